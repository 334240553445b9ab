"""MinHash near-dedup by chosen-path set similarity join.

Sets are the 5-word shingles of whole texts, as 64-bit hashes.  Texts with equal sets form a class
and only its representative goes on.  Each representative has ``WIDTH`` minwise tokens.  A tree
starts with all documents in its root; a node picks ``BRANCH`` of the minwise positions (by a hash
of its path), and sends each document to the child named by the token that it has there.  Nodes of
one document end.  Nodes of up to ``SMALL`` documents are compared exhaustively; larger ones branch
again.  ``TREES`` independent trees are grown at once.

Recall.  A pair of similarity s survives a node with probability p = 1 - (1 - s p)^2; for s = 0.75
the fixed point is 8/9, at any depth, so six trees miss such a pair with probability below 2e-6, and
pairs further above the threshold less.  Pairs are tested on 64 tokens first (those with fewer than
34 alike have 0.75 with a chance below 3 in 10^5) and confirmed on full sets.

Large groups.  Only connectivity is asked for, so first every document is compared with one leader:
of its root children's least ids the one most like it.  That is one pair a document, and it joins
groups of near copies of any size.  Nodes whose documents all have one component are then finished;
the trees look only for pairs between components.  Where a component has half of a node, and
half of the component lies there, it leaves the node: the others meet all of it, once for all nodes, and
only they go on.  Branching cannot part documents that are nearly all alike, and going on would repeat
them in ever more nodes, so a node that kept at least ``KEEPS`` of its parent's documents, and one of up
to ``FINISH`` that kept ``HALF`` of them or was left by a component, is finished at once: where up to ``REST`` documents lie outside its largest component, by
comparing these with all of it, dealt over tasks, else in blocks of ``BLOCK`` documents, whole, each block
pair a task of its own.  The same is done with nodes still large at ``DEPTH``.  A crowd in which no
component has half is thus compared in full, in each node that it fills: a square of its documents.

Defined cases: null and empty texts, and texts of white space, have n_shingles 0 and link with
nothing; shorter texts than five words have one shingle; a null id links with nothing and stays;
rows that share an id are one document to the components; an empty table gives an empty result;
further columns are kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import by_row, connected_components
from .ranks import rank_within
from .scratch import Scratch, unused
from .wordhash import mix, shingle_sets
from .worker import lean

SHINGLE, THRESHOLD = 5, 75
WIDTH, TREES, BRANCH, SMALL, DEPTH, BLOCK = 64, 6, 2, 48, 12, 256
#: A node that holds this share of its parent has not been parted by branching.
KEEPS = 0.75
#: Documents outside an unparted node's largest component up to which they are compared with the whole
#: node, and the documents of a node that one task then holds.
REST, CHUNK = 256, 1024
#: Documents up to which a node is finished at once, in two blocks at most, where its children would repeat them:
#: where it holds this share of its parent, or is what a main component left.
FINISH, HALF = 512, 0.5
#: Equal minwise tokens of ``WIDTH`` from which a pair is confirmed on its full sets.
ALIKE = 34
#: Ids of candidates that are broadcast at most (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(4242)
_MUL = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64)
#: Positions that the roots pick, distinct over all trees.
_ROOT = _RNG.permutation(WIDTH)[: TREES * BRANCH]


def minwise(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``flat``: 16 bits of the least hashes by ``WIDTH`` functions, and the ids of
    its children in the roots, from all bits of the tokens there."""
    out, roots = np.empty((len(starts), WIDTH), np.uint16), np.empty((len(starts), len(_ROOT)), np.uint64)
    slot = {int(j): k for k, j in enumerate(_ROOT)}
    with np.errstate(over="ignore"):
        for j in range(WIDTH):
            least = mix(np.minimum.reduceat((flat * _MUL[j] + _ADD[j]) >> np.uint64(8), starts))
            out[:, j] = least & np.uint64(0xFFFF)
            if j in slot:
                roots[:, slot[j]] = mix(least + _ADD[slot[j]])
    return out, roots


@lean
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        n, low, high, sig, path, held, done = [], [], [], [], [], [], 0

        def flush() -> None:
            if held:
                lengths = np.array([len(s) for s in held])
                some = np.flatnonzero(lengths)
                found, roots = np.zeros((len(held), WIDTH), np.uint16), np.zeros((len(held), len(_ROOT)), np.uint64)
                a, b = np.zeros(len(held), np.uint64), np.zeros(len(held), np.uint64)
                if len(some):
                    flat = np.concatenate(held)
                    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[some]
                    found[some], roots[some] = minwise(flat, starts)
                    with np.errstate(over="ignore"):
                        a[some] = np.add.reduceat(mix(flat + np.uint64(1)), starts)
                        b[some] = np.add.reduceat(mix(flat ^ np.uint64(0x5DEECE66D)), starts)
                n.extend(lengths.tolist()), low.append(a.view(np.int64)), high.append(b.view(np.int64))
                sig.extend(row.tobytes() for row in found)
                path.extend(row.tobytes() for row in roots)
                held.clear()

        for shingles in shingle_sets(text, SHINGLE):
            held.append(shingles)
            done += len(shingles)
            if done > 200_000:
                flush()
                done = 0
        flush()
        if n:
            yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(np.concatenate(low)), pa.array(np.concatenate(high)), pa.array(sig, pa.binary()), pa.array(path, pa.binary())], names=["id", "n", "lo", "hi", "sig", "path"])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        node = _matrix(batch.column(1), np.int64, len(_ROOT))
        yield pa.record_batch([pa.array(np.repeat(ids, len(_ROOT))), pa.array(node.reshape(-1))], names=["id", "node"])


def _matrix(column: pa.Array, kind: type = np.uint16, width: int = WIDTH) -> np.ndarray:
    _, where, data = column.buffers()
    at = int(np.frombuffer(where, np.int32)[column.offset])
    raw = bytes(data)[at : at + np.dtype(kind).itemsize * width * len(column)] if data is not None else b""
    return np.frombuffer(raw, kind).reshape(-1, width)


def _like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, sa, sb -> a, b, alike: equal minwise tokens, where enough."""
    for batch in batches:
        alike = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1)
        keep = pa.array(alike >= ALIKE)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(alike.astype(np.int32))], names=["a", "b", "alike"]).filter(keep)


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, id, comp, sig, n (of the node) -> the same for the children."""
    for batch in batches:
        node = batch.column(0).to_numpy().view(np.uint64)
        sig = _matrix(batch.column(3))
        at = np.arange(len(node))
        for k in range(BRANCH):
            with np.errstate(over="ignore"):
                pick = mix(node + np.uint64(2 * k + 1))
                position = (pick >> np.uint64(32)) % np.uint64(WIDTH)
                child = mix(pick ^ (sig[at, position.astype(np.int64)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            yield pa.record_batch([pa.array(child.view(np.int64)), *batch.columns[1:]], names=["node", "id", "comp", "sig", "was"])


def _exhaust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node, at most ``SMALL`` of each -> pairs of different components that are alike."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*kept, batch]).combine_chunks()
        nodes = table.column(0).to_numpy()
        last = int(np.searchsorted(nodes[::-1] != nodes[-1], True)) if nodes[0] != nodes[-1] else len(nodes)
        kept = table.slice(len(nodes) - last).to_batches()
        yield from _pairs(table.slice(0, len(nodes) - last))
    if kept:
        yield from _pairs(pa.Table.from_batches(kept).combine_chunks())


def _pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if table.num_rows < 2:
        return
    node, ids, comp = (table.column(i).to_numpy() for i in range(3))
    sig = _matrix(table.column(3).combine_chunks() if table.column(3).num_chunks != 1 else table.column(3).chunk(0))
    for step in range(1, SMALL):
        i = np.flatnonzero(node[:-step] == node[step:])
        if not len(i):
            return
        i = i[comp[i] != comp[i + step]]
        for part in range(0, len(i), 100_000):
            k = i[part : part + 100_000]
            k = k[(sig[k] == sig[k + step]).sum(axis=1) >= ALIKE]
            if len(k):
                yield pa.record_batch([pa.array(np.maximum(ids[k], ids[k + step])), pa.array(np.minimum(ids[k], ids[k + step]))], names=["a", "b"])


def _lopsided(tables: Scratch, label: str, texts: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Links of documents outside their node's main component with all of the node.

    Sets travel with the rows and decide on the spot: what comes out is one confirmed link for each
    document and component, not the candidates.
    """
    rows = tables.table(f"{label}-rows", rows)
    if rows.isEmpty():
        return None
    rows = _with_sets(tables, label, texts, rows)
    found = tables.table(f"{label}-links", _met(_grid(rows.withColumn("rest", F.lit(REST)), rows.where("comp <> main").withColumn("rest", F.lit(REST)))))
    tables.drop(f"{label}-sets", f"{label}-rows")
    return found


def _grid(whole: DataFrame, others: DataFrame) -> DataFrame:
    """Meetings of some ``REST`` others (``rest`` of them in their node) with some ``CHUNK`` of all its ``n`` documents."""
    chunks, blocks = F.ceil(F.col("n") / CHUNK).cast("long"), F.ceil(F.col("rest") / REST).cast("long")
    each = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), many - 1))
    dealt = lambda many: F.pmod(F.xxhash64("id"), many)
    whole = whole.withColumn("one", dealt(chunks)).withColumn("other", each(blocks)).withColumn("kind", F.lit(1))
    others = others.withColumn("one", each(chunks)).withColumn("other", dealt(blocks)).withColumn("kind", F.lit(0))
    return whole.unionByName(others).withColumn("chunk", F.col("other") * chunks + F.col("one"))


def _hung(tables: Scratch, texts: DataFrame, reps: DataFrame, comp: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Links of documents with the main components that they have met in any node, each pair of these once.

    ``rows``: id, comp, sig, main.  As in ``_lopsided`` sets decide on the spot.
    """
    others = tables.table("hung-rows", rows.dropDuplicates(["id", "main"]))
    if others.isEmpty():
        return None
    mains = tables.table("hung-mains", others.groupBy("main").agg(F.count(F.lit(1)).alias("rest")))
    whole = comp.select(F.col("node").alias("id"), F.col("component").alias("comp")).join(mains.hint("shuffle_hash"), F.col("comp") == F.col("main"))
    whole = tables.table("hung-whole", whole.join(reps.select("id", "sig").hint("shuffle_hash"), "id"))
    mains = tables.table("hung-sizes", whole.groupBy("main").agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("rest")))
    both = whole.drop("rest").withColumn("all", F.lit(True)).unionByName(others.withColumn("all", F.lit(False)))
    both = tables.table("hung-both", both.join(mains.hint("shuffle_hash"), "main").withColumn("node", F.col("main")))
    both = _with_sets(tables, "hung", texts, both)
    found = tables.table("hung-links", _met(_grid(both.where("all"), both.where("NOT all"))))
    tables.drop("hung-sets", "hung-both", "hung-sizes", "hung-whole", "hung-mains", "hung-rows")
    return found


def _blocks(tables: Scratch, texts: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Links between components within large nodes: each meeting is of two blocks of one node, or one with itself.

    As in ``_lopsided`` sets decide on the spot, so a crowd of texts that are nearly alike leaves no candidates.
    """
    rows = tables.table("blocks-rows", rows)
    if rows.isEmpty():
        return None
    ranked = rank_within(tables, "blocks", rows, "node", ["id"]).withColumn("block", F.floor(F.col("rank") / BLOCK))
    most = ranked.groupBy("node").agg(F.max("block").alias("last"))
    ranked = tables.table("blocks-ranked", ranked.join(most, "node").select("node", "id", "comp", "sig", "block", "last"))
    block, other = F.col("block"), F.col("other")
    met = _with_sets(tables, "blocks", texts, ranked).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    kinds = F.when(block < other, F.array(F.lit(0))).when(block > other, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    met = met.withColumn("chunk", F.least(block, other) * (F.col("last") + 1) + F.greatest(block, other)).withColumn("kind", F.explode(kinds))
    found = tables.table("blocks-links", _met(met))
    tables.drop("blocks-sets", "blocks-ranked", "blocks-rows")
    return found


def _with_sets(tables: Scratch, label: str, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with the full sets of their documents."""
    need = tables.table(f"{label}-need", rows.select("id").distinct())
    need = F.broadcast(need) if need.count() <= BROADCAST_IDS else need.hint("shuffle_hash")
    return rows.join(tables.table(f"{label}-sets", texts.join(need, "id").mapInArrow(_full_sets, "id long, set binary")), "id")


def _met(rows: DataFrame) -> DataFrame:
    """Links between the documents of kind 0 and those of kind 1 of each node and chunk."""
    rows = rows.select("node", "chunk", "kind", "id", "comp", "sig", "set")
    return rows.repartition("node", "chunk").sortWithinPartitions("node", "chunk", "kind", "id").mapInArrow(_against, "a long, b long")


@lean
def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), SHINGLE)]
            yield pa.record_batch([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "set"])


@lean
def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node, chunk and kind: the others (kind 0, at most ``REST`` or ``BLOCK``) come first and are
    kept, then the node's documents stream by and are compared with them on their full sets."""
    key, ids, comps, sigs, kept = None, np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, WIDTH), np.uint16), []
    for batch in batches:
        node, chunk, kind, own, comp = (batch.column(k).to_numpy() for k in range(5))
        sig = _matrix(batch.column(5))
        cuts = np.flatnonzero((node[1:] != node[:-1]) | (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)]):
            if lo == hi:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(6).slice(lo, hi - lo).to_pylist()]
            if kind[lo] == 0:
                if key != (node[lo], chunk[lo]):
                    key, ids, comps, sigs, kept = (node[lo], chunk[lo]), ids[:0], comps[:0], sigs[:0], []
                ids, comps, sigs = np.concatenate([ids, own[lo:hi]]), np.concatenate([comps, comp[lo:hi]]), np.concatenate([sigs, sig[lo:hi]])
                kept = kept + sets
                continue
            left, right = [], []
            for k in range(len(ids)):
                near = np.flatnonzero((comp[lo:hi] != comps[k]) & ((sig[lo:hi] == sigs[k]).sum(axis=1) >= ALIKE))
                # One confirmed link to each component is enough.
                done: set[int] = set()
                for part in range(0, len(near), 64):
                    some = np.array([j for j in near[part : part + 64] if comp[lo + j] not in done], np.int64)
                    if not len(some):
                        continue
                    size = np.array([len(sets[j]) for j in some])
                    flat = np.concatenate([sets[j] for j in some])
                    at = np.minimum(np.searchsorted(kept[k], flat), len(kept[k]) - 1)
                    both = np.add.reduceat((kept[k][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
                    for j in some[100 * both >= THRESHOLD * (size + len(kept[k]) - both)]:
                        if comp[lo + j] not in done:
                            done.add(int(comp[lo + j]))
                            left.append(max(own[lo + j], ids[k])), right.append(min(own[lo + j], ids[k]))
            if left:
                yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _confirm(tables: Scratch, label: str, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    need = tables.table(f"{label}-need", pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    need = F.broadcast(need) if need.count() <= BROADCAST_IDS else need.hint("shuffle_hash")
    held = tables.table(f"{label}-texts", texts.join(need, "id"))
    left, right = held.select(F.col("id").alias("a"), F.col("text").alias("ta")), held.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(shingle_sets(batch.column(2), SHINGLE), shingle_sets(batch.column(3), SHINGLE)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= THRESHOLD * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    wide = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return tables.table(f"{label}-edges", wide.mapInArrow(measure, "a long, b long"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    tables = Scratch(docs.sparkSession, "chosen-path")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = tables.table("sets", texts.mapInArrow(_signatures, "id long, n long, lo long, hi long, sig binary, path binary"))
    linked = sets.where("n > 0 AND id IS NOT NULL")
    classes = tables.table("classes", linked.groupBy("lo", "hi").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")))
    if not linked.groupBy("id").agg(F.countDistinct("lo", "hi").alias("k")).where("k > 1").isEmpty():
        # One id with different texts: all of them are searched.
        tables.drop("sets", "classes")
        search = lambda rows: annotate(rows, "key", "text").withColumn("linked", F.col("n_shingles") > 0)
        out = by_row(tables, texts, search, "n_shingles")
        return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), F.col("id").eqNullSafe(F.col("label")).alias("kept"))
    # One row for each representative; exact rows that repeat are dropped.
    reps = linked.join(classes.select("lo", "hi", F.col("rep").alias("id")).hint("shuffle_hash"), ["lo", "hi", "id"]).select("id", "sig", "path")
    reps = tables.table("reps", reps.dropDuplicates(["id"]))
    edges = _links(tables, texts, reps)
    component = tables.table("component", connected_components(tables, "all", edges))
    tables.drop("reps")
    labels = classes.join(component, classes["rep"] == component["node"], "left").select("lo", "hi", F.coalesce("component", "rep").alias("label"))
    out = sets.where("n > 0 AND id IS NOT NULL").join(labels.hint("shuffle_hash"), ["lo", "hi"]).select("id", "n", "label")
    out = out.unionByName(sets.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("label")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), F.col("id").eqNullSafe(F.col("label")).alias("kept"))


def _links(tables: Scratch, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges that connect all representatives that a chain of links connects."""
    roots = tables.table("roots", reps.select("id", "path").mapInArrow(_roots, "id long, node long"))
    crowd = roots.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("leader")).where("n > 1")
    crowd = tables.table("crowd", crowd)
    members = tables.table("members", roots.join(crowd.hint("shuffle_hash"), "node").select("node", "id", "leader"))
    tables.drop("roots")
    # Each document and the leader most like it: one pair a document.
    stars = members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    stars = stars.join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    stars = tables.table("stars", stars.select("a", "b", "sa", "sb").mapInArrow(_like, "a long, b long, alike int"))
    one = stars.groupBy("a").agg(F.max(F.struct("alike", -F.col("b"))).alias("m")).select("a", (-F.col("m")["col2"]).alias("b"))
    edges = _confirm(tables, "star", texts, tables.table("one", one))
    comp = tables.table("star-comp", connected_components(tables, "star", edges))
    tables.drop("star-texts")
    state = members.select("node", "id").join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    state = state.join(reps.select("id", "sig"), "id").select("node", "id", F.coalesce("component", "id").alias("comp"), "sig", F.lit(None).cast("long").alias("was"))
    sizes = tables.table("sizes", comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    small: list[DataFrame] = []
    lopsided: list[DataFrame] = []
    dense: list[DataFrame] = []
    hung: list[DataFrame] = []
    columns = ["node", "id", "comp", "sig"]
    for depth in range(DEPTH + 1):
        state = tables.table(f"level-{depth}", state)
        parts = state.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("was").alias("was"))
        stats = parts.groupBy("node").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k"), F.max("was").alias("was")).where("k > 1")
        stats = stats.select("node", "n", "k", "was", F.col("top.c").alias("c"), F.col("top.comp").alias("main"))
        stats = stats.join(sizes.hint("shuffle_hash"), F.col("main") == F.col("component"), "left").drop("component")
        # Half of the node, and half of the component: the others meet the component once, whole, and leave it here.
        hangs = (F.col("n") > SMALL) & (2 * F.col("c") >= F.col("n")) & (2 * F.col("c") >= F.coalesce("size", F.lit(1)))
        unparted = F.lit(depth == DEPTH) | F.coalesce(F.col("n") >= F.when(F.col("n") <= FINISH, HALF).otherwise(KEEPS) * F.col("was"), F.lit(False))
        rest = F.col("n") - F.col("c")
        way = F.when(F.col("n") <= SMALL, "small").when(~unparted, "branch").when(rest <= REST, "lopsided").otherwise("blocks")
        left = F.when(F.col("k") == 2, "done").when(rest <= SMALL, "small").when(F.lit(depth == DEPTH) | (rest <= FINISH), "blocks").otherwise("branch")
        stats = stats.withColumn("hangs", hangs).withColumn("way", F.when(hangs, left).otherwise(way)).withColumn("n", F.when(hangs, rest).otherwise(F.col("n")))
        # Written, so that the join below reads nothing but two shuffles and a hot node may be split.
        stats = tables.table(f"stats-{depth}", stats.select("node", "n", "main", "way", "hangs"))
        alive = state.drop("was").join(stats.hint("shuffle_hash"), "node").where("NOT hangs OR comp <> main")
        alive = tables.table(f"alive-{depth}", alive)
        tables.drop(f"level-{depth}", f"stats-{depth}")
        hung.append(alive.where("hangs").select("id", "comp", "sig", "main"))
        for way, kept in (("small", small), ("lopsided", lopsided), ("blocks", dense)):
            kept.append(alive.where(F.col("way") == way).drop("way", "hangs"))
        large = alive.where("way = 'branch'").select(*columns, "n")
        if large.isEmpty():
            break
        state = large.mapInArrow(_branch, "node long, id long, comp long, sig binary, was long")
    sure = _hung(tables, texts, reps, comp, reduce(DataFrame.unionByName, hung))
    edges = edges if sure is None else edges.unionByName(sure)
    # Nodes have names of their own at every depth, so all depths are finished together.
    sure = _lopsided(tables, "lopsided", texts, reduce(DataFrame.unionByName, lopsided))
    edges = edges if sure is None else edges.unionByName(sure)
    sure = _blocks(tables, texts, reduce(DataFrame.unionByName, dense).select(*columns))
    edges = edges if sure is None else edges.unionByName(sure)
    together = reduce(DataFrame.unionByName, small).select(*columns).repartition("node").sortWithinPartitions("node")
    pairs = together.mapInArrow(_exhaust, "a long, b long")
    pairs = tables.table("pairs", pairs.distinct())
    tables.drop(*[f"alive-{k}" for k in range(DEPTH + 1)])
    if pairs.isEmpty():
        return edges
    return edges.unionByName(_confirm(tables, "path", texts, pairs))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one with the least id; its row is unchanged."""
    tables = Scratch(docs.sparkSession, "chosen-path-stage")
    key = unused(docs, "__qw_id")
    gone = tables.table("gone", annotate(docs, id_col, text_col).where("NOT kept").select(F.col(id_col).alias(key)).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(key), "left_anti")
