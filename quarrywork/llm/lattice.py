"""Embedding near-dedup by lattice hashing.

A table projects unit vectors on random directions, eight for a block, and decodes each block to the
nearest point of the E8 lattice; the points of its blocks name a vector's cell.  A vector lives in one
cell a table and probes that cell and the neighbouring cells nearest to it (a step to one of the 240
neighbours in some of its blocks).  Vectors that meet in a cell, home against probe, are candidates;
64 sign bits drop most chance meetings inside the join, and cosines in double precision decide.

``plan_of`` gives blocks, tables and probes for the number of distinct vectors of a label: one block
tells some 36,000 cells apart, so beyond ``PLANS``' bounds cells get one more block, and more tables
and probes hold the recall.  So chance meetings a vector stay below a constant instead of growing with
the label.  By simulation every plan misses a pair at cosine 0.93 with about 1 in 10^3, at every length of the
vectors (64, 128 and 768 are tested); closer pairs far less.

Large groups never become pairs.  Equal vectors form a class that is hashed once and counts by its
size.  In cells of ``DENSE`` vectors or more, those within half the threshold's angle of the cell's
mean direction form a clique: any two of them are within the whole angle, so they are linked without
comparison.  Cliques enter a cell once.  Between cliques the triangle inequality settles most pairs;
the others are compared in blocks of ``BLOCK`` by ``BLOCK`` vectors, and a block yields one count
for each vector and one edge, never its pairs.

Defined cases: null, empty, zero and non-finite vectors, null labels and null ids have n_links 0,
their own id as component and stay; vectors of different lengths do not link; rows that share an id
are counted one by one and have one component; an empty table gives an empty result; further columns
are kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import by_row, connected_components
from .scratch import Scratch, unused
from .wordhash import mix
from .worker import lean

THRESHOLD = 0.93
SEED = 99
#: Distinct vectors of a label up to which a plan is used; its blocks, scale, tables and probes.
PLANS = (
    (1 << 15, 1, 0.9, 5, 16), (1 << 17, 2, 0.6, 8, 32), (1 << 19, 2, 0.7, 9, 64),
    (1 << 21, 2, 0.8, 16, 64), (1 << 24, 3, 0.6, 11, 160), (None, 3, 0.7, 16, 320),
)
#: Differing sign bits of 64 up to which a meeting of two single vectors is looked at.
SIGNS = 22
DENSE, BLOCK = 8, 1024
#: Labels whose plans are broadcast at most (24 bytes each); beyond it the join shuffles.
BROADCAST_LABELS = 100_000


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all +-1/2 with an even number of minuses."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            found.append(v)
    found += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(found)


ROOTS = _roots()


_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers of even sum; where odd, the worst rounded one goes the other way."""
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(y - r)[odd].argmax(axis=1)
    r[odd, worst] += np.where(y[odd, worst] >= r[odd, worst], 1.0, -1.0)
    return r


def nearest_e8(y: np.ndarray) -> np.ndarray:
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _code(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit name for lattice points (last axis), salted by table and group."""
    code = np.broadcast_to(salt, points.shape[:-1]).astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(8):
            code = mix(code * _FOLD + np.rint(2 * points[..., k]).astype(np.int64).view(np.uint64))
    return code


def plan_of(n: int) -> int:
    """The place in ``PLANS`` for a label of ``n`` distinct vectors."""
    return next(k for k, (most, *_) in enumerate(PLANS) if most is None or n <= most)


def cells(unit: np.ndarray, group: np.ndarray, plan: int = 0, only_home: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cells (n, tables), probed cells (n, tables * (1 + probes)) and 64 sign bits; with
    ``only_home`` the first table's home cells and nothing else."""
    n, dim = unit.shape
    _, blocks, scale, tables, probes = PLANS[plan]
    rng = np.random.default_rng([SEED, dim, plan] if plan else [SEED, dim])
    home, probe = [], []
    for t in range(tables):
        salt = mix(group + np.uint64(t + 1))
        own, codes, costs = salt, None, None
        for _ in range(blocks):
            # A unit vector times a standard normal matrix has the same spread at every length.
            y = unit @ (rng.normal(size=(dim, 8)) * scale)
            point = nearest_e8(y)
            if only_home:
                with np.errstate(over="ignore"):
                    own = mix(own * _FOLD + _code(point, np.uint64(0)))
                continue
            gain = (y - point) @ ROOTS.T
            # Steps to the nearest neighbours, by what they add to the squared distance; no step adds nothing.
            near = np.argpartition(-gain, min(probes, 32), axis=1)[:, : min(probes, 32)]
            step = np.concatenate([np.zeros((n, 1)), 2 - 2 * np.take_along_axis(gain, near, axis=1)], axis=1)
            code = np.concatenate([_code(point, np.uint64(0))[:, None], _code(point[:, None, :] + ROOTS[near], np.uint64(0))], axis=1)
            with np.errstate(over="ignore"):
                own = mix(own * _FOLD + code[:, 0])
                if codes is None:
                    codes, costs = mix(salt[:, None] * _FOLD + code), step
                else:
                    codes = mix(codes[:, :, None] * _FOLD + code[:, None, :]).reshape(n, -1)
                    costs = (costs[:, :, None] + step[:, None, :]).reshape(n, -1)
            if codes.shape[1] > probes + 1:
                best = np.argpartition(costs, probes, axis=1)[:, : probes + 1]
                codes, costs = np.take_along_axis(codes, best, axis=1), np.take_along_axis(costs, best, axis=1)
        home.append(own)
        if only_home:
            return own[:, None], np.empty((n, 0), np.uint64), np.zeros(n, np.uint64)
        probe.append(codes)
    bits = (unit @ rng.normal(size=(dim, 64))) > 0
    signs = np.packbits(bits, axis=1).view(np.uint64)[:, 0]
    return np.stack(home, axis=1), np.concatenate(probe, axis=1), signs


@lru_cache(maxsize=4096)
def _label_digest(label) -> tuple[int, int]:
    """128 bits of a label's own text, as two signed numbers."""
    raw = hashlib.md5(repr(label + 0.0 if isinstance(label, float) else label).encode()).digest()
    return tuple(int.from_bytes(raw[k : k + 8], "little", signed=True) for k in (0, 8))


@lean
def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, vector, label -> id, group (label and length, 128 bits), hashes and bytes of the vector as
    doubles; null where unusable."""
    for batch in batches:
        out: list[tuple] = []
        for i, v, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            x = None if not v.is_valid or label is None or i is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if x is None or not len(x) or not np.isfinite(x).all() or not np.abs(x).max() > 0:
                out.append((i, None, None, None, None, None))
                continue
            x = x + 0.0  # -0.0 and 0.0 are equal
            word = mix(x.view(np.uint64))
            at = mix(np.arange(1, len(x) + 1, dtype=np.uint64))
            with np.errstate(over="ignore"):
                a, b = ((mix(word ^ at) * at).sum(dtype=np.uint64), (mix(word + at) * (at | np.uint64(1))).sum(dtype=np.uint64))
            g, l = (g ^ len(x) for g in _label_digest(label))
            out.append((i, g, l, int(a.view(np.int64)), int(b.view(np.int64)), x.tobytes()))
        if out:
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["id", "grp", "lab", "h0", "h1", "vec"])


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors, by length."""
    raw = column.to_pylist()
    size = np.array([len(r) // 8 for r in raw])
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        x = np.frombuffer(b"".join(raw[k] for k in at), np.float64).reshape(len(at), dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
        yield at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows of one vector length and one plan, their unit vectors and groups: grp, plan and vec are the
    second to fourth columns."""
    plan = batch.column(2).to_numpy()
    for at, unit in _units(batch.column(3)):
        for k in np.unique(plan[at]):
            own = plan[at] == k
            yield at[own], unit[own], batch.column(1).to_numpy()[at[own]].view(np.uint64), int(k)


@lean
def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, grp, plan, vec, lab -> id, first home cell, grp, lab, unit vector."""
    for batch in batches:
        for at, unit, group, plan in _alike(batch):
            # The first table's home cells alone: no probes.
            home, _, _ = cells(unit, group, plan, only_home=True)
            yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(home[:, 0].view(np.int64)), batch.column(1).take(pa.array(at)), batch.column(4).take(pa.array(at)), pa.array(list(unit))], names=["id", "cell", "grp", "lab", "unit"])


@lean
def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, grp, plan, vec, clique -> cell, clique, signs, home."""
    for batch in batches:
        for at, unit, group, plan in _alike(batch):
            clique = batch.column(4).to_numpy()[at]
            step = max(1, 1_000_000 // (PLANS[plan][3] * (1 + PLANS[plan][4])))
            for lo in range(0, len(at), step):
                home, probe, signs = cells(unit[lo : lo + step], group[lo : lo + step], plan)
                for code, is_home in ((home, True), (probe, False)):
                    k = code.shape[1]
                    yield pa.record_batch(
                        [pa.array(code.reshape(-1).view(np.int64)), pa.array(np.repeat(clique[lo : lo + step], k)), pa.array(np.repeat(signs, k).view(np.int64)), pa.array(np.full(code.size, is_home))],
                        names=["cell", "clique", "signs", "home"],
                    )


def _angle(cosine) -> F.Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _dot(a, b) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def annotate(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    tables = Scratch(vectors.sparkSession, "lattice")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("l"))
    rows = tables.table("rows", base.mapInArrow(_prepare, "id long, grp long, lab long, h0 long, h1 long, vec binary"))
    same = ["grp", "lab", "h0", "h1"]
    classes = tables.table("classes", rows.where("vec IS NOT NULL").groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")))
    if not rows.where("vec IS NOT NULL").groupBy("id").agg(F.countDistinct(*same).alias("k")).where("k > 1").isEmpty():
        # One id with different vectors: all of them are searched.
        off = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        usable = F.col("l").isNotNull() & (F.size("v") > 0) & ~F.exists("v", off) & F.exists("v", lambda x: x != 0)
        search = lambda r: annotate(r, "key", "v", "l").join(r.select(F.col("key").alias("__k"), F.coalesce(usable, F.lit(False)).alias("linked")).where("key IS NOT NULL"), F.col("key") == F.col("__k"), "left")
        out = by_row(tables, base, search, "n_links")
        return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), F.col("label").alias("component_id"), F.col("id").eqNullSafe(F.col("label")).alias("kept"))
    reps = rows.join(classes.withColumnRenamed("rep", "id"), [*same, "id"]).select("id", "grp", "lab", "m", "vec").dropDuplicates(["id"])
    # One row a label and length: distinct vectors, and the plan for so many.
    sizes = tables.table("sizes", classes.groupBy("grp", "lab").agg(F.count(F.lit(1)).alias("k")))
    plan = F.lit(len(PLANS) - 1)
    for k in reversed(range(len(PLANS) - 1)):
        plan = F.when(F.col("k") <= PLANS[k][0], k).otherwise(plan)
    sizes = sizes.select("grp", "lab", plan.alias("plan"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LABELS else sizes.hint("shuffle_hash")
    reps = tables.table("reps", tables.table("single", reps).join(sizes, ["grp", "lab"]))
    tables.drop("single")
    member = tables.table("member", _cliques(tables, reps))
    links, edges = _between(tables, member)
    inside = member.groupBy("clique").agg(F.sum("m").alias("total"))
    component = tables.table("component", connected_components(tables, "cliques", edges))
    per = member.select("id", "clique").join(inside, "clique").join(component, F.col("clique") == F.col("node"), "left").join(links, "id", "left")
    per = per.select("id", (F.col("total") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "clique").alias("c"))
    found = rows.where("vec IS NOT NULL").join(classes, same).select(F.col("id").alias("__id"), "rep").join(per.withColumnRenamed("id", "rep"), "rep").select("__id", "n", "c")
    out = found.unionByName(rows.where("vec IS NULL").select(F.col("id").alias("__id"), F.lit(0).cast("long").alias("n"), F.col("id").alias("c")))
    return out.select(F.col("__id").alias(id_col), F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.col("__id").eqNullSafe(F.col("c")).alias("kept"))


def _cliques(tables: Scratch, reps: DataFrame) -> DataFrame:
    """id, grp, lab, plan, m, vec, clique, and for the members of cliques of two or more: centre and angle."""
    by = ["cell", "grp", "lab"]
    homes = reps.select("id", "grp", "plan", "vec", "lab").mapInArrow(_homes, "id long, cell long, grp long, lab long, unit array<double>")
    homes = tables.table("homes", homes)
    dense = tables.table("dense", homes.groupBy(*by).count().where(F.col("count") >= DENSE).select(*by))
    crowded = tables.table("crowded", homes.join(dense, by, "left_semi"))
    tables.drop("homes", "dense")
    mean = crowded.select(*by, F.posexplode("unit").alias("k", "x")).groupBy(*by, "k").agg(F.sum("x").alias("x"))
    mean = mean.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("c")).select(*by, F.col("c.x").alias("c"))
    mean = mean.withColumn("norm", F.sqrt(_dot(F.col("c"), F.col("c")))).where("norm > 0").select(*by, F.transform("c", lambda x: x / F.col("norm")).alias("centre"))
    mean = tables.table("mean", mean)
    half = float(np.arccos(THRESHOLD) / 2 - 1e-7)
    inside = crowded.join(mean, by).withColumn("angle", _angle(_dot(F.col("unit"), F.col("centre")))).where(F.col("angle") <= half)
    inside = tables.table("inside", inside.select("id", *by, "centre", "angle"))
    tables.drop("crowded", "mean")
    named = tables.table("named", inside.groupBy(*by).agg(F.min("id").alias("clique"), F.max("angle").alias("radius")))
    inside = inside.join(named, by).select("id", "clique", "centre", "radius")
    return reps.join(inside, "id", "left").withColumn("big", F.col("clique").isNotNull()).withColumn("clique", F.coalesce("clique", "id"))


def _between(tables: Scratch, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between members of different cliques (id, links), and edges between cliques."""
    entries = member.select("id", "grp", "plan", "vec", "clique", "big")
    single = entries.where("NOT big").select("id", "grp", "plan", "vec", "clique").mapInArrow(_entries, "cell long, clique long, signs long, home boolean").withColumn("big", F.lit(False))
    # A clique enters each cell once.
    grouped = entries.where("big").select("id", "grp", "plan", "vec", "clique").mapInArrow(_entries, "cell long, clique long, signs long, home boolean")
    grouped = grouped.groupBy("cell", "clique", "home").agg(F.min("signs").alias("signs")).withColumn("big", F.lit(True)).select(*single.columns)
    met = single.unionByName(grouped)
    a = met.where("home").select("cell", F.col("clique").alias("a"), F.col("signs").alias("sa"), F.col("big").alias("ba"))
    b = met.where("NOT home").select("cell", F.col("clique").alias("b"), F.col("signs").alias("sb"), F.col("big").alias("bb"))
    close = F.col("ba") | F.col("bb") | (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= SIGNS)
    pairs = a.join(b.hint("shuffle_hash"), "cell").where(close & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = tables.table("pairs", pairs)
    ball = member.where("big").groupBy("clique").agg(F.first("centre").alias("centre"), F.first("radius").alias("radius"))
    of = lambda k: ball.select(F.col("clique").alias(k), F.col("centre").alias(f"c{k}"), F.col("radius").alias(f"r{k}"))
    # Two cliques whose balls are too far apart have no link.
    apart = _angle(_dot(F.col("ca"), F.col("cb"))) - F.col("ra") - F.col("rb") > float(np.arccos(THRESHOLD) + 1e-7)
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce(apart, F.lit(False))).select("a", "b")
    pairs = tables.table("near", pairs)
    rank = member.select("id", "grp", "lab", "m", "vec", "clique", F.floor(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * 1.0).alias("deal"), "big")
    size = member.groupBy("clique").count().select("clique", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    dealt = rank.join(size, "clique").withColumn("block", F.pmod("deal", F.col("blocks"))).select("id", "grp", "lab", "m", "vec", "clique", "block", "blocks")
    blocks = size.select("clique", "blocks")
    sized = pairs.join(blocks.select(F.col("clique").alias("a"), F.col("blocks").alias("na")), "a").join(blocks.select(F.col("clique").alias("b"), F.col("blocks").alias("nb")), "b")
    grid = sized.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).select("a", "b", "i", "j")
    left = grid.join(dealt, (F.col("clique") == F.col("a")) & (F.col("block") == F.col("i")))
    right = grid.join(dealt, (F.col("clique") == F.col("b")) & (F.col("block") == F.col("j")))
    tasks = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).select("a", "b", "i", "j", "side", "id", "m", "vec", "grp", "lab")
    tasks = tasks.repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j", "side", "id")
    got = tables.table("links", tasks.mapInArrow(_compare, "id long, links long, a long, b long"))
    links = got.where("id IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    return links, got.where("a IS NOT NULL").select("a", "b").distinct()


@lean
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block pair; a pair has at most a few ``BLOCK`` rows and is compared at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        cut = _cuts(table)
        yield from _blocks(table, cut[:-1])
        held = table.slice(cut[-2] if len(cut) > 1 else 0).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield from _blocks(table, _cuts(table))


def _cuts(table: pa.Table) -> list[int]:
    keys = np.stack([table.column(k).to_numpy() for k in range(4)])
    return [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]


def _blocks(table: pa.Table, cut: list[int]) -> Iterator[pa.RecordBatch]:
    ids, links, left, right = [], [], [], []
    side, ident, m = (table.column(k).to_numpy() for k in (4, 5, 6))
    a, b, vec = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(7)
    grp, lab = table.column(8).to_numpy(), table.column(9).to_numpy()
    for lo, hi in zip(cut, cut[1:]):
        mid = lo + int(np.searchsorted(side[lo:hi], 1))
        if mid in (lo, hi) or grp[lo] != grp[mid] or lab[lo] != lab[mid]:
            continue  # a clique has one label, and labels may share a cell's name
        x, y = (_stack(vec.slice(s, e - s)) for s, e in ((lo, mid), (mid, hi)))
        linked = np.einsum("ik,jk->ij", x, y) >= THRESHOLD
        if linked.any():
            for own, other, hit in (((lo, mid), (mid, hi), linked), ((mid, hi), (lo, mid), linked.T)):
                count = hit @ m[other[0] : other[1]]
                some = np.flatnonzero(count)
                ids.append(ident[own[0] : own[1]][some]), links.append(count[some])
            left.append(a[lo]), right.append(b[lo])
    if ids:
        i, n = np.concatenate(ids), np.concatenate(links)
        k = len(left)
        column = lambda x, before, after: pa.array([None] * before + list(x) + [None] * after, pa.int64())
        yield pa.record_batch([column(i, 0, k), column(n, 0, k), column(left, len(i), 0), column(right, len(i), 0)], names=["id", "links", "a", "b"])


def _stack(column) -> np.ndarray:
    (_, unit), = list(_units(column))
    return unit


def deduplicate(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One vector of each component stays, with its own columns."""
    key = unused(vectors, "__qw_id")
    gone = Scratch(vectors.sparkSession, "lattice-stage").table("gone", annotate(vectors, id_col, vector_col, label_col).where("NOT kept").select(F.col(id_col).alias(key)).distinct())
    return vectors.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(key), "left_anti")
