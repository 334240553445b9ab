"""Removal of byte strings that repeat in a corpus, by suffix sorting.

Every byte goes that a ``length``-byte string covers which also starts anywhere else, in the same text or
another.  Suffixes are dealt by content, so that equal strings meet: the string at a start belongs to its
anchor, the ``GRAM`` bytes with the least hash in it (the first of them, where several are equal).  Equal
strings have equal anchors at equal offsets.  Starts with one anchor are a run; a run and its bytes are a
piece.

1. Texts are written in buckets by a row number, so that later joins with them move only the other side.
2. Anchors are counted; those met once are done with, as no string of theirs repeats.
3. Equal pieces become one with their number (128-bit digests), so copies are sorted once.
4. Pieces are dealt by anchor; anchors with over ``PIECES`` pieces are split by the pieces' digests.  A
   task takes some ``BLOCK`` bytes of pieces at a time and sorts all their suffixes (``deep_shallow``).
   Neighbours that agree in ``length`` bytes are a class, and classes of two starts or more repeat.  What a
   block of a split anchor holds once meets the classes of the other blocks by a 128-bit digest.
5. Of a piece, its first and last repeated start suffice: a run is shorter than ``length``, so their strings
   cover all between.  They are joined with the pieces' places and merged text by text.

A task holds one block, or some 512 KB of text (longer texts are cut in overlapping stretches) and one
text.  Texts below ``length`` bytes keep everything.

Defined cases: null and empty texts have no bytes and the digest of nothing; repeated rows, also those that
share an id or have none, are texts of their own, so each copy of a text of ``length`` bytes or more loses
all; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .deep_shallow import Block
from .scratch import Scratch, drop_path, passing_path
from .worker import lean
from .wordhash import SLICE, _powers, mix

LENGTH, GRAM = 400, 48
#: Pieces of an anchor that meet in one block, and bytes of pieces that a block takes.
PIECES, BLOCK = 2048, 4 << 20
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)
_VALUES = np.random.default_rng(412).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Digests:
    """64-bit digests of any stretches of bytes, from prefix sums (``kind`` 0 or 1 names one of two)."""

    def __init__(self, raw: np.ndarray, kind: int):
        self.inverse = _powers(pow(_BASES[kind], -1, 1 << 64), len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[kind][raw] * _powers(_BASES[kind], len(raw)), out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start])


def stretches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets, place of each stretch in its text): whole texts together, long texts in
    stretches of some ``SLICE`` bytes that overlap in ``LENGTH`` - 1."""
    _, where, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        lo, hi = int(offsets[a]), int(offsets[b])
        if b > a + 1 or hi - lo <= SLICE:
            yield np.arange(a, b), raw[lo:hi], offsets[a : b + 1] - lo, np.zeros(b - a, np.int64)
        else:
            for at in range(lo, hi, SLICE):
                own = raw[at : min(hi, at + SLICE + LENGTH - 1)]
                yield np.array([a]), own, np.array([0, len(own)]), np.array([at - lo])
        a = b


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text, anchor, first start, last start (bytes from the beginning of
    ``raw``), the anchor's digest and two digests of the piece."""
    last = np.repeat(offsets[1:] - length, np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(raw)) <= last)
    if not len(starts):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 3
    one, two = Digests(raw, 0), Digests(raw, 1)
    n, wide = len(raw) - gram + 1, length - gram + 1
    hashes = one.of(np.arange(n), gram)
    # The least hash of 40 bits, then the first place; the minimum of each window by prefixes and suffixes of blocks.
    place = np.uint64((1 << 24) - 1)
    ranked = np.full(-(-n // wide) * wide, ~np.uint64(0))
    ranked[:n] = (hashes & ~place) | np.arange(n, dtype=np.uint64)
    ranked = ranked.reshape(-1, wide)
    ahead = np.minimum.accumulate(ranked, axis=1).ravel()
    behind = np.minimum.accumulate(ranked[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[starts], ahead[starts + wide - 1]) & place).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
    lo, hi, at = starts[new], starts[np.append(new[1:], len(starts)) - 1], anchor[new]
    text = np.searchsorted(offsets, lo, side="right") - 1
    shape = ((at - lo) << 20 | (hi - lo)).astype(np.uint64)
    size = hi - lo + length
    return text, at, lo, hi, hashes[at], mix(one.of(lo, size) ^ shape), mix(two.of(lo, size) + shape)


_ANCHOR = "row long, at int, lo int, hi int, g long, p1 long, p2 long"


def _found_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, raw, offsets, shift in stretches(batch.column(1)):
                text, at, lo, hi, *digests = anchors(raw, offsets, length, gram)
                base = shift[text] - offsets[text]
                numbers = [pa.array((x + base).astype(np.int32)) for x in (at, lo, hi)]
                yield pa.record_batch([pa.array(ids[rows[text]]), *numbers, *(pa.array(d.view(np.int64)) for d in digests)], names=["row", "at", "lo", "hi", "g", "p1", "p2"])

    return texts.select("row", "bytes").where(F.length("bytes") >= length).mapInArrow(find, _ANCHOR)


_PIECE = "g long, p1 long, p2 long, n long, split int, off int, piece binary"


def _cut_pieces(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each piece, from the one text that stands for it."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("g", "p1", "p2", "n", "split", "at", "lo", "hi")).alias("pieces"))
    met = texts.select("row", "bytes").join(lists, "row").select("bytes", "pieces")

    @lean
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(0)[k].as_buffer().to_pybytes()
                own = pa.RecordBatch.from_struct_array(batch.column(1)[k].values)
                lo, hi, at = (own.column(c).to_pylist() for c in ("lo", "hi", "at"))
                pieces = pa.array([raw[i : j + length] for i, j in zip(lo, hi)], pa.binary())
                off = pa.array([a - i for a, i in zip(at, lo)], pa.int32())
                yield pa.record_batch([*(own.column(c) for c in ("g", "p1", "p2", "n", "split")), off, pieces], names=["g", "p1", "p2", "n", "split", "off", "piece"])

    return met.mapInArrow(take, _PIECE)


_CLASS = "g long, p1 long, p2 long, low int, high int, d1 long, d2 long, n long"


def _sorted_blocks(pieces: DataFrame, length: int, block: int) -> DataFrame:
    """Rows with ``low`` and ``high``: the first and last start of a piece, from its anchor, that repeat in its
    block.  Rows with ``n``: classes in blocks of split anchors, with the one start (``low``) of those met once."""

    def judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(b"".join(rows.column("piece").to_pylist()), np.uint8)
        size = pc.binary_length(rows.column("piece")).to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        g, p1, p2, n, split, off = (rows.column(c).to_numpy() for c in ("g", "p1", "p2", "n", "split", "off"))
        count = size - length + 1
        piece = np.repeat(np.arange(len(size)), count)
        starts = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + first[piece]
        sorted_ = Block(raw, starts, length)
        where, begins = np.unique(sorted_.first, return_inverse=True)
        weight = np.bincount(begins, n[piece[sorted_.order]]).astype(np.int64)
        again = np.empty(len(starts), bool)
        again[sorted_.order] = weight[begins] > 1
        rel = starts - first[piece] - off[piece]
        names = ["g", "p1", "p2", "low", "high", "d1", "d2", "n"]
        hit = np.flatnonzero(again)
        if len(hit):
            own, at = np.unique(piece[hit], return_index=True)
            upto = np.append(at[1:], len(hit)) - 1
            none = pa.nulls(len(own), pa.int64())
            yield pa.record_batch([pa.array(x[own]) for x in (g, p1, p2)] + [pa.array(rel[hit[x]].astype(np.int32)) for x in (at, upto)] + [none] * 3, names=names)
        lead = sorted_.order[where]
        keep = np.flatnonzero(split[piece[lead]] > 1)
        if len(keep):
            lead, weight = lead[keep], weight[keep]
            d = [pa.array(Digests(raw, k).of(starts[lead], length).view(np.int64)) for k in (0, 1)]
            low = pa.array(rel[lead].astype(np.int32), mask=weight > 1)
            yield pa.record_batch([pa.array(x[piece[lead]]) for x in (g, p1, p2)] + [low, low, *d, pa.array(weight)], names=names)

    @lean
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while held and sum(x.nbytes for x in held) > block:
                rows = pa.Table.from_batches(held).combine_chunks()
                g, salt = rows.column("g").to_numpy(), rows.column("salt").to_numpy()
                ends = np.flatnonzero((g[1:] != g[:-1]) | (salt[1:] != salt[:-1])) + 1  # only whole groups
                size = np.cumsum(pc.binary_length(rows.column("piece")).to_numpy())
                ends = ends[: max(1, int(np.searchsorted(size[ends - 1], block, side="right")))] if len(ends) else ends
                if not len(ends):
                    break
                yield from judged(rows.slice(0, int(ends[-1])))
                held = rows.slice(int(ends[-1])).to_batches()
        if held:
            yield from judged(pa.Table.from_batches(held))

    dealt = pieces.withColumn("salt", F.pmod(F.col("p1"), F.col("split")).cast("int"))
    dealt = dealt.repartition("g", "salt").sortWithinPartitions("g", "salt")
    return dealt.mapInArrow(sort, _CLASS)


def _removed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Each text with its numbers, by the stretches that go."""
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    met = texts.join(lists, "row", "left").select("doc_id", "bytes", "spans")

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_buffer().to_pybytes() if batch.column(1)[k].is_valid else b""
                own = batch.column(2)[k]
                runs, digest, at = [], hashlib.sha256(), 0
                if own.is_valid:
                    lo, hi = (own.values.field(c).to_numpy() for c in ("lo", "hi"))
                    order = np.argsort(lo, kind="stable")
                    lo, reach = lo[order], np.maximum.accumulate(hi[order])
                    new = np.append(True, lo[1:] > reach[:-1])
                    runs = list(zip(lo[new].tolist(), reach[np.append(np.flatnonzero(new)[1:], len(lo)) - 1].tolist()))
                for a, b in runs:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), [x for r in runs for x in r]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return met.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, pieces: int = PIECES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (first byte and end of each maximal removed
    run, one behind the other) of every row."""
    spark = docs.sparkSession
    tables = Scratch(spark, "suffixes")
    name, path = f"quarrywork_texts_{uuid.uuid4().hex}", passing_path(spark, "suffixes-texts")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = given.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row")
    dealt.write.bucketBy(buckets, "row").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    try:
        texts = spark.table(name)
        found = tables.table("anchors", _found_anchors(texts, length, gram))
        often = tables.table("often", found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"))
        places = tables.table("places", found.join(often, "g"))
        tables.drop("anchors", "often")
        stands = F.min(F.struct("row", "at", "lo", "hi"))
        distinct = tables.table("distinct", places.groupBy("g", "p1", "p2").agg(F.count(F.lit(1)).alias("n"), stands.alias("s")).select("g", "p1", "p2", "n", "s.*"))
        split = distinct.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / pieces).cast("int").alias("split"))
        split = tables.table("split", split)
        cut = tables.table("pieces", _cut_pieces(texts, distinct.join(split, "g"), length))
        tables.drop("distinct", "split")
        classes = tables.table("classes", _sorted_blocks(cut, length, block))
        tables.drop("pieces")
        sure = classes.where("n IS NULL").select("g", "p1", "p2", "low", "high")
        across = classes.where("n IS NOT NULL")
        twice = tables.table("twice", across.groupBy("d1", "d2").agg(F.sum("n").alias("n")).where("n > 1").select("d1", "d2"))
        late = across.where("low IS NOT NULL").join(twice, ["d1", "d2"]).select("g", "p1", "p2", "low", "high")
        ends = sure.unionByName(late).groupBy("g", "p1", "p2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        ends = tables.table("ends", ends)
        spans = places.join(ends, ["g", "p1", "p2"]).select("row", (F.col("at") + F.col("low")).alias("lo"), (F.col("at") + F.col("high") + length).alias("hi"))
        out = tables.table("result", _removed(texts, spans))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(spark, path)
    tables.drop("places", "classes", "twice", "ends")
    return out
