"""Objects of a large JSON array, read by many tasks.

Whether a brace opens an object depends on all that stands before it: the depth, whether a string is open,
and whether a backslash came last.  A split of the file is a function of this state, and it has a short
form: for each of the four (string, backslash) states, the state at its end and two numbers a, b, as the
depth d becomes max(d + a, b) (a closing brace at depth 0 changes nothing).  Such functions compose to such
functions.

1. Each split computes its function.  Splits are those of Spark's text source with ``}`` as line end.
2. Functions of a file are composed in order: one row a split, and every split gets its state to begin with.
3. Each split cuts its own objects.  What begins in one split and ends in another leaves its parts, at most
   two a split, which are joined in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Splits whose states are broadcast at most (some 100 bytes each); beyond it splits meet them by a shuffle.
BROADCAST_SPLITS = 100_000
#: The four states of (string, backslash).
STATES = [(q, s) for q in (0, 1) for s in (0, 1)]


class Marks:
    """The braces and quotes of some bytes that no backslash takes away, given the backslash state before."""

    def __init__(self, raw: np.ndarray, skip: int):
        slash = raw == 92
        at = np.flatnonzero((raw == 34) | (raw == 123) | (raw == 125))
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(raw)))) if slash.any() else np.arange(len(raw))
        before = np.append(-1, last)[at]  # the last byte before that is no backslash
        run = at - 1 - before + np.where(before < 0, skip, 0)
        self.at = at[run % 2 == 0]
        self.char = raw[self.at]
        end = len(raw) - 1 - int(last[-1]) if len(raw) else 0
        self.skip = (end + (skip if not len(raw) or last[-1] < 0 else 0)) % 2
        self.quotes = np.cumsum(self.char == 34)

    def braces(self, quoted: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and steps (1, -1) of the braces outside strings, and whether a string is open at the end."""
        out = (self.char != 34) & ((self.quotes + quoted) % 2 == 0)
        return self.at[out], np.where(self.char[out] == 123, 1, -1), int((self.quotes[-1] + quoted) % 2) if len(self.quotes) else quoted


def transfer(raw: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(string, backslash, a, b) for each state to begin with."""
    marks, out = {s: Marks(raw, s) for s in (0, 1)}, []
    for q, s in STATES:
        _, step, open_ = marks[s].braces(q)
        sums = np.cumsum(step)
        a = int(sums[-1]) if len(sums) else 0
        out.append((open_, marks[s].skip, a, a - min(0, int(sums.min()) if len(sums) else 0)))
    return out


def composed(first: list[tuple], then: list[tuple]) -> list[tuple]:
    out = []
    for q, s, a, b in first:
        p, r, c, d = then[2 * q + s]
        out.append((p, r, a + c, max(b + c, d)))
    return out


IDENTITY = [(q, s, 0, 0) for q, s in STATES]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch, np.ndarray]]:
    """(file, split, first row, bytes) of the rows of a batch that lie in one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, at = batch.column("file").to_numpy(zero_copy_only=False), batch.column("at").to_numpy()
        begins = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (file[1:] != file[:-1])) + 1).tolist(), batch.num_rows]
        for i, j in zip(begins, begins[1:]):
            value = batch.column("value").slice(i, j - i).to_pylist()
            yield file[i], int(at[i]), batch.slice(i, 1), np.frombuffer(b"}".join([*value, b""]), np.uint8)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, whole, done = None, IDENTITY, []
    for file, at, _, raw in _runs(batches):
        if (file, at) != now:
            if now:
                done.append((*now, [x for f in whole for x in f]))
            now, whole = (file, at), IDENTITY
        whole = composed(whole, transfer(raw))
    if now:
        done.append((*now, [x for f in whole for x in f]))
        yield pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["file", "at", "f"])


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state before each split of a file."""
    quoted, skip, depth, out = 0, 0, 0, []
    for at, f in sorted(zip(pdf["at"], pdf["f"]), key=lambda x: x[0]):
        out.append((pdf["file"].iloc[0], at, quoted, skip, depth))
        quoted, skip, a, b = (int(x) for x in np.asarray(f).reshape(4, 4)[2 * quoted + skip])
        depth = max(depth + a, b)
    return pd.DataFrame(out, columns=["file", "at", "quoted", "skip", "depth"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, at, nr, begins, ends, object): whole objects, and parts that lack a beginning or an end."""
    now, found = None, []
    held: list[bytes] = []
    begins = True  # whether what is held begins its object
    nr = quoted = skip = depth = 0

    def left() -> list[tuple]:
        return [(*now, nr, begins, False, b"".join(held))] if now and depth and held else []

    for file, at, row, raw in _runs(batches):
        if (file, at) != now:
            found += left()
            now, nr, held, begins = (file, at), 0, [], False
            quoted, skip, depth = (row.column(c)[0].as_py() for c in ("quoted", "skip", "depth"))
        marks = Marks(raw, skip)
        place, step, quoted = marks.braces(quoted)
        skip, sums, data = marks.skip, np.cumsum(step), raw.tobytes()
        level = sums + np.maximum(depth, -np.minimum.accumulate(np.minimum(sums, 0))) if len(sums) else sums
        before = np.append(depth, level[:-1]) if len(sums) else sums
        opens, closes = place[(before == 0) & (level == 1)].tolist(), (place[(before == 1) & (level == 0)] + 1).tolist()
        if depth and closes:
            found.append((*now, nr, begins, True, b"".join([*held, data[: closes[0]]])))
            nr, held, closes = nr + 1, [], closes[1:]
        elif depth:
            held.append(data)
        for i, j in zip(opens, closes):
            found.append((*now, nr, True, True, data[i:j]))
            nr += 1
        if len(opens) > len(closes):
            held, begins = [data[opens[-1] :]], True
        depth = int(level[-1]) if len(level) else depth
        if len(found) >= 1000:
            yield _batch(found)
            found = []
    found += left()
    if found:
        yield _batch(found)


_KIND = "file string, at long, nr long, begins boolean, ends boolean, object binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "at", "nr", "begins", "ends", "object"])


def objects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, at, nr (ascending in a file), object (text): the objects of all files, each read in splits."""
    rows = spark.read.option("lineSep", "}").text(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))
    functions = rows.mapInArrow(_functions, "file string, at long, f array<long>")
    starts = functions.groupBy("file").applyInPandas(_starts, "file string, at long, quoted int, skip int, depth long")
    if rows.rdd.getNumPartitions() <= BROADCAST_SPLITS:
        met = rows.join(F.broadcast(starts), ["file", "at"])
    else:
        met = rows.withColumn("id", F.monotonically_increasing_id()).join(starts, ["file", "at"]).repartition("file", "at").sortWithinPartitions("file", "at", "id").drop("id")
    found = met.mapInArrow(_cut, _KIND)
    whole = found.where("begins AND ends").select("file", "at", "nr", "object")
    # Parts: each that begins opens an object, to which all parts up to the next belong.
    w = W.partitionBy("file").orderBy("at", "nr")
    parts = found.where("NOT (begins AND ends)").withColumn("one", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    lists = F.array_sort(F.collect_list(F.struct("at", "nr", "object")))
    joined = parts.groupBy("file", "one").agg(lists.alias("l"), F.max("ends").alias("ends")).where("ends AND one > 0")
    joined = joined.select("file", F.col("l")[0]["at"].alias("at"), F.col("l")[0]["nr"].alias("nr"), F.unhex(F.array_join(F.transform("l", lambda x: F.hex(x["object"])), "")).alias("object"))
    return whole.unionByName(joined).withColumn("object", F.make_valid_utf8(F.col("object").cast("string")))
