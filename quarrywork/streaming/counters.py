"""Running totals and a buffered sink of a stream, each with a ledger of the micro-batches that are in.

Both are used from ``foreachBatch``.  A micro-batch becomes visible with one entry of a log (see
``sources.versions``), which tells for each stream the last batch that is in; one that comes again, after a
failure or from a new checkpoint, changes nothing.  A stream's batches come one after the other and with
the same rows under the same number, as Structured Streaming has it; several streams may share a ledger.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.versions import Versions

#: Items that a sketch of frequent items tracks, and k of the sketches of quantiles (rank error near 0.013).
TRACKED, QUANTILE_K = 2048, 200
_FOLDED = ("n", "n_ok", "total", "ids", "sizes", "items")


def _named(stream: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", stream):
        raise ValueError(f"a stream's name has letters, digits, _ and -: {stream!r}")
    return stream


class Counters:
    """Totals by group that grow with a stream and can be merged.

    A micro-batch leaves one row a group: rows, successes, sum of sizes, and sketches of distinct ids
    (HyperLogLog), of sizes (quantiles) and of frequent items.  The work of a batch is that of its own
    rows; what came before is only read by ``totals`` and, after ``deltas`` batches, by a merge into one
    base.  Rows whose group is null make a group of their own.  Null sizes count as rows and are in no
    sum or quantile; null ids and items are in no sketch.
    """

    def __init__(self, spark: SparkSession, root: str, by: Sequence[str], ok: Column, size: Column, id_: Column, item: Column, deltas: int = 20):
        self.spark, self.by, self.deltas = spark, list(by), deltas
        if clash := set(self.by) & set(_FOLDED):
            raise ValueError(f"groups may not be named {sorted(clash)}")
        self.given = {"ok": ok, "size": size.cast("long"), "id": id_.cast("string"), "item": item.cast("string")}
        self.base = Versions(spark, root)

    def partial(self, rows: DataFrame) -> DataFrame:
        """One row a group."""
        g = rows.select(*self.by, *(c.alias(f"__{k}") for k, c in self.given.items()))
        return g.groupBy(*self.by).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("__ok", F.lit(False))).alias("n_ok"), F.coalesce(F.sum("__size"), F.lit(0)).alias("total"),
            F.hll_sketch_agg("__id").alias("ids"), F.kll_sketch_agg_bigint("__size", QUANTILE_K).alias("sizes"),
            F.expr(f"approx_top_k_accumulate(__item, {TRACKED}) FILTER (WHERE __item IS NOT NULL)").alias("items"),
        )

    @staticmethod
    def _merge() -> list[Column]:
        return [
            *(F.sum(c).alias(c) for c in ("n", "n_ok", "total")), F.hll_union_agg("ids").alias("ids"),
            F.kll_merge_agg_bigint("sizes", QUANTILE_K).alias("sizes"), F.expr(f"approx_top_k_combine(items, {TRACKED})").alias("items"),
        ]

    def add(self, rows: DataFrame, batch: int, stream: str = "main") -> bool:
        """Counts a micro-batch in; False where it is in already."""
        stream = _named(stream)
        if batch <= self.base.log.newest()[1].get("last_batch", {}).get(stream, -1):
            return False
        path = f"{self.base.root}/delta-{uuid.uuid4().hex}"
        self.partial(rows).write.parquet(path)

        def enter(log: dict) -> dict:
            last = log.get("last_batch", {})
            if batch <= last.get(stream, -1):  # another attempt at the same batch was faster
                return {**log, "retired": [*log["retired"], [path, time.time()]]}
            return {**log, "last_batch": {**last, stream: batch}, "deltas": [*log.get("deltas", []), path]}

        log = self.base._commit(enter)
        if len(log["deltas"]) >= self.deltas:
            self.compact()
        return path in log["deltas"]

    def _folders(self, log: dict) -> list[str]:
        return [*log.get("merged", []), *log.get("deltas", [])]

    def compact(self) -> bool:
        """Merges base and deltas of this moment into a new base; False where another merge was faster."""
        old = self.base.log.newest()[1]
        gone = self._folders(old)
        if len(gone) < 2:
            return False
        path = f"{self.base.root}/rows-{uuid.uuid4().hex}"
        self.spark.read.parquet(*gone).groupBy(*self.by).agg(*self._merge()).write.parquet(path)

        def swap(log: dict) -> dict:
            if not set(gone) <= set(self._folders(log)):
                return {**log, "retired": [*log["retired"], [path, time.time()]]}
            retired = [[p, time.time()] for p in gone]
            return {**log, "merged": [path], "deltas": [p for p in log.get("deltas", []) if p not in gone], "retired": [*log["retired"], *retired]}

        done = path in self.base._commit(swap)["merged"]
        self.base.vacuum(self.base.grace)
        return done

    def totals(self, by: Sequence[str] | None = None, quantiles: Sequence[float] = (0.5,), top: int = 5) -> DataFrame:
        """n, n_ok, success_rate (percent; 0 without rows), total, n_ids (estimate), quantiles (an array,
        null without sizes) and top_items (item, count) by some of the groups; by none of them: one row.

        Nothing counted yet gives no rows by group, and one row of zeros, null and no items by none.
        """
        by = self.by if by is None else list(by)
        folders = self._folders(self.base.log.newest()[1])
        if folders:
            rows = self.spark.read.parquet(*folders)
        else:
            named = self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in self.by) + (", " if self.by else "") + "__ok boolean, __size long, __id string, __item string")
            empty = Counters(self.spark, self.base.root, self.by, F.col("__ok"), F.col("__size"), F.col("__id"), F.col("__item"))
            rows = empty.partial(named)
        # By none: by a constant, as frequent items cannot be merged where a task has no row.
        g = rows.groupBy(*by or [F.lit(0).alias("__all")]).agg(*self._merge())
        out = g.select(
            *by or ["__all"], "n", "n_ok", (F.col("n_ok") * 100 / F.greatest("n", F.lit(1))).alias("success_rate"), "total", F.hll_sketch_estimate("ids").alias("n_ids"),
            F.when(F.kll_sketch_get_n_bigint("sizes") > 0, F.kll_sketch_get_quantile_bigint("sizes", F.array(*map(F.lit, quantiles)))).alias("quantiles"),
            F.expr(f"approx_top_k_estimate(items, {top})").alias("top_items"),
        )
        if by:
            return out
        one = self.spark.range(1).select(F.lit(0).alias("__all"))
        return one.join(out, "__all", "left").drop("__all").fillna(0, ["n", "n_ok", "success_rate", "total", "n_ids"])


class BufferedSink:
    """Appends micro-batches to JSON lines in flushes of at least ``size`` rows.

    A batch is first written to a buffer of its own; when the buffered rows reach ``size``, or by
    ``flush`` or at the end of a ``with`` block, they are written together, so a stream of small batches leaves
    few files.  Buffered rows outlive the process: whoever opens the sink again goes on with them.  A flush lies
    in a folder by its stream and number; only those numbers that the ledger names are read.
    """

    def __init__(self, spark: SparkSession, root: str, size: int = 1, stream: str = "main"):
        self.spark, self.size, self.stream = spark, size, _named(stream)
        self.base = Versions(spark, root)

    def __enter__(self) -> BufferedSink:
        return self

    def __exit__(self, *error) -> None:
        self.flush()

    def _own(self, log: dict) -> dict:
        return {"last": -1, "buffer": [], "flushes": 0, "rows": 0, **log.get("sinks", {}).get(self.stream, {})}

    def _enter(self, change) -> dict:
        def whole(log: dict) -> dict:
            own, gone = change(self._own(log))
            return {**log, "sinks": {**log.get("sinks", {}), self.stream: own}, "retired": [*log["retired"], *([p, time.time()] for p in gone)]}

        return self._own(self.base._commit(whole))

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Buffers a micro-batch, and flushes where the buffer is full; False where it is in already."""
        if batch <= self._own(self.base.log.newest()[1])["last"]:
            return False
        path = f"{self.base.root}/buffer-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        n = self.spark.read.parquet(path).count()

        def enter(own: dict) -> tuple[dict, list[str]]:
            if batch <= own["last"]:
                return own, [path]
            return {**own, "last": batch, "buffer": [*own["buffer"], [path, n]] if n else own["buffer"]}, [] if n else [path]

        own = self._enter(enter)
        if sum(k for _, k in own["buffer"]) >= self.size:
            self.flush()
        return True

    def flush(self) -> int:
        """Writes what is buffered; returns how many rows that were."""
        own = self._own(self.base.log.newest()[1])
        if not own["buffer"]:
            return 0
        number, paths = own["flushes"] + 1, [p for p, _ in own["buffer"]]
        n = sum(k for _, k in own["buffer"])
        # Written again under the same number, where an earlier attempt got no further than this.
        self.spark.read.option("mergeSchema", True).parquet(*paths).write.mode("overwrite").json(f"{self.base.root}/flushed/{self.stream}/{number}")

        def enter(now: dict) -> tuple[dict, list[str]]:
            if now["flushes"] != own["flushes"]:
                raise RuntimeError(f"two writers of stream {self.stream}")
            return {**now, "flushes": number, "rows": now["rows"] + n, "buffer": [b for b in now["buffer"] if b[0] not in paths]}, paths

        self._enter(enter)
        self.base.vacuum(self.base.grace)
        return n

    def _flushed(self) -> list[str]:
        sinks = self.base.log.newest()[1].get("sinks", {})
        return [f"{self.base.root}/flushed/{s}/{k}" for s, own in sorted(sinks.items()) for k in range(1, own["flushes"] + 1)]

    def rows(self, schema) -> DataFrame:
        """What all streams have flushed."""
        paths = self._flushed()
        return self.spark.read.schema(schema).json(paths) if paths else self.spark.createDataFrame([], schema)

    def stats(self) -> dict[str, int]:
        """Entries written and buffered, flushes and bytes, over all streams."""
        sinks = self.base.log.newest()[1].get("sinks", {}).values()
        size = 0
        for path in self._flushed():
            fs, p = self.base.log.fs(path)
            size += fs.getContentSummary(p).getLength()
        return {
            "entries_written": sum(s["rows"] for s in sinks), "entries_buffered": sum(k for s in sinks for _, k in s["buffer"]),
            "flushes": sum(s["flushes"] for s in sinks), "file_size": size,
        }
