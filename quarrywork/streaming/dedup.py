"""Streaming dedup over several keys: sharded in the state store, or global over a state table.

A record is accepted when none of its keys (URL, title, content) was marked by an accepted one before;
only accepted records mark.  Order is that of micro-batches, and of ``order`` within one.

* ``accepted`` keeps one state entry a key in the state store, grouped by a shard such as the domain; the
  same title in two shards passes twice.  A shard is judged by one task, so shards should be many.
* ``accept_into`` judges all records together: what the state table knows is anti-joined, the rest goes
  through the distributed greedy loop of ``operators.dedup``, and keys are written by micro-batch.

Null keys mark and match nothing, in either way; records without any key are accepted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import dedup as D

KEYS = ("url_key", "title_key", "content_key")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Marks(StatefulProcessor):
    """Marked keys of a shard, one entry each, forgotten after ``ttl_ms`` and, beyond ``most`` keys of a
    kind, in the order of marking.

    ``marked`` tells a key's number within its kind, ``line`` the key of a number, and ``ends`` the number
    to forget next and the next to give.  A key that is marked again after it was forgotten gets a new
    number, so an old number never takes a new mark away.
    """

    def __init__(self, keys: Sequence[str], order: str, most: int | None, ttl_ms: int | None):
        self.keys, self.order_by, self.most, self.ttl_ms = tuple(keys), order, most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}
        self.marked = handle.getMapState("marked", "kind int, key string", "nr long", **ttl)
        self.line = handle.getMapState("line", "kind int, nr long", "key string", **ttl)
        self.ends = handle.getMapState("ends", "kind int", "first long, next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order_by, kind="stable")
        known: dict[tuple[int, str], int | None] = {}  # keys met in this batch, with their numbers
        ends = {k: self.ends.getValue((k,)) if self.ends.containsKey((k,)) else (0, 0) for k in range(len(self.keys))}
        ends = {k: list(v) for k, v in ends.items()}
        flags = []
        for values in batch[list(self.keys)].itertuples(index=False):
            own = [(k, v) for k, v in enumerate(values) if isinstance(v, str)]
            for name in own:
                if name not in known:
                    known[name] = self.marked.getValue(name)[0] if self.marked.containsKey(name) else None
            flags.append(all(known[name] is None for name in own))
            if flags[-1]:
                for name in own:
                    self._mark(name, known, ends[name[0]])
        for k, v in ends.items():
            self.ends.updateValue((k,), tuple(v))
        yield pd.DataFrame({self.order_by: batch[self.order_by].to_numpy(), "accepted": flags})

    def _mark(self, name: tuple[int, str], known: dict, ends: list[int]) -> None:
        kind, nr = name[0], ends[1]
        known[name] = nr
        self.marked.updateValue(name, (nr,))
        self.line.updateValue((kind, nr), (name[1],))
        ends[1] += 1
        while self.most is not None and ends[1] - ends[0] > self.most:
            oldest, ends[0] = ends[0], ends[0] + 1
            if self.line.containsKey((kind, oldest)):  # else its time was over before
                gone = (kind, self.line.getValue((kind, oldest))[0])
                self.line.removeKey((kind, oldest))
                if known.get(gone, oldest) == oldest:
                    self.marked.removeKey(gone)
                    known[gone] = None

    def close(self) -> None:
        pass


def accepted(rows: DataFrame, shard: str = "source_domain", order: str = "link", keys: Sequence[str] = KEYS, most: int | None = None, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """(order, accepted) of a stream's records, shard by shard.

    A mark ends ``ttl_ms`` after it was made (None: never); with ``most`` the oldest marks of a kind beyond that
    many go, so that what only they told apart is accepted again.  Start it with ``start``: it needs the
    RocksDB state store, and with time-to-live Spark would ask for empty batches for ever.
    """
    out = T.StructType([rows.schema[order], T.StructField("accepted", T.BooleanType())])
    slim = rows.select(shard, order, *(F.col(k).cast("string").alias(k) for k in keys))
    mode = "ProcessingTime" if ttl_ms else "None"
    return slim.groupBy(shard).transformWithStateInPandas(Marks(keys, order, most, ttl_ms), out, "Append", mode)


def start(rows: DataFrame, path: str, checkpoint: str, form: str = "json"):
    """Writes the outcome for all that is available, exactly once, and returns the query, which ends."""
    conf = rows.sparkSession.conf
    # Changes are written after a batch, not the whole store; snapshots follow in the background.
    wanted = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:  # a query keeps the settings with which it starts
        return rows.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


_STATE = "kind int, key string, batch long, at long"


class StateTable:
    """Marked keys as a table: one folder a micro-batch, so a batch that is run again replaces its own.

    ``most`` keeps that many newest keys of a kind; what is older is forgotten between micro-batches.
    """

    def __init__(self, spark, path: str, most: int | None = None):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def before(self, batch: int | None = None) -> DataFrame:
        """kind, key, batch, at of the keys that hold before a micro-batch (None: after all)."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return self.spark.createDataFrame([], _STATE)
        rows = self.spark.read.schema(_STATE).option("basePath", self.path).parquet(self.path)
        rows = rows if batch is None else rows.where(F.col("batch") < batch)
        return rows if self.most is None else self._newest(rows)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The ``most`` last of each kind: every batch's own last ones first, so that a task ranks few."""
        last = lambda *by: W.partitionBy("kind", *by).orderBy(F.desc("batch"), F.desc("at"), "key")
        few = rows.withColumn("r", F.row_number().over(last("batch"))).where(F.col("r") <= self.most)
        return few.withColumn("r", F.row_number().over(last())).where(F.col("r") <= self.most).drop("r")

    def write(self, marks: DataFrame, batch: int) -> None:
        marks.select("kind", "key", "at").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def accept_into(rows: DataFrame, path: str, state: StateTable, checkpoint: str, order: str, keys: Sequence[str] = KEYS):
    """Judges all records of a stream together and writes those accepted under ``path``, one folder a
    micro-batch (read it with ``batch`` as a partition column); returns the query.

    ``order`` is a whole number, unique within the stream.  A micro-batch that is run again after a failure
    meets the state of the batches before it and replaces its own two folders, so nothing is lost or doubled.
    """
    kinds = F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(i).alias("kind"), F.col(k).cast("string").alias("key"))) for i, k in enumerate(keys)])

    def judge(batch: DataFrame, nr: int) -> None:
        batch = batch.persist()
        entries = batch.select(F.col(order).alias("at"), F.explode(F.array_compact(kinds)).alias("k")).select("at", "k.kind", "k.key")
        seen = entries.join(state.before(nr).select("kind", "key").distinct(), ["kind", "key"]).select(F.col("at").alias(order)).distinct()
        won = D.accepted(batch.join(seen, order, "left_anti"), list(keys), order).persist()
        won.write.mode("overwrite").parquet(f"{path}/batch={nr}")
        state.write(entries.join(won.select(F.col(order).alias("at")), "at", "left_semi"), nr)
        won.unpersist(), batch.unpersist()

    return rows.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
