"""Versions of a table under several writers, and a result cache kept in them.

A version's rows lie in a folder of their own; a log of small files ``_log/<number>.json`` says which
versions there are.  A log file is made only where its number is free (a hard link on a local file system,
a rename that does not replace on others, as in HDFS; an object store needs one that has such a rename).  Who
finds it taken reads the log again and tries the next number, so no writer's version is lost.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..schemas import VERSION

#: Log files that stay behind the newest.
LOGS_KEPT = 100


class Conflict(RuntimeError):
    """Other writers were faster, again and again."""


class Log:
    """Numbered JSON files, each made once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def newest(self) -> tuple[int, dict]:
        """Number and content of the newest file; 0 and nothing, where there is none."""
        while True:
            names = self._names()
            if not names:
                return 0, {}
            fs, p = self.fs(f"{self.folder}/{names[-1]}")
            try:
                stream = fs.open(p)
            except Exception:
                if fs.exists(p):
                    raise
                continue  # removed since it was listed, so there is a newer one
            try:
                return int(names[-1].split(".")[0]), json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()

    def _names(self) -> list[str]:
        fs, p = self.fs(self.folder)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if n.endswith(".json") and n[0] != ".")

    def add(self, number: int, content: dict) -> bool:
        """Makes the file of a number; False where it is there already."""
        fs, folder = self.fs(self.folder)
        fs.mkdirs(folder)
        _, target = self.fs(f"{self.folder}/{number:012d}.json")
        _, draft = self.fs(f"{self.folder}/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                files, path = self.jvm.java.nio.file.Files, lambda p: self.jvm.java.nio.file.Path.of(p.toUri())
                files.createLink(path(fs.makeQualified(target)), path(fs.makeQualified(draft)))
                return True
            return bool(fs.rename(draft, target))
        except Exception:
            if fs.exists(target):
                return False
            raise
        finally:
            if fs.exists(draft):
                fs.delete(draft, False)

    def prune(self) -> None:
        for name in self._names()[:-LOGS_KEPT]:
            fs, p = self.fs(f"{self.folder}/{name}")
            fs.delete(p, False)


class Versions:
    """Versions of a table, of which one is current.

    Readers stay on the rows that they have opened: a version that falls out of the newest ``most`` is only
    retired, and its folder goes ``grace`` seconds later, with the next write or ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str, grace: float = 3600, tries: int = 50):
        self.spark, self.root, self.grace, self.tries = spark, root.rstrip("/"), grace, tries
        self.log = Log(spark, f"{self.root}/_log")

    def manifest(self) -> DataFrame:
        """version, path, created, current of the versions that are kept."""
        rows = [tuple(r) for r in self.log.newest()[1].get("versions", [])]
        return self.spark.createDataFrame(rows, VERSION)

    def _commit(self, change) -> dict:
        """Adds a log file with what ``change`` makes of the newest one; again, as long as others are faster."""
        for _ in range(self.tries):
            number, old = self.log.newest()
            new = change({"last": 0, "versions": [], "retired": [], **old})
            if self.log.add(number + 1, new):
                return new
        raise Conflict(f"{self.root}: no free number in {self.tries} tries")

    def write(self, rows: DataFrame, created: str, most: int = 3) -> int:
        """Writes a version, makes it current and keeps the newest ``most``; returns its number."""
        path = f"{self.root}/rows-{uuid.uuid4().hex}"
        rows.write.parquet(path)

        def add(log: dict) -> dict:
            version = log["last"] + 1
            old = sorted(log["versions"], reverse=True)
            kept = [[v, p, c, False] for v, p, c, _ in old[: most - 1]]
            gone = [[p, time.time()] for _, p, _, _ in old[most - 1 :]]
            return {**log, "last": version, "versions": [[version, path, created, True], *kept], "retired": log["retired"] + gone}

        version = self._commit(add)["last"]
        self.vacuum(self.grace)
        return version

    def rollback(self, version: int) -> None:
        """Makes an older version current; one that is not kept is an error."""

        def point(log: dict) -> dict:
            if version not in {r[0] for r in log["versions"]}:
                raise ValueError(f"no version {version}")
            return {**log, "versions": [[v, p, c, v == version] for v, p, c, _ in log["versions"]]}

        self._commit(point)

    def vacuum(self, grace: float) -> None:
        """Removes the folders of versions that were retired over ``grace`` seconds ago."""
        due = {p for p, at in self.log.newest()[1].get("retired", []) if time.time() - at >= grace}
        if due:
            self._commit(lambda log: {**log, "retired": [r for r in log["retired"] if r[0] not in due]})
            for path in due:
                fs, p = self.log.fs(path)
                fs.delete(p, True)
        self.log.prune()

    def current(self) -> DataFrame:
        """The rows of the current version, which stay while it is kept and ``grace`` longer."""
        return self.at(next(r[0] for r in self.log.newest()[1].get("versions", []) if r[3]))

    def at(self, version: int) -> DataFrame:
        path = {r[0]: r[1] for r in self.log.newest()[1].get("versions", [])}.get(version)
        if path is None:
            raise ValueError(f"no version {version}")
        return self.spark.read.parquet(path)


def cache_key(query: Column, most: Column, focus: Column) -> Column:
    """The key under which results of a search are kept."""
    return F.md5(F.concat_ws(":", F.coalesce(query, F.lit("")), F.coalesce(most.cast("string"), F.lit("")), F.coalesce(focus, F.lit(""))))


class ResultCache:
    """Results by key, for ``ttl`` seconds, at most ``most`` keys (the last ones set).

    A base table and folders of later entries; the last entry of a key counts.  ``compact`` merges them
    into a new base, as a version, and leaves out what is too old or too much.  Times are given (whole
    seconds), so runs can be repeated; a null key is never found.
    """

    def __init__(self, spark: SparkSession, root: str, ttl: int, most: int | None = None):
        self.spark, self.ttl, self.most = spark, ttl, most
        self.base = Versions(spark, root)

    def set(self, rows: DataFrame, at: Column) -> None:
        """Keeps results (key, result), set at a time, as one delta."""
        path = f"{self.base.root}/delta-{uuid.uuid4().hex}"
        rows.where("key IS NOT NULL").select("key", "result", at.cast("long").alias("at")).write.parquet(path)
        self.base._commit(lambda log: {**log, "deltas": [*log.get("deltas", []), path]})

    def _entries(self, log: dict) -> DataFrame | None:
        """The last entry of each key."""
        paths = [r[1] for r in log.get("versions", []) if r[3]] + log.get("deltas", [])
        if not paths:
            return None
        parts = [self.spark.read.parquet(p).select("key", "result", "at", F.lit(k).alias("nr")) for k, p in enumerate(paths)]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        last = F.max_by(F.struct("result", "at"), F.struct("at", "nr"))
        return rows.groupBy("key").agg(last.alias("e")).select("key", "e.*")

    def _live(self, log: dict, now: int) -> DataFrame | None:
        """Entries that are not too old, and among the newest: the time from which they count is looked up first,
        then ties at that time are told apart by key."""
        rows = self._entries(log)
        if rows is None:
            return None
        if self.most is not None:
            times = rows.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
            before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            room = times.select("at", F.least(F.col("n"), F.lit(self.most) - before).alias("room")).where("room > 0")
            nth = F.row_number().over(W.partitionBy("at").orderBy("key"))
            rows = rows.join(room, "at").withColumn("nth", nth).where("nth <= room").drop("nth", "room")
        return rows.where(F.lit(now) - F.col("at") < self.ttl)

    def get(self, keys: DataFrame, now: int) -> DataFrame:
        """The rows of ``keys`` (key, more) with hit and result (null without a hit)."""
        live = self._live(self.base.log.newest()[1], now)
        if live is None:
            return keys.withColumn("hit", F.lit(False)).withColumn("result", F.lit(None).cast("string"))
        found = live.select("key", "result", F.lit(True).alias("hit"))
        return keys.join(found, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def compact(self, now: int) -> int:
        """Merges base and deltas of this moment; later deltas stay.  Returns the entries that are left."""
        log = self.base.log.newest()[1]
        live, merged = self._live(log, now), set(log.get("deltas", []))
        if live is None:
            return 0
        path = f"{self.base.root}/rows-{uuid.uuid4().hex}"
        live.select("key", "result", "at").write.parquet(path)

        def swap(new: dict) -> dict:
            if [r[1] for r in new["versions"] if r[3]] != [r[1] for r in log.get("versions", []) if r[3]]:
                raise Conflict(f"{self.base.root} was compacted by another writer")
            gone = [[p, time.time()] for p in [*(r[1] for r in new["versions"]), *merged]]
            return {"last": new["last"] + 1, "versions": [[new["last"] + 1, path, str(now), True]], "retired": new["retired"] + gone, "deltas": [p for p in new.get("deltas", []) if p not in merged]}

        self.base._commit(swap)
        self.base.vacuum(self.base.grace)
        return self.spark.read.parquet(path).count()
