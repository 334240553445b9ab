"""Intermediate tables in the folder that the whole cluster shares.

``session.shared_dir`` names the folder.  Tables are plain Parquet, so a lost executor costs a re-read and
never a recomputation.  Results read some of these tables lazily, so what an operator has not dropped
itself goes when the driver ends.
"""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession

from ..session import new_path


def unused(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``rows`` has it in any case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_LEFT: set[str] = set()
_HOOKED: set[str] = set()


def _drop_left(spark: SparkSession) -> None:
    """Drops what is left when the driver ends, where its session still runs."""
    try:
        for path in list(_LEFT):
            drop_path(spark, path)
    except Exception:  # the session has been stopped before
        pass


def passing_path(spark: SparkSession, name: str) -> str:
    """A new path whose contents go when the driver ends."""
    if spark.sparkContext.applicationId not in _HOOKED:
        _HOOKED.add(spark.sparkContext.applicationId)
        atexit.register(_drop_left, spark)
    path = new_path(spark, name)
    _LEFT.add(path)
    return path


class Scratch:
    """Writes tables for one operator run and drops those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self._paths = spark, name, {}

    def table(self, label: str, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads it (lineage ends here)."""
        path = passing_path(self.spark, f"{self.name}-{label}")
        df.write.parquet(path)
        self._paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, label: str) -> str:
        return self._paths[label]

    def drop(self, *labels: str) -> None:
        for label in labels:
            path = self._paths.pop(label, None)
            if path:
                drop_path(self.spark, path)
                _LEFT.discard(path)
