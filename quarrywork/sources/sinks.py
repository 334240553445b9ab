"""Sinks and versions.  Job commits are atomic; nothing is written row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F

from ..functions import text as X, urls as U
from ..operators import dedup as D
from ..session import cut
from .versions import Versions  # noqa: F401


def append_jsonl(rows: DataFrame, path: str) -> int:
    """Appends rows as JSON lines and returns how many were written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]


def append_new(rows: DataFrame, known: DataFrame, path: str, url: str = "link", title: str = "title", content: str = "text_extracted", order: str = "ord") -> tuple[DataFrame, dict[str, int]]:
    """Appends the rows that neither the state (kind, key) nor an earlier row of their own run knows.

    A row without title or content is told by its URL alone.  Returns the state that the written rows
    leave behind and the numbers of rows written and held back.
    """
    spoken = (F.coalesce(F.trim(title), F.lit("")) != "") & (F.coalesce(F.trim(content), F.lit("")) != "")
    told = rows.withColumns({"__u": F.md5(U.normalize(url)), "__t": F.when(spoken, X.normalize(title)), "__c": F.when(spoken, F.md5(X.normalize(content)))})
    for column, kind in (("__u", "url"), ("__t", "title"), ("__c", "content")):
        told = told.join(known.where(F.col("kind") == kind).select(F.col("key").alias(column)).distinct(), column, "left_anti")
    kept = cut(D.accepted(told, ["__u", "__t", "__c"], order))
    n = append_jsonl(kept.drop("__u", "__t", "__c"), path)
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for c, kind in (("__u", "url"), ("__t", "title"), ("__c", "content"))])
    state = known.select("kind", "key").unionByName(kept.select(F.explode(keys).alias("s")).select("s.kind", "s.key").where("key IS NOT NULL")).distinct()
    return state, {"written": n, "duplicates": rows.count() - n}


def stats(spark: SparkSession, path: str) -> dict[str, int]:
    """Entries and bytes of a folder of JSON lines; both 0 where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {"entries": 0, "bytes": 0}
    return {"entries": spark.read.text(path).where(F.trim("value") != "").count(), "bytes": fs.getContentSummary(p).getLength()}


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_successes(results: DataFrame, path: str) -> None:
    """Entries of successful agents only: success, data_entries."""
    results.where("success").select(F.explode("data_entries").alias("e")).select("e.*").write.mode("overwrite").json(path)


def write_state(state: DataFrame, path: str) -> None:
    """The dedup state (kind, key) of a run, each key once; replaces what earlier runs left."""
    state.select("kind", "key").distinct().write.mode("overwrite").parquet(path)


def write_index(flat: DataFrame, path: str) -> dict[str, int]:
    """A flat index as an artefact: the rows under ``rows`` and its numbers under ``stats``, which are
    written last, so that a reader finds whole indexes only.  Returns the numbers."""
    seen = Observation()
    size = F.size("unit")
    flat.observe(seen, F.count(F.lit(1)).alias("n"), F.min(size).alias("dim"), F.max(size).alias("widest")).write.mode("overwrite").parquet(f"{path}/rows")
    got = seen.get
    if got["dim"] != got["widest"]:
        raise ValueError(f"vectors of {got['dim']} and {got['widest']} numbers in one index")
    stats = {"n": got["n"], "dim": got["dim"] or 0}
    flat.sparkSession.createDataFrame([tuple(stats.values())], "n long, dim int").coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return stats


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a finished index; an index whose rows do not agree with its numbers is an error."""
    stats = spark.read.schema("n long, dim int").json(f"{path}/stats").first()
    rows = spark.read.parquet(f"{path}/rows")
    n = rows.count()
    if stats is None or n != stats["n"]:
        raise ValueError(f"{path} has {n} rows instead of {stats and stats['n']}")
    return rows


def write_ivf(listed: DataFrame, centres, path: str) -> dict[str, int]:
    """An inverted file (``search.ivf``) as an artefact: a folder of rows for each list, the centres, and the
    numbers, which are written last.  Returns the numbers."""
    spark = listed.sparkSession
    seen = Observation()
    size = F.size("unit")
    rows = listed.observe(seen, F.count(F.lit(1)).alias("n"), F.min(size).alias("dim"), F.max(size).alias("widest"))
    rows.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    got = seen.get
    if got["dim"] != got["widest"]:
        raise ValueError(f"vectors of {got['dim']} and {got['widest']} numbers in one index")
    lines = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(lines, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    stats = {"n": got["n"], "dim": got["dim"] or 0, "lists": len(lines)}
    spark.createDataFrame([tuple(stats.values())], "n long, dim int, lists int").coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return stats


def read_ivf(spark: SparkSession, path: str):
    """(rows, centres) of a finished inverted file, for ``search.top_k_ivf``: rows by list, centres as a matrix."""
    import numpy as np

    stats = spark.read.schema("n long, dim int, lists int").json(f"{path}/stats").first()
    lines = spark.read.schema("list int, centre array<double>").parquet(f"{path}/centres").orderBy("list").collect()
    if stats is None or len(lines) != stats["lists"]:
        raise ValueError(f"{path} is not a finished index")
    if not lines:
        raise ValueError(f"{path} has no lists")
    return spark.read.parquet(f"{path}/rows"), np.array([r.centre for r in lines])


def analytics(agents: DataFrame, key: str, run: str) -> DataFrame:
    """One JSON document of a run: totals, and a list of its agents in order of ``key`` (a bounded list)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(key), *[F.col(c) for c in agents.columns if c != key])))
    total = [F.sum(c).alias(f"total_{c}") for c, kind in agents.dtypes if c != key and kind in ("int", "bigint", "double")]
    whole = agents.agg(F.count(F.lit(1)).alias("agents"), *total, parts.alias("agent_performance"))
    return whole.select(F.lit(run).alias("run"), F.to_json(F.struct("*")).alias("document"))


def as_document(rows: DataFrame, out: str = "document") -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias(out))


def retained(versions: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` versions of each name (name, version)."""
    return versions.withColumn("__r", F.row_number().over(W.partitionBy("name").orderBy(F.desc("version")))).where(F.col("__r") <= most).drop("__r")
