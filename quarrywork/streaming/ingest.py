"""Streaming ingest: JSON files in, normalised and deduplicated records out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X, urls as U


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file stream with event time, URL key, title and content hash."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.withColumns({
        "event_time": F.try_to_timestamp(F.col("extraction_timestamp")), "url_key": F.md5(U.normalize("link")),
        "title_key": X.normalize("title"), "content_key": F.md5(X.normalize("text_extracted")),
    })


def distinct_urls(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Keep-first by URL within the watermark: state is bounded by it."""
    return rows.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["url_key"])


def append_to(rows: DataFrame, path: str, checkpoint: str):
    """Writes all that is available as JSON, exactly once, and returns the query."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def domain_counts(rows: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Incremental counters by domain and day."""
    return rows.withWatermark("event_time", delay).groupBy(F.window("event_time", window), "source_domain").agg(F.count(F.lit(1)).alias("n"))
