"""Aggregates, histograms, running windows and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def corpus_stats(rows: DataFrame, id_col: str, length_col: str) -> DataFrame:
    total = F.sum(length_col).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("n_distinct"), total.alias("total_length"), F.round(total / F.count(length_col), 6).alias("mean_length"))


def _named(facet: str):
    return lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))


def facets(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All value counts in one pass: facet, value, n.  Array columns count each element."""
    kinds = dict(rows.dtypes)
    parts = []
    for c in columns:
        values = F.col(c) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
        parts.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), _named(c)))
    return rows.select(F.explode(F.concat(*parts)).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def success_summary(rows: DataFrame, success: Column, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(success).alias("n_success"), F.count_if(~success).alias("n_failure"),
        F.round(F.coalesce(F.sum(F.when(success, F.col(value)).cast("decimal(38,10)")).cast("double"), F.lit(0.0)), 4).alias("value_success"),
    )


def last_n_mean(rows: DataFrame, key: str, order: Sequence[str], value: str, n: int = 10) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)
    return rows.withColumn("last_mean", F.round(F.sum(F.col(value).cast("decimal(20,10)")).over(w).cast("double") / F.count(value).over(w), 6))


def running_rate(rows: DataFrame, key: str, order: Sequence[str], success: Column) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rate = F.sum(success.cast("int")).over(w) / F.count(F.lit(1)).over(w)
    delay = F.when(F.col("rate") > 0.8, 0.1).when(F.col("rate") > 0.5, 0.2).otherwise(0.4)
    return rows.withColumn("rate", F.round(rate, 6)).withColumn("delay", delay)


def adaptive_delay(rows: DataFrame, key: str, order: Sequence[str], success: Column, every: int = 10, usual: float = 0.1) -> DataFrame:
    """The running rate, and the delay that follows from it at every ``every``-th row; ``usual`` at others."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(*order))
    out = running_rate(rows.withColumn("nth", nth), key, order, success)
    return out.withColumn("delay", F.when(F.col("nth") % every == 0, F.col("delay")).otherwise(usual))


def top_by_last_mean(rows: DataFrame, key: str, order: Sequence[str], value: str, most: int = 5, n: int = 10) -> DataFrame:
    """The ``most`` keys with the highest mean of their last ``n`` values; ties by key."""
    last = last_rows(rows, key, [F.desc(c) for c in order], n)
    mean = F.round(F.sum(F.col(value).cast("decimal(38,10)")).cast("double") / F.count(value), 6)
    return last.groupBy(key).agg(mean.alias("last_mean")).orderBy(F.desc("last_mean"), key).limit(most)


def levels(rows: DataFrame, success: Column, value: str, outer: str, inner: str) -> DataFrame:
    """Counts and sums for each pair, for each ``outer`` and for all, in one pass (grouping sets)."""
    grouped = rows.withColumn("__ok", success).rollup(outer, inner).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("__ok").alias("n_success"),
        F.round(F.coalesce(F.sum(F.col(value).cast("decimal(38,10)")).cast("double"), F.lit(0.0)), 4).alias("total"),
    )
    return grouped.withColumn("level", F.when(F.col("level") == 0, 0).when(F.col("level") == 1, 1).otherwise(2))


def analysed(records: DataFrame, facets_of: Sequence[str], score: str, most: int = 10) -> DataFrame:
    """facet, value, n, mean: the ``most`` commonest values of each facet (ties by value), and the mean
    score under facet "all"."""
    counts = facets(records, facets_of)
    best = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))
    top = counts.withColumn("__r", best).where(F.col("__r") <= most).select("facet", "value", "n", F.lit(None).cast("double").alias("mean"))
    mean = F.round(F.sum(F.col(score).cast("decimal(38,10)")).cast("double") / F.count(score), 6)
    return top.unionByName(records.agg(F.lit("all").alias("facet"), F.lit(None).cast("string").alias("value"), F.count(F.lit(1)).alias("n"), mean.alias("mean")))


def last_rows(rows: DataFrame, key: str, order: Sequence[Column], n: int = 50) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def top_n(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """A report of n rows: each task keeps its own n."""
    return rows.orderBy(*order).limit(n)


def key_terms(rows: DataFrame, id_col: str, text_col: str, pattern: str, n: int = 20) -> DataFrame:
    """The n commonest matches in each text, ties by first place."""
    found = rows.select(id_col, F.posexplode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(pattern), F.lit(0))).alias("pos", "term"))
    counts = found.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    w = W.partitionBy(id_col).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(id_col, "rank", "term", "n")


def fresh(rows: DataFrame, cached_at: str, run_ts: Column, ttl_seconds: int) -> DataFrame:
    """Cache rows that are still valid at ``run_ts``."""
    return rows.where(F.unix_timestamp(run_ts) - F.unix_timestamp(cached_at) < ttl_seconds)


def token_bucket(rows: DataFrame, key: str, order: str, seconds: str, rate: float, capacity: float) -> DataFrame:
    """Delay of each request of a key in order: a full bucket of ``capacity`` refilled at ``rate``.

    A key's requests are read in order as a stream, so a task holds a batch and one bucket.
    """

    def run(batches):
        now, left, last = object(), capacity, None
        for pdf in batches:
            delays = []
            for name, t in zip(pdf["__g"], pdf[seconds]):
                left = min(capacity, left + (t - last) * rate) if name == now else capacity
                now, last = name, t
                delays.append(0.0 if left >= 1 else (1 - left) / rate)
                left -= left >= 1
            yield pdf.assign(delay=delays).drop(columns="__g")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    named = rows.withColumn("__g", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    return named.repartition("__g").sortWithinPartitions("__g", order).mapInPandas(run, f"{kinds}, delay double")
