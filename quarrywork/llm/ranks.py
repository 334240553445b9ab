"""Ranks within keys that may hold most rows, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import Scratch, unused


def rank_within(tables: Scratch, label: str, rows: DataFrame, key: str, order: Sequence[str], out: str = "rank") -> DataFrame:
    """Adds ``out``: 0, 1, ... within each value of ``key``, in one fixed order.

    A digest of ``order`` deals each key over 4096 * 4096 slices; counts of slices are aggregated
    map-side, and every window sees at most 4096 nodes or the rows of one slice.  ``rows`` must read
    a written table.  Rows that are equal in ``order`` may swap ranks.
    """
    a, b, n, s1, s2, start, at = (unused(rows, f"__{x}") for x in ("a", "b", "n", "s1", "s2", "start", "in"))
    digest = F.xxhash64(*[F.col(c) for c in order])
    dealt = rows.withColumn(a, F.shiftrightunsigned(digest, 52)).withColumn(b, F.shiftrightunsigned(digest, 40).bitwiseAND(4095))
    counts = tables.table(f"{label}-counts", dealt.groupBy(key, a, b).agg(F.count(F.lit(1)).alias(n)))
    upto = lambda by, along: F.coalesce(F.sum(n).over(W.partitionBy(*by).orderBy(along).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    low = counts.withColumn(s2, upto([key, a], b))
    top = counts.groupBy(key, a).agg(F.sum(n).alias(n)).withColumn(s1, upto([key], a))
    starts = low.join(top.select(key, a, s1), [key, a]).select(key, a, b, (F.col(s1) + F.col(s2)).alias(start))
    inside = F.row_number().over(W.partitionBy(key, a, b).orderBy(*order)) - 1
    ranked = dealt.withColumn(at, inside).join(starts, [key, a, b])
    return ranked.withColumn(out, F.col(start) + F.col(at)).drop(a, b, at, start)
