"""Bounded samples in the order of a digest, without a sort and without a task or driver that gathers more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def among_first(rows: DataFrame, digest: Column, most: int) -> Column:
    """A condition that holds for the rows with the smallest ``digest`` (64 bits, unsigned): for all if
    they are ``most`` at most, else for that many or up to a tenth less.

    Counts by the digest's first 12 bits say where to cut, counts by the next 12 bits refine the class
    that is cut; each is one map-side-combined aggregate of at most 4096 rows.
    """
    taken, prefix, bits = 0, 0, 52
    while True:
        cell = F.shiftrightunsigned(digest, bits)
        inside = rows if bits == 52 else rows.where(F.shiftrightunsigned(digest, bits + 12) == prefix)
        counts = {r["c"]: r["n"] for r in inside.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if bits == 52 and sum(counts.values()) <= most:
            return F.lit(True)
        prefix <<= 12
        while taken + counts.get(prefix, 0) <= most:
            taken += counts.get(prefix, 0)
            prefix += 1
        if taken >= 0.9 * most or bits < 16:
            return F.shiftrightunsigned(digest, bits) < prefix
        bits -= 12
