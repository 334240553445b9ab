"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Every step is a map-side-combined minimum and one join; edges shrink towards stars in a number of
rounds that grows with the logarithm of the graph.  Nothing but two scalars a round reaches the
driver.  A graph of up to ``FEW`` edges, a fixed bound, is solved by one task, as rounds of joins over
so few rows cost more than they compute; both ways give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


#: Edges (16 bytes each) that one task holds at most.
FEW = 20_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a whole small graph -> node, component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(tables: Scratch, label: str, edges: DataFrame) -> DataFrame:
    """``edges``: a, b (ids).  Returns node, component: the smallest id that the node reaches."""
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = tables.table(f"{label}-0", pair)
    mark, step = _mark(now), 0
    if mark[0] <= FEW:
        return now.coalesce(1).mapInArrow(_union_find, "node long, component long")
    while mark[0]:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # Large star: neighbours above a node go to the least of its surroundings.
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its neighbours below go to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        hung = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        now = tables.table(f"{label}-{step}", small)
        tables.drop(f"{label}-{step - 1}")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    hubs = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), "component").unionByName(hubs)


def by_row(tables: Scratch, rows: DataFrame, search, count: str) -> DataFrame:
    """id, n and label of each row where ids repeat: ``search`` gives each row's ``count``, component_id
    and whether it is linked at all, under a key of the row's own; components that share an id become
    one, named by its least id.  Rows that are not linked, or without id, keep their id."""
    keyed = tables.table("keyed", rows.withColumn("key", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())))
    found = tables.table("by-key", search(keyed.drop("id")).select("key", F.col(count).cast("long").alias("n"), F.col("component_id").alias("c"), "linked"))
    got = keyed.select("id", "key").join(found, "key")
    held = tables.table("held", got.where("linked").select("id", "n", "c"))
    least = held.groupBy("id").agg(F.min("c").alias("b"))
    edges = tables.table("shared", held.join(least, "id").where("c <> b").select(F.col("c").alias("a"), "b").distinct())
    merged = connected_components(tables, "shared-ids", edges)
    named = tables.table("named", held.join(merged, F.col("c") == F.col("node"), "left").select("id", "n", F.coalesce("component", "c").alias("c")))
    out = named.join(named.groupBy("c").agg(F.min("id").alias("label")), "c").select("id", "n", "label")
    alone = got.where("NOT linked").select("id", "n").unionByName(found.where("key IS NULL").select(F.col("key").alias("id"), "n"))
    return out.unionByName(alone.withColumn("label", F.col("id")))
