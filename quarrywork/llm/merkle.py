"""Merkle manifest of a dataset: leaves, block trees by DuckDB, roots and proofs by Spark.

Every row is a leaf: the sha256 of its fields, each written as its length in bytes, ``:`` and its value
(``-`` where it is null).  Within a group leaves ascend by id; every eight consecutive nodes become the
sha256 of their digests in hex, level by level until one remains, the group's root.  Roots of groups, in
the order of the groups, become the root of all in the same way.

Rows get their places by one range shuffle of ids and digests (no text moves) and a count for each
range.  Places are dealt in aligned blocks of ``BLOCK`` = 8^4 nodes, so no run of siblings crosses a
block.  An executor hands each block to DuckDB as an Arrow table: one ordered ``string_agg`` with sha256
a level gives the parents, two windowed ones give each node's siblings to its left and right.  The
blocks' roots are the nodes of the next round (three rounds reach 6.8 * 10^10 rows a group), and Spark
joins what lies above a block behind the paths inside it.  A task holds one block.

Defined cases: rows with null ids come first and rows that share an id ascend by their leaf, so repeated
rows are leaves of their own, side by side; a null group is a group, before all others; an empty table
gives no rows; a group of one row has that row's leaf as its root; further columns, whatever their names,
take no part unless they are carried.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import Scratch

FANOUT, DEPTH = 8, 4
BLOCK = FANOUT**DEPTH
#: Rows of block or group roots that are broadcast (with paths of at most some 3,000 bytes); more are joined by a shuffle.
FEW = 8192
PATH = "array<struct<l string, r string>>"


def leaf(*fields: Column) -> Column:
    """sha256 in hex over the fields: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    written = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*written), 256)


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["l"], s["r"])))


def folded(path: Column, node: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def manifest(docs: DataFrame, leaf_of: Column, group: str = "lang", order: str = "doc_id", carry: Sequence[Column] = ()) -> DataFrame:
    """``order``, ``carry``, leaf, subroot, root and path (siblings to the left and right, level by level
    from the leaf to the root) of every row."""
    tables = Scratch(docs.sparkSession, "merkle")
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    given = docs.select(key.alias("g"), F.col(order).alias("o"), leaf_of.alias("h"), F.struct(F.lit(0).alias("_"), *carry).alias("c"))
    rows = tables.table("leaves", given)
    inside = _climbed(tables, "rows", _placed(tables, "rows", rows, ["o", "h"]))
    groups = tables.table("subroots", inside.groupBy("g").agg(F.first("root").alias("h")))
    above = _placed(tables, "groups", groups.select(F.lit("").alias("g"), F.col("g").alias("o"), "h", F.struct(F.lit(0).alias("_")).alias("c")), ["o"])
    above = _climbed(tables, "groups", above).select(F.col("o").alias("g"), F.col("path").alias("over"), F.col("root").alias("top"))
    out = _met(inside, above, ["g"])
    tables.drop("leaves", "rows-placed", "groups-placed")
    return out.select(F.col("o").alias(order), "c.*", F.col("h").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "over").alias("path")).drop("_")


def _met(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(F.broadcast(few) if few.count() <= FEW else few, on)


def _placed(tables: Scratch, label: str, rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``: 0, 1, ... within each group ``g`` in ``order``, without gathering a group.

    Ranges are sorted and numbered where they lie; a range's part of a group starts where the counts of
    the ranges before it end.  A last key keeps rows apart that are equal in all others.
    """
    dealt = rows.withColumn("salt", F.monotonically_increasing_id())
    by = ["g", *order, "salt"]
    lined = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt").withColumn("seq", F.monotonically_increasing_id())
    lined = tables.table(f"{label}-placed", lined.withColumn("part", F.shiftright("seq", 33)))
    parts = lined.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = tables.table(f"{label}-starts", parts.select("g", "part", (before - F.col("first")).alias("shift")))
    return _met(lined, starts, ["g", "part"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def _climbed(tables: Scratch, label: str, nodes: DataFrame) -> DataFrame:
    """Nodes (g, pos, h, more) with their path to the root of their group, and this root."""
    sizes = nodes.groupBy("g").agg((F.max("pos") + 1).alias("n"))
    steps = F.lit(0)
    for k in range(1, 22):  # 8^21 = 2^63
        steps = steps + (F.col("n") > F.lit(FANOUT ** (k - 1))).cast("int")
    sizes = tables.table(f"{label}-sizes", sizes.select("g", steps.alias("levels")))
    most = sizes.agg(F.max("levels").alias("m")).first().m or 0
    blocks = _met(nodes, sizes, ["g"]).withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("levels", F.least("levels", F.lit(DEPTH)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.drop("levels").schema) + f", path {PATH}, root string"
    done = tables.table(f"{label}-climbed", blocks.groupBy("g", "block").applyInArrow(_trees, schema))
    if most <= DEPTH:
        return done.drop("block")
    tops = done.where(F.col("pos") == F.col("block") * BLOCK).select("g", F.col("block").alias("pos"), F.col("root").alias("h"))
    above = _climbed(tables, f"{label}+", tops).select("g", F.col("pos").alias("block"), F.col("path").alias("over"), F.col("root").alias("top"))
    return _met(done.drop("root"), above, ["g", "block"]).withColumn("path", F.concat("path", "over")).withColumnRenamed("top", "root").drop("block", "over")


#: Parents: the digest of every run of eight digests.
_PARENTS = f"CREATE OR REPLACE TEMP TABLE n{{up}} AS SELECT p // {FANOUT} AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM n{{at}} GROUP BY p // {FANOUT}"
#: Each node's siblings on either side.
_SIDES = f"""CREATE OR REPLACE TEMP TABLE s{{at}} AS SELECT p, {{{{
  'l': coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
  'r': coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')}}}} AS s
  FROM n{{at}} WINDOW run AS (PARTITION BY p // {FANOUT} ORDER BY p)"""
_ENGINE: list = []


def _engine():
    """One DuckDB connection a worker, in one thread, with bounded memory and no files."""
    if not _ENGINE:
        import duckdb

        _ENGINE.append(duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}))
    return _ENGINE[0]


def _trees(block: pa.Table) -> pa.Table:
    """The tree over one aligned block: every node's path inside the block, and the block's root."""
    block = block.sort_by("pos")
    levels = block.column("levels")[0].as_py()
    engine = _engine()
    engine.register("given", pa.table({"p": block.column("pos"), "h": block.column("h")}))
    engine.execute("CREATE OR REPLACE TEMP TABLE n0 AS SELECT * FROM given")
    for at in range(levels):
        engine.execute(_SIDES.format(at=at))
        engine.execute(_PARENTS.format(at=at, up=at + 1))
    root = engine.execute(f"SELECT h FROM n{levels}").fetchall()[0][0]
    if levels:
        joins = "".join(f" JOIN s{at} ON s{at}.p = n0.p // {FANOUT**at}" for at in range(levels))
        path = engine.sql(f"SELECT [{', '.join(f's{at}.s' for at in range(levels))}] AS path FROM n0{joins} ORDER BY n0.p").to_arrow_table().column("path")
    else:
        path = pa.array([[]] * block.num_rows, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))
    engine.unregister("given")
    return block.drop_columns("levels").append_column("path", path).append_column("root", pa.array([root] * block.num_rows, pa.string()))
