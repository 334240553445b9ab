"""Mixing sources to target weights [native]: systematic sampling within each source.

Each document of a source is expected ``target / source_size`` times (0 to 2).  Documents of a
source are put in one fixed order, by size and then by a content hash; the prefix sum of expected
copies plus one random offset for the source is taken, and a document is emitted once for every
integer boundary that it crosses.  Ordering by size makes each size class take its own share, so the
words taken come near the target, usually within one long document.

The prefix sum never gathers a source in one task.  The order is cut into a fixed tree (source, size
class, size, hash slice); counts are aggregated map-side, prefix sums are windows over at most a few
thousand nodes of one parent, and only rows of one leaf are ranked together.

Defined cases: null or blank text has size 0 and is never taken; a null source is a source of its
own and comes last; sources of no words get target 0; a null id is ordered by its text's hash; rows
that are equal in all used columns may swap their copies; an empty table gives an empty result;
further columns are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranks import rank_within
from .scratch import Scratch, unused

#: Fixed value: a word is a run without the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
_TREE = ["source", "__c", "__b", "__a"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order_key(id_col: str, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit("")))))


def _offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("<null>"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def _ranked_sources(tables: Scratch, sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """source, source_size, weight: weights repeat over the sources by code point, null last.

    Sources are range-partitioned and ranked within their partition after the partitions' counts.
    """
    dealt = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__p", F.spark_partition_id())
    dealt = tables.table("sources", dealt)
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("__p").orderBy(F.col("source").asc_nulls_last())) - 1
    rank = F.col("__start") + F.col("__in")
    return (
        dealt.withColumn("__in", inside)
        .join(starts.select("__p", "__start"), "__p")
        .select("source", "source_size", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    )


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes by weight, at most ``cap`` times a source's size.

    What is above a cap is shared anew by weight among the others until none is above.  Each round
    is one aggregate of three sums.
    """
    total = sources.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    limit = F.col("source_size") * F.lit(float(cap))
    level = 0.0
    while total:
        # A source whose limit is below weight * level is held at its limit from now on.
        held = limit < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(held, F.col("source_size"))).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("weight")
        ).first()
        if not row["weight"]:
            break
        new = (share * total - cap * (row["held"] or 0)) / row["weight"]
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level))))


def plan(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken, and its key."""
    tables = Scratch(docs.sparkSession, "mixing")
    text = F.col(text_col)
    size = word_count(text)
    narrow = tables.table(
        "narrow",
        docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), size.alias("__size"), _order_key(id_col, text).alias("__key"))
        .withColumn("__c", F.shiftright("__size", 8)).withColumn("__b", F.col("__size").bitwiseAND(255))
        .withColumn("__a", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int")),
    )
    sizes = narrow.groupBy("source").agg(F.sum("__size").alias("source_size"))
    goal = tables.table("targets", targets(_ranked_sources(tables, sizes, weights), share, cap))
    leaves = tables.table("leaves", narrow.groupBy(*_TREE).agg(F.count(F.lit(1)).alias("__n")))
    start = F.lit(0)
    nodes = leaves
    for depth in (1, 2, 3):
        parent, child = _TREE[:depth], _TREE[depth]
        before = W.partitionBy(*parent).orderBy(child).rowsBetween(W.unboundedPreceding, -1)
        level = leaves.groupBy(*parent, child).agg(F.sum("__n").alias("__n")).withColumn(f"__s{depth}", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
        on = level.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*parent, child])], f"__s{depth}")
        cond = F.lit(True)
        for i, k in enumerate([*parent, child]):
            cond = cond & nodes[k].eqNullSafe(on[f"__k{i}"])
        nodes = nodes.join(on, cond).drop(*[f"__k{i}" for i in range(depth + 1)])
        start = start + F.col(f"__s{depth}")
    nodes = nodes.select(*[F.col(k).alias(f"__l{i}") for i, k in enumerate(_TREE)], start.alias("__start"))
    ranked = narrow.withColumn("__in", F.row_number().over(W.partitionBy(*_TREE).orderBy("__key", "__id")))
    cond = F.lit(True)
    for i, k in enumerate(_TREE):
        cond = cond & ranked[k].eqNullSafe(nodes[f"__l{i}"])
    goal = goal.select(F.col("source").alias("__gs"), "source_size", "target")
    ranked = ranked.join(nodes, cond)
    ranked = ranked.join(F.broadcast(goal) if _small(goal) else goal, ranked["source"].eqNullSafe(goal["__gs"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = (F.col("__start") + F.col("__in")).cast("double")
    offset = _offset(F.col("source"), seed)
    copies = (F.floor(upto * rate + offset) - F.floor((upto - 1) * rate + offset)).cast("long")
    return ranked.select(
        F.col("__id").alias(id_col), "source", F.col("__size").alias("size"), F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken"), F.col("__key").alias("row_key"),
    )


#: Sources whose targets are broadcast at most: under 2 MB.  Beyond it the join shuffles.
BROADCAST_SOURCES = 10_000


def _small(goal: DataFrame) -> bool:
    return goal.count() <= BROADCAST_SOURCES


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixture: each document's row as often as it is taken, with its own columns."""
    tables = Scratch(docs.sparkSession, "mixture")
    own, key, total, count, nth, copies, one, row = (unused(docs, f"__qw_{x}") for x in ("own", "key", "sum", "n", "nth", "copies", "one", "row"))
    chosen = plan(docs, id_col=id_col, text_col=text_col, **options).where("copies > 0")
    # Rows with the same key are equal in id and text; the copies of such rows are dealt by rank.
    chosen = tables.table("chosen", chosen.groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").alias(total)))
    keyed = docs.withColumn(own, _order_key(id_col, F.col(text_col)))
    times = tables.table("times", keyed.groupBy(F.col(own).alias(key)).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1))
    columns = list(docs.columns)
    if times.isEmpty():
        dealt = keyed.join(chosen, F.col(own) == F.col(key)).withColumn(copies, F.col(total)).select(*columns, copies)
    else:
        single = keyed.join(times, F.col(own) == F.col(key), "left_anti").join(chosen, F.col(own) == F.col(key)).withColumn(copies, F.col(total))
        # Rows that repeat have a number each, so their ranks do not gather a key in one task.
        many = keyed.join(times, F.col(own) == F.col(key)).drop(key).join(chosen, F.col(own) == F.col(key)).withColumn(row, F.monotonically_increasing_id())
        many = rank_within(tables, "many", tables.table("many", many), own, [row], nth)
        share = lambda x: F.floor(x * F.col(total) / F.col(count))
        many = many.withColumn(copies, (share(F.col(nth) + 1) - share(F.col(nth))).cast("long"))
        dealt = single.select(*columns, copies).unionByName(many.select(*columns, copies))
    return dealt.where(F.col(copies) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*columns)
