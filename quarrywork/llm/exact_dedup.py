"""Exact dedup [native]: 128-bit content hash, smallest stable id, byte comparison inside groups.

Plan.  One pass over the texts writes a narrow table (id, hash, length, digest).  Groups come from
a map-side-combined aggregate over it, so a group that holds a third of all rows arrives as one row
per task.  Only members of groups of two or more move their texts: an inner join to the groups,
whose group side has one row per hash (skewed hashes are split by AQE).  Each member's normalised
bytes are then compared with its representative's.  Where a comparison fails (a hash collision),
that hash's members are regrouped by the bytes themselves.

Defined cases: null text counts as empty; texts without any other character than white space are
equal to the empty text and to each other; a null id loses every tie against a number; rows that
repeat both id and text share one verdict in ``annotate`` and leave one row in ``deduplicate``;
an empty table gives an empty result; further columns, whatever their names, are kept untouched by
``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch, unused

#: Fixed value: the white space that two equal texts may differ in.
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def content_hash(norm: Column) -> Column:
    """128 bits over the UTF-8 bytes."""
    return F.unhex(F.md5(norm))


def _groups(narrow: DataFrame, keys: list[str]) -> DataFrame:
    best = F.min(F.struct((-F.col("__n")).alias("a"), F.col("__id").isNull().alias("b"), F.col("__id").alias("c")))
    return narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"), best.alias("__best"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``hasher`` maps the normalised text to the grouping hash; tests pass a weak one to force
    collisions.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "exact")
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    norm = normalised(F.col("__text"))
    narrow = tables.table(
        "narrow",
        base.withColumn("__norm", norm).select(
            "__id",
            hasher(F.col("__norm")).alias("__h"),
            F.length(F.coalesce("__text", F.lit(""))).cast("long").alias("__n"),
            F.unhex(F.sha2(F.col("__norm"), 256)).alias("__sha"),
        ),
    )
    groups = tables.table("groups", _groups(narrow, ["__h"]).where("__size > 1").select("__h", "__size", F.col("__best.c").alias("__keep")))
    members = tables.table(
        "members",
        base.withColumn("__norm", norm).withColumn("__h", hasher(F.col("__norm")))
        .join(groups.select("__h", "__keep").hint("shuffle_hash"), "__h")
        .select("__h", "__id", "__keep", "__norm", F.length(F.coalesce("__text", F.lit(""))).cast("long").alias("__n")),
    )
    # Written before the join, so that both of its sides are bare shuffles and AQE may split a large group.
    reps = tables.table("reps", members.where(F.col("__id").eqNullSafe(F.col("__keep"))).groupBy("__h").agg(F.min("__norm").alias("__rep")))
    collided = tables.table("collided", members.join(reps, "__h").where("__norm <> __rep").select("__h")).distinct()
    out = narrow.join(groups.hint("shuffle_hash"), "__h", "left")
    if not collided.isEmpty():
        # Hash collisions: these members are grouped by their bytes instead.
        inside = members.join(collided, "__h").withColumn("__sha", F.unhex(F.sha2("__norm", 256)))
        fixed = tables.table("fixed", _groups(inside, ["__h", "__sha", "__norm"]).select("__h", "__sha", F.col("__size").alias("__size2"), F.col("__best.c").alias("__keep2")))
        out = (
            out.join(fixed, ["__h", "__sha"], "left")
            .withColumn("__keep", F.when(F.col("__size2").isNotNull(), F.col("__keep2")).otherwise(F.col("__keep")))
            .withColumn("__size", F.coalesce("__size2", "__size"))
        )
    tables.drop("members", "reps", "collided")
    keep = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return out.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Rows that share id and text with the row that stays collapse into one.
    """
    tables = Scratch(docs.sparkSession, "exact-stage")
    verdict = tables.table("verdict", annotate(docs, id_col, text_col).where("group_size > 1"))
    key, digest, count, own = (unused(docs, x) for x in ("__qw_id", "__qw_sha", "__qw_n", "__qw_s"))
    named = [F.col(id_col).alias(key), F.unhex("text_sha256").alias(digest)]
    dropped = tables.table("dropped", verdict.where("NOT kept").select(*named).distinct())
    doubled = verdict.where("kept").select(*named).groupBy(key, digest).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1).drop(count)
    doubled = tables.table("doubled", doubled)
    tables.drop("verdict")
    # A row is named by id and digest, since an id may repeat with another text.
    rows = docs.withColumn(own, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    same = F.col(own).eqNullSafe(F.col(digest)) & F.col(id_col).eqNullSafe(F.col(key))
    left = rows.join(dropped, same, "left_anti")
    if not doubled.isEmpty():
        rows = left
        left = rows.join(doubled, same, "left_anti").unionByName(rows.join(doubled, same, "left_semi").dropDuplicates([id_col, own]))
    return left.drop(own)
