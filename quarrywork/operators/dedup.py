"""Deduplication: single key, chained keys (mark on check) and greedy multi-key (mark on accept)."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X, urls as U
from ..session import cut


def keep_first(rows: DataFrame, key: Column | str, order: Sequence[str]) -> DataFrame:
    """The first row of each key; of rows that are equal in ``order``, one.

    One aggregate with map-side combining: a hot key leaves each task as one row, and rows that are not
    first are never shuffled.
    """
    key = F.col(key) if isinstance(key, str) else key
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order))
    return rows.groupBy(key.alias("key")).agg(first.alias("row")).select("row.*")


def checked(rows: DataFrame, keys: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """Every key is marked when it is checked, so passing one check after the other is exact."""
    for key in keys:
        rows = keep_first(rows, key, order)
    return rows


#: Open rows and keys up to which the driver finishes the greedy loop.
FEW = 100_000


def accepted(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A row is accepted iff none of its keys belongs to an accepted earlier row; rejected rows mark
    nothing.  Null keys mark and match nothing.

    This is the first maximal independent set in ``order``.  In a round, a row that is the earliest open
    one in all of its keys is accepted, and all that share a key with an accepted row are rejected.  From the
    second round on, rows that share keys with one earlier row alone are decided too, however far back their chain
    reaches: they are accepted iff that row is not, and such links are composed by doubling.  Rounds go on until
    at most ``FEW`` entries (rows and keys) are open, which are finished by the plain loop on the driver.
    Nothing is gathered by component.  ``order`` must be unique.
    """
    kinds = F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)])
    edges = rows.select(F.col(order).alias("o"), F.explode_outer(F.array_compact(kinds)).alias("k"))
    open_, taken = cut(edges), None
    for done in itertools.count(1):
        if open_.count() <= FEW:
            rest = _greedy(open_)
            taken = rest if taken is None else taken.union(rest)
            break
        won = _decided(open_, chains=done > 1)
        taken = won if taken is None else taken.union(won)
        if done % 20 == 0:
            taken = cut(taken)
        # Written before the joins, so that rows of a hot key may be split.
        closed = cut(open_.join(won, "o", "left_semi").where("k IS NOT NULL").select("k").distinct())
        lost = open_.join(closed, "k", "left_semi").select("o").distinct()
        open_ = cut(open_.join(won, "o", "left_anti").join(lost, "o", "left_anti"))
    return rows.join(taken.withColumnRenamed("o", "__o"), F.col(order) == F.col("__o"), "left_semi")


def _decided(open_: DataFrame, chains: bool) -> DataFrame:
    """The open rows (o, k) that a round accepts; with ``chains``, also those that chains lead to."""
    least = open_.where("k IS NOT NULL").groupBy("k").agg(F.min("o").alias("m"))
    placed = open_.join(least, "k", "left")
    if not chains:
        later = placed.groupBy("o").agg(F.max(F.when(F.col("m") < F.col("o"), 1).otherwise(0)).alias("later"))
        return cut(later.where("later = 0").select("o"))
    placed = cut(placed)
    second = placed.where("o > m").groupBy("k").agg(F.min("o").alias("m2"))
    # The second of a key follows its first alone; a later one follows two or more.
    told = placed.join(second, "k", "left").select("o", F.when(F.col("o") == F.col("m2"), F.col("m")).alias("p"), (F.col("o") > F.col("m2")).alias("far"))
    state = cut(told.groupBy("o").agg(F.min("p").alias("p"), F.max("p").alias("q"), F.max("far").alias("far")))
    more = F.coalesce("far", F.lit(False))
    free = state.where(~more & F.col("p").isNull()).select("o")
    links = state.where(~more & (F.col("p") == F.col("q"))).select("o", "p", F.lit(True).alias("odd"), F.lit(False).alias("ended"))
    ends = _doubled(cut(links))
    return cut(free.union(ends.where("NOT odd").join(free.withColumnRenamed("o", "p"), "p", "left_semi").select("o")))


def _doubled(links: DataFrame) -> DataFrame:
    """Links (o, p, odd, ended) led on to the first row that has no link; ``odd`` tells whether that takes an odd
    number of steps.  Each turn doubles the steps, so there are as many as the longest chain has binary digits."""
    while not links.where("NOT ended").isEmpty():
        ahead = links.select(F.col("o").alias("at"), F.col("p").alias("to"), F.col("odd").alias("more"))
        led = links.where("NOT ended").join(ahead, F.col("p") == F.col("at"), "left").select(
            "o", F.coalesce("to", "p").alias("p"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("at").isNull().alias("ended")
        )
        links = cut(led.union(links.where("ended")))
    return links


def _greedy(open_: DataFrame) -> DataFrame:
    """The accepted ones of few open rows (o, k), row by row in order of o."""
    marked, won = set(), []
    for o, group in itertools.groupby(open_.orderBy("o").collect(), key=lambda r: r.o):
        own = {r.k for r in group if r.k is not None}
        if not own & marked:
            marked |= own
            won.append((o,))
    return open_.sparkSession.createDataFrame(won, open_.select("o").schema)


def membership(rows: DataFrame, state: DataFrame, url: str = "url", title: str = "title", content: str = "content") -> DataFrame:
    """Flags against a state table (kind, key): ``is_duplicate_url`` and ``is_duplicate_content``."""
    seen = lambda kind: state.where(F.col("kind") == kind).select("key").distinct()
    out = rows.withColumn("__u", F.md5(U.normalize(url))).withColumn("__t", X.normalize(title)).withColumn("__c", F.md5(X.normalize(content)))
    for column, kind, flag in (("__u", "url", "__fu"), ("__t", "title", "__ft"), ("__c", "content", "__fc")):
        out = out.join(seen(kind).withColumnRenamed("key", f"{column}k").withColumn(flag, F.lit(True)), F.col(column) == F.col(f"{column}k"), "left").drop(f"{column}k")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.withColumn("is_duplicate_url", flag("__fu")).withColumn("is_duplicate_content", flag("__ft") | flag("__fc")).drop("__u", "__t", "__c", "__fu", "__ft", "__fc")


def state_of(rows: DataFrame, url: str = "url", title: str = "title", content: str = "content") -> DataFrame:
    """The state rows (kind, key) that processed rows leave behind."""
    keys = F.array(
        F.struct(F.lit("url").alias("kind"), F.md5(U.normalize(url)).alias("key")),
        F.struct(F.lit("title").alias("kind"), X.normalize(title).alias("key")),
        F.struct(F.lit("content").alias("kind"), F.md5(X.normalize(content)).alias("key")),
    )
    return rows.select(F.explode(keys).alias("s")).select("s.kind", "s.key").where("key IS NOT NULL AND key <> ''").distinct()


def state_counts(state: DataFrame) -> DataFrame:
    """Distinct URLs, titles and contents of a state table (kind, key): one row."""
    n = lambda kind: F.countDistinct(F.when(F.col("kind") == kind, F.col("key")))
    return state.agg(n("url").alias("total_urls"), n("title").alias("total_titles"), n("content").alias("total_content_hashes"))


def against_state(rows: DataFrame, state: DataFrame, **columns: str) -> DataFrame:
    """Rows that an earlier run's state does not know: nothing of this run is marked, so rows that are
    equal to each other all stay."""
    return membership(rows, state, **columns).where("NOT is_duplicate_url AND NOT is_duplicate_content").drop("is_duplicate_url", "is_duplicate_content")


def similar_to_recent(rows: DataFrame, group: str, order: str, text: str, ratio: float = 0.85, recent: int = 100, length: int = 500) -> DataFrame:
    """Keeps rows whose prefix is not like (difflib ratio) one of the last ``recent`` kept of its group.

    A group is read in order as a stream, so a task holds a batch and ``recent`` prefixes, however large
    the group is.
    """
    import difflib

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = object(), deque(maxlen=recent)
        for pdf in batches:
            flags = []
            for name, snippet in zip(pdf["__g"], pdf[text].fillna("").str[:length]):
                if name != now:
                    now, kept = name, deque(maxlen=recent)
                near = any(difflib.SequenceMatcher(None, snippet, k).ratio() > ratio for k in reversed(kept))
                flags.append(not near)
                if not near:
                    kept.append(snippet)
            yield pdf[flags].drop(columns="__g")

    named = rows.withColumn("__g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    return named.repartition("__g").sortWithinPartitions("__g", order).mapInPandas(keep, rows.schema)
