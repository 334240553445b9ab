"""Search results: boosts, ranking, selection, and whole search flows over tables of hits.

The search itself is outside the engine: hits enter as a table (query, rank, href, title, body), and
every flow here is a composition that Catalyst plans as one query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scoring as S, text as X, urls as U
from . import dedup as D, expand as E, records as R


def boosted(hits: DataFrame, domains: Sequence[str], query: str = "query") -> DataFrame:
    """Relevance 1, or 2 where the host contains a listed name; ranked by it within each query, in the
    order of the search where equal."""
    host = F.lower(U.netloc("href"))
    out = hits.withColumn("domain", host).withColumn("relevance_score", F.when(X.contains_any(host, domains), 2.0).otherwise(1.0))
    return out.withColumn("position", F.row_number().over(W.partitionBy(query).orderBy(F.desc("relevance_score"), "rank")))


def one_strategy(queries: DataFrame, hits: DataFrame, suffix: str = "agriculture", most: int = 10) -> DataFrame:
    """The first ``most`` hits of each query (query_id, text) in one general form; snippets are their content."""
    asked = queries.select("query_id", F.concat_ws(" ", "text", F.lit(suffix)).alias("query"))
    rows = asked.join(hits, "query").where(F.col("rank") <= most)
    return rows.select("query_id", "query", "rank", "href", "title", F.col("body").alias("snippet"), F.col("body").alias("content"))


def three_strategies(queries: DataFrame, hits: DataFrame, most: int = 10) -> DataFrame:
    """Hits of each query (query_id, text) as it is and in two general forms, distinct by URL in order of
    strategy and rank, with estimated quality and relevance."""
    from ..sources.readers import candidates

    forms = F.slice(E.expanded("text"), 1, 3)
    asked = queries.select("query_id", F.col("text").alias("asked"), F.posexplode(forms).alias("strategy", "query"))
    return candidates(asked.join(hits, "query"), most)


def threshold(rows: DataFrame, score: str, least: float, success: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of at least that score, and one row of counts over all rows: kept, extracted, failed."""
    kept = F.coalesce(F.col(score) >= least, F.lit(False))
    ok = F.coalesce(success, F.lit(False))
    return rows.where(kept), rows.agg(F.count_if(kept).alias("kept"), F.count_if(ok).alias("successful_extractions"), F.count_if(~ok).alias("failed_extractions"))


def response(rows: DataFrame, success: Column, score: str = "relevance_score", *by: str) -> DataFrame:
    """Summary of a response: results, extractions that succeeded and failed, mean relevance (0 without any)."""
    ok = F.coalesce(success, F.lit(False))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_results"), F.count_if(ok).alias("successful_extractions"), F.count_if(~ok).alias("failed_extractions"),
        F.round(F.coalesce(F.try_divide(F.sum(F.col(score).cast("decimal(38,10)")).cast("double"), F.count(score)), F.lit(0.0)), 6).alias("average_relevance"),
    )


def selected(candidates: DataFrame, query: str, most: int = 5, least: float = 0.3, chosen: str | None = None) -> DataFrame:
    """Candidates to extract: of at least that quality, and where there are more than ``most``, a model's
    choice (positions 1 to 15 in the array column ``chosen``) or, without one, the most relevant, then
    best ones; ties in order of rank."""
    good = candidates.where(F.col("estimated_quality") >= least)
    n = F.count(F.lit(1)).over(W.partitionBy(query))
    place = F.row_number().over(W.partitionBy(query).orderBy("rank"))
    best = F.row_number().over(W.partitionBy(query).orderBy(F.desc("relevance_score"), F.desc("estimated_quality"), "rank"))
    rows = good.withColumns({"__n": n, "__place": place, "__best": best})
    plain = (F.col("__n") <= most) | (F.col("__best") <= most)
    if chosen:
        named = F.filter(F.slice(F.coalesce(F.col(chosen), F.array().cast("array<int>")), 1, most), lambda x: (x >= 1) & (x <= F.least(F.col("__n"), F.lit(15))))
        plain = F.when((F.col("__n") > most) & (F.size(named) > 0), F.array_contains(named, F.col("__place"))).otherwise(plain)
    return rows.where(plain).drop("__n", "__place", "__best")


def ranked(rows: DataFrame, query: str, credibility: Column, relevance: Column, freshness: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Rows with a weighted score and their rank by it within each query; ties by URL."""
    total = relevance * weights[0] + credibility * weights[1] + freshness * weights[2]
    return rows.withColumn("score", total).withColumn("position", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), "url")))


def search(queries: DataFrame, hits: DataFrame, pages: DataFrame, exact: dict[str, float], most: int = 10, least: float = 3.0) -> DataFrame:
    """The search flow: variants of each query (query_id, text), their hits, one per URL, with what was
    extracted, ranked by relevance, credibility and freshness, without those of low relevance; the first
    ``most`` of each query."""
    asked = queries.select("query_id", F.col("text").alias("asked"), F.posexplode(E.variants("text")).alias("variant", "query"))
    found = asked.join(hits, "query").select("query_id", "asked", "variant", "rank", F.col("href").alias("url"), "title", F.col("body").alias("snippet"))
    first = D.keep_first(found.withColumn("__key", F.struct("query_id", U.normalize("url"))), "__key", ["variant", "rank"]).drop("__key")
    rows = R.with_extractions(first, pages)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.coalesce("content", F.lit("")))
    relevance = S.term_coverage(text, "asked")
    trust = S.source_credibility(S.authority(F.lower(U.netloc("url")), exact), "author", "publish_date", F.coalesce("word_count", X.word_count("snippet")))
    out = ranked(rows.withColumn("relevance", relevance), "query_id", trust, F.col("relevance"), S.freshness("publish_date"))
    return out.where((F.col("relevance") >= least) & (F.col("position") <= most))


def read_articles(selected_rows: DataFrame, pages: DataFrame, least_words: int = 100) -> DataFrame:
    """Selected candidates with their pages' content; an article of fewer words is its snippet."""
    rows = R.with_extractions(selected_rows, pages)
    short = F.coalesce(F.col("word_count") < least_words, F.lit(True))
    return rows.withColumn("content", F.when(short, F.coalesce("snippet", F.lit(""))).otherwise(F.col("content")))


def three_phases(queries: DataFrame, hits: DataFrame, pages: DataFrame, trusted: Sequence[str], most: int = 5) -> DataFrame:
    """Candidates (three times ``most``), the selected ones, and their articles."""
    found = three_strategies(queries, hits, 3 * most)
    ok = X.contains_any(F.lower(U.netloc("href")), trusted)
    low = F.lower(F.concat_ws(" ", "title", "body"))
    asked = F.array_distinct(X.words(F.lower(F.col("asked"))))
    hits_of_query = F.size(F.filter(asked, lambda w: low.contains(w)))
    found = found.withColumns({"estimated_quality": S.candidate_quality(ok, hits_of_query, "body"), "relevance_score": S.candidate_relevance(ok, hits_of_query, F.lit(0), F.lit(0))})
    chosen = selected(found.withColumn("rank", F.col("position")), "query_id", most)
    return read_articles(chosen.select("query_id", "rank", F.col("href").alias("url"), "title", F.col("body").alias("snippet"), "relevance_score", "estimated_quality"), pages)


def articles(pages: DataFrame, blocked: Sequence[str] = (), least: int = 200, id_col: str = "page_id") -> DataFrame:
    """Pages (url, html) to articles: none from blocked hosts, from checks for robots, and without main
    content; id, url, content, author, publication_date, keywords, word_count."""
    from ..functions import classify as C, html as H

    good = pages.where(~X.contains_any(F.coalesce(U.netloc("url"), F.lit("")), blocked) & F.coalesce(~C.is_bot_check("html"), F.lit(False)))
    return good.select(id_col, "url", H.article("html", least).alias("a")).where("a IS NOT NULL").select(id_col, "url", "a.*")
