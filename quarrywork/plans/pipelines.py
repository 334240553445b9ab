"""Whole flows as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import lexicon as L
from ..functions import text as X, urls as U
from ..session import cut
from ..operators import chunking, citations as K, dedup as D, expand as E, search as V, validate as Y


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Corpus to flat index: chunks with ids, text and unit vectors in one row."""
    chunks = chunking.chunk(documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "text").where(F.length(F.trim("chunk_text")) >= 50)
    chunks = chunks.select(F.concat_ws("-", F.col("doc").cast("string"), F.col("chunk_id").cast("string")).alias("chunk"), "chunk_text")
    return chunks.withColumn("e", V.hash_embedding(F.col("chunk_text"))).transform(lambda c: V.index(c, "chunk", "e", "chunk_text"))


def cited_reports(questions: DataFrame, documents: DataFrame, k: int = 3, index: DataFrame | None = None) -> DataFrame:
    """Question -> two variants -> top k chunks each -> numbered, cited report.  ``index`` is one that has
    been built before (``sinks.write_index``); without it the documents are chunked and embedded now."""
    asked = questions.select("item_id", F.posexplode(E.variants("text")).alias("sub", "q"))
    queries = asked.select(F.concat_ws("-", F.col("item_id").cast("string"), F.col("sub").cast("string")).alias("query_id"), V.hash_embedding(F.col("q")).alias("unit"))
    # Written once: it is read to rank ids and again for the winners' texts.
    flat = index if index is not None else cut(build_index(documents))
    hits = V.top_k(queries, flat, k, digits=9)
    item, sub = F.split_part("query_id", F.lit("-"), F.lit(1)).cast("long"), F.split_part("query_id", F.lit("-"), F.lit(2)).cast("int")
    lines = hits.select(item.alias("item_id"), (sub * 1000 + F.col("rank")).alias("ord"), F.concat_ws(" ", F.concat(F.lit("["), K.citation_id(F.lit("DB"), sub + 1, F.col("rank")), F.lit("]")), X.abstract("chunk_text", 200)).alias("line"))
    return K.numbered(lines, "item_id", "ord", F.col("line"), "report")


def material(questions: DataFrame, index: DataFrame, hits: DataFrame, k: int = 3, most: int = 3, agents=None) -> DataFrame:
    """Citations of all sub-queries of each question (item_id, text): the ``k`` nearest chunks of an index
    for the query as its agent asks it, and the first ``most`` web hits (query, rank, href, title, body).
    """
    rows = agents if agents is not None else L.AGENTS
    asked = E.routed(questions.select("item_id", F.posexplode(E.variants("text")).alias("sub", "q")), "q", rows)
    name = F.concat_ws("-", F.col("item_id").cast("string"), F.col("sub").cast("string"))
    found = V.top_k(asked.select(name.alias("query_id"), V.hash_embedding(F.col("agent_query")).alias("unit")), index, k, digits=9)
    item, sub = F.split_part("query_id", F.lit("-"), F.lit(1)).cast("long"), F.split_part("query_id", F.lit("-"), F.lit(2)).cast("int")
    database = found.select(item.alias("item_id"), sub.alias("sub"), (F.col("rank") - 1).alias("rank"), F.lit("").alias("title"), F.col("id").alias("source"), F.col("chunk_text").alias("text"), F.round("similarity_score", 6).alias("score"))
    web = asked.join(hits, asked["q"] == hits["query"]).where(F.col("rank") <= most)
    web = web.select("item_id", "sub", (F.col("rank") - 1).alias("rank"), "title", F.col("href").alias("url"), F.col("body").alias("snippet"), F.lit("").alias("content"), F.lit(1.0).alias("score"))
    return K.flattened(database, web, "item_id")


def curate(hits: DataFrame, assigned: int | None = None, blocks: int = 1) -> DataFrame:
    """Search results to new, valid records: normalise, dedup by URL, title and content, validate."""
    rows = hits.withColumn("url_key", U.normalize("link")).withColumn("title_key", F.nullif(X.normalize("title"), F.lit(""))).withColumn("content_key", F.md5(X.normalize("text_extracted")))
    rows = D.accepted(rows, ["url_key", "title_key", "content_key"], "ord").drop("url_key", "title_key", "content_key")
    return Y.validated(rows).where("valid").drop("errors", "valid")
