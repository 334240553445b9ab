"""Overlapping token chunks and records to chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X


def chunk(rows: DataFrame, text_col: str, size: int = 256, overlap: int = 25, tokens: Callable[[Column], Column] = X.words) -> DataFrame:
    """Adds chunk_id, chunk_text, chunk_start, chunk_end; one row a chunk.

    A text of up to ``size`` tokens is one chunk, verbatim.  Longer ones are windows with a stride of
    ``size - overlap`` that start while tokens are left; offsets are proportional to the length.
    """
    stride = size - overlap
    t = F.col(text_col)
    with_tokens = rows.withColumn("__t", tokens(t)).withColumn("__n", F.size("__t")).where("__n > 0")
    starts = F.when(F.col("__n") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__n") - 1, F.lit(stride)))
    out = with_tokens.select("*", F.posexplode(starts).alias("chunk_id", "__s"))
    end = F.least(F.col("__s") + size, F.col("__n"))
    whole = F.col("__n") <= size
    at = lambda i: F.floor(i / F.col("__n") * F.length(t)).cast("int")
    return out.withColumns({
        "chunk_text": F.when(whole, t).otherwise(F.array_join(F.slice("__t", F.col("__s") + 1, F.lit(size)), " ")),
        "chunk_start": F.when(whole, 0).otherwise(at(F.col("__s"))),
        "chunk_end": F.when(whole, F.length(t)).otherwise(at(end)),
    }).drop("__t", "__n", "__s")


def record_chunks(records: DataFrame, index_col: str = "row_idx", least: int = 50, **options) -> DataFrame:
    """Corpus records to chunks: text and abstract, id = md5(link + index), short chunks dropped after
    they are numbered."""
    text = F.concat_ws(" ", F.coalesce("text_extracted", F.lit("")), F.coalesce("abstract", F.lit("")))
    rows = records.withColumn("__whole", text).withColumn("record_id", F.md5(F.concat(F.coalesce("link", F.lit("")), F.col(index_col).cast("string"))))
    out = chunk(rows, "__whole", **options).where(F.length(F.trim("chunk_text")) >= least).drop("__whole")
    return out.withColumn("relevance_score", F.coalesce("relevance_score", F.lit(1.0)))
