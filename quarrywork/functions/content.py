"""Relevant paragraphs, abstracts made of them, and a struct of what a text is about."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .. import lexicon as L
from . import scoring as S, text as X

#: Substrings of paragraphs on the subject.
SUBJECT = ("agriculture", "agricultural", "farming", "farm", "crop")


def relevant_paragraphs(text: X.Text, least: int = 50, subject: Sequence[str] = SUBJECT, places: Sequence[str] = L.REGION_TERMS) -> Column:
    """Paragraphs on the subject, and those over 100 characters that name a place (as a substring)."""
    on = lambda p: X.contains_any(F.lower(p), subject) | (X.contains_any(F.lower(p), places) & (F.length(p) > 100))
    return F.filter(X.paragraphs(text, least), on)


def enhanced_abstract(text: X.Text, limit: int = 500, **options) -> Column:
    """Relevant paragraphs (else the first one) up to ``limit`` characters; the one that passes it is cut
    where over 50 characters are left.  An empty result falls back to the text's beginning."""
    t = X.col(text)
    found = relevant_paragraphs(t, **options)
    parts = F.when(F.size(found) > 0, found).otherwise(F.slice(F.split(t, r"\n\s*\n"), 1, 1))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, p: Column) -> Column:
        room = F.lit(limit) - acc["n"]
        over = F.length(p) > room
        more = F.when(over & (room > 50), F.array_append(acc["parts"], F.concat(F.substring(p, F.lit(1), room), F.lit("...")))).when(over, acc["parts"]).otherwise(F.array_append(acc["parts"], p))
        return F.when(acc["full"], acc).otherwise(F.struct(more.alias("parts"), (acc["n"] + F.length(p)).alias("n"), over.alias("full")))

    joined = F.trim(F.array_join(F.aggregate(parts, start, step, lambda acc: acc["parts"]), " "))
    prefix = F.concat(F.substring(t, 1, limit), F.when(F.length(t) > limit, "...").otherwise(""))
    return F.when(joined == "", prefix).otherwise(joined)


def term_counts_top(text: X.Text, terms: Sequence[str], most: int = 20) -> Column:
    """The commonest whole words of a lexicon, ties in order of first place."""
    found = F.regexp_extract_all(F.lower(X.col(text)), F.lit(X.term_pattern(terms)), F.lit(0))
    count = lambda w, all_: F.struct((-F.size(F.filter(all_, lambda v: v == w))).alias("n"), F.array_position(all_, w).alias("at"), w.alias("w"))
    ranked = X.let(found, lambda all_: F.transform(F.array_distinct(all_), lambda w: count(w, all_)))
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda x: x["w"])


def structured_info(text: X.Text, title: X.Text = "", threshold: float = 0.3, agri: Sequence[str] = L.AGRI_TERMS, farm: Sequence[str] = L.FARM_TERMS, region: Sequence[str] = L.REGION_TERMS) -> Column:
    """Relevance, top 20 terms, first ten relevant paragraphs, places, word and paragraph counts; a null
    or empty text has relevance 0, empty lists and a null paragraph count."""
    return X.let(F.coalesce(X.col(text), F.lit("")), lambda t: X.let(S.density(t, title, agri, farm, region), lambda score: X.let(relevant_paragraphs(t, places=region), lambda paragraphs: _info(t, score, paragraphs, threshold, (*agri, *farm), region))))


def _info(t: Column, score: Column, paragraphs: Column, threshold: float, terms: Sequence[str], region: Sequence[str]) -> Column:
    none = F.array().cast("array<string>")
    some = F.struct(
        (score >= threshold).alias("is_relevant"), score.alias("relevance_score"), term_counts_top(t, terms).alias("key_terms"), F.slice(paragraphs, 1, 10).alias("paragraphs"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(X.term_pattern(region)), F.lit(0)))).alias("regions_mentioned"), X.word_count(t).alias("word_count"), F.size(paragraphs).alias("paragraph_count"),
    )
    empty = F.struct(F.lit(False).alias("is_relevant"), F.lit(0.0).alias("relevance_score"), none.alias("key_terms"), none.alias("paragraphs"), none.alias("regions_mentioned"), F.lit(0).cast("long").alias("word_count"), F.lit(None).cast("int").alias("paragraph_count"))
    return F.when(t == "", empty).otherwise(some)


def watering(text: X.Text, terms: Sequence[str] = ("irrigation", "watering"), most: int = 500) -> Column:
    """The first sentence that speaks of watering, up to ``most`` characters; null where none does."""
    found = F.filter(X.sentences_with_ends(text), lambda s: X.contains_any(F.lower(s), terms))
    return F.substring(F.try_element_at(found, F.lit(1)), 1, most)


def best_paragraphs(text: X.Text, terms: Sequence[str], most: int = 8, limit: int = 3000, least: int = 50) -> Column:
    """The ``most`` paragraphs with the most lexicon substrings, ties in order, up to ``limit`` characters;
    where none has any, the first ten distinct sentences."""
    ranked = F.transform(X.paragraphs(text, least + 1), lambda p, i: F.struct((-X.match_count(F.lower(p), terms)).alias("n"), i.alias("at"), p.alias("p")))
    some = F.slice(F.array_sort(F.filter(ranked, lambda x: x["n"] < 0)), 1, most)
    body = F.array_join(F.transform(some, lambda x: x["p"]), "\n\n")
    rest = F.array_join(F.slice(F.array_distinct(X.sentences_with_ends(text)), 1, 10), " ")
    return F.substring(F.when(F.size(some) > 0, body).otherwise(rest), 1, limit)
