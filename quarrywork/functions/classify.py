"""CASE classifiers and rule tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import lexicon as L
from . import text as X


def _case(subject: Column, branches, otherwise: str) -> Column:
    out = None
    for terms, name in branches:
        out = (F if out is None else out).when(X.contains_any(subject, terms), name)
    return out.otherwise(otherwise)


#: Genres in order of priority.
GENRE = (
    (("survey", "questionnaire", "census"), "survey"), (("dataset", "data", "statistics", "csv", "database"), "dataset"), (("pdf", ".pdf", "document"), "pdf"),
    (("book", "handbook", "manual", "guide"), "book"), (("report", "annual", "study", "analysis"), "report"),
)
#: Search strategies in order of priority.
STRATEGY = (
    (("vs", "comparison", "compare"), "comparative_analysis"), (("trend", "over time", "historical"), "temporal_analysis"),
    (("impact", "effect", "influence"), "impact_assessment"), (("icar", "iari", "research"), "institution_focused"),
    (("iot", "ai", "precision", "smart"), "technology_integration"),
)


def genre(*texts: X.Text) -> Column:
    return _case(F.lower(F.concat_ws(" ", *[X.col(t) for t in texts])), GENRE, "article")


def strategy(query: X.Text) -> Column:
    return _case(F.lower(X.col(query)), STRATEGY, "general_exploration")


def category(url: X.Text, title: X.Text, is_pdf: X.Text) -> Column:
    u, t, pdf = F.lower(X.col(url)), F.lower(X.col(title)), X.col(is_pdf)
    paper = X.contains_any(t, ("research", "study", "analysis"))
    report = X.contains_any(t, ("report", "survey"))
    return (
        F.when(pdf & paper, "research_paper").when(pdf & report, "technical_report").when(pdf, "pdf_document")
        .when(X.contains_any(u, ("gov.in", "nic.in")), "government_content").when(X.contains_any(u, ("edu", "ac.in", "university")), "academic_content")
        .when(X.contains_any(t, ("news", "article")), "news_article").otherwise("web_content")
    )


def tags(text: X.Text, base: tuple[Column, ...] = (), mapping: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Base tags and those of which a keyword is a substring, distinct and sorted."""
    low = F.lower(X.col(text))
    found = [F.when(X.contains_any(low, keys), F.lit(tag)) for tag, keys in (mapping or L.TAGS).items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*base, *found))))


def tags_in_order(text: X.Text, first: Column, mapping: dict[str, tuple[str, ...]] | None = None) -> Column:
    """``first`` and the tags of which a keyword is a substring, in the mapping's order, repeats kept."""
    low = F.lower(X.col(text))
    found = [F.when(X.contains_any(low, keys), F.lit(tag)) for tag, keys in (mapping or L.PDF_TAGS).items()]
    return F.array_compact(F.array(first, *found))


def goes_to(url: X.Text, patterns: Column) -> Column:
    """Whether a URL contains one of an agent's patterns; an agent without any gets every URL."""
    p = F.coalesce(patterns, F.array().cast("array<string>"))
    return (F.size(p) == 0) | F.exists(p, lambda x: F.contains(F.coalesce(X.col(url), F.lit("")), x))


def is_bot_check(html: X.Text) -> Column:
    return (F.length(X.col(html)) < 500) | (X.match_count(F.lower(X.col(html)), L.BOT_MARKS) >= 2)


def is_navigation(text: X.Text) -> Column:
    return (F.length(X.col(text)) < 20) | (X.match_count(F.lower(X.col(text)), L.NAVIGATION_MARKS) >= 2) | (X.word_count(text) < 5)
