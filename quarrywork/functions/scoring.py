"""Numeric scores as column arithmetic, in a fixed order of operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .. import lexicon as L
from . import text as X


def _cap(x: Column) -> Column:
    return F.least(x, F.lit(1.0))


def density(text: X.Text, title: X.Text = "", agri: Sequence[str] = L.AGRI_TERMS, farm: Sequence[str] = L.FARM_TERMS, region: Sequence[str] = L.REGION_TERMS) -> Column:
    """Share of lexicon words in twice the title and the text, plus 0.2 where the title has one."""
    title = F.lit("") if isinstance(title, str) and not title else X.col(title)
    whole = F.concat_ws(" ", title, title, X.col(text))

    def score(t: Column) -> Column:
        # The text is cut into words once for all three lists, and counted once.
        parts = lambda n: X.let(X.word_list(t), lambda found: F.struct(n.alias("n"), *[X._counted(t, found, terms).alias(name) for name, terms in (("a", agri), ("f", farm), ("r", region))]))
        value = X.let(X.let(X.word_count(t), parts), lambda c: F.when(c["n"] > 0, c["a"] / c["n"] * 0.5 + c["f"] / c["n"] * 0.3 + c["r"] / c["n"] * 0.2))
        return X.let(value, lambda v: F.when(v.isNull(), F.lit(0.0)).otherwise(_cap(v + F.when(X.term_count(title, agri) > 0, 0.2).otherwise(0.0))))

    return X.let(whole, score)


def occurrence(text: X.Text, terms: Sequence[str] = L.RELEVANCE_TERMS, places: Sequence[str] = L.PLACE_TERMS) -> Column:
    """0.1 for each occurrence of a term and 0.05 for each place, at most 1."""
    low = F.lower(X.col(text))
    count = lambda ts: sum((X.occurrences(low, t) for t in ts), F.lit(0))
    return _cap(count(terms) * 0.1 + count(places) * 0.05)


def occurrence_with_domain(content: X.Text, title: X.Text, snippet: X.Text, domains: Sequence[str], terms: Sequence[str] = L.RELEVANCE_TERMS[:5], places: Sequence[str] = L.PLACE_TERMS, compat: bool = False) -> Column:
    """Occurrences in content, title and snippet, plus 0.5 for a listed domain.  ``compat`` looks for the
    domain in the snippet as if that were the URL, where it hardly ever stands; else ``snippet``'s own
    row is expected to name its URL in a column ``url``."""
    low = F.lower(F.concat_ws(" ", X.col(content), X.col(title), X.col(snippet)))
    count = lambda ts: sum((X.occurrences(low, t) for t in ts), F.lit(0))
    host = F.lower(F.regexp_extract(F.coalesce(X.col(snippet) if compat else F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return _cap(count(terms) * 0.1 + count(places) * 0.05 + F.when(X.contains_any(host, domains), 0.5).otherwise(0.0))


def term_coverage(text: X.Text, query: X.Text, terms: Sequence[str] = L.COVERAGE_TERMS) -> Column:
    """0 to 10: seven times the share of the query's distinct words in the text, and half a point for
    each lexicon term in it (3 at most)."""
    low, asked = F.lower(F.coalesce(X.col(text), F.lit(""))), F.array_distinct(X.words(F.lower(X.col(query))))
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, X.words(low))) / F.size(asked)).otherwise(0.0)
    return F.least(share * 7 + F.least(X.match_count(low, terms) * 0.5, F.lit(3.0)), F.lit(10.0))


def reputation(domain: X.Text, exact: dict[str, float] = L.REPUTATION) -> Column:
    """0 to 1: a listed host, else by what the host contains; 0 without a URL's host given as null."""
    d = X.col(domain)
    out = F.when(d.isNull(), 0.0)
    for name, value in exact.items():
        out = out.when(d == name, value)
    # Substrings of hosts and their scores, asked in this order.
    for parts, value in (((".edu", ".gov", ".org"), 0.7), (("docs.", "documentation", "manual"), 0.6), (("blog", "medium.com", "dev.to"), 0.5)):
        out = out.when(X.contains_any(d, parts), value)
    return out.otherwise(0.4)


def saturating(text: X.Text, terms: Sequence[str] = L.SATURATING_TERMS) -> Column:
    low = F.lower(X.col(text))
    return _cap(sum((F.least(X.occurrences(low, t) * 0.1, F.lit(0.2)) for t in terms), F.lit(0.0)))


def presence(text: X.Text, terms: Sequence[str] = L.CONTEXT_TERMS, places: Sequence[str] = L.STATES[:10]) -> Column:
    low = F.lower(X.col(text))
    return _cap(X.match_count(low, terms) * 0.3 + X.match_count(low, [p.lower() for p in places]) * 0.1)


def richness(tags: Column, regions: Column, crops: Column, soils: Column, climates: Column, fertilizers: Column, methods: Column) -> Column:
    has = lambda c, w: F.when(F.size(F.coalesce(c, F.array())) > 0, w).otherwise(0.0)
    return _cap(sum((has(c, 0.2) for c in (tags, regions, crops)), F.lit(0.0)) + sum((has(c, 0.1) for c in (soils, climates, fertilizers, methods)), F.lit(0.0)))


def content_quality(length: X.Text, relevance: X.Text, context: X.Text, rich: X.Text, is_pdf: X.Text) -> Column:
    n = X.col(length)
    size = F.when(n > 5000, 0.2).when(n > 2000, 0.15).when(n > 500, 0.1).when(n > 100, 0.05).otherwise(0.0)
    return _cap(size + F.least(X.col(relevance) * 0.3, F.lit(0.3)) + F.least(X.col(context) * 0.2, F.lit(0.2)) + F.least(X.col(rich) * 0.2, F.lit(0.2)) + F.when(X.col(is_pdf), 0.1).otherwise(0.0))


def coverage(text: X.Text, terms: Sequence[str], compat: bool = False) -> Column:
    """Distinct terms found over the lexicon's size.  ``compat`` keeps capital letters in terms, which
    a lower-cased text can never match."""
    return X.match_count(F.lower(X.col(text)), terms if compat else [t.lower() for t in terms]) / F.lit(float(len(terms)))


def completeness(length: X.Text, *present: Column) -> Column:
    n = X.col(length)
    size = F.when(n > 1000, 0.3).when(n > 500, 0.2).when(n > 100, 0.1).otherwise(0.0)
    return _cap(sum((F.when(p, 0.1).otherwise(0.0) for p in present), size))


def credibility(domain: X.Text, high: Sequence[str] = L.HIGH_CREDIT, medium: Sequence[str] = L.MEDIUM_CREDIT) -> Column:
    d = F.lower(F.coalesce(X.col(domain), F.lit("")))
    return F.when(d == "", 0.3).when(X.contains_any(d, high), 1.0).when(X.contains_any(d, medium), 0.7).when(X.contains_any(d, (".edu", ".gov", ".org")), 0.6).otherwise(0.4)


def overall_quality(agri: Column, place: Column, complete: Column, credit: Column) -> Column:
    return agri * 0.3 + place * 0.25 + complete * 0.25 + credit * 0.2


def candidate_quality(trusted: Column, hits: Column, snippet: X.Text) -> Column:
    return _cap(F.lit(0.5) + F.when(trusted, 0.3).otherwise(0.0) + F.least(hits * 0.05, F.lit(0.25)) + F.when(F.length(X.col(snippet)) > 200, 0.1).otherwise(0.0))


def candidate_relevance(trusted: Column, query_hits: Column, agri_hits: Column, place_hits: Column) -> Column:
    bounded = F.least(query_hits * 0.05, F.lit(0.2)) + F.least(agri_hits * 0.03, F.lit(0.15)) + F.least(place_hits * 0.02, F.lit(0.1))
    return _cap(F.lit(0.5) + F.when(trusted, 0.3).otherwise(0.0) + bounded)


def authority(domain: X.Text, exact: dict[str, float], keywords: Sequence[str] = ("agri", "farm", "crop", "research")) -> Column:
    """0 to 10: a listed domain, else its suffix in this order, else a keyword, else 5."""
    d = X.col(domain)
    out = F.when(F.lit(False), 0.0)
    for name, value in exact.items():
        out = out.when(d == name, value)
    # Suffix scores, asked in this order.
    for suffix, value in ((".gov", 9.0), (".edu", 8.5), (".org", 7.0), (".ac.in", 8.5), (".nic.in", 9.0)):
        out = out.when(d.endswith(suffix), value)
    return out.when(X.contains_any(d, keywords), 6.0).otherwise(5.0)


def source_credibility(domain_score: Column, author: X.Text, date: X.Text, n_words: X.Text) -> Column:
    bonus = F.when(X.col(author).isNotNull(), 1.0).otherwise(0.0) + F.when(X.col(date).isNotNull(), 1.0).otherwise(0.0)
    loss = F.when(X.col(n_words) < 100, 2.0).when(X.col(n_words) < 300, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), domain_score + bonus - loss))


def freshness(date: X.Text) -> Column:
    return F.when(X.col(date).isNull(), 5.0).otherwise(7.0)


def overlap_relevance(title: X.Text, snippet: X.Text, url: X.Text, query: X.Text) -> Column:
    """Shares of the query's distinct words in title, snippet and URL, and a bonus for the phrase."""
    terms = F.array_distinct(X.words(F.lower(X.col(query))))
    n = F.greatest(F.size(terms), F.lit(1))
    low = [F.lower(F.coalesce(X.col(c), F.lit(""))) for c in (title, snippet, url)]
    inside = lambda t: F.size(F.array_intersect(terms, X.words(t))) / n
    in_url = F.size(F.filter(terms, lambda w: low[2].contains(w))) / n
    phrase = F.when(low[0].contains(F.lower(X.col(query))), 0.3).when(low[1].contains(F.lower(X.col(query))), 0.2).otherwise(0.0)
    return _cap(inside(low[0]) * 0.5 + inside(low[1]) * 0.3 + in_url * 0.2 + phrase)


def inverse_distance(value: X.Text) -> Column:
    """``1 / (1 + value)``, 0 for negative values."""
    return F.when(X.col(value) < 0, 0.0).otherwise(1.0 / (X.col(value) + 1.0))
