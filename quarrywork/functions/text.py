"""Scalar text functions: Column -> Column, all inside code generation.

``(?U)`` gives ``\\w``, ``\\s`` and ``\\b`` their Unicode meaning.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(text: Text) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def normalize(text: Text) -> Column:
    return collapse(F.lower(col(text)))


def normalize_words(text: Text) -> Column:
    """Lower case without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def clean(text: Text) -> Column:
    """Collapsed text of word characters, spaces and ``. , - ( ) [ ] : ;``."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(text), r"(?U)\s+", " "), r"(?U)[^\w\s.,\-()\[\]:;]", ""))


#: Lazy patterns of page furniture.
BOILERPLATE = (r"Cookie.*?Accept", r"Privacy Policy.*?Terms", r"Subscribe.*?Newsletter", r"Follow us.*?Social", r"Share.*?Facebook", r"Advertisement.*?Close")


def strip_boilerplate(text: Text, patterns: Sequence[str] = BOILERPLATE) -> Column:
    out = F.regexp_replace(col(text), r"(?U)\s+", " ")
    for p in patterns:
        out = F.regexp_replace(out, f"(?i){p}", "")
    return F.trim(out)


def words(text: Text) -> Column:
    return F.filter(F.split(col(text), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Text) -> Column:
    return F.size(words(text)).cast("long")


def occurrences(text: Text, term: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")


def contains_any(text: Text, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | col(text).contains(term)
    return out


def matches(text: Text, terms: Sequence[str]) -> Column:
    """The lexicon's terms that are substrings of the lower-cased text, sorted."""
    low = F.lower(col(text))
    return F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in sorted(set(terms))]))


def match_count(text: Text, terms: Sequence[str]) -> Column:
    out = F.lit(0)
    for t in terms:
        out = out + F.when(col(text).contains(t), 1).otherwise(0)
    return out


def term_pattern(terms: Sequence[str]) -> str:
    return r"(?iU)\b(?:" + "|".join(t.replace("-", r"\-") for t in terms) + r")\b"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda's argument is a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Text) -> Column:
    """Runs of word characters, in lower case."""
    return F.split(F.lower(col(text)), r"(?U)\W+")


def term_count(text: Text, terms: Sequence[str]) -> Column:
    """Whole-word occurrences of any term, case ignored; of terms that begin alike the first listed counts."""
    return let(col(text), lambda t: _counted(t, word_list(t), terms))


def _counted(text: Column, found: Column, terms: Sequence[str]) -> Column:
    """Terms of one word are counted in the list of words; the few others by a pattern, and what they
    cover is not counted again."""
    single = [t for t in terms if t.isalnum()]
    several = [t for k, t in enumerate(terms) if not t.isalnum() and not any(s == re.split(r"\W", t)[0] for s in terms[:k])]
    count = lambda words_: F.size(F.filter(words_, lambda w: w.isin(*single))) if single else F.lit(0)
    if not several:
        return count(found).cast("long")
    pattern = term_pattern(several)
    rest = F.regexp_count(text, F.lit(pattern)) + count(word_list(F.regexp_replace(text, pattern, " ")))
    return F.when(contains_any(F.lower(text), several), rest).otherwise(count(found)).cast("long")


def truncate_sentences(text: Text, limit: int = 1000) -> Column:
    """Whole ``'. '``-separated sentences within ``limit - 50`` characters, then ``...``."""
    t = col(text)
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))
    step = lambda acc, x: F.when(
        acc["full"] | (F.length(acc["s"]) + F.length(x) + 2 > limit - 50), F.struct(acc["s"].alias("s"), F.lit(True).alias("full"))
    ).otherwise(F.struct(F.concat(acc["s"], x, F.lit(". ")).alias("s"), F.lit(False).alias("full")))
    cut = F.aggregate(F.split(t, r"\. "), start, step, lambda acc: F.concat(F.trim(acc["s"]), F.lit("...")))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def abstract(text: Text, limit: int = 500) -> Column:
    """Collapsed text up to ``limit``: cut at a late full stop, else at a space with ``...``."""
    t = collapse(text)
    head = F.substring(t, 1, limit)
    stop = limit - F.locate(".", F.reverse(head))  # index of the last full stop
    space = limit - F.locate(" ", F.reverse(head))
    at_stop = F.locate(".", head) > 0
    return F.when(F.length(t) <= limit, t).when(at_stop & (stop > int(limit * 0.7)), F.substring(head, F.lit(1), stop + 1)).otherwise(
        F.concat(F.when(F.locate(" ", head) > 0, F.substring(head, F.lit(1), space)).otherwise(head), F.lit("..."))
    )


def paragraphs(text: Text, least: int = 50) -> Column:
    return F.filter(F.transform(F.split(col(text), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= least)


def sentences(text: Text, least_words: int = 3) -> Column:
    """Split after ``. ! ?`` runs followed by white space; short ones are dropped."""
    parts = F.transform(F.split(col(text), r"[.!?]+(?U:\s+)"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.size(words(s)) >= least_words)


def sentences_with_ends(text: Text) -> Column:
    return F.filter(F.split(col(text), r"(?<=[.!?])(?U:\s+)"), lambda s: F.trim(s) != "")


def year(text: Text) -> Column:
    return F.expr("1") * F.nullif(F.regexp_extract(col(text), r"(19|20)\d{2}", 0), F.lit("")).cast("int")


#: Date forms, tried in this order.
DATES = (r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{4}", r"(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}")


def publication_date(text: Text) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(col(text), p, 0), F.lit("")) for p in DATES])


def simplify_query(query: Text, stop_words: Sequence[str], most: int = 4) -> Column:
    kept = F.filter(words(F.lower(col(query))), lambda w: ~w.isin(*stop_words))
    return F.array_join(F.slice(kept, 1, most), " ")


def token_estimate(text: Text) -> Column:
    return F.floor(F.length(col(text)) / 4).cast("long")
