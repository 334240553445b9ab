"""URL scalars by regular expressions (``parse_url`` raises on the URLs found in the wild)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import Text, col


def normalize(url: Text) -> Column:
    """Lower case, trailing slashes off, ``www.`` off anywhere, then cut at the first ``?``."""
    return F.split_part(F.replace(F.regexp_replace(F.trim(F.lower(col(url))), "/+$", ""), F.lit("www."), F.lit("")), F.lit("?"), F.lit(1))


def scheme_host_path(url: Text) -> Column:
    """``scheme://netloc/path`` in lower case, without query and fragment."""
    u = F.lower(col(url))
    return F.concat(F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*)://", 1), F.lit("://"), netloc(u), path(u))


def netloc(url: Text) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Text) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def key(url: Text) -> Column:
    return F.regexp_replace(F.lower(col(url)), "/+$", "")


def is_pdf(url: Text) -> Column:
    """The path ends in ``.pdf`` or ``pdf`` occurs in query or fragment."""
    u = F.lower(col(url))
    rest = F.regexp_extract(u, r"^[^?#]*([?#].*)$", 1)
    return path(u).endswith(".pdf") | rest.contains("pdf")


def allowed_by_robots(url: Text, robots: Text, trusted: tuple[str, ...] = ()) -> Column:
    """Trusted hosts pass; else a robots text that disallows ``/pdf`` or this very path blocks."""
    ok = F.lit(False)
    for d in trusted:
        ok = ok | netloc(url).contains(d)
    text = F.coalesce(col(robots), F.lit(""))
    blocked = text.contains("Disallow: /pdf") | F.array_contains(F.split(text, "\n"), F.concat(F.lit("Disallow: "), path(url)))
    return ok | ~blocked
