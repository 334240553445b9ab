"""Text of HTML pages: a regular expression path for well-formed markup, and a parser in an Arrow UDF."""

from __future__ import annotations

from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .text import Text, col, collapse

#: Elements without readable text.
SILENT = ("script", "style", "nav", "footer", "header", "aside")


def title(html: Text) -> Column:
    return F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def strip_tags(html: Text, silent: tuple[str, ...] = SILENT) -> Column:
    """Visible text by regular expressions; elements named in ``silent`` go with their content."""
    out = col(html)
    for tag in silent:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return collapse(F.regexp_replace(out, r"(?s)<[^>]+>", " "))


#: Elements dropped before an article is read; classes of divisions that hold content.
ARTICLE_SILENT = (*SILENT, "iframe", "noscript", "form", "button", "input")
CONTENT_CLASSES = ("content", "article", "post", "entry", "main", "body")
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div article main section li h1 h2 h3 td th br tr body title".split())


class _Page(HTMLParser):
    """Text pieces, and for each closed element its name, class and range of pieces, outside silent elements."""

    def __init__(self, silent: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.silent, self.depth = set(silent), 0
        self.pieces: list[str] = []
        self.open: list[tuple[str, str, int]] = []
        self.closed: list[tuple[int, int, str, str]] = []
        self.blocks: list[tuple[str, list[str]]] = [("", [])]
        self.meta: dict[str, str] = {}
        self.title: str | None = None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "meta":
            name = given.get("name") or given.get("property")
            if name and given.get("content"):
                self.meta.setdefault(name.lower(), given["content"])
        if tag in BLOCKS:
            self.blocks.append((tag, []))
        if tag in VOID:
            return
        self.depth += tag in self.silent
        self.open.append((tag, (given.get("class") or "").lower(), len(self.pieces)))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self._close() != tag:
                pass
        if tag in BLOCKS:
            self.blocks.append(("", []))

    def _close(self) -> str:
        tag, kind, start = self.open.pop()
        self.closed.append((start, len(self.pieces), tag, kind))
        self.depth -= tag in self.silent
        return tag

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "title" and self.title is None and not self.depth:
            self.title = " ".join(data.split())
        if not self.depth:
            self.pieces.append(data)
            self.blocks[-1][1].append(data)

    def elements(self, *tags: str) -> list[tuple[int, int, str, str]]:
        """Closed elements of these names, in the page's order (outer ones before inner ones)."""
        return sorted((e for e in self.closed if e[2] in tags), key=lambda e: (e[0], -e[1]))

    def words(self, element: tuple[int, int, str, str]) -> str:
        return " ".join(" ".join(self.pieces[element[0] : element[1]]).split())

    def inside(self, outer: tuple[int, int, str, str], *tags: str) -> list[tuple[int, int, str, str]]:
        return [e for e in self.elements(*tags) if outer[0] <= e[0] and e[1] <= outer[1] and e is not outer]


def _parse(html: str | None, silent: tuple[str, ...] = SILENT) -> _Page:
    page = _Page(silent)
    page.feed(html or "")
    page.close()
    while page.open:
        page._close()
    return page


def _lines(page: _Page) -> list[tuple[str, str]]:
    found = ((tag, " ".join("".join(parts).split())) for tag, parts in page.blocks if tag != "title")
    return [(tag, text) for tag, text in found if text]


def _main(page: _Page) -> str:
    """Articles and mains of over 200 characters; else such divisions of a content class; else
    paragraphs of over 50 characters."""
    for elements in (page.elements("article", "main"), [e for c in CONTENT_CLASSES for e in page.elements("div") if c in e[3]]):
        long = [text for text in map(page.words, elements) if len(text) > 200]
        if long:
            return " ".join(long)
    return " ".join(text for text in map(page.words, page.elements("p")) if len(text) > 50)


def _texts(page: _Page) -> tuple[str, str]:
    """The whole page's text; paragraphs of over 30 characters, or the whole where they are short."""
    lines = _lines(page)
    body = "\n\n".join(text for tag, text in lines if tag == "p" and len(text) > 30)
    whole = "\n".join(text for _, text in lines)
    return whole, body if len(body) >= 200 else whole


def _record(html: str | None, silent: tuple[str, ...]) -> dict:
    page = _parse(html, silent)
    whole, readable = _texts(page)
    tables = [[[page.words(c) for c in page.inside(r, "td", "th")] for r in page.inside(t, "tr")] for t in page.elements("table")[:3]]
    lists = [[page.words(i) for i in page.inside(x, "li")] for x in page.elements("ul", "ol")[:5]]
    return {
        "title": page.title, "text": whole, "readable": readable, "main": _main(page), "metadata": page.meta,
        "tables": [[r for r in t if r] for t in tables if any(t)], "lists": [x for x in lists if len(x) > 2],
    }


PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("readable", T.StringType()), T.StructField("main", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))), T.StructField("lists", T.ArrayType(T.ArrayType(T.StringType()))),
])


@lru_cache(maxsize=None)
def _reader(silent: tuple[str, ...]):
    @F.pandas_udf(PAGE)
    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_record(page, silent) for page in html], columns=PAGE.names)

    return read


@F.pandas_udf(T.StringType())
def _readable(html: pd.Series) -> pd.Series:
    return pd.Series([_texts(_parse(page))[1] for page in html], dtype=object)


def page(html: Text, silent: tuple[str, ...] = SILENT) -> Column:
    """All that is read from a page, as a struct, by one parse: a projection of several of its fields
    calls the parser once."""
    return _reader(tuple(silent))(col(html))


def page_text(html: Text) -> Column:
    return page(html)["text"]


def main_text(html: Text) -> Column:
    """Paragraphs of over 30 characters; where they are short, the whole page's text.  Nothing else of a page
    is built or kept in the worker."""
    return _readable(col(html))


def tables(html: Text) -> Column:
    """The first three tables as rows of cells."""
    return page(html)["tables"]


def lists(html: Text) -> Column:
    """Those of the first five lists that have over two items."""
    return page(html)["lists"]


def metadata(html: Text) -> Column:
    return page(html)["metadata"]


def content(html: Text) -> Column:
    """Page to content: success, content, title, author, publish_date, word_count, tables and lists."""
    read = page(html, (*SILENT, "iframe"))
    main, meta = read["main"], read["metadata"]
    found = F.length(main) > 0
    return F.struct(
        found.alias("success"), F.when(found, main).otherwise("").alias("content"), F.coalesce(read["title"], F.lit("")).alias("title"), author(meta).alias("author"), published(meta).alias("publish_date"),
        F.when(found, F.size(F.split(main, " "))).otherwise(0).alias("word_count"), ((F.size(read["tables"]) > 0) | (F.size(read["lists"]) > 0)).alias("has_structured_data"),
        read["tables"].alias("tables"), read["lists"].alias("lists"),
    )


def _first_of(meta: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(meta, F.lit(n))), F.lit("")) for n in names])


def author(meta: Column) -> Column:
    return _first_of(meta, "author", "article:author")


def published(meta: Column) -> Column:
    return _first_of(meta, "article:published_time", "pubdate", "date")


def article(html: Text, least: int = 200) -> Column:
    """Page to article: content, author, publication date, keywords, word count; null where the main
    content has under ``least`` characters."""
    read = page(html, ARTICLE_SILENT)
    main, meta = read["main"], read["metadata"]
    return F.when(F.length(main) >= least, F.struct(main.alias("content"), author(meta).alias("author"), published(meta).alias("publication_date"), _first_of(meta, "keywords").alias("keywords"), F.size(F.split(main, " ")).alias("word_count")))
