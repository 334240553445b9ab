"""Citations: ids, extraction, validation, policy, bibliography, placement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import text as X
from ..session import cut
from . import ratio as R

#: Fixed value: ids such as ``[DB-1-2]``.
PATTERN = r"\[((?:DB|WEB)-\d+-\d+)\]"
#: Fixed value: ids of any kind.
ANY = r"\[([A-Z]+-\d+-\d+)\]"
ANY_WHOLE = r"\[[A-Z]+-\d+-\d+\]"


def citation_id(kind: Column, query: Column, result: Column) -> Column:
    return F.concat_ws("-", kind, query.cast("string"), result.cast("string"))


def extract(text: X.Text, pattern: str = PATTERN) -> Column:
    """All ids in order, repeats kept."""
    return F.regexp_extract_all(X.col(text), F.lit(pattern), F.lit(1))


def remove(text: X.Text, ids: Column) -> Column:
    return F.aggregate(ids, X.col(text), lambda t, i: F.replace(t, F.concat(F.lit("["), i, F.lit("]")), F.lit("")))


#: Marks of factual and of other sentences.
FACTUAL = (
    r"\b\d+(?:\.\d+)?%", r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:kg|ton|hectare|litre|meter|cm)", r"\b(?:study|research|report|survey|data|statistics)\b",
    r"\b(?:is|are|was|were|has|have|can|should|must)\b", r"\b(?:according to|based on|shows that|indicates that)\b",
)
OTHER = (r"^\s*#", r"^\s*\*\*", r"^\s*-\s", r"^\s*\d+\.", r"^\s*(?:References|Citations|Sources)")


def factual(sentences: Column) -> Column:
    def keep(s: Column) -> Column:
        skip, fact = F.lit(False), F.lit(False)
        for p in OTHER:
            skip = skip | s.rlike(f"(?i){p}")
        for p in FACTUAL:
            fact = fact | s.rlike(f"(?i){p}")
        n = X.word_count(s)
        return ~skip & (((n > 8) & fact) | (n > 15))

    return F.filter(sentences, keep)


def validate(answers: DataFrame, known: DataFrame, id_col: str = "answer_id", text_col: str = "text") -> DataFrame:
    """Per answer: valid, invalid (repeats kept), uncited facts (first five), coverage.

    ``known`` (answer_id, citation_id) is aggregated to one set an answer and joined by id.
    """
    sets = known.groupBy(id_col).agg(F.collect_set("citation_id").alias("__known"))
    out = answers.join(sets, id_col, "left").withColumn("__known", F.coalesce("__known", F.array().cast("array<string>")))
    out = out.withColumn("__ids", extract(text_col)).withColumn("__facts", factual(X.sentences_with_ends(text_col)))
    uncited = F.filter("__facts", lambda s: ~s.rlike(PATTERN))
    n = F.size("__facts")
    return out.select(
        id_col,
        F.filter("__ids", lambda i: F.array_contains("__known", i)).alias("valid"),
        F.filter("__ids", lambda i: ~F.array_contains("__known", i)).alias("invalid"),
        F.size("__ids").cast("long").alias("n_citations"),
        F.slice(uncited, 1, 5).alias("uncited"),
        F.when(n == 0, 1.0).otherwise((n - F.size(uncited)) / n).alias("coverage"),
    )


def policy(coverage: X.Text, n_citations: X.Text) -> Column:
    """What happens to an answer: strip invalid ids, add a note, or write it anew."""
    return F.when(X.col(n_citations) == 0, "regenerate").when(X.col(coverage) > 0.8, "strip").when(X.col(coverage) > 0.5, "annotate").otherwise("regenerate")


def report(answers: DataFrame, known: DataFrame, id_col: str = "answer_id", text_col: str = "text", often: int = 5) -> DataFrame:
    """Per answer: citations, those that are known, the unknown ones with their places (from 0), and ids
    that it uses more than ``often`` times."""
    sets = known.groupBy(id_col).agg(F.collect_set("citation_id").alias("__known"))
    out = answers.join(sets, id_col, "left").withColumn("__known", F.coalesce("__known", F.array().cast("array<string>")))
    out = out.withColumn("__ids", F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(1))).withColumn("__parts", F.split(F.col(text_col), ANY_WHOLE, -1))
    # An id's place: the lengths of the text parts and of the marks before it.
    before = lambda i: F.aggregate(F.slice("__parts", F.lit(1), i + 1), F.lit(0), lambda n, p: n + F.length(p)) + F.aggregate(F.slice("__ids", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x) + 2)
    placed = F.transform("__ids", lambda x, i: F.struct(x.alias("citation_id"), before(i).alias("position")))
    unknown = F.filter(placed, lambda x: ~F.array_contains("__known", x["citation_id"]))
    count = lambda x: F.size(F.filter("__ids", lambda y: y == x))
    return out.select(
        id_col, F.size("__ids").alias("total_citations"), (F.size("__ids") - F.size(unknown)).alias("valid_citations"), unknown.alias("missing_sources"),
        F.filter(F.array_distinct("__ids"), lambda x: count(x) > often).alias("excessive"), (F.size(unknown) == 0).alias("valid"),
    )


def usage(answers: DataFrame, id_col: str = "answer_id", text_col: str = "text") -> DataFrame:
    """citation_id, uses: how often each id occurs over all answers."""
    return answers.select(F.explode(extract(text_col)).alias("citation_id")).groupBy("citation_id").agg(F.count(F.lit(1)).alias("uses"))


def bibliography(sources: DataFrame, used: DataFrame, used_only: bool = True) -> DataFrame:
    """One line a source: ``[id] title - url (cited n times)``."""
    joined = sources.join(used, "citation_id", "inner" if used_only else "left")
    uses = F.coalesce("uses", F.lit(0))
    line = F.format_string("[%s] %s - %s (cited %d times)", "citation_id", "title", "url", uses)
    return joined.select("citation_id", uses.cast("long").alias("uses"), line.alias("line"))


STYLES = {"inline": (" ", ""), "superscript": ("<sup>", "</sup>"), "footnote": ("^", "")}


def format_ids(ids: Column, style: str = "inline") -> Column:
    before, after = STYLES[style]
    return F.when(F.size(ids) == 0, "").otherwise(F.concat(F.lit(before), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("["), i, F.lit("]"))), ""), F.lit(after)))


@F.pandas_udf(T.StringType())
def place(text: pd.Series, sentences: pd.Series, marks: pd.Series) -> pd.Series:
    """Puts each sentence's mark after it, from the last to the first."""

    def one(t, parts, found):
        at, spots = 0, []
        for s, m in zip(parts, found):
            k = (t or "").find(s, at)
            if k >= 0:
                at = k + len(s)
                spots.append((at, m))
        for k, m in reversed(spots):
            t = t[:k] + (m or "") + t[k:]
        return t

    return pd.Series([one(*row) for row in zip(text, sentences, marks)])


def numbered(rows: DataFrame, group: str, order: str, line: Column, out: str = "lines") -> DataFrame:
    """``[n] line`` for each row of a group, in order, as one text."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    numbered = F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["l"]))
    return rows.groupBy(group).agg(F.array_join(numbered, "\n").alias(out))


def preview(text: X.Text, most: int = 200) -> Column:
    t = X.col(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def flattened(database: DataFrame, web: DataFrame, *group: str) -> DataFrame:
    """Citations of all sub-queries' results, in order of sub-query, source and rank, of each ``group``.

    ``database``: sub, rank, title, source, text, score; ``web``: sub, rank, title, url, snippet,
    content, score (sub and rank from 0).  Without a title, a chunk is named by its source; a web hit
    without content is its snippet.
    """
    ids = lambda kind: citation_id(F.lit(kind), F.col("sub") + 1, F.col("rank") + 1)
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("source"))
    own = database.select(*group, "sub", "rank", F.lit("database").alias("type"), ids("DB").alias("citation_id"), title.alias("title"), F.col("source").alias("url"), preview("text").alias("content_preview"), F.col("score").cast("double").alias("score"), F.col("text").alias("full_content"))
    full = F.coalesce(F.nullif("content", F.lit("")), F.col("snippet"))
    hits = web.select(*group, "sub", "rank", F.lit("web").alias("type"), ids("WEB").alias("citation_id"), "title", "url", preview("snippet").alias("content_preview"), F.col("score").cast("double").alias("score"), full.alias("full_content"))
    return own.unionByName(hits).withColumn("ord", F.struct("sub", "type", "rank"))


def content_map(citations: DataFrame) -> DataFrame:
    """content_hash, citation_id: of citations with equal content the last one in order."""
    return citations.groupBy(F.md5("full_content").alias("content_hash")).agg(F.max_by("citation_id", "ord").alias("citation_id"))


def hit_lines(hits: DataFrame, group: str, order: str = "rank") -> DataFrame:
    """Per group the numbered citations (``[i] title. domain. url``) and the context block for a model."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("title"), F.col("domain"), F.col("url"), F.col("snippet"))))
    number = lambda i: (i + 1).cast("string")
    cited = F.transform(items, lambda x, i: F.concat(F.lit("["), number(i), F.lit("] "), x["title"], F.lit(". "), x["domain"], F.lit(". "), x["url"]))
    block = F.transform(items, lambda x, i: F.concat(number(i), F.lit(". **"), x["title"], F.lit("**\n   Source: "), x["url"], F.lit("\n   Domain: "), x["domain"], F.lit("\n   Content: "), x["snippet"], F.lit("\n\n")))
    return hits.groupBy(group).agg(F.array_join(cited, "\n").alias("citations"), F.concat(F.lit("Web Search Results:\n\n"), F.array_join(block, "")).alias("context"))


def merged(responses: DataFrame, group: str, agent: str = "ord", compat: bool = False) -> DataFrame:
    """Answers of several agents (group, ord, success, citations, execution_time) as one: citations in
    order of agent and place, each once by its whole text, numbered anew; total time of the successes.

    ``compat`` takes four characters off as the old number, which is one too few from ``[10]`` on.
    """
    good = responses.where("success")
    each = good.select(group, agent, F.posexplode("citations").alias("pos", "citation"))
    first = each.groupBy(group, "citation").agg(F.min(F.struct(agent, "pos")).alias("at"))
    bare = lambda x: F.substring(x, 5, 1 << 30) if compat else F.regexp_replace(x, r"^\[\d+\] ", "")
    items = F.array_sort(F.collect_list(F.struct("at", "citation")))
    lines = F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), bare(x["citation"])))
    listed = first.groupBy(group).agg(lines.alias("citations"))
    time = F.round(F.sum(F.when(F.col("success"), F.col("execution_time")).cast("decimal(20,6)")).cast("double"), 6)
    totals = responses.groupBy(group).agg(F.count_if("success").alias("agent_count"), F.count_if(~F.col("success")).alias("failed_agents"), F.coalesce(time, F.lit(0.0)).alias("total_time"))
    return totals.join(listed, group, "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<string>"))).withColumn("success", F.col("agent_count") > 0)


def as_strings(citations: X.Text) -> Column:
    """``title - url``, the URL alone, or the raw string of citations (title, url, link, raw); those that
    have neither URL nor raw string are dropped."""
    def one(c: Column) -> Column:
        url = F.coalesce(F.nullif(c["url"], F.lit("")), F.nullif(c["link"], F.lit("")))
        return F.when(c["raw"].isNotNull(), c["raw"]).when(url.isNotNull(), F.when(F.coalesce(c["title"], F.lit("")) != "", F.concat(c["title"], F.lit(" - "), url)).otherwise(url))

    return F.array_compact(F.transform(X.col(citations), one))


def rendered(questions: DataFrame, citations: DataFrame, group: str = "item_id", question: str = "text") -> DataFrame:
    """One report a question: its sections by sub-query (from 1) with numbered previews, an index of all
    citations in order of id, and the counts of both kinds.

    ``citations``: group, sub, type, rank, citation_id, title, url, content_preview.  A question without
    any gets the heading and zeros.
    """
    ordered = lambda *by: F.array_sort(F.collect_list(F.struct(*by, "citation_id", "title", "url", "content_preview")))
    entry = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". **"), x["title"], F.lit("** ["), x["citation_id"], F.lit("]\n   "), x["content_preview"])
    sections = citations.groupBy(group, "sub").agg(F.array_join(F.transform(ordered("type", "rank"), entry), "\n").alias("lines"))
    sections = sections.withColumn("section", F.concat(F.lit("## Sub-query "), (F.col("sub") + 1).cast("string"), F.lit("\n\n"), "lines"))
    body = sections.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "section"))), lambda x: x["section"]), "\n\n").alias("body"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("citation_id", "title", "url"))), lambda x: F.concat(F.lit("- ["), x["citation_id"], F.lit("] "), x["title"], F.lit(" - "), x["url"]))
    index = citations.groupBy(group).agg(F.array_join(listed, "\n").alias("index"), F.count_if(F.col("type") == "database").alias("n_db"), F.count_if(F.col("type") == "web").alias("n_web"))
    out = questions.select(group, F.col(question).alias("__q")).join(body, group, "left").join(index, group, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(head), F.col(c))).otherwise("")
    return out.select(group, F.concat(F.lit("# "), F.coalesce("__q", F.lit("")), part("\n\n", "body"), part("\n\n## Citations\n\n", "index"), F.lit("\n\nDatabase: "), n("n_db"), F.lit(", web: "), n("n_web")).alias("report"))


#: Fixed value: what is added to an answer with uncited facts.
NOTE = "\n\n**Note:** Some statements in this answer may benefit from additional citations. Please refer to the complete research report for detailed source information."


def with_note(text: X.Text, uncited: Column, available: Column) -> Column:
    return F.when((F.size(uncited) > 0) & (F.size(available) > 0), F.concat(X.col(text), F.lit(NOTE))).otherwise(X.col(text))


def reference_list(available: X.Text, most: int = 20) -> Column:
    """The first ``most`` citations (citation_id, title, source) in order of id, one a line, and how many more."""
    ordered = F.array_sort(F.transform(X.col(available), lambda c: F.struct(c["citation_id"].alias("i"), F.coalesce(c["title"], F.lit("Unknown")).alias("t"), F.coalesce(c["source"], F.lit("unknown")).alias("s"))))
    lines = F.transform(F.slice(ordered, 1, most), lambda c: F.concat(F.lit("   ["), c["i"], F.lit("] - "), F.substring(c["t"], 1, 80), F.lit(" ("), c["s"], F.lit(")")))
    more = F.size(ordered) - most
    extra = F.when(more > 0, F.array(F.concat(F.lit("   ... and "), more.cast("string"), F.lit(" more citations available")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lines, extra), "\n")


def source_sentences(sources: DataFrame, text: str = "content") -> DataFrame:
    """citation_id, pos, sentence of all sources."""
    return sources.select("citation_id", F.posexplode(X.sentences(text)).alias("pos", "sentence"))


def places(text: X.Text, sentences: Column) -> Column:
    """For each sentence the place (from 0) at which it begins, searched from the end of the one before;
    -1 where it is not found, which moves nothing."""
    t = X.col(text)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, s: Column) -> Column:
        k = F.call_function("locate", s, t, acc["at"])
        return F.struct(F.when(k > 0, k + F.length(s)).otherwise(acc["at"]).alias("at"), F.array_append(acc["found"], k - 1).alias("found"))

    return F.aggregate(sentences, start, step, lambda acc: acc["found"])


def matching_texts(sentences: DataFrame, sources: DataFrame, threshold: float = 0.75, most: int = 3) -> DataFrame:
    """Sentences (sent_id, sentence) against source sentences (citation_id, sentence) by text alone: the
    best ratio of each source, at least ``threshold``, three sources a sentence.

    Distinct texts meet in the exact ratio join of ``operators.ratio``.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    found = cut(R.similar(sentences.select(F.col("sentence").alias("text")), sources.select(F.col("sentence").alias("text")), threshold))
    asked = sentences.select("sent_id", low("sentence").alias("left")).distinct()
    known = sources.select("citation_id", low("sentence").alias("right")).distinct()
    best = asked.join(found, "left").join(known, "right").groupBy("sent_id", "citation_id").agg(F.max("similarity").alias("similarity"))
    w = W.partitionBy("sent_id").orderBy(F.desc("similarity"), "citation_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
