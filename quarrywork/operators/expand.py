"""Query expansion, agents, assignment and templates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import lexicon as L
from ..functions import text as X
from ..session import cut, ship_package

#: Words that call for one more query, in this order.
CONTEXT = (
    (("disease", "pest", "infection"), "plant pathology treatment"), (("price", "cost", "market", "economic"), "agricultural economics market analysis"),
    (("climate", "weather", "rain"), "climate agriculture impact"),
)


def expanded(query: X.Text) -> Column:
    """The query, two general forms and at most one for its context."""
    q = X.col(query)
    context = None
    for terms, suffix in CONTEXT:
        hit = F.concat(q, F.lit(f" {suffix}"))
        context = (F if context is None else context).when(X.contains_any(F.lower(q), terms), hit)
    return F.array_compact(F.array(q, F.concat(q, F.lit(" agriculture")), F.concat(q, F.lit(" farming")), context))


def variants(query: X.Text, most: int = 2) -> Column:
    q = X.col(query)
    plain = ~X.contains_any(F.lower(q), ("agriculture", "farming"))
    add = lambda suffix: F.concat(q, F.lit(f" {suffix}"))
    return F.slice(F.array_compact(F.array(q, F.when(plain, add("agriculture")), F.when(plain, add("farming India")), add("best practices"))), 1, most)


def agents(spark: SparkSession, rows: Sequence[tuple[str, str, str]] = L.AGENTS) -> DataFrame:
    """ord, agent, focus, expertise: a constant relation."""
    literal = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("agent"), F.lit(f).alias("focus"), F.lit(e).alias("expertise")) for i, (a, f, e) in enumerate(rows)])
    return spark.range(1).select(F.explode(literal).alias("a")).select("a.*")


def agent_score(query: Column, focus: str, expertise: str) -> Column:
    low = F.lower(query)
    hits = lambda phrases: sum((F.when(low.contains(p.strip().lower()), 1).otherwise(0) for p in phrases.split(",")), F.lit(0))
    return hits(focus) * 2 + hits(expertise)


def best_agent(query: X.Text, rows: Sequence[tuple[str, str, str]] = L.AGENTS) -> Column:
    """Most phrase hits (focus counts double); the first wins ties; null without a hit."""
    scored = F.array(*[F.struct(agent_score(X.col(query), f, e).alias("s"), F.lit(-i).alias("o"), F.lit(a).alias("agent")) for i, (a, f, e) in enumerate(rows)])
    top = F.array_max(scored)
    return F.when(top["s"] > 0, top["agent"])


def block_of(index: Column, total: int, blocks: int) -> Column:
    """Contiguous blocks of ``total // blocks``; the last takes the remainder."""
    return F.least(F.floor(index / max(1, total // blocks)), F.lit(blocks - 1)).cast("long")


def round_robin(index: Column, groups: int) -> Column:
    return F.pmod(index, F.lit(groups)).cast("long")


def with_agent_context(query: X.Text, agent: X.Text, rows: Sequence[tuple[str, str, str]] = L.AGENTS) -> Column:
    """The query followed by its agent's focus and expertise; the query alone without an agent."""
    out = X.col(query)
    for name, focus, expertise in rows:
        out = F.when(X.col(agent) == name, F.concat_ws(" ", X.col(query), F.lit(focus), F.lit(expertise))).otherwise(out)
    return out


def routed(queries: DataFrame, text: str, rows: Sequence[tuple[str, str, str]] = L.AGENTS) -> DataFrame:
    """Sub-queries with their best agent (null where none fits) and the query as that agent asks it."""
    return queries.withColumn("agent", best_agent(text, rows)).withColumn("agent_query", with_agent_context(text, "agent", rows))


def specialised(query: X.Text, specialisation: X.Text, terms: dict[str, str] = L.SPECIAL_TERMS) -> Column:
    """The query with its specialisation's terms behind it (none: a space)."""
    found = F.lit("")
    for name, more in terms.items():
        found = F.when(X.col(specialisation) == name, more).otherwise(found)
    return F.concat(X.col(query), F.lit(" "), found)


def with_picked_word(query: X.Text, specialisation: X.Text, words: dict[str, Sequence[str]] = L.SPECIAL_WORDS, seed: int = 1) -> Column:
    """One word of the specialisation behind the query, picked by a digest of the query, unless the query
    has it in any case; "agriculture" for an unknown specialisation."""
    q = X.col(query)
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), q)), 1, 8), 16, 10).cast("long")
    word = F.lit("agriculture")
    for name, own in words.items():
        pick = F.element_at(F.array(*[F.lit(w) for w in own]), (F.pmod(digest, F.lit(len(own))) + 1).cast("int"))
        word = F.when(X.col(specialisation) == name, pick).otherwise(word)
    return F.when(F.contains(F.lower(q), F.lower(word)), q).otherwise(F.concat_ws(" ", q, word))


def or_fallback(generated_queries: X.Text, area: X.Text, specialisation: X.Text, place: X.Text, seed: int = 1) -> Column:
    """One of a model's first five queries, picked by a digest; without any, ``area specialisation place``."""
    some = F.slice(F.filter(X.col(generated_queries), lambda x: F.trim(x) != ""), 1, 5)
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.array_join(some, "|"))), 1, 8), 16, 10).cast("long")
    own = F.concat_ws(" ", X.col(area), X.col(specialisation), X.col(place))
    return F.when(F.size(some) > 0, F.element_at(some, (F.pmod(digest, F.greatest(F.size(some), F.lit(1))) + 1).cast("int"))).otherwise(own)


def prompt(template: str, *values: Column) -> Column:
    """A template with ``%s`` for each value."""
    return F.format_string(template, *values)


def expansion_prompt(queries: X.Text, most: int = 10) -> Column:
    """What a model is asked to expand: the first ``most`` queries, one a line."""
    return prompt("Base queries:\n%s\nWrite one new search query a line.", F.array_join(F.transform(F.slice(X.col(queries), 1, most), lambda q: F.concat(F.lit("- "), q)), "\n"))


def extraction_prompt(title: X.Text, content: X.Text, most: int = 3000) -> Column:
    """What a model is asked to extract from: the title and the content's first ``most`` characters."""
    return prompt("Title: %s\nContent: %s\nAnswer with one JSON object.", F.coalesce(X.col(title), F.lit("")), F.substring(F.coalesce(X.col(content), F.lit("")), 1, most))


#: Queries that a task places at a time.
BLOCK = 1 << 16


def placed(masks: Sequence[int], load: list[int]) -> list[int]:
    """The agent of each query in order: the least loaded of those in its mask, the first of equals.  ``load``
    goes on."""
    options: dict[int, list[int]] = {}
    out = []
    for m in masks:
        own = options.get(m)
        if own is None:
            own = options[m] = [i for i in range(len(load)) if m >> i & 1]
        pick = own[0] if len(own) == 1 else min(own, key=load.__getitem__)
        load[pick] += 1
        out.append(pick)
    return out


def _loads(blocks: DataFrame, n: int, agents: int) -> list[list[int]]:
    """The load before each block (block, masks), as if one loop went over all.

    What a block adds depends on the differences between loads only.  All blocks are placed side by side
    from guessed loads, then again those whose load to begin with has turned out otherwise, until none has.
    The first wrong block is right after a round, so this ends; as greedy placing evens out differences,
    two or three rounds mostly do.  The driver holds one short list a block.
    """
    starts, added, used = [[0] * agents for _ in range(n)], [[0] * agents for _ in range(n)], [None] * n
    while True:
        for k in range(1, n):
            starts[k] = [x + y for x, y in zip(starts[k - 1], added[k - 1])]
        level = [tuple(x - min(s) for x in s) for s in starts]
        open_ = [k for k in range(n) if used[k] != level[k]]
        if not open_:
            return starts
        asked = {k: list(level[k]) for k in open_}

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [(b, m) for b, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if b in asked]
                done = []
                for b, masks in keep:
                    load = list(asked[b])
                    placed(masks, load)
                    done.append([x - y for x, y in zip(load, asked[b])])
                yield pa.record_batch([pa.array([b for b, _ in keep], pa.int64()), pa.array(done, pa.list_(pa.int64()))], names=["block", "added"])

        for r in blocks.mapInArrow(place, "block long, added array<long>").collect():
            added[r.block], used[r.block] = list(r.added), level[r.block]


def assigned(queries: DataFrame, order: str, text: str, batch: str | None = None, rows: Sequence[tuple[str, str, str]] = L.AGENTS) -> DataFrame:
    """Greedy assignment in order: most hits, then the least loaded agent; no hit: least loaded of all.

    The load runs over all queries, or starts anew in each job where ``batch`` names its column.  Of a query
    only the set of its best agents matters, one number; blocks of ``BLOCK`` of them are placed side by side
    (``_loads``), so no task sees all queries.  Jobs are read as streams, one task a job.  Queries that are
    equal in ``order`` have some fixed order.
    """
    ship_package(queries.sparkSession)
    names = [a for a, _, _ in rows]
    scores = F.array(*[agent_score(F.col(text), f, e) for _, f, e in rows])
    best = F.array_max("__s")
    mask = F.aggregate(F.transform("__s", lambda x, i: F.when((x == best) | (best == 0), F.lit(2).cast("double") ** i).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    scored = queries.withColumn("__s", scores).withColumn("__mask", mask.cast("long")).drop("__s")
    if batch:
        return _by_job(queries, scored, order, batch, names)
    # Order values are dealt in ranges by their rank: counts of ranges first, then ranks inside them.
    lined = scored.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id())
    lined = cut(lined.withColumn("__p", F.shiftright("__id", 33)))
    sizes = lined.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = lined.join(F.broadcast(sizes.select("__p", (before - F.col("__first")).alias("__shift"))), "__p")
    ranked = ranked.withColumn("__rank", F.col("__id") + F.col("__shift")).drop("__p", "__id", "__shift")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("__rank").alias("r"), F.col("__mask").alias("m"))))
    blocks = cut(ranked.groupBy(F.floor(F.col("__rank") / BLOCK).alias("block")).agg(pairs.alias("l")).select("block", F.transform("l", lambda x: x["m"]).alias("masks")))
    last = blocks.agg(F.max("block").alias("last")).first().last
    starts = _loads(blocks, 0 if last is None else last + 1, len(names))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chosen = [names[i] for i in placed(masks, list(starts[b]))]
                yield pa.record_batch([pa.array(range(b * BLOCK, b * BLOCK + len(masks)), pa.int64()), pa.array(chosen, pa.string())], names=["__rank", "agent"])

    chosen = blocks.mapInArrow(choose, "__rank long, agent string")
    return ranked.join(chosen, "__rank").select(*[F.col(f"`{c}`") for c in queries.columns], "agent")


def _by_job(queries: DataFrame, scored: DataFrame, order: str, batch: str, names: list[str]) -> DataFrame:
    """Each job's queries in order, as a stream."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, load = object(), []
        for pdf in batches:
            chosen = []
            for job, mask in zip(pdf["__b"], pdf["__mask"]):
                if job != now:
                    now, load = job, [0] * len(names)
                chosen.append(names[placed([mask], load)[0]])
            yield pdf.assign(agent=chosen).drop(columns=["__mask", "__b"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    scored = scored.withColumn("__b", F.coalesce(F.concat(F.lit("="), F.col(batch).cast("string")), F.lit("")))
    return scored.repartition("__b").sortWithinPartitions("__b", order).mapInPandas(place, f"{kinds}, agent string")


def generated(spark: SparkSession, n: int, areas: Sequence[str], contexts: Sequence[str], modifiers: Sequence[str], seed: int = 1) -> DataFrame:
    """``n`` template queries by seeded digest picks, distinct, in order: id, query."""
    def pick(terms: Sequence[str], salt: int) -> Column:
        digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), F.lit(str(salt)))), 1, 8), 16, 10).cast("long")
        return F.element_at(F.array(*[F.lit(t) for t in terms]), (F.pmod(digest, F.lit(len(terms))) + 1).cast("int"))

    rows = spark.range(4 * n).select("id", F.concat_ws(" ", pick(modifiers, 1), pick(areas, 2), pick(contexts, 3)).alias("query"))
    return rows.groupBy("query").agg(F.min("id").alias("id")).orderBy("id").limit(n).select("id", "query")


#: Beginnings of lines that are no queries, in lower case.
CHATTY = ("here are", "here is", "sure", "certainly", "of course", "below are", "i can", "note:")
PLACEHOLDER = r"(?i)\[[^\]]*\]|<[^>]*>|\bquery \d+\b|\.\.\."


def query_list(spark: SparkSession, queries: Sequence[str], most: int | None = None) -> DataFrame:
    """ord, query: a constant list of queries, the first ``most`` of it (none or 0: all)."""
    literal = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(q).alias("query")) for i, q in enumerate(queries[: most or None])])
    return spark.range(1).select(F.explode(literal).alias("q")).select("q.*")


def parsed_list(output: X.Text, least: int = 10, most: int = 10) -> Column:
    """Lines of a numbered or bulleted list without their marks, longer than ``least`` characters.

    Placeholders and chatty lines are skipped.  Without any such line, all lines are taken that end in a
    question mark; without these, all longer lines.
    """
    lines = F.transform(F.split(X.col(output), "\n"), lambda x: F.trim(x))
    good = lambda x: (F.length(x) > least) & ~x.rlike(PLACEHOLDER) & ~_starts(F.lower(x), CHATTY)
    marked = F.filter(lines, lambda x: x.rlike(r"^(?:\d+[.)]|[-*•])\s"))
    first = F.filter(F.transform(marked, lambda x: F.trim(F.regexp_replace(x, r"^(?:\d+[.)]|[-*•])\s+", ""))), good)
    asked = F.filter(lines, lambda x: x.endswith("?") & good(x))
    rest = F.filter(lines, good)
    return F.slice(F.when(F.size(first) > 0, first).when(F.size(asked) > 0, asked).otherwise(rest), 1, most)


def _starts(x: Column, beginnings: Sequence[str]) -> Column:
    out = F.lit(False)
    for b in beginnings:
        out = out | x.startswith(b)
    return out


def focused(query: X.Text, focus: X.Text, run_year: int) -> Column:
    """Query rewriting by focus area, with the clock as a parameter."""
    q, f = X.col(query), X.col(focus)
    return (
        F.when(f == "news", F.concat(q, F.lit(f" latest news {run_year}"))).when(f == "academic", F.concat(q, F.lit(" research paper study")))
        .when(f == "technical", F.concat(q, F.lit(" technical documentation"))).when(f == "recent", F.concat(q, F.lit(f" {run_year}"))).otherwise(q)
    )
