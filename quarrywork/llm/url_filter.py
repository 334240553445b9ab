"""URL filters: character language-model ratio with rules before it.

Two variable-order Markov models, of accepted and of rejected URLs, give each character (a byte of
the URL in UTF-8) the probability after its longest known context of up to ``ORDER`` characters,
interpolated with shorter contexts (Witten-Bell).  A URL's score is the difference of the two
log-likelihoods divided by its length; it is allowed when the score is at least a limit calibrated on
held-back training URLs, so that the two kinds of error are as even as they can be.

Contexts and characters are packed in one number each, so counting is sorting and scoring is a few
look-ups for all characters of a batch at once.

Rules decide first: a rule ``host/path`` fits its host and all subdomains where the URL's path begins
with the rule's; the longest wins.  Rules also label the training URLs.  The models count the
characters of all distinct labelled URLs, whole, as sums over packed numbers with map-side combining;
every fifth of them, in the order of a hash, is held back, and all of those are scored for the limit.
All of them count.  The driver collects and broadcasts ``EVENTS`` rows of a class and length of contexts
at most: beyond it the commoner contexts, from which the characters after them have their exact
probability.  Characters after other contexts meet the table of all counts in tasks, dealt by the last
two characters of the context, and their log-probabilities are summed as whole numbers, in any order.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is
judged by the models on its whole text (null: the empty text, whose score is 0); a null id is kept;
repeated rows get equal verdicts; without URLs of one class the limit allows all; an empty table
gives an empty result; further columns are ignored by ``judge`` and kept by ``accepted``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .keytable import KeyTable
from .scratch import Scratch, unused
from .wordhash import slices
from .worker import lean

ORDER = 5
#: Rows of a class's table of contexts of one length and the characters after them that is broadcast.
EVENTS = 1 << 18
#: Parts of 1 in which log-probabilities are summed; rows of counts and characters in a task, on average.
PARTS, TASK_ROWS = 1 << 36, 1 << 20
#: Distinct scores from which the limit is looked for in the driver; cells of a histogram of them.
SCORES, CELLS = 1 << 16, 4096
#: Marks before a URL's first character and behind its last one.
START, END = 2, 3
#: Fixed values: (allow, host, path).
RULES = (
    (True, "com", "/"), (False, "example.com", "/en/"), (True, "www.example.com", "/en/"), (False, "net", "/es/"), (False, "net", "/fr/"),
)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule(host_col: Column, path_col: Column, rules: Sequence[tuple[bool, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and whether it allows; null where none fits."""
    text, allow = None, None
    # The longest rule is asked first; equally long rules in their own order.
    for ok, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(start)
        text = F.when(fits, name + start) if text is None else text.when(fits, name + start)
        allow = F.when(fits, F.lit(ok)) if allow is None else allow.when(fits, F.lit(ok))
    return text, allow


def _packed(urls: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of all URLs and one end mark each: the last ``order`` characters before it as
    one number, the character, and the URL's row.  Before a URL's start stand start marks."""
    _, where, data = urls.buffers()
    ends = np.frombuffer(where, np.int32)[urls.offset : urls.offset + len(urls) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    size = np.diff(ends)
    padded = np.full(len(raw) + (order + 1) * len(urls), START, np.uint64)
    row = np.repeat(np.arange(len(urls)), size)
    padded[np.arange(len(raw)) + order * (row + 1) + row] = raw
    last = ends[1:] + (order + 1) * np.arange(1, len(urls) + 1) - 1
    padded[last] = END
    first = ends[:-1] + (order + 1) * np.arange(len(urls)) + order
    at = np.repeat(first - (ends[:-1] + np.arange(len(urls))), size + 1) + np.arange(len(raw) + len(urls))
    context = np.zeros(len(at), np.uint64)
    for k in range(order, 0, -1):
        context = context << np.uint64(8) | padded[at - k]
    return context, padded[at], np.repeat(np.arange(len(urls)), size + 1)


def _ending(events: np.ndarray, k: int) -> np.ndarray:
    """Contexts with a character -> their last ``k`` characters with it."""
    return events & np.uint64((1 << (8 * k + 8)) - 1)


def _strings(urls: Sequence[str] | pa.Array) -> pa.Array:
    return pc.fill_null(urls if isinstance(urls, pa.Array) else pa.array(urls, pa.string()), "")


class MarkovModel:
    """Probabilities of characters after contexts of 0 to ``order`` characters (6 at most)."""

    def __init__(self, urls: Sequence[str] | pa.Array = (), order: int = ORDER, counts: Sequence[tuple[np.ndarray, np.ndarray]] | None = None):
        """Of URLs, or of ``counts``: for each length of context, contexts with a character (sorted) and how
        often they occur; a context comes with all its characters, and with all shorter ones that end it."""
        self.order = order
        if counts is None:
            context, symbol, _ = _packed(_strings(urls), order)
            counts = [np.unique(_ending(context << np.uint64(8) | symbol, k), return_counts=True) for k in range(order + 1)]
        #: For each length of context: known contexts with the log of what they leave to shorter
        #: ones, and known contexts with a character, with the log of its probability.
        self.contexts, self.rest, self.events, self.log_p = [], [], [], []
        shorter = None
        for k, (events, n) in enumerate(counts):
            contexts, of = np.unique(events >> np.uint64(8), return_inverse=True)
            kinds, total = np.bincount(of, minlength=len(contexts)), np.bincount(of, n, len(contexts))
            # Every event is one of the context without its first character, too.
            below = 1 / 256 if shorter is None else shorter[1][np.searchsorted(shorter[0], events & np.uint64((1 << (8 * k)) - 1))]
            p = (n + kinds[of] * below) / (total + kinds)[of]
            shorter = events, p
            self.contexts.append(KeyTable(contexts)), self.rest.append(np.log(kinds / (total + kinds)))
            self.events.append(KeyTable(events)), self.log_p.append(np.log(p))

    def log_probability(self, context: np.ndarray, symbol: np.ndarray, longest: int | None = None) -> np.ndarray:
        """Of each character after its packed context (of ``longest`` characters)."""
        out = np.zeros(len(symbol))
        left = np.arange(len(symbol))
        for k in range(self.order if longest is None else longest, -1, -1):
            if not len(left):
                return out
            own = context[left] & np.uint64((1 << (8 * k)) - 1)
            at = self.events[k].find(own << np.uint64(8) | symbol[left])
            hit = at >= 0
            out[left[hit]] += self.log_p[k][at[hit]]
            left, own = left[~hit], own[~hit]
            at = self.contexts[k].find(own)
            known = at >= 0
            out[left[known]] += self.rest[k][at[known]]
        out[left] -= math.log(256)
        return out

    def probability(self, context: str, c: str) -> float:
        """Of one ASCII character after up to ``order`` others."""
        own = context[-self.order :].encode()
        packed = np.array([int.from_bytes(own, "big")], np.uint64)
        return float(np.exp(self.log_probability(packed, np.array([ord(c)], np.uint64), len(own)))[0])

    @property
    def known(self) -> dict[bytes, dict[str, float]]:
        """The known characters after each known context, and their probabilities (to look at)."""
        out: dict[bytes, dict[str, float]] = {}
        for k, (table, p) in enumerate(zip(self.events, self.log_p)):
            for key, q in zip(table.keys[:-1].tolist(), p.tolist()):
                out.setdefault((key >> 8).to_bytes(k, "big"), {})[chr(key & 255)] = math.exp(q)
        return out

    def log_likelihood(self, urls: Sequence[str] | pa.Array) -> np.ndarray:
        urls = _strings(urls)
        context, symbol, row = _packed(urls, self.order)
        return np.bincount(row, self.log_probability(context, symbol), len(urls))


class UrlModel:
    #: allow, event, n: all counts, where the models hold the commoner contexts only (``scores`` uses those alone).
    counts: DataFrame | None = None

    def __init__(self, accepted: Sequence[str], rejected: Sequence[str]):
        # Every fifth training URL is held back and sets the limit.
        self.good = MarkovModel([u for k, u in enumerate(accepted) if k % 5])
        self.bad = MarkovModel([u for k, u in enumerate(rejected) if k % 5])
        self.limit = -math.inf
        a, r = np.sort(self.scores(accepted[::5])), np.sort(self.scores(rejected[::5]))
        if len(a) and len(r):
            at = np.unique(np.concatenate([a, r]))
            lost, passed = np.searchsorted(a, at, side="left") / len(a), 1 - np.searchsorted(r, at, side="left") / len(r)
            self.limit = float(at[np.abs(lost - passed).argmin()])

    def score(self, url: str) -> float:
        return float(self.scores([url])[0])

    def scores(self, urls: Sequence[str] | pa.Array) -> np.ndarray:
        """Difference of the log-likelihoods by length; 0 for the empty URL."""
        urls = _strings(urls)
        size = pc.binary_length(urls).to_numpy(zero_copy_only=False).astype(np.float64)
        return np.where(size > 0, (self.good.log_likelihood(urls) - self.bad.log_likelihood(urls)) / np.maximum(size, 1), 0.0)


    @classmethod
    def of(cls, good: MarkovModel, bad: MarkovModel) -> "UrlModel":
        own = cls.__new__(cls)
        own.good, own.bad, own.limit = good, bad, -math.inf
        return own


def fit(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[bool, str, str]] = RULES) -> UrlModel:
    """The models of all distinct labelled URLs, and their limit."""
    tables = Scratch(pages.sparkSession, "urls")
    h, p = host(F.col(url_col)), path(F.col(url_col))
    allow = rule(h, p, rules)[1]
    named = pages.select(F.col(url_col).cast("string").alias("url"), allow.alias("allow")).where("allow IS NOT NULL").distinct()
    named = tables.table("named", named.withColumn("h", F.xxhash64("url")).withColumn("cell", F.shiftright("h", 48)))
    # The place in the order of the hash: 65,536 cells of it, and within a cell.
    cells = named.groupBy("allow", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("allow").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("allow", "cell").orderBy("h", "url")) - 1
    placed = named.withColumn("inside", inside).join(F.broadcast(cells.withColumn("before", before).drop("n")), ["allow", "cell"])
    placed = tables.table("placed", placed.select("allow", "url", (F.pmod(F.col("before") + F.col("inside"), F.lit(5)) == 0).alias("held")))
    counts = tables.table("counts", placed.where("NOT held").select("allow", "url").mapInArrow(_events, "allow boolean, event long, n long").groupBy("allow", "event").agg(F.sum("n").alias("n")))
    (good, all_good), (bad, all_bad) = (_kept(counts.where(F.col("allow") == kind), ORDER) for kind in (True, False))
    model = UrlModel.of(MarkovModel(counts=good), MarkovModel(counts=bad))
    model.counts = None if all_good and all_bad else counts
    scores = _scored(placed.where("held").select("allow", "url"), model, "url", "score").groupBy("score")
    scores = tables.table("scores", scores.agg(F.count_if("allow").alias("a"), F.count_if(~F.col("allow")).alias("r")))
    model.limit = _limit(scores)
    tables.drop("named", "placed", "scores", *(["counts"] if model.counts is None else []))
    return model


@lean
def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """allow, url -> allow, contexts of ``ORDER`` characters with the one behind, how often."""
    for batch in batches:
        urls = _strings(batch.column(1))
        for a, b, _, _ in slices(urls):
            context, symbol, row = _packed(urls.slice(a, b - a), ORDER)
            allow = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)[row]
            for kind in (True, False):
                events, n = np.unique((context << np.uint64(8) | symbol)[allow == kind], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(events), kind)), pa.array(events.view(np.int64)), pa.array(n.astype(np.int64))], names=["allow", "event", "n"])


def _kept(counts: DataFrame, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """What ``MarkovModel`` takes: per length of context at most ``EVENTS`` rows, of its commonest contexts; and
    whether these are all."""
    out, least = [], 0
    for k in range(order + 1):
        mask = (1 << (8 * k + 8)) - 1
        own = counts.groupBy(F.col("event").bitwiseAND(F.lit(mask)).alias("event")).agg(F.sum("n").alias("n"))
        context = F.shiftright("event", 8).alias("context")
        whole = own.groupBy(context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        # Rows by the logarithm of their context's count: 64 at most.
        levels = whole.groupBy(F.floor(F.log2("total")).cast("int").alias("level")).agg(F.sum("kinds").alias("kinds")).collect()
        while sum(r["kinds"] for r in levels if r["level"] >= least) > EVENTS:
            # What ends a kept context is at least as common, so it is kept, too.
            least += 1
        kept = own.withColumn("context", context)
        if least:
            kept = kept.join(whole.where(F.floor(F.log2("total")) >= least).select("context"), "context")
        found = kept.select("event", "n").toPandas()
        events, n = found["event"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.float64)
        at = np.argsort(events)
        out.append((events[at], n[at]))
    return out, not least


def _limit(scores: DataFrame) -> float:
    """The score (rows: score, how many accepted and rejected URLs have it) at which the shares of accepted
    URLs below and of rejected ones from it on are closest; their difference grows with the score."""
    whole = scores.agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if not whole.a or not whole.r:
        return -math.inf
    lo, hi, below, behind = whole.lo, whole.hi, np.zeros(2), (math.inf, math.inf)
    while True:
        inside = scores.where(F.col("score").between(lo, hi))
        if inside.count() <= SCORES:
            cells = inside.select(F.col("score").alias("least"), F.col("score").alias("most"), "a", "r")
        else:
            cell = F.floor((F.col("score") - lo) * (CELLS / (hi - lo)))
            cells = inside.groupBy(cell.alias("c")).agg(F.min("score").alias("least"), F.max("score").alias("most"), F.sum("a").alias("a"), F.sum("r").alias("r")).drop("c")
        rows = sorted(tuple(x) for x in cells.collect())
        least, most, a, r = (np.array(x, float) for x in zip(*rows))
        a, r = below[0] + np.cumsum(a) - a, below[1] + np.cumsum(r) - r
        gap = a / whole.a - (1 - r / whole.r)
        if (least == most).all():
            at = int(np.abs(gap).argmin())
            return min((abs(float(gap[at])), float(least[at])), behind)[1]
        # The sign changes within the last cell that begins below 0, or where the next one begins.
        at = max(0, int(np.searchsorted(gap, 0)) - 1)
        if at + 1 < len(least):
            behind = abs(float(gap[at + 1])), float(least[at + 1])
        lo, hi, below = float(least[at]), float(most[at]), np.array([a[at], r[at]])


def _scored(rows: DataFrame, model: UrlModel, url: str, out: str) -> DataFrame:
    """``rows`` with the models' score of the URL: one map, some thousand URLs at once, where the models hold all
    counts; else the distinct URLs are scored and joined."""
    shared = rows.sparkSession.sparkContext.broadcast(UrlModel.of(model.good, model.bad))
    if model.counts is not None:
        key, scores = unused(rows, "__qw_url"), _scored_by_join(rows, model.counts, shared, url)
        text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
        return rows.withColumn(key, text).join(scores.select(F.col("url").alias(key), F.col("score").alias(out)), key).drop(key)
    at = rows.columns.index(url)

    @lean
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A slice's arrays hold some 100 bytes a character.
            for a, b, _, _ in slices(_strings(batch.column(at))):
                part = batch.slice(a, b - a)
                yield part.append_column(out, pa.array(shared.value.scores(part.column(at)), pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(scores, f"{kinds}, `{out}` double")


def _scored_by_join(rows: DataFrame, counts: DataFrame, shared, url: str) -> DataFrame:
    """url, score: of the distinct URLs of ``rows``, by the models of all counts."""
    spark = rows.sparkSession
    tables = Scratch(spark, "scored")
    texts = rows.select(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url")).distinct()
    texts = tables.table("texts", texts.select(F.monotonically_increasing_id().alias("nr"), "url"))
    asked = tables.table("asked", texts.mapInArrow(lean(partial(_asked, shared=shared)), "nr long, allow boolean, event long, parts long"))
    events = asked.where("event IS NOT NULL").select("allow", "event").distinct()
    # Lengths 0 and 1 have 65,536 rows a class at most.
    short = counts.groupBy("allow", F.col("event").bitwiseAND(F.lit(0xFFFF)).alias("event")).agg(F.sum("n").alias("n")).toArrow()
    short = spark.sparkContext.broadcast({kind: _of_kind(short, kind) for kind in (True, False)})
    met = events.select("allow", "event", F.lit(None).cast("long").alias("n")).unionByName(counts.select("allow", "event", "n"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-met.count() // TASK_ROWS))
    met = met.repartition(tasks, F.shiftright("event", 8).bitwiseAND(F.lit(0xFFFF)))
    found = tables.table("found", met.mapInArrow(lean(partial(_met, short=short)), "allow boolean, event long, parts long"))
    parts = asked.where("event IS NOT NULL").drop("parts").join(found, ["allow", "event"]).select("nr", F.when(F.col("allow"), F.col("parts")).otherwise(-F.col("parts")).alias("parts"))
    parts = parts.unionByName(asked.where("event IS NULL").select("nr", "parts")).groupBy("nr").agg(F.sum("parts").alias("parts"))
    size = F.octet_length("url")
    score = F.when(size > 0, F.col("parts") / F.lit(float(PARTS)) / size).otherwise(F.lit(0.0))
    scores = tables.table("scores", texts.join(parts, "nr").select("url", score.alias("score")))
    tables.drop("texts", "asked", "found")
    return scores


def _of_kind(rows: pa.Table, kind: bool) -> tuple[np.ndarray, np.ndarray]:
    """Events and their counts (null: 0) of one class."""
    own = rows.filter(pc.equal(rows.column("allow"), kind))
    return own.column("event").to_numpy().view(np.uint64), pc.fill_null(own.column("n"), 0).to_numpy()


def _whole(log_p: np.ndarray) -> np.ndarray:
    return np.round(log_p * PARTS).astype(np.int64)


def _asked(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """nr, URL -> a row of each URL with the sum over the characters behind contexts that the models hold, and a
    row (allow, event) for each other character and class."""
    for batch in batches:
        for a, b, _, _ in slices(_strings(batch.column(1))):
            nr = batch.column(0).slice(a, b - a).to_numpy()
            context, symbol, row = _packed(_strings(batch.column(1).slice(a, b - a)), ORDER)
            total = np.zeros(len(nr), np.int64)
            for kind, sign, model in ((True, 1, shared.value.good), (False, -1, shared.value.bad)):
                known = model.contexts[ORDER].find(context) >= 0
                np.add.at(total, row[known], sign * _whole(model.log_probability(context[known], symbol[known])))
                events = (context << np.uint64(8) | symbol)[~known].view(np.int64)
                yield _rows(nr[row[~known]], np.full(len(events), kind), events, None)
            yield _rows(nr, None, None, total)


def _rows(nr: np.ndarray, allow: np.ndarray | None, event: np.ndarray | None, parts: np.ndarray | None) -> pa.RecordBatch:
    column = lambda x, kind: pa.nulls(len(nr), kind) if x is None else pa.array(x, kind)
    return pa.record_batch([pa.array(nr, pa.int64()), column(allow, pa.bool_()), column(event, pa.int64()), column(parts, pa.int64())], names=["nr", "allow", "event", "parts"])


def _met(batches: Iterator[pa.RecordBatch], short) -> Iterator[pa.RecordBatch]:
    """allow, event, n (null: asked) of the contexts that end with some two characters each -> the asked events with
    their log-probability."""
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    asked = pc.is_null(rows.column("n"))
    for kind in (True, False):
        events, _ = _of_kind(rows.filter(asked), kind)
        if not len(events):
            continue
        counts = []
        for k in range(ORDER + 1):
            own, n = short.value[kind] if k < 2 else _of_kind(rows.filter(pc.invert(asked)), kind)
            ends, of = np.unique(_ending(own, k), return_inverse=True)
            counts.append((ends, np.bincount(of, n, len(ends))))
        log_p = MarkovModel(counts=counts).log_probability(events >> np.uint64(8), events & np.uint64(255))
        yield pa.record_batch([pa.array(np.full(len(events), kind)), pa.array(events.view(np.int64)), pa.array(_whole(log_p))], names=["allow", "event", "parts"])


def judge(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[bool, str, str]] = RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the models' score."""
    rows = _scored(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")), model, "url", "score")
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    text, allow = rule(F.col("host"), F.col("path"), rules)
    allowed = F.coalesce(allow, F.col("score") >= F.lit(model.limit))
    return rows.select(F.col("id").alias(id_col), "host", "path", text.alias("rule"), F.when(allowed, "allow").otherwise("block").alias("verdict"), "score")


def accepted(pages: DataFrame, model: UrlModel, url_col: str = "url", rules: Sequence[tuple[bool, str, str]] = RULES) -> DataFrame:
    """The rows whose URL is allowed, with their own columns whatever their names."""
    score = unused(pages, "__qw_score")
    rows = _scored(pages, model, url_col, score)
    allow = rule(host(F.col(url_col)), path(F.col(url_col)), rules)[1]
    return rows.where(F.coalesce(allow, F.col(score) >= F.lit(model.limit))).drop(score)
