"""LM scoring by masked pseudo-likelihood.

A bidirectional window network sees ``WINDOW`` words on each side of a masked word and predicts it:
embeddings of the context words, scaled by place and summed, go through one hidden layer to a
softmax over ``CLASSES`` classes and, given the class, one over the class's ``PER_CLASS`` outputs.  The
commonest ``OWN`` words are outputs themselves; all others share ``BUCKETS`` hashed outputs, within
which a word has its relative frequency in the corpus.  A document's score is the sum of the
conditional log-probabilities of all its words, each predicted from both sides.

What is gathered grows with the input.  Word counts come from all documents, as sums over hashes with
map-side combining, and stay a table: the counts of the ``KEPT`` commonest words are broadcast, a
document's other words, each once with its number, meet the table in a join by hash, so that every
word has its own count whatever the size of the vocabulary (``KEPT`` moves words between these two
ways and changes no score).  Training masks every place of every document, at every size of corpus: in each round
where one trainer holds the corpus, else once, as each round takes a part of it.  Outputs are written in stretches of ``SPAN`` words, with the ``WINDOW`` words before and after, which hold
the windows of all their places.  Stretches are dealt over trainers, one for each ``SHARE`` words (``TRAINERS`` at most,
which then have more), each of which runs minibatch Adagrad in numpy over all its own, a bounded batch at a time; after a round the trainers'
parameters are averaged, by ranges of parameters on the executors, and the next round starts from the
average.  The driver holds the parameters (some 270,000 numbers), never stretches.

The network's size is fixed, so every word is scored by the same arithmetic at every size of corpus.

Defined cases: null and empty texts have no words, score 0 and mean null; a text of one word is
predicted from boundaries alone; null ids are kept; repeated rows count, train and score each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .keytable import KeyTable
from .scratch import Scratch
from .worker import keep_memory, lean
from .wordhash import slices, words

WINDOW, HIDDEN = 3, 32
CLASSES, PER_CLASS = 64, 64
OUTPUTS, BUCKETS = CLASSES * PER_CLASS, PER_CLASS  # the last class holds the buckets
OWN = OUTPUTS - BUCKETS
EDGE = OUTPUTS  # what stands outside a text
KEPT = 1 << 16
#: Words that a trainer has in a round; trainers at most; rounds of averaging; words in a batch at least and at most.
SHARE, TRAINERS, ROUNDS, BATCH, LARGEST = 1 << 21, 4096, 2, 1024, 1 << 13
#: Batches of a round below which a trainer goes over its words again, and how often at most; batches of a round.
STEPS, PASSES, ENOUGH = 150, 4, 256
#: Rate of the first round, and what is left of it in each further one.
RATE, DECAY = 0.2, 0.4
#: Words of a stretch; stretches in a row of their table; stretches that are scored at once, that a trainer holds; parameters in a row.
SPAN, RUN, SCORED, HELD, CHUNK = 64, 512, 128, 1 << 15, 1 << 12
#: Log-counts are summed as multiples of 1 / FINE, so that sums do not depend on their order.
FINE = 1e9
_PLACES = tuple(k for k in range(-WINDOW, WINDOW + 1) if k)


@dataclass
class Vocabulary:
    """Frequent words by hash, their outputs and log relative frequency within them; for each output its
    count, and what any other word has: minus the log of that count, to which the log of the word's own
    count is added."""

    hashes: np.ndarray
    outputs: np.ndarray
    within: np.ndarray
    whole: np.ndarray

    def __post_init__(self):
        self.table, self.rest = KeyTable(self.hashes), -np.log(np.maximum(self.whole, 1))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Output, log relative frequency (without a rare word's log count), and which are rare."""
        at = self.table.find(h)
        rare = at < 0
        output = OWN + (h % np.uint64(BUCKETS)).astype(np.int64)
        within = self.rest[output]
        output[~rare], within[~rare] = self.outputs[at[~rare]], self.within[at[~rare]]
        return output, within, rare


@lean
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, offsets in slices(batch.column(0)):
            h, n = np.unique(words(raw, offsets)[0], return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the commonest words, ``most`` at most, in order of count and hash.

    Two histograms say where to cut (by the logarithm of the count, and, within the class that is cut,
    by the first bits of the hash), so no more rows than that reach the driver from all tasks together.
    """
    level, cell = F.floor(F.log2("n") * 8).cast("int"), F.shiftrightunsigned("h", 52)
    left, cut = most, None
    for r in sorted(counts.groupBy(level.alias("l")).count().collect(), key=lambda r: -r["l"]):  # some 500 rows at most
        if r["count"] > left:
            cut = r["l"]
            break
        left -= r["count"]
    some = counts
    if cut is not None:
        upto = -1
        for r in sorted(counts.where(level == cut).groupBy(cell.alias("c")).count().collect()):  # 4096 rows at most
            if r["count"] > left:
                break
            left, upto = left - r["count"], r["c"]
        some = counts.where((level > cut) | ((level == cut) & (cell <= upto)))
    found = some.toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.lexsort((h, -n))
    return h[order], n[order].astype(np.float64)


def vocabulary(tables: Scratch, texts: DataFrame) -> Vocabulary:
    """Of all texts; the table of all counts stays under "counts"."""
    counts = tables.table("counts", texts.mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    h, n = _commonest(counts, KEPT)
    own = min(OWN, len(h))
    output = OWN + (h % np.uint64(BUCKETS)).astype(np.int64)
    output[:own] = np.arange(own)
    # h mod BUCKETS for signed numbers, as BUCKETS is a power of two.
    spread = counts.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("c")).agg(F.sum("n").alias("n"))
    whole = np.zeros(OUTPUTS)
    for r in spread.collect():  # BUCKETS rows
        whole[OWN + r["c"]] = r["n"]
    np.subtract.at(whole, OWN + (h[:own] % np.uint64(BUCKETS)).astype(np.int64), n[:own])
    whole[:own] = n[:own]
    return Vocabulary(h, output, np.log(n / np.maximum(whole[output], 1)), whole)


def contexts(output: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[position, place]: outputs of the words around each position ``at``; ``EDGE`` outside its text."""
    doc = np.searchsorted(before, at, side="right") - 1
    low, high = before[doc], before[doc + 1]
    found = np.empty((len(at), len(_PLACES)), np.int64)
    for k, place in enumerate(_PLACES):
        there = at + place
        found[:, k] = np.where((there >= low) & (there < high), output[np.clip(there, 0, max(0, len(output) - 1))], EDGE)
    return found


def stretches(output: np.ndarray, before: np.ndarray) -> np.ndarray:
    """[stretch, word]: all texts in a row, with edges between them, cut every ``SPAN`` words: a stretch's own words,
    then the ``WINDOW`` before and after them, as 16-bit numbers.  Own words that are ``EDGE`` are no places."""
    first = np.zeros(len(output), np.int64)
    first[before[:-1][before[:-1] < before[1:]]] = 1
    at = np.arange(len(output)) + WINDOW * np.cumsum(first)
    n = -(-(int(at[-1]) + 1 - WINDOW) // SPAN) if len(at) else 0
    line = np.full(n * SPAN + 2 * WINDOW, EDGE, "<u2")
    line[at] = output
    if not n:
        return np.empty((0, SPAN + 2 * WINDOW), "<u2")
    rows = np.lib.stride_tricks.sliding_window_view(line, SPAN + 2 * WINDOW)[::SPAN]
    return np.concatenate([rows[:, WINDOW:-WINDOW], rows[:, :WINDOW], rows[:, -WINDOW:]], axis=1)


def _lines(rows: np.ndarray) -> np.ndarray:
    """Stretches in the order of their text."""
    return np.concatenate([rows[:, -2 * WINDOW : -WINDOW], rows[:, : -2 * WINDOW], rows[:, -WINDOW:]], axis=1)


def _places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the stretches' own words are places, in order of class, and their outputs."""
    own = rows[:, : -2 * WINDOW].reshape(-1).astype(np.int64)
    at = np.flatnonzero(own != EDGE)
    at = at[np.argsort((own[at] // PER_CLASS).astype(np.uint8), kind="stable")]
    return at, own[at]


# The network ------------------------------------------------------------------------------------------


@dataclass
class Network:
    """Parameters, float32."""

    embed: np.ndarray
    place: np.ndarray
    bias: np.ndarray
    upper: np.ndarray
    upper_bias: np.ndarray
    lower: np.ndarray
    lower_bias: np.ndarray

    SHAPES = ((OUTPUTS + 1, HIDDEN), (2 * WINDOW, HIDDEN), (HIDDEN,), (CLASSES, HIDDEN), (CLASSES,), (OUTPUTS, HIDDEN), (OUTPUTS,))

    @classmethod
    def start(cls, whole: np.ndarray, seed: int = 5) -> "Network":
        """Random embeddings; biases from the outputs' counts, so that it starts as the unigram model."""
        share = (whole + 1e-3).reshape(CLASSES, PER_CLASS) / (whole.sum() + 1e-3 * OUTPUTS)
        upper = share.sum(axis=1)
        embed = np.random.default_rng(seed).normal(size=cls.SHAPES[0]) * 0.1
        parts = [embed, np.ones(cls.SHAPES[1]), np.zeros(cls.SHAPES[2]), np.zeros(cls.SHAPES[3]), np.log(upper), np.zeros(cls.SHAPES[5]), np.log(share / upper[:, None])]
        return cls.of(np.concatenate([p.reshape(-1) for p in parts]))

    @classmethod
    def of(cls, flat: np.ndarray) -> "Network":
        """From all parameters in a row."""
        ends = np.cumsum([0, *(int(np.prod(s)) for s in cls.SHAPES)])
        return cls(*(flat[a:b].reshape(s).astype(np.float32) for a, b, s in zip(ends, ends[1:], cls.SHAPES)))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.bias, self.upper, self.upper_bias, self.lower, self.lower_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parts()])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """[own word, HIDDEN] from the embeddings of lines."""
        n = around.shape[1] - 2 * WINDOW
        total = around[:, :n] * self.place[0]
        for k, place in enumerate(_PLACES[1:], 1):
            total += around[:, WINDOW + place : WINDOW + place + n] * self.place[k]
        total += self.bias
        return np.tanh(total, out=total).reshape(-1, HIDDEN)

    def within_classes(self, hidden: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Scores of the outputs of each place's class; places come in runs of one class."""
        score = np.empty((len(hidden), PER_CLASS), np.float32)
        for kind, a, b in runs:
            own = slice(kind * PER_CLASS, (kind + 1) * PER_CLASS)
            np.matmul(hidden[a:b], self.lower[own].T, out=score[a:b])
            score[a:b] += self.lower_bias[own]
        return score

    def of_stretches(self, rows: np.ndarray) -> np.ndarray:
        """Log-probability of each place of stretches, in their order."""
        at, target = _places(rows)
        hidden = self.hidden(self.embed[_lines(rows)])[at]
        each, score = np.arange(len(at)), hidden @ self.upper.T + self.upper_bias
        found = score[each, target // PER_CLASS] - _log_sum(score)
        score = self.within_classes(hidden, _runs(target // PER_CLASS))
        found += score[each, target % PER_CLASS] - _log_sum(score)
        return found[np.argsort(at)].astype(float)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target output in its context: a stretch of one word."""
        return self.of_stretches(np.concatenate([target[:, None], context], axis=1))


def _runs(kinds: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, begin, end) of sorted kinds."""
    cut = np.flatnonzero(np.diff(kinds, prepend=-1)).tolist()
    return list(zip(kinds[cut].tolist(), cut, [*cut[1:], len(kinds)]))


_ONES = np.ones(max(CLASSES, PER_CLASS), np.float32)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of each row's exponentials, in place."""
    most = x.max(axis=1)
    x -= most[:, None]
    return np.log(np.exp(x, out=x) @ _ONES[: x.shape[1]]) + most


def _missed(score: np.ndarray, hit: np.ndarray, scale: np.float32) -> np.ndarray:
    """Gradients of minus the log softmax, in place."""
    score -= score.max(axis=1, keepdims=True)
    np.exp(score, out=score)
    score *= (scale / (score @ _ONES[: score.shape[1]]))[:, None]
    score[np.arange(len(score)), hit] -= scale
    return score


class _Adagrad:
    """Steps scaled by the root of each parameter's summed squared gradients."""

    def __init__(self, parameter: np.ndarray, rate: float):
        self.p, self.rate, self.seen = parameter, np.float32(rate), np.full(parameter.shape, 1e-2, np.float32)

    def step(self, gradient: np.ndarray, at=slice(None)) -> None:
        seen = self.seen[at] + gradient * gradient
        self.seen[at] = seen
        self.p[at] -= self.rate * gradient / np.sqrt(seen)


def train(network: Network, runs: Iterable[np.ndarray], passes: int = 1, round_: int = 0, batch: int = BATCH) -> int:
    """Minibatch Adagrad, in place, on runs of stretches; returns the number of places.
    Batches come shuffled from one run; for more than one pass the runs must be a list."""
    rule, rng, total = [_Adagrad(p, RATE * DECAY**round_) for p in network.parts()], np.random.default_rng(round_), 0
    for k in range(passes):
        for run in runs:
            total += int((run[:, :SPAN] != EDGE).sum()) * (k == 0)
            run = run[rng.permutation(len(run))]
            for lo in range(0, len(run), max(1, batch // SPAN)):
                _step(network, rule, run[lo : lo + max(1, batch // SPAN)])
    return total


def _step(net: Network, rule: list[_Adagrad], rows: np.ndarray) -> None:
    """On all places of some stretches."""
    at, target = _places(rows)
    if not len(at):
        return
    line, kinds, scale = _lines(rows).astype(np.int64), target // PER_CLASS, np.float32(8 / len(at))
    around = net.embed[line]
    every = net.hidden(around)
    hidden = every[at]
    miss = _missed(hidden @ net.upper.T + net.upper_bias, kinds, scale)
    back = miss @ net.upper
    rule[3].step(miss.T @ hidden), rule[4].step(miss.sum(axis=0))
    runs = _runs(kinds)
    miss = _missed(net.within_classes(hidden, runs), target % PER_CLASS, scale)
    lower, lower_bias = np.zeros_like(net.lower), np.zeros_like(net.lower_bias)
    for kind, a, b in runs:
        own = slice(kind * PER_CLASS, (kind + 1) * PER_CLASS)
        back[a:b] += miss[a:b] @ net.lower[own]
        np.matmul(miss[a:b].T, hidden[a:b], out=lower[own])
        lower_bias[own] = miss[a:b].sum(axis=0)
    rule[5].step(lower), rule[6].step(lower_bias)
    back *= 1 - hidden * hidden
    every[:] = 0
    every[at] = back
    every = every.reshape(len(rows), -1, HIDDEN)
    # Gradients of the embeddings, by places of the lines, then summed over equal words.
    n, gradient, place = every.shape[1], np.zeros_like(around), np.empty_like(net.place)
    for k, p in enumerate(_PLACES):
        there = slice(WINDOW + p, WINDOW + p + n)
        gradient[:, there] += every * net.place[k]
        place[k] = np.einsum("abh,abh->h", around[:, there], every)
    flat = line.reshape(-1)
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    word = flat[order]
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    rule[1].step(place), rule[2].step(back.sum(axis=0))
    rule[0].step(np.add.reduceat(gradient.reshape(-1, HIDDEN)[order], starts, axis=0), word[starts])


# Training over the cluster ------------------------------------------------------------------------------


def _stretches(texts: DataFrame, vocab) -> DataFrame:
    """n, words: runs of stretches of all texts, and their number of places."""

    @lean
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in slices(batch.column(0)):
                h, _, _, before = words(raw, offsets)
                rows = stretches(vocab.value.look_up(h)[0], before)
                for lo in range(0, len(rows), RUN):
                    some = rows[lo : lo + RUN]
                    yield pa.record_batch({"n": pa.array([int((some[:, :SPAN] != EDGE).sum())], pa.int64()), "words": pa.array([some.tobytes()], pa.binary())})

    return texts.mapInArrow(gather, "n long, words binary")


def fit(tables: Scratch, texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Network:
    """The network, trained on all places of all texts."""
    context = texts.sparkSession.sparkContext
    rows = tables.table("stretches", _stretches(texts, context.broadcast(vocab)).withColumn("run", F.monotonically_increasing_id()))
    flat = Network.start(vocab.whole).flat()
    total = rows.agg(F.sum("n")).first()[0] or 0
    # What one trainer holds is gone over in each round, if it is little more often; else a round takes the runs of its number.
    parts = rounds if total > SHARE else 1
    trainers = min(TRAINERS, -(-total // (parts * SHARE)))
    passes = int(np.clip(STEPS * BATCH // max(1, total), 1, PASSES)) if parts == 1 else 1
    batch = int(np.clip(total // max(1, parts * trainers) // ENOUGH, BATCH, LARGEST))
    for k in range(rounds if total else 0):
        own = rows.where(F.pmod(F.xxhash64("run"), F.lit(parts)) == k % parts)
        # The same runs in the same order at every attempt.
        dealt = own.select("words", "run").repartition(trainers, "run").sortWithinPartitions("run")
        part = dealt.mapInArrow(_trainer(context.broadcast(flat), passes, k, batch), "chunk long, n long, sums binary")
        # A range of parameters meets in one task as a running sum: a few KB, however many trainers.
        part = part.repartition("chunk").sortWithinPartitions("chunk", "n").mapInArrow(_averaged, "chunk long, mean binary")
        means = {r["chunk"]: r["mean"] for r in part.collect()}  # the parameters, once
        flat = np.frombuffer(b"".join(means[c] for c in sorted(means)), np.float64) if means else flat
    tables.drop("stretches")
    return Network.of(flat)


def _held(runs: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Runs of texts together, up to some ``HELD`` stretches."""
    some: list[np.ndarray] = []
    for run in runs:
        some.append(run)
        if sum(map(len, some)) >= HELD:
            yield np.concatenate(some)
            some = []
    if some:
        yield np.concatenate(some)


def _trainer(start, passes: int, round_: int, size: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        own = Network.of(start.value)
        runs = _held(np.frombuffer(raw.as_py(), "<u2").reshape(-1, SPAN + 2 * WINDOW) for batch in batches for raw in batch.column(0))
        n = train(own, list(runs) if passes > 1 else runs, passes, round_, size)
        if n:
            flat = own.flat().astype(np.float64) * n
            cuts = range(0, len(flat), CHUNK)
            sums = pa.array([flat[c : c + CHUNK].tobytes() for c in cuts], pa.binary())
            yield pa.record_batch({"chunk": pa.array(range(len(cuts)), pa.int64()), "n": pa.array([n] * len(cuts), pa.int64()), "sums": sums})

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk -> the mean of each chunk's parameters."""
    out = lambda c, total, n: pa.record_batch({"chunk": pa.array([c], pa.int64()), "mean": pa.array([(total / n).tobytes()], pa.binary())})
    chunk, total, n = None, None, 0
    for batch in batches:
        for c, k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            sums = np.frombuffer(raw.as_py(), np.float64)
            if c != chunk:
                if chunk is not None:
                    yield out(chunk, total, n)
                chunk, total, n = c, np.zeros(len(sums)), 0
            total, n = total + sums, n + k
    if chunk is not None:
        yield out(chunk, total, n)


# Scoring ------------------------------------------------------------------------------------------------


def _scored(column: pa.Array, vocab: Vocabulary, network: Network) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: words and summed log-probabilities of each text (without the log counts of rare words),
    the hashes of all words, which are rare, and words before each text."""
    for _, _, raw, offsets in slices(column):
        h, _, _, before = words(raw, offsets)
        output, within, rare = vocab.look_up(h)
        rows = stretches(output, before)
        parts = [network.of_stretches(rows[lo : lo + SCORED]) for lo in range(0, len(rows), SCORED)]
        log_p = np.concatenate([np.empty(0), *parts])
        sums = np.concatenate([[0.0], np.cumsum(log_p + within)])
        yield np.diff(before), sums[before[1:]] - sums[before[:-1]], h, rare, before


def _rare(h: np.ndarray, rare: np.ndarray, before: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each text its distinct rare words (lists of hashes) and how often it has each."""
    at = np.flatnonzero(rare)
    doc, word = np.searchsorted(before, at, side="right") - 1, h[at]
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])) if len(doc) else np.empty(0, np.int64)
    ends = pa.array(np.searchsorted(doc[new], np.arange(len(before))).astype(np.int32))
    times = np.diff(np.append(new, len(doc))).astype(np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(word[new].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, log_likelihood, mean_log_likelihood."""
    tables = Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = rows.select("text")
    vocab = vocabulary(tables, texts)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, fit(tables, texts, vocab)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in batches:
            at = 0
            for n, total, h, rare, before in _scored(batch.column(1), *shared.value):
                yield pa.record_batch([batch.column(0).slice(at, len(n)), pa.array(n), pa.array(total), *_rare(h, rare, before)], names=["id", "n", "s", "h", "k"])
                at += len(n)

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, n long, s double, h array<long>, k array<long>"
    got = tables.table("scored", rows.mapInArrow(run, kinds).withColumn("row", F.monotonically_increasing_id()))
    rare = got.select("row", F.explode(F.arrays_zip("h", "k")).alias("w")).select("row", "w.h", "w.k")
    logs = docs.sparkSession.read.schema("h long, n long").parquet(tables.path("counts")).select("h", F.log("n").alias("log_n"))
    # Few documents hold a rare word, so no hash is hot; sums are of whole numbers, in any order.
    more = rare.join(logs, "h").groupBy("row").agg((F.sum(F.round(F.col("k") * F.col("log_n") * FINE).cast("long")) / FINE).alias("more"))
    got = got.drop("h", "k").join(more, "row", "left").withColumn("s", F.col("s") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("s").alias("log_likelihood"), mean.alias("mean_log_likelihood"))
