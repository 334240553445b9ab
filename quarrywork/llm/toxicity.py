"""Toxicity by a linear-chain conditional random field over words.

Tokens are labelled from document labels: a word type is toxic where the places in which it stands
(pairs of neighbours, so that copies count once) are far more common in toxic training documents
than in clean ones; tokens of toxic documents that are of such a type carry label 1, all others 0.
On these sequences a two-state linear-chain CRF is fitted in numpy by gradient ascent: each token
has weights for itself and its two neighbours, the chain has a weight for each pair of
states.  Forward-backward marginals give every word of a text a probability; the document's score
comes from its most toxic word through a logistic curve fitted on the training documents, and the
words above one half are the offending spans.

The classifier is fitted on at most ``FIT_DOCS`` toxic and ``FIT_CLEAN`` clean training documents (a
documented bound, in the order of a hash of the id) of at most ``FIT_LENGTH`` characters each, so what the driver collects
is bounded in rows and bytes; the model keeps weights only of the few types that speak for toxicity,
found by their full 64-bit hashes.  Every document is scored by its whole text.

Scoring is one map over whole texts: words are hashed on Arrow's buffers, weights are looked up, and
the chain is run over blocks of ``CHUNK`` words at once (transfer matrices of blocks, a short scan
over blocks, then the inside of the blocks), so that one pass costs a few array operations a word.

Defined cases: null and empty texts are sequences without words and get the score of a text without
evidence; unlabelled rows and null labels do not train; rows with null ids are scored and not held
out; without any toxic training row the model is empty and every score is low; repeated rows
get equal scores; an empty table gives an empty result; further columns are kept by ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sampling import among_first
from .scratch import unused
from .wordhash import mix, slices, words
from .worker import give_back, lean

SLOTS = 1 << 20
CHUNK = 64
#: Toxic and clean training documents that the chain is fitted on at most, and their length.
FIT_DOCS, FIT_CLEAN, FIT_LENGTH = 1200, 2400, 50_000
THRESHOLD = 0.7
#: A type is toxic from so many places in toxic training documents, such log-odds and such a
#: log-likelihood ratio on.
LEAST_SEEN, LEAST_ODDS, LEAST_RATIO = 3, 3.0, 12.0
#: ASCII marks dropped at the edges of a word before it is hashed.
EDGE_MARKS = b".,;:!?\"'()[]{}<>*#%&$|_-"
_EDGE = np.zeros(256, bool)
_EDGE[list(EDGE_MARKS)] = True


@dataclass
class Model:
    """Weights of word types (type 0: every word that is not kept), the chain's pair weights, the
    curve from evidence to score.  ``slots`` says by the upper bits of a word's hash whether some type
    has them; such words are looked up in ``keys`` by all 64, so types may share upper bits."""

    keys: np.ndarray
    own: np.ndarray
    near: np.ndarray
    chain: np.ndarray
    curve: tuple[float, float]

    def __post_init__(self):
        self.slots = np.zeros(SLOTS, bool)
        self.slots[_slot(self.keys[1:])] = True
        self.order = np.argsort(self.keys[1:]) + 1

    def types(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.slots[_slot(hashes)])
        if len(some):
            ranked = self.keys[self.order]
            at = np.minimum(np.searchsorted(ranked, hashes[some]), len(ranked) - 1)
            found[some] = np.where(ranked[at] == hashes[some], self.order[at], 0)
        return found


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts without their edge marks, first bytes, ends, words before."""
    bare = raw
    if len(raw):
        bare = raw.copy()
        bare[_EDGE[raw]] = 32
    return words(bare, offsets)


def marginals(energy: np.ndarray, chain: np.ndarray, before: np.ndarray) -> np.ndarray:
    """P(state 1) of each position of the chains that start at ``before[:-1]``.

    ``energy`` is the log-odds of state 1 at a position, ``chain[i, j]`` the log weight of i -> j.
    """
    n = len(energy)
    if not n:
        return np.empty(0)
    forward = _sweep(energy, np.exp(chain), before)
    back = before[-1] - before[::-1]
    backward = _sweep(energy[::-1], np.exp(chain.T), back)[::-1]
    # Both hold a position's own energy: it is taken out once.
    odds = forward + backward - energy
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _sweep(energy: np.ndarray, t: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log alpha(1) / alpha(0) at each position, from the left.

    With r = alpha(1) / alpha(0) a step is r' = e (t01 + t11 r) / (t00 + t10 r): a Moebius map, so a
    block of steps is one 2 x 2 matrix.  Chains are restarted by a step that forgets r.
    """
    n = len(energy)
    starts = np.unique(before[:-1][before[:-1] < before[1:]])
    rows = -(-n // CHUNK)

    def padded(x, at_start, rest: float) -> np.ndarray:
        out = np.full(rows * CHUNK, rest)
        out[:n] = x
        out[starts] = at_start
        return out.reshape(rows, CHUNK)

    e = np.exp(np.clip(energy, -30, 30))
    a, b = padded(e * t[1, 1], 0.0, 1.0), padded(e * t[0, 1], e[starts], 0.0)
    del e
    c, d = padded(t[1, 0], 0.0, 0.0), padded(t[0, 0], 1.0, 1.0)
    # The matrix of each block.
    pa_, pb, pc, pd = a[:, 0].copy(), b[:, 0].copy(), c[:, 0].copy(), d[:, 0].copy()
    for k in range(1, CHUNK):
        na, nb = a[:, k] * pa_ + b[:, k] * pc, a[:, k] * pb + b[:, k] * pd
        nc, nd = c[:, k] * pa_ + d[:, k] * pc, c[:, k] * pb + d[:, k] * pd
        scale = 1 / np.maximum(np.maximum(np.abs(na), np.abs(nb)), np.maximum(np.abs(nc), np.abs(nd)))
        pa_, pb, pc, pd = na * scale, nb * scale, nc * scale, nd * scale
    enter = np.empty(rows)
    r = 1.0
    for i, (w, x, y, z) in enumerate(zip(pa_.tolist(), pb.tolist(), pc.tolist(), pd.tolist())):
        enter[i] = r
        r = (w * r + x) / max(y * r + z, 1e-300)
    out, r = np.empty((rows, CHUNK)), enter
    for k in range(CHUNK):
        r = (a[:, k] * r + b[:, k]) / np.maximum(c[:, k] * r + d[:, k], 1e-300)
        out[:, k] = r
    return np.log(np.maximum(out.reshape(-1)[:n], 1e-300))


def energies(own: np.ndarray, around: np.ndarray, bucket: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Log-odds of state 1 for words of types ``bucket``: its own weight and its neighbours'."""
    energy = own[bucket]
    near = around[bucket]
    inside = np.ones(len(bucket), bool)
    inside[before[:-1][before[:-1] < len(bucket)]] = False
    energy[1:] += np.where(inside[1:], near[:-1], 0)
    energy[:-1] += np.where(inside[1:], near[1:], 0)
    return energy


def evidence(p: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each text the log-odds of its most toxic word (-10 without words)."""
    out = np.full(len(before) - 1, -10.0)
    some = np.flatnonzero(before[1:] > before[:-1])
    if len(some):
        most = np.maximum.reduceat(p, before[:-1][some])
        out[some] = np.clip(np.log(np.maximum(most, 1e-9) / np.maximum(1 - most, 1e-9)), -10, 10)
    return out


def held_out(id_col) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_docs: int, fit_clean: int = FIT_CLEAN) -> list[tuple[str, int]]:
    """Texts and labels of at most ``fit_docs`` toxic and ``fit_clean`` clean training rows, by the order of a hash.

    The sample is drawn from the labels, so what is broadcast to the texts' scan is that many ids.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    named = named.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    named = named.withColumn("h", F.xxhash64("id"))
    some = [named.where(F.col("toxic") == kind) for kind in (1, 0)]
    some = [rows.where(among_first(rows, F.col("h"), most)) for rows, most in zip(some, (fit_docs, fit_clean))]
    some = some[0].unionByName(some[1]).drop("h")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= FIT_LENGTH)
    # One text for each id, however often it repeats.
    rows = rows.join(F.broadcast(some), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return sorted((r.text, r.toxic) for r in rows.select("text", "toxic").collect())


def toxic_types(bucket: np.ndarray, size: int, before: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which of ``size`` types are toxic: seen between many different pairs of neighbours in toxic documents
    and far more rarely in clean ones.  Copies of a document repeat its neighbours and count once; so
    does a word that one document repeats, as documents are counted, too, and the lesser count holds."""
    doc = np.repeat(np.arange(len(kinds)), np.diff(before))
    context = np.roll(bucket, 1).astype(np.uint64) << np.uint64(40)
    context ^= np.roll(bucket, -1).astype(np.uint64) << np.uint64(18)
    context ^= bucket.astype(np.uint64)
    context = mix(context)
    count = []
    for kind in (0, 1):
        own = kinds[doc] == kind
        _, place = np.unique(context[own], return_index=True)
        _, held = np.unique(doc[own] * size + bucket[own], return_index=True)
        count.append(np.minimum(*(np.bincount(bucket[own][one], minlength=size) for one in (place, held))))
    clean, toxic = count
    odds = np.log((toxic + 0.5) / (toxic.sum() + 1)) - np.log((clean + 0.5) / (clean.sum() + 1))
    # Log-likelihood ratio against the share that toxic documents have of all places: rare words
    # that are met in toxic documents by chance do not reach it.
    share, n = toxic.sum() / max(1, toxic.sum() + clean.sum()), toxic + clean
    ratio = toxic * np.log(np.maximum(toxic, 0.5) / np.maximum(n * share, 1e-9)) + clean * np.log(np.maximum(clean, 0.5) / np.maximum(n * (1 - share), 1e-9))
    return (toxic >= LEAST_SEEN) & (odds >= LEAST_ODDS) & (ratio >= LEAST_RATIO)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_docs: int = FIT_DOCS, fit_clean: int = FIT_CLEAN) -> Model:
    """The model from labelled rows that are not held out."""
    rows = sample(docs, labels, id_col, text_col, label_col, fit_docs, fit_clean)
    return train([t for t, _ in rows], np.array([k for _, k in rows], np.int64))


def train(texts: list[str], kinds: np.ndarray, rounds: int = 20, rate: float = 1.0) -> Model:
    """Gradient ascent on the chains' conditional log-likelihood, then the document curve.

    The gradient of a weight is its labelled minus its expected count; expected counts of the chain
    weights use neighbouring marginals.
    """
    found, before = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, raw, offsets in slices(pa.array(texts, pa.large_string())):
        part, _, _, upto = token_hashes(raw, offsets)
        found.append(part), before.append(upto[1:] + before[-1][-1])
    hashes, before = np.concatenate(found), np.concatenate(before)
    del found
    give_back()  # what the words of the texts took, in the driver
    if not kinds.any() or not len(hashes):
        return Model(np.zeros(1, np.uint64), np.full(1, -4.0), np.zeros(1), np.zeros((2, 2)), (0.0, -4.0))
    vocabulary, bucket = np.unique(hashes, return_inverse=True)
    size = len(vocabulary)
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    label = (toxic_types(bucket, size, before, kinds)[bucket] & (kinds[doc] == 1)).astype(float)
    del doc
    give_back()
    own, near, chain = np.full(size, -4.0), np.zeros(size), np.zeros((2, 2))
    inside = np.ones(len(bucket), bool)
    inside[before[:-1][before[:-1] < len(bucket)]] = False
    count = np.bincount(bucket, minlength=size)
    pairs = inside[1:]
    n = max(1, int(pairs.sum()))
    for _ in range(rounds):
        p = marginals(energies(own, near, bucket, before), chain, before)
        miss = label - p
        own += rate * 4 * np.bincount(bucket, miss, size) / np.sqrt(count)
        step = np.bincount(bucket[:-1], np.where(pairs, miss[1:], 0), size) + np.bincount(bucket[1:], np.where(pairs, miss[:-1], 0), size)
        near += 0.1 * rate * step / count
        np.clip(own, -8, 8, out=own), np.clip(near, -1, 1, out=near)
        for i in (0, 1):
            for j in (0, 1):
                of = lambda x, k: x if k else 1 - x
                want, have = of(label[:-1], i) * of(label[1:], j), of(p[:-1], i) * of(p[1:], j)
                chain[i, j] += rate * float(((want - have) * pairs).sum()) / n
        np.clip(chain, -2, 2, out=chain)
    # Types that say little share type 0, which also stands for words not met in training.
    keep = np.flatnonzero(own > -3)
    rest = np.ones(size, bool)
    rest[keep] = False
    common = float(np.average(own[rest], weights=count[rest])) if rest.any() else -6.0
    model = Model(
        np.concatenate([np.zeros(1, np.uint64), vocabulary[keep]]), np.concatenate([[common], own[keep]]), np.concatenate([[0.0], near[keep]]), chain, (1.0, 0.0)
    )
    x = evidence(_marginals(model, hashes, before), before)
    model.curve = _logistic(x, kinds.astype(float))
    return model


def _marginals(model: Model, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    return marginals(energies(model.own, model.near, model.types(hashes), before), model.chain, before)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and intercept of P(toxic | evidence), by Newton's method with a prior."""
    a, b = 0.5, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-9
        ga, gb = ((y - p) * x).sum() - 0.01 * a, (y - p).sum() - 0.01 * b
        haa, hab, hbb = (w * x * x).sum() + 0.01, (w * x).sum(), w.sum() + 0.01
        det = haa * hbb - hab * hab
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
        a, b = float(np.clip(a, 0, 5)), float(np.clip(b, -20, 20))
    return a, b


def _scored(model: Model, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: document scores, word marginals, first bytes, ends, words before."""
    a, b = model.curve
    for _, _, raw, offsets in slices(column):
        hashes, first, last, before = token_hashes(raw, offsets)
        p = _marginals(model, hashes, before)
        base = np.repeat(offsets[:-1], np.diff(before))
        yield 1 / (1 + np.exp(-(a * evidence(p, before) + b))), p, first - base, last - base, before


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and a score in [0, 1] for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers, whatever the corpus

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [s[0] for s in _scored(model, batch.column(batch.num_columns - 1))]
            if got:
                yield pa.record_batch([*batch.columns[:-1], pa.array(np.concatenate(got))], names=[*batch.schema.names[:-1], out])

    text = unused(docs, "__qw_text")
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, `{out}` double")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Offending words: id, start and end (bytes of the UTF-8 text), probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for scores, p, first, last, before in _scored(shared.value, batch.column(1)):
                hit = np.flatnonzero(p >= least)
                doc = at + np.searchsorted(before, hit, side="right") - 1
                yield pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(first[hit]), pa.array(last[hit]), pa.array(p[hit])], names=["doc_id", "start", "end", "probability"])
                at += len(scores)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, probability double")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = score(docs, fit(docs, labels, id_col), keep=(id_col,))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, unchanged."""
    model = fit(docs, labels, id_col, text_col)
    out = unused(docs, "__qw_score")
    return score(docs, model, text_col, out, tuple(docs.columns)).where(F.col(out) < THRESHOLD).select(*docs.columns)
