"""Alignment of two tokenizers against a plain version over all occurrences."""

import bisect
import collections
import hashlib
import random

import public_tokenizers
import pytest

from quarrywork.llm import alignment

from .brute import EDGE_TEXTS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def tokens(text):
    """(id, bytes) of both tokenizers, from whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not _MODELS:
        a = Tokenizer.from_file(A)
        a.encode_special_tokens = True
        _MODELS.extend([a, SentencePieceProcessor(model_file=B)])
    a, b = _MODELS
    spaced = " " + text
    ids = a.encode(spaced, add_special_tokens=False).ids
    left = [(i, alignment.byte_level(a.id_to_token(i))) for i in ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    same = all(b"".join(x for _, x in side) == spaced.encode() for side in (left, right))
    return (left, right) if text and same else ([], [])


_MODELS = []


def ends(side):
    at, out = 0, []
    for _, x in side:
        at += len(x)
        out.append(at)
    return out


def brute(rows):
    groups, counts = [], collections.Counter()
    for _, text in rows:
        left, right = tokens(text or "")
        le, re = ends(left), ends(right)
        cuts = sorted(set(le) & set(re))
        inside = lambda side, to, lo, hi: [i for i, _ in side[bisect.bisect_right(to, lo) : bisect.bisect_right(to, hi)]]
        groups.append([(inside(left, le, lo, hi), inside(right, re, lo, hi)) for lo, hi in zip([0, *cuts], cuts)])
        counts.update({(x, y) for g in groups[-1] for x in g[0] for y in g[1]})
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for (doc, _), own in zip(rows, groups):
        links = [(x, y) for g in own for x in g[0] for y in g[1]]
        text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in own)
        yield (doc, sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(links), hashlib.sha256(text.encode()).hexdigest() if own else "", sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links))


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "the", "Überraschung", " ", "  ", "\n", "\t", "漢字", "🙂", "é", "é", "1234", "...", "'s", " ", "　", "​", "<|endoftext|>", "</s>", "\x00", "ﬁ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(150)]
    return [(100 + i, t) for i, t in enumerate([*texts, "with ▁ mark", " leading", "trailing ", "   "])]


@pytest.mark.parametrize("bound", [alignment.BROADCAST_PAIRS, 0])
def test_equals_plain_version(spark, bound):
    rows = EDGE_TEXTS + odd_texts() + [(7, "a b c d e f g h")] * 3
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, pairs string").repartition(3)
    got = alignment.align(docs, A, B, bound=bound).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_real_texts_and_small_slices(spark, sf, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 100)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60]
    aligner = alignment.Aligner(A, B)
    import pyarrow as pa

    got = list(aligner.rows(pa.array([t for _, t in rows], pa.string())))
    want = list(brute(rows))
    assert [tuple(g[:5]) for g in got] == [w[1:6] for w in want]
    assert [int(g[6].sum()) for g in got] == [w[4] for w in want]


def test_large_group_of_links():
    """A text without shared cuts inside is one group; its links are met slice by slice."""
    import numpy as np

    a, b = np.arange(3000) % 7, np.arange(2000) % 5
    one = np.array([0]), np.array([0]), np.array([3000]), np.array([2000]), np.array([0]), 1
    pairs, times, ends = alignment.Aligner._pairs(a, b, *one)
    assert ends == [35] and int(times.sum()) == 6_000_000 and pairs.tolist() == sorted((x << 16) | y for x in range(7) for y in range(5))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
