"""Removal of repeated strings, and the sorting below it, against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pytest

from quarrywork.llm import deep_shallow, suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    counts = collections.Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    for (doc, _), x in zip(rows, texts):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if counts[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        yield doc, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def found(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, row string").repartition(3)
    out = suffix_dedup.deduplicate(docs, **options)
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("shallow,small", [(32, 1 << 15), (8, 4), (16, 64), (64, 2)])
def test_sorts(monkeypatch, shallow, small):
    monkeypatch.setattr(deep_shallow, "SHALLOW", shallow), monkeypatch.setattr(deep_shallow, "SMALL", small)
    rng = random.Random(shallow)
    words = [bytes(rng.choices(b"ab\x00\xff", k=rng.randint(1, 40))) for _ in range(12)]
    raw = b"".join(rng.choices(words, k=150))
    for length in (1, 5, 20, 37, 64):
        starts = np.array(rng.sample(range(len(raw) - length), 600))
        got = deep_shallow.Block(np.frombuffer(raw, np.uint8), starts, length)
        strings = [raw[starts[i] : starts[i] + length] for i in got.order.tolist()]
        assert sorted(got.order.tolist()) == list(range(600)) and strings == sorted(strings)
        assert got.first.tolist() == [strings.index(s) for s in strings]


def passages(rng, length):
    """Texts of small letters with shared passages around ``length`` bytes, copies and repetitions."""
    draw = lambda n: "".join(rng.choices("abcdefgh é漢", k=n))
    shared = [draw(rng.randint(length // 2, 3 * length)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(shared) if rng.random() < 0.3 else draw(rng.randint(1, 2 * length)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100, rows[5][1]), (100, rows[5][1]), (None, rows[7][1]), (101, None), (102, ""), (103, "x" * 5 * length), (104, "ab" * 3 * length), (105, "x" * length), (106, draw(length - 1))]
    return rows


def test_short_strings(spark):
    rows = passages(random.Random(1), 40)
    want = sorted(brute(rows, 40), key=repr)
    assert sum(w[2] for w in want) > 0 and found(spark, rows, length=40, gram=8) == want


def test_split_anchors_and_small_blocks(spark):
    rng = random.Random(2)
    rows = passages(rng, 40)
    middle = "a passage that very many texts share, with other words on both of its sides"
    rows += [(200 + i, "".join(rng.choices("klmnopq", k=60)) + middle + "".join(rng.choices("rstuvw", k=60))) for i in range(80)]
    assert found(spark, rows, length=40, gram=8, pieces=7, block=2000) == sorted(brute(rows, 40), key=repr)


def test_whole_length_and_long_texts(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=1_100_000))
    rows += [(900, long), (901, "head " + long[520_000:530_000] + " tail"), (902, long[1_000:1_399]), (903, long[2_000:2_400])]
    assert found(spark, rows) == sorted(brute(rows, 400), key=repr)


def test_empty_table(spark):
    assert found(spark, []) == []
