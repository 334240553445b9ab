"""Training of the scoring network looks at every place of every text, at every size of corpus."""

import random
import uuid

import numpy as np

from quarrywork.llm import lm_score


def texts(n):
    rng = random.Random(3)
    return ["", "one", " ".join(rng.choice("abcdefgh") for _ in range(700))] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) for _ in range(n)]


def test_stretches_hold_each_place_once_with_its_window():
    output, before = [], [0]
    for t in texts(60):
        output += [len(t) % 7 * 100 + ord(c[0]) for c in t.split()]
        before.append(len(output))
    output, before = np.array(output), np.array(before)
    rows = lm_score.stretches(output, before)
    line, got = lm_score._lines(rows), []
    for k in range(lm_score.SPAN):
        window = line[:, k : k + 2 * lm_score.WINDOW + 1]
        got.append(window[window[:, lm_score.WINDOW] != lm_score.EDGE])
    around = lm_score.contexts(output, before, np.arange(len(output)))
    want = np.insert(around, lm_score.WINDOW, output, axis=1)
    assert sorted(np.concatenate(got).tolist()) == sorted(want.tolist())
    assert len(lm_score.stretches(np.empty(0, np.int64), np.zeros(3, np.int64))) == 0


def test_all_rounds_together_train_on_every_place(spark, monkeypatch, tmp_path):
    """Also where the counts are those of a corpus a million times as large, and many trainers share it."""
    monkeypatch.setattr(lm_score, "SHARE", 500)
    trainer, span, edge, wide, folder = lm_score._trainer, lm_score.SPAN, lm_score.EDGE, lm_score.SPAN + 2 * lm_score.WINDOW, str(tmp_path)

    def counting(*given):
        inner = trainer(*given)

        def run(batches):
            held = list(batches)
            seen = sum(int((np.frombuffer(raw.as_py(), "<u2").reshape(-1, wide)[:, :span] != edge).sum()) for batch in held for raw in batch.column(0))
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(seen))
            yield from inner(iter(held))

        return run

    monkeypatch.setattr(lm_score, "_trainer", counting)
    rows = texts(80)
    docs = spark.createDataFrame([(t,) for t in rows], "text string").repartition(6)
    tables = lm_score.Scratch(spark, "test")
    vocab = lm_score.vocabulary(tables, docs)
    vocab.whole *= 1e6
    lm_score.fit(tables, docs, vocab)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == sum(len(t.split()) for t in rows)
