"""Batch models and the content-addressed store."""

import numpy as np
from pyspark.sql import functions as F

from quarrywork.operators.embedding import EmbeddingStore


def counting(folder, bad=()):
    """A model that leaves a file for every text it is called with, and fails on some."""

    def load():
        import pathlib
        import uuid

        def embed(texts):
            if any(t in bad for t in texts):
                raise ValueError("cannot embed")
            for t in texts:
                pathlib.Path(folder, uuid.uuid4().hex).write_text(t)
            return np.array([[len(t), t.count("a"), 1.0] for t in texts])

        return embed

    return load


def calls(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_each_text_is_embedded_once_over_runs(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    store = EmbeddingStore(spark, f"file://{tmp_path}/store", counting(str(seen)), 3, batch_size=4)
    first = spark.createDataFrame([(i, f"text a{i % 10}") for i in range(60)] + [(99, None)], "id long, s string").repartition(4)
    got = {r.id: list(r.vector) for r in store.embed(first, "s").collect()}
    assert got[3] == got[13] == [7.0, 1.0, 1.0] and got[99] == [0.0, 0.0, 0.0] and len(got) == 61
    assert calls(seen) == sorted(f"text a{k}" for k in range(10))
    again = EmbeddingStore(spark, f"file://{tmp_path}/store", counting(str(seen)), 3)
    more = first.select("id", "s").union(spark.createDataFrame([(100, "new"), (101, "new")], "id long, s string"))
    assert again.add(more, "s") == 1 and again.add(more, "s") == 0
    assert calls(seen) == sorted([*(f"text a{k}" for k in range(10)), "new"]) and again.rows().count() == 11
    assert again.embed(first.limit(0), "s").count() == 0


def test_failures_give_zeros_and_are_tried_again(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["good", "bad", "fine", "bad"])], "vector long, __t string").coalesce(1)
    store = EmbeddingStore(spark, f"file://{tmp_path}/store", counting(str(seen), bad=("bad",)), 3, batch_size=10)
    got = {r["__t"]: list(r.v) for r in store.embed(rows, "__t", out="v").collect()}
    assert got == {"good": [4.0, 0.0, 1.0], "fine": [4.0, 0.0, 1.0], "bad": [0.0, 0.0, 0.0]} and calls(seen) == ["fine", "good"]
    assert EmbeddingStore(spark, f"file://{tmp_path}/store", counting(str(seen)), 3).add(rows, "__t") == 1
    assert calls(seen) == ["bad", "fine", "good"]
    assert store.rows().where(F.size("vector") != 3).count() == 0
