"""Objects of a JSON array, read in splits, against a plain walk over the bytes."""

import json
import random

import numpy as np
import pytest

from quarrywork.sources import json_splits as S, readers


def walk(raw):
    quoted = skip = depth = 0
    start, out = 0, []
    for i, c in enumerate(raw):
        if skip:
            skip = 0
        elif c == 92:
            skip = 1
        elif c == 34:
            quoted = 1 - quoted
        elif not quoted and c == 123:
            start = i if depth == 0 else start
            depth += 1
        elif not quoted and c == 125 and depth:
            depth -= 1
            if depth == 0:
                out.append(raw[start : i + 1])
    return out, (quoted, skip, depth)


def junk(seed, n):
    return bytes(random.Random(seed).choices(b'{}"\\ a', weights=[4, 4, 3, 2, 3, 3], k=n))


@pytest.mark.parametrize("seed", range(30))
def test_functions_compose(seed):
    raw = junk(seed, 200)
    cut = random.Random(seed).randint(0, 200)
    whole = S.composed(S.transfer(np.frombuffer(raw[:cut], np.uint8)), S.transfer(np.frombuffer(raw[cut:], np.uint8)))
    assert whole == S.transfer(np.frombuffer(raw, np.uint8))
    quoted, skip, a, b = whole[0]
    assert (quoted, skip, max(a, b)) == walk(raw)[1]
    # Any state to begin with: some bytes before lead to it.
    for before in (b"{{{", b'{"', b'"\\', b"{\\"):
        q, s, d = walk(before)[1]
        q, s, a, b = whole[2 * q + s]
        assert (q, s, max(d + a, b)) == walk(before + raw)[1]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000"), spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes"), spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("bound", [S.BROADCAST_SPLITS, 0])
def test_splits_equal_the_walk(spark, tmp_path, small_splits, monkeypatch, bound):
    monkeypatch.setattr(S, "BROADCAST_SPLITS", bound)
    rng = random.Random(9)
    objects = [{"a": i, "s": "".join(rng.choices('{}[]"\\é🙂 x', k=rng.choice([0, 30, 200]))), "o": {"p": [{}, {"q": "}"}]}} for i in range(300)]
    objects[50]["s"] = "long { \\ \" " * 2000  # over several splits
    (tmp_path / "a.json").write_text("[" + ", ".join(json.dumps(o, ensure_ascii=i % 2 == 0) for i, o in enumerate(objects)) + "]")
    (tmp_path / "b.json").write_bytes(b"[" + junk(1, 20_000))
    (tmp_path / "c.json").write_bytes(b'{"only": "{"}')
    paths = [f"file://{tmp_path}/{n}.json" for n in "abc"]
    assert spark.read.option("lineSep", "}").text(paths).rdd.getNumPartitions() > 10
    got = sorted((r.file[-6], r["at"], r.nr, r.object) for r in S.objects(spark, paths).collect())
    want = [(n, x.decode(errors="replace")) for n in "abc" for x in walk((tmp_path / f"{n}.json").read_bytes())[0]]
    assert [(n, x) for n, _, _, x in got] == want


def test_both_ways_read_the_same(spark, tmp_path, small_splits):
    objects = [{"a": i, "s": 'x "{' * (i % 9)} for i in range(500)]
    lines = [json.dumps(o) for o in objects]
    lines.insert(7, '{"a": }'), lines.insert(0, '"a { string"')
    path = tmp_path / "x.json"
    path.write_text("[" + ",".join(lines) + "]")
    read = lambda **o: [(r.a, r.s) for r in readers.json_document(spark, f"file://{path}", "a long, s string", **o).collect()]
    assert sorted(read(large=0)) == sorted(read()) == [(o["a"], o["s"]) for o in objects]
    assert read(large=0, first=5) == read(first=5) == [(o["a"], o["s"]) for o in objects[:5]]
