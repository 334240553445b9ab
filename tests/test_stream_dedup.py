"""Streaming dedup over several keys: it ends, equals the plain loop, and forgets in order."""

import random

import pytest

from quarrywork.session import ship_package
from quarrywork.streaming import dedup

SCHEMA = "ord long, shard string, url_key string, title_key string, content_key string"


def loop(batches, by_shard=False, most=None):
    """Row by row; with ``most``, the oldest marks of a kind go."""
    marked, out = {}, []
    for batch in batches:
        for row in sorted(batch):
            own = [((row[1] if by_shard else None, kind), key) for kind, key in enumerate(row[2:]) if key is not None]
            if all(key not in marked.get(kind, []) for kind, key in own):
                out.append(row[0])
                for kind, key in own:
                    marked.setdefault(kind, []).append(key)
                    del marked[kind][: -most if most else 0]
    return out, marked


def batches(seed, n=3, size=60):
    rng = random.Random(seed)
    draw = lambda k: rng.choice([None, *map(str, range(k))])
    return [[(b * size + i, f"s{rng.randrange(3)}", draw(60), draw(40), draw(80)) for i in range(size)] for b in range(n)]


def stream(spark, folder, given):
    for k, batch in enumerate(given):
        spark.createDataFrame(random.Random(k).sample(batch, len(batch)), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("most", [None, 5])
def test_sharded_equals_loop_and_forgets_in_order(spark, tmp_path, most):
    ship_package(spark)
    given = batches(1)
    rows = dedup.accepted(stream(spark, f"{tmp_path}/in", given), "shard", "ord", most=most, ttl_ms=None if most else 86_400_000)
    q = dedup.start(rows, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert q.awaitTermination(240)
    got = spark.read.schema("ord long, accepted boolean").json(f"{tmp_path}/out")
    want, marked = loop(given, by_shard=True, most=most)
    assert got.count() == 180 and sorted(r.ord for r in got.where("accepted").collect()) == want
    # One state entry a key, and never more than the cap.
    state = spark.read.format("statestore").option("stateVarName", "marked").option("path", f"{tmp_path}/cp").load()
    held = sorted((r.key[0], r.user_map_key[0], r.user_map_key[1]) for r in state.select("key", "user_map_key").collect())
    assert held == sorted((shard, kind, key) for (shard, kind), keys in marked.items() for key in keys)
    assert most is None or max(len(k) for k in marked.values()) <= most
    # A later run goes on where the first ended.
    more = [(1000 + i, "s0", r[2], r[3], r[4]) for i, r in enumerate(given[0][:20])]
    rows = dedup.accepted(stream(spark, f"{tmp_path}/in", [more]), "shard", "ord", most=most, ttl_ms=None if most else 86_400_000)
    assert dedup.start(rows, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(240)
    assert sorted(r.ord for r in spark.read.schema("ord long, accepted boolean").json(f"{tmp_path}/out").where("accepted").collect()) == loop([*given, more], True, most)[0]


def test_marks_end_with_their_time(spark, tmp_path):
    ship_package(spark)
    same = [[(k, "s", "u", "t", "c")] for k in range(2)]
    for ttl, want in ((1, [0, 1]), (86_400_000, [0])):
        rows = dedup.accepted(stream(spark, f"{tmp_path}/in{ttl}", same), "shard", "ord", ttl_ms=ttl)
        assert dedup.start(rows, f"{tmp_path}/out{ttl}", f"{tmp_path}/cp{ttl}").awaitTermination(240)
        assert sorted(r.ord for r in spark.read.schema("ord long, accepted boolean").json(f"{tmp_path}/out{ttl}").where("accepted").collect()) == want


def test_global_equals_loop_and_replays(spark, tmp_path):
    given = batches(2)
    want, marked = loop(given)
    state = dedup.StateTable(spark, f"{tmp_path}/state")
    run = lambda mark: dedup.accept_into(stream(spark, f"{tmp_path}/in{mark}", given), f"{tmp_path}/out", state, f"{tmp_path}/{mark}", "ord").awaitTermination(240)
    assert run("a")
    read = lambda: sorted(r.ord for r in spark.read.schema("ord long").parquet(f"{tmp_path}/out/batch=*").collect())
    assert read() == want
    assert sorted((r.kind, r.key) for r in state.before().collect()) == sorted((kind, key) for (_, kind), keys in marked.items() for key in keys)
    assert run("b") and read() == want  # all batches once more, without the marks of the first run's progress
    few = dedup.StateTable(spark, f"{tmp_path}/state", most=5).before().collect()
    for kind in range(3):
        assert [r.key for r in sorted(few, key=lambda r: (r.batch, r.at)) if r.kind == kind] == marked[None, kind][-5:]
