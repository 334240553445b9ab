"""Counters and the buffered sink: equal to one aggregate over all rows, whatever comes again."""

import random

import pytest
from pyspark.sql import functions as F

from quarrywork.streaming.counters import BufferedSink, Counters

SCHEMA = "nr long, domain string, ok boolean, size long, url string"


def rows(n=900, seed=3):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    return [(k, pick("a", "a", "b", None), pick(True, False, None), pick(None, rng.randrange(1000)), pick(None, f"u{rng.randrange(300)}")) for k in range(n)]


def counters(spark, path, **more):
    return Counters(spark, path, ["domain"], F.col("ok"), F.col("size"), F.col("url"), F.col("url"), **more)


def exact(given):
    out = {}
    for domain in {r[1] for r in given}:
        own = [r for r in given if r[1] == domain]
        ok = sum(r[2] is True for r in own)
        out[domain] = (len(own), ok, round(ok * 100 / len(own), 9), sum(r[3] or 0 for r in own))
    return out


def plain(totals):
    return {r.domain: (r.n, r.n_ok, round(r.success_rate, 9), r.total) for r in totals.collect()}


@pytest.mark.parametrize("deltas", [2, 100])
def test_counters_equal_one_aggregate_and_replays_change_nothing(spark, tmp_path, deltas):
    given = rows()
    c = counters(spark, f"{tmp_path}/c", deltas=deltas)
    parts = [given[:100], given[100:101], [], given[101:600], given[600:]]
    frames = [spark.createDataFrame(p, SCHEMA) for p in parts]
    for k, frame in enumerate(frames):
        assert c.add(frame, k)
        assert not c.add(frame, k)
    again = counters(spark, f"{tmp_path}/c", deltas=deltas)  # as after a restart
    assert not any(again.add(frame, k) for k, frame in enumerate(frames))
    assert plain(again.totals()) == exact(given)
    for r in again.totals(quantiles=[0.1, 0.5, 0.9], top=3).collect():
        own = [g for g in given if g[1] == r.domain]
        urls, sizes = [g[4] for g in own if g[4]], sorted(g[3] for g in own if g[3] is not None)
        assert abs(r.n_ids - len(set(urls))) <= 0.03 * len(set(urls))
        for q, v in zip([0.1, 0.5, 0.9], r.quantiles):
            assert abs(sum(s <= v for s in sizes) / len(sizes) - q) < 0.05
        counts = {u: urls.count(u) for u in set(urls)}
        assert [t["count"] for t in r.top_items] == sorted(counts.values(), reverse=True)[:3]
        assert all(counts[t["item"]] == t["count"] for t in r.top_items)
    one = again.totals(by=[]).first()
    assert one.n == len(given) and one.n_ok == sum(r[2] is True for r in given)


def test_streams_share_a_ledger_and_nothing_counted(spark, tmp_path):
    c = counters(spark, f"{tmp_path}/c")
    assert c.totals().count() == 0
    zero = c.totals(by=[]).first()
    assert (zero.n, zero.n_ok, zero.success_rate, zero.total, zero.n_ids, zero.quantiles) == (0, 0, 0, 0, 0, None) and not zero.top_items
    given = rows(40)
    for stream, part in (("x", given[:20]), ("y", given[20:])):
        assert c.add(spark.createDataFrame(part, SCHEMA), 0, stream)
    assert c.compact() and not c.compact()
    assert plain(c.totals()) == exact(given)
    with pytest.raises(ValueError):
        c.add(spark.createDataFrame(given, SCHEMA), 1, "../x")


def test_delta_of_an_unfinished_attempt_is_not_counted(spark, tmp_path):
    given = rows(60)
    c = counters(spark, f"{tmp_path}/c")
    c.add(spark.createDataFrame(given[:30], SCHEMA), 0)
    c.partial(spark.createDataFrame(given[30:], SCHEMA)).write.parquet(f"{tmp_path}/c/delta-lost")  # fails before the ledger
    assert plain(c.totals()) == exact(given[:30])
    c.add(spark.createDataFrame(given[30:], SCHEMA), 1)
    assert plain(c.totals()) == exact(given)


def test_buffer_flushes_by_size_by_hand_and_at_the_end(spark, tmp_path):
    given, root = rows(25), f"{tmp_path}/s"
    frame = lambda lo, hi: spark.createDataFrame(given[lo:hi], SCHEMA).coalesce(1)
    read = lambda s: sorted(r.nr for r in s.rows(SCHEMA).collect())
    s = BufferedSink(spark, root, size=10)
    assert read(s) == [] and s.stats() == {"entries_written": 0, "entries_buffered": 0, "flushes": 0, "file_size": 0}
    assert s.add(frame(0, 4), 0) and s.add(frame(4, 4), 1) and s.add(frame(4, 8), 2)
    assert read(s) == [] and s.stats()["entries_buffered"] == 8
    s = BufferedSink(spark, root, size=10)  # what is buffered outlives the writer
    assert not s.add(frame(0, 4), 0) and s.add(frame(8, 12), 3)
    assert read(s) == list(range(12)) and s.stats()["flushes"] == 1
    assert s.add(frame(12, 14), 4) and s.flush() == 2 and s.flush() == 0 and read(s) == list(range(14))
    # A flush that wrote its rows but not its entry: they are not read, and written again.
    frame(14, 20).write.json(f"{root}/flushed/main/3")
    assert read(s) == list(range(14))
    with BufferedSink(spark, root, size=10) as s:
        s.add(frame(14, 20), 5)
        with BufferedSink(spark, root, size=1, stream="other") as o:
            o.add(frame(20, 25), 0)
    assert read(s) == list(range(25)) and s.stats()["entries_written"] == 25 and s.stats()["file_size"] > 0
    assert sorted(s.rows(SCHEMA).collect(), key=lambda r: r.nr) == sorted(spark.createDataFrame(given, SCHEMA).collect(), key=lambda r: r.nr)


def test_stream_over_a_new_checkpoint_changes_nothing(spark, tmp_path):
    given = rows(90)
    for lo in range(0, 90, 30):
        spark.createDataFrame(given[lo : lo + 30], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    c, s = counters(spark, f"{tmp_path}/c"), BufferedSink(spark, f"{tmp_path}/s", size=50)
    for mark in "ab":
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(lambda rows, nr: (c.add(rows, nr), s.add(rows, nr)) and None).option("checkpointLocation", f"{tmp_path}/{mark}").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    assert plain(c.totals()) == exact(given)
    assert s.stats()["entries_written"] == 60 and s.flush() == 30
    assert sorted(r.nr for r in s.rows(SCHEMA).collect()) == list(range(90))
