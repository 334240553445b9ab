"""Versions under several writers, and the result cache."""

import threading

import pytest
from pyspark.sql import functions as F

from quarrywork.sources.versions import Conflict, Log, ResultCache, Versions


def test_parallel_writers_lose_nothing(spark, tmp_path):
    root, numbers, failed = f"file://{tmp_path}/v", [], []

    def write(k):
        try:
            numbers.append(Versions(spark, root).write(spark.range(k + 1), f"w{k}", most=5))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed and sorted(numbers) == [1, 2, 3, 4, 5]
    store = Versions(spark, root)
    rows = store.manifest().collect()
    assert {r.created for r in rows} == {f"w{k}" for k in range(5)} and [r.version for r in rows if r.current] == [5]
    assert all(store.at(r.version).count() == int(r.created[1:]) + 1 for r in rows)


def test_a_number_is_given_once(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if log.add(1, {"k": k}) else None) for k in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and log.newest() == (1, {"k": won[0]})
    store = Versions(spark, f"file://{tmp_path}/busy", tries=2)
    store.log.add = lambda *_: False
    with pytest.raises(Conflict):
        store.write(spark.range(1), "x")


def test_readers_finish_on_retired_versions(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/v", grace=3600)
    store.write(spark.range(7), "old", most=1)
    reader = store.current()
    store.write(spark.range(2), "new", most=1)
    assert reader.count() == 7 and store.current().count() == 2
    with pytest.raises(ValueError):
        store.at(1)
    store.vacuum(0)
    assert len(list(tmp_path.glob("v/rows-*"))) == 1 and store.current().count() == 2
    store.write(spark.range(3), "third", most=2)
    store.rollback(2)
    assert store.current().count() == 2 and [r.version for r in store.manifest().collect()] == [3, 2]


def test_cache(spark, tmp_path):
    cache = ResultCache(spark, f"file://{tmp_path}/c", ttl=100, most=3)
    keys = spark.createDataFrame([(k,) for k in ["a", "b", "c", "d", "e", None]], "key string")
    look = lambda now: {r.key: r.result for r in cache.get(keys, now).where("hit").collect()}
    put = lambda at, **kv: cache.set(spark.createDataFrame(list(kv.items()) + [(None, "lost")], "key string, result string"), F.lit(at))
    assert look(0) == {} and cache.compact(0) == 0
    put(10, a="1", b="2")
    assert look(10) == {"a": "1", "b": "2"} and look(109) == look(10) and look(110) == {}
    put(20, a="3")
    assert look(115) == {"a": "3"}
    put(30, c="4", d="5")  # b is the oldest of four keys
    assert look(30) == {"a": "3", "c": "4", "d": "5"}
    assert cache.compact(30) == 3 and look(30) == {"a": "3", "c": "4", "d": "5"}
    put(40, e="6", c="7")
    assert look(40) == {"c": "7", "d": "5", "e": "6"} and look(131) == {"c": "7", "e": "6"}
    assert cache.compact(131) == 2 and look(131) == {"c": "7", "e": "6"}
    # A compaction that is overtaken by another one does not undo it; deltas set meanwhile stay.
    other, add = ResultCache(spark, f"file://{tmp_path}/c", ttl=100, most=3), cache.base._commit

    def late(change):
        other.compact(131)
        return add(change)

    cache.base._commit = late
    with pytest.raises(Conflict):
        cache.compact(131)
    cache.base._commit = add
    assert look(131) == {"c": "7", "e": "6"}
