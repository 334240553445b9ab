"""Recorded searches: what was recorded comes back, pushed filters read fewer parts, rounds come as a stream."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from quarrywork.operators import web as B
from quarrywork.sources import recorded_search as S

ROWS = [(f"q{k % 40}", k // 40, f"https://h{k}", None if k % 7 == 0 else f"t {k}", "word " * (k % 90)) for k in range(400)]
ROWS += [("q3", 99, "https://again", "ü\n\"x\"", None), ("q3", 99, "https://again", "ü\n\"x\"", None), ("", 0, "e", "e", ""), ("ü é", 0, "u", "u", "u"), (None, None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, S.HITS)


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    S.register(spark)
    path = f"{tmp_path_factory.mktemp('web')}/rec"
    assert S.rounds(path) == 0
    assert S.record(frame(spark, ROWS[:150]), path, parts=16) == 0
    assert S.record(frame(spark, []), path) == 1
    assert S.record(frame(spark, ROWS[150:]), path, parts=5) == 2
    return path


def read(spark, folder):
    return spark.read.format(S.NAME).load(folder)


def test_all_rows_come_back(spark, folder):
    assert plain(read(spark, folder).collect()) == plain(ROWS)
    assert plain(read(spark, f"file://{folder}").collect()) == plain(ROWS)
    assert read(spark, f"{folder}-none").count() == 0


@pytest.mark.parametrize("where, keep", [
    ("query = 'q3'", lambda q: q == "q3"), ("query IN ('q1', 'ü é', 'nobody')", lambda q: q in ("q1", "ü é")), ("query = ''", lambda q: q == ""),
    ("query = 'nobody'", lambda q: False), ("query IS NULL", lambda q: q is None), ("query = 'q3' AND query = 'q4'", lambda q: False), ("query = 'q3' OR rank = 0", None),
])
def test_filters_are_right(spark, folder, where, keep):
    want = [r for r in ROWS if (keep(r[0]) if keep else r[0] == "q3" or r[1] == 0)]
    assert plain(read(spark, folder).where(where).collect()) == plain(want)
    assert plain(read(spark, folder).where(where).where("rank < 5").collect()) == plain(r for r in want if r[1] is not None and r[1] < 5)


def test_pushed_filter_reads_fewer_parts(spark, folder):
    whole = S.Recorded(folder)
    n = len(whole.partitions())
    one = S.Recorded(folder)
    other = In(("href",), ("x",))
    assert list(one.pushFilters([EqualTo(("query",), "q3"), other])) == [other]
    assert 0 < len(one.partitions()) <= 2 < n  # one part of either round
    tasks = lambda rows: rows.rdd.getNumPartitions()
    assert tasks(read(spark, folder).where("query = 'q3'")) <= 2 < tasks(read(spark, folder)) == n


def test_unfinished_round_is_not_read_and_written_again(spark, folder, tmp_path):
    path = f"{tmp_path}/rec"
    S.record(frame(spark, ROWS[:20]), path)
    frame(spark, ROWS[20:40]).withColumns({"of": F.lit(1), "part": F.lit(0)}).write.partitionBy("of", "part").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/round=1")
    assert plain(read(spark, path).collect()) == plain(ROWS[:20])
    assert S.record(frame(spark, ROWS[20:30]), path) == 1
    assert plain(read(spark, path).collect()) == plain(ROWS[:30])


def test_stream_gives_each_round_once(spark, tmp_path):
    path, seen = f"{tmp_path}/rec", []
    S.register(spark)

    def run():
        q = spark.readStream.format(S.NAME).load(path).writeStream.foreachBatch(lambda rows, nr: seen.append(plain(rows.collect()))).option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    S.record(frame(spark, ROWS[:60]), path)
    run()
    S.record(frame(spark, ROWS[60:70]), path)
    S.record(frame(spark, ROWS[70:90]), path)
    run(), run()
    assert [s for s in seen if s] == [plain(ROWS[:60]), plain(ROWS[60:90])]


def test_feeds_a_search_flow(spark, folder, tmp_path):
    asked = spark.createDataFrame([(1, "q1"), (2, "q30"), (3, "nobody")], "query_id long, text string")
    flow = lambda hits: plain(B.three_strategies(asked, hits, 7).drop("content").collect())
    assert flow(read(spark, folder)) == flow(frame(spark, ROWS)) != []
