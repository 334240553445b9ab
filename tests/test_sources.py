"""Sources, sinks, versions and streams on small files."""

import json

import pytest
from pyspark.sql import types as T

from quarrywork.schemas import CORPUS_RECORD
from quarrywork.sources import readers, sinks
from quarrywork.streaming import ingest


def test_jsonl(spark, tmp_path):
    lines = [json.dumps({"title": "a", "link": "l1", "source_domain": "x"}), "", "{broken", json.dumps({"title": "b", "source_domain": "y"}), json.dumps({"title": "c", "source_domain": "x", "unknown": 1})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    path = str(tmp_path / "a.jsonl")
    assert [(r.title, r.row_idx) for r in readers.jsonl(spark, path).orderBy("row_idx").collect()] == [("a", 0), ("b", 3), ("c", 4)]
    assert [r.title for r in readers.jsonl(spark, path, keep=readers.equal_domain("x")).orderBy("row_idx").collect()] == ["a", "c"]
    assert [r.title for r in readers.jsonl(spark, path, most=1).collect()] == ["a"]
    assert readers.jsonl(spark, path).drop("row_idx").schema == CORPUS_RECORD


def test_json_document_csv_and_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1},\n {"k": 2}]')
    schema = T.StructType([T.StructField("k", T.LongType())])
    assert sorted(r.k for r in readers.json_document(spark, str(tmp_path / "a.json"), schema).collect()) == [1, 2]
    assert readers.json_document(spark, str(tmp_path / "a.json"), schema, first=1).count() == 1
    (tmp_path / "q.csv").write_text('ID,question\n1,"a, b"\n2,c\n')
    assert [tuple(r) for r in readers.questions(spark, str(tmp_path / "q.csv")).orderBy("id").collect()] == [("1", "a, b"), ("2", "c")]
    (tmp_path / "t.txt").write_text("1\n2\n3\n")
    assert [r.value for r in readers.text_lines(spark, str(tmp_path / "t.txt"), head=2).collect()] == ["1", "2"]
    assert [r.value for r in readers.text_lines(spark, str(tmp_path / "t.txt"), tail=1).collect()] == ["3"]
    with pytest.raises(ValueError):
        readers.text_lines(spark, "x", head=1, tail=1)
    info = readers.file_info(spark, str(tmp_path / "t.txt")).first()
    assert (info.size_bytes, info.is_large) == (6, False)


def test_candidates_and_bootstrap(spark):
    hits = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "a"), (1, 1, 2, "c"), (1, 2, 1, "d")], "query_id long, strategy int, rank int, href string")
    assert [(r.position, r.href) for r in readers.candidates(hits, 3).orderBy("position").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    rows = spark.createDataFrame([("", "u", "t", "x")], "link string, url string, title string, content string")
    assert tuple(readers.bootstrap_state(rows).first()) == ("u", "t", "x")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"'), (2, "c")], "id long, text string")
    assert sinks.append_jsonl(rows, str(tmp_path / "j")) == 2 and sinks.append_jsonl(rows, str(tmp_path / "j")) == 2
    assert spark.read.schema(rows.schema).json(str(tmp_path / "j")).count() == 4
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).where("text = 'a \"b\"'").count() == 1
    results = spark.createDataFrame([(True, [(1,)]), (False, [(2,)])], "success boolean, data_entries array<struct<k:long>>")
    sinks.write_successes(results, str(tmp_path / "s"))
    assert [r.k for r in spark.read.schema("k long").json(str(tmp_path / "s")).collect()] == [1]
    assert json.loads(sinks.as_document(rows.limit(1)).first().document)["id"] == 1


def test_versions(spark, tmp_path):
    store = sinks.Versions(spark, str(tmp_path / "v"))
    for k in range(5):
        assert store.write(spark.range(k + 1), f"t{k}") == k + 1
    assert store.current().count() == 5
    assert sorted(r.version for r in store.manifest().collect()) == [3, 4, 5]
    store.rollback(3)
    assert store.current().count() == 3
    with pytest.raises(ValueError):
        store.rollback(1)
    rows = spark.createDataFrame([("a", v) for v in range(5)], "name string, version long")
    assert sorted(r.version for r in sinks.retained(rows, 2).collect()) == [3, 4]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("http://a.com/x", "t1", "c1"), ("http://b.com/x", "t1", "c2"), ("http://b.com/x", "t2", "c3"), ("http://www.a.com/x/", "t9", "c9")]
    src.joinpath("1.json").write_text("\n".join(json.dumps({"link": u, "title": t, "text_extracted": c, "source_domain": "d", "extraction_timestamp": "2024-01-01T00:00:00"}) for u, t, c in rows))
    stream = ingest.read_records(spark, str(src), CORPUS_RECORD)
    q = ingest.append_to(ingest.distinct_urls(stream).select("link"), str(tmp_path / "out"), str(tmp_path / "cp1"))
    assert q.awaitTermination(120)
    assert spark.read.schema("link string").json(str(tmp_path / "out")).count() == 2
    q = ingest.append_to(ingest.domain_counts(stream, "0 seconds"), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert q.awaitTermination(120)
