"""What queries write for their readers is written by many tasks, and read back whole."""

import json
import re

from pyspark.sql import DataFrame

from quarrywork.plans import record_queries as R
from quarrywork.plans.queries import QUERIES
from quarrywork.sources import readers


def test_numbers_of_lines_over_files(spark, sf, monkeypatch):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    monkeypatch.setattr(R, "FILE_CHARS", 100_000)
    got = QUERIES["jsonl_row_index"](spark, sf)
    assert len(got.inputFiles()) > 2
    assert sorted((r.row_idx, r.doc_id) for r in got.collect()) == list(enumerate(ids))


def test_arrays_of_several_files(spark, sf, monkeypatch):
    want = sorted((r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
    monkeypatch.setattr(R, "FILE_CHARS", 50_000)
    got = QUERIES["json_array_splits"](spark, sf)
    assert sorted((r.page_id, r.html) for r in got.collect()) == want


def test_line_numbers_in_a_file_stay(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({"x": f"{name}{i}"}) + "\n" for i in range(3)))
    read = lambda **k: {r.x: r.row_idx for r in readers.jsonl(spark, str(tmp_path), "x string", **k).collect()}
    assert read() == {"a0": 0, "a1": 1, "a2": 2, "b0": 0, "b1": 1, "b2": 2}
    assert read(over_all=True) == {"a0": 0, "a1": 1, "a2": 2, "b0": 3, "b1": 4, "b2": 5}


def test_stream_files_are_not_made_by_a_task_that_reads_all(spark, sf, monkeypatch):
    def refuse(*_):
        raise AssertionError("one task would read all texts")

    monkeypatch.setattr(DataFrame, "coalesce", refuse, raising=False)
    monkeypatch.setattr(type(spark.range(1)), "coalesce", refuse)
    assert R.document_stream(spark, sf).isStreaming


def test_structured_info_finds_terms_once(spark):
    from quarrywork.functions import content as T

    rows = spark.createDataFrame([("the of the que.",), ("",), (None,)], "text string")
    got = rows.select(T.structured_info("text", agri=("the", "of"), farm=("the",), region=("que",)).alias("i"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_extract_all", plan)) <= 2
    assert got.collect()[0].i.key_terms == ["the", "of"]
