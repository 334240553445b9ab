"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrywork.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root of nodes, and of each the lists of its siblings to the left and right on every level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, p in enumerate(at):
            run = p // 8 * 8
            paths[k].append(("".join(level[run:p]), "".join(level[p + 1 : run + 8])))
        level, at = [H("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([n[2] for n in sorted(by[x], key=lambda n: n[:3])]) for x in langs}
    root, over = tree([trees[x][0] for x in langs])
    out = []
    for x, above in zip(langs, over):
        for (_, _, h, r), path in zip(sorted(by[x], key=lambda n: n[:3]), trees[x][1]):
            path = path + above
            at = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                at = leaf(r[0], r[3], r[2], r[4], r[1].translate({c: c + 32 for c in range(65, 91)}))
            for left, right in path:
                at = H(left + at + right)
            out.append((r[0], h, trees[x][0], root, H("".join(a + b for a, b in path)), at, at == root))
    return out


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(spark, path):
    return sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, path).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 9, 200])
def test_equals_plain_tree(spark, tmp_path, n):
    rows = [(i * 7 % n, f"Text Ä {i}" * (i % 4), ["en", "de", None, "é", "x" * i][i % 5], "s" if i % 3 else None, i) for i in range(n)]
    assert found(spark, table(spark, tmp_path, rows)) == sorted(brute(rows), key=repr)


def test_several_blocks_and_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 64), monkeypatch.setattr(merkle, "DEPTH", 2)
    rows = [(i, f"Row {i}", "en" if i % 7 else "de", "s", i) for i in range(5000)]
    assert found(spark, table(spark, tmp_path, rows)) == sorted(brute(rows), key=repr)
    monkeypatch.setattr(merkle, "FEW", 0)  # joins by shuffle
    assert found(spark, str(tmp_path)) == sorted(brute(rows), key=repr)


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 3 + [(1, "a", "en", "s", 1), (1, "A", "en", "s", 1), (1, "A", "en", "s", 1), (0, "", "en", "", 0), (2, "Long " * 40_000, "", "s", 5)]
    assert found(spark, table(spark, tmp_path, rows)) == sorted(brute(rows), key=repr)


def test_empty_table_and_clashing_names(spark, tmp_path):
    assert found(spark, table(spark, tmp_path, [])) == []
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "pos long, h string, g string").withColumn("salt", F.lit(1))
    got = merkle.manifest(rows, merkle.leaf(F.col("h")), group="g", order="pos", carry=[F.col("salt"), F.col("h").alias("text")]).collect()
    assert {(r.pos, r.text, r.salt) for r in got} == {(1, "a", 1), (2, "b", 1)} and {r.root for r in got} == {H(leaf("a") + leaf("b"))}


def test_sql_equals_plain_tree(tmp_path):
    rows = [(i, f"Text Ä {i}", ["en", "de", None][i % 3], "s", i) for i in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op11_merkle_manifest']})").fetchall(), key=repr) == sorted(brute(rows), key=repr)
