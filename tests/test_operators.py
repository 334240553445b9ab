"""Operators against plain Python."""

import difflib
import json

import numpy as np
from pyspark.sql import functions as F

from quarrywork.functions import classify as C, html as H, json_repair as J, scoring as S, text as X, urls as U
from quarrywork.operators import chunking, citations as K, dedup as D, expand as E, report as R, search as V, validate as Y
from quarrywork.plans.pipelines import curate


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_accepted_is_the_greedy_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *(None if rng.random() < 0.1 else f"{k}{int(rng.integers(0, 12))}" for k in "utc")) for i in range(60)]
    marked, keep = set(), []
    for i, *keys in rows:
        own = {(n, k) for n, k in enumerate(keys) if k is not None}
        if not own & marked:
            marked |= own
            keep.append(i)
    df = spark.createDataFrame(rows, "ord long, u string, t string, c string")
    assert sorted(r.ord for r in D.accepted(df, ["u", "t", "c"], "ord").collect()) == keep


def test_accepted_settles_long_chains(spark, monkeypatch):
    """A chain in which each row shares a key with the next: every other row, whatever the rounds."""
    for n, few in ((300, D.FEW), (13, 0)):
        monkeypatch.setattr(D, "FEW", few)
        df = spark.createDataFrame([(i, f"k{i // 2}", f"k{(i + 1) // 2}") for i in range(n)], "ord long, u string, t string")
        assert sorted(r.ord for r in D.accepted(df, ["u", "t"], "ord").collect()) == list(range(0, n, 2))


def test_accepted_keeps_rows_without_keys(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, None), (2, None, None), (3, "a", None), (4, "a", None)], "ord long, u string, t string")
    for few in (D.FEW, 0):
        monkeypatch.setattr(D, "FEW", few)
        assert sorted(r.ord for r in D.accepted(df, ["u", "t"], "ord").collect()) == [1, 2, 3]
        assert D.accepted(df.where("false"), ["u", "t"], "ord").count() == 0


def test_dedup_modes(spark):
    df = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", "t1"), (3, "u2", "t2")], "ord long, url string, title string")
    assert sorted(r.ord for r in D.accepted(df, ["url", "title"], "ord").collect()) == [1, 3]
    assert sorted(r.ord for r in D.checked(df, ["url", "title"], ["ord"]).collect()) == [1]
    assert sorted(r.ord for r in D.keep_first(df, "title", ["ord"]).collect()) == [1, 3]


def test_membership(spark):
    seen = spark.createDataFrame([("http://www.A.com/x/", "Old title", "old")], "url string, title string, content string")
    new = spark.createDataFrame([("http://a.com/x?y=1", "n", "n"), ("http://b.com", "OLD  title", "x"), ("http://c.com", "z", "Old"), ("http://d.com", "q", "q")], "url string, title string, content string")
    got = {r.url: (r.is_duplicate_url, r.is_duplicate_content) for r in D.membership(new, D.state_of(seen)).collect()}
    assert got == {"http://a.com/x?y=1": (True, False), "http://b.com": (False, True), "http://c.com": (False, True), "http://d.com": (False, False)}


def test_similar_to_recent(spark):
    texts = ["the quick brown fox jumps", "the quick brown fox jumped", "something else entirely", "the quick brown fox jumps!"]
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "ord long, g string, text string")
    kept = []
    for t in texts:
        if not any(difflib.SequenceMatcher(None, t, k).ratio() > 0.85 for k in reversed(kept)):
            kept.append(t)
    assert [r.text for r in D.similar_to_recent(df, "g", "ord", "text").orderBy("ord").collect()] == kept


def test_text_functions(spark):
    r = one(
        spark, X.normalize_words(F.lit("  Ünder, the  TREE! ")).alias("a"), X.year(F.lit("in 1820 and 1987")).alias("b"), X.publication_date(F.lit("on 3/4/2020")).alias("c"),
        X.truncate_sentences(F.lit("One two. Three four. " + "x" * 100), 80).alias("d"), X.strip_boilerplate(F.lit("a Cookie stuff Accept b")).alias("e"), X.paragraphs(F.lit("short\n\n" + "y" * 60)).alias("f"),
        X.token_estimate(F.lit("123456789")).alias("g"), X.year(F.lit("none")).alias("h"),
    )
    assert (r.a, r.b, r.c, r.d, r.f, r.g, r.h) == ("ünder the tree", 1987, "3/4/2020", "One two. Three four....", ["y" * 60], 2, None)
    assert r.e.split() == ["a", "b"]


def test_density_counts_words(spark):
    r = one(spark, F.round(S.density(F.lit("farming wheat in the punjab today now"), F.lit("wheat")), 6).alias("s"))
    n = 9
    assert r.s == round(min(1, 4 / n * 0.5 + 1 / n * 0.3 + 1 / n * 0.2 + 0.2), 6)


def test_scores(spark):
    r = one(
        spark, S.inverse_distance(F.lit(1.0)).alias("a"), S.inverse_distance(F.lit(-1.0)).alias("b"), S.overlap_relevance(F.lit("red soil"), F.lit("soil"), F.lit("http://x/soil"), F.lit("red soil")).alias("c"),
        S.candidate_quality(F.lit(True), F.lit(3), F.lit("x" * 201)).alias("d"), S.source_credibility(F.lit(9.5), F.lit("a"), F.lit("d"), F.lit(50)).alias("e"), S.freshness(F.lit(None)).alias("f"),
        S.candidate_relevance(F.lit(False), F.lit(9), F.lit(9), F.lit(9)).alias("g"),
    )
    assert (r.a, r.b, round(r.c, 6), r.d, r.e, r.f, round(r.g, 6)) == (0.5, 0.0, 1.0, 1.0, 9.5, 5.0, 0.95)


def test_classify(spark):
    r = one(spark, C.genre(F.lit("Census of farms")).alias("a"), C.category(F.lit("http://x.gov.in"), F.lit("t"), F.lit(False)).alias("b"), C.category(F.lit("u"), F.lit("A survey"), F.lit(True)).alias("c"),
            C.is_navigation(F.lit("home about contact")).alias("d"), C.strategy(F.lit("wheat vs rice")).alias("e"), C.tags(F.lit("drip water"), (F.lit("article"),)).alias("f"))
    assert tuple(r) == ("survey", "government_content", "technical_report", True, "comparative_analysis", ["article", "irrigation"])


def test_urls(spark):
    r = one(spark, U.normalize(F.lit(" HTTP://www.A.com/x/?q ")).alias("a"), U.is_pdf(F.lit("http://a/b.pdf?x")).alias("b"), U.is_pdf(F.lit("http://a/b?f=pdf")).alias("c"), U.is_pdf(F.lit("http://pdf.a/b")).alias("d"),
            U.allowed_by_robots(F.lit("http://a.org/pdf/x"), F.lit("Disallow: /pdf")).alias("e"), U.allowed_by_robots(F.lit("http://a.org/y"), F.lit(None)).alias("f"))
    assert tuple(r) == ("http://a.com/x/", True, True, False, False, True)


def test_json_repair(spark):
    good = {"k": 1, "s": "a"}
    cases = [json.dumps(good), f"```json\n{json.dumps(good)}\n```", "{'k': 1, 's': 'a'}", '{"k": 1, "s": "a",}', f"Sure: {json.dumps(good)} done", "{'k': 1, 's': 'a',} said"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*cases, "no object", '{"s": "a"}', None])], "i long, raw string")
    got = {r.i: r.j for r in df.select("i", J.repaired("raw", ["k"]).alias("j")).collect()}
    assert all(json.loads(got[i]) == good for i in range(len(cases))) and got[6] is got[7] is got[8] is None


def test_html(spark):
    page = "<html><head><title> A b </title><meta name='author' content='Me'><script>x<y</script></head><body><nav>menu</nav><p>" + "Long words here. " * 20 + "</p><table><tr><td>1</td><td>2</td></tr></table></body></html>"
    df = spark.createDataFrame([(page,), (None,)], "html string")
    r = df.select(H.title("html").alias("t"), H.main_text("html").alias("m"), H.page_text("html").alias("p"), H.tables("html").alias("b"), H.metadata("html").alias("d"), H.strip_tags("html").alias("s")).first()
    assert r.t == "A b" and r.m.startswith("Long words") and "menu" not in r.p and r.b == [[["1", "2"]]] and r.d == {"author": "Me"} and "menu" not in r.s


def test_citations(spark):
    df = spark.createDataFrame([("First claim here. Second one.", ["First claim here", "Second one"], [" [DB-1-1]", " [WEB-1-2]"])], "t string, s array<string>, m array<string>")
    assert df.select(K.place("t", "s", "m")).first()[0] == "First claim here [DB-1-1]. Second one [WEB-1-2]."
    facts = ["# Heading with many words in it that goes on and on", "The study shows that ten percent of all the plants grow", "Too short", "- list item of the study that is long enough to count here"]
    assert one(spark, K.factual(F.array(*[F.lit(f) for f in facts])).alias("f")).f == [facts[1]]
    assert one(spark, K.format_ids(F.array(F.lit("a"), F.lit("b")), "superscript").alias("f")).f == "<sup>[a][b]</sup>"


def test_chunks(spark):
    texts = {1: " ".join(f"w{i}" for i in range(600)), 2: "a b  c", 3: "", 4: " ".join(["x"] * 256), 5: " ".join(["x"] * 240)}
    got = chunking.chunk(spark.createDataFrame(list(texts.items()), "id long, text string"), "text").collect()
    assert sorted((r.id, r.chunk_id) for r in got) == [(1, 0), (1, 1), (1, 2), (2, 0), (4, 0), (5, 0)]
    words = texts[1].split()
    for r in got:
        if r.id == 1:
            s = r.chunk_id * 231
            assert r.chunk_text.split() == words[s : s + 256] and r.chunk_start == int(s / 600 * len(texts[1]))
    assert next(r for r in got if r.id == 2).chunk_text == "a b  c"


def test_ivf_recall(spark, sf):
    flat = V.index(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    queries = flat.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in V.top_k(queries, flat, 3).collect()}
    listed, centres = V.ivf(flat, 20)
    found = {(r.query_id, r.id) for r in V.top_k_ivf(queries, listed, centres, 3, probes=16).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_greedy_assignment(spark):
    agents = (("a", "wheat", "seed"), ("b", "soil", "ph"))
    texts = ["wheat", "wheat", "soil wheat", "nothing", "nothing", "ph"]
    load, want = [0, 0], []
    for t in texts:
        s = [2 * ("wheat" in t) + ("seed" in t), 2 * ("soil" in t) + ("ph" in t)]
        k = min((i for i in (0, 1) if s[i] == max(s)), key=lambda i: (load[i], i))
        load[k] += 1
        want.append("ab"[k])
    df = spark.createDataFrame(list(enumerate(texts)), "i long, q string")
    assert [r.agent for r in E.assigned(df, "i", "q", rows=agents).orderBy("i").collect()] == want


def test_expansion(spark):
    r = one(spark, E.expanded(F.lit("Pest on rice")).alias("a"), E.variants(F.lit("x farming")).alias("b"), E.parsed_list(F.lit("1. first long query here\n- second long query\nnoise\n2) short")).alias("c"), E.focused(F.lit("q"), F.lit("news"), 2024).alias("d"))
    assert (r.a, r.b) == (["Pest on rice", "Pest on rice agriculture", "Pest on rice farming", "Pest on rice plant pathology treatment"], ["x farming", "x farming best practices"])
    assert (r.c, r.d) == (["first long query here", "second long query"], "q latest news 2024")
    got = E.generated(spark, 20, ("a", "b", "c"), ("x", "y", "z"), ("1", "2", "3")).collect()
    assert len({g.query for g in got}) == len(got) == 20


def test_token_bucket(spark):
    df = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate([0, 0, 0, 10])], "k string, i long, t double")
    assert [r.delay for r in R.token_bucket(df, "k", "i", "t", 0.5, 2).orderBy("i").collect()] == [0.0, 0.0, 2.0, 0.0]


def test_first_errors_and_missing_columns(spark):
    df = spark.createDataFrame([(1, "t")], "ord long, title string")
    checked = Y.validated(df)
    assert "Missing required field: link" in checked.first().errors
    assert Y.first_errors(checked, "ord", 3).count() == 3


def test_curate(spark, sf):
    from quarrywork.plans.queries import records

    rows = records(spark, sf).withColumn("ord", F.col("doc_id"))
    got = curate(rows)
    assert 0 < got.count() < rows.count() and got.columns == rows.columns


def test_rag_answers_all_questions(spark, sf):
    from quarrywork.plans.queries import QUERIES

    assert {r.item_id for r in QUERIES["rag_pipeline"](spark, sf).select("item_id").collect()} == {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id").collect()}


def test_main_text_builds_nothing_else(spark, monkeypatch):
    """Only the readable text of a page is built where only that is asked for, and it is the same."""
    import pandas as pd

    pages = ["<html><body><p>" + "word " * 60 + "</p><table><tr><td>a</td></tr></table></body></html>", "<p>short</p><li>x</li>", "", None]
    want = [H._record(p, H.SILENT)["readable"] for p in pages]
    monkeypatch.setattr(H, "_record", None)
    assert H._readable.func(pd.Series(pages, dtype=object)).tolist() == want
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r.m for r in df.select(H.main_text("html").alias("m")).collect()] == want
