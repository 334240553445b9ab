"""Records, search flows, page reading, sources and citations against plain Python."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from quarrywork.functions import content as T, html as H, json_repair as J, text as X
from quarrywork.operators import citations as K, dedup as D, expand as E, records as Q, search as V, validate as Y, web as B
from quarrywork.plans.pipelines import build_index, cited_reports, curate
from quarrywork.schemas import CORPUS_RECORD
from quarrywork.sources import readers, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


HIT = "href string, title string, body string, full_content string, ord long"


def test_hits_become_valid_records(spark):
    text = "Rice farming in Punjab needs urea and black soil. Irrigation is done at night. " * 3
    rows = [("http://icar.gov.in/a.pdf", "Crop survey", "A snippet about wheat", text, 1), ("http://x.org/b", "News", "only the snippet of wheat in Kerala, which is long enough to be one", None, 2), ("", "no url", "x", "y", 3), ("http://c.org", None, "x", "y", 4), ("http://c.org", "", "x", "y", 5), ("http://d.org/e", "Empty", None, "", 6)]
    got = {r.link: r for r in Q.from_hits(spark.createDataFrame(rows, HIT), at=F.lit("2024-05-01").cast("timestamp")).collect()}
    assert set(got) == {"http://icar.gov.in/a.pdf", "http://x.org/b", "http://d.org/e"}
    first = got["http://icar.gov.in/a.pdf"]
    assert (first.genre, first.is_pdf, first.source_domain, first.crop_types, first.indian_regions, first.fertilizers, first.soil_types) == ("survey", True, "icar.gov.in", ["rice", "wheat"], ["punjab"], ["urea"], ["black soil"])
    assert first.watering_schedule == "Irrigation is done at night." and first.content_length == len(text) and first.extraction_timestamp == "2024-05-01T00:00:00"
    assert got["http://x.org/b"].text_extracted == rows[1][2] and got["http://d.org/e"].text_extracted == "" and got["http://d.org/e"].abstract is None
    made = Q.from_hits(spark.createDataFrame(rows, HIT))
    assert [f.name for f in made.schema] == [f.name for f in CORPUS_RECORD] and made.columns == [f.name for f in CORPUS_RECORD]
    assert sorted(r.link for r in curate(made.withColumn("ord", F.monotonically_increasing_id())).collect()) == ["http://icar.gov.in/a.pdf", "http://x.org/b"]
    assert Q.from_hits(spark.createDataFrame([], HIT)).count() == 0


def test_defaults_fill_every_field(spark):
    r = Q.defaulted(spark.createDataFrame([("http://a", None)], "url string, snippet string")).first()
    assert (r.title, r.link, r.text_extracted, r.abstract, r.genre, r.tags, r.relevance_score, r.content_length, r.is_pdf, r.data_type) == ("", "http://a", "", None, "article", [], 0.0, 0, False, "mixed")


PAGE = """<html><head><title> The  page </title><meta name="author" content=" Jo "><meta property="article:published_time" content="2024-01-02"><meta name="keywords" content="a, b"></head>
<body><header>Menu</header><nav>nav</nav><div class="Main-Content"><p>{}</p><ul><li>one</li><li>two</li><li>three</li></ul></div><ol><li>x</li></ol>
<table><tr><th>h1</th><th>h2</th></tr><tr><td>1</td><td><b>2</b> 3</td></tr><tr></tr></table><p>tail &amp; end</p><form>form words</form><footer>foot</footer><br></body></html>"""


def test_page_is_read_once_for_all_fields(spark):
    page = PAGE.format("Long words of the article. " * 20)
    df = spark.createDataFrame([(1, "http://a.org/x", page), (2, "http://blocked.example/x", page), (3, "http://b.org", "captcha " + page + " access denied"), (4, "http://c.org", "<html><p>short</p></html>" + " " * 600), (5, "http://d.org", None), (6, None, page)], "page_id long, url string, html string")
    r = df.where("page_id = 1").select(H.title("html").alias("t"), H.tables("html").alias("b"), H.lists("html").alias("l"), H.metadata("html").alias("m"), H.page_text("html").alias("p"), H.main_text("html").alias("w"), H.content("html").alias("c")).first()
    assert r.t.split() == ["The", "page"] and r.b == [[["h1", "h2"], ["1", "2 3"]]] and r.l == [["one", "two", "three"]]
    assert r.m == {"author": " Jo ", "article:published_time": "2024-01-02", "keywords": "a, b"} and "Menu" not in r.p and "tail & end" in r.p
    assert r.c.success and r.c.title == "The page" and r.c.content.startswith("Long words") and r.c.content.endswith("two three") and (r.c.author, r.c.publish_date) == ("Jo", "2024-01-02")
    plan = df.select(H.tables("html"), H.lists("html"), H.page_text("html"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = {a.page_id: a for a in B.articles(df, ("blocked.example",)).collect()}
    assert set(got) == {1, 6} and got[1].word_count == len(got[1].content.split()) and got[1].keywords == "a, b" and "form words" not in got[1].content
    bad = spark.createDataFrame([("<div><p>a<div>b</p></div></b><table><td>x",), ("<script>x</script",), ("",)], "html string")
    assert [x.p for x in bad.select(H.page_text("html").alias("p")).collect()][0].split() == ["a", "b", "x"]


def test_main_content_order_of_choices(spark):
    long, mid = "w " * 150, "p " * 40
    pages = [f"<article>{long}</article><div class='content'>{long}z</div>", f"<div class='post'>{long}</div><p>{mid}</p>", f"<p>{mid}</p><p>tiny</p><p>{mid}</p>", "<p>tiny</p>"]
    got = [r.m for r in spark.createDataFrame([(p,) for p in pages], "html string").select(H.page("html")["main"].alias("m")).collect()]
    assert got == [" ".join(long.split()), " ".join(long.split()), " ".join((mid + mid).split()), ""]


def test_abstract_of_relevant_paragraphs(spark):
    para = lambda word, n: (word + " ") * n
    text = "\n\n".join([para("nothing", 10).strip(), para("farm", 60).strip(), para("crop", 40).strip(), para("soil", 30).strip()])
    want = (para("farm", 60).strip() + " " + para("crop", 40).strip())
    r = one(spark, T.enhanced_abstract(F.lit(text)).alias("a"), T.enhanced_abstract(F.lit("plain words")).alias("b"), T.enhanced_abstract(F.lit("")).alias("c"), T.enhanced_abstract(F.lit(para("farm", 200).strip())).alias("d"), T.best_paragraphs(F.lit(text), ("crop", "farm")).alias("e"))
    assert r.a == want and r.b == "plain words" and r.c == "" and r.d == (para("farm", 200).strip())[:500] + "..."
    assert r.e == para("farm", 60).strip() + "\n\n" + para("crop", 40).strip()
    r = one(spark, T.structured_info(F.lit(None).cast("string")).alias("i")).i
    assert (r.is_relevant, r.relevance_score, r.key_terms, r.paragraph_count) == (False, 0.0, [], None)
    r = one(spark, T.structured_info(F.lit("wheat rice Wheat in the Punjab farming"), F.lit("Rice")).alias("i")).i
    assert r.key_terms == ["wheat", "rice", "farming"] and r.regions_mentioned == ["punjab"] and r.is_relevant


def test_terms_of_several_words_count_once(spark):
    texts = ["organic farming and farming", "Agri-Tech, up and UP!", "seed drill seed", "", "food security food", "farming-organic farming"]
    terms = ("farming", "organic farming", "agri-tech", "up", "seed", "seed drill", "food security")
    pattern = X.term_pattern(terms)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.term_count("t", terms).alias("a"), F.regexp_count("t", F.lit(pattern)).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_salvage_and_schema(spark):
    raw = 'x "a": "1", "b": 2.5, "c": ["p", "q"], "d": "say", "a": "z" , "e": []'
    got = json.loads(one(spark, J.salvaged(F.lit(raw)).alias("s")).s)
    assert got == {"a": "z", "b": 2.5, "c": ["p", "q"], "d": "say", "e": []}
    assert one(spark, J.salvaged(F.lit("nothing here")).alias("s")).s is None
    cases = {'{"domain": "x", "relevance_score": 0.5}': True, '{"domain": "x"}': False, '{"domain": 1, "relevance_score": 0.5}': False, '{"domain": "x", "relevance_score": 1.5}': False, '{"domain": "x", "relevance_score": "a"}': False, "[1]": False, "": False, '{"domain": "x", "relevance_score": 0, "key_insights": "no"}': False}
    rows = spark.createDataFrame([(k,) for k in cases], "j string").select("j", J.conforms("j", J.ANALYSIS_SCHEMA).alias("ok")).collect()
    assert {r.j: r.ok for r in rows} == cases
    r = one(spark, J.merged_analysis(J.parsed(F.lit('Sure: {"domain": "d", "relevance_score": 1, "key_insights": ["1","2","3","4","5","6"]} ok'))).alias("m"), J.merged_analysis(J.parsed(F.lit(None).cast("string"))).alias("n")).asDict()
    assert (r["m"].domain, r["m"].relevance_score, len(r["m"].key_insights)) == ("d", 1.0, 5) and (r["n"].domain, r["n"].relevance_score, r["n"].data_points) == ("general", 0.5, [])


def test_type_messages(spark):
    r = spark.createDataFrame([('{"title": 1, "tags": "x", "is_pdf": true, "content_length": 2.5, "relevance_score": true}',), ("no json",)], "record string").select(Y.type_errors().alias("e")).collect()
    assert [m.split(":")[0] for m in r[0].e] == ["Invalid type for title", "Invalid type for tags", "Invalid type for content_length"] and r[1].e == []


def test_ratio_matches_equal_all_pairs(spark):
    asked = [(1, "The red soil of the south"), (2, "x"), (3, ""), (4, "Completely other words here"), (5, "the red soil of the North!")]
    known = [("A", "the red soil of the south."), ("A", "other"), ("B", "red soil in the south"), ("C", "words here, completely other"), ("D", "the red soil of the south"), ("E", "X")]
    for least in (0.4, 0.75, 0.95):
        want = {}
        for i, s in asked:
            best = {}
            for c, t in known:
                r = difflib.SequenceMatcher(None, s.lower(), t.lower()).ratio()
                if r >= least:
                    best[c] = max(best.get(c, 0), r)
            for rank, (c, r) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3], 1):
                want[i, c] = (round(r, 9), rank)
        got = K.matching_texts(spark.createDataFrame(asked, "sent_id long, sentence string"), spark.createDataFrame(known, "citation_id string, sentence string"), least).collect()
        assert {(r.sent_id, r.citation_id): (round(r.similarity, 9), r["rank"]) for r in got} == want


def test_citation_lists(spark):
    r = one(spark, K.reference_list(F.array(*[F.struct(F.lit(f"WEB-1-{k}").alias("citation_id"), F.lit("T" * 100).alias("title"), F.lit(None).cast("string").alias("source")) for k in range(25, 0, -1)])).alias("l"), K.with_note(F.lit("t"), F.array().cast("array<string>"), F.array(F.lit("a"))).alias("n"))
    lines = r.l.split("\n")
    assert len(lines) == 21 and lines[0] == "   [WEB-1-1] - " + "T" * 80 + " (unknown)" and lines[-1] == "   ... and 5 more citations available" and r.n == "t"
    rows = [("q", 1, True, [f"[{k}] c{k}" for k in range(1, 12)], 1.0), ("q", 2, True, ["[1] c1", "[2] new"], 2.0), ("q", 3, False, ["[1] lost"], 9.0), ("p", 1, False, [], 1.0)]
    df = spark.createDataFrame(rows, "g string, ord int, success boolean, citations array<string>, execution_time double")
    got = {r.g: r for r in K.merged(df, "g").collect()}
    assert got["q"].citations == [f"[{k}] c{k}" for k in range(1, 12)] + ["[12] new"] and (got["q"].total_time, got["q"].failed_agents) == (3.0, 1) and not got["p"].success and got["p"].citations == []
    assert {r.g: r.citations for r in K.merged(df, "g", compat=True).collect()}["q"][9:11] == ["[10]  c10", "[11]  c11"]


def test_selection_of_candidates(spark):
    rows = [("q", k, 0.1 * k, (k * 3) % 5 / 4) for k in range(1, 9)] + [("few", 1, 0.5, 0.1), ("few", 2, 0.2, 0.9)]
    df = spark.createDataFrame(rows, "query string, rank int, estimated_quality double, relevance_score double")
    good = [r for r in rows if r[0] == "q" and r[2] >= 0.3]
    want = sorted(r[1] for r in sorted(good, key=lambda r: (-r[3], -r[2], r[1]))[:3])
    got = B.selected(df, "query", 3).collect()
    assert sorted(r["rank"] for r in got if r.query == "q") == want and [r["rank"] for r in got if r.query == "few"] == [1]
    chosen = B.selected(df.withColumn("chosen", F.array(F.lit(9), F.lit(2), F.lit(1))), "query", 3, chosen="chosen").collect()
    assert sorted(r["rank"] for r in chosen if r.query == "q") == [good[0][1], good[1][1]]


def test_three_phase_search(spark):
    queries = spark.createDataFrame([(1, "red soil")], "query_id long, text string")
    hits = spark.createDataFrame([("red soil", 1, "http://a.gov/1", "Red soil", "x " * 150), ("red soil", 2, "http://b.com/2", "Other", "short"), ("red soil agriculture", 1, "http://a.gov/1", "Again", "y"), ("red soil farming", 1, "http://c.gov/3", "Soil", "red")], "query string, rank int, href string, title string, body string")
    pages = spark.createDataFrame([("http://a.gov/1", True, "word " * 120, "Page", None, None), ("http://c.gov/3", True, "too short", "P", None, None), ("http://b.com/2", False, "", "", None, None)], "url string, success boolean, content string, title string, author string, publish_date string")
    got = {r.url: r for r in B.three_phases(queries, hits, pages, (".gov",), 2).collect()}
    assert set(got) == {"http://a.gov/1", "http://c.gov/3"} and got["http://a.gov/1"].content.startswith("word") and got["http://c.gov/3"].content == "red"


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    lines = {}
    for name, n in (("b", 500), ("a", 3), ("c", 60)):
        rows = [json.dumps({"k": i, "f": name, "pad": "x" * (i % 90)}) if i % 11 else ("" if i % 2 else "{broken") for i in range(n)]
        (tmp_path / f"{name}.json").write_text("\n".join(rows) + "\n")
        lines[name] = {i for i in range(n) if i % 11}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        path, schema = f"file://{tmp_path}", "k long, f string"
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = readers.jsonl(spark, path, schema).collect()
        assert all(r.k == r.row_idx for r in got) and {n: {r.k for r in got if r.f == n} for n in lines} == lines
        assert [(r.f, r.k) for r in readers.jsonl(spark, path, schema, most=4).collect()] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
        tail = [r.value for r in readers.text_lines(spark, path, tail=2).collect()]
        assert [json.loads(x)["k"] for x in tail] == [59, 58] and len(readers.text_lines(spark, path, head=5).collect()) == 5
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_json_array_skips_broken_objects(spark, tmp_path):
    objects = [{"a": i, "s": 'q"\\{}[],é漢' * (i % 50), "n": {"x": [1, {"y": 2}]}} for i in range(3000)]
    parts = [json.dumps(o, indent=i % 3 or None, ensure_ascii=i % 2 == 0) for i, o in enumerate(objects)]
    parts.insert(5, '{"a": }')
    parts.insert(9, '{"a" 7}')
    (tmp_path / "x.json").write_text("[" + ",\n".join(parts) + "]")
    got = readers.json_document(spark, f"file://{tmp_path}/x.json", "a long, s string").collect()
    assert sorted((r.a, r.s) for r in got) == [(o["a"], o["s"]) for o in objects]
    assert [r.a for r in readers.json_document(spark, f"file://{tmp_path}/x.json", "a long", first=3).collect()] == [0, 1, 2]
    (tmp_path / "one.json").write_text('{"a": 5}')
    assert readers.json_document(spark, f"file://{tmp_path}/one.json", "a long").first().a == 5


def test_state_and_files(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert readers.state(spark, path).count() == 0
    rows = spark.createDataFrame([("http://a.com", "T", "c"), ("http://a.com/", "t ", "d")], "url string, title string, content string")
    sinks.write_state(D.state_of(rows), path)
    assert tuple(D.state_counts(readers.state(spark, path)).first()) == (1, 1, 2)
    (tmp_path / "state" / "part-damaged.parquet").write_bytes(b"PAR1 not parquet")
    assert readers.state(spark, path).count() == 4
    info = readers.file_info(spark, f"file://{tmp_path}/nowhere").first()
    assert not info.exists and info.size_bytes == 0 and readers.file_info(spark, path).where("exists").count() > 0


def test_index_artefact(spark, tmp_path):
    rows = spark.createDataFrame([(k, [float(k + 1), 1.0], f"t{k}") for k in range(5)], "i long, v array<double>, chunk_text string")
    path = f"file://{tmp_path}/index"
    assert sinks.write_index(V.index(rows, "i", "v", "chunk_text"), path) == {"n": 5, "dim": 2}
    assert sinks.read_index(spark, path).count() == 5
    sinks.read_index(spark, path).limit(2).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError):
        sinks.read_index(spark, path)
    with pytest.raises(ValueError):
        sinks.write_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, unit array<double>"), f"{path}2")


def test_reports_from_a_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"document {k} speaks of topic{k % 3} and of many other things that are long enough to stay") for k in range(9)], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "topic1"), (2, None)], "item_id long, text string")
    sinks.write_index(build_index(docs), f"file://{tmp_path}/i")
    stored = {r.item_id: r.report for r in cited_reports(questions, docs, index=sinks.read_index(spark, f"file://{tmp_path}/i")).collect()}
    assert stored == {r.item_id: r.report for r in cited_reports(questions, docs).collect()} and "topic1" in stored[1]


@pytest.mark.parametrize("block", [7, E.BLOCK])
def test_assignment_in_jobs_and_over_all(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = [(k, k // 7, ["crops", "soil health", "pests", "nothing"][k % 4]) for k in range(40)]
    df = spark.createDataFrame(rows, "i long, job int, q string").repartition(3)
    names = [a for a, _, _ in E.L.AGENTS]
    for batch in (None, "job"):
        got = {r.i: r.agent for r in E.assigned(df, "i", "q", batch).collect()}
        loads = {}
        for i, job, q in rows:
            load = loads.setdefault(job if batch else None, dict.fromkeys(names, 0))
            fits = [a for a, f, e in E.L.AGENTS if q in f] or names
            pick = min(fits, key=lambda a: (load[a], names.index(a)))
            load[pick] += 1
            assert got[i] == pick
    assert E.assigned(df.limit(0), "i", "q").count() == 0


def test_assignment_of_many_queries(spark, monkeypatch):
    """50,000 queries in 50 blocks equal one loop, after few rounds."""
    monkeypatch.setattr(E, "BLOCK", 1000)
    rng = random.Random(11)
    agents = [(f"a{k}", f"word{k}", f"other{k % 2}") for k in range(5)]
    rows = [(i, " ".join(rng.choices(["word0", "word1", "word2", "word3", "word4", "other0", "other1", "none"], weights=[9, 3, 1, 1, 1, 2, 2, 6], k=rng.randint(1, 3)))) for i in range(50_000)]
    got = {r.i: r.agent for r in E.assigned(spark.createDataFrame(rows, "i long, q string").repartition(5), "i", "q", rows=agents).collect()}
    load, wrong = [0] * 5, 0
    for i, q in rows:
        s = [2 * (f in q) + (e in q) for _, f, e in agents]
        pick = min((k for k in range(5) if s[k] == max(s)), key=lambda k: (load[k], k))
        load[pick] += 1
        wrong += got[i] != f"a{pick}"
    assert wrong == 0


def test_keep_first_of_a_hot_key(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.lit("x").alias("row"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"))
    got = D.keep_first(df, "key", ["id"])
    assert got.columns == df.columns and got.count() == 501 and got.where("key = 'hot'").first().id == 0
    both = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, o long")
    assert sorted(r.o for r in D.keep_first(both, "k", ["o"]).collect()) == [1, 5]


def test_parsed_lists_fall_back(spark):
    r = one(
        spark, E.parsed_list(F.lit("Here are some\n1. first real query\n2) [insert topic here]\n- second real query\n* tiny")).alias("a"), E.parsed_list(F.lit("Sure!\nIs this a question line?\nand more words")).alias("b"),
        E.parsed_list(F.lit("a line of some words\nx")).alias("c"), E.parsed_list(F.lit(None).cast("string")).alias("d"),
    )
    assert (r.a, r.b, r.c, r.d) == (["first real query", "second real query"], ["Is this a question line?"], ["a line of some words"], None)


def test_material_of_sub_queries(spark, sf):
    """Chunks are the nearest ones to the agent's form of each variant, hits the first ones of the variant."""
    from quarrywork.plans import record_queries as M

    got = M.sub_query_material(spark, sf).collect()
    questions = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    variants = {r.item_id: r.v for r in spark.createDataFrame(list(questions.items()), "item_id long, text string").select("item_id", E.variants("text").alias("v")).collect()}
    assert {(r.item_id, r["sub"]) for r in got} == {(i, k) for i, v in variants.items() for k in range(len(v))}
    hits = {}
    for r in M.searched(spark, sf).drop("item_id").distinct().collect():
        hits.setdefault(r["query"], {})[r["rank"]] = r
    web = {(r.item_id, r["sub"], r["rank"]): r for r in got if r.type == "web"}
    for (i, k, rank), r in web.items():
        assert (r.url, r.title) == (hits[variants[i][k]][rank + 1].href, hits[variants[i][k]][rank + 1].title) and r.citation_id == f"WEB-{k + 1}-{rank + 1}"
    asked = {(i, k): q for i, v in variants.items() for k, q in enumerate(v)}
    routed = {(r.i, r.k): r.agent_query for r in E.routed(spark.createDataFrame([(i, k, q) for (i, k), q in asked.items()], "i long, k int, q string"), "q", M._ROUTES).collect()}
    index = build_index(spark.read.parquet(f"{sf}/documents.parquet"))
    some = dict(list(routed.items())[:3])
    unit = spark.createDataFrame([(f"{i}-{k}", q) for (i, k), q in some.items()], "query_id string, q string").select("query_id", V.hash_embedding(F.col("q")).alias("unit"))
    best = {(r.query_id, r["rank"] - 1): r.id for r in V.top_k(unit, index, 3, digits=9).collect()}
    assert all(best[f"{r.item_id}-{r['sub']}", r["rank"]] == r.url for r in got if r.type == "database" and (r.item_id, r["sub"]) in some)


def test_append_new_and_stats(spark, tmp_path):
    schema = "link string, title string, text_extracted string, ord long"
    path = f"file://{tmp_path}/out"
    assert sinks.stats(spark, path) == {"entries": 0, "bytes": 0}
    state = spark.createDataFrame([], "kind string, key string")
    first = spark.createDataFrame([("http://a.com", "T", "x", 1), ("http://www.a.com/", "U", "y", 2), ("http://b.com", "", "x", 3), ("http://c.com", "t", "z", 4)], schema)
    state, done = sinks.append_new(first, state, path)
    assert done == {"written": 2, "duplicates": 2}
    state, done = sinks.append_new(spark.createDataFrame([("http://b.com?x", "V", "v", 1), ("http://e.com", "W", "X ", 2), ("http://f.com", None, None, 3)], schema), state, path)
    assert done == {"written": 1, "duplicates": 2} and sinks.stats(spark, path)["entries"] == 3
    assert sorted(r.link for r in spark.read.schema(schema).json(path).collect()) == ["http://a.com", "http://b.com", "http://f.com"]


def test_salvage_reads_a_text_once(spark):
    """The plan does not repeat what it computes: its size grew with each use of a value before."""
    from quarrywork.functions import json_repair as J

    rows = spark.createDataFrame([('"domain": "x", "relevance_score": 0.5, "key_insights": ["a"] and "domain": "y"',), (None,), ("{}",)], "raw string")
    got = rows.select(J.parsed("raw").alias("p"), J.salvaged("raw").alias("s"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 8
    assert got.collect()[0].s == '{"domain":"y","relevance_score":0.5,"key_insights":["a"]}' and got.collect()[0].p == got.collect()[0].s
