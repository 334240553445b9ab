"""More queries and their SQL: records, search flows, model output, citations, expansion, and the scalar
functions that ``queries`` leaves out.  The vocabulary of the tables is invented, so word lists are of
words that occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import lexicon as L
from ..functions import classify as C, content as T, html as H, json_repair as J, scoring as S, text as X, urls as U
from ..operators import chunking, citations as K, dedup as D, expand as E, records as Q, report as R, search as V, web as B
from ..session import new_path, ship_package
from ..sources import readers, sinks
from .queries import MORE, WORDS, _CHUNK, _KEYS, _case_sql, _keys, _U, query, read, sql_list

_W = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
_NOT = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"


def _found(terms, subject: str) -> str:
    return f"list_filter({sql_list(sorted(set(terms)))}, lambda k: contains({subject}, k))"


def _count(terms, subject: str) -> str:
    return "(" + " + ".join(f"((length({subject}) - length(replace({subject}, '{t}', ''))) // {len(t)})" for t in terms) + ")"


def _hits(terms, subject: str) -> str:
    return "(" + " + ".join(f"contains({subject}, '{t}')::INT" for t in terms) + ")"


def _words(subject: str) -> str:
    return f"list_filter(regexp_split_to_array({subject}, '{_W}'), lambda w: w <> '')"


def _pick(text: str, n: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {n} + 1)::INT"


# Hits to records ----------------------------------------------------------------------------------------

LEX = Q.Lexicons(regions=WORDS, crops=("que", "en"), methods=("der",), soils=("la", "die"), climates=("in",), fertilizers=("und",), species=("of",), relevance=WORDS, places=MORE, saturating=WORDS, context=WORDS[:2], tags={"a": ("the", "of"), "b": ("que",), "c": ("der", "und")})

_HITS = """
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'https://' || source || CASE WHEN doc_id % 4 = 0 THEN '.gov.in/report' WHEN doc_id % 4 = 1 THEN '.edu/a.pdf' ELSE '.com/x' END || '?id=' || doc_id END AS href,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'Annual news of ' || lang ELSE 'Study ' || doc_id END AS title, CASE WHEN doc_id % 7 <> 0 THEN substr(text, 1, 700) END AS body,
  CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '' END AS full_content FROM documents"""


def hits(spark, d) -> DataFrame:
    """Documents as search hits, some without URL, title, snippet or page."""
    mod = lambda k: F.pmod("doc_id", F.lit(k))
    end = F.when(mod(4) == 0, ".gov.in/report").when(mod(4) == 1, ".edu/a.pdf").otherwise(".com/x")
    return read(spark, d, "documents").select(
        "doc_id", F.when(mod(9) == 0, "").otherwise(F.concat(F.lit("https://"), "source", end, F.lit("?id="), F.col("doc_id").cast("string"))).alias("href"),
        F.when(mod(13) == 0, F.lit(None)).when(mod(5) == 0, F.concat(F.lit("Annual news of "), "lang")).otherwise(F.concat(F.lit("Study "), F.col("doc_id").cast("string"))).alias("title"),
        F.when(mod(7) != 0, F.substring("text", 1, 700)).alias("body"), F.when(mod(3) == 0, F.col("text")).when(mod(3) == 1, "").alias("full_content"),
    )


_RECORDS = f"""
WITH h AS ({_HITS}), f AS (SELECT *, coalesce(nullif(full_content, ''), coalesce(body, '')) AS f FROM h WHERE coalesce(href, '') <> '' AND coalesce(title, '') <> ''),
w AS (SELECT *, f || ' ' || title || ' ' || coalesce(body, '') AS whole, lower(f || ' ' || title || ' ' || coalesce(body, '')) AS low,
  lower(href || ' ' || title || ' ' || coalesce(body, '')) AS g, string_split(regexp_replace(f || ' ' || title || ' ' || coalesce(body, ''), '([.!?]){_W}', '\\1' || chr(1), 'g'), chr(1)) AS s FROM f),
r AS (SELECT *, {_case_sql('g', C.GENRE, 'article')} AS genre FROM w),
records AS (SELECT title, href AS link, f AS text_extracted, CASE WHEN coalesce(body, '') <> '' THEN substr(body, 1, 500) END AS abstract, genre,
  list_sort(list_distinct(list_concat([genre], list_filter(['a', 'b', 'c'], lambda t: (t = 'a' AND (contains(low, 'the') OR contains(low, 'of'))) OR (t = 'b' AND contains(low, 'que')) OR (t = 'c' AND (contains(low, 'der') OR contains(low, 'und'))))))) AS tags,
  {_found(LEX.regions, 'low')} AS indian_regions, {_found(LEX.crops, 'low')} AS crop_types, {_found(LEX.methods, 'low')} AS farming_methods, {_found(LEX.soils, 'low')} AS soil_types,
  {_found(LEX.climates, 'low')} AS climate_info, {_found(LEX.fertilizers, 'low')} AS fertilizers, {_found(LEX.species, 'low')} AS plant_species,
  substr(list_filter(list_filter(s, lambda x: trim(x) <> ''), lambda x: contains(lower(x), 'irrigation') OR contains(lower(x), 'watering'))[1], 1, 500) AS watering_schedule,
  lower(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS source_domain, '2024-03-01T00:00:00' AS extraction_timestamp,
  round(least({_count(LEX.relevance, 'low')} * 0.1 + {_count(LEX.places, 'low')} * 0.05, 1.0), 6)::DOUBLE AS relevance_score, length(f)::BIGINT AS content_length, md5(f) AS content_hash, md5(href) AS url_hash,
  contains(lower(href), 'pdf') AS is_pdf FROM r)"""
_LISTS = ("tags", "indian_regions", "crop_types", "farming_methods", "soil_types", "climate_info", "fertilizers", "plant_species")
_PLAIN = ("title", "link", "text_extracted", "abstract", "genre", "watering_schedule", "source_domain", "extraction_timestamp", "relevance_score", "content_length", "content_hash", "url_hash", "is_pdf")


def records(spark, d) -> DataFrame:
    return Q.from_hits(hits(spark, d), LEX, F.lit("2024-03-01").cast("timestamp"))


@query(f"{_RECORDS} SELECT {', '.join(_PLAIN)}, {', '.join(f'''array_to_string({c}, ',') AS {c}''' for c in _LISTS)} FROM records")
def hit_records(spark, d):
    rows = records(spark, d)
    round6 = {"relevance_score": F.round("relevance_score", 6)}
    return rows.withColumns(round6).select(*_PLAIN, *[F.array_join(c, ",").alias(c) for c in _LISTS])


@query(f"""{_RECORDS}, t AS (SELECT *, lower(title || ' ' || text_extracted) AS low FROM records)
SELECT link, {_case_sql("lower(title)", C.STRATEGY, 'general_exploration')} AS search_strategy,
  CASE WHEN is_pdf AND (contains(lower(title), 'research') OR contains(lower(title), 'study') OR contains(lower(title), 'analysis')) THEN 'research_paper' WHEN is_pdf AND (contains(lower(title), 'report') OR contains(lower(title), 'survey')) THEN 'technical_report'
   WHEN is_pdf THEN 'pdf_document' WHEN contains(lower(link), 'gov.in') OR contains(lower(link), 'nic.in') THEN 'government_content' WHEN contains(lower(link), 'edu') OR contains(lower(link), 'ac.in') OR contains(lower(link), 'university') THEN 'academic_content'
   WHEN contains(lower(title), 'news') OR contains(lower(title), 'article') THEN 'news_article' ELSE 'web_content' END AS content_category,
  round(least({" + ".join(f"CASE WHEN len({c}) > 0 THEN 0.2 ELSE 0 END" for c in ("tags", "indian_regions", "crop_types"))} + {" + ".join(f"CASE WHEN len({c}) > 0 THEN 0.1 ELSE 0 END" for c in ("soil_types", "climate_info", "fertilizers", "farming_methods"))}, 1.0), 6)::DOUBLE AS richness,
  round(least({" + ".join(f"least({_count([w], 'low')} * 0.1, 0.2)" for w in WORDS)}, 1.0), 6)::DOUBLE AS relevance, round(least({_hits(WORDS[:2], 'low')} * 0.3 + {_hits(WORDS, 'low')} * 0.1, 1.0), 6)::DOUBLE AS context FROM t""")
def hit_scores(spark, d):
    got = Q.with_search_scores(records(spark, d), "title", F.lit("agent"), LEX)
    return got.select("link", "search_strategy", "content_category", F.round("data_richness_score", 6).alias("richness"), F.round("agriculture_relevance", 6).alias("relevance"), F.round("indian_context_score", 6).alias("context"))


@query("""
SELECT coalesce(href, '') AS link, coalesce(title, '') AS title, coalesce(full_content, body, '') AS text_extracted, CASE WHEN body <> '' THEN substr(body, 1, 500) END AS abstract, 'article' AS genre, 0 AS n_tags, 0::DOUBLE AS relevance_score, 0::BIGINT AS content_length, false AS is_pdf
FROM (""" + _HITS + ")")
def result_defaults(spark, d):
    got = Q.defaulted(hits(spark, d).select(F.col("href").alias("url"), "title", F.col("body").alias("snippet"), "full_content"))
    return got.select("link", "title", "text_extracted", "abstract", "genre", F.size("tags").alias("n_tags"), "relevance_score", "content_length", "is_pdf")


_EXTRACTED = """
WITH h AS (""" + _HITS + """), p AS (SELECT href AS url, doc_id % 4 <> 0 AS success, substr(text, 1, 900) AS content, CASE WHEN doc_id % 8 = 1 THEN '' ELSE 'Page ' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN 'A' || doc_id END AS author FROM h JOIN documents USING (doc_id) WHERE href <> ''),
e AS (SELECT h.doc_id, h.href, h.title AS own, h.body, p.url IS NOT NULL AS extracted, p.content AS page, p.title AS page_title, p.author FROM h LEFT JOIN p ON h.href = p.url AND p.success)"""


def page_extractions(spark, d) -> DataFrame:
    rows = hits(spark, d).select("doc_id", "href").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id").where("href <> ''")
    mod = lambda k: F.pmod("doc_id", F.lit(k))
    return rows.select(
        F.col("href").alias("url"), (mod(4) != 0).alias("success"), F.substring("text", 1, 900).alias("content"), F.when(mod(8) == 1, "").otherwise(F.concat(F.lit("Page "), F.col("doc_id").cast("string"))).alias("title"),
        F.when(mod(3) == 0, F.concat(F.lit("A"), F.col("doc_id").cast("string"))).alias("author"), F.lit(None).cast("string").alias("publish_date"),
    )


@query(f"""{_EXTRACTED} SELECT doc_id, extracted, CASE WHEN extracted THEN page ELSE coalesce(body, '') END AS content, CASE WHEN extracted AND page_title <> '' THEN page_title ELSE own END AS title, author,
  CASE WHEN extracted THEN len({_words('page')})::BIGINT END AS word_count FROM e""")
def hits_enriched(spark, d):
    rows = hits(spark, d).select("doc_id", F.col("href").alias("url"), "title", F.col("body").alias("snippet"))
    return Q.with_extractions(rows, page_extractions(spark, d)).select("doc_id", "extracted", "content", "title", "author", "word_count")


_ANSWERS = """SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE (doc_id % 11) / 10.0 END::DOUBLE AS score FROM documents"""


@query(f"""
SELECT doc_id, score IS NOT NULL AS enhanced_by_llm, CASE WHEN score IS NOT NULL THEN CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END END AS content_summary,
  coalesce(score > 0.7, false) AS high_quality, CASE WHEN score > 0.7 THEN score END AS quality_score, CASE WHEN score IS NULL THEN 'rules' ELSE 'model' END AS maker FROM ({_ANSWERS})""")
def model_enrichment(spark, d):
    score = F.when(F.pmod("doc_id", F.lit(6)) != 0, F.pmod("doc_id", F.lit(11)) / F.lit(10.0))
    rows = read(spark, d, "documents").select("doc_id", "text", F.when(score.isNotNull(), F.struct(score.alias("relevance_score"))).alias("analysis"))
    rows = rows.withColumn("m", F.when(F.col("analysis").isNotNull(), F.struct(F.lit("model").alias("maker")))).withColumn("r", F.struct(F.lit("rules").alias("maker")))
    got = Q.model_or_rules(Q.with_model_analysis(rows, "analysis", "text"), "m", "r")
    return got.select("doc_id", "enhanced_by_llm", "content_summary", "high_quality", "quality_score", F.col("record.maker").alias("maker"))


# Search flows ---------------------------------------------------------------------------------------------

_SEARCH = """
SELECT item_id, text || suffix AS query, rank, 'http://' || CASE WHEN (item_id + rank) % 3 = 0 THEN 'www.' ELSE '' END || 'site' || ((item_id * 7 + rank * 3 + pos) % 23) || CASE WHEN rank % 4 = 0 THEN '.edu' WHEN rank % 4 = 1 THEN '.com' ELSE '.org' END || '/p' || (rank % 5) AS href,
  'Title ' || substr(text, 1, 20 + rank * 5) AS title, substr(text, 1 + rank * 10, 150 + rank * 20) AS body
FROM benchmark, (VALUES (0, ''), (1, ' agriculture'), (2, ' farming'), (3, ' farming India')) v(pos, suffix), (SELECT unnest(range(1, 9))::INT AS rank) r"""


def searched(spark, d) -> DataFrame:
    """Eight hits for each question in four forms."""
    forms = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("suffix")) for i, s in enumerate(("", " agriculture", " farming", " farming India"))])
    b = read(spark, d, "benchmark").select("item_id", "text", F.explode(forms).alias("f")).select("item_id", "text", "f.*").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(8))))
    site = F.pmod(F.col("item_id") * 7 + F.col("rank") * 3 + F.col("pos"), F.lit(23)).cast("string")
    end = F.when(F.pmod("rank", F.lit(4)) == 0, ".edu").when(F.pmod("rank", F.lit(4)) == 1, ".com").otherwise(".org")
    url = F.concat(F.lit("http://"), F.when(F.pmod(F.col("item_id") + F.col("rank"), F.lit(3)) == 0, "www.").otherwise(""), F.lit("site"), site, end, F.lit("/p"), F.pmod("rank", F.lit(5)).cast("string"))
    return b.select("item_id", F.concat("text", "suffix").alias("query"), "rank", url.alias("href"), F.concat(F.lit("Title "), F.substring("text", F.lit(1), 20 + F.col("rank") * 5)).alias("title"), F.substring("text", 1 + F.col("rank") * 10, 150 + F.col("rank") * 20).alias("body"))


def asked(spark, d) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_HOST = "lower(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@query(f"""
WITH h AS (SELECT DISTINCT * FROM ({_SEARCH})), s AS (SELECT *, {_HOST} AS domain, CASE WHEN contains({_HOST}, '.edu') THEN 2.0 ELSE 1.0 END::DOUBLE AS relevance_score FROM h)
SELECT item_id, query, rank, domain, relevance_score, row_number() OVER (PARTITION BY query, item_id ORDER BY relevance_score DESC, rank)::INT AS position FROM s""")
def web_boosted(spark, d):
    rows = searched(spark, d).distinct().withColumn("asked", F.concat_ws("|", F.col("item_id").cast("string"), "query"))
    return B.boosted(rows, (".edu",), "asked").select("item_id", "query", "rank", "domain", "relevance_score", "position")


@query(f"SELECT item_id AS query_id, query, rank, href, title, body AS snippet, body AS content FROM ({_SEARCH}) WHERE rank <= 5 AND query LIKE '% agriculture'")
def web_single_strategy(spark, d):
    got = searched(spark, d)
    return B.one_strategy(asked(spark, d), got.drop("item_id").distinct(), most=5).where(F.col("query").endswith(" agriculture"))


_THREE = f"""
WITH h AS (SELECT * FROM ({_SEARCH})), c AS (SELECT item_id AS query_id, CASE WHEN query LIKE '% agriculture' THEN 1 WHEN query LIKE '% farming' THEN 2 ELSE 0 END AS strategy, rank, href FROM h WHERE query NOT LIKE '% farming India'),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, href ORDER BY strategy, rank) = 1)
SELECT query_id, strategy, rank, href, row_number() OVER (PARTITION BY query_id ORDER BY strategy, rank)::INT AS position FROM f QUALIFY position <= 12"""


@query(_THREE)
def web_three_strategies(spark, d):
    got = B.three_strategies(asked(spark, d), searched(spark, d).drop("item_id").distinct(), 12)
    return got.select("query_id", "strategy", "rank", "href", "position")


@query(_THREE)
def web_recorded(spark, d):
    """The same flow over hits recorded in two rounds and read through the data source."""
    from ..sources import recorded_search as S

    S.register(spark)
    path, hits = new_path(spark, "recorded"), searched(spark, d).drop("item_id").distinct()
    for part in (F.col("rank") <= 4, F.col("rank") > 4):
        S.record(hits.where(part), path)
    got = B.three_strategies(asked(spark, d), spark.read.format(S.NAME).load(path), 12)
    return got.select("query_id", "strategy", "rank", "href", "position")


_CANDIDATES = "SELECT item_id, rank, href, round(((item_id * 3 + rank) % 10) / 10.0, 6)::DOUBLE AS estimated_quality, round(((item_id + rank * 7) % 6) / 5.0, 6)::DOUBLE AS relevance_score FROM (" + _SEARCH + ") WHERE query NOT LIKE '% agriculture' AND query NOT LIKE '% farming' AND query NOT LIKE '% farming India'"


@query(f"""
WITH c AS ({_CANDIDATES}), g AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place,
  row_number() OVER (PARTITION BY item_id ORDER BY relevance_score DESC, estimated_quality DESC, rank) AS best FROM c WHERE estimated_quality >= 0.3)
SELECT item_id, rank, estimated_quality, relevance_score FROM g WHERE CASE WHEN n > 3 AND item_id % 2 = 0 THEN place IN (2, 4) ELSE n <= 3 OR best <= 3 END""")
def web_selected(spark, d):
    """For every second question a model has chosen the second and fourth candidate."""
    plain = ~(F.col("query").endswith(" agriculture") | F.col("query").endswith(" farming") | F.col("query").endswith(" farming India"))
    quality, relevance = F.pmod(F.col("item_id") * 3 + F.col("rank"), F.lit(10)) / 10.0, F.pmod(F.col("item_id") + F.col("rank") * 7, F.lit(6)) / 5.0
    rows = searched(spark, d).where(plain).withColumns({"estimated_quality": F.round(quality, 6), "relevance_score": F.round(relevance, 6), "chosen": F.when(F.pmod("item_id", F.lit(2)) == 0, F.array(F.lit(2), F.lit(4), F.lit(99)))})
    return B.selected(rows, "item_id", 3, chosen="chosen").select("item_id", "rank", "estimated_quality", "relevance_score")


_FLOW = f"""
WITH h AS (SELECT DISTINCT item_id, query, rank, href AS url, title, body AS snippet FROM ({_SEARCH})),
b AS (SELECT item_id, text, NOT (contains(lower(text), 'agriculture') OR contains(lower(text), 'farming')) AS plain FROM benchmark),
v AS (SELECT item_id, text, list_slice(CASE WHEN plain THEN [text, text || ' agriculture'] ELSE [text, text || ' best practices'] END, 1, 2) AS q FROM b),
a AS (SELECT item_id, text, unnest(q) AS query, unnest([0, 1]) AS variant FROM v),
f AS (SELECT DISTINCT a.item_id AS query_id, a.text AS asked, variant, rank, url, title, snippet FROM a JOIN h ON a.query = h.query),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, split_part(replace(regexp_replace(trim(lower(url)), '/+$', ''), 'www.', ''), '?', 1) ORDER BY variant, rank, url) = 1),
p AS (SELECT DISTINCT 'http://site' || (i % 23) || '.org/p' || (i % 5) AS url, 'page text ' || (i % 23) || repeat(' the soil and more', (i % 23) * 3) AS content, 'Page ' || (i % 23) AS title FROM range(1, 500) r(i)),
e AS (SELECT k.*, p.content IS NOT NULL AS extracted, CASE WHEN p.content IS NOT NULL THEN p.content ELSE coalesce(snippet, '') END AS content, coalesce(p.title, k.title) AS t2, CASE WHEN p.content IS NOT NULL THEN len({_words('p.content')})::BIGINT END AS word_count FROM k LEFT JOIN p ON k.url = p.url),
t AS (SELECT *, lower(t2 || ' ' || snippet || ' ' || content) AS low, list_distinct({_words('lower(asked)')}) AS terms, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM e),
s AS (SELECT *, least(CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, {_words('low')})) / len(terms)::DOUBLE ELSE 0 END * 7 + least({_hits(L.COVERAGE_TERMS, 'low')} * 0.5, 3.0), 10.0)::DOUBLE AS relevance,
  greatest(0, least(10, CASE WHEN host = 'site1.org' THEN 8.0 WHEN ends_with(host, '.edu') THEN 8.5 WHEN ends_with(host, '.org') THEN 7.0 ELSE 5.0 END
   - CASE WHEN coalesce(word_count, len({_words('snippet')})) < 100 THEN 2 WHEN coalesce(word_count, len({_words('snippet')})) < 300 THEN 1 ELSE 0 END))::DOUBLE AS trust FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance * 0.5 + trust * 0.3 + 5.0 * 0.2, 9) DESC, url) AS position FROM s)"""


@query(f"{_FLOW} SELECT query_id, url, t2 AS title, extracted, round(relevance, 6)::DOUBLE AS relevance, position::INT AS position FROM r WHERE round(relevance, 9) >= 3.0 AND position <= 10")
def web_search_flow(spark, d):
    """Variants, hits, one per URL, extraction, ranking, filter, the first ten of each question."""
    i = F.pmod("id", F.lit(23))
    pages = spark.range(1, 500).select(
        F.concat(F.lit("http://site"), i.cast("string"), F.lit(".org/p"), F.pmod("id", F.lit(5)).cast("string")).alias("url"), F.lit(True).alias("success"),
        F.concat(F.lit("page text "), i.cast("string"), F.call_function("repeat", F.lit(" the soil and more"), (i * 3).cast("int"))).alias("content"), F.concat(F.lit("Page "), i.cast("string")).alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("publish_date"),
    ).distinct()
    got = B.search(asked(spark, d), searched(spark, d).drop("item_id").distinct(), pages, {"site1.org": 8.0})
    return got.select("query_id", "url", "title", "extracted", F.round("relevance", 6).alias("relevance"), "position")


@query(f"""
WITH c AS ({_CANDIDATES}) SELECT item_id, count(*) FILTER (WHERE relevance_score >= 0.5) AS total_results, count(*) FILTER (WHERE relevance_score >= 0.5 AND rank % 3 <> 0) AS successful_extractions, count(*) FILTER (WHERE relevance_score >= 0.5 AND rank % 3 = 0) AS failed_extractions,
  round(coalesce(avg(relevance_score::DECIMAL(38,10)) FILTER (WHERE relevance_score >= 0.5), 0)::DOUBLE, 6) AS average_relevance FROM c GROUP BY item_id HAVING count(*) FILTER (WHERE relevance_score >= 0.5) > 0""")
def web_response(spark, d):
    """Results of at least that relevance, and the summary of each response."""
    plain = ~(F.col("query").endswith(" agriculture") | F.col("query").endswith(" farming") | F.col("query").endswith(" farming India"))
    rows = searched(spark, d).where(plain).withColumn("relevance_score", F.round(F.pmod(F.col("item_id") + F.col("rank") * 7, F.lit(6)) / 5.0, 6))
    ok = F.pmod("rank", F.lit(3)) != 0
    return B.response(B.threshold(rows, "relevance_score", 0.5, ok)[0], ok, "relevance_score", "item_id")


@query(f"""
WITH c AS ({_CANDIDATES}) SELECT count(*) FILTER (WHERE relevance_score >= 0.5) AS kept, count(*) FILTER (WHERE rank % 3 <> 0) AS successful_extractions, count(*) FILTER (WHERE rank % 3 = 0) AS failed_extractions FROM c""")
def web_threshold_metrics(spark, d):
    plain = ~(F.col("query").endswith(" agriculture") | F.col("query").endswith(" farming") | F.col("query").endswith(" farming India"))
    rows = searched(spark, d).where(plain).withColumn("relevance_score", F.round(F.pmod(F.col("item_id") + F.col("rank") * 7, F.lit(6)) / 5.0, 6))
    return B.threshold(rows, "relevance_score", 0.5, F.pmod("rank", F.lit(3)) != 0)[1]


@query(f"""
WITH h AS (SELECT *, {_HOST} AS d FROM ({_HITS})), w AS (SELECT *, lower(coalesce(full_content, '') || ' ' || coalesce(title, '') || ' ' || coalesce(body, '')) AS low FROM h)
SELECT doc_id, round(least({_count(WORDS, 'low')} * 0.1 + {_count(MORE, 'low')} * 0.05 + CASE WHEN contains(d, '.edu') THEN 0.5 ELSE 0 END, 1.0), 6)::DOUBLE AS with_domain,
  round(least({_count(WORDS, 'low')} * 0.1 + {_count(MORE, 'low')} * 0.05, 1.0), 6)::DOUBLE AS compat,
  CASE WHEN contains(d, '.edu') OR contains(d, '.gov') OR contains(d, '.org') THEN 0.7 WHEN contains(d, 'docs.') OR contains(d, 'documentation') OR contains(d, 'manual') THEN 0.6 WHEN contains(d, 'blog') OR contains(d, 'medium.com') OR contains(d, 'dev.to') THEN 0.5 ELSE 0.4 END::DOUBLE AS reputation
FROM w""")
def hit_relevance(spark, d):
    rows = hits(spark, d).withColumns({"url": F.col("href"), "a": F.coalesce("full_content", F.lit("")), "b": F.coalesce("title", F.lit("")), "c": F.coalesce("body", F.lit(""))})
    score = lambda compat: F.round(S.occurrence_with_domain("a", "b", "c", (".edu",), WORDS, MORE, compat), 6)
    return rows.select("doc_id", score(False).alias("with_domain"), score(True).alias("compat"), S.reputation(F.lower(U.netloc("href"))).alias("reputation"))


@query(f"""
WITH q AS (SELECT doc_id, lower(text) AS low, list_distinct({_words('lower(source || lang || text[1:40])')}) AS terms FROM (SELECT doc_id, text, source || ' ' AS source, lang || ' ' AS lang FROM documents))
SELECT doc_id, round(least(CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, {_words('low')})) / len(terms)::DOUBLE ELSE 0 END * 7 + least({_hits(WORDS, 'low')} * 0.5, 3.0), 10.0), 6)::DOUBLE AS coverage FROM q""")
def term_coverage(spark, d):
    q = F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit(" "), F.substring("text", 1, 40))
    return read(spark, d, "documents").select("doc_id", F.round(S.term_coverage("text", q, WORDS), 6).alias("coverage"))


# Content --------------------------------------------------------------------------------------------------

_PARAS = "string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10))"


def paragraphs_of(spark, d) -> DataFrame:
    """Documents with a blank line in place of each full stop."""
    return read(spark, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n\n")).alias("text"))


_RELEVANT = rf"""
WITH t AS (SELECT doc_id, replace(text, '. ', chr(10) || chr(10)) AS text FROM documents),
p AS (SELECT doc_id, text, regexp_split_to_array(text, '\n[\s\x0B]*\n') AS raw, list_filter(list_transform(regexp_split_to_array(text, '\n[\s\x0B]*\n'), lambda p: trim(p, ' ')), lambda p: length(p) >= 50) AS p FROM t),
r AS (SELECT doc_id, text, raw, list_filter(p, lambda x: contains(lower(x), 'the') OR contains(lower(x), 'que') OR (contains(lower(x), 'en') AND length(x) > 100)) AS r FROM p)"""


@query(f"{_RELEVANT} SELECT doc_id, len(r)::INT AS n, array_to_string(r, '|') AS joined FROM r")
def relevant_paragraphs(spark, d):
    found = T.relevant_paragraphs("text", subject=("the", "que"), places=("en",))
    return paragraphs_of(spark, d).withColumn("r", found).select("doc_id", F.size("r").alias("n"), F.array_join("r", "|").alias("joined"))


@query(f"""{_RELEVANT}, u AS (SELECT doc_id, text, CASE WHEN len(r) > 0 THEN r ELSE list_slice(raw, 1, 1) END AS u FROM r),
x AS (SELECT doc_id, text, unnest(u) AS p, generate_subscripts(u, 1) AS i FROM u),
c AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
k AS (SELECT *, coalesce(bool_or(before + length(p) > 500) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM c),
j AS (SELECT doc_id, any_value(text) AS text, trim(coalesce(string_agg(CASE WHEN before + length(p) <= 500 THEN p WHEN 500 - before > 50 THEN substr(p, 1, (500 - before)::INT) || '...' END, ' ' ORDER BY i) FILTER (WHERE NOT done), ''), ' ') AS a FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN a = '' THEN substr(text, 1, 500) || CASE WHEN length(text) > 500 THEN '...' ELSE '' END ELSE a END AS abstract FROM j""")
def abstract_relevant(spark, d):
    return paragraphs_of(spark, d).select("doc_id", T.enhanced_abstract("text", subject=("the", "que"), places=("en",)).alias("abstract"))


_TERMS = lambda ws, t="t": f"len(list_filter(regexp_split_to_array(lower({t}), '{_NOT}'), lambda w: list_contains({sql_list(ws)}, w)))"
_DENSITY = f"(CASE WHEN len({_words('t')}) = 0 THEN 0 ELSE least({_TERMS(WORDS)} / len({_words('t')})::DOUBLE * 0.5 + {_TERMS(WORDS[:2])} / len({_words('t')})::DOUBLE * 0.3 + {_TERMS(MORE)} / len({_words('t')})::DOUBLE * 0.2, 1.0) END)"


@query(f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS x, '  ' || coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, x, {_DENSITY} AS score, list_filter(regexp_split_to_array(lower(x), '{_NOT}'), lambda w: list_contains({sql_list((*WORDS, *WORDS[:2]))}, w)) AS terms, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(x), '{_NOT}'), lambda w: list_contains({sql_list(MORE)}, w)))) AS regions FROM x)
SELECT doc_id, round(score, 9)::DOUBLE AS relevance_score, score >= 0.3 AS is_relevant, array_to_string(regions, ',') AS regions, len({_words('x')})::BIGINT AS word_count, len(list_distinct(terms))::INT AS n_terms FROM f""")
def structured_info(spark, d):
    info = T.structured_info("text", agri=WORDS, farm=WORDS[:2], region=MORE)
    got = read(spark, d, "documents").select("doc_id", info.alias("i"))
    return got.select("doc_id", F.round("i.relevance_score", 9).alias("relevance_score"), "i.is_relevant", F.array_join("i.regions_mentioned", ",").alias("regions"), "i.word_count", F.size("i.key_terms").alias("n_terms"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\x0B\x1C-\x1F\x85\p{Z}]', '', 'g'), '""" + _W + r"""', ' ', 'g')) AS bare, nullif(regexp_extract(text, '(19|20)\d{2}', 0), '')::INT AS year,
  coalesce(nullif(regexp_extract(text, '\d{4}-\d{2}-\d{2}', 0), ''), nullif(regexp_extract(text, '\d{1,2}/\d{1,2}/\d{4}', 0), ''), nullif(regexp_extract(text, '(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}', 0), '')) AS published,
  trim(""" + "".join("regexp_replace(" for _ in X.BOILERPLATE) + "regexp_replace(text, '" + _W + "', ' ', 'g')" + "".join(f", '(?i){p}', '', 'g')" for p in X.BOILERPLATE) + """) AS stripped FROM documents""")
def text_more(spark, d):
    return read(spark, d, "documents").select("doc_id", X.normalize_words("text").alias("bare"), X.year("text").alias("year"), X.publication_date("text").alias("published"), X.strip_boilerplate("text").alias("stripped"))


@query(rf"""
WITH s AS (SELECT doc_id, text, string_split(text, '. ') AS s FROM documents), x AS (SELECT doc_id, text, unnest(s) AS p, generate_subscripts(s, 1) AS i FROM s),
c AS (SELECT *, sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM x),
k AS (SELECT *, bool_or(upto > 950) OVER (PARTITION BY doc_id ORDER BY i) AS done FROM c)
SELECT doc_id, CASE WHEN length(any_value(text)) <= 1000 THEN any_value(text) ELSE trim(coalesce(string_agg(p || '. ', '' ORDER BY i) FILTER (WHERE NOT done), ''), ' ') || '...' END AS cut FROM k GROUP BY doc_id""")
def sentences_cut(spark, d):
    return read(spark, d, "documents").select("doc_id", X.truncate_sentences("text").alias("cut"))


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace({''.join('regexp_replace(' for _ in H.SILENT)}html{''.join(f', $$(?is)<{t}' + chr(92) + f'b[^>]*>.*?</{t}>$$, $$ $$, $$g$$)' for t in H.SILENT)}, '(?s)<[^>]+>', ' ', 'g'), '{_W}', ' ', 'g')) AS plain FROM pages")
def html_plain(spark, d):
    return read(spark, d, "pages").select("page_id", H.strip_tags("html").alias("plain"))


@query()
def html_articles(spark, d):
    """Articles of all pages, tested against a plain reading of planted pages."""
    ship_package(spark)
    return B.articles(read(spark, d, "pages"), ("blocked.example",))


@query()
def html_content(spark, d):
    ship_package(spark)
    return read(spark, d, "pages").select("page_id", H.content("html").alias("c")).select("page_id", "c.success", "c.title", "c.content", "c.word_count", F.size("c.tables").alias("n_tables"), F.size("c.lists").alias("n_lists"))


# Scores -----------------------------------------------------------------------------------------------------


@query(f"""
WITH t AS (SELECT doc_id, doc_id % 2 = 0 AS trusted, doc_id % 9 AS a, doc_id % 5 AS b, doc_id % 11 AS c, text, n_chars, lang, lower(text) AS low, (doc_id % 21 - 10) / 10.0 AS v FROM documents)
SELECT doc_id, round(least(0.5 + CASE WHEN trusted THEN 0.3 ELSE 0 END + least(a * 0.05, 0.25) + CASE WHEN length(text) > 200 THEN 0.1 ELSE 0 END, 1.0), 6)::DOUBLE AS candidate_quality,
  round(least(0.5 + CASE WHEN trusted THEN 0.3 ELSE 0 END + least(a * 0.05, 0.2) + least(b * 0.03, 0.15) + least(c * 0.02, 0.1), 1.0), 6)::DOUBLE AS candidate_relevance,
  round(greatest(0, least(10, 5.0 + c * 0.4 + CASE WHEN trusted THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN n_chars < 100 THEN 2 WHEN n_chars < 300 THEN 1 ELSE 0 END)), 6)::DOUBLE AS credibility,
  CASE WHEN doc_id % 3 = 0 THEN 7.0 ELSE 5.0 END::DOUBLE AS freshness, round(CASE WHEN v < 0 THEN 0 ELSE 1 / (v + 1) END, 6)::DOUBLE AS inverse,
  round(a / 10.0 * 0.3 + b / 10.0 * 0.25 + c / 10.0 * 0.25 + 0.2 * 0.5, 6)::DOUBLE AS overall, round(greatest(0, least(1, v * 2)), 6)::DOUBLE AS clamped,
  round(least({_count(WORDS, 'low')} * 0.1 + {_count(MORE, 'low')} * 0.05, 1.0), 6)::DOUBLE AS occurrence FROM t""")
def candidate_scores(spark, d):
    mod = lambda k: F.pmod("doc_id", F.lit(k))
    trusted, v = mod(2) == 0, (mod(21) - 10) / 10.0
    third, author = F.when(mod(3) == 0, "d"), F.when(trusted, "a")
    r = lambda x, name: F.round(x, 6).alias(name)
    return read(spark, d, "documents").select(
        "doc_id", r(S.candidate_quality(trusted, mod(9), "text"), "candidate_quality"), r(S.candidate_relevance(trusted, mod(9), mod(5), mod(11)), "candidate_relevance"),
        r(S.source_credibility(F.lit(5.0) + mod(11) * 0.4, author, third, "n_chars"), "credibility"), S.freshness(third).alias("freshness"), r(S.inverse_distance(v), "inverse"),
        r(S.overall_quality(mod(9) / 10.0, mod(5) / 10.0, mod(11) / 10.0, F.lit(0.5)), "overall"), r(J.clamp(v * 2), "clamped"), r(S.occurrence("text", WORDS, MORE), "occurrence"),
    )


@query(f"""
WITH t AS (SELECT doc_id, lower(source || ' ' || substr(text, 1, 60)) AS q, lower(substr(text, 1, 80)) AS title, lower(coalesce(substr(text, 30, 200), '')) AS snippet, lower('http://' || source || '/x') AS url FROM documents),
w AS (SELECT *, list_distinct({_words('q')}) AS terms FROM t)
SELECT doc_id, round(least(len(list_intersect(terms, {_words('title')})) / greatest(len(terms), 1)::DOUBLE * 0.5 + len(list_intersect(terms, {_words('snippet')})) / greatest(len(terms), 1)::DOUBLE * 0.3
  + len(list_filter(terms, lambda x: contains(url, x))) / greatest(len(terms), 1)::DOUBLE * 0.2 + CASE WHEN contains(title, q) THEN 0.3 WHEN contains(snippet, q) THEN 0.2 ELSE 0 END, 1.0), 6)::DOUBLE AS overlap FROM w""")
def overlap_scores(spark, d):
    q = F.concat(F.col("source"), F.lit(" "), F.substring("text", 1, 60))
    got = S.overlap_relevance(F.substring("text", 1, 80), F.substring("text", 30, 200), F.concat(F.lit("http://"), "source", F.lit("/x")), q)
    return read(spark, d, "documents").select("doc_id", F.round(got, 6).alias("overlap"))


@query(f"""
SELECT doc_id, length(text) < 20 OR {_hits([m.replace("'", "''") for m in L.NAVIGATION_MARKS], 'lower(text)')} >= 2 OR len({_words('text')}) < 5 AS navigation,
  contains('http://' || source || '.org/x', 'src_1') AND false OR NOT (doc_id % 3 = 0 OR doc_id % 5 = 0) OR contains(source, '1') AS allowed FROM documents""")
def text_filters(spark, d):
    robots = F.when(F.pmod("doc_id", F.lit(3)) == 0, "User-agent: *\nDisallow: /pdf").when(F.pmod("doc_id", F.lit(5)) == 0, "User-agent: *\nDisallow: /x")
    url = F.concat(F.lit("http://"), "source", F.lit("/x"))
    return read(spark, d, "documents").select("doc_id", C.is_navigation("text").alias("navigation"), U.allowed_by_robots(url, robots, ("1",)).alias("allowed"))


# Model output -----------------------------------------------------------------------------------------------

_BROKEN = """SELECT event_id, 'Result: "domain": "d' || (event_id % 7) || '", "relevance_score": ' || CASE WHEN event_id % 5 = 0 THEN '1.5' ELSE '0.' || (event_id % 10) END || ', "key_insights": ["a", "b' || (event_id % 3) || '"] and "note": "12"' AS raw FROM events"""


@query(f"""
WITH e AS ({_BROKEN}) SELECT event_id, 'd' || (event_id % 7) AS domain, CASE WHEN event_id % 5 = 0 THEN 1.5 ELSE (event_id % 10) / 10.0 END::DOUBLE AS score, '["a","b' || (event_id % 3) || '"]' AS insights, 12.0::DOUBLE AS note, event_id % 5 <> 0 AS conforms,
  CASE WHEN event_id % 5 = 0 THEN 'general' ELSE 'd' || (event_id % 7) END AS parsed_domain, CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE (event_id % 10) / 10.0 END::DOUBLE AS merged_score, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS n_insights FROM e""")
def model_output(spark, d):
    """Pairs salvaged from text that no repair makes valid; a score of 1.5 does not conform and gives the default."""
    e, n = F.col("event_id"), lambda k: F.pmod("event_id", F.lit(k)).cast("string")
    raw = F.concat(F.lit('Result: "domain": "d'), n(7), F.lit('", "relevance_score": '), F.when(F.pmod("event_id", F.lit(5)) == 0, "1.5").otherwise(F.concat(F.lit("0."), n(10))), F.lit(', "key_insights": ["a", "b'), n(3), F.lit('"] and "note": "12"'))
    rows = read(spark, d, "events").select(e, raw.alias("raw")).withColumn("s", J.salvaged("raw")).withColumn("p", J.parsed("raw"))
    get = lambda c, key: F.get_json_object(c, f"$.{key}")
    merged = J.merged_analysis("p")
    return rows.withColumn("m", merged).select(
        "event_id", get("s", "domain").alias("domain"), get("s", "relevance_score").cast("double").alias("score"), get("s", "key_insights").alias("insights"), get("s", "note").cast("double").alias("note"),
        J.conforms("s", J.ANALYSIS_SCHEMA).alias("conforms"), F.col("m.domain").alias("parsed_domain"), F.col("m.relevance_score").alias("merged_score"), F.size("m.key_insights").alias("n_insights"),
    )


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Invalid type for title: expected <class ''str''>, got BIGINT' WHEN 1 THEN 'Invalid type for tags: expected <class ''list''>, got STRING' WHEN 2 THEN '' ELSE 'Invalid type for is_pdf: expected <class ''bool''>, got BIGINT' END AS errors FROM events""")
def type_errors(spark, d):
    from ..operators import validate as Y

    kind = F.pmod("event_id", F.lit(4))
    raw = F.when(kind == 0, '{"title": 5, "tags": ["a"], "relevance_score": 1}').when(kind == 1, '{"title": "t", "tags": "a"}').when(kind == 2, '{"content_length": true, "relevance_score": 0.5, "is_pdf": false}').otherwise('{"is_pdf": 1}')
    return read(spark, d, "events").select("event_id", raw.alias("record")).select("event_id", F.array_join(Y.type_errors(), ";").alias("errors"))


@query("""
SELECT item_id, CASE item_id % 3 WHEN 0 THEN text || '|second query line of text' WHEN 1 THEN 'what is ' || replace(text, '?', '') || '?' ELSE 'a longer line without marks' END AS queries FROM (SELECT item_id, trim(regexp_replace(substr(text, 1, 40), '[^a-zA-Z ]', '', 'g')) || ' and more words' AS text FROM benchmark)""")
def model_lists(spark, d):
    """Lists in a model's answer: numbered lines, else questions, else all longer lines."""
    text = F.concat(F.trim(F.regexp_replace(F.substring("text", 1, 40), "[^a-zA-Z ]", "")), F.lit(" and more words"))
    kind = F.pmod("item_id", F.lit(3))
    raw = F.when(kind == 0, F.concat(F.lit("Here are the queries:\n1. "), text, F.lit("\n2) second query line of text\n- [placeholder text here]\n* short")))
    raw = raw.when(kind == 1, F.concat(F.lit("Sure, this is what I would ask\nwhat is "), F.replace(text, F.lit("?"), F.lit("")), F.lit("?\nother words without a mark"))).otherwise("Certainly! That is easy\na longer line without marks\ntiny")
    return read(spark, d, "benchmark").select("item_id", F.array_join(E.parsed_list(raw), "|").alias("queries"))


# Expansion --------------------------------------------------------------------------------------------------

_SPECIAL = tuple(L.SPECIAL_TERMS)
_PICKED = tuple(list(L.SPECIAL_WORDS)[:3])


@query(f"""
WITH b AS (SELECT item_id, text, {sql_list((*_SPECIAL, 'none'))}[(item_id % 5 + 1)::INT] AS s, {sql_list((*_PICKED, 'none'))}[(item_id % 4 + 1)::INT] AS p FROM benchmark),
w AS (SELECT *, CASE p {" ".join(f"WHEN '{p}' THEN {sql_list(L.SPECIAL_WORDS[p])}[{_pick("'1:' || text", str(len(L.SPECIAL_WORDS[p])))}]" for p in _PICKED)} ELSE 'agriculture' END AS word FROM b)
SELECT item_id, text || ' ' || CASE s {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SPECIAL_TERMS.items())} ELSE '' END AS specialised, CASE WHEN contains(lower(text), lower(word)) THEN text ELSE text || ' ' || word END AS picked,
  CASE item_id % 4 WHEN 0 THEN text || ' latest news 2024' WHEN 1 THEN text || ' research paper study' WHEN 2 THEN text || ' 2024' ELSE text END AS focused FROM w""")
def query_suffixes(spark, d):
    at = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod("item_id", F.lit(k)) + 1).cast("int"))
    focus = at(("news", "academic", "recent", "general"), 4)
    return read(spark, d, "benchmark").select("item_id", E.specialised("text", at((*_SPECIAL, "none"), 5)).alias("specialised"), E.with_picked_word("text", at((*_PICKED, "none"), 4)).alias("picked"), E.focused("text", focus, 2024).alias("focused"))


_ROUTES = (("first", "the, of", "and"), ("second", "que, la", "der, en"), ("third", "die", "in"))


@query("""
WITH s AS (SELECT item_id, text, 2 * (contains(t, 'the')::INT + contains(t, 'of')::INT) + contains(t, 'and')::INT AS a, 2 * (contains(t, 'que')::INT + contains(t, 'la')::INT) + contains(t, 'der')::INT + contains(t, 'en')::INT AS b, 2 * contains(t, 'die')::INT + contains(t, 'in')::INT AS c
  FROM (SELECT item_id, text, lower(text) AS t FROM benchmark)),
g AS (SELECT *, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS agent FROM s)
SELECT item_id, agent, text || CASE agent WHEN 'first' THEN ' the, of and' WHEN 'second' THEN ' que, la der, en' WHEN 'third' THEN ' die in' ELSE '' END AS agent_query FROM g""")
def routed_queries(spark, d):
    return E.routed(read(spark, d, "benchmark"), "text", _ROUTES).select("item_id", "agent", "agent_query")


@query(f"""
WITH b AS (SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN [] ELSE list_transform(range(1, (item_id % 4 + 2)::BIGINT), lambda i: text || ' ' || i) END::VARCHAR[] AS q FROM benchmark)
SELECT item_id, CASE WHEN len(q) > 0 THEN q[{_pick("'1:' || array_to_string(q, '|')", 'greatest(len(q), 1)')}] ELSE 'area special place' END AS query,
  'Base queries:' || chr(10) || array_to_string(list_transform(list_slice(q, 1, 10), lambda x: '- ' || x), chr(10)) || chr(10) || 'Write one new search query a line.' AS expansion,
  'Title: T' || chr(10) || 'Content: ' || substr(text, 1, 100) || chr(10) || 'Answer with one JSON object.' AS extraction FROM b""")
def query_or_fallback(spark, d):
    n = F.pmod("item_id", F.lit(4)) + 1
    some = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.concat(F.col("text"), F.lit(" "), i.cast("string")))
    rows = read(spark, d, "benchmark").withColumn("q", F.when(F.pmod("item_id", F.lit(3)) == 0, F.array().cast("array<string>")).otherwise(some))
    return rows.select("item_id", E.or_fallback("q", F.lit("area"), F.lit("special"), F.lit("place")).alias("query"), E.expansion_prompt("q").alias("expansion"), E.extraction_prompt(F.lit("T"), "text", 100).alias("extraction"))


# Citations --------------------------------------------------------------------------------------------------

_RESULTS = """
WITH db AS (SELECT vec_id % 20 AS sub, (vec_id // 20)::INT AS rank, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'T' || vec_id END AS title, 'src' || label AS source, repeat('chunk ' || (vec_id % 50) || ' ', (vec_id % 40 + 1)::INT) AS text, (vec_id % 10) / 10.0 AS score FROM embeddings),
web AS (SELECT page_id % 20 AS sub, (page_id // 20)::INT AS rank, 'P' || page_id AS title, url, substr(html, 1, 250) AS snippet, CASE WHEN page_id % 2 = 0 THEN substr(html, 1, 400) ELSE '' END AS content, (page_id % 7) / 10.0 AS score FROM pages),
c AS (SELECT sub, rank, 'database' AS type, 'DB-' || (sub + 1) || '-' || (rank + 1) AS citation_id, coalesce(nullif(title, ''), source) AS title, source AS url, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS content_preview, score::DOUBLE AS score, text AS full_content FROM db
  UNION ALL SELECT sub, rank, 'web', 'WEB-' || (sub + 1) || '-' || (rank + 1), title, url, CASE WHEN length(snippet) > 200 THEN substr(snippet, 1, 200) || '...' ELSE snippet END, score::DOUBLE, coalesce(nullif(content, ''), snippet) FROM web)"""


def results(spark, d) -> DataFrame:
    v, p = read(spark, d, "embeddings"), read(spark, d, "pages")
    mod = lambda c, k: F.pmod(c, F.lit(k))
    db = v.select(
        mod("vec_id", 20).alias("sub"), F.floor(F.col("vec_id") / 20).cast("int").alias("rank"), F.when(mod("vec_id", 3) == 0, "").otherwise(F.concat(F.lit("T"), F.col("vec_id").cast("string"))).alias("title"), F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"),
        F.call_function("repeat", F.concat(F.lit("chunk "), mod("vec_id", 50).cast("string"), F.lit(" ")), (mod("vec_id", 40) + 1).cast("int")).alias("text"), (mod("vec_id", 10) / 10.0).alias("score"),
    )
    web = p.select(mod("page_id", 20).alias("sub"), F.floor(F.col("page_id") / 20).cast("int").alias("rank"), F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("title"), "url", F.substring("html", 1, 250).alias("snippet"), F.when(mod("page_id", 2) == 0, F.substring("html", 1, 400)).otherwise("").alias("content"), (mod("page_id", 7) / 10.0).alias("score"))
    return K.flattened(db, web)


@query(f"{_RESULTS} SELECT sub, rank, type, citation_id, title, url, md5(content_preview) AS preview, score, md5(full_content) AS content FROM c")
def citations_flat(spark, d):
    return results(spark, d).select("sub", "rank", "type", "citation_id", "title", "url", F.md5("content_preview").alias("preview"), "score", F.md5("full_content").alias("content"))


@query(f"{_RESULTS} SELECT md5(full_content) AS content_hash, arg_max(citation_id, (sub * 10 + (type = 'web')::INT) * 1000000 + rank) AS citation_id FROM c GROUP BY 1")
def citation_content_map(spark, d):
    return K.content_map(results(spark, d))


@query("""
SELECT conv_id, string_agg('[' || r || '] ' || role || '. d' || turn || '. http://x/' || turn, chr(10) ORDER BY r) AS citations,
  'Web Search Results:' || chr(10) || chr(10) || string_agg(r || '. **' || role || '**' || chr(10) || '   Source: http://x/' || turn || chr(10) || '   Domain: d' || turn || chr(10) || '   Content: ' || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY r) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id""")
def hit_context(spark, d):
    t = F.col("turn").cast("string")
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("title"), F.concat(F.lit("d"), t).alias("domain"), F.concat(F.lit("http://x/"), t).alias("url"), F.coalesce("text", F.lit("")).alias("snippet"))
    return K.hit_lines(rows, "conv_id", "turn")


_RESPONSES = "SELECT conv_id, turn AS ord, turn % 4 <> 3 AS success, ['[1] page ' || (turn % 3), '[12] page ' || (conv_id % 5), '[2] page ' || (turn % 2)] AS citations, (turn % 5) * 1.5 + 0.25 AS t FROM conversations"


@query(f"""
WITH r AS ({_RESPONSES}), x AS (SELECT conv_id, ord, unnest(citations) AS c, generate_subscripts(citations, 1) AS pos FROM r WHERE success),
f AS (SELECT conv_id, c, min(ord * 10 + pos) AS place FROM x GROUP BY ALL), n AS (SELECT conv_id, string_agg('[' || k || '] ' || regexp_replace(c, '^\\[\\d+\\] ', ''), '|' ORDER BY k) AS citations FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS k FROM f) GROUP BY conv_id),
t AS (SELECT conv_id, count(*) FILTER (WHERE success) AS agent_count, count(*) FILTER (WHERE NOT success) AS failed_agents, round(coalesce(sum(CASE WHEN success THEN t END), 0), 6)::DOUBLE AS total_time FROM r GROUP BY conv_id)
SELECT t.conv_id, agent_count, failed_agents, total_time, coalesce(n.citations, '') AS citations, agent_count > 0 AS success FROM t LEFT JOIN n ON t.conv_id = n.conv_id""")
def citations_merged(spark, d):
    t, c = F.col("turn"), F.col("conv_id")
    cited = lambda mark, n: F.concat(F.lit(f"[{mark}] page "), n.cast("string"))
    rows = read(spark, d, "conversations").select("conv_id", t.alias("ord"), (F.pmod(t, F.lit(4)) != 3).alias("success"), F.array(cited(1, F.pmod(t, F.lit(3))), cited(12, F.pmod(c, F.lit(5))), cited(2, F.pmod(t, F.lit(2)))).alias("citations"), (F.pmod(t, F.lit(5)) * 1.5 + 0.25).alias("execution_time"))
    return K.merged(rows, "conv_id").withColumn("citations", F.array_join("citations", "|"))


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'T - ' || url || '|raw text' WHEN 1 THEN url || '|raw text' WHEN 2 THEN 'raw text' ELSE 'U - http://link|raw text' END AS strings FROM pages""")
def citation_strings(spark, d):
    k = F.pmod("page_id", F.lit(4))
    none = F.lit(None).cast("string")
    one = F.struct(F.when(k == 0, "T").when(k == 2, "D").when(k == 3, "U").otherwise("").alias("title"), F.when(k < 2, F.col("url")).alias("url"), F.when(k == 3, "http://link").alias("link"), none.alias("raw"))
    raw = F.struct(none.alias("title"), none.alias("url"), none.alias("link"), F.lit("raw text").alias("raw"))
    return read(spark, d, "pages").select("page_id", F.array_join(K.as_strings(F.array(one, raw)), "|").alias("strings"))


@query(r"""
WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, turn, text || ' [DB-' || turn || '-1] x [WEB-1-1]' || repeat(' [API-9-9]', (turn % 8)::INT) AS text FROM conversations),
i AS (SELECT *, regexp_extract_all(text, '\[([A-Z]+-\d+-\d+)\]', 1) AS ids, length(text) AS n FROM a)
SELECT answer_id, len(ids)::INT AS total_citations, len(list_filter(ids, lambda x: x IN ('DB-1-1', 'WEB-1-1')))::INT AS valid_citations,
  array_to_string(list_filter(ids, lambda x: x NOT IN ('DB-1-1', 'WEB-1-1')), ',') AS unknown, CASE WHEN turn % 8 > 0 THEN n - 10 * (turn % 8) + 1 WHEN turn <> 1 THEN n - (length('[DB-' || turn || '-1] x [WEB-1-1]')) END::INT AS first_unknown_at_end,
  CASE WHEN turn % 8 > 5 THEN 'API-9-9' ELSE '' END AS excessive FROM i""")
def citation_report(spark, d):
    c = read(spark, d, "conversations")
    more = F.call_function("repeat", F.lit(" [API-9-9]"), F.pmod("turn", F.lit(8)).cast("int"))
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "turn", F.concat("text", F.format_string(" [DB-%d-1] x [WEB-1-1]", "turn"), more).alias("text"))
    known = rows.select("answer_id", F.explode(F.array(F.lit("DB-1-1"), F.lit("WEB-1-1"))).alias("citation_id"))
    got = K.report(rows, known).join(rows.select("answer_id", "turn"), "answer_id")
    ours = F.filter("missing_sources", lambda x: F.when(F.pmod("turn", F.lit(8)) > 0, x["citation_id"] == "API-9-9").otherwise(True))
    return got.select("answer_id", "total_citations", "valid_citations", F.array_join(F.transform("missing_sources", lambda x: x["citation_id"]), ",").alias("unknown"), F.try_element_at(ours, F.lit(1))["position"].alias("first_unknown_at_end"), F.array_join("excessive", ",").alias("excessive"))


@query("""
WITH r AS (SELECT conv_id, list('DB-' || turn || '-1' ORDER BY 'DB-' || turn || '-1') AS ids, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_concat(list_transform(list_slice(ids, 1, 3), lambda x: '   [' || x || '] - Title ' || x || ' (database)'), CASE WHEN n > 3 THEN ['   ... and ' || (n - 3) || ' more citations available'] ELSE [] END), chr(10)) AS list FROM r""")
def reference_list(spark, d):
    i = F.format_string("DB-%d-1", "turn")
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(i.alias("citation_id"), F.concat(F.lit("Title "), i).alias("title"), F.lit("database").alias("source"))).alias("c"))
    return rows.select("conv_id", K.reference_list("c", 3).alias("list"))


_SENTENCES = rf"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+{_W}'), lambda x: trim(x)), lambda x: len({_words('x')}) >= 3)"


@query(f"SELECT doc_id AS citation_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INT AS pos FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def source_sentences(spark, d):
    return K.source_sentences(read(spark, d, "documents").select(F.col("doc_id").alias("citation_id"), F.col("text").alias("content")))


@query(f"""
WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS sentence FROM documents)
SELECT doc_id, count(*) AS n, sum(length(sentence))::DOUBLE AS length, sum(length(sentence) - length(replace(sentence, 'e', '')))::DOUBLE AS e,
       (SELECT count(DISTINCT sentence) FROM s) AS embedded FROM s GROUP BY doc_id""")
def embedded_once(spark, d):
    """Sentences of all documents through a batch model and its store, in two runs: each distinct one is
    embedded once.  The model counts letters."""
    from ..operators.embedding import EmbeddingStore

    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), t.count("e")] for t in texts], float)

    # Read four times below, so sentences are cut once, and written.
    rows, path = read(spark, d, "documents").select("doc_id", F.explode(X.sentences("text")).alias("sentence")), new_path(spark, "sentences")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    store = EmbeddingStore(spark, new_path(spark, "embeddings"), load, 2, batch_size=1000)
    new = store.add(rows.where("doc_id % 2 = 0"), "sentence") + store.add(rows, "sentence")
    got = store.embed(rows, "sentence")
    sums = [F.sum(F.col("vector")[k]).alias(name) for k, name in enumerate(("length", "e"))]
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("embedded", F.lit(new))


@query(f"SELECT conv_id, turn, unnest(s) AS sentence, (strpos(text, unnest(s)) - 1)::INT AS at FROM (SELECT conv_id, turn, text, list_slice({_SENTENCES}, 1, 1) AS s FROM conversations)")
def sentence_places(spark, d):
    rows = read(spark, d, "conversations").withColumn("s", F.slice(X.sentences("text"), 1, 1)).withColumn("at", K.places("text", F.col("s")))
    return rows.select("conv_id", "turn", F.explode(F.arrays_zip("s", "at")).alias("z")).select("conv_id", "turn", F.col("z.s").alias("sentence"), F.col("z.at").alias("at"))


@query()
def ratio_matches(spark, d):
    """Sentences of all conversations against the benchmark's by Ratcliff-Obershelp ratio, tested
    against all pairs by difflib."""
    ship_package(spark)
    rows = read(spark, d, "conversations")
    asked = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sent_id"), F.explode(X.sentences("text")).alias("sentence"))
    known = K.source_sentences(read(spark, d, "benchmark").select(F.col("item_id").alias("citation_id"), F.col("text").alias("content")))
    return K.matching_texts(asked, known, 0.5)


@query()
def near_copy_turns(spark, d):
    """Turns of all conversations whose whole texts differ and are alike by a ratio of 0.75 or more, tested
    against all pairs by difflib."""
    from ..operators import ratio

    rows = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return ratio.near_copies(rows, "id", "text", 0.75)


@query("""
SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' [DB-1-1]' WHEN turn % 3 = 1 THEN ' [DB-1-1][WEB-2-2]' ELSE '' END AS marked, CASE WHEN turn % 2 = 0 THEN text || '<note>' ELSE text END AS noted FROM conversations""".replace("<note>", K.NOTE.replace("'", "''").replace("\n\n", "' || chr(10) || chr(10) || '")))
def citation_marks(spark, d):
    k = F.pmod("turn", F.lit(3))
    ids = F.when(k == 0, F.array(F.lit("DB-1-1"))).when(k == 1, F.array(F.lit("DB-1-1"), F.lit("WEB-2-2"))).otherwise(F.array().cast("array<string>"))
    uncited = F.when(F.pmod("turn", F.lit(2)) == 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.concat("text", K.format_ids(ids)).alias("marked"), K.with_note("text", uncited, F.array(F.lit("DB-1-1"))).alias("noted"))


# State and reports --------------------------------------------------------------------------------------------

_STATE = """
WITH n AS (SELECT page_id, md5(split_part(replace(regexp_replace(trim(lower(url)), '/+$', ''), 'www.', ''), '?', 1)) AS u, 'title ' || (page_id % 90) AS t, md5('body ' || (page_id % 120)) AS c FROM pages)"""


def state_rows(spark, d) -> DataFrame:
    p = read(spark, d, "pages")
    return p.select("page_id", "url", F.concat(F.lit("Title "), F.pmod("page_id", F.lit(90)).cast("string")).alias("title"), F.concat(F.lit(" BODY  "), F.pmod("page_id", F.lit(120)).cast("string")).alias("content"))


@query(f"{_STATE} SELECT count(DISTINCT u) AS total_urls, count(DISTINCT t) AS total_titles, count(DISTINCT c) AS total_content_hashes FROM n")
def state_counts(spark, d):
    return D.state_counts(D.state_of(state_rows(spark, d)))


@query(f"""{_STATE}, s AS (SELECT * FROM n WHERE page_id % 3 = 0)
SELECT page_id, u IN (SELECT u FROM s) AS is_duplicate_url, t IN (SELECT t FROM s) OR c IN (SELECT c FROM s) AS is_duplicate_content FROM n""")
def state_membership(spark, d):
    rows = state_rows(spark, d)
    return D.membership(rows, D.state_of(rows.where("page_id % 3 = 0"))).select("page_id", "is_duplicate_url", "is_duplicate_content")


@query(f"""{_STATE}, s AS (SELECT * FROM n WHERE page_id % 50 = 0) SELECT page_id FROM n WHERE u NOT IN (SELECT u FROM s) AND t NOT IN (SELECT t FROM s) AND c NOT IN (SELECT c FROM s)""")
def state_filter(spark, d):
    """The state is written and read back; nothing of this run is marked."""
    rows = state_rows(spark, d)
    path = new_path(spark, "state")
    sinks.write_state(D.state_of(rows.where("page_id % 50 = 0")), path)
    return D.against_state(rows, readers.state(spark, path)).select("page_id")


@query("""
WITH l AS (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10)
SELECT user_id, round((sum(value::DECIMAL(38,10))::DOUBLE / count(value)), 6) AS last_mean FROM l GROUP BY user_id ORDER BY last_mean DESC, user_id LIMIT 5""")
def top_by_last_mean(spark, d):
    return R.top_by_last_mean(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query("""
SELECT event_type, user_id, CASE WHEN grouping(event_type, user_id) = 0 THEN 0 WHEN grouping(event_type, user_id) = 1 THEN 1 ELSE 2 END AS level, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_success, round(coalesce(sum(value::DECIMAL(38,10))::DOUBLE, 0), 4) AS total
FROM events GROUP BY ROLLUP (event_type, user_id)""")
def summary_levels(spark, d):
    return R.levels(read(spark, d, "events"), F.col("value") > 50, "value", "event_type", "user_id")


@query("""
WITH f AS (SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2)
SELECT facet, value, n, NULL::DOUBLE AS mean FROM f QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 10
UNION ALL SELECT 'all', NULL, count(*), round(sum(n_chars::DECIMAL(38,10))::DOUBLE / count(n_chars), 6) FROM documents""")
def output_analysis(spark, d):
    return R.analysed(read(spark, d, "documents"), ["lang", "source"], "n_chars")


@query("""
WITH r AS (SELECT event_id, row_number() OVER w AS nth, (sum((event_type <> 'error')::INT) OVER w)::DOUBLE / count(*) OVER w AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN nth % 10 <> 0 THEN 0.1 WHEN round(rate, 6) > 0.8 THEN 0.1 WHEN round(rate, 6) > 0.5 THEN 0.2 ELSE 0.4 END::DOUBLE AS delay FROM r""")
def adaptive_delay(spark, d):
    return R.adaptive_delay(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "delay")


@query("SELECT unnest(range(0, 4))::INT AS ord, unnest(['crop_specialist', 'soil_expert', 'pest_manager', 'sustainability_advisor']) AS agent")
def agent_relation(spark, d):
    return E.agents(spark).select("ord", "agent")


# Sources and sinks --------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents WHERE source = 'src_3' OR doc_id % 2 = 0")
def jsonl_scan(spark, d):
    """Written as JSON lines, some of them blank or broken, and read back by predicate."""
    path = new_path(spark, "lines")
    rows = read(spark, d, "documents").select("doc_id", "lang", "source")
    broken = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(F.to_json(F.struct("*")), F.lit("\n\n{broken"))).otherwise(F.to_json(F.struct("*")))
    sinks.write_text(rows.select(broken.alias("line")), "line", path)
    return readers.jsonl(spark, path, "doc_id long, lang string, source string", keep=(F.col("doc_id") % 2 == 0) | readers.equal_domain("src_3", "source")).drop("row_idx")


#: Characters of a file that ``in_order`` writes, about: two splits or more.
FILE_CHARS = 256 << 20


def in_order(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows sorted by key over partitions, one for each ``FILE_CHARS`` of text."""
    chars = rows.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return rows.repartitionByRange(max(1, -(-chars // FILE_CHARS)), key).sortWithinPartitions(key)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS row_idx FROM documents")
def jsonl_row_index(spark, d):
    """Files in order of id, each read in many splits: the number of each line over all of them."""
    path = new_path(spark, "numbered")
    sinks.write_json(in_order(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"), path)
    return readers.jsonl(spark, path, "doc_id long, text string", over_all=True).select("doc_id", "row_idx")


@query("SELECT page_id, url FROM pages")
def json_array_scan(spark, d):
    """One array of objects, with a broken one among them, written as text and streamed back."""
    path = new_path(spark, "array")
    rows = read(spark, d, "pages").select("page_id", "url").repartitionByRange(1, "page_id").sortWithinPartitions("page_id")
    line = F.concat(F.when(F.monotonically_increasing_id() == 0, "[{\"page_id\": }, ").otherwise(", "), F.to_json(F.struct("page_id", "url")))
    sinks.write_text(rows.select(line.alias("line")), "line", path)
    return readers.json_document(spark, path, "page_id long, url string")


@query("SELECT page_id, html FROM pages")
def json_array_splits(spark, d):
    """Whole pages as arrays, each a file of one line, read in splits by many tasks."""
    path = new_path(spark, "array")
    rows = in_order(read(spark, d, "pages").select("page_id", "html"), "page_id", "html")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    line = F.concat(F.when(first, "[").otherwise(", "), F.to_json(F.struct("page_id", "html")))
    rows.select(line.alias("line")).write.option("lineSep", " ").text(path)
    return readers.json_document(spark, path, "page_id long, html string", large=0)


@query("SELECT page_id, url FROM pages")
def metadata_copy(spark, d):
    """A JSON document read twice: the second time from the Parquet copy that the first has left."""
    path = new_path(spark, "metadata")
    sinks.write_json(read(spark, d, "pages").select("page_id", "url"), path)
    readers.metadata(spark, path, "page_id long, url string")
    return readers.metadata(spark, path, "page_id long, url string")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, id, rank::INT AS rank FROM (SELECT q.query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM q, embeddings v) WHERE rank <= 2""")
def stored_index(spark, d):
    """An index that is written, checked and read back, and searched."""
    path = new_path(spark, "index")
    sinks.write_index(V.index(read(spark, d, "embeddings"), "vec_id", "embedding"), path)
    flat = sinks.read_index(spark, path)
    return V.top_k(flat.where("id % 20 = 0").withColumnRenamed("id", "query_id"), flat, 2, digits=9).select("query_id", "id", "rank")


@query("SELECT item_id::VARCHAR AS id, text AS question FROM benchmark")
def csv_questions(spark, d):
    path = new_path(spark, "questions")
    sinks.write_csv(read(spark, d, "benchmark").select(F.col("item_id").alias("ID"), F.col("text").alias("question")), path)
    return readers.questions(spark, path)


@query("SELECT 'line ' || lpad(item_id::VARCHAR, 6, '0') AS value FROM benchmark ORDER BY 1 DESC LIMIT 7")
def text_tail(spark, d):
    path = new_path(spark, "text")
    rows = read(spark, d, "benchmark").select(F.concat(F.lit("line "), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("line"))
    sinks.write_text(rows.repartitionByRange(3, "line").sortWithinPartitions("line"), "line", path)
    return readers.text_lines(spark, path, tail=7).select("value")


@query("SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents")
def append_batches(spark, d):
    path = new_path(spark, "appended")
    rows = read(spark, d, "documents").select("doc_id")
    n = [sinks.append_jsonl(rows, path) for _ in range(2)]
    assert n[0] == n[1]
    return spark.read.schema("doc_id long").json(path)


@query("SELECT 1::BIGINT AS version, 'first' AS created, false AS current UNION ALL SELECT 2, 'second', true UNION ALL SELECT 3, 'third', false")
def version_catalogue(spark, d):
    """Three versions of a table, and a rollback to the second."""
    versions = sinks.Versions(spark, new_path(spark, "versions"))
    for name in ("first", "second", "third"):
        versions.write(read(spark, d, "region"), name)
    versions.rollback(2)
    assert versions.current().count() == read(spark, d, "region").count()
    return versions.manifest().select("version", "created", "current")


@query("SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM documents GROUP BY lang")
def versions_parallel(spark, d):
    """Documents by language, each written as a version by a writer of its own at the same time."""
    from concurrent.futures import ThreadPoolExecutor

    docs = read(spark, d, "documents")
    langs = [r.lang for r in docs.select("lang").distinct().limit(1000).collect()]
    root = new_path(spark, "versions")
    write = lambda x: sinks.Versions(spark, root).write(docs.where(F.col("lang").eqNullSafe(x)), str(x), most=1000)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(write, langs))
    store = sinks.Versions(spark, root)
    assert sorted(numbers) == list(range(1, len(langs) + 1))
    rows = store.at(numbers[0])
    for n in numbers[1:]:
        rows = rows.unionByName(store.at(n))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_ids"))


@query("""
WITH e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events), m AS (SELECT max(t) AS t FROM e), u AS (SELECT DISTINCT user_id FROM e),
l AS (SELECT user_id, max(t) AS t, arg_max(event_id, (t, event_id)) AS event_id FROM e WHERE user_id % 3 <> 0 GROUP BY user_id),
r AS (SELECT *, row_number() OVER (ORDER BY t DESC, md5(user_id || ':8:all')) AS nth FROM l)
SELECT u.user_id, (r.user_id IS NOT NULL AND nth <= 60 AND m.t - r.t < 200000) AS hit, CASE WHEN nth <= 60 AND m.t - r.t < 200000 THEN event_id::VARCHAR END AS result
FROM u CROSS JOIN m LEFT JOIN r USING (user_id)""")
def result_cache(spark, d):
    """Results of the users' searches, set in two runs with a compaction between them, and looked up: some were
    never set, some are too old, some had to make room."""
    from ..sources.versions import ResultCache, cache_key

    rows = read(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    first, last = rows.agg(F.expr("percentile_approx(t, 0.5)"), F.max("t")).first()
    key = cache_key(F.col("user_id").cast("string"), F.lit(8), F.lit("all"))
    cache = ResultCache(spark, new_path(spark, "cache"), ttl=200_000, most=60)
    for part, now in ((rows.where(F.col("t") <= first), first), (rows.where(F.col("t") > first), last)):
        sets = part.where("user_id % 3 <> 0").groupBy("user_id").agg(F.max(F.struct("t", "event_id")).alias("e"))
        cache.set(sets.select(key.alias("key"), F.col("e.event_id").cast("string").alias("result"), "e.t"), F.col("t"))
        cache.compact(now) if now == first else None
    return cache.get(rows.select("user_id").distinct().withColumn("key", key), last).select("user_id", "hit", "result")


@query("SELECT user_id % 7 AS agent, event_id FROM events WHERE user_id % 7 <> 3")
def batch_successes(spark, d):
    """Entries of the agents that succeeded."""
    path = new_path(spark, "successes")
    rows = read(spark, d, "events").groupBy(F.pmod("user_id", F.lit(7)).alias("agent")).agg(F.collect_list(F.struct(F.pmod("user_id", F.lit(7)).alias("agent"), "event_id")).alias("data_entries"))
    sinks.write_successes(rows.withColumn("success", F.col("agent") != 3), path)
    return spark.read.schema("agent long, event_id long").json(path)


@query("""
WITH a AS (SELECT user_id % 5 AS agent, count(*) AS entries FROM events GROUP BY 1)
SELECT 'run' AS run, (SELECT count(*) FROM a) AS agents, (SELECT sum(entries) FROM a)::BIGINT AS total, string_agg(agent || ':' || entries, ',' ORDER BY agent) AS each FROM a""")
def analytics_document(spark, d):
    agents = read(spark, d, "events").groupBy(F.pmod("user_id", F.lit(5)).alias("agent")).agg(F.count(F.lit(1)).alias("entries"))
    doc = F.from_json("document", "agents long, total_entries long, agent_performance array<struct<agent: long, entries: long>>")
    got = sinks.analytics(agents, "agent", "run").select("run", doc.alias("d"))
    return got.select("run", "d.agents", F.col("d.total_entries").alias("total"), F.array_join(F.transform("d.agent_performance", lambda x: F.concat(x["agent"].cast("string"), F.lit(":"), x["entries"].cast("string"))), ",").alias("each"))


@query(f"""
WITH r AS (SELECT doc_id, text || ' ' || substr(text, 1, 50) AS text, md5('https://x/' || source || doc_id) AS record_id FROM documents), c AS ({_CHUNK.replace('FROM documents', 'FROM r').replace('WITH t', 'WITH t').strip()})
SELECT r.record_id, chunk_id, chunk_hash FROM c JOIN r USING (doc_id) WHERE chunk_length >= 50""".replace("md5(CASE WHEN n <= 256 THEN text ELSE array_to_string(list_slice(w, s + 1, s + 256), ' ') END) AS chunk_hash", "length(trim(CASE WHEN n <= 256 THEN text ELSE array_to_string(list_slice(w, s + 1, s + 256), ' ') END, ' ')) AS chunk_length, md5(CASE WHEN n <= 256 THEN text ELSE array_to_string(list_slice(w, s + 1, s + 256), ' ') END) AS chunk_hash"))
def record_chunks(spark, d):
    rows = read(spark, d, "documents").select(F.col("text").alias("text_extracted"), F.substring("text", 1, 50).alias("abstract"), F.concat(F.lit("https://x/"), "source").alias("link"), F.col("doc_id").alias("row_idx"), F.lit(None).cast("double").alias("relevance_score"))
    return chunking.record_chunks(rows).select("record_id", "chunk_id", F.md5("chunk_text").alias("chunk_hash"))


# Reports, streams and state machines ----------------------------------------------------------------------------


_MATERIAL = """
WITH q AS (SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) v(item_id, text)), c AS (SELECT conv_id % 2 + 1 AS item_id, (turn % 3)::INT AS sub, CASE WHEN turn % 2 = 0 THEN 'database' ELSE 'web' END AS type, (conv_id * 100 + turn)::INT AS rank,
  CASE WHEN turn % 2 = 0 THEN 'DB-' ELSE 'WEB-' END || (turn % 3 + 1) || '-' || (conv_id * 100 + turn + 1) AS citation_id, role AS title, 'u' || turn AS url, substr(coalesce(text, ''), 1, 30) AS content_preview FROM conversations)"""


@query(_MATERIAL + """, n AS (SELECT *, row_number() OVER (PARTITION BY item_id, sub ORDER BY type, rank, citation_id) AS i FROM c),
s AS (SELECT item_id, sub, '## Sub-query ' || (sub + 1) || chr(10) || chr(10) || string_agg(i || '. **' || title || '** [' || citation_id || ']' || chr(10) || '   ' || content_preview, chr(10) ORDER BY i) AS section FROM n GROUP BY item_id, sub),
b AS (SELECT item_id, string_agg(section, chr(10) || chr(10) ORDER BY sub) AS body FROM s GROUP BY 1),
x AS (SELECT item_id, string_agg('- [' || citation_id || '] ' || title || ' - ' || url, chr(10) ORDER BY citation_id, title, url) AS idx, count(*) FILTER (WHERE type = 'database') AS n_db, count(*) FILTER (WHERE type = 'web') AS n_web FROM c GROUP BY 1)
SELECT q.item_id::BIGINT AS item_id, '# ' || coalesce(text, '') || coalesce(chr(10) || chr(10) || body, '') || coalesce(chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || idx, '') || chr(10) || chr(10) || 'Database: ' || coalesce(n_db, 0) || ', web: ' || coalesce(n_web, 0) AS report
FROM q LEFT JOIN b ON q.item_id = b.item_id LEFT JOIN x ON q.item_id = x.item_id""")
def rendered_report(spark, d):
    """Sections, citation index and counts; the third question has no citations."""
    t, c = F.col("turn"), F.col("conv_id")
    rank, even = (c * 100 + t).cast("int"), F.pmod(t, F.lit(2)) == 0
    sub = F.pmod(t, F.lit(3)).cast("int")
    name = F.concat(F.when(even, "DB-").otherwise("WEB-"), (sub + 1).cast("string"), F.lit("-"), (rank + 1).cast("string"))
    rows = read(spark, d, "conversations").select((F.pmod(c, F.lit(2)) + 1).alias("item_id"), sub.alias("sub"), F.when(even, "database").otherwise("web").alias("type"), rank.alias("rank"), name.alias("citation_id"), F.col("role").alias("title"), F.concat(F.lit("u"), t.cast("string")).alias("url"), F.substring(F.coalesce("text", F.lit("")), 1, 30).alias("content_preview"))
    questions = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "item_id long, text string")
    return K.rendered(questions, rows)


@query()
def sub_query_material(spark, d):
    """Chunks and web hits of every question's sub-queries, tested against its parts."""
    from .pipelines import build_index, material

    ship_package(spark)
    path = new_path(spark, "chunks")
    sinks.write_index(build_index(read(spark, d, "documents")), path)
    got = material(read(spark, d, "benchmark"), sinks.read_index(spark, path), searched(spark, d).drop("item_id").distinct(), agents=_ROUTES)
    return got.select("item_id", "sub", "type", "rank", "citation_id", "title", "url", F.md5("full_content").alias("content"))


@query(f"""
WITH h AS (SELECT item_id, query, rank, href FROM ({_SEARCH})), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY item_id, split_part(replace(regexp_replace(trim(lower(href)), '/+$', ''), 'www.', ''), '?', 1) ORDER BY query, rank) = 1)
SELECT item_id, query, rank, href FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY query, rank) <= 5""")
def web_first_five(spark, d):
    """Distinct URLs of each question, the first five of them."""
    rows = searched(spark, d).select("item_id", "query", "rank", "href")
    first = D.keep_first(rows.withColumn("k", F.struct("item_id", U.normalize("href"))), "k", ["query", "rank"]).drop("k")
    return R.last_rows(first, "item_id", [F.col("query"), F.col("rank")], 5)


@query(f"""
SELECT doc_id, array_to_string(list_concat([lang], list_filter(['a', 'b', 'c'], lambda t: (t = 'a' AND (contains(lower(text), 'the') OR contains(lower(text), 'of'))) OR (t = 'b' AND contains(lower(text), 'que')) OR (t = 'c' AND contains(lower(text), 'der')))), ',') AS tags,
  CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN contains('http://' || source || '.org', '_1') ELSE contains('http://' || source || '.org', '_2') OR contains('http://' || source || '.org', '_3') END AS goes FROM documents""")
def ordered_tags(spark, d):
    patterns = F.when(F.pmod("doc_id", F.lit(3)) == 1, F.array(F.lit("_1"))).when(F.pmod("doc_id", F.lit(3)) == 2, F.array(F.lit("_2"), F.lit("_3")))
    return read(spark, d, "documents").select("doc_id", F.array_join(C.tags_in_order("text", F.col("lang"), {"a": ("the", "of"), "b": ("que",), "c": ("der",)}), ",").alias("tags"), C.goes_to(F.concat(F.lit("http://"), "source", F.lit(".org")), patterns).alias("goes"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events),
g(user_id, event_id, i, room, last, delay) AS (SELECT user_id, event_id, i, 1.0::DOUBLE, t, 0.0::DOUBLE FROM e WHERE i = 1 UNION ALL
  SELECT user_id, event_id, i, CASE WHEN room >= 1 THEN room - 1 ELSE room END, t, CASE WHEN room >= 1 THEN 0.0 ELSE (1 - room) / 0.00001::DOUBLE END FROM (
    SELECT e.user_id, e.event_id, e.i, e.t, least(2.0::DOUBLE, g.room + (e.t - g.last) * 0.00001::DOUBLE) AS room FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1))
SELECT event_id, round(delay, 3) AS delay FROM g""")
def token_bucket(spark, d):
    """A bucket of two tokens, one more in 100,000 seconds, for each user."""
    ship_package(spark)
    rows = read(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"))
    rows = rows.withColumn("o", F.struct("t", "event_id"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return R.token_bucket(rows.drop("o").withColumn("nth", nth), "user_id", "nth", "t", 0.00001, 2.0).select("event_id", F.round("delay", 3).alias("delay"))


@query("SELECT (row_number() OVER () - 1)::INT AS ord, q AS query FROM (SELECT unnest(['a', 'b', 'c']) AS q)")
def static_queries(spark, d):
    return E.query_list(spark, ["a", "b", "c", "d"], 3)


@query("SELECT DISTINCT split_part(replace(regexp_replace(trim(lower(url)), '/+$', ''), 'www.', ''), '?', 1) AS url FROM pages")
def stream_distinct(spark, d):
    """Records as a stream of files, each twice; one of each URL is written, exactly once."""
    from ..schemas import CORPUS_RECORD
    from ..streaming import ingest

    source, target, mark = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    rows = read(spark, d, "pages").select(F.col("url").alias("link"), F.lit("t").alias("title"), F.lit("2024-01-01T00:00:00").alias("extraction_timestamp"))
    for _ in range(2):
        rows.write.mode("append").json(source)
    stream = ingest.distinct_urls(ingest.read_records(spark, source, CORPUS_RECORD)).select("link")
    ingest.append_to(stream, target, mark).awaitTermination()
    return spark.read.schema("link string").json(target).select(U.normalize("link").alias("url"))


def document_stream(spark, d, parts: int = 3) -> DataFrame:
    """Documents with three keys each as a stream, in ``parts`` micro-batches by ascending id."""
    source = new_path(spark, "stream-in")
    rows = _keys(spark, d).select("doc_id", F.col("url").alias("url_key"), F.col("title").alias("title_key"), F.col("content").alias("content_key"), F.col("title").substr(1, 3).alias("shard"))
    # Texts are read once, by all tasks; what one task then writes as a file are the keys of a micro-batch.
    keys = new_path(spark, "stream-keys")
    rows.write.parquet(keys)
    rows = spark.read.schema(rows.schema).parquet(keys)
    cuts = rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.01) if parts > 1 else []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = rows if lo is None else rows.where(F.col("doc_id") > lo)
        (part if hi is None else part.where(F.col("doc_id") <= hi)).repartition(1 if parts > 1 else 8).write.mode("append").parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)


def _greedy(keys: str, shard: str = "''") -> str:
    return f"""
WITH RECURSIVE k AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, list_transform(['t' || title, 'c' || content, 'u' || url], lambda x: {shard} || '|' || x) AS keys FROM ({keys})),
g(i, doc_id, ok, marked) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[] UNION ALL
  SELECT k.i, k.doc_id, NOT list_has_any(g.marked, k.keys), CASE WHEN list_has_any(g.marked, k.keys) THEN g.marked ELSE list_concat(g.marked, k.keys) END FROM g JOIN k ON k.i = g.i + 1)
SELECT doc_id FROM g WHERE ok"""


@query(_greedy(_KEYS, "substr(title, 1, 3)"))
def stream_accepted_sharded(spark, d):
    """Greedy over three keys in a stream, within shards, with one state entry a key."""
    from ..streaming import dedup

    ship_package(spark)
    target, mark = new_path(spark, "stream-out"), new_path(spark, "stream-mark")
    rows = dedup.accepted(document_stream(spark, d), "shard", "doc_id", ttl_ms=86_400_000)
    dedup.start(rows, target, mark, "parquet").awaitTermination()
    return spark.read.schema("doc_id long, accepted boolean").parquet(target).where("accepted").select("doc_id")


@query(_greedy(_KEYS))
def stream_accepted(spark, d):
    """Greedy over three keys in a stream, over all shards, with the keys in a table."""
    from ..streaming import dedup

    target, mark, kept = (new_path(spark, n) for n in ("stream-out", "stream-mark", "stream-state"))
    state = dedup.StateTable(spark, kept)
    dedup.accept_into(document_stream(spark, d), target, state, mark, "doc_id").awaitTermination()
    return spark.read.schema("doc_id long").parquet(f"{target}/batch=*")


def file_stream(spark, rows: DataFrame, files: int = 6, at_once: int = 2) -> DataFrame:
    """Rows as a stream of some files, ``at_once`` a micro-batch."""
    source = new_path(spark, "stream-in")
    rows.repartition(files).write.parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(source)


def run_twice(spark, stream: DataFrame, each) -> None:
    """A stream from two checkpoints, so that each of its micro-batches comes twice."""
    for _ in range(2):
        stream.writeStream.foreachBatch(each).option("checkpointLocation", new_path(spark, "stream-mark")).trigger(availableNow=True).start().awaitTermination()


@query("""
WITH l AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL), t AS (SELECT source, max(n) AS top FROM l GROUP BY source)
SELECT d.source, count(*) AS n, count(*) FILTER (n_chars >= 1000) AS n_ok, round(count(*) FILTER (n_chars >= 1000) * 100.0 / count(*), 6)::DOUBLE AS success_rate, coalesce(sum(n_chars), 0)::BIGINT AS total,
  any_value(top) AS top_lang, true AS ids_close, true AS median_close FROM documents d LEFT JOIN t ON t.source IS NOT DISTINCT FROM d.source GROUP BY d.source""")
def incremental_counters(spark, d):
    """Running totals by source over a stream whose micro-batches all come twice; the estimates of distinct ids
    and of the median are held against all rows."""
    from ..streaming.counters import Counters

    rows = read(spark, d, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    counters = Counters(spark, new_path(spark, "counters"), ["source"], F.col("n_chars") >= 1000, F.col("n_chars"), F.col("doc_id"), F.col("lang"), deltas=2)
    run_twice(spark, file_stream(spark, rows), lambda batch, nr: counters.add(batch, nr) and None)
    got = counters.totals(top=1).withColumn("median", F.col("quantiles")[0])
    share = lambda c: F.count_if(c) / F.greatest(F.count("n_chars"), F.lit(1))
    told = rows.withColumnRenamed("source", "s").join(F.broadcast(got.select("source", "median")) if got.count() <= 10_000 else got.select("source", "median"), F.col("s").eqNullSafe(F.col("source")))
    true = told.groupBy("s").agg(F.countDistinct("doc_id").alias("ids"), share(F.col("n_chars") <= F.col("median")).alias("upto"), share(F.col("n_chars") < F.col("median")).alias("below"))
    close = F.col("median").isNull() | ((F.col("upto") >= 0.45) & (F.col("below") <= 0.55))
    return got.join(true, F.col("s").eqNullSafe(F.col("source"))).select(
        "source", "n", "n_ok", F.round("success_rate", 6).alias("success_rate"), "total", F.col("top_items")[0]["count"].alias("top_lang"),
        (F.abs(F.col("n_ids") - F.col("ids")) <= 0.05 * F.col("ids")).alias("ids_close"), close.alias("median_close"),
    )


@query("SELECT doc_id, lang, n_chars::BIGINT AS n_chars FROM documents")
def buffered_append(spark, d):
    """Documents from a stream whose micro-batches all come twice, written in flushes of half of them or more."""
    from ..streaming.counters import BufferedSink

    rows = read(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("n_chars").cast("long").alias("n_chars"))
    with BufferedSink(spark, new_path(spark, "sink"), size=rows.count() // 2) as sink:
        run_twice(spark, file_stream(spark, rows), lambda batch, nr: sink.add(batch, nr) and None)
    assert sink.stats()["entries_buffered"] == 0 and sink.stats()["entries_written"] == rows.count()
    return sink.rows(rows.schema)


@query(f"""{_STATE.replace("WITH n", "WITH RECURSIVE n")}, s AS (SELECT * FROM n WHERE page_id % 50 = 0),
f AS (SELECT row_number() OVER (ORDER BY page_id) AS i, page_id, ['u' || u, 't' || t, 'c' || c] AS keys FROM n WHERE u NOT IN (SELECT u FROM s) AND t NOT IN (SELECT t FROM s) AND c NOT IN (SELECT c FROM s)),
g(i, page_id, ok, marked) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[] UNION ALL
  SELECT f.i, f.page_id, NOT list_has_any(g.marked, f.keys), CASE WHEN list_has_any(g.marked, f.keys) THEN g.marked ELSE list_concat(g.marked, f.keys) END FROM g JOIN f ON f.i = g.i + 1)
SELECT page_id FROM g WHERE ok""")
def append_new(spark, d):
    """Rows that neither the state nor an earlier row knows, appended and counted."""
    rows = state_rows(spark, d).withColumn("ord", F.col("page_id"))
    path = new_path(spark, "new")
    known = D.state_of(rows.where("page_id % 50 = 0"))
    _, done = sinks.append_new(rows.where("page_id % 50 <> 0"), known, path, "url", "title", "content")
    written = sinks.stats(spark, path)
    assert written["entries"] == done["written"] and written["bytes"] > 0
    return spark.read.schema("page_id long").json(path)
