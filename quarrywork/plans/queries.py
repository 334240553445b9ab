"""Queries over the driver tables, one for each operator or small family, and their DuckDB SQL.

Text columns of the tables are invented words, so lexicon queries use a lexicon of words that occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import lexicon as L
from ..functions import classify as C, html as H, json_repair as J, scoring as S, text as X, urls as U
from ..operators import chunking, citations as K, dedup as D, expand as E, report as R, search as V, validate as Y
from ..session import new_path, ship_package
from ..sources import sinks

WORDS = ("the", "of", "and", "que", "der")
MORE = ("en", "la", "in", "die")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_U = r"[\x09-\x0D\x1C-\x20\x85\xA0]"
UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))"


# Vector search ------------------------------------------------------------------------------------

_KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.embedding::DOUBLE[]) AS ip FROM q, embeddings v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ip, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, rank::INT AS rank, round(ip, 6) AS inner_product, 'DB-' || query_id || '-' || rank AS citation_id,
       round(CASE WHEN ip < 0 THEN 0 ELSE 1 / (1 + ip) END, 6) AS similarity_score
FROM r WHERE rank <= 3"""


@query(_KNN)
def knn_top3(spark, d):
    """The three nearest vectors of every row whose id is divisible by 20, with citation ids."""
    flat = V.index(read(spark, d, "embeddings"), "vec_id", "embedding")
    got = V.top_k(flat.where("id % 20 = 0").withColumnRenamed("id", "query_id"), flat, 3, digits=9)
    return got.select(
        "query_id", "id", "rank", F.round("inner_product", 6).alias("inner_product"),
        K.citation_id(F.lit("DB"), F.col("query_id"), F.col("rank")).alias("citation_id"), F.round("similarity_score", 6).alias("similarity_score"),
    )


@query("""
WITH s AS (SELECT vec_id AS sent_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
m AS (SELECT s.sent_id, v.label AS source_id, max(list_cosine_similarity(s.e, v.embedding::DOUBLE[])) AS sim FROM s, embeddings v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY sim DESC, source_id) AS rank FROM m WHERE sim >= 0.3)
SELECT sent_id, source_id, round(sim, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 3""")
def knn_threshold_sources(spark, d):
    flat = V.index(read(spark, d, "embeddings"), "vec_id", "embedding", "label")
    got = V.matching_sources(flat.where("id % 20 = 0").select(F.col("id").alias("sent_id"), "unit"), flat.withColumnRenamed("label", "source_id"), 0.3)
    return got.select("sent_id", "source_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, len(embedding)::INT AS dim FROM embeddings""")
def vector_norms(spark, d):
    e = F.col("embedding").cast("array<double>")
    return read(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(V.dot(e, e)), 6).alias("norm"), F.size("embedding").alias("dim"))


@query("""
SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, count(*) FILTER (WHERE list_max(embedding) = 0 AND list_min(embedding) = 0) AS n_zero,
       count(DISTINCT len(embedding)) AS n_dims FROM embeddings""")
def index_consistency(spark, d):
    zero = (F.array_max("embedding") == 0) & (F.array_min("embedding") == 0)
    return read(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_ids"), F.count_if(zero).alias("n_zero"), F.countDistinct(F.size("embedding")).alias("n_dims"))


def _ivf_sql(lists: str, probes: int) -> str:
    """Seeds by digest, two rounds of means, the nearest lists, the best rows in them."""
    near = lambda i: f"(SELECT id, e, arg_min(list, (d, list)) AS list FROM (SELECT v.id, v.e, c.list, list_dot_product(c.c, c.c) - 2 * list_dot_product(v.e, c.c) AS d FROM v, c{i} c) GROUP BY ALL)"
    rounds = "".join(f"""
c{i + 1} AS (SELECT c.list, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
  SELECT list, list(x ORDER BY i) AS c FROM (SELECT list, i, avg(x) AS x FROM (SELECT list, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {near(i)}) GROUP BY ALL) GROUP BY list) m USING (list)),""" for i in range(2))
    return f"""
WITH v AS (SELECT vec_id AS id, {UNIT} AS e FROM embeddings),
c0 AS (SELECT row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1 AS list, e AS c FROM v QUALIFY row_number() OVER (ORDER BY md5(id::VARCHAR), id) <= {lists}),{rounds}
l AS {near(2)},
p AS (SELECT v.id AS query_id, v.e AS q, c.list FROM v, c2 c WHERE v.id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY list_dot_product(c.c, c.c) - 2 * list_dot_product(v.e, c.c), c.list) <= {probes}),
s AS (SELECT query_id, l.id, list_dot_product(q, l.e) AS ip FROM p JOIN l USING (list)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ip, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, rank::INT AS rank, round(ip, 6) AS inner_product FROM r WHERE rank <= 3"""


@query(_ivf_sql("20", 14))
def ivf_probe(spark, d):
    """Top 3 in the 14 of 20 lists nearest to each query: recall 1.00 on sf0.01, 0.94 on sf0.1."""
    flat = V.index(read(spark, d, "embeddings"), "vec_id", "embedding")
    listed, centres = V.ivf(flat, 20)
    return V.top_k_ivf(flat.where("id % 20 = 0").withColumnRenamed("id", "query_id"), listed, centres, 3, 14, 9).select("query_id", "id", "rank", F.round("inner_product", 6).alias("inner_product"))


@query(_ivf_sql("(SELECT greatest(1, least(100, count(*) // 10)) FROM embeddings)", 60))
def ivf_stored(spark, d):
    """An inverted file, written by list, read again, and searched in the 60 lists nearest to each query
    (the vectors have no clusters to speak of; recall of the top 3: 1.00 on sf0.01, 0.95 on sf0.1)."""
    flat = V.index(read(spark, d, "embeddings"), "vec_id", "embedding")
    path = new_path(spark, "ivf")
    sinks.write_ivf(*V.ivf(flat), path)
    listed, centres = sinks.read_ivf(spark, path)
    return V.top_k_ivf(flat.where("id % 20 = 0").withColumnRenamed("id", "query_id"), listed, centres, 3, 60, 9).select("query_id", "id", "rank", F.round("inner_product", 6).alias("inner_product"))


# URLs -----------------------------------------------------------------------------------------------


@query(r"""
SELECT page_id, split_part(replace(regexp_replace(trim(lower(url)), '/+$', ''), 'www.', ''), '?', 1) AS normalized,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_replace(lower(url), '/+$', '') AS url_key,
       regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*)://', 1) || '://' || regexp_extract(lower(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)
         || regexp_extract(lower(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS plain,
       md5(split_part(replace(regexp_replace(trim(lower(url)), '/+$', ''), 'www.', ''), '?', 1)) AS url_hash FROM pages""")
def url_normalize(spark, d):
    return read(spark, d, "pages").select("page_id", U.normalize("url").alias("normalized"), U.netloc("url").alias("host"), U.key("url").alias("url_key"), U.scheme_host_path("url").alias("plain"), F.md5(U.normalize("url")).alias("url_hash"))


@query(r"""
SELECT page_id, ends_with(regexp_extract(lower(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '.pdf')
         OR contains(regexp_extract(lower(url), '^[^?#]*([?#].*)$', 1), 'pdf') AS is_pdf,
       CASE WHEN d = '' THEN 0.3 WHEN list_bool_or(list_transform(%s, lambda k: contains(d, k))) THEN 1.0
            WHEN list_bool_or(list_transform(%s, lambda k: contains(d, k))) THEN 0.7
            WHEN contains(d, '.edu') OR contains(d, '.gov') OR contains(d, '.org') THEN 0.6 ELSE 0.4 END::DOUBLE AS credibility,
       CASE WHEN d = 'example.com' THEN 8.0 WHEN ends_with(d, '.gov') THEN 9.0 WHEN ends_with(d, '.edu') THEN 8.5 WHEN ends_with(d, '.org') THEN 7.0
            WHEN ends_with(d, '.ac.in') THEN 8.5 WHEN ends_with(d, '.nic.in') THEN 9.0
            WHEN contains(d, 'agri') OR contains(d, 'farm') OR contains(d, 'crop') OR contains(d, 'research') THEN 6.0 ELSE 5.0 END::DOUBLE AS authority
FROM (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS d FROM pages)""" % (sql_list(L.HIGH_CREDIT), sql_list(L.MEDIUM_CREDIT)))
def url_scores(spark, d):
    host = F.lower(U.netloc("url"))
    return read(spark, d, "pages").select("page_id", U.is_pdf("url").alias("is_pdf"), S.credibility(host).alias("credibility"), S.authority(host, {"example.com": 8.0}).alias("authority"))


@query(r"""
WITH v AS (SELECT page_id * 3 AS ord, url FROM pages UNION ALL SELECT page_id * 3 + 1, upper(url) || '/' FROM pages UNION ALL SELECT page_id * 3 + 2, url || '?x=1' FROM pages),
k AS (SELECT *, split_part(replace(regexp_replace(trim(lower(url)), '/+$', ''), 'www.', ''), '?', 1) AS key FROM v)
SELECT ord, url FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS r FROM k) WHERE r = 1""")
def dedup_url_keep_first(spark, d):
    p = read(spark, d, "pages")
    part = lambda i, u: p.select((F.col("page_id") * 3 + i).alias("ord"), u.alias("url"))
    rows = part(0, F.col("url")).unionByName(part(1, F.concat(F.upper("url"), F.lit("/")))).unionByName(part(2, F.concat(F.col("url"), F.lit("?x=1"))))
    return D.keep_first(rows, U.normalize("url"), ["ord"]).select("ord", "url")


@query(r"""
SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages)
QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1""")
def dedup_host(spark, d):
    rows = read(spark, d, "pages").select("page_id", U.netloc("url").alias("host"))
    return D.keep_first(rows, "host", ["page_id"])


_KEYS = "SELECT doc_id, substr(md5(coalesce(text, '')), 1, 2) AS url, source || lang || (doc_id % 7)::VARCHAR AS title, md5(coalesce(text, '')) AS content FROM documents"


@query(f"""
WITH k AS ({_KEYS}), a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY title ORDER BY doc_id) = 1)
SELECT doc_id FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1""")
def dedup_check_mode(spark, d):
    """Title is marked before the next key is tested."""
    return D.checked(_keys(spark, d), ["title", "url"], ["doc_id"]).select("doc_id")


def _keys(spark, d):
    text = F.md5(F.coalesce("text", F.lit("")))
    return read(spark, d, "documents").select("doc_id", F.substring(text, 1, 2).alias("url"), F.concat("source", "lang", F.pmod("doc_id", F.lit(7)).cast("string")).alias("title"), text.alias("content"))


@query(f"""
WITH RECURSIVE k AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, ['t' || title, 'c' || content, 'u' || url] AS keys FROM ({_KEYS})),
g(i, doc_id, ok, marked) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[] UNION ALL
  SELECT k.i, k.doc_id, NOT list_has_any(g.marked, k.keys), CASE WHEN list_has_any(g.marked, k.keys) THEN g.marked ELSE list_concat(g.marked, k.keys) END FROM g JOIN k ON k.i = g.i + 1)
SELECT doc_id FROM g WHERE ok""")
def dedup_accept_mode(spark, d):
    """Greedy over three keys."""
    return D.accepted(_keys(spark, d), ["title", "content", "url"], "doc_id").select("doc_id")


# Text scalars -----------------------------------------------------------------------------------------


@query(r"""
SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g')) AS normalized, length(text)::INT AS n_chars,
       len(list_filter(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x85\p{Z}]+'), lambda w: w <> ''))::BIGINT AS n_words,
       (length(text) // 4)::BIGINT AS n_tokens, md5(trim(regexp_replace(lower(text), '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g'))) AS content_hash FROM documents""")
def text_norm(spark, d):
    n = X.normalize("text")
    return read(spark, d, "documents").select("doc_id", n.alias("normalized"), F.length("text").alias("n_chars"), X.word_count("text").alias("n_words"), X.token_estimate("text").alias("n_tokens"), F.md5(n).alias("content_hash"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g'), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\x0B\x85\p{Z}.,\-()\[\]:;]', '', 'g')) AS cleaned FROM documents""")
def text_clean(spark, d):
    return read(spark, d, "documents").select("doc_id", X.clean("text").alias("cleaned"))


@query(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g')) AS t FROM documents),
h AS (SELECT *, substr(t, 1, 500) AS head FROM t),
p AS (SELECT *, 501 - strpos(reverse(head), '.') AS stop, 501 - strpos(reverse(head), ' ') AS space, strpos(head, '.') > 0 AS has_stop FROM h)
SELECT doc_id, CASE WHEN length(t) <= 500 THEN t WHEN has_stop AND stop - 1 > 350 THEN substr(head, 1, stop::INT)
       ELSE CASE WHEN strpos(head, ' ') > 0 THEN substr(head, 1, (space - 1)::INT) ELSE head END || '...' END AS abstract FROM p""")
def abstract_prefix(spark, d):
    return read(spark, d, "documents").select("doc_id", X.abstract("text").alias("abstract"))


@query(r"""
SELECT doc_id, len(s)::BIGINT AS n_sentences, s[1] AS first_sentence FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+[\s\x0B\x1C-\x1F\x85\p{Z}]+'), lambda x: trim(x)),
         lambda x: len(list_filter(regexp_split_to_array(x, '[\s\x0B\x1C-\x1F\x85\p{Z}]+'), lambda w: w <> '')) >= 3) AS s FROM documents)""")
def sentences_a(spark, d):
    s = X.sentences("text")
    return read(spark, d, "documents").withColumn("s", s).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.try_element_at("s", F.lit(1)).alias("first_sentence"))


_S = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
_ENDED = rf"list_filter(string_split(regexp_replace(text, '([.!?]){_S}', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"


@query(f"SELECT doc_id, len({_ENDED}) AS n, (len({_ENDED}) - 1)::INT AS last FROM documents WHERE len({_ENDED}) > 0")
def sentences_b(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(X.sentences_with_ends("text")).alias("pos", "sentence"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))


_Q = "lower(text)"


@query(f"""
SELECT item_id, array_to_string(list_slice(list_filter(regexp_split_to_array({_Q}, '\\s+'), lambda w: w <> '' AND NOT list_contains({sql_list(L.STOP_WORDS)}, w)), 1, 4), ' ') AS simple FROM benchmark""")
def query_simplify(spark, d):
    return read(spark, d, "benchmark").select("item_id", X.simplify_query("text", L.STOP_WORDS).alias("simple"))


# Lexicons and scores --------------------------------------------------------------------------------


@query(f"""
SELECT doc_id, array_to_string(list_filter({sql_list(sorted(WORDS))}, lambda k: contains(lower(text), k)), ',') AS found,
       {" + ".join(f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)})" for w in WORDS)} AS n_occurrences FROM documents""")
def lexicon_tags(spark, d):
    low = F.lower("text")
    n = sum((X.occurrences(low, w) for w in WORDS), F.lit(0))
    return read(spark, d, "documents").select("doc_id", F.array_join(X.matches("text", WORDS), ",").alias("found"), n.cast("long").alias("n_occurrences"))


_COUNT = lambda w: f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)})"


@query(f"""
SELECT doc_id, round(least(({" + ".join(_COUNT(w) for w in WORDS)}) * 0.1 + ({" + ".join(_COUNT(w) for w in MORE)}) * 0.05, 1.0), 6)::DOUBLE AS occurrence,
       round(least({" + ".join(f"least({_COUNT(w)} * 0.1, 0.2)" for w in WORDS)}, 1.0), 6)::DOUBLE AS saturating,
       round(least(({" + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS[:2])}) * 0.3 + ({" + ".join(f"contains(lower(text), '{w}')::INT" for w in MORE)}) * 0.1, 1.0), 6)::DOUBLE AS presence,
       round(({" + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS)}) / {float(len(WORDS))}::DOUBLE, 6) AS coverage FROM documents""")
def relevance_scores(spark, d):
    return read(spark, d, "documents").select(
        "doc_id", F.round(S.occurrence("text", WORDS, MORE), 6).alias("occurrence"), F.round(S.saturating("text", WORDS), 6).alias("saturating"),
        F.round(S.presence("text", WORDS[:2], MORE), 6).alias("presence"), F.round(S.coverage("text", WORDS), 6).alias("coverage"),
    )


_NOT_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"
_TERM = lambda ws: f"len(list_filter(regexp_split_to_array(lower(t), '{_NOT_WORD}'), lambda w: list_contains({sql_list(ws)}, w)))"


@query(f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_S}'), lambda w: w <> ''))::DOUBLE AS n FROM documents),
s AS (SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE least({_TERM(WORDS)} / n * 0.5 + {_TERM(WORDS[:2])} / n * 0.3 + {_TERM(MORE)} / n * 0.2, 1.0) END AS s FROM t)
SELECT doc_id, round(s, 9)::DOUBLE AS density, s >= 0.3 AS relevant FROM s""")
def relevance_density(spark, d):
    n = S.density("text", agri=WORDS, farm=WORDS[:2], region=MORE)
    return read(spark, d, "documents").select("doc_id", F.round(n, 9).alias("density"), (n >= 0.3).alias("relevant"))


@query("""
SELECT doc_id, round(least(CASE WHEN n_chars > 5000 THEN 0.2 WHEN n_chars > 2000 THEN 0.15 WHEN n_chars > 500 THEN 0.1 WHEN n_chars > 100 THEN 0.05 ELSE 0 END
         + least((doc_id % 11) / 10.0 * 0.3, 0.3) + least((doc_id % 7) / 6.0 * 0.2, 0.2) + least((doc_id % 5) / 4.0 * 0.2, 0.2)
         + CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0 END, 1.0), 6)::DOUBLE AS quality,
       round(least(CASE WHEN n_chars > 1000 THEN 0.3 WHEN n_chars > 500 THEN 0.2 WHEN n_chars > 100 THEN 0.1 ELSE 0 END
         + CASE WHEN lang IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN n_chars > 50 THEN 0.1 ELSE 0 END, 1.0), 6)::DOUBLE AS completeness FROM documents""")
def quality_composite(spark, d):
    part = lambda k: F.pmod("doc_id", F.lit(k)) / F.lit(float(k - 1))
    q = S.content_quality("n_chars", part(11), part(7), part(5), F.pmod("doc_id", F.lit(2)) == 0)
    return read(spark, d, "documents").select("doc_id", F.round(q, 6).alias("quality"), F.round(S.completeness("n_chars", F.col("lang").isNotNull(), F.col("n_chars") > 50), 6).alias("completeness"))


def _case_sql(subject: str, branches, otherwise: str) -> str:
    when = " ".join(f"WHEN {' OR '.join(f'''contains({subject}, '{t}')''' for t in terms)} THEN '{name}'" for terms, name in branches)
    return f"CASE {when} ELSE '{otherwise}' END"


@query(f"SELECT page_id, {_case_sql('lower(url)', C.GENRE, 'article')} AS genre, {_case_sql('lower(html)', C.STRATEGY, 'general_exploration')} AS strategy FROM pages")
def genre_case(spark, d):
    return read(spark, d, "pages").select("page_id", C.genre("url").alias("genre"), C.strategy("html").alias("strategy"))


@query("""
SELECT page_id, CASE WHEN contains(u, 'gov.in') OR contains(u, 'nic.in') THEN 'government_content' WHEN contains(u, 'edu') OR contains(u, 'ac.in') OR contains(u, 'university') THEN 'academic_content'
  WHEN contains(h, 'news') OR contains(h, 'article') THEN 'news_article' ELSE 'web_content' END AS category FROM (SELECT page_id, lower(url) AS u, lower(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))) AS h FROM pages)""")
def category_case(spark, d):
    return read(spark, d, "pages").select("page_id", C.category("url", H.title("html"), F.lit(False)).alias("category"))


_RULES = {"a": ("the", "of"), "b": ("que",), "c": ("der", "und")}


@query(f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(['{"', '".join(_RULES)}', lang], lambda t: t = lang OR
  {" OR ".join(f"(t = '{t}' AND ({' OR '.join(f'''contains(lower(text), '{k}')''' for k in ks)}))" for t, ks in _RULES.items())}))), ',') AS tags FROM documents""")
def rule_tags(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(C.tags("text", (F.col("lang"),), _RULES), ",").alias("tags"))


@query("""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), 'th[a-z]')) AS term, generate_subscripts(regexp_extract_all(lower(text), 'th[a-z]'), 1) - 1 AS pos FROM documents),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM m GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::INT AS rank, term, n FROM c QUALIFY rank <= 20""")
def key_terms_top(spark, d):
    return R.key_terms(read(spark, d, "documents"), "doc_id", "text", "th[a-z]")


# Chunks, validation, JSON -----------------------------------------------------------------------------

_CHUNK = r"""
WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x85\p{Z}]+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT *, len(w) AS n FROM t WHERE len(w) > 0),
c AS (SELECT *, unnest(CASE WHEN n <= 256 THEN [0] ELSE range(0, n, 231) END) AS s FROM n)
SELECT doc_id, (s // 231)::INT AS chunk_id, CASE WHEN n <= 256 THEN 0 ELSE floor(s::DOUBLE / n * length(text)) END::INT AS chunk_start,
       CASE WHEN n <= 256 THEN length(text) ELSE floor(least(s + 256, n)::DOUBLE / n * length(text)) END::INT AS chunk_end,
       md5(CASE WHEN n <= 256 THEN text ELSE array_to_string(list_slice(w, s + 1, s + 256), ' ') END) AS chunk_hash FROM c"""


@query(_CHUNK)
def chunk_256_25(spark, d):
    return chunking.chunk(read(spark, d, "documents"), "text").select("doc_id", "chunk_id", "chunk_start", "chunk_end", F.md5("chunk_text").alias("chunk_hash"))


def records(spark, d) -> DataFrame:
    """Documents in the record schema, some of them damaged by id."""
    bad = lambda k: F.pmod("doc_id", F.lit(k)) == 0
    empty = F.array().cast("array<string>")
    return read(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.when(bad(5), "ftp").otherwise("https"), F.lit("://example.com/"), F.col("doc_id").cast("string")).alias("link"),
        F.col("text").alias("text_extracted"), X.abstract("text").alias("abstract"), F.when(bad(7), "poem").otherwise("article").alias("genre"), F.array("lang").alias("tags"),
        *[empty.alias(c) for c in ("indian_regions", "crop_types", "farming_methods", "soil_types", "climate_info", "fertilizers", "plant_species")],
        F.lit("mixed").alias("data_type"), F.when(bad(11), F.lit(None)).otherwise(F.col("source")).alias("source_domain"), F.lit("2024-01-01T00:00:00").alias("extraction_timestamp"),
        (F.pmod("doc_id", F.lit(13)) / 10.0).alias("relevance_score"), F.col("n_chars").alias("content_length"), F.md5("text").alias("content_hash"), F.md5("source").alias("url_hash"), F.lit(False).alias("is_pdf"),
    )


_ERRORS = """
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE (doc_id % 7 = 0)::INT + (doc_id % 5 = 0)::INT + (doc_id % 13 > 10)::INT + (n_chars < 50)::INT END AS n_errors FROM documents"""


@query(_ERRORS)
def validate_rows(spark, d):
    return Y.validated(records(spark, d)).select("doc_id", F.size("errors").alias("n_errors"))


@query(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE n_errors = 0) AS valid, count(*) FILTER (WHERE n_errors > 0) AS invalid,
       coalesce((count(*) FILTER (WHERE n_errors = 0))::DOUBLE / count(*), 0) AS rate FROM ({_ERRORS})""")
def validation_summary(spark, d):
    return Y.summary(Y.validated(records(spark, d)))


@query("""
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_id % 6 <> 5 AS repaired FROM events""")
def json_repair(spark, d):
    """Objects damaged in five ways; a sixth of them keep only a key and a number."""
    p, way = F.col("props"), F.pmod("event_id", F.lit(6))
    damaged = (
        F.when(way == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(way == 2, F.replace(p, F.lit('"'), F.lit("'"))).when(way == 3, F.replace(p, F.lit("}"), F.lit(",}")))
        .when(way == 4, F.concat(F.lit("Here it is: "), p, F.lit(" as asked"))).when(way == 5, F.replace(p, F.lit("}"), F.lit(""))).otherwise(p)
    )
    fixed = J.repaired(damaged, ["k"])
    k = F.coalesce(F.get_json_object(fixed, "$.k").cast("double"), J.number(damaged, "k"))
    return read(spark, d, "events").select("event_id", k.cast("long").alias("k"), fixed.isNotNull().alias("repaired"))


# Queries and agents -------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT item_id, list_filter([text, text || ' agriculture', text || ' farming', CASE WHEN contains(t, 'disease') OR contains(t, 'pest') OR contains(t, 'infection') THEN text || ' plant pathology treatment'
  WHEN contains(t, 'price') OR contains(t, 'cost') OR contains(t, 'market') OR contains(t, 'economic') THEN text || ' agricultural economics market analysis'
  WHEN contains(t, 'climate') OR contains(t, 'weather') OR contains(t, 'rain') THEN text || ' climate agriculture impact' END], lambda x: x IS NOT NULL) AS v FROM (SELECT *, lower(text) AS t FROM benchmark))
SELECT item_id, unnest(v) AS variant, (generate_subscripts(v, 1) - 1)::INT AS pos FROM v""")
def query_fanout(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.posexplode(E.expanded("text")).alias("pos", "variant"))


@query("""
SELECT item_id, least((row_number() OVER (ORDER BY item_id) - 1) // greatest(1, (SELECT count(*) FROM benchmark) // 6), 5)::BIGINT AS block,
       ((row_number() OVER (ORDER BY item_id) - 1) % 4)::BIGINT AS turn FROM benchmark""")
def query_block_partition(spark, d):
    """Contiguous blocks and round robin over the questions of one job (a bounded list)."""
    from pyspark.sql import Window as W

    b = read(spark, d, "benchmark")
    rows = b.withColumn("i", F.row_number().over(W.orderBy("item_id")) - 1)
    return rows.select("item_id", E.block_of(F.col("i"), b.count(), 6).alias("block"), E.round_robin(F.col("i"), 4).alias("turn"))


_AGENTS = (("first", "the, of", "and"), ("second", "que, la", "der, en"), ("third", "die", "in"))


@query("""
WITH s AS (SELECT item_id, 2 * (contains(t, 'the')::INT + contains(t, 'of')::INT) + contains(t, 'and')::INT AS a,
  2 * (contains(t, 'que')::INT + contains(t, 'la')::INT) + contains(t, 'der')::INT + contains(t, 'en')::INT AS b, 2 * contains(t, 'die')::INT + contains(t, 'in')::INT AS c
  FROM (SELECT item_id, lower(text) AS t FROM benchmark))
SELECT item_id, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS agent FROM s""")
def agent_argmax(spark, d):
    return read(spark, d, "benchmark").select("item_id", E.best_agent("text", _AGENTS).alias("agent"))


@query("""
WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY item_id) AS i, item_id, [2 * (contains(t, 'the')::INT + contains(t, 'of')::INT) + contains(t, 'and')::INT,
  2 * (contains(t, 'que')::INT + contains(t, 'la')::INT) + contains(t, 'der')::INT + contains(t, 'en')::INT, 2 * contains(t, 'die')::INT + contains(t, 'in')::INT] AS s FROM (SELECT item_id, lower(text) AS t FROM benchmark)),
c AS (SELECT i, item_id, list_filter([1, 2, 3], lambda j: list_max(s) = 0 OR s[j] = list_max(s)) AS c FROM s),
g(i, item_id, pick, load) AS (SELECT 0::BIGINT, NULL::BIGINT, 0, [0, 0, 0] UNION ALL
  SELECT i, item_id, pick, list_transform([1, 2, 3], lambda j: load[j] + (j = pick)::INT) FROM (
    SELECT c.i, c.item_id, g.load, list_sort(list_transform(c.c, lambda j: {'l': g.load[j], 'j': j}))[1].j AS pick FROM g JOIN c ON c.i = g.i + 1))
SELECT item_id, ['first', 'second', 'third'][pick] AS agent FROM g WHERE i > 0""")
def greedy_query_assignment(spark, d):
    ship_package(spark)
    return E.assigned(read(spark, d, "benchmark").select("item_id", "text"), "item_id", "text", rows=_AGENTS).select("item_id", "agent")


_DIGEST = lambda k, n: f"(('0x' || substr(md5(id || ':1:{k}'), 1, 8))::BIGINT % {n} + 1)::INT"


@query(f"""
WITH r AS (SELECT id, {sql_list(L.METHODS)}[{_DIGEST(1, len(L.METHODS))}] || ' ' || {sql_list(L.CROPS)}[{_DIGEST(2, len(L.CROPS))}] || ' ' || {sql_list(L.STATES)}[{_DIGEST(3, len(L.STATES))}] AS query FROM range(0, 200) t(id))
SELECT min(id) AS id, query FROM r GROUP BY query ORDER BY 1 LIMIT 50""")
def template_queries(spark, d):
    return E.generated(spark, 50, L.CROPS, L.STATES, L.METHODS)


# Citations ----------------------------------------------------------------------------------------------

_ANSWER = "SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, text || ' [DB-' || turn || '-1] [WEB-' || (turn % 3) || '-' || (conv_id % 4) || ']' AS text FROM conversations"


def answers(spark, d) -> DataFrame:
    c = read(spark, d, "conversations")
    mark = F.format_string(" [DB-%d-1] [WEB-%d-%d]", "turn", F.pmod("turn", F.lit(3)), F.pmod("conv_id", F.lit(4)))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", F.concat("text", mark).alias("text"))


def known(spark, d) -> DataFrame:
    a = answers(spark, d)
    ids = F.array(F.format_string("DB-%d-1", "turn"), F.lit("WEB-1-1"), F.lit("WEB-0-2"))
    return a.select("answer_id", F.explode(ids).alias("citation_id"))


@query(rf"""
WITH a AS ({_ANSWER}), i AS (SELECT answer_id, turn, regexp_extract_all(text, '\[((?:DB|WEB)-\d+-\d+)\]', 1) AS ids FROM a),
k AS (SELECT *, ['DB-' || turn || '-1', 'WEB-1-1', 'WEB-0-2'] AS known FROM i)
SELECT answer_id, array_to_string(list_filter(ids, lambda x: list_contains(known, x)), ',') AS valid,
       array_to_string(list_filter(ids, lambda x: NOT list_contains(known, x)), ',') AS invalid, len(ids)::BIGINT AS n_citations FROM k""")
def citations_used(spark, d):
    got = K.validate(answers(spark, d), known(spark, d))
    return got.select("answer_id", F.array_join("valid", ",").alias("valid"), F.array_join("invalid", ",").alias("invalid"), "n_citations")


_ANY = lambda ps: "(" + " OR ".join(f"regexp_matches(x, '(?i){p}')" for p in ps) + ")"
_N = f"len(list_filter(regexp_split_to_array(x, '{_S}'), lambda w: w <> ''))"


@query(rf"""
WITH a AS ({_ANSWER}), f AS (SELECT answer_id, len(regexp_extract_all(text, '{K.PATTERN}')) AS n, list_filter({_ENDED}, lambda x: NOT {_ANY(K.OTHER)} AND (({_N} > 8 AND {_ANY(K.FACTUAL)}) OR {_N} > 15)) AS facts FROM a),
u AS (SELECT *, list_filter(facts, lambda x: NOT regexp_matches(x, '{K.PATTERN}')) AS u FROM f),
c AS (SELECT *, CASE WHEN len(facts) = 0 THEN 1.0 ELSE (len(facts) - len(u)) / len(facts)::DOUBLE END::DOUBLE AS c FROM u)
SELECT answer_id, least(len(u), 5)::INT AS n_uncited, round(c, 6) AS coverage, CASE WHEN n = 0 THEN 'regenerate' WHEN c > 0.8 THEN 'strip' WHEN c > 0.5 THEN 'annotate' ELSE 'regenerate' END AS action FROM c""")
def citation_coverage(spark, d):
    got = K.validate(answers(spark, d), known(spark, d))
    return got.select("answer_id", F.size("uncited").alias("n_uncited"), F.round("coverage", 6).alias("coverage"), K.policy("coverage", "n_citations").alias("action"))


_USES = rf"WITH a AS ({_ANSWER}), u AS (SELECT unnest(regexp_extract_all(text, '\[((?:DB|WEB)-\d+-\d+)\]', 1)) AS citation_id FROM a), n AS (SELECT citation_id, count(*) AS uses FROM u GROUP BY 1)"


@query(f"{_USES} SELECT citation_id, uses, uses > 5 AS excessive FROM n")
def citation_stats(spark, d):
    return K.usage(answers(spark, d)).withColumn("excessive", F.col("uses") > 5)


@query(f"""
{_USES}, s AS (SELECT 'WEB-' || (page_id % 3) || '-' || (page_id % 4) AS citation_id, min(url) AS url FROM pages GROUP BY 1)
SELECT s.citation_id, coalesce(uses, 0)::BIGINT AS uses, '[' || s.citation_id || '] ' || upper(s.citation_id) || ' - ' || url || ' (cited ' || coalesce(uses, 0) || ' times)' AS line
FROM s LEFT JOIN n ON s.citation_id = n.citation_id""")
def bibliography(spark, d):
    ids = F.format_string("WEB-%d-%d", F.pmod("page_id", F.lit(3)), F.pmod("page_id", F.lit(4)))
    sources = read(spark, d, "pages").groupBy(ids.alias("citation_id")).agg(F.min("url").alias("url")).withColumn("title", F.upper("citation_id"))
    return K.bibliography(sources, K.usage(answers(spark, d)), used_only=False)


@query(f"{_USES}, s AS (SELECT DISTINCT 'WEB-' || (page_id % 5) || '-' || (page_id % 7) AS citation_id FROM pages) SELECT citation_id FROM s WHERE citation_id NOT IN (SELECT citation_id FROM n)")
def citations_uncited(spark, d):
    ids = F.format_string("WEB-%d-%d", F.pmod("page_id", F.lit(5)), F.pmod("page_id", F.lit(7)))
    return read(spark, d, "pages").select(ids.alias("citation_id")).distinct().join(K.usage(answers(spark, d)), "citation_id", "left_anti")


@query(rf"""
WITH a AS ({_ANSWER}), k AS (SELECT *, list_filter(regexp_extract_all(text, '\[((?:DB|WEB)-\d+-\d+)\]', 1), lambda x: x <> 'DB-' || turn || '-1') AS bad FROM a)
SELECT answer_id, list_reduce(list_prepend(text, bad), lambda t, i: replace(t, '[' || i || ']', '')) AS cleaned FROM k""")
def citations_removed(spark, d):
    a = answers(spark, d)
    bad = F.filter(K.extract("text"), lambda i: i != F.format_string("DB-%d-1", "turn"))
    return a.select("answer_id", K.remove("text", bad).alias("cleaned"))


# Aggregates and windows -----------------------------------------------------------------------------------


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_distinct, sum(n_chars)::BIGINT AS total_length, round(sum(n_chars)::DOUBLE / count(n_chars), 6) AS mean_length FROM documents")
def corpus_stats(spark, d):
    return R.corpus_stats(read(spark, d, "documents"), "doc_id", "n_chars")


@query("""
SELECT facet, value, count(*) AS n FROM (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents
  UNION ALL SELECT 'quality', quality::VARCHAR FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL""")
def facet_histograms(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "lang", "source").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.facets(rows, ["lang", "source", "quality"])


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS n_success, count(*) FILTER (WHERE event_type = 'error') AS n_failure,
       round(coalesce(sum(CASE WHEN event_type <> 'error' THEN value::DECIMAL(38, 10) END)::DOUBLE, 0), 4) AS value_success FROM events GROUP BY user_id""")
def agent_summary(spark, d):
    return R.success_summary(read(spark, d, "events"), F.col("event_type") != "error", "value", "user_id")


@query("""
SELECT event_id, user_id, round((sum(value::DECIMAL(20, 10)) OVER w)::DOUBLE / count(value) OVER w, 6) AS last_mean FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def last10_avg_by_user(spark, d):
    got = R.last_n_mean(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return got.select("event_id", "user_id", "last_mean")


@query("""
WITH r AS (SELECT event_id, (sum((event_type <> 'error')::INT) OVER w)::DOUBLE / count(*) OVER w AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, round(rate, 6) AS rate, CASE WHEN round(rate, 6) > 0.8 THEN 0.1 WHEN round(rate, 6) > 0.5 THEN 0.2 ELSE 0.4 END::DOUBLE AS delay FROM r""")
def running_success_rate(spark, d):
    return R.running_rate(read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "rate", "delay")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def last50_by_user(spark, d):
    return R.last_rows(read(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT - epoch(date_trunc('second', ts))::BIGINT < 86400")
def ttl_cache_lookup(spark, d):
    return R.fresh(read(spark, d, "events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp"), 86_400).select("event_id")


@query("SELECT p_partkey, round(p_size * 0.5 + p_retailprice * 0.3, 4) AS score FROM part ORDER BY p_size * 0.5 + p_retailprice * 0.3 DESC, p_partkey LIMIT 20")
def weighted_top_k(spark, d):
    score = F.col("p_size") * 0.5 + F.col("p_retailprice") * 0.3
    return R.top_n(read(spark, d, "part").withColumn("s", score), 20, F.desc("s"), F.col("p_partkey")).select("p_partkey", F.round("s", 4).alias("score"))


@query("""
SELECT conv_id, string_agg('[' || r || '] ' || role, chr(10) ORDER BY r) AS lines FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id""")
def report_lines(spark, d):
    return K.numbered(read(spark, d, "conversations"), "conv_id", "turn", F.col("role"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity::DECIMAL(20, 4))::DOUBLE, 2) AS sum_qty FROM lineitem GROUP BY ALL""")
def lineitem_summary(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity").cast("decimal(20,4)")).cast("double"), 2).alias("sum_qty"))


# HTML -----------------------------------------------------------------------------------------------------


@query(r"""
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(html) < 500 OR
  list_sum(list_transform(%s, lambda k: contains(lower(html), k)::INT)) >= 2 AS bot_check FROM pages""" % sql_list(L.BOT_MARKS))
def html_title(spark, d):
    return read(spark, d, "pages").select("page_id", H.title("html").alias("title"), C.is_bot_check("html").alias("bot_check"))


@query()
def html_main_text(spark, d):
    ship_package(spark)
    return read(spark, d, "pages").select("page_id", H.main_text("html").alias("text"), H.strip_tags("html").alias("plain"))


# Compositions -----------------------------------------------------------------------------------------------


_HISTOGRAM = lambda t: f"list_transform(range(64), lambda i: len(list_filter({t}, lambda p: p = i))::DOUBLE)"
_AT = lambda t: f"list_transform(list_filter(regexp_split_to_array(lower({t}), '{_NOT_WORD}'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 4))::BIGINT % 64)"
_RAG = f"""
WITH b AS (SELECT item_id, text, NOT (contains(lower(text), 'agriculture') OR contains(lower(text), 'farming')) AS plain FROM benchmark),
v AS (SELECT item_id, unnest([0, 1]) AS sub, unnest(CASE WHEN plain THEN [text, text || ' agriculture'] ELSE [text, text || ' best practices'] END) AS q FROM b),
qa AS (SELECT item_id, sub, {_AT('q')} AS pos FROM v), q AS (SELECT item_id, sub, {_HISTOGRAM('pos')} AS e FROM qa),
t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_S}'), lambda w: w <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM t WHERE len(w) > 0),
s AS (SELECT *, unnest(CASE WHEN n <= 256 THEN [0] ELSE range(0, n, 231) END) AS s FROM n),
c AS (SELECT doc_id || '-' || (s // 231) AS id, CASE WHEN n <= 256 THEN text ELSE array_to_string(list_slice(w, s + 1, s + 256), ' ') END AS chunk FROM s),
ca AS (SELECT id, chunk, {_AT('chunk')} AS pos FROM c WHERE length(trim(chunk, ' ')) >= 50), ce AS (SELECT id, chunk, {_HISTOGRAM('pos')} AS e FROM ca),
p AS (SELECT item_id, sub, id, chunk, coalesce(list_inner_product(q.e, ce.e) / nullif(sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(ce.e, ce.e)), 0), 0) AS ip FROM q, ce),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, sub ORDER BY round(ip, 9) DESC, id) AS rank FROM p QUALIFY rank <= 3),
a AS (SELECT *, trim(regexp_replace(chunk, '{_S}', ' ', 'g')) AS t FROM k), h AS (SELECT *, substr(t, 1, 200) AS head FROM a),
x AS (SELECT *, 201 - strpos(reverse(head), '.') AS stop, 201 - strpos(reverse(head), ' ') AS space FROM h),
l AS (SELECT item_id, sub, rank, '[DB-' || (sub + 1) || '-' || rank || '] ' || CASE WHEN length(t) <= 200 THEN t WHEN strpos(head, '.') > 0 AND stop - 1 > 140 THEN substr(head, 1, stop::INT)
  ELSE CASE WHEN strpos(head, ' ') > 0 THEN substr(head, 1, (space - 1)::INT) ELSE head END || '...' END AS line FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sub, rank) AS nr FROM l)
SELECT item_id, string_agg('[' || nr || '] ' || line, chr(10) ORDER BY nr) AS report FROM o GROUP BY item_id"""


@query(_RAG)
def rag_pipeline(spark, d):
    """Questions -> variants -> nearest chunks of the corpus -> cited report, one row a question."""
    from .pipelines import cited_reports

    ship_package(spark)
    return cited_reports(read(spark, d, "benchmark"), read(spark, d, "documents"))


from . import record_queries  # noqa: E402,F401  (adds its queries)
