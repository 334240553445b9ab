"""The queries ``opN_<name>`` over whole tables, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from . import alignment, chosen_path, exact_dedup, lattice, license_scan, lm_score, merkle, mixing, packing, suffix_dedup, token_output, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(spark, _table(spark, sf_dir, "documents"), tokenizer_path())


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.annotate(_table(spark, sf_dir, "documents"))


def op4_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.annotate(_table(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars")
    whole = lambda text: merkle.leaf(*map(F.col, fields), text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, whole(lower)).alias("changed")
    out = merkle.manifest(docs, whole(F.col("text")), carry=[changed])
    found = merkle.folded(F.col("path"), F.coalesce("changed", "leaf"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_lm_score": op2_lm_score,
    "op3_token_files": op3_token_files,
    "op4_lattice_dedup": op4_lattice_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_pack": op7_pack,
    "op8_near_dedup": op8_near_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_cross_alignment": op13_cross_alignment,
}

def _license_sql() -> str:
    """The same canonical form in DuckDB's SQL, with the catalogue as a VALUES list."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        x = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        x = f"regexp_replace({x}, {quote(license_scan.COPYRIGHT_LINE)}, '\\1', 'g')"
        for old, new in license_scan.SPELLINGS:
            x = f"replace({x}, {quote(old)}, {quote(new)})"
        return f"trim(regexp_replace({x}, '[^0-9a-z]+', ' ', 'g'))"

    values = ", ".join(f"({quote(name)}, {quote(text)}, true)" for name, text in license_scan.KNOWN)
    values += "".join(f", ({quote(name)}, {quote(text)}, false)" for name, text in license_scan.PARTS)
    return f"""
WITH given(license, text, whole) AS (VALUES {values}),
known AS (SELECT sha256({canonical("text")}) AS digest, min(license) AS license, min(license) FILTER (WHERE whole) AS entire FROM given GROUP BY 1),
d AS (SELECT row_number() OVER () AS nr, doc_id, text, sha256({canonical("text")}) AS digest FROM documents),
lines AS (
  SELECT nr, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
paragraphs AS (
  SELECT nr, unnest(regexp_split_to_array(text, {quote(license_scan.BLANK_LINE)})) AS line FROM d WHERE regexp_matches(coalesce(text, ''), {quote(license_scan.BLANK_LINE)})),
parts AS (
  SELECT nr, line, false AS several FROM lines WHERE regexp_matches(line, {quote(license_scan.LINE_MARK)})
  UNION ALL SELECT nr, line, true FROM paragraphs WHERE regexp_matches(line, {quote(license_scan.PARAGRAPH_MARK)})),
named AS (
  SELECT nr, CASE WHEN several THEN coalesce(k.entire, k.license) ELSE k.entire END AS license FROM parts JOIN known k ON sha256({canonical("line")}) = k.digest),
found AS (SELECT nr, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM named WHERE license IS NOT NULL GROUP BY nr)
SELECT doc_id, d.digest, k.entire AS license, coalesce(notices, '') AS notices
FROM d LEFT JOIN known k ON d.digest = k.digest LEFT JOIN found ON found.nr = d.nr
"""


def _merkle_sql(most: int = 7) -> str:
    """The tree level by level: ``most`` levels of eight hold two million rows a language."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    sides = """coalesce(string_agg(h, '' ORDER BY p) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '' ORDER BY p) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"""
    levels = ""
    for name, start, steps in (("a", "a0 AS (SELECT g, p, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d)", most), ("b", "b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS p, h, count(*) OVER () AS n FROM subroots)", 3)):
        levels += start + ",\n"
        for k in range(steps):
            levels += f"""{name}s{k} AS (SELECT g, p, {sides} FROM {name}{k} WHERE n > 1 WINDOW run AS (PARTITION BY g, p // 8 ORDER BY p)),
{name}{k + 1} AS (SELECT g, p, h, count(*) OVER (PARTITION BY g) AS n FROM (
  SELECT g, p // 8 AS p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, p // 8)),
"""
        if name == "a":
            levels += f"subroots AS (SELECT g, h FROM a{steps}),\nplaces AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS q FROM subroots),\n"
    steps = [("a", k, f"d.p // {8**k}", "d.g") for k in range(most)] + [("b", k, f"places.q // {8**k}", "''") for k in range(3)]
    joins = "".join(f"\nLEFT JOIN {t}s{k} ON {t}s{k}.g = {g} AND {t}s{k}.p = {p}" for t, k, p, g in steps)
    proof = " || ".join(f"coalesce({t}s{k}.l || {t}s{k}.r, '')" for t, k, _, _ in steps)
    fold = "coalesce(changed, leaf)"
    folds, last = "", "f0"
    for nr, (t, k, _, _) in enumerate(steps):
        folds += f"f{nr + 1} AS (SELECT * REPLACE (CASE WHEN {t}{k}l IS NULL THEN node ELSE sha256({t}{k}l || node || {t}{k}r) END AS node) FROM f{nr}),\n"
        last = f"f{nr + 1}"
    kept = ", ".join(f"{t}s{k}.l AS {t}{k}l, {t}s{k}.r AS {t}{k}r" for t, k, _, _ in steps)
    return f"""
WITH RECURSIVE poly(i, c) AS (
  SELECT i, i::BIGINT FROM range(256) t(i)),
crctable AS (
  SELECT i, list_reduce([c, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM poly),
crcs AS (SELECT list(c ORDER BY i) AS t FROM crctable),
d AS (
  SELECT coalesce('=' || lang, '') AS g, doc_id, {leaf("text")} AS leaf,
         CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
                   lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) % 3 = 0
              THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS p
  FROM documents, crcs),
{levels}f0 AS (
  SELECT d.doc_id, d.leaf, subroots.h AS subroot, b3.h AS root, sha256({proof}) AS proof_sha256, {fold} AS node, {kept}
  FROM d JOIN subroots ON subroots.g = d.g JOIN places ON places.g = d.g CROSS JOIN b3{joins}),
{folds}done AS (SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM {last})
SELECT * FROM done
"""


ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op6_license_scan": _license_sql(),
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, source_size * 2.0::DOUBLE / w AS ratio FROM s),
k AS (
  SELECT *,
         coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held,
         sum(w) OVER (ORDER BY ratio DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS free,
         sum(source_size) OVER ()::BIGINT AS total
  FROM r),
level AS (
  SELECT arg_min((1.5::DOUBLE * total - 2.0::DOUBLE * held) / free, ratio)
         FILTER (WHERE (1.5::DOUBLE * total - 2.0::DOUBLE * held) / free <= ratio) AS v
  FROM k),
t AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, w * coalesce(v, 0::DOUBLE)) AS target,
         (('0x' || substr(md5('17:' || coalesce(source, '<null>')), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM s, level),
n AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0::DOUBLE END AS rate,
         (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.key, d.doc_id))::DOUBLE AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (floor(pos * rate + u) - floor((pos - 1) * rate + u))::BIGINT * size AS taken
FROM n
""",
    "op5_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, sha256(norm) AS text_sha256
FROM n WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
""",
}
