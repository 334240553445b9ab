"""Row validation: error messages in a column, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as L
from ..schemas import CORPUS_RECORD, REQUIRED

#: Fixed value: the form of a valid link.
URL = r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"


# The messages.
def errors(have: list[str]) -> Column:
    """Messages for one record; missing required fields alone where there are any."""
    missing = [F.when(F.lit(True) if f not in have else F.col(f).isNull(), F.lit(f"Missing required field: {f}")) for f in REQUIRED]
    absent = F.array_compact(F.array(*missing))
    if not set(REQUIRED) <= set(have):
        return absent
    say = lambda bad, *text: F.when(F.coalesce(bad, F.lit(True)), F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text]))
    year = F.col("publication_year") if "publication_year" in have else F.lit(None).cast("int")
    found = [
        say(~F.col("genre").isin(*L.GENRES), "Invalid genre: ", F.col("genre")),
        say(~F.col("data_type").isin(*L.DATA_TYPES), "Invalid data_type: ", F.col("data_type")),
        say(~F.col("link").rlike(URL), "Invalid URL format: ", F.col("link")),
        say(~F.col("relevance_score").between(0.0, 1.0), "Relevance score must be between 0.0 and 1.0"),
        say(F.try_to_timestamp(F.col("extraction_timestamp")).isNull(), "Invalid timestamp format: ", F.col("extraction_timestamp")),
        F.when(year.isNotNull() & ~year.between(1900, 2030), F.concat(F.lit("Invalid publication year: "), year.cast("string"))),
        say(F.col("content_length") < 50, "Content too short: ", F.col("content_length").cast("string")),
        *[say(F.trim(F.col(f)) == "", f"Empty or whitespace-only {f}") for f in ("title", "text_extracted", "abstract")],
        *[say(F.length(F.col(f)) != 32, f"Invalid {f} length (should be 32 characters)") for f in ("content_hash", "url_hash")],
    ]
    return F.when(F.size(absent) > 0, absent).otherwise(F.array_compact(F.array(*found)))


#: What a field of each kind must be, as its message names it.
KINDS = {"string": "<class 'str'>", "array<string>": "<class 'list'>", "double": "(<class 'int'>, <class 'float'>)", "bigint": "<class 'int'>", "boolean": "<class 'bool'>"}


def type_errors(record: str = "record") -> Column:
    """Messages for the fields of a raw JSON record that are there and not of their type; a boolean is
    taken for a whole number, as it is one where records come from."""
    data = F.try_parse_json(F.col(record))
    keys = F.coalesce(F.json_object_keys(F.col(record)), F.array().cast("array<string>"))
    fits = {"string": ("STRING",), "array<string>": ("ARRAY",), "double": ("BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN"), "bigint": ("BIGINT", "BOOLEAN"), "boolean": ("BOOLEAN",)}
    found = []
    for f in CORPUS_RECORD:
        kind = f.dataType.simpleString()
        if f.name not in REQUIRED or kind not in KINDS:
            continue
        own = F.coalesce(F.schema_of_variant(F.try_variant_get(data, f"$.{f.name}", "variant")), F.lit("VOID"))
        bad = F.array_contains(keys, f.name) & ~own.rlike("^(" + "|".join(fits[kind]) + ")")
        found.append(F.when(bad, F.concat(F.lit(f"Invalid type for {f.name}: expected {KINDS[kind]}, got "), own)))
    return F.array_compact(F.array(*found))


def validated(records: DataFrame) -> DataFrame:
    return records.withColumn("errors", errors(records.columns)).withColumn("valid", F.size("errors") == 0)


def summary(checked: DataFrame) -> DataFrame:
    """Total, valid, invalid, rate: one row."""
    n, ok = F.count(F.lit(1)), F.count_if("valid")
    return checked.agg(n.alias("total"), ok.alias("valid"), (n - ok).alias("invalid"), F.coalesce(F.try_divide(ok.cast("double"), n), F.lit(0.0)).alias("rate"))


def first_errors(checked: DataFrame, order: str, most: int = 50) -> DataFrame:
    """The first ``most`` messages in row order (a report)."""
    rows = checked.select(F.col(order).alias("entry"), F.posexplode("errors").alias("pos", "error"))
    return rows.orderBy("entry", "pos").limit(most).select("entry", F.format_string("Entry %d: %s", "entry", "error").alias("error"))
