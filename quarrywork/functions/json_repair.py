"""Repair of damaged JSON objects: the first candidate that parses with its required keys wins."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import text as X
from .text import Text, col


def candidates(raw: Text) -> list[Column]:
    """As it is; the fenced block; quotes turned; trailing commas dropped; from first to last brace."""
    t = F.trim(col(raw))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    quotes = F.replace(t, F.lit("'"), F.lit('"'))
    commas = F.regexp_replace(t, r",\s*([}\]])", "$1")
    body = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    both = F.regexp_replace(F.replace(body, F.lit("'"), F.lit('"')), r",\s*([}\]])", "$1")
    return [t, fenced, quotes, commas, body, both]


def repaired(raw: Text, required: Sequence[str] = ()) -> Column:
    """The repaired object's text, or null."""

    def valid(c: Column) -> Column:
        ok = F.try_parse_json(c).isNotNull() & c.startswith("{")
        for k in required:
            ok = ok & F.get_json_object(c, f"$.{k}").isNotNull()
        return F.when(ok, c)

    return F.coalesce(*[X.let(c, valid) for c in candidates(raw)])


def number(raw: Text, field: str) -> Column:
    """A number salvaged from ``"field": value`` in text that no repair makes valid."""
    found = F.regexp_extract(col(raw), rf"['\"]?{field}['\"]?\s*:\s*['\"]?(-?[0-9]+(?:\.[0-9]+)?)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def salvaged(raw: X.Text) -> Column:
    """What ``"key": value`` pairs a broken text holds, as JSON of strings, numbers and lists of strings;
    null without any.  Keys found as a number replace those found as a string, lists replace both; of
    equal ones the last counts."""
    return X.let(X.col(raw), lambda t: X.let(_pairs(t), _last_of_each))


def _bare(text: Column) -> Column:
    """A text as JSON has it between quotes."""
    return X.let(F.to_json(F.array(text)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def _pairs(t: Column) -> Column:
    """(k, v) of a text: those found as strings, then numbers, then lists."""
    pairs = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    key = lambda x: F.regexp_extract(x, r'^"([^"]+)"', 1)
    after = lambda x: F.regexp_replace(x, r'(?s)^"[^"]+":\s*', "")
    as_number = lambda v: v.cast("double").cast("string")
    word = lambda x: F.regexp_extract(x, r'(?s)^"[^"]+":\s*"([^"]*)"$', 1)
    value = lambda w: F.when(w.rlike(r"^\d+\.?\d*$"), as_number(w)).otherwise(_bare(w))
    strings = F.transform(pairs(r'"[^"]+":\s*"[^"]*"'), lambda x: F.struct(key(x).alias("k"), X.let(word(x), value).alias("v")))
    numbers = F.transform(pairs(r'"[^"]+":\s*\d+\.?\d*'), lambda x: F.struct(key(x).alias("k"), as_number(after(x)).alias("v")))
    lists = F.transform(pairs(r'(?s)"[^"]+":\s*\[.*?\]'), lambda x: F.struct(key(x).alias("k"), F.to_json(F.regexp_extract_all(after(x), F.lit(r'"([^"]+)"'), F.lit(1))).alias("v")))
    return F.concat(strings, numbers, lists)


def _last_of_each(every: Column) -> Column:
    """JSON of the last value of each key."""
    last = lambda k: F.element_at(F.filter(every, lambda x: x["k"] == k), -1)["v"]
    object_ = lambda keys: F.when(F.size(keys) > 0, F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(_bare(k), F.lit(":"), last(k))), ","), F.lit("}")))
    return X.let(F.array_distinct(F.transform(every, lambda x: x["k"])), object_)


def conforms(data: X.Text, schema: dict) -> Column:
    """Whether a JSON object has a schema's required keys, and those of its properties that it has the
    right type (string, number, array) and range."""
    return X.let(X.col(data), lambda d: X.let(F.coalesce(F.json_object_keys(d), F.array().cast("array<string>")), lambda keys: _conforms(d, keys, schema)))


def _conforms(d: Column, keys: Column, schema: dict) -> Column:
    ok = F.try_parse_json(d).isNotNull() & F.trim(d).startswith("{")
    for name in schema.get("required", ()):
        ok = ok & F.array_contains(keys, name)
    for name, rule in schema.get("properties", {}).items():
        kind = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(d), f"$.{name}", "variant")), F.lit("VOID"))
        value = F.get_json_object(d, f"$.{name}").try_cast("double")
        want = {"string": kind == "STRING", "number": kind.rlike("^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)"), "array": kind.startswith("ARRAY")}.get(rule.get("type"))
        good = F.lit(True) if want is None else want
        if rule.get("type") == "number":
            good = good & F.coalesce(value >= F.lit(float(rule.get("minimum", "-inf"))), F.lit(True)) & F.coalesce(value <= F.lit(float(rule.get("maximum", "inf"))), F.lit(True))
        ok = ok & (~F.array_contains(keys, name) | good)
    return F.coalesce(ok, F.lit(False))


#: What a failed analysis is, and the keys of the two kinds of answers.
ANALYSIS = {"domain": "general", "relevance_score": 0.5, "key_insights": [], "indian_context": "", "actionable_info": "", "data_points": [], "geographic_relevance": []}
ANALYSIS_SCHEMA = {"required": ("domain", "relevance_score"), "properties": {"domain": {"type": "string"}, "relevance_score": {"type": "number", "minimum": 0, "maximum": 1}, "key_insights": {"type": "array"}}}
QUERY_SCHEMA = {"required": ("queries",), "properties": {"queries": {"type": "array"}}}


def default_analysis() -> Column:
    """The analysis that stands for one that failed, as JSON."""
    return F.lit(json.dumps({**ANALYSIS, "llm_processed": False, "parse_error": True}))


def parsed(raw: X.Text, schema: dict = ANALYSIS_SCHEMA, default: Column | None = None) -> Column:
    """The repaired object if it conforms, else the salvaged pairs if these do, else the default."""
    good = lambda data: X.let(data, lambda d: F.when(conforms(d, schema), d))
    fallback = default_analysis() if default is None else default
    return F.coalesce(good(repaired(raw, schema.get("required", ()))), good(salvaged(raw)), fallback)


def merged_analysis(data: X.Text) -> Column:
    """An analysis as a struct: the score within 0 to 1 (0.5 if it is none), the lists up to 5, 10 and 10
    entries, defaults where a key is missing."""
    kind = "domain string, relevance_score string, key_insights array<string>, indian_context string, actionable_info string, data_points array<string>, geographic_relevance array<string>"
    return X.let(F.from_json(X.col(data), kind, {"mode": "PERMISSIVE"}), _merged)


def _merged(d: Column) -> Column:
    listed = lambda name, most: F.slice(F.coalesce(d[name], F.array().cast("array<string>")), 1, most).alias(name)
    text = lambda name: F.coalesce(d[name], F.lit(ANALYSIS[name])).alias(name)
    score = clamp(F.coalesce(d["relevance_score"].try_cast("double"), F.lit(0.5))).alias("relevance_score")
    return F.struct(text("domain"), score, listed("key_insights", 5), text("indian_context"), text("actionable_info"), listed("data_points", 10), listed("geographic_relevance", 10))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def clipped(values: Column, most: int = 20, length: int = 5000) -> Column:
    return F.transform(F.slice(values, 1, most), lambda v: F.substring(v, 1, length))
