"""License scans [native]: canonical digest lookup.

A text is brought to a canonical form: ASCII letters lower-cased, copyright lines dropped, equivalent
spellings made one, and everything but ASCII letters and digits removed between words.  The digest
of the whole canonical text is hash-joined to the digests of the known licences.  The same lookup is
made for each line that speaks of a licence, and for each paragraph of several lines (between blank
lines) that does, so that notices and parts of licences inside other texts are found, behind the marks of
a comment, too; a line or paragraph is a text of its own here.  Paragraphs are known by those of the
whole texts, of at least ``PARAGRAPH`` characters, that stand in one licence only.

The catalogue of digests is a constant of the package (some 16,000 notices and whole texts, see
``license_catalogue``), so it is broadcast.  A notice in other words, and a text that is neither in
the catalogue nor a listed variant of one in it, matches nothing.

Defined cases: null and empty texts and texts without letters or digits have the digest of the empty
text and match nothing; a null id is kept; rows that repeat are scanned each; several notices in one
text are listed once each in order of name; an empty table gives an empty result; further columns
are ignored by ``scan`` and kept by ``unlicensed``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .license_catalogue import notices, paragraphs, whole_texts
from .scratch import unused

#: Equivalent spellings, applied in this order to text in lower case.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("http:", "https:"), ("(c)", "copyright"), ("©", "copyright"), ("sub-license", "sublicense"),
             ("non-infringement", "noninfringement"), ("per cent", "percent"), ("copyright holder", "copyright owner"), ("&", "and"))

#: Texts and notices of licences, in canonical spelling or not.
_BASE = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
_WHOLE = whole_texts([(n, t) for n, t in _BASE if n in ("MIT", "ISC") and len(t) > 200])
#: Characters of a paragraph by which a licence is known.
PARAGRAPH = 80
KNOWN = (*_BASE, *_WHOLE, *notices())
PARTS = paragraphs([(n, t) for n, t in (*_BASE, *_WHOLE) if len(t) > 200], PARAGRAPH)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that opens with a copyright mark and names a year or "all rights reserved".
COPYRIGHT_LINE = r"(^|\n)[ \t]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "$1")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, "[^0-9a-z]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def catalogue(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """license, digest: one row for each known digest, computed by the same expressions."""
    rows = F.from_json(F.lit(json.dumps([{"license": name, "text": text} for name, text in known])), "array<struct<license:string,text:string>>")
    rows = spark.range(1).select(F.explode(rows).alias("k")).select("k.license", digest(F.col("k.text")).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


#: What a line, and what a paragraph, has that can be in the catalogue.
LINE_MARK, PARAGRAPH_MARK = "(?i)licen[sc]|spdx|permission|copyright", "(?i)licen[sc]|permission|copyright|warrant|redistribut"
BLANK_LINE = r"\n[ \t]*\n"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest, license (of the whole text, else null), notices (of lines and paragraphs)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(LINE_MARK))
    some = F.when(text.rlike(BLANK_LINE), F.filter(F.split(text, BLANK_LINE, -1), lambda x: x.rlike(PARAGRAPH_MARK))).otherwise(F.array().cast("array<string>"))
    digests = lambda parts: F.transform(parts, lambda x: F.sha2(canonical(x), 256))
    rows = docs.select(F.col(id_col).alias("__id"), digest(text).alias("digest"), digests(lines).alias("__lines"), digests(some).alias("__some"))
    known = catalogue(spark)
    out = rows.join(F.broadcast(known), "digest", "left")
    # The catalogues are constants: literal maps in the expression, one for each start of a digest.
    whole, part = _lookup(known, 12), _lookup(catalogue(spark, PARTS), 8)
    names = F.concat(F.transform("__lines", whole), F.transform("__some", lambda d: F.coalesce(whole(d), part(d))))
    names = F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull())))
    return out.select(F.col("__id").alias(id_col), "digest", "license", F.array_join(names, ",").alias("notices"))


def _lookup(known: DataFrame, bits: int):
    """A function from a digest to its licence, null where it is unknown."""
    starts: list[dict[str, str]] = [{} for _ in range(1 << bits)]
    for r in known.collect():  # a constant of the package
        starts[int(r["digest"][:3], 16) >> (12 - bits)][r["digest"]] = r["license"]
    found = F.from_json(F.lit(json.dumps(starts)), "array<map<string,string>>")
    start = lambda d: F.shiftright(F.conv(F.substring(d, 1, 3), 16, 10).cast("int"), 12 - bits)
    return lambda d: F.try_element_at(F.get(found, start(d)), d)


def unlicensed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose whole text is no known licence, unchanged."""
    own, known = unused(docs, "__qw_digest"), unused(docs, "__qw_known")
    rows = docs.withColumn(own, digest(F.col(text_col)))
    listed = F.broadcast(catalogue(docs.sparkSession).select(F.col("digest").alias(known)))
    return rows.join(listed, F.col(own) == F.col(known), "left_anti").drop(own)
