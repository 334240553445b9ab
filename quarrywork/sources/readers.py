"""Sources.  Schemas are given, never inferred; paths may be in any store that Spark reads."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..schemas import CORPUS_RECORD
from ..session import ship_package
from . import json_splits


#: Splits of files whose counts are broadcast at most (some 100 bytes each); beyond it the join shuffles.
BROADCAST_SPLITS = 100_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, row_idx (the line's number in its file), line_no (over all files in order of name).

    Rows of a split have consecutive ids, so a line's place is its id less its split's least one, plus
    the lines of the splits before: counts by split are combined map-side, and only they are summed up
    in order (one row a split).
    """
    ids = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    splits = ids.groupBy("file", "__at").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.orderBy("file", "__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "__at", "__first", before(W.partitionBy("file")).alias("__own"), before(W.partitionBy()).alias("__all"))
    splits = F.broadcast(splits) if spark.read.text(path).rdd.getNumPartitions() <= BROADCAST_SPLITS else splits
    place = F.col("__id") - F.col("__first")
    return ids.join(splits, ["file", "__at"]).select("value", "file", (place + F.col("__own")).alias("row_idx"), (place + F.col("__all")).alias("line_no"))


def jsonl(spark: SparkSession, path: str, schema: T.StructType = CORPUS_RECORD, keep: Column | None = None, most: int | None = None, over_all: bool = False) -> DataFrame:
    """JSON lines with ``row_idx``, the line's number in its file or, with ``over_all``, over all files in order
    of name (blank lines count).

    Blank and malformed lines are dropped; ``keep`` filters records; ``most`` stops after that many
    kept ones, in order of file and line.
    """
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    lines = numbered_lines(spark, path).where((F.trim("value") != "") & F.try_parse_json("value").isNotNull())
    number = F.col("line_no" if over_all else "row_idx").alias("row_idx")
    rows = lines.select(parsed.alias("r"), number, "line_no").select("r.*", "row_idx", "line_no")
    rows = rows.where(keep) if keep is not None else rows
    return (rows.orderBy("line_no").limit(most) if most is not None else rows).drop("line_no")


def equal_domain(domain: str | None, column: str = "source_domain") -> Column:
    return F.lit(True) if domain is None else F.coalesce(F.col(column), F.lit("")) == domain


def _objects(paths: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path -> path, pos, object: the outermost objects of a file's text, as they stand there.

    The file is read in pieces and scanned for braces outside strings, so what is held is one piece
    and one object.
    """
    from pyarrow import fs

    mark = re.compile(r'["\\{}]')
    for batch in paths:
        for path in batch.column(0).to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            depth, quoted, skip, held, pos, found = 0, False, False, [], 0, []
            with system.open_input_stream(name) as stream:
                decode = codecs.getincrementaldecoder("utf-8")("replace").decode
                while True:
                    raw = stream.read(1 << 20)
                    text, start, at = decode(raw, not raw), 0, 0
                    if skip:
                        at, skip = min(1, len(text)), not text
                    while hit := mark.search(text, at):
                        at, c = hit.end(), hit.group()
                        if c == "\\":
                            at, skip = at + 1, at >= len(text)
                        elif c == '"':
                            quoted = not quoted
                        elif not quoted and c == "{":
                            start = hit.start() if depth == 0 else start
                            depth += 1
                        elif not quoted and depth:
                            depth -= 1
                            if depth == 0:
                                found.append((path, pos, "".join([*held, text[start:at]])))
                                held, pos = [], pos + 1
                    if depth:
                        held.append(text[start:])
                    if found and (not raw or len(found) >= 1000):
                        yield pa.record_batch([pa.array(c) for c in zip(*found)], names=["file", "pos", "object"])
                        found = []
                    if not raw:
                        break


#: Bytes from which a document is read in splits.
LARGE_DOCUMENT = 64 << 20


def json_document(spark: SparkSession, path: str, schema: T.StructType, first: int | None = None, large: int | None = None) -> DataFrame:
    """An array of objects (or one object) as rows; truncation, in order, only where ``first`` asks for it.

    Files of up to ``large`` bytes (``LARGE_DOCUMENT``) are a task each, which streams them; larger ones are read
    in splits by many tasks (``json_splits``).  Both ways give the same rows: a malformed object is skipped and
    the others are read, provided that its quotes and braces are in pairs.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    limit = LARGE_DOCUMENT if large is None else large
    big = [r["path"] for r in files.where(F.col("length") > limit).select("path").collect()]
    small = files.where(F.col("length") <= limit).select("path")
    small = small.repartition(max(1, small.count()))
    rows = small.mapInArrow(_objects, "file string, pos long, object string").select("file", F.lit(0).cast("long").alias("at"), F.col("pos").alias("nr"), "object")
    if big:
        rows = rows.unionByName(json_splits.objects(spark, big))
    rows = rows.where(F.try_parse_json("object").isNotNull())
    rows = rows.orderBy("file", "at", "nr").limit(first) if first is not None else rows
    return rows.select(F.from_json("object", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def metadata(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The metadata of an index: Parquet where the folder has a finished copy of it, else the JSON document,
    of which a Parquet copy is left for the next time.  No other binary format is read."""
    copy = f"{path}.parquet"
    fs, p = _file_system(spark, f"{copy}/_SUCCESS")
    if not fs.exists(p):
        json_document(spark, path, schema).write.mode("overwrite").parquet(copy)
    return spark.read.schema(schema).parquet(copy)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def questions(spark: SparkSession, path: str) -> DataFrame:
    """CSV with ``id`` or ``ID`` and ``query_question`` or ``question``."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    pick = lambda *names: F.coalesce(*[F.col(c) for c in rows.columns if c in names], F.lit(None))
    return rows.select(pick("id", "ID").cast("string").alias("id"), pick("query_question", "question").cast("string").alias("question"))


def text_lines(spark: SparkSession, path: str, head: int | None = None, tail: int | None = None) -> DataFrame:
    """Lines with their order over all files by name; the first or the last few of them."""
    if head is not None and tail is not None:
        raise ValueError("head and tail exclude each other")
    rows = numbered_lines(spark, path).select("value", "line_no")
    if head is not None:
        return rows.orderBy("line_no").limit(head)
    return rows.orderBy(F.desc("line_no")).limit(tail) if tail is not None else rows


def state(spark: SparkSession, path: str) -> DataFrame:
    """The state (kind, key) of earlier runs; empty where there is none or its files are damaged."""
    schema = "kind string, key string"
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path).where("kind IS NOT NULL AND key IS NOT NULL")


def file_info(spark: SparkSession, path: str, large_mb: float = 100, stream_mb: float = 500) -> DataFrame:
    """Size and time of each file, whose contents are not read; one row with ``exists`` false where there is none."""
    fs, p = _file_system(spark, path)
    kind = "path string, modificationTime timestamp, size_bytes long"
    if fs.globStatus(p):
        files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", F.col("length").alias("size_bytes")).withColumn("exists", F.lit(True))
    else:
        files = spark.createDataFrame([(path, None, 0)], kind).withColumn("exists", F.lit(False))
    mb = F.col("size_bytes") / 1048576
    return files.withColumns({"size_mb": mb, "size_gb": mb / 1024, "is_large": mb > large_mb, "requires_streaming": mb > stream_mb})


def bootstrap_state(records: DataFrame) -> DataFrame:
    """url, title, content from records that may name them in two ways."""
    have = records.columns
    either = lambda a, b: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (a, b) if c in have], F.lit(None).cast("string"))
    return records.select(either("link", "url").alias("url"), either("title", "title").alias("title"), either("text_extracted", "content").alias("content"))


def candidates(hits: DataFrame, most: int) -> DataFrame:
    """Hits (query_id, strategy, rank, href, ...) in order of strategy, distinct by URL, ``most`` a query."""
    order = [F.col("strategy"), F.col("rank")]
    first = F.row_number().over(W.partitionBy("query_id", "href").orderBy(*order))
    kept = hits.withColumn("__f", first).where("__f = 1").drop("__f")
    return kept.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= most)
