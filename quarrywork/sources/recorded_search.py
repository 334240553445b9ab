"""Recorded web searches as a data source: what a search gave when it was asked, read again without the network.

``record`` keeps hits (query, rank, href, title, body) in rounds, each parted by a digest of the query.
``spark.read.format("recorded_search")`` reads all rounds; of a filter on ``query`` (equal, in) only the
parts that can hold such queries are read.  ``spark.readStream`` gives the rounds as they come.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..session import ship_package

NAME, HITS = "recorded_search", "query string, rank int, href string, title string, body string"
COLUMNS = ["query", "rank", "href", "title", "body"]
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; its filters are pushed from then on."""
    ship_package(spark)
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(RecordedSearch)


def _storage(path: str):
    """File system of Arrow and the folder on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[A-Za-z][\w+.-]*:/", path) else f"file://{path}")


def rounds(path: str) -> int:
    """How many rounds are recorded in full, without a gap."""
    from pyarrow import fs

    storage, folder = _storage(path)
    done = 0
    while storage.get_file_info(f"{folder}/round={done}/_SUCCESS").type == fs.FileType.File:
        done += 1
    return done


def record(hits: DataFrame, path: str, parts: int = 64) -> int:
    """Keeps hits as the next round and returns its number.

    One recorder at a time; a round that was not finished is written again.  Rows without a query are kept in
    a part of their own.  The rows of a part that is large are dealt to several tasks.
    """
    number = rounds(path)
    part = F.when(F.col("query").isNull(), F.lit(-1)).otherwise(F.pmod(F.crc32(F.encode("query", "UTF-8")), F.lit(parts))).cast("int")
    rows = hits.select("query", F.col("rank").cast("int").alias("rank"), "href", "title", "body", F.lit(parts).alias("of"), part.alias("part"))
    rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("of", "part").parquet(f"{path}/round={number}")
    return number


@dataclass
class File(InputPartition):
    """One file of a part, and the queries that are asked for (None: all)."""

    path: str
    asked: tuple[str, ...] | None = None


def _files(path: str, first: int, end: int, asked: tuple[str, ...] | None) -> list[File]:
    from pyarrow import fs

    storage, folder = _storage(path)
    out = []
    for number in range(first, end):
        for found in storage.get_file_info(fs.FileSelector(f"{folder}/round={number}", recursive=True)):
            place = re.search(r"/of=(\d+)/part=(-?\d+)/[^/_.][^/]*$", found.path)
            if place and found.type == fs.FileType.File:
                of, part = map(int, place.groups())
                here = None if asked is None else tuple(q for q in asked if zlib.crc32(q.encode()) % of == part)
                if here is None or here:
                    out.append(File(found.path, here))
    return out


def _rows(path: str, file: File) -> Iterator:
    """The rows of a file as Arrow batches."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    with _storage(path)[0].open_input_file(file.path) as source:
        for batch in pq.ParquetFile(source).iter_batches(1000, columns=COLUMNS):
            if file.asked is not None:
                batch = batch.filter(pc.is_in(batch.column("query"), value_set=pa.array(file.asked, pa.string())))
            if batch.num_rows:
                yield batch.select(COLUMNS)


class Recorded(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.asked = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("query",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                values = {v for v in values if v is not None}  # nothing is equal to null
                self.asked = values if self.asked is None else self.asked & values
            else:
                yield f

    def partitions(self) -> list[File]:
        asked = None if self.asked is None else tuple(sorted(self.asked))
        return _files(self.path, 0, rounds(self.path), asked)

    def read(self, partition: File | None) -> Iterator:
        # Spark asks for one reading without a partition where there is none.
        return _rows(self.path, partition) if isinstance(partition, File) else iter(())


class Rounds(DataSourceStreamReader):
    """Offsets are numbers of rounds; a micro-batch holds the rounds that came since the last one."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        return {"round": rounds(self.path)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return _files(self.path, start["round"], end["round"], None)

    def read(self, partition: File) -> Iterator:
        return _rows(self.path, partition) if isinstance(partition, File) else iter(())


class RecordedSearch(DataSource):
    """Option ``path``: the folder of the rounds, on a file system that Arrow and all executors reach."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return HITS

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError(f"{NAME} needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> Recorded:
        return Recorded(self._path())

    def streamReader(self, schema: StructType) -> Rounds:
        return Rounds(self._path())
