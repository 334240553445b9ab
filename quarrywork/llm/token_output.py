"""Token-ID / binary output: Arrow files of fixed-size-list batches.

Documents are range-partitioned by id and sorted; each partition is one file (ascending ids across
files, too).  A file's ids are one stream cut into sequences of ``seq_len``: record batches of
``input_ids: fixed_size_list<uint16>[seq_len]`` (uint32 where the vocabulary has over 65,536 ids) and
``mask: fixed_size_list<bool>[seq_len]`` (false on the padding of a file's last sequence), ``ROWS``
sequences a batch.  Files are in Arrow's IPC file
format, so a reader maps the file and slices sequence k out of batch ``k // ROWS`` without a copy.
Beside each is ``*.docs.arrow`` with ``doc_id, start, n_tokens`` within the file: an id that ends a
document may also occur within a text, so boundaries are stored and not guessed.

Recovery: a task writes under a name of its own attempt and reports it in a manifest that Spark
commits; readers open only files in the manifest, so files of lost attempts are ignored.  Memory in
a task: one Arrow batch of texts and one batch of sequences.

Defined cases: null and empty texts are the end id alone; rows with null ids come first; rows that
share an id are written in the order of their text; an empty table gives a manifest without rows;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .encoding import shared_encoder
from .scratch import passing_path
from .worker import lean

SEQ_LEN, ROWS = 2048, 256
END_ID = 2
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long"
_ROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def open_dir(uri: str):
    """The file system of a URI and the path in it; works for any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes ids as sequences of one length; keeps at most one batch in memory."""

    def __init__(self, sink, seq_len: int, rows: int, narrow: bool):
        self.seq_len, self.rows = seq_len, rows
        lists = lambda kind: pa.list_(pa.field("item", kind, nullable=False), seq_len)
        self.kind = np.uint16 if narrow else np.uint32
        self.schema = pa.schema([pa.field("input_ids", lists(pa.from_numpy_dtype(self.kind)), False), pa.field("mask", lists(pa.bool_()), False)])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[bytes] = []
        self.bytes = self.tokens = self.sequences = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.bytes += len(ids)
        self.tokens += len(ids) // 4
        if self.bytes >= 4 * self.seq_len * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        raw, unit = b"".join(self.waiting), 4 * self.seq_len
        upto = len(raw) if last else len(raw) // (unit * self.rows) * unit * self.rows
        for at in range(0, upto, unit * self.rows):
            ids = np.frombuffer(raw[at : min(upto, at + unit * self.rows)], dtype="<u4")
            n = -(-len(ids) // self.seq_len)
            flat, mask = np.zeros(n * self.seq_len, self.kind), np.zeros(n * self.seq_len, bool)
            flat[: len(ids)], mask[: len(ids)] = ids, True
            kinds = [f.type for f in self.schema]
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=k) for x, k in zip((flat, mask), kinds)]
            self.file.write_batch(pa.record_batch(columns, schema=self.schema))
            self.sequences += n
        self.waiting, self.bytes = [raw[upto:]], len(raw) - upto

    def close(self) -> None:
        self._flush(True)
        self.file.close()


def write(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int = END_ID, seq_len: int = SEQ_LEN,
          id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the files under ``uri`` (a folder that all executors share); returns the manifest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    dealt = dealt.sortWithinPartitions("doc_id", "text")

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        system, folder = open_dir(uri)
        system.create_dir(folder, recursive=True)
        name = f"part-{part:06d}-{task.taskAttemptId()}"
        out = index = writer = None
        encoder, start, n_docs = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = shared_encoder(tokenizer_path)
                out = system.open_output_stream(f"{folder}/{name}.arrow")
                side = system.open_output_stream(f"{folder}/{name}.docs.arrow")
                writer, index = SequenceWriter(out, seq_len, ROWS, max(end_id, len(encoder.lengths) - 1) < 1 << 16), pa.ipc.new_file(side, _ROW)
            sizes: list[int] = []
            for _, _, ids, ends in encoder.flat(batch.column(1), end_id):
                writer.add(ids.tobytes())
                sizes += np.diff(ends).tolist()
            starts = start + np.cumsum([0, *sizes])
            index.write_batch(pa.record_batch([batch.column(0), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64())], schema=_ROW))
            start, n_docs = int(starts[-1]), n_docs + len(sizes)
        if writer is not None:
            writer.close(), index.close(), out.close(), side.close()
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "path": [f"{uri}/{name}"], "n_docs": [n_docs], "n_tokens": [writer.tokens], "n_sequences": [writer.sequences]})

    manifest = dealt.mapInArrow(encode, MANIFEST)
    manifest.write.parquet(f"{uri}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest")


def read_file(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Documents of one file: id, start within the file, ids.  Holds one batch and one document."""
    system, name = open_dir(path)
    source = system.open_input_file(f"{name}.arrow")
    reader = pa.ipc.open_file(source)
    at, have, batch = 0, np.empty(0, np.uint16), 0
    with system.open_input_file(f"{name}.docs.arrow") as side:
        index = pa.ipc.open_file(side)
        for k in range(index.num_record_batches):
            docs = index.get_batch(k)
            for doc, start, n in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                parts = [have[start - at :]]
                while sum(map(len, parts)) < n:
                    got = reader.get_batch(batch)
                    ids = got.column(0).values.to_numpy()
                    mask = got.column(1).values.to_numpy(zero_copy_only=False)
                    parts.append(ids if mask[-1] else ids[: int(mask.sum())])
                    batch += 1
                have, at = np.concatenate(parts) if len(parts) > 1 else parts[0], start
                yield doc, start, have[:n]
    source.close()


def read(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (over all documents before), n_tokens, ids_crc32."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = files.select("path", "before").repartition(max(1, manifest.count()), "path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path, before in zip(files.column(0).to_pylist(), files.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc, start, ids in read_file(path):
                    rows.append((doc, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return files.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write to a new shared folder and read the files back."""
    return read(write(docs, passing_path(spark, "tokens"), tokenizer_path, **options))
