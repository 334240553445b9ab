"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is byte-level BPE (``tokenizers``), B is BPE with byte fallback (``sentencepiece``), which adds
a space; so A gets a space and the text, too.  For a run of texts the bytes at which tokens end are marked
in one packed bitset for each tokenizer.  Their AND holds the shared cuts; popcounts of whole words, summed
up, and of the masked word at a cut give the tokens of either side before it (rank), so every cut becomes a
range of tokens.  The ranges between two cuts are a group, and all A-B pairs of a group are links.

Over the corpus, an id pair counts the documents that hold it linked.  Documents are written with their
distinct pairs and how often each occurs; the counts are one map-side combined aggregate over the pairs.
Up to ``BROADCAST_PAIRS`` distinct pairs meet the documents as sorted arrays (9 bytes a pair) in the Python
workers; more meet them in a join by pair, in which the pairs' side has one row a pair, so that AQE can
split a frequent pair.  Both ways give the same rows.

A task holds a run of some 512 KB of text (a longer text is a run of its own) and ``LINKS`` links of it at a
time.

Defined cases: null and empty texts, and texts whose joined tokens of A or B are not a space and the text
(U+2581 in a text reads as a space, say), have no tokens: zeros and ''.  Rows are judged one by one, so
repeated rows and rows that share an id, or have none, are rows of the result each, and count as documents
each.  Spellings of special tokens are plain text.  An empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .encoding import Encoder
from .scratch import Scratch
from .worker import lean
from .wordhash import slices

#: Distinct pairs that are sent to the workers as arrays.
BROADCAST_PAIRS = 4_000_000
#: Links whose arrays are held at once.
LINKS = 1 << 20
#: Parts of texts whose pieces a worker keeps, and their greatest length.
PARTS_KEPT, LONGEST = 1 << 20, 64
#: New parts that are encoded as one text.
TOGETHER = 2000
_PARTS = re.compile(" +[^ ]*")
_SHARED: dict[tuple[str, str], "Aligner"] = {}


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


class Vocabulary:
    """The bytes of every token, one behind the other."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.first[ids], self.size[ids])]


def byte_level(token: str) -> bytes:
    """The bytes that a byte-level token's characters stand for: printable Latin-1 characters for
    themselves, characters from U+0100 on for all other bytes in ascending order."""
    if not _BYTES:
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        _BYTES.update({chr(b): b for b in own})
        _BYTES.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)})
    return bytes(_BYTES[c] for c in token) if all(c in _BYTES for c in token) else token.encode()


_BYTES: dict[str, int] = {}


class Pieces:
    """Ids of a SentencePiece model: texts are cut before each run of spaces, and parts are kept.

    No piece of a model that splits at white space holds a space behind another character, so no piece
    crosses such a cut; a model with other pieces gets whole texts.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)
        self.kept: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The 32-bit ids of each text."""
        if not self.cuts:
            return [np.array(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]
        parts = [_PARTS.findall(" " + t) if t else [] for t in texts]
        if len(self.kept) > PARTS_KEPT:
            self.kept.clear()
        new = sorted(set(chain.from_iterable(parts)).difference(self.kept))
        self._learn([p for p in new if "▁" not in p and p.strip(" ")], [p for p in new if "▁" in p or not p.strip(" ")])
        out = [b"".join(map(self.kept.__getitem__, p)) for p in parts]
        for p in new:
            if len(p) > LONGEST:
                del self.kept[p]
        return out

    def _learn(self, plain: list[str], odd: list[str]) -> None:
        """Keeps the ids of new parts: plain ones are encoded behind each other and cut by their bytes."""
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = np.array(self.model.encode("".join(some)[1:]), "<u4")
            ends, size = np.cumsum([len(p.encode()) for p in some]), np.cumsum(self.vocabulary.size[ids])
            upto = np.searchsorted(size, ends)
            if len(size) and size[-1] == ends[-1] and (size[upto] == ends).all():
                raw, upto = ids.tobytes(), (4 * (upto + 1)).tolist()
                self.kept.update(zip(some, (raw[i:j] for i, j in zip([0, *upto], upto))))
            else:
                odd = odd + some
        for p in odd:
            # A text without characters has no tokens, so one space alone is looked up.
            self.kept[p] = np.array(self.model.encode(p[1:]) if len(p) > 1 else [self.model.piece_to_id("▁")], "<u4").tobytes()


class Bits:
    """Marked positions as packed words, with the marks before each word."""

    def __init__(self, places: np.ndarray, n: int):
        marks = np.zeros(-(-n // 64) * 64, bool)
        marks[places] = True
        self.words = np.packbits(marks, bitorder="little").view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Marks up to and at each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = self.words[word] & (~np.uint64(0) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(upto)

    def shared(self, other: "Bits") -> np.ndarray:
        """Places that are marked in both."""
        return np.flatnonzero(np.unpackbits((self.words & other.words).view(np.uint8), bitorder="little"))


class Aligner:
    """Two tokenizers, and the groups and links of texts between them."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Encoder(a_path)
        self.a.model.encode_special_tokens = True
        self.a.added = []
        self.b = Pieces(b_path)
        model = self.a.model
        self.a_vocabulary = Vocabulary([byte_level(model.id_to_token(i) or "") for i in range(model.get_vocab_size())])
        text = lambda n, ends: [f"{i}{e}".encode() for i in range(n) for e in ends]
        #: Every id as text with what follows it inside and at the end of its side of a group.
        self.written = text(len(self.a_vocabulary.size), ",|") + text(len(self.b.vocabulary.size), ",;")

    def rows(self, column: pa.Array) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text."""
        given = pc.fill_null(column, "")
        spaced = pc.binary_join_element_wise(pa.scalar(" ", given.type), given, pa.scalar("", given.type))
        for lo, hi, raw, offsets in slices(spaced):
            texts = given.slice(lo, hi - lo).to_pylist()
            runs = list(self.a.flat(spaced.slice(lo, hi - lo)))
            a = np.concatenate([ids for _, _, ids, _ in runs]).astype(np.int64)
            a_count = np.concatenate([np.diff(ends) for _, _, _, ends in runs])
            found = self.b.ids(texts)
            b = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
            b_count = np.array([len(x) // 4 for x in found], np.int64)
            good = np.array([bool(t) for t in texts])
            good &= self._same(self.a_vocabulary, a, a_count, raw, offsets) & self._same(self.b.vocabulary, b, b_count, raw, offsets)
            keep = lambda ids, count: (ids[np.repeat(good, count)], np.where(good, count, 0))
            size = np.where(good, np.diff(offsets), 0)
            yield from self._aligned(*keep(a, a_count), *keep(b, b_count), size)

    @staticmethod
    def _same(words: Vocabulary, ids: np.ndarray, count: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the joined tokens of each text are its bytes."""
        row = np.repeat(np.arange(len(count)), count)
        size = np.bincount(row, words.size[ids], len(count)).astype(np.int64)
        fits = size == np.diff(offsets)
        ids = ids[fits[row]]
        where = spread(offsets[:-1][fits], size[fits])
        wrong = where[words.joined(ids) != raw[where]]
        fits[np.searchsorted(offsets, wrong, side="right") - 1] = False
        return fits

    def _aligned(self, a: np.ndarray, a_count: np.ndarray, b: np.ndarray, b_count: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
        rows, n = len(size), int(size.sum())
        a_ends, b_ends = np.cumsum(self.a_vocabulary.size[a]) - 1, np.cumsum(self.b.vocabulary.size[b]) - 1
        a_bits, b_bits = Bits(a_ends, n), Bits(b_ends, n)
        cuts = a_bits.shared(b_bits)
        a_upto, b_upto = a_bits.rank(cuts), b_bits.rank(cuts)
        a_from, b_from = np.append(0, a_upto[:-1])[: len(cuts)], np.append(0, b_upto[:-1])[: len(cuts)]
        a_n, b_n = a_upto - a_from, b_upto - b_from
        group_ends = np.searchsorted(cuts, np.cumsum(size))  # groups before the end of each row
        group_row = np.repeat(np.arange(rows), np.diff(group_ends, prepend=0))
        links = np.bincount(group_row, a_n * b_n, rows).astype(np.int64)
        # Ids in the order in which they are written: A's of a group, then B's.
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(b_from, a_n)] = 2 * a
        order[np.arange(len(b)) + np.repeat(a_upto, b_n)] = 2 * (b + len(self.a_vocabulary.size))
        order[a_upto + b_from - 1] += 1
        order[a_upto + b_upto - 1] += 1
        ends = np.cumsum(a_count + b_count).tolist()
        pairs, times, pair_ends = self._pairs(a, b, a_from, b_from, a_n, b_n, group_row, rows)
        groups = np.diff(group_ends, prepend=0)
        at = pair_at = 0
        for k in range(rows):
            text = b"".join(map(self.written.__getitem__, order[at : ends[k]].tolist()))
            at = ends[k]
            yield int(a_count[k]), int(b_count[k]), int(groups[k]), int(links[k]), hashlib.sha256(text[:-1]).hexdigest() if text else "", pairs[pair_at : pair_ends[k]], times[pair_at : pair_ends[k]]
            pair_at = pair_ends[k]

    @staticmethod
    def _pairs(a, b, a_from, b_from, a_n, b_n, group_row, rows) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Distinct id pairs of each row, ascending, how often each is linked, and where rows end."""
        upto = np.cumsum(a_n * b_n)
        found, times = [], []
        total = int(upto[-1]) if len(upto) else 0
        for lo in range(0, total, LINKS):
            link = np.arange(lo, min(total, lo + LINKS))
            group = np.searchsorted(upto, link, side="right")
            nr = link - (upto - a_n * b_n)[group]
            pair = (a[a_from[group] + nr // b_n[group]] << 16) | b[b_from[group] + nr % b_n[group]]
            key, n = np.unique((group_row[group] << 32) | pair, return_counts=True)
            found.append(key), times.append(n)
        if not found:
            return np.empty(0, np.uint32), np.empty(0, np.int64), [0] * rows
        key, n = np.concatenate(found), np.concatenate(times)
        if len(found) > 1:  # a pair of one row may be met in several slices
            key, where = np.unique(key, return_inverse=True)
            n = np.bincount(where, n).astype(np.int64)
        ends = np.searchsorted(key >> 32, np.arange(rows), side="right")
        return (key & 0xFFFFFFFF).astype(np.uint32), n, ends.tolist()


def shared_aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for each Python worker."""
    if (a_path, b_path) not in _SHARED:
        _SHARED[a_path, b_path] = Aligner(a_path, b_path)
    return _SHARED[a_path, b_path]


_FIXED = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_LISTS = {"pairs": pa.int32(), "times": pa.int32()}
_SHAPE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its numbers, its groups' digest, its distinct linked pairs (A's id times 65,536
    and B's id, as a signed 32-bit number) and how often each occurs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    @lean
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, at = [], 0, 0
            texts = batch.column(1)
            for row in shared_aligner(a_path, b_path).rows(texts) if batch.num_rows else ():
                done.append(row)
                held += len(row[5])
                if held > LINKS:
                    yield _batch(batch.column(0).slice(at, len(done)), done)
                    at, done, held = at + len(done), [], 0
            if done:
                yield _batch(batch.column(0).slice(at, len(done)), done)

    return rows.mapInArrow(align, f"doc_id long, {_SHAPE}, pairs array<int>, times array<int>")


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    out = [ids, *(pa.array(c, f.type) for c, f in zip(columns, _FIXED))]
    ends = np.cumsum([0, *(len(x) for x in columns[5])]).astype(np.int32)
    out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(columns[5]).view(np.int32))))
    out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(columns[6]).astype(np.int32))))
    return pa.record_batch(out, names=["doc_id", *_FIXED.names, *_LISTS])


def counted(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best (whether no pair of its A id is held by more)."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    most = W.partitionBy(F.shiftrightunsigned("pair", 16))
    return counts.withColumn("best", F.col("n") == F.max("n").over(most))


def summed(tables: Scratch, rows: DataFrame, counts: DataFrame, bound: int = BROADCAST_PAIRS) -> DataFrame:
    """Rows with n_best (links whose pair is the best of its A id) and count_sum (the pairs' counts over links)."""
    if counts.count() <= bound:
        return _summed_there(rows, counts)
    named = tables.table("named", rows.withColumn("row", F.monotonically_increasing_id()))
    each = named.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    met = each.join(counts, each["pairs"] == counts["pair"])
    times = F.col("times").cast("long")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    out = named.join(sums, "row", "left").drop("row", "pairs", "times")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def _summed_there(rows: DataFrame, counts: DataFrame) -> DataFrame:
    known = counts.toArrow()
    pair = known.column("pair").to_numpy().astype(np.int32).view(np.uint32)
    order = np.argsort(pair)
    n, best = known.column("n").to_numpy()[order], known.column("best").to_numpy()[order]
    sent = rows.sparkSession.sparkContext.broadcast((pair[order], n.astype(np.uint32 if len(n) == 0 or n.max() < 1 << 32 else np.int64), best.astype(bool)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            size = np.diff(pairs.offsets.to_numpy())
            place = np.searchsorted(pair, pairs.flatten().to_numpy().view(np.uint32))
            upto = lambda x: np.append(0, np.cumsum(x))
            ends = upto(size)
            sums = [np.diff(upto(x)[ends]) for x in (times * best[place], times * n[place].astype(np.int64))]
            kept = batch.drop_columns(["pairs", "times"])
            yield pa.record_batch([*kept.columns, *(pa.array(x.astype(np.int64)) for x in sums)], names=[*kept.schema.names, "n_best", "count_sum"])

    return rows.mapInArrow(add, f"doc_id long, {_SHAPE}, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, bound: int = BROADCAST_PAIRS, **columns: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every document."""
    tables = Scratch(docs.sparkSession, "alignment")
    rows = tables.table("rows", aligned(docs, a_path, b_path, **columns))
    return summed(tables, rows, tables.table("counts", counted(rows)), bound)
