"""Token ids by the ``tokenizers`` library, with each distinct part of a text encoded once per worker.

A byte-level tokenizer never joins across a single space between two characters that are not white
space (the space opens the next piece), nor across a single line feed there (a piece of its own), nor
from an ASCII letter or digit to an ASCII mark.  So a text may be cut at these places, and its ids are
the ids of its parts.  Cuts are found on Arrow's buffers; no Python string is made for a part.

Parts of up to ``LONGEST`` bytes are kept in a table: open addressing by a 64-bit hash, the bytes of
every hit compared, ids in one array.  Unseen parts are encoded together, joined in one text and cut
apart again by the tokens' lengths in bytes.  The table holds some ``WORDS_KEPT`` parts (about 50
bytes each); beyond that it keeps those that were met again.  Longer parts, and texts that spell an
added token, are encoded as they are.  ``tests/llm`` holds all this against encoding whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordhash import mix, slices

#: Parts that are kept before those not met again are dropped.
WORDS_KEPT = 1 << 21
LONGEST = 64
#: Unseen parts that are encoded as one text.
_JOIN = 2000

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of the characters among which Unicode's other white space is: no cut beside these.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
for _c in range(33, 127):
    (_ALNUM if chr(_c).isalnum() else _MARK)[_c] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHARED: dict[tuple[str, int], "Encoder"] = {}


def shared_encoder(path: str, words_kept: int = WORDS_KEPT) -> "Encoder":
    """One encoder for each Python worker: later tasks find the parts that earlier ones have met."""
    if (path, words_kept) not in _SHARED:
        _SHARED[path, words_kept] = Encoder(path, words_kept)
    return _SHARED[path, words_kept]


def _closed(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each byte position is surely no white space."""
    one = raw[at - 1]
    wide = (one >= 0x80) & ((raw[np.maximum(at - 2, 0)] == 0xC2) | _WIDE[raw[np.maximum(at - 3, 0)]])
    return ~_WHITE[one] & ~wide


def _open(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character after each byte position is surely no white space."""
    one = raw[np.minimum(at + 1, len(raw) - 1)]
    return ~_WHITE[one] & ~_WIDE[one]


def part_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the parts of all texts begin; every text that is not empty begins one."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = edge[:-1].copy()
    gap = np.flatnonzero((raw == 32) | (raw == 10))
    gap = gap[~edge[gap] & ~edge[gap + 1]]
    begins[gap[_closed(raw, gap) & _open(raw, gap)]] = True
    mark = np.flatnonzero(_MARK[raw])
    mark = mark[~edge[mark]]
    begins[mark[_ALNUM[raw[mark - 1]]]] = True
    return np.flatnonzero(begins)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number (views the padded bytes)."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", buffer=padded, strides=(1,))


def _hashes(lanes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of byte runs of up to ``LONGEST`` bytes, from their eight-byte lanes."""
    with np.errstate(over="ignore"):
        h = mix((lanes[first] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _MUL)
        some = np.flatnonzero(size > 8)
        for k in range(8, LONGEST, 8):
            if not len(some):
                break
            h[some] = mix(h[some] * _MUL ^ (lanes[first[some] + k] & _MASK[np.minimum(size[some] - k, 8)]))
            some = some[size[some] > k + 8]
    return h


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1024, kind), 0

    def append(self, more: np.ndarray) -> None:
        self.room(len(more))
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)

    def room(self, more: int) -> None:
        if self.n + more > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(more, self.n // 2) + 1024, self.data.dtype)])

    def now(self) -> np.ndarray:
        return self.data[: self.n]


class Encoder:
    """``flat(column)``: the ids of a column's texts in flat arrays; ``ids(texts)``: as bytes."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kept = words_kept
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.lengths = np.array([len(self.model.id_to_token(i) or "") for i in range(self.model.get_vocab_size())], dtype=np.int64)
        self._clear()

    def _clear(self) -> None:
        self.key, self.met = _Grown(np.uint64), _Grown(bool)
        self.text, self.text_at, self.text_n = _Grown(np.uint8), _Grown(np.int64), _Grown(np.uint8)
        self.out, self.out_at, self.out_n = _Grown(np.uint16 if len(self.lengths) <= 1 << 16 else np.uint32), _Grown(np.int64), _Grown(np.uint8)
        self.slots = np.full(1 << 12, -1, np.int32)
        self.text.append(np.zeros(8, np.uint8))  # lanes of the last part may read on

    # The table ---------------------------------------------------------------------------------------

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        slot = self._slot(h)
        entry = self.slots[slot].astype(np.int64)
        some = np.flatnonzero((entry >= 0) & (self.key.data[entry] != h))
        while len(some):
            slot[some] = (slot[some] + 1) & (len(self.slots) - 1)
            entry[some] = self.slots[slot[some]]
            at = entry[some]
            some = some[(at >= 0) & (self.key.data[at] != h[some])]
        return entry

    def _place(self, entries: np.ndarray) -> None:
        slot = self._slot(self.key.data[entries])
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _drop_unmet(self) -> None:
        """Keeps the parts that were met again since they were learnt; none, where these are too many."""
        stay = np.flatnonzero(self.met.now())
        if 4 * len(stay) > 3 * self.kept:
            stay = stay[:0]
        key, size, count = self.key.now()[stay], self.text_n.now()[stay], self.out_n.now()[stay]
        text = self.text.data[_spread(self.text_at.now()[stay], size.astype(np.int64))]
        out = self.out.data[_spread(self.out_at.now()[stay], count.astype(np.int64))]
        self._clear()
        self._add(key, text, size.astype(np.int64), out, count.astype(np.int64))

    def _add(self, key: np.ndarray, text: np.ndarray, size: np.ndarray, out: np.ndarray, count: np.ndarray) -> None:
        first, self.text.n = self.key.n, self.text.n - 8  # the padding moves to the end
        self.text_at.append(self.text.n + np.cumsum(size) - size), self.out_at.append(self.out.n + np.cumsum(count) - count)
        self.text.append(text), self.text.append(np.zeros(8, np.uint8)), self.out.append(out)
        self.key.append(key), self.met.append(np.zeros(len(key), bool)), self.text_n.append(size), self.out_n.append(count)
        if 2 * self.key.n > len(self.slots):
            self.slots = np.full(1 << int(2 * self.key.n).bit_length(), -1, np.int32)
            first = 0
        self._place(np.arange(first, self.key.n))

    def _same(self, entry: np.ndarray, lanes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes of each entry are those of the run."""
        own = np.ndarray((self.text.n - 7,), "<u8", buffer=self.text.data, strides=(1,))
        at = self.text_at.data[entry]
        same = self.text_n.data[entry] == size
        some = np.flatnonzero(same)
        for k in range(0, LONGEST, 8):
            if not len(some):
                break
            same[some] = ((lanes[first[some] + k] ^ own[at[some] + k]) & _MASK[np.minimum(size[some] - k, 8)]) == 0
            some = some[same[some] & (size[some] > k + 8)]
        return same

    # Encoding ----------------------------------------------------------------------------------------

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, raw: np.ndarray, h: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Encodes distinct parts and adds them to the table."""
        # Parts that open with a cut and end in no white space may stand next to each other in a text.
        joined = ((raw[first] == 32) | (raw[first] == 10)) & (size > 1) & _open(raw, first) & _closed(raw, first + size)
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        h, first, size, joined = h[order], first[order], size[order], int(joined.sum())
        text = raw[_spread(first, size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = text.tobytes()
        cuts = [*range(0, joined, _JOIN), joined]
        found = self._whole([data[ends[a] : ends[b]].decode() for a, b in zip(cuts, cuts[1:])])
        ids = np.array([i for x in found for i in x], np.int64)
        upto = np.searchsorted(np.cumsum(self.lengths[ids]), ends[1 : joined + 1]) + 1
        single = self._whole([data[ends[k] : ends[k + 1]].decode() for k in range(joined, len(h))])
        count = np.concatenate([np.diff(upto, prepend=0), np.array([len(x) for x in single], np.int64)])
        self._add(h, text, size, np.concatenate([ids, np.array([i for x in single for i in x], np.int64)]), count)

    def flat(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, offsets): bounded runs of rows, each row's ids and, where
        given, ``end_id`` behind them.  Nulls are empty texts."""
        for a, b, raw, offsets in slices(pc.fill_null(column, "")):
            yield a, b, *self._encode(raw, offsets, end_id)

    def _spelt(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose texts spell an added token."""
        data = raw.tobytes()
        if not any(x in data for x in self.added):
            return np.empty(0, np.int64)
        return np.array([k for k in range(len(offsets) - 1) if any(x in data[offsets[k] : offsets[k + 1]] for x in self.added)], np.int64)

    def _encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        rows, tail = len(offsets) - 1, int(end_id is not None)
        if self.key.n > self.kept:
            self._drop_unmet()
        first = part_starts(raw, offsets) if len(raw) else np.empty(0, np.int64)
        spelt = self._spelt(raw, offsets)
        if len(spelt):
            row = np.searchsorted(offsets, first, side="right") - 1
            first = first[~np.isin(row, spelt) | np.isin(first, offsets)]
        size = np.diff(first, append=len(raw))
        entry = np.full(len(first), -1, np.int64)
        short = size <= LONGEST
        if len(spelt):
            short &= ~np.isin(np.searchsorted(offsets, first, side="right") - 1, spelt)
        if short.any():
            lanes = _lanes(raw)
            at = np.flatnonzero(short)
            f, n = first[at], size[at]
            h = _hashes(lanes, f, n)
            got = self._find(h)
            new = np.flatnonzero(got < 0)
            if len(new):
                _, one = np.unique(h[new], return_index=True)
                one = new[one]
                self._learn(raw, h[one], f[one], n[one])
                got = self._find(h)
            again = np.ones(len(h), bool)
            if len(new):
                again[one] = False
            # What has the hash of another part is encoded on its own.
            got[~self._same(got, lanes, f, n)] = -1
            self.met.data[got[again & (got >= 0)]] = True
            entry[at] = got
        before = np.searchsorted(first, offsets)
        place = np.arange(len(first)) + tail * np.repeat(np.arange(rows), np.diff(before))
        count, source = np.full(len(first) + tail * rows, tail, np.int64), np.zeros(len(first) + tail * rows, np.int64)
        known = entry >= 0
        count[place[known]], source[place[known]] = self.out_n.data[entry[known]], self.out_at.data[entry[known]]
        odd = np.flatnonzero(~known)
        if len(odd):
            found = self._whole([raw[first[k] : first[k] + size[k]].tobytes().decode() for k in odd])
            sizes = np.array([len(x) for x in found], np.int64)
            # Behind the table's ids, without becoming part of it.
            self.out.room(int(sizes.sum()))
            self.out.data[self.out.n : self.out.n + int(sizes.sum())] = [i for x in found for i in x]
            count[place[odd]], source[place[odd]] = sizes, self.out.n + np.cumsum(sizes) - sizes
        ids = self.out.data[_spread(source, count)].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(count)])
        if tail:
            last = before[1:] + np.arange(rows)
            ids[ends[last]] = end_id
            return ids, np.concatenate([[0], ends[last + 1]])
        return ids, ends[before]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for _, _, ids, ends in self.flat(pa.array(texts, pa.string())):
            raw = ids.tobytes()
            out += [raw[4 * i : 4 * j] for i, j in zip(ends.tolist(), ends[1:].tolist())]
        return out
