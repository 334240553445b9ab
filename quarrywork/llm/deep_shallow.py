"""Deep-shallow sorting of suffixes by their first bytes.

``Block(raw, starts, length)`` orders suffixes by ``length`` bytes.  Multikey quicksort, with eight bytes as
one character, splits them around pivots to ``SHALLOW`` bytes; segments of up to ``SMALL`` suffixes are
sorted by the array instead, one character at a time.  Suffixes that still agree go, group by group, into
a blind trie: an inner node holds only the first bit in which its two sides differ, a descent looks at
these bits alone, and one comparison with the leaf it ends in gives the place of the new suffix.
"""

from __future__ import annotations

import numpy as np

SHALLOW, SMALL = 32, 1 << 15


class Block:
    """``order``: the suffixes (places in ``starts``) in ascending order; ``first``: for each place of the
    order, where the run of suffixes begins that are equal in ``length`` bytes."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, length: int):
        self.starts, self.length, self.shallow = starts, length, min(SHALLOW, length)
        padded = np.zeros(len(raw) + SHALLOW + 8, np.uint8)
        padded[: len(raw)] = raw
        self.lanes = np.ndarray((len(raw) + SHALLOW,), ">u8", buffer=padded, strides=(1,))
        self.text = padded.tobytes()
        self.order, self.first = np.arange(len(starts)), np.arange(len(starts))
        self._multikey()

    def _key(self, which: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes at a depth, without those beyond the shallow depth."""
        key = self.lanes[self.starts[which] + depth].astype(np.uint64)
        over = depth + 8 - self.shallow
        return key >> np.uint64(8 * over) if over > 0 else key

    def _multikey(self) -> None:
        todo = [(0, len(self.starts), 0)]
        while todo:
            lo, hi, depth = todo.pop()
            if hi - lo < 2:
                continue
            if depth >= self.shallow:
                self._deep(lo, hi)
            elif hi - lo <= max(SMALL, 255):
                self._sort(lo, hi, depth)
            else:
                own = self.order[lo:hi]
                key = self._key(own, depth)
                sample = np.sort(key[:: len(key) // 255])
                pivot = sample[len(sample) // 2]
                less, more = key < pivot, key > pivot
                same = ~(less | more)
                a, b = lo + int(less.sum()), hi - int(more.sum())
                self.order[lo:hi] = np.concatenate([own[less], own[same], own[more]])
                todo += [(lo, a, depth), (a, b, depth + 8), (b, hi, depth)]

    def _sort(self, lo: int, hi: int, depth: int) -> None:
        """A small segment, character by character; what is alone in its run is left out of the next."""
        place, run = np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        while depth < self.shallow and len(place):
            own = self.order[place]
            key = self._key(own, depth)
            by = np.lexsort((key, run))
            self.order[place], key, run = own[by], key[by], run[by]
            new = np.append(True, (key[1:] != key[:-1]) | (run[1:] != run[:-1]))
            alone = new & np.append(new[1:], True)
            run = np.cumsum(new)
            place, run = place[~alone], run[~alone]
            depth += 8
        if len(place):
            begins = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(place)]):
                self._deep(int(place[a]), int(place[a]) + b - a)

    def _deep(self, lo: int, hi: int) -> None:
        """Suffixes that agree to the shallow depth, by a blind trie."""
        own = self.order[lo:hi].tolist()
        skip, upto, text = self.shallow, self.length, self.text
        at = self.starts[self.order[lo:hi]].tolist()
        if upto <= skip:
            self.first[lo:hi] = lo
            return
        words = [text[s + skip : s + upto] for s in at]
        top = 8 * (upto - skip) - 1
        number = int.from_bytes
        # A leaf is (word, number, members); an inner node [byte, mask, side of 0, side of 1].
        root: tuple | list = (words[0], number(words[0], "big"), [own[0]])
        for word, who in zip(words[1:], own[1:]):
            node = root
            while type(node) is list:
                node = node[3 if word[node[0]] & node[1] else 2]
            if node[0] == word:
                node[2].append(who)
                continue
            value = number(word, "big")
            bit = top - ((value ^ node[1]).bit_length() - 1)
            byte, mask = bit >> 3, 128 >> (bit & 7)
            above, side, node = None, 0, root
            while type(node) is list and (node[0] < byte or node[0] == byte and node[1] > mask):
                above, side = node, 3 if word[node[0]] & node[1] else 2
                node = node[side]
            leaf = (word, value, [who])
            new = [byte, mask, node, leaf] if word[byte] & mask else [byte, mask, leaf, node]
            if above is None:
                root = new
            else:
                above[side] = new
        out, first, todo = [], [], [root]
        while todo:
            node = todo.pop()
            if type(node) is list:
                todo += [node[3], node[2]]
            else:
                first += [lo + len(out)] * len(node[2])
                out += node[2]
        self.order[lo:hi], self.first[lo:hi] = out, first
