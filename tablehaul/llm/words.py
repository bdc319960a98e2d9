"""Words of many texts at once, as numpy arrays.

A word is a longest run of bytes other than space, tab, LF, VT, FF and CR. Hashes are
polynomial in 64-bit arithmetic with odd bases, so any run of words has a hash that
is had from two prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BYTE_BASE = 0x9E3779B97F4A7C15
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)  # one for each independent run hash


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: Bytes that are widened to 64 bits at once; powers of a base that are kept.
PIECE, KEPT_POWERS = 1 << 18, 1 << 19
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base; the longest list so far is kept."""
    kept = _TABLES.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, dtype=np.uint64, out=kept)
        if n <= KEPT_POWERS:
            _TABLES[base] = kept
    return kept[:n]


class Words:
    """The words of a column of texts; nulls have none.

    ``hashes[i]`` is the hash of word i, ``doc[i]`` its row, ``first[d]:first[d + 1]`` the
    words of row d; ``start`` and ``end`` are byte offsets in ``data``.
    """

    def __init__(self, texts: pa.Array, fold: np.ndarray | None = None):
        """fold: 256 bytes that stand for the text's bytes, for comparing without case or punctuation."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        if fold is not None:
            self.data = fold[self.data]
        self.row_at = offsets - offsets[0]
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        word = ~blank
        # A word starts where a word byte follows a blank or begins a row, and ends likewise.
        starts, ends = word.copy(), word.copy()
        if len(word):
            inner = self.row_at[:-1][np.diff(self.row_at) > 0]
            begins = np.zeros(len(word), dtype=bool)
            begins[inner] = True
            starts[1:] &= blank[:-1] | begins[1:]
            ends[:-1] &= blank[1:] | begins[1:]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.row_at)
        self.rows = len(texts)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.count)
        self.hashes = self._hash_words()

    def _hash_words(self) -> np.ndarray:
        """Piece by piece: a piece is whole words, or a part of one that is longer."""
        out = np.zeros(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            begin = int(self.start[at])
            stop = int(np.searchsorted(self.end, begin + PIECE, "right"))
            if stop == at:
                out[at], at = self._long_word(begin, int(self.end[at])), at + 1
                continue
            bytes_ = self.data[begin : self.end[stop - 1]].astype(np.uint64) + np.uint64(1)
            out[at:stop] = Prefix(bytes_, _BYTE_BASE).run(self.start[at:stop] - begin, self.end[at:stop] - begin)
            at = stop
        return mix(out + (self.end - self.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def _long_word(self, begin: int, end: int) -> int:
        total = 0
        for at in range(begin, end, PIECE):
            bytes_ = self.data[at : min(at + PIECE, end)].astype(np.uint64) + np.uint64(1)
            part = int(np.sum(bytes_ * _powers(_BYTE_BASE, len(bytes_)), dtype=np.uint64))
            total += part * pow(_BYTE_BASE, at - begin, 1 << 64)
        return total % (1 << 64)

    def prefix(self, which: int = 0) -> Prefix:
        return Prefix(self.hashes, BASES[which])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each row's whole word sequence."""
        out = []
        for which in (0, 1):
            p = self.prefix(which)
            out.append(mix(p.run(self.first[:-1], self.first[1:]) + self.count.astype(np.uint64)))
        return out[0], out[1]

    def row_words(self, d: int) -> list[bytes]:
        return self.data[self.row_at[d] : self.row_at[d + 1]].tobytes().split()


class Prefix:
    """Prefix sums from which the hash of any run of words follows."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum(hashes * _powers(base, n), dtype=np.uint64, out=self.sums[1:])
        self.inverse = _powers(pow(base, -1, 1 << 64), n + 1)

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of words start..end-1, the same wherever the run stands."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
