"""A compressed FM-index over word ids: a wavelet matrix with packed bits, backward search in lanes, and capped matching statistics."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence, one packed bit vector for each bit of the alphabet."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        n = len(values)
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit.astype(bool), bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8").astype(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            self.zeros.append(int(n - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        symbols = np.arange(1 << bits)
        self.start = self.follow(symbols, np.zeros(len(symbols), np.int64))

    def follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position ends up below the last level on the path of a symbol."""
        for k in range(self.bits):
            block = at >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbols >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self.follow(symbols, at) - self.start[symbols]


class FmIndex:
    """The index of one shard's texts (word ids from 1; 0 parts the texts), for patterns of up to `width` words.

    Suffixes are sorted by their first 32 words, which is all that backward search for up to 31 words depends on.
    """

    def __init__(self, text: np.ndarray, width: int) -> None:
        if not 1 <= width <= 31:
            raise ValueError("a pattern has 1 to 31 words")
        self.width, self.n = width, len(text)
        ranks, have = {1: text.astype(np.int64)}, 1
        while have < 32:
            ranks[2 * have] = self._join(ranks[have], ranks[have], have)
            have *= 2
        order = np.argsort(ranks[32], kind="stable")
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(text.max(initial=0)).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.wavelet.bits))])
        self.order = order
        # Classes of rows that share their first `width` words: what a match belongs to.
        own = self._prefix(ranks, width)[order]
        self.heads = np.flatnonzero(np.diff(own, prepend=-1))
        self.class_of_row = np.cumsum(np.diff(own, prepend=-1) != 0) - 1
        # Intervals of rows that share one word less: what a match is cut back to before the next word comes in front.
        less = self._prefix(ranks, width - 1)[order] if width > 1 else np.zeros(len(order), np.int64)
        heads = np.flatnonzero(np.diff(less, prepend=-1))
        row = np.cumsum(np.diff(less, prepend=-1) != 0) - 1
        self.low, self.high = heads[row], np.append(heads[1:], self.n)[row]

    def _prefix(self, ranks: dict[int, np.ndarray], words: int) -> np.ndarray:
        """Ranks of suffixes by their first so many words, put together from those by powers of two."""
        out, done = None, 0
        for power in (16, 8, 4, 2, 1):
            if words & power:
                out = ranks[power] if out is None else self._join(out, ranks[power], done)
                done += power
        return out

    def _join(self, left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        """Dense ranks of left[i] followed by right[i + shift]; nothing follows the end."""
        after = np.zeros(len(right), np.int64)
        after[: max(0, len(right) - shift)] = right[shift:] + 1
        return np.unique(left * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of each pattern with a word put in front."""
        return self.first[symbols] + self.wavelet.rank(symbols, lo), self.first[symbols] + self.wavelet.rank(symbols, hi)

    def find(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the `width` words that end before each of these places, from nothing."""
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for k in range(1, self.width + 1):
            lo, hi = self.extend(text[ends - k], lo, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def stream(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each place of text the class of the `width` words from there on, or -1 where the index holds them nowhere.

        Texts run side by side from right to left. A match loses its last word (an interval known for every row) and gains the word in front of it, so each
        place costs one step of backward search; where a match is lost, the next place is searched anew.
        """
        out = np.full(len(text), -1, np.int64)
        lanes = np.flatnonzero(ends - starts >= self.width)
        lanes = lanes[np.argsort(starts[lanes] - ends[lanes], kind="stable")]
        at = ends[lanes] - self.width
        lo, hi = self.find(text, ends[lanes])
        while len(lanes):
            found = hi > lo
            row = np.minimum(lo, self.n - 1)
            out[at[found]] = self.class_of_row[row][found]
            lo, hi = np.where(found, self.low[row], 0), np.where(found, self.high[row], 0)
            more = at > starts[lanes]
            lanes, at, lo, hi, found = lanes[more], at[more] - 1, lo[more], hi[more], found[more]
            if not len(lanes):
                break
            lo, hi = self.extend(text[at], lo, hi)
            if not found.all():
                lost = np.flatnonzero(~found)
                lo[lost], hi[lost] = self.find(text, at[lost] + self.width)
        return out

    def least_of_class(self, value: np.ndarray) -> np.ndarray:
        """For each class the least value[p] of the places p that it has in the indexed text."""
        return np.minimum.reduceat(value[self.order], self.heads) if self.n else np.zeros(0, value.dtype)
