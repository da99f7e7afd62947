"""Helpers shared by the text operators: Arrow batches in, numpy views of their words out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Bytes 0x20 and 0x09-0x0D part words; everything else belongs to one.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def columns(documents, *names: str):
    """The named columns only, so that extra columns of any name do no harm."""
    return documents.select(*names)


def text_slices(batches: Iterable[pa.RecordBatch], max_bytes: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Cut batches whose last column is text so that each slice has about max_bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += int(n)
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column, null as empty; offsets start at 0."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words_before): byte spans of all words, and how many words come before each text."""
    inside = ~_IS_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            base, inverse = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
            base[0] = inverse[0] = 1
            self.up, self.down = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int = 64) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each run, equal for equal runs of one type of values wherever they stand.

    Runs of up to `longest` values go by a polynomial, which two long sequences could be made to share; longer ones by XXH64 of their bytes.
    """
    up, down = _POWERS.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    out = mix((total[ends] - total[starts]) * down[starts] + mix(length + np.uint64(0x2545F4914F6CDD1D)))
    for k in np.flatnonzero(ends - starts > longest):
        out[k] = xxhash.xxh64_intdigest(values[starts[k] : ends[k]].tobytes())
    return out
