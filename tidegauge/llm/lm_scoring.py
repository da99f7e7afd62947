"""Language-model scores from a log-frequency Bloom filter.

Training counts words and pairs of neighbouring words in Spark, all training texts whole: every task counts what it has read, the counts meet by blocks of hashes, and
each block is finished on its own. Counts are quantised as q = 1 + floor(2 log2 c), and an n-gram of level q is put into the filter q times, once for each level up to it. A probe asks for
level 1, 2, ... until one is missing. All words and pairs of training are in the filter, which grows with them: it is a table of blocks of hashes in the shared folder. The levels that the
filter gives for the most frequent n-grams, at most max_broadcast of them, go to every worker; all other probes go to their blocks by a shuffle, one row of packed keys for each slice of
text and block, and come back as a byte each. A filter of at most max_filter bytes can be sent whole instead. Both ways read the same bits and give the same scores.

The base score is that of exact word counts: those of the most frequent words, at most max_broadcast of them, go to every worker, and the rest of each text's words
are joined, once for each text, to the table of counts by a shuffle, but for words that the filter lacks, which training hasn't. Words are told apart by a 64-bit hash.

Null and empty texts are the end token alone. Repeated rows are scored each. Rows without doc_id count as training, having no number to hold them out by. Very long texts
are scored whole. With no training token at all, N and V are 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import mix, run_hashes, text_buffer, text_slices, word_spans
from tidegauge.llm.shared import largest, materialise

#: The end token; also what stands before the first word.
END = np.uint64(0xE4D0E4D0E4D0E4D1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, contexts, first): hashes of all tokens of all texts, each text closed by END; the token before each; and where each text begins."""
    data, offsets = text_buffer(column)
    starts, ends, before = word_spans(data, offsets)
    n = len(offsets) - 1
    first = before + np.arange(n + 1)
    tokens = np.full(len(starts) + n, END)
    own = np.ones(len(tokens), bool)
    own[first[1:] - 1] = False
    tokens[own] = run_hashes(_LOWER[data], starts, ends)
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[first[:-1]] = END
    return tokens, contexts, first


def pair_hash(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(contexts * _PAIR + tokens)


def word_hash(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ _ONE)


def code_of(hashed: np.ndarray, bits: int) -> np.ndarray:
    """An n-gram in the filter: its block above 40 bits, of which the lower 8 are zero, so that a key takes 4 bytes."""
    return (hashed >> np.uint64(24 - bits)) & ~np.uint64(0xFF)


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed: of small numbers most planes are empty."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _widened(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_sorted(x: np.ndarray) -> bytes:
    """Ascending keys as the steps between them."""
    return _squeezed(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_widened(raw, "<u8"), dtype=np.uint64)


PAIRS, WORDS = 1, 2


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray, high: int) -> Iterator[tuple]:
    """Rows (kind, block, keys, counts) of sorted keys, cut by their high bits."""
    blocks = (keys >> np.uint64(high)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield kind, int(blocks[a]), _pack_sorted(keys[a:b] - (keys[a] >> np.uint64(high) << np.uint64(high))), _squeezed(counts[a:b].astype("<u4"))


def count_ngrams(texts: DataFrame, bits: int, hashes: int = 3, bits_per_entry: int = 10, together: int = 1_500_000) -> DataFrame:
    """kind, block, data, keys, counts, n_keys, total by 2**bits blocks of words and of pairs: each block's part of the filter, as large as its entries need, from all its counts.

    Keys and counts are those of all words, under the block's number, and of the pairs seen twice or more: the rest of the pairs live in the filter alone.
    A task counts about `together` tokens at a time.
    """
    schema = "kind int, block int, keys binary, counts binary"

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, k, high in ((WORDS, 0, 64 - bits), (PAIRS, 1, 40)):
            rows = list(_rows(kind, *np.unique(np.concatenate([h[k] for h in held]), return_counts=True), high))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "block", "keys", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in text_slices(batches, 1 << 20):
            tokens, contexts, _ = token_runs(batch.column(0))
            held.append((word_hash(tokens), code_of(pair_hash(contexts, tokens), bits)))
            if sum(len(t) for t, _ in held) >= together:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        kind, block = int(group["kind"].iloc[0]), int(group["block"].iloc[0])
        keys = np.concatenate([_unpack_sorted(x) for x in group["keys"]])
        counts = np.concatenate([_widened(x, "<u4") for x in group["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        keys, counts = keys[heads], np.add.reduceat(counts, heads)
        size = -(-max(64, int(levels(counts).sum()) * bits_per_entry) // 64) * 64
        data = Filter.block(block_keys(kind, keys, bits), counts, hashes, size)
        kept = np.ones(len(keys), bool) if kind == WORDS else counts > 1
        row = (kind, block, data, _pack_sorted(keys[kept]), _squeezed(counts[kept]), len(keys), int(counts.sum()))
        return pd.DataFrame([row], columns=["kind", "block", "data", "keys", "counts", "n_keys", "total"])

    return texts.select("text").mapInArrow(count, schema).groupBy("kind", "block").applyInPandas(add, "kind int, block int, data binary, keys binary, counts binary, n_keys long, total long")


def block_keys(kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """What the filter of a block holds for keys as they are counted: words have more bits than it takes."""
    return code_of(keys, bits) if kind == WORDS else keys


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(counts) + 1e-9).astype(np.int64)


# The least and the largest whole count of each level, and their middle; where a level holds none, the least above it.
_LOW = np.array([0.0] + [float(math.ceil(2 ** ((q - 1) / 2) - 1e-9)) for q in range(1, 128)])
_HIGH = np.maximum(_LOW, [0.0] + [float(math.ceil(2 ** (q / 2) - 1e-9) - 1) for q in range(1, 128)])
_MIDDLE = np.array([0.0] + [(math.ceil(2 ** ((q - 1) / 2) - 1e-9) + max(math.ceil(2 ** (q / 2) - 1e-9) - 1, math.ceil(2 ** ((q - 1) / 2) - 1e-9))) / 2 for q in range(1, 128)])


class Filter:
    """The log-frequency Bloom filter: blocks of equal size in one array of bits."""

    def __init__(self, block_bits: int, bits: int, hashes: int, data: np.ndarray) -> None:
        self.block_bits, self.bits, self.hashes, self.data = block_bits, bits, hashes, data

    @staticmethod
    def positions(keys: np.ndarray, level: int, hashes: int, block_bits: int | np.ndarray) -> np.ndarray:
        """Bits of n-grams in their block, of under 2**32 bits, at a level; keys are the 40 bits under the block's number."""
        seed, half = mix(keys + np.uint64((level << 48) + 0x5851F42D4C957F2D)), np.uint64(32)
        step = (seed << half) | (seed >> half) | np.uint64(1)
        size = np.asarray(block_bits, np.uint64)
        return np.stack([(((seed + np.uint64(i) * step) >> half) * size) >> half for i in range(hashes)])

    @classmethod
    def block(cls, keys: np.ndarray, counts: np.ndarray, hashes: int, block_bits: int) -> bytes:
        out, q = np.zeros(block_bits // 8, np.uint8), levels(counts) if len(counts) else counts
        for level in range(1, int(q.max(initial=0)) + 1):
            at = cls.positions(keys[q >= level], level, hashes, block_bits).reshape(-1)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return out.tobytes()

    def level(self, hashed: np.ndarray) -> np.ndarray:
        """The highest level at which every probe up to it finds the n-gram."""
        code = hashed >> np.uint64(24 - self.bits)
        base, keys = (code >> np.uint64(40)) * np.uint64(self.block_bits), code & np.uint64((1 << 40) - 1)
        out, left = np.zeros(len(hashed), np.int64), np.arange(len(hashed))
        for level in range(1, 128):
            at = self.positions(keys[left], level, self.hashes, self.block_bits) + base[left]
            found = np.ones(len(left), bool)
            for p in at:
                found &= (self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[found]
            if not len(left):
                break
            out[left] = level
        return out

    def count(self, hashed: np.ndarray) -> np.ndarray:
        """The middle of the counts of a level; zero where level 1 is missing. Equal n-grams are probed once."""
        keys, back = np.unique(hashed, return_inverse=True)
        q = self.level(keys)
        return np.where(q > 0, _MIDDLE[q], 0.0)[back]


def fine_levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(8 * np.log2(counts)).astype(np.int64)


def level_counts(counted: DataFrame) -> np.ndarray:
    """How many n-grams there are of each fine level, of those whose counts are kept."""

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.zeros(512, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                by += np.bincount(fine_levels(_widened(raw, "<i8")), minlength=512)
        yield pa.record_batch([pa.array(range(512), pa.int32()), pa.array(by)], names=["level", "n"])

    out = np.zeros(512, np.int64)
    for r in counted.select("counts").mapInArrow(sizes, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


def block_levels(data: bytes, keys: np.ndarray, bits: int, hashes: int = 3) -> np.ndarray:
    """Levels that a block's bits give for keys under its number."""
    return Filter(8 * len(data), bits, hashes, np.frombuffer(data, np.uint8)).level(keys << np.uint64(24 - bits))


def frequent_levels(counted: DataFrame, bits: int, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind, the sorted codes (block and key) of the `most` most frequent n-grams and the levels that the filter gives for them."""
    of_level = level_counts(counted)
    cut = next((k for k in range(512) if of_level[k:].sum() <= most), 512)

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, block, data, raw_keys, raw_counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = _unpack_sorted(raw_keys)[fine_levels(_widened(raw_counts, "<i8")) >= cut]
                if len(keys):
                    keys = np.unique(block_keys(kind, keys, bits))
                    row = (kind, _pack_sorted(keys + (np.uint64(block) << np.uint64(40))), block_levels(data, keys, bits).astype(np.int8).tobytes())
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "codes", "levels"])

    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {PAIRS: [], WORDS: []}
    for r in counted.select("kind", "block", "data", "keys", "counts").mapInArrow(pick, "kind int, codes binary, levels binary").toLocalIterator():
        held[r["kind"]].append((_unpack_sorted(bytes(r["codes"])), np.frombuffer(bytes(r["levels"]), np.int8)))
    out = {}
    for kind, some in held.items():
        codes = np.concatenate([np.zeros(0, np.uint64), *(c for c, _ in some)])
        found = np.concatenate([np.zeros(0, np.int8), *(q for _, q in some)])
        order = np.argsort(codes)
        out[kind] = codes[order], found[order]
    return out


def known_levels(codes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The level of each n-gram, -1 where it isn't among the frequent ones."""
    known, found = frequent
    if not len(known):
        return np.full(len(codes), -1, np.int8)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, found[at], np.int8(-1))


def log_shares(of_word: np.ndarray, of_context: np.ndarray, of_pair: np.ndarray, mass: float, backoff: float) -> np.ndarray:
    """log10 of the pair's share of its context and the smoothed share of the word, from levels.

    Counts above are the least of their level and those below the largest, so that the shares of a context's words, an unknown one included, add up to at most 1, but for what the filter finds
    by chance. Behind a context that training lacks the word's share stands alone.
    """
    word, context = (_LOW[of_word] + 0.1) / mass, _HIGH[of_context]
    pair = np.minimum(_LOW[of_pair], context) / np.maximum(1.0, context)
    return np.log10(np.minimum(np.where(context > 0, (1 - backoff) * pair + backoff * word, word), 1.0))


class Whole:
    """All blocks of one kind in one array, each with a size of its own."""

    def __init__(self, blocks: list[tuple[int, bytes]], bits: int, hashes: int = 3) -> None:
        self.bits, self.hashes = bits, hashes
        self.base, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.there = np.zeros(1 << bits, bool)
        at = 0
        for block, data in blocks:
            self.base[block], self.size[block], self.there[block] = at, 8 * len(data), True
            at += 8 * len(data)
        self.data = np.frombuffer(b"".join([*(data for _, data in blocks), b"\0"]), np.uint8)

    def level(self, codes: np.ndarray) -> np.ndarray:
        """The highest level at which every probe up to it finds the n-gram, by its block and key."""
        block, keys = (codes >> np.uint64(40)).astype(np.int64), codes & np.uint64((1 << 40) - 1)
        out, left = np.zeros(len(codes), np.int8), np.flatnonzero(self.there[block])
        for level in range(1, 128):
            at = Filter.positions(keys[left], level, self.hashes, self.size[block[left]])
            found = np.ones(len(left), bool)
            for p in at + self.base[block[left]]:
                found &= (self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[found]
            if not len(left):
                break
            out[left] = level
        return out

    def fill(self, codes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """found with the levels where it has -1; equal n-grams are probed once."""
        lacking = np.flatnonzero(found < 0)
        keys, back = np.unique(codes[lacking], return_inverse=True)
        found[lacking] = self.level(keys)[back]
        return found


def whole_filter(blocks: DataFrame, bits: int) -> dict[int, Whole]:
    """The filter by kind, on the driver: for one whose size has been checked."""
    held: dict[int, list[tuple[int, bytes]]] = {PAIRS: [], WORDS: []}
    for r in blocks.select("kind", "block", "data").toLocalIterator():
        held[r["kind"]].append((r["block"], bytes(r["data"])))
    return {kind: Whole(some, bits) for kind, some in held.items()}


KINDS = (WORDS, PAIRS)
PLACES = (
    "row_id long, doc_id long, h long, times long, n_tokens long, n_known long, base_score double, score double, slice_id long, kind int, block int, keys binary, state array<binary>"
)
_ASKED, _SAME = -1, -2


def questions(codes: np.ndarray, found: np.ndarray) -> tuple[list[tuple[int, bytes]], list[bytes]]:
    """(block, keys) for the n-grams that found lacks, each asked once for a slice of text; and what answered() needs to put the answers into their places."""
    lacking = np.flatnonzero(found < 0)
    _, heads, back = np.unique(codes[lacking], return_index=True, return_inverse=True)
    same = np.ones(len(lacking), bool)
    same[heads] = False
    marked = found.copy()
    marked[lacking] = np.where(same, np.int8(_SAME), np.int8(_ASKED))
    asked = codes[lacking[~same]]
    blocks = (asked >> np.uint64(40)).astype("<u4")
    order = np.argsort(blocks, kind="stable")
    keys, sorted_blocks = ((asked[order] >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype("<u4"), blocks[order]
    cuts = np.flatnonzero(np.diff(sorted_blocks.astype(np.int64), prepend=-1))
    rows = [(int(sorted_blocks[a]), keys[a:b].tobytes()) for a, b in zip(cuts, [*cuts, len(keys)][1:], strict=True)]
    return rows, [_squeezed(marked), _squeezed(blocks), _squeezed(lacking[heads][back[same]].astype("<u4"))]


def answered(state: list[bytes], answers: list[tuple[int, bytes]]) -> np.ndarray:
    """The levels of all places from questions() and the answers by block."""
    found, blocks, same = (_widened(raw, kind) for raw, kind in zip(state, ("i1", "<u4", "<u4"), strict=True))
    out = found.copy()
    out[np.flatnonzero(found == _ASKED)[np.argsort(blocks, kind="stable")]] = np.frombuffer(b"".join(x for _, x in sorted(answers)), np.int8)
    out[found == _SAME] = out[same]
    return out


def context_levels(of_word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The level of the token before each; before the first stands END, as at the end of each text."""
    out = np.empty_like(of_word)
    out[1:] = of_word[:-1]
    out[first[:-1]] = of_word[first[1:] - 1]
    return out


def probe_scores(written: DataFrame, filter_blocks: DataFrame, bits: int, mass: float, backoff: float) -> DataFrame:
    """row_id, rare_score of all texts: questions go to their block of the filter, one row for each slice of text and block, and the answers, a byte each, back to the slice."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        raw = left.column("keys").to_pylist()
        ends = np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)
        data = right.column("data")[0].as_py() if right.num_rows else bytes(8)
        found = []
        # Many questions together, but not so many that their arrays leave the cache.
        for rows in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(ends // (1 << 16))) + 1):
            keys = np.frombuffer(b"".join(raw[i] for i in rows), "<u4").astype(np.uint64) << np.uint64(8)
            answer = block_levels(data, keys, bits).astype(np.int8)
            found += [x.tobytes() for x in np.split(answer, ends[rows][:-1] - (ends[rows[0] - 1] if rows.size and rows[0] else 0))] if rows.size else []
        return left.drop_columns(["keys"]).append_column("levels", pa.array(found, pa.binary()))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        answers: dict[int, list[tuple[int, bytes]]] = {kind: [] for kind in KINDS}
        for kind, block, found in zip(*(right.column(c).to_pylist() for c in ("kind", "block", "levels")), strict=True):
            answers[kind].append((block, found))
        for state in left.column("state").to_pylist():
            of_word, of_pair = (answered(state[2 + 3 * k : 5 + 3 * k], answers[kind]) for k, kind in enumerate(KINDS))
            first = np.concatenate([[0], np.cumsum(_widened(state[1], "<i8"))])
            shares = log_shares(of_word, context_levels(of_word, first), of_pair, mass, backoff)
            ids.append(_widened(state[0], "<i8"))
            scores.append(np.add.reduceat(shares, first[:-1]))
        return pa.table({"row_id": np.concatenate(ids), "rare_score": np.concatenate(scores)})

    asked = written.where("kind is not null").select("slice_id", "kind", "block", "keys").groupBy("kind", "block")
    answers = asked.cogroup(filter_blocks.select("kind", "block", "data").groupBy("kind", "block")).applyInArrow(probe, "slice_id long, kind int, block int, levels binary")
    states = written.where("state is not null").select("slice_id", "state").groupBy("slice_id")
    return states.cogroup(answers.groupBy("slice_id")).applyInArrow(finish, "row_id long, rare_score double")


def word_counts(counted: DataFrame, bits: int) -> DataFrame:
    """h, c of every training token."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.record_batch([pa.array((_unpack_sorted(keys) + (np.uint64(block) << np.uint64(64 - bits))).view(np.int64)), pa.array(_widened(counts, "<i8"))], names=["h", "c"])

    return counted.where(F.col("kind") == WORDS).select("block", "keys", "counts").mapInArrow(run, "h long, c long")


def lm_scores(documents: DataFrame, modulus: int = 10, keep: int = 0, backoff: float = 0.8, max_broadcast: int = 1 << 19, max_filter: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. A filter of at most max_filter bytes goes to the workers whole; by default none does, so that all sizes take one way."""
    spark = documents.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == keep, F.lit(False))
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # About 16 MB of text to a block, in whole bits.
    bits = min(24, max(4, math.ceil(math.log2(max(1, size / (16 << 20))))))
    counted = materialise(count_ngrams(documents.where(~held), bits), "filter")
    of_words = F.col("kind") == WORDS
    n, v, filter_size = counted.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.when(of_words, F.col("total")), F.when(of_words, F.col("n_keys")), F.length("data")))).first()
    mass = n + 0.1 * (v + 1)
    counts = materialise(word_counts(counted, bits), "word-counts")
    common = largest(counts, "c", max_broadcast).toArrow()
    keys, times = (common.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(keys)
    bounded = filter_size <= max_filter
    shared = spark.sparkContext.broadcast((frequent_levels(counted, bits, max_broadcast), whole_filter(counted, bits) if bounded else None, keys[order], times[order]))
    fields = spark.createDataFrame([], PLACES).schema
    arrow = {f.name: {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.list_(pa.binary())) for f in fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, whole, known, exact = shared.value

        def out(n: int, **given) -> pa.RecordBatch:
            """n rows of PLACES; columns that aren't given are null."""
            return pa.record_batch([given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in arrow.items()], names=list(arrow))

        for batch in text_slices(batches):
            tokens, contexts, first = token_runs(batch.column(2))
            rows, words = batch.num_rows, word_hash(tokens)
            codes = {WORDS: code_of(words, bits), PAIRS: code_of(pair_hash(contexts, tokens), bits)}
            of = {kind: known_levels(codes[kind], frequent[kind]) for kind in KINDS}
            score = np.zeros(rows)
            if whole:
                of = {kind: whole[kind].fill(codes[kind], of[kind]) for kind in KINDS}
                score = np.add.reduceat(log_shares(of[WORDS], context_levels(of[WORDS], first), of[PAIRS], mass, backoff), first[:-1])
            else:
                name, state = int(batch.column(0)[0].as_py()), [_squeezed(batch.column(0).to_numpy()), _squeezed(np.diff(first).astype("<i8"))]
                for kind in KINDS:
                    asked, more = questions(codes[kind], of[kind])
                    state += more
                    if asked:
                        yield out(len(asked), slice_id=np.full(len(asked), name), kind=np.full(len(asked), kind), block=[b for b, _ in asked], keys=[k for _, k in asked])
                yield out(1, slice_id=[name], state=[state])
            # The base: exact counts of common words here, the other words as rows of their own.
            at = np.minimum(np.searchsorted(known, words.view(np.int64)), max(0, len(known) - 1))
            hit = known[at] == words.view(np.int64) if len(known) else np.zeros(len(tokens), bool)
            base = np.add.reduceat(np.where(hit, np.log10((exact[at] if len(known) else np.zeros(1)) + 0.1) - math.log10(mass), 0.0), first[:-1])
            found = np.add.reduceat(hit.astype(np.int64), first[:-1])
            # Words of level 0 are none of training's; of the others a text's repeats are one row.
            none = np.flatnonzero(~hit & (of[WORDS] == 0))
            base += np.bincount(np.searchsorted(first, none, side="right") - 1, minlength=rows) * (math.log10(0.1) - math.log10(mass))
            yield out(rows, row_id=batch.column(0), doc_id=batch.column(1), times=np.zeros(rows, np.int64), n_tokens=np.diff(first), n_known=found, base_score=base, score=score)
            rest = np.flatnonzero(~hit & (of[WORDS] != 0))
            owner = np.searchsorted(first, rest, side="right") - 1
            order = np.lexsort((words[rest], owner))
            rest, owner = rest[order], owner[order]
            heads = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(words[rest].view(np.int64), prepend=0) != 0) | (np.arange(len(rest)) == 0))
            repeats, take, k = np.diff(np.append(heads, len(rest))), pa.array(owner[heads]), len(heads)
            zero = np.zeros(k, np.int64)
            yield out(k, row_id=batch.column(0).take(take), doc_id=batch.column(1).take(take), h=words[rest[heads]].view(np.int64), times=repeats, n_tokens=zero, n_known=zero, base_score=np.zeros(k), score=np.zeros(k))

    rows = documents.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    written = materialise(rows.mapInArrow(run, PLACES), "places")
    # Rows of whole texts have no word to look up: in the join they would all meet in one task.
    places = written.where("slice_id is null")
    parts = places.where("h is not null").join(counts, "h", "left")
    parts = parts.unionByName(places.where("h is null").withColumn("c", F.lit(None).cast("long")).select(*parts.columns))
    c = F.coalesce("c", F.lit(0))
    out = parts.groupBy("row_id", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + F.col("times") * (F.log10(c + 0.1) - math.log10(mass))).alias("base_score"),
        F.sum("score").alias("score"),
    )
    if not bounded:
        out = out.drop("score").join(probe_scores(written, counted, bits, mass, backoff).withColumnRenamed("rare_score", "score"), "row_id")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
