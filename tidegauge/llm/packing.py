"""Best-fit packing of token sequences, planned over lengths and carried out by ranks.

Documents become token ids and an end id; longer ones are cut into pieces of the capacity, the first of which may be shorter. All that the plan needs is how
many pieces there are of each length: at most `capacity` numbers, however large the corpus. Over them runs large-item matching: lengths above a third of
the capacity go at most two to a sequence, each with the longest partner that still fits, and the smaller ones, longest first, into the tightest gap. Equal
sequences are planned as one group with a count. Every piece then finds its place from its rank among the pieces of its length.

Null and empty texts are the end id alone. Repeated rows, and rows without doc_id, are packed each on its own. Very long texts are cut, never truncated.
Pieces of one length tie, and go by the task and place in which they are read. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.batches import mix, run_hashes, text_buffer, text_slices
from tidegauge.llm.shared import materialise


_SPACE, _NEWLINE = 32, 10
# What else str.split() takes for white space: these bytes, and characters that may begin with one of these pairs of bytes.
_OTHER = np.zeros(256, bool)
_OTHER[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_LEADS = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


def single_spaced(column: pa.Array) -> np.ndarray:
    """Whether each text's words stand one space or newline apart, without any other white space and none at either end."""
    data, offsets = text_buffer(column)
    starts, ends = offsets[:-1], offsets[1:]
    good = ends > starts
    if not len(data):
        return good
    parts = (data == _SPACE) | (data == _NEWLINE)
    good &= ~parts[np.minimum(starts, len(data) - 1)] & ~parts[np.maximum(ends, 1) - 1]
    bad = _OTHER[data]
    bad[1:] |= parts[1:] & parts[:-1]
    good[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = False
    pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(np.isin(pairs, [a << 8 | b for a, b in _LEADS])), side="right")):
        text = column[int(k)].as_py() if good[k] else ""
        good[k] = bool(text) and text.split() == text.replace("\n", " ").split(" ")
    return good


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[k for k in range(128) if chr(k).isalnum()]] = True


def elements(data: np.ndarray, offsets: np.ndarray, punctuation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, after a space) of what single-spaced texts are put together from: words, runs of the given ASCII punctuation that end a word behind a letter or digit, newlines."""
    newlines = np.flatnonzero(data == _NEWLINE)
    parts = np.sort(np.concatenate([np.flatnonzero(data == _SPACE), newlines]))
    starts, ends = np.sort(np.concatenate([offsets[:-1], parts + 1])), np.sort(np.concatenate([parts, offsets[1:]]))
    cut = np.maximum.accumulate(np.where(punctuation[data], -1, np.arange(len(data))))[ends - 1] + 1
    before = data[cut - 1]
    # Of other characters only the letters of two bytes that begin with 0xC3 are looked for.
    letter = _ALNUM[before] | ((before >= 0x80) & (data[cut - 2] == 0xC3) & (before != 0x97) & (before != 0xB7))
    split = (cut < ends) & (cut > starts) & letter
    spaced = (starts > 0) & (data[starts - 1] == _SPACE)
    body = np.where(split, cut, ends)
    starts, ends = np.concatenate([starts, cut[split], newlines]), np.concatenate([body, ends[split], newlines + 1])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], np.concatenate([spaced, np.zeros(len(starts) - len(spaced), bool)])[order]


class Encoder:
    """Ids of texts by the tokenizer at path, which splits words in front of a space.

    A text whose words stand one space or newline apart is put together from the ids of its words, of which at most `most` are remembered in one array, found by 64-bit hashes;
    any other text goes through the tokenizer whole. Words of Latin letters alone go to the tokenizer's model without its splitting.
    """

    def __init__(self, path: str, most: int = 800_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.forget()
        letters = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.newline = self.whole("\n")
        # Special strings go through the tokenizer in one piece.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.punctuation = _PUNCTUATION.copy()
        self.punctuation[list("".join(special).encode())] = False
        self.by_words = len(self.newline) == 1 and not any(re.search(r"\s", t) or t.isalpha() for t in special) and self.whole("a b.\nc").tolist() == [*self.whole("a"), *self.whole(" b"), *self.whole("."), *self.newline, *self.whole("c")]
        if self.by_words:
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.letters = {ord(c): split(c)[0][0] for c in letters}
            self.space, self.newline_name = split(" ")[0][0], split("\n")[0][0]
            # These names are letters too, whose own names stand for something else.
            self.letters |= {ord(c): c for c in self.space + self.newline_name}
            self.latin = re.compile(f"[{''.join(c for c in letters if c not in self.space + self.newline_name)}]+").fullmatch
            sample = ["the", "naïve", "Straße", "señor"]
            ids, begins, ends = self.latin_ids(sample, " ")
            self.by_model = len(begins) == len(sample) and all(ids[a:b].tolist() == self.whole(f" {w}").tolist() for w, a, b in zip(sample, begins, ends, strict=True))

    def forget(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begins, self.ends, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def latin_ids(self, words: list[str], lead: str, together: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends) of words of Latin letters; many go in one call, as a call costs more than a word."""
        # In front of each stands a newline, which the model has by its own name and which ends in a token by itself.
        between = f"\n{self.newline_name}\n{self.space if lead else ''}"
        texts = [(between + between.join(words[i : i + together])).translate(self.letters) for i in range(0, len(words), together)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        begins = np.flatnonzero(ids == self.newline[0])
        return ids, begins + 1, np.append(begins[1:], len(ids))

    def other_ids(self, words: list[str], lead: str, together: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of any words, as lines of one text: none holds a newline, and a newline before a word or its space is a token by itself."""
        texts = ["".join([f"\n{lead}{w}" for w in words[i : i + together]]) for i in range(0, len(words), together)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        begins = np.flatnonzero(ids == self.newline[0])
        if len(begins) == len(words):
            return ids, begins + 1, np.append(begins[1:], len(ids))
        each = [self.whole(lead + w) for w in words]
        begins = np.cumsum([0, *map(len, each)])
        return np.concatenate(each), begins[:-1], begins[1:]

    def learn(self, keys: np.ndarray, words: list[str], spaced: np.ndarray) -> None:
        """Remember the ids of new elements; those after a space hold it."""
        rows = np.empty(len(words), np.int64)
        latin = np.array([self.latin(w) is not None for w in words], bool) & self.by_model
        newline = np.array([w == "\n" for w in words], bool)
        for mask, lead, ids_of in ((latin & spaced, " ", self.latin_ids), (latin & ~spaced, "", self.latin_ids), (~latin & spaced, " ", self.other_ids), (~latin & ~spaced & ~newline, "", self.other_ids), (newline, "", lambda *_: (self.newline, np.zeros(1, np.int64), np.ones(1, np.int64)))):
            if len(at := np.flatnonzero(mask)):
                ids, begins, ends = ids_of([words[k] for k in at], lead)
                rows[at] = len(self.begins) + np.arange(len(at))
                self.begins, self.ends = np.concatenate([self.begins, len(self.ids) + begins]), np.concatenate([self.ends, len(self.ids) + ends])
                self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, list[int]]:
        """(ids of all texts, bounds of the texts among them) of single-spaced texts."""
        data, offsets = text_buffer(column)
        starts, ends, spaced = elements(data, offsets, self.punctuation)
        keys, first, back = np.unique(mix(run_hashes(data, starts, ends) + spaced.astype(np.uint64)), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            where, raw = first[new], data.tobytes()
            self.learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], spaced[where])
            at = np.searchsorted(self.keys, keys)
        rows = self.rows[at]
        begins, sizes = self.begins[rows][back], (self.ends[rows] - self.begins[rows])[back]
        done = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(begins - done[:-1], sizes) + np.arange(done[-1])]
        return ids, [*done[np.searchsorted(starts, offsets[:-1])].tolist(), int(done[-1])]


@cache
def encoder(path: str, most: int) -> Encoder:
    return Encoder(path, most)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int"


def token_pieces(documents: DataFrame, path: str, capacity: int, end_id: int, parts: int, remember: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; part deals the pieces out evenly, copies of one text too."""
    end = np.array([end_id], "<u4")

    def encoded(texts: pa.Array, single: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text in turn."""
        tokens = encoder(path, remember)
        ids, bounds = tokens.encode(texts.filter(pa.array(single))) if single.any() else (np.zeros(0, np.uint32), [0])
        k = 0
        for i, known in enumerate(single.tolist()):
            if known:
                yield ids[bounds[k] : bounds[k + 1]]
                k += 1
            else:
                yield tokens.whole(texts[i].as_py())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = 0
        for batch in text_slices(batches):
            texts = pc.fill_null(batch.column(1), "")
            single = single_spaced(texts) & encoder(path, remember).by_words
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(texts, single), strict=True):
                raw = np.concatenate([ids.astype("<u4"), end]).tobytes()
                n, view = len(raw) // 4, memoryview(raw)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(view[4 * a : 4 * b])), strict=True):
                        column.append(value)
            part = (np.arange(dealt, dealt + len(out[0])) % parts).astype(np.int32)
            dealt += len(out[0])
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:]), pa.array(part)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups (sequences, [(length, pieces of it in each)]) for this many pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)

    def put(bins: int, inside: list[tuple[int, int]]) -> None:
        if bins:
            gaps[capacity - sum(n * k for n, k in inside)].append((bins, inside))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        # The longest partner that fits, perhaps of the same length.
        p = bisect.bisect_right(large, capacity - n) - 1
        if p < 0:
            put(left[n], [(n, 1)])
            left[n] = 0
        elif large[p] == n:
            put(left[n] // 2, [(n, 2)])
            left[n] %= 2
            if left[n]:
                # The odd one looks for a shorter partner.
                p -= 1
                put(1, [(n, 1)] if p < 0 else [(n, 1), (large[p], 1)])
                if p >= 0:
                    left[large[p]] -= 1
                left[n] = 0
        else:
            pairs = min(left[n], left[large[p]])
            put(pairs, [(n, 1), (large[p], 1)])
            left[n] -= pairs
            left[large[p]] -= pairs
        large = [x for x in large if left[x]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            gap = min((g for g in gaps if g >= n and gaps[g]), default=0)
            # The tightest gap takes the length again and again before the next one opens.
            bins, inside = gaps[gap].pop() if gap else (-(-todo // (capacity // n)), [])
            each = (gap or capacity) // n
            full, rest = min(bins, todo // each), 0
            put(full, [*inside, (n, each)])
            todo -= full * each
            if full < bins and todo:
                rest = min(each, todo)
                put(1, [*inside, (n, rest)])
                todo -= rest
            if inside:
                put(bins - full - bool(rest), inside)
    return [group for g in gaps.values() for group in g]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset, pieces in each sequence), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for bins, inside in groups:
        offset = 0
        for n, k in inside:
            rows[n].append((rank[n], sequence, offset, k))
            rank[n] += bins * k
            offset += n * k
        sequence += bins
    return {n: np.array(r, np.int64) for n, r in rows.items()}


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(documents: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, remember: int = 800_000) -> DataFrame:
    """One row per piece with its sequence and its offset there. Each worker remembers the ids of `remember` words."""
    pieces = materialise(token_pieces(documents, path, capacity, end_id, parts=1 << 10, remember=remember), "pieces-packed")
    cells = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "pieces-cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(counts, capacity))
    # A rank runs through the parts of a length, and within a part in any fixed order: at most capacity x parts cells, and no length meets in one task.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    cells = cells.select("length", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(cells, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[at[0]])
                rows = table[n]
                g = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                q = rank[at] - g[:, 0]
                sequence[at], offset[at] = g[:, 1] + q // g[:, 3], g[:, 2] + q % g[:, 3] * n
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in PACKED.split(", ")])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PACKED)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
