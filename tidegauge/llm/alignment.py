"""Alignment of two tokenizers' tokens over the same bytes, by elementary intervals.

The union of both sides' token ends cuts the bytes into elementary intervals. Each interval lies in one A token and one B token, found by a search of its end
among theirs, so that it is one overlap, and every overlap is one interval. An end that both sides share closes a group; the products of the groups' tokens are
a table of their own (group_products).

Both tokenizers split a text in front of a space or newline that stands between two other characters (no piece of B reaches over one, which is checked when the
model is read), so that the intervals of a text are those of its units one after another. Units are aligned once by each worker, many at a time, and at most
`most` of them are remembered.

A pair's count is how many links of the corpus hold it. All texts' links are written, two ids each, and counted in tasks before they are handed on; the most
frequent pairs, at most max_broadcast, go to every worker, and the links of the others are joined to their table by a shuffle. None of those others is frequent:
a level of counts is sent whole or not at all.

Null and empty texts, and those whose tokens don't give back the text's bytes on one side, have no tokens: zeros and no groups. Rows without doc_id and repeated rows
are aligned, and counted, each on its own. Ties for a B id's highest count are all highest. Very long texts and units are aligned whole. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.batches import text_buffer, text_slices
from tidegauge.llm.shared import largest, materialise

# Between other characters only: within a run of white space the tokenizers may do as they like.
_UNIT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def units(text: str | None) -> list[str]:
    """The units of a space and the text; an empty or missing text has none."""
    return _UNIT.split(" " + text) if text else []


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, a, b, shared) of the elementary intervals: the tokens that hold each, and whether both end there. No token is empty, and both sides end together."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


@cache
def _tokenizers(path_a: str, path_b: str):
    """(A, bytes of A's ids, B, bytes of B's ids)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    # Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on.
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [x for x in range(256) if x not in itself]
    byte_of = {chr(x): x for x in itself} | {chr(0x100 + k): x for k, x in enumerate(rest)}
    bytes_a = [b""] * a.get_vocab_size(with_added_tokens=True)
    for token, i in a.get_vocab(with_added_tokens=True).items():
        bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
    if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
        raise ValueError(f"{path_b} has pieces that reach over a space or a line's end; its texts can't be aligned by units")
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return a, bytes_a, b, bytes_b


def _flat(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum())), sizes


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at starts."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _decimals(n: int) -> np.ndarray:
    """Decimal digits of 0 to n - 1 at the right of a row, zeros before them and room for what follows at its end."""
    width = len(str(n)) + 1
    return np.frombuffer("".join(f"{i:>{width - 1}} " for i in range(n)).replace(" ", "\0").encode(), np.uint8).reshape(n, width)


class _Codes(dict):
    """Gives each new unit the next number and notes it."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = code = len(self)
        return code


class Units:
    """What a worker remembers of units: sizes, links as A id and B id, groups as text. Beyond `most` units those seen once are forgotten, or all."""

    def __init__(self, path_a: str, path_b: str, most: int = 1 << 18) -> None:
        self.a, self.bytes_a, self.b, self.bytes_b = _tokenizers(path_a, path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in y]) for y in (self.bytes_a, self.bytes_b))
        self.kind = np.dtype("<u2" if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else "<u4")
        self.decimals = _decimals(max(len(self.bytes_a), len(self.bytes_b)))
        self.most = most
        self.forget(0)

    def forget(self, times: int) -> None:
        """Keep units that were seen more than `times` times, if these are at most half of what may be kept; times 0: none."""
        kept = np.flatnonzero(self.used > times) if times else np.zeros(0, np.int64)
        if times and len(kept) * 2 <= self.most:
            names, places = list(self.code), _spread(self.start[kept], self.n_links[kept])
            self.code = _Codes()
            self.code.update((names[k], i) for i, k in enumerate(kept.tolist()))
            self.groups = [self.groups[k] for k in kept.tolist()]
            self.good, self.counts, self.used, self.n_links, self.links = self.good[kept], self.counts[kept], self.used[kept], self.n_links[kept], self.links[places]
            self.start = np.cumsum(self.n_links) - self.n_links
            if len(self.links) * 2 <= 8 * self.most:
                return
        self.code, self.groups = _Codes(), []
        self.good, self.counts, self.links = np.zeros(0, bool), np.zeros((0, 3), np.int64), np.zeros((0, 2), self.kind)
        self.used, self.start, self.n_links = (np.zeros(0, np.int64) for _ in range(3))

    def same_bytes(self, raw: list[bytes], ids: list[list[int]], names: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether each unit's tokens give its bytes; all at once where they all do."""
        flat, n = _flat(ids)
        ends = np.cumsum(np.append(0, sizes[flat]))
        upto = np.cumsum(np.append(0, n))
        if np.array_equal(ends[upto[1:]] - ends[upto[:-1]], [len(r) for r in raw]) and b"".join(map(names.__getitem__, flat.tolist())) == b"".join(raw):
            return np.ones(len(raw), bool)
        return np.array([b"".join(map(names.__getitem__, x)) == r for r, x in zip(raw, ids, strict=True)], bool)

    def learn(self, new: list[str]) -> None:
        raw = [u.encode() for u in new]
        ids_a = [x.ids for x in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # B sets a space before each text: the unit's own one, or a token of its own in front of a newline.
        ids_b = [x if u[0] == " " else x[1:] for u, x in zip(new, self.b.encode([u[1:] if u[0] == " " else u for u in new], num_threads=1), strict=True)]
        good = self.same_bytes(raw, ids_a, self.bytes_a, self.size_a) & self.same_bytes(raw, ids_b, self.bytes_b, self.size_b)
        kept = np.flatnonzero(good)
        if len(kept) < len(new):
            raw, ids_a, ids_b = ([x[k] for k in kept.tolist()] for x in (raw, ids_a, ids_b))
        (a, n_a), (b, n_b) = _flat(ids_a), _flat(ids_b)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends, in_a, in_b, shared = intervals(ends_a, ends_b) if len(a) else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        unit = np.searchsorted(np.cumsum([len(r) for r in raw]), ends) if len(raw) else ends
        counts, n_links = np.zeros((len(new), 3), np.int64), np.zeros(len(new), np.int64)
        counts[kept, 0], counts[kept, 1] = n_a, n_b
        counts[kept, 2] = np.bincount(unit[shared], minlength=len(kept))
        n_links[kept] = np.bincount(unit, minlength=len(kept))
        texts = [""] * len(new)
        for k, t in zip(kept.tolist(), self.group_texts(a, b, ends_a, ends_b, ends[shared], unit[shared], len(kept)), strict=True):
            texts[k] = t
        self.groups += texts
        self.start = np.concatenate([self.start, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, np.stack([a[in_a], b[in_b]], axis=1).astype(self.kind)])
        self.n_links = np.concatenate([self.n_links, n_links])
        self.good, self.counts = np.concatenate([self.good, good]), np.concatenate([self.counts, counts])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])

    def group_texts(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, ends: np.ndarray, unit: np.ndarray, n: int) -> list[str]:
        """Groups of each of n units as a1,a2|b1;a3|b2: all tokens' digits and what follows them in the groups' order, cut between units."""
        if not len(a):
            return [""] * n
        group = np.concatenate([2 * np.searchsorted(ends, ends_a), 2 * np.searchsorted(ends, ends_b) + 1])
        order = np.argsort(group, kind="stable")
        group = group[order]
        cells = self.decimals[np.concatenate([a, b])[order]]
        last = np.append(group[1:] != group[:-1], True)
        cells[:, -1] = np.where(last, np.where(group % 2, ord(";"), ord("|")), ord(","))
        text = cells[cells > 0].tobytes().decode()
        upto = np.cumsum((cells > 0).sum(axis=1))
        # Each unit's text ends with its last group's semicolon, which goes.
        final = upto[np.searchsorted(group, 2 * np.flatnonzero(np.append(unit[1:] != unit[:-1], True)) + 1, side="right") - 1].tolist()
        return [text[s : e - 1] for s, e in zip([0, *final[:-1]], final, strict=True)]

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(code of every unit of the texts that have tokens, text it belongs to)."""
        if len(self.code) > self.most or len(self.links) > 8 * self.most:
            self.forget(1)
        split = [units(t) for t in texts]
        flat = list(chain.from_iterable(split))
        codes = np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))
        if self.code.new:
            self.learn(self.code.new)
            self.code.new = []
        self.used += np.bincount(codes, minlength=len(self.used))
        text = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        if not self.good.all():
            bad = np.zeros(len(texts), bool)
            bad[text[~self.good[codes]]] = True
            codes, text = codes[~bad[text]], text[~bad[text]]
        return codes, text


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])


def _keys(links: np.ndarray) -> np.ndarray:
    return links[:, 0].astype(np.int64) << 32 | links[:, 1].astype(np.int64)


def linked(documents: DataFrame, path_a: str, path_b: str, most: int = 1 << 18) -> DataFrame:
    """row_id, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links of every row; links: pairs of A id and B id, two bytes each (four, if a vocabulary has over 65,536 tokens)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(path_a, path_b, most)
        for batch in text_slices(batches):
            codes, text = known.codes(batch.column(2).to_pylist())
            edge = np.searchsorted(text, np.arange(batch.num_rows + 1))

            def total(of: np.ndarray) -> np.ndarray:
                upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(of[codes])])
                return upto[edge[1:]] - upto[edge[:-1]]

            groups = list(map(known.groups.__getitem__, codes.tolist()))
            digests = [hashlib.sha256(";".join(groups[x:y]).encode()).hexdigest() if y > x else "" for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            n_links = total(known.n_links)
            links = known.links[_spread(known.start[codes], known.n_links[codes])]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), *(pa.array(total(known.counts[:, k])) for k in range(3)), pa.array(n_links), pa.array(digests, pa.string()), _binary(links, np.cumsum(n_links) * 2 * known.kind.itemsize)],
                names=["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
            )

    rows = documents.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def _links(column: pa.Array, n_links: np.ndarray) -> np.ndarray:
    """Links of all rows of a batch."""
    data, _ = text_buffer(column)
    pairs = int(n_links.sum())
    return np.frombuffer(data.tobytes(), "<u4" if len(data) == 8 * pairs else "<u2").reshape(pairs, 2)


def pair_counts(links: DataFrame, most: int = 1 << 21) -> DataFrame:
    """a, b, n, best of every pair of ids: its links in all rows of linked(), and whether no other pair of b has more. A task hands on after about `most` pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def gathered() -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])

        for batch in text_slices(batches, 8 << 20):
            some, times = np.unique(_keys(_links(batch.column(1), batch.column(0).to_numpy())), return_counts=True)
            both, at = np.unique(np.concatenate([keys, some]), return_inverse=True)
            keys, n, old = both, np.zeros(len(both), np.int64), n
            np.add.at(n, at, np.concatenate([old, times]))
            if len(keys) > most:
                yield gathered()
                keys, n = keys[:0], n[:0]
        yield gathered()

    counted = links.select("n_links", "links").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # A B id has at most as many pairs as A has ids.
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def align(documents: DataFrame, path_a: str, path_b: str, most: int = 1 << 18, max_broadcast: int = 1 << 19) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row, for the byte-level tokenizer at path_a and the sentencepiece model at path_b."""
    spark = documents.sparkSession
    links = materialise(linked(documents, path_a, path_b, most), "links")
    pairs = materialise(pair_counts(links), "pairs")
    # Bounded: max_broadcast pairs, whatever the corpus.
    sent = largest(pairs, "n", max_broadcast).select((F.col("a") * (1 << 32) + F.col("b")).alias("key"), "n", "best").toArrow().sort_by("key")
    common = spark.sparkContext.broadcast(tuple(sent.column(k).to_numpy() for k in range(3)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = common.value
        n, best = np.append(n, 0), np.append(best, False)  # of a link that wasn't sent
        for batch in text_slices(batches, 4 << 20):
            sizes = batch.column(1).to_numpy()
            asked = _keys(_links(batch.column(2), sizes))
            at = np.searchsorted(keys, asked)
            found = keys[np.minimum(at, len(keys) - 1)] == asked if len(keys) else np.zeros(len(asked), bool)
            at = np.where(found, at, len(keys))
            edge = np.cumsum(np.append(0, sizes))

            def total(of: np.ndarray) -> np.ndarray:
                upto = np.cumsum(np.append(0, of))
                return upto[edge[1:]] - upto[edge[:-1]]

            none = [pa.nulls(batch.num_rows, pa.int64())] * 2
            names = ["row_id", "n_best", "count_sum", "a", "b"]
            yield pa.record_batch([batch.column(0), pa.array(total(best[at].astype(np.int64))), pa.array(total(n[at])), *none], names=names)
            if not found.all():
                row, rare = np.repeat(np.arange(batch.num_rows), sizes)[~found], asked[~found]
                empty = [pa.nulls(len(rare), pa.int64())] * 2
                yield pa.record_batch([batch.column(0).take(pa.array(row)), *empty, pa.array(rare >> 32), pa.array(rare & 0xFFFFFFFF)], names=names)

    parts = links.select("row_id", "n_links", "links").mapInArrow(run, "row_id long, n_best long, count_sum long, a long, b long")
    if sent.num_rows < pairs.count():
        parts = materialise(parts, "link-sums")
        rare = parts.where("a is not null").select("row_id", "a", "b").join(pairs, ["a", "b"]).select("row_id", F.col("best").cast("long").alias("n_best"), F.col("n").alias("count_sum"))
        parts = parts.where("a is null").select("row_id", "n_best", "count_sum").unionByName(rare)
    rows = links.select("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    sums = parts.groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(sums, "row_id").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, group_no, start, stop (bytes of a space and the text), a_ids, b_ids of every group of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(path_a, path_b)
        for batch in text_slices(batches):
            rows: list[tuple] = []
            texts = batch.column(1).to_pylist()
            codes, text = known.codes(texts)
            edge = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                at, no = 0, 0
                for part in ";".join(known.groups[c] for c in codes[edge[i] : edge[i + 1]].tolist()).split(";"):
                    if part:
                        a, b = ([int(x) for x in side.split(",")] for side in part.split("|"))
                        stop = at + int(known.size_a[a].sum())
                        rows.append((doc_id, no, at, stop, a, b))
                        at, no = stop, no + 1
            ids = pa.list_(pa.int64())
            kinds = [pa.int64()] * 4 + [ids, ids]
            if rows:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "group_no", "start", "stop", "a_ids", "b_ids"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, group_no long, start long, stop long, a_ids array<long>, b_ids array<long>")


def group_products(grouped: DataFrame) -> DataFrame:
    """doc_id, group_no, a_id, b_id: each A token with each B token of the groups that groups() returns."""
    return grouped.select("doc_id", "group_no", F.explode("a_ids").alias("a_id"), "b_ids").select("doc_id", "group_no", "a_id", F.explode("b_ids").alias("b_id"))


def op11_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
