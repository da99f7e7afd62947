"""Exact substring dedup with an FM-index per shard.

A window of `width` words that starts earlier somewhere else (in a smaller doc_id, or before in the same document) is repeated, and all words that repeated windows cover are removed.

1. Every window is known by its anchor, the least hash of the `anchor`-word runs in it, so that equal windows have equal anchors. Windows in a row mostly
   share theirs, which makes one segment. Anchors that occur once in the corpus can't have repeated windows; their segments go no further.
2. Segments go to shards by anchor, so that all equal windows meet. Of equal segments a task sends on only the first, as the others are repeated throughout. Segments of an
   anchor of over `hot` places are sent window by window, by the hash of the window: what surrounds a passage that a third of the corpus shares is spread evenly.
3. Each shard builds the compressed FM-index of its segments and streams them through it: backward search over the wavelet matrix gives, place by place, the
   interval of all occurrences of the window, and with it the earliest.
4. The intervals found go back to their documents.

Copies of whole texts are repeated throughout but for the smallest doc_id, and skip 2 and 3.

Null and empty texts have no word. Rows without doc_id stay whole. Repeated rows keep what the first would keep; rows that share a doc_id but not the
text count as one document and are cleaned each on its own. Very long texts are searched whole. Of windows that tie, in one document too, the one that starts first stays. An empty table
gives an empty result. Extra columns, whatever their names, are ignored. Words are told apart by 48 bits of a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import mix, run_hashes, text_buffer, text_slices, word_spans
from tidegauge.llm.fm_index import FmIndex
from tidegauge.llm.shared import join_spread, materialise

_ALL = (1 << 31) - 1


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` values in a row."""
    have = 1
    while 2 * have <= span:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    return np.minimum(values[: len(values) - (span - have)], values[span - have :]) if span > have else values


def segments(words: np.ndarray, bounds: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first, last): runs of windows, by first and last start in all words, with one anchor; bounds part the texts."""
    if len(words) < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) * 2
    at = np.arange(len(words) - anchor + 1)
    grams = run_hashes(words, at, at + anchor)
    # 38 bits of the hash order the runs; the place below them breaks ties to the left and names the run.
    place = np.uint64((1 << 26) - 1)
    least = (sliding_least((mix(grams) & ~place) | at.astype(np.uint64), width - anchor + 1) & place).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(len(least)), side="right") - 1
    whole = np.arange(len(least)) + width <= bounds[text + 1]
    windows = np.flatnonzero(whole)
    least, text = least[windows], text[windows]
    new = (np.diff(least, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(windows)) - 1
    return text[heads], grams[least[heads]].view(np.int64), windows[heads], windows[tails]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds of the texts among them)."""
    data, offsets = text_buffer(column)
    starts, ends, before = word_spans(data, offsets)
    return run_hashes(data, starts, ends), before


def anchors(documents: DataFrame, width: int, anchor: int) -> DataFrame:
    """anchor, doc_id of every segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            text, found, _, _ = segments(*_words(batch.column(1)), width, anchor)
            yield pa.record_batch([pa.array(found), batch.column(0).take(pa.array(text))], names=["anchor", "doc_id"])

    return documents.select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")


def compressed(documents: DataFrame) -> DataFrame:
    """doc_id, text_id, packed: texts as zstd frames, so that a shuffle moves little; text_id tells rows of one doc_id apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in text_slices(batches):
            raw = [pack(x or b"") for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["doc_id", "text_id", "packed"])

    return documents.select("doc_id", text_hash().alias("text_id"), "text").mapInArrow(run, "doc_id long, text_id long, packed binary")


def text_hash(seed: int | None = None):
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text) if seed is None else F.xxhash64(F.lit(seed), text)


def unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x) for x in column.to_pylist()], pa.large_binary())


def _six(words: np.ndarray) -> bytes:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


SHARDED = "shard int, docs binary, texts binary, starts binary, sizes binary, words binary, gone binary"


def sharded(rows: DataFrame, shards: int, width: int, anchor: int, hot: int) -> DataFrame:
    """Segments of repeated anchors by shard; rows: (doc_id, text_id, packed, found [(anchor, n)], copies [text_id]), sorted by doc_id in each partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batch.select([0, 1, 3, 4, 2]) for batch in batches):
            own = np.array([t not in (c or ()) for t, c in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)], bool)
            words, bounds = _words(unpacked(batch.column(4)))
            text, found, first, last = segments(words, bounds, width, anchor)
            keep, crowded = np.zeros(len(text), bool), np.zeros(len(text), bool)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            lists = batch.column(2)
            at, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            known, n = flat.field("anchor").to_numpy(), flat.field("n").to_numpy()
            for i in np.flatnonzero(own):
                a, b = cuts[i], cuts[i + 1]
                k, m = known[at[i] : at[i + 1]], n[at[i] : at[i + 1]]
                if a < b and len(k):
                    order = np.argsort(k)
                    j = np.minimum(np.searchsorted(k, found[a:b], sorter=order), len(k) - 1)
                    keep[a:b] = k[order[j]] == found[a:b]
                    crowded[a:b] = keep[a:b] & (m[order[j]] > hot)
            # Segments of crowded anchors fall into their windows.
            cold = np.flatnonzero(keep & ~crowded)
            many = np.flatnonzero(crowded)
            width_of = last[many] - first[many] + 1
            step = np.arange(width_of.sum()) - np.repeat(np.cumsum(width_of) - width_of, width_of)
            single = np.repeat(first[many], width_of) + step
            doc = np.concatenate([text[cold], np.repeat(text[many], width_of)])
            start = np.concatenate([first[cold], single])
            stop = np.concatenate([last[cold], single]) + width
            whole = run_hashes(words, start, stop)
            key = np.concatenate([found[cold].view(np.uint64), whole[len(cold) :]])
            shard = (mix(key) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((start, doc))
            fresh = np.zeros(len(doc), bool)
            for i in order:
                h = int(whole[i])
                if h not in seen:
                    fresh[i] = True
                    seen.add(h)
            if len(seen) > 3_000_000:
                seen.clear()
            # What is repeated throughout needs no search; it goes along to any shard.
            shard = np.where(fresh, shard, (mix(start.astype(np.uint64) + whole) % np.uint64(shards)).astype(np.int64))
            ids, names = batch.column(0).to_numpy()[doc], batch.column(1).to_numpy()[doc]
            order = np.argsort(shard, kind="stable")
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                lengths = stop[part] - start[part]
                new = part[fresh[part]]
                size = stop[new] - start[new]
                places = np.arange(size.sum()) + np.repeat(start[new] - np.cumsum(size) + size, size)
                rows.append((int(shard[part[0]]), ids[part].tobytes(), names[part].tobytes(), (start[part] - bounds[doc[part]]).tobytes(), lengths.tobytes(), _six(words[places]), (~fresh[part]).tobytes()))
            if rows:
                yield pa.record_batch([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names=[x.split()[0] for x in SHARDED.split(", ")])

    return rows.select("doc_id", "text_id", "packed", "found", "copies").mapInArrow(run, SHARDED)


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each doc without overlap, sorted; intervals that touch become one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    # The furthest stop so far within a doc: docs are numbered, and each lies above all stops of the one before.
    number = np.cumsum(np.diff(doc, prepend=doc[0]) != 0)
    lift = number * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + lift[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    return doc[heads], start[heads], reach[tails] - lift[tails]


FOUND = "doc_id long, text_id long, start int, stop int"


def search_shard(group: pd.DataFrame, width: int) -> pd.DataFrame:
    """Intervals of repeated windows of one shard."""
    docs, texts, starts, sizes = (np.frombuffer(b"".join(group[c]), np.int64) for c in ("docs", "texts", "starts", "sizes"))
    gone = np.frombuffer(b"".join(group["gone"]), bool)
    raw = np.frombuffer(b"".join(group["words"]), np.uint8).reshape(-1, 6)
    words = np.zeros((len(raw), 8), np.uint8)
    words[:, :6] = raw
    ids = np.unique(words.reshape(-1).view("<u8"), return_inverse=True)[1] + 1
    new = np.flatnonzero(~gone)
    size = sizes[new]
    # Segment after segment, each followed by a 0.
    head = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()) or 1, np.int64)
    segment = np.repeat(np.arange(len(new)), size)
    inside = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
    places = head[segment] + inside
    text[places] = ids
    index = FmIndex(text, width)
    # Places by document and start: the order in which one counts as earlier.
    key = np.full(len(text), np.iinfo(np.int64).max)
    doc, at = docs[new][segment], starts[new][segment] + inside
    order = np.lexsort((at, doc))
    step = np.ones(len(order), np.int64)
    step[1:] = (np.diff(doc[order]) != 0) | (np.diff(at[order]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    key[places] = rank
    cls = index.stream(text, head, head + size)
    seen = cls[places]
    again = np.flatnonzero((seen >= 0) & (index.least_of_class(key)[seen] < rank))
    # Rows of one document: number (doc, text) pairs together.
    doc = np.concatenate([docs[new][segment][again], docs[gone]])
    name = np.concatenate([texts[new][segment][again], texts[gone]])
    start = np.concatenate([at[again], starts[gone]])
    stop = np.concatenate([at[again] + width, starts[gone] + sizes[gone]])
    if not len(doc):
        return pd.DataFrame({"doc_id": doc, "text_id": name, "start": start.astype(np.int32), "stop": stop.astype(np.int32)})
    order = np.lexsort((name, doc))
    number = np.empty(len(doc), np.int64)
    number[order] = np.cumsum((np.diff(doc[order], prepend=doc[order[0]]) != 0) | (np.diff(name[order], prepend=name[order[0]]) != 0))
    which = np.empty(int(number.max()) + 1, np.int64)
    which[number] = np.arange(len(doc))
    number, start, stop = merged(number, start, stop)
    return pd.DataFrame({"doc_id": doc[which[number]], "text_id": name[which[number]], "start": start.astype(np.int32), "stop": stop.astype(np.int32)})


def repeated_spans(documents: DataFrame, width: int = 20, anchor: int = 5, hot: int = 500, shard_words: int = 1_000_000) -> DataFrame:
    """doc_id, text_id, start, stop of repeated stretches of words; stretches may overlap."""
    rows = documents.where("doc_id is not null").select("doc_id", "text")
    keys = rows.select("doc_id", text_hash().alias("text_id"), text_hash(7).alias("text_id2"))
    least = keys.groupBy("text_id", "text_id2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = materialise(keys.join(least, ["text_id", "text_id2"]).where("doc_id > least").select("doc_id", "text_id"), "copies")
    placed = materialise(anchors(rows, width, anchor), "anchors")
    repeated = materialise(placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors-repeated")
    found = join_spread(placed, repeated, ["anchor"]).select("doc_id", F.struct("anchor", F.col("n").cast("int").alias("n")).alias("hit"), F.lit(None).cast("long").alias("copy"))
    found = found.unionByName(copies.select("doc_id", F.lit(None).cast(found.schema["hit"].dataType).alias("hit"), F.col("text_id").alias("copy")))
    by_doc = materialise(found.groupBy("doc_id").agg(F.collect_set("hit").alias("found"), F.collect_set("copy").alias("copies")), "anchors-by-doc")
    total = by_doc.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    shards = max(1, total * (width + width // 2) // shard_words)
    joined = compressed(rows).join(by_doc, "doc_id").sortWithinPartitions("doc_id")
    parts = sharded(joined, shards, width, anchor, hot)
    spans = parts.groupBy("shard").applyInPandas(lambda group: search_shard(group, width), FOUND)
    return spans.unionByName(copies.select("doc_id", "text_id", F.lit(0).alias("start"), F.lit(_ALL).alias("stop")))


CLEAN = "doc_id long, n_words long, n_removed long, kept string"


def substring_dedup(documents: DataFrame, width: int = 20, digest: bool = False, **how) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, one space apart; its SHA-256 with digest) of every row."""
    spans = repeated_spans(documents, width, **how).groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batch.select([0, 2, 1]) for batch in batches):
            rows = []
            unpack = zstandard.ZstdDecompressor().decompress
            for packed, spans in zip(batch.column(2).to_pylist(), batch.column(1), strict=True):
                words = unpack(packed).split()
                n = len(words)
                if spans.is_valid and n >= width:
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, np.minimum(spans.values.field("start").to_numpy(), n), 1)
                    np.add.at(gone, np.minimum(spans.values.field("stop").to_numpy(), n), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0).tolist()]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept"])

    texts = compressed(documents)
    return texts.join(spans, ["doc_id", "text_id"], "left").select("doc_id", "packed", "spans").mapInArrow(run, CLEAN)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).withColumnRenamed("kept", "kept_sha256")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, i, words[i + 1] AS word, array_to_string(words[i + 1 : i + 20], ' ') AS win, i + 20 <= len(words) AS whole
  FROM (SELECT *, unnest(range(len(words))) AS i
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents))
), r AS (
  SELECT doc_id, i, whole AND row_number() OVER (PARTITION BY win, whole ORDER BY doc_id, i) > 1 AS again FROM w
), c AS (
  SELECT doc_id, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), d AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM c JOIN w USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)
"""
