"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams, of one to three characters, of every labelled row, in Spark; what reaches the driver is one count for each language and bucket, at most
languages x buckets, and the number of languages is held under max_languages. The matrix of log-probabilities is broadcast, and texts are
scored in batches: the sparse matrix of texts and buckets times the weights, in numpy.

A text that is null, empty or without a letter is `und` with score 0. Rows without a label teach nothing. With no labelled row at all, every text is `und`.
Very long texts are scored whole. Ties between languages go to the first by name. Repeated rows are scored, and teach, each on its own. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidegauge.llm.batches import text_buffer, text_slices

_SPACE = 32
#: Bytes of text at a time: a character takes some 60 bytes while its n-grams are looked up.
_SLICE = 128 << 10


@cache
def _fold() -> np.ndarray:
    """What n-grams don't tell apart, for characters up to U+FFFF: capitals count as small, and all that are no letters as one space."""
    small = [c.lower() if c.isalpha() else " " for c in map(chr, range(1 << 16))]
    return np.array([ord(c) if len(c) == 1 else k for k, c in enumerate(small)], np.uint32)


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points of all texts, offsets of the texts in them); null as empty."""
    data, offsets = text_buffer(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    # A character begins with every byte that doesn't continue one.
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    return np.where(codes < 1 << 16, _fold()[np.minimum(codes, (1 << 16) - 1)], codes), before[offsets]


def ngram_buckets(folded: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (text index, bucket) of every n-gram of the folded characters; an n-gram stays inside its text, and those of only spaces don't count."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    wide = folded.astype(np.uint64)
    for n in orders:
        if len(folded) < n:
            continue
        # Multiplicative hashing; the order goes in, so that equal codes of two orders part.
        code, spaces = np.full(len(folded) - n + 1, n, np.uint64), np.full(1, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + wide[k : len(folded) - n + 1 + k]
            spaces = spaces * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_SPACE)
        inside = (owner[: len(code)] == owner[n - 1 :]) & (code != spaces[0])
        code = code[inside] * np.uint64(0xD6E8FEB86659FD93)
        yield owner[: len(inside)][inside], ((code >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def train(labelled: DataFrame, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, max_languages: int = 200) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [bucket, language]) from (text, lang) rows; add-one smoothing, equal priors."""
    languages = sorted(r[0] for r in labelled.where("lang is not null").select("lang").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages if the matrix of that size may be broadcast")
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(languages) * buckets, np.int64)
        for batch in text_slices(batches, _SLICE):
            where = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for owner, bucket in ngram_buckets(*characters(batch.column(1)), orders, buckets):
                totals += np.bincount(where[owner] * buckets + bucket, minlength=len(totals))
        used = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(used), pa.array(totals[used])], names=["cell", "n"])

    rows = labelled.where("lang is not null").select("lang", "text")
    cells = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.ones((len(languages), buckets))
    counts.reshape(-1)[cells["cell"].to_numpy()] += cells["n"].to_numpy()
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)


def predict(texts: DataFrame, languages: list[str], weights: np.ndarray, orders: tuple[int, ...] = (1, 2, 3), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in carry, lang_pred, score of (doc_id, text) rows; score is the posterior of the language, with log-likelihoods scaled by 10 / sqrt(n-grams) as n-grams overlap."""
    spark = texts.sparkSession
    given = ["doc_id", *carry]
    if not languages:
        return texts.select(*given, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared, buckets = spark.sparkContext.broadcast(weights), weights.shape[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, _SLICE):
            w, n = shared.value, batch.num_rows
            totals, size = np.zeros((n, len(languages))), np.zeros((n, 1))
            for owner, bucket in ngram_buckets(*characters(batch.column(-1)), orders, buckets):
                # Rows of the sparse matrix texts x buckets times the weights: gather the entries' weights, add them up by text.
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                if len(starts):
                    totals[owner[starts]] += np.add.reduceat(w[bucket], starts, axis=0, dtype=np.float64)
                    size[owner[starts], 0] += np.diff(starts, append=len(owner))
            z = 10 * (totals - totals.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(1, size))
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            letters = pc.fill_null(pc.match_substring_regex(batch.column(-1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best = p.argmax(axis=1)
            names = [languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(letters, p.max(axis=1), 0.0))], names=[*given, "lang_pred", "score"])

    rows = texts.select(*given, F.col("text").alias("_text"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(documents: DataFrame, modulus: int, keep: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == keep


def language_id(documents: DataFrame, modulus: int = 3, keep: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the columns in carry of every row; learns from the labelled rows that are not held out."""
    fold = held_out(documents, modulus, keep)
    languages, weights = train(documents.where(~fold).select("text", "lang"))
    out = predict(documents, languages, weights, carry=carry)
    return out.select("doc_id", held_out(out, modulus, keep).alias("held_out"), "lang_pred", "score", *carry)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
