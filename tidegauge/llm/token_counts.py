"""Token counts from pieces counted once per distinct pre-token, without materialising ids.

A pre-token is a run of non-spaces with the spaces before it. No piece of the model reaches over the end of one (checked when the model is read), so
the tokens of a text are those of its pre-tokens. The distinct pre-tokens are gathered and counted in Spark; those that most documents use, at most
max_broadcast of them, go to every worker, and the rest of each document's pre-token frequencies are joined to the table of pieces by a shuffle.

Null and empty texts have no token. Repeated rows are counted each on its own, rows without doc_id too. Very long texts and pre-tokens are counted whole.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import text_slices
from tidegauge.llm.shared import largest, materialise

_SPACED = re.compile(" *[^ ]+| +$")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens, each without the one space that the model sets before a text or stands for its own first space."""
    if not text:
        return []
    text = text.replace("▁", " ")
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [x[1:] for x in _SPACED.findall(" " + text)]


@cache
def model(path: str):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    if any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.vocab_size())):
        raise ValueError(f"{path} has pieces that reach over a space; its tokens can't be counted by pre-token")
    return m


def piece_counts(keys: list[str], path: str) -> list[int]:
    """Pieces of each pre-token where it stands after a word."""
    m = model(path)
    lead = len(m.encode("a"))
    return [len(x) - lead for x in m.encode(["a " + k for k in keys], num_threads=1)]


def distinct_pre_tokens(documents: DataFrame, most: int = 400_000) -> DataFrame:
    """pre_token, df of all texts; a task holds at most about `most` pre-tokens before it hands them on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre_token", "df"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(pre_tokens(text or "")))
                if len(seen) > most:
                    yield flush()
                    seen.clear()
        yield flush()

    return documents.select("text").mapInArrow(run, "pre_token string, df long").groupBy("pre_token").agg(F.sum("df").alias("df"))


def with_pieces(pre: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = piece_counts(batch.column(0).to_pylist(), path)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), batch.column(1)], names=["pre_token", "pieces", "df"])

    return pre.select("pre_token", "df").mapInArrow(run, "pre_token string, pieces long, df long")


def token_counts(documents: DataFrame, path: str, limit: int = 4096, max_broadcast: int = 1 << 19) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, for the sentencepiece model at path."""
    spark = documents.sparkSession
    pieces = materialise(with_pieces(distinct_pre_tokens(documents), path), "pieces")
    # Bounded: max_broadcast pre-tokens of at most 64 characters, whatever the corpus.
    common = largest(pieces.where(F.length("pre_token") <= 64), "df", max_broadcast).select("pre_token", "pieces").toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(common.column(0).to_pylist(), common.column(1).to_pylist(), strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in text_slices(batches):
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            row, token, times, part = [], [], [], np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, n in Counter(pre_tokens(text or "")).items():
                    if (p := table.get(k)) is not None:
                        part[i] += n * p
                    else:
                        row.append(i)
                        token.append(k)
                        times.append(n)
            # A row for each text, with its common part and no frequency, and a row for each of its rarer pre-tokens.
            every = np.arange(batch.num_rows)
            at = np.concatenate([every, np.array(row, np.int64)])
            one = np.arange(len(at)) < batch.num_rows
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(at)),
                    batch.column(1).take(pa.array(at)),
                    pa.array(np.where(one, np.concatenate([sizes, np.zeros(len(row), np.int64)]), 0), pa.int64()),
                    pa.array(np.concatenate([part, np.zeros(len(row), np.int64)]), pa.int64()),
                    pa.array([str(x) for x in batch.column(0).to_pylist()] + token, pa.string()),
                    pa.array(np.concatenate([np.zeros(batch.num_rows, np.int64), np.array(times, np.int64)]), pa.int64()),
                ],
                names=["row_id", "doc_id", "n_bytes", "part", "pre_token", "times"],
            )

    rows = documents.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    parts = rows.mapInArrow(run, "row_id long, doc_id long, n_bytes long, part long, pre_token string, times long")
    joined = parts.join(pieces.select("pre_token", "pieces"), "pre_token", "left")
    total = F.sum(F.col("part") + F.col("times") * F.coalesce("pieces", F.lit(0)))
    out = joined.groupBy("row_id", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("piece_bpe_32k.model")))
