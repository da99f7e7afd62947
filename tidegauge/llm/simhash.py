"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is cut into so few segments that of two linked ones some segment differs by at most one bit. Every segment is indexed once for each of its bits with
that bit as a wildcard; equal variants are joined and the pairs verified. Only distinct fingerprints are indexed, so copies cost nothing.

The 64-bit fingerprints of 3-word shingles are cut into two segments of 32 bits, so that all links within 3 bits are found, whatever the data. near_copies.py has
fingerprints of its own, four segments of 32 bits, and verifies on sets of shingles.

Null and empty texts have fingerprint zero and link like any other. Rows without doc_id get a fingerprint and no component. Repeated rows and ties share a component.
Very long texts are fingerprinted whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import mix, run_hashes, text_buffer, text_slices, word_spans
from tidegauge.llm.components import components
from tidegauge.llm.shared import materialise


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """64 bits, each set if over half of the shingles' XXH64 values have it; zero for a text without words."""
    line = b" ".join(raw.lower().split())
    if not line:
        return 0
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(line)]
    n = max(1, len(starts) - words + 1)
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, 50_000):
        hashes = b"".join([digest(line[s:e], seed) for s, e in zip(starts[at : min(n, at + 50_000)], ends[at + min(words, len(starts)) - 1 :], strict=False)])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fps = np.array([fingerprint(raw or b"", words, seed) for raw in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, hot: int = 2000) -> DataFrame:
    """a, b: all pairs of distinct fingerprints (column fp) within 3 bits.

    Of three differing bits one half of the fingerprint has at most one. A variant that more than `hot` fingerprints share is cut again: up to three bits
    differ in the other half, so one of its four bytes is equal, and the pairs meet in the smaller groups of equal bytes instead.
    """
    half = [0xFFFFFFFF, 0xFFFFFFFF << 32]
    masks = [half[s] & ~(1 << (32 * s + i)) for s in (0, 1) for i in range(32)]
    variants = F.explode(F.array(*[F.struct(F.lit(j).cast("short").alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for j, m in enumerate(masks)])).alias("k")
    keys = fps.select("fp", variants).select("fp", "k.j", "k.v")
    shared = keys.groupBy("j", "v").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes the variants by the rows before they are exploded, a 64th of them, and would broadcast them: both joins say how they are done.
    keys = materialise(keys.join(shared.hint("shuffle_merge"), ["j", "v"]), "simhash-variants")
    # j < 32: the low half is the segment, the four bytes are those of the high half; and the other way round.
    other = F.array(*[F.struct(F.lit(q).alias("q"), F.shiftrightunsigned("fp", 8 * q).bitwiseAND(F.lit(255)).alias("byte")) for q in range(8)])
    cut = F.when(F.col("n") <= hot, F.array(F.struct(F.lit(-1).alias("q"), F.lit(0).cast("long").alias("byte")))).otherwise(F.when(F.col("j") < 32, F.slice(other, 5, 4)).otherwise(F.slice(other, 1, 4)))
    keys = keys.select("fp", "j", "v", F.explode(cut).alias("c")).select("fp", "j", "v", "c.q", "c.byte")
    a, b = keys.withColumnRenamed("fp", "a"), keys.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    low = differ.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(differ, 32)
    # The first variant that a pair shares reports it, so that no pair is reported for each of them.
    first = F.when(F.bit_count(low) == 0, 0).when(F.bit_count(low) == 1, F.log2(low)).when(F.bit_count(high) == 0, 32).otherwise(32 + F.log2(high))
    pairs = a.join(b.hint("shuffle_merge"), ["j", "v", "q", "byte"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= 3) & (F.col("j") == F.round(first)))
    return pairs.select("a", "b").distinct()


def simhash_components(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    fps = materialise(fingerprints(documents), "fingerprints")
    distinct = materialise(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints-distinct")
    groups = distinct.join(components(links(distinct.select("fp"))), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    groups = materialise(groups, "fingerprints-grouped")
    named = groups.join(groups.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
