"""Line dedup with levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without space characters at its ends and with A-Z in lower case. Keys of at least min_chars code points that min_docs
documents hold lose all their lines except in the largest doc_id that holds them.

Documents come in batches. Each batch is merge-anti-joined with the runs: keys that no run holds make a new sorted run, and keys that one holds are
added to the levels of repeats, with their counts. A level of fan_out runs is compacted into one run of the next level, so that a batch meets
about fan_out * log(batches) runs.

Null and empty texts are one empty line and stay. Rows without doc_id stay whole and count for no key. Repeated rows count as one document; rows
that share a doc_id but not the text are one document for the count, and each loses its own lines. Very long texts cost in proportion to their lines. Lines that tie in one
document go or stay together. An empty table gives an empty result; columns that carry doesn't name are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import join_spread, materialise

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else; lower() is the same, and much faster, where all characters are ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(documents: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_id, line_no, h1, h2: the 128-bit hash of every line that is long enough to be dropped."""
    lines = documents.where("doc_id is not null").select("doc_id", text_id(F.col("text")).alias("text_id"), F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    # Both ends go before the length is known, but a shorter line can't have a long enough key.
    long = lines.where(F.length("line") >= min_chars).withColumn("key", ascii_lower(F.btrim(F.col("line"), F.lit(SPACES))))
    return long.where(F.length("key") >= min_chars).select("doc_id", "text_id", "line_no", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class Levels:
    """Sorted runs of (h1, h2, n_docs, max_doc) by level; a full level is merged into one run of the next."""

    def __init__(self, name: str, fan_out: int) -> None:
        self.name, self.fan_out, self.levels = name, fan_out, [[]]

    def add(self, run: DataFrame, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        # Ranges of hashes go to tasks, each sorted: readers skip by the files' bounds, and a later merge moves little.
        self.levels[level].append(materialise(run.sortWithinPartitions(*KEY), f"{self.name}-{level}"))
        if len(self.levels[level]) >= self.fan_out:
            merged, self.levels[level] = merge(self.levels[level]), []
            self.add(merged, level + 1)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]


def merge(runs: list[DataFrame]) -> DataFrame:
    together = reduce(DataFrame.unionByName, runs)
    return together.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))


def add_batch(batch: DataFrame, first: Levels, again: Levels) -> None:
    """batch: (h1, h2, doc_id) of documents of which no other batch has any."""
    counted = batch.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
    if not first.all():
        first.add(counted)
        return
    counted = materialise(counted, "line-batch")
    known = reduce(DataFrame.unionByName, [r.select(*KEY) for r in first.all()])
    again.add(counted.join(known, KEY, "left_semi"))
    first.add(counted.join(known, KEY, "left_anti"))


def repeated_keys(keys: DataFrame, min_docs: int = 3, batches: int = 4, fan_out: int = 3) -> DataFrame:
    """h1, h2, n_docs, max_doc of the keys that at least min_docs documents hold; keys: (doc_id, h1, h2, batch)."""
    first, again = Levels("line-first", fan_out), Levels("line-again", fan_out)
    for b in range(batches):
        add_batch(keys.where(F.col("batch") == b), first, again)
    return merge(first.all() + again.all()).where(F.col("n_docs") >= min_docs)


def line_dedup(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped and the columns named in carry, for each row of documents."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    keys = materialise(line_keys(documents, min_chars).select("*", batch), "line-keys", "batch")
    repeated = materialise(repeated_keys(keys, min_docs, batches), "line-repeated")
    drops = (
        join_spread(keys, repeated, KEY, "n_docs").where(F.col("doc_id") < F.col("max_doc"))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"))
        .agg(F.array_sort(F.collect_set("line_no")).alias("_drop"))
    )
    rows = documents.select("doc_id", "text", *carry)
    rows = rows.join(drops, (F.col("doc_id") == F.col("_doc")) & (text_id(F.col("text")) == F.col("_text")), "left")
    lines = split_lines(F.col("text"))
    # What lies between dropped lines is kept as slices, so that a text of many lines costs no more than its length.
    kept = F.expr(
        "flatten(transform(sequence(0, size(_drop)), k -> slice(_lines, if(k = 0, 0, _drop[k - 1] + 1) + 1,"
        " if(k = size(_drop), size(_lines), _drop[k]) - if(k = 0, 0, _drop[k - 1] + 1))))"
    )
    rows = rows.withColumn("_lines", lines)
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select("doc_id", text.alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), *carry)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
