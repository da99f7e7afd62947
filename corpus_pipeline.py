"""A corpus pipeline of five stages: language, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) with docs the documents that the stage before it kept, and all but the last return the columns of documents.
Stages read whole tables and texts. Null and empty texts have no known language and go in the first stage; rows without doc_id stay whole, and link to nothing, until packing, which takes each
row on its own. Repeated rows count as one document of repeated lines and near copies, of which one stays. Very long texts are read whole. Of lines and copies that tie the largest and the smallest
doc_id stay. An empty table passes all stages empty. Extra columns go with the first stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.decontamination import contaminated
from tidegauge.llm.language_id import language_id
from tidegauge.llm.line_dedup import line_dedup
from tidegauge.llm.near_copies import without_near_copies
from tidegauge.llm.packing import pack
from tidegauge.llm.shared import release, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not `und`, and as likely as all others together."""
    found = language_id(docs, carry=("text", "lang", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that another one keeps; n_chars follows the text."""
    kept = line_dedup(docs, carry=("lang", "source", "n_chars"))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return without_near_copies(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places in sequences of 1024 tokens."""
    import public_tokenizers

    # Workers live on from stage to stage, so that what they remember adds to the memory of the others.
    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), remember=200_000)


def stage(f: Stage) -> Stage:
    """A stage that first removes what earlier stages left in the shared folder: their results are written tables by then.

    Rows go to Python in batches of 2000: with whole texts in them, the usual 10,000 take more memory than the work on them.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        return f(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", stage(known_language)),
    ("lines", stage(without_repeated_lines)),
    ("near_copies", stage(one_of_near_copies)),
    ("benchmark", stage(without_benchmark)),
    ("packing", stage(packed)),
]

#: Naive Bayes, SimHash and tokenizers are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is a table in the shared folder that the next one reads."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, f in STAGES[:-1]:
        out = f(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
