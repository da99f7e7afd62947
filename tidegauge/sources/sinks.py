"""Sinks: typed Parquet, views and tables, JSON lines by split, lineage CSV, training exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.schema import conform


def append_parquet(df: DataFrame, path: str, schema: StructType) -> None:
    """Append rows in the schema's columns and types."""
    conform(df, schema).write.mode("append").parquet(path)


def register(spark: SparkSession, paths: dict[str, str]) -> None:
    """A view of each Parquet table by name."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def save_tables(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").saveAsTable(name)


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def write_jsonl(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder for each split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_lineage_csv(rows: DataFrame, path: str, key: str, item: str) -> None:
    """key and its distinct items, sorted and joined by semicolons."""
    rows.groupBy(key).agg(F.concat_ws(";", F.array_sort(F.collect_set(item))).alias("items")).write.mode("overwrite").option("header", True).csv(path)


def training_rows(tasks: DataFrame, modes: list[str]) -> DataFrame:
    """Each task once for each export mode, its other columns as one JSON text."""
    fields = [c for c in tasks.columns if c not in ("task_id", "split")]
    each = F.explode(F.array(*map(F.lit, modes))).alias("mode")
    return tasks.select("task_id", "split", each, F.to_json(F.struct(*fields)).alias("body"))
