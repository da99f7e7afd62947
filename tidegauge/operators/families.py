"""Catalog-level families over a summary with one row per stream: means, extremes, coverage, ranks, pairs, variability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.order import place


def unique_points(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Streams whose key no other stream has, as a semi-join."""
    single = summary.groupBy(*keys).agg(F.countDistinct("stream_id").alias("n")).where("n = 1")
    return summary.join(single, keys, "left_semi")


def metadata_only(inventory: DataFrame, summary: DataFrame) -> DataFrame:
    return inventory.join(summary, "stream_id", "left_anti")


def numbered(rows: DataFrame, order: list[str], splits: int = 5) -> DataFrame:
    """ordinal from 0 within the site, and a split: every fifth row of a site is dev, every fifth but one test."""
    k = F.col("ordinal")
    return place(rows, ["site_id"], order, "ordinal").withColumn("ordinal", k - 1).withColumn("split", F.when(k % splits == splits - 1, "dev").when(k % splits == splits - 2, "test").otherwise("train"))


def point_extrema(summary: DataFrame, order: list[str]) -> DataFrame:
    """Least and greatest value by turns."""
    rows = numbered(summary, order)
    even = F.col("ordinal") % 2 == 0
    return rows.select("site_id", "stream_id", "split", F.when(even, "min_value").otherwise("max_value").alias("metric"), F.when(even, F.col("min_value")).otherwise(F.col("max_value")).alias("value"))


def leaders(summary: DataFrame, groups: list[str], metric: str, margin: float) -> DataFrame:
    """The stream with the largest metric of each group and the runner-up, where they are at least `margin` apart; equal ones go by stream_id."""
    w = Window.partitionBy(*groups).orderBy(F.desc(metric), "stream_id")
    rows = summary.where(F.col(metric).isNotNull()).select(*groups, F.col("stream_id").alias("top_stream_id"), F.col(metric).alias("top_value"), F.lead("stream_id").over(w).alias("runner_stream_id"), F.lead(metric).over(w).alias("runner_value"), F.row_number().over(w).alias("k"))
    return rows.where((F.col("k") == 1) & (F.col("top_value") - F.col("runner_value") >= margin)).drop("k")


def neighbours(summary: DataFrame, groups: list[str], metric: str, margin: float) -> DataFrame:
    """Streams next to each other by id within a group whose metrics differ by at least `margin`, and which is larger."""
    w = Window.partitionBy(*groups).orderBy("stream_id")
    rows = summary.select(*groups, F.col("stream_id").alias("left_stream_id"), F.col(metric).alias("left_value"), F.lead("stream_id").over(w).alias("right_stream_id"), F.lead(metric).over(w).alias("right_value"))
    winner = F.when(F.col("left_value") > F.col("right_value"), F.col("left_stream_id")).otherwise(F.col("right_stream_id"))
    return rows.where(F.abs(F.col("left_value") - F.col("right_value")) >= margin).withColumn("winner", winner)


def every_nth(rows: DataFrame, order: list[str], n: int, cap: int) -> DataFrame:
    """Every n-th row in order, from the first on, at most cap of them."""
    return place(rows, ["site_id"], order, "_k").where((F.col("_k") % n == 1) & (F.col("_k") <= n * cap)).drop("_k")
