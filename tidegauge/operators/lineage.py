"""Which archive member a stream comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def with_lineage(inventory: DataFrame, members: DataFrame) -> DataFrame:
    """The inventory with each stream's first member by name, and has_raw."""
    first = first_by(members, ["stream_id"], "member_name")
    return inventory.join(first, "stream_id", "left").withColumn("has_raw", F.col("member_name").isNotNull())
