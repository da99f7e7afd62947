"""Balanced selection of tasks into splits, without a loop over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.order import place, running_total


def with_split(rows: DataFrame, order: list, held_out: str) -> DataFrame:
    """test for held-out rows; of the others every fifth is dev. The count runs over all of them, also those that are not selected later."""
    counted = running_total(rows, [], order, F.when(F.expr(held_out), 0).otherwise(1), "_seen")
    return counted.withColumn("split", F.when(F.expr(held_out), "test").when((F.col("_seen") - 1) % 5 == 4, "dev").otherwise("train")).drop("_seen")


def take_by_split(rows: DataFrame, order: list, held_out: str, balance: list[str], targets: dict[str, int], caps: dict[str, int]) -> DataFrame:
    """In order, at most caps[split] rows of each balance key and then at most targets[split] rows of each split."""
    split = with_split(rows, order, held_out)

    def limit(values: dict[str, int]):
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("split"))

    capped = place(split, ["split", *balance], order, "_k").where(F.col("_k") <= limit(caps)).drop("_k")
    return place(capped, ["split"], order, "ordinal").where(F.col("ordinal") <= limit(targets))


def identity_problems(candidates: DataFrame, contract: DataFrame, key: str) -> DataFrame:
    """Records of the contract that no candidate or several candidates answer: (key, problem)."""
    several = candidates.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").join(contract, key, "left_semi").select(key, F.lit("several").alias("problem"))
    missing = contract.join(candidates, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return several.unionByName(missing)


def diversity_subset(rows: DataFrame, mode: str, order: list, per_mode: int, total: int) -> DataFrame:
    """Up to per_mode rows of each mode first, then the rest in order, up to total."""
    k = F.row_number().over(Window.partitionBy(mode).orderBy(*order))
    return rows.withColumn("_later", (k > per_mode).cast("int")).orderBy("_later", *order).limit(total).drop("_later")
