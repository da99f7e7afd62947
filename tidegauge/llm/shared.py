"""What several operators share: intermediate tables, frequent rows, joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.tables import materialise, release, shared_folder, small_enough

__all__ = ["join_spread", "largest", "materialise", "release", "shared_folder", "small_enough"]


def largest(df: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the largest whole numbers in a column, at most `most` of them, without a sort: the cut lies between two levels of an eighth of an octave."""
    level = F.floor(8 * F.log2(F.col(column) + 1))
    cut, held = 1 << 10, 0
    for r in sorted(df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        if held + r["n"] > most:
            break
        cut, held = r["level"], held + r["n"]
    return df.where(level >= cut)


def join_spread(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n", parts: int = 1000) -> DataFrame:
    """rows joined with a written table of their keys, which has how often each occurs; keys of over a thousandth of all go by broadcast.

    Of these there are fewer than `parts`, whatever the data, so that the broadcast is bounded, and no key has more than a thousandth of the shuffled rows.
    """
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot, cold = F.broadcast(counted.where(F.col(n) * parts > total)), counted.where(F.col(n) * parts <= total)
    return rows.join(hot, keys, "left_anti").join(cold, keys).unionByName(rows.join(hot, keys))
