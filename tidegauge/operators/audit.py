"""Audits: rules that give a row for each problem, equality of tables, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, kind) for every rule that holds for a row; all rules in one pass. A rule that is null doesn't hold."""
    found = F.array(*[F.when(rule, F.lit(kind)) for kind, rule in rules.items()])
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("kind"))


def histogram(rows: DataFrame, *keys: str, top: int | None = None) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), *keys).limit(top)


def levels(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by all keys, by each subset of them from the right rolled up, and in all, in one scan."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def collisions(rows: DataFrame, signature: list[str], gold: str, key: str) -> DataFrame:
    """Signatures with several rows and several gold values, and the rows' keys."""
    grouped = rows.groupBy(*signature).agg(F.count("*").alias("n"), F.countDistinct(gold).alias("n_gold"), F.concat_ws(";", F.array_sort(F.collect_set(F.col(key).cast("string")))).alias("keys"))
    return grouped.where("n > 1 and n_gold > 1")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, and on which side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: count and an order-free sum of row hashes, to compare builds without moving them."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("rows_hash"))


def binding(traces: DataFrame, tasks: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem): traces without a task, tasks without a trace, and fields that differ (null equals null)."""
    t, s = traces.alias("t"), tasks.alias("s")
    both = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    differ = [F.when(F.col(f"t.{key}").isNotNull() & F.col(f"s.{key}").isNotNull() & ~F.col(f"t.{f}").eqNullSafe(F.col(f"s.{f}")), F.lit(f"differs_{f}")) for f in fields]
    all_ = F.array(F.when(F.col(f"s.{key}").isNull(), F.lit("no_task")), F.when(F.col(f"t.{key}").isNull(), F.lit("no_trace")), *differ)
    return both.select(F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}")).alias(key), F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("problem"))


def forbidden_tokens(lines: DataFrame, pattern: str) -> DataFrame:
    """path, line number and token of every match; lines: (path, n, line)."""
    return lines.select("path", "n", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("token"))


def first_blocking(layers: list[tuple[str, Column]]) -> Column:
    """The name of the first layer whose check fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in layers], F.lit("none"))


def numeric_summary(rows: DataFrame, name: str, numbers: str) -> DataFrame:
    """Least, median and greatest of each key of a map column, by `name`."""
    out = rows.select(name, F.explode(numbers).alias("key", "value")).groupBy(name, "key")
    return out.agg(F.min("value").alias("least"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("greatest"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
