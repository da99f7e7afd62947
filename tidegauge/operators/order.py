"""Order statistics without a task that holds a whole group: places in an order by prefix sums over ranges, exact quantiles by narrowing to the bin that holds the rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.tables import materialise, small_enough


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    together = F.lit(True)
    for k in keys:
        together = together & a[k].eqNullSafe(b[k])
    return together


def running_total(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], amount: Column, name: str, ranges: int | None = None) -> DataFrame:
    """rows with the sum of `amount` over the rows of the same `by` up to each one, itself included, in the order; rows are written once.

    Rows are dealt into ranges of (by, order). Each range adds up by itself, and takes over what its group's earlier ranges have: a table with a row for each range and group in it.
    Rows that are equal in by and order stay in one range and follow each other in any order. Null keys form a group; null amounts count as 0.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if not by:
        return running_total(rows.withColumn("_all", F.lit(0)), ["_all"], order, amount, name, ranges).drop("_all")
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_amount", F.coalesce(amount, F.lit(0)).cast("long")).repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id())
    # Where ranges end is sampled anew by every job, so that it has to be written.
    dealt = materialise(dealt, "ranges")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range", *by).agg(F.sum("_amount").alias("_sum"))
    before = totals.select("_range", *by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum("_amount").over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn("_own", own)
    joined = summed.join(before, (summed["_range"] == before["_range"]) & _same(summed, before, by))
    return joined.select(*[summed[c] for c in rows.columns], (before["_before"] + summed["_own"]).alias(name))


def place(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str, ranges: int | None = None) -> DataFrame:
    """rows with their place, from 1, among the rows of the same `by` in a total order: row_number() with no task that sees a whole group."""
    return running_total(rows, by, order, F.lit(1), name, ranges)


def quantiles(rows: DataFrame, by: Sequence[str], value: Column, shares: dict[str, float], bounded: int = 100_000, bins: int = 64) -> DataFrame:
    """by..., a column for each share: the exact quantile, interpolated between neighbours, of the values that aren't null; groups without any have no row.

    While a group has more than `bounded` values left, sketches (of bounded size, merged before the shuffle) cut it into bins, values are counted by bin, and only the bin
    that holds the wanted place is kept: it has about a `bins`-th of the values, or repeats of a single one, which is then the answer. What is left is sorted by distinct
    value. All groups and shares narrow together, in about log(rows / bounded) / log(bins) rounds.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    base = materialise(rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], value.cast("double").alias("_v")).where("_v is not null"), "values")
    sizes = base.groupBy(*keys).agg(F.count("*").alias("left")).where("left > 0")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("share"), (F.lit(float(q)) * (F.col("left") - 1)).alias("at"), F.lit(step).alias("step")) for name, q in shares.items() for step in (0, 1)])).alias("w")
    none = F.lit(None).cast("double")
    # One row for each of the two neighbours of a place; what is left to it lies between low and high (null: no end), and rank counts from there.
    target = sizes.select(*keys, "left", wanted).select(
        *keys, "left", "w.share", "w.step", (F.col("w.at") - F.floor("w.at")).alias("part"), F.least(F.floor("w.at") + F.col("w.step"), F.col("left") - 1).cast("long").alias("rank"),
        none.alias("low"), none.alias("high"), none.alias("answer"),
    )
    target, rounds = materialise(target, "targets"), 0
    while (target.where("answer is null").agg(F.max("left")).first()[0] or 0) > bounded:
        target, rounds = materialise(_narrowed(base, target, keys, bins), "targets"), rounds + 1
    open_ = target.where("answer is null")
    # Where nothing was narrowed, all values are left.
    inside = _inside(base, open_, keys) if rounds else base.select(*keys, none.alias("low"), none.alias("high"), "_v")
    counted = inside.groupBy(*keys, "low", "high", "_v").agg(F.count("*").alias("c"))
    found = _at_rank(open_, counted, "_v", keys).withColumn("answer", F.col("_v")).select(*target.columns).unionByName(target.where("answer is not null"))
    a, b = (F.max(F.when(F.col("step") == k, F.col("answer"))) for k in (0, 1))
    both = found.groupBy(*keys, "share", "part").agg(a.alias("a"), b.alias("b")).withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return both.groupBy(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)]).agg(*[F.max(F.when(F.col("share") == name, F.col("q"))).alias(name) for name in shares])


def _inside(base: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """keys, low, high, _v: the values between each pair of ends that some target of their group has; targets of one group have few different ones."""
    ends = small_enough(materialise(target.select(*keys, "low", "high").distinct(), "ends"))
    within = (ends["low"].isNull() | (base["_v"] > ends["low"])) & (ends["high"].isNull() | (base["_v"] < ends["high"]))
    return base.join(ends, _same(base, ends, keys) & within).select(*[ends[c] for c in ends.columns], base["_v"])


def _at_rank(target: DataFrame, counted: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Targets with the row of `counted` (keys, low, high, order, c) in which their rank falls, and how many come up to its end."""
    group = [*keys, "low", "high"]
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    summed = counted.withColumn("upto", upto)
    falls = (summed["upto"] > target["rank"]) & (summed["upto"] - summed["c"] <= target["rank"])
    return target.join(summed, _same(target, summed, group) & falls).select(*[target[c] for c in target.columns], *[summed[c] for c in summed.columns if c not in group])


def _narrowed(base: DataFrame, target: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Targets with their bin in place of what was left to them."""
    open_ = target.where("answer is null")
    inside, group = _inside(base, open_, keys), [*keys, "low", "high"]
    cuts = inside.groupBy(*group).agg(F.array_distinct(F.percentile_approx("_v", [i / bins for i in range(bins + 1)], 20 * bins)).alias("cuts"))
    cuts = small_enough(materialise(cuts, "cuts"))
    joined = inside.join(cuts, _same(inside, cuts, group)).select(*[inside[c] for c in inside.columns], cuts["cuts"])
    # The i-th cut itself is bin 2i - 1, what lies between it and the next bin 2i: repeats of a value stand alone.
    at = F.size(F.filter("cuts", lambda c: c <= F.col("_v")))
    bin_ = 2 * at - F.when((at > 0) & (F.get("cuts", at - 1) == F.col("_v")), 1).otherwise(0)
    counted = joined.groupBy(*group, "cuts", bin_.alias("bin")).agg(F.count("*").alias("c"))
    hit = _at_rank(open_, counted, "bin", keys).withColumns({"half": F.floor(F.col("bin") / 2).cast("int"), "alone": F.col("bin") % 2 == 1})
    new = hit.select(
        *[F.col(c) for c in open_.columns if c not in ("rank", "left", "answer", "low", "high")],
        (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), F.col("c").alias("left"), F.when(F.col("alone"), F.get("cuts", F.col("half"))).alias("answer"),
        F.coalesce(F.when(~F.col("alone") & (F.col("half") > 0), F.get("cuts", F.col("half") - 1)), F.col("low")).alias("low"),
        F.coalesce(F.when(~F.col("alone"), F.get("cuts", F.col("half"))), F.col("high")).alias("high"),
    )
    return new.select(*target.columns).unionByName(target.where("answer is not null"))
