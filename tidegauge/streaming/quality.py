"""Quality metrics of streams, and ends of their windows, kept up to date as observations come in, in whatever order.

A batch is added to the rows of its days, and only the days that it touched are judged again, each into a partial result: counts, first and last rows, and how often each gap occurs. Metrics of a
stream follow from its days' partials and the gaps between neighbouring days, so that late rows count like others and no batch reads more than its days. A batch that is run again replaces
what it wrote. Batch and stream give the same metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import PERIODS, is_finite, seconds_between
from tidegauge.operators.aggregates import STREAM

DAY = [*STREAM, "day"]


def partials(rows: DataFrame) -> DataFrame:
    """For each stream and day (rows: site_id, stream_id, day, ts, value) what its metrics need; gaps maps seconds to how often they lie between neighbouring rows of the day."""
    ordered = Window.partitionBy(*DAY).orderBy("ts", "value")
    finite = is_finite("value")
    before = F.last(F.when(finite, F.col("value")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    steps = rows.where("ts is not null").select("*", seconds_between(F.lag("ts").over(ordered), F.col("ts")).alias("gap"), before.alias("before"))
    place = F.struct("ts", "value")
    counts = steps.groupBy(*DAY).agg(
        F.count("*").alias("n"), F.count(F.when(finite, 1)).alias("n_finite"), F.count(F.when(finite & (F.col("value") == 0), 1)).alias("n_zero"), F.count(F.when(finite & (F.col("value") == F.col("before")), 1)).alias("n_constant"),
        F.countDistinct("ts").alias("n_ts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min(F.when(finite, place)).alias("first"), F.max(F.when(finite, place)).alias("last"),
    )
    gaps = steps.where("gap is not null").groupBy(*DAY, "gap").agg(F.count("*").alias("c")).groupBy(*DAY).agg(F.collect_list(F.struct("gap", "c")).alias("gaps"))
    return counts.join(gaps, DAY, "left")


def metrics(parts: DataFrame) -> DataFrame:
    """The metrics of each stream (as aggregates.quality gives them) from the partials of its days."""
    days = Window.partitionBy(*STREAM).orderBy("day")
    earlier = days.rowsBetween(Window.unboundedPreceding, -1)
    # Between days: the gap from the last row before, and a finite value that the next day's first repeats.
    linked = parts.select(
        "*", seconds_between(F.lag("last_ts").over(days), F.col("first_ts")).alias("across"),
        (F.last("last.value", ignorenulls=True).over(earlier) == F.col("first.value")).alias("again"),
    )
    n, good = F.sum("n"), F.sum("n_finite")
    sums = linked.groupBy(*STREAM).agg(
        n.alias("n_points"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.round(1 - good / n, 6).alias("nan_fraction"), F.round(F.sum("n_zero") / F.nullif(good, F.lit(0)), 6).alias("zero_fraction"),
        F.round((F.sum("n_constant") + F.count(F.when(F.col("again"), 1))) / F.nullif(good - 1, F.lit(0)), 6).alias("constant_fraction"),
        # An instant lies in one day, so that days have no instants in common.
        F.round(1 - F.sum("n_ts") / n, 6).alias("duplicate_timestamp_fraction"),
    )
    one = F.array(F.struct(F.col("across").alias("gap"), F.lit(1).cast("long").alias("c")))
    kind = "array<struct<gap: double, c: bigint>>"
    every = linked.select(*STREAM, F.explode(F.concat(F.coalesce("gaps", F.array().cast(kind)), F.when(F.col("across").isNotNull(), one).otherwise(F.array().cast(kind)))).alias("g"))
    counted = every.groupBy(*STREAM, "g.gap").agg(F.sum("g.c").alias("c"))
    by_gap = Window.partitionBy(*STREAM).orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    positive = counted.where("gap > 0").select(*STREAM, "gap", "c", F.sum("c").over(by_gap).alias("upto"), F.sum("c").over(Window.partitionBy(*STREAM)).alias("total"))
    # The two middle places of the positive gaps.
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col("gap")))
    middle = positive.groupBy(*STREAM).agg(at(low).alias("a"), at(high).alias("b")).select(*STREAM, (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("raw_step"))
    longest = counted.groupBy(*STREAM).agg(F.max("gap").alias("longest_gap_seconds"))
    out = sums.join(middle, STREAM, "left").join(longest, STREAM, "left")
    covered = F.col("n_points") / (F.rint(seconds_between("first_ts", "last_ts") / F.col("raw_step")) + 1)
    observed = F.when(F.col("raw_step").isNotNull(), F.round(F.least(F.lit(1.0), covered), 6))
    return out.select(
        *STREAM, "n_points", "first_ts", "last_ts", F.round("raw_step", 7).alias("median_step_seconds"), "longest_gap_seconds", observed.alias("observed_fraction"),
        "nan_fraction", "zero_fraction", "constant_fraction", "duplicate_timestamp_fraction",
    )


def latest_partials(spark: SparkSession, path: str) -> DataFrame:
    """Of each stream and day what the last batch that touched it wrote."""
    every = spark.read.parquet(f"{path}/partials")
    rest = [c for c in every.columns if c not in (*DAY, "batch")]
    return every.groupBy(*DAY).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*DAY, "_s.*")


def run_available(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """Add what the source (site_id, stream_id, ts, value) holds now, and return the metrics of all that came so far; path is a folder that all machines share."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(*STREAM, "ts", "value", F.to_date("ts").alias("day")).where("ts is not null")
        # Days are folders, so that a later batch reads those that it touches and no others.
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/rows/batch={number}")
        # Read again, as the source need not give the same rows twice in one batch.
        own = batch.sparkSession.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
        touched = own.where(F.col("batch") == number).select(*DAY).distinct()
        days = [r["day"] for r in touched.select("day").distinct().collect()]
        if days:
            again = own.where(F.col("day").isin(days) & (F.col("batch") <= number)).drop("batch").join(touched, DAY, "left_semi")
            partials(again).write.mode("overwrite").parquet(f"{path}/partials/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return metrics(latest_partials(spark, path))


def with_ends(windows: DataFrame, period: str) -> DataFrame:
    """Windows (site_id, stream_id, window_start, ...) with the end that stored aggregates have: where the stream's next one starts, the last after 1, 7 or 31 days."""
    after = F.lead("window_start").over(Window.partitionBy(*STREAM).orderBy("window_start"))
    return windows.withColumn("window_end", F.coalesce(after, F.col("window_start") + F.make_dt_interval(F.lit(PERIODS[period][1]))))
