"""Window aggregates, calendar profiles, quality metrics, previews and inventories of observations (site_id, stream_id, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import PERIODS, candidate_key, exact_mean, hour_of, is_finite, seconds_between
from tidegauge.tables import tasks_for

STREAM = ["site_id", "stream_id"]


def summarize(obs: DataFrame, period: str) -> DataFrame:
    """Statistics of finite values per stream and day, Tuesday week or month. A window ends where the stream's next one starts, the last after 1, 7 or 31 days."""
    bucket, days = PERIODS[period]
    # Nearly every row may be a group of its own, so that sums before the shuffle would fill a task with as many buffers as its split has rows.
    rows = obs.where(is_finite("value")).select(*STREAM, bucket("ts").alias("window_start"), "value")
    n = tasks_for(rows)
    stats = rows.repartition(n, *STREAM, "window_start").groupBy(*STREAM, "window_start").agg(*_statistics()).repartition(n, *STREAM)
    after = F.lead("window_start").over(Window.partitionBy(*STREAM).orderBy("window_start"))
    end = F.coalesce(after, F.col("window_start") + F.make_dt_interval(F.lit(days)))
    return stats.select(*STREAM, F.lit(period).alias("period"), "window_start", end.alias("window_end"), "count", "mean_value", "std_value", "min_value", "max_value")


def _statistics() -> list:
    """Count, mean, sample deviation (null for one value), least and greatest."""
    return [F.count("*").alias("count"), exact_mean("value").alias("mean_value"), F.round(F.stddev_samp("value"), 4).alias("std_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")]


def calendar_profile(obs: DataFrame) -> DataFrame:
    """Statistics per stream, day of the week (0 is Monday) and hour."""
    day, hour = F.weekday("ts").cast("bigint"), F.hour("ts").cast("bigint")
    return obs.where(is_finite("value")).groupBy(*STREAM, day.alias("day_of_week"), hour.alias("hour_of_day")).agg(*_statistics())


def hourly_mean(obs: DataFrame) -> DataFrame:
    """Mean per stream and hour over all rows, however they are dealt to files."""
    return obs.where("ts is not null and value is not null").groupBy(*STREAM, hour_of("ts").alias("hour")).agg(exact_mean("value").alias("mean_value"), F.count("*").alias("count"))


def quality(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Coverage, gaps and fractions per stream (or per keys); see the fields of schema.QUALITY.

    The median step is over positive steps; a stream without one has no observed fraction. Values that are equal to the one before count as constant
    among finite values in order.
    """
    keys = keys or STREAM
    ordered = Window.partitionBy(*keys).orderBy("ts", "value")
    finite = is_finite("value")
    # The last finite value before this row: values that are not finite don't part two equal ones.
    before = F.last(F.when(finite, F.col("value")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    steps = obs.where("ts is not null").select(*keys, "ts", "value", seconds_between(F.lag("ts").over(ordered), F.col("ts")).alias("gap"), before.alias("before"))
    # The median from the places of steps in a second order of the same groups: sorting spills, and a group has no buffer that grows with its steps.
    step = F.when(F.col("gap") > 0, F.col("gap"))
    by_step = Window.partitionBy(*keys).orderBy(step.asc_nulls_last())
    m = F.count(step).over(by_step.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    steps = steps.select("*", step.alias("step"), F.row_number().over(by_step).alias("place"), m.alias("m"))
    low, high = (F.max(F.when(F.col("place") == p, F.col("step"))) for p in (F.floor((F.col("m") + 1) / 2), F.floor(F.col("m") / 2) + 1))
    n, good = F.count("*"), F.count(F.when(finite, 1))
    # In order of time an instant is new where a step leads to it.
    instants = F.count(F.when(F.col("gap").isNull() | (F.col("gap") > 0), 1))
    out = steps.groupBy(*keys).agg(
        n.alias("n_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.when(F.max("m") % 2 == 1, low).otherwise(0.5 * low + 0.5 * high).alias("raw_step"), F.max("gap").alias("longest_gap_seconds"),
        F.round(1 - good / n, 6).alias("nan_fraction"),
        F.round(F.count(F.when(finite & (F.col("value") == 0), 1)) / F.nullif(good, F.lit(0)), 6).alias("zero_fraction"),
        F.round(F.count(F.when(finite & (F.col("value") == F.col("before")), 1)) / F.nullif(good - 1, F.lit(0)), 6).alias("constant_fraction"),
        F.round(1 - instants / n, 6).alias("duplicate_timestamp_fraction"),
    )
    covered = F.col("n_points") / (F.rint(seconds_between("first_ts", "last_ts") / F.col("raw_step")) + 1)
    observed = F.when(F.col("raw_step").isNotNull(), F.round(F.least(F.lit(1.0), covered), 6))
    return out.select(
        *keys, "n_points", "first_ts", "last_ts", F.round("raw_step", 7).alias("median_step_seconds"), "longest_gap_seconds", observed.alias("observed_fraction"),
        "nan_fraction", "zero_fraction", "constant_fraction", "duplicate_timestamp_fraction",
    )


def inventory_summary(inventory: DataFrame, obs: DataFrame) -> DataFrame:
    """The inventory with count, distinct values, first and last instant and statistics of each stream that has observations; deviation 0 for one value."""
    # By value first, as distinct values are counted; each task has a bounded number of them.
    rows = obs.select(*STREAM, "ts", "value")
    stats = rows.repartition(tasks_for(rows), *STREAM, "value").groupBy(*STREAM).agg(
        F.count("value").alias("n_points"), F.countDistinct("value").alias("n_distinct"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), exact_mean("value").alias("mean_value"),
        F.coalesce(F.round(F.stddev_samp("value"), 4), F.lit(0.0)).alias("std_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    )
    return inventory.join(stats, STREAM)


def with_ambiguity(inventory: DataFrame, *fields: str) -> DataFrame:
    """candidate_key of site, class, equipment and location, and how many streams share it."""
    keyed = inventory.withColumn("candidate_key", candidate_key(*(fields or ("site_id", "point_class", "equipment_label", "location_label"))))
    return keyed.withColumn("candidate_ambiguity", F.count("stream_id").over(Window.partitionBy("candidate_key")))


def previews(obs: DataFrame, points: int = 96) -> DataFrame:
    """At most `points` rows of each stream: all where it has no more, else evenly spaced with first and last."""
    ordered = Window.partitionBy(*STREAM)
    clean = obs.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    ranked = clean.select("*", (F.row_number().over(ordered.orderBy("ts", "value")) - 1).cast("bigint").alias("i"), F.count("*").over(ordered).alias("n"))
    # Place k of the spacing is the row floor(k (n-1) / (points-1)), and a row is taken if some k lands on it.
    step = (F.col("n") - 1) / F.lit(float(points - 1))
    near = F.ceil(F.col("i") / step)
    hits = F.exists(F.array(near - 1, near, near + 1), lambda k: (k >= 0) & (k < points - 1) & (F.floor(k * step) == F.col("i")))
    return ranked.where((F.col("n") <= points) | (F.col("i") == F.col("n") - 1) | hits).select(*STREAM, "i", "ts", "value")


def preview_arrays(obs: DataFrame, points: int = 96) -> DataFrame:
    return previews(obs, points).groupBy(*STREAM).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("points"))
