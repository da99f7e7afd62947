"""Coverage of windows and data-driven thresholds. Thresholds are one-row tables; crossing with one is a broadcast of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import seconds_between, week_tue
from tidegauge.operators.aggregates import STREAM, quality
from tidegauge.operators.order import place, quantiles, running_total


def gap_ratio() -> Column:
    return F.col("longest_gap_seconds") / F.nullif(F.col("median_step_seconds"), F.lit(0.0))


def window_coverage(aggregates: DataFrame, stream_quality: DataFrame) -> DataFrame:
    """Each window with the share of its expected points (by the stream's median step) that it has; streams without a positive median step have no row."""
    steps = stream_quality.where("median_step_seconds > 0").select(*STREAM, "median_step_seconds")
    expected = F.floor(seconds_between("window_start", "window_end") / F.col("median_step_seconds")) + 1.0
    covered = F.least(F.lit(1.0), F.col("count") / F.greatest(F.lit(1.0), expected))
    return aggregates.join(steps, STREAM).withColumn("window_coverage", covered).drop("median_step_seconds")


def quality_reference(stream_quality: DataFrame, digits: int = 4) -> DataFrame:
    """One row: abstain and answer thresholds of coverage (p10, p75) and gap ratio (p95, p50) over all streams."""
    q = quantiles(stream_quality, [], F.col("observed_fraction"), {"low": 0.10, "high": 0.75}).select(F.array("low", "high").alias("q"))
    g = quantiles(stream_quality, [], gap_ratio(), {"mid": 0.50, "long": 0.95}).select(F.array("mid", "long").alias("g"))
    return _thresholds(q.crossJoin(F.broadcast(g)), digits)


def _thresholds(row: DataFrame, digits: int) -> DataFrame:
    return row.select(
        F.round(F.col("q")[0], digits).alias("abstain_observed_fraction_below"),
        F.round(F.col("q")[1], digits).alias("answer_observed_fraction_at_least"),
        F.round(F.col("g")[0], digits).alias("answer_gap_ratio_at_most"),
        F.round(F.col("g")[1], digits).alias("abstain_gap_ratio_above"),
    )


def week_quality(obs: DataFrame) -> DataFrame:
    """Quality metrics of each stream and Tuesday week."""
    return quality(obs.withColumn("window_start", week_tue("ts")), [*STREAM, "window_start"])


def window_reference_week(windows: DataFrame, digits: int = 4, per_stream: int = 8, per_site: int = 8000, enough: int = 2000) -> DataFrame:
    """One row of thresholds from sampled weeks: each stream's first windows, a site's first rows, and no more once both metrics were seen often enough.

    The sampling is the feature: it is the rule by which the thresholds are defined. windows: week_quality rows.
    """
    stream = Window.partitionBy(*STREAM).orderBy("window_start")
    order = ["site_id", "stream_id", "window_start"]
    ranked = place(windows.select("*", F.row_number().over(stream).alias("k"), gap_ratio().alias("ratio")), ["site_id"], order[1:], "s")
    sample = ranked.where((F.col("k") <= per_stream) & (F.col("s") <= per_site)).select(*order, "observed_fraction", "ratio")
    ok, known = F.col("observed_fraction").isNotNull().cast("int"), F.col("ratio").isNotNull().cast("int")
    seen = running_total(running_total(sample, [], order, ok, "n_observed"), [], order, known, "n_ratio")
    # What rows before this one have.
    used = seen.where(F.least(F.col("n_observed") - ok, F.col("n_ratio") - known) < enough)
    q = F.percentile("observed_fraction", F.array(F.lit(0.10), F.lit(0.75)))
    g = F.percentile("ratio", F.array(F.lit(0.50), F.lit(0.85)))
    return _thresholds(used.agg(q.alias("q"), g.alias("g")), digits)


def window_reference_from_coverage(covered: DataFrame, reference: DataFrame, digits: int = 4) -> DataFrame:
    """Day and month thresholds: coverage from the aggregates, gap thresholds from all streams."""
    q = quantiles(covered, [], F.col("window_coverage"), {"low": 0.10, "high": 0.75})
    row = q.select(F.round("low", digits).alias("abstain_observed_fraction_below"), F.round("high", digits).alias("answer_observed_fraction_at_least"))
    return row.crossJoin(F.broadcast(reference.select("answer_gap_ratio_at_most", "abstain_gap_ratio_above")))
