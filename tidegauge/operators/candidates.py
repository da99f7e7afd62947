"""Candidate mining: the analytic families over points, window aggregates and quality.

points has site_id, stream_id, point_class, equipment_label, location_label, location_type and candidate_ambiguity. Ranks are total orders, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import seconds_between
from tidegauge.operators.aggregates import STREAM
from tidegauge.operators.order import place, quantiles
from tidegauge.operators.pairs import widest_pairs
from tidegauge.operators.thresholds import gap_ratio, window_coverage
from tidegauge.tables import materialise

# Which point classes take part.
VALID = "^[A-Z][A-Za-z0-9_]*$"
COMPATIBLE = "(_Sensor|_Setpoint|_Limit)$"
NO_AGGREGATION = "(^Time_|^Duration_Sensor$|_Energy_Sensor$|^Chilled_Water_Supply_Flow_Sensor$|_Parameter$)"
NO_TIMESTAMP = "(_Parameter$)"
NO_QUALITY = "(^Time_|^Duration_Sensor$|_Energy_Sensor$|_Parameter$|^Min_Limit$|^Max_Limit$)"


def usable_class(excluded: str | None = None) -> Column:
    """Named classes; with `excluded` only those of measured kinds, less the excluded ones."""
    c = F.col("point_class")
    named = c.isNotNull() & (c != "Point") & c.rlike(VALID)
    return named if excluded is None else named & c.rlike(COMPATIBLE) & ~c.rlike(excluded)


def unambiguous(excluded: str | None = None) -> Column:
    return (F.col("candidate_ambiguity") == 1) & F.col("equipment_label").isNotNull() & usable_class(excluded)


def rank(keys: Sequence[Column | str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def class_caps(points: DataFrame, aggregates: DataFrame, q: float = 0.995, least: int = 100) -> DataFrame:
    """The q-quantile of |mean| for each site and class with at least so many windows."""
    rows = points.where(usable_class(NO_AGGREGATION)).select(*STREAM, "point_class").join(aggregates.where("mean_value is not null").select(*STREAM, "mean_value"), STREAM)
    enough = rows.groupBy("site_id", "point_class").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return quantiles(rows, ["site_id", "point_class"], F.abs("mean_value"), {"max_abs_mean": q}).join(enough, ["site_id", "point_class"])


def supported_windows(points: DataFrame, aggregates: DataFrame, quality: DataFrame, keep: Column, q: float = 0.10) -> DataFrame:
    """Windows of points that `keep` lets in, with enough coverage (the q-quantile over all windows) and a mean under the cap of the class."""
    covered = window_coverage(aggregates, quality)
    cutoff = quantiles(covered, [], F.col("window_coverage"), {"min_window_coverage": q})
    rows = points.where(keep & usable_class(NO_AGGREGATION)).join(covered, STREAM).crossJoin(F.broadcast(cutoff))
    rows = rows.where(F.col("window_coverage") >= F.col("min_window_coverage")).join(class_caps(points, aggregates), ["site_id", "point_class"])
    return rows.where(F.abs("mean_value") <= F.col("max_abs_mean"))


def _window_columns() -> list[str]:
    return ["site_id", "stream_id", "point_class", "equipment_label", "location_label", "window_start", "window_end", "count", "window_coverage", "mean_value", "max_abs_mean", "site_rank"]


def mean_lookup(points: DataFrame, weekly: DataFrame, quality: DataFrame, per_site: int | None = None) -> DataFrame:
    """Each stream's first supported week with the site's rank over all candidate weeks; with per_site, for takers of a site's first ones, ranks up to it only."""
    rows = supported_windows(points, weekly, quality, unambiguous())
    ranked = place(rows.withColumn("own", rank(STREAM, "window_start")), ["site_id"], ["stream_id", "window_start"], "site_rank")
    first = ranked.where("own = 1").select(*_window_columns())
    return first if per_site is None else first.where(F.col("site_rank") <= per_site)


def quarter_lookup(points: DataFrame, daily: DataFrame, quality: DataFrame, latest: bool = False) -> DataFrame:
    """Each stream's first (or latest) supported day of every quarter."""
    day = F.col("window_start").desc() if latest else F.col("window_start").asc()
    rows = supported_windows(points, daily, quality, unambiguous())
    ranked = place(rows.withColumn("own", rank([*STREAM, F.quarter("window_start")], day)), ["site_id"], ["stream_id", day], "site_rank")
    return ranked.where("own = 1").select(*_window_columns())


def disambiguation(points: DataFrame, per_site: int = 2000) -> DataFrame:
    """Points of classes with at least two members, larger classes first."""
    sizes = points.where(unambiguous()).groupBy("site_id", "point_class").agg(F.count("*").alias("class_size")).where("class_size >= 2")
    rows = place(points.where("candidate_ambiguity = 1").join(sizes, ["site_id", "point_class"]), ["site_id"], [F.desc("class_size"), "stream_id"], "site_rank")
    return rows.where(F.col("site_rank") <= per_site).select("site_id", "stream_id", "point_class", "equipment_label", "location_label", "class_size", "site_rank")


def pairwise(points: DataFrame, weekly: DataFrame, quality: DataFrame, per_site: int = 2500) -> DataFrame:
    """Pairs of one class and week on different equipment, of which the means differ by at least the median of the class; pairs under it are counted, not made."""
    rows = supported_windows(points, weekly, quality, unambiguous())
    return widest_pairs(rows.withColumn("value", F.col("mean_value")), per_site)


def window_rank(points: DataFrame, monthly: DataFrame, quality: DataFrame, least: int = 3, per_site: int = 2000) -> DataFrame:
    """The winner of each site, location type, class and month with at least three streams, where its lead reaches the median lead.

    Winner and runner-up come from one window: lead() in place of joining the ranked rows with themselves.
    """
    group = ["site_id", "location_type", "point_class", "window_start", "window_end"]
    rows = supported_windows(points, monthly, quality, F.col("location_type").isNotNull())
    # A stream has one row a month, so that rows are streams. Groups by start alone decide places, those by start and end how many take part.
    by_mean = Window.partitionBy("site_id", "location_type", "point_class", "window_start").orderBy(F.desc("mean_value"), "stream_id")
    sized = rows.withColumn("n_streams", F.count("*").over(Window.partitionBy(*group))).where(F.col("n_streams") >= least)
    led = sized.select(
        *group, "n_streams", "window_coverage", F.col("stream_id").alias("top_stream_id"), F.col("mean_value").alias("top_mean_value"),
        F.lead("stream_id").over(by_mean).alias("runner_stream_id"), F.lead("mean_value").over(by_mean).alias("runner_mean_value"), F.row_number().over(by_mean).alias("pos"),
    ).where("pos = 1 and runner_stream_id is not null").drop("pos")
    led = led.withColumn("margin_value", F.abs(F.col("top_mean_value") - F.col("runner_mean_value")))
    led = materialise(led, "led")
    cut = quantiles(led, ["site_id", "location_type", "point_class"], F.col("margin_value"), {"min_margin": 0.5})
    good = led.join(cut, ["site_id", "location_type", "point_class"]).where((F.col("margin_value") > 0) & (F.col("margin_value") >= F.col("min_margin")))
    order = [F.desc("n_streams"), F.desc("margin_value"), "location_type", "point_class", "window_start", "top_stream_id", "runner_stream_id"]
    return place(good, ["site_id"], order, "site_rank").where(F.col("site_rank") <= per_site)


def timestamp_points(points: DataFrame, quality: DataFrame, positive_step: bool, per_site: int = 1200) -> DataFrame:
    rows = points.where(unambiguous(NO_TIMESTAMP)).join(quality.select(*STREAM, "median_step_seconds", "duplicate_timestamp_fraction"), STREAM)
    rows = rows.where(F.coalesce("duplicate_timestamp_fraction", F.lit(0.0)) == 0.0)
    rows = rows.where("median_step_seconds > 0") if positive_step else rows
    return place(rows, ["site_id"], ["point_class", "stream_id"], "site_rank").where(F.col("site_rank") <= per_site)


def _capped(rows: DataFrame, cap: int) -> DataFrame:
    """The first `cap` rows of a site in the order of class and stream."""
    return place(rows, ["site_id"], ["point_class", "stream_id"], "n").where(F.col("n") <= cap).drop("n")


def timestamp_value(points: DataFrame, quality: DataFrame, obs: DataFrame, cap: int = 180, least: int = 3) -> DataFrame:
    """The middle observation of each point with at least three."""
    chosen = timestamp_points(points, quality, False).select("site_id", "stream_id", "point_class", "site_rank")
    own = Window.partitionBy(*STREAM)
    rows = obs.where("ts is not null and value is not null").join(chosen, STREAM).withColumns({"i": F.row_number().over(own.orderBy("ts", "value")) - 1, "n": F.count("*").over(own)})
    middle = rows.where((F.col("n") >= least) & (F.col("i") == F.floor(F.col("n") / 2)))
    return _capped(middle.select("site_id", "stream_id", "point_class", F.col("ts").alias("requested_ts"), F.col("value").alias("observed_value")), cap)


def timestamp_nearest(points: DataFrame, quality: DataFrame, obs: DataFrame, cap: int = 180, least: int = 3) -> DataFrame:
    """A probe at four tenths of the first gap that is between half and one and a half median steps long (and at least a second)."""
    chosen = timestamp_points(points, quality, True).select("site_id", "stream_id", "point_class", "median_step_seconds")
    own = Window.partitionBy(*STREAM)
    ordered = own.orderBy("ts", "value")
    rows = obs.where("ts is not null and value is not null").join(chosen, STREAM).withColumns({"n": F.count("*").over(own), "left_ts": F.lag("ts").over(ordered), "left_value": F.lag("value").over(ordered)})
    rows = rows.withColumn("gap", seconds_between("left_ts", "ts"))
    fit = rows.where((F.col("n") >= least) & (F.col("gap") > 0) & (F.col("gap") >= F.greatest(F.lit(1.0), 0.5 * F.col("median_step_seconds"))) & (F.col("gap") <= 1.5 * F.col("median_step_seconds")))
    first = fit.withColumn("k", rank(STREAM, "ts", "value")).where("k = 1")
    return _capped(first.select("site_id", "stream_id", "point_class", F.col("left_ts").alias("observed_ts"), F.col("left_value").alias("observed_value"), F.round(F.col("gap") * 0.4, 3).alias("offset_seconds")), cap)


def quality_gate(points: DataFrame, weekly: DataFrame, quality: DataFrame, window_quality: DataFrame, thresholds: DataFrame) -> DataFrame:
    """All weeks that are clearly bad or clearly good, bad and good ones taking turns within a site.

    window_quality: metrics of each stream and week. Windows reach to the stream's next week, but nothing lies between, so that a join on the week's start finds all their rows.
    """
    covered = window_coverage(weekly, quality)
    rows = points.where(unambiguous(NO_QUALITY)).select(*STREAM, "point_class").join(covered.select(*STREAM, "window_start"), STREAM)
    metrics = window_quality.select(*STREAM, "window_start", "n_points", "observed_fraction", gap_ratio().alias("gap_ratio"), "duplicate_timestamp_fraction", "nan_fraction")
    judged = rows.join(metrics, [*STREAM, "window_start"]).where("observed_fraction is not null and n_points >= 2").crossJoin(F.broadcast(thresholds))
    decision = gate_decision()
    judged = judged.select("site_id", "stream_id", "point_class", "window_start", "observed_fraction", "gap_ratio", decision.alias("d")).where("d is not null")
    judged = judged.select("*", F.col("d.decision").alias("decision"), F.col("d.reason").alias("reason")).drop("d")
    # Taking turns: the k-th bad before the k-th good; 'abstain' comes before 'answer'.
    judged = place(judged, ["site_id", "decision"], ["point_class", "stream_id", "window_start"], "turn")
    return place(judged, ["site_id"], ["turn", "decision"], "place")


def gate_decision() -> Column:
    """Bad coverage, long gaps, or healthy; null where neither is clear. Thresholds that are null don't judge."""

    def answer(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))

    gap_ok = F.col("answer_gap_ratio_at_most").isNull() | F.col("gap_ratio").isNull() | (F.col("gap_ratio") <= F.col("answer_gap_ratio_at_most"))
    clean = (F.coalesce("duplicate_timestamp_fraction", F.lit(0.0)) == 0) & (F.coalesce("nan_fraction", F.lit(0.0)) == 0)
    return (
        F.when(F.col("observed_fraction") < F.col("abstain_observed_fraction_below"), answer("abstain", "low_coverage"))
        .when(F.col("gap_ratio") > F.col("abstain_gap_ratio_above"), answer("abstain", "long_gap"))
        .when((F.col("observed_fraction") >= F.col("answer_observed_fraction_at_least")) & gap_ok & clean, answer("answer", "healthy"))
    )
