"""Neighbouring windows with data, dialogue states and interaction modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import exact_mean, rounded, shifted, week_mon
from tidegauge.operators.aggregates import quality
from tidegauge.operators.asof import rows_in_windows
from tidegauge.operators.thresholds import gap_ratio


def adjacent_window(obs: DataFrame, windows: DataFrame, digits: int | None = 4) -> DataFrame:
    """For each window (request_id, stream_id, window_start, window_end) the one before it, or after it if that is empty; windows with neither have no row."""
    s, e = "window_start", "window_end"
    step = F.explode(F.array(F.struct(F.lit("previous").alias("direction"), F.lit(-1).alias("n")), F.struct(F.lit("next").alias("direction"), F.lit(1).alias("n"))))
    moved = windows.select("request_id", "stream_id", s, e, step.alias("m"))
    both = moved.select(F.concat_ws("|", "request_id", "m.direction").alias("request_id"), F.col("request_id").alias("window_id"), "stream_id", F.col("m.direction").alias("direction"), shifted(s, s, e, F.col("m.n")).alias(s), shifted(e, s, e, F.col("m.n")).alias(e))
    stats = rows_in_windows(obs.where("value is not null and not isnan(value)"), both).groupBy("window_id", "direction", "stream_id", s, e).agg(rounded(exact_mean("value", F.nullif(F.count("value"), F.lit(0))), digits).alias("mean_value"), F.count("value").alias("count"))
    best = stats.where("count > 0").withColumn("k", F.row_number().over(Window.partitionBy("window_id").orderBy(F.desc("direction")))).where("k = 1")
    return best.select(F.col("window_id").alias("request_id"), "direction", "stream_id", s, e, "mean_value", "count")


def moved_windows(windows: DataFrame, *carry: str) -> DataFrame:
    """Each window (request_id, window_start, window_end) one length before and after, as window_id, with place 0 for the one before."""
    s, e = "window_start", "window_end"
    step = F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("previous").alias("direction"), F.lit(-1).alias("n")), F.struct(F.lit(1).alias("place"), F.lit("next").alias("direction"), F.lit(1).alias("n"))))
    moved = windows.select("request_id", s, e, *carry, step.alias("m"))
    return moved.select(F.col("request_id").alias("window_id"), "m.place", "m.direction", *carry, shifted(s, s, e, F.col("m.n")).alias(s), shifted(e, s, e, F.col("m.n")).alias(e))


def _means(obs: DataFrame, tries: DataFrame, digits: int | None) -> DataFrame:
    """Mean and count of each (window_id, place, stream_id) whose window has values."""
    asked = tries.withColumn("request_id", F.concat_ws("|", "window_id", "place", "stream_id"))
    rows = rows_in_windows(obs.where("value is not null and not isnan(value)"), asked).where("value is not null")
    return rows.groupBy("window_id", "place", "direction", "stream_id", "window_start", "window_end").agg(rounded(exact_mean("value"), digits).alias("mean_value"), F.count("value").alias("count"))


def _first_place(rows: DataFrame, *fields: str) -> DataFrame:
    best = rows.groupBy("window_id").agg(F.min(F.struct("place", *fields)).alias("b"))
    return best.select(F.col("window_id").alias("request_id"), *[f"b.{f}" for f in fields])


def adjacent_compare(obs: DataFrame, windows: DataFrame, digits: int | None = 4) -> DataFrame:
    """For each (request_id, left_stream_id, right_stream_id, window_start, window_end) the window before, else after, in which both streams have values, and its winner.

    The left one wins only if it is strictly larger.
    """
    tries = moved_windows(windows, "left_stream_id", "right_stream_id")
    sides = tries.withColumn("stream_id", F.explode(F.array_distinct(F.array("left_stream_id", "right_stream_id"))))
    keys = ["window_id", "place"]
    means = _means(obs, sides, digits)
    left, right = (means.select(*keys, F.col("stream_id").alias(f"{x}_stream_id"), F.col("mean_value").alias(f"{x}_mean_value")) for x in ("left", "right"))
    both = tries.join(left, [*keys, "left_stream_id"]).join(right, [*keys, "right_stream_id"])
    winner = F.when(F.col("left_mean_value") > F.col("right_mean_value"), F.col("left_stream_id")).otherwise(F.col("right_stream_id"))
    return _first_place(both.withColumn("winning_stream_id", winner), "direction", "window_start", "window_end", "left_mean_value", "right_mean_value", "winning_stream_id")


def adjacent_rank(obs: DataFrame, windows: DataFrame, members: DataFrame, digits: int | None = 4) -> DataFrame:
    """For each (request_id, group, window_start, window_end) the window before, else after, in which a member (group, stream_id) has values, and the largest mean there."""
    tries = moved_windows(windows, "group").join(members.select("group", "stream_id"), "group")
    best = _means(obs, tries, digits).groupBy("window_id", "place", "direction", "window_start", "window_end").agg(F.max(F.struct("mean_value", "stream_id")).alias("top"))
    return _first_place(best.select("window_id", "place", "direction", "window_start", "window_end", "top.stream_id", "top.mean_value"), "direction", "window_start", "window_end", "stream_id", "mean_value")


def adjacent_quality(obs: DataFrame, windows: DataFrame) -> DataFrame:
    """For each (request_id, stream_id, window_start, window_end) the window before, else after, that has metrics of quality, and these."""
    tries = moved_windows(windows, "stream_id").withColumn("request_id", F.concat_ws("|", "window_id", "place"))
    rows = rows_in_windows(obs, tries.select("request_id", "stream_id", "window_start", "window_end")).where("ts is not null")
    metrics = quality(rows, ["request_id"]).withColumn("gap_ratio", F.round(gap_ratio(), 4)).where("observed_fraction is not null or gap_ratio is not null")
    return _first_place(tries.join(metrics, "request_id"), "direction", "stream_id", "window_start", "window_end", "observed_fraction", "gap_ratio")


def week_around(obs: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each anchor (request_id, stream_id, anchor_ts) the Monday week that holds it, or the one before, or the one after: the first with data."""
    weeks = obs.where("ts is not null").groupBy("stream_id", week_mon("ts").alias("window_start")).agg(F.count("*").alias("count"))
    # A week is offered to itself, to the one after it and to the one before it, so that rows are counted once and not for each anchor.
    offered = weeks.select("*", F.posexplode(F.array(F.lit(0), F.lit(7), F.lit(-7))).alias("place", "days")).withColumn("_week", F.col("window_start") + F.make_dt_interval(F.col("days")))
    best = offered.groupBy("stream_id", "_week").agg(F.min(F.struct("place", "window_start", "count")).alias("b"))
    found = anchors.select("request_id", "stream_id", week_mon("anchor_ts").alias("_week")).join(best, ["stream_id", "_week"])
    return found.select("request_id", "stream_id", "b.window_start", (F.col("b.window_start") + F.make_dt_interval(F.lit(7))).alias("window_end"), "b.count")


def dialogue_states(turns: DataFrame) -> DataFrame:
    """The state of each turn (conv_id, turn, role): setup, request, clarify, answer, revision, revised_answer; the last turn of a conversation stops it.

    Roles seen before a turn decide its state, so that counts over the conversation's order replace a loop over it.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def seen(role: str):
        return F.coalesce(F.sum((F.col("role") == role).cast("int")).over(before), F.lit(0))

    state = (
        F.when(F.col("role") == "system", "setup")
        .when(F.col("role") == "user", F.when(seen("assistant") > 0, "revision").when(seen("user") > 0, "clarify").otherwise("request"))
        .otherwise(F.when(seen("assistant") > 0, "revised_answer").otherwise("answer"))
    )
    return turns.select("conv_id", "turn", "role", state.alias("state"), F.lead("turn").over(w).isNull().alias("stops"))


def interaction_modes(states: DataFrame) -> DataFrame:
    """The mode of each conversation: its distinct states in order of first appearance, joined by _then_."""
    first = states.where("state <> 'setup'").groupBy("conv_id", "state").agg(F.min("turn").alias("turn"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "state"))), lambda x: x["state"])
    return first.groupBy("conv_id").agg(F.array_join(ordered, "_then_").alias("mode"))
