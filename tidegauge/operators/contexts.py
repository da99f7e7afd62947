"""What the phases of a task stand on: streams, windows and periods, the quality there, how hard a task is, and where it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import typed as J
from tidegauge.operators.planning import decision
from tidegauge.operators.sequences import Tool
from tidegauge.tables import materialise

DAYS = ("day_mean_lookup", "relative_24h_mean_lookup")
#: Families whose window stands in their tool's call, and the gold's field that names the stream.
CALLED = {"window_pairwise_compare": ("compare_window", "winning_stream_id"), "window_rank": ("rank_window", "stream_id")}


def supported_period(period: Column) -> Column:
    """day, week or month; anything else is week."""
    return F.when(period.isin("day", "week", "month"), period).otherwise("week")


def phase_contexts(tasks: DataFrame) -> DataFrame:
    """task_id, phase (from 1), stream_id, window_start, window_end (text), period of each phase that has a stream and a window.

    tasks: task_id, family, period, phase_golds (array of maps of frozen values), calls (array of tool_name and arguments as such maps). The n-th phase of a comparison or a ranking has the window of
    the n-th call of its tool; gates of quality take what their gold lacks from their n-th inspection.
    """
    rows = tasks.select("task_id", "family", "period", "calls", F.posexplode("phase_golds").alias("k", "gold"))
    text = lambda m, f: F.nullif(J.text_of(m[f]), F.lit(""))

    def nth(tool: str) -> Column:
        return F.get(F.filter("calls", lambda c: c["tool_name"] == tool), F.col("k"))["arguments"]

    gold = F.col("gold")
    own = [F.struct(text(gold, "stream_id").alias("stream_id"), text(gold, "window_start").alias("window_start"), text(gold, "window_end").alias("window_end"), p.alias("period")) for p in (F.lit("day"), supported_period(F.col("period")))]
    found = F.when(F.col("family").isin(*DAYS), own[0]).when(F.col("family") == "window_mean_lookup", own[1])
    for family, (tool, stream) in CALLED.items():
        a = nth(tool)
        found = found.when(F.col("family") == family, F.struct(text(gold, stream).alias("stream_id"), text(a, "window_start").alias("window_start"), text(a, "window_end").alias("window_end"), supported_period(text(a, "period")).alias("period")))
    a = nth("inspect_quality_window")
    gate = [F.coalesce(text(gold, f), text(a, f)).alias(f) for f in ("window_start", "window_end")]
    found = found.when(F.col("family") == "quality_gate", F.struct(text(gold, "stream_id").alias("stream_id"), *gate, supported_period(F.coalesce(text(gold, "period"), text(a, "period"))).alias("period")))
    out = rows.select("task_id", (F.col("k") + 1).alias("phase"), found.alias("c")).select("task_id", "phase", "c.*")
    return out.where("stream_id is not null and window_start is not null and window_end is not null")


def quality_golds(contexts: DataFrame, inspect: Tool) -> DataFrame:
    """The contexts with decision (answer or abstain), observed_fraction and gap_ratio of their windows, all inspected together."""
    asked = materialise(contexts.withColumn("request_id", F.monotonically_increasing_id()), "contexts")
    arguments = J.written(**{n: F.col(n) for n in ("stream_id", "window_start", "window_end", "period")})
    got = inspect(asked.select("request_id", arguments.alias("arguments")))
    value = lambda n: J.number_of(J.at_path(F.col("output"), F.lit(n))).alias(n)
    return asked.join(got, "request_id").select(*contexts.columns, decision(F.col("output")).alias("decision"), value("observed_fraction"), value("gap_ratio"))


def difficulty(tasks: DataFrame) -> DataFrame:
    """task_id and the counts that make a task hard: different tools, arguments that are times, references, calls that aggregate, phases beyond the first.

    tasks: task_id, calls (array of tool_name and arguments as maps of frozen values), phase_golds.
    """
    values = F.flatten(F.transform("calls", lambda c: F.map_values(c["arguments"])))
    keys = F.flatten(F.transform("calls", lambda c: F.map_keys(c["arguments"])))
    many = lambda a: F.size(a).cast("long")
    return tasks.select(
        "task_id", many(F.array_distinct(F.transform("calls", lambda c: c["tool_name"]))).alias("required_tool_count"),
        many(F.filter(keys, lambda k: k.isin("window_start", "window_end", "timestamp"))).alias("time_count"),
        many(F.filter(values, lambda v: v.rlike(r'"\$[^".]+\.'))).alias("reference_count"),
        many(F.filter("calls", lambda c: c["tool_name"].isin("aggregate_window", "compare_window", "rank_window"))).alias("aggregation_count"),
        F.greatest(many("phase_golds") - 1, F.lit(0)).cast("long").alias("revision_count"),
    )


def risks(tasks: DataFrame) -> DataFrame:
    """family, what (phases, variants or revisions that differ from phases), n_of, n: how many tasks of a family have so many phases and variants, and how many phases don't fit the turns.

    tasks: task_id, family, phase_golds, variants, turns.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    pairs = F.array(F.struct(F.lit("phases").alias("what"), size("phase_golds").alias("n_of")), F.struct(F.lit("variants").alias("what"), size("variants").alias("n_of")), F.struct(F.lit("misfit").alias("what"), (size("phase_golds") - 1 - size("turns")).alias("n_of")))
    return tasks.select("family", F.explode(pairs).alias("p")).groupBy("family", "p.what", "p.n_of").agg(F.count("*").alias("n"))


def traces(static: DataFrame, final: DataFrame, sources: DataFrame, replays: DataFrame, runs: DataFrame) -> DataFrame:
    """Every final task with the static one it rests on, its raw sources, whether a replay gives the same object, and its recorded run.

    static: task_id, json; final: task_id, static_id, stream_ids, json; sources: stream_id, source; replays: task_id, json; runs: task_id, model, label. JSON is compared as it means; problems are an array of
    no_static, no_source, no_replay, replay_differs.
    """
    digest = F.sha2(J.frozen("json"), 256)
    raw = final.select("task_id", F.explode("stream_ids").alias("stream_id")).join(sources, "stream_id", "left")
    known = raw.groupBy("task_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max(F.col("source").isNull()).alias("lost"))
    rows = final.select("task_id", "static_id", digest.alias("release_digest")).join(known, "task_id", "left")
    rows = rows.join(static.select(F.col("task_id").alias("static_id"), digest.alias("static_digest")), "static_id", "left").join(replays.select("task_id", digest.alias("replay_digest")), "task_id", "left").join(runs.select("task_id", "model", "label"), "task_id", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("static_digest").isNull(), "no_static"), F.when(F.coalesce("lost", F.lit(True)), "no_source"), F.when(F.col("replay_digest").isNull(), "no_replay"),
        F.when(F.col("replay_digest") != F.col("release_digest"), "replay_differs"),
    ))
    none = F.array().cast("array<string>")
    return rows.select("task_id", "static_id", F.coalesce("sources", none).alias("sources"), "release_digest", "replay_digest", "model", "label", problems.alias("problems"))
