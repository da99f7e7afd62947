"""The query tools, for many requests at once: requests are a DataFrame, and each tool is a few joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import exact_mean, normalize_label, rounded
from tidegauge.operators.aggregates import quality
from tidegauge.operators.asof import rows_in_windows
from tidegauge.operators.thresholds import gap_ratio
from tidegauge.tables import materialise

METRICS = ("mean_value", "std_value", "min_value", "max_value", "count")


def resolve_points(inventory: DataFrame, requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """request_id, match_count, stream_ids (sorted), stream_id (only where one matches), resolution_strategy.

    First class and site as given with labels compared without case; requests without any match then try the classes that the given one stands for (aliases:
    alias, point_class) and labels without site, quotes and case. A label that is null asks nothing.
    """
    fields = ("equipment_label", "location_label")
    asked = requests.select("request_id", F.struct("site_id", "point_class", *fields).alias("_ask"))
    # Requests that ask the same are answered once.
    asks = asked.select("_ask").distinct().select("_ask", "_ask.*")

    def loose(label: str) -> Column:
        return normalize_label(label, "site_id")

    def keyed(how: Callable[[str], Column]) -> DataFrame:
        """Points with each of their labels and without it: what an ask with or without that label is equal to."""
        kept = [F.struct(*[(how(f) if f in some else F.lit(None).cast("string")).alias(f) for f in fields]) for some in (fields, fields[:1], fields[1:], ())]
        there = [reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in some], F.lit(True)) for some in (fields, fields[:1], fields[1:], ())]
        forms = F.explode(F.array_compact(F.array(*[F.when(t, k) for t, k in zip(there, kept, strict=True)])))
        return inventory.select("site_id", "stream_id", F.col("point_class").alias("_class"), forms.alias("_key"))

    def key(how: Callable[[str], Column]) -> Column:
        return F.struct(*[how(f).alias(f) for f in fields])

    first = asks.withColumns({"_class": F.col("point_class"), "_key": key(F.lower)}).join(keyed(F.lower), ["site_id", "_class", "_key"]).select("_ask", "stream_id")
    rest = asks.join(first, "_ask", "left_anti")
    wider = aliases.select(F.col("alias").alias("point_class"), F.col("point_class").alias("_class")).unionByName(rest.select("point_class", F.col("point_class").alias("_class")).distinct()).distinct()
    second = rest.join(wider, "point_class").withColumn("_key", key(loose)).join(keyed(loose), ["site_id", "_class", "_key"]).select("_ask", "stream_id")
    found = first.withColumn("how", F.lit("exact")).unionByName(second.distinct().withColumn("how", F.lit("fallback")))
    grouped = found.groupBy("_ask").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("stream_id")).alias("stream_ids"), F.first("how").alias("how"))
    out = asked.join(grouped, "_ask", "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return out.select("request_id", n.alias("match_count"), "stream_ids", F.when(n == 1, F.element_at("stream_ids", 1)).alias("stream_id"), F.when(F.col("how") == "fallback", "fallback").alias("resolution_strategy"))


def list_points(inventory: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, count, stream_ids of each site's points; class, equipment type and location type filter where they aren't null."""
    filters = ("point_class", "equipment_type", "location_type")
    points = inventory.select("site_id", "stream_id", *[F.col(c).alias(f"_{c}") for c in filters])
    wanted = reduce(lambda a, b: a & b, [F.col(c).isNull() | (F.col(c) == F.col(f"_{c}")) for c in filters])
    hits = requests.join(points, "site_id").where(wanted).groupBy("request_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("stream_id")).alias("stream_ids"))
    return requests.select("request_id").join(hits, "request_id", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint"))


def aggregate_window(obs: DataFrame, aggregates: DataFrame, requests: DataFrame, digits: int | None = 4) -> DataFrame:
    """Statistics for requests (request_id, stream_id, period, window_start, window_end).

    A stored aggregate of the same stream, period and bounds answers (sample deviation); only the other requests read observations (population deviation).
    Nothing in a window is count 0 and nulls. The mean has so many digits, or all of them.
    """
    stored = aggregates.select("stream_id", "period", "window_start", "window_end", *METRICS)
    ready = requests.join(stored, ["stream_id", "period", "window_start", "window_end"])
    rest = requests.join(ready.select("request_id"), "request_id", "left_anti")
    rows = rows_in_windows(obs.where("value is not null and not isnan(value)"), rest)
    raw = rows.groupBy("request_id", "stream_id", "window_start", "window_end").agg(
        rounded(exact_mean("value", F.nullif(F.count("value"), F.lit(0))), digits).alias("mean_value"), F.round(F.stddev_pop("value"), 4).alias("std_value"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("value").alias("count"),
    ).withColumn("source", F.lit("observations"))
    cols = ["request_id", "stream_id", "window_start", "window_end", "source", *METRICS]
    ready = ready.withColumns({"source": F.lit("stored"), "mean_value": rounded(F.col("mean_value"), digits)})
    return ready.select(*cols).unionByName(raw.select(*cols))


def metric(name: str):
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}; known are {', '.join(METRICS)}")
    return F.col(name).cast("double")


def compare_window(results: DataFrame, pairs: DataFrame, name: str = "mean_value") -> DataFrame:
    """request_id, left_value, right_value, winner: left only if strictly larger; no winner where a side is null."""
    values = results.select("request_id", "stream_id", metric(name).alias("v"))
    left = values.select(F.col("request_id").alias("left_request"), F.col("stream_id").alias("left_stream"), F.col("v").alias("left_value"))
    right = values.select(F.col("request_id").alias("right_request"), F.col("stream_id").alias("right_stream"), F.col("v").alias("right_value"))
    both = pairs.join(left, "left_request", "left").join(right, "right_request", "left")
    winner = F.when(F.col("left_value").isNull() | F.col("right_value").isNull(), None).when(F.col("left_value") > F.col("right_value"), F.col("left_stream")).otherwise(F.col("right_stream"))
    return both.select("request_id", "left_value", "right_value", winner.alias("winner"))


def rank_window(results: DataFrame, groups: list[str], name: str = "mean_value", descending: bool = True, topk: int = 1) -> DataFrame:
    """The topk streams of each group by value and stream_id, both downwards or both upwards; null values don't take part."""
    v, s = metric(name), F.col("stream_id")
    order = [v.desc(), s.desc()] if descending else [v.asc(), s.asc()]
    ranked = results.where(v.isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("place") <= topk).select(*groups, "place", "stream_id", v.alias("value"))


def inspect_quality(stream_quality: DataFrame, reference: DataFrame, streams: DataFrame) -> DataFrame:
    """Metrics, gap ratio and thresholds of the asked streams; a stream that is not there has no row."""
    rows = stream_quality.join(streams, "stream_id", "left_semi").withColumn("gap_ratio", F.round(gap_ratio(), 4))
    return rows.crossJoin(F.broadcast(reference))


def inspect_quality_window(obs: DataFrame, requests: DataFrame, reference: DataFrame) -> DataFrame:
    """Metrics of each requested window and the thresholds, which also stand where the window is empty."""
    rows = rows_in_windows(obs, requests.select("request_id", "stream_id", "window_start", "window_end")).where("ts is not null")
    metrics = quality(rows, ["request_id"]).withColumn("gap_ratio", F.round(gap_ratio(), 4))
    return requests.select("request_id", "stream_id").join(metrics, "request_id", "left").crossJoin(F.broadcast(reference))


def describe(streams: DataFrame, ready: DataFrame, inventory: DataFrame, fields: list[str]) -> DataFrame:
    """The fields of each asked stream from the ready points, else from the inventory, else its id alone; source tells which."""
    a = ready.select("stream_id", F.struct(*fields).alias("a"))
    b = inventory.select("stream_id", F.struct(*fields).alias("b"))
    out = streams.join(a, "stream_id", "left").join(b, "stream_id", "left").select("stream_id", F.coalesce("a", "b").alias("f"), F.when(F.col("a").isNotNull(), "ready").when(F.col("b").isNotNull(), "inventory").otherwise("id").alias("source"))
    return out.select("stream_id", "f.*", "source")


def resolve_references(calls: DataFrame) -> DataFrame:
    """Arguments of calls with $cN.field replaced by that output of the task's call cN.

    calls: task_id, call_id, tool_name, arguments and output (maps of text). An output that isn't there leaves null.
    """
    args = calls.select("task_id", "call_id", F.explode_outer("arguments").alias("name", "given"))
    split = args.select("*", F.regexp_extract("given", r"^\$(c\d+)\.(.+)$", 1).alias("from_call"), F.regexp_extract("given", r"^\$(c\d+)\.(.+)$", 2).alias("field"))
    outputs = calls.select("task_id", F.col("call_id").alias("from_call"), F.explode("output").alias("field", "found"))
    joined = split.join(outputs, ["task_id", "from_call", "field"], "left").select("task_id", "call_id", "name", F.when(F.col("from_call") != "", F.col("found")).otherwise(F.col("given")).alias("value"))
    pairs = F.filter(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda p: p["name"].isNotNull())
    return calls.select("task_id", "call_id", "tool_name").join(joined.groupBy("task_id", "call_id").agg(F.map_from_entries(pairs).alias("arguments")), ["task_id", "call_id"], "left")


def resolve_paths(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """calls with every argument $<call>.<path> replaced by what stands there in that call's output.

    calls: task_id, call_id, arguments (map of text); outputs: task_id, call_id, output (JSON). A path has fields and places such as a.b[3]. A path that isn't there
    leaves null; with a call that isn't there the argument is plain text and stays.
    """
    args = calls.select("task_id", "call_id", F.explode("arguments").alias("name", "given"))
    refs = args.select("*", F.regexp_extract("given", r"^\$([^.]+)\.(.+)$", 1).alias("from_call"), F.regexp_extract("given", r"^\$([^.]+)\.(.+)$", 2).alias("path"))
    known = outputs.select("task_id", F.col("call_id").alias("from_call"), "output", F.lit(True).alias("known"))
    there = F.call_function("get_json_object", F.col("output"), F.concat(F.lit("$."), F.col("path")))
    values = refs.join(known, ["task_id", "from_call"], "left").select("task_id", "call_id", "name", F.when(F.col("known"), there).otherwise(F.col("given")).alias("value"))
    maps = values.groupBy("task_id", "call_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("arguments"))
    none = F.create_map().cast("map<string,string>")
    return calls.drop("arguments").join(maps, ["task_id", "call_id"], "left").withColumn("arguments", F.coalesce("arguments", none))


def execute_sequences(calls: DataFrame, run: dict[str, Callable[[DataFrame], DataFrame]], steps: int) -> DataFrame:
    """task_id, position, call_id, tool_name, arguments, output: every task's calls in order, each tool once a step for all tasks together.

    calls: task_id, position (from 1), call_id (null: c and the position), tool_name, arguments (map of text). A tool gets task_id, call_id and arguments, with
    references to earlier outputs replaced, and returns task_id, call_id and output (JSON); a call without an answer has null. Calls beyond `steps` or of unknown
    tools are in the result, without output. Steps are written, as each reads all before it.
    """
    named = calls.withColumn("call_id", F.coalesce("call_id", F.concat(F.lit("c"), F.col("position").cast("string"))))
    cols = ["task_id", "position", "call_id", "tool_name", "arguments", "output"]
    rest = named.where((F.col("position") > steps) | ~F.col("tool_name").isin(*run)).withColumn("output", F.lit(None).cast("string")).select(*cols)
    done: DataFrame | None = None
    for step in range(1, steps + 1):
        now = named.where((F.col("position") == step) & F.col("tool_name").isin(*run))
        ready = now if done is None else resolve_paths(now, done.select("task_id", "call_id", "output"))
        answers = reduce(lambda a, b: a.unionByName(b), [tool(ready.where(F.col("tool_name") == name).select("task_id", "call_id", "arguments")).select("task_id", "call_id", "output") for name, tool in run.items()])
        result = materialise(ready.join(answers, ["task_id", "call_id"], "left").select(*cols), "calls")
        done = result if done is None else done.unionByName(result)
    return rest if done is None else done.unionByName(rest)
