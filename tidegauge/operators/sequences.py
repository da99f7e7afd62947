"""Sequences of calls on the query tools, for all tasks at once: typed arguments, references into earlier outputs at any depth, one plan for each tool and step.

calls: task_id, position (from 1), call_id (null: c and the position), tool_name, arguments (map of frozen values, see functions.typed). A text $call.path anywhere in an
argument, also in its lists and objects, stands for what is at that path of the task's earlier call; of a call that isn't there it is plain text, and a path that isn't
there is null. Tools get request_id and arguments, and return request_id and output (JSON).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import typed as J
from tidegauge.functions.columns import instant, iso_text
from tidegauge.operators import asof, tools
from tidegauge.operators.tools import METRICS
from tidegauge.tables import materialise

Tool = Callable[[DataFrame], DataFrame]
#: A whole text of a frozen value that may be a reference: its quotes, the call and the path.
_REFERENCE = r'"\$([^".\\$]+)\.((?:[^"\\])+)"(?!:)'


def resolve(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """calls with the references in their arguments replaced; outputs: task_id, call_id, output of all calls made so far."""
    names = calls.select("task_id", "position", F.explode("arguments").alias("name", "value"))
    found = names.select("*", F.explode_outer(F.array_distinct(F.regexp_extract_all("value", F.lit(_REFERENCE), F.lit(0)))).alias("token"))
    split = found.withColumns({"from_call": F.regexp_extract("token", _REFERENCE, 1), "path": F.regexp_extract("token", _REFERENCE, 2)})
    known = outputs.select("task_id", F.col("call_id").alias("from_call"), "output", F.lit(True).alias("known"))
    met = split.join(known, ["task_id", "from_call"], "left")
    swap = F.when(F.col("known"), F.struct("token", F.coalesce(J.at_path(F.col("output"), F.col("path")), F.lit("null")).alias("to")))
    swaps = met.groupBy("task_id", "position", "name", "value").agg(F.collect_list(swap).alias("swaps"))
    value = F.aggregate("swaps", F.col("value"), lambda v, s: F.replace(v, s["token"], s["to"]))
    maps = swaps.select("task_id", "position", F.struct("name", value.alias("value")).alias("e")).groupBy("task_id", "position").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("arguments"))
    none = F.create_map().cast("map<string,string>")
    return calls.drop("arguments").join(maps, ["task_id", "position"], "left").withColumn("arguments", F.coalesce("arguments", none))


def execute(calls: DataFrame, run: dict[str, Tool], steps: int) -> DataFrame:
    """task_id, position, call_id, tool_name, arguments, output of every call, each tool once a step for all tasks together.

    Calls beyond `steps` or of unknown tools have no output. Every step is written, so that the next one reads it and nothing is computed twice.
    """
    named = materialise(calls.withColumn("call_id", F.coalesce("call_id", F.concat(F.lit("c"), F.col("position").cast("string")))), "calls")
    columns = ["task_id", "position", "call_id", "tool_name", "arguments", "output"]
    made = (F.col("position") <= steps) & F.col("tool_name").isin(*run)
    done = [named.where(~made).withColumn("output", F.lit(None).cast("string")).select(*columns)]
    for step in range(1, steps + 1):
        now = named.where(made & (F.col("position") == step))
        if len(done) > 1:
            now = resolve(now, reduce(DataFrame.unionByName, done[1:]).select("task_id", "call_id", "output"))
        # A number for each request, fixed as the table is written.
        now = materialise(now.withColumn("request_id", F.monotonically_increasing_id()), "requests")
        used = [r["tool_name"] for r in now.select("tool_name").distinct().collect()]
        if not used:
            continue
        answers = reduce(DataFrame.unionByName, [run[name](now.where(F.col("tool_name") == name).select("request_id", "arguments")).select("request_id", "output") for name in sorted(used)])
        done.append(materialise(now.join(answers, "request_id", "left").select(*columns), "outputs"))
    return reduce(DataFrame.unionByName, done)


def argument(name: str) -> Column:
    return J.text_of(F.col("arguments")[name])


def time_argument(name: str, kind: str) -> Column:
    return instant(argument(name)).cast(kind)


def written(**values: Column) -> Column:
    return J.object_of(J.written(**values))


class Tools:
    """The query tools as functions of requests, over one store: inventory, observations, stored aggregates of all periods, quality of streams, and thresholds.

    aliases: alias, point_class; reference: one row of thresholds for streams; window_references: period and such a row for each period.
    """

    def __init__(self, inventory: DataFrame, obs: DataFrame, aggregates: DataFrame, quality: DataFrame, aliases: DataFrame, reference: DataFrame, window_references: DataFrame) -> None:
        self.inventory, self.obs, self.aggregates, self.quality = inventory, obs, aggregates, quality
        self.aliases, self.reference, self.window_references = aliases, reference, window_references
        self.time = dict(obs.dtypes)["ts"]

    def all(self) -> dict[str, Tool]:
        names = ("resolve_point", "list_points", "aggregate_window", "compare_window", "rank_window", "lookup_observation", "inspect_quality", "inspect_quality_window")
        return {n: getattr(self, n) for n in names}

    def _described(self, found: DataFrame, fields: list[str]) -> DataFrame:
        """request_id, points: array of objects of the found streams (request_id, site_id, stream_id), by stream."""
        points = found.join(self.inventory, ["site_id", "stream_id"]).select("request_id", "stream_id", written(**{f: F.col(f) for f in fields}).alias("p"))
        return points.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stream_id", "p"))), lambda x: x["p"]).alias("points"))

    def resolve_point(self, asked: DataFrame) -> DataFrame:
        requests = asked.select("request_id", *[argument(n).alias(n) for n in ("site_id", "point_class", "equipment_label", "location_label")])
        found = tools.resolve_points(self.inventory, requests, self.aliases)
        each = found.join(requests.select("request_id", "site_id"), "request_id").select("request_id", "site_id", F.explode("stream_ids").alias("stream_id"))
        both = found.join(self._described(each, ["stream_id", "point_class", "equipment_label", "location_label", "point_label"]), "request_id", "left")
        fields = J.written(match_count=F.col("match_count"))
        fields = F.map_concat(fields, F.create_map(F.lit("matches"), J.array_of(F.coalesce("points", F.array().cast("array<string>")))))
        for name in ("stream_id", "resolution_strategy"):
            fields = F.map_concat(fields, F.when(F.col(name).isNotNull(), J.written(**{name: F.col(name)})).otherwise(F.create_map().cast("map<string,string>")))
        return both.select("request_id", J.object_of(fields).alias("output"))

    def list_points(self, asked: DataFrame) -> DataFrame:
        requests = asked.select("request_id", *[argument(n).alias(n) for n in ("site_id", "point_class", "equipment_type", "location_type")])
        found = tools.list_points(self.inventory, requests)
        each = found.join(requests.select("request_id", "site_id"), "request_id").select("request_id", "site_id", F.explode("stream_ids").alias("stream_id"))
        both = found.join(self._described(each, ["stream_id", "point_class", "equipment_type", "equipment_label", "location_type", "location_label"]), "request_id", "left")
        none = F.array().cast("array<string>")
        points = F.create_map(F.lit("points"), J.array_of(F.coalesce("points", none)))
        return both.select("request_id", J.object_of(F.map_concat(J.written(stream_ids=F.coalesce("stream_ids", none), count=F.col("count")), points)).alias("output"))

    def _windows(self, requests: DataFrame) -> DataFrame:
        """request_id and the rounded statistics of each request (request_id, stream_id, period, window_start, window_end)."""
        got = tools.aggregate_window(self.obs, self.aggregates, requests)
        rounded = [F.round(m, 4).alias(m) for m in METRICS if m != "count"]
        return requests.join(got.select("request_id", *rounded, "count"), "request_id", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))

    def _span(self) -> list[Column]:
        return [time_argument("window_start", self.time).alias("window_start"), time_argument("window_end", self.time).alias("window_end"), argument("period").alias("period")]

    def aggregate_window(self, asked: DataFrame) -> DataFrame:
        got = self._windows(asked.select("request_id", argument("stream_id").alias("stream_id"), *self._span()))
        own = {m: F.col(m) for m in METRICS}
        return got.select("request_id", written(stream_id=F.col("stream_id"), window_start=iso_text("window_start"), window_end=iso_text("window_end"), period=F.col("period"), **own).alias("output"))

    def _metric(self) -> Column:
        return F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m).cast("double"))])[F.col("metric")]

    def compare_window(self, asked: DataFrame) -> DataFrame:
        rows = asked.select("request_id", argument("left_stream_id").alias("left"), argument("right_stream_id").alias("right"), argument("metric").alias("metric"), *self._span())
        # Two requests each, told apart by the last bit.
        sides = rows.select("*", F.posexplode(F.array("left", "right")).alias("side", "stream_id"))
        got = self._windows(sides.select((F.col("request_id") * 2 + F.col("side")).alias("request_id"), "stream_id", "metric", "window_start", "window_end", "period"))
        by = got.select(F.shiftright("request_id", 1).alias("request_id"), (F.col("request_id") % 2).alias("side"), self._metric().alias("v")).groupBy("request_id").agg(*[F.max(F.when(F.col("side") == k, F.col("v"))).alias(n) for k, n in ((0, "left_value"), (1, "right_value"))])
        winner = F.when(F.col("left_value").isNull() | F.col("right_value").isNull(), None).when(F.col("left_value") > F.col("right_value"), F.col("left")).otherwise(F.col("right"))
        out = written(metric=F.col("metric"), left_stream_id=F.col("left"), right_stream_id=F.col("right"), left_value=F.col("left_value"), right_value=F.col("right_value"), winning_stream_id=winner, window_start=iso_text("window_start"), window_end=iso_text("window_end"))
        return rows.join(by, "request_id").select("request_id", out.alias("output"))

    def rank_window(self, asked: DataFrame) -> DataFrame:
        order = F.coalesce(argument("order"), F.lit("desc"))
        topk = F.coalesce(J.number_of(F.col("arguments")["topk"]), F.lit(1)).cast("int")
        rows = asked.select("request_id", F.transform(J.items(F.col("arguments")["stream_ids"]), J.text_of).alias("streams"), argument("metric").alias("metric"), order.alias("order"), topk.alias("topk"), *self._span())
        each = materialise(rows.select(F.col("request_id").alias("own"), F.explode("streams").alias("stream_id"), "metric", "window_start", "window_end", "period").withColumn("request_id", F.monotonically_increasing_id()), "ranked")
        got = self._windows(each).select("own", "stream_id", "metric", self._metric().alias("v")).where("v is not null")
        listed = got.groupBy(F.col("own").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("v", "stream_id"))).alias("up"))
        both = rows.join(listed, "request_id", "left")
        ranked = F.slice(F.when(F.col("order") == "desc", F.reverse("up")).otherwise(F.col("up")), 1, F.col("topk"))
        texts = F.transform(ranked, lambda r: J.object_of(F.map_concat(J.written(stream_id=r["stream_id"]), F.map_from_arrays(F.array("metric"), F.array(F.get(J.items(F.to_json(F.array(r["v"]))), F.lit(0)))))))
        fields = J.written(metric=F.col("metric"), window_start=iso_text("window_start"), window_end=iso_text("window_end"), order=F.col("order"), topk=F.col("topk"))
        return both.select("request_id", J.object_of(F.map_concat(fields, F.create_map(F.lit("ranked_streams"), J.array_of(F.coalesce(texts, F.array().cast("array<string>")))))).alias("output"))

    def lookup_observation(self, asked: DataFrame) -> DataFrame:
        rows = asked.select("request_id", argument("stream_id").alias("stream_id"), time_argument("timestamp", self.time).alias("probe_ts"), F.coalesce(argument("mode"), F.lit("exact")).alias("mode"))
        probes = rows.withColumnRenamed("request_id", "probe_id")
        there = self.obs.join(probes.select("stream_id").distinct(), "stream_id", "left_semi")
        met = asof.exact(there, probes.where("mode = 'exact'")).select(F.col("probe_id").alias("request_id"), "found", F.col("value").alias("exact_value"))
        near = asof.nearest(there, probes.where("mode <> 'exact'")).select(F.col("probe_id").alias("request_id"), "observed_ts", "value", "offset_seconds", "exact_match_found")
        both = rows.join(met, "request_id", "left").join(near, "request_id", "left")
        asked_at = {"stream_id": F.col("stream_id"), "requested_timestamp": iso_text("probe_ts")}
        missed = J.written(**asked_at, exact_match_found=F.lit(False))
        hit = J.written(**asked_at, observed_timestamp=iso_text("probe_ts"), value=F.col("exact_value"), exact_match_found=F.lit(True))
        nearest = J.written(**asked_at, observed_timestamp=iso_text("observed_ts"), value=F.col("value"), exact_match_found=F.col("exact_match_found"), fallback_reason=F.lit("nearest_available_observation"), offset_seconds=F.col("offset_seconds"))
        return both.select("request_id", J.object_of(F.when(F.col("found"), hit).when(F.col("observed_ts").isNotNull(), nearest).otherwise(missed)).alias("output"))

    def inspect_quality(self, asked: DataFrame) -> DataFrame:
        rows = asked.select("request_id", argument("stream_id").alias("stream_id"))
        got = rows.join(tools.inspect_quality(self.quality, self.reference, rows.select("stream_id").distinct()), "stream_id")
        return got.select("request_id", self._quality({"stream_id": F.col("stream_id")}).alias("output"))

    def _quality(self, first: dict[str, Column]) -> Column:
        metrics = {m: F.round(m, 4) for m in ("observed_fraction", "gap_ratio", "duplicate_timestamp_fraction", "nan_fraction")}
        limits = ("abstain_observed_fraction_below", "answer_observed_fraction_at_least", "answer_gap_ratio_at_most", "abstain_gap_ratio_above")
        return J.object_of(F.map_concat(J.written(**first, **metrics), F.create_map(F.lit("quality_reference"), written(**{n: F.col(n) for n in limits}))))

    def inspect_quality_window(self, asked: DataFrame) -> DataFrame:
        rows = asked.select("request_id", argument("stream_id").alias("stream_id"), *self._span())
        none = self.reference.limit(1).select(F.lit(1).alias("one"))
        got = tools.inspect_quality_window(self.obs, rows, none).drop("one", "stream_id")
        both = rows.join(got, "request_id", "left").join(F.broadcast(self.window_references), "period", "left")
        return both.select("request_id", self._quality({"stream_id": F.col("stream_id"), "window_start": iso_text("window_start"), "window_end": iso_text("window_end"), "period": F.col("period")}).alias("output"))
