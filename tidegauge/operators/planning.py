"""From requests in words to answers: phrases and times are grounded, each family of tasks has a template of calls, and all tasks' calls run together on the query tools.

tasks: task_id, site_id, family, text. Phrases are found by equality of runs of words, however long they are, and a phrase that stands inside a longer one of its kind doesn't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import texts as X
from tidegauge.functions import typed as J
from tidegauge.functions.columns import iso_text, normalize_text
from tidegauge.operators.sequences import Tool, execute
from tidegauge.operators.summaries import phrase_hits
from tidegauge.tables import materialise

MEANS = ("day_mean_lookup", "relative_24h_mean_lookup", "window_mean_lookup")
STEPS = 3


def phrase_table(inventory: DataFrame) -> DataFrame:
    """site_id (null: any), kind, phrase, value of the ways to say classes, equipment and locations."""
    classes = inventory.where("point_class is not null").select(F.lit(None).cast("string").alias("site_id"), F.lit("class").alias("kind"), F.explode(X.class_phrases("point_class")).alias("phrase"), F.col("point_class").alias("value"))
    parts = [classes]
    for kind, column in (("equipment", "equipment_label"), ("location", "location_label")):
        parts.append(inventory.where(F.col(column).isNotNull()).select("site_id", F.lit(kind).alias("kind"), F.explode(X.label_variants(column)).alias("phrase"), F.col(column).alias("value")))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.where("phrase <> ''").distinct()


def grounded(tasks: DataFrame, phrases: DataFrame) -> DataFrame:
    """task_id and an array of values for each kind (class, equipment, location), in order of their first place in the text; the least value of phrases that several share."""
    known = phrases.groupBy("kind", "phrase", "site_id").agg(F.min("value").alias("value")).withColumn("value", F.struct("kind", "site_id", "value")).select("phrase", "value")
    hits = phrase_hits(tasks, "task_id", "text", known).join(tasks.select("task_id", F.col("site_id").alias("own"), normalize_text("text").alias("said")), "task_id")
    hits = hits.where(F.col("value.site_id").isNull() | (F.col("value.site_id") == F.col("own")))
    # Places in the text with a blank at each end, so that a phrase is met between words.
    start = F.position(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")), F.concat(F.lit(" "), F.col("said"), F.lit(" ")))
    hits = hits.select("task_id", F.struct(start.alias("start"), (start + F.length("phrase")).alias("stop"), F.col("value.kind").alias("kind"), F.col("value.value").alias("value")).alias("h"))
    lists = hits.groupBy("task_id").agg(F.array_sort(F.collect_set("h")).alias("hits"))

    def inside(a: Column, b: Column) -> Column:
        return (a["kind"] == b["kind"]) & (b["start"] <= a["start"]) & (b["stop"] >= a["stop"]) & ((b["stop"] - b["start"]) > (a["stop"] - a["start"]))

    kept = lists.select("task_id", F.filter("hits", lambda a: ~F.exists("hits", lambda b: inside(a, b))).alias("hits"))

    def values(kind: str) -> Column:
        return F.transform(F.filter("hits", lambda h: h["kind"] == kind), lambda h: h["value"]).alias(kind)

    return kept.select("task_id", *map(values, ("class", "equipment", "location")))


def call(position: int, tool: str, arguments: dict[str, Column]) -> Column:
    return F.struct(F.lit(position).alias("position"), F.lit(None).cast("string").alias("call_id"), F.lit(tool).alias("tool_name"), J.written(**arguments).alias("arguments"))


def plans(tasks: DataFrame, phrases: DataFrame) -> DataFrame:
    """Calls (task_id, position, call_id, tool_name, arguments) of all tasks whose family has a template and whose text has its time."""
    rows = tasks.join(grounded(tasks, phrases), "task_id", "left")
    rows = rows.select("*", X.window_in("family", "text").alias("w"), X.instant_in("text").alias("at"))
    site, cls, f = F.col("site_id"), F.get("class", F.lit(0)), F.col("family")

    def resolve(position: int, which: int) -> Column:
        return call(position, "resolve_point", {"site_id": site, "point_class": cls, "equipment_label": F.get("equipment", F.lit(which)), "location_label": F.get("location", F.lit(which))})

    span = {"window_start": iso_text("w.start"), "window_end": iso_text("w.end"), "period": F.col("w.period"), "metric": F.lit("mean_value")}
    found = F.lit("$c1.stream_id")
    mean = F.array(resolve(1, 0), call(2, "aggregate_window", {"stream_id": found, **span}))
    pair = F.array(resolve(1, 0), resolve(2, 1), call(3, "compare_window", {"left_stream_id": found, "right_stream_id": F.lit("$c2.stream_id"), **span}))
    listed = call(1, "list_points", {"site_id": site, "point_class": cls})
    rank = F.array(listed, call(2, "rank_window", {"stream_ids": F.lit("$c1.stream_ids"), "order": F.when(F.lower("text").rlike(r"\blowest\b"), "asc").otherwise("desc"), "topk": F.lit(1), **span}))
    looks = [call(k, "lookup_observation", {"stream_id": found, "timestamp": iso_text("at"), "mode": F.lit(mode)}) for k, mode in ((2, "exact"), (3, "nearest"))]
    timed = F.array(resolve(1, 0), *looks)
    quality = F.array(resolve(1, 0), call(2, "inspect_quality_window", {"stream_id": found, **span}))
    dated = F.col("w").isNotNull()
    # A comparison names two of something.
    two = (F.size("equipment") > 1) | (F.size("location") > 1)
    template = (
        F.when(f.isin(*MEANS) & dated, mean).when((f == "window_pairwise_compare") & dated & two, pair).when((f == "window_rank") & dated, rank)
        .when(f.isin("timestamp_value_lookup", "timestamp_nearest_lookup") & F.col("at").isNotNull(), timed).when((f == "quality_gate") & dated, quality)
    )
    return rows.select("task_id", F.explode(template).alias("c")).select("task_id", "c.*")


def decision(output: Column) -> Column:
    """answer or abstain by the thresholds that an inspection gives; abstain where neither is clear."""
    value = lambda name: J.number_of(J.at_path(output, F.lit(name)))
    share, gap = value("observed_fraction"), value("gap_ratio")
    limit = lambda name: value(f"quality_reference.{name}")
    bad = (share < limit("abstain_observed_fraction_below")) | (gap > limit("abstain_gap_ratio_above"))
    good = (share >= limit("answer_observed_fraction_at_least")) & (gap.isNull() | limit("answer_gap_ratio_at_most").isNull() | (gap <= limit("answer_gap_ratio_at_most")))
    return F.when(F.coalesce(good, F.lit(False)) & ~F.coalesce(bad, F.lit(False)), "answer").otherwise("abstain")


def answers(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """task_id, answer (map of frozen values) from the outputs of a task's calls; null where nothing ran. done: what execute() returns."""
    outputs = done.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("position", "output"))).alias("out"))
    rows = tasks.select("task_id", "family").join(outputs, "task_id", "left")
    one, two, three = (F.col("out")[k] for k in (1, 2, 3))
    f = F.col("family")
    stream = J.at_path(one, F.lit("stream_id"))

    def entry(**values: Column) -> Column:
        return F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.coalesce(v, F.lit("null")))])

    at = lambda output, path: J.at_path(output, F.lit(path))
    exact = at(two, "exact_match_found") == "true"
    look = F.when(exact, two).otherwise(three)
    answer = (
        F.when(f.isin(*MEANS), entry(stream_id=stream, mean_value=at(two, "mean_value"), count=at(two, "count")))
        .when(f == "window_pairwise_compare", entry(winning_stream_id=at(three, "winning_stream_id"), left_value=at(three, "left_value"), right_value=at(three, "right_value")))
        .when(f == "window_rank", entry(stream_id=at(two, "ranked_streams[0].stream_id"), mean_value=at(two, "ranked_streams[0].mean_value")))
        .when(f.isin("timestamp_value_lookup", "timestamp_nearest_lookup"), entry(stream_id=stream, value=at(look, "value"), observed_timestamp=at(look, "observed_timestamp"), exact_match_found=at(two, "exact_match_found")))
        .when(f == "quality_gate", entry(stream_id=stream, decision=F.concat(F.lit('"'), decision(two), F.lit('"')), observed_fraction=at(two, "observed_fraction")))
    )
    return rows.select("task_id", F.when(F.col("out").isNotNull(), answer).alias("answer"))


def solve(tasks: DataFrame, inventory: DataFrame, tools: dict[str, Tool]) -> DataFrame:
    """task_id, answer of every task, from its text.

    Tasks of one site, family and text have one answer and are solved once: what their calls give back, lists of all points of a class included, isn't kept for each.
    """
    key = F.struct("site_id", "family", "text").alias("asked")
    asked = materialise(tasks.select(key).distinct().select("asked", F.monotonically_increasing_id().alias("task_id")), "asked")
    each = asked.select("task_id", "asked.*")
    found = answers(each, execute(plans(each, phrase_table(inventory)), tools, STEPS))
    known = materialise(asked.join(found, "task_id").select("asked", "answer"), "answers")
    return tasks.select("task_id", key).join(known, "asked").select("task_id", "answer")
