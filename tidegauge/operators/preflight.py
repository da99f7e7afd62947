"""Preflight of tasks before they are used: their structure, their gold answers run again on the query tools, and their decisions held against the thresholds.

tasks: task_id, mode, n_revisions, phases (array of family, gold as a map of frozen values, required as an array of names) and final (such a struct, or null). Every rule gives a row
for each break: task_id, phase (from 1, null: the task), kind, field, gold and found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import typed as J
from tidegauge.functions.columns import instant
from tidegauge.functions.intents import INTENTS, says
from tidegauge.operators.sequences import Tool
from tidegauge.tables import materialise

ISSUE = ["task_id", "phase", "kind", "field", "gold", "found"]
NEAR = 1e-9

SPAN = {n: n for n in ("window_start", "window_end", "period")}
MEAN = {"metric": '"mean_value"'}
#: For each family the tool that gives its gold answer, the call's arguments by the gold's fields (text in quotes: fixed), and where each field of the answer stands in the output.
RERUN: dict[str, tuple[str, dict[str, str], dict[str, str]]] = {
    **{f: ("aggregate_window", {"stream_id": "stream_id", **SPAN}, {"mean_value": "mean_value"}) for f in ("day_mean_lookup", "relative_24h_mean_lookup", "window_mean_lookup")},
    "window_pairwise_compare": (
        "compare_window", {"left_stream_id": "left_stream_id", "right_stream_id": "right_stream_id", **SPAN, **MEAN},
        {"winning_stream_id": "winning_stream_id", "left_mean_value": "left_value", "right_mean_value": "right_value"},
    ),
    "window_rank": ("rank_window", {"stream_ids": "stream_ids", **SPAN, **MEAN, "topk": "1"}, {"stream_id": "ranked_streams[0].stream_id", "mean_value": "ranked_streams[0].mean_value"}),
    "quality_gate": ("inspect_quality_window", {"stream_id": "stream_id", **SPAN}, {"observed_fraction": "observed_fraction", "gap_ratio": "gap_ratio"}),
}
TIMED = ("timestamp_value_lookup", "timestamp_nearest_lookup")
TIMES = ("observed_timestamp", "window_start", "window_end")


def _issues(rows: DataFrame, found: list[Column]) -> DataFrame:
    """Rows for the structs (kind, field, gold, found) that aren't null."""
    issues = F.filter(F.array(*found), lambda x: x.isNotNull())
    return rows.select("task_id", "phase", F.explode(issues).alias("i")).select("task_id", "phase", "i.*")


def issue(broken: Column, kind: str, field: str | None = None, gold: Column | None = None, found: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.when(broken, F.struct(F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), (null if gold is None else gold.cast("string")).alias("gold"), (null if found is None else found.cast("string")).alias("found")))


def _frozen_phase(p: Column) -> Column:
    """A phase as text that doesn't depend on the order of its gold's fields."""
    return F.to_json(F.struct(p["family"].alias("family"), F.array_sort(F.map_entries(p["gold"])).alias("gold"), p["required"].alias("required")))


def structure(tasks: DataFrame, mode: Column) -> DataFrame:
    """Breaks of the number of phases, of the final one, of the mode (which should be `mode`), and phases without required fields or with fields that their gold lacks."""
    n = F.coalesce(F.size("phases"), F.lit(0))
    whole = tasks.withColumn("phase", F.lit(None).cast("int"))
    last = F.get("phases", n - 1)
    differs = ~_frozen_phase(F.col("final")).eqNullSafe(_frozen_phase(last))
    of_task = _issues(whole, [
        issue(n != 1 + F.col("n_revisions"), "phase_count_mismatch", "phases", 1 + F.col("n_revisions"), n),
        issue((F.col("final").isNull() != last.isNull()) | (F.col("final").isNotNull() & differs), "final_phase_mismatch", "final"),
        issue(~F.col("mode").eqNullSafe(mode), "interaction_mode_mismatch", "mode", F.col("mode"), mode),
    ])
    each = phases_of(tasks)
    absent = F.array_join(F.filter("required", lambda f: ~F.map_contains_key(F.col("gold"), f)), ",")
    of_phase = _issues(each, [
        issue(F.coalesce(F.size("required"), F.lit(0)) == 0, "phase_required_fields_empty", "required"),
        issue(absent != "", "gold_field_missing", "gold", absent),
    ])
    return of_task.unionByName(of_phase)


def phases_of(tasks: DataFrame) -> DataFrame:
    """task_id, phase (from 1), family, gold, required of every phase."""
    rows = tasks.select("task_id", F.posexplode("phases").alias("k", "p"))
    return rows.select("task_id", (F.col("k") + 1).alias("phase"), "p.family", "p.gold", "p.required")


def _compared(gold: Column, found: Column, field: str) -> Column:
    """Whether a gold value is what was found: numbers within 1e-9, instants as instants, the rest by type."""
    if field in TIMES:
        return F.coalesce(instant(J.text_of(gold)) == instant(J.text_of(found)), gold.eqNullSafe(found))
    numbers = F.abs(J.number_of(gold) - J.number_of(found)) <= NEAR
    return F.when(J.is_text(gold) | J.is_text(found), J.same(gold, found)).otherwise(F.coalesce(numbers, gold.eqNullSafe(found)))


def _value(c: Column) -> Column:
    return F.coalesce(c, F.lit("null"))


def rerun(tasks: DataFrame, tools: dict[str, Tool], families: dict[str, tuple[str, dict[str, str], dict[str, str]]] | None = None) -> DataFrame:
    """A row for every field of a gold answer that its tool gives otherwise, and for golds that lack what the call needs; each tool runs once for all phases."""
    families = RERUN if families is None else families
    phases = materialise(phases_of(tasks).where(F.col("family").isin(*families)).withColumn("request_id", F.monotonically_increasing_id()), "phases")
    out = []
    for tool in sorted({t for t, _, _ in families.values()}):
        asked = None
        for family, (name, arguments, _) in families.items():
            if name != tool:
                continue
            pairs = [x for a, g in arguments.items() for x in (F.lit(a), F.lit(g) if g[0] == '"' or g.isdigit() else _value(F.col("gold")[g]))]
            own = phases.where(F.col("family") == family).select("request_id", F.create_map(*pairs).alias("arguments"))
            asked = own if asked is None else asked.unionByName(own)
        got = tools[tool](asked).select("request_id", "output")
        for family, (name, arguments, fields) in families.items():
            if name != tool:
                continue
            rows = phases.where(F.col("family") == family).join(got, "request_id", "left")
            needs = [g for g in arguments.values() if g[0] != '"' and not g.isdigit() and g != "period"]
            lacking = F.array_join(F.array_compact(F.array(*[F.when(_value(F.col("gold")[g]) == "null", F.lit(g)) for g in needs])), ",")
            checks = [issue(lacking != "", "gold_lacks_arguments", None, lacking)]
            for field, path in fields.items():
                gold, found = _value(F.col("gold")[field]), _value(J.at_path(F.col("output"), F.lit(path)))
                checks.append(issue((lacking == "") & ~_compared(gold, found, field), "gold_differs", field, gold, found))
            out.append(_issues(rows, checks))
    return reduce(DataFrame.unionByName, out)


def rerun_lookups(tasks: DataFrame, lookup: Tool) -> DataFrame:
    """Breaks of golds that look an instant up: exact where there is one, else the nearest observation with its reason."""
    phases = materialise(phases_of(tasks).where(F.col("family").isin(*TIMED)).withColumn("request_id", F.monotonically_increasing_id() * 2), "phases")
    gold = lambda f: _value(F.col("gold")[f])
    asked = [phases.select((F.col("request_id") + k).alias("request_id"), F.create_map(F.lit("stream_id"), gold("stream_id"), F.lit("timestamp"), gold("requested_timestamp"), F.lit("mode"), F.lit(f'"{mode}"')).alias("arguments")) for k, mode in ((0, "exact"), (1, "nearest"))]
    got = materialise(lookup(asked[0].unionByName(asked[1])).select("request_id", "output"), "lookups")
    sides = [got.where(F.col("request_id") % 2 == k).select((F.col("request_id") - k).alias("request_id"), F.col("output").alias(n)) for k, n in ((0, "exact"), (1, "near"))]
    rows = phases.join(sides[0], "request_id", "left").join(sides[1], "request_id", "left")
    hit = _value(J.at_path(F.col("exact"), F.lit("exact_match_found"))) == "true"
    expected = F.when(hit, F.col("exact")).otherwise(F.col("near"))
    at = lambda f: _value(J.at_path(expected, F.lit(f)))
    lacking = (gold("stream_id") == "null") | (gold("requested_timestamp") == "null")
    reason = F.when(hit, "null").otherwise(at("fallback_reason"))
    match = F.when(gold("exact_match_found") == "true", "true").otherwise("false")
    return _issues(rows, [
        issue(lacking, "timestamp_phase_missing_gold_fields"),
        issue(~lacking & (match != hit.cast("string")), "timestamp_exact_match_mismatch", "exact_match_found", match, hit),
        issue(~lacking & ~_compared(gold("observed_timestamp"), at("observed_timestamp"), "observed_timestamp"), "timestamp_observed_timestamp_mismatch", "observed_timestamp", gold("observed_timestamp"), at("observed_timestamp")),
        issue(~lacking & ((gold("value") == "null") | ~_compared(gold("value"), at("value"), "value")), "timestamp_value_mismatch", "value", gold("value"), at("value")),
        issue(~lacking & (gold("fallback_reason") != reason), "timestamp_fallback_reason_mismatch", "fallback_reason", gold("fallback_reason"), reason),
    ])


def decisions(tasks: DataFrame, references: DataFrame) -> DataFrame:
    """Breaks of quality decisions by the thresholds of their period (week, if the gold names none): answers that these don't allow, and abstentions that they do unless the quality is marginal.

    references: period and the four thresholds, a few rows; null thresholds don't judge.
    """
    rows = phases_of(tasks).where(F.col("family") == "quality_gate").withColumn("period", F.coalesce(J.text_of(F.col("gold")["period"]), F.lit("week"))).join(F.broadcast(references), "period", "left")
    share, gap = J.number_of(F.col("gold")["observed_fraction"]), J.number_of(F.col("gold")["gap_ratio"])
    gap_ok = F.col("answer_gap_ratio_at_most").isNull() | gap.isNull() | (gap <= F.col("answer_gap_ratio_at_most"))
    good = F.coalesce((share >= F.col("answer_observed_fraction_at_least")) & gap_ok, F.lit(False))
    said, reason = J.text_of(F.col("gold")["decision"]), J.text_of(F.col("gold")["reason"])
    return _issues(rows, [
        issue((said == "answer") & ~good, "quality_answer_threshold_mismatch", "decision", said, F.lit("abstain")),
        issue((said == "abstain") & good & ~reason.eqNullSafe(F.lit("marginal_quality")), "quality_abstain_threshold_mismatch", "decision", said, F.lit("answer")),
    ])


# What prompts of a family say, each group by one of its words.
PROMPTS: dict[str, list[tuple[str, ...]]] = {
    "reporting_commitment": INTENTS["reporting_commitment"],
    "quality_reporting_commitment": [("report it as-is",), ("abstain",), ("quality",)],
    "combined_reporting_commitment": [("abstain",), ("timestamped reading", "data-quality check", "data-quality result")],
}


def prompts(turns: DataFrame, rules: dict[str, list[tuple[str, ...]]] | None = None) -> DataFrame:
    """Breaks of prompts (task_id, phase, family, prompt) that lack what their family says; families without a rule pass."""
    rules = PROMPTS if rules is None else rules
    return _issues(turns, [issue((F.col("family") == f) & ~says("prompt", groups), f"{f}_prompt_mismatch", "prompt", None, F.col("prompt")) for f, groups in rules.items()])


def preflight(tasks: DataFrame, mode: Column, tools: dict[str, Tool], references: DataFrame) -> DataFrame:
    """All breaks of the tasks: structure, golds run again, look-ups and decisions."""
    parts = [structure(tasks, mode), rerun(tasks, tools), rerun_lookups(tasks, tools["lookup_observation"]), decisions(tasks, references)]
    return reduce(DataFrame.unionByName, [p.select(*ISSUE) for p in parts])
