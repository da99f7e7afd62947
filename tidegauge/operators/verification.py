"""Verification of executed calls and answers against gold tasks, from calls to labels, for all tasks in one plan.

tasks: task_id, family, period (text or null), gold (map of frozen values, see functions.typed), required (names of the answer's fields), tolerance (map of numbers; such fields are
numeric), streams and tools (required ids and tool names), variants (arrays of calls: call_id, tool_name, arguments as a map of frozen values, references already resolved).
calls: task_id, position, tool_name, arguments (map of frozen values), output (JSON). answers: task_id, final and evidence (JSON or null). A task has as many calls as an
episode has turns, so that they are one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import typed as J
from tidegauge.functions.columns import instant
from tidegauge.operators import scoring

# Fields that report, families whose windows may move, and what of a call's arguments is a time.
REPORTING = ["sample_exact_match_found", "sample_checked_timestamp"]
MOVABLE = ["day_mean_lookup", "relative_24h_mean_lookup", "window_mean_lookup"]
WINDOW = ["window_start", "window_end", "period"]
TIMES = {"aggregate_window": WINDOW, "compare_window": WINDOW, "rank_window": WINDOW, "inspect_quality_window": WINDOW, "lookup_observation": ["timestamp", "mode"]}
INSTANTS = ["window_start", "window_end", "timestamp"]
IGNORED = "sample|quality"



def texts(*items: str) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def field_checks(required: Column, tolerance: Column, gold: Column, given: Column) -> Column:
    """struct(score, issues): one check for each required field; numeric ones within their tolerance, others equal by type."""

    def issue(f: Column) -> Column:
        number = F.abs(J.number_of(given[f]) - J.number_of(gold[f])) <= tolerance[f]
        wrong = F.when(tolerance[f].isNotNull(), F.when(~F.coalesce(number, F.lit(False)), F.concat(F.lit("numeric_mismatch:"), f))).when(~J.same(given[f], gold[f]), F.concat(F.lit("value_mismatch:"), f))
        return F.when(~F.map_contains_key(given, f), F.concat(F.lit("missing_final_field:"), f)).otherwise(wrong)

    found = F.filter(F.transform(required, issue), lambda x: x.isNotNull())
    n = F.size(required)
    return F.struct(F.when(n == 0, 1.0).otherwise((n - F.size(found)) / n).alias("score"), found.alias("issues"))


def _arguments_hold(gold: Column, given: Column) -> Column:
    """Whether a call has all arguments of a gold one; a gold null is met by none."""
    return F.forall(F.map_entries(gold), lambda e: J.same(F.coalesce(given[e["key"]], F.lit("null")), e["value"]))


def process_checks(tools: Column, variants: Column, calls: Column) -> Column:
    """struct(score, issues): the better of the recall of tools and the best variant's share of calls in place, with all its arguments."""
    names = F.transform(calls, lambda c: c["tool_name"])
    recall = scoring.recall(tools, names)
    equal = lambda g, p: (g["tool_name"] == p["tool_name"]) & _arguments_hold(g["arguments"], p["arguments"])
    best = F.coalesce(F.array_max(F.transform(variants, lambda v: scoring.sequence_match(v, calls, equal))), F.lit(0.0))
    missing = F.transform(F.filter(tools, lambda t: ~F.array_contains(names, t)), lambda t: F.concat(F.lit("missing_tool:"), t))
    return F.struct(F.greatest(recall, best).alias("score"), F.concat(missing, F.when(best < 1, texts("call_sequence_mismatch")).otherwise(texts())).alias("issues"))


def evidence_checks(streams: Column, evidence: Column, calls: Column) -> Column:
    """struct(score, issues): recall of the required streams among the evidence's ids, or where it has none among all texts of the calls' outputs."""
    ids = F.coalesce(J.fields(evidence)["stream_ids"], evidence)
    named = F.coalesce(J.texts_in(ids), texts())
    outputs = F.flatten(F.transform(calls, lambda c: F.coalesce(J.texts_in(c["output"]), texts())))
    given = F.when(F.size(named) > 0, named).otherwise(outputs)
    missing = F.transform(F.filter(streams, lambda s: ~F.array_contains(given, s)), lambda s: F.concat(F.lit("missing_evidence:"), s))
    return F.struct(scoring.recall(streams, given).alias("score"), missing.alias("issues"))


def temporal_checks(variants: Column, calls: Column, moved: Column) -> Column:
    """struct(score, issues): of the best variant, the share of its calls' times that some call of the tool has. A moved window (`moved`) is right; without times all is."""

    def needs(v: Column) -> Column:
        """(tool, names, arguments) of the calls that have times to check."""
        def relevant(c: Column) -> Column:
            known = F.element_at(F.create_map(*[x for t, names in TIMES.items() for x in (F.lit(t), texts(*names))]), c["tool_name"])
            return F.struct(c["tool_name"].alias("tool"), F.filter(known, lambda n: F.map_contains_key(c["arguments"], n)).alias("names"), c["arguments"].alias("arguments"))

        timed = F.filter(v, lambda c: c["tool_name"].isin(*TIMES) & ~F.coalesce(c["call_id"], F.lit("")).rlike(IGNORED))
        return F.filter(F.transform(timed, relevant), lambda r: F.size(r["names"]) > 0)

    def equal(n: Column, a: Column, b: Column) -> Column:
        times = instant(J.text_of(a)) == instant(J.text_of(b))
        return F.when(n.isin(*INSTANTS), F.coalesce(times, F.lit(False))).otherwise(J.same(F.coalesce(a, F.lit("null")), b))

    def met(r: Column) -> Column:
        return F.exists(calls, lambda c: (c["tool_name"] == r["tool"]) & F.forall(r["names"], lambda n: equal(n, c["arguments"][n], r["arguments"][n])))

    def judged(v: Column) -> Column:
        r = needs(v)
        issues = F.transform(F.filter(r, lambda x: ~met(x)), lambda x: F.concat(F.lit("temporal_mismatch:"), x["tool"], F.lit(":"), F.array_join(x["names"], ",")))
        return F.struct(F.size(r).alias("n"), issues.alias("issues"))

    all_of = F.filter(F.transform(variants, judged), lambda j: j["n"] > 0)
    scored = F.transform(all_of, lambda j, i: F.struct(((j["n"] - F.size(j["issues"])) / j["n"]).alias("score"), (-i).alias("first"), j["issues"].alias("issues")))
    best = F.array_max(scored)
    right = F.struct(F.lit(1.0).alias("score"), texts().alias("issues"))
    return F.when(moved | (F.size(scored) == 0), right).otherwise(F.struct(best["score"].alias("score"), best["issues"].alias("issues")))


def phase_checks(n_phases: Column, given: Column) -> Column:
    """struct(score, issues): the share of good phases; given: array of (good, issues) in order, and 0 where there are fewer than phases. No phases: 1."""
    n, there = n_phases, F.coalesce(F.size(given), F.lit(0))
    missing = F.transform(F.sequence(there + 1, n), lambda i: F.concat(F.lit("missing_phase_answer:"), i.cast("string")))
    bad = F.flatten(F.transform(given, lambda g, i: F.when(g["good"], texts()).when(F.size(g["issues"]) == 0, F.array(F.concat(F.lit("phase_"), (i + 1).cast("string"), F.lit(":invalid_answer")))).otherwise(F.transform(g["issues"], lambda x: F.concat(F.lit("phase_"), (i + 1).cast("string"), F.lit(":"), x)))))
    none = F.struct(F.lit(1.0).alias("score"), texts().alias("issues"))
    short = F.struct(F.lit(0.0).alias("score"), missing.alias("issues"))
    whole = F.struct((F.size(F.filter(given, lambda g: g["good"])) / n).alias("score"), F.coalesce(bad, texts()).alias("issues"))
    return F.when(n == 0, none).when(there < n, short).otherwise(whole)


def allowed_periods(variants: Column, family: Column, period: Column) -> Column:
    """Periods that a moved window may name: those of the variants' own calls (null among them), else by the family."""
    own = F.flatten(F.transform(variants, lambda v: F.transform(F.filter(v, lambda c: c["tool_name"] == "aggregate_window"), lambda c: F.coalesce(c["arguments"]["period"], F.lit("null")))))
    named = F.concat(F.lit('"'), period, F.lit('"'))
    other = F.when(family == "relative_24h_mean_lookup", texts('"custom"', '"day"')).when(period.isNotNull(), F.array(named, F.lit('"custom"'))).otherwise(texts())
    return F.when(F.size(own) > 0, own).otherwise(other)


def moved_windows(tasks: DataFrame, obs: DataFrame) -> DataFrame:
    """task_id, ways (array of window_start, window_end): windows that count as the gold one, of tasks whose window may move."""
    golds = tasks.where(F.col("family").isin(*MOVABLE)).select("task_id", F.col("gold_stream").alias("stream_id"), instant(J.text_of(F.col("gold")["window_start"])).alias("window_start"), instant(J.text_of(F.col("gold")["window_end"])).alias("window_end"))
    golds = golds.where("stream_id is not null and window_start is not null and window_end is not null")
    return scoring.relaxed_windows(obs, golds).groupBy("task_id").agg(F.collect_list(F.struct("window_start", "window_end")).alias("ways"))


def with_moved_call(rows: DataFrame) -> DataFrame:
    """rows with moved: the first call on the gold stream whose window is one of `ways` (null: none), and gold and variants bound to it where it has a mean."""
    periods = allowed_periods(F.col("variants"), F.col("family"), F.col("period"))

    def fits(c: Column) -> Column:
        stream = F.coalesce(J.text_of(J.fields(c["output"])["stream_id"]), J.text_of(c["arguments"]["stream_id"]))
        start, end = instant(J.text_of(c["arguments"]["window_start"])), instant(J.text_of(c["arguments"]["window_end"]))
        period = (F.size(periods) == 0) | F.array_contains(periods, F.coalesce(c["arguments"]["period"], F.lit("null")))
        window = F.exists(F.col("ways"), lambda w: (w["window_start"] == start) & (w["window_end"] == end))
        return F.coalesce((c["tool_name"] == "aggregate_window") & (stream == F.col("gold_stream")) & period & window, F.lit(False))

    found = rows.withColumn("moved", F.get(F.filter("calls", fits), F.lit(0)))
    mean = F.nullif(J.fields(F.col("moved.output"))["mean_value"], F.lit("null"))
    found = found.withColumn("moved_mean", mean)
    bound = F.col("moved_mean").isNotNull()

    def replaced(old: Column, names: list[str]) -> Column:
        new = F.map_filter(F.col("moved.arguments"), lambda k, _: k.isin(*names))
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)

    gold = replaced(F.col("gold"), WINDOW[:2])
    gold = F.map_concat(F.map_filter(gold, lambda k, _: k != "mean_value"), F.create_map(F.lit("mean_value"), F.col("moved_mean")))
    first = F.get("variants", F.lit(0))
    at = F.array_position(F.transform(first, lambda c: c["tool_name"] == "aggregate_window"), F.lit(True)) - 1
    new = F.transform(first, lambda c, i: F.struct(c["call_id"].alias("call_id"), c["tool_name"].alias("tool_name"), F.when(i == at, replaced(c["arguments"], WINDOW)).otherwise(c["arguments"]).alias("arguments")))
    return found.withColumns({"gold": F.when(bound, gold).otherwise(F.col("gold")), "variants": F.when(bound & (F.size("variants") > 0), F.concat("variants", F.array(new))).otherwise(F.col("variants"))})


def verify(tasks: DataFrame, calls: DataFrame, answers: DataFrame, obs: DataFrame, phases: DataFrame | None = None) -> DataFrame:
    """task_id, label, strict_label, scores of process, final, core, reporting, evidence, grounding, temporal, phase and task, and issues (array) of every task.

    phases: task_id, n_phases, given (array of (good, issues) in order); tasks without a row have no phases. Tasks without calls or answers are judged as having none.
    """
    made = calls.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("position", "tool_name", "arguments", "output")), lambda a, b: (a["position"] - b["position"]).cast("int")).alias("calls"))
    empty = "array<struct<position: {}, tool_name: string, arguments: map<string,string>, output: string>>".format(dict(calls.dtypes)["position"])
    gold_stream = F.coalesce(J.text_of(F.col("gold")["stream_id"]), F.get("streams", F.lit(0)))
    rows = tasks.withColumn("gold_stream", gold_stream)
    rows = rows.join(made, "task_id", "left").join(answers.select("task_id", "final", "evidence"), "task_id", "left").join(moved_windows(rows, obs), "task_id", "left")
    rows = rows.withColumn("calls", F.coalesce("calls", F.array().cast(empty)))
    if phases is None:
        rows = rows.withColumns({"n_phases": F.lit(0), "given": F.array().cast("array<struct<good: boolean, issues: array<string>>>")})
    else:
        rows = rows.join(phases.select("task_id", "n_phases", "given"), "task_id", "left").withColumn("n_phases", F.coalesce("n_phases", F.lit(0)))
    rows = with_moved_call(rows)
    given = J.fields("final")
    own = F.filter("required", lambda f: ~f.isin(*REPORTING))
    told = F.filter("required", lambda f: f.isin(*REPORTING))
    gold, tolerance = F.col("gold"), F.col("tolerance")

    def checked(names: Column, absent: Column) -> Column:
        none = F.struct(F.lit(0.0).alias("score"), absent.alias("issues"))
        return F.when(given.isNull(), none).otherwise(field_checks(names, tolerance, gold, given))

    no_answer = texts("missing_answer_fact:final_answer")
    all_told = F.struct(F.lit(1.0).alias("score"), texts().alias("issues"))
    parts = {
        "process": process_checks(F.col("tools"), F.col("variants"), F.col("calls")),
        "final": checked(F.col("required"), no_answer),
        "core": checked(own, no_answer),
        "reporting": F.when(F.size(told) == 0, all_told).otherwise(checked(told, F.transform(told, lambda f: F.concat(F.lit("missing_reporting_field:"), f)))),
        "evidence": evidence_checks(F.col("streams"), F.col("evidence"), F.col("calls")),
        "temporal": temporal_checks(F.col("variants"), F.col("calls"), F.col("moved").isNotNull()),
        "phase": phase_checks(F.col("n_phases"), F.col("given")),
    }
    scored = rows.select("task_id", *[c.alias(f"{name}_part") for name, c in parts.items()])
    v = scoring.verdict(*(F.col(f"{name}_part.score") for name in ("process", "core", "evidence", "reporting", "temporal", "phase")))
    issues = F.concat(*(F.col(f"{name}_part.issues") for name in ("process", "temporal", "final", "evidence", "phase")))
    out = scored.withColumn("v", v)
    scores = [F.round(F.col(f"{name}_part.score"), 4).alias(f"{name}_score") for name in parts]
    return out.select("task_id", "v.label", "v.strict_label", *scores, F.col("v.grounding").alias("grounding_score"), F.col("v.task").alias("task_score"), issues.alias("issues"))
