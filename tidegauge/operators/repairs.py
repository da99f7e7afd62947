"""Repairs of task contracts: an ordered table of rules in one pass over the rows, each with its entry in the history, and phases that revise a goal.

A rule changes columns where its condition holds; the next one sees what it left. The history (array of stage, kind, status, changed) gets an entry for every rule that is to be logged: `applied` with the
names of the columns that really changed, `unchanged` where the rule left all as it was, and `skipped` where its condition doesn't hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import typed as J

HISTORY = "array<struct<stage: string, kind: string, status: string, changed: array<string>>>"


@dataclass
class Rule:
    """stage names the rule, kind groups rules; changes are expressions over the row as earlier rules left it."""

    stage: str
    kind: str
    condition: Column
    changes: dict[str, Column] = field(default_factory=dict)


def comparable(c: Column, kind: str) -> Column:
    """A value as something that can be compared: maps, and what holds them, go by their text."""
    return F.to_json(F.struct(c.alias("x"))) if "map<" in kind else c


def repaired(rows: DataFrame, rules: Sequence[Rule], history: str = "history") -> DataFrame:
    """rows after all rules in order. No rule shuffles, so that all of them are one stage."""
    if history not in rows.columns:
        rows = rows.withColumn(history, F.array().cast(HISTORY))
    for rule in rules:
        kinds = dict(rows.dtypes)
        holds = F.coalesce(rule.condition, F.lit(False))
        new = {f"_new_{n}": F.when(holds, c.cast(kinds[n])).otherwise(F.col(n)) if n in kinds else F.when(holds, c) for n, c in rule.changes.items()}
        rows = rows.withColumns({"_holds": holds, **new})
        differs = [F.when(~comparable(F.col(f"_new_{n}"), kinds[n]).eqNullSafe(comparable(F.col(n), kinds[n])), F.lit(n)) if n in kinds else F.when(F.col("_holds"), F.lit(n)) for n in rule.changes]
        changed = F.array_compact(F.array(*differs)) if differs else F.array().cast("array<string>")
        status = F.when(~F.col("_holds"), "skipped").when(F.size(changed) > 0, "applied").otherwise("unchanged")
        entry = F.struct(F.lit(rule.stage).alias("stage"), F.lit(rule.kind).alias("kind"), status.alias("status"), changed.alias("changed"))
        rows = rows.withColumn(history, F.concat(history, F.array(entry)))
        rows = rows.withColumns({n: F.col(f"_new_{n}") for n in rule.changes}).drop("_holds", *new)
    return rows


def applied(rows: DataFrame, history: str = "history") -> DataFrame:
    """stage, kind, status, n: how often each rule did what."""
    return rows.select(F.explode(history).alias("h")).groupBy("h.stage", "h.kind", "h.status").agg(F.count("*").alias("n"))


# ---- phases that revise a goal

CALL = "array<struct<call_id: string, tool_name: string, arguments: map<string,string>>>"
#: What of a revision goes into the revised gold, by the tool that answers (fixed values).
REVISED = {
    "aggregate_window": ("window_start", "window_end", "mean_value"),
    "compare_window": ("winning_stream_id", "left_stream_id", "right_stream_id", "left_mean_value", "right_mean_value"),
    "rank_window": ("stream_id", "mean_value", "window_start", "window_end"),
}


def put(old: Column, new: Column) -> Column:
    """A map with another one's entries in place of its own."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def _next_id(calls: Column) -> Column:
    return F.concat(F.lit("c"), (F.size(calls) + 1).cast("string"))


def _with_call(calls: Column, last: Column, arguments: Column) -> Column:
    """calls with another one like `last`, its arguments replaced by these."""
    return F.concat(calls, F.array(F.struct(_next_id(calls).alias("call_id"), last["tool_name"].alias("tool_name"), put(last["arguments"], arguments).alias("arguments"))))


def _again(calls: Column, first: Column, arguments: Column) -> Column:
    """The variant that asks its first steps again: `first` (calls of one tool) copied, and the last call on what they give.

    Copies' ids count on, and a reference of the last call to a first step names its copy.
    """
    last = F.element_at(calls, -1)
    n = F.size(calls)
    copies = F.transform(first, lambda c, i: F.struct(F.concat(F.lit("c"), (n + i + 1).cast("string")).alias("call_id"), c["tool_name"].alias("tool_name"), c["arguments"].alias("arguments")))
    pairs = F.transform(first, lambda c, i: F.struct(F.concat(F.lit("$"), c["call_id"], F.lit(".")).alias("old"), F.concat(F.lit("$c"), (n + i + 1).cast("string"), F.lit(".")).alias("new")))
    moved = F.transform_values(put(last["arguments"], arguments), lambda _, v: F.aggregate(pairs, v, lambda a, p: F.replace(a, p["old"], p["new"])))
    final = F.struct(F.concat(F.lit("c"), (n + F.size(first) + 1).cast("string")).alias("call_id"), last["tool_name"].alias("tool_name"), moved.alias("arguments"))
    return F.concat(calls, copies, F.array(final))


def revise_goals(rows: DataFrame, revisions: DataFrame, milestone: str = "provide_stream_evidence") -> DataFrame:
    """rows with a phase more where there is a revision: the gold of the new window, its call in the calls and in each variant, a variant that resolves its streams again, turns and milestones.

    rows: task_id, gold (map of frozen values), phase_golds (array of such), calls and variants (arrays of call_id, tool_name, arguments; ids c1, c2, ...), turns (array of prompts), milestones (array of names),
    max_turns. revisions: task_id, kind (the tool that answers), direction, prompt, window_start and window_end (frozen), values (map of frozen values of the revised gold), one a task.
    """
    joined = rows.join(revisions.select("task_id", F.struct("kind", "direction", "prompt", "window_start", "window_end", "values").alias("_r")), "task_id", "left")
    r = F.col("_r")
    has = F.col("_r").isNotNull() & r["kind"].isin(*REVISED)
    window = F.create_map(F.lit("window_start"), r["window_start"], F.lit("window_end"), r["window_end"])
    names = F.element_at(F.create_map(*[x for k, v in REVISED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), r["kind"])
    gold = put(F.col("gold"), F.map_filter(F.map_concat(F.map_filter(r["values"], lambda k, _: ~k.isin("window_start", "window_end")), window), lambda k, _: F.array_contains(names, k)))
    calls = _with_call(F.col("calls"), F.element_at("calls", -1), window)

    def extended(v: Column) -> Column:
        starts = F.filter(v, lambda c, i: (c["tool_name"] == F.get(v, F.lit(0))["tool_name"]) & (i < F.size(v) - 1))
        opening = F.get(v, F.lit(0))["tool_name"]
        wanted = ((opening == "resolve_point") & (((r["kind"] == "aggregate_window") & (F.size(starts) >= 1)) | ((r["kind"] == "compare_window") & (F.size(starts) >= 2)))) | ((opening == "list_points") & (r["kind"] == "rank_window"))
        first = F.slice(starts, 1, F.when(r["kind"] == "compare_window", 2).otherwise(1))
        own = _with_call(v, F.element_at(v, -1), window)
        return F.when(F.coalesce(wanted, F.lit(False)), F.array(own, _again(v, first, window))).otherwise(F.array(own))

    variants = F.flatten(F.transform("variants", extended))
    at = F.array_position(F.col("milestones"), F.lit(milestone))
    place = F.when(at > 0, at.cast("int") - 1).otherwise(F.size("milestones"))
    inserted = F.concat(F.slice("milestones", F.lit(1), place), F.array(F.lit("receive_goal_revision"), F.lit("deliver_revised_operator_answer")), F.slice("milestones", place + 1, F.size("milestones")))
    changes = {
        "phase_golds": F.array(F.col("gold"), gold), "calls": calls, "variants": variants, "turns": F.array(r["prompt"]),
        "milestones": inserted, "max_turns": F.col("max_turns") + 1, "gold": gold,
    }
    return repaired(joined, [Rule("goal_revision_contract_repair", "repair", has, changes)]).drop("_r")


def as_call(call_id: str, tool: str, **arguments: Column) -> Column:
    return F.struct(F.lit(call_id).alias("call_id"), F.lit(tool).alias("tool_name"), J.written(**arguments).alias("arguments"))
