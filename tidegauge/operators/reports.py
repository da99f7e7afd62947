"""Episodes assembled from static tasks, and reports over their verdicts: labels, categories of issues, what blocked first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.intents import error_category, issue_category
from tidegauge.operators.repairs import HISTORY


def assembled(static: DataFrame, mode: Column, slots: Column) -> DataFrame:
    """Static tasks (task_id, family, ...) as episodes: mode, slots to ask for (array), the static id that they rest on, and a history of how they came to be."""
    entries = [("seed_static_task", "seed", "observed"), ("contract_generation", "contract", "generated")]
    none = F.array().cast("array<string>")
    history = F.array(*[F.struct(F.lit(a).alias("stage"), F.lit(b).alias("kind"), F.lit(c).alias("status"), none.alias("changed")) for a, b, c in entries]).cast(HISTORY)
    return static.select("*", mode.alias("mode"), F.coalesce(slots, none).alias("slots"), F.col("task_id").alias("static_id"), history.alias("history"))


def mode_counts(episodes: DataFrame) -> DataFrame:
    """split, family, mode, n, n_clarify by every split, family and mode, by each alone (the others null), and in all; level tells which were summed over."""
    sets = F.grouping_id()
    sums = [F.count("*").alias("n"), F.count(F.when(F.size("slots") > 0, 1)).alias("n_clarify")]
    return episodes.cube("split", "family", "mode").agg(*sums, sets.cast("long").alias("level")).where(F.col("level").isin(0, 3, 5, 6, 7))


def failures(results: DataFrame) -> DataFrame:
    """results (task_id, label, error, traced, issues and the parts' issues as arrays) with categories (distinct, sorted) and the layer that blocked first.

    The layers in order: an error of the controller, no trace of the dialogue, phases, calls, times, the final answer.
    """
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    layers = [
        (error_category("error") != "none", "controller_parse_or_binding_failure"), (~F.coalesce("traced", F.lit(False)), "protocol_trace_missing"), (n("phase_issues"), "phase_completion_failure"),
        (n("process_issues"), "tool_process_failure"), (n("temporal_issues"), "temporal_contract_failure"), (n("final_issues"), "final_answer_failure"),
    ]
    first = F.coalesce(*[F.when(c, F.lit(name)) for c, name in layers], F.lit("other_failure"))
    categories = F.array_sort(F.array_distinct(F.transform(F.coalesce("issues", F.array().cast("array<string>")), issue_category)))
    return results.withColumns({"categories": categories, "error_category": error_category("error"), "layer": F.when(F.col("label") == "accomplished", None).otherwise(first)})


def report(results: DataFrame, *by: str) -> DataFrame:
    """by, what (label or category), value, n: how many tasks have each label and each category of issues."""
    pairs = F.concat(
        F.array(F.struct(F.lit("label").alias("what"), F.col("label").alias("value"))), F.transform("categories", lambda c: F.struct(F.lit("category").alias("what"), c.alias("value"))),
    )
    return results.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.what", "p.value").agg(F.count("*").alias("n"))


def witnesses(results: DataFrame, *by: str) -> DataFrame:
    """by, n, n_accomplished, rate: what a controller that should fail has solved all the same."""
    good = F.count(F.when(F.col("label") == "accomplished", 1))
    return results.groupBy(*by).agg(F.count("*").alias("n"), good.alias("n_accomplished"), F.round(good / F.count("*"), 4).alias("rate"))
