"""Scores of predictions against gold answers, evidence, calls and phases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import within
from tidegauge.operators.asof import nearest


def structured(rows: DataFrame, fields: dict[str, float | None]) -> DataFrame:
    """rows with gold_<f> and pred_<f>: how many fields are missing, wrong, and right of all. A tolerance makes a field a number, None an exact value.

    Every field is checked, with or without a gold value; one that isn't given is wrong.
    """
    checks = []
    for f, tolerance in fields.items():
        gold, pred = F.col(f"gold_{f}"), F.col(f"pred_{f}")
        good = within(gold, pred, tolerance) if tolerance is not None else F.coalesce(gold == pred, F.lit(False))
        checks.append(F.struct(F.lit(f).alias("field"), pred.isNull().alias("missing"), good.alias("good")))
    c = F.array(*checks)
    total = F.size(c)
    right = F.size(F.filter(c, lambda x: x["good"]))
    return rows.withColumns({
        "n_checks": total.cast("bigint"), "n_missing": F.size(F.filter(c, lambda x: x["missing"])).cast("bigint"),
        "score": F.when(total > 0, right / total).otherwise(1.0), "ok": right == total,
        "issues": F.array_join(F.transform(F.filter(c, lambda x: ~x["good"]), lambda x: F.concat(F.when(x["missing"], "missing_").otherwise("wrong_"), x["field"])), ","),
    })


def recall(required: Column, given: Column) -> Column:
    """Share of required items, repeats counted, that are given; 1 where nothing is required."""
    n, there = F.size(required), F.coalesce(given, F.array().cast("array<string>"))
    return F.when(n == 0, 1.0).otherwise(F.size(F.filter(required, lambda x: F.array_contains(there, x))) / n)


def sequence_match(gold: Column, given: Column, equal=lambda g, p: g == p) -> Column:
    """Share of a gold sequence's places at which the given one agrees; 1 for an empty one. What is given beyond it doesn't count."""
    n = F.size(gold)
    same = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(equal(F.get(gold, i), F.get(given, i)), F.lit(False))))
    return F.when(n == 0, 1.0).otherwise(same / n)


def process(required: Column, variants: Column, given: Column) -> Column:
    """The better of the recall of required tools and the best match with a variant."""
    best = F.coalesce(F.array_max(F.transform(variants, lambda v: sequence_match(v, given))), F.lit(0.0))
    return F.greatest(recall(required, given), best)


def temporal(requirements: DataFrame, calls: DataFrame) -> DataFrame:
    """task_id, score: the share of a task's required windows (task_id, tool, window_start, window_end) that some call has; each requirement counts once."""
    keys = ["task_id", "tool", "window_start", "window_end"]
    met = requirements.join(calls.select(*keys).distinct().withColumn("met", F.lit(1)), keys, "left")
    return met.groupBy("task_id").agg((F.sum(F.coalesce("met", F.lit(0))) / F.count("*")).alias("score"))


def temporal_best(requirements: DataFrame, calls: DataFrame, ignored: tuple[str, ...] = ("sample", "quality")) -> DataFrame:
    """task_id, score: the best of a task's variants (task_id, variant, call_id, tool, window_start, window_end) by the share of its windows that some call has.

    Requirements whose call_id holds an ignored word don't count; a task without others scores 1.
    """
    keys = ["task_id", "tool", "window_start", "window_end"]
    counts = ~F.coalesce(F.col("call_id"), F.lit("")).rlike("|".join(ignored)) if ignored else F.lit(True)
    met = requirements.where(counts).join(calls.select(*keys).distinct().withColumn("met", F.lit(1)), keys, "left")
    shares = met.groupBy("task_id", "variant").agg((F.sum(F.coalesce("met", F.lit(0))) / F.count("*")).alias("score"))
    best = shares.groupBy("task_id").agg(F.max("score").alias("score"))
    return requirements.select("task_id").distinct().join(best, "task_id", "left").withColumn("score", F.coalesce("score", F.lit(1.0)))


def relaxed_windows(obs: DataFrame, golds: DataFrame) -> DataFrame:
    """task_id, stream_id, label, window_start, window_end that count as a gold window (task_id, stream_id, window_start, window_end).

    The window itself, then its ends moved to the stream's nearest observations, or its start with the same length; equal ones keep the first label. A task may have several
    streams and windows.
    """
    probe = F.explode(F.array("window_start", "window_end")).alias("probe_ts")
    asked = golds.select("stream_id", probe).distinct().withColumn("probe_id", F.xxhash64("stream_id", "probe_ts"))
    # Of the other streams nothing is asked.
    near = nearest(obs.join(asked.select("stream_id").distinct(), "stream_id", "left_semi"), asked)
    at = near.groupBy("stream_id", "probe_ts").agg(F.max("observed_ts").alias("near"))

    def side(name: str, column: str) -> DataFrame:
        return at.select("stream_id", F.col("probe_ts").alias(column), F.col("near").alias(name))

    rows = golds.join(side("a", "window_start"), ["stream_id", "window_start"], "left").join(side("b", "window_end"), ["stream_id", "window_end"], "left")
    s, e, a, b = (F.col(x) for x in ("window_start", "window_end", "a", "b"))
    ways = [("exact", s, e), ("exact_start_nearest_end", s, b), ("nearest_start_fixed_duration", a, a + (e - s)), ("nearest_start_nearest_end", a, b)]
    tries = F.array(*[F.struct(F.lit(name).alias("label"), x.alias("window_start"), y.alias("window_end")) for name, x, y in ways])
    every = rows.select("task_id", "stream_id", F.posexplode(tries).alias("place", "w")).where("w.window_end > w.window_start")
    first = every.groupBy("task_id", "stream_id", "w.window_start", "w.window_end").agg(F.min_by("w.label", "place").alias("label"))
    return first.select("task_id", "stream_id", "label", "window_start", "window_end")


def phase_score(phases: DataFrame, answers: DataFrame) -> DataFrame:
    """task_id, score: the share of phases (task_id, phase) with a good answer (task_id, phase, good); 0 where a phase has none."""
    both = phases.join(answers, ["task_id", "phase"], "left")
    share = F.sum(F.coalesce(F.col("good").cast("int"), F.lit(0))) / F.count("*")
    return both.groupBy("task_id").agg(F.when(F.bool_or(F.col("good").isNull()), 0.0).otherwise(share).alias("score"))


def verdict(process: Column, core: Column, evidence: Column, reporting: Column, timing: Column, phases: Column) -> Column:
    """struct of grounding, task score, label and strict label from the part scores (0 to 1, 1 is good).

    Grounding is the mean of evidence and reporting; a task the mean of core, grounding, time and phases; strict takes the process with it.
    """
    grounding = (evidence + reporting) / 2
    task = (core + grounding + timing + phases) / 4
    good = (core == 1) & (evidence == 1) & (reporting == 1) & (timing == 1) & (phases == 1)

    def grade(ok: Column, score: Column) -> Column:
        return F.when(ok, "accomplished").when(score > 0, "partially_accomplished").otherwise("not_accomplished")

    return F.struct(F.round(grounding, 4).alias("grounding"), F.round(task, 4).alias("task"), grade(good, task).alias("label"), grade(good & (process == 1), (process + task) / 2).alias("strict_label"))


def label(core: Column, grounding: Column, timing: Column, phases: Column) -> Column:
    """The first that fails of core answer, grounding, time and phases; success if none does."""
    return F.when(~core, "wrong_answer").when(~grounding, "ungrounded").when(~timing, "wrong_time").when(~phases, "phases_missing").otherwise("success")


def mentions(text: Column, variants: Column | list[Column]) -> Column:
    """Whether the text holds any of the variants. Columns in a list are compiled; those inside an array and its lambda are walked through for every row."""
    if isinstance(variants, list):
        return reduce(lambda a, b: a | b, [F.contains(text, v) for v in variants])
    return F.exists(variants, lambda v: F.contains(text, v))
