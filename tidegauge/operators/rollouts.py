"""Features of rollouts (calls, outputs and an answer) and a trained model of whether a task was accomplished."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import typed as J
from tidegauge.functions.columns import fixed, normalize_text
from tidegauge.functions.texts import NUMBER, TIMESTAMP

# Words that an answer mentions, and the kinds of errors of a transcript.
MENTIONS = {
    "average": ("average", "mean"), "nearest": ("nearest", "closest"), "compare": ("higher", "greater", "larger"),
    "top": ("top", "highest", "rank"), "abstain": ("abstain", "not reliable", "not healthy"),
}
ERRORS = {"json": "json_parse_error", "tool_exec": "tool_execution_error", "missing": "missing_tool_call_or_final_answer"}


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int").cast("double")


def numbers_of(json: Column) -> Column:
    """All numbers of a JSON text at any depth, as written in its frozen form; names, texts and truth values are none."""
    bare = F.regexp_replace(J.frozen(json), r'"(?:[^"\\]|\\.)*"', "")
    return F.coalesce(F.regexp_extract_all(bare, F.lit(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0)), F.array().cast("array<string>"))


def times_of(json: Column) -> Column:
    """All texts of a JSON text at any depth that hold a time."""
    return F.filter(F.coalesce(J.texts_in(json), F.array().cast("array<string>")), lambda t: t.rlike(TIMESTAMP))


def written_numbers(numbers: Column) -> Column:
    """How numbers may be told: with four to one decimals, and without zeros at their end."""
    def ways(x: Column) -> Column:
        v = x.cast("double")
        texts = [fixed(v, n) for n in (4, 3, 2, 1)]
        cut = [F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "") for t in texts]
        return F.array(*[normalize_text(t) for t in texts + cut])

    return F.array_distinct(F.flatten(F.transform(numbers, ways)))


def written_times(times: Column) -> Column:
    """How instants may be told: with day and time, day alone, time alone, or the month in words."""
    from tidegauge.functions.columns import instant

    formats = ("yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "HH:mm:ss", "HH:mm", "MMM dd, yyyy HH:mm", "MMMM dd, yyyy HH:mm")
    each = F.transform(times, lambda t: F.array(*[normalize_text(F.date_format(instant(t), f)) for f in formats]))
    return F.array_distinct(F.filter(F.flatten(each), lambda x: x.isNotNull()))


def overlap(text: Column, variants: Column) -> Column:
    """The share of the variants that stand in the text; 0 where there are none."""
    n = F.size(variants)
    return F.when(n > 0, F.size(F.filter(variants, lambda v: (v != "") & F.contains(text, v))) / n).otherwise(0.0)


def features(rollouts: DataFrame, families: list[str], tools: list[str]) -> DataFrame:
    """task_id and a column of doubles for each feature; FEATURES names them.

    rollouts: task_id, family, calls (array of tool_name and output as JSON, in order), answer (JSON or null), error (text or null), terms (array of the words that describe the streams of
    the outputs). An answer that is a JSON text is one in words; objects have no words.
    """
    words = F.coalesce(J.text_of(J.frozen("answer")), F.lit(""))
    text = F.coalesce(normalize_text(words), F.lit(""))
    names = F.transform("calls", lambda c: c["tool_name"])
    last = F.get("calls", F.size("calls") - 1)
    outputs = F.transform("calls", lambda c: c["output"])
    ids = lambda x: F.array_distinct(F.transform(F.coalesce(J.texts_in(x), F.array().cast("array<string>")), normalize_text))
    all_ids = F.array_distinct(F.flatten(F.transform(outputs, ids)))
    counts = F.transform(outputs, lambda o: J.fields(o))
    error = F.coalesce(F.col("error"), F.lit(""))
    out = {
        "num_steps": F.size("calls").cast("double"), "has_final_answer": flag(F.col("answer").isNotNull()), "final_answer_is_text": flag(J.is_text(J.frozen("answer"))), "has_parse_error": flag(error != ""),
        **{f"parse_error_{k}": flag(F.contains(error, F.lit(v))) for k, v in ERRORS.items()},
        "any_zero_match": flag(F.exists(counts, lambda m: J.number_of(m["match_count"]) == 0)), "any_positive_aggregate_count": flag(F.exists(counts, lambda m: ~J.is_text(m["count"]) & (J.number_of(m["count"]) > 0))),
        **{f"family_{f}": flag(F.col("family") == f) for f in families},
        **{f"tool_count_{t}": (F.size(names) - F.size(F.array_remove(names, t))).cast("double") for t in tools},
        **{f"last_tool_{t}": flag(last["tool_name"] == t) for t in tools},
        "answer_len_tokens": F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("double"), "answer_has_digits": flag(text.rlike(NUMBER)), "answer_has_timestamp": flag(words.rlike(TIMESTAMP)),
        **{f"answer_mentions_{k}": flag(text.rlike("|".join(v))) for k, v in MENTIONS.items()},
        "last_number_overlap": overlap(text, written_numbers(numbers_of(last["output"]))), "last_timestamp_overlap": overlap(text, written_times(times_of(last["output"]))),
        "last_stream_overlap": overlap(text, ids(last["output"])), "all_stream_overlap": overlap(text, all_ids), "descriptor_overlap": overlap(text, F.array_distinct(F.coalesce(F.transform("terms", normalize_text), F.array().cast("array<string>")))),
    }
    return rollouts.select("task_id", *[c.alias(n) for n, c in out.items()])


def target(process: Column, final: Column, evidence: Column) -> Column:
    """How useful a rollout was, 0 to 1, from its scores."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * process + 0.3 * final + 0.1 * evidence))


def train(rows: DataFrame, names: list[str], label: str, hidden: int = 64, rounds: int = 100, seed: int = 7) -> PipelineModel:
    """A classifier of the features `names` with one hidden layer; label is 0.0 or 1.0. Gradients are summed over partitions, so that no task holds all rows."""
    assemble = VectorAssembler(inputCols=names, outputCol="_raw", handleInvalid="error")
    scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)
    network = MultilayerPerceptronClassifier(featuresCol="_x", labelCol=label, layers=[len(names), hidden, 2], maxIter=rounds, seed=seed, predictionCol="_class", probabilityCol="_p", rawPredictionCol="_r")
    return Pipeline(stages=[assemble, scale, network]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with probability, that of the label 1."""
    return model.transform(rows).withColumn("probability", vector_to_array("_p")[1]).drop("_raw", "_x", "_class", "_p", "_r")
