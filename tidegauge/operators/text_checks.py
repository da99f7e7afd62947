"""Answers in words against gold answers: each family of tasks has facts to tell, and a fact is told if the text holds any of the ways to say it.

tasks: task_id, family, gold (map of frozen values), required (names of fields), and answers: task_id, text. Streams may be told by their id or by a label of theirs, numbers with four to one decimals,
instants in any of several forms, and decisions, reasons and the like by the words below. Each fact is a row, which meets the tables of words by broadcast and the streams' labels by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import typed as J
from tidegauge.functions.columns import instant, normalize_answer, number_variants, with_fixed
from tidegauge.functions.texts import SHORT_FORMS
from tidegauge.operators.verification import REPORTING

MEANS = ("day_mean_lookup", "relative_24h_mean_lookup", "window_mean_lookup")

# The ways to tell the value of a field, what facts each family tells (name of the fact, how it is told, field), and words that a fact needs without a field.
SAID: dict[str, dict[str, list[str]]] = {
    "resolution_status": {
        "exact": ["exact match", "exact logged match", "exact logged reading"],
        "unique_nearest": ["unique nearest match", "nearest match", "nearest available one"],
        "ambiguous_nearest": ["too ambiguous", "ambiguous", "public time alone", "more precise timestamp"],
    },
    "stability_status": {
        "same_winner": ["stayed the same", "same winner", "same top-ranked stream", "same top stream"],
        "winner_changed": ["changed", "winner changed", "top-ranked stream changed", "different winner"],
    },
    "trend_status": {
        "quality_improved": ["improved", "got better", "quality improved", "more reliable", "better"],
        "quality_worsened": ["worsened", "got worse", "quality worsened", "less reliable", "worse"],
        "quality_stable": ["stayed about the same", "stayed the same", "roughly the same", "quality stayed similar", "about the same", "same"],
    },
    "decision": {
        "abstain": ["i would abstain", "would abstain", "cannot answer", "can't answer", "not reliable enough", "insufficient", "not enough data"],
        "answer": ["i would answer", "would answer", "healthy enough to answer", "reliable enough to answer", "looks healthy enough to answer"],
    },
    "reason": {
        "low_coverage": ["coverage", "low coverage", "insufficient coverage", "not enough data"],
        "long_gap": ["gap", "longest gap", "large gap", "big gap", "missing data"],
        "healthy": ["healthy", "reliable enough", "looks healthy", "quality looks healthy"],
        "healthy_quality": ["reliable enough to report", "result is reliable enough to report", "quality is healthy enough to report", "quality is healthy", "looks healthy"],
        "marginal_quality": ["marginal", "not reliable enough", "coverage", "gap ratio", "quality"],
        "exact_timestamp": ["exact timestamp", "timestamp is exact", "exact logged reading", "exact reading"],
        "nearest_but_acceptable": ["nearest available timestamp is close enough", "nearest available timestamp", "close enough", "nearest is acceptable"],
        "timestamp_too_imprecise": ["current time is too imprecise", "time is too imprecise", "need a more precise timestamp", "more precise timestamp"],
    },
    "commitment_action": {
        "answer": ["report it as-is", "report it as is", "would report it", "report it", "report the reading as-is", "report the reading as is", "report the value as-is", "report the value as is"],
        "abstain": ["abstain", "cannot report", "not report it", "would not report the reading as-is", "would not report the reading as is", "would not report the value as-is", "would not report the value as is"],
        "re_clarify": ["ask for a more precise timestamp", "ask for a narrower time range", "ask for more detail", "ask for more time detail", "need more time detail", "need a more precise timestamp", "need a narrower time range", "before reporting it"],
    },
    "clarification_request": {
        "more_precise_timestamp": ["more precise timestamp", "precise timestamp", "more exact time"],
        "narrower_time_range": ["narrower time range", "narrower window", "more precise time range"],
    },
}
FALLBACK = ["nearest", "closest", "no exact"]
CUES = {
    "comparative_cue": ["higher", "larger", "greater"],
    "nearest_cue": FALLBACK,
    "exact_cue": ["exact logged", "exact match", "exact reading"],
    "sample_exact_match_found": ["exact match", "exact logged", "exact sample", "matched exactly"],
}
NUMBERS = ("left_mean_value", "right_mean_value", "mean_value", "value", "observed_fraction", "gap_ratio", "offset_seconds")
TIMES = ("observed_timestamp", "sample_checked_timestamp")
STREAMS = ("stream_id", "winning_stream_id")
FAMILIES: dict[str, list[tuple[str, str]]] = {
    # (fact, the field that it tells or the cue that it is)
    "point_disambiguation": [("stream_id", "stream_id")],
    **{f: [("mean_value", "mean_value")] for f in MEANS},
    "window_pairwise_compare": [("winning_stream", "winning_stream_id"), ("comparative_cue", "comparative_cue"), ("left_mean_value", "left_mean_value"), ("right_mean_value", "right_mean_value")],
    "window_rank": [("winning_stream", "stream_id"), ("mean_value", "mean_value")],
    "rank_stability_assessment": [("stability_status", "stability_status")],
    "timestamp_value_lookup": [("observed_timestamp", "observed_timestamp"), ("value", "value")],
    "timestamp_nearest_lookup": [("nearest_cue", "nearest_cue"), ("observed_timestamp", "observed_timestamp"), ("value", "value")],
    "quality_gate": [("decision", "decision")],
    "quality_trend_assessment": [("trend_status", "trend_status")],
    "timestamp_resolution_context": [("resolution_status", "resolution_status"), ("observed_timestamp", "observed_timestamp"), ("offset_seconds", "offset_seconds")],
    "quality_preference": [("preferred_reference", "preferred_reference")],
    "timestamp_preference": [("preferred_reference", "preferred_reference"), ("exact_cue", "exact_or_nearest"), ("observed_timestamp", "observed_timestamp"), ("value", "value")],
    "reporting_commitment": [("commitment_action", "commitment_action")],
    "timestamp_reportability_decision": [("commitment_action", "commitment_action")],
}
# Of follow-up answers: what tells a decision, what speaks against it, and what gives its reason; cues of a ranking and of a comparison.
RATIONALE = {
    "answer": (
        ["would answer", "would not abstain", "not abstain", "can answer", "answer this", "healthy enough", "reliable enough", "looks healthy", "supports answering", "supports reporting"],
        ["would abstain", "cannot answer", "can't answer", "insufficient"],
    ),
    "abstain": (["abstain", "cannot answer", "can't answer", "not reliable enough", "insufficient", "not enough data", "poor quality"], []),
}
REASONS = {
    "coverage": ["coverage", "observed fraction", "fraction observed"],
    "gap": ["gap ratio", "longest gap", "large gap", "big gap", "too many gaps", "missing data", "missingness"],
    "quality": ["data quality", "signal quality", "quality metrics", "quality is poor", "quality looks healthy", "quality is healthy", "quality is reliable"],
}
RANKING = ["ranked", "ranking", "candidate streams", "candidate points", "across streams", "across points"]
COMPARISON = ["winning", "higher average", "higher mean", "higher value", "compared", "comparison", "versus", "vs"]
#: A cue that tells a field of its own, and families of which a reason need not be told.
CUE_OF = {"nearest_cue": "fallback_reason", "exact_or_nearest": "fallback_reason"}
SILENT = ("reporting_commitment", "timestamp_reportability_decision")

_TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "HH:mm:ss", "HH:mm", "MMM dd, yyyy HH:mm", "MMMM dd, yyyy HH:mm")


def texts(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def said_number(value: Column) -> Column:
    """The ways to write a number, each with and without zeros at its end; none for what is no number."""
    v = J.number_of(value)
    ways = number_variants(v)
    cut = F.transform(ways, lambda w: F.regexp_replace(F.regexp_replace(w, r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    return F.when(v.isNull(), texts([])).otherwise(F.array_distinct(F.concat(ways, cut)))


def said_time(value: Column) -> Column:
    t = instant(J.text_of(value))
    return F.when(t.isNull(), texts([])).otherwise(F.transform(F.array(*[F.date_format(t, f) for f in _TIME_FORMATS]), normalize_answer))


def said_date(value: Column, period: Column) -> Column:
    """A day or the time of it; in a month's answer also the month and year. Longer forms hold one of these."""
    t = instant(J.text_of(value))
    forms = [normalize_answer(F.date_format(t, f)) for f in ("MMM dd", "MMMM dd", "yyyy-MM-dd", "HH:mm")]
    months = [F.when(period == "month", normalize_answer(F.date_format(t, f))) for f in ("MMM yyyy", "MMMM yyyy")]
    return F.array_compact(F.array(*forms, *months))


def said_reference(gold: Column) -> Column:
    """The ways to tell which of two results is preferred: first or second, its stream, its day or time."""
    period = J.text_of(gold["period"])
    dates = [said_date(gold[f], period) for f in ("window_start", "requested_timestamp", "observed_timestamp")]
    return F.concat(F.array_compact(F.array(normalize_answer(J.text_of(gold["preferred_reference"])), normalize_answer(J.text_of(gold["stream_id"])))), *dates)


def said_window(start: Column, period: Column) -> Column:
    """The ways to tell a window as a basis: a week's beginning, a month, a day, else the instant."""
    t = instant(J.text_of(start))
    told = lambda *formats: F.array_compact(F.array(*[F.concat(F.lit(head), normalize_answer(F.date_format(t, f))) for head, f in formats]))
    week = told(("week beginning ", "MMM dd"), ("week beginning ", "MMMM dd"), ("week of ", "MMM dd, yyyy"), ("week of ", "MMMM dd, yyyy"))
    month, day = told(("", "MMM yyyy"), ("", "MMMM yyyy")), told(("", "MMM dd"), ("", "MMMM dd"), ("", "yyyy-MM-dd"))
    return F.when(period == "week", week).when(period == "month", month).when(period == "day", day).otherwise(said_time(start))


def label_ways(label: Column | str) -> Column:
    """A label, it with equipment in short form, and it without a first word that has an underscore; none for a blank one."""
    t = normalize_answer(label)
    short = [F.when(F.contains(t, F.lit(k)), F.replace(t, F.lit(k), F.lit(v))) for k, v in SHORT_FORMS.items()]
    rest = F.nullif(F.regexp_extract(t, r"^[^ ]*_[^ ]* (.*)$", 1), F.lit(""))
    return F.filter(F.array_compact(F.array(t, *short, rest)), lambda x: x != "")


def stream_labels(inventory: DataFrame) -> DataFrame:
    """stream_id, names: the ways to say its point, equipment and location."""
    each = F.array_distinct(F.flatten(F.array(*[label_ways(c) for c in ("point_label", "equipment_label", "location_label")])))
    return inventory.select("stream_id", each.alias("names")).groupBy("stream_id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the fixed values above, for broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def facts(tasks: DataFrame, core: bool, reporting: bool) -> DataFrame:
    """tasks once for each fact that its answer has to tell, in one row each: place, name, field, extra (null for a task without any).

    These are the facts of its family, then other required fields (extra: only where there are ways to tell them). The families' lists come by broadcast, so that no task is shuffled for them.
    """
    own = _table(tasks.sparkSession, [(f, [(k, n, x, False) for k, (n, x) in enumerate(list_)], [CUE_OF.get(x, x) for _, x in list_]) for f, list_ in FAMILIES.items()], "family string, own array<struct<place: int, name: string, field: string, extra: boolean>>, done array<string>")
    fact = lambda place, name, field, extra: F.struct(place.cast("int").alias("place"), name.alias("name"), field.alias("field"), extra.alias("extra"))
    required, done = F.coalesce("required", texts([])), F.coalesce("done", texts([]))
    parts = []
    if core:
        quiet = lambda x: F.col("family").isin(*SILENT) & (x == "reason")
        more = F.filter(F.transform(required, lambda x, k: fact(k + 100, x, x, F.lit(True))), lambda f: ~f["field"].isin(*REPORTING) & ~F.array_contains(done, f["field"]) & ~quiet(f["field"]))
        parts += [F.coalesce("own", F.array(fact(F.lit(0), F.lit("fallback"), F.lit("fallback"), F.lit(False)))), more]
    if reporting:
        parts.append(F.transform(F.array_intersect(required, texts(REPORTING)), lambda x: fact(F.when(x == REPORTING[0], 1000).otherwise(1001), x, x, x == REPORTING[1])))
    return tasks.join(own, "family", "left").select(*tasks.columns, F.explode_outer(F.concat(*parts)).alias("fact")).select(*tasks.columns, "fact.*")


def check(tasks: DataFrame, answers: DataFrame, inventory: DataFrame, core: bool = True, reporting: bool = True) -> DataFrame:
    """task_id, ok, score, issues of every task's answer; without an answer no fact is told. core: facts of the family and required fields; reporting: the fields that report.

    A task meets its answer once, its facts meet the labels of their streams, and are summed up: three shuffles. What Spark would broadcast by the size of files says how it is joined.
    """
    spark = tasks.sparkSession
    text = answers.select("task_id", normalize_answer(F.coalesce("text", F.lit(""))).alias("said"))
    answered = tasks.select("task_id", "family", "gold", "required").join(text.hint("shuffle_merge"), "task_id", "left").withColumn("said", F.coalesce("said", F.lit("")))
    field, none, value = F.col("field"), texts([]), F.col("gold")[F.col("field")]
    exact = (F.col("family") == "point_disambiguation") & (field == "stream_id") & ~F.col("extra")
    asked = facts(answered, core, reporting).withColumn("word", J.text_of(value))
    # Numbers and times are read once, and each step on them is a column of its own.
    asked = asked.withColumns({"number": F.when(field.isin(*NUMBERS), J.number_of(value)), "time": F.when(field.isin(*TIMES), instant("word")), "stream": F.when(field.isin(*STREAMS) & ~F.coalesce(exact, F.lit(False)), F.col("word"))})
    said = _table(spark, [(f, v, w) for f, values in SAID.items() for v, w in values.items()], "field string, word string, phrases array<string>")
    cues = _table(spark, [*CUES.items(), ("fallback_reason", FALLBACK)], "field string, cue array<string>")
    rows = asked.join(said, ["field", "word"], "left").join(cues, "field", "left")
    plain = F.when(F.coalesce(F.col("word"), F.lit("")) != "", F.array(normalize_answer("word"))).otherwise(none)
    ways = (
        F.when(F.col("cue").isNotNull(), F.col("cue")).when(field == "fallback", F.array(normalize_answer(J.object_of("gold"))))
        .when(field == "preferred_reference", said_reference(F.col("gold"))).when(field == "exact_or_nearest", F.when(F.col("gold")["exact_match_found"] == "true", texts(CUES["exact_cue"])).otherwise(texts(FALLBACK)))
        .when(field.isin(*STREAMS), plain).when(field.isin(*SAID), F.coalesce("phrases", plain)).otherwise(none)
    )
    rows = rows.select("task_id", "place", "name", "extra", "said", "number", "time", "stream", ways.alias("ways"))
    numbers = [f"_number{n}" for n in (4, 3, 2, 1)]
    for n, name in zip((4, 3, 2, 1), numbers, strict=True):
        rows = with_fixed(rows, name, "number", n)
    told = lambda w: (w != "") & F.contains("said", w)
    # A number without the zeros at its end begins the one with them, so that a text with either has it.
    by_number = reduce(Column.__or__, [told(F.rtrim(F.rtrim(F.col(c), F.lit("0")), F.lit("."))) for c in numbers])
    by_time = reduce(Column.__or__, [told(normalize_answer(F.date_format("time", f))) for f in _TIME_FORMATS])
    good = F.when(F.col("number").isNotNull(), by_number).when(F.col("time").isNotNull(), by_time).otherwise(holds(F.col("said"), F.col("ways")))
    counts = F.col("name").isNotNull() & (~F.col("extra") | F.col("number").isNotNull() | F.col("time").isNotNull() | (F.size("ways") > 0))
    rows = rows.select("task_id", "place", "name", "said", "stream", counts.alias("counts"), F.coalesce(good, F.lit(False)).alias("good"))
    # Only a stream that isn't told by its id asks for labels, and takes the text along; other facts are dealt by their task, as a single key would take them all to one place.
    asks = F.col("stream").isNotNull() & ~F.col("good")
    dealt = rows.select("task_id", "place", "name", "counts", "good", F.when(asks, F.col("said")).alias("said"), F.when(asks, F.col("stream")).otherwise("").alias("_stream"), F.when(asks, 0).otherwise(F.xxhash64("task_id")).alias("_deal"))
    labels = stream_labels(inventory).select(F.col("stream_id").alias("_stream"), F.lit(0).cast("long").alias("_deal"), "names")
    met = dealt.join(labels.hint("shuffle_merge"), ["_stream", "_deal"], "left")
    labelled = F.col("said").isNotNull() & (F.size(F.coalesce("names", none)) > 0)
    judged = met.select("task_id", "place", "name", (F.col("counts") | labelled).alias("counts"), (F.col("good") | (labelled & holds(F.col("said"), F.col("names")))).alias("good"))
    lost = F.collect_list(F.when(F.col("counts") & ~F.col("good"), F.struct("place", F.concat(F.lit("missing_answer_fact:"), F.col("name")).alias("issue"))))
    sums = judged.groupBy("task_id").agg(F.count(F.when(F.col("counts"), 1)).alias("n"), F.transform(F.array_sort(lost), lambda x: x["issue"]).alias("issues"))
    return sums.select("task_id", (F.size("issues") == 0).alias("ok"), F.when(F.col("n") == 0, 1.0).otherwise((F.col("n") - F.size("issues")) / F.col("n")).alias("score"), "issues")


def holds(text: Column, ways: Column) -> Column:
    return F.exists(ways, lambda w: (w != "") & F.contains(text, w))


def mentions(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """task_id, mentioned (array of streams): which streams (task_id, said, stream_id) a text names by id or label."""
    named = rows.distinct().join(stream_labels(inventory), "stream_id", "left")
    told = F.array_union(F.array(normalize_answer("stream_id")), F.coalesce("names", texts([])))
    return named.where(holds(F.col("said"), told)).groupBy("task_id").agg(F.collect_set("stream_id").alias("mentioned"))


def evidence_followup(tasks: DataFrame, answers: DataFrame, inventory: DataFrame) -> DataFrame:
    """task_id, ok: whether a follow-up names the streams that an answer rests on, and their basis.

    tasks: task_id, family, gold, phase_golds (maps of frozen values), streams (required ids), basis (map of frozen values: observed_timestamp, window_start, requested_timestamp, period,
    preferred_reference, equipment_label, point_label, location_label), seen (ids in the calls' outputs). All required streams are named; or in rankings the winner, two of the seen streams, or words of a ranking; or in
    comparisons the last winner, or one required stream and words of a comparison. If the basis has anything to tell, some of it is told.
    """
    text = answers.select("task_id", normalize_answer(F.coalesce("text", F.lit(""))).alias("said"))
    rows = tasks.join(text, "task_id", "left").withColumn("said", F.coalesce("said", F.lit("")))
    rank, pair = F.col("family") == "window_rank", F.col("family") == "window_pairwise_compare"
    winners = F.filter(F.transform(F.coalesce("phase_golds", F.array().cast("array<map<string,string>>")), lambda g: J.text_of(g["winning_stream_id"])), lambda w: w.isNotNull() & (w != ""))
    rows = rows.withColumn("winner", F.when(rank, J.text_of(F.col("gold")["stream_id"])).when(pair & (F.size(winners) > 0), F.element_at(winners, -1)))
    none = texts([])
    asked = rows.select("task_id", "said", F.explode(F.array_compact(F.concat(F.coalesce("streams", none), F.coalesce("seen", none), F.array("winner")))).alias("stream_id"))
    rows = rows.join(mentions(asked, inventory), "task_id", "left").withColumn("mentioned", F.coalesce("mentioned", none))
    basis = lambda f: F.nullif(F.col("basis")[f], F.lit("null"))
    said, period = F.col("said"), J.text_of(basis("period"))
    preferred = F.map_filter("basis", lambda k, _: k != "stream_id")
    told = [
        F.when(basis("observed_timestamp").isNotNull(), holds(said, said_time(basis("observed_timestamp")))), F.when(basis("window_start").isNotNull() & (F.coalesce(period, F.lit("")) != ""), holds(said, said_window(basis("window_start"), period))),
        F.when(F.coalesce(J.text_of(basis("preferred_reference")), F.lit("")) != "", holds(said, said_reference(preferred))),
        *[F.when(F.length(F.trim(J.text_of(basis(f)))) > 0, holds(said, label_ways(J.text_of(basis(f))))) for f in ("equipment_label", "point_label", "location_label")],
    ]
    hits = F.array_compact(F.array(*told))
    based = (F.size(hits) == 0) | F.array_contains(hits, True)
    named = lambda s: F.array_contains("mentioned", s)
    required = F.coalesce("streams", none)
    own = F.size(F.array_intersect(required, F.col("mentioned")))
    seen = F.size(F.array_intersect(F.array_distinct(F.coalesce("seen", none)), F.col("mentioned")))
    ranked = rank & (F.coalesce(named(F.col("winner")), F.lit(False)) | (seen >= 2) | holds(said, texts(RANKING)))
    compared = pair & (F.coalesce(named(F.col("winner")), F.lit(False)) | ((own >= 1) & holds(said, texts(COMPARISON))))
    ok = (said != "") & (F.size(required) > 0) & based & ((F.size(F.array_except(required, F.col("mentioned"))) == 0) | ranked | compared)
    return rows.select("task_id", F.coalesce(ok, F.lit(False)).alias("ok"))


def rationale_followup(tasks: DataFrame, answers: DataFrame, reference: DataFrame) -> DataFrame:
    """task_id, ok: whether a follow-up tells the decision of the gold (the last gate's, in gates of quality), nothing against it, and a reason that fits.

    tasks: task_id, family, gold, phase_families, phase_golds. reference: one row of the weekly thresholds. Who abstains for coverage or for gaps alone has to say so, or speak of quality.
    """
    text = answers.select("task_id", normalize_answer(F.coalesce("text", F.lit(""))).alias("said"))
    gates = F.filter(F.arrays_zip(F.coalesce("phase_families", texts([])).alias("f"), F.coalesce("phase_golds", F.array().cast("array<map<string,string>>")).alias("g")), lambda p: (p["f"] == "quality_gate") & p["g"].isNotNull())
    gold = F.when((F.col("family") == "quality_gate") & (F.size(gates) > 0), F.element_at(gates, -1)["g"]).otherwise(F.col("gold"))
    rows = tasks.withColumn("_gold", gold).join(text, "task_id", "left").withColumn("said", F.coalesce("said", F.lit(""))).crossJoin(F.broadcast(reference))
    g, said = F.col("_gold"), F.col("said")
    answered = F.coalesce(J.text_of(g["decision"]) == "answer", F.lit(False))
    told = F.when(answered, holds(said, texts(RATIONALE["answer"][0])) & ~holds(said, texts(RATIONALE["answer"][1]))).otherwise(holds(said, texts(RATIONALE["abstain"][0])))
    coverage = holds(said, texts(REASONS["coverage"])) | holds(said, said_number(g["observed_fraction"]))
    gap = holds(said, texts(REASONS["gap"])) | holds(said, said_number(g["gap_ratio"]))
    quality = holds(said, texts(REASONS["quality"]))
    low = F.coalesce(J.number_of(g["observed_fraction"]) < F.col("abstain_observed_fraction_below"), F.lit(False))
    high = F.coalesce(J.number_of(g["gap_ratio"]) > F.col("abstain_gap_ratio_above"), F.lit(False))
    abstains = F.coalesce(J.text_of(g["decision"]) == "abstain", F.lit(False))
    reason = F.when(abstains & low & ~high, coverage | quality).when(abstains & high & ~low, gap | quality).otherwise(coverage | gap | quality)
    return rows.select("task_id", ((said != "") & told & reason).alias("ok"))
