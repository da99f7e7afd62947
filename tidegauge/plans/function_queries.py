"""Queries of the column functions on names, texts, instants and turns; their SQL follows the rules step by step, not the functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import columns as K
from tidegauge.functions import decisions as D
from tidegauge.functions import intents as I
from tidegauge.plans import views as V
from tidegauge.plans.registry import query

_ID = "substr(md5(s_name), 1, 8) || '-' || substr(md5(s_name), 9, 4) || '-' || substr(md5(s_name), 13, 4) || '-' || substr(md5(s_name), 17, 4) || '-' || substr(md5(s_name), 21, 12)"
_TITLE = "array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(
    "names_of_streams",
    f"""SELECT s_suppkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '[^0-9A-Za-z]+', '_', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_+', '_', 'g'), '_')) AS snake, replace(lower(id), '-', '_') AS stream_id,
      CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, '#', '-') ELSE 'y' END AS local, {_TITLE.format("'roomAir_temp-' || s_name")} AS title, CASE WHEN s_suppkey % 3 < 2 THEN chr((65 + s_suppkey % 3)::INT) END AS site,
      CASE WHEN s_suppkey % 4 < 2 THEN NULL ELSE s_name END AS nullable, CASE WHEN s_suppkey % 4 < 2 THEN 'other' ELSE s_name END AS best, CASE WHEN s_suppkey % 2 = 0 THEN replace(lower(id), '-', '_') ELSE lower(s_name) END AS archived
    FROM (SELECT *, ' unitName ' || s_name || '-HVACPoint' AS name, {_ID} AS id FROM supplier)""",
)
def names_of_streams(spark, d):
    """Names in camel case, ids in names, local names, titles, sites in file names, blank labels and members of archives."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    digest = F.md5(name)
    cut = [F.substr(digest, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    ident = F.concat_ws("-", *cut)
    blank = F.when(k % 4 == 0, " NaN ").when(k % 4 == 1, "  ").otherwise(name)
    return V.table(spark, d, "supplier").select(
        "s_suppkey", K.snake_case(F.concat(F.lit(" unitName "), name, F.lit("-HVACPoint"))).alias("snake"), K.normalize_stream_id(F.concat(F.lit("Site_A_"), F.upper(ident), F.lit(".csv"))).alias("stream_id"),
        F.when(k % 2 == 0, K.local_name(F.concat(F.lit("http://a/b/"), F.regexp_replace(name, "#", "-")))).otherwise(K.local_name(F.lit("http://a/x#y"))).alias("local"),
        K.title_case(F.concat(F.lit("roomAir_temp-"), name)).alias("title"), K.site_of_file(F.when(k % 3 == 0, "Site_a_metadata.csv").when(k % 3 == 1, "x-SITE-B.csv").otherwise("other.csv")).alias("site"),
        K.nullable_text(blank).alias("nullable"), K.best_label(blank, F.lit("other")).alias("best"),
        K.archive_stream_id(F.when(k % 2 == 0, F.concat(F.lit("data/Site_B_"), ident, F.lit(".pickle"))).otherwise(F.concat(F.lit("data/Site_B_"), name, F.lit(".pkl")))).alias("archived"),
    )


@query(
    "texts_normalised",
    """SELECT o_orderkey, lower(o_orderpriority) || ' and ' || o_orderstatus AS answer, trim(regexp_replace(lower(o_orderpriority || '  É/' || o_orderstatus), '[^a-z0-9]+', ' ', 'g')) AS ascii, contains(regexp_replace(lower('The 1_URGENT or 2.HIGH'), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g')) AS held
    FROM (SELECT * REPLACE (lower(o_orderstatus) AS o_orderstatus) FROM orders)""",
)
def texts_normalised(spark, d):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return V.table(spark, d, "orders").select(
        "o_orderkey", K.normalize_answer(F.concat(F.lit(" "), p, F.lit("\n AND\t"), s, F.lit(" "))).alias("answer"), K.normalize_ascii(F.concat(p, F.lit("  É/"), s)).alias("ascii"), F.contains(K.only_alnum(F.lit("The 1_URGENT or 2.HIGH")), K.only_alnum(p)).alias("held"),
    )


@query(
    "instants_in_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END AS iso, date_trunc('minute', ts) AS minute, TRUE AS same, event_id % 2 = 0 AS shifted_same, FALSE AS rubbish_same,
      strftime(ts, '%Y-%m-%d %H:%M') AS told FROM events""",
)
def instants_in_text(spark, d):
    """Instants as text and back: with and without a zone, in another zone, and what is no time."""
    iso = K.iso_text("ts")
    shifted = F.concat(K.iso_text(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(1))), F.when(F.col("event_id") % 2 == 0, "+01:00").otherwise("Z"))
    return V.table(spark, d, "events").select(
        "event_id", iso.alias("iso"), K.minute_of("ts").alias("minute"), K.same_instant(iso, F.concat(F.replace(iso, F.lit("T"), F.lit(" ")), F.lit("Z"))).alias("same"), K.same_instant(iso, shifted).alias("shifted_same"),
        K.same_instant(F.lit("soon"), F.lit("soon")).alias("rubbish_same"), F.get(K.timestamp_variants("ts"), F.lit(2)).alias("told"),
    )


TURNS = ["Go to the PREVIOUS week. Would you answer or abstain?", "forward by one; use the nearest logged reading", "Report it as-is, wait for a narrower time range, or abstain?", "If the operator meant Fan {} instead, which stream should I use at SITE_C?", "Of the first and second, which would you trust more? Answer or abstain."]


@query(
    "intents_of_turns",
    """SELECT o_orderkey, ['quality', 'timestamp', 'reporting_commitment', 'point_revision', 'quality_preference'][k + 1] AS intents, [-1, 1, NULL, NULL, NULL][k + 1] AS direction, CASE WHEN k = 3 THEN 'Fan ' || o_orderstatus END AS target, CASE WHEN k = 3 THEN 'SITE_C' END AS site,
      ['process_call_sequence_mismatch', 'grounding_evidence_missing', 'other', 'temporal_contract_mismatch', 'protocol_phase_completion_missing'][k + 1] AS issue, ['none', 'controller_rank_empty_result', 'controller_other_error', 'none', 'controller_binding_missing_stream_id'][k + 1] AS error,
      ['natural_language_question', 'compact_json_tool_action', 'natural_language_answer', NULL, 'natural_language_answer'][k + 1] AS format FROM (SELECT *, o_orderkey % 5 AS k FROM orders)""",
)
def intents_of_turns(spark, d):
    k = (F.col("o_orderkey") % 5).cast("int")
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), k)
    text = F.replace(pick(*TURNS), F.lit("{}"), F.col("o_orderstatus"))
    issue = pick("call_sequence_mismatch", "missing_evidence:x", "unheard", "temporal_mismatch:a:b", "missing_phase_answer:2")
    error = pick("", "tool: empty_rank", "boom", None, "KeyError:'stream_id'")
    stage = pick("ask", "call", "final", "unknown", "rationale")
    decisions = {"ask": "clarify", "call": "act", "final": "answer", "rationale": "answer"}
    return V.table(spark, d, "orders").select(
        "o_orderkey", F.array_join(I.intents(text), ",").alias("intents"), I.direction(text).alias("direction"), I.revised_target(text).alias("target"), I.site_in(text).alias("site"), I.issue_category(issue).alias("issue"), I.error_category(error).alias("error"), I.response_format(stage, decisions).alias("format"),
    )


@query(
    "timestamp_preference",
    """SELECT event_id, CASE WHEN e1 <> e2 THEN CASE WHEN e1 THEN 'first' ELSE 'second' END WHEN o1 <= o2 THEN 'first' ELSE 'second' END AS preferred
    FROM (SELECT event_id, event_id % 3 = 0 AS e1, event_id % 4 = 0 AS e2, event_id % 5 AS o1, user_id % 5 AS o2 FROM events)""",
)
def timestamp_preference(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    first, second = D.timestamp_rank(e % 3 == 0, (e % 5).cast("double")), D.timestamp_rank(e % 4 == 0, (u % 5).cast("double"))
    return V.table(spark, d, "events").select("event_id", D.preferred(first, second).alias("preferred"))
