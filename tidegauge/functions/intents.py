"""What turns of a dialogue ask for, and what issues and stages stand for: rules over words, from tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.columns import col

# What is said for each intent (every group by one of its words), categories of issues and errors (by how they begin, what they are, or what they hold), and stages.
INTENTS: dict[str, list[tuple[str, ...]]] = {
    "quality": [("would you answer or abstain", "make the same answer-or-abstain decision")],
    "timestamp": [("nearest available reading", "nearest logged reading")],
    "quality_preference": [("first and second",), ("trust more",), ("answer or abstain",)],
    "timestamp_preference": [("first and second timestamp",), ("trust more",), ("reporting",)],
    "reporting_commitment": [("report it as-is",), ("abstain",), ("more precise timestamp", "narrower time range")],
    "point_revision": [("if the operator meant ",), ("which stream should i use",)],
}
DIRECTIONS: dict[int, tuple[str, ...]] = {-1: ("previous", "back by"), 1: ("next", "forward by")}
ISSUES: list[tuple[str, str, str]] = [
    ("begins", "missing_phase_answer:", "protocol_phase_completion_missing"),
    ("is", "missing_goal_revision_answer", "protocol_goal_revision_missing"),
    ("is", "missing_evidence_followup_answer", "protocol_evidence_followup_missing"),
    ("is", "call_sequence_mismatch", "process_call_sequence_mismatch"),
    ("begins", "missing_tool:", "process_required_tool_missing"),
    ("begins", "missing_answer_fact:", "final_answer_content_missing"),
    ("begins", "missing_evidence:", "grounding_evidence_missing"),
    ("begins", "temporal_mismatch:", "temporal_contract_mismatch"),
]
ERRORS: list[tuple[str, str, str]] = [
    ("holds", "missing_revised_timestamp", "controller_parse_missing_revised_timestamp"),
    ("holds", "missing_revised_target_phrase", "controller_parse_missing_revised_target_phrase"),
    ("holds", "unsupported_revision_direction", "controller_parse_unsupported_revision_surface"),
    ("holds", "KeyError:'stream_id'", "controller_binding_missing_stream_id"),
    ("holds", "empty_rank", "controller_rank_empty_result"),
    ("holds", "missing_point_class", "controller_parse_missing_point_class"),
    ("holds", "no_point_candidate", "controller_grounding_no_point_candidate"),
]
DECISIONS = {"clarify": "natural_language_question", "act": "compact_json_tool_action", "answer": "natural_language_answer"}
#: Site ids in texts: capitals and a letter behind an underscore.
SITE = r"\b[A-Z]+_[A-Z]\b"


def says(text: Column | str, groups: list[tuple[str, ...]]) -> Column:
    """Whether the text has one of the words of every group, without regard to case; a missing text has none."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in g]) for g in groups])


def intents(text: Column | str, table: dict[str, list[tuple[str, ...]]] = INTENTS) -> Column:
    """The names of all intents that the text has, in the table's order."""
    return F.array_compact(F.array(*[F.when(says(text, groups), F.lit(name)) for name, groups in table.items()]))


def direction(text: Column | str) -> Column:
    """-1 back, 1 forward (back, where both are said), null for neither."""
    return F.coalesce(*[F.when(says(text, [words]), F.lit(d)) for d, words in DIRECTIONS.items()])


def revised_target(text: Column | str) -> Column:
    """What the operator is said to have meant instead, or null."""
    return F.nullif(F.trim(F.regexp_extract(col(text), r"(?i)if the operator meant (.+?) instead", 1)), F.lit(""))


def site_in(text: Column | str, pattern: str = SITE) -> Column:
    return F.nullif(F.regexp_extract(col(text), pattern, 0), F.lit(""))


def category(value: Column | str, table: list[tuple[str, str, str]], other: str) -> Column:
    """The category of the first rule that the value meets, else `other`."""
    v = col(value)
    met = {"begins": F.startswith, "holds": F.contains, "is": lambda a, b: a == b}
    return F.coalesce(*[F.when(met[how](v, F.lit(text)), F.lit(name)) for how, text, name in table], F.lit(other))


def issue_category(issue: Column | str) -> Column:
    return category(issue, ISSUES, "other")


def error_category(error: Column | str) -> Column:
    return F.when(F.coalesce(col(error), F.lit("")) == "", "none").otherwise(category(error, ERRORS, "controller_other_error"))


def response_format(stage: Column | str, decisions: dict[str, str]) -> Column:
    """The format of what a stage answers with; decisions: stage to clarify, act or answer. Null for a stage that isn't in it."""
    kinds = F.create_map(*[F.lit(x) for kv in decisions.items() for x in kv])
    formats = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    return F.try_element_at(formats, F.try_element_at(kinds, col(stage)))
