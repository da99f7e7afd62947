"""Decision rules as columns: quality, preference, trend, timestamps, reporting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.columns import col


def answer(action: str, reason: str | Column) -> Column:
    return F.struct(F.lit(action).alias("action"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def quality_decision(observed: str = "observed_fraction", gap: str = "gap_ratio") -> Column:
    """struct(action, reason) by the threshold columns; what is neither bad nor good is marginal and abstains."""
    o, g = col(observed), col(gap)
    healthy = (o >= F.col("answer_observed_fraction_at_least")) & (F.col("answer_gap_ratio_at_most").isNull() | g.isNull() | (g <= F.col("answer_gap_ratio_at_most")))
    return (
        F.when(o < F.col("abstain_observed_fraction_below"), answer("abstain", "low_coverage"))
        .when(g > F.col("abstain_gap_ratio_above"), answer("abstain", "long_gap"))
        .when(healthy, answer("answer", "healthy"))
        .otherwise(answer("abstain", "marginal_quality"))
    )


def preference_rank(action: Column, reason: Column, observed: Column, gap: Column) -> Column:
    """A struct that orders candidates: decision, coverage of 0.95, coverage to two digits, smaller gap, coverage, health. Coverage 0 counts as unknown."""
    o = F.when(observed.isNull() | (observed == 0), F.lit(-1.0)).otherwise(observed)
    return F.struct((action == "answer").cast("int"), (o >= 0.95).cast("int"), F.bround(o, 2), F.coalesce(-gap, F.lit(float("-inf"))), o, (reason == "healthy").cast("int"))


def preferred(first: Column, second: Column) -> Column:
    """first unless second ranks strictly higher."""
    return F.when(first >= second, "first").otherwise("second")


def timestamp_rank(exact: Column, offset: Column) -> Column:
    return F.struct(F.coalesce(exact, F.lit(False)).cast("int"), -F.coalesce(offset, F.lit(0.0)))


def quality_trend(first_action: Column, second_action: Column, first_obs: Column, second_obs: Column, first_gap: Column, second_gap: Column) -> Column:
    """improved, worsened or stable; which metrics are there and a change of decision come before the changes of coverage and gap."""
    has_first, has_second = first_obs.isNotNull() & first_gap.isNotNull(), second_obs.isNotNull() & second_gap.isNotNull()
    zero = F.lit(0.0)
    obs, gap = F.coalesce(second_obs, zero) - F.coalesce(first_obs, zero), F.coalesce(first_gap, zero) - F.coalesce(second_gap, zero)
    # The changes of coverage and gap that count.
    up = ((obs >= 0.02) & (gap >= -1.0)) | ((gap >= 0.5) & (obs >= -0.05))
    down = ((obs <= -0.02) & (gap <= 1.0)) | ((gap <= -0.5) & (obs <= 0.05))
    return (
        F.when(has_first & ~has_second, "quality_worsened")
        .when(has_second & ~has_first, "quality_improved")
        .when((first_action == "abstain") & (second_action == "answer"), "quality_improved")
        .when((first_action == "answer") & (second_action == "abstain"), "quality_worsened")
        .when(up, "quality_improved")
        .when(down, "quality_worsened")
        .otherwise("quality_stable")
    )


def rank_stability(first: Column, second: Column) -> Column:
    return F.when(F.coalesce(first, F.lit("")) == F.coalesce(second, F.lit("")), "same_winner").otherwise("winner_changed")


def timestamp_commitment(exact: Column, offset: Column, within: float) -> Column:
    """Answer an exact instant or one at most `within` seconds off; else ask again."""
    return F.when(exact, answer("answer", "exact_timestamp")).when(offset <= within, answer("answer", "nearest_but_acceptable")).otherwise(answer("re_clarify", "timestamp_too_imprecise"))


def quality_commitment(action: Column, reason: Column) -> Column:
    return (
        F.when((action == "answer") & (reason == "healthy"), answer("answer", "healthy_quality"))
        .when((action == "abstain") & (F.coalesce(reason, F.lit("")) != ""), answer("abstain", reason))
        .otherwise(answer("re_clarify", "marginal_quality"))
    )


def combined_commitment(action: Column, reason: Column, has_timestamp: Column, exact: Column, offset: Column, within: float = 120.0) -> Column:
    """Abstaining for quality comes first, then the timestamp, then quality alone. A null action means that there was no quality phase."""
    return F.when((action == "abstain") & (F.coalesce(reason, F.lit("")) != ""), answer("abstain", reason)).when(has_timestamp, timestamp_commitment(exact, offset, within)).otherwise(quality_commitment(action, reason))


def strict_commitment(action: Column, reason: Column, has_timestamp: Column, exact: Column, offset: Column, within: float = 30.0) -> Column:
    """As combined, but quality that isn't healthy asks again before any timestamp counts."""
    unhealthy = action.isNotNull() & ~((action == "answer") & (F.coalesce(reason, F.lit("")) == "healthy"))
    return (
        F.when((action == "abstain") & (F.coalesce(reason, F.lit("")) != ""), answer("abstain", reason))
        .when(unhealthy, answer("re_clarify", "marginal_quality"))
        .when(has_timestamp, timestamp_commitment(exact, offset, within))
        .otherwise(answer("re_clarify", "marginal_quality"))
    )


def resolution_status(exact: Column, offset: Column, within: float = 30.0) -> Column:
    return F.when(exact, "exact").when(offset <= within, "unique_nearest").otherwise("ambiguous_nearest")


def reportability(status: Column, action: Column, reason: Column) -> Column:
    bad = F.when(reason.isin("low_coverage", "long_gap"), reason).otherwise(F.lit("marginal_quality"))
    return (
        F.when(action == "abstain", answer("abstain", bad))
        .when(action.isNotNull() & ~((action == "answer") & (F.coalesce(reason, F.lit("")) == "healthy")), answer("abstain", "marginal_quality"))
        .when(status == "exact", answer("answer", "exact_timestamp"))
        .when(status == "unique_nearest", answer("answer", "nearest_but_acceptable"))
        .otherwise(answer("re_clarify", "timestamp_too_imprecise"))
    )


def prompted_commitment(action: Column, reason: Column, exact: Column, offset: Column, prompt: Column, within: float = 30.0) -> Column:
    """Abstain for quality; ask again for a far instant only where the prompt speaks of a more precise timestamp; else answer."""
    far = ~F.coalesce(exact, F.lit(False)) & F.coalesce(offset > within, F.lit(False)) & F.coalesce(F.contains(prompt, F.lit("more precise timestamp")), F.lit(False))
    good = F.when(F.coalesce(exact, F.lit(False)), "exact_timestamp").otherwise("nearest_but_acceptable")
    return F.when(action == "abstain", answer("abstain", F.coalesce(F.nullif(reason, F.lit("")), F.lit("marginal_quality")))).when(far, answer("re_clarify", "timestamp_too_imprecise")).otherwise(answer("answer", good))
