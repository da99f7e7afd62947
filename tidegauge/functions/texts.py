"""Column functions on requests in words and on JSON text: dates, phrases, label variants, ids and numbers. None of them is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import col, normalize_text

# Words for the last part of a class, short forms of equipment, month names, patterns of numbers and times in values.
CLASS_WORDS = {"Sensor": ("sensor", "reading", "measurement"), "Setpoint": ("setpoint", "setting"), "Limit": ("limit", "threshold"), "Status": ("status", "state")}
SHORT_FORMS = {"fan coil unit": "fcu", "air handler unit": "ahu", "building control unit": "bcu"}
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
NUMBER = r"(?<![A-Za-z0-9_])[-+]?\d+(?:\.\d+)?"
# What dates in words and as numbers look like, without regard to case.
MONTH = rf"\b(?:{MONTHS})\s+\d{{4}}\b"
DAY = rf"\b(?:{MONTHS})\s+\d{{1,2}},\s+\d{{4}}\b"
ISO_DAY = r"\b\d{4}-\d{2}-\d{2}\b"
TIMESTAMP = r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\+00:00|Z)?)?"


def found(x: Column | str, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(col(x), pattern, group), F.lit(""))


# ---- dates and times in words


def has_calendar_reference(text: Column | str) -> Column:
    """Whether the text names a full date, or a month and year after in or during."""
    return F.exists(F.array(*[F.lit(p) for p in (DAY, rf"\b(?:in|during)\s+{MONTH}", ISO_DAY)]), lambda p: F.rlike(col(text), F.concat(F.lit("(?i)"), p)))


def _date(x: Column, pattern: str) -> Column:
    return F.try_to_date(F.regexp_replace(x, r"\s+", " "), pattern).cast("timestamp_ntz")


def date_in(text: Column | str) -> Column:
    """The first date in words, else the first as yyyy-MM-dd; null where there is none or it isn't in the calendar."""
    words, iso = found(text, f"(?i){DAY}"), found(text, ISO_DAY)
    return F.when(words.isNotNull(), _date(words, "MMMM d, yyyy")).otherwise(_date(iso, "yyyy-MM-dd"))


def instant_in(text: Column | str) -> Column:
    """The first `H:mm[:ss[.f]] UTC on Month d, yyyy`."""
    whole = found(text, rf"(?i)\b\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?\s+UTC\s+on\s+(?:{MONTHS})\s+\d{{1,2}},\s+\d{{4}}\b")
    time = [F.regexp_extract(whole, r"^(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", g) for g in (1, 2, 3)]
    hours, minutes = (F.coalesce(t.try_cast("int"), F.lit(0)) for t in time[:2])
    return date_in(whole) + F.make_dt_interval(F.lit(0), hours, minutes, F.coalesce(time[2].try_cast("decimal(18,6)"), F.lit(0)))


def month_in(text: Column | str) -> Column:
    """The first day of the first `Month yyyy`."""
    return _date(F.concat(F.lit("1 "), found(text, f"(?i){MONTH}")), "d MMMM yyyy")


def window_in(family: Column | str, text: Column | str) -> Column:
    """struct(start, end, period) that a request of this task family asks for; null where the text has no such time."""
    f, day, none = col(family), date_in(text), F.lit(None)
    until, month = F.coalesce(instant_in(text), day), month_in(text)

    def window(start: Column, end: Column, period: str) -> Column:
        return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end"), F.lit(period).alias("period"))).otherwise(none)

    def days(n: int) -> Column:
        return F.make_dt_interval(F.lit(n))

    return (
        F.when(f == "day_mean_lookup", window(day, day + days(1), "day"))
        .when(f == "relative_24h_mean_lookup", window(until - days(1), until, "custom"))
        .when(f.isin("window_mean_lookup", "window_pairwise_compare", "quality_gate"), window(day, day + days(7), "week"))
        .when(f == "window_rank", window(month, F.add_months(month, 1).cast("timestamp_ntz"), "month"))
    )


def time_phrase(family: Column | str, start: Column, end: Column, requested: Column) -> Column:
    """The time of a task in words: a day, the 24 hours before an instant, a week, a month or an instant."""
    f, words = col(family), "MMMM d, yyyy"
    fraction = F.regexp_replace(F.date_format(requested, "SSSSSS"), "0+$", "")
    second = F.concat(F.date_format(requested, "HH:mm:ss"), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))
    return (
        F.when(f == "day_mean_lookup", F.date_format(start, words))
        .when(f == "relative_24h_mean_lookup", F.concat(F.lit("24 hours to "), F.date_format(end, "HH:mm"), F.lit(" UTC on "), F.date_format(end, words)))
        .when(f.isin("window_mean_lookup", "window_pairwise_compare"), F.concat(F.lit("week of "), F.date_format(start, words)))
        .when(f == "window_rank", F.date_format(start, "MMMM yyyy"))
        .when(f.isin("timestamp_value_lookup", "timestamp_nearest_lookup"), F.concat(second, F.lit(" UTC on "), F.date_format(requested, words)))
    )


# ---- names in words


def class_phrases(point_class: Column | str) -> Column:
    """The ways to say a class such as Room_Air_Temperature_Sensor, normalised and sorted."""
    name = col(point_class)
    last, stem = F.substring_index(name, "_", -1), found(point_class, r"^(.+)_[^_]*$", 1)
    words = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in CLASS_WORDS.items() for x in kv])
    said = F.when(stem.isNotNull(), F.transform(F.try_element_at(words, last), lambda w: F.concat(stem, F.lit(" "), w)))
    every = F.concat(F.array(name), F.coalesce(said, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(every, normalize_text))))


def label_variants(label: Column | str) -> Column:
    """A label, it with equipment in short form, and it without a first word that has an underscore; normalised and sorted."""
    t = F.lower(col(label))
    short = [F.when(F.contains(t, F.lit(k)), F.replace(t, F.lit(k), F.lit(v))) for k, v in SHORT_FORMS.items()]
    rest = found(t, r"^[^ ]*_[^ ]* (.*)$", 1)
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.array(t, *short, rest), normalize_text))))


def replaced(x: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    out = col(x)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def numbered(prefix: Column | str, family: Column | str, ordinal: Column | str) -> Column:
    """prefix_family_00042."""
    return F.concat_ws("_", col(prefix), col(family), F.lpad(col(ordinal).cast("string"), 5, "0"))


def ordinal_of(x: Column | str) -> Column:
    """The number behind the last underscore, or null."""
    return F.substring_index(col(x), "_", -1).try_cast("bigint")


# ---- JSON text and calls


def ids_in(json: Column | str, key: str = "stream_id") -> Column:
    """Text values of the key at any depth, in order of the text, without their escapes."""
    found = F.regexp_extract_all(col(json), F.lit(rf'[{{,]\s*"{key}"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1))
    return F.transform(found, lambda x: F.try_variant_get(F.try_parse_json(x), "$", "string"))


def numbers_in(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def times_in(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(TIMESTAMP), F.lit(0))


def call_key(tool: Column | str, arguments: Column | str) -> Column:
    """A call as text that doesn't depend on the order of its arguments (a map)."""
    return F.to_json(F.struct(col(tool).alias("tool"), F.array_sort(F.map_entries(col(arguments))).alias("arguments")))


def clean_json(rows: DataFrame, *fields: str, name: str = "json") -> DataFrame:
    """rows with their fields as JSON; null fields are left out, and so are numbers that aren't finite. Texts stay, whatever they read as."""
    kinds = dict(rows.dtypes)

    def clean(f: str) -> Column:
        v = F.col(f)
        return F.when(~(F.isnan(v) | (F.abs(v) == float("inf"))), v).alias(f) if kinds[f] in ("double", "float") else v

    return rows.withColumn(name, F.to_json(F.struct(*map(clean, fields))))


def time_anchor(observed: Column, requested: Column, gold_start: Column, call_start: Column, first: Column) -> Column:
    """The instant a task stands at: observed, requested, start of the answer's or the call's window, else the stream's first."""
    return F.coalesce(observed, requested, gold_start, call_start, first)
