"""Column functions: text normalisers, time buckets, numbers, hash choices. None of them is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a stream id looks like in names.
UUID = r"[0-9a-fA-F]{8}[-_][0-9a-fA-F]{4}[-_][0-9a-fA-F]{4}[-_][0-9a-fA-F]{4}[-_][0-9a-fA-F]{12}"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- missing values and text


def nullable_text(x: Column | str) -> Column:
    """Trimmed text; blank, nan and none are null."""
    t = F.trim(col(x))
    return F.when(F.lower(t).isin("", "nan", "none"), None).otherwise(t)


def best_label(*xs: Column | str) -> Column:
    """The first that is not blank."""
    return F.coalesce(*map(nullable_text, xs))


def normalize_text(x: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits as one space; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(nullable_text(x)), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def normalize_answer(x: Column | str) -> Column:
    """Lower case, white space as one space."""
    return F.trim(F.lower(F.regexp_replace(col(x), r"\s+", " ")))


def normalize_ascii(x: Column | str) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", " "))


def only_alnum(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "")


def normalize_label(x: Column | str, site: Column | str) -> Column:
    """A label without its site in front, without quotes and backticks, in lower case, with single spaces."""
    t = F.lower(F.trim(F.regexp_replace(col(x), "['\"`]", "")))
    s = F.concat(F.lower(col(site)), F.lit(" "))
    return F.trim(F.regexp_replace(F.when(F.startswith(t, s), F.substr(t, F.length(s) + 1)).otherwise(t), r"\s+", " "))


#: A word of a name in camel or any other case: capitals with what follows them, or small letters and digits.
WORD = "[A-Z]+[a-z0-9]*|[a-z0-9]+"


def snake_case(x: Column | str) -> Column:
    """The words of a name in lower case with underscores between them."""
    return F.lower(F.array_join(F.regexp_extract_all(col(x), F.lit(WORD), F.lit(0)), "_"))


def normalize_stream_id(x: Column | str) -> Column:
    """The first UUID in the text, with underscores and in lower case; null where there is none."""
    return F.nullif(F.lower(F.translate(F.regexp_extract(col(x), UUID, 0), "-", "_")), F.lit(""))


def archive_stream_id(x: Column | str) -> Column:
    """The stream id of an archive member's name: its UUID, else the name without folder, site prefix and .pickle."""
    name = F.regexp_replace(F.substring_index(col(x), "/", -1), r"\.(pickle|pkl)$", "")
    return F.coalesce(normalize_stream_id(name), F.lower(F.regexp_replace(name, "^(?i)site_[a-z]_", "")))


def local_name(x: Column | str) -> Column:
    """What follows the # of an IRI, else its last /."""
    return F.when(F.contains(col(x), F.lit("#")), F.substring_index(col(x), "#", -1)).otherwise(F.substring_index(col(x), "/", -1))


def title_case(x: Column | str) -> Column:
    t = F.regexp_replace(F.regexp_replace(col(x), "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")
    return F.initcap(F.trim(t))


def site_of_file(name: Column | str) -> Column:
    return F.upper(F.nullif(F.regexp_extract(col(name), "(?i)site[_-]?([a-z])", 1), F.lit("")))


def candidate_key(*xs: Column | str) -> Column:
    """Normalised fields joined by a pipe; unlike concat_ws a null field stays as an empty place."""
    parts: list[Column] = []
    for x in xs:
        parts += [F.lit("|")] if parts else []
        parts.append(F.coalesce(normalize_text(x), F.lit("")))
    return F.concat(*parts)


def choose_primary(types: Column | str, generic: tuple[str, ...]) -> Column:
    """The least type that is not generic, else the least."""
    t = col(types)
    return F.coalesce(F.array_min(F.filter(t, lambda x: ~x.isin(*generic))), F.array_min(t))


# ---- time


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col(a), col(b)) / F.lit(1e6)


def _ntz(date: Column) -> Column:
    return date.cast("timestamp_ntz")


def day_of(ts: Column | str) -> Column:
    return _ntz(F.to_date(col(ts)))


def week_tue(ts: Column | str) -> Column:
    """Weeks of the stored aggregates: they start on Tuesday."""
    return _ntz(F.date_add(F.trunc(F.date_sub(F.to_date(col(ts)), 1), "week"), 1))


def week_mon(ts: Column | str) -> Column:
    """Weeks of episodes: they start on Monday."""
    return _ntz(F.trunc(F.to_date(col(ts)), "week"))


def month_of(ts: Column | str) -> Column:
    return _ntz(F.trunc(F.to_date(col(ts)), "month"))


def hour_of(ts: Column | str) -> Column:
    return day_of(ts) + F.make_dt_interval(F.lit(0), F.hour(col(ts)))


def minute_of(ts: Column | str) -> Column:
    return hour_of(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.minute(col(ts)))


#: Bucket and the days by which a last window ends after its start.
PERIODS = {"day": (day_of, 1), "week": (week_tue, 7), "month": (month_of, 31)}


def infer_period(start: Column | str, end: Column | str) -> Column:
    days = seconds_between(start, end) / 86400
    return F.when(F.abs(days - 1) < 0.01, "day").when(F.abs(days - 7) < 0.01, "week").otherwise("month")


def shifted(ts: Column | str, start: Column | str, end: Column | str, windows: int | Column) -> Column:
    """ts moved by so many lengths of the window from start to end."""
    micros, day = F.timestamp_diff("MICROSECOND", col(start), col(end)) * windows, F.lit(86_400_000_000)
    seconds = ((micros % day).cast("decimal(12,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return col(ts) + F.make_dt_interval(((micros - micros % day) / day).cast("int"), F.lit(0), F.lit(0), seconds)


def iso_text(ts: Column | str) -> Column:
    """ISO 8601; microseconds only where there are any."""
    t = col(ts)
    plain = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(t, "SSSSSS")
    return F.when(micros == "000000", plain).otherwise(F.concat(plain, F.lit("."), micros))


def instant(x: Column | str) -> Column:
    """The instant that a text names, in any format that Spark parses; without a zone it is in UTC, whatever the session's. Null for rubbish."""
    t = F.trim(col(x))
    day = F.concat(t, F.lit("T00:00:00Z"))
    minutes = t.rlike(r"[T ]\d\d?:\d\d?$")
    return F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d\d?-\d\d?$"), day).when(minutes, F.concat(t, F.lit(":00Z"))).when(t.rlike(r"(?i)\d(z|utc|[+-]\d\d(:?\d\d)?)$") & t.rlike("[T ]"), t).otherwise(F.concat(t, F.lit("Z"))))


def same_instant(a: Column | str, b: Column | str) -> Column:
    """Whether two texts name one instant; null and rubbish are never equal."""
    return F.coalesce(instant(a) == instant(b), F.lit(False))


# ---- numbers


def is_finite(x: Column | str) -> Column:
    v = col(x)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def within(a: Column | str, b: Column | str, tolerance: float) -> Column:
    return F.coalesce(F.abs(col(a).try_cast("double") - col(b).try_cast("double")) <= tolerance, F.lit(False))


def exact_mean(x: Column | str, count: Column | None = None) -> Column:
    """The mean. Where all values have at most six decimals and are under 1e14, from their exact sum, so that it doesn't depend on how rows are dealt to tasks; else from the sum of doubles."""
    v = col(x).cast("double")
    d = v.try_cast("decimal(20,6)")
    n = F.count(v) if count is None else count
    return F.when(F.bool_and(v.isNull() | F.coalesce(d.cast("double") == v, F.lit(False))), F.sum(d).cast("double") / n).otherwise(F.sum(v) / n)


def rounded(x: Column, digits: int | None) -> Column:
    """x to so many digits, or as it is."""
    return x if digits is None else F.round(x, digits)


def fixed(x: Column | str, digits: int) -> Column:
    """A number as text with so many decimals, rounded by its exact binary value and halves to even; of 1e11 or more as the JVM writes it.

    The product with the power of ten and its rounding error, from halves of the factors' bits, together are exact.
    """
    v, scale = F.abs(col(x).cast("double")), float(10**digits)
    product, wide = v * scale, v * 134217729.0
    high = wide - (wide - v)
    error = high * scale - product + (v - high) * scale
    whole = F.floor(product)
    over = (product - whole.cast("double") - 0.5) + error
    units = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    power = F.lit(10**digits).cast("long")
    text = F.concat(F.when(col(x) < 0, "-").otherwise(""), ((units - units % power) / power).cast("long").cast("string"), F.lit("." if digits else ""), F.lpad((units % power).cast("string"), digits, "0"))
    return F.when(v < 1e11, text).otherwise(F.format_string(f"%.{digits}f", col(x).cast("double")))


def with_fixed(rows: DataFrame, name: str, x: Column | str, digits: int) -> DataFrame:
    """rows with fixed(x, digits) as `name`, for tables of many rows: each step is a column of its own, which the next ones read, where one column would have it written out in all their places."""
    scale, power = float(10**digits), F.lit(10**digits).cast("long")
    v, product, whole, units = (F.col(f"_{c}") for c in ("v", "product", "whole", "units"))
    steps = rows.withColumn("_x", col(x).cast("double")).withColumn("_v", F.when(F.abs("_x") < 1e11, F.abs("_x")))
    steps = steps.withColumns({"_product": v * scale, "_wide": v * 134217729.0}).withColumn("_high", F.col("_wide") - (F.col("_wide") - v))
    steps = steps.withColumns({"_whole": F.floor(product), "_error": F.col("_high") * scale - product + (v - F.col("_high")) * scale})
    steps = steps.withColumn("_over", (product - whole.cast("double") - 0.5) + F.col("_error"))
    steps = steps.withColumn("_units", whole + F.when((F.col("_over") > 0) | ((F.col("_over") == 0) & (whole % 2 == 1)), 1).otherwise(0))
    text = F.concat(F.when(F.col("_x") < 0, "-").otherwise(""), ((units - units % power) / power).cast("long").cast("string"), F.lit("." if digits else ""), F.lpad((units % power).cast("string"), digits, "0"))
    out = F.when(v.isNotNull(), text).otherwise(F.format_string(f"%.{digits}f", F.col("_x")))
    return steps.withColumn(name, out).select(*[c for c in rows.columns if c != name], name)


def number_variants(x: Column | str) -> Column:
    """A number as text with four to one decimals, and with the zeros at its end cut."""
    v = col(x)
    texts = [fixed(v, n) for n in (4, 3, 2, 1)]
    return F.array_distinct(F.array(*texts, F.regexp_replace(texts[0], r"\.?0+$", "")))


def timestamp_variants(ts: Column | str) -> Column:
    t = col(ts)
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "MMMM d, yyyy HH:mm", "MMM d, yyyy HH:mm", "d MMMM yyyy HH:mm", "MMMM d, yyyy 'at' HH:mm", "yyyy-MM-dd"]
    return F.array(*[F.date_format(t, f) for f in formats])


# ---- choices and identities


def stable_choice(seed: Column | str, n: int | Column) -> Column:
    """0 to n-1 from the first 8 hexadecimal digits of the MD5."""
    return F.conv(F.substr(F.md5(col(seed)), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % n


def short_id(prefix: str, x: Column | str, digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substr(F.sha1(col(x)), F.lit(1), F.lit(digits)))


def identity(*fields: str) -> Column:
    """SHA-256 of the fields as JSON, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)
