"""Summaries of tasks, phases, calls and scores: groups, last of a kind, phrases found in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import normalize_text


def only(rows: DataFrame, **wanted: list[str] | None) -> DataFrame:
    """Rows whose columns have one of the wanted values; None asks nothing."""
    for name, values in wanted.items():
        rows = rows if values is None else rows.where(F.col(name).isin(values))
    return rows


def constant_groups(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of groups with one distinct value; nulls don't count. Least and greatest merge before the shuffle, distinct values wouldn't."""
    both = rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_max"))
    return both.where(F.col(value) == F.col("_max")).drop("_max")


def mean_scores(rows: DataFrame, keys: list[str], fields: list[str], digits: int = 4) -> DataFrame:
    """Mean of each score, and rows, by group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(f), digits).alias(f"mean_{f}") for f in fields])


def counts_if(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """How many rows of a group meet each condition, and whether all do."""
    counts = [F.count_if(c).alias(f"n_{name}") for name, c in conditions.items()]
    return rows.groupBy(*keys).agg(*counts, *[F.bool_and(F.coalesce(c, F.lit(False))).alias(f"all_{name}") for name, c in conditions.items()])


def usage(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Sums by group; null is 0."""
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f"total_{f}") for f in fields])


def requirement_groups(rows: DataFrame, signature: str, key: str, first: int = 8) -> DataFrame:
    """signature, n, keys: the count of each signature and its first keys in order. Only `first` rows of a partition's signature leave it."""
    place = F.row_number().over(Window.partitionBy(signature).orderBy(key))
    kept = rows.select(signature, key).withColumn("_k", place).where(F.col("_k") <= first)
    lists = kept.groupBy(signature).agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return rows.groupBy(signature).agg(F.count("*").alias("n")).join(lists, signature)


def last_two(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """key, first, second: the fields of the last two rows of each key, oldest first; keys with one row have none."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    kept = rows.withColumn("_k", place).where("_k <= 2")
    struct = F.struct(*fields)
    out = kept.groupBy(key).agg(F.max(F.when(F.col("_k") == 2, struct)).alias("first"), F.max(F.when(F.col("_k") == 1, struct)).alias("second"), F.count("*").alias("_n"))
    return out.where("_n = 2").drop("_n")


def latest_of(rows: DataFrame, key: str, kind: str, order: str, fields: list[str]) -> DataFrame:
    """The fields of the last row of each key and kind."""
    return rows.groupBy(key, kind).agg(F.max_by(F.struct(*fields), order).alias("_last")).select(key, kind, "_last.*")


def first_of_each(rows: DataFrame, key: str, what: str, order: str) -> DataFrame:
    """Distinct values of each key in order of their first place, as (key, values)."""
    first = rows.groupBy(key, what).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", what))), lambda x: x[what]).alias("values"))


def phrase_hits(texts: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, value, phrase) of every phrase that stands in the text between word borders.

    phrases: (phrase, value), normalised, of any length. Runs of as many words as some phrase has meet phrases by equality, so that no text is compared with every phrase.
    """
    lengths = phrases.agg(F.collect_set(F.size(F.split("phrase", " "))).alias("_lengths"))
    split = texts.select(key, F.split(normalize_text(text), " ").alias("_w")).crossJoin(F.broadcast(lengths))
    # Starts of a run of n words; a text with fewer has none.
    starts = lambda n: F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1)).otherwise(F.array().cast("array<int>"))
    runs = split.select(key, F.explode(F.flatten(F.transform("_lengths", lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice("_w", i, n), " "))))).alias("phrase"))
    return runs.join(phrases, "phrase").select(key, "value", "phrase").distinct()


def longest_hit(hits: DataFrame, key: str) -> DataFrame:
    """The value of each key's longest phrase; among equals the least value."""
    ranked = hits.groupBy(key).agg(F.min(F.struct((-F.length("phrase")).alias("_l"), "value", "phrase")).alias("_b"))
    return ranked.select(key, "_b.value", "_b.phrase")


def covers(required: Column, given: Column) -> Column:
    """Whether everything required is given."""
    return F.size(F.array_except(required, given)) == 0


def combinations_up_to(n: Column, k: int) -> Column:
    """How many subsets of 1 to k of n things there are (up to 2^63)."""
    n = n.cast("bigint")
    zero = F.struct(F.lit(1).cast("bigint").alias("term"), F.lit(0).cast("bigint").alias("total"))

    def add(acc: Column, i: Column) -> Column:
        product = acc["term"] * (n - i + 1)
        term = ((product - product % i) / i).cast("bigint")
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint")), zero, add, lambda a: a["total"])


def standardized(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fields less their mean, over their sample deviation; a deviation under 1e-6 (or of one row) counts as 1."""
    stats = rows.agg(*[x for f in fields for x in (F.avg(f).alias(f"_m_{f}"), F.stddev_samp(f).alias(f"_s_{f}"))])
    scaled = {f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") >= 1e-6, F.col(f"_s_{f}")).otherwise(1.0) for f in fields}
    return rows.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*stats.columns)


def other_member(members: DataFrame, group: list[str], key: str) -> DataFrame:
    """For each member the least other one of its group, as `alternate`; null where it is alone. Only a group's two least meet its members."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(key))
    least = members.select(*group, key).withColumn("_k", place).where("_k <= 2").groupBy(*group)
    two = least.agg(F.min(key).alias("_a"), F.max(F.when(F.col("_k") == 2, F.col(key))).alias("_b"))
    return members.join(two, group).withColumn("alternate", F.when(F.col(key) == F.col("_a"), F.col("_b")).otherwise(F.col("_a"))).drop("_a", "_b")


def earlier_or_later(rows: DataFrame, key: str, text: str, order: str, value: str) -> DataFrame:
    """Of each key's rows the value of the last where its text says `later of the two`, of the first where it says `earlier of the two`, else null."""
    t = F.lower(F.max(text))
    return rows.groupBy(key).agg(F.when(F.contains(t, F.lit("later of the two")), F.max_by(value, order)).when(F.contains(t, F.lit("earlier of the two")), F.min_by(value, order)).alias(value))


def with_backing(episodes: DataFrame, static: DataFrame, key: str, backing: str) -> DataFrame:
    """Episodes with the columns of the static row they rest on: the backing id, else their own."""
    s = static.select(F.col(key).alias("_backing"), *[F.col(c).alias(f"static_{c}") for c in static.columns if c != key])
    return episodes.withColumn("_backing", F.coalesce(backing, key)).join(s, "_backing", "left").drop("_backing")
