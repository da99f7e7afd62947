"""Capabilities as bits of one number: what tasks need, which classes of solvers can't do them, and which needs are minimal.

A task's needs are a mask with a bit for each named capability. A class of solvers has capabilities that it may not use and a largest number of them. As more capabilities never hurt, a
class can do a task exactly if it may use all of its needs and these are few enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.summaries import combinations_up_to


def bit(names: list[str], name: str) -> int:
    return 1 << names.index(name)


def mask_of(names: list[str], needs: dict[str, Column]) -> Column:
    """The mask of the capabilities whose condition holds; null conditions don't."""
    if len(names) > 63:
        raise ValueError("a mask holds up to 63 capabilities")
    total = F.lit(0).cast("long")
    for name, condition in needs.items():
        total = total.bitwiseOR(F.when(condition, F.lit(bit(names, name))).otherwise(0).cast("long"))
    return total


def names_of(names: list[str], mask: Column) -> Column:
    """The capabilities of a mask, in their order."""
    return F.filter(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, F.lit(n)) for k, n in enumerate(names)]), lambda x: x.isNotNull())


def can(needs: Column, forbidden: Column, most: Column) -> Column:
    return (needs.bitwiseAND(forbidden) == 0) & (F.bit_count(needs) <= most)


def blocking(tasks: DataFrame, classes: DataFrame) -> DataFrame:
    """task_id, blocked: the names of the solver classes that can't do a task, sorted. tasks: task_id, needs; classes: solver_class, forbidden, most (a few rows)."""
    masks = tasks.select("needs").distinct().crossJoin(F.broadcast(classes))
    blocked = masks.groupBy("needs").agg(F.array_sort(F.collect_set(F.when(~can(F.col("needs"), F.col("forbidden"), F.col("most")), F.col("solver_class")))).alias("blocked"))
    # Each need is judged once; tasks of one need only look it up, and all masks fit where their number is small.
    return tasks.select("task_id", "needs").join(blocked, "needs").select("task_id", "needs", "blocked")


def class_report(tasks: DataFrame, classes: DataFrame, n_capabilities: int) -> DataFrame:
    """solver_class, programs (sets of allowed capabilities up to the largest number), needs_met and tasks_met (distinct masks and tasks that it can do)."""
    counted = tasks.groupBy("needs").agg(F.count("*").alias("n"))
    met = counted.crossJoin(F.broadcast(classes)).where(can(F.col("needs"), F.col("forbidden"), F.col("most")))
    sums = met.groupBy("solver_class").agg(F.count("*").alias("needs_met"), F.sum("n").alias("tasks_met"))
    allowed = F.lit(n_capabilities) - F.bit_count(F.col("forbidden").bitwiseAND(F.lit((1 << n_capabilities) - 1)))
    programs = [F.lit(1).cast("long"), *(combinations_up_to(allowed, k) + 1 for k in range(1, n_capabilities + 1))]
    sized = classes.select("solver_class", F.get(F.array(*programs), F.least(F.col("most"), F.lit(n_capabilities))).alias("programs"))
    return sized.join(sums, "solver_class", "left").select("solver_class", "programs", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("needs_met", "tasks_met")])


def contained(masks: DataFrame) -> DataFrame:
    """inner, outer: every pair of different masks (column `needs`) of which one has all capabilities of the other.

    Each mask is put under the rarest of its capabilities alone and looks under all of its own, so that a pair meets once and under few others; the empty mask is in all.
    """
    distinct = masks.select("needs").distinct()
    bits = distinct.select("needs", F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.getbit("needs", k) == 1)).alias("k"))
    held = bits.groupBy("k").agg(F.count("*").alias("held"))
    rarest = bits.join(F.broadcast(held), "k").groupBy("needs").agg(F.min(F.struct("held", "k")).alias("r")).select(F.col("needs").alias("inner"), F.col("r.k").alias("k"))
    pairs = bits.select(F.col("needs").alias("outer"), "k").join(rarest, "k").where((F.col("inner") != F.col("outer")) & (F.col("inner").bitwiseAND(F.col("outer")) == F.col("inner"))).select("inner", "outer")
    empty = distinct.where("needs = 0").select(F.col("needs").alias("inner")).join(distinct.where("needs <> 0").select(F.col("needs").alias("outer")), F.lit(True))
    return pairs.unionByName(empty)


def needs_report(tasks: DataFrame, names: list[str], first: int = 8) -> DataFrame:
    """needs, capabilities, n, task_ids (the first few), minimal and maximal: the distinct needs, whether none has a part of them, and whether none has them and more."""
    inside = contained(tasks)
    has = inside.select(F.col("outer").alias("needs")).distinct().withColumn("larger", F.lit(True))
    within = inside.select(F.col("inner").alias("needs")).distinct().withColumn("smaller", F.lit(True))
    place = F.row_number().over(Window.partitionBy("needs").orderBy("task_id"))
    ids = tasks.select("needs", "task_id").withColumn("_k", place).where(F.col("_k") <= first).groupBy("needs").agg(F.array_sort(F.collect_list("task_id")).alias("task_ids"))
    counted = tasks.groupBy("needs").agg(F.count("*").alias("n")).join(ids, "needs").join(has, "needs", "left").join(within, "needs", "left")
    return counted.select("needs", names_of(names, F.col("needs")).alias("capabilities"), "n", "task_ids", F.col("larger").isNull().alias("minimal"), F.col("smaller").isNull().alias("maximal"))
