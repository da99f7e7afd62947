"""The entity graph: aliases, bindings of points to equipment and locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.columns import choose_primary

POINT_OF, HAS_POINT = ("isPointOf",), ("hasPoint",)
LOCATED = ("hasLocation", "isLocatedIn", "locatedIn")
GENERIC = ("Entity", "Point", "Class", "NamedIndividual")


def entity_aliases(entities: DataFrame) -> DataFrame:
    """primary_type, type_rank and entity_alias (type and number) of each entity; entities without a type are numbered as Entity, after the others."""
    typed = entities.withColumn("raw_type", choose_primary("types", GENERIC))
    named = F.coalesce("raw_type", F.lit("Entity"))
    rank = F.row_number().over(Window.partitionBy(named).orderBy(F.col("raw_type").asc_nulls_last(), "entity_id"))
    out = typed.select("entity_id", "entity_label", named.alias("primary_type"), rank.cast("bigint").alias("type_rank"))
    return out.withColumn("entity_alias", F.concat_ws("_", "primary_type", F.col("type_rank").cast("string")))


def _least_target(relations: DataFrame, predicates: tuple[str, ...], source: str, target: str, name: str) -> DataFrame:
    return relations.where(F.col("predicate").isin(*predicates)).groupBy(F.col(source).alias("node")).agg(F.min(target).alias(name))


def stream_targets(points: DataFrame, relations: DataFrame) -> DataFrame:
    """point, equipment and location of each point (point_entity).

    Equipment is what the point is part of, else what lists it as its point; the location is the point's own, else that of its equipment: two hops. Of several
    the least counts.
    """
    direct = _least_target(relations, POINT_OF, "source_entity", "target_entity", "direct")
    listed = _least_target(relations, HAS_POINT, "target_entity", "source_entity", "listed")
    places = _least_target(relations, LOCATED, "source_entity", "target_entity", "place")
    out = points.join(direct, F.col("point_entity") == direct.node, "left").drop("node").join(listed, F.col("point_entity") == listed.node, "left").drop("node")
    out = out.withColumn("equipment_entity", F.coalesce("direct", "listed")).drop("direct", "listed")
    own, inherited = places.withColumnRenamed("place", "own"), places.withColumnRenamed("place", "inherited")
    out = out.join(own, F.col("point_entity") == own.node, "left").drop("node").join(inherited, F.col("equipment_entity") == inherited.node, "left").drop("node")
    return out.withColumn("location_entity", F.coalesce("own", "inherited")).drop("own", "inherited")


def with_aliases(targets: DataFrame, aliases: DataFrame) -> DataFrame:
    """The three entities of each row with their aliases: one dimension in three roles."""
    out = targets
    for role in ("point", "equipment", "location"):
        side = aliases.select(F.col("entity_id").alias(f"{role}_entity"), F.col("entity_alias").alias(f"{role}_alias"))
        out = out.join(side, f"{role}_entity", "left")
    return out


def streams_of_subjects(triples: DataFrame, predicate: str) -> DataFrame:
    """stream_id and its entity; of several subjects the last in order counts."""
    return triples.where(F.col("p") == predicate).groupBy(F.col("o").alias("stream_id")).agg(F.max("s").alias("point_entity"))


def graph_tables(triples: DataFrame, type_predicate: str = "rdf:type", label_predicate: str = "rdfs:label") -> tuple[DataFrame, DataFrame]:
    """(entities with types and label, relations between entities) from triples (s, p, o, is_literal)."""
    types = triples.where(F.col("p") == type_predicate).groupBy(F.col("s").alias("entity_id")).agg(F.array_sort(F.collect_set("o")).alias("types"))
    labels = triples.where(F.col("p") == label_predicate).groupBy(F.col("s").alias("entity_id")).agg(F.min("o").alias("entity_label"))
    entities = types.join(labels, "entity_id", "left")
    relations = triples.where((F.col("p") != type_predicate) & ~F.col("is_literal")).select(F.col("s").alias("source_entity"), F.col("p").alias("predicate"), F.col("o").alias("target_entity")).distinct()
    return entities, relations
