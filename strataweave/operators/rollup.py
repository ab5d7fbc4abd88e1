"""Rollups: atomic relations become weighted edges between services, databases, brokers and domains.

All take relations (id, relation_type, subject_id, object_id, confidence, status) and objects (id, object_type, granularity, parent_id).
Only approved relations count. One shuffle on the edge key; objects join by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.scalars import exact_avg
from strataweave.sources.scratch import stored

EDGE = ("relation_type", "subject_id", "object_id")


def approved(relations: DataFrame, *types: str) -> DataFrame:
    return relations.where((F.col("status") == "APPROVED") & F.col("relation_type").isin(*types))


def _lifted(relations: DataFrame, objects: DataFrame, target: Column) -> DataFrame:
    # The objects of a partition are hashed, so the relations, which are many more, are not sorted.
    o = objects.select(F.col("id").alias("object_id"), "granularity", "parent_id")
    return relations.join(o.hint("shuffle_hash"), "object_id").withColumn("object_id", target).where(F.col("object_id").isNotNull())


def service_calls(relations: DataFrame, objects: DataFrame) -> DataFrame:
    """Relation rows lifted to service level: a call's target is the object if compound, else its parent; no self edges."""
    # One pass: both kinds meet the objects together.
    whole = (F.col("relation_type") == "depend_on") | (F.col("granularity") == "COMPOUND")
    lifted = _lifted(approved(relations, "call", "depend_on"), objects, F.when(whole, F.col("object_id")).otherwise(F.col("parent_id")))
    return lifted.where("subject_id <> object_id").drop("granularity", "parent_id")


def edges(lifted: DataFrame) -> DataFrame:
    """relation_type, subject_id, object_id, edge_weight, confidence."""
    return lifted.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("edge_weight"), exact_avg(F.col("confidence")).alias("confidence"))


def service_to_service(relations: DataFrame, objects: DataFrame) -> DataFrame:
    return edges(service_calls(relations, objects))


def service_to_parent(relations: DataFrame, objects: DataFrame, *types: str) -> DataFrame:
    """Access to an atomic object counts for its parent: a table's database, a topic's broker."""
    return edges(_lifted(approved(relations, *types), objects, F.col("parent_id")))


def service_to_database(relations: DataFrame, objects: DataFrame) -> DataFrame:
    return service_to_parent(relations, objects, "read", "write")


def service_to_broker(relations: DataFrame, objects: DataFrame) -> DataFrame:
    return service_to_parent(relations, objects, "produce", "consume")


def domain_to_domain(s2s: DataFrame, affinities: DataFrame, least: float = 0.2) -> DataFrame:
    """Call edges spread over the domains of both ends by affinity; weights sum, confidence is weighted. Affinities are cut before they join."""
    a = affinities.where(F.col("affinity") >= least)
    x = a.select(F.col("object_id").alias("subject_id"), F.col("domain_id").alias("from_domain"), F.col("affinity").alias("ax"))
    y = a.select("object_id", F.col("domain_id").alias("to_domain"), F.col("affinity").alias("by"))
    k = F.col("edge_weight") * F.col("ax") * F.col("by")
    spread = s2s.where("relation_type = 'call'").join(x, "subject_id").join(y, "object_id").withColumn("k", k)
    sums = spread.groupBy("from_domain", "to_domain").agg(F.sum("k").alias("weight"), F.sum(F.coalesce("confidence", F.lit(0.0)) * F.col("k")).alias("ck"))
    return sums.select("from_domain", "to_domain", F.floor(F.col("weight") + 0.5).alias("edge_weight"), "weight", F.when(F.col("weight") > 0, F.col("ck") / F.col("weight")).alias("confidence"))


def graph_stats(level_edges: DataFrame) -> DataFrame:
    """object_id, out_degree, in_degree, by one pass: each edge counts once at either end."""
    ends = level_edges.select(F.explode(F.array(F.struct(F.col("subject_id").alias("o"), F.lit(1).alias("out"), F.lit(0).alias("inn")), F.struct(F.col("object_id").alias("o"), F.lit(0).alias("out"), F.lit(1).alias("inn")))).alias("e"))
    return ends.groupBy(F.col("e.o").alias("object_id")).agg(F.sum("e.out").alias("out_degree"), F.sum("e.inn").alias("in_degree"))


def hubs(stats: DataFrame, threshold: int = 50) -> DataFrame:
    """Objects whose in-degree reaches the threshold, which is kept within 5 to 500."""
    return stats.where(F.col("in_degree") >= max(5, min(500, threshold)))


def provenance(lifted: DataFrame) -> DataFrame:
    """The long form of what an edge was made from: one row for each edge and base relation."""
    return lifted.select(*EDGE, F.col("id").alias("base_relation_id")).distinct()


#: The level of edges that each relation type makes.
LEVELS = {"call": "SERVICE_TO_SERVICE", "expose": "SERVICE_TO_SERVICE", "depend_on": "SERVICE_TO_SERVICE", "read": "SERVICE_TO_DATABASE", "write": "SERVICE_TO_DATABASE", "produce": "SERVICE_TO_BROKER", "consume": "SERVICE_TO_BROKER"}


def affected_scope(events: DataFrame, relations: DataFrame) -> DataFrame:
    """(level, service_id) that change events touch: services whose outgoing edges of that level are to be built again.

    events: kind, relation_type, subject_id, object_id; stored, as is what they touch, so nothing before them runs again. Relations are met once, and only
    if events name objects. A created or deleted relation touches its subject; EXPOSE_CHANGED its subject
    and the endpoint's callers; OBJECT_PARENT_CHANGED all that refer to the object; DOMAIN_AFFINITY_CHANGED the level of domains
    (service_id null). Any change between services touches the level of domains too.
    """
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    events = stored(events.select("kind", "relation_type", "subject_id", "object_id"), "scope-events")
    made = events.where("kind in ('RELATION_CREATED', 'RELATION_DELETED')").select(level[F.col("relation_type")].alias("level"), F.col("subject_id").alias("service_id"))
    exposed = events.where("kind = 'EXPOSE_CHANGED'")
    moved = events.where("kind = 'OBJECT_PARENT_CHANGED'")
    found = made.unionByName(exposed.select(F.lit("SERVICE_TO_SERVICE").alias("level"), F.col("subject_id").alias("service_id")))
    named = moved.select("object_id", F.lit(False).alias("calls")).unionByName(exposed.select("object_id", F.lit(True).alias("calls"))).groupBy("object_id").agg(F.min("calls").alias("calls"))
    if not events.where("kind in ('EXPOSE_CHANGED', 'OBJECT_PARENT_CHANGED')").isEmpty():
        users = relations.where("status = 'APPROVED'").join(named.hint("shuffle_hash"), "object_id").where("not calls or relation_type = 'call'")
        found = found.unionByName(users.select(level[F.col("relation_type")].alias("level"), F.col("subject_id").alias("service_id")))
    found = stored(found.where("level is not null and service_id is not null").distinct(), "scope")
    domains = found.where("level = 'SERVICE_TO_SERVICE'").select(F.lit(1)).limit(1).union(events.where("kind = 'DOMAIN_AFFINITY_CHANGED'").select(F.lit(1)).limit(1)).distinct()
    return found.unionByName(domains.select(F.lit("DOMAIN_TO_DOMAIN").alias("level"), F.lit(None).cast("string").alias("service_id")))


def services_at(scope: DataFrame, level: str) -> DataFrame:
    """subject_id of the services that a scope names at a level."""
    return scope.where(F.col("level") == level).select(F.col("service_id").alias("subject_id"))


def incremental(old: DataFrame, relations: DataFrame, subjects: DataFrame, build) -> DataFrame:
    """Edges of the subjects are built again from their own base relations alone; the others are kept. ``build(relations)`` makes edges."""
    kept = old.join(subjects, "subject_id", "left_anti").select(*EDGE, "edge_weight", "confidence")
    return kept.unionByName(build(relations.join(subjects, "subject_id", "left_semi")))


def incremental_stats(stats: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Degrees after edges were removed and added: only the ends of those edges change; objects without an edge go."""
    signed = graph_stats(added).unionByName(graph_stats(removed).select("object_id", (-F.col("out_degree")).alias("out_degree"), (-F.col("in_degree")).alias("in_degree")))
    sums = stats.unionByName(signed).groupBy("object_id").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"))
    return sums.where("out_degree > 0 or in_degree > 0")
