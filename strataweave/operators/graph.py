"""Graph queries over edge tables: bounded reach, simple paths, usage, drill-down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.scalars import exact_avg, path_score
from strataweave.sources.scratch import stored


def neighbours(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) pairs to walk along, in one pass; for both directions a pair counts once, whichever way its edges point, and is turned afterwards."""
    s, o = F.col("subject_id"), F.col("object_id")
    if direction == "BOTH":
        pairs = edges.where(s.isNotNull() & o.isNotNull()).select(F.least(s, o).alias("a"), F.greatest(s, o).alias("b")).distinct()
        return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("p")).select("p.*")
    return {"DOWNSTREAM": edges.select(s.alias("src"), o.alias("dst")), "UPSTREAM": edges.select(o.alias("src"), s.alias("dst"))}[direction].distinct()


def reach(spark: SparkSession, edges: DataFrame, target: str, direction: str, max_depth: int) -> DataFrame:
    """id and least depth of every node within max_depth of target, target included: one join a level, joined visited nodes left out."""
    pairs = stored(neighbours(edges, direction), "pairs")
    seen = level = spark.createDataFrame([(target, 0)], "id string, depth int")
    for depth in range(1, max_depth + 1):
        step = level.select(F.col("id").alias("src")).join(pairs, "src").select(F.col("dst").alias("id")).distinct()
        level = stored(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "level")  # else each level repeats all before it
        seen = seen.unionByName(level)
    return seen


def impact_edges(edges: DataFrame, nodes: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """All edges that leave, in the direction walked, a node that was expanded."""
    inner = nodes.where(F.col("depth") < max_depth).select("id")
    ends = {"DOWNSTREAM": ["subject_id"], "UPSTREAM": ["object_id"], "BOTH": ["subject_id", "object_id"]}[direction]
    parts = [edges.join(inner.withColumnRenamed("id", end), end, "left_semi").select(*edges.columns) for end in ends]
    return reduce(DataFrame.union, parts).distinct()


def ahead(relations: DataFrame, source: str, target: str, max_hops: int) -> DataFrame:
    """The relations that a simple path of up to max_hops from source to target can take, stored, so that weights are made for those alone.

    Each level of reach is one pass over the stored relations against the nodes of the level before, new ones only; the last hop must end at the target.
    """
    s, o = F.col("subject_id"), F.col("object_id")
    rows = stored(relations.where((s != target) & (o != source)), "walkable")
    seen = level = relations.sparkSession.range(1).select(F.lit(source).alias("subject_id"))  # its size is known, so it is sent to the relations
    for _ in range(max_hops - 2):
        step = rows.join(level, "subject_id", "left_semi").select(o.alias("subject_id")).distinct()
        level = stored(step.join(seen, "subject_id", "left_anti"), "level")
        seen = seen.unionByName(level)
    return rows.join(seen.withColumn("near", F.lit(True)), "subject_id", "left").where(F.col("near") | (o == target)).select(*rows.columns)


def simple_paths(edges: DataFrame, source: str, target: str, max_hops: int, top_k: int) -> DataFrame:
    """The best paths without repeated nodes of 1 to max_hops edges: hops, path, avg confidence, least weight, score.

    Parallel edges of a pair count as one: the first by relation type. Walks stop at the target. Nodes that cannot
    reach the target in the hops left are cut, and so is a walk that even the most confident edges would
    not lift to the score of the top_k-th path found so far; both lose none of the best. Ties: fewer hops, then the path's text.
    """
    pair = edges.groupBy("subject_id", "object_id").agg(F.min_by(F.struct("edge_weight", "confidence"), "relation_type").alias("e"))
    step = stored(pair.select(F.col("subject_id").alias("at"), F.col("object_id").alias("next"), F.col("e.edge_weight").alias("w"), F.coalesce("e.confidence", F.lit(0.0)).alias("c")), "steps")
    most = step.agg(F.max("c")).first()[0] or 0.0
    left = [step.where(F.col("next") == target).select("at").distinct()]
    for _ in range(max_hops - 2):
        left.append(stored(left[-1].union(step.join(left[-1].withColumnRenamed("at", "next"), "next", "left_semi").select("at")).distinct(), "near"))
    score = lambda h: path_score(F.col("sum_c") / h, F.col("least_w"), F.lit(h))
    live = step.where(F.col("at") == source).select(F.array("at", "next").alias("path"), F.col("next").alias("at"), F.col("c").alias("sum_c"), F.col("w").alias("least_w"))
    best = None
    for hops in range(1, max_hops + 1):
        done = live.where(F.col("at") == target).select(F.lit(hops).alias("hops"), F.concat_ws(">", "path").alias("path"), (F.col("sum_c") / hops).alias("avg_confidence"), "least_w", score(hops).alias("score"))
        best = done if best is None else best.unionByName(done)
        best = stored(best.orderBy(F.desc(F.round("score", 9)), "hops", "path").limit(top_k), "paths")
        if hops == max_hops:
            return best.orderBy(F.desc(F.round("score", 9)), "hops", "path")
        bar = best.agg(F.when(F.count(F.lit(1)) >= top_k, F.min("score")).otherwise(-1.0)).first()[0] - 1e-8  # one number: the score to beat
        ahead = F.greatest(*[path_score((F.col("sum_c") + more * F.lit(most)) / (hops + more), F.col("least_w"), F.lit(hops + more)) for more in range(1, max_hops - hops + 1)], F.lit(-2.0))
        live = live.where(F.col("at") != target).where(ahead >= bar).join(left[max_hops - hops - 1], "at", "left_semi")
        live = live.join(step, "at").where(~F.array_contains("path", F.col("next")))
        live = live.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at"), (F.col("sum_c") + F.col("c")).alias("sum_c"), F.least("least_w", "w").alias("least_w"))
        live = stored(live, "walks")


def usage(rollup: DataFrame, relations: DataFrame, object_id: str) -> DataFrame:
    """Rollup edges into an object and the atomic relations on it, of any status."""
    a = rollup.where(F.col("object_id") == object_id).select(F.lit("rollup").alias("kind"), "relation_type", "subject_id", "object_id", "confidence")
    b = relations.where(F.col("object_id") == object_id).select(F.lit("atomic").alias("kind"), "relation_type", "subject_id", "object_id", "confidence")
    return a.unionAll(b)


def root_ancestors(objects: DataFrame) -> DataFrame:
    """id and the first id of its materialised path."""
    return objects.select("id", F.split("path", "/")[1].alias("root_id"))


def unused_atomics(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Atomic objects that no relation uses."""
    used = relations.select(F.col("object_id").alias("id")).union(relations.select(F.col("subject_id").alias("id"))).distinct()
    return objects.where("granularity = 'ATOMIC'").join(used, "id", "left_anti")


def contributors(relations: DataFrame, objects: DataFrame, target: str, group: str) -> DataFrame:
    """Approved relations into the subtree of a compound object, summed by relation type, source or target, heaviest first."""
    scope = objects.where((F.col("id") == target) | F.col("path").startswith(f"/{target}/")).select(F.col("id").alias("object_id"))
    rows = relations.where("status = 'APPROVED' and relation_type <> 'expose'").join(scope, "object_id", "left_semi")
    key = {"type": "relation_type", "source": "subject_id", "target": "object_id"}[group]
    return rows.groupBy(F.col(key).alias("group_key")).agg(F.count(F.lit(1)).alias("weight"), exact_avg(F.col("confidence")).alias("confidence"))


def evidence_chain(edges: DataFrame, provenance: DataFrame, evidences: DataFrame, hop: int = 0) -> DataFrame:
    """An item for each edge and evidence of its base relations, or one 'rollup' item; score is confidence times weight over hop + 1."""
    key = ["relation_type", "subject_id", "object_id"]
    seen = provenance.join(evidences.select(F.col("relation_id").alias("base_relation_id"), F.col("id").alias("evidence_id"), "evidence_type"), "base_relation_id")
    rows = edges.join(seen.select(*key, "evidence_id", "evidence_type").distinct(), key, "left")
    score = F.col("confidence") * F.col("edge_weight") / (hop + 1)
    return rows.select(*key, "edge_weight", "confidence", F.coalesce("evidence_type", F.lit("rollup")).alias("evidence_type"), F.coalesce("evidence_id", F.lit("")).alias("evidence_id"), score.alias("score"))


def top_evidence(chain: DataFrame, most: int = 10) -> DataFrame:
    """The best items of an evidence chain: by score, edge weight and confidence, then the nearer hop and the evidence's id."""
    return chain.orderBy(F.desc(F.round("score", 9)), F.desc("edge_weight"), F.desc("confidence"), "hop", "evidence_id", "subject_id", "object_id", "relation_type").limit(most)
