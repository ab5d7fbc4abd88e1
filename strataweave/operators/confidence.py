"""Confidence arithmetic: cross-source validation, contradictions, review feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.scalars import clamp, round_half_up, support_boost


def source_of(evidence_type: Column) -> Column:
    """Which of config, code and db an evidence type speaks for."""
    return F.when(evidence_type.isin("CONFIG", "LLM_CONFIG"), "config").when(evidence_type.isin("FILE", "LLM_CODE"), "code").when(evidence_type == "SCHEMA", "db")


def by_source(evidences: DataFrame, relations: DataFrame) -> DataFrame:
    """status, evidence_type, source, n, relations: evidence (relation_id, evidence_type) of relations (relation_id, status), and how many different relations it names.

    Counted by relation first, where the join has put the rows, so none of them moves again.
    """
    each = evidences.join(relations, "relation_id").groupBy("relation_id", "status", "evidence_type").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("status", "evidence_type", source_of(F.col("evidence_type")).alias("source")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("relations"))


def adjusted(original: Column, sources: Column, contradictions: Column, boost: float = 0.3, penalty: float = 0.15) -> Column:
    """Unchanged for a single source without contradiction, else raised by support and lowered by contradictions, within .1 and .99."""
    new = clamp(original + support_boost(sources, boost) - penalty * contradictions, 0.1, 0.99)
    return F.when((sources < 2) & (contradictions == 0), original).otherwise(new)


def cross_validate(candidates: DataFrame, calls: DataFrame, objects: DataFrame) -> DataFrame:
    """id, sources, contradiction, confidence, adjusted, validated for call candidates (with evidence_types).

    A candidate known from code that targets a service is a phantom call unless the same
    subject really calls one of that service's endpoints.
    """
    known = calls.join(objects.select(F.col("id").alias("object_id"), F.col("parent_id")), "object_id").where("parent_id is not null")
    known = known.select("subject_id", F.col("parent_id").alias("object_id"), F.lit(True).alias("backed")).distinct()
    kinds = F.array_sort(F.array_distinct(F.transform("evidence_types", source_of)))
    rows = candidates.withColumn("kinds", kinds).join(known, ["subject_id", "object_id"], "left")
    phantom = F.array_contains("kinds", "code") & (F.col("relation_type") == "call") & F.col("backed").isNull()
    rows = rows.withColumn("n", F.size("kinds")).withColumn("bad", phantom.cast("int"))
    return rows.select(
        "id", F.array_join("kinds", ",").alias("sources"), F.when(phantom, "PHANTOM_CALL").otherwise("").alias("contradiction"), "confidence",
        adjusted(F.col("confidence"), F.col("n"), F.col("bad")).alias("adjusted"), ((F.col("n") > 1) & (F.col("bad") == 0)).alias("validated"),
    )


def feedback_stats(reviews: DataFrame, least: int = 10, most: float = 0.15) -> DataFrame:
    """feedback_key, approved, rejected, total, rate, adjustment of reviewed rows (feedback_key, status)."""
    sums = reviews.groupBy("feedback_key").agg(F.count_if(F.col("status") == "APPROVED").alias("approved"), F.count_if(F.col("status") == "REJECTED").alias("rejected"))
    rate = round_half_up(F.col("approved") / F.col("total"), 4)
    out = sums.withColumn("total", F.col("approved") + F.col("rejected")).where("total > 0").withColumn("rate", rate)
    change = round_half_up(clamp((F.col("rate") - 0.5) * most, -most, most), 4)
    return out.withColumn("adjustment", F.when(F.col("total") < least, 0.0).otherwise(change))


def apply_feedback(rows: DataFrame, stats: DataFrame, specific: str, general: str, least: int = 10) -> DataFrame:
    """Adds fed_confidence: the specific key's adjustment if it has samples enough, else the general one's if it has, else the first that exists."""
    s = stats.select(F.col("feedback_key").alias(specific), F.col("total").alias("n1"), F.col("adjustment").alias("a1"))
    g = stats.select(F.col("feedback_key").alias(general), F.col("total").alias("n2"), F.col("adjustment").alias("a2"))
    pick = F.when(F.col("n1") >= least, F.col("a1")).when(F.col("n2") >= least, F.col("a2")).otherwise(F.coalesce("a1", "a2", F.lit(0.0)))
    joined = rows.join(s, specific, "left").join(g, general, "left")
    return joined.withColumn("fed_confidence", round_half_up(clamp(F.col("confidence") + pick, 0.1, 0.99), 4)).drop("n1", "a1", "n2", "a2")


def unsupported(candidates: DataFrame, support: DataFrame, on: list[str], code: str, penalty: float = 0.15) -> DataFrame:
    """Adds contradiction (``code`` where no support has the same key, else empty) and the confidence that is left."""
    known = support.select(*on, F.lit(True).alias("_known")).distinct()
    bad = F.col("_known").isNull()
    out = candidates.join(known, on, "left").withColumn("contradiction", F.when(bad, code).otherwise(""))
    return out.withColumn("adjusted", F.when(bad, clamp(F.col("confidence") - penalty, 0.1, 0.99)).otherwise(F.col("confidence"))).drop("_known")
