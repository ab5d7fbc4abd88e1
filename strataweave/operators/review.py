"""Review of candidates and merging of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("relation_type", "subject_id", "object_id")


def upsert_candidates(old: DataFrame, new: DataFrame, relations: DataFrame) -> DataFrame:
    """Candidates after new ones arrive: those with a relation already are skipped; of equal keys the highest confidence stays, old first on ties."""
    fresh = new.join(relations.select(*KEY).distinct(), list(KEY), "left_anti")
    both = old.select(*KEY, "id", "confidence", F.lit(0).alias("age")).unionByName(fresh.select(*KEY, "id", "confidence", F.lit(1).alias("age")))
    best = F.min_by(F.struct("id", "confidence", "age"), F.struct(-F.col("confidence"), F.col("age"), F.col("id")))
    return both.groupBy(*KEY).agg(best.alias("b")).select(*KEY, "b.id", "b.confidence", (F.col("b.age") == 1).alias("is_new"))


def approve(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations that approval adds: one for each key that does not exist yet, of the candidate with the least id."""
    first = candidates.groupBy(*KEY).agg(F.min_by(F.struct("id", "confidence"), "id").alias("c"))
    return first.select(*KEY, "c.id", "c.confidence").join(relations.select(*KEY).distinct(), list(KEY), "left_anti")


def missing_evidence(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Evidence links of approved rows that the relations do not carry yet."""
    return wanted.join(held, ["relation_id", "evidence_type"], "left_anti").distinct()


def survivors(rows: DataFrame, key: str, order: list) -> DataFrame:
    """For every row the row of the same key that survives, and its own place."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).withColumn("survivor_id", F.first("id").over(w))


def repoint(relations: DataFrame, survivor: DataFrame) -> DataFrame:
    """Relations with both ends moved to survivors; self loops go, of equal edges the highest confidence stays."""
    s = survivor.select(F.col("id").alias("_old"), F.col("survivor_id").alias("_new"))
    for end in ("subject_id", "object_id"):
        relations = relations.join(s, F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    return relations.where("subject_id <> object_id").groupBy(*KEY).agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("merged"))


def merged_features(rows: DataFrame, key: str, maxima: list[str], sets: list[str]) -> DataFrame:
    """One row a key: the largest of each figure and the union of each array."""
    return rows.groupBy(key).agg(*[F.max(c).alias(c) for c in maxima], *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets])


def decide(candidates: DataFrame, decisions: DataFrame, relations: DataFrame, candidate_evidence: DataFrame, relation_evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """After a set of decisions: the candidates (with status), new relations, new evidence links, and what each candidate decided for the first time adds to the feedback counts.

    candidates: id, relation_type, subject_id, object_id, confidence, status, feedback_key. decisions: id, action (APPROVED or REJECTED); the last by ``at`` counts. An approval makes a
    relation if its key has none, and the relation of the key gets the candidate's evidence that it lacks; a rejection only changes status and counts.
    """
    last = decisions.groupBy("id").agg(F.max_by("action", F.struct("at", "action")).alias("action"))
    rows = candidates.join(last, "id", "left")
    after = rows.select("id", *KEY, "confidence", F.coalesce("action", "status").alias("status"), "feedback_key")
    approved = rows.where("action = 'APPROVED'")
    made = approve(approved.select("id", *KEY, "confidence"), relations).withColumn("id", F.concat(F.lit("R-"), F.col("id")))
    held = relations.groupBy(*KEY).agg(F.min("id").alias("relation_id")).unionByName(made.select(*KEY, F.col("id").alias("relation_id")))
    wanted = approved.select("id", *KEY).join(candidate_evidence.select(F.col("candidate_id").alias("id"), "evidence_id"), "id").join(held, list(KEY)).select("relation_id", "evidence_id").distinct()
    links = wanted.join(relation_evidence.select("relation_id", "evidence_id"), ["relation_id", "evidence_id"], "left_anti")
    first = rows.where("status = 'PENDING' and action is not null").groupBy("feedback_key").agg(F.count_if(F.col("action") == "APPROVED").alias("approved"), F.count_if(F.col("action") == "REJECTED").alias("rejected"))
    return after, made, links, first


def judged(predicted: DataFrame, truth: DataFrame, *key: str) -> DataFrame:
    """One row: predicted, true_positives, false_positives, false_negatives, precision and recall (four digits; 0 without any) over distinct keys."""
    p, t = predicted.select(*key).distinct().withColumn("p", F.lit(1)), truth.select(*key).distinct().withColumn("t", F.lit(1))
    sums = p.join(t, list(key), "full").agg(F.count("p").alias("predicted"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("true_positives"), F.count("t").alias("truths"))
    share = lambda n, of: F.when(F.col(of) > 0, F.round(F.col(n) / F.col(of), 4)).otherwise(0.0)
    return sums.select("predicted", "true_positives", (F.col("predicted") - F.col("true_positives")).alias("false_positives"), (F.col("truths") - F.col("true_positives")).alias("false_negatives"), share("true_positives", "predicted").alias("precision"), share("true_positives", "truths").alias("recall"))


def cutover(baseline: DataFrame, candidate: DataFrame, truth: DataFrame, *key: str, least_precision: float = 0.0, least_recall: float = 0.0, most_approvals: int = 0) -> DataFrame:
    """One row: both sides' counts and rates, the deltas, the failed checks and GO or NO_GO: precision and recall may not fall, nor the number of approvals grow, by more than the thresholds."""
    side = lambda df, name: judged(df, truth, *key).select(*[F.col(c).alias(f"{name}_{c}") for c in ("predicted", "true_positives", "false_positives", "false_negatives", "precision", "recall")], F.lit(1).alias("one"))
    rows = side(baseline, "baseline").join(side(candidate, "candidate"), "one").drop("one")  # one row each
    delta = lambda c: F.round(F.col(f"candidate_{c}") - F.col(f"baseline_{c}"), 4)
    rows = rows.withColumns({"precision_delta": delta("precision"), "recall_delta": delta("recall"), "approval_delta": F.col("candidate_predicted") - F.col("baseline_predicted")})
    failed = F.array_compact(F.array(F.when(F.col("precision_delta") < least_precision, "precision"), F.when(F.col("recall_delta") < least_recall, "recall"), F.when(F.col("approval_delta") > most_approvals, "approvals")))
    return rows.withColumn("failed", F.array_join(failed, ",")).withColumn("decision", F.when(F.size(failed) == 0, "GO").otherwise("NO_GO"))


def recut(chain: DataFrame, most: int, least: float, *group: str) -> DataFrame:
    """Of each group's evidence items of confidence ``least`` or more the best ``most``: by confidence, score and weight, then the nearer hop and the id."""
    order = [F.desc("confidence"), F.desc(F.round("score", 9)), F.desc("edge_weight"), F.col("hop"), F.col("evidence_id")]
    return chain.where(F.col("confidence") >= least).withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most)


def scenarios(signals: DataFrame, most: int = 5) -> DataFrame:
    """domain_id, place, title, trigger, entry_id, evidences: of each domain the first ``most`` scenarios, requests before messages, in order of their first signal.

    signals: domain_id, trigger (http, consume, publish), key, entry_id, seq, evidence_id. Equal keys are one scenario with the evidence of all; published messages start none.
    """
    rows = signals.where("trigger in ('http', 'consume')")
    sums = rows.groupBy("domain_id", "trigger", "key").agg(F.min("seq").alias("seq"), F.min_by("entry_id", F.struct("seq", "entry_id")).alias("entry_id"), F.count_distinct("evidence_id").alias("evidences"))
    w = Window.partitionBy("domain_id").orderBy(F.desc("trigger"), "seq", "key")
    title = F.when(F.col("trigger") == "http", F.concat("key", F.lit(" request"))).otherwise(F.concat("key", F.lit(" message")))
    return sums.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("domain_id", F.col("place").cast("long").alias("place"), title.alias("title"), "trigger", "entry_id", "evidences")
