"""Queries on candidates: validation, feedback, approval, merging, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataweave.functions.scalars import exact_avg, r6
from strataweave.operators import confidence, review
from strataweave.sources.graph_tables import GraphTables, avg6_sql, with_tables


def cross_validation(spark, sf_dir):
    g = GraphTables(spark, sf_dir)
    out = confidence.cross_validate(g.candidates(), g.relations().where("relation_type = 'call' and status = 'APPROVED'"), g.objects())
    return out.withColumn("confidence", r6(F.col("confidence"))).withColumn("adjusted", r6(F.col("adjusted")))


def validation_counts(spark, sf_dir):
    v = cross_validation(spark, sf_dir)
    return v.groupBy("sources", "contradiction").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("validated").alias("validated"), r6(exact_avg(F.col("adjusted") - F.col("confidence"))).alias("mean_change"))


def _reviews(g: GraphTables):
    """Reviewed calls with their feedback keys, over all call relations."""
    s = g.steps()
    status = F.when(F.col("l_quantity") <= 10, "REJECTED").otherwise("APPROVED")
    return s.select(F.concat_ws(":", F.lit("call"), "l_linestatus", "l_returnflag").alias("k1"), F.concat_ws(":", F.lit("call"), "l_linestatus").alias("k2"), status.alias("status"))


def feedback_stats(spark, sf_dir):
    r = _reviews(GraphTables(spark, sf_dir))
    rows = r.select(F.explode(F.array("k1", "k2")).alias("feedback_key"), "status")
    return confidence.feedback_stats(rows)


def feedback_apply(spark, sf_dir):
    g = GraphTables(spark, sf_dir)
    rows = g.steps(waiting=True).select(F.concat(F.lit("C"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("rn").cast("string")).alias("id"), F.concat_ws(":", F.lit("call"), "l_linestatus", "l_returnflag").alias("k1"), F.concat_ws(":", F.lit("call"), "l_linestatus").alias("k2"), (1 - F.col("l_discount")).alias("confidence"))
    return confidence.apply_feedback(rows, feedback_stats(spark, sf_dir), "k1", "k2").select("id", r6(F.col("confidence")).alias("confidence"), "fed_confidence")


FEEDBACK = """rv AS (SELECT 'call:' || l_linestatus || ':' || l_returnflag AS k1, 'call:' || l_linestatus AS k2, l_quantity <= 10 AS bad FROM steps),
fb AS (SELECT *, CASE WHEN total < 10 THEN 0.0 ELSE floor(least(greatest((rate - 0.5) * 0.15, -0.15), 0.15) * 10000 + 0.5) / 10000 END AS adjustment FROM (
  SELECT k AS feedback_key, count(*) FILTER (WHERE NOT bad) AS approved, count(*) FILTER (WHERE bad) AS rejected, count(*) AS total, floor(count(*) FILTER (WHERE NOT bad) / count(*) * 10000 + 0.5) / 10000 AS rate
  FROM (SELECT k1 AS k, bad FROM rv UNION ALL SELECT k2, bad FROM rv) GROUP BY 1))"""


def approve_candidates(spark, sf_dir):
    """Relations that approving all candidates of confidence .95 or more adds."""
    g = GraphTables(spark, sf_dir)
    good = g.candidates().where("confidence >= 0.95").select("id", "relation_type", "subject_id", "object_id", "confidence")
    out = review.approve(good, g.relations().where("relation_type in ('call', 'depend_on')"))
    return out.withColumn("confidence", r6(F.col("confidence")))


def candidate_upsert(spark, sf_dir):
    """Candidates of open lines updated by those of closed ones."""
    g = GraphTables(spark, sf_dir)
    key = ["id", "relation_type", "subject_id", "object_id", "confidence"]
    old, new = g.candidates().where("language = 'O'").select(*key), g.candidates().where("language <> 'O'").select(*key)
    done = g.relations().where("relation_type = 'depend_on'").withColumn("relation_type", F.lit("call"))
    out = review.upsert_candidates(old, new, done)
    return out.withColumn("confidence", r6(F.col("confidence")))


def promote_evidence(spark, sf_dir):
    """Code and schema evidence of approved calls that configuration evidence does not cover yet."""
    g = GraphTables(spark, sf_dir)
    e = g.evidences().select("relation_id", "evidence_type")
    wanted = e.join(g.relations().where("status = 'APPROVED'").select(F.col("id").alias("relation_id")), "relation_id", "left_semi")
    held = e.where("evidence_type = 'CONFIG'")
    return review.missing_evidence(wanted, held)


def merge_tables(spark, sf_dir):
    """Parts of one brand and size are one table: relations are moved to the survivor and merged."""
    g = GraphTables(spark, sf_dir)
    p = g.source("part").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws("|", "p_brand", "p_type").alias("k"), "p_partkey")
    s = review.survivors(p, "k", ["p_partkey"])
    out = review.repoint(g.relations().where("relation_type in ('read', 'write')"), s)
    return out.withColumn("confidence", r6(F.col("confidence")))


def dedupe_objects(spark, sf_dir):
    """Customers of equal nation, segment and balance sign: place and survivor of each."""
    c = GraphTables(spark, sf_dir).source("customer").select(F.col("c_custkey").alias("id"), F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment", (F.col("c_acctbal") >= 0).cast("string")).alias("k"))
    out = review.survivors(c, "k", ["id"])
    return out.select("id", F.col("place").cast("long").alias("place"), "survivor_id")


def merged_candidates(spark, sf_dir):
    """Candidates of one subject as one row: best confidence and tax, union of targets."""
    g = GraphTables(spark, sf_dir)
    rows = g.candidates().withColumn("targets", F.array("object_id"))
    out = review.merged_features(rows, "subject_id", ["confidence", "tax"], ["targets"])
    return out.select("subject_id", r6(F.col("confidence")).alias("confidence"), r6(F.col("tax")).alias("tax"), F.array_join("targets", ",").alias("targets"))


def dashboard_counts(spark, sf_dir):
    g = GraphTables(spark, sf_dir)
    a = g.objects().groupBy(F.lit("objects").alias("what"), F.col("object_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    b = g.relations().groupBy(F.lit("relations").alias("what"), F.concat_ws(":", "relation_type", "status").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def cutover_report(spark, sf_dir):
    """Precision and recall of the candidate pairs against the service-to-service pairs of the whole order table."""
    g = GraphTables(spark, sf_dir)
    predicted = g.candidates().select("subject_id", "object_id").distinct()
    truth = g.relations().where("relation_type = 'call' and status = 'APPROVED'").join(g.objects().select(F.col("id").alias("object_id"), "parent_id"), "object_id").select("subject_id", F.col("parent_id").alias("object_id")).distinct()
    hit = predicted.join(truth, ["subject_id", "object_id"], "left_semi")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sums = one(predicted, "predicted").join(F.broadcast(one(truth, "truth"))).join(F.broadcast(one(hit, "hits")))  # one row each
    ratio = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).when(F.col(n) <= 0, 1.0).otherwise(0.0)
    return sums.select("predicted", "truth", "hits", r6(ratio("hits", "predicted")).alias("precision"), r6(ratio("hits", "truth")).alias("recall"))


def candidate_list(spark, sf_dir):
    """The first fifty candidates by confidence."""
    return GraphTables(spark, sf_dir).candidates().select("id", "subject_id", "object_id", r6(F.col("confidence")).alias("confidence")).orderBy(F.desc("confidence"), "id").limit(50)


def tag_counts(spark, sf_dir):
    """Every nation as a tag, with its customers and suppliers; tags without any count nought."""
    g = GraphTables(spark, sf_dir)
    c = g.source("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = g.source("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return g.source("nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def sharing_model(spark, sf_dir):
    """Tables by how many services use them."""
    g = GraphTables(spark, sf_dir)
    rows = g.relations().where("relation_type in ('read', 'write')").groupBy(F.col("object_id").alias("table_id")).agg(F.count_distinct("subject_id").alias("services"))
    return rows.withColumn("model", F.when(F.col("services") > 1, "SHARED").otherwise("OWNED"))


def stale_config(spark, sf_dir):
    """Configured accesses to databases without an access in code by the same service to one of their tables."""
    g = GraphTables(spark, sf_dir)
    c = g.chain(waiting=True).where("l_returnflag in ('R', 'A')").join(g.source("part"), F.col("l_partkey") == F.col("p_partkey"))
    c = c.select(F.concat_ws(":", "l_orderkey", "rn").alias("id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("subject_id"), F.concat(F.lit("DB"), F.col("p_brand")).alias("object_id"), (1 - F.col("l_tax")).alias("confidence"))
    tables = g.objects().where("object_type = 'db_table'").select(F.col("id").alias("object_id"), "parent_id")
    support = g.relations().where("relation_type in ('read', 'write')").join(tables, "object_id").select("subject_id", F.col("parent_id").alias("object_id"))
    out = confidence.unsupported(c, support, ["subject_id", "object_id"], "STALE_CONFIG")
    return out.select("id", "subject_id", "object_id", "contradiction", r6(F.col("adjusted")).alias("adjusted"))


def dead_topics(spark, sf_dir):
    """Messages of small value as configured ones: dead where no other message uses the same topic from the same service."""
    g = GraphTables(spark, sf_dir)
    small = g.source("events").select(F.concat(F.lit("M"), F.col("event_id").cast("string")).alias("id"), (F.coalesce("value", F.lit(0.0)) < 5).alias("small"))
    m = g.relations().where("relation_type in ('produce', 'consume')").join(small, "id")
    out = confidence.unsupported(m.where("small"), m.where("not small"), ["relation_type", "subject_id", "object_id"], "DEAD_TOPIC")
    return out.select("id", "contradiction", r6(F.col("adjusted")).alias("adjusted"))


def orphan_keys(spark, sf_dir):
    """Keys from each part to the one before it of its brand: orphans where no service uses either."""
    g = GraphTables(spark, sf_dir)
    p = g.source("part").withColumn("ref", F.lag("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("ref is not null")
    used = g.relations().where("relation_type in ('read', 'write')").select(F.substring("object_id", 2, 20).cast("long").alias("end")).distinct()
    ends = p.select("p_partkey", F.explode(F.array("p_partkey", "ref")).alias("end")).join(used, "end", "left_semi").select("p_partkey")
    out = confidence.unsupported(p.select("p_partkey", "ref", F.lit(0.5).alias("confidence")), ends, ["p_partkey"], "ORPHAN_FK")
    return out.select("p_partkey", "ref", "contradiction", r6(F.col("adjusted")).alias("adjusted"))


CAND = "cand AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'N' THEN 'code,db' ELSE 'code' END ELSE CASE WHEN l_returnflag = 'N' THEN 'config,db' ELSE 'config' END END AS sources FROM candidates)"
VALID = """known AS (SELECT DISTINCT subject_id, parent_id FROM relations r JOIN objects o ON r.object_id = o.id WHERE r.relation_type = 'call' AND r.status = 'APPROVED'),
vv AS (SELECT c.*, sources LIKE '%,%' AS two, contains(sources, 'code') AND k.parent_id IS NULL AS phantom FROM cand c LEFT JOIN known k ON k.subject_id = c.subject_id AND k.parent_id = c.object_id),
valid AS (SELECT id, sources, CASE WHEN phantom THEN 'PHANTOM_CALL' ELSE '' END AS contradiction, round(confidence, 6) AS confidence,
  round(CASE WHEN NOT two AND NOT phantom THEN confidence ELSE least(greatest(confidence + CASE WHEN two THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN phantom THEN 0.15::DOUBLE ELSE 0 END, 0.1), 0.99) END, 6) AS adjusted, two AND NOT phantom AS validated FROM vv)"""

ENTRIES = {
    "cross_validation": (cross_validation, with_tables("SELECT * FROM valid", CAND, VALID)),
    "validation_counts": (validation_counts, with_tables("SELECT sources, contradiction, count(*) AS candidates, count(*) FILTER (WHERE validated) AS validated, " + avg6_sql("adjusted - confidence") + " AS mean_change FROM valid GROUP BY ALL", CAND, VALID)),
    "stale_config": (stale_config, with_tables("""SELECT l_orderkey || ':' || rn AS id, 'S' || l_suppkey AS subject_id, 'DB' || p_brand AS object_id, CASE WHEN k THEN '' ELSE 'STALE_CONFIG' END AS contradiction, round(CASE WHEN k THEN 1 - l_tax ELSE least(greatest(1 - l_tax - 0.15, 0.1), 0.99) END, 6) AS adjusted FROM (
        SELECT *, EXISTS (SELECT 1 FROM relations r JOIN objects o ON o.id = r.object_id WHERE r.relation_type IN ('read', 'write') AND r.subject_id = 'S' || l_suppkey AND o.parent_id = 'DB' || p_brand) AS k FROM waiting JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'A'))""")),
    "dead_topics": (dead_topics, with_tables("""SELECT id, CASE WHEN k THEN '' ELSE 'DEAD_TOPIC' END AS contradiction, round(CASE WHEN k THEN confidence ELSE least(greatest(confidence - 0.15, 0.1), 0.99) END, 6)::DOUBLE AS adjusted FROM (
        SELECT r.*, small, bool_or(NOT small) OVER (PARTITION BY relation_type, subject_id, object_id) AS k FROM relations r JOIN (SELECT 'M' || event_id AS id, coalesce(value, 0) < 5 AS small FROM events) e ON e.id = r.id WHERE relation_type IN ('produce', 'consume')) WHERE small""")),
    "orphan_keys": (orphan_keys, with_tables("""SELECT p_partkey, ref, CASE WHEN k THEN '' ELSE 'ORPHAN_FK' END AS contradiction, CASE WHEN k THEN 0.5 ELSE 0.35 END::DOUBLE AS adjusted FROM (
        SELECT *, EXISTS (SELECT 1 FROM relations r WHERE r.relation_type IN ('read', 'write') AND r.object_id IN ('T' || p_partkey, 'T' || ref)) AS k FROM (SELECT p_partkey, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ref FROM part) WHERE ref IS NOT NULL)""")),
    "feedback_stats": (feedback_stats, with_tables("SELECT feedback_key, approved, rejected, total, rate, adjustment FROM fb", FEEDBACK)),
    "feedback_apply": (feedback_apply, with_tables("""SELECT 'C' || l_orderkey || ':' || rn AS id, round(1 - l_discount, 6) AS confidence,
        floor(least(greatest(1 - l_discount + CASE WHEN a.total >= 10 THEN a.adjustment WHEN b.total >= 10 THEN b.adjustment ELSE coalesce(a.adjustment, b.adjustment, 0) END, 0.1), 0.99) * 10000 + 0.5) / 10000 AS fed_confidence
        FROM waiting_steps LEFT JOIN fb a ON a.feedback_key = 'call:' || l_linestatus || ':' || l_returnflag LEFT JOIN fb b ON b.feedback_key = 'call:' || l_linestatus""", FEEDBACK)),
    "approve_candidates": (approve_candidates, with_tables("""SELECT relation_type, subject_id, object_id, min(id) AS id, round(arg_min(confidence, id), 6) AS confidence FROM candidates c WHERE confidence >= 0.95
        AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.relation_type = c.relation_type AND r.subject_id = c.subject_id AND r.object_id = c.object_id) GROUP BY ALL""")),
    "candidate_upsert": (candidate_upsert, with_tables("""SELECT relation_type, subject_id, object_id, arg_min(id, (-confidence, age, id)) AS id, round(max(confidence), 6) AS confidence, arg_min(age, (-confidence, age, id)) = 1 AS is_new FROM (
        SELECT id, relation_type, subject_id, object_id, confidence, 0 AS age FROM candidates WHERE l_linestatus = 'O' UNION ALL
        SELECT id, relation_type, subject_id, object_id, confidence, 1 FROM candidates c WHERE l_linestatus <> 'O' AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.relation_type = 'depend_on' AND r.subject_id = c.subject_id AND r.object_id = c.object_id)) GROUP BY ALL""")),
    "promote_evidence": (promote_evidence, with_tables("SELECT DISTINCT relation_id, evidence_type FROM evidences e WHERE evidence_type <> 'CONFIG' AND EXISTS (SELECT 1 FROM relations r WHERE r.id = relation_id AND status = 'APPROVED')")),
    "merge_tables": (merge_tables, with_tables("""SELECT relation_type, subject_id, s AS object_id, round(max(confidence), 6) AS confidence, count(*) AS merged FROM relations r JOIN (
        SELECT 'T' || p_partkey AS id, 'T' || min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS s FROM part) p ON r.object_id = p.id WHERE relation_type IN ('read', 'write') GROUP BY ALL""")),
    "dedupe_objects": (dedupe_objects, "SELECT c_custkey AS id, row_number() OVER w AS place, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, c_acctbal >= 0) AS survivor_id FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment, c_acctbal >= 0 ORDER BY c_custkey)"),
    "merged_candidates": (merged_candidates, with_tables("SELECT subject_id, round(max(confidence), 6) AS confidence, round(max(tax), 6) AS tax, array_to_string(list_sort(list_distinct(list(object_id))), ',') AS targets FROM candidates GROUP BY 1")),
    "dashboard_counts": (dashboard_counts, with_tables("SELECT 'objects' AS what, object_type AS kind, count(*) AS n FROM objects GROUP BY ALL UNION ALL SELECT 'relations', relation_type || ':' || status, count(*) FROM relations GROUP BY ALL")),
    "cutover_report": (cutover_report, with_tables("""SELECT count(*) FILTER (WHERE p) AS predicted, count(*) FILTER (WHERE t) AS truth, count(*) FILTER (WHERE p AND t) AS hits, round(count(*) FILTER (WHERE p AND t) / count(*) FILTER (WHERE p), 6) AS precision, round(count(*) FILTER (WHERE p AND t) / count(*) FILTER (WHERE t), 6) AS recall
        FROM (SELECT s, o, bool_or(k = 1) AS p, bool_or(k = 2) AS t FROM (SELECT subject_id AS s, object_id AS o, 1 AS k FROM candidates UNION ALL SELECT subject_id, parent_id, 2 FROM relations r JOIN objects x ON r.object_id = x.id WHERE relation_type = 'call' AND status = 'APPROVED') GROUP BY ALL)""")),
    "candidate_list": (candidate_list, with_tables("SELECT id, subject_id, object_id, round(confidence, 6) AS confidence FROM candidates ORDER BY 4 DESC, 1 LIMIT 50")),
    "tag_counts": (tag_counts, "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation"),
    "sharing_model": (sharing_model, with_tables("SELECT object_id AS table_id, count(DISTINCT subject_id) AS services, CASE WHEN count(DISTINCT subject_id) > 1 THEN 'SHARED' ELSE 'OWNED' END AS model FROM relations WHERE relation_type IN ('read', 'write') GROUP BY 1")),
}
