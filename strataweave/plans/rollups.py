"""Queries on rollups and their upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions.scalars import r6
from strataweave.operators import graph, rollup
from strataweave.sources.graph_tables import GraphTables, avg6_sql, with_tables
from strataweave.sources.scratch import fresh_path, stored
from strataweave.streaming import changes

LIFT = """lifted AS (SELECT relation_type, subject_id, object_id, id, confidence FROM (
  SELECT r.relation_type, r.subject_id, r.id, r.confidence, CASE WHEN r.relation_type = 'depend_on' OR o.granularity = 'COMPOUND' THEN r.object_id ELSE o.parent_id END AS object_id
  FROM relations r JOIN objects o ON r.object_id = o.id WHERE r.status = 'APPROVED' AND r.relation_type IN ('call', 'depend_on')) WHERE object_id <> subject_id)"""
AVG6 = avg6_sql("confidence")
PARENT = "SELECT relation_type, subject_id, o.parent_id AS object_id, count(*) AS edge_weight, " + AVG6 + " AS confidence FROM relations r JOIN objects o ON r.object_id = o.id WHERE status = 'APPROVED' AND relation_type IN ({}) AND o.parent_id IS NOT NULL GROUP BY ALL"


def edge_columns(df):
    return df.select("relation_type", "subject_id", "object_id", F.col("edge_weight").cast("long").alias("edge_weight"), r6(F.col("confidence")).alias("confidence"))


def of_types(g: GraphTables, *types: str):
    """Objects of some types; the other branches of the union fold away in the plan."""
    return g.objects().where(F.col("object_type").isin(*types))


def called(g: GraphTables):
    """What calls and dependencies can point at."""
    return of_types(g, "service", "api_endpoint")


#: Types of relations between services.
CALLS = ("call", "depend_on")


def s2s_of(g: GraphTables):
    return rollup.service_to_service(g.relations(*CALLS), called(g))


def rollup_s2s(spark, sf_dir):
    return edge_columns(s2s_of(GraphTables(spark, sf_dir)))


def rollup_s2db(spark, sf_dir):
    g = GraphTables(spark, sf_dir)
    return edge_columns(rollup.service_to_database(g.relations("read", "write"), of_types(g, "db_table")))


def rollup_s2broker(spark, sf_dir):
    g = GraphTables(spark, sf_dir)
    return edge_columns(rollup.service_to_broker(g.relations("produce", "consume"), of_types(g, "topic")))


def rollup_d2d(spark, sf_dir):
    g = GraphTables(spark, sf_dir)
    out = rollup.domain_to_domain(s2s_of(g), g.affinities())
    return out.select("from_domain", "to_domain", F.col("edge_weight").cast("long").alias("edge_weight"), r6(F.col("weight")).alias("weight"), r6(F.col("confidence")).alias("confidence"))


def graph_stats(spark, sf_dir):
    return rollup.graph_stats(s2s_of(GraphTables(spark, sf_dir)))


def hubs(spark, sf_dir):
    return rollup.hubs(rollup.graph_stats(s2s_of(GraphTables(spark, sf_dir))), 5)


def rollup_provenance(spark, sf_dir):
    g = GraphTables(spark, sf_dir)
    return rollup.provenance(rollup.service_calls(g.relations(*CALLS), called(g)))


def _events(g: GraphTables):
    """Change events from lines that wait, early ones of an order: deleted where returned, else created."""
    s = g.steps(waiting=True).where("l_linenumber <= 2")
    return s.select(
        (F.col("l_orderkey") * 100 + F.col("rn")).alias("event_id"), F.when(F.col("l_returnflag") == "R", "RELATION_DELETED").otherwise("RELATION_CREATED").alias("kind"), F.lit("call").alias("relation_type"),
        F.concat(F.lit("S"), F.col("a_supp").cast("string")).alias("subject_id"), F.concat(F.lit("E"), F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("object_id"), (1 - F.col("l_discount")).alias("confidence"),
    )


def _mixed_events(g: GraphTables):
    """Events of all kinds, by a waiting line's place in its order."""
    s, n = g.steps(waiting=True), F.col("l_linenumber")
    kind = F.when(n == 3, "EXPOSE_CHANGED").when(n == 4, "OBJECT_PARENT_CHANGED").when(n == 5, "DOMAIN_AFFINITY_CHANGED").when(F.col("l_returnflag") == "R", "RELATION_DELETED").otherwise("RELATION_CREATED")
    on_table = n.isin(4, 6)
    target = F.when(on_table, F.concat(F.lit("T"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("E"), F.col("l_suppkey").cast("string"), F.lit(":"), n.cast("string")))
    return s.select(kind.alias("kind"), F.when(on_table, "read").otherwise("call").alias("relation_type"), F.concat(F.lit("S"), F.col("a_supp").cast("string")).alias("subject_id"), target.alias("object_id"))


def _access_events(g: GraphTables):
    """Changed accesses of waiting lines."""
    s = g.chain(waiting=True).where("l_returnflag in ('R', 'A')")
    return s.select(
        (F.col("l_orderkey") * 100 + F.col("rn")).alias("event_id"), F.when(F.col("l_linestatus") == "F", "RELATION_DELETED").otherwise("RELATION_CREATED").alias("kind"), F.when(F.col("l_returnflag") == "R", "read").otherwise("write").alias("relation_type"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("subject_id"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("object_id"), (1 - F.col("l_tax")).alias("confidence"),
    )


def _incremental(old, events, level: str, build):
    """Edges before, touched services and edges after events on stored relations of the level's types."""
    events = stored(events, "events")
    new = changes.applied(old, changes.last_events(events))
    subjects = stored(rollup.services_at(rollup.affected_scope(events, new), level), "touched")
    before = build(old)
    return before, subjects, rollup.incremental(before, new, subjects, build)


def incremental_s2s(spark, sf_dir):
    """Old edges plus a batch of events, by rebuilding only what the events touch; the SQL recomputes everything."""
    g = GraphTables(spark, sf_dir, keep=True)
    objects = stored(called(g), "objects")
    return edge_columns(_incremental(stored(g.relations(*CALLS), "relations"), _events(g), "SERVICE_TO_SERVICE", lambda r: rollup.service_to_service(r, objects))[2])


def incremental_s2db(spark, sf_dir):
    g = GraphTables(spark, sf_dir, keep=True)
    objects = stored(of_types(g, "db_table"), "objects")
    return edge_columns(_incremental(stored(g.relations("read", "write"), "relations"), _access_events(g), "SERVICE_TO_DATABASE", lambda r: rollup.service_to_database(r, objects))[2])


def incremental_stats(spark, sf_dir):
    """Degrees after the events of incremental_s2s, from the degrees before and the edges of the touched services."""
    g = GraphTables(spark, sf_dir, keep=True)
    objects = stored(called(g), "objects")
    build = lambda r: rollup.service_to_service(r, objects)
    events, old = stored(_events(g), "events"), stored(g.relations(*CALLS), "relations")
    new = changes.applied(old, changes.last_events(events))
    subjects = stored(rollup.services_at(rollup.affected_scope(events, new), "SERVICE_TO_SERVICE"), "touched")
    before = stored(build(old), "edges")
    added = build(new.join(subjects, "subject_id", "left_semi"))
    return rollup.incremental_stats(rollup.graph_stats(before), before.join(subjects, "subject_id", "left_semi"), added)


def affected_scope(spark, sf_dir):
    g = GraphTables(spark, sf_dir, keep=True)
    return rollup.affected_scope(_mixed_events(g), g.relations())


EVENTS = """ev AS (SELECT l_orderkey * 100 + rn AS event_id, CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'C' END AS kind, 'S' || a_supp AS subject_id, 'E' || l_suppkey || ':' || l_linenumber AS object_id, 1 - l_discount AS confidence
  FROM waiting_steps WHERE l_linenumber <= 2),
last AS (SELECT subject_id, object_id, arg_max(kind, event_id) AS kind, arg_max(confidence, event_id) AS confidence FROM ev GROUP BY ALL),
after AS (SELECT relation_type, subject_id, object_id, confidence FROM relations r WHERE status = 'APPROVED' AND relation_type IN ('call', 'depend_on')
    AND NOT (relation_type = 'call' AND EXISTS (SELECT 1 FROM last l WHERE l.subject_id = r.subject_id AND l.object_id = r.object_id))
  UNION ALL SELECT 'call', subject_id, object_id, confidence FROM last WHERE kind = 'C')"""


def stream_s2s(spark, sf_dir):
    """The same change events, as a stream of files: each micro-batch rebuilds the edges of the services it touches."""
    g = GraphTables(spark, sf_dir, keep=True)
    base = fresh_path(spark, "stream")
    objects = stored(called(g), "objects")  # each batch meets them
    _events(g).repartitionByRange(3, "event_id").write.parquet(f"{base}/events")
    scope = lambda events, relations: rollup.services_at(rollup.affected_scope(events, relations), "SERVICE_TO_SERVICE")
    keeper = changes.RollupMaintainer(spark, stored(g.relations(*CALLS), "relations"), scope, lambda r: rollup.service_to_service(r, objects), f"{base}/state")
    source = spark.readStream.schema(changes.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
    keeper.start(source, f"{base}/checkpoint").awaitTermination()
    return edge_columns(keeper.edges())


def generation_log(spark, sf_dir):
    """Generations of a rollup, one for each month of orders: the newest is active, the others are archived."""
    g = GraphTables(spark, sf_dir)
    months = g.source("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("changes"))
    top = months.agg(F.max("month").alias("newest"))
    return months.join(F.broadcast(top)).select("month", "changes", F.when(F.col("month") == F.col("newest"), "ACTIVE").otherwise("ARCHIVED").alias("status"))  # one row


def rollup_rebuild_levels(spark, sf_dir):
    """A whole rebuild: edges and total weight of each level and relation type."""
    g = GraphTables(spark, sf_dir, keep=True)
    r, o = g.relations(), g.objects()
    out = None
    for level, df in (("SERVICE_TO_SERVICE", rollup.service_to_service(r, o)), ("SERVICE_TO_DATABASE", rollup.service_to_database(r, o)), ("SERVICE_TO_BROKER", rollup.service_to_broker(r, o))):
        part = df.groupBy("relation_type").agg(F.count(F.lit(1)).alias("edges"), F.sum("edge_weight").alias("total_weight")).withColumn("rollup_level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out.select("rollup_level", "relation_type", "edges", "total_weight")


def evidence_chain(spark, sf_dir):
    g = GraphTables(spark, sf_dir, keep=True)
    lifted = stored(rollup.service_calls(g.relations(*CALLS), called(g)), "lifted")
    return graph.evidence_chain(rollup.edges(lifted), rollup.provenance(lifted), g.evidences()).withColumn("confidence", r6(F.col("confidence"))).withColumn("score", r6(F.col("score")))


def evidence_top(spark, sf_dir):
    """The ten best items of evidence for the calls and dependencies of all services."""
    g = GraphTables(spark, sf_dir, keep=True)
    lifted = stored(rollup.service_calls(g.relations(*CALLS), called(g)), "lifted")
    items = graph.evidence_chain(rollup.edges(lifted), rollup.provenance(lifted), g.evidences()).withColumn("hop", F.lit(0))
    return graph.top_evidence(items).select("relation_type", "subject_id", "object_id", "edge_weight", "evidence_type", "evidence_id", r6(F.col("score")).alias("score"))


ENTRIES = {
    "evidence_top": (evidence_top, with_tables("""SELECT s.relation_type, s.subject_id, s.object_id, s.edge_weight, coalesce(evidence_type, 'rollup') AS evidence_type, coalesce(e.id, '') AS evidence_id, round(s.confidence * s.edge_weight, 6) AS score
        FROM s2s s LEFT JOIN (SELECT DISTINCT l.relation_type, l.subject_id, l.object_id, e.id, e.evidence_type FROM lifted l JOIN evidences e ON e.relation_id = l.id) e
        ON s.relation_type = e.relation_type AND s.subject_id = e.subject_id AND s.object_id = e.object_id ORDER BY round(s.confidence * s.edge_weight, 9) DESC, s.edge_weight DESC, s.confidence DESC, 6, 2, 3, 1 LIMIT 10""", LIFT)),
    "rollup_s2s": (rollup_s2s, with_tables("SELECT relation_type, subject_id, object_id, edge_weight, confidence6 AS confidence FROM s2s")),
    "rollup_s2db": (rollup_s2db, with_tables(PARENT.format("'read', 'write'"))),
    "rollup_s2broker": (rollup_s2broker, with_tables(PARENT.format("'produce', 'consume'"))),
    "rollup_d2d": (rollup_d2d, with_tables("""SELECT from_domain, to_domain, CAST(floor(sum(k) + 0.5) AS BIGINT) AS edge_weight, round(sum(k), 6) AS weight, round(sum(confidence * k) / sum(k), 6) AS confidence FROM (
        SELECT x.domain_id AS from_domain, y.domain_id AS to_domain, confidence, edge_weight * x.affinity * y.affinity AS k FROM s2s
        JOIN affinities x ON x.object_id = subject_id AND x.affinity >= 0.2 JOIN affinities y ON y.object_id = s2s.object_id AND y.affinity >= 0.2 WHERE relation_type = 'call') GROUP BY ALL""")),
    "graph_stats": (graph_stats, with_tables("SELECT object_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT subject_id AS object_id, 1 AS o, 0 AS i FROM s2s UNION ALL SELECT object_id, 0, 1 FROM s2s) GROUP BY 1")),
    "hubs": (hubs, with_tables("SELECT object_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT subject_id AS object_id, 1 AS o, 0 AS i FROM s2s UNION ALL SELECT object_id, 0, 1 FROM s2s) GROUP BY 1 HAVING sum(i) >= 5")),
    "rollup_provenance": (rollup_provenance, with_tables("SELECT DISTINCT relation_type, subject_id, object_id, id AS base_relation_id FROM lifted", LIFT)),
    "incremental_s2s": (incremental_s2s, with_tables("""SELECT relation_type, subject_id, target AS object_id, count(*) AS edge_weight, """ + AVG6 + """ AS confidence FROM (
        SELECT a.*, CASE WHEN relation_type = 'depend_on' OR granularity = 'COMPOUND' THEN object_id ELSE parent_id END AS target FROM after a JOIN objects o ON a.object_id = o.id) WHERE target <> subject_id GROUP BY ALL""", EVENTS)),
    "stream_s2s": (stream_s2s, with_tables("""SELECT relation_type, subject_id, target AS object_id, count(*) AS edge_weight, """ + AVG6 + """ AS confidence FROM (
        SELECT a.*, CASE WHEN relation_type = 'depend_on' OR granularity = 'COMPOUND' THEN object_id ELSE parent_id END AS target FROM after a JOIN objects o ON a.object_id = o.id) WHERE target <> subject_id GROUP BY ALL""", EVENTS)),
    "generation_log": (generation_log, "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS changes FROM orders GROUP BY 1) SELECT month, changes, CASE WHEN month = (SELECT max(month) FROM m) THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status FROM m"),
    "incremental_s2db": (incremental_s2db, with_tables("""SELECT relation_type, subject_id, parent_id AS object_id, count(*) AS edge_weight, """ + AVG6 + """ AS confidence FROM (
        SELECT relation_type, subject_id, object_id, confidence FROM relations r WHERE relation_type IN ('read', 'write') AND NOT EXISTS (SELECT 1 FROM last l WHERE l.relation_type = r.relation_type AND l.subject_id = r.subject_id AND l.object_id = r.object_id)
        UNION ALL SELECT relation_type, subject_id, object_id, confidence FROM last WHERE status = 'O') a JOIN objects o ON a.object_id = o.id GROUP BY ALL""",
        """last AS (SELECT relation_type, subject_id, object_id, arg_max(confidence, e) AS confidence, arg_max(l_linestatus, e) AS status FROM (SELECT l_orderkey * 100 + rn AS e, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'read' ELSE 'write' END AS relation_type,
          'S' || l_suppkey AS subject_id, 'T' || l_partkey AS object_id, 1 - l_tax AS confidence FROM waiting WHERE l_returnflag IN ('R', 'A')) GROUP BY ALL)""")),
    "incremental_stats": (incremental_stats, with_tables("""SELECT object_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT subject_id AS object_id, 1 AS o, 0 AS i FROM edge UNION ALL SELECT target, 0, 1 FROM edge) GROUP BY 1""", EVENTS,
        """edge AS (SELECT DISTINCT relation_type, subject_id, target FROM (SELECT a.*, CASE WHEN relation_type = 'depend_on' OR granularity = 'COMPOUND' THEN object_id ELSE parent_id END AS target FROM after a JOIN objects o ON a.object_id = o.id) WHERE target <> subject_id)""")),
    "affected_scope": (affected_scope, with_tables("""SELECT level, service_id FROM scope UNION SELECT 'DOMAIN_TO_DOMAIN', NULL WHERE EXISTS (SELECT 1 FROM scope WHERE level = 'SERVICE_TO_SERVICE') OR EXISTS (SELECT 1 FROM waiting_steps WHERE l_linenumber = 5)""",
        """lv(t, level) AS (VALUES ('call', 'SERVICE_TO_SERVICE'), ('depend_on', 'SERVICE_TO_SERVICE'), ('read', 'SERVICE_TO_DATABASE'), ('write', 'SERVICE_TO_DATABASE'), ('produce', 'SERVICE_TO_BROKER'), ('consume', 'SERVICE_TO_BROKER'))""",
        """scope AS (SELECT CASE WHEN l_linenumber = 6 THEN 'SERVICE_TO_DATABASE' ELSE 'SERVICE_TO_SERVICE' END AS level, 'S' || a_supp AS service_id FROM waiting_steps WHERE l_linenumber NOT IN (4, 5)
          UNION SELECT level, subject_id FROM relations JOIN lv ON t = relation_type WHERE status = 'APPROVED' AND object_id IN (SELECT 'T' || l_partkey FROM waiting_steps WHERE l_linenumber = 4)
          UNION SELECT 'SERVICE_TO_SERVICE', subject_id FROM relations WHERE status = 'APPROVED' AND relation_type = 'call' AND object_id IN (SELECT 'E' || l_suppkey || ':' || l_linenumber FROM waiting_steps WHERE l_linenumber = 3))""")),
    "rollup_rebuild_levels": (rollup_rebuild_levels, with_tables("""SELECT 'SERVICE_TO_SERVICE' AS rollup_level, relation_type, count(*) AS edges, CAST(sum(edge_weight) AS BIGINT) AS total_weight FROM s2s GROUP BY 2
        UNION ALL SELECT CASE WHEN relation_type IN ('read', 'write') THEN 'SERVICE_TO_DATABASE' ELSE 'SERVICE_TO_BROKER' END, relation_type, count(*), CAST(sum(n) AS BIGINT) FROM (
          SELECT relation_type, subject_id, parent_id, count(*) AS n FROM relations r JOIN objects o ON r.object_id = o.id WHERE relation_type IN ('read', 'write', 'produce', 'consume') GROUP BY ALL) GROUP BY 1, 2""")),
    "evidence_chain": (evidence_chain, with_tables("""SELECT s.relation_type, s.subject_id, s.object_id, s.edge_weight, s.confidence6 AS confidence, coalesce(evidence_type, 'rollup') AS evidence_type, coalesce(e.id, '') AS evidence_id, round(s.confidence * s.edge_weight, 6) AS score
        FROM s2s s LEFT JOIN (SELECT DISTINCT l.relation_type, l.subject_id, l.object_id, e.id, e.evidence_type FROM lifted l JOIN evidences e ON e.relation_id = l.id) e
        ON s.relation_type = e.relation_type AND s.subject_id = e.subject_id AND s.object_id = e.object_id""", LIFT)),
}
