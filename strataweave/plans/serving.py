"""Queries on generations, dispatch, contributors of many requests, related objects and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions.scalars import cursor, r6
from strataweave.operators import drilldown, generations, rollup
from strataweave.operators.generations import Generations, Request
from strataweave.plans.rollups import AVG6, EVENTS, _events, edge_columns, of_types
from strataweave.sources.graph_tables import GraphTables, avg6_sql, with_tables
from strataweave.sources.scratch import fresh_path, stored
from strataweave.streaming import changes


def _built(spark, g: GraphTables) -> tuple[Generations, object]:
    """Two generations: from the base relations, then, by upkeep, after the change events; a third is being built."""
    store = Generations(spark, fresh_path(spark, "generations"))
    objects, old = stored(g.objects(), "objects"), stored(g.relations(), "relations")
    store.rebuild(generations.base_levels(old, objects), mode="rebuild", events=0)
    events = stored(_events(g), "events")
    new = changes.applied(old, changes.last_events(events))
    touched = stored(rollup.services_at(rollup.affected_scope(events, new), "SERVICE_TO_SERVICE"), "touched")
    before = store.edges("SERVICE_TO_SERVICE")
    kept = {level: (lambda level=level: store.edges(level, 1)) for level in generations.LEVEL_ORDER[1:]}
    store.rebuild({"SERVICE_TO_SERVICE": lambda: rollup.incremental(before, new, touched, lambda r: rollup.service_to_service(r, objects))} | kept, mode="upkeep", events=1)
    store.create()
    store.add_meta(9, lost="yes")
    return store, old


def generation_levels(spark, sf_dir):
    """Each generation with its state, what was noted on it, and its edges a level."""
    store, _ = _built(spark, GraphTables(spark, sf_dir, keep=True))
    state = store.state()
    rows = None
    for version in (1, 2):
        for level in generations.LEVEL_ORDER:
            one = store.edges(level, version).agg(F.count(F.lit(1)).alias("edges"), F.sum("edge_weight").alias("weight")).select(F.lit(version).cast("long").alias("version"), F.lit(level).alias("level"), "edges", "weight")
            rows = one if rows is None else rows.unionByName(one)
    return state.join(rows, "version", "left").select("version", "status", F.col("meta")["mode"].alias("mode"), "level", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("weight", F.lit(0)).alias("weight"))


def dispatched(spark, sf_dir):
    """The same requests on the first generation and on the active one: impact, usage and a domain, with the generation that answered."""
    g = GraphTables(spark, sf_dir, keep=True)
    store, relations = _built(spark, g)
    out = None
    for version in (1, None):
        for kind, params in (("IMPACT_ANALYSIS", {"object_id": "S1", "max_depth": 1}), ("USAGE_DISCOVERY", {"object_id": "S2"}), ("DOMAIN_SUMMARY", {"domain_id": "D1"}), ("UNKNOWN", {})):
            used, result = generations.execute(store, Request(kind, generation=version, params=params), relations, g.affinities())
            n = F.sum("members") if kind == "DOMAIN_SUMMARY" else F.count(F.lit(1))
            one = result.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit(used).cast("long").alias("generation"), F.lit(kind).alias("query_type"), "n")
            out = one if out is None else out.unionByName(one)
    return out


def _message_events(g: GraphTables):
    """Changed messages of services: an event with an even number ends one of its user's uses of the topic, another starts one an hour later."""
    e = g.source("events").join(g.source("supplier").select(F.col("s_suppkey").alias("user_id")), "user_id", "left_semi").where("value >= 20")
    gone = F.col("event_id") % 2 == 0
    return e.select(
        "event_id", F.when(gone, "RELATION_DELETED").otherwise("RELATION_CREATED").alias("kind"), F.when(F.col("event_type").isin("purchase", "signup"), "produce").otherwise("consume").alias("relation_type"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("subject_id"), F.concat(F.lit("TP"), "event_type", F.lit(":"), ((F.hour("ts") + F.when(gone, 0).otherwise(1)) % 24).cast("string")).alias("object_id"), F.lit(0.75).alias("confidence"),
    )


def incremental_s2broker(spark, sf_dir):
    """Broker edges after changed messages, by building only the services that they touch; the SQL builds all."""
    g = GraphTables(spark, sf_dir)
    topics = stored(of_types(g, "topic"), "topics")
    build = lambda r: rollup.service_to_broker(r, topics)
    old, events = stored(g.relations().where("relation_type in ('produce', 'consume')"), "relations"), stored(_message_events(g), "events")
    new = changes.applied(old, changes.last_events(events))
    subjects = stored(rollup.services_at(rollup.affected_scope(events, new), "SERVICE_TO_BROKER"), "touched")
    return edge_columns(rollup.incremental(stored(build(old), "edges"), new, subjects, build))


def contributor_pages(spark, sf_dir):
    """A request for each service: what leads from it (or from anywhere) into the next service, a database, a broker or a domain, in four groupings, with pages of several sizes."""
    g = GraphTables(spark, sf_dir)
    k = F.col("s_suppkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    target = F.when(k % 4 == 0, text("D", k % 5)).when(k % 4 == 1, text("DBBrand#", k % 25 + 1)).when(k % 4 == 2, "BRclick").otherwise(text("S", k + 1))
    requests = g.source("supplier").select(
        k.alias("request_id"), text("S", k).alias("source_id"), target.alias("target_id"), F.element_at(F.array(*map(F.lit, ("relationType", "sourceAtomic", "targetAtomic", "targetCompound"))), (k % 4 + 1).cast("int")).alias("group_by"),
        F.when(k % 3 == 0, "GLOBAL").otherwise("SUBTREE").alias("scope_mode"), F.when(k % 7 == 0, F.array(F.lit("call"), F.lit("read"))).alias("relation_types"), F.when(k % 5 == 0, F.array(F.lit("depend_on"))).alias("excluded_types"),
        F.when(k % 8 == 0, 0.5).alias("threshold"), F.when(k % 6 != 5, (k % 6).cast("int")).alias("page_size"), F.when(k % 5 == 3, cursor(F.lit(2))).when(k % 5 == 4, "?").alias("cursor"),
    )
    return drilldown.contributors(requests, g.relations(), g.objects(), g.affinities(), g.evidences())


def related_objects(spark, sf_dir):
    """How often each object stands at either end of each type of relation, and the names of the first and last object at the other end."""
    g = GraphTables(spark, sf_dir)
    rows = drilldown.related(g.relations(), g.objects())
    return rows.groupBy("id", "direction", "relation_type").agg(F.count(F.lit(1)).alias("n"), F.min("other_label").alias("first_label"), F.max("other_label").alias("last_label"))


def object_search_many(spark, sf_dir):
    """Names of parts, of suppliers in small letters, parts of names and unknown names, each looked up among all objects or those of a type."""
    g = GraphTables(spark, sf_dir)
    k = F.col("p_partkey")
    asked = g.source("part").select(
        k.alias("request_id"), F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat(F.lit("supplier#"), F.lpad((k % 90).cast("string"), 9, "0"))).when(k % 4 == 2, F.concat(F.lit("NO_"), k.cast("string"), F.lit("%"))).otherwise(F.substring("p_name", 2, 6)).alias("text"),
        F.when(k % 3 == 0, "db_table").when(k % 3 == 1, "service").alias("object_type"),
    )
    return drilldown.find_objects(g.objects(), asked)


S2S2 = """after2 AS (SELECT relation_type, subject_id, target AS object_id, count(*) AS edge_weight FROM (
  SELECT a.*, CASE WHEN relation_type = 'depend_on' OR granularity = 'COMPOUND' THEN object_id ELSE parent_id END AS target FROM after a JOIN objects o ON a.object_id = o.id) WHERE target <> subject_id GROUP BY ALL)"""
PARENTS = """par AS (SELECT CASE WHEN relation_type IN ('read', 'write') THEN 'SERVICE_TO_DATABASE' ELSE 'SERVICE_TO_BROKER' END AS level, relation_type, subject_id, parent_id, count(*) AS n FROM relations r JOIN objects o ON r.object_id = o.id WHERE status = 'APPROVED' AND relation_type IN ('read', 'write', 'produce', 'consume') GROUP BY ALL)"""
USED = "SELECT {0} AS generation, 'IMPACT_ANALYSIS' AS query_type, 1 + (SELECT count(DISTINCT object_id) FROM {1} WHERE subject_id = 'S1') AS n UNION ALL SELECT {0}, 'USAGE_DISCOVERY', (SELECT count(*) FROM {1} WHERE object_id = 'S2') + (SELECT count(*) FROM relations WHERE object_id = 'S2') UNION ALL SELECT {0}, 'DOMAIN_SUMMARY', (SELECT count(*) FROM affinities WHERE domain_id = 'D1') UNION ALL SELECT {0}, 'UNKNOWN', 0"

ENTRIES = {
    "generation_levels": (generation_levels, with_tables("""SELECT v AS version, st AS status, mode, level, edges, CAST(weight AS BIGINT) AS weight FROM (VALUES (1::BIGINT, 'ARCHIVED', 'rebuild'), (2, 'ACTIVE', 'upkeep')) g(v, st, mode) JOIN (
          SELECT 1 AS w, 'SERVICE_TO_SERVICE' AS level, count(*) AS edges, sum(edge_weight) AS weight FROM s2s UNION ALL SELECT 2, 'SERVICE_TO_SERVICE', count(*), sum(edge_weight) FROM after2
          UNION ALL SELECT 1, level, count(*), sum(n) FROM par GROUP BY level UNION ALL SELECT 2, level, count(*), sum(n) FROM par GROUP BY level) ON w = v
        UNION ALL SELECT 3, 'BUILDING', NULL, NULL, 0, 0""", EVENTS, S2S2, PARENTS)),
    "dispatched": (dispatched, with_tables(f"SELECT generation::BIGINT AS generation, query_type, n FROM ({USED.format(1, 's2s')} UNION ALL {USED.format(2, 'after2')})", EVENTS, S2S2)),
    "incremental_s2broker": (incremental_s2broker, with_tables("SELECT relation_type, subject_id, parent_id AS object_id, count(*) AS edge_weight, " + AVG6 + """ AS confidence FROM (
          SELECT relation_type, subject_id, object_id, confidence FROM relations r WHERE relation_type IN ('produce', 'consume') AND NOT EXISTS (SELECT 1 FROM lm WHERE lm.relation_type = r.relation_type AND lm.subject_id = r.subject_id AND lm.object_id = r.object_id)
          UNION ALL SELECT relation_type, subject_id, object_id, 0.75 FROM lm WHERE NOT gone) a JOIN objects o ON a.object_id = o.id GROUP BY ALL""",
        """lm AS (SELECT relation_type, subject_id, object_id, arg_max(gone, event_id) AS gone FROM (SELECT event_id, event_id % 2 = 0 AS gone, CASE WHEN event_type IN ('purchase', 'signup') THEN 'produce' ELSE 'consume' END AS relation_type, 'S' || user_id AS subject_id,
          'TP' || event_type || ':' || ((hour(ts) + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END) % 24) AS object_id FROM events WHERE value >= 20 AND user_id IN (SELECT s_suppkey FROM supplier)) GROUP BY 1, 2, 3)""")),
    "contributor_pages": (contributor_pages, with_tables("""SELECT k AS request_id, CAST(place AS BIGINT) AS place, group_key, group_label, weight, evidence_count, total, CASE WHEN off + size < n THEN rtrim(replace(replace(to_base64(encode(CAST(off + size AS VARCHAR))), '+', '-'), '/', '_'), '=') END AS next_cursor FROM (
          SELECT k, off, size, key AS group_key, CASE WHEN k % 4 = 0 THEN key ELSE coalesce(o.name, key) END AS group_label, weight, CAST(ec AS BIGINT) AS evidence_count, CAST(sum(weight) OVER (PARTITION BY k) AS BIGINT) AS total, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY weight DESC, key) AS place
          FROM gr LEFT JOIN objects o ON o.id = key) WHERE place > off AND place <= off + size""",
        """rq AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS src, CASE s_suppkey % 4 WHEN 0 THEN 'D' || (s_suppkey % 5) WHEN 1 THEN 'DBBrand#' || (s_suppkey % 25 + 1) WHEN 2 THEN 'BRclick' ELSE 'S' || (s_suppkey + 1) END AS tgt, greatest(1, CASE WHEN s_suppkey % 6 = 5 THEN 20 ELSE s_suppkey % 6 END) AS size, CASE WHEN s_suppkey % 5 = 3 THEN 2 ELSE 0 END AS off, CASE WHEN s_suppkey % 8 = 0 THEN 0.5 ELSE 0.2 END AS th FROM supplier)""",
        """ts AS (SELECT k, id FROM rq JOIN objects o ON tgt[1] <> 'D' OR tgt[1:2] = 'DB' WHERE id = tgt OR path LIKE '/' || tgt || '/%' UNION SELECT k, o.id FROM rq JOIN affinities a ON a.domain_id = tgt AND a.affinity >= th JOIN objects o ON o.id = a.object_id OR o.path LIKE '/' || a.object_id || '/%' UNION SELECT k, tgt FROM rq)""",
        "ec AS (SELECT relation_id, count(DISTINCT id) AS c FROM evidences GROUP BY 1)",
        """gr AS (SELECT rq.k, off, size, CASE rq.k % 4 WHEN 0 THEN relation_type WHEN 1 THEN subject_id WHEN 2 THEN r.object_id ELSE coalesce(string_split(ob.path, '/')[2], r.object_id) END AS key, count(*) AS weight, coalesce(sum(c), 0) AS ec
          FROM ts JOIN relations r ON r.object_id = ts.id AND status = 'APPROVED' JOIN rq ON rq.k = ts.k LEFT JOIN objects ob ON ob.id = r.object_id LEFT JOIN ec ON ec.relation_id = r.id
          WHERE (rq.k % 3 = 0 OR subject_id = src) AND relation_type <> CASE WHEN rq.k % 5 = 0 THEN 'depend_on' ELSE 'expose' END AND (rq.k % 7 <> 0 OR relation_type IN ('call', 'read')) GROUP BY 1, 2, 3, 4)""")),
    "related_objects": (related_objects, with_tables("""SELECT x.id, direction, relation_type, count(*) AS n, min(coalesce(o.name, other)) AS first_label, max(coalesce(o.name, other)) AS last_label FROM (SELECT subject_id AS id, 'OUTBOUND' AS direction, relation_type, object_id AS other FROM relations UNION ALL SELECT object_id, 'INBOUND', relation_type, subject_id FROM relations) x LEFT JOIN objects o ON o.id = other GROUP BY 1, 2, 3""")),
    "object_search_many": (object_search_many, with_tables("""SELECT k AS request_id, coalesce(arg_min(o.id, (lower(name) <> t, name, o.id)) FILTER (WHERE contains(lower(name), t)), arg_min(o.id, (name, o.id))) AS object_id, CASE WHEN count(*) FILTER (WHERE contains(lower(name), t)) = 0 THEN 'first' WHEN count(*) FILTER (WHERE lower(name) = t) > 0 THEN 'exact' ELSE 'part' END AS match, count(*) FILTER (WHERE contains(lower(name), t)) AS n
        FROM ask JOIN objects o ON ty IS NULL OR o.object_type = ty GROUP BY 1""",
        """ask AS (SELECT p_partkey AS k, lower(trim(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'supplier#' || lpad(CAST(p_partkey % 90 AS VARCHAR), 9, '0') WHEN 2 THEN 'NO_' || p_partkey || '%' ELSE substr(p_name, 2, 6) END)) AS t, CASE p_partkey % 3 WHEN 0 THEN 'db_table' WHEN 1 THEN 'service' END AS ty FROM part)""")),
}
