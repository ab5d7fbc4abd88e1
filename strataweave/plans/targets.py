"""Queries on what candidates, schemas and gateway rules mean, and on lists and cursors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataweave.functions.scalars import NAME_SUFFIXES, clamp, name_tokens, r6
from strataweave.operators import signals, targets
from strataweave.plans import domains, proofs, reports, rollups
from strataweave.sources.graph_tables import LINE_ORDER, GraphTables, with_tables
from strataweave.sources.scratch import stored

SUFFIXES = ", ".join(f"'{x}'" for x in NAME_SUFFIXES)


def _laid(g: GraphTables):
    endpoints = g.objects().where("object_type = 'api_endpoint'")
    return targets.on_endpoints(g.candidates(), endpoints, g.relations().where("relation_type = 'call'"))


def endpoint_candidates(spark, sf_dir):
    """Service candidates as candidates for the endpoints that their subject does not call yet."""
    return _laid(GraphTables(spark, sf_dir)).withColumn("confidence", r6(F.col("confidence")))


def candidate_details(spark, sf_dir):
    """All candidates, for services and their endpoints, without those for services, by name."""
    g = GraphTables(spark, sf_dir)
    both = g.candidates().select("subject_id", "object_id", "confidence").unionByName(_laid(g).select("subject_id", "object_id", "confidence"))
    out = targets.visible(both, stored(g.objects(), "objects"))
    return out.select("subject_name", "object_name", "parent_name", r6(F.col("confidence")).alias("confidence"))


def call_artifacts(spark, sf_dir):
    """Each call with the endpoint it goes to and its evidence, if any."""
    g = GraphTables(spark, sf_dir)
    calls = g.relations().where("relation_type = 'call'").select(F.col("id").alias("relation_id"), "subject_id", "object_id")
    endpoints = g.objects().where("object_type = 'api_endpoint'").select(F.col("id").alias("object_id"), F.col("name").alias("artifact"), F.col("parent_id").alias("service_id"))
    evidence = g.evidences().select("relation_id", F.col("id").alias("evidence_id"), "evidence_type")
    return calls.join(endpoints, "object_id").join(evidence, "relation_id", "left").select("relation_id", "subject_id", "service_id", "artifact", "evidence_id", "evidence_type")


def twin_tables(spark, sf_dir):
    """Parts as tables of their brand's database: small ones without a schema, others in their type's; the largest were rejected."""
    p = GraphTables(spark, sf_dir).source("part").select(F.col("p_brand").alias("database"), F.col("p_name").alias("name"), F.col("p_type").alias("schema"), "p_size")
    return targets.twin_tables(p.where("p_size <= 25"), p.where("p_size > 25"), p.where("p_size = 50"))


def schema_changes(spark, sf_dir):
    """Databases whose set of table names changed with the largest parts; their new hash."""
    p = GraphTables(spark, sf_dir).source("part").select(F.col("p_brand").alias("database"), F.concat_ws(" ", "p_type", "p_name").alias("name"), "p_size")
    return targets.schema_hashes(p).join(targets.schema_hashes(p.where("p_size <= 45")).select("database", "schema_hash"), ["database", "schema_hash"], "left_anti")


def affinity_weights(spark, sf_dir):
    """Tables and topics against each token of their names, by the weights of their kind."""
    o = GraphTables(spark, sf_dir).objects().where("object_type in ('db_table', 'topic')").select("id", "object_type", name_tokens(F.col("name")).alias("tokens"))
    rows = o.select("id", "object_type", F.explode("tokens").alias("slug"), F.size("tokens").alias("n"))
    table = F.col("object_type") == "db_table"
    score = targets.weighted_affinity(table, name=1 / F.col("n"), table=table, topic=~table)
    return rows.select(F.col("id").alias("object_id"), "slug", r6(score).alias("affinity"))


def prior_confidence(spark, sf_dir):
    """Confidence before validation, as an event's properties hold it in percent, else from its value; 0 to 1."""
    e = GraphTables(spark, sf_dir).source("events")
    held = F.get_json_object("props", "$.k").cast("double") / 100
    return e.select("event_id", r6(clamp(F.coalesce(F.when(held <= 0.5, held), F.col("value") / 1000, F.lit(0.0)), 0.0, 1.0)).alias("confidence"))


def route_transforms(spark, sf_dir):
    """Gateway rules from the pages' paths, with the segments they take off; obsolete where no page of https has the rule."""
    p = GraphTables(spark, sf_dir).source("pages")
    rules = p.select(F.regexp_replace(proofs.url_path(F.col("url")), "/[0-9]+$", "/**").alias("match_path"), F.col("url").startswith("https://").alias("live"))
    out = rules.groupBy("match_path").agg((~F.bool_or("live")).alias("obsolete"))
    return out.select("match_path", F.sha2("match_path", 256).alias("source_hash"), targets.strip_count(F.col("match_path")).cast("long").alias("strip"), "obsolete")


def endpoint_intents(spark, sf_dir):
    """Inbound intents of endpoints from their path, or from a label 'METHOD /path'."""
    e = proofs.endpoint_rows(GraphTables(spark, sf_dir))
    path = targets.endpoint_path(F.when(F.col("endpoint_method") == "ANY", F.col("endpoint_path")), F.concat_ws(" ", "endpoint_method", "endpoint_path"))
    return e.select(F.col("endpoint_id").alias("source_id"), path.alias("path_hint")).where("path_hint is not null")


def run_list(spark, sf_dir):
    """The newest orders as runs: twenty, unless another number up to a hundred is asked for."""
    return GraphTables(spark, sf_dir).source("orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(targets.page_size(None)).select("o_orderkey", "o_orderstatus")


def change_cursor(spark, sf_dir):
    """Where a reader of changes stands: how many generations there are, the active one, and the newest event."""
    log = rollups.generation_log(spark, sf_dir)
    top = log.agg(F.count(F.lit(1)).alias("generation"), F.max(F.when(F.col("status") == "ACTIVE", F.col("month"))).alias("built"))
    newest = GraphTables(spark, sf_dir).source("events").agg(F.max("event_id").alias("token"))
    return top.join(F.broadcast(newest))  # one row each


def selected_scope(spark, sf_dir):
    """Relations with both ends in the scope of the selected services."""
    ends = stored(reports.scope_closure(spark, sf_dir), "scope")
    r = GraphTables(spark, sf_dir).relations()
    r = r.join(ends.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").join(ends.select(F.col("id").alias("object_id")), "object_id", "left_semi")
    return r.select("id", "relation_type", "subject_id", "object_id")


def export_domains(spark, sf_dir):
    """A JSON text a domain: its name, how many members it has, and the five that belong to it most."""
    top = domains.domain_top_members(spark, sf_dir).groupBy("domain_id").agg(F.array_sort(F.collect_list(F.struct("place", "object_id"))).alias("t"))  # five a domain
    rows = domains.domain_list(spark, sf_dir).join(top, "domain_id", "left")
    return rows.select("domain_id", F.to_json(F.struct(F.col("domain_id").alias("domain"), "name", "members", F.col("t.object_id").alias("top"))).alias("json"))


def config_keys(spark, sf_dir):
    """The keys 'brand.name' of parts that answer part names, brands, those keys of the largest parts, and nations."""
    g = GraphTables(spark, sf_dir)
    p = g.source("part")
    keys = p.select(F.concat_ws(".", "p_brand", "p_name").alias("key"))
    asked = p.select(F.explode(F.array("p_name", "p_brand", F.when(F.col("p_size") == 50, F.concat_ws(".", "p_brand", "p_name")))).alias("key")).union(g.source("nation").select("n_name"))
    return targets.key_matches(asked, keys).withColumn("score", r6(F.col("score")))


def db_contradictions(spark, sf_dir):
    """Accesses whose part is not the one of the line before in its order, with the reasons."""
    g = GraphTables(spark, sf_dir)
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = g.source("lineitem").select("*", F.row_number().over(w).alias("rn"), F.lag("l_partkey").over(w).alias("before"))
    named = lambda key, p: g.source("part").select(F.col("p_partkey").alias(key), F.col("p_type").alias(f"{p}_schema"), F.col("p_name").alias(f"{p}_table"))
    rows = lines.join(named("l_partkey", "own"), "l_partkey").join(named("before", "past"), "before", "left")
    side = lambda p: (F.col(f"{p}_schema"), F.col(f"{p}_table"))
    none = (F.lit(None).cast("string"), F.lit(None).cast("string"))
    reasons = targets.db_contradictions(side("past"), side("own"), none, F.col("l_returnflag") == "N", F.col("l_quantity") >= 45)
    return rows.select("l_orderkey", F.col("rn").cast("long").alias("rn"), F.array_join(reasons, ",").alias("reasons"))


def page_completeness(spark, sf_dir):
    """Pages as functions: an outbound call of their address, and a database section where they hold a table; long ones are cut, those with a script not understood."""
    p = GraphTables(spark, sf_dir).source("pages").select("page_id", proofs.url_path(F.col("url")).alias("path"), proofs.url_host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    http = targets.section_completeness(F.length("html") >= 1500, F.col("path") != "/", F.col("host") != "", F.col("path").rlike("[0-9]"), F.col("host").startswith("m."))
    db = F.when(F.contains("html", F.lit("<table")), targets.section_completeness(F.lit(False), F.lit(True), F.lit(False)))
    return p.select("page_id", targets.summary_completeness([http, db], F.length("html") > 5000, F.contains("html", F.lit("<script"))).alias("completeness"))


def link_endpoints(spark, sf_dir):
    """Hosts and paths that pages link to, resolved to the page that alone serves them, or else to the host."""
    p = GraphTables(spark, sf_dir).source("pages")
    served = p.select(proofs.url_host(F.col("url")).alias("service_id"), proofs.url_path(F.col("url")).alias("path"), F.col("page_id").alias("endpoint_id"))
    return targets.http_targets(proofs.page_links(spark, sf_dir).select("host", "path", "n"), served)


def intent_upkeep(spark, sf_dir):
    """Intents of links, by their page's host: what an extraction over longer pages keeps of one over pages with a script."""
    p = GraphTables(spark, sf_dir).source("pages")

    def found(pages):
        links = signals.page_links(pages).select("page_id", "link_host", "path")
        own = pages.select("page_id", proofs.url_host(F.col("url")).alias("owner"))
        return targets.intent_hashes(links.join(own, "page_id"), ["owner"], ["link_host", "path"])

    return targets.retired(found(p.where("length(html) >= 1500")), found(p.where("contains(html, '<script')")))


LAID = """laid AS (SELECT c.subject_id, o.id AS object_id, c.object_id AS service_id, greatest(max(c.confidence) * 0.85::DOUBLE, 0.5::DOUBLE) AS confidence FROM candidates c JOIN objects o ON o.parent_id = c.object_id AND o.object_type = 'api_endpoint'
  WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.relation_type = 'call' AND r.subject_id = c.subject_id AND r.object_id = o.id) GROUP BY ALL)"""

ENTRIES = {
    "endpoint_candidates": (endpoint_candidates, with_tables("SELECT subject_id, object_id, service_id, round(confidence, 6) AS confidence FROM laid", LAID)),
    "candidate_details": (candidate_details, with_tables("""SELECT s.name AS subject_name, t.name AS object_name, p.name AS parent_name, round(l.confidence, 6) AS confidence
        FROM laid l LEFT JOIN objects s ON s.id = l.subject_id LEFT JOIN objects t ON t.id = l.object_id LEFT JOIN objects p ON p.id = t.parent_id""", LAID)),
    "call_artifacts": (call_artifacts, with_tables("""SELECT r.id AS relation_id, r.subject_id, o.parent_id AS service_id, o.name AS artifact, e.id AS evidence_id, e.evidence_type
        FROM relations r JOIN objects o ON o.id = r.object_id AND o.object_type = 'api_endpoint' LEFT JOIN evidences e ON e.relation_id = r.id WHERE r.relation_type = 'call'""")),
    "twin_tables": (twin_tables, """WITH u AS (SELECT DISTINCT p_brand AS b, p_name AS n FROM part WHERE p_size <= 25), q AS (SELECT DISTINCT p_brand AS b, p_name AS n, p_type AS s FROM part WHERE p_size > 25),
        m AS (SELECT *, count(*) OVER (PARTITION BY b, n) AS k FROM u JOIN q USING (b, n))
        SELECT b AS database, n AS name, s AS schema, CASE WHEN k = 1 THEN 0.65 ELSE 0.4 END::DOUBLE AS confidence FROM m WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size = 50 AND p_brand = b AND p_name = n AND p_type = s)"""),
    "schema_changes": (schema_changes, """WITH n AS (SELECT p_brand AS b, lower(p_type || ' ' || p_name) AS n, min(p_size) AS z FROM part GROUP BY ALL),
        x AS (SELECT b, z, ('0x' || substr(sha256(n), 1, 15))::BIGINT AS v FROM n),
        h AS (SELECT b, count(*) AS tables, bit_xor(v) AS v, count(*) FILTER (WHERE z <= 45) AS c0 FROM x GROUP BY 1)
        SELECT b AS database, tables, sha256(b || '|' || tables || '|' || v) AS schema_hash FROM h WHERE c0 < tables"""),
    "affinity_weights": (affinity_weights, with_tables(f"""SELECT id AS object_id, unnest(t) AS slug, round(least(1.0::DOUBLE, 0.15::DOUBLE / len(t) + CASE k WHEN 'db_table' THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END), 6) AS affinity FROM (
        SELECT id, object_type AS k, list_distinct(list_filter(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: len(x) >= 2 AND x NOT IN ({SUFFIXES}))) AS t FROM objects WHERE object_type IN ('db_table', 'topic'))""")),
    "prior_confidence": (prior_confidence, """SELECT event_id, round(least(greatest(coalesce(CASE WHEN k <= 0.5::DOUBLE THEN k END, value::DOUBLE / 1000, 0), 0), 1), 6)::DOUBLE AS confidence FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE / 100 AS k FROM events)"""),
    "route_transforms": (route_transforms, f"""WITH {proofs.URLS}, r AS (SELECT regexp_replace(path, '/[0-9]+$', '/**') AS m, starts_with(url, 'https://') AS live FROM u JOIN pages USING (page_id)),
        g AS (SELECT m, NOT bool_or(live) AS obsolete, len(list_filter(string_split(trim(m), '/'), lambda s: s <> '' AND NOT contains(s, '*'))) AS f FROM r GROUP BY 1)
        SELECT m AS match_path, sha256(m) AS source_hash, CASE WHEN f > 1 THEN f - 1 END AS strip, obsolete FROM g"""),
    "endpoint_intents": (endpoint_intents, f"WITH {proofs.URLS}, {proofs.ENDPOINTS} SELECT m || ' ' || host || endpoint_path AS source_id, endpoint_path AS path_hint FROM ep"),
    "run_list": (run_list, "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"),
    "change_cursor": (change_cursor, "SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS generation, max(strftime(o_orderdate, '%Y-%m')) AS built, (SELECT max(event_id) FROM events) AS token FROM orders"),
    "selected_scope": (selected_scope, with_tables("""SELECT id, relation_type, subject_id, object_id FROM relations WHERE subject_id IN (SELECT id FROM scope) AND object_id IN (SELECT id FROM scope)""", reports.CHOSEN, f"scope AS ({reports.SCOPE})")),
    "export_domains": (export_domains, with_tables("""SELECT o.id AS domain_id, to_json({'domain': o.id, 'name': o.name, 'members': (SELECT count(*) FROM affinities a WHERE a.domain_id = o.id),
        'top': (SELECT list(object_id ORDER BY affinity DESC, object_id) FROM (SELECT * FROM affinities a WHERE a.domain_id = o.id ORDER BY affinity DESC, object_id LIMIT 5))})::VARCHAR AS json FROM objects o WHERE object_type = 'domain'""")),
    "config_keys": (config_keys, """WITH k AS (SELECT DISTINCT lower(p_brand || '.' || p_name) AS k FROM part),
        a AS (SELECT lower(p_name) AS a FROM part UNION SELECT lower(p_brand) FROM part UNION SELECT lower(p_brand || '.' || p_name) FROM part WHERE p_size = 50 UNION SELECT lower(n_name) FROM nation),
        g AS (SELECT *, list_filter(string_split_regex(a, '[./_\\-\\s]+'), lambda s: s <> '') AS x, list_filter(string_split_regex(k, '[./_\\-\\s]+'), lambda s: s <> '') AS y FROM a, k),
        s AS (SELECT a, k, CASE WHEN a = k THEN 1000 + len(k) ELSE 25 * len(list_filter(x, lambda s: list_contains(y, s))) + CASE WHEN ends_with(k, a) THEN 200 ELSE 0 END + CASE WHEN ends_with(a, k) THEN 120 ELSE 0 END
          + CASE WHEN contains(k, a) OR contains(a, k) THEN 60 ELSE 0 END + least(len(k), 120) / 10::DOUBLE END::DOUBLE AS score FROM g),
        b AS (SELECT a, arg_max(k, (score, len(k), k)) AS key, max(score) AS score FROM s GROUP BY 1)
        SELECT a AS asked, key, round(score, 6) AS score, CASE WHEN score >= 1000 THEN 'exact' WHEN score >= 200 THEN 'suffix' ELSE 'token' END AS strategy FROM b"""),
    "db_contradictions": (db_contradictions, """WITH l AS (SELECT *, row_number() OVER w AS rn, lag(l_partkey) OVER w AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_discount))
        SELECT l_orderkey, rn, array_to_string(list_filter([CASE WHEN p.p_type <> b.p_type THEN 'DB_SCHEMA_CONTRADICTION' END, CASE WHEN replace(p.p_name, ' ', '') <> replace(b.p_name, ' ', '') THEN 'DB_TABLE_CONTRADICTION' END,
          CASE WHEN l_returnflag = 'N' THEN 'UNSUPPORTED_SUMMARY_CONFLICT' END, CASE WHEN l_quantity >= 45 THEN 'TRUNCATED_SUMMARY_CONFLICT' END], lambda x: x IS NOT NULL), ',') AS reasons
        FROM l JOIN part p ON p.p_partkey = l_partkey LEFT JOIN part b ON b.p_partkey = before"""),
    "page_completeness": (page_completeness, f"""WITH {proofs.URLS}, s AS (SELECT u.page_id, html, CASE WHEN length(html) >= 1500 THEN 0.35::DOUBLE ELSE 0::DOUBLE END + CASE WHEN path = '/' THEN 0::DOUBLE WHEN regexp_matches(path, '[0-9]') THEN 0.25::DOUBLE ELSE 0.45::DOUBLE END
          + CASE WHEN host = '' THEN 0::DOUBLE WHEN starts_with(host, 'm.') THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS h FROM u JOIN (SELECT page_id, coalesce(html, '') AS html FROM pages) USING (page_id))
        SELECT page_id, round(least(greatest(CASE WHEN contains(html, '<table') THEN (h + 0.45::DOUBLE) / 2 ELSE h END - (CASE WHEN length(html) > 5000 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN contains(html, '<script') THEN 0.15::DOUBLE ELSE 0::DOUBLE END), 0), 1), 4) AS completeness FROM s"""),
    "link_endpoints": (link_endpoints, f"""WITH {proofs.URLS}, {proofs.LINKS}, c AS (SELECT host, path, count(*) AS n FROM links GROUP BY ALL), e AS (SELECT host, path, min(page_id) AS p FROM u GROUP BY ALL HAVING min(page_id) = max(page_id))
        SELECT c.host, c.path, n, h.host AS service_id, e.p AS endpoint_id, CASE WHEN e.p IS NOT NULL THEN 'endpoint' WHEN h.host IS NOT NULL THEN 'service' ELSE 'open' END AS status
        FROM c LEFT JOIN (SELECT DISTINCT host FROM u) h ON h.host = c.host LEFT JOIN e ON e.host = c.host AND e.path = c.path"""),
    "intent_upkeep": (intent_upkeep, f"""WITH {proofs.URLS}, {proofs.LINKS}, i AS (SELECT sha256(u.host || chr(31) || lower(trim(l.host)) || chr(31) || lower(trim(l.path))) AS intent_hash, sha256(u.host) AS anchor_hash, length(html) >= 1500 AS n, contains(html, '<script') AS b
        FROM links l JOIN u USING (page_id) JOIN pages USING (page_id))
        SELECT intent_hash, anchor_hash, CASE WHEN NOT bool_or(b) THEN 'new' WHEN NOT bool_or(n) THEN 'retired' ELSE 'kept' END AS status FROM i WHERE n OR b GROUP BY ALL"""),
}
