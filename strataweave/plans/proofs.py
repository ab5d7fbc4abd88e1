"""Queries on signals in texts and on closing intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions.scalars import path_compatibility, r6, segments, url_host, url_path
from strataweave.operators import proof, signals
from strataweave.sources.graph_tables import GraphTables, with_tables
from strataweave.sources.scratch import stored


def code_signals(spark, sf_dir):
    """Line signals in documents by kind and document."""
    docs = GraphTables(spark, sf_dir).source("documents")
    return signals.line_signals(docs, "doc_id", "text").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("line").cast("long").alias("first_line"), F.max("confidence").alias("confidence"))


def signal_merge(spark, sf_dir):
    """Signals of two engines on the same page: links found in the markup and the page's own address."""
    pages = GraphTables(spark, sf_dir).source("pages")
    own = pages.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.lit("address").alias("engine"), F.lit(0.6).alias("confidence"))
    links = signals.page_links(pages).select(F.col("link_host").alias("host"), "path", F.lit("markup").alias("engine"), F.lit(0.8).alias("confidence"))
    return signals.merge_signals(own.unionByName(links).select("host", "engine", "confidence"), ["host"])


def page_links(spark, sf_dir):
    return signals.page_links(GraphTables(spark, sf_dir).source("pages")).groupBy(F.col("link_host").alias("host"), "path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


def config_entries(spark, sf_dir):
    return signals.config_entries(GraphTables(spark, sf_dir).source("documents"), "doc_id", "text")


def sql_tables(spark, sf_dir):
    """Tables in SQL statements that are made from each part: reads of its name, writes to its brand."""
    p = GraphTables(spark, sf_dir).source("part")
    text = F.concat(F.lit("/* part */ WITH t AS (SELECT * FROM "), F.regexp_replace("p_name", "[^a-z]+", "_"), F.lit(") INSERT INTO "), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "_"), F.lit(" SELECT * FROM t -- end"))
    found = signals.sql_tables(p.select("p_partkey", text.alias("sql")), "p_partkey", "sql")
    return found.groupBy("table_name", "access").agg(F.count(F.lit(1)).alias("statements"))


def key_candidates(spark, sf_dir):
    """Foreign keys among columns that customers' segments and nations make up: declared, unique, in an index, or by name alone."""
    c = GraphTables(spark, sf_dir).source("customer")
    column = F.concat(F.lower(F.element_at(F.array(*[F.lit(x) for x in ("BUILDING", "MACHINERY", "HOUSEHOLD", "ORDER", "FURNITURE")]), (F.col("c_nationkey") % 5 + 1).cast("int"))), F.lit("_id"))
    cols = c.groupBy(F.concat(F.lower("c_mktsegment"), F.lit("s")).alias("table_name"), column.alias("column_name")).agg(
        F.min(F.when((F.col("c_nationkey") % 5 == 1) & (F.col("c_mktsegment") == "BUILDING"), "machinerys")).alias("declared_ref"), F.max(F.col("c_nationkey") % 5 == 2).alias("is_unique"), F.max(F.col("c_mktsegment") == "MACHINERY").alias("in_index"))
    return signals.key_candidates(cols)


def owner_by_path(spark, sf_dir):
    """Owner of each page: the nearest path segment that is a language of the documents."""
    g = GraphTables(spark, sf_dir)
    services = g.source("documents").select(F.col("lang").alias("name")).where("name is not null").distinct().select("name", F.concat(F.lit("L"), F.col("name")).alias("id"))
    return signals.owners(g.source("pages").select(url_path(F.col("url")).alias("path")).distinct(), services)


def hash_incremental(spark, sf_dir):
    """Documents that a second scan must read again, after the English ones were seen, those of one source with a line more."""
    docs = GraphTables(spark, sf_dir).source("documents").select("doc_id", "text", "lang", "source")
    before = docs.where("lang = 'en'").select("doc_id", F.when(F.col("source") == "src3", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))).otherwise(F.col("text")).alias("text"))
    return signals.changed_files(docs.select("doc_id", "text"), before, "doc_id", "text")


def _intents(g: GraphTables):
    """An intent for each page: a call of its path, answered by the service of its host."""
    p = g.source("pages")
    return p.select(F.col("page_id").alias("intent_id"), url_path(F.col("url")).alias("path"), url_host(F.col("url")).alias("provider_id"), F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"))


def endpoint_rows(g: GraphTables):
    """Endpoints of each host: the paths of its longer pages, with numbers as placeholders."""
    e = g.source("pages").where("length(html) >= 1500").select(url_host(F.col("url")).alias("provider_id"), F.regexp_replace(url_path(F.col("url")), "/[0-9]+", "/{id}").alias("endpoint_path"), F.when(F.col("page_id") % 2 == 0, "ANY").otherwise("GET").alias("endpoint_method")).distinct()
    return e.withColumn("endpoint_id", F.concat_ws(" ", "endpoint_method", F.concat("provider_id", "endpoint_path")))


def path_compat(spark, sf_dir):
    """Every path of a host against every endpoint of that host."""
    g = GraphTables(spark, sf_dir)
    rows = _intents(g).select("provider_id", "path").distinct().join(endpoint_rows(g).select("provider_id", "endpoint_path").distinct(), "provider_id")
    return rows.select("provider_id", "path", "endpoint_path", r6(path_compatibility(segments(F.col("path")), segments(F.col("endpoint_path")))).alias("score"))


def proof_http(spark, sf_dir):
    g = GraphTables(spark, sf_dir)
    endpoints = stored(endpoint_rows(g), "endpoints")  # used as patterns and as targets: the pages' texts are read once
    return proof.endpoint_choice(_intents(g), endpoints).withColumn("score", r6(F.col("score")))


def route_match(spark, sf_dir):
    """The gateway rule that takes each page's path: exact for the first page of a language, else by language, by a pattern of long numbers, or the rule for all; ties are marked."""
    g = GraphTables(spark, sf_dir)
    langs = _intents(g).select(F.regexp_extract("path", "^/([a-z]+)/", 1).alias("l")).where("l <> ''").distinct()
    rule = lambda i, mode, path, priority: (i.alias("rule_id"), F.lit(mode).alias("mode"), path.alias("match_path"), F.lit(priority).alias("priority"))
    prefix = langs.select(*rule(F.concat(F.lit("p-"), F.col("l")), "prefix", F.concat(F.lit("/"), F.col("l"), F.lit("/**")), 1))
    again = langs.where("l > 'f'").select(*rule(F.concat(F.lit("q-"), F.col("l")), "prefix", F.concat(F.lit("/"), F.col("l"), F.lit("/*")), 1))
    exact = _intents(g).where("path rlike '^/[a-z]+/[0-9]+$'").groupBy(F.regexp_extract("path", "^/([a-z]+)/", 1).alias("l")).agg(F.min("path").alias("match_path")).select(*rule(F.concat(F.lit("x-"), F.col("l")), "exact", F.col("match_path"), 1))
    others = spark.range(1).select(*rule(F.lit("r"), "regex", F.lit("/[0-9]*7$"), 1)).unionByName(spark.range(1).select(*rule(F.lit("z"), "prefix", F.lit("/**"), 0)))
    out = proof.route_matches(_intents(g).select("intent_id", "path"), prefix.unionByName(again).unionByName(exact).unionByName(others))
    return out.select("intent_id", "rule_id", F.col("spec").cast("long").alias("spec"), "tied", proof.transformed(F.col("path"), F.lit(1), F.lit("/internal")).alias("internal_path"))


def db_intents(spark, sf_dir):
    """Table intents from part names, the tables, and what an answer needs beside them."""
    g = GraphTables(spark, sf_dir)
    intents = g.source("part").select(F.col("p_partkey").alias("intent_id"), F.col("p_name").alias("table_hint"))
    return intents, g.objects().where("object_type = 'db_table'"), "table_hint", "DB_TABLE_UNRESOLVED", "TABLE_MATCH_AMBIGUOUS"


def message_intents(spark, sf_dir):
    """Topic intents from events of every user, the topics, and what an answer needs beside them."""
    g = GraphTables(spark, sf_dir)
    intents = g.source("events").select(F.col("event_id").alias("intent_id"), F.concat(F.lit("TP"), "event_type", F.lit(":"), (F.hour("ts") + F.col("event_id") % 3).cast("string")).alias("topic_hint"))
    return intents, g.objects().where("object_type = 'topic'"), "topic_hint", "MESSAGE_TARGET_UNRESOLVED", "TOPIC_MATCH_AMBIGUOUS"


def proof_db(spark, sf_dir):
    """Table intents: a name that one table bears closes, others are ambiguous."""
    return proof.name_choice(*db_intents(spark, sf_dir))


def proof_message(spark, sf_dir):
    return proof.name_choice(*message_intents(spark, sf_dir))


def proof_confidence(spark, sf_dir):
    """The confidence formula over order lines: quality from the discount, slots from the tax, counts from line and quantity."""
    l = GraphTables(spark, sf_dir).chain()
    c = proof.proof_confidence(1 - F.col("l_discount"), F.col("l_tax") * 10, F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", 0.2).otherwise(0.12), (F.col("l_quantity") < 5).cast("int"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.9))
    return l.select("l_orderkey", "rn", r6(c).alias("confidence")).withColumn("rn", F.col("rn").cast("long"))


def impacted_intents(spark, sf_dir):
    """Orders whose proof depends on a part or supplier that changed."""
    g = GraphTables(spark, sf_dir)
    lines = g.source("lineitem")
    deps = lines.select(F.col("l_orderkey").alias("intent_id"), F.explode(F.array(F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("key")), F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("key")))).alias("d")).select("intent_id", "d.kind", "d.key")
    changed = g.source("part").where("p_size = 1").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key")).union(g.source("supplier").where("s_acctbal < 0").select(F.lit("supplier"), "s_suppkey"))
    return proof.impacted(deps, changed)


def intent_classes(spark, sf_dir):
    """Turns of conversations by the query that their words ask for; the first rule that fits."""
    t = F.lower("text")
    kind = F.when(t.rlike(r"\b(path|route|from)\b"), "PATH_DISCOVERY").when(t.rlike(r"\b(impact|affect|of)\b"), "IMPACT_ANALYSIS").when(t.rlike(r"\b(use|uses|for)\b"), "USAGE_DISCOVERY").otherwise("DOMAIN_SUMMARY")
    return GraphTables(spark, sf_dir).source("conversations").groupBy("role", kind.alias("query_type")).agg(F.count(F.lit(1)).alias("turns"))


def route_chain(spark, sf_dir):
    """Page paths through two tiers of gateway rules: by language, then by version."""
    g = GraphTables(spark, sf_dir)
    langs = _intents(g).select(F.regexp_extract("path", "^/([a-z]+)(/|$)", 1).alias("l")).where("l <> ''").distinct()
    first = langs.select(F.concat(F.lit("a-"), F.col("l")).alias("rule_id"), F.lit("prefix").alias("mode"), F.concat(F.lit("/"), F.col("l"), F.lit("/**")).alias("match_path"), F.lit(1).alias("priority"), F.lit(1).alias("strip"), F.lit("/V1").alias("prepend"))
    second = spark.range(1).select(F.lit("b").alias("rule_id"), F.lit("prefix").alias("mode"), F.lit("/V1/**").alias("match_path"), F.lit(1).alias("priority"), F.lit(1).alias("strip"), F.lit("/INTERNAL").alias("prepend"))
    twins = first.where("rule_id > 'a-f'").withColumn("rule_id", F.concat(F.lit("c"), F.substring("rule_id", 2, 99)))  # as strong as the first: paths stay where they tie
    return proof.route_chain(_intents(g), first.unionByName(second).unionByName(twins)).select("intent_id", "path", F.col("hops").cast("long").alias("hops"), "status")


def provider_choice(spark, sf_dir):
    """The page's language by the share of pages that its first path segment has in each top-level domain, if one leads clearly."""
    p = GraphTables(spark, sf_dir).source("pages").select(F.regexp_extract("url", r"://[^/]*\.([a-z]+)(/|$)", 1).alias("candidate"), F.regexp_extract("url", r"://[^/]+/([a-z]+)", 1).alias("segment"))
    n = p.groupBy("segment", "candidate").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("segment").agg(F.sum("n").alias("total"))
    scores = n.join(total, "segment").select("segment", "candidate", (F.col("n") / F.col("total")).alias("score"))
    return proof.clear_winner(scores, "segment", 0.3, 0.02).withColumn("score", r6(F.col("score")))


def confidence_rules(spark, sf_dir):
    """Line signals by kind after rules that raise entries of tokens and links."""
    docs = GraphTables(spark, sf_dir).source("documents")
    rows = signals.line_signals(docs, "doc_id", "text")
    out = signals.with_rules(rows, [(F.col("kind") == "entry", 0.08), (F.col("kind") == "link", 0.6), (F.col("line") > 3, -0.05)])
    return out.select("doc_id", F.col("line").cast("long").alias("line"), "kind", r6(F.col("confidence")).alias("confidence"))


def unambiguous_endpoints(spark, sf_dir):
    """Paths of a host that one page alone serves."""
    g = GraphTables(spark, sf_dir)
    return signals.unambiguous(_intents(g), ["provider_id", "path"], "intent_id")


def language_metrics(spark, sf_dir):
    """Documents, lines and signals of each language, and the share of documents without any."""
    docs = GraphTables(spark, sf_dir).source("documents")
    lines = docs.select("doc_id", "lang", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    hits = signals.line_signals(docs, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("signals"))
    rows = lines.join(hits, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.coalesce(F.sum("signals"), F.lit(0)).alias("signals"), F.round(F.count_if(F.col("signals").isNull()) / F.count(F.lit(1)), 3).alias("fallback_rate"))


def module_boundaries(spark, sf_dir):
    """Hosts scored as modules; each page stands for a file of its host."""
    p = GraphTables(spark, sf_dir).source("pages")
    names = ("src/main/resources/application.yml", "src/main/java/A.java", "build.gradle", "README", "src/main/ts/main.ts", "docs/x", "pom.xml", "src/main/resources/x.txt")
    path = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("page_id") % 8 + 1).cast("int"))
    files = p.select(url_host(F.col("url")).alias("module"), path.alias("path"), F.col("html").alias("text"))
    return signals.module_scores(files).select(F.col("module").alias("host"), F.col("score").cast("long").alias("score"), "class")


URLS = "u AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END AS path FROM pages)"
LINKS = """k AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS l FROM pages),
links AS (SELECT page_id, lower(regexp_extract(l, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host,
  CASE WHEN contains(l, '://') THEN CASE WHEN regexp_extract(l, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(l, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END ELSE regexp_extract(l, '^[^?#]*') END AS path FROM k)"""
SEGS = lambda c: f"list_transform(list_filter(string_split({c}, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^(\\$?\\{{.*\\}}|:.+|\\*+)$') THEN '{{*}}' ELSE lower(s) END)"
ENDPOINTS = """ep AS (SELECT DISTINCT host, regexp_replace(path, '/[0-9]+', '/{id}', 'g') AS endpoint_path, CASE WHEN page_id % 2 = 0 THEN 'ANY' ELSE 'GET' END AS m FROM u JOIN pages USING (page_id) WHERE length(html) >= 1500)"""
DYN = "(regexp_full_match(c, '[0-9]+') OR regexp_full_match(c, '[0-9a-f]{24}') OR regexp_full_match(c, '[0-9a-f]{32,}') OR (regexp_matches(c, '[0-9]') AND regexp_matches(c, '[a-z]')))"
SCORE = f"""sc AS (SELECT host, path, endpoint_path, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0
    WHEN b[len(b)] = '{{*}}' AND len(a) <> len(b) THEN CASE WHEN a[1:len(b) - 1] = b[1:len(b) - 1] THEN 0.55 ELSE 0.0 END
    WHEN abs(len(a) - len(b)) > 1 THEN 0.0 ELSE greatest(0.0, coalesce(fit, 0) / greatest(1, least(len(a), len(b))) - 0.2 * abs(len(a) - len(b))) END AS score FROM (
  SELECT *, (SELECT sum(CASE WHEN c IS NULL OR e IS NULL THEN -0.4 WHEN e = '{{*}}' THEN CASE WHEN c = '{{*}}' OR {DYN} THEN 0.9 ELSE 0.5 END WHEN c = '{{*}}' THEN 0.7 WHEN c = e THEN 1.0 ELSE -0.4 END) FROM (SELECT a[i] AS c, b[i] AS e FROM (SELECT unnest(range(1, len(b) + 1)) AS i))) AS fit
  FROM (SELECT DISTINCT u.host, u.path, ep.endpoint_path, {SEGS('u.path')} AS a, {SEGS('ep.endpoint_path')} AS b FROM u JOIN ep ON u.host = ep.host)))"""

ENTRIES = {
    "code_signals": (code_signals, """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS c, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
        s AS (SELECT doc_id, line, CASE WHEN regexp_matches(c, '@(Get|Post|Put|Delete|Patch|Request)Mapping') THEN 'expose' WHEN regexp_matches(c, '(RestTemplate|WebClient|FeignClient|axios\\.|fetch\\(|requests\\.)') THEN 'call'
          WHEN regexp_matches(c, '(kafkaTemplate\\.send|\\.send\\(\\s*new\\s+ProducerRecord)') THEN 'produce' WHEN regexp_matches(c, '@KafkaListener') THEN 'consume' WHEN regexp_matches(c, 'https?://[^\\s"''<>]+') THEN 'link' WHEN regexp_matches(c, '[A-Za-z_][A-Za-z0-9_.-]*\\s*[=:]\\s*"[^"]+"') THEN 'entry' END AS kind FROM l)
        SELECT doc_id, kind, count(*) AS n, CAST(min(line) AS BIGINT) AS first_line, CASE kind WHEN 'expose' THEN 0.8 WHEN 'consume' THEN 0.8 WHEN 'link' THEN 0.6 WHEN 'entry' THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence FROM s WHERE kind IS NOT NULL GROUP BY ALL"""),
    "signal_merge": (signal_merge, f"WITH {URLS}, {LINKS} SELECT host, max(c)::DOUBLE AS confidence, array_to_string(list_sort(list_distinct(list(e))), ',') AS engines, arg_max(e, (c, e)) AS best_engine FROM (SELECT host, 'address' AS e, 0.6 AS c FROM u UNION ALL SELECT host, 'markup', 0.8 FROM links) GROUP BY 1"),
    "page_links": (page_links, f"WITH {LINKS} SELECT host, path, count(*) AS n, count(DISTINCT page_id) AS pages FROM links GROUP BY ALL"),
    "config_entries": (config_entries, """WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.-]*\\s*=\\s*"[^"]+"')) AS x FROM documents) SELECT doc_id, regexp_extract(x, '^([A-Za-z0-9_.-]+)', 1) AS name, regexp_extract(x, '"([^"]+)"', 1) AS value FROM e"""),
    "sql_tables": (sql_tables, "SELECT regexp_replace(p_name, '[^a-z]+', '_', 'g') AS table_name, 'read' AS access, count(*) AS statements FROM part GROUP BY 1 UNION ALL SELECT regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), 'write', count(*) FROM part GROUP BY 1"),
    "key_candidates": (key_candidates, """WITH c AS (SELECT DISTINCT lower(c_mktsegment) || 's' AS t, ['building', 'machinery', 'household', 'order', 'furniture'][c_nationkey % 5 + 1] AS b FROM customer)
        SELECT t AS table_name, b || '_id' AS column_name, b || 's' AS ref_table, CASE WHEN t = 'buildings' AND b = 'machinery' THEN 0.95 WHEN b = 'household' THEN 0.85 WHEN t = 'machinerys' THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence
        FROM c WHERE b || 's' IN (SELECT t FROM c) OR (t = 'buildings' AND b = 'machinery')"""),
    "owner_by_path": (owner_by_path, f"WITH {URLS}, p AS (SELECT DISTINCT path FROM u), s AS (SELECT path, unnest(string_split(lower(path), '/')) AS seg, generate_subscripts(string_split(lower(path), '/'), 1) AS pos FROM p) SELECT path, 'L' || arg_max(seg, pos) AS service_id FROM s WHERE seg IN (SELECT lang FROM documents) GROUP BY 1"),
    "hash_incremental": (hash_incremental, "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE lang IS DISTINCT FROM 'en' OR source = 'src3'"),
    "path_compat": (path_compat, f"WITH {URLS}, {ENDPOINTS}, {SCORE} SELECT host AS provider_id, path, endpoint_path, round(score, 6)::DOUBLE AS score FROM sc"),
    "proof_http": (proof_http, f"""WITH {URLS}, {ENDPOINTS}, {SCORE}, r AS (SELECT u.page_id, ep.m || ' ' || u.host || ep.endpoint_path AS e, sc.score, sc.score >= 0.75 AND (ep.m = 'ANY' OR ep.m = CASE WHEN u.page_id % 3 = 0 THEN 'POST' ELSE 'GET' END) AS ok
          FROM u LEFT JOIN ep ON u.host = ep.host LEFT JOIN sc ON sc.host = u.host AND sc.path = u.path AND sc.endpoint_path = ep.endpoint_path),
        b AS (SELECT page_id, max(score) FILTER (WHERE ok) AS best FROM r GROUP BY 1), t AS (SELECT page_id, best, count(*) FILTER (WHERE ok AND score = best) AS n, min(e) FILTER (WHERE ok AND score = best) AS e FROM r JOIN b USING (page_id) GROUP BY ALL)
        SELECT page_id AS intent_id, CASE WHEN n = 0 THEN 'PROVIDER_ENDPOINT_NOT_FOUND' WHEN n > 1 THEN 'ENDPOINT_MATCH_AMBIGUOUS' ELSE 'CLOSED_ATOMIC' END AS status, CASE WHEN n = 1 THEN e END AS endpoint_id, round(best, 6)::DOUBLE AS score FROM t"""),
    "route_match": (route_match, f"""WITH {URLS}, i AS (SELECT page_id, path, regexp_extract(path, '^/([a-z]+)/', 1) AS l FROM u), x AS (SELECT l, min(path) AS p FROM i WHERE regexp_full_match(path, '/[a-z]+/[0-9]+') GROUP BY 1),
        m AS (SELECT page_id, path, CASE WHEN path = p THEN 'x-' || i.l WHEN regexp_matches(path, '/[0-9]*7$') THEN 'r' WHEN i.l <> '' THEN 'p-' || i.l ELSE 'z' END AS rule_id, i.l FROM i LEFT JOIN x ON i.l = x.l AND i.l <> '')
        SELECT page_id AS intent_id, rule_id, CASE rule_id[1] WHEN 'x' THEN 202 WHEN 'r' THEN 101 WHEN 'p' THEN 2 ELSE 1 END::BIGINT AS spec, rule_id[1] = 'p' AND l > 'f' AS tied,
          '/internal' || CASE WHEN regexp_matches(path, '^/[^/]+/.*[^/]') THEN rtrim(regexp_replace(path, '^/[^/]+', ''), '/') ELSE '' END AS internal_path FROM m"""),
    "proof_db": (proof_db, """SELECT p_partkey AS intent_id, CASE WHEN n IS NULL THEN 'DB_TABLE_UNRESOLVED' WHEN n > 1 THEN 'TABLE_MATCH_AMBIGUOUS' ELSE 'CLOSED_ATOMIC' END AS status, CASE WHEN n = 1 THEN t END AS target_id
        FROM part LEFT JOIN (SELECT p_name AS k, count(*) AS n, min('T' || p_partkey) AS t FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY 1) ON k = p_name"""),
    "proof_message": (proof_message, """WITH t AS (SELECT DISTINCT 'TP' || event_type || ':' || hour(ts) AS t FROM events) SELECT event_id AS intent_id, CASE WHEN t IS NULL THEN 'MESSAGE_TARGET_UNRESOLVED' ELSE 'CLOSED_ATOMIC' END AS status, t AS target_id FROM events LEFT JOIN t ON t = 'TP' || event_type || ':' || (hour(ts) + event_id % 3)"""),
    "proof_confidence": (proof_confidence, with_tables("""SELECT l_orderkey, rn, round(least(greatest(((1 - l_discount) * 0.45::DOUBLE + l_tax * 10 * 0.25::DOUBLE + least(0.2::DOUBLE, 0.05::DOUBLE * l_linenumber) + CASE WHEN l_returnflag = 'R' THEN 0.2::DOUBLE ELSE 0.12::DOUBLE END - CASE WHEN l_quantity < 5 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) * CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END, 0), 1), 6) AS confidence FROM chain""")),
    "impacted_intents": (impacted_intents, "SELECT DISTINCT l_orderkey AS intent_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"),
    "route_chain": (route_chain, f"""WITH {URLS}, i AS (SELECT page_id, path, regexp_extract(path, '^/([a-z]+)(/|$)', 1) AS l FROM u)
        SELECT page_id AS intent_id, CASE WHEN l = '' OR l > 'f' THEN path ELSE '/INTERNAL' || rtrim(substr(path, len(l) + 2), '/') END AS path, CASE WHEN l = '' OR l > 'f' THEN 0 ELSE 2 END::BIGINT AS hops, CASE WHEN l > 'f' THEN 'ROUTE_RULE_CONFLICT' ELSE '' END AS status FROM i"""),
    "provider_choice": (provider_choice, """WITH p AS (SELECT regexp_extract(url, '://[^/]*\\.([a-z]+)(/|$)', 1) AS c, regexp_extract(url, '://[^/]+/([a-z]+)', 1) AS segment FROM pages),
        n AS (SELECT segment, c, count(*) / sum(count(*)) OVER (PARTITION BY segment) AS score FROM p GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER w AS place, coalesce(lead(score) OVER w, 0) AS second FROM n WINDOW w AS (PARTITION BY segment ORDER BY score DESC, c))
        SELECT segment, c AS candidate, round(score, 6) AS score FROM r WHERE place = 1 AND score >= 0.3 AND score - second >= 0.02"""),
    "confidence_rules": (confidence_rules, """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS c, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
        s AS (SELECT doc_id, line, CASE WHEN regexp_matches(c, '@(Get|Post|Put|Delete|Patch|Request)Mapping') THEN 'expose' WHEN regexp_matches(c, '(RestTemplate|WebClient|FeignClient|axios\\.|fetch\\(|requests\\.)') THEN 'call'
          WHEN regexp_matches(c, '(kafkaTemplate\\.send|\\.send\\(\\s*new\\s+ProducerRecord)') THEN 'produce' WHEN regexp_matches(c, '@KafkaListener') THEN 'consume' WHEN regexp_matches(c, 'https?://[^\\s"\'\'<>]+') THEN 'link' WHEN regexp_matches(c, '[A-Za-z_][A-Za-z0-9_.-]*\\s*[=:]\\s*"[^"]+"') THEN 'entry' END AS kind FROM l)
        SELECT doc_id, CAST(line AS BIGINT) AS line, kind, round(CASE kind WHEN 'expose' THEN 0.8 WHEN 'consume' THEN 0.8 WHEN 'link' THEN 1.0 WHEN 'entry' THEN 0.58 ELSE 0.7 END::DOUBLE - CASE WHEN line > 3 THEN 0.05::DOUBLE ELSE 0 END, 6) AS confidence FROM s WHERE kind IS NOT NULL"""),
    "unambiguous_endpoints": (unambiguous_endpoints, f"WITH {URLS} SELECT host AS provider_id, path, min(page_id) AS intent_id FROM u GROUP BY 1, 2 HAVING count(DISTINCT page_id) = 1"),
    "language_metrics": (language_metrics, """WITH l AS (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), s AS (SELECT doc_id, lang, len(x) AS lines, len(list_filter(x, lambda c: regexp_matches(c, '@(Get|Post|Put|Delete|Patch|Request)Mapping|RestTemplate|WebClient|FeignClient|axios\\.|fetch\\(|requests\\.|kafkaTemplate\\.send|\\.send\\(\\s*new\\s+ProducerRecord|@KafkaListener|https?://[^\\s"\'\'<>]+|[A-Za-z_][A-Za-z0-9_.-]*\\s*[=:]\\s*"[^"]+"'))) AS n FROM l)
        SELECT lang, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(n) AS BIGINT) AS signals, round(count(*) FILTER (WHERE n = 0) / count(*), 3) AS fallback_rate FROM s GROUP BY 1"""),
    "module_boundaries": (module_boundaries, f"""WITH {URLS}, f AS (SELECT host, u.page_id % 8 AS k, regexp_matches(coalesce(html, ''), '(?i)(spring-boot|application|org\\.springframework\\.boot|io\\.quarkus|shadowJar)') AS runs FROM u JOIN pages USING (page_id)),
        m AS (SELECT host, bool_or(k = 0) AS config, bool_or(k IN (1, 4)) AS code, bool_or(k IN (0, 1, 4, 7)) AS main, bool_or(k IN (2, 6) AND runs) AS plugin, bool_or(k = 4) AS entry FROM f GROUP BY 1),
        s AS (SELECT host, (3 * config::INT + 2 * code::INT + main::INT + 3 * plugin::INT - 3 * regexp_matches(host, '(?i)(common|domain|shared|lib|library)')::INT - 3 * (NOT entry AND NOT plugin)::INT)::BIGINT AS score FROM m)
        SELECT host, score, CASE WHEN score >= 3 THEN 'service_candidate' WHEN score <= -1 THEN 'library_candidate' ELSE 'inherited' END AS class FROM s"""),
    "intent_classes": (intent_classes, "SELECT role, CASE WHEN regexp_matches(t, '\\b(path|route|from)\\b') THEN 'PATH_DISCOVERY' WHEN regexp_matches(t, '\\b(impact|affect|of)\\b') THEN 'IMPACT_ANALYSIS' WHEN regexp_matches(t, '\\b(use|uses|for)\\b') THEN 'USAGE_DISCOVERY' ELSE 'DOMAIN_SUMMARY' END AS query_type, count(*) AS turns FROM (SELECT role, lower(text) AS t FROM conversations) GROUP BY ALL"),
}
