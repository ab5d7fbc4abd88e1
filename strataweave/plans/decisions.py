"""Queries on project files as configuration, and on decisions: review, cutover, evidence cuts, scenarios, domain summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions.scalars import exact_avg, r6
from strataweave.operators import intake, review
from strataweave.sources.graph_tables import GraphTables, avg6_sql, with_tables
from strataweave.sources.scratch import stored

K = lambda c="s_suppkey": F.col(c).cast("string")


def application_files(g: GraphTables):
    """An application file of each supplier, below the folder of its nation: a data source, brokers, gateway routes."""
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit("spring:\n  application:\n    name: "), F.translate("s_name", "#", "-"), F.when(k % 3 != 2, F.concat(F.lit("\n  datasource:\n    url: jdbc:postgresql://DB"), (k % 7).cast("string"), F.lit(":5432/app"), (k % 11).cast("string"), F.lit("?ssl=true"))).otherwise(""),
        F.when(k % 2 == 0, F.concat(F.lit("\n  kafka:\n    bootstrap-servers: broker"), (k % 5).cast("string"), F.lit(":9092\n    consumer:\n      group-id: g"), F.when(k % 4 == 0, "\n    producer:\n      acks: all").otherwise(""))).otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit("\nzuul:\n  routes:\n    next:\n      path: /next/**\n      serviceId: Supplier-"), F.lpad((k + 1).cast("string"), 9, "0"))).otherwise(""), F.lit("\n"),
    )
    return g.source("supplier").select(F.concat(F.lit("repo/N"), F.col("s_nationkey").cast("string"), F.lit("/S"), K(), F.lit("/application.yml")).alias("path"), text.alias("text"))


def config_relations(spark, sf_dir):
    """What the suppliers' application files tell of relations, by the supplier that each file names."""
    g = GraphTables(spark, sf_dir)
    entries = stored(intake.flattened(application_files(g)), "entries")
    services = g.source("supplier").select(F.concat(F.lit("S"), K()).alias("id"), F.translate("s_name", "#", "_").alias("name"))
    return intake.relation_candidates(intake.config_candidates(entries), intake.named_services(entries, services))


def compose_relations(spark, sf_dir):
    """A compose file of each nation: its suppliers wait for a database, a broker or each other."""
    k = F.col("s_suppkey")
    image = F.when(k % 4 == 0, "postgres:16").when(k % 4 == 1, "bitnami/kafka").otherwise(F.concat(F.lit("shop/s"), K()))
    block = F.concat(F.lit("  s"), K(), F.lit(":\n    image: "), image, F.when(k % 4 >= 2, F.concat(F.lit("\n    depends_on:\n      - s"), (k - 25).cast("string"), F.lit("\n      - s"), (k - 50).cast("string"))).otherwise(""))
    # A file holds the suppliers of one nation and one hundred numbers, so it is bounded.
    rows = GraphTables(spark, sf_dir).source("supplier").groupBy((k % 25).alias("n"), F.floor(k / 100).alias("h")).agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("blocks"))
    files = rows.select(F.concat(F.lit("repo/N"), F.col("n").cast("string"), F.lit("-"), F.col("h").cast("string"), F.lit("/docker-compose.yml")).alias("path"), F.concat(F.lit("services:\n"), "blocks", F.lit("\n")).alias("text"))
    return intake.compose_candidates(intake.compose_services(files))


def json_config(spark, sf_dir):
    """Dotted keys of events' properties, wrapped with their type and a list."""
    e = GraphTables(spark, sf_dir).source("events")
    text = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"event":{"props":'), "props", F.lit(',"type":"'), "event_type", F.lit('"},"list":[1,{"a":"x"}],"none":{}}')))
    return intake.json_entries(e.select(F.col("event_id").cast("string").alias("path"), text.alias("text"))).groupBy("key", "value").agg(F.count(F.lit(1)).alias("files"))


def detected_projects(spark, sf_dir):
    """Customers as files of their nation's repository: markers at its root, in folders right below and too deep, some in folders that do not count."""
    k = F.col("c_custkey")
    at = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    marker = at("pom.xml", "package.json", "README.md", "build.gradle.kts", "go.mod", "setup.py", "Cargo.toml")
    root = F.concat(F.lit("/repo/n"), F.col("c_nationkey").cast("string"))
    folder = F.when(k % 50 == 0, "").when(k % 9 == 0, "/node_modules").when(k % 10 == 0, "/.hidden").otherwise(F.concat(F.lit("/p"), (k % 40).cast("string")))
    deep = F.when(k % 6 == 0, "/src").otherwise("")
    return intake.projects(GraphTables(spark, sf_dir).source("customer").select(root.alias("root"), F.concat(root, folder, deep, F.lit("/"), marker).alias("path")))


def _decided(g: GraphTables):
    c = stored(g.candidates().withColumn("status", F.when(F.col("tax") == 0, "REJECTED").otherwise("PENDING")).withColumn("feedback_key", F.concat(F.lit("call:"), "language")), "candidates")
    d = c.where("confidence >= 0.92").select("id", F.lit(1).alias("at"), F.when(F.col("confidence") >= 0.95, "APPROVED").otherwise("REJECTED").alias("action"))
    d = d.unionByName(c.where("confidence >= 0.98").select("id", F.lit(2).alias("at"), F.lit("REJECTED").alias("action")))
    evidence = c.select(F.col("id").alias("candidate_id"), F.explode("evidence_types").alias("t")).select("candidate_id", F.concat_ws("-", "candidate_id", "t").alias("evidence_id"))
    relations = stored(g.relations().where("relation_type = 'depend_on'").withColumn("relation_type", F.lit("call")), "relations")
    return c, d, relations, evidence, evidence.limit(0).withColumnRenamed("candidate_id", "relation_id")


def reviewed(spark, sf_dir):
    """Candidates approved and rejected in one set, some twice: how many have which status, relations made, evidence linked, and first decisions for the feedback."""
    after, made, links, first = review.decide(*_decided(GraphTables(spark, sf_dir)))
    out = after.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("candidate "), "status").alias("what"), "n")
    out = out.unionByName(made.agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("what"), "n")).unionByName(links.agg(F.count(F.lit(1)).alias("n")).select(F.lit("evidence").alias("what"), "n"))
    return out.unionByName(first.select(F.explode(F.array(F.struct(F.concat(F.lit("approved "), "feedback_key").alias("what"), F.col("approved").alias("n")), F.struct(F.concat(F.lit("rejected "), "feedback_key").alias("what"), F.col("rejected").alias("n")))).alias("x")).select("x.*"))


def cutover_decision(spark, sf_dir):
    """Depend-on edges found from sure candidates (baseline: the surest) against the relations: rates, deltas, and whether to go."""
    g = GraphTables(spark, sf_dir)
    key = ("subject_id", "object_id")
    c = stored(g.candidates().select(*key, "confidence"), "candidates")
    truth = g.relations().where("relation_type = 'depend_on'")
    return review.cutover(c.where("confidence >= 0.97"), c.where("confidence >= 0.93"), truth, *key, least_precision=-0.02, most_approvals=1_000_000)


def evidence_recut(spark, sf_dir):
    """Of each part's lines as evidence of at least .93 the surest three."""
    lines = GraphTables(spark, sf_dir).lines()
    chain = lines.select("l_partkey", (1 - F.col("l_tax")).alias("confidence"), (F.col("l_quantity") * (1 - F.col("l_tax"))).alias("score"), F.col("l_quantity").alias("edge_weight"), F.col("l_linenumber").alias("hop"), (F.col("l_orderkey") * 1000 + F.col("rn")).alias("evidence_id"))
    return review.recut(chain, 3, 0.93, "l_partkey").select("l_partkey", F.col("place").cast("long").alias("place"), "evidence_id", r6(F.col("confidence")).alias("confidence"))


def domain_scenarios(spark, sf_dir):
    """The first five scenarios of each region: pages as requests to the region by their number, events as messages of the suppliers' regions."""
    g = GraphTables(spark, sf_dir)
    p = g.source("pages").select((F.col("page_id") % 5).alias("domain_id"), F.lit("http").alias("trigger"), F.concat(F.when(F.col("page_id") % 3 == 0, "POST ").otherwise("GET "), F.regexp_extract("url", "://[^/]+(/[a-z]+/[0-9]{0,1})", 1)).alias("key"), F.col("page_id").alias("entry_id"), F.col("page_id").alias("seq"), (F.col("page_id") % 40).alias("evidence_id"))
    region = g.source("supplier").join(F.broadcast(g.source("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("user_id"), F.col("n_regionkey").alias("domain_id"))  # nation: 25 rows at every scale
    e = g.source("events").join(region, "user_id").where("value >= 60")
    e = e.select("domain_id", F.when(F.col("event_type").isin("purchase", "signup"), "publish").otherwise("consume").alias("trigger"), F.concat("event_type", F.lit("-"), F.hour("ts").cast("string")).alias("key"), F.col("user_id").alias("entry_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 40).alias("evidence_id"))
    return review.scenarios(p.where("seq >= 3").unionByName(e), 5)


def domain_profile(spark, sf_dir):
    """Members of each domain by type with their mean affinity: services of .2 or more and their endpoints, and how many call edges lead out of and into the domain's services."""
    g = GraphTables(spark, sf_dir)
    members = stored(g.affinities().where("affinity >= 0.2"), "members")
    objects = g.objects()
    kids = objects.where("object_type = 'api_endpoint'").select(F.col("parent_id").alias("object_id")).join(members, "object_id").select("domain_id", F.lit("api_endpoint").alias("object_type"), "affinity")
    rows = members.select("domain_id", F.lit("service").alias("object_type"), "affinity").unionByName(kids)
    types = rows.groupBy("domain_id", "object_type").agg(F.count(F.lit(1)).alias("members"), r6(exact_avg(F.col("affinity"))).alias("avg_affinity"))
    depends = g.relations("depend_on").select("subject_id", "object_id").distinct()
    # An end's domains are a short list, so an edge is one row until it leaves or enters a domain.
    domains = members.groupBy("object_id").agg(F.collect_set("domain_id").alias("d"))
    of = lambda end, name: domains.select(F.col("object_id").alias(end), F.col("d").alias(name)).hint("shuffle_hash")
    ends = depends.join(of("subject_id", "a"), "subject_id", "left").join(of("object_id", "b"), "object_id", "left")
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in ("a", "b"))
    side = lambda x, y, out: F.transform(F.array_except(x, y), lambda d: F.struct(d.alias("domain_id"), F.lit(out).alias("out")))
    crossed = ends.select(F.explode(F.concat(side(a, b, True), side(b, a, False))).alias("x")).select("x.*")
    edges = crossed.groupBy("domain_id").agg(F.count_if("out").alias("edges_out"), F.count_if(~F.col("out")).alias("edges_in"))
    return types.join(edges, "domain_id", "left").na.fill(0, ["edges_out", "edges_in"])


ENTRIES = {
    "config_relations": (config_relations, """WITH s AS (SELECT s_suppkey AS k FROM supplier), t AS (
        SELECT k, unnest(['read', 'write']) AS relation_type, 'db' || (k % 7) || ':5432/app' || (k % 11) AS target, 0.9 AS confidence FROM s WHERE k % 3 <> 2
        UNION ALL SELECT k, 'consume', 'broker' || (k % 5) || ':9092', 0.85 FROM s WHERE k % 2 = 0 UNION ALL SELECT k, 'produce', 'broker' || (k % 5) || ':9092', 0.85 FROM s WHERE k % 4 = 0
        UNION ALL SELECT k, 'call', 'Supplier-' || lpad(CAST(k + 1 AS VARCHAR), 9, '0'), 0.7 FROM s WHERE k % 5 = 0)
        SELECT 'S' || k AS subject_id, relation_type, target, confidence::DOUBLE AS confidence, 1::BIGINT AS files FROM t"""),
    "compose_relations": (compose_relations, """WITH s AS (SELECT s_suppkey AS k FROM supplier), w AS (SELECT k, unnest([k - 25, k - 50]) AS t FROM s WHERE k % 4 >= 2)
        SELECT 'repo/N' || (w.k % 25) || '-' || (w.k // 100) || '/docker-compose.yml' AS path, 's' || w.k AS subject, unnest(CASE t % 4 WHEN 0 THEN ['read', 'write'] WHEN 1 THEN ['produce', 'consume'] ELSE ['depend_on'] END) AS relation_type, 's' || t AS target, 0.6::DOUBLE AS confidence FROM w JOIN s ON s.k = t AND t // 100 = w.k // 100"""),
    "json_config": (json_config, """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS v FROM events WHERE event_id % 10 <> 0) SELECT key, value, count(*) AS files FROM (
        SELECT 'event.props.k' AS key, v AS value FROM e WHERE v IS NOT NULL UNION ALL SELECT 'event.type', event_type FROM e UNION ALL SELECT 'list.0', '1' FROM e UNION ALL SELECT 'list.1.a', 'x' FROM e) GROUP BY 1, 2"""),
    "detected_projects": (detected_projects, """WITH f AS (SELECT '/repo/n' || c_nationkey AS root, CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 9 = 0 THEN 'node_modules' WHEN c_custkey % 10 = 0 THEN '.hidden' ELSE 'p' || (c_custkey % 40) END AS folder, c_custkey % 6 = 0 AS deep,
          ['pom.xml', 'package.json', 'README.md', 'build.gradle.kts', 'go.mod', 'setup.py', 'Cargo.toml'][c_custkey % 7 + 1] AS marker FROM customer),
        g AS (SELECT root, CASE WHEN deep AND folder = '' THEN 'src' ELSE folder END AS folder, marker, list_position(['package.json', 'pom.xml', 'build.gradle', 'build.gradle.kts', 'pyproject.toml', 'setup.py', 'go.mod', 'Cargo.toml'], marker) AS p FROM f WHERE (NOT deep OR folder = '') AND folder NOT IN ('node_modules', '.hidden'))
        SELECT root, CASE WHEN folder = '' THEN root ELSE root || '/' || folder END AS path, CASE WHEN folder = '' THEN string_split(root, '/')[-1] ELSE folder END AS name, ['node', 'java', 'java', 'kotlin', 'python', 'python', 'go', 'rust'][min(p)] AS language, arg_min(marker, p) AS marker FROM g WHERE p IS NOT NULL GROUP BY root, folder"""),
    "reviewed": (reviewed, with_tables("""SELECT 'candidate ' || st AS what, count(*) AS n FROM z GROUP BY st UNION ALL SELECT 'relation', (SELECT count(*) FROM mk) UNION ALL SELECT 'evidence', (SELECT count(*) FROM (SELECT DISTINCT k.rid, z.id, t FROM z JOIN k ON k.s = z.subject_id AND k.o = z.object_id, unnest(ts) u(t) WHERE act = 'APPROVED'))
          UNION ALL SELECT 'approved call:' || l_linestatus, count(*) FILTER (WHERE act = 'APPROVED') FROM z WHERE tax <> 0 AND act IS NOT NULL GROUP BY l_linestatus UNION ALL SELECT 'rejected call:' || l_linestatus, count(*) FILTER (WHERE act = 'REJECTED') FROM z WHERE tax <> 0 AND act IS NOT NULL GROUP BY l_linestatus""",
        "z0 AS (SELECT *, CASE WHEN confidence >= 0.98 THEN 'REJECTED' WHEN confidence >= 0.95 THEN 'APPROVED' WHEN confidence >= 0.92 THEN 'REJECTED' END AS act, list_concat([CASE WHEN l_linestatus = 'O' THEN 'FILE' ELSE 'CONFIG' END], CASE WHEN l_returnflag = 'N' THEN ['SCHEMA'] ELSE [] END) AS ts FROM candidates)",
        "z AS (SELECT *, coalesce(act, CASE WHEN tax = 0 THEN 'REJECTED' ELSE 'PENDING' END) AS st FROM z0)",
        "dp AS (SELECT subject_id AS s, object_id AS o, min(id) AS rid FROM relations WHERE relation_type = 'depend_on' GROUP BY 1, 2)",
        "mk AS (SELECT subject_id AS s, object_id AS o, 'R-' || min(id) AS rid FROM z WHERE act = 'APPROVED' AND NOT EXISTS (SELECT 1 FROM dp WHERE dp.s = subject_id AND dp.o = object_id) GROUP BY 1, 2)",
        "k AS (SELECT * FROM dp UNION ALL SELECT * FROM mk)")),
    "cutover_decision": (cutover_decision, with_tables("""SELECT bp AS baseline_predicted, bt AS baseline_true_positives, bp - bt AS baseline_false_positives, n - bt AS baseline_false_negatives, b_p AS baseline_precision, b_r AS baseline_recall, cp AS candidate_predicted, ct AS candidate_true_positives, cp - ct AS candidate_false_positives, n - ct AS candidate_false_negatives,
          c_p AS candidate_precision, c_r AS candidate_recall, round(c_p - b_p, 4) AS precision_delta, round(c_r - b_r, 4) AS recall_delta, cp - bp AS approval_delta, concat_ws(',', CASE WHEN round(c_p - b_p, 4) < -0.02 THEN 'precision' END, CASE WHEN round(c_r - b_r, 4) < 0 THEN 'recall' END) AS failed,
          CASE WHEN round(c_p - b_p, 4) < -0.02 OR round(c_r - b_r, 4) < 0 THEN 'NO_GO' ELSE 'GO' END AS decision FROM (SELECT *, round(bt / bp, 4) AS b_p, round(bt / n, 4) AS b_r, round(ct / cp, 4) AS c_p, round(ct / n, 4) AS c_r FROM c)""",
        "tr AS (SELECT DISTINCT subject_id, object_id FROM relations WHERE relation_type = 'depend_on')", "cd AS (SELECT subject_id, object_id, max(confidence) AS top, EXISTS (SELECT 1 FROM tr WHERE tr.subject_id = c.subject_id AND tr.object_id = c.object_id) AS good FROM candidates c GROUP BY 1, 2)",
        "c AS (SELECT count(*) FILTER (WHERE top >= 0.97) AS bp, count(*) FILTER (WHERE top >= 0.97 AND good) AS bt, count(*) FILTER (WHERE top >= 0.93) AS cp, count(*) FILTER (WHERE top >= 0.93 AND good) AS ct, (SELECT count(*) FROM tr) AS n FROM cd)")),
    "evidence_recut": (evidence_recut, with_tables("""SELECT l_partkey, place, evidence_id, round(confidence, 6) AS confidence FROM (SELECT l_partkey, 1 - l_tax AS confidence, l_orderkey * 1000 + rn AS evidence_id, row_number() OVER (PARTITION BY l_partkey ORDER BY 1 - l_tax DESC, round(l_quantity * (1 - l_tax), 9) DESC, l_quantity DESC, l_linenumber, l_orderkey * 1000 + rn) AS place FROM lines WHERE 1 - l_tax >= 0.93) WHERE place <= 3""")),
    "domain_scenarios": (domain_scenarios, """WITH p AS (SELECT page_id % 5 AS d, 'http' AS t, CASE WHEN page_id % 3 = 0 THEN 'POST ' ELSE 'GET ' END || regexp_extract(url, '://[^/]+(/[a-z]+/[0-9]{0,1})', 1) AS k, page_id AS entry, page_id AS seq, page_id % 40 AS ev FROM pages WHERE page_id >= 3
        UNION ALL SELECT n_regionkey, 'consume', event_type || '-' || hour(ts), user_id, event_id, event_id % 40 FROM events JOIN supplier ON s_suppkey = user_id JOIN nation ON n_nationkey = s_nationkey WHERE value >= 60 AND event_type NOT IN ('purchase', 'signup')),
        g AS (SELECT d, t, k, min(seq) AS seq, arg_min(entry, (seq, entry)) AS entry, count(DISTINCT ev) AS evidences FROM p GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY t DESC, seq, k) AS place FROM g)
        SELECT d AS domain_id, place, k || CASE t WHEN 'http' THEN ' request' ELSE ' message' END AS title, t AS trigger, entry AS entry_id, evidences FROM r WHERE place <= 5"""),
    "domain_profile": (domain_profile, with_tables("SELECT t.domain_id, object_type, members, avg_affinity, coalesce(o, 0) AS edges_out, coalesce(i, 0) AS edges_in FROM t LEFT JOIN x ON x.domain_id = t.domain_id",
        "m AS (SELECT * FROM affinities WHERE affinity >= 0.2)",
        "t AS (SELECT domain_id, object_type, count(*) AS members, " + avg6_sql("affinity") + " AS avg_affinity FROM (SELECT domain_id, 'service' AS object_type, affinity FROM m UNION ALL SELECT domain_id, 'api_endpoint', affinity FROM m JOIN objects o ON o.parent_id = m.object_id AND o.object_type = 'api_endpoint') GROUP BY 1, 2)",
        "dd AS (SELECT DISTINCT subject_id, object_id FROM relations WHERE relation_type = 'depend_on')",
        "x AS (SELECT d.domain_id, count(*) FILTER (WHERE s AND NOT b) AS o, count(*) FILTER (WHERE b AND NOT s) AS i FROM (SELECT DISTINCT domain_id FROM m) d, (SELECT * FROM dd) e, LATERAL (SELECT EXISTS (SELECT 1 FROM m WHERE m.domain_id = d.domain_id AND m.object_id = e.subject_id) AS s, EXISTS (SELECT 1 FROM m WHERE m.domain_id = d.domain_id AND m.object_id = e.object_id) AS b) GROUP BY 1)")),
}
