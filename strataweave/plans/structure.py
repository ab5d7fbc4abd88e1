"""Queries on symbols, line owners, parents, approvals, evidence pools and split domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions.scalars import r6
from strataweave.operators import hierarchy, seeding, symbols
from strataweave.sources.graph_tables import GraphTables, with_tables
from strataweave.sources.scratch import stored

S, METHOD = lambda c: F.concat(F.lit("S"), F.col(c).cast("string")), lambda c: F.concat(F.lit("m"), (F.col(c) % 3).cast("string"))


def call_targets(spark, sf_dir):
    """What a call of each nation (an interface) reaches: its richer suppliers implement it, order lines call on, some of them through the nation of the next supplier."""
    g = GraphTables(spark, sf_dir)
    suppliers = g.source("supplier")
    nation = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("nation"))
    steps = g.lines().where("rn > 1 and l_discount = 0.1 and l_returnflag = 'N'").join(nation, "l_suppkey")
    nested = steps.select(S("a_supp").alias("type"), METHOD("rn").alias("method"), F.when(F.col("l_linestatus") == "O", F.col("nation")).otherwise(S("l_suppkey")).alias("to_type"), METHOD("l_linenumber").alias("to_method")).distinct()
    direct = g.source("lineitem").where("l_returnflag = 'R' and l_tax = 0").select(S("l_suppkey").alias("type"), METHOD("l_linenumber").alias("method"), F.concat(F.lit("E"), F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("target")).distinct()
    faces = g.source("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("type"))
    implements = suppliers.where("s_acctbal > 8000").select(S("s_suppkey").alias("class"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("interface"))
    starts = faces.select("type", F.explode(F.array(*[F.lit(f"m{k}") for k in range(3)])).alias("method")).withColumn("start", F.concat_ws(".", "type", "method"))
    out = symbols.resolve_calls(starts, implements, faces, nested, direct, 3)
    return out.groupBy("start", "target").agg(F.min("depth").cast("long").alias("depth"), F.min(F.struct("penalty", "impl")).alias("p"), F.count(F.lit(1)).alias("ways")).select("start", "target", "depth", r6(F.col("p.penalty")).alias("penalty"), F.col("p.impl").alias("impl"), "ways")


def implementation_map(spark, sf_dir):
    """How many rich suppliers each nation has, and the only one if there is one."""
    suppliers = GraphTables(spark, sf_dir).source("supplier").where("s_acctbal > 8000")
    return symbols.implementations(suppliers.select(S("s_suppkey").alias("class"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("interface")))


def line_owners(spark, sf_dir):
    """A part's time is a file and a day a line: returned lines are functions of as many days as pieces, and each other line belongs to the innermost."""
    lines = GraphTables(spark, sf_dir).source("lineitem").withColumn("day", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long"))
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    functions = lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("file"), key.alias("function_id"), F.col("day").alias("line_start"), (F.col("day") + F.col("l_quantity").cast("long") * 20).alias("line_end"))
    points = lines.where("l_returnflag <> 'R'").groupBy(F.col("l_partkey").alias("file"), F.col("day").alias("line")).agg(F.count(F.lit(1)).alias("signals"))
    return symbols.owners(points, functions).select("file", "line", "signals", "function_id")


def _tree(g: GraphTables):
    """Orders below customers below nations below regions; customers in debt are not there."""
    def level(df, prefix, key, parent):
        up = F.concat(F.lit(parent[0]), F.col(parent[1]).cast("string")) if parent else F.lit(None).cast("string")
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit("service" if prefix == "N" else "part").alias("object_type"), up.alias("parent_id"))

    out = level(g.source("region"), "R", "r_regionkey", None)
    for df, prefix, key, parent in ((g.source("nation"), "N", "n_nationkey", ("R", "n_regionkey")), (g.source("customer").where("c_acctbal >= 0"), "C", "c_custkey", ("N", "c_nationkey")), (g.source("orders"), "O", "o_orderkey", ("C", "o_custkey"))):
        out = out.unionByName(level(df, prefix, key, parent))
    return out


def root_of_parents(spark, sf_dir):
    """The last ancestor of every order, customer, nation and region that is there."""
    return hierarchy.roots_by_parent(_tree(GraphTables(spark, sf_dir)))


def selected_scope_closure(spark, sf_dir):
    """Nations of the first region, all below them, and the parts that their orders hold."""
    g = GraphTables(spark, sf_dir)
    selected = g.source("nation").where("n_regionkey = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"))
    holds = g.source("lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("subject_id"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("object_id"))
    return hierarchy.selected_objects(_tree(g), holds, selected)


def inherited_intents(spark, sf_dir):
    """How many intents (events of a user as a service) each service and endpoint has, its own and inherited ones."""
    g = GraphTables(spark, sf_dir)
    objects = g.objects().where("object_type in ('service', 'api_endpoint')")
    intents = g.source("events").select(F.col("event_id").alias("intent_id"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("user_id").cast("string"), F.lit(":1"))).otherwise(S("user_id")).alias("source_id"))
    return hierarchy.inherited(intents, objects).groupBy("object_id").agg(F.count(F.lit(1)).alias("intents"), F.min("intent_id").alias("first_intent"))


def approved_domain(spark, sf_dir):
    """Implements edges after domain D0 was approved with other members: only services of members that left or came are built again; the SQL builds all."""
    g = GraphTables(spark, sf_dir)
    objects = stored(g.objects().where("object_type in ('service', 'api_endpoint')").select("id", "object_type", "parent_id"), "objects")
    e = objects.where("object_type = 'api_endpoint'").select(F.col("id").alias("object_id"), F.regexp_extract("id", "^E([0-9]+)", 1).cast("long").alias("s"), F.regexp_extract("id", ":([0-9]+)$", 1).cast("long").alias("l"))
    ranked = F.array(F.struct(F.concat(F.lit("D"), ((F.col("s") + F.col("l")) % 5).cast("string")).alias("domain_id"), F.lit(0.9).alias("affinity")), F.struct(F.concat(F.lit("D"), ((F.col("s") + F.col("l") + 1 + F.col("l") % 3) % 5).cast("string")).alias("domain_id"), F.lit(0.4).alias("affinity")))
    affinities = stored(e.select("object_id", F.explode(ranked).alias("x")).select("object_id", "x.*"), "affinities")
    members = e.where("l <= 2 and s % 3 <> 0").select("object_id", F.when(F.col("l") == 1, 0.95).otherwise(0.5).alias("affinity"))
    edges = stored(hierarchy.implements(objects, affinities), "implements")
    return hierarchy.approve_members(objects, affinities, "D0", members, edges)[2].withColumn("confidence", r6(F.col("confidence")))


def _evidence(g: GraphTables):
    """Order lines as evidence: the part's brand is the file, the line's place and quantity the lines; the service acts on the part's type."""
    lines = g.lines().join(g.source("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    return lines.select(F.when(F.col("l_returnflag") != "N", F.col("p_brand")).alias("file"), F.col("rn").cast("long").alias("line_start"), (F.col("rn") + F.col("l_quantity")).cast("long").alias("line_end"), S("l_suppkey").alias("source_id"), F.col("p_type").alias("action"), F.col("l_suppkey").alias("service"))


def evidence_pool(spark, sf_dir):
    """Distinct places of evidence, each once."""
    return hierarchy.evidence_pool(_evidence(GraphTables(spark, sf_dir)))


def evidence_sets(spark, sf_dir):
    """Of each service and action the evidence: how much, and the least id."""
    return hierarchy.pooled_sets(_evidence(GraphTables(spark, sf_dir)), "service", "action").groupBy("service", "action").agg(F.count("evidence_id").alias("evidences"), F.min("evidence_id").alias("first_id"))


def split_domains(spark, sf_dir):
    """Parts of each brand split by a table of selectors (name, words in the name, type as a route), and how cohesive each part's members are by the orders that join them."""
    g = GraphTables(spark, sf_dir)
    p = g.source("part")
    seeds = F.array(F.concat(F.lit("name:"), "p_name"), F.concat(F.lit("class:"), F.substring_index("p_name", " ", -1)), F.concat(F.lit("route:/"), F.lower("p_type"), F.lit("/"), F.col("p_size").cast("string")))
    members = p.select(F.col("p_brand").alias("cluster_id"), F.col("p_partkey").alias("object_id"), F.explode(seeds).alias("source"))
    brands = p.select(F.col("p_brand").alias("cluster_id"), F.when(F.length("p_brand") > 7, "bolt").otherwise("ring").alias("word")).distinct()
    one = lambda part, kind, value: F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), value.alias("value"))
    selectors = brands.select("cluster_id", F.explode(F.array(one(1, "object_name", F.concat(F.lit("red "), "word")), one(2, "class_name", F.col("word")), one(3, "route_prefix", F.lit("/economy")), one(4, "seed_source", F.lit("blue")))).alias("x")).select("cluster_id", "x.*")
    parts = stored(hierarchy.split_members(members, selectors), "parts")
    lines = g.lines().select("l_orderkey", "rn", F.col("l_partkey").alias("object_id"))
    follows = lines.select("l_orderkey", (F.col("rn") - 1).alias("rn"), F.col("object_id").alias("next"))
    relations = lines.join(follows, ["l_orderkey", "rn"]).select(F.col("object_id").alias("subject_id"), F.col("next").alias("object_id"))
    return hierarchy.part_cohesion(parts, relations).select("cluster_id", F.col("part").cast("long").alias("part"), "object_id", r6(F.col("cohesion")).alias("cohesion"))


def _seeded(g: GraphTables):
    """Parts as tables and functions with names, paths, classes, files, packages, routes and topics made of their words."""
    k, p = F.col("p_partkey"), g.source("part")
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    kind = F.lower("p_type")
    objects = p.select(
        k.alias("id"), F.when(k % 2 == 0, "db_table").otherwise("function").alias("object_type"), F.when(k % 2 == 0, F.concat_ws("_", first, second)).otherwise(F.concat(first, F.initcap(second), F.lit("Service"))).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("/api/v1/"), kind, F.lit("/x"))).otherwise(F.concat(F.lit("/app/"), k.cast("string"))).alias("path"), F.when(k % 3 == 1, F.concat(F.initcap(second), F.lit("Core"), F.initcap(kind), F.lit("Dao"))).alias("class_name"),
        F.when(k % 5 == 0, F.concat(F.lit("/src/"), second, F.lit("/"), F.initcap(first), F.lit("Mapper.java"))).alias("file_path"),
    )
    artifacts = p.where("p_partkey % 4 = 0").select(k.alias("object_id"), F.lit(None).cast("string").alias("file_path"), F.concat(F.when(k % 8 == 0, "com.acme.").otherwise("x.io."), kind, F.lit("."), second).alias("package"))
    intents = p.where("p_partkey % 6 < 2").select(k.alias("object_id"), F.when(k % 6 == 0, F.concat(F.lit("/api/"), first, F.lit("/list/{id}/"), k.cast("string"), F.lit("/"), second)).alias("route"), F.when(k % 6 == 1, F.concat(kind, F.lit("."), first)).alias("topic"))
    return stored(objects, "objects"), artifacts, intents


def seed_slugs(spark, sf_dir):
    """How many parts bear each slug, by the kind of seed."""
    return seeding.seeds(*_seeded(GraphTables(spark, sf_dir))).groupBy("slug", "source").agg(F.count(F.lit(1)).alias("objects"), F.min("object_id").alias("first_id"))


def seeded_clusters(spark, sf_dir):
    """The members of each slug's cluster with their affinity by all eight kinds of seeds."""
    objects, artifacts, intents = _seeded(GraphTables(spark, sf_dir))
    return seeding.clusters(objects, seeding.seeds(objects, artifacts, intents))


LISTED = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
SEEDED = f"""w AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b, lower(p_type) AS t FROM part),
sd0 AS (SELECT k, unnest(CASE WHEN k % 3 = 0 THEN [t] ELSE [CAST(k AS VARCHAR)] END) AS slug, 'path' AS source FROM w UNION ALL SELECT k, unnest([a, b]), 'name' FROM w UNION ALL SELECT k, unnest([b, 'core', t]), 'class' FROM w WHERE k % 3 = 1 UNION ALL SELECT k, a, 'file' FROM w WHERE k % 5 = 0
  UNION ALL SELECT k, unnest([a, b]), 'table' FROM w WHERE k % 2 = 0 UNION ALL SELECT k, unnest([t, b]), 'package' FROM w WHERE k % 4 = 0 UNION ALL SELECT k, unnest([a, b]), 'route' FROM w WHERE k % 6 = 0 UNION ALL SELECT k, t, 'topic' FROM w WHERE k % 6 = 1),
sd AS (SELECT DISTINCT k AS object_id, slug, source FROM sd0 WHERE slug NOT IN {LISTED(seeding.LOW_VALUE)} AND length(slug) >= 2)"""
TREE = """tree AS (SELECT 'R' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders)"""
PLACE = "substr(sha1(file || ':' || line_start || '-' || line_end), 1, 16)"
EVIDENCE = """ev AS (SELECT CASE WHEN l_returnflag <> 'N' THEN p_brand END AS file, rn AS line_start, CAST(rn + l_quantity AS BIGINT) AS line_end, 'S' || l_suppkey AS source_id, p_type AS action, l_suppkey AS service FROM lines JOIN part ON p_partkey = l_partkey)"""

ENTRIES = {
    "call_targets": (call_targets, with_tables("SELECT start, target, CAST(min(depth) AS BIGINT) AS depth, min(penalty) / 10 AS penalty, arg_min(impl, (penalty, impl IS NOT NULL, impl)) AS impl, count(*) AS ways FROM (SELECT DISTINCT start, target, depth, impl, amb, penalty FROM walk JOIN dc ON dc.type = walk.type AND dc.method = walk.method) GROUP BY 1, 2",
        "nst AS (SELECT DISTINCT 'S' || a_supp AS type, 'm' || (rn % 3) AS method, CASE WHEN l_linestatus = 'O' THEN 'N' || s_nationkey ELSE 'S' || l_suppkey END AS to_type, 'm' || (l_linenumber % 3) AS to_method FROM lines JOIN supplier ON s_suppkey = l_suppkey WHERE rn > 1 AND l_discount = 0.1 AND l_returnflag = 'N')",
        "dc AS (SELECT DISTINCT 'S' || l_suppkey AS type, 'm' || (l_linenumber % 3) AS method, 'E' || l_suppkey || ':' || l_linenumber AS target FROM lineitem WHERE l_returnflag = 'R' AND l_tax = 0)",
        "im AS (SELECT 'N' || s_nationkey AS face, 'S' || s_suppkey AS cls, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier WHERE s_acctbal > 8000)",
        """walk AS (SELECT 'N' || n_nationkey || '.m' || k AS start, cls AS type, 'm' || k AS method, 1 AS depth, cls AS impl, n > 1 AS amb, CASE WHEN n > 1 THEN 1 ELSE 0 END AS penalty FROM nation, range(3) r(k), im WHERE face = 'N' || n_nationkey
          UNION SELECT start, coalesce(cls, to_type), to_method, depth + 1, coalesce(cls, impl), CASE WHEN cls IS NULL THEN amb ELSE n > 1 END, penalty + CASE WHEN n > 1 THEN 1 ELSE 0 END FROM walk JOIN nst ON nst.type = walk.type AND nst.method = walk.method LEFT JOIN im ON face = to_type WHERE depth < 3 AND (to_type[1] = 'S' OR cls IS NOT NULL))""")),
    "implementation_map": (implementation_map, "SELECT 'N' || s_nationkey AS interface, count(*) AS n, CASE WHEN count(*) = 1 THEN min('S' || s_suppkey) END AS only FROM supplier WHERE s_acctbal > 8000 GROUP BY 1"),
    "line_owners": (line_owners, """WITH l AS (SELECT *, datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS day FROM lineitem), f AS (SELECT l_partkey AS file, l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS id, day AS a, day + CAST(l_quantity AS BIGINT) * 20 AS b FROM l WHERE l_returnflag = 'R'),
        p AS (SELECT l_partkey AS file, day AS line, count(*) AS signals FROM l WHERE l_returnflag <> 'R' GROUP BY 1, 2)
        SELECT p.file, line, any_value(signals) AS signals, arg_min(id, (-a, b, id)) AS function_id FROM p LEFT JOIN f ON f.file = p.file AND line BETWEEN a AND b GROUP BY 1, 2"""),
    "root_of_parents": (root_of_parents, f"WITH RECURSIVE {TREE}, up AS (SELECT id, id AS here FROM tree UNION ALL SELECT up.id, t.parent_id FROM up JOIN tree t ON t.id = up.here WHERE t.parent_id IN (SELECT id FROM tree)) SELECT up.id, here AS root_id FROM up JOIN tree t ON t.id = here WHERE t.parent_id IS NULL OR t.parent_id NOT IN (SELECT id FROM tree)"),
    "selected_scope_closure": (selected_scope_closure, f"WITH RECURSIVE {TREE}, d AS (SELECT 'N' || n_nationkey AS id FROM nation WHERE n_regionkey = 0 UNION SELECT t.id FROM tree t JOIN d ON t.parent_id = d.id) SELECT id FROM d UNION SELECT 'T' || l_partkey FROM lineitem WHERE 'O' || l_orderkey IN (SELECT id FROM d)"),
    "inherited_intents": (inherited_intents, with_tables("SELECT object_id, count(DISTINCT intent_id) AS intents, min(intent_id) AS first_intent FROM (SELECT intent_id, source_id AS object_id FROM it UNION ALL SELECT intent_id, c.id FROM it JOIN objects s ON s.id = source_id AND s.object_type = 'service' JOIN objects c ON c.parent_id = s.id AND c.object_type = 'api_endpoint') GROUP BY 1",
        "it AS (SELECT event_id AS intent_id, CASE WHEN event_type = 'error' THEN 'E' || user_id || ':1' ELSE 'S' || user_id END AS source_id FROM events)")),
    "approved_domain": (approved_domain, """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS l FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)),
        a AS (SELECT s, l, (s + l) % 5 AS d, 0.9::DOUBLE AS w FROM e UNION ALL SELECT s, l, (s + l + 1 + l % 3) % 5, 0.4 FROM e),
        b AS (SELECT * FROM a WHERE d <> 0 UNION ALL SELECT s, l, 0, CASE WHEN l = 1 THEN 0.95 ELSE 0.5 END FROM e WHERE l <= 2 AND s % 3 <> 0),
        f AS (SELECT s, l, arg_min(d, (-w, d)) AS d FROM b GROUP BY 1, 2), t AS (SELECT s, count(*) AS total FROM e GROUP BY 1)
        SELECT 'S' || f.s AS service_id, 'D' || d AS domain_id, count(*) AS in_domain, any_value(total) AS total, round(count(*) / any_value(total), 6) AS confidence FROM f JOIN t ON t.s = f.s GROUP BY f.s, d"""),
    "evidence_pool": (evidence_pool, with_tables(f"SELECT 'ev-' || {PLACE} AS evidence_id, file, line_start, line_end, min(source_id) AS source_id FROM ev WHERE file IS NOT NULL GROUP BY ALL", EVIDENCE)),
    "evidence_sets": (evidence_sets, with_tables(f"SELECT service, action, count(DISTINCT 'ev-' || {PLACE}) AS evidences, min('ev-' || {PLACE}) AS first_id FROM ev GROUP BY 1, 2", EVIDENCE)),
    "split_domains": (split_domains, with_tables("""SELECT m.cluster_id, m.part, m.object_id, round(CASE WHEN count(o.b) = 0 THEN 0 ELSE count(k.object_id) / count(o.b) END, 6) AS cohesion FROM m LEFT JOIN o ON o.a = m.object_id LEFT JOIN m k ON k.object_id = o.b AND k.cluster_id = m.cluster_id AND k.part IS NOT DISTINCT FROM m.part GROUP BY 1, 2, 3""",
        "w AS (SELECT *, CASE WHEN length(p_brand) > 7 THEN 'bolt' ELSE 'ring' END AS word FROM part)",
        "m AS (SELECT p_brand AS cluster_id, p_partkey AS object_id, CASE WHEN lower(p_name) = 'red ' || word THEN 1 WHEN contains(string_split(p_name, ' ')[-1], word) THEN 2 WHEN lower(p_type) = 'economy' THEN 3 WHEN contains(lower(p_name), 'blue') THEN 4 END::BIGINT AS part FROM w)",
        "fl AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY rn) AS b FROM lines)",
        "o AS (SELECT a, b FROM fl WHERE b IS NOT NULL UNION ALL SELECT b, a FROM fl WHERE b IS NOT NULL)")),
    "seed_slugs": (seed_slugs, f"WITH {SEEDED} SELECT slug, source, count(*) AS objects, min(object_id) AS first_id FROM sd GROUP BY 1, 2"),
    "seeded_clusters": (seeded_clusters, f"""WITH {SEEDED}, f AS (SELECT object_id, slug, bool_or(source = 'path')::INT AS p, bool_or(source = 'route')::INT AS r, bool_or(source = 'topic')::INT AS o, bool_or(source IN ('class', 'file', 'package'))::INT AS c, bool_or(source = 'table')::INT AS t, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM sd GROUP BY 1, 2),
        n AS (SELECT f.*, CASE WHEN slug IN (a, b) THEN 1 / len(list_distinct([a, b])) ELSE 0 END AS j FROM f JOIN w ON w.k = object_id),
        x AS (SELECT slug, object_id, sources, CASE WHEN object_id % 2 = 0 THEN 0.05 * p + 0.2 * r + 0.1 * o + 0.15 * j + 0.1 * c + 0.4 * t ELSE 0.1 * p + 0.3 * r + 0.2 * o + 0.15 * j + 0.2 * c + 0.05 * t END AS a FROM n)
        SELECT slug, object_id, round(a::DOUBLE, 3) AS affinity, sources FROM x WHERE round(a, 9) >= 0.2"""),
}
