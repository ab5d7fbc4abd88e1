"""Queries on domains: membership, cohesion, clusters, names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataweave.functions.scalars import NAME_SUFFIXES, exact_avg, name_tokens, r6
from strataweave.operators import domain
from strataweave.plans.rollups import s2s_of
from strataweave.sources.graph_tables import GraphTables, avg6_sql, with_tables

SUFFIXES = ", ".join(f"'{x}'" for x in NAME_SUFFIXES)
PRIMARY = "prime AS (SELECT object_id, arg_min(domain_id, (-affinity, domain_id)) AS domain_id, max(affinity) AS affinity FROM affinities GROUP BY 1)"


def primary_domain(spark, sf_dir):
    return domain.primary(GraphTables(spark, sf_dir).affinities())


def affinity_normalize(spark, sf_dir):
    out = domain.normalised(GraphTables(spark, sf_dir).affinities())
    return out.withColumn("share", r6(F.col("share"))).withColumn("purity", r6(F.col("purity")))


def domain_list(spark, sf_dir):
    """Every domain with its members, their average affinity and how many belong to it first."""
    g = GraphTables(spark, sf_dir)
    a = g.affinities()
    first = domain.primary(a).groupBy("domain_id").agg(F.count(F.lit(1)).alias("primary_members"))
    sums = a.groupBy("domain_id").agg(F.count(F.lit(1)).alias("members"), r6(exact_avg(F.col("affinity"))).alias("avg_affinity"))
    rows = g.objects().where("object_type = 'domain'").select(F.col("id").alias("domain_id"), "name")
    return rows.join(sums, "domain_id", "left").join(first, "domain_id", "left").na.fill(0, ["members", "primary_members"])


def domain_summary(spark, sf_dir):
    """Inner edges among a domain's primary members and their density."""
    g = GraphTables(spark, sf_dir)
    p = domain.primary(g.affinities())
    n = p.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"))
    e = s2s_of(g).select("subject_id", "object_id").distinct()
    e = e.join(p.select(F.col("object_id").alias("subject_id"), F.col("domain_id").alias("x")), "subject_id").join(p.select("object_id", F.col("domain_id").alias("y")), "object_id").where("x = y")
    inner = e.groupBy(F.col("x").alias("domain_id")).agg(F.count(F.lit(1)).alias("inner_edges"))
    rows = n.join(inner, "domain_id", "left").na.fill(0, ["inner_edges"])
    return rows.select("domain_id", "n", "inner_edges", r6(F.when(F.col("n") > 1, F.col("inner_edges") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)).alias("density"))


def domain_top_members(spark, sf_dir):
    """The five members of highest affinity of each domain: a ranked window whose limit Spark applies before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("domain_id").orderBy(F.desc("affinity"), "object_id"))
    return GraphTables(spark, sf_dir).affinities().withColumn("place", rank).where("place <= 5").select("domain_id", F.col("place").cast("long").alias("place"), "object_id", "affinity")


def implementing_services(spark, sf_dir):
    """Endpoints of a service, by the region of its callers: which domains a service works for."""
    g = GraphTables(spark, sf_dir)
    kids = g.objects().where("object_type = 'api_endpoint'").select("id", "parent_id")
    callers = g.relations().where("relation_type = 'call' and status = 'APPROVED'").join(domain.primary(g.affinities()).select(F.col("object_id").alias("subject_id"), "domain_id"), "subject_id")
    out = domain.implementing_services(kids, callers.select(F.col("object_id").alias("id"), "domain_id").distinct())
    return out.withColumn("ratio", r6(F.col("ratio")))


def cohesion(spark, sf_dir):
    g = GraphTables(spark, sf_dir)
    e = s2s_of(g).select(F.concat_ws("|", "relation_type", "subject_id", "object_id").alias("id"), "subject_id", "object_id")
    return domain.cohesion(e, domain.primary(g.affinities())).withColumn("cohesion", r6(F.col("cohesion")))


def structural_clusters(spark, sf_dir):
    """Parts grouped by the tokens of their names."""
    parts = GraphTables(spark, sf_dir).source("part").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    return domain.structural_clusters(parts)


def name_jaccard(spark, sf_dir):
    """Part names that share tokens, with the Jaccard similarity of their names; pairs meet on tokens."""
    t = GraphTables(spark, sf_dir).source("part").select(F.col("p_name").alias("a")).distinct().withColumn("ta", name_tokens(F.col("a")))
    left = t.withColumn("tok", F.explode("ta"))
    right = t.select(F.col("a").alias("b"), F.col("ta").alias("tb")).withColumn("tok", F.explode("tb"))
    pairs = left.join(right, "tok").where("a < b").select("a", "b", "ta", "tb").distinct()
    return pairs.select("a", "b", r6(F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))).alias("jaccard"))


def fuzzy_domain(spark, sf_dir):
    """For each nation or region name the best other name, by fuzzy score."""
    g = GraphTables(spark, sf_dir)
    names = g.source("nation").select(F.lower("n_name").alias("name")).union(g.source("region").select(F.lower("r_name"))).distinct()
    rows = domain.fuzzy_pairs(names, names).withColumn("score", domain.fuzzy_score(F.col("word"), F.col("name")))
    return rows.where("word <> name and score > 0").groupBy("word").agg(F.max_by(F.struct("name", "score"), F.struct("score", F.col("name"))).alias("b")).select("word", "b.name", F.col("b.score").cast("long").alias("score"))


def affinity_upsert(spark, sf_dir):
    """Affinities after services with a debt were rated anew: sure of their own domain, and new in the one four after it."""
    g = GraphTables(spark, sf_dir)
    s = g.source("supplier").where("s_acctbal < 0").join(F.broadcast(g.source("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nation: 25 rows at every scale
    rated = s.select("s_suppkey", "n_regionkey", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(0.95).alias("a")), F.struct(F.lit(4).alias("k"), F.lit(0.25).alias("a")))).alias("x"))
    new = rated.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("object_id"), F.concat(F.lit("D"), ((F.col("n_regionkey") + F.col("x.k")) % 5).cast("string")).alias("domain_id"), F.col("x.a").alias("affinity"))
    return domain.upsert_affinities(g.affinities(), new)


def domain_scope(spark, sf_dir):
    """Members of every domain's scope and the service edges inside it, by relation type."""
    g = GraphTables(spark, sf_dir)
    inside = domain.scope_edges(s2s_of(g).select("relation_type", "subject_id", "object_id", "edge_weight"), g.affinities())
    return inside.groupBy("domain_id", "relation_type").agg(F.count(F.lit(1)).alias("edges"), F.sum("edge_weight").alias("weight"))


def table_domains(spark, sf_dir):
    """Customer names, read as table names, by the domain that their prefix names; domains are the market segments and order words."""
    g = GraphTables(spark, sf_dir)
    c = g.source("customer")
    tables = c.select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit("_"), "c_custkey").alias("table_name"))
    domains = c.select(F.col("c_mktsegment").alias("name")).distinct().where("name <> 'BUILDING'").withColumn("domain_id", F.concat(F.lit("d-"), F.lower("name"))).union(spark.range(1).select(F.lit("build").alias("name"), F.lit("d-build").alias("domain_id")))
    found = domain.table_domains(tables, domains)
    return found.groupBy("domain_id").agg(F.count(F.lit(1)).alias("tables")).select("domain_id", "tables", (F.col("tables") / F.max("tables").over(Window.partitionBy(F.lit(1)))).alias("score")).withColumn("score", r6(F.col("score")))


def collaborators(spark, sf_dir):
    g = GraphTables(spark, sf_dir)
    return domain.collaborators(s2s_of(g).select("relation_type", "subject_id", "object_id"), domain.primary(g.affinities()))


ENTRIES = {
    "primary_domain": (primary_domain, with_tables("SELECT object_id, domain_id, affinity FROM prime", PRIMARY)),
    "affinity_normalize": (affinity_normalize, with_tables("""SELECT object_id, domain_id, round(share, 6) AS share, round(max(share) OVER (PARTITION BY object_id), 6) AS purity,
        CASE WHEN row_number() OVER (PARTITION BY object_id ORDER BY affinity DESC, domain_id) = 1 THEN 'primary' WHEN share >= 0.25 THEN 'secondary' ELSE '' END AS role
        FROM (SELECT *, affinity / sum(affinity) OVER (PARTITION BY object_id) AS share FROM affinities)""")),
    "domain_list": (domain_list, with_tables("""SELECT o.id AS domain_id, o.name, (SELECT count(*) FROM affinities a WHERE a.domain_id = o.id) AS members, (SELECT """ + avg6_sql("affinity") + """ FROM affinities a WHERE a.domain_id = o.id) AS avg_affinity,
        (SELECT count(*) FROM prime p WHERE p.domain_id = o.id) AS primary_members FROM objects o WHERE object_type = 'domain'""", PRIMARY)),
    "domain_summary": (domain_summary, with_tables("""SELECT domain_id, n, coalesce(i, 0) AS inner_edges, CASE WHEN n > 1 THEN round(coalesce(i, 0) / (n * (n - 1)), 6) ELSE 0.0 END AS density
        FROM (SELECT domain_id, count(*) AS n FROM prime GROUP BY 1) LEFT JOIN (SELECT x.domain_id, count(*) AS i FROM (SELECT DISTINCT subject_id, object_id FROM s2s) e JOIN prime x ON x.object_id = e.subject_id JOIN prime y ON y.object_id = e.object_id WHERE x.domain_id = y.domain_id GROUP BY 1) USING (domain_id)""", PRIMARY)),
    "domain_top_members": (domain_top_members, with_tables("SELECT domain_id, place, object_id, affinity FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY affinity DESC, object_id) AS place FROM affinities) WHERE place <= 5")),
    "implementing_services": (implementing_services, with_tables("""SELECT parent_id AS service_id, domain_id, in_domain, total, round(in_domain / total, 6) AS ratio FROM
        (SELECT parent_id, domain_id, count(DISTINCT o.id) AS in_domain FROM objects o JOIN relations r ON r.object_id = o.id AND r.relation_type = 'call' AND r.status = 'APPROVED' JOIN prime p ON p.object_id = r.subject_id WHERE object_type = 'api_endpoint' GROUP BY ALL)
        JOIN (SELECT parent_id, count(*) AS total FROM objects WHERE object_type = 'api_endpoint' GROUP BY 1) USING (parent_id)""", PRIMARY)),
    "cohesion": (cohesion, with_tables("""SELECT p.domain_id, member, count(*) FILTER (WHERE p.domain_id = q.domain_id) AS inner_relations, count(*) AS all_relations, round(count(*) FILTER (WHERE p.domain_id = q.domain_id) / count(*), 6) AS cohesion FROM
        (SELECT subject_id AS member, object_id AS other FROM s2s UNION ALL SELECT object_id, subject_id FROM s2s WHERE subject_id <> object_id) JOIN prime p ON p.object_id = member LEFT JOIN prime q ON q.object_id = other GROUP BY ALL""", PRIMARY)),
    "structural_clusters": (structural_clusters, f"""WITH t AS (SELECT 'T' || p_partkey AS object_id, list_distinct(list_filter(string_split_regex(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: len(x) >= 2 AND x NOT IN ({SUFFIXES}))) AS tokens FROM part),
        s AS (SELECT object_id, unnest(tokens) AS slug, 0.55 / len(tokens) AS score FROM t), k AS (SELECT * FROM s WHERE score >= 0.2)
        SELECT slug, object_id, floor(score * 1000 + 0.5) / 1000 AS score, members FROM k JOIN (SELECT slug, count(*) AS members FROM k GROUP BY 1 HAVING count(*) >= 2) USING (slug)"""),
    "name_jaccard": (name_jaccard, f"""WITH t AS (SELECT a, list_distinct(list_filter(string_split_regex(lower(a), '[^a-z0-9]+'), lambda x: len(x) >= 2 AND x NOT IN ({SUFFIXES}))) AS t FROM (SELECT DISTINCT p_name AS a FROM part))
        SELECT x.a, y.a AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard FROM t x JOIN t y ON x.a < y.a WHERE len(list_intersect(x.t, y.t)) > 0"""),
    "fuzzy_domain": (fuzzy_domain, """WITH n AS (SELECT lower(n_name) AS name FROM nation UNION SELECT lower(r_name) FROM region),
        s AS (SELECT w.name AS word, n.name, CASE WHEN starts_with(n.name, w.name) THEN 85 WHEN contains(n.name, w.name) THEN 70 WHEN levenshtein(w.name, n.name) <= 2 THEN 60 ELSE 0 END AS score FROM n w JOIN n ON w.name <> n.name)
        SELECT word, arg_max(name, (score, name)) AS name, CAST(max(score) AS BIGINT) AS score FROM s WHERE score > 0 GROUP BY 1"""),
    "affinity_upsert": (affinity_upsert, with_tables("""SELECT object_id, domain_id, coalesce(n.affinity, a.affinity)::DOUBLE AS affinity, n.affinity IS NOT NULL AS changed FROM affinities a FULL JOIN (
        SELECT 'S' || s_suppkey AS object_id, 'D' || ((n_regionkey + k) % 5) AS domain_id, CASE k WHEN 0 THEN 0.95 ELSE 0.25 END AS affinity FROM supplier JOIN nation ON s_nationkey = n_nationkey, (VALUES (0), (4)) t(k) WHERE s_acctbal < 0) n USING (object_id, domain_id)""")),
    "domain_scope": (domain_scope, with_tables("""SELECT x.domain_id, relation_type, count(*) AS edges, CAST(sum(edge_weight) AS BIGINT) AS weight FROM s2s JOIN affinities x ON x.object_id = subject_id AND x.affinity >= 0.2
        JOIN affinities y ON y.object_id = s2s.object_id AND y.affinity >= 0.2 AND y.domain_id = x.domain_id GROUP BY ALL""")),
    "table_domains": (table_domains, """WITH t AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'd-build' ELSE 'd-' || lower(c_mktsegment) END AS domain_id, count(*) AS tables FROM customer GROUP BY 1)
        SELECT domain_id, tables, round(tables / max(tables) OVER (), 6) AS score FROM t"""),
    "collaborators": (collaborators, with_tables("""SELECT domain_id, direction, relation_type, count(*) AS n FROM (
        SELECT x.domain_id, 'OUT' AS direction, relation_type FROM s2s JOIN prime x ON x.object_id = subject_id JOIN prime y ON y.object_id = s2s.object_id WHERE x.domain_id <> y.domain_id
        UNION ALL SELECT y.domain_id, 'IN', relation_type FROM s2s JOIN prime x ON x.object_id = subject_id JOIN prime y ON y.object_id = s2s.object_id WHERE x.domain_id <> y.domain_id) GROUP BY ALL""", PRIMARY)),
}
