"""Domain discovery: membership, cohesion, clustering by seeds, fuzzy names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.scalars import name_tokens, round_half_up
from strataweave.operators.texts import holding_pairs


def primary(affinities: DataFrame) -> DataFrame:
    """The domain of highest affinity of each object; on ties the least domain id."""
    return affinities.groupBy("object_id").agg(F.min_by(F.struct("domain_id", "affinity"), F.struct(-F.col("affinity"), F.col("domain_id"))).alias("p")).select("object_id", "p.domain_id", "p.affinity")


def normalised(affinities: DataFrame, secondary: float = 0.25) -> DataFrame:
    """share of each domain in an object's affinities, purity (the largest share) and whether it is primary or secondary."""
    w = Window.partitionBy("object_id")
    rank = F.row_number().over(w.orderBy(F.desc("affinity"), "domain_id"))
    out = affinities.withColumn("total", F.sum("affinity").over(w)).withColumn("place", rank)
    out = out.withColumn("share", F.when(F.col("total") > 0, F.col("affinity") / F.col("total")).otherwise(0.0))
    role = F.when(F.col("place") == 1, "primary").when(F.col("share") >= secondary, "secondary").otherwise("")
    return out.withColumn("purity", F.max("share").over(w)).select("object_id", "domain_id", "share", "purity", role.alias("role"))


def implementing_services(children: DataFrame, members: DataFrame) -> DataFrame:
    """service_id, domain_id, in_domain, total, ratio for services with children (parent_id, id) in a domain."""
    totals = children.groupBy("parent_id").agg(F.count(F.lit(1)).alias("total"))
    inside = children.join(members, "id").groupBy("parent_id", "domain_id").agg(F.count(F.lit(1)).alias("in_domain"))
    return inside.join(totals, "parent_id").select(F.col("parent_id").alias("service_id"), "domain_id", "in_domain", "total", (F.col("in_domain") / F.col("total")).alias("ratio"))


def cohesion(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Per member the share of its relations that stay in its domain; a self relation counts once."""
    ends = relations.select("id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("member"), "subject_id", "object_id")
    other = F.when(F.col("member") == F.col("subject_id"), F.col("object_id")).otherwise(F.col("subject_id"))
    m = members.select(F.col("object_id").alias("member"), "domain_id")
    n = members.select(F.col("object_id").alias("other"), F.col("domain_id").alias("other_domain"))
    rows = ends.withColumn("other", other).select("member", "other").join(m, "member").join(n, "other", "left")
    inner = F.count_if(F.col("domain_id") == F.col("other_domain"))
    return rows.groupBy("domain_id", "member").agg(inner.alias("inner_relations"), F.count(F.lit(1)).alias("all_relations")).withColumn("cohesion", F.col("inner_relations") / F.col("all_relations"))


def structural_clusters(objects: DataFrame, weight: float = 0.55, least: float = 0.2, smallest: int = 2) -> DataFrame:
    """slug, object_id, score: objects that share name tokens; seeds meet objects by an equi-join on tokens.

    The score is weight divided by the number of the object's tokens; scores under ``least`` go, and so do
    clusters of fewer than ``smallest`` members.
    """
    tokens = objects.select(F.col("id").alias("object_id"), name_tokens(F.col("name")).alias("tokens"))
    rows = tokens.select("object_id", F.explode("tokens").alias("slug"), F.size("tokens").alias("n")).withColumn("score", F.lit(weight) / F.col("n")).where(F.col("score") >= least)
    sizes = rows.groupBy("slug").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= smallest)
    return rows.join(sizes, "slug").select("slug", "object_id", round_half_up(F.col("score"), 3).alias("score"), "members")


def fuzzy_score(query: Column, name: Column) -> Column:
    """100 equal, 85 prefix, 70 contained, 60 within two edits, else 0; both lower case."""
    q, n = F.lower(query), F.lower(name)
    return F.when(q == n, 100).when(n.startswith(q), 85).when(n.contains(q), 70).when(F.levenshtein(q, n) <= 2, 60).otherwise(0)


def _edits(name: Column) -> Column:
    """The name and all that is left of it without one or two letters."""
    less = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    one = F.when(F.length(name) > 1, less(name)).otherwise(F.array(F.lit("")))
    two = F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 1, less(x)).otherwise(F.array(F.lit("")))))
    return F.array_distinct(F.concat(F.array(name), one, two))


def fuzzy_pairs(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name) of all pairs that fuzzy_score can rate above 0, by equi-joins: names that hold the word, and pairs within two edits, which share a form with one or two letters left out."""
    held = holding_pairs(words.withColumnRenamed("name", "word"), "word", names, "name").where(F.contains("name", F.col("word")))
    form = lambda df, c: df.select("name", F.explode(_edits(F.col("name"))).alias("form")).withColumnRenamed("name", c)
    close = form(words, "word").join(form(names, "name"), "form")
    return held.select("word", "name").union(close.select("word", "name")).distinct()


def table_domains(tables: DataFrame, domains: DataFrame) -> DataFrame:
    """tables with domain_id: the domain (name, domain_id) that the part of table_name before its first '_' names, or else holds or is held by; least id of several.

    Prefixes meet names by equi-joins on parts of them, once for each distinct prefix.
    """
    prefix = F.lower(F.regexp_extract("table_name", "^([^_]+|_.*)", 1))
    keyed = tables.withColumn("prefix", prefix)
    d, p = domains.select(F.lower("name").alias("name"), "domain_id"), keyed.select("prefix").where("prefix <> ''").distinct()
    pairs = holding_pairs(p, "prefix", d, "name").join(d, "name").withColumn("loose", F.col("name") != F.col("prefix"))
    best = pairs.groupBy("prefix").agg(F.min_by("domain_id", F.struct("loose", "domain_id")).alias("domain_id"))
    return keyed.join(best, "prefix").drop("prefix")


def collaborators(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Relations that cross a domain's border: domain_id, direction, relation_type, n."""
    s = members.select(F.col("object_id").alias("subject_id"), F.col("domain_id").alias("from_domain"))
    o = members.select("object_id", F.col("domain_id").alias("to_domain"))
    rows = relations.join(s, "subject_id").join(o, "object_id").where("from_domain <> to_domain")
    ends = rows.select("relation_type", F.explode(F.array(F.struct(F.col("from_domain").alias("domain_id"), F.lit("OUT").alias("direction")), F.struct(F.col("to_domain").alias("domain_id"), F.lit("IN").alias("direction")))).alias("e"))
    return ends.groupBy("e.domain_id", "e.direction", "relation_type").agg(F.count(F.lit(1)).alias("n"))


def upsert_affinities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Affinities (object_id, domain_id, affinity) after new ones arrive: a new one takes the place of the old one of its pair."""
    n = new.groupBy("object_id", "domain_id").agg(F.max("affinity").alias("fresh"))
    return old.join(n, ["object_id", "domain_id"], "full").select("object_id", "domain_id", F.coalesce("fresh", "affinity").alias("affinity"), F.col("fresh").isNotNull().alias("changed"))


def scope_edges(edges: DataFrame, affinities: DataFrame, least: float = 0.2) -> DataFrame:
    """domain_id with each edge between two of its members of affinity ``least`` or more."""
    m = affinities.where(F.col("affinity") >= least).select("domain_id", "object_id")
    rows = edges.join(m.withColumnRenamed("object_id", "subject_id"), "subject_id")
    return rows.join(m, ["domain_id", "object_id"], "left_semi")
