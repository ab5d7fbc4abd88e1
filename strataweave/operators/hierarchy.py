"""Parents: root ancestors, closures of selected services, intents that children inherit, and derived edges after an approval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.sources.scratch import stored


def roots_by_parent(objects: DataFrame) -> DataFrame:
    """id and root_id: the last ancestor that exists, by pointer jumping: each round doubles how far a pointer reaches.

    An object whose parent is null or not there is its own root. Objects on a cycle or below one have the least id of the cycle as root.
    """
    ids = objects.select(F.col("id").alias("up")).distinct()
    edges = objects.select("id", F.col("parent_id").alias("up")).join(ids, "up", "left_semi")
    # up: as far as the pointer reaches; low: the least id on the way there, itself left out; done: it stands on a root.
    live = objects.select("id").distinct().join(edges.groupBy("id").agg(F.min("up").alias("up")), "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.coalesce("up", "id").alias("low"))
    live, count = stored(live, "pointers"), None
    size = live.count()
    for _ in range(max(1, size.bit_length())):
        further = live.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("next_low"))
        moved = stored(live.join(further, "up").select("id", F.col("next").alias("up"), F.least("low", "next_low").alias("low")), "pointers")
        now = moved.join(live.select("id", F.col("up").alias("was"), F.col("low").alias("was_low")), "id").where("up <> was or low <> was_low").limit(1).count()
        live = moved
        if not now:
            break
    # On a root the pointer stands still; on a cycle it does not, and after as many steps as there are objects low is the least id of the cycle.
    fixed = objects.select("id").distinct().join(edges.select("id").distinct(), "id", "left_anti").select(F.col("id").alias("up"), F.lit(True).alias("fixed"))
    cycle = live.select(F.col("id").alias("up"), F.col("low").alias("cycle_low"))
    return live.join(fixed, "up", "left").join(cycle, "up", "left").select("id", F.when(F.col("fixed"), F.col("up")).otherwise(F.col("cycle_low")).alias("root_id"))


def closure(objects: DataFrame, selected: DataFrame, rounds: int = 64) -> DataFrame:
    """id of the selected objects and all below them; a level a round, until nothing is added. Each round joins only what the one before added."""
    seen = stored(selected.select("id").distinct(), "scope")
    new = seen
    for _ in range(rounds):
        found = objects.join(new.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id").distinct().join(seen, "id", "left_anti")
        new = stored(found, "scope-new")
        if new.isEmpty():
            return seen
        seen = stored(seen.unionByName(new), "scope")
    raise ValueError(f"objects lie deeper than {rounds} levels")


def selected_objects(objects: DataFrame, relations: DataFrame, selected: DataFrame) -> DataFrame:
    """id of the selected services, all below them, and what their relations point at, but no other services."""
    scope = closure(objects, selected)
    targets = relations.join(scope.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").select(F.col("object_id").alias("id")).distinct()
    services = objects.where("object_type = 'service'").select("id")
    return scope.unionByName(targets.join(services, "id", "left_anti")).distinct()


def inherited(intents: DataFrame, objects: DataFrame, types: tuple[str, ...] = ("function", "api_endpoint")) -> DataFrame:
    """intent_id and object_id: an intent's source, and where that is a service its children of some types."""
    own = intents.select("intent_id", F.col("source_id").alias("object_id"))
    services = objects.where("object_type = 'service'").select(F.col("id").alias("source_id"))
    children = objects.where(F.col("object_type").isin(*types)).select(F.col("parent_id").alias("source_id"), F.col("id").alias("object_id"))
    passed = intents.join(services, "source_id", "left_semi").join(children, "source_id").select("intent_id", "object_id")
    return own.unionByName(passed).distinct()


CODE = ("function", "api_endpoint")


def implements(objects: DataFrame, affinities: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """service_id, domain_id, in_domain, total, confidence: the share of a service's code children whose first domain (greatest affinity, then least id) it is."""
    children = objects.where(F.col("object_type").isin(*CODE) & F.col("parent_id").isNotNull()).select(F.col("id").alias("object_id"), F.col("parent_id").alias("service_id"))
    children = children.join(objects.where("object_type = 'service'").select(F.col("id").alias("service_id")), "service_id", "left_semi")
    if services is not None:
        children = children.join(services, "service_id", "left_semi")
    total = children.groupBy("service_id").agg(F.count(F.lit(1)).alias("total"))
    first = affinities.join(children, "object_id").groupBy("service_id", "object_id").agg(F.min(F.struct((-F.col("affinity")).alias("a"), "domain_id")).alias("f"))
    sums = first.groupBy("service_id", F.col("f.domain_id").alias("domain_id")).agg(F.count(F.lit(1)).alias("in_domain"))
    return sums.join(total, "service_id").select("service_id", "domain_id", "in_domain", "total", (F.col("in_domain") / F.col("total")).alias("confidence"))


def approve_members(objects: DataFrame, affinities: DataFrame, domain_id: str, members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Affinities, touched services, and implements edges after a domain's members were approved.

    members: object_id, affinity. Members that are not named again leave the domain; others get the new affinity. Only services with a child that was or
    is a member are built again, from their own children alone; all other edges stay as they are.
    """
    before = affinities.where(F.col("domain_id") == domain_id)
    now = members.groupBy("object_id").agg(F.max("affinity").alias("affinity")).select("object_id", F.lit(domain_id).alias("domain_id"), "affinity")
    after = stored(affinities.where(F.col("domain_id") != domain_id).unionByName(now), "affinities")
    moved = before.select("object_id").unionByName(now.select("object_id")).distinct()
    services = objects.where("object_type = 'service'").select(F.col("id").alias("service_id"))
    touched = stored(objects.join(moved.withColumnRenamed("object_id", "id"), "id", "left_semi").select(F.col("parent_id").alias("service_id")).distinct().join(services, "service_id", "left_semi"), "touched")
    built = implements(objects.join(touched.withColumnRenamed("service_id", "parent_id"), "parent_id", "left_semi").unionByName(objects.where("object_type = 'service'")), after, touched)
    return after, touched, edges.join(touched, "service_id", "left_anti").unionByName(built)


def evidence_pool(evidences: DataFrame) -> DataFrame:
    """evidence_id, file, line_start, line_end, source_id: equal places are one evidence, with an id from its content and the least source; evidence without a file is none."""
    place = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("line_start", "line_end")]
    key = F.concat(F.col("file"), F.lit(":"), place[0], F.lit("-"), place[1])
    return evidences.where("file is not null and file <> ''").groupBy(F.concat(F.lit("ev-"), F.substring(F.sha1(key.cast("binary")), 1, 16)).alias("evidence_id"), "file", "line_start", "line_end").agg(F.min("source_id").alias("source_id"))


def pooled_sets(evidences: DataFrame, *key: str) -> DataFrame:
    """key and evidence_id: the union of the evidence of all that share a key, a row an id, so that no row gathers a set; keys without evidence have one row with null."""
    place = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("line_start", "line_end")]
    id_ = F.concat(F.lit("ev-"), F.substring(F.sha1(F.concat(F.col("file"), F.lit(":"), place[0], F.lit("-"), place[1]).cast("binary")), 1, 16))
    rows = evidences.select(*key, F.when(F.col("file") != "", id_).alias("evidence_id")).distinct()
    some = rows.where("evidence_id is not null")
    return some.unionByName(rows.where("evidence_id is null").join(some.select(*key).distinct(), list(key), "left_anti"))


KINDS = ("seed_source", "route_prefix", "object_name", "class_name", "file_path", "table_name")


def split_members(members: DataFrame, selectors: DataFrame) -> DataFrame:
    """cluster_id, object_id, part: the first suggestion (least ``part``) of the member's cluster with a selector that takes it, null for the rest.

    members: cluster_id, object_id, source ('kind:value', a row a seed). selectors: cluster_id, part, kind, value. Names and routes meet by an equi-join;
    texts that a source must hold meet the sources of their own cluster and kind only.
    """
    source = F.lower("source")
    m = stored(members.select("cluster_id", "object_id", source.alias("source"), F.substring_index(source, ":", 1).alias("seed"), F.regexp_extract(source, "^[a-z]+:/*([^/]*)", 1).alias("head")).distinct(), "members")
    s = selectors.select("cluster_id", "part", "kind", F.lower(F.trim("value")).alias("value")).where("value <> ''").distinct()
    pair = ["cluster_id", "object_id", "part"]
    named = m.join(s.where("kind = 'object_name'").withColumn("source", F.concat(F.lit("name:"), "value")), ["cluster_id", "source"]).select(pair)
    routed = m.where("seed = 'route'").join(s.where("kind = 'route_prefix'").withColumn("head", F.regexp_extract("value", "^/*([^/]*)", 1)).where("head <> ''"), ["cluster_id", "head"]).select(pair)
    holding = s.where(F.col("kind").isin("class_name", "file_path", "table_name")).withColumn("seed", F.element_at(F.create_map(F.lit("class_name"), F.lit("class"), F.lit("file_path"), F.lit("file"), F.lit("table_name"), F.lit("table")), F.col("kind")))
    held = m.join(holding, ["cluster_id", "seed"]).where("contains(source, value)").select(pair)
    anywhere = m.join(s.where("kind = 'seed_source'"), "cluster_id").where("contains(source, value)").select(pair)
    first = named.unionByName(routed).unionByName(held).unionByName(anywhere).groupBy("cluster_id", "object_id").agg(F.min("part").alias("part"))
    return m.select("cluster_id", "object_id").distinct().join(first, ["cluster_id", "object_id"], "left")


def part_cohesion(members: DataFrame, relations: DataFrame) -> DataFrame:
    """cluster_id, part, object_id, cohesion: of a member's relations (subject_id, object_id) the share whose other end is in the same part (null part: the rest); 0 without any."""
    ends = relations.select(F.col("subject_id").alias("object_id"), F.col("object_id").alias("other")).unionByName(relations.select("object_id", F.col("subject_id").alias("other")))
    mine = members.select("cluster_id", F.coalesce("part", F.lit(-1)).alias("part"), "object_id")
    rows = mine.join(ends, "object_id", "left").join(mine.withColumnRenamed("object_id", "other").withColumn("inside", F.lit(1)), ["cluster_id", "part", "other"], "left")
    sums = rows.groupBy("cluster_id", "part", "object_id").agg(F.count("other").alias("all"), F.count("inside").alias("in"))
    return sums.select("cluster_id", F.when(F.col("part") >= 0, F.col("part")).alias("part"), "object_id", F.when(F.col("all") > 0, F.col("in") / F.col("all")).otherwise(0.0).alias("cohesion"))
