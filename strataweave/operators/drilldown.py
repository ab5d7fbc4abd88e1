"""What stands behind an edge: contributors by scope, group and page, relations of an object with names, and search by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.scalars import cursor
from strataweave.operators.texts import held_parts
from strataweave.sources.scratch import stored

#: Groups of a page if none or too many are asked for, the affinity that makes a member, and what is left out unless asked otherwise.
PAGE, MOST, MEMBER, LEFT_OUT = 20, 100, 0.2, ("expose",)


def label(o: str = "") -> Column:
    return F.coalesce(*[F.col(f"{o}{c}") for c in ("display_name", "name", "id")])


def offset_of(token: Column) -> Column:
    """The offset that a page token holds; 0 for none, or for one that is no token."""
    plain = F.translate(F.coalesce(token, F.lit("")), "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), (4 - F.length(plain) % 4) % 4))
    return F.greatest(F.lit(0), F.coalesce(F.try_to_binary(padded, F.lit("base64")).cast("string").try_cast("int"), F.lit(0)))


#: The reach of what lies below an object by its path, or is it: within any threshold.
INSIDE = float("inf")


def holders(objects: DataFrame, affinities: DataFrame, roots: DataFrame) -> DataFrame:
    """id, holds: those of roots (root_id) that hold each object, as an array of (root_id, reach). A domain holds the services that belong to it, with all below them, as far as their
    affinity reaches; any other object holds all below it. Each object knows its ancestors by its path, so all meet by equi-joins; itself is left to ``held``."""
    above = objects.select("id", F.explode(F.array_distinct(F.filter(F.concat(F.split("path", "/"), F.array("id")), lambda s: s != ""))).alias("root_id"))
    domains = objects.where("object_type = 'domain'").select(F.col("id").alias("root_id")).distinct()
    plain = above.where("root_id <> id").join(domains, "root_id", "left_anti").select("id", "root_id", F.lit(INSIDE).alias("reach"))
    member = affinities.withColumnRenamed("domain_id", "root_id").join(domains, "root_id", "left_semi").groupBy("object_id", "root_id").agg(F.max("affinity").cast("double").alias("reach"))
    inner = above.withColumnRenamed("root_id", "object_id").join(member, "object_id").select("id", "root_id", "reach")
    most = plain.unionByName(inner).groupBy("id", "root_id").agg(F.max("reach").alias("reach"))
    return most.where("root_id <> id").join(roots, "root_id", "left_semi").groupBy("id").agg(F.collect_list(F.struct("root_id", "reach")).alias("holds"))


def held(df: DataFrame, at: str, holding: DataFrame, root: str, reach: str) -> DataFrame:
    """A row for each object that holds the one in column ``at``, and for itself."""
    own = F.array(F.struct(F.col(at).alias("root_id"), F.lit(INSIDE).alias("reach")))
    rows = df.join(holding.withColumnRenamed("id", at), at, "left")
    return rows.withColumn("h", F.explode(F.concat(F.coalesce("holds", F.array().cast("array<struct<root_id:string,reach:double>>")), own))).select(*df.columns, F.col("h.root_id").alias(root), F.col("h.reach").alias(reach))


def contributors(requests: DataFrame, relations: DataFrame, objects: DataFrame, affinities: DataFrame, evidences: DataFrame) -> DataFrame:
    """A row a group of each request's page: request_id, place, group_key, group_label, weight, evidence_count, total, next_cursor (null: the last page).

    requests: request_id, source_id, target_id, group_by (relationType, sourceAtomic, targetAtomic, else the target's compound), scope_mode (SUBTREE or GLOBAL: from anywhere),
    relation_types and excluded_types (arrays; null: all, and expose), threshold, page_size, cursor (a next_cursor). All requests run as one job.

    What requests ask for is counted once for all that ask for it: first by ends, threshold and grouping, a cell a type of relation; then by types; pages only pick places.
    """
    sized = lambda c: F.coalesce(F.col(c), F.lit(None).cast("array<string>"))
    r = requests.withColumn("threshold", F.coalesce("threshold", F.lit(MEMBER)).cast("double")).withColumn("excluded", F.coalesce(sized("excluded_types"), F.array(*map(F.lit, LEFT_OUT))))
    r = r.withColumn("page_size", F.greatest(F.lit(1), F.least(F.lit(MOST), F.coalesce("page_size", F.lit(PAGE))))).withColumn("page_offset", offset_of(F.col("cursor")))
    r = r.withColumn("grouping", F.when(F.col("group_by").isin("relationType", "sourceAtomic", "targetAtomic"), F.col("group_by")).otherwise("targetCompound")).withColumn("anywhere", F.col("scope_mode").eqNullSafe("GLOBAL"))
    wide = F.coalesce(F.size("relation_types"), F.lit(0)).isin(0, -1)
    r = r.withColumn("types", F.when(~wide, F.array_sort(F.array_distinct("relation_types"))).otherwise(F.array().cast("array<string>"))).withColumn("excluded", F.array_sort(F.array_distinct("excluded")))
    r = r.withColumn("ends", F.to_json(F.struct(F.when(~F.col("anywhere"), F.col("source_id")), F.col("target_id"), F.col("threshold"), F.col("grouping"), "anywhere"))).withColumn("asked", F.to_json(F.struct("ends", "types", "excluded")))
    r = stored(r, "requests")
    ends = r.select("ends", "source_id", "target_id", "threshold", "grouping", "anywhere").dropDuplicates(["ends"])
    ends = stored(ends.withColumn("end_no", F.monotonically_increasing_id()), "ends")  # a number is carried, not the text

    seen = evidences.select("id", "relation_id").repartition("relation_id").distinct().groupBy("relation_id").agg(F.count(F.lit(1)).alias("k"))
    live = relations.where("status = 'APPROVED'").select(F.col("id").alias("relation_id"), "relation_type", "subject_id", "object_id").dropDuplicates(["relation_id"]).join(seen, "relation_id", "left")
    sums = lambda weight, k: (F.sum(weight).alias("weight"), F.coalesce(F.sum(k), F.lit(0)).alias("k"))
    pairs = stored(live.groupBy("relation_type", "subject_id", "object_id").agg(*sums(F.lit(1), "k")), "pairs")
    holding = lambda some, end: stored(holders(objects, affinities, some.select(F.col(end).alias("root_id")).distinct()), "holders")
    root = objects.select(F.col("id").alias("object_id"), F.element_at(F.filter(F.split("path", "/"), lambda s: s != ""), 1).alias("compound"))

    def cells(rows: DataFrame, key: Column) -> DataFrame:
        return rows.groupBy("end_no", "relation_type", key.alias("group_key")).agg(*sums("weight", "k"))

    target = F.when(F.col("grouping") == "relationType", F.col("relation_type")).when(F.col("grouping") == "sourceAtomic", F.col("subject_id")).when(F.col("grouping") == "targetAtomic", F.col("object_id")).otherwise(F.coalesce("compound", "object_id"))
    # From a source: its few relations first, then whether the target holds their other ends.
    some = ends.where(~F.col("anywhere"))
    below = held(pairs, "subject_id", holding(some, "source_id"), "source_id", "source_reach").join(some, "source_id").where("source_reach >= threshold")
    below = below.select("end_no", "grouping", "threshold", F.col("target_id").alias("wanted"), "relation_type", "subject_id", "object_id", "weight", "k")
    below = held(below, "object_id", holding(some, "target_id"), "target_id", "target_reach").where("target_id = wanted and target_reach >= threshold").join(root, "object_id", "left")

    def far(rows: DataFrame, grouped: Column) -> DataFrame:
        some = ends.where(F.col("anywhere") & grouped)
        return held(rows, "object_id", holding(some, "target_id"), "target_id", "target_reach").join(some.drop("source_id"), "target_id").where("target_reach >= threshold")

    # From anywhere: sources are summed up before targets fan out, but where they are the groups.
    by_source = F.col("grouping") == "sourceAtomic"
    summed = pairs.groupBy("relation_type", "object_id").agg(*sums("weight", "k")).join(root, "object_id", "left").withColumn("subject_id", F.lit(None).cast("string"))
    found = cells(below, target).unionByName(cells(far(pairs, by_source), F.col("subject_id"))).unionByName(cells(far(summed, ~by_source), target))

    kinds = r.select("asked", "ends", "types", "excluded").dropDuplicates(["asked"]).join(ends.select("ends", "end_no"), "ends")
    fits = ~F.array_contains("excluded", F.col("relation_type")) & ((F.size("types") == 0) | F.array_contains("types", F.col("relation_type")))
    groups = stored(found.join(kinds, "end_no").where(fits).groupBy("asked", "group_key").agg(*sums("weight", "k")), "groups")
    totals = groups.groupBy("asked").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("all"))
    placed = groups.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("weight"), "group_key")))
    end = F.col("page_offset").cast("long") + F.col("page_size")
    asked = r.join(totals, "asked").withColumn("last", F.least(end, F.col("all"))).where("page_offset < last")
    places = asked.select("request_id", "asked", "grouping", "page_offset", "page_size", "total", "all", F.explode(F.sequence(F.col("page_offset").cast("long") + 1, "last")).alias("place"))
    page = places.join(placed, ["asked", "place"])
    names = objects.select(F.col("id").alias("group_key"), label().alias("named"))
    return page.join(names, "group_key", "left").select(
        "request_id", F.col("place").cast("long").alias("place"), "group_key", F.when(F.col("grouping") == "relationType", F.col("group_key")).otherwise(F.coalesce("named", "group_key")).alias("group_label"),
        "weight", F.col("k").alias("evidence_count"), "total", F.when(end < F.col("all"), cursor(end)).alias("next_cursor"),
    )


def related(relations: DataFrame, objects: DataFrame) -> DataFrame:
    """id, direction (INBOUND, OUTBOUND), relation_id, relation_type, status, other_id, other_label: every object's relations with the name of the other end; a relation of an object with itself is in both."""
    ends = relations.select(F.explode(F.array(
        F.struct(F.col("subject_id").alias("id"), F.lit("OUTBOUND").alias("direction"), F.col("object_id").alias("other_id"), F.col("id").alias("relation_id"), "relation_type", "status"),
        F.struct(F.col("object_id").alias("id"), F.lit("INBOUND").alias("direction"), F.col("subject_id").alias("other_id"), F.col("id").alias("relation_id"), "relation_type", "status"),
    )).alias("e")).select("e.*")
    return ends.join(objects.select(F.col("id").alias("other_id"), label().alias("named")), "other_id", "left").select("id", "direction", "relation_id", "relation_type", "status", "other_id", F.coalesce("named", "other_id").alias("other_label"))


def find_objects(objects: DataFrame, asked: DataFrame, block: int = 1000) -> DataFrame:
    """request_id, object_id, match (exact, part or first), n: the object that a name means. asked: request_id, text, object_type (null: any).

    An equal name, else a name that holds the text (in it % and _ are themselves), letter case aside, else the first object; of several the least name, then id.
    Distinct names are cut into their parts of the lengths that texts have, ``block`` lengths at a time, which meet the distinct texts by an equi-join.
    """
    low = lambda c: F.lower(F.trim(c))
    o = objects.select("object_type", F.struct(label().alias("label"), F.col("id").alias("object_id")).alias("first")).withColumn("low", low("first.label"))
    names = stored(o.groupBy("object_type", "low").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")), "names")
    q = stored(asked.select("request_id", low("text").alias("text"), "object_type"), "asked")
    found = held_parts(names.select("low"), "low", q.select("text"), "text", block)
    hits = names.join(found, "low").groupBy("text", F.col("object_type").alias("kind")).agg(F.sum("n").alias("n"), F.min(F.struct((F.col("low") != F.col("text")).alias("partly"), "first.label", "first.object_id")).alias("best"))
    first = names.groupBy(F.col("object_type").alias("kind")).agg(F.min("first").alias("first"))
    every = q.join(first, F.expr("object_type is null or object_type = kind"))  # a row a type of object
    rows = every.join(hits, ["text", "kind"], "left")
    sums = rows.groupBy("request_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("best").alias("best"), F.min("first").alias("first"))
    return sums.select("request_id", F.coalesce("best.object_id", "first.object_id").alias("object_id"), F.when(F.col("best").isNull(), "first").when(F.col("best.partly"), "part").otherwise("exact").alias("match"), "n")
