"""Domain seeds of all kinds, and the clusters that they span."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.scalars import NAME_SUFFIXES
from strataweave.operators.targets import weighted_affinity

#: Words that say nothing of a domain, in names, in routes, at the start of packages, and as segments of paths; and the types of objects that are tables.
LOW_VALUE = ("robot", "core", "mgt", "mgmt", "robotcore", "rb")
ROUTE_LOW_VALUE = (*LOW_VALUE, "get", "post", "put", "delete", "patch", "options", "head", "any", "id", "ids", "list", "show", "index", "home")
NAMESPACES = ("com", "org", "net", "io", "dev", "app", "co", "kr", "jp", "uk", "us")
NO_DOMAIN = ("api", "apis", "rest", "graphql", "gql", "rpc", "grpc", "public", "internal", "private", "app", "web")
TABLE_TYPES = ("db_table", "db_view", "database_table", "table")
HANGUL = "가-힣"


def slug_of(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), f"[^a-z0-9{HANGUL}]", "")


def useful(slug: Column, low: tuple[str, ...] = LOW_VALUE) -> Column:
    return (slug != "") & ~slug.isin(*low) & ((F.length(slug) >= 2) | slug.rlike(f"[{HANGUL}]"))


def tokens(name: Column) -> Column:
    """Tokens of a name of two letters or more, without the endings that say nothing."""
    parts = F.transform(F.split(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), r"[\s_\-./]+"), slug_of)
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*NAME_SUFFIXES)))


def _some(slugs: Column, low: tuple[str, ...] = LOW_VALUE) -> Column:
    return F.filter(slugs, lambda s: useful(s, low))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.startswith(":") & ~s.startswith("{"))


def _plain(segment: Column) -> Column:
    return F.lower(segment).isin(*NO_DOMAIN) | segment.rlike(r"(?i)^v\d+$")


def path_slugs(path: Column) -> Column:
    """The first segment that can name a domain, else the last one."""
    segs = _segments(path)
    named = F.filter(segs, lambda s: ~_plain(s))
    return _some(F.filter(F.array(slug_of(F.coalesce(F.get(named, F.lit(0)), F.get(segs, F.size(segs) - 1)))), lambda s: s.isNotNull()))


def route_slugs(route: Column) -> Column:
    slugs = F.transform(F.filter(_segments(route), lambda s: ~_plain(s)), slug_of)
    return F.array_distinct(F.filter(_some(slugs, ROUTE_LOW_VALUE), lambda s: ~s.rlike(r"^\d+$")))


def package_slugs(package: Column) -> Column:
    """Segments behind the namespace and its owner ('com.acme.'), but no namespace words, nor a short first one."""
    slugs = F.transform(F.split(package, "[./]"), slug_of)
    start = F.when(slugs[0].isin(*NAMESPACES), F.least(F.lit(2), F.size(slugs) - 1)).otherwise(0)
    placed = F.transform(slugs, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    kept = F.filter(placed, lambda x: (x["i"] >= start) & useful(x["s"]) & ~x["s"].isin(*NAMESPACES) & ~((x["i"] == 0) & (F.length(x["s"]) <= 3)))
    return F.transform(kept, lambda x: x["s"])


def file_slugs(path: Column) -> Column:
    name = F.element_at(F.filter(F.split(path, "/"), lambda s: s != ""), -1)
    return _some(tokens(F.regexp_replace(name, r"\.[^.]+$", "")))


def seeds(objects: DataFrame, artifacts: DataFrame, intents: DataFrame) -> DataFrame:
    """object_id, slug, source (path, name, class, file, package, table, route, topic), distinct. objects: id, object_type, name, path, class_name, file_path. artifacts: object_id,
    file_path, package. intents: object_id (inherited ones too), route, topic. Fields may be null."""
    o = objects.withColumnRenamed("id", "object_id")
    table = F.when(F.lower("object_type").isin(*TABLE_TYPES) & F.col("name").contains("_"), _some(F.transform(F.split("name", "_"), slug_of)))
    first = F.get(F.filter(F.split("topic", r"[.\-_/]"), lambda s: s != ""), F.lit(0))
    kinds = (
        (o, "path", path_slugs(F.col("path"))), (o, "name", _some(tokens(F.col("name")))), (o, "class", _some(tokens(F.col("class_name")))), (o, "file", file_slugs(F.col("file_path"))), (o, "table", table),
        (artifacts, "file", file_slugs(F.col("file_path"))), (artifacts, "package", package_slugs(F.col("package"))), (intents, "route", route_slugs(F.col("route"))), (intents, "topic", _some(F.array_compact(F.array(slug_of(first))))),
    )
    rows = [df.select("object_id", F.explode(slugs).alias("slug"), F.lit(kind).alias("source")) for df, kind, slugs in kinds]
    return reduce(DataFrame.unionByName, rows).distinct()


def clusters(objects: DataFrame, found: DataFrame, threshold: float = 0.2) -> DataFrame:
    """slug, object_id, affinity (three digits), sources: the members of each slug's cluster. An object has an affinity to its own slugs only, so seeds are grouped and no object meets all slugs."""
    has = lambda *kinds: F.max(F.col("source").isin(*kinds).cast("int"))
    rows = found.groupBy("object_id", "slug").agg(*[has(k).alias(k) for k in ("path", "route", "topic", "table")], has("class", "file", "package").alias("code"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    o = objects.select(F.col("id").alias("object_id"), "object_type", tokens(F.col("name")).alias("words"))
    rows = rows.join(o, "object_id")
    like = F.when(F.array_contains("words", F.col("slug")), F.lit(1.0) / F.size("words")).otherwise(0.0)
    affinity = weighted_affinity(F.lower("object_type").isin(*TABLE_TYPES), path=F.col("path"), route=F.col("route"), topic=F.col("topic"), name=like, code=F.col("code"), table=F.col("table"))
    return rows.withColumn("a", affinity).where(F.round("a", 9) >= threshold).select("slug", "object_id", F.round("a", 3).alias("affinity"), "sources")
