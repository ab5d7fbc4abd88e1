"""Candidates laid on what they can mean: endpoints of a service, twin tables, weighted affinities, changed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.texts import holding_pairs

#: What each signal counts towards an affinity, for tables and for all other objects.
DEFAULT_WEIGHTS = {"path": 0.1, "route": 0.3, "topic": 0.2, "name": 0.15, "code": 0.2, "table": 0.05}
TABLE_WEIGHTS = {"path": 0.05, "route": 0.2, "topic": 0.1, "name": 0.15, "code": 0.1, "table": 0.4}


def weighted_affinity(table_like: Column, **signals: Column) -> Column:
    """Signals (0 or 1, name: 0 to 1) by the weights of their kind of object; at most 1, and signals not given count nothing."""
    total = lambda w: sum((s.cast("double") * w[k] for k, s in signals.items()), F.lit(0.0)) / sum(w.values())
    return F.least(F.lit(1.0), F.when(table_like, total(TABLE_WEIGHTS)).otherwise(total(DEFAULT_WEIGHTS)))


def on_endpoints(candidates: DataFrame, endpoints: DataFrame, known: DataFrame, factor: float = 0.85, least: float = 0.5) -> DataFrame:
    """Candidates that name a service, as candidates for each of its endpoints (id, parent_id) that their subject does not call yet.

    One row a pair of services first, its best confidence; an endpoint's is ``factor`` of that, and no less than ``least``.
    """
    best = candidates.groupBy("subject_id", F.col("object_id").alias("service_id")).agg(F.max("confidence").alias("c"))
    rows = best.join(endpoints.select(F.col("id").alias("object_id"), F.col("parent_id").alias("service_id")), "service_id")
    rows = rows.join(known.select("subject_id", "object_id"), ["subject_id", "object_id"], "left_anti")
    return rows.select("subject_id", "object_id", "service_id", F.greatest(F.col("c") * factor, F.lit(least)).alias("confidence"))


def visible(candidates: DataFrame, objects: DataFrame) -> DataFrame:
    """Candidates whose target is no service, with the names of both ends and of the target's parent."""
    name = lambda p: objects.select(F.col("id").alias(f"{p}_id"), F.coalesce("display_name", "name", "id").alias(f"{p}_name"))
    target = objects.select(F.col("id").alias("object_id"), "object_type", F.coalesce("display_name", "name", "id").alias("object_name"), "parent_id")
    rows = candidates.join(target, "object_id", "left").where("object_type is null or object_type <> 'service'")
    return rows.join(name("subject"), "subject_id", "left").join(name("parent"), "parent_id", "left")


def twin_tables(plain: DataFrame, qualified: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of a table without a schema (database, name) and one of its database and name with a schema.

    Confidence .65 for an only sibling and .4 for one of several; pairs that were rejected before stay out.
    """
    key = ["database", "name"]
    q = qualified.select(*key, "schema").distinct()
    siblings = q.groupBy(*key).agg(F.count(F.lit(1)).alias("siblings"))
    rows = plain.select(*key).distinct().join(siblings, key).join(q, key)
    rows = rows.join(rejected.select(*key, "schema"), [*key, "schema"], "left_anti")
    return rows.select(*key, "schema", F.when(F.col("siblings") == 1, 0.65).otherwise(0.4).alias("confidence"))


def schema_hashes(tables: DataFrame) -> DataFrame:
    """database, tables and a hash of the set of its tables' names (lower case): an xor of the names' hashes, so no database gathers its names."""
    names = tables.select("database", F.lower("name").alias("name")).distinct()
    part = F.conv(F.substring(F.sha2("name", 256), 1, 15), 16, 10).cast("long")
    sums = names.groupBy("database").agg(F.count(F.lit(1)).alias("tables"), F.bit_xor(part).alias("x"))
    return sums.select("database", "tables", F.sha2(F.concat_ws("|", "database", "tables", "x"), 256).alias("schema_hash"))


def strip_count(match_path: Column) -> Column:
    """How many leading segments a gateway rule takes off: all fixed ones but the last; null for none."""
    fixed = F.size(F.filter(F.split(F.trim(match_path), "/"), lambda s: (s != "") & ~s.contains("*")))
    return F.when(fixed > 1, fixed - 1)


def endpoint_path(metadata_path: Column, *labels: Column) -> Column:
    """The path in an endpoint's metadata, or in the first label of the form 'METHOD /path'; null if none has one."""
    found = [F.when(metadata_path.startswith("/"), metadata_path)]
    for label in labels:
        route = F.regexp_extract(F.trim(label), r"(?i)^(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD|ANY)\s+(.+)$", 2)
        found.append(F.when(route.startswith("/"), route))
    return F.coalesce(*found)


def page_size(limit: int | None, default: int = 20, most: int = 100) -> int:
    return default if limit is None else min(max(limit, 1), most)


def _segments(key: Column) -> Column:
    return F.filter(F.split(key, r"[./_\-\s]+"), lambda s: s != "")


#: Fixed values of the score: equal keys, the asked one at the end of the other, the other at its end, one inside the other, a shared segment.
EQUAL, ENDS, ENDED, INSIDE, SEGMENT = 1000.0, 200, 120, 60, 25


def key_score(asked: Column, key: Column) -> Column:
    """How well a configuration key answers one that is asked for; both normalised and not empty."""
    shared = F.size(F.filter(_segments(asked), lambda s: F.array_contains(_segments(key), s)))
    part = lambda c, n: F.when(c, n).otherwise(0)
    loose = SEGMENT * shared + part(key.endswith(asked), ENDS) + part(asked.endswith(key), ENDED) + part(key.contains(asked) | asked.contains(key), INSIDE)
    return F.when(asked == key, EQUAL + F.length(key)).otherwise(loose + F.least(F.length(key), F.lit(120)) / 10)


def key_matches(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """asked, key, score, strategy: the best key for each one asked for (columns key); on ties the longer, then the greater.

    Keys meet on a shared segment, or where one holds the other, by equi-joins over distinct keys. Such a pair scores over 25,
    any other at most 12, so one asked for that meets none gets the longest key of all. Empty and null keys stay out.
    """
    clean = lambda df: df.select(F.regexp_replace(F.lower(F.trim("key")), r"\[(\d+)\]", ".$1").alias("key")).where("key <> ''").distinct()
    a, k = clean(asked).withColumnRenamed("key", "asked"), clean(keys)
    by = lambda df, how: df.select("*", F.explode(F.array_distinct(how(F.col(df.columns[0])))).alias("part"))
    pairs = by(a, _segments).join(by(k, _segments), "part").select("asked", "key")
    pairs = pairs.union(holding_pairs(a, "asked", k, "key").select("asked", "key")).distinct()
    rank = lambda c: F.struct(c.alias("score"), F.length("key").alias("n"), F.col("key").alias("key"))
    best = pairs.groupBy("asked").agg(F.max(rank(key_score(F.col("asked"), F.col("key")))).alias("b"))
    longest = k.agg(F.max(rank(F.least(F.length("key"), F.lit(120)) / 10)).alias("l"))
    rows = a.join(best, "asked", "left").join(F.broadcast(longest)).select("asked", F.coalesce("b", "l").alias("b"))  # one row
    score = F.col("b.score")
    return rows.select("asked", "b.key", score.alias("score"), F.when(score >= 1000, "exact").when(score >= 200, "suffix").otherwise("token").alias("strategy")).where("key is not null")


def db_contradictions(intent: tuple[Column, Column], summary: tuple[Column, Column], resolved: tuple[Column, Column], unsupported: Column, truncated: Column) -> Column:
    """Reasons why a database intent contradicts its function's summary; each argument before the flags is (schema, table), null or empty where not known."""
    token = lambda c: F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), F.lit(""))
    differ = lambda i, side: F.coalesce(token(side[i]) != token(summary[i]), F.lit(False))
    reasons = (
        (differ(0, intent) | differ(0, resolved), "DB_SCHEMA_CONTRADICTION"), (differ(1, intent) | differ(1, resolved), "DB_TABLE_CONTRADICTION"),
        (unsupported, "UNSUPPORTED_SUMMARY_CONFLICT"), (truncated, "TRUNCATED_SUMMARY_CONFLICT"),
    )
    return F.array_compact(F.array(*[F.when(c, reason) for c, reason in reasons]))


def section_completeness(action: Column, target: Column, source: Column, dynamic_target: Column | None = None, dynamic_source: Column | None = None) -> Column:
    """How complete a summary's section is: action .35, target .45 and source .2, less where a path (.25) or host (.1) is made at run time."""
    no = F.lit(False)
    worth = lambda held, dynamic, less, full: F.when(F.coalesce(held, no), F.when(F.coalesce(dynamic if dynamic is not None else no, no), less).otherwise(full)).otherwise(0.0)
    return F.when(F.coalesce(action, no), 0.35).otherwise(0.0) + worth(target, dynamic_target, 0.25, 0.45) + worth(source, dynamic_source, 0.1, 0.2)


def summary_completeness(sections: list[Column], truncated: Column, unsupported: Column) -> Column:
    """Mean of the sections that are there (null: not there; 0 if none), less .1 if cut and .15 if not understood; 0 to 1, four digits."""
    held = F.array_compact(F.array(*sections))
    mean = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held)
    less = F.when(truncated, 0.1).otherwise(0.0) + F.when(unsupported, 0.15).otherwise(0.0)
    return F.when(F.size(held) > 0, F.round(F.least(F.greatest(mean - less, F.lit(0.0)), F.lit(1.0)), 4)).otherwise(0.0)


def http_targets(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Calls (host, path) with service_id, endpoint_id and how far they resolve.

    A host that serves nothing leaves a call open; a path that one endpoint (service_id, path, endpoint_id) of the host alone
    serves gives the endpoint, any other the service only.
    """
    services = endpoints.select(F.col("service_id").alias("host")).distinct().withColumn("service_id", F.col("host"))
    only = endpoints.groupBy(F.col("service_id").alias("host"), "path").agg(F.min("endpoint_id").alias("endpoint_id"), F.max("endpoint_id").alias("last")).where("endpoint_id = last").drop("last")
    rows = calls.join(services, "host", "left").join(only, ["host", "path"], "left")
    return rows.withColumn("status", F.when(F.col("endpoint_id").isNotNull(), "endpoint").when(F.col("service_id").isNotNull(), "service").otherwise("open"))


def intent_hashes(intents: DataFrame, anchor: list[str], hints: list[str]) -> DataFrame:
    """intent_hash over anchor and hints (trimmed, lower case, null as empty) and anchor_hash over the anchor alone; one row an intent."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = lambda cols: F.sha2(F.concat_ws("\u001f", *cols), 256)
    held = [text(c) for c in anchor]
    return intents.select(digest(held + [F.lower(F.trim(text(c))) for c in hints]).alias("intent_hash"), digest(held).alias("anchor_hash")).distinct()


def retired(now: DataFrame, before: DataFrame) -> DataFrame:
    """intent_hash, anchor_hash, status: intents that a new extraction adds, keeps or retires."""
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    rows = mark(now, "n").join(mark(before, "b"), ["intent_hash", "anchor_hash"], "full")
    return rows.select("intent_hash", "anchor_hash", F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "retired").otherwise("kept").alias("status"))
