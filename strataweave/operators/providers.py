"""Which service answers an HTTP intent, and which of its endpoints: a waterfall of stages.

Each stage sees only what the ones before left open: alias bindings together with the services' own tokens, then hosts that bindings name, then
the path alone. Whether an intent has no provider, one or several shows in the least and greatest id of its candidates, so postings of a token hold two ids
however many services share it, and a token that a third of all bindings bear joins as one row.

Stored tables of texts that repeat are tiny as files and large as rows, so Spark would take them for small and send them through the driver: joins here say
that both sides are shuffled (by hash where a side has a row or few a key, else by merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.scalars import path_compatibility, segments
from strataweave.sources.scratch import stored

#: Fixed value: endings of configuration keys and names that say nothing of the service.
ENDINGS = r"(?:-?base)?-?url$|(?:-?base)?-?host$|-?service$|-?client$"
#: A fit of paths that counts, what a fitting method adds, and the score and lead that a path alone needs.
FIT, METHOD_BONUS, PATH_SCORE, PATH_LEAD = 0.75, 0.3, 0.9, 0.2


def lookup_tokens(value: Column) -> Column:
    """The forms under which a hint or an alias is looked up: kebab case, without its ending, both without separators, and its parts."""
    bare = lambda c: F.regexp_replace(c, "[-_.]", "")
    kebab = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(value), "([a-z0-9])([A-Z])", "$1-$2"), r"[_\s]+", "-"), "-+", "-"))
    stem = F.regexp_replace(kebab, ENDINGS, "")
    return F.array_distinct(F.filter(F.concat(F.array(kebab, bare(kebab), stem, bare(stem)), F.split(kebab, "[./-]+")), lambda t: t != ""))


def service_token(value: Column) -> Column:
    """Letters and digits of a name, or of the host of an address."""
    host = F.regexp_extract(F.regexp_replace(F.lower(F.trim(value)), "^https?://", ""), "^([^/:]*)", 1)
    return F.regexp_replace(host, "[^a-z0-9]+", "")


def _ends(column: str) -> list[Column]:
    return [F.min(column).alias("low"), F.max(column).alias("high")]


def provider_stages(intents: DataFrame, services: DataFrame, bindings: DataFrame, endpoints: DataFrame) -> DataFrame:
    """intent_id, stage (alias, host or path), low and high: the least and greatest provider that the first stage with any found; no stage: no row.

    intents: intent_id, source_id, hints (array: hosts and configuration keys), path, method. services: service_id, tokens (array of service tokens).
    bindings: alias_key, alias_value, owner_id (null: any), service_id, host. endpoints: endpoint_id, provider_id, endpoint_path, endpoint_method.
    """
    own = services.select("service_id", F.explode("tokens").alias("token")).groupBy("token").agg(*_ends("service_id"))
    own = stored(own, "service-tokens")
    keys = F.array_distinct(F.concat(*[lookup_tokens(F.coalesce(c, F.lit(""))) for c in ("alias_key", "alias_value", "host")]))
    named = bindings.select(F.coalesce("owner_id", F.lit("")).alias("owner_id"), "service_id", F.explode(keys).alias("token"), service_token(F.coalesce("host", F.lit(""))).alias("host_token"))
    # Stored, so that a join with them shuffles both sides anew and a frequent token's intents can be dealt to several tasks.
    aliases = stored(named.where("service_id is not null").groupBy("token", "owner_id").agg(*_ends("service_id")), "alias-tokens").hint("shuffle_hash")
    hosts = named.where("host_token <> ''").select("token", "owner_id", "host_token").distinct().join(own.withColumnRenamed("token", "host_token").hint("shuffle_hash"), "host_token").groupBy("token", "owner_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hosts = stored(hosts, "host-tokens").hint("shuffle_hash")

    looked = stored(intents.select("intent_id", "source_id", F.array_distinct(F.flatten(F.transform("hints", lookup_tokens))).alias("tokens")), "looked-up")
    scoped = lambda rows: rows.select("intent_id", F.explode("tokens").alias("token"), F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("source_id", F.lit(""))))).alias("owner_id"))
    direct = looked.select("intent_id", F.explode(F.array_distinct(F.transform(F.flatten(F.transform("tokens", lookup_tokens)), service_token))).alias("token"))
    found = scoped(looked).join(aliases, ["token", "owner_id"]).select("intent_id", "low", "high").unionByName(direct.join(own.hint("shuffle_hash"), "token").select("intent_id", "low", "high"))
    merge = lambda rows, stage: rows.groupBy("intent_id").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("stage", F.lit(stage))
    first = stored(merge(found, "alias"), "by-alias")
    second = scoped(looked.join(first.hint("shuffle_hash"), "intent_id", "left_anti")).join(hosts, ["token", "owner_id"]).select("intent_id", "low", "high")
    closed = stored(first.unionByName(merge(second, "host")), "by-host")
    third = by_path(intents.join(closed.hint("shuffle_hash"), "intent_id", "left_anti"), endpoints)
    return closed.unionByName(third.select("intent_id", F.col("provider_id").alias("low"), F.col("provider_id").alias("high"), F.lit("path").alias("stage")))


def fitting_paths(paths: DataFrame, patterns: DataFrame, *on: str) -> DataFrame:
    """path, endpoint_path (and ``on``) of score FIT or more, and the score.

    Such a pair has as many segments, or one more or less, and few that differ, so one of the first places agrees: pairs meet there by
    an equi-join instead of all with all. Distinct paths meet distinct patterns.
    """
    free = lambda n: F.floor(n * ((1 - FIT) / 1.4)).cast("int")  # noqa: E731  places that may differ
    places = lambda n: F.when(n == 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.least(free(n), n - 1)))
    p = paths.select(*on, "path").distinct().withColumn("segs", segments(F.col("path")))
    p = p.withColumn("size", F.explode(F.filter(F.array(*[F.size("segs") + d for d in (-1, 0, 1)]), lambda n: n >= 0))).withColumn("place", F.explode(places(F.least("size", F.size("segs")))))
    at = F.get("segs", F.col("place"))
    p = p.withColumn("key", F.explode(F.when(F.col("place") < 0, F.array(F.lit(""))).when(at == "{*}", F.array(F.lit("{any}"))).otherwise(F.array(at, F.lit("{*}")))))
    e = patterns.select(*on, "endpoint_path").distinct().withColumn("pattern", segments(F.col("endpoint_path"))).withColumn("size", F.size("pattern"))
    e = e.withColumn("place", F.explode(F.array_union(places(F.col("size")), F.array(F.lit(-1)))))
    e = e.withColumn("key", F.explode(F.when(F.col("place") < 0, F.array(F.lit(""))).otherwise(F.array(F.get("pattern", F.col("place")), F.lit("{any}")))))
    rows = p.join(e.hint("shuffle_hash"), [*on, "size", "place", "key"]).select(*on, "path", "endpoint_path", path_compatibility(F.col("segs"), F.col("pattern")).alias("score")).where(F.col("score") >= FIT)
    return rows.distinct()


def by_path(intents: DataFrame, endpoints: DataFrame) -> DataFrame:
    """intent_id and provider_id where the path alone points at one provider clearly.

    Of the providers of one pattern and method three are enough: without the source two are left, and two of equal score leave the intent open.
    """
    some = endpoints.select("endpoint_path", "endpoint_method", "provider_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("endpoint_path", "endpoint_method").orderBy("provider_id"))).where("k <= 3").drop("k")
    rows = intents.select("intent_id", "source_id", "path", "method").join(fitting_paths(intents, endpoints).hint("merge"), "path").join(some.hint("shuffle_hash"), "endpoint_path").where("not (provider_id <=> source_id)")
    fits = (F.col("endpoint_method") == "ANY") | (F.col("endpoint_method") == F.coalesce("method", F.lit("ANY")))
    scores = rows.groupBy("intent_id", "provider_id").agg(F.max(F.col("score") + F.when(fits, METHOD_BONUS).otherwise(0.0)).alias("score"))
    w = Window.partitionBy("intent_id").orderBy(F.desc("score"), "provider_id")
    ranked = scores.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    return ranked.where((F.col("k") == 1) & (F.round("score", 6) >= PATH_SCORE) & (F.col("second").isNull() | (F.round(F.col("score") - F.col("second"), 6) >= PATH_LEAD))).select("intent_id", "provider_id")


def endpoint_matches(intents: DataFrame, endpoints: DataFrame, exact: Column | None = None) -> DataFrame:
    """intent_id, n and endpoint_id (the least): the endpoints of the provider with a fitting method, those of equal path if any, else those that fit; an intent's hint decides among them."""
    e = endpoints.select("provider_id", "endpoint_path", "endpoint_method", "endpoint_id")
    rows = intents.join(fitting_paths(intents, e, "provider_id").hint("merge"), ["provider_id", "path"]).join(e.hint("shuffle_hash"), ["provider_id", "endpoint_path"])
    rows = rows.where((F.col("endpoint_method") == "ANY") | (F.col("endpoint_method") == F.col("method")))
    same = segments(F.col("path")) == segments(F.col("endpoint_path"))
    hinted = F.coalesce(F.col("endpoint_id") == F.col("hint_id"), F.lit(False))
    level = lambda keep, name: [F.count_if(keep).alias(f"n_{name}"), F.min(F.when(keep, F.col("endpoint_id"))).alias(f"e_{name}")]
    sums = rows.groupBy("intent_id").agg(*level(same & hinted, "same_hint"), *level(same, "same"), *level(hinted, "hint"), *level(F.lit(True), "fit"))
    pick = lambda c: F.when(F.col("n_same_hint") > 0, F.col(f"{c}_same_hint")).when(F.col("n_same") > 0, F.col(f"{c}_same")).when(F.col("n_hint") > 0, F.col(f"{c}_hint")).otherwise(F.col(f"{c}_fit"))
    return sums.select("intent_id", pick("n").alias("n"), pick("e").alias("endpoint_id"))


def staged_providers(intents: DataFrame, services: DataFrame, bindings: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The intents with stage, low and high (as provider_stages), the provider chosen or alone, and whether there are many."""
    intents = stored(intents.withColumn("hints", F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("hosts", "config_keys")])), "intents")
    staged = intents.join(provider_stages(intents, services, bindings, endpoints).hint("merge"), "intent_id", "left")
    # A chosen provider counts where it is a candidate; the least and greatest of the candidates tell that for one of two.
    chosen = F.col("provider_override").isNotNull() & F.col("provider_override").isin(F.col("low"), F.col("high"))
    staged = staged.withColumn("provider_id", F.when(chosen, F.col("provider_override")).when(F.col("low") == F.col("high"), F.col("low"))).withColumn("many", F.col("low") != F.col("high"))
    return stored(staged, "staged")


def open_reason() -> Column:
    """Why an intent without any provider is open."""
    hint = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    return (
        F.when(F.coalesce("dynamic", F.lit(False)), "DYNAMIC_URI_UNRESOLVED")
        .when(~hint("hosts") & ~hint("config_keys") & F.col("path").isNotNull(), "PATH_ONLY_TARGET_UNRESOLVED")
        .when(hint("config_keys"), "CONFIG_BINDING_MISSING")
        .otherwise("HOST_ALIAS_UNRESOLVED")
    )


def resolve_http(intents: DataFrame, services: DataFrame, bindings: DataFrame, endpoints: DataFrame) -> DataFrame:
    """intent_id, status, stage, provider_id, target_id: closed on one endpoint, or open with the reason.

    intents also have hosts and config_keys (arrays), dynamic (boolean: host or path is only known at run time), provider_override (a chosen candidate) and hint_id (an endpoint); all may be null.
    """
    staged = staged_providers(intents, services, bindings, endpoints)
    served = endpoints.select("provider_id").distinct().withColumn("served", F.lit(True))
    matched = endpoint_matches(staged.where("provider_id is not null and method is not null"), endpoints)
    rows = staged.join(served, "provider_id", "left").join(matched.hint("merge"), "intent_id", "left")
    status = (
        F.when(F.col("provider_id").isNull() & F.coalesce("many", F.lit(False)), "PROVIDER_SERVICE_AMBIGUOUS")
        .when(F.col("provider_id").isNull(), open_reason())
        .when(F.col("served").isNull(), "PROVIDER_ENDPOINT_INDEX_EMPTY")
        .when(F.col("method").isNull(), "METHOD_UNKNOWN")
        .when(F.coalesce("n", F.lit(0)) == 0, "PROVIDER_ENDPOINT_NOT_FOUND")
        .when(F.col("n") > 1, "ENDPOINT_MATCH_AMBIGUOUS")
        .otherwise("CLOSED_ATOMIC")
    )
    return rows.select("intent_id", status.alias("status"), "stage", "provider_id", F.when(F.col("n") == 1, F.col("endpoint_id")).alias("target_id"))
