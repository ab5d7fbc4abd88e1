"""Which table, topic or queue an intent means: its name among all, or among those that its bindings point at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.providers import lookup_tokens
from strataweave.sources.scratch import stored

#: Actions that read a table and that write one.
READS, WRITES = ("select", "read", "query", "find"), ("insert", "update", "delete", "write", "save", "merge", "upsert")


def kebab(value: Column) -> Column:
    """A name in kebab case, as aliases are compared."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(value), "([a-z0-9])([A-Z])", "$1-$2"), r"[_\s]+", "-"), "-+", "-"))


def access_type(action: Column) -> Column:
    a = F.lower(F.trim(action))
    return F.when(a.isin(*READS), "read").when(a.isin(*WRITES), "write")


def bound_tokens(hinted: DataFrame, bindings: DataFrame) -> DataFrame:
    """hints and token: what the bindings that share a form with one of some hints (array) resolve to. hinted: distinct hints."""
    keys = F.array_distinct(F.concat(*[lookup_tokens(F.coalesce(c, F.lit(""))) for c in ("alias_key", "alias_value", "host")]))
    to = F.array_distinct(F.filter(F.array(kebab(F.coalesce("service_id", F.lit(""))), kebab(F.coalesce("host", F.lit("")))), lambda t: t != ""))
    aliases = bindings.select(F.explode(keys).alias("form"), to.alias("to")).select("form", F.explode("to").alias("token")).distinct()
    forms = hinted.select("hints", F.explode(F.array_distinct(F.flatten(F.transform("hints", lookup_tokens)))).alias("form"))
    return forms.join(aliases, "form").select("hints", "token").distinct()


def resource_choice(intents: DataFrame, resources: DataFrame, bindings: DataFrame) -> DataFrame:
    """The intents without their hints, with narrowed, many_names (several bear the name), n (0, 1 or 2: several), target_id: of name and, where the intent has one, schema.

    intents (stored, as they are read more than once): kind, name, schema, hints, any others. resources: id, kind, name, schema, tokens. An intent whose bindings
    point at any resource of its kind sees those alone. Intents that ask the same (kind, name, schema, tokens pointed at) are answered as one, and meet the answer by
    one join. Postings hold the least and greatest id of a name, so a name or token that a third of all resources bear is one row.
    """
    low = lambda c: F.lower(F.trim(c))
    others = [c for c in intents.columns if c not in ("kind", "name", "schema", "hints")]
    r = stored(resources.select("id", "kind", low("name").alias("low_name"), low("schema").alias("low_schema"), "tokens"), "resources")
    ends = [F.min("id").alias("low"), F.max("id").alias("high")]
    tokens = r.select("id", "kind", "low_name", "low_schema", F.explode("tokens").alias("token"))
    hinted = intents.where(F.size("hints") > 0).select("hints").distinct()
    pointed = bound_tokens(hinted, bindings).join(tokens.select("kind", "token").distinct(), "token").groupBy("kind", "hints").agg(F.array_sort(F.collect_list("token")).alias("pointed"))
    i = intents.join(stored(pointed, "pointed"), ["kind", "hints"], "left").withColumn("low_name", low("name")).withColumn("low_schema", low("schema"))
    key = ["kind", "low_name", "low_schema", "pointed"]
    asked = stored(i.select(*key).where("low_name is not null").distinct(), "questions")

    def found(some: DataFrame, among: DataFrame, on: list[str]) -> DataFrame:
        any_ = some.join(among.groupBy(*on, "low_name").agg(*ends), [*on, "low_name"]).select(*key, "low", "high", F.lit(False).alias("in_schema"))
        exact = some.where("low_schema is not null").join(among.groupBy(*on, "low_name", "low_schema").agg(*ends), [*on, "low_name", "low_schema"]).select(*key, "low", "high", F.lit(True).alias("in_schema"))
        return any_.unionByName(exact)

    rows = found(asked.where("pointed is null"), r, ["kind"]).unionByName(found(asked.where("pointed is not null").withColumn("token", F.explode("pointed")), tokens, ["kind", "token"]))
    s = F.col("in_schema")
    sums = rows.groupBy(*key).agg(F.min(F.when(~s, F.col("low"))).alias("l"), F.max(F.when(~s, F.col("high"))).alias("h"), F.min(F.when(s, F.col("low"))).alias("sl"), F.max(F.when(s, F.col("high"))).alias("sh"))
    first, last = F.when(F.col("low_schema").isNotNull(), F.col("sl")).otherwise(F.col("l")), F.when(F.col("low_schema").isNotNull(), F.col("sh")).otherwise(F.col("h"))
    n = F.when(first.isNull(), 0).when(first == last, 1).otherwise(2)
    answers = sums.select(*[F.col(c).alias(f"a_{c}") for c in key], (F.col("l") != F.col("h")).alias("many"), n.alias("found"), F.when(n == 1, first).alias("target_id"))
    same = [F.col(c) == F.col(f"a_{c}") for c in ("kind", "low_name")] + [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in ("low_schema", "pointed")]
    out = i.join(answers, same, "left")
    return out.select(*others, "kind", "name", "schema", F.col("pointed").isNotNull().alias("narrowed"), F.coalesce("many", F.lit(False)).alias("many_names"), F.coalesce("found", F.lit(0)).alias("n"), "target_id")


def resolve_tables(intents: DataFrame, tables: DataFrame, bindings: DataFrame) -> DataFrame:
    """intent_id, status, relation_type, target_id, narrowed. intents: intent_id, action, resource ('table' or 'schema.table'), schema (or null), hints (array)."""
    part = F.filter(F.transform(F.split("resource", "[.]"), F.trim), lambda s: s != "")
    i = intents.withColumn("part", part).withColumn("schema", F.coalesce("schema", F.when(F.size("part") > 1, F.col("part")[0]))).withColumn("name", F.when(F.size("part") > 0, F.element_at("part", -1)))
    i = stored(i.select("intent_id", "hints", "name", "schema", access_type(F.col("action")).alias("relation_type"), F.lit("db_table").alias("kind")), "table-intents")
    rows = resource_choice(i, tables.withColumn("kind", F.lit("db_table")), bindings)
    status = (
        F.when(F.col("relation_type").isNull(), "DB_ACTION_UNKNOWN").when(F.col("name").isNull(), "DB_TABLE_UNRESOLVED").when(F.col("schema").isNull() & F.col("many_names"), "DB_SCHEMA_AMBIGUOUS")
        .when(F.col("n") == 0, "DB_TABLE_UNRESOLVED").when(F.col("n") > 1, "TABLE_MATCH_AMBIGUOUS").otherwise("CLOSED_ATOMIC")
    )
    return rows.select("intent_id", status.alias("status"), "relation_type", F.when(status == "CLOSED_ATOMIC", F.col("target_id")).alias("target_id"), "narrowed")


def resolve_channels(intents: DataFrame, channels: DataFrame, bindings: DataFrame) -> DataFrame:
    """intent_id, status, target_id, narrowed. intents: intent_id, channel, kind (topic or queue; null: topic), hints (array). channels: id, kind, names (array), tokens (array)."""
    i = stored(intents.select("intent_id", "hints", F.coalesce("kind", F.lit("topic")).alias("kind"), F.col("channel").alias("name"), F.lit(None).cast("string").alias("schema")), "channel-intents")
    named = channels.select("id", "kind", F.explode("names").alias("name"), F.lit(None).cast("string").alias("schema"), "tokens")
    rows = resource_choice(i, named, bindings)
    status = F.when(F.col("n") == 0, "MESSAGE_TARGET_UNRESOLVED").when(F.col("n") > 1, "TOPIC_MATCH_AMBIGUOUS").otherwise("CLOSED_ATOMIC")
    return rows.select("intent_id", status.alias("status"), "target_id", "narrowed")


def message_contradictions(resource: Column, channel: Column, kind: Column, topic: Column, queue: Column, name: Column, summary_kind: Column, unsupported: Column, truncated: Column) -> Column:
    """In what an intent (resource, channel, kind) and a function's summary (the rest) contradict each other, as an array; empty texts are absent ones."""
    some = lambda c: F.when(F.trim(c) != "", kebab(c))
    differs = lambda a, b: F.coalesce(a != b, F.lit(False))
    wrong = (differs(some(resource), some(topic)) & (kind == "topic")) | (differs(some(resource), some(queue)) & (kind == "queue")) | differs(some(channel), F.coalesce(some(topic), some(queue), some(name)))
    return F.array_compact(F.array(
        F.when(wrong, "MESSAGE_TARGET_CONTRADICTION"), F.when(differs(some(summary_kind), kind), "MESSAGE_CHANNEL_TYPE_CONTRADICTION"),
        F.when(F.coalesce(unsupported, F.lit(False)), "UNSUPPORTED_SUMMARY_CONFLICT"), F.when(F.coalesce(truncated, F.lit(False)), "TRUNCATED_SUMMARY_CONFLICT"),
    ))
