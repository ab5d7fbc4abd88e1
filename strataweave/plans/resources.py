"""Queries on intents that mean tables, topics and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.operators import resources
from strataweave.sources.graph_tables import GraphTables, with_tables

TEXT = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))


def table_resolution(spark, sf_dir):
    """Every order line reads or writes a table by its part's name, some with the part's type as schema, some through the data source of their supplier, which is bound to a brand."""
    g = GraphTables(spark, sf_dir)
    parts = g.source("part")
    tables = parts.select(TEXT("T", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("schema"), F.array(resources.kebab(TEXT("DB", "p_brand")), resources.kebab(F.col("p_brand"))).alias("tokens"))
    none = F.lit(None).cast("string")
    bindings = g.source("supplier").select(TEXT("ds", "s_suppkey").alias("alias_key"), none.alias("alias_value"), none.alias("service_id"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string"))).alias("host"))
    lines = g.lines().join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    k = F.col("l_linenumber")
    action = F.when(F.col("l_tax") == 0.08, "call").when(F.col("l_linestatus") == "O", "select").otherwise("Update")
    name = F.when(k == 5, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name"))
    intents = lines.select(
        (F.col("l_orderkey") * 1000 + F.col("rn")).alias("intent_id"), action.alias("action"), F.when(k % 3 == 0, F.concat("p_type", F.lit("."), name)).when(k == 7, " ").otherwise(name).alias("resource"),
        F.when(k == 4, "STANDARD").alias("schema"), F.when(k % 2 == 0, F.array(TEXT("ds", "l_suppkey"))).otherwise(F.array().cast("array<string>")).alias("hints"),
    )
    return resources.resolve_tables(intents, tables, bindings)


def _channels(g: GraphTables):
    e = g.source("events").withColumn("h", F.hour("ts"))
    channels = e.select("event_type", "h").distinct().select(
        F.concat(F.lit("TP"), "event_type", F.lit(":"), F.col("h").cast("string")).alias("id"), F.when(F.col("h") < 20, "topic").otherwise("queue").alias("kind"), F.array(TEXT("h", "h")).alias("names"),
        F.array(resources.kebab(TEXT("BR", "event_type")), F.col("event_type")).alias("tokens"),
    )
    return e, channels


def channel_resolution(spark, sf_dir):
    """Every event goes to the topic or queue of an hour, which each kind of event has; two of three users' buses are bound to a broker, which tells whose it is."""
    g = GraphTables(spark, sf_dir)
    e, channels = _channels(g)
    none = F.lit(None).cast("string")
    bindings = e.select(F.concat(F.lit("bus"), F.col("event_id").cast("string")).alias("alias_key"), none.alias("alias_value"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("BR"), "event_type")).alias("service_id"), F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("host"))
    k = F.col("event_id")
    intents = e.select(k.alias("intent_id"), F.concat(F.lit("H"), ((F.col("h") + k % 2) % 26).cast("string")).alias("channel"), F.when(k % 5 == 0, "queue").when(k % 5 == 1, "topic").alias("kind"), F.when(k % 3 != 0, F.array(TEXT("bus", "user_id"))).otherwise(F.array().cast("array<string>")).alias("hints"))
    return resources.resolve_channels(intents, channels, bindings)


def message_contradictions(spark, sf_dir):
    """What events (as summaries) say otherwise than the event of the same user a number before (as the intent)."""
    e = GraphTables(spark, sf_dir).source("events").select("event_id", "user_id", "event_type", F.hour("ts").alias("h"))
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.concat(F.col("event_type"), F.lit("_"), (F.col("h") % 4).cast("string")).alias("resource"), F.when(F.col("user_id") % 2 == 0, "topic").otherwise("queue").alias("kind"))
    name = F.concat(F.col("event_type"), F.lit("-"), (F.col("h") % 4).cast("string"))
    k = F.col("event_id")
    said = e.join(before, "event_id").select(
        "event_id", resources.message_contradictions(
            F.col("resource"), F.when(k % 2 == 0, F.col("resource")), F.col("kind"), F.when(k % 3 == 0, name).when(k % 3 == 1, ""), F.when(k % 3 == 1, name), F.when(k % 3 == 2, name),
            F.when(k % 3 == 0, "topic").when(k % 3 == 1, "queue"), k % 11 == 0, k % 13 == 0,
        ).alias("r"))
    return said.where(F.size("r") > 0).select("event_id", F.array_join(F.array_sort("r"), ",").alias("reasons"))


ENTRIES = {
    "table_resolution": (table_resolution, with_tables("""SELECT i.id AS intent_id, CASE WHEN rt IS NULL THEN 'DB_ACTION_UNKNOWN' WHEN name IS NULL THEN 'DB_TABLE_UNRESOLVED' WHEN schema IS NULL AND n > 1 THEN 'DB_SCHEMA_AMBIGUOUS' WHEN coalesce(m, 0) = 0 THEN 'DB_TABLE_UNRESOLVED' WHEN m > 1 THEN 'TABLE_MATCH_AMBIGUOUS' ELSE 'CLOSED_ATOMIC' END AS status,
          rt AS relation_type, CASE WHEN rt IS NOT NULL AND name IS NOT NULL AND m = 1 AND NOT (schema IS NULL AND n > 1) THEN t END AS target_id, narrow AS narrowed FROM i LEFT JOIN mt ON mt.id = i.id""",
        "l AS (SELECT l_orderkey * 1000 + rn AS id, l_linenumber AS k, l_suppkey, l_tax, l_linestatus, p_name, p_type FROM lines JOIN part ON p_partkey = l_partkey)",
        """i0 AS (SELECT id, k, CASE WHEN l_tax = 0.08 THEN NULL WHEN l_linestatus = 'O' THEN 'read' ELSE 'write' END AS rt, CASE WHEN k = 7 THEN NULL WHEN k = 5 THEN p_name || ' x' ELSE p_name END AS name, CASE WHEN k = 4 THEN 'STANDARD' WHEN k % 3 = 0 THEN p_type END AS schema,
          CASE WHEN k % 2 = 0 AND s_acctbal > 0 THEN 'Brand#' || (s_suppkey % 30) END AS brand FROM l LEFT JOIN supplier ON s_suppkey = l_suppkey)""",
        "i AS (SELECT *, brand IS NOT NULL AND brand IN (SELECT p_brand FROM part) AS narrow FROM i0)",
        "pn AS (SELECT p_name, p_type, p_brand, count(*) AS c, min('T' || p_partkey) AS t FROM part GROUP BY 1, 2, 3)",
        "mt AS (SELECT i.id, sum(c) AS n, sum(c) FILTER (WHERE schema IS NULL OR p_type = schema) AS m, min(t) FILTER (WHERE schema IS NULL OR p_type = schema) AS t FROM i JOIN pn ON p_name = name AND (NOT narrow OR p_brand = brand) GROUP BY 1)")),
    "channel_resolution": (channel_resolution, """WITH e AS (SELECT event_id, user_id, event_type, hour(ts) AS h FROM events), c AS (SELECT DISTINCT event_type AS t, h, CASE WHEN h < 20 THEN 'topic' ELSE 'queue' END AS kind FROM e),
        i AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'queue' ELSE 'topic' END AS kind, (h + event_id % 2) % 26 AS ch, CASE WHEN event_id % 3 <> 0 THEN (SELECT b.event_type FROM e b WHERE b.event_id = e.user_id) END AS broker FROM e),
        j AS (SELECT i.*, broker IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.t = broker AND c.kind = i.kind) AS narrow FROM i),
        m AS (SELECT event_id, count(*) AS n, min('TP' || t || ':' || h) AS id FROM j JOIN c ON c.kind = j.kind AND c.h = ch AND (NOT narrow OR t = broker) GROUP BY 1)
        SELECT event_id AS intent_id, CASE WHEN n IS NULL THEN 'MESSAGE_TARGET_UNRESOLVED' WHEN n > 1 THEN 'TOPIC_MATCH_AMBIGUOUS' ELSE 'CLOSED_ATOMIC' END AS status, CASE WHEN n = 1 THEN id END AS target_id, narrow AS narrowed FROM j LEFT JOIN m USING (event_id)"""),
    "message_contradictions": (message_contradictions, """WITH e AS (SELECT event_id AS k, user_id, event_type, hour(ts) AS h, event_type || '-' || hour(ts) % 4 AS name FROM events),
        j AS (SELECT e.k, e.name, b.name AS resource, CASE WHEN b.user_id % 2 = 0 THEN 'topic' ELSE 'queue' END AS kind FROM e JOIN e b ON b.k = e.k - 1),
        r AS (SELECT k, list_filter([CASE WHEN name <> resource AND ((k % 3 = 0 AND kind = 'topic') OR (k % 3 = 1 AND kind = 'queue') OR k % 2 = 0) THEN 'MESSAGE_TARGET_CONTRADICTION' END, CASE WHEN (k % 3 = 0 AND kind <> 'topic') OR (k % 3 = 1 AND kind <> 'queue') THEN 'MESSAGE_CHANNEL_TYPE_CONTRADICTION' END,
          CASE WHEN k % 11 = 0 THEN 'UNSUPPORTED_SUMMARY_CONFLICT' END, CASE WHEN k % 13 = 0 THEN 'TRUNCATED_SUMMARY_CONFLICT' END], lambda x: x IS NOT NULL) AS r FROM j)
        SELECT k AS event_id, array_to_string(list_sort(r), ',') AS reasons FROM r WHERE len(r) > 0"""),
}
