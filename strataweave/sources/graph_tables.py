"""The architecture graph that this library's queries run on, derived from the given tables.

Suppliers are services, order lines that follow each other are calls between them, parts are tables of their brand's
database, event types are brokers with a topic an hour, regions are domains. Every table grows with its source table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.sources.scratch import spread, stored

LINE_ORDER = ("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, *cols: str):
    parts = [F.lit(prefix)]
    for i, c in enumerate(cols):
        parts += [F.lit(":")] * (i > 0) + [F.col(c).cast("string")]
    return F.concat(*parts)


#: Lines that wait for review: their calls are candidates and change events, not relations.
WAITING = "l_quantity >= 48"


class GraphTables:
    """Derived tables over one data folder, each from whole tables. With ``keep`` the order lines and their places are stored at first use, for queries that need them more than once."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False):
        self.spark, self.sf_dir, self.keep, self._lines, self._rows = spark, sf_dir, keep, None, None

    def source(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def rows(self) -> int:
        """The number of order lines, from the files' footers."""
        if self._rows is None:
            self._rows = self.source("lineitem").count()
        return self._rows

    def lines(self) -> DataFrame:
        """All order lines with their place in the order and the supplier and flag of the line before, by one window."""
        if self._lines is not None:
            return self._lines
        w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
        out = spread(self.source("lineitem"), self.rows(), "l_orderkey").withColumn("rn", F.row_number().over(w))
        out = out.withColumn("a_supp", F.lag("l_suppkey").over(w)).withColumn("a_flag", F.lag("l_returnflag").over(w))
        if self.keep:
            out = self._lines = stored(out, "lines")
        return out

    def chain(self, waiting: bool = False) -> DataFrame:
        """Lines that make relations, or those that wait."""
        return self.lines().where(WAITING if waiting else f"not ({WAITING})")

    def steps(self, waiting: bool = False) -> DataFrame:
        """The same lines, but the first of each order: each follows another line."""
        return self.chain(waiting).where("rn > 1")

    def objects(self) -> DataFrame:
        """id, object_type, granularity, name, display_name, parent_id, path."""
        lines = self.source("lineitem")
        none = F.lit(None).cast("string")

        def rows(df, kind, grain, id_, name, parent=none, display=None, keys=()):
            path = F.concat(F.lit("/"), F.coalesce(F.concat(F.col("p"), F.lit("/")), F.lit("")), F.col("id"))
            df = df.select(*keys).distinct() if keys else df  # numbers first: a text is made once an object, not once a line
            out = df.select(id_.alias("id"), F.lit(kind).alias("object_type"), F.lit(grain).alias("granularity"), name.alias("name"), (display if display is not None else name).alias("display_name"), parent.alias("p"))
            out = out.withColumn("path", path).withColumnRenamed("p", "parent_id")
            return out if keys else out.distinct()

        parts = self.source("part").join(lines.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
        events = self.source("events").withColumn("h", F.hour("ts"))
        region, supplier = self.source("region"), self.source("supplier")
        out = rows(region, "domain", "COMPOUND", _id("D", "r_regionkey"), F.col("r_name"))
        for df in (
            rows(supplier, "service", "COMPOUND", _id("S", "s_suppkey"), F.col("s_name")),
            rows(lines, "api_endpoint", "ATOMIC", _id("E", "l_suppkey", "l_linenumber"), _id("E", "l_suppkey", "l_linenumber"), _id("S", "l_suppkey"), keys=("l_suppkey", "l_linenumber")),
            rows(parts, "database", "COMPOUND", _id("DB", "p_brand"), F.col("p_brand"), keys=("p_brand",)),
            rows(parts, "db_table", "ATOMIC", _id("T", "p_partkey"), F.col("p_name"), _id("DB", "p_brand")),
            rows(events, "message_broker", "COMPOUND", _id("BR", "event_type"), F.col("event_type"), keys=("event_type",)),
            rows(events, "topic", "ATOMIC", _id("TP", "event_type", "h"), _id("TP", "event_type", "h"), _id("BR", "event_type"), keys=("event_type", "h")),
        ):
            out = out.unionByName(df)
        return out

    def relations(self, *types: str) -> DataFrame:
        """id, relation_type, subject_id, object_id, confidence, status. A line makes up to three relations, in one pass over the lines. With ``types`` those of these types alone."""
        approved, step = F.lit("APPROVED"), F.col("rn") > 1
        kinds = [
            (("call",), "C", step, F.lit("call"), _id("S", "a_supp"), _id("E", "l_suppkey", "l_linenumber"), "l_discount", F.when(F.col("l_quantity") <= 2, "REJECTED").otherwise(approved)),
            (("depend_on",), "D", step & (F.col("a_flag") == "R"), F.lit("depend_on"), _id("S", "a_supp"), _id("S", "l_suppkey"), "l_discount", approved),
            (("read", "write"), "A", F.col("l_returnflag").isin("R", "A"), F.when(F.col("l_returnflag") == "R", "read").otherwise("write"), _id("S", "l_suppkey"), _id("T", "l_partkey"), "l_tax", approved),
        ]
        kinds = [kind for kind in kinds if not types or set(kind[0]) & set(types)]
        traced = None
        if kinds:
            # A line fans out as letters and the columns follow, so columns that a query leaves out are never made.
            rows = self.chain().select("*", F.explode(F.array(*[F.when(kind[2], kind[1]) for kind in kinds])).alias("k")).where("k is not null")
            pick = lambda made: reduce(lambda rest, kind: F.when(F.col("k") == kind[1], made(kind)).otherwise(rest), kinds[-2::-1], made(kinds[-1]))
            traced = rows.select(
                F.concat(F.col("k"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("rn").cast("string")).alias("id"), pick(lambda kind: kind[3]).alias("relation_type"), pick(lambda kind: kind[4]).alias("subject_id"),
                pick(lambda kind: kind[5]).alias("object_id"), pick(lambda kind: 1 - F.col(kind[6])).alias("confidence"), pick(lambda kind: kind[7]).alias("status"),
            )
        if traced is not None and types and not {"produce", "consume"} & set(types):
            return traced.where(F.col("relation_type").isin(*types))
        events = self.source("events").withColumn("h", F.hour("ts")).join(self.source("supplier").select(F.col("s_suppkey").alias("user_id")), "user_id", "left_semi")
        messages = events.select(
            _id("M", "event_id").alias("id"), F.when(F.col("event_type").isin("purchase", "signup"), "produce").otherwise("consume").alias("relation_type"),
            _id("S", "user_id").alias("subject_id"), _id("TP", "event_type", "h").alias("object_id"), (F.lit(0.5) + (F.col("event_id") % 5) / 10).alias("confidence"), approved.alias("status"),
        )
        out = messages if traced is None else traced.unionByName(messages)
        return out.where(F.col("relation_type").isin(*types)) if types else out

    def affinities(self) -> DataFrame:
        """object_id, domain_id, affinity: a service belongs to its region and, less, to the next two."""
        s = self.source("supplier").join(F.broadcast(self.source("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nation: 25 rows at every scale
        own = F.when(F.col("s_suppkey") % 2 == 0, 0.7).otherwise(0.9)
        ranks = F.array(*[F.struct(F.lit(k).alias("k"), a.alias("a")) for k, a in ((0, own), (1, F.lit(0.3)), (2, F.lit(0.1)))])
        return s.select("s_suppkey", "n_regionkey", F.explode(ranks).alias("x")).select(
            _id("S", "s_suppkey").alias("object_id"), F.concat(F.lit("D"), ((F.col("n_regionkey") + F.col("x.k")) % 5).cast("string")).alias("domain_id"), F.col("x.a").alias("affinity")
        )

    def evidences(self) -> DataFrame:
        """id, relation_id, evidence_type."""
        s = self.steps()
        kinds = F.array(F.when(F.col("l_linestatus") == "O", "FILE").otherwise("CONFIG"), F.when(F.col("l_returnflag") == "N", "SCHEMA"))
        out = s.select(_id("C", "l_orderkey", "rn").alias("relation_id"), F.explode(kinds).alias("evidence_type")).where("evidence_type is not null")
        return out.select(F.concat_ws("-", F.lit("EV"), "relation_id", "evidence_type").alias("id"), "relation_id", "evidence_type")

    def candidates(self) -> DataFrame:
        """Calls that wait for review; evidence_types as an array."""
        s = self.steps(waiting=True)
        kinds = F.array_compact(F.array(F.when(F.col("l_linestatus") == "O", "FILE").otherwise("CONFIG"), F.when(F.col("l_returnflag") == "N", "SCHEMA")))
        return s.select(
            _id("C", "l_orderkey", "rn").alias("id"), F.lit("call").alias("relation_type"), _id("S", "a_supp").alias("subject_id"), _id("S", "l_suppkey").alias("object_id"),
            (1 - F.col("l_discount")).alias("confidence"), kinds.alias("evidence_types"), F.col("l_linestatus").alias("language"), F.col("l_tax").alias("tax"),
        )


def avg_sql(x: str) -> str:
    """The mean as ``exact_avg`` takes it."""
    return f"(sum(CAST(floor(({x}) * 1e12 + 0.5) AS HUGEINT))::DOUBLE / (count({x}) * 1e12))"


def avg6_sql(x: str) -> str:
    """That mean rounded half up to six digits, in whole numbers."""
    total = f"sum(CAST(floor(({x}) * 1e12 + 0.5) AS HUGEINT))"
    return f"(sign({total}) * CAST((2 * abs({total}) + 1000000 * count({x})) // (2000000 * count({x})) AS DOUBLE) / 1000000)"


#: The same tables for DuckDB, as common table expressions.
SQL = f"""
lines AS (SELECT *, row_number() OVER w AS rn, lag(l_suppkey) OVER w AS a_supp, lag(l_returnflag) OVER w AS a_flag FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_discount)),
chain AS (SELECT * FROM lines WHERE l_quantity < 48),
steps AS (SELECT * FROM chain WHERE rn > 1),
waiting AS (SELECT * FROM lines WHERE l_quantity >= 48),
waiting_steps AS (SELECT * FROM waiting WHERE rn > 1),
parts AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
objects AS (
  SELECT 'D' || r_regionkey AS id, 'domain' AS object_type, 'COMPOUND' AS granularity, r_name AS name, NULL AS parent_id, '/D' || r_regionkey AS path FROM region
  UNION SELECT 'S' || s_suppkey, 'service', 'COMPOUND', s_name, NULL, '/S' || s_suppkey FROM supplier
  UNION SELECT 'E' || l_suppkey || ':' || l_linenumber, 'api_endpoint', 'ATOMIC', 'E' || l_suppkey || ':' || l_linenumber, 'S' || l_suppkey, '/S' || l_suppkey || '/E' || l_suppkey || ':' || l_linenumber FROM lineitem
  UNION SELECT 'DB' || p_brand, 'database', 'COMPOUND', p_brand, NULL, '/DB' || p_brand FROM parts
  UNION SELECT 'T' || p_partkey, 'db_table', 'ATOMIC', p_name, 'DB' || p_brand, '/DB' || p_brand || '/T' || p_partkey FROM parts
  UNION SELECT 'BR' || event_type, 'message_broker', 'COMPOUND', event_type, NULL, '/BR' || event_type FROM events
  UNION SELECT 'TP' || event_type || ':' || hour(ts), 'topic', 'ATOMIC', 'TP' || event_type || ':' || hour(ts), 'BR' || event_type, '/BR' || event_type || '/TP' || event_type || ':' || hour(ts) FROM events),
relations AS (
  SELECT 'C' || l_orderkey || ':' || rn AS id, 'call' AS relation_type, 'S' || a_supp AS subject_id, 'E' || l_suppkey || ':' || l_linenumber AS object_id, 1 - l_discount AS confidence,
    CASE WHEN l_quantity <= 2 THEN 'REJECTED' ELSE 'APPROVED' END AS status FROM steps
  UNION ALL SELECT 'D' || l_orderkey || ':' || rn, 'depend_on', 'S' || a_supp, 'S' || l_suppkey, 1 - l_discount, 'APPROVED' FROM steps WHERE a_flag = 'R'
  UNION ALL SELECT 'A' || l_orderkey || ':' || rn, CASE WHEN l_returnflag = 'R' THEN 'read' ELSE 'write' END, 'S' || l_suppkey, 'T' || l_partkey, 1 - l_tax, 'APPROVED' FROM chain WHERE l_returnflag IN ('R', 'A')
  UNION ALL SELECT 'M' || event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'produce' ELSE 'consume' END, 'S' || user_id, 'TP' || event_type || ':' || hour(ts), 0.5 + (event_id % 5) / 10.0, 'APPROVED'
    FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier)),
affinities AS (
  SELECT 'S' || s_suppkey AS object_id, 'D' || ((n_regionkey + k) % 5) AS domain_id, CASE k WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 0.7 ELSE 0.9 END WHEN 1 THEN 0.3 ELSE 0.1 END::DOUBLE AS affinity
  FROM supplier JOIN nation ON s_nationkey = n_nationkey, (VALUES (0), (1), (2)) t(k)),
evidences AS (
  SELECT 'EV-C' || l_orderkey || ':' || rn || '-' || t AS id, 'C' || l_orderkey || ':' || rn AS relation_id, t AS evidence_type FROM
  (SELECT l_orderkey, rn, CASE WHEN l_linestatus = 'O' THEN 'FILE' ELSE 'CONFIG' END AS t FROM steps UNION ALL SELECT l_orderkey, rn, 'SCHEMA' FROM steps WHERE l_returnflag = 'N')),
candidates AS (
  SELECT 'C' || l_orderkey || ':' || rn AS id, 'call' AS relation_type, 'S' || a_supp AS subject_id, 'S' || l_suppkey AS object_id, 1 - l_discount AS confidence,
    l_linestatus, l_returnflag, l_tax AS tax FROM waiting_steps),
s2s AS (
  SELECT relation_type, subject_id, target AS object_id, count(*) AS edge_weight, {avg_sql('confidence')} AS confidence, {avg6_sql('confidence')} AS confidence6 FROM (
    SELECT r.relation_type, r.subject_id, r.confidence, CASE WHEN r.relation_type = 'depend_on' OR o.granularity = 'COMPOUND' THEN r.object_id ELSE o.parent_id END AS target
    FROM relations r JOIN objects o ON r.object_id = o.id WHERE r.status = 'APPROVED' AND r.relation_type IN ('call', 'depend_on'))
  WHERE target IS NOT NULL AND target <> subject_id GROUP BY ALL)
"""


def with_tables(select: str, *ctes: str) -> str:
    """DuckDB SQL over the derived tables."""
    return "WITH RECURSIVE " + ",\n".join([SQL.strip(), *ctes]) + "\n" + select
