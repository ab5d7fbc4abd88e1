"""Queries on exports, snapshots, schema hashes and shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.operators import exchange
from strataweave.sources.graph_tables import GraphTables, with_tables
from strataweave.sources.scratch import fresh_path


def graph_export(spark, sf_dir):
    """Objects, approved relations and candidates as JSON lines."""
    g = GraphTables(spark, sf_dir)
    return exchange.graph_lines(g.objects(), g.relations(), g.candidates())


def csv_text(spark, sf_dir):
    """Parts as CSV files with a byte order mark, read back as lines: how often each line stands there, headers once."""
    path = fresh_path(spark, "csv")
    p = GraphTables(spark, sf_dir).source("part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('12" '), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(", big"))).when(F.col("p_partkey") % 7 != 0, F.col("p_name"))
    exchange.write_csv(p.select("p_partkey", name.alias("name"), "p_brand"), path, "p_partkey", "name", "p_brand")
    lines = spark.read.option("lineSep", "\r\n").text(path)
    return lines.select(F.when(F.col("value").contains("p_partkey"), F.lit("header")).otherwise(F.col("value")).alias("line")).distinct()


def snapshot_restore(spark, sf_dir):
    """Relations and affinities saved, changed, and restored: counts and sums of what is there again."""
    g, path = GraphTables(spark, sf_dir), fresh_path(spark, "snapshot")
    exchange.save({"relations": g.relations(), "affinities": g.affinities()}, path)
    back = exchange.restore(spark, path)
    a = back["relations"].groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).select(F.col("relation_type").alias("what"), "n", "first_id")
    return a.unionByName(back["affinities"].groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"), F.min("object_id").alias("first_id")).select(F.col("domain_id").alias("what"), "n", "first_id"))


def schema_details(spark, sf_dir):
    """Brands as databases whose columns or keys changed, though their tables' names did not: sizes are types, the dearest parts' types are keys."""
    p = GraphTables(spark, sf_dir).source("part")
    tables = p.select(F.col("p_brand").alias("database"), F.col("p_name").alias("table"), F.lit(None).cast("string").alias("metadata")).distinct()
    columns = p.select(F.col("p_brand").alias("database"), F.col("p_name").alias("table"), F.col("p_type").alias("column"), F.col("p_size").alias("type"))
    keys = p.select(F.col("p_brand").alias("database"), F.col("p_name").alias("table"), F.col("p_type").alias("column"), F.when(F.col("p_retailprice") > 1900, F.col("p_size").cast("string")).alias("ref"))
    before = exchange.full_schema_hashes(tables, columns, keys.where("ref is not null"))
    grown = columns.withColumn("type", F.when((F.col("type") == 50) & F.col("database").endswith("1"), 51).otherwise(F.col("type")))
    after = exchange.full_schema_hashes(tables, grown.unionByName(grown), keys.where("ref is not null and (ref <> '7' or not endswith(database, '2'))"))
    return after.join(before.select("database", F.col("schema_hash").alias("old")), "database").where("schema_hash <> old").select("database", "tables")


def shared_tables(spark, sf_dir):
    """Parts as tables: used by several suppliers, named alike in several brands that are only guessed, owned, or unused."""
    g = GraphTables(spark, sf_dir)
    uses = g.source("lineitem").where("l_returnflag = 'R' and l_quantity < 3").select(F.col("l_partkey").alias("table_id"), F.col("l_suppkey").alias("service_id"))
    tables = g.source("part").select(F.col("p_partkey").alias("table_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("database_id"), (F.col("p_size") <= 2).alias("guessed"))
    return exchange.sharing(uses, tables)


ENTRIES = {
    "graph_export": (graph_export, with_tables("""SELECT 'object' AS kind, '{"id":"' || id || '","object_type":"' || object_type || '","name":"' || name || '"' || coalesce(',"parent_id":"' || parent_id || '"', '') || '}' AS line FROM objects
        UNION ALL SELECT kind, '{"id":"' || id || '","relation_type":"' || relation_type || '","subject_id":"' || subject_id || '","object_id":"' || object_id || '"}' FROM (SELECT 'relation' AS kind, id, relation_type, subject_id, object_id FROM relations WHERE status = 'APPROVED' UNION ALL SELECT 'candidate', id, relation_type, subject_id, object_id FROM candidates)""")),
    "csv_text": (csv_text, """SELECT 'header' AS line UNION ALL SELECT p_partkey || ',' || CASE p_partkey % 3 WHEN 0 THEN '"12"" ' || p_name || '"' WHEN 1 THEN '"' || p_name || ', big"' ELSE CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE '' END END || ',' || p_brand FROM part"""),
    "snapshot_restore": (snapshot_restore, with_tables("SELECT relation_type AS what, count(*) AS n, min(id) AS first_id FROM relations GROUP BY 1 UNION ALL SELECT domain_id, count(*), min(object_id) FROM affinities GROUP BY 1")),
    "schema_details": (schema_details, "SELECT p_brand AS database, count(DISTINCT p_name) AS tables FROM part GROUP BY 1 HAVING bool_or(suffix(p_brand, '1') AND p_size = 50) OR bool_or(suffix(p_brand, '2') AND p_size = 7 AND p_retailprice > 1900)"),
    "shared_tables": (shared_tables, """WITH u AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 3 GROUP BY 1), g AS (SELECT lower(p_name) AS x FROM part WHERE p_size <= 2 GROUP BY 1 HAVING count(DISTINCT p_brand) > 1)
        SELECT p_partkey AS table_id, coalesce(n, 0) AS services, CASE WHEN n > 1 THEN 'SHARED' WHEN p_size <= 2 AND lower(p_name) IN (SELECT x FROM g) THEN 'SUSPECTED_SHARED' WHEN n = 1 THEN 'OWNED' ELSE 'UNUSED' END AS model FROM part LEFT JOIN u ON l_partkey = p_partkey"""),
}
