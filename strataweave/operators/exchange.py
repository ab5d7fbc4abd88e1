"""Graphs as JSON, tables as CSV text, snapshots and their restoration, hashes of whole schemas, shared tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def graph_lines(objects: DataFrame, relations: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """kind and line (JSON): every object, every approved relation, and every pending candidate if candidates are given."""
    lines = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*c)).alias("line"))
    ends = ("id", "relation_type", "subject_id", "object_id")
    out = lines(objects, "object", "id", "object_type", "name", "parent_id").unionByName(lines(relations.where("status = 'APPROVED'"), "relation", *ends))
    return out if candidates is None else out.unionByName(lines(candidates, "candidate", *ends))


def csv_line(*columns: Column) -> Column:
    """A line of CSV: fields with a quote, comma or line break stand in quotes, quotes in them double; null is empty."""

    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *map(field, columns))


def write_csv(df: DataFrame, path: str, *columns: str) -> None:
    """Files of CSV text, each with a byte order mark and a header, as spreadsheets expect it; lines end with CR LF."""
    head = "﻿" + ",".join(columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task writes a file: the header goes before its first line."""
        for k, batch in enumerate(b for b in batches if b.num_rows):
            if not k:
                yield pa.RecordBatch.from_arrays([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    df.select(csv_line(*map(F.col, columns)).alias("value")).mapInArrow(headed, "value string").write.option("lineSep", "\r\n").text(path)


def save(tables: dict[str, DataFrame], path: str) -> None:
    """A snapshot: each table in its own folder, and a list of them written last, so that an unfinished snapshot is none."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.parquet(f"{path}/_tables_done")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a finished snapshot, by name."""
    names = [r["name"] for r in spark.read.schema("name string").parquet(f"{path}/_tables_done").collect()]
    return {n: spark.read.parquet(f"{path}/{n}") for n in sorted(names)}


def full_schema_hashes(tables: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """database, tables, schema_hash over names and metadata of tables, their columns with types, and keys, in any order.

    tables: database, table, metadata. columns: database, table, column, type. keys: database, table, column, ref. Rows are hashed each for itself and the hashes added up, so nothing is gathered.
    """
    text = lambda df, kind, *c: df.select("database", F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in c]).alias("t"), F.lit(int(kind == "table")).alias("is_table"))
    rows = text(tables, "table", "table", "metadata").unionByName(text(columns, "column", "table", "column", "type")).unionByName(text(keys, "key", "table", "column", "ref")).distinct()
    part = lambda n: F.conv(F.substring(F.sha2("t", 256), n, 15), 16, 10).cast("decimal(20,0)")  # noqa: E731  60 bits
    sums = rows.groupBy("database").agg(F.sum("is_table").alias("tables"), *[F.sum(part(15 * k + 1)).alias(f"s{k}") for k in range(4)])
    return sums.select("database", "tables", F.sha2(F.concat_ws("|", "database", "tables", *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("schema_hash"))


def sharing(uses: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, services, model: SHARED where several services use a table, SUSPECTED_SHARED where its name stands in two or more databases that were only guessed, else OWNED (one) or UNUSED.

    uses: table_id, service_id. tables: table_id, name, database_id, guessed.
    """
    n = uses.groupBy("table_id").agg(F.count_distinct("service_id").alias("services"))
    names = tables.where("guessed").groupBy(F.lower("name").alias("low")).agg(F.count_distinct("database_id").alias("places")).where("places > 1")
    rows = tables.withColumn("low", F.when(F.col("guessed"), F.lower("name"))).join(n, "table_id", "left").join(names, "low", "left")
    model = F.when(F.col("services") > 1, "SHARED").when(F.col("places").isNotNull(), "SUSPECTED_SHARED").when(F.col("services") == 1, "OWNED").otherwise("UNUSED")
    return rows.select("table_id", F.coalesce("services", F.lit(0)).cast("long").alias("services"), model.alias("model"))
