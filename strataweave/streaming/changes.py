"""Rollups kept up to date from a stream of change events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strataweave.operators import rollup

EVENT_SCHEMA = "event_id long, kind string, relation_type string, subject_id string, object_id string, confidence double"
EDGE_SCHEMA = "relation_type string, subject_id string, object_id string, edge_weight long, confidence double"
KEY = ("relation_type", "subject_id", "object_id")
BASE = -1


def last_events(events: DataFrame) -> DataFrame:
    """The event that made or took away each relation with the largest event_id; events of other kinds change no relation."""
    return events.where("kind in ('RELATION_CREATED', 'RELATION_DELETED')").groupBy(*KEY).agg(F.max_by(F.struct("event_id", "kind", "confidence"), "event_id").alias("e")).select("e.event_id", "e.kind", *KEY, "e.confidence")


def applied(relations: DataFrame, last: DataFrame) -> DataFrame:
    """Relations after events: RELATION_CREATED puts one in the place of all of its key, RELATION_DELETED takes them away."""
    kept = relations.join(last.select(*KEY), list(KEY), "left_anti").select("id", *KEY, "confidence", "status")
    made = last.where("kind = 'RELATION_CREATED'").select(F.concat(F.lit("N"), F.col("event_id").cast("string")).alias("id"), *KEY, "confidence", F.lit("APPROVED").alias("status"))
    return kept.unionByName(made)


class RollupMaintainer:
    """Edges of one level in a folder that batches of events add to.

    The base relations stay as they are. Batch b writes three small tables under its own number: the last event of each
    relation in it, the services it touched, and those services' edges, built again from their relations alone. An
    edge counts if no later batch touched its subject. Batches are named by the stream's batch id and read only
    what lower ids wrote, so a batch that is played again after a failure gives the same files, and a maintainer that starts
    on an existing folder goes on from it. Events count by event_id, in whatever order batches bring them.
    """

    def __init__(self, spark: SparkSession, relations: DataFrame, scope: Callable[[DataFrame, DataFrame], DataFrame], build: Callable[[DataFrame], DataFrame], path: str):
        """``scope(events, relations)``: subject_id of services to build again; ``build(relations)``: edges."""
        self.spark, self.base, self.scope, self.build, self.path = spark, relations, scope, build, path.rstrip("/")
        if not self._started():
            self._write(BASE, spark.createDataFrame([], EVENT_SCHEMA), spark.createDataFrame([], "subject_id string"), build(relations))

    def _started(self) -> bool:
        """Whether the base edges, which are written last, are there."""
        try:
            self.spark.read.parquet(f"{self.path}/edges/batch={BASE}")
            return True
        except AnalysisException:
            return False

    def _write(self, batch: int, log: DataFrame, touched: DataFrame, edges: DataFrame) -> None:
        log.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        touched.write.mode("overwrite").parquet(f"{self.path}/touched/batch={batch}")
        edges.write.mode("overwrite").parquet(f"{self.path}/edges/batch={batch}")

    def _read(self, name: str, schema: str, below: int | None) -> DataFrame:
        df = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")
        return df if below is None else df.where(F.col("batch") < below)

    def edges(self, below: int | None = None) -> DataFrame:
        """The edges after all batches, or after those with ids under ``below``."""
        latest = self._read("touched", "subject_id string", below).groupBy("subject_id").agg(F.max("batch").alias("latest"))
        rows = self._read("edges", EDGE_SCHEMA, below).join(latest, "subject_id", "left")
        return rows.where(F.col("batch") == F.coalesce("latest", F.lit(BASE))).drop("batch", "latest").select(*KEY, "edge_weight", "confidence")

    def relations(self, below: int | None = None) -> DataFrame:
        return applied(self.base, last_events(self._read("log", EVENT_SCHEMA, below)))

    def apply(self, events: DataFrame, batch_id: int) -> None:
        events = events.select(*[f.split(" ")[0] for f in EVENT_SCHEMA.split(", ")])
        last = last_events(events)
        last.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
        now = self.relations(batch_id + 1)
        if events.where("kind in ('EXPOSE_CHANGED', 'OBJECT_PARENT_CHANGED')").isEmpty():
            now = now.limit(0)  # other events name the services themselves: no relation needs to be read
        self.scope(events, now).distinct().write.mode("overwrite").parquet(f"{self.path}/touched/batch={batch_id}")
        touched = self.spark.read.schema("subject_id string").parquet(f"{self.path}/touched/batch={batch_id}")
        log = last_events(self._read("log", EVENT_SCHEMA, batch_id + 1).join(touched, "subject_id", "left_semi"))
        mine = applied(self.base.join(touched, "subject_id", "left_semi"), log)
        self.build(mine).write.mode("overwrite").parquet(f"{self.path}/edges/batch={batch_id}")

    def start(self, events: DataFrame, checkpoint: str):
        """A streaming query over events that applies each micro-batch once."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
