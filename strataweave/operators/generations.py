"""Generations of rollups: built beside the active one, then activated; queries run on the active one or on one that they name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strataweave.operators import graph, rollup
from strataweave.operators.rollup import EDGE

LOG = "seq long, version long, action string, meta map<string,string>"
EDGES = "relation_type string, subject_id string, object_id string, edge_weight long, confidence double"


class Generations:
    """A folder with a log of what happened to generations and each one's edges by level.

    Nothing is overwritten: each step adds a row to the log, and the state is read from it, so a reader sees the old generation until the new one's
    activation is there. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def _add(self, version: int, action: str, meta: dict[str, str] | None = None) -> None:
        seq = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(seq, version, action, meta or {})], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def state(self) -> DataFrame:
        """version, status, meta: built ones that were never activated are BUILDING, the last activated is ACTIVE, others ARCHIVED; later meta entries replace earlier ones."""
        log = self.log()
        last = log.where("action = 'ACTIVATED'").groupBy("version").agg(F.max("seq").alias("at"))
        newest = last.agg(F.max("at")).first()[0]
        entries = log.select("version", "seq", F.explode_outer("meta").alias("k", "v")).groupBy("version", "k").agg(F.max_by("v", "seq").alias("v"))
        meta = entries.where("k is not null").groupBy("version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("meta"))
        rows = log.where("action = 'CREATED'").select("version").distinct().join(last, "version", "left").join(meta, "version", "left")
        status = F.when(F.col("at").isNull(), "BUILDING").when(F.col("at") == newest, "ACTIVE").otherwise("ARCHIVED")
        return rows.select("version", status.alias("status"), F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"))

    def active(self) -> int | None:
        row = self.log().where("action = 'ACTIVATED'").agg(F.max_by("version", "seq").alias("v")).first()
        return row["v"]

    def create(self) -> int:
        """The version after the active one, being built; a build that was left is begun again under its number."""
        version = (self.active() or 0) + 1
        self._add(version, "CREATED")
        return version

    def write(self, version: int, level: str, edges: DataFrame) -> None:
        edges.select(*EDGE, F.col("edge_weight").cast("long").alias("edge_weight"), "confidence").write.mode("overwrite").parquet(f"{self.path}/edges/version={version}/level={level}")

    def add_meta(self, version: int, **entries: str) -> None:
        """Entries replace those of their names; a version that was never created has none."""
        if not self.log().where((F.col("version") == version) & (F.col("action") == "CREATED")).isEmpty():
            self._add(version, "META", entries)

    def activate(self, version: int) -> None:
        self._add(version, "ACTIVATED")

    def edges(self, level: str, version: int | None = None) -> DataFrame:
        """Edges of a level in a version, or in the active one; none where there is no such build."""
        version = version if version is not None else self.active() or 0
        try:
            return self.spark.read.schema(EDGES).parquet(f"{self.path}/edges/version={version}/level={level}")
        except AnalysisException:
            return self.spark.createDataFrame([], EDGES)

    def cursor(self) -> tuple[int, str]:
        """The active version and a token that changes with every step of the log."""
        row = self.log().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq")).first()
        return self.active() or 0, f"{self.active() or 0}:{row['seq']}"

    def rebuild(self, levels: dict[str, Callable[[], DataFrame]], activate: bool = True, **meta: str) -> int:
        """A whole new generation, level by level in the order given."""
        version = self.create()
        for level, build in levels.items():
            self.write(version, level, build())
        self.add_meta(version, **{k: str(v) for k, v in meta.items()})
        if activate:
            self.activate(version)
        return version


@dataclass
class Request:
    """A query on one level of a generation (the active one if none is named)."""

    query_type: str
    level: str = "SERVICE_TO_SERVICE"
    generation: int | None = None
    params: dict = field(default_factory=dict)


def execute(store: Generations, request: Request, relations: DataFrame, members: DataFrame) -> tuple[int, DataFrame]:
    """The generation that a request ran on, and its result; an unknown type of query has an empty one. members: object_id, domain_id, affinity."""
    version = request.generation if request.generation is not None else store.active() or 0
    p = request.params
    if request.query_type == "DOMAIN_SUMMARY":  # needs no edges
        out = members.where(F.col("domain_id") == p["domain_id"]).groupBy("domain_id").agg(F.count(F.lit(1)).alias("members"))
        return version, out
    edges = store.edges(request.level, version)
    if request.query_type == "IMPACT_ANALYSIS":
        return version, graph.reach(store.spark, edges, p["object_id"], p.get("direction", "DOWNSTREAM"), p.get("max_depth", 3))
    if request.query_type == "PATH_DISCOVERY":
        return version, graph.simple_paths(edges, p["source_id"], p["target_id"], p.get("max_hops", 6), p.get("top_k", 5))
    if request.query_type == "USAGE_DISCOVERY":
        return version, graph.usage(edges, relations, p["object_id"])
    return version, store.spark.createDataFrame([], "id string")


LEVEL_ORDER = ("SERVICE_TO_SERVICE", "SERVICE_TO_DATABASE", "SERVICE_TO_BROKER")


def base_levels(relations: DataFrame, objects: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """How each level is built from base relations."""
    build = (rollup.service_to_service, rollup.service_to_database, rollup.service_to_broker)
    return {level: (lambda f=f: f(relations, objects)) for level, f in zip(LEVEL_ORDER, build)}
