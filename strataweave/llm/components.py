"""Connected components of an edge table, by least labels and pointer jumping, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, comp) for every vertex of edges (a, b): comp is the least vertex of its component.

    Each round gives a vertex the least label among its neighbours' and then its label's
    label. Hubs gather by partial minima; each round is a table in the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct().toDF("v", "n"), "edges")
    labels = stored(both.groupBy("v").agg(F.least(F.min("n"), F.first("v")).alias("comp")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("v", "n").withColumnRenamed("comp", "c"), "n").groupBy("v").agg(F.min("c").alias("c"))
        step = labels.join(near, "v").select("v", "comp", F.least("comp", "c").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("comp").alias("d"))
        new = stored(step.join(jump, "c", "left").select("v", "comp", F.least("c", F.coalesce("d", "c")).alias("next")), "labels")
        done = new.where("comp <> next").isEmpty()
        labels = new.select("v", F.col("next").alias("comp"))
        if done:
            return labels
    raise RuntimeError("components did not settle")
