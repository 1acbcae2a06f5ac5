"""Connected components as rounds of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.store import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every end of ``links`` (a, b).

    Labels fall along links and are then shortened by looking up the label of the
    label, so rounds grow with the logarithm of a component's diameter.  Only the count
    of changed labels comes to the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    edges = scratch.keep(both.where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.keep(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")),
        f"{name}-0",
    )
    k = 0
    while True:
        offered = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("offer"))
        )
        lower = labels.join(offered, "node", "left").select(
            "node", "component", F.least("component", "offer").alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        k += 1
        scratch.keep(
            lower.join(jump, "low", "left").select(
                "node", F.least("low", "far").alias("component"),
                (F.least("low", "far") < F.col("component")).alias("changed"),
            ),
            f"{name}-{k}",
        )
        read = scratch.spark.read.parquet(scratch.path(f"{name}-{k}"))
        scratch.drop(f"{name}-{k - 1}")
        labels = read.select("node", "component")
        if not read.where("changed").limit(1).count():
            return labels
