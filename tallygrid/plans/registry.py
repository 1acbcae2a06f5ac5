"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Text rules compile to long methods, which the JVM leaves uncompiled above 8,000
    bytes of code; below that limit Spark splits them and they run compiled.

    Stored tables compress well, so the size of a file says little about its rows: which
    side of a join is small enough to be sent to all is told from shuffled rows alone.
    Joins by table and row leave rows that are dealt by table where they are; unions are
    dealt anew, since their parts may be merged differently from those they meet."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "8MB")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with the SQL giving the same rows."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add
