"""Where intermediates are written: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

#: Whether a job's shuffle files go when it ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master (as in tests) gets a temporary folder; a cluster
    gets an error, since its executors do not see one another's disks.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: its rows are read from the written files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, parts: int | None = None, by: str = "table_id") -> DataFrame:
    """``df`` written once as Parquet and read back: lineage ends here, an executor lost
    later costs a read, and readers still prune columns and push filters down.

    With ``parts`` it is written as that many buckets, so what follows per ``by`` needs no
    exchange; ``df`` should come dealt by ``by`` over as many parts, else tasks write more files.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    if parts is None:
        with released(spark):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    with released(spark):
        df.write.format("parquet").bucketBy(parts, by).option("path", path).saveAsTable(name)
    return spark.table(name)
