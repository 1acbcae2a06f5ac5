"""Incremental processing of a growing directory of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallygrid import schemas
from tallygrid.functions import numeric as N


def read_cells(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Cells arriving as JSON lines; lines that do not parse keep a status."""
    schema = schemas.CELLS + ", _corrupt_record STRING"
    raw = (
        spark.readStream.schema(schema).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("maxFilesPerTrigger", files_per_trigger).json(path)
    )
    return raw.withColumn(
        "status", F.when(F.col("_corrupt_record").isNull(), "ok").otherwise("failed")
    )


def running_profile(cells: DataFrame) -> DataFrame:
    """Counts per cell type and status so far: associative, so it streams in complete mode.

    The state holds one row per (status, cell type), however long the stream runs; there
    is no event time and no watermark.
    """
    text = F.col("text")
    kind = F.when(F.col("status") == "ok", N.cell_type(text)).otherwise("none")
    return cells.groupBy("status", kind.alias("cell_type")).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(N.strip(text) != "").alias("filled"),
        F.count_if(N.lenient_number(text).isNotNull()).alias("numeric"),
    )


def start_profile(profile: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Process everything there is, then stop; a restart takes up only new files."""
    return (
        profile.writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def append_cells(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Typed cells appended to a table, exactly once per input file."""
    typed = cells.where(F.col("status") == "ok").select(
        "table_id", "row_idx", "col_idx", "text", N.cell_type(F.col("text")).alias("cell_type"),
        N.lenient_number(F.col("text")).alias("value"),
    )
    return (
        typed.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
