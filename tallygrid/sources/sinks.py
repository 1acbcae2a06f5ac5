"""Writers.  All write with many tasks, except the one-row summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators.validate import pass_summary
from tallygrid.partitioning import row_chunk


def table_documents(cells: DataFrame, metadata: DataFrame, checks: DataFrame) -> DataFrame:
    """One document per table and chunk of 65,536 rows: grid, values, metadata, checks.

    A table of ordinary size is one document; a longer one continues in ``part`` 1, 2 ...
    with metadata and checks kept in part 0.  ``cells`` is the normalised form.
    """
    one_row = F.array_sort(
        F.collect_list(F.struct("col_idx", "text", "value", "normalized", "cell_type"))
    )
    rows = cells.groupBy("table_id", row_chunk().alias("part"), "row_idx").agg(one_row.alias("cells"))
    grids = rows.groupBy("table_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("rows")
    )
    columns = metadata.groupBy("table_id").agg(
        F.array_sort(
            F.collect_list(F.struct("col_idx", "currency", "scale", "unit", "column_type", "year"))
        ).alias("columns")
    )
    verdict = pass_summary(checks, "table_id").select("table_id", F.struct(
        "total", "n_passed", "failed", "pass_rate", "all_passed"
    ).alias("summary"))
    first = F.col("part") == 0
    return (
        grids.join(columns, "table_id", "left").join(verdict, "table_id", "left")
        .select(
            "table_id", "part", F.size("rows").alias("n_rows"), "rows",
            F.when(first, F.transform(F.get("rows", F.lit(0))["cells"], lambda c: c["text"])).alias("headers"),
            F.when(first, F.col("columns")).alias("columns"),
            F.when(first, F.col("summary")).alias("summary"),
        )
    )


def write_documents(docs: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    docs.write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_summary(one_row: DataFrame, path: str) -> None:
    """A summary has one row (or one per group of a report): a single file."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def write_samples_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """Per-sample rows with fixed decimals and a header per file."""
    shown = [
        F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes
    ]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def write_confusion_csv(confusion: DataFrame, path: str) -> None:
    """The matrix has one row per class; its fixed order is kept in a single file."""
    ordered = confusion.coalesce(1).sortWithinPartitions("position").drop("position")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def manifest(samples: DataFrame, name: str, seed: int = 42, shown: int = 100) -> DataFrame:
    """seed, sample count and the fingerprint of the first sorted names."""
    first = samples.select(name).orderBy(name).limit(shown)
    print_ = first.agg(
        F.substring(F.md5(F.array_join(F.array_sort(F.collect_list(name)), "|")), 1, 12)
        .alias("fingerprint")
    )
    count = samples.agg(F.count(F.lit(1)).alias("n_samples"))
    one = F.lit(1)
    return (
        count.withColumn("_k", one).join(print_.withColumn("_k", one), "_k").drop("_k")
        .withColumn("seed", F.lit(seed))
    )
