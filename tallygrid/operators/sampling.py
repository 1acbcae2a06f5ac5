"""Deterministic samples and limits (each is a report in its own right)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.partitioning import first_k, running_sums


def first_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First n rows in a total order (a distributed top-n, no full sort)."""
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows drawn without replacement, the same ones for the same seed: the first by the
    MD5 of seed and ids."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))
    return df.orderBy(key, *ids).limit(n)


def even_steps(df: DataFrame, keys: Sequence[str], position: str, k: int) -> DataFrame:
    """Every (n // k)-th row per key, k at most.

    ``position`` is the row's 1-based place within its key; group sizes come from an
    aggregate, so no task holds a whole group.
    """
    sizes = df.groupBy(*keys).agg(F.max(position).alias("_n"))
    step = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    picked = df.join(sizes, list(keys)).where(
        ((F.col(position) - 1) % step == 0) & (F.floor((F.col(position) - 1) / step) < k)
    )
    return picked.drop("_n")


def every_nth(df: DataFrame, order: str, n: int = 100, chunk_bits: int = 16) -> DataFrame:
    """The first row and every n-th after it, in the order of a unique integer column.

    Rows are numbered inside chunks of the column's values, on top of the totals of the
    chunks before, so no task holds all rows.
    """
    rows = df.withColumn("_chunk", F.shiftright(F.col(order).cast("long"), chunk_bits))
    numbered = running_sums(rows, {"_before": F.lit(1)}, (), order, "_chunk", inclusive=False)
    return numbered.where(F.col("_before") % n == 0).drop("_chunk", "_before")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    return first_k(df, keys, order, k).drop("rank")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in order (an aggregate: partial before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    ).select(*keys, "_r.*")
