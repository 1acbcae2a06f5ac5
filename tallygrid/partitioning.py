"""Keeping work evenly spread when one table holds a large share of all rows.

``row_idx`` is an INT, so splitting it into chunks of 2**16 rows bounds both sides:
a (table, chunk) group has at most 65,536 rows and a table at most 32,768 chunks.
Ordered computations run inside chunks and are joined up by a second, much smaller
pass over chunk totals; per-table facts are copied to the chunks of their table
before they are joined back.  Tables of ordinary size have the single chunk 0 and
pay nothing for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 16


def row_chunk(row_idx: str | Column = "row_idx") -> Column:
    return F.shiftright(F.col(row_idx) if isinstance(row_idx, str) else row_idx, CHUNK_BITS)


def with_chunk(df: DataFrame) -> DataFrame:
    """Add ``row_chunk`` (kept if the frame already has it)."""
    return df if "row_chunk" in df.columns else df.withColumn("row_chunk", row_chunk())


def extent(cells: DataFrame) -> DataFrame:
    """One row per table: n_rows, n_cols (from the largest index seen)."""
    return cells.groupBy("table_id").agg(
        (F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols")
    )


def attach(
    rows: DataFrame,
    facts: DataFrame,
    n_rows: DataFrame | None = None,
    on: Sequence[str] = ("table_id",),
    how: str = "left",
) -> DataFrame:
    """Join per-table (or per-column) ``facts`` onto chunked ``rows``.

    ``facts`` needs ``n_rows`` or takes it from the frame given.  Each fact row is
    copied once per chunk of its table, so no join key holds more than one chunk.
    Facts are few beside the rows: they are hashed, and the rows need no sort.
    """
    last = F.greatest(row_chunk(F.col("n_rows") - 1), F.lit(0))
    chunks = F.explode(F.sequence(F.lit(0), last)).alias("row_chunk")
    if n_rows is None:
        copies = facts.select("*", chunks)
    else:
        copies = facts.join(n_rows.select("table_id", "n_rows"), "table_id").select(
            *facts.columns, chunks
        )
    return rows.join(copies.hint("shuffle_hash"), [*on, "row_chunk"], how)


def running_sums(
    rows: DataFrame,
    sums: dict[str, Column],
    keys: Sequence[str] = ("table_id",),
    order: str = "row_idx",
    chunk: str = "row_chunk",
    inclusive: bool = True,
) -> DataFrame:
    """Running totals over ``order`` per key, computed chunk by chunk.

    ``rows`` holds one row per (keys, order) and a non-negative integer ``chunk``
    that is monotone in ``order``.  A key with one chunk finds nothing to carry.
    """
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(
        Window.unboundedPreceding, end
    )
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, chunk)
        .agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
        .select(*keys, chunk, *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums])
        .where(" OR ".join(f"_c_{n} <> 0" for n in sums))
    )
    local = rows.select("*", *[F.sum(e).over(inside).alias(f"_l_{n}") for n, e in sums.items()])
    joined = local.join(carried, [*keys, chunk], "left")
    zero = F.lit(0)
    total = {
        n: F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero) for n in sums
    }
    return joined.select(*rows.columns, *[e.alias(n) for n, e in total.items()])


def neighbours(
    rows: DataFrame,
    back: dict[str, Column],
    ahead: dict[str, Column],
    keys: Sequence[str],
    order: str,
    chunk: Column,
) -> DataFrame:
    """Nearest non-null value strictly before / after each row along ``order``.

    Same two-level scheme as :func:`running_sums`; ``order`` is unique per key.
    """
    rows = rows.withColumn("_k", chunk)
    up = Window.partitionBy(*keys, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys, "_k").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    kup = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    kdown = Window.partitionBy(*keys).orderBy("_k").rowsBetween(1, Window.unboundedFollowing)
    pos = F.col(order)
    per_chunk = rows.groupBy(*keys, "_k").agg(
        *[F.max_by(e, F.when(e.isNotNull(), pos)).alias(f"_b_{n}") for n, e in back.items()],
        *[F.min_by(e, F.when(e.isNotNull(), pos)).alias(f"_a_{n}") for n, e in ahead.items()],
    )
    carried = per_chunk.select(
        *keys,
        "_k",
        *[F.last(f"_b_{n}", ignorenulls=True).over(kup).alias(f"_cb_{n}") for n in back],
        *[F.first(f"_a_{n}", ignorenulls=True).over(kdown).alias(f"_ca_{n}") for n in ahead],
    )
    local = rows.select(
        "*",
        *[F.last(e, ignorenulls=True).over(up).alias(f"_lb_{n}") for n, e in back.items()],
        *[F.first(e, ignorenulls=True).over(down).alias(f"_la_{n}") for n, e in ahead.items()],
    )
    out = local.join(carried, [*keys, "_k"], "left")
    return out.select(
        *[c for c in rows.columns if c != "_k"],
        *[F.coalesce(f"_lb_{n}", f"_cb_{n}").alias(n) for n in back],
        *[F.coalesce(f"_la_{n}", f"_ca_{n}").alias(n) for n in ahead],
    )


def first_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key.

    Spark turns ``row_number() <= k`` into a group limit that runs before the
    shuffle as well, so a hot key sends at most k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
