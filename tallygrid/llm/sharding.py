"""Sharding by a two-pass external shuffle.

Pass one scatters the rows over buckets that fit in memory, by a seeded hash, shuffles
each bucket by Fisher and Yates, and writes it.  Pass two numbers the rows along the
buckets and cuts the sequence into shards whose counts differ by one at most; a bucket
meets one or two shards, so shards are written without another exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.store import Scratch
from tallygrid.partitioning import running_sums

BUCKET_BYTES = 4 << 20
LAW = "rows"


def shuffled(
    docs: DataFrame, shards: int = 16, seed: int = 0, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``row`` (the input row), ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0).

    Rows are placed by the hash of their position in the input, so neither null nor
    repeated ids or texts gather anywhere: every bucket gets about ``bucket_bytes`` of
    text.  Null and empty texts count as one byte.  With fewer rows than shards the last
    ones are empty; an empty table gives an empty result.  The input should be a stored
    table, whose rows keep their positions.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    size = F.coalesce(F.octet_length(docs["text"].cast("string")), F.lit(0)) + F.lit(1)
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = -(-total // bucket_bytes) or 1
    placed = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(buckets))
    # in the order of the input first: the same table and seed give the same shards
    by_place = F.array_sort(
        F.collect_list(F.struct("at", "row")),
        lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0),
    )
    mixed = placed.groupBy(bucket.alias("bucket")).agg(by_place.alias("rows"))
    # stored row by row: no reader meets a whole bucket
    mixed = mixed.select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("k", "item"))
    stored = scratch.keep(mixed.select("bucket", "k", "item.row"), "buckets")
    lengths = stored.groupBy("bucket").agg(F.count("*").alias("n"))
    lengths = scratch.keep(lengths.withColumn("row_chunk", F.shiftright("bucket", 12)), "lengths")
    count = lengths.agg(F.sum("n")).first()[0] or 1
    before = running_sums(lengths, {"before": F.col("n")}, (), "bucket", inclusive=False)
    # a few bytes a bucket, stored, so that Spark knows whether they fit every task
    offsets = scratch.keep(before.select("bucket", "before"), "offsets")
    rows = stored.join(offsets, "bucket")
    rows = rows.select("row", (F.col("before") + F.col("k")).alias("place"))
    rows = rows.withColumn("shard", F.expr(f"place * {shards} div {count}"))
    start = F.expr(f"(shard * {count} + {shards - 1}) div {shards}")
    return rows.select("row", F.col("shard").cast("int"), (F.col("place") - start).alias("slot"))


def sharded(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``.  Columns of these names in the
    input are kept as ``input_shard`` and ``input_slot``."""
    clashes = {c: f"input_{c}" for c in docs.columns if c.lower() in ("shard", "slot")}
    renamed = docs.withColumnsRenamed(clashes)
    return shuffled(renamed, shards, seed).select("row.*", "shard", "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard, each file in slot order; buckets are written as they stand."""
    rows.write.partitionBy("shard").mode("overwrite").parquet(path)
