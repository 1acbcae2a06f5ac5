"""Mixing sources to target weights by hash thresholds.

Every row has a hash; a source takes its whole repeats and, for what is left of its
target, the rows whose hash is below a threshold.  The threshold comes from histograms:
sizes are summed by source and leading hash bits, the bucket in which the budget ends is
found, and only that bucket is summed again by the next bits.  Nothing is sorted, and
the data are filtered by comparing a hash with a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Five levels of 12 bits use up the hash, so the threshold falls between two hashes.
LEVELS = 5
BITS = 12
HASH_BITS = LEVELS * BITS

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits from the id and the text, so that rows which share an id still differ."""
    parts = [F.lit(str(seed)), doc_id.cast("string"), F.md5(text)]
    key = F.concat_ws(":", *(F.coalesce(p, F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, size, hash``"""
    text = docs["text"].cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"), row_hash(docs["doc_id"], text, seed).alias("hash"),
    )


def targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``source, source_size, target``: all sizes shared by weight, up to ``max_repeats``
    times the source, the excess reshared.

    Sources in order of how soon they are full; the full ones are the first so many, and
    the others share what these leave.  A row per source: the recipe, not the data.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    recipe = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    recipe = recipe.select("source", "source_size", weight.cast("long").alias("weight"))
    most = F.col("source_size") * max_repeats
    soon = Window.orderBy((most / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    recipe = recipe.select(
        "*", most.alias("most"), F.row_number().over(soon).alias("place"),
        F.coalesce(F.sum(most).over(soon.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(soon.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        F.sum("source_size").over(every).alias("total"),
    )
    level = (F.col("total") - F.col("full")).cast("double") / F.col("rest")
    recipe = recipe.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("place"))
    recipe = recipe.withColumn("fits", F.min_by("level", fits).over(every))
    return recipe.select(
        "source", "source_size",
        F.least(F.col("most").cast("double"), F.col("fits") * F.col("weight")).alias("target"),
    )


def thresholds(sizes: DataFrame, goal: DataFrame, scratch: Scratch) -> DataFrame:
    """``source, source_size, target, whole, below``: every row is taken ``whole`` times,
    and once more where its hash is less than ``below``.

    The rows below the threshold come as near to the rest of the target as any: the last
    hash is taken if that leaves less than its omission.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    bounds = goal.select("*", F.coalesce(whole, F.lit(0)).cast("long").alias("whole"))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    bounds = bounds.select("*", rest.alias("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("last"))
    bounds = scratch.keep(bounds, "bounds-0")
    for k in range(LEVELS):
        shift = HASH_BITS - BITS * (k + 1)
        mine = sizes.withColumnRenamed("source", "_source")
        inside = mine.join(
            bounds,
            F.col("source").eqNullSafe(F.col("_source"))
            & (F.shiftright("hash", shift + BITS) == F.col("prefix")),
        )
        known = ["source", "source_size", "target", "whole", "rest", "taken"]
        histogram = inside.groupBy(*known, F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("amount")
        )
        upto = Window.partitionBy("source").orderBy("bucket")
        summed = histogram.withColumn("upto", F.col("taken") + F.sum("amount").over(upto))
        ends = summed.where(F.col("upto") > F.col("rest")).groupBy(*known).agg(
            F.min("bucket").alias("prefix"), F.min_by("upto", "bucket").alias("upto"),
            F.min_by("amount", "bucket").alias("last"),
        )
        bounds = scratch.keep(
            ends.select(
                *known[:-1], "prefix", (F.col("upto") - F.col("last")).alias("taken"), "last"
            ),
            f"bounds-{k + 1}",
        )
    more = 2 * (F.col("rest") - F.col("taken")) > F.col("last")
    below = bounds.select(
        F.col("source").alias("_source"), (F.col("prefix") + more.cast("long")).alias("below")
    )
    first = scratch.spark.read.parquet(scratch.path("bounds-0"))
    joined = first.join(below, F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select(
        "source", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")
    )


def with_copies(rows: DataFrame, source: Column, hashed: Column, bounds: DataFrame) -> DataFrame:
    """``rows`` with the bounds of their source and ``copies``, how often each is taken."""
    named = bounds.withColumnRenamed("source", "_source")
    extra = (hashed < F.col("below")).cast("long")
    joined = rows.join(named, source.eqNullSafe(F.col("_source")))
    return joined.withColumn("copies", F.col("whole") + extra)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` per row of ``docs``.

    Size counts words; sources in code point order, null last, weigh ``weights`` in turn
    and share the total of all sizes.  Null texts have size 0; rows of one source that
    agree in doc_id and text share one hash and so one decision; a source without words
    has target 0.  Only doc_id, text and source are read.  An empty table gives an empty
    result.  The same table and seed give the same mix.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    sizes = scratch.keep(measured(docs, seed), "sizes")
    goal = targets(sizes, weights, max_repeats)
    bounds = scratch.keep(thresholds(sizes, goal, scratch), "thresholds")
    taken = with_copies(sizes, F.col("source"), F.col("hash"), bounds)
    return taken.select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 0,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns as they were."""
    scratch = Scratch(docs.sparkSession, "mixture")
    sizes = scratch.keep(measured(docs, seed), "sizes")
    goal = targets(sizes, weights, max_repeats)
    bounds = scratch.keep(thresholds(sizes, goal, scratch), "thresholds")
    rows = docs.select(
        F.struct("*").alias("row"), docs["source"].cast("string").alias("name"),
        row_hash(docs["doc_id"], docs["text"].cast("string"), seed).alias("hash"),
    )
    taken = with_copies(rows, F.col("name"), F.col("hash"), bounds)
    times = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return taken.select("row", F.explode(times)).select("row.*")
