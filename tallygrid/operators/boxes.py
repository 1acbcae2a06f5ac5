"""Detections and structure boxes: filters, indices, grids of cell boxes, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import geometry as G
from tallygrid.partitioning import attach, row_chunk, running_sums

# --- fixed values: structure label ids -------------------------------------------------
STRUCTURE_KINDS = {
    0: "table", 1: "columns", 2: "rows", 3: "column_headers", 4: "row_headers", 5: "spanning_cells",
}


def above(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Boxes scored strictly above the threshold."""
    return df.where(F.col("score") > threshold)


def best_detection(images: DataFrame, detections: DataFrame, pad: int = 10) -> DataFrame:
    """Highest-scored box per image (first on ties), padded; the whole image if none.

    ``images`` holds image_id, width, height.
    """
    top = detections.groupBy("image_id").agg(
        F.min_by(F.struct("x1", "y1", "x2", "y2"), F.struct(-F.col("score"), F.col("idx"))).alias("b")
    )
    w, h = F.col("width"), F.col("height")
    crop = G.padded(tuple(F.col(f"b.{c}") for c in ("x1", "y1", "x2", "y2")), pad, w, h)
    whole = (F.lit(0), F.lit(0), w, h)
    return images.join(top, "image_id", "left").select(
        "image_id",
        *[F.coalesce(c, o).alias(n) for c, o, n in zip(crop, whole, ("x1", "y1", "x2", "y2"))],
        F.col("b").isNotNull().alias("detected"),
    )


def all_crops(images: DataFrame, detections: DataFrame, pad: int = 10) -> DataFrame:
    """Every detection padded and clipped to its image."""
    crop = G.padded(G.box(), pad, F.col("width"), F.col("height"))
    return detections.join(images, "image_id").select(
        "image_id", "idx", *[c.alias(n) for c, n in zip(crop, ("x1", "y1", "x2", "y2"))], "score"
    )


def index_structure(elements: DataFrame) -> DataFrame:
    """Number rows by y1 and columns by x1 within each table (ties by input index).

    Counted stretch by stretch of the page, so a table of any length is spread out.
    """
    key = F.when(F.col("kind") == "columns", F.col("x1")).otherwise(F.col("y1"))
    placed = elements.withColumn("_o", F.struct(key.alias("k"), F.col("idx"))).withColumn(
        "_c", F.floor(key / 4096.0)
    )
    counted = running_sums(placed, {"_n": F.lit(1)}, ("table_id", "kind"), "_o", "_c")
    return counted.withColumn("position", (F.col("_n") - 1).cast("int")).drop("_o", "_c", "_n")


def lines(elements: DataFrame, kind: str, prefix: str) -> DataFrame:
    return elements.where(F.col("kind") == kind).select(
        "table_id", F.col("idx").alias(f"{prefix}_idx"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in ("x1", "y1", "x2", "y2", "score")],
    )


def grid_boxes(elements: DataFrame) -> DataFrame:
    """Intersection box of every row and column, header flag and mean confidence.

    The output is the grid itself; columns are copied to the row chunks of their table
    so that no join key holds more than one chunk of rows.
    """
    rows = lines(elements, "rows", "r").withColumn("row_chunk", row_chunk("r_idx"))
    sizes = rows.groupBy("table_id").agg((F.max("r_idx") + 1).alias("n_rows"))
    pairs = attach(rows, lines(elements, "columns", "c"), sizes, how="inner")
    lo = lambda c: F.greatest(f"r_{c}", f"c_{c}")
    hi = lambda c: F.least(f"r_{c}", f"c_{c}")
    return pairs.select(
        "table_id", F.col("r_idx").alias("row_idx"), F.col("c_idx").alias("col_idx"),
        lo("x1").alias("x1"), lo("y1").alias("y1"), hi("x2").alias("x2"), hi("y2").alias("y2"),
        ((F.col("r_idx") == 0) | (F.col("c_idx") == 0)).alias("is_header"),
        ((F.col("r_score") + F.col("c_score")) / 2).alias("confidence"),
    )


def _html_row(tag: str, texts: Column) -> Column:
    return F.concat(
        F.lit("<tr>"),
        F.array_join(
            F.transform(texts, lambda t: F.concat(F.lit(f"<{tag}>"), t, F.lit(f"</{tag}>"))), ""
        ),
        F.lit("</tr>"),
    )


def cells_to_html(cells: DataFrame) -> DataFrame:
    """table_id, part, html: first row as header, the rest as body.

    A table longer than one chunk of rows gives one fragment per chunk, in ``part``
    order; concatenated they are the document.
    """
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct("col_idx", "text"))), lambda s: s["text"]
    )
    rows = cells.groupBy("table_id", row_chunk().alias("part"), "row_idx").agg(texts.alias("texts"))
    line = F.when(
        F.col("row_idx") == 0,
        F.concat(F.lit("<thead>"), _html_row("th", F.col("texts")), F.lit("</thead><tbody>")),
    ).otherwise(_html_row("td", F.col("texts")))
    parts = rows.groupBy("table_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))).alias("lines")
    )
    last = parts.groupBy("table_id").agg(F.max("part").alias("last"))
    body = F.array_join(F.transform("lines", lambda s: s["line"]), "")
    return parts.join(last, "table_id").select(
        "table_id", "part",
        F.concat(
            F.when(F.col("part") == 0, "<table>").otherwise(""), body,
            F.when(F.col("part") == F.col("last"), "</tbody></table>").otherwise(""),
        ).alias("html"),
    )


def headers(cells: DataFrame) -> DataFrame:
    """table_id, col_idx, header: the first row."""
    return cells.where(F.col("row_idx") == 0).select(
        "table_id", "col_idx", F.col("text").alias("header")
    )


def labels(cells: DataFrame) -> DataFrame:
    """table_id, row_idx, label: the first column."""
    return cells.where(F.col("col_idx") == 0).select(
        "table_id", "row_idx", F.coalesce("text", F.lit("")).alias("label")
    )
