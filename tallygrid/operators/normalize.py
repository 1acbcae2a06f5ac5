"""Numbers of a whole table: column metadata from the header rows, then every cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions import numeric as N
from tallygrid.partitioning import attach, extent, with_chunk


def column_metadata(cells: DataFrame, header_rows: int = 3, compat: bool = False) -> DataFrame:
    """table_id, col_idx, currency, scale, unit, column_type, year.

    Later header rows overwrite earlier ones; the last currency and the last scale in
    column order fill the columns that state none.  Only the header rows are read
    (``row_idx < header_rows`` reaches the scan) and every step is an aggregate with
    map-side partials.
    """
    text, row = F.col("text"), F.col("row_idx")
    kind = N.cell_type(text, compat)
    head = (
        cells.where(row < header_rows)
        .withColumn("kind", kind)
        .withColumn("u", F.when(F.col("kind") == "unit_header", N.unit_header(text, compat)))
    )
    u = F.col("u")
    scaled = u["scale"] > 1
    per_column = head.groupBy("table_id", "col_idx").agg(
        F.max_by(u["currency"], F.when(u["currency"].isNotNull(), row)).alias("own_currency"),
        F.max_by(u["scale"], F.when(scaled, row)).alias("own_scale"),
        F.max_by(u["unit"], F.when(scaled, row)).alias("unit"),
        F.max_by("kind", F.when(F.col("kind").isin("year", "note"), row)).alias("kind"),
        F.max_by(
            N.strip(text).try_cast("int"), F.when(F.col("kind") == "year", row)
        ).alias("year"),
        F.min("row_idx").alias("first_row"),
    )
    col = F.col("col_idx")
    # a table has one row per column here, so its window is small however many rows it has
    whole = Window.partitionBy("table_id")
    filled = per_column.select(
        "*",
        F.max(F.when(F.col("first_row") == 0, col)).over(whole).alias("last_col"),
        F.max_by("own_currency", F.when(F.col("own_currency").isNotNull(), col)).over(whole).alias("tc"),
        F.max_by("own_scale", F.when(F.col("own_scale").isNotNull(), col)).over(whole).alias("ts"),
    )
    kind = F.when(col == 0, "label").otherwise(F.coalesce("kind", F.lit("unknown")))
    fills = ~kind.isin("label", "note")
    one = F.lit(1).cast("bigint")
    return (
        filled.where(col <= F.col("last_col"))
        .select(
            "table_id",
            "col_idx",
            F.coalesce("own_currency", F.when(fills, F.col("tc"))).alias("currency"),
            F.coalesce("own_scale", F.when(fills, F.col("ts")), one).alias("scale"),
            "unit",
            kind.alias("column_type"),
            "year",
        )
    )


def normalize_texts(
    df: DataFrame,
    text: str = "text",
    kind: str | None = None,
    default_currency: str | None = None,
    default_scale: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """Add value, currency, unit, scale, is_negative, normalized, cell_type.

    Cells that are not numeric keep the column's currency and scale and have no value.
    """
    t = F.col(text)
    null = F.lit(None).cast("string")
    dc = F.col(default_currency) if default_currency else null
    ds = F.col(default_scale) if default_scale else F.lit(1).cast("bigint")
    numeric = F.col("cell_type") == "numeric"
    # plain amounts go the short way: their brackets are their sign, and they name no unit
    plain = F.col("_plain")
    thousands = F.col("_s").contains("000") & F.col("_s").rlike(r"\b000\b")
    bare_unit = F.when(thousands, "000") if compat else null
    staged = (
        df.withColumn("cell_type", F.col(kind) if kind else N.cell_type(t, compat))
        .withColumn("_plain", F.when(numeric, N.plain_amount(t)))
        .withColumn("_s", F.when(plain, F.translate(t, "()", "")).when(numeric, N.unsigned(t)))
        .withColumn("_bare", F.when(plain, True).when(numeric, N.bare_number(F.col("_s"))))
        .withColumn(
            "unit",
            F.when(F.col("_bare"), bare_unit).when(numeric, N.unit(F.col("_s"), compat)),
        )
        .withColumn("_own", F.when(numeric, N.unit_scale(F.col("unit"))))
        .withColumn("scale", F.when(F.col("_own") > 1, F.col("_own")).otherwise(ds))
        .withColumn(
            "currency",
            F.coalesce(F.when(numeric & ~F.col("_bare"), N.currency(F.col("_s"), compat)), dc),
        )
        .withColumn("is_negative", F.when(plain, t.startswith("(")).when(numeric, N.is_negative(t)).otherwise(False))
        .withColumn("_n", F.when(plain, F.translate(F.col("_s"), ",", "").try_cast("double")).when(numeric, N.first_number(F.col("_s"))) * F.col("scale"))
        .withColumn("value", F.when(F.col("is_negative"), -F.col("_n")).otherwise(F.col("_n")))
        .withColumn(
            "normalized",
            F.when(F.col("value").isNotNull(), N.money_text(F.col("value"), F.col("currency"))),
        )
    )
    return staged.drop("_plain", "_s", "_bare", "_own", "_n")


def normalize_cells(
    cells: DataFrame,
    metadata: DataFrame | None = None,
    header_rows: int = 3,
    compat: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Normalise whole tables; numbers inside header rows are headers without a value.

    ``sizes`` (table_id, n_rows) saves a pass over the cells where it is known.
    """
    metadata = column_metadata(cells, header_rows, compat) if metadata is None else metadata
    meta = metadata.select(
        "table_id", "col_idx", F.col("currency").alias("_dc"), F.col("scale").alias("_ds")
    )
    joined = attach(with_chunk(cells), meta, extent(cells) if sizes is None else sizes, on=("table_id", "col_idx"))
    kind = N.cell_type(F.col("text"), compat)
    typed = joined.withColumn("_kind", kind).withColumn(
        "_kind",
        F.when((F.col("row_idx") < header_rows) & (F.col("_kind") == "numeric"), "header").otherwise(
            F.col("_kind")
        ),
    ).withColumn("_ds", F.coalesce("_ds", F.lit(1).cast("bigint")))
    out = normalize_texts(typed, "text", "_kind", "_dc", "_ds", compat)
    return out.drop("_kind", "_dc", "_ds", "row_chunk")


def raw_values(cells: DataFrame) -> DataFrame:
    """cells with ``value`` parsed leniently, for tables that were never normalised."""
    return cells.withColumn("value", N.lenient_number(F.col("text")))
