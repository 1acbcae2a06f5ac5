"""Tables from parquet datasets, HTML, markdown, sparse cells and OCR output."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tallygrid import schemas
from tallygrid.functions import geometry as G
from tallygrid.functions.numeric import strip
from tallygrid.operators.teds import is_well_nested
from tallygrid.partitioning import extent

# --- parquet datasets ------------------------------------------------------------------


def read_otsl(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """filename, html of rows that carry an image; the image itself is never read out."""
    df = spark.read.parquet(f"{path}/{split}-*.parquet")
    as_text = lambda c: (
        F.array_join(c, "") if isinstance(df.schema[c].dataType, ST.ArrayType) else F.col(c)
    )
    html = [as_text(c) for c in ("html", "html_restored") if c in df.columns]
    return df.where(F.col("image").isNotNull()).select("filename", F.coalesce(*html).alias("html"))


def read_synfintabs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SYNFINTABS).parquet(path)


def synfintabs_cells(df: DataFrame) -> DataFrame:
    """table_id, row_idx, col_idx, text, gt_label, n_rows, n_cols, first_text."""
    sized = df.select(F.col("id").alias("table_id"), "rows", F.size("rows").alias("n_rows"))
    rows = sized.select("table_id", "n_rows", F.posexplode("rows").alias("row_idx", "r"))
    return rows.select(
        "table_id", "row_idx", "n_rows", F.size("r.cells").alias("n_cols"),
        F.get("r.cells", F.lit(0))["text"].alias("first_text"),
        F.posexplode("r.cells").alias("col_idx", "c"),
    ).select(
        "table_id", "row_idx", "col_idx", F.coalesce("c.text", F.lit("")).alias("text"),
        F.col("c.label").alias("gt_label"), "n_rows", "n_cols", "first_text",
    )


def synfintabs_questions(df: DataFrame) -> DataFrame:
    q = F.col("q")
    return df.select(F.col("id").alias("table_id"), F.explode("questions").alias("q")).select(
        "table_id", q["id"].alias("question_id"), q["question"].alias("question"),
        q["answer"].alias("answer"), q["answer_keys"]["row"].alias("row_key"),
        q["answer_keys"]["col"].alias("col_key"),
    )


# --- HTML --------------------------------------------------------------------------------


def html_to_cells(df: DataFrame, html: str = "html", rows_before: str | None = None) -> DataFrame:
    """table_id, row_idx, col_idx, text of td/th cells; rows without cells are dropped.

    Well-nested tables stay inside built-in expressions, the rest goes through the
    stdlib parser in Arrow batches.  ``rows_before`` (optional) offsets row numbers.
    """
    good = F.coalesce(is_well_nested(F.col(html)), F.lit(False))
    keep = [c for c in df.columns if c != html]
    rows = F.filter(
        F.transform(
            F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1),
            lambda r: F.transform(
                F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1),
                lambda c: strip(F.regexp_replace(c, r"<[^>]*>", "")),
            ),
        ),
        lambda r: F.size(r) > 0,
    )
    neat = df.where(good).select(*keep, F.posexplode(rows).alias("row_idx", "r")).select(
        *keep, "row_idx", F.posexplode("r").alias("col_idx", "text")
    )
    kept = ST.StructType([df.schema[c] for c in keep])
    schema = ST.StructType(
        [*kept.fields, ST.StructField("row_idx", ST.IntegerType()),
         ST.StructField("col_idx", ST.IntegerType()), ST.StructField("text", ST.StringType())]
    )
    odd = df.where(~good).select(*keep, F.col(html).alias("_html")).mapInPandas(_parser(keep), schema)
    out = neat.unionByName(odd)
    if rows_before:
        out = out.withColumn("row_idx", (F.col("row_idx") + F.col(rows_before)).cast("int"))
    return out


def _parser(keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        class Grid(HTMLParser):
            def __init__(self) -> None:
                super().__init__()
                self.rows: list[list[str]] = []
                self.cell: list[str] | None = None

            def handle_starttag(self, tag, attrs):
                if tag == "tr":
                    self.rows.append([])
                elif tag in ("td", "th"):
                    self.cell = []

            def handle_endtag(self, tag):
                if tag in ("td", "th") and self.cell is not None:
                    if not self.rows:
                        self.rows.append([])
                    self.rows[-1].append("".join(self.cell).strip())
                    self.cell = None

            def handle_data(self, data):
                if self.cell is not None:
                    self.cell.append(data)

        for batch in batches:
            out = []
            for *key, markup in batch[[*keep, "_html"]].itertuples(index=False, name=None):
                grid = Grid()
                grid.feed(markup or "")
                rows = [r for r in grid.rows if r]
                out += [(*key, i, j, t) for i, row in enumerate(rows) for j, t in enumerate(row)]
            yield pd.DataFrame(out, columns=[*keep, "row_idx", "col_idx", "text"])

    return run


# --- markdown -----------------------------------------------------------------------------


def markdown_to_cells(df: DataFrame, markdown: str = "markdown", dialect: str = "bounded") -> DataFrame:
    """table_id..., row_idx, col_idx, text of a pipe table.

    ``bounded``: lines starting and ending with ``|``, blank cells dropped;
    ``first_block``: any line with ``|`` up to the first line without one after the
    table began; ``inner``: bounded lines with inner blanks kept.
    Separator rows are dropped throughout.  Lines are walked inside their own document.
    """
    keep = [c for c in df.columns if c != markdown]
    lines = F.transform(F.split(markdown, "\n"), lambda x: strip(x))
    piped = lambda x: x.contains("|")
    if dialect == "first_block":
        flags = F.transform(lines, piped)
        begin = F.array_position(flags, True)
        rest = F.slice(lines, F.greatest(begin, F.lit(1)).cast("int"), F.size(lines))
        stop = F.array_position(F.transform(rest, piped), False)
        lines = F.when(begin == 0, F.array().cast("array<string>")).otherwise(
            F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)
        )
    else:
        lines = F.filter(lines, lambda x: x.rlike(r"^\|.*\|$"))
    lines = F.filter(lines, lambda x: ~x.rlike(r"^[|\s:\-]+$") | ~x.contains("-"))

    def cells(x: Column) -> Column:
        parts = F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: strip(c))
        return F.filter(parts, lambda c: c != "") if dialect == "bounded" else parts

    rows = F.filter(F.transform(lines, cells), lambda r: F.size(r) > 0)
    return df.select(*keep, F.posexplode(rows).alias("row_idx", "r")).select(
        *keep, "row_idx", F.posexplode("r").alias("col_idx", "text")
    )


# --- sparse and recognised cells --------------------------------------------------------------


def dense_grid(cells: DataFrame) -> DataFrame:
    """Every (row, column) up to the largest seen, '' where no cell was given."""
    size = extent(cells)
    rows = size.select(
        "table_id", "n_rows", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_idx")
    )
    grid = rows.select(
        "table_id", "row_idx", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col_idx")
    )
    return grid.join(cells, ["table_id", "row_idx", "col_idx"], "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


def ocr_boxes(raw: DataFrame, pad_x: float = 0.0, pad_y: float = 0.0) -> DataFrame:
    """Engine output (table_id, box_id, text, polygon, confidence) to boxes.

    ``polygon`` is ARRAY<STRUCT<x, y>>; items without text or with fewer than four
    corners are skipped; the padding added before recognition is taken off again.
    """
    b = G.polygon_box(F.col("polygon"))
    off = (pad_x, pad_y, pad_x, pad_y)
    return raw.where((F.size("polygon") >= 4) & (strip(F.col("text")) != "")).select(
        "table_id", "box_id", "text",
        *[(c - o).alias(n) for c, o, n in zip(b, off, ("x1", "y1", "x2", "y2"))], "confidence",
    )


def converted_cells(table_cells: DataFrame, page_texts: DataFrame) -> DataFrame:
    """Converter output (table_id, seq, text, bbox): table cells, then page texts.

    Missing boxes become [0, 0, 100, 20], confidence is .95, blank texts are dropped.
    """
    both = table_cells.withColumn("part", F.lit(0)).unionByName(page_texts.withColumn("part", F.lit(1)))
    default = F.array(*[F.lit(v) for v in (0.0, 0.0, 100.0, 20.0)])
    b = F.coalesce("bbox", default)
    return both.where(strip(F.coalesce("text", F.lit(""))) != "").select(
        "table_id", "part", "seq", strip(F.col("text")).alias("text"),
        *[b[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.lit(0.95).alias("confidence"),
    )


# --- files ---------------------------------------------------------------------------------------


def list_files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """name, path, length, modified of the files with an extension; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}")
    return files.option("recursiveFileLookup", True).load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length",
        F.col("modificationTime").alias("modified"),
    )


def with_existing_file(samples: DataFrame, files: DataFrame, name: str = "filename") -> DataFrame:
    """Samples whose file is there."""
    present = files.select(F.col("name").alias(name))
    return samples.join(present, name, "left_semi")

