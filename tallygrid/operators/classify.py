"""Classes of cells and rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.numeric import strip
from tallygrid.partitioning import attach, running_sums, with_chunk
from tallygrid.storage import stored

CELL_LABELS = ["section_title", "column_header", "row_header", "data", "currency_unit"]

# --- fixed values: patterns of the five-label classifier ---------------------------
CURRENCY_UNIT = (
    r"(?i)^[$£€¥₹]$|^[$£€¥₹]\s*'?000s?$|^'?000s?$|^millions?$|^billions?$|^thousands?$"
    r"|^USD$|^GBP$|^EUR$"
)
NUMBER = (
    r"(?i)^-?\d+$|^-?\d{1,3}(,\d{3})*$|^-?\d+\.\d+$|^-?\d{1,3}(,\d{3})*\.\d+$"
    r"|^\(-?\d{1,3}(,\d{3})*\)$|^\(-?\d{1,3}(,\d{3})*\.\d+\)$|^[$£€¥₹]?\s*-?\d|^-$|^nil$|^—$"
)
SECTION_WORDS = [
    "total", "subtotal", "net", "gross", "assets", "liabilities",
    "equity", "revenue", "expenses", "profit", "loss", "income",
    "creditors", "debtors", "capital", "reserves", "provisions",
    "amounts falling due", "amounts owed", "called up", "share capital",
]

# --- fixed values: row keywords ------------------------------------------------------
TOTAL_ROWS = [
    "total assets", "total liabilities", "total equity",
    "total revenue", "grand total", "net income", "net profit",
    "cash and cash equivalents at the end",
    "cash at end", "closing cash",
    "at the end of the year", "at end of year",
]
CASH_FLOW_ROWS = (
    r"net\s*cash\s*flow.*?(from|used)|cash\s*flow\s*(from|used)"
    r"|net\s*(increase|decrease).*cash|increase.*decrease.*cash"
)
SUBTOTAL_ROWS = ["subtotal", "sub-total", "sub total"]
SECTION_ROWS = [
    "non-current assets", "current assets",
    "non-current liabilities", "current liabilities",
    "shareholders equity", "stockholders equity",
    "equity attributable",
    "revenue", "cost of sales", "operating expenses",
    "changes in working capital",
]
TOTAL_WORDS = [
    "total", "net", "sum", "subtotal", "grand total",
    "balance", "aggregate", "overall",
]

UPPER_ONLY = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"


def has_any(text: Column, keywords: Sequence[str]) -> Column:
    """True when the lower-cased, stripped text contains one of the keywords."""
    s = F.lower(strip(text))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | s.contains(k)
    return F.coalesce(hit, F.lit(False))


# --- cells -----------------------------------------------------------------------------


def cell_label(text: Column, row: Column, col: Column) -> Column:
    """section_title / column_header / row_header / data / currency_unit from text."""
    s = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(s == "", "data")
        .when(s.rlike(CURRENCY_UNIT), "currency_unit")
        .when((row == 0) & (col == 0) & F.lower(s).isin("note", "notes"), "data")
        .when(row == 0, "column_header")
        .when(s.rlike(NUMBER), "data")
        .when((col == 0) & has_any(s, SECTION_WORDS), "section_title")
        .when(col == 0, "row_header")
        .otherwise("data")
    )


def position_label(row: Column, col: Column) -> Column:
    """Label from the position alone."""
    return F.when(row == 0, "column_header").when(col == 0, "row_header").otherwise("data")


def statement_label(text: Column, row: Column, col: Column) -> Column:
    """column_header / total_row / section_title / row_header / currency_unit / data."""
    s = F.lower(text)
    return (
        F.when(row == 0, "column_header")
        .when((col == 0) & s.contains("total"), "total_row")
        .when((col == 0) & s.rlike("assets|liabilities|equity"), "section_title")
        .when(col == 0, "row_header")
        .when(s.contains("rm") & s.contains("000"), "currency_unit")
        .otherwise("data")
    )


# Rule orders of the structural classifier; the presets differ in precedence and in
# how strict a few rules are.
STRUCTURE_PRESETS = {
    "text": ["section", "total", "note", "amount", "header_word", "row_header", "data"],
    "grid": ["total", "note_first", "long_section", "top_text", "side_text", "digits", "data"],
    "fixed": ["total", "note_second", "long_section", "top_text", "side_text", "digits", "data"],
    "boxes": ["total", "note", "section", "top_word", "row_header", "digits", "data"],
}


def structure_label(text: Column, row: Column, col: Column, preset: str = "text") -> Column:
    """empty / total / note_ref / section_header / column_header / row_header / numeric / data."""
    s = F.lower(strip(text))
    digit = text.rlike(r"\d")
    short_integer = text.rlike(r"^\d{1,2}$")
    upper = text.rlike(UPPER_ONLY) & ~digit
    # fixed values: the words and years inside the rules
    rules = {
        "section": (upper, "section_header"),
        "long_section": (upper & (F.length(text) > 3), "section_header"),
        "total": (s.contains("total"), "total"),
        "note": (short_integer, "note_ref"),
        "note_first": (short_integer & (col == 0), "note_ref"),
        "note_second": (short_integer & (col <= 1), "note_ref"),
        "amount": (
            digit & (text.contains(",") | F.regexp_replace(text, "[,.]", "").rlike(r"^\d+$")),
            "numeric",
        ),
        "header_word": (
            text.rlike("2022|2023|2024|2025") | s.rlike("group|company|note"), "column_header"
        ),
        "top_text": ((row < 3) & ~digit, "column_header"),
        "top_word": ((row < 3) & s.rlike("note|group|company|rm|000|total"), "column_header"),
        "side_text": ((col == 0) & ~digit, "row_header"),
        "row_header": (col == 0, "row_header"),
        "digits": (digit, "numeric"),
        "data": (F.lit(True), "data"),
    }
    blank = text if preset == "text" else strip(text)
    out = F.when(text.isNull() | blank.isin("", "-", "–", "—"), "empty")
    for name in STRUCTURE_PRESETS[preset]:
        condition, label = rules[name]
        out = out.when(condition, label)
    return out


# --- rows --------------------------------------------------------------------------------


def row_class(label: Column, has_value: Column, position: Column, n_rows: Column) -> Column:
    """Class of a row from its label, whether it holds numbers, and where it stands."""
    s = F.lower(strip(F.coalesce(label, F.lit(""))))
    no_label = label.isNull() | (label == "")
    late = position > n_rows * 0.7
    heading = has_any(s, SECTION_ROWS) | (label.rlike(UPPER_ONLY) & (F.length(label) < 30))
    return (
        F.when(no_label & ~has_value, "empty")
        .when(position < 2, "header")
        .when(has_any(s, TOTAL_ROWS), "total")
        .when(s.rlike(CASH_FLOW_ROWS) | has_any(s, SUBTOTAL_ROWS), "subtotal")
        .when(s.contains("total") & late, "total")
        .when(s.contains("total"), "subtotal")
        .when(no_label & (position > n_rows * 0.85), "subtotal")
        .when(no_label, "data")
        .when(~has_value & heading, "section_header")
        .otherwise("data")
    )


def table_rows(values: DataFrame) -> DataFrame:
    """One row per table row: label, has_value, has_amount (beyond the label column)."""
    known = F.col("value").isNotNull()
    return (
        with_chunk(values)
        .groupBy("table_id", "row_chunk", "row_idx")
        .agg(
            F.max(F.when(F.col("col_idx") == 0, F.col("text"))).alias("label"),
            F.max(known).alias("has_value"),
            F.max(known & (F.col("col_idx") > 0)).alias("has_amount"),
        )
    )


def classify_rows(
    values: DataFrame, implicit_subtotals: bool = True, keep: Callable[[DataFrame], DataFrame] = stored
) -> DataFrame:
    """table_id, row_chunk, row_idx, label, has_value, has_amount, n_rows, row_class.

    ``values`` holds table_id, row_idx, col_idx, text, value.  ``keep`` stores the rows,
    which are read twice.
    """
    rows = table_rows(values)
    sizes = rows.groupBy("table_id").agg((F.max("row_idx") + 1).alias("n_rows"))
    rows = attach(rows, sizes).withColumn(
        "row_class",
        row_class(F.col("label"), F.col("has_value"), F.col("row_idx"), F.col("n_rows")),
    )
    if not implicit_subtotals:
        return rows
    rows = keep(rows)
    hits = implicit_subtotal_rows(values, rows)
    return rows.join(
        hits.withColumn("_hit", F.lit(True)), ["table_id", "row_chunk", "row_idx"], "left"
    ).withColumn(
        "row_class",
        F.when(F.col("_hit"), "subtotal").otherwise(F.col("row_class")),
    ).drop("_hit")


BOUNDARIES = ("subtotal", "total", "section_header")


def implicit_subtotal_rows(values: DataFrame, rows: DataFrame) -> DataFrame:
    """Unlabelled data rows equal (within 1 %) to the data rows above them.

    A row found this way ends its section, so later rows of the section depend on
    earlier ones.  Each candidate carries running sums from the section start, which
    reduces the dependence to a fold over the candidates alone.  These stream in row
    order, so a section of any length needs memory for one row and its open sums.
    """
    blank = F.coalesce(strip(F.col("label")), F.lit("")) == ""
    candidate = (F.col("row_class") == "data") & blank
    # Only tables, then only sections, that hold a candidate need running sums.
    tables = rows.where(candidate).select("table_id").distinct()
    marked = running_sums(
        rows.join(tables, "table_id", "left_semi").withColumn("_cand", candidate),
        {"section": F.when(F.col("row_class").isin(*BOUNDARIES), 1).otherwise(0)},
    ).select("table_id", "row_chunk", "row_idx", "section", "_cand", "row_class")
    with_cands = marked.where("_cand").select("table_id", "section").distinct()
    data = marked.where(F.col("row_class") == "data").join(
        with_cands, ["table_id", "section"], "left_semi"
    )
    v = F.col("value")
    amounts = with_chunk(values).select("table_id", "row_chunk", "row_idx", "col_idx", "value")
    long = data.join(amounts, ["table_id", "row_chunk", "row_idx"]).drop("row_class")
    summed = running_sums(
        long,
        {"s": F.coalesce(v, F.lit(0.0)), "n": F.when(v.isNotNull(), 1).otherwise(0)},
        keys=("table_id", "section", "col_idx"),
    )
    cell = F.struct(F.col("col_idx").cast("int").alias("col_idx"), "value", "s", F.col("n").cast("long").alias("n"))
    cands = (
        summed.where("_cand")
        .groupBy("table_id", "section", "row_chunk", "row_idx")
        .agg(F.collect_list(cell).alias("cells"))
    )
    ordered = cands.repartition("table_id", "section").sortWithinPartitions(
        "table_id", "section", "row_idx"
    )
    kinds = {c: ordered.schema[c].dataType.simpleString() for c in ("table_id", "row_chunk", "row_idx")}
    return ordered.mapInPandas(_closing_rows, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def _closing_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates, section by section in row order, that equal what is above them since
    the section began or the last such row: two values or more in one column at least."""
    section, base = None, {}
    for batch in batches:
        keep = []
        for table, number, cells in zip(batch["table_id"], batch["section"], batch["cells"], strict=True):
            if (table, number) != section:
                section, base = (table, number), {}
            keep.append(any(_adds_up(c, *base.get(c["col_idx"], (0.0, 0))) for c in cells))
            if keep[-1]:
                base = {c["col_idx"]: (c["s"], c["n"]) for c in cells}
        yield batch.loc[keep, ["table_id", "row_chunk", "row_idx"]]


def _adds_up(cell: dict, before: float, counted: int) -> bool:
    value = cell["value"]
    if value is None or value == 0:
        return False
    total = cell["s"] - value - before
    return cell["n"] - 1 - counted >= 2 and abs(total - value) <= 0.01 * abs(value)


def keyword_rows(rows: DataFrame, keywords: Sequence[str] = tuple(TOTAL_WORDS)) -> DataFrame:
    """Rows whose label contains one of the keywords."""
    return rows.where(has_any(F.col("label"), keywords))


def first_rows(
    rows: DataFrame, roles: dict[str, Sequence[str]], prefer_longest: bool = False
) -> DataFrame:
    """table_id, role, row_idx: first row per role whose label contains a keyword.

    ``prefer_longest`` lets the longest keyword win over the earliest row, so that
    ``total assets`` beats ``intangible assets``.
    """
    s = F.lower(strip(F.col("label")))

    def longest(words: Sequence[str]) -> Column:
        return F.greatest(*[F.when(s.contains(k), len(k)).otherwise(0) for k in words], F.lit(0))

    hits = F.array(
        *[F.struct(F.lit(r).alias("role"), longest(k).alias("len")) for r, k in roles.items()]
    )
    found = (
        rows.where(F.col("label") != "")
        .select("table_id", "row_idx", F.inline(F.filter(hits, lambda h: h["len"] > 0)))
    )
    order = F.struct(F.negative("len"), F.col("row_idx")) if prefer_longest else F.col("row_idx")
    return found.groupBy("table_id", "role").agg(F.min_by("row_idx", order).alias("row_idx"))
