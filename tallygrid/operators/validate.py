"""Accounting rules over normalised tables.

All pass tests are ``|diff| <= tolerance * max(|reference|, 1)``.  Sections are running
counts of boundary rows, so a rule is one aggregate over (table, section, column);
the closing row of a section is picked up by the same aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.text import ratio
from tallygrid.operators.classify import (
    BOUNDARIES,
    TOTAL_WORDS,
    classify_rows,
    first_rows,
    has_any,
    table_rows,
)
from tallygrid.partitioning import (
    attach,
    extent,
    running_sums,
    with_chunk,
)
from tallygrid.storage import stored

#: How rows that are read several times are stored; those of dealt tables can stay dealt.
Keep = Callable[[DataFrame], DataFrame]

# --- fixed values: keywords of statement rows ------------------------------------------
ASSETS = ["total assets", "assets"]
LIABILITIES = ["total liabilities", "liabilities"]
EQUITY = ["total equity", "equity", "shareholders equity", "stockholders equity"]
REVENUE = ["revenue", "total revenue", "net revenue", "sales", "turnover"]
EXPENSES = ["total expenses", "operating expenses", "expenses"]
PROFIT = [
    "net income", "net profit", "profit", "net earnings", "net periodic benefit cost",
]


def within(diff: Column, reference: Column, tolerance: float) -> Column:
    return F.abs(diff) <= tolerance * F.greatest(F.abs(reference), F.lit(1.0))


def _check(
    rule: str, expected: Column, actual: Column, diff: Column, reference: Column,
    tolerance: float, failure: Column | str,
) -> Column:
    passed = within(diff, reference, tolerance)
    return F.struct(
        F.lit(rule).alias("rule"),
        passed.alias("passed"),
        expected.alias("expected"),
        actual.alias("actual"),
        diff.alias("diff"),
        F.lit(tolerance).alias("tolerance"),
        F.when(passed, "OK")
        .otherwise(F.lit(failure) if isinstance(failure, str) else failure)
        .alias("message"),
    )


def equity_balance(a: Column, liab: Column, eq: Column, tolerance: float = 0.01) -> Column:
    """Assets = liabilities + equity."""
    return _check(
        "equity_balance", liab + eq, a, a - (liab + eq), a, tolerance,
        "Assets != Liabilities + Equity",
    )


def profit_equation(rev: Column, exp: Column, profit: Column, tolerance: float = 0.01) -> Column:
    """Revenue - expenses = net profit."""
    return _check(
        "profit_equation", rev - exp, profit, rev - exp - profit, rev, tolerance,
        "Revenue - Expenses != Net Profit",
    )


def column_sum(total: Column, stated: Column, tolerance: float = 0.01) -> Column:
    """Sum of components against the stated total."""
    return _check(
        "column_sum", stated, total, total - stated, stated, tolerance,
        F.format_string("Sum(%.2f) != Total(%.2f)", total, stated),
    )


def cash_flow_balance(
    opening: Column, change: Column, closing: Column, tolerance: float = 0.01
) -> Column:
    """Opening + change = closing."""
    return _check(
        "cash_flow_balance", opening + change, closing, opening + change - closing, closing,
        tolerance, "Opening + Changes != Closing",
    )


def percentage_consistency(
    value: Column, base: Column, percentage: Column, tolerance: float = 0.02
) -> Column:
    """value / base = percentage within an absolute tolerance; tiny bases fail."""
    tiny = F.abs(base) < 0.001
    computed = F.when(~tiny, F.try_divide(value, base))
    diff = F.abs(computed - percentage)
    passed = ~tiny & (diff <= tolerance)
    percent = [F.format_string("%.2f%%", x * 100) for x in (computed, percentage)]
    return F.struct(
        F.lit("percentage_consistency").alias("rule"),
        passed.alias("passed"),
        F.when(~tiny, percentage).alias("expected"),
        computed.alias("actual"),
        diff.alias("diff"),
        F.when(~tiny, F.lit(tolerance)).alias("tolerance"),
        F.when(tiny, "Base value too small for percentage calculation")
        .when(passed, "OK")
        .otherwise(F.concat(F.lit("Computed "), percent[0], F.lit(" != Reported "), percent[1]))
        .alias("message"),
    )


# --- sums of sections ---------------------------------------------------------------------


def _sections(rows: DataFrame) -> DataFrame:
    """Rows with three counts of what precedes them: boundaries, totals, subtotals."""
    is_class = lambda *c: F.when(F.col("row_class").isin(*c), 1).otherwise(0)
    return running_sums(
        rows,
        {"section": is_class(*BOUNDARIES), "block": is_class("total"), "subs": is_class("subtotal")},
        inclusive=False,
    )


def _counted(values: DataFrame, rows: DataFrame | None, keep: Keep) -> DataFrame:
    """The rows given with their counts, or those of ``values``, stored with them."""
    return keep(_sections(classify_rows(values, keep=keep))) if rows is None else _sections(rows)


def _included(blank_rows: bool = True) -> Column:
    """Does a row count towards the subtotal that closes its section?"""
    blank = F.coalesce(F.col("label"), F.lit("")) == ""
    keep = (F.col("row_class") == "data") | (
        (F.col("row_class") == "header") & F.col("has_amount")
    )
    if blank_rows:
        keep = keep | (blank & F.col("has_amount"))
    return keep & ~F.col("row_class").isin(*BOUNDARIES)


def _amounts(values: DataFrame, rows: DataFrame) -> DataFrame:
    """Classified rows joined to their amounts beyond the label column."""
    amounts = with_chunk(values).where(F.col("col_idx") > 0)
    return amounts.select("table_id", "row_chunk", "row_idx", "col_idx", "value").join(
        rows, ["table_id", "row_chunk", "row_idx"]
    )


def _shown(label: Column, kind: str, row: Column) -> Column:
    return F.when(label != "", label).otherwise(
        F.concat(F.lit(f"{kind} (Row "), row.cast("string"), F.lit(")"))
    )


CHECK_COLUMNS = [
    "table_id", "rule", "row_type", "column", "total_row", "total_row_index", "expected",
    "actual", "diff", "tolerance", "passed", "message", "num_components", "subtotal_row",
    "subtotal_value", "additional_items", "first_component", "last_component",
]


def _pick(condition: Column, what: Column | str) -> Column:
    return F.max(F.when(condition, F.col(what) if isinstance(what, str) else what))


def column_sum_checks(
    values: DataFrame, rows: DataFrame | None = None, tolerance: float = 0.01,
    blank_rows: bool = True, keep: Keep = stored,
) -> DataFrame:
    """Subtotals, totals, totals with additions and grand totals, per column.

    ``first_component`` and ``last_component`` bound the rows that were added up; which
    rows of these they are, by label, is told by :func:`component_lists`.  How many
    subtotals stand above a total is counted over the table, whatever its columns hold.

    Both passes are aggregates over counted sections with map-side partial sums, so a
    section holding a large share of all rows is added up where its rows are read.
    """
    counted = _counted(values, rows, keep)
    long = _amounts(values, counted)
    v, cls, at = F.col("value"), F.col("row_class"), F.col("row_idx")
    keep = _included(blank_rows)

    def ends(which: Column, name: str) -> list[Column]:
        return [f(F.when(which, at)).alias(f"{name}_{n}") for f, n in ((F.min, "from"), (F.max, "to"))]

    sub = cls == "subtotal"
    subtotals = (
        long.groupBy("table_id", "section", "col_idx")
        .agg(
            F.sum(F.when(keep, v)).alias("total"),
            F.count(F.when(keep, v)).alias("num_components"),
            _pick(sub, v).alias("stated"),
            _pick(sub, "row_idx").alias("total_row_index"),
            _pick(sub, "label").alias("label"),
            *ends(keep, "keep"),
        )
        .where((F.col("num_components") > 0) & F.col("stated").isNotNull())
        .select(
            "table_id", F.lit("subtotal").alias("row_type"), F.col("col_idx").alias("column"),
            _shown(F.col("label"), "Subtotal", F.col("total_row_index")).alias("total_row"),
            "total_row_index", "num_components", "total", "stated",
            F.lit(None).cast("string").alias("subtotal_row"),
            F.lit(None).cast("double").alias("subtotal_value"),
            F.lit(None).cast("bigint").alias("additional_items"),
            F.col("keep_from").alias("first_component"), F.col("keep_to").alias("last_component"),
        )
    )

    data, extra, tot = cls == "data", cls.isin("data", "additional"), cls == "total"
    stretches = long.groupBy("table_id", "block", "subs", "col_idx").agg(
        F.sum(F.when(data, v)).alias("data_sum"),
        F.count(F.when(data, v)).alias("data_n"),
        F.sum(F.when(extra, v)).alias("extra_sum"),
        F.count(F.when(extra, v)).alias("extra_n"),
        F.sum(F.when(sub, v)).alias("sub_sum"),
        F.count(F.when(sub, v)).alias("sub_n"),
        *ends(data, "data"), *ends(extra, "extra"), *ends(sub & v.isNotNull(), "sub"),
        _pick(tot, v).alias("stated"),
        _pick(tot, "row_idx").alias("total_row_index"),
        _pick(tot, "label").alias("label"),
    )
    blocks = stretches.groupBy("table_id", "block", "col_idx").agg(
        F.sum("data_sum").alias("data_sum"),
        F.sum("data_n").alias("data_n"),
        F.max_by("extra_sum", "subs").alias("extra_sum"),
        F.max_by("extra_n", "subs").alias("extra_n"),
        F.sum("sub_sum").alias("sub_sum"),
        F.sum("sub_n").alias("sub_n"),
        *[f(f"{c}_{n}").alias(f"{c}_{n}") for c in ("data", "sub") for f, n in ((F.min, "from"), (F.max, "to"))],
        F.max_by("extra_to", "subs").alias("extra_to"),
        F.max("stated").alias("stated"),
        F.max("total_row_index").alias("total_row_index"),
        F.max("label").alias("label"),
    )
    above = counted.where(sub).groupBy("table_id", "block").agg(
        F.count(F.lit(1)).alias("sub_rows"), F.max("label").alias("sub_label"), F.max("row_idx").alias("sub_row")
    )
    none, single = F.col("sub_rows") == 0, F.col("sub_rows") == 1
    part = lambda n: F.when(none, F.col(f"data_{n}")).when(single, F.col("sub_row")).otherwise(F.col(f"sub_{n}"))
    totals = (
        blocks.where(F.col("stated").isNotNull())
        .join(above, ["table_id", "block"], "left").fillna(0, ["sub_rows"])
        .withColumn(
            "total",
            F.when(none, F.col("data_sum"))
            .when(single, F.col("sub_sum") + F.coalesce("extra_sum", F.lit(0.0)))
            .otherwise(F.col("sub_sum")),
        )
        .where(F.col("total").isNotNull())
        .select(
            "table_id",
            F.when(none, "total").when(single, "total_with_additions").otherwise("grand_total")
            .alias("row_type"),
            F.col("col_idx").alias("column"),
            _shown(F.col("label"), "Total", F.col("total_row_index")).alias("total_row"),
            "total_row_index",
            F.when(none, F.col("data_n")).when(single, 1 + F.col("extra_n"))
            .otherwise(F.col("sub_n")).alias("num_components"),
            "total",
            "stated",
            F.when(single, _shown(F.col("sub_label"), "Subtotal", F.col("sub_row")))
            .alias("subtotal_row"),
            F.when(single, F.col("sub_sum")).alias("subtotal_value"),
            F.when(single, F.col("extra_n")).alias("additional_items"),
            part("from").alias("first_component"),
            F.when(single, F.greatest("sub_row", "extra_to")).otherwise(part("to")).alias("last_component"),
        )
    )
    both = subtotals.unionByName(totals)
    return both.withColumn(
        "_c", column_sum(F.col("total"), F.col("stated"), tolerance)
    ).select("*", "_c.*").select(*CHECK_COLUMNS)


def component_lists(
    values: DataFrame, rows: DataFrame | None = None, blank_rows: bool = True, keep: Keep = stored
) -> DataFrame:
    """table_id, row_type, total_row_index, column, part, component_rows.

    The labels of the rows that a subtotal, a total without subtotals, or a grand total is
    made of, in row order; rows without a label are named by their number.  A grand total
    adds up the subtotals that its ``column`` holds; for the others all columns share one
    list and ``column`` is null.  ``part`` is the chunk of rows that a list covers, so that a
    section of any length is a sequence of bounded lists.
    """
    counted = _counted(values, rows, keep)
    cls = F.col("row_class")

    def listed(parts: DataFrame, keys: list[str], name: Column) -> DataFrame:
        item = F.struct("row_idx", F.when(F.col("label") != "", F.col("label")).otherwise(name).alias("label"))
        names = F.transform(F.array_sort(F.collect_list(item)), lambda r: r["label"])
        return parts.groupBy("table_id", *keys, F.col("row_chunk").alias("part")).agg(names.alias("component_rows"))

    def closing(kind: str, key: str) -> DataFrame:
        found = counted.where(cls == kind)
        return found.select("table_id", key, F.col("row_idx").cast("int").alias("total_row_index"))

    plain = F.format_string("Row %d", F.col("row_idx"))
    subtotals = listed(counted.where(_included(blank_rows)), ["section"], plain).join(
        closing("subtotal", "section"), ["table_id", "section"]
    )
    subs = counted.where(cls == "subtotal").groupBy("table_id", "block").agg(F.count(F.lit(1)).alias("n"))
    ends = closing("total", "block").join(subs, ["table_id", "block"], "left").fillna(0, ["n"])
    totals = listed(counted.where(cls == "data"), ["block"], plain).join(
        ends.where("n = 0"), ["table_id", "block"]
    )
    amounts = _amounts(values, counted.where(cls == "subtotal")).where(F.col("value").isNotNull())
    grand = listed(amounts, ["block", "col_idx"], F.format_string("Subtotal (Row %d)", F.col("row_idx"))).join(
        ends.where("n > 1"), ["table_id", "block"]
    )
    none = F.lit(None).cast("int")

    def shaped(df: DataFrame, kind: str, column: Column) -> DataFrame:
        return df.select(
            "table_id", F.lit(kind).alias("row_type"), "total_row_index", column.alias("column"), "part", "component_rows"
        )

    every = shaped(subtotals, "subtotal", none).unionByName(shaped(totals, "total", none))
    return every.unionByName(shaped(grand, "grand_total", F.col("col_idx").cast("int")))


def row_selection(values: DataFrame, rows: DataFrame | None = None, keep: Keep = stored) -> DataFrame:
    """Why each row of a subtotal's section was included or not (the debug trail)."""
    rows = _counted(values, rows, keep)
    closing = rows.where(F.col("row_class") == "subtotal").select(
        "table_id", "section", F.col("row_idx").alias("total_row_index")
    )
    blank = F.coalesce(F.col("label"), F.lit("")) == ""
    cls = F.col("row_class")
    # fixed values: the reasons
    reason = (
        F.when(cls == "data", "DATA row")
        .when((cls == "header") & F.col("has_amount"), "HEADER with numeric (reclassified as DATA)")
        .when(blank & F.col("has_amount"), "Empty label with numeric values")
        .otherwise(
            F.concat(
                F.lit("Excluded: class="), cls,
                F.when(blank, ", label=False").otherwise(", label=True"),
                F.when(F.col("has_amount"), ", numeric=True").otherwise(", numeric=False"),
            )
        )
    )
    return (
        rows.where(~cls.isin(*BOUNDARIES))
        .join(closing, ["table_id", "section"])
        .select(
            "table_id", "total_row_index", "row_idx",
            F.when(blank, "(empty)").otherwise(F.col("label")).alias("label"),
            "row_class", F.col("has_amount").alias("has_numeric"),
            _included().alias("included"), reason.alias("reason"),
        )
    )


def keyword_sum_checks(values: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Every row between two keyword totals must add up to the later one."""
    rows = table_rows(values).withColumn("is_total", has_any(F.col("label"), TOTAL_WORDS))
    rows = running_sums(
        rows, {"block": F.col("is_total").cast("int")}, inclusive=False,
    )
    v, tot = F.col("value"), F.col("is_total")
    sums = _amounts(values, rows).groupBy("table_id", "block", "col_idx").agg(
        F.sum(F.when(~tot, v)).alias("total"),
        F.count(F.when(~tot, v)).alias("num_components"),
        _pick(tot, v).alias("stated"),
        _pick(tot, "row_idx").alias("total_row_index"),
        _pick(tot, "label").alias("total_row"),
    )
    return (
        sums.where((F.col("num_components") > 0) & F.col("stated").isNotNull())
        .withColumn("_c", column_sum(F.col("total"), F.col("stated"), tolerance))
        .select(
            "table_id", F.col("col_idx").alias("column"), "total_row", "total_row_index",
            "num_components", "_c.*",
        )
    )


# --- statement equations -------------------------------------------------------------------


def _role_values(
    values: DataFrame, roles: DataFrame, names: list[str]
) -> DataFrame:
    """One row per (table, column) with the value of each role's row."""
    amounts = values.where(F.col("col_idx") > 0).select(
        "table_id", "row_idx", F.col("col_idx").alias("column"), "value"
    )
    return (
        amounts.join(roles, ["table_id", "row_idx"])
        .groupBy("table_id", "column")
        .agg(*[_pick(F.col("role") == n, "value").alias(n) for n in names])
    )


def balance_sheet_columns(
    values: DataFrame, tolerance: float = 0.01, prefer_longest: bool = False
) -> DataFrame:
    """Assets = liabilities + equity for every column of tables naming all three."""
    roles = first_rows(
        table_rows(values),
        {"assets": ASSETS, "liabilities": LIABILITIES, "equity": EQUITY},
        prefer_longest,
    )
    found = _role_values(values, roles, ["assets", "liabilities", "equity"]).dropna()
    check = equity_balance(F.col("assets"), F.col("liabilities"), F.col("equity"), tolerance)
    return found.withColumn("_c", check).select("table_id", "column", "_c.*")


def income_statement_columns(
    values: DataFrame, tolerance: float = 0.01, prefer_longest: bool = False
) -> DataFrame:
    """Revenue - expenses = profit for every column of tables naming all three."""
    roles = first_rows(
        table_rows(values),
        {"revenue": REVENUE, "expenses": EXPENSES, "profit": PROFIT},
        prefer_longest,
    )
    found = _role_values(values, roles, ["revenue", "expenses", "profit"]).dropna()
    check = profit_equation(F.col("revenue"), F.col("expenses"), F.col("profit"), tolerance)
    return found.withColumn("_c", check).select("table_id", "column", "_c.*")


def summarise_columns(columns: DataFrame, rule: str, failure: str) -> DataFrame:
    """One row per table from per-column results."""
    passed = F.bool_and("passed")
    return columns.groupBy("table_id").agg(
        F.lit(rule).alias("rule"),
        passed.alias("passed"),
        F.count(F.lit(1)).alias("num_components"),
        F.when(passed, "All columns pass").otherwise(failure).alias("message"),
    )


def balance_sheet(values: DataFrame, tolerance: float = 0.01, **options) -> DataFrame:
    return summarise_columns(
        balance_sheet_columns(values, tolerance, **options), "balance_sheet",
        "Some columns failed balance sheet check",
    )


def income_statement(values: DataFrame, tolerance: float = 0.01, **options) -> DataFrame:
    return summarise_columns(
        income_statement_columns(values, tolerance, **options), "income_statement",
        "Some columns failed income statement check",
    )


def validate_tables(values: DataFrame, tolerance: float = 0.01, keep: Keep = stored) -> DataFrame:
    """All rules; ``values`` needs a ``value`` column (see ``normalize``)."""
    return (
        column_sum_checks(values, tolerance=tolerance, keep=keep)
        .unionByName(balance_sheet(values, tolerance), allowMissingColumns=True)
        .unionByName(income_statement(values, tolerance), allowMissingColumns=True)
    )


def equity_split(values: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Total equity = attributable + non-controlling, with keyword fallbacks.

    When no label names total equity, the row with the largest absolute value stands
    in for it.
    """
    label = F.lower("label")
    has = lambda *w: _all(label.contains(x) for x in w)
    tiers = {
        "total": [has("total equity"), has("total", "equity")],
        "attributable": [has("equity holders"), has("attributable"), has("equity")],
        "non_controlling": [has("non-controlling"), has("interest")],
    }
    hits = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.lit(i).alias("tier"), cond.alias("hit"))
            for role, conds in tiers.items()
            for i, cond in enumerate(conds)
        ]
    )
    by_label = (
        table_rows(values)
        .where(F.col("label") != "")
        .select("table_id", "row_idx", F.inline(F.filter(hits, lambda h: h["hit"])))
        .select("table_id", "row_idx", "role", "tier")
    )
    size = F.abs("value")
    largest = (
        values.where((F.col("col_idx") > 0) & F.col("value").isNotNull())
        .groupBy("table_id")
        .agg(F.min_by("row_idx", F.struct(-size, F.col("row_idx"))).alias("row_idx"))
        .select("table_id", "row_idx", F.lit("total").alias("role"), F.lit(9).alias("tier"))
    )
    roles = (
        by_label.unionByName(largest)
        .groupBy("table_id", "role")
        .agg(F.min_by("row_idx", F.struct("tier", "row_idx")).alias("row_idx"))
    )
    found = _role_values(values, roles, list(tiers)).dropna()
    diff = F.col("total") - (F.col("attributable") + F.col("non_controlling"))
    return found.select(
        "table_id", "column", F.col("total").alias("total_equity"), "attributable",
        "non_controlling", diff.alias("diff"),
        within(diff, F.col("total"), tolerance).alias("passed"),
    )


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def pass_summary(checks: DataFrame, *keys: str) -> DataFrame:
    """total, passed, failed, pass_rate, all_passed; null verdict when nothing ran."""
    total, ok = F.count(F.lit(1)), F.count_if("passed")
    return checks.groupBy(*keys).agg(
        total.alias("total"),
        ok.alias("n_passed"),
        (total - ok).alias("failed"),
        ratio(ok, total).alias("pass_rate"),
        F.bool_and("passed").alias("all_passed"),
    )


# --- questions over normalised tables ----------------------------------------------------------


def year_comparison(values: DataFrame, metadata: DataFrame) -> DataFrame:
    """INCREASED / DECREASED / UNCHANGED between the two latest years of each row."""
    years = metadata.where(F.col("year").isNotNull()).select("table_id", "col_idx", "year")
    amounts = attach(
        with_chunk(values).where(F.col("value").isNotNull()), years, extent(values),
        on=("table_id", "col_idx"), how="inner",
    )
    latest = F.array_sort(
        F.collect_list(F.struct(F.negative("year").alias("y"), F.col("value").alias("v")))
    )
    per_row = amounts.groupBy("table_id", "row_chunk", "row_idx").agg(latest.alias("ys")).where(
        F.size("ys") >= 2
    )
    new, old = F.col("ys")[0], F.col("ys")[1]
    return per_row.select(
        "table_id", "row_idx", (-new["y"]).alias("year_new"), (-old["y"]).alias("year_old"),
        new["v"].alias("value_new"), old["v"].alias("value_old"),
        F.when(new["v"] > old["v"], "INCREASED").when(new["v"] < old["v"], "DECREASED")
        .otherwise("UNCHANGED").alias("change"),
    )


def printed_total(
    values: DataFrame, column: int, section: str | None = None, rows: DataFrame | None = None
) -> DataFrame:
    """The first total or subtotal printed in a column, NOT_FOUND where there is none."""
    rows = classify_rows(values) if rows is None else rows
    wanted = F.col("row_class").isin("total", "subtotal")
    if section:
        wanted = wanted & F.lower("label").contains(section.lower())
    cell = values.where(F.col("col_idx") == column).select("table_id", "row_idx", "text")
    found = (
        rows.where(wanted)
        .join(cell, ["table_id", "row_idx"])
        .where(F.col("text") != "")
        .groupBy("table_id")
        .agg(F.min_by("text", "row_idx").alias("total"))
    )
    tables = values.select("table_id").distinct()
    return tables.join(found, "table_id", "left").select(
        "table_id", F.coalesce("total", F.lit("NOT_FOUND")).alias("total")
    )
