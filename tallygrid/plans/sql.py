"""SQL snippets for the DuckDB twins of the column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from tallygrid.functions import numeric as N
from tallygrid.functions import text as T
from tallygrid.operators import classify as C
from tallygrid.operators import validate as V


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def number(x: str) -> str:
    return f"CASE WHEN {matches(x, N._FLOAT)} THEN TRY_CAST({x} AS DOUBLE) END"


def case(pairs: Sequence[tuple[str, str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def contains_any(x: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {lit(w)})" for w in words) + ")"


def cell_type(t: str, compat: bool = False) -> str:
    s = strip(t)
    counted = s if compat else sub(s, N.UNIT_TOKENS)
    left = f"length({sub(counted, r"[0-9,.\-+()%$£€¥\s]")})"
    digit = matches(s, r"\d")
    return case(
        [
            (f"{t} IS NULL OR {s} = ''", "'empty'"),
            (matches(s, N.YEAR), "'year'"),
            (matches(s, N.NOTE), "'note'"),
            (
                f"{matches(s, N.UNIT_HEADER)} AND NOT {matches(sub(s, chr(39) + '?000'), chr(92) + 'd')}",
                "'unit_header'",
            ),
            (f"{digit} AND {left} <= 2", "'numeric'"),
            (f"NOT {digit} AND length({s}) < 20", "'header'"),
        ],
        "'text'",
    )


def currency(t: str, compat: bool = False) -> str:
    first = [] if compat else [(matches(f"lower({t})", r"us\$"), "'USD'")]
    return case(
        first + [(matches(f"lower({t})", p), lit(c)) for c, p in N.CURRENCY_PATTERNS.items()]
    )


def unit(t: str, compat: bool = False) -> str:
    s = f"lower({t})"
    pairs = [(f"contains({s}, '''000')", "'''000'")]
    for w in N.UNIT_SCALES:
        if w != "'000" and (w != "000" or compat):
            pairs.append((matches(s, rf"\b{w}\b"), lit(w)))
    suffix = f"regexp_extract({s}, {lit(N.SUFFIX if compat else N.SUFFIX_STRICT)}, 1)"
    return case(pairs, f"nullif({suffix}, '')")


def unit_scale(u: str) -> str:
    return case([(f"{u} = {lit(w)}", f"{v}::BIGINT") for w, v in N.UNIT_SCALES.items()], "1::BIGINT")


def first_number(t: str) -> str:
    cleaned = sub(t, "[,']")
    return f"TRY_CAST(regexp_extract({cleaned}, {lit(r'[-+]?[0-9]+(?:[.][0-9]+)?')}) AS DOUBLE)"


def inner(t: str) -> str:
    s = strip(t)
    return f"CASE WHEN contains({s}, '(') AND contains({s}, ')') THEN {sub(s, '[()]')} ELSE {s} END"


def unsigned(t: str) -> str:
    return sub(sub(inner(t), r"^[-+]"), "-$")


def negative(t: str) -> str:
    s = strip(t)
    return (
        f"((contains({s}, '(') AND contains({s}, ')')) OR starts_with({inner(t)}, '-') "
        f"OR ends_with({sub(inner(t), '^[-+]')}, '-'))"
    )


def normalized_columns(t: str, kind: str, dc: str, ds: str, src: str, compat: bool = False) -> str:
    """SELECT over ``src`` adding the seven normalised columns (src has its own columns)."""
    return f"""
SELECT * EXCLUDE (_s, _own, _dc, _ds), CASE WHEN value IS NULL THEN NULL ELSE
    CASE WHEN currency IS NULL THEN '' ELSE currency || ' ' END ||
    CASE WHEN value = floor(value) THEN format('{{:,.0f}}', value) ELSE format('{{:,.2f}}', value) END END AS normalized
FROM (SELECT *, CASE WHEN is_negative THEN -(n) ELSE n END AS value FROM (
  SELECT *, CASE WHEN cell_type = 'numeric' THEN {first_number('_s')} * scale END AS n FROM (
    SELECT *, CASE WHEN _own > 1 THEN _own ELSE _ds END AS scale,
           coalesce(CASE WHEN cell_type = 'numeric' THEN {currency('_s', compat)} END, _dc) AS currency,
           CASE WHEN cell_type = 'numeric' THEN {negative(t)} ELSE false END AS is_negative
    FROM (SELECT *, CASE WHEN cell_type = 'numeric' THEN {unit_scale('unit')} END AS _own FROM (
      SELECT *, CASE WHEN cell_type = 'numeric' THEN {unit('_s', compat)} END AS unit FROM (
        SELECT *, CASE WHEN cell_type = 'numeric' THEN {unsigned(t)} END AS _s
        FROM (SELECT *, {kind} AS cell_type, {dc} AS _dc, {ds} AS _ds FROM {src})))))))"""


METADATA = f"""
  SELECT c.table_id, col_idx, coalesce(oc, CASE WHEN fills THEN tc END) AS currency,
         coalesce(os, CASE WHEN fills THEN ts END, 1)::BIGINT AS scale, unit, column_type, year
  FROM (SELECT *, column_type NOT IN ('label', 'note') AS fills FROM (
    SELECT table_id, col_idx,
      max_by(cur, row_idx) FILTER (kind = 'unit_header' AND cur IS NOT NULL) AS oc,
      max_by(sc, row_idx) FILTER (kind = 'unit_header' AND sc > 1) AS os,
      max_by(un, row_idx) FILTER (kind = 'unit_header' AND sc > 1) AS unit,
      CASE WHEN col_idx = 0 THEN 'label' ELSE coalesce(max_by(kind, row_idx) FILTER (kind IN ('year', 'note')), 'unknown') END AS column_type,
      max_by(TRY_CAST(trim(text) AS INTEGER), row_idx) FILTER (kind = 'year') AS year
    FROM (SELECT *, {unit_scale('un')} AS sc FROM (SELECT *, {cell_type('text')} AS kind, {currency('text')} AS cur, {unit('text')} AS un FROM cells WHERE row_idx < 3))
    GROUP BY table_id, col_idx)) c
  JOIN (SELECT table_id, max_by(oc, col_idx) FILTER (oc IS NOT NULL) AS tc, max_by(os, col_idx) FILTER (os IS NOT NULL) AS ts FROM (
    SELECT table_id, col_idx, max_by(cur, row_idx) FILTER (cur IS NOT NULL) AS oc, max_by(sc, row_idx) FILTER (sc > 1) AS os
    FROM (SELECT *, {unit_scale('un')} AS sc FROM (SELECT *, {currency('text')} AS cur, {unit('text')} AS un FROM cells WHERE row_idx < 3 AND {cell_type('text')} = 'unit_header'))
    GROUP BY table_id, col_idx) GROUP BY table_id) t ON t.table_id = c.table_id"""

KIND = f"CASE WHEN row_idx < 3 AND ({cell_type('text')}) = 'numeric' THEN 'header' ELSE {cell_type('text')} END"
NORM = (
    "SELECT table_id, row_idx, col_idx, text, value, currency, unit, scale, is_negative, normalized, cell_type FROM ("
    + normalized_columns(
        "text", KIND, "mc", "ms",
        "(SELECT c.*, m.currency AS mc, coalesce(m.scale, 1) AS ms FROM cells c LEFT JOIN meta m USING (table_id, col_idx))",
    )
    + ")"
)

_late = "row_idx > n_rows * 0.7"
_no_label = "coalesce(label, '') = ''"
ROW_CLASS = case(
    [
        (f"{_no_label} AND NOT has_value", "'empty'"),
        ("row_idx < 2", "'header'"),
        (contains_any("label", C.TOTAL_ROWS), "'total'"),
        (f"{matches('lower(label)', C.CASH_FLOW_ROWS)} OR {contains_any('label', C.SUBTOTAL_ROWS)}", "'subtotal'"),
        (f"contains(lower(label), 'total') AND {_late}", "'total'"),
        ("contains(lower(label), 'total')", "'subtotal'"),
        (f"{_no_label} AND row_idx > n_rows * 0.85", "'subtotal'"),
        (_no_label, "'data'"),
        (
            f"NOT has_value AND ({contains_any('label', C.SECTION_ROWS)} OR "
            f"({matches('label', C.UPPER_ONLY)} AND length(label) < 30))",
            "'section_header'",
        ),
    ],
    "'data'",
)
BASE_ROWS = f"""
  SELECT *, {ROW_CLASS} AS base_class FROM (
    SELECT table_id, row_idx, max(CASE WHEN col_idx = 0 THEN text END) AS label, bool_or(value IS NOT NULL) AS has_value,
           bool_or(value IS NOT NULL AND col_idx > 0) AS has_amount, max(max(row_idx) + 1) OVER (PARTITION BY table_id) AS n_rows
    FROM norm GROUP BY table_id, row_idx)"""
# The derived tables have at most one unlabelled row per section, so a single look at
# the running sums decides it; the general fold is tested against brute force instead.
IMPLICIT = """
  SELECT DISTINCT table_id, row_idx FROM (
    SELECT r.*, n.col_idx, n.value,
      coalesce(sum(CASE WHEN base_class = 'data' THEN n.value END) OVER w, 0) AS above,
      count(CASE WHEN base_class = 'data' THEN n.value END) OVER w AS cnt
    FROM (SELECT *, sum(CASE WHEN base_class IN ('subtotal', 'total', 'section_header') THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row_idx) AS seg FROM base_rows) r
    JOIN norm n USING (table_id, row_idx)
    WINDOW w AS (PARTITION BY r.table_id, seg, n.col_idx ORDER BY r.row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE base_class = 'data' AND trim(coalesce(label, '')) = '' AND cnt >= 2 AND abs(value) > 0 AND abs(above - value) <= 0.01 * abs(value)"""
ROWS = """
  SELECT b.table_id, b.row_idx, label, has_value, has_amount, n_rows, CASE WHEN i.row_idx IS NOT NULL THEN 'subtotal' ELSE base_class END AS row_class
  FROM base_rows b LEFT JOIN implicit i ON i.table_id = b.table_id AND i.row_idx = b.row_idx"""

STEPS = {
    "meta": METADATA, "norm": NORM, "base_rows": BASE_ROWS, "implicit": IMPLICIT, "class_rows": ROWS,
}


def steps(upto: str, **more: str) -> dict[str, str]:
    """The chain of CTEs up to a step, plus any given."""
    out = {}
    for k, v in STEPS.items():
        out[k] = v
        if k == upto:
            break
    return {**out, **more}


SECTIONED = """
  SELECT *, sum(CASE WHEN row_class IN ('subtotal', 'total', 'section_header') THEN 1 ELSE 0 END) OVER p AS section,
     sum(CASE WHEN row_class = 'total' THEN 1 ELSE 0 END) OVER p AS block, sum(CASE WHEN row_class = 'subtotal' THEN 1 ELSE 0 END) OVER p AS subs
  FROM class_rows WINDOW p AS (PARTITION BY table_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
SECTIONED = SECTIONED.replace("sum(CASE", "coalesce(sum(CASE").replace(") OVER p", ") OVER p, 0)")


def check_cols(total: str, stated: str, tol: float = 0.01) -> str:
    ok = f"abs({total} - {stated}) <= {tol} * greatest(abs({stated}), 1.0)"
    return (
        f"'column_sum' AS rule, {ok} AS passed, {stated} AS expected, {total} AS actual, {total} - {stated} AS diff, {tol}::DOUBLE AS tolerance, "
        f"CASE WHEN {ok} THEN 'OK' ELSE 'Sum(' || format('{{:.2f}}', {total}) || ') != Total(' || format('{{:.2f}}', {stated}) || ')' END AS message"
    )


# Totals are easier to state as joins of the total row with the rows of its block.
TOTALS = """
  SELECT t.table_id, t.row_idx, t.col_idx, any_value(t.label) AS label, any_value(t.value) AS stated,
    count(DISTINCT x.row_idx) FILTER (x.row_class = 'subtotal') AS n_sub,
    sum(x.value) FILTER (x.row_class = 'data') AS ds, count(x.value) FILTER (x.row_class = 'data') AS dn,
    sum(x.value) FILTER (x.row_class = 'data' AND x.subs = t.subs) AS es, count(x.value) FILTER (x.row_class = 'data' AND x.subs = t.subs) AS en,
    sum(x.value) FILTER (x.row_class = 'subtotal') AS ss, count(x.value) FILTER (x.row_class = 'subtotal') AS sn,
    max(x.label) FILTER (x.row_class = 'subtotal') AS sl, max(x.row_idx) FILTER (x.row_class = 'subtotal') AS sr,
    min(x.row_idx) FILTER (x.row_class = 'data') AS d1, max(x.row_idx) FILTER (x.row_class = 'data') AS d2,
    max(x.row_idx) FILTER (x.row_class IN ('data', 'additional') AND x.subs = t.subs) AS e2,
    min(x.row_idx) FILTER (x.row_class = 'subtotal' AND x.value IS NOT NULL) AS s1, max(x.row_idx) FILTER (x.row_class = 'subtotal' AND x.value IS NOT NULL) AS s2
  FROM long t JOIN long x ON x.table_id = t.table_id AND x.block = t.block AND x.col_idx = t.col_idx
  WHERE t.row_class = 'total' AND t.value IS NOT NULL GROUP BY t.table_id, t.row_idx, t.col_idx"""
SUBTOTALS = """
  SELECT t.table_id, t.row_idx, t.col_idx, any_value(t.label) AS label, any_value(t.value) AS stated,
    sum(x.value) AS total, count(x.value) AS num, min(x.row_idx) AS k1, max(x.row_idx) AS k2
  FROM long t JOIN long x ON x.table_id = t.table_id AND x.section = t.section AND x.col_idx = t.col_idx AND x.keep
  WHERE t.row_class = 'subtotal' AND t.value IS NOT NULL GROUP BY t.table_id, t.row_idx, t.col_idx HAVING count(x.value) > 0"""
CHECKS = f"""
  SELECT table_id, row_type, col AS "column", total_row, CAST(total_row_index AS INTEGER) AS total_row_index, CAST(num AS BIGINT) AS num_components,
         subtotal_row, subtotal_value, CAST(additional_items AS BIGINT) AS additional_items, k1::INTEGER AS first_component, k2::INTEGER AS last_component, {check_cols('total', 'stated')}
  FROM (
    SELECT table_id, 'subtotal' AS row_type, col_idx AS col, CASE WHEN label <> '' THEN label ELSE 'Subtotal (Row ' || row_idx || ')' END AS total_row,
      row_idx AS total_row_index, num, NULL::VARCHAR AS subtotal_row, NULL::DOUBLE AS subtotal_value, NULL::BIGINT AS additional_items, total, stated, k1, k2 FROM subtotals
    UNION ALL
    SELECT table_id, CASE n_sub WHEN 0 THEN 'total' WHEN 1 THEN 'total_with_additions' ELSE 'grand_total' END, col_idx,
      CASE WHEN label <> '' THEN label ELSE 'Total (Row ' || row_idx || ')' END, row_idx,
      CASE n_sub WHEN 0 THEN dn WHEN 1 THEN 1 + en ELSE sn END,
      CASE n_sub WHEN 1 THEN CASE WHEN sl <> '' THEN sl ELSE 'Subtotal (Row ' || sr || ')' END END,
      CASE n_sub WHEN 1 THEN ss END, CASE n_sub WHEN 1 THEN en END,
      CASE n_sub WHEN 0 THEN ds WHEN 1 THEN ss + coalesce(es, 0) ELSE ss END, stated,
      CASE n_sub WHEN 0 THEN d1 WHEN 1 THEN sr ELSE s1 END, CASE n_sub WHEN 0 THEN d2 WHEN 1 THEN greatest(sr, e2) ELSE s2 END FROM totals)
  WHERE total IS NOT NULL"""
LONG = """
  SELECT s.*, n.col_idx, n.value,
    (row_class = 'data' OR (row_class = 'header' AND has_amount) OR (coalesce(label, '') = '' AND has_amount)) AND row_class NOT IN ('subtotal', 'total', 'section_header') AS keep
  FROM sectioned s JOIN norm n ON n.table_id = s.table_id AND n.row_idx = s.row_idx WHERE n.col_idx > 0"""


def check_steps(**more: str) -> dict[str, str]:
    return steps(
        "class_rows", sectioned=SECTIONED, long=LONG, totals=TOTALS, subtotals=SUBTOTALS,
        checks=CHECKS, **more,
    )


def role_columns(roles: dict[str, Sequence[str]]) -> str:
    """One row per (table, column) with each role's value (first matching row)."""
    firsts = ", ".join(
        f"min(row_idx) FILTER ({contains_any('label', k)}) AS r_{r}" for r, k in roles.items()
    )
    vals = ", ".join(f"max(value) FILTER (row_idx = r_{r}) AS {r}" for r in roles)
    known = " AND ".join(f"{r} IS NOT NULL" for r in roles)
    return f"""SELECT * FROM (SELECT table_id, col_idx AS "column", {vals} FROM norm JOIN
      (SELECT table_id, {firsts} FROM base_rows WHERE label <> '' GROUP BY table_id) USING (table_id)
      WHERE col_idx > 0 GROUP BY ALL) WHERE {known}"""


BALANCE = f"""
  SELECT table_id, "column", 'equity_balance' AS rule, ok AS passed, liabilities + equity AS expected, assets AS actual, assets - (liabilities + equity) AS diff,
     0.01::DOUBLE AS tolerance, CASE WHEN ok THEN 'OK' ELSE 'Assets != Liabilities + Equity' END AS message
  FROM (SELECT *, abs(assets - (liabilities + equity)) <= 0.01 * greatest(abs(assets), 1) AS ok FROM
    ({role_columns({'assets': V.ASSETS, 'liabilities': V.LIABILITIES, 'equity': V.EQUITY})}))"""
INCOME = f"""
  SELECT table_id, "column", 'profit_equation' AS rule, ok AS passed, revenue - expenses AS expected, profit AS actual, revenue - expenses - profit AS diff,
     0.01::DOUBLE AS tolerance, CASE WHEN ok THEN 'OK' ELSE 'Revenue - Expenses != Net Profit' END AS message
  FROM (SELECT *, abs(revenue - expenses - profit) <= 0.01 * greatest(abs(revenue), 1) AS ok FROM
    ({role_columns({'revenue': V.REVENUE, 'expenses': V.EXPENSES, 'profit': V.PROFIT})}))"""

TERMS = "[" + ", ".join(lit(t) for t in sorted(T.FINANCIAL_TERMS)) + "]"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, '\\s+'), lambda w: w <> '')"


def mapping(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in d.items()) + "}"


def correct_ocr(t: str) -> str:
    m = mapping(T.OCR_FIXES)
    up = "regexp_matches({0}, '^[A-Z]')"
    whole = f"{m}[lower({strip(t)})]"
    fix = f"{m}[lower({sub('w', '[^a-zA-Z]')})]"
    word = (
        f"list_transform({words(t)}, lambda w: coalesce(CASE WHEN {up.format('w')} THEN "
        f"upper(substring({fix}, 1, 1)) || lower(substring({fix}, 2)) ELSE lower({fix}) END, w))"
    )
    return (
        f"CASE WHEN {t} = '' THEN {t} WHEN {whole} IS NOT NULL THEN CASE WHEN {up.format(t)} THEN "
        f"upper(substring({whole}, 1, 1)) || substring({whole}, 2) ELSE lower({whole}) END "
        f"ELSE array_to_string({word}, ' ') END"
    )


def jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def chars(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ''), lambda c: c <> ''))"


def iou(a: str, b: str) -> str:
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    inter = f"CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0 END"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter})"
    return f"(CASE WHEN {inter} > 0 AND {union} > 0 THEN ({inter}) / {union} ELSE 0 END)"


def share_inside(a: str, b: str) -> str:
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)) ELSE 0 END)"
