"""DuckDB twins of ``inputs``: named CTEs, stitched together by :func:`q`."""

from __future__ import annotations

import re


def amount(v: str) -> str:
    return f"CASE WHEN {v} < 0 THEN '(' || format('{{:,}}', abs({v})) || ')' ELSE format('{{:,}}', abs({v})) END"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "items": ((), """
  SELECT l.table_id, CAST(l.note + 2 AS INTEGER) AS row_idx, l.note, p_name AS label, v2, v3
  FROM (SELECT l_orderkey AS table_id, l_linenumber AS note, min(l_partkey) AS pk,
          CAST(sum(CAST(round(l_extendedprice) AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS v2,
          CAST(sum(CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS BIGINT) AS v3
        FROM lineitem GROUP BY ALL) l JOIN part ON l.pk = p_partkey"""),
    "tot": (("items",), """
  SELECT table_id, max(row_idx) AS m, CAST(sum(v2) AS BIGINT) AS s2, CAST(sum(v3) AS BIGINT) AS s3,
         table_id % 3 AS kind FROM items GROUP BY table_id"""),
    "fig": (("tot",), """
  SELECT *, CASE WHEN kind = 1 THEN s2 * 2 WHEN kind = 0 THEN s2 + 1000 + table_id % 50 ELSE s2 + 1500 + table_id % 50 END
           + CASE WHEN table_id % 7 = 0 THEN 99999 ELSE 0 END AS a2,
         CASE WHEN kind = 1 THEN s3 * 2 WHEN kind = 0 THEN s3 + 1000 + table_id % 50 ELSE s3 + 1500 + table_id % 50 END AS a3,
         CAST(floor(abs(s2) / 4) AS BIGINT) + 700 + CASE WHEN table_id % 11 = 0 THEN 5000 ELSE 0 END AS e2,
         CAST(floor(abs(s3) / 4) AS BIGINT) + 700 + CASE WHEN table_id % 11 = 0 THEN 5000 ELSE 0 END AS e3
  FROM tot"""),
    "statement_rows": (("items", "tot", "fig"), f"""
  SELECT table_id, row_idx, label, note, {amount('v2')} AS t2, {amount('v3')} AS t3 FROM (
    SELECT table_id, row_idx, label, CAST(note AS VARCHAR) AS note, v2, v3 FROM items
    UNION ALL SELECT table_id, m + 1, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'Subtotal' ELSE 'Goodwill' END, '', CASE WHEN kind = 2 THEN 500 ELSE s2 END, CASE WHEN kind = 2 THEN 500 ELSE s3 END FROM fig
    UNION ALL SELECT table_id, m + 2, CASE WHEN kind = 1 THEN 'Total current assets' ELSE 'Tax recoverable' END, '', CASE WHEN kind = 1 THEN s2 ELSE 1000 + table_id % 50 END, CASE WHEN kind = 1 THEN s3 ELSE 1000 + table_id % 50 END FROM fig
    UNION ALL SELECT table_id, m + 3, 'Total assets', '', a2, a3 FROM fig
    UNION ALL SELECT table_id, m + 4, 'Equity attributable to owners', '', CAST(floor(abs(s2) / 4) AS BIGINT), CAST(floor(abs(s3) / 4) AS BIGINT) FROM fig
    UNION ALL SELECT table_id, m + 5, 'Non-controlling interests', '', 700, 700 FROM fig
    UNION ALL SELECT table_id, m + 6, 'Total equity', '', e2, e3 FROM fig
    UNION ALL SELECT table_id, m + 7, 'Total liabilities', '', a2 - e2 + CASE WHEN table_id % 17 = 3 THEN 77777 ELSE 0 END, a3 - e3 + CASE WHEN table_id % 17 = 3 THEN 77777 ELSE 0 END FROM fig
    UNION ALL SELECT table_id, m + 8, 'Revenue', '', s2 * 2, s3 * 2 FROM fig
    UNION ALL SELECT table_id, m + 9, 'Operating expenses', '', s2, s3 FROM fig
    UNION ALL SELECT table_id, m + 10, 'Net profit', '', s2 + CASE WHEN table_id % 13 = 0 THEN 12345 ELSE 0 END, s3 FROM fig)
  UNION ALL SELECT o_orderkey, h.row_idx,
      CASE h.row_idx WHEN 1 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'In thousands' ELSE '' END WHEN 2 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'POSITION' ELSE 'ASSETS' END ELSE '' END,
      CASE WHEN h.row_idx = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Ref' ELSE 'Note' END ELSE '' END,
      CASE h.row_idx WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN CASE o_orderkey % 6 WHEN 1 THEN 'US$ million' WHEN 2 THEN '' ELSE 'RM''000' END ELSE '' END,
      CASE h.row_idx WHEN 0 THEN CAST(year(o_orderdate) - 1 AS VARCHAR) WHEN 1 THEN 'RM''000' ELSE '' END
  FROM orders, (VALUES (0), (1), (2)) h(row_idx)
  WHERE o_orderkey IN (SELECT table_id FROM tot)"""),
    "cells": (("statement_rows",), """
  SELECT table_id, row_idx, 0 AS col_idx, label AS text FROM statement_rows
  UNION ALL SELECT table_id, row_idx, 1, note FROM statement_rows
  UNION ALL SELECT table_id, row_idx, 2, t2 FROM statement_rows
  UNION ALL SELECT table_id, row_idx, 3, t3 FROM statement_rows"""),
    "labelled_cells": (("cells",), """
  SELECT *, CASE WHEN table_id % 10 = 0 AND row_idx % 4 = 3 AND col_idx = 0 THEN 'data'
      WHEN row_idx = 0 THEN 'column_header' WHEN text = 'RM''000' THEN 'currency_unit'
      WHEN col_idx = 0 AND regexp_matches(text, '(?i)total|assets|equity|revenue|expenses|profit') THEN 'section_title'
      WHEN col_idx = 0 AND text <> '' THEN 'row_header' ELSE 'data' END AS gt_label FROM cells"""),
    "struct_elements": (("items",), """
  SELECT table_id, 'rows' AS kind, idx, 0.0::DOUBLE AS x1, (idx * 30)::DOUBLE AS y1, 640.0::DOUBLE AS x2, (idx * 30 + 26)::DOUBLE AS y2,
         (0.9 - (idx % 5) * 0.1)::DOUBLE AS score
  FROM (SELECT table_id, unnest(range(0, max(row_idx) + 11))::INTEGER AS idx FROM items GROUP BY table_id)
  UNION ALL SELECT table_id, 'columns', idx, (idx * 160)::DOUBLE, 0.0, (idx * 160 + 140)::DOUBLE, (n_rows * 30)::DOUBLE, (0.95 - idx * 0.05)::DOUBLE
  FROM (SELECT table_id, max(row_idx) + 11 AS n_rows FROM items GROUP BY table_id), (SELECT unnest(range(0, 4))::INTEGER AS idx)"""),
    "ocr_boxes": (("cells",), """
  SELECT table_id, CAST(row_idx * 4 + col_idx AS INTEGER) AS box_id, text,
         (col_idx * 160 + sh + far)::DOUBLE AS x1, (row_idx * 30 + sh)::DOUBLE AS y1,
         (col_idx * 160 + 90 + sh + wide + far)::DOUBLE AS x2, (row_idx * 30 + 22 + sh)::DOUBLE AS y2,
         (0.9 - (row_idx % 7) * 0.05)::DOUBLE AS confidence
  FROM (SELECT *, table_id % 7 - 3 AS sh, CASE WHEN (row_idx * 4 + col_idx) % 29 = 0 AND col_idx = 3 THEN 400 ELSE 0 END AS far,
               CASE WHEN (row_idx * 4 + col_idx) % 11 = 0 THEN 60 ELSE 0 END AS wide FROM cells WHERE text <> '')"""),
    "cell_boxes": (("cells",), """
  SELECT table_id, CAST(row_idx * 4 + col_idx AS INTEGER) AS cell_id, row_idx, col_idx, text,
         (col_idx * 160)::DOUBLE AS x1, (row_idx * 30)::DOUBLE AS y1, (col_idx * 160 + 140)::DOUBLE AS x2, (row_idx * 30 + 26)::DOUBLE AS y2
  FROM cells WHERE text <> ''"""),
    "det_line": ((), """
  SELECT l_orderkey AS image_id, l_linenumber AS n, max(l_discount) AS disc, max(l_tax) AS tax, min(l_returnflag) AS flag
  FROM lineitem GROUP BY ALL"""),
    "gt_boxes": (("det_line",), """
  SELECT image_id, n AS idx, (n * 100)::DOUBLE AS x1, 0.0::DOUBLE AS y1, (n * 100 + 80)::DOUBLE AS x2, 40.0::DOUBLE AS y2 FROM det_line"""),
    "pred_boxes": (("det_line",), """
  SELECT image_id, n * 2 AS idx, n * 100 + round(disc * 300) AS x1, 2.0::DOUBLE AS y1, n * 100 + 80 + round(disc * 300) AS x2, 42.0::DOUBLE AS y2, 0.95 - disc AS score
  FROM det_line WHERE NOT (flag = 'N' AND n % 5 = 0)
  UNION ALL SELECT image_id, n * 2 + 1, n * 100 + 7, 0, n * 100 + 87, 40, 0.9 - tax
  FROM det_line WHERE NOT (flag = 'N' AND n % 5 = 0) AND tax > 0.05"""),
    "text_pairs": ((), """
  SELECT doc_id, source, line, gt, replace(replace(gt, 'e', 'c'), ' t', ' ') AS pred
  FROM (SELECT doc_id, source, unnest(range(0, len(parts)))::INTEGER AS line, unnest(parts) AS gt
        FROM (SELECT doc_id, source, regexp_split_to_array(text, '[.!?\\n]+') AS parts FROM documents))"""),
    "number_texts": ((), """
  SELECT o_orderkey AS id, o_totalprice AS gt, CASE o_orderkey % 24
    WHEN 0 THEN two WHEN 1 THEN '(' || whole || ')' WHEN 2 THEN '$' || whole WHEN 3 THEN '12.5%' WHEN 4 THEN '1.2m'
    WHEN 5 THEN '750k' WHEN 6 THEN '-' WHEN 7 THEN 'abc' WHEN 8 THEN 'USD -' || whole WHEN 9 THEN whole || '-'
    WHEN 10 THEN '(' || whole || ') RM''000' WHEN 11 THEN pl || ' million' WHEN 12 THEN '£ ' || two WHEN 13 THEN '2019'
    WHEN 14 THEN '-' || two WHEN 15 THEN 'Notes' WHEN 16 THEN 'S$' || whole WHEN 17 THEN 'RM''000' WHEN 18 THEN ' '
    WHEN 19 THEN 'A' || pl || ' 1MM' WHEN 20 THEN 'nil' WHEN 21 THEN '3.4 billion' WHEN 22 THEN '12 May 2020 final accounts' ELSE 'RM ' || pl END AS text
  FROM (SELECT *, format('{:,.0f}', o_totalprice) AS whole, format('{:,.2f}', o_totalprice) AS two, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS pl FROM orders)"""),
    "noisy_labels": ((), """
  SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN
    (['otal assets', 'Otal Liabilities', 'the ash flows', 'Net ncome (rofit)', 'Turnover', 'PBT', 'Total  Assets!', 'cash and equivalents cash',
      'Other operating income net', 'right-of-use assets', 'Oroup curent S''000', 'ET old Ther', '', 'Deferred tax assets', 'loans and financing advances'])[p_partkey % 15 + 1]
    ELSE p_name || ' ' || substring(p_type, 2) END AS text FROM part"""),
    "question_base": (("statement_rows",), """
  SELECT r.table_id, r.row_idx, CASE (r.table_id + r.row_idx) % 6 WHEN 0 THEN upper(r.label) WHEN 1 THEN r.label || ' (restated)'
      WHEN 2 THEN replace(r.label, 'a', 'aa') WHEN 3 THEN CASE WHEN r.table_id % 2 = 0 THEN 'no such row zzz' ELSE r.label END ELSE r.label END AS row_key,
      r.t2, r.t3, h.t2 AS y2, h.t3 AS y3
  FROM statement_rows r JOIN statement_rows h ON h.table_id = r.table_id AND h.row_idx = 0 WHERE r.row_idx > 2 AND r.label <> ''"""),
    "questions": (("question_base",), """
  SELECT table_id, row_idx * 4 + c AS question_id, row_key,
      CASE WHEN (table_id + row_idx) % 6 = 4 THEN substring(y, 3, 2) ELSE y END AS col_key, answer
  FROM (SELECT *, 2 AS c, y2 AS y, t2 AS answer FROM question_base UNION ALL SELECT *, 3, y3, t3 FROM question_base)"""),
    "answers": (("questions",), """
  SELECT table_id, question_id, model, reply, 20 + length(reply) AS tokens FROM (
    SELECT table_id, question_id, 'model_a' AS model, reply FROM rep
    UNION ALL SELECT table_id, question_id, 'model_b', CASE WHEN (table_id + question_id) % 5 = 0 THEN '0' ELSE reply END FROM rep)"""),
    "rep": (("questions",), """
  SELECT *, CASE WHEN table_id % 9 = 0 THEN '' WHEN (table_id + question_id) % 17 = 0 THEN 'ERROR: timeout'
      WHEN table_id % 4 = 0 THEN replace(answer, ',', ' ') ELSE answer END AS reply FROM questions"""),
    "markdown_pages": (("statement_rows",), """
  SELECT table_id, 0 AS part, string_agg('| ' || label || ' | ' || note || ' | ' || t2 || ' | ' || t3 || ' |' ||
      CASE WHEN row_idx = 0 THEN chr(10) || '|---|---|---|---|' ELSE '' END, chr(10) ORDER BY row_idx) AS markdown FROM statement_rows GROUP BY table_id"""),
    "html_tables": (("statement_rows",), """
  SELECT table_id, 0 AS part, '<table>' || string_agg('<tr><td>' || label || '</td><td>' || note || '</td><td>' || t2 || '</td><td>' || t3 || '</td></tr>', '' ORDER BY row_idx) || '</table>' AS html
  FROM statement_rows GROUP BY table_id"""),
}
CTES["answers"] = (("questions", "rep"), CTES["answers"][1])


def q(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the CTEs it names (and theirs) in front."""
    wanted: list[str] = []

    def need(n: str) -> None:
        if n in wanted:
            return
        for d in CTES[n][0]:
            need(d)
        wanted.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in wanted]
    # an extra that is read more than once is worked out once
    later = {n: " ".join([*list((extra or {}).values())[i + 1 :], body]) for i, n in enumerate(extra or {})}
    once = {n: len(re.findall(rf"\b{n}\b", text)) < 2 for n, text in later.items()}
    parts += [f"{n} AS {'' if once[n] else 'MATERIALIZED '}({s})" for n, s in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
