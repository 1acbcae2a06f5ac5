"""Queries over boxes: structure, alignment, grids and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import geometry as G
from tallygrid.operators import align as A
from tallygrid.operators import boxes as B
from tallygrid.operators import matching as M
from tallygrid.storage import stored
from tallygrid.plans import inputs as I
from tallygrid.plans import sql as S
from tallygrid.plans.inputs_sql import q
from tallygrid.plans.registry import query


def _stored(*frames):
    return [stored(f) for f in frames]


def _heights(spark, sf):
    """What rows of boxes are told from, stored dealt by table: no box is dealt again."""
    return I.keeper(spark, sf)(I.ocr_boxes(spark, sf).select("table_id", "box_id", "y1", "y2"))


# --- geometry ------------------------------------------------------------------------------


@query(
    q(
        "pred_boxes gt_boxes",
        f"""SELECT p.image_id, p.idx AS p, g.idx AS g, round({S.iou('p', 'g')}, 6) AS iou, round({S.share_inside('p', 'g')}, 6) AS inside,
      round(CASE WHEN least(p.x2, g.x2) > greatest(p.x1, g.x1) THEN (least(p.x2, g.x2) - greatest(p.x1, g.x1)) / (p.x2 - p.x1) ELSE 0 END, 6) AS x_overlap
      FROM pred_boxes p JOIN gt_boxes g ON p.image_id = g.image_id AND g.idx = p.idx // 2""",
    )
)
def box_overlaps(spark, sf):
    pred, gt = I.detections(spark, sf)
    right = gt.select(
        "image_id", F.col("idx").alias("g"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")]
    )
    a, b = G.box(), G.box("b_")
    return pred.withColumn("g", F.floor(F.col("idx") / 2)).join(right, ["image_id", "g"]).select(
        "image_id", F.col("idx").alias("p"), "g", F.round(G.iou(a, b), 6).alias("iou"),
        F.round(G.containment(a, b), 6).alias("inside"), F.round(G.overlap(a, b, "x"), 6).alias("x_overlap"),
    )


@query(
    q(
        "gt_boxes",
        """SELECT image_id, idx, x1 - w / 2 AS cx1, y1 + h / 2 AS cy2, x1 + w AS xy2, least(500, x1 + 80) AS fixed_x2, greatest(0, least(x1, x2)) AS fixed_x1
    FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM gt_boxes)""",
    )
)
def converted_boxes(spark, sf):
    _, gt = I.detections(spark, sf)
    x, y = F.col("x1"), F.col("y1")
    w, h = F.col("x2") - x, F.col("y2") - y
    c, z = G.from_centre(x, y, w, h), G.from_xywh(x, y, w, h)
    swapped = G.repaired((F.col("x2"), y, x, F.col("y2")), F.lit(500.0), F.lit(500.0))
    return gt.select(
        "image_id", "idx", c[0].alias("cx1"), c[3].alias("cy2"), z[2].alias("xy2"),
        swapped[2].alias("fixed_x2"), swapped[0].alias("fixed_x1"),
    )


def _images(spark, sf):
    return I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.lit(700).alias("width"), F.lit(100).alias("height")
    )


@query(
    q(
        "pred_boxes",
        """SELECT o_orderkey AS image_id, coalesce(greatest(0, b.x1::INT - 10), 0) AS x1, coalesce(greatest(0, b.y1::INT - 10), 0) AS y1,
      coalesce(least(700, b.x2::INT + 10), 700) AS x2, coalesce(least(100, b.y2::INT + 10), 100) AS y2, b.image_id IS NOT NULL AS detected
      FROM orders LEFT JOIN (SELECT * FROM pred_boxes QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, idx) = 1) b ON b.image_id = o_orderkey""",
    )
)
def best_detections(spark, sf):
    return B.best_detection(_images(spark, sf), I.detections(spark, sf)[0])


@query(
    q(
        "pred_boxes",
        """SELECT image_id, idx, greatest(0, x1::INT - 10) AS x1, greatest(0, y1::INT - 10) AS y1, least(700, x2::INT + 10) AS x2, least(100, y2::INT + 10) AS y2, round(score, 6) AS score
      FROM pred_boxes JOIN orders ON o_orderkey = image_id WHERE score > 0.9""",
    )
)
def confident_crops(spark, sf):
    pred, _ = I.detections(spark, sf)
    return B.all_crops(_images(spark, sf), B.above(pred, 0.9)).withColumn("score", F.round("score", 6))


@query(
    q(
        "struct_elements",
        """SELECT table_id, kind, idx, CAST(row_number() OVER (PARTITION BY table_id, kind ORDER BY CASE WHEN kind = 'columns' THEN x1 ELSE y1 END, idx) - 1 AS INTEGER) AS position FROM struct_elements WHERE score > 0.6""",
    )
)
def structure_positions(spark, sf):
    return B.index_structure(B.above(I.struct_elements(spark, sf), 0.6)).select(
        "table_id", "kind", "idx", "position"
    )


@query(
    q(
        "struct_elements",
        """SELECT r.table_id, r.idx AS row_idx, c.idx AS col_idx, greatest(r.x1, c.x1) AS x1, greatest(r.y1, c.y1) AS y1, least(r.x2, c.x2) AS x2, least(r.y2, c.y2) AS y2,
      r.idx = 0 OR c.idx = 0 AS is_header, round((r.score + c.score) / 2, 6) AS confidence
      FROM struct_elements r JOIN struct_elements c ON c.table_id = r.table_id AND c.kind = 'columns' WHERE r.kind = 'rows'""",
    )
)
def grid_cell_boxes(spark, sf):
    return B.grid_boxes(I.struct_elements(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(
    q(
        "statement_rows",
        """SELECT table_id, 0 AS part, '<table>' || string_agg(CASE WHEN row_idx = 0 THEN '<thead><tr><th>' || label || '</th><th>' || note || '</th><th>' || t2 || '</th><th>' || t3 || '</th></tr></thead><tbody>'
      ELSE '<tr><td>' || label || '</td><td>' || note || '</td><td>' || t2 || '</td><td>' || t3 || '</td></tr>' END, '' ORDER BY row_idx) || '</tbody></table>' AS html FROM statement_rows GROUP BY table_id""",
    )
)
def grid_html(spark, sf):
    return B.cells_to_html(I.cells(spark, sf))


@query(
    q(
        "cells",
        """SELECT table_id, max(text) FILTER (row_idx = 0 AND col_idx = 2) AS header_2, count(*) FILTER (row_idx = 0) AS n_headers, count(*) FILTER (col_idx = 0 AND text <> '') AS n_labels FROM cells GROUP BY table_id""",
    )
)
def headers_and_labels(spark, sf):
    cells = I.cells(spark, sf)
    h = B.headers(cells).groupBy("table_id").agg(
        F.max(F.when(F.col("col_idx") == 2, F.col("header"))).alias("header_2"),
        F.count(F.lit(1)).alias("n_headers"),
    )
    lab = B.labels(cells).groupBy("table_id").agg(F.count_if(F.col("label") != "").alias("n_labels"))
    return h.join(lab, "table_id")


@query(
    q(
        "struct_elements ocr_boxes",
        "SELECT kind, count(*) AS n, round(avg(score), 6) AS mean_score FROM struct_elements GROUP BY kind UNION ALL SELECT 'ocr', count(*), round(avg(confidence), 6) FROM ocr_boxes",
    )
)
def element_statistics(spark, sf):
    stats = lambda df, k, s: df.groupBy(k.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("mean_score")
    )
    return stats(I.struct_elements(spark, sf), F.col("kind"), "score").unionByName(
        stats(I.ocr_boxes(spark, sf), F.lit("ocr"), "confidence")
    )


# --- alignment --------------------------------------------------------------------------------

_SLICE_Y = "(CASE WHEN least(b.y2, r.y2) > greatest(b.y1, r.y1) THEN (least(b.y2, r.y2) - greatest(b.y1, r.y1)) ELSE 0 END)"
_SLICE_X = "(CASE WHEN least(b.x2, r.x2) > greatest(b.x1, r.x1) THEN (least(b.x2, r.x2) - greatest(b.x1, r.x1)) ELSE 0 END)"
_LINES = {
    f"best_{n}": f"""SELECT b.table_id, b.box_id, arg_min(r.idx, (-s, r.idx)) FILTER (s > 0) AS by_overlap, min(r.idx) FILTER (({lo1} + {hi1}) / 2 BETWEEN {lo2} AND {hi2}) AS by_centre,
      arg_min(r.idx, (abs(({lo1} + {hi1}) / 2 - ({lo2} + {hi2}) / 2), r.idx)) AS by_distance
      FROM (SELECT b.*, r.idx, r.x1 AS rx1, r.x2 AS rx2, r.y1 AS ry1, r.y2 AS ry2,
        0.3 * {o} / (({hi1} - {lo1}) + ({hi2} - {lo2}) - {o}) + 0.7 * {o} / ({hi1} - {lo1}) AS s
        FROM ocr_boxes b JOIN struct_elements r ON r.table_id = b.table_id AND r.kind = '{n}') b, LATERAL (SELECT b.idx AS idx, b.rx1 AS x1, b.rx2 AS x2, b.ry1 AS y1, b.ry2 AS y2) r
      GROUP BY b.table_id, b.box_id"""
    for n, lo1, hi1, lo2, hi2, o in (
        ("rows", "b.y1", "b.y2", "r.y1", "r.y2", _SLICE_Y), ("columns", "b.x1", "b.x2", "r.x1", "r.x2", _SLICE_X),
    )
}


def _align_sql(method):
    pick = {
        "hybrid": "coalesce({0}.by_overlap, {0}.by_centre, {0}.by_distance)",
        "iou": "{0}.by_overlap", "center": "{0}.by_centre",
    }[method]
    return q(
        "ocr_boxes struct_elements",
        f"""SELECT g.table_id, g.row_idx, g.col_idx, coalesce(text, '') AS text FROM
        (SELECT r.table_id, r.idx AS row_idx, c.idx AS col_idx FROM struct_elements r JOIN struct_elements c ON c.table_id = r.table_id AND c.kind = 'columns' WHERE r.kind = 'rows') g
        LEFT JOIN (SELECT b.table_id, {pick.format('y')} AS row_idx, {pick.format('x')} AS col_idx, string_agg(text, ' ' ORDER BY y1, x1, b.box_id) AS text
           FROM ocr_boxes b JOIN best_rows y ON y.table_id = b.table_id AND y.box_id = b.box_id JOIN best_columns x ON x.table_id = b.table_id AND x.box_id = b.box_id GROUP BY 1, 2, 3) f
        ON f.table_id = g.table_id AND f.row_idx = g.row_idx AND f.col_idx = g.col_idx""",
        _LINES,
    )


def _kept_boxes(spark, sf):
    """Boxes and elements of statements, stored dealt by table: neither is dealt again."""
    keep = I.keeper(spark, sf)
    return keep(I.ocr_boxes(spark, sf)), keep(I.struct_elements(spark, sf))


def _align(method):
    def run(spark, sf):
        boxes, elements = _kept_boxes(spark, sf)
        return A.align_to_grid(boxes, elements, method)

    return run


for _m in ("hybrid", "iou", "center"):
    query(_align_sql(_m), name=f"aligned_grid_{_m}")(_align(_m))


_CELLPAIR = f"""SELECT b.table_id, b.box_id, b.text, b.x1, b.x2, c.cell_id, {S.iou('b', 'c')} AS iou, {S.share_inside('b', 'c')} AS share, {S.share_inside('c', 'b')} AS covered,
  (b.x1 + b.x2) / 2 BETWEEN c.x1 AND c.x2 AND (b.y1 + b.y2) / 2 BETWEEN c.y1 AND c.y2 AS inside
  FROM ocr_boxes b JOIN cell_boxes c ON c.table_id = b.table_id AND least(b.x2, c.x2) > greatest(b.x1, c.x1) AND least(b.y2, c.y2) > greatest(b.y1, c.y1)"""


def _boxes_cells(spark, sf):
    rows = I.stored_rows(spark, sf)
    return I.ocr_boxes(spark, sf, rows), I.cell_boxes(spark, sf, rows)


@query(
    q(
        "ocr_boxes cell_boxes",
        """SELECT c.table_id, c.cell_id, coalesce(t.text, '') AS text FROM cell_boxes c LEFT JOIN (SELECT table_id, cell_id, string_agg(text, ' ' ORDER BY box_id) AS text FROM (
       SELECT table_id, box_id, any_value(text) AS text, coalesce(arg_min(cell_id, (-iou, cell_id)) FILTER (iou >= 0.1), min(cell_id) FILTER (inside)) AS cell_id FROM pairs GROUP BY table_id, box_id)
       GROUP BY table_id, cell_id) t USING (table_id, cell_id)""",
        {"pairs": _CELLPAIR},
    )
)
def cell_texts(spark, sf):
    return A.align_to_cells(*_boxes_cells(spark, sf))


@query(
    q(
        "ocr_boxes cell_boxes",
        """SELECT c.table_id, c.cell_id, c.text AS gt, coalesce(s.pred, '') AS pred, coalesce(s.n, 0) AS n_boxes, coalesce(i.pred, '') AS pred_by_iou FROM cell_boxes c
      LEFT JOIN (SELECT table_id, cell_id, count(*) AS n, string_agg(text, ' ' ORDER BY (x1 + x2) / 2, box_id) AS pred FROM pairs WHERE share > 0.3 GROUP BY ALL) s USING (table_id, cell_id)
      LEFT JOIN (SELECT table_id, cell_id, string_agg(text, ' ' ORDER BY x1, box_id) AS pred FROM pairs WHERE iou > 0.1 GROUP BY ALL) i USING (table_id, cell_id)""",
        {"pairs": _CELLPAIR},
    )
)
def merged_cell_texts(spark, sf):
    boxes, cells = _boxes_cells(spark, sf)
    by_iou = A.merge_into_cells(boxes, cells, 0.1, "iou").select(
        "table_id", "cell_id", F.col("pred").alias("pred_by_iou")
    )
    return A.merge_into_cells(boxes, cells).join(by_iou, ["table_id", "cell_id"])


@query(
    q(
        "ocr_boxes cell_boxes",
        """SELECT c.table_id, c.cell_id, c.text AS gt, m.b.box_id AS box_id, m.b.text AS pred, round(m.b.iou, 6) AS iou FROM cell_boxes c LEFT JOIN
      (SELECT table_id, cell_id, arg_min({'box_id': box_id, 'text': text, 'iou': iou}, (-iou, box_id)) AS b FROM pairs WHERE iou >= 0.3 GROUP BY ALL) m USING (table_id, cell_id)""",
        {"pairs": _CELLPAIR},
    )
)
def best_boxes(spark, sf):
    return A.best_box_per_cell(*_boxes_cells(spark, sf)).withColumn("iou", F.round("iou", 6))


@query(
    q(
        "ocr_boxes cell_boxes",
        """SELECT c.table_id, c.cell_id, c.text AS gt, m.b.box_id AS box_id, CASE WHEN m.b IS NULL THEN 1.0 WHEN contains(lower(m.b.text), lower(c.text)) THEN 0.0
        ELSE round(coalesce(list_min(list_transform(regexp_split_to_array(lower(m.b.text), '\\s+'), lambda w: levenshtein(lower(c.text), w) / length(c.text))), 1.0), 6) END AS cer
      FROM cell_boxes c LEFT JOIN (SELECT table_id, cell_id, arg_min({'box_id': box_id, 'text': text}, (-covered, box_id)) AS b FROM pairs WHERE covered >= 0.5 GROUP BY ALL) m USING (table_id, cell_id)""",
        {"pairs": _CELLPAIR},
    )
)
def words_in_lines(spark, sf):
    return A.words_to_lines(*_boxes_cells(spark, sf)).withColumn("cer", F.round("cer", 6))


@query(
    q(
        "cell_boxes struct_elements",
        """SELECT c.table_id, c.cell_id, coalesce(min(r.idx) FILTER (r.kind = 'rows' AND (c.y1 + c.y2) / 2 BETWEEN r.y1 AND r.y2), 0) AS row_idx,
        coalesce(min(r.idx) FILTER (r.kind = 'columns' AND (c.x1 + c.x2) / 2 BETWEEN r.x1 AND r.x2), 0) AS col_idx FROM cell_boxes c JOIN struct_elements r ON r.table_id = c.table_id GROUP BY ALL""",
    )
)
def placed_cells(spark, sf):
    keep = I.keeper(spark, sf)
    cells = keep(I.cell_boxes(spark, sf).drop("row_idx", "col_idx", "text").withColumnRenamed("cell_id", "box_id"))
    elements = keep(I.struct_elements(spark, sf))
    return A.place_cells(cells, elements).select(
        "table_id", F.col("box_id").alias("cell_id"), "row_idx", "col_idx"
    )


# --- grids from boxes ---------------------------------------------------------------------------

_GAPROWS = """SELECT b.*, sum(CASE WHEN yc - prev > gap THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY yc, x1, box_id ROWS UNBOUNDED PRECEDING)::INTEGER AS row_idx
  FROM (SELECT *, lag(yc) OVER (PARTITION BY table_id ORDER BY yc, x1, box_id) AS prev, greatest(10, 0.6 * median(y2 - y1) OVER (PARTITION BY table_id)) AS gap FROM (SELECT *, (y1 + y2) / 2 AS yc FROM ocr_boxes)) b"""


@query(
    q(
        "ocr_boxes",
        """SELECT g.table_id, g.box_id, g.row_idx AS by_gap, e.row_idx AS by_edge FROM gap g JOIN (
      SELECT table_id, box_id, sum(CASE WHEN y1 - prev > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY y1, x1, box_id ROWS UNBOUNDED PRECEDING)::INTEGER AS row_idx
      FROM (SELECT *, lag(y1) OVER (PARTITION BY table_id ORDER BY y1, x1, box_id) AS prev FROM ocr_boxes)) e USING (table_id, box_id)""",
        {"gap": _GAPROWS},
    )
)
def rows_by_gap(spark, sf):
    boxes = _heights(spark, sf)
    gap = A.rows_by_gap(boxes).select("table_id", "box_id", F.col("row_idx").alias("by_gap"))
    edge = A.rows_by_gap(boxes, F.col("y1"), 20.0).select("table_id", "box_id", F.col("row_idx").alias("by_edge"))
    return gap.join(edge, ["table_id", "box_id"])


def _walk(names: str, steps: dict[str, str], walk: str, body: str, **after: str) -> str:
    """``body`` over a walk along one position after another."""
    head = q(names, "", steps).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    return f"{head},\nwalk AS ({walk})" + "".join(f",\n{n} AS ({s})" for n, s in after.items()) + f"\n{body}"


def _anchors(gap: int) -> dict[str, str]:
    """Each row's first centre is the nearest one that lies far enough below the last row's."""
    return {
        "steps": {"mids": "SELECT DISTINCT table_id, (y1 + y2) / 2 AS p FROM ocr_boxes"},
        "walk": f"""SELECT table_id, 0 AS row_idx, min(p) AS row_y FROM mids GROUP BY table_id UNION ALL
          SELECT w.table_id, w.row_idx + 1, min(m.p) FROM walk w JOIN mids m ON m.table_id = w.table_id AND m.p > w.row_y AND m.p - w.row_y >= {gap} GROUP BY w.table_id, w.row_idx""",
        "anchored": """SELECT o.*, max(w.row_idx)::INTEGER AS row_idx, max(w.row_y) AS row_y
          FROM ocr_boxes o JOIN walk w ON w.table_id = o.table_id AND w.row_y <= (o.y1 + o.y2) / 2 GROUP BY ALL""",
    }


_CENTRES = {
    "steps": {"xs": """SELECT table_id, (x1 + x2) / 2 AS pos, count(*) AS n, row_number() OVER (PARTITION BY table_id ORDER BY (x1 + x2) / 2) AS k
      FROM ocr_boxes WHERE regexp_matches(text, '[0-9]') GROUP BY table_id, pos"""},
    "walk": """SELECT table_id, k, 0 AS idx, pos AS c FROM xs WHERE k = 1 UNION ALL
      SELECT w.table_id, x.k, CASE WHEN abs(pos - c) > 40 THEN idx + 1 ELSE idx END, CASE WHEN abs(pos - c) > 40 THEN pos ELSE pos - (pos - c) * pow(0.5, n) END
      FROM walk w JOIN xs x ON x.table_id = w.table_id AND x.k = w.k + 1""",
    "centres": "SELECT table_id, idx, arg_max(c, k) AS pos FROM walk GROUP BY table_id, idx",
}


@query(_walk("ocr_boxes", body="SELECT table_id, box_id, row_idx, row_y FROM anchored", **_anchors(40)), name="rows_by_anchor")
def _anchor(spark, sf):
    return A.rows_by_anchor(_heights(spark, sf), 40.0).select("table_id", "box_id", "row_idx", "row_y")


@query(
    _walk(
        "ocr_boxes",
        {"ys": "SELECT table_id, y1 AS p, row_number() OVER (PARTITION BY table_id ORDER BY min(box_id), y1) AS k FROM ocr_boxes GROUP BY table_id, y1"},
        """SELECT DISTINCT table_id, 0::BIGINT AS k, []::DOUBLE[] AS bins, NULL::DOUBLE AS p, NULL::DOUBLE AS row_y FROM ys UNION ALL
        SELECT table_id, k, CASE WHEN home IS NULL THEN list_append(bins, p) ELSE bins END, p, coalesce(home, p) FROM (
          SELECT w.table_id, y.k, w.bins, y.p, list_filter(w.bins, lambda b: abs(y.p - b) < 40)[1] AS home FROM walk w JOIN ys y ON y.table_id = w.table_id AND y.k = w.k + 1)""",
        "SELECT o.table_id, box_id, (dense_rank() OVER (PARTITION BY o.table_id ORDER BY row_y) - 1)::INTEGER AS row_idx, row_y FROM ocr_boxes o JOIN walk w ON w.table_id = o.table_id AND w.p = o.y1",
    ),
    name="rows_by_first_fit",
)
def _first_fit(spark, sf):
    return A.rows_by_first_fit(_heights(spark, sf), 40.0).select("table_id", "box_id", "row_idx", "row_y")


_BOXGRID = {
    **{k: v for k, v in _CENTRES.items() if k not in ("steps", "walk")},
    "gap": _GAPROWS,
    "homes": """SELECT g.table_id, g.box_id, arg_min(c.idx, (abs((g.x1 + g.x2) / 2 - c.pos), c.idx)) + 1 AS col_idx
      FROM gap g JOIN centres c ON c.table_id = g.table_id WHERE regexp_matches(g.text, '[0-9]') GROUP BY ALL""",
    "fallback": """SELECT r.table_id, r.row_idx, c.col_idx, coalesce(t.text, '') AS text FROM (SELECT DISTINCT table_id, row_idx FROM gap) r
      JOIN (SELECT table_id, (idx + 1)::INTEGER AS col_idx FROM centres UNION SELECT table_id, 0 FROM centres) c USING (table_id)
      LEFT JOIN (SELECT table_id, row_idx, coalesce(col_idx, 0) AS col_idx, trim(string_agg(text, ' ' ORDER BY x1, yc, box_id)) AS text
                 FROM gap LEFT JOIN homes USING (table_id, box_id) GROUP BY ALL) t USING (table_id, row_idx, col_idx)""",
}


@query(
    _walk("ocr_boxes", _CENTRES["steps"], _CENTRES["walk"], "SELECT * FROM fallback", **_BOXGRID), name="grid_from_boxes"
)
def _grid_from_boxes(spark, sf):
    return A.grid_from_boxes(I.keeper(spark, sf)(I.ocr_boxes(spark, sf)))


@query(
    _walk(
        "ocr_boxes struct_elements",
        body="""SELECT table_id, row_idx, (col_idx - lead)::INTEGER AS col_idx, text FROM (
          SELECT *, min(col_idx) FILTER (trim(text) <> '') OVER (PARTITION BY table_id, row_idx) AS lead FROM texts) WHERE col_idx >= lead""",
        **_anchors(20),
        cols="SELECT table_id, idx, x1, x2, (x1 + x2) / 2 AS mid FROM struct_elements WHERE kind = 'columns'",
        placed="""SELECT a.table_id, a.box_id, a.row_idx, a.text, a.pos, coalesce(min(c.idx) FILTER (a.pos BETWEEN c.x1 AND c.x2), arg_min(c.idx, (abs(a.pos - c.mid), c.idx))) AS col_idx
          FROM (SELECT *, (x1 + x2) / 2 AS pos FROM anchored) a JOIN cols c USING (table_id) GROUP BY ALL""",
        texts="SELECT table_id, row_idx, col_idx, string_agg(text, ' ' ORDER BY pos, box_id) AS text FROM placed GROUP BY ALL",
    ),
    name="grid_with_column_bounds",
)
def _grid_with_columns(spark, sf):
    return A.grid_with_columns(*_kept_boxes(spark, sf))


@query(
    _walk("ocr_boxes", _CENTRES["steps"], _CENTRES["walk"], "SELECT table_id, idx, round(pos, 6) AS pos FROM centres", centres=_CENTRES["centres"]),
    name="column_centres",
)
def _column_centres(spark, sf):
    numbers = I.ocr_boxes(spark, sf).where(F.col("text").rlike(r"\d"))
    return A.column_centres(
        stored(numbers.select("table_id", ((F.col("x1") + F.col("x2")) / 2).alias("pos")))
    ).withColumn("pos", F.round("pos", 6))


@query(
    q(
        "cells struct_elements",
        """SELECT table_id, in_header, small_integers, n_columns, in_header OR n_columns >= 6 OR small_integers >= 3 AS has_note_column FROM (
      SELECT table_id, bool_or(row_idx < 3 AND col_idx <= 2 AND lower(trim(text)) = 'note') AS in_header,
        count(*) FILTER (row_idx >= 3 AND col_idx = 1 AND regexp_matches(trim(text), '^[0-9]+$') AND TRY_CAST(trim(text) AS INTEGER) BETWEEN 1 AND 30) AS small_integers FROM cells GROUP BY table_id)
      JOIN (SELECT table_id, count(*) AS n_columns FROM struct_elements WHERE kind = 'columns' GROUP BY table_id) USING (table_id)""",
    )
)
def note_columns(spark, sf):
    return A.note_columns(I.cells(spark, sf), I.struct_elements(spark, sf))


# --- matching -----------------------------------------------------------------------------------


def _greedy(keys: str, pairs: str, order: str, body: str, names: str = "pred_boxes gt_boxes", **more: str) -> str:
    """One pair after the other, with the boxes used so far as lists."""
    rank = {"iou": "iou DESC, p, g", "prediction": "p, iou DESC, g"}[order]
    on = " AND ".join(f"r.{k} = w.{k}" for k in keys.split(", "))
    these, those = (", ".join(f"{x}.{k}" for k in keys.split(", ")) for x in "rw")
    head = q(names, "", {**more, "cand": pairs}).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    return f"""{head},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {rank}) AS n FROM cand),
walk AS (
  SELECT {keys}, 0::BIGINT AS n, []::BIGINT[] AS ps, []::BIGINT[] AS gs, NULL::BIGINT AS p, NULL::BIGINT AS g, NULL::DOUBLE AS iou
  FROM (SELECT DISTINCT {keys} FROM ranked)
  UNION ALL
  SELECT {keys}, n, CASE WHEN free THEN list_append(ps, p0) ELSE ps END, CASE WHEN free THEN list_append(gs, g0) ELSE gs END,
         CASE WHEN free THEN p0 END, CASE WHEN free THEN g0 END, CASE WHEN free THEN iou END FROM (
    SELECT {these}, r.n, w.ps, w.gs, r.p AS p0, r.g AS g0, r.iou, NOT list_contains(w.ps, r.p) AND NOT list_contains(w.gs, r.g) AS free
    FROM walk w JOIN ranked r ON {on} AND r.n = w.n + 1)
), matches AS (SELECT {keys}, p, g, iou FROM walk WHERE p IS NOT NULL)
{body}"""


_CAND = f"""SELECT * FROM (SELECT p.image_id, p.idx AS p, g.idx AS g, {S.iou('p', 'g')} AS iou
  FROM pred_boxes p JOIN gt_boxes g ON p.image_id = g.image_id AND p.x1 < g.x2 AND g.x1 < p.x2) WHERE iou >= 0.5"""
_MATCHES = "SELECT image_id, p, g, round(iou, 6) AS iou FROM matches"
_SCORES = """round(coalesce(sum(tp) / nullif(sum(np), 0), 0), 6) AS precision, round(coalesce(sum(tp) / nullif(sum(ng), 0), 0), 6) AS recall,
  round(CASE WHEN sum(tp) = 0 THEN 0 ELSE 2 * sum(tp) / (sum(np) + sum(ng)) END, 6) AS f1"""
_TOTALS = "sum(tp)::BIGINT AS tp, (sum(np) - sum(tp))::BIGINT AS fp, (sum(ng) - sum(tp))::BIGINT AS fn"
_COUNTS = """(SELECT {keys}, 0 AS tp, 1 AS np, 0 AS ng, 0.0 AS s FROM {pred} UNION ALL SELECT {keys}, 0, 0, 1, 0 FROM {gt} UNION ALL SELECT {keys}, 1, 0, 0, iou FROM matches)"""


@query(_greedy("image_id", _CAND, "prediction", _MATCHES), name="greedy_matches_by_prediction")
def _by_prediction(spark, sf):
    pred, gt = I.detections(spark, sf)
    return M.greedy_match(M.candidate_pairs(pred, gt, 0.5), "prediction").withColumn("iou", F.round("iou", 6))


@query(_greedy("image_id", _CAND, "iou", _MATCHES), name="greedy_matches_by_iou")
def _by_iou(spark, sf):
    pred, gt = I.detections(spark, sf)
    return M.greedy_match(M.candidate_pairs(pred, gt, 0.5), "iou").withColumn("iou", F.round("iou", 6))


@query(
    _greedy(
        "image_id, threshold", f"SELECT c.*, threshold FROM ({_CAND}) c JOIN limits ON iou >= threshold", "prediction",
        f"""SELECT threshold, {_SCORES}, round(coalesce(sum(s) / nullif(sum(tp), 0), 0), 6) AS mean_iou, {_TOTALS}
        FROM {_COUNTS.format(keys="threshold", pred="pred_boxes, limits", gt="gt_boxes, limits")} GROUP BY threshold""",
        limits="SELECT unnest([0.5, 0.75, 0.9])::DOUBLE AS threshold",
    ),
    name="detection_scores_at_thresholds",
)
def _scores_at(spark, sf):
    return _rounded(M.scores_at(*_stored(*I.detections(spark, sf))), "mean_iou")


def _rounded(scores, *more):
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", *more)})


@query(
    _greedy(
        "image_id", _CAND, "iou",
        f"""SELECT image_id, {_SCORES}, round(CASE WHEN sum(tp) + sum(np) + sum(ng) = 0 THEN 1 ELSE coalesce(avg(s / nullif(tp, 0)), 0) END, 6) AS avg_iou, {_TOTALS}
        FROM (SELECT image_id, sum(tp) AS tp, sum(np) AS np, sum(ng) AS ng, sum(s) AS s
              FROM {_COUNTS.format(keys="image_id", pred="pred_boxes", gt="gt_boxes")} GROUP BY image_id) GROUP BY GROUPING SETS ((image_id), ())""",
    ),
    name="detection_scores_by_image",
)
def _by_image(spark, sf):
    pred, gt = _stored(*I.detections(spark, sf))
    matches = M.greedy_match(M.candidate_pairs(pred, gt, 0.5), "iou")
    return _rounded(M.image_scores(M.detection_counts(pred, gt, matches)), "avg_iou")


@query(
    _greedy(
        "image_id, threshold",
        f"""SELECT c.*, threshold FROM (SELECT p.image_id, p.idx AS p, g.idx AS g, {S.iou('p', 'g')} AS iou FROM moved p JOIN truth g ON p.image_id = g.image_id
            AND p.x1 < g.x2 AND g.x1 < p.x2 AND p.y1 < g.y2 AND g.y1 < p.y2) c JOIN limits ON iou >= threshold""",
        "prediction",
        f"""SELECT kind, threshold, {_SCORES}, round(coalesce(sum(s) / nullif(sum(tp), 0), 0), 6) AS mean_iou, {_TOTALS}
        FROM (SELECT *, split_part(image_id, ':', 2) AS kind FROM {_COUNTS.format(keys="image_id, threshold", pred="moved, limits", gt="truth, limits")}) GROUP BY kind, threshold""",
        "struct_elements", limits="SELECT unnest([0.5, 0.75])::DOUBLE AS threshold",
        truth="SELECT table_id || ':' || kind AS image_id, idx, x1, y1, x2, y2, score FROM struct_elements",
        moved="SELECT image_id, idx, x1, y1, x2, y2 + (idx % 7) * 3 AS y2 FROM truth WHERE idx % 9 <> 4 AND score > 0.5",
    )
)
def structure_scores(spark, sf):
    gt = I.struct_elements(spark, sf)
    one = F.concat_ws(":", "table_id", "kind").alias("image_id")
    (truth,) = _stored(gt.select(one, "kind", "idx", "x1", "y1", "x2", "y2", "score"))
    moved = truth.where(F.col("idx") % 9 != 4).withColumn("y2", F.col("y2") + (F.col("idx") % 7) * 3)
    (pred,) = _stored(B.above(moved, 0.5))
    scores = M.scores_at(pred, truth, (0.5, 0.75), kind=F.split_part("image_id", F.lit(":"), F.lit(2)))
    return _rounded(scores, "mean_iou")
