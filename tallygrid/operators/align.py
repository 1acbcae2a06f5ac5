"""Recognised boxes placed into grids and cells.

Boxes meet lines or cells through spatial bands, never through all pairs of a table:
both sides are copied to the bands they touch and joined on (table, band), so the work
follows the number of real neighbours and one large table spreads over its bands.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions import geometry as G
from tallygrid.functions import text as T
from tallygrid.operators.boxes import lines
from tallygrid.partitioning import attach, neighbours, row_chunk, running_sums

BAND = 64.0
SPREAD = 8192.0


def _bands(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(F.greatest(lo, hi) / size))


def ordered_text(order: list[Column | str], text: str = "text") -> Column:
    """Aggregate: the texts of one cell joined by blanks in the given order."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    items = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda s: s["t"]), " ")


# --- rows and columns ---------------------------------------------------------------------


def best_lines(boxes: DataFrame, marks: DataFrame, axis: str) -> DataFrame:
    """table_id, box_id, by_overlap, by_centre: the row (y) or column (x) of each box.

    ``marks``: table_id, m_idx, m_x1..m_y2.  Lines are also copied to the stretches of
    the other axis that hold boxes, which keeps a long table's few columns from
    becoming its hot keys.
    """
    lo, hi, other = ("y1", "y2", "x1") if axis == "y" else ("x1", "x2", "y1")
    stretch = F.floor(F.col(other) / SPREAD)
    spread = boxes.select(
        "table_id", "box_id", "x1", "y1", "x2", "y2", stretch.alias("stretch"),
        F.explode(_bands(F.col(lo), F.col(hi), BAND)).alias("band"),
    )
    stretches = boxes.select("table_id", stretch.alias("stretch")).distinct()
    placed = marks.join(stretches, "table_id").select(
        "table_id", "stretch", "m_idx", f"m_{lo}", f"m_{hi}",
        F.explode(_bands(F.col(f"m_{lo}"), F.col(f"m_{hi}"), BAND)).alias("band"),
    )
    pairs = spread.join(placed, ["table_id", "stretch", "band"])
    box = G.box()
    mlo, mhi = F.col(f"m_{lo}"), F.col(f"m_{hi}")
    if axis == "y":
        slice_ = (box[0], mlo, box[2], mhi)
    else:
        slice_ = (mlo, box[1], mhi, box[3])
    score = G.iou(box, slice_) * 0.3 + G.overlap(box, slice_, axis) * 0.7
    mid = G.centre(F.col(lo), F.col(hi))
    inside = (mlo <= mid) & (mid <= mhi)
    idx = F.col("m_idx")
    return pairs.withColumn("_s", score).groupBy("table_id", "box_id").agg(
        F.min_by(F.when(F.col("_s") > 0, idx), F.when(F.col("_s") > 0, F.struct(-F.col("_s"), idx)))
        .alias("by_overlap"),
        F.min(F.when(inside, idx)).alias("by_centre"),
    )


def nearest(points: DataFrame, sites: DataFrame) -> DataFrame:
    """table_id, pos, nearest_idx: the closest site of each distinct position.

    ``points``: table_id, pos; ``sites``: table_id, pos, idx.  Equal distances go to
    the lower index.  The search looks at the sites just before and after along the
    line, found stretch by stretch.
    """
    both = points.select("table_id", "pos", F.lit(None).cast("int").alias("idx")).unionByName(
        sites.select("table_id", "pos", F.col("idx").cast("int").alias("idx"))
    )
    unique = both.groupBy("table_id", "pos").agg(
        F.min("idx").alias("idx"), F.max(F.col("idx").isNull()).alias("is_point")
    )
    site = F.when(F.col("idx").isNotNull(), F.struct("pos", "idx"))
    near = neighbours(
        unique, {"before": site}, {"after": site}, ["table_id"], "pos",
        F.floor(F.col("pos") / 256.0),
    ).where("is_point")

    def option(c: str) -> Column:
        s = F.col(c)
        return F.when(
            s.isNotNull(), F.struct(F.abs(s["pos"] - F.col("pos")).alias("d"), s["idx"].alias("i"))
        )

    here = F.when(F.col("idx").isNotNull(), F.struct(F.lit(0.0).alias("d"), F.col("idx").alias("i")))
    best = F.array_min(F.array_compact(F.array(here, option("before"), option("after"))))
    return near.select("table_id", "pos", best["i"].alias("nearest_idx"))


def _placed(boxes: DataFrame, marks: DataFrame, axis: str, method: str, name: str) -> DataFrame:
    found = best_lines(boxes, marks, axis)
    pick = {
        "iou": F.col("by_overlap"),
        "center": F.col("by_centre"),
        "hybrid": F.coalesce("by_overlap", "by_centre"),
    }[method]
    out = boxes.join(found, ["table_id", "box_id"], "left").withColumn(name, pick)
    out = out.drop("by_overlap", "by_centre")
    if method != "hybrid":
        return out
    lo, hi = ("y1", "y2") if axis == "y" else ("x1", "x2")
    out = out.withColumn("pos", G.centre(F.col(lo), F.col(hi)))
    sites = marks.select(
        "table_id", G.centre(F.col(f"m_{lo}"), F.col(f"m_{hi}")).alias("pos"),
        F.col("m_idx").alias("idx"),
    )
    lost = out.where(F.col(name).isNull()).select("table_id", "pos").distinct()
    wanted = sites.join(lost.select("table_id").distinct(), "table_id", "left_semi")
    return (
        out.join(nearest(lost, wanted), ["table_id", "pos"], "left")
        .withColumn(name, F.coalesce(name, "nearest_idx"))
        .drop("pos", "nearest_idx")
    )


def assign_to_grid(boxes: DataFrame, elements: DataFrame, method: str = "hybrid") -> DataFrame:
    """boxes with row_idx and col_idx; null where the method finds no line."""
    rows = lines(elements, "rows", "m")
    columns = lines(elements, "columns", "m")
    placed = _placed(boxes, rows, "y", method, "row_idx")
    return _placed(placed, columns, "x", method, "col_idx")


def align_to_grid(boxes: DataFrame, elements: DataFrame, method: str = "hybrid") -> DataFrame:
    """Full grid of texts: every row and column of the structure, '' where empty."""
    filled = (
        assign_to_grid(boxes, elements, method)
        .where(F.col("row_idx").isNotNull() & F.col("col_idx").isNotNull())
        .groupBy("table_id", "row_idx", "col_idx")
        .agg(ordered_text(["y1", "x1", "box_id"]).alias("text"))
    )
    return fill_grid(filled, full_grid(elements))


def full_grid(elements: DataFrame) -> DataFrame:
    """table_id, row_idx, col_idx of every cell of the structure."""
    rows = elements.where(F.col("kind") == "rows").select("table_id", F.col("idx").alias("row_idx"))
    columns = elements.where(F.col("kind") == "columns").select(
        "table_id", F.col("idx").alias("col_idx")
    )
    sizes = rows.groupBy("table_id").agg((F.max("row_idx") + 1).alias("n_rows"))
    chunked = rows.withColumn("row_chunk", row_chunk())
    return attach(chunked, columns, sizes, how="inner").select("table_id", "row_idx", "col_idx")


def fill_grid(cells: DataFrame, grid: DataFrame) -> DataFrame:
    return grid.join(cells, ["table_id", "row_idx", "col_idx"], "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


def place_cells(cell_boxes: DataFrame, elements: DataFrame) -> DataFrame:
    """Detected cells to the first row and column holding their centre, else 0."""
    zero = F.lit(0)
    placed = assign_to_grid(cell_boxes, elements, "center")
    return placed.withColumn("row_idx", F.coalesce("row_idx", zero)).withColumn(
        "col_idx", F.coalesce("col_idx", zero)
    )


# --- cell boxes ------------------------------------------------------------------------------


def overlapping(
    left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("table_id",), tile: float = 256.0
) -> DataFrame:
    """Pairs of boxes sharing some area; the right box comes as b_x1..b_y2.

    Both sides are copied to the tiles they touch; a pair is kept only in the tile
    holding the top-left corner of the common area, so it appears once.
    """

    def tiled(df: DataFrame, p: str) -> DataFrame:
        x = _bands(F.col(f"{p}x1"), F.col(f"{p}x2"), tile)
        y = _bands(F.col(f"{p}y1"), F.col(f"{p}y2"), tile)
        return df.withColumn("tile_x", F.explode(x)).withColumn("tile_y", F.explode(y))

    renamed = right
    for c in ("x1", "y1", "x2", "y2"):
        renamed = renamed.withColumnRenamed(c, f"b_{c}")
    pairs = tiled(left, "").join(tiled(renamed, "b_"), [*keys, "tile_x", "tile_y"])
    corner = (F.greatest("x1", "b_x1"), F.greatest("y1", "b_y1"))
    return pairs.where(
        (F.least("x2", "b_x2") > corner[0])
        & (F.least("y2", "b_y2") > corner[1])
        & (F.floor(corner[0] / tile) == F.col("tile_x"))
        & (F.floor(corner[1] / tile) == F.col("tile_y"))
    ).drop("tile_x", "tile_y")


def _pairs(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    slim = boxes.select("table_id", "box_id", "text", "x1", "y1", "x2", "y2")
    targets = cells.select("table_id", "cell_id", "x1", "y1", "x2", "y2")
    return overlapping(slim, targets)


def align_to_cells(boxes: DataFrame, cells: DataFrame, min_iou: float = 0.1) -> DataFrame:
    """Each box to its best cell (IoU, else the first cell holding its centre)."""
    cx, cy = G.centre(F.col("x1"), F.col("x2")), G.centre(F.col("y1"), F.col("y2"))
    inside = (
        (F.col("b_x1") <= cx) & (cx <= F.col("b_x2")) & (F.col("b_y1") <= cy) & (cy <= F.col("b_y2"))
    )
    good = F.col("_iou") >= min_iou
    chosen = (
        _pairs(boxes, cells)
        .withColumn("_iou", G.iou(G.box(), G.box("b_")))
        .groupBy("table_id", "box_id")
        .agg(
            F.first("text").alias("text"),
            F.coalesce(
                F.min_by("cell_id", F.when(good, F.struct(-F.col("_iou"), F.col("cell_id")))),
                F.min(F.when(inside, F.col("cell_id"))),
            ).alias("cell_id"),
        )
    )
    texts = (
        chosen.where(F.col("cell_id").isNotNull())
        .groupBy("table_id", "cell_id")
        .agg(ordered_text(["box_id"]).alias("text"))
    )
    return (
        cells.select("table_id", "cell_id")
        .join(texts, ["table_id", "cell_id"], "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
    )


def merge_into_cells(
    boxes: DataFrame, cells: DataFrame, min_share: float = 0.3, by: str = "share"
) -> DataFrame:
    """All boxes reaching far enough into a cell, joined left to right.

    ``by="share"``: common area over box area, ordered by x-centre; ``by="iou"``: IoU,
    ordered by left edge.  A box may serve several cells.
    """
    a, b = G.box(), G.box("b_")
    measure = G.containment(a, b) if by == "share" else G.iou(a, b)
    order = G.centre(F.col("x1"), F.col("x2")) if by == "share" else F.col("x1")
    texts = (
        _pairs(boxes, cells)
        .where(measure > min_share)
        .groupBy("table_id", "cell_id")
        .agg(ordered_text([order, "box_id"]).alias("pred"), F.count(F.lit(1)).alias("n_boxes"))
    )
    return cells.join(texts, ["table_id", "cell_id"], "left").select(
        "table_id", "cell_id", F.col("text").alias("gt"),
        F.coalesce("pred", F.lit("")).alias("pred"),
        F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"),
    )


def best_box_per_cell(boxes: DataFrame, cells: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """Each cell with its best-overlapping box, null where none reaches the threshold."""
    iou = G.iou(G.box(), G.box("b_"))
    best = (
        _pairs(boxes, cells)
        .withColumn("iou", iou)
        .where(F.col("iou") >= min_iou)
        .groupBy("table_id", "cell_id")
        .agg(
            F.min_by(
                F.struct("box_id", F.col("text").alias("pred"), "iou"),
                F.struct(-F.col("iou"), F.col("box_id")),
            ).alias("m")
        )
    )
    return cells.join(best, ["table_id", "cell_id"], "left").select(
        "table_id", "cell_id", F.col("text").alias("gt"), "m.box_id", "m.pred", "m.iou"
    )


def words_to_lines(line_boxes: DataFrame, words: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Each word with the line covering it best and its error against that line.

    A word found inside the line text scores 0, otherwise the best single word counts.
    """
    share = G.containment(G.box("b_"), G.box())
    best = (
        _pairs(line_boxes, words)
        .withColumn("share", share)
        .where(F.col("share") >= min_share)
        .groupBy("table_id", "cell_id")
        .agg(
            F.min_by(
                F.struct("box_id", F.col("text").alias("line")),
                F.struct(-F.col("share"), F.col("box_id")),
            ).alias("m")
        )
    )
    word, line = F.lower("text"), F.lower("m.line")
    errors = F.transform(T.words(line), lambda w: T.cer(word, w))
    return words.join(best, ["table_id", "cell_id"], "left").select(
        "table_id", "cell_id", F.col("text").alias("gt"), "m.box_id",
        F.when(F.col("m").isNull(), 1.0)
        .when(line.contains(word), 0.0)
        .otherwise(F.coalesce(F.array_min(errors), F.lit(1.0)))
        .alias("cer"),
    )


# --- grids from boxes alone ---------------------------------------------------------------------


def value_runs(df: DataFrame, value: str, new_run: Column, keys: tuple = ("table_id",)) -> DataFrame:
    """Distinct values per key with a run number; ``new_run`` may use ``prev``.

    ``df`` has one row per (keys, value).  Runs are counted inside chunks of values; the first
    value of a chunk meets the last one before it, and what earlier chunks counted is carried.
    """
    inside = Window.partitionBy(*keys, "_k").orderBy(value)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunks = Window.partitionBy(*keys).orderBy("_k")
    new = F.when(new_run, 1).otherwise(0)
    rows = df.withColumn("_k", F.floor(F.col(value) / 4096.0)).withColumn("prev", F.lag(value).over(inside))
    rows = rows.withColumn("_new", new)
    firsts = rows.select(
        "*", F.max(value).over(whole).alias("_last"), F.sum("_new").over(whole).alias("_n")
    ).where(F.col("prev").isNull())
    firsts = firsts.withColumn("prev", F.lag("_last").over(chunks)).withColumn("_new", new)
    total = F.sum(F.col("_n") + F.col("_new")).over(chunks.rowsBetween(Window.unboundedPreceding, 0))
    carried = firsts.select(*keys, "_k", (total - F.col("_n")).alias("_c")).where("_c <> 0")
    local = rows.select(*df.columns, "_k", F.sum("_new").over(so_far).alias("_l"))
    return local.join(carried, [*keys, "_k"], "left").select(
        *df.columns, (F.col("_l") + F.coalesce("_c", F.lit(0))).alias("run")
    )


def rows_by_gap(boxes: DataFrame, position: Column | None = None, gap: float | None = None) -> DataFrame:
    """boxes with row_idx: a new row starts where the step down exceeds the gap.

    The default gap is max(10, 0.6 x median box height), measured between centres.
    Boxes are reduced to their distinct heights on the page before anything is ordered.
    """
    pos = G.centre(F.col("y1"), F.col("y2")) if position is None else position
    placed = boxes.withColumn("_p", pos)
    heights = placed.select("table_id", "_p").distinct()
    if gap is None:
        limits = boxes.groupBy("table_id").agg(
            F.greatest(F.lit(10.0), F.median(F.col("y2") - F.col("y1")) * 0.6).alias("_gap")
        )
        heights = heights.join(limits, "table_id")
    else:
        heights = heights.withColumn("_gap", F.lit(gap))
    runs = value_runs(heights, "_p", F.col("_p") - F.col("prev") > F.col("_gap"))
    rows = runs.select("table_id", "_p", F.col("run").cast("int").alias("row_idx"))
    return placed.join(rows, ["table_id", "_p"]).drop("_p")


def _streamed(
    runs: DataFrame, order: list[str], fold: Callable[[], Callable[..., list]], results: list[str], values: list[str]
) -> DataFrame:
    """Rows of each (table_id, run) folded one after another, in ``order``.

    ``fold()`` gives a function for one stretch: called with the ``values`` of a row, or
    without any at the end, it returns result rows (doubles).  Stretches are dealt over the tasks and
    stream through; only the state of one stretch is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step, out, kind = None, None, [], None

        def sent() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            columns = list(zip(*rows, strict=True)) or [()] * (len(results) + 1)
            types = [kind, *[pa.float64()] * len(results)]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["table_id", *results])

        for batch in batches:
            kind = batch.column("table_id").type
            tables, numbers = batch.column("table_id").to_pylist(), batch.column("run").to_pylist()
            for table, number, *row in zip(
                tables, numbers, *(batch.column(c).to_pylist() for c in values), strict=True
            ):
                if (table, number) != last:
                    if step:
                        out += [(last[0], *r) for r in step()]
                    last, step = (table, number), fold()
                out += [(table, *r) for r in step(*row)]
            if len(out) >= 10_000:
                yield sent()
        if step:
            out += [(last[0], *r) for r in step()]
            yield sent()

    columns = dict.fromkeys(["table_id", "run", *values, *order])
    dealt = runs.select(*columns).repartition("table_id", "run")
    dealt = dealt.sortWithinPartitions("table_id", "run", *order)
    schema = f"table_id {runs.schema['table_id'].dataType.simpleString()}, "
    return dealt.mapInArrow(run, schema + ", ".join(f"{c} double" for c in results))


def _fold_rows(boxes: DataFrame, position: Column, gap: float, in_input_order: bool) -> DataFrame:
    """Rows built one box after another, gap-separated stretches independently.

    Positions at least ``gap`` apart never share a row, and only the first box at a
    position matters, so the fold sees the distinct positions of one stretch.  Rows are at
    least ``gap`` apart, so a position meets at most three cells of that width.
    """
    placed = boxes.withColumn("_p", position)
    firsts = placed.groupBy("table_id", "_p").agg(F.min("box_id").alias("_first"))
    runs = value_runs(firsts, "_p", F.col("_p") - F.col("prev") >= gap)

    def anchors():
        row_y = None

        def step(p: float | None = None) -> list:
            nonlocal row_y
            if p is None:
                return []
            if row_y is None or not abs(p - row_y) < gap:
                row_y = p
            return [(p, row_y)]

        return step

    def bins():
        cells: dict[int, list[tuple[int, float]]] = {}
        opened = 0

        def step(p: float | None = None) -> list:
            nonlocal opened
            if p is None:
                return []
            cell = math.floor(p / gap)
            near = [b for k in (cell - 1, cell, cell + 1) for b in cells.get(k, ()) if abs(p - b[1]) < gap]
            if near:
                return [(p, min(near)[1])]
            cells.setdefault(cell, []).append((opened, p))
            opened += 1
            return [(p, p)]

        return step

    order, fold = (["_first", "_p"], bins) if in_input_order else (["_p"], anchors)
    rows = _streamed(runs, order, fold, ["p", "row_y"], ["_p"])
    starts = rows.select("table_id", "row_y").distinct()
    ranked = running_sums(
        starts.withColumn("_k", F.floor(F.col("row_y") / 4096.0)), {"n": F.lit(1)},
        order="row_y", chunk="_k",
    )
    ranked = ranked.select("table_id", "row_y", (F.col("n") - 1).cast("int").alias("row_idx"))
    return (
        placed.join(rows.withColumnRenamed("p", "_p"), ["table_id", "_p"])
        .join(ranked, ["table_id", "row_y"])
        .drop("_p")
    )


def rows_by_anchor(boxes: DataFrame, gap: float = 20.0) -> DataFrame:
    """A new row starts once a box centre is ``gap`` or more below the row's first box."""
    mid = G.centre(F.col("y1"), F.col("y2"))
    return _fold_rows(boxes, mid, gap, in_input_order=False)


def rows_by_first_fit(boxes: DataFrame, gap: float = 25.0) -> DataFrame:
    """Boxes in input order join the oldest row closer than ``gap``, else open one."""
    return _fold_rows(boxes, F.col("y1"), gap, in_input_order=True)


def column_centres(values: DataFrame, threshold: float = 40.0) -> DataFrame:
    """table_id, idx, pos: cluster centres of x positions, each the running midpoint.

    A value further than the threshold from the last centre opens a cluster, otherwise
    the centre moves half-way towards it; k equal values move it by 1 - 2^-k.
    ``values``: table_id, pos (one row per box).
    """
    counted = values.groupBy("table_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    runs = value_runs(counted, "pos", F.col("pos") - F.col("prev") > threshold)

    def midpoints():
        centre = None

        def step(pos: float | None = None, n: int = 0) -> list:
            nonlocal centre
            if pos is None:
                return [] if centre is None else [(centre,)]
            if centre is not None and not abs(pos - centre) > threshold:
                centre = pos - (pos - centre) * 0.5**n
                return []
            done, centre = centre, pos
            return [] if done is None else [(done,)]

        return step

    centres = _streamed(runs, ["pos"], midpoints, ["pos"], ["pos", "n"])
    ranked = running_sums(
        centres.withColumn("_k", F.floor(F.col("pos") / 4096.0)), {"n": F.lit(1)},
        order="pos", chunk="_k",
    )
    return ranked.select("table_id", (F.col("n") - 1).cast("int").alias("idx"), "pos")


def grid_from_boxes(boxes: DataFrame) -> DataFrame:
    """Coarse grid when structure recognition failed: label column, then number columns."""
    mid = G.centre(F.col("x1"), F.col("x2"))
    rows = rows_by_gap(boxes).withColumn("pos", mid).withColumn(
        "is_number", F.col("text").rlike(r"\d")
    )
    numbers = rows.where("is_number")
    centres = column_centres(numbers.select("table_id", "pos"))
    nearest_centre = nearest(numbers.select("table_id", "pos").distinct(), centres)
    placed = (
        rows.join(nearest_centre, ["table_id", "pos"], "left")
        .withColumn(
            "col_idx", F.when(F.col("is_number"), F.col("nearest_idx") + 1).otherwise(0)
        )
    )
    y = G.centre(F.col("y1"), F.col("y2"))
    texts = placed.groupBy("table_id", "row_idx", "col_idx").agg(
        F.trim(ordered_text(["x1", y, "box_id"])).alias("text")
    )
    every_row = rows.select("table_id", "row_idx").distinct()
    columns = centres.select("table_id", (F.col("idx") + 1).alias("col_idx"))
    columns = columns.unionByName(columns.select("table_id").distinct().withColumn("col_idx", F.lit(0)))
    sizes = every_row.groupBy("table_id").agg((F.max("row_idx") + 1).alias("n_rows"))
    grid = attach(every_row.withColumn("row_chunk", row_chunk()), columns, sizes, how="inner")
    return fill_grid(texts, grid.select("table_id", "row_idx", "col_idx"))


def grid_with_columns(boxes: DataFrame, elements: DataFrame, gap: float = 20.0) -> DataFrame:
    """Anchor rows with known column bounds; leading blank cells of a row are dropped."""
    rows = rows_by_anchor(boxes, gap).drop("row_y")
    columns = lines(elements, "columns", "m")
    by_centre = _placed(rows, columns, "x", "center", "col_idx")
    pos = G.centre(F.col("x1"), F.col("x2"))
    sites = columns.select(
        "table_id", G.centre(F.col("m_x1"), F.col("m_x2")).alias("pos"), F.col("m_idx").alias("idx")
    )
    lost = by_centre.where(F.col("col_idx").isNull()).select("table_id", pos.alias("pos")).distinct()
    placed = (
        by_centre.withColumn("pos", pos)
        .join(nearest(lost, sites), ["table_id", "pos"], "left")
        .withColumn("col_idx", F.coalesce("col_idx", "nearest_idx"))
    )
    texts = placed.groupBy("table_id", "row_idx", "col_idx").agg(
        ordered_text([pos, "box_id"]).alias("text")
    )
    lead = texts.where(F.trim("text") != "").groupBy("table_id", "row_idx").agg(
        F.min("col_idx").alias("lead")
    )
    return texts.join(lead, ["table_id", "row_idx"]).where(
        F.col("col_idx") >= F.col("lead")
    ).select("table_id", "row_idx", (F.col("col_idx") - F.col("lead")).alias("col_idx"), "text")


def note_columns(cells: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """Per table: is column 1 a note column, and by which evidence?"""
    s = F.trim("text")
    r, c = F.col("row_idx"), F.col("col_idx")
    small = s.rlike(r"^\d+$") & s.try_cast("int").between(1, 30)
    tall = F.max(r) >= 3
    out = cells.groupBy("table_id").agg(
        F.coalesce(F.bool_or((r < 3) & (c <= 2) & (F.lower(s) == "note")), F.lit(False))
        .alias("in_header"),
        F.when(tall, F.count_if((r >= 3) & (c == 1) & small))
        .otherwise(F.count_if((c == 1) & small)).alias("small_integers"),
    )
    if elements is None:
        out = out.withColumn("n_columns", F.lit(0).cast("bigint"))
    else:
        n = elements.where(F.col("kind") == "columns").groupBy("table_id").agg(
            F.count(F.lit(1)).alias("n_columns")
        )
        out = out.join(n, "table_id", "left").fillna(0, ["n_columns"])
    verdict = F.col("in_header") | (F.col("n_columns") >= 6) | (F.col("small_integers") >= 3)
    return out.withColumn("has_note_column", verdict)


def choose_grid(aligned: DataFrame, fallback: DataFrame, has_checks: DataFrame) -> DataFrame:
    """Per table the aligned grid, or the fallback when the aligned one is poor.

    The fallback wins if the aligned grid has fewer than two rows or columns, or if the
    aligned grid yields no equity check while the fallback yields one or has more rows.
    ``has_checks``: table_id, which ('aligned' / 'fallback').
    """
    size = lambda df, n: df.groupBy("table_id").agg(
        (F.max("row_idx") + 1).alias(f"{n}_rows"), (F.max("col_idx") + 1).alias(f"{n}_cols")
    )
    checks = has_checks.groupBy("table_id").agg(
        F.bool_or(F.col("which") == "aligned").alias("a_ok"),
        F.bool_or(F.col("which") == "fallback").alias("f_ok"),
    )
    no = F.lit(False)
    small = (F.coalesce("a_rows", F.lit(0)) < 2) | (F.coalesce("a_cols", F.lit(0)) < 2)
    better = F.coalesce("f_ok", no) | (
        F.coalesce("f_rows", F.lit(0)) > F.coalesce("a_rows", F.lit(0))
    )
    decided = (
        size(aligned, "a").join(size(fallback, "f"), "table_id", "full")
        .join(checks, "table_id", "left")
        .select(
            "table_id",
            F.when(
                F.col("f_rows").isNotNull() & (small | (~F.coalesce("a_ok", no) & better)), "fallback"
            ).otherwise("aligned").alias("source"),
        )
    )
    both = aligned.select("table_id", "row_idx", "col_idx", "text", F.lit("aligned").alias("source"))
    both = both.unionByName(
        fallback.select("table_id", "row_idx", "col_idx", "text", F.lit("fallback").alias("source"))
    )
    return both.join(decided, ["table_id", "source"], "left_semi")
