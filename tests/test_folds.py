"""Order-dependent operators against brute force, also with tables cut into tiny chunks."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import tallygrid.partitioning as partitioning
from tallygrid.operators import align, classify, lookup, matching, score, validate


@pytest.fixture(params=[16, 2])
def chunk_bits(request, monkeypatch):
    """Small chunks make every table span several, as a very long one would."""
    monkeypatch.setattr(partitioning, "CHUNK_BITS", request.param)
    return request.param


def brute_classes(labels, grid):
    """Row classes with implicit subtotals, one table, plain loops."""
    base = []
    n = len(labels)
    for i, label in enumerate(labels):
        has = any(v is not None for v in grid[i])
        low = label.lower().strip()
        if not label and not has:
            base.append("empty")
        elif i < 2:
            base.append("header")
        elif "total assets" in low:
            base.append("total")
        elif "subtotal" in low:
            base.append("subtotal")
        elif not label and i > n * 0.85:
            base.append("subtotal")
        else:
            base.append("data")
    for i in range(n):
        if base[i] != "data" or labels[i].strip():
            continue
        start = max([j + 1 for j in range(i) if base[j] in ("subtotal", "total")], default=0)
        for c in range(len(grid[i])):
            v = grid[i][c]
            parts = [grid[j][c] for j in range(start, i) if base[j] == "data" and grid[j][c] is not None]
            if v and len(parts) >= 2 and abs(sum(parts) - v) <= 0.01 * abs(v):
                base[i] = "subtotal"
                break
    return base


def test_implicit_subtotals(spark, chunk_bits):
    rng = random.Random(7)
    rows, want = [], {}
    for t in range(6):
        labels, grid, run = ["", ""], [[None] * 3, [None] * 3], [0, 0]
        for _ in range(rng.randint(15, 40)):
            if rng.random() < 0.3 and run[0]:
                labels.append("")
                grid.append([None, float(run[0]), float(run[1] if rng.random() < 0.8 else 3)])
                run = [0, 0] if rng.random() < 0.8 else run
            elif rng.random() < 0.1:
                labels.append("Subtotal")
                grid.append([None, 5.0, 6.0])
                run = [0, 0]
            else:
                a, b = rng.randint(50, 900), rng.randint(50, 900)
                labels.append(f"item {len(labels)}")
                grid.append([None, float(a), float(b)])
                run = [run[0] + a, run[1] + b]
        labels.append("Total assets")
        grid.append([None, 1.0, 2.0])
        want[t] = brute_classes(labels, grid)
        for i, label in enumerate(labels):
            for c in range(3):
                rows.append((t, i, c, label if c == 0 else "x", grid[i][c]))
    values = spark.createDataFrame(rows, "table_id INT, row_idx INT, col_idx INT, text STRING, value DOUBLE")
    got = classify.classify_rows(values).orderBy("table_id", "row_idx").collect()
    for t, classes in want.items():
        assert [r.row_class for r in got if r.table_id == t] == classes


def test_sections_of_chunked_tables_agree(spark, monkeypatch):
    rows = []
    for t in range(3):
        for i in range(23):
            label = "Total assets" if i % 9 == 8 else "Subtotal" if i % 5 == 4 else f"item {i}"
            rows += [(t, i, 0, label, None), (t, i, 1, "1", float(i + t))]
    values = spark.createDataFrame(rows, "table_id INT, row_idx INT, col_idx INT, text STRING, value DOUBLE")
    key = ["table_id", "row_type", "total_row_index", "expected", "actual", "num_components"]
    whole = sorted(map(tuple, validate.column_sum_checks(values).select(*key).collect()))
    monkeypatch.setattr(partitioning, "CHUNK_BITS", 2)
    assert sorted(map(tuple, validate.column_sum_checks(values).select(*key).collect())) == whole
    assert whole


def brute_greedy(pairs, order):
    rank = (lambda p: (-p[3], p[1], p[2])) if order == "iou" else (lambda p: (p[1], -p[3], p[2]))
    used_p, used_g, out = set(), set(), []
    for img, p, g, v in sorted(pairs, key=lambda x: (x[0], *rank(x))):
        if (img, p) not in used_p and (img, g) not in used_g:
            used_p.add((img, p))
            used_g.add((img, g))
            out.append((img, p, g))
    return sorted(out)


@pytest.mark.parametrize("order", ["iou", "prediction"])
def test_greedy_match(spark, order):
    rng = random.Random(3)
    pairs = [
        (i, p, g, round(rng.uniform(0.5, 1.0), 1))
        for i in range(4) for p in range(12) for g in range(12) if rng.random() < 0.3
    ]
    df = spark.createDataFrame(pairs, "image_id INT, p INT, g INT, iou DOUBLE")
    got = sorted((r.image_id, r.p, r.g) for r in matching.greedy_match(df, order).collect())
    assert got == brute_greedy(pairs, order)


def test_greedy_match_in_clusters(spark):
    """Boxes in two rows of clusters, with their extents: the same pairs as over the image."""
    rng = random.Random(4)
    boxes = lambda n: [
        (i, k, x, y, x + rng.uniform(20, 60), y + rng.uniform(20, 40))
        for i in range(3) for k in range(n)
        for x, y in [(rng.choice([0, 30, 5000, 9000]) + rng.uniform(0, 40), rng.choice([0, 300]) + rng.uniform(0, 20))]
    ]
    kind = "image_id INT, idx INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    pred, gt = (spark.createDataFrame(boxes(60), kind) for _ in range(2))
    pairs = matching.candidate_pairs(pred, gt, 0.2)
    flat = [(r.image_id, r.p, r.g, r.iou) for r in pairs.collect()]
    assert len(flat) > 100
    for order in ("iou", "prediction"):
        got = sorted((r.image_id, r.p, r.g) for r in matching.greedy_match(pairs, order).collect())
        assert got == brute_greedy(flat, order)
    x = matching.swept(pairs, ["image_id"], "x_lo", "x_hi", "run")
    assert x.select("image_id", "run").distinct().count() >= 6


def test_greedy_match_of_long_preferences(spark):
    """Every box prefers the same partner, so pairs are settled one after another."""
    n = 2000
    pairs = spark.range(2 * n).selectExpr(
        "1 as image_id", "cast(id % 2000 as int) as p", "cast(if(id < 2000, 0, 1 + id % 1999) as int) as g",
        "if(id < 2000, 0.9, 0.6) - id % 2000 / 10000.0D as iou",
    ).distinct()
    flat = [(r.image_id, r.p, r.g, r.iou) for r in pairs.collect()]
    for order in ("iou", "prediction"):
        got = sorted((r.image_id, r.p, r.g) for r in matching.greedy_match(pairs, order).collect())
        assert got == brute_greedy(flat, order)


def test_folds_over_one_long_stretch(spark):
    """200,000 positions without a gap, in a table whose id is a string."""
    boxes = spark.range(200_000).selectExpr(
        "'t' as table_id", "cast(id as int) as box_id", "0.0D as x1", "id * 1.5 as y1", "1.0D as x2", "id * 1.5 + 1 as y2",
    ).withColumn("text", F.lit("1"))
    boxes = boxes.withColumns({c: F.col(c).cast("double") for c in ("y1", "y2")})
    last = align.rows_by_anchor(boxes, 20.0).agg(F.max("row_idx"), F.count("*"), F.max("row_y")).first()
    assert (last[0], last[1]) == (200_000 // 14, 200_000)
    fit = align.rows_by_first_fit(boxes, 25.0).agg(F.max("row_idx"), F.count("*")).first()
    assert tuple(fit) == (200_000 // 17, 200_000)
    centres = align.column_centres(boxes.select("table_id", F.col("y1").alias("pos")), 40.0)
    assert centres.agg(F.count("*"), F.max("idx")).first()[0] >= 1 and centres.schema["table_id"].dataType.simpleString() == "string"


def test_component_lists(spark, monkeypatch):
    """Which rows make up subtotals, totals and grand totals; in chunks of four rows too."""
    labels = ["", "", "ASSETS", "a", "", "c", "Total current assets", "d", "Total non-current assets", "Total assets", "e", "f", "Total liabilities"]
    nums = [None, None, None, 1.0, 2.0, 3.0, 6.0, 4.0, 4.0, 10.0, 5.0, 6.0, 11.0]
    classes = ["empty", "empty", "section_header", "data", "data", "data", "subtotal", "data", "subtotal", "total", "data", "data", "total"]
    values = spark.createDataFrame(
        [(1, i, c, t if c == 0 else "", None if c == 0 or c == 2 and i == 6 else v) for i, (t, v) in enumerate(zip(labels, nums, strict=True)) for c in range(3)],
        "table_id INT, row_idx INT, col_idx INT, text STRING, value DOUBLE",
    )

    def found():
        rows = classify.classify_rows(values, implicit_subtotals=False).drop("row_class").join(
            spark.createDataFrame(list(enumerate(classes)), "row_idx INT, row_class STRING"), "row_idx"
        )
        lists = collections.defaultdict(list)
        for r in sorted(validate.component_lists(values, rows).collect(), key=lambda r: r.part):
            lists[r.row_type, r.total_row_index, r.column] += r.component_rows
        checks = {(r.row_type, r.total_row_index, r.column): (r.first_component, r.last_component) for r in validate.column_sum_checks(values, rows).collect()}
        return lists, checks

    want = {
        ("subtotal", 6, None): ["a", "Row 4", "c"], ("subtotal", 8, None): ["d"], ("total", 12, None): ["e", "f"],
        ("grand_total", 9, 1): ["Total current assets", "Total non-current assets"],
        ("grand_total", 9, 2): ["Total non-current assets"],
    }
    lists, checks = found()
    assert lists == want
    assert checks["subtotal", 6, 1] == (3, 5) and checks["grand_total", 9, 1] == (6, 8)
    # column 2 lacks one subtotal's amount: still two subtotals above the total
    assert checks["grand_total", 9, 2] == (8, 8) and checks["total", 12, 1] == (10, 11)
    monkeypatch.setattr(partitioning, "CHUNK_BITS", 2)
    assert found() == (want, checks)


def test_first_hits(spark):
    """The first row by any test wins, over three kinds of test and blank cells."""
    cells = spark.createDataFrame(
        [(1, i, c, t) for i, row in enumerate([["Head", "2024"], ["Trade receivable", "7"], ["x", "see deposits"], ["Deposits", "9"], ["", "1"]]) for c, t in enumerate(row)],
        "table_id INT, row_idx INT, col_idx INT, text STRING",
    )
    keys = ["trade recievable", "deposits", "1", "nothing like it", "Deposits placed", "head"]
    df = spark.createDataFrame([(1, k) for k in keys], "table_id INT, row_key STRING")
    got = {r.row_key: r.row_idx for r in lookup.first_row_hits(df, cells, blank_hits=False).collect()}
    assert got == {"trade recievable": 1, "deposits": 2, "1": 4, "Deposits placed": 3, "head": 0}
    blank = {r.row_key: r.row_idx for r in lookup.first_row_hits(df, cells).collect()}
    assert blank == {**got, "nothing like it": 4}
    cols = spark.createDataFrame([(1, "2024 RM"), (1, "trade receivables"), (1, "deposits")], "table_id INT, col_key STRING")
    found = {r.col_key: r.col_idx for r in lookup.first_column_hits(cols, cells, blank_hits=False).collect()}
    assert found == {"2024 RM": 1, "trade receivables": 0, "deposits": 1}


def _boxes(spark, seed, n=60, tables=3):
    rng = random.Random(seed)
    rows = []
    for t in range(tables):
        for b in range(n):
            x, y = rng.uniform(0, 600), rng.uniform(0, 900)
            text = str(rng.randint(1, 99)) if rng.random() < 0.5 else f"w{b}"
            rows.append((t, b, text, x, y, x + rng.uniform(10, 90), y + rng.uniform(8, 14), 0.9))
    schema = "table_id INT, box_id INT, text STRING, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, confidence DOUBLE"
    return rows, spark.createDataFrame(rows, schema)


def test_rows_by_anchor_and_first_fit(spark):
    rows, boxes = _boxes(spark, 5)
    anchor = {(r.table_id, r.box_id): r.row_idx for r in align.rows_by_anchor(boxes, 20.0).collect()}
    fit = {(r.table_id, r.box_id): r.row_idx for r in align.rows_by_first_fit(boxes, 25.0).collect()}
    for t in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == t]
        mid = lambda r: (r[4] + r[6]) / 2
        idx, start = -1, None
        for r in sorted(mine, key=mid):
            if start is None or abs(mid(r) - start) >= 20:
                idx, start = idx + 1, mid(r)
            assert anchor[t, r[1]] == idx
        bins, home = [], {}
        for r in sorted(mine, key=lambda r: r[1]):
            b = next((b for b in bins if abs(r[4] - b) < 25), None)
            if b is None:
                bins.append(b := r[4])
            home[r[1]] = b
        for r in mine:
            assert fit[t, r[1]] == sorted(bins).index(home[r[1]])


def test_column_centres(spark):
    rng = random.Random(11)
    values = [(t, float(rng.choice([10, 20, 20, 45, 90, 300, 310, 318, 500]))) for t in range(3) for _ in range(30)]
    df = spark.createDataFrame(values, "table_id INT, pos DOUBLE")
    got = align.column_centres(df).orderBy("table_id", "idx").collect()
    for t in range(3):
        centres = []
        for v in sorted(v for k, v in values if k == t):
            if not centres or abs(v - centres[-1]) > 40:
                centres.append(v)
            else:
                centres[-1] = (centres[-1] + v) / 2
        assert [r.pos for r in got if r.table_id == t] == pytest.approx(centres)


def test_grid_from_boxes_keeps_every_text(spark):
    rows, boxes = _boxes(spark, 9, n=40, tables=2)
    cells = align.grid_from_boxes(boxes).collect()
    for t in range(2):
        words = sorted(w for r in cells if r.table_id == t for w in r.text.split())
        assert words == sorted(r[2] for r in rows if r[0] == t)


def test_nearest_prefers_lower_index(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 700.0), (1, 40.0)], "table_id INT, pos DOUBLE")
    sites = spark.createDataFrame([(1, 0.0, 1), (1, 10.0, 0), (1, 1000.0, 2)], "table_id INT, pos DOUBLE, idx INT")
    got = {r.pos: r.nearest_idx for r in align.nearest(points, sites).collect()}
    assert got == {5.0: 0, 40.0: 0, 700.0: 2}


def test_exact_median(spark):
    rng = random.Random(2)
    data = [(k, rng.choice([0.1, 0.25, rng.random()])) for k in "ab" for _ in range(101 if k == "a" else 60)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE")
    import statistics

    got = {r.k: r["median"] for r in score.exact_median(df, "v", ["k"]).collect()}
    for k in "ab":
        assert got[k] == pytest.approx(statistics.median(v for kk, v in data if kk == k))


def test_running_sums_across_chunks(spark):
    df = spark.range(50).select(F.lit(1).alias("table_id"), F.col("id").cast("int").alias("row_idx")).withColumn(
        "row_chunk", F.shiftright("row_idx", 3)
    )
    out = partitioning.running_sums(df, {"s": F.col("row_idx")}).orderBy("row_idx").collect()
    assert [r.s for r in out] == [i * (i + 1) // 2 for i in range(50)]
