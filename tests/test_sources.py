"""Readers and writers on small files of each format."""

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import lookup, teds
from tallygrid.sources import annotations as A
from tallygrid.sources import sinks, tables
from tallygrid.streaming import ingest


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pubtabnet(spark, tmp_path):
    line = {
        "filename": "a.png", "split": "val",
        "html": {
            "structure": {"tokens": ["<tr>", "<td>", "</td>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "<tr>", "<td>", "</td>", "</tr>"]},
            "cells": [
                {"tokens": ["<b>", "N", "o", "</b>"], "bbox": [1, 2, 3, 4]},
                {"tokens": ["7"], "bbox": [5, 6, 7, 8]},
                {"tokens": ["x"]},
            ],
        },
    }
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps(line) + "\n" + json.dumps({**line, "split": "train"}) + "\n")
    df = A.read_pubtabnet(spark, str(path), "val")
    assert df.count() == 1
    assert _rows(A.cell_texts(df), "cell_id", "text", "x1") == [(0, "No", 1.0), (1, "7", 5.0)]
    assert A.token_html(df).first().html == (
        '<table><tr><td><b>No</b></td><td colspan="2">7</td></tr><tr><td>x</td></tr></table>'
    )
    assert "<td7</td>" in A.token_html(df, compat=True).first().html
    assert _rows(A.token_grid(df), "row_idx", "col_idx", "text") == [
        (0, 0, "<b> N o </b>"), (0, 1, "7"), (1, 0, "x"), (1, 1, ""),
    ]


def test_token_grid_leaves_out_rows_without_cells(spark):
    tokens = ["<tr>", "</tr>", "<tr>", "<td>", "</td>", "<td>", "</td>", "</tr>", "<tr>", "<td", ">", "</td>", "</tr>", "<tr>", "<td>"]
    rows = [
        ("a", {"structure": {"tokens": tokens}, "cells": [{"tokens": ["x"]}, {"tokens": []}, {"tokens": ["<i>", "y"]}, {"tokens": ["z"]}]}),
        ("short", {"structure": {"tokens": tokens}, "cells": [{"tokens": ["x"]}]}),
        ("none", {"structure": {"tokens": []}, "cells": []}),
    ]
    kind = "filename string, html struct<structure: struct<tokens: array<string>>, cells: array<struct<tokens: array<string>, bbox: array<double>>>>"
    df = spark.createDataFrame([(f, {**h, "cells": [{**c, "bbox": None} for c in h["cells"]]}) for f, h in rows], kind)
    assert _rows(A.token_grid(df), "filename", "row_idx", "col_idx", "text") == [
        ("a", 0, 0, "x"), ("a", 0, 1, ""), ("a", 1, 0, "<i> y"), ("a", 1, 1, ""), ("short", 0, 0, "x"),
    ]
    html = dict(_rows(A.token_html(df), "filename", "html"))
    assert html["none"] == "<table></table>"
    assert html["a"] == "<table><tr></tr><tr><td>x</td><td></td></tr><tr><td><i>y</td></tr><tr><td>z</table>"


def test_voc_and_files(spark, tmp_path):
    one = (
        "<annotation><filename>a.jpg</filename><size><width>9</width><height>8</height></size>"
        "<object><name>table row</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"
    )
    (tmp_path / "a.xml").write_text(one)
    (tmp_path / "b.xml").write_text("<annotation><filename>b.jpg</filename><size>")
    (tmp_path / "a.jpg").write_bytes(b"x")
    voc = A.read_voc(spark, str(tmp_path / "*.xml"))
    assert _rows(A.structure_elements(voc), "filename", "kind", "x1") == [("a.jpg", "rows", 1.0)]
    files = tables.list_files(spark, str(tmp_path), "jpg")
    samples = spark.createDataFrame([("a.jpg",), ("c.jpg",)], "filename STRING")
    assert _rows(tables.with_existing_file(samples, files), "filename") == [("a.jpg",)]


def test_coco(spark, tmp_path):
    coco = {
        "images": [{"id": 1, "file_name": "p.png", "width": 10, "height": 20}, {"id": 2, "file_name": "q.png", "width": 1, "height": 1}],
        "annotations": [
            {"image_id": 1, "category_id": 9, "bbox": [1, 2, 3, 4], "area": 12},
            {"image_id": 1, "category_id": 10, "bbox": [0, 0, 1, 1], "area": 1},
        ],
        "categories": [{"id": 9, "name": "Table"}, {"id": 10, "name": "Text"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(coco))
    boxes = A.coco_table_boxes(A.read_coco(spark, str(tmp_path / "c.json")))
    assert _rows(boxes, "file_name", "category", "x2", "y2") == [("p.png", "Table", 4.0, 6.0)]


def test_words(spark, tmp_path):
    (tmp_path / "a_words.json").write_text(json.dumps([{"text": "hi", "bbox": [0, 0, 1, 1]}, {"text": " ", "bbox": []}, {"text": "you", "bbox": []}]))
    (tmp_path / "b_words.json").write_text(json.dumps({"value": [{"text": "other", "bbox": [0, 0, 1, 1]}]}))
    words = A.read_words(spark, str(tmp_path / "*.json"))
    assert _rows(A.page_text(words), "stem", "text") == [("a", "hi you"), ("b", "other")]


def test_ground_truth_dialects(spark, tmp_path):
    a = {"image": "a.png", "cells": [{"row": 1, "col": 0, "text": "Cash", "semantic_type": "row_header", "numeric_value": None}], "validation_rules": [{"type": "sum", "description": "d", "formula": "f"}]}
    b = {"image_name": "b.png", "cells": [{"row": 2, "col": 1, "text": "5", "type": "data", "value": 5.0}], "qa_pairs": [{"id": "q1", "question": "?", "answer": "5", "answer_value": 5.0, "row_key": "r", "col_key": "c"}]}
    for n, d in (("a", a), ("b", b)):
        (tmp_path / f"{n}.json").write_text(json.dumps(d))
    gt = A.read_ground_truth(spark, str(tmp_path))
    assert _rows(A.ground_truth_cells(gt), "table_id", "label") == [("a.png", "row_header"), ("b.png", "data")]
    assert _rows(A.ground_truth_questions(gt), "question_id", "row_key") == [("q1", "r")]
    assert _rows(A.ground_truth_rules(gt), "rule") == [("sum",)]


def test_parquet_datasets(spark, tmp_path):
    spark.sql("SELECT 'a' AS filename, struct(X'00' AS bytes) AS image, CAST(null AS STRING) AS html, array('<table>', '</table>') AS html_restored UNION ALL SELECT 'b', null, 'x', null").write.parquet(str(tmp_path / "test-0.parquet"))
    assert _rows(tables.read_otsl(spark, str(tmp_path)), "filename", "html") == [("a", "<table></table>")]
    spark.sql("""SELECT 't' AS id, 1 AS theme, array(named_struct('cells', array(named_struct('text', 'A', 'label', 'x'), named_struct('text', '1', 'label', 'data')))) AS rows,
      array(named_struct('id', 'q', 'question', '?', 'answer', '1', 'answer_keys', named_struct('row', 'A', 'col', 'B'))) AS questions, named_struct('words', array('A')) AS ocr_results""").write.parquet(str(tmp_path / "syn"))
    df = tables.read_synfintabs(spark, str(tmp_path / "syn"))
    assert _rows(tables.synfintabs_cells(df), "row_idx", "col_idx", "text", "first_text", "n_cols") == [(0, 0, "A", "A", 2), (0, 1, "1", "A", 2)]
    assert _rows(tables.synfintabs_questions(df), "row_key", "col_key") == [("A", "B")]


def test_engine_output(spark):
    raw = spark.sql("""SELECT 't' AS table_id, 0 AS box_id, 'x' AS text, array(struct(5D AS x, 6D AS y), struct(9D AS x, 6D AS y), struct(9D AS x, 8D AS y), struct(5D AS x, 8D AS y)) AS polygon, 0.5D AS confidence
      UNION ALL SELECT 't', 1, 'bad', array(), 0.1D""")
    assert _rows(tables.ocr_boxes(raw, 2.0, 1.0), "x1", "y1", "x2", "y2") == [(3.0, 5.0, 7.0, 7.0)]
    cells = spark.sql("SELECT 't' AS table_id, 0 AS seq, ' a ' AS text, CAST(null AS ARRAY<DOUBLE>) AS bbox UNION ALL SELECT 't', 1, ' ', null")
    page = spark.sql("SELECT 't' AS table_id, 0 AS seq, 'b' AS text, array(1D, 2D, 3D, 4D) AS bbox")
    assert _rows(tables.converted_cells(cells, page), "part", "text", "x2", "confidence") == [(0, "a", 100.0, 0.95), (1, "b", 3.0, 0.95)]


def test_trees(spark):
    good = "<table><tr><td>a</td><td> b </td></tr></table>"
    odd = "<table><tr><td>a<td>b</tr></table>"
    df = spark.createDataFrame([(1, good, good), (2, odd, good), (3, "", good)], "table_id INT, pred_html STRING, gt_html STRING")
    scored = {r.table_id: r for r in teds.score_teds(df).collect()}
    assert scored[1].teds == 1.0 and scored[1].teds_struct == 1.0
    assert scored[2].teds < 1.0 and scored[3].teds_struct == pytest.approx(0.25)
    events = teds.event_similarity(df, "pred_html", "gt_html", "s").collect()
    assert {r.table_id: r.s for r in events}[1] == 1.0
    nodes = spark.createDataFrame([(good,)], "h STRING").select(
        teds.built_in_nodes(F.col("h")).alias("a"), teds.parsed_nodes(F.col("h")).alias("b")
    ).first()
    assert nodes.a == nodes.b


def test_similarity_lookup(spark):
    labels = spark.createDataFrame([(1, 0, ""), (1, 1, "Cash and banks"), (1, 2, "Cash and bank"), (1, 3, "Trade debtors")], "table_id INT, row_idx INT, label STRING")
    keys = spark.createDataFrame([(1, "cash and bank"), (1, "trade debitors"), (1, "zzzz")], "table_id INT, row_key STRING")
    got = {r.row_key: r.idx for r in lookup.best_similar(keys, labels, "row_key").collect()}
    assert got == {"cash and bank": 2, "trade debitors": 3}


def test_similarity_without_floor(spark):
    names = ["Cash and bank", "Trade debtors", "Cash", "abab", "baba", "cdcd xyw", "Zq", "Total equity and liabilities"]
    wanted = ["trade", "ab", "bbaa", "cash at banks", "qz", "dcxw", "equity", "liable", "####", "total cash", "abad", "zz"]
    rows = [(t, i, x) for t in (1, 2) for i, x in enumerate(names[t - 1 :])]
    labels = spark.createDataFrame(rows, "table_id INT, row_idx INT, label STRING")
    keys = spark.createDataFrame([(t, k) for t in (1, 2) for k in wanted], "table_id INT, row_key STRING")

    def plain(floor, boost):
        for t, k in [(t, k) for t in (1, 2) for k in wanted]:
            best = (floor, None)
            for _, i, x in (r for r in rows if r[0] == t):
                score = SequenceMatcher(None, k, x.lower()).ratio()
                if boost and (k in x.lower() or x.lower() in k):
                    score = max(score, boost)
                best = (score, i) if score > best[0] else best
            if best[1] is not None:
                yield t, k, best[1], round(best[0], 9)

    for floor, boost, options in [(0, 0.9, {"floor": None}), (0, None, {"floor": None}), (0.5, None, {"strict": True})]:
        got = lookup.best_similar(keys, labels, "row_key", boost=boost, **options).collect()
        assert sorted((*r[:3], round(r.score, 9)) for r in got) == sorted(plain(floor, boost))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456)], "name STRING, v DOUBLE")
    sinks.write_samples_csv(df, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).first().v == "0.1235"
    sinks.write_summary(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    conf = spark.createDataFrame([("b", 1, 2), ("a", 0, 3)], "gt STRING, position INT, x INT")
    sinks.write_confusion_csv(conf, str(tmp_path / "c"))
    assert [r.gt for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["a", "b"]
    assert sinks.manifest(df, "name").first().n_samples == 1


def test_streaming_profile(spark, tmp_path):
    src, ck = tmp_path / "in", tmp_path / "ck"
    src.mkdir()
    cell = lambda i, t: json.dumps({"table_id": "t", "row_idx": i, "col_idx": 0, "text": t})
    (src / "1.json").write_text(cell(0, "1,234") + "\n" + cell(1, "Cash") + "\nnot json\n")
    profile = ingest.running_profile(ingest.read_cells(spark, str(src)))
    ingest.start_profile(profile, "profile_now", str(ck)).awaitTermination(120)
    got = {(r.status, r.cell_type): r.cells for r in spark.table("profile_now").collect()}
    assert got == {("ok", "numeric"): 1, ("ok", "header"): 1, ("failed", "none"): 1}
    ingest.append_cells(ingest.read_cells(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
