"""Canonical schemas (DDL strings, usable wherever Spark takes a schema)."""

CELLS = "table_id STRING, row_idx INT, col_idx INT, text STRING"

OCR_BOXES = (
    "table_id STRING, box_id INT, text STRING, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, "
    "y2 DOUBLE, confidence DOUBLE"
)

STRUCT_ELEMENTS = (
    "table_id STRING, kind STRING, idx INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, "
    "y2 DOUBLE, score DOUBLE"
)

PUBTABNET = (
    "filename STRING, split STRING, html STRUCT<structure: STRUCT<tokens: ARRAY<STRING>>, "
    "cells: ARRAY<STRUCT<tokens: ARRAY<STRING>, bbox: ARRAY<DOUBLE>>>>"
)

VOC = (
    "filename STRING, size STRUCT<width: INT, height: INT>, "
    "object ARRAY<STRUCT<name: STRING, bndbox: STRUCT<xmin: DOUBLE, ymin: DOUBLE, "
    "xmax: DOUBLE, ymax: DOUBLE>>>, _corrupt_record STRING"
)

COCO = (
    "images ARRAY<STRUCT<id: BIGINT, file_name: STRING, width: INT, height: INT>>, "
    "annotations ARRAY<STRUCT<image_id: BIGINT, category_id: INT, bbox: ARRAY<DOUBLE>, "
    "area: DOUBLE>>, categories ARRAY<STRUCT<id: INT, name: STRING>>"
)

WORDS = "ARRAY<STRUCT<text: STRING, bbox: ARRAY<DOUBLE>>>"

SYNFINTABS = (
    "id STRING, theme INT, "
    "rows ARRAY<STRUCT<cells: ARRAY<STRUCT<text: STRING, label: STRING>>>>, "
    "questions ARRAY<STRUCT<id: STRING, question: STRING, answer: STRING, "
    "answer_keys: STRUCT<row: STRING, col: STRING>>>, "
    "ocr_results STRUCT<words: ARRAY<STRING>>"
)

# Both ground-truth dialects in one schema: fields a file lacks read as null.
GROUND_TRUTH = (
    "image STRING, image_name STRING, description STRING, document_type STRING, "
    "currency STRING, "
    "cells ARRAY<STRUCT<row: INT, col: INT, text: STRING, semantic_type: STRING, "
    "type: STRING, numeric_value: DOUBLE, value: DOUBLE>>, "
    "qa_pairs ARRAY<STRUCT<id: STRING, question: STRING, answer: STRING, "
    "answer_value: DOUBLE, row_key: STRING, col_key: STRING>>, "
    "validation_rules ARRAY<STRUCT<id: STRING, type: STRING, rule: STRING, "
    "description: STRING, formula: STRING>>"
)
