"""What the queries' plans move: read off before anything runs."""

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def plan(spark, name):
    return __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_no_side_is_broadcast_for_the_size_of_its_file(spark):
    assert "Broadcast" not in plan(spark, "aligned_grid_iou")


def test_cells_are_not_dealt_again(spark):
    # the last exchange deals items by table, and that of orders meets it
    for name in ("grid_html", "grid_accuracy"):
        text = plan(spark, name)
        above = text[: text.index("Generate")]
        assert "Exchange" not in above, name


def test_shares_of_orders_are_exact(spark, tmp_path):
    # 0.38 + 3 * 0.01 in doubles lies above 0.41, which rounds this liability up
    orders = spark.createDataFrame([(4106023, 300650.0)], "o_orderkey long, o_totalprice double")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    (row,) = __spark_entry__.queries()["rule_checks"](spark, str(tmp_path)).collect()
    assert row.percent_actual == 0.409998


def test_values_are_stored_dealt(spark):
    # values and rows read back from the stored tables meet without an exchange
    assert "Exchange" not in plan(spark, "keyword_sum_checks")


def test_plain_amounts_read_like_any_other(spark):
    from pyspark.sql import functions as F

    from tallygrid.operators.normalize import normalize_texts

    texts = ["1,234", "(1,234)", "(7)", "2019", "1999", "000", "1,000", "12,", "(1,2", "1)", ",5", "-5", "", " 8 ", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("ds", F.lit(1000).cast("bigint"))
    got = {r.text: (r.cell_type, r.is_negative, r.value) for r in normalize_texts(df, default_scale="ds").collect()}
    assert got["1,234"] == ("numeric", False, 1234000.0) and got["(1,234)"] == ("numeric", True, -1234000.0)
    assert got["(7)"] == ("numeric", True, -7000.0) and got["2019"] == got["1999"] == ("year", False, None)
    assert got["000"] == ("numeric", False, 0.0) and got["1,000"] == ("numeric", False, 1000000.0)
    assert got["12,"] == ("numeric", False, 12000.0) and got["(1,2"] == ("numeric", False, 12000.0)
    assert got["1)"] == ("numeric", False, 1000.0) and got[",5"] == ("numeric", False, 5000.0)
    assert got["-5"] == ("numeric", True, -5000.0) and got[" 8 "] == ("numeric", False, 8000.0)
    assert got[""] == got[None] == ("empty", False, None)


def test_texts_of_one_file_are_dealt(spark, tmp_path):
    from tallygrid.plans import inputs

    docs = spark.range(2 * inputs.PART_DOCUMENTS + 1).selectExpr("id AS doc_id", "'s' AS source", "'One. Two.' AS text")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    pairs = inputs.text_pairs(spark, str(tmp_path))
    assert pairs.rdd.getNumPartitions() == 3 and pairs.count() == 3 * docs.count()


def test_distances_are_derived_once_and_words_not_at_all(spark):
    for name in ("error_histogram", "character_errors", "engine_error_table", "error_distribution"):
        text = plan(spark, name)
        assert text.count("levenshtein(") <= 1 and "gt_words" not in text, name


def test_histogram_leaves_missing_values_out(spark):
    from tallygrid.operators import score

    df = spark.createDataFrame([("a", 0.1), ("a", None), ("b", None), ("b", 2.0)], "k string, v double")
    got = {(r.k, r.bin, r.n) for r in score.histogram(df, "v", 2, by=["k"]).collect()}
    assert got == {("a", 0, 1), ("b", 1, 1)}


def test_sets_of_cells_meet_where_they_are(spark):
    # only items, orders and the counts of tables are exchanged, not cells
    for name in ("cell_f1_positions", "cell_f1_with_text"):
        text = plan(spark, name)
        join = text[text.index("SortMergeJoin") :]
        assert "FullOuter" in join.splitlines()[0], name
        assert "Exchange" not in join[: join.index("Generate")], name


def test_missing_texts_are_equal(spark):
    from tallygrid.operators import score

    kind = "table_id long, row_idx int, col_idx int, text string"
    pred = spark.createDataFrame([(1, 0, 0, None), (1, 0, 0, ""), (1, 0, 1, "A"), (1, 0, 1, "a ")], kind)
    gt = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, "a"), (2, 0, 0, "b")], kind)
    got = {r.table_id: (r.tp, r.fp, r.fn) for r in score.cell_f1(pred, gt).collect()}
    assert got == {1: (2, 1, 0), 2: (0, 0, 1)}


def test_samples_are_measured_where_cells_lie(spark):
    # only the totals by backend are exchanged above the union, nothing from it down to the cells
    text = plan(spark, "pipeline_summary")
    above, union = text[: text.index("Union")], text[text.index("Union") :]
    assert above.count("Exchange") == 1 and "Exchange" not in union[: union.index("Generate")]


def test_boxes_are_not_dealt_again(spark):
    # heights and rows are derived from boxes stored by table
    assert "Exchange" not in plan(spark, "rows_by_gap")


def test_runs_go_on_across_chunks_of_values(spark):
    from pyspark.sql import functions as F

    from tallygrid.operators import align

    places = [0, 5, 4090, 4095, 4097, 4110, 12000, 12288, 12290, 50000]
    df = spark.createDataFrame([(k, float(p) + k) for k in (1, 2) for p in places], "table_id long, p double")
    got = align.value_runs(df, "p", F.col("p") - F.col("prev") > 10)
    runs = [0, 0, 1, 1, 1, 2, 3, 4, 4, 5]
    want = {(k, float(p) + k, r) for k in (1, 2) for p, r in zip(places, runs, strict=True)}
    assert {(r.table_id, r.p, r.run) for r in got.collect()} == want


def test_labels_of_one_file_are_dealt(spark, tmp_path):
    from tallygrid.plans import inputs

    part = spark.range(2 * inputs.PART_LABELS + 1).selectExpr("id AS p_partkey", "'a b' AS p_name", "'c d' AS p_type")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    labels = inputs.noisy_labels(spark, str(tmp_path))
    assert labels.rdd.getNumPartitions() == 3 and labels.count() == part.count()


def test_labels_are_repaired_once(spark):
    # not once for each known line item
    assert plan(spark, "financial_labels").count("regexp_replace(") <= 3


def test_closest_line_items(spark):
    from tallygrid.functions import text as T

    texts = ["Deferred tax assets net", "deferred tax", "Sundry", "", None, "net profit", "equivalents and cash cash"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")

    def overlap(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    from pyspark.sql import functions as F

    for text, fixed, got in df.select("text", T.correct_ocr(F.col("text")), T.correct_financial_label(F.col("text"))).collect():
        want = fixed
        if text and fixed.strip().lower() not in T.FINANCIAL_TERMS:
            score, term = min((-overlap(set(fixed.lower().split()), set(t.split())), t) for t in T.FINANCIAL_TERMS)
            want = term.title() if score < -0.7 else fixed
        assert got == want, text


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    from pathlib import Path

    from tallygrid.llm.store import Scratch
    from tallygrid.storage import CLEANUP, stored

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    dirs = [Path(str(d)) for d in env.blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for d in dirs for f in d.rglob("shuffle_*")}
    before = files()
    df = spark.range(1000).selectExpr("id AS table_id").repartition(3, "table_id")
    kept = [Scratch(spark, "test").keep(df, "a"), stored(df), stored(df, 3)]
    assert files() <= before
    assert spark.conf.get(CLEANUP) == "false"
    assert [k.count() for k in kept] == [1000] * 3


def test_questions_and_cells_come_from_rows_derived_once(spark):
    for name in ("first_row_hits", "qa_with_fallback", "lookup_answers"):
        assert "l_extendedprice" not in plan(spark, name), name


def test_a_filter_on_a_score_leaves_copies_unscored(spark):
    from pyspark.sql import functions as F

    from tallygrid.functions.similarity import with_ratio

    pairs = spark.range(8).select(F.lit("abcd").alias("a"), F.concat(F.lit("abc"), F.col("id") % 2).alias("b"))
    close = with_ratio(pairs, "a", "b", "s").where("s >= 0.5")
    text = close._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and close.count() == 8


def test_candidates_of_small_and_large_tables_are_all_that_can_reach_the_floor(spark, monkeypatch):
    from difflib import SequenceMatcher

    from tallygrid.operators import lookup

    keys = ["total assets", "totl aset", "élan vital", "x" * 300, "zz", "net profit", "a b c"]
    labels = ["total assets", "net profits", "élan vitál", "x" * 299 + "y", "zzz", "abc", "profit net"]
    left = spark.createDataFrame([(k, t) for k in (1, None) for t in keys + [""]], "table_id long, k string")
    right = spark.createDataFrame([(1, t) for t in labels], "table_id long, l string")
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    overlap = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    for multiset, score in ((True, ratio), (False, overlap)):
        want = {(k, t) for k in keys for t in labels if score(k, t) >= 0.7}
        for small in (0, 128):
            monkeypatch.setattr(lookup, "_SMALL", small)
            rows = lookup.similar_candidates(left, right, "k", "l", 0.7, multiset).collect()
            got = [(r.k, r.l) for r in rows]
            assert len(got) == len(set(got)) and want <= set(got) and {r.table_id for r in rows} == {1}
            assert len(got) < len(keys) * len(labels)


def test_contained_texts_are_found_among_few_and_many_beginnings(spark, monkeypatch):
    from tallygrid.operators import lookup

    small = spark.createDataFrame([(1, t) for t in ("as", "asset", "é", "net", "")], "table_id long, s string")
    large = spark.createDataFrame([(1, t) for t in ("assets", "élan as", "te", "net net", "")], "table_id long, t string")
    want = {("as", "assets"), ("asset", "assets"), ("as", "élan as"), ("é", "élan as"), ("net", "net net")}
    for few in (0, 64):
        monkeypatch.setattr(lookup, "_FEW", few)
        rows = [(r.s, r.t) for r in lookup.contained(small, large, "s", "t").collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_boxes_and_elements_are_stored_dealt(spark):
    # lines, boxes and cells meet where they lie; nothing is derived a second time
    assert "Exchange" not in plan(spark, "aligned_grid_iou")
    assert "l_extendedprice" not in plan(spark, "merged_cell_texts")
