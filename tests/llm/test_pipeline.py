"""The pipeline on a small table: each stage against what it should leave."""

import corpus_pipeline
from tallygrid.llm import decontaminate, jaccard, mixture, quality
from tests.llm.fixtures import documents


def test_stages(spark, tmp_path):
    docs = documents(spark)
    leak = docs.where("doc_id = 1").first().text
    bench = [(1, " ".join(leak.split()[:14]))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
        sizes.append((frame, after))
        frame = after
    assert sizes[0][1].count() == quality.score(docs).where("kept").count()
    again = jaccard.jaccard_classes(sizes[1][1], 5, 80)
    assert again.count() == again.select("component").distinct().count() == sizes[1][1].count()
    assert decontaminate.leaks(sizes[1][1], spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 1
    assert sizes[2][1].count() == sizes[1][1].count() - 1 and not sizes[2][1].where("doc_id = 1").count()
    copies = mixture.mix(sizes[2][1]).agg({"copies": "sum"}).first()[0]
    assert sizes[3][1].count() == copies == sizes[4][1].count()
    assert {"shard", "slot"} < set(frame.columns)


def test_run_and_empty(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
