"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import decontaminate, jaccard, katz, language, line_dedup, main_text, mixture, oracles, phrases, quality, runs, sharding, token_files, warc_zip
from tallygrid.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query(oracles.QUALITY)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


@query(oracles.JACCARD)
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard.jaccard_classes(table(spark, sf_dir, "documents"), width=4, percent=85)
    return classes.select("doc_id", "n_shingles", "component_id")


@query()
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("tiles").withColumn("contaminated", found.coverage >= decontaminate.MIN_COVERAGE)


@query(oracles.MIXTURE)
def op6_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixture.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_repeats=3)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.sharded(table(spark, sf_dir, "documents"), shards=16)
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(sharding.LAW).alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), order=3)


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query(oracles.WARC)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zip.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(table(spark, sf_dir, "documents"))


@query(oracles.LINES)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.per_document(table(spark, sf_dir, "documents"))


@query(oracles.PHRASES)
def op11_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top(phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5), 2000)


@query(oracles.RUNS)
def op12_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(with_repeated_ends(table(spark, sf_dir, "documents"))))


@query()
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def with_repeated_ends(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the texts of one document in ten end in a repeated stretch, whose
    place and period follow from the CRC-32 of the decimal doc_id (null: text unchanged)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(chosen, split).alias("words"))
    sized = words.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr(
        "array_join(transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')"
    )
    return cut.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))
