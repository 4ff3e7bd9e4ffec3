"""The operators of this subpackage over the test tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.llm.decontaminate import find_contamination
from stridemap.llm import line_dedup
from stridemap.llm.mixing import mix
from stridemap.llm.near_dedup import near_duplicates
from stridemap.llm.oracles import ORACLES as ORACLES
from stridemap.llm.quality_classifier import classify
from stridemap.llm.quality_rules import quality
from stridemap.llm.substring_dedup import repeated_spans
from stridemap.llm.token_output import read_shards, write_shards
from stridemap.llm.toxicity import toxicity
from stridemap.llm.url_filter import filter_urls
from stridemap.session import read

#: Name of the vocabulary file of token output; its place is looked up when the query runs.
VOCABULARY = "word_bpe_49k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_recurring_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", F.round("evidence", 6).alias("evidence"), F.round("site_share", 6).alias("site_share"), F.round("score", 6).alias("score"), "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85, bands=24)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number its path ends with; the quality labels of documents are the pages' labels."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    shown = F.expr("try_cast(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*/([0-9]+)', 1), '') AS bigint)")
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("shown")).agg(F.min("quality").alias("quality"))
    rows = pages.select("page_id", "url", shown.alias("shown")).join(known, "shown", "left")
    rows = rows.withColumn("label", F.when(F.col("quality") == 0, "block").when(F.col("quality") == 1, "allow"))
    found = filter_urls(rows, label_col="label", reject_at=0.4)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_token_output": op7_token_output,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
}
