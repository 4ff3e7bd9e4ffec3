"""A training corpus in five stages: toxicity, near-duplicates, benchmark decontamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of documents. run() writes each stage's result as Parquet in the shared folder and
rereads it as the next one's docs.

Rows may repeat an id. Toxicity and decontamination drop all rows of an id that has a rejected row; of rows with
the same id and text the near-duplicate stage keeps one; mixing repeats rows on purpose, and token output writes each.

Near-duplicates share 80 percent or more of their shingles of five words. 40 bands of 6 miss a link at exactly 0.8 with
probability 5e-6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.llm.decontaminate import find_contamination
from stridemap.llm.mixing import mix, mixed_documents
from stridemap.llm.near_dedup import near_duplicates
from stridemap.llm.queries import VOCABULARY
from stridemap.llm.token_output import read_shards, write_shards
from stridemap.llm.toxicity import toxicity
from stridemap.session import discard, materialize, read, scratch


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents but those whose id is in rejected; null is an id."""
    ids = rejected.select(F.col("doc_id").alias("id")).distinct()
    rows = docs.alias("own")
    return rows.join(ids.alias("out"), F.col("own.doc_id").eqNullSafe(F.col("out.id")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = toxicity(docs, read(spark, sf_dir, "labels"))
    return _without(docs, found.where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs, k=5, percent=80, bands=40)
    kept = _without(docs, found.where("doc_id is not null and doc_id <> component_id"))
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    again = materialize(again.select("doc_id"), "repeated")
    if again.limit(1).count() == 0:
        return kept
    # the columns of documents lie in a struct, so that no name clashes
    repeated = kept.join(again, "doc_id", "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("mark"))
    once = repeated.dropDuplicates(["doc_id", "mark"]).select("row.*")
    return _without(kept, again).unionByName(once.select(*(F.col(f"`{c}`") for c in docs.columns)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The classifier, MinHash and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as tables:  # what the stage writes on its way goes when its result is written
            result = materialize(stage(spark, docs, sf_dir), name)
            tables.keep(result)
        discard(docs)
        docs = result
    return docs
