"""Quality classifier: hierarchical empirical Bayes over sites.

A logistic classifier on the statistics of a document and on its words gives its own evidence, the logarithm of a likelihood ratio.
Words are hashed to `word_buckets` numbers. A bucket's log ratio comes from the labelled training documents that have a word of
it, shrunk towards none by `word_weight` documents; a document's word evidence is the mean over its words. The table of buckets has a fixed size, and is broadcast.
Sites form levels: all documents, hosts, paths within hosts. Every group has a posterior share of good documents: labelled training
rows count by label, all others by the classifier's probability, so statistics cover all documents. Shares are beta posteriors whose prior is
the parent's share with the weight m of pseudo-documents; m comes from the spread of shares between the groups of a
level by the method of moments (and is LEAST_WEIGHT or more), so sparse sites shrink to their parent, and at last to the global prior. A document's score is the posterior from
its own evidence and its path's share.

All of that is grouped aggregation with partial sums; only the classifier is fitted on a sample, at most
`sample_rows` labelled rows of one training fold, in order of a hash, which give no counts of words; all other labelled training rows do. Labels of rows with crc32(id as text) mod folds = held_out are never read.

Cases: null and empty texts have zero statistics; null site values are groups of their own; null labels and labels of unknown documents are ignored, of
several the lowest counts; repeated rows have equal scores; without labels of both classes the evidence is 0 and
the score is the site's share; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemap.llm import wordscan
from stridemap.llm.quality_rules import STATS, text_statistics
from stridemap.llm.toxicity import logistic
from stridemap.session import materialize


#: However unlike groups are, a parent's share weighs as much as this number of documents.
LEAST_WEIGHT = 5


def buckets_of(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, first word of each text): lower-cased words as toxicity has them."""
    mapped, starts, ends, first = wordscan.words(*wordscan.utf8(column), wordscan.alnum_table())
    return (wordscan.span_hash(wordscan.prefix_hash(mapped), starts, ends) % np.uint64(buckets)).astype(np.int64), first


def bucket_ratios(rows: DataFrame, buckets: int, weight: float, slice_bytes: int = 2 << 20) -> np.ndarray:
    """The shrunk log ratio of each bucket from labelled rows (text, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordscan.slices(batches, "text", slice_bytes):
            found, first = buckets_of(batch.column("text"), buckets)
            pairs = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(first)) * buckets + found)
            good = batch.column("y").to_numpy(zero_copy_only=False)[pairs // buckets]
            n, k = (np.bincount(pairs % buckets, weights=w, minlength=buckets).astype(np.int64) for w in (np.ones(len(pairs)), good))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(k[some])], names=["bucket", "n", "k"])

    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("k")).first()
    out = np.zeros(buckets)
    if not 0 < total["k"] < total["n"]:
        return out
    share = total["k"] / total["n"]
    found = rows.mapInArrow(count, "bucket bigint, n bigint, k bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).toArrow()
    n, k = (found.column(c).to_numpy().astype(float) for c in "nk")
    out[found.column("bucket").to_numpy()] = np.log((k + weight * share) / (n - k + weight * (1 - share))) - np.log(share / (1 - share))
    return out


def document_statistics(docs: DataFrame, keys: list[str], ratios: np.ndarray, slice_bytes: int = 2 << 20) -> DataFrame:
    """Rows (id, keys, STATS, word_evidence) of rows (id, text, keys)."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordscan.slices(batches, "text", slice_bytes):
            found = text_statistics(*wordscan.utf8(batch.column("text")))
            bucket, first = buckets_of(batch.column("text"), len(sent.value))
            total = np.concatenate(([0.0], np.cumsum(sent.value[bucket])))
            # rounded, so that sums over other neighbours in a batch don't show
            mean = np.round((total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1), 9)
            columns = [batch.column("id"), *(batch.column(k) for k in keys), *(pa.array(found[s].astype(np.int64)) for s in STATS), pa.array(mean)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *keys, *STATS, "word_evidence"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(measure, ", ".join([f"id {kind}", *(f"{k} string" for k in keys), *(f"{s} bigint" for s in STATS), "word_evidence double"]))


def features() -> list[Column]:
    """Statistics of a row as small numbers."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    part = lambda a, b: F.sqrt(F.least(F.col(a) / b, F.lit(1.0)))
    return [
        F.log1p(F.col("n_words").cast("double")) / 5,
        F.greatest(F.lit(0.0), 1 - F.col("n_words") / 50.0),
        F.log(chars / words),
        part("n_symbols", chars),
        part("n_dup_lines", lines),
        part("n_repeat_words", words),
        part("n_upper", chars),
        F.col("n_distinct") / words,
        F.log(words / lines) / 3,
        F.col("word_evidence"),
    ]


def shrunk_shares(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Add column share, the posterior of the finest group, to rows (groups..., n good of 0..1 in column good)."""
    total = rows.agg(F.count("*").alias("n"), F.sum("good").alias("k")).first()
    n_all, k_all = total["n"] or 0, total["k"] or 0.0
    prior = (k_all + 1) / (n_all + 2)
    levels: list[DataFrame] = []
    for depth in range(1, len(groups) + 1):
        keys = groups[:depth]
        level = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("good").alias("k"))
        if depth == 1:
            level = level.withColumn("parent", F.lit(prior))
        else:
            level = level.join(levels[-1].select(*keys[:-1], F.col("share").alias("parent")), keys[:-1])
        level = materialize(level, "level")
        spread = level.agg(
            F.count("*").alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("parent"), F.lit(2))).alias("s"),
            F.sum(F.col("n") * F.col("parent") * (1 - F.col("parent"))).alias("v"),
        ).first()
        weight = pseudo_documents(spread["g"], spread["n"], spread["s"], spread["v"])
        levels.append(level.withColumn("share", (F.col("k") + weight * F.col("parent")) / (F.col("n") + weight)))
    return levels[-1].select(*groups, "share")


def near_sites(shares: DataFrame, most: int) -> DataFrame:
    """To be broadcast, if there are at most so many sites: a hot site's documents then stay where they are."""
    shares = materialize(shares, "shares")
    return F.broadcast(shares) if shares.count() <= most else shares


def pseudo_documents(n_groups: int, n_rows: int, between: float | None, binomial: float | None) -> float:
    """The weight of the parent's share, from the spread of shares beyond chance."""
    if not n_groups or not binomial or n_rows <= n_groups:
        return 100.0
    chance = n_groups / n_rows
    excess = min(max((between / binomial - chance) / (1 - chance), 1e-4), 1 / (1 + LEAST_WEIGHT))
    return (1 - excess) / excess


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sites: tuple[str, ...] = ("source", "lang"),
    label_col: str = "quality",
    folds: int = 5,
    held_out: int = 0,
    sample_rows: int = 20_000,
    word_buckets: int = 1 << 18,
    word_weight: float = 10.0,
    broadcast_labels: int = 1_000_000,
    broadcast_sites: int = 200_000,
) -> DataFrame:
    """One row for each document: id, held_out, evidence, site_share, score, kept (score of 0.5 or more).

    `sites` names the levels from host to path, coarse to fine.
    """
    wordscan.bound_batches(docs.sparkSession)
    names = [f"k{j}" for j in range(len(sites))]
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    number = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds))
    fold = number == held_out
    known = materialize(known.where(~fold).groupBy("id").agg(F.min("y").alias("y")), "labels")
    few = known.count() <= broadcast_labels
    near = F.broadcast if few else (lambda df: df)
    tune = materialize(known.where(number == (held_out + 1) % folds).orderBy(F.xxhash64("id"), "id").limit(sample_rows), "tune")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).cast("string").alias(n) for c, n in zip(sites, names, strict=True)))
    ratios = bucket_ratios(texts.select("id", "text").join(near(known.join(F.broadcast(tune.select("id")), "id", "left_anti")), "id").select("text", "y"), word_buckets, word_weight)
    rows = document_statistics(texts, names, ratios)
    rows = rows.select("id", *(F.coalesce(F.concat(F.lit("="), n), F.lit("")).alias(n) for n in names), F.array(*features()).alias("x"))
    rows = materialize(rows.join(near(known), "id", "left"), "features")
    sample = rows.join(F.broadcast(tune.select("id")), "id", "left_semi").select("id", "x", "y").distinct().orderBy(F.xxhash64("id"), "id", "x").limit(sample_rows).select("x", "y").collect()
    y = np.array([r["y"] for r in sample], float)
    if 0 < y.sum() < len(y):
        w = logistic(np.array([r["x"] for r in sample]), y)
        base = float(np.log(y.mean() / (1 - y.mean())))
    else:
        w, base = np.zeros(1 + len(features())), 0.0
    evidence = sum((F.lit(float(c)) * F.col("x")[j] for j, c in enumerate(w[1:])), F.lit(float(w[0]) - base))
    rows = rows.withColumn("evidence", F.greatest(F.least(evidence, F.lit(30.0)), F.lit(-30.0)))
    rows = rows.withColumn("good", F.coalesce(F.col("y").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + base)))))
    rows = materialize(rows.select("id", *names, "evidence", "good"), "evidence")
    shares = shrunk_shares(rows.select(*names, "good"), names)
    joined = rows.join(near_sites(shares, broadcast_sites), names)
    score = 1 / (1 + F.exp(-F.col("evidence")) * (1 - F.col("share")) / F.col("share"))
    out = joined.select("id", F.coalesce(fold, F.lit(False)).alias("held_out"), "evidence", F.col("share").alias("site_share"), score.alias("score"))
    return out.withColumn("kept", F.col("score") >= 0.5).withColumnRenamed("id", id_col)
