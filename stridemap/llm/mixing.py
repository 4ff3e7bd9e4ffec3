"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Targets. Sources in order of code points (null last) have the given weights in turn and share
the words of all documents by weight; a source's target stops at `cap` times its size, and the excess goes to the
others by weight, until none is above. That is a water level, which sums over all sources raise until no further source
is above its cap.

Rates. Among all document rates that give each source its target words, entropy balancing takes
those with the least relative entropy to the corpus, counted in words. The dual is convex: the
sum over sources of size * exp(m) - target * m, and document rates are the exponential tilts
exp(m) of their source's multiplier. Newton steps on all multipliers run as DataFrame steps over the
table of sources; the sizes in it are sums over all documents. They end when every target is met to `tolerance`.

Copies. A document gets the whole part of its rate, and some get one more, so that a source's words come near
its target. Documents lie in bins of a source by a hash of their id; whole bins get the extra
copy until the next one would exceed what is missing, and within that one bin, whose size is about the square
root of the source's, documents are taken while they fit: in order of the hash, then in three turns the largest that fit first. A hot
source has more bins, so no task holds it. Reruns agree, whatever the partitions.

The table of sources is broadcast up to `broadcast_sources` rows and joined by a shuffle beyond.

Cases: null or empty text has size 0: its document gets the whole part of its rate and takes 0 words; a null source is a source of its own, the last;
repeated rows (same id, source and size) get the same number of copies; a null id is an id; an empty
table gives no rows; a source without words has the target 0. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemap.session import materialize

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """Add rank, from 0 in order of source, nulls last: by ranges of the order and the sizes of the ranges before."""
    ranges = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("m"))
    before = sizes.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))  # a row for each range
    here = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranges.withColumn("here", here).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("here") - 1).drop("part", "here", "before")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Add target to a table (source, n, source_size) of sources.

    All sources share by weight; those above cap times their size are fixed there, and the others share the rest, until none is above: the
    level (words for each unit of weight) only rises, so a source once above stays above. Each turn is one sum over all sources."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = materialize(ranked(sources).withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")).drop("rank"), "weights")
    level = 0.0
    while True:
        capped = F.col("most") <= F.col("weight") * F.lit(level)
        found = rows.agg(F.sum("source_size").cast("double").alias("total"), F.sum(F.when(capped, F.col("most"))).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        following = ((found["total"] or 0.0) - (found["fixed"] or 0.0)) / found["open"] if found["open"] else level
        if following <= level * (1 + 1e-12):
            break
        level = following
    target = F.when(F.col("most") <= F.col("weight") * F.lit(level), F.col("most")).otherwise(F.col("weight") * F.lit(level))
    return rows.withColumn("target", target).select("source", "n", "source_size", "target")


def balance(sources: DataFrame, tolerance: float, max_steps: int) -> DataFrame:
    """Add the multiplier m and the rate exp(m) by Newton steps on the dual."""
    live = (F.col("target") > 0) & (F.col("source_size") > 0)
    state = materialize(sources.withColumn("m", F.when(live, F.lit(0.0))), "multipliers")
    for _ in range(max_steps):
        gradient = F.col("source_size") * F.exp("m") - F.col("target")
        curvature = F.col("source_size") * F.exp("m")
        # far below the solution a Newton step overshoots: steps up are at most 1
        stepped = state.withColumn("m", F.col("m") - F.greatest(gradient / curvature, F.lit(-1.0)))
        state = materialize(stepped, "multipliers")
        off = state.where(F.abs(F.col("source_size") * F.exp("m") - F.col("target")) > tolerance * F.col("target"))
        if off.limit(1).count() == 0:
            return state.withColumn("rate", F.coalesce(F.exp("m"), F.lit(0.0)))
    raise RuntimeError(f"no balance in {max_steps} Newton steps")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3,
    tolerance: float = 1e-9,
    max_steps: int = 80,
    broadcast_sources: int = 200_000,
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, rate, copies."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    rows = materialize(rows.withColumn("luck", F.xxhash64("id", F.lit("mixing"))), "sizes")
    sources = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    sources = balance(targets(sources, weights, cap), tolerance, max_steps)
    whole = F.floor(F.col("rate") + 1e-7).cast("bigint")
    sources = sources.withColumn("whole", whole).withColumn("missing", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint"))
    sources = sources.withColumn("n_bins", F.ceil(F.sqrt("n") / 8).cast("bigint"))
    keyed = sources.select(F.col("source").alias("s"), "source_size", "target", "rate", "whole", "missing", "n_bins")
    # 53 bits of the hash as a number from 0 to below 1
    share = F.shiftrightunsigned("luck", 11) / F.lit(float(1 << 53))
    few = sources.count() <= broadcast_sources
    near = F.broadcast if few else (lambda df: df)
    placed = rows.join(near(keyed), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bin", F.floor(share * F.col("n_bins")))
    placed = placed.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))  # never null, for keys
    bins = placed.groupBy("source_key", "bin").agg(F.sum("size").alias("bin_size"), F.first("missing").alias("missing"))
    up_to = Window.partitionBy("source_key").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("bin_size").over(up_to))
    cut = bins.where(F.col("upto") > F.col("missing")).groupBy("source_key").agg(F.min(F.struct("bin", (F.col("missing") - F.col("upto") + F.col("bin_size")).alias("need"))).alias("cut"))
    cut = cut.select("source_key", F.col("cut.bin").alias("cut_bin"), F.col("cut.need").alias("need"))
    placed = placed.join(near(cut), "source_key", "left")
    kept = ["id", "source", "size", "source_size", "target", "rate"]
    sure = placed.where(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin")))
    more = (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))) & (F.col("size") > 0)
    sure = sure.select(*kept, (F.col("whole") + F.when(more, 1).otherwise(0)).alias("copies"))
    last = placed.where(F.col("bin") == F.col("cut_bin")).withColumn("extra", F.lit(0))
    of_source = Window.partitionBy("source_key")
    # range frames: equal rows are taken together
    by_luck, by_size = of_source.orderBy("luck", "id", "size"), of_source.orderBy(F.desc("size"), "luck", "id")
    for in_order in (by_luck, by_size, by_size, by_size):
        fits = (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("need"))
        last = last.withColumn("sum_", F.sum(F.when(fits, F.col("size"))).over(in_order))
        last = last.withColumn("now", (fits & (F.col("sum_") <= F.col("need"))).cast("int"))
        last = last.withColumn("need", F.col("need") - F.sum(F.col("now") * F.col("size")).over(of_source)).withColumn("extra", F.col("extra") + F.col("now"))
    last = last.select(*kept, (F.col("whole") + F.col("extra")).alias("copies"))
    out = sure.unionByName(last)
    return out.withColumnsRenamed({"id": id_col, "source": source_col})


def mixed_documents(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each as often as its copies say (none for 0), with their own columns."""
    amounts = mixed.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "size", "copies").where("copies > 0").distinct()
    # the columns of documents lie in a struct, so that no name clashes
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("own_id"), F.col(source_col).cast("string").alias("own_source"), word_count(F.col(text_col).cast("string")).alias("own_size"))
    joined = rows.join(amounts, F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("turn")).select("row.*")
