"""Quality rules: base statistics with fixed limits, then robust multivariate outliers.

Base statistics come from whole texts: n_words (runs of [^\\x20\\x09-\\x0D]), word_chars (code
points in words), n_symbols (characters of #*$%&|<>), n_dup_lines (lines with a word that equal an
earlier one), n_repeat_words (words in windows of three words found twice or more). Lines and
windows are compared by 64-bit hashes within a document. A document fails the base rules with fewer
than `least_words` words, or with more than `most_repeats` percent of its words repeated.

The others are judged by the minimum covariance determinant: for each language and source,
the location and scatter of those `support` of the documents whose scatter has the least determinant
describe the bulk; a document whose squared Mahalanobis distance from it, on transformed
statistics, exceeds the chi-square quantile of 1 - `tail` is an outlier. There are two starts: medians with quartile ranges, and mean with
covariance of all documents of the group. From each, concentration steps go on until one lowers the determinant by less than `tolerance` of its
logarithm's unit: distances of all rows, the `support` quantile of each group from a histogram of 64 bins for each doubling, moments of the
rows up to that bin. (A bin is taken whole, so a step's support may be some rows more than the last one's; a step that would raise the determinant is not
taken.) Of the two ends the one with the lesser determinant counts. Each step is one
grouped aggregation of all rows with partial sums, by group and histogram bin, so a hot source is no hot task; the
estimates are a small table, broadcast up to `broadcast_groups` rows and joined by a shuffle beyond. Distances are scaled so that their median is
that of a chi-square variable, if it is more.
A group of fewer than `least_group` documents takes its language's estimate, and a language of
fewer than that the estimate of all documents. Each statistic's scatter has a floor, so a statistic that is
constant in the bulk doesn't reject every deviation from it.

Cases: null and empty texts have zero statistics and fail the base rules; null languages and sources are groups of
their own; repeated rows are judged alike and each counts; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemap.llm import wordscan
from stridemap.session import materialize, materialize_counted

SYMBOLS = b"#*$%&|<>"
#: Transformed statistics, and the least standard deviation that each is taken to have.
VECTOR = {
    "x_words": 0.5,
    "x_word_length": 0.10,
    "x_symbols": 0.05,
    "x_dup_lines": 0.15,
    "x_repeats": 0.15,
    "x_upper": 0.05,
    "x_variety": 0.10,
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct", "n_lines"]


def _repeats(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with an owner: which occur again in the same owner, and which of those are not the first."""
    key = wordscan.mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    often, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    later[order[1:][same]] = True
    return often, later


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of each text."""
    n_docs = len(offsets) - 1
    mapped, starts, ends, first = wordscan.words(data, offsets, wordscan.space_table(lower=False))
    prefix = wordscan.prefix_hash(data)
    per_doc = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    point = (data & 0xC0) != 0x80
    word = wordscan.span_hash(prefix, starts, ends)
    doc_of_word = np.repeat(np.arange(n_docs), np.diff(first))
    count = lambda owner, flags: np.bincount(owner[flags], minlength=n_docs)
    # windows of three words that lie in one text
    n = max(0, len(word) - 2)
    inside = doc_of_word[:n] == doc_of_word[2:] if n else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    windows = word[at] + word[at + 1] * np.uint64(0xD6E8FEB86659FD93) + word[at + 2] * np.uint64(0xA0761D6478BD642F)
    often, _ = _repeats(doc_of_word[at], windows)
    change = np.zeros(len(word) + 3, np.int32)
    np.add.at(change, at[often], 1)
    np.add.at(change, at[often] + 3, -1)
    repeated = np.cumsum(change)[: len(word)] > 0
    _, again = _repeats(doc_of_word, word)
    # lines
    cuts = np.flatnonzero(data == 0x0A)
    begins = np.sort(np.concatenate((offsets[:-1], cuts + 1)), kind="stable")
    doc_of_line = np.searchsorted(offsets[1:], begins, "right")
    owner_ok = doc_of_line < n_docs
    begins, doc_of_line = begins[owner_ok], doc_of_line[owner_ok]
    stops = np.minimum(np.append(begins[1:], len(data)), offsets[doc_of_line + 1])
    line_end = stops - ((stops > begins) & (data[np.maximum(stops - 1, 0)] == 0x0A) if len(data) else 0)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, begins)
    begins, line_end, doc_of_line = begins[has_word], line_end[has_word], doc_of_line[has_word]
    _, dup = _repeats(doc_of_line, wordscan.span_hash(prefix, begins, line_end) + (line_end - begins).astype(np.uint64))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    return {
        "n_words": np.diff(first),
        "word_chars": per_doc(point & (mapped != 0)),
        "n_symbols": per_doc(symbol[data]),
        "n_dup_lines": count(doc_of_line, dup),
        "n_repeat_words": count(doc_of_word, repeated),
        "n_upper": per_doc((data >= 0x41) & (data <= 0x5A)),
        "n_distinct": count(doc_of_word, ~again),
        "n_lines": np.bincount(doc_of_line, minlength=n_docs),
    }


def base_statistics(docs: DataFrame, id_col: str, text_col: str, keys: list[str], slice_bytes: int = 2 << 20) -> DataFrame:
    """Rows (id, the key columns as text, STATS)."""
    wordscan.bound_batches(docs.sparkSession)
    names = [f"k{j}" for j in range(len(keys))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).cast("string").alias(n) for c, n in zip(keys, names, strict=True)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordscan.slices(batches, "text", slice_bytes):
            found = text_statistics(*wordscan.utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(n) for n in names), *(pa.array(found[s].astype(np.int64)) for s in STATS)], names=["id", *names, *STATS])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(measure, ", ".join([f"id {kind}", *(f"{n} string" for n in names), *(f"{s} bigint" for s in STATS)]))


def vector() -> list[Column]:
    """The transformed statistics of a row of STATS with words."""
    words, chars = F.col("n_words").cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    part = lambda a, b: F.sqrt(F.least(F.col(a) / F.greatest(b, F.lit(1.0)), F.lit(1.0)))
    made = {
        "x_words": F.log(words),
        "x_word_length": F.log(chars / words),
        "x_symbols": part("n_symbols", chars),
        "x_dup_lines": part("n_dup_lines", F.col("n_lines").cast("double")),
        "x_repeats": part("n_repeat_words", words),
        "x_upper": part("n_upper", chars),
        # distinct words against what a text of that length tends to have
        "x_variety": F.log(F.col("n_distinct") / words) + 0.12 * F.log(words),
    }
    return [made[name].alias(name) for name in VECTOR]


def chi_square_quantile(p: float, d: int) -> float:
    """By the Wilson-Hilferty approximation."""
    z = NormalDist().inv_cdf(p)
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


#: Histogram bins of squared distances: this many for each doubling.
FINE = 64


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(F.greatest(distance, F.lit(1e-9))) * FINE).cast("int")


def _moments(names: list[str]) -> list[Column]:
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    return [F.count("*").alias("n"), *(F.sum(a).alias(f"s_{a}") for a in names), *(F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in pairs)]


def _fit(names: list[str], floors: list[float]):
    """A function from rows of moments to rows of location, inverse Cholesky factor and log determinant (mapInPandas)."""

    def fit(frames):
        import pandas as pd

        d = len(names)
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                n = row["n"]
                mean = np.array([row[f"s_{a}"] for a in names]) / n
                scatter = np.empty((d, d))
                for i, a in enumerate(names):
                    for j in range(i, d):
                        scatter[i, j] = scatter[j, i] = row[f"q_{a}_{names[j]}"] / n - mean[i] * mean[j]
                scatter += np.diag(np.maximum(0, np.square(floors) - np.diag(scatter)))
                low = None
                while low is None:
                    try:
                        low = np.linalg.cholesky(scatter)
                    except np.linalg.LinAlgError:  # rounding: widen the diagonal
                        scatter += np.diag(np.square(floors)) * 0.1
                out.append({k: row[k] for k in KEY} | {"mean": mean.tolist(), "factor": np.linalg.inv(low).ravel().tolist(), "log_det": float(2 * np.log(np.diag(low)).sum())})
            yield pd.DataFrame(out, columns=[*KEY, "mean", "factor", "log_det"])

    return fit


#: A group's estimate from one start: level of the group, its name, start, documents.
KEY = ["level", "g", "start", "size"]
ESTIMATE = "level int, g string, start int, size bigint, mean array<double>, factor array<double>, log_det double"


def distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance of a row from the location and factor beside it."""
    d, total = len(names), F.lit(0.0)
    for i in range(d):
        part = sum(((F.col(names[j]) - F.col("mean")[j]) * F.col("factor")[i * d + j] for j in range(i + 1)), F.lit(0.0))
        total = total + part * part
    return total


def _groups() -> Column:
    """The groups of a row at three levels: its language and source, its language, all."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.regexp_replace(F.col(c), "[/\\\\\\\\]", "\\\\\\\\$0")), F.lit(""))
    return F.array(F.concat(text("k0"), F.lit("/"), text("k1")), text("k0"), F.lit("*"))


def robust_estimates(rows: DataFrame, names: list[str], support: float, tolerance: float, least_group: int, broadcast_groups: int = 20_000) -> DataFrame:
    """(level, g, size, mean, factor, log_det, scale, steps) for the groups of rows, whose column groups has their names by level."""
    floors = [VECTOR[n] for n in names]
    levels = materialize(
        rows.groupBy("groups").agg(F.count("*").alias("n"))
        .select(F.posexplode("groups").alias("level", "g"), "n").groupBy("level", "g").agg(F.sum("n").cast("bigint").alias("size")),
        "groups",
    )
    # a group that is too small is not estimated at its own level
    used = materialize(levels.where((F.col("size") >= least_group) | (F.col("level") == 2)).select("level", "g", "size"), "used")
    near = F.broadcast if 2 * used.count() <= broadcast_groups else (lambda df: df)
    leveled = rows.select(*names, F.posexplode("groups").alias("level", "g"))
    quantile = lambda c, p: F.percentile_approx(c, F.lit(p), F.lit(1000))
    centre = leveled.groupBy("level", "g").agg(*(quantile(c, 0.5).alias(f"m_{c}") for c in names), *(quantile(c, 0.75).alias(f"u_{c}") for c in names), *(quantile(c, 0.25).alias(f"l_{c}") for c in names))
    spread = [F.greatest((F.col(f"u_{c}") - F.col(f"l_{c}")) / 1.349, F.lit(f)) for c, f in zip(names, floors, strict=True)]
    d = len(names)
    fit = _fit(names, floors)
    medians = centre.join(used, ["level", "g"]).select("level", "g", F.lit(0).alias("start"), "size", F.array(*(F.col(f"m_{c}") for c in names)).alias("mean"), F.array(*(1 / spread[i] if i == j else F.lit(0.0) for i in range(d) for j in range(d))).alias("factor"), F.lit(float("inf")).alias("log_det"))
    whole = leveled.groupBy("level", "g").agg(*_moments(names)).join(used, ["level", "g"]).withColumn("start", F.lit(1))
    state = medians.unionByName(whole.mapInPandas(fit, ESTIMATE).withColumn("log_det", F.lit(float("inf"))))
    state = materialize(state.withColumn("steps", F.lit(0)).withColumn("live", F.lit(True)), "estimates")
    along = Window.partitionBy("level", "g", "start").orderBy("bin")
    while True:
        live = state.where("live")
        cells = leveled.join(near(live), ["level", "g"]).withColumn("bin", _bin(distance(names))).groupBy(*KEY, "bin").agg(*_moments(names))
        inner = cells.withColumn("before", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inner = inner.where(F.col("before") < F.ceil(F.lit(support) * F.col("size")))
        summed = [c for c in cells.columns if c not in (*KEY, "bin")]
        found = inner.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in summed)).mapInPandas(fit, ESTIMATE)
        found = found.select("level", "g", "start", F.struct("mean", "factor", "log_det").alias("e"))
        both = state.join(found, ["level", "g", "start"], "left")
        lower = F.col("live") & F.coalesce(F.col("e.log_det") < F.col("log_det"), F.lit(False))
        fresh = [F.when(lower, F.col(f"e.{c}")).otherwise(F.col(c)).alias(c) for c in ("mean", "factor", "log_det")]
        goes_on = lower & (F.col("e.log_det") < F.col("log_det") - tolerance)
        state, n = materialize_counted(both.select(*KEY, *fresh, (F.col("steps") + F.col("live").cast("int")).alias("steps"), goes_on.alias("live")), "live", "estimates")
        if n == 0:
            break
    best = state.groupBy("level", "g").agg(F.min_by(F.struct("size", F.lit(0).alias("start"), "mean", "factor", "log_det", "steps"), F.struct("log_det", "start")).alias("e")).select("level", "g", "e.*")
    best = materialize(best, "best")
    # the scale that puts the median distance where a chi-square variable has it
    cells = leveled.join(near(best), ["level", "g"]).groupBy(*KEY, _bin(distance(names)).alias("bin")).agg(F.count("*").alias("n"))
    half = cells.withColumn("upto", F.sum("n").over(along)).where(F.col("upto") >= F.col("size") / 2).groupBy("level", "g").agg(F.min("bin").alias("bin"))
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("bin") + 0.5) / FINE) / chi_square_quantile(0.5, d), F.lit(1.0))
    return materialize(best.join(half, ["level", "g"]).select("level", "g", "size", "mean", "factor", "log_det", "steps", scale.alias("scale")), "estimates")


def quality(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_words: int = 50,
    most_repeats: int = 50,
    support: float = 0.75,
    tolerance: float = 1e-3,
    least_group: int = 100,
    tail: float = 1e-3,
    broadcast_groups: int = 20_000,
) -> DataFrame:
    """One row for each document: id, the base statistics, base_failed, distance (null if base_failed), kept."""
    names = list(VECTOR)
    rows = materialize(base_statistics(docs, id_col, text_col, [lang_col, source_col]), "statistics")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    sound = materialize(rows.where(~F.col("base_failed")).select("id", *STATS, *vector(), _groups().alias("groups")), "vectors")
    found = robust_estimates(sound, names, support, tolerance, least_group, broadcast_groups)
    # the estimate of the smallest group that is large enough
    at = sound.select("groups").distinct().select("groups", F.posexplode("groups").alias("level", "g"))
    best = at.join(found, ["level", "g"]).groupBy("groups").agg(F.min_by(F.struct("mean", "factor", "scale"), "level").alias("e"))
    best = materialize(best.select("groups", "e.mean", "e.factor", "e.scale"), "best")
    near = F.broadcast if best.count() <= broadcast_groups else (lambda df: df)
    limit = chi_square_quantile(1 - tail, len(names))
    judged = sound.join(near(best), "groups").withColumn("distance", distance(names) / F.col("scale"))
    judged = judged.select("id", *STATS, F.lit(False).alias("base_failed"), "distance", (F.col("distance") <= limit).alias("kept"))
    refused = rows.where("base_failed").select("id", *STATS, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.unionByName(refused).withColumnRenamed("id", id_col)
