"""Toxicity from class-conditional Kneser-Ney models.

Words are lower-cased (A-Z) runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. Labelled training documents give counts
of word pairs for the toxic and the ordinary class: n_c(h w) is the number of documents of class c with the pair, where
documents of the same text count once. With an absolute discount of 1, h the word before w, and k_c(w) the number of
distinct words before w (the continuation count of the lower order),

    P_c(w | h) = (max(n_c(h w) - 1, 0) + N_c(h .) P_c(w)) / n_c(h), or P_c(w) where class c has no h
    P_c(w)     = (max(k_c(w) - 1, 0) + V_c S(w)) / K_c

where n_c(h) and K_c are sums, N_c(h .) and V_c count the words after h and all words, and S is the continuation share of
w in both classes together. r(h w) = log P_t(w | h) / P_o(w | h), and u(w) = log P_t(w) / P_o(w) less the constant that unknown words
have (it depends on the sizes of the classes alone). Most expressions are as frequent in both classes but for chance, so each order
is interpolated with the next lower one by the strength of its evidence:

    e(w)   = s(G_w) u(w)
    e(h w) = s(G_hw) r(h w) + (1 - s(G_hw)) e(w) where a class counts the pair twice or more, else e(w)

with G the log-likelihood ratio statistic of an expression's counts in both classes against those of all, and
s(G) = 1 / (1 + exp((evidence - G) / 2)). The discount leaves nothing of a pair counted once, so it has its word's e; and u is 0
for words counted once at most. The table of the model leaves those out, which loses nothing. A document has the sum of e over all its words, normalised by length.

Two numbers describe a document: the mean ratio of its words, and the highest mean over `span` consecutive words. A logistic curve without
weights below 0, fitted to at most `calibration_rows` labelled rows (of one training fold, in order of a hash) that give no
counts, turns them into a score from 0 to 1. All other labelled training rows are counted.

Words are 64-bit hashes. Counts go as sorted arrays, dealt out by the hash of the pair, so a frequent word is in all
buckets; where such arrays would be shorter than `blob_bytes`, they go as rows that Spark sums. A model of at most
`broadcast_rows` expressions (12 bytes each) is broadcast; a larger one is dealt out by hash, as are the distinct expressions of each
chunk of documents, in rounds of about `round_bytes` of text, or of a share of it if there would be more than `rounds`. Labels and the hashes of copied texts are broadcast if there are at most `broadcast_labels`, else joined by a
shuffle.

Cases: null and empty texts have the ratios 0 and the score of no evidence; null labels and labels of unknown documents
are ignored; of several labels of a document the highest counts; repeated rows have equal scores; without labels of both classes
every ratio is 0 and every score is the smoothed share of toxic labels. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemap.llm import wordscan
from stridemap.session import discard, materialize, release

START = np.uint64(1)  # stands before a document's first word
FACTOR = np.uint64(0x9FB21C651E98DF25)


def word_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(for each word the hash of the word before, its own, first word of each text)."""
    mapped, starts, ends, first = wordscan.words(data, offsets, wordscan.alnum_table())
    word = wordscan.span_hash(wordscan.prefix_hash(mapped), starts, ends)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = START
    return before, word, first


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return wordscan.mix(before * FACTOR + word)


def _sum_by(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return (keys, *counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[heads], *(np.add.reduceat(c[order], heads) for c in counts))


def distinct_texts(rows: DataFrame, broadcast_rows: int) -> DataFrame:
    """Labelled rows (text, toxic), copies of a text once in each class. Only texts with copies are shuffled."""
    marked = rows.select("text", "toxic", F.xxhash64("text").alias("mark"))
    copied = materialize(marked.groupBy("mark", "toxic").agg(F.count("*").alias("n")).where("n > 1").select("mark", "toxic"), "copied")
    near = F.broadcast(copied) if copied.count() <= broadcast_rows else copied
    once = marked.join(near, ["mark", "toxic"], "left_anti")
    return once.unionByName(marked.join(near, ["mark", "toxic"], "left_semi").dropDuplicates(["mark", "toxic"])).select("text", "toxic")


#: Counts of a word: as the first of a pair in toxic and ordinary documents, words after it there, words before it there and in both.
STATS = ["n_t", "n_o", "after_t", "after_o", "before_t", "before_o", "before"]


def pair_counts(rows: DataFrame, slice_bytes: int, bucket_bytes: int, blob_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Of labelled rows (text, toxic): pairs (h, w, t, o) that a class counts twice or more, and word counts (word, STATS)."""
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # about three bytes of counts for each byte of text, and buckets of at most about bucket_bytes
    bits = max(4, (3 * total // bucket_bytes).bit_length())
    as_rows = (3 * slice_bytes) >> bits < blob_bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordscan.slices(batches, "text", slice_bytes):
            before, word, first = word_pairs(*wordscan.utf8(batch.column("text")))
            if not len(word):
                continue
            keys = pair_keys(before, word)
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.argsort(keys, kind="stable")
            keys, text = keys[order], text[order]
            heads = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[text[heads]]
            at = order[heads]
            keys, where, t, o = _first_by(keys[heads], at, (toxic == 1).astype("<i4"), (toxic != 1).astype("<i4"))
            columns = [before[where].view("<i8"), word[where].view("<i8"), t.astype("<i4"), o.astype("<i4")]
            if as_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "w", "t", "o"])
                continue
            cuts = _cuts(keys, bits)
            full = np.flatnonzero(np.diff(cuts)).tolist()
            blobs = [[c[cuts[b] : cuts[b + 1]].tobytes() for b in full] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "h", "w", "t", "o"])

    def settle(group: pa.Table) -> pa.Table:
        h, w, t, o = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)]) for name, kind in zip("hwto", ("<u8", "<u8", "<i4", "<i4"), strict=True))
        _, at, t, o = _first_by(pair_keys(h, w), np.arange(len(h)), t, o)
        h, w = h[at], w[at]
        in_t, in_o, none = (t > 0).astype("<i4"), (o > 0).astype("<i4"), np.zeros(len(h), "<i4")
        of_h, of_w = [t, o, in_t, in_o, none, none, none], [none, none, none, none, in_t, in_o, none + 1]
        word, *stats = _sum_by(np.concatenate((h, w)), *(np.concatenate(c) for c in zip(of_h, of_w, strict=True)))
        often = (t > 1) | (o > 1)
        n, m = int(often.sum()), len(word)
        columns = [np.repeat([0, 1], (n, m)).astype("<i4"), np.concatenate((h[often], word)).view("<i8"), np.concatenate((w[often].view("<i8"), np.zeros(m, "<i8")))]
        columns += [np.concatenate((c, s)) for c, s in zip((t[often], o[often], *[np.zeros(n, "<i4")] * 5), stats, strict=True)]
        return pa.table([pa.array(c.astype("<i4") if k > 2 else c) for k, c in enumerate(columns)], names=["kind", "h", "w", *STATS])

    if as_rows:
        pairs = rows.mapInArrow(count, "h bigint, w bigint, t int, o int").groupBy("h", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
        pairs = materialize(pairs, "pairs")
        ints = lambda *c: [x.cast("bigint").alias(s) for x, s in zip(c, STATS, strict=True)]
        seen = [(F.col(c) > 0).cast("int") for c in ("t", "o")]
        zero = F.lit(0)
        stats = pairs.select(F.col("h").alias("word"), *ints(F.col("t"), F.col("o"), *seen, zero, zero, zero)).unionByName(pairs.select(F.col("w").alias("word"), *ints(zero, zero, zero, zero, *seen, F.lit(1))))
        often = pairs.where("t > 1 or o > 1")
    else:
        blobs = rows.mapInArrow(count, "bucket int, h binary, w binary, t binary, o binary")
        pairs = materialize(blobs.groupBy("bucket").applyInArrow(settle, f"kind int, h bigint, w bigint, {', '.join(f'{s} int' for s in STATS)}"), "pairs")
        stats = pairs.where("kind = 1").select(F.col("h").alias("word"), *STATS)
        often = pairs.where("kind = 0").select("h", "w", F.col(STATS[0]).alias("t"), F.col(STATS[1]).alias("o"))
    release(spark)
    words = materialize(stats.groupBy("word").agg(*(F.sum(s).alias(s) for s in STATS)), "words")
    release(spark)
    often._stridemap_path = pairs._stridemap_path
    return often, words


def _first_by(keys: np.ndarray, places: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, a place of each, and the sums of their counts."""
    if not len(keys):
        return (keys, places, *counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[heads], places[order][heads], *(np.add.reduceat(c[order], heads) for c in counts))


def likelihood_ratios(rows: DataFrame, evidence: float, slice_bytes: int, bucket_bytes: int, blob_bytes: int) -> DataFrame:
    """(h, w, e) of the pairs, and with h null of the words, of labelled rows (text, toxic)."""
    often, words = pair_counts(rows, slice_bytes, bucket_bytes, blob_bytes)
    n = words.agg(*(F.coalesce(F.sum(s), F.lit(0)).cast("double").alias(s) for s in STATS), *(F.count_if(F.col(s) > 0).alias("v" + s[-2:]) for s in ("before_t", "before_o"))).first()
    if not n["before_t"] or not n["before_o"]:
        discard(often, words)
        return rows.sparkSession.createDataFrame([], "h bigint, w bigint, e float")

    def weight(t: str, o: str, all_t: float, all_o: float) -> Column:
        """s(G) of counts t and o."""
        share, both = all_t / (all_t + all_o), F.col(t) + F.col(o)
        term = lambda x, p: F.when(x > 0, x * F.log(x / (both * p))).otherwise(0.0)
        return 1 / (1 + F.exp(F.lit(evidence / 2) - term(F.col(t), share) - term(F.col(o), 1 - share)))

    lower = lambda c: (F.greatest(F.col(f"before_{c}") - 1, F.lit(0)) + n[f"v_{c}"] * F.col("before") / n["before"]) / n[f"before_{c}"]
    unknown = float(np.log(n["v_t"] / n["before_t"]) - np.log(n["v_o"] / n["before_o"]))
    e = weight("before_t", "before_o", n["before_t"], n["before_o"]) * (F.log(lower("t") / lower("o")) - unknown)
    of_w = words.where("before > 0").select(F.col("word").alias("w"), lower("t").alias("p_t"), lower("o").alias("p_o"), F.when(F.greatest("before_t", "before_o") > 1, e).otherwise(0.0).alias("e_w"))
    of_h = words.select(F.col("word").alias("h"), "n_t", "n_o", "after_t", "after_o")
    both = often.join(of_w, "w").join(of_h, "h")
    given = lambda c, own: F.when(F.col(f"n_{c}") > 0, (F.greatest(F.col(own) - 1, F.lit(0)) + F.col(f"after_{c}") * F.col(f"p_{c}")) / F.col(f"n_{c}")).otherwise(F.col(f"p_{c}"))
    sure = weight("t", "o", n["n_t"], n["n_o"])
    double = both.select("h", "w", (sure * F.log(given("t", "t") / given("o", "o")) + (1 - sure) * F.col("e_w")).cast("float").alias("e"))
    single = of_w.where("e_w <> 0").select(F.lit(None).cast("bigint").alias("h"), "w", F.col("e_w").cast("float").alias("e"))
    out = materialize(single.unionByName(double), "ratios")
    discard(often, words)
    return out


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(is_pair, key, e) of rows (h, w, e): the key of a word is its hash."""
    for batch in batches:
        is_pair = batch.column("h").is_valid()
        h, w = (batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in "hw")
        keys = np.where(is_pair.to_numpy(zero_copy_only=False), pair_keys(h, w), w).view(np.int64)
        yield pa.RecordBatch.from_arrays([is_pair, pa.array(keys), batch.column("e")], names=["is_pair", "key", "e"])


class Model:
    """Expressions of a model in sorted arrays, from tables (key, e) of pairs and words."""

    def __init__(self, pairs: pa.Table, words: pa.Table):
        self.pairs, self.of_pair = self._sorted(pairs)
        self.words, self.of_word = self._sorted(words)

    @staticmethod
    def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, e = table.column("key").to_numpy().view(np.uint64), table.column("e").to_numpy()
        order = np.argsort(keys, kind="stable")
        return keys[order], e[order]

    def evidence(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """e of each word after the one before it."""
        known = _look_up(pair_keys(before, word), self.pairs, self.of_pair, np.nan)
        return np.where(np.isnan(known), _look_up(word, self.words, self.of_word, 0.0), known)


def _look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
    if not len(known):
        return np.full(len(keys), other)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], other)


def _judged(ids: pa.Array, first: np.ndarray, e: np.ndarray, span: int) -> pa.RecordBatch:
    """(id, mean_ratio, span_ratio) of texts, from e of all their words and the first word of each."""
    total = np.concatenate(([0.0], np.cumsum(e, dtype=float)))
    n = np.diff(first)
    mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
    best = mean.copy()
    long = np.flatnonzero(n >= span)
    if len(long):
        window = np.append((total[span:] - total[:-span]) / span, np.zeros(span))
        ends = first[long + 1] - span + 1
        best[long] = np.maximum.reduceat(window, np.ravel(np.column_stack((first[long], ends))))[::2]
    # rounded, so that sums over other neighbours in a batch don't show
    return pa.RecordBatch.from_arrays([ids, pa.array(np.round(mean, 9)), pa.array(np.round(best, 9))], names=["id", "mean_ratio", "span_ratio"])


def text_ratios(
    docs: DataFrame, model: DataFrame, span: int, broadcast_rows: int, slice_bytes: int, bucket_bytes: int = 16 << 20, round_bytes: int = 256 << 20, rounds: int = 8
) -> tuple[DataFrame, Broadcast | None]:
    """(id, mean_ratio, span_ratio) of rows (id, text), and what was sent for it; written already if nothing was."""
    kind = docs.schema["id"].dataType.simpleString()
    result = f"id {kind}, mean_ratio double, span_ratio double"
    if model.count() <= broadcast_rows:
        table = materialize(model.mapInArrow(keyed, "is_pair boolean, key bigint, e float"), "keyed")
        sent = docs.sparkSession.sparkContext.broadcast(Model(*(table.where(c).select("key", "e").toArrow() for c in ("is_pair", "not is_pair"))))
        discard(table)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in wordscan.slices(batches, "text", slice_bytes):
                before, word, first = word_pairs(*wordscan.utf8(batch.column("text")))
                yield _judged(batch.column("id"), first, sent.value.evidence(before, word), span)

        return docs.mapInArrow(judge, result), sent

    return _in_rounds(docs, model, result, span, slice_bytes, bucket_bytes, round_bytes, rounds), None


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the buckets of sorted keys, by the keys' first bits."""
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))


def _in_rounds(docs: DataFrame, model: DataFrame, result: str, span: int, slice_bytes: int, bucket_bytes: int, round_bytes: int, rounds: int) -> DataFrame:
    """text_ratios() without a copy of the model anywhere: a chunk's distinct keys and the model's are dealt out by hash as
    sorted arrays, a bucket answers with a bit for each key that is asked and e of the known ones. The documents go in
    rounds, each of which frees its shuffles, so that the disk holds a part of what is asked at a time."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    rounds = max(1, min(rounds, -(-total // round_bytes)))
    # keys of about twice the bytes of the text at most, and 12 bytes of each expression
    bits = max(4, ((2 * total // rounds + 12 * model.count()) // bucket_bytes).bit_length())
    ids_type = f"array<{docs.schema['id'].dataType.simpleString()}>"
    dealt_type = "bucket int, part bigint, keys binary, known binary, e binary"

    def blobs(part: int | None, keys: np.ndarray, e: np.ndarray | None) -> pa.RecordBatch:
        cuts = _cuts(keys, bits)
        full = np.flatnonzero(np.diff(cuts)).tolist()
        data = [None if c is None else [c[cuts[b] : cuts[b + 1]].tobytes() for b in full] for c in (keys, None, e)]
        columns = [pa.array(full, pa.int32()), pa.array([part] * len(full), pa.int64()), *(pa.nulls(len(full), pa.binary()) if x is None else pa.array(x, pa.binary()) for x in data)]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "keys", "known", "e"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            h, w = (rows.column(c).fill_null(0).to_numpy().view(np.uint64) for c in "hw")
            keys = pair_keys(h, w)
            order = np.argsort(keys, kind="stable")
            return blobs(None, keys[order], rows.column("e").to_numpy()[order])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= slice_bytes // 4:
                yield flushed(held)
                held = []
        if held:
            yield flushed(held)
        wordscan.give_back()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in wordscan.slices(batches, "text", slice_bytes):
            ids, texts = (pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in ("id", "text"))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), ids, texts], names=["part", "ids", "texts"])
            part += 1

    def asked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts the first word of each; the distinct keys of pairs and words in order; the order of all pairs' keys,
        followed by all words', and for each in that order its place among the distinct ones."""
        before, word, first = word_pairs(*wordscan.utf8(texts))
        keys = np.concatenate((pair_keys(before, word), pair_keys(np.uint64(0), word)))
        order = np.argsort(keys)
        keys = keys[order]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        return first, keys[head], order, np.cumsum(head) - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield blobs(batch.column("part")[k].as_py(), asked(batch.column("texts").slice(k, 1).flatten())[1], None)
        wordscan.give_back()

    def look_up(group: pa.Table) -> pa.Table:
        own = group.column("part").is_null()
        of_model, asks = group.filter(own), group.filter(pc.invert(own))
        keys, e = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in of_model.column(name))]) for name, kind in (("keys", "<u8"), ("e", "<f4")))
        order = np.argsort(keys, kind="stable")
        keys, e = keys[order], e[order]
        known, values = [], []
        for x in asks.column("keys"):
            found = _look_up(np.frombuffer(x.as_buffer(), "<u8"), keys, e, np.nan)
            there = ~np.isnan(found)
            known.append(np.packbits(there).tobytes())
            values.append(found[there].astype("<f4").tobytes())
        out = [asks.column("bucket"), asks.column("part"), pa.nulls(len(known), pa.binary()), pa.array(known, pa.binary()), pa.array(values, pa.binary())]
        del group, of_model, asks
        wordscan.give_back()
        return pa.table(out, names=["bucket", "part", "keys", "known", "e"])

    def judge(group: pa.Table) -> pa.Table:
        text = group.filter(group.column("texts").is_valid())
        answers = group.filter(group.column("texts").is_null()).sort_by("bucket")
        first, keys, order, place = asked(text.column("texts").combine_chunks().flatten())
        counts = np.diff(_cuts(keys, bits))
        sizes = counts[counts > 0].tolist()
        known = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(answers.column("known"), sizes, strict=True)]
        of_key = np.full(len(keys), np.nan, "<f4")
        of_key[np.concatenate([np.zeros(0, np.uint8), *known]).view(bool)] = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(x.as_buffer(), "<f4") for x in answers.column("e"))])
        e = np.empty(len(order), "<f4")
        e[order] = of_key[place]
        n = len(e) // 2
        given = np.where(np.isnan(e[:n]), np.nan_to_num(e[n:]), e[:n])
        out = _judged(text.column("ids").combine_chunks().flatten(), first, given, span)
        wordscan.give_back()
        return pa.Table.from_batches([out])

    dealt = materialize(model.mapInArrow(deal, dealt_type), "dealt")
    found = []
    for k in range(rounds):
        chosen = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == k) if rounds > 1 else docs
        chunks = materialize(chosen.mapInArrow(pack, f"part bigint, ids {ids_type}, texts array<string>"), "chunks")
        asks = chunks.select("part", "texts").mapInArrow(ask, dealt_type)
        answers = asks.unionByName(dealt).groupBy("bucket").applyInArrow(look_up, dealt_type).select("part", "bucket", "known", "e")
        both = chunks.unionByName(answers, allowMissingColumns=True)
        found.append(materialize(both.groupBy("part").applyInArrow(judge, result), "round"))
        discard(chunks)
        release(spark)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = materialize(out, "scored")
    discard(dealt, *found)
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (constant first) of a logistic regression, by Newton steps with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        curvature = (x.T * np.maximum(p * (1 - p), 1e-9)) @ x + np.diag(ridge)
        move = np.linalg.solve(curvature, gradient)
        w -= move * min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """logistic() without the columns whose weights are below 0, so that more evidence never lowers a score."""
    used = np.arange(x.shape[1])
    w = logistic(x, y)
    while (w[1:] < 0).any():
        used = used[w[1:] >= 0]
        w = logistic(x[:, used], y)
    out = np.zeros(x.shape[1] + 1)
    out[np.append(0, used + 1)] = w
    return out


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    evidence: float = 15.0,
    span: int = 8,
    calibration_rows: int = 20_000,
    broadcast_rows: int = 8_000_000,
    broadcast_labels: int = 1_000_000,
    slice_bytes: int = 2 << 20,
    count_bytes: int = 2 << 20,
    bucket_bytes: int = 16 << 20,
    blob_bytes: int = 512,
    round_bytes: int = 256 << 20,
    rounds: int = 8,
) -> DataFrame:
    """One row for each document: id, held_out, mean_ratio, span_ratio, score, predicted.

    Labels of rows with crc32(id as text) mod folds = held_out are never read. Of the next fold's, the first
    calibration_rows in order of a hash serve for the logistic curve; all others are counted.
    """
    wordscan.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null").withColumn("fold", fold)
    known = materialize(known.where(F.col("fold") != held_out).groupBy("id", "fold").agg(F.max("toxic").alias("toxic")), "labels")
    near: Callable[[DataFrame], DataFrame] = F.broadcast if known.count() <= broadcast_labels else (lambda df: df)
    tune = known.where(F.col("fold") == (held_out + 1) % folds).orderBy(F.xxhash64("id"), "id").limit(calibration_rows)
    tune = materialize(tune.select("id", "toxic"), "tune")
    learned = known.join(F.broadcast(tune), "id", "left_anti").select("id", "toxic")
    counted = distinct_texts(rows.join(near(learned), "id"), broadcast_labels)
    model = likelihood_ratios(counted, evidence, count_bytes, bucket_bytes, blob_bytes)
    ratios, sent = text_ratios(rows, model, span, broadcast_rows, slice_bytes, bucket_bytes, round_bytes, rounds)
    if sent is not None:
        ratios = materialize(ratios, "scored")
        sent.destroy()
    discard(model)
    release(docs.sparkSession)
    sample = ratios.join(F.broadcast(tune), "id").select("id", "mean_ratio", "span_ratio", "toxic").distinct().orderBy(F.xxhash64("id"), "id", "mean_ratio", "span_ratio")
    sample = sample.limit(calibration_rows).select("mean_ratio", "span_ratio", "toxic").collect()
    y = np.array([r["toxic"] for r in sample], float)
    x = np.array([(r["mean_ratio"], r["span_ratio"]) for r in sample], float).reshape(-1, 2)
    if 0 < y.sum() < len(y):
        middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        w = rising((x - middle) / scale, y)
        slope = w[1:] / scale
        base = w[0] - float(slope @ middle)
    else:  # nothing to fit: a curve that asks for one clear expression
        n = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
        share = (n["t"] + 1) / (n["n"] + 10)
        base, slope = np.log(share / (1 - share)), np.array([0.0, 10.0])
    raw = F.lit(float(base)) + F.lit(float(slope[0])) * F.col("mean_ratio") + F.lit(float(slope[1])) * F.col("span_ratio")
    out = ratios.withColumn("held_out", F.coalesce(fold == held_out, F.lit(False))).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(raw, F.lit(30.0)), F.lit(-30.0)))))
    return out.select(F.col("id").alias(id_col), "held_out", "mean_ratio", "span_ratio", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
