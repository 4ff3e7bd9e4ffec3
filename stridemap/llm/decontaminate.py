"""Benchmark decontamination with an FM-index for each shard of training text.

Words are lower-cased (A-Z) runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. A test phrase is a window of
`window` consecutive words of a benchmark item; an item of fewer words, but not none, is one phrase.

Every shard (a run of documents of some MB) becomes a sequence over the alphabet of the
phrases' words; each run of other words, and each document bound, is one separator, which no
phrase contains. Its suffix array gives a Burrows-Wheeler transform, held as a wavelet matrix.
All phrases are searched backwards at once; occurrences are located by walking to suffix
positions sampled at every 16th place and at run starts, and overlapping ones merge to spans.

The index of a shard covers the words that the phrases have, and the separators; words that no phrase has are not in it.

The phrases are the query set. They are taken in blocks of at most `block_bytes` of text (an item is never cut). One block is searched in one pass over
the documents, which stay where they are: there is no shuffle. Further blocks are a pass each: the driver makes one block, the
executors hold that one alone, and its hits are written before the next is made; at the end the hits of each document are merged.

Cases: null or empty text has no words and no hits; repeated rows are judged alike; an item
without words is in no document; an empty benchmark hits nothing; a benchmark item_id that
repeats counts once; null item ids are ignored. Columns of the documents other than id and text are not
read. A document of any length is one row of one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemap.llm import wordscan
from stridemap.session import materialize

SAMPLE = 16


class PhraseSet:
    """The windows of some benchmark items as sequences of word numbers, 1 and up."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        data, offsets = wordscan.utf8(pa.array([t or "" for _, t in items], pa.large_string()))
        mapped, starts, ends, first = wordscan.words(data, offsets, wordscan.alnum_table())
        found = wordscan.word_array(mapped, starts, ends)
        encoded = found.dictionary_encode()
        self.vocabulary = encoded.dictionary
        ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        phrases: dict[tuple[int, ...], set[str]] = {}
        for k, (name, _) in enumerate(items):
            own = ids[first[k] : first[k + 1]].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                phrases.setdefault(tuple(own[i : i + window]), set()).add(name)
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.words = np.zeros((len(phrases), window), np.int64)
        for k, p in enumerate(phrases):
            self.words[k, : len(p)] = p
        self.names = [name for name, _ in items]
        number = {name: k for k, name in enumerate(self.names)}
        owners = [sorted(number[x] for x in own) for own in phrases.values()]
        self.owner_first = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([x for own in owners for x in own], np.int64)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence whose zeros are separators, each unlike every other and
    smaller than any word, in the order of their places. Prefix doubling; places that are
    already told apart are not sorted again."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    zeros = symbols == 0
    n_zero = int(zeros.sum())
    counts = np.bincount(symbols)
    counts[0] = 0
    begin = n_zero + np.concatenate(([0], np.cumsum(counts)[:-1]))
    rank = begin[symbols]  # the rank of a group is the place of its first member
    rank[zeros] = np.arange(n_zero)
    order = np.argsort(rank, kind="stable")
    group = rank[order]
    tied = np.zeros(n, bool)
    same = group[1:] == group[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    places = np.flatnonzero(tied)
    step = 1
    while len(places):
        at = order[places]
        following = np.minimum(at + step, n)
        next_rank = np.where(following < n, rank[np.minimum(following, n - 1)], -1)
        key = rank[at] * (n + 1) + next_rank + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[places] = at  # groups are runs of places, and stay in their run
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        heads = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[at] = heads
        tied = np.zeros(len(at), bool)
        tied[1:] |= ~fresh[1:]
        tied[:-1] |= ~fresh[1:]
        places = places[tied]
        step *= 2
    return order


class FMIndex:
    """Burrows-Wheeler transform of a separated word sequence, as a wavelet matrix."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        """symbols: 0 (separator, also the last symbol) to alphabet - 1."""
        n = len(symbols)
        order = suffix_array(symbols)
        self.transform = symbols[order - 1]  # place 0 takes the last symbol, a separator
        totals = np.bincount(symbols, minlength=alphabet)
        self.first = np.concatenate(([0], np.cumsum(totals)))
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.n_zero: list[int] = []
        current = self.transform
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.n_zero.append(n - int(ones[-1]))
            flag = bit.astype(bool)
            current = np.concatenate((current[~flag], current[flag]))
        self.start = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))
        starts_run = self.transform == 0
        sampled = starts_run | (order % SAMPLE == 0)
        self.sampled_before = np.concatenate(([0], np.cumsum(sampled)))
        self.sampled = sampled
        self.positions = order[sampled]

    def _descend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][row]
            row = np.where((symbol >> level) & 1, self.n_zero[k] + ones, row - ones)
        return row

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """first[symbol] + number of that symbol before row."""
        return self.first[symbol] + self._descend(symbol, row) - self.start[symbol]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of suffixes that begin with each phrase (rows of words, padded)."""
        low = np.zeros(len(words), np.int64)
        high = np.full(len(words), len(self.transform), np.int64)
        for k in range(words.shape[1] - 1, -1, -1):
            live = np.flatnonzero((k < lengths) & (high > low))
            if len(live):
                symbol = words[live, k]
                low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in those rows."""
        at, moved = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[at])
        while len(live):
            at[live] = self.step(self.transform[at[live]], at[live])
            moved[live] += 1
            live = live[~self.sampled[at[live]]]
        return self.positions[self.sampled_before[at]] + moved


def search_shard(data: np.ndarray, offsets: np.ndarray, phrases: PhraseSet) -> dict:
    """Judge a run of documents: words, hit words, items and merged spans (in words and bytes) for each."""
    n_docs = len(offsets) - 1
    mapped, starts, ends, first = wordscan.words(data, offsets, wordscan.alnum_table())
    n_words = len(starts)
    change = np.zeros(n_words + 1, np.int64)
    items: dict[int, set[str]] = {}
    if len(phrases.lengths) and n_words:
        found = wordscan.word_array(mapped, starts, ends)
        ids = pc.index_in(found, phrases.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # a separator before the first word of each document, then one for each run of other words
        symbols = np.insert(ids, first[:-1], 0)
        word_of = np.insert(np.arange(n_words), first[:-1], -1)
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        symbols, word_of = np.append(symbols[keep], 0), np.append(word_of[keep], -1)
        index = FMIndex(symbols, len(phrases.vocabulary) + 1)
        low, high = index.search(phrases.words, phrases.lengths)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        word = word_of[index.locate(rows)]
        np.add.at(change, word, 1)
        np.add.at(change, word + phrases.lengths[which], -1)
        doc = np.searchsorted(first, word, "right") - 1
        for d, k in np.unique(np.stack((doc, which)), axis=1).T.tolist():
            own = phrases.owners[phrases.owner_first[k] : phrases.owner_first[k + 1]].tolist()
            items.setdefault(d, set()).update(phrases.names[x] for x in own)
    hit = np.cumsum(change[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    at_start = hit.copy()
    at_start[1:] &= ~hit[:-1]
    at_end = hit.copy()
    at_end[:-1] &= ~hit[1:]
    bounds = first[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < n_words)]
    at_start[bounds] = hit[bounds]
    at_end[bounds - 1] = hit[bounds - 1]
    span_first, span_last = np.flatnonzero(at_start), np.flatnonzero(at_end)
    span_doc = np.searchsorted(first, span_first, "right") - 1
    spans: dict[int, list[dict]] = {}
    for d, u, v, a, b in zip(span_doc.tolist(), span_first.tolist(), span_last.tolist(), starts[span_first].tolist(), ends[span_last].tolist(), strict=True):
        spans.setdefault(d, []).append({"start": a - int(offsets[d]), "end": b - int(offsets[d]), "first": u - int(first[d]), "last": v - int(first[d])})
    return {
        "n_words": np.diff(first),
        "n_hit": total[first[1:]] - total[first[:-1]],
        "items": [sorted(items.get(d, ())) for d in range(n_docs)],
        "spans": [spans.get(d, []) for d in range(n_docs)],
    }


def merged_spans(spans: list[dict]) -> list[dict]:
    """Spans of one document as few as they can be: those that share a word or stand side by side become one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"] + 1:
            if s["last"] > out[-1]["last"]:
                out[-1] |= {"last": s["last"], "end": s["end"]}
        else:
            out.append(dict(s))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
SPAN_TYPE = "array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>"


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[PhraseSet]:
    """The benchmark as phrase sets of at most about block_bytes of text each (an item is never cut)."""
    rows = (
        benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
        .distinct()
        .orderBy("name", "text")
    )
    block: list[tuple[str, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > block_bytes:
            yield PhraseSet(block, window)
            block, size = [], 0
        block.append((row["name"], row["text"]))
        size += len(row["text"])
    if block:
        yield PhraseSet(block, window)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shard_bytes: int = 2 << 20,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row for each document: id, n_words, n_hit, items (sorted strings) and spans, the merged
    removal spans as [start, end) in bytes of the UTF-8 text, with their first and last word."""
    wordscan.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    block = next(blocks, None) or PhraseSet([], window)
    following = next(blocks, None)
    if following is None:
        found, _ = searched(rows, block, shard_bytes)
        return found.drop("mark").withColumnRenamed("id", id_col)
    # several blocks: what each finds is written, and no executor holds two
    marked = rows.withColumn("mark", F.xxhash64("text"))
    parts: list[DataFrame] = []
    while block is not None:
        found, sent = searched(marked, block, shard_bytes)
        if not parts:  # the first pass also counts the words of all documents
            parts.append(materialize(found, "found"))
        else:
            parts.append(materialize(found.where("n_hit > 0"), "found"))
        sent.destroy()
        block, following = following, next(blocks, None)
    hits = parts[0].where("n_hit > 0")
    for part in parts[1:]:
        hits = hits.unionByName(part)
    # rows of one id and text are alike, so this pair is a key; null ids and texts are values of it
    key = [F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), F.col("id").isNull().alias("unnamed"), "mark"]
    own = hits.select(*key, "items", "spans").groupBy("name", "unnamed", "mark").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("all_spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged_spans(x) for x in batch.column("all_spans").to_pylist()]
            hit = [sum(s["last"] - s["first"] + 1 for s in x) for x in spans]
            kept = [batch.column(c) for c in ("name", "unnamed", "mark", "all_items")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, SPANS), pa.array(hit, pa.int64())], names=["name", "unnamed", "mark", "all_items", "all_spans", "all_hit"])

    own = own.mapInArrow(merge, f"name string, unnamed boolean, mark bigint, all_items array<string>, all_spans {SPAN_TYPE}, all_hit bigint")
    base = parts[0].select("id", "n_words", *key)
    return base.join(own, ["name", "unnamed", "mark"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("all_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("all_items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("all_spans", F.array().cast(SPAN_TYPE)).alias("spans"),
    )


def searched(rows: DataFrame, block: PhraseSet, shard_bytes: int) -> tuple[DataFrame, Broadcast]:
    """(id, mark, n_words, n_hit, items, spans) of rows (id, text, perhaps mark) for one block, and what was sent for it."""
    sent = rows.sparkSession.sparkContext.broadcast(block)
    has_mark = "mark" in rows.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for batch in wordscan.slices(batches, "text", shard_bytes):
            out = search_shard(*wordscan.utf8(batch.column("text")), phrases)
            mark = batch.column("mark") if has_mark else pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), mark, pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], SPANS)],
                names=["id", "mark", "n_words", "n_hit", "items", "spans"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"id {kind}, mark bigint, n_words bigint, n_hit bigint, items array<string>, spans {SPAN_TYPE}"), sent
