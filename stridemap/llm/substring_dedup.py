"""Removal of repeated byte strings by a difference cover of text positions.

A byte is removed if some string of `length` bytes that covers it also starts anywhere else.

The difference-cover suffix algorithm sorts the suffixes at sampled positions (those with a
residue in a set that holds every difference), names them, and derives the order of all other
suffixes from the next sampled one. With residues modulo 3 and full recursion a distributed
sort moves some ten times the text in every round. Only prefixes of `length` bytes matter
here, so the cover is one modulo 133 (twelve residues, in which every difference occurs),
and two rounds do, without triples or recursion:

1. Sampled prefixes. At every position whose residue (from its document's start) is in the
   cover, the prefix of 68 = 200 - 132 bytes gets a name. Names are sorted, and those that
   occur twice are kept. If strings of 200 bytes at i and j are equal, some shift below 133
   takes both to sampled positions, and both of those have the same repeated name.
2. Remaining suffixes. Every start at most 132 bytes before a kept sample is sorted by its own
   prefix of 200 bytes, and neighbours in that order are compared.

Prefixes are named by 64-bit hashes (40 bits and the bucket's for the samples, where a
collision only costs work), so that a sort compares numbers. A hash is not the string, so what is removed is confirmed:
in each run of repeated starts those that cover all its bytes (every `length`-th and the last) are looked for in all texts, and
count only if another place has the same name and the same SHA-256 of its bytes. If one does not, all starts of its run are
looked for, and those without a partner are dropped.

Texts lie in chunks of some MB, which never move for the sorts: a chunk sends its sorted
distinct names in bulk, dealt out by their top bits; each bucket sends back one bit for each
name. A name that is in every text is sent once by each chunk, so no bucket is larger than
the others by more than one entry for each chunk. The number of such blobs is that of chunks times that of buckets; where they would be shorter
than `blob_bytes` on average, names go as rows instead, grouped and joined by Spark, so that what is sent stays in proportion to the
text. Of equal texts one is in a chunk; only texts with copies are shuffled for that. What buckets send back (a bit for each name) is broadcast to the chunks
up to `broadcast_bytes`, and beyond that joined by a shuffle, which then moves the chunks too.

Cases: null text is empty; a text shorter than `length` bytes loses nothing; repeated rows are
documents of their own, so texts of at least `length` bytes that occur twice are removed whole;
matches may overlap themselves and never cross documents. An empty table gives no rows.
Columns other than id and text are not read. One text must fit in a worker's memory some forty times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemap.llm import wordscan
from stridemap.session import discard, materialize, release


def difference_cover(q: int) -> np.ndarray:
    """q + 1 residues modulo q*q + q + 1, q prime, in which every non-zero difference occurs once:
    the exponents of a generator of GF(q**3) whose powers lie in a plane."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, found = (1, 0, 0), []  # coefficients of 1, x, x*x; x**3 = a x*x + b x + c
                for k in range(v):
                    if x[2] == 0:
                        found.append(k)
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
                    return np.array(found)
    raise ValueError("q must be prime")


#: Low bytes of a name that are sent; the top bits are the bucket's number, of 8 bits or more.
SAMPLE_WIDTH, START_WIDTH = 5, 7


class Cover:
    """A difference cover that suits strings of `length` bytes."""

    def __init__(self, length: int):
        sizes = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31) if 3 * (q * q + q + 1) <= 2 * length + 1]
        if not sizes:
            raise ValueError("length must be 10 or more")
        self.length, q = length, sizes[-1]
        self.modulus = q * q + q + 1
        self.short = length - self.modulus + 1
        self.member = np.zeros(self.modulus, bool)
        self.member[difference_cover(q)] = True


class Chunk:
    """Texts in one byte array."""

    def __init__(self, row: dict, cover: Cover, name_bits: int):
        self.data, self.offsets, self.cover = np.frombuffer(zstandard.decompress(row["data"]), np.uint8), np.frombuffer(row["offsets"], np.int64), cover
        self.prefix = wordscan.prefix_hash(self.data)
        self.spare = np.uint64(64 - name_bits)

    def samples(self) -> np.ndarray:
        cover, out = self.cover, []
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            n = b - a - cover.short + 1
            if n > 0:
                own = np.flatnonzero(cover.member)
                tiled = (own[None, :] + np.arange(0, n, cover.modulus)[:, None]).ravel()
                out.append(tiled[tiled < n] + a)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def candidates(self, samples: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Starts of whole strings at most modulus - 1 before a kept sample."""
        at = samples[kept]
        text = np.searchsorted(self.offsets, at, "right") - 1
        low = np.maximum(at - self.cover.modulus + 1, self.offsets[text])
        high = np.minimum(at, self.offsets[text + 1] - self.cover.length) + 1
        some = high > low
        change = np.zeros(len(self.data) + 2, np.int32)
        np.add.at(change, low[some], 1)
        np.add.at(change, high[some], -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    def names(self, starts: np.ndarray, length: int) -> np.ndarray:
        return wordscan.span_hash(self.prefix, starts, starts + length) >> self.spare << self.spare

    def digests(self, starts: np.ndarray) -> list[bytes]:
        raw = memoryview(self.data)
        return [hashlib.sha256(raw[a : a + self.cover.length]).digest() for a in starts.tolist()]


def as_runs(starts: np.ndarray) -> np.ndarray:
    """Rows (first, after the last) of runs of consecutive starts."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return np.column_stack((starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)] + 1))


def from_runs(runs: np.ndarray, step: int = 1) -> np.ndarray:
    """Every step-th start of each run, and its last."""
    sizes = -(-(runs[:, 1] - runs[:, 0]) // step)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = np.repeat(runs[:, 0], sizes) + at * step
    return np.unique(np.concatenate((found, runs[:, 1] - 1))) if step > 1 else found


def dealt(names: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, sorted distinct names as `width` low bytes each, bits that tell which occur twice) by top bits."""
    distinct, counts = np.unique(names, return_counts=True)
    cuts = _cuts(distinct, bits)
    raw = distinct.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    twice = counts > 1
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[bucket], cuts[bucket + 1]
        yield bucket, raw[a:b].tobytes(), np.packbits(twice[a:b]).tobytes()


def _edges(bits: int) -> np.ndarray:
    """Lower bounds of the buckets."""
    return np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)


def flags_of(names: np.ndarray, masks: list[dict] | None, known: list[int] | None, bits: int) -> np.ndarray:
    """For each name (in the order given), whether it was found: its bucket's mask says so, or it is among the known."""
    distinct, place = np.unique(names, return_inverse=True)
    if known is not None:
        return np.isin(distinct, np.array(known, np.int64).view(np.uint64))[place]
    flags = np.zeros(len(distinct), bool)
    cuts = _cuts(distinct, bits)
    for mask in masks or ():
        a, b = cuts[mask["bucket"]], cuts[mask["bucket"] + 1]
        flags[a:b] = np.unpackbits(np.frombuffer(mask["repeated"], np.uint8), count=b - a).astype(bool)
    return flags[place]


def _cuts(distinct: np.ndarray, bits: int) -> np.ndarray:
    return np.append(np.searchsorted(distinct, _edges(bits)), len(distinct))


#: chunk -1 asks for names.
BLOB = "bucket int, chunk bigint, names binary, twice binary"
ROW = "chunk bigint, name bigint, twice boolean"


def answered(sent: DataFrame, width: int, as_rows: bool, asked: bool = False) -> DataFrame:
    """(chunk, masks, known): for each chunk which of its names are repeated, or with `asked` which ones chunk -1 has too. As
    masks for each of its buckets that has any, or as a list of the names."""
    if as_rows:
        here = sent.where("chunk >= 0")
        if asked:
            wanted = sent.where("chunk < 0").select("name").distinct()
        else:
            wanted = here.groupBy("name").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("name")
        found = here.join(wanted, "name", "left_semi").groupBy("chunk").agg(F.collect_list("name").alias("known"))
        return found.select("chunk", F.lit(None).cast("array<struct<bucket:int,repeated:binary>>").alias("masks"), "known")

    def settle(group: pa.Table) -> pa.Table:
        chunks = group.column("chunk").to_pylist()
        parts = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in group.column("names").to_pylist()]
        sizes = [len(x) for x in parts]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :width] = np.concatenate(parts)
        flat = wide.view("<u8").ravel()
        ends = np.cumsum(sizes)
        if asked:
            ours = np.repeat(np.array(chunks) < 0, sizes)
            flags = np.isin(flat, flat[ours])
        else:
            flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(group.column("twice").to_pylist(), sizes, strict=True)])
            order = np.argsort(flat, kind="stable")
            same = flat[order[1:]] == flat[order[:-1]]  # neighbours in sorted order
            flags[order[1:][same]] = True
            flags[order[:-1][same]] = True
        rows = [(c, np.packbits(flags[e - n : e]).tobytes()) for c, n, e in zip(chunks, sizes, ends.tolist(), strict=True) if c >= 0 and flags[e - n : e].any()]
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "repeated": pa.array([r[1] for r in rows], pa.binary())})

    found = sent.groupBy("bucket").applyInArrow(settle, "chunk bigint, bucket int, repeated binary")
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "repeated")).alias("masks"))
    return found.select("chunk", "masks", F.lit(None).cast("array<bigint>").alias("known"))


def pack_chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows (key, text, copies) as rows of about chunk_bytes: chunk, n_bytes, keys, copies, offsets, data (compressed)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal part
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = wordscan.utf8(table.column("text"))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([table.column("key").to_pylist()], pa.list_(pa.string())), pa.array([table.column("copies").to_pylist()], pa.list_(pa.int64())), pa.array([offsets.astype("<i8").tobytes()], pa.binary()), pa.array([zstandard.compress(data.tobytes(), 1)], pa.binary())],
                names=["chunk", "n_bytes", "keys", "copies", "offsets", "data"],
            )
            part += 1
            return out

        for batch in wordscan.slices(batches, "text", chunk_bytes // 8):
            n = wordscan.utf8(batch.column("text"))[1][-1]
            if held and size + n > chunk_bytes:
                yield flush()
                held, size = [], 0
            held.append(batch)
            size += n
        if held:
            yield flush()

    return rows.mapInArrow(pack, "chunk bigint, n_bytes bigint, keys array<string>, copies array<bigint>, offsets binary, data binary")


def distinct_texts(rows: DataFrame, broadcast_rows: int) -> DataFrame:
    """(key, text, copies) of rows (text): each text once, with its hash. Only texts that have copies are shuffled."""
    keyed = rows.select(F.sha2("text", 256).alias("key"), "text")
    copied = materialize(keyed.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "copied")
    near = F.broadcast(copied) if copied.count() <= broadcast_rows else copied
    once = keyed.join(near.select("key"), "key", "left_anti").select("key", "text", F.lit(1).cast("bigint").alias("copies"))
    return once.unionByName(keyed.join(near, "key").dropDuplicates(["key"]))


def repeated_spans(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    chunk_bytes: int = 3 << 20,
    bucket_bytes: int = 8 << 20,
    blob_bytes: int = 256,
    broadcast_rows: int = 1_000_000,
    broadcast_bytes: int = 64 << 20,
    name_bits: int = 64,
    with_kept: bool = False,
) -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, spans (removed [start, end) in bytes),
    kept_sha256, and the kept bytes if asked for. Names of fewer bits cost work, not results."""
    spark = docs.sparkSession
    wordscan.bound_batches(spark)
    cover = Cover(length)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    distinct = distinct_texts(rows.where(F.octet_length("text") >= length), broadcast_rows)
    chunks = materialize(pack_chunks(distinct, chunk_bytes), "chunks")
    release(spark)
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    # buckets of at most about bucket_bytes of names, if every start were a candidate in the second round
    bits = max(8, (int(total * cover.member.mean() * SAMPLE_WIDTH) // bucket_bytes).bit_length())
    more_bits = max(8, (total * START_WIDTH // (2 * bucket_bytes)).bit_length())
    sample_rows = int(chunk_bytes * cover.member.mean() * SAMPLE_WIDTH) >> bits < blob_bytes
    start_rows = (chunk_bytes * START_WIDTH // 4) >> more_bits < blob_bytes
    kind = lambda as_rows: ROW if as_rows else BLOB

    def send_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, cover, name_bits)
            yield from _sent(row["chunk"], chunk.names(chunk.samples(), cover.short), bits, SAMPLE_WIDTH, sample_rows)

    def starts_of(row: dict) -> tuple[Chunk, np.ndarray]:
        chunk = Chunk(row, cover, name_bits)
        samples = chunk.samples()
        kept = flags_of(chunk.names(samples, cover.short), row["masks"], row["known"], bits)
        return chunk, chunk.candidates(samples, kept)

    def send_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk, starts = starts_of(row)
            yield from _sent(row["chunk"], chunk.names(starts, length), more_bits, START_WIDTH, start_rows)

    def keep_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk, starts = starts_of(row)
            runs = as_runs(starts[flags_of(chunk.names(starts, length), row["more_masks"], row["more_known"], more_bits)])
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([runs.astype("<i8").tobytes()], pa.binary())], names=["chunk", "runs"])

    def runs_of(row: dict) -> np.ndarray:
        return np.frombuffer(row["runs"], "<i8").reshape(-1, 2)

    def near(df: DataFrame) -> DataFrame:
        """A written table by chunk, to be broadcast if it is small enough."""
        size = [F.octet_length(c) if k == "binary" else F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x["repeated"]) + 48) if k.startswith("array<struct") else 8 * F.size(c) if k.startswith("array") else F.lit(8) for c, k in df.dtypes]
        weight = sum((F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("bigint") for x in size), F.lit(0))
        return F.broadcast(df) if (df.agg(F.sum(weight).alias("n")).first()["n"] or 0) <= broadcast_bytes else df

    body = chunks.select("chunk", "offsets", "data")
    first = materialize(answered(body.mapInArrow(send_samples, kind(sample_rows)), SAMPLE_WIDTH, sample_rows), "names")
    release(spark)
    second = materialize(answered(body.join(near(first), "chunk").mapInArrow(send_starts, kind(start_rows)), START_WIDTH, start_rows), "starts")
    release(spark)
    both = body.join(near(first), "chunk").join(near(second).withColumnsRenamed({"masks": "more_masks", "known": "more_known"}), "chunk")
    runs = materialize(both.mapInArrow(keep_starts, "chunk bigint, runs binary"), "runs")
    discard(first, second)
    release(spark)

    def without_partner(runs: DataFrame, step: int) -> DataFrame:
        """(chunk, at): of every step-th start and the last of each run, those whose string is nowhere else."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                chunk, at = Chunk(row, cover, name_bits), from_runs(runs_of(row), step)
                names = chunk.names(at, length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["chunk"])), pa.array(at), pa.array(names), pa.array(chunk.digests(at), pa.binary())], names=["chunk", "at", "name", "digest"])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _sent(-1, batch.column("name").to_numpy().view(np.uint64), more_bits, START_WIDTH, start_rows)

        def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                yield from _sent(row["chunk"], Chunk(row, cover, name_bits).names(from_runs(runs_of(row)), length), more_bits, START_WIDTH, start_rows)

        def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                chunk, at = Chunk(row, cover, name_bits), from_runs(runs_of(row))
                names = chunk.names(at, length)
                asked = flags_of(names, row["masks"], row["known"], more_bits)
                found = list(zip(names[asked].view(np.int64).tolist(), chunk.digests(at[asked]), strict=True))
                count: dict[tuple[int, bytes], int] = {}
                for x in found:
                    count[x] = count.get(x, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in count], pa.int64()), pa.array([x[1] for x in count], pa.binary()), pa.array(list(count.values()), pa.int64())], names=["name", "digest", "n"])

        probes = materialize(body.join(near(runs), "chunk").mapInArrow(probe, "chunk bigint, at bigint, name bigint, digest binary"), "probes")
        wanted = probes.select("name").distinct().mapInArrow(ask, kind(start_rows))
        offered = body.join(near(all_runs), "chunk").mapInArrow(offer, kind(start_rows))
        asked = materialize(answered(wanted.unionByName(offered), START_WIDTH, start_rows, asked=True), "asked")
        release(spark)
        shown = body.join(near(all_runs), "chunk").join(near(asked), "chunk").mapInArrow(show, "name bigint, digest binary, n bigint")
        partners = shown.groupBy("name", "digest").agg(F.sum("n").alias("n")).where("n > 1")
        alone = materialize(probes.join(partners, ["name", "digest"], "left_anti").select("chunk", "at"), "alone")
        discard(probes, asked)
        release(spark)
        return alone

    def affected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            own, at = runs_of(row), np.array(row["bad"], np.int64)
            hit = np.unique(np.searchsorted(own[:, 0], at, "right") - 1)
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([own[hit].tobytes()], pa.binary())], names=["chunk", "runs"])

    all_runs = runs
    bad = without_partner(runs, length)
    if bad.limit(1).count():  # equal hashes of unlike strings
        worse = runs.join(bad.groupBy("chunk").agg(F.collect_list("at").alias("bad")), "chunk")
        again = materialize(worse.mapInArrow(affected, "chunk bigint, runs binary"), "affected")
        bad = without_partner(again, 1)
        discard(again)
    bad = materialize(bad.groupBy("chunk").agg(F.collect_list("at").alias("bad")), "bad")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            offsets = np.frombuffer(row["offsets"], np.int64)
            change = np.zeros(int(offsets[-1]) + 1, np.int32)
            data = None
            if row["runs"]:
                data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
                own = runs_of(row)
                if row["bad"]:
                    own = as_runs(np.setdiff1d(from_runs(own), np.array(row["bad"], np.int64)))
                np.add.at(change, own[:, 0], 1)
                np.add.at(change, own[:, 1] - 1 + length, -1)
            covered = np.cumsum(change[:-1]) > 0
            out: list[tuple] = []
            for key, copies, a, b in zip(row["keys"], row["copies"], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = covered[a:b] if copies == 1 else np.ones(b - a, bool)
                if own.any():
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).reshape(-1, 2)
                    rest = b"" if own.all() else data[a:b][~own].tobytes()
                    out.append((key, int(own.sum()), [{"start": s, "end": e} for s, e in edges.tolist()], hashlib.sha256(rest).hexdigest(), rest if with_kept else None))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "n_removed", "spans", "kept_sha256", "kept"])

    full = chunks.join(near(runs), "chunk", "left").join(near(bad), "chunk", "left")
    removed = materialize(full.mapInArrow(judge, "key string, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary"), "removed")
    discard(chunks, runs, bad)
    release(spark)
    whole = rows.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("key"), *([F.encode("text", "UTF-8").alias("whole")] if with_kept else []))
    out = whole.join(removed.withColumnRenamed("kept_sha256", "rest_sha256"), "key", "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("rest_sha256", "key").alias("kept_sha256"),
        *([F.coalesce("kept", "whole").alias("kept")] if with_kept else []),
    )
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _sent(chunk: int, names: np.ndarray, bits: int, width: int, as_rows: bool) -> Iterator[pa.RecordBatch]:
    if as_rows:
        distinct, counts = np.unique(names, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), chunk)), pa.array(distinct.view(np.int64)), pa.array(counts > 1)], names=["chunk", "name", "twice"])
        return
    parts = list(dealt(names, bits, width))
    if parts:
        columns = list(zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
            names=["bucket", "chunk", "names", "twice"],
        )
