"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct shingles of `k` words (lower-cased A-Z runs of
[^\\x20\\x09-\\x0D]; with fewer words, the whole sequence is one shingle). Documents are linked if
100 * |intersection| >= percent * |union|; components are what links connect.

1. Equal sets (by a 128-bit hash) form a class, so a group of copies is one row from here on.
2. Each class has `bands` bands of `rows` MinHash values. With 24 bands of 6, a pair at a similarity of 0.85
   shares no band with probability 1.2e-5, one at 0.9 with 2e-8.
3. The MinHash values are folded into an odd sketch: each value flips one of 512 bits. The
   exclusive or of two sketches holds the bits of values that differ; a population count that
   stands for a similarity far below the threshold (seven standard deviations: 1e-12) drops a pair. A second
   sketch folds the set itself: its population count never exceeds the number of shingles that
   only one of the two has, so it drops no linked pair, and for sets of some hundred shingles it drops nearly all others.
4. What remains is confirmed on the full sets.

No pairs are made within a band's bucket. In each of two rounds every bucket with more than one component names hubs. The first hub is the most
central member, the one whose buckets are largest: in a group of near copies it is linked with most. All members are compared with it. Then about
four members of its component follow, which only those outside are compared with. Then hubs leave the bucket, since all their links
there that matter are known, and components are joined: a round's comparisons are the members times a constant.

What is still in buckets with two components is like others without being linked, such as texts with the same long boilerplate. It is
joined by prefixes, which is exact: with shingles in a common order, rarest first, two linked sets share a shingle within their first
n - ceil(t n) + 1, and within the first n - ceil(2 t n / (1 + t)) + 1 of the smaller one. Texts that share boilerplate but are not linked have that many
shingles of their own, which no other text has, so they meet nothing: the join is in proportion to the members. Lengths and the place of the first common shingle bound the overlap
before a pair is made, and of each shingle only members outside its most frequent component are joined with the others. (Sets made of the same
few shingles in many combinations can still make many pairs; that is no band's but the problem's own worst case, and no cap is set on it.)

Cases: null, empty and blank texts have empty sets, linked with nothing; repeated rows are
equal sets, their component is their least id; ids must be comparable; rows with null ids take part
in no link and are components of their own (null). Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemap.llm import wordscan
from stridemap.operators.components import connected_components
from stridemap.session import discard, materialize, release

SKETCH_BITS = 512
LANES = SKETCH_BITS // 64


class Hasher:
    """MinHash values by odd multipliers over mixed 32-bit shingle hashes."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.n = bands, rows, bands * rows
        rng = np.random.Generator(np.random.PCG64(7))
        self.times = rng.integers(0, 1 << 31, self.n, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, self.n, dtype=np.uint64).astype(np.uint32)[:, None]
        self.salt = rng.integers(0, 1 << 63, (2, self.n), dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.n, 0xFFFFFFFF, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for a in range(0, len(short), 2048):
            part = self.times * short[None, a : a + 2048]
            part += self.plus
            np.minimum(low, part.min(axis=1), out=low)
        return low

    def bands_of(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band (rows: documents)."""
        mixed = wordscan.mix(minima.astype(np.uint64) ^ self.salt[0]).reshape(len(minima), self.bands, self.rows)
        odd = (np.arange(self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return wordscan.mix((mixed * odd).sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))

    def odd_sketches(self, minima: np.ndarray) -> np.ndarray:
        """SKETCH_BITS parities as LANES 64-bit lanes for each document."""
        bit = (wordscan.mix(minima.astype(np.uint64) ^ self.salt[1]) % np.uint64(SKETCH_BITS)).astype(np.int64)
        place = bit + np.arange(len(minima))[:, None] * SKETCH_BITS
        parity = (np.bincount(place.ravel(), minlength=len(minima) * SKETCH_BITS) & 1).astype(np.uint8)
        return np.packbits(parity.reshape(len(minima), SKETCH_BITS), axis=1, bitorder="little").view("<i8")

    def set_sketch(self, shingles: np.ndarray) -> np.ndarray:
        """SKETCH_BITS parities of a set as LANES 64-bit lanes."""
        parity = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
        return np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8")

    def most_bits(self, percent: int, sigmas: float = 7) -> int:
        """The population count that a pair at the threshold exceeds by chance of so many standard deviations."""
        away = 1 - percent / 100
        flips = 2 * (self.n * away + sigmas * (self.n * away * (1 - away)) ** 0.5)
        mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
        return int(mean + sigmas * (mean / 2) ** 0.5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles."""
    mapped, starts, ends, first = wordscan.words(data, offsets, wordscan.space_table())
    word = wordscan.span_hash(wordscan.prefix_hash(mapped), starts, ends)
    factors = [np.uint64(pow(0xBF58476D1CE4E5B9, j + 1, 1 << 64)) for j in range(k)]
    whole = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j, factor in enumerate(factors):
        whole += word[j : len(word) - k + 1 + j] * factor
    whole = wordscan.mix(whole)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            some = (word[a:b] * np.array(factors[: b - a])).sum(dtype=np.uint64, keepdims=True)
            yield wordscan.mix(some + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signatures(docs: DataFrame, k: int, hasher: Hasher, slice_bytes: int) -> DataFrame:
    """(id, n_shingles, set_a, set_b, bands, odd) of rows (id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordscan.slices(batches, "text", slice_bytes):
            n = batch.num_rows
            sizes, hashes, minima = np.zeros(n, np.int64), np.zeros((2, n), np.uint64), np.zeros((n, hasher.n), np.uint32)
            parity = np.zeros((n, LANES), np.int64)
            for d, own in enumerate(shingle_sets(*wordscan.utf8(batch.column("text")), k)):
                if len(own):
                    sizes[d] = len(own)
                    hashes[0, d] = own.sum(dtype=np.uint64)
                    hashes[1, d] = wordscan.mix(own ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                    minima[d] = hasher.minima(own)
                    parity[d] = hasher.set_sketch(own)
            hashes = wordscan.mix(hashes + sizes.astype(np.uint64)).view(np.int64)
            lists = lambda x, width: pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(x.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes), pa.array(hashes[0]), pa.array(hashes[1]), lists(hasher.bands_of(minima), hasher.bands), lists(np.hstack((hasher.odd_sketches(minima), parity)), 2 * LANES)],
                names=["id", "n_shingles", "set_a", "set_b", "bands", "odd"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, odd array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, slice_bytes: int, broadcast_ids: int) -> DataFrame:
    """(id, items) of the wanted ids: the sorted hashes of their sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordscan.slices(batches, "text", slice_bytes):
            found = [x.tobytes() for x in shingle_sets(*wordscan.utf8(batch.column("text")), k)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "items"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.join(_near(wanted, broadcast_ids), "id", "left_semi").mapInArrow(sets, f"id {kind}, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, broadcast_ids: int) -> DataFrame:
    """Those of the pairs (lo, hi) of ids that are linked, from their full sets."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["lo", "hi"])

    kind = sets.schema["id"].dataType.simpleString()
    wanted = pairs.select(F.col("lo").alias("id")).union(pairs.select(F.col("hi").alias("id"))).distinct()
    needed = sets.join(F.broadcast(wanted) if pairs.count() <= broadcast_ids else wanted, "id", "left_semi")
    left = pairs.join(needed.select(F.col("id").alias("lo"), F.col("items").alias("a")), "lo")
    rows = left.join(needed.select(F.col("id").alias("hi"), F.col("items").alias("b")), "hi").select("lo", "hi", "a", "b")
    return rows.mapInArrow(test, f"lo {kind}, hi {kind}")


def alike(pairs: DataFrame, sketches: DataFrame, hasher: Hasher, percent: int) -> DataFrame:
    """Those of the pairs (lo, hi) that sizes and sketches (c, n_shingles, odd) don't rule out."""
    left = sketches.select(F.col("c").alias("lo"), F.col("n_shingles").alias("n_lo"), F.col("odd").alias("odd_lo"))
    right = sketches.select(F.col("c").alias("hi"), F.col("n_shingles").alias("n_hi"), F.col("odd").alias("odd_hi"))
    both = pairs.join(left, "lo").join(right, "hi")
    apart = [sum((F.bit_count(F.col("odd_lo")[j].bitwiseXOR(F.col("odd_hi")[j])) for j in range(a, a + LANES)), F.lit(0)) for a in (0, LANES)]
    near = (100 * F.least("n_lo", "n_hi") >= percent * F.greatest("n_lo", "n_hi")) & (apart[0] <= hasher.most_bits(percent))
    return both.where(near & ((100 + percent) * apart[1] <= (100 - percent) * (F.col("n_lo") + F.col("n_hi")))).select("lo", "hi")


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (lo, hi) of members (c, part) of different parts that may be linked: all that are, and few others. sets: (id, items)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                items = np.frombuffer(batch.column("items")[k].as_buffer(), np.int64)
                own = [pa.array([batch.column(c)[k].as_py()] * len(items), batch.schema.field(c).type) for c in ("c", "part")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(items), len(items))), pa.array(items)], names=["c", "part", "n", "item"])

    kind = members.schema["c"].dataType.simpleString()
    own = sets.join(members, sets["id"] == members["c"]).select("c", "part", "items")
    rows = materialize(own.mapInArrow(unpack, f"c {kind}, part {kind}, n bigint, item bigint"), "items")
    # how frequent a shingle is, and in which part the most
    by_part = rows.groupBy("item", "part").agg(F.count("*").alias("k"))
    items = by_part.groupBy("item").agg(F.sum("k").alias("df"), F.count("*").alias("parts"), F.max(F.struct("k", "part")).alias("top"))
    items = materialize(items.select("item", "df", (F.col("parts") > 1).alias("crossed"), F.col("top.part").alias("top_part")), "frequencies")
    # first places in the common order: rarest first
    ranked = rows.join(items.where("df > 1").select("item", "df", "crossed"), "item", "left")
    first = lambda least: F.col("n") - least + 1
    most = first(F.ceil(F.lit(percent) * F.col("n") / 100)).cast("bigint")
    fewer = first(F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent))).cast("bigint")
    in_order = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item", F.coalesce("crossed", F.lit(False)).alias("crossed"))))
    sorted_ = ranked.groupBy("c", "part", "n").agg(in_order.alias("all"))
    prefix = sorted_.select("c", "part", "n", fewer.alias("fewer"), F.posexplode(F.slice("all", F.lit(1), most.cast("int"))).alias("place", "s"))
    prefix = materialize(prefix.where("s.crossed").select("c", "part", "n", "place", (F.col("place") < F.col("fewer")).alias("early"), F.col("s.item").alias("item")), "prefixes")
    # written, so that both sides of the next join are dealt out anew and a hot shingle's can be split
    outer = materialize(prefix.join(items.where("crossed").select("item", "top_part"), "item").where("part <> top_part").drop("top_part"), "outer")
    a, b = outer.alias("a"), prefix.alias("b")
    a_smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.c") < F.col("b.c")))
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    may = (F.col("a.part") != F.col("b.part")) & F.when(a_smaller, F.col("a.early")).otherwise(F.col("b.early"))
    may = may & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & ((100 + percent) * rest >= percent * (F.col("a.n") + F.col("b.n")))
    pairs = a.join(b, (F.col("a.item") == F.col("b.item")) & may)
    out = materialize(pairs.select(F.least("a.c", "b.c").alias("lo"), F.greatest("a.c", "b.c").alias("hi")).distinct(), "pairs")
    discard(rows, items, prefix, outer)
    return out


#: Members of the first hub's component that become hubs in each round after the first.
HUBS = (4,)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 6,
    slice_bytes: int = 2 << 20,
    broadcast_ids: int = 2_000_000,
) -> DataFrame:
    """One row for each document: id, n_shingles, class_id (least id with an equal set),
    component_id (least id reachable by links, its own included)."""
    hasher = Hasher(bands, rows)
    spark = docs.sparkSession
    wordscan.bound_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(signatures(texts, k, hasher, slice_bytes), "signatures")
    some = signed.where("n_shingles > 0 and id is not null")
    classes = some.groupBy("set_a", "set_b").agg(F.min("id").alias("class_id"))
    named = materialize(some.select("id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("id", "class_id").distinct(), "classes")
    heads = some.join(named.where("id = class_id").select("id"), "id", "left_semi").dropDuplicates(["id"])
    heads = materialize(heads.select(F.col("id").alias("c"), "n_shingles", "odd", "bands"), "heads")
    release(spark)
    # a value is that of one band; rows are two numbers until a pair is to be judged
    values = heads.select("c", F.explode("bands").alias("value"))
    crowded = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(values.join(crowded, "value"), "members")
    release(spark)
    # a class in many and large buckets is near the middle of its group
    central = members.groupBy("c").agg(F.sum("n").alias("central"))
    members = materialize(members.select("c", "value").join(central, "c"), "members")
    wanted = materialize(members.select("c").distinct(), "wanted")
    sketches = materialize(heads.join(_near(wanted, broadcast_ids), "c", "left_semi").select("c", "n_shingles", "odd"), "sketches")
    sets = materialize(full_sets(texts, wanted.select(F.col("c").alias("id")), k, slice_bytes, broadcast_ids).dropDuplicates(["id"]), "sets")
    discard(heads)
    release(spark)
    links: DataFrame | None = None
    parts: DataFrame | None = None
    for number in range(len(HUBS) + 2):
        at = members.withColumn("part", F.col("c")) if parts is None else members.join(parts, "c", "left").withColumn("part", F.coalesce("component", "c")).drop("component")
        at = at.withColumn("luck", F.pmod(F.xxhash64("c", F.lit(number)), F.lit(1 << 20)) / float(1 << 20))
        top = F.max(F.struct("central", "luck", "c", "part"))
        open_ = at.groupBy("value").agg(F.count("*").alias("many"), F.min("part").alias("low"), F.max("part").alias("high"), top.alias("top"))
        open_ = materialize(open_.where("low < high").select("value", "many", F.col("top.c").alias("top"), F.col("top.part").alias("top_part")), "buckets")
        at = materialize(at.join(_near(open_, broadcast_ids // 4), "value"), "open")
        discard(open_, members)
        if at.limit(1).count() == 0:
            discard(at)
            break
        inside = F.col("part") == F.col("top_part")
        if number == 0:
            hub = F.col("c") == F.col("top")
            found = at.where(~hub).select("c", F.col("top").alias("h"))
        elif number <= len(HUBS):
            hub = (F.col("c") == F.col("top")) | (inside & (F.col("luck") < F.lit(float(HUBS[number - 1])) / F.col("many")))
            hubs = at.where(hub & inside).select("value", F.col("c").alias("h"))
            found = at.where(~inside).select("value", "c").join(hubs, "value")
        else:
            found = prefix_pairs(at.select("c", "part").distinct(), sets, percent).select(F.col("lo").alias("c"), F.col("hi").alias("h"))
        pairs = found.select(F.least("c", "h").alias("lo"), F.greatest("c", "h").alias("hi")).distinct()
        pairs = materialize(alike(pairs, sketches, hasher, percent), "pairs")
        found = confirmed(pairs, sets, percent, broadcast_ids)
        found = materialize(found if links is None else links.unionByName(found), "links")
        discard(links)
        links = found
        parts = connected_components(links, "lo", "hi").select(F.col("node").alias("c"), "component")
        if number > len(HUBS):
            discard(at, pairs)
            break
        members = materialize(at.where(~hub).select("c", "value", "central"), "members")
        discard(at, pairs)
        release(spark)
    discard(sets, sketches, wanted)
    out = signed.select("id", "n_shingles").join(named, "id", "left")
    if parts is not None:
        out = out.join(parts.withColumnRenamed("c", "class_id"), "class_id", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast(signed.schema["id"].dataType))
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("component", "class_id", "id").alias("component_id"),
    )


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df
