"""Token ids as sorted-string-table shards.

Texts are encoded with a tokenizers file, an end id is appended, and documents go in ascending
order of id into shards of sorted-string tables (sstable.py). Documents are dealt out by ranges
of (id, hash of text), so neither a hot id nor an uneven id space fills one task; each task streams
to files of at most about `shard_bytes`. File names hold the task's attempt and only the
manifest (a table in the shared folder) says which files count, so a repeated task does no harm.

The tokenizer splits at white space, so texts are encoded by distinct words: words between
space, tab, line feed and carriage return are looked up in a bounded cache and only new ones go
through the library. Only a tokenizer file with exactly the steps STEPS allows this; with any other file
whole texts are encoded.

Cases: null or empty text has the end id only; a null id sorts first; repeated rows are
repeated entries, in order of their text; an empty table gives no shard and no rows. Integer
and string ids are kept as they are; columns other than id and text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridemap.llm import sstable, storage, wordscan
from stridemap.session import materialize, shared_dir

#: Bytes at which every tokenizer with white-space splitting splits.
CUTS = (0x20, 0x09, 0x0A, 0x0D)


def encode_key(key: int | str | None) -> bytes:
    """Keys in byte order: null, then integers, then strings."""
    if key is None:
        return b"\x00"
    if isinstance(key, int):
        return b"\x01" + struct.pack(">Q", key + (1 << 63))
    return b"\x02" + key.encode()


def decode_key(key: bytes) -> int | str | None:
    if key[0] == 0:
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] == 1 else key[1:].decode()


#: A piece of a plain word: lower-case letters of ASCII and Latin-1, or signs other than ' and <.
PLAIN = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
LETTER, DIGIT, SIGN, ODD = 1, 2, 3, 4


def byte_classes() -> np.ndarray:
    """Byte -> LETTER, DIGIT, SIGN or ODD; white space is 0."""
    table = np.full(256, ODD, np.uint8)
    table[0x21:0x7F] = SIGN
    table[0x30:0x3A] = DIGIT
    table[0x41:0x5B] = table[0x61:0x7B] = LETTER
    table[[0x27, 0x3C]] = ODD
    table[list(CUTS)] = 0
    return table


def piece_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with plain letters lowered, mask of bytes in words, starts, ends) of pieces: the runs of
    letters or signs and the single digits of plain words, and other words whole."""
    kind = byte_classes()[data]
    text = data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)  # U+00C0 to U+00FF
    after = data[lead + 1]
    lead, after = lead[(after != 0x97) & (after != 0xB7)], after[(after != 0x97) & (after != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    starts, ends = wordscan.word_bounds(kind, offsets)
    odd = np.concatenate(([0], np.cumsum(kind == ODD, dtype=np.int32)))
    plain = odd[ends] == odd[starts]
    fold = np.zeros(len(data) + 1, np.int8)  # 1 inside plain words
    fold[starts[plain]] = 1
    fold[ends[plain]] -= 1
    fold = np.cumsum(fold[:-1], dtype=np.int8).astype(bool)
    text[upper & fold] += 0x20
    high = lead[(after >= 0x80) & (after <= 0x9E)]
    text[high[fold[high]] + 1] += 0x20
    inside = kind != 0
    first = np.zeros(len(data), bool)
    first[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & fold[1:] & inside[1:]
    first[starts] = True
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(data))
    word = np.searchsorted(starts, begin, "right") - 1
    return text, inside, begin, np.minimum(end, ends[word])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable Latin-1, else one from 256 up."""
    out, spare = [], 256
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b
        out.append(chr(b) if shown else chr(spare))
        spare += not shown
    return out


class WordEncoder:
    """A tokenizer with a cache of words.

    Most of the library's time goes into its regular expressions, not its merges. A word of
    plain letters, digits and signs is therefore folded and cut into pieces here, by the same
    pattern, and each distinct piece goes to the library's model; all other words go through
    the whole tokenizer.
    """

    def __init__(self, path: str, cache_words: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = check_white_space(self.tokenizer)
        self.cache_words = cache_words
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode() for w in new]
        encoded: list[list[int]] = [[]] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if PLAIN.fullmatch(text):
                letters = text if text.isascii() else "".join(self.letters[b] for b in new[k])
                encoded[k] = [t.id for t in self.model.tokenize(letters)]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            encoded[k] = e.ids
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        base = len(self.known)
        for k, word in enumerate(new):
            self.known[word] = base + k
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.pool = np.concatenate((self.pool, np.fromiter((x for ids in encoded for x in ids), np.uint32, int(size.sum()))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text, with an end mark)."""
        if not self.by_word:
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            first = np.cumsum([0, *map(len, lists)])
            return np.fromiter((x for ids in lists for x in ids), np.uint32, int(first[-1])), first
        text, inside, starts, ends = piece_bounds(data, offsets)
        of_text = np.searchsorted(starts, offsets)
        sizes = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=sizes[1:])
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(text[inside])]).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.cache_words:
            self._clear()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        known = self.known
        number = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[found.indices.to_numpy(zero_copy_only=False)]
        size = self.size[number]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        at = np.repeat(self.first[number] - total[:-1], size)
        at += np.arange(len(at))
        return self.pool[at], total[of_text]


#: The one splitting pattern that piece_bounds() repeats for plain words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: The steps before the model that piece_bounds() repeats, in this order.
STEPS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
]


def check_white_space(tokenizer) -> bool:
    """Does encoding a text equal encoding its words between white space, one by one, with the pieces of SPLIT? Only if the
    file has exactly STEPS before its model and no added token that plain words could be part of."""
    import json

    spec = json.loads(tokenizer.to_str())
    parts = [spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}]
    flat = [x for p in parts for x in (p.get("normalizers") or p.get("pretokenizers") or [p])]
    same = len(flat) == len(STEPS) and all(want == {k: got.get(k) for k in want} for want, got in zip(STEPS, flat, strict=True))
    whole = not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) or "<" not in t["content"] for t in spec.get("added_tokens", []))
    return same and whole and not spec.get("truncation") and not spec.get("padding")


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    folder: str | None = None,
    shard_bytes: int = 48 << 20,
    slice_bytes: int = 2 << 20,
) -> DataFrame:
    """Write the shards; returns the manifest (part, seq, path, n_docs, n_tokens, first_token),
    where first_token counts the ids of all shards before."""
    spark = docs.sparkSession
    wordscan.bound_batches(spark)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(n, "id", "mark").sortWithinPartitions("id", "mark", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        own = encoder(tokenizer)
        wide = own.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 or end_id >= 1 << 16
        kind, done = np.dtype("<u4" if wide else "<u2"), []
        writer, path, n_docs, n_tokens = None, "", 0, 0
        for batch in wordscan.slices(batches, "text", slice_bytes):
            ids, first = own.encode(*wordscan.utf8(batch.column("text")))
            ids = np.insert(ids, first[1:], end_id).astype(kind)
            first = (first + np.arange(len(first))) * kind.itemsize
            raw = ids.tobytes()
            for key, a, b in zip(batch.column("id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if writer is None:
                    path = f"{folder}/shard-{part:06d}-{len(done):05d}-{attempt}.sst"
                    writer, n_docs, n_tokens = sstable.Writer(storage.open_write(path), width=kind.itemsize), 0, 0
                writer.add(encode_key(key), raw[a:b])
                n_docs += 1
                n_tokens += (b - a) // kind.itemsize
                if writer.offset >= shard_bytes:
                    writer.close()
                    done.append((part, len(done), path, n_docs, n_tokens))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((part, len(done), path, n_docs, n_tokens))
        if done:
            columns = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                names=["part", "seq", "path", "n_docs", "n_tokens"],
            )

    manifest = materialize(rows.select("id", "text").mapInArrow(write, "part int, seq int, path string, n_docs bigint, n_tokens bigint"), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("bigint")))


def read_shards(manifest: DataFrame, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """One row for each document, from the files: id, start, n_tokens, ids_crc32."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                rows: list[tuple] = []
                with storage.open_read(path) as file:
                    table = sstable.Reader(file)
                    kind = np.dtype(f"<u{table.width}")
                    for key, value in table.scan():
                        ids = np.frombuffer(value, kind)
                        rows.append((decode_key(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 20_000:
                            yield as_batch(rows)
                            rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["id", "start", "n_tokens", "ids_crc32"])

    found = manifest.select("path", "first_token").repartition(n).mapInArrow(scan, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.withColumnRenamed("id", id_col)
