"""Sorted-string tables: immutable files of key-value pairs in key order.

Layout: data blocks | filter block | index block | footer. A data block holds entries
(shared prefix length, rest length, value length as LEB128 numbers, rest of the key, value), is
compressed as a whole and followed by nothing; keys share prefixes within a block only. The
index has, for each block, its last key, offset, stored size and CRC-32. The filter is a Bloom
filter over all keys. The footer has fixed size and ends with a magic number, so a reader needs
only the end of a file to find everything. Equal keys may repeat; they stay in written order.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import xxhash
import zstandard

MAGIC = b"STRIDE-SSTABLE-1"
#: filter offset, filter size, hashes, index offset, index size, entries, value width, magic
FOOTER = struct.Struct("<QQIQQQI16s")
ENTRY = struct.Struct("<QII")


def put_varint(out: bytearray, n: int) -> None:
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def _key_hash(key: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_64_intdigest(key)
    return both >> 32, both & 0xFFFFFFFF | 1


class BloomFilter:
    """k hashes by double hashing over a bit array."""

    def __init__(self, bits: np.ndarray, hashes: int):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def of(cls, keys: list[tuple[int, int]], bits_per_key: int = 10, hashes: int = 7) -> BloomFilter:
        n = max(64, len(keys) * bits_per_key + 7 & ~7)
        flags = np.zeros(n, np.uint8)
        if keys:
            both = np.array(keys, np.int64)
            for k in range(hashes):
                flags[(both[:, 0] + k * both[:, 1]) % n] = 1
        return cls(np.packbits(flags, bitorder="little"), hashes)

    def may_have(self, key: bytes) -> bool:
        a, b = _key_hash(key)
        n = len(self.bits) * 8
        return all(self.bits[(x := (a + k * b) % n) >> 3] >> (x & 7) & 1 for k in range(self.hashes))


class Writer:
    """Write pairs in ascending key order."""

    def __init__(self, out: BinaryIO, block_bytes: int = 1 << 16, width: int = 2):
        self.out, self.block_bytes, self.width = out, block_bytes, width
        self.block, self.last = bytearray(), b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[tuple[int, int]] = []
        self.offset = 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.hashes and key < self.last:
            raise ValueError("keys must ascend")
        shared = shared_prefix(self.last, key) if self.block else 0
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.hashes.append(_key_hash(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            stored = self.packer.compress(bytes(self.block))
            self.index.append((self.last, self.offset, len(stored), zlib.crc32(stored)))
            self._write(stored)
            self.block = bytearray()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def close(self) -> None:
        self._flush()
        bloom = BloomFilter.of(self.hashes)
        at_filter, bits = self.offset, bloom.bits.tobytes()
        self._write(bits)
        at_index, index = self.offset, bytearray()
        for key, offset, size, crc in self.index:
            put_varint(index, len(key))
            index += key
            index += ENTRY.pack(offset, size, crc)
        self._write(bytes(index))
        self._write(FOOTER.pack(at_filter, len(bits), bloom.hashes, at_index, len(index), len(self.hashes), self.width, MAGIC))
        self.out.close()


class Reader:
    """Look keys up by binary search over the sparse index, or scan in key order."""

    def __init__(self, file: BinaryIO):
        self.file = file
        file.seek(0, 2)
        file.seek(file.tell() - FOOTER.size)
        at_filter, n_filter, hashes, at_index, n_index, self.n_entries, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string table")
        file.seek(at_filter)
        self.bloom = BloomFilter(np.frombuffer(file.read(n_filter), np.uint8), hashes)
        file.seek(at_index)
        data, at = file.read(n_index), 0
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        while at < len(data):
            n, at = get_varint(data, at)
            self.last_keys.append(data[at : at + n])
            self.blocks.append(ENTRY.unpack_from(data, at + n))
            at += n + ENTRY.size
        self.unpacker = zstandard.ZstdDecompressor()

    def _entries(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        offset, size, crc = self.blocks[number]
        self.file.seek(offset)
        stored = self.file.read(size)
        if zlib.crc32(stored) != crc:
            raise ValueError(f"block {number} is damaged")
        data, at, key = self.unpacker.decompress(stored), 0, b""
        while at < len(data):
            shared, at = get_varint(data, at)
            rest, at = get_varint(data, at)
            n, at = get_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for number in range(len(self.blocks)):
            yield from self._entries(number)

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key."""
        if not self.bloom.may_have(key):
            return []
        found = []
        for number in range(bisect_left(self.last_keys, key), len(self.blocks)):
            for own, value in self._entries(number):
                if own == key:
                    found.append(value)
                elif own > key:
                    return found
        return found
