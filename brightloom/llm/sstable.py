"""Sorted-string-table files: prefix-compressed blocks, sparse index, Bloom filter, footer.

Layout: data blocks, index block, Bloom filter, footer. A block is a run of entries (shared key bytes,
other key bytes, value bytes; the three lengths as varints), then the offset of every 16th entry, whose key is
whole, their number and a crc32. The index has one entry for a data block: its last key, with offset and
length as value. Keys may repeat; equal keys stand side by side in the order in which they were added.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

MAGIC = b"BLSST001"
BLOCK_BYTES = 32 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQHH8s")


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do, null first."""
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Block:
    """Entries that become one block."""

    def __init__(self):
        self.parts, self.size, self.n, self.last, self.restarts = [], 0, 0, b"", []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(self.size)
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.parts += (head, value)
        self.size += len(head) + len(value)
        self.n, self.last = self.n + 1, key

    def done(self) -> bytes:
        body = b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        return body + struct.pack("<I", zlib.crc32(body))


def entries(block: bytes, start: int = 0) -> Iterator[tuple[bytes, memoryview]]:
    """Keys and values from the entry at ``start``, a restart, on."""
    view = memoryview(block)
    end = len(block) - 8 - 4 * struct.unpack_from("<I", block, len(block) - 8)[0]
    key, at = b"", start
    while at < end:
        shared, at = _read_varint(view, at)
        other, at = _read_varint(view, at)
        size, at = _read_varint(view, at)
        key = key[:shared] + bytes(view[at : at + other])
        at += other
        yield key, view[at : at + size]
        at += size


def checked(block: bytes) -> bytes:
    if zlib.crc32(block[:-4]) != struct.unpack_from("<I", block, len(block) - 4)[0]:
        raise ValueError("a block of a sorted-string table is damaged")
    return block


def _seek(block: bytes, key: bytes) -> int:
    """The last restart whose key is below ``key``, or the first: from there entries reach every one with ``key``."""
    n = struct.unpack_from("<I", block, len(block) - 8)[0]
    restarts = struct.unpack_from(f"<{n}I", block, len(block) - 8 - 4 * n)
    found = bisect.bisect_left(restarts, key, key=lambda at: next(entries(block, at))[0])
    return restarts[max(0, found - 1)]


def _places(key: bytes, bits: int, hashes: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest(key)
    return ((h & 0xFFFFFFFF) + np.arange(hashes, dtype=np.int64) * ((h >> 32) | 1)) % bits


class Writer:
    """Collects entries in key order; ``size`` is what is held so far."""

    def __init__(self, width: int):
        self.width, self.blocks, self.index, self.block = width, [], Block(), Block()
        self.size, self.keys, self.n, self.ids = 0, [], 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        self.block.add(key, value)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.n, self.ids = self.n + 1, self.ids + len(value) // self.width
        if self.block.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block.n:
            data = self.block.done()
            self.index.add(self.block.last, struct.pack("<QQ", self.size, len(data)))
            self.blocks.append(data)
            self.size += len(data)
            self.block = Block()

    def done(self) -> bytes:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_places(k, bits, BLOOM_HASHES)] = 1
        index, bloom = self.index.done(), np.packbits(bloom, bitorder="little").tobytes()
        footer = _FOOTER.pack(self.size, len(index), self.size + len(index), len(bloom), self.n, self.ids, BLOOM_HASHES, self.width, MAGIC)
        return b"".join([*self.blocks, index, bloom, footer])


class Reader:
    """A table in a random-access file (``read_at(nbytes, offset)``): reads the footer, then only what is asked for."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        *where, self.n, self.ids, self.hashes, self.width, magic = _FOOTER.unpack(read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string table")
        self.index = checked(read_at(where[1], where[0]))
        self.bloom = np.frombuffer(read_at(where[3], where[2]), np.uint8)

    def _block(self, place: memoryview) -> bytes:
        offset, length = struct.unpack("<QQ", place)
        return checked(self.read_at(length, offset))

    def may_hold(self, key: bytes) -> bool:
        at = _places(key, 8 * len(self.bloom), self.hashes)
        return bool((self.bloom[at >> 3] >> (at & 7) & 1).all())

    def get(self, key: bytes) -> list[bytes]:
        """The values of ``key``, in order: Bloom filter, then binary search in index and block."""
        found: list[bytes] = []
        if not self.n or not self.may_hold(key):
            return found
        for last, place in entries(self.index, _seek(self.index, key)):
            if last < key:
                continue
            block = self._block(place)
            for k, v in entries(block, _seek(block, key)):
                if k == key:
                    found.append(bytes(v))
                elif k > key:
                    return found
            if last > key:
                break
        return found

    def scan(self) -> Iterator[tuple[bytes, memoryview]]:
        for _, place in entries(self.index):
            yield from entries(self._block(place))
