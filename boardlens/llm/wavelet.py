"""Wavelet-matrix shard files for token ids.

One file holds a shard: a table of documents and one bit-plane per id bit,
highest bit first. Below a plane the ids whose bit is 0 come before those whose
bit is 1, each side in its order, so a few rank steps answer *which id is at i*,
*how many of an id lie in a range* and *where is its k-th place* without
decoding the shard. Planes are stored in blocks, each compressed by itself, with
the count of ones before it; a query reads and decompresses only the blocks it
touches, and holds a bounded number of them with their counts by byte.
"""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import zstandard

MAGIC = b"BLWM0001"
#: Bits of a plane that are compressed together.
BLOCK_BITS = 1 << 17
#: Blocks that a reader holds at most (about 80 KB each).
HELD_BLOCKS = 256


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _split(ids: np.ndarray, bits: int):
    """Yield (packed plane, ones) from the highest bit down."""
    cur = ids
    for b in range(bits - 1, -1, -1):
        one = ((cur >> b) & 1).astype(bool)
        at = np.flatnonzero(one)
        yield np.packbits(one), len(at)
        cur = np.concatenate([cur[np.flatnonzero(~one)], cur[at]])


def write_shard(ids: np.ndarray, doc_ids: np.ndarray, doc_valid: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of a shard file.

    ``ids`` are the documents' ids joined, ``lengths`` each document's count,
    ``doc_ids``/``doc_valid`` the document keys (a key may be null).
    """
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    docs = _pack(doc_ids.astype("<i8").tobytes() + np.asarray(doc_valid, np.uint8).tobytes() + lengths.astype("<i8").tobytes())
    head, body, at = [], [], 0
    step = BLOCK_BITS // 8
    for plane, ones in _split(ids, bits):
        before, table = 0, []
        for i in range(0, len(plane), step):
            block = plane[i : i + step]
            data = _pack(block.tobytes())
            table.append((at, len(data), before))
            body.append(data)
            at += len(data)
            before += int(np.bitwise_count(block).sum())
        head.append(struct.pack("<Q", n - ones) + np.array(table, "<i8").tobytes())
    meta = struct.pack("<QQQQ", n, bits, len(doc_ids), -(-(-(-n // 8)) // step)) + b"".join(head)
    return MAGIC + struct.pack("<QQ", len(meta), len(docs)) + meta + docs + b"".join(body)


class Shard:
    """Reader of one shard file: its bytes, or a function that reads (place, size) of them."""

    def __init__(self, raw: bytes | Callable[[int, int], bytes]):
        self._read = raw if callable(raw) else lambda at, size: raw[at : at + size]
        head = self._read(0, 24)
        if head[:8] != MAGIC:
            raise ValueError("not a token shard")
        n_meta, n_docs = struct.unpack_from("<QQ", head, 8)
        meta = self._read(24, n_meta)
        self.n, self.bits, docs, blocks = struct.unpack_from("<QQQQ", meta)
        at = 32
        self.zeros, self.table = [], []
        for _ in range(self.bits):
            self.zeros.append(struct.unpack_from("<Q", meta, at)[0])
            self.table.append(np.frombuffer(meta, "<i8", 3 * blocks, at + 8).reshape(blocks, 3))
            at += 8 + 24 * blocks
        self._docs, self._body, self._many = (24 + n_meta, n_docs), 24 + n_meta + n_docs, docs
        self._held: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def _column(self, at: int, kind) -> np.ndarray:
        return np.frombuffer(_unpack(self._read(*self._docs)), kind, self._many, at * self._many)

    @property
    def doc_ids(self) -> np.ndarray:
        return self._column(0, "<i8")

    @property
    def doc_valid(self) -> np.ndarray:
        return self._column(8, np.uint8).astype(bool)

    @property
    def lengths(self) -> np.ndarray:
        return self._column(9, "<i8")

    def __len__(self) -> int:
        return self.n

    def _packed(self, plane: int, k: int) -> bytes:
        at, size, _ = (int(x) for x in self.table[plane][k])
        return _unpack(self._read(self._body + at, size))

    def _block(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of block k of a plane, ones of the plane before each of them and after the last)."""
        got = self._held.pop((plane, k), None)
        if got is None:
            octets = np.frombuffer(self._packed(plane, k), np.uint8)
            got = octets, int(self.table[plane][k, 2]) + np.concatenate([[0], np.cumsum(np.bitwise_count(octets), dtype=np.int64)])
            if len(self._held) >= HELD_BLOCKS:
                self._held.popitem(last=False)
        self._held[plane, k] = got
        return got

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i == 0:
            return 0
        k = (i - 1) // BLOCK_BITS
        octets, before = self._block(plane, k)
        byte, bit = divmod(i - k * BLOCK_BITS, 8)
        return int(before[byte]) + (int(octets[byte]) >> (8 - bit)).bit_count() if bit else int(before[byte])

    def _bit(self, plane: int, i: int) -> int:
        byte, bit = divmod(i % BLOCK_BITS, 8)
        return int(self._block(plane, i // BLOCK_BITS)[0][byte]) >> (7 - bit) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            bit = self._bit(p, i)
            one = self._rank1(p, i)
            i = self.zeros[p] + one if bit else i - one
            value = 2 * value + bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` among places lo..hi-1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value."""
        before = self.table[plane][:, 2]
        if not bit:
            before = np.arange(len(before)) * BLOCK_BITS - before
        b = int(np.searchsorted(before, k, side="right")) - 1
        octets, ones = self._block(plane, b)
        upto = ones if bit else b * BLOCK_BITS + 8 * np.arange(len(ones)) - ones
        byte = int(np.searchsorted(upto, k, side="right")) - 1
        bits = np.unpackbits(octets[byte : byte + 1])
        return b * BLOCK_BITS + 8 * byte + int(np.flatnonzero(bits == bit)[k - int(upto[byte])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.zeros[p] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, in order (uint16 where they fit)."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            packed = b"".join(self._packed(p, k) for k in range(len(self.table[p])))
            one = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n).view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~one)] = cur[: self.zeros[p]]
            out[np.flatnonzero(one)] = cur[self.zeros[p] :] | kind(1 << (self.bits - 1 - p))
            cur = out
        return cur
