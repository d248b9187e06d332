"""Vectorised splitting and hashing of words in Arrow text columns.

A batch of texts is one byte buffer; words are byte ranges in it. A word's
64-bit key comes from a prefix polynomial over the bytes (mod 2**64), shifted
to be free of its place, then mixed with its length, so all words of a batch
are keyed by a few numpy passes and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text that one numpy pass takes together (one longer text is one pass).
CHUNK_BYTES = 1 << 20


def _powers(kind: str, n: int) -> np.ndarray:
    """base**i (or its inverse) mod 2**64 for i below n, grown by doubling."""
    have = _POWERS.get(kind)
    if have is None:
        have = np.ones(1, U64)
    base = _BASE if kind == "up" else _BASE_INV
    while len(have) < n:
        step = U64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _POWERS[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit keys so that all bits depend on all bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _polynomial(data: np.ndarray) -> np.ndarray:
    """The polynomial over the bytes before each place."""
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _powers("up", len(data)), out=prefix[1:])
    return prefix


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of the byte ranges [start, end) of ``data``, in ascending order.

    Taken by runs of ranges that lie within ``CHUNK_BYTES``, and a longer range
    by parts, so that one long text needs no more than many short ones.
    """
    raw = np.zeros(len(start), U64)
    first = 0
    while first < len(start):
        low = int(start[first])
        last = max(first + 1, int(np.searchsorted(end, low + CHUNK_BYTES, side="right")))
        if int(end[last - 1]) - low <= CHUNK_BYTES:
            prefix = _polynomial(data[low : int(end[last - 1])])
            s, e = start[first:last] - low, end[first:last] - low
            raw[first:last] = (prefix[e] - prefix[s]) * _powers("down", len(prefix))[s]
        else:
            for at in range(low, int(end[first]), CHUNK_BYTES):
                part = _polynomial(data[at : min(at + CHUNK_BYTES, int(end[first]))])[-1:]
                raw[first : first + 1] += part * U64(pow(_BASE, at - low, 1 << 64))
        first = last
    return mix(raw + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets) of runs of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    else:
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def _table(*groups: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    for g in groups:
        t[np.frombuffer(g, np.uint8)] = True
    return t


SPACE = _table(b" \t\n\x0b\x0c\r")
#: Space and ASCII punctuation: what parts words where only their letters count.
SPACE_PUNCT = _table(b" \t\n\x0b\x0c\r", bytes(range(33, 48)), bytes(range(58, 65)), bytes(range(91, 97)), bytes(range(123, 127)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes outside ``apart``; runs end with their text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = inside[tails]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def word_runs(column: pa.Array, apart: np.ndarray = SPACE, carry: int = 0) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, ended, bytes, heads, starts, ends, row of each word, keys) of runs of rows, lower-cased (A-Z).

    Starts and ends are places in ``bytes``, and so is each row's head (where its
    text begins, below 0 where that was in an earlier window). A text beyond ``CHUNK_BYTES`` comes alone, in windows cut between
    words: each begins with the last ``carry`` words of the one before (at places
    below 0), and only the last one has ended.
    """
    for first, end, data, offsets in text_chunks(column):
        if len(data) <= CHUNK_BYTES:
            data = LOWER[data]
            start, stop, row = word_spans(data, offsets, apart)
            yield first, end - first, True, data, offsets[:-1], start, stop, row, span_keys(data, start, stop)
            continue
        at = 0
        tail = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        while at < len(data):
            to = min(at + CHUNK_BYTES, len(data))
            while to < len(data):  # up to the end of the word
                gap = np.flatnonzero(apart[data[to : to + 4096]])
                if len(gap):
                    to += int(gap[0])
                    break
                to = min(to + 4096, len(data))
            part = LOWER[data[at:to]]
            start, stop, _ = word_spans(part, np.array([0, len(part)]), apart)
            keys = span_keys(part, start, stop)
            start, stop, keys = np.concatenate([tail[0] - at, start]), np.concatenate([tail[1] - at, stop]), np.concatenate([tail[2], keys])
            yield first, 1, to == len(data), part, np.array([-at]), start, stop, np.zeros(len(start), np.int64), keys
            tail = (start[-carry:] + at, stop[-carry:] + at, keys[-carry:]) if carry else tail
            at = to


def ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values as int64 with 0 for null, validity) of an integer column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    return np.asarray(column.cast(pa.int64()).fill_null(0)), valid
