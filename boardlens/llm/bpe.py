"""Byte-level BPE over Arrow text columns, each distinct unit tokenised once per worker.

A text is cut before every single space that follows a byte other than white
space. Byte-level BPE's own splitting always cuts there, so encoding the units
apart gives the ids of the whole text. Units are keyed by
:func:`words.span_keys`; a bounded table in the Python worker maps keys to ids,
and only units that it lacks go through the ``tokenizers`` library. Texts in
which other Unicode white space meets a space, and tokenizers of another build,
are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from boardlens.llm import words as W

# Fixed values of the byte-level scheme: its split pattern and the bytes that stand for themselves.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SELF_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))

_ODD_SPACE = r"\x1c-\x1f\x85\xa0  -     　"
_ODD_IN_UNIT = re.compile(f"[{_ODD_SPACE}]")
_ODD_THEN_SPACE = re.compile(rb"(?:[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80) ")
_ODD_BYTES = re.compile(_ODD_THEN_SPACE.pattern[:-1])
#: Units that a worker remembers; a full table is emptied, so memory stays bounded.
MAX_UNITS = 1 << 21
#: The same for the pieces that the split pattern makes of new units.
MAX_PIECES = 1 << 17
#: Bytes of short texts that are encoded together: what a unit takes meanwhile is many times its bytes.
RUN_BYTES = 1 << 18


class KeyTable:
    """Open-addressing map from 64-bit keys to int32, with batch find and insert."""

    def __init__(self, log2: int = 16):
        self._alloc(log2)

    def _alloc(self, log2: int) -> None:
        self.log2, self.n = log2, 0
        self.keys = np.zeros(1 << log2, np.uint64)
        self.vals = np.zeros(1 << log2, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.log2)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of ``keys`` (none may be 0), -1 where absent."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.vals[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.vals[slot[hit]]
            on = ~hit & (held != 0)
            left, slot = left[on], slot[on]
        return out

    def insert(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Add distinct absent ``keys``."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys != 0
            k, v = self.keys[old], self.vals[old]
            self._alloc(max(self.log2 + 1, int(np.ceil(np.log2(2 * (len(k) + len(keys)) + 1)))))
            self.insert(k, v)
        self.n += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.vals[slot[won]] = vals[won]
            keys, vals, slot = keys[~won], vals[~won], (slot[~won] + 1) & (len(self.keys) - 1)


class ByteBpe:
    """One tokenizer file, with the units that this worker has met."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        conf = json.loads(self.tokenizer.to_str())
        pre = conf.get("pre_tokenizer") or {}
        self.by_unit = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and conf.get("normalizer") is None
            and conf["model"]["type"] == "BPE"
        )
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.tokenize = self.tokenizer.model.tokenize
        self.split = regex.compile(SPLIT_PATTERN).findall
        others = [b for b in range(256) if b not in SELF_BYTES]
        self.letters = {b: chr(256 + i) for i, b in enumerate(others)}
        self._empty()

    def _empty(self) -> None:
        self.table = KeyTable()
        self.pieces: dict[str, list[int]] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, self.dtype)
        self.used = 0

    def _piece_ids(self, piece: str) -> list[int]:
        if len(self.pieces) >= MAX_PIECES:
            self.pieces.clear()
        if piece.isascii() and piece.isprintable() and not piece.isspace():
            seen = "\u0120" + piece[1:] if piece[0] == " " else piece
        else:
            seen = piece.encode().decode("latin-1").translate(self.letters)
        ids = self.pieces[piece] = [t.id for t in self.tokenize(seen)]
        return ids

    def _unit_ids(self, units: list[str], odd: bool) -> list[list[int]]:
        """Ids of each unit; odd: some may hold white space that is not plain."""
        out, pieces, split, whole = [], self.pieces, self.split, self._piece_ids
        for unit in units:
            if unit[1:].isalpha() and unit[0] == " ":
                out.append(pieces.get(unit) or whole(unit))
            elif odd and _ODD_IN_UNIT.search(unit):
                out.append(self.tokenizer.encode(unit, add_special_tokens=False).ids)
            else:
                ids: list[int] = []
                for piece in split(unit):
                    ids += pieces.get(piece) or whole(piece)
                out.append(ids)
        return out

    def _learn(self, keys: np.ndarray, units: list[str], odd: bool) -> None:
        if self.table.n + len(keys) > MAX_UNITS:
            self._empty()
        ids = self._unit_ids(units, odd)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.dtype, int(size.sum()))
        first, n = self.table.n, self.table.n + len(keys)
        while n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.size[first:n] = size
        self.start[first:n] = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.table.insert(keys, np.arange(first, n, dtype=np.int32))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return counts, np.fromiter(chain.from_iterable(ids), self.dtype, int(counts.sum()))

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_unit or _ODD_THEN_SPACE.search(data):
            raw = data.tobytes()
            return self._whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        n = len(data)
        if not n:
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, self.dtype)
        cut = np.zeros(n, bool)
        cut[1:] = (data[1:] == 32) & ~W.SPACE[data[:-1]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        keys = W.span_keys(data, start, end)
        keys[keys == 0] = 1
        at = self.table.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            raw, where = data.tobytes(), missing[where]
            odd = _ODD_BYTES.search(raw) is not None
            before = self.table.n
            self._learn(new, [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)], odd)
            if self.table.n < before + len(new):  # it was emptied meanwhile
                at = self.table.find(keys)
                lost = np.flatnonzero(at < 0)
                if len(lost):
                    new, where = np.unique(keys[lost], return_index=True)
                    where = lost[where]
                    self._learn(new, [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)], odd)
                    at = self.table.find(keys)
            else:
                at[missing] = self.table.find(keys[missing])
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        return np.diff(upto), ids

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids per row, all ids) for runs of rows; null is empty.

        A text beyond ``CHUNK_BYTES`` is encoded by windows, cut before spaces
        that follow a visible ASCII byte: no unit spans those.
        """
        for first, end, data, offsets in W.text_chunks(column, RUN_BYTES):
            if len(data) <= W.CHUNK_BYTES or not self.by_unit:
                yield first, end, *self._chunk(data, offsets)
                continue
            at, ids = 0, []
            while at < len(data):
                to = min(at + W.CHUNK_BYTES, len(data))
                while to < len(data):
                    part = data[to - 1 : to + 4096]
                    cuts = np.flatnonzero((part[1:] == 32) & (part[:-1] > 32) & (part[:-1] < 127))
                    if len(cuts):
                        to += int(cuts[0])
                        break
                    to = min(to + 4096, len(data))
                ids.append(self._chunk(data[at:to], np.array([0, to - at]))[1])
                at = to
            ids = np.concatenate(ids)
            yield first, end, np.array([len(ids)]), ids


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The tokenizer at ``path``, read once per Python worker (or again after :func:`forget`)."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def forget() -> None:
    """Let go of the tokenizers that this worker holds, with their tables (300 MB and more)."""
    _LOADED.clear()


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each row's ids."""
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    ends = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[np.flatnonzero(keep)] = ids
    return counts + 1, out
