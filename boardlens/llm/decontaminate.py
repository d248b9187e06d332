"""Benchmark decontamination with spaced seeds.

Words are lower-cased and parted at white space and ASCII punctuation. Fixed
masks look at some positions of a window of words and ignore the others, so a
seed survives substitutions at the ignored places: the four masks together hit
every window of 13 words with up to two substitutions and every window of 16
with up to three (by enumeration; a test repeats it). An item of up to 12 words
has seeds of neighbouring words besides, so short that as many substitutions as
it may have leave one of them whole. Seed hashes of the test items are joined
with those of all training texts; around each hit the texts are aligned, hits
with too few equal words fall at once, and the best stretch of the others is
scored, so a chance hit falls and a copied passage with exchanged words stays.

The test set is taken in blocks of at most ``BLOCK_WORDS`` words. A block's
index is all that is broadcast, and larger test sets are more blocks, each a
scan of the texts. Long texts are searched by windows that overlap by the
longest item.

Nulls and odd rows: null or wordless texts and items overlap nothing; items of
fewer than ``min_words`` words are not searched for (chance finds them); null
keys, of texts or items, are keys like others; rows that repeat give their
results each, and so do repeated items; a text that holds an item more than once
gives a row for each place; empty tables give none; further columns, of any
name, are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.llm import words as W
from boardlens.llm.shared import lean

# The positions that each mask looks at.
MASKS = ((0, 4, 6, 7, 9, 10), (0, 1, 3, 8, 9, 10), (0, 1, 2, 4, 5, 6), (0, 4, 5, 7, 8, 9))
#: Words of test items that one index holds at most (about 40 bytes each).
BLOCK_WORDS = 1 << 20
#: A stretch counts from so many equal words (or this share of a shorter item), at this share of equal words.
MIN_MATCH, MIN_SHARE, MIN_IDENTITY = 10, 0.8, 0.75
MIN_WORDS = 5
MISMATCH = -2
#: Items of so many words at most have seeds of neighbouring words.
SHORT_WORDS = 12
#: Hits, and words of alignments, that are taken together.
HITS, ALIGNED = 1 << 19, 1 << 21
_FILTER_BITS = 20


def need_equal(words):
    """Equal words that an item of so many words takes."""
    return np.minimum(MIN_MATCH, np.ceil(MIN_SHARE * words - 1e-9)).astype(np.int64)


def _seed(keys: np.ndarray, positions: tuple[int, ...], n: int) -> np.ndarray:
    h = np.zeros(n, np.uint64)
    for p in positions:
        h = h * np.uint64(0x9E3779B97F4A7C15) + keys[p : p + n]
        h ^= h >> np.uint64(31)
    return W.mix(h)


class SeedIndex:
    """Seeds of a block of test items: for each mask, sorted hashes and their places."""

    def __init__(self, item_ids: list, texts: list[str | None], min_words: int = MIN_WORDS):
        keys, item, offsets = [], [], [0]
        self.ids = []
        for i, t in zip(item_ids, texts, strict=True):
            for _, _, data, off in W.text_chunks(pa.array([t], pa.string())):
                data = W.LOWER[data]
                start, end, _ = W.word_spans(data, off, W.SPACE_PUNCT)
                if len(start) >= min_words:
                    keys.append(W.span_keys(data, start, end))
                    item.append(np.full(len(start), len(self.ids)))
                    offsets.append(offsets[-1] + len(start))
                    self.ids.append(i)
        self.keys = np.concatenate(keys or [np.zeros(0, np.uint64)])
        self.item = np.concatenate(item or [np.zeros(0, np.int64)])
        self.offsets = np.array(offsets)
        lengths = np.diff(self.offsets)
        self.seeds = []
        for mask in MASKS:
            self._add(mask, lengths >= 0)
        # Parted into one more piece than they may have substitutions, items keep a piece whole.
        self.longest = int(lengths.max()) if len(lengths) else 0
        whole = {n: n // (n - int(need_equal(n)) + 1) for n in range(min_words, SHORT_WORDS + 1)}
        for size in sorted(set(whole.values())):
            short = np.isin(lengths, [n for n, k in whole.items() if k == size])
            if short.any():
                self._add(tuple(range(size)), short)

    def _add(self, mask: tuple[int, ...], items: np.ndarray) -> None:
        n = len(self.keys) - mask[-1]
        if n <= 0:
            return
        at = np.flatnonzero((self.item[:n] == self.item[mask[-1] :]) & items[self.item[:n]])
        if not len(at):
            return
        h = _seed(self.keys, mask, n)[at]
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.seeds.append((mask, h[order], at[order], bits))

    def hits(self, keys: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct hits worth aligning, as rows (text row, item, diagonal: word place in ``keys`` minus place in the index)."""
        found = [np.zeros((3, 0), np.int64)]
        for mask, hashes, places, bits in self.seeds:
            n = len(keys) - mask[-1]
            if n <= 0:
                continue
            h = _seed(keys, mask, n)
            at = np.flatnonzero(bits[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            at = at[row[at] == row[at + mask[-1]]]
            lo = np.searchsorted(hashes, h[at], side="left")
            hi = np.searchsorted(hashes, h[at], side="right")
            some = hi > lo
            at, lo, many = at[some], lo[some], (hi - lo)[some]
            upto = np.cumsum(many)
            a = 0
            while a < len(at):  # a word that repeats in both meets itself very often
                b = max(a + 1, int(np.searchsorted(upto, upto[a] - many[a] + HITS, side="right")))
                part = many[a:b]
                doc = np.repeat(at[a:b], part)
                place = places[np.repeat(lo[a:b] - (np.cumsum(part) - part), part) + np.arange(len(doc))]
                met = np.unique(np.stack([row[doc], self.item[place], doc - place]), axis=1)
                found.append(met[:, self._worth(met, keys, first)])
                a = b
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def _worth(self, met: np.ndarray, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which hits have as many equal words on their diagonal as a stretch takes."""
        rows, items, d = met
        a = np.maximum(self.offsets[items], first[rows] - d)
        long = np.minimum(self.offsets[items + 1], first[rows + 1] - d) - a
        out, upto, i = np.zeros(len(d), bool), np.cumsum(long), 0
        while i < len(d):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - long[i] + ALIGNED, side="right")))
            many = long[i:j]
            head = np.cumsum(many) - many
            place = np.repeat(a[i:j] - head, many) + np.arange(int(many.sum()))
            equal = self.keys[place] == keys[place + np.repeat(d[i:j], many)]
            out[i:j] = np.add.reduceat(equal, head, dtype=np.int64) >= need_equal(np.diff(self.offsets)[items[i:j]])
            i = j
        return out


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """[from, to) of the alignment with the greatest sum of 1 for equal and MISMATCH for unequal words."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, MISMATCH))])
    gain = total - np.minimum.accumulate(total)
    to = int(np.argmax(gain))
    return int(np.argmin(total[: to + 1])), to


def stretches(index: SeedIndex, keys: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, equal words, words of the stretch, first word place, first item word): the best of each hit."""
    first = np.searchsorted(row, np.arange(row[-1] + 2 if len(row) else 1))
    out = []
    rows, items, diagonals = index.hits(keys, row, first)
    for r, i, d in zip(rows.tolist(), items.tolist(), diagonals.tolist(), strict=True):
        q0, q1 = int(index.offsets[i]), int(index.offsets[i + 1])
        a, b = max(q0, int(first[r]) - d), min(q1, int(first[r + 1]) - d)
        equal = index.keys[a:b] == keys[a + d : b + d]
        s, e = best_stretch(equal)
        n = int(equal[s:e].sum())
        if n >= int(need_equal(q1 - q0)) and n >= MIN_IDENTITY * (e - s):
            out.append((r, i, n, e - s, a + d + s, a + s - q0))
    return out


def apart(found: list[tuple]) -> list[tuple]:
    """Of stretches (row, item, equal words, words, first place, ...) of one row and item that share words the best one, best first."""
    out: list[tuple] = []
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x in sorted(found, key=lambda x: (x[0], x[1], -x[2], x[3], x[4])):
        held = taken.setdefault(x[:2], [])
        k = bisect(held, (x[4], 0))
        before, after = held[k - 1] if k else None, held[k] if k < len(held) else None
        if (before is None or before[1] <= x[4]) and (after is None or x[4] + x[3] <= after[0]):
            held.insert(k, (x[4], x[4] + x[3]))
            out.append(x)
    return out


RESULT = "n_equal long, n_overlap long, item_words long, start_byte long, end_byte long, item_start long"


def find_overlaps(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per stretch that a text and a test item share: both keys, equal words, length and where it lies.

    ``start_byte``/``end_byte`` are places in the UTF-8 text, ``item_start`` a
    word of the item. ``docs`` is scanned once per block of test items.
    """
    spark = docs.sparkSession
    wanted = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("i"), F.col(item_text).cast("string").alias("t"))
    # No word is shorter than a byte and a separator, so bytes bound the words.
    size = wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    key_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, key), (items, item_key)))
    schema = f"`{key}` {key_type}, `{item_key}` {item_type}, {RESULT}"

    def scan(block: int) -> DataFrame:
        part = wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t").collect()  # one block
        held = spark.sparkContext.broadcast(SeedIndex([r["i"] for r in part], [r["t"] for r in part], min_words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                found: list[tuple] = []
                parts: list[tuple] = []  # stretches of a text that comes in windows, by its bytes
                for a, _, ended, _, heads, start, end, row, keys in W.word_runs(batch.column(1), W.SPACE_PUNCT, index.longest):
                    here = [(a + r, i, n, long, int(start[at] - heads[r]), int(end[at + long - 1] - heads[r]), item_at) for r, i, n, long, at, item_at in apart(stretches(index, keys, row))]
                    if parts or not ended:
                        # Windows overlap, so a stretch may come twice, and once cut short.
                        parts += [(r, i, n, e - s, s, (r, i, n, long, s, e, item_at)) for r, i, n, long, s, e, item_at in here]
                        if not ended:
                            continue
                        here, parts = [x[5] for x in apart(parts)], []
                    found += [(r, index.ids[i], n, long, int(index.offsets[i + 1] - index.offsets[i]), s, e, item_at) for r, i, n, long, s, e, item_at in here]
                cols = list(zip(*found, strict=True)) if found else [[]] * 8
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_arrow), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=[key, item_key, *(x.split()[0] for x in RESULT.split(", "))],
                )

        return rows.mapInArrow(lean(run), schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(items.schema[item_key].dataType)
    out = scan(0)
    for b in range(1, blocks):
        out = out.unionByName(scan(b))
    return out
