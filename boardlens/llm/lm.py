"""Language-model scores: marginal probability of texts over all subword segmentations.

Texts are lower-cased (A-Z) and parted at ASCII white space; a text is its words
and one end. The pieces come from an existing vocabulary and are never trained;
their probabilities start at its scores and are fitted to the training words by
expectation maximisation (the file in use holds merge ranks, not probabilities).
Pieces do not cross words, so a text's marginal probability is the product of
its words', and each distinct word of the corpus goes through the lattice once
per round instead of once per occurrence.

The words of the training texts are pieces, too: of a word that occurs in them
the lattice has one more arc, over its whole length, weighted by its count less
a discount, over all tokens; the discounts' mass weighs the segmentations into
vocabulary pieces. The forward recursion sums over all of these, so ``score`` is
one proper distribution in which frequent words keep their frequency and new
words get what their pieces say, and what it learns grows with the corpus (the
vocabulary's own weights do not). ``lattice_score`` is the score without those
arcs.

All training texts are counted, all texts are scored. Words that occur often
(at most ``COMMON_WORDS`` of them, whatever the corpus) travel to the tasks as a
broadcast; the others are joined by word, so no key of the join is frequent.

Nulls and odd rows: a null or empty text is the end alone; rows that repeat
count as often as they occur; a null key trains and is scored like any other
(its checksum is null, so it is held out of nothing); with no training texts all
words are unknown; an empty table gives an empty result; columns other than key
and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.llm import shared
from boardlens.llm import words as W
from boardlens.llm.bpe import KeyTable
from boardlens.llm.lattice import Lattice, load_pieces

COMMON_WORDS = 1 << 18
#: Distinct words that a task counts before it hands its counts on.
TASK_WORDS = 1 << 20
#: Words that go through the lattice together.
LATTICE_WORDS = 1 << 16
#: Weight of the vocabulary's own scores against the counts, in pieces.
PRIOR_PIECES = 1000.0
EM_ROUNDS = 3


def _text_words(column: pa.Array):
    """(first row, rows, ended, lower-cased bytes, starts, ends, row of each word, keys) of runs of rows, long texts by windows."""
    for a, rows, ended, data, _, start, end, row, keys in W.word_runs(column):
        keys[keys == 0] = 1
        yield a, rows, ended, data, start, end, row, keys


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string array."""
    size = end - start
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    body = data[np.repeat(start - (ends - size), size) + np.arange(total)]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(body))


def count_words(docs: DataFrame, trains: Column, *, text: str = "text") -> DataFrame:
    """(word, c, n): occurrences in training texts and in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = KeyTable(), []
        counts = np.zeros((2, 1 << 16), np.int64)

        def emit() -> pa.RecordBatch:
            nonlocal table, held
            words = pa.concat_arrays(held)
            out = pa.RecordBatch.from_arrays([words, pa.array(counts[0, : len(words)].copy()), pa.array(counts[1, : len(words)].copy())], names=["word", "c", "n"])
            table, held = KeyTable(), []
            counts[:] = 0
            return out

        for batch in batches:
            train = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for a, _, _, data, start, end, row, keys in _text_words(batch.column(0)):
                if not len(keys):
                    continue
                at = table.find(keys)
                new = np.flatnonzero(at < 0)
                if len(new):
                    fresh, first = np.unique(keys[new], return_index=True)
                    held.append(_strings(data, start[new[first]], end[new[first]]))
                    table.insert(fresh, np.arange(table.n, table.n + len(fresh), dtype=np.int32))
                    at[new] = table.find(keys[new])
                    while table.n > counts.shape[1]:
                        counts = np.concatenate([counts, np.zeros_like(counts)], axis=1)
                counts[1, : table.n] += np.bincount(at, minlength=table.n)
                counts[0, : table.n] += np.bincount(at[train[a + row]], minlength=table.n)
                if table.n >= TASK_WORDS:
                    yield emit()
        if held:
            yield emit()

    rows = docs.select(F.col(text).cast("string").alias("t"), trains.alias("train"))
    parts = rows.mapInArrow(run, "word string, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Totals:
    """Of the training texts: tokens (ends included), distinct tokens, texts, words met once and twice."""

    tokens: int
    distinct: int
    texts: int
    once: int = 0
    twice: int = 0

    @property
    def discount(self) -> float:
        """What absolute discounting takes from each word's count."""
        return min(0.95, max(0.05, self.once / max(1, self.once + 2 * self.twice)))

    def whole(self, c: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Natural-log probability of words met c times whose pieces' lattice gives ``pieces``."""
        n = max(1, self.tokens)
        types = self.distinct - (self.texts > 0)
        arc = np.maximum(c - self.discount, 0.0) / n
        rest = max(self.discount * types, 1.0) / n
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(arc), math.log(rest) + pieces)

    def base(self, c):
        """Natural-log probability of a token that occurs c times, as a number or column."""
        below = math.log(self.tokens + 0.5 * (self.distinct + 1))
        return F.log(c + 0.5) - below if isinstance(c, Column) else np.log(c + 0.5) - below


def _batched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _bytes(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def fit_pieces(words: DataFrame, pieces: list[bytes], prior: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Natural-log probability by piece, fitted to the distinct training words of ``words`` (word, c).

    Each counts once: the pieces have to tell new words, not repeat frequent ones.
    """
    spark = words.sparkSession
    known = words.where("c > 0").select("word")
    logp = prior
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((pieces, logp))  # of the vocabulary's size

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*held.value)
            total = np.zeros(len(lattice.pieces))
            for part in _batched(batches, LATTICE_WORDS):
                total += lattice.expect(_bytes(part["word"]), np.ones(len(part)))
            at = np.flatnonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["piece", "uses"])

        uses = np.zeros(len(pieces))
        for r in known.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"]] = r["uses"]
        mass = uses + PRIOR_PIECES * np.exp(prior)
        logp = np.log(mass / mass.sum())
        held.unpersist()
    return logp


def score(docs: DataFrame, trains: Column, vocabulary: str, *, key: str = "doc_id", text: str = "text", rounds: int = EM_ROUNDS) -> DataFrame:
    """One row per text: key, n_tokens, n_known, train_tokens, base_score, lattice_score, score (log10)."""
    spark = docs.sparkSession
    words = shared.materialise(count_words(docs, trains, text=text), "lm-words")
    texts = docs.where(trains).count()
    sums = words.agg(F.sum("c"), *[F.sum(x.cast("long")) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)]).first()
    totals = Totals((sums[0] or 0) + texts, (sums[1] or 0) + (texts > 0), texts, sums[2] or 0, sums[3] or 0)
    pieces, prior = load_pieces(vocabulary)
    logp = fit_pieces(words, pieces, prior, rounds)
    end = math.log(max(texts, 0.5) / max(1, totals.tokens))
    model = spark.sparkContext.broadcast((pieces, logp))

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for part in _batched(batches, LATTICE_WORDS):
            sub = lattice.score(_bytes(part["word"]))
            part = part.append_column("sub", pa.array(sub, pa.float64())).append_column("whole", pa.array(totals.whole(np.asarray(part["c"], float), sub), pa.float64()))
            yield from part.combine_chunks().to_batches()

    scored = words.mapInArrow(through, "word string, c long, n long, sub double, whole double").withColumn("base", totals.base(F.col("c")))
    scored = shared.materialise(scored, "lm-scores")

    # The occurrences from which on at most COMMON_WORDS words are common, from a histogram of bounded size.
    step = F.floor(F.log2("n") * 16).cast("int")
    common_from, left = None, COMMON_WORDS
    for r in sorted(scored.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        left -= r["count"]
        if left < 0:
            break
        common_from = r["s"]
    is_common = step >= (common_from if common_from is not None else 1 << 30)
    common = scored.where(is_common).select("word", "c", "base", "sub", "whole").toArrow()
    data = np.frombuffer(b"".join(_bytes(common["word"])), np.uint8)
    size = np.fromiter(map(len, _bytes(common["word"])), np.int64, len(common))
    keys = W.span_keys(data, np.cumsum(size) - size, np.cumsum(size)) if len(common) else np.zeros(0, np.uint64)
    keys[keys == 0] = 1
    held = spark.sparkContext.broadcast((keys, *(np.asarray(common[x], np.float64) for x in ("base", "sub", "whole")), np.asarray(common["c"]) > 0))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_c, base_c, sub_c, whole_c, known_c = held.value
        table = KeyTable()
        table.insert(keys_c, np.arange(len(keys_c), dtype=np.int32))
        for batch in batches:
            seen: list[tuple] = []  # of a text that comes in windows
            for a, rows, ended, data, start, end, row, keys in _text_words(batch.column(1)):
                at = table.find(keys)
                hit, rare = at >= 0, np.flatnonzero(at < 0)
                sums = [np.bincount(row[hit], weights=v[at[hit]], minlength=rows) for v in (base_c, sub_c, whole_c, known_c.astype(float))]
                many = np.bincount(row, minlength=rows)
                cuts = np.searchsorted(row[rare], np.arange(rows + 1)).astype(np.int32)
                words = _strings(data, start[rare], end[rare])
                if seen or not ended:
                    seen.append((sums, many, words))
                    if not ended:
                        continue
                    sums, many, words = [sum(x) for x in zip(*(h[0] for h in seen), strict=True)], sum(h[1] for h in seen), pa.concat_arrays([h[2] for h in seen])
                    cuts, seen = np.array([0, len(words)], np.int32), []
                lists = pa.ListArray.from_arrays(pa.array(cuts), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), pa.array(many, pa.int64()), pa.array(sums[3].astype(np.int64)), *map(pa.array, sums[:3]), lists],
                    names=["k", "n_words", "n_known", "base", "sub", "whole", "rare"],
                )

    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    part = rows.mapInArrow(add_up, f"k {key_type}, n_words long, n_known long, base double, sub double, whole double, rare array<string>")
    part = shared.materialise(part.withColumn("row", F.monotonically_increasing_id()), "lm-texts")
    rare = part.select("row", F.explode("rare").alias("word")).join(scored.where(~is_common).select("word", "c", "base", "sub", "whole"), "word")
    rare = rare.groupBy("row").agg(F.sum("base").alias("rare_base"), F.sum("sub").alias("rare_sub"), F.sum("whole").alias("rare_whole"), F.sum((F.col("c") > 0).cast("long")).alias("rare_known"))
    out = part.drop("rare").join(rare, "row", "left")
    ln10 = math.log(10)
    zero = F.lit(0)
    return out.select(
        F.col("k").alias(key),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", zero) + int(texts > 0)).alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        ((F.col("base") + F.coalesce("rare_base", zero) + float(totals.base(texts))) / ln10).alias("base_score"),
        ((F.col("sub") + F.coalesce("rare_sub", zero) + end) / ln10).alias("lattice_score"),
        ((F.col("whole") + F.coalesce("rare_whole", zero) + end) / ln10).alias("score"),
    )
