"""Toxicity scores from a character n-gram classifier with naive Bayes feature scaling.

Every character n-gram (code points, lower case, white space as one kind of
space) is hashed into 2**HASH_BITS features; a text has a feature or not, however
often. On labelled texts the features' document counts in both classes give
naive Bayes log-count ratios; the features whose class shares differ most clearly
are kept, each is scaled by its ratio, and a logistic regression with a penalty
on squared weights is fitted to the scaled features, which are not standardised
after that: the ratios decide how much a feature may say. Scoring adds up the
weights of all features of the whole text, taken by windows.

The fit uses at most ``max_rows`` labelled texts (those with the smallest key
hashes, so the same ones each time); everything else covers all rows. The driver
holds three arrays of the features' number and the kept features of those texts.

Nulls and odd rows: a null or empty text scores what the intercept and its two
spaces give; labels without a document, with a null key or null are not learned
from; a null key is scored like any other; a key labelled twice counts once, as
toxic if any label says so; rows that repeat are scored alike (and learned from
as often as they occur); without labels of both classes every score is the share
of toxic labels (0.5 if there are none); an empty table gives an empty result;
columns may have any names, one named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from boardlens.llm.shared import lean, numbered

HASH_BITS = 20
ORDERS = (3, 4, 5, 6, 7)
#: Labelled texts that a fit takes at most.
MAX_ROWS = 8_000
#: Features that a fit keeps at most.
MAX_FEATURES = 2_000
#: Documents of both classes in which a kept feature occurs at least, and its least z-score.
MIN_DOCS, MIN_Z = 5, 5.0
#: Penalty of the squared weights of the scaled features.
L2 = 1e-3


def _windows(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray]]:
    """(first row, end row, whether these rows end here, code points, place of each row's end mark).

    Texts beyond ``limit`` code points come alone, in windows that overlap by
    the longest n-gram less one.
    """

    def coded(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("\0".join([*held, ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        points[(points > 0) & (points < 33)] = 32
        return points, np.flatnonzero(points == 0)

    first, held, size = 0, [], 0
    for i in range(len(column)):
        t = " " + (column[i].as_py() or "").replace("\0", " ") + " "
        if held and size + len(t) > limit:
            yield first, i, True, *coded(held)
            held, size = [], 0
        if len(t) > limit:
            for a in range(0, len(t), limit):
                yield i, i + 1, a + limit >= len(t), *coded([t[a : a + limit + max(ORDERS) - 1].lower()])
            continue
        if not held:
            first = i
        held.append(t.lower())
        size += len(t)
    if held:
        yield first, len(column), True, *coded(held)


def _features(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (feature of the n-gram at each place, whether it lies within one text)."""
    ends = np.cumsum(points == 0)
    h = points.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            return
        h = h[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n in ORDERS:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = (ends[n - 1 :] == ends[: len(h)]) & (points[: len(h)] != 0)
            yield (x >> np.uint64(64 - HASH_BITS)).astype(np.int64), inside


def present(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row less the first, feature) of the distinct features of each text; of ``wanted`` ones only, if given."""
    open_text: np.ndarray | None = None
    for first, end, ended, points, marks in _windows(column):
        keys = []
        for f, inside in _features(points):
            at = np.flatnonzero(inside if wanted is None else inside & wanted[f])
            keys.append(np.searchsorted(marks, at) << HASH_BITS | f[at])
        found = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]))
        if open_text is not None:
            found = np.union1d(open_text, found)
        open_text = None if ended else found
        if ended:
            yield first, end, found >> HASH_BITS, found & ((1 << HASH_BITS) - 1)


@dataclass
class Model:
    """``weight`` by feature (float32) and ``bias`` of the log-odds."""

    weight: np.ndarray
    bias: float

    def log_odds(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        wanted = self.weight != 0
        for first, end, row, feature in present(column, wanted):
            out[first:end] += np.bincount(row, weights=self.weight[feature], minlength=end - first)
        return out


def naive_bayes_ratios(df1: np.ndarray, df0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """log of (smoothed share of toxic / of other documents' feature mass) by feature."""
    p, q = df1 + 1.0, df0 + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum()) if n1 and n0 else np.zeros(len(df1))


def _choose(df1: np.ndarray, df0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    share = (df1 + df0) / (n1 + n0)
    z = np.abs(df1 / n1 - df0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    z[(df1 + df0 < MIN_DOCS) | (z < MIN_Z)] = 0
    top = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    return np.sort(top[z[top] > 0])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = L2, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean log loss plus l2/2 of the squared weights, by accelerated gradient steps.

    The columns are taken as they are: a column of larger values pays less for
    its share in a score.
    """
    n, m = x.shape
    w, b = np.zeros(m, x.dtype), float(np.log(y.mean() / (1 - y.mean())))
    v = np.ones(m, x.dtype)
    for _ in range(15):  # the largest curvature, by power iteration
        v = x.T @ (x @ (v / max(float(np.linalg.norm(v)), 1e-30)))
    step = 4.0 / (1.2 * float(np.linalg.norm(v)) / n + 4 * l2 + 1)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(x @ vw + vb, -40, 40))) - y).astype(x.dtype)
        nw, nb = vw - np.float32(step) * (x.T @ g / n + np.float32(l2) * vw), vb - step * float(g.mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + np.float32((t - 1) / nt) * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on ``labelled`` (one row per text; ``label`` 0 or 1)."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(text).cast("string").alias("t"), (F.col(label) != 0).cast("int").alias("y"))
    # An exact bound on the hash finds the sample without moving texts.
    bound = rows.select("h", "k", "y").orderBy("h", "k").limit(max_rows).agg(F.max("h"), F.count("*"), F.sum("y")).first()
    n, n1 = bound[1], bound[2] or 0
    if not n1 or n1 == n:
        share = 0.5 if not n else min(max(n1 / n, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << HASH_BITS, np.float32), float(np.log(share / (1 - share))))
    sample = rows.where(F.col("h") <= bound[0]).select("t", "y")
    slices = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, 1 << HASH_BITS), np.int64)
        seen = np.zeros(2, np.int64)
        for batch in batches:
            y = np.asarray(batch.column(1))
            np.add.at(seen, y, 1)
            for first, _, row, feature in present(batch.column(0)):
                np.add.at(df, (y[first + row], feature), 1)
        if seen.any():
            parts = df.reshape(2, slices, -1).swapaxes(0, 1)
            yield pa.RecordBatch.from_pydict({"s": pa.array(range(slices), pa.int32()), "df": pa.array([p.tobytes() for p in parts], pa.binary()), "n0": pa.array([int(seen[0])] * slices, pa.int64()), "n1": pa.array([int(seen[1])] * slices, pa.int64())})

    def add(part: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x, np.int64) for x in part["df"].to_pylist()), np.zeros(2 * (1 << HASH_BITS) // slices, np.int64))
        return pa.table({"s": pa.array([part["s"][0].as_py()], pa.int32()), "df": pa.array([total.tobytes()], pa.binary()), "n0": pa.array([sum(part["n0"].to_pylist())], pa.int64()), "n1": pa.array([sum(part["n1"].to_pylist())], pa.int64())})

    schema = "s int, df binary, n0 long, n1 long"
    sums = sorted(sample.mapInArrow(lean(count), schema).groupBy("s").applyInArrow(add, schema).collect())
    df0, df1 = np.concatenate([np.frombuffer(r["df"], np.int64).reshape(2, -1) for r in sums], axis=1)
    n0, n1 = sums[0]["n0"], sums[0]["n1"]
    ratio = naive_bayes_ratios(df1, df0, n1, n0)
    chosen = _choose(df1, df0, n1, n0)
    weight = np.zeros(1 << HASH_BITS, np.float32)
    if not len(chosen):
        return Model(weight, float(np.log(n1 / n0)))
    wanted = np.zeros(1 << HASH_BITS, bool)
    wanted[chosen] = True
    shared_wanted = labelled.sparkSession.sparkContext.broadcast(wanted)  # 2**HASH_BITS bytes

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, row, feature in present(batch.column(0), shared_wanted.value):
                cuts = pa.array(np.searchsorted(row, np.arange(end - first + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, end - first).cast(pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(feature, pa.int32()))], names=["y", "f"])

    data = sample.mapInArrow(lean(kept), "y int, f array<int>").toArrow()  # at most max_rows lists of MAX_FEATURES
    y, f = np.asarray(data["y"]).astype(np.float32), data["f"].combine_chunks()
    where = np.repeat(np.arange(len(y)), np.diff(np.asarray(f.offsets)))
    x = np.zeros((len(y), len(chosen)), np.float32)
    col = np.searchsorted(chosen, np.asarray(f.flatten()))
    x[where, col] = ratio[chosen].astype(np.float32)[col]
    w, bias = logistic(x, y)
    weight[chosen] = w * ratio[chosen]
    return Model(weight, bias)


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity of each whole text as ``out`` (in place of a column of that name); other columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes a feature, whatever the input
    keep = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = held.value.log_odds(batch.column(at))
            p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(p, pa.float64())], names=[*keep, out])

    plain = text in keep and docs.schema[text].dataType == StringType()
    at = keep.index(text) if plain else len(keep)
    rows = numbered(docs, keep, *[] if plain else [F.col(f"`{text}`").cast("string")])
    return rows.mapInArrow(lean(run), StructType([*(docs.schema[c] for c in keep), StructField(out, DoubleType())]))


def learnable(key: Column) -> Column:
    """Keys whose labels a query may learn from: crc32 of the key's text mod 5 is not 0 (a null key is one that has no such remainder)."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 != 0, F.lit(True))


def with_labels(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Texts with their label, one row per labelled key that may be learned from."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & learnable(F.col(key))).groupBy(key).agg(F.max(label).alias(label))
    return docs.select(key, text).join(one, key)
