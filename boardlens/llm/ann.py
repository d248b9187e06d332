"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised apart (k-means each, fitted on a
bounded sample), so K centroids a half make K*K cells. Every row is indexed. A
query walks the centroid pairs by rising sum of its two squared distances, with
a heap, until the cells passed hold enough entries; the sum reached there is its
radius. All entries of cells within the radius are reranked by exact distance in
double precision. The cells go along with the query as bits: sums computed anew
would be rounded otherwise, and the last cell may lie exactly on the radius.

How many entries are enough is measured, not guessed: a bounded sample of the
queries is searched exactly and the budget is set so that their neighbours are
found at ``target_recall``.

Entries meet queries by (first centroid, slice): cells of a first centroid with
many rows are cut into slices of about ``SLICE_ROWS`` rows, so repeated vectors
that crowd one cell spread over tasks. Each entry travels once; a task holds the
entries of one slice, and the queries that reach it go past them in batches.
Partial results are k rows per query and slice.

Nulls and odd rows: vectors that are null, zero, hold null or non-finite
components take no part, as query or entry; neither do rows without an id.
Vectors of different lengths have no distance: those of each length are searched
among themselves. Equal distances go to the smaller id. Rows that share the
query's id are its own; a row that repeats is an entry each time. Fewer rows than
k give all of them; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.llm import shared

#: Rows that the codebooks are fitted on, queries that the budget is measured on.
FIT_ROWS, CALIBRATION_QUERIES = 20_000, 200
MAX_CENTROIDS = 256
SLICE_ROWS = 20_000
#: Queries that a task walks the cells for, about, and tasks at most.
WALK_ROWS, WALK_TASKS = 64, 1 << 14


def _matrix(column: pa.Array) -> np.ndarray:
    """A list<double> column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centroids of Lloyd's algorithm from k random rows; an empty cluster takes a random row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centroid(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def walk(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Centroid pairs by rising sum of distances (multi-sequence algorithm)."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap:
        s, i, j = heapq.heappop(heap)
        yield s, o1[i], o2[j]
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))


def radius(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, budget: int) -> float:
    """The sum at which the cells passed hold ``budget`` entries (infinite if all hold fewer)."""
    seen = 0
    for s, i, j in walk(d1, d2):
        seen += counts[i, j]
        if seen >= budget:
            return s
    return float("inf")


def entries_before(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, cells: list[tuple[int, int]]) -> list[int]:
    """For each cell, the entries passed when the walk has passed it."""
    left, seen, out = set(cells), 0, {}
    for _, i, j in walk(d1, d2):
        seen += int(counts[i, j])
        if (i, j) in left:
            out[i, j] = seen
            left.discard((i, j))
            if not left:
                break
    return [out[c] for c in cells]


def _top(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest, ties to smaller ids."""
    at = np.arange(len(dist))
    if len(dist) > k:
        at = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
    return at[np.lexsort((ids[at], dist[at]))][:k]


RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id long, v array<double>) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False)))


def search(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, target_recall: float = 0.96, centroids: int | None = None, seed: int = 7) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``vectors`` that ``is_query`` (a condition on ``id``).

    Returns query_id, rank, vec_id, score (Euclidean distance).
    """
    spark = vectors.sparkSession
    rows = shared.materialise(usable(vectors, key, vector), "ann-rows")
    out = spark.createDataFrame([], RESULT)
    for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():  # one row a length of vectors
        if r["count"] > 1:
            out = out.unionByName(_search(rows.where(F.size("v") == r["n"]), r["count"], is_query, k, target_recall, centroids, seed))
    return out


def _search(rows: DataFrame, total: int, is_query: Column, k: int, target_recall: float, centroids: int | None, seed: int) -> DataFrame:
    """:func:`search` among ``total`` vectors of one length."""
    spark = rows.sparkSession
    result = "query_id long, vec_id long, score double"
    order = F.xxhash64("id", F.lit(seed))
    sample = _matrix(rows.withColumn("h", order).orderBy("h", "id").limit(FIT_ROWS).select("v").toArrow()["v"])
    half = max(1, sample.shape[1] // 2)
    m = centroids or int(min(MAX_CENTROIDS, max(1, np.sqrt(total) / 1.8)))
    m = min(m, len(sample))
    book1 = kmeans(sample[:, :half], m, seed)
    book2 = kmeans(sample[:, half:], m, seed + 1) if sample.shape[1] > half else np.zeros((1, 0))
    books = spark.sparkContext.broadcast((book1, book2))  # at most 2 * MAX_CENTROIDS half vectors

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b1, b2 = books.value
        for batch in batches:
            x = _matrix(batch.column(1))
            if len(x):
                c1, c2 = nearest_centroid(x[:, :half], b1), nearest_centroid(x[:, half:], b2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c1, pa.int32()), pa.array(c2, pa.int32())], names=["id", "v", "c1", "c2"])

    index = shared.materialise(rows.mapInArrow(quantise, "id long, v array<double>, c1 int, c2 int"), "ann-index")
    counts = np.zeros((len(book1), len(book2)), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # at most MAX_CENTROIDS ** 2 rows
        counts[r[0], r[1]] = r[2]

    queries = rows.where(is_query)
    tried = queries.withColumn("h", order).orderBy("h", "id").limit(CALIBRATION_QUERIES).select("id", "v").toArrow()
    if not len(tried):
        return spark.createDataFrame([], RESULT)
    budget = _budget(spark, index, np.asarray(tried["id"]), _matrix(tried["v"]), (book1, book2), half, counts, k, target_recall)

    slices = np.maximum(1, -(-counts.sum(1) // SLICE_ROWS))
    n_queries = queries.count()
    held = spark.sparkContext.broadcast((counts, slices))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b1, b2 = books.value
        counts, slices = held.value
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            d1, d2 = squared_distances(x[:, :half], b1), squared_distances(x[:, half:], b2)
            out: list[list] = [[], [], [], []]
            for i in range(len(x)):
                r = radius(d1[i], d2[i], counts, budget)
                within = np.packbits(d1[i][:, None] + d2[i] <= r, axis=1)
                for c in np.flatnonzero(within.any(1) & (counts.sum(1) > 0)).tolist():
                    for s in range(int(slices[c])):
                        for col, val in zip(out, (i, c, s, within[c].tobytes()), strict=True):
                            col.append(val)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["id", "v", "c1", "slice", "cells"])

    tasks = min(WALK_TASKS, max(1, n_queries // WALK_ROWS))
    aimed = queries.repartition(tasks, "id").mapInArrow(aim, "id long, v array<double>, c1 int, slice int, cells binary")
    of = F.create_map(*[F.lit(x) for c, s in enumerate(slices.tolist()) for x in (c, int(s))])
    # By place in the index, not by id: rows that share an id are dealt out, too.
    entries = index.withColumn("slice", F.pmod(F.xxhash64(F.monotonically_increasing_id()), of[F.col("c1")]).cast("int"))
    entries = entries.select("c1", "slice", F.lit(False).alias("asks"), "id", "v", "c2", F.lit(None).cast("binary").alias("cells"))
    asking = aimed.select("c1", "slice", F.lit(True).alias("asks"), "id", "v", F.lit(None).cast("int").alias("c2"), "cells")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts = None, []
        x = ids = c2 = None
        for batch in batches:
            cells_of, asks = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]), np.asarray(batch.column(2))
            cuts = np.flatnonzero(np.any(cells_of[:, 1:] != cells_of[:, :-1], axis=0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if a == b:
                    continue
                if place != tuple(cells_of[:, a].tolist()):
                    place, parts, x = tuple(cells_of[:, a].tolist()), [], None
                run = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append((_matrix(run.column(4)), np.asarray(run.column(3)), np.asarray(run.column(5))))
                    continue
                if not parts:
                    continue
                if x is None:
                    x, ids, c2 = (np.concatenate(p) for p in zip(*parts, strict=True))
                q, q_ids = _matrix(run.column(4)), np.asarray(run.column(3))
                found: list[list[np.ndarray]] = [[], [], []]
                for i in range(len(q)):
                    within = np.unpackbits(np.frombuffer(run.column(6)[i].as_buffer(), np.uint8)).view(bool)
                    at = np.flatnonzero(within[c2] & (ids != q_ids[i]))
                    if len(at):
                        diff = x[at] - q[i]
                        dist = np.sqrt((diff * diff).sum(1))
                        best = _top(dist, ids[at], k)
                        for col, val in zip(found, (np.full(len(best), q_ids[i]), ids[at][best], dist[best]), strict=True):
                            col.append(val)
                cols = [np.concatenate(c) if c else np.zeros(0) for c in found]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    met = entries.unionByName(asking).repartition("c1", "slice").sortWithinPartitions("c1", "slice", "asks")
    partial = met.mapInArrow(rerank, result)
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Brute force for a bounded set of queries: (query_id, vec_id, score, extra...), k a query."""
    held = rows.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, q = held.value
        for batch in batches:
            x, ids = _matrix(batch.column(1)), np.asarray(batch.column(0))
            for i in range(len(q) if len(x) else 0):
                at = np.flatnonzero(ids != ids_q[i])
                rough = ((x[at] - q[i]) ** 2).sum(1)
                best = at[_top(rough, ids[at], k)]
                dist = np.sqrt(((x[best] - q[i]) ** 2).sum(1))
                take = pa.array(best, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), ids_q[i]), pa.int64()), pa.array(ids[best], pa.int64()), pa.array(dist, pa.float64()), *(batch.column(2 + j).take(take) for j in range(len(extra)))], names=["query_id", "vec_id", "score", *extra])

    partial = rows.select("id", "v", *extra).mapInArrow(run, "query_id long, vec_id long, score double" + "".join(f", {c} int" for c in extra))
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return partial.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def _budget(spark, index: DataFrame, q_ids: np.ndarray, q: np.ndarray, books, half: int, counts: np.ndarray, k: int, target: float) -> int:
    """Entries to pass so that the sampled queries' exact neighbours are found at ``target``."""
    by: dict[int, list[tuple[int, int]]] = {}
    for r in exact(index, q_ids, q, k, ("c1", "c2")).collect():  # k rows a sampled query
        by.setdefault(r["query_id"], []).append((r["c1"], r["c2"]))
    d1, d2 = squared_distances(q[:, :half], books[0]), squared_distances(q[:, half:], books[1])
    need = [n for i, one in enumerate(q_ids.tolist()) if one in by for n in entries_before(d1[i], d2[i], counts, by[one])]
    need.sort()
    return max(10 * k, need[min(len(need) - 1, int(np.ceil(target * len(need))))] if need else 0)
