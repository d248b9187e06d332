"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents longer than a sequence give whole sequences from their start; what is
left of each is rounded up to a length class of ``grain`` tokens. The counts per
class (a histogram of fixed size, the only thing that reaches the driver) are
the demands of a cutting-stock problem: a linear program over patterns (how many
pieces of each class share a sequence) starts from one-class patterns, and a
knapsack dynamic program over its dual prices finds the next pattern worth
adding until none is. The pattern counts are rounded down; what they leave over
is packed best-fit-decreasing into patterns of their own. Then the k-th document
of a class takes the class's k-th slot, counted through the patterns in order.

The rank of a document in its class is found without bringing a class together:
rows are written once with a number of their own and hashed by it into buckets,
documents are ranked inside (class, bucket), and the buckets' sizes add up to
offsets. So neither a length nor a key that a third of all documents share costs
more than any other, and a task that runs again ranks its rows as before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.llm.shared import materialise

#: What :func:`pack` adds.
ADDED = ("piece", "start", "piece_length", "sequence_id", "offset")
#: Rows of one (class, bucket) group at which more buckets are taken.
ROWS_PER_BUCKET = 200_000


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of classes within ``capacity`` (unbounded knapsack, dynamic program)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fits = int(np.searchsorted(sizes, w, side="right"))
        best[w] = best[w - 1]
        if fits:
            value = best[w - sizes[:fits]] + prices[:fits]
            k = int(np.argmax(value))
            if value[k] > best[w] + 1e-12:
                best[w], pick[w] = value[k], k
    pattern = np.zeros(len(sizes))
    w = capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            pattern[pick[w]] += 1
            w -= int(sizes[pick[w]])
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, sizes: np.ndarray, capacity: int, max_rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns by row, fractional uses) of the cutting-stock linear program.

    ``sizes`` ascend. ``max_rounds`` only bounds how close to the optimum the
    program comes; any state of it is a feasible packing.
    """
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)  # column p: pieces of each class
    cost = np.ones(m)  # 0 for a surplus column: more pieces of a class than it needs
    inverse = np.diag(1.0 / np.diag(patterns))
    uses = inverse @ demand
    for _ in range(max_rounds):
        prices = cost @ inverse
        low = int(np.argmin(prices))
        if prices[low] < -1e-9:
            new, price = np.zeros(m), 0.0
            new[low] = -1
        else:
            value, new = best_pattern(prices, sizes, capacity)
            if value <= 1 + 1e-7:
                break
            price = 1.0
        change = inverse @ new
        able = change > 1e-9
        if not able.any():
            break
        steps = np.where(able, uses / np.where(able, change, 1), np.inf)
        leave = int(np.argmin(steps))
        step = steps[leave]
        uses = np.maximum(uses - step * change, 0)
        uses[leave] = step
        row = inverse[leave] / change[leave]
        inverse -= np.outer(change, row)
        inverse[leave] = row
        patterns[:, leave] = new
        cost[leave] = price
    return patterns.T.round().astype(np.int64)[cost > 0], uses[cost > 0]


def plan_patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pieces by class, number of sequences)] that hold exactly or more than ``demand``."""
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(c)] for c in sizes], np.int64)
    patterns, uses = column_generation(need.astype(float), sizes, capacity)
    out: list[tuple[dict[int, int], int]] = []
    left = need.copy()
    for pattern, use in sorted(zip(patterns.tolist(), uses.tolist(), strict=True), key=lambda x: -x[1]):
        pattern = np.array(pattern)
        some = pattern > 0
        n = int(min(np.floor(use + 1e-6), (left[some] // pattern[some]).min())) if some.any() else 0
        if n > 0:
            out.append(({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(some)}, n))
            left -= n * pattern
    # What rounding leaves over: a few pieces for each pattern at most.
    space: dict[int, list[dict[int, int]]] = {}
    for i in np.argsort(-sizes):
        c = int(sizes[i])
        for _ in range(int(left[i])):
            room = min((r for r, bins in space.items() if r >= c and bins), default=None)
            one = space[room].pop() if room is not None else {}
            one[c] = one.get(c, 0) + 1
            space.setdefault((capacity if room is None else room) - c, []).append(one)
    return out + [(one, 1) for bins in space.values() for one in bins]


def pack(docs: DataFrame, length: str, key: str, *, size: int = 2048, grain: int = 8) -> DataFrame:
    """Cut and pack ``docs`` (one row each, ``length`` ids) into sequences of ``size`` ids.

    Returns the rows of ``docs``, one per piece, with ``piece`` (number in the
    document), ``start``, ``piece_length``, ``sequence_id`` and ``offset``.
    Rows without ids (null or 0) have no piece; rows that share a key, or repeat,
    are packed as documents of their own; an empty table gives no pieces. Names
    beginning with ``_pk_`` are reserved, columns named as the results are
    replaced.
    """
    n = F.coalesce(F.col(length).cast("long"), F.lit(0))
    rows = docs.where(n > 0).withColumns({"_pk_full": F.floor(n / size).cast("long"), "_pk_rest": (n % size).cast("long"), "_pk_row": F.monotonically_increasing_id()})
    rows = rows.withColumn("_pk_class", F.ceil(F.col("_pk_rest") / grain).cast("int")).drop(*[c for c in ADDED if c != key])
    rows = materialise(rows, "packing-rows")
    hist = {r[0]: r[1] for r in rows.groupBy("_pk_class").count().collect()}  # at most size / grain + 1 rows
    buckets = int(min(1 << 14, max(64, max(hist.values(), default=0) // ROWS_PER_BUCKET)))
    rows = rows.withColumn("_pk_bucket", F.pmod(F.xxhash64("_pk_row"), F.lit(buckets)).cast("int"))

    plan = plan_patterns({c: k for c, k in hist.items() if c}, size // grain)
    slots, sequences, filled = [], 0, {}
    for pattern, times in plan:
        at = 0
        for c, k in sorted(pattern.items(), reverse=True):
            lo = filled.get(c, 0)
            filled[c] = lo + k * times
            slots.append((c, lo, lo + k * times, k, sequences, at))
            at += k
        sequences += times

    spark = docs.sparkSession
    slots_df = spark.createDataFrame(slots, "_pk_class int, _pk_lo long, _pk_hi long, _pk_many long, _pk_seq long, _pk_at long")
    sums = rows.groupBy("_pk_class", "_pk_bucket").agg(F.count("*").alias("_pk_n"), F.sum("_pk_full").alias("_pk_f"))
    upto = Window.partitionBy("_pk_class").orderBy("_pk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    full = {r[0]: r[1] for r in sums.groupBy("_pk_class").agg(F.sum("_pk_f")).collect()}
    base, at = {}, sequences
    for c in sorted(full):
        base[c] = at
        at += full[c]
    base_of = F.create_map(*[F.lit(x) for c in sorted(base) for x in (c, base[c])]) if base else F.create_map(F.lit(0), F.lit(0))
    sums = sums.select(
        "_pk_class",
        "_pk_bucket",
        F.coalesce(F.sum("_pk_n").over(upto), F.lit(0)).alias("_pk_n0"),
        (F.coalesce(F.sum("_pk_f").over(upto), F.lit(0)) + base_of[F.col("_pk_class")]).alias("_pk_f0"),
    )
    group = Window.partitionBy("_pk_class", "_pk_bucket").orderBy(key, "_pk_row")
    ranked = rows.withColumns({"_pk_k": F.row_number().over(group).cast("long") - 1, "_pk_fb": F.coalesce(F.sum("_pk_full").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ranked = ranked.join(sums, ["_pk_class", "_pk_bucket"]).withColumns({"_pk_k": F.col("_pk_k") + F.col("_pk_n0"), "_pk_f0": F.col("_pk_f0") + F.col("_pk_fb")})

    own = [c for c in rows.columns if not c.startswith("_pk_") and c not in ADDED]
    whole = ranked.where(F.col("_pk_full") > 0).select(*own, "_pk_f0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pk_full") - 1)).alias("piece"))
    whole = whole.select(*own, "piece", (F.col("piece") * size).alias("start"), F.lit(size).cast("long").alias("piece_length"), (F.col("_pk_f0") + F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # The slots table has a row for each class of each pattern: bounded by size / grain, not by the data.
    k: Column = F.col("_pk_k") - F.col("_pk_lo")
    rest = ranked.where(F.col("_pk_class") > 0).join(F.broadcast(slots_df), (ranked["_pk_class"] == slots_df["_pk_class"]) & (F.col("_pk_k") >= F.col("_pk_lo")) & (F.col("_pk_k") < F.col("_pk_hi")))
    rest = rest.select(*own, "_pk_full", "_pk_rest", (F.col("_pk_seq") + F.floor(k / F.col("_pk_many"))).alias("sequence_id"), (F.col("_pk_at") + k % F.col("_pk_many")).alias("_pk_slot"))
    before = Window.partitionBy("sequence_id").orderBy("_pk_slot").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.select(*own, F.col("_pk_full").alias("piece"), (F.col("_pk_full") * size).alias("start"), F.col("_pk_rest").alias("piece_length"), "sequence_id", F.coalesce(F.sum("_pk_rest").over(before), F.lit(0)).alias("offset"))
    return whole.unionByName(rest)
