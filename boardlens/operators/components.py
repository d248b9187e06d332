"""Connected components of an edge table: spanning forests per task, then boards in groups, rounds for what is large."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.plans.workers import ensure_importable
from boardlens.sources.scratch import drop_table, materialise


#: Edges that one task may take whole; edges of small boards that a task takes together about.
LOCAL_EDGES, GROUP_EDGES = 1 << 20, 1 << 18


def _label(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of an edge list held in memory."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _codes(column: pa.Array) -> np.ndarray:
    """Places of the values among the sorted distinct ones (strings in byte order, as Spark compares them)."""
    coded = pc.dictionary_encode(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    place = np.empty(len(coded.dictionary), np.int64)
    place[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(place))
    return place[np.asarray(coded.indices)]


def _stars(edges: pa.Table) -> pa.Table:
    """(keys..., node, smallest node reachable) of an edge table (keys..., s, d) held in memory."""
    ends = pa.concat_arrays([c for x in ("s", "d") for c in edges[x].chunks])
    code, n = _codes(ends), edges.num_rows
    board = np.zeros(n, np.int64)
    for k in edges.column_names[:-2]:
        own = _codes(edges[k])
        _, board = np.unique(board * (int(own.max()) + 1) + own, return_inverse=True)
    at = code + np.tile(board, 2) * (int(code.max()) + 1)
    nodes, root = _label(at[:n], at[n:])
    values, first = np.unique(at, return_index=True)  # of each node a place where it stands
    of = {c: edges[c].take(pa.array(first % n)) for c in edges.column_names[:-2]}
    return pa.table(of | {"s": ends.take(pa.array(first)), "d": ends.take(pa.array(first[np.searchsorted(values, root)]))})


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join the same nodes: each node of a run of edges with the smallest one that it reaches there."""
    held, rows, stars = [], 0, 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows - stars >= GROUP_EDGES:
            table = _stars(pa.Table.from_batches(held))
            held, rows = table.to_batches(), table.num_rows
            stars = rows
            if stars > 2 * GROUP_EDGES:
                yield from held
                held, rows, stars = [], 0, 0
    if rows:
        yield from _stars(pa.Table.from_batches(held)).to_batches()


def local_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) as :func:`connected_components`, in one task: for long ends and a checked number of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            ends = [np.concatenate([np.asarray(x.column(i)) for x in held]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _label(*ends)], names=["node", "component"])

    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long"), F.col(b).cast("long"))
    return materialise(pairs.repartition(1).mapInArrow(run, "node long, component long"), "cc")


def _rounds(edges: DataFrame, on: list[str]) -> DataFrame:
    """(keys..., node, component) by label propagation and pointer jumping over whole tables."""
    both = materialise(edges.select(*on, "s", "d").union(edges.select(*on, "d", "s")).distinct(), f"cc-edges-{uuid.uuid4().hex[:6]}")
    labels = materialise(both.groupBy(*on, F.col("s").alias("node")).agg(F.least(F.col("s"), F.min("d")).alias("lab")), "cc")
    while True:
        near = both.join(labels.select(*on, F.col("node").alias("s"), "lab"), [*on, "s"]).groupBy(*on, F.col("d").alias("node")).agg(F.min("lab").alias("near"))
        own = labels.join(near, [*on, "node"]).select(*on, "node", F.col("lab").alias("old"), F.least("lab", "near").alias("lab"))
        # Follow the label: the label of one's label is never larger.
        heads = labels.select(*on, F.col("node").alias("lab"), F.col("lab").alias("head"))
        step = own.join(heads, [*on, "lab"], "left").select(*on, "node", "old", F.least(F.col("lab"), F.coalesce("head", "lab")).alias("lab"))
        done = materialise(step, "cc")
        changed = done.where("lab <> old").limit(1).count()
        drop_table(labels)
        labels = done.drop("old")
        if not changed:
            drop_table(both)
            return labels.select(*on, "node", F.col("lab").alias("component"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., node, component) for every node of ``edges``; component is the smallest node reachable.

    Each task first reduces its edges to a spanning forest, so what is written is
    bounded by nodes, not edges. Boards (``keys``; all edges are one if there are
    none) whose forests hold at most ``LOCAL_EDGES`` edges are then solved whole,
    many small ones to a task. Larger ones go in rounds over all executors: the
    smallest label around every node, then labels of labels until nothing
    changes, each round written to the shared folder, so lineage stays short and
    a lost executor costs no more than a round. Self-loops and repeated edges do
    no harm; rows with a null end are ignored, a null key is a board of its own
    (but joins nothing in a large one); no edges give no rows.
    """
    ensure_importable(edges.sparkSession)
    on = list(keys)
    names = [f"_k{i}" for i in range(len(on))]
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(on, names, strict=True)], F.col(a).alias("s"), F.col(b).alias("d"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    forest = materialise(pairs.mapInArrow(_forest, schema), "cc-forest")
    sizes = forest.groupBy(*names).count()
    most, total = sizes.agg(F.max("count"), F.sum("count")).first()
    small = forest
    if (most or 0) > LOCAL_EDGES:
        large = sizes.where(F.col("count") > LOCAL_EDGES).select(*names) if names else None
        small = forest.join(large, names, "left_anti") if names else forest.limit(0)
    group = F.pmod(F.xxhash64(*names), F.lit(max(1, -(-(total or 0) // GROUP_EDGES)))) if names else F.lit(0).cast("long")
    solved = small.withColumn("_group", group).groupBy("_group").applyInArrow(lambda t: _stars(t.drop_columns(["_group"])), schema)
    back = [F.col(n).alias(k) for k, n in zip(on, names, strict=True)]
    found = solved.select(*back, F.col("s").alias("node"), F.col("d").alias("component"))
    if (most or 0) > LOCAL_EDGES:
        rest = _rounds(forest.join(large, names, "left_semi") if names else forest, names)
        found = found.unionByName(rest.select(*back, "node", "component"))
    out = materialise(found, "cc")
    drop_table(forest)
    return out
