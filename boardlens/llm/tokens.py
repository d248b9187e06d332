"""Token-id shards: encode texts, write wavelet-matrix files, read them back.

``write_token_shards`` deals the documents out by ranges of their key, encodes
each range in order and rolls a new file whenever the open one is full. Files
appear under their final name only when whole, and a retried task writes the
same bytes under the same names, so lost executors cost repetition and nothing
else. The manifest (one row per file) is the only thing the driver handles, as
a table.

A manifest answers by ranged reads of its files: ``token_at`` which ids are at
given places of all ids, ``count_tokens`` how often ids occur, ``find_token``
where one occurs.

Nulls, ties and odd rows: a null text is empty; null keys come first; rows with
equal keys are kept, ordered by text; an empty table gives an empty manifest;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlens.llm import bpe, shared, wavelet
from boardlens.llm.words import ints

MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"
#: Ids in a shard file, about (a document is never split between files).
SHARD_TOKENS = 1 << 20


def write_token_shards(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, *, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` and write shard files below ``out_dir``; returns the manifest (written there too)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt, seq = task.partitionId(), task.taskAttemptId(), 0
        coder = bpe.load(tokenizer)
        held: list[tuple] = []
        n_held = 0

        def roll() -> pa.RecordBatch:
            nonlocal held, n_held, seq
            ids, keys, valid, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{out_dir}/part-{part:06d}-{seq:06d}.wm"
            shared.write_bytes(path, wavelet.write_shard(ids, keys, valid, counts), str(attempt))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": len(keys), "n_tokens": len(ids)}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            held, n_held, seq = [], 0, seq + 1
            return row

        for batch in batches:
            keys, valid = ints(batch.column(0))
            for a, b, counts, ids in coder.encode(batch.column(1)):
                counts, ids = bpe.with_end(counts, ids, end_id)
                held.append((ids, keys[a:b], valid[a:b], counts))
                n_held += len(ids)
                if n_held >= shard_tokens:
                    yield roll()
        if held:
            yield roll()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    manifest = ordered.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{out_dir}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with each file's ``start``: ids in all files before it.

    Sums of parts are added up first, so no task sees every file: one row per
    part meets in one task, files meet only with those of their part.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").select("path", "n_tokens", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"))


def read_token_shards(manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: key, start, n_tokens, ids_crc32 (and ids).

    ``ids`` is binary: little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = wavelet.Shard(shared.read_bytes(path))
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                cut = list(zip(starts.tolist(), ends.tolist(), strict=True))
                cols = {
                    "key": pa.array(shard.doc_ids, pa.int64(), mask=~shard.doc_valid),
                    "start": pa.array(start + starts, pa.int64()),
                    "n_tokens": pa.array(shard.lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in cut], pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([ids[a:b].tobytes() for a, b in cut], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return _spread(shard_starts(manifest), "path", "start").mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_at(manifest: DataFrame, places: DataFrame, *, place: str = "place") -> DataFrame:
    """(place, token) of the distinct ``places`` among all ids; places outside them, and null, have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, starts, wanted = (batch.column(c).to_pylist() for c in ("path", "start", "place"))
            tokens, at = [], 0
            while at < len(batch):  # rows are in order of path
                end = at
                with shared.open_ranges(paths[at]) as ranges:
                    shard = wavelet.Shard(ranges)
                    while end < len(batch) and paths[end] == paths[at]:
                        tokens.append(shard.access(wanted[end] - starts[end]))
                        end += 1
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(tokens, pa.int64())], names=["place", "token"])

    # Files and places meet by runs of SHARD_TOKENS places: a file lies in few of them.
    run = lambda c: F.floor(c / SHARD_TOKENS)
    files = shard_starts(manifest).withColumn("run", F.explode(F.sequence(run(F.col("start")), run(F.col("start") + F.col("n_tokens") - 1))))
    wanted = places.select(F.col(place).cast("long").alias("place")).distinct().withColumn("run", run(F.col("place")))
    met = wanted.join(files, "run").where("place >= start AND place < start + n_tokens").select("path", "start", "place")
    return met.repartition("path").sortWithinPartitions("path", "place").mapInArrow(read, "place long, token long")


def count_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n) of the given ids over all files."""
    tokens = sorted(set(tokens))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with shared.open_ranges(path) as ranges:
                    shard = wavelet.Shard(ranges)
                    yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    each = _spread(manifest, "path").mapInArrow(read, "token long, n long")
    asked = manifest.sparkSession.createDataFrame([(t,) for t in tokens], "token long")
    return asked.join(each.groupBy("token").agg(F.sum("n").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def find_token(manifest: DataFrame, token: int) -> DataFrame:
    """(place): where ``token`` occurs among all ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with shared.open_ranges(path) as ranges:
                    shard = wavelet.Shard(ranges)
                    n = shard.count(token)
                    for k in range(0, n, 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([start + shard.select(token, i) for i in range(k, min(n, k + 10_000))], pa.int64())], names=["place"])

    return _spread(shard_starts(manifest), "path", "start").mapInArrow(read, "place long")


def _spread(files: DataFrame, *columns: str) -> DataFrame:
    """A row per file, dealt out to as many tasks as there are files (4,096 at most)."""
    return files.select(*columns).repartition(max(1, min(files.count(), 4096)), "path")
