"""Snapshots of boards as partitioned tables, their headers, history and latest pointers.

A snapshot is the partition (board_id, snapshot_id) of the tables nodes, edges,
clusters and relations; writing one replaces that partition only, reading one
prunes to it. Headers, history entries and pointers are appended; the newest of
a board counts, so a write that is repeated changes nothing. Mutations are
serialised within the process.
"""

from __future__ import annotations

import threading
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.operators import history
from boardlens.sources.scratch import drop_dir, drop_table, materialise

SCHEMA_VERSION = 3
TABLES = ("nodes", "edges", "clusters", "relations")
HEADER = "board_id string, snapshot_id string, node_hash string, created_at_ms long, doc_structure_hint string, ingest_mode string, custom_phases array<string>, schema_version int, seq long"
_LOCK = threading.Lock()


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def write(self, name: str, rows: DataFrame) -> None:
        """Rows with board_id and snapshot_id; their partitions are replaced."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("board_id", "snapshot_id").parquet(f"{self.root}/{name}")

    def read(self, name: str, keys: DataFrame | None = None) -> DataFrame | None:
        """A table, of the (board_id, snapshot_id) in ``keys`` only; None if there is none yet."""
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return None
        rows = self.spark.read.option("basePath", path).parquet(path).withColumns({"board_id": F.col("board_id").cast("string"), "snapshot_id": F.col("snapshot_id").cast("string")})
        return rows if keys is None else rows.join(F.broadcast(keys.select("board_id", "snapshot_id")) if keys.isLocal() else keys.select("board_id", "snapshot_id"), ["board_id", "snapshot_id"], "left_semi")

    def headers(self) -> DataFrame:
        path = f"{self.root}/headers"
        return self.spark.read.schema(HEADER).parquet(path) if self._exists(path) else self.spark.createDataFrame([], HEADER)

    def append_headers(self, rows: DataFrame) -> None:
        """Add history entries; one equal to a board's newest entry is no new one."""
        with _LOCK:
            newest = self.headers().groupBy("board_id").agg(F.max_by("snapshot_id", "seq").alias("_last"), F.max("seq").alias("_seq"))
            new = rows.join(newest, "board_id", "left").where(~F.col("snapshot_id").eqNullSafe(F.col("_last")))
            names = [c.split()[0] for c in HEADER.split(", ")]
            new = new.withColumns({"seq": F.coalesce("_seq", F.lit(0)) + 1, "schema_version": F.lit(SCHEMA_VERSION)}).select(*names)
            new = materialise(new, "headers")  # read whole before its own table grows
            new.write.mode("append").parquet(f"{self.root}/headers")
            drop_table(new)

    def history(self, board_ids: list[str] | None = None) -> DataFrame:
        h = self.headers().where(F.col("snapshot_id").isNotNull()).withColumn("cache_key", F.col("snapshot_id"))
        h = h.where(F.col("schema_version") == SCHEMA_VERSION)
        return history.append(h if board_ids is None else h.where(F.col("board_id").isin(*board_ids)))

    def latest(self) -> DataFrame:
        """(board_id, snapshot_id) of each board's newest snapshot of this schema version."""
        h = self.headers().where(F.col("schema_version") == SCHEMA_VERSION)
        return h.groupBy("board_id").agg(F.max_by("snapshot_id", "seq").alias("snapshot_id"))

    def collect_garbage(self) -> list[tuple[str, str]]:
        """Drop snapshots that fell off their board's history and that nothing refers to."""
        with _LOCK:
            h = self.headers().withColumn("cache_key", F.col("snapshot_id"))
            kept = history.append(h)
            pointers = self.latest().select("board_id", F.col("snapshot_id").alias("cache_key"), F.lit(SCHEMA_VERSION).alias("schema_version"))
            gone = history.collectable(history.dropped(h), h.select("cache_key", "board_id").distinct(), kept, pointers, schema_version=SCHEMA_VERSION)
            out = [(r["board_id"], r["cache_key"]) for r in gone.collect()]
            for board, key in out:
                for name in TABLES:
                    drop_dir(self.spark, f"{self.root}/{name}/board_id={board}/snapshot_id={key}")
            return out


class BoardCache:
    """The boards used last, most recent last; the oldest goes when there are too many."""

    def __init__(self, size: int = 10):
        self.size, self.boards = size, OrderedDict()

    def put(self, board_id: str, value) -> None:
        self.boards.pop(board_id, None)
        self.boards[board_id] = value
        while len(self.boards) > self.size:
            self.boards.popitem(last=False)

    def get(self, board_id: str):
        if board_id not in self.boards:
            return None
        self.boards.move_to_end(board_id)
        return self.boards[board_id]
