"""Snapshot history: adjacent de-duplication, cap, look-back, and collection of unreferenced snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 20


def append(history: DataFrame, *, cap: int = CAP) -> DataFrame:
    """Entries (board_id, seq, cache_key, ...) less those equal to the one before, the newest ``cap`` of each board.

    What fell off the cap is told by :func:`dropped`.
    """
    return numbered(history).where(F.col("age") <= cap).drop("age")


def numbered(history: DataFrame) -> DataFrame:
    """De-duplicated entries with ``age`` (1 is the newest)."""
    board = Window.partitionBy("board_id")
    before = F.lag("cache_key").over(board.orderBy("seq"))
    first = F.lag("seq").over(board.orderBy("seq")).isNull()
    new = history.withColumn("_new", first | ~F.col("cache_key").eqNullSafe(before)).where("_new").drop("_new")
    return new.withColumn("age", F.row_number().over(board.orderBy(F.desc("seq"))))


def dropped(history: DataFrame, *, cap: int = CAP) -> DataFrame:
    """(board_id, cache_key) that fell off the cap and are in none of the kept entries."""
    n = numbered(history)
    old = n.where(F.col("age") > cap).select("board_id", "cache_key").distinct()
    return old.join(n.where(F.col("age") <= cap).select("board_id", "cache_key"), ["board_id", "cache_key"], "left_anti")


def nth_back(history: DataFrame, steps: int) -> DataFrame:
    """The entry ``steps`` before the newest of each board that has one."""
    return numbered(history).where(F.col("age") == steps + 1).drop("age")


def collectable(candidates: DataFrame, snapshots: DataFrame, kept: DataFrame, pointers: DataFrame, *, schema_version: int = 3) -> DataFrame:
    """Candidate (board_id, cache_key) whose snapshot may go: a safe name, owned by this board, not referenced anywhere.

    ``snapshots``: (cache_key, board_id) owners; ``kept``: history entries of all
    boards; ``pointers``: (board_id, cache_key, schema_version). A reference row
    whose key is null is malformed: then nothing may go.
    """
    broken = kept.select("cache_key").union(pointers.select("cache_key")).where(F.col("cache_key").isNull()).limit(1).count()
    safe = candidates.where(F.col("cache_key").rlike("^[a-z0-9]{1,64}$"))
    own = safe.join(snapshots.select("cache_key", F.col("board_id").alias("owner")), "cache_key", "left").where(F.col("owner").isNull() | (F.col("owner") == F.col("board_id")))
    held = kept.select("cache_key").union(pointers.where(F.col("schema_version") == schema_version).select("cache_key")).distinct()
    return own.join(held, "cache_key", "left_anti").where(F.lit(not broken)).select("board_id", "cache_key").distinct()
