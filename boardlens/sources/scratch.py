"""Intermediate tables in a folder that the driver and every executor can reach.

The folder is the one that the session names in ``spark.checkpoint.dir``. Where
it is unset, a session on one machine gets a temporary folder, and one on a
cluster an error: no folder of one machine would do. What was made here and is
not dropped before is removed when the driver's Python ends, for results that
are read lazily may need it until then; :func:`clear` removes it at once.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, SparkSession] = {}


def base_dir(spark: SparkSession) -> str:
    """The shared folder as a qualified URI (made on first use if none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="boardlens-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        base = _OWN["dir"]
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return str(fs.makeQualified(path).toString()).rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name; nobody else writes there."""
    path = f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


@atexit.register
def clear() -> None:
    """Remove all folders made by :func:`new_dir` that are left; results that still read them fail after that."""
    for path, spark in list(_MADE.items()):
        with contextlib.suppress(Exception):  # the session, or the folder, may be gone
            drop_dir(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder made by :func:`new_dir` once nothing reads it any more."""
    _MADE.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a table made by :func:`materialise`."""
    files = df.inputFiles()
    if files:
        drop_dir(df.sparkSession, files[0].rsplit("/", 1)[0])
