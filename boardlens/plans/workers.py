"""Let Python workers import this library."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of an Arrow batch that goes to a Python worker, about (rows are many or few as they are short or long).
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ensure_importable(spark: SparkSession) -> None:
    """Put this library's place on the workers' module path (as on the driver).

    Where the session sets no bound on the bytes of an Arrow batch, it gets one,
    so that the workers' memory does not depend on how long the texts are that
    come in a row (a batch holds one row at least).
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
