"""Token counts of documents and CRCs of their fixed-size pieces, ids not kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from boardlens.llm import bpe
from boardlens.llm.shared import lean, numbered


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, *, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``doc_tokens`` (end id included) and ``piece_crcs``.

    ``piece_crcs`` holds the unsigned CRC32 of each run of ``size`` ids (the last
    may be shorter) as little-endian unsigned 32-bit integers. A null or empty
    text has one id, the end; rows that repeat are counted each; an empty table
    gives an empty result; columns may have any names, those named as the results
    are replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "doc_tokens", "piece_crcs")]
    rows = numbered(docs, keep, F.col(f"`{text}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        coder = bpe.load(tokenizer)
        for batch in batches:
            for a, b, counts, ids in coder.encode(batch.column(len(keep))):
                counts, ids = bpe.with_end(counts, ids, end_id)
                ids, ends = ids.astype("<u4"), np.cumsum(counts).tolist()
                crcs = [[zlib.crc32(ids[i : min(i + size, e)]) for i in range(s, e, size)] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                    names=[*keep, "doc_tokens", "piece_crcs"],
                )

    out = [StructField("doc_tokens", LongType()), StructField("piece_crcs", ArrayType(LongType()))]
    return rows.mapInArrow(lean(run, tables=True), StructType([*(docs.schema[c] for c in keep), *out]))
