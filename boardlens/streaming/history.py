"""Snapshot history as a stream: entries equal to their board's previous one are dropped as they arrive.

The batch rule (``operators.history.append``) over unbounded input: the state of
a board is the key of its last entry. Entries of a micro-batch are taken in
order of ``seq``; one whose ``seq`` is not above the last seen is late and
dropped, so replayed input changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "board_id string, seq long, cache_key string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, last = state.get if state.exists else (-1, None)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for s, k in zip(rows["seq"].tolist(), rows["cache_key"].tolist(), strict=True):
        if s > seq:
            if k != last:
                out.append((key[0], s, k))
            seq, last = s, k
    state.update((seq, last))
    yield pd.DataFrame(out, columns=["board_id", "seq", "cache_key"])


def dedupe_history(entries: DataFrame) -> DataFrame:
    """A stream of (board_id, seq, cache_key) without adjacent repeats (append mode)."""
    return entries.groupBy("board_id").applyInPandasWithState(_advance, SCHEMA, "seq long, cache_key string", "append", GroupStateTimeout.NoTimeout)
