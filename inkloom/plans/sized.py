"""Joins that broadcast a side only after its size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow key column (at most some 100 bytes each) that are broadcast.
BROADCAST_ROWS = 200_000


def keep_keys(df: DataFrame, keys: DataFrame, on: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of df whose key is among keys (distinct, already written).

    Up to so many keys are broadcast, so that the wide side isn't shuffled;
    beyond, both sides are shuffled on the key and merged, which may spill."""
    few = keys.limit(rows + 1).count() <= rows
    return df.join(F.broadcast(keys) if few else keys.hint("merge"), on, "left_semi")
