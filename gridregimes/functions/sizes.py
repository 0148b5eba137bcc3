"""Broadcasts behind a count of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Bytes that a side may have to be broadcast; a larger one is joined by a shuffle.
BROADCAST_LIMIT = 32 << 20


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT, kept: bool = False) -> DataFrame:
    """``df`` marked for broadcast if its counted rows, of ``row_bytes`` each, stay within the limit.

    It is written before it is counted, so that it is computed once; ``kept`` if it comes from a stored table anyway.
    """
    side = df if kept else stored(df, "side")
    return F.broadcast(side) if side.count() * row_bytes <= limit else side
