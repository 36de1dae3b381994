"""Stored changes played to a streaming query: delivery after delivery, with a stop and a restart between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bounds(env: DataFrame, parts: int, clock: str = "ts_ms") -> list[int]:
    """The ends of ``parts`` equal spans of the clock; the last one is open."""
    low, high = env.agg(F.min(clock), F.max(clock)).first()
    if low is None:
        return []
    return [low + (high - low) * (i + 1) // parts for i in range(parts - 1)]


def play(env: DataFrame, folder: str, start: Callable[[], StreamingQuery], parts: int = 3, again: bool = True,
         clock: str = "ts_ms") -> None:
    """Write ``env`` as JSON deliveries by ``clock`` and run the query to the end of each.

    ``start`` begins the query anew: what it has read and kept is in its checkpoint.
    With ``again`` the second delivery brings the first one's changes once more.
    """
    ends = bounds(env, parts, clock)
    for i in range(len(ends) + 1):
        part = env
        if i > 0 and not (again and i == 1):
            part = part.where(F.col(clock) > ends[i - 1])
        if i < len(ends):
            part = part.where(F.col(clock) <= ends[i])
        part.write.json(f"{folder}/delivery-{i:03d}")
        query = start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
