"""Inner joins. Null keys match nothing, whatever the strategy.

Without a strategy the optimizer chooses by size, and adaptive execution splits skewed partitions. The
strategies ask for one algorithm; broadcasting is only ever done below a size limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import estimated_bytes

#: bytes up to which a side may be broadcast, by the optimizer's estimate
BROADCAST_BYTES = 64 << 20
_HINTS = {"hash": "shuffle_hash", "merge": "merge"}


def equi_join(left: DataFrame, right: DataFrame, condition: Column, strategy: str | None = None) -> DataFrame:
    """Inner join; ``strategy`` is None, ``hash``, ``merge`` or ``broadcast`` (the right side).

    A right side that may be larger than ``BROADCAST_BYTES`` is joined by shuffling instead.
    """
    if strategy == "broadcast":
        small = estimated_bytes(right) <= BROADCAST_BYTES
        return left.join(F.broadcast(right) if small else right, condition, "inner")
    if strategy is not None:
        right = right.hint(_HINTS[strategy])
    return left.join(right, condition, "inner")


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Inner join on any condition. Without an equality in it every pair of rows is compared."""
    return left.join(right, condition, "inner")


def lookup_join(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str) -> DataFrame:
    """Join of few outer rows with their matches: the outer side is broadcast while it is small."""
    return equi_join(inner, outer, F.col(inner_key) == F.col(outer_key), "broadcast").select(*outer.columns, *inner.columns)


def many_to_one_join(many: DataFrame, one: DataFrame, many_key: str, one_key: str) -> DataFrame:
    """Join in which few inner rows are met again and again.

    Inner rows that are never met drop out in the join itself; keeping the matches of a key at hand is what a
    hash join does. The inner side is the one that is hashed, or broadcast if it is small.
    """
    return equi_join(many, one, F.col(many_key) == F.col(one_key), "broadcast" if estimated_bytes(one) <= BROADCAST_BYTES else None)


def join_all(tables: Sequence[DataFrame], conditions: Sequence[Column]) -> DataFrame:
    """Left-deep join of any number of tables; ``conditions[i]`` connects table i + 1 to those before it."""
    if len(conditions) != len(tables) - 1:
        raise ValueError("each table but the first needs a condition that connects it")
    out = tables[0]
    for t, condition in zip(tables[1:], conditions):
        out = out.join(t, condition, "inner")
    return out
