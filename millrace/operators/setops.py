"""Set operations on rows, as sets and as bags. Nulls are equal; columns go by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

_OPERATIONS = {
    "UNION ALL": lambda a, b: a.unionAll(b),
    "UNION": lambda a, b: a.union(b).distinct(),
    "INTERSECT ALL": lambda a, b: a.intersectAll(b),
    "INTERSECT": lambda a, b: a.intersect(b),
    "EXCEPT ALL": lambda a, b: a.exceptAll(b),
    "EXCEPT": lambda a, b: a.subtract(b),
}


def combine(left: DataFrame, op: str, right: DataFrame) -> DataFrame:
    """``left op right``; the number and the types of the columns have to be the same, names come from the left."""
    if op not in _OPERATIONS:
        raise ValueError(f"unknown set operation {op!r}; one of {', '.join(_OPERATIONS)}")
    a, b = ([f.dataType for f in d.schema.fields] for d in (left, right))
    if a != b:
        raise TypeError(f"columns of {op} differ: {', '.join(x.simpleString() for x in a)} and {', '.join(x.simpleString() for x in b)}")
    # positions, not names, decide; plain names keep later references clear of both inputs
    return _OPERATIONS[op](left, right.toDF(*left.columns))


def compound(first: DataFrame, rest: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """A chain of set operations from left to right; none binds more tightly than another."""
    out = first
    for op, df in rest:
        out = combine(out, op, df)
    return out
