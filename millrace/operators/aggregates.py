"""COUNT, SUM, MIN, MAX, grouping and removal of duplicates.

Aggregation combines on the map side before it shuffles. A null group value is a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: output name -> (count, sum, min or max; column or "*")
Spec = Mapping[str, tuple[str, "str | Column"]]


def _column(df: DataFrame, kind: str, arg: str | Column) -> Column:
    if isinstance(arg, str) and arg == "*":
        if kind != "count":
            raise ValueError(f"{kind}(*) has no meaning")
        return F.count(F.lit(1))
    arg = F.col(arg) if isinstance(arg, str) else arg
    if kind == "sum":
        of = df.select(arg.alias("x")).schema["x"].dataType
        if not isinstance(of, T.NumericType):
            raise TypeError(f"no sum of {of.simpleString()}")
        return F.sum(arg)
    return {"count": F.count, "min": F.min, "max": F.max}[kind](arg)


def aggregate(df: DataFrame, keys: Sequence[str], spec: Spec) -> DataFrame:
    """One row per group, or one row altogether without keys, even for no rows: COUNT 0, others null.

    COUNT of a column, SUM, MIN and MAX skip nulls; SUM of whole numbers is BIGINT and overflow an error.
    """
    columns = [_column(df, kind, arg).alias(name) for name, (kind, arg) in spec.items()]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def groups(df: DataFrame, keys: Sequence[str], show: Sequence[str] | None = None, merge_equal: bool = False) -> DataFrame:
    """GROUP BY without aggregates: one row per group, showing ``show`` (of the keys).

    With ``merge_equal`` rows that look the same after projection are one, so that fewer columns than
    keys give fewer rows than groups.
    """
    out = df.select(*keys).distinct().select(*(show or keys))
    return out.distinct() if merge_equal else out


def distinct(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without duplicates; nulls are equal."""
    return (df if columns is None else df.select(*columns)).distinct()
