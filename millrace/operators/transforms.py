"""Filter and projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import passes


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` is true, whatever its type; null is not true."""
    kind = df.select(condition.alias("c")).schema["c"].dataType
    return df.where(passes(condition, kind))


def project(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """The named columns, or new ones by name."""
    if isinstance(columns, Mapping):
        return df.select(*(c.alias(n) for n, c in columns.items()))
    return df.select(*columns)


def all_columns_of(left: DataFrame, right: DataFrame, joined: DataFrame) -> DataFrame:
    """All columns of a join, left ones first; a right column whose name is taken gets the suffix ``_2``, ``_3`` ..."""
    taken: set[str] = set()
    names = []
    for name in [*left.columns, *right.columns]:
        new, k = name, 1
        while new.lower() in taken:
            k += 1
            new = f"{name}_{k}"
        taken.add(new.lower())
        names.append(new)
    return joined.toDF(*names)
