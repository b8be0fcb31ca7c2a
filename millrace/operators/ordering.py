"""Sorting, top-N and limits. Nulls come first ascending and last descending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: column and whether it ascends
Key = tuple[str, bool]


def _columns(keys: Sequence[Key]) -> list[Column]:
    return [F.col(name).asc_nulls_first() if up else F.col(name).desc_nulls_last() for name, up in keys]


def sort(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """All rows in order; keys are column names, never positions, and need not be shown afterwards."""
    return df.orderBy(*_columns(keys)) if keys else df


def top_n(df: DataFrame, keys: Sequence[Key], n: int) -> DataFrame:
    """The first ``n`` rows in order, without sorting the rest."""
    return sort(df, keys).limit(n)


def limit(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows; 0 gives none."""
    return df.limit(n)
