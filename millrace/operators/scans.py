"""Scans and lookups.

There are no index structures: a lookup is a filter that reaches the Parquet reader, which skips row
groups by their minimum and maximum. ``cluster_by`` lays a table out so that this works, in place of
building an index; ``lookup`` and friends take the place of scanning one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import compare, constant
from millrace.session import keep, partitions_for


def scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All rows; only ``columns`` are read when given."""
    return df if columns is None else df.select(*columns)


def ordered_scan(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows in ascending key order (nulls first)."""
    return df.orderBy(*(F.col(k).asc() for k in keys))


def lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    """Rows whose key equals ``value``, duplicates included; null finds nothing."""
    return df.where(compare(F.col(key), "=", constant(value)))


def _within(key: str, low: Any, high: Any, low_inclusive: bool, high_inclusive: bool) -> Column:
    out = F.lit(True)
    if low is not None:
        out = compare(F.col(key), ">=" if low_inclusive else ">", constant(low))
    if high is not None:
        upper = compare(F.col(key), "<=" if high_inclusive else "<", constant(high))
        out = upper if low is None else out & upper
    return out


def range_lookup(df: DataFrame, key: str, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
    """Rows whose key lies between the bounds; a bound of None is open. Null keys are never within bounds."""
    return df.where(_within(key, low, high, low_inclusive, high_inclusive) & F.col(key).isNotNull())


def prefix_lookup(df: DataFrame, equal: Mapping[str, Any], key: str | None = None, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
    """Equality on leading key columns and a range on the next one."""
    out = df
    for name, value in equal.items():
        out = lookup(out, name, value)
    return out if key is None else range_lookup(out, key, low, high, low_inclusive, high_inclusive)


def rows_where_all(df: DataFrame, *conditions: Column) -> DataFrame:
    """Intersection of lookups: one filter, evaluated in one pass over the rows."""
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return df.where(out)


def rows_where_any(df: DataFrame, *conditions: Column) -> DataFrame:
    """Union of lookups without duplicates: one filter, evaluated in one pass over the rows."""
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return df.where(out)


def covering(df: DataFrame, keys: Sequence[str], condition: Column | None = None) -> DataFrame:
    """An answer from key columns alone; nothing else is read."""
    return (df if condition is None else df.where(condition)).select(*keys)


def key_list(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """The keys of matching rows, in place of row addresses."""
    return df.where(condition).select(key)


def fetch(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows that a list of keys names; a key that is listed twice gives its rows once."""
    return df.join(keys.select(F.col(key).alias("fetch__")), F.col(key) == F.col("fetch__"), "left_semi")


def fetch_after_limit(df: DataFrame, key: str, condition: Column, n: int) -> DataFrame:
    """The first ``n`` matching rows by key: the limit is taken on keys, the rows are fetched afterwards."""
    return fetch(df, key_list(df, key, condition).orderBy(key).limit(n), key)


def materialize(df: DataFrame) -> DataFrame:
    """Keep the rows for reading them several times, in memory as far as they fit and else on disk; see ``session.Scope`` for how long."""
    return keep(df)


def cluster_by(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows laid out for lookups by ``keys``: range-partitioned and sorted, to be written as Parquet."""
    return df.repartitionByRange(partitions or partitions_for(df), *keys).sortWithinPartitions(*keys)
