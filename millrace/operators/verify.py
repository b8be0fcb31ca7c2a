"""Checks that tables hold what they should."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that do not occur equally often in both, with how often more in ``a`` (negative: in ``b``).

    Both tables are counted before anything is compared, in one shuffle; nulls are equal.
    """
    names = a.columns
    sides = a.select(*names).withColumn("side__", F.lit(1)).unionByName(b.select(*names).withColumn("side__", F.lit(-1)))
    return sides.groupBy(*names).agg(F.sum("side__").alias("surplus")).where("surplus <> 0")


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows equally often."""
    return [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema] and differences(a, b).isEmpty()


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often; keys that hold a null are left out."""
    known = df.select(*keys)
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(df: DataFrame, not_null: Sequence[str] = (), max_length: Mapping[str, int] | None = None) -> DataFrame:
    """One row: how many rows break each rule."""
    rules = [F.count_if(F.col(c).isNull()).alias(f"{c} is null") for c in not_null]
    rules += [F.count_if(F.coalesce(F.length(c), F.lit(0)) > n).alias(f"{c} is longer than {n}") for c, n in (max_length or {}).items()]
    return df.agg(*rules) if rules else df.agg(F.lit(0).alias("no rules"))
