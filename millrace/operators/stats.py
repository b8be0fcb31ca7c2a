"""Column statistics: what a planner keeps, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 10
MOST_COMMON = 8


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _counted(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """How often each value of each column occurs: ``column``, ``value`` (as text), ``n``, ``low``, ``high`` (as numbers)."""
    number = lambda n: F.col(n).cast("double") if _numeric(df, n) else F.lit(None).cast("double")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value"), number(n).alias("number")) for n in names)))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"), F.min("p.number").alias("low"), F.max("p.number").alias("high"))


def _described(counted: DataFrame) -> DataFrame:
    return counted.groupBy("column").agg(
        F.sum("n").alias("row_count"), F.count("value").alias("distinct_count"),
        (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("null_fraction"),
        F.min("low").alias("min_value"), F.max("high").alias("max_value"),
    )


def columns(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, distinct known values, fraction of nulls, least and greatest number.

    All columns are counted in a few shuffles over (column, value), not one pass each.
    """
    return _described(_counted(df, list(names or df.columns)))


def histogram(df: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Upper bounds of buckets that hold equally many values: ``bucket``, ``upper_bound``.

    Bounds are values of the column, within 1/10000 of the rows; no values, no rows. The summary that
    tasks exchange has a fixed size.
    """
    fractions = [(i + 1) / buckets for i in range(buckets)]
    bounds = df.agg(F.percentile_approx(F.col(name).cast("double"), fractions, F.lit(10_000)).alias("bounds"))
    return bounds.select(F.posexplode("bounds").alias("pos", "upper_bound")).select((F.col("pos") + 1).alias("bucket"), "upper_bound")


def most_common(df: DataFrame, name: str, n: int = MOST_COMMON) -> DataFrame:
    """The ``n`` most common known values with their fraction of all rows; ties by value."""
    counted = df.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.sum("n").alias("n")).scalar()
    top = counted.where("value IS NOT NULL").orderBy(F.col("n").desc(), F.col("value")).limit(n)
    return top.select("value", (F.col("n") / whole).alias("frequency"))


def pairs(df: DataFrame, names: Sequence[str], n: int = MOST_COMMON) -> tuple[DataFrame, DataFrame]:
    """For each pair of columns: number of distinct pairs of known values, and the most common pairs."""
    two = list(combinations(names, 2))
    struct = lambda a, b: F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.col(a).cast("string").alias("value_1"), F.col(b).cast("string").alias("value_2"))
    counted = df.select(F.explode(F.array(*(struct(a, b) for a, b in two))).alias("p")).select("p.*").where("value_1 IS NOT NULL AND value_2 IS NOT NULL")
    counted = counted.groupBy("column_1", "column_2", "value_1", "value_2").agg(F.count(F.lit(1)).alias("n"))
    joint = counted.groupBy("column_1", "column_2").agg(F.count(F.lit(1)).alias("distinct_pairs"))
    order = Window.partitionBy("column_1", "column_2").orderBy(F.col("n").desc(), "value_1", "value_2")
    common = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return joint, common


def analyze(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Column statistics with histogram and most common values as arrays, to be stored as one table.

    Two scans for any number of columns: one counts values, whose counts also tell the most common ones (by
    number, then text; no more than those leave a task), and one makes the histograms of all numeric columns.
    """
    names = list(names or df.columns)
    counted = _counted(df, names)
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    top = counted.where("value IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_COMMON)
    common = top.groupBy(F.col("column").alias("c")).agg(F.sort_array(F.collect_list(F.struct("rank", "n", "value"))).alias("top"))
    out = _described(counted).join(common, F.col("column") == F.col("c"), "left")
    shares = F.transform("top", lambda x: F.struct((x["n"] / F.col("row_count")).alias("frequency"), x["value"].alias("value")))
    out = out.select(*(c for c in out.columns if c not in ("c", "top")), F.coalesce(shares, F.array().cast("array<struct<frequency: double, value: string>>")).alias("most_common"))
    numbers = [n for n in names if _numeric(df, n)]
    if not numbers:
        return out.withColumn("bounds", F.lit(None).cast("array<double>"))
    fractions = [(i + 1) / BUCKETS for i in range(BUCKETS)]
    every = df.agg(*(F.percentile_approx(F.col(n).cast("double"), fractions, F.lit(10_000)).alias(f"b{i}") for i, n in enumerate(numbers)))
    bounds = every.select(F.explode(F.array(*(F.struct(F.lit(n).alias("c"), F.col(f"b{i}").alias("bounds")) for i, n in enumerate(numbers)))).alias("x")).select("x.*")
    return out.join(bounds, F.col("column") == F.col("c"), "left").drop("c")
