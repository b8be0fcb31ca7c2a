"""The most frequent values of a column by three-phase threshold search.

The rows are spread over nodes so that what one node holds can be counted there. Phase one sends each
node's leading values and adds up what was sent: the k-th of these partial sums is a lower bound of the
k-th true count. Phase two fetches from every node the values that reach the node's share of the bound:
a value that stays below its share on every node cannot reach the bound altogether. Phase three adds up
the fetched values exactly over all nodes. No node sends more than the values above its share, however
many distinct values there are.

Node counts are written once, so that the phases read them without counting again; what the phases send
is broadcast while it is small, and shuffled otherwise.

Rows are spread by a hash that keeps repeated rows together and nothing else, so that neither a frequent
value nor a large segment ends up on one node, and the nodes' shares are equal.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import partitions_for, write_out

#: slack for comparing sums of doubles that were added in different orders
_SLACK = 1 - 1e-9
#: bytes of leaders and bounds that are broadcast
BROADCAST_BYTES = 32 << 20


class NodeCounts:
    """Counts of values per node (node__, column keys, value__, count__), and totals of every column (total__)."""

    def __init__(self, local: DataFrame, totals: DataFrame, column: Sequence[str], nodes: int):
        self.local, self.totals, self.column, self.nodes = local, totals, list(column), nodes


def count_segments(entries: DataFrame, column: Sequence[str], segment: Sequence[str], value: str, frequency: str, size: str, nodes: int | None = None) -> NodeCounts:
    """Node counts from per-segment value lists: a value counts ``frequency * size`` in its segment.

    ``column`` names the counted column (for instance relation and column number) and ``segment`` the
    rest of a segment's key. A segment's size counts once however many values it lists; repeated rows
    count once; null frequencies and sizes add nothing; the null value is not a candidate, but its
    segment counts in the total. No rows give no counts; other columns are ignored, whatever their names.
    """
    nodes = nodes or partitions_for(entries)
    keys = [*column, *segment]
    placed = entries.select(
        F.pmod(F.xxhash64(*keys, value), F.lit(nodes)).alias("node__"), *keys, F.col(value).alias("value__"),
        (F.col(frequency) * F.col(size)).cast("double").alias("count__"),
    ).repartition(nodes, "node__")
    # repeated rows are on one node, and the node is part of the keys: no further shuffle for counting
    once = placed.groupBy("node__", *keys, "value__").agg(F.max("count__").alias("count__"))
    local = once.groupBy("node__", *column, "value__").agg(F.sum("count__").alias("count__")).where("value__ IS NOT NULL AND count__ > 0")
    sizes = entries.select(*keys, F.col(size).cast("long").alias("size__")).groupBy(*keys).agg(F.max("size__").alias("size__"))
    return NodeCounts(write_out(local), sizes.groupBy(*column).agg(F.sum("size__").alias("total__")).where("total__ > 0"), column, nodes)


def count_rows(df: DataFrame, value: str, column: Sequence[str] = (), nodes: int | None = None) -> NodeCounts:
    """Node counts from plain rows.

    Rows are counted before the shuffle. The node follows from the value and a salt (16 ways, by the
    whole row), which spreads a value that holds most of the rows. Null values are not candidates but
    count in the total.
    """
    nodes = nodes or partitions_for(df)
    salted = df.select(*column, F.col(value).alias("value__"), F.pmod(F.xxhash64(*df.columns), F.lit(16)).alias("salt__"))
    counted = salted.groupBy(*column, "value__", "salt__").agg(F.count(F.lit(1)).cast("double").alias("count__"))
    placed = counted.withColumn("node__", F.pmod(F.xxhash64("value__", "salt__"), F.lit(nodes)))
    local = write_out(placed.groupBy("node__", *column, "value__").agg(F.sum("count__").alias("count__")))
    return NodeCounts(local.where("value__ IS NOT NULL"), local.groupBy(*column).agg(F.sum("count__").alias("total__")), column, nodes)


def _same(names: Sequence[str], right: str) -> Column:
    same = F.lit(True)
    for i, name in enumerate(names):
        same = same & F.col(name).eqNullSafe(F.col(f"{right}{i}"))
    return same


def _renamed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*(F.col(n).alias(f"{prefix}{i}") for i, n in enumerate(names)), *(c for c in df.columns if c not in names))


def _sent(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if a count of its bytes allows it, to be shuffled otherwise."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    size = F.lit(8 * len(df.columns))
    for t in texts:
        size = size + F.coalesce(t, F.lit(0))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_BYTES else df


def _resolve(counts: NodeCounts, bound: DataFrame) -> DataFrame:
    """Exact counts of all values that can reach ``bound`` (column keys, bound__, total__)."""
    column = counts.column
    bounds = _sent(write_out(_renamed(bound, column, "b__")))
    above = counts.local.join(bounds, _same(column, "b__"), "inner").where(F.col("count__") >= F.col("bound__") / counts.nodes * _SLACK)
    fetched = _sent(write_out(_renamed(above.select(*column, F.col("value__").alias("fetched__")).distinct(), column, "f__")))
    # left_semi keeps the counts of every node, also where the value stays below the node's share
    exact = counts.local.join(fetched, (F.col("value__") == F.col("fetched__")) & _same(column, "f__"), "left_semi")
    exact = exact.groupBy(*column, "value__").agg(F.sum("count__").alias("count__"))
    return exact.join(bounds, _same(column, "b__"), "inner").select(*column, "value__", "count__", "bound__", "total__")


def _lower_bounds(counts: NodeCounts, k: int) -> DataFrame:
    """Phase one: column keys, bound__ and total__, from the ``k`` leading values of every node.

    The k-th of the summed leaders' counts cannot exceed the k-th true count.
    """
    column = counts.column
    best = Window.partitionBy("node__", *column).orderBy(F.col("count__").desc(), F.col("value__"))
    leaders = counts.local.withColumn("rank__", F.row_number().over(best)).where(F.col("rank__") <= k)
    partial = leaders.groupBy(*column, "value__").agg(F.sum("count__").alias("count__"))
    # at most k leaders per node and column reach this window
    ranked = partial.withColumn("rank__", F.row_number().over(_by_count(column))).where(F.col("rank__") <= k)
    lower = ranked.groupBy(*column).agg(F.when(F.max("rank__") == k, F.min("count__")).otherwise(0.0).alias("bound__"))
    totals = _renamed(counts.totals, column, "t__")
    return lower.join(totals, _same(column, "t__"), "inner").select(*column, "bound__", "total__")


def _by_count(column: Sequence[str]):
    return Window.partitionBy(*(column or [F.lit(1)])).orderBy(F.col("count__").desc(), F.col("value__"))


def values_above_share(counts: NodeCounts, share: float, value: str = "value") -> DataFrame:
    """Values that make up at least ``share`` of their column: column keys, value, n, share.

    Only as many values as such shares fit into what was counted can, so they are among as many leading
    ones, and the bound of phase one is raised to ``share`` of the column's total where it is lower. Null
    values are never returned; columns without any counted row give none. Values compare exactly as they
    stand, and may be of any length.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie above 0 and not above 1")
    least = F.lit(float(share)) * F.col("total__")
    # one row per column; counts may add up to more than the total where segments list what overlaps
    mass = counts.local.groupBy(*counts.column).agg(F.sum("count__").alias("mass__"))
    fit = mass.join(_renamed(counts.totals, counts.column, "t__"), _same(counts.column, "t__"), "inner").agg(F.max(F.col("mass__") / least).alias("k")).first()["k"]
    bound = _lower_bounds(counts, max(1, math.floor((fit or 0) / _SLACK))).withColumn("bound__", F.greatest("bound__", least))
    exact = _resolve(counts, bound)
    return exact.where(F.col("count__") / F.col("total__") >= F.lit(float(share))).select(
        *counts.column, F.col("value__").alias(value), F.col("count__").alias("n"), (F.col("count__") / F.col("total__")).alias("share")
    )


def top_k(counts: NodeCounts, k: int, value: str = "value") -> DataFrame:
    """The ``k`` most frequent values of each column: column keys, value, n, rank.

    Equal counts rank by ascending value. A column with fewer than ``k`` values returns them all; no
    rows in, no rows out. Counts are exact for what the nodes counted.
    """
    exact = _resolve(counts, _lower_bounds(counts, k))
    # counts within rounding of each other are one count, however their parts were added up
    exact = exact.withColumn("count__", F.round("count__", 6))
    final = exact.withColumn("rank", F.row_number().over(_by_count(counts.column))).where(F.col("rank") <= k)
    return final.select(*counts.column, F.col("value__").alias(value), F.col("count__").alias("n"), "rank")
