"""Scalar expressions: literals, two-valued comparisons, logic, arithmetic and truth of any value."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")
ARITHMETIC = ("+", "-", "*", "/")


def constant(value: Any) -> Column:
    """A literal; whole numbers are INT where they fit, else BIGINT; fractions are DOUBLE, never decimal."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast(T.IntegerType() if -(2**31) <= value < 2**31 else T.LongType())
    if isinstance(value, float):
        return F.lit(value)
    raise TypeError(f"no literal of type {type(value).__name__}")


def _operand(value: Any) -> Column:
    return value if isinstance(value, Column) else constant(value)


def compare(left: Any, op: str, right: Any) -> Column:
    """``left op right`` as a filter condition: null where an operand is null, which no filter lets pass."""
    a, b = _operand(left), _operand(right)
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def is_true(condition: Column) -> Column:
    """The two-valued form of a condition, for projecting it: false where it is null."""
    return F.coalesce(condition, F.lit(False))


def both(*conditions: Column) -> Column:
    """All conditions hold. Null counts as false, so the result is never null."""
    out = F.lit(True)
    for c in conditions:
        out = out & is_true(c)
    return out


def either(*conditions: Column) -> Column:
    """At least one condition holds. Null counts as false, so the result is never null."""
    out = F.lit(False)
    for c in conditions:
        out = out | is_true(c)
    return out


def arithmetic(left: Any, op: str, right: Any, fraction: bool = False) -> Column:
    """``+ - * /`` on numbers: BIGINT unless ``fraction`` says an operand is DOUBLE, ``/`` always DOUBLE.

    Null in, null out. Overflow and division by zero (less than 1e-12 either way) are errors.
    """
    a, b = _operand(left), _operand(right)
    if op not in ARITHMETIC:
        raise ValueError(f"unknown operation {op!r}")
    if op == "/":
        a, b = a.cast("double"), b.cast("double")
        return F.when(F.abs(b) < 1e-12, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(a / b)
    kind = "double" if fraction else "bigint"
    a, b = a.cast(kind), b.cast(kind)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def passes(value: Column, kind: T.DataType) -> Column:
    """Truth of a value of any type as a filter condition, which can reach the reader: null for null, numbers are true unless zero, texts unless empty."""
    if isinstance(kind, T.BooleanType):
        return value
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (value > 1e-12) | (value < -1e-12)
    if isinstance(kind, T.NumericType):
        return value != 0
    if isinstance(kind, T.StringType):
        return value != ""
    raise TypeError(f"no truth value for {kind.simpleString()}")


def truthy(value: Column, kind: T.DataType) -> Column:
    """The two-valued form of ``passes``, for projecting it: null is false."""
    return is_true(passes(value, kind))
