"""The five column types, constraints, and literals that go into columns."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPARK = {"BOOLEAN": T.BooleanType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType()}
_RANGE = {"INT": 31, "BIGINT": 63}


class ConstraintError(ValueError):
    """A row that a table's rules do not allow."""


@dataclass(frozen=True)
class ColumnDef:
    """A column: BOOLEAN, INT, BIGINT, DOUBLE or VARCHAR(n), n in characters; null allowed unless said otherwise."""

    name: str
    kind: str
    nullable: bool = True

    def __post_init__(self) -> None:
        if self.kind not in ("BOOLEAN", "INT", "BIGINT", "DOUBLE") and self.length is None:
            raise ValueError(f"unknown type {self.kind}")

    @property
    def length(self) -> int | None:
        m = re.fullmatch(r"VARCHAR\((\d+)\)", self.kind)
        return int(m[1]) if m else None

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK.get(self.kind, T.StringType())

    def store(self, value: Any) -> Any:
        """``value`` as this column holds it; whole numbers widen, and narrow where they fit."""
        if value is None:
            if not self.nullable:
                raise ConstraintError(f"{self.name} must not be null")
            return None
        if self.kind == "BOOLEAN" and isinstance(value, bool):
            return value
        if self.kind in _RANGE and isinstance(value, int) and not isinstance(value, bool):
            if not -(1 << _RANGE[self.kind]) <= value < 1 << _RANGE[self.kind]:
                raise ConstraintError(f"{value} does not fit {self.name} {self.kind}")
            return value
        if self.kind == "DOUBLE" and isinstance(value, (int, float)) and not isinstance(value, bool):
            return float(value)
        if self.length is not None and isinstance(value, str):
            if len(value) > self.length:
                raise ConstraintError(f"{self.name} holds at most {self.length} characters")
            return value
        raise ConstraintError(f"{self.name} {self.kind} cannot hold {value!r}")

    def literal(self, value: Any) -> Column:
        return F.lit(self.store(value)).cast(self.spark_type)


@dataclass(frozen=True)
class TableDef:
    columns: tuple[ColumnDef, ...]
    #: index name -> (key columns, unique)
    indexes: dict[str, tuple[tuple[str, ...], bool]]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, True) for c in self.columns])

    @property
    def layout(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Columns rows are ordered by (the keys of the first index), and columns with Bloom filters (first keys of the others)."""
        keys = [k for k, _ in self.indexes.values()]
        return (keys[0] if keys else ()), tuple(dict.fromkeys(k[0] for k in keys[1:] if k[0] != keys[0][0]))

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError(f"no column {name}")

    def to_json(self) -> dict:
        return {"columns": [asdict(c) for c in self.columns], "indexes": {n: [list(k), u] for n, (k, u) in self.indexes.items()}}

    @staticmethod
    def from_json(x: dict) -> TableDef:
        return TableDef(tuple(ColumnDef(**c) for c in x["columns"]), {n: (tuple(k), u) for n, (k, u) in x["indexes"].items()})
