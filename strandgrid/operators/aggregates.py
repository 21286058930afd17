"""Aggregates of one-key groups; all have a partial step before the shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgrid.plans.errors import QueryError
from strandgrid.plans.schema import DATES, NUMBERS


@dataclass(frozen=True)
class Aggregate:
    kind: str
    column: str | None = None


def key() -> Aggregate:
    return Aggregate("key")


def count() -> Aggregate:
    return Aggregate("count")


def count_distinct(column: str) -> Aggregate:
    return Aggregate("count_distinct", column)


def sum_(column: str) -> Aggregate:
    return Aggregate("sum", column)


def min_(column: str) -> Aggregate:
    return Aggregate("min", column)


def max_(column: str) -> Aggregate:
    return Aggregate("max", column)


def average(column: str) -> Aggregate:
    return Aggregate("average", column)


_MADE = {"count_distinct": F.count_distinct, "sum": F.sum, "min": F.min, "max": F.max, "average": F.avg}


def grouped(df: DataFrame, column: str, outputs: dict[str, Aggregate]) -> DataFrame:
    if not outputs:
        raise QueryError("a grouped select needs outputs")
    made = []
    for name, a in outputs.items():
        if not isinstance(a, Aggregate) or a.kind not in (*_MADE, "key", "count"):
            raise QueryError(f"{name}: not an aggregate")
        if a.kind == "key":
            continue
        if a.kind == "count":
            made.append(F.count(F.lit(1)).alias(name))
            continue
        if a.column not in df.columns:
            raise QueryError(f"{name}: no column {a.column}")
        kind = df.schema[a.column].dataType
        allowed = NUMBERS if a.kind in ("sum", "average") else (*NUMBERS, *DATES)
        if not isinstance(kind, allowed):
            raise QueryError(f"{name}: {a.kind} is not supported for {kind.simpleString()}")
        c = F.col(a.column)
        if a.kind == "sum" and isinstance(kind, T.IntegerType):
            c = c.cast("long")
        made.append(_MADE[a.kind](c).alias(name))
    keyed = df.groupBy(F.col(column).alias("_key"))
    out = keyed.agg(*made) if made else keyed.agg(F.lit(1).alias("_one"))
    return out.select([F.col("_key").alias(n) if a.kind == "key" else F.col(n) for n, a in outputs.items()])
