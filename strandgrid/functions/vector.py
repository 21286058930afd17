"""Distances of vectors, in the engine's own expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandgrid.plans.errors import QueryError


def squared_distance(vector: Column, to: Sequence[float], name: str = "vector") -> Column:
    """Squared Euclidean distance: components subtracted as floats, squares summed as doubles, the sum rounded to a float
    (and given as a double); NULL for NULL.

    A vector of another dimension fails the query.
    """
    query = F.array(*[F.lit(float(x)).cast("float") for x in to])
    part = F.zip_with(vector, query, lambda a, b: (a - b).cast("double") * (a - b).cast("double"))
    total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x).cast("float").cast("double")
    wrong = F.size(vector) != F.lit(len(to))
    return F.when(vector.isNull(), F.lit(None).cast("double")).when(wrong, F.raise_error(F.lit(f"column {name}: vector dimensionality changed")).cast("double")).otherwise(total)


def check_query(to: Sequence[float] | None, k: int) -> None:
    if to is None or len(to) == 0:
        raise QueryError("the query vector must not be empty")
    if k <= 0:
        raise QueryError("the number of neighbours must be positive")
