"""From clauses to a filtered DataFrame: maximal runs of linked clauses are ORed, runs are ANDed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgrid.plans.errors import QueryError


@dataclass(frozen=True, eq=False)
class Clause:
    """Either a condition on a row, or membership of the ``on`` values in the distinct rows of ``members``."""

    condition: Column | None = None
    members: DataFrame | None = None
    on: tuple[Column, ...] = ()
    null_safe: bool = False
    distances: DataFrame | None = None

    def joined_on(self, members: DataFrame) -> Column:
        pairs = [(a.eqNullSafe(F.col(f"_m.{b}")) if self.null_safe else a == F.col(f"_m.{b}")) for a, b in zip(self.on, members.columns, strict=False)]
        return reduce(lambda x, y: x & y, pairs)


def runs(count: int, links: frozenset[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for i in range(count):
        if i and i - 1 in links:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def filtered(source: DataFrame, clauses: tuple[Clause, ...], links: frozenset[int]) -> DataFrame:
    """The rows of ``source`` that pass.  Conditions come first, so they reach the scan; memberships are semi joins, or
    left joins with a marker where they are ORed with other clauses."""
    if links and max(links) >= len(clauses) - 1:
        raise QueryError("or_ needs a clause after it")
    df, columns = source, source.columns
    groups = [[clauses[i] for i in run] for run in runs(len(clauses), links)]
    for run in groups:
        if all(c.members is None for c in run):
            df = df.where(reduce(lambda x, y: x | y, (c.condition for c in run)))
    for run in groups:
        if len(run) == 1 and run[0].members is not None:
            df = df.join(run[0].members.alias("_m"), run[0].joined_on(run[0].members), "left_semi")
    mark = 0
    for run in groups:
        if len(run) == 1 or all(c.members is None for c in run):
            continue
        tests: list[Column] = []
        for c in run:
            if c.members is None:
                tests.append(c.condition)
                continue
            name = f"_mark{mark}"
            mark += 1
            df = df.join(c.members.withColumn(name, F.lit(True)).alias("_m"), c.joined_on(c.members), "left").select(*[F.col(x) for x in df.columns], F.col(f"_m.{name}").alias(name))
            tests.append(F.col(name).isNotNull())
        df = df.where(reduce(lambda x, y: x | y, tests)).select(columns)
    return df
