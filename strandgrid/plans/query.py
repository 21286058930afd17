"""The query builder: clauses are collected, then compiled to one lazy DataFrame.

Clauses are ANDed; ``or_()`` joins the clause before it to the one after it.  A builder is immutable: every call returns
a new one, so a query can be reused and extended.  Terminal calls return DataFrames and run nothing themselves.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgrid.functions import signatures, text, vector
from strandgrid.operators import aggregates, ordering
from strandgrid.operators.neighbours import nearest
from strandgrid.plans import expr
from strandgrid.plans.compile import Clause, filtered
from strandgrid.plans.errors import QueryError
from strandgrid.plans.schema import DATES, NUMBERS, STEP, TableSchema, is_vector

BOUNDARIES = ("both_inclusive", "from_inclusive", "to_inclusive", "both_exclusive")
#: Values up to which membership is a literal list; more become a semi join.
LITERALS = 2000
#: Most bytes that a result may have when it is fetched, unless another limit is given.
MOST_BYTES = 314_572_800
#: The column of a stored table that holds the packed signatures of its signature index.
SIGNATURE = "_signature"


@dataclass(frozen=True)
class Query:
    """A table and the clauses, order and limits put on it so far.

    ``source``: the rows.  ``schema``: what is known of the table.  ``shard``: the column with the shard of a row, if
    the table is sharded; then the row's identity is (shard, key), neighbours are searched for in each shard, and there
    is no skip.
    """

    source: DataFrame
    schema: TableSchema
    shard: str | None = None
    reduced: bool = False  # a partition's view: no grouping, signatures or index definitions in the original API
    clauses: tuple[Clause, ...] = ()
    links: frozenset[int] = frozenset()  # clause i is ORed with clause i + 1
    order: tuple[str, bool] | None = None
    skipped: int | None = None
    taken: int | None = None
    group: str | None = None
    signature_index: tuple[str, int] | None = None
    group_indexes: frozenset[tuple[str, str]] | None = None  # (group, value) pairs that may be grouped; None: all

    # filters

    @property
    def identity(self) -> list[str]:
        return [self.shard, self.schema.key] if self.shard else [self.schema.key]

    def _kind(self, column: str) -> T.DataType:
        return expr.kind_of(self.source.schema, column)

    def _with(self, clause: Clause) -> "Query":
        return replace(self, clauses=(*self.clauses, clause))

    def _where(self, condition: Column) -> "Query":
        return self._with(Clause(condition=condition))

    def where(self, node: expr.Node) -> "Query":
        """Rows for which a tree of comparisons holds."""
        return self._where(expr.predicate(node, self.source.schema))

    def between(self, column: str, low: Any, high: Any, boundaries: str = "both_inclusive") -> "Query":
        kind = self._kind(column)
        if low is None or high is None:
            raise QueryError(f"column {column}: the bounds of between can't be None")
        if boundaries not in BOUNDARIES:
            raise QueryError(f"boundaries must be one of {', '.join(BOUNDARIES)}")
        if not isinstance(kind, (*NUMBERS, *DATES)):
            raise QueryError(f"column {column}: between is not supported for {kind.simpleString()}")
        c, a, b = F.col(column), expr.literal(low, kind, column), expr.literal(high, kind, column)
        left = c >= a if boundaries in ("both_inclusive", "from_inclusive") else c > a
        right = c <= b if boundaries in ("both_inclusive", "to_inclusive") else c < b
        return self._where(left & right)

    def intersect(self, column: str, values: Iterable[Any] | DataFrame) -> "Query":
        """Rows whose column is in a set; None in the set stands for NULL; strings in any case.

        A DataFrame of one column, or more than LITERALS values, becomes a join; Spark picks its kind by size.
        """
        kind = self._kind(column)
        if isinstance(kind, T.BinaryType) or is_vector(kind):
            raise QueryError(f"column {column}: intersect is not supported for {kind.simpleString()}")
        string = isinstance(kind, T.StringType)
        key = (lambda c: F.lower(F.nullif(c, F.lit("")))) if string else (lambda c: c)
        if isinstance(values, DataFrame):
            own = values.select(key(F.col(values.columns[0])).alias("_value")).distinct()
            return self._with(Clause(members=own, on=(key(F.col(column)),), null_safe=True))
        values = set(values)
        null = None in values or string and "" in values
        if null and column in self.schema.required:
            raise QueryError(f"column {column} can't be NULL, so None can't be in its set")
        rest = [v for v in values if v is not None and v != ""]
        checked = [expr.literal(v, kind, column) for v in rest[:LITERALS]] if len(rest) <= LITERALS else []
        if len(rest) > LITERALS:
            for v in rest:
                expr.literal(v, kind, column)
            spark = self.source.sparkSession
            own = spark.createDataFrame([(v.lower() if string else v,) for v in rest] + [(None,)] * null, T.StructType([T.StructField("_value", kind)])).distinct()
            return self._with(Clause(members=own, on=(key(F.col(column)),), null_safe=True))
        if string:
            condition = F.lower(F.col(column)).isin(sorted({v.lower() for v in rest})) if rest else F.lit(False)
        else:
            condition = F.col(column).isin(checked) if rest else F.lit(False)
        if null:
            condition = condition | expr.is_null(column, kind)
        return self._where(F.coalesce(condition, F.lit(False)))

    def intersect_ids(self, ids: DataFrame) -> "Query":
        """Rows whose identity (shard and key, or key) is in ``ids``."""
        own = ids.select([F.col(c).alias(f"_id{k}") for k, c in enumerate(self.identity)]).distinct()
        return self._with(Clause(members=own, on=tuple(F.col(c) for c in self.identity)))

    # searches

    def _steps(self, start: int | None, steps: int | None) -> Column:
        if (start is None) != (steps is None):
            raise QueryError("give both start_step and steps, or neither")
        if start is None:
            return F.lit(True)
        key = F.col(self.schema.key)
        return (key >= STEP * start) & (key < STEP * (start + steps))

    def search(self, column: str, query: str, start_step: int | None = None, steps: int | None = None) -> "Query":
        """Rows whose text has every word of the query as a token; ``start_step`` and ``steps`` limit the keys."""
        mode = self.schema.search_mode(column)
        limit = self._steps(start_step, steps)
        self._kind(column)
        return self if query == "" else self._where(text.has_all_words(F.col(column), query, mode) & limit)

    def search_partial(self, column: str, query: str, start_step: int | None = None, steps: int | None = None) -> "Query":
        """As search, but every word of the query must begin a token."""
        mode = self.schema.search_mode(column)
        limit = self._steps(start_step, steps)
        self._kind(column)
        return self if query == "" else self._where(text.has_all_prefixes(F.col(column), query, mode) & limit)

    def search_time_limited(self, column: str, query: str, milliseconds: int, steps_at_once: int = 5, clock: Callable[[], dt.datetime] = dt.datetime.now) -> tuple["Query", int]:
        """Search a few steps of keys at a time until the time is over.  Returns the query limited to the searched steps,
        and the percentage of steps searched; how far it comes depends on the machine.

        It begins with ``steps_at_once`` steps and doubles their number as long as that fits the time left, so a large
        table takes few jobs.  Files sorted by key are only read where the steps are.
        """
        last = self.last_step().first()[0]
        total = 0 if last is None else int(last) + 1
        limit = dt.timedelta(milliseconds=milliseconds)
        begun = clock()
        done, now = 0, steps_at_once
        while done < total and (since := clock()) - begun < limit:
            # the work that is timed: the matches of these steps
            self.search(column, query, done, min(now, total - done)).count().first()
            done = min(total, done + now)
            if 2 * (clock() - since) < limit - (clock() - begun):
                now *= 2
        return self.search(column, query, 0, done), 100 if total == 0 else 100 * done // total

    def search_bitfunnel(self, column: str, query: str, stop_count: int | None = None, batch: int = 1024) -> "Query":
        """Rows whose signature holds the query's bits: every match, and some other rows.

        The column needs a signature index.  ``stop_count``: no further batch of ``batch`` keys is taken once the
        batches before it hold so many rows.
        """
        if self.reduced:
            raise QueryError("search_bitfunnel is not available on a partition")
        if self.signature_index is None or self.signature_index[0] != column:
            raise QueryError(f"column {column} needs a signature index")
        if query == "":
            return self
        bits = self.signature_index[1]
        held = F.col(SIGNATURE) if SIGNATURE in self.source.columns else signatures.signature(F.col(column), bits, self.schema.search_mode(column))
        found = signatures.may_match(held, query, bits)
        if stop_count is None:
            return self._where(found)
        return self.intersect_ids(ordering.until_count(self.source.where(found).select(*self.identity), self.schema.key, batch, stop_count))

    def search_neighbours(self, column: str, to: Sequence[float], k: int) -> "Query":
        """The k nearest rows of the whole table (of each shard, if sharded), ANDed with the other clauses."""
        vector.check_query(to, k)
        if not self.schema.is_searchable_vector(column) or not is_vector(self._kind(column)):
            raise QueryError(f"column {column} is not a searchable vector: name it ...L2, or register it")
        found = nearest(self.source, column, to, k, self.schema.key, self.shard)
        return self._with(Clause(members=found.select([F.col(c).alias(f"_id{n}") for n, c in enumerate(self.identity)]), on=tuple(F.col(c) for c in self.identity), distances=found))

    def or_(self) -> "Query":
        """Join the clause before with the clause after."""
        if not self.clauses:
            raise QueryError("or_ needs a clause before it")
        return replace(self, links=self.links | {len(self.clauses) - 1})

    # order and limits

    def _ordered(self, column: str, up: bool) -> "Query":
        kind = self._kind(column)
        if isinstance(kind, T.BinaryType) or is_vector(kind):
            raise QueryError(f"column {column}: can't order by {kind.simpleString()}")
        if self.order is not None:
            raise QueryError("a query has one order")
        return replace(self, order=(column, up))

    def order_by(self, column: str) -> "Query":
        return self._ordered(column, True)

    def order_by_descending(self, column: str) -> "Query":
        return self._ordered(column, False)

    def skip(self, n: int) -> "Query":
        if self.order is None:
            raise QueryError("skip needs an order")
        if self.shard:
            raise QueryError("skip is not available on a sharded table")
        if n < 0:
            raise QueryError("skip needs a number that isn't negative")
        return replace(self, skipped=n)

    def take(self, n: int) -> "Query":
        if self.order is None:
            raise QueryError("take needs an order")
        if n < 0:
            raise QueryError("take needs a number that isn't negative")
        return replace(self, taken=n)

    # terminal calls

    def matches(self) -> DataFrame:
        """The rows that the clauses leave, without order and limits."""
        return filtered(self.source, self.clauses, self.links)

    def rows(self) -> DataFrame:
        df = self.matches()
        return df if self.order is None else ordering.ordered(df, *self.order, self.identity, self.skipped, self.taken)

    def select_entity(self) -> DataFrame:
        return self.rows().select([c for c in self.source.columns if c != SIGNATURE])

    def select(self, *columns: str, **renamed: str) -> DataFrame:
        """Bare columns, under their own or new names; expressions are rejected."""
        pairs = [*((c, c) for c in columns), *((c, name) for name, c in renamed.items())]
        if not pairs:
            raise QueryError("select needs columns; use select_entity for all")
        for c, _ in pairs:
            if not isinstance(c, str):
                raise QueryError("select takes column names, no expressions")
            self._kind(c)
        if self.shard and self.order and self.order[0] not in [c for c, _ in pairs]:
            raise QueryError("on a sharded table the column of the order must be selected")
        return self.rows().select([F.col(c).alias(name) for c, name in pairs])

    def in_batches(self, *columns: str, size: int = 3000) -> Iterator[list]:
        """The result in lists of ``size`` rows, fetched partition by partition; not one snapshot of order."""
        df = self.select(*columns) if columns else self.select_entity()
        held: list = []
        for row in df.toLocalIterator():
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def fetched(self, *columns: str, most_bytes: int = MOST_BYTES) -> list:
        """The rows on the driver; refused if their values take more than ``most_bytes``."""
        df = self.select(*columns) if columns else self.select_entity()

        def width(f: T.StructField) -> Column:
            if isinstance(f.dataType, (T.StringType, T.BinaryType)):
                return F.coalesce(F.octet_length(f.name), F.lit(0))
            if isinstance(f.dataType, T.ArrayType):
                return F.when(F.col(f.name).isNotNull(), 4 * F.size(f.name)).otherwise(0)
            return F.lit({"int": 4, "float": 4}.get(f.dataType.simpleString(), 16 if isinstance(f.dataType, T.DecimalType) else 8))

        size = df.agg(F.sum(sum((width(f).cast("long") for f in df.schema), F.lit(0)))).first()[0] or 0
        if size > most_bytes:
            raise QueryError(f"the result has {size} bytes; at most {most_bytes} are allowed")
        return df.collect()

    def get_ids(self) -> DataFrame:
        return self.matches().select(*self.identity)

    def all_ids(self) -> DataFrame:
        """One row: n_ids, and whether those are all rows of the table."""
        total = self.source.agg(F.count(F.lit(1)).alias("_total"))
        return self.matches().agg(F.count(F.lit(1)).alias("n_ids")).crossJoin(total).select("n_ids", (F.col("n_ids") == F.col("_total")).alias("all_ids"))  # one row each

    def count(self) -> DataFrame:
        return self.matches().agg(F.count(F.lit(1)).alias("count"))

    def last_step(self) -> DataFrame:
        """The largest key of the table divided by the step; NULL for an empty table."""
        return self.source.agg(F.expr(f"cast(max(`{self.schema.key}`) div {STEP} as bigint)").alias("last_step"))

    def statistics(self) -> DataFrame:
        """One row: total (matches before skip and take) and searched_percentile."""
        return self.matches().agg(F.count(F.lit(1)).alias("total")).withColumn("searched_percentile", F.lit(100))

    def distances(self) -> DataFrame:
        """Identity and squared distance of every neighbour that the query's neighbour clauses found."""
        found = [c.distances for c in self.clauses if c.distances is not None]
        if not found:
            raise QueryError("the query has no neighbour search")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.select(*self.identity, "distance")

    # groups

    def group_by(self, column: str) -> "Grouped":
        if self.reduced:
            raise QueryError("group_by is not available on a partition")
        if not isinstance(self._kind(column), T.IntegerType):
            raise QueryError(f"column {column}: groups need an int column")
        return Grouped(self, column)


@dataclass(frozen=True)
class Grouped:
    query: Query
    column: str

    def select(self, **outputs: aggregates.Aggregate) -> DataFrame:
        """One row for each group; each output is a key(), count(), sum_(c), ... of strandgrid.operators.aggregates."""
        if self.query.shard and not any(a.kind == "key" for a in outputs.values()):
            raise QueryError("groups of a sharded table need their key")
        allowed = self.query.group_indexes
        for a in outputs.values():
            needs = isinstance(a, aggregates.Aggregate) and allowed is not None
            if needs and not any(g == self.column and a.column in (None, v) for g, v in allowed):
                raise QueryError(f"column {self.column}: no group index" + (f" with {a.column}" if a.column else ""))
        return aggregates.grouped(self.query.matches(), self.column, outputs)
