"""Save, update, delete and increment as DataFrame transformations: from rows before to rows after."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgrid.plans.errors import QueryError
from strandgrid.plans.expr import kind_of, literal
from strandgrid.plans.schema import MAX_NEW_ID, TableSchema, evolved, is_vector, shaped

#: Positions that one task numbers when ids are assigned.
CHUNK_BITS = 20


def first_of_each(items: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of rows with the same key, the one with the lowest position; rows with key 0 are all new and all stay."""
    w = Window.partitionBy(*keys, F.when(F.col(keys[-1]) == 0, F.col(position))).orderBy(position)
    return items.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def with_ids(items: DataFrame, key: str, position: str, last: int) -> DataFrame:
    """Give rows with key 0 the ids after ``last``, in the order of position.

    Rows are numbered in chunks of positions; the chunks' counts are summed up in one small table, so no task numbers
    all rows.
    """
    old, new = items.where(F.col(key) != 0), items.where(F.col(key) == 0).withColumn("_chunk", F.shiftright(F.col(position), CHUNK_BITS))
    sizes = new.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = new.join(sizes.select("_chunk", start.alias("_start")), "_chunk").withColumn("_nth", F.row_number().over(Window.partitionBy("_chunk").orderBy(position)))
    number = F.lit(last) + F.col("_start") + F.col("_nth")
    limit = F.when(number > MAX_NEW_ID, F.raise_error(F.lit("the largest id is reached"))).otherwise(number)
    kind = items.schema[key].dataType
    return old.unionByName(numbered.withColumn(key, limit.cast(kind)).drop("_chunk", "_start", "_nth"))


def checked_ids(items: DataFrame, key: str) -> DataFrame:
    c = F.col(key)
    bad = F.when(c.isNull(), F.raise_error(F.lit(f"{key} can't be NULL"))).when(c < 0, F.raise_error(F.lit(f"{key} can't be negative"))).otherwise(c)
    return items.withColumn(key, bad.cast(items.schema[key].dataType))


def upserted(before: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` replace the rows of their keys and are added otherwise; columns are only ever added."""
    schema = evolved(before.schema, items.schema)
    kept = before.join(items.select(*keys), keys, "left_anti")
    return shaped(kept, schema).unionByName(shaped(items, schema))


def saved(before: DataFrame, items: DataFrame, schema: TableSchema, position: str = "_position") -> DataFrame:
    """The table after a batch is saved: the first of equal keys counts, key 0 gets the next id."""
    if position not in items.columns:
        items = items.withColumn(position, F.monotonically_increasing_id())
    last = before.agg(F.max(schema.key)).first()[0] or 0
    top = items.agg(F.max(schema.key)).first()[0] or 0
    items = first_of_each(checked_ids(items, schema.key), [schema.key], position)
    items = with_ids(items, schema.key, position, max(last, top)).drop(position)
    return upserted(before, schema.normalised(items), [schema.key])


def change_table(before: DataFrame, column: str, changes: Mapping[int, Any], schema: TableSchema, key: str) -> DataFrame:
    """(key, _new) of a dictionary of new values, checked against the column."""
    kind = kind_of(before.schema, column)
    if column == key:
        raise QueryError("the key can't be updated")
    for v in changes.values():
        if v is None and column in schema.required:
            raise QueryError(f"column {column} can't be set to None")
        if v is not None and not is_vector(kind) and not isinstance(kind, T.BinaryType):
            literal(v, kind, column)
    rows = [(k, list(map(float, v)) if is_vector(kind) and v is not None else v) for k, v in changes.items()]
    out = before.sparkSession.createDataFrame(rows, T.StructType([T.StructField(key, before.schema[key].dataType), T.StructField(column, kind)]))
    return out.select(key, schema.stored(column, kind).alias("_new"))


def updated(before: DataFrame, column: str, changes: Mapping[int, Any] | DataFrame, schema: TableSchema) -> DataFrame:
    """The table after one column is set for some keys (a dictionary, or a DataFrame of key and value); unknown keys are
    ignored."""
    key = schema.key
    if isinstance(changes, DataFrame):
        value = changes.columns[1]
        new = changes.select(F.col(changes.columns[0]).alias(key), F.col(value).cast(kind_of(before.schema, column)).alias(column))
        new = new.select(key, schema.stored(column, before.schema[column].dataType).alias("_new"))
    else:
        new = change_table(before, column, changes, schema, key)
    joined = before.join(new.withColumn("_hit", F.lit(True)), key, "left")
    return joined.select([F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in before.columns])


def deleted(before: DataFrame, ids: Iterable[int] | DataFrame, schema: TableSchema) -> DataFrame:
    """The table without the rows of some keys; unknown keys are ignored."""
    key = schema.key
    gone = ids.select(F.col(ids.columns[0]).alias(key)) if isinstance(ids, DataFrame) else before.sparkSession.createDataFrame([(int(i),) for i in ids], T.StructType([T.StructField(key, before.schema[key].dataType)]))
    return before.join(gone, key, "left_anti")


def wrapped(n: int) -> int:
    """An int column's value: beyond its 32 bits it goes on at the other end."""
    return (n + 2**31) % 2**32 - 2**31


def incremented(before: DataFrame, matches: DataFrame, steps: Mapping[str, int], new_row: Mapping[str, Any], schema: TableSchema, only_if: int | None = None) -> tuple[DataFrame, int | None]:
    """Add to int columns of the one row of ``matches``, or insert ``new_row`` if there is none.

    Returns the table after, and the first column's old value (None if a row was inserted).  With ``only_if``, nothing is
    added unless the old value is that; the old value is returned all the same.  Sums wrap around at 32 bits.
    """
    for c in steps:
        if not isinstance(kind_of(before.schema, c), T.IntegerType):
            raise QueryError(f"column {c}: only int columns can be incremented")
    found = matches.limit(2).collect()
    if len(found) > 1:
        raise QueryError("more than one row matches")
    if not found:
        fields = [f for f in before.schema if f.name in new_row]
        row = before.sparkSession.createDataFrame([tuple(new_row[f.name] for f in fields)], T.StructType(fields))
        if schema.key not in new_row:
            row = row.withColumn(schema.key, F.lit(0).cast(before.schema[schema.key].dataType))
        return saved(before, row, schema), None
    row = found[0]
    if any(row[c] is None for c in steps):
        raise QueryError("NULL can't be incremented")
    old = row[next(iter(steps))]
    if only_if is not None and old != only_if:
        return before, old
    hit = F.col(schema.key) == F.lit(row[schema.key])
    added = {c: F.when(hit, F.lit(wrapped(row[c] + n)).cast("int")).otherwise(F.col(c)) for c, n in steps.items()}
    return before.withColumns(added), old
