"""Queries over DataFrames: whole tables, partitions, sharded tables."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgrid.plans.errors import QueryError
from strandgrid.plans.query import Query
from strandgrid.plans.schema import TableSchema


def over(df: DataFrame, key: str = "Id", **known) -> Query:
    """A query over any DataFrame with an integer key.  ``known``: search, vectors, required (see TableSchema)."""
    return Query(df, TableSchema(key=key, **known))


def partition(df: DataFrame, column: str, value, key: str = "Id", shard: str | None = None, **known) -> Query:
    """One partition of a table stored with ``partitionBy(column)``: an equality on it, so other folders aren't read.
    ``shard``: the shard column of a table that is sharded as well."""
    return Query(df.where(F.col(column) == F.lit(value)), TableSchema(key=key, **known), shard=shard, reduced=True)


def sharded(df: DataFrame, shard: str = "Sid", key: str = "Id", **known) -> Query:
    """A table whose rows are identified by (shard, key).  Spark reads all shards as one DataFrame."""
    if shard not in df.columns:
        raise QueryError(f"a sharded table needs its shard column {shard}")
    return Query(df, TableSchema(key=key, **known), shard=shard)


def shard_of(key: Column, shards: int) -> Column:
    """Round-robin placement of numbered rows in shards 1 to ``shards``."""
    return (F.pmod(key, F.lit(shards)) + 1).cast("int")


def place(rows: DataFrame, shards: int, shard: str = "Sid", key: str = "Id", position: str | None = None) -> DataFrame:
    """Give the rows of a batch their shard: all must be new (key and shard 0) or all have both.

    New rows are dealt in turn by ``position`` (a number from 0), or at random if there is none; the draw has a seed, so a
    task that is run again deals as before.
    """
    new = (F.col(key) == 0) & (F.col(shard) == 0)
    half = (F.col(key) == 0) != (F.col(shard) == 0)
    seen = rows.agg(F.coalesce(F.max(half), F.lit(False)).alias("half"), F.coalesce(F.max(new), F.lit(False)).alias("new"), F.coalesce(F.max(~new), F.lit(False)).alias("old")).first()
    if seen["half"]:
        raise QueryError(f"{key} and {shard} must both be 0 or both be set")
    if seen["new"] and seen["old"]:
        raise QueryError("new and existing rows can't be saved in one batch")
    if not seen["new"]:
        return rows
    dealt = shard_of(F.col(position), shards) if position else (F.floor(F.rand(random.getrandbits(31)) * shards) + 1).cast("int")
    return rows.withColumn(shard, dealt)
