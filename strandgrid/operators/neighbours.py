"""Exact nearest neighbours of one query vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgrid.functions.vector import squared_distance


def nearest(source: DataFrame, column: str, to: Sequence[float], k: int, key: str, shard: str | None = None) -> DataFrame:
    """shard (if given), key, distance of the k nearest rows, of each shard if given; NULL vectors are never near.

    Without shards this is a TakeOrderedAndProject: each task keeps k rows.  With shards, the k best of each shard and
    task come first too (row_number with a limit is pushed below the exchange), then those of each shard.
    """
    d = squared_distance(F.col(column), to, column).alias("distance")
    rows = source.where(F.col(column).isNotNull())
    if shard is None:
        return rows.select(key, d).orderBy("distance", key).limit(k)
    w = Window.partitionBy(shard).orderBy("distance", key)
    return rows.select(shard, key, d).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
