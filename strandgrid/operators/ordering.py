"""One-key orders with skip and take, and a stop at a count by batches of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Batches whose counts are summed up together before the runs of them are.
RUN = 4096


def ordered(df: DataFrame, column: str, up: bool, identity: list[str], skip: int | None, take: int | None) -> DataFrame:
    """NULLs first going up and last going down; ties by identity in the same direction; strings in any case.

    Skip and take become one TakeOrderedAndProject, so no full sort is made for a page of rows.
    """
    c = F.lower(column) if isinstance(df.schema[column].dataType, T.StringType) else F.col(column)
    keys = [c, *(F.col(k) for k in reversed(identity))]
    df = df.orderBy([k.asc_nulls_first() if up else k.desc_nulls_last() for k in keys])
    if skip:
        df = df.offset(skip)
    return df if take is None else df.limit(take)


def until_count(rows: DataFrame, key: str, batch: int, stop: int) -> DataFrame:
    """The rows of all batches of ``batch`` keys up to the one in which the running count reaches ``stop``.

    The running count has two levels: runs of RUN batches are summed up in one task, which sees one row for each of them,
    and the batches of a run in one task for each run.  Rows without a key are of no batch.

    ``rows`` may be dear, so they are made once: counts and result read one shuffle of them.  Spark shares it only if
    both want the same columns and rows of it: the counts group by all columns, and the condition on the partition's
    number, which always holds, isn't deterministic, so none is pushed below it.
    """
    at = lambda k: F.floor(F.col(k) / F.lit(batch))
    dealt = rows.where(F.col(key).isNotNull()).repartition(at(key)).where(F.spark_partition_id() >= 0)
    held = dealt.withColumn("_batch", at(key))
    sizes = held.groupBy("_batch", *[c for c in rows.columns if c != key]).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.groupBy("_batch").agg(F.sum("_n").alias("_n")).withColumn("_run", F.floor(F.col("_batch") / F.lit(RUN)))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sizes.groupBy("_run").agg(F.sum("_n").alias("_n")).select("_run", earlier(Window.orderBy("_run")).alias("_start"))
    inside = sizes.withColumn("_within", earlier(Window.partitionBy("_run").orderBy("_batch")))
    kept = inside.join(runs, "_run").where(F.col("_start") + F.col("_within") < stop).select("_batch")
    return held.join(kept, "_batch", "left_semi").drop("_batch")
