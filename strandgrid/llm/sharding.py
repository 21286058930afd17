"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child makes a weighted hash draw, an exponential
variable with the child's weight as rate, and the smallest draw wins; so children win in proportion to their weights.
A changed weight changes only that child's draw: rows move between that subtree and others, and nowhere else.

The texts are read once: their sizes, checksums and shards are written to the shared folder, and the slots are counted
from there.  A shard added to a full tree comes as a region of its own (``tree``), so it takes rows only into itself: law ``key``.

Defined cases: null text has size 1 and the checksum of the empty string; null ids share one draw, that of the id -2^62;
rows that repeat an id get the same shard and different slots; of equal draws the child that is named first wins; a
child without weight gets no rows; texts of any length are only measured; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgrid.llm._common import table, written

#: Groups that the rows of a shard are numbered in; their sizes are summed up front, so no task numbers a whole shard.
SLOT_CHUNKS = 4096
SHARDS = 16


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int = -1


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def tree(shards: int, racks: int = 2, per_rack: int = 2, base: int = SHARDS) -> Node:
    """``base`` shards in regions of ``racks`` x ``per_rack``; every shard beyond those is a region of its own."""
    leaf = lambda s: Node(f"shard{s}", 1.0, (), s)
    first, regions = min(shards, base), []
    for r in range(0, first, racks * per_rack):
        own = [
            inner(f"region{r}/rack{k}", [leaf(s) for s in range(k, min(k + per_rack, first))])
            for k in range(r, min(r + racks * per_rack, first), per_rack)
        ]
        regions.append(inner(f"region{r}", own))
    regions += [inner(f"region+{s}", [inner(f"region+{s}/rack", [leaf(s)])]) for s in range(base, shards)]
    return inner("root", regions)


def draw(key: Column, node: Node) -> Column:
    """Exponential with rate ``node.weight``, a function of the key and the node's name."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11) + F.lit(1)).cast("double") * F.lit(2.0**-53)
    return -F.log(u) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """The shard that ``key`` reaches below ``node``."""
    if node.shard >= 0:
        return F.lit(node.shard)
    alive = [c for c in node.children if c.weight > 0]
    if len(alive) == 1:
        return descend(key, alive[0])
    won = F.array_min(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(alive)]))["i"]
    out = descend(key, alive[-1])
    for i, c in reversed(list(enumerate(alive[:-1]))):
        out = F.when(won == i, descend(key, c)).otherwise(out)
    return out


def assign_shards(docs: DataFrame, now: Node, grown: Node) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, now).cast("int").alias("shard"),
        descend(key, grown).cast("int").alias("grown_shard"),
    )
    # the row's place takes part in its chunk, so equal rows don't pile up; written, so that the place stays
    chunk = F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(SLOT_CHUNKS)).cast("int")
    rows = written(rows.withColumn("_chunk", chunk), "shards")
    # at most shards x SLOT_CHUNKS rows, whatever the input: bounded for the broadcast
    sizes = rows.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_chunk").orderBy("doc_id", "text_crc32", "size")
    slotted = rows.withColumn("_i", F.row_number().over(order) - 1).join(F.broadcast(starts), ["shard", "_chunk"])
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_i")).cast("long").alias("slot"), "grown_shard")


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), tree(SHARDS), tree(SHARDS + 1))
