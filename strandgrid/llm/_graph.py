"""Connected components of an edge table, and a bounded filter of ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgrid.llm._common import drop_written, written

FILTER_BITS_LOG2 = 24
_CHUNK_BYTES = 1 << 15
#: Edges that a task holds at once when it contracts them.
LOCAL_EDGES = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bit(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * _MIX
    return ((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(64 - FILTER_BITS_LOG2)).astype(np.int64)


class IdFilter:
    """Bits of hashed ids, of fixed size: a passed id may not be in the set, a refused one isn't."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def passes(self, ids: np.ndarray) -> np.ndarray:
        b = _bit(ids)
        return (self.bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def id_filter(ids: DataFrame) -> IdFilter:
    """The filter of a one-column table of longs.  Tasks OR their bits in chunks; 2 MB reach the driver, never the ids."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << FILTER_BITS_LOG2, bool)
        for batch in batches:
            own[_bit(batch.column(0).to_numpy(zero_copy_only=False))] = True
        packed = np.packbits(own, bitorder="little").reshape(-1, _CHUNK_BYTES)
        full = np.flatnonzero(packed.any(axis=1))
        yield pa.record_batch([pa.array(full, pa.int32()), pa.array([packed[k].tobytes() for k in full], pa.binary())], ["chunk", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        out = np.zeros(_CHUNK_BYTES, np.uint8)
        for x in table.column("bits").to_pylist():
            out |= np.frombuffer(x, np.uint8)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": [out.tobytes()]})

    spark = ids.sparkSession
    parts = min(64, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = ids.repartition(parts).mapInArrow(bits, "chunk int, bits binary")
    out = np.zeros((1 << FILTER_BITS_LOG2) // 8, np.uint8).reshape(-1, _CHUNK_BYTES)
    for row in packed.groupBy("chunk").applyInArrow(joined, "chunk int, bits binary").collect():
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return IdFilter(out.ravel())


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges with the same components: of every LOCAL_EDGES edges, each node to the smallest that it reaches."""
    waiting: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        edges = np.concatenate(waiting)
        waiting.clear()
        nodes, at = np.unique(edges, return_inverse=True)
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in at.reshape(-1, 2).tolist():
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        least = np.array([root(x) for x in range(len(nodes))], np.int64)
        moved = least != np.arange(len(nodes))
        return pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], ["a", "b"])

    for batch in batches:
        waiting.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1))
        if sum(map(len, waiting)) >= LOCAL_EDGES:
            yield stars()
    if waiting:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b) that reach a smaller one: the smallest node reachable; a table in
    the shared folder.

    Edges are contracted task by task first; then large-star and small-star rounds (Kiveris et al., 2014) until no edge
    changes; each round is a written table.
    """
    now = written(edges.where("a <> b").mapInArrow(local_stars, "a long, b long").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        new = written(new.where("a <> b").distinct(), "edges")
        was, state = state, new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = new
        if state == was:
            out = written(now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
            drop_written(now)
            return out
