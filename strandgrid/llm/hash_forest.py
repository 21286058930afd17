"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree hashes a vector to a string of BITS signs of random projections and keeps the strings of a block of vectors as
one sorted array.  A query descends every tree to its longest matching prefix (a binary search), then all trees ascend
together: each step shortens the prefix by a bit, which widens a range of each array.  At each step an entry gets a vote
from every tree whose range holds it, so its votes are the bits that it shares beyond the last prefix.  The ascent ends
when the ranges hold VISITS times the block's entries; the entries with most votes are the candidates, SHARE of the block
or CANDIDATES at least.  Their distances are exact.

Vectors are indexed in blocks of at most BLOCK rows and BLOCK_BYTES.  The queries are dealt by a hash into passes of
about QUERY_BYTES, which are broadcast one at a time; a pass is searched in every block, whose forest is built once for
it, and the best k of each block are merged.  So no task or broadcast grows with the input.  Equal vectors are one entry
of a block with their k + 1 smallest distinct ids, so a vector that is very common costs no more than another.

Defined cases: vectors that are null, zero, or hold a null or a number that isn't finite take no part; vectors of
another dimension than the query's are no candidates for it; rows without an id take no part; each row of a repeated id
is a candidate, but the id takes one place, with the smallest distance of its rows to those of the query's id; no row of
the query's own id is its candidate; equal distances are in the order of ids; fewer candidate ids than k give fewer rows;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgrid.llm._common import drop_written, table, written

TREES, BITS, SEED = 192, 16, 5
#: Candidates of a block: this share of its entries, but no fewer than so many.
SHARE, CANDIDATES = 0.12, 100
#: The ascent ends when the trees' ranges hold so many times the entries of the block.
VISITS = 5
K, EVERY = 10, 100
BLOCK, BLOCK_BYTES, QUERY_BYTES = 16_384, 16 << 20, 16 << 20


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(ok, F.lit(False)))


class Forest:
    """The sorted arrays of one block of vectors of equal dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(axis=1))
        fresh = new | np.append(True, ids[1:] != ids[:-1])  # not a repeated row
        ids, vectors, new = ids[fresh], vectors[fresh], new[fresh]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(ids)))
        self.vectors = vectors[first]
        self.ids = [ids[a : a + min(n, k + 1)] for a, n in zip(first.tolist(), many.tolist(), strict=True)]
        self.planes = np.random.default_rng(SEED).standard_normal((TREES, BITS, vectors.shape[1]))
        keys = self.hashed(self.vectors)
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def hashed(self, vectors: np.ndarray) -> np.ndarray:
        """The hash string of each vector in each tree, as an integer whose highest bit comes first."""
        out = np.zeros((TREES, len(vectors)), np.int32)
        for t in range(TREES):
            out[t] = (vectors @ self.planes[t].T > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int32))
        return out

    def ranges(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[bits dropped, tree, query]: where the range begins and ends that shares all bits of the query but the last
        ones, for 0 to BITS dropped bits."""
        low, high = (np.zeros((BITS + 1, *hashed.shape), np.int32) for _ in range(2))
        for drop in range(BITS + 1):
            first = hashed >> drop << drop
            for t in range(TREES):
                low[drop, t] = np.searchsorted(self.keys[t], first[t])
                high[drop, t] = np.searchsorted(self.keys[t], first[t] + (1 << drop))
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` entries with most votes; ``low``, ``high``: the ranges of one query."""
        n = len(self.vectors)
        if most >= n:
            return np.arange(n)
        size = (high - low).astype(np.int64)
        enough = np.flatnonzero(size.sum(axis=1) >= VISITS * n)
        steps = int(enough[0]) + 1 if len(enough) else BITS + 1
        size, low = size[:steps].ravel(), (low[:steps] + np.arange(TREES, dtype=np.int64) * n).ravel()
        place = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        votes = np.bincount(self.order.ravel()[place], minlength=n)
        return np.argpartition(-votes, most - 1)[:most]

    def nearest(self, own: int, vector: np.ndarray, at: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k nearest ids of the entries ``at``, each once."""
        distance = np.sqrt(((self.vectors[at] - vector) ** 2).sum(axis=1))
        out: list[tuple[float, int]] = []
        for x in np.argsort(distance, kind="stable").tolist():
            if len(out) >= k and distance[x] > out[-1][0]:
                break
            held = {own, *(i for _, i in out)}
            out += [(float(distance[x]), int(i)) for i in self.ids[at[x]] if int(i) not in held]
            out.sort()
            del out[k:]
        return [(i, d) for d, i in out]

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(query id, id, distance) of the k nearest found for each query."""
        most = max(CANDIDATES, k + 1, int(SHARE * len(self.vectors)))
        for a in range(0, len(ids), 256):
            low, high = self.ranges(self.hashed(vectors[a : a + 256]))
            for n, (q, v) in enumerate(zip(ids[a : a + 256].tolist(), vectors[a : a + 256], strict=True)):
                for i, d in self.nearest(q, v, self.candidates(low[:, :, n], high[:, :, n], most), k):
                    yield q, i, d


def by_dimension(ids: np.ndarray, v: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each dimension."""
    size, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
    end = np.cumsum(size)
    return {d: (ids[size == d], np.stack([flat[e - d : e] for e in end[size == d].tolist()])) for d in np.unique(size).tolist()}


def search_pass(index: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each index block."""
    held = index.sparkSession.sparkContext.broadcast(queries)
    rows_most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows, size = 0, 0

        def searched() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting.clear()
            out: list[tuple[int, int, float]] = []
            for dim, (ids, vectors) in by_dimension(whole.column(0).to_numpy(), whole.column(1)).items():
                if dim in held.value:
                    out += Forest(ids, vectors, k).search(*held.value[dim], k)
            q, i, d = zip(*out, strict=True) if out else ((), (), ())
            return pa.record_batch([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

        step = min(512, rows_most)
        for batch in batches:
            for part in (batch.slice(x, step) for x in range(0, batch.num_rows, step)):
                waiting.append(part)
                rows, size = rows + part.num_rows, size + 8 * len(part.column(1).flatten())
                if rows >= rows_most or size >= BLOCK_BYTES:
                    yield searched()
                    rows, size = 0, 0
        if waiting:
            yield searched()

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, each id once."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` (vec_id, v) its k nearest of ``index`` found."""
    spark = index.sparkSession
    asked = queries.select("vec_id", "v").distinct()
    size = asked.agg(F.sum(F.size("v").cast("long") * 8)).first()[0] or 0
    passes = max(1, -(-size // QUERY_BYTES))
    found = None
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(passes)) == p).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        one = rows.to_batches()[0]
        made = search_pass(index, by_dimension(one.column(0).to_numpy(), one.column(1)), k)
        if passes > 1:  # a job of its own, of which the best k of each query stay
            made = written(ranked(made, k).drop("rank"), "neighbours")
        found = made if found is None else found.unionByName(made)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if passes == 1:
        return ranked(found, k)
    out = written(ranked(found, k), "neighbours")
    drop_written(found)
    return out


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings"))
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % EVERY == 0))
