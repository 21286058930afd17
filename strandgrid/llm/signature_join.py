"""Exact Jaccard join of documents on word n-grams, by signature trees.

Two documents link when 100 * intersection >= 75 * union of their sets of 5-word shingles.  A block of documents is
joined by a signature tree: its nodes hold the OR of their documents' bitmaps and their range of sizes, and a dual
traversal drops every pair of nodes whose largest possible overlap is too small for any pair below.

Blocks come from the sets in hash order.  Documents with equal sets are one class from the start.

1. Classes that share their smallest shingle are joined with their whole sets: this finds most links.
2. Linked classes share one of their first n - ceil(3n/4) + 1 shingles, in any order that is the same for all, and one
   more for each by which these prefixes are longer (prefix filter; one more for MORE shingles of a set).  The order puts
   shingles of very many documents last: they are counted, over all documents, in a sketch of fixed size, whose only
   effect is the order and the way their postings go.  So a common passage makes no large block.  Classes that share
   enough such shingles with classes that they are not yet connected with are joined by bitmaps, and the pairs that pass
   are compared set by set.  First only the BEST pairs of every two components of a block are compared, then all pairs of
   what is still apart.

So no link between different components is missed.  Large blocks (of many classes, or of many shingles) are split: in
step 1 by a hash (what it misses, step 2 finds), in step 2 as ``blocks_of`` says.  Tables that the steps write are
deleted once their last reader is done.

Defined cases: a text with fewer than five words has its whole sequence as its only shingle; null and word-free texts
have none and form components of their own; rows that repeat link as equal sets; texts of any length are whole, their
words are hashed in slices of SLICE bytes; a class whose rows all lack an id has a null component; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgrid.llm._common import drop_written, id_text, powers, row_blocks, table, text_arrays, written
from strandgrid.llm._graph import IdFilter, components, id_filter

WORDS = 5
#: Most classes of a block that holds whole sets (step 1) or bitmaps (step 2), and shingles of them for each class.
BLOCK, WIDE = 4096, 100_000
SHINGLES = 640
FANOUT, LEADERS, BEST = 8, 6, 3
#: A set's prefix is one shingle longer for each so many of its shingles.
MORE = 32
#: Blocks of so many rows need no tree above their leaves.
SMALL = 16
#: Bytes of packed postings that one task of the prefix filter should hold.
BUCKET_BYTES = 16 << 20
#: Bytes of postings that a task holds before it sends them on.
FLUSH_BYTES = 24 << 20
#: Bytes of bitmaps that pairs are compared by at once, on either side.
PAIR_BYTES = 4 << 20
#: Counters of the sketch, and those sent in one row.  A counter is high from OFTEN + OFTEN_TIMES times the mean.
COUNTERS, CHUNK = 1 << 20, 1 << 15
OFTEN, OFTEN_TIMES = 256, 8
NO_ID = -(2**63)
#: Bytes of a long text whose words are hashed at once.
SLICE = 1 << 20
POSTING = np.dtype([("key", "<u8"), ("class", "<i8"), ("n", "<i4")])

_K = 0x100000001B3
_INVERSE = pow(_K, -1, 2**64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
_LOW = (_LOW + np.uint64(1)) * _MIX  # a byte's value, spread over 64 bits
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX2
    return (h ^ (h >> np.uint64(27))) * _MIX


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of some texts begins, and its hash; a long text is read in slices that end at a blank."""
    if len(offsets) == 2 and len(data) > SLICE:
        parts, at = [], 0
        while at < len(data):
            blank = np.flatnonzero(_BLANK[data[at + SLICE : at + 2 * SLICE]])
            end = at + SLICE + int(blank[0]) if len(blank) else len(data)
            start, word = _word_hashes(data[at:end], np.array([0, end - at]))
            parts.append((start + at, word))
            at = end
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    return _word_hashes(data, offsets)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blank = np.append(_BLANK[data], True)
    edge = np.zeros(n + 1, bool)
    edge[1:] = blank[1:] != blank[:-1]
    edge[0] = not blank[0]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    inner = inner[~blank[inner] & ~blank[inner - 1]]  # a word that ends and one that begins at the edge of two texts
    end, start = edge & blank, edge & ~blank
    start[inner] = end[inner] = True
    start, end = np.flatnonzero(start), np.flatnonzero(end)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOW[data] * powers(_K, n), dtype=np.uint64, out=total[1:])
    return start, mixed((total[end] - total[start]) * powers(_INVERSE, n)[start])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    none = np.zeros(0, np.uint64)
    start, word = word_hashes(data, offsets)
    chain = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        chain = chain * _MIX + word[i : i + len(chain)]
    chain = mixed(chain)
    bounds = np.searchsorted(start, offsets)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(chain[a : b - WORDS + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _MIX + w
            out.append(mixed(np.array([h])))
        else:
            out.append(none)
    return out


def class_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    """Shingles in the prefix of a set of n.  Sets of n and m that link have min(n, m) // MORE + 1 in common there."""
    return n - -(-3 * n // 4) + 1 + n // MORE


def least_shared(n: Column) -> Column:
    """Prefix shingles that a set of n shares with any set that it links with: the smallest such set has ceil(3n/4)."""
    return F.floor(F.ceil(3 * n / 4) / MORE) + 1


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def width(n: int) -> int:
    """Bits of a set's bitmap: a power of two, four times the set's size at least."""
    return max(64, 1 << (4 * int(n) - 1).bit_length())


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Narrower bitmaps (rows of 64-bit words) of the same sets."""
    while bits.shape[1] > words:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


class SignatureTree:
    """Levels of nodes over documents in the given order; the last level is the documents."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        surplus = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, surplus, comps, comps)]
        while len(self.levels[0][1]) > 1:
            bits, low, high, surplus, c0, c1 = self.levels[0]
            at = np.arange(0, len(low), FANOUT)
            self.levels.insert(0, (np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(surplus, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    @staticmethod
    def possible(level, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether any two documents below nodes i and j may link and are not yet in one component."""
        bits, low, high, surplus, c0, c1 = level
        alike = (c0[i] == c1[i]) & (c0[j] == c1[j]) & (c0[i] == c0[j])
        ok = ~alike & (4 * high[i] >= 3 * low[j]) & (4 * high[j] >= 3 * low[i])
        at = np.flatnonzero(ok)
        step = max(1, PAIR_BYTES // bits[0].nbytes)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            a, b = i[part], j[part]
            most = np.bitwise_count(bits[a] & bits[b]).sum(axis=1).astype(np.int64) + np.minimum(surplus[a], surplus[b])
            most = np.minimum(most, np.minimum(high[a], high[b]))
            ok[part] = 7 * most >= 3 * (low[a] + low[b])
        return ok

    def overlap(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Shared bits of documents, as a share of their sizes."""
        bits, size = self.levels[-1][:2]
        step = max(1, PAIR_BYTES // bits[0].nbytes)
        parts = [np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(axis=1) for k in range(0, len(i), step)]
        return np.concatenate(parts).astype(np.float64) / (size[i] + size[j]) if parts else np.zeros(0)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of document pairs (i < j) that the traversal can't rule out."""
        todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = np.arange(FANOUT)
        while todo:
            depth, i, j = todo.pop()
            if len(i) > 1 << 12:
                todo += [(depth, i[1 << 12 :], j[1 << 12 :])]
                i, j = i[: 1 << 12], j[: 1 << 12]
            level = self.levels[depth]
            ok = self.possible(level, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if depth == len(self.levels) - 1:
                yield i[i < j], j[i < j]
                continue
            n = len(self.levels[depth + 1][1])
            a = np.repeat(i * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(step, FANOUT), len(i))
            b = np.repeat(j * FANOUT, FANOUT * FANOUT) + np.tile(np.tile(step, FANOUT), len(i))
            keep = (a <= b) & (b < n) & (a < n)
            todo.append((depth + 1, a[keep], b[keep]))


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return 7 * int((b[at] == a).sum()) >= 3 * (len(a) + len(b))


def join_sets(sets: list[np.ndarray]) -> np.ndarray:
    """A label for each set: equal for sets that are connected by links among them; exact."""
    n = len(sets)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    if n <= 6:
        for i in range(n):
            for j in range(i):
                if (x := root(i)) != (y := root(j)) and links(sets[i], sets[j]):
                    parent[max(x, y)] = min(x, y)
        return np.array([root(i) for i in range(n)])
    sizes = np.array([len(s) for s in sets], np.int64)
    # a few leaders against all that are still alone: one search each
    alone = np.ones(n, bool)
    if n:
        for _ in range(LEADERS):
            left = np.flatnonzero(alone)
            if len(left) < 2:
                break
            lead = int(left[np.argsort(sizes[left], kind="stable")[len(left) // 2]])
            alone[lead] = False
            rest = left[(left != lead) & (4 * sizes[left] >= 3 * sizes[lead]) & (4 * sizes[lead] >= 3 * sizes[left])]
            if not len(rest):
                continue
            flat = np.concatenate([sets[k] for k in rest])
            hit = sets[lead][np.minimum(np.searchsorted(sets[lead], flat), sizes[lead] - 1)] == flat
            both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[rest])[:-1]]), dtype=np.int64)
            linked = rest[7 * both >= 3 * (sizes[rest] + sizes[lead])]
            parent[linked] = lead
            alone[linked] = False
    comps = np.array([root(i) for i in range(n)])
    if (comps == comps[0]).all():
        return comps
    order = np.lexsort((sizes, comps))
    bits = width(int(np.median(sizes)))
    tree = SignatureTree(np.stack([bitmap(sets[k], bits) for k in order]), sizes[order], comps[order])
    for i, j in tree.pairs():
        for a, b in zip(order[i].tolist(), order[j].tolist(), strict=True):
            if (x := root(a)) != (y := root(b)) and links(sets[a], sets[b]):
                parent[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(n)])


def sets_of(batches: Iterator[pa.RecordBatch], only: IdFilter | None = None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(rows, shingle sets) of blocks of rows; with ``only``, of the rows whose id passes."""
    for batch in batches:
        if only is not None:
            batch = batch.filter(pa.array(only.passes(batch.column(0).to_numpy(zero_copy_only=False))))
        data, offsets = text_arrays(batch.column(1))
        for i, j in row_blocks(offsets):
            yield batch.slice(i, j - i), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def keyed(docs: DataFrame) -> DataFrame:
    return id_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("key"))


def class_rows(docs: DataFrame) -> DataFrame:
    """doc_id, key, class, n, least of every row: hash of its text; its set's class, size and smallest hash (null if
    empty); and, for the first row of a class in a task, the set's bitmap.  Besides, chunk and counts: each task's
    counters of the shingles of its classes."""
    names = ["doc_id", "key", "class", "n", "least", "bits", "chunk", "counts"]
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(COUNTERS, np.uint32), set()
        for rows, sets in sets_of(batches):
            classes = [class_of(s) if len(s) else None for s in sets]
            new = [c is not None and c not in seen and not seen.add(c) for c in classes]
            if any(new):
                own = np.concatenate([s for s, x in zip(sets, new, strict=True) if x])
                counts += np.bincount((own & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            n = len(sets)
            bits = [bitmap(s, width(len(s))).tobytes() if x else None for s, x in zip(sets, new, strict=True)]
            columns = [classes, [len(s) for s in sets], [int(s[:1].view(np.int64)[0]) if len(s) else None for s in sets], bits, [None] * n, [None] * n]
            yield pa.record_batch([rows.column(0), rows.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds[2:], strict=True))], names)
        parts = counts.reshape(-1, CHUNK)
        full = np.flatnonzero(parts.any(axis=1)).tolist()
        none = [None] * len(full)
        columns = [none] * 6 + [full, [zlib.compress(parts[k].tobytes(), 1) for k in full]]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return keyed(docs).mapInArrow(run, "doc_id long, key long, class long, n long, least long, bits binary, chunk int, counts binary")


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Whether each counter of the sketch is high; of fixed size, so it may be collected and broadcast."""

    def total(t: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK, np.uint64)
        for x in t.column("counts").to_pylist():
            out += np.frombuffer(zlib.decompress(x), np.uint32)
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "counts": [out.tobytes()]})

    counts = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint64)
    for r in rows.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(total, "chunk int, counts binary").collect():
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.uint64)
    return counts.ravel() > OFTEN + OFTEN_TIMES * counts.mean()


def common_last(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A sorted set with its common shingles after the others."""
    last = common[(own & np.uint64(len(common) - 1)).astype(np.int64)]
    return np.concatenate([own[~last], own[last]]) if last.any() else own


def whole_sets(docs: DataFrame, only: IdFilter) -> DataFrame:
    """class, n, least, set (packed hashes) of the rows whose id passes; once for each class and task."""
    held = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in sets_of(batches, held.value):
            rows = [(c, s) for s in sets if len(s) and (c := class_of(s)) not in seen and not seen.add(c)]
            yield pa.record_batch([pa.array([c for c, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()), pa.array([int(s[:1].view(np.int64)[0]) for _, s in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], ["class", "n", "least", "set"])

    return keyed(docs).mapInArrow(run, "class long, n long, least long, set binary")


def weight(n: str) -> Column:
    """The size of a block: its classes, or its shingles by SHINGLES if that is more."""
    return F.greatest(F.count(F.lit(1)), (F.sum(n) / SHINGLES).cast("long"))


def first_links(docs: DataFrame, reps: DataFrame, buckets: int) -> DataFrame:
    """Step 1: class, root of the classes that a chain of links connects within their block of equal smallest shingles.

    The roots of a split block meet again in ever fewer parts, until one part holds them or nothing links any more.
    """
    level, now, heads = 0, reps, None
    made = new = linked_in_parts(docs, now, buckets, level)
    while True:
        large = now.groupBy("least").agg(F.count(F.lit(1)).alias("members"), weight("n").alias("weight")).where(F.col("weight") > BLOCK)
        left = written(now.join(large.select("least"), "least", "left_semi").join(new.select("class"), "class", "left_anti").select(now.columns), "heads")
        before, after = large.agg(F.sum("members")).first()[0] or 0, left.count()
        drop_written(heads, new if new is not made else None)
        heads = left
        if after in (0, before):
            drop_written(heads)
            return made
        level, now = level + 1, heads
        new = linked_in_parts(docs, now, buckets, level)
        step = new.select(F.col("class").alias("root"), F.col("root").alias("further"))
        grown = written(made.join(step, "root", "left").select("class", F.coalesce("further", "root").alias("root")).unionByName(new), "roots")
        drop_written(made)
        made = grown


def linked_in_parts(docs: DataFrame, reps: DataFrame, buckets: int, level: int) -> DataFrame:
    """class, root within the blocks of equal smallest shingles, or within hash parts of those beyond BLOCK classes."""
    shared = reps.groupBy("least").agg(F.count(F.lit(1)).alias("members"), weight("n").alias("weight")).where("members > 1")
    own = written(reps.join(shared, "least").select("class", "doc_id", "least", "weight"), "asked")
    # an id that passes may be another class's: shared, missing, or alike in its hash
    rows, large = whole_sets(docs, id_filter(own.select("doc_id"))), None
    if level:
        rows = rows.join(own.select("class", "weight"), "class")
    else:  # such a class is in ``own`` too, or the only one of its ``least``; so the sets needn't meet their classes
        large = written(own.where(F.col("weight") > BLOCK).select("least", "weight").distinct(), "large")
        rows = rows.join(large, "least", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    part = F.when(F.col("weight") > BLOCK, F.pmod(F.xxhash64("class", F.lit(level)), (F.col("weight") / BLOCK).cast("long") + 1)).otherwise(F.lit(0))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("least", part), F.lit(buckets)).cast("int")).withColumn("part", part)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("least", "ascending"), ("part", "ascending"), ("class", "ascending")])
        least, part, cls = (t.column(c).to_numpy() for c in ("least", "part", "class"))
        packed = t.column("set")
        cut = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (part[1:] != part[:-1])))
        out, roots = [], []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(cls)], strict=True):
            at = a + np.flatnonzero(np.append(True, cls[a + 1 : b] != cls[a : b - 1]))
            if len(at) > 1:
                label = join_sets([np.frombuffer(packed[int(k)].as_py(), np.uint64) for k in at])
                for k, r in zip(at, label.tolist(), strict=True):
                    if at[r] != k:
                        out.append(int(cls[k]))
                        roots.append(int(cls[at[r]]))
        return pa.table({"class": pa.array(out, pa.int64()), "root": pa.array(roots, pa.int64())})

    made = written(rows.select("bucket", "least", "part", "class", "set").groupBy("bucket").applyInArrow(run, "class long, root long"), "roots")
    drop_written(own, large)
    return made


def only_classes(rows: DataFrame, only: IdFilter) -> DataFrame:
    """The rows (class, bits) whose class passes."""
    held = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(held.value.passes(x.column(0).to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(run, "class long, bits binary")


def shared_prefixes(docs: DataFrame, buckets: int, common: np.ndarray) -> DataFrame:
    """Step 2: key, class, n for every prefix shingle that two or more classes of fitting sizes hold.

    The postings of a key meet in a task; those of common shingles, which may be of very many classes, don't: they are
    dealt by key and class and go on as they are, to be sifted by their components (``open_groups``).
    """
    held = docs.sparkSession.sparkContext.broadcast(common)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kept: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(kept) if kept else np.zeros(0, POSTING)
            often = held.value[(rows["key"] & np.uint64(COUNTERS - 1)).astype(np.int64)]
            spread = np.where(often, mixed(rows["key"] ^ rows["class"].view(np.uint64) * _MIX), rows["key"])
            where = (spread % np.uint64(buckets)).astype(np.int64) + buckets * often
            order = np.argsort(where, kind="stable")
            rows, where = rows[order], where[order]
            cut = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
            blobs = [rows[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=False)]
            return pa.record_batch([pa.array(where[cut], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for _, sets in sets_of(batches):
            for s in sets:
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                own = np.empty(prefix_length(len(s)), POSTING)
                own["key"], own["class"], own["n"] = common_last(s, held.value)[: len(own)], c, len(s)
                kept.append(own)
                size += own.nbytes
            if size > FLUSH_BYTES:
                yield flush()
                kept.clear()
                size = 0
        yield flush()

    def shared(t: pa.Table) -> pa.Table:
        packed = np.frombuffer(b"".join(t.column("blob").to_pylist()), POSTING)
        if t.column("bucket")[0].as_py() >= buckets:  # postings of common shingles: of each key only a part is here
            packed = np.unique(packed)
            return pa.table([pa.array(packed["key"].view(np.int64)), pa.array(packed["class"]), pa.array(packed["n"].astype(np.int64))], ["key", "class", "n"])
        order = np.argsort(packed["key"], kind="stable")
        same = packed["key"][order[1:]] == packed["key"][order[:-1]]
        packed = packed[order[np.append(same, False) | np.append(False, same)]]
        rows = np.stack([packed["key"].view(np.int64), packed["class"], packed["n"].astype(np.int64)], 1)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
        new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)) if len(rows) else np.zeros(0, bool)
        rows = rows[new]
        # in order of size, a class stays if a neighbour of its key may link to it
        near = (rows[1:, 0] == rows[:-1, 0]) & (4 * rows[:-1, 2] >= 3 * rows[1:, 2])
        rows = rows[np.append(near, False) | np.append(False, near)] if len(rows) else rows
        return pa.table({k: pa.array(np.ascontiguousarray(rows[:, i])) for i, k in enumerate(("key", "class", "n"))})

    blobs = keyed(docs).mapInArrow(packed, "bucket int, blob binary")
    return blobs.groupBy("bucket").applyInArrow(shared, "key long, class long, n long")


def small_blocks(block: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within blocks of at most SMALL rows; ``block`` is sorted, ``size``: of each row's block."""
    i = [np.flatnonzero((block[d:] == block[:-d]) & (size[d:] <= SMALL)) for d in range(1, SMALL)]
    return np.concatenate(i), np.concatenate([x + d for d, x in enumerate(i, 1)])


def best_of(score: np.ndarray, c0: np.ndarray, c1: np.ndarray, most: int) -> np.ndarray:
    """The pairs with the ``most`` highest scores of every two components."""
    low, high = np.minimum(c0, c1), np.maximum(c0, c1)
    order = np.lexsort((-score, high, low))
    new = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
    first = np.flatnonzero(new)
    return order[np.arange(len(order)) - first[np.cumsum(new) - 1] < most]


def bitmap_pairs(rows: DataFrame, buckets: int, best: int | None = None) -> DataFrame:
    """a, b, ca, cb (classes and their different components) that the trees of the blocks can't rule out; or, in
    ``again``, the key of a block of which not all pairs were given.

    ``rows``: key, block, side (null: the whole block is joined with itself; else 0 and 1 are joined), class, comp, n,
    bits.
    ``best``: only so many pairs of every two components of a bucket, those with the largest possible overlap.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        block, key, n, comp, cls = (t.column(c).to_numpy() for c in ("block", "key", "n", "comp", "class"))
        side = t.column("side").fill_null(2).to_numpy()
        packed = [np.frombuffer(x, np.uint64) for x in t.column("bits").to_pylist()]
        band = np.array([len(x) for x in packed], np.int64)
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        many = np.diff(np.append(cut, len(block)))
        made: list[np.ndarray] = []
        again: list[np.ndarray] = []

        def add(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
            keep = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 2))
            i, j = np.where(cls[i] < cls[j], i, j)[keep], np.where(cls[i] < cls[j], j, i)[keep]
            if best is not None and len(i):
                own = best_of(score[keep], comp[i], comp[j], best)
                again.append(np.unique(np.delete(key[i], own)))
                i, j = i[own], j[own]
            made.append(np.stack([cls[i], cls[j], comp[i], comp[j]], 1))

        i, j = small_blocks(block, np.repeat(many, many))
        low = np.minimum(band[i], band[j])
        fits = (np.maximum(band[i], band[j]) <= 2 * low) & (comp[i] != comp[j])
        for w in np.unique(low[fits]).tolist():
            at = np.flatnonzero(fits & (low == w))
            own, where = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            tree = SignatureTree(np.concatenate([fold(packed[k][None], w) for k in own]), n[own], comp[own])
            ok = tree.possible(tree.levels[-1], where[: len(at)], where[len(at) :])
            add(i[at[ok]], j[at[ok]], tree.overlap(where[: len(at)][ok], where[len(at) :][ok]))
        for a, k in zip(cut[many > SMALL].tolist(), many[many > SMALL].tolist(), strict=True):
            for w in np.unique(band[a : a + k]).tolist():  # documents that may link have equal or neighbouring widths
                own = a + np.flatnonzero((band[a : a + k] == w) | (band[a : a + k] == 2 * w))
                own = own[np.lexsort((n[own], comp[own]))]
                tree = SignatureTree(np.concatenate([fold(packed[x][None], w) for x in own]), n[own], comp[own])
                for i, j in tree.pairs():
                    fits = np.minimum(band[own[i]], band[own[j]]) == w
                    add(own[i[fits]], own[j[fits]], tree.overlap(i[fits], j[fits]))
        pairs = np.unique(np.concatenate(made), axis=0) if made else np.zeros((0, 4), np.int64)
        rest = np.unique(np.concatenate(again)).tolist() if again else []
        out = {k: pa.array(pairs[:, x].tolist() + [None] * len(rest), pa.int64()) for x, k in enumerate(("a", "b", "ca", "cb"))}
        return pa.table(out | {"again": pa.array([None] * len(pairs) + rest, pa.int64())})

    return rows.withColumn("bucket", F.pmod("block", F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(run, "a long, b long, ca long, cb long, again long")


def blocks_of(members: DataFrame) -> DataFrame:
    """key, block, side, class, comp, n: the groups of ``members`` (key, size, class, comp, n), large ones split.

    A large group has a major component, that of most of its classes, which needn't be joined with itself.  The classes
    of the major one are dealt to cells, by a range of n and a hash; each of the others (minor) meets the cells of its
    own range and of the two beside it, and the minor ones meet each other in cells of their own.
    """
    columns = ["key", "block", "side", "class", "comp", "n"]
    small = members.where(F.col("size") <= WIDE).select("key", F.xxhash64("key").alias("block"), F.lit(None).cast("int").alias("side"), "class", "comp", "n")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.34)))).cast("int")
    large = members.where(F.col("size") > WIDE).withColumn("band", band)
    counted = large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("many"), weight("n").alias("weight"))
    major = counted.groupBy("key").agg(F.max_by("comp", F.struct("many", "comp")).alias("major"), F.sum("weight").alias("all"), F.max(F.struct("many", "comp", "weight")).alias("top"))
    part = lambda weight: (weight / (WIDE // 2)).cast("int") + 1
    major = major.select("key", "major", part(F.col("top.weight")).alias("parts"), part(F.col("all") - F.col("top.weight")).alias("minor_parts"))
    large = large.join(major, "key")
    hashed = lambda parts: F.pmod(F.xxhash64("class"), F.col(parts)).cast("int")
    cell = lambda kind, *names: F.xxhash64("key", F.lit(kind), *names)
    own = large.where("comp = major").withColumn("block", cell(0, "band", hashed("parts"))).withColumn("side", F.lit(0))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    rest = large.where("comp <> major")
    met = rest.withColumn("step", near).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("block", cell(0, F.col("band") + F.col("step"), "p")).withColumn("side", F.lit(1))
    # the minor ones: a cell meets itself, and as side 0 or 1 every part of its own range and of the ranges beside it
    rest = rest.withColumn("part", hashed("minor_parts")).withColumn("step", near).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("minor_parts") - 1)))
    mine, theirs = F.struct("band", "part"), F.struct((F.col("band") + F.col("step")).alias("band"), F.col("p").alias("part"))
    rest = rest.withColumn("block", cell(1, F.least(mine, theirs), F.greatest(mine, theirs)))
    rest = rest.withColumn("side", F.when(mine == theirs, F.lit(None)).when(mine < theirs, 0).otherwise(1).cast("int"))
    return small.unionByName(own.select(columns)).unionByName(met.select(columns)).unionByName(rest.select(columns))


def true_links(docs: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b: the components ca, cb of the rows of ``pairs`` (a, b, ca, cb) whose whole sets link; a table in the shared
    folder."""
    ids = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    ids = written(ids.join(reps, "class").select("class", "doc_id"), "asked")
    sets = written(whole_sets(docs, id_filter(ids.select("doc_id"))).join(ids.select("class"), "class", "left_semi").dropDuplicates(["class"]), "sets")
    left = sets.select(F.col("class").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("set").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = [links(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(x.column("sa").to_pylist(), x.column("sb").to_pylist(), strict=True)]
            yield x.select(["ca", "cb"]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])

    found = pairs.join(left, "a").join(right, "b").select("ca", "cb", "sa", "sb").mapInArrow(run, "a long, b long")
    found = written(found.distinct(), "links")
    drop_written(sets, ids)
    return found


def open_groups(members: DataFrame) -> DataFrame:
    """key, size, class, comp, n, many: the groups of members (key, class, comp, n, many) of several components, gathered
    by their smallest class; a table in the shared folder.

    Keys whose smallest class is the same share most members (copies share most of their shingles): they are one group,
    in which a class stands once and a pair meets once.  ``many``: for how many prefix shingles a class stands in a group.
    A class that stands for fewer, in all groups, than it shares with a set that it links with goes.
    """
    least = members.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("class").alias("first")).where("c0 <> c1")
    gathered = members.join(least.select("key", "first"), "key").groupBy("first", "class").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.sum("many").alias("many"))
    # a class has no more groups than prefix shingles
    gathered = gathered.withColumn("all", F.sum("many").over(Window.partitionBy("class")))
    gathered = written(gathered.where(F.col("all") >= least_shared(F.col("n"))).drop("all"), "gathered")
    sizes = gathered.groupBy("first").agg(weight("n").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    out = gathered.join(sizes.select("first", "size"), "first").select(F.col("first").alias("key"), "size", "class", "comp", "n", "many")
    out = written(out, "open")
    drop_written(gathered)
    return out


def relabelled(rows: DataFrame, met: DataFrame) -> DataFrame:
    """``rows`` with their comp replaced by the component of ``met`` (node, component) that it belongs to."""
    other = [c for c in rows.columns if c != "comp"]
    return rows.join(met.withColumnRenamed("node", "comp"), "comp", "left").select(*other, F.coalesce("component", "comp").alias("comp"))


def linked_rows(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID for null), key, n, comp of every row of ``docs`` (doc_id, text): equal comp for linked rows, null
    for rows without shingles; a table in the shared folder."""
    spark = docs.sparkSession
    made = written(class_rows(docs), "classes")
    common, rows = common_shingles(made), written(made.where("chunk is null").drop("bits", "chunk", "counts"), "rows")
    reps = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("least").alias("least"))
    held = rows.agg(F.sum("n")).first()[0] or 0
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, held * POSTING.itemsize * (MORE + 4) // (4 * MORE) // BUCKET_BYTES + 1)  # the prefixes

    roots = first_links(docs, reps, max(shuffle, held * 8 // BUCKET_BYTES + 1))
    comp = F.coalesce("root", "class").alias("comp")
    members = written(shared_prefixes(docs, buckets, common).join(roots, "class", "left").select("key", "class", "n", comp), "prefixes")
    apart = open_groups(members.withColumn("many", F.lit(1)))
    drop_written(members)
    asked = apart.select("class").distinct()
    own = only_classes(made.where("bits is not null").select("class", "bits"), id_filter(asked)).join(asked, "class", "left_semi")
    bits = written(own.dropDuplicates(["class"]), "bitmaps")
    drop_written(made)  # the bitmaps of all classes, and the counters
    held = apart.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle, held // BUCKET_BYTES + 1)
    named = rows.join(roots, "class", "left").select("doc_id", "key", "n", comp)
    done = [rows, roots, bits]
    for best in (BEST, None):
        blocks = blocks_of(apart if best is not None else apart.join(pairs.select(F.col("again").alias("key")), "key", "left_semi"))
        pairs = written(bitmap_pairs(blocks.join(bits, "class"), parts, best).distinct(), "pairs")
        done += [apart, pairs]
        links = true_links(docs, pairs.where("a is not null").drop("again"), reps)
        met = components(links)
        drop_written(links)
        done.append(met)
        named = relabelled(named, met)
        if best is not None:
            apart = open_groups(relabelled(apart.drop("size"), met))
    named = written(named, "linked")
    drop_written(*done)
    return named


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    named = linked_rows(docs)
    least = named.where("comp is not null").groupBy("comp").agg(F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("component_id"))
    return named.join(least, "comp", "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull() & (F.col("doc_id") != NO_ID), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` of which one row of each linked group stays: of the smallest id (null last), then
    text hash, then hash of all columns.  Rows without shingles are linked with nothing and all stay."""
    named = linked_rows(docs)
    first = F.min(F.struct((F.col("doc_id") == NO_ID).alias("last"), F.col("doc_id"), F.col("key")))
    kept = named.where("comp is not null").groupBy("comp").agg(first.alias("first")).select("first.doc_id", "first.key")
    same = named.where("comp is not null").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    alone = named.where("comp is null").select("doc_id", "key", F.lit(1).cast("long").alias("copies")).distinct()
    kept = written(kept.join(same, ["doc_id", "key"]).unionByName(alone), "kept")
    drop_written(named)
    # the rows travel as one struct, so their names can't clash with ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    stay = rows.join(kept, ["doc_id", "key"])
    if kept.where("copies > 1").isEmpty():
        return stay.select("row.*")
    # rows that repeat id and text: the one whose other columns have the smallest hash
    plain = [F.col(f"row.{f.name}") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = F.min_by("row", F.xxhash64(*plain)).alias("row")
    repeated = stay.where("copies > 1").groupBy("doc_id", "key").agg(one)
    return stay.where("copies = 1").select("row.*").unionByName(repeated.select("row.*"))


def op10_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
