"""Removal of repeated passages: every byte covered by a LENGTH-byte string that also starts anywhere else.

Suffixes are indexed at anchors only.  The anchor of a LENGTH-byte window is the leftmost smallest hashed GRAM-gram in
it, a function of the window's content: two equal windows have their anchors at the same place, so comparing the
anchors of one gram with each other finds every repeated window.  An anchor owns the windows that chose it.

1. Every distinct text gives its anchors: hash of the gram, hash of all bytes its windows cover (its whole).
2. Of the anchors of a gram that stands in several places, two of each whole are compared by a logarithmic family of
   suffix arrays (``SuffixFamily``), with the bytes around them: each batch of anchored suffixes becomes an array of
   them sorted by the bytes after the gram, and one sorted by the bytes before it; both are merged with every level, two
   sorted runs at a time, and scanned for windows that two suffixes share; levels of equal size are merged.  Further
   anchors of a whole lie in the same passage and follow without being compared again, so copies never pile up.
3. The intervals found are joined to the texts, merged and removed.

A gram may stand in very many different surroundings.  While the anchors are made, they are counted by gram in a sketch
of fixed size, over all texts; its only effect is where anchors go: the grams of a high counter (more than HOT and
HOT_TIMES the mean) never meet in one task.  Their windows are hashed whole and counted by the hash.

Defined cases: null is the empty text; texts shorter than LENGTH lose nothing; a text that occurs in several rows is
lost whole if it has LENGTH bytes; texts of any length are whole, their anchors are made in slices of SLICE bytes;
rows that repeat a text or an id count as rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgrid.llm._common import drop_written, id_text, powers, row_blocks, table, text_arrays, written

LENGTH, GRAM = 200, 64
#: Counters of the sketch, and those sent in one row.  A counter is high from HOT + HOT_TIMES times the mean.
COUNTERS, CHUNK = 1 << 22, 1 << 16
HOT, HOT_TIMES = 50_000, 8
#: Anchors in a batch of the family, and in a partition.
BATCH, PARTITION = 30_000, 90_000
#: Bytes of anchors that a task holds before it sends them on, and that a bucket should hold.
FLUSH_BYTES, BUCKET_BYTES = 24 << 20, 16 << 20
#: Rows of a packed blob; a reader holds some thousands of blobs.
PIECE = 512
#: Bytes of a long text whose anchors are made at once.
SLICE = 1 << 20

_K = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = pow(int(_K), -1, 2**64)
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, np.int64).astype(np.uint64)
ANCHOR = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("text", "<i8"), ("size", "<i4"), ("at", "<i4"), ("far", "<u1"), ("near", "<u1")])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of a byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers(int(_K), n), dtype=np.uint64, out=self.total[1:])
        self.shrink = powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.shrink[start])

    def grams(self, k: int) -> np.ndarray:
        return mixed((self.total[k:] - self.total[:-k]) * self.shrink[: len(self.shrink) - k])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: running minima of blocks from both ends."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The ANCHOR rows of each text of a block."""
    if len(offsets) == 2 and len(data) > SLICE + LENGTH:
        return long_anchors(data, int(text[0]))
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    if not windows.any():
        return np.zeros(0, ANCHOR)
    hashes = Hashes(data)
    grams = hashes.grams(GRAM)
    where = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(grams >> np.uint64(32) << np.uint64(32) | where, LENGTH - GRAM + 1)
    owner = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(len(owner)) + (offsets[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]))[owner]
    chosen = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    first, last, at, owner = start[cut], start[np.append(cut[1:] - 1, len(start) - 1)], chosen[cut], owner[cut]
    out = np.empty(len(cut), ANCHOR)
    out["gram"], out["text"], out["size"] = grams[at], text[owner], sizes[owner]
    out["at"], out["far"], out["near"] = at - offsets[owner], at - first, at - last
    shape = out["far"].astype(np.uint64) << np.uint64(8) | out["near"].astype(np.uint64)
    out["whole"] = mixed(hashes.of(first, last + LENGTH) + shape * _K)
    return out


def long_anchors(data: np.ndarray, text: int) -> np.ndarray:
    """The anchors of one long text, by slices that overlap by a window less a byte.  An anchor that owns windows of two
    slices stands twice, each time with the windows of one."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[at : at + SLICE + LENGTH - 1]
        own = anchors(part, np.array([0, len(part)]), np.array([text]))
        own["at"] += at
        out.append(own)
    found = np.concatenate(out)
    found["size"] = len(data)
    return found


def groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number of each row in that order) of equal rows."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.cumsum(new)


def covered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval of its text that an anchor's windows cover."""
    return rows["at"].astype(np.int64) - rows["far"], rows["at"].astype(np.int64) - rows["near"] + LENGTH


def merged(text: np.ndarray, size: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of each text without overlaps."""
    if not len(text):
        return text, size, start, end
    order = np.lexsort((start, size, text))
    text, size, start, end = text[order], size[order], start[order], end[order]
    other = np.append(True, (text[1:] != text[:-1]) | (size[1:] != size[:-1]))
    number = np.cumsum(other)
    reach = np.maximum.accumulate(end + number * 2**32) - number * 2**32  # restarts at each text
    new = other | np.append(True, start[1:] > reach[:-1])
    return text[new], size[new], start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def found_rows(kind: int, text, size, a, b, c=None, gram=None) -> pa.RecordBatch:
    n = len(text)
    zero = np.zeros(n, np.int32)
    return pa.record_batch(
        [pa.array(np.full(n, kind, np.int32)), pa.array(np.ascontiguousarray(text), pa.int64()), pa.array(np.ascontiguousarray(size), pa.int32())]
        + [pa.array(np.ascontiguousarray(zero if x is None else x).astype(np.int32)) for x in (a, b, c)]
        + [pa.array(np.zeros(n, np.int64) if gram is None else np.ascontiguousarray(gram).view(np.int64))],
        ["kind", "text", "size", "a", "b", "c", "gram"],
    )


_FOUND = "kind int, text long, size int, a int, b int, c int, gram long"
INTERVAL, DETAIL, BY_WINDOW = 0, 1, 2
#: Kinds of the rows that packed_anchors gives.
ANCHORS, SURE, COUNTS = 0, 1, 2


def counter_of(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64(COUNTERS - 1)).astype(np.int64)


def of_each(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ANCHOR rows in the order of gram, whole and place, each place once, and each row's number among its whole."""
    order, place = groups(rows["gram"], rows["whole"], rows["text"], rows["size"], rows["at"])
    rows = rows[order][np.append(True, place[1:] != place[:-1])] if len(rows) else rows
    new = np.append(True, (rows["gram"][1:] != rows["gram"][:-1]) | (rows["whole"][1:] != rows["whole"][:-1]))[: len(rows)]
    first = np.flatnonzero(new)
    return rows, np.arange(len(rows)) - first[np.cumsum(new) - 1] if len(rows) else np.zeros(0, np.int64)


def sure_intervals(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    return merged(rows["text"], rows["size"].astype(np.int64), *covered(rows))


def packed_anchors(docs: DataFrame) -> DataFrame:
    """kind, chunk, n, blob.  ANCHORS: packed ANCHOR rows, at most two of a whole and flush.  SURE: intervals of further
    ones.  COUNTS: a chunk of a task's counters, by gram, and how many anchors it has counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        kept: list[np.ndarray] = []
        size = 0
        counts = np.zeros(COUNTERS, np.uint32)

        def flush() -> pa.RecordBatch:
            rows, nth = of_each(np.concatenate(kept) if kept else np.zeros(0, ANCHOR))
            np.add.at(counts, counter_of(rows["gram"][nth == 0]), 1)
            sure = np.stack(sure_intervals(rows[nth >= 2]), 1).astype(np.int64)
            blobs = [(kind, x[k : k + PIECE].tobytes()) for kind, x in ((ANCHORS, rows[nth < 2]), (SURE, sure)) for k in range(0, len(x), PIECE)]
            n = [int((nth == 0).sum())] + [0] * (len(blobs) - 1)
            return packed_rows([k for k, _ in blobs], [None] * len(blobs), n[: len(blobs)], [x for _, x in blobs])

        for batch in batches:
            keys, sizes = batch.column("key").to_numpy(), batch.column("size").to_numpy()
            new = np.array([s >= LENGTH and (k, s) not in seen and not seen.add((k, s)) for k, s in zip(keys.tolist(), sizes.tolist(), strict=True)], bool)
            batch, keys = batch.filter(pa.array(new)), keys[new]
            data, offsets = text_arrays(batch.column("text"))
            for i, j in row_blocks(offsets):
                own = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], keys[i:j])
                kept.append(own)
                size += own.nbytes
                if size > FLUSH_BYTES:
                    yield flush()
                    kept.clear()
                    size = 0
        yield flush()
        parts = counts.reshape(-1, CHUNK)
        full = np.flatnonzero(parts.any(axis=1)).tolist()
        yield packed_rows([COUNTS] * len(full), full, [0] * len(full), [zlib.compress(parts[k].tobytes(), 1) for k in full])

    return docs.select("key", "size", "text").mapInArrow(run, "kind int, chunk int, n long, blob binary")


def packed_rows(kind: list, chunk: list, n: list, blob: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(kind, pa.int32()), pa.array(chunk, pa.int32()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], ["kind", "chunk", "n", "blob"])


def high_counters(packed: DataFrame, number: int, hot: int) -> np.ndarray:
    """Whether each counter of the sketch is high: a bit each, whatever the input."""
    limit = hot + HOT_TIMES * number / COUNTERS

    def total(t: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK, np.uint64)
        for x in t.column("blob").to_pylist():
            out += np.frombuffer(zlib.decompress(x), np.uint32)
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "blob": [np.packbits(out > limit).tobytes()]})

    high = np.zeros((COUNTERS // CHUNK, CHUNK), bool)
    for r in packed.where(f"kind = {COUNTS}").select("chunk", "blob").groupBy("chunk").applyInArrow(total, "chunk int, blob binary").collect():
        high[r["chunk"]] = np.unpackbits(np.frombuffer(r["blob"], np.uint8))
    return high.ravel()


def dealt(packed: DataFrame, buckets: int, high: np.ndarray) -> DataFrame:
    """(bucket, blob): ANCHOR rows by gram (bucket from 0), those of high counters by whole (bucket from ``buckets``),
    intervals (bucket below 0)."""
    held = packed.sparkSession.sparkContext.broadcast(np.packbits(high))

    def split(rows: np.ndarray, where: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(where, kind="stable")
        rows, where = rows[order], where[order]
        cut = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        blobs = [rows[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True)]
        return pa.record_batch([pa.array(where[cut], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.unpackbits(held.value).astype(bool)
        kept: dict[int, list[bytes]] = {ANCHORS: [], SURE: []}

        def flush() -> Iterator[pa.RecordBatch]:
            rows, sure = np.frombuffer(b"".join(kept[ANCHORS]), ANCHOR), np.frombuffer(b"".join(kept[SURE]), np.int64).reshape(-1, 4)
            kept[ANCHORS].clear()
            kept[SURE].clear()
            if len(rows):
                apart = high[counter_of(rows["gram"])]
                yield split(rows, (np.where(apart, rows["whole"], rows["gram"]) % np.uint64(buckets)).astype(np.int64) + buckets * apart)
            if len(sure):
                yield split(sure, -1 - (sure[:, 0] % buckets))

        size = 0
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                kept[kind].append(blob)
                size += len(blob)
                if size > FLUSH_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return packed.where(f"kind <> {COUNTS}").select("kind", "blob").mapInArrow(run, "bucket int, blob binary")


def compare_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """The anchors to compare in detail (two of each whole, if their gram stands in several places) or by window, and the
    intervals of further ones."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        blob = b"".join(t.column("blob").to_pylist())
        if bucket < 0:
            x = np.frombuffer(blob, np.int64).reshape(-1, 4)
            return pa.Table.from_batches([found_rows(INTERVAL, x[:, 0], x[:, 1], x[:, 2], x[:, 3])])
        rows, nth = of_each(np.frombuffer(blob, ANCHOR))
        asked, further = rows[nth < 2], rows[nth >= 2]
        kind = BY_WINDOW
        if bucket < buckets:
            gram, kind = asked["gram"], DETAIL
            new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
            of_gram = np.cumsum(new) - 1
            asked = asked[np.bincount(of_gram, minlength=1)[of_gram] > 1]
        out = [found_rows(INTERVAL, *sure_intervals(further)), found_rows(kind, asked["text"], asked["size"], asked["at"], asked["far"], asked["near"], asked["gram"])]
        return pa.Table.from_batches(out)

    return rows.groupBy("bucket").applyInArrow(run, _FOUND)


def interleaved(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``b`` put to the places ``at`` of the result, ``a`` to the others."""
    out = np.empty((len(a) + len(b), *a.shape[1:]), a.dtype)
    mine = np.ones(len(out), bool)
    mine[at] = False
    out[mine], out[at] = a, b
    return out


class Sorted:
    """Anchored suffixes in the order of gram and bytes on one side of it; ``row``: their numbers."""

    def __init__(self, key: np.ndarray, row: np.ndarray):
        self.key, self.row = key, row

    @staticmethod
    def of(gram: np.ndarray, side: np.ndarray, row: np.ndarray) -> "Sorted":
        """By gram, then eight bytes more in each round; only suffixes that still tie are sorted again."""
        order = np.argsort(gram, kind="stable")
        head = np.append(True, gram[order[1:]] != gram[order[:-1]])
        words = np.ascontiguousarray(side).view(">u8")
        for c in range(words.shape[1]):
            at = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(at):
                break
            group = np.cumsum(head)[at]
            value = words[order[at], c].astype(np.uint64)
            again = np.lexsort((value, group))
            order[at], value = order[at][again], value[again]
            head[at] = np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1]))
        # one byte string each, compared as such; the last byte keeps zeros before it from being dropped
        key = np.empty((len(order), 8 + side.shape[1] + 1), np.uint8)
        key[:, :8] = np.ascontiguousarray(gram[order].astype(">u8")).view(np.uint8).reshape(-1, 8)
        key[:, 8:-1], key[:, -1] = side[order], 1
        return Sorted(key, row[order])

    def strings(self) -> np.ndarray:
        return self.key.view(f"S{self.key.shape[1]}").ravel()

    def merge(self, other: "Sorted") -> "Sorted":
        """Two sorted runs as one: the place of each of ``other`` among ours is found by binary search."""
        at = np.searchsorted(self.strings(), other.strings(), "right") + np.arange(len(other.row))
        return Sorted(interleaved(self.key, other.key, at), interleaved(self.row, other.row, at))

    def common(self) -> np.ndarray:
        """Bytes that each suffix shares with the one before it on this side, from the gram on; -1: another gram."""
        differ = self.key[1:, 8:-1] != self.key[:-1, 8:-1]
        out = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
        return np.where((self.key[1:, :8] == self.key[:-1, :8]).all(axis=1), out, -1)


class Level:
    """A suffix array (by the bytes after the gram) and the same of the text read backward (by the bytes before it)."""

    def __init__(self, after: Sorted, before: Sorted):
        self.after, self.before = after, before

    def merge(self, other: "Level") -> "Level":
        return Level(self.after.merge(other.after), self.before.merge(other.before))


class SuffixFamily:
    """Levels of geometrically growing size; ``hits[row, d]``: the window that begins d bytes before row's anchor."""

    def __init__(self):
        self.levels: list[Level] = []
        self.hits = np.zeros((0, LENGTH - GRAM + 1), bool)
        self.far = self.near = np.zeros(0, np.int64)

    def add(self, gram, after, before, far, near) -> None:
        row = len(self.hits) + np.arange(len(gram))
        self.hits = np.concatenate([self.hits, np.zeros((len(gram), self.hits.shape[1]), bool)])
        self.far, self.near = np.concatenate([self.far, far]), np.concatenate([self.near, near])
        new = Level(Sorted.of(gram, after, row), Sorted.of(gram, before, row))
        self.scan(new)
        for level in self.levels:
            self.scan(level.merge(new))
        while self.levels and len(self.levels[-1].after.row) <= len(new.after.row):
            new = self.levels.pop().merge(new)
        self.levels.append(new)

    def scan(self, level: Level) -> None:
        """Mark the windows that two suffixes share: equal from the anchor on for as long as the window goes (a run of
        the one array), and equal before it (a run of the other)."""
        after, before = level.after, level.before
        n = len(after.row)
        if n < 2:
            return
        right, left = after.common(), before.common()
        # the order of the rows of this level, and where each stands in the other array
        place = np.empty(n, np.int64)
        place[np.argsort(after.row)] = np.argsort(before.row)
        # only a suffix that shares its gram with a neighbour can share a window
        paired = np.append(False, right >= 0) | np.append(right >= 0, False)
        far, near = self.far[after.row], self.near[after.row]
        for d in range(self.hits.shape[1]):
            own = np.flatnonzero(paired & (near <= d) & (d <= far))
            if len(own) < 2:
                continue
            run = np.concatenate([[0], np.cumsum(right < LENGTH - GRAM - d)])
            back = np.concatenate([[0], np.cumsum(left < d)])
            key = run[own] * n + back[place[own]]
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            hit = own[order[np.append(same, False) | np.append(False, same)]]
            self.hits[after.row[hit], d] = True


def hit_intervals(hits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of hits of each row."""
    padded = np.zeros((len(hits), hits.shape[1] + 2), np.int8)
    padded[:, 1:-1] = hits
    edge = np.diff(padded, axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, at[row] - (last - 1), at[row] - first + LENGTH


def surroundings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """gram, text, size, at, far, near, bytes (before and after the gram) of the asked anchors."""
    per_text = asked.groupBy("text", "size").agg(F.collect_list(F.struct("a", "b", "c", "gram")).alias("asked"))
    joined = docs.join(per_text.withColumnRenamed("text", "key"), ["key", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names = ["gram", "text", "size", "at", "far", "near", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in names)
            data, offsets = text_arrays(batch.column("text"))
            raw = memoryview(data)
            for k, (key, size) in enumerate(zip(batch.column("key").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                if (key, size) in seen:
                    continue
                seen.add((key, size))
                for x in batch.column("asked")[k].as_py():
                    at = int(offsets[k]) + x["a"]
                    row = (x["gram"], key, size, x["a"], x["b"], x["c"], bytes(raw[at - x["b"] : at]) + bytes(raw[at + GRAM : at - x["c"] + LENGTH]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return joined.select("key", "size", "text", "asked").mapInArrow(run, "gram long, text long, size int, at int, far int, near int, bytes binary")


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """gram, after, before (reversed), far, near of a batch of surroundings."""
    far, near = batch.column("far").to_numpy().astype(np.int64), batch.column("near").to_numpy().astype(np.int64)
    n, most = len(far), LENGTH - GRAM
    flat = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8)
    size = far + most - near
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    step = np.arange(most)
    before, after = np.zeros((n, most), np.uint8), np.zeros((n, most), np.uint8)
    has = step < far[:, None]
    before[has] = flat[(begin[:, None] + far[:, None] - 1 - step)[has]]
    has = step < (most - near)[:, None]
    after[has] = flat[(begin[:, None] + far[:, None] + step)[has]]
    return batch.column("gram").to_numpy().view(np.uint64), after, before, far, near


def family_intervals(spans: DataFrame, parts: int) -> DataFrame:
    """The repeated intervals that the suffix families of the grams' partitions find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, texts, sizes, places = SuffixFamily(), [], [], []
        waiting: list[pa.RecordBatch] = []

        def index() -> None:
            batch = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting.clear()
            family.add(*unpack(batch))
            for kept, name in ((texts, "text"), (sizes, "size"), (places, "at")):
                kept.append(batch.column(name).to_numpy().astype(np.int64))

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BATCH:
                index()
        if waiting:
            index()
        if texts:
            text, size, at = (np.concatenate(x) for x in (texts, sizes, places))
            row, start, end = hit_intervals(family.hits, at)
            yield found_rows(INTERVAL, *merged(text[row], size[row], start, end))

    return spans.repartition(parts, "gram").mapInArrow(run, _FOUND)


def window_intervals(spans: DataFrame) -> DataFrame:
    """The repeated windows of grams with very many surroundings: counted by a hash of the whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                gram, after, before, far, near = unpack(part)
                text, size, at = (part.column(c).to_numpy().astype(np.int64) for c in ("text", "size", "at"))
                right = [np.zeros(len(gram), np.uint64)]
                for c in range(after.shape[1]):
                    right.append(right[-1] * _K + _TABLE[after[:, c]])
                left, out = np.zeros(len(gram), np.uint64), []
                for d in range(LENGTH - GRAM + 1):
                    own = np.flatnonzero((near <= d) & (d <= far))
                    h = mixed(mixed(gram[own] + np.uint64(d)) + mixed(left[own]) * _K + right[LENGTH - GRAM - d][own])
                    out.append((h.view(np.int64), text[own], size[own], at[own] - d))
                    if d < before.shape[1]:
                        left = left * _K + _TABLE[before[:, d]]
                yield pa.record_batch([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], ["window", "text", "size", "start"])

    rows = spans.mapInArrow(run, "window long, text long, size long, start long")
    # a window's first place and its number need one row a task; the rows are then joined to the repeated windows
    again = rows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    hit = rows.join(again, "window", "left_semi")
    return hit.select(F.lit(INTERVAL).alias("kind"), "text", F.col("size").cast("int").alias("size"), F.col("start").cast("int").alias("a"), (F.col("start") + LENGTH).cast("int").alias("b"))


def repeated_intervals(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """text, size, spans: the intervals (a, b) of the distinct texts (by hash and size) that lie in repeated windows; a
    table in the shared folder."""
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = written(packed_anchors(docs), "anchors")
    number = packed.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle, number * ANCHOR.itemsize // BUCKET_BYTES + 1)
    high = high_counters(packed, number, hot)
    found = written(compare_anchors(dealt(packed, buckets, high), buckets), "compared")
    drop_written(packed)
    number = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = found.where(F.col("kind") == INTERVAL).select("text", "size", "a", "b")
    windows = None
    if number.get(DETAIL):
        spans = surroundings(docs, found.where(F.col("kind") == DETAIL))
        out = out.unionByName(family_intervals(spans, max(shuffle, number[DETAIL] // PARTITION + 1)).select("text", "size", "a", "b"))
    if number.get(BY_WINDOW):
        windows = written(surroundings(docs, found.where(F.col("kind") == BY_WINDOW)), "windows")
        out = out.unionByName(window_intervals(windows).select("text", "size", "a", "b"))
    out = written(out.groupBy("text", "size").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "intervals")
    drop_written(found, windows)
    return out


def with_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"text": text, "key": F.xxhash64(text), "size": F.octet_length(text)})


def union_spans(asked: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted((x["a"], x["b"]) for x in asked or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append([x[0], x[1]])
    return [(a, b) for a, b in out]


def span_table(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """key, size, spans of the texts of ``docs`` (text, key, size) that lose bytes; spans: intervals (a, b)."""
    spans = repeated_intervals(docs, HOT if hot is None else hot)
    copies = docs.groupBy("key", "size").agg(F.count(F.lit(1)).alias("copies")).where((F.col("copies") > 1) & (F.col("size") >= LENGTH))
    whole = copies.select(F.col("key").alias("text"), "size", F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b"))).alias("spans"))
    both = spans.unionByName(whole).groupBy("text", "size").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return both.withColumnRenamed("text", "key")


def remove_repeats(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column("text"))
            raw = data.tobytes()
            for i, j in row_blocks(offsets):
                removed, number, kept = [], [], []
                for k in range(i, j):
                    spans = union_spans(batch.column("spans")[k].as_py())
                    own = raw[offsets[k] : offsets[k + 1]]
                    edges = [0, *(x for s in spans for x in s), len(own)]
                    kept.append(b"".join(own[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    removed.append(len(own) - len(kept[-1]))
                    number.append(len(spans))
                yield pa.record_batch(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    keyed = with_keys(id_text(docs))
    rows = keyed.join(span_table(keyed, hot), ["key", "size"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with repeated passages cut out of text (and n_chars, if there, counted anew).

    A character that a cut would split goes with the passage, so the text stays valid.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = with_keys(docs.select("text"))
    # the rows travel as one struct, so their names can't clash with ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text).alias("key"), F.octet_length(text).alias("size"))
    rows = rows.join(span_table(keyed), ["key", "size"], "left").select("row", "spans")
    place, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            _, offsets = text_arrays(columns[place])
            for i, j in row_blocks(offsets):
                part = [c.slice(i, j - i) for c in columns]
                asked = batch.column("spans").slice(i, j - i)
                if asked.null_count < len(asked):
                    part[place] = pa.array([cut(t, x) if x else t for t, x in zip(part[place].to_pylist(), asked.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(part, names=names)

    def cut(text: str, asked: list[dict]) -> str:
        raw, at, kept = text.encode(), 0, []
        for a, b in union_spans(asked):
            while a > 0 and raw[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b += 1
            kept.append(raw[at:a])
            at = max(at, b)
        return (b"".join(kept) + raw[at:]).decode()

    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_suffix_family_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
