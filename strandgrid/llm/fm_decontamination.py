"""Benchmark decontamination with one FM-index per shard of training text.

A shard is a run of whole documents.  Its words become symbols: benchmark words have numbers from 2, 1 stands for
every other word and ends each stretch, and one 0 ends the shard.  A stretch without as many benchmark words in a row as
the shortest window has can't hold a window and is left out of the index; nothing else is.  The suffix array (prefix
doubling), the Burrows-Wheeler transform in a wavelet tree, and every SAMPLE-th suffix position make the index.  All
windows of the benchmark are searched backward; their rows are walked to a sampled position; the hits of a document are
merged to spans.  A long stretch is indexed in parts that overlap by a window less a word.

The benchmark is dealt by a hash of its distinct rows into passes of about PASS_BYTES of text; the driver and the
workers hold the tables of one pass at a time (arrays of some four times its text).  All passes search the texts as they
are; what the passes but one find is written, by text, and merged with what the last finds.  So the number of passes
changes no result.  Words are told apart by 64-bit hashes.

Defined cases: null or word-free documents have no words and no hits; null or word-free items have no windows; rows
that repeat an item_id count as one item, and rows without one mark hits but count as none; rows that repeat a text or a
doc_id give a row each; an empty table of documents gives no rows, an empty benchmark hits nothing; texts of any length
are whole, their words are numbered in slices of SLICE bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgrid.llm._common import drop_written, id_text, powers, row_blocks, table, text_arrays, written

WINDOW = 8
CONTAMINATED = 2
SAMPLE = 4
#: Bytes of benchmark text that one pass over the documents searches for, on average.
PASS_BYTES = 8 << 20
#: Bytes of a text whose words are numbered at once, symbols of an index, and windows searched at once.
SLICE, INDEX, TOGETHER = 1 << 20, 1 << 18, 1 << 16

#: Lower-cases A-Z, keeps digits, letters and every byte of other characters, and turns all else into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BYTES = np.frombuffer(WORD_BYTES, np.uint8)
_K = 0x9E3779B97F4A7C15
_INVERSE = pow(_K, -1, 2**64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TABLE = np.random.default_rng(23).integers(1, 2**63, 256, np.int64).astype(np.uint64)


def word_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each word of some texts begins and ends in their bytes (k x 2); no word goes over a text's edge."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _BYTES[data] != 32
    edge = np.diff(inside)
    begin, end = edge == 1, edge == -1
    cut = offsets[1:-1]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    begin[cut] = end[cut] = True
    return np.stack([np.flatnonzero(begin), np.flatnonzero(end)], 1)


def word_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64 bits of each word: the sum of its bytes' numbers times the powers of a multiplier, from its first byte on."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[_BYTES[data]] * powers(_K, n), dtype=np.uint64, out=total[1:])
    h = (total[places[:, 1]] - total[places[:, 0]]) * powers(_INVERSE, n)[places[:, 0]]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def sliced(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first, after the last, begin, end) of runs of texts of about SLICE bytes, and slices of longer texts."""
    for i, j in row_blocks(offsets, SLICE):
        at, end = int(offsets[i]), int(offsets[j])
        while end - at > SLICE:
            blank = np.flatnonzero(_BYTES[data[at + SLICE : min(end, at + 2 * SLICE)]] == 32)
            if not len(blank):
                break
            cut = at + SLICE + int(blank[0])
            yield i, j, at, cut
            at = cut
        yield i, j, at, end


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.empty(n, bool)
    head[:1], head[1:] = True, symbols[order[1:]] != symbols[order[:-1]]
    group = np.flatnonzero(head)[np.cumsum(head) - 1]
    rank[order] = group
    step = 1
    while True:
        tied = ~(head & np.append(head[1:], True))
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        pos = order[at]
        nxt = pos + step
        key = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        again = np.lexsort((key, group[at]))
        order[at], key = pos[again], key[again]
        g = group[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        head[at] = fresh
        group[at] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        rank[order[at]] = group[at]
        step *= 2


class WaveletTree:
    """Ranks over integers below 2**bits: a bit row and its running count for every level, stable-partitioned by bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        at = values
        for level in range(bits - 1, -1, -1):
            bit = at >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(int(len(at) - bit.sum()))
            at = np.concatenate([at[bit == 0], at[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start, end = np.zeros_like(end), end
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            up = (symbol >> level & 1).astype(bool)
            start = np.where(up, zeros + ones[start], start - ones[start])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE):
        order = suffix_array(symbols)
        self.n = len(symbols)
        before = symbols[order - 1]  # the last symbol, which must be the only 0, precedes the suffix at 0
        self.tree = WaveletTree(before, max(1, int(alphabet - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        sampled = order % sample == 0
        self.sampled = sampled
        self.sample_at = np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, symbol: Callable[[np.ndarray, int], np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns by backward search; ``symbol``: of some patterns, so many places before their last
        one (-1: not in the text)."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        for k in range(int(lengths.max()) if len(lengths) else 0):
            live = np.flatnonzero((lengths > k) & (hi > lo))
            if not len(live):
                break
            c = symbol(live, k)
            hi[live[c < 0]] = 0
            live, c = live[c >= 0], c[c >= 0]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step back through the text to a sampled suffix."""
        out, steps, todo = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.sampled[rows[todo]]
            hit = todo[done]
            out[hit] = self.positions[self.sample_at[rows[hit]]] + steps[hit]
            todo = todo[~done]
            c = self.tree.symbol(rows[todo])
            rows[todo] = self.first[c] + self.tree.rank(c, rows[todo])
            steps[todo] += 1
        return out % self.n


class Phrases:
    """The distinct windows of a set of items, as arrays: their words' numbers, and the items that hold each window."""

    def __init__(self, items: list[tuple[int | None, bytes]] | pa.Table, window: int = WINDOW):
        if isinstance(items, pa.Table):
            keys, texts = items.column(0).combine_chunks(), items.column(1)
        else:
            keys, texts = pa.array([i for i, _ in items], pa.int64()), pa.array([t.decode("utf-8", "surrogatepass") for _, t in items], pa.string())
        data, offsets = text_arrays(texts)
        counts, hashes = np.zeros(len(offsets) - 1, np.int64), [np.zeros(0, np.uint64)]
        for i, j, at, end in sliced(data, offsets):
            edges = np.clip(offsets[i : j + 1], at, end) - at
            places = word_places(data[at:end], edges)
            hashes.append(word_hashes(data[at:end], places))
            counts[i:j] += np.diff(np.searchsorted(places[:, 0], edges))
        #: sorted hashes of the words; a word's number is its place here, and 2 more
        self.vocabulary, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
        self.words = (numbers + 2).astype(np.int32)
        first = np.cumsum(counts) - counts
        full, short = counts >= window, (counts > 0) & (counts < window)
        per = np.where(full, counts - window + 1, short)
        item = np.repeat(np.arange(len(counts)), per)
        start = first[item] + np.arange(len(item)) - (np.cumsum(per) - per)[item]
        number = self._numbered(start, item, first, counts, full, window)
        many = int(number.max()) + 1 if len(number) else 0
        self.starts, self.lengths = np.zeros(many, np.int32), np.zeros(many, np.uint8 if window < 256 else np.int32)
        self.starts[number], self.lengths[number] = start, np.minimum(counts[item], window)
        self.shortest = int(self.lengths.min()) if many else 0
        self.window = window
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        self.items, place = np.unique(keys.fill_null(0).to_numpy(zero_copy_only=False)[known], return_inverse=True)
        of_row = np.full(len(counts), -1)
        of_row[known] = place
        held = of_row[item] >= 0
        pairs = np.unique(number[held] * max(1, len(self.items)) + of_row[item[held]])
        #: items of window w: holders[bounds[w] : bounds[w + 1]]
        self.holders = (pairs % max(1, len(self.items))).astype(np.int32)
        self.bounds = np.searchsorted(pairs, np.arange(many + 1) * max(1, len(self.items))).astype(np.int32)

    def _numbered(self, start, item, first, counts, full, window: int) -> np.ndarray:
        """Equal numbers for equal windows: whole windows by doubling, those of shorter items by their words."""
        out = np.zeros(len(start), np.int64)
        whole = full[item]
        most = 0
        if whole.any():
            rank, span = self.words.astype(np.int64), 1
            while span < window:
                step = min(span, window - span)
                pair = rank[: len(rank) - step] * (len(self.words) + 2) + rank[step:]
                rank, span = np.unique(pair, return_inverse=True)[1], span + step
            _, out[whole] = np.unique(rank[start[whole]], return_inverse=True)
            most = int(out[whole].max()) + 1
        if (~whole).any():
            rows = np.flatnonzero(~whole)
            grid = np.zeros((len(rows), window), np.int32)
            size = counts[item[rows]]
            has = np.arange(window) < size[:, None]
            grid[has] = self.words[(start[rows][:, None] + np.arange(window))[has]]
            out[rows] = most + np.unique(grid, axis=0, return_inverse=True)[1].ravel()
        return out

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words, 1 for those that the benchmark lacks."""
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1).astype(np.int32)

    def found(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all occurrences in a shard's symbols, by its FM-index."""
        alphabet, local = np.unique(symbols, return_inverse=True)
        index = FMIndex(local.astype(np.int64), len(alphabet))
        here = np.full(len(self.vocabulary) + 2, -1, np.int64)
        here[alphabet] = np.arange(len(alphabet))
        # a window of which the shard lacks a word needs no search
        lacking = np.concatenate([[0], np.cumsum(here[self.words] < 0)])
        able = np.flatnonzero(lacking[self.starts + self.lengths.astype(np.int64)] == lacking[self.starts])
        places, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(able), TOGETHER):
            asked = able[k : k + TOGETHER]
            start, length = self.starts[asked].astype(np.int64), self.lengths[asked].astype(np.int64)
            lo, hi = index.search(lambda live, back, a=start, n=length: here[self.words[a[live] + n[live] - 1 - back]], length)  # noqa: B023
            own = np.flatnonzero(hi > lo)
            many = hi[own] - lo[own]
            which = np.repeat(own, many)
            rows = np.repeat(lo[own], many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            places.append(index.locate(rows))
            windows.append(asked[which])
        return np.concatenate(places), np.concatenate(windows)


@dataclass(frozen=True)
class Hits:
    """What some texts hold: number of words; spans of hit words (first, after the last) and items, each with the text
    that it belongs to, in the order of texts."""

    counts: np.ndarray
    span_text: np.ndarray
    first: np.ndarray
    after: np.ndarray
    item_text: np.ndarray
    items: np.ndarray

    def lists(self) -> tuple[pa.Array, pa.Array]:
        n = len(self.counts)
        cut = lambda x: pa.array(np.searchsorted(x, np.arange(n + 1)).astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(self.first), pa.array(self.after)], ["first", "after"])
        return pa.ListArray.from_arrays(cut(self.span_text), pairs), pa.ListArray.from_arrays(cut(self.item_text), pa.array(self.items))


def document_hits(phrases: Phrases, data: np.ndarray, offsets: np.ndarray) -> Hits:
    """The hits of some texts, by the FM-indexes of their stretches of benchmark words."""
    counts, parts = np.zeros(len(offsets) - 1, np.int64), [np.zeros(0, np.int32)]
    for i, j, at, end in sliced(data, offsets):
        edges = np.clip(offsets[i : j + 1], at, end) - at
        places = word_places(data[at:end], edges)
        parts.append(phrases.numbers(word_hashes(data[at:end], places)))
        counts[i:j] += np.diff(np.searchsorted(places[:, 0], edges))
    ids = np.concatenate(parts)
    first_word = np.cumsum(counts) - counts
    none = np.zeros(0, np.int64)
    if not len(phrases.starts) or not len(ids):
        return Hits(counts, none, none, none, none, none)
    known = np.concatenate([[False], ids > 1, [False]])
    begin, end = known[1:-1] & ~known[:-2], known[1:-1] & ~known[2:]
    edge = first_word[1:][(first_word[1:] > 0) & (first_word[1:] < len(ids))]
    begin[edge] |= known[1:-1][edge]
    end[edge - 1] |= known[1:-1][edge - 1]
    begin, size = np.flatnonzero(begin), np.flatnonzero(end) + 1 - np.flatnonzero(begin)
    begin, size = begin[size >= phrases.shortest], size[size >= phrases.shortest]
    # a long stretch in parts that overlap by a window less a word
    overlap = phrases.window - 1
    step = INDEX - overlap
    more = np.maximum(-(-(size - overlap) // step), 1)
    owner = np.repeat(np.arange(len(size)), more)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)
    begin = begin[owner] + nth * step
    size = np.minimum(size[owner] - nth * step, INDEX)
    places, windows = [none], [none]
    shard = np.cumsum(size + 1) // INDEX
    for k in np.unique(shard).tolist():
        own = shard == k
        a, n = begin[own], size[own]
        starts = np.cumsum(n + 1) - n - 1
        symbols = np.ones(int(n.sum()) + len(n) + 1, np.int32)
        symbols[-1] = 0
        where = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        symbols[where] = ids[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        at, which = phrases.found(symbols)
        stretch = np.searchsorted(starts, at, "right") - 1
        places.append(a[stretch] + at - starts[stretch])
        windows.append(which)
    first, which = np.concatenate(places), np.concatenate(windows)
    if not len(first):
        return Hits(counts, none, none, none, none, none)
    order = np.argsort(first, kind="stable")
    first, which = first[order], which[order]
    text = np.searchsorted(first_word, first, "right") - 1
    reach = np.maximum.accumulate(first + phrases.lengths[which])  # a hit ends in its own text, so texts don't mix
    new = np.append(True, (first[1:] > reach[:-1]) | (text[1:] != text[:-1]))
    last = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
    pairs = np.unique(text * len(phrases.starts) + which)
    owner, which = pairs // len(phrases.starts), pairs % len(phrases.starts)
    held = phrases.bounds[which + 1].astype(np.int64) - phrases.bounds[which]
    at = np.repeat(phrases.bounds[which] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
    found = np.unique(np.repeat(owner, held) * max(1, len(phrases.items)) + phrases.holders[at])
    span_text = text[new]
    base = first_word[span_text]
    return Hits(counts, span_text, first[new] - base, last - base, found // max(1, len(phrases.items)), phrases.items[found % max(1, len(phrases.items))] if len(found) else none)


_SPANS = "array<struct<first:bigint,after:bigint>>"
_FOUND = f"spans {_SPANS}, item_ids array<bigint>"


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_earlier(now: tuple[pa.Array, pa.Array], old: tuple[pa.Array, pa.Array]) -> tuple[pa.Array, pa.Array]:
    """Spans and items of each text together with those of other passes (null: none)."""
    if old[0].null_count == len(old[0]):
        return now
    pairs = lambda x: [(s["first"], s["after"]) for s in x or ()]
    spans = [merge_spans(pairs(a) + pairs(b)) for a, b in zip(now[0].to_pylist(), old[0].to_pylist(), strict=True)]
    items = [sorted({*a, *(b or ())}) for a, b in zip(now[1].to_pylist(), old[1].to_pylist(), strict=True)]
    return pa.array([[{"first": a, "after": b} for a, b in s] for s in spans], now[0].type), pa.array(items, now[1].type)


def benchmark_passes(benchmark: DataFrame, key: str = "item_id", most: int | None = None) -> tuple[DataFrame, int]:
    """(item_id, text, pass) of the distinct rows of the benchmark, and the number of passes: each of about ``most``
    bytes, dealt by hash."""
    rows = id_text(benchmark, key).select(F.col("doc_id").alias("item_id"), "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    passes = max(1, -(-size // (PASS_BYTES if most is None else most)))
    return rows.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))), passes


def phrases_of(rows: DataFrame, k: int, window: int) -> Phrases:
    """The windows of one pass; only its rows come to the driver."""
    return Phrases(rows.where(F.col("pass") == k).select("item_id", "text").toArrow(), window)


def other_passes(docs: DataFrame, rows: DataFrame, passes: int, window: int) -> DataFrame | None:
    """key, size, spans, item_ids of the texts (by hash and size) in which the passes from 1 on find anything.  Each is
    a job of its own, whose tables go when it is done."""
    texts = docs.select(F.xxhash64("text").alias("key"), F.octet_length("text").alias("size"), "text")
    found = None
    for k in range(1, passes):
        held = docs.sparkSession.sparkContext.broadcast(phrases_of(rows, k, window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_arrays(batch.column("text"))
                for i, j in row_blocks(offsets):
                    spans, items = document_hits(held.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).lists()
                    own = batch.select(["key", "size"]).slice(i, j - i)
                    out = pa.record_batch([*own.columns, spans, items], ["key", "size", "spans", "item_ids"])
                    yield out.filter(pa.array(np.diff(spans.offsets.to_numpy()) > 0))

        made = written(texts.mapInArrow(run, f"key long, size int, {_FOUND}").dropDuplicates(["key", "size"]), "leaks")
        held.destroy()
        found = made if found is None else found.unionByName(made)
    if found is None:
        return None
    merged = found.groupBy("key", "size").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
    out = written(merged, "leaks")  # a row for each text and pass at most is collected
    drop_written(found)
    return out


def with_other_passes(docs: DataFrame, found: DataFrame | None) -> DataFrame:
    """row (a struct of the columns of ``docs``, so their names can't clash with ours), and the spans and item_ids that
    ``found`` has for the row's text."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("key"), F.octet_length("text").alias("size"))
    if found is None:
        return rows.select("row", F.lit(None).cast(_SPANS).alias("spans"), F.lit(None).cast("array<bigint>").alias("item_ids"))
    return rows.join(found, ["key", "size"], "left").select("row", "spans", "item_ids")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans of hit words, item_ids of every row of ``docs`` (doc_id, text)."""
    rows, passes = benchmark_passes(benchmark)
    docs = id_text(docs)
    found = other_passes(docs, rows, passes, window)
    held = docs.sparkSession.sparkContext.broadcast(phrases_of(rows, 0, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("row").flatten()
            data, offsets = text_arrays(texts)
            for i, j in row_blocks(offsets):
                hits = document_hits(held.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = batch.slice(i, j - i)
                spans, items = with_earlier(hits.lists(), (own.column("spans"), own.column("item_ids")))
                yield pa.record_batch([ids.slice(i, j - i), pa.array(hits.counts), spans, items], ["doc_id", "n_words", "spans", "item_ids"])

    return with_other_passes(docs, found).mapInArrow(run, f"doc_id long, n_words long, {_FOUND}")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = CONTAMINATED) -> DataFrame:
    """The rows and columns of ``docs`` without its contaminated rows (windows of ``limit`` items or more) and, in the
    others, without the words of benchmark windows (n_chars, if there, counted anew).  Clean rows stay as they are."""
    rows, passes = benchmark_passes(benchmark)
    found = other_passes(id_text(docs), rows, passes, window)
    held = docs.sparkSession.sparkContext.broadcast(phrases_of(rows, 0, window))
    names, place = docs.columns, docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(batch.column("row").flatten(), names)
            data, offsets = text_arrays(rows.column(place))
            for i, j in row_blocks(offsets):
                part, own = rows.slice(i, j - i), batch.slice(i, j - i)
                hits = document_hits(held.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                spans, items = with_earlier(hits.lists(), (own.column("spans"), own.column("item_ids")))
                hit = np.flatnonzero(np.diff(spans.offsets.to_numpy()))
                if len(hit):
                    part = cut_rows(part, place, count, hit.tolist(), spans)
                yield part.filter(pa.array(np.diff(items.offsets.to_numpy()) < limit))

    return with_other_passes(docs, found).mapInArrow(run, docs.schema)


def cut_rows(part: pa.RecordBatch, place: int, count: int | None, hit: list[int], spans: pa.Array) -> pa.RecordBatch:
    """Rows of which those of ``hit`` lose the words of their spans."""
    texts = part.column(place).to_pylist()
    sizes = part.column(count).to_pylist() if count is not None else None
    for k in hit:
        raw = texts[k].encode()
        places = word_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        at, kept = 0, []
        for s in spans[k].as_py():
            kept.append(raw[at : places[s["first"], 0]])
            at = int(places[s["after"] - 1, 1])
        texts[k] = (b"".join(kept) + raw[at:]).decode()
        if sizes is not None:
            sizes[k] = len(texts[k])
    part = part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))
    if sizes is not None:
        part = part.set_column(count, part.schema.field(count), pa.array(sizes, part.schema.field(count).type))
    return part


def digests(leaks: DataFrame) -> DataFrame:
    names = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))))
    return leaks.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"]).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("item_ids") >= CONTAMINATED).alias("contaminated"),
    )


def op3_fm_index_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
