"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax output.

Features of a text: its words, its adjacent word pairs and the character 3- to 5-grams of its words, each word put
between a begin and an end mark; each feature is hashed to one of BUCKETS learned vectors.  Characters are code points,
words are what stands between blanks.  Training is plain stochastic gradient descent in numpy on a bounded sample of the
labelled rows (at most TRAIN_ROWS rows, those with the smallest hash of doc_id, and of their texts in that order as many
as fit TRAIN_BYTES); everything else, the scores included, covers whole texts.  The output is linear in the average, so a
trained model folds to one number a bucket, and a score is a mean of numbers.

Defined cases: null, empty and blank texts have no features and get the score of the bias alone; label rows with a
null id or label are not learned from; several labels of one id count each, and all with the same one of the id's texts
(that of the smallest hash); texts of any length are whole, read in slices of words; rows that repeat a text or an id
give a row each, with the same score for the same text; without both labels in the sample every score is the share of
label 1 (0.5 without labels); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgrid.llm._common import drop_written, id_text, powers, row_blocks, table, text_arrays, written

#: Bounds of the sample that is learned from: label rows, and bytes of text.
TRAIN_ROWS, TRAIN_BYTES = 3000, 64 << 20
BUCKETS_LOG2 = 18
DIM, EPOCHS, RATE, SEED = 8, 6, 0.5, 7
#: Small samples are gone through more often, to as many steps.
LEAST_STEPS = 6000
GRAMS = (3, 4, 5)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
#: Bytes of text whose features are made at once.
STEP_BYTES = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0x100000001B3)
_INVERSE = pow(int(_MULTIPLIER), -1, 2**64)
_BLANKS = b" \t\n\v\f\r"
_BLANK = np.zeros(256, bool)
_BLANK[list(_BLANKS)] = True
#: Symbols before and after a word; a character is its code point plus SYMBOL.
BEGIN, END, SYMBOL = 1, 2, 3


def bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Fibonacci hashing of 64 bits to a bucket, salted by the feature's kind."""
    h = (h ^ (h >> np.uint64(29))) * _MIX + np.uint64(kind * 0x632BE59BD9B4E019 & (2**64 - 1))
    return ((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, documents) of one kind of feature after the other; documents are in order within a kind."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    if not n:
        return
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.searchsorted(lead, offsets)  # each document's first character
    letter = ~_BLANK[np.minimum(points, 255)] | (points > 255)
    edge = np.ones(n + 1, bool)
    edge[1:n] = letter[1:] != letter[:-1]
    edge[first] = True
    at = np.flatnonzero(edge)
    word = letter[at[:-1]]
    start, size = at[:-1][word], np.diff(at)[word]
    if not len(start):
        return
    doc = np.searchsorted(first, start, "right") - 1
    owner = np.repeat(np.arange(len(start)), size + 2)
    symbols = np.full(len(owner), BEGIN, np.uint64)
    ends = np.cumsum(size + 2)
    symbols[ends - 1] = END
    own = np.repeat(np.arange(len(start)), size)
    symbols[np.arange(len(own)) + 2 * own + 1] = points[letter].astype(np.uint64) + np.uint64(SYMBOL)
    # a word's hash: the sum of its symbols times the powers of the multiplier, from its first symbol on
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(int(_MULTIPLIER), len(symbols)), dtype=np.uint64, out=total[1:])
    begins = ends - size - 2
    h = (total[ends] - total[begins]) * powers(_INVERSE, len(symbols))[begins]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    yield bucket(h, 1), doc
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    # the difference of the hashes: a repeated word is one feature whatever the word
    yield bucket(h[pair + 1] - h[pair], 2), doc[pair]
    for k in GRAMS:
        m = len(symbols) - k + 1
        if m < 1:
            continue
        h = symbols[:m].copy()
        for i in range(1, k):
            h = h * _MULTIPLIER + symbols[i : m + i]
        inside = owner[k - 1 :] == owner[:m]
        yield bucket(h[inside], k), doc[owner[:m][inside]]


def slices(text: bytes, most: int) -> list[bytes]:
    """A long text in slices of words; each begins with the last word of the one before."""
    out, at = [], 0
    while len(text) - at > most:
        end = max(text.rfind(bytes([b]), at, at + most) for b in _BLANKS)
        last = text[at:end].rstrip(_BLANKS) if end > at else b""
        word = at + max(last.rfind(bytes([b])) for b in _BLANKS) + 1
        if word <= at:  # no two words in so many bytes
            break
        out.append(text[at:end])
        at = word
    return [*out, text[at:]]


@dataclass(frozen=True)
class Model:
    """One number a bucket, already the difference of the two classes' outputs, and a bias."""

    weight: np.ndarray
    bias: float

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the features' numbers and their count, for each text."""
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n, np.int64)
        for ids, doc in features(data, offsets):
            total += np.bincount(doc, self.weight[ids], n)
            count += np.bincount(doc, minlength=n)
        return total, count

    def long_sums(self, text: bytes, most: int) -> tuple[float, int]:
        """The same of one long text: the sums of its slices, less those of the words that stand in two slices."""
        total, count = 0.0, 0
        parts = slices(text, most)
        for k, part in enumerate(parts):
            shared = part.split(None, 1)[0] if k else b""
            for sign, x in ((1, part), (-1, shared)):
                t, n = self.sums(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
                total, count = total + sign * float(t[0]), count + sign * int(n[0])
        return total, count

    def score(self, data: np.ndarray, offsets: np.ndarray, most: int = STEP_BYTES) -> np.ndarray:
        if len(offsets) == 2 and len(data) > most:
            total, count = (np.array([x]) for x in self.long_sums(data.tobytes(), most))
        else:
            total, count = self.sums(data, offsets)
        z = self.bias + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(texts: list[str], labels: list[int]) -> Model:
    """Vectors and output weights by stochastic gradient descent on the softmax loss, one document at a time."""
    y = np.array(labels, np.int64)
    buckets = 1 << BUCKETS_LOG2
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(buckets, np.float32), float(np.log(p / (1 - p))))
    rows = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        ids = [x for x, _ in features(raw, np.array([0, len(raw)]))]
        ids, many = np.unique(np.concatenate(ids), return_counts=True) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rows.append((ids, (many / max(1, many.sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (buckets, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    # both classes weigh the same in the loss
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(y)))
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, part = rows[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            hidden = part @ vectors[ids]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            error = (p * weight[i]).astype(np.float32)
            back = output @ error
            output -= rate * np.outer(hidden, error)
            bias -= rate * error
            if len(ids):
                # a bucket's share of a text is tiny: scaled by its inverse root, rare and common features both learn
                vectors[ids] -= rate * np.sqrt(part)[:, None] * back
    return Model(vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Learn from at most ``most`` labelled rows outside the held-out fold, whose texts have ``most_bytes`` at most; the
    same rows whatever the partitions."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)  # bounded: may be broadcast
    chosen = chosen.groupBy("doc_id").agg(F.collect_list("quality").alias("qualities"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")  # of the rows of an id
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one, F.first("qualities").alias("qualities"))
    rows = written(rows.select("doc_id", "one.text", "qualities", F.coalesce(F.octet_length("one.text"), F.lit(0)).alias("size")), "labelled")
    sizes = sorted((zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["size"]) for r in rows.select("doc_id", "size").collect())
    room, held = most_bytes, []
    for _, key, size in sizes:
        if size <= room:
            held.append(key)
            room -= size
    sample = rows.where(F.col("doc_id").isin(held)).select("doc_id", "text", F.explode("qualities").alias("quality")).toPandas()
    drop_written(rows)
    sample["order"] = [zlib.crc32(str(d).encode()) for d in sample["doc_id"]]
    sample = sample.sort_values(["order", "doc_id", "quality"])
    return train(sample["text"].tolist(), sample["quality"].tolist())


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """doc_id, score, predicted of every row; with ``keep``, the rows themselves whose prediction is 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            data, offsets = text_arrays(batch.column("text"))
            parts = [own.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in row_blocks(offsets, STEP_BYTES)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            if keep:
                yield batch.filter(pa.array(score >= threshold))
            else:
                yield pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    return id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` that a model of their own labels doesn't reject."""
    return scores(docs, fit(docs, labels), keep=True)


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
