"""Operators 3, 5, 9, 10 and the pipeline against plain models."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from support import documents, leaks, link_components, odd_texts, repeats, saved, sha, shingles

import corpus_pipeline
from strandgrid.llm import fm_decontamination, quality_classifier, signature_join, suffix_dedup
from strandgrid.llm._common import BATCH_BYTES, powers, row_blocks, small_batches, text_arrays
from strandgrid.llm._graph import components, id_filter
from strandgrid.llm.entries import QUERIES


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


# 3


@pytest.mark.parametrize("size,index,together", [(None, None, None), (16, 20, 3)])
def test_fm_index_against_plain_search(monkeypatch, size, index, together):
    """Also with texts in slices, stretches in parts and windows in groups."""
    if size:
        for name, value in (("SLICE", size), ("INDEX", index), ("TOGETHER", together)):
            monkeypatch.setattr(fm_decontamination, name, value)
    rng = random.Random(1)
    for _ in range(40):
        alphabet = ["a", "b", "B", "é", "c1"][: rng.randint(1, 5)]
        text = lambda n: "".join(rng.choice(alphabet) + rng.choice([" ", ". ", "  "]) for _ in range(n))  # noqa: B023, E731
        items = [(i, text(rng.randint(0, 14))) for i in range(6)] + [(2, text(9)), (None, text(8)), (7, None)]
        docs = [text(rng.randint(0, 60)) for _ in range(10)] + [None, ""]
        phrases = fm_decontamination.Phrases([(i, (t or "").encode()) for i, t in items])
        data, offsets = text_arrays(pa.array(docs, pa.string()))
        hits = fm_decontamination.document_hits(phrases, data, offsets)
        spans, found = hits.lists()
        got = [(n, sum(x["after"] - x["first"] for x in s), tuple(f)) for n, s, f in zip(hits.counts.tolist(), spans.to_pylist(), found.to_pylist(), strict=True)]
        assert got == leaks(items, docs)


def test_wavelet_tree_and_suffix_array():
    rng = np.random.default_rng(0)
    x = np.append(rng.integers(1, 9, 300), 0)
    tree = fm_decontamination.WaveletTree(x, 4)
    for s in range(9):
        for end in (0, 1, 150, 301):
            assert tree.rank(np.array([s]), np.array([end]))[0] == (x[:end] == s).sum()
    assert (tree.symbol(np.arange(301)) == x).all()
    assert fm_decontamination.suffix_array(x).tolist() == sorted(range(301), key=lambda i: x[i:].tolist())


ITEMS = [(1, "the stone river of and the naïve stone over"), (2, "one TWO three"), (3, "completely other words that never occur anywhere here at all"), (4, None), (5, ""), (12, "same same same")]


def test_leaks_query(spark, tmp_path, monkeypatch):
    texts = [*odd_texts(), "xx the Stone, river of and the naïve stone over. yy one two three", "one two", "a one two three b"]
    sf = saved(spark, tmp_path, documents=documents(spark, texts), benchmark=bench(spark, ITEMS))
    want = leaks(ITEMS, texts)
    for most in (fm_decontamination.PASS_BYTES, 60, 14):
        monkeypatch.setattr(fm_decontamination, "PASS_BYTES", most)
        got = {r["doc_id"]: r for r in QUERIES["op3_fm_index_leaks"](spark, sf).collect()}
        for k, (n, hit, items) in enumerate(want):
            r = got[k]
            names = ",".join(sorted(map(str, items)))
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"], r["items_sha256"]) == (n, hit, len(items), len(items) >= 2, sha(names.encode()))
    none = saved(spark, tmp_path / "n", documents=documents(spark, texts), benchmark=bench(spark, ITEMS).limit(0))
    assert all(r["n_hit"] == 0 for r in QUERIES["op3_fm_index_leaks"](spark, none).collect())
    twice = saved(spark, tmp_path / "t", documents=documents(spark, texts).unionByName(documents(spark, texts[::-1])), benchmark=bench(spark, ITEMS))
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"]) for r in QUERIES["op3_fm_index_leaks"](spark, twice).collect())
    assert got == Counter([(k, *w[:2]) for k, w in enumerate(want)] + [(k, *w[:2]) for k, w in enumerate(want[::-1])])
    empty = saved(spark, tmp_path / "e", documents=documents(spark, texts).limit(0), benchmark=bench(spark, ITEMS))
    assert QUERIES["op3_fm_index_leaks"](spark, empty).collect() == []


def test_memory_of_phrases():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(200)).encode()) for k in range(800)]
    phrases = fm_decontamination.Phrases(items)
    assert phrases.nbytes() <= 5 * sum(len(t) for _, t in items)


def test_leaks_are_cut(spark):
    texts = ["Clean text, stays. As it is", "yy! One, two THREE; zz", "the stone river of and the naïve stone over / one two three", None, ""]
    df = fm_decontamination.without_leaks(documents(spark, texts), bench(spark, ITEMS))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in df.collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: ("yy! ; zz", 8), 3: (None, None), 4: ("", 0)}
    assert df.columns == documents(spark, texts).columns


def test_passes_cut_as_one(spark, monkeypatch):
    items = [(1, "one two three"), (2, "three four x y z w v"), (3, "p q"), (4, "alpha beta gamma delta epsilon"), (4, "omega psi chi")]
    texts = ["i one two three j three four x y z w v k", "i one two three four x y z w v k", "p One, two three. q", "alpha beta gamma delta epsilon / omega psi chi end", "clean", None, ""]
    docs = documents(spark, texts)
    got, whole = {}, fm_decontamination.PASS_BYTES
    for limit in (2, 3):
        for most in (whole, 30, 14):
            monkeypatch.setattr(fm_decontamination, "PASS_BYTES", most)
            assert fm_decontamination.benchmark_passes(bench(spark, items))[1] == {whole: 1, 30: 3, 14: 6}[most]
            df = fm_decontamination.without_leaks(docs, bench(spark, items), limit=limit)
            assert df.schema.simpleString() == docs.schema.simpleString()
            got[limit, most] = sorted(map(tuple, df.collect()))
        assert got[limit, 30] == got[limit, 14] == got[limit, whole]
    cut = {r[0]: r[1] for r in got[2, 30]}
    assert cut == {2: "p . q", 3: " end", 4: "clean", 5: None, 6: ""}
    assert {r[0]: r[1] for r in got[3, 30]} == cut | {0: "i  j  k", 1: "i  k"}


# 5


def planted():
    rng = random.Random(3)

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            t[rng.randrange(len(t))] = rng.choice("abcdé")
        return "".join(t)

    base = ["".join(rng.choice("abcdefg é") for _ in range(rng.randint(300, 1500))) for _ in range(6)]
    texts = [edited(rng.choice(base), rng.randint(0, 6)) for _ in range(40)]
    texts += [None, "", "a" * 199, "a" * 200, "a" * 201, "a" * 1000, "ab" * 400, "ab" * 400 + "x", "z" * 200, "z" * 200, "y" * 150 + "q" * 150]
    return texts + ["".join(rng.choice(base)[a : a + rng.randint(150, 260)] for a in (rng.randint(0, 100) for _ in range(5))) for _ in range(20)]


@pytest.mark.parametrize("hot,batch,most", [(None, None, None), (2, None, None), (None, 15, None), (None, 9, 300), (3, 9, 300)])
def test_repeats(spark, monkeypatch, hot, batch, most):
    """Also with grams counted as hot, families of many levels, and long texts in slices."""
    if batch:
        monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    if most:
        monkeypatch.setattr(suffix_dedup, "SLICE", most)
        monkeypatch.setattr(suffix_dedup, "row_blocks", lambda offsets: row_blocks(offsets, 400))
    texts = planted() + odd_texts()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffix_dedup.remove_repeats(documents(spark, texts), hot).collect()}
    assert [got[k] for k in range(len(texts))] == repeats(texts)


def test_repeats_query_and_stage(spark, tmp_path):
    texts = odd_texts()
    sf = saved(spark, tmp_path, documents=documents(spark, texts))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_suffix_family_dedup"](spark, sf).collect()}
    want = repeats(texts)
    assert [got[k] for k in range(len(texts))] == want
    stage = suffix_dedup.without_repeats(documents(spark, texts))
    assert stage.columns == documents(spark, texts).columns
    for r in stage.collect():
        if want[r["doc_id"]][1] == 0:
            assert r["text"] == (texts[r["doc_id"]] or "") or r["text"] == texts[r["doc_id"]]
        else:
            assert len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1] and r["n_chars"] == len(r["text"])
    empty = saved(spark, tmp_path / "e", documents=documents(spark, texts).limit(0))
    assert QUERIES["op5_suffix_family_dedup"](spark, empty).collect() == []
    twice = saved(spark, tmp_path / "t", documents=documents(spark, texts).unionByName(documents(spark, texts[::-1])))
    rows = sorted(tuple(r) for r in QUERIES["op5_suffix_family_dedup"](spark, twice).collect())
    again = repeats(texts + texts[::-1])
    assert rows == sorted((k % len(texts), *w) for k, w in enumerate(again))


def test_levels_are_merged_runs():
    rng = np.random.default_rng(4)

    def some(n):
        gram, side = rng.integers(0, 3, n).astype(np.uint64), rng.integers(0, 2, (n, 136)).astype(np.uint8) * (rng.random((n, 1)) < 0.7)
        return gram, np.ascontiguousarray(side.astype(np.uint8))

    a, b = some(40), some(25)
    merged = suffix_dedup.Sorted.of(*a, np.arange(40)).merge(suffix_dedup.Sorted.of(*b, 40 + np.arange(25)))
    whole = suffix_dedup.Sorted.of(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.arange(65))
    assert (merged.key == whole.key).all() and sorted(merged.row) == list(range(65))
    rows = [bytes(k) for k in merged.key]
    assert rows == sorted(rows)
    for k, n in enumerate(merged.common(), 1):
        same = rows[k][:8] == rows[k - 1][:8]
        assert n == (-1 if not same else next((i for i in range(136) if rows[k][8 + i] != rows[k - 1][8 + i]), 136))


def test_no_task_meets_all_anchors_of_a_hot_gram(spark):
    """One gram in every document, each time with other bytes around it."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    many = word(64 * 5000).encode()
    least = int(np.argmin(suffix_dedup.Hashes(np.frombuffer(many, np.uint8)).grams(64)))
    gram = many[least : least + 64].decode()  # so it is the anchor of what stands around it
    texts = [word(150) + gram + word(150) for _ in range(400)]
    texts += [texts[0][60:300] + "x"]  # one window is repeated
    docs = suffix_dedup.with_keys(documents(spark, texts).select("text"))
    packed = suffix_dedup.packed_anchors(docs).cache()
    number = packed.agg(suffix_dedup.F.sum("n")).first()[0]
    buckets = 64
    largest = {}
    for hot in (10**6, 50):
        rows = suffix_dedup.dealt(packed, 64, suffix_dedup.high_counters(packed, number, hot))
        largest[hot] = max(r["n"] for r in rows.groupBy("bucket").agg(suffix_dedup.F.sum(suffix_dedup.F.octet_length("blob")).alias("n")).collect()) // suffix_dedup.ANCHOR.itemsize
    assert largest[10**6] >= 400 and largest[50] < 100
    packed.unpersist()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffix_dedup.remove_repeats(documents(spark, texts), 50).collect()}
    assert [got[k] for k in range(len(texts))] == repeats(texts)


def test_anchors_are_local():
    rng = random.Random(0)
    text = "".join(rng.choice("abcd") for _ in range(3000)).encode()
    whole = suffix_dedup.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.zeros(1, np.int64))
    part = suffix_dedup.anchors(np.frombuffer(text[700:1500], np.uint8), np.array([0, 800]), np.zeros(1, np.int64))
    chosen = {p: a["at"] for a in whole for p in range(a["at"] - a["far"], a["at"] - a["near"] + 1)}
    for a in part:
        for p in range(a["at"] - a["far"], a["at"] - a["near"] + 1):
            assert chosen[p + 700] == a["at"] + 700


# 9


def test_classifier(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_subword_quality"](spark, sf).toPandas()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.3)).all() and rows.score.between(0, 1).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.95
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([(good > b).mean() for b in bad]) >= 0.97


BLANKS = " \t\n\v\f\r"
WRAP = 2**64


def plain_bucket(h: int, kind: int) -> int:
    mix = 0x9E3779B97F4A7C15
    h = ((h ^ h >> 29) * mix + kind * 0x632BE59BD9B4E019) % WRAP
    return (h ^ h >> 32) * mix % WRAP >> 64 - quality_classifier.BUCKETS_LOG2


def plain_features(text: str | None) -> Counter:
    """Words, word pairs and character n-grams of marked words, one at a time."""
    step, mix = 0x100000001B3, 0x9E3779B97F4A7C15
    out, hashes = Counter(), []
    for word in re.findall(f"[^{BLANKS}]+", text or ""):
        marked = [1, *(ord(c) + 3 for c in word), 2]
        h = sum(x * pow(step, i, WRAP) for i, x in enumerate(marked)) % WRAP
        hashes.append((h ^ h >> 31) * mix % WRAP)
        out[plain_bucket(hashes[-1], 1)] += 1
        for k in (3, 4, 5):
            for i in range(len(marked) - k + 1):
                h = 0
                for x in marked[i : i + k]:
                    h = (h * step + x) % WRAP
                out[plain_bucket(h, k)] += 1
    for a, b in zip(hashes, hashes[1:], strict=False):
        out[plain_bucket((b - a) % WRAP, 2)] += 1
    return out


def plain_train(texts, labels):
    """The same descent in double precision, document by document."""
    q = quality_classifier
    rng = np.random.default_rng(q.SEED)
    vectors = rng.uniform(-1 / q.DIM, 1 / q.DIM, (1 << q.BUCKETS_LOG2, q.DIM)).astype(np.float32).astype(float)
    output, bias, share = np.zeros((q.DIM, 2)), np.zeros(2), sum(labels) / len(labels)
    epochs = max(q.EPOCHS, -(-q.LEAST_STEPS // len(labels)))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            found = plain_features(texts[i])
            total = sum(found.values())
            rate = q.RATE * (1 - done / (epochs * len(labels)))
            done += 1
            hidden = sum((n / total * vectors[b] for b, n in found.items()), np.zeros(q.DIM))
            z = hidden @ output + bias
            p = np.exp(z) / np.exp(z).sum()
            p[labels[i]] -= 1
            error = p * (0.5 / share if labels[i] else 0.5 / (1 - share))
            back = output @ error
            output -= rate * np.outer(hidden, error)
            bias -= rate * error
            for b, n in found.items():
                vectors[b] -= rate * (n / total) ** 0.5 * back
    return vectors @ (output[:, 1] - output[:, 0]), bias[1] - bias[0]


def test_features_against_a_plain_model():
    texts = [t or "" for t in odd_texts()]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    found = [Counter() for _ in texts]
    for ids, doc in quality_classifier.features(np.frombuffer(b"".join(raw), np.uint8), offsets):
        assert (np.diff(doc) >= 0).all()
        for b, d in zip(ids.tolist(), doc.tolist(), strict=True):
            found[d][b] += 1
    assert found == [plain_features(t) for t in texts]


def test_training_and_scores_against_a_plain_model(monkeypatch):
    monkeypatch.setattr(quality_classifier, "LEAST_STEPS", 60)
    monkeypatch.setattr(quality_classifier, "EPOCHS", 2)
    texts = [*odd_texts()[:12], "good words are here", "Bad!! w0rds ???", None, "   "]
    labels = [k % 3 % 2 for k in range(len(texts))]
    model, (weight, bias) = quality_classifier.train(texts, labels), plain_train(texts, labels)
    assert np.allclose(model.weight, weight, atol=1e-4) and abs(model.bias - bias) < 1e-4
    for t in odd_texts():
        found = plain_features(t)
        z = bias + sum(weight[b] * n for b, n in found.items()) / max(1, sum(found.values()))
        raw = np.frombuffer((t or "").encode(), np.uint8)
        whole = model.score(raw, np.array([0, len(raw)]))[0]
        assert abs(whole - 1 / (1 + np.exp(-z))) < 1e-4
        for most in (40, 300):  # in slices
            assert abs(model.score(raw, np.array([0, len(raw)]), most)[0] - whole) < 1e-9
        if not found:
            assert whole == 1 / (1 + np.exp(-model.bias))


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(d, "x" * (50 if d % 2 else 10)) for d in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id long, quality int")
    seen = []
    train = quality_classifier.train
    try:
        quality_classifier.train = lambda texts, labels: seen.append(texts)
        quality_classifier.fit(docs, labels, most_bytes=200)
        quality_classifier.fit(docs, labels)
    finally:
        quality_classifier.train = train
    assert 150 < sum(map(len, seen[0])) <= 200 and len(seen[1]) == sum(zlib.crc32(str(d).encode()) % 5 != 0 for d in range(40))


def test_classifier_edges(spark, tmp_path):
    texts = odd_texts()
    docs = documents(spark, texts)
    for labels in ([], [(1, 1)], [(5, 1), (6, 0), (6, 0), (None, 1), (7, None), (999, 1), (9, 1), (11, 0)]):
        sf = saved(spark, tmp_path / str(len(labels)), documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int"))
        got = QUERIES["op9_subword_quality"](spark, sf).toPandas()
        assert len(got) == len(texts) and got.score.between(0, 1).all()
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality_classifier.keep_quality(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    sf = saved(spark, tmp_path / "e", documents=docs.limit(0), labels=spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert QUERIES["op9_subword_quality"](spark, sf).collect() == []
    twice = saved(spark, tmp_path / "t", documents=docs.unionByName(docs), labels=spark.createDataFrame([(16, 1), (17, 0), (18, 1)], "doc_id long, quality int"))
    got = QUERIES["op9_subword_quality"](spark, twice).toPandas()
    assert len(got) == 2 * len(texts) and (got.groupby("doc_id").score.nunique() == 1).all()


def test_held_out_labels_are_not_learned_from(spark):
    out = [d for d in range(400) if zlib.crc32(str(d).encode()) % 5 == 0][:3]
    docs = spark.createDataFrame([(d, "good text here" if d % 2 else "BAD!! TEXT!!") for d in range(60)], "doc_id long, text string")
    labels = [(d, d % 2) for d in range(60)]
    flipped = [(d, 1 - q if d in out else q) for d, q in labels]
    fit = lambda x: quality_classifier.fit(docs, spark.createDataFrame(x, "doc_id long, quality int"))
    a, b = fit(labels), fit(flipped)
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_repeated_documents_displace_no_label(spark, monkeypatch):
    ids = [d for d in range(60) if zlib.crc32(str(d).encode()) % 5]
    many = min(ids, key=lambda d: zlib.crc32(str(d).encode()))
    rows = [(d, "good text here" if d % 2 else "BAD!! TEXT!!") for d in ids]
    labels = spark.createDataFrame([(d, d % 2) for d in ids], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda texts, labels: seen.append((texts, labels)))
    for more in ([], [(many, dict(rows)[many])] * 200, [(many, f"another text {k}") for k in range(200)]):
        quality_classifier.fit(spark.createDataFrame(rows + more, "doc_id long, text string").repartition(3), labels, 50)
    assert len(seen[0][0]) == len(ids) <= 50 and seen[1] == seen[0]
    assert seen[2][1] == seen[0][1] and seen[2][0][1:] == seen[0][0][1:]


# 10


def near_copies(n=150, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 200))]
        for _ in range(rng.choice([1, 1, 3, 8, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t = t[: rng.randint(len(t) * 3 // 4, len(t))]
            texts.append(" ".join(t) + (" " + passage if rng.random() < 0.3 else ""))
    return texts


def row_links(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("block,wide,best,often,shingles", [(None, None, None, None, None), (4, 6, 1, (0, 2), 640), (50, 60, 1, (0, 2), 5)])
def test_links(spark, monkeypatch, block, wide, best, often, shingles):
    if block:
        monkeypatch.setattr(signature_join, "SHINGLES", shingles)
        monkeypatch.setattr(signature_join, "BLOCK", block)
        monkeypatch.setattr(signature_join, "WIDE", wide)
        monkeypatch.setattr(signature_join, "BEST", best)
        monkeypatch.setattr(signature_join, "OFTEN", often[0])
        monkeypatch.setattr(signature_join, "OFTEN_TIMES", often[1])
    texts = near_copies() + odd_texts()
    got = row_links(signature_join.link_components(documents(spark, texts)))
    want = link_components(list(enumerate(texts)))
    assert [got[k] for k in range(len(texts))] == want


def test_large_blocks_give_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(signature_join, "BLOCK", 4)
    rng = random.Random(8)
    rows = []
    for _ in range(3):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for k in range(60):
            t = list(base)
            for _ in range(rng.choice([1, 2, 6, 9])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(400)}"
            rows.append(([None, 5, k][k % 3], " ".join(t)))
    levels, whole = [], signature_join.linked_in_parts
    monkeypatch.setattr(signature_join, "linked_in_parts", lambda docs, reps, buckets, level: levels.append(level) or whole(docs, reps, buckets, level))
    firsts, first = [], signature_join.first_links


    def counted(*given):
        made = first(*given)
        firsts.append((made.count(), made.select("class").distinct().count()))
        return made

    monkeypatch.setattr(signature_join, "first_links", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in signature_join.link_components(df).collect()), key=str)
    assert max(levels) > 0 and firsts[0][0] == firsts[0][1] > 0
    assert got == sorted([(i, n, c) for (i, _), (n, c) in zip(rows, link_components(rows), strict=True)], key=str)


def test_prefixes_of_linked_sets(spark):
    """Prefixes of linked sets share as many shingles as asked, at sizes where a link needs all of the smaller set too."""
    rng = np.random.default_rng(3)
    least = dict(map(tuple, spark.range(1, 1400).select("id", signature_join.least_shared(F.col("id"))).collect()))
    common = rng.random(1 << 10) < 0.3
    for n in [*range(1, 70), *range(70, 1000, 23)]:
        for m in {n, n + n // 6, n + n // 3}:
            both = max(-(-3 * (n + m) // 7), 0)
            pool = rng.integers(0, 2**63, n + m - both, np.uint64)
            a, b = (signature_join.common_last(np.sort(x), common) for x in (pool[:n], np.concatenate([pool[:both], pool[n:]])))
            assert len(b) == m and signature_join.links(np.sort(a), np.sort(b))
            shared = len(np.intersect1d(a[: signature_join.prefix_length(n)], b[: signature_join.prefix_length(m)]))
            assert shared >= max(least[n], least[m]) >= 1, (n, m)
    # the smallest shingles of each are the other's largest: as few as can be
    for n in range(1, 1000):
        m = n + n // 3
        a, b = np.arange(m - n, m), np.arange(m)
        assert len(np.intersect1d(a[: signature_join.prefix_length(n)], b[: signature_join.prefix_length(m)])) >= max(least[n], least[m]), n


def test_documents_that_meet_by_chance_reach_no_bitmaps(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    lines = [words(9) for _ in range(10)]
    texts = []
    for k in range(60):
        text = words(400)
        for x in (k, 7 * k + 1):
            text[50 + 100 * (x % 3) : 59 + 100 * (x % 3)] = lines[x % 10]
        texts.append(" ".join(text))
    for k in range(12):
        copy = texts[k].split(" ")
        for _ in range(rng.choice([3, 8, 12])):
            copy[rng.randrange(400)] = "other"
        texts += [" ".join(copy), " ".join(texts[k].split(" ")[: rng.choice([300, 302, 304, 350])])]
    met, whole = set(), signature_join.bitmap_pairs
    monkeypatch.setattr(signature_join, "bitmap_pairs", lambda rows, *more: met.update(r[0] for r in rows.select("class").collect()) or whole(rows, *more))
    got = row_links(signature_join.link_components(documents(spark, texts)))
    assert [got[k] for k in range(len(texts))] == link_components(list(enumerate(texts)))
    assert 0 < len(met) <= 36


def test_words_of_slices(monkeypatch):
    for t in [*odd_texts(), " ".join(near_copies(20))]:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        monkeypatch.setattr(signature_join, "SLICE", 1 << 20)
        whole = signature_join.shingle_sets(raw, np.array([0, len(raw)]))
        monkeypatch.setattr(signature_join, "SLICE", 25)
        assert (signature_join.shingle_sets(raw, np.array([0, len(raw)]))[0] == whole[0]).all()


def test_link_edges(spark, tmp_path):
    t = "a b c d e f g h i j k l m n o p"
    rows = [(3, t), (3, t), (None, t), (7, t.upper()), (None, "q r s t u v"), (None, "q r s t u v"), (9, None), (9, ""), (11, "x y"), (12, "X  y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in signature_join.link_components(df).collect()), key=str)
    assert got == sorted([(i, n, c) for (i, _), (n, c) in zip(rows, link_components(rows), strict=True)], key=str)
    kept = sorted((tuple(r) for r in signature_join.one_of_each(df).collect()), key=str)
    assert kept == sorted([(3, t), (None, "q r s t u v"), (9, None), (9, ""), (11, "x y")], key=str)
    other = spark.createDataFrame([(3, t, "x"), (3, t, "y"), (3, t, "x"), (4, "u v", "z")], "doc_id long, text string, source string")
    stayed = [sorted(map(tuple, signature_join.one_of_each(other.repartition(n)).collect())) for n in (1, 2, 3)]
    assert len(stayed[0]) == 2 and stayed[0] == stayed[1] == stayed[2]
    empty = saved(spark, tmp_path / "e", documents=df.limit(0))
    assert QUERIES["op10_signature_tree_join"](spark, empty).collect() == []


def test_signature_tree_prunes_no_link():
    rng = random.Random(6)
    sets = [np.sort(np.array([hash(x) % 2**63 for x in shingles(t)], np.uint64)) for t in near_copies(80, 7)]
    sizes = np.array([len(s) for s in sets])
    for bits in (64, 1024):
        tree = signature_join.SignatureTree(np.stack([signature_join.bitmap(s, bits) for s in sets]), sizes, np.arange(len(sets)))
        found = {(a, b) for i, j in tree.pairs() for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        true = {(a, b) for b in range(len(sets)) for a in range(b) if signature_join.links(sets[a], sets[b])}
        assert true and true <= found
    assert rng


def test_components_and_filter(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)]
    parent: dict[int, int] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if x != root(x)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    ids = id_filter(spark.range(0, 5000, 7))
    assert ids.passes(np.arange(0, 5000, 7)).all() and ids.passes(np.arange(10**6, 10**6 + 5000)).sum() < 50


def test_tables_and_settings_are_left_as_they_were(spark, tmp_path):
    """Each operator leaves the table of its result at most, and no setting of the session changed."""
    texts = near_copies(60) + odd_texts()
    sf = saved(spark, tmp_path, documents=documents(spark, texts), benchmark=bench(spark, ITEMS), labels=spark.createDataFrame([(16, 1), (17, 0)], "doc_id long, quality int"))
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    limits = [spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")]
    for name, own in (("op3_fm_index_leaks", 0), ("op5_suffix_family_dedup", 1), ("op9_subword_quality", 0), ("op10_signature_tree_join", 1)):
        before = set(folder.iterdir())
        assert QUERIES[name](spark, sf).count() == len(texts)
        assert len(set(folder.iterdir()) - before) == own, name
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert len(set(folder.iterdir()) - before) <= 4  # the last stage's input and tables that results read
    assert limits == [spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")]
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given in ("64m", "1m", "300000"):
        spark.conf.set(size, given)
        with small_batches(spark):
            assert spark.conf.get(size) == (given if given in ("1m", "300000") else str(BATCH_BYTES))
        assert spark.conf.get(size) == given
    spark.conf.set(size, limits[1])


def test_powers():
    for n in (0, 1, 5, 2000, 3):
        assert powers(7, n).tolist() == [pow(7, i, 2**64) for i in range(n)]


# pipeline


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "repeats", "leaks", "tokens"]

    labels, model = spark.read.parquet(f"{sf}/labels.parquet"), None
    model = quality_classifier.fit(docs, labels)
    good = text(stages["quality"](spark, docs, sf))
    assert good.keys() == {r["doc_id"] for r in quality_classifier.scores(docs, model).where("predicted = 1").collect()}

    rows = sorted(text(docs).items())
    kept = text(stages["near_copies"](spark, docs, sf))
    assert kept.keys() == {c for _, c in link_components(rows)} and all(kept[k] == dict(rows)[k] for k in kept)

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before = text(docs)
    cut = text(stages["leaks"](spark, docs, sf))
    for (k, t), (_, hit, found) in zip(rows, leaks(items, [t for _, t in rows]), strict=True):
        assert (k in cut) == (len(found) < 2)
        if k in cut and not found:
            assert cut[k] == before[k]
        if k in cut and hit:
            assert len(cut[k]) < len(before[k])

    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= len(kept)


def test_pipeline_on_odd_rows(spark, tmp_path):
    texts = odd_texts()
    docs = documents(spark, texts)
    sf = saved(spark, tmp_path, documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int"), benchmark=bench(spark, ITEMS))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.run(spark, sf).count() > 0
