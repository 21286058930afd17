"""Operators 2, 6, 7 and 8 against plain models."""

import hashlib
import math
import os
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from support import documents, odd_texts, saved

from strandgrid.llm import chat_windows, hash_forest, sharding, url_filter
from strandgrid.llm.bpe import default_path
from strandgrid.llm.entries import ORACLE_SQL, QUERIES

# 2


def digests(turns):
    """{conv: (turns, digest, loss chars, loss digest)} of (conv, turn, role, text) rows."""
    held = defaultdict(list)
    for conv, turn, role, text in turns:
        held[conv].append((turn if turn is not None else -(2**63), role or "", text or ""))
    out = {}
    for conv, rows in held.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        out[conv] = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def random_turns():
    rng = random.Random(0)
    bits = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "x ", "\n", "<\\|", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", "r\\n", "<|im_end|>"]), "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 30, 600])))) for c in range(40) for t in range(rng.randint(1, 30))]
    return rows + [(None, 0, "user", "a"), (None, 1, "assistant", None), (50, None, None, None), (50, 1, "assistant", "t"), (50, 1, "assistant", "t"), (51, 0, "system", "s" * 3000), (51, 1, "assistant", "u" * 9000)]


def test_windows_read_back(spark):
    turns = random_turns()
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", chat_windows.F.lit("x")).repartition(3)
    windows = chat_windows.format_windows(df, default_path("byte_bpe_50k.json"), 300, 60)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_windows.read_back(windows).collect()}
    assert got == digests(turns)
    for r in windows.collect():
        parsed = chat_windows.parse(r["text"])
        new = len(parsed) - r["repeated"]
        assert new >= 1 and (r["tokens"] <= 300 or new == 1)
        assert "".join(chat_windows.turn_text(a, b)[0] for a, b in parsed) == r["text"]
        assert [chat_windows.unescape(r["text"][s["start"] : s["end"]]) for s in r["loss"]] == [t for a, t in parsed[r["repeated"] :] if a == "assistant"]
        if r["window"] and r["repeated"]:
            assert r["first_turn"] > 0
    assert any(r["repeated"] > 1 for r in windows.collect())


def test_system_turn_is_retained(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, k, "user" if k % 2 else "assistant", f"word{k} " * 40) for k in range(1, 12)]
    got = chat_windows.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), default_path("byte_bpe_50k.json"), 400, 130).collect()
    assert len(got) > 1 and all(chat_windows.parse(r["text"])[0] == ("system", "be brief") for r in got)


def test_escaping_is_reversible():
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("<|\\i\n") for _ in range(rng.randint(0, 12)))
        assert "<|" not in chat_windows.escape(t) and chat_windows.unescape(chat_windows.escape(t)) == t
        assert "\n" not in chat_windows.escape_role(t) and chat_windows.unescape_role(chat_windows.escape_role(t)) == t


def test_chat_query(spark, tmp_path):
    rows = random_turns()
    sf = saved(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: tuple(r)[1:5] for r in QUERIES["op2_budgeted_windows"](spark, sf).collect()}
    assert got == digests(rows + [(-1, 0, "user", chat_windows.TRAP), (-1, 1, "assistant", chat_windows.TRAP)])
    empty = saved(spark, tmp_path / "e", conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert [r["conv_id"] for r in QUERIES["op2_budgeted_windows"](spark, empty).collect()] == [-1]


# 6


def test_shards(spark, tmp_path):
    texts = odd_texts()
    sf = saved(spark, tmp_path, documents=documents(spark, texts).unionByName(documents(spark, texts[-3:])))
    rows = QUERIES["op6_hash_tree_shards"](spark, sf).collect()
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode() if r["doc_id"] >= 3 else None
        if raw is not None:
            assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) + 3 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    empty = saved(spark, tmp_path / "e", documents=documents(spark, texts).limit(0))
    assert QUERIES["op6_hash_tree_shards"](spark, empty).collect() == []


def plain_shard(key: int, node: sharding.Node) -> int:
    """The descent, one weighted draw after the other."""
    while node.shard < 0:
        draws = []
        for i, c in enumerate(node.children):
            if c.weight > 0:
                h = xxhash.xxh64_intdigest(c.name.encode(), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
                draws.append((-math.log(((h >> 11) + 1) * 2.0**-53) / c.weight, i))
        node = node.children[min(draws)[1]]
    return node.shard


def test_every_row_against_a_plain_descent(spark):
    weights = sharding.inner("w", [sharding.Node("a", 0.0, (), 0), sharding.inner("b", [sharding.Node("c", 0.25, (), 1), sharding.Node("d", 3.0, (), 2)]), sharding.Node("e", 2.0, (), 3)])
    ids = [None, 0, -1, 2**62, -(2**63), *range(1, 3000, 7)]
    docs = spark.createDataFrame([(i, "é" * 100_000 if k == 5 else None if k % 5 == 0 else f"t{k % 3}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    for now, grown in ((sharding.tree(16), sharding.tree(17)), (weights, sharding.tree(3))):
        rows = sharding.assign_shards(docs, now, grown).collect()
        assert len(rows) == len(ids)
        slots = defaultdict(list)
        for r in rows:
            key = -(2**62) if r["doc_id"] is None else r["doc_id"]
            assert (r["shard"], r["grown_shard"]) == (plain_shard(key, now), plain_shard(key, grown))
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(r["size"] for r in rows) == 200_001


def test_shard_shares_and_growth(spark):
    ids = spark.range(40_000).select(sharding.F.col("id").alias("doc_id"), sharding.F.lit(None).cast("string").alias("text"))
    for n in (16, 17, 18):
        out = sharding.assign_shards(ids, sharding.tree(n), sharding.tree(n + 1)).groupBy("shard", "grown_shard").count().collect()
        assert all(r["grown_shard"] in (r["shard"], n) for r in out)
        size = defaultdict(int)
        for r in out:
            size[r["shard"]] += r["count"]
        assert len(size) == n and max(abs(v - 40_000 / n) for v in size.values()) < 5 * math.sqrt(40_000 / n)


def test_weights_move_rows_only_at_changed_subtrees(spark):
    old = sharding.tree(16)
    racks = list(old.children[1].children)
    racks[0] = sharding.inner(racks[0].name, [sharding.Node(c.name, c.weight * 3, (), c.shard) for c in racks[0].children])
    new = sharding.inner("root", [old.children[0], sharding.inner(old.children[1].name, racks), *old.children[2:]])
    ids = spark.range(20_000).select(sharding.F.col("id").alias("doc_id"), sharding.F.lit("").alias("text"))
    moved = {(r["shard"], r["grown_shard"]) for r in sharding.assign_shards(ids, old, new).where("shard <> grown_shard").select("shard", "grown_shard").distinct().collect()}
    assert moved and all(b // 4 == 1 for _, b in moved)  # only into the region whose weight rose


# 7


CASES = [
    ("https://www.Example.com/en/12", "www.example.com", "/en/12", "com/en/", "block"),
    ("http://example.com/en/7x?q=/en/", "example.com", "/en/7x", "example.com/en/7", "allow"),
    ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    ("x://a.example.net/de/8", "a.example.net", "/de/8", "example.net/de/8", "block"),
    ("x://a.b.org/es/#f", "a.b.org", "/es/", "org/es/", "block"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://xcom/en/", "xcom", "/en/", None, "allow"),
    ("http://cheap-pills.site/x", "cheap-pills.site", "/x", None, "block"),
    ("http://spammer.site/free", "spammer.site", "/free", None, "allow"),
    ("http://free.site/a/bonus", "free.site", "/a/bonus", None, "block"),
    ("http://free.site/a/free", "free.site", "/a/free", None, "allow"),
    ("no scheme/casino", "", "", None, "block"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://h?x", "h", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
]
RULE_VERDICT = {h + p: v for v, h, p in url_filter.RULES}


def test_urls(spark, tmp_path):
    rows = [(k, u, "<html>") for k, (u, *_) in enumerate(CASES)] + [(None, CASES[0][0], None), (0, CASES[0][0], None)]
    sf = saved(spark, tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", url_filter.F.lit("x")))
    got = QUERIES["op7_url_vocabulary"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is None:
            continue
        _, host, path, rule, verdict = CASES[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), CASES[r["page_id"]]
        assert r["verdict"] == (RULE_VERDICT[rule] if rule else verdict)
    empty = saved(spark, tmp_path / "e", pages=spark.createDataFrame([], "page_id long, url string"))
    assert QUERIES["op7_url_vocabulary"](spark, empty).collect() == []
    assert not url_filter.vocabulary_blocks("casino", (), ())


def test_vocabulary_table(spark):
    terms = spark.createDataFrame([("Lotto", True), ("lotto", False), ("jetzt", False), ("hier", None), ("", True), (None, True)], "term string, strict boolean")
    strict, soft = url_filter.vocabulary_of(terms)
    assert (strict, soft) == (("lotto",), ("hier", "jetzt"))
    urls = ["http://x.de/LOTTO-6", "http://lottos.de/jetzt", "http://x.de/jetzt/hier", "http://casino.de/", "http://x.de/jetzt/jetzt", "http://x.de/" + "a/" * 100_000 + "lotto"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, strict=strict, soft=soft).collect()}
    assert [got[k] for k in range(len(urls))] == ["block", "allow", "block", "allow", "allow", "block"]
    for words in ("gratis-wetten", "rencontre/gratuit", "spam", "préstamo-barato", "free-bets"):
        assert url_filter.vocabulary_blocks(f"http://h.example/{words}")


def test_verdicts_of_the_rules(spark, tmp_path):
    """The words of the contract's list, written out here."""
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for v, h, p in url_filter.RULES} == said
    urls = ["http://a.com/en/casino", "http://example.com/en/7/casino", "http://a.net/de/casino", "http://example.net/de/7-casino", "http://a.example.net/de/81", "http://a.org/es/x"]
    rules = ["com/en/", "example.com/en/7", "net/de/", "net/de/", "example.net/de/8", "org/es/"]
    sf = saved(spark, tmp_path, pages=spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    got = sorted(QUERIES["op7_url_vocabulary"](spark, sf).select("page_id", "rule", "verdict").collect())
    assert [tuple(r) for r in got] == [(k, r, said[r]) for k, r in enumerate(rules)]


def test_rules_of_equal_length():
    table = url_filter.RuleTable([("block", "b.com", "/aaaa"), ("allow", "a.b.com", "/aa"), ("block", "a.b.com", "/aa")])
    assert table.match("a.b.com", "/aaaab") == ("a.b.com/aa", "allow")


# 8


def brute(rows, k=10, every=100):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for q, v in ok:
        if q % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def test_neighbours_of_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(230)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] + [1.0] * 5), (404, [float("inf")] * 6), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (None, rows[1][1]), (600, []), (700, [0.0] * 6)]
    sf = saved(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for r in QUERIES["op8_hash_prefix_forest"](spark, sf).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = brute(rows)
    assert got.keys() == want.keys() == {0, 100, 200, 300, 500}
    for q, near in want.items():
        assert [i for _, i in got[q]] == [i for _, i in near] and np.allclose([d for d, _ in got[q]], [d for d, _ in near], atol=1e-12)
    empty = saved(spark, tmp_path / "e", embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert QUERIES["op8_hash_prefix_forest"](spark, empty).collect() == []


@pytest.mark.parametrize("block", [hash_forest.BLOCK, 100])
def test_repeated_rows_take_one_place(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(hash_forest, "BLOCK", block)
    monkeypatch.setattr(hash_forest, "SHARE", 1.0)
    monkeypatch.setattr(hash_forest, "QUERY_BYTES", 1 << 20 if block > 100 else 300)
    rng = np.random.default_rng(1)
    once = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(201)]
    other = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in (7, 8, 9, 100)]  # ids of two vectors
    same = [(i, once[0][1]) for i in range(300, 315)]
    rows = once * 2 + other + same + [same[3]] * 30 + [once[0]] * 30 + [once[5]] * 12
    held = defaultdict(list)
    for i, v in rows:
        held[i].append(np.array(v, float))
    gap = lambda a, b: min(float(np.sqrt(((x - y) ** 2).sum())) for x in held[a] for y in held[b])
    sf = saved(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for r in QUERIES["op8_hash_prefix_forest"](spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == {0, 100, 200, 300}
    for q, near in got.items():
        want = sorted((gap(q, i), i) for i in held if i != q)[:10]
        assert [(n, i) for n, i, _ in near] == [(n, i) for n, (_, i) in enumerate(want, 1)]
        assert np.allclose([d for _, _, d in near], [d for d, _ in want], atol=1e-12)


def test_ties_are_kept_where_the_forest_prunes(spark, tmp_path):
    """Thirty ids of one vector near the query, and ten at one distance on either side: the smallest ids win."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(1, 3000) if i % 100]
    query = rng.standard_normal(24)
    step = np.zeros(24)
    step[0] = 0.125
    rows += [(0, query.tolist()), (4000, (query + 8 * step).tolist())]
    rows += [(i, (query + 8 * step + (2 * step if i % 2 else -2 * step)).tolist()) for i in range(5001, 5021)]
    rows += [(i, (query + step).tolist()) for i in range(6001, 6031)][::-1]
    # doubles that floats hold: the distances tie in the table's own type
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    sf = saved(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(1))
    got = defaultdict(list)
    for r in QUERIES["op8_hash_prefix_forest"](spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute(rows)
    assert len(rows) * hash_forest.SHARE < 600
    assert [i for i, _ in got[0]] == list(range(6001, 6011)) and len({d for _, d in got[0]}) == 1
    assert [i for i, _ in got[4000]] == [i for _, i in want[4000]]


@pytest.mark.parametrize("block,queries", [(None, None), (700, 7)])
def test_recall(spark, monkeypatch, block, queries):
    if block:
        monkeypatch.setattr(hash_forest, "BLOCK", block)
        monkeypatch.setattr(hash_forest, "QUERY_BYTES", queries * 64 * 8)
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert hash_forest.SHARE * len(rows) < len(rows) / 5  # most entries are no candidates
    want, got = brute(rows), defaultdict(set)
    for r in QUERIES["op8_hash_prefix_forest"](spark, sf).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & {i for _, i in near}) / 10 for q, near in want.items()]) >= 0.9


def test_recall_of_a_large_block():
    t = pq.read_table("/root/testdata/check_s/embeddings.parquet").to_pandas() if os.path.exists("/root/testdata/check_s") else pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()
    t = t[t.embedding.notna()]
    ids, vectors = t.vec_id.to_numpy(), np.stack([np.array(x, float) for x in t.embedding])
    asked = np.flatnonzero(ids % 100 == 0)[:60]
    found = defaultdict(set)
    for q, i, _ in hash_forest.Forest(ids, vectors).search(ids[asked], vectors[asked], 10):
        found[q].add(i)
    share = []
    for q in asked:
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[ids == ids[q]] = np.inf
        share.append(len(found[int(ids[q])] & set(ids[np.argsort(d)[:10]].tolist())) / 10)
    assert np.mean(share) >= 0.9


def test_votes_are_shared_bits():
    rng = np.random.default_rng(3)
    forest = hash_forest.Forest(np.arange(400), rng.standard_normal((400, 8)))
    query = rng.standard_normal((1, 8))
    low, high = forest.ranges(forest.hashed(query))
    assert (high[hash_forest.BITS] - low[hash_forest.BITS] == 400).all()
    entry, asked = forest.hashed(forest.vectors), forest.hashed(query)
    shared = np.array([[hash_forest.BITS - int(x).bit_length() for x in t] for t in entry ^ asked])
    size = (high - low)[:, :, 0].sum(axis=1)
    kept = hash_forest.BITS - int(np.flatnonzero(size >= hash_forest.VISITS * 400)[0])
    votes = np.maximum(shared - kept + 1, 0).sum(axis=0)
    got = forest.candidates(low[:, :, 0], high[:, :, 0], 40)
    assert votes[got].min() >= np.sort(votes)[-40] and len(set(got.tolist())) == 40


def test_sql_is_for_registered_queries():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) == 10
