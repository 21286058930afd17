"""Text and vector searches on literal rows."""

import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandgrid import QueryError, over, sharded
from strandgrid.functions import signatures, text
from strandgrid.plans.query import Query


def named(spark, *texts, column="NameSearch"):
    return over(spark.createDataFrame(list(enumerate(texts, 1)), f"Id int, {column} string"))


def ids(q):
    return sorted(r[0] for r in q.get_ids().collect())


def test_search(spark):
    q = named(spark, "test 123 abc", "test", None)
    assert ids(q.search("NameSearch", "test")) == [1, 2]
    assert ids(q.search("NameSearch", "test abc")) == [1]
    assert ids(q.search("NameSearch", "")) == [1, 2, 3]
    assert ids(q.search("NameSearch", "  ")) == []


def test_search_partial(spark):
    q = named(spark, "test 123 abc", "test", None, "привет")
    assert ids(q.search_partial("NameSearch", "te ab")) == [1]
    assert ids(q.search_partial("NameSearch", "прив")) == [4]
    assert ids(q.search_partial("NameSearch", "прива")) == []
    assert ids(q.search_partial("NameSearch", "testtest")) == []
    assert ids(q.search_partial("NameSearch", "est")) == []


def test_separators(spark):
    q = named(spark, "test@abc")
    for word in ("test", "test@abc", "abc"):
        assert ids(q.search("NameSearch", word)) == [1]
    s = named(spark, "test@abc one", column="NameSearchS")
    assert [ids(s.search("NameSearchS", w)) for w in ("test", "test@abc", "abc", "one")] == [[], [1], [], [1]]
    assert ids(named(spark, "a.b\nc").search("NameSearch", "b")) == []
    assert ids(named(spark, "a+b").search("NameSearch", "a")) == []


def test_case(spark):
    q = named(spark, "ПриВеТ Как ДелА")
    assert ids(q.search("NameSearch", "привет дела")) == [1]
    assert ids(q.search_partial("NameSearch", "ПРИ КА Д")) == [1]
    assert q.select("NameSearch").first()[0] == "ПриВеТ Как ДелА"


def test_steps(spark):
    q = over(spark.range(1, 3100).select(F.col("id").cast("int").alias("Id"), F.lit("test i abc").alias("NameSearch")))
    assert ids(q.search("NameSearch", "test", 0, 1)) == list(range(1, 1000))
    assert ids(q.search("NameSearch", "test", 1, 1)) == list(range(1000, 2000))
    with pytest.raises(QueryError):
        q.search("NameSearch", "test", 1)
    found, percent = q.search_time_limited("NameSearch", "test", 60_000)
    assert percent == 100 and found.count().first()[0] == 3099


SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)


def model(value, mode):
    low = value.lower()
    plain = {x for x in "".join(" " if c in SPACES else c for c in low).split(" ") if x}
    if mode == "spaces":
        return plain
    parts = "".join(" " if c in text.SEPARATORS else c for c in low).split(" ")
    return plain | {y for x in parts if (y := x.strip(SPACES))}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aBé .,\n\t@#-_\\[]–· \u0085x+", max_size=30), min_size=1, max_size=20))
def test_tokens_match_the_rules(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    for mode in ("words", "spaces"):
        for i, got in df.select("i", text.tokens(F.col("v"), mode)).collect():
            assert set(got) == model(values[i], mode) and len(set(got)) == len(got)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB .\n\t@-\\E", max_size=12), min_size=1, max_size=25), st.text(alphabet="ab .@\\E", min_size=1, max_size=5))
def test_searches_match_the_rules(spark, values, query):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    words = query.lower().split()
    for mode in ("words", "spaces"):
        sets = [model(v, mode) for v in values]
        exact = {i for i, s in enumerate(sets) if words and all(w in s for w in words)}
        begins = {i for i, s in enumerate(sets) if words and all(any(t.startswith(w) for t in s) for w in words)}
        assert {r[0] for r in df.where(text.has_all_words(F.col("v"), query, mode)).select("i").collect()} == exact
        assert {r[0] for r in df.where(text.has_all_prefixes(F.col("v"), query, mode)).select("i").collect()} == begins


def test_signatures_find_a_superset(spark):
    values = [f"word{k % 7} common thing{k}" for k in range(300)]
    q = named(spark, *values)
    q = Query(q.source, q.schema, signature_index=("NameSearch", 256))
    for words in ("word3", "common", "thing12 word5"):
        assert set(ids(q.search("NameSearch", words))) <= set(ids(q.search_bitfunnel("NameSearch", words)))
    assert ids(q.search_bitfunnel("NameSearch", " ")) == []
    assert len(ids(q.search_bitfunnel("NameSearch", "common", stop_count=5))) == 300
    wide = over(spark.range(3000).select(F.col("id").cast("int").alias("Id"), F.lit("common").alias("NameSearch")))
    wide = Query(wide.source, wide.schema, signature_index=("NameSearch", 64))
    assert len(ids(wide.search_bitfunnel("NameSearch", "common", stop_count=1500))) == 2048
    with pytest.raises(QueryError):
        named(spark, "x").search_bitfunnel("NameSearch", "x")
    with pytest.raises(QueryError):
        signatures.check_size(13, 1024)


def test_signatures_of_rows(spark):
    values = ["a b", None, "", "c", "a"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(1).orderBy("i").select(signatures.signature(F.col("v"), 64)).collect()]
    bits = lambda v: {p for w in model(v, "words") for p in signatures.positions([w], 64)[0].tolist()}
    assert got == [None if v is None else [int.from_bytes(sum(1 << p for p in bits(v)).to_bytes(8, "little"), "little", signed=True)] for v in values]
    wide = spark.createDataFrame([("a b c. d",)], "v string").select(signatures.signature(F.col("v"), 200).alias("s"))
    want = {p for w in model("a b c. d", "words") for p in signatures.positions([w], 200)[0].tolist()}
    assert [b for k, x in enumerate(wide.first()["s"]) for b in range(64 * k, 64 * k + 64) if x >> (b % 64) & 1] == sorted(want)
    assert wide.select(signatures.share_of_bits(F.col("s"), 200)).first()[0] == len(want) / 200


def test_token_sets_in_python_and_in_spark_agree(spark):
    values = ["a.b\nc", "x\x1cy \x85z", "", "  ", "Ünï-CODE–dash•dot", "tab\there (par) [b]"]
    for mode in ("words", "spaces"):
        df = spark.createDataFrame([(v,) for v in values], "v string").select(F.lower("v").alias("low"), text.tokens(F.col("v"), mode).alias("t"))
        assert all(signatures.token_set(r["low"], mode) == set(r["t"]) for r in df.collect())


def test_signature_hashes():
    """By the hashes' published definitions, one character at a time."""
    for word in ("", "a", "test", "привет", "😀x"):
        units = [int.from_bytes(word.encode("utf-16-le")[k : k + 2], "little") for k in range(0, len(word.encode("utf-16-le")), 2)]
        fnv, djb, sdbm = 2166136261, 5381, 0
        for u in units:
            fnv = (fnv ^ u) * 16777619 % 2**32
            djb = (djb * 33 + u) % 2**64
            sdbm = (u + sdbm * 65599) % 2**64
        assert signatures.positions([word], 1000).tolist() == [[fnv % 1000, djb % 1000, sdbm % 1000]]


def most_memory(make):
    """What make() gives, and the most bytes that Python and numpy held for it."""
    tracemalloc.start()
    try:
        return make(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_long_word_costs_no_memory_for_the_others():
    words = [f"w{k}" for k in range(2000)]
    both, most = most_memory(lambda: signatures.positions([*words, "x" * 10_000], 256))
    assert both[:-1].tolist() == signatures.positions(words, 256).tolist() and most < 16 << 20


def test_signatures_are_made_in_blocks():
    texts = [None if k % 50 == 0 else " ".join(f"{k}x{j}" for j in range(60_000 if k == 99 else 300)) for k in range(1, 1600)]
    rows = pa.array(texts, pa.string())
    assert [x for part in signatures.blocks(rows, 256) for x in part.to_pylist()] == texts
    got, most = most_memory(lambda: signatures.hashed(rows, 256, "words"))
    assert most < 64 << 20  # all at once: 200 MB and more
    for k in (0, 48, 49, 98, 1598):
        assert got[k].as_py() == (None if texts[k] is None else signatures.packed([texts[k]], 256, "words")[0].tolist())


def test_a_search_that_stops_makes_each_signature_once(spark):
    for shards, last in ((1, 2047), (2, 1023)):
        df = spark.range(5000 * shards).selectExpr(f"cast(id div {shards} as int) Id", f"cast(id % {shards} as int) Sid", "concat('common x', id) NameSearch")
        q = Query(df, over(df).schema, shard="Sid" if shards > 1 else None, signature_index=("NameSearch", 512))
        found = q.search_bitfunnel("NameSearch", "common", stop_count=1500).get_ids()
        got = found.collect()
        assert len(got) == len(set(got)) == 2048 and max(r["Id"] for r in got) == last
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ArrowEvalPython") == 1


def test_rows_without_a_key_are_of_no_batch(spark):
    df = spark.createDataFrame([(None, "common")] * 9 + [(k, "common") for k in range(3)], "Id int, NameSearch string")
    q = Query(df, over(df).schema, signature_index=("NameSearch", 512))
    assert ids(q.search_bitfunnel("NameSearch", "common", stop_count=5)) == [0, 1, 2]


V = [(1, [0.01, 0.02, 0.03]), (2, [0.011, 0.022, 0.033]), (3, [-0.01, -0.02, -0.03]), (4, [-0.011, -0.022, -0.033]), (5, None)]


def test_neighbours(spark):
    df = spark.createDataFrame(V, "Id int, VectorL2 array<float>")
    at = [-0.015, -0.025, -0.035]
    assert ids(over(df).search_neighbours("VectorL2", at, 1)) == [4]
    assert ids(over(df.where("Id <> 4")).search_neighbours("VectorL2", at, 1)) == [3]
    assert ids(over(df).search_neighbours("VectorL2", at, 100)) == [1, 2, 3, 4]
    own = over(df).search_neighbours("VectorL2", V[0][1], 1).distances().first()
    assert own["Id"] == 1 and own["distance"] == 0
    from strandgrid import field

    assert ids(over(df).where(field("Id") == 1).search_neighbours("VectorL2", at, 1)) == []
    with pytest.raises(Exception, match="vector dimensionality changed"):
        over(df).search_neighbours("VectorL2", [1.0], 1).get_ids().collect()


def test_neighbours_of_each_shard(spark):
    df = spark.createDataFrame([(1 + i % 2, i, [float(i)]) for i in range(10)], "Sid int, Id int, VectorL2 array<float>")
    got = sharded(df).search_neighbours("VectorL2", [3.2], 2).get_ids().collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 4), (2, 3), (2, 5)]
