"""Operators 1 and 4 against the tokenizers library."""

import random

import numpy as np
import pytest
from support import documents, odd_texts, saved, sha
from tokenizers import Tokenizer

from strandgrid.llm import bpe, speculative_bpe, token_counts
from strandgrid.llm._common import text_arrays
from strandgrid.llm.entries import QUERIES

BYTE, WORD = bpe.default_path("byte_bpe_50k.json"), bpe.default_path("word_bpe_49k.json")
ALPHABET = "aab bcdeést'' 'llrevemsd \n\t 01²½٣漢字!?. \u3000\u200b\u0301ǅ😀\x1c\x85 ΣσİȨ"


def random_texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["".join(rng.choice("thereingsonaliouea") for _ in range(rng.randint(1, 60))) for _ in range(n // 4)]


def test_counts_equal_the_library():
    import pyarrow as pa

    texts = random_texts(4000) + [t or "" for t in odd_texts()] + ["<|endoftext|>a<|endoftext|>", "a" * 3000, "ab" * 2000, " " * 999]
    data, offsets = text_arrays(pa.array(texts))
    got = token_counts.Counter(BYTE).count(data, offsets)
    assert got.tolist() == [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("chunk,warm,size,states", [(4, 2, 64, 40), (7, 1, 1 << 20, 10**6), (256, 48, 300, 500)])
def test_chunks_and_slices_change_nothing(monkeypatch, chunk, warm, size, states):
    """Words of many chunks, wrong guesses of entry states, texts in slices, dropped states."""
    for name, value in (("CHUNK", chunk), ("WARM", warm), ("SLICE", size), ("MOST_STATES", states)):
        monkeypatch.setattr(token_counts, name, value)
    import pyarrow as pa

    rng = random.Random(3)
    texts = random_texts(300, 1) + ["thereingson" * 200, "z" * 3000, " ".join("".join(rng.choice("aeinorst") for _ in range(90)) for _ in range(60)), "a " * 700 + "<|endoftext|>" + "b\n" * 500, "", "x"]
    data, offsets = text_arrays(pa.array(texts))
    counter = token_counts.Counter(BYTE)
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert counter.count(data, offsets).tolist() == want
    assert counter.count(data, offsets).tolist() == want


def test_chunk_maps_compose():
    """The scan tells which chunks were run from a state that the chunk before doesn't end in, and adds up the counts."""
    fits, sums = token_counts.scan_maps(np.array([token_counts.ANY, 5, 7, token_counts.ANY, 2]), np.array([5, 6, 1, 2, 9]), np.array([1, 2, 3, 4, 5]))
    assert fits.tolist() == [True, True, False, True, True] and sums.tolist() == [1, 3, 6, 10, 15]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pairs_are_decided_as_by_merging(path):
    rng = random.Random(5)
    m = bpe.load(path)
    table = bpe.PairTable(m)
    own = [i for i in m.token_bytes if table.stands(i)]
    inner = [i for i in own if not m.ends[i]]
    pairs = [(rng.choice(inner), rng.choice(own)) for _ in range(3000)] + [(i, i) for i in rng.sample(inner, 500)]
    for t in rng.sample([i for i in own if len(m.token_bytes[i]) > 1], 3000):  # parts that a token was cut into
        raw = m.token_bytes[t]
        k = rng.randint(1, len(raw) - 1)
        a, b = m.merge(m.symbols(raw[:k], False))[-1], m.merge(m.symbols(raw[k:], m.ends[t]))[0]
        if table.stands(a) and table.stands(b):
            pairs.append((a, b))
    assert [table.decided(a, b) for a, b in pairs] == [table.merged_alike(a, b) for a, b in pairs]


def test_prefix_scan_composes():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 8, (37, 8)).astype(np.uint8)
    want, state = [], np.arange(8)
    for m in maps:
        state = m[state]
        want.append(state)
    assert (token_counts.prefix_scan(maps) == np.array(want)).all()
    symbols = rng.integers(0, 9, 1000).astype(np.uint8)
    assert (token_counts.run_chunks(symbols, 7) == token_counts.run_chunks(symbols, 1000)).all()


def test_coding_equals_the_library():
    texts = random_texts(4000, 2) + [t or "" for t in odd_texts()] + ["<|startoftext|>", "<|EndOfText|>"] + [chr(i) + "a" for i in range(32, 0x3000, 7)]
    codec, library = speculative_bpe.Codec(WORD), Tokenizer.from_file(WORD)
    for text, got, want in zip(texts, codec.encode_block(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
        assert codec.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_slices_of_long_texts_change_nothing(monkeypatch):
    monkeypatch.setattr(speculative_bpe, "SLICE", 30)
    monkeypatch.setattr(speculative_bpe, "MOST_WORDS", 50)
    codec, library = speculative_bpe.Codec(WORD), Tokenizer.from_file(WORD)
    for text in [*(t or "" for t in odd_texts()), " ".join(random_texts(200, 4)), "x" * 200, "a <|endoftext|> " * 30]:
        ids = codec.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike():
    m = bpe.load(WORD)
    word = ("thereingson" * 30).encode()
    ids = m.symbols(word)
    short, todo = list(ids), True
    while todo:
        best = min(((m.ranks[p], k) for k, p in enumerate(zip(short, short[1:], strict=False)) if p in m.ranks), default=None)
        todo = best is not None
        if todo:
            short[best[1] : best[1] + 2] = [best[0][1]]
    assert m.merge(ids) == short


@pytest.mark.parametrize("name", ["op1_transducer_counts", "op4_speculative_bpe"])
def test_queries(spark, tmp_path, name):
    texts = odd_texts()
    sf = saved(spark, tmp_path, documents=documents(spark, texts))
    got = {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}
    assert len(got) == len(texts)
    library = Tokenizer.from_file(BYTE if name.startswith("op1") else WORD)
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        if name.startswith("op1"):
            assert got[k]["n_bytes"] == len((t or "").encode()) and got[k]["over_limit"] == (len(ids) > 512)
        else:
            assert got[k]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
            assert got[k]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False).encode())
    twice = documents(spark, texts).unionByName(documents(spark, texts[::-1]))
    rows = QUERIES[name](spark, saved(spark, tmp_path / "twice", documents=twice)).collect()
    counts = [got[k]["n_tokens"] for k in range(len(texts))]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == sorted([*enumerate(counts), *enumerate(counts[::-1])])
    empty = saved(spark, tmp_path / "empty", documents=documents(spark, texts).limit(0))
    assert QUERIES[name](spark, empty).collect() == []
