"""Encoding and decoding with a word-level BPE vocabulary, by speculation and verification.

Greedy longest match proposes the tokens of each new word.  Every adjacent pair of proposed tokens is then looked up
in a sorted table of pairs that are known to stand or not (one vectorised search for all pairs of a block; unknown
pairs are decided once, by exactly merging their joint text).  A word whose pairs all stand is encoded; only the words
with a failing pair are merged exactly.

Texts are split at the strings of added tokens, normalised (NFC, white space, lower case) and cut into words as the
vocabulary file says.  A text with a character on which Python and the tokenizers library differ takes the library's
own normaliser and splitter.

Defined cases: null and empty texts have no ids and decode to the empty text; texts and words of any length are whole,
long texts are read in slices of about SLICE characters; rows that repeat a text or an id give a row each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandgrid.llm._common import LASTING, id_text, row_blocks, table, text_arrays
from strandgrid.llm.bpe import PairTable, default_path, load

#: Encodings that a worker remembers: of so many words, and of the words before them until as many more have come.
MOST_WORDS = 150_000
#: Characters of a long text, and ids, that are worked on at once.
SLICE = 1 << 20
_CUT = re.compile("[A-Za-z](?= )")
#: Marks the string of an added token among words; no word holds this character next to a letter.
_ADDED = "\0a"


class KnownPairs:
    """Sorted keys (left << 32 | right) and whether the pair stands."""

    def __init__(self, table: PairTable):
        self.table = table
        self.keys, self.stand = np.zeros(0, np.int64), np.zeros(0, bool)

    def check(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        asked = left << 32 | right
        at, found = self._find(asked)
        if not found.all():
            new = np.unique(asked[~found])
            stand = np.array([self.table.decided(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            if len(self.keys) > 2_000_000:
                self.keys, self.stand = np.zeros(0, np.int64), np.zeros(0, bool)
                return self.check(left, right)
            self.keys, self.stand = np.concatenate([self.keys, new]), np.concatenate([self.stand, stand])
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.stand = self.keys[order], self.stand[order]
            at, _ = self._find(asked)
        return self.stand[at]

    def _find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return at, self.keys[at] == asked


class Codec:
    def __init__(self, path: str):
        self.merges = load(path)
        self.library = Tokenizer.from_file(path)
        split = next(p for p in self.merges.spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        added = sorted(self.merges.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")")
        pairs = PairTable(self.merges)
        self.pairs = KnownPairs(pairs)
        own = [(t, i) for i, t in self.merges.token_bytes.items() if pairs.stands(i)]
        self.inner = {t: i for t, i in own if not self.merges.ends[i]}
        self.final = {t: i for t, i in own if self.merges.ends[i]}
        self.longest = max(len(t) for t, _ in own)
        #: length of the longest inner token that begins with these two bytes (or is one byte)
        self.most: dict[bytes, int] = {}
        for t in self.inner:
            self.most[t[:2]] = max(len(t), self.most.get(t[:2], 0))
        self.special = {_ADDED + t: i.to_bytes(4, "little") for t, i in self.merges.added.items()}
        self.memo: dict[str, bytes] = dict(self.special)
        self.older: dict[str, bytes] = {}
        self.text = self.merges.text | {i: t for t, i in self.merges.added.items()}
        self.seen: set[str] = set()
        self.odd: set[str] = set("Σ")  # lower-cased by its neighbours in Python, not in the library

    # text to words

    def words(self, text: str) -> list[str]:
        new = set(text) - self.seen
        if new:
            self.odd |= {c for c in new if self.differs(c)}
            self.seen |= new
        if not self.odd.isdisjoint(text):
            norm = self.library.normalizer.normalize_str(text)
            return [w for w, _ in self._library_words(norm)]
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.word.findall(text.lower())

    def _library_words(self, norm: str) -> list[tuple[str, tuple[int, int]]]:
        return [(norm[a:b], (a, b)) for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def differs(self, c: str) -> bool:
        if unicodedata.combining(c) and c > "\u036f":
            return True  # the order of rare marks depends on the Unicode version
        mine = unicodedata.normalize("NFC", c).lower()
        norm = self.library.normalizer.normalize_str(c)
        if norm != (" " if regex.fullmatch(r"\s", c) else mine):
            return True
        return any([w for w, _ in self._library_words(x)] != self.word.findall(x) for x in (norm, norm + "x", norm + "1", norm + "!", "x" + norm, "!" + norm))

    # words to ids

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; the last token must end the word."""
        out, at, n = [], 0, len(word)
        while at < n:
            rest = n - at
            if rest <= self.longest and (token := self.final.get(word[at:])) is not None:
                out.append(token)
                break
            for k in range(min(self.most.get(word[at : at + 2], 1), rest - 1), 0, -1):
                if (token := self.inner.get(word[at : at + k])) is not None:
                    out.append(token)
                    at += k
                    break
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new words: propose all, verify all pairs at once, merge the failing ones exactly."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        size = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(words)), size)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        failed = np.zeros(len(words), bool)
        if len(inside):
            stand = self.pairs.check(flat[inside], flat[inside + 1])
            failed[owner[inside[~stand]]] = True
        for i in np.flatnonzero(failed).tolist():
            proposed[i] = self.merges.merge(self.merges.symbols(raw[i]))
        for w, ids in zip(words, proposed, strict=True):
            self.memo[w] = np.array(ids, "<u4").tobytes()

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows: list[list[str]] = []
        for text in texts:
            row: list[str] = []
            parts = self.added.split(text) if "<|" in text else [text]
            for i, part in enumerate(parts):
                if i % 2:
                    row.append(_ADDED + part)
                elif part:
                    row.extend(self.words(part))
            rows.append(row)
        if len(self.memo) > MOST_WORDS:
            self.older, self.memo = self.memo, dict(self.special)
        new = set().union(*rows) - self.memo.keys()
        again = new & self.older.keys()
        self.memo.update({w: self.older[w] for w in again})
        new -= again
        if new:
            self.learn(list(new))
        return [b"".join(map(self.memo.__getitem__, row)) for row in rows]

    def encode(self, text: str) -> bytes:
        """Ids of one text; a long one is cut where a letter is followed by a space, between two words in any case."""
        out, at = [], 0
        while len(text) - at > SLICE and (m := _CUT.search(text, at + SLICE)):
            out += self.encode_block([text[at : m.end()]])
            at = m.end()
        return b"".join([*out, *self.encode_block([text[at:]])])

    # ids to text

    def decode(self, ids: bytes) -> str:
        """As the library does for a vocabulary without a decoder: the tokens' own strings, joined by spaces."""
        step = 4 * SLICE
        return " ".join([" ".join([self.text[i] for i in np.frombuffer(ids[k : k + step], "<u4").tolist()]) for k in range(0, len(ids), step)])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def forget() -> None:
    codec.cache_clear()
    load.cache_clear()


LASTING["codec"] = forget


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), decoded (string) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_arrays(batch.column(1), "codec")
            own = codec(tokenizer)
            for i, j in row_blocks(offsets):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                ids = own.encode_block(texts) if j - i > 1 else [own.encode(texts[0])]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json")))
