"""Small tables with the cases that every operator has to handle, and plain models of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHINGLE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["the", "stone", "Über", "naïve", "x1", "it's", "漢字", "and", "of", "river,", "<|endoftext|>", "<|im_end|>", "ΑΣ", "é"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 160))) for _ in range(6)]
    out: list[str | None] = [None, "", " ", "\n\t ", "a", "one two three", "ONE two three", "😀" * 70, "z" * 5000, " ".join(["same"] * 400), "<|endoftext|>", "it's 'RE I'll x'", "\x00\x01\x1c\x85", "é" * 300]
    for _ in range(25):
        text = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3, 20])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(" ".join(text))
    out += [base[0], base[0], base[1] + " " + base[2], " ".join(base) * 12]
    return out


#: Columns that a careless operator would mix up with its own.
EXTRA = "n_tokens string, key string, size string, spans string, class string, comp string, score string, __copies int"


def documents(spark, texts, parts: int = 3):
    rows = [(k, t, "en", "s", None if t is None else len(t), *["x"] * 7, k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(parts)


def saved(spark, path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def shingles(text: str | None) -> set:
    w = SHINGLE_WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def link_components(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int | None]]:
    """(set size, component) of each row."""
    sets = [shingles(t) for _, t in rows]
    held = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            held[x].append(k)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in held[x] if j < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(k)] = root(j)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(len(s), least.get(root(k))) for k, s in enumerate(sets)]


def repeats(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, digest of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return out


def leaks(items, texts, window: int = 8):
    """(words, hit words, items) of each text."""
    held = defaultdict(set)
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            held[tuple(w[k : k + window])].add(i)
    sizes = {len(x) for x in held}
    out = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in held:
                    hit.update(range(k, k + n))
                    found |= held[x]
        out.append((len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    return out
