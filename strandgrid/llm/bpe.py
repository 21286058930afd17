"""Byte-pair merge tables and exact merging, shared by the tokenizer operators."""

from __future__ import annotations

import json
from functools import lru_cache

import public_tokenizers


def byte_alphabet() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte: itself if printable, else 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Stands for the rank of a pair that doesn't merge.
_NONE = (1 << 62, -1)


class Merges:
    """Vocabulary and merge ranks over symbols that are ids; ``merge`` is the exact procedure."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.spec = spec
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.text = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        visible = byte_alphabet()
        self.byte_id = [self.vocab[visible[b]] for b in range(256)]
        self.last_id = [self.vocab[visible[b] + self.suffix] for b in range(256)]
        back = {c: b for b, c in visible.items()}
        #: bytes of each token, and if the token ends a word
        self.token_bytes: dict[int, bytes] = {}
        self.ends: dict[int, bool] = {}
        for t, i in self.vocab.items():
            core = t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
            self.ends[i] = bool(self.suffix) and t.endswith(self.suffix)
            self.token_bytes[i] = bytes(back[c] for c in core)

    def symbols(self, word: bytes, ends: bool = True) -> list[int]:
        ids = [self.byte_id[b] for b in word]
        if ids and ends and self.suffix:
            ids[-1] = self.last_id[word[-1]]
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first among equals."""
        if len(ids) > 64:
            return self._merge_long(ids)
        ids, known = list(ids), self.ranks.get
        found = [known(p, _NONE) for p in zip(ids, ids[1:], strict=False)]  # (rank, merged id) of each pair
        while found:
            best = min(found)
            if best is _NONE:
                break
            at = found.index(best)  # the leftmost
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = known((ids[at - 1], ids[at]), _NONE)
            if at < len(found):
                found[at] = known((ids[at], ids[at + 1]), _NONE)
        return ids

    def last_pair(self, ids: list[int]) -> tuple[int, int] | None:
        """The pair that the last merge joins, if all of ``ids`` become one token."""
        ids, ranks, last = list(ids), self.ranks, None
        while len(ids) > 1:
            known = [(r, i) for i in range(len(ids) - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
            if not known:
                return None
            (_, new), at = min(known)
            last = (ids[at], ids[at + 1])
            ids[at : at + 2] = [new]
        return last

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for words of any length."""
        import heapq

        n = len(ids)
        ids, prev, nxt, alive = list(ids), list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        # entries are (rank, merged id, position, left id, right id); ranks differ by pair, so position breaks ties
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = new, False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for left, right in ((prev[i], i), (i, nxt[i])):
                if left >= 0 and right >= 0 and (r := self.ranks.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (*r, left, ids[left], ids[right]))
        return [x for x, y in zip(ids, alive, strict=True) if y]


@lru_cache(maxsize=4)
def load(path: str) -> Merges:
    return Merges(path)


class PairTable:
    """Whether two adjacent tokens stay as they are when their joint text is merged exactly; remembered by pair.

    A token sequence is the exact encoding of its text if every token encodes to itself and every adjacent pair holds.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        #: token: (left, right, rank) of the merge that completes it; None: a symbol; () : not known, or out of rank order
        self.made: dict[int, tuple[int, int, int] | tuple[()] | None] = {}
        self.own: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def stands(self, token: int) -> bool:
        if (known := self.own.get(token)) is None:
            m = self.merges
            known = self.own[token] = m.merge(m.symbols(m.token_bytes[token], m.ends[token])) == [token]
        return known

    def completed(self, token: int) -> tuple[int, int, int] | tuple[()] | None:
        """The last merge of a token that stands, if its merges come in the order of their ranks."""
        if token in self.made:
            return self.made[token]
        m = self.merges
        ids = m.symbols(m.token_bytes[token], m.ends[token])
        out: tuple[int, int, int] | tuple[()] | None = None
        if len(ids) > 1:
            out = ()
            if len(ids) <= 64 and (last := m.last_pair(ids)) is not None and m.ranks[last][1] == token:
                parts = [self.completed(x) for x in last]
                if all(x is None or (x and x[2] < m.ranks[last][0]) for x in parts):
                    out = (*last, m.ranks[last][0])
        self.made[token] = out
        return out

    def holds(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.decided(a, b)
        return known

    def decided(self, a: int, b: int) -> bool:
        """Take both tokens apart at the edge where they meet, the later merge first.  Whenever two parts stand side by
        side, a merge of them must not come before the merges that use them up (of equal ones the left comes first)."""
        left, right, ranks = a, b, self.merges.ranks
        used_left = used_right = 1 << 62
        while True:
            cross = ranks.get((left, right))
            if cross is not None and cross[0] < used_left and cross[0] <= used_right:
                return False
            x, y = self.completed(left), self.completed(right)
            if x is None and y is None:
                return True
            if x == () or y == ():
                return self.merged_alike(a, b)
            if y is None or (x is not None and x[2] > y[2]):
                left, used_left = x[1], x[2]
            else:
                right, used_right = y[0], y[2]

    def merged_alike(self, a: int, b: int) -> bool:
        """The definition: merge the joint text."""
        m = self.merges
        return m.merge(m.symbols(m.token_bytes[a], False) + m.symbols(m.token_bytes[b], m.ends[b])) == [a, b]


def default_path(name: str) -> str:
    return public_tokenizers.path(name)
