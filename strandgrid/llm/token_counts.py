"""Exact token counts by compiled finite-state transducers.

Two deterministic machines make the counts of a byte-level vocabulary:

* ``SPLIT`` splits text into words.  It reads one symbol a character (its class, with the look-ahead of the pattern
  folded in) and marks the transitions that begin a word.  The text of many documents is cut into equal chunks; the
  map from start state to end state of every chunk is built for all start states at once, the maps are composed by a
  parallel prefix scan, and each chunk is then run once more from the state the scan gives it.
* ``CountTransducer`` reads the bytes of the words.  Its states hold the last tokens of the encodings of the word's
  prefixes, as far back as a token can still begin; each transition carries the change in the number of emitted tokens.
  States and transitions are compiled on first use and remembered; their number is bounded.  The text is cut into
  chunks, all chunks are run in step over arrays of transitions, and their maps (entry state to last state and emitted
  tokens) are composed by a prefix scan, whose sums at the documents' edges are the counts.

Strings of added tokens inside a text count as the library counts them: one token, and the text splits there.

Defined cases: null and empty texts have 0 bytes and 0 tokens; texts of any length are whole, read in slices of about
SLICE bytes (a single word beyond that is read at once); rows that repeat a text or an id give a row each; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from strandgrid.llm._common import LASTING, id_text, table, text_arrays
from strandgrid.llm.bpe import Merges, PairTable, default_path, load

OVER = 512
CHUNK = 256
#: Bytes before a chunk inside a word that its entry state is guessed from.
WARM = 48
#: Bytes of text that are read together.
SLICE = 1 << 20
#: Compiled states of a worker; they are dropped and built anew beyond this.
MOST_STATES = 250_000
#: Entry of a chunk that begins with a word: it takes every state.
ANY = -1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(rb"[0-9A-Za-z](?=[ \n])")

# character classes
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# input symbols
S_L, S_N, S_O, S_A2, S_A3, S_RUN, S_SP, S_END, S_RESET = range(9)
# states
IN_L, IN_N, IN_O, IN_RUN, AFTER_SP, DONE, LAST1, LAST2 = range(8)


def split_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, begins a word) for each input symbol and state.

    S_A2 and S_A3 are apostrophes that begin a two- or three-character contraction if a word may begin there; S_RUN is
    white space followed by more white space or the end; S_SP and S_END are a last space and another last blank.
    """
    nxt = np.zeros((9, 8), np.uint8)
    new = np.ones((9, 8), np.uint8)
    for symbol, state in ((S_L, IN_L), (S_N, IN_N), (S_O, IN_O)):
        nxt[symbol] = state
        new[symbol, [state, AFTER_SP]] = 0
    nxt[S_L, LAST2], new[S_L, LAST2] = LAST1, 0
    nxt[S_L, LAST1], new[S_L, LAST1] = DONE, 0
    for symbol, state in ((S_A2, LAST1), (S_A3, LAST2)):
        nxt[symbol] = state
        nxt[symbol, [IN_O, AFTER_SP]] = IN_O
        new[symbol, [IN_O, AFTER_SP]] = 0
    nxt[S_RUN] = IN_RUN
    new[S_RUN, IN_RUN] = 0
    nxt[S_SP], nxt[S_END], nxt[S_RESET] = AFTER_SP, DONE, DONE
    return nxt, new


NEXT, NEW = split_machine()


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps: row i is maps[i] after ... after maps[0]; log2(n) rounds."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def run_chunks(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Boolean for each symbol: a word begins there.  Chunk state maps first, then their scan, then the marks."""
    n = len(symbols)
    m = max(1, -(-n // chunk))
    grid = np.full(m * chunk, S_RESET, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(m, chunk).T)
    flat = NEXT.ravel()
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (m, 8)).copy()
    for row in grid:
        maps = flat[(row.astype(np.uint8) * 8)[:, None] + maps]
    start = np.full(m, DONE, np.uint8)
    if m > 1:
        start[1:] = prefix_scan(maps)[:-1, DONE]
    marks, state, news = np.empty((chunk, m), np.uint8), start, NEW.ravel()
    for i, row in enumerate(grid):
        at = row * 8 + state
        marks[i] = news[at]
        state = flat[at]
    return marks.T.ravel()[:n].astype(bool)


class CharClasses:
    """Class of each code point, asked from the library's own pre-tokenizer the first time it occurs."""

    def __init__(self, pre_tokenizer):
        self.pre = pre_tokenizer
        self.known = np.full(0x110000, 255, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        got = self.known[points]
        if (got == 255).any():
            for p in np.unique(points[got == 255]):
                self.known[p] = self.probe(chr(p)) if not 0xD800 <= p < 0xE000 else OTHER
            got = self.known[points]
        return got

    def probe(self, c: str) -> int:
        if c == " ":
            return SPACE
        joins = lambda s: len(self.pre.pre_tokenize_str(s)) == 1
        return LETTER if joins(c + "x") else NUMBER if joins(c + "1") else OTHER if joins(c + "!") else BLANK


class CountTransducer:
    """Bytes in, number of tokens out; a word begins in state 0.

    State: the longest read suffix that can still begin a token, the last token of the encoding of each prefix that
    ends inside it, and those prefixes' token counts relative to the newest.  The next encoding's last token is the one
    vocabulary token that ends at the new byte and holds with the token before it.  A transition carries the change in
    the number of tokens.  Transitions are compiled on first use into a hash table of arrays.
    """

    def __init__(self, merges: Merges):
        self.merges, self.pairs = merges, PairTable(merges)
        self.ids = {t: i for i, t in merges.token_bytes.items() if self.pairs.stands(i)}
        self.prefixes = {t[:k] for t in self.ids for k in range(len(t) + 1)}
        self.clear()

    def clear(self) -> None:
        self.states = [(b"", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self._tables(16)

    def _tables(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.moves = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def compile(self, state: int, byte: int) -> int:
        """The transition of a state and a byte: next state << 16 | 32768 + change in the number of tokens."""
        suffix, tokens, counts = self.states[state]
        # tokens[k], counts[k]: of the prefix that ends after suffix[:k]; counts relative to the newest prefix; a
        # None token is the word's beginning
        read, ids, holds = suffix + bytes([byte]), self.ids, self.pairs.holds
        for k in range(len(read)):
            token = ids.get(read[k:])
            if token is not None and (tokens[k] is None or holds(tokens[k], token)):
                delta = counts[k] + 1
                break
        else:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        cut = 0
        while read[cut:] not in self.prefixes:
            cut += 1
        new = (read[cut:], (*tokens, token)[cut:], tuple([c - delta for c in counts[cut:]] + [0]))
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
        return at << 16 | 32768 + delta

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty one that it would take."""
        slot = ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            todo = todo[(held != keys[todo]) & (held >= 0)]
        return slot

    def _add(self, keys: np.ndarray, moves: np.ndarray) -> None:
        if 2 * (self.used + len(keys)) > len(self.keys):
            own = self.keys >= 0
            keys, moves = np.concatenate([self.keys[own], keys]), np.concatenate([self.moves[own], moves])
            self._tables(max(self.bits, int(4 * len(keys) - 1).bit_length()))
        self.used += len(keys)
        while len(keys):  # keys that want the same slot go one after the other
            slot = self._slots(keys)
            _, first = np.unique(slot, return_index=True)
            self.keys[slot[first]], self.moves[slot[first]] = keys[first], moves[first]
            keys, moves = np.delete(keys, first), np.delete(moves, first)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes in the number of tokens."""
        keys = state << 8 | byte
        slot = self._slots(keys)
        missing = self.keys[slot] < 0
        if missing.any():
            new = np.unique(keys[missing])
            self._add(new, np.array([self.compile(k >> 8, k & 255) for k in new.tolist()], np.int64))
            slot = self._slots(keys)
        moves = self.moves[slot]
        return moves >> 16, (moves & 0xFFFF) - 32768

    def run(self, data: np.ndarray, begins: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maps of chunks: last state and emitted tokens of each, from its entry state; all chunks go in step."""
        order = np.argsort(-length, kind="stable")
        start, length, state = start[order], length[order], entry[order].copy()
        total = np.zeros(len(order), np.int64)
        going = np.searchsorted(-length, -np.arange(int(length.max()) if len(length) else 0), "left")
        for k, n in enumerate(going.tolist()):
            at = start[:n] + k
            state[:n], emitted = self.step(np.where(begins[at], 0, state[:n]), data[at])
            total[:n] += emitted
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def totals(self, data: np.ndarray, begins: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Number of tokens before each of ``pieces`` (positions where words begin) and at the end.

        The text is cut into chunks where words begin.  A word of several chunks is cut inside: such a chunk is run from
        the state that the bytes before it lead to from a fresh start, which is nearly always the true one; if the scan
        of the maps shows another, the chunk is run again from that.
        """
        n = len(data)
        if not n:
            return np.zeros(len(pieces) + 1, np.int64)
        at = np.flatnonzero(begins)
        first = np.append(True, at[1:] // CHUNK != at[:-1] // CHUNK)
        first[np.searchsorted(at, pieces)] = True
        start = at[first]
        length = np.diff(np.append(start, n))
        inner = np.maximum(-(-length // CHUNK) - 1, 0) * (length > 4 * CHUNK)
        if inner.any():
            owner = np.repeat(np.arange(len(start)), inner + 1)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(inner + 1) - inner - 1, inner + 1)
            start = start[owner] + nth * CHUNK
            length = np.diff(np.append(start, n))
        fresh = begins[start]
        entry = np.where(fresh, ANY, 0)
        cut = np.flatnonzero(~fresh)
        if len(cut):
            entry[cut] = self.run(data, begins, start[cut] - WARM, np.full(len(cut), WARM), np.zeros(len(cut), np.int64))[0]
        last, emitted = self.run(data, begins, start, length, np.maximum(entry, 0))
        while True:
            fits, sums = scan_maps(entry, last, emitted)
            wrong = np.flatnonzero(~fits)
            if not len(wrong):
                break
            entry[wrong] = last[wrong - 1]
            last[wrong], emitted[wrong] = self.run(data, begins, start[wrong], length[wrong], entry[wrong])
        sums = np.append(0, sums)
        return np.append(sums[np.searchsorted(start, pieces)], sums[-1])


def scan_maps(entry: np.ndarray, last: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix composition of chunk maps (entry state, or ANY; last state; emitted tokens), in log2(n) rounds.

    A map fits if the one before it ends in a state that it takes.  Composed maps add up their tokens.
    """
    fits = (entry == ANY) | (entry == np.append(-2, last[:-1]))
    sums, step = emitted.copy(), 1
    while step < len(sums):
        sums[step:] = sums[step:] + sums[:-step]
        step *= 2
    return fits, sums


class Counter:
    """Token counts of blocks of documents for one byte-level vocabulary."""

    def __init__(self, path: str):
        merges = load(path)
        self.classes = CharClasses(Tokenizer.from_file(path).pre_tokenizer)
        self.machine = CountTransducer(merges)
        self.added = re.compile("|".join(map(re.escape, sorted(merges.added, key=len, reverse=True))).encode()) if merges.added else None
        self.sliced = not any(c.isspace() for t in merges.added for c in t)

    def pieces(self, data: bytes, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, document, added tokens before it) of the text between added tokens; long text in slices."""
        found = self.added is not None and self.added.search(data) is not None
        for d, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            more = 0
            if found:
                for m in self.added.finditer(data, s, e):
                    yield from self.slices(data, s, m.start(), d, more)
                    s, more = m.end(), 1
            yield from self.slices(data, s, e, d, more)

    def slices(self, data: bytes, s: int, e: int, d: int, more: int) -> Iterator[tuple[int, int, int, int]]:
        """A text of more than SLICE bytes is cut where a letter or digit is followed by a blank: a word always begins."""
        while self.sliced and e - s > SLICE:
            m = _CUT.search(data, s + SLICE - 1, e)
            if m is None:
                break
            yield s, m.start() + 1, d, more
            s, more = m.start() + 1, 0
        yield s, e, d, more

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        totals = np.zeros(len(offsets) - 1, np.int64)
        held: list[tuple[int, int, int]] = []
        size = 0
        for s, e, d, more in self.pieces(raw, offsets):
            totals[d] += more
            if e > s:
                held.append((s, e, d))
                size += e - s
            if size >= SLICE:
                self._count(raw, held, totals)
                held.clear()
                size = 0
        if held:
            self._count(raw, held, totals)
        return totals

    def _count(self, raw: bytes, held: list[tuple[int, int, int]], totals: np.ndarray) -> None:
        start, end, owner = (np.array(x, np.int64) for x in zip(*held, strict=True))
        body = raw[start[0] : end[-1]] if (start[1:] == end[:-1]).all() else b"".join([raw[s:e] for s, e, _ in held])
        at = np.concatenate([[0], np.cumsum(end - start)])
        begins = np.zeros(len(body), bool)
        begins[self.word_starts(body, at)] = True
        if len(self.machine.states) > MOST_STATES:
            self.machine.clear()
        sums = self.machine.totals(np.frombuffer(body, np.uint8).astype(np.int64), begins, at[:-1])
        np.add.at(totals, owner, np.diff(sums))

    def word_starts(self, body: bytes, at: np.ndarray) -> np.ndarray:
        """Byte positions where words begin; ``at``: where pieces begin, and the end."""
        points = np.frombuffer(body.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.flatnonzero((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)
        first = np.searchsorted(lead, at[:-1])
        kind = self.classes.of(points)
        n = len(points)
        ends = np.zeros(n + 1, bool)
        ends[first] = True
        ends[n] = True
        blank = kind >= SPACE
        more = np.append(blank[1:], False) | ends[1:]
        symbol = kind.astype(np.uint8)  # S_L, S_N and S_O are the classes' own numbers
        symbol[blank & more] = S_RUN
        symbol[(kind == SPACE) & ~more] = S_SP
        symbol[(kind == BLANK) & ~more] = S_END
        quote = np.flatnonzero(points == ord("'"))
        if len(quote):
            far = np.concatenate([points, np.zeros(2, np.uint32)])
            inside1 = ~ends[np.minimum(quote + 1, n)]
            inside2 = inside1 & ~ends[np.minimum(quote + 2, n)]
            a, b = far[quote + 1], far[quote + 2]
            two = inside1 & np.isin(a, [ord(c) for c in "stmd"])
            three = inside2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            symbol[quote[two]] = S_A2
            symbol[quote[three]] = S_A3
        # a reset before each piece: every piece begins in the state DONE
        reset = np.insert(symbol, first, S_RESET)
        keep = np.ones(len(reset), bool)
        keep[first + np.arange(len(first))] = False
        return lead[run_chunks(reset)[keep]]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


LASTING["counts"] = counter.cache_clear


def count_tokens(docs: DataFrame, tokenizer: str, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > over) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column(1), "counts")
            tokens = counter(tokenizer).count(data, offsets)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > over)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
