"""Bit signatures of token sets: three hashes a token, a superset test for searches.

The hashes are built from FNV-1a (32 bit), DJB2 and SDBM (64 bit) over UTF-16 code units, computed for a whole batch of
tokens at once.  A signature is packed into 64-bit words, so the test is a few bitwise ANDs in generated code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandgrid.functions.text import SEPARATORS, SPACES, query_words
from strandgrid.plans.errors import QueryError

#: Fixed values of the three hashes.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
DJB2_BASIS, DJB2_FACTOR = 5381, 33
SDBM_FACTOR = 65599

_PLAIN = re.compile(f"[^{SPACES}]+")
_SPACE_CHARACTERS = "".join(chr(c) for c in range(0x10000) if re.match(f"[{SPACES}]", chr(c)))
#: White space to str.split, but not the Unicode property.
_NO_SPACES = "\x1c\x1d\x1e\x1f"
#: Bytes of text and bits of signatures that one step works on; they bound the memory of a Python worker.
BLOCK_BYTES, BLOCK_BITS = 1 << 20, 1 << 23
#: So few words are hashed one by one.
FEW = 8


def check_size(bits: int, batch: int) -> None:
    if bits <= 0 or bits % 8:
        raise QueryError("the number of bits must be a multiple of 8")
    if batch <= 0 or batch % 1024:
        raise QueryError("the batch must be a multiple of 1024")


def positions(words: list[str], bits: int) -> np.ndarray:
    """Three bit positions for each word (n x 3).

    All words take one code unit in a step, the longest first, so those that have one left stay a prefix.
    """
    n = len(words)
    units = np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), "<u2")
    size = np.fromiter(map(len, words), np.int64, n)
    if int(size.sum()) != len(units):  # some characters are two units
        size = np.fromiter((len(w.encode("utf-16-le", "surrogatepass")) // 2 for w in words), np.int64, n)
    order = np.argsort(-size, kind="stable")
    start, size = (np.cumsum(size) - size)[order], size[order]
    fnv, djb, sdbm = np.full(n, FNV_BASIS, np.uint64), np.full(n, DJB2_BASIS, np.uint64), np.zeros(n, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    k, left = 0, int(np.count_nonzero(size))
    while left > FEW:
        c, f, d, s = units[start[:left] + k].astype(np.uint64), fnv[:left], djb[:left], sdbm[:left]
        f ^= c
        f *= np.uint64(FNV_PRIME)
        f &= low
        d *= np.uint64(DJB2_FACTOR)
        d += c
        s *= np.uint64(SDBM_FACTOR)
        s += c
        k += 1
        left = int(np.searchsorted(-size[:left], -k))
    for w in range(left):
        f, d, s = int(fnv[w]), int(djb[w]), int(sdbm[w])
        for at in range(int(start[w]) + k, int(start[w] + size[w]), BLOCK_BYTES):
            for c in units[at : min(at + BLOCK_BYTES, int(start[w] + size[w]))].tolist():
                f = (f ^ c) * FNV_PRIME & 0xFFFFFFFF
                d = d * DJB2_FACTOR + c & 0xFFFFFFFFFFFFFFFF
                s = c + s * SDBM_FACTOR & 0xFFFFFFFFFFFFFFFF
        fnv[w], djb[w], sdbm[w] = f, d, s
    out = np.empty((n, 3), np.uint64)
    out[order] = np.stack([fnv, djb, sdbm], 1) % np.uint64(bits)
    return out


def token_set(low: str, mode: str) -> set[str]:
    """The distinct tokens of a lower-cased text; as text.tokens gives them."""
    out = set(_PLAIN.findall(low) if any(c in low for c in _NO_SPACES) else low.split())
    if mode != "spaces":
        for c in SEPARATORS:
            low = low.replace(c, " ")
        out.update([x.strip(_SPACE_CHARACTERS) for x in set(low.split(" ")) - out])
        out.discard("")
    return out


def packed(texts: list[str | None], bits: int, mode: str) -> np.ndarray:
    """The signatures of some texts: one row each of 64-bit words, bit b in word b // 64."""
    sets = [token_set(x, mode) if x is not None else () for x in texts]
    # a token is hashed for each text that has it: that takes less time than to look it up
    at = positions(list(chain.from_iterable(sets)), bits).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in sets])
    out = np.zeros((len(texts), -(-bits // 64) * 64), bool)
    for h in range(3):
        out[row, at[:, h]] = True
    return np.packbits(out, axis=1, bitorder="little").view("<i8")


def blocks(rows: pa.Array, bits: int) -> Iterator[pa.Array]:
    """Slices of at most BLOCK_BYTES of text and BLOCK_BITS of signatures; a text beyond that is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    most, k = max(1, BLOCK_BITS // bits), 0
    while k < len(rows):
        before = int(ends[k - 1]) if k else 0
        to = min(max(k + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right"))), k + most)
        yield rows.slice(k, to - k)
        k = to


def hashed(rows: pa.Array, bits: int, mode: str) -> pa.Array:
    """The signatures of an Arrow batch of lower-cased texts, made block by block."""
    words = -(-bits // 64)
    made = [packed(part.to_pylist(), bits, mode).ravel() for part in blocks(rows, bits)]
    flat = np.concatenate(made) if made else np.zeros(0, np.int64)
    out = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * words), pa.array(flat))
    return pc.if_else(rows.is_null(), pa.scalar(None, out.type), out)


def signature(column: Column, bits: int, mode: str = "words") -> Column:
    """array<bigint> of a text's signature, packed; NULL for NULL.  Texts become tokens and bits in Arrow batches."""

    @F.arrow_udf("array<bigint>")
    def made(rows: pa.Array) -> pa.Array:
        return hashed(rows, bits, mode)

    return made(F.lower(column))


def share_of_bits(signature: Column, bits: int) -> Column:
    """The share of a packed signature's bits that are set."""
    return F.aggregate(signature, F.lit(0), lambda n, x: n + F.bit_count(x)) / F.lit(bits)


def may_match(signature: Column, query: str, bits: int) -> Column:
    """The packed signature holds all bits of the query's words: true for every match, and for some other rows."""
    words = query_words(query)
    if not words:
        return F.lit(query == "")
    masks: dict[int, int] = {}
    for b in np.unique(positions(words, bits)).tolist():
        masks[b // 64] = masks.get(b // 64, 0) | 1 << b % 64
    out = F.lit(True)
    for k, mask in sorted(masks.items()):
        wanted = F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")
        out = out & (signature.getItem(k).bitwiseAND(wanted) == wanted)
    return F.coalesce(out, F.lit(False))
