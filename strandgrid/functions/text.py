"""Token sets of text columns and of search strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters, besides the space, that separate words in full mode.
SEPARATORS = "~#@$^&*=,.!?:;-\"'`()[]<>{}/·–|↑•%°„_\\"
#: White space (the Unicode property), for Java's regular expressions and for SQL.
SPACES = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

_ANY_SPACE = f"[{SPACES}]+"
_SEPARATOR = "[ " + "".join("\\" + c if c.isascii() else c for c in SEPARATORS) + "]+"
_EDGES = f"^[{SPACES}]+|[{SPACES}]+$"


def query_words(query: str) -> list[str]:
    """A search string is split at white space only."""
    return list(dict.fromkeys(query.lower().split()))


def tokens(column: Column, mode: str = "words") -> Column:
    """array<string> of the distinct tokens of a text; NULL for NULL.

    ``spaces``: what stands between white space.  ``words``: that, and what stands between separators and spaces.
    """
    low = F.lower(column)
    plain = F.filter(F.split(low, _ANY_SPACE), lambda x: x != "")
    if mode == "spaces":
        return F.array_distinct(plain)
    parts = F.transform(F.split(low, _SEPARATOR), lambda x: F.regexp_replace(x, _EDGES, ""))
    return F.array_union(plain, F.filter(parts, lambda x: x != ""))


def _quoted(word: str) -> str:
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _splits(word: str) -> bool:
    return any(c in SEPARATORS for c in word)


def _is_token(word: str, mode: str) -> str:
    """A pattern that finds a text with ``word`` among its tokens: between white space, or (in full mode) a piece between
    separators and spaces that is the word but for white space at its edges."""
    w = _quoted(word)
    plain = f"(?:\\A|[{SPACES}]){w}(?:\\z|[{SPACES}])"
    if mode == "spaces" or _splits(word):
        return plain
    return f"{plain}|(?:\\A|{_SEPARATOR[:-1]})[{SPACES}]*{w}[{SPACES}]*(?:\\z|{_SEPARATOR[:-1]})"


def _begins_token(word: str, mode: str) -> str:
    """A pattern that finds a text with a token that ``word`` begins: after white space or (in full mode) a separator."""
    before = f"[{SPACES}]" if mode == "spaces" or _splits(word) else f"[{SPACES}{_SEPARATOR[1:-2]}]"
    return f"(?:\\A|{before}){_quoted(word)}"


def _all_found(column: Column, query: str, mode: str, pattern) -> Column:
    """An empty query holds for all rows, a blank one for none.  No token set is built: each word is one search of the
    text, after a plain substring test that most rows fail."""
    if query == "":
        return F.lit(True)
    words = query_words(query)
    if not words:
        return F.lit(False)
    low, out = F.lower(column), F.lit(True)
    for w in words:
        out = out & F.contains(low, F.lit(w))
    for w in words:
        out = out & F.rlike(low, F.lit(pattern(w, mode)))
    return F.coalesce(out, F.lit(False))


def has_all_words(column: Column, query: str, mode: str) -> Column:
    """Every word of the query is a token of the text."""
    return _all_found(column, query, mode, _is_token)


def has_all_prefixes(column: Column, query: str, mode: str) -> Column:
    """Every word of the query begins a token of the text."""
    return _all_found(column, query, mode, _begins_token)
