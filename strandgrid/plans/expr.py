"""Filter expressions: a bare column against a value, joined by & and |."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgrid.plans.errors import QueryError
from strandgrid.plans.schema import DATES, NUMBERS, is_vector


class Node:
    def __and__(self, other: "Node") -> "Node":
        return Both("&", self, _node(other))

    def __or__(self, other: "Node") -> "Node":
        return Both("|", self, _node(other))

    def __bool__(self) -> bool:
        raise QueryError("use & and | with parentheses; 'and', 'or', 'not' and chained comparisons can't be translated")


def _node(x: Any) -> "Node":
    if not isinstance(x, Node):
        raise QueryError("both sides of & and | must be comparisons")
    return x


@dataclass(frozen=True, eq=False)
class Compare(Node):
    op: str
    column: str
    value: Any


@dataclass(frozen=True, eq=False)
class Both(Node):
    op: str
    left: Node
    right: Node


class Field:
    """A column on the left of a comparison.  Anything but a comparison with a value is rejected."""

    __hash__ = None

    def __init__(self, name: str):
        self.name = name

    def _compare(self, op: str, value: Any) -> Compare:
        if isinstance(value, (Field, Node, Column)):
            raise QueryError("the right side of a comparison must be a value, not a column")
        return Compare(op, self.name, value)

    def __eq__(self, value):  # type: ignore[override]
        return self._compare("==", value)

    def __ne__(self, value):  # type: ignore[override]
        return self._compare("!=", value)

    def __lt__(self, value):
        return self._compare("<", value)

    def __le__(self, value):
        return self._compare("<=", value)

    def __gt__(self, value):
        return self._compare(">", value)

    def __ge__(self, value):
        return self._compare(">=", value)

    def _reject(self, *_):
        raise QueryError(f"column {self.name}: the left side of a comparison must be a bare column")

    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __mod__ = __neg__ = __invert__ = __getitem__ = _reject
    __bool__ = _reject


def field(name: str) -> Field:
    return Field(name)


def kind_of(schema: T.StructType, column: str) -> T.DataType:
    if column not in schema.fieldNames():
        raise QueryError(f"no column {column}")
    return schema[column].dataType


def literal(value: Any, kind: T.DataType, column: str) -> Column:
    """``value`` as a constant of the column's type; a value that would need the column converted is rejected."""
    whole = isinstance(value, int) and not isinstance(value, bool)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        ok = whole
    elif isinstance(kind, T.DoubleType):
        ok = whole or isinstance(value, float)
    elif isinstance(kind, T.DecimalType):
        ok = whole or isinstance(value, decimal.Decimal)
    elif isinstance(kind, DATES):
        ok = isinstance(value, dt.datetime)
    elif isinstance(kind, T.StringType):
        ok = isinstance(value, str)
    else:
        ok = False
    if not ok:
        raise QueryError(f"column {column} of type {kind.simpleString()} can't be compared with {type(value).__name__}")
    if whole and isinstance(kind, T.IntegerType) and not -(2**31) <= value < 2**31:
        return F.lit(value).cast("long")
    return F.lit(value).cast(kind)


def is_null(column: str, kind: T.DataType) -> Column:
    c = F.col(column)
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, T.BinaryType):
        return c.isNull() | (F.length(c) == 0)
    return c.isNull()


def predicate(node: Node, schema: T.StructType) -> Column:
    """The Column of a filter tree.  NULLs: == and the order comparisons are false, != is true."""
    if isinstance(node, Both):
        left, right = predicate(node.left, schema), predicate(node.right, schema)
        return left & right if node.op == "&" else left | right
    if not isinstance(node, Compare):
        raise QueryError("a filter must be a comparison, such as field('x') > 1")
    kind = kind_of(schema, node.column)
    c, op, value = F.col(node.column), node.op, node.value
    empty = value is None or isinstance(value, (str, bytes)) and len(value) == 0
    if op in ("==", "!=") and empty:
        null = is_null(node.column, kind)
        return null if op == "==" else ~null
    if isinstance(kind, T.BinaryType) or is_vector(kind):
        raise QueryError(f"column {node.column}: only == None and != None are supported for {kind.simpleString()}")
    if op not in ("==", "!="):
        if value is None:
            raise QueryError(f"column {node.column}: can't evaluate {op} None")
        if not isinstance(kind, (*NUMBERS, *DATES)):
            raise QueryError(f"column {node.column}: {op} is not supported for {kind.simpleString()}")
    v = literal(value, kind, node.column)
    if isinstance(kind, T.StringType):
        c, v = F.lower(c), F.lit(value.lower())
    ops = {"==": lambda: c == v, "!=": lambda: ~c.eqNullSafe(v), "<": lambda: c < v, "<=": lambda: c <= v, ">": lambda: c > v, ">=": lambda: c >= v}
    return ops[op]()
