"""Column registry of a table: types, search mode, vectors, nullability, and the rules a saved value must meet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgrid.plans.errors import QueryError

#: Fixed limits of the data model.
MAX_CHARS = 1_048_576
MAX_BYTES = 1_048_576
MAX_NEW_ID = (2**31 - 1) // 2
STEP = 1000

INTEGERS = (T.IntegerType, T.LongType)
NUMBERS = (T.IntegerType, T.LongType, T.DoubleType, T.DecimalType)
DATES = (T.TimestampType, T.TimestampNTZType)


def is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)


@dataclass
class TableSchema:
    """What the engine knows of a table besides its Spark schema.

    ``search``: column to "words" (full tokenizer) or "spaces".  Columns whose names end in Search or SearchS get theirs
    by default.  ``required``: columns that can't be NULL.  ``vectors``: vector columns that can be searched, by default
    those whose names end in L2.
    """

    key: str = "Id"
    search: dict[str, str] = field(default_factory=dict)
    vectors: set[str] = field(default_factory=set)
    required: set[str] = field(default_factory=set)

    def search_mode(self, column: str) -> str:
        if column in self.search:
            return self.search[column]
        low = column.lower()
        if low.endswith("searchs"):
            return "spaces"
        if low.endswith("search"):
            return "words"
        raise QueryError(f"column {column} is not searchable: name it ...Search or ...SearchS, or register it")

    def is_searchable_vector(self, column: str) -> bool:
        return column in self.vectors or column.lower().endswith("l2")

    def check_types(self, schema: T.StructType) -> None:
        """Reject types that the model doesn't have."""
        if self.key not in schema.fieldNames():
            raise QueryError(f"a table needs its key column {self.key}")
        if not isinstance(schema[self.key].dataType, INTEGERS):
            raise QueryError(f"the key {self.key} must be an integer")
        for f in schema:
            ok = isinstance(f.dataType, (*NUMBERS, *DATES, T.StringType, T.BinaryType)) or is_vector(f.dataType)
            if not ok:
                raise QueryError(f"column {f.name}: type {f.dataType.simpleString()} is not supported")

    def stored(self, name: str, kind: T.DataType) -> Column:
        """The value that is saved for a column; the job fails on a value that the model rejects."""
        c = F.col(name)
        fail = lambda bad, why: F.when(bad, F.raise_error(F.lit(f"column {name}: {why}"))).otherwise(c)
        if isinstance(kind, T.DoubleType):
            c = fail(F.isnan(c) | (F.abs(c) == float("inf")), "NaN and infinity are not supported") + F.lit(0.0)
        elif isinstance(kind, T.StringType):
            c = fail(F.length(c) > MAX_CHARS, "string too long")
            c = F.nullif(c, F.lit(""))
        elif isinstance(kind, T.BinaryType):
            c = fail(F.length(c) > MAX_BYTES, "binary too long")
            c = F.when(F.length(c) > 0, c)
        if name in self.required:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"column {name}: NULL in a column that can't be NULL"))).otherwise(c)
        return c.cast(kind).alias(name)

    def normalised(self, df: DataFrame) -> DataFrame:
        self.check_types(df.schema)
        return df.select([self.stored(f.name, f.dataType) for f in df.schema])


def evolved(old: T.StructType, new: T.StructType) -> T.StructType:
    """The schema after rows of ``new`` come to a table of ``old``: columns are only added, types never change."""
    out = list(old)
    for f in new:
        known = next((x for x in old if x.name == f.name), None)
        if known is None:
            out.append(T.StructField(f.name, f.dataType, True))
        elif known.dataType != f.dataType:
            raise QueryError(f"column {f.name}: type can't be changed from {known.dataType.simpleString()} to {f.dataType.simpleString()}")
    return T.StructType(out)


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``; those it lacks are NULL."""
    have = set(df.columns)
    return df.select([F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def default_of(kind: T.DataType) -> Column:
    if isinstance(kind, DATES):
        return F.lit("0001-01-01 00:00:00").cast(kind)
    if isinstance(kind, NUMBERS):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)
