"""A query engine for typed tables with an integer key, on Spark DataFrames."""

from strandgrid.plans.errors import QueryError
from strandgrid.plans.expr import field
from strandgrid.plans.query import Query
from strandgrid.plans.schema import TableSchema
from strandgrid.sources.tables import over, sharded

__all__ = ["Query", "QueryError", "TableSchema", "field", "over", "sharded"]
