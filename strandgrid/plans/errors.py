class QueryError(ValueError):
    """A query or a write that the engine rejects; the message says why."""
