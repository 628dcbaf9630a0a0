"""Errors that callers can expect."""


class EngineError(RuntimeError):
    """Wrong use of a database, table or query."""
