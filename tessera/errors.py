"""Errors of the dialect and of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors this package raises on purpose."""


class SqlQueryError(EngineError):
    """An error in a statement; ``position`` is the place in its text, from 0, where known."""

    def __init__(self, message: str, text: str = "", position: int | None = None) -> None:
        self.position = position
        if position is not None:
            before = text[:position]
            message = f"{message} (line {before.count(chr(10)) + 1}, column {position - before.rfind(chr(10))}: {text[position : position + 20]!r})"
        super().__init__(message)


class SqlLexicalError(SqlQueryError):
    """Bad character, unterminated string, malformed number, or a statement that is too long."""


class SqlSyntaxError(SqlQueryError):
    """The statement doesn't follow the grammar."""


class SqlUnsupportedError(SqlQueryError):
    """A known construct outside this dialect."""


class SqlLimitError(SqlQueryError):
    """Conditions nested too deeply."""


class SqlBindingError(SqlQueryError):
    """Names, types or rules of meaning are broken."""


class SqlUnknownTableError(SqlBindingError):
    pass


class SqlUnknownColumnError(SqlBindingError):
    pass


class DuplicateError(EngineError):
    """A unique column would hold a value twice."""


class MaintenanceError(EngineError):
    """A change of rows failed; the table is as before."""


class TransactionError(EngineError):
    """A statement that the state of the session doesn't allow."""


class LockTimeout(TransactionError):
    pass


class DeadlockVictim(TransactionError):
    """Waiting would close a circle of sessions that wait for each other."""


class ExecutionError(EngineError):
    """A statement failed while it ran; ``report`` is what EXPLAIN ANALYZE knows by then."""

    def __init__(self, message: str, report: str) -> None:
        super().__init__(message)
        self.report = report
