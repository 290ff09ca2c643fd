"""Typed failures: every error a caller can meet carries one of eight codes."""

from __future__ import annotations

from enum import Enum


class ErrorCode(str, Enum):
    PARSE_ERROR = "PARSE_ERROR"
    UNSUPPORTED_SQL = "UNSUPPORTED_SQL"
    UNKNOWN_TABLE = "UNKNOWN_TABLE"
    UNKNOWN_COLUMN = "UNKNOWN_COLUMN"
    TYPE_MISMATCH = "TYPE_MISMATCH"
    BUDGET_EXCEEDED = "BUDGET_EXCEEDED"
    DATA_ERROR = "DATA_ERROR"
    INTERNAL = "INTERNAL"


class BudgetKind(str, Enum):
    TUPLES = "TUPLES"
    TIME = "TIME"


class QueryError(Exception):
    def __init__(self, code: ErrorCode, message: str):
        super().__init__(message)
        self.code = code


class BudgetExceeded(QueryError):
    def __init__(self, kind: BudgetKind, message: str):
        super().__init__(ErrorCode.BUDGET_EXCEEDED, message)
        self.kind = kind


def unsupported(message: str) -> QueryError:
    return QueryError(ErrorCode.UNSUPPORTED_SQL, message)


#: Spark's error conditions, by class: bad data, and what our own checks should have caught.
_DATA = ("CAST_OVERFLOW", "ARITHMETIC_OVERFLOW", "CAST_INVALID_INPUT", "FAILED_READ_FILE", "MALFORMED_RECORD_IN_PARSING", "PATH_NOT_FOUND", "BINARY_ARITHMETIC_OVERFLOW")


def from_spark(ex: Exception) -> QueryError:
    """Map a failure inside Spark by its error class; paths and stack traces stay out of the message."""
    get = getattr(ex, "getCondition", None) or getattr(ex, "getErrorClass", None)
    condition = (get() if get else None) or ""
    text = str(ex)
    if condition.startswith(_DATA) or any(f"[{c}" in text for c in _DATA):  # a failed task's condition stands in the text
        if "MALFORMED" in text or "FAILED_READ_FILE" in text:
            return QueryError(ErrorCode.DATA_ERROR, "A source file could not be read: a row doesn't have the expected fields, or the file changed since it was registered.")
        return QueryError(ErrorCode.DATA_ERROR, "A value is out of range for its type (numeric overflow or an unreadable number).")
    return QueryError(ErrorCode.INTERNAL, f"Query failed inside the engine ({condition or type(ex).__name__}).")
