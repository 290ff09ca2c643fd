"""Scalar and aggregate semantics that differ from Spark's defaults, as column expressions (all run in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import ErrorCode, QueryError

NUMERIC = {"INT", "BIGINT", "DOUBLE", "FLOAT", "SMALLINT", "TINYINT"}
WHOLE = {"INT", "BIGINT", "SMALLINT", "TINYINT"}


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("DECIMAL")


def comparable(a: str, b: str, what: str) -> None:
    """Numbers compare with numbers, everything else with its own type; nothing is converted silently."""
    if a != b and not (is_numeric(a) and is_numeric(b)):
        raise QueryError(ErrorCode.TYPE_MISMATCH, f"Cannot compare {a} with {b} in: {what}.")


def product_type(a: str, b: str, what: str) -> str:
    if not (is_numeric(a) and is_numeric(b)):
        raise QueryError(ErrorCode.TYPE_MISMATCH, f"Cannot multiply {a} by {b} in: {what}.")
    if a == b:
        return a
    return "DOUBLE" if not {a, b} <= WHOLE else "BIGINT"


def wrapping_product(a: Column, b: Column) -> Column:
    """32-bit product that wraps around, for parity where overflow must not be an error."""
    wide = a.cast("bigint") * b
    return (F.pmod(wide + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def aggregate(function: str, value: Column | None, kind: str) -> tuple[Column, str]:
    """(column, result type). Whole numbers keep their type: sums must fit it, averages are cut toward zero."""
    if function == "COUNT":
        return F.count(F.lit(1) if value is None else value).cast("int"), "INT"
    if function in ("MIN", "MAX"):
        return (F.min if function == "MIN" else F.max)(value), kind
    if not is_numeric(kind):
        raise QueryError(ErrorCode.TYPE_MISMATCH, f"{function} needs a numeric argument, not {kind}.")
    if kind not in WHOLE:
        return (F.sum(value), "DOUBLE") if function == "SUM" else (F.avg(value), "DOUBLE")
    out = "INT" if kind == "INT" else "BIGINT"
    total = F.sum(value.cast("bigint"))
    if function == "AVG":
        total = F.call_function("div", total, F.nullif(F.count(value), F.lit(0)))
    return total.cast("int" if out == "INT" else "bigint"), out
