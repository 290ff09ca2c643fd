"""The relational operators, as DataFrame transformations; Catalyst chooses how they run.

Inside the engine a column is named ``table.column``, so joins never meet an ambiguous name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.catalog import TableMeta


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def scan(table: TableMeta) -> DataFrame:
    return table.frame.select(*(col(c).alias(f"{table.name}.{c}") for c in table.columns))


def select(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def project(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(col(n).alias(f"{i}:{n}") for i, n in enumerate(names)))


def join(left: DataFrame, right: DataFrame, condition: Column | None, algorithm: str | None = None) -> DataFrame:
    """Inner equi, theta or (without a condition) cross join; ``algorithm`` is a Spark join hint."""
    if algorithm:
        right = right.hint(algorithm)
    return left.crossJoin(right) if condition is None else left.join(right, condition, "inner")


def aggregate(df: DataFrame, keys: list[str], calls: list[tuple[str, Column]]) -> DataFrame:
    """Grouped, or over everything: then an empty input gives no row."""
    if not calls:
        return df.select(*map(col, keys)).distinct()
    out = [c.alias(n) for n, c in calls]
    if keys:
        return df.groupBy(*map(col, keys)).agg(*out)
    return df.agg(*out, F.count(F.lit(1)).alias("#rows")).filter(col("#rows") > 0).drop("#rows")


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort(df: DataFrame, names: list[str]) -> DataFrame:
    return df.orderBy(*(col(n).asc() for n in names))


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
