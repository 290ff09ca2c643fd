"""A validated query to a DataFrame: resolution and type checks come first, so every user error is met before a job starts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import ErrorCode, QueryError
from tessera.functions import semantics
from tessera.operators import relational as ops
from tessera.plans.ast import Column, Comparison, Expr, Literal, Product, Query, columns_of
from tessera.plans.logical import split_where
from tessera.sources.catalog import Catalog, TableMeta


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    qualified_name: str | None
    type: str


@dataclass(frozen=True)
class Compiled:
    frame: DataFrame  # unique internal names
    columns: tuple[ColumnMeta, ...]
    scans: tuple[TableMeta, ...]
    limit: int | None
    streaming: bool  # no operator needs all rows before the first comes out


_OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


class Compiler:
    def __init__(self, catalog: Catalog, query: Query, algorithm: str | None = None, observe=None):
        self.q, self.algorithm = query, algorithm
        self.watch = observe or (lambda df: df)
        self.tables = {t: catalog.get(t) for t in query.tables}
        self.catalog = catalog

    def type_of(self, c: Column) -> str:
        meta = self.tables.get(c.table)
        if meta is None:
            raise QueryError(ErrorCode.UNKNOWN_TABLE, f"Table '{c.table}' not found in FROM. Available tables: {', '.join(self.catalog.names() if c.table not in self.catalog else self.q.tables)}.")
        if c.name not in meta.columns:
            raise QueryError(ErrorCode.UNKNOWN_COLUMN, f"Column '{c.table}.{c.written or c.name}' not found. Available: {', '.join(f'{c.table}.{x}' for x in meta.columns)}.")
        return meta.types[meta.columns.index(c.name)]

    def name(self, c: Column) -> str:
        self.type_of(c)
        return f"{c.table}.{c.name}"

    def expr(self, e: Expr) -> tuple[SparkColumn, str]:
        if isinstance(e, Column):
            return ops.col(self.name(e)), self.type_of(e)
        if isinstance(e, Literal):
            return F.lit(e.value), "STRING" if isinstance(e.value, str) else "INT"
        assert isinstance(e, Product)
        (a, x), (b, y) = self.expr(e.left), self.expr(e.right)
        return a * b, semantics.product_type(x, y, str(e))

    def condition(self, conjuncts: list[Comparison]) -> SparkColumn | None:
        out = []
        for c in conjuncts:
            (a, x), (b, y) = self.expr(c.left), self.expr(c.right)
            semantics.comparable(x, y, str(c))
            out.append(_OPS[c.op](a, b))
        return reduce(lambda a, b: a & b, out) if out else None

    def compile(self) -> Compiled:
        q = self.q
        for c in [*q.columns, *q.group_by, *(x for p in q.where for x in columns_of(p.left) + columns_of(p.right))]:
            self.type_of(c)
        joins, rest = split_where(q)
        df = self.watch(ops.scan(self.tables[q.tables[0]]))
        for table, conjuncts in zip(q.tables[1:], joins[1:], strict=True):
            df = self.watch(ops.join(df, self.watch(ops.scan(self.tables[table])), self.condition(conjuncts), self.algorithm if conjuncts else None))
        if rest:
            df = self.watch(ops.select(df, self.condition(rest)))
        if q.grouped:
            names, metas, df = self._aggregate(df)
        elif q.star:
            names = [f"{t}.{c}" for t in q.tables for c in self.tables[t].columns]
            metas = [ColumnMeta(c, f"{t}.{c}".lower() if len(q.tables) > 1 else None, k) for t in q.tables for c, k in zip(self.tables[t].columns, self.tables[t].types, strict=True)]
        else:
            names = [self.name(c) for c in q.columns]
            metas = [ColumnMeta(c.name, f"{c.table}.{c.name}".lower(), self.type_of(c)) for c in q.columns]
        order = []
        for c in q.order_by:
            if (n := self.name(c)) not in names:
                raise QueryError(ErrorCode.UNKNOWN_COLUMN, f"Column '{c}' not found: ORDER BY needs a selected column. Available: {', '.join(names)}.")
            order.append(f"{names.index(n)}:{n}")
        df = ops.project(df, names)
        if q.distinct:
            df = ops.distinct(df)
        if order:
            df = ops.sort(df, order)
        return Compiled(df, tuple(metas), tuple(self.tables.values()), q.limit, not (q.grouped or q.distinct or order))

    def _aggregate(self, df: DataFrame) -> tuple[list[str], list[ColumnMeta], DataFrame]:
        """Selected group columns first, then the calls, whatever their order in SELECT."""
        q = self.q
        keys = list(dict.fromkeys(self.name(c) for c in q.group_by))
        calls, metas = [], [ColumnMeta(c.name, f"{c.table}.{c.name}".lower(), self.type_of(c)) for c in q.columns]
        for i, a in enumerate(q.aggregates):
            value, kind = (None, "INT") if a.argument is None else self.expr(a.argument)
            out, kind = semantics.aggregate(a.function, value, kind)
            arg = "*" if a.argument is None else f"{a.argument.table}.{a.argument.name}" if isinstance(a.argument, Column) else str(i)
            calls.append((f"#{i}", out))
            metas.append(ColumnMeta(f"{a.function}({arg})".lower(), None, kind))
        df = self.watch(ops.aggregate(df, keys, calls))
        return [self.name(c) for c in q.columns] + [n for n, _ in calls], metas, df
