"""The validated query: what is left of Catalyst's unresolved plan after the whitelist."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Column:
    table: str
    name: str  # lower case
    written: str = field(default="", compare=False)

    def __str__(self) -> str:
        return f"{self.table}.{self.written or self.name}"


@dataclass(frozen=True)
class Literal:
    value: int | str

    def __str__(self) -> str:
        return f"'{self.value}'" if isinstance(self.value, str) else str(self.value)


@dataclass(frozen=True)
class Product:
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left} * {self.right}"


Expr = Column | Literal | Product


@dataclass(frozen=True)
class Comparison:
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"

    def tables(self) -> set[str]:
        return {c.table for c in columns_of(self.left) + columns_of(self.right)}


@dataclass(frozen=True)
class Aggregate:
    function: str  # upper case
    argument: Expr | None  # None: *

    def __str__(self) -> str:
        arg = "*" if self.argument is None else f"{self.argument.table}.{self.argument.name}" if isinstance(self.argument, Column) else str(self.argument)
        return f"{self.function}({arg})"


@dataclass(frozen=True)
class Query:
    tables: tuple[str, ...]
    star: bool
    columns: tuple[Column, ...]  # selected, without aggregates
    aggregates: tuple[Aggregate, ...]
    where: tuple[Comparison, ...]
    group_by: tuple[Column, ...]
    distinct: bool
    order_by: tuple[Column, ...]
    limit: int | None

    @property
    def grouped(self) -> bool:
        return bool(self.aggregates or self.group_by)


def columns_of(e: Expr) -> list[Column]:
    if isinstance(e, Product):
        return columns_of(e.left) + columns_of(e.right)
    return [e] if isinstance(e, Column) else []
