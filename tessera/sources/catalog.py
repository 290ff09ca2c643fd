"""Tables: strict CSV files (INT or STRING by inference, no nulls) and Parquet tables with Spark's types."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ErrorCode, QueryError

DATA_DIR = "data"
_CSV = {"quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "emptyValue": "", "encoding": "UTF-8"}
_INT = r"^[+-]?[0-9]+$"


@dataclass(frozen=True)
class TableMeta:
    name: str
    frame: DataFrame
    columns: tuple[str, ...]
    types: tuple[str, ...]
    row_count: int | None = None


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegerType):
        return "INT"
    return kind.simpleString().upper()


class Catalog:
    """Case-sensitive table names to tables; columns are lower-cased. Registration is atomic."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, TableMeta | Callable[[], TableMeta]] = {}
        self._lock = threading.Lock()

    @classmethod
    def from_directory(cls, spark: SparkSession, path: str) -> Catalog:
        """All ``data/*.csv`` files below a database directory."""
        catalog = cls(spark)
        top = os.path.join(path, DATA_DIR)
        if not os.path.isdir(top):
            raise QueryError(ErrorCode.DATA_ERROR, f"Database directory has no '{DATA_DIR}' folder.")
        for f in sorted(os.listdir(top)):
            if f.endswith(".csv"):
                catalog.register_csv(f.removesuffix(".csv"), os.path.join(top, f))
        return catalog

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, names: tuple[str, ...]) -> Catalog:
        """``<path>/<name>.parquet`` tables, read when first used."""
        catalog = cls(spark)
        for name in names:
            catalog._tables[name] = lambda name=name: frame_meta(name, spark.read.parquet(f"{path}/{name}.parquet"))
        return catalog

    def names(self) -> list[str]:
        return sorted(self._tables)

    def get(self, name: str) -> TableMeta:
        found = self._tables.get(name)
        if found is None:
            raise QueryError(ErrorCode.UNKNOWN_TABLE, f"Table '{name}' not found. Available tables: {', '.join(self.names())}.")
        if callable(found):
            found = self._tables[name] = found()
        return found

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def __len__(self) -> int:
        return len(self._tables)

    def register(self, meta: TableMeta) -> bool:
        """False if the name is taken; nothing changes then."""
        with self._lock:
            return self._tables.setdefault(meta.name, meta) is meta

    def register_csv(self, name: str, path: str) -> bool:
        return name not in self._tables and self.register(read_csv(self.spark, name, path))

    def register_frame(self, name: str, frame: DataFrame) -> bool:
        return self.register(frame_meta(name, frame))


def frame_meta(name: str, frame: DataFrame) -> TableMeta:
    columns = tuple(c.lower() for c in frame.columns)
    return TableMeta(name, frame.toDF(*columns), columns, tuple(type_name(f.dataType) for f in frame.schema))


def _has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may hold a line break: some line has an odd number of quotes. Only such a file must be read
    as a whole; any other is split into tasks by lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).agg(F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False))).first()[0])


def read_csv(spark: SparkSession, name: str, path: str) -> TableMeta:
    """One pass over the file finds its types (INT unless some cell is not one) and its rows."""
    try:
        head = spark.read.options(**_CSV, header=False).csv(path).first()
        cells = [(x or "").strip().lower() for x in head] if head is not None else []
        if not any(cells):
            raise QueryError(ErrorCode.DATA_ERROR, f"Table '{name}' has no header row.")
        twice = sorted({c for c in cells if cells.count(c) > 1})
        if twice:
            raise QueryError(ErrorCode.DATA_ERROR, f"Table '{name}' has a duplicate column: {', '.join(twice)}.")
        shape = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(cells))])
        raw = spark.read.schema(shape).options(**(_CSV | {"multiLine": _has_line_breaks(spark, path)}), header=True, enforceSchema=True, mode="FAILFAST").csv(path)
        text = [F.coalesce(F.col(f"_c{i}"), F.lit("")) for i in range(len(cells))]
        ints = [F.bool_and(t.rlike(_INT) & F.expr(f"try_cast(coalesce(_c{i}, '') as int)").isNotNull()).alias(f"i{i}") for i, t in enumerate(text)]
        found = raw.agg(F.count(F.lit(1)).alias("n"), *ints).first()
    except QueryError:
        raise
    except (PySparkException, Py4JJavaError) as ex:
        if "UNABLE_TO_INFER" in str(ex) or "EMPTY" in str(ex):
            raise QueryError(ErrorCode.DATA_ERROR, f"Table '{name}' has no header row.") from ex
        raise QueryError(ErrorCode.DATA_ERROR, f"Table '{name}': a row doesn't have the expected {len(cells) if 'cells' in locals() else '?'} fields, or the file can't be read.") from ex
    kinds = ["STRING" if found[f"i{i}"] is False else "INT" for i in range(len(cells))]
    frame = raw.select(*((t.cast("int") if k == "INT" else t).alias(c) for t, k, c in zip(text, kinds, cells, strict=True)))
    return TableMeta(name, frame, tuple(cells), tuple(kinds), found["n"])
