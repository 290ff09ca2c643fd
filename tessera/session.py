"""The engine, and the one guarded way to it that all gateways use."""

from __future__ import annotations

import csv
import os
import threading
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tessera.budget import OVER, Budget, BudgetPolicy, TupleMeter, run_limited
from tessera.errors import QueryError, from_spark
from tessera.plans import frontend, logical
from tessera.plans.ast import Query
from tessera.plans.compiler import ColumnMeta, Compiled, Compiler
from tessera.sources.catalog import Catalog

TRUNCATED = "Result was truncated by LIMIT at {} rows; more rows exist. Raise the LIMIT or add a WHERE filter to see other rows."


@dataclass(frozen=True)
class ResultSet:
    columns: tuple[ColumnMeta, ...]
    rows: list[tuple]
    truncated: bool

    @property
    def hint(self) -> str | None:
        return TRUNCATED.format(len(self.rows)) if self.truncated else None


class Engine:
    """Plans and runs queries of the dialect over a catalog. ``algorithm``: a Spark join hint for all joins (merge,
    shuffle_hash, broadcast); by default Catalyst decides by size."""

    def __init__(self, spark: SparkSession, catalog: Catalog, algorithm: str | None = None):
        self.spark, self.catalog, self.algorithm = spark, catalog, algorithm

    def parse(self, sql: str) -> Query:
        q = frontend.parse(self.spark, sql)
        for t in q.tables:
            self.catalog.get(t)
        return q

    def compile(self, sql: str, meter: TupleMeter | None = None) -> Compiled:
        q = self.parse(sql)
        if meter and q.limit is not None and not (q.grouped or q.distinct or q.order_by):
            meter.stopping = False  # such a LIMIT stops by itself, and reads ahead by batches
        return Compiler(self.catalog, q, self.algorithm, meter.watch if meter else None).compile()

    def frame(self, sql: str, names: list[str] | None = None) -> DataFrame:
        """The query as a lazy DataFrame, under the given or the header names."""
        c = self.compile(sql)
        df = c.frame if c.limit is None else c.frame.limit(c.limit)
        return df.toDF(*(names or [m.name for m in c.columns]))

    def explain(self, sql: str) -> str:
        q = self.parse(sql)
        c = Compiler(self.catalog, q, self.algorithm).compile()
        frame = c.frame if c.limit is None else c.frame.limit(c.limit)
        columns = {t: self.catalog.get(t).columns for t in q.tables}
        return f"=== Plan (as written) ===\n{logical.show(logical.written(q))}\n=== Plan (optimized) ===\n{logical.show(logical.optimized(q, columns))}\n=== Plan (Catalyst) ===\n{frame._jdf.queryExecution().optimizedPlan().toString().rstrip()}"

    def execute(self, sql: str, budget: Budget = Budget()) -> ResultSet:
        meter = TupleMeter(budget.max_tuples) if budget.max_tuples is not None else None
        c = self.compile(sql, meter)
        if meter and not (c.streaming and c.limit is not None) and all(t.row_count is not None for t in c.scans):
            meter.check(sum(t.row_count for t in c.scans))  # all of it would be read: no need to start

        def work() -> ResultSet:
            # no more rows than the budget allows ever reach the driver, but one that shows there are more
            most = min((x + 1 for x in (c.limit, budget.max_tuples) if x is not None), default=None)
            df = c.frame if most is None else c.frame.limit(most)
            rows = [tuple(r) for r in df.collect()]
            if meter and len(rows) > meter.limit:
                raise meter.failure(f"more than {meter.limit}")
            if meter:
                # a LIMIT over pipelined operators reads ahead by whole batches: what it asked for is what counts
                meter.check(len(rows) * len(meter.seen) if c.streaming and c.limit is not None else None)
            cut = c.limit is not None and len(rows) > c.limit
            return ResultSet(c.columns, rows[: c.limit] if cut else rows, cut)

        try:
            return run_limited(self.spark, work, budget.timeout_ms)
        except QueryError:
            raise
        except (PySparkException, Py4JJavaError) as ex:
            if meter and OVER in str(ex):
                raise meter.failure(f"more than {meter.limit}") from ex
            raise from_spark(ex) from ex

    def write_csv(self, sql: str, path: str, budget: Budget = Budget()) -> None:
        """Header and rows to one file; on any failure no file is left. For large results use ``write_csv_dir``."""
        result = self.execute(sql, budget)
        part = f"{path}.part"
        try:
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            with open(part, "w", newline="", encoding="utf-8") as f:
                out = csv.writer(f, lineterminator="\n")
                out.writerow([c.name for c in result.columns])
                out.writerows(result.rows)
            os.replace(part, path)
        except BaseException:
            if os.path.exists(part):
                os.unlink(part)
            raise

    def write_csv_dir(self, sql: str, path: str) -> None:
        """Distributed sink: part files written by the executors."""
        c = self.compile(sql)
        df = c.frame if c.limit is None else c.frame.limit(c.limit)
        df.toDF(*(f"{m.name}_{i}" if [x.name for x in c.columns].count(m.name) > 1 else m.name for i, m in enumerate(c.columns))).write.csv(path, header=True)


@dataclass(frozen=True)
class AuditEvent:
    principal: str
    sql: str
    outcome: str  # SUCCESS, EXPLAIN, ERROR
    explain_text: str | None = None
    row_count: int | None = None
    truncated: bool | None = None
    error_code: str | None = None


class Busy(Exception):
    """No permit is free."""


@dataclass(frozen=True)
class Answer:
    result: ResultSet | None = None
    explain: str | None = None


class QueryService:
    """Permit, plan, clamp, run, audit: every query goes through ``execute``, and every outcome is audited."""

    def __init__(self, engine: Engine, policy: BudgetPolicy = BudgetPolicy(), permits: int | None = None, audit: Callable[[AuditEvent], None] = lambda e: None):
        self.engine, self.policy, self.audit = engine, policy, audit
        self._permits = threading.Semaphore(permits or os.cpu_count() or 1)

    def execute(self, sql: str, max_tuples: int | None = None, timeout_ms: int | None = None, principal: str = "anonymous") -> Answer:
        if not self._permits.acquire(blocking=False):
            self.audit(AuditEvent(principal, sql, "ERROR", error_code="CONCURRENCY_LIMIT"))
            raise Busy("Too many concurrent queries; retry shortly.")
        try:
            explain, text = frontend.strip_explain(sql or "")
            if explain:
                plan = self.engine.explain(text)
                self.audit(AuditEvent(principal, sql, "EXPLAIN", explain_text=plan))
                return Answer(explain=plan)
            result = self.engine.execute(text, self.policy.clamp(max_tuples, timeout_ms))
            self.audit(AuditEvent(principal, sql, "SUCCESS", row_count=len(result.rows), truncated=result.truncated))
            return Answer(result)
        except QueryError as ex:
            self.audit(AuditEvent(principal, sql, "ERROR", error_code=ex.code.value))
            raise
        except ValueError:
            self.audit(AuditEvent(principal, sql, "ERROR", error_code="BAD_REQUEST"))
            raise
        except Exception:
            self.audit(AuditEvent(principal, sql, "ERROR", error_code="INTERNAL"))
            raise
        finally:
            self._permits.release()
