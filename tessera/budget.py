"""Query budgets that fail closed: rows that operators produce, and wall-clock time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.errors import BudgetExceeded, BudgetKind


#: What a task raises that has made more rows than its query may.
OVER = "TESSERA_TUPLE_BUDGET"


@dataclass(frozen=True)
class Budget:
    """None means unlimited."""

    max_tuples: int | None = None
    timeout_ms: int | None = None


@dataclass(frozen=True)
class BudgetPolicy:
    """Defaults where a caller names no limit, and caps above which none may go."""

    default_tuples: int = 100_000
    max_tuples: int = 1_000_000
    default_timeout_ms: int = 5_000
    max_timeout_ms: int = 30_000

    def clamp(self, max_tuples: int | None, timeout_ms: int | None) -> Budget:
        for name, value in (("maxTuples", max_tuples), ("timeoutMs", timeout_ms)):
            if value is not None and (isinstance(value, bool) or not isinstance(value, int)):
                raise ValueError(f"{name} must be a whole number.")
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be positive.")
        return Budget(min(max_tuples or self.default_tuples, self.max_tuples), min(timeout_ms or self.default_timeout_ms, self.max_timeout_ms))


class TupleMeter:
    """Counts the rows out of every scan, filter, join and aggregation of one query, with Spark's observations. A task
    that alone makes more rows than the budget fails at once (``stopping``), so that no operator runs far beyond it."""

    def __init__(self, limit: int, stopping: bool = True):
        self.limit, self.stopping, self.seen = limit, stopping, []

    def watch(self, df: DataFrame) -> DataFrame:
        o = Observation(f"rows-{uuid.uuid4().hex}")
        self.seen.append(o)
        df = df.observe(o, F.count(F.lit(1)).alias("n"))
        if not self.stopping:
            return df
        row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # its number in the task
        return df.where(F.when(row < self.limit, F.lit(True)).otherwise(F.raise_error(F.lit(OVER)).cast("boolean")))

    def failure(self, total: object) -> BudgetExceeded:
        return BudgetExceeded(BudgetKind.TUPLES, f"Query exceeded its tuple budget: {total} rows processed, {self.limit} allowed. Try a tighter WHERE or LIMIT.")

    def check(self, total: int | None = None) -> None:
        total = sum(int(o.get.get("n", 0)) for o in self.seen) if total is None else total
        if total > self.limit:
            raise self.failure(total)


def run_limited(spark: SparkSession, work: Callable[[], object], timeout_ms: int | None) -> object:
    """Run ``work`` in a job group of its own; at the deadline its jobs are cancelled until it has ended."""
    if timeout_ms is None:
        return work()
    if timeout_ms <= 0:
        raise BudgetExceeded(BudgetKind.TIME, f"Query exceeded its time budget of {timeout_ms} ms.")
    group, box = f"query-{uuid.uuid4().hex}", {}

    def target() -> None:
        try:
            spark.sparkContext.setJobGroup(group, "budgeted query", interruptOnCancel=True)
            box["value"] = work()
        except BaseException as ex:  # handed to the caller's thread
            box["error"] = ex

    t = threading.Thread(target=inheritable_thread_target(target), daemon=True)
    t.start()
    t.join(timeout_ms / 1000)
    if t.is_alive():
        while t.is_alive():  # a cancel before the job is submitted cancels nothing
            spark.sparkContext.cancelJobGroup(group)
            t.join(0.2)
        raise BudgetExceeded(BudgetKind.TIME, f"Query exceeded its time budget of {timeout_ms} ms.")
    if "error" in box:
        raise box["error"]
    return box["value"]
