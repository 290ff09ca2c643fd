"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    sc.setCheckpointDir(own)
    return shared_dir(spark)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_scratch = threading.local()


def cut(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    if not keep and getattr(_scratch, "open", None):
        _scratch.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables cut inside the block when it ends, but for those to keep: use their rows before."""
    _scratch.open = [*getattr(_scratch, "open", []), []]
    try:
        yield
    finally:
        for path in _scratch.open.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` once nothing reads it any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _delete(df.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on texts and sets reach Python by at most ``rows`` rows at a time: a batch of the default 10,000 takes
    tens of MB several times over, on both sides, in each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns only, so extra or clashing columns never matter."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n
