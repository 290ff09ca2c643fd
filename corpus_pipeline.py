"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next stage's documents. All stages but the last return the columns of documents; the last adds
``copies``, how often the mix takes the document.

Edge cases: every stage takes empty tables, null columns and extra columns (dropped here); a null doc_id is never linked
with anything, and each such row is judged by itself; of rows that repeat a doc_id one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, mixing, ngram_join, suffix_dedup
from tessera.llm._spark import cut, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected when its language can't be told: no letters, or hardly better than chance.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    docs = docs.select(*COLUMNS)
    found = langid.with_language(docs, langid.learn(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    docs = docs.select(*COLUMNS)
    with scratch(spark):
        first = cut(ngram_join.link(docs).where("doc_id = component_id").select("doc_id").distinct(), "kept", keep=True)
    # of rows that repeat a doc_id always the same one: the least by a hash of all its columns
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*COLUMNS), "text"))
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__row", order).where("__row = 1").drop("__row")
    return kept.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of windows that stand earlier; documents of which nothing is left go."""
    cleaned = suffix_dedup.dedup(docs.select(*COLUMNS), carry=("lang", "source"))
    left = cleaned.where((F.col("n_removed") == 0) | (F.octet_length("kept") > 0))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    # a row is known by id and text, so that one without an id is decided by itself
    docs = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    found = decontaminate.leaks(docs.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies of each."""
    return mixing.with_copies(docs.select(*COLUMNS)).select(*COLUMNS, "copies")


STAGES = [
    ("language_id", known_language),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", benchmark_leaks),
    ("mix_sources", mixed),
]

#: The stages hold a trained classifier and a sampling: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
