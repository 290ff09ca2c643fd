"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

Items are partitioned by their number of shingles, u being the largest number of a partition (a power of two). An
item's sketch is its k(u) smallest MinHash values (bottom-k of the hashed shingles), k(u) = u - ceil(t u) + 1 for the
threshold t. A document that holds at least t of the item's shingles misses fewer than k(u) of them, so it holds one of
the sketch, however long it is: the search loses nothing. 1. Sketched shingles alone are searched for in the documents'
shingles: what is hit is a candidate pair. 2. Candidate documents are read again, and each candidate pair is verified by
exact shingle containment, |item ∩ document| / |item| >= t.

Scale: the search is one join of the documents' shingle hashes with the sketches (broadcast only where the item table
is checked to be small, else a shuffled join); after that only hits are left. A passage in a third of all documents
is spread by (item, document), and hits are pre-aggregated. Items of one size share a hot shingle at most as often as
there are items.

Hashes have 64 bits: with 10**13 document shingles against 10**4 item shingles, the chance of any false hit is under 1 %,
and one would not reach the threshold by itself.

Edge cases: null texts are empty; texts with fewer than five words have one shingle, the whole sequence; empty items
match nothing; items with equal text all match; repeated rows of documents count once; rows that share a doc_id (also
the null one) are one document. Extra columns, and columns of other names than those used, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import cut, text_of

N = 5
THRESHOLD = 0.75
BROADCAST_SHINGLES = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    parts = F.split(F.translate(F.col(text), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingles(df: DataFrame, text: str, out: str, n: int = N) -> DataFrame:
    """Adds ``out``, the distinct n-word shingle hashes of ``text``."""
    df = df.withColumn("__w", words(text))
    w = F.col("__w")
    many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))
    one = F.array(F.xxhash64(F.concat_ws(" ", w)))
    none = F.array().cast("array<bigint>")
    return df.withColumn(out, F.array_distinct(F.when(F.size(w) == 0, none).when(F.size(w) < n, one).otherwise(many))).drop("__w")


def sketch_size(n: Column, threshold: float) -> Column:
    """k(u) for the partition of an item of n shingles."""
    u = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)))))
    return (u - F.ceil(u * threshold) + 1).cast("int")


def item_shingles(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, item_shingles, h, sketched: the shingles of each item, those of its sketch marked."""
    it = shingles(items.select("item_id", F.coalesce(items["text"], F.lit("")).alias("text")), "text", "s")
    ranked = F.array_sort(F.transform("s", lambda h: F.struct(F.xxhash64(h, F.lit("minhash")).alias("o"), h.alias("h"))))
    it = it.select("item_id", F.size("s").alias("item_shingles"), F.posexplode_outer(ranked).alias("at", "x")).where("x is not null")
    return it.select("item_id", "item_shingles", F.col("x.h").alias("h"), (F.col("at") < sketch_size(F.col("item_shingles"), threshold)).alias("sketched"))


def candidates(docs: DataFrame, it: DataFrame, small: bool) -> DataFrame:
    """doc_id, item_id of documents that hold a sketched shingle of an item."""
    sketch = it.where("sketched").select("h", "item_id")
    # explode_outer: for explode the optimiser adds a filter on the array's size, and with it a second, uncached tokenising
    d = shingles(text_of(docs), "text", "s").select("doc_id", F.explode_outer("s").alias("h"))
    return d.join(F.broadcast(sketch) if small else sketch, "h").select("doc_id", "item_id").distinct()


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment of every pair that reaches the threshold."""
    it = item_shingles(items, threshold)
    small = it.count() <= BROADCAST_SHINGLES
    pairs = cut(candidates(docs, it, small), "candidates")
    found = pairs.select(F.col("doc_id").alias("c_id")).distinct()
    d = text_of(docs)
    d = d.join(found, d["doc_id"].eqNullSafe(found["c_id"]), "left_semi")
    d = shingles(d, "text", "s").select("doc_id", F.explode_outer("s").alias("h"))
    hits = d.join(F.broadcast(it) if small else it, "h").select("doc_id", "item_id", "item_shingles", "h").distinct()  # repeated rows count once
    shared = hits.groupBy("doc_id", "item_id", "item_shingles").agg(F.count(F.lit(1)).alias("shared"))
    p = pairs.select(F.col("doc_id").alias("c_id"), F.col("item_id").alias("c_item"))
    shared = shared.join(p, F.col("doc_id").eqNullSafe(F.col("c_id")) & F.col("item_id").eqNullSafe(F.col("c_item")), "left_semi")
    shared = shared.where(F.col("shared") >= F.lit(threshold) * F.col("item_shingles"))
    return shared.select("doc_id", "item_id", F.col("item_shingles").cast("long").alias("item_shingles"), "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))
