"""Document fingerprints from closed syncmers, with DataFrame functions only.

Units are words of letters and digits (ASCII and Latin), and any other visible character by itself, so scripts without
spaces work too. A k-mer of K units is a closed syncmer when its smallest inner s-mer (S units, by hash) stands at its
first or last place: that depends on the k-mer alone, so the same passage gives the same anchors in any document. The
fingerprint is the bottom-M sketch of a document's syncmers: the M smallest different hashes, each with the place (in
units) where it first stands, as hex.

Likeness is by position: of the M smallest hashes of both sketches together, the share that both have at places which
agree, that is, whose shift from one document to the other is within DRIFT units of the median shift. Passages that
stand in another order agree in part only. Its error is that of a sample of M (a standard error of at most 0.0625).

The next document: rows are dealt out to buckets by the quantiles of doc_id, whatever ids there are; an id (or the null
id) that fills several buckets is spread over them by the hash of the text. Each text is sketched once, in its bucket,
and handed to the row before; only the first row of each bucket, one of at most ``MOST_BUCKETS``, is looked for anew.

Edge cases: null text is empty; no units: empty fingerprint (likeness of two empty ones is 1, of an empty and another
0); fewer than K units: one anchor, the hash of all units. Equal texts have equal fingerprints. Rows with the same
doc_id follow each other by the hash of their text; a null doc_id comes last. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, M = 5, 2, 64
DRIFT = 64
UNIT = r"[A-Za-z0-9À-ɏ]+|[^\s\p{Cntrl}A-Za-z0-9À-ɏ]"
BUCKETS, MOST_BUCKETS = 4, 20_000  # buckets a shuffle partition, and in all


def _hashes(units: Column, n: int) -> Column:
    """Hashes of all runs of n units (an empty array where there are fewer)."""
    parts = lambda i: F.xxhash64(*(F.get(units, i + j) for j in range(n)))
    return F.when(F.size(units) >= n, F.transform(F.sequence(F.lit(0), F.size(units) - n), parts)).otherwise(F.array().cast("array<bigint>"))


def with_syncmers(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Adds ``out``: array<struct<pos int, hash bigint>>, the anchors of ``text`` by position (in units)."""
    units, smers = f"__u_{out}", f"__s_{out}"
    w = k - s + 1
    df = df.withColumn(units, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0)))
    df = df.withColumn(smers, _hashes(F.col(units), s))
    h = F.col(smers)

    def at(i: Column) -> Column:
        inner = [F.get(h, i + j) for j in range(w)]
        closed = F.least(*inner) == F.least(inner[0], inner[-1])
        return F.when(closed, F.struct(i.cast("int").alias("pos"), F.xxhash64(*inner).alias("hash")))

    many = F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - w), at), lambda x: x.isNotNull())
    one = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.concat_ws(" ", F.col(units))).alias("hash")))
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return df.withColumn(out, F.when(F.size(units) == 0, none).when(F.size(units) < k, one).otherwise(many)).drop(units, smers)


def with_sketch(df: DataFrame, text: str, out: str, m: int = M, k: int = K, s: int = S) -> DataFrame:
    """Adds ``out``: struct<h array<bigint>, p array<int>>, the sorted bottom-m hashes of the document's anchors and
    where each first stands."""
    anchors, hashes, low = f"__a_{out}", f"__h_{out}", f"__l_{out}"
    df = with_syncmers(df, text, anchors, k, s)
    df = df.withColumn(hashes, F.transform(anchors, lambda x: x["hash"]))
    df = df.withColumn(low, F.slice(F.array_sort(F.array_distinct(hashes)), 1, m))
    first = lambda h: F.get(F.col(anchors), (F.array_position(F.col(hashes), h) - 1).cast("int"))["pos"]
    return df.withColumn(out, F.struct(F.col(low).alias("h"), F.transform(low, first).alias("p"))).drop(anchors, hashes, low)


def likeness(a: str, b: str, m: int = M, drift: int = DRIFT) -> Column:
    """Share of the m smallest hashes of two sketches together that both have at places which agree."""
    union = F.slice(F.array_sort(F.array_union(f"{a}.h", f"{b}.h")), 1, m)
    both = F.array_intersect(union, F.array_intersect(f"{a}.h", f"{b}.h"))
    place = lambda x, h: F.get(F.col(f"{x}.p"), (F.array_position(F.col(f"{x}.h"), h) - 1).cast("int"))
    shifts = F.array_sort(F.transform(both, lambda h: place(b, h) - place(a, h)))
    # how many shifts lie within the drift of the median one
    near = F.transform(F.array(shifts), lambda s: F.size(F.filter(s, lambda x: F.abs(x - F.get(s, F.floor(F.size(s) / 2).cast("int"))) <= drift)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.get(near, F.lit(0)) / F.size(union))


def as_text(sketch: str) -> Column:
    entry = lambda h, p: F.concat(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lpad(F.lower(F.hex(p)), 8, "0"))
    return F.concat_ws("", F.zip_with(f"{sketch}.h", f"{sketch}.p", entry))


def _splits_below(splits: Column, n: int, value: Column, equal: bool) -> Column:
    """How many of the n sorted splits lie below a value (or equal it, too), by bisection."""
    steps = [F.lit(1 << i) for i in reversed(range(max(1, n).bit_length()))]

    def go(at: Column, step: Column) -> Column:
        x = F.get(splits, at + step - 1)
        return F.when((at + step <= n) & ((x <= value) if equal else (x < value)), at + step).otherwise(at)

    return F.aggregate(F.array(*steps), F.lit(0), go)


def with_bucket(docs: DataFrame, buckets: int) -> DataFrame:
    """Adds __b, a bucket that never falls as doc_id rises (null ids lowest), and __u, by which rows of an id are ordered."""
    spread = [i / buckets for i in range(1, buckets)] or [0.5]
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.percentile_approx("doc_id", spread, 10 * buckets).alias("splits")).first()
    splits = sorted(row.splits or [])
    without = max(1, -(-row.nulls * buckets // max(1, row.n)))
    u = F.shiftrightunsigned(F.xxhash64("text"), 1)
    of = lambda many: F.shiftright(F.shiftright(u, 39) * many, 24).cast("int")  # noqa: E731  which of many parts
    if splits:
        array = F.array(*(F.lit(x).cast("long") for x in splits))
        low, high = (_splits_below(array, len(splits), F.col("doc_id"), e) for e in (False, True))
        docs = docs.withColumn("__low", low).withColumn("__high", high)
        known = F.col("__low") + F.when(F.col("__high") > F.col("__low") + 1, of(F.col("__high") - F.col("__low"))).otherwise(F.lit(0))
    else:
        docs, known = docs.withColumns({"__low": F.lit(0), "__high": F.lit(0)}), F.lit(0)
    return docs.withColumn("__u", u).withColumn("__b", F.when(F.col("doc_id").isNull(), of(F.lit(without)) - without).otherwise(known)).drop("__low", "__high")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, a (the text's sketch), and of the next document by descending doc_id (after the last: the first)
    next_text and c, its sketch."""
    spark = docs.sparkSession
    buckets = buckets or min(MOST_BUCKETS, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_bucket(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")), buckets)
    order = [F.col("doc_id").desc_nulls_last(), F.col("__u").desc(), F.col("text")]
    d = with_sketch(rows.repartition("__b"), "text", "a")
    d = d.withColumn("__next", F.lead(F.struct("text", "a")).over(Window.partitionBy("__b").orderBy(*order)))
    # the first row of each bucket: found by id and hash (at most one row a bucket), then with its text
    tops = rows.groupBy("__b").agg(F.max(F.struct("doc_id", "__u")).alias("top"))
    by = Window.orderBy(F.col("__b").desc())
    after = tops.select(F.col("__b").alias("b"), F.coalesce(F.lead("__b").over(by), F.max("__b").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("nb"))
    t = F.broadcast(tops.select(F.col("__b").alias("tb"), F.col("top.doc_id").alias("tid"), F.col("top.__u").alias("tu")))  # at most MOST_BUCKETS rows of three numbers, and as many for null ids
    heads = rows.join(t, (F.col("__b") == F.col("tb")) & F.col("doc_id").eqNullSafe(F.col("tid")) & (F.col("__u") == F.col("tu"))).groupBy("tb").agg(F.min("text").alias("text"))
    heads = with_sketch(heads, "text", "a").select(F.col("tb").alias("nb"), F.struct("text", "a").alias("__head"))
    first = after.join(heads, "nb").select(F.col("b").alias("__b"), "__head")
    d = d.join(first, "__b").withColumn("__next", F.coalesce("__next", "__head"))
    return d.select("doc_id", "text", "a", F.col("__next.text").alias("next_text"), F.col("__next.a").alias("c"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the text with its second half overwritten from the next document, and likenesses."""
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    d = with_sketch(d.drop("text", "next_text"), "edited", "b")
    return d.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text("a").alias("fingerprint"), as_text("b").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"),
    )
