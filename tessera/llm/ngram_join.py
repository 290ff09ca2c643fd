"""N-gram Jaccard join as a metric-space join: documents, as sets of word shingles, that lie within a distance.

Jaccard distance is a metric, so a pair within r of each other is found in some region around a pivot, if each region
also gets the documents in its triangle-inequality window. Regions are made in levels:

1. Singleton pivots. In the space of all shingles documents are almost all at distance 1 from one another, and no
   number of document pivots tells them apart. The first pivots are therefore single shingles {s}. By the order of
   hashes, two documents within r share a shingle among the first n - ceil(t n) + 1 of each (t = 1 - r): that prefix
   is the document's window. Prefixes are taken longer by e, so that linked documents share at least 1 + e of it, and
   each document may leave out its most crowded pivots (common lines) as long as a shared one must remain.
2. Document pivots. Crowded regions with the same document as pivot are one; each is joined in full. One of more than
   REGION documents is split recursively: documents go to the nearest of several pivots, and by the window
   d(x, p) <= d(x, home) + 2r (and < tau + r) to others; documents that are far from all pivots form a region of their
   own, with those at >= tau - r. What pivots don't split is compared block by block.

Links are counted, not listed: each document gets the number of other documents linked with it. Regions overlap, so rows
carry tags of the earlier regions of their document, and a pair that shares a tag has been counted there.

All tests are exact (whole shingle sets are intersected); regions and windows only say which pairs need one.

Scale: equal sets are one node. Only repeated prefix shingles are shuffled with their documents (a bit map of fixed
size sieves them); whole sets are made again only for documents that take part in a test. Small regions yield all pairs
(at most SMALL a document), crowded ones a row a document; nothing is capped or dropped.

Edge cases: null text is empty; a text without words has an empty set and is linked with nothing; fewer than five words
give one shingle, the whole sequence; rows that share a doc_id are one document, which connects its
different texts (links of each are added up; n_shingles is of the row's own text); a null doc_id is linked with nothing; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._bitmap import bit_map, marked
from tessera.llm._graph import components
from tessera.llm._spark import cut, drop_table, small_batches
from tessera.llm._text import U, Words, chunks, mix, shingle_sets

NUM, DEN = 75, 100  # similarity of 0.75 or more
SMALL = 16
CROWDED = 8
MAP_BITS = 27
ID_BITS = 24
REGION = 2048
PIVOTS = 8
RARE = 24  # values in so few documents of a region are counted pair by pair
PAIRS, COLUMNS = 1 << 21, 2048
TAU = 0.5
SHRINK, GROW = 0.9, 1.5  # a split must leave no part of over 0.9 of the region, and at most 1.5 times its rows
LEVELS = 6
EPS = 1e-9


def least_shared(n: int) -> int:
    return -(-NUM * n // DEN)


def extra(n: int) -> int:
    """How much longer than needed the prefix of n shingles is; never falls as n grows."""
    return max(0, min(least_shared(n) - 1, max(12 * n // 100, 30)))


def prefix_length(n: int) -> int:
    return min(n, n - least_shared(n) + 1 + extra(n)) if n else 0


def may_omit(n: int) -> int:
    """Pivots that a document may leave out: half of the extra length of its smallest possible partner."""
    return extra(NUM * n // DEN) // 2


def sets_of(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Sorted 63-bit shingle hashes of each text."""
    for _, _, raw, off in chunks(column):
        for s in shingle_sets(Words(raw, off), size):
            yield np.unique(s >> U(1))


def digest(s: np.ndarray) -> int:
    return int(mix(s).sum(dtype=U).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, two digests of the set, the prefix (null where the doc_id is, and where the task has had the same set of another)."""
    had: set[tuple[int, int]] = set()
    shape = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("last", pa.int64()), ("omit", pa.int32()), ("prefix", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for doc_id, s in zip(batch.column("doc_id").to_pylist(), sets_of(batch.column("text")), strict=True):
            n = len(s)
            d = (digest(s), int(mix(s ^ U(0x5DEECE66D)).sum(dtype=U).view(np.int64))) if n else (0, 0)
            k = prefix_length(n)
            first = n > 0 and doc_id is not None and d not in had
            rows.append((doc_id, n, *d, int(s[k - 1]) if n else 0, may_omit(n), s[:k].view(np.int64) if first else None))
            if first:
                had.add(d)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)


def _distinct_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, n = np.unique(batch.column("prefix").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2).astype(np.int8))], names=["s", "n"])


def _kept_rows(marks):
    """Rows (shingle, first digest of the set) of prefix shingles that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            s = lists.flatten().to_numpy()
            ids = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            on = marked(mix(s.view(U)), marks.value)
            yield pa.RecordBatch.from_arrays([pa.array(s[on]), batch.column("d1").take(pa.array(ids[on]))], names=["s", "d1"])

    return run


def _sets(ids, size):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            on = np.flatnonzero(marked(mix(doc.view(U)), ids.value))
            part = batch.take(pa.array(on))
            sets = list(sets_of(part.column("text"), size))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "d1", "shingles"])

    return run


def _close(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if small * DEN < large * NUM:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DEN >= (len(a) + len(b) - both) * NUM


def distance(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1.0 - both / max(1, len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        on = [_close(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(on, pa.bool_())), batch.column("y").filter(pa.array(on, pa.bool_()))], names=["x", "y"])


def shared(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the lists (of different values) share: rare values pair by pair, others by products of
    matrices with one column for all values that stand in the same lists."""
    n = len(lists)
    both = np.zeros((n, n), np.float32)  # exact below 2**24
    values, who = np.concatenate([x.view(U) for x in lists]), np.repeat(np.arange(n), [len(x) for x in lists])
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    held = np.diff(np.append(first, len(values)))
    for d in range(2, RARE + 1):
        at = first[held == d]
        i, j = np.triu_indices(d, 1)
        step = max(1, PAIRS // len(i))
        for k in range(0, len(at), step):
            rows = who[at[k : k + step, None] + np.arange(d)]
            np.add.at(both, (rows[:, i].ravel(), rows[:, j].ravel()), np.float32(1))
    both += both.T
    often = held > RARE
    if often.any():
        of = np.add.reduceat(mix(who.astype(U) + U(1)), first)[often]  # names the lists that hold a value
        _, one, weight = np.unique(of, return_index=True, return_counts=True)
        at, held = first[often][one], held[often][one]
        for k in range(0, len(at), COLUMNS):
            x = np.zeros((n, len(at[k : k + COLUMNS])), np.float32)
            for c, (f, m) in enumerate(zip(at[k : k + COLUMNS].tolist(), held[k : k + COLUMNS].tolist(), strict=True)):
                x[who[f : f + m], c] = 1
            both += (x * weight[k : k + COLUMNS].astype(np.float32)) @ x.T
    return both


class _Join:
    """The exact join of one region: ``found`` connects what is linked, ``links`` adds up the weights of the documents
    linked with each, but for pairs that share a tag (they are counted elsewhere)."""

    def __init__(self, sets: list[np.ndarray], weights: list[int], tags: list[np.ndarray] | None = None):
        self.sets, self.weights, self.tags = sets, np.array(weights, np.int64), tags
        self.found, self.links = [], np.zeros(len(sets), np.int64)

    def region(self, members: list[int]) -> None:
        ids = np.array(members)
        sizes = np.array([len(self.sets[i]) for i in members])
        close = shared([self.sets[i] for i in members]).astype(np.int64) * (DEN + NUM) >= NUM * (sizes[:, None] + sizes)
        np.fill_diagonal(close, False)
        root = np.full(len(ids), -1)
        for i in range(len(ids)):
            if root[i] < 0:
                root[i], at = i, np.array([i])
                while len(at):
                    at = np.flatnonzero(close[at].any(axis=0) & (root < 0))
                    root[at] = i
        self.found += [(members[i], members[r]) for i, r in enumerate(root.tolist()) if i != r]
        if self.tags is not None:
            close &= shared([self.tags[i] for i in members]) == 0
        self.links[ids] += close @ self.weights[ids]


def far_apart(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Of candidates for pivots those farther than TAU + r from every one before: close pivots would hold the same documents."""
    out: list[np.ndarray] = []
    for s in sets:
        if all(distance(s, p) > TAU + 1 - NUM / DEN for p in out):
            out.append(s)
    return out


def _join_region(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep").drop_duplicates("rep")  # a node has one set; its rows can repeat
    ids = pdf["rep"].tolist()
    j = _Join([np.frombuffer(b, U) for b in pdf["shingles"]], pdf["weight"].tolist(), [np.array(t, np.int64) for t in pdf["tags"]])
    j.region(list(range(len(ids))))
    root = dict(j.found)
    return pd.DataFrame({"x": ids, "y": [ids[root.get(i, i)] for i in range(len(ids))], "links": j.links})


def _tag(region: str, part: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{region}/{part}".encode(), digest_size=8).digest(), "little", signed=True)


def _assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of large regions with their region's candidate pivots -> rows of the parts, each tagged with the document's
    earlier parts: of the parts that a pair shares the first one counts it."""
    r = 1 - NUM / DEN
    for pdf in batches:
        out = []
        for region, rep, weight, tags, blob, size, ps in zip(*(pdf[c] for c in ("region", "rep", "weight", "tags", "shingles", "size", "pivots")), strict=True):
            s = np.frombuffer(blob, U)
            d = [distance(s, p) for p in far_apart([np.frombuffer(p["shingles"], U) for p in (() if ps is None else ps)])]
            near = min(d, default=1.0)
            parts = [-1] if near >= TAU - r - EPS else []  # -1: far from all pivots
            parts += [k for k, x in enumerate(d) if x <= min(near + 2 * r, TAU + r) + EPS]
            had = list(tags)
            for k in parts:
                out.append((region, f"{region}/{k}", size, rep, weight, list(had), blob))
                had.append(_tag(region, k))
        yield pd.DataFrame(out, columns=["parent", "region", "size", "rep", "weight", "tags", "shingles"])


def _divide(regions: DataFrame) -> DataFrame:
    """Regions of more than REGION documents are split by pivots until none is so large; a region that its pivots don't
    split is dealt out as pairs of blocks, each to be compared in full. Tags see to it that each pair counts once."""
    shape = "parent string, region string, size long, rep long, weight long, tags array<long>, shingles binary"
    done, whole = regions.where("false"), regions.where("false")
    for level in range(LEVELS):
        sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
        rows = cut(regions.join(sizes, "region"), "sized")
        done = done.unionByName(rows.where(F.col("size") <= REGION).drop("size"))
        large = rows.where(F.col("size") > REGION)
        if not large.limit(1).count():
            regions = large.drop("size")
            break
        # about PIVOTS documents of each region by hash, so no region is gathered to choose them
        chosen = large.where(F.pmod(F.xxhash64("rep", F.lit(level)), F.col("size")) < PIVOTS)
        pivots = chosen.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("rep", "shingles"))).alias("pivots"))
        split = cut(large.join(pivots, "region", "left").select("region", "rep", "weight", "tags", "shingles", "size", "pivots").mapInPandas(_assigned, shape), "split")
        parts = split.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
        good = parts.groupBy("parent").agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.first("size").alias("size"))
        good = good.where((F.col("most") <= SHRINK * F.col("size")) & (F.col("all") <= GROW * F.col("size"))).select("parent")
        whole = whole.unionByName(large.join(good, large["region"] == good["parent"], "left_anti").drop("size"))
        regions = split.join(good, "parent", "left_semi").select("region", "rep", "weight", "tags", "shingles")
    rest = whole.unionByName(regions)
    sizes = rest.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / (REGION // 2)).alias("blocks"))
    rest = rest.join(sizes, "region").withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rest = rest.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    # a pair inside a block counts where the block meets itself
    tags = F.when(F.col("b") == F.col("o"), F.col("tags")).otherwise(F.concat("tags", F.array(F.xxhash64("region", "b"))))
    rest = rest.select(F.concat_ws("/", "region", F.least("b", "o"), F.greatest("b", "o")).alias("region"), "rep", "weight", tags.alias("tags"), "shingles")
    return done.unionByName(rest)


def link(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (how many other documents it is linked with) for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = cut(base.mapInArrow(_signatures, "doc_id long, n long, d1 long, d2 long, last long, omit int, prefix array<long>"), "signatures")
    some = sig.where("n > 0 and doc_id is not null")
    # equal sets are one node, named by their smallest doc_id; of several sets of that id the others by a hash (negative)
    same = cut(some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first"), F.max("last").alias("last"), F.max("omit").alias("omit")), "sets")
    own = same.groupBy("first").agg(F.min(F.struct("d1", "d2", "n")).alias("own"))
    named = F.when(F.col("own") == F.struct("d1", "d2", "n"), F.col("first")).otherwise(F.xxhash64("d1", "d2", "n").bitwiseOR(F.lit(-(1 << 63))))
    nodes = cut(same.join(own, "first").select(named.alias("rep"), "first", "d1", "d2", "n", "last", "omit"), "nodes")
    drop_table(same)
    members = cut(some.select("doc_id", "d1", "d2", "n").join(nodes.select("rep", "d1", "d2", "n"), ["d1", "d2", "n"]).select("doc_id", "rep").distinct(), "members")
    info = nodes.select("rep", "n", "last", "omit")

    # 1. singleton pivots; a digest that two sets share would only make more candidates
    prefixes = some.where("prefix is not null").select("d1", "prefix")
    twice = prefixes.mapInArrow(_distinct_hashes, "s long, n byte").groupBy("s").agg(F.sum("n").alias("n")).where("n > 1")
    marks = spark.sparkContext.broadcast(bit_map(twice.select("s").mapInArrow(_mixed, "h long"), MAP_BITS))
    rows = prefixes.mapInArrow(_kept_rows(marks), "s long, d1 long").join(nodes.select("d1", "rep"), "d1").select("s", "rep").distinct()
    rows = cut(rows, "pivots")
    sizes = cut(sig.select("doc_id", F.col("n").alias("n_shingles")), "sizes")
    drop_table(sig)  # the prefixes have been used
    crowd = rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ranked = rows.join(crowd, "s").join(info.select("rep", "omit"), "rep").withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("c").desc(), "s")))  # a document's own prefix
    left_out = (F.col("rank") <= F.col("omit")) & (F.col("c") > CROWDED)
    ranked = cut(ranked.select("s", "rep", left_out.alias("out")), "ranked")
    drop_table(rows)
    omitted = ranked.where("out").groupBy("rep").agg(F.count(F.lit(1)).alias("o"))
    kept = ranked.where("not out").select("s", "rep")
    pivot = F.min_by("rep", F.xxhash64("rep")).alias("pivot")
    regions = cut(kept.join(kept.groupBy("s").agg(F.count(F.lit(1)).alias("c"), pivot).where("c > 1"), "s"), "regions")

    # 2. pairs of small regions, but for those that also share a crowded one
    crowded = cut(regions.where(F.col("c") > SMALL).select("pivot", "rep").distinct(), "crowded")
    groups = cut(crowded.groupBy("rep").agg(F.sort_array(F.collect_set("pivot")).alias("groups")), "groups")
    weights = members.groupBy("rep").agg(F.count_distinct("doc_id").alias("weight"))
    small = regions.where(F.col("c") <= SMALL).select("s", "rep")
    pairs = small.select("s", F.col("rep").alias("x")).join(small.select("s", F.col("rep").alias("y")), "s").where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    facts = info.join(omitted, "rep", "left").select("rep", "n", "last", F.coalesce("o", F.lit(0)).alias("o"))
    facts = facts.withColumn("k", F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1).withColumn("e", F.greatest(F.lit(0), F.least(F.ceil(F.col("n") * NUM / DEN) - 1, F.greatest(F.floor(F.col("n") * 12 / 100), F.lit(30))))).withColumn("k", F.least("n", F.col("k") + F.col("e"))).drop("e")
    of = lambda side: facts.select(*(F.col(c).alias(side if c == "rep" else f"{c}{side}") for c in facts.columns))
    pairs = pairs.join(of("x"), "x").join(of("y"), "y")
    need = F.ceil(F.lit(NUM) * (F.col("nx") + F.col("ny")) / (NUM + DEN))
    beyond = F.when(F.col("lastx") <= F.col("lasty"), F.col("nx") - F.col("kx")).otherwise(F.col("ny") - F.col("ky"))  # shared shingles past both prefixes, at most
    pairs = pairs.where((F.least("nx", "ny") * DEN >= F.greatest("nx", "ny") * NUM) & (F.col("c") + F.col("ox") + F.col("oy") + beyond >= need)).select("x", "y")
    in_ = lambda side: groups.select(F.col("rep").alias(side), F.col("groups").alias(f"g{side}"))
    pairs = pairs.join(in_("x"), "x", "left").join(in_("y"), "y", "left").where(~F.coalesce(F.arrays_overlap("gx", "gy"), F.lit(False)))
    pairs = cut(pairs.select("x", "y").distinct(), "pairs")
    linked = _verify(base, nodes, pairs, size).distinct()
    edges, of = linked, lambda side: weights.select(F.col("rep").alias(side), "weight")
    links = linked.join(of("y"), "y").select(F.col("x").alias("rep"), F.col("weight").alias("links"))
    links = links.union(linked.join(of("x"), "x").select("y", "weight"))

    # 3. crowded regions are joined in full; of those that a pair shares the one with the smallest pivot counts it
    if crowded.limit(1).count():
        sets = _sets_of(base, nodes, groups.select(F.col("rep").alias("id")), size)
        todo = crowded.join(groups, "rep").join(weights, "rep").select("pivot", "rep", "weight", F.expr("filter(groups, g -> g < pivot)").alias("tags"))
        filled = cut(todo.join(sets, F.col("rep") == F.col("id")).select(F.col("pivot").cast("string").alias("region"), "rep", "weight", "tags", "shingles"), "regions")
        more = cut(_divide(filled).groupBy("region").applyInPandas(_join_region, "x long, y long, links long"), "links")
        drop_table(filled)
        edges = edges.union(more.where("x <> y").select("x", "y"))
        links = links.union(more.select("x", "links"))
    # a document with several sets connects them
    several = members.groupBy("doc_id").agg(F.min("rep").alias("y"), F.max("rep").alias("x")).where("x <> y")
    edges = edges.union(members.join(several.select("doc_id", "y"), "doc_id").where("rep <> y").select(F.col("rep").alias("x"), "y"))
    labels = cut(components(edges), "labels")
    if labels.where("component < 0").limit(1).count():  # the smallest node may be named by a hash: its documents have the name
        odd = labels.where("component < 0").join(nodes.select("rep", "first"), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("first").alias("least"))
        labels = labels.join(odd, "component", "left").select("node", F.coalesce("least", "component").alias("component"))

    links = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = weights.join(links, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    # read anew, so that a node of very many equal documents can be split in the join
    known = cut(known.select("rep", F.coalesce("component", F.when(F.col("rep") >= 0, F.col("rep"))).alias("component"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "known")
    found = members.join(known, "rep").groupBy("doc_id").agg(F.min(F.coalesce("component", "doc_id")).alias("component_id"), F.sum("links").alias("n_links"))
    return sizes.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(U)).view(np.int64))], names=["h"])


def _sets_of(base: DataFrame, nodes: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, shingles (8 bytes each) of the given nodes, from a second reading of the texts."""
    spark = base.sparkSession
    wanted = ids.select("id").distinct().join(nodes.select(F.col("rep").alias("id"), F.col("first").alias("doc_id"), "d1"), "id")
    marks = spark.sparkContext.broadcast(bit_map(wanted.select("doc_id").distinct().mapInArrow(_mixed, "h long"), ID_BITS))
    made = base.where("doc_id is not null").mapInArrow(_sets(marks, size), "doc_id long, d1 long, shingles binary")
    return made.join(wanted, ["doc_id", "d1"]).select("id", "shingles")


def _verify(base: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id")))
    sets = cut(_sets_of(base, nodes, ids, size), "sets")
    a = sets.select(F.col("id").alias("x"), F.col("shingles").alias("a"))
    b = sets.select(F.col("id").alias("y"), F.col("shingles").alias("b"))
    links = cut(pairs.join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(_verified, "x long, y long"), "links")
    drop_table(sets)
    return links
