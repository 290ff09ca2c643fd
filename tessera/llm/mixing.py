"""Mixing sources to target weights by the cube method.

Every document of a source gets the same expected number of copies, target / source size; the whole part is taken
outright and the fraction is an inclusion probability. The cube method turns these probabilities into 0 or 1. Flight:
three units at a time walk along directions in the null space of the balancing constraints (documents, tokens), so both
totals keep their expected value until no direction is left. Landing, per source: what flights left open, and a pool of
about ``POOL`` documents that didn't fly, are decided from the largest to the smallest, each with its probability less
the error of the total so far, so that small documents settle what large ones upset; last, copies of pool documents (all
documents of a source of up to 2 * ``POOL``) are added or taken away (0 to 3 stay) while that brings the source nearer
to its target.

Scale: flights run per (source, block) with about ``block_units`` units a block, so a hot source is split over many
tasks; each block leaves at most two undecided units, which fly again in ever fewer blocks until ``block_units`` of a
source are left for its landing. Sources are ranked and filled without being gathered: only sums reach the driver.

Edge cases: null text has size 0; a null source is a source of its own (last in order); a source of size 0 gets target
0; repeated rows are units of their own; ids of any size stay exact, beside null ones too; an empty table gives an empty
result. Extra columns are ignored by ``mix`` and carried by ``take`` and ``with_copies`` (a column ``copies`` is replaced).
"""

from __future__ import annotations

import random
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._spark import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK_UNITS = 1000
POOL = 256
BROADCAST_SOURCES = 50_000
EPS = 1e-9


def water_level(total: float, weights: float, capped: Callable[[float], tuple[float, float]]) -> float | None:
    """The level u at which min(cap * size, u * weight) adds up to ``total``. ``capped(u)``: the sum of cap * size where
    u * weight is above it, and the weights of all others. Steps never pass the level; None: everything is capped."""
    u = total / weights if weights else 0.0
    while True:
        gone, open_ = capped(u)
        if not open_:
            return None
        after = (total - gone) / open_
        if after <= u:
            return u
        u = after


def _move(p: list[float], u: list[float], rng: random.Random) -> None:
    """One step of the flight: along u or -u to the cube's face, with probabilities that keep p's expectation."""
    up = down = float("inf")
    for x, d in zip(p, u, strict=True):
        if d > 0:
            up, down = min(up, (1 - x) / d), min(down, x / d)
        elif d < 0:
            up, down = min(up, x / -d), min(down, (1 - x) / -d)
    step = up if rng.random() * (up + down) < down else -down
    for i, d in enumerate(u):
        x = p[i] + step * d
        p[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x


def flight(probs: list[float], sizes: list[int], rng: random.Random, land: bool) -> list[float]:
    """Fast cube flight with the constraints (1, size): three units at a time until at most two are undecided."""
    out = list(probs)
    active: list[int] = []
    for i, x in enumerate(out):
        if not EPS <= x <= 1 - EPS:
            out[i] = float(round(x))
            continue
        active.append(i)
        if len(active) == 3:
            a, b, c = (sizes[j] for j in active)
            u = [float(c - b), float(a - c), float(b - a)]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            top = max(map(abs, u))
            p = [out[j] for j in active]
            _move(p, [d / top for d in u], rng)
            for j, v in zip(active, p, strict=True):
                out[j] = v
            active = [j for j in active if EPS <= out[j] <= 1 - EPS]
    if land:
        if len(active) == 2:  # the constraint on documents goes; tokens stay balanced
            i, j = active
            u = [float(sizes[j]), -float(sizes[i])] if sizes[i] and sizes[j] else [1.0, -1.0]
            top = max(map(abs, u))
            p = [out[i], out[j]]
            _move(p, [d / top for d in u], rng)
            out[i], out[j] = p
            active = [j for j in active if EPS <= out[j] <= 1 - EPS]
        for i in active:
            out[i] = 1.0 if rng.random() < out[i] else 0.0
    return out


def landing(probs: list[float], sizes: list[int], whole: list[int], pool: list[bool], cap: int, rng: random.Random) -> list[int]:
    """Copies of each unit: probabilities become 0 or 1 from the largest unit to the smallest, each shifted against the
    error of the total so far (0 and 1 stay); then whole copies of pool units move while that brings the total nearer."""
    copies, off = list(whole), 0.0
    order = sorted(range(len(probs)), key=lambda i: (-sizes[i], i))
    for i in order:
        p = probs[i]
        if EPS < p < 1 - EPS and sizes[i]:
            p -= off / sizes[i]
        x = int(rng.random() < p)
        copies[i] += x
        off += (x - probs[i]) * sizes[i]
    for i in order:
        while pool[i] and sizes[i] and 2 * abs(off) > sizes[i]:
            step = -1 if off > 0 else 1
            if not 0 <= copies[i] + step <= cap:
                break
            copies[i] += step
            off += step * sizes[i]
    return copies


def _sorted(t: pa.Table) -> pa.Table:
    return t.sort_by([("unit", "ascending"), ("size", "ascending"), ("doc_id", "ascending")])


def _fly(seed: int):
    def run(t: pa.Table) -> pa.Table:
        t = _sorted(t)
        rank, blocks, block = (t.column(c)[0].as_py() for c in ("rank", "blocks", "block"))
        out = flight(t.column("frac").to_pylist(), t.column("size").to_pylist(), random.Random(f"{seed}/{rank}/{blocks}/{block}"), False)
        return t.set_column(t.schema.get_field_index("frac"), t.schema.field("frac"), pa.array(out, pa.float64()))

    return run


def _land(seed: int, cap: int):
    def run(t: pa.Table) -> pa.Table:
        t = _sorted(t)
        columns = [t.column(c).to_pylist() for c in ("frac", "size", "whole", "pool")]
        out = landing(*columns, cap, random.Random(f"{seed}/{t.column('rank')[0].as_py()}"))
        return t.set_column(t.schema.get_field_index("whole"), t.schema.field("whole"), pa.array(out, pa.int64()))

    return run


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap=MOST_COPIES) -> DataFrame:
    """(source, source_size, target, n, rank): one row a source, ranked by code point with null last."""
    order = F.col("source").asc_nulls_last()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # sorted runs of sources, numbered by the sizes of the runs before: one row a partition is all that is ordered at once
    runs = cut(per.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)), "sources")
    before = F.coalesce(F.sum("many").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = runs.groupBy("run").agg(F.count(F.lit(1)).alias("many")).select("run", before.alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(runs.join(begin, "run").select("source", "source_size", "n", rank.alias("rank"), weight.alias("weight")), "sources")
    total, all_weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()

    def capped(u: float) -> tuple[float, float]:
        over = F.lit(u) * F.col("weight") > F.col("source_size") * cap
        gone, open_ = ranked.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        return float(gone), open_

    level = water_level(float(total), all_weights, capped)
    most = (F.col("source_size") * cap).cast("double")
    target = most if level is None else F.least(most, F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"), "n", "rank")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = MOST_COPIES, block_units: int = BLOCK_UNITS, seed: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of ``docs`` (doc_id, text, source), and the
    columns to carry."""
    size = F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long")
    sizes = cut(docs.select("doc_id", "source", *carry, size.alias("size"), F.xxhash64("doc_id", "text", *carry).alias("unit")), "sizes")
    targets = source_targets(sizes, weights, cap)
    t = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    share = F.least(F.lit(0.5), F.lit(float(POOL)) / F.col("n"))
    units = (
        sizes.alias("s").join(t.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "s.source", *carry, "size", "unit", "source_size", "target", "n", "rank", ratio.alias("ratio"))
        .withColumn("whole", F.floor(F.col("ratio") + EPS))
        .withColumn("frac", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
        .withColumn("pool", F.pmod(F.xxhash64("unit", F.lit("pool")), F.lit(1 << 20)) < share * (1 << 20))
        .withColumn("few", F.col("n") <= 2 * POOL)
        .withColumn("blocks", F.ceil(F.col("n") / block_units))
        .withColumn("block", F.pmod(F.xxhash64("unit", "size"), F.col("blocks")))
        .drop("n", "ratio")
    )
    shape = units.schema
    open_ = (F.col("frac") >= EPS) & (F.col("frac") <= 1 - EPS)
    blocks = targets.agg(F.max(F.ceil(F.col("n") / block_units))).first()[0] or 0
    last, flying, done = units.where("pool"), units.where(~F.col("pool") & open_), units.where(~F.col("pool") & ~open_)
    while True:
        flown = cut(flying.groupBy("rank", "block").applyInArrow(_fly(seed), shape), "flight")
        done, left = done.unionByName(flown.where(~open_)), flown.where(open_)
        if 2 * blocks <= block_units:
            break
        # at most two units a block are left: the next round needs a block for every block_units of them
        fewer = F.ceil(F.col("blocks") * 2 / block_units)
        flying = left.withColumn("blocks", fewer).withColumn("block", F.pmod(F.col("block"), F.col("blocks"))).select(shape.names)
        blocks = -(-blocks * 2 // block_units)
    last = last.unionByName(left).unionByName(done.where("few").withColumn("pool", F.lit(True)))
    done = done.where("not few").withColumn("whole", F.col("whole") + F.round("frac").cast("long"))
    landed = last.groupBy("rank").applyInArrow(_land(seed, cap), shape)
    copies = F.col("whole")
    result = done.unionByName(landed)
    return result.select("doc_id", "size", "source", "source_size", "target", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), *carry)


def with_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, each with its number of ``copies`` (replacing a column of that name)."""
    docs = docs.drop("copies")
    # rows are told apart by everything in them, and those that are equal by a number: each gets its own decision
    row = F.xxhash64(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    number = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    rows = docs.withColumn("__row", row).withColumn("__number", number)
    plan = mix(rows, carry=("__row", "__number"), **options).where("copies > 0").select("__row", "__number", "copies")
    return rows.join(plan, ["__row", "__number"]).drop("__row", "__number")


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken."""
    rows = with_copies(docs, **options).withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.drop("copies")
