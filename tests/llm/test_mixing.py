import random
import re
from collections import defaultdict

import pytest

from tessera.llm import mixing

from .conftest import SCHEMA


def targets(sizes, weights=(5, 2, 1), cap=3):
    """By bisection: the level at which min(cap * size, level * weight) adds up to all sizes."""
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, lo, hi = sum(sizes.values()), 0.0, float(sum(sizes.values())) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * sizes[s], mid * w[s]) for s in sizes) < total else (lo, mid)
    return {s: min(cap * sizes[s], hi * w[s]) for s in sizes}


def check(got, rows, near):
    """near: the most that a source of several documents may be off, as a share of its target, beside its smallest text."""
    size, source = {}, {}
    for i, t, _, s, *_ in rows:
        size[i], source[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s
    total, taken = defaultdict(int), defaultdict(int)
    for i in size:
        total[source[i]] += size[i]
    want = targets(total)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]], rel=1e-6)
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] += r.taken
    for s in total:
        least = min((x for i, x in size.items() if source[i] == s and x), default=0)
        most = max((x for i, x in size.items() if source[i] == s), default=0)
        if 3 * (total[s] - most) < want[s]:  # the others don't suffice: the largest text comes whole or not at all
            least = most / 2
        assert abs(taken[s] - want[s]) <= max(near * want[s], least), (s, taken[s], want[s])


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    check(got, rows, 0.02)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(2)).collect())


def test_blocks_and_later_rounds(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 50), "en", "hot" if i % 3 else f"s{i % 5}", 0, "") for i in range(900)]
    check(mixing.mix(spark.createDataFrame(rows, SCHEMA), block_units=20).collect(), rows, 0.01)


def test_heavy_tails(spark):
    """Sizes over three orders of magnitude: the worst source is within 2 % of its target."""
    rng = random.Random(8)
    rows = [(i, f"w{i} " * int(min(3000, 3 * rng.paretovariate(0.9))), "en", f"s{i % 7}", 0, "") for i in range(700)]
    check(mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect(), rows, 0.02)


def test_ids_stay_exact(spark):
    ids = [None, 2**53 + 1, 2**53 + 3, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(i, "some words of text", "a") for i in ids], "doc_id long, text string, source string")
    assert sorted([r.doc_id for r in mixing.mix(docs).collect()], key=str) == sorted(ids, key=str)


def test_clashing_names(spark):
    names = "doc_id long, text string, source string, size int, unit int, rank int, block int, copies int, pool int"
    docs = spark.createDataFrame([(i, "w " * (i + 1), "ab"[i % 2], 1, 2, 3, 4, 5, 6) for i in range(20)], names)
    assert len(mixing.mix(docs).collect()) == 20
    got = mixing.with_copies(docs)
    assert got.columns.count("copies") == 1 and all(0 < r.copies <= 3 for r in got.collect())


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 500) for _ in range(300)]
    out = mixing.flight([0.3] * 300, sizes, rng, land=False)
    assert sum(0 < x < 1 for x in out) <= 2
    assert sum(out) == pytest.approx(90) and sum(x * s for x, s in zip(out, sizes)) == pytest.approx(0.3 * sum(sizes))
    assert {*mixing.flight([0.3] * 300, sizes, rng, land=True)} <= {0.0, 1.0}


def test_inclusion_probabilities_are_kept():
    counts = [0] * 6
    for k in range(4000):
        for i, x in enumerate(mixing.flight([0.25] * 6, [3, 9, 1, 4, 7, 7], random.Random(k), land=True)):
            counts[i] += x
    assert all(abs(c / 4000 - 0.25) < 0.03 for c in counts)


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 1, 1), ("b", 50, 1), ("c", 49, 1), (None, 0, 1)], "source string, size long, unit long")
    got = {r.source: (r["rank"], r.target) for r in mixing.source_targets(sizes).collect()}
    want = targets({"a": 1, "b": 50, "c": 49, None: 0})
    assert {s: k for s, (k, _) in got.items()} == {"a": 0, "b": 1, "c": 2, None: 3}
    assert {s: x for s, (_, x) in got.items()} == pytest.approx(want)
    empty = mixing.source_targets(sizes.where("source is null")).first()
    assert empty.target == 0.0


def test_landing():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 2000) for _ in range(40)]
    for k in range(50):
        copies = mixing.landing([0.4] * 40, sizes, [1] * 40, [i % 2 == 0 for i in range(40)], 3, random.Random(k))
        assert all(0 <= c <= 3 for c in copies) and abs(sum(c * s for c, s in zip(copies, sizes)) - 1.4 * sum(sizes)) <= min(sizes)


def test_edges(empty, odd):
    assert mixing.mix(empty).collect() == []
    assert len(mixing.mix(odd).collect()) == 6
    assert "copies" in mixing.with_copies(odd).columns and mixing.take(empty).collect() == []


def test_rows_without_id_and_equal_rows_get_their_own_copies(spark):
    rows = [(None, f"word w{i % 150} " * 5, "ab"[i % 2]) for i in range(200)] + [(1, "same text again", "c")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, got = mixing.mix(docs).collect(), mixing.with_copies(docs).collect()
    assert {(r.source, r.target) for r in plan} and len(got) < len(rows)
    for source, target in {(r.source, r.target) for r in plan}:
        assert abs(sum(len(r.text.split()) * r.copies for r in got if r.source == source) - target) <= 10
