import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import ngram_join as nj

from .conftest import SCHEMA, corpus, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in by[s])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            by[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link(df).collect()}


def test_against_brute_force(docs, rows):
    assert result(docs) == brute(rows)


def test_crowded_regions_are_joined_by_pivots(spark, monkeypatch):
    """A passage in every document and a chain of near copies: regions over SMALL, several components in each."""
    rng = random.Random(5)
    passage, rows = words(rng, 60), []
    for k in range(20):
        base = words(rng, 30) + passage
        for _ in range(3):
            rows.append((len(rows), " ".join(base), None, None, 0, ""))
            base = [*base]
            base[rng.randrange(30)] = f"new{len(rows)}"
    monkeypatch.setattr(nj, "SMALL", 4)
    monkeypatch.setattr(nj, "CROWDED", 10**6)  # nothing may be left out: all goes through the crowded regions
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == brute(rows)
    monkeypatch.setattr(nj, "REGION", 16)
    monkeypatch.setattr(nj, "LEVELS", 2)
    assert result(df) == brute(rows)


def test_region_join_equals_all_pairs():
    rng = random.Random(3)
    sets = []
    for _ in range(40):
        base = {rng.getrandbits(62) for _ in range(60)}
        for _ in range(4):
            sets.append(np.array(sorted(base), np.uint64))
            base = {*list(base)[4:], *(rng.getrandbits(62) for _ in range(rng.randrange(9)))}

    def classes(links):
        parent = list(range(len(sets)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in links:
            parent[root(i)] = root(j)
        return [root(i) == root(j) for i in range(len(sets)) for j in range(i)]

    j = nj._Join(sets, list(range(len(sets))))
    j.region(list(range(len(sets))))
    assert classes(j.found) == classes([(a, b) for a in range(len(sets)) for b in range(a) if nj._close(sets[a], sets[b])])


@pytest.mark.parametrize("n", [1, 2, 5, 30, 60, 100, 333, 5000])
def test_prefix_bounds(n):
    """A linked partner z of any size shares 1 + extra(z), of which both together may omit no more than extra(z)."""
    for other in range(nj.least_shared(n), 100 * n // 75 + 1):
        small = min(n, other)
        assert nj.may_omit(n) + nj.may_omit(other) <= nj.extra(small)
    assert nj.prefix_length(n) <= n and nj.extra(n) <= nj.extra(n + 1)


def test_edges(empty, odd):
    assert result(empty) == {}
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nj.link(odd).collect()]
    assert len(got) == 6 and (9, 0, 9) in got and (None, 56, None) in got and got.count((7, 56, 7)) == 2


def test_other_seed(spark):
    rows = corpus(8, 40)
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_null_ids_take_no_prefix_from_their_copies(spark):
    w = words(random.Random(4), 100)
    near = " ".join([*w[:50], "changed", *w[51:]])
    rows = [(None, " ".join(w), None, None, 0, ""), (1, " ".join(w), None, None, 0, ""), (2, near, None, None, 0, "")]
    got = {(r.doc_id, r.component_id) for r in nj.link(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    assert got == {(None, None), (1, 1), (2, 1)}


def links_of(rows):
    """Number of linked others of each document, by all pairs."""
    sets, n = {}, Counter()
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            n[i] += i != j and both > 0 and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)
    return dict(n)


def counted(df):
    return {r.doc_id: r.n_links for r in nj.link(df).collect()}


def test_number_of_links(docs, rows):
    assert counted(docs) == links_of(rows)


def test_number_of_links_in_crowded_regions(spark, monkeypatch):
    """A family of near copies in which some pairs are too far apart, exact copies of some, and a passage in every document."""
    rng = random.Random(6)
    passage, rows = words(rng, 60), []
    for k in range(6):
        base = words(rng, 60) + passage
        for _ in range(12):
            w = [*base]
            for _ in range(rng.randrange(5)):
                w[rng.randrange(60)] = f"new{rng.random()}"
            rows += [(len(rows) + c, " ".join(w), None, None, 0, "") for c in range(1 + rng.randrange(2))]
    want = links_of(rows)
    assert len(set(want.values())) > 3
    monkeypatch.setattr(nj, "SMALL", 4)
    df = spark.createDataFrame(rows, SCHEMA)
    assert counted(df) == want
    monkeypatch.setattr(nj, "CROWDED", 10**6)
    monkeypatch.setattr(nj, "REGION", 16)
    monkeypatch.setattr(nj, "LEVELS", 2)
    assert counted(df) == want


def test_shared():
    rng = random.Random(7)
    lists = [np.array(sorted(rng.sample(range(300), rng.randrange(120))), np.int64) for _ in range(90)]
    both = nj.shared(lists)
    assert all(both[i, j] == len(np.intersect1d(lists[i], lists[j])) for i in range(90) for j in range(90) if i != j)


def test_an_id_with_several_texts(spark):
    """Each text keeps its links, and the document connects them."""
    rng = random.Random(11)
    a, long, other = words(rng, 100), words(rng, 1000), words(rng, 200)
    near_a, near_long = [*a[:50], "changed", *a[51:]], [*long[:500], "changed", *long[501:]]
    t = lambda w: " ".join(w)
    rows = [(1, t(a)), (1, t(long)), (2, t(near_a)), (3, t(near_long)), (4, t(other)), (5, t(other)), (5, t(words(rng, 80))), (9, t(near_a))]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.n_links) for r in nj.link(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert {i: c for (i, _), (c, _) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 1}
    assert [got[1, 96], got[1, 996], got[2, 96], got[9, 96], got[3, 996]] == [(1, 3), (1, 3), (1, 2), (1, 2), (1, 1)]
    # the smallest id of a group stands in rows whose sets are named by a hash
    rows = [(1, t(a)), (1, t(long)), (7, t(near_a)), (8, t(near_long)), (6, t(other))]
    assert {(r.doc_id, r.component_id) for r in nj.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(1, 1), (7, 1), (8, 1), (6, 6)}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 1, 2, 3, 4)], "doc_id long, text string, rep int, n int, d1 int, first int")
    assert {(r.doc_id, r.component_id, r.n_links) for r in nj.link(docs).collect()} == {(1, 1, 1), (2, 1, 1)}
