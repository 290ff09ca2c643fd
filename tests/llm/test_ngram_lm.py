import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ngram_lm as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    docs = {i: [*WORD.findall((t or "").translate(FOLD)), None] for i, t, *_ in rows}
    one, two, n_train = Counter(), Counter(), 0
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    for i, w in docs.items():
        if not held[i]:
            one.update(w)
            two.update(zip(["<s>", *w], w))
            n_train += 1
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    out = {}
    for i, w in docs.items():
        base = sum(math.log10(p1(x)) for x in w)
        score = sum(math.log10((two[c, x] + lm.MU * p1(x)) / ((n_train if c == "<s>" else one[c]) + lm.MU)) for c, x in zip(["<s>", *w], w))
        out[i] = (held[i], len(w), sum(one[x] > 0 for x in w), n, base, score)
    return out


def test_against_brute_force(docs, rows):
    want = brute(rows)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert got.keys() == want.keys()
    for i, (held, tokens, known, n, base, score) in want.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held, tokens, known, n)
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.score == pytest.approx(score, abs=1e-3 * tokens)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b a b", 1, 2, 3, 4)], "doc_id long, text string, shard int, chunk int, train int, blob int")
    assert lm.score(docs).first().n_tokens == 5


def test_edges(empty, odd):
    assert lm.score(empty).collect() == []
    got = [(r.doc_id, r.held_out, r.n_tokens) for r in lm.score(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, None, 61), (7, zlib.crc32(b"7") % 7 == 2, 61), (7, zlib.crc32(b"7") % 7 == 2, 61), (8, zlib.crc32(b"8") % 7 == 2, 7), (8, zlib.crc32(b"8") % 7 == 2, 61), (9, zlib.crc32(b"9") % 7 == 2, 1)], key=str)


@pytest.mark.parametrize("n,universe", [(1, 1), (5, 7), (1000, 1200), (1000, 10**6), (3000, 2**40), (500, 2**62), (64, 2**64 - 1)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    store = lm.Store()
    made = lm.EliasFano(store, v, universe)
    for ef in (made, lm.EliasFano(lm.Store(np.frombuffer(b"".join(store.parts), np.uint8)))):
        assert (ef.access(np.arange(len(v))) == v).all()
        x = np.unique(np.concatenate((v, rng.integers(0, universe, n, dtype=np.uint64))))
        at, equal = ef.successor(x, np.zeros(len(x), np.int64), np.full(len(x), len(v)))
        want = np.searchsorted(v, x)
        assert (equal == np.isin(x, v)).all() and (at[equal] == want[equal]).all()


def test_scores_do_not_depend_on_shards_or_chunks(spark, docs, monkeypatch):
    def run(**options):
        return sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, **options).collect())

    want = run()
    for partitions, chunk, probe in ((2, 1 << 12, 1), (9, 1 << 20, 2)):
        monkeypatch.setattr(lm, "PROBE", probe)
        monkeypatch.setattr(lm, "FREQUENT", 1 + partitions)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert run(chunk=chunk) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_codes():
    x = np.linspace(-23.9, 0, 1000)
    assert np.abs(np.log10(lm.restored(lm.quantised(x))) - x).max() < 2e-4 and lm.restored(np.zeros(1, np.uint16))[0] == 0


def test_probabilities_sum_to_one():
    """Over the training words and one unknown word, in any context."""
    text = "a b a c a b".split()
    one, two = Counter([*text, "$"]), Counter(zip(["^", *text], [*text, "$"]))
    n, v = sum(one.values()), len(one)
    for c in ("a", "b", "new"):
        follow = sum(two[c, w] for w in one)
        total = sum((two[c, w] + lm.MU * (one[w] + 1) / (n + v + 1)) / (one[c] + lm.MU) for w in one) + lm.MU / (n + v + 1) / (one[c] + lm.MU)
        assert follow == one[c] and total == pytest.approx(1)
