import random
import re

from tessera.llm import decontaminate as dc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(t):
    w = WORD.findall((t or "").translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_against_brute_force(spark, docs, rows):
    texts = {i: t for i, t, *_ in rows}
    long = max((t for t in texts.values() if t), key=len).split()
    items = [(0, " ".join(long[100:130])), (1, " ".join(long[50:58] + ["x"] + long[59:90])), (2, " ".join(long[7:200]).upper()), (3, "ab ab ab ab ab ab"), (4, None), (5, ""), (6, "one"), (7, " ".join(long[::3][:60])), (8, texts[0]), (9, " ".join(long[1000:1900]))]
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.shared) for r in dc.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in texts.items():
        d = shingles(t)
        for k, x in items:
            s = shingles(x)
            if s and len(s & d) >= 0.75 * len(s):
                want[i, k] = (len(s), len(s & d))
    assert got == want and {k for _, k in want} >= {0, 1, 2, 3, 6, 8, 9}


def test_search_loses_nothing_at_the_threshold(spark):
    """Items of 1 to 1,000 shingles in documents that hold just 75 % of them, and just less."""
    rng = random.Random(5)
    items, docs, want = [], [], set()
    for k, n in enumerate([1, 2, 3, 4, 5, 8, 9, 31, 32, 33, 64, 65, 100, 129, 257, 500, 1000] * 4):
        w = [f"i{k}w{j}" for j in range(n + 4)]
        items.append((k, " ".join(w)))
        need = -(-3 * n // 4)
        lost = rng.sample(range(n), n - need)
        for more, i in ((0, 2 * k), (1, 2 * k + 1)):  # the second lacks one shingle more
            held = sorted({*range(n)} - {*lost})[more:]
            noise = lambda: [f"n{rng.randrange(10**9)}" for _ in range(6)]
            docs.append((i, " ".join(x for j in held for x in [*noise(), *w[j : j + 5]])))
            if not more:
                want.add((i, k))
    shape = "text string"
    got = dc.leaks(spark.createDataFrame(docs, f"doc_id long, {shape}"), spark.createDataFrame(items, f"item_id long, {shape}")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    it = dc.item_shingles(spark.createDataFrame(items, f"item_id long, {shape}"))
    assert it.where("sketched").count() < 0.5 * it.count()  # the search is by sketches, not by all shingles


def test_clashing_names_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e", 1, 2, 3), (3, "A B C D E F", 1, 2, 3)], "doc_id long, text string, h int, item_id int, s int")
    items = spark.createDataFrame([(1, "a b c d e", 9, 9)], "item_id long, text string, doc_id int, h int")
    assert {(r.doc_id, r.item_id, r.shared) for r in dc.leaks(docs, items).collect()} == {(None, 1, 1), (3, 1, 1)}


def test_edges(spark, empty, odd):
    items = spark.createDataFrame([(1, "other text of the same id")], "item_id long, text string")
    none = items.where("false")
    assert dc.leaks(empty, items).collect() == [] and dc.leaks(odd, none).collect() == []
    assert [(r.doc_id, r.containment) for r in dc.leaks(odd, items).collect()] == [(8, 1.0)]


def test_main_path_is_native(spark, docs):
    plan = dc.leaks(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
