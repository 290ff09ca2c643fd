import hashlib
import random

import pytest

from tessera.llm import fingerprint as fp


def test_edits_and_likeness(docs, rows):
    got = {r.doc_id: r for r in fp.compare_edits(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    following = {a[0]: b[1] or "" for a, b in zip(order, [*order[1:], order[0]])}
    prints = {}
    for i, t, *_ in rows:
        t, r = t or "", got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[i][:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        if edited == t:
            assert r.near_edited == 1.0
    long = [got[i] for i, t, *_ in rows if t and len(t.split()) >= 100 and len(set(t)) > 5]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.9 * len(long)


def following(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    return {a[0]: b[1] or "" for a, b in zip(order, [*order[1:], order[0]])}


@pytest.mark.parametrize("buckets", [1, 2, 7, 300])
def test_next_across_buckets(docs, rows, buckets):
    assert {r.doc_id: r.next_text for r in fp.with_next(docs, buckets).select("doc_id", "next_text").collect()} == following(rows)


def test_next_with_sparse_and_hot_ids(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-(2**63), 2**63), f"text {i}") for i in range(120)]
    got = {r.doc_id: r.next_text for r in fp.with_next(spark.createDataFrame(rows, "doc_id long, text string"), 16).select("doc_id", "next_text").collect()}
    assert got == following(rows)
    # a third without id, a third with one id: a ring through all rows, by descending id
    hot = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(150)]
    df = spark.createDataFrame(hot, "doc_id long, text string")
    back = {r.text: r.next_text for r in fp.with_next(df, 12).select("text", "next_text").collect()}
    id_of, ring, at = {t: i for i, t in hot}, [], "text 149"
    for _ in hot:
        ring.append(id_of[at])
        at = back[at]
    assert at == "text 149" and ring == sorted(ring, key=lambda i: (i is not None, i or 0), reverse=True)
    per = fp.with_bucket(df, 12).groupBy("__b").count().collect()
    assert max(r["count"] for r in per) < 40


def test_likeness_is_by_position(spark):
    w = [f"w{i}x{i * i % 89}" for i in range(400)]
    a, b, moved = " ".join(w), " ".join(["new words in front"] + w), " ".join(w[200:] + w[:200])
    df = spark.createDataFrame([(1, a, b, moved, "other text " * 50)], "id int, a string, b string, moved string, other string")
    for c in ("a", "b", "moved", "other"):
        df = fp.with_sketch(df, c, f"s_{c}")
    r = df.select(fp.likeness("s_a", "s_a").alias("same"), fp.likeness("s_a", "s_b").alias("shifted"), fp.likeness("s_a", "s_moved").alias("moved"), fp.likeness("s_a", "s_other").alias("other")).first()
    assert r.same == 1 and r.shifted > 0.9 and 0.2 < r.moved < 0.8 and r.other == 0


def test_error_of_the_estimate(spark):
    """Against the Jaccard similarity of all anchors: within three standard errors of a sample of 64."""
    rng = random.Random(6)
    rows = []
    for i in range(40):
        w = [f"v{rng.randrange(10**6)}" for _ in range(600)]
        x = [y if rng.random() > i / 400 else "changed" for y in w]
        rows.append((i, " ".join(w), " ".join(x)))
    df = spark.createDataFrame(rows, "id int, a string, b string")
    for c in ("a", "b"):
        df = fp.with_syncmers(fp.with_sketch(df, c, f"s_{c}"), c, f"m_{c}")
    for r in df.select(fp.likeness("s_a", "s_b").alias("got"), "m_a", "m_b").collect():
        p, q = {x.hash for x in r.m_a}, {x.hash for x in r.m_b}
        assert abs(r.got - len(p & q) / len(p | q)) <= 3 * 0.0625


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "d e f", 1, 2, 3)], "doc_id long, text string, a int, c int, n_chars int")
    assert {r.doc_id: r.n_chars for r in fp.compare_edits(docs).collect()} == {1: 5, 2: 5}


def test_anchors_are_context_free(spark):
    passage = " ".join(f"word{i * i % 97}x{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"some text before {passage}"), (2, f"{passage} and after it")], "id int, text string")
    a, b = (r.m for r in fp.with_syncmers(df, "text", "m").orderBy("id").collect())
    inner = [(x.pos - 3, x.hash) for x in a if x.pos >= 3]
    assert inner and {*inner} <= {(x.pos, x.hash) for x in b}


def test_edges(empty, odd, spark):
    assert fp.compare_edits(empty).collect() == []
    got = fp.compare_edits(odd).collect()
    assert len(got) == 6 and len({r.fingerprint for r in got if r.n_chars == 299}) == 1
    one = fp.compare_edits(spark.createDataFrame([(5, "only this one")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert fp.compare_edits(spark.createDataFrame([(5, None)], "doc_id long, text string")).first().fingerprint == ""


def test_main_path_is_native(docs):
    plan = fp.compare_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
