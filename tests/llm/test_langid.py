import random
import zlib

import numpy as np
import pytest

from tessera.llm import langid


def data(spark, n=240):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "tion", "er", "and"], "fr": ["eau", "ment", "é", "que", "oi"], "de": ["ung", "sch", "ü", "heit", "ein"]}
    rows = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang if i % 10 else None, "s", 1, "x"))
    return spark.createDataFrame([*rows, (n, None, None, None, None, None), (n + 1, "123 !!", "en", None, 0, ""), (n + 2, "", "fr", None, 0, "")], "doc_id long, text string, lang string, source string, n_chars long, extra string")


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in langid.identify(data(spark)).collect()}
    assert len(got) == 243
    held = [r for r in got.values() if r.held_out and r.doc_id < 240]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.values())
    assert sum(r.lang_pred == ["de", "en", "fr"][r.doc_id % 3] for r in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3 and got[240].score == 0.0


def fitted(texts, labels):
    return langid.fit([langid.frequencies(t) for t in texts], labels, np.ones(1 << langid.BITS))


def test_weights_are_sparse_and_calibrated():
    texts = ["aab ab aab"] * 60 + ["xxy yx xyy"] * 60
    m = fitted(texts, ["p"] * 60 + ["q"] * 60)
    assert (m.weights == 0).mean() > 0.99 and m.temperature > 0
    raw = np.frombuffer(b"aab ab" + b"xyy", np.uint8)
    assert langid.softmax(m.logits(raw, np.array([0, 6, 9]))).argmax(axis=1).tolist() == [0, 1]


def test_bulk_scores_equal_single_ones():
    m = fitted(["abc abd"] * 30 + ["xyz xyw"] * 30, ["a"] * 30 + ["b"] * 30)
    texts = ["abc", "", "x", "xyz abd", "ab", "é日𝄞 ÀB", "ß"]
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    bulk = m.logits(np.frombuffer("".join(texts).encode(), np.uint8), off)
    for t, z in zip(texts, bulk, strict=True):
        idx, v = langid.frequencies(t) if t else (np.zeros(0, int), np.zeros(0))
        assert z == pytest.approx(v @ m.weights[idx] + m.bias, abs=1e-6)


def test_code_points():
    texts = ["Aé日𝄞z", "", "ÀB\u0130"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    p, off = langid.points(raw, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    assert [[*map(chr, p[a:b])] for a, b in zip(off[:-1], off[1:])] == [list("aé日𝄞z"), [], list("àb\u0130")]


def test_rare_language_and_copies(spark):
    """A third of the rows are copies of one text; one language has 1 in 100 rows; the sample is a tenth of them."""
    d = data(spark, 900)
    copies = d.where("doc_id = 1").crossJoin(spark.range(450).withColumnRenamed("id", "k")).selectExpr("10000 + k as doc_id", "text", "'en' as lang", "source", "n_chars", "extra")
    rare = spark.createDataFrame([(20000 + i, "zzyx qwzx " * 5 + f"xzq{i} zyx", "zz", "s", 1, "") for i in range(14)], d.schema)
    got = langid.identify(d.unionByName(copies).unionByName(rare), sample=120)
    r = got.where("doc_id >= 20000").groupBy("lang_pred").count().collect()
    assert [(x.lang_pred, x["count"]) for x in r] == [("zz", 14)]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "old", 9.0, 1)], "doc_id long, text string, lang string, lang_pred string, score double, o int")
    assert langid.with_language(docs, None).columns == ["doc_id", "text", "lang", "o", "lang_pred", "score"]
    assert len(langid.identify(docs).collect()) == 1


def test_edges(empty, odd):
    assert langid.identify(empty).collect() == []
    assert len(langid.identify(odd).collect()) == 6
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
