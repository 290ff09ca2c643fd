import random
import re

import numpy as np

from tessera.llm import licenses as lc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(text):
    w = WORD.findall((text or "").translate(FOLD))
    places = [(i, label) for phrase, label in lc.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def texts():
    rng = random.Random(6)
    pool = ["cc", "by", "all", "rights", "reserved", "general", "public", "license", "the", "CC BY", "All Rights Reserved.", "GNU General Public License", "naïve", "x"]
    out = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    out += [t for _, t in lc.TEMPLATES] + [None, "", "Licensed under CC BY-NC 4.0.", "cc, by; CC-BY cc\nby", "some words before " + lc.TEMPLATES[3][1].replace("free of charge", "for free") + " and after", "word " * 5000 + "all rights reserved"]
    return out


def test_scan(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in lc.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")} and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted({*filter(None, r.labels.split(","))}))
    for k, (label, _) in enumerate(lc.TEMPLATES):
        assert label in got[60 + k].labels.split(",")
    changed = got[60 + len(lc.TEMPLATES) + 4]
    assert "mit" in changed.labels and changed.score < 1 and changed.spans[0].first_word == 3


def test_matching_statistics():
    rng = random.Random(2)
    templates = [[rng.choice("abc") for _ in range(rng.randrange(1, 15))] for _ in range(8)]
    a = lc.Automaton(templates, [(["a", "b"], "x")])
    known = templates + [["a", "b"]]
    for _ in range(60):
        text = [rng.choice("abc") for _ in range(30)]
        for j, (v, n) in enumerate(a.statistics([a.vocab[w] for w in text])):
            want = max(k for k in range(j + 2) if any(t[i : i + k] == text[j + 1 - k : j + 1] for t in known for i in range(len(t) - k + 1)))
            assert n == want
            if n:
                here = [(t, e) for t, w in enumerate(known) for e in range(n, len(w) + 1) if w[e - n : e] == text[j + 1 - n : j + 1]]
                assert a.places[v] == here  # all occurrences


def labels_of(words):
    a, sizes = lc.default_automaton(), [len(lc.split(t)) for _, t in lc.TEMPLATES]
    ids = np.array([a.vocab.get(w, -1) for w in words])
    return {lc.TEMPLATES[t][0] for t, _, _, share in lc.chain(lc.scan_words(ids, a, len(sizes))[1], sizes) if share >= lc.COVERED}


def test_labels_survive_any_one_edit():
    """Each word of each template dropped, doubled or changed: its label stays."""
    for label, text in lc.TEMPLATES:
        w = lc.split(text)
        step = max(1, len(w) // 40)
        for k in range(0, len(w), step) if len(w) >= 12 else ():
            for edited in (w[:k] + w[k + 1 :], w[: k + 1] + w[k:], [*w[:k], "changed", *w[k + 1 :]]):
                others = (lc.split(t) for name, t in lc.TEMPLATES if name != label)
                if not any(edited[i : i + len(o)] == o for o in others for i in range(len(edited) - len(o) + 1)):  # then it is another's text
                    assert label in labels_of(["before", *edited, "after"]), (label, k)


def test_labels_against_brute_force():
    """Without edits: a template's label is there if and only if its words stand there, or those of one that holds most of it."""
    rng = random.Random(3)
    sets = [(label, lc.split(t)) for label, t in lc.TEMPLATES]
    for _ in range(60):
        chosen = rng.sample(sets, 2)
        text = [f"n{rng.randrange(99)}" for _ in range(30)]
        for _, w in chosen:
            text += w + [f"n{rng.randrange(99)}" for _ in range(30)]
        got = labels_of(text)
        for label, w in sets:
            if any(text[i : i + len(w)] == w for i in range(len(text))):
                assert label in got
        longest = lambda w: max((n for i in range(len(w)) for n in (next((k for k in range(len(w) - i, 0, -1) if any(text[j : j + k] == w[i : i + k] for j in range(len(text)))), 0),)), default=0)
        for label in got:
            assert any(longest(w) >= 3 and sum(x in text for x in w) >= lc.COVERED * len(w) for name, w in sets if name == label)
    assert labels_of([f"n{i}" for i in range(500)]) == set() and labels_of("permission is hereby granted to any person".split()) == set()


def test_repeated_and_very_long_texts(spark):
    notice = lc.TEMPLATES[4][1]
    got = {r.doc_id: r for r in lc.scan(spark.createDataFrame([(1, f"{notice} and {notice}"), (2, "filler words here " * 50_000 + notice + " more" * 50_000)], "doc_id long, text string")).collect()}
    assert sum(x.label == "mit" and x.covered == 1.0 for x in got[1].spans) >= 2
    assert "mit" in got[2].labels and got[2].score == 1.0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "all rights reserved", "x", 1, 2.0)], "doc_id long, text string, labels string, n_words int, score double")
    assert lc.scan(docs).first().base_labels == "reserved"


def test_edges(empty, odd):
    assert lc.scan(empty).collect() == []
    assert len(lc.scan(odd).collect()) == 6
