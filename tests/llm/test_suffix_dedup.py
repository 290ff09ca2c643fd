import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd

from .conftest import SCHEMA


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if (w := b[k : k + length]) in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(gone[k] > (gone[k - 1] if k else 0) for k in range(len(b)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.report(df).collect()}


def test_against_brute_force(docs, rows):
    assert result(docs) == brute(rows)


@pytest.mark.parametrize("hot", [0, 0x55, 255])
def test_streaming_in_small_chunks(spark, monkeypatch, hot):
    rows = [(i, f"{i} start " + "the same passage in every text, over and over again; " * (i % 4) + f"end {i * 7}" + "y" * (97 + i), None, None, 0, "") for i in range(40)]
    monkeypatch.setattr(sd, "STREAM_ROWS", 3)
    monkeypatch.setattr(sd, "SEGMENT", 64)
    monkeypatch.setattr(sd, "SEND_ROWS", 20)
    batches = list(_contexts(rows, hot))
    spans = {}
    for b in sd._repeats(iter(batches)):
        for d, lo, hi in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lo", "hi")), strict=True):
            spans.setdefault(d, []).append((lo, hi))
    want = brute(rows)
    assert {i: sum(b - a for a, b in sd._union(spans.get(i, []))) for i, *_ in rows} == {i: w[1] for i, w in want.items()}
    assert result(spark.createDataFrame(rows, SCHEMA)) == want


def _contexts(rows, hot):
    import pyarrow as pa

    class Full:
        value = np.full(1 << 5, 255, np.uint8).tobytes()

    class Some:
        value = np.full(1 << 5, hot, np.uint8).tobytes()

    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "g": [0] * len(rows), "text": [r[1] for r in rows]})
    found = []
    for b in sd._contexts(Full, Some)(iter([batch])):
        found.append(b)
    t = pa.Table.from_batches(found).sort_by([("h", "ascending"), ("doc_id", "ascending"), ("first", "ascending")])
    yield from t.to_batches()


def test_hot_lines(spark, monkeypatch):
    """Common lines, shorter and longer than a window, in texts that differ around them."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij \n") for _ in range(n))
    line, long = noise(70), noise(260)
    rows = [(i, noise(rng.randrange(200)) + line + noise(5) + long[: 90 + i % 40] + noise(rng.randrange(120)) + (long if i % 3 else line) + noise(30), None, None, 0, "") for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    assert result(docs) == want
    monkeypatch.setattr(sd, "HOT", 5)
    assert result(docs) == want


def test_rows_of_a_hot_line_meet_in_their_task():
    import pyarrow as pa

    class Full:
        value = np.full(1 << 5, 255, np.uint8).tobytes()

    rng = random.Random(4)
    line = "".join(rng.choice("abcdefghij ") for _ in range(400))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "g": [0] * 500, "text": [line] * 500})
    (got,) = sd._contexts(Full, Full)(iter([batch]))
    with_bytes = got.filter(got.column("ctx").is_valid())
    assert with_bytes.num_rows < got.num_rows / 100 and set(with_bytes.column("doc_id").to_pylist()) == {0}


def test_radix_groups():
    raw = np.frombuffer(b"ab" * 120 + b"c" * 150, np.uint8)
    starts = np.arange(0, 250)
    again = sd.radix_groups(sd._loads(raw), starts, np.zeros(len(starts), np.uint64))
    seen, want = set(), []
    for s in starts:
        w = raw[s : s + 100].tobytes()
        want.append(w in seen)
        seen.add(w)
    assert again.tolist() == want


@pytest.mark.parametrize("w", [1, 3, 70])
def test_sliding_argmin(w):
    v = np.random.default_rng(1).integers(0, 20, 200, dtype=np.uint64) << np.uint64(24)
    assert sd.sliding_argmin(v, w).tolist() == [i + int(v[i : i + w].argmin()) for i in range(len(v) - w + 1)]


def test_edges(empty, odd):
    assert result(empty) == {}
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in sd.report(odd).collect())
    a = 60 * 5 - 1
    assert len(got) == 6 and got.count(("7", a, 0)) == 2 and ("None", a, a) in got and ("8", a, a) in got and ("9", 0, 0) in got


def test_clashing_names(docs):
    from pyspark.sql import functions as F

    more = docs.withColumns({c: F.lit(1) for c in ("copy", "spans", "g", "h", "c_id")})
    got = sd.dedup(more, carry=("copy", "spans", "g", "lang"))
    assert got.columns == ["doc_id", "copy", "spans", "g", "lang", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"] and got.count() == docs.count()


def test_carried_columns(docs):
    assert sd.dedup(docs, carry=("lang", "source")).columns == ["doc_id", "lang", "source", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"]
