import base64
import hashlib
import random

import pytest

from tessera.llm import warc


def pages():
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", "".join(chr(rng.randrange(32, 400)) for _ in range(rng.choice([0, 10, 3000, 60000])))) for i in range(40)]
    rows += [(100 + i, f"http://same/{i}", rows[3][2]) for i in range(5)] + [(200, "http://n", None), (201, None, ""), (202, "http://m", "\x1f\u008b\x08 WARC/1.1\r\n" * 50), (203, "http://é ü", "a\r\n\r\nb")]
    return rows


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("range_bytes", [97, 4096, 4 << 20])
def test_round_trip(spark, range_bytes, monkeypatch):
    monkeypatch.setattr(warc, "MOST_TASKS", 16)
    rows = pages()
    m = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    assert m.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read(m, range_bytes).collect()
    assert len(got) == len(rows) and len({r.page_id for r in got}) == len(rows)
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html or "", i)
    html_of = {i: h or "" for i, _, h in rows}
    for r in got:
        html = html_of[r.page_id]
        lead = first[html]
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), digest(html))
        assert (r.record_type, r.refers_to) == (("response", None) if lead == r.page_id else ("revisit", lead))
        assert r.record_type == "revisit" or bytes(r.payload) == html.encode()


def test_many_ranges_are_many_tasks(spark):
    m = warc.write(spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1))
    assert warc.reading_tasks(m, 4096) == -(-m.first().bytes // 4096) > 20
    back = warc.read(m, 4096)
    back.count()
    assert back.rdd.getNumPartitions() == warc.reading_tasks(m, 4096)


def test_archives_of_failed_attempts_go(spark):
    import os

    m = warc.write(spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(2))
    top = m.first().path.rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    open(f"{top}/left-behind.warc.gz", "wb").close()
    warc._drop_unlisted(m, "file://" + top)
    assert len(os.listdir(top)) == m.count()


def test_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read(warc.write(df, least_bytes=5)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_files_are_gzip_members(spark):
    import gzip

    m = warc.write(spark.createDataFrame([(1, "u", "x"), (2, "u", "y")], "page_id long, url string, html string").coalesce(1))
    raw = gzip.open(m.first().path.removeprefix("file:").replace("//", "/"), "rb").read()
    assert raw.count(b"WARC/1.1\r\n") == 2


def test_edges(spark):
    shape = "page_id long, url string, html string, extra string"
    assert warc.read(warc.write(spark.createDataFrame([], shape))).collect() == []
    got = warc.read(warc.write(spark.createDataFrame([(None, None, "a", None), (5, "u", "a", "z"), (5, "u", "a", "z"), (None, "u", None, "")], shape))).collect()
    assert sorted((str(r.page_id), r.record_type) for r in got) == [("5", "response"), ("5", "response"), ("None", "response"), ("None", "revisit")]


def test_clashing_names(spark):
    rows = [(1, "u", "a", "x", 7, 9, 3, "y"), (2, "v", "a", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, bytes long, first_id long, n long, refers_to string")
    got = warc.read(warc.write(df)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "revisit", 1)]
