"""The SQL equivalents on a small table of copies, shared passages, ties, nulls, empty and long texts."""

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "pages", "benchmark")


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sql")
    html = ["<p>a</p>", None, "", "<p>é</p>", "<p>a</p>", "<p>A</p>", None, "x" * 5000]
    docs.drop("extra").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    items = [" ".join(rows[5 * k][1].split()[:20]) for k in range(6)] + [None, "", "one", "never seen in any of the texts"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql_gives_the_same_rows(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())
