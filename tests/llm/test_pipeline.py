import random

import pytest

import corpus_pipeline as cp

from .conftest import SCHEMA, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    top = str(tmp_path_factory.mktemp("corpus"))
    item = words(rng, 40)
    passage = words(rng, 60)
    rows = []
    for i in range(80):
        w = words(rng, 120)
        if i in (20, 21):
            w[10:10] = item
        if i in (30, 31, 32):
            w[50:50] = passage
        rows.append((i, " ".join(w), ["en", "fr"][i % 2], ["a", "b", None][i % 3], 1, "x"))
    rows.append((80, rows[5][1], "en", "a", 1, "x"))
    rows.append((81, rows[6][1].replace(rows[6][1].split()[60], "changed", 1), "en", "a", 1, "x"))
    rows.append((82, "1234 !!", "en", "a", 1, "x"))
    rows.append((83, None, None, None, None, None))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages_take_effect(spark, folder):
    docs, ids, texts = spark.read.parquet(f"{folder}/documents.parquet"), [], []
    for name, stage in cp.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        ids.append({r.doc_id for r in rows})
        texts.append({r.doc_id: r.text for r in rows})
        if name != cp.STAGES[-1][0]:
            assert docs.columns == list(cp.COLUMNS)
    assert ids[0] == {*range(82)} and ids[1] == {*range(80)}
    assert ids[2] == ids[1] and all(len(texts[2][i]) < len(texts[1][i]) - 200 for i in (31, 32)) and texts[2][30] == texts[1][30]
    # of the two that hold the item the second lost it as a repeated passage
    assert ids[3] == ids[2] - {20}
    assert ids[4] <= ids[3] and all(r.copies in (1, 2, 3) for r in docs.collect())


def test_run(spark, folder):
    assert cp.run(spark, folder).columns == [*cp.COLUMNS, "copies"]


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_empty(spark, folder, empty, name, stage):
    assert stage(spark, empty, folder).collect() == []


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_odd_rows(spark, folder, odd, name, stage):
    assert stage(spark, odd, folder).count() <= 18


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_clashing_names(spark, folder, name, stage):
    """Columns named as a stage names its own change nothing, and don't come through."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("extra")
    clash = docs.selectExpr("*", "'x' as row", "1 as __row", "'no' as lang_pred", "9.5D as score", "-1L as component_id", "2 as copies", "'k' as kept", "'t' as kept_text", "0 as n_removed", "7 as size", "3.0D as target")
    want, got = stage(spark, docs, folder), stage(spark, clash, folder)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_leak_without_id_goes_and_other_rows_without_id_stay(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    rows = [(None, f"some words before {item}", "en", "a", 1, "x"), (None, "a text of its own without an item", "en", "a", 1, "x"), (5, "another one that stays", "en", "a", 1, "x")]
    left = cp.benchmark_leaks(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    assert {(r.doc_id, r.text) for r in left} == {(r[0], r[1]) for r in rows[1:]}
