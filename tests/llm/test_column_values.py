"""Columns of the caller's that are named like an operator's own keep their values."""

import pytest

from examlytics.llm import decontaminate, exact_dedup, language_id, minhash_dedup, warc

NAMES = ["__key", "__nth", "__root", "__row", "__id", "__hits", "kept", "a.b"]


@pytest.fixture(scope="module")
def table(spark):
    prose = "the quick brown fox jumps over the lazy dog and runs far away from the old grey house at night"
    texts = [prose, prose, prose.upper(), f"{prose} again", "", None, "alone in the dark"]
    rows = [(i, t, "en", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    schema = ", ".join(["doc_id long", "text string", "lang string", *[f"`{n}` string" for n in NAMES]])
    return spark.createDataFrame(rows, schema).repartition(3)


def same_values(got, table, ids):
    assert got.columns == table.columns and got.dtypes == table.dtypes
    want = {r.doc_id: tuple(r) for r in table.collect()}
    assert sorted(map(tuple, got.collect()), key=str) == sorted((want[i] for i in ids), key=str)


def test_stages(spark, table):
    same_values(exact_dedup.drop_copies(table), table, [1, 2, 3, 5, 6])
    same_values(minhash_dedup.keep_one(table, percent=80), table, [0, 4, 5, 6])
    bench = spark.createDataFrame([(1, "alone in the dark")], "item_id long, text string")
    same_values(decontaminate.drop_contaminated(table, bench), table, range(6))


def test_outputs_replace_columns_of_their_names(spark, table):
    rows = table.select(*[c for c in table.columns if c != "a.b"]).withColumnRenamed("kept", "score").withColumnRenamed("__key", "lang_pred")
    got = language_id.predict(rows, *language_id.train(rows))
    assert got.columns.count("score") == 1 == got.columns.count("lang_pred")
    assert {r.doc_id: r["__nth"] for r in got.select("doc_id", "__nth", "score", "lang_pred").collect()} == {i: f"__nth{i}" for i in range(7)}
    pages = table.select("doc_id", "text").toDF("record", "html").selectExpr("string(record) as record", "html", "'u' as url")
    made = warc.responses(pages)
    assert made.columns == ["html", "url", "record"] and all(bytes(r.record).startswith(b"WARC/") for r in made.collect())
