"""Stages on documents whose other columns bear the names that operators use inside."""

from __future__ import annotations

from caselog.llm import decontaminate, jaccard, mixing, quality, sharding
from tests.llm import cases

TEXTS = [" ".join(cases.words(60, i)) for i in range(6)]


def clashing(spark):
    return cases.documents(spark, TEXTS, clash=True)


def whole(docs, df):
    """All columns as they were, and in all clashing ones the old value."""
    assert df.columns == docs.columns
    rows = df.collect()
    assert all(r[name] == "clash" for r in rows for name in cases.CLASHES)
    return {r["doc_id"]: r["text"] for r in rows}


def test_filtering_stages_keep_clashing_columns(spark):
    docs = clashing(spark)
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert whole(docs, quality.keep(docs)) == want
    assert whole(docs, jaccard.deduplicate(docs)) == want
    assert whole(docs, decontaminate.clean(docs, items)) == want
    mixed = whole(docs, mixing.applied(docs, mixing.mix(docs)))
    assert mixed and all(want[i].startswith(text) for i, text in mixed.items())


def test_shards_keep_clashing_columns(spark, tmp_path):
    docs = clashing(spark)
    folder = sharding.write_shards(docs, str(tmp_path / "s"), 3)
    assert folder not in docs.columns
    back = spark.read.parquet(str(tmp_path / "s"))
    assert whole(docs, back.drop(folder).select(*docs.columns)) == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r[folder] for r in back.collect()} == {0, 1, 2}


def test_one_row_stays_of_a_component_with_tied_or_null_ids(spark):
    near = cases.words(60)
    other = [*near[:59], "else"]
    rows = [(5, near), (5, other), (None, near), (None, other)]
    table = [(i, " ".join(w), "en", "a", 1) for i, w in rows]
    assert jaccard.deduplicate(spark.createDataFrame(table, cases.COLUMNS)).count() == 1
    kept = jaccard.deduplicate(spark.createDataFrame(table[2:], cases.COLUMNS)).collect()
    assert [r["doc_id"] for r in kept] == [None]


def test_copies_send_their_set_once_a_task(spark):
    texts = [" ".join(cases.words(60))] * 500 + [" ".join(cases.words(60, 1))]
    docs = cases.documents(spark, texts).coalesce(2)
    per_key = jaccard._signatures(docs, {}).groupBy("key", "node").count().agg({"count": "max"}).first()[0]
    assert per_key <= 2
