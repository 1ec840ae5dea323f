"""Hot keys: joins with the first of a kind are split by adaptive execution."""

from __future__ import annotations

import contextlib

import pytest
from caselog.llm import spans, suffixes
from tests.llm import cases

SPLIT = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
}


@contextlib.contextmanager
def small_tasks(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark):
    """A passage that 70 % of all documents share, between words of their own."""
    common = " ".join(cases.words(60)) + "."
    texts = [" ".join(cases.words(30, i + 1)) + ". " + (common if i % 10 < 7 else " ".join(cases.words(50, 5000 + i)) + ".") for i in range(1500)]
    return cases.documents(spark, texts).repartition(12)


def test_a_span_of_most_documents_is_split(spark, docs):
    with small_tasks(spark):
        assert "skew=true" in executed(spans.repeated(docs))


def test_a_stretch_of_most_documents_is_split(spark, docs):
    with small_tasks(spark):
        assert "skew=true" in executed(suffixes.repeated(docs))
