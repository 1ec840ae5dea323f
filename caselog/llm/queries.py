"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.llm import alignment, decontaminate, jaccard, licenses, mixing, passages, quality, quotes, sharding, spans, suffixes, token_files, tries
from caselog.llm.common import documents, stored

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.cleaned(documents(spark, sf_dir))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.document_shards(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir)).select("doc_id", *quality.SCORES)


def op5_passage_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = passages.scored(docs, passages.train(docs, labels))
    return scores.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.report(found).drop("key", "text_hash")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(documents(spark, sf_dir), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(documents(spark, sf_dir)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(tries.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conversation-turns")
    return tries.trie(*tries.spliced(turns))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cleaned(documents(spark, sf_dir)).drop("kept")


def queries() -> dict[str, Query]:
    return {name: query for name, query in globals().items() if name.startswith("op") and callable(query)}
