"""The registered queries of this subpackage and their DuckDB SQL (none where SQL can't express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pseudoflow.llm import chat, collocations, exact_dedup, jaccard_join, packing, pii, quality_classifier, quality_rules, sentencepiece_codec, simhash, spelling, suffix_dedup, toxicity
from pseudoflow.llm.common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(read(spark, sf_dir, "documents")).drop("kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(read(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(read(spark, sf_dir, "documents"), every=31)


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_chat, op3_packing, op4_exact_dedup, op5_simhash, op6_suffix_dedup, op7_quality_rules,
    op8_quality_classifier, op9_sentencepiece, op10_toxicity, op11_collocations, op12_spelling, op13_jaccard,
)}
ORACLE = {"op2_chat": chat.SQL, "op4_exact_dedup": exact_dedup.SQL, "op7_quality_rules": quality_rules.SQL, "op11_collocations": collocations.SQL}
