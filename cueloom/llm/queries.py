"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import decontaminate, licenses, lines, mixing, passages, quality, secrets, simhash, suffixes, tokens
from cueloom.llm.common import table
from cueloom.llm.oracles import ORACLE_SQL


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.BASE, "base_failed", "kept", "rule")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of candidates and of findings, where they start, and a digest of the findings."""
    scanned = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(spark, secrets.findings() + secrets.assigned()))
    found = F.filter("findings", lambda x: x["secret"])
    return scanned.select(
        "doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(found).cast("long").alias("n_findings"),
        F.array_join(F.transform(found, lambda x: x["start"].cast("string")), ",").alias("starts"),
        F.sha2(F.array_join(F.transform(found, lambda x: x["candidate"]), "\n"), 256).alias("findings_sha256"),
    )


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_lines": op2_lines,
    "op3_tokens": op3_tokens,
    "op4_passages": op4_passages,
    "op5_licenses": op5_licenses,
    "op6_mixing": op6_mixing,
    "op7_suffixes": op7_suffixes,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "pipeline": corpus_pipeline.run,
}
