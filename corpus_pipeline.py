"""A training corpus from raw documents: quality rules, near-dedup, decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a DataFrame. Every stage
is written as Parquet to the shared folder and read again before the next one. All but the last return rows with the
columns of documents; the last one returns a row for each document that it wrote.

Cases, for every stage: columns of any name and type beside doc_id, text and source are passed through; a null text counts
as an empty one; rows with one id, or without, are rows of their own; of rows that are equal in all columns near-dedup keeps
one; which of several near copies stays follows from ids, then from a hash of all columns, so reruns agree; an empty table
gives an empty one. The mix may take a row twice, so token files can have two documents with one id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueloom.llm import decontaminate, mixing, quality, simhash, tokens
from cueloom.llm.common import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned ones reject."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more), the one with the smallest id."""
    return simhash.one_of_each(docs, similarity=(4, 5))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of 13 words of any benchmark item, and of which shorter items cover less than a twentieth."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each time that the mix takes it, cut where it takes only a part."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the token files."""
    import public_tokenizers

    return tokens.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", good_quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("source_mixing", mixed),
    ("token_files", tokenized),
]

#: Fingerprints, learned rules and a tokenizer are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
