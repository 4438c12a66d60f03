"""The corpus pipeline: stages of weftcloud.llm applied to documents, each written and read again.

Defined cases, for every stage: null text counts as empty (the classifier rejects it, so later stages see none unless called alone); rows with
a null doc_id are judged by their text and never linked by it; repeated rows are exact copies of which one stays; an empty table gives an
empty table; all but the last stage return the columns of documents, whatever else documents holds; the last returns doc_id,
n_tokens, ids_sha256 and decoded_sha256 of every row. No stage changes the session's settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftcloud.llm import bpe_transducer, exact_dedup, minmax_dedup, queries, suffix_decontam, weak_labels
from weftcloud.llm.store import dropped, ship, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_labels.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax_dedup.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_decontam.remove_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_transducer.digests(bpe_transducer.round_trip(docs, queries.tokenizer_path(), keep=False))


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_exact_copies), ("MinHash near-dedup", drop_near_copies), ("benchmark decontamination", decontaminate), ("byte-level BPE", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
