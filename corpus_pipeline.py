"""A training corpus from ``documents``: toxicity, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webcatalog.llm import mixing, packing, queries, secret_scan, simhash, toxicity
from webcatalog.llm.common import ready, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on the labelled ones among ``docs``, doesn't reject."""
    labels = ready(spark).read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs, labels, queries.TOXICITY)
    return toxicity.score(docs, chain, "toxic").where("NOT rejected").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose SimHashes (three-word shingles) link at three bits."""
    ready(spark)
    return simhash.keep_first_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    ready(spark)
    return secret_scan.redact(docs, written(secret_scan.scan(docs), "findings"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, each at least once."""
    ready(spark)
    return mixing.realise(docs, repetition_limit=queries.REPETITION_LIMIT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    ready(spark)
    return packing.pack(docs, queries.tokenizer_path(), keep_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The models and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
