"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes each stage's rows as Parquet to the shared
folder and reads them back as the next stage's documents. All stages but the last return the columns of ``documents``.

Defined results, for all stages: a null text counts as an empty one and stays null where documents are handed on; rows of null id
stay through every filter that does not reject their text; of rows that repeat an id each is judged by its own text; an empty
table gives an empty table; texts of any length are read whole; extra columns, whatever their names, are handed on unread. Ids are
whole numbers. ``tests/llm/test_pipeline.py`` holds the stages against plain Python.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from normslice.llm import bpe, decontaminate, near_copies, secrets, simhash, toxicity
from normslice.llm.common import shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity 0.8) stays: the one of the smallest id."""
    return simhash.keep_smallest(docs, near_copies.near_copies(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with the digests of the round trip."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("byte_level_bpe", tokenize),
]

#: Fitted models, fingerprints and merges are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
