"""From raw documents to token files: five stages, each one operator of ``leadloom.llm``.

A stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns
documents with unchanged columns; the last returns one row per document of the token
files. Its output is written as Parquet and read again as the next stage's ``docs``.

Defined results: rows with NULL text or NULL ids pass all stages like empty documents and are
not lost by joins; an empty table gives no rows; extra columns are kept to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import decontam, mixing, neardup, tokens, toxicity
from leadloom.llm.common import crc32_of_id, table
from leadloom.session import freeze

VOCABULARY = "byte_bpe_50k.json"
HELD_OUT = 5


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is not toxic; labels of every fifth id are not learned from."""
    learn = F.coalesce(crc32_of_id() % HELD_OUT != 0, F.lit(True))
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"), learn)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    return neardup.one_of_each(docs, width=5, percent=80)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; doc_id, start, n_tokens, ids_crc32 as read from them."""
    return tokens.encode_and_read(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", toxic_out), ("near_dedup", near_copies_out), ("decontamination", benchmark_out),
          ("mixing", mixed), ("token_files", token_files)]

#: No SQL: classifier, min-max hashing and tokenizer. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
