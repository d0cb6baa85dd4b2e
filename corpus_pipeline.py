"""The corpus pipeline: quality rules, toxicity, exact dedup, SimHash near-dedup, best-fit packing.

Each stage takes the documents that the stage before it kept, with the columns of ``documents``, and
its decisions take effect; the last returns one row per packed piece. Every row is judged by its own
text, whatever its doc_id: rows that repeat a doc_id or have none go or stay one by one. Of equal and
of near texts the row with the smallest doc_id stays, null last. Empty input passes through as no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lintel.llm.common import ensure_checkpoint_dir, table
from lintel.llm.exact_dedup import keep_one_of_each
from lintel.llm.packing import pack_documents
from lintel.llm.quality_rules import keep_good
from lintel.llm.queries import tokenizer_path
from lintel.llm.simhash import keep_one_of_each_component
from lintel.llm.toxicity import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each_component(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("best-fit packing", packing),
]

#: Forests, factorization machines and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet to the shared folder and read again by the next."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
