"""A corpus pipeline: quality, near-duplicates, decontamination, secrets, packing.

Every stage takes any documents table with the columns of ``documents``, more columns and an empty table
included; all but the last return these columns. Each says below what null and repeated rows become.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwire.llm import decontaminate, similar, packing, quality, secrets
from leafwire.llm.common import keep, remove, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. A null text scores as an empty one; rows are judged one by one."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word Jaccard similarity of 0.8 or more), the document of the smallest id.

    Null and empty texts are copies of each other. Rows without an id go by their text alone.
    """
    return similar.drop_near_copies(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of any benchmark item occurs. Null and empty texts have none; rows are judged one by one."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), least=1).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark, n_chars brought up to date. Null texts stay null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences. Null texts are empty and have their end token; rows that repeat are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: A trained network, an iteration and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again as the next one's documents.

    The rows of a stage go when the next one has written its own; the result is written before the last ones go.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    out = keep(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, folder)
    return out
