"""Corpora and results: JSON lines, JSON documents, Parquet."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
#: ``source`` has leaves of different types from row to row, so it is a VARIANT and never inferred.
EXAMPLE = f"messages {MESSAGES}, meta struct<shape:string,task:string,variation_seed:bigint,source:variant>"
PROMPTS = f"messages {MESSAGES}"
SPLITS = ("train", "valid", "holdout")


class NoData(FileNotFoundError):
    """A file that has to be there is absent or empty."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can see the path, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_examples(spark: SparkSession, path: str, schema: str = EXAMPLE, missing_ok: bool = True) -> DataFrame:
    """Chat examples; blank lines are skipped. A missing file is empty or, if not ``missing_ok``, an error."""
    if not exists(spark, path):
        if not missing_ok:
            raise NoData(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages only: other columns are never parsed."""
    return read_examples(spark, path, PROMPTS, missing_ok=False)


#: Fixed value: the order in which the files of a corpus are read.
FILE_ORDER = ("valid", "holdout", "train")


def read_replies(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """split, place (of its file in FILE_ORDER), content: the assistant's texts of all files that are there."""
    parts = [replies(read_examples(spark, paths[name], PROMPTS)).select(F.lit(name).alias("split"), F.lit(i).alias("place"), "content") for i, name in enumerate(FILE_ORDER) if name in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str = EXAMPLE) -> DataFrame:
    """All splits with a column ``split``; those without a file are left out."""
    parts = [read_examples(spark, p, schema).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def replies(examples: DataFrame) -> DataFrame:
    """The assistant's text of each example."""
    return examples.select(F.get("messages", F.lit(1))["content"].alias("content"))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that hold more than white space."""
    return spark.read.text(path).where(F.col("value").rlike(r"(?U)\S")).count()


def validate(spark: SparkSession, train: str, valid: str) -> dict[str, int]:
    """Line counts of both files; an absent or empty one is an error before anything else starts."""
    out = {}
    for name, path in (("train", train), ("valid", valid)):
        if not exists(spark, path):
            raise NoData(f"{name}: {path} does not exist")
        out[name] = count_lines(spark, path)
        if not out[name]:
            raise NoData(f"{name}: {path} is empty")
    return out


def read_document(spark: SparkSession, path: str) -> DataFrame | None:
    """One JSON document, or None if there is no such file."""
    return spark.read.option("multiLine", True).json(path) if exists(spark, path) else None


def write_document(spark: SparkSession, path: str, payload: Any) -> None:
    """A result as indented JSON; folders are made, non-ASCII text stays."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray((json.dumps(payload, indent=2, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()


def write_examples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet by split, so that a read of one split reads nothing else."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def one_record(spark: SparkSession, text: str) -> DataFrame:
    """A record from the command line or standard input."""
    return spark.createDataFrame([(text,)], "raw string")
