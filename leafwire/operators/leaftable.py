"""A record's leaves as rows, and the format's rules over them as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwire.functions import udfs

INDEXED = r"\A(.+)\[([0-9]+)\]\z"


def explode_lines(df: DataFrame, text: str = "raw", key: str = "rec_id") -> DataFrame:
    """key, line (from 1), content: lines end at LF alone."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def explode_leaves(df: DataFrame, text: str = "raw", key: str = "rec_id") -> DataFrame:
    """key, pos, and the leaf's key (name), kind, raw, cells."""
    return df.select(key, F.posexplode(udfs.record_leaves(text)).alias("pos", "leaf")).select(key, "pos", F.col("leaf.key").alias("name"), "leaf.kind", "leaf.raw", "leaf.cells")


def simple_leaves(lines: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, line, name, raw of ``name=raw`` lines, without Python: for records known to hold nothing else."""
    found = F.regexp_extract("content", r"\A([^=:]+)=(.*)\z", 1)
    return lines.where(F.col("content").rlike(r"\A[^=:]+=")).select(key, "line", found.alias("name"), F.regexp_extract("content", r"\A([^=:]+)=(.*)\z", 2).alias("raw"))


def repeats(leaves: DataFrame, key: str = "rec_id") -> DataFrame:
    """How often each name stands in its record, where that is twice or more."""
    return leaves.groupBy(key, "name").agg(F.count("*").alias("n")).where("n > 1")


def index_repeats(leaves: DataFrame, key: str = "rec_id", order: str = "line") -> DataFrame:
    """Names that repeat get their running index."""
    w = Window.partitionBy(key, "name")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    return leaves.withColumn("name", F.when(n > 1, F.concat("name", F.lit("["), i.cast("string"), F.lit("]"))).otherwise(F.col("name")))


def visible_header(leaves: DataFrame, key: str = "rec_id", order: str = "line") -> DataFrame:
    """``leaves`` (name, header: the columns or null) with ``columns``: those of the last header above of the row's prefix."""
    prefix = F.coalesce(F.nullif(F.regexp_extract("name", INDEXED, 1), F.lit("")), F.col("name"))
    w = Window.partitionBy(key, "_prefix").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return leaves.withColumn("_prefix", prefix).withColumn("columns", F.last("header", ignorenulls=True).over(w)).drop("_prefix")


def dense_arrays(leaves: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, prefix, dense: whether the indices of each array run from 0 without a gap."""
    cut = leaves.select(key, F.regexp_extract("name", INDEXED, 1).alias("prefix"), F.nullif(F.regexp_extract("name", INDEXED, 2), F.lit("")).cast("int").alias("i")).where("i is not null")
    return cut.groupBy(key, "prefix").agg((F.max("i") + 1 == F.count_distinct("i")).alias("dense"))


def missing_required(leaves: DataFrame, required: list[str], key: str = "rec_id") -> DataFrame:
    """key and the required names that have no leaf."""
    have = leaves.groupBy(key).agg(F.collect_set("name").alias("have"))
    return have.select(key, F.array_except(F.array(*[F.lit(x) for x in required]), "have").alias("missing"))
