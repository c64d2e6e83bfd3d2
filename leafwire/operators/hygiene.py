"""Checks of a split corpus as one report: check, level, subject, detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwire.functions import native, udfs

#: Shapes that only the holdout may have.
HOLDOUT_SHAPES = ("multiline_body", "pathological_keys", "large_table", "deep_array_literal", "flat_inline_object")
REPORT = "check string, level string, subject string, detail string"


def holdout_table(spark: SparkSession, shapes: tuple[str, ...] = HOLDOUT_SHAPES) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in shapes])).alias("shape"))


def _row(check: str, level: str, subject: str, detail: str) -> list:
    return [F.lit(check).alias("check"), F.lit(level).alias("level"), F.expr(subject).cast("string").alias("subject"), F.expr(detail).cast("string").alias("detail")]


def purity(corpus: DataFrame, shapes: tuple[str, ...] = HOLDOUT_SHAPES) -> DataFrame:
    """Holdout rows of other shapes fail; holdout shapes without rows are a warning."""
    held, named = corpus.where("split = 'holdout'").select("shape").distinct(), holdout_table(corpus.sparkSession, shapes)
    strange = held.join(named, "shape", "left_anti").select(*_row("holdout_purity", "FAIL", "shape", "'not a holdout shape'"))
    absent = named.join(held, "shape", "left_anti").select(*_row("holdout_purity", "WARN", "shape", "'no rows'"))
    return strange.unionByName(absent)


def leaks(corpus: DataFrame, shapes: tuple[str, ...] = HOLDOUT_SHAPES) -> DataFrame:
    """Holdout shapes in the splits train and valid."""
    found = corpus.where("split in ('train', 'valid')").groupBy("split", "shape").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(holdout_table(corpus.sparkSession, shapes)), "shape", "left_semi").select(*_row("leak", "FAIL", "concat(split, '/', shape)", "n"))


def shape_counts(corpus: DataFrame, split: str = "valid") -> DataFrame:
    return corpus.where(F.col("split") == split).groupBy("shape").agg(F.count("*").alias("n"))


def balance(corpus: DataFrame) -> DataFrame:
    """Shapes of train that valid lacks, and counts in valid that are more than one apart."""
    counts = shape_counts(corpus)
    lacking = corpus.where("split = 'train'").select("shape").distinct().join(counts, "shape", "left_anti").select(*_row("stratified", "FAIL", "shape", "'not in valid'"))
    spread = counts.agg((F.max("n") - F.min("n")).alias("spread")).where("spread > 1").select(*_row("stratified", "FAIL", "'valid'", "spread"))
    return lacking.unionByName(spread)


def containment(corpus: DataFrame, prompt: str = "prompt", source: str = "source", key: str = "rec_id", strict: bool = False) -> DataFrame:
    """key and the leaves of its source that its prompt does not show, for every row."""
    leaves = udfs.primitive_leaves_strict(source) if strict else udfs.primitive_leaves(source)
    return corpus.withColumn("_leaves", leaves).select(key, native.missing_parts(prompt, "_leaves").alias("missing"))


def contained(corpus: DataFrame, **names: str) -> DataFrame:
    """One row: how many examples were checked and how many have a leaf that their prompt lacks."""
    found = containment(corpus, **names)
    return found.agg(F.count("*").alias("checked"), F.count_if(F.size("missing") > 0).alias("bad"))


def report(corpus: DataFrame, shapes: tuple[str, ...] = HOLDOUT_SHAPES) -> DataFrame:
    """All checks. ``corpus``: split, shape, rec_id, prompt, source (JSON text)."""
    bad = containment(corpus).where(F.size("missing") > 0).select(*_row("containment", "FAIL", "rec_id", "array_join(missing, ', ')"))
    return purity(corpus, shapes).unionByName(leaks(corpus, shapes)).unionByName(balance(corpus)).unionByName(bad)


def passed(found: DataFrame) -> bool:
    return found.where("level = 'FAIL'").isEmpty()
