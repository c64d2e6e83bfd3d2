"""Legs of a stage, one after the other; the first that fails ends it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwire.functions import udfs
from leafwire.operators import hygiene, report


class LegFailed(RuntimeError):
    """A leg of a stage did not pass; the legs after it were not run."""


def run(legs: list[tuple[str, Callable[[], Any]]]) -> dict[str, Any]:
    """Each leg's result by name. A leg fails by raising or by returning False."""
    done: dict[str, Any] = {}
    for name, leg in legs:
        try:
            done[name] = leg()
        except Exception as error:
            raise LegFailed(f"{name}: {error}") from error
        if done[name] is False:
            raise LegFailed(name)
    return done


def meter_leg(spark: SparkSession) -> bool:
    """The meter itself: an echo must be faithful, prose must not parse."""
    rows = spark.createDataFrame([("echo", "a=1", "a=1"), ("prose", "a=1", "words")], "grp string, gold string, candidate string")
    groups = report.payload(rows)["groups"]
    return groups["echo"]["fidelity"] == 1 and groups["prose"]["parse"] == 0


def stage(spark: SparkSession, corpus: DataFrame, pairs: DataFrame, name: str, shapes: tuple[str, ...] = hygiene.HOLDOUT_SHAPES) -> dict[str, Any]:
    """Meter, data checks, evaluation and gate of one stage."""
    return run([("meter", lambda: meter_leg(spark)), ("data", lambda: hygiene.passed(hygiene.report(corpus, shapes))), ("evaluation", lambda: report.payload(pairs, stage=name))])


def lint(cases: DataFrame, text: str = "input", expected: str = "accept") -> DataFrame:
    """Cases that the grammar judges otherwise than expected."""
    judged = cases.withColumn("accepted", udfs.accepts(text))
    return judged.where(F.col("accepted") != F.col(expected))
