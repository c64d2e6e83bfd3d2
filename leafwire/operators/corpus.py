"""Building a corpus: sampling by shape, merging, deduplication, pairing, caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwire.functions import udfs


def shape_of(meta: str = "meta") -> Column:
    return F.coalesce(F.col(meta)["shape"], F.lit("?"))


def task_of(meta: str = "meta") -> Column:
    return F.coalesce(F.col(meta)["task"], F.lit("?"))


def _round_robin(df: DataFrame, shape: str, order: list[Column], n: int) -> DataFrame:
    """The first of every shape, then the second, and so on, ``n`` rows in all; a shape that runs out is passed over.

    No shape can have more than ``n`` rows among them, and that limit reaches below the shuffle.
    """
    ranked = df.withColumn("_turn", F.row_number().over(Window.partitionBy(shape).orderBy(*order))).where(F.col("_turn") <= max(0, n))
    return ranked.orderBy("_turn", shape).limit(max(0, n)).drop("_turn")


def sample(df: DataFrame, n: int, seed: int = 0, shape: str = "shape", key: str = "rec_id") -> DataFrame:
    """A sample with shapes in turn, each shape's rows in a seeded order that does not depend on the partitions."""
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")))
    return _round_robin(df, shape, [order, F.col(key)], n)


def stratify(df: DataFrame, n: int, shape: str = "shape", key: str = "rec_id") -> DataFrame:
    """As :func:`sample`, each shape's rows in the order of ``key``."""
    return _round_robin(df, shape, [F.col(key)], n)


def head(df: DataFrame, n: int, key: str = "rec_id") -> DataFrame:
    """The first rows in file order."""
    return df.orderBy(key).limit(n)


def capped(df: DataFrame, most: int = 2285, key: str = "rec_id") -> DataFrame:
    """At most so many rows, by key; 0 keeps all."""
    return head(df, most, key) if most > 0 else df


def merge(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_real(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """Real rows join the splits train and valid; holdout stays as it is."""
    return synthetic.unionByName(real.where(F.col("split").isin("train", "valid")))


def valid_share(synthetic_valid: int, shapes: int) -> int:
    """How many real rows keep the split valid within one row per shape."""
    return synthetic_valid // shapes if shapes else 0


def dedupe_text(df: DataFrame, text: str = "text", key: str = "rec_id") -> DataFrame:
    """One row of each text, that of the smallest key (any of rows that are equal in both).

    Texts are not shuffled: their 256-bit digests and lengths are grouped, and the rows are found again by
    digest and key.
    """
    digest, least = F.sha2(F.col(text), 256), "_least"
    named = df.withColumn("_digest", F.concat_ws("/", F.coalesce(digest, F.lit("null")), F.octet_length(text).cast("string")))
    first = named.groupBy("_digest").agg(F.min(key).alias(least)).withColumnRenamed("_digest", "_of")
    kept = named.join(first, (F.col("_digest") == F.col("_of")) & F.col(key).eqNullSafe(F.col(least)), "left_semi")
    return kept.dropDuplicates([key, "_digest"]).select(*df.columns)


def dedupe_json(df: DataFrame, value: str, key: str = "rec_id") -> DataFrame:
    """One row of each JSON value, whatever its key order and spacing; rows that are not JSON go."""
    named = df.withColumn("canon", udfs.canon(value)).where("canon is not null")
    return dedupe_text(named, "canon", key)


def lossless(df: DataFrame, raw: str, value: str) -> DataFrame:
    """Rows whose record decodes to their JSON value."""
    read = udfs.decoded(df, raw, "_read")
    return read.where(F.col("_read.ok") & (F.col("_read.value") == udfs.canon_loose(value))).drop("_read")


def ingest(df: DataFrame, raw: str, value: str, key: str = "rec_id", most: int = 0) -> DataFrame:
    """Real values: only those whose record is lossless, one of each value, capped."""
    return capped(dedupe_json(lossless(df, raw, value), value, key), most, key)


def chat_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, prompt, reply) of each user turn that an assistant turn follows."""
    w = Window.partitionBy(conv).orderBy(turn)
    rows = turns.withColumn("_role", F.lead("role").over(w)).withColumn("reply", F.lead("text").over(w))
    return rows.where("role = 'user' and _role = 'assistant'").select(conv, turn, F.col("text").alias("prompt"), "reply")


def budget(micro: int, batch: int, accumulation: int, iterations: int, rows: int) -> dict[str, float]:
    """Steps of a training run when the micro-batch changes: the number of examples seen stays."""
    steps = max(1, accumulation * (batch // micro if micro else 1))
    most = max(1, iterations // steps)
    return {"micro_batch": micro, "grad_accum": steps, "max_steps": most, "examples_seen": most * micro * steps, "epochs": most * micro * steps / rows if rows else 0.0}
