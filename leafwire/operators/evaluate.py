"""Scoring replies against gold records, gates, comparisons, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwire.functions import native, udfs

#: The least value of each metric at each stage.
GATES = [
    ("smoke", "valid_fidelity", 0.50),
    ("warm", "valid_fidelity", 0.75),
    ("warm", "holdout_fidelity", 0.2301),
    ("mid", "valid_parse", 0.95),
    ("full", "valid_parse", 0.98),
    ("full", "valid_fidelity", 0.95),
    ("full", "holdout_parse", 0.98),
    ("full", "holdout_fidelity", 0.95),
]
NOTE = "the token ratio against JSON (at most 0.92) is judged by compare() with a tokenizer"


def scored(pairs: DataFrame, gold: str = "gold", candidate: str = "candidate", thinks: bool = True) -> DataFrame:
    """``pairs`` with gold_ok, parse, fidelity, repaired, error (its first line) and output (its start, on failure).

    Both decodes stand in one projection: each record is decoded once.
    """
    reply = native.strip_think(candidate) if thinks else F.col(candidate)
    reply = F.regexp_replace(reply, r"(?U)\A\s+|\s+\z", "")
    both = udfs.decoded_together(pairs.withColumn("_reply", reply), _gold=gold, _read="_reply")
    parse = F.coalesce(F.col("_read.ok"), F.lit(False))
    fidelity = parse & F.coalesce(F.col("_gold.value") == F.col("_read.value"), F.lit(False))
    out = both.withColumns({"gold_ok": F.coalesce(F.col("_gold.ok"), F.lit(False)), "parse": parse, "fidelity": fidelity, "repaired": parse & (F.size("_read.repairs") > 0)})
    out = out.withColumn("error", native.first_error_line("_read.error"))
    return out.withColumn("output", F.when(~(F.col("parse") & F.col("fidelity")), native.shortened("_reply", "output"))).drop("_reply", "_gold", "_read")


def groups(rows: DataFrame, by: str = "grp") -> DataFrame:
    """Per group: parse, fidelity, repaired, n and skipped. Rows whose gold is unreadable count as skipped alone."""
    ok = F.col("gold_ok")
    return rows.groupBy(by).agg(
        F.count_if(ok & F.col("parse")).alias("parse"),
        F.count_if(ok & F.col("fidelity")).alias("fidelity"),
        F.count_if(ok & F.col("repaired")).alias("repaired"),
        F.count_if(ok).alias("n"),
        F.count_if(~ok).alias("skipped"),
    )


def fractions(scores: DataFrame, by: str = "grp") -> DataFrame:
    """(metric, actual), such as valid_parse; null where a group has no rows."""
    both = F.explode(F.array(*[F.struct(F.concat(F.col(by), F.lit(f"_{m}")).alias("metric"), native.fraction(m, "n").alias("actual")) for m in ("parse", "fidelity")]))
    return scores.select(both.alias("x")).select("x.metric", "x.actual")


def gate_table(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{s}', '{m}', {t}D)" for s, m, t in GATES)
    return spark.sql(f"select * from values {values} as t(stage, metric, threshold)")


def checks(scores: DataFrame, by: str = "grp") -> DataFrame:
    """stage, metric, threshold, actual, ok of every gate; a metric that is absent fails."""
    found = gate_table(scores.sparkSession).join(fractions(scores, by), "metric", "left")
    return found.select("stage", "metric", "threshold", F.round("actual", 4).alias("actual"), F.coalesce(F.col("actual") >= F.col("threshold"), F.lit(False)).alias("ok"))


def gate(scores: DataFrame, stage: str, by: str = "grp") -> dict:
    """The verdict of one stage; passed is None for a stage without gates."""
    rows = checks(scores, by).where(F.col("stage") == stage).orderBy("metric").collect()  # four rows at most
    return {"stage": stage, "passed": all(r["ok"] for r in rows) if rows else None, "checks": [{k: r[k] for k in ("metric", "threshold", "actual", "ok")} for r in rows], "note": NOTE if stage == "full" else None}


def self_test(scores: DataFrame, least: float = 0.8, by: str = "grp") -> DataFrame:
    """Groups and whether enough of their replies are faithful."""
    return scores.select(by, (F.col("fidelity") >= least * F.col("n")).alias("passed"))


#: Fixed value: the most that records may need of the tokens of the same JSON.
TOKEN_RATIO = 0.92


def compare(pairs: DataFrame, gold: str = "gold", record: str = "candidate", base: str = "base", by: str = "grp", tokenizer: str | None = None) -> DataFrame:
    """Per group: how often the record and the base model's JSON are right, their bytes and words, and the ratio of bytes.

    With the path of a ``tokenizer`` also their tokens, the ratio of these, and whether that passes TOKEN_RATIO.
    """
    rows = udfs.decoded_together(pairs, {"_b": base}, _w=gold, _r=record)
    right = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    tokens = [F.sum(udfs.token_count(c, tokenizer)).alias(f"{name}_tokens") for name, c in (("record", record), ("base", base))] if tokenizer else []
    sums = rows.groupBy(by).agg(
        F.count("*").alias("n"),
        right(F.col("_r.ok")).alias("record_parse"),
        right(F.col("_r.value") == F.col("_w.value")).alias("record_fidelity"),
        right(F.col("_b.json").isNotNull()).alias("base_parse"),
        right(F.col("_b.canon") == F.col("_w.value")).alias("base_fidelity"),
        F.sum(F.octet_length(record)).alias("record_bytes"),
        F.sum(F.octet_length(base)).alias("base_bytes"),
        F.avg(native.word_count(record)).alias("record_words"),
        F.avg(native.word_count(base)).alias("base_words"),
        *tokens,
    )
    sums = sums.withColumn("ratio", native.fraction("record_bytes", "base_bytes"))
    if not tokenizer:
        return sums
    return sums.withColumn("token_ratio", native.fraction("record_tokens", "base_tokens")).withColumn("tokens_ok", F.col("token_ratio") <= TOKEN_RATIO)


def parity(left: DataFrame, right: DataFrame, key: str = "rec_id") -> DataFrame:
    """Rows (key, ok, value on both sides) whose results disagree, or that one side lacks. Results: key, ok, value."""
    a, b = left.select(key, F.col("ok").alias("ok_a"), F.col("value").alias("value_a")), right.select(key, F.col("ok").alias("ok_b"), F.col("value").alias("value_b"))
    return a.join(b, key, "full").where("not (ok_a <=> ok_b) or (ok_a and not (value_a <=> value_b))")


def leaf_table(df: DataFrame, value: str, key: str = "rec_id") -> DataFrame:
    """key, path, type, leaf of every leaf of a JSON column."""
    return df.select(key, F.explode(udfs.flatten_json(value)).alias("x")).select(key, "x.path", "x.type", "x.leaf")


def tree_diff(df: DataFrame, expected: str, got: str, key: str = "rec_id") -> DataFrame:
    """key, rank, path of each leaf of ``expected`` that ``got`` drops (1), types otherwise (2) or changes (3)."""
    a, b = leaf_table(df, expected, key), leaf_table(df, got, key)
    b = b.select(key, "path", F.col("type").alias("type_b"), F.col("leaf").alias("leaf_b"))
    rank = F.when(F.col("leaf_b").isNull(), 1).when(F.col("type") != F.col("type_b"), 2).when(F.col("leaf") != F.col("leaf_b"), 3)
    return a.join(b, [key, "path"], "left").withColumn("rank", rank).where("rank is not null").select(key, "rank", "path")


def last_loss(log: DataFrame, loss: str = "loss", step: str = "step") -> DataFrame:
    """The last loss that is not null."""
    return log.agg(F.expr(f"max_by({loss}, {step}) filter (where {loss} is not null)").alias("last_loss"))

