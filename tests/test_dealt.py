"""Rows are dealt out before they are decoded: a file of one row group is a single task's, whatever its splits."""

import pytest
from pyspark.sql import functions as F

from leafwire.functions import codec, udfs
from leafwire.plans import more  # noqa: F401  (registers its queries)
from leafwire.plans.queries import QUERIES, pairs, records

DEALT = ["perturbed_schemas", "decode_bare_rollup", "decode_multiline", "schema_typed", "lenient_errors", "score_pairs", "structural_damage", "repair_wraps", "repair_blocks", "compare_candidates", "flatten_braces", "decode_nested_path", "decode_typed", "decode_inline_object", "repair_separator", "reject_records", "extract_json_fenced", "flatten_leaves", "leaf_containment", "canon_dedupe", "tree_diff", "describe_diff", "grammar_accept", "leaf_rows", "ingest_lossless", "lenient_sparse", "two_equalities", "repeated_key_order", "batch_results", "loss_digits"]


def scans_of_decodes(df):
    """For each scan below a decode, whether its rows are dealt out on the way."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return ["REPARTITION_BY_NUM" in x for x in plan.partition("ArrowEvalPython")[2].split("FileScan")[:-1]]


@pytest.mark.parametrize("name", DEALT)
def test_dealt_out_before_decoding(spark, sf_dir, name):
    found = scans_of_decodes(QUERIES[name](spark, sf_dir))
    assert found and all(found)


def test_pairs_are_dealt_out(spark, sf_dir):
    assert pairs(spark, sf_dir).select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism


def test_tasks_grow_with_the_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr("leafwire.plans.queries.SHARE", 64)
    rows = records(spark, sf_dir, "customer")
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert rows.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and max(counts) < sum(counts) / 4


@pytest.mark.parametrize("name", ["compare_candidates", "score_pairs"])
def test_one_worker_a_task(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("FileScan") == 1


def test_lines_need_no_worker(spark):
    rows = more.told(spark, ["a", "b\n"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation")
    assert rows.schema.simpleString() == "struct<line:string>" and [r.line for r in rows.collect()] == ["a", "b\n"]


def test_found_json(spark):
    texts = ['say {"b": 1, "a": 2.0} ok', "none", None, "[1, 2] x", "NaN", '{"a": NaN}', "[" * 3000 + "]" * 3000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(udfs.found_json("t").alias("x"), udfs.extract_json("t").alias("json"), udfs.canon(udfs.extract_json("t")).alias("canon")).collect()
    assert [(r.x and r.x.json, r.x and r.x.canon) for r in got] == [(r.json, r.canon) for r in got] and got[0].json == '{"b":1,"a":2.0}'


def test_short_ways_of_the_scan():
    assert codec.path_of("a.b c.d]") == ["a", "b c", "d]"] and codec.path_of("a[0].<<<b.c>>>") == ["a", 0, "b.c"]
    for key in ("", ".", "a.", ".a", "a..b"):
        with pytest.raises(codec.Unreadable):
            codec.path_of(key)
    assert codec.split_cells("a},b") == ["a}", "b"] and codec.split_cells("{a,b},c") == ["{a,b}", "c"] and codec.split_cells("") == [""]
    assert codec.first_outside("<<<a=b>>>:c", "=:") == 9 and codec.first_outside("a:b=c", "=:") == 1 and codec.first_outside("a", "=:") == -1
    assert codec.decode("a=<b=[\n1\n]")["value"] == {"a=<b": [1]}


def test_one_scan_for_all_schemas(monkeypatch):
    scans = []
    monkeypatch.setattr(codec.Scan, "run", lambda self, run=codec.Scan.run: scans.append(1) or run(self))
    texts = ["a=1\nb.c[0]=x", "a: 1\na=2", "```\nx=<<<7f\na\n>>>01\n```", "no line", "a: 1\nbad", "r=[\n1\n]\nt::u\nt[0]=1", "a[0]=1\na[2]=1"]
    schemas = [None, "a:n\nb.c[]:s", "a:s?", "x:t", "r[]:n\nt[]:o", "bad"]
    for text in texts:
        for decode in (codec.decode, codec.decode_lenient):
            fresh = [(codec.scanned.cache_clear(), decode(text, s))[1] for s in schemas]
            scans.clear()
            codec.scanned.cache_clear()
            assert [decode(text, s) for s in schemas + schemas] == fresh + fresh and len(scans) <= 1
