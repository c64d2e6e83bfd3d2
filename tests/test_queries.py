"""Each query against its SQL; one decode a record; the rest of the package stands alone."""

import json

import pytest
from pyspark.sql import functions as F

from leafwire.functions import native, udfs
from leafwire.functions.trees import shown_strictly
from leafwire.operators import corpus, evaluate, hygiene, mutate, report
from leafwire.plans import more, stages  # noqa: F401  (more registers queries)
from leafwire.plans.queries import ORACLE_SQL, QUERIES, splits
from leafwire.sources import jsonl
from leafwire.streaming import records
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) is None


def test_one_evaluation_a_record(spark):
    rows = spark.range(5).select(F.concat(F.lit("a="), F.col("id")).alias("raw"))
    read = udfs.decoded(rows, "raw").where("decoded.ok").select("decoded.value", F.size("decoded.repairs"))
    assert read._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert read.count() == 5


def test_native_surface_is_the_codecs(spark):
    texts = ["```\na=1\n```", "a=1\r\nb=2", " ﻿a=1 ", "<raif>\na=1\n</raif>", "plain=1", "a=1\r\nb=2\r"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(native.strip_fence("t"), native.normalize_crlf("t"), native.trim_record("t"), native.strip_markers("t")).collect()
    assert got[0][0] == "a=1" and got[1][1] == "a=1\nb=2" and got[2][2] == "a=1" and got[3][3] == "a=1" and got[4][0] == "plain=1"
    scalars = ["true", "null", "12", "-0", "1.5", "<<<x>>>", 'a"b', "007", "[]"]
    got = spark.createDataFrame([(s,) for s in scalars], "s string").select(native.infer_scalar("s")).collect()
    assert [json.loads(r[0]) for r in got] == [True, None, 12, 0, 1.5, "x", 'a"b', "007", []]


def test_native_text(spark):
    row = spark.createDataFrame([("Qwen/Q2", "  <think>x\ny</think> hi", '{"a": 1}', "not json")], "m string, r string, j string, n string")
    got = row.select(native.template_family("m"), native.strip_think("r"), native.translate_prompt("j"), native.translate_prompt("n"), native.license_of("m"), native.variant_for_model("r", F.lit(False)), native.word_count("n")).first()
    assert got[0] == "chatml" and got[1] == "hi" and got[2].endswith('{"a": 1}') and got[3] == "not json" and got[4] == "apache-2.0" and got[5].startswith("  <think>") and got[6] == 2


def test_json_functions(spark):
    rows = spark.createDataFrame([('{"b":5.0,"a":[1,{"c":null}]}', '{"a":[1,{"c":null}],"b":5}')], "x string, y string")
    got = rows.select(udfs.canon_equal("x", "y"), udfs.value_equal("x", "y"), udfs.primitive_leaves("x"), udfs.flatten_json("x"), udfs.minify("x"), udfs.four_digits(F.lit(0.123456)), udfs.four_digits(F.lit(None).cast("double"))).first()
    assert got[0] is False and got[1] is True and got[2] == ["5.0", "1", "null"] and [r.path for r in got[3]] == ["b", "a[0]", "a[1].c"]
    assert got[4] == '{"b":5.0,"a":[1,{"c":null}]}' and got[5] == "0.1235" and got[6] == "—"
    assert [shown_strictly(x) for x in (1e-7, 1e16, 1e21, 1.25e-5, True)] == ["1e-7", "10000000000000000", "1e+21", "0.0000125", "true"]
    found = spark.createDataFrame([("say {\"a\": 1} ok",), ("[1, 2] x",), ("none",)], "t string").select(udfs.extract_json("t")).collect()
    assert [r[0] for r in found] == ['{"a":1}', "[1,2]", None]


def test_sources(spark, tmp_path):
    path = str(tmp_path / "train.jsonl")
    rows = [{"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": f"a={i}"}], "meta": {"shape": "s", "task": "t", "variation_seed": i, "source": {"label": x}}} for i, x in enumerate([1, True])]
    open(path, "w").write("\n\n".join(map(json.dumps, rows)) + "\n")
    got = jsonl.read_examples(spark, path)
    assert got.count() == 2 and got.select(F.to_json(got.meta.source)).collect()[1][0] == '{"label":true}'
    assert jsonl.read_examples(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(jsonl.NoData):
        jsonl.read_messages(spark, str(tmp_path / "none.jsonl"))
    assert jsonl.count_lines(spark, path) == 2
    assert [r.content for r in jsonl.replies(got).collect()] == ["a=0", "a=1"]
    assert jsonl.validate(spark, path, path) == {"train": 2, "valid": 2}
    (tmp_path / "empty.jsonl").write_text("\n \n")
    with pytest.raises(jsonl.NoData):
        jsonl.validate(spark, path, str(tmp_path / "empty.jsonl"))
    jsonl.write_document(spark, str(tmp_path / "new" / "r.json"), {"ü": 1})
    assert "ü" in (tmp_path / "new" / "r.json").read_text()
    assert jsonl.read_document(spark, str(tmp_path / "no.json")) is None
    both = jsonl.read_splits(spark, {"train": path, "holdout": str(tmp_path / "none.jsonl")})
    jsonl.write_splits(both.select("messages", "split"), str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).where("split = 'train'").count() == 2


def test_meter_and_gate(spark):
    gold = "a=1\nb=x"
    rows = [("valid", 1, gold, gold), ("valid", 2, gold, gold + "\nc=2"), ("valid", 3, gold, "just prose"), ("valid", 4, gold, "well: a=1"), ("valid", 5, gold, f"<think>hm</think>\n{gold}"), ("holdout", 6, "unreadable", gold), ("holdout", 7, gold, None)]
    scored = evaluate.scored(spark.createDataFrame(rows, "grp string, rec_id long, gold string, candidate string"))
    got = {r["rec_id"]: (r["parse"], r["fidelity"], r["repaired"]) for r in scored.collect()}
    assert got[1] == (True, True, False) and got[2] == (True, False, False) and got[3] == (False, False, False)
    assert got[4] == (True, False, True) and got[5] == (True, True, False) and got[7] == (False, False, False)
    scores = evaluate.groups(scored)
    by = {r["grp"]: r.asDict() for r in scores.collect()}
    assert by["valid"] == {"grp": "valid", "parse": 4, "fidelity": 2, "repaired": 1, "n": 5, "skipped": 0}
    assert by["holdout"]["skipped"] == 1 and by["holdout"]["n"] == 1
    assert evaluate.gate(scores, "smoke")["passed"] is False and evaluate.gate(scores, "no such")["passed"] is None
    document = report.payload(spark.createDataFrame(rows, "grp string, rec_id long, gold string, candidate string"), stage="smoke")
    assert report.exit_code(document) == 1 and "FAIL" in report.summary(document)
    assert "| valid | 80% | 40% | 5 |" in report.model_card(document, "Qwen/x", {"final_loss": 0.12345})


def test_hygiene_report(spark, sf_dir):
    found = hygiene.report(splits(spark, sf_dir).withColumn("source", F.lit('{"x":"nowhere"}')), ("es",))
    assert {r["check"] for r in found.collect()} >= {"stratified", "containment"} and not hygiene.passed(found)


def test_corpus(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i else "c", f"t{i % 3}") for i in range(9)], "rec_id long, shape string, text string")
    assert [r["shape"] for r in corpus.stratify(rows, 5).collect()] == ["a", "b", "c", "a", "b"]
    assert sorted(r["rec_id"] for r in corpus.dedupe_text(rows).collect()) == [0, 1, 2]
    assert corpus.capped(rows, 0).count() == 9 and corpus.capped(rows, 2).count() == 2
    assert corpus.sample(rows, 100).count() == 9
    assert corpus.budget(4, 16, 1, 100, 50) == {"micro_batch": 4, "grad_accum": 4, "max_steps": 25, "examples_seen": 400, "epochs": 8.0}
    assert corpus.valid_share(30, 7) == 4


def test_mutators(spark):
    rows = mutate.random_records(spark, 30)
    wrapped = udfs.decoded(mutate.wraps(rows), "raw").withColumn("want", udfs.canon_loose("value"))
    assert wrapped.where("not decoded.ok or decoded.value <> want").count() == 0
    assert mutate.damage(rows).count() == 210 and udfs.decoded(mutate.damage(rows), "raw").where("decoded is null").count() == 0
    assert udfs.decoded(rows, "raw", schema="schema").where("not decoded.ok").count() == 0
    made = mutate.template_examples(spark, 20, ["x", "y"])
    assert made.count() == 40 and udfs.decoded(made, "raw").where("decoded.ok").count() == 40


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"rec_id": i, "ts": f"2024-01-01T00:00:{i:02d}", "raw": "a=1" if i % 2 else "bad"}) for i in range(10)))
    records.write_stream(records.decode_stream(records.read_stream(spark, str(source))), str(out), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(out)).where("decoded.ok").count() == 5
    q = records.quality_by_window(records.read_stream(spark, str(source))).writeStream.format("memory").queryName("q").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n), sum(ok) from q").first()[:] == (10, 5)


def test_stage(spark):
    shapes = ("held",)
    rows = [(0, "train", "s", '1', "1"), (1, "valid", "s", "2", "2"), (2, "holdout", "held", "3", "3")]
    good = spark.createDataFrame(rows, "rec_id long, split string, shape string, prompt string, source string")
    pairs = spark.createDataFrame([("valid", "a=1", "a=1")], "grp string, gold string, candidate string")
    assert stages.stage(spark, good, pairs, "smoke", shapes)["evaluation"]["gate"]["passed"]
    with pytest.raises(stages.LegFailed, match="data"):
        stages.stage(spark, good.withColumn("shape", F.lit("held")), pairs, "smoke", shapes)
    cases = spark.createDataFrame([("a=1", True), ("=x", False), ("a=[", True)], "input string, accept boolean")
    assert [r["input"] for r in stages.lint(cases).collect()] == ["a=["]
