"""Queries of files, repairs, reports, generators and the rest, with the same in SQL."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwire.functions import native, udfs
from leafwire.operators import corpus, evaluate, hygiene, mutate, report
from leafwire.plans import stages
from leafwire.plans.queries import SCORES_SQL, lines, pairs, query, records, score_pairs, splits, table, value
from leafwire.sources import jsonl


def told(spark: SparkSession, said: list[str]) -> DataFrame:
    """Lines of the driver as rows. From Arrow, since a list of tuples goes through a new Python worker in every core."""
    return spark.createDataFrame(pa.table({"line": pa.array(said, pa.string())}))


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines share: below spark.checkpoint.dir or, where all of Spark is one process, a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="leafwire-")
    return f"{named.rstrip('/')}/files-{uuid.uuid4().hex}"


def example_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Documents as chat examples in JSON lines, a blank line after every third, one folder for each split."""
    d = F.col("rec_id")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("id="), d.cast("string")).alias("content")))
    source = F.when(d % 2 == 0, F.lit('{"label":1}')).otherwise(F.lit('{"label":true}'))
    text = F.concat(F.lit('{"messages":'), F.to_json(messages), F.lit(',"meta":{"shape":"'), "shape", F.lit('","task":"translate","variation_seed":'), d.cast("string"), F.lit(',"source":'), source, F.lit("}}"))
    rows = splits(spark, sf_dir).select("split", F.explode(F.when(d % 3 == 0, F.array(text, F.lit("  "))).otherwise(F.array(text))).alias("value"))
    folder = scratch(spark)
    rows.write.partitionBy("split").text(folder)
    return {name: f"{folder}/split={name}" for name in jsonl.SPLITS}


SPLITS_SQL = "(select doc_id, lang, source, case when lang = 'es' and doc_id % 50 <> 0 then 'holdout' when doc_id % 10 = 0 then 'valid' else 'train' end as split from documents)"


@query(f"""select split, lang as shape, count(*) as n, sum(doc_id)::bigint as seeds, count(*) filter (where doc_id % 2 = 0) as ones, count(*) filter (where doc_id % 2 <> 0) as trues, count(distinct source) as prompts from {SPLITS_SQL} group by 1, 2""")
def read_examples(spark, sf_dir):
    """JSON lines with blank lines, mixed types in ``source`` and one file that is not there."""
    paths = example_files(spark, sf_dir)
    rows = jsonl.read_splits(spark, {**paths, "none": scratch(spark)})
    label = F.to_json(F.col("meta.source"))
    return rows.groupBy("split", corpus.shape_of().alias("shape")).agg(
        F.count("*").alias("n"), F.sum("meta.variation_seed").alias("seeds"), F.count_if(label == '{"label":1}').alias("ones"), F.count_if(label == '{"label":true}').alias("trues"), F.count_distinct(F.col("messages")[0]["content"]).alias("prompts")
    )


@query(f"""select split, case split when 'valid' then 0 when 'holdout' then 1 else 2 end as place, count(*) as n, sum(doc_id)::bigint as ids from {SPLITS_SQL} group by 1, 2""")
def read_replies(spark, sf_dir):
    rows = jsonl.read_replies(spark, example_files(spark, sf_dir))
    rows = udfs.decoded(rows, "content").withColumn("id", value("id bigint")["id"])
    return rows.groupBy("split", "place").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""select count(*) filter (where split = 'train') as train, count(*) filter (where split = 'valid') as valid, true as absent_fails, count(*) filter (where split = 'holdout') as messages from {SPLITS_SQL}""")
def validate_files(spark, sf_dir):
    paths = example_files(spark, sf_dir)
    found = jsonl.validate(spark, paths["train"], paths["valid"])
    fails = []
    for read in (lambda: jsonl.validate(spark, paths["train"], scratch(spark)), lambda: jsonl.read_messages(spark, scratch(spark))):
        try:
            read()
            fails.append(False)
        except jsonl.NoData:
            fails.append(True)
    n = jsonl.read_messages(spark, paths["holdout"]).select("messages").count()
    return spark.createDataFrame([(found["train"], found["valid"], all(fails), n)], "train long, valid long, absent_fails boolean, messages long")


@query("""select count(*) as n, 'Zür' as name, true as absent, max(event_id) as steps, max_by(value, event_id) filter (where event_type <> 'click') as final_loss from events""")
def result_documents(spark, sf_dir):
    """A result and a run record as JSON documents, written and read again."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.when(F.col("event_type") != "click", F.col("value")).alias("loss"))
    path = scratch(spark)
    jsonl.write_document(spark, f"{path}/deep/result.json", report.run_record(log, name="Zür", n=log.count()))
    read = jsonl.read_document(spark, f"{path}/deep/result.json")
    return read.select("n", "name", F.lit(jsonl.read_document(spark, f"{path}/none.json") is None).alias("absent"), "steps", "final_loss")


@query("""select '{"a":1,"b":{"c":"x y"}}' as value, true as ok""")
def one_record(spark, sf_dir):
    return udfs.decoded(jsonl.one_record(spark, "a=1\nb.c=x y"), "raw").select("decoded.value", "decoded.ok")


@query("""select c_mktsegment as seg, count(*) as n, sum(c_custkey)::bigint as keys, sum(c_nationkey)::bigint as nations, count(*) as flattened, count(*) filter (where c_custkey % 4 = 0) as left_open from customer group by 1""")
def flatten_braces(spark, sf_dir):
    """Nested blocks in braces; every fourth record has one that is never closed and stays a leaf."""
    k = F.col("c_custkey").cast("string")
    raw = F.concat(F.lit("c={\n  key="), k, F.lit("\n  seg="), "c_mktsegment", F.lit("\n  nation={\n    id="), F.col("c_nationkey").cast("string"), F.lit("\n  }\n}"), F.when(F.col("c_custkey") % 4 == 0, "\nopen={\nz=1").otherwise(""))
    rows = udfs.decoded(records(spark, sf_dir, "customer").select(raw.alias("raw")), "raw").withColumn("v", value("c struct<key:bigint,seg:string,nation:struct<id:bigint>>, open string"))
    return rows.groupBy(F.col("v.c.seg").alias("seg")).agg(
        F.count("*").alias("n"), F.sum("v.c.key").alias("keys"), F.sum("v.c.nation.id").alias("nations"), F.count_if(F.array_contains(udfs.repair_kinds(F.col("decoded")), "multiline_braces_flattened")).alias("flattened"), F.count_if(F.col("v.open") == "{").alias("left_open")
    )


BLOCKS = {
    "same": ("<<<7f2a", ">>>7f2a", ""),
    "other_nonce": ("<<<7f2a", ">>>0123", "mismatched_nonce_recovered"),
    "fewer": ("<<", ">>", "delimiter_count_repaired"),
    "short_closer": ("<<<7f2a", ">>7f2a", "delimiter_count_repaired"),
    "open": ("<<<7f2a", None, "unterminated_block_closed_at_eof"),
}
BLOCKS_SQL = ", ".join(f"('{k}', '{v[2]}')" for k, v in BLOCKS.items())


@query(f"""select v.variant, v.kinds, count(*) as n, count(*) as n_same, count(*) filter (where v.variant = 'open') as truncated from customer, (values {BLOCKS_SQL}) as v(variant, kinds) group by 1, 2""")
def repair_blocks(spark, sf_dir):
    """Blocks whose closing line has another nonce, fewer signs, or is not there."""
    body = F.concat(F.lit("words about "), "c_name", F.lit("\nand no more words"))
    raws = [F.struct(F.lit(name).alias("variant"), F.concat(F.lit(f"note={a}\n"), body, F.lit(f"\n{b}" if b else "")).alias("raw")) for name, (a, b, _) in BLOCKS.items()]
    rows = records(spark, sf_dir, "customer").select(body.alias("body"), F.explode(F.array(*raws)).alias("x")).select("body", "x.*")
    rows = udfs.decoded(rows, "raw", lenient=True).withColumn("note", value("note string")["note"])
    kinds = F.array_join(udfs.repair_kinds(F.col("decoded")), ",")
    return rows.groupBy("variant", kinds.alias("kinds")).agg(F.count("*").alias("n"), F.count_if(F.col("note") == F.col("body")).alias("n_same"), F.count_if("decoded.truncated").alias("truncated"))


@query("""select v.variant, count(*) as n, v.ok, v.error, v.detail from supplier, (values ('astral', true, '', 'k😀,k￼'), ('key', false, 'a>>>', ''), ('deeper', false, 'a>>>', '')) as v(variant, ok, error, detail) group by 1, 3, 4, 5""")
def repeated_key_order(spark, sf_dir):
    """The detail of a repair lists keys by UTF-16 units; the first bad key in code-point order is named."""
    raws = {"astral": "k\ufffc=1\nk\ufffc=2\nk\U0001f600=1\nk\U0001f600=2", "key": "t::z>>>,a>>>\nt[0]=1,2", "deeper": "t::z,a>>>\nt[0]=1,2"}
    rows = records(spark, sf_dir, "supplier").select(F.explode(F.create_map(*[F.lit(x) for kv in raws.items() for x in kv])).alias("variant", "raw"))
    rows = udfs.decoded(rows, "raw")
    named = F.coalesce(F.regexp_extract("decoded.error", "([az]>>>)", 1), F.lit(""))
    detail = F.coalesce(F.get("decoded.repairs", F.lit(0))["detail"], F.lit(""))
    return rows.groupBy("variant", F.col("decoded.ok").alias("ok"), named.alias("error"), detail.alias("detail")).agg(F.count("*").alias("n"))


@query("""select count(*) as n, count(*) filter (where p_partkey % 2 = 0) as n_ok, sum(case when p_partkey % 2 = 0 then p_partkey end)::bigint as keys, count(*) filter (where p_partkey % 6 = 0) as n_repaired, count(*) filter (where p_partkey % 2 <> 0) as n_errors from part""")
def batch_results(spark, sf_dir):
    """Results of a batch: the number of repairs, and no value or error where there is none."""
    k = F.col("p_partkey")
    raw = F.when(k % 2 != 0, "nothing").when(k % 3 == 0, F.concat(F.lit("```\nk="), k.cast("string"), F.lit("\n```"))).otherwise(lines(k="p_partkey"))
    rows = udfs.decoded(records(spark, sf_dir, "part").select(raw.alias("raw")), "raw").select(udfs.batch_result(F.col("decoded")).alias("r"))
    return rows.agg(F.count("*").alias("n"), F.count_if("r.ok").alias("n_ok"), F.sum(F.from_json("r.value", "k bigint")["k"]).alias("keys"), F.sum("r.repairs").cast("long").alias("n_repaired"), F.count("r.error").alias("n_errors"))


@query("""select conv_id, turn, case when conv_id % 2 = 0 then md5(text) else md5('<think>a</think>' || text) end as digest, md5('Details: ' || role || chr(10) || chr(10) || 'id:n') as prompt from conversations""")
def model_replies(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<think>a</think>"), "text").alias("reply"), F.concat(F.lit("Details: "), "role").alias("details"))
    return rows.select("conv_id", "turn", F.md5(native.variant_for_model("reply", F.col("conv_id") % 2 == 0)).alias("digest"), F.md5(native.prompt("details", F.lit("id:n"))).alias("prompt"))


@query("""select event_id, case when event_id % 5 = 0 then '—' else format('{:.4g}', value) end as loss from events""")
def loss_digits(spark, sf_dir):
    return records(spark, sf_dir, "events").select("event_id", udfs.four_digits(F.when(F.col("event_id") % 5 != 0, F.col("value"))).alias("loss"))


@query("""select lang, sum(least(length(text), 120))::bigint as mismatch, sum(least(length(text), 160))::bigint as error, sum(least(length(text), 200))::bigint as gold, sum(least(length(text), 240))::bigint as prompt, sum(least(length(text), 400))::bigint as output from documents group by 1""")
def shown_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*[F.sum(F.length(native.shortened("text", r))).cast("long").alias(r) for r in native.SHOWN])


@query("""select o_orderkey as rec_id, case when o_orderkey % 10 = 0 then 'nothing to say' else 'id=' || o_orderkey || chr(10) || 'status=?' end as output, o_orderkey % 10 = 0 as failed from orders where o_orderkey % 10 = 0 or o_orderkey % 7 = 0""")
def failed_replies(spark, sf_dir):
    """What is kept of a reply: its start, only where it is wrong, and the first line of an error."""
    rows = evaluate.scored(pairs(spark, sf_dir)).where("output is not null")
    return rows.select("rec_id", "output", (F.col("error").isNotNull() & ~F.col("error").contains("\n")).alias("failed"))


@query(f"""select grp || ': parse ' || parse || '/' || n || ' (' || cast(round_even(100.0 * parse / n, 0) as int) || '%), fidelity ' || fidelity || '/' || n || ' (' || cast(round_even(100.0 * fidelity / n, 0) as int) || '%), repaired ' || repaired || ', skipped ' || skipped as line from ({SCORES_SQL})
union all select 'gate smoke: ' || case when fidelity >= 0.5 * n then 'PASS' else 'FAIL' end from ({SCORES_SQL}) where grp = 'valid' union all select '  valid_fidelity ' || cast(round(fidelity / n, 4) as varchar) || ' (at least 0.5): ' || case when fidelity >= 0.5 * n then 'ok' else 'failed' end from ({SCORES_SQL}) where grp = 'valid'""")
def summary_lines(spark, sf_dir):
    text = report.summary(report.payload(pairs(spark, sf_dir), stage="smoke"))
    return told(spark, text.split("\n"))


@query(f"""with s as ({SCORES_SQL}), v as (select * from s where grp = 'valid'), h as (select * from s where grp = 'holdout')
select t.stage, t.passed, case when t.passed = false then 1 else 0 end as code from (select 'smoke' as stage, v.fidelity >= 0.5 * v.n as passed from v union all select 'warm', v.fidelity >= 0.75 * v.n and h.fidelity >= 0.2301 * h.n from v, h
union all select 'mid', v.parse >= 0.95 * v.n from v union all select 'full', v.parse >= 0.98 * v.n and v.fidelity >= 0.95 * v.n and h.parse >= 0.98 * h.n and h.fidelity >= 0.95 * h.n from v, h union all select 'other', null) as t""")
def exit_codes(spark, sf_dir):
    scores = score_pairs(spark, sf_dir).cache()
    try:
        gates = [evaluate.gate(scores, s) for s in ("smoke", "warm", "mid", "full", "other")]
    finally:
        scores.unpersist()
    return spark.createDataFrame([(g["stage"], g["passed"], report.exit_code({"gate": g})) for g in gates], "stage string, passed boolean, code int")


@query("""select b.batch, b.micro, greatest(1, b.acc * (b.batch // b.micro)) as grad_accum, greatest(1, 7000 // greatest(1, b.acc * (b.batch // b.micro))) as max_steps,
greatest(1, 7000 // greatest(1, b.acc * (b.batch // b.micro))) * b.micro * greatest(1, b.acc * (b.batch // b.micro)) as examples_seen, count(*) as rows from orders, (values (16, 4, 1), (16, 16, 1), (4, 2, 8), (2, 4, 1)) as b(batch, micro, acc) group by 1, 2, b.acc""")
def training_budgets(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    rows = [(batch, micro, corpus.budget(micro, batch, acc, 7000, n)) for batch, micro, acc in ((16, 4, 1), (16, 16, 1), (4, 2, 8), (2, 4, 1))]
    return spark.createDataFrame([(a, m, x["grad_accum"], x["max_steps"], x["examples_seen"], round(x["examples_seen"] / x["epochs"])) for a, m, x in rows], "batch int, micro int, grad_accum int, max_steps int, examples_seen int, rows long")


@query(f"""select '| ' || grp || ' | ' || cast(round_even(100.0 * parse / n, 0) as int) || '% | ' || cast(round_even(100.0 * fidelity / n, 0) as int) || '% | ' || n || ' |' as line from ({SCORES_SQL})
union all select unnest(['license: apache-2.0', 'base_model: Org/Qwen-1', 'Final loss: 0.1235', '* rate: 0.1', '* rows: 7', 'Apache License 2.0 (https://www.apache.org/licenses/LICENSE-2.0). Built with Qwen.'])""")
def model_card_lines(spark, sf_dir):
    run = {"final_loss": 0.12345, "hyperparameters": {"rate": 0.1}, "data": {"rows": 7}}
    card = report.model_card(report.payload(pairs(spark, sf_dir)), "Org/Qwen-1", run)
    some = [x for x in card.split("\n") if x.startswith(("| valid", "| holdout", "license:", "base_model", "Final", "* ", "Apache"))]
    return told(spark, some)


@query("""select p_partkey, case p_partkey % 2 when 0 then 'qwen' else 'llama' end as family, case p_partkey % 2 when 0 then 'Built with Qwen' else 'Built with Llama' end as attribution, case p_partkey % 2 when 0 then 'Apache License 2.0' else 'Llama 3.2 Community License' end as name from part""")
def license_lines(spark, sf_dir):
    d = native.license_details(F.when(F.col("p_partkey") % 2 == 0, "Org/QWEN-3").otherwise("Org/Other"))
    return table(spark, sf_dir, "part").select("p_partkey", d["family"].alias("family"), d["attribution"].alias("attribution"), d["name"].alias("name"))


@query("""select unnest(['deep_array_literal', 'flat_inline_object', 'large_table', 'multiline_body', 'pathological_keys']) as shape""")
def holdout_shapes(spark, sf_dir):
    return hygiene.holdout_table(spark)


@query(f"""select 'meter' as leg, 'true' as result union all select 'data', 'true' union all select 'evaluation', case when fidelity >= 0.5 * n then 'PASS' else 'FAIL' end from ({SCORES_SQL}) where grp = 'valid' union all select 'bad data', 'data'""")
def stage_legs(spark, sf_dir):
    """A stage whose legs pass, and one that stops at its data."""
    good = spark.createDataFrame([(0, "train", "s", "1", "1"), (1, "valid", "s", "2", "2"), (2, "holdout", "held", "3", "3")], "rec_id long, split string, shape string, prompt string, source string")
    done = stages.stage(spark, good, pairs(spark, sf_dir), "smoke", ("held",))
    rows = [(leg, str(done[leg]).lower()) for leg in ("meter", "data")] + [("evaluation", "PASS" if done["evaluation"]["gate"]["passed"] else "FAIL")]
    try:
        stages.stage(spark, good.withColumn("shape", F.lit("held")), pairs(spark, sf_dir), "smoke", ("held",))
    except stages.LegFailed as stopped:
        rows.append(("bad data", str(stopped)))
    return spark.createDataFrame(rows, "leg string, result string")


@query("""select s_suppkey % 3 as k, count(*) as n from supplier where s_suppkey % 3 <> 1 group by 1""")
def grammar_lint(spark, sf_dir):
    """Cases that the grammar judges otherwise than expected; a grammar without a root is refused."""
    k = F.col("s_suppkey") % 3
    rows = table(spark, sf_dir, "supplier").select(k.alias("k"), F.when(k == 0, F.concat(F.lit("a=[\n"), "s_name")).otherwise(lines(a="s_name")).alias("input"), (k != 2).alias("accept"))
    return stages.lint(rows).groupBy("k").agg(F.count("*").alias("n"))


@query("""select v.kind, 200::bigint as n, 200::bigint as n_ok, 200::bigint as n_same from (values ('plain'), ('typed')) as v(kind)""")
def random_values(spark, sf_dir):
    """Random objects as records, by themselves and by a schema of every type."""
    out = []
    for kind, rows, schema in (("plain", mutate.random_records(spark, 200), None), ("typed", mutate.typed_records(spark, 200), "schema")):
        read = udfs.decoded(rows, "raw", schema=schema).withColumn("want", udfs.canon_loose("value"))
        out.append(read.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_if("decoded.ok").alias("n_ok"), F.count_if(F.col("decoded.value") == F.col("want")).alias("n_same")))
    return out[0].unionByName(out[1])


@query("""select v.change, count(*) as n, count(*) filter (where v.ok) as n_ok from part, (values ('as_derived', true), ('flip', false), ('drop', false), ('optional', true), ('require', false), ('open', true)) as v(change, ok) group by 1""")
def perturbed_schemas(spark, sf_dir):
    """A schema derived from a value, and five changes of it, against records of that value's form."""
    derived = mutate.schema_of({"name": "x", "size": 1, "more": {"big": True, "tags": ["a"]}})
    named = {"as_derived": derived, **mutate.perturbed_schemas(derived)}
    raw = F.concat(F.lit("name="), "p_name", F.lit("\nsize="), F.col("p_size").cast("string"), F.lit("\nmore.big=true\nmore.tags[0]="), "p_brand")
    rows = records(spark, sf_dir, "part").select(raw.alias("raw"), F.explode(F.create_map(*[F.lit(x) for kv in named.items() for x in kv])).alias("change", "schema"))
    return udfs.decoded(rows, "raw", schema="schema").groupBy("change").agg(F.count("*").alias("n"), F.count_if("decoded.ok").alias("n_ok"))


@query("""select v.kind, 300::bigint as n, 300::bigint as n_judged from (values ('chars'), ('tokens')) as v(kind)""")
def soup(spark, sf_dir):
    """Random characters and tokens: every text has a result, strict and lenient, or an error."""
    import random

    r = random.Random(7)
    rows = spark.createDataFrame([(kind, mutate.soup(r, r.randrange(1, 60), kind == "tokens")) for kind in ("chars", "tokens") for _ in range(300)], "kind string, raw string")
    rows = udfs.decoded(udfs.decoded(rows, "raw"), "raw", "kept", lenient=True)
    judged = (F.col("decoded.ok") | F.col("decoded.error").isNotNull()) & F.try_parse_json("kept.value").isNotNull()
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(judged).alias("n_judged"))


@query("""select shape, case when shape = 'held' then 'holdout' else 'other' end as split, 30::bigint as n, 30::bigint as n_ok, 30::bigint as n_same from (values ('x'), ('y'), ('held')) as t(shape)""")
def template_corpus(spark, sf_dir):
    """A generated corpus: a preset's size, a holdout shape, prompts that hold each record's value."""
    rows = mutate.template_examples(spark, "smoke", ["x", "y", "held"], holdout=("held",))
    rows = udfs.decoded(rows, "raw")
    want = udfs.canon(F.regexp_replace("prompt", "^Translate: ", ""))
    split = F.when(F.col("split") == "holdout", "holdout").otherwise("other")
    return rows.groupBy("shape", split.alias("split")).agg(F.count("*").alias("n"), F.count_if("decoded.ok").alias("n_ok"), F.count_if(F.col("decoded.value") == want).alias("n_same"))


@query("""select count(*) as n, count(*) as n_same, count(*) as n_shorter, count(*) as n_read from customer""")
def shuffled_and_cut(spark, sf_dir):
    """Lines in another order keep the value; a cut at any character has a lenient result."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rec_id"), lines(a="c_custkey", b="c_name", c="c_mktsegment").alias("raw"))
    same = udfs.decoded(udfs.decoded(mutate.shuffled(rows.withColumn("whole", F.col("raw"))), "raw"), "whole", "want")
    cut = udfs.decoded(mutate.random_cuts(rows.withColumn("whole", F.col("raw"))), "raw", lenient=True)
    both = same.select(F.lit(1).alias("n"), (F.col("decoded.value") == F.col("want.value")).cast("int").alias("n_same"), F.lit(0).alias("n_shorter"), F.lit(0).alias("n_read"))
    both = both.unionByName(cut.select(F.lit(0).alias("n"), F.lit(0).alias("n_same"), (F.length("raw") < F.length("whole")).cast("int").alias("n_shorter"), F.col("decoded.value").isNotNull().cast("int").alias("n_read")))
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


@query("""select case when doc_id % 10 = 0 then 'valid' else 'train' end as split, count(*) as n, count(*) filter (where doc_id >= 0) as kept from documents where lang <> 'es' group by 1 union all select 'holdout', count(*), count(*) from documents where lang = 'es'""")
def merge_real(spark, sf_dir):
    """Real rows join train and valid; a real holdout would be left out."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(d.alias("rec_id"), F.when(F.col("lang") == "es", "holdout").when(d % 10 == 0, "valid").otherwise("train").alias("split"))
    synthetic, real = docs.where((F.col("rec_id") % 2 == 0) | (F.col("split") == "holdout")), docs.where("rec_id % 2 <> 0")
    return corpus.merge_real(synthetic, real).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("rec_id") >= 0).alias("kept"))
