"""One query for each operator over the star schema's tables, and the same in SQL.

Records are made from columns with string functions, decoded, and aggregated; the SQL
computes the aggregates from the columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwire.functions import native, udfs
from leafwire.operators import corpus, evaluate, hygiene, leaftable, mutate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The column by which a table's rows are dealt out, and how many bytes of a table make a task.
KEYS = {"customer": "c_custkey", "documents": "doc_id", "events": "event_id", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey"}
SHARE = 1 << 20


def records(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for decoding, dealt out to all cores, and to more tasks as it grows.

    A row group is never divided: in how many splits a file may be read says nothing of how many tasks have rows,
    and a decode costs far more than moving its text.
    """
    df = table(spark, sf_dir, name)
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-size // SHARE)), KEYS[name])


def lines(**leaves: Column | str) -> Column:
    """A record: a line for each leaf, its name with _ for the dot of a path."""
    return F.concat_ws("\n", *[F.concat(F.lit(k.replace("__", ".") + "="), (F.col(v) if isinstance(v, str) else v).cast("string")) for k, v in leaves.items()])


def value(schema: str, column: str = "decoded.value") -> Column:
    return F.from_json(column, schema)


def flag(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


@query("""select o_orderstatus, o_orderpriority, count(*) as n, sum(o_orderkey)::bigint as sum_key from orders group by 1, 2""")
def decode_bare_rollup(spark, sf_dir):
    raw = records(spark, sf_dir, "orders").select(lines(key="o_orderkey", status="o_orderstatus", priority="o_orderpriority").alias("raw"))
    rows = udfs.decoded(raw, "raw").select(value("key bigint, status string, priority string").alias("v"))
    return rows.groupBy(F.col("v.status").alias("o_orderstatus"), F.col("v.priority").alias("o_orderpriority")).agg(F.count("*").alias("n"), F.sum("v.key").alias("sum_key"))


@query("""select p_size > 25 as big, count(*) as n, sum(p_partkey)::bigint as sum_key, count(distinct p_brand) as brands from part group by 1""")
def decode_typed(spark, sf_dir):
    raw = F.concat_ws("\n", F.concat(F.lit("k:n="), F.col("p_partkey").cast("string")), F.concat(F.lit("s:s="), "p_brand"), F.concat(F.lit("b:b="), flag(F.col("p_size") > 25)))
    rows = udfs.decoded(records(spark, sf_dir, "part").select(raw.alias("raw")), "raw").select(value("k bigint, s string, b boolean").alias("v"))
    return rows.groupBy(F.col("v.b").alias("big")).agg(F.count("*").alias("n"), F.sum("v.k").alias("sum_key"), F.count_distinct("v.s").alias("brands"))


@query("""select c_mktsegment as seg, c_nationkey as nation, count(*) as n, sum(c_custkey)::bigint as sum_key from customer group by 1, 2""")
def decode_nested_path(spark, sf_dir):
    raw = records(spark, sf_dir, "customer").select(lines(cust__key="c_custkey", cust__seg="c_mktsegment", cust__nation__id="c_nationkey").alias("raw"))
    rows = udfs.decoded(raw, "raw").select(value("cust struct<key:bigint,seg:string,nation:struct<id:int>>").alias("v"))
    return rows.groupBy(F.col("v.cust.seg").alias("seg"), F.col("v.cust.nation.id").alias("nation")).agg(F.count("*").alias("n"), F.sum("v.cust.key").alias("sum_key"))


def numbered(arrays: Column, name: str) -> Column:
    return F.array_join(F.transform(arrays, lambda x, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]="), x)), "\n")


@query("""select l_orderkey, count(*) as n, sum(l_partkey)::bigint as sum_part from lineitem group by 1""")
def decode_indexed_array(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("xs"))
    rows = udfs.decoded(orders.select("l_orderkey", numbered(F.col("xs"), "xs").alias("raw")), "raw").select("l_orderkey", value("xs array<bigint>")["xs"].alias("xs"))
    return rows.select("l_orderkey", F.size("xs").cast("long").alias("n"), F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_part"))


@query("""select l_linenumber as line, count(*) as n, sum(l_partkey)::bigint as sum_part from lineitem group by 1""")
def decode_table(spark, sf_dir):
    cells = F.concat_ws(",", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(cells).alias("rows"))
    raw = F.concat(F.lit("items::line,part\n"), numbered(F.col("rows"), "items"))
    items = udfs.decoded(orders.select(raw.alias("raw")), "raw").select(F.explode(value("items array<struct<line:int,part:bigint>>")["items"]).alias("x"))
    return items.groupBy(F.col("x.line").alias("line")).agg(F.count("*").alias("n"), F.sum("x.part").alias("sum_part"))


@query("""select o_custkey, count(*) as n, sum(o_orderkey)::bigint as sum_key from orders group by 1""")
def decode_array_rows(spark, sf_dir):
    customers = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ks"))
    raw = F.concat(F.lit("ks=[\n"), F.array_join("ks", "\n"), F.lit("\n]"))
    rows = udfs.decoded(customers.select("o_custkey", raw.alias("raw")), "raw").select("o_custkey", value("ks array<bigint>")["ks"].alias("ks"))
    return rows.select("o_custkey", F.size("ks").cast("long").alias("n"), F.aggregate("ks", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_key"))


@query("""select s_suppkey, s_name from supplier""")
def decode_inline_object(spark, sf_dir):
    raw = F.concat(F.lit("o={id="), F.col("s_suppkey").cast("string"), F.lit(",name="), F.col("s_name"), F.lit("}"))
    rows = udfs.decoded(records(spark, sf_dir, "supplier").select(raw.alias("raw")), "raw").select(value("o struct<id:bigint,name:string>")["o"].alias("o"))
    return rows.select(F.col("o.id").alias("s_suppkey"), F.col("o.name").alias("s_name"))


def block(text: Column | str, closer: str) -> Column:
    return F.concat(F.lit("body=<<<7f2a\n"), text, F.lit(closer))


@query("""select doc_id, n_chars, md5(text) as digest from documents""")
def decode_multiline(spark, sf_dir):
    docs = records(spark, sf_dir, "documents").select("doc_id", block("text", "\n>>>7f2a").alias("raw"))
    rows = udfs.decoded(docs, "raw").select("doc_id", value("body string")["body"].alias("body"))
    return rows.select("doc_id", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("digest"))


@query("""select v.variant, count(*) as n, count(*) as n_equal, (count(*) * v.per)::bigint as n_repairs
from customer, (values ('fence', 1), ('named_fence', 1), ('markers', 1), ('tokens', 1), ('opener', 2), ('crlf', 1), ('space', 0)) as v(variant, per) group by v.variant, v.per""")
def repair_wraps(spark, sf_dir):
    rows = records(spark, sf_dir, "customer").select("c_custkey", "c_name", lines(id="c_custkey", name="c_name").alias("raw"))
    rows = udfs.decoded(mutate.wraps(rows), "raw").withColumn("v", value("id bigint, name string"))
    same = (F.col("v.id") == F.col("c_custkey")) & (F.col("v.name") == F.col("c_name"))
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(same).alias("n_equal"), F.sum(F.size("decoded.repairs")).alias("n_repairs"))


@query("""select lang, count(*) as n, count(*) as n_truncated, sum(length(rtrim(text, ' ' || chr(9) || chr(10) || chr(13))))::bigint as chars from documents group by 1""")
def repair_truncated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", block("text", "").alias("raw"))
    rows = udfs.decoded(docs, "raw", lenient=True).withColumn("body", value("body string")["body"])
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("decoded.truncated").alias("n_truncated"), F.sum(F.length("body")).alias("chars"))


@query("""select user_id, count(*) as n from events group by 1 having count(*) > 1""")
def repair_repeated_keys(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.concat(F.lit("tag="), "event_type")).alias("tags")).where(F.size("tags") > 1)
    rows = udfs.decoded(users.select("user_id", F.array_join("tags", "\n").alias("raw")), "raw")
    return rows.select("user_id", F.size(value("tag array<string>")["tag"]).cast("long").alias("n"))


@query("""select concat(' ', c_mktsegment) as seg, count(*) as n, count(*) as n_repaired from customer group by 1""")
def repair_separator(spark, sf_dir):
    rows = udfs.decoded(records(spark, sf_dir, "customer").select(F.concat(F.lit("seg: "), "c_mktsegment").alias("raw")), "raw")
    return rows.groupBy(value("seg string")["seg"].alias("seg")).agg(F.count("*").alias("n"), F.count_if(F.array_contains(udfs.repair_kinds(F.col("decoded")), "separator_coerced")).alias("n_repaired"))


@query("""select o_orderkey % 7 as k, count(*) as n, count(*) filter (where o_orderkey % 7 > 2) as n_ok from orders group by 1""")
def reject_records(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    raw = F.when(k == 0, "a[0]=1\na[2]=3").when(k == 1, "a=1\na.b=2").when(k == 2, "t::<<<a>>>\nt[0]=1").otherwise(lines(a="o_orderkey"))
    rows = udfs.decoded(records(spark, sf_dir, "orders").select(k.alias("k"), raw.alias("raw")), "raw")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count_if("decoded.ok").alias("n_ok"))


SCHEMA = "id:n\nname:s\nbig:b\nnote:s?"


@query("""select count(*) as n, count(*) filter (where p_partkey % 5 <> 0 and p_partkey % 3 <> 0) as n_ok,
count(*) filter (where p_partkey % 5 = 0) as n_missing, count(*) filter (where p_partkey % 5 <> 0 and p_partkey % 3 = 0) as n_unknown,
(sum(p_partkey) filter (where p_partkey % 5 <> 0 and p_partkey % 3 <> 0))::bigint as sum_key from part""")
def schema_typed(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.concat_ws("\n", lines(id="p_partkey", big=flag(F.col("p_size") > 25)), F.when(k % 5 != 0, lines(name="p_name")), F.when((k % 5 != 0) & (k % 3 == 0), "extra=1"))
    rows = records(spark, sf_dir, "part").select(raw.alias("raw"), F.lit(SCHEMA).alias("schema"))
    rows = udfs.decoded(rows, "raw", schema="schema")
    error = F.col("decoded.error")
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if("decoded.ok").alias("n_ok"),
        F.count_if(error.contains("missing required")).alias("n_missing"),
        F.count_if(error.contains("unknown field")).alias("n_unknown"),
        F.sum(value("id bigint, name string, big boolean")["id"]).alias("sum_key"),
    )


@query("""select count(*) as n, count(*) filter (where o_orderkey % 5 = 0) as n_errors, sum(o_orderkey)::bigint as sum_key from orders""")
def lenient_errors(spark, sf_dir):
    raw = F.concat(lines(a="o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, "\nnothing here").otherwise(""))
    rows = udfs.decoded(records(spark, sf_dir, "orders").select(raw.alias("raw")), "raw", lenient=True)
    return rows.agg(F.count("*").alias("n"), F.sum(F.size("decoded.errors")).cast("long").alias("n_errors"), F.sum(value("a bigint")["a"]).alias("sum_key"))


@query("""select conv_id, turn, md5(ltrim(text, ' ' || chr(9) || chr(10) || chr(13))) as digest from conversations""")
def think_strip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(" <think>a\nb</think>\n"), "text").alias("reply"))
    return rows.select("conv_id", "turn", F.md5(native.strip_think("reply")).alias("digest"))


@query("""select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as sum_k from events group by 1""")
def extract_json_fenced(spark, sf_dir):
    rows = records(spark, sf_dir, "events").select("event_type", F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone.")).alias("reply"))
    found = rows.select("event_type", F.from_json(udfs.extract_json("reply"), "k bigint")["k"].alias("k"))
    return found.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("sum_k"))


@query("""select path, type, count(*) as n, count(distinct leaf) as leaves from (select unnest([{'path': 'key', 'type': 'number', 'leaf': cast(o_orderkey as varchar)}, {'path': 'tags[0]', 'type': 'string', 'leaf': '"' || o_orderstatus || '"'},
{'path': 'tags[1].late', 'type': 'boolean', 'leaf': case when o_orderkey % 2 = 0 then 'true' else 'false' end}, {'path': 'a.none', 'type': 'string', 'leaf': 'null'}]) as x from orders), lateral (select x.path as path, x.type as type, x.leaf as leaf) group by 1, 2""")
def flatten_leaves(spark, sf_dir):
    """Objects in arrays, nulls and empty containers: the last have no leaves."""
    text = F.concat(F.lit('{"key":'), F.col("o_orderkey").cast("string"), F.lit(',"tags":["'), "o_orderstatus", F.lit('",{"late":'), flag(F.col("o_orderkey") % 2 == 0), F.lit('}],"a":{"none":null,"empty":{},"list":[]}}'))
    rows = evaluate.leaf_table(records(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), text.alias("json")), "json")
    return rows.groupBy("path", "type").agg(F.count("*").alias("n"), F.count_distinct("leaf").alias("leaves"))


def order_json(*more: Column) -> Column:
    return F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), *more))


@query("""select count(*) as checked, count(*) filter (where o_orderkey % 5 = 0) as bad from orders""")
def leaf_containment(spark, sf_dir):
    prompt = F.concat(F.lit("order "), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderkey").cast("string")), F.lit(' has status "'), "o_orderstatus", F.lit('"'))
    rows = records(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), prompt.alias("prompt"), order_json().alias("source"))
    return hygiene.contained(rows)


@query("""select count(distinct (json_extract_string(props, '$.k'), event_type)) as n from events""")
def canon_dedupe(spark, sf_dir):
    k, kind = F.get_json_object("props", "$.k"), F.to_json(F.array("event_type"))
    one, two = F.concat(F.lit('{"k":'), k, F.lit(',"t":'), kind, F.lit("}")), F.concat(F.lit('{"t": '), kind, F.lit(', "k": '), k, F.lit("}"))
    rows = records(spark, sf_dir, "events").select(F.col("event_id").alias("rec_id"), F.when(F.col("event_id") % 2 == 0, one).otherwise(two).alias("value"))
    return corpus.dedupe_json(rows, "value").agg(F.count("*").alias("n"))


@query("""select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5('0/' || doc_id), doc_id) as rn from documents) order by rn, lang limit 13""")
def stratified_sample(spark, sf_dir):
    return corpus.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 13, 0, "lang", "doc_id")


@query("""select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as rn from documents) order by rn, lang limit 13""")
def stratify_no_shuffle(spark, sf_dir):
    return corpus.stratify(table(spark, sf_dir, "documents").select("doc_id", "lang"), 13, "lang", "doc_id")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus: their languages are shapes, Spanish is held out, but some of it leaks."""
    d = F.col("doc_id")
    split = F.when((F.col("lang") == "es") & (d % 50 != 0), "holdout").when(d % 10 == 0, "valid").otherwise("train")
    return table(spark, sf_dir, "documents").select(d.alias("rec_id"), split.alias("split"), F.col("lang").alias("shape"), F.col("source").alias("prompt"))


SPLITS_SQL = "(select doc_id, lang, case when lang = 'es' and doc_id % 50 <> 0 then 'holdout' when doc_id % 10 = 0 then 'valid' else 'train' end as split from documents)"


@query(f"select lang as shape, count(*) as n from {SPLITS_SQL} where split = 'valid' group by 1")
def split_counts(spark, sf_dir):
    return hygiene.shape_counts(splits(spark, sf_dir))


@query(f"""select 'stratified' as "check", 'FAIL' as level, 'valid' as subject, cast(max(n) - min(n) as varchar) as detail from (select count(*) as n from {SPLITS_SQL} where split = 'valid' group by lang) having max(n) - min(n) > 1
union all select distinct 'stratified', 'FAIL', lang, 'not in valid' from {SPLITS_SQL} where split = 'train' and lang not in (select lang from {SPLITS_SQL} where split = 'valid')""")
def split_balance(spark, sf_dir):
    return hygiene.balance(splits(spark, sf_dir))


@query(f"""select 'leak' as "check", 'FAIL' as level, split || '/' || lang as subject, cast(count(*) as varchar) as detail from {SPLITS_SQL} where lang = 'es' and split <> 'holdout' group by split, lang""")
def holdout_leak(spark, sf_dir):
    return hygiene.leaks(splits(spark, sf_dir), ("es",))


@query(f"""select 'holdout_purity' as "check", 'FAIL' as level, shape as subject, 'not a holdout shape' as detail from (select distinct source || '/' || lang as shape from documents where lang in ('es', 'fr')) where shape not in (select distinct source || '/es' from documents)
union all select 'holdout_purity', 'WARN', 'xx', 'no rows'""")
def holdout_purity(spark, sf_dir):
    """Shapes are sources by language; French ones stand in the holdout where only Spanish ones may."""
    shape = F.concat_ws("/", "source", "lang")
    docs = table(spark, sf_dir, "documents").where("lang in ('es', 'fr')").select(F.lit("holdout").alias("split"), shape.alias("shape"))
    allowed = [r["shape"] for r in docs.where(F.col("shape").endswith("/es")).distinct().collect()]  # a few sources
    return hygiene.purity(docs, (*allowed, "xx"))


@query("""select conv_id, turn, md5(text) as prompt, md5(reply) as reply from (select conv_id, turn, role, text, lead(role) over w as next, lead(text) over w as reply from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next = 'assistant'""")
def chat_pairs(spark, sf_dir):
    return corpus.chat_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5("prompt").alias("prompt"), F.md5("reply").alias("reply"))


@query("""select conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn)) as digest from conversations group by 1""")
def chat_render(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    return rows.select("conv_id", F.md5(native.chat_render("m", "chatml")).alias("digest"))


@query("""select kind, count(*) as n from (select 'documents' as kind, text from documents union all select 'benchmark', text from benchmark) group by 1""")
def union_splits(spark, sf_dir):
    docs, bench = (table(spark, sf_dir, t).select(F.lit(t).alias("kind"), "text") for t in ("documents", "benchmark"))
    return corpus.merge(docs, bench).groupBy("kind").agg(F.count("*").alias("n"))


@query("""select min(doc_id) as doc_id, md5(text) as digest from documents group by text""")
def dedupe_text(spark, sf_dir):
    return corpus.dedupe_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", F.md5("text").alias("digest"))


def pairs(spark: SparkSession, sf_dir: str, base: Column | None = None) -> DataFrame:
    """Orders as gold and reply: every 10th reply is prose, every 7th has another status, every 3rd of the rest is fenced, every 20th gold is unreadable."""
    k = F.col("o_orderkey")
    gold = lines(id="o_orderkey", status="o_orderstatus")
    reply = F.when(k % 10 == 0, "nothing to say").when(k % 7 == 0, lines(id="o_orderkey", status=F.lit("?"))).when(k % 3 == 0, F.concat(F.lit("```\n"), gold, F.lit("\n```"))).otherwise(gold)
    grp = F.when(k % 2 == 0, "valid").otherwise("holdout")
    return records(spark, sf_dir, "orders").select(k.alias("rec_id"), grp.alias("grp"), F.when(k % 20 == 0, "unreadable").otherwise(gold).alias("gold"), reply.alias("candidate"), (order_json() if base is None else base).alias("base"))


SCORES_SQL = """select case when o_orderkey % 2 = 0 then 'valid' else 'holdout' end as grp,
count(*) filter (where o_orderkey % 20 <> 0 and o_orderkey % 10 <> 0) as parse,
count(*) filter (where o_orderkey % 20 <> 0 and o_orderkey % 10 <> 0 and o_orderkey % 7 <> 0) as fidelity,
count(*) filter (where o_orderkey % 20 <> 0 and o_orderkey % 10 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 3 = 0) as repaired, count(*) filter (where o_orderkey % 20 <> 0) as n, count(*) filter (where o_orderkey % 20 = 0) as skipped from orders group by 1"""


@query(SCORES_SQL)
def score_pairs(spark, sf_dir):
    return evaluate.groups(evaluate.scored(pairs(spark, sf_dir)))


@query(f"""with s as ({SCORES_SQL}), m as (select grp || '_parse' as metric, parse / n as actual from s union all select grp || '_fidelity', fidelity / n from s)
select g.stage, g.metric, m.actual >= g.threshold as ok from (values ('smoke', 'valid_fidelity', 0.5), ('warm', 'valid_fidelity', 0.75), ('warm', 'holdout_fidelity', 0.2301), ('mid', 'valid_parse', 0.95),
('full', 'valid_parse', 0.98), ('full', 'valid_fidelity', 0.95), ('full', 'holdout_parse', 0.98), ('full', 'holdout_fidelity', 0.95)) as g(stage, metric, threshold) left join m on m.metric = g.metric""")
def gate_eval(spark, sf_dir):
    return evaluate.checks(score_pairs(spark, sf_dir)).select("stage", "metric", "ok")


@query("""with p as (select case when o_orderkey % 2 = 0 then 'valid' else 'holdout' end as grp, o_orderkey % 20 <> 0 as gold, o_orderkey % 10 <> 0 as parses, o_orderkey % 10 <> 0 and o_orderkey % 7 <> 0 as faithful,
case when o_orderkey % 10 = 0 then 'nothing to say' when o_orderkey % 7 = 0 then 'id=' || o_orderkey || chr(10) || 'status=?' when o_orderkey % 3 = 0 then '```' || chr(10) || 'id=' || o_orderkey || chr(10) || 'status=' || o_orderstatus || chr(10) || '```'
else 'id=' || o_orderkey || chr(10) || 'status=' || o_orderstatus end as record,
case when o_orderkey % 9 = 0 then 'no json' when o_orderkey % 5 = 0 then 'Sure: {"id": ' || o_orderkey || ', "status": "' || o_orderstatus || '"} there' else '{"status":"?","id":' || o_orderkey || '}' end as base,
o_orderkey % 9 <> 0 as base_parses, o_orderkey % 9 <> 0 and o_orderkey % 5 = 0 as base_right from orders)
select grp, count(*) as n, count(*) filter (where parses) as record_parse, count(*) filter (where gold and faithful) as record_fidelity, count(*) filter (where base_parses) as base_parse, count(*) filter (where gold and base_right) as base_fidelity,
sum(strlen(record))::bigint as record_bytes, sum(strlen(base))::bigint as base_bytes, round(avg(len(list_filter(string_split_regex(record, '\\s+'), lambda x: x <> ''))), 6) as record_words, round(avg(len(list_filter(string_split_regex(base, '\\s+'), lambda x: x <> ''))), 6) as base_words,
round(sum(strlen(record)) / sum(strlen(base)), 6) as ratio from p group by 1""")
def compare_candidates(spark, sf_dir):
    k = F.col("o_orderkey")
    base = F.when(k % 9 == 0, "no json").when(k % 5 == 0, F.concat(F.lit('Sure: {"id": '), k.cast("string"), F.lit(', "status": "'), "o_orderstatus", F.lit('"} there'))).otherwise(F.concat(F.lit('{"status":"?","id":'), k.cast("string"), F.lit("}")))
    found = evaluate.compare(pairs(spark, sf_dir, base))
    return found.withColumns({c: F.round(c, 6) for c in ("record_words", "base_words", "ratio")})


@query("""select rank, path, count(*) as n from (select case o_orderkey % 4 when 0 then 1 when 1 then 2 else 3 end as rank, case o_orderkey % 4 when 2 then 'key' else 'status' end as path from orders where o_orderkey % 4 <> 3) group by 1, 2""")
def tree_diff(spark, sf_dir):
    k = F.col("o_orderkey")
    key = F.col("o_orderkey").alias("key")
    got = F.when(k % 4 == 0, F.to_json(F.struct(key))).when(k % 4 == 1, F.to_json(F.struct(key, F.lit(5).alias("status")))).when(k % 4 == 2, F.to_json(F.struct((k + 1).alias("key"), F.col("o_orderstatus").alias("status")))).otherwise(order_json())
    rows = records(spark, sf_dir, "orders").select(k.alias("rec_id"), order_json().alias("want"), got.alias("got"))
    return evaluate.tree_diff(rows, "want", "got").groupBy("rank", "path").agg(F.count("*").alias("n"))


@query("""select case o_orderkey % 4 when 0 then 'status got dropped or misnested' when 1 then 'status: string became a number' when 2 then 'key changed value' else 'the shape doesn''t match' end as words, count(*) as n from orders group by 1""")
def describe_diff(spark, sf_dir):
    k = F.col("o_orderkey")
    key = F.col("o_orderkey").alias("key")
    got = F.when(k % 4 == 0, F.to_json(F.struct(key))).when(k % 4 == 1, F.to_json(F.struct(key, F.lit(5).alias("status")))).when(k % 4 == 2, F.to_json(F.struct((k + 1).alias("key"), F.col("o_orderstatus").alias("status")))).otherwise(order_json())
    rows = records(spark, sf_dir, "orders").select(udfs.describe_diff(order_json(), got).alias("words"))
    return rows.groupBy("words").agg(F.count("*").alias("n"))


@query("""select s_suppkey % 4 as k, count(*) as n, count(*) filter (where s_suppkey % 4 < 2) as accepted from supplier group by 1""")
def grammar_accept(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, lines(id="s_suppkey", name="s_name")).when(k == 1, F.concat(F.lit("xs=[\n"), "s_name", F.lit("\n]"))).when(k == 2, F.concat(F.lit("xs=[\n"), "s_name")).otherwise(F.concat(F.lit("="), "s_name"))
    rows = records(spark, sf_dir, "supplier").select(k.alias("k"), udfs.accepts(raw).alias("yes"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count_if("yes").alias("accepted"))


@query("""select name, count(*) as n, sum(strlen(raw))::bigint as bytes from (select 'id' as name, cast(o_orderkey as varchar) as raw from orders union all select 'status', o_orderstatus from orders) group by 1""")
def native_leaves(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), lines(id="o_orderkey", status="o_orderstatus").alias("raw"))
    return leaftable.simple_leaves(leaftable.explode_lines(rows)).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).alias("bytes"))


@query("""select name, kind, n, n as n_raw from (values ('id', 'bare'), ('name', 's'), ('items', 'header'), ('items[0]', 'row')) as v(name, kind), (select count(*) as n from supplier)""")
def leaf_rows(spark, sf_dir):
    raw = F.concat(F.lit("id=1\nname:s="), "s_name", F.lit("\nitems::a,b\nitems[0]=1,2"))
    rows = leaftable.explode_leaves(records(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rec_id"), raw.alias("raw")))
    return rows.groupBy("name", "kind").agg(F.count("*").alias("n"), F.count(F.coalesce("raw", F.get("cells", F.lit(0)))).alias("n_raw"))


def tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return records(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), F.row_number().over(w).alias("line"), F.col("event_type").alias("name"))


TAGS_SQL = "(select user_id, event_id, event_type, count(*) over (partition by user_id, event_type) as n, row_number() over (partition by user_id, event_type order by event_id) as i from events)"


@query(f"select case when n > 1 then event_type || '[' || (i - 1) || ']' else event_type end as name, count(*) as n from {TAGS_SQL} group by 1")
def index_repeats(spark, sf_dir):
    return leaftable.index_repeats(tag_lines(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"))


@query("""select user_id as rec_id, event_type as name, count(*) as n from events group by 1, 2 having count(*) > 1""")
def repeated_keys(spark, sf_dir):
    return leaftable.repeats(tag_lines(spark, sf_dir))


@query("""select o_orderkey % 2 = 0 as dense, count(*) as n from orders group by 1""")
def dense_arrays(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("rec_id"), F.explode(F.array(F.lit("a[0]"), F.when(k % 2 == 0, "a[1]").otherwise("a[3]"))).alias("name"))
    return leaftable.dense_arrays(rows).groupBy("dense").agg(F.count("*").alias("n"))


@query("""select count(*) as n, count(*) filter (where o_orderkey % 2 = 0) as n_seen from orders""")
def table_header_scope(spark, sf_dir):
    k = F.col("o_orderkey")
    early = k % 2 == 0
    header = F.struct(F.when(early, 1).otherwise(3).alias("line"), F.lit("t").alias("name"), F.lit("a,b").alias("header"))
    row = F.struct(F.lit(2).alias("line"), F.lit("t[0]").alias("name"), F.lit(None).cast("string").alias("header"))
    rows = table(spark, sf_dir, "orders").select(k.alias("rec_id"), F.explode(F.array(header, row)).alias("x")).select("rec_id", "x.*")
    seen = leaftable.visible_header(rows).where("name = 't[0]'")
    return seen.agg(F.count("*").alias("n"), F.count_if(F.col("columns").isNotNull()).alias("n_seen"))


@query("""select max_by(value, event_id) filter (where event_type <> 'click') as last_loss from events""")
def last_loss(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.when(F.col("event_type") != "click", F.col("value")).alias("loss"))
    return evaluate.last_loss(log)


@query("""select o_orderkey as rec_id from orders where (o_orderkey % 11 = 0 or o_orderkey % 13 = 0 or o_orderkey % 17 = 0) and not (o_orderkey % 13 = 0 and o_orderkey % 17 = 0)""")
def parity(spark, sf_dir):
    """Results that disagree, and rows that one side lacks."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("rec_id"), "o_orderkey", lines(a="o_orderkey").alias("x"), F.when(k % 11 == 0, "no record").otherwise(lines(a="o_orderkey")).alias("y"))
    left, right = (udfs.decoded(rows.where(k % without != 0), c).select("rec_id", "decoded.ok", "decoded.value") for c, without in (("x", 13), ("y", 17)))
    return evaluate.parity(left, right).select("rec_id")


@query("""select lang, sum(strlen('text=' || doc_id))::bigint as record, sum(strlen('{"text":' || doc_id || '}'))::bigint as json from documents group by 1""")
def byte_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", native.byte_delta(lines(text="doc_id"), udfs.minify(F.concat(F.lit('{ "text" : '), F.col("doc_id").cast("string"), F.lit(" }")))).alias("d"))
    return rows.groupBy("lang").agg(F.sum("d.record").alias("record"), F.sum("d.json").alias("json"))


@query("""select cut, count(*) as n, count(*) as n_ok from customer, (values (1), (2)) as v(cut) group by 1""")
def truncation_cuts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(lines(a="c_custkey", b="c_name", c="c_mktsegment").alias("raw"))
    cuts = udfs.decoded(mutate.truncations(rows), "raw")
    return cuts.groupBy("cut").agg(F.count("*").alias("n"), F.count_if("decoded.ok").alias("n_ok"))


@query("""select min(p_partkey) as rec_id, p_size from part where p_partkey % 3 <> 0 group by p_size""")
def ingest_lossless(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.lit("size=x")).otherwise(lines(size="p_size"))
    rows = records(spark, sf_dir, "part").select(k.alias("rec_id"), raw.alias("raw"), F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit("}")).alias("value"))
    return corpus.ingest(rows, "raw", "value").select("rec_id", F.from_json("value", "size int")["size"].alias("p_size"))


#: Spellings of numbers and the JSON that the format's rules give them; null: refused.
NUMBERS = {
    "-0": "0", "-0.0": "0", "9007199254740993": "9007199254740992", "123456789012345678": "123456789012345680", "1e16": "10000000000000000", "12345678901234567890123": "12345678901234567741440", "1e3": "1000", "2.50": "2.5", "1e999": None, "-1E400": None,
    "0.0001": "0.0001", "1e-7": "1e-07", "1.25e-5": "1.25e-05", "12345678.5": "12345678.5", "0.1": "0.1", "1e22": "10000000000000000000000", "007": '"007"', "+1": '"+1"', "1.": '"1."', "٣": '"٣"', "3e-12": "3e-12", "123456.789e3": "123456789",
}
NUMBERS_SQL = ", ".join("('{}', {})".format(k, "null" if v is None else f"'{v}'") for k, v in NUMBERS.items())


@query(f"""select p_partkey, cast(p_size as varchar) as size, '"' || p_name || '"' as name, cast(p_size > 25 as varchar) as big, x.value as number from part, (select row_number() over () - 1 as i, v, value from (values {NUMBERS_SQL}) as t(v, value)) as x where p_partkey % {len(NUMBERS)} = x.i""")
def infer_scalars(spark, sf_dir):
    number = F.element_at(F.array(*[F.lit(v) for v in NUMBERS]), (F.col("p_partkey") % len(NUMBERS) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), "p_name", flag(F.col("p_size") > 25).alias("big"), number.alias("number"))
    return rows.select("p_partkey", *[native.infer_scalar(c).alias(name) for c, name in (("size", "size"), ("p_name", "name"), ("big", "big"), ("number", "number"))])


@query("""select count(*) as n, count(*) as fenced, count(*) as crlf, count(*) as marked, count(*) as trimmed, (3 * count(*))::bigint as kept from customer""")
def native_surface(spark, sf_dir):
    raw = lines(id="c_custkey", name="c_name")
    rows = table(spark, sf_dir, "customer").select(raw.alias("raw"), *[mutate.WRAPS[w](raw).alias(w) for w in ("fence", "crlf", "markers")])
    space = "\ufeff\u2003\u00a0 \t\n"  # of the format's own set; NEL is not in it
    half = F.concat("raw", F.lit("\nlast\r\nend"))
    same = lambda f, c: F.when(f(c) == c, 1).otherwise(0)
    kept = same(native.strip_fence, F.concat(F.lit("a ```\n"), "raw", F.lit("\n```"))) + same(native.normalize_crlf, half) + same(native.trim_record, F.concat(F.lit("\x85"), "raw", F.lit("\x1c")))
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(native.strip_fence("fence") == F.col("raw")).alias("fenced"),
        F.count_if(native.normalize_crlf("crlf") == F.col("raw")).alias("crlf"),
        F.count_if(native.strip_markers("markers") == F.col("raw")).alias("marked"),
        F.count_if(native.trim_record(F.concat(F.lit(space), "raw", F.lit(space))) == F.col("raw")).alias("trimmed"),
        F.sum(kept).cast("long").alias("kept"),
    )


@query("""select v.variant, count(*) as n, count(*) filter (where v.ok) as n_ok, count(*) filter (where v.same) as n_same, coalesce(v.kinds, '') as kinds from customer,
(values ('coerce_separator', true, true, 'separator_coerced'), ('duplicate', true, false, 'repeated_keys_indexed'), ('shrink_delimiters', true, true, 'delimiter_count_repaired'), ('other_nonce', true, true, 'mismatched_nonce_recovered'),
('garbage', false, false, ''), ('reverse', false, false, ''), ('indent', true, false, 'unterminated_block_closed_at_eof')) as v(variant, ok, same, kinds) group by v.variant, v.kinds""")
def structural_damage(spark, sf_dir):
    """Records with a block: each variant's readability, value and repairs."""
    raw = F.concat(lines(id="c_custkey"), F.lit("\nnote=<<<7f2a\nsome words of "), "c_name", F.lit("\nand more\n>>>7f2a"))
    rows = records(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("some words of "), "c_name", F.lit("\nand more")).alias("note"), raw.alias("raw"))
    rows = udfs.decoded(mutate.damage(rows), "raw").withColumn("v", value("id string, note string"))
    same = (F.col("v.id") == F.col("c_custkey").cast("string")) & (F.col("v.note") == F.col("note"))
    kinds = F.array_join(F.array_sort(F.array_distinct(udfs.repair_kinds(F.col("decoded")))), ",")
    rows = rows.withColumns({"same": F.coalesce(F.col("decoded.ok") & same, F.lit(False)), "kinds": F.when(F.col("decoded.ok"), kinds).otherwise("")})
    return rows.groupBy("variant", "kinds").agg(F.count("*").alias("n"), F.count_if("decoded.ok").alias("n_ok"), F.count_if("same").alias("n_same"))


@query("""select count(*) as n, count(*) filter (where o_orderkey % 3 = 0) as n_sparse, count(*) as n_kept from orders""")
def lenient_sparse(spark, sf_dir):
    raw = F.concat(lines(id="o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, "\nxs[0]=1\nxs[2]=3").otherwise("\nxs[0]=1"))
    rows = udfs.decoded(records(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "raw", lenient=True)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.exists("decoded.errors", lambda e: e["key"] == "xs")).alias("n_sparse"), F.count_if(value("id bigint")["id"] == F.col("o_orderkey")).alias("n_kept"))


@query("""select count(*) as n, count(*) filter (where p_partkey % 2 = 0) as n_canon, count(*) filter (where p_partkey % 3 <> 0) as n_value from part""")
def two_equalities(spark, sf_dir):
    k = F.col("p_partkey")
    a = F.concat(F.lit('{"a":'), F.col("p_size").cast("string"), F.lit("}"))
    b = F.concat(F.lit('{ "a" : '), F.when(k % 3 == 0, (F.col("p_size") + 1).cast("string")).when(k % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0"))), F.lit("}"))
    same = F.concat(F.lit('{"a": '), F.col("p_size").cast("string"), F.when(k % 2 == 0, "").otherwise(".0"), F.lit("}"))
    return records(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.count_if(udfs.canon_equal(a, same)).alias("n_canon"), F.count_if(udfs.value_equal(a, b)).alias("n_value"))


@query("""select o_orderkey % 3 as k, count(*) as n, case o_orderkey % 3 when 0 then 'status' when 1 then 'id,status' else '' end as missing from orders group by 1, 3""")
def missing_required(spark, sf_dir):
    k = F.col("o_orderkey")
    names = F.when(k % 3 == 0, F.array(F.lit("id"))).when(k % 3 == 1, F.array(F.lit("other"))).otherwise(F.array(F.lit("id"), F.lit("status")))
    rows = table(spark, sf_dir, "orders").select(k.alias("rec_id"), F.explode(names).alias("name"))
    found = leaftable.missing_required(rows, ["id", "status"])
    return found.groupBy((F.col("rec_id") % 3).alias("k"), F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("n"))


@query("""select 'translate' as task, count(*) as n, count(*) filter (where role = 'user') as wrapped from conversations""")
def translate_prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.lit("translate").alias("task"), F.when(F.col("role") == "user", F.to_json(F.struct("role", "turn"))).otherwise(F.lit("plain words")).alias("t"))
    return rows.where("task = 'translate'").groupBy("task").agg(F.count("*").alias("n"), F.count_if(native.translate_prompt("t").startswith("Translate")).alias("wrapped"))


@query("""select case when doc_id % 4 = 0 then '?' else lang end as shape, count(*) as n from documents group by 1""")
def default_shape(spark, sf_dir):
    meta = F.struct(F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("shape"), F.lit(None).cast("string").alias("task"))
    return table(spark, sf_dir, "documents").select(meta.alias("meta")).groupBy(corpus.shape_of().alias("shape")).agg(F.count("*").alias("n"))


@query(f"""select grp, fidelity >= 0.8 * n as passed from ({SCORES_SQL})""")
def self_test(spark, sf_dir):
    return evaluate.self_test(score_pairs(spark, sf_dir))


@query("""select doc_id, lang from documents order by doc_id limit 20""")
def file_order_head(spark, sf_dir):
    return corpus.capped(table(spark, sf_dir, "documents").select("doc_id", "lang"), 20, "doc_id")


@query("""select p_partkey, case p_partkey % 3 when 0 then 'chatml' else 'llama' end as family, case p_partkey % 3 when 0 then 'apache-2.0' else 'llama3.2' end as license from part""")
def model_families(spark, sf_dir):
    model = F.when(F.col("p_partkey") % 3 == 0, "Org/Qwen-1").otherwise("Org/Llama-1")
    return table(spark, sf_dir, "part").select("p_partkey", native.template_family(model).alias("family"), native.license_of(model).alias("license"))
