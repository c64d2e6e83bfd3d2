"""Queries of the operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwire.llm import decontaminate, hmm, html_text, licenses, packing, quality, secrets, simhash, substrings, vptree
from leafwire.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_scores(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_neighbours, op2_html, op3_decontaminate, op4_substrings, op5_packing, op6_quality, op7_secrets, op8_simhash, op9_licenses, op10_language_model, pipeline)}
WORDS_SQL = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP3_SQL = f"""
with items as (select item_id, {WORDS_SQL} as w from benchmark),
wins as (select distinct item_id, array_to_string(w[i : i + 7], ' ') as phrase, least(len(w), 8) as n from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from items where len(w) > 0)),
docs as (select doc_id, {WORDS_SQL} as w from documents),
grams as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as phrase from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from wins))),
found as (select doc_id, i, n, item_id from grams join wins using (phrase, n)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by 1),
words as (select doc_id, p, w[p] as term from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from docs)),
counts as (select term, count(*) as n from words group by 1),
places as (select phrase, off, term, row_number() over (partition by phrase order by coalesce(n, 0), off) as r from (select phrase, off, string_split(phrase, ' ')[off] as term from (select phrase, unnest(range(1, len(string_split(phrase, ' ')) + 1)) as off from (select distinct phrase from wins))) left join counts using (term)),
lists as (select doc_id, phrase, r, p - off as s from places join words using (term) where r <= 2),
close as (select distinct a.doc_id, a.phrase from lists a join lists b using (doc_id, phrase) where a.r = 1 and b.r = 2 and abs(a.s - b.s) <= 4 union select doc_id, phrase from lists join wins using (phrase) where r = 1 and n = 1),
nearly as (select doc_id, count(distinct item_id) as n_near from close join wins using (phrase) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from found) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated, coalesce(n_near, 0) as n_near
from docs left join hits using (doc_id) left join named using (doc_id) left join nearly using (doc_id)"""


#: The contract's patterns, written for DuckDB and not taken from the operator, and those of the two added kinds:
#: kind, pattern, group whose length is tested, least length.
KINDS = (
    ("assign", r"""(?:([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
)


def _spans_sql() -> str:
    """Spans from the pieces between a pattern's matches and the matches themselves."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        regex = pattern.replace("'", "''")
        parts.append(
            f"select doc_id, {rank} as rank, '{kind}' as kind, list_sum([len(x) for x in g[1 : i]]) + coalesce(list_sum([len(x) for x in m[1 : i - 1]]), 0) as start, len(m[i]) as n, len(v[i]) as tested, {least} as least "
            f"from (select doc_id, string_split_regex(text, '{regex}') as g, regexp_extract_all(text, '{regex}', 0) as m, regexp_extract_all(text, '{regex}', {group}) as v, unnest(range(1, len(m) + 1)) as i from d)"
        )
    return " union all ".join(parts)


OP7_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
s as (select *, kind || ':' || cast(start as bigint) || ':' || cast(start + n as bigint) as line from ({_spans_sql()}) where tested >= least),
a as (select doc_id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access, count(*) filter (where rank = 2) as n_hex,
coalesce(string_agg(line, ',' order by start, rank) filter (where rank < 3), '') as base, string_agg(line, ',' order by start, rank) as spans from s group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""

#: The others train models, iterate, or need a hash or a tokenizer that SQL lacks; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op7_secrets": OP7_SQL}
