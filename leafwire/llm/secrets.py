"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every
match must satisfy. The trigrams that any rule asks for are looked up in each text and
stored as postings (trigram, document); the postings of a document are intersected with
the rules' alternatives, and only what passes is verified with the expression itself. A
rule without mandatory trigrams scans all texts. All of it is DataFrame expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwire.llm.common import lookup, unused

try:
    from re import _constants as K
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as K
    import sre_parse as parser

MOST = 128
#: Bits of one mask column.
WIDTH = 60


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Group whose length is tested, and the least length.
    group: int = 0
    least: int = 1


#: The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Kinds that the method adds.
MORE = (Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"))


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def least(query: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without alternatives that another one implies."""
    return {a for a in query if not any(b < a for b in query)}


def both(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    out = least({x | y for x in a for y in b})
    return out if len(out) <= MOST else min(a, b, key=len)


def trigram_query(regex: str) -> set[frozenset[str]]:
    """Alternatives of which each match has, in lower case, all trigrams of at least one.

    An empty alternative means that nothing is mandatory.
    """

    def literal(code: int) -> str:
        return chr(code).lower()

    def choices(items: list) -> set[str] | None:
        """The characters of a class, if they are few."""
        out: set[str] = set()
        for op, arg in items:
            if op is K.LITERAL:
                out.add(literal(arg))
            elif op is K.RANGE and arg[1] - arg[0] < 4:
                out |= {literal(c) for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return out if len(out) <= 4 else None

    def walk(tree) -> tuple[set[frozenset[str]], set[str] | None]:
        """The query so far and, where the whole part is a few strings, these."""
        query, runs, exact = {frozenset()}, {""}, True
        for op, arg in tree:
            sub_query, strings = {frozenset()}, None
            if op is K.LITERAL:
                strings = {literal(arg)}
            elif op is K.IN:
                strings = choices(arg)
            elif op is K.SUBPATTERN:
                sub_query, strings = walk(arg[3])
            elif op is K.BRANCH:
                parts = [walk(x) for x in arg[1]]
                sub_query = least(set().union(*(q if s is None else both(q, {grams(x) for x in s}) for q, s in parts)))
                strings = set().union(*(s for _, s in parts)) if all(s is not None for _, s in parts) else None
                if strings is not None:
                    sub_query = {frozenset()}
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                low, high, inner = arg
                part_query, part = walk(inner)
                if part is not None and low == 0 and high == 1:
                    strings = part | {""}
                elif part is not None and low == high == 1:
                    strings = part
                elif low:
                    sub_query = part_query if part is None else both(part_query, {grams(x) for x in part})
            elif op is K.AT:
                strings = {""}
            if strings is not None and len(runs) * len(strings) <= MOST:
                runs = {a + b for a in runs for b in strings}
                query = both(query, sub_query)
                continue
            exact = False
            query = both(both(query, {grams(x) for x in runs}), sub_query if strings is None else {grams(x) for x in strings})
            runs = {""}
        if exact:
            return query, runs
        return both(query, {grams(x) for x in runs}), None

    query, strings = walk(parser.parse(regex))
    return query if strings is None else both(query, {grams(x) for x in strings})


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(set().union(*trigram_query(r.regex)) for r in rules)))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) of the trigrams that occur in each text, in either case."""
    low = F.lower("text")  # one expression of all tests, so that it is made once a text
    masks = [reduce(Column.__add__, [F.when(low.contains(t), F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, t in enumerate(trigrams[i : i + WIDTH])]) for i in range(0, len(trigrams), WIDTH)]
    rows = docs.select("doc_id", *[m.alias(f"m{i}") for i, m in enumerate(masks)])
    bits = [F.when(F.col(f"m{i // WIDTH}").bitwiseAND(F.lit(1 << i % WIDTH).cast("long")) != 0, F.lit(i)) for i in range(len(trigrams))]
    # an outer explode: from an inner one a filter is inferred that would make all tests again
    found = rows.select(F.array_compact(F.array(*bits)).alias("found"), "doc_id")
    return found.select(F.explode_outer("found").alias("trigram"), "doc_id").where("trigram is not null")


def candidates(index: DataFrame, trigrams: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and a column ``is_<kind>`` for each rule with mandatory trigrams."""
    words = range(-(-len(trigrams) // WIDTH))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % WIDTH)
    masks = index.groupBy("doc_id").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / WIDTH) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words])
    place = {t: i for i, t in enumerate(trigrams)}

    def has(alternative: frozenset[str]) -> Column:
        need = [sum(1 << (place[t] % WIDTH) for t in alternative if place[t] // WIDTH == w) for w in words]
        return reduce(Column.__and__, [F.col(f"m{w}").bitwiseAND(F.lit(n).cast("long")) == n for w, n in enumerate(need) if n])

    tests = [reduce(Column.__or__, [has(a) for a in sorted(trigram_query(r.regex), key=sorted)]).alias(f"is_{r.kind}") for r in rules if frozenset() not in trigram_query(r.regex)]
    return masks.select("doc_id", *tests).where(reduce(Column.__or__, [F.col(f"is_{r.kind}") for r in rules if frozenset() not in trigram_query(r.regex)]))


def spans(rule: Rule, rank: int) -> Column:
    """The rule's matches in ``text`` as an array of (start, rank, kind, end), in code points.

    The pieces between matches give the offsets: both come from the same leftmost scan.
    """
    regex = F.lit(rule.regex)
    whole = F.regexp_extract_all("text", regex, F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all("text", regex, F.lit(rule.group))
    rows = F.arrays_zip(F.split("text", rule.regex, -1).alias("gap"), whole.alias("all"), tested.alias("tested"))
    start = lambda acc, x: acc["at"] + F.length(x["gap"])
    span = lambda acc, x: F.struct(start(acc, x).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start(acc, x) + F.length(x["all"])).alias("end"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (start(acc, x) + F.coalesce(F.length(x["all"]), F.lit(0))).alias("at"),
            F.when(F.length(x["tested"]) >= rule.least, F.concat(acc["out"], F.array(span(acc, x)))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, name: str = "found") -> DataFrame:
    """The rows of ``docs`` with ``text`` non-null and a column ``name``: all spans, by start, then rule order.

    A null or empty text has no spans. Rows that share a doc_id, or have none, are scanned
    one by one. Columns of any other name stay as they are; one named ``name`` is an error.
    """
    if unused(name, docs) != name:
        raise ValueError(f"the documents have a column named {name}")
    trigrams = vocabulary(rules)
    listed = [r.kind for r in rules if frozenset() not in trigram_query(r.regex)]
    posted, marks = unused("_posted", docs), {k: unused(f"_is_{k}", docs) for k in listed}
    hits = lookup(candidates(postings(docs, trigrams), trigrams, rules).withColumnsRenamed({"doc_id": posted} | {f"is_{k}": m for k, m in marks.items()}))
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col(posted)), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    each = []
    for rank, rule in enumerate(rules):
        asked = F.coalesce(F.col(marks[rule.kind]), F.lit(False)) if rule.kind in listed else F.lit(True)
        each.append(F.when(asked & F.col("text").rlike(rule.regex), spans(rule, rank)).otherwise(none))
    return rows.withColumn(name, F.array_sort(F.concat(*each))).drop(posted, *marks.values())


def listing(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch that spans cover replaced by ``mark``; other columns, of whatever name, and clean or null texts stay."""
    names, spans_, none = docs.columns, unused("found", docs), unused("_none", docs)
    found = scan(docs.withColumn(none, F.col("text").isNull()), rules, spans_)
    begun = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def merge(acc: Column, x: Column) -> Column:
        piece = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        return F.struct(F.when(x["start"] >= acc["at"], F.concat(acc["out"], piece, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    whole = F.aggregate(spans_, begun, merge, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    clean = found.withColumn("text", F.when(F.size(spans_) > 0, whole).when(~F.col(none), F.col("text")))
    return clean.select(*names)


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``."""
    found = scan(docs.select("doc_id", "text"), rules)
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    count = lambda i: F.size(F.filter("found", lambda x: x["rank"] == i)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("found")).alias("spans"))
