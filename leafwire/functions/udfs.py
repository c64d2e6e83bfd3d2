"""The codec and the tree functions as Spark columns, in Arrow batches.

Each function takes columns and gives a column. A value is canonical JSON text, which
compares and groups; ``parse_json`` makes a VARIANT of it for extraction. A record that
cannot be read never fails a task.

Catalyst may run a deterministic Python function again where a filter on its result comes
before another use of it. :func:`decoded` marks its function so that this cannot happen: one
evaluation a record.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwire.functions import codec, grammar, trees

REPAIRS = "array<struct<kind:string,detail:string>>"
STRICT = f"struct<ok:boolean,value:string,error:string,repairs:{REPAIRS}>"
LENIENT = f"struct<value:string,errors:array<struct<line:int,key:string,error:string>>,repairs:{REPAIRS},truncated:boolean>"
LEAVES = "array<struct<key:string,kind:string,raw:string,cells:array<string>>>"
FLAT = "array<struct<path:string,type:string,leaf:string>>"

_repairs = pa.list_(pa.struct([("kind", pa.string()), ("detail", pa.string())]))
_strict = pa.struct([("ok", pa.bool_()), ("value", pa.string()), ("error", pa.string()), ("repairs", _repairs)])
_lenient = pa.struct([("value", pa.string()), ("errors", pa.list_(pa.struct([("line", pa.int32()), ("key", pa.string()), ("error", pa.string())]))), ("repairs", _repairs), ("truncated", pa.bool_())])
_leaves = pa.list_(pa.struct([("key", pa.string()), ("kind", pa.string()), ("raw", pa.string()), ("cells", pa.list_(pa.string()))]))
_flat = pa.list_(pa.struct([("path", pa.string()), ("type", pa.string()), ("leaf", pa.string())]))


def batched(spark_type: str, arrow_type: pa.DataType, f: Callable[..., Any]) -> Any:
    """An Arrow function of the values of its columns; null in the first column gives null."""

    def run(*columns: pa.Array) -> pa.Array:
        lists = [c.to_pylist() for c in columns]
        return pa.array([None if row[0] is None else f(*row) for row in zip(*lists)], arrow_type)

    if len(spark_type) > 0 and f.__code__.co_argcount == 1:
        return F.arrow_udf(lambda a: run(a), spark_type)
    return F.arrow_udf(lambda a, b: run(a, b), spark_type)


@lru_cache(maxsize=256)
def schema_tree(declaration: str) -> codec.Node | str:
    """Parsed once a declaration in each worker; the error's text if it is malformed."""
    try:
        return codec.parse_schema(declaration)
    except codec.Unreadable as error:
        return str(error)


def strict_row(text: str, declaration: str | None = None) -> dict:
    tree = schema_tree(declaration) if declaration is not None else None
    if isinstance(tree, str):
        return {"ok": False, "value": None, "error": tree, "repairs": []}
    out = codec.decode(text, tree)
    return {**out, "value": codec.canon(out["value"]) if out["ok"] else None}


def lenient_row(text: str, declaration: str | None = None) -> dict:
    tree = schema_tree(declaration) if declaration is not None else None
    if isinstance(tree, str):
        return {"value": "{}", "errors": [{"line": None, "key": None, "error": tree}], "repairs": [], "truncated": False}
    out = codec.decode_lenient(text, tree)
    return {**out, "value": codec.canon(out["value"])}


def leaf_rows(text: str) -> list[dict]:
    return [{"key": x.key, "kind": x.kind, "raw": None if isinstance(x.data, list) else x.data, "cells": x.data if isinstance(x.data, list) else None} for x in codec.leaves(text)]


def flat_rows(text: str) -> list[dict] | None:
    try:
        return [{"path": p, "type": trees.kind_of(v), "leaf": trees.shown(v)} for p, v in trees.walk(trees.load(text))]
    except (ValueError, RecursionError):
        return None


def decode(text: Column | str, schema: Column | str | None = None, one_evaluation: bool = False) -> Column:
    """Strict decode: ok, value, error, repairs. ``schema``: a column of declarations, null for none."""
    args = [text] if schema is None else [text, schema]
    f = batched(STRICT, _strict, (lambda t: strict_row(t)) if schema is None else (lambda t, s: strict_row(t, s)))
    return (f.asNondeterministic() if one_evaluation else f)(*args)


def decode_lenient(text: Column | str, schema: Column | str | None = None, one_evaluation: bool = False) -> Column:
    """Lenient decode: value, errors, repairs, truncated."""
    args = [text] if schema is None else [text, schema]
    f = batched(LENIENT, _lenient, (lambda t: lenient_row(t)) if schema is None else (lambda t, s: lenient_row(t, s)))
    return (f.asNondeterministic() if one_evaluation else f)(*args)


def decoded(df: DataFrame, text: str, into: str = "decoded", schema: str | None = None, lenient: bool = False) -> DataFrame:
    """``df`` with a decode column that is evaluated once a record, however it is used."""
    f = decode_lenient if lenient else decode
    return df.withColumn(into, f(text, schema, one_evaluation=True))


def decoded_together(df: DataFrame, extracted: dict[str, str] | None = None, **texts: str) -> DataFrame:
    """``df`` with a strict decode of each text (name=column) and the JSON in each reply of ``extracted``, once a record.

    All stand in one projection, so that a task needs one Python worker, not one for each.
    """
    found = {name: found_json(c) for name, c in (extracted or {}).items()}
    return df.withColumns({name: decode(c, one_evaluation=True) for name, c in texts.items()} | found)


def found_json(text: Column | str) -> Column:
    """json, canon: the JSON of a chatty reply as :func:`extract_json` gives it, and its canonical form."""

    def row(t: str) -> dict:
        found = trees.json_in(t)
        return {"json": found, "canon": None if found is None else trees.canonical(found)}

    return batched("struct<json:string,canon:string>", pa.struct([("json", pa.string()), ("canon", pa.string())]), lambda t: row(t)).asNondeterministic()(text)


def record_leaves(text: Column | str) -> Column:
    """The record's leaves: key, kind, raw, cells."""
    return batched(LEAVES, _leaves, lambda t: leaf_rows(t))(text)


def flatten_json(text: Column | str) -> Column:
    """(path, type, leaf as text) of each leaf of a JSON text; null if it is not JSON."""
    return batched(FLAT, _flat, lambda t: flat_rows(t))(text)


def primitive_leaves(text: Column | str) -> Column:
    """Each leaf of a JSON text as a prompt shows it."""
    rows = flatten_json(text)
    return F.transform(rows, lambda x: x["leaf"])


def primitive_leaves_strict(text: Column | str) -> Column:
    """As :func:`primitive_leaves`, with numbers as a JavaScript engine spells them."""

    def rows(t: str) -> list[str] | None:
        try:
            return [trees.shown_strictly(v) for _, v in trees.walk(trees.load(t))]
        except (ValueError, RecursionError):
            return None

    return batched("array<string>", pa.list_(pa.string()), lambda t: rows(t))(text)


def canon(text: Column | str) -> Column:
    """Canonical JSON; null if it is not JSON."""
    return batched("string", pa.string(), lambda t: trees.canonical(t))(text)


def canon_loose(text: Column | str) -> Column:
    """Canonical JSON in which 5 and 5.0 are equal."""
    return batched("string", pa.string(), lambda t: trees.loose(t))(text)


def canon_equal(a: Column | str, b: Column | str) -> Column:
    return canon(a) == canon(b)


def value_equal(a: Column | str, b: Column | str) -> Column:
    return canon_loose(a) == canon_loose(b)


def minify(text: Column | str) -> Column:
    return batched("string", pa.string(), lambda t: trees.minified(t))(text)


def extract_json(text: Column | str) -> Column:
    """The JSON of a chatty reply, compact; null if there is none."""
    return batched("string", pa.string(), lambda t: trees.json_in(t))(text)


def describe_diff(expected: Column | str, got: Column | str) -> Column:
    """The first difference of two JSON texts in words."""

    def words(a: str, b: str | None) -> str | None:
        try:
            return trees.difference(trees.load(a), trees.load(b))
        except (ValueError, RecursionError):
            return None

    return batched("string", pa.string(), lambda a, b: words(a, b))(expected, got)


def four_digits(x: Column | str) -> Column:
    """A loss to four significant digits; an em dash where there is none."""
    name = x if isinstance(x, Column) else F.col(x)
    return F.coalesce(batched("string", pa.string(), lambda v: f"{v:.4g}")(name), F.lit("—"))


def accepts(text: Column | str, rules: str = grammar.RECORDS) -> Column:
    """Whether the grammar accepts the text. The grammar is checked on the driver first."""
    grammar.compiled(rules)
    return batched("boolean", pa.bool_(), lambda t: grammar.compiled(rules).accepts(t))(text)


def repair_kinds(result: Column) -> Column:
    return F.transform(result["repairs"], lambda x: x["kind"])


def batch_result(result: Column) -> Column:
    """ok, value (where ok), repairs (their number), error (where not ok) of a strict decode."""
    ok = result["ok"]
    return F.struct(ok.alias("ok"), F.when(ok, result["value"]).alias("value"), F.size(result["repairs"]).alias("repairs"), F.when(~ok, result["error"]).alias("error"))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Any:
    from tokenizers import Tokenizer  # only where tokens are asked for

    return Tokenizer.from_file(path)


def token_count(text: Column | str, path: str) -> Column:
    """Tokens of a text by the tokenizer whose file is at ``path`` on every machine."""
    return batched("long", pa.int64(), lambda t: len(tokenizer(path).encode(t, add_special_tokens=False).ids))(text)
