"""Variants of records for tests: cuts, wraps, structural damage, random records and schemas."""

from __future__ import annotations

import random
import string
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRAPS = {
    "fence": lambda t: F.concat(F.lit("```\n"), t, F.lit("\n```")),
    "named_fence": lambda t: F.concat(F.lit("```text\n"), t, F.lit("\n```")),
    "markers": lambda t: F.concat(F.lit("<raif>\n"), t, F.lit("\n</raif>")),
    "tokens": lambda t: F.concat(F.lit("<|raif_start|>\n"), t, F.lit("\n<|raif_end|>")),
    "opener": lambda t: F.concat(F.lit("<raif>\n"), t),
    "crlf": lambda t: F.replace(t, F.lit("\n"), F.lit("\r\n")),
    "space": lambda t: F.concat(F.lit("\n  \n"), t, F.lit("\n\n")),
}
DAMAGE = {
    "coerce_separator": lambda t: F.regexp_replace(t, r"\A([^=:\n]*)=", "$1:"),
    "duplicate": lambda t: F.concat(t, F.lit("\n"), F.substring_index(t, "\n", 1)),
    "shrink_delimiters": lambda t: F.replace(F.replace(t, F.lit("<<<"), F.lit("<<")), F.lit(">>>"), F.lit(">>")),
    "other_nonce": lambda t: F.regexp_replace(t, r"(?m)^>>>[0-9a-f]+$", ">>>0123"),
    "garbage": lambda t: F.concat(t, F.lit("\nno separator here")),
    "reverse": lambda t: F.array_join(F.reverse(F.split(t, "\n", -1)), "\n"),
    "indent": lambda t: F.array_join(F.transform(F.split(t, "\n", -1), lambda x: F.concat(F.lit("  "), x)), "\n"),
}


def truncations(df: DataFrame, text: str = "raw") -> DataFrame:
    """Each record cut after each of its lines but the last: ``cut`` lines are left."""
    lines = F.split(text, "\n", -1)
    rows = df.withColumn("_lines", lines).where(F.size("_lines") > 1).withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("_lines") - 1)))
    return rows.withColumn(text, F.array_join(F.slice("_lines", 1, F.col("cut")), "\n")).drop("_lines")


def random_cuts(df: DataFrame, text: str = "raw", key: str = "rec_id", seed: int = 0) -> DataFrame:
    """Each record cut after a number of characters that depends on seed and key: ``cut`` are left, one at least is lost."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.greatest(F.length(text), F.lit(1))).cast("int")
    return df.withColumn("cut", at).withColumn(text, F.substring(F.col(text), F.lit(1), F.col("cut")))


def shuffled(df: DataFrame, text: str = "raw", key: str = "rec_id", seed: int = 0) -> DataFrame:
    """Each record with its lines in an order that depends on seed and key."""
    ranked = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.xxhash64(F.lit(seed), F.col(key), i).alias("h"), x.alias("line")))
    return df.withColumn(text, F.array_join(F.transform(F.array_sort(ranked), lambda x: x["line"]), "\n"))


def _variants(df: DataFrame, text: str, named: dict) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), f(F.col(text)).alias("t")) for n, f in named.items()]))
    return df.withColumn("_v", each).withColumns({"variant": F.col("_v.variant"), text: F.col("_v.t")}).drop("_v")


def wraps(df: DataFrame, text: str = "raw") -> DataFrame:
    """Each record in the seven ways that change its surface, never its value."""
    return _variants(df, text, WRAPS)


def damage(df: DataFrame, text: str = "raw") -> DataFrame:
    """Each record in seven structural mutations."""
    return _variants(df, text, DAMAGE)


def random_value(r: random.Random, depth: int = 2) -> Any:
    """A scalar, an array of scalars, or an object of such."""
    if depth and r.random() < 0.4:
        return {random_key(r): random_value(r, depth - 1) for _ in range(r.randrange(1, 4))}
    if depth and r.random() < 0.2:
        return [random_scalar(r) for _ in range(r.randrange(1, 4))]
    return random_scalar(r)


def random_scalar(r: random.Random) -> Any:
    return r.choice([True, False, None, r.randrange(-999, 999), r.randrange(1, 99) / 4, random_key(r) + " " + random_key(r)])


def random_key(r: random.Random) -> str:
    return "".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(1, 8)))


def step_of(key: str) -> str:
    """A key as a segment of a path, wrapped where the format's own signs stand in it."""
    return f"<<<{key}>>>" if set(key) & set(".[]=:<>{},") else key


def record_of(value: dict, path: str = "") -> str:
    """A record of an object of scalars, arrays and objects, by paths."""
    lines = []

    def put(here: str, v: Any) -> None:
        if isinstance(v, dict):
            lines.append(record_of(v, here) if v else f"{here}={{}}")
        elif isinstance(v, list):
            if not v:
                lines.append(f"{here}=[]")
            for i, x in enumerate(v):
                put(f"{here}[{i}]", x)
        else:
            lines.append(f"{here}={'true' if v is True else 'false' if v is False else 'null' if v is None else v}")

    for k, v in value.items():
        put(f"{path}.{step_of(k)}" if path else step_of(k), v)
    return "\n".join(lines)


def schema_of(value: dict, path: str = "", optional: bool = False) -> str:
    """The declaration that the value satisfies; arrays are of the type of their items, or of strings if these differ."""
    lines = []
    for k, v in value.items():
        here = f"{path}.{step_of(k)}" if path else step_of(k)
        mark = "?" if optional or v is None else ""
        if isinstance(v, dict):
            lines.append(schema_of(v, here, optional))
        elif isinstance(v, list):
            kinds = {scalar_kind(x) for x in v}
            lines.append(f"{here}[]:{kinds.pop() if len(kinds) == 1 else 'o'}{mark}")
        else:
            lines.append(f"{here}:{scalar_kind(v)}{mark}")
    return "\n".join(lines)


def scalar_kind(x: Any) -> str:
    return "b" if isinstance(x, bool) else "n" if isinstance(x, int | float) else "s"


def typed_records(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """rec_id, raw, value (JSON text), schema of n objects with a field of each declared type: s, n, b, t, o and arrays."""
    import json

    r, rows = random.Random(seed), []
    for i in range(n):
        value = {"s": random_key(r), "n": r.randrange(-99, 99), "b": r.random() < 0.5, "t": "null", "o": {random_key(r): r.randrange(9)}, "a": [random_key(r) for _ in range(r.randrange(1, 4))]}
        rows.append((i, record_of(value), json.dumps(value), "s:s\nn:n\nb:b\nt:t\no:o\na[]:s"))
    return spark.createDataFrame(rows, "rec_id long, raw string, value string, schema string")


def perturbed_schemas(declaration: str) -> dict[str, str]:
    """Five changes: a type flipped, a line dropped, all optional, a field more, all open."""
    lines = declaration.split("\n")
    flip = {"s": "n", "n": "b", "b": "s", "t": "n", "o": "s"}
    name, _, kind = lines[0].rpartition(":")
    return {
        "flip": "\n".join([f"{name}:{flip[kind[0]]}{kind[1:]}", *lines[1:]]),
        "drop": "\n".join(lines[1:]),
        "optional": "\n".join(x if x.endswith("?") else x + "?" for x in lines),
        "require": "\n".join([*lines, "never_there:s"]),
        "open": "\n".join(f"{x.rpartition(':')[0]}:o?" for x in lines),
    }


def soup(r: random.Random, n: int, tokens: bool = False) -> str:
    """Random characters, or random tokens of the format."""
    if tokens:
        return "".join(r.choice(["a", "b.c", "=", ":", "::", "<<<", ">>>", "{", "}", "[", "]", ",", "\n", "1", "null", ":n="]) for _ in range(n))
    return "".join(r.choice("ab=:.[]{}<>,\n\r 01") for _ in range(n))


def random_records(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """rec_id, raw, value (JSON text), schema of n random objects, for tests."""
    import json

    r = random.Random(seed)
    rows = []
    for i in range(n):
        value = {random_key(r): random_value(r) for _ in range(r.randrange(1, 6))}
        rows.append((i, record_of(value), json.dumps(value), schema_of(value)))
    return spark.createDataFrame(rows, "rec_id long, raw string, value string, schema string")


#: Examples of each shape that the presets make, and the shares of evaluation, schema and adversarial ones.
PRESETS = {"smoke": 30, "warm": 100, "full": 500}
EVALUATED, WITH_SCHEMA, ADVERSARIAL = 0.05, 0.7, 0.5


def template_examples(spark: SparkSession, per_shape: int | str, shapes: list[str], evaluated: float = EVALUATED, seed: int = 0, holdout: tuple[str, ...] = (), with_schema: float = WITH_SCHEMA, adversarial: float = ADVERSARIAL) -> DataFrame:
    """Synthetic examples made on the executors: rec_id, split, shape, prompt, raw, schema (null for those without), adversarial.

    ``per_shape``: a number or a preset. Shapes of ``holdout`` go to that split whole; of the others the share
    ``evaluated`` is valid. Adversarial ones hold text that looks like the format.
    """
    n = PRESETS[per_shape] if isinstance(per_shape, str) else per_shape
    rows = spark.range(n * len(shapes)).withColumnRenamed("id", "rec_id")
    shape = F.element_at(F.array(*[F.lit(s) for s in shapes]), (F.col("rec_id") % len(shapes) + 1).cast("int"))
    draw = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("rec_id")), F.lit(10_000)) / 10_000
    odd = draw("adversarial") < adversarial
    name = F.when(odd, F.format_string("a=%d: {b}", "rec_id")).otherwise(F.format_string("user %d", "rec_id"))
    raw = F.concat_ws("\n", F.format_string("id=%d", "rec_id"), F.concat(F.lit("user.name=<<<"), name, F.lit(">>>")), F.concat(F.lit("kind="), shape))
    prompt = F.concat(F.lit("Translate: "), F.to_json(F.struct(F.col("rec_id").alias("id"), F.struct(name.alias("name")).alias("user"), shape.alias("kind"))))
    split = F.when(shape.isin(*holdout) if holdout else F.lit(False), "holdout").when(draw("split") < evaluated, "valid").otherwise("train")
    schema = F.when(draw("schema") < with_schema, "id:n\nuser.name:s\nkind:s")
    return rows.select("rec_id", split.alias("split"), shape.alias("shape"), prompt.alias("prompt"), raw.alias("raw"), schema.alias("schema"), odd.alias("adversarial"))
