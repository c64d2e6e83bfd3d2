"""Functions of records, prompts and replies that need no Python: Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwire.functions.codec import SPACE

#: What a line may hold: Java's dot leaves out NEL too, which a record's line may have.
IN_LINE = r"[^\n\r\x{2028}\x{2029}]"
#: Chat markers of the two template families.
LLAMA = ("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>", "<|begin_of_text|>")
CHATML = ("<|im_start|>", "\n", "<|im_end|>\n", "")


def _col(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def trim_record(text: Column | str) -> Column:
    """Outer white space by the format's own set: BOM yes, NEL no."""
    return F.btrim(_col(text), F.lit(SPACE))


def strip_cr(line: Column | str) -> Column:
    return F.regexp_replace(_col(line), "\\r\\z", "")


def strip_fence(text: Column | str) -> Column:
    """The inside of a text that is one fenced block as a whole."""
    space = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACE) + "]"
    inside = F.regexp_extract(_col(text), rf"(?s)\A{space}*```[a-zA-Z]*\n(.*?)\n```{space}*\z", 1)
    return F.when(_col(text).rlike(rf"(?s)\A{space}*```[a-zA-Z]*\n.*?\n```{space}*\z"), inside).otherwise(_col(text))


def normalize_crlf(text: Column | str) -> Column:
    """LF line ends where every line but the last ends in CR."""
    lines = F.split(_col(text), "\n", -1)
    all_cr = (F.size(lines) > 1) & F.forall(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: x.endswith("\r"))
    return F.when(all_cr, F.array_join(F.transform(lines, strip_cr), "\n")).otherwise(_col(text))


def strip_markers(text: Column | str) -> Column:
    """Without the frame at the edges."""
    opened = F.regexp_replace(_col(text), r"\A\s*(?:<\|raif_start\|>|<raif>)(?:\n|\z)", "")
    return F.regexp_replace(opened, r"(?:\A|\n)(?:<\|raif_end\|>|</raif>)\s*\z", "")


def number_text(x: Column) -> Column:
    """A double as JSON writes it: whole ones by all their digits, others by the shortest ones, with an exponent below 1e-4.

    Null for infinities and for whole numbers of 2 ** 115 and more, which the codec reads.
    """
    size, high = F.abs(x), F.floor(x / 2.0**53)
    whole = F.when(size < 9.0e18, x.try_cast("bigint").cast("string")).when(
        size < 2.0**115, (high.try_cast("decimal(19,0)") * F.lit(2**53).cast("decimal(16,0)") + (x - high * 2.0**53).try_cast("decimal(16,0)")).cast("string")
    )
    plain = F.regexp_replace(x.try_cast("decimal(38,20)").cast("string"), r"0+\z", "")
    tiny = F.regexp_replace(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), "E-", "e-"), r"e-([0-9])\z", "e-0$1")
    return F.when(x == F.rint(x), whole).when(size >= 1.0e-4, plain).otherwise(tiny)


def infer_scalar(raw: Column | str) -> Column:
    """JSON text of a bare scalar: word, number by way of a double, else a string. Wrapped text unwraps once.

    Null for a number that overflows, which the codec refuses, and where :func:`number_text` is null.
    """
    raw = _col(raw)
    number = raw.rlike(r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z")
    wrapped = raw.startswith("<<<") & raw.endswith(">>>") & (F.length(raw) >= 6)
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"\A\[|\]\z", "")
    return (
        F.when(wrapped, quoted(F.substring(raw, F.lit(4), F.length(raw) - 6)))
        .when(raw.isin("true", "false", "null", "[]", "{}"), raw)
        .when(number, number_text(raw.try_cast("double")))
        .otherwise(quoted(raw))
    )


def strip_think(text: Column | str) -> Column:
    """A reply without one leading block of thoughts."""
    return F.regexp_replace(_col(text), r"(?U)\A\s*(?s:<think>.*?</think>)\s*", "")


def variant_for_model(text: Column | str, thinks: Column) -> Column:
    """The reply without thoughts for models that think, else as it is."""
    return F.when(thinks, strip_think(text)).otherwise(_col(text))


def template_family(model: Column | str) -> Column:
    low = F.lower(_col(model))
    return F.when(low.contains("qwen") | low.contains("chatml"), "chatml").otherwise("llama")


def chat_render(messages: Column | str, family: Column | str = "llama") -> Column:
    """Messages (role, content) in the family's markers."""
    kind = family if isinstance(family, Column) else F.lit(family)

    def by(marks: tuple[str, str, str, str]) -> Column:
        turns = F.transform(_col(messages), lambda m: F.concat(F.lit(marks[0]), m["role"], F.lit(marks[1]), m["content"], F.lit(marks[2])))
        return F.concat(F.lit(marks[3]), F.array_join(turns, ""))

    return F.when(kind == "chatml", by(CHATML)).otherwise(by(LLAMA))


def translate_prompt(text: Column | str, wrapper: str = "Translate this JSON:\n") -> Column:
    """JSON gets the task's wrapper, other text stays."""
    return F.when(F.try_parse_json(_col(text)).isNotNull(), F.concat(F.lit(wrapper), _col(text))).otherwise(_col(text))


def prompt(details: Column | str, schema: Column | str) -> Column:
    return F.concat_ws("\n\n", _col(details), _col(schema))


# Licence id, its name and link, and the attribution that each family of base models asks for.
LICENSES = {
    "qwen": ("apache-2.0", "Apache License 2.0", "https://www.apache.org/licenses/LICENSE-2.0", "Built with Qwen"),
    "llama": ("llama3.2", "Llama 3.2 Community License", "https://www.llama.com/llama3_2/license/", "Built with Llama"),
}


def license_family(model: Column | str) -> Column:
    return F.when(F.lower(_col(model)).contains("qwen"), "qwen").otherwise("llama")


def license_of(model: Column | str) -> Column:
    """Licence id of a base model's family."""
    return license_details(model)["id"]


def license_details(model: Column | str) -> Column:
    """family, id, name, link and attribution."""
    family = license_family(model)
    part = lambda i: F.when(family == "qwen", LICENSES["qwen"][i]).otherwise(LICENSES["llama"][i])
    return F.struct(family.alias("family"), part(0).alias("id"), part(1).alias("name"), part(2).alias("link"), part(3).alias("attribution"))


#: How many characters of a text each report shows.
SHOWN = {"mismatch": 120, "error": 160, "gold": 200, "prompt": 240, "output": 400}


def shortened(text: Column | str, report: str = "output") -> Column:
    """The start of a text, as long as the report shows."""
    return F.substring(_col(text), 1, SHOWN[report])


def byte_delta(record: Column | str, minified: Column | str) -> Column:
    """bytes of the record, of the JSON, and by how many percent the record is smaller."""
    a, b = F.octet_length(_col(record)), F.octet_length(_col(minified))
    return F.struct(a.alias("record"), b.alias("json"), F.try_divide(F.lit(100.0) * (b - a), b).alias("percent_saved"))


def word_count(text: Column | str) -> Column:
    """Words between spaces: a stand-in, not a count of tokens."""
    return F.size(F.filter(F.split(_col(text), r"\s+", -1), lambda x: x != ""))


def first_error_line(error: Column | str) -> Column:
    return F.split(_col(error), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]", 2)[0]


def contains_all(prompt_: Column | str, parts: Column | str) -> Column:
    """Whether every part stands in the prompt."""
    return F.forall(_col(parts), lambda x: F.contains(_col(prompt_), x))


def missing_parts(prompt_: Column | str, parts: Column | str) -> Column:
    return F.filter(_col(parts), lambda x: ~F.contains(_col(prompt_), x))


def fraction(part: Column | str, whole: Column | str) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(_col(part).cast("double"), _col(whole))


def leaf_type(value: Column | str) -> Column:
    """boolean, number or string of a VARIANT leaf; null counts as string."""
    kind = F.schema_of_variant(_col(value))
    return F.when(kind == "BOOLEAN", "boolean").when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise("string")
