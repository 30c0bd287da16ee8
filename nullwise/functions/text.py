"""Column expressions for prompt text and reply parsing.

All are built-in Spark expressions (no Python UDF), so they stay in
whole-stage codegen and run wherever the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_TOKEN = "missing"


def number_text(c: Column) -> Column:
    """The whole number in the shortest digits that read back: '12.0', '1e-07', '1e+16'.

    Plain digits from 0.0001 up to 1e16, an exponent of two digits or more outside.
    """
    d = c.cast("double")
    s = d.cast("string")  # plain from 0.001 up to 1e7 only
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,21)").cast("string"), "0+$", ""), "\\.$", ".0")
    e = F.regexp_replace(s, "\\.0E", "E")
    for pattern, to in (("E-(\\d)$", "e-0$1"), ("E-(\\d+)$", "e-$1"), ("E(\\d+)$", "e+$1")):
        e = F.regexp_replace(e, pattern, to)
    size = F.abs(d)
    return (F.when((d == 0) | ((size >= 1e-3) & (size < 1e7)), s)
            .when((size >= 1e-4) & (size < 1e16), plain).otherwise(e))


def value_text(c: Column, is_numeric: bool, missing: str = MISSING_TOKEN) -> Column:
    # format_string renders a null as 'null', so nulls are caught first
    v = number_text(c) if is_numeric else c.cast("string")
    return F.when(c.isNull(), F.lit(missing)).otherwise(v)


def strip_ws(c: Column) -> Column:
    """Python-style strip of leading/trailing whitespace."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def strip_think(c: Column) -> Column:
    """Remove the first complete <think>...</think> section, then strip.

    First opening tag, first closing tag after it; an unclosed tag is kept.
    """
    start = F.locate("<think>", c)
    end = F.when(start > 0, F.call_function("locate", F.lit("</think>"), c, start + 7)
                 ).otherwise(F.lit(0))
    cut = F.concat(F.substring(c, F.lit(1), start - 1), F.substring(c, end + 8, F.lit(2147483647)))
    return strip_ws(F.when((start > 0) & (end > 0), cut).otherwise(c))


def parse_label(c: Column, classes: list[int], default: int) -> Column:
    """First integer in the reply if it is an allowed class, else ``default``."""
    raw = F.regexp_extract(strip_ws(c), "-?\\d+", 0)
    val = raw.try_cast("bigint")
    ok = val.isin(*classes)
    return F.when(c.isNotNull() & ok, val.cast("int")).otherwise(F.lit(default))


def parse_flag(c: Column, name: str) -> Column:
    """G11 for one field: ``name = <digits>`` -> 1.0 if >= 1 else 0.0; absent -> 0.0."""
    raw = F.regexp_extract(c, name + "\\s*=\\s*(\\d+)", 1)
    return F.when(c.isNotNull() & raw.rlike("[1-9]"), F.lit(1.0)).otherwise(F.lit(0.0))  # any number of digits


def request_json(prompt: Column, model: str, system_prompt: str = "",
                 temperature: float | None = None) -> Column:
    """Chat request body with system and user messages."""
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
                   F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    fields = [F.lit(model).alias("model"), msgs.alias("messages"), F.lit(False).alias("stream")]
    if temperature is not None:
        fields.append(F.lit(float(temperature)).alias("temperature"))
    return F.to_json(F.struct(*fields))


def reply_text(body: Column, fmt: str) -> Column:
    """The reply text inside a response body, for the two supported formats."""
    if fmt == "ollama":
        return F.coalesce(F.get_json_object(body, "$.message.content"), F.lit(""))
    if fmt == "openai":
        return F.get_json_object(body, "$.choices[0].message.content")
    return body
