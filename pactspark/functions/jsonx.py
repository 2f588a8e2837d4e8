"""Getting JSON out of text that merely contains it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pactspark.functions.scope import let
from pactspark.functions.text import strip
from pactspark.packs.fixed import FENCE_PATTERN

SALVAGED = StructType([StructField("json", StringType()), StructField("strategy", StringType())])


def is_json(text: Column) -> Column:
    """True for one valid JSON value, other than a bare null, and nothing behind it.

    The parser stops after a value whatever follows. Inside a list and inside an object
    the value must end where the text ends, and no text breaks out of both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    return listed.isNotNull() & named.isNotNull() & (F.coalesce(F.trim(text), F.lit("")) != "null")


def whole_or_fenced(text: Column) -> Column:
    """The text itself, else the first fenced block that parses; null if neither."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(FENCE_PATTERN), F.lit(1)), strip)

    def result(value: Column, strategy: str) -> Column:
        return F.struct(value.alias("json"), F.lit(strategy).alias("strategy"))

    return let(strip(text), lambda t: F.when(is_json(t), result(t, "whole")).otherwise(
        let(F.get(F.filter(blocks, is_json), 0), lambda b: F.when(b.isNotNull(), result(b, "fenced")))
    ))


def value_at(text: str, start: int = 0) -> int | None:
    """Where the JSON value that begins at ``start`` ends; null if none does, or it is a bare null."""
    try:
        value, stop = json.JSONDecoder().raw_decode(text, start)
    except (ValueError, RecursionError):
        return None
    return None if value is None else stop


def embedded_value(text: str) -> str | None:
    """The object or list at the first brace or bracket, whichever of them is read."""
    for start in sorted(p for p in map(text.find, "{[") if p >= 0):
        stop = value_at(text, start)
        if stop is not None:
            return text[start:stop]
    return None


def leading_value(text: str) -> str | None:
    """The value that the text begins with, if nothing else stands on its last line."""
    stop = value_at(text)
    if stop is None or text[stop:].partition("\n")[0].strip():
        return None
    return text[:stop]


@F.pandas_udf(SALVAGED)
def salvage_rest(texts: pd.Series) -> pd.DataFrame:
    """An embedded object or list, then a leading value, for texts the built-ins gave up on."""
    out = []
    for text in texts:
        body = (text or "").strip()
        finds = ((embedded_value(body), "balanced"), (leading_value(body), "lines"))
        out.append(next((f for f in finds if f[0] is not None), (None, None)))
    return pd.DataFrame(out, columns=["json", "strategy"])


salvage_rest = salvage_rest.asNondeterministic()
