"""JSON payloads inside free text: extraction, typed parsing, repair."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.text import strip

# Characters of a broken text shown by default; the whole text stays in its column.
PREVIEW_CHARS = 200

STRICT_JSON = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def extract_json_payload(c: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; without such a pair the
    stripped text, less a surrounding code fence."""
    text = strip(c)
    first = F.instr(text, F.lit("{"))
    last = F.length(text) - F.instr(F.reverse(text), F.lit("}")) + 1
    has_object = (first > 0) & F.contains(text, F.lit("}")) & (last > first)

    newline = F.instr(text, F.lit("\n"))
    fenced = F.startswith(text, F.lit("```")) & (newline > 0)
    body = F.substr(text, newline + 1)
    closed = F.when(F.endswith(body, F.lit("```")), F.substr(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    return (
        F.when(has_object, F.substr(text, first, last - first + 1))
        .when(fenced, strip(closed))
        .otherwise(text)
    )


def is_one_json_object(c: Column) -> Column:
    """True when the text is exactly one JSON object.

    ``from_json`` stops after the first value, so the text is read as the only
    element of an array: trailing content then breaks the array.
    """
    elements = F.from_json(F.concat(F.lit("["), c, F.lit("]")), T.ArrayType(T.StringType()), STRICT_JSON)
    single = (F.size(elements) == 1) & F.startswith(F.get(elements, F.lit(0)), F.lit("{"))
    return F.coalesce(single, F.lit(False))


def parse_payload(
    df: DataFrame, col: str, schema: T.StructType | str, into: str = "parsed", preview: int = PREVIEW_CHARS
) -> DataFrame:
    """Typed parse of a payload column.

    Adds ``into`` (null when broken), ``ok``, and ``preview`` (start of the
    broken text).
    """
    ok = is_one_json_object(F.col(col))
    return df.withColumns(
        {
            into: F.when(ok, F.from_json(F.col(col), schema, STRICT_JSON)),
            "ok": ok,
            "preview": F.when(~ok, F.substr(F.col(col), F.lit(1), F.lit(preview))),
        }
    )


# What the scan stops at: a whole or unfinished string, a bracket, a comma, a colon.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{},:]', re.DOTALL)
_ENDS = {"[": "]", "{": "}"}


def repair_text(text: str) -> str:
    """Close arrays left open before a key, then whatever is open at the end.

    One scan from left to right over any number of scopes. Each open scope knows its last
    comma. A colon inside an array shows that the string before it is a key of the enclosing
    object, so all arrays inside that object ended before that comma. Text that is valid, or that has nothing to
    close, is given back as it is.
    """
    try:
        json.loads(text)
        return text
    except (ValueError, RecursionError):
        pass
    out: list[str] = []
    scopes: list[list] = []
    at, after_string, objects = 0, False, 0
    for token in _TOKEN.finditer(text):
        mark = token.group()
        out.append(text[at:token.start()])
        at = token.end()
        if mark in _ENDS:
            scopes.append([mark, None])
            objects += mark == "{"
        elif mark in "]}":
            if scopes and _ENDS[scopes[-1][0]] == mark:
                scopes.pop()
                objects -= mark == "}"
        elif mark == ",":
            if scopes:
                scopes[-1][1] = len(out)
        elif mark == ":" and after_string and objects and scopes[-1][0] == "[" and scopes[-1][1] is not None:
            comma, closed = scopes[-1][1], 0
            while scopes[-1][0] == "[":
                scopes.pop()
                closed += 1
            # The comma moves behind the brackets and now belongs to the object.
            out[comma] = "]" * closed + ","
            scopes[-1][1] = comma
        after_string = mark[0] == '"'
        out.append(mark)
    out.append(text[at:])
    if not scopes:
        return "".join(out)
    return "".join(out).rstrip().removesuffix(",") + "".join(_ENDS[s[0]] for s in reversed(scopes))


@F.pandas_udf(T.StringType())
def _repair_batch(texts: pd.Series) -> pd.Series:
    return texts.map(repair_text, na_action="ignore")


def repair_json(df: DataFrame, col: str, into: str = "repaired") -> DataFrame:
    """Repair truncated JSON in ``col``; valid rows pass through untouched.

    Adds ``into``, ``was_valid`` and ``is_valid``. Valid rows enter the Arrow
    batch as nulls, so only broken text crosses to Python.
    """
    checked = df.withColumn("was_valid", is_one_json_object(F.col(col)))
    broken = F.when(~F.col("was_valid"), F.col(col))
    return (
        checked.withColumn("_fixed", _repair_batch(broken))
        .withColumn(into, F.coalesce(F.col("_fixed"), F.col(col)))
        .drop("_fixed")
        .withColumn("is_valid", F.when(F.col("was_valid"), True).otherwise(is_one_json_object(F.col(into))))
    )
