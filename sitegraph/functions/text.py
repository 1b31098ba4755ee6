"""Small string helpers as Column expressions."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "\\s\\u00a0"
_BLANKS = " \t\n\x0b\f\r\u00a0"


def strip(text: Column) -> Column:
    """Trim all blanks, also line breaks and no-break spaces (``trim`` only drops spaces).
    Blanks before one of Unicode's own line ends at the end go, too; only such texts need a pattern."""
    edges = rf"^[{BLANK}]+|[{BLANK}]+$"
    odd = text.endswith("\u0085") | text.endswith("\u2028") | text.endswith("\u2029")
    return F.when(odd, F.regexp_replace(text, edges, "")).otherwise(F.btrim(text, F.lit(_BLANKS)))


def is_blank(text: Column) -> Column:
    """Only tab, line feed, form feed, carriage return and space."""
    return text.rlike(r"^[\t\n\f\r ]*\z")


def squeeze(text: Column) -> Column:
    """An all-blank text becomes one line feed if it has one, else one space."""
    return F.when(
        is_blank(text), F.when(text.contains("\n"), F.lit("\n")).otherwise(F.lit(" "))
    ).otherwise(text)


def pretty_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def indent_json(text: Column, sort_keys: bool = False) -> Column:
    """JSON text laid out for reading (four blanks per level), for reports."""

    @F.arrow_udf("STRING")
    def indent(lines: pa.Array) -> pa.Array:
        def layout(line: str | None) -> str | None:
            if line is None:
                return None
            return json.dumps(json.loads(line), indent=4, ensure_ascii=False, sort_keys=sort_keys)

        return pa.array([layout(line) for line in lines.to_pylist()], pa.string())

    return indent(text)
