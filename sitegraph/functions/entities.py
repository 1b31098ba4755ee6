"""Character entities as Column expressions (all JVM-side)."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the five entities every markup dialect knows
XML_ENTITIES = {"apos": "'", "quot": '"', "amp": "&", "lt": "<", "gt": ">"}

_PIECES = r"&#[0-9]+;|&#x[0-9a-fA-F]+;|&[a-zA-Z][-.a-zA-Z0-9]*;|[^&]+|&"


def lookup(table: dict[str, str]) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def code_point(n: Column) -> Column:
    """Character of a Unicode code point (``chr`` in Spark is modulo 256)."""
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def _numeric(piece: Column) -> Column:
    digits = F.regexp_extract(piece, "^&#x?([0-9a-fA-F]+);$", 1)
    base16 = piece.startswith("&#x")
    n = F.when(base16, F.conv(digits, 16, 10)).otherwise(digits)
    return F.coalesce(code_point(n.try_cast("bigint")), piece)


def decode_xml_entities(text: Column) -> Column:
    """The five XML entities to characters; ``&amp;`` last, so nothing decodes twice."""
    for name in ("lt", "gt", "quot", "apos", "amp"):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(XML_ENTITIES[name]))
    return text


def convert_entities(text: Column, mode: str | None = "html", numeric: bool = True) -> Column:
    """Entities to characters.

    ``html``: named entities; the five XML names only where HTML has them too,
    unknown names get their ampersand escaped. ``xml``: only the five.
    ``xhtml``: both, unknown names kept. ``None``: numeric ones only.
    """
    if mode not in (None, "html", "xml", "xhtml"):
        raise ValueError(f"unknown entity mode: {mode}")
    known: dict[str, str] = {}
    if mode in ("xml", "xhtml"):
        known.update(XML_ENTITIES)
    if mode in ("html", "xhtml"):
        known.update({name: chr(cp) for name, cp in name2codepoint.items()})
    escape_unknown = mode == "html"

    def convert(piece: Column) -> Column:
        name = F.substring(piece, F.lit(2), F.length(piece) - 2)
        named = F.lit(None).cast("string")
        if known:
            named = lookup(known)[name]
        other = piece
        if escape_unknown:
            other = F.when(name.isin(*XML_ENTITIES), piece).otherwise(
                F.concat(F.lit("&amp;"), F.substring(piece, F.lit(2), F.length(piece)))
            )
        done = F.when(piece.rlike(r"^&[a-zA-Z][-.a-zA-Z0-9]*;$"), F.coalesce(named, other))
        if numeric:
            done = done.when(piece.startswith("&#"), _numeric(piece))
        return done.otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    converted = F.array_join(F.transform(pieces, convert), "")
    return F.when(text.contains("&"), converted).otherwise(text)


def attribute_value(text: Column) -> Column:
    """Attribute values: the five XML entities and numeric references are decoded."""
    return F.when(text.contains("&"), convert_entities(text, "xml")).otherwise(text)


def complete_references(text: Column) -> Column:
    """Text keeps its entities, but a reference without ``;`` gains one."""
    fixed = F.regexp_replace(
        text,
        r"&(#[0-9]++|#[xX][0-9a-fA-F]++|[a-zA-Z][-.a-zA-Z0-9]*+)(?=[^-.;a-zA-Z0-9])",
        "&$1;",
    )
    return F.when(text.contains("&"), fixed).otherwise(text)


def escape_entities(text: Column) -> Column:
    """Bare ``&`` (not part of a reference), ``<`` and ``>`` to entities."""
    reference = r"#(?:[0-9]+|x[0-9a-fA-F]+);|[a-zA-Z][-.a-zA-Z0-9]*;"
    text = F.regexp_replace(text, f"&(?!{reference})", "&amp;")
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
