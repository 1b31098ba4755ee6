"""Markup to rows: the token stream and the node table.

Tokens are cut out by one Java regular expression inside Spark. A Python helper
sees only the token names and answers with the tree numbering; everything else
(attributes, texts, entities) is computed by Column expressions on node rows.
No step shuffles: a page's nodes are derived from its own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import nesting
from sitegraph.functions.entities import attribute_value, complete_references, convert_entities
from sitegraph.functions.once import once
from sitegraph.functions.text import squeeze
from sitegraph.schemas import ATTRS, ROOT_NAME

ENCODING_SLOT = "%ENCODING%"

_ATTR = (
    r"""\s*+([a-zA-Z_][-:.a-zA-Z_0-9]*+)"""
    r"""(\s*+=\s*+('[^']*+'|"[^"]*+"|[\]\[\-a-zA-Z0-9./,:;+*%?!&$()_#=~'"@]*+))?+"""
)
_ATTR_RUN = "(?:" + _ATTR.replace("([", "(?:[").replace(r"(\s", r"(?:\s").replace("('", "(?:'") + ")*+"
_NAME = "[a-zA-Z][-_.:a-zA-Z0-9]*+"
_START = f"<{_NAME}{_ATTR_RUN}[^<>]*+(?:>|(?=<))"
_END = r"</[^<>]*+(?:>|(?=<))"
_TEXT = "(?:[^<]++|<(?![a-zA-Z/!?]))++"
_TOKENS = "|".join(
    [
        r"<!--.*?--\s*+>",            # comment
        r"<!\[CDATA\[.*?(?:\]\]>|\z)",
        r"<![a-zA-Z][^>]*+>",         # declaration
        r"<!(?:>|\[[^>]*+>)",         # empty comment, marked section
        r"<!.*+",                     # bogus or never closed: to the end
        r"<\?[^>]*+>",
        r"<\?.*+",
        _START,
        _END,
        r"<[a-zA-Z/].*+",             # tag never closed
        _TEXT,
    ]
)
_HEADS = [rf"<{_NAME}", r"</[^<>]*+", r"<!--", r"<![a-zA-Z]", r"<!\[CDATA\[", r"<!\[", r"<!>", r"<\?", ""]
# a construct that never closes can only be the last token; it makes no node
_CLOSED = r"(?s)^(?:<!--.*--\s*>|<!\[CDATA\[.*|<!(?:[^-a-zA-Z\[]|$).*|<(?!!--)[^<>]*+(?:\"[^\"]*\"[^<>]*+|'[^']*'[^<>]*+)*+>|<(?!!--).*>|(?!<[a-zA-Z/!?]).*)$"

Massage = Iterable[tuple[str, str]]
# fixed values: slash glued to a tag end, blanks after "<!"
DEFAULT_MASSAGE: Massage = ((r"(<[^<>]*)/>", "$1 />"), (r"<!\s+([^<>]*)>", "<!$1>"))
# characters without which these find nothing: most markup is not looked through
_NEEDED = dict(zip((pattern for pattern, _ in DEFAULT_MASSAGE), ("/>", "<!")))


def massage_markup(html: Column, fixes: Massage = DEFAULT_MASSAGE) -> Column:
    """Regular-expression clean-up before tokens are cut; pass your own list or none."""
    for pattern, replacement in fixes:
        fixed = F.regexp_replace(html, pattern, replacement)
        needed = _NEEDED.get(pattern)
        html = F.when(html.contains(needed), fixed).otherwise(html) if needed else fixed
    return html


def _opening(rules: nesting.Dialect) -> str:
    """Start tag of an element whose content is taken literally."""
    return rf"<({'|'.join(sorted(rules.literal))})(?=[\s/>]){_ATTR_RUN}[^<>]*+>"


def _any_token(rules: nesting.Dialect, group: int = 1) -> str:
    """A token; the name of a literal element is the ``group``-th group."""
    return f"{_opening(rules)}.*?(?=</\\{group}\\s*+>|\\z)|{_TOKENS}" if rules.literal else _TOKENS


def _pieces(html: Column, rules: nesting.Dialect) -> Column:
    return F.regexp_extract_all(html, F.lit(f"(?is){_any_token(rules)}"), F.lit(0))


def _named_pieces(html: Column, rules: nesting.Dialect, names: Iterable[str]) -> Column:
    """The start tags with these names: tokens between them are passed over in the same match and
    make no texts of their own. Texts and end tags are the most of them and asked for first."""
    wanted = rf"<(?:{'|'.join(names)})(?![-_.:a-zA-Z0-9])"
    group = 2 if rules.literal else 1
    tokens = rf"(?:{_TEXT}|{_END}|(?!{wanted})(?:{_any_token(rules)}))*+(\z|(?={wanted})(?:{_any_token(rules, 3)}))"
    return F.array_remove(F.regexp_extract_all(html, F.lit(f"(?is){tokens}"), F.lit(group)), "")


def _heads(tokens: Column, rules: nesting.Dialect) -> Column:
    """What tells a token's kind and name: its first characters. After the name of a literal
    element whose content is empty stands one more."""
    options = list(_HEADS)
    if rules.literal:
        names = "|".join(sorted(rules.literal))
        options[:0] = [rf"<(?:{names})(?=[\s/>])(?={_ATTR_RUN}[^<>]*+>(?!\z))", rf"<(?:{names})[\s/>]"]
    return F.transform(tokens, lambda t: F.regexp_extract(t, f"(?is)^({'|'.join(options)})", 1))


def _token_kind(raw: Column) -> Column:
    closed = raw.rlike(_CLOSED)
    return (
        F.when(raw.rlike("^<[a-zA-Z]"), F.when(raw.rlike(f"(?s)^{_START}"), "start").otherwise("drop"))
        .when(raw.startswith("</"), F.when(raw.rlike(r"^</[^<>]*+(?:>|$)"), "end").otherwise("drop"))
        .when(raw.startswith("<!--"), F.when(closed, "comment").otherwise("drop"))
        .when(raw.startswith("<![CDATA["), F.lit("cdata"))
        .when(raw.rlike(r"^<!(?:>|\[)"), F.lit("drop"))
        .when(raw.rlike("^<![a-zA-Z]"), F.when(raw.endswith(">"), "decl").otherwise("drop"))
        .when(raw.startswith("<?"), F.when(raw.endswith(">"), "pi").otherwise("drop"))
        .otherwise(F.lit("text"))
    )


def tag_name(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, f"^<({_NAME})", 1))


def html_tokens(pages: DataFrame, dialect: str = "html", html: str = "html",
                keep: Iterable[str] = ("page_id",), names: Iterable[str] | None = None) -> DataFrame:
    """Flat token rows: ``pos, kind, name, raw`` per page; no Python involved.

    ``names`` keeps only start tags with these names, before rows are made.
    """
    rules = nesting.DIALECTS[dialect]
    markup = massage_markup(F.col(html))
    if names is not None:
        # a column of its own, so that Spark compiles what takes it apart
        pages = once(pages, {"_named": _named_pieces(markup, rules, names)})
        pieces = F.col("_named")
    else:
        pieces = _pieces(markup, rules)
    if names is None and rules.literal:
        opening = f"(?is)^{_opening(rules)}"

        def split(piece: Column) -> Column:
            tag = F.regexp_extract(piece, opening, 0)
            body = F.substring(piece, F.length(tag) + 1, F.length(piece))
            return F.when((tag != "") & (body != ""), F.array(tag, F.concat(F.lit("\0"), body))) \
                .otherwise(F.array(piece))

        pieces = F.flatten(F.transform(pieces, split))
    rows = pages.select(*keep, F.posexplode_outer(pieces).alias("pos", "piece")).filter("piece IS NOT NULL")
    if names is not None and not rules.literal.intersection(name.lower() for name in names):
        # one that ends otherwise was cut off by the next tag or the end of the page
        return rows.filter(F.col("piece").endswith(">")).select(
            *keep, "pos", F.lit("start").alias("kind"), tag_name(F.col("piece")).alias("name"), F.col("piece").alias("raw"))
    body = F.col("piece").startswith("\0")
    raw = F.when(body, F.expr("substring(piece, 2)")).otherwise(F.col("piece"))
    rows = rows.select(*keep, "pos", F.when(body, "raw").otherwise(_token_kind(F.col("piece"))).alias("kind"),
                       raw.alias("raw"))
    end_name = F.lower(F.trim(F.regexp_extract("raw", r"^</\s*([^<>]*?)\s*>?$", 1)))
    name = F.when(F.col("kind") == "start", tag_name(F.col("raw"))).when(F.col("kind") == "end", end_name)
    return rows.select(*keep, "pos", "kind", F.coalesce(name, F.lit("")).alias("name"), "raw") \
        .filter("kind <> 'drop'")


def node_depth(tokens: DataFrame, void: Iterable[str] = tuple(nesting.HTML.void)) -> DataFrame:
    """Open-element count before each token of balanced markup."""
    from pyspark.sql import Window as W

    opens = (F.col("kind") == "start") & ~F.col("name").isin(*void)
    step = F.when(opens, 1).when(F.col("kind") == "end", -1).otherwise(0)
    before = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return tokens.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)))


def _structure_udf(rules: nesting.Dialect, names: frozenset[str] | None = None) -> Callable[[Column], Column]:
    @F.arrow_udf(nesting.STRUCTURE if names is None else nesting.NAMED_STRUCTURE)
    def structure(heads: pa.Array) -> pa.Array:
        return nesting.structure_batch(heads, rules, names)

    return structure


def attr_pairs(raw: Column, name: Column) -> Column:
    """Ordered attributes of a start tag; one without a value has its name as value."""
    rest = F.regexp_extract(
        F.substring(raw, F.length(name) + 2, F.length(raw)), f"(?s)^{_ATTR_RUN}", 0
    )

    # a lambda computes what it names as often as it uses it, so each step has its own
    def cut(piece: Column) -> Column:
        return F.struct(*[F.regexp_extract(piece, f"(?s)^{_ATTR}", group).alias(part) for group, part in ((1, "key"), (2, "given"), (3, "value"))])

    def unquoted(p: Column) -> Column:
        value = p["value"]
        quoted = value.rlike(r"""(?s)^(?:'.*'|".*")$""") & (F.length(value) > 1)
        bare = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(p["key"].alias("key"), p["given"].alias("given"), bare.alias("value"))

    def pair(p: Column) -> Column:
        value = F.when(p["given"] != "", attribute_value(p["value"])).otherwise(p["key"])
        return F.struct(F.lower(p["key"]).alias("k"), value.alias("v"))

    pieces = F.regexp_extract_all(rest, F.lit(f"(?s){_ATTR}"), F.lit(0))
    pairs = F.transform(F.transform(F.transform(pieces, cut), unquoted), pair)
    # a tag of its name and at most one character more has none: most tags need no pattern
    return F.when(F.length(raw) - F.length(name) <= 2, F.array().cast(ATTRS)).otherwise(pairs)


def attr_value(raw: Column, name: str, key: str) -> Column:
    """One attribute of start tags with this name, as ``attr_map(attr_pairs(...))`` has it.

    Of a tag that has it once, in quotes and without entities, one match tells the value; others are
    read attribute by attribute.
    """
    this, run = rf"\s*+(?i:{key})(?![-:.a-zA-Z_0-9])", _ATTR_RUN.removesuffix(")*+").removeprefix("(?:")
    others = rf"(?:(?!{this}){run})*+"
    plain = rf"""^<.{{{len(name)}}}{others}{this}\s*+=\s*+(['"])([^'"&]++)\1{others}(?!{run})"""
    value = F.try_element_at(F.regexp_extract_all(raw, F.lit(f"(?s){plain}"), F.lit(2)), F.lit(1))
    pairs = F.filter(attr_pairs(raw, F.lit(name)), lambda a: a["k"] == key)
    return F.coalesce(value, F.try_element_at(pairs, F.lit(-1))["v"])


def attr_map(attrs: Column) -> Column:
    """Lookup map; the last of several equal names wins."""
    keys = F.transform(attrs, lambda a: a["k"])
    last = F.filter(attrs, lambda a, i: ~F.array_contains(F.slice(keys, i + 2, F.size(attrs)), a["k"]))
    return F.map_from_entries(F.when(F.size(attrs) < 2, attrs).otherwise(last))


def _charset_slot(attrs: Column) -> Column:
    """``<meta http-equiv content="…charset=x">``: the charset becomes a slot that
    rendering fills with the output encoding."""
    marked = F.exists(attrs, lambda a: (a["k"] == "http-equiv") & (a["v"] != ""))

    def filled(part: Column) -> Column:
        name = F.substring_index(part, "=", 1)
        return F.when((F.trim(name) == "charset") & part.contains("="), F.concat(name, F.lit(f"={ENCODING_SLOT}"))).otherwise(part)

    slot = F.transform(
        attrs,
        lambda a: F.struct(
            a["k"].alias("k"),
            F.when(
                a["k"] == "content",
                F.array_join(F.transform(F.split(a["v"], ";"), filled), ";"),
            ).otherwise(a["v"]).alias("v"),
        ),
    )
    return F.when(marked, slot).otherwise(attrs)


def _inner(raw: Column, head: int, tail: str) -> Column:
    return F.regexp_replace(F.substring(raw, head + 1, 2**31 - 1 - head), tail, "")


def dialect_rules(dialect: str, void: Iterable[str] = ()) -> nesting.Dialect:
    rules = nesting.DIALECTS[dialect]
    return nesting.replace(rules, void=rules.void | frozenset(void)) if void else rules


def placed_tokens(pages: DataFrame, rules: nesting.Dialect, html: str, keep: Iterable[str], massage: Massage,
                  slash_closes: bool, strings: bool, names: Iterable[str] | None = None) -> DataFrame:
    """A row per page with ``z``: its nodes in document order, each its token and its place.

    With ``names`` only the root and elements with these names, with ``pre`` and ``name``
    (null for the root); ``child`` is then null where the only child is an element.
    """
    structure = _structure_udf(rules, None if names is None else frozenset(names))
    source = pages.select(*keep, massage_markup(F.col(html), massage).alias("markup"))
    cut = once(source, {"tokens": _pieces(F.col("markup"), rules)})
    cut = once(cut.select(*keep, "tokens"), {"heads": _heads(F.col("tokens"), rules)})
    last = F.try_element_at("tokens", F.lit(-1))
    open_end = F.coalesce(~last.rlike(_CLOSED), F.lit(False)) & ~last.rlike(f"(?is)^{_opening(rules)}" if rules.literal else r"^\z")
    heads = F.when(open_end, F.slice("heads", F.lit(1), F.size("heads") - 1)).otherwise(F.col("heads"))
    if slash_closes:
        heads = F.zip_with(heads, "tokens", lambda h, t: F.when(
            h.rlike("^<[a-zA-Z]") & t.endswith("/>"), F.concat(h, F.lit("/"))).otherwise(h))
    placed = cut.select(*keep, "tokens", structure(heads).alias("s"))
    fields = ["raw", "post", "depth", "parent_pre", "sib_no", "keep_blank"]
    columns = [
        F.transform("s.token", lambda i: F.get("tokens", i)).alias("token"),
        *[F.col(f"s.{c}").alias(c) for c in fields],
    ]
    if names is not None:
        more = ["pre", "name"]
        columns += [F.col(f"s.{c}").alias(c) for c in more]
        if strings:
            columns.append(F.transform("s.child_token", lambda t, i: F.when(t.isNotNull(), F.struct(
                F.get("tokens", t).alias("token"), F.get("s.child_raw", i).alias("raw"),
                F.get("s.child_keep", i).alias("keep_blank")))).alias("child"))
    elif strings:
        # an only child has the next number, and its parent ends with it
        columns.append(F.transform(
            "s.post", lambda end, i: F.when(end == i + 1, F.struct(
                F.get("tokens", F.get("s.token", end)).alias("token"), F.get("s.raw", end).alias("raw"),
                F.get("s.keep_blank", end).alias("keep_blank")))).alias("child"))
    return placed.select(*keep, F.arrays_zip(*columns).alias("z"))


def node_kind(token: Column, raw: Column) -> Column:
    """The kind of a node from its token; the root has none."""
    tag = token.rlike("^<[a-zA-Z]") & ~raw
    return F.when(token.isNull() | tag, "tag").when(raw, "text").otherwise(_token_kind(token))


def node_attrs(kind: Column, name: Column, token: Column) -> Column:
    pairs = F.when(kind == "tag", F.coalesce(attr_pairs(token, name), F.array().cast(ATTRS)))
    return F.when(name == "meta", _charset_slot(pairs)).otherwise(pairs)


def node_content(rules: nesting.Dialect, entities: str | None, squeeze_blanks: bool,
                 kind: Column, token: Column, raw: Column, keep_blank: Column) -> Column:
    """The text of a string node."""
    body = F.regexp_replace(token, f"(?is)^{_opening(rules)}", "") if rules.literal else token
    text = complete_references(token) if entities is None else convert_entities(token, entities)
    text = F.when(raw, body).otherwise(text)
    if squeeze_blanks:
        text = F.when(keep_blank, text).otherwise(squeeze(text))
    return (
        F.when(kind == "text", text)
        .when(kind == "comment", _inner(token, 4, r"--\s*>$"))
        .when(kind == "cdata", _inner(token, 9, r"\]\]>$"))
        .when(token.startswith("<?xml"), F.lit(f"xml version='1.0' encoding='{ENCODING_SLOT}'"))
        .when(kind.isin("pi", "decl"), _inner(token, 2, ">$"))
    )


def child_kind(child: Column, raw: Column) -> Column:
    """The kind of an element's only child, null where it has none or several."""
    return F.when(raw, "text").when(child.rlike("^<[a-zA-Z]"), "tag").when(child.isNotNull(), _token_kind(child))


def html_nodes(pages: DataFrame, dialect: str = "html", html: str = "html",
               keep: Iterable[str] = ("page_id",), entities: str | None = None,
               massage: Massage = DEFAULT_MASSAGE, void: Iterable[str] = (),
               squeeze_blanks: bool = True, slash_closes: bool = False,
               names: Iterable[str] | None = None, strings: bool = False) -> DataFrame:
    """Node table of tolerant markup, one row per element or string.

    ``names`` keeps only those elements, all strings and the root; attributes of
    others are never computed. ``slash_closes`` treats ``<x/>`` as an element
    without content; by default only void elements are. ``strings`` adds
    ``string``: the text of an element whose only child is a string.
    """
    rules = dialect_rules(dialect, void)
    zipped = placed_tokens(pages, rules, html, keep, massage, slash_closes, strings)
    rows = zipped.select(*keep, F.posexplode_outer("z").alias("pre", "n")).select(*keep, "pre", "n.*")
    place = [*keep, "pre", "post", "depth", "parent_pre", "sib_no"]

    root, token, raw = F.col("token").isNull(), F.col("token"), F.col("raw")
    tag = token.rlike("^<[a-zA-Z]") & ~raw
    kinds = once(rows, {"kind": node_kind(token, raw), "name": F.when(root, ROOT_NAME).when(tag, tag_name(token))})
    if names is not None:
        kinds = kinds.filter((F.col("kind") != "tag") | F.col("name").isin(*names, ROOT_NAME))

    def content(*of: Column) -> Column:
        return node_content(rules, entities, squeeze_blanks, *of)

    kind = F.col("kind")
    extra = []
    if strings:
        child, child_raw = F.col("child.token"), F.col("child.raw")
        extra = [F.when(kind == "tag", content(child_kind(child, child_raw), child, child_raw, F.col("child.keep_blank"))).alias("string")]
    nodes = once(kinds, {"attrs": node_attrs(kind, F.col("name"), token)})
    nodes = nodes.select(*place, "kind", "name", "attrs", attr_map(F.col("attrs")).alias("attr"),
                         content(kind, token, F.col("raw"), F.col("keep_blank")).alias("text"), *extra)
    if rules.child_attributes:
        return soap_attributes(nodes)
    return nodes


def soap_attributes(nodes: DataFrame) -> DataFrame:
    """An element with exactly one string child is also an attribute of its parent,
    unless the parent has that attribute; the first such child counts."""
    children = (
        nodes.filter("parent_pre IS NOT NULL")
        .groupBy("page_id", F.col("parent_pre").alias("pre"))
        .agg(F.count("*").alias("n"), F.max("text").alias("only"),
             F.max((F.col("kind") != "tag").cast("int")).alias("is_text"))
        .filter("n = 1 AND is_text = 1")
    )
    lifted = (
        nodes.filter("kind = 'tag' AND pre > 0").select("page_id", "pre", "parent_pre", "name")
        .join(children.select("page_id", "pre", "only"), ["page_id", "pre"])
        .groupBy("page_id", F.col("parent_pre").alias("pre"), "name")
        .agg(F.min_by("only", "pre").alias("v"), F.min("pre").alias("at"))
        .groupBy("page_id", "pre")
        .agg(F.array_sort(F.collect_list(F.struct("at", F.col("name").alias("k"), "v"))).alias("lifted"))
    )
    new = F.filter("lifted", lambda c: ~F.exists("attrs", lambda a: a["k"] == c["k"]))
    joined = nodes.join(lifted, ["page_id", "pre"], "left").withColumn(
        "attrs",
        F.when(F.col("lifted").isNull(), F.col("attrs")).otherwise(
            F.concat("attrs", F.transform(new, lambda c: F.struct(c["k"].alias("k"), c["v"].alias("v"))))
        ),
    )
    return joined.withColumn("attr", F.when(F.col("kind") == "tag", attr_map(F.col("attrs")))).select(*nodes.columns)
