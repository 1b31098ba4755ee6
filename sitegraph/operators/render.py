"""Node rows back to markup: every node yields an opening and a closing piece, and
a page's pieces are joined in document order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions.entities import escape_entities
from sitegraph.functions.once import once
from sitegraph.functions.text import strip
from sitegraph.operators.html_nodes import ENCODING_SLOT
from sitegraph.functions.nesting import HTML
from sitegraph.operators.tree import PAGE

VOID = tuple(sorted(HTML.void))


def render_special(kind: Column, text: Column) -> Column:
    """Strings with the wrapper of their kind."""
    return (
        F.when(kind == "comment", F.concat(F.lit("<!--"), text, F.lit("-->")))
        .when(kind == "cdata", F.concat(F.lit("<![CDATA["), text, F.lit("]]>")))
        .when(kind == "pi", F.concat(F.lit("<?"), text, F.lit("?>")))
        .when(kind == "decl", F.concat(F.lit("<!"), text, F.lit(">")))
        .otherwise(text)
    )


def _attributes(attrs: Column, encoding: str) -> Column:
    def one(a: Column) -> Column:
        value = F.replace(a["v"], F.lit(ENCODING_SLOT), F.lit(encoding))
        single = value.contains('"')
        value = F.when(single, F.replace(value, F.lit("'"), F.lit("&squot;"))).otherwise(value)
        quote = F.when(single, F.lit("'")).otherwise(F.lit('"'))
        return F.concat(F.lit(" "), a["k"], F.lit("="), quote, escape_entities(value), quote)

    return F.array_join(F.transform(attrs, one), "")


def _tags(row: Callable[[str], Column], void: tuple[str, ...], encoding: str) -> tuple[Column, Column]:
    name, is_void = row("name"), row("name").isin(*void) if void else F.lit(False)
    start = F.concat(F.lit("<"), name, _attributes(row("attrs"), encoding),
                     F.when(is_void, F.lit(" />")).otherwise(F.lit(">")))
    end = F.when(~is_void, F.concat(F.lit("</"), name, F.lit(">")))
    return start, end


def _pieces_of(row: Callable[[str], Column], void: tuple[str, ...], encoding: str, pretty: bool) -> Column:
    """The pieces of one node. ``a, b, c`` order them: an opening by ``pre``; a closing
    after the last descendant, inner elements first."""
    start, end = _tags(row, void, encoding)
    tag = (row("kind") == "tag") & (row("pre") > 0)
    text = F.replace(render_special(row("kind"), row("text")), F.lit(ENCODING_SLOT), F.lit(encoding))
    if pretty:
        text = strip(text)
    opening = F.struct(row("pre").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"),
                       row("depth").alias("depth"), F.when(tag, start).otherwise(text).alias("piece"))
    closing = F.struct(row("post").alias("a"), F.lit(1).alias("b"), (-row("depth")).alias("c"),
                       row("depth").alias("depth"), F.when(tag, end).alias("piece"))
    return F.filter(F.array(opening, closing), lambda p: F.coalesce(p["piece"], F.lit("")) != "")


def _pieces(nodes: DataFrame, void: tuple[str, ...], encoding: str, pretty: bool) -> DataFrame:
    return nodes.filter("pre > 0").select(PAGE, F.explode(_pieces_of(F.col, void, encoding, pretty)).alias("p"))


def render_pages(trees: DataFrame, void: tuple[str, ...] = VOID, encoding: str = "utf-8", pretty: bool = False) -> DataFrame:
    """The same as ``render``, or ``prettify``, of pages whose ``nodes`` are an array in their row
    (``page_tree.page_nodes``): no exchange. All columns but ``nodes`` stay."""
    keep = [c for c in trees.columns if c != "nodes"]
    inner = F.filter("nodes", lambda n: n["pre"] > 0)
    pieces = F.array_sort(F.flatten(F.transform(inner, lambda n: _pieces_of(lambda c: n[c], void, encoding, pretty))))
    if not pretty:
        return trees.select(*keep, F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("html"))
    top = F.element_at(F.filter(inner, lambda n: n["parent_pre"] == 0), -1)
    rows = once(trees, {"_p": pieces, "_t": F.when(F.exists("nodes", lambda n: n["parent_pre"] == 0), top)})
    lines = F.array_join(F.transform("_p", lambda p: F.concat(F.repeat(F.lit(" "), p["depth"] - 1), p["piece"])), "\n")
    closes = (F.col("_t.kind") == "tag") & ~F.col("_t.name").isin(*void)
    html = F.when(F.size("_p") == 0, "").otherwise(F.concat(lines, F.when(closes, F.lit("")).otherwise(F.lit("\n"))))
    return rows.select(*keep, html.alias("html"))


def render(nodes: DataFrame, void: tuple[str, ...] = VOID, encoding: str = "utf-8") -> DataFrame:
    """Markup of each page: ``page_id, html``."""
    joined = _pieces(nodes, void, encoding, False).groupBy(PAGE).agg(
        F.array_sort(F.collect_list("p")).alias("p"))
    html = joined.select(PAGE, F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("html"))
    return nodes.filter("pre = 0").select(PAGE).join(html, PAGE, "left").select(
        PAGE, F.coalesce("html", F.lit("")).alias("html"))


def prettify(nodes: DataFrame, void: tuple[str, ...] = VOID, encoding: str = "utf-8") -> DataFrame:
    """One tag or string per line, indented by depth; blank strings vanish."""
    joined = _pieces(nodes, void, encoding, True).groupBy(PAGE).agg(
        F.array_sort(F.collect_list("p")).alias("p"))
    lines = F.transform("p", lambda p: F.concat(F.repeat(F.lit(" "), p["depth"] - 1), p["piece"]))
    # a page that ends in a closing tag has no final line feed
    tail = nodes.filter("parent_pre = 0").groupBy(PAGE).agg(
        F.max_by(F.struct("kind", "name"), "pre").alias("t"))
    closes = (F.col("t.kind") == "tag") & ~F.col("t.name").isin(*void)
    body = F.concat(F.array_join(lines, "\n"), F.when(closes, F.lit("")).otherwise(F.lit("\n")))
    return nodes.filter("pre = 0").select(PAGE).join(
        joined.join(tail, PAGE, "left").select(PAGE, body.alias("html")), PAGE, "left"
    ).select(PAGE, F.coalesce("html", F.lit("")).alias("html"))


def encode_markup(html: Column, encoding: str = "utf-8") -> Column:
    """Rendered text as bytes."""
    return F.encode(html, encoding)
