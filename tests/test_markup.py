"""Tolerant parsing: structure rules, texts, attributes, dialects."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from sitegraph.functions import nesting
from sitegraph.functions.entities import convert_entities, escape_entities
from sitegraph.operators import edit as E
from sitegraph.operators import tree as T
from sitegraph.operators.html_nodes import html_nodes, html_tokens, massage_markup
from sitegraph.operators.render import prettify, render
from sitegraph.operators.select import sel


def outline(nodes):
    """``parent>name`` or text per node, by page."""
    pages = {}
    for r in nodes.orderBy("page_id", "pre").collect():
        pages.setdefault(r.page_id, []).append(r)
    out = []
    for rows in pages.values():
        names = {r.pre: r.name for r in rows}
        out.append([f"{names[r.parent_pre]}>{r.name or r.text}" for r in rows if r.pre])
    return out


CASES = {
    "<p>Para1<p>Para2": "[document]>p p>Para1 [document]>p p>Para2",
    "<blockquote>Bob<blockquote>Blah": "[document]>blockquote blockquote>Bob blockquote>blockquote blockquote>Blah",
    "<table><tr>Blah<tr>Bla": "[document]>table table>tr tr>Blah table>tr tr>Bla",
    "<tr>Blah<table><tr>Bla": "[document]>tr tr>Blah tr>table table>tr tr>Bla",
    "<b>Foo<b>Bar</b></b>": "[document]>b b>Foo [document]>b b>Bar",
    "<br/>x<! --Comment-->": "[document]>br [document]>x [document]>Comment",
    '<script>var t="</p>";</script>': '[document]>script script>var t="</p>";',
    "<p><b>x<br><p>y": "[document]>p p>b b>x b>br [document]>p p>y",
    "<ul><li>1<li>2<ul><li>3</ul><li>4</ul>": "[document]>ul ul>li li>1 ul>li li>2 li>ul ul>li li>3 ul>li li>4",
    "<li>a<li>b": "[document]>li li>a li>li li>b",
    "<p>a<table><td>b<p>c": "[document]>p p>a p>table table>td td>b td>p p>c",
    "<nav>a<nav>b</nav>c": "[document]>nav nav>a [document]>nav nav>b [document]>c",
    "<i>a</b>c</i>": "[document]>i i>a i>c",
    "<div><div>x</div></div>": "[document]>div div>div div>x",
    "<textarea><b>x</b></textarea>z": "[document]>textarea textarea><b>x</b> [document]>z",
    "<script src=x></script>z": "[document]>script [document]>z",
    "<SCRIPT>a</Script >z": "[document]>script script>a [document]>z",
    "a < b": "[document]>a < b",
    "x<a href='y'": "[document]>x",
    "x<!-- y": "[document]>x",
    "<![CDATA[a<b]]>c": "[document]>a<b [document]>c",
}


def test_structure(page):
    for markup, want, have in zip(CASES, CASES.values(), outline(html_nodes(page(*CASES)))):
        assert " ".join(have) == want, markup


def test_declaration_that_never_parses_is_text(page):
    assert outline(html_nodes(page("<p>a<!9 <p>b"), massage=())) == [["[document]>p", "p>a", "p><!9 <p>b"]]


def test_intervals(page):
    nodes = html_nodes(page(*CASES)).collect()
    at = {(r.page_id, r.pre): r for r in nodes}
    for r in nodes:
        assert r.pre <= r.post
        if r.pre:
            parent = at[r.page_id, r.parent_pre]
            assert parent.pre < r.pre and r.post <= parent.post and r.depth == parent.depth + 1


def test_dialects(page):
    xml = html_nodes(page("<foo><bar></foo>", "<br>x", "<foo><foo>x"), dialect="xml")
    assert outline(xml) == [["[document]>foo", "foo>bar"], ["[document]>br", "br>x"],
                            ["[document]>foo", "[document]>foo", "foo>x"]]
    nested = html_nodes(page("<b>Foo<b>Bar</b></b>"), dialect="nestable_inline")
    assert outline(nested) == [["[document]>b", "b>Foo", "b>b", "b>Bar"]]
    minimal = html_nodes(page("<div><div>x"), dialect="minimal")
    assert outline(minimal) == [["[document]>div", "[document]>div", "div>x"]]
    soap = html_nodes(page("<foo><bar>baz</bar><bar>2</bar></foo>"), dialect="soap")
    assert soap.filter("name = 'foo'").first().attr == {"bar": "baz"}
    void = html_nodes(page("<a><x>1</a>"), dialect="xml", void=["x"])
    assert outline(void) == [["[document]>a", "a>x", "a>1"]]


def test_slash_closes_only_on_request(page):
    assert outline(html_nodes(page("<x/>a"))) == [["[document]>x", "x>a"]]
    assert outline(html_nodes(page("<x/>a"), slash_closes=True)) == [["[document]>x", "[document]>a"]]


def test_attributes(page):
    markup = """<a HREF=x Title='q"' CHECKED n="&lt;&#65;&#20013;&nbsp;" x=1 x=2 y = "a > b">t</a>"""
    row = html_nodes(page(markup)).filter("name = 'a'").first()
    assert [(a.k, a.v) for a in row.attrs] == [
        ("href", "x"), ("title", 'q"'), ("checked", "CHECKED"), ("n", "<A中&nbsp;"), ("x", "1"), ("x", "2"), ("y", "a > b")]
    assert row.attr["x"] == "2"


def test_texts(page):
    rows = html_nodes(page("<p>AT&T x &copy y &amp;</p> \n <p> \t </p><pre>  </pre>")).filter("kind = 'text'").orderBy("pre")
    assert [r.text for r in rows.collect()] == ["AT&T; x &copy; y &amp;", "\n", " ", "  "]
    kinds = html_nodes(page("<?xml version='1'?><!DOCTYPE html><!--c--><?php x?>")).filter("pre > 0").orderBy("pre")
    assert [(r.kind, r.text) for r in kinds.collect()] == [
        ("pi", "xml version='1.0' encoding='%ENCODING%'"), ("decl", "DOCTYPE html"), ("comment", "c"), ("pi", "php x?")]


def test_charset_slot_is_filled_on_output(page):
    nodes = html_nodes(page('<meta http-equiv="Content-Type" content="text/html; charset=gb2312">'))
    assert render(nodes, encoding="utf-8").first().html == \
        '<meta http-equiv="Content-Type" content="text/html; charset=utf-8" />'


def test_entities(spark):
    def conv(text, mode):
        return spark.range(1).select(convert_entities(F.lit(text), mode).alias("x")).first().x

    text = "&lt;&eacute;&apos;&bogus;&#233;&#x4e2d;& &amp;lt;"
    assert conv(text, "xml") == "<&eacute;'&bogus;é中& &lt;"
    assert conv(text, "html") == "<é&apos;&amp;bogus;é中& &lt;"
    assert conv(text, "xhtml") == "<é'&bogus;é中& &lt;"
    assert conv(text, None) == "&lt;&eacute;&apos;&bogus;é中& &amp;lt;"
    out = spark.range(1).select(escape_entities(F.lit("a & b &amp; <c> &#12; &x")).alias("x")).first().x
    assert out == "a &amp; b &amp; &lt;c&gt; &#12; &amp;x"


def test_massage(spark):
    fixed = massage_markup(F.lit("<br/><! x><b>"))
    own = massage_markup(F.lit("aXb"), [("X", "-")])
    assert tuple(spark.range(1).select(fixed, own).first()) == ("<br /><!x><b>", "a-b")


def test_find_and_navigate(page):
    nodes = html_nodes(page("<div id=a class='x y'><p>1</p><p class=y>2<b>3</b></p></div><div>4</div>")).cache()

    def pres(df):
        return [r.pre for r in df.orderBy("ctx_pre", "pre").collect()]

    div = nodes.filter("name = 'div'")
    assert pres(T.find_all(nodes, sel("p"), div)) == [2, 4]
    assert pres(T.find_all(nodes, sel("p"), div, limit=1)) == [2]
    assert pres(T.find(nodes, sel("p"), div)) == [2, None]
    assert [r.pre for r in nodes.filter(sel("div", "x").on()).collect()] == [1]
    assert [r.pre for r in nodes.filter(sel(class_=None).on()).orderBy("pre").collect()] == [0, 2, 6, 8]
    assert pres(T.find_text(nodes, re.compile("[24]"))) == [5, 9]
    texts = {r.ctx_pre: r.text for r in T.node_text(nodes, div, "|").collect()}
    assert texts == {1: "1|2|3", 8: "4"}
    strings = {r.pre: r.string for r in T.node_string(nodes).collect()}
    assert strings[2] == "1" and strings[4] is None and strings[6] == "3"


def test_render_and_edit(page):
    markup = "<p class='a\"b'>x<br/>&amp; < y</p><!--c-->"
    nodes = html_nodes(page(markup))
    assert render(nodes).first().html == "<p class='a\"b'>x<br />&amp; < y</p><!--c-->"
    assert render(html_nodes(page("<div><p><!-- c --></p></div>\n<b>1<i>2</i></b>"))).first().html == \
        "<div><p><!-- c --></p></div>\n<b>1<i>2</i></b>"
    pretty = prettify(html_nodes(page("<div><p>x</p> <b>1<i>2</i></b></div>"))).first().html
    assert pretty == "<div>\n <p>\n  x\n </p>\n <b>\n  1\n  <i>\n   2\n  </i>\n </b>\n</div>"
    base = html_nodes(page("<div><b>1<b2>2</b2></b><i></i>t</div>"))
    assert render(E.unwrap(base, sel(["b", "b2"]))).first().html == "<div>12<i></i>t</div>"
    assert render(E.set_string(base, sel("i"), "new")).first().html == "<div><b>1<b2>2</b2></b><i>new</i>t</div>"
    assert render(E.replace_nodes(base, sel("b"), "X")).first().html == "<div>X<i></i>t</div>"
    only = E.parse_only(html_nodes(page("<div>a<p>1<b>2</b></p></div><p>3</p>")), sel("p"))
    assert render(only).first().html == "<p>1<b>2</b></p><p>3</p>"
    twice = E.attr_set(html_nodes(page("<a x=1 x=2>t</a>")), sel("a"), "x", "3")
    assert render(twice).first().html == '<a x="3" x="3">t</a>'
    assert render(E.attr_delete(twice, sel("a"), "x")).first().html == "<a>t</a>"


def test_tokens(page):
    rows = html_tokens(page("a<b x=1>c</b><!--d--><script>1<2</script>")).orderBy("pos").collect()
    assert [(r.kind, r.name, r.raw) for r in rows] == [
        ("text", "", "a"), ("start", "b", "<b x=1>"), ("text", "", "c"), ("end", "b", "</b>"), ("comment", "", "<!--d-->"),
        ("start", "script", "<script>"), ("raw", "", "1<2"), ("end", "script", "</script>")]


TAGS = st.sampled_from(["p", "b", "div", "li", "ul", "table", "tr", "td", "span", "br", "nav"])
PIECE = st.one_of(TAGS.map(lambda t: f"<{t}>"), TAGS.map(lambda t: f"</{t}>"), st.sampled_from(["x", "y z", "&amp;", "<!--c-->"]))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECE, max_size=25).map("".join), min_size=5, max_size=25))
def test_rendered_pages_parse_to_the_same_nodes(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id BIGINT, html STRING")
    nodes = html_nodes(df)
    again = html_nodes(render(nodes).select("page_id", "html"))
    shape = ["page_id", "pre", "post", "depth", "parent_pre", "sib_no", "kind", "name"]

    def rows(n):
        return sorted(map(str, n.select(*shape).collect()))

    assert nodes.count() >= len(pages)
    assert rows(html_nodes(render(again).select("page_id", "html"))) == rows(again)


def brute_structure(heads, rules):
    """The nesting rules as a plain walk up the stack."""
    stack, parents, names = [0], {0: None}, {0: ""}
    for head in heads:
        if head.startswith("</"):
            at = [i for i in range(1, len(stack)) if names[stack[i]] == head[2:]]
            if at:
                del stack[at[-1]:]
            continue
        name = head[1:] if head else None
        if name and name not in rules.void:
            triggers = rules.nestable.get(name)
            for i in range(len(stack) - 1, 0, -1):
                open_name = names[stack[i]]
                if open_name == name and triggers is None:
                    del stack[i:]
                    break
                if (open_name in triggers) if triggers is not None else (name in rules.reset and open_name in rules.reset):
                    del stack[i + 1:]
                    break
        pre = len(parents)
        parents[pre], names[pre] = stack[-1], name
        if name and name not in rules.void:
            stack.append(pre)
    return parents


@given(st.lists(st.one_of(TAGS.map(lambda t: f"<{t}"), TAGS.map(lambda t: f"</{t}"), st.just("")), max_size=60),
       st.sampled_from(["html", "nestable_inline", "minimal", "xml"]))
def test_structure_against_a_plain_walk(heads, dialect):
    rules = nesting.DIALECTS[dialect]
    rows = nesting.assign_structure(heads, rules)
    assert {pre: r[4] for pre, r in enumerate(rows)} == brute_structure(heads, rules)


@pytest.mark.parametrize("deep", [3000])
def test_deep_and_long_pages(page, deep):
    nodes = html_nodes(page("<div>" * deep + "x" * 100_000 + "a<b" * 10 + ">" + "&amp;" * 5000))
    assert nodes.agg(F.max("depth")).first()[0] > deep
