"""Page-local tree queries against those on the node table, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from sitegraph.catalog import all_queries
from sitegraph.operators import page_tree as P
from sitegraph.operators import tree as T
from sitegraph.operators.html_nodes import html_nodes
from sitegraph.operators.render import prettify, render, render_pages
from sitegraph.operators.select import ANY, sel

MARKUP = [
    "<html><body class=x><p>a <b>b</b> c<p>d<ul><li>1<li id=k class='x y'>2<ul><li>3</ul></ul></body>",
    "", "plain text only", "<b><b><i></b>x</i><!-- note --><br><br/>tail &amp; &lt;more", None, "<![CDATA[x]]><?pi?><!doctype html><p", "<script>var a='<p>';</script><p>after",
    "<table><tr><td>1<td>2<tr><td>3</table><div><div></div><div><p>x</div></div>",
]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<br>", "x", " ", "\n", "<div class='q r' id=3>", "</div>", "<i a=1 a=2>", "</i>", "&copy;", "<!--c-->", "<pre> ", "</pre>"]
    more = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(MARKUP + more)), "page_id BIGINT, html STRING").repartition(4)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_nodes_are_those_of_the_table(spark, pages):
    fields = ["page_id", "pre", "post", "depth", "parent_pre", "sib_no", "kind", "name", "attrs", "attr", "text", "string"]
    got = P.page_nodes(pages, strings=True).select("page_id", F.inline("nodes"))
    assert rows(got, *fields) == rows(html_nodes(pages, strings=True), *fields)


MATCH = [sel("b"), sel(["li", "p", "div"]), ANY, sel(class_=True), sel("div", "r")]
CONTEXT = [sel(["p", "ul", "div", "b"]), ANY]


@pytest.mark.parametrize("match,context", [(0, 0), (1, 1), (3, 0), (4, 1)])
def test_navigation(spark, pages, match, context):
    match, context = MATCH[match], CONTEXT[context]
    nodes, trees = html_nodes(pages).persist(), P.page_nodes(pages).persist()
    ctx = nodes.filter(context.on())
    for name in ("find_all", "next_elements", "previous_elements", "next_siblings", "previous_siblings"):
        for limit in (None, 2):
            want = T.find_all(nodes, match, ctx, limit) if name == "find_all" else getattr(T, name)(nodes, ctx, match, limit)
            assert rows(getattr(P, name)(trees, match, context, limit), "page_id", "ctx_pre", "pre") == rows(want, "page_id", "ctx_pre", "pre"), (name, limit)
    for name in ("find", "next_element", "previous_element", "next_sibling", "previous_sibling"):
        want = T.find(nodes, match, ctx) if name == "find" else getattr(T, name)(nodes, ctx, match)
        assert rows(getattr(P, name)(trees, match, context), "page_id", "ctx_pre", "pre") == rows(want, "page_id", "ctx_pre", "pre"), name
    assert rows(P.nth_match(trees, match, context, 1), "page_id", "ctx_pre", "pre") == rows(T.nth_match(nodes, ctx, match, 1), "page_id", "ctx_pre", "pre")
    nodes.unpersist(), trees.unpersist()


def test_text_and_markup(spark, pages):
    nodes, trees = html_nodes(pages).persist(), P.page_nodes(pages).persist()
    want = rows(T.node_text(nodes, nodes.filter(ANY.on()), "|"), "page_id", "ctx_pre", "text")
    assert rows(P.node_text(trees, ANY, "|"), "page_id", "ctx_pre", "text") == want
    assert rows(render_pages(trees), "page_id", "html") == rows(render(nodes), "page_id", "html")
    assert rows(render_pages(trees, pretty=True), "page_id", "html") == rows(prettify(nodes), "page_id", "html")
    nodes.unpersist(), trees.unpersist()


def test_equal_subtrees_have_equal_digests(spark, pages):
    """The same classes as digests made from all nodes of each subtree."""
    nodes, trees = html_nodes(pages).persist(), P.page_nodes(pages).persist()
    old = {(r.page_id, r.ctx_pre): r.fingerprint for r in T.subtree_fingerprint(nodes, nodes.filter(ANY.on())).collect()}
    new = {(r.page_id, r.ctx_pre): r.fingerprint for r in P.subtree_fingerprint(trees, ANY).collect()}
    assert set(old) == set(new) and len(set(zip(old.values(), (new[k] for k in old)))) == len(set(old.values())) == len(set(new.values()))
    nodes.unpersist(), trees.unpersist()


def test_deep_pages(spark):
    """A page of 30,000 nested elements: work is linear."""
    deep = spark.createDataFrame([(1, "<div>" * 30000 + "x")], "page_id BIGINT, html STRING")
    trees = P.page_nodes(deep, attributes=False)
    assert P.find(trees, sel("div"), sel("div")).filter("pre IS NULL").count() == 1
    assert P.next_element(trees, sel("b"), sel("div")).filter("pre IS NULL").count() == 30000


@pytest.mark.parametrize("name", ["find_all", "find", "next_elements", "next_element", "previous_element", "next_siblings", "previous_sibling",
                                  "node_text", "nth_child", "render", "prettify", "mine_pages", "mine", "field_errors", "scoped_links"])
def test_no_exchange_in_page_queries(spark, tmp_path, name):
    """Pages in as many files as there are cores: nothing but narrow steps."""
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").repartition(8).write.parquet(str(tmp_path / "pages.parquet"))
    plan = all_queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_nodes_asked_for_by_name(spark, pages):
    # other nodes do not leave the helper that places them, and the rest is as in the whole page
    names = {"b", "li", "script", "pre", "ul"}
    fields = ["page_id", "pre", "post", "depth", "parent_pre", "sib_no", "kind", "name", "attrs", "attr", "string"]
    got = P.page_nodes(pages, strings=True, texts=False, names=names).select("page_id", F.inline("nodes"))
    every = P.page_nodes(pages, strings=True).select("page_id", F.inline("nodes"))
    assert rows(got, *fields) == rows(every.filter((F.col("pre") == 0) | F.col("name").isin(*names)), *fields)


def test_equal_heads_are_read_once(monkeypatch):
    import pyarrow as pa

    from sitegraph.functions import nesting

    heads = [["<ul", "<li", "", "</li"] * 50, None, [], ["<li", ""]]
    want = [nesting.assign_structure(h or [], nesting.HTML) for h in heads]
    read, seen = nesting._read, []
    monkeypatch.setattr(nesting, "_read", lambda h, rules: seen.append(h) or read(h, rules))
    got = nesting.structure_batch(pa.array(heads, pa.list_(pa.string())), nesting.HTML).to_pylist()
    assert [list(map(list, zip(*page.values(), strict=True))) for page in got] == want
    assert sorted(seen) == ["", "</li", "<li", "<ul"]
    few = nesting.structure_batch(pa.array(heads, pa.list_(pa.string())), nesting.HTML, {"ul"}).to_pylist()
    assert [len(page["pre"]) for page in few] == [51, 1, 1, 1]
