"""Queries: tree navigation and selection."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sitegraph.catalog import query
from sitegraph.catalog.tables import nodes, saved_nodes, trees, with_nodes
from sitegraph.operators import page_tree as P
from sitegraph.operators import tree as T
from sitegraph.operators.select import ANY, attr_get, attr_has, sel
from sitegraph.session import cut_lineage, run_folder


def _hits(found):
    return found.select("page_id", F.col("ctx_pre").cast("bigint"), F.col("pre").cast("bigint"))


def _of(n, *names):
    return n.filter(F.col("name").isin(*names))


def _pairs(where: str, ctx: str) -> str:
    return with_nodes(f"""SELECT c.page_id, c.pre AS ctx_pre, d.pre FROM nodes c JOIN nodes d
      ON d.page_id = c.page_id AND {where} WHERE c.name IN ({ctx})""")


def _one(where: str, ctx: str, pick: str = "min") -> str:
    return with_nodes(f"""SELECT c.page_id, c.pre AS ctx_pre, {pick}(d.pre) AS pre FROM nodes c LEFT JOIN nodes d
      ON d.page_id = c.page_id AND {where} WHERE c.name IN ({ctx}) GROUP BY ALL""")


_BELOW = "d.pre > c.pre AND d.pre <= c.post"


@query("find_all", _pairs(f"{_BELOW} AND d.name IN ('a', 'b', 'br')", "'body', 'article', 'ul', 'li', 'p', 'b'"))
def _find_all(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.find_all(t, sel(["a", "b", "br"]), sel(["body", "article", "ul", "li", "p", "b"])))


@query("find_all_limit", with_nodes("""
    SELECT page_id, CAST(0 AS BIGINT) AS ctx_pre, pre FROM nodes WHERE name = 'p'
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pre) <= 3"""))
def _find_all_limit(spark, sf):
    return _hits(T.find_all(nodes(spark, sf), sel("p"), limit=3))


@query("find", _one(f"{_BELOW} AND d.name = 'b'", "'p', 'article', 'ul'"))
def _find(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.find(t, sel("b"), sel(["p", "article", "ul"])))


@query("find_children", _pairs("d.parent_pre = c.pre AND d.kind = 'tag'", "'article', 'ul', 'p', 'head'"))
def _find_children(spark, sf):
    n = saved_nodes(spark, sf)
    return _hits(T.find_children(n, _of(n, "article", "ul", "p", "head"), sel(True)))


@query("find_text", with_nodes("""
    SELECT page_id, pre, kind FROM nodes WHERE kind <> 'tag' AND text <> '' AND regexp_matches(text, 'tion|track')"""))
def _find_text(spark, sf):
    return T.find_text(nodes(spark, sf), re.compile("tion|track")).select("page_id", F.col("pre").cast("bigint"), "kind")


@query("next_elements", _pairs("d.pre > c.pre AND d.name = 'p'", "'h1', 'p'"))
def _next_elements(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.next_elements(t, sel("p"), sel(["h1", "p"])))


@query("next_element", _one("d.pre > c.pre AND d.name = 'b'", "'h1', 'p'"))
def _next_element(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.next_element(t, sel("b"), sel(["h1", "p"])))


@query("previous_elements", _pairs("d.pre < c.pre AND d.name IN ('li', 'body')", "'footer', 'h1', 'a'"))
def _previous_elements(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.previous_elements(t, sel(["li", "body"]), sel(["footer", "h1", "a"])))


@query("previous_element", _one("d.pre < c.pre AND d.name = 'div'", "'footer', 'h1', 'a'", "max"))
def _previous_element(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.previous_element(t, sel("div"), sel(["footer", "h1", "a"])))


_SAME = "d.parent_pre = c.parent_pre"


@query("next_siblings", _pairs(f"{_SAME} AND d.pre > c.pre AND d.kind = 'tag'", "'li', 'title', 'p'"))
def _next_siblings(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.next_siblings(t, sel(True), sel(["li", "title", "p"])))


@query("next_sibling", _one(f"{_SAME} AND d.pre > c.pre AND d.kind = 'tag'", "'li', 'title', 'p'"))
def _next_sibling(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.next_sibling(t, sel(True), sel(["li", "title", "p"])))


@query("previous_siblings", _pairs(f"{_SAME} AND d.pre < c.pre AND d.name = 'li'", "'li'"))
def _previous_siblings(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.previous_siblings(t, sel("li"), sel(["li"])))


@query("previous_sibling", _one(f"{_SAME} AND d.pre < c.pre AND d.kind = 'tag'", "'li', 'article', 'br'", "max"))
def _previous_sibling(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.previous_sibling(t, ANY, sel(["li", "article", "br"])))


_ABOVE = "d.pre < c.pre AND d.post >= c.pre"


@query("parents", _pairs(f"{_ABOVE} AND d.kind = 'tag'", "'a', 'b', 'br'"))
def _parents(spark, sf):
    n = saved_nodes(spark, sf)
    return _hits(T.parents(n, _of(n, "a", "b", "br"), sel(True)))


@query("parent", _one(f"{_ABOVE} AND d.name IN ('ul', 'article', 'html')", "'a', 'b', 'br', 'title'", "max"))
def _parent(spark, sf):
    n = saved_nodes(spark, sf)
    return _hits(T.parent(n, _of(n, "a", "b", "br", "title"), sel(["ul", "article", "html"])))


@query("neighbours", with_nodes("""
    SELECT page_id, pre, lead(pre) OVER pg AS next_pre, lag(pre) OVER pg AS previous_pre,
           lead(pre) OVER fam AS next_sibling_pre, lag(pre) OVER fam AS previous_sibling_pre FROM nodes
    WINDOW pg AS (PARTITION BY page_id ORDER BY pre), fam AS (PARTITION BY page_id, parent_pre ORDER BY pre)"""))
def _neighbours(spark, sf):
    names = ("pre", "next_pre", "previous_pre", "next_sibling_pre", "previous_sibling_pre")
    return T.neighbours(nodes(spark, sf)).select("page_id", *[F.col(c).cast("bigint") for c in names])


def _selected(n, selector):
    return n.filter(selector.on()).select("page_id", F.col("pre").cast("bigint"))


def _where(condition: str) -> str:
    return with_nodes(f"SELECT page_id, pre FROM nodes WHERE {condition}")


@query("select_by_name", _where("name IN ('p', 'li') OR regexp_matches(name, '^h')"))
def _select_by_name(spark, sf):
    n = nodes(spark, sf)
    both = sel(re.compile("^h")).on() | sel({"p": 1, "li": 1}).on()
    return n.filter(both).select("page_id", F.col("pre").cast("bigint"))


@query("select_by_attribute", _where(
    "kind = 'tag' AND ((attr_k = 'class' AND attr_v = 'ad') OR (attr_k = 'href' AND regexp_matches(attr_v, 'th')) OR (name = 'div' AND attr_k <> 'href'))"))
def _select_by_attribute(spark, sf):
    n = nodes(spark, sf)
    any_of = sel(class_="ad").on() | sel(href=re.compile("th")).on() | sel("div", href=None, class_=True).on()
    return n.filter(any_of).select("page_id", F.col("pre").cast("bigint"))


@query("select_by_css_class", _where("kind = 'tag' AND attr_k = 'class' AND attr_v = 'ad'"))
def _select_by_css_class(spark, sf):
    return _selected(nodes(spark, sf), sel("div", "ad"))


@query("select_by_callable", _where("name = 'a' AND length(attr_v) > 6"))
def _select_by_callable(spark, sf):
    return _selected(nodes(spark, sf), sel("a", href=lambda v: F.length(v) > 6))


@query("attr_get", with_nodes("""
    SELECT page_id, pre, CASE WHEN attr_k = 'href' THEN attr_v ELSE 'none' END AS href FROM nodes WHERE kind = 'tag'"""))
def _attr_get(spark, sf):
    tags = nodes(spark, sf).filter("kind = 'tag'")
    return tags.select("page_id", F.col("pre").cast("bigint"), attr_get(F.col("attr"), "href", "none").alias("href"))


@query("attr_has", with_nodes("""
    SELECT name, sum(CASE WHEN attr_k = 'class' THEN 1 ELSE 0 END)::BIGINT AS with_class,
           sum(CASE WHEN attr_k = 'lang' THEN 1 ELSE 0 END)::BIGINT AS with_lang FROM nodes WHERE kind = 'tag' GROUP BY name"""))
def _attr_has(spark, sf):
    tags = nodes(spark, sf).filter("kind = 'tag'")
    return tags.groupBy("name").agg(F.count_if(attr_has(F.col("attr"), "class")).alias("with_class"),
                                    F.count_if(attr_has(F.col("attr"), "lang")).alias("with_lang"))


@query("node_string", with_nodes("""
    SELECT t.page_id, t.pre, (SELECT CASE WHEN count(*) = 1 AND bool_and(x.kind <> 'tag') THEN max(x.text) END
      FROM nodes x WHERE x.page_id = t.page_id AND x.parent_pre = t.pre) AS string FROM nodes t WHERE t.kind = 'tag'"""))
def _node_string(spark, sf):
    return T.node_string(saved_nodes(spark, sf)).select("page_id", F.col("pre").cast("bigint"), "string")


@query("node_text", with_nodes(r"""
    SELECT c.page_id, c.pre AS ctx_pre, md5(coalesce(string_agg(regexp_replace(x.text, '^\s+|\s+$', '', 'g'), '|' ORDER BY x.pre), '')) AS digest
    FROM nodes c LEFT JOIN nodes x ON x.page_id = c.page_id AND x.kind <> 'tag' AND x.pre > c.pre AND x.pre <= c.post
    WHERE c.name IN ('[document]', 'nav', 'li', 'article', 'p', 'br', 'head') GROUP BY ALL"""))
def _node_text(spark, sf):
    t = trees(spark, sf, attributes=False)
    text = P.node_text(t, sel(["[document]", "nav", "li", "article", "p", "br", "head"]), "|")
    return text.select("page_id", F.col("ctx_pre").cast("bigint"), F.md5("text").alias("digest"))


@query("child_count", with_nodes("""
    SELECT page_id, pre, (SELECT count(*) FROM nodes x WHERE x.page_id = t.page_id AND x.parent_pre = t.pre) AS n_children
    FROM nodes t WHERE kind = 'tag'"""))
def _child_count(spark, sf):
    return T.child_count(saved_nodes(spark, sf)).select("page_id", F.col("pre").cast("bigint"), "n_children")


@query("child_index", with_nodes("SELECT page_id, pre, sib_no AS child_index FROM nodes WHERE pre > 0"))
def _child_index(spark, sf):
    return T.child_index(nodes(spark, sf)).select("page_id", F.col("pre").cast("bigint"), F.col("child_index").cast("bigint"))


@query("nth_child", with_nodes("""
    SELECT u.page_id, u.pre AS ctx_pre, l.pre FROM nodes u JOIN nodes l
      ON l.page_id = u.page_id AND l.pre > u.pre AND l.pre <= u.post AND l.name = 'li' WHERE u.name = 'ul'
    QUALIFY row_number() OVER (PARTITION BY u.page_id, u.pre ORDER BY l.pre) = 3"""))
def _nth_child(spark, sf):
    t = trees(spark, sf, texts=False, attributes=False)
    return _hits(P.nth_match(t, sel("li"), sel(["ul"]), 2))


@query("contains_child", with_nodes("""
    SELECT page_id, pre FROM nodes p WHERE name = 'p' AND EXISTS (
      SELECT 1 FROM nodes b WHERE b.page_id = p.page_id AND b.parent_pre = p.pre AND b.name = 'b')"""))
def _contains_child(spark, sf):
    n = saved_nodes(spark, sf)
    return T.contains_child(n, _of(n, "p"), sel("b")).select("page_id", F.col("pre").cast("bigint"))


@query("subtree_equal", with_nodes("""
    SELECT page_id, ctx_pre, min(page_id) OVER (PARTITION BY f) AS first_page, count(*) OVER (PARTITION BY f) AS copies FROM (
      SELECT c.page_id, c.pre AS ctx_pre, string_agg(concat_ws('~', d.pre - c.pre, d.post - d.pre, d.kind, d.name, d.attr_k, d.attr_v, d.text), '^' ORDER BY d.pre) AS f
      FROM nodes c JOIN nodes d ON d.page_id = c.page_id AND d.pre BETWEEN c.pre AND c.post
      WHERE c.name IN ('li', 'style', 'script', 'nav', 'b', 'div') GROUP BY ALL)"""))
def _subtree_equal(spark, sf):
    prints = P.subtree_fingerprint(trees(spark, sf), sel(["li", "style", "script", "nav", "b", "div"]))
    # digests are read twice; written, both sides of the join are plain and a hot one can be split
    prints = cut_lineage(prints, run_folder(spark, "prints"))
    groups = cut_lineage(T.equal_subtrees(prints), run_folder(spark, "groups"))
    return prints.join(groups, "fingerprint").select(
        "page_id", F.col("ctx_pre").cast("bigint"), "first_page", "copies")
