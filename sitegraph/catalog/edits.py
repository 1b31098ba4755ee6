"""Queries: bulk edits and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.catalog import query
from sitegraph.catalog.tables import nodes, saved_nodes, trees, with_nodes
from sitegraph.operators import edit as E
from sitegraph.operators.render import render, render_pages, render_special
from sitegraph.operators.select import sel


def _rows(n, *columns):
    return n.select("page_id", *[F.col(c).cast("bigint") for c in columns])


def _digest(rendered):
    return rendered.select("page_id", F.md5("html").alias("digest"), F.length("html").cast("bigint").alias("size"))


# markup of the rows in ``kept(page_id, pre, post, depth, kind, name, attr_k, attr_v, text)``
_RENDER = r"""
pieces AS (
  SELECT page_id, pre AS a, 0 AS b, 0 AS c, depth, CASE WHEN kind = 'tag' THEN '<' || name ||
      CASE WHEN attr_k <> '' THEN ' ' || attr_k || '="' || attr_v || '"' ELSE '' END ||
      CASE WHEN name IN ('br', 'meta') THEN ' />' ELSE '>' END
    WHEN kind = 'comment' THEN '<!--' || text || '-->' WHEN kind = 'decl' THEN '<!' || text || '>' ELSE text END AS piece, kind
  FROM kept WHERE name IS DISTINCT FROM '[document]'
  UNION ALL SELECT page_id, post, 1, -depth, depth, '</' || name || '>', kind FROM kept
  WHERE kind = 'tag' AND name NOT IN ('br', 'meta', '[document]'))
"""
_RENDERED = "SELECT page_id, md5(html) AS digest, length(html) AS size FROM (SELECT page_id, string_agg(piece, '' ORDER BY a, b, c) AS html FROM pieces GROUP BY page_id)"


def _kept(sql: str) -> str:
    return f"kept AS ({sql})"


@query("render", with_nodes(_RENDERED, _kept("SELECT * FROM nodes"), _RENDER))
def _render(spark, sf):
    return _digest(render_pages(trees(spark, sf)))


@query("prettify", with_nodes(r"""
    SELECT page_id, md5(html) AS digest, length(html) AS size FROM (
      SELECT page_id, string_agg(repeat(' ', CAST(depth - 1 AS INT)) || CASE WHEN kind = 'tag' THEN piece ELSE trim(piece, ' ') END, chr(10) ORDER BY a, b, c) AS html
      FROM pieces WHERE trim(piece, ' ') <> '' GROUP BY page_id)""", _kept("SELECT * FROM nodes"), _RENDER))
def _prettify(spark, sf):
    return _digest(render_pages(trees(spark, sf), pretty=True))


@query("render_special", with_nodes("""
    SELECT page_id, pre, CASE kind WHEN 'comment' THEN '<!--' || text || '-->' ELSE '<!' || text || '>' END AS markup
    FROM nodes WHERE kind IN ('comment', 'decl')"""))
def _render_special(spark, sf):
    special = nodes(spark, sf).filter("kind NOT IN ('tag', 'text')")
    return special.select("page_id", F.col("pre").cast("bigint"),
                          render_special(F.col("kind"), F.col("text")).alias("markup"))


@query("drop_subtrees", with_nodes("""
    SELECT n.page_id, n.pre, n.parent_pre, row_number() OVER (PARTITION BY n.page_id, n.parent_pre ORDER BY n.pre) - 1 AS sib_no
    FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes a WHERE a.page_id = n.page_id
      AND a.name IN ('nav', 'script', 'style', 'div', 'b') AND n.pre BETWEEN a.pre AND a.post)"""))
def _drop_subtrees(spark, sf):
    left = E.drop_subtrees(nodes(spark, sf), sel(["nav", "script", "style", "div", "b"]))
    return _rows(left, "pre", "parent_pre", "sib_no")


@query("clear_contents", with_nodes(_RENDERED, _kept("""
    SELECT n.* FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes a WHERE a.page_id = n.page_id
      AND a.name IN ('nav', 'article') AND n.pre > a.pre AND n.pre <= a.post)"""), _RENDER))
def _clear_contents(spark, sf):
    return _digest(render(E.clear_contents(saved_nodes(spark, sf), sel(["nav", "article"]))))


@query("unwrap", with_nodes("""
    SELECT n.page_id, n.pre, n.depth - (SELECT count(*) FROM nodes a WHERE a.page_id = n.page_id AND a.name IN ('b', 'li', 'ul')
        AND n.pre > a.pre AND n.pre <= a.post) AS depth, k.pre AS parent_pre,
      row_number() OVER (PARTITION BY n.page_id, k.pre ORDER BY n.pre) - 1 AS sib_no
    FROM nodes n LEFT JOIN nodes k ON k.page_id = n.page_id AND k.pre = (SELECT max(a.pre) FROM nodes a
      WHERE a.page_id = n.page_id AND a.pre < n.pre AND a.post >= n.pre AND a.kind = 'tag' AND a.name NOT IN ('b', 'li', 'ul'))
    WHERE n.name IS NULL OR n.name NOT IN ('b', 'li', 'ul')"""))
def _unwrap(spark, sf):
    return _rows(E.unwrap(saved_nodes(spark, sf), sel(["b", "li", "ul"])), "pre", "depth", "parent_pre", "sib_no")


_INSIDE = "EXISTS (SELECT 1 FROM nodes a WHERE a.page_id = n.page_id AND a.name = '{0}' AND n.pre {1} a.pre AND n.pre <= a.post)"


@query("set_string", with_nodes(_RENDERED, _kept(f"""
    SELECT page_id, pre * 2 AS pre, post * 2 + 1 AS post, depth, kind, name, attr_k, attr_v, text FROM nodes n WHERE NOT {_INSIDE.format('h1', '>')}
    UNION ALL SELECT page_id, pre * 2 + 1, pre * 2 + 1, depth + 1, 'text', NULL, '', '', 'New heading' FROM nodes WHERE name = 'h1'"""), _RENDER))
def _set_string(spark, sf):
    return _digest(render(E.set_string(saved_nodes(spark, sf), sel("h1"), "New heading")))


@query("replace_nodes", with_nodes(_RENDERED, _kept(f"""
    SELECT page_id, pre, post, depth, kind, name, attr_k, attr_v, text FROM nodes n WHERE NOT {_INSIDE.format('nav', '>=')}
    UNION ALL SELECT page_id, pre, pre, depth, 'text', NULL, '', '', '[menu]' FROM nodes WHERE name = 'nav'"""), _RENDER))
def _replace_nodes(spark, sf):
    return _digest(render(E.replace_nodes(saved_nodes(spark, sf), sel("nav"), "[menu]")))


def _attr_text(n):
    text = F.array_join(F.transform("attrs", lambda a: F.concat(a["k"], F.lit("="), a["v"])), ";")
    return n.filter("kind = 'tag'").select("page_id", F.col("pre").cast("bigint"), text.alias("attrs"))


@query("attr_set", with_nodes("""
    SELECT page_id, pre, CASE WHEN name = 'a' THEN 'href=' || attr_v || ';rel=nofollow' WHEN name = 'div' THEN 'class=box'
      WHEN attr_k = '' THEN '' ELSE attr_k || '=' || attr_v END AS attrs FROM nodes WHERE kind = 'tag'"""))
def _attr_set(spark, sf):
    n = E.attr_set(nodes(spark, sf), sel("a"), "rel", "nofollow")
    return _attr_text(E.attr_set(n, sel("div"), "class", "box"))


@query("attr_delete", with_nodes("""
    SELECT page_id, pre, CASE WHEN name = 'a' OR attr_k = '' THEN '' ELSE attr_k || '=' || attr_v END AS attrs FROM nodes WHERE kind = 'tag'"""))
def _attr_delete(spark, sf):
    return _attr_text(E.attr_delete(nodes(spark, sf), sel("a"), "href"))
