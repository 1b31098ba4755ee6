"""Queries: markup to rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.catalog import query
from sitegraph.catalog.tables import nodes, pages, with_nodes, with_tokens
from sitegraph.functions.entities import convert_entities, escape_entities
from sitegraph.operators.html_nodes import html_nodes, html_tokens, massage_markup, node_depth


@query("html_nodes", with_nodes(
    "SELECT page_id, pre, post, depth, parent_pre, sib_no, kind, name, attr_k, attr_v, text FROM nodes"))
def _html_nodes(spark, sf):
    first = F.get("attrs", F.lit(0))
    return nodes(spark, sf).select(
        "page_id", F.col("pre").cast("bigint"), F.col("post").cast("bigint"),
        F.col("depth").cast("bigint"), F.col("parent_pre").cast("bigint"),
        F.col("sib_no").cast("bigint"), "kind", "name",
        F.coalesce(first["k"], F.lit("")).alias("attr_k"),
        F.coalesce(first["v"], F.lit("")).alias("attr_v"), "text")


@query("html_tokens", with_tokens("SELECT page_id, pos, kind, name, raw FROM tokens"))
def _html_tokens(spark, sf):
    return html_tokens(pages(spark, sf)).select("page_id", F.col("pos").cast("bigint"), "kind", "name", "raw")


@query("massage_markup", "SELECT page_id, md5(replace(html, '<br>', '<br />')) AS digest FROM pages")
def _massage(spark, sf):
    # both faults that the fixes are for: a slash glued to the end, a blank behind "<!"
    faulty = F.replace(F.replace("html", F.lit("<br>"), F.lit("<br/>")), F.lit("<!--"), F.lit("<! \n--"))
    return pages(spark, sf).select("page_id", F.md5(massage_markup(faulty)).alias("digest"))


@query("node_depth", with_tokens("""
    SELECT page_id, pos, name, coalesce(sum(CASE kind WHEN 'start' THEN 1 ELSE -1 END) OVER (
      PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth
    FROM tokens WHERE name IN ('nav', 'ul', 'li', 'a')"""))
def _node_depth(spark, sf):
    tokens = html_tokens(pages(spark, sf)).filter(F.col("name").isin("nav", "ul", "li", "a"))
    return node_depth(tokens).select("page_id", F.col("pos").cast("bigint"), "name", F.col("depth").cast("bigint"))


@query("convert_entities", """
    SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS digest FROM pages""")
def _convert_entities(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(convert_entities(F.col("html"), "xhtml")).alias("digest"))


@query("escape_entities", r"""
    SELECT doc_id, md5(replace(replace(replace(replace(
      regexp_replace(text, '&(#\d+;|#x[0-9a-fA-F]+;|[a-zA-Z0-9_]+;)', chr(1) || '\1', 'g'),
      '&', '&amp;'), chr(1), '&'), '<', '&lt;'), '>', '&gt;')) AS digest FROM documents""")
def _escape_entities(spark, sf):
    from sitegraph.catalog.tables import table

    return table(spark, sf, "documents").select("doc_id", F.md5(escape_entities(F.col("text"))).alias("digest"))


@query("squeeze_blank_text", """
    SELECT page_id, CAST((length(html) - length(replace(html, '</li><li>', ''))) / 9 AS BIGINT) AS line_feeds,
           CAST((length(html) - length(replace(html, '</p><p>', ''))) / 7 AS BIGINT) AS spaces FROM pages""")
def _squeeze_blank_text(spark, sf):
    from sitegraph.operators.edit import squeeze_blank_text

    spread = F.replace(F.replace("html", F.lit("</li><li>"), F.lit("</li> \n \t<li>")), F.lit("</p><p>"), F.lit("</p> \t <p>"))
    raw = html_nodes(pages(spark, sf).withColumn("html", spread), squeeze_blanks=False)
    return squeeze_blank_text(raw).groupBy("page_id").agg(
        F.count_if(F.col("text") == "\n").alias("line_feeds"), F.count_if(F.col("text") == " ").alias("spaces"))


@query("dialects", """
    SELECT d AS dialect, page_id, pre, parent_pre, name, replace(replace(lifted, '?', page_id::VARCHAR), '!', length(html)::VARCHAR) AS lifted
    FROM pages, (VALUES
      ('html', 0, NULL, '[document]', ''), ('html', 1, 0, 'b', ''), ('html', 3, 0, 'b', ''), ('html', 5, 0, 'div', ''),
      ('html', 7, 5, 'div', ''), ('html', 9, 0, 'foo', ''), ('html', 10, 9, 'bar', ''), ('html', 12, 0, 'br', ''),
      ('nestable_inline', 0, NULL, '[document]', ''), ('nestable_inline', 1, 0, 'b', ''), ('nestable_inline', 3, 1, 'b', ''), ('nestable_inline', 5, 0, 'div', ''),
      ('nestable_inline', 7, 5, 'div', ''), ('nestable_inline', 9, 0, 'foo', ''), ('nestable_inline', 10, 9, 'bar', ''), ('nestable_inline', 12, 0, 'br', ''),
      ('minimal', 0, NULL, '[document]', ''), ('minimal', 1, 0, 'b', ''), ('minimal', 3, 0, 'b', ''), ('minimal', 5, 0, 'div', ''),
      ('minimal', 7, 0, 'div', ''), ('minimal', 9, 0, 'foo', ''), ('minimal', 10, 9, 'bar', ''), ('minimal', 12, 0, 'br', ''),
      ('xml', 0, NULL, '[document]', ''), ('xml', 1, 0, 'b', ''), ('xml', 3, 0, 'b', ''), ('xml', 5, 0, 'div', ''),
      ('xml', 7, 0, 'div', ''), ('xml', 9, 0, 'foo', ''), ('xml', 10, 9, 'bar', ''), ('xml', 12, 0, 'br', ''), ('xml', 13, 12, 'i', ''),
      ('soap', 0, NULL, '[document]', 'b=?,div=1'), ('soap', 1, 0, 'b', ''), ('soap', 3, 0, 'b', ''), ('soap', 5, 0, 'div', ''),
      ('soap', 7, 0, 'div', ''), ('soap', 9, 0, 'foo', 'bar=!'), ('soap', 10, 9, 'bar', ''), ('soap', 12, 0, 'br', ''), ('soap', 13, 12, 'i', ''),
      ('html', 13, 0, 'i', ''), ('nestable_inline', 13, 0, 'i', ''), ('minimal', 13, 0, 'i', '')
    ) v(d, pre, parent_pre, name, lifted)""")
def _dialects(spark, sf):
    # markup on which the dialects differ: equal elements inside each other, an element without end
    markup = F.concat(F.lit("<b>"), F.col("page_id").cast("string"), F.lit("<b>y</b></b><div>1<div>2</div></div><foo><bar>"),
                      F.length("html").cast("string"), F.lit("</bar></foo><br><i></i>"))
    small, out = pages(spark, sf).select("page_id", markup.alias("html")), None
    for dialect in ("html", "nestable_inline", "minimal", "xml", "soap"):
        part = html_nodes(small, dialect=dialect).filter("kind = 'tag'").select(
            F.lit(dialect).alias("dialect"), "page_id", F.col("pre").cast("bigint"), F.col("parent_pre").cast("bigint"), "name",
            F.array_join(F.transform("attrs", lambda a: F.concat(a["k"], F.lit("="), a["v"])), ",").alias("lifted"))
        out = part if out is None else out.unionByName(part)
    return out


@query("soap_attributes", with_nodes("""
    SELECT c.page_id, c.parent_pre AS pre, c.name AS k, arg_min(s.text, c.pre) AS v
    FROM nodes c JOIN nodes s ON s.page_id = c.page_id AND s.parent_pre = c.pre AND s.kind <> 'tag'
    JOIN nodes p ON p.page_id = c.page_id AND p.pre = c.parent_pre
    WHERE c.kind = 'tag' AND p.attr_k <> c.name
      AND (SELECT count(*) FROM nodes x WHERE x.page_id = c.page_id AND x.parent_pre = c.pre) = 1
    GROUP BY c.page_id, c.parent_pre, c.name"""))
def _soap_attributes(spark, sf):
    from sitegraph.operators.html_nodes import soap_attributes

    before = nodes(spark, sf)
    after = soap_attributes(before).withColumn("a", F.explode("attrs"))
    given = F.col("a.k").isin("lang", "charset", "href", "class")
    return after.filter(~given).select("page_id", F.col("pre").cast("bigint"), F.col("a.k").alias("k"), F.col("a.v").alias("v"))


@query("parse_only", with_nodes("""
    SELECT n.page_id, n.pre, n.depth - a.depth + 1 AS depth, CASE WHEN n.pre = a.pre THEN 0 ELSE n.parent_pre END AS parent_pre
    FROM nodes n JOIN nodes a ON a.page_id = n.page_id AND a.name = 'p' AND n.pre BETWEEN a.pre AND a.post
    UNION ALL SELECT page_id, 0, 0, NULL FROM nodes WHERE pre = 0"""))
def _parse_only(spark, sf):
    from sitegraph.operators.edit import parse_only
    from sitegraph.operators.select import sel

    kept = parse_only(nodes(spark, sf), sel("p"))
    return kept.select("page_id", *[F.col(c).cast("bigint") for c in ("pre", "depth", "parent_pre")])
