"""Tree queries on the node table: joins and windows over ``(page_id, pre, post)``.

A context is a set of node rows (any columns beyond ``page_id, pre, post,
parent_pre, sib_no`` are ignored); results carry ``ctx_pre`` and the matched
node's columns. Candidates are filtered before any join, and a page-wide search
needs no join at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegraph.functions.text import strip
from sitegraph.operators.intervals import stab_join
from sitegraph.operators.select import ANY, Selector

PAGE = "page_id"


def _context(ctx: DataFrame) -> DataFrame:
    return ctx.select(
        PAGE, F.col("pre").alias("ctx_pre"), F.col("post").alias("ctx_post"),
        F.col("parent_pre").alias("ctx_parent"), F.col("sib_no").alias("ctx_sib"),
    )


def _found(joined: DataFrame, nodes: DataFrame) -> DataFrame:
    return joined.select(PAGE, "ctx_pre", *[c for c in nodes.columns if c != PAGE])


def first_per_context(found: DataFrame, ctx: DataFrame, nearest_last: bool = False) -> DataFrame:
    """One match per context by ``pre``, null where there is none (map-side combined)."""
    columns = [c for c in found.columns if c not in (PAGE, "ctx_pre")]
    pick = F.max_by if nearest_last else F.min_by
    best = found.groupBy(PAGE, "ctx_pre").agg(pick(F.struct(*columns), "pre").alias("hit"))
    base = ctx.select(PAGE, F.col("pre").alias("ctx_pre"))
    return base.join(best, [PAGE, "ctx_pre"], "left").select(
        PAGE, "ctx_pre", *[F.col(f"hit.{c}").alias(c) for c in columns]
    )


def _limited(found: DataFrame, limit: int | None, reverse: bool = False) -> DataFrame:
    if not limit:
        return found
    order = F.desc("pre") if reverse else F.asc("pre")
    rank = F.row_number().over(W.partitionBy(PAGE, "ctx_pre").orderBy(order))
    return found.withColumn("_n", rank).filter(F.col("_n") <= limit).drop("_n")


def find_all(nodes: DataFrame, selector: Selector = ANY, ctx: DataFrame | None = None,
             limit: int | None = None) -> DataFrame:
    """Descendants that match, in document order; without ``ctx`` those of the page."""
    hits = nodes.filter(selector.on() & (F.col("pre") > 0))
    if ctx is None:
        found = hits.withColumn("ctx_pre", F.lit(0)).select(PAGE, "ctx_pre", *nodes.columns[1:])
        return _limited(found, limit)
    inside = _context(ctx).withColumn("_lo", F.col("ctx_pre") + 1)
    found = _found(stab_join(hits, inside, "pre", "_lo", "ctx_post"), nodes)
    return _limited(found, limit)


def find(nodes: DataFrame, selector: Selector, ctx: DataFrame) -> DataFrame:
    """First matching descendant per context, nulls where there is none."""
    return first_per_context(find_all(nodes, selector, ctx), ctx)


def find_children(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY,
                  strings: bool = False, limit: int | None = None) -> DataFrame:
    """Direct children; ``strings`` adds the string children (plain iteration)."""
    hits = nodes if strings else nodes.filter(selector.on())
    hits = hits.filter("parent_pre IS NOT NULL")
    ids = _context(ctx).select(PAGE, "ctx_pre")
    joined = hits.withColumn("ctx_pre", F.col("parent_pre")).join(ids, [PAGE, "ctx_pre"])
    return _limited(_found(joined, nodes), limit)


def find_text(nodes: DataFrame, text: object = True, ctx: DataFrame | None = None,
              limit: int | None = None) -> DataFrame:
    """String nodes (comments and script bodies are strings too) matching ``text``."""
    return find_all(nodes, Selector(text=text), ctx, limit)


def next_elements(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY,
                  limit: int | None = None) -> DataFrame:
    """Matches later in document order, descendants included."""
    last = nodes.filter("pre = 0").select(PAGE, F.col("post").alias("_last"))
    after = _context(ctx).withColumn("_lo", F.col("ctx_pre") + 1).join(last, PAGE)
    hits = nodes.filter(selector.on())
    return _limited(_found(stab_join(hits, after, "pre", "_lo", "_last"), nodes), limit)


def next_element(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY) -> DataFrame:
    return first_per_context(next_elements(nodes, ctx, selector), ctx)


def previous_elements(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY,
                      limit: int | None = None) -> DataFrame:
    """Matches earlier in document order, ancestors included, nearest first."""
    before = _context(ctx).withColumns({"_lo": F.lit(0), "_hi": F.col("ctx_pre") - 1})
    hits = nodes.filter(selector.on())
    return _limited(_found(stab_join(hits, before, "pre", "_lo", "_hi"), nodes), limit, reverse=True)


def previous_element(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY) -> DataFrame:
    return first_per_context(previous_elements(nodes, ctx, selector), ctx, nearest_last=True)


def _siblings(nodes: DataFrame, ctx: DataFrame, selector: Selector, later: bool) -> DataFrame:
    hits = nodes.filter(selector.on() & F.col("parent_pre").isNotNull())
    side = _context(ctx).withColumnRenamed("ctx_parent", "parent_pre")
    joined = hits.join(side, [PAGE, "parent_pre"])
    order = F.col("sib_no") > F.col("ctx_sib") if later else F.col("sib_no") < F.col("ctx_sib")
    return _found(joined.filter(order), nodes)


def next_siblings(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY,
                  limit: int | None = None) -> DataFrame:
    return _limited(_siblings(nodes, ctx, selector, True), limit)


def previous_siblings(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY,
                      limit: int | None = None) -> DataFrame:
    return _limited(_siblings(nodes, ctx, selector, False), limit, reverse=True)


def next_sibling(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY) -> DataFrame:
    return first_per_context(next_siblings(nodes, ctx, selector), ctx)


def previous_sibling(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY) -> DataFrame:
    return first_per_context(previous_siblings(nodes, ctx, selector), ctx, nearest_last=True)


def neighbours(nodes: DataFrame) -> DataFrame:
    """Unfiltered next/previous element and sibling of every node, by window."""
    page = W.partitionBy(PAGE).orderBy("pre")
    family = W.partitionBy(PAGE, "parent_pre").orderBy("sib_no")
    return nodes.withColumns({
        "next_pre": F.lead("pre").over(page),
        "previous_pre": F.lag("pre").over(page),
        "next_sibling_pre": F.lead("pre").over(family),
        "previous_sibling_pre": F.lag("pre").over(family),
    })


def parents(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY,
            limit: int | None = None) -> DataFrame:
    """Ancestors that match, nearest first; the root ``[document]`` counts."""
    above = nodes.filter(selector.on() & (F.col("post") > F.col("pre"))) \
        .withColumn("_lo", F.col("pre") + 1)
    points = _context(ctx).select(PAGE, "ctx_pre")
    found = _found(stab_join(points, above, "ctx_pre", "_lo", "post"), nodes)
    return _limited(found, limit, reverse=True)


def parent(nodes: DataFrame, ctx: DataFrame, selector: Selector = ANY) -> DataFrame:
    """Nearest matching ancestor."""
    return first_per_context(parents(nodes, ctx, selector), ctx, nearest_last=True)


def child_count(nodes: DataFrame) -> DataFrame:
    """Every element with its number of children (strings count)."""
    counts = nodes.filter("parent_pre IS NOT NULL").groupBy(
        PAGE, F.col("parent_pre").alias("pre")).agg(F.count("*").alias("n_children"))
    tags = nodes.filter("kind = 'tag'")
    return tags.join(counts, [PAGE, "pre"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))


def child_index(nodes: DataFrame) -> DataFrame:
    """Position of every node among its siblings, from 0."""
    return nodes.filter("parent_pre IS NOT NULL").withColumn("child_index", F.col("sib_no"))


def nth_match(nodes: DataFrame, ctx: DataFrame, selector: Selector, k: int) -> DataFrame:
    """The k-th (from 0) matching descendant of each context."""
    found = find_all(nodes, selector, ctx)
    rank = F.row_number().over(W.partitionBy(PAGE, "ctx_pre").orderBy("pre"))
    return found.withColumn("_n", rank).filter(F.col("_n") == k + 1).drop("_n")


def contains_child(nodes: DataFrame, ctx: DataFrame, selector: Selector) -> DataFrame:
    """Contexts that have a matching direct child."""
    children = nodes.filter(selector.on() & F.col("parent_pre").isNotNull()).select(
        PAGE, F.col("parent_pre").alias("pre"))
    return ctx.join(children, [PAGE, "pre"], "left_semi")


def node_string(nodes: DataFrame) -> DataFrame:
    """Per element: its text if it has exactly one child and that is a string."""
    only = nodes.filter("parent_pre IS NOT NULL").groupBy(
        PAGE, F.col("parent_pre").alias("pre")
    ).agg(
        F.when((F.count("*") == 1) & (F.count_if(F.col("kind") != "tag") == 1), F.max("text")).alias("string")
    )
    return nodes.filter("kind = 'tag'").join(only, [PAGE, "pre"], "left")


def node_text(nodes: DataFrame, ctx: DataFrame, separator: str = "") -> DataFrame:
    """All strings inside each context, trimmed and joined in document order.

    Strings are brought together once per page; a context is a slice of that
    list, found from the number of strings before its first and last node. Texts
    are never repeated per context on the way.
    """
    is_string = F.col("kind") != "tag"
    lists = nodes.filter(is_string).groupBy(PAGE).agg(
        F.array_sort(F.collect_list(F.struct("pre", strip(F.col("text")).alias("s")))).alias("all"))
    so_far = F.count_if(is_string).over(
        W.partitionBy(PAGE).orderBy("pre").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    counts = nodes.select(PAGE, F.col("pre").alias("at"), so_far.alias("k"))
    base = ctx.select(PAGE, F.col("pre").alias("ctx_pre"), F.col("post").alias("ctx_post"))
    bounds = base.join(counts.select(PAGE, F.col("at").alias("ctx_pre"), F.col("k").alias("lo")), [PAGE, "ctx_pre"]) \
        .join(counts.select(PAGE, F.col("at").alias("ctx_post"), F.col("k").alias("hi")), [PAGE, "ctx_post"])
    inside = F.slice("all", F.col("lo") + 1, F.col("hi") - F.col("lo"))
    text = F.array_join(F.transform(inside, lambda p: p["s"]), separator)
    return bounds.join(lists, PAGE, "left").select(PAGE, "ctx_pre", F.coalesce(text, F.lit("")).alias("text"))


def subtree_fingerprint(nodes: DataFrame, ctx: DataFrame) -> DataFrame:
    """Equal subtrees (names, ordered attributes, strings, shape) get equal digests.

    Also useful as a duplicate key for pages or page parts. Node digests are
    combined in document order with their place relative to the root.
    """
    content = F.to_json(F.struct("kind", "name", "attrs", "text"))
    rows = nodes.select(PAGE, "pre", (F.col("post") - F.col("pre")).alias("span"),
                        F.sha2(content, 256).alias("d"))
    inside = _context(ctx)
    parts = stab_join(rows, inside, "pre", "ctx_pre", "ctx_post").groupBy(PAGE, "ctx_pre").agg(
        F.array_sort(F.collect_list(F.struct((F.col("pre") - F.col("ctx_pre")).alias("at"), "span", "d"))).alias("parts"))
    line = F.transform("parts", lambda p: F.concat_ws(":", p["at"].cast("string"), p["span"].cast("string"), p["d"]))
    return parts.select(PAGE, "ctx_pre", F.sha2(F.array_join(line, "\n"), 256).alias("fingerprint"))


def subtree_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of fingerprinted subtrees compared key by key (``page_id``)."""
    pair = left.select(PAGE, F.col("fingerprint").alias("l")).join(
        right.select(PAGE, F.col("fingerprint").alias("r")), PAGE, "full_outer")
    return pair.select(PAGE, F.col("l").eqNullSafe(F.col("r")).alias("equal"))


def equal_subtrees(fingerprints: DataFrame) -> DataFrame:
    """Each fingerprint with its first page and number of copies."""
    groups = fingerprints.groupBy("fingerprint").agg(
        F.min(PAGE).alias("first_page"), F.count("*").alias("copies"))
    return groups
