"""Bulk tree edits. Numbers may get gaps; intervals and order stay valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegraph.functions.text import squeeze
from sitegraph.operators.html_nodes import attr_map
from sitegraph.operators.intervals import stab_join
from sitegraph.operators.select import Selector
from sitegraph.operators.tree import PAGE

def _rows_so_far(last: int = 0):
    return W.partitionBy(PAGE).orderBy("pre").rowsBetween(W.unboundedPreceding, last)


def covered_by(chosen: Column, strictly: bool = False) -> Column:
    """True for nodes inside a chosen node's interval (or equal to it).

    One ordered pass per page: intervals nest, so a node is inside iff the
    furthest ``post`` of the chosen nodes before it reaches it.
    """
    furthest = F.max(F.when(chosen, F.col("post"))).over(_rows_so_far(-1 if strictly else 0))
    return F.coalesce(furthest >= F.col("pre"), F.lit(False))


def drop_subtrees(nodes: DataFrame, selector: Selector) -> DataFrame:
    """Remove selected nodes with all their descendants."""
    marked = nodes.withColumn("_gone", covered_by(selector.on() & (F.col("pre") > 0)))
    return renumber_siblings(marked.filter("NOT _gone").drop("_gone"))


def clear_contents(nodes: DataFrame, selector: Selector) -> DataFrame:
    """Remove everything inside the selected elements."""
    marked = nodes.withColumn("_gone", covered_by(selector.on(), strictly=True))
    return renumber_siblings(marked.filter("NOT _gone").drop("_gone"))


def renumber_siblings(nodes: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(PAGE, "parent_pre").orderBy("pre")) - 1
    return nodes.withColumn("sib_no", rank)


def unwrap(nodes: DataFrame, selector: Selector) -> DataFrame:
    """Remove selected tags but keep their children in place."""
    marked = nodes.withColumn("_cut", selector.on() & (F.col("pre") > 0) & (F.col("kind") == "tag"))
    cut = marked.filter("_cut").select(
        PAGE, F.col("pre").alias("_at"), (F.col("pre") + 1).alias("_lo"), F.col("post").alias("_hi"))
    kept = marked.filter("NOT _cut").drop("_cut")
    # depth shrinks by the number of removed tags around a node
    around = stab_join(kept.select(PAGE, "pre"), cut, "pre", "_lo", "_hi") \
        .groupBy(PAGE, "pre").agg(F.count("*").cast("int").alias("_up"))
    # a removed parent is replaced by its nearest kept ancestor
    holders = kept.filter("kind = 'tag'").select(
        PAGE, F.col("pre").alias("_p"), (F.col("pre") + 1).alias("_plo"), F.col("post").alias("_phi"))
    moved = stab_join(cut.select(PAGE, "_at"), holders, "_at", "_plo", "_phi") \
        .groupBy(PAGE, F.col("_at").alias("parent_pre")).agg(F.max("_p").alias("_new"))
    out = kept.join(around, [PAGE, "pre"], "left").join(moved, [PAGE, "parent_pre"], "left")
    out = out.withColumns({
        "depth": F.col("depth") - F.coalesce("_up", F.lit(0)),
        "parent_pre": F.coalesce("_new", "parent_pre"),
    }).select(*nodes.columns)
    return renumber_siblings(out)


def _text_row(nodes: DataFrame, at: DataFrame, text: Column) -> DataFrame:
    fields = dict(nodes.dtypes)
    values = {"kind": F.lit("text"), "text": text, "sib_no": F.lit(0)}
    columns = []
    for c in nodes.columns:
        if c in values:
            columns.append(values[c].cast(fields[c]).alias(c))
        elif c in ("name", "attrs", "attr"):
            columns.append(F.lit(None).cast(fields[c]).alias(c))
        else:
            columns.append(F.col(c))
    return at.select(*columns)


def replace_nodes(nodes: DataFrame, selector: Selector, text: Column | str) -> DataFrame:
    """Replace selected subtrees by one text in the same place (outermost ones win)."""
    chosen = selector.on() & (F.col("pre") > 0)
    marked = nodes.withColumns({
        "_gone": covered_by(chosen), "_inner": covered_by(chosen, strictly=True),
    })
    kept = marked.filter("NOT _gone").drop("_gone", "_inner")
    at = marked.filter("_gone AND NOT _inner").drop("_gone", "_inner").withColumn("post", F.col("pre"))
    text = text if isinstance(text, Column) else F.lit(text)
    return renumber_siblings(kept.unionByName(_text_row(nodes, at, text)))


def set_string(nodes: DataFrame, selector: Selector, text: Column | str) -> DataFrame:
    """Replace the contents of selected elements by one text.

    An element without contents has no number to spare for the text; such pages
    are spread out first (numbers doubled), which keeps every order.
    """
    wide = nodes.withColumns({
        "pre": F.col("pre") * 2, "parent_pre": F.col("parent_pre") * 2,
        "post": F.col("post") * 2 + 1,
    })
    chosen = selector.on() & (F.col("kind") == "tag")
    marked = wide.withColumns({"_inner": covered_by(chosen, strictly=True), "_chosen": chosen})
    kept = marked.filter("NOT _inner")
    text = text if isinstance(text, Column) else F.lit(text)
    at = kept.filter("_chosen").withColumns({
        "parent_pre": F.col("pre"), "pre": F.col("pre") + 1, "post": F.col("pre") + 1,
        "depth": F.col("depth") + 1,
    })
    kept, at = kept.drop("_inner", "_chosen"), at.drop("_inner", "_chosen")
    return renumber_siblings(kept.unionByName(_text_row(wide, at, text)))


def _with_attrs(nodes: DataFrame, selector: Selector, change: Callable[[Column], Column]) -> DataFrame:
    chosen = selector.on() & (F.col("kind") == "tag")
    changed = nodes.withColumn("attrs", F.when(chosen, change(F.col("attrs"))).otherwise(F.col("attrs")))
    return changed.withColumn("attr", attr_map(F.col("attrs"))).select(*nodes.columns)


def attr_set(nodes: DataFrame, selector: Selector, key: str, value: Column | str) -> DataFrame:
    """Set an attribute: every occurrence is rewritten, an absent one is appended."""
    value = value if isinstance(value, Column) else F.lit(value)

    def change(attrs: Column) -> Column:
        pair = F.struct(F.lit(key).alias("k"), value.alias("v"))
        return F.when(
            F.exists(attrs, lambda a: a["k"] == key),
            F.transform(attrs, lambda a: F.when(a["k"] == key, pair).otherwise(a)),
        ).otherwise(F.concat(attrs, F.array(pair)))

    return _with_attrs(nodes, selector, change)


def attr_delete(nodes: DataFrame, selector: Selector, key: str) -> DataFrame:
    """Delete all attributes of that name."""
    return _with_attrs(nodes, selector, lambda attrs: F.filter(attrs, lambda a: a["k"] != key))


def squeeze_blank_text(nodes: DataFrame, keep: tuple[str, ...] = ("pre", "textarea")) -> DataFrame:
    """All-blank strings become one line feed or space, except inside ``keep``."""
    inside = covered_by(F.col("name").isin(*keep) & (F.col("kind") == "tag"))
    text = F.when((F.col("kind") == "text") & ~F.col("_keep"), squeeze(F.col("text"))).otherwise(F.col("text"))
    return nodes.withColumn("_keep", inside).withColumn("text", text).drop("_keep")


def parse_only(nodes: DataFrame, selector: Selector) -> DataFrame:
    """Keep only outermost elements (or top-level strings) that match, with contents.

    The result is a page whose root holds just these parts.
    """
    chosen = selector.on() & (F.col("pre") > 0)
    if selector.text is not None:
        kept = nodes.filter((chosen & (F.col("depth") == 1)) | (F.col("pre") == 0))
        return renumber_siblings(kept)
    marked = nodes.withColumns({
        "_in": covered_by(chosen), "_inner": covered_by(chosen, strictly=True),
    })
    marked = marked.withColumn("_shift", F.last(
        F.when(F.col("_in") & ~F.col("_inner"), F.col("depth") - 1), ignorenulls=True).over(_rows_so_far()))
    kept = marked.filter("_in OR pre = 0").withColumns({
        "depth": F.when(F.col("pre") == 0, 0).otherwise(F.col("depth") - F.col("_shift")),
        "parent_pre": F.when(F.col("pre") == 0, F.col("parent_pre"))
        .when(~F.col("_inner"), F.lit(0)).otherwise(F.col("parent_pre")),
    }).select(*nodes.columns)
    return renumber_siblings(kept)
