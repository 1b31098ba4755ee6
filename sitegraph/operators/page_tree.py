"""Tree queries that stay in the page's row: no join, no exchange, no written node table.

A page is one row with its nodes as an array in document order, so a node's ``pre`` is
its index. The rank index of a selector holds the numbers of its matches and, for every
node, how many matches there are up to it. What lies below, after or before a context is
then a range of ranks, the k-th match a lookup, and a subtree's text a slice of the page's
strings. Siblings have the same index in the order of families.

Use these where pages are at hand; ``operators.tree`` asks the same of a node table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions.once import once
from sitegraph.functions.text import strip
from sitegraph.operators.html_nodes import (
    DEFAULT_MASSAGE, Massage, attr_map, child_kind, dialect_rules, node_attrs, node_content, node_kind, placed_tokens, tag_name,
)
from sitegraph.operators.select import ANY, Selector
from sitegraph.schemas import ROOT_NAME

Row = Callable[[str], Column]

#: fields of a node that are known without looking at attributes or texts
PLACE = ("pre", "post", "depth", "parent_pre", "sib_no", "kind", "name")


def page_nodes(pages: DataFrame, dialect: str = "html", html: str = "html", keep: Iterable[str] = ("page_id",),
               entities: str | None = None, massage: Massage = DEFAULT_MASSAGE, void: Iterable[str] = (),
               squeeze_blanks: bool = True, slash_closes: bool = False, strings: bool = False,
               only: Callable[[Row], Column] | None = None, texts: bool = True, attributes: bool = True,
               names: Iterable[str] | None = None) -> DataFrame:
    """``keep`` and ``nodes``: the rows of ``html_nodes`` as one array per page.

    ``only`` drops nodes by a predicate over ``PLACE`` fields before attributes and texts
    are computed (indexes are numbers of nodes only without it); ``texts`` and
    ``attributes`` tell which of these to compute at all. ``names`` keeps the root and
    elements with these names: others never come back from the helper that places them.
    """
    rules, keep = dialect_rules(dialect, void), list(keep)
    placed = placed_tokens(pages, rules, html, keep, massage, slash_closes, strings, names)
    place = ("post", "depth", "parent_pre", "sib_no")
    rest = ("token", "raw", "keep_blank", *(["child"] if strings else []))

    def named(n: Column) -> Column:
        return F.struct(*[n[c].alias(c) for c in ("pre", *place)], F.lit("tag").alias("kind"), F.coalesce(n["name"], F.lit(ROOT_NAME)).alias("name"), *[n[c].alias(c) for c in rest])

    def start(n: Column, i: Column) -> Column:
        tag = n["token"].rlike("^<[a-zA-Z]") & ~n["raw"]
        name = F.when(n["token"].isNull(), ROOT_NAME).when(tag, tag_name(n["token"]))
        return F.struct(i.alias("pre"), *[n[c].alias(c) for c in place], node_kind(n["token"], n["raw"]).alias("kind"), name.alias("name"), *[n[c].alias(c) for c in rest])

    found = F.transform("z", start if names is None else named)
    if only is not None:
        found = F.filter(found, lambda n: only(lambda c: n[c]))
    rows = once(placed.select(*keep, "z"), {"n1": found}).select(*keep, "n1")

    def attributed(n: Column) -> Column:
        return F.struct(*[n[c].alias(c) for c in (*PLACE, *rest)], node_attrs(n["kind"], n["name"], n["token"]).alias("attrs"))

    if attributes:
        rows = once(rows, {"n2": F.transform("n1", attributed)}).select(*keep, F.col("n2").alias("n1"))

    def content(*of: Column) -> Column:
        return node_content(rules, entities, squeeze_blanks, *of)

    def whole(n: Column) -> Column:
        fields = [n[c].alias(c) for c in PLACE]
        if attributes:
            fields += [n["attrs"].alias("attrs"), attr_map(n["attrs"]).alias("attr")]
        if texts:
            fields.append(content(n["kind"], n["token"], n["raw"], n["keep_blank"]).alias("text"))
        if strings:
            child = n["child"]
            kind = child_kind(child["token"], child["raw"])
            fields.append(F.when(n["kind"] == "tag", content(kind, child["token"], child["raw"], child["keep_blank"])).alias("string"))
        return F.struct(*fields)

    return once(rows, {"nodes": F.transform("n1", whole)}).select(*keep, "nodes")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _starts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins among the flattened values, and its length."""
    size = np.diff(lists.offsets.to_numpy())
    return np.cumsum(size) - size, size


def document_ranks(flags: pa.Array) -> pa.Array:
    """Numbers of the matches, and for every node how many there are up to it, itself included."""
    start, size = _starts(flags)
    hit = flags.flatten().to_numpy(zero_copy_only=False).astype(bool)
    total = np.concatenate([[0], np.cumsum(hit)])
    page = np.repeat(np.arange(len(size)), size)
    upto = total[1:] - total[start][page]
    number = np.arange(len(hit)) - start[page]
    return pa.StructArray.from_arrays([_lists(number[hit], total[start + size] - total[start]), _lists(upto, size)], ["hits", "upto"])


def family_ranks(flags: pa.Array, parents: pa.Array) -> pa.Array:
    """The same with the children of an element next to each other, and the ranks where a node's family begins and ends."""
    start, size = _starts(flags)
    hit = flags.flatten().to_numpy(zero_copy_only=False).astype(bool)
    parent = parents.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    page = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((parent, page))  # stable: siblings stay in document order
    total = np.concatenate([[0], np.cumsum(hit[order])])
    new = np.ones(len(order), dtype=bool)
    new[1:] = (parent[order][1:] != parent[order][:-1]) | (page[order][1:] != page[order][:-1])
    head = np.flatnonzero(new)
    family = np.cumsum(new) - 1
    base = total[start][page[order]]
    out = [np.empty(len(order), dtype=np.int64) for _ in range(3)]
    for column, values in zip(out, (total[1:] - base, total[head][family] - base, total[np.append(head[1:], len(order))][family] - base), strict=True):
        column[order] = values
    number = order - start[page[order]]
    hits = _lists(number[hit[order]], total[start + size] - total[start])
    return pa.StructArray.from_arrays([hits, *(_lists(c, size) for c in out)], ["hits", "upto", "low", "high"])


def _meets(which: Selector | Callable[[Row], Column]) -> Callable[[Column], Column]:
    """A selector, or a predicate over the fields of a node, as a test of an array's element."""
    on = which.on if isinstance(which, Selector) else which
    return lambda n: F.coalesce(on(lambda c: n[c]), F.lit(False))


Range = Callable[[Column], tuple[Column, Column]]


def _ranked(trees: DataFrame, selector: Selector | Callable[[Row], Column], context: Selector, family: bool) -> DataFrame:
    """``nodes``, the rank index of ``selector`` and ``_c``, the contexts, of every page."""
    keep = [c for c in trees.columns if c != "nodes"]
    flags = F.transform("nodes", _meets(selector))
    if family:
        index = F.arrow_udf(family_ranks, "hits ARRAY<INT>, upto ARRAY<INT>, low ARRAY<INT>, high ARRAY<INT>")
        ranks = index(flags, F.col("nodes.parent_pre"))
    else:
        ranks = F.arrow_udf(document_ranks, "hits ARRAY<INT>, upto ARRAY<INT>")(flags)
    return once(trees, {"_r": ranks, "_c": F.filter("nodes", _meets(context))}).select(*keep, "nodes", "_r.*", "_c")


def _every(trees: DataFrame, selector: Selector, context: Selector, within: Range, family: bool = False,
           limit: int | None = None, last: bool = False) -> DataFrame:
    """``ctx_pre, pre`` of the matches in each context's range of ranks; with ``limit`` the
    first of them, or the ``last``."""
    keep = [c for c in trees.columns if c != "nodes"]

    def pairs(c: Column) -> Column:
        low, high = within(c)
        if limit and last:
            low = F.greatest(low, high - limit)
        elif limit:
            high = F.least(high, low + limit)
        return F.transform(F.slice("hits", low + 1, F.greatest(high - low, F.lit(0))), lambda p: F.struct(c["pre"].alias("ctx_pre"), p.alias("pre")))

    found = _ranked(trees, selector, context, family)
    return found.select(*keep, F.inline(F.flatten(F.transform("_c", pairs))))


def _one(trees: DataFrame, selector: Selector, context: Selector, within: Range, family: bool = False, k: int = 0, last: bool = False) -> DataFrame:
    """``ctx_pre, pre`` of the k-th match in each context's range (from its end if ``last``), null where there is none."""
    keep = [c for c in trees.columns if c != "nodes"]

    def hit(c: Column) -> Column:
        low, high = within(c)
        at = high - 1 - k if last else low + k
        return F.struct(c["pre"].alias("ctx_pre"), F.when(high - low > k, F.get("hits", at)).alias("pre"))

    found = _ranked(trees, selector, context, family)
    return found.select(*keep, F.inline(F.transform("_c", hit)))


def _upto(at: Column) -> Column:
    return F.when(at < 0, 0).otherwise(F.get("upto", at))


def _below(c: Column) -> tuple[Column, Column]:
    return _upto(c["pre"]), _upto(c["post"])


def _after(c: Column) -> tuple[Column, Column]:
    return _upto(c["pre"]), F.size("hits")


def _before(c: Column) -> tuple[Column, Column]:
    return F.lit(0), _upto(c["pre"] - 1)


def _later(c: Column) -> tuple[Column, Column]:
    rank = F.get("upto", c["pre"])
    return rank, F.when(c["parent_pre"].isNull(), rank).otherwise(F.get("high", c["pre"]))


def _earlier(c: Column) -> tuple[Column, Column]:
    low, rank = F.get("low", c["pre"]), F.get("upto", c["pre"])
    itself = F.when((rank > 0) & (F.get("hits", rank - 1) == c["pre"]), 1).otherwise(0)
    return low, F.when(c["parent_pre"].isNull(), low).otherwise(rank - itself)


def find_all(trees: DataFrame, selector: Selector, context: Selector, limit: int | None = None) -> DataFrame:
    """Descendants that match, in document order."""
    return _every(trees, selector, context, _below, limit=limit)


def find(trees: DataFrame, selector: Selector, context: Selector) -> DataFrame:
    """First matching descendant of each context."""
    return _one(trees, selector, context, _below)


def nth_match(trees: DataFrame, selector: Selector, context: Selector, k: int) -> DataFrame:
    """The k-th (from 0) matching descendant of each context that has one."""
    return _one(trees, selector, context, _below, k=k).filter("pre IS NOT NULL")


def next_elements(trees: DataFrame, selector: Selector, context: Selector, limit: int | None = None) -> DataFrame:
    """Matches later in document order, descendants included."""
    return _every(trees, selector, context, _after, limit=limit)


def next_element(trees: DataFrame, selector: Selector, context: Selector) -> DataFrame:
    return _one(trees, selector, context, _after)


def previous_elements(trees: DataFrame, selector: Selector, context: Selector, limit: int | None = None) -> DataFrame:
    """Matches earlier in document order, ancestors included; with ``limit`` the nearest."""
    return _every(trees, selector, context, _before, limit=limit, last=True)


def previous_element(trees: DataFrame, selector: Selector, context: Selector) -> DataFrame:
    return _one(trees, selector, context, _before, last=True)


def next_siblings(trees: DataFrame, selector: Selector, context: Selector, limit: int | None = None) -> DataFrame:
    return _every(trees, selector, context, _later, family=True, limit=limit)


def next_sibling(trees: DataFrame, selector: Selector, context: Selector) -> DataFrame:
    return _one(trees, selector, context, _later, family=True)


def previous_siblings(trees: DataFrame, selector: Selector, context: Selector, limit: int | None = None) -> DataFrame:
    return _every(trees, selector, context, _earlier, family=True, limit=limit, last=True)


def previous_sibling(trees: DataFrame, selector: Selector, context: Selector) -> DataFrame:
    return _one(trees, selector, context, _earlier, family=True, last=True)


def node_text(trees: DataFrame, context: Selector = ANY, separator: str = "") -> DataFrame:
    """``ctx_pre, text``: all strings inside each context, trimmed and joined in document order."""
    keep = [c for c in trees.columns if c != "nodes"]
    found = _ranked(trees, lambda row: row("kind") != "tag", context, False)
    found = once(found, {"_s": F.transform("hits", lambda p: strip(F.get("nodes", p)["text"]))})

    def text(c: Column) -> Column:
        low, high = _below(c)
        return F.struct(c["pre"].alias("ctx_pre"), F.array_join(F.slice("_s", low + 1, high - low), separator).alias("text"))

    return found.select(*keep, F.inline(F.transform("_c", text)))


def merkle_digests(own: pa.Array, parents: pa.Array) -> pa.Array:
    """The digest of every node's subtree from digests of the nodes: its own, then those of
    its children in order. One pass from the last node to the first, since children follow parents."""
    out = []
    for digests, above in zip(own.to_pylist(), parents.to_pylist(), strict=True):
        below: list[list[str]] = [[] for _ in digests]
        for i in range(len(digests) - 1, -1, -1):
            digests[i] = hashlib.sha256(":".join((digests[i], *reversed(below[i]))).encode()).hexdigest()
            if above[i] is not None:
                below[above[i]].append(digests[i])
        out.append(digests)
    return pa.array(out, pa.list_(pa.string()))


def subtree_fingerprint(trees: DataFrame, context: Selector) -> DataFrame:
    """``ctx_pre, fingerprint``: equal subtrees (names, ordered attributes, strings, shape)
    get equal digests. Linear in the page, however deep contexts stand inside each other."""
    keep = [c for c in trees.columns if c != "nodes"]
    own = F.transform("nodes", lambda n: F.sha2(F.to_json(F.struct(n["kind"], n["name"], n["attrs"], n["text"])), 256))
    found = once(trees, {"_d": F.arrow_udf(merkle_digests, "ARRAY<STRING>")(own, F.col("nodes.parent_pre")), "_c": F.filter("nodes", _meets(context))})
    return found.select(*keep, F.inline(F.transform("_c", lambda c: F.struct(c["pre"].alias("ctx_pre"), F.get("_d", c["pre"]).alias("fingerprint")))))
