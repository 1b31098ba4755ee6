"""Field mining: declarative descriptions of records on pages.

A description names, per field, a chain of selectors. One pass over the nodes
keeps the few that any selector wants; they meet in one row per page (built
completely before the shuffle, as a page's nodes share a task), and all fields
are Column expressions on that row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions.once import once
from sitegraph.functions.text import indent_json, pretty_json
from sitegraph.operators.page_tree import page_nodes
from sitegraph.operators.select import Selector
from sitegraph.schemas import DETAILS, IMAGES, PRODUCT_FIELDS

Post = Callable[[Column], Column]


@dataclass(frozen=True)
class Step:
    """The ``k``-th match (from 0) inside the node reached so far."""

    selector: Selector
    k: int = 0


def path(*steps: Selector | Step) -> tuple[Step, ...]:
    return tuple(s if isinstance(s, Step) else Step(s) for s in steps)


@dataclass(frozen=True)
class Field:
    """``take`` is ``string``, ``text`` or an attribute as ``@name``.

    The first ``required`` steps must match or the field fails; a later gap only
    leaves the field out. ``null_fails``: an element without a single string, too.
    """

    name: str
    path: tuple[Step, ...]
    take: str = "string"
    required: int | None = None
    null_fails: bool = False
    post: Post | None = None


@dataclass(frozen=True)
class FirstOf:
    """The first alternative whose ``when`` path matches decides; none fails."""

    name: str
    options: tuple[tuple[tuple[Step, ...], Field | str], ...]


@dataclass(frozen=True)
class Joined:
    """Strings of all matches, joined; a match without one string fails the field."""

    name: str
    path: tuple[Step, ...]
    items: Selector
    required: int = 0
    separator: str = ", "


@dataclass(frozen=True)
class Images:
    """Attribute of all matches, numbered; ``kinds`` gives (kind, rewrite) per image."""

    path: tuple[Step, ...]
    items: Selector
    attr: str
    first_no: int
    kinds: tuple[tuple[str, Post | None], ...]


@dataclass(frozen=True)
class TextImages:
    """Pattern hits in the blank-separated words of the first matching string."""

    text: Selector
    pattern: str
    first_no: int
    kind: str


@dataclass(frozen=True)
class Details:
    """``title`` and string of all matches that have a title."""

    name: str
    path: tuple[Step, ...]
    items: Selector
    post: Post


@dataclass(frozen=True)
class Count:
    name: str
    path: tuple[Step, ...]
    items: Selector


Item = Field | FirstOf | Joined | Images | TextImages | Details | Count


@dataclass(frozen=True)
class Group:
    """Items in order; the first that fails adds ``error`` and ends the group."""

    error: str
    items: tuple[Item, ...]


@dataclass(frozen=True)
class MineSpec:
    site: str
    groups: tuple[Group, ...]


def numbered_images(values: Column, first_no: int, kinds: Sequence[tuple[str, Post | None]]) -> Column:
    """``ARRAY<STRUCT<no, kind, src>>`` from image addresses."""
    def one(v: Column, i: Column) -> Column:
        return F.array(*[
            F.struct((i + first_no).cast("int").alias("no"), F.lit(kind).alias("kind"),
                     (post(v) if post else v).alias("src"))
            for kind, post in kinds
        ])

    return F.flatten(F.transform(values, one))


def full_image_url(src: Column) -> Column:
    """Address of the full picture behind a thumbnail."""
    return F.regexp_replace(src, r"_\d+x\d+\.jpg$", "")


def size_list(strings: Column, separator: str = ", ") -> Column:
    """Joined strings, null if any is missing (a plain join would skip it)."""
    return F.when(F.forall(strings, lambda s: s.isNotNull()), F.array_join(strings, separator))


_WORD = 60


def _asked(selector: Selector) -> list[str] | None:
    """The names that a selector asks for, None if it may meet any."""
    wanted = [selector.name] if isinstance(selector.name, str) else selector.name
    return [str(name) for name in wanted] if isinstance(wanted, (list, tuple, set, dict)) else None


class _Plan:
    """Compiles a description to columns over ``c``, the page's candidate array."""

    def __init__(self) -> None:
        self.selectors: list[Selector] = []
        self.attrs: list[str] = []
        self.stages: list[tuple[str, Column]] = []
        self.known: dict[tuple, str] = {}

    def bit(self, selector: Selector) -> int:
        for n, s in enumerate(self.selectors):
            if s is selector:
                return n
        self.selectors.append(selector)
        return len(self.selectors) - 1

    def masks(self, row: Callable[[str], Column], names: set[str] | None) -> list[Column]:
        """Which selectors a node meets: a bit each, ``_WORD`` to a number.

        Where all selectors ask for names, a node is only compared with those of its own name.
        """
        def bits(first: int, name: str | None) -> Column:
            word = F.lit(0).cast("bigint")
            for n, s in enumerate(self.selectors[first:first + _WORD]):
                if name is None or name in _asked(s):
                    word = word + F.when(s.on(row), F.lit(1 << n)).otherwise(F.lit(0)).cast("bigint")
            return word

        firsts = range(0, max(1, len(self.selectors)), _WORD)
        if names is None:
            return [bits(first, None) for first in firsts]
        words = []
        for first in firsts:
            cases = F.lit(0).cast("bigint")
            for name in sorted(names, reverse=True):
                cases = F.when(row("name") == name, bits(first, name)).otherwise(cases)
            words.append(cases)
        return words

    def possible(self) -> set[str] | None:
        """The names of elements that selectors ask for; None where one asks for anything else."""
        names: set[str] = set()
        for s in self.selectors:
            wanted = _asked(s)
            if s.text is not None or wanted is None:
                return None
            names.update(wanted)
        return names

    def attr(self, key: str) -> str:
        if key not in self.attrs:
            self.attrs.append(key)
        return f"a{self.attrs.index(key)}"

    def inside(self, node: str | None, selector: Selector) -> Column:
        word, n = divmod(self.bit(selector), _WORD)

        def hit(x: Column) -> Column:
            found = x[f"m{word}"].bitwiseAND(F.lit(1 << n).cast("bigint")) != 0
            if node is None:
                return found
            return found & (x["pre"] > F.col(f"{node}.pre")) & (x["pre"] <= F.col(f"{node}.post"))

        return F.filter("c", hit)

    def step(self, node: str | None, step: Step) -> str:
        key = (node, id(step.selector), step.k)
        if key not in self.known:
            name = f"_n{len(self.known)}"
            self.stages.append((name, F.get(self.inside(node, step.selector), F.lit(step.k))))
            self.known[key] = name
        return self.known[key]

    def hold(self, column: Column) -> str:
        """A column of its own for what is used more than once."""
        name = f"_h{len(self.stages)}"
        self.stages.append((name, column))
        return name

    def walk(self, steps: Iterable[Step]) -> list[str]:
        reached: list[str] = []
        for s in steps:
            reached.append(self.step(reached[-1] if reached else None, s))
        return reached

    def take(self, node: str, what: str) -> Column:
        return F.col(f"{node}.{self.attr(what[1:]) if what.startswith('@') else 's'}")

    def all(self, steps: tuple[Step, ...], items: Selector) -> tuple[list[str], Column]:
        reached = self.walk(steps)
        return reached, F.col(self.hold(self.inside(reached[-1] if reached else None, items)))


def _present(names: Sequence[str]) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull()
    return ok


def _field(plan: _Plan, f: Field) -> tuple[dict[str, Column], Column]:
    reached = plan.walk(f.path)
    required = len(reached) if f.required is None else f.required
    ok = _present(reached[:required])
    value = plan.take(reached[-1], f.take)
    if f.take.startswith("@") or f.null_fails:
        ok = ok & (F.col(reached[-1]).isNull() | value.isNotNull())
    return {f.name: f.post(value) if f.post else value}, ok


def _first_of(plan: _Plan, f: FirstOf) -> tuple[dict[str, Column], Column]:
    value, ok = F.lit(None).cast("string"), F.lit(False)
    for when, then in reversed(f.options):
        found = _present(plan.walk(when))
        if isinstance(then, str):
            this, this_ok = F.lit(then), F.lit(True)
        else:
            columns, this_ok = _field(plan, then)
            this = columns[then.name]
        value = F.when(found, this).otherwise(value)
        ok = F.when(found, this_ok).otherwise(ok)
    return {f.name: value}, ok


def _joined(plan: _Plan, f: Joined) -> tuple[dict[str, Column], Column]:
    reached, items = plan.all(f.path, f.items)
    strings = F.col(plan.hold(F.transform(items, lambda x: x["s"])))
    some = (F.size(items) > 0) & _present(reached)
    return {f.name: F.when(some, size_list(strings, f.separator))}, \
        _present(reached[:f.required]) & (~some | F.forall(strings, lambda s: s.isNotNull()))


def _images(plan: _Plan, f: Images) -> tuple[dict[str, Column], Column]:
    reached, items = plan.all(f.path, f.items)
    field = plan.attr(f.attr)
    values = F.col(plan.hold(F.transform(items, lambda x: x[field])))
    # one without the attribute ends the list; those before it are kept
    gap = F.col(plan.hold(F.array_position(F.transform(values, lambda v: v.isNull()), True)))
    whole = F.when(gap > 0, F.slice(values, F.lit(1), (gap - 1).cast("int"))).otherwise(values)
    return {"images": numbered_images(whole, f.first_no, f.kinds)}, _present(reached) & (gap == 0)


def _text_images(plan: _Plan, f: TextImages) -> tuple[dict[str, Column], Column]:
    node = plan.step(None, Step(f.text))
    words = F.split(F.col(f"{node}.s"), r"\s+")
    hits = F.filter(F.transform(words, lambda w: F.regexp_extract(w, f.pattern, 0)), lambda h: h != "")
    return {"images": numbered_images(hits, f.first_no, ((f.kind, None),))}, F.col(node).isNotNull()


def _details(plan: _Plan, f: Details) -> tuple[dict[str, Column], Column]:
    reached, items = plan.all(f.path, f.items)
    title = plan.attr("title")
    titled = F.col(plan.hold(F.filter(items, lambda x: x[title].isNotNull())))
    whole = F.col(plan.hold(F.forall(titled, lambda x: x["s"].isNotNull()) & _present(reached)))
    pairs = F.transform(titled, lambda x: F.struct(x[title].alias("attr_name"), f.post(x["s"]).alias("attr_value")))
    return {f.name: F.when(whole, pairs)}, whole


def _count(plan: _Plan, f: Count) -> tuple[dict[str, Column], Column]:
    reached, items = plan.all(f.path, f.items)
    return {f.name: F.size(items)}, _present(reached)


_BUILD = {
    Field: _field, FirstOf: _first_of, Joined: _joined, Images: _images,
    TextImages: _text_images, Details: _details, Count: _count,
}


def field_errors(failed: Sequence[tuple[Column, str]]) -> Column:
    """Messages of the failed groups, in order; a failure never loses the record."""
    return F.concat(F.lit(""), *[F.when(bad, F.lit(text)).otherwise(F.lit("")) for bad, text in failed])


def mine(pages: DataFrame, spec: MineSpec, keep: Iterable[str] = ("page_id", "url"),
         html: str = "html") -> DataFrame:
    """One record per page: ``keep`` columns, ``site``, ``error`` and the fields."""
    keep = list(keep)
    plan = _Plan()
    values: dict[str, list[Column]] = {}
    failed: list[tuple[Column, str]] = []
    for group in spec.groups:
        fine = F.lit(True)
        for item in group.items:
            columns, ok = _BUILD[type(item)](plan, item)
            for name, value in columns.items():
                kept = fine if isinstance(item, (Images, TextImages)) else fine & ok
                values.setdefault(name, []).append(F.when(kept, value))
            fine = fine & ok
        failed.append((~fine, group.error))

    names = plan.possible()
    # a page stays one row: pages may share all of ``keep``, as snapshots of a URL do
    def candidate(n: Column) -> Column:
        return F.struct(
            n["pre"].alias("pre"), n["post"].alias("post"), *[m.alias(f"m{i}") for i, m in enumerate(plan.masks(lambda c: n[c], names))],
            (n["string"] if names is not None else F.when(n["kind"] == "tag", n["string"]).otherwise(n["text"])).alias("s"),
            *[n["attr"][k].alias(f"a{i}") for i, k in enumerate(plan.attrs)])

    trees = page_nodes(pages, html=html, keep=keep, strings=True, texts=names is None, names=names)
    def met_any(n: Column) -> Column:
        found = n["pre"] == 0
        for first in range(0, max(1, len(plan.selectors)), _WORD):
            found = found | (n[f"m{first // _WORD}"] != 0)
        return found

    page = once(trees, {"c": F.filter(F.transform("nodes", candidate), met_any)}).select(*keep, "c")
    for name, column in plan.stages:
        page = page.withColumn(name, column)
    return page.select(
        *keep, F.lit(spec.site).alias("site"), field_errors(failed).alias("error"),
        *[F.coalesce(*v).alias(name) for name, v in values.items()],
    )


def as_products(records: DataFrame) -> DataFrame:
    """Records of any site in the common product shape."""
    have = set(records.columns)
    return records.select(
        "url", "site", "error",
        *[(F.col(f).cast("string") if f in have else F.lit(None).cast("string")).alias(f) for f in PRODUCT_FIELDS],
        (F.col("prod_details") if "prod_details" in have else F.lit(None).cast(DETAILS)).alias("prod_details"),
        (F.coalesce("images", F.array().cast(IMAGES)) if "images" in have else F.array().cast(IMAGES)).alias("images"),
    )


def product_json(pretty: bool = False) -> Column:
    """A product as one JSON object with the keys its site uses: fields that are
    there, and ``prod_img_<kind>_<no>`` per image."""
    scalars = F.map_filter(
        F.create_map(*[x for f in ("url", "error", *PRODUCT_FIELDS) for x in (F.lit(f), F.col(f))]),
        lambda k, v: v.isNotNull())
    images = F.map_from_entries(F.transform("images", lambda i: F.struct(
        F.concat(F.lit("prod_img_"), i["kind"], F.lit("_"), i["no"].cast("string")), i["src"])))
    flat = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(scalars, images)))))
    nested = F.concat(F.regexp_replace(flat, r"\}$", ',"prod_details":'), F.to_json("prod_details"), F.lit("}"))
    line = F.when(F.col("prod_details").isNull(), flat).otherwise(nested)
    return indent_json(line, sort_keys=True) if pretty else line


def mine_url(pages: DataFrame) -> DataFrame:
    """The base miner: one record per page with just its URL."""
    return pages.select("url")


def mine_regex(pages: DataFrame, patterns: dict[str, str], keep: Iterable[str] = ("url",), html: str = "html") -> DataFrame:
    """Fields by pattern (group 1) on the body markup; a record needs all of them."""
    body = F.regexp_extract(html, r"(?is)<body(?:\s[^>]*)?>(.*?)(?:</body\s*>|\z)", 1)
    found = pages.select(*keep, body.alias("_b")).select(
        *keep, *[F.nullif(F.regexp_extract("_b", p, 1), F.lit("")).alias(n) for n, p in patterns.items()])
    return found.dropna(subset=list(patterns))


def mine_many(parts: Sequence[DataFrame]) -> DataFrame:
    """Records of several miners, concatenated."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def mine_report(products: DataFrame) -> DataFrame:
    """Records as readable JSON with sorted keys."""
    return products.select("url", product_json(pretty=True).alias("record"))


def record_report(records: DataFrame) -> DataFrame:
    return records.select(pretty_json(F.struct(*sorted(records.columns))).alias("record"))


def custom_miner(pages: DataFrame, extract: Callable[[pa.RecordBatch], pa.Table], schema: str) -> DataFrame:
    """Hook for a miner in Python, as a table function: ``extract`` gets a batch of page rows and
    gives the table of their records, any number per page, with the columns of ``schema``."""

    @F.arrow_udtf(returnType=schema)
    class Miner:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            yield extract(batch)

    return Miner(pages.asTable())


def custom_seeker(pages: DataFrame, inspect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Hook for a seeker: a function from pages to tasks."""
    return pages.transform(inspect)
