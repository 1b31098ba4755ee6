"""Links of pages, and the tasks that crawl rules make of them.

Everything here is local to a page row or a link row: no shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions.once import once, present
from sitegraph.functions.text import pretty_json, strip
from sitegraph.functions.urls import resolve_url
from sitegraph.operators.html_nodes import attr_value, html_tokens
from sitegraph.operators.page_tree import page_nodes
from sitegraph.operators.select import Selector
from sitegraph.schemas import TASK_COLUMNS


@dataclass(frozen=True)
class Rule:
    """Which URLs to follow (``seekers``) or mine (``miners``), and how often."""

    regex: str
    max_hop: int
    revisit_interval: int = 0
    fetcher: str = "snapshot"
    seekers: tuple[str, ...] = ()
    miners: tuple[str, ...] = ()
    stop_if_matched: bool = False


@dataclass(frozen=True)
class SeekerSpec:
    """A rule list, optionally only for links inside the first ``scope`` element."""

    rules: Sequence[Rule] = field(default_factory=tuple)
    scope: Selector | None = None


def extract_links(pages: DataFrame, scope: Selector | None = None,
                  keep: Iterable[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``href`` of every anchor that has one, trimmed, with its ``pos``.

    Anchors need no nesting, so tokens suffice and all of it stays in the JVM.
    With ``scope`` only anchors inside the first matching element count; a page
    without such an element contributes all its anchors.
    """
    keep = list(keep)
    if scope is None:
        anchors = html_tokens(pages, html=html, keep=keep, names=["a"]).filter("kind = 'start'")
        # an anchor without these letters has no such attribute, and its others need no reading
        anchors = anchors.filter(F.col("raw").rlike("(?i)href"))
        anchors = present(anchors, "href", attr_value(F.col("raw"), "a", "href"))
    else:
        anchors = _scoped_anchors(pages, scope, keep, html).filter("href IS NOT NULL")
    return anchors.select(*keep, "pos", strip(F.col("href")).alias("href"))


def _scoped_anchors(pages: DataFrame, scope: Selector, keep: list[str], html: str) -> DataFrame:
    """Scope and anchors of a page are looked for in its own row; attributes are computed
    for elements that may be either."""
    def wanted(row: Callable[[str], Column]) -> Column:
        named = row("name").isin("a", scope.name) if isinstance(scope.name, str) else F.lit(True)
        return (row("kind") == "tag") & (row("pre") > 0) & named

    trees = page_nodes(pages, html=html, keep=keep, only=wanted, texts=False)
    first = F.get(F.filter("nodes", lambda n: F.coalesce(scope.on(lambda c: n[c]), F.lit(False))), F.lit(0))
    trees = once(trees, {"_scope": first})
    anchors = F.filter("nodes", lambda n: (n["name"] == "a") & (F.col("_scope").isNull() | (
        (n["pre"] > F.col("_scope.pre")) & (n["pre"] <= F.col("_scope.post")))))
    return trees.select(*keep, F.posexplode_outer(F.transform(anchors, lambda n: n["attr"]["href"])).alias("pos", "href"))


def resolve_links(links: DataFrame, base: str = "url") -> DataFrame:
    """Adds ``link``: the absolute form against the final page URL."""
    return once(links, {"link": resolve_url(F.col(base), F.col("href"))})


def anchored(regex: str) -> str:
    """Match from the start, open at the end."""
    return f"^(?:{regex})"


def _rule_struct(no: int, rule: Rule) -> Column:
    def names(values: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return F.struct(
        F.lit(no).alias("rule_no"), F.lit(rule.max_hop).alias("max_hop"),
        F.lit(rule.revisit_interval).cast("bigint").alias("revisit_interval"),
        F.lit(rule.fetcher).alias("fetcher"), names(rule.seekers).alias("seekers"),
        names(rule.miners).alias("miners"), F.lit(rule.stop_if_matched).alias("stop"),
    )


def rule_array(rules: Sequence[Rule]) -> Column:
    """The rules as a constant array, in list order."""
    return F.array(*[_rule_struct(n, r) for n, r in enumerate(rules)])


def match_rules(links: DataFrame, rules: Sequence[Rule], url: str = "link") -> DataFrame:
    """One row per (link, matching rule); a matching rule with ``stop_if_matched``
    hides the later ones. Rules come from a job description and are literal
    patterns in the plan, compiled once per task."""
    found = [F.when(F.col(url).rlike(anchored(r.regex)), _rule_struct(n, r)) for n, r in enumerate(rules)]
    hits = F.filter(F.array(*found), lambda r: r.isNotNull())
    if any(r.stop_if_matched for r in rules):
        stops = F.filter(hits, lambda r: r["stop"])
        last = F.coalesce(F.try_element_at(stops, F.lit(1))["rule_no"], F.lit(len(rules)))
        hits = F.filter(hits, lambda r: r["rule_no"] <= last)
    return links.withColumn("rule", F.explode_outer(hits)).filter("rule IS NOT NULL") \
        .select(*links.columns, "rule.*").drop("stop")


def matching_rules(url: Column, rules: Sequence[Rule]) -> Column:
    """The numbers of the rules that ``match_rules`` finds, as an array."""
    found = [F.when(url.rlike(anchored(r.regex)), F.lit(n)) for n, r in enumerate(rules)]
    hits = F.array_except(F.array(*found).cast("array<int>"), F.array(F.lit(None).cast("int")))
    if any(r.stop_if_matched for r in rules):
        stops = [n for n, r in enumerate(rules) if r.stop_if_matched]
        last = F.coalesce(F.array_min(F.filter(hits, lambda n: n.isin(*stops))), F.lit(len(rules)))
        hits = F.filter(hits, lambda n: n <= last)
    return hits


_META = r"\\\[\](){}.*+?^$|"
_LITERAL = rf"^\^?((?:(?:[^{_META}]|\\[^A-Za-z0-9])(?![*?{{]))*)"


def literal_prefix(regex: Column) -> Column:
    """Text with which every match must begin; empty where the pattern names none, or
    where alternatives stand outside of groups."""
    outer = F.regexp_replace(F.regexp_replace(regex, r"(?s)\\.", ""), r"\[[^\]]*\]", "")
    for _ in range(6):
        outer = F.regexp_replace(outer, r"\([^()]*\)", "")
    found = F.regexp_replace(F.regexp_extract(regex, _LITERAL, 1), r"(?s)\\(.)", "$1")
    unclear = outer.contains("|") | regex.contains("\\Q") | regex.isNull()
    return F.when(unclear, "").otherwise(found)


def rule_index(rules: DataFrame, on: str = "rule_set") -> DataFrame:
    """One row per rule set: its rules in as many slots (``_slots``) as there are rules, by
    the hash of their literal prefix, and the lengths that prefixes have."""
    fields = ["rule_no", *[c for c in rules.columns if c not in (on, "rule_no")]]
    sized = rules.groupBy(on).agg(F.count("*").alias("_m"))
    placed = rules.select(on, F.struct(*fields).alias("_rule"), literal_prefix(F.col("regex")).alias("_prefix"))
    placed = placed.join(sized, on).withColumn("_slot", _slot(F.col("_prefix"), F.col("_m")))
    held = placed.groupBy(on, "_slot").agg(
        F.collect_list(F.struct("_rule", "_prefix")).alias("_held"), F.collect_set(F.length("_prefix")).alias("_sizes"))
    every = sized.select(on, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)).alias("_slot"))
    slots = every.join(held, [on, "_slot"], "left").groupBy(on).agg(
        F.array_sort(F.collect_list(F.struct("_slot", "_held"))).alias("_all"),
        F.array_distinct(F.flatten(F.collect_list("_sizes"))).alias("_lengths"))
    return slots.select(on, F.col("_all._held").alias("_slots"), "_lengths")


#: characters of all rules, as JSON, up to which every executor gets them
COPIED = 8 << 20


def _slot(prefix: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(prefix), slots.cast("bigint"))


def match_rule_table(links: DataFrame, rules: DataFrame, url: str = "link", on: str = "rule_set") -> DataFrame:
    """Same with rules from a table, e.g. one rule set per store: links carry the
    name of their rule set. ``stop_if_matched`` is applied per link.

    The rules of a set travel as one row, so a link meets them in one join, and
    matching and stopping happen inside its row. A link is compared with those rules
    only whose literal prefix it begins with: one look into the set's slots for each
    length that prefixes have. Rules without such a prefix meet every link. The rules'
    size is summed up first: up to ``COPIED`` characters they go to the links, or a small
    link table would go to the few tasks that hold rules; beyond it Spark chooses.
    """
    index = rule_index(rules, on)
    size = rules.agg(F.sum(F.length(F.to_json(F.struct(*rules.columns))))).head()[0]
    met = links.join(F.broadcast(index) if (size or 0) <= COPIED else index, on)

    def begun(length: Column) -> Column:
        head = F.left(F.col(url), length)
        slot = F.get("_slots", _slot(head, F.size("_slots")).cast("int"))
        return F.coalesce(F.filter(slot, lambda r: r["_prefix"] == head)["_rule"], F.array())

    likely = F.flatten(F.transform(F.filter("_lengths", lambda n: n <= F.length(url)), begun))
    met = once(met, {"_likely": F.when(F.col(url).isNotNull(), likely)})
    hits = F.filter("_likely", lambda r: F.regexp_like(F.col(url), F.concat(F.lit("^(?:"), r["regex"], F.lit(")"))))
    met = once(met, {"_hits": F.array_sort(hits)})
    stop = F.get(F.filter("_hits", lambda r: r["stop_if_matched"]), F.lit(0))["rule_no"]
    met = met.withColumn("_stop", stop)
    kept = F.filter("_hits", lambda r: F.col("_stop").isNull() | (r["rule_no"] <= F.col("_stop")))
    return met.select(on, *[c for c in links.columns if c != on], F.inline(kept))


def hop_limit(matched: DataFrame, hop: Column) -> DataFrame:
    """Beyond ``max_hop`` a link is not followed further; it may still be mined."""
    nothing = F.array().cast("array<string>")
    return matched.withColumn("hop", hop).withColumn(
        "seekers", F.when(F.col("hop") > F.col("max_hop"), nothing).otherwise(F.col("seekers")))


def drop_idle_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.size("seekers") + F.size("miners") > 0)


def make_tasks(matched: DataFrame, keep: Iterable[str] = (), url: str = "link") -> DataFrame:
    keep = list(keep)
    shaped = matched.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
                            F.col(url).alias("url"), *TASK_COLUMNS[1:])
    return shaped.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep) if c != "url"], *TASK_COLUMNS)


def task_json(tasks: DataFrame) -> Column:
    return F.to_json(F.struct(*[tasks[c] for c in TASK_COLUMNS]))


def seek(pages: DataFrame, seeker: SeekerSpec, hop: Column | int = 0,
         keep: Iterable[str] = ("page_id",), html: str = "html") -> DataFrame:
    """Tasks found on pages; ``hop`` is the distance of the page itself."""
    keep = list(keep)
    carried = [*keep, "url", "hop"]
    hop = hop if isinstance(hop, Column) else F.lit(hop)
    links = resolve_links(extract_links(pages.withColumn("hop", hop), seeker.scope, carried, html))
    links = links.filter("link <> ''").withColumnRenamed("hop", "_hop").withColumnRenamed("url", "src_url")
    matched = match_rules(links, seeker.rules)
    tasks = drop_idle_tasks(hop_limit(matched, F.col("_hop") + 1))
    return make_tasks(tasks, [*keep, "src_url", "pos", "rule_no"])


def seek_many(pages: DataFrame, seekers: dict[str, SeekerSpec], **options: object) -> DataFrame:
    """Several seekers over the same pages, results concatenated."""
    out: DataFrame | None = None
    for no, (name, spec) in enumerate(seekers.items()):
        part = seek(pages, spec, **options).withColumns({"seeker": F.lit(name), "seeker_no": F.lit(no)})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no seekers")
    return out


def seek_report(pages: DataFrame, seeker: SeekerSpec, url: str | None = None) -> DataFrame:
    """What the rules make of one page (or each page) at hop 0, as readable JSON."""
    chosen = pages if url is None else pages.filter(F.col("url") == url)
    tasks = seek(chosen, seeker)
    return tasks.select("page_id", "pos", "rule_no", pretty_json(F.struct(*TASK_COLUMNS)).alias("task"))
