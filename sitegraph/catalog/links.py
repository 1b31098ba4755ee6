"""Queries: links, rules and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.catalog import query
from sitegraph.catalog.tables import dealt, pages, table
from sitegraph.functions.urls import resolve_url
from sitegraph.operators import links as L
from sitegraph.operators.mine import custom_seeker
from sitegraph.operators.select import sel

RULES = (
    L.Rule(r"https?://[^/]+/[a-m]", 1, 3600, "snapshot", ("walk",)),
    L.Rule(r".*/.*e$", 0, 60, "snapshot", ("walk",), ("words",)),
    L.Rule(r"http://.*/t", 3, 86400, "snapshot", (), ("words",), True),
    L.Rule(r".*", 5, 0, "snapshot", ("walk", "deep"), ()),
    L.Rule(r".*/[A-Z]", 0, 10, "snapshot", ("walk",), ()),
)
SEEKER = L.SeekerSpec(RULES)

_RULES_SQL = """
rules(rule_no, regex, max_hop, revisit_interval, seekers, miners, stop) AS (VALUES
  (0, '^(?:https?://[^/]+/[a-m])', 1, 3600, 'walk', '', false), (1, '^(?:.*/.*e$)', 0, 60, 'walk', 'words', false),
  (2, '^(?:http://.*/t)', 3, 86400, '', 'words', true), (3, '^(?:.*)', 5, 0, 'walk,deep', '', false),
  (4, '^(?:.*/[A-Z])', 0, 10, 'walk', '', false))
"""
_ANCHORS_SQL = r"""
anchors AS (
  SELECT page_id, url, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href FROM (
    SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h FROM pages)),
links AS (SELECT page_id, url, pos, href, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href AS link FROM anchors)
"""
_MATCHED_SQL = """
hits AS (SELECT l.*, r.* FROM links l JOIN rules r ON regexp_matches(l.link, r.regex)),
matched AS (SELECT * FROM hits h WHERE rule_no <= coalesce((SELECT min(s.rule_no) FROM hits s
  WHERE s.stop AND s.page_id = h.page_id AND s.pos = h.pos), 99)),
tasks AS (SELECT *, 2 AS hop, CASE WHEN 2 > max_hop THEN '' ELSE seekers END AS next_seekers FROM matched)
"""


def _with(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _links(spark, sf):
    return L.resolve_links(L.extract_links(pages(spark, sf)))


@query("extract_links", _with("SELECT page_id, pos, href FROM anchors", _ANCHORS_SQL))
def _extract_links(spark, sf):
    return L.extract_links(pages(spark, sf)).select("page_id", F.col("pos").cast("bigint"), "href")


@query("scoped_links", _with("""
    SELECT 'ul' AS scope, page_id, pos, href FROM anchors
    UNION ALL SELECT 'none', page_id, pos, href FROM anchors
    UNION ALL SELECT 'li', page_id, pos, href FROM anchors WHERE pos = 0""", _ANCHORS_SQL))
def _scoped_links(spark, sf):
    p, out = pages(spark, sf), None
    # the last: no page has it, so all links count; an ad block holds no links at all
    for label, scope in (("ul", sel("ul")), ("ad", sel("div", class_="ad")), ("li", sel("li")), ("none", sel("section"))):
        part = L.extract_links(p, scope).select(F.lit(label).alias("scope"), "page_id", F.col("pos").cast("bigint"), "href")
        out = part if out is None else out.unionByName(part)
    return out


_KINDS = ["x", "x/y?z=1", "/x/y", "../x", "./x#f", "//other.example/x", "?q=1", "#f", "", "http://a.example/b/../c", "../../../x/./y/..", "mailto:x@y"]


@query("resolve_url", r"""
    WITH base AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root,
      regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '(\?[^#]*)', 1) AS q FROM pages),
    b AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM base),
    u AS (SELECT *, regexp_replace(folder, '[^/]+/$', '') AS up FROM b)
    SELECT page_id, kind, CASE kind
      WHEN 'x' THEN root || folder || 'x' WHEN 'x/y?z=1' THEN root || folder || kind WHEN '/x/y' THEN root || kind
      WHEN '../x' THEN root || up || 'x' WHEN './x#f' THEN root || folder || 'x#f' WHEN '//other.example/x' THEN scheme || ':' || kind
      WHEN '?q=1' THEN root || path || kind WHEN '#f' THEN root || path || q || kind WHEN '' THEN url
      WHEN '../../../x/./y/..' THEN root || '/x/' ELSE kind END AS link
    FROM u, (VALUES ('x'), ('x/y?z=1'), ('/x/y'), ('../x'), ('./x#f'), ('//other.example/x'), ('?q=1'), ('#f'), (''),
      ('http://a.example/b/../c'), ('../../../x/./y/..'), ('mailto:x@y')) k(kind)""")
def _resolve_url(spark, sf):
    kinds = F.explode(F.array(*[F.lit(k) for k in _KINDS]))
    return pages(spark, sf).select("page_id", "url", kinds.alias("kind")).select(
        "page_id", "kind", resolve_url(F.col("url"), F.col("kind")).alias("link"))


@query("resolve_links", _with("SELECT page_id, pos, link FROM links", _ANCHORS_SQL))
def _resolve_links(spark, sf):
    return _links(spark, sf).select("page_id", F.col("pos").cast("bigint"), "link")


@query("match_rules", _with("SELECT page_id, pos, rule_no FROM hits", _ANCHORS_SQL, _RULES_SQL, _MATCHED_SQL))
def _match_rules(spark, sf):
    from dataclasses import replace

    rules = [replace(r, stop_if_matched=False) for r in RULES]
    return L.match_rules(_links(spark, sf), rules).select("page_id", F.col("pos").cast("bigint"), "rule_no")


@query("stop_if_matched", _with("SELECT page_id, pos, rule_no FROM matched", _ANCHORS_SQL, _RULES_SQL, _MATCHED_SQL))
def _stop_if_matched(spark, sf):
    return L.match_rules(_links(spark, sf), RULES).select("page_id", F.col("pos").cast("bigint"), "rule_no")


@query("hop_limit", _with("SELECT page_id, pos, rule_no, next_seekers AS seekers, miners FROM tasks", _ANCHORS_SQL, _RULES_SQL, _MATCHED_SQL))
def _hop_limit(spark, sf):
    limited = L.hop_limit(L.match_rules(_links(spark, sf), RULES), F.lit(2))
    return limited.select("page_id", F.col("pos").cast("bigint"), "rule_no",
                          F.array_join("seekers", ",").alias("seekers"), F.array_join("miners", ",").alias("miners"))


@query("drop_idle_tasks", _with("SELECT page_id, pos, rule_no FROM tasks WHERE next_seekers <> '' OR miners <> ''", _ANCHORS_SQL, _RULES_SQL, _MATCHED_SQL))
def _drop_idle_tasks(spark, sf):
    limited = L.hop_limit(L.match_rules(_links(spark, sf), RULES), F.lit(2))
    return L.drop_idle_tasks(limited).select("page_id", F.col("pos").cast("bigint"), "rule_no")


_TASK_SQL = """
SELECT page_id, pos, rule_no, '{"url":"' || link || '","revisit_interval":' || revisit_interval || ',"fetcher":"snapshot","seekers":['
  || CASE next_seekers WHEN '' THEN '' WHEN 'walk' THEN '"walk"' ELSE '"walk","deep"' END || '],"miners":['
  || CASE miners WHEN '' THEN '' ELSE '"words"' END || '],"hop":2}' AS task
FROM tasks WHERE next_seekers <> '' OR miners <> ''
"""


@query("make_tasks", _with(_TASK_SQL, _ANCHORS_SQL, _RULES_SQL, _MATCHED_SQL))
def _make_tasks(spark, sf):
    limited = L.drop_idle_tasks(L.hop_limit(L.match_rules(_links(spark, sf), RULES), F.lit(2)))
    tasks = L.make_tasks(limited, ["page_id", "pos", "rule_no"])
    return tasks.select("page_id", F.col("pos").cast("bigint"), "rule_no", L.task_json(tasks).alias("task"))


_SEEK_SQL = _with("SELECT page_id, pos, rule_no, link AS url, next_seekers AS seekers, miners, hop FROM tasks WHERE next_seekers <> '' OR miners <> ''",
                  _ANCHORS_SQL, _RULES_SQL, _MATCHED_SQL)


def _task_rows(tasks):
    return tasks.select("page_id", F.col("pos").cast("bigint"), "rule_no", "url",
                        F.array_join("seekers", ",").alias("seekers"), F.array_join("miners", ",").alias("miners"), "hop")


@query("seek", _SEEK_SQL)
def _seek(spark, sf):
    return _task_rows(L.seek(pages(spark, sf), SEEKER, hop=1))


@query("seek_many", _with("""
    SELECT 'all' AS seeker, page_id, pos, rule_no FROM tasks WHERE next_seekers <> '' OR miners <> ''
    UNION ALL SELECT 'first', page_id, pos, rule_no FROM tasks WHERE pos = 0 AND (next_seekers <> '' OR miners <> '')""",
    _ANCHORS_SQL, _RULES_SQL, _MATCHED_SQL))
def _seek_many(spark, sf):
    both = {"all": SEEKER, "first": L.SeekerSpec(RULES, sel("li"))}
    return L.seek_many(pages(spark, sf), both, hop=1).select("seeker", "page_id", F.col("pos").cast("bigint"), "rule_no")


@query("seek_report", _with("""
    SELECT page_id, pos, rule_no, link AS url, 1 AS hop FROM matched
    WHERE miners <> '' OR (seekers <> '' AND max_hop >= 1)""", _ANCHORS_SQL, _RULES_SQL, _MATCHED_SQL))
def _seek_report(spark, sf):
    report = L.seek_report(pages(spark, sf), SEEKER)
    return report.select("page_id", F.col("pos").cast("bigint"), "rule_no", F.get_json_object("task", "$.url").alias("url"),
                         F.get_json_object("task", "$.hop").cast("int").alias("hop"))


@query("custom_seeker", _SEEK_SQL)
def _custom_seeker(spark, sf):
    return _task_rows(custom_seeker(pages(spark, sf), lambda p: L.seek(p, SEEKER, hop=1)))


@query("match_rule_table", _with("SELECT page_id, pos, CAST(rule_no AS INT) AS rule_no FROM matched", _ANCHORS_SQL, _RULES_SQL, _MATCHED_SQL))
def _match_rule_table(spark, sf):
    from sitegraph.schemas import RULE

    # the same rules under three names, pages take turns
    rows = [(f"set{k}", n, r.regex, r.max_hop, r.revisit_interval, r.fetcher, list(r.seekers), list(r.miners), r.stop_if_matched)
            for k in range(3) for n, r in enumerate(RULES)]
    links = _links(spark, sf).withColumn("rule_set", F.concat(F.lit("set"), (F.col("page_id") % 3).cast("string")))
    matched = L.match_rule_table(links, spark.createDataFrame(rows, RULE))
    return matched.select("page_id", F.col("pos").cast("bigint"), "rule_no")


@query("match_many_rules", """
    SELECT l_orderkey, l_linenumber, CAST(l_partkey AS INT) AS rule_no FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 2000000000 FROM lineitem WHERE l_partkey % 3 <> 0 OR l_partkey % 100 = 0""")
def _match_many_rules(spark, sf):
    # a rule for each part, a thousand to a set, and one that all links of a set match;
    # every third stops, every hundredth begins with no literal text
    key = F.col("p_partkey").cast("string")
    part = table(spark, sf, "part")
    open_end, free = F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 100 == 0
    regex = F.when(free, F.concat(F.lit(".*/"), key, F.lit("$"))).when(
        open_end, F.concat(F.lit("^/part/"), key, F.lit(r"(?:\?.*|/.*)?$"))).otherwise(F.concat(F.lit("/part/"), key, F.lit("$")))
    thousand = F.floor(F.col("p_partkey") / 1000).cast("string")

    def rule(no, pattern, stop):
        return F.struct(no.cast("int").alias("rule_no"), pattern.alias("regex"), stop.alias("stop_if_matched"))

    own = part.select(thousand.alias("rule_set"), F.inline(F.array(rule(F.col("p_partkey"), regex, ~open_end & ~free))))
    shared = part.select(thousand.alias("rule_set")).distinct().select(
        "rule_set", F.inline(F.array(rule(F.lit(2000000000), F.lit("/part/"), F.lit(False)))))
    links = dealt(table(spark, sf, "lineitem"), "l_orderkey").select(
        "l_orderkey", "l_linenumber", F.floor(F.col("l_partkey") / 1000).cast("string").alias("rule_set"),
        F.concat(F.lit("/part/"), F.col("l_partkey").cast("string")).alias("link"))
    return L.match_rule_table(links, own.unionByName(shared)).select("l_orderkey", "l_linenumber", "rule_no")
