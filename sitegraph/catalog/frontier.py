"""Queries: frontier and crawl."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.catalog import query
from sitegraph.catalog.history import past_state, state_sql, with_events, _UPTO
from sitegraph.catalog.links import _ANCHORS_SQL
from sitegraph.catalog.tables import EDGES_SQL, graph_edges, pages, table
from sitegraph.operators import frontier as Q
from sitegraph.operators.links import Rule, SeekerSpec, extract_links, resolve_links
from sitegraph.operators.mine import Field, Group, MineSpec, Step
from sitegraph.operators.select import sel
from sitegraph.plans.crawl import crawl, mine_visits
from sitegraph.session import cut_lineage, run_folder
from sitegraph.sources.jobs import JobSpec

RULES = (
    Rule(r"^/region/", 5, 0, "snapshot", ("walk",)),
    Rule(r"^/nation/", 5, 0, "snapshot", ("walk",)),
    Rule(r"^/supplier/", 3, 0, "snapshot", ("walk",)),
    Rule(r"^/part/", 1, 0, "snapshot", (), ("part",)),
)
SHORT = (
    Rule(r"^/region/|^/nation/", 5, 0, "snapshot", ("walk",)),
    Rule(r"^/supplier/", 2, 0, "snapshot", ("walk",), ("supplier",)),
    Rule(r"^/part/", 9, 0, "snapshot", (), ("part",)),
)


def _walk(spark, sf, rules):
    links = graph_edges(spark, sf).select("src_url", F.lit("walk").alias("seeker"), F.lit(0).alias("pos"),
                                          F.col("dst_url").alias("link"))
    seed = {"url": "/", "seekers": ["walk"], "hop": 0}
    return crawl(spark, JobSpec("graph", (seed,), {"walk": SeekerSpec(rules)}), links=links)


_REACH = EDGES_SQL + """,
reach(url, hop) AS (
  SELECT '/', 0 UNION
  SELECT e.dst_url, r.hop + 1 FROM reach r JOIN edges e ON e.src_url = r.url
  WHERE {stop} AND r.hop < 8 AND e.dst_url <> '/'),
first AS (SELECT url, min(hop) AS hop FROM reach GROUP BY url)
"""


@query("crawl", "WITH RECURSIVE " + _REACH.format(stop="r.url NOT LIKE '/part/%'") + """
    SELECT url, hop, CASE WHEN url LIKE '/part/%' THEN '' ELSE 'walk' END AS seekers,
      CASE WHEN url LIKE '/part/%' THEN 'part' ELSE '' END AS miners, '' AS status_code FROM first""")
def _crawl(spark, sf):
    return _walk(spark, sf, RULES).visits.select(
        "url", "hop", F.array_join("seekers", ",").alias("seekers"), F.array_join("miners", ",").alias("miners"), "status_code")


@query("crawl_hop_cut", "WITH RECURSIVE " + _REACH.format(stop="r.url NOT LIKE '/supplier/%'") + """
    SELECT url, hop, CASE WHEN url LIKE '/supplier/%' THEN '' ELSE 'walk' END AS seekers FROM first""")
def _crawl_hop_cut(spark, sf):
    return _walk(spark, sf, SHORT).visits.select("url", "hop", F.array_join("seekers", ",").alias("seekers"))


@query("crawl_hops", "WITH RECURSIVE " + _REACH.format(stop="r.url NOT LIKE '/part/%'") + "SELECT url, hop FROM first")
def _crawl_hops(spark, sf):
    return Q.crawl_hops(_walk(spark, sf, RULES).visits)


_TASKS_SQL = """
tasks AS (SELECT 'https://shop.example/item/' || user_id || '-' || (event_id % 8) AS url, event_id % 5 AS hop, event_id AS seq, event_type AS miner FROM events)
"""


def _tasks(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("https://shop.example/item/"), F.col("user_id").cast("string"), F.lit("-"),
                 (F.col("event_id") % 8).cast("string")).alias("url"),
        (F.col("event_id") % 5).alias("hop"), F.col("event_id").alias("seq"), F.col("event_type").alias("miner"))


@query("dedup_visits", f"WITH {_TASKS_SQL} SELECT * FROM tasks QUALIFY row_number() OVER (PARTITION BY url ORDER BY hop, seq) = 1")
def _dedup_visits(spark, sf):
    return Q.dedup_visits(_tasks(spark, sf))


@query("frontier_batch", f"""WITH {_TASKS_SQL} SELECT url, seq, CASE WHEN row_number() OVER (ORDER BY seq) <= 4321 THEN 1 ELSE 0 END AS taken FROM tasks""")
def _frontier_batch(spark, sf):
    taken, rest = Q.frontier_batch(_tasks(spark, sf), 4321)
    return taken.select("url", "seq", F.lit(1).alias("taken")).unionByName(rest.select("url", "seq", F.lit(0).alias("taken")))


@query("enqueue", f"""WITH {_TASKS_SQL}
    SELECT url, hop, seq FROM tasks WHERE miner <> 'purchase' UNION ALL
    SELECT url, hop, (SELECT max(seq) FROM tasks WHERE miner <> 'purchase') + row_number() OVER (ORDER BY hop, seq)
    FROM tasks WHERE miner = 'purchase'""")
def _enqueue(spark, sf):
    t = _tasks(spark, sf)
    queue, new = t.filter("miner <> 'purchase'"), t.filter("miner = 'purchase'").withColumnRenamed("seq", "found")
    return Q.enqueue(queue, new, ["hop", "found"], run_folder(spark, "enqueue")).select("url", "hop", "seq")


@query("requeue_deferred", f"""WITH {_TASKS_SQL}
    SELECT url, hop, seq FROM tasks WHERE miner <> 'error' UNION ALL
    SELECT url, hop, (SELECT max(seq) FROM tasks) + row_number() OVER (ORDER BY seq) FROM tasks WHERE miner = 'error'""")
def _requeue_deferred(spark, sf):
    t = _tasks(spark, sf)
    return Q.requeue_deferred(t, t.filter("miner = 'error'"), run_folder(spark, "requeue")).select("url", "hop", "seq")


@query("pending_count", f"WITH {_TASKS_SQL} SELECT count(*) AS pending FROM tasks WHERE miner <> 'purchase'")
def _pending_count(spark, sf):
    return Q.pending_count(_tasks(spark, sf).filter("miner <> 'purchase'"))


@query("processed_count", f"WITH {_TASKS_SQL} SELECT count(*) AS processed FROM tasks WHERE miner = 'purchase'")
def _processed_count(spark, sf):
    return Q.processed_count(_tasks(spark, sf).filter("miner = 'purchase'"))


@query("latest_tasks", f"WITH {_TASKS_SQL} SELECT url, hop, seq FROM tasks ORDER BY seq DESC LIMIT 5")
def _latest_tasks(spark, sf):
    return Q.latest_tasks(_tasks(spark, sf)).select("url", "hop", "seq")


@query("latest_links", with_events("""
    SELECT url, failed_cnt FROM state ORDER BY last_start_ts DESC NULLS LAST, url DESC LIMIT 5""", _UPTO, state_sql("past")))
def _latest_links(spark, sf):
    return Q.latest_links(past_state(spark, sf)).select("url", F.col("failed_cnt").cast("bigint"))


@query("unseen_links", with_events("""
    SELECT DISTINCT url FROM fetch_events f WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.url = f.url AND s.last_start_ts IS NOT NULL)""",
    _UPTO, state_sql("past")))
def _unseen_links(spark, sf):
    from sitegraph.catalog.tables import fetch_events

    return Q.unseen_links(fetch_events(spark, sf), past_state(spark, sf), "url")


@query("dead_links", "WITH " + _ANCHORS_SQL + """
    SELECT link AS url, count(*) AS n_links, 'HTTP 404' AS status_code FROM links
    WHERE link NOT IN (SELECT url FROM pages) GROUP BY link""")
def _dead_links(spark, sf):
    p = pages(spark, sf)
    return Q.dead_links(resolve_links(extract_links(p)), p)


# A shop on real markup: index -> nations -> suppliers -> parts. A supplier lists the
# parts of its own number modulo 97; every tenth part has no page.
_SHOP = "http://shop.example/"
_SHOP_RULES = (
    Rule(r"^http://shop\.example/(?:nation|supplier)\d+\.html$", 5, 0, "snapshot", ("walk",)),
    Rule(r"^http://shop\.example/part\d+\.html$", 1, 0, "snapshot", (), ("item",)),
)
_SHOP_ITEM = MineSpec("shop", (
    Group("no name; ", (Field("name", (Step(sel("h1")),)),)),
    Group("no price; ", (Field("price", (Step(sel("div", class_="box")), Step(sel("span", class_="price")))),)),
))


def shop_site(spark, sf):
    """Pages of the shop: an index, a page per nation and supplier, and most parts.

    Pages of suppliers and parts are dealt out before their markup is made, over as many tasks as there
    are shuffle partitions (cores, if there are more): they take far longer to parse than their stored
    bytes tell, and markup itself is never moved.
    """
    nation, supplier, part = (table(spark, sf, t) for t in ("nation", "supplier", "part"))
    files = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def address(kind, key):
        return F.concat(F.lit(f"{kind}"), F.col(key).cast("string"), F.lit(".html"))

    def sorted_anchors(target):
        anchors = F.concat(F.lit("<li><a href=' "), target, F.lit(" '>x</a><a name='n'>y</a>"))
        return F.array_sort(F.collect_list(anchors))

    def listing(anchors):
        return F.concat(F.lit("<html><body><ul>"), F.array_join(anchors, ""), F.lit("</ul></body></html>"))

    def grouped(rows, url, target):
        return rows.groupBy(url.alias("url")).agg(listing(sorted_anchors(target)).alias("html"))

    # the parts of a number are listed once for all suppliers of that number, and copied to as many
    # slots as rows of that number are dealt over; a supplier that is there twice lists each part twice
    slots = -(-32 * files // 97)

    def dealt(rows, kind, key, copies, item):
        return rows.select(F.concat(F.lit(_SHOP), address(kind, key)).alias("url"), copies.alias("copies"), item.alias("item"),
                           (F.col(key) % 97).alias("k"), F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot"))

    sellers = supplier.groupBy("s_suppkey").agg(F.count("*").cast("int").alias("n"))
    items = part.filter("p_partkey % 10 <> 0").withColumn("html", F.concat(
        F.lit("<html><body><h1>"), "p_name", F.lit("</h1><div class='box'>"),
        F.when(F.col("p_partkey") % 7 > 0, F.concat(F.lit("<span class='price'>$"), "p_partkey", F.lit("</span>"))).otherwise(F.lit("")),
        F.lit("</div><a href='index.html'>home</a></body></html>")))
    rows = dealt(sellers, "supplier", "s_suppkey", F.col("n"), F.lit(None).cast("string")) \
        .unionByName(dealt(items, "part", "p_partkey", F.lit(0), F.col("html")))
    parts = part.groupBy((F.col("p_partkey") % 97).alias("k")).agg(sorted_anchors(address("part", "p_partkey")).alias("l")) \
        .withColumn("slot", F.explode(F.array(*[F.lit(n) for n in range(slots)])))
    rows = rows.repartition(files, "k", "slot").join(parts.repartition(files, "k", "slot"), ["k", "slot"], "left")
    times = F.when(F.col("copies") == 1, F.col("l")).otherwise(
        F.flatten(F.transform("l", lambda anchor: F.array_repeat(anchor, F.col("copies")))))
    # a supplier without parts has no page
    rows = rows.filter("copies = 0 OR l IS NOT NULL").select(
        "url", F.when(F.col("copies") == 0, F.col("item")).otherwise(listing(times)).alias("html"))
    pages = (grouped(nation, F.lit(_SHOP + "index.html"), address("nation", "n_nationkey"))
             .unionByName(grouped(supplier, F.concat(F.lit(_SHOP), address("nation", "s_nationkey")), address("supplier", "s_suppkey")))
             .unionByName(rows))
    return pages.select(F.xxhash64("url").alias("page_id"), "url", F.col("url").alias("final_url"), F.lit("text/html").alias("content_type"), "html")


def written_site(spark, sf):
    """The shop's pages as a table."""
    return cut_lineage(shop_site(spark, sf), run_folder(spark, "site"))


@query("crawl_pages", f"""
    WITH sold AS (SELECT DISTINCT p_partkey AS p, p_name FROM part JOIN supplier ON s_suppkey % 97 = p_partkey % 97)
    SELECT '{_SHOP}index.html' AS url, 0 AS hop, '' AS status_code, NULL AS error, NULL AS name, NULL AS price
    UNION ALL SELECT '{_SHOP}nation' || n_nationkey || '.html', 1, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN '' ELSE 'HTTP 404' END, NULL, NULL, NULL FROM nation
    UNION ALL SELECT '{_SHOP}supplier' || s_suppkey || '.html', 2, CASE WHEN s_suppkey % 97 IN (SELECT p_partkey % 97 FROM part) THEN '' ELSE 'HTTP 404' END, NULL, NULL, NULL FROM supplier
    UNION ALL SELECT '{_SHOP}part' || p || '.html', 3, CASE WHEN p % 10 = 0 THEN 'HTTP 404' ELSE '' END,
      CASE WHEN p % 10 <> 0 THEN CASE WHEN p % 7 = 0 THEN 'no price; ' ELSE '' END END, CASE WHEN p % 10 <> 0 THEN p_name END,
      CASE WHEN p % 10 <> 0 AND p % 7 <> 0 THEN '$' || p END FROM sold""")
def _crawl_pages(spark, sf):
    site = written_site(spark, sf)
    seed = {"url": _SHOP + "index.html", "seekers": ["walk"], "hop": 0}
    spec = JobSpec("shop", (seed,), {"walk": SeekerSpec(_SHOP_RULES)}, {"item": _SHOP_ITEM})
    result = crawl(spark, spec, pages=site)
    records = mine_visits(result, site, spec)["item"].select("url", "error", "name", "price")
    return result.visits.select("url", "hop", "status_code").join(records, "url", "left")
