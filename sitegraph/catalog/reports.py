"""Queries: reports and downstream upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.catalog import query
from sitegraph.catalog.history import with_events
from sitegraph.catalog.tables import fetch_events, pages, table
from sitegraph.functions.urls import host
from sitegraph.operators import report as R
from sitegraph.operators.mine import mine
from sitegraph.plans.shops import page_miner


@query("job_status", with_events("""
    SELECT *, 'Workers: 8, Tasks:(' || done || ', pending:' || pending || '), Links:(' || started || ', succ:' || succeeded
      || ', fail:' || failed || '), Output: ' || output AS status
    FROM (SELECT count(*) FILTER (kind = 'start') AS done, count(*) FILTER (kind = 'start') AS started,
        count(*) FILTER (kind = 'end' AND status_code = '') AS succeeded, count(*) FILTER (kind = 'end' AND status_code <> '') AS failed FROM fetch_events),
      (SELECT count(*) AS pending FROM orders), (SELECT count(*) AS output FROM part)"""))
def _job_status(spark, sf):
    e = fetch_events(spark, sf)
    return R.job_status(e.filter("kind = 'start'"), table(spark, sf, "orders"), e, table(spark, sf, "part"), 8)


@query("status_series", with_events("""
    SELECT strftime(d, '%Y-%m-%d') AS day, started, succeeded, failed, CAST(sum(started) OVER w AS BIGINT) AS total_started,
      CAST(sum(succeeded) OVER w AS BIGINT) AS total_succeeded, CAST(sum(failed) OVER w AS BIGINT) AS total_failed FROM (
        SELECT date_trunc('day', ts) AS d, count(*) FILTER (kind = 'start') AS started,
          count(*) FILTER (kind = 'end' AND status_code = '') AS succeeded, count(*) FILTER (kind = 'end' AND status_code <> '') AS failed
        FROM fetch_events GROUP BY 1) WINDOW w AS (ORDER BY d)"""))
def _status_series(spark, sf):
    # days by the log's own clock, whatever the session's time zone
    events = fetch_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    series = R.status_series(events, "1 day", "week")
    return series.select(F.date_format("at", "yyyy-MM-dd").alias("day"), *series.columns[1:])


@query("crawl_yield", r"""
    SELECT host, count(*) AS visited, count(*) FILTER (n > 8) AS products, round(count(*) FILTER (n > 8) / count(*), 4) AS ratio FROM (
      SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<p>')) AS n FROM pages) GROUP BY host""")
def _crawl_yield(spark, sf):
    p = pages(spark, sf).withColumn("host", host(F.col("url")))
    products = mine(p, page_miner(), ["host", "url"]).filter("paragraphs > 8")
    return R.crawl_yield(p.select("host"), products)


_SEEN = "SELECT '/part/' || l_partkey AS url, l_shipdate AS seen_at, l_orderkey, l_linenumber, CAST(floor(l_quantity / 17) AS INT) AS price_band FROM lineitem"
_ORDER = ["seen_at", "l_orderkey", "l_linenumber"]


def _observations(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("/part/"), F.col("l_partkey").cast("string")).alias("url"),
        F.col("l_shipdate").cast("timestamp").alias("seen_at"), "l_orderkey", "l_linenumber",
        F.floor(F.col("l_quantity") / 17).cast("int").alias("price_band"))


@query("product_upsert", f"""
    SELECT url, l_orderkey, l_linenumber, price_band, CASE WHEN before IS NULL THEN 'insert' WHEN before = price_band THEN 'unchanged' ELSE 'update' END AS action
    FROM (SELECT *, lag(price_band) OVER (PARTITION BY url ORDER BY seen_at, l_orderkey, l_linenumber) AS before FROM ({_SEEN}))""")
def _product_upsert(spark, sf):
    changes = R.product_upsert(_observations(spark, sf), "url", _ORDER, ["price_band"])
    return changes.select("url", "l_orderkey", "l_linenumber", "price_band", "action")


@query("latest_product", f"""
    SELECT url, strftime(seen_at, '%Y-%m-%d') AS seen_on, price_band FROM ({_SEEN})
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY seen_at DESC, l_orderkey DESC, l_linenumber DESC) = 1""")
def _latest_product(spark, sf):
    latest = R.latest_product(_observations(spark, sf), "url", _ORDER)
    return latest.select("url", F.date_format("seen_at", "yyyy-MM-dd").alias("seen_on"), "price_band")


@query("page_changes", """
    SELECT CASE WHEN page_id % 7 = 0 THEN url || '/new' ELSE url END AS url,
      CASE WHEN page_id % 7 = 0 THEN 'added' WHEN page_id % 5 = 0 THEN 'changed' ELSE 'same' END AS change FROM pages
    UNION ALL SELECT url, 'removed' FROM pages WHERE page_id % 7 = 0""")
def _page_changes(spark, sf):
    old = pages(spark, sf)
    new = old.select(
        F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("/new"))).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("<!-- new -->"))).otherwise(F.col("html")).alias("html"))
    return R.page_changes(old, new)
