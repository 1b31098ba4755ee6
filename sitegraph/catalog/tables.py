"""The given tables as the inputs the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.operators.html_nodes import html_nodes
from sitegraph.operators.page_tree import page_nodes
from sitegraph.session import cut_lineage, run_folder


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "pages"), "page_id")


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows as the scan splits them. Only where it gives fewer splits than there are cores
    (a small stored file is one split, whatever the session asks for) are they dealt out by a key
    before they are parsed; the result is the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, by)


def trees(spark: SparkSession, sf: str, **options: object) -> DataFrame:
    """The pages with their nodes as an array in the row."""
    return page_nodes(pages(spark, sf), **options)


def nodes(spark: SparkSession, sf: str, **options: object) -> DataFrame:
    return html_nodes(pages(spark, sf), **options)


def saved_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The node table, written once: for queries that read it more than once."""
    return cut_lineage(nodes(spark, sf), run_folder(spark, "nodes"))


def fetch_events(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` read as the log of fetch starts and ends."""
    return as_fetch_events(table(spark, sf, "events"))


def as_fetch_events(events: DataFrame) -> DataFrame:
    item = F.concat(F.lit("https://shop.example/item/"), F.col("user_id").cast("string"),
                    F.lit("-"), (F.col("event_id") % 8).cast("string"))
    return events.select(
        item.alias("url"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "signup", "start").otherwise("end").alias("kind"),
        F.when(F.col("event_type") == "purchase", "")
        .otherwise(F.concat(F.lit("HTTP "), "event_type")).alias("status_code"),
    )


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A cyclic link graph from foreign keys: ``src_url, dst_url``."""
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    supplier, lines = table(spark, sf, "supplier"), table(spark, sf, "lineitem")

    def path(kind: str, key: str) -> F.Column:
        return F.concat(F.lit(f"/{kind}/"), F.col(key).cast("string"))

    def edge(df: DataFrame, src: F.Column, dst: F.Column) -> DataFrame:
        return df.select(src.alias("src_url"), dst.alias("dst_url"))

    home = F.lit("/")
    return (
        edge(region, home, path("region", "r_regionkey"))
        .unionByName(edge(nation, path("region", "n_regionkey"), path("nation", "n_nationkey")))
        .unionByName(edge(nation, path("nation", "n_nationkey"), home))
        .unionByName(edge(supplier, path("nation", "s_nationkey"), path("supplier", "s_suppkey")))
        .unionByName(edge(lines, path("supplier", "l_suppkey"), path("part", "l_partkey")).distinct())
        .unionByName(edge(lines, path("part", "l_partkey"), path("supplier", "l_suppkey")).distinct())
    )


FETCH_EVENTS_SQL = """
fetch_events AS (
  SELECT 'https://shop.example/item/' || user_id || '-' || (event_id % 8) AS url, ts,
         CASE WHEN event_type = 'signup' THEN 'start' ELSE 'end' END AS kind,
         CASE WHEN event_type = 'purchase' THEN '' ELSE 'HTTP ' || event_type END AS status_code
  FROM events)
"""

EDGES_SQL = """
edges AS (
  SELECT '/' AS src_url, '/region/' || r_regionkey AS dst_url FROM region
  UNION ALL SELECT '/region/' || n_regionkey, '/nation/' || n_nationkey FROM nation
  UNION ALL SELECT '/nation/' || n_nationkey, '/' FROM nation
  UNION ALL SELECT '/nation/' || s_nationkey, '/supplier/' || s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT '/supplier/' || l_suppkey, '/part/' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT '/part/' || l_partkey, '/supplier/' || l_suppkey FROM lineitem)
"""

# Tokens and node table in SQL, for markup as in ``pages``: one step of the
# recursion consumes one token of every page, ``names`` and ``pres`` are the open
# elements. The name lists are the nesting rules for elements that occur there.
TOKENS_SQL = r"""
cut AS (
  SELECT page_id, flatten(list_transform(
    regexp_extract_all(html, '(?s)<script>.*?</script>|<!--.*?-->|<[^>]*>|[^<]+'),
    lambda t: CASE WHEN t LIKE '<script>%' THEN ['<script>', chr(1) || t[9:length(t) - 9], '</script>'] ELSE [t] END)) AS toks
  FROM pages),
tokens AS MATERIALIZED (
  SELECT page_id, pos,
    CASE WHEN t LIKE chr(1) || '%' THEN 'raw' WHEN t LIKE '<!--%' THEN 'comment' WHEN t LIKE '<!%' THEN 'decl'
         WHEN t LIKE '</%' THEN 'end' WHEN t LIKE '<%' THEN 'start' ELSE 'text' END AS kind,
    CASE WHEN t LIKE chr(1) || '%' OR t LIKE '<!%' OR t NOT LIKE '<%' THEN ''
         ELSE lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) END AS name,
    CASE WHEN t LIKE chr(1) || '%' THEN t[2:] ELSE t END AS raw
  FROM (SELECT page_id, unnest(toks) AS t, generate_subscripts(toks, 1) - 1 AS pos FROM cut))
"""

NODES_SQL = TOKENS_SQL + r""",
step(page_id, pos, n, made, pre, parent_pre, depth, names, pres) AS (
  SELECT DISTINCT page_id, CAST(-1 AS BIGINT), CAST(1 AS BIGINT), true, CAST(0 AS BIGINT), CAST(NULL AS BIGINT),
         CAST(0 AS BIGINT), ['[document]'], [CAST(0 AS BIGINT)] FROM tokens
  UNION ALL
  SELECT page_id, pos, n + CASE WHEN node THEN 1 ELSE 0 END, node, n, pres[keep], CAST(keep AS BIGINT),
         CASE WHEN opens THEN list_append(names[1:keep], name) ELSE names[1:keep] END,
         CASE WHEN opens THEN list_append(pres[1:keep], n) ELSE pres[1:keep] END
  FROM (
    SELECT *, kind <> 'end' AS node, kind = 'start' AND name NOT IN ('br', 'meta') AS opens,
      CASE WHEN kind = 'end' THEN coalesce(list_max(list_filter(range(2, len(names) + 1), lambda i: names[i] = name)) - 1, len(names))
           WHEN kind <> 'start' OR name IN ('br', 'meta') THEN len(names)
           WHEN name IN ('div', 'span', 'ul', 'ol') THEN len(names)
           WHEN name = 'li' THEN coalesce(list_max(list_filter(range(2, len(names) + 1), lambda i: names[i] IN ('ul', 'ol'))), len(names))
           WHEN name = 'p' THEN coalesce(list_max(list_transform(
                list_filter(range(2, len(names) + 1), lambda i: names[i] IN ('p', 'div', 'ul', 'ol', 'li')),
                lambda i: CASE WHEN names[i] = 'p' THEN i - 1 ELSE i END)), len(names))
           ELSE coalesce(list_max(list_filter(range(2, len(names) + 1), lambda i: names[i] = name)) - 1, len(names))
      END AS keep
    FROM (SELECT t.page_id, t.pos, t.kind, t.name, s.n, s.names, s.pres
          FROM step s JOIN tokens t ON t.page_id = s.page_id AND t.pos = s.pos + 1))),
placed AS MATERIALIZED (
  SELECT s.page_id, s.pre, s.parent_pre, s.depth,
    row_number() OVER (PARTITION BY s.page_id, s.parent_pre ORDER BY s.pre) - 1 AS sib_no,
    CASE WHEN s.pre = 0 OR t.kind = 'start' THEN 'tag' WHEN t.kind = 'raw' THEN 'text' ELSE t.kind END AS kind,
    CASE WHEN s.pre = 0 THEN '[document]' WHEN t.kind = 'start' THEN t.name END AS name,
    CASE WHEN t.kind = 'start' THEN regexp_extract(t.raw, '^<[a-z0-9]+ ([a-z]+)="([^"]*)"', 1) ELSE '' END AS attr_k,
    CASE WHEN t.kind = 'start' THEN replace(regexp_extract(t.raw, '^<[a-z0-9]+ ([a-z]+)="([^"]*)"', 2), '&amp;', '&') ELSE '' END AS attr_v,
    CASE WHEN t.kind = 'raw' THEN t.raw
         WHEN t.kind = 'text' THEN CASE WHEN trim(t.raw, ' ') = '' THEN ' ' ELSE t.raw END
         WHEN t.kind = 'comment' THEN t.raw[5:length(t.raw) - 3]
         WHEN t.kind = 'decl' THEN t.raw[3:length(t.raw) - 1] END AS text
  FROM step s LEFT JOIN tokens t ON t.page_id = s.page_id AND t.pos = s.pos WHERE s.made),
nodes AS MATERIALIZED (
  SELECT p.*, coalesce((SELECT min(q.pre) - 1 FROM placed q
      WHERE q.page_id = p.page_id AND q.pre > p.pre AND q.depth <= p.depth),
      (SELECT max(q.pre) FROM placed q WHERE q.page_id = p.page_id)) AS post
  FROM placed p)
"""


def with_nodes(select: str, *more: str) -> str:
    """SQL over the node table ``nodes``; ``more`` are further ``name AS (…)`` parts."""
    return "WITH RECURSIVE " + ",\n".join([NODES_SQL, *more]) + "\n" + select


def with_tokens(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([TOKENS_SQL, *more]) + "\n" + select
