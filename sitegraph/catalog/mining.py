"""Queries: field mining. Product pages of the known shops are built from ``part``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sitegraph.catalog import query
from sitegraph.catalog.tables import dealt, pages, table
from sitegraph.operators import mine as M
from sitegraph.operators.select import sel
from sitegraph.plans import shops


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _unless(bad: str, *parts: Column | str) -> Column:
    return F.when(F.expr(bad), F.lit("")).otherwise(_cat(*parts))


def _key() -> Column:
    return F.col("p_partkey").cast("string")


def _shop_pages(spark, sf, body: Column) -> DataFrame:
    part = dealt(table(spark, sf, "part"), "p_partkey")
    html = _cat("<html><head><title>x</title></head><body><div class='top'><ul><li>menu</li></ul></div>", body, "</body></html>")
    return part.select(F.col("p_partkey").alias("page_id"), _cat("/part/", _key()).alias("url"), html.alias("html"))


def okaybuy_pages(spark, sf) -> DataFrame:
    size = F.col("p_size").cast("string")
    return _shop_pages(spark, sf, _cat(
        _unless("p_partkey % 5 = 1", "<ul class='title'><li class='fr'>x</li><li class='fl'>", _unless("p_partkey % 7 = 2", "<h1>", F.col("p_name"), "</h1>"),
                "<p>SKU: ", _key(), "</p></li></ul>"),
        _unless("p_partkey % 11 = 3", "<div class='txt1'>", _unless("p_partkey % 2 = 1", "<span class='market_pr'>", _key(), ".5</span>"),
                "<span class='sale_pr'>", _key(), "</span><dl><dd class='fl'>to <span class='black'>", size, "</span></dd></dl></div>"),
        "<div class='txt2'><p class='size'><a href='#'>", size, "</a><a>", _unless("p_partkey % 13 = 4", "4", "2"), "</a></p></div>",
        _unless("p_partkey % 3 = 2", '<script>large_images[1] = new Image();\nlarge_images[1].src     = "http://i.okaybuy.cn/images/com/l/', _key(),
                '.jpg";\nlarge_images[2].src     = "http://i.okaybuy.cn/images/com/l/', _key(), '_2.jpg";</script>'),
    ))





def _rows(records: DataFrame, *names: str, details: bool = False) -> DataFrame:
    r = M.as_products(records)
    pairs = F.array_join(F.transform("prod_details", lambda d: F.concat(d["attr_name"], F.lit(":"), d["attr_value"])), "|")
    images = F.array_join(F.transform("images", lambda i: F.concat(i["kind"], i["no"].cast("string"), F.lit("="), i["src"])), ";")
    more = [F.coalesce(pairs, F.lit("")).alias("details")] if details else []
    return r.select("url", "error", *[F.coalesce(n, F.lit("-")).alias(n) for n in names], images.alias("images"), *more)


@query("mine_okaybuy", """
    SELECT '/part/' || p_partkey AS url,
      CASE WHEN p_partkey % 5 = 1 OR p_partkey % 7 = 2 THEN 'Failed to extract prod_name' ELSE '' END ||
      CASE WHEN p_partkey % 5 = 1 THEN 'Failed to extract prod_sku' ELSE '' END ||
      CASE WHEN p_partkey % 11 = 3 THEN 'Failed to extract prod price and shipping' ELSE '' END ||
      CASE WHEN p_partkey % 13 = 4 THEN 'Failed to extract size; ' ELSE '' END ||
      CASE WHEN p_partkey % 3 = 2 THEN 'Failed to extract image; ' ELSE '' END AS error,
      CASE WHEN p_partkey % 5 = 1 OR p_partkey % 7 = 2 THEN '-' ELSE p_name END AS prod_name,
      CASE WHEN p_partkey % 5 = 1 THEN '-' ELSE 'SKU: ' || p_partkey END AS prod_sku,
      CASE WHEN p_partkey % 11 = 3 OR p_partkey % 2 = 1 THEN '-' ELSE p_partkey || '.5' END AS prod_market_price,
      CASE WHEN p_partkey % 11 = 3 THEN '-' ELSE '' || p_partkey END AS prod_price,
      CASE WHEN p_partkey % 11 = 3 THEN '-' ELSE '' || p_size END AS shipping_cost,
      CASE WHEN p_partkey % 13 = 4 THEN '-' ELSE p_size || ', 42' END AS size,
      CASE WHEN p_partkey % 3 = 2 THEN '' ELSE 'f1=http://i.okaybuy.cn/images/com/l/' || p_partkey || '.jpg;f2=http://i.okaybuy.cn/images/com/l/' || p_partkey || '_2.jpg' END AS images
    FROM part""")
def _mine_okaybuy(spark, sf):
    records = M.mine(okaybuy_pages(spark, sf), shops.okaybuy_miner())
    return _rows(records, "prod_name", "prod_sku", "prod_market_price", "prod_price", "shipping_cost", "size")


def paixie_pages(spark, sf) -> DataFrame:
    return _shop_pages(spark, sf, _cat(
        "<div id='areaPro'>", _unless("p_partkey % 5 = 1", "<div class='info'>", _unless("p_partkey % 7 = 2", "<h1>", F.col("p_name"), "</h1>"),
        "<ul><li>a<strong>", F.col("p_brand"), "</strong></li><li><span>  ", F.col("p_type"), " \n</span></li><li><span>\t", F.col("p_type"), "\r\n</span></li><li>",
        _unless("p_partkey % 3 = 2", "<del>", _key(), "</del>"), "</li><li><span>now <span>", _key(), "</span></span></li></ul></div>"),
        "<div class='gallery'><a class='jsGoodsGallery' rel='", _key(), "_1.jpg'></a><a class='jsGoodsGallery'", _unless("p_partkey % 11 = 3", " rel='2.jpg'"),
        "></a><a class='jsGoodsGallery' rel='3.jpg'></a></div></div>",
        _unless("p_partkey % 13 = 4", "<div id='boxCollectionSize'>", _unless("p_partkey % 2 = 1", "<ul id='jsListSize'><li>40</li><li>", F.col("p_size").cast("string"), "</li></ul>"), "</div>"),
    ))


@query("mine_paixie", r"""
    SELECT '/part/' || p_partkey AS url,
      CASE WHEN a OR p_partkey % 7 = 2 THEN 'Failed to extract prod_name' ELSE '' END ||
      CASE WHEN a OR d THEN 'Failed to extract prod price and shipping' ELSE '' END ||
      CASE WHEN p_partkey % 13 = 4 THEN 'Failed to extract size; ' ELSE '' END ||
      CASE WHEN p_partkey % 11 = 3 THEN 'Failed to extract image; ' ELSE '' END AS error,
      CASE WHEN a OR p_partkey % 7 = 2 THEN '-' ELSE p_name END AS prod_name, CASE WHEN a THEN '-' ELSE p_brand END AS prod_brand,
      CASE WHEN a THEN '-' ELSE p_type END AS prod_aution_type, CASE WHEN a THEN '-' ELSE p_type END AS prod_type,
      CASE WHEN a OR d THEN '-' ELSE '' || p_partkey END AS prod_market_price, CASE WHEN a OR d THEN '-' ELSE '' || p_partkey END AS prod_price,
      CASE WHEN p_partkey % 13 = 4 OR p_partkey % 2 = 1 THEN '-' ELSE '40, ' || p_size END AS size,
      'f1=' || p_partkey || '_1.jpg' || CASE WHEN p_partkey % 11 = 3 THEN '' ELSE ';f2=2.jpg;f3=3.jpg' END AS images
    FROM (SELECT *, p_partkey % 5 = 1 AS a, p_partkey % 3 = 2 AS d FROM part)""")
def _mine_paixie(spark, sf):
    records = M.mine(paixie_pages(spark, sf), shops.paixie_miner())
    return _rows(records, "prod_name", "prod_brand", "prod_aution_type", "prod_type", "prod_market_price", "prod_price", "size")


def taobao_pages(spark, sf) -> DataFrame:
    cost = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('<li id=ShippingCost class=\"freight delivery clearfix\"><em>', p_size, '</em></li>')"
                  " WHEN 1 THEN '<li id=\"J_PostageCont\"></li>' ELSE '' END")
    return _shop_pages(spark, sf, _cat(
        "<div class='detail-hd'><h3><a", _unless("p_partkey % 5 = 1", " href='/i?a=1&amp;b=2'"), ">", F.col("p_name"), "</a></h3></div><ul>",
        _unless("p_partkey % 7 = 2", "<li class='detail-price clearfix'><span>y</span><strong>", _key(), "</strong></li>"),
        _unless("p_partkey % 11 = 3", "<li class='sold-out clearfix'><em>", F.col("p_size").cast("string"), "</em></li>"), cost,
        "</ul><ul class='attributes-list'><li title='brand'>\tx&nbsp;", F.col("p_brand"), "\r\n</li><li>none</li><li title='type'>", _unless("p_partkey % 13 = 4", F.col("p_type")), "</li></ul>",
        _unless("p_partkey % 17 = 5", "<ul id='J_UlThumb' class='thumb clearfix'><li><img src='", _key(), ".jpg_40x40.jpg'></li><li><img src='b.jpg'></li></ul>"),
    ))


@query("mine_taobao", r"""
    SELECT '/part/' || p_partkey AS url,
      CASE WHEN p_partkey % 5 = 1 THEN 'failed to parse prod_name; ' ELSE '' END || CASE WHEN p_partkey % 7 = 2 THEN 'failed to parse prod_price; ' ELSE '' END ||
      CASE WHEN p_partkey % 11 = 3 THEN 'failed to parse sold_amount; ' ELSE '' END || CASE WHEN p_partkey % 3 = 2 THEN 'failed to parse shipping_cost; ' ELSE '' END ||
      CASE WHEN p_partkey % 13 = 4 THEN 'failed to parse details; ' ELSE '' END || CASE WHEN p_partkey % 17 = 5 THEN 'failed to get images; ' ELSE '' END AS error,
      p_name AS prod_name, CASE WHEN p_partkey % 5 = 1 THEN '-' ELSE '/i?a=1&b=2' END AS sku_url,
      CASE WHEN p_partkey % 7 = 2 THEN '-' ELSE '' || p_partkey END AS prod_price, CASE WHEN p_partkey % 11 = 3 THEN '-' ELSE '' || p_size END AS sold_amount,
      CASE p_partkey % 3 WHEN 0 THEN '' || p_size WHEN 1 THEN '0.0' ELSE '-' END AS shipping_cost,
      CASE WHEN p_partkey % 13 = 4 THEN '' ELSE 'brand:x ;' || p_brand || '|type:' || p_type END AS details,
      CASE WHEN p_partkey % 17 = 5 THEN '' ELSE 's0=' || p_partkey || '.jpg_40x40.jpg;f0=' || p_partkey || '.jpg;s1=b.jpg;f1=b.jpg' END AS images
    FROM part""")
def _mine_taobao(spark, sf):
    records = M.mine(taobao_pages(spark, sf), shops.taobao_miner())
    return _rows(records, "prod_name", "sku_url", "prod_price", "sold_amount", "shipping_cost", details=True)


_PAGES_SQL = r"""
SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading,
  regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS ad, regexp_extract(html, '<footer>&copy; (\S+)', 1) AS footer_host,
  len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages
"""


@query("mine_pages", _PAGES_SQL)
def _mine_pages(spark, sf):
    records = M.mine(pages(spark, sf), shops.page_miner())
    return records.select("page_id", "url", "title", "heading", "ad", "footer_host", F.col("paragraphs").cast("bigint"))


BOLD = M.MineSpec("bold", (
    M.Group("no bold text; ", (M.Field("bold", M.path(sel("article"), M.Step(sel("p"), 1), sel("b")), null_fails=True),)),
    M.Group("no heading; ", (M.Field("heading", M.path(sel("h1"))),)),
    M.Group("no second ad; ", (M.Field("ad", M.path(M.Step(sel("div", class_="ad"), 1))),)),
))


@query("field_errors", r"""
    SELECT page_id, heading, CASE WHEN second LIKE '<p><b>%' AND second NOT LIKE '%<br>%' THEN '' ELSE 'no bold text; ' END || 'no second ad; ' AS error FROM (
      SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading,
        coalesce(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)', 1), '<p>(?:<b>)?[^<]*(?:<br>)?')[2], '') AS second FROM pages)""")
def _field_errors(spark, sf):
    return M.mine(pages(spark, sf), BOLD).select("page_id", "heading", "error")


@query("mine", r"""
    SELECT page_id, coalesce(regexp_extract_all(html, '<a href="([^"]*)">', 1)[3], '-') AS third_link,
      coalesce(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)[1], '-') AS first_label FROM pages""")
def _mine(spark, sf):
    nav = sel("nav")
    spec = M.MineSpec("nav", (
        M.Group("few links; ", (M.Field("third_link", M.path(nav, M.Step(sel("a"), 2)), take="@href"),)),
        M.Group("no links; ", (M.Field("first_label", M.path(nav, sel("ul"), sel("a"))),)),
    ))
    return M.mine(pages(spark, sf), spec).select(
        "page_id", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("third_link", "first_label")])


@query("mine_url", "SELECT url FROM pages")
def _mine_url(spark, sf):
    return M.mine_url(table(spark, sf, "pages"))


@query("mine_regex", r"""
    SELECT * FROM (SELECT url, regexp_extract(html, '<h1>([A-Za-z]+)', 1) AS word, regexp_extract(html, '&copy; (m\.\S+|www\.\S+)', 1) AS host FROM pages)
    WHERE word <> '' AND host <> ''""")
def _mine_regex(spark, sf):
    return M.mine_regex(pages(spark, sf), {"word": r"<h1>([A-Za-z]+)", "host": r"&copy; (m\.\S+|www\.\S+)"})


@query("mine_many", """
    SELECT 'bold' AS site, page_id, NULL AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages
    UNION ALL SELECT 'pages', page_id, regexp_extract(html, '<title>([^<]*)</title>', 1), regexp_extract(html, '<h1>([^<]*)</h1>', 1) FROM pages""")
def _mine_many(spark, sf):
    p = pages(spark, sf)
    return M.mine_many([M.mine(p, BOLD), M.mine(p, shops.page_miner())]).select("site", "page_id", "title", "heading")


@query("numbered_images", """
    SELECT page_id, no, kind, CASE kind WHEN 's' THEN src ELSE regexp_replace(src, '_40x40\\.jpg$', '') END AS src FROM (
      SELECT page_id, generate_subscripts(h, 1) - 1 AS no, unnest(h) || '_40x40.jpg' AS src
      FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h FROM pages)), (VALUES ('s'), ('f')) k(kind)""".replace("\\\\", "\\"))
def _numbered_images(spark, sf):
    from sitegraph.operators.links import extract_links

    links = extract_links(pages(spark, sf)).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "href"))).alias("h"))
    thumbs = F.transform("h", lambda x: F.concat(x["href"], F.lit("_40x40.jpg")))
    numbered = M.numbered_images(thumbs, 0, (("s", None), ("f", M.full_image_url)))
    return links.select("page_id", F.inline(numbered)).select("page_id", F.col("no").cast("bigint"), "kind", "src")


@query("full_image_url", r"""
    SELECT p_partkey, regexp_replace(p_name || CASE p_partkey % 3 WHEN 0 THEN '_40x40.jpg' WHEN 1 THEN '_x40.jpg' ELSE '_1x200.jpg.gif' END, '_\d+x\d+\.jpg$', '') AS src FROM part""")
def _full_image_url(spark, sf):
    ending = F.expr("CASE p_partkey % 3 WHEN 0 THEN '_40x40.jpg' WHEN 1 THEN '_x40.jpg' ELSE '_1x200.jpg.gif' END")
    return table(spark, sf, "part").select("p_partkey", M.full_image_url(F.concat("p_name", ending)).alias("src"))


@query("size_list", """
    SELECT l_partkey, CASE WHEN bool_or(l_quantity > 49) THEN '-' ELSE array_to_string(list_transform(list_sort(list(DISTINCT CAST(l_quantity AS INT))), lambda x: x::VARCHAR), ', ') END AS sizes
    FROM lineitem GROUP BY l_partkey""")
def _size_list(spark, sf):
    # distinct sizes seen per part, fifty at most; 50 stands for a size without a label
    quantity = F.col("l_quantity").cast("int")
    seen = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(quantity)).alias("q"))
    labels = F.transform("q", lambda x: F.when(x < 50, x.cast("string")))
    return seen.select("l_partkey", F.coalesce(M.size_list(labels), F.lit("-")).alias("sizes"))


@query("attribute_list", r"""
    SELECT p_partkey, 'brand:x ;' || p_brand || '|type:' || p_type AS details FROM part WHERE p_partkey % 13 <> 4""")
def _attribute_list(spark, sf):
    records = M.mine(taobao_pages(spark, sf), shops.taobao_miner()).filter("prod_details IS NOT NULL")
    details = F.array_join(F.transform("prod_details", lambda d: F.concat(d["attr_name"], F.lit(":"), d["attr_value"])), "|")
    return records.select(F.col("page_id").alias("p_partkey"), details.alias("details"))


@query("mine_report", """
    SELECT '/part/' || p_partkey AS url, p_name AS name, CASE WHEN p_partkey % 17 <> 5 THEN p_partkey || '.jpg' ELSE '-' END AS image,
      CASE WHEN p_partkey % 13 <> 4 THEN p_type ELSE '-' END AS detail FROM part""")
def _mine_report(spark, sf):
    report = M.mine_report(M.as_products(M.mine(taobao_pages(spark, sf), shops.taobao_miner())))

    def value(path: str) -> Column:
        return F.coalesce(F.get_json_object("record", path), F.lit("-"))

    return report.select("url", value("$.prod_name").alias("name"), value("$.prod_img_f_0").alias("image"),
                         value("$.prod_details[1].attr_value").alias("detail"))


@query("custom_miner", "SELECT url, length(html) AS size, CAST((length(html) - length(replace(html, '<a ', ''))) / 3 AS BIGINT) AS links FROM pages")
def _custom_miner(spark, sf):
    def extract(batch: pa.RecordBatch) -> pa.Table:
        html = batch.column("html")
        links = pc.count_substring(html, "<a ").cast(pa.int64())
        return pa.table([batch.column("url"), pc.utf8_length(html).cast(pa.int64()), links], ["url", "size", "links"])

    return M.custom_miner(pages(spark, sf).select("url", "html"), extract, "url STRING, size BIGINT, links BIGINT")
