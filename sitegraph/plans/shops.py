"""Descriptions of the known sites: what a record is made of, which links to follow.

Selectors, patterns and messages are fixed values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegraph.functions.text import strip
from sitegraph.operators.links import Rule, SeekerSpec
from sitegraph.operators.mine import (
    Count, Details, Field, FirstOf, Group, Images, Joined, MineSpec, Step, TextImages,
    full_image_url, path,
)
from sitegraph.operators.select import Selector, sel
from sitegraph.sources.jobs import JobSpec

FETCHER = "simple_http_get"
ENCODING = "gb2312"


def okaybuy_miner() -> MineSpec:
    title, prices = sel("ul", class_="title"), sel("div", class_="txt1")
    return MineSpec("okaybuy", (
        Group("Failed to extract prod_name", (
            Field("prod_name", path(title, sel("li", class_="fl"), sel("h1"))),)),
        Group("Failed to extract prod_sku", (
            Field("prod_sku", path(title, sel(text=re.compile("SKU: "))), take="text"),)),
        Group("Failed to extract prod price and shipping", (
            Field("prod_market_price", path(prices, sel("span", class_="market_pr")), required=1),
            Field("prod_price", path(prices, sel("span", class_="sale_pr")), required=1),
            Field("shipping_cost", path(prices, sel("dd", class_="fl"), sel("span", class_="black")), required=1),
        )),
        Group("Failed to extract size; ", (
            Joined("size", path(sel("div", class_="txt2"), sel("p", class_="size")), sel("a")),)),
        Group("Failed to extract image; ", (
            TextImages(
                sel(text=re.compile(r'large_images\[1\].src     = "http://i.okaybuy.cn/images/com/l')),
                r"http://i.okaybuy.cn/images/com/l/.+\.jpg", 1, "f"),)),
    ))


def paixie_miner() -> MineSpec:
    area, info, listing, item = sel("div", id="areaPro"), sel("div", class_="info"), sel("ul"), sel("li")
    span = sel("span")

    def row(k: int, *rest: Selector) -> tuple[Step, ...]:
        return path(area, info, listing, Step(item, k), *rest)

    return MineSpec("paixie", (
        Group("Failed to extract prod_name", (Field("prod_name", path(area, info, sel("h1"))),)),
        Group("Failed to extract prod price and shipping", (
            Field("prod_brand", row(0, sel("strong"))),
            Field("prod_aution_type", row(1, span), null_fails=True, post=strip),
            Field("prod_type", row(2, span), null_fails=True, post=lambda s: F.regexp_replace(s, "[\t\r\n]", "")),
            Field("prod_market_price", row(3, sel("del"))),
            Field("prod_price", row(4, span, span)),
        )),
        Group("Failed to extract size; ", (
            Joined("size", path(sel("div", id="boxCollectionSize"), sel("ul", id="jsListSize")), item, required=1),)),
        Group("Failed to extract image; ", (
            Images(path(area, sel("div", class_="gallery")), sel("a", class_="jsGoodsGallery"), "rel", 1, (("f", None),)),)),
    ))


def attribute_text(s: Column) -> Column:
    for old, new in (("\t", ""), ("&nbsp", " "), ("\r\n", "")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def taobao_miner() -> MineSpec:
    head = path(sel("div", class_="detail-hd"), sel("h3"), sel("a"))
    cost = sel("li", id="ShippingCost", class_="freight delivery clearfix")
    return MineSpec("taobao", (
        Group("failed to parse prod_name; ", (Field("prod_name", head), Field("sku_url", head, take="@href"))),
        Group("failed to parse prod_price; ", (
            Field("prod_price", path(sel("li", class_="detail-price clearfix"), sel("strong"))),)),
        Group("failed to parse sold_amount; ", (
            Field("sold_amount", path(sel("li", class_="sold-out clearfix"), sel("em"))),)),
        Group("failed to parse shipping_cost; ", (
            FirstOf("shipping_cost", (
                (path(cost), Field("shipping_cost", path(cost, sel("em")))),
                (path(sel("li", id="J_PostageCont")), "0.0"),
            )),)),
        Group("failed to parse details; ", (
            Details("prod_details", path(sel("ul", class_="attributes-list")), sel("li"), attribute_text),)),
        Group("failed to get images; ", (
            Images(path(sel("ul", id="J_UlThumb", class_="thumb clearfix")), sel("img"), "src", 0,
                   (("s", None), ("f", full_image_url))),)),
    ))


def page_miner() -> MineSpec:
    """Plain pages: title, heading, advertisement, host named in the footer, paragraphs."""
    body = path(sel("article"))
    footer_host = r"^&copy; (\S+)"
    return MineSpec("pages", (
        Group("no title; ", (Field("title", path(sel("head"), sel("title"))),)),
        Group("no heading; ", (Field("heading", path(sel("article"), sel("h1"))),)),
        Group("no advertisement; ", (Field("ad", path(sel("div", class_="ad"))),)),
        Group("no footer; ", (
            Field("footer_host", path(sel("footer")), null_fails=True,
                  post=lambda s: F.regexp_extract(s, footer_host, 1)),)),
        Group("no article; ", (Count("paragraphs", body, sel("p")),)),
    ))


DEMO_FIELDS = {"name": r"name: (\w+)", "price": r"price: (\$\d+)"}


def demo_job(seed_url: str) -> JobSpec:
    rules = (
        Rule(r".*/cat\d+\.html", 3, 60, FETCHER, ("simple_seek",)),
        Rule(r".*prod\d+\.html", 1, 60, FETCHER, (), ("simple_miner",)),
    )
    seed = {"url": seed_url, "revisit_interval": 60, "fetcher": FETCHER, "seekers": ["simple_seek"], "hop": 0}
    return JobSpec("sample", (seed,), {"simple_seek": SeekerSpec(rules)}, {"simple_miner": DEMO_FIELDS}, encoding="utf-8")


def _shop_job(name: str, seed_url: str, seeker: str, spec: SeekerSpec, miners: dict) -> JobSpec:
    seed = {"url": seed_url, "revisit_interval": 14400, "fetcher": FETCHER, "seekers": [seeker], "hop": 0}
    return JobSpec(name, (seed,), {seeker: spec}, miners, encoding=ENCODING)


def okaybuy_job() -> JobSpec:
    listing = "http://www.okaybuy.com.cn/list.php?code=001000000&odrby=new&curpage=1"
    rules = (
        Rule(r"^http://www.okaybuy.com.cn/list.php\?code=001000000&odrby=new&curpage=\d+", 200, 14400, FETCHER, ("okaybuy_cat_seeker",)),
        Rule(r"^http://www.okaybuy.com.cn/com/\d+.html$", 201, 86400, FETCHER, (), ("okaybuy_item_miner",)),
    )
    return _shop_job("okaybuy", listing, "okaybuy_cat_seeker", SeekerSpec(rules), {"okaybuy_item_miner": okaybuy_miner()})


def paixie_job() -> JobSpec:
    listing = "http://www.paixie.net/shoes/goods/_______-1.html"
    rules = (
        Rule(r"^http://www.paixie.net/shoes/goods/_______-\d+.html$", 500, 14400, FETCHER, ("paixie_cat_seeker",)),
        Rule(r"^http://www.paixie.net/product/\d+.html$", 500, 86400, FETCHER, (), ("paixie_item_miner",)),
    )
    return _shop_job("paixie", listing, "paixie_cat_seeker", SeekerSpec(rules), {"paixie_item_miner": paixie_miner()})


TAOBAO_SEED = (
    "http://{store}.taobao.com/?price1=&price2=&search=y&pageNum=1&scid=0&keyword=&orderType=_time"
    "&old_starts=&categoryp=&pidvid=&viewType=list&isNew=&ends="
)
TAOBAO_RULES = (
    (r"^http://{store}.taobao.com/?.*search=y.+pageNum=\d", 50, 14400, ("taobao_cat_seeker",), ()),
    (r"^http://item.taobao.com/auction/item_detail-.+\.htm$", 51, 86400, (), ("taobao_item_miner",)),
)


def taobao_job(store: str) -> JobSpec:
    rules = tuple(
        Rule(regex.replace("{store}", store), hop, wait, FETCHER, seekers, miners)
        for regex, hop, wait, seekers, miners in TAOBAO_RULES
    )
    spec = SeekerSpec(rules, sel("div", class_="shop-hesper"))
    return _shop_job(store, TAOBAO_SEED.replace("{store}", store), "taobao_cat_seeker", spec, {"taobao_item_miner": taobao_miner()})
