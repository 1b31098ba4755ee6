"""Links, rules, frontier and the whole crawl on small fixtures."""

import json
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F
import pytest

from sitegraph.functions.urls import resolve_url
from sitegraph.operators import frontier as Q
from sitegraph.operators import links as L
from sitegraph.operators import linkstate as S
from sitegraph.operators.intervals import stab_join
from sitegraph.operators.select import sel
from sitegraph.plans import crawl as plans
from sitegraph.plans import shops
from sitegraph.plans.crawl import crawl, mine_visits
from sitegraph.schemas import LINK_STATE, RULE
from sitegraph.session import checkpoint_root, run_folder
from sitegraph.sources import jobs
from sitegraph.sources import pages as P
from sitegraph.sources.decode import decode_pages
from sitegraph.sources.pages import read_page_files

# the examples of RFC 3986, section 5.4 (and the empty reference, which is the page itself)
RFC_BASE = "http://a/b/c/d;p?q"
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g",
    "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
    "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x",
}


def test_resolve_url(spark):
    rows = spark.createDataFrame([(r,) for r in RFC], "ref STRING")
    got = {r.ref: r.url for r in rows.select("ref", resolve_url(F.lit(RFC_BASE), F.col("ref")).alias("url")).collect()}
    assert got == RFC
    other = [("http://a", "b", "http://a/b"), ("file:///s/index.html", "c.html", "file:///s/c.html"),
             ("file:/s/index.html", "c.html", "file:/s/c.html")]
    for base, ref, want in other:
        assert spark.range(1).select(resolve_url(F.lit(base), F.lit(ref))).first()[0] == want


DEMO = {
    "index.html": '<html><body><a href="cat1.html"> cat1 </a><a href=" cat2.html "> cat2 </a></body></html>',
    "cat1.html": '<html><body><a href="prod1.html"> prod1 </a><a href="prod2.html"> prod2 </a></body></html>',
    "cat2.html": '<html><body><a href="prod1.html"> prod1 </a><a href="prod2.html"> prod2 </a><a>no link</a></body></html>',
    "prod1.html": "<html><body>\nname: prod1<br/>\nprice: $45<br/>\n</body></html>",
    "prod2.html": "<html><body>\nname: prod2<br/>\nprice: $99<br/>\n</body></html>",
}


@pytest.fixture
def demo(spark, tmp_path):
    for name, text in DEMO.items():
        (tmp_path / name).write_text(text)
    pages = decode_pages(read_page_files(spark, str(tmp_path), "*.html"), from_encoding="utf-8")
    return pages, f"file:{tmp_path}/index.html"


def test_demo_site(spark, demo):
    pages, seed = demo
    spec = shops.demo_job(seed)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    result = crawl(spark, spec, pages=pages, now=now)
    visits = {r.url.rsplit("/", 1)[1]: r for r in result.visits.collect()}
    assert {u: (r.hop, list(r.seekers), list(r.miners)) for u, r in visits.items()} == {
        "index.html": (0, ["simple_seek"], []), "cat1.html": (1, ["simple_seek"], []), "cat2.html": (1, ["simple_seek"], []),
        # beyond the rule's hop limit, and mined all the same
        "prod1.html": (2, [], ["simple_miner"]), "prod2.html": (2, [], ["simple_miner"])}
    order = [r.url.rsplit("/", 1)[1] for r in result.visits.orderBy("round", "seq").collect()]
    assert order == ["index.html", "cat1.html", "cat2.html", "prod1.html", "prod2.html"]
    assert result.tasks.agg(F.sum("n")).first()[0] == 7
    records = mine_visits(result, pages, spec)["simple_miner"]
    assert sorted((r.name, r.price) for r in records.collect()) == [("prod1", "$45"), ("prod2", "$99")]
    assert result.state.filter("last_status_code = '' AND failed_cnt = 0").count() == 5


def test_crawl_goes_on_from_history(spark, demo):
    pages, seed = demo
    t0 = datetime(2024, 1, 1)
    rows = [(seed, t0, t0, "", 0), (seed.replace("index", "cat1"), t0, t0, "HTTP 500", 4),
            (seed.replace("index", "cat2"), t0 + timedelta(seconds=90), None, "", 0)]
    state = spark.createDataFrame(rows, LINK_STATE)
    later = F.lit(str(t0 + timedelta(seconds=100))).cast("timestamp")
    result = crawl(spark, shops.demo_job(seed), pages=pages, state=state, now=later)
    # index is due again, cat1 was given up, cat2 is still running
    assert [(r.url, r.decision) for r in result.visits.collect()] == [(seed, "revisit")]
    assert [r.url for r in result.deferred.collect()] == [seed.replace("index", "cat2")]
    missing = shops.demo_job(seed.replace("index", "gone"))
    lost = crawl(spark, missing, pages=pages, now=later)
    assert [(r.last_status_code, r.failed_cnt) for r in lost.state.collect()] == [("HTTP 404", 1)]


def test_first_task_of_a_url_wins_with_its_miners(spark):
    rules = (L.Rule("^/a", 9, seekers=("s",)), L.Rule("^/b", 9, seekers=("s",), miners=("first",)),
             L.Rule("^/b", 9, miners=("second",)))
    links = spark.createDataFrame([("/", "s", 1, "/a"), ("/", "s", 0, "/b"), ("/a", "s", 0, "/b"), ("/b", "s", 0, "/"), ("/b", "s", 1, "/b")],
                                  "src_url STRING, seeker STRING, pos INT, link STRING")
    spec = jobs.JobSpec("x", ({"url": "/", "seekers": ["s"]},), {"s": L.SeekerSpec(rules)})
    visits = crawl(spark, spec, links=links).visits
    assert {r.url: list(r.miners) for r in visits.collect()} == {"/": [], "/a": [], "/b": ["first"]}


URLS = {
    "okaybuy": ("http://www.okaybuy.com.cn/com/16891657.html", "okaybuy_item_miner"),
    "paixie": ("http://www.paixie.net/product/325354.html", "paixie_item_miner"),
    "taobao": ("http://item.taobao.com/auction/item_detail-0db1-a4cac5e9329bd6ca120af53b20290cfd.htm", "taobao_item_miner"),
}


def test_shop_rules(spark):
    specs = {"okaybuy": shops.okaybuy_job(), "paixie": shops.paixie_job(), "taobao": shops.taobao_job("gracegift")}
    for shop, (url, miner) in URLS.items():
        (seeker,) = specs[shop].seekers.values()
        urls = spark.createDataFrame([(url,), (url + "?x",), (specs[shop].seeds[0]["url"],)], "link STRING")
        hits = L.match_rules(urls, seeker.rules).collect()
        assert [(h.link, list(h.miners)) for h in hits if h.miners] == [(url, [miner])]
        assert [h.link for h in hits if h.seekers] == [specs[shop].seeds[0]["url"]]
    wrong = (L.Rule(r"^http://item.taobao.com/auction/item_detail-*\.htm$", 51, miners=("taobao_item_miner",)),)
    assert L.match_rules(spark.createDataFrame([(URLS["taobao"][0],)], "link STRING"), wrong).count() == 0


def test_rule_tables_stop_per_link(spark):
    rules = spark.createDataFrame(
        [("r", 0, "/a", 1, 0, "f", ["s"], [], True), ("r", 1, "/", 1, 0, "f", ["s"], [], False), ("q", 0, "/", 1, 0, "f", ["s"], [], False)], RULE)
    links = spark.createDataFrame([("r", "/ab"), ("r", "/b"), ("q", "/ab")], "rule_set STRING, link STRING")
    hits = L.match_rule_table(links, rules).collect()
    assert sorted((h.rule_set, h.link, h.rule_no) for h in hits) == [("q", "/ab", 0), ("r", "/ab", 0), ("r", "/b", 1)]


PREFIXES = {
    "http://a.example/x": "http://a", r"http://a\.example/x": "http://a.example/x", "^/a": "/a", "/ab?c": "/a", "/ab*": "/a", "/ab+c": "/ab",
    "/ab{0}": "/a", "/a|/b": "", "/a(b|c)": "/a", "/a(b|(c|d))x|y": "", "/a[|]b": "/a", r"/a\|b": "/a|b", "(?i)/a": "", r"/a\d": "/a",
    r"\Q/a|b\E": "", ".*x": "", "": "", "/ü-é/?": "/ü-é", r"/a\.?b": "/a", r"/a\\|b": "", "/a$": "/a", "(/a)?/b": "",
}


def test_literal_prefix(spark):
    rows = spark.createDataFrame([(r,) for r in [*PREFIXES, None]], "regex STRING")
    got = {r.regex: r.prefix for r in rows.select("regex", L.literal_prefix(F.col("regex")).alias("prefix")).collect()}
    assert got == {**PREFIXES, None: ""}


def test_indexed_rules_match_as_each_rule_alone(spark):
    import random

    rnd, parts = random.Random(5), ["/a", "/b", "/ab", "x", "é", ".h", "|", "?q", "/a/b"]
    patterns = [p for p in PREFIXES if not p.startswith("\\Q")] + [
        re.escape("".join(rnd.choices(parts, k=rnd.randint(1, 3)))) + rnd.choice(["", "$", ".*", "?", "+", "(/.*)?$", "|/b"]) for _ in range(300)]
    urls = [None, "", "/ü-é", "http://a.example/x"] + ["".join(rnd.choices(parts, k=rnd.randint(1, 5))) for _ in range(120)]
    stops = [rnd.random() < 0.02 for _ in patterns]
    rules = spark.createDataFrame(
        [(f"s{n % 2}", n, p, 1, 0, "f", ["s"], [], stops[n]) for n, p in enumerate(patterns)] + [("s0", 9999, None, 1, 0, "f", [], [], False)], RULE)
    links = spark.createDataFrame([(f"s{k}", i, u) for k in (0, 1, 2) for i, u in enumerate(urls)], "rule_set STRING, i INT, link STRING")
    got = sorted((r.rule_set, r.i, r.rule_no) for r in L.match_rule_table(links, rules).collect())
    want = []
    for k in (0, 1):
        for i, u in enumerate(urls):
            for n in range(k, len(patterns), 2):
                if u is not None and re.match(f"(?:{patterns[n]})" if not patterns[n].startswith("(?i)") else f"(?i:{patterns[n][4:]})", u):
                    want.append((f"s{k}", i, n))
                    if stops[n]:
                        break
    assert got == sorted(want) and len(want) > 500


def test_scope(spark, page):
    pages = page("<a href=1></a><div class=x><a href=2></a></div><div class=x><a href=3></a></div>", "<a href=4></a>", "<div class=x></div><a href=5></a>")
    links = L.extract_links(pages, sel("div", class_="x")).collect()
    assert sorted((r.page_id, r.href) for r in links) == [(0, "2"), (1, "4")]


NOW = datetime(2024, 1, 1, 12)


@pytest.mark.parametrize("start, end, status, failed, interval, want", [
    (None, None, "", 0, 60, "start_new"),
    (100, 60, "", 0, 60, "skip_fresh"), (100, 61, "", 0, 60, "revisit"), (100, 9999, "", 0, 0, "skip_fresh"),
    (30, None, "", 0, 60, "defer_running"), (31, None, "", 0, 60, "restart_timeout"),
    (99, 20, "HTTP 500", 1, 60, "defer_retry"), (99, 21, "HTTP 500", 1, 60, "retry"),
    (99, 81, "HTTP 500", 3, 60, "retry"), (99, 80, "HTTP 500", 3, 60, "defer_retry"),
    (99, 9999, "HTTP 500", 4, 60, "drop_failed"), (None, 5, "HTTP 500", 1, 60, "start_new"),
])
def test_visit_decision(spark, start, end, status, failed, interval, want):
    def ago(seconds):
        return None if seconds is None else NOW - timedelta(seconds=seconds)

    row = spark.createDataFrame([("u", ago(start), ago(end), status, failed)], LINK_STATE)
    decision = S.visit_decision(F.lit(str(NOW)).cast("timestamp"), F.lit(interval))
    assert row.select(decision).first()[0] == want


def test_frontier_batch_takes_whatever_is_there(spark):
    queue = spark.range(10).select(F.col("id").cast("string").alias("url"), (F.col("id") * 50_000).alias("seq"))
    for n, want in ((0, 0), (3, 3), (10, 10), (99, 10)):
        taken, rest = Q.frontier_batch(queue, n)
        assert sorted(r.seq for r in taken.collect()) == [i * 50_000 for i in range(want)]
        assert rest.count() == 10 - want


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = Q.number_rows(df, ["k"], run_folder(spark, "numbers"), 5).collect()
    assert all(r.seq == r.k + 6 for r in rows)


def test_interval_join_against_brute_force(spark):
    import random

    rnd = random.Random(1)
    points = [(p, rnd.randrange(70_000)) for p in (1, 2) for _ in range(150)]
    spans = []
    for p in (1, 2):
        for _ in range(60):
            lo = rnd.randrange(70_000)
            spans.append((p, lo, lo + rnd.choice([-1, 0, 5, 300, 5000, 60_000])))
    a = spark.createDataFrame(points, "page_id INT, x INT").distinct()
    b = spark.createDataFrame(spans, "page_id INT, lo INT, hi INT").distinct()
    got = sorted(tuple(r) for r in stab_join(a, b, "x", "lo", "hi").select("page_id", "x", "lo", "hi").collect())
    want = sorted((p, x, lo, hi) for p, x in set(points) for q, lo, hi in set(spans) if p == q and lo <= x <= hi)
    assert got == want


def test_job_file(spark, tmp_path):
    job = {"name": "demo", "encoding": "utf-8", "policy": {"max_failed": 2, "timeout": 5},
           "seeds": [{"url": "u1", "seekers": ["s"], "hop": 0}, {"url": "u2"}],
           "seekers": [{"name": "s", "scope_name": "div", "scope_attrs": {"class": "x"}, "rules": [
               {"regex": "^a", "max_hop": 3, "next_seekers": ["s"]}, {"regex": "^b", "max_hop": 1, "next_miners": ["m"], "stop_if_matched": True}]}]}
    path = tmp_path / "job.json"
    path.write_text(json.dumps(job))
    spec = jobs.load_job_spec(spark, str(path))
    assert spec.policy == S.Policy(2, 5, 10) and spec.encoding == "utf-8"
    assert spec.seekers["s"].rules[1] == L.Rule("^b", 1, 0, "snapshot", (), ("m",), True)
    assert [(r.url, r.seq) for r in jobs.seed_tasks(spark, spec.seeds).orderBy("seq").collect()] == [("u1", 0), ("u2", 1)]
    table = jobs.read_job_table(spark, str(path))
    assert [(r.rule_set, r.rule_no, r.regex) for r in jobs.rules_table(table).orderBy("rule_no").collect()] == [
        ("demo/s", 0, "^a"), ("demo/s", 1, "^b")]
    assert [r.url for r in jobs.seeds_table(table).orderBy("seq").collect()] == ["u1", "u2"]
    assert jobs.rules_frame(spark, spec).count() == 2


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_stopped_crawl_says_what_is_pending(spark):
    links = [("/", "s", 0, "/a"), ("/", "s", 1, "/b"), ("/a", "s", 0, "/c"), ("/b", "s", 0, "/c"), ("/c", "s", 0, "/")]
    df = spark.createDataFrame(links, "src_url STRING, seeker STRING, pos INT, link STRING")
    spec = jobs.JobSpec("j", ({"url": "/", "seekers": ["s"]},), {"s": L.SeekerSpec((L.Rule("/", 9, 0, "snapshot", ("s",)),))})
    part = crawl(spark, spec, links=df, max_rounds=1)
    assert [r.url for r in part.visits.collect()] == ["/"] and sorted(r.url for r in part.pending.collect()) == ["/a", "/b"]
    rest = crawl(spark, spec, links=df, seeds=part.pending)
    assert {"/a", "/b", "/c"} <= {r.url for r in rest.visits.collect()}
    whole = crawl(spark, spec, links=df)
    assert whole.pending.count() == 0 and sorted(r.url for r in whole.visits.collect()) == ["/", "/a", "/b", "/c"]


def test_snapshots_of_a_url_are_one_visit(spark):
    rows = [(1, "u", "u", "text/html", "<a href='/x'>x</a>"), (2, "u", "u", "text/html", "<a href='/x'>x</a>")]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, final_url STRING, content_type STRING, html STRING")
    spec = jobs.JobSpec("j", ({"url": "u", "seekers": ["s"]},), {"s": L.SeekerSpec((L.Rule(".*", 3, 0, "snapshot", ("s",)),))})
    assert [r.url for r in crawl(spark, spec, pages=pages).visits.collect()].count("u") == 1
    assert [r.page_id for r in P.newest_pages(pages).collect()] == [2]
    tasks = spark.createDataFrame([("u",), ("v",)], "url STRING")
    fetched = {r.url: r.status_code for r in P.snapshot_fetch(tasks, P.newest_pages(pages)).collect()}
    assert fetched == {"u": "", "v": "HTTP 404"}


def test_scoped_links_of_snapshots(spark):
    rows = [("u", "<div id='d'><a name='n'>n</a><a href='/1'>1</a></div>"), ("u", "<div id='d'><a href='/2'>2</a></div><a href='/3'>3</a>")]
    pages = spark.createDataFrame(rows, "url STRING, html STRING")
    got = sorted((r.pos, r.href) for r in L.extract_links(pages, sel("div", id="d"), ["url"]).collect())
    assert got == [(0, "/2"), (1, "/1")]
    plain = sorted((r.pos, r.href) for r in L.extract_links(pages, None, ["url"]).collect())
    assert plain == [(0, "/2"), (1, "/1"), (1, "/3")]


def test_templates_meet_stores_of_their_family(spark):
    stores = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "store STRING, family INT")
    templates = spark.createDataFrame([(0, "^{store}/", 1), (0, "x{store}{store}", 2), (1, "y", 3)], "family INT, regex STRING, max_hop INT")
    got = sorted(map(tuple, jobs.rule_template(stores, templates).collect()))
    assert got == [("a", "^a/", 1), ("a", "xaa", 2), ("b", "y", 3)]


def _ring(spark, n=40):
    """A start page that links to all of a ring of pages, each of which links to the next two."""
    links = [("/", "s", i, f"/{i}") for i in range(0, n, 8)]
    links += [(f"/{i}", "s", k, f"/{(i + k + 1) % n}") for i in range(n) for k in (0, 1, 1)]
    spec = jobs.JobSpec("ring", ({"url": "/", "seekers": ["s"]},), {"s": L.SeekerSpec((L.Rule("/", 99, 0, "snapshot", ("s",)),))})
    return spark.createDataFrame(links, "src_url STRING, seeker STRING, pos INT, link STRING"), spec


def _visited(result):
    return sorted((r.round, r.url, r.hop, list(r.seekers)) for r in result.visits.collect())


@pytest.mark.parametrize("lost", ["links", "rounds/round=0", "rounds/round=3", "log/round=2"])
def test_a_crawl_goes_on_after_its_driver_was_lost(spark, monkeypatch, lost):
    links, spec = _ring(spark)
    whole = crawl(spark, spec, links=links)
    folder, written = run_folder(spark, "lost"), []
    plain_cut, plain_commit = plans.cut_lineage, plans.CrawlLog.commit

    def cut(df, path):
        if path.endswith(f"/{lost}"):
            # the round's files are there, its line in the log is not
            plain_cut(df, path)
            raise KeyboardInterrupt
        written.append(path.removeprefix(folder))
        return plain_cut(df, path)

    def commit(log, number, value):
        if lost == "links" and number == -1 or lost == f"log/round={number}":
            raise KeyboardInterrupt
        plain_commit(log, number, value)

    with monkeypatch.context() as patch:
        patch.setattr(plans, "cut_lineage", cut)
        patch.setattr(plans.CrawlLog, "commit", commit)
        with pytest.raises(KeyboardInterrupt):
            crawl(spark, spec, links=links, folder=folder)
    before = set(written)
    written.clear()
    with monkeypatch.context() as patch:
        patch.setattr(plans, "cut_lineage", lambda df, path: written.append(path.removeprefix(folder)) or plain_cut(df, path))
        again = crawl(spark, spec, links=links, folder=folder)
    assert _visited(again) == _visited(whole) and again.rounds == whole.rounds
    if "/rounds/round=1" in before:
        # neither the links nor a committed round are made a second time
        assert not {"/tasks", "/rounds/round=0", "/rounds/round=1"} & set(written)
    assert _visited(crawl(spark, spec, links=links, folder=folder)) == _visited(whole)
    other = jobs.JobSpec("ring", ({"url": "/1", "seekers": ["s"]},), spec.seekers)
    with pytest.raises(ValueError):
        crawl(spark, other, links=links, folder=folder)


def test_rounds_of_one_crawl_may_be_asked_for_in_turn(spark):
    links, spec = _ring(spark)
    whole, folder = crawl(spark, spec, links=links), run_folder(spark, "turns")
    for n in range(1, whole.rounds + 2):
        part = crawl(spark, spec, links=links, folder=folder, max_rounds=n)
        assert part.rounds == min(n, whole.rounds)
    assert _visited(part) == _visited(whole) and part.pending.count() == 0


def test_hubs_lie_in_pieces_and_lose_no_link(spark, monkeypatch):
    links, spec = _ring(spark)
    want = sorted((r.url, r.hop, r.n) for r in crawl(spark, spec, links=links).tasks.collect())
    folder = run_folder(spark, "hubs")
    buckets = plans.lay_out(links, spec.seekers, folder, hub=2)
    graph = plans.link_graph(spark, spec.seekers, folder, buckets)
    assert [(r.src_url, r.pieces) for r in graph.hubs.collect()] == [("/", 3)]
    assert graph.links.filter("source LIKE '%/'").select("source").distinct().count() > 1
    monkeypatch.setattr(plans, "lay_out", lambda *a: buckets)
    monkeypatch.setattr(plans, "FEW_SOURCES", 3)
    result = crawl(spark, spec, links=links, folder=folder)
    assert sorted((r.url, r.hop, r.n) for r in result.tasks.collect()) == want


def test_a_round_does_not_move_links(spark):
    links, spec = _ring(spark)
    folder = run_folder(spark, "plan")
    graph = plans.link_graph(spark, spec.seekers, folder, plans.lay_out(links, spec.seekers, folder))
    visits = spark.range(5000).select(
        F.concat(F.lit("/"), F.col("id").cast("string")).alias("url"), F.col("id").alias("seq"), F.lit(0).alias("hop"),
        F.array(F.lit("s")).alias("seekers"), F.lit("").alias("status_code"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans._next_tasks(visits, graph)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # the one exchange is that of the frontier
    assert plan.count("Exchange hashpartitioning(source") == 1 and "Bucketed: true" in plan
    few = plans._next_tasks(visits.filter("seq < 2"), graph)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: [^\]]*In\(source", few)


def test_written_site_is_dealt_out(spark, tmp_path):
    """Listings and items lie in files of like size, whatever the sizes of the stored tables."""
    from sitegraph.catalog.frontier import shop_site, written_site

    spark.range(1).selectExpr("CAST(id AS INT) AS n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(40).selectExpr("id AS s_suppkey", "0 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(400).selectExpr("id AS p_partkey", "'p' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    site = written_site(spark, str(tmp_path))
    assert sorted(map(tuple, site.collect())) == sorted(map(tuple, shop_site(spark, str(tmp_path)).collect()))
    sizes = [r["count"] for r in site.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 4


def test_anchors_without_href_cost_no_reading(page):
    """They are dropped by their letters before attributes are cut; what looks like href is not one."""
    links = L.extract_links(page("<a name='n'>1</a><A HREF=' x '>2</A><a title='href'>3</a><a>4</a><a hrefs=y>5</a><a href>6</a>"))
    assert [(r.pos, r.href) for r in links.orderBy("pos").collect()] == [(1, "x"), (5, "href")]
    assert "(?i)href" in links._jdf.queryExecution().optimizedPlan().toString()


def test_parts_are_listed_once_per_number(spark, tmp_path):
    """Markup of supplier pages is made after their rows were dealt out: no list is collected per supplier.
    Suppliers that come twice list each part twice; keys that are null make no page."""
    from sitegraph.catalog.frontier import shop_site

    spark.createDataFrame([(1,), (2,), (None,)], "n_nationkey INT").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(3, 1), (3, 2), (100, 1), (4, None), (50, 1), (None, 2)], "s_suppkey BIGINT, s_nationkey INT").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(3, "a"), (100, "b"), (100, "b"), (10, "c"), (7, None), (4, "d"), (None, "e")], "p_partkey BIGINT, p_name STRING").write.parquet(f"{tmp_path}/part.parquet")
    site = shop_site(spark, str(tmp_path))

    def listing(kind, *keys):
        return "<html><body><ul>" + "".join(f"<li><a href=' {kind}{k}.html '>x</a><a name='n'>y</a>" for k in keys) + "</ul></body></html>"

    def item(key, name):
        price = f"<span class='price'>${key}</span>" if key % 7 else ""
        return f"<html><body><h1>{name}</h1><div class='box'>{price}</div><a href='index.html'>home</a></body></html>"

    at = "http://shop.example/"
    want = [(at + "index.html", listing("nation", 1, 2)), (at + "nation1.html", listing("supplier", 100, 3, 50)),
            (at + "nation2.html", listing("supplier", 3)), (None, listing("supplier", 4)),
            (at + "supplier3.html", listing("part", 100, 100, 100, 100, 3, 3)), (at + "supplier100.html", listing("part", 100, 100, 3)),
            (at + "supplier4.html", listing("part", 4)), (at + "part3.html", item(3, "a")),
            (at + "part4.html", item(4, "d")), (at + "part7.html", None)]
    assert sorted(((r.url, r.html) for r in site.collect()), key=str) == sorted(want, key=str)
    above: list[tuple[int, str]] = []
    for line in site._jdf.queryExecution().optimizedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [a for a in above if a[0] < depth] + [(depth, line)]
        assert "Join" not in line or not any("collect_list" in a for _, a in above)


def test_named_tags_are_those_of_all_tokens(page):
    """Passing over other tokens finds the same start tags at the same places."""
    import random

    from sitegraph.functions import nesting
    from sitegraph.operators import html_nodes as H

    rnd = random.Random(3)
    bits = ["<a href=1>", "<A HREF='x'>", "<a", "<a href=2 ", "</a>", "<!-- <a href=3> -->", "<!--", "<script>", "</script>", "<script src=x>", "<b>", "<abbr>",
            "text", " < ", "<a/>", "<![CDATA[ <a> ]]>", "<?php <a> ?>", "<!doctype x>", "<! <a>>", "<a href='<a>'>", "<a href=\"x>", "\n", "é", "'", ">", "<textarea>", "</textarea >", "<br/>"]
    pages = page(*["".join(rnd.choices(bits, k=rnd.randint(0, 12))) for _ in range(400)], "", None)
    rules = nesting.DIALECTS["html"]
    pieces = F.filter(H._pieces(H.massage_markup(F.col("html")), rules), lambda p: p.rlike("(?i)^<(?:a|script)(?![-_.:a-zA-Z0-9])"))
    for names in (["a"], ["script", "a"]):
        kept = F.filter(pieces, lambda p: p.rlike("(?i)^<(?:" + "|".join(names) + ")(?![-_.:a-zA-Z0-9])"))
        old = pages.select("page_id", F.posexplode(kept).alias("pos", "raw")).withColumn("kind", H._token_kind(F.col("raw"))).filter("kind <> 'drop'")
        want = sorted((r.page_id, r.pos, r.kind, r.raw) for r in old.collect())
        got = sorted((r.page_id, r.pos, r.kind, r.raw) for r in H.html_tokens(pages, names=names).collect())
        assert got == want and len(want) > 200


def test_one_attribute_of_a_tag(spark):
    from sitegraph.operators import html_nodes as H

    tags = ["<a href='x'>", '<A HREF = "x" >', "<a href=x>", "<a href>", "<a>", "<a href=''>", "<a title='href' href='y' id=z>", "<a href='1' href='2'>",
            "<a href='1' href=2>", "<a href='1' href>", "<a hrefs='1'>", "<a href-x='1' href='2'>", "<a href='a&amp;b'>", "<a href='it\"s'>", "<a title=\"href='1'\" href='2'>",
            "<a\nhref='x\ny'>", "<a href='x' =>", "<a href='x' />", "<a href='x'id='y'>", "<a = href='x'>", "<a href='x", "<a class=q href='ä'   b>", "<a href='x' >"]
    rows = spark.createDataFrame([(t,) for t in tags], "raw STRING")
    pairs = F.filter(H.attr_pairs(F.col("raw"), F.lit("a")), lambda a: a["k"] == "href")
    both = rows.select("raw", F.try_element_at(pairs, F.lit(-1))["v"].alias("want"), H.attr_value(F.col("raw"), "a", "href").alias("got")).collect()
    assert {r.raw: r.got for r in both} == {r.raw: r.want for r in both}


def test_bare_names_are_put_behind_the_folder(spark):
    from sitegraph.functions.urls import base_folder

    bases = [RFC_BASE, "http://a", "http://a/", "file:/s/index.html", "x", "", None, "http://a/b/../c/d", "http://a/./x", "mailto:me", "?q", "http://a/b/..", "//h/p"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in [*RFC, "x y", "a\nb", ".x", None]], "base STRING, ref STRING")
    base, ref = F.col("base"), F.col("ref")
    odd = rows.filter(~resolve_url(base, ref).eqNullSafe(resolve_url(base, ref, base_folder(base))))
    assert odd.collect() == []


def test_rule_numbers_are_those_of_matched_rules(spark):
    rules = (L.Rule("/a", 1), L.Rule("/b", 1, stop_if_matched=True), L.Rule("/ab", 1), L.Rule("/", 1, stop_if_matched=True), L.Rule("", 1))
    links = spark.createDataFrame([("/ab",), ("/b",), ("x",), ("",), (None,)], "link STRING")
    for some in (rules, rules[:1], rules[2:3] + rules[4:], ()):
        want = sorted((r.link, r.rule_no) for r in L.match_rules(links, some).collect()) if some else []
        got = links.select("link", F.explode(L.matching_rules(F.col("link"), some)).alias("n")).collect()
        assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("packed", [True, False])
def test_first_tasks_are_found_without_sorting_links(spark, packed):
    """A hash table with one number per URL finds the first task, as comparing all parts of its place does."""
    import random

    rnd = random.Random(9)
    links = [(f"/{rnd.randrange(30)}", rnd.choice("st"), rnd.randrange(50), f"/{rnd.choice('abc')}{rnd.randrange(12)}") for _ in range(600)]
    links = spark.createDataFrame(links, "src_url STRING, seeker STRING, pos INT, link STRING")
    seekers = {"s": L.SeekerSpec((L.Rule("/a", 2, seekers=("s",)), L.Rule("/[ab]", 9, seekers=("t",), miners=("m",)), L.Rule("/c", 9))),
               "t": L.SeekerSpec((L.Rule("/c", 1, seekers=("s",)), L.Rule("/", 0, miners=("n",))))}
    folder = run_folder(spark, "first")
    graph = plans.link_graph(spark, seekers, folder, plans.lay_out(links, seekers, folder))
    assert graph.last_pos == 49
    seq = F.shiftleft(F.pmod(F.col("id") * 7, F.lit(3)), 33) + F.pmod(F.col("id") * 11, F.lit(31))
    visits = spark.range(30).select(
        F.concat(F.lit("/"), F.col("id").cast("string")).alias("url"), seq.alias("seq"), (F.col("id") % 4).cast("int").alias("hop"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("t"), F.lit("s"))).otherwise(F.array(F.lit("s"))).alias("seekers"), F.lit("").alias("status_code"))
    want = Q.dedup_visits(plans._next_tasks(visits, graph).drop("n"), plans._ORDER)
    found = plans._first_tasks(visits, graph if packed else plans.replace(graph, last_pos=None))
    columns = [*plans.TASK_COLUMNS, *plans._ORDER]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, want.select(columns).collect())) != []
    if packed:
        limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = plans._found_links(visits, graph, look_up=False)._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and "Sort " not in plan
            assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
