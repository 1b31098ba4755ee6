"""Shop records from encoded pages, records on disk, and streams."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitegraph.operators import linkstate as S
from sitegraph.operators import mine as M
from sitegraph.operators import report as R
from sitegraph.operators.select import sel
from sitegraph.plans import shops
from sitegraph.schemas import FETCH_EVENT
from sitegraph.session import run_folder
from sitegraph.sources import decode as D
from sitegraph.sources.sinks import check_json_lines, read_json_lines, read_run, save_run, write_products
from sitegraph.streaming import history as H
from sitegraph.streaming import keyed

TAOBAO = """<html><head><meta http-equiv="Content-Type" content="text/html; charset=gb2312"></head><body>
<div class="detail-hd"><h3><a href="/i.htm?a=1&amp;b=2">红色鞋</a></h3></div><ul>
<li class="detail-price clearfix"><span>价</span><strong>99.00</strong></li><li class="sold-out clearfix"><em>12</em></li>
<li id="J_PostageCont">js</li></ul><ul class="attributes-list"><li title="品牌">\t品牌:&nbsp;x\r\n</li><li>-</li></ul>
<ul id="J_UlThumb" class="thumb clearfix"><li><img src="http://i/1.jpg_40x40.jpg"><li><img src="http://i/2.jpg"></ul></body></html>"""


def shop_page(spark, *texts):
    rows = [(i, f"http://shop/{i}", t.encode("gb2312")) for i, t in enumerate(texts)]
    return D.decode_pages(spark.createDataFrame(rows, "page_id BIGINT, url STRING, data BINARY"), from_encoding="gb2312")


def test_taobao_from_encoded_bytes(spark):
    pages = shop_page(spark, TAOBAO, "<p>nothing</p>")
    full, empty = M.as_products(M.mine(pages, shops.taobao_miner())).orderBy("url").collect()
    assert (full.prod_name, full.sku_url, full.prod_price, full.sold_amount, full.shipping_cost, full.error) == (
        "红色鞋", "/i.htm?a=1&b=2", "99.00", "12", "0.0", "")
    assert [tuple(d) for d in full.prod_details] == [("品牌", "品牌: ;x")]
    assert [tuple(i) for i in full.images] == [(0, "s", "http://i/1.jpg_40x40.jpg"), (0, "f", "http://i/1.jpg"),
                                               (1, "s", "http://i/2.jpg"), (1, "f", "http://i/2.jpg")]
    assert empty.error == ("failed to parse prod_name; failed to parse prod_price; failed to parse sold_amount; "
                           "failed to parse shipping_cost; failed to parse details; failed to get images; ")


def test_errors_keep_earlier_fields(spark, page):
    pages = page(
        "<div id=areaPro><div class=info><h1>n</h1><ul><li><strong>b</strong></li><li><span>t</span></li></ul></div></div>",
        "<ul class=title><li class=fl><h1>a<i>b</i></h1></li></ul><div class=txt1></div><div class=txt2><p class=size><a>1</a><a><b>2</b></a></p></div>")
    first = M.as_products(M.mine(pages, shops.paixie_miner())).orderBy("url").first()
    assert (first.prod_name, first.prod_brand, first.prod_aution_type, first.prod_type) == ("n", "b", "t", None)
    assert first.error == "Failed to extract prod price and shippingFailed to extract size; Failed to extract image; "
    second = M.as_products(M.mine(pages, shops.okaybuy_miner())).orderBy("url").collect()[1]
    # a heading with markup has no single string: no name, but no error either
    assert second.prod_name is None
    assert second.error == "Failed to extract prod_skuFailed to extract size; Failed to extract image; "


def test_product_json_has_the_keys_of_its_site(spark):
    products = M.as_products(M.mine(shop_page(spark, TAOBAO), shops.taobao_miner()))
    record = json.loads(products.select(M.product_json()).first()[0])
    assert record["prod_img_f_0"] == "http://i/1.jpg" and "prod_brand" not in record
    assert record["prod_details"] == [{"attr_name": "品牌", "attr_value": "品牌: ;x"}]
    pretty = M.mine_report(products).first().record
    assert json.loads(pretty) == record and "\n" in pretty


def test_decoding(spark):
    rows = [
        (0, b"<p>caf\xe9 \x93x\x94 \x80</p>"), (1, "<?xml version='1.0' encoding='KOI8-R'?><p>р</p>".encode("koi8-r")),
        (2, '<meta content="text/html; charset=Big5">中'.encode("big5")), (3, "中".encode()), (4, b""),
        (5, '<?xml version="1.0"?>x'.encode("utf-16-be")), (6, b"\x4c\x6f\xa7\x94"),
    ]
    out = D.decode_pages(spark.createDataFrame(rows, "page_id INT, data BINARY")).orderBy("page_id").collect()
    assert out[0].html == "<p>café &ldquo;x&rdquo; &euro;</p>" and out[0].used_encoding == "windows-1252"
    assert out[1].html.endswith("р</p>") and out[1].declared_encoding == "koi8-r"
    assert out[2].html.endswith("中") and out[2].used_encoding == "big5"
    assert out[3].html == "中" and out[3].used_encoding == "utf-8"
    assert out[4].html == ""
    assert out[5].sniffed_encoding == "utf-16be" and out[5].html == '<?xml version="1.0"?>x'
    assert out[6].sniffed_encoding == "ebcdic"
    real = D.decode_pages(spark.createDataFrame([(0, b"a\x93b\xff"), (1, b"a\x81\xff")], "page_id INT, data BINARY"), quotes_to=None)
    assert [(r.html, r.used_encoding) for r in real.orderBy("page_id").collect()] == [("a\u201cb\xff", "windows-1252"), (None, None)]
    bad = D.decode_pages(spark.createDataFrame([(0, b"a\xff")], "page_id INT, data BINARY"), from_encoding="utf-8").first()
    assert bad.html == "a�"
    quotes = spark.range(1).select(D.smart_quotes(F.lit("\x93a\x81\x9f"), "xml")).first()[0]
    assert quotes == "&#x201C;a &#x;"


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": \n\n{"b": "中"}\n')
    rows = check_json_lines(read_json_lines(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [(r.line_no, r.valid) for r in rows] == [(1, True), (2, False), (3, False), (4, True)]
    assert rows[1].report == "Line 2: is not valid JSON" and "中" in rows[3].report
    assert rows[0].report.startswith("Line 1: {\n")


def test_long_files_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"{i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = read_json_lines(spark, str(tmp_path))
        assert lines.filter("line_no <> CAST(value AS INT)").count() == 0 and lines.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_writing_appends_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "中"), ("u2", None)], "url STRING, name STRING")
    out = str(tmp_path / "out")
    assert write_products(rows, out) == 2 and write_products(rows.limit(1), out) == 1
    lines = [r.value for r in spark.read.text(out).collect()]
    assert len(lines) == 3 and all(line.isascii() for line in lines)
    assert {json.loads(line)["url"] for line in lines} == {"u1", "u2"}


def test_runs(spark):
    folder = run_folder(spark, "runs")
    for run, n in ((0, 1), (1, 5), (1, 2)):
        save_run(spark.createDataFrame([(n,)], "a INT"), folder, run)
    assert read_run(spark, folder, "a INT").collect() == [(2,)] and read_run(spark, folder, "a INT", 0).collect() == [(1,)]


def test_a_description_may_have_many_selectors(page):
    spec = M.MineSpec("x", (M.Group("no", tuple(M.Field(f"f{n}", (M.Step(sel("p", id=f"i{n}")),)) for n in range(100))),))
    got = M.mine(page("".join(f"<p id='i{n}'>t{n}</p>" for n in range(100))), spec).first()
    assert [got[f"f{n}"] for n in range(100)] == [f"t{n}" for n in range(100)]


def test_snapshots_of_a_url_are_pages_of_their_own(spark):
    rows = [("u", "<p id='i'>old</p>"), ("u", "<p id='i'>new</p>"), ("u", "<p id='i'>new</p>")]
    pages = spark.createDataFrame(rows, "url STRING, html STRING")
    spec = M.MineSpec("x", (M.Group("no", (M.Field("f", (M.Step(sel("p", id="i")),)),)),))
    assert sorted(r.f for r in M.mine(pages, spec, ["url"]).collect()) == ["new", "new", "old"]


def brute_state(events):
    state = {}
    for url, ts, kind, status in sorted(events, key=lambda e: e[1]):
        start, end, code, failed = state.get(url, (None, None, "", 0))
        if kind == "start":
            state[url] = (ts, end, code, failed)
        else:
            state[url] = (start, ts, status, failed + 1 if status else 0)
    return state


def make_events(n=400):
    import random

    rnd, t0 = random.Random(3), datetime(2024, 1, 1)
    # one URL owns a third of all events
    return [("hot" if rnd.random() < 0.34 else f"u{rnd.randrange(20)}", t0 + timedelta(minutes=7 * i),
             *rnd.choice([("start", ""), ("end", ""), ("end", "HTTP 500"), ("end", "URL x")])) for i in range(n)]


def as_dict(state):
    return {r.url: (r.last_start_ts, r.last_end_ts, r.last_status_code, r.failed_cnt) for r in state.collect()}


def test_fold_against_brute_force(spark):
    events = make_events()
    df = spark.createDataFrame(events, FETCH_EVENT)
    assert as_dict(S.link_state_fold(df)) == brute_state(events)


def run_in_batches(spark, start):
    """The events as a stream of five files in time order."""
    root = run_folder(spark, "batches")
    events, rows = make_events(), []
    writer = None
    for n in range(5):
        part = events[n * 80:(n + 1) * 80]
        rows += part
        spark.createDataFrame(part, FETCH_EVENT).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(FETCH_EVENT).parquet(f"{root}/in")
        writer = start(stream, root)
        writer.trigger(availableNow=True).start().awaitTermination()
    return root, rows


def test_stream_equals_batch(spark):
    root, rows = run_in_batches(spark, lambda s, root: H.link_state_stream(s, f"{root}/state", f"{root}/check"))
    assert as_dict(H.read_states(spark, f"{root}/state")) == brute_state(rows)
    # a batch writes the states of its own URLs only
    parts = spark.read.parquet(f"{root}/state").groupBy("batch").agg(F.countDistinct("url").alias("urls")).orderBy("batch").collect()
    assert [r.urls for r in parts] == [len({e[0] for e in rows[n * 80:(n + 1) * 80]}) for n in range(5)]


def test_hot_and_late_events_of_one_batch(spark):
    """A URL with nearly all events, several at one time, in one batch and out of order."""
    t0 = datetime(2024, 1, 1)
    rows = [("hot", t0 + timedelta(seconds=(7 * n) % 50), "start" if n % 3 == 0 else "end", "" if n % 3 == 0 or n % 50 == 20 else f"HTTP {n % 2}") for n in range(900)]
    rows += [("cold", t0, "start", ""), ("bad", t0, "end", "HTTP 500"), ("bad", t0, "end", "HTTP 404"), (None, t0, "end", ""), ("none", None, "end", "")]
    root = run_folder(spark, "hot")
    spark.createDataFrame(rows, FETCH_EVENT).repartition(6).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(FETCH_EVENT).parquet(f"{root}/in")
    H.link_state_stream(stream, f"{root}/state", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    good = spark.createDataFrame([r for r in rows if r[0] and r[1]], FETCH_EVENT)
    assert as_dict(H.read_states(spark, f"{root}/state")) == as_dict(S.link_state_fold(good))


def test_urls_of_a_bucket_share_a_state(spark, monkeypatch):
    """Python is called, and a state kept, per bucket of URLs and not per URL; quiet URLs keep theirs."""
    monkeypatch.setattr(keyed, "BUCKETS", 3)
    t0, root, rows = datetime(2024, 1, 1), run_folder(spark, "buckets"), []
    for n in range(3):
        part = [(f"u{k}", t0 + timedelta(hours=n, minutes=k % 7), kind, "" if kind == "start" or k % 5 == n else f"HTTP {k % 3}")
                for k in range(60) if n == 0 or k % (n + 1) for kind in ("start", "end")[k % 2:]]
        rows += part
        spark.createDataFrame(part, FETCH_EVENT).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(FETCH_EVENT).parquet(f"{root}/in")
        run = H.link_state_stream(stream, f"{root}/state", f"{root}/check").trigger(availableNow=True).start()
        run.awaitTermination()
        assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    assert as_dict(H.read_states(spark, f"{root}/state")) == as_dict(S.link_state_fold(spark.createDataFrame(rows, FETCH_EVENT)))


def test_state_of_quiet_urls_goes(spark):
    """Once the watermark is past a URL's interval, a timer takes its state away."""
    t0, root = datetime(2024, 1, 1), run_folder(spark, "quiet")
    kept = []
    for n, part in enumerate([[(f"u{k}", t0) for k in range(50)], [("u0", t0 + timedelta(days=9))], [("u0", t0 + timedelta(days=18))], [("u0", t0 + timedelta(days=27))]]):
        spark.createDataFrame(part, "url STRING, ts TIMESTAMP").coalesce(1).write.mode("append").parquet(f"{root}/in")
        due = H.revisit_stream(spark.readStream.schema("url STRING, ts TIMESTAMP").parquet(f"{root}/in"), 86400)
        run = due.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
        run.awaitTermination()
        kept.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert spark.read.parquet(f"{root}/out").count() == 53
    assert kept[-1] < kept[0] / 5

def test_stateful_operator_equals_batch(spark):
    def start(stream, root):
        def save(batch, number):
            batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

        return H.link_states(stream).writeStream.outputMode("update").foreachBatch(save) \
            .option("checkpointLocation", f"{root}/check")

    root, rows = run_in_batches(spark, start)
    out = spark.read.parquet(f"{root}/out")
    latest = out.groupBy("url").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("url", "batch")]), "batch").alias("s"))
    assert as_dict(latest.select("url", "s.*")) == brute_state(rows)


def test_upsert_keeps_rows_without_time_or_key(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 1, 1), (None, 1, 1), (None, 2, 2)], "url STRING, t INT, v INT")
    got = R.product_upsert(df, "url", ["t"], ["v"]).collect()
    assert sorted((str(r.url), str(r.t), r.action) for r in got) == [
        ("None", "1", "insert"), ("None", "2", "update"), ("a", "1", "unchanged"), ("a", "None", "insert")]


def test_revisits_do_not_depend_on_batches(spark):
    """One task every two days for ten days, and a busy URL: due again after a day."""
    t0 = datetime(2024, 1, 1)
    tasks = [("slow", t0 + timedelta(days=2 * n)) for n in range(5)] + [("busy", t0 + timedelta(hours=n)) for n in range(200)]
    tasks = sorted(tasks, key=lambda x: x[1]) + [(None, t0)]
    want, last = [], {}
    for url, ts in tasks[:-1]:
        if url not in last or (ts - last[url]).total_seconds() > 86400:
            last[url] = ts
            want.append((url, ts))
    for batches in (1, 5):
        root, size = run_folder(spark, "revisit"), -(-len(tasks) // batches)
        for n in range(batches):
            spark.createDataFrame(tasks[n * size:(n + 1) * size], "url STRING, ts TIMESTAMP").coalesce(1).write.mode("append").parquet(f"{root}/in")
            due = H.revisit_stream(spark.readStream.schema("url STRING, ts TIMESTAMP").parquet(f"{root}/in"), 86400)
            due.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check") \
                .trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(f"{root}/out").collect())) == sorted(want)


def test_raw_events_are_combined_before_they_move(spark):
    plan = S.link_state_fold(spark.createDataFrame(make_events(), FETCH_EVENT))._jdf.queryExecution().executedPlan().toString()
    # below every exchange by url or time of raw rows stands a partial aggregate; no window anywhere
    assert "Window" not in plan
    below = [b for a, b in zip(plan.splitlines(), plan.splitlines()[1:]) if "Exchange hashpartitioning" in a]
    assert below and all("Aggregate" in b or "Project" in b or "Filter" in b for b in below)


def test_upsert_with_nulls_and_slices(spark):
    rows = [("a", i, v) for i, v in enumerate([1, 1, None, None, 2, 2, 1])]
    df = spark.createDataFrame(rows, "url STRING, t INT, v INT")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for ranges in ("1", "3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        got = R.product_upsert(df, "url", ["t"], ["v"]).orderBy("t").collect()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert [r.action for r in got] == ["insert", "unchanged", "update", "unchanged", "update", "unchanged", "update"]
