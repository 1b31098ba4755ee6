"""The operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitegraph.llm import words as Wd
from sitegraph.llm.ann import Hashing, nearest
from sitegraph.llm.common import components, saved, saved_side, saved_with
from sitegraph.llm.decontaminate import align, leaks
from sitegraph.llm.licenses import scan_licenses
from sitegraph.llm.mixing import mix_sources
from sitegraph.llm.ngram_join import jaccard_components, one_of_each
from sitegraph.llm.sharding import capacities, fill, ring, shard_rows
from sitegraph.llm.toolchat import canonical, faults, link_tools, parsed
from sitegraph.llm.warc import derive

DOC = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, shard INT, size STRING, node STRING, t INT, path INT, score STRING"
LONG = " ".join(f"w{i}" for i in range(30_000))


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None, 9, "x", "y", 5, 7, "z") for i, t, s in rows], DOC)


ODD = [(1, "Aa bb cc dd", "b"), (1, "Aa bb cc dd", "b"), (None, "aa bb cc dd", None), (2, None, "a"), (3, "", None), (4, " \t\n", "a"),
       (5, LONG, "a"), (6, LONG + " tail", "a"), (7, "one", "b"), (8, "one", "c"), (9, "ünï cödé  x", "é"), (9, "other text", "é")]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_words_are_those_of_the_pattern():
    texts = ["", "a", " a b ", "x" * 5, None, "é b\tC", "tail", " ", "b"]
    got = [[] for _ in texts]
    for w in Wd.slices(pa.array(texts)):
        raw = w.raw.tobytes()
        for s, e, d in zip(w.start, w.end, w.doc, strict=True):
            got[w.first + d].append(raw[s:e].decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_word_hashes_depend_on_the_word_only():
    one = next(Wd.slices(pa.array(["abc Abd xyz"])))
    two = next(Wd.slices(pa.array(["", "zz", "q xyz ABC"])))
    assert one.hashes()[0] == two.hashes()[3] and one.hashes()[2] == two.hashes()[2] and len(set(one.hashes())) == 3


def test_long_texts_are_slices_of_their_own(monkeypatch):
    monkeypatch.setattr(Wd, "SLICE_BYTES", 64)
    texts = ["a b " * 5, LONG[:5000], None, "c"]
    assert [(w.first, int(w.counts().sum())) for w in Wd.slices(pa.array(texts))] == [
        (0, 10), (1, len(LONG[:5000].split())), (2, 1)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 9), (7, 7)], "a BIGINT, b BIGINT")
    assert dict(rows_of(components(edges, "c"))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert components(edges.limit(0), "c").count() == 0


# sharding

def test_ring_fills_every_shard_evenly():
    nodes = ring(5, 8)
    counts = {k: (k * 7) % 11 for k in range(len(nodes))}
    total = sum(counts.values())
    plan = fill(nodes, counts, capacities(total, 5))
    for arc, n in counts.items():
        got = sorted((a, b) for x, a, b, _, _ in plan if x == arc)
        assert [a for a, _ in got] == [0, *[b for _, b in got]][:len(got)] and (got[-1][1] if got else 0) == n
    loads = {}
    for _, a, b, s, slot in sorted(plan, key=lambda p: (p[3], p[4])):
        assert slot == loads.get(s, 0)
        loads[s] = slot + b - a
    assert sorted(loads.values()) == sorted(capacities(total, 5))


def test_a_new_shard_moves_few(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "string(id) AS text")
    a, b = ({r.doc_id: r.shard for r in shard_rows(docs, n).collect()} for n in (24, 25))
    # a plain modulus would move 96 %; overflow moves some more than the new shard's share
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)


def test_shards_of_odd_rows(spark):
    got = rows_of(shard_rows(table(spark, ODD), 3))
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2] or 0) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 8, 0 if t is None else zlib.crc32(t.encode())) for i, t, _ in ODD)
    slots = [sorted(r[4] for r in got if r[3] == s) for s in range(3)]
    assert slots == [list(range(4))] * 3
    assert shard_rows(table(spark, ODD).limit(0), 3).count() == 0


# mixing

def test_mix_of_odd_rows(spark):
    got = rows_of(mix_sources(table(spark, ODD)))
    assert len(got) == len(ODD) and {r[1] for r in got} == {"a", "b", "c", "é", None}
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in ODD)
    assert sorted(r[2] for r in got) == sizes and all(0 <= r[5] <= 2 * r[2] for r in got)
    for src in {r[1] for r in got}:
        own = [r for r in got if r[1] == src]
        assert sum(r[2] for r in own) == own[0][3] and abs(sum(r[5] for r in own) - own[0][4]) <= 8
        assert own[0][4] <= 2 * own[0][3] + 1e-9
    assert sum({r[1]: r[4] for r in got}.values()) == pytest.approx(1.5 * sum(sizes))
    assert mix_sources(table(spark, ODD).limit(0)).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mix_sources(table(spark, ODD)))))


def test_quotas_of_shards_sum_to_those_of_sources(spark):
    from sitegraph.llm.mixing import quotas, shard_quotas, targets

    sources = spark.createDataFrame([("a", 1000), ("b", 5000), ("c", 40), (None, 300)], "src STRING, source_size BIGINT")
    whole = quotas(targets(sources, (5, 2, 1), 1.5, 2.0), 16, 2.0)
    want, got = {r.src: r.quota for r in whole.collect()}, {}
    for r in shard_quotas(whole, 7).collect():
        got.setdefault(r.src, []).append(r.blocks)
    assert {k: sum(v) for k, v in got.items()} == want and all(len(v) == 7 for v in got.values())
    # every shard is a mix by itself: a source's parts differ by the rounding only
    assert all(max(v) - min(v) <= 2 for v in got.values())


def test_small_sources_come_near_their_targets(spark):
    """Sources of a few words, at the query's own block size; and the words that are taken, block by block."""
    texts = {"a": [1, 4], "b": [3], "c": [200, 0, 37], "d": [6000, 1, 1, 999], "e": [2], None: [5]}
    docs = [(10 * k + i, " ".join(["w"] * n), s) for k, (s, sizes) in enumerate(texts.items()) for i, n in enumerate(sizes)]
    got = rows_of(mix_sources(table(spark, docs)))
    for src, sizes in texts.items():
        own = [r for r in got if r[1] == src]
        assert sorted(r[2] for r in own) == sorted(sizes) and abs(sum(r[5] for r in own) - own[0][4]) <= 8
        assert sum(sizes) > 8 or abs(sum(r[5] for r in own) - own[0][4]) <= 0.5 + 1e-9
        assert all((r[6] is None) <= (r[5] < r[2] or not r[2]) and (r[6] is None or 0 <= r[6] < 16) for r in own)


# n-gram join

def test_join_of_odd_rows(spark):
    got = sorted(((r[0] is None, r[0] or 0, r[1], r[2]) for r in rows_of(jaccard_components(table(spark, ODD)))))
    n = len(LONG.split())
    assert got == sorted([(False, 1, 2, 1), (False, 1, 2, 1), (True, 0, 2, 1), (False, 2, 0, 2), (False, 3, 0, 3), (False, 4, 0, 4),
                          (False, 5, n - 2, 5), (False, 6, n - 1, 5), (False, 7, 1, 7), (False, 8, 1, 7), (False, 9, 1, 9), (False, 9, 1, 9)])
    assert jaccard_components(table(spark, ODD).limit(0)).count() == 0


def test_one_of_each_loses_no_unlike_text(spark):
    """Rows count by id and text: two texts of one id are two rows, equal rows one, null ids last."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(5, a, "s"), (5, b, "s"), (3, a, "t"), (7, c, "z"), (7, c, "a"), (None, c, "q"), (None, b + " tail", None), (9, None, "a"), (9, "", "a"), (9, " ", "a"),
            (None, "only here is this text of words", "k"), (None, "only here is this text of words", "j"), (8, a + " x", "u"), (8, "short", "u"), (11, "short", "u")]
    got = sorted(((r[0], r[1], r[3]) for r in rows_of(one_of_each(table(spark, docs)))), key=str)
    want = [(3, a, "t"), (5, b, "s"), (7, c, "a"), (9, None, "a"), (9, "", "a"), (9, " ", "a"), (None, "only here is this text of words", "j"), (8, "short", "u")]
    assert got == sorted(want, key=str) and one_of_each(table(spark, [])).count() == 0
    assert one_of_each(table(spark, docs)).columns == table(spark, docs).columns


def _brute(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed,num,den,width", [(1, 90, 100, 3), (2, 80, 100, 5)])
def test_join_equals_brute_force(spark, monkeypatch, seed, num, den, width):
    """Families of near copies, a passage that many share, and small limits, so that every path is used."""
    from sitegraph.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HOT", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    passage, rows = word(40), []
    bases = [word(int(n)) for n in rng.integers(5, 260, 12)]
    for k in range(320):
        w = list(bases[k % 12] if k % 3 else word(int(rng.integers(1, 120))))
        for _ in range(int(rng.integers(0, 5)) if k % 12 else int(rng.integers(0, 2))):
            w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 50)}"
        rows.append((k, " ".join(w + passage if k % 4 == 0 else w)))
    got = {r[0]: (r[1], r[2]) for r in rows_of(jaccard_components(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), width, num, den))}
    want = _brute(rows, width, num, den)
    assert got == want and len({c for _, c in want.values()}) < 300


# decontamination

def test_alignment_scores():
    x = np.arange(1, 11)
    assert align(x, np.concatenate([[99, 98], x, [97]])) == (20, 12)
    assert align(x, np.delete(x, 4))[0] == 9 * 2 - 1
    assert align(x, np.insert(x, 5, 77))[0] == 20 - 1
    y = x.copy()
    y[3] = 55
    assert align(x, y)[0] == 9 * 2 - 1
    assert align(x, np.array([50, 51])) == (0, 0)


def test_leaks(spark):
    rng = np.random.default_rng(3)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 900, n)]
    items = {k: word(int(rng.integers(15, 50))) for k in range(12)}
    rows, want = [(100, None), (101, ""), (None, " ".join(items[0])), (102, "short")], set()
    for k in range(60):
        w, item = word(int(rng.integers(0, 300))), items[k % 12]
        if k % 3:
            held = [x for j, x in enumerate(item) if k % 3 == 1 or j % 9] if k % 2 else item
            at = int(rng.integers(0, len(w) + 1))
            w = w[:at] + held + w[at:]
            want.add((k, k % 12))
        rows.append((k, (" ".join(w)).upper() if k % 5 == 0 else ", ".join(w)))
    rows += rows[:8]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id BIGINT, text STRING, item_id INT, words STRING")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(50, None), (51, ""), (52, "short")], "item_id BIGINT, text STRING")
    got = rows_of(leaks(docs, bench))
    assert {(r[0], r[1]) for r in got} == want | {(102, 52)} and len(got) == len(want) + 1
    assert all(0.5 <= r[3] <= 1 for r in got)
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0


def test_leaks_of_many_equal_edits(spark):
    """The copies make their own seeds the commonest of an item that also stands unedited."""
    item = [f"v{k}" for k in range(38)]
    copy = [x if k < 12 or k % 3 else "other" for k, x in enumerate(item)]
    docs = [(0, " ".join(item))] + [(k, f"doc {k} says " + " ".join(copy)) for k in range(1, 40)] + [(k, " ".join(copy)) for k in range(40, 80)]
    got = rows_of(leaks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"),
                        spark.createDataFrame([(7, " ".join(item))], "item_id BIGINT, text STRING")))
    assert sorted(r[0] for r in got) == list(range(80)) and {r[1] for r in got} == {7}
    assert {r[4] for r in got if r[0] in (1, 40)} == {41, 38}


def test_leaks_equal_brute_force_without_seeds(spark):
    """Every document against every item: copies changed at random, every fourth word, or with a word put in everywhere."""
    rng = np.random.default_rng(8)
    word = lambda n: list((60 * rng.random(n) ** 2).astype(int))
    items = {k: word(n) for k, n in enumerate([4, 5, 6, 7, 8, 10, 12, 15, 20, 30] * 3)}
    items[90] = list(range(200, 215))
    docs = {0: [x if k % 4 < 3 else 999 for k, x in enumerate(items[90])], 1: [y for x in items[90] for y in (x, 900 + x)][:-1], 2: []}
    for k in range(3, 90):
        copy = []
        for x in items[k % 30]:
            kind = rng.random() * 4
            copy += [x] if kind > 1.2 else [int(rng.integers(0, 60))] if kind > 0.7 else [x, int(rng.integers(0, 60))] if kind > 0.3 else []
        docs[k] = word(int(rng.integers(0, 40))) + copy + word(int(rng.integers(0, 40)))
    want = {(d, i): s for d, w in docs.items() for i, item in items.items()
            if (s := align(np.array(item), np.array(w, dtype=int))[0] / (2 * len(item))) >= 0.5}
    text = lambda rows: spark.createDataFrame([(k, " ".join(f"w{x}" for x in w)) for k, w in rows.items()], "id BIGINT, text STRING")
    got = {(r[0], r[1]): r[3] for r in rows_of(leaks(text(docs).withColumnRenamed("id", "doc_id"), text(items).withColumnRenamed("id", "item_id")))}
    assert got == pytest.approx(want) and {(0, 90), (1, 90)} <= set(want) and len(want) > 90


# licenses

def test_license_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    long = "some words of a text that says nothing about anything at all. " * 30
    files = [("a/LICENSE", mit), ("a/b/x", long + "\n" + apache), ("a/b/y", long), ("a/b/c/z", None), ("d/x", ""), (None, mit), ("a/b/y", long),
             ("e/f/COPYING", apache + "\n" + apache), ("e/f/g/h/deep", "plain"), ("e/top", long), ("near", "Released by the License of MIT people")]
    df = spark.createDataFrame([(p, t, "x", 1.0) for p, t in files], "path STRING, text STRING, license STRING, score DOUBLE")
    got = {r.path: (r.own, r.license, r.inherited_from) for r in scan_licenses(df).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "MIT", None), "a/b/x": ("Apache-2.0", "Apache-2.0", None), "a/b/y": (None, "MIT", "a"), "a/b/c/z": (None, "MIT", "a"),
        "d/x": (None, None, None), None: (None, None, None), "e/f/COPYING": ("Apache-2.0", "Apache-2.0", None),
        "e/f/g/h/deep": (None, "Apache-2.0", "e/f"), "e/top": (None, None, None), "near": (None, None, None)}
    assert scan_licenses(df).count() == len(files) and scan_licenses(df.limit(0)).count() == 0


def test_license_texts_headers_and_tags(spark):
    """Whole licence files, wrapped headers in comments, SPDX tags, and siblings that share most words."""
    mit = """MIT License\n\nCopyright (c) 2020 Someone\n
Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n
The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"""
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n"
    agpl = """# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as published by
# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os\n""" + "x = 1\n" * 300
    code = "value = compute(other)\n" * 50
    files = [("m/LICENSE", mit), ("m/src/a.c", code), ("g/COPYING", gpl), ("g/x/y/z.c", code), ("s/one.py", "# SPDX-License-Identifier: MIT\n" + code),
             ("s/two.py", "// SPDX-License-Identifier: LGPL-3.0\n" + code), ("a/app.py", agpl), ("l/x", "This work is licensed under the GNU Lesser General Public License, version 3."),
             ("c/by", "Licensed under CC BY 4.0."), ("c/nc", "Licensed under CC BY-NC 4.0."), ("c/sa", "Licensed under CC BY-SA 4.0."), ("n/none", code),
             ("t/tie", "ISC License\nMIT License"), ("v/long", code * 4000 + "Released under the MIT License.")]
    got = {r.path: (r.own, r.license, r.inherited_from) for r in scan_licenses(spark.createDataFrame(files, "path STRING, text STRING")).collect()}
    assert got == {
        "m/LICENSE": ("MIT", "MIT", None), "m/src/a.c": (None, "MIT", "m"), "g/COPYING": ("GPL-3.0", "GPL-3.0", None), "g/x/y/z.c": (None, "GPL-3.0", "g"),
        "s/one.py": ("MIT", "MIT", None), "s/two.py": ("LGPL-3.0", "LGPL-3.0", None), "a/app.py": ("AGPL-3.0", "AGPL-3.0", None), "l/x": ("LGPL-3.0", "LGPL-3.0", None),
        "c/by": ("CC-BY-4.0", "CC-BY-4.0", None), "c/nc": ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), "c/sa": ("CC-BY-SA-4.0", "CC-BY-SA-4.0", None),
        "n/none": (None, None, None), "t/tie": ("ISC", "ISC", None), "v/long": ("MIT", "MIT", None)}


# tool chat

SCHEMA = {"add": {"type": "object", "required": ["x"], "additionalProperties": False,
                  "properties": {"x": {"type": "integer", "minimum": 0}, "kind": {"enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "string"}}}}}


def test_schema_faults():
    assert faults({"x": 1, "l": ["q"]}, SCHEMA["add"]) == []
    assert faults({"x": -1, "kind": "c", "y": 1, "l": [1]}, SCHEMA["add"]) == [
        "$.y: unknown", "$.kind: not one of the choices", "$.l[0]: not string", "$.x: below 0"]
    assert faults({"x": True}, SCHEMA["add"]) == ["$.x: not integer"] and faults([], SCHEMA["add"]) == ["$: not object"]
    assert canonical({"b": [1, None], "a": "ü"}) == '{"a":"ü","b":[1,null]}'
    assert [parsed(t)[1] is None for t in ('{"a":1}', '{"a":1,"a":2}', "NaN", "{", None, "[" * 100_000)] == [True, False, False, False, False, False]


def test_link_tools(spark):
    from sitegraph.llm.toolchat import CALLS, RESULTS

    calls = [(1, 0, "a", "add", '{"x": 1}', []), (1, 1, "b", "add", '{"x": "q"}', ["a"]), (1, 2, "c", "add", "{", ["b", "a", "zz"]),
             (1, 3, "a", "add", '{"x": 9}', []), (1, 3, "a", "add", '{"x": 9}', []), (2, 0, "a", "sub", None, None), (2, 1, "p", "add", '{"x":1}', ["q"]),
             (2, 2, "q", "add", '{"x":1}', ["p"]), (None, 1, "n", "add", '{"x":1}', []), (3, None, None, "add", '{"x":1}', [])]
    results = [(1, 5, "a", "r1"), (1, 4, "a", "r0"), (1, 6, "b", None), (2, 9, "gone", "r"), (2, 3, "p", "r"), (None, 1, "n", "x")]
    got = rows_of(link_tools(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMA))
    assert len(got) == 13
    have = {(r[0], r[3], r[4], r[1], tuple(r[5])) for r in got}
    assert have == {
        (1, "a", "linked", 0, ()), (1, "b", "linked", 1, ("$.x: not integer",)), (1, "c", "open", 2, ("$: not JSON",)), (1, "a", "repeated", None, ()),
        (2, "a", "open", 0, ("$: no arguments",)), (2, "p", "circular", None, ()), (2, "q", "circular", None, ()), (None, "n", "open", None, ()),
        (3, None, "open", None, ()), (2, "gone", "orphan", None, ()), (None, "n", "orphan", None, ())}
    line = next(r[6] for r in got if r[:2] == (1, 0) and r[3] == "a")
    assert line == '{"call":{"after":[],"arguments":{"x":1},"level":0,"name":"add","turn":0},"conversation":1,"errors":[],"id":"a","result":{"content":"r0","turn":4},"state":"linked"}'
    empty = link_tools(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMA)
    assert empty.count() == 0


def test_levels_of_chains_and_joins(spark):
    from sitegraph.llm.toolchat import CALLS, order_calls

    rng, rows, want = np.random.default_rng(4), [], {}
    for conv, size, most in ((1, 70, 1), (2, 40, 3), (3, 25, 2)):
        for k in range(size):
            on = sorted({int(x) for x in rng.integers(max(0, k - 4), k, rng.integers(1, most + 1))}) if k and (most == 1 or k % 5) else []
            want[conv, f"c{k}"] = max((want[conv, f"c{j}"] + 1 for j in on), default=0)
            rows.append((conv, k, f"c{k}", "add", "{}", [f"c{j}" for j in on] + ["none"]))
    rows += [(4, k, f"c{k}", "add", "{}", [f"c{(k + 1) % 5}"]) for k in range(5)] + [(4, 9, "d", "add", "{}", ["c0", "e"]), (4, 9, "e", "add", "{}", [])]
    want |= {(4, f"c{k}"): None for k in range(5)} | {(4, "d"): None, (4, "e"): 0}
    got = {(r.conv_id, r.call_id): r.level for r in order_calls(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == want


# WARC

def test_derivatives(spark):
    http = "HTTP/1.1 404 Not Found\r\ncontent-type:  text/html\r\n\r\n"
    body = '<html><script>x<p>y</script><h1>A &amp; B</h1><!-- c --><p>one<br>two <a class="k" href="/l">three</a></p></html>'
    rows = [("<urn:r1>", "http://h/", "2020-01-01T00:00:00Z", http, body, 1), ("<urn:r1>", "http://h/", "2020-01-01T00:00:00Z", http, body, 1),
            (None, None, None, None, None, 2), ("<urn:r2>", "http://e/", "2020-01-01T00:00:00Z", http, "", 3)]
    df = spark.createDataFrame(rows, "record_id STRING, target_uri STRING, date STRING, http STRING, body STRING, kind INT")
    got = derive(df).collect()
    assert len(got) == 8
    conv = next(r for r in got if r.refers_to == "<urn:r1>" and r.kind == "conversion")
    head, block = conv.record.split("\r\n\r\n", 1)
    assert block == "A & B\none\ntwo three\r\n\r\n" and f"Content-Length: {conv.length}" in head and "WARC-Refers-To: <urn:r1>" in head
    meta = next(r for r in got if r.refers_to == "<urn:r1>" and r.kind == "metadata")
    assert "source-status: 404\r\nsource-content-type: text/html\r\n" in meta.record and "outlink: /l\r\n" in meta.record
    assert f"WARC-Concurrent-To: {conv.record_id}" in meta.record and meta.record_id != conv.record_id
    lost = [r for r in got if r.target_uri == ""]
    assert len(lost) == 2 and "WARC-Target-URI" not in lost[0].record and lost[0].refers_to.startswith("<urn:uuid:")
    assert derive(df.limit(0)).count() == 0


@pytest.mark.parametrize("anchor,links", [
    ('<a href="x?a=1&amp;b=2">', ["x?a=1&b=2"]),
    ("<a class=k href='x&#38;y \"z\"'>", ['x&y "z"']),
    ("<A HREF=/x/y?q=1&lang=en>t</A>", ["/x/y?q=1&lang=en"]),
    ("<a title='a > b href=no' data-href=no href = yes>", ["yes"]),
    ('<a id="k"href="x"><a name=top><a href="x&#13;&#10;WARC-Type: y">', ["x", "xWARC-Type: y"]),
])
def test_outlinks_of_every_attribute_form(spark, anchor, links):
    df = spark.createDataFrame([("<urn:r>", "u", "d", "h", f"<p>{anchor}</p>")], "record_id STRING, target_uri STRING, date STRING, http STRING, body STRING")
    meta = next(r for r in derive(df).collect() if r.kind == "metadata")
    assert re.findall("outlink: ([^\r]*)\r\n", meta.record) == links


@pytest.mark.parametrize("body,text,links", [
    ('<script>var a="<a href=x.html>";</script><!-- <a href="c.html"> --><a href="y.html">y</a>', "y", ["y.html"]),
    ('<p>head<img alt="a > b" src="x">tail</p>', "headtail", []),
    ('<p title="open>text</p>more', "text\nmore", []),
    ("<p>seen</p><script>var x = 1; <a href=no.html>", "seen", []),
    ("<p>seen</p><!-- <a href=no.html> never closed", "seen", []),
    ("<style media='>'>p {}</style><!-- > <script> --><a href=z>z</a>", "z", ["z"]),
    ("<p>" + "word " * 200000 + "<br>end", "word " * 199999 + "word\nend", []),
])
def test_hidden_parts_and_broken_markup(spark, body, text, links):
    df = spark.createDataFrame([("<urn:r>", "u", "d", "h", body)], "record_id STRING, target_uri STRING, date STRING, http STRING, body STRING")
    got = {r.kind: r.record.split("\r\n\r\n", 1)[1].removesuffix("\r\n\r\n") for r in derive(df).collect()}
    assert got["conversion"] == text and re.findall("outlink: ([^\r]*)\r\n", got["metadata"]) == links


# nearest neighbours

def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    vec = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    odd = [(300, None), (301, [0.0] * 8), (302, [1.0] * 7), (303, [float("nan")] * 8), (304, [float("inf")] + [1.0] * 7), (None, [1.0] * 8),
           (305, [None] + [1.0] * 7), vec[40], (400, [9.0 * x for x in vec[20][1]])]
    df = spark.createDataFrame([(i, v, 3) for i, v in vec + odd], "vec_id BIGINT, embedding ARRAY<DOUBLE>, bucket INT")
    got = {}
    for q, rank, v, score in rows_of(nearest(df, k=5, how=Hashing(probes=200))):
        got.setdefault(q, []).append((rank, v, score))
    ids = np.array([i for i, _ in vec] + [400])
    x = np.array([v for _, v in vec] + [[9.0 * y for y in vec[20][1]]])
    assert set(got) == {q for q in ids if q % 20 == 0}
    for q, rows in got.items():
        s = x @ x[list(ids).index(q)]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        rows.sort()
        assert [(r, v) for r, v, _ in rows] == [(n + 1, ids[k]) for n, k in enumerate(order)]
        assert np.allclose([s_ for _, _, s_ in rows], s[order], rtol=0, atol=1e-12)
    assert nearest(df.limit(0)).count() == 0
    few = nearest(df.filter("vec_id < 3"), k=20)
    assert sorted((r[0], r[1]) for r in rows_of(few)) == [(0, 1), (0, 2)]


def test_neighbours_of_tiny_vectors(spark):
    """Scores far below 1e-9, and more near ties than are asked for."""
    rng = np.random.default_rng(6)
    for x in (rng.normal(size=(300, 8)) * 1e-6, np.c_[np.ones(300), 1e-12 * rng.permutation(300)]):
        df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
        got = {(q, r): v for q, r, v, _ in rows_of(nearest(df, "vec_id IN (299, 100)", k=5, how=Hashing(probes=200)))}
        for q in (299, 100):
            s = np.einsum("nd,nd->n", x[[q] * 300], x)
            best = [k for k in np.lexsort((np.arange(300), -s)) if k != q][:5]
            assert [got[q, r + 1] for r in range(5)] == best


def test_hot_cell_is_dealt_in_blocks(spark, monkeypatch):
    from sitegraph.llm import ann

    monkeypatch.setattr(ann, "BLOCK", 7)
    df = spark.createDataFrame([(k, [1.0, 1.0 + k % 3 / 100]) for k in range(100)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = sorted(rows_of(ann.nearest(df, k=4)))
    want = [(q, r + 1, v) for q in range(0, 100, 20) for r, v in enumerate([v for v in range(2, 100, 3) if v != q][:4])]
    assert [r[:3] for r in got] == want


def test_blocks_change_no_neighbour(spark, monkeypatch):
    """Candidates are those of the cells, however vectors are laid out; repeated rows are dealt apart."""
    from sitegraph.llm import ann

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(200, 8)), np.tile(rng.normal(size=8), (150, 1))])
    rows = [(k, [float(y) for y in v]) for k, v in enumerate(x)] + [(20, [float(y) for y in x[20]])] * 100
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    how = Hashing(probes=60)
    whole = sorted(rows_of(nearest(df, k=3, how=how)))
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "ASKED", 4)
    assert sorted(rows_of(nearest(df, k=3, how=how))) == whole
    # against the cells themselves
    ball = [ann.unit_ball(x, np.sqrt((x * x).sum(1).max()), query) for query in (False, True)]
    home, visits = how.home(ball[0]), how.visits(ball[1])
    for q in range(0, 350, 20):
        near = np.array([k for k in range(350) if k != q and any(home[t, k] in visits[t, q] for t in range(how.tables))])
        if len(near) >= 3:
            s = np.einsum("nd,nd->n", x[near], x[[q] * len(near)])
            assert [r[2] for r in whole if r[0] == q] == [near[k] for k in np.lexsort((near, -s))[:3]]


def _jobs_of(spark, group, work):
    """How many jobs Spark ran for ``work()``."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_figures_of_saved_tables_take_no_job(spark):
    figures = {"rows": F.count(F.lit(1)), "large": F.count_if(F.col("v") > 2), "top": F.max("v")}
    for n, want in ((5, {"rows": 5, "large": 2, "top": 4}), (0, {"rows": 0, "large": 0, "top": None})):
        rows = spark.range(9).filter(f"id < {n}").withColumnRenamed("id", "v")
        plain = _jobs_of(spark, f"plain-{n}", lambda rows=rows: saved(rows, "plain"))
        got = []
        assert _jobs_of(spark, f"with-{n}", lambda rows=rows, got=got: got.append(saved_with(rows, "figures", **figures))) == plain
        out, seen = got[0]
        assert seen == want and out.count() == n and out.columns == ["v"]
        # a side that was counted as it was written is not counted again
        assert _jobs_of(spark, f"side-{n}", lambda rows=rows: saved_side(rows, "side")) == plain
    for empty in (rows.join(spark.range(3).withColumnRenamed("id", "v"), "v"), rows.groupBy("v").agg(F.max("v").alias("w")), rows.limit(0)):
        assert saved_with(empty, "empty", rows=F.count(F.lit(1)))[1] == {"rows": 0}


def test_few_jobs_find_near_duplicates(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "x y z"), (None, "x y z"), (4, None)]
    docs = saved(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), "docs")
    got = []
    few = _jobs_of(spark, "near", lambda: got.extend(rows_of(one_of_each(docs).select("doc_id"))))
    assert sorted(r[0] for r in got) == [1, 3, 4]
    # 47 when tables were counted, and families written again, by jobs of their own
    assert few <= 43
