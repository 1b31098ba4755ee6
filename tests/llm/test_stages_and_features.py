"""Plain versions of toxicity features and of the ring; odd rows through every stage of the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_small_cases import LONG, ODD, rows_of, table

import corpus_pipeline
from sitegraph.llm import licenses, toxicity
from sitegraph.llm.sharding import shard_rows
from sitegraph.llm.toxicity import FEATURES, NEAR, SECOND_PERSON, STEMS, dense_features, score_documents, without_toxic
from sitegraph.llm.words import NOT_ALNUM, slices

MARKS = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".encode())
STEM = STEMS[0]
HEAVY = {"awful": 2.0, "nasty": 1.25, "wicked": 0.5}
BEGINS = {"horriblest"[:STEM]: 0.75, "wickedness"[:STEM]: 1.5}


def letter(b):
    return 65 <= b <= 90 or 97 <= b <= 122 or b >= 128


def plain_features(text):
    raw = text.encode()
    words, word, at = [], b"", None
    for k, b in enumerate(raw + b" "):
        if chr(b).isalnum() and b < 128 or b >= 128:
            word += bytes([b])
        elif word:
            words.append(word)
            word = b""
    low = [w.lower() for w in words]
    whole = [HEAVY.get(w.decode("utf-8", "replace"), 0.0) for w in low]
    stem = [BEGINS.get(w[:STEM].decode("utf-8", "replace"), 0.0) if len(w) > STEM else 0.0 for w in low]
    weight = [max(a, b) for a, b in zip(whole, stem)]
    hits = [k for k, x in enumerate(weight) if x > 0]
    you = [k for k, w in enumerate(low) if w.decode("utf-8", "replace") in SECOND_PERSON]
    n, chars = max(1, len(words)), max(1, len(raw))
    return {
        "hits": len(hits), "hit_rate": sum(weight) / n, "hit_kinds": len({low[k] if whole[k] else low[k][:STEM] + b"*" for k in hits}),
        "stem_rate": sum(x > 0 for x in stem) / n, "heaviest": max(weight, default=0),
        "near_you": sum(any(abs(k - y) <= NEAR for y in you) for k in hits), "you_rate": len(you) / n,
        "capital_rate": sum(65 <= b <= 90 for b in raw) / chars,
        "shout_rate": sum(len(w) > 2 and all(65 <= b <= 90 for b in w) for w in words) / n,
        "punctuation_rate": sum(b in MARKS for b in raw) / chars, "bang_rate": sum(b in b"!?" for b in raw) / chars,
        "disguise_rate": sum(letter(raw[k - 1]) and letter(raw[k + 1]) and (raw[k] in MARKS or 48 <= raw[k] <= 57) for k in range(1, len(raw) - 1)) / n,
        "repeat_rate": sum(letter(raw[k]) and raw[k] == raw[k - 1] == raw[k - 2] for k in range(2, len(raw))) / n,
        "log_words": math.log1p(len(words)),
    }


def test_features_equal_plain_ones():
    rng = np.random.default_rng(3)
    pool = [*HEAVY, "horriblest", "horribles", "wickedness", "wickeder", "you", "YOUR", "Tu", "plain", "SHOUT", "id1ot", "st*pid", "soooo", "é", "ünï", "!", "??", "", " "]
    texts = ["", " \t\n", "you", "awful", "AWFUL you", "x" * 5000 + " awful", *(
        " ".join(rng.choice(pool, size=int(rng.integers(1, 60)))) for _ in range(200))]
    known = {int(toxicity._word_hash([w])[0]): x for w, x in HEAVY.items()}
    for begin, x in BEGINS.items():
        w = next(iter(slices(pa.array([begin + "x"]), NOT_ALNUM)))
        known[int(toxicity._stems(w, STEM)[1][0])] = x
    entries = np.array(sorted(known), dtype=np.uint64)
    weights = np.array([known[int(e)] for e in entries])
    second = np.sort(toxicity._word_hash(list(SECOND_PERSON)))
    got = np.concatenate([dense_features(w, entries, weights, second) for w in slices(pa.array(texts), NOT_ALNUM)])
    for text, row in zip(texts, got):
        assert dict(zip(FEATURES, row)) == pytest.approx(plain_features(text)), text


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, toxic INT, text STRING, score STRING")


def test_scores_of_odd_rows(spark):
    docs = table(spark, ODD)
    for labels in ([], [(1, 1, "x", "y"), (7, 1, "x", "y")], [(1, 1, "x", "y"), (3, None, "x", "y"), (None, 0, "x", "y"), (6, 0, "x", "y"), (6, 0, "x", "y")]):
        got = rows_of(score_documents(docs, labelled(spark, labels)))
        assert Counter(i for i, *_ in got) == Counter(i for i, *_ in ODD)
        assert all(0 <= s <= 1 and p == (s >= 0.7) and h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, h, s, p in got)
        # equal texts score alike: repeated rows, and null, empty and blank ones
        assert len({s for i, _, s, _ in got if i in (2, 3)}) == 1 and len({s for i, _, s, _ in got if i in (7, 8)}) == 1
    assert score_documents(docs.limit(0), labelled(spark, [])).count() == 0
    assert without_toxic(docs.limit(0), labelled(spark, [])).columns == docs.columns


def plain_shards(ids, n_shards, virtual):
    """Who owns each row: row by row along the ring, own shards first, then what is left over goes on."""
    place = lambda key: int(hashlib.md5(key.encode()).hexdigest()[:13], 16)
    nodes = sorted((place(f"shard-{s}-{v}"), s) for s in range(n_shards) for v in range(virtual))
    rows = sorted((place("null" if i is None else str(i)), i) for i in ids)
    room = [len(ids) // n_shards + (s < len(ids) % n_shards) for s in range(n_shards)]
    owner, arc = {}, {i: next((k for k, (x, _) in enumerate(nodes) if x >= p), 0) for p, i in rows}
    at = dict(arc)
    waiting = [i for _, i in rows]
    while waiting:
        left = []
        for i in sorted(waiting, key=lambda i: (arc[i], [r[1] for r in rows].index(i))):
            shard = nodes[at[i]][1]
            if room[shard]:
                room[shard] -= 1
                owner[i] = shard
            else:
                at[i] = (at[i] + 1) % len(nodes)
                left.append(i)
        waiting = left
    return owner


@pytest.mark.parametrize("n_shards,virtual", [(24, 64), (5, 2), (3, 1)])
def test_shards_equal_a_plain_ring(spark, n_shards, virtual):
    ids = [*range(400, 700), None]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id BIGINT, text STRING")
    assert {r.doc_id: r.shard for r in shard_rows(docs, n_shards, virtual).collect()} == plain_shards(ids, n_shards, virtual)


def test_a_new_shard_moves_a_tenth_at_most(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "string(id) AS text")
    a, b = ({r.doc_id: r.shard for r in shard_rows(docs, n).collect()} for n in (24, 25))
    assert 0.04 * len(a) <= sum(a[k] != b[k] for k in a) < 0.1 * len(a)


def test_many_directories_are_joined_in_parts(spark, monkeypatch):
    mit = "Released under the MIT License."
    rows = [("a/LICENSE", mit), *((f"a/b/{k}", "plain") for k in range(50)), ("a/b/7", "plain"), ("c/x", None), (None, mit)]
    df = spark.createDataFrame(rows, "path STRING, text STRING")
    few = sorted(map(str, rows_of(licenses.scan_licenses(df))))
    monkeypatch.setattr(licenses, "sized", lambda side: side)
    assert sorted(map(str, rows_of(licenses.scan_licenses(df)))) == few and len(few) == len(rows)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with the tables that stages read: odd labels, and benchmark items that are null, empty and long."""
    folder = str(tmp_path_factory.mktemp("odd"))
    labelled(spark, [(1, 0, "x", "y"), (None, 1, "x", "y"), (4, None, "x", "y")]).write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([(0, "quite another passage of a test"), (1, None), (2, ""), (None, "null id"), (3, "other text")],
                          "item_id BIGINT, text STRING").write.parquet(folder + "/benchmark.parquet")
    return folder


def bare(rows):
    return Counter((r.doc_id, r.text, r.source) for r in rows)


def test_stages_on_odd_rows(spark, tables):
    docs = table(spark, ODD)
    stages = dict(corpus_pipeline.STAGES)
    every = bare(docs.collect())
    assert bare(stages["toxicity"](spark, docs, tables).collect()) == every
    apart = stages["near_duplicates"](spark, docs, tables)
    assert apart.columns == docs.columns
    # 1 three times (one of them without id), 5 and 6, 7 and 8; null, empty and blank texts stay
    assert sorted(str(r.doc_id) for r in apart.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 9, 9]))
    free = bare(stages["decontamination"](spark, docs, tables).collect())
    # a document goes by its id: both texts of 9, of which one is an item
    assert free == Counter({k: n for k, n in every.items() if k[0] != 9})
    mix = stages["mixing"](spark, docs, tables)
    assert mix.columns == docs.columns and set(bare(mix.collect())) <= set(every)
    assert all(n <= 2 * every[k] for k, n in bare(mix.collect()).items())
    ids = rows_of(stages["token_ids"](spark, docs, tables).select("doc_id", "n_tokens"))
    assert Counter(i for i, _ in ids) == Counter(i for i, *_ in ODD) and all(n >= 1 for _, n in ids)
    assert [n for i, n in ids if i == 5][0] > len(LONG.split())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, tables, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, table(spark, ODD).limit(0), tables).count() == 0
