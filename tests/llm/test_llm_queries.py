"""The registered queries on given tables: against their SQL, or brute force, or held-out labels."""

import glob
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sitegraph.llm.decontaminate import LEAK, MATCH, align
from sitegraph.llm.queries import ORACLES, QUERIES
from sitegraph.llm.toolchat import canonical

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents ORDER BY 1").fetchall()


def texts(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(int(r[i]) if isinstance(r[i], float) and r[i] == int(r[i]) else r[i]) for i in order) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    assert texts(df.collect(), df.columns) == texts(cursor.fetchall(), [c[0] for c in cursor.description])


def shingle_sets(documents, width):
    out = {}
    for i, t, *_ in documents:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def grouped(sets, num, den):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1:]:
            x, y = sets[i], sets[j]
            if x and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_ngram_join(spark, documents):
    sets = shingle_sets(documents, 3)
    root = grouped(sets, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_ngram_jaccard_join"](spark, SF).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_decontamination(spark, documents, duck):
    names = {}
    number = lambda t: np.array([names.setdefault(w, len(names)) for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate(LOWER))])
    items = {i: number(t) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()}
    want = {}
    for d, t, _ in documents:
        w = number(t)
        for i, item in items.items():
            if np.isin(item, w).sum() >= LEAK * len(item) and (s := align(item, w)[0] / (MATCH * len(item))) >= LEAK:
                want[d, i] = s
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op1_decontamination"](spark, SF).collect()}
    assert got == pytest.approx(want) and want


def test_toxicity_on_held_out_labels(spark):
    """Trained on some hundred labels; the full tables give more."""
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{MORE}/labels.parquet'").fetchall())
    rows = QUERIES["op3_toxicity"](spark, MORE).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    hit = [toxic[r.doc_id] for r in held if r.predicted]
    assert np.mean(hit) >= 0.9 and sum(hit) >= 0.6 * sum(toxic[r.doc_id] for r in held)


def test_sharding(spark, documents):
    rows = QUERIES["op4_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == [(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t, _ in documents]
    slots = [sorted(r.slot for r in rows if r.shard == s) for s in range(24)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def token_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    kept = token_ids.__dict__.setdefault("t", None) or Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    token_ids.t = kept
    return kept.encode(text or "", add_special_tokens=False).ids + [2]


def test_token_ids(spark, documents):
    got, start = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_ids"](spark, SF).collect()}, 0
    for i, t, _ in documents:
        ids = token_ids(t)
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(documents)


def test_neighbours_recall(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["op8_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    found = []
    for q, named in got.items():
        s = x @ x[list(ids).index(q)]
        best = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert sorted(named) == list(range(1, 21))
        assert np.allclose([named[k][1] for k in sorted(named)], [s[list(ids).index(named[k][0])] for k in sorted(named)], rtol=0, atol=1e-12)
        assert [named[k] for k in sorted(named)] == sorted(named.values(), key=lambda v: (-v[1], v[0]))
        found.append(len({v for v, _ in named.values()} & set(best)) / 20)
    assert np.mean(found) >= 0.9


def test_tool_chat(spark, duck):
    turns = duck.execute("SELECT count(*) FILTER (role = 'user') FROM conversations").fetchone()[0]
    rows = QUERIES["op9_tool_chat"](spark, SF).collect()
    others = duck.execute("SELECT conv_id, turn, role, text FROM conversations WHERE role NOT IN ('user', 'assistant')").fetchall()
    said = [r for r in rows if r.state == "message"]
    assert sorted((r.conv_id, r.turn) for r in said) == sorted((c, t) for c, t, _, _ in others) and others
    assert sorted(r.json for r in said) == sorted(canonical({"conversation": c, "message": {"role": r, "text": x, "turn": t}, "state": "message"}) for c, t, r, x in others)
    # every turn is in a line: as a call, a result or a message
    assert sum((r.state != "orphan") + ('"result"' in r.json) for r in rows) == duck.execute("SELECT count(*) FROM conversations").fetchone()[0]
    rows = [r for r in rows if r.state != "message"]
    assert sum(r.state != "orphan" for r in rows) == turns and {r.state for r in rows} <= {"linked", "open", "orphan"}
    pairs = set(duck.execute("SELECT conv_id, turn FROM conversations WHERE role = 'user' INTERSECT SELECT conv_id, turn - 1 FROM conversations WHERE role = 'assistant'").fetchall())
    assert {(r.conv_id, r.turn) for r in rows if r.state == "linked"} == pairs
    chain = set(duck.execute("SELECT conv_id, turn FROM conversations WHERE role = 'user'").fetchall())

    def level(c, t):
        return 1 + level(c, t - 2) if (c, t - 2) in chain else 0

    assert all(r.level == level(r.conv_id, r.turn) for r in rows if r.state != "orphan")


def test_pipeline(spark, documents, duck, tmp_path):
    """Every stage on what the one before kept."""
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        df = stage(spark, docs, SF)
        assert df.columns == columns
        df.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append([(r.doc_id, r.text, r.source) for r in docs.collect()])
    clean, apart, free, mix = kept
    whole = {i: t for i, t, _ in documents}
    assert 0.8 * len(documents) < len(clean) <= len(documents) and all(whole[i] == t for i, t, _ in clean + mix)
    root = grouped(shingle_sets(clean, 5), 80, 100)
    assert sorted(i for i, *_ in apart) == sorted(set(root.values()))
    leaked = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.translate(LOWER)) for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    leaked = [" ".join(w) for w in leaked]
    plain = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.translate(LOWER)))
    assert not [i for i, t, _ in free if any(f" {p} " in f" {plain(t)} " for p in leaked)]
    assert {i for i, *_ in free} <= {i for i, *_ in apart} and len(free) > 0.8 * len(apart)
    words = lambda rows: sum(len(WORD.findall(t)) for _, t, _ in rows)
    assert words(mix) == pytest.approx(1.5 * words(free), rel=0.1)
    assert max(np.unique([i for i, *_ in mix], return_counts=True)[1]) <= 2
    out = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id, r.n_tokens) for r in out) == sorted((i, len(token_ids(t))) for i, t, _ in mix)
    assert [r.start for r in out] == list(np.cumsum([0] + [r.n_tokens for r in out[:-1]]))
