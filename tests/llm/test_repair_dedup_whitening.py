"""Conversation repair, line deduplication and whitening against plain versions, and their odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from functools import cache

import duckdb
import numpy as np
import pytest

from sitegraph.llm.chatrepair import Search, damaged, digests, plain, repair
from sitegraph.llm.linededup import Filters, twice_seen, without_repeated_lines
from sitegraph.llm.queries import QUERIES
from sitegraph.llm.whitening import count_above, exact_sums, leading, whiten

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CHAT = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


# --- conversations


def best_edits(rows):
    """(cost, audit) by a search from the last row back, whole strings compared."""
    @cache
    def rest(i, state, inserts):
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, ""))
        lead = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
        to = {"s": 1, "u": 2, "a": 3}
        if inserts < 3:
            cost, audit = rest(i, to[lead], inserts + 1)
            found.append((cost + 2, "I" + audit))
        if i < len(rows):
            initial, gone, cut = rows[i]
            cost, audit = rest(i + 1, state, 0)
            found.append((cost + 3, "D" + audit))
            if not gone:
                if initial == lead or (state == 0 and initial == "s"):
                    cost, audit = rest(i + 1, to[initial], 0)
                    found.append((cost + cut, "K" + audit))
                cost, audit = rest(i + 1, to[lead], 0)
                found.append((cost + 2 + cut, "R" + audit))
        return min(found, default=(10 ** 9, ""))

    return rest(0, 0, 0)


def plainly(rows):
    """One conversation's answer from its rows after damage, in order."""
    seen, faults, light = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        wrong = "blank" if not said else "duplicate" if (role, text) in seen else None if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if wrong:
            faults[wrong] += 1
        light.append((role[:1], wrong in ("blank", "duplicate"), wrong == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(light, light[1:], strict=False))
    cost, audit = best_edits(tuple(light))
    out, k, last = [], 0, ""
    for edit in audit:
        made = "assistant" if last == "u" else "user"
        role, text = (made, "") if edit == "I" else rows[k][1:]
        k += edit != "I"
        if edit != "D":
            role = made if edit == "R" else role
            out.append(f"{role}:{text}")
            last = role[:1]
    return gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine.extend([(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3)))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


@pytest.mark.parametrize("folder", [SF, MORE])
def test_repair_of_all_conversations(spark, folder):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()
    want = {c: plainly(r) for c, r in after_damage(rows).items()}
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert got == want and {c for c, *_ in rows} == set(got)


def test_repair_of_odd_rows(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    said = ["Yes.", "no", "", None, "Why?\n", " \t", "é!", "long " * 20000 + "end."]
    rows = [(c if c < 60 else None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(said)) for c in range(61) for _ in range(rng.randint(1, 12))]
    rows += [(100, t, "user", "Hi.") for t in range(120)] + [(101, t, "user", f"Hi {t}.") for t in range(120)] + [(102, 0, "user", "A."), (102, 0, "user", "A.")]
    want = {c: plainly(r) for c, r in after_damage(rows).items()}
    got = {r.conv_id: tuple(r)[1:] for r in digests(repair(damaged(spark.createDataFrame(rows, CHAT).repartition(5)))).collect()}
    assert got == want


def test_repair_gives_rows_and_reads_nothing_else(spark):
    rows = spark.createDataFrame([(1, 5, "assistant", None, 9, "x"), (1, 9, "user", "Full.", 9, "y")], CHAT + ", copy INT, dropped STRING")
    got = [tuple(r)[1:] for r in repair(plain(rows)).orderBy("step").collect()]
    assert got == [(1, "D", 5, "blank", "assistant", None, None), (2, "K", 9, None, "user", "user", "Full."), (3, "I", None, None, None, "assistant", "")]
    none = spark.createDataFrame([], CHAT)
    assert digests(repair(damaged(none))).collect() == [] and digests(repair(plain(none))).columns[0] == "conv_id"


def test_settled_edits_leave():
    """Memory holds unresolved turns only; survivors that never meet stay whole and come out right."""
    search, left, most = Search(), 0, 0
    for k in range(4000):
        search.feed((k, "user", "", None), "ua"[k % 2], k % 7 == 3, False)
        left += len(list(search.settled()))
        node, depth = max((s[2] for s in search.survivors.values()), key=lambda n: n is not search.root), 0
        while node is not None and node is not search.root:
            node, depth = node.parent, depth + 1
        most = max(most, depth)
    search.end()
    assert left + len(list(search.settled())) >= 4000 and most < 50
    search = Search()
    for k in range(3001):
        search.feed((k, "tool", "", None), "t", False, False)
    search.end()
    assert "".join(e.name for e in search.settled()) == "D" + "R" * 3000


# --- lines


def deduplicated(rows, copies=5):
    """(doc_id, n_lines, n_dropped, kept) of every row."""
    def key(line):
        k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line)
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
        return k if len(k) >= 40 else None

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    last = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in holders.items() if k is not None and len(v) >= copies}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_of_all_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = sorted((tuple(r) for r in QUERIES["op12_line_dedup"](spark, SF).collect()), key=str)
    assert got == sorted(((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in deduplicated(rows)), key=str)


@pytest.mark.parametrize("bits", [6, 12, 20])
def test_lines_of_odd_rows(spark, bits):
    """Also with filters so small that every line is a suspect."""
    a, b, short = "This line stands in many documents, word for word", "é" * 40, "é" * 39
    rows = [(i, f"own line {i} that is long enough to count as one\n  {a.upper() if i % 2 else a}\t\n{b}\n{short}") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, f"{a}\n{a}"), (23, f"{a}\n{a}"), (23, f"x\n{b}\r"), (None, a), (None, f"{a}\nz"), (24, short), (25, ("q" * 50 + "\n") * 5000)]
    rows += [(30 + i, "y" * 60) for i in range(4)] + [(30, "y" * 60 + "\n" + "y" * 60)] + [(50 + i, " ".join(str(i * k) for k in range(30))) for i in range(300)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id BIGINT, text STRING, lines INT, mark STRING").repartition(7)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "text")) for r in without_repeated_lines(docs, bits=bits).collect()), key=str)
    assert got == deduplicated(rows)
    none = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert without_repeated_lines(none).collect() == []


def test_filters_lose_nothing(spark):
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 1 << 63, 4000).astype(np.uint64) for _ in range(4)]
    again = np.concatenate([parts[0][:50], parts[1][:50]])
    parts[3] = np.concatenate([parts[3], again])
    whole = Filters(20)
    for part in parts:
        own = Filters(20)
        own.add(part)
        at = np.flatnonzero(own.once)
        whole.merge(at, own.once[at], own.twice[at])
    alone = Filters(20)
    alone.add(again)
    assert (whole.twice & alone.once == alone.once).all()
    text = "a line that is long enough to be looked at, number %d"
    docs = spark.createDataFrame([(bytearray("\n".join(text % k for k in range(i, 100 + i)).encode()),) for i in (0, 99)], "text BINARY")
    bits = np.unpackbits(twice_seen(docs, 27).view(np.uint8)).sum()
    assert 0 < bits <= 3


# --- embeddings


def whole_numbers(rows):
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    return good, np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for _, v in good], dtype=object)


@pytest.mark.parametrize("folder", [SF, MORE])
def test_whitening_of_all_embeddings(spark, folder):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet' ORDER BY 1").fetchall()
    good, x = whole_numbers(rows)
    n, sums = len(x), x.sum(axis=0)
    z = (n * x - sums).astype(np.float64) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = z @ vectors / np.sqrt(values)
    got = QUERIES["op13_embedding_whitening"](spark, folder).toPandas().sort_values(["vec_id", "component"])
    assert got.vec_id.tolist() == [i for i, _ in good for _ in range(32)] and got.component.tolist() == list(range(1, 33)) * n
    assert (got.n == n).all() and got.deviation.tolist() == [int(s) for s in ((n * x - sums) ** 2).sum(axis=1) for _ in range(32)]
    w = got.whitened.to_numpy().reshape(n, 32)
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, rtol=0, atol=1e-9)
    assert np.allclose(got.explained[:32], values / np.trace(z.T @ z / n), rtol=1e-10)
    error = np.abs((w - w.mean(axis=0)).T @ (w - w.mean(axis=0)) / n - np.eye(32)).max()
    assert got.identity_error.nunique() == 1 and abs(got.identity_error.iloc[0] - error) < 1e-10 < 1e-4


def test_whitening_of_odd_rows(spark):
    kind = "vec_id BIGINT, embedding ARRAY<DOUBLE>, component INT, v STRING, n INT"
    frame = lambda rows: spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows], kind)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (0, rows[0][1]), (None, rows[1][1])]
    got = whiten(frame(rows + odd)).toPandas()
    assert len(got) == 42 * 5 and set(got.vec_id.dropna()) == set(range(40)) and got.identity_error.max() < 1e-12
    assert whiten(frame([])).collect() == [] and whiten(frame(odd[:2])).collect() == []
    one = whiten(frame([(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    flat = whiten(frame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0])])).collect()
    assert [(r.vec_id, r.component, None if r.whitened is None else round(abs(r.whitened), 12)) for r in flat if r.vec_id == 1] == [(1, 1, 1.0), (1, 2, None), (1, 3, None)]
    huge = whiten(frame([(1, [1e15, 1.0]), (2, [-1e15, 3.0]), (3, [2.5, 2.0])])).toPandas()
    assert huge.identity_error.max() < 1e-4 and huge.deviation.isna().sum() == 4


def test_sums_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(3) * 10.0 ** int(rng.integers(0, 12))).tolist()) for i in range(60)]
    y = np.array([[int(np.floor(64 * c)) for c in v] for _, v in rows], dtype=object)
    df = spark.createDataFrame(rows, "vec_id BIGINT, v ARRAY<DOUBLE>").repartition(5)
    n, sums = exact_sums(df, None)
    centre = [int(Fraction(s, n).__floor__()) for s in sums]
    d = y - np.array(centre, dtype=object)
    assert (n, sums) == (60, list(y.sum(axis=0))) and exact_sums(df, centre)[1] == list((d.T @ d).ravel())


@pytest.mark.parametrize("kind", ["random", "equal", "near", "rank", "identity", "zero"])
def test_spectrum_slicing(kind):
    rng = np.random.default_rng(11)
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    values = {"random": rng.random(48) * 9, "equal": np.repeat(np.arange(12.0), 4), "near": 1 + 1e-10 * np.arange(48), "rank": np.r_[np.zeros(41), np.arange(1.0, 8)], "identity": np.ones(48), "zero": np.zeros(48)}[kind]
    m = q @ np.diag(values) @ q.T
    m = (m + m.T) / 2
    got, vectors = leading(m, 32)
    assert np.allclose(got, np.sort(values)[::-1][:32], rtol=0, atol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-13 and np.abs(m @ vectors - vectors * got).max() < 1e-12
    true = np.linalg.eigvalsh(m)
    for at in rng.random(40) * 10:
        assert count_above(m, at) == (true > at).sum() or np.abs(true - at).min() < 1e-9
