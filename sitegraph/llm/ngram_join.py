"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets of Jaccard similarity s share a token among the first
``n - ceil(s n) + 1`` of each, whatever global order sorts the tokens; so a pair
must do so under every order. Here tokens are 64-bit hashes of shingles, and an
order is the order of a hash of them. The first order finds candidates, all
three filter them, and only then are whole sets compared.

Large groups. Equal sets are one node. A token that many sets have among their
first ("hot", ``HOT`` sets or more) comes last in the first order, so the common
passage of unlike documents links nothing. Sets whose first tokens are mostly hot
are near copies of each other: they meet, like all candidates, in families,
which are compared block against block, by matrix products, one task per pair
of blocks; pairs do not become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import bitmap, components, has_bit, saved, saved_with, sized, table
from sitegraph.llm.words import bounds, distinct, mix, shingles, slices

#: a token among the first of so many sets is hot
HOT = 64
#: sets per side of a block comparison
BLOCK = 512
#: size of the fixed bitmap that picks the documents of families
BITS = 24
#: size of the fixed bitmap that keeps tokens of one set alone out of the shuffle
TOKEN_BITS = 26
#: what makes the second and third order from a token
_ORDERS = (np.uint64(0), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))
_EDGE = np.uint64(0xA0761D6478BD642F)


class Limits:
    """Integer bounds for similarity ``num / den``; every one holds for any pair that links."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.loss = 1 - num / den
        # a set with ``prefix`` tokens in its head that are not hot is found by those alone
        self.head_rate = self.loss + 0.05
        # where a partner's head tokens are at the latest: a token of rank r in x has at most
        # r + |y - x| tokens of y before it, |y - x| <= loss * |y| and |x| <= |y| / (1 - loss)
        self.kept_rate = self.head_rate / (1 - self.loss) + self.loss

    def prefix(self, n):
        """Tokens that a partner must share one of."""
        return n - -(-(n * self.num) // self.den) + 1

    def kept(self, n):
        """Tokens kept of a set."""
        return np.minimum(n, (n * self.kept_rate).astype(np.int64) + 8)

    # the same as SQL
    def prefix_sql(self, n: str) -> str:
        return f"({n} - (({n} * {self.num} + {self.den - 1}) div {self.den}) + 1)"

    def head_sql(self, n: str) -> str:
        return f"least({n}, cast(floor({n} * {self.head_rate!r}D) as bigint) + 5)"

    def kept_sql(self, n: str) -> str:
        return f"least({n}, cast(floor({n} * {self.kept_rate!r}D) as bigint) + 8)"

    def overlap_sql(self, a: str, b: str) -> str:
        return f"((({a} + {b}) * {self.num} + {self.num + self.den - 1}) div {self.num + self.den})"


def _set_rows(texts: pa.Array, width: int):
    """Per slice: first document, sizes, nodes, tokens and where each document's begin."""
    for words in slices(texts):
        h, doc = distinct(*shingles(words, width))
        at = bounds(doc, words.n_docs)
        n = np.diff(at)
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(mix(h ^ _EDGE), out=sums[1:])
        node = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)).view(np.int64)
        yield words.first, n, node, h, at


def _lists(values: np.ndarray, lengths: np.ndarray, mask: np.ndarray | None = None) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    nulls = None if mask is None else pa.array(mask)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)), mask=nulls)


def text_mark() -> Column:
    """What tells rows of one doc_id and different texts apart."""
    return F.xxhash64(F.col("text").cast("string")).alias("mark")


def sketches(docs: DataFrame, width: int, limits: Limits) -> DataFrame:
    """``doc_id, mark, n, node, firsts``: hash of the text, set size, hash of the set, its first tokens (null where the same task gave them before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for first, n, node, h, at in _set_rows(batch.column(1), width):
                again = np.zeros(len(n), dtype=bool)
                for k, v in enumerate(node.tolist()):
                    again[k] = v in seen
                    seen.add(v)
                keep = np.where(again, 0, limits.kept(n))
                pick = np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(keep, n)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(n)), batch.column(2).slice(first, len(n)), pa.array(n.astype(np.int64)), pa.array(node), _lists(h[pick], keep, again)],
                    ["doc_id", "mark", "n", "node", "firsts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_mark()).mapInArrow(
        run, "doc_id BIGINT, mark BIGINT, n BIGINT, node BIGINT, firsts ARRAY<BIGINT>")


def _postings(sk: DataFrame, words: Broadcast) -> DataFrame:
    """``node, n, pos, t`` of the first tokens that are in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = batch.column(2)
            at = firsts.offsets.to_numpy()
            t = firsts.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
            size = np.diff(at)
            row = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(has_bit(words.value, t, TOKEN_BITS))
            row = row[hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array((hit - (at[row] - at[0])).astype(np.int32)), pa.array(t[hit])],
                ["node", "n", "pos", "t"])

    return sk.select("node", "n", "firsts").mapInArrow(run, "node BIGINT, n BIGINT, pos INT, t BIGINT")


def whole_sets(docs: DataFrame, width: int, words: Broadcast) -> DataFrame:
    """``node, n, tokens`` of the documents whose id is in the bitmap (or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            hit = ~known | has_bit(words.value, ids.fill_null(0).to_numpy(zero_copy_only=False), BITS)
            batch = batch.filter(pa.array(hit))
            for _, n, node, h, at in _set_rows(batch.column(1), width):
                new = np.zeros(len(n), dtype=bool)
                for k, v in enumerate(node.tolist()):
                    new[k] = v not in seen
                    seen.add(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[new]), pa.array(n[new].astype(np.int64)), _lists(h[np.repeat(new, n)], n[new])],
                    ["node", "n", "tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "node BIGINT, n BIGINT, tokens ARRAY<BIGINT>")


def _counts(rows: list[np.ndarray], cols: list[np.ndarray] | None) -> np.ndarray:
    """Size of the intersection of each row set with each column set."""
    every = rows + (cols or [])
    tokens = np.concatenate(every) if every else np.zeros(0, dtype=np.uint64)
    who = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    place, who = place[shared], who[shared]
    _, place = np.unique(place, return_inverse=True)
    a, b = len(rows), len(every) - len(rows)
    out = np.zeros((a, b if cols is not None else a), dtype=np.float32)
    width, top = 2048, int(place.max()) + 1 if len(place) else 0
    order = np.argsort(place, kind="stable")
    place, who = place[order], who[order]
    for first in range(0, top, width):
        lo, hi = np.searchsorted(place, [first, first + width])
        m = np.zeros((len(every), width), dtype=np.float32)
        m[who[lo:hi], place[lo:hi] - first] = 1
        out += m[:a] @ (m[a:] if cols is not None else m).T
    return out.astype(np.int64)


def links_of(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], limits: Limits) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of side 0 and those of side 1 (or among all)."""
    one = _first_of(nodes, side)
    nodes, side, sets = nodes[one], side[one], [sets[i] for i in one]
    two = bool(side.any())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(nodes)),) * 2
    if not len(left) or not len(right):
        return []
    n = np.array([len(s) for s in sets], dtype=np.int64)
    a, b = n[left][:, None], n[right][None, :]
    fit = (np.minimum(a, b) * limits.den >= limits.num * np.maximum(a, b)) & (a > 0) & (b > 0)
    if not two:
        fit &= left[:, None] < right[None, :]
    p = limits.prefix(n)
    for order in _ORDERS:
        if not fit.any():
            return []
        firsts = [s[np.argsort(mix(s ^ order) if order else s)[:k]] for s, k in zip(sets, p, strict=True)]
        fit &= _counts([firsts[i] for i in left], [firsts[i] for i in right] if two else None) > 0
    rows, cols = np.flatnonzero(fit.any(1)), np.flatnonzero(fit.any(0))
    if not len(rows):
        return []
    both = _counts([sets[left[i]] for i in rows], [sets[right[i]] for i in cols])
    union = n[left[rows]][:, None] + n[right[cols]][None, :] - both
    linked = fit[np.ix_(rows, cols)] & (both * limits.den >= limits.num * union)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = int(left[rows[i]]), int(right[cols[j]])
        fx, fy = find(x), find(y)
        if fx != fy:
            root[fx] = fy
            out.append((int(nodes[x]), int(nodes[y])))
    return out


def _first_of(nodes: np.ndarray, side: np.ndarray) -> np.ndarray:
    order = np.lexsort((side, nodes))
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = (nodes[order][1:] != nodes[order][:-1]) | (side[order][1:] != side[order][:-1])
    return order[keep]


def _verify(jobs: DataFrame, limits: Limits) -> DataFrame:
    """Links ``a, b`` found in the jobs ``job, side, node, tokens``; a job's rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(nodes: list, side: list, sets: list):
            found = links_of(np.array(nodes, dtype=np.int64), np.array(side, dtype=np.int64), sets, limits)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        now, nodes, side, sets = None, [], [], []
        for batch in batches:
            values = batch.column(3).values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = batch.column(3).offsets.to_numpy()
            for k, (job, s, node) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if job != now:
                    if len(nodes) > 1:
                        yield from done(nodes, side, sets)
                    now, nodes, side, sets = job, [], [], []
                nodes.append(node)
                side.append(s)
                sets.append(np.array(values[at[k]:at[k + 1]]))
        if len(nodes) > 1:
            yield from done(nodes, side, sets)

    return jobs.mapInArrow(run, "a BIGINT, b BIGINT")


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, node, root, mark`` of every row of ``docs(doc_id, text)``.

    A row's set holds the shingles of ``width`` words of its lower-cased text (of
    all words where there are fewer). Rows link when
    ``den * |intersection| >= num * |union|``; ``component_id`` is the smallest
    doc_id reachable over links.

    Rows with null text, or without words, have no shingles and link with
    nothing: their own doc_id is the component. Rows with null doc_id take part
    and have no say in the smallest id. Repeated rows and equal sets are one node
    and come back as often as they came in. An empty table gives no rows. Other
    columns are not looked at. ``node`` is a 64-bit hash of the set, ``root`` that of
    one set of the component (two components can have the same smallest id, where an
    id repeats with another text), ``mark`` a hash of the text.
    """
    limits, context = Limits(num, den), docs.sparkSession.sparkContext
    sk = saved(sketches(docs, width, limits), "sketch")
    filled = sk.filter("n > 0 AND firsts IS NOT NULL")
    counts = saved(filled.select(F.explode("firsts").alias("t")).groupBy("t").agg(F.count("*").alias("cnt")).filter("cnt > 1"), "tokens")
    wanted = context.broadcast(bitmap(counts, "t", TOKEN_BITS))
    shared = saved(_postings(filled, wanted).join(counts, "t"), "shared")
    wanted.destroy()
    hot, live = shared.filter(F.col("cnt") >= HOT), shared.filter(F.col("cnt") < HOT)

    # candidates by the first order
    near = live.groupBy("t").agg(F.array_sort(F.collect_set(F.struct("n", "node"))).alias("m")).filter("size(m) > 1")
    pairs = near.select(F.inline(F.expr(f"""
        flatten(transform(m, (x, i) -> transform(
            filter(slice(m, i + 2, size(m)), y -> x.n * {den} >= {num} * y.n),
            y -> struct(x.node as a, x.n as na, y.node as b, y.n as nb))))""")))
    pairs = pairs.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c"))
    heavy = saved(hot.groupBy("node", "n").agg(
        F.count_if(F.expr(f"pos < {limits.head_sql('n')}")).alias("in_head"), F.count("*").alias("h")), "heavy")
    h = heavy.select("node", "h")
    pairs = (pairs.join(h.withColumnsRenamed({"node": "a", "h": "ha"}), "a", "left")
             .join(h.withColumnsRenamed({"node": "b", "h": "hb"}), "b", "left"))
    least = lambda n: f"{limits.kept_sql(n)} - ({n} - {limits.overlap_sql('na', 'nb')})"
    pairs = pairs.filter(f"c + least(coalesce(ha, 0), coalesce(hb, 0)) >= least({least('na')}, {least('nb')})")
    # sets that are found by their hot tokens only
    bulk = heavy.filter(f"{limits.head_sql('n')} - in_head < {limits.prefix_sql('n')}").select("node")
    by_hot = hot.filter(f"pos < {limits.prefix_sql('n')}").join(bulk, "node", "left_semi").select("t", "node")
    stars = by_hot.join(by_hot.groupBy("t").agg(F.min("node").alias("pivot")), "t").select(
        F.col("node").alias("a"), F.col("pivot").alias("b"))
    families = components(pairs.select("a", "b").unionByName(stars), "family")

    classes = saved(sk.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "classes")
    members = families.join(classes, "node")
    wanted = context.broadcast(bitmap(members, "doc_id", BITS))
    sets = whole_sets(docs, width, wanted)
    links = saved(_verify(_jobs(members.select("node", "root", "n"), sets, limits), limits), "found")
    wanted.destroy()
    found = components(links, "links")

    root = F.coalesce("root", "node")
    named = classes.filter("n > 0").join(found, "node", "left").select("node", root.alias("root"), "doc_id")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "root").select("node", "component_id", "root")
    return (sk.select("doc_id", "mark", "n", "node").join(named, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node", root.alias("root"), "mark"))


def _jobs(members: DataFrame, sets: DataFrame, limits: Limits) -> DataFrame:
    """``job, side, node, tokens``: every two sets of a family that may link meet in a job.

    A small family is one job. A larger one is cut by size, each step a factor of
    the similarity, so only sets of the same or the next step can link; steps are
    dealt into blocks, and every two blocks are a job.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-1.000001 * np.log(1 - limits.loss)))).cast("int")
    members = members.withColumn("step", step)
    # a row per family: its sets, and the blocks of each step
    units = members.groupBy("root", "step").agg(F.count("*").alias("c")).groupBy("root").agg(
        F.sum("c").alias("m"), F.map_from_entries(F.collect_list(F.struct("step", F.ceil(F.col("c") / BLOCK).cast("int")))).alias("ks"))
    members = members.join(saved(units, "units"), "root").withColumn("small", F.col("m") <= BLOCK)
    beside = lambda d: F.when(~F.col("small"), F.try_element_at("ks", F.col("step") + d))
    members = members.withColumns({"k": F.coalesce(beside(0), F.lit(1)), "k_next": beside(1), "k_prev": beside(-1)})
    members = members.withColumn("step", F.when(F.col("small"), 0).otherwise(F.col("step")))
    job = lambda s1, b1, s2, b2: f"xxhash64(root, {s1}, {b1}, {s2}, {b2})"
    members = members.withColumn("b", F.expr("cast(pmod(xxhash64(node), k) as int)"))
    jobs = members.select("node", F.inline(F.expr(f"""
        concat(
          transform(sequence(0, k - 1), o -> struct({job('step', 'least(b, o)', 'step', 'greatest(b, o)')} as job, if(o < b, 1, 0) as side)),
          if(k_next is null, array(), transform(sequence(0, k_next - 1), o -> struct({job('step', 'b', 'step + 1', 'o')} as job, 0 as side))),
          if(k_prev is null, array(), transform(sequence(0, k_prev - 1), o -> struct({job('step - 1', 'o', 'step', 'b')} as job, 1 as side))))""")))
    rows = jobs.join(sets, "node").select("job", "side", "node", "tokens")
    return rows.repartition("job").sortWithinPartitions("job")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, null ids last.

    A group is a component of ``jaccard_components``; rows count by doc_id and text, so
    unlike texts of one id are rows of their own. Of several texts of a group's smallest
    id one stays, and of rows that are equal in both the one with the smallest other
    columns. Rows with null text, or without words, are in no group and all stay. An
    empty table gives no rows.
    """
    found = saved(jaccard_components(docs, width, num, den).filter("n_shingles > 0").select(F.col("doc_id").alias("g_id"), F.col("mark").alias("g_mark"), "root"), "groups")
    first = F.min(F.struct(F.col("g_id").isNull().alias("none"), "g_id", "g_mark")).alias("first")
    first = saved(found.groupBy("root").agg(first), "first")
    met = found.join(first, "root").withColumn("stays", F.expr("g_id <=> first.g_id AND g_mark = first.g_mark"))
    fates, rows_of = saved_with(met.groupBy("g_id", "g_mark", "stays").agg(F.count("*").alias("n")).filter("NOT stays OR n > 1"), "fates",
                                gone=F.count_if(~F.col("stays")), again=F.count_if(F.col("stays")))
    gone, again = (fates.filter(which).select("g_id", "g_mark") for which in ("NOT stays", "stays"))
    rows, same = docs.select(F.struct(*docs.columns).alias("d"), text_mark()), F.expr("d.doc_id <=> g_id AND mark = g_mark")
    kept = rows.join(sized(gone, rows_of["gone"]), same, "left_anti")
    if not rows_of["again"]:
        return kept.select("d.*")
    again = sized(again, rows_of["again"])
    alone = kept.join(again, same, "left_anti").select("d")
    one = kept.join(again, same, "left_semi").groupBy("d.doc_id", "mark").agg(F.min("d").alias("d")).select("d")
    return alone.unionByName(one).select("d.*")


def op2_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """All documents: 3-word shingles, similarity 90 % or more."""
    return jaccard_components(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")
