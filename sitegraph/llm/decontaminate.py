"""Benchmark decontamination: close word pairs as seeds, then local alignment of words.

A seed is two words of a test item with at most one word between. Every alignment
of a score above that of one word holds a known number of such pairs, so of an
item's pairs only the rarest have to be looked for: as many that one of them is
in every alignment that counts. Texts are read twice. The first time the pairs
are counted; the second time, where a text may hold a pair that is looked for (a
fixed-size bitmap decides), the words around are kept as a passage. Different
passages meet items in an exact join, and Smith-Waterman alignment of the words
scores how much of the item the passage holds, with words changed, dropped or
put in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegraph.llm.common import bitmap, has_bit, saved, saved_side, saved_with, table
from sitegraph.llm.words import NOT_ALNUM, Words, mix, shingles, slices

#: items of fewer words are one seed of all their words
SEED = 4
#: size of the bitmap of seeds, looked up at two places
BITS = 24
_OTHER = np.uint64(0x2545F4914F6CDD1D)
#: gains of the alignment: an equal word, another word, a word too many or missing
MATCH, MISMATCH, GAP = 2, -1, -1
#: an item counts as leaked from this share of its full score
LEAK = 0.5


def pairs_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of two words, next to each other or with one between, and the number of the first word."""
    h = w.hashes()
    seeds, spots = [], []
    for step in (1, 2):
        if len(h) > step:
            at = np.flatnonzero(w.doc[:-step] == w.doc[step:])
            seeds.append(mix(mix(h[at]) + h[at + step]))
            spots.append(at)
    return (np.concatenate(seeds), np.concatenate(spots)) if seeds else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def seeds_of(w: Words, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All seeds of texts: pairs, and stretches of the widths below ``SEED`` that items have."""
    s, at = pairs_of(w)
    for width in (k for k in widths if k < SEED):
        if w.doc.size >= width:
            s = np.concatenate([s, shingles(w, width, short=False)[0]])
            at = np.concatenate([at, np.flatnonzero(w.doc[:w.doc.size - width + 1] == w.doc[width - 1:])])
    return s, at


def item_words(items: DataFrame) -> DataFrame:
    """``item_id, words, width, seeds, spots``: hashes of the words and of the seeds, and each seed's first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), NOT_ALNUM):
                h, n = w.hashes(), w.counts()
                begin = np.concatenate([[0], np.cumsum(n)])
                s, at = pairs_of(w)
                few = n[w.doc[at]] < SEED
                s, at = s[~few], at[~few]
                # shingles of SEED words, but for texts of fewer: those are one
                whole, doc = shingles(w, SEED)
                few = n[doc] < SEED
                s, at = np.concatenate([s, whole[few]]), np.concatenate([at, begin[doc[few]]])
                order = np.argsort(at, kind="stable")
                s, at = s[order], at[order]
                size = np.bincount(w.doc[at], minlength=w.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.n_docs), _lists(h, n), pa.array(np.minimum(n, SEED).astype(np.int32)),
                     _lists(s, size), _lists(at - begin[w.doc[at]], size)], ["item_id", "words", "width", "seeds", "spots"])

    return items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        "item_id IS NOT NULL").mapInArrow(
            run, "item_id BIGINT, words ARRAY<BIGINT>, width INT, seeds ARRAY<BIGINT>, spots ARRAY<BIGINT>").filter("width > 0")


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")


def _possible(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Where the bitmap of seeds has both places of a seed."""
    hit = np.flatnonzero(has_bit(bits, s, BITS))
    return hit[has_bit(bits, s[hit] ^ _OTHER, BITS)]


def counted(docs: DataFrame, shared: Broadcast, widths: list[int]) -> DataFrame:
    """``t, often``: how often the texts hold each possible seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), NOT_ALNUM):
                s, _ = seeds_of(w, widths)
                t, n = np.unique(s[_possible(shared.value, s)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], ["t", "n"])

    return _texts(docs).mapInArrow(run, "t BIGINT, n BIGINT").groupBy("t").agg(F.sum("n").alias("often"))


def passages(docs: DataFrame, shared: Broadcast, widths: list[int], around: int) -> DataFrame:
    """``doc_id, at, words, hits``: stretches of words around possible seeds, ``at`` the first word's number.

    Hits closer than twice ``around`` words share a stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), NOT_ALNUM):
                h = w.hashes()
                begin = np.concatenate([[0], np.cumsum(w.counts())])
                seed, spot = seeds_of(w, widths)
                hit = _possible(shared.value, seed)
                if not len(hit):
                    continue
                hit = hit[np.argsort(spot[hit], kind="stable")]
                spot, seed = spot[hit], seed[hit]
                doc = w.doc[spot]
                new = np.ones(len(spot), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (spot[1:] - spot[:-1] > 2 * around)
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(spot)) - 1
                first = np.maximum(spot[head] - around, begin[doc[head]])
                last = np.minimum(spot[tail] + SEED + around, begin[doc[head] + 1])
                n = last - first
                pick = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                ids = batch.column(0).slice(w.first, w.n_docs).take(pa.array(doc[head]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array((first - begin[doc[head]]).astype(np.int64)), _lists(h[pick], n), _lists(seed, tail - head + 1)],
                    ["doc_id", "at", "words", "hits"])

    return _texts(docs).mapInArrow(run, "doc_id BIGINT, at BIGINT, words ARRAY<BIGINT>, hits ARRAY<BIGINT>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score of two word rows, and where in the passage the best stretch ends.

    A row of the table at a time: gaps along the row are a running maximum.
    """
    slope = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        step = np.maximum(row + GAP, 0)
        np.maximum(step[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH), out=step[1:])
        row = np.maximum.accumulate(step + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def scored(pairs: DataFrame, least: float) -> DataFrame:
    """``p, q, item_id, seeds, score, end`` of pairs with the words of both sides; 0 where too few words are shared for ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column(4), batch.column(5))]
            score, ends = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for k in range(batch.num_rows):
                item, passage = (v[o[k]:o[k + 1]] for v, o in sides)
                if np.isin(item, passage).sum() < least * len(item) - 1e-9:
                    continue
                best, ends[k] = align(item, passage)
                score[k] = best / (MATCH * len(item))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score), pa.array(ends)],
                                             ["p", "q", "item_id", "seeds", "score", "end"])

    return pairs.select("p", "q", "item_id", "seeds", "item_words", "words").mapInArrow(
        run, "p BIGINT, q BIGINT, item_id BIGINT, seeds BIGINT, score DOUBLE, end BIGINT")


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAK) -> DataFrame:
    """``doc_id, item_id, seeds, score, ends``: which of ``docs(doc_id, text)`` hold which of ``items(item_id, text)``.

    ``score`` is the alignment's share of the item's full score, ``least`` or
    more; ``seeds`` the different seeds of those looked for that met, ``ends`` the number of the word
    behind the aligned stretch. Words are letters and digits, without case in
    ASCII. An item that is in a text at several places is returned once, by its
    best place, the first of equal ones.

    Rows without id, null and empty texts, and items without words match nothing.
    Rows that repeat an id count as one document. Empty tables give no rows.
    Other columns are not looked at. An item of fewer than ``SEED`` words is
    one seed, and has to stand in the text as it is.

    Nothing from ``least`` up is passed over, as long as a single word cannot reach
    it (``least`` times the item's words above 1; with 0.5, any item of ``SEED``).
    Of n words with m matched, the score is 2 m less the words skipped between
    matched neighbours (on the side that skips more), so at most m - ``least`` n of
    the m - 1 steps skip two or more: ``least`` n - 1 steps at least are seeds, each
    at another word of the item. Of its n - 1 words that begin seeds, all but so
    many less one are looked for, the rarest. Such a stretch has (3 - 2 ``least``) n
    words at most.
    """
    words, facts = saved_with(item_words(items), "items", longest=F.max(F.size("words")),
                              **{f"width{k}": F.count_if(F.col("width") == k) for k in range(1, SEED + 1)})
    widths = [k for k in range(1, SEED + 1) if facts[f"width{k}"]]
    if not widths:
        return words.select(F.col("item_id").alias("doc_id"), "item_id", F.lit(0).cast("bigint").alias("seeds"),
                            F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("ends"))
    seeds = words.select(
        "item_id", F.xxhash64("words").alias("own"), "width", F.size("words").alias("n"), F.inline(F.arrays_zip(F.col("seeds").alias("t"), F.col("spots").alias("spot"))))

    def bits(some: DataFrame) -> Broadcast:
        return docs.sparkSession.sparkContext.broadcast(bitmap(some.select(F.inline(F.expr(f"array(struct(t as t), struct(t ^ {int(_OTHER.view(np.int64))}L as t))"))), "t", BITS))

    # how often the corpus has each seed, and each item's rarer first words
    possible = bits(seeds)
    seeds = saved(seeds.join(counted(docs, possible, widths), "t", "left").withColumn("often", F.coalesce("often", F.lit(0))), "seeds")
    possible.destroy()
    sure = F.greatest(F.lit(1), F.ceil(F.lit(float(least)) * F.col("n") - 1 - 1e-9))
    rank = F.row_number().over(W.partitionBy("item_id", "own").orderBy("often", "spot"))
    place = ["item_id", "own", "spot"]
    rare = seeds.groupBy(*place, "n").agg(F.sum("often").alias("often")).withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - sure)
    short = seeds.filter(F.col("width") < SEED).select("item_id", "t")
    seeds = saved(seeds.filter(F.col("width") == SEED).join(rare.select(place), place, "left_semi")
                  .select("item_id", "t").unionByName(short).distinct(), "looked_for")
    around = math.ceil(max(1.0, 3 - 2 * least) * facts["longest"])
    wanted = bits(seeds)
    held = saved(passages(docs, wanted, widths, around), "passages")
    wanted.destroy()
    # the alignment depends on the words alone: equal passages meet the items once
    held = held.withColumn("p", F.xxhash64("words")).withColumn("q", F.xxhash64(F.lit(1), "words"))
    own = saved(held.select("p", "q", "words", "hits").dropDuplicates(["p", "q"]), "different")
    met = own.select("p", "q", F.explode(F.array_distinct("hits")).alias("t")).join(seeds, "t").groupBy("p", "q", "item_id").agg(
        F.count("*").alias("seeds"))
    pairs = met.join(own.select("p", "q", "words"), ["p", "q"]).join(
        words.select("item_id", F.col("words").alias("item_words")), "item_id")
    found = saved_side(scored(pairs, least).filter(F.col("score") >= least), "aligned")
    places = held.select("doc_id", "at", "p", "q").join(found, ["p", "q"]).withColumn("ends", F.col("at") + F.col("end"))
    best = places.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("seeds", "score", "ends"), F.struct("score", -F.col("ends"), "seeds")).alias("b"))
    return best.select("doc_id", "item_id", "b.seeds", "b.score", "b.ends")


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """All documents against all benchmark items."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
