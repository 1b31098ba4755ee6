"""Toxicity: boosted trees over a few dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, that toxic texts of the
training sample have and others lack. What a text's hits, their nearness to the
second person, capitals, punctuation and disguised words say is left to the trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import saved, saved_with, table
from sitegraph.llm.words import NOT_ALNUM, Words, mix, slices

#: at most so many labelled rows of each class train the model, those of the smallest hash
SAMPLE = 12_000
#: most entries of the lexicon, those of the highest weight
ENTRIES = 4_000
#: beginnings of words, in bytes
STEMS = (4, 5, 6)
#: an entry is in so many toxic texts of the sample at least (and in this share of them), and so many times likelier there
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = 3, 0.005, 12.0
#: words to either side in which a second person counts as near
NEAR = 6

#: fixed values: words for the second person
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "youre", "u", "ur",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "sie",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos",
    "ti", "tus", "usted", "ustedes", "vosotros", "os",
)

FEATURES = ("hits", "hit_rate", "hit_kinds", "stem_rate", "heaviest", "near_you", "you_rate",
            "capital_rate", "shout_rate", "punctuation_rate", "bang_rate", "disguise_rate", "repeat_rate", "log_words")


def _word_hash(texts: list[str]) -> np.ndarray:
    """Hashes of single words as ``slices`` gives them."""
    out = []
    for w in slices(pa.array(texts), NOT_ALNUM):
        out.append(w.hashes())
    return np.concatenate(out)


def _stems(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words are longer than ``n`` bytes, and the hash of their first ``n`` (marked as a beginning)."""
    at = np.flatnonzero(w.end - w.start > n)
    return at, mix(w.stretch(w.start[at], w.start[at] + n) + np.uint64(n))


def _terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Every term of the texts: words and beginnings, with their documents."""
    h, doc = [w.hashes()], [w.doc]
    for n in STEMS:
        at, stem = _stems(w, n)
        h.append(stem)
        doc.append(w.doc[at])
    return np.concatenate(h), np.concatenate(doc)


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic, part`` of at most ``SAMPLE`` labelled rows of each class.

    Equal texts count once. ``part`` 0 to 3: part 3 is for calibration.
    """
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(3), "doc_id")
    picked = None
    for kind in (0, 1):
        # a sort with a limit keeps that many rows per task
        some = marked.filter(F.col("toxic") == kind).orderBy(order, "doc_id").limit(SAMPLE)
        picked = some if picked is None else picked.unionByName(some)
    # SAMPLE rows of two numbers at most: the bound that allows the broadcast
    got = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    once = got.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(F.min_by(F.struct("text", "toxic"), "doc_id").alias("x"))
    return once.select("x.text", "x.toxic", F.pmod("h", F.lit(4)).cast("int").alias("part"))


def lexicon(sample: DataFrame, bad: int, good: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of terms and their weights: the log of how much likelier toxic texts (``bad`` of the sample, ``good`` others) are to have them."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for w in slices(batch.column(0), NOT_ALNUM):
                h, doc = _terms(w)
                pair = np.unique(np.stack([doc.astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[1].view(np.int64)), pa.array(toxic[w.first + pair[0].astype(np.int64)].astype(np.int32))], ["t", "toxic"])

    found = sample.select("text", "toxic").mapInArrow(terms, "t BIGINT, toxic INT").groupBy("t").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    ratio = (F.col("bad") + 0.5) / F.lit(bad + 1.0) / ((F.col("good") + 0.5) / F.lit(good + 1.0))
    best = found.filter(F.col("bad") >= max(LEAST_TEXTS, LEAST_SHARE * bad)).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    rows = best.orderBy(F.desc(F.log("ratio") * F.col("bad")), "t").limit(ENTRIES).select("t", F.log("ratio").alias("w")).toPandas()
    rows = rows.sort_values("t", key=lambda t: t.to_numpy().view(np.uint64))
    return rows["t"].to_numpy(np.int64).view(np.uint64), rows["w"].to_numpy(np.float64)


def _weigh(h: np.ndarray, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(entries) or not len(h):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(entries, h), len(entries) - 1)
    return np.where(entries[at] == h, weights[at], 0.0)


_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTERS = _UPPER.copy()
_LETTERS[97:123] = True
_LETTERS[128:] = True
_DIGITS = np.zeros(256, dtype=bool)
_DIGITS[48:58] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def dense_features(w: Words, entries: np.ndarray, weights: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` per document of the slice."""
    docs, doc = w.n_docs, w.doc
    count = lambda of, weight=None: np.bincount(of, weight, minlength=docs).astype(np.float64)
    n = np.maximum(count(doc), 1)
    h = w.hashes()
    whole = _weigh(h, entries, weights)
    stem = np.zeros(len(h))
    key = h.copy()
    for size in STEMS:
        at, s = _stems(w, size)
        value = _weigh(s, entries, weights)
        better = value > stem[at]
        key[at[better]] = s[better]
        stem[at] = np.maximum(stem[at], value)
    weight = np.maximum(whole, stem)
    key = np.where(whole > 0, h, key)
    hit = np.flatnonzero(weight > 0)
    kinds = np.unique(np.stack([doc[hit].astype(np.uint64), key[hit]]), axis=1)[0].astype(np.int64) if len(hit) else hit
    heaviest = np.zeros(docs)
    np.maximum.at(heaviest, doc[hit], weight[hit])
    you = np.flatnonzero(np.isin(h, second))
    near = np.zeros(len(hit), dtype=bool)
    if len(you) and len(hit):
        right = np.searchsorted(you, hit)
        for at in (np.minimum(right, len(you) - 1), np.maximum(right - 1, 0)):
            near |= (np.abs(you[at] - hit) <= NEAR) & (doc[you[at]] == doc[hit])
    size = np.diff(w.at)
    of_byte = np.repeat(np.arange(docs), size)
    letters, upper, marks = _LETTERS[w.raw], _UPPER[w.raw], _MARKS[w.raw]
    chars = np.maximum(size, 1)
    upto = np.concatenate([[0], np.cumsum(upper)])
    shout = (upto[w.end] - upto[w.start] == w.end - w.start) & (w.end - w.start > 2)
    bang = (w.raw == 33) | (w.raw == 63)
    # a digit or mark between letters, as in a disguised word
    odd = np.zeros(len(w.raw), dtype=bool)
    # three bytes of one document
    one = of_byte[2:] == of_byte[:-2]
    if len(w.raw) > 2:
        odd[1:-1] = one & letters[:-2] & letters[2:] & (marks | _DIGITS[w.raw])[1:-1]
    same = np.zeros(len(w.raw), dtype=bool)
    if len(w.raw) > 2:
        same[2:] = one & letters[2:] & (w.raw[2:] == w.raw[1:-1]) & (w.raw[1:-1] == w.raw[:-2])
    return np.stack([
        count(doc[hit]), count(doc[hit], weight[hit]) / n, count(kinds), count(doc, (stem > 0).astype(float)) / n, heaviest,
        count(doc[hit[near]]), count(doc[you]) / n,
        count(of_byte, upper.astype(float)) / chars, count(doc, shout.astype(float)) / n,
        count(of_byte, marks.astype(float)) / chars, count(of_byte, bang.astype(float)) / chars,
        count(of_byte, odd.astype(float)) / n, count(of_byte, same.astype(float)) / n, np.log1p(count(doc)),
    ], axis=1)


def with_features(rows: DataFrame, keep: list[str], entries: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``keep`` columns (BIGINT) of ``rows`` with the features of ``text``; null text counts as empty."""
    second = np.sort(_word_hash(list(SECOND_PERSON)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(0), NOT_ALNUM):
                x = dense_features(w, entries, weights, second)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(w.first, w.n_docs) for c in batch.columns[1:]] + [pa.array(x[:, k]) for k in range(len(FEATURES))],
                    [*keep, *FEATURES])

    schema = ", ".join([f"{k} BIGINT" for k in keep] + [f"{f} DOUBLE" for f in FEATURES])
    return rows.select("text", *[F.col(k).cast("bigint").alias(k) for k in keep]).mapInArrow(run, schema)


class ToxicityModel:
    """Lexicon, trees and calibration, fitted on a bounded sample."""

    def __init__(self, docs: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 3) -> None:
        sample, n = saved_with(training_sample(docs, labels).coalesce(8), "sample", **{
            name: F.count_if(F.expr(f"toxic = {kind} AND part {part}"))
            for name, kind, part in (("bad", 1, "< 3"), ("good", 0, "< 3"), ("held_bad", 1, "= 3"), ("held_good", 0, "= 3"))})
        self.entries, self.weights = lexicon(sample.filter("part < 3"), n["bad"], n["good"])
        self.assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        rows = saved(self.assemble.transform(with_features(sample, ["toxic", "part"], self.entries, self.weights))
                     .select(F.col("toxic").cast("double").alias("label"), "part", "features").coalesce(4), "features")
        self.trees = self.scale = None
        # without both classes there is nothing to learn: every score is the labels' mean
        self.prior = n["bad"] / max(1, n["bad"] + n["good"])
        if n["bad"] and n["good"]:
            self.trees = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=3, minInstancesPerNode=5).fit(rows.filter("part < 3"))
            if n["held_bad"] and n["held_good"]:
                self.scale = IsotonicRegression(featuresCol="raw", labelCol="label").fit(self._raw(rows.filter("part = 3")))

    def _raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns (BIGINT) of ``docs`` and ``score``, 0 to 1."""
        return self.add_score(with_features(docs, keep, self.entries, self.weights)).select(*keep, "score")

    def add_score(self, x: DataFrame) -> DataFrame:
        """Rows with the features, and ``score``."""
        if self.trees is None:
            return x.withColumn("score", F.lit(self.prior))
        x = self._raw(self.assemble.transform(x))
        if self.scale is None:
            return x.withColumn("score", F.col("raw"))
        # calibrated steps tie; a small share of the raw score keeps their order
        score = 0.98 * F.col("prediction") + 0.02 * F.col("raw")
        return self.scale.transform(x).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def without_toxic(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """``docs`` but for the rows that ``score_documents`` predicts to be toxic, all columns as they are."""
    model = model or ToxicityModel(docs, labels.filter(~held_out(F.col("doc_id"))))
    second = np.sort(_word_hash(list(SECOND_PERSON)))
    entries, weights = model.entries, model.weights

    @F.arrow_udf("array<double>")
    def features(text: pa.Array) -> pa.Array:
        parts = [dense_features(w, entries, weights, second).reshape(-1) for w in slices(text, NOT_ALNUM)]
        offsets = np.arange(len(text) + 1, dtype=np.int32) * len(FEATURES)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0)))

    names = [F.col("x")[k].alias(f) for k, f in enumerate(FEATURES)]
    rows = docs.select(F.struct(*docs.columns).alias("doc"), features(F.col("text").cast("string")).alias("x")).select("doc", *names)
    return model.add_score(rows).filter(F.col("score") < 0.7).select("doc.*")


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels the contract keeps from training; null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Labels come from ``labels(doc_id, toxic)``, of rows not held out; at most
    ``SAMPLE`` rows of each class. Rows without doc_id or label never train.
    Several labels of a doc_id count as toxic if one does. Null and empty texts
    get the score of a text without words; without labels of both classes every
    score is the share of toxic ones (0 if there are none). Repeated rows get
    equal scores. Other columns are not looked at.
    """
    model = model or ToxicityModel(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = model.score(docs, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, by the labels of those not held out."""
    return score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))
