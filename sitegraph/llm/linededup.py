"""Lines that repeat across documents, found behind two Bloom filters.

Every task passes its lines through a pair of filters of a fixed size: what the first
(once seen) already holds goes into the second (twice seen). Pairs of all tasks are
merged slice by slice: bits that two of the first share belong to the second. Only
lines that the second filter holds are shuffled, as digests, for an exact count and
the choice of the document that keeps them. A filter that is too full lets more lines
pass to the exact count and loses none.

Cases: a null text is an empty one: one empty line. Rows with the same doc_id are one
document; a null doc_id is one document too, the smallest. Repeated rows come out as
often as they come in. An empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import saved, table

#: a line counts from so many code points on, and repeats in so many documents
LEAST, COPIES = 40, 5

#: bits of each filter (16 MB), and of the part of it that is merged at once
BITS, SLICE_BITS = 27, 22

#: bits set per line, all in one 64-bit word
MARKS = 3

BLANKS = b" \t\n\x0b\x0c\r"

#: output rows and text bytes of a batch
BATCH, BATCH_BYTES = 2048, 8 << 20


def key(line: bytes) -> bytes | None:
    """What makes two lines one, or None for a line too short to count."""
    line = line.strip(BLANKS)
    if len(line) < LEAST or (len(line) < 4 * LEAST and not line.isascii() and len(line.decode("utf-8", "replace")) < LEAST):
        return None
    return line.lower()  # of bytes: A to Z only


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each hash in a filter of 2**bits bits, and its marks there."""
    word = (hashes >> np.uint64(70 - bits)).astype(np.int64)
    marks = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(MARKS):
        marks |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return word, marks


class Filters:
    """Once-seen and twice-seen bits of one task, or of a slice of all tasks."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = (np.zeros(1 << (bits - 6), dtype=np.uint64) for _ in range(2))

    def add(self, hashes: np.ndarray) -> None:
        """``hashes``: of lines, a line of one document once."""
        hashes, counts = np.unique(hashes, return_counts=True)
        word, marks = places(hashes, self.bits)
        again = (counts > 1) | (self.once[word] & marks == marks)
        np.bitwise_or.at(self.twice, word[again], marks[again])
        np.bitwise_or.at(self.once, word, marks)

    def merge(self, word: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
        """The words that another task has set, each once."""
        self.twice[word] |= twice | (self.once[word] & once)
        self.once[word] |= once


def lines_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Row number and lines; the texts are bytes in column 0."""
    for row, text in enumerate(batch.column(0)):
        yield row, (text.as_py() or b"").split(b"\n")


def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, list[int], list[int], list[bytes]]:
    """Hash, row, line number and key of every line that counts."""
    rows, numbers, keys = [], [], []
    for row, lines in lines_of(batch):
        for number, line in enumerate(lines):
            k = key(line)
            if k is not None:
                rows.append(row)
                numbers.append(number)
                keys.append(k)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys)), rows, numbers, keys


def twice_seen(texts: DataFrame, bits: int) -> np.ndarray:
    """The merged second filter over the column ``text`` (bytes)."""
    part = min(bits, SLICE_BITS) - 6

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(bits)
        for batch in batches:
            hashes, rows, _, _ = hashed(batch)
            once = np.unique(np.stack([np.array(rows, dtype=np.uint64), hashes]), axis=1)[1] if rows else hashes
            own.add(once)
        full = np.flatnonzero(own.once)
        cuts = np.searchsorted(full, np.arange(0, len(own.once) + 1, 1 << part))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                at = full[a:b]
                data = ((at & ((1 << part) - 1)).astype("<u4"), own.once[at], own.twice[at])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=["slice", "word", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([whole.twice.tobytes()], pa.binary())], names=["slice", "twice"])

        for batch in batches:
            for k, word, once, twice in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != now:
                    if whole is not None:
                        yield done()
                    now, whole = k, Filters(part + 6)
                whole.merge(np.frombuffer(word, "<u4"), np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64))
        if whole is not None:
            yield done()

    parts = texts.select("text").mapInArrow(gather, "slice INT, word BINARY, once BINARY, twice BINARY")
    parts = parts.repartition(1 << max(0, bits - 6 - part), "slice").sortWithinPartitions("slice")
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for row in parts.mapInArrow(merge, "slice INT, twice BINARY").toLocalIterator():
        out[row.slice << part:(row.slice + 1) << part] = np.frombuffer(row.twice, np.uint64)
    return out


def suspects(texts: DataFrame, bits: int) -> DataFrame:
    """``key`` (128 bits of SHA-256), ``doc_id``, ``mark``, ``lines``: the lines of a row that the second filter holds."""
    spark = texts.sparkSession
    seen = spark.sparkContext.broadcast(twice_seen(texts, bits))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows, numbers, keys = hashed(batch)
            word, marks = places(hashes, bits)
            found: dict[tuple[int, bytes], list[int]] = {}
            for k in np.flatnonzero(seen.value[word] & marks == marks).tolist():
                found.setdefault((rows[k], keys[k]), []).append(numbers[k])
            at = pa.array([row for row, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array([hashlib.sha256(k).digest()[:16] for _, k in found], pa.binary()),
                batch.column(1).take(at), batch.column(2).take(at), pa.array(list(found.values()), pa.list_(pa.int32())),
            ], names=["key", "doc_id", "mark", "lines"])

    found = texts.mapInArrow(pick, f"key BINARY, doc_id {dict(texts.dtypes)['doc_id']}, mark BIGINT, lines ARRAY<INT>")
    out = saved(found, "suspect-lines")
    seen.destroy()
    return out


def repeated_lines(docs: DataFrame, copies: int = COPIES, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``mark`` (of the text) and ``lines`` (numbers from 0) of the lines that must go.

    A line found in ``copies`` documents or more stays in the one of largest doc_id only.
    """
    found = suspects(marked(docs), bits)
    last = found.groupBy("key").agg(F.countDistinct(F.struct("doc_id")).alias("n"), F.max("doc_id").alias("last"))
    last = saved(last.filter(F.col("n") >= copies).select("key", "last"), "often-lines")
    gone = found.join(last, "key").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return gone.groupBy("doc_id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


def marked(docs: DataFrame) -> DataFrame:
    """Texts as bytes, with the id and a hash of the text, which tells rows of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(text.cast("binary").alias("text"), "doc_id", F.xxhash64(text).alias("mark"))


def without_repeated_lines(docs: DataFrame, copies: int = COPIES, bits: int = BITS) -> DataFrame:
    """``doc_id``, the ``text`` that stays, ``n_lines`` before and ``n_dropped``, a row for each row of ``docs``."""
    texts, gone = marked(docs), saved(repeated_lines(docs, copies, bits), "gone-lines")
    gone = gone.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "lines")
    both = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").select("text", "doc_id", "lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, from_row, size = batch.column(2).to_pylist(), 0, 0
            out: tuple[list, list, list] = ([], [], [])

            def part(to_row: int) -> pa.RecordBatch:
                kept, n, dropped = out
                arrays = [batch.column(1).slice(from_row, to_row - from_row), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]  # noqa: B023
                return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_lines", "n_dropped"])

            for row, lines in lines_of(batch):
                less = set(gone[row] or ())
                kept = b"\n".join([x for k, x in enumerate(lines) if k not in less] if less else lines)
                for column, value in zip(out, (kept, len(lines), len(less)), strict=True):
                    column.append(value)
                size += len(kept)
                if len(out[0]) >= BATCH or size >= BATCH_BYTES:
                    yield part(row + 1)
                    out, from_row, size = ([], [], []), row + 1, 0
            yield part(batch.num_rows)

    return both.mapInArrow(cut, f"doc_id {dict(texts.dtypes)['doc_id']}, text STRING, n_lines BIGINT, n_dropped BIGINT")


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the lines that repeat: counts, and a digest of what stays."""
    kept = without_repeated_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), decided AS (
  SELECT keyed.doc_id, line, no, coalesce(last <> keyed.doc_id, false) AS gone
  FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM decided GROUP BY doc_id
"""
