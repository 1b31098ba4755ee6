"""What several operators share: saved tables, fixed-size bitmaps, connected rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.words import mix
from sitegraph.session import cut_lineage, run_folder

#: a word: what is between blanks (0x20, 0x09 to 0x0D)
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there."""
    return cut_lineage(df, run_folder(df.sparkSession, name))


def saved_with(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """Like ``saved``, and aggregates of its rows, taken by the tasks that write them: no job counts them later."""
    seen = Observation()
    out = saved(df.observe(seen, *[c.alias(n) for n, c in figures.items()]), name)
    return out, seen.get


#: a join side of so many bytes is copied to all tasks; beyond it, both sides are shuffled
COPIED_BYTES = 8 << 20

#: bytes of a value of fixed width in a row, and what others are taken for
WIDTHS = {"bigint": 8, "double": 8, "int": 8, "boolean": 8}
OTHER_WIDTH = 64


def sized(side: DataFrame, rows: int | None = None) -> DataFrame:
    """A saved side of a join, copied to all tasks if its rows, ``rows`` or those counted here, are small."""
    width = 16 + sum(WIDTHS.get(kind, OTHER_WIDTH) for _, kind in side.dtypes)
    return F.broadcast(side) if (side.count() if rows is None else rows) * width <= COPIED_BYTES else side


def saved_side(df: DataFrame, name: str) -> DataFrame:
    """``df`` saved as a side of a join, counted while it is written, and ``sized``."""
    side, seen = saved_with(df, name, rows=F.count(F.lit(1)))
    return sized(side, seen["rows"])


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose doc_id is in ``ids``; rows without doc_id stay."""
    return docs.join(saved_side(ids.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "ids"), "doc_id", "left_anti").select(*docs.columns)


def crc32_text(text: F.Column) -> F.Column:
    return F.crc32(F.encode(text, "UTF-8"))


def bit_places(values: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each 64-bit value in a bitmap of 2**bits bits."""
    return (mix(values.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


#: words of 64 bits of a bitmap that are merged at once
SLICE = 1 << 16


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with a bit set for each value of a BIGINT column.

    Its size is fixed, whatever the table's: a full bitmap lets more rows pass to
    the exact join behind it, and loses none. Tasks send the words they have set,
    slice by slice; merged slices reach the driver as one binary value each.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for batch in batches:
            at = bit_places(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(got, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        full = np.flatnonzero(got)
        for k in np.unique(full // SLICE).tolist():
            at = full[(full >= k * SLICE) & (full < (k + 1) * SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(at - k * SLICE).astype("<u4").tobytes()], pa.binary()),
                                              pa.array([got[at].tobytes()], pa.binary())], names=["slice", "w", "b"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole = None, None
        for batch in batches:
            for k, w, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != now:
                    if whole is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["slice", "b"])
                    now, whole = k, np.zeros(SLICE, dtype=np.uint64)
                whole[np.frombuffer(w, "<u4")] |= np.frombuffer(b, np.uint64)
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["slice", "b"])

    parts = df.select(F.col(column).cast("bigint").alias("v")).filter("v IS NOT NULL").mapInArrow(words, "slice INT, w BINARY, b BINARY")
    parts = parts.repartition(max(1, (1 << (bits - 6)) // SLICE), "slice").sortWithinPartitions("slice").mapInArrow(merge, "slice INT, b BINARY")
    out = np.zeros(max(SLICE, 1 << (bits - 6)), dtype=np.uint64)
    for row in parts.collect():
        out[row.slice * SLICE:(row.slice + 1) * SLICE] = np.frombuffer(row.b, np.uint64)
    return out[:1 << (bits - 6)]


def has_bit(words: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    at = bit_places(values, bits)
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


#: nodes whose edges a task joins up before it sends them on
FOREST = 1 << 20


def local_forest(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` of the same components, a > b: what a task reads becomes stars around smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        def stars() -> pa.RecordBatch:
            found = [(x, find(x)) for x in list(root)]
            found = [(x, top) for x, top in found if x != top]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([top for _, top in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((find(a), find(b)))
                root[high] = low
            if len(root) > FOREST:
                yield stars()
        yield stars()

    return edges.select("a", "b").mapInArrow(run, "a BIGINT, b BIGINT")


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root``: the smallest node reachable over edges ``a, b`` (BIGINT).

    Each task first joins up the edges it reads. Then stars are joined in turn: every
    node hands its larger neighbours to its smallest one, then its smaller ones. Each
    turn is an aggregate with map-side combine and a join; a written table cuts the
    lineage. It ends when no node has a smaller neighbour and another one; the number
    of turns grows with the logarithm of the path length.
    """
    now = saved(local_forest(edges), name)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen, facts = saved_with(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")), name,
                                 torn=F.count_if(F.expr("low < a AND high <> low")))
        low = seen.select("a", F.least("low", "a").alias("m"))
        if not facts["torn"]:
            return low.select(F.col("a").alias("node"), F.col("m").alias("root"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        now = saved(local_forest(small), name)
