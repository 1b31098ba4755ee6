"""Which points lie in which intervals, page by page, without pairing them all.

The number line of a page is tiled in blocks of 1, 16, 256 and 4096. An interval
is covered by few such tiles, a point lies in exactly one tile per size, so an
equi-join on ``(page, size, tile)`` meets each true pair once and no others. Work
follows the result size, and the tiles of one large page spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFTS = (0, 4, 8, 12)


def _tile(shift: int, block: Column) -> Column:
    return F.struct(F.lit(shift).alias("shift"), block.cast("bigint").alias("block"))


def point_tiles(p: Column) -> Column:
    return F.array(*[_tile(s, F.shiftright(p.cast("bigint"), s)) for s in SHIFTS])


def cover_tiles(lo: Column, hi: Column) -> Column:
    """The tiles that exactly cover ``lo..hi`` (both inclusive)."""
    lo, hi = lo.cast("bigint"), hi.cast("bigint")

    def first(s: int) -> Column:
        return F.shiftright(lo + ((1 << s) - 1), s)

    def last(s: int) -> Column:
        return F.shiftright(hi + 1, s) - 1

    def run(s: int, a: Column, b: Column) -> Column:
        blocks = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(blocks, lambda x: _tile(s, x))

    parts = []
    for s, wider in zip(SHIFTS, SHIFTS[1:] + (None,)):
        if wider is None:
            parts.append(run(s, first(s), last(s)))
            continue
        step = wider - s
        inner_lo = F.shiftleft(first(wider), step)
        inner_hi = F.shiftleft(last(wider) + 1, step) - 1
        split = first(wider) <= last(wider)
        left = F.when(split, F.least(inner_lo - 1, last(s))).otherwise(last(s))
        parts.append(run(s, first(s), left))
        parts.append(F.when(split, run(s, inner_hi + 1, last(s))).otherwise(run(s, F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))))
    return F.concat(*parts)


def stab_join(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str,
              on: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """All (point row, interval row) pairs with ``lo <= point <= hi`` on equal ``on``."""
    p = points.withColumn("_t", F.explode(point_tiles(F.col(point))))
    i = intervals.withColumn("_t", F.explode(cover_tiles(F.col(lo), F.col(hi))))
    p = p.withColumns({"_shift": F.col("_t.shift"), "_block": F.col("_t.block")}).drop("_t")
    i = i.withColumns({"_shift": F.col("_t.shift"), "_block": F.col("_t.block")}).drop("_t")
    return p.join(i, [*on, "_shift", "_block"]).drop("_shift", "_block")
