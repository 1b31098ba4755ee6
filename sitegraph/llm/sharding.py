"""Sharding: a hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegraph.llm.common import crc32_text, saved, table


def ring_place(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16)


def ring(n_shards: int, virtual: int) -> list[tuple[int, int]]:
    """``place, shard`` of every virtual node, clockwise."""
    return sorted((ring_place(f"shard-{s}-{v}"), s) for s in range(n_shards) for v in range(virtual))


def capacities(total: int, n_shards: int) -> list[int]:
    """How many rows each shard may hold: the whole, as even as integers allow."""
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def fill(nodes: list[tuple[int, int]], rows: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each arc go: ``arc, from_rank, to_rank, shard, first_slot``.

    ``rows`` counts the rows of each arc (the stretch of the ring that ends at a
    virtual node). First every arc fills its own shard as far as there is room;
    what is left over goes on clockwise, one virtual node per turn, until a shard
    takes it. Counts are moved, no rows: the work is that of the virtual nodes.
    """
    taken = [0] * len(room)
    out = []
    waiting = [(arc, arc, 0, n) for arc, n in sorted(rows.items()) if n]
    while waiting:
        left = []
        for arc, at, first, last in waiting:
            shard = nodes[at][1]
            n = min(last - first, room[shard] - taken[shard])
            if n:
                out.append((arc, first, first + n, shard, taken[shard]))
                taken[shard] += n
            if first + n < last:
                left.append((arc, (at + 1) % len(nodes), first + n, last))
        waiting = left
    return out


def shard_rows(docs: DataFrame, n_shards: int = 24, virtual: int = 64) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs(doc_id, text)``.

    A row's place on the ring is a hash of its doc_id; its virtual node is the
    next one clockwise. Every shard has room for its even share of the rows, so
    counts differ by one at most; a full shard's rows go on clockwise and others
    stay, so a new shard moves few rows. Slots count from 0 in each shard
    without gaps. Only counts per virtual node (``n_shards * virtual``, whatever
    the input) come to the driver.

    Size: UTF-8 bytes of the text plus 8. A null text has size 8 and null crc; a
    null doc_id has a place like any other key; repeated rows are counted, placed
    side by side and returned as often. An empty table gives no rows. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    nodes = ring(n_shards, virtual)
    keys = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        crc32_text(F.col("text")).alias("text_crc32"))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("bigint")
    # equal rows are one row with a count from here on: a hot key is one row
    keys = keys.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("place", place)
    places = np.array([p for p, _ in nodes])

    @F.pandas_udf("int")
    def arc(place: pd.Series) -> pd.Series:
        # rows beyond the last virtual node belong to the first one
        return pd.Series(np.searchsorted(places, place.to_numpy()) % len(places))

    keys = saved(keys.withColumn("arc", arc("place")), "ring")
    counts = {r.arc: r.n for r in keys.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    plan = fill(nodes, counts, capacities(sum(counts.values()), n_shards))
    by_arc = defaultdict(list)
    for arc_no, first, last, shard, slot in plan:
        by_arc[arc_no].append((first, last, shard, slot))
    parts = spark.createDataFrame(
        [(a, x) for a, x in by_arc.items()],
        "arc INT, parts ARRAY<STRUCT<first: BIGINT, last: BIGINT, shard: INT, slot: BIGINT>>")
    order = W.partitionBy("arc").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    ranked = keys.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    # parts: at most a few rows per virtual node
    placed = ranked.join(F.broadcast(parts), "arc").withColumn("rank", F.explode(F.expr("sequence(before, before + n - 1)")))
    part = F.filter("parts", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["last"]))[0]
    return placed.withColumn("part", part).select(
        "doc_id", "size", "text_crc32", F.col("part.shard").alias("shard"),
        (F.col("part.slot") + F.col("rank") - F.col("part.first")).alias("slot"))


def op4_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents into shards 0 to 23 under the law ``rows``."""
    out = shard_rows(table(spark, sf, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
