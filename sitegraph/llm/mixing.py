"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegraph.llm.common import WORD, saved, saved_side, table

#: a source's order is cut in so many stretches, so that no task holds a whole source
STRETCHES = 1024


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("bigint")


def seeded(seed: int, key: Column) -> Column:
    """A number of 48 bits from a key, by md5, so that any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key)), 1, 12), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``target`` per source: ``share`` of all sizes by weight, ``most`` times a source's size at most.

    The excess of full sources goes to the others by weight until none is above.
    With the sources in the order of ``most * size / weight`` those that end full
    come first, so one running sum finds the level where the filling stops.
    ``sources(src, source_size)`` has a row per source.
    """
    by_name = W.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    fill = W.orderBy("ratio", F.col("src").asc_nulls_last())
    every = W.partitionBy()
    return (
        sources.withColumn("weight", weight)
        .withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("source_size").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.lit(most) * F.col("full")) / F.col("open"))
        # the level of the first source that does not reach its limit
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
        .withColumn("target", F.least(F.lit(most) * F.col("source_size"),
                                      F.coalesce(F.col("weight") * F.col("level"), F.lit(most) * F.col("source_size"))))
        .select("src", "source_size", "weight", "target")
    )


#: a source is cut into blocks of ``block`` words, a smaller one into about so many
BLOCKS = 256

#: multipliers (primes) of which one shares no factor with a number of blocks below 10**17
STEPS = (1_000_003, 999_983, 1_000_033)


def quotas(sources: DataFrame, block: int, most: float) -> DataFrame:
    """Adds each source's size of a ``block``, its ``blocks``, its ``aim`` and its ``quota``, both in blocks.

    The blocks of a source hold equal numbers of words, but for its last: ``block``
    words, or fewer in a source so small that a block would be a large part of it.
    Seats go to the highest quotients ``aim / (2 s + 1)``: all from one half up are
    served, and no others, so a source gets its aim rounded half down, ``most`` times
    its blocks at most; the house has as many seats as that makes.
    """
    words = F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"source_size div {BLOCKS}")))
    return (
        sources.withColumn("block", words.cast("bigint"))
        .withColumn("blocks", F.expr("(source_size + block - 1) div block"))
        .withColumn("aim", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0))
        .withColumn("quota", F.least(F.ceil(F.col("aim") - 0.5), F.floor(F.lit(most) * F.col("blocks"))).cast("bigint"))
    )


def shard_quotas(sources: DataFrame, n_shards: int) -> DataFrame:
    """``src, shard, blocks, upto``: each source's integer quota of every output shard, and that of all up to it.

    Seats in the order of their quotients fill the shards one after another:
    after shard j a source has what the same rule gives for j/n of its aim. The
    parts sum to the whole quota, and every shard is a proportional mix itself.
    """
    share = F.least(F.col("quota"), F.ceil(F.col("aim") * F.col("j") / F.lit(float(n_shards)) - 0.5).cast("bigint"))
    upto = sources.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(n_shards)))).withColumn(
        "upto", F.when(F.col("j") == n_shards, F.col("quota")).otherwise(F.greatest(F.lit(0), share)))
    before = F.lag("upto", 1, 0).over(W.partitionBy("src").orderBy("j"))
    return upto.select("src", (F.col("j") - 1).alias("shard"), (F.col("upto") - before).alias("blocks"), "upto")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                block: int = 16, seed: int = 6, n_shards: int = 16) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, shard`` of every row of ``docs(doc_id, text, source)``.

    Each source's rows are put in seeded order, end to end, and cut into blocks. Every
    output shard has an integer quota of blocks of each source; the quotas, shard after
    shard, are served by the blocks in seeded order, all of them once before any comes
    again. ``taken`` counts a row's words in blocks served, ``most`` (an integer) times
    its size at most; ``shard`` is where the first of its blocks goes (null: none).

    Null text and text without words have size 0 and give nothing; null source is
    a source, the last; null doc_id is a key like others. Repeated rows follow
    each other in the order and are returned as often; ties cannot matter, since
    rows that tie are equal. A source without words has target 0. An empty table
    gives no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("src"),
                       count_words(F.col("text")).alias("size"))
    # equal rows are one row with a count from here on
    rows = rows.groupBy("doc_id", "src", "size").agg(F.count("*").alias("n"))
    place = seeded(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = saved(rows.withColumn("place", place).withColumn("stretch", F.expr(f"place div {(1 << 48) // STRETCHES}").cast("int")), "mix")
    # from here to the join: a row per source and stretch, or per source and shard
    parts = rows.groupBy("src", "stretch").agg(F.sum(F.col("size") * F.col("n")).alias("part"))
    parts = parts.withColumn("part_start", F.sum("part").over(
        W.partitionBy("src").orderBy("stretch").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("part"))
    by_source = saved(quotas(targets(parts.groupBy("src").agg(F.sum("part").alias("source_size")), weights, share, most), block, most), "quotas")
    ends = shard_quotas(by_source, n_shards).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("ends"))
    by_source = by_source.alias("q").join(ends.alias("e"), F.expr("q.src <=> e.src")).select("q.*", F.expr("e.ends.upto").alias("ends"))
    parts = parts.alias("p").join(by_source.alias("s"), F.expr("p.src <=> s.src")).select(
        F.col("p.src").alias("p_src"), F.col("p.stretch").alias("p_stretch"), "part_start", "source_size", "target", "block", "blocks", "quota", "ends")
    order = W.partitionBy("src", "stretch").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
    rows = rows.join(parts, F.expr("src <=> p_src AND stretch = p_stretch"))
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
    start = F.col("part_start") + F.col("before") + (F.col("copy") - 1) * F.col("size")
    rows = rows.withColumn("start", start).withColumn("again", F.expr("IF(blocks > 0, quota % blocks, 0)"))
    # the place of a block in the seeded order is a number times a prime, modulo the number of blocks
    step = F.coalesce(*[F.when(F.col("blocks") % p != 0, p) for p in STEPS])
    rows = rows.withColumn("step", F.when(F.col("size") > 0, step).cast("bigint"))
    met = F.expr("transform(sequence(start div block, (start + size - 1) div block), b -> struct("
                 f"(b % blocks * step + {seed}) % blocks AS seat, least(start + size, (b + 1) * block) - greatest(start, b * block) AS words))")
    rows = rows.withColumn("met", F.when(F.col("size") > 0, met))
    taken = F.expr("IF(size > 0, quota div blocks * size + aggregate(met, 0L, (s, m) -> s + IF(m.seat < again, m.words, 0L)), 0L)")
    first = F.expr("array_min(met.seat)")
    shard = F.when((F.col("quota") >= F.col("blocks")) | (first < F.col("again")), F.size(F.filter("ends", lambda u: u <= first)))
    return rows.select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", taken.alias("taken"), shard.alias("shard"))


def mixed(docs: DataFrame, block: int = 16, seed: int = 6) -> DataFrame:
    """``docs`` as often as the mix takes them.

    A row comes once per whole round of its words; what is taken beyond that
    brings one more copy with the chance of its share, by a seeded number, so
    that sources keep near their targets. Rows that repeat an id, source and size
    share their copies evenly. Rows without words are not taken.
    """
    some = mix_sources(docs, block=block, seed=seed).filter("size > 0")
    chance = seeded(seed + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) / F.lit(float(1 << 48))
    copies = F.expr("taken div size") + F.when(chance < F.expr("taken % size") / F.col("size"), 1).otherwise(0)
    keys = some.groupBy("doc_id", "source", "size").agg(F.sum(copies).alias("c"), F.count("*").alias("m")).filter("c > 0")
    keys = saved_side(keys.select(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("size").alias("k_size"), "c", "m"), "copies")
    rows = docs.select(F.struct(*docs.columns).alias("d"), count_words(F.col("text")).alias("s"))
    met = rows.join(keys, F.expr("d.doc_id <=> k_id AND d.source <=> k_source AND s = k_size"))
    each = F.expr("c div m") + F.when(F.expr("pmod(xxhash64(d.text), m) < c % m"), 1).otherwise(0)
    return met.withColumn("each", each).filter("each > 0").select("d", F.explode(F.expr("sequence(1L, each)"))).select("d.*")


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents: weights 5, 2, 1 by source, 150 % of all words."""
    out = mix_sources(table(spark, sf, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "shard")


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('6-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS place
  FROM documents),
sized AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM rows GROUP BY src),
levels AS (
  SELECT *, 2.0 * source_size / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sized WINDOW f AS (ORDER BY 2.0 * source_size / weight, src NULLS LAST)),
aimed AS (
  SELECT *, least(2.0::DOUBLE * source_size, coalesce(weight * (SELECT level FROM levels WHERE ratio > level ORDER BY ratio LIMIT 1), 2.0::DOUBLE * source_size)) AS target
  FROM levels),
cut AS (
  SELECT *, greatest(1, least(16, source_size // 256)) AS block FROM aimed),
counted AS (
  SELECT *, (source_size + block - 1) // block AS blocks FROM cut),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size * blocks ELSE 0 END AS aim FROM counted),
seats AS (
  SELECT *, least(CAST(ceil(aim - 0.5) AS BIGINT), 2 * blocks) AS quota,
    CASE WHEN blocks % 1000003 <> 0 THEN 1000003 WHEN blocks % 999983 <> 0 THEN 999983 ELSE 1000033 END AS step FROM shares),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM rows),
met AS (
  SELECT *, CASE WHEN size > 0 THEN list_transform(range(start // block, (start + size - 1) // block + 1),
    lambda b: {'seat': (b % blocks * step + 6) % blocks, 'words': least(start + size, (b + 1) * block) - greatest(start, b * block)}) ELSE [] END AS m
  FROM placed p JOIN seats s ON p.src IS NOT DISTINCT FROM s.src),
firsts AS (
  SELECT *, list_min(list_transform(m, lambda x: x.seat)) AS seat FROM met)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
  CAST(CASE WHEN size > 0 THEN quota // blocks * size
    + coalesce(list_sum(list_transform(m, lambda x: CASE WHEN x.seat < quota % blocks THEN x.words ELSE 0 END)), 0) ELSE 0 END AS BIGINT) AS taken,
  CASE WHEN size > 0 AND (quota >= blocks OR seat < quota % blocks) THEN len(list_filter(range(1, 17),
    lambda j: seat >= CASE j WHEN 16 THEN quota ELSE greatest(0, least(quota, CAST(ceil(aim * j / 16.0::DOUBLE - 0.5) AS BIGINT))) END)) END AS shard
FROM firsts
"""
