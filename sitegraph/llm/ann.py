"""Nearest neighbours by multiprobe p-stable hashing.

Each table cuts space by ``hashes`` random directions into cells of a width. A
query visits its own cell and cells beside it, in the order of how near its
projections lie to the borders that must be crossed, which is the order of the
estimated chance to hold a neighbour. What the visited cells of all tables hold
is merged, and each vector found is compared once, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegraph.llm.common import saved, table
from sitegraph.llm.words import mix

#: vectors, and queries, that meet in one task: about so many at most
BLOCK = 8192
ASKED = 32768

#: stretches of the first direction by which vectors are laid out, at most; fuller ones are dealt out by hash
STRETCHES = 4096


@dataclass(frozen=True)
class Hashing:
    """Tables, directions and cell width for vectors scaled into the unit ball."""

    tables: int = 6
    hashes: int = 6
    width: float = 2.5
    probes: int = 24
    seed: int = 8

    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return (rng.standard_normal((self.tables, dim + 1, self.hashes)), rng.random((self.tables, self.hashes)) * self.width)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Tables x vectors x hashes, in cell widths."""
        a, b = self.directions(x.shape[1] - 1)
        return (np.einsum("nd,tdh->tnh", x, a, optimize=True) + b[:, None, :]) / self.width

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """One number per cell (last axis), each table's apart from the others'."""
        out = np.zeros(cells.shape[:-1], dtype=np.uint64) + np.arange(self.tables, dtype=np.uint64).reshape(-1, *[1] * (cells.ndim - 2))
        for k in range(cells.shape[-1]):
            out = mix(out + cells[..., k].astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def home(self, x: np.ndarray) -> np.ndarray:
        """Tables x vectors: the bucket of each vector."""
        return self.buckets(np.floor(self.places(x)))

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Tables x vectors x probes: the buckets to visit, likeliest first."""
        place = self.places(x)
        home = np.floor(place)
        left = place - home
        # every way to stay or cross a border of up to all directions; the cost is the squared way to it
        steps = np.array(list(product((-1, 0, 1), repeat=self.hashes)))
        cost = (left**2) @ (steps == -1).T + ((1 - left) ** 2) @ (steps == 1).T
        best = np.argpartition(cost, min(self.probes, len(steps)) - 1, axis=-1)[..., :self.probes]
        return self.buckets(home[..., None, :] + steps[best])


def unit_ball(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with one more component, so that the nearest point is the one of largest inner product."""
    if query:
        return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], axis=1)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part: finite, not zero, of the commonest length."""
    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", number) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").head()
    return rows.filter(F.size("v") == (size.n if size else 0)).withColumn("v", F.col("v").cast("array<float>" if "float" in kind else "array<double>"))


class Layout:
    """Blocks of at most about ``size`` rows that lie near each other: stretches of equal numbers of
    rows along the first direction (column ``along``), the fuller ones dealt out by column ``deal``."""

    def __init__(self, rows: DataFrame, size: int) -> None:
        n = min(STRETCHES, max(1, -(-rows.count() // size)))
        cuts = rows.agg(F.percentile_approx("along", [k / n for k in range(1, n)], 10 * n)).head()[0] if n > 1 else []
        self.cuts = np.unique(np.array(cuts, dtype=np.float64))
        at = self.stretch(F.col("along"))
        counts = {r.at: r.n for r in rows.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect()}
        self.parts = np.array([-(-counts.get(k, 1) // size) for k in range(len(self.cuts) + 1)], dtype=np.int64)
        self.first = np.cumsum(self.parts) - self.parts
        self.total = int(self.parts.sum())

    def stretch(self, along: F.Column) -> F.Column:
        cuts = self.cuts

        @F.arrow_udf("int")
        def find(x: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(cuts, x.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

        return find(along)

    def blocks(self, along: np.ndarray, deal: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cuts, along, side="right")
        return self.first[at] + deal.astype(np.int64) % self.parts[at]


def nearest(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, how: Hashing | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for each query row.

    ``queries`` picks the rows of ``vectors(vec_id, embedding)`` to search for, in
    all rows but the query's own id. Scores are inner products of the vectors in
    double precision; ties go to the smaller vec_id.

    Vectors that are null, zero, not finite or of another length than the
    commonest take no part, nor do rows without vec_id. Of repeated rows a query
    is searched once and a vec_id named once, with its largest score. Where a
    query's cells hold fewer than ``k`` it is compared with every vector. An
    empty table gives no rows. Other columns are not looked at.

    All rows are indexed. Vectors and queries are laid out in blocks. A join of cells
    and block numbers, without vectors, tells which blocks meet: those of which one
    holds a cell that a query of the other visits. Each block goes once to every block
    it meets, and there the candidates of all tables are one set before they are compared.
    """
    how = how or Hashing()
    found = usable(vectors)
    element = "FLOAT" if "float" in dict(found.dtypes)["v"] else "DOUBLE"
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    first = found.agg(F.max(F.size("v")).alias("dim"), F.sqrt(F.max(norm)).alias("longest")).head()
    if first.dim is None:
        return found.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim, longest = first.dim, first.longest

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for part in (batch.slice(n, 1024) for n in range(0, batch.num_rows, 1024)):
                ids, v = part.column(0), part.column(1)
                along = how.places(unit_ball(_matrix(v, dim).astype(np.float64), longest, False))[0, :, 0]
                # written once: repeated rows are dealt apart by where they were read
                deal = mix(ids.to_numpy().view(np.uint64) + np.arange(at, at + len(ids), dtype=np.uint64)) >> np.uint64(33)
                at += len(ids)
                yield pa.RecordBatch.from_arrays([ids, v, pa.array(along), pa.array(deal.astype(np.int64))], ["vec_id", "v", "along", "deal"])

    rows = saved(found.mapInArrow(lay, f"vec_id BIGINT, v ARRAY<{element}>, along DOUBLE, deal BIGINT"), "vectors")
    asked = rows.filter(queries)
    p, q = Layout(rows, BLOCK), Layout(asked, ASKED)

    def placed(df: DataFrame, layout: Layout, name: str) -> DataFrame:
        @F.arrow_udf("bigint")
        def block(along: pa.Array, deal: pa.Array) -> pa.Array:
            return pa.array(layout.blocks(along.to_numpy(zero_copy_only=False), deal.to_numpy(zero_copy_only=False)))

        return df.select(F.col("vec_id").alias("id"), "v", block("along", "deal").alias(name))

    points, seekers = placed(rows, p, "p"), placed(asked, q, "q")

    def cells(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(n, 1024) for n in range(0, batch.num_rows, 1024)):
                    x = unit_ball(_matrix(part.column(1), dim).astype(np.float64), longest, query)
                    got = how.visits(x) if query else how.home(x)[:, :, None]
                    block = np.broadcast_to(part.column(2).to_numpy()[None, :, None], got.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(got.reshape(-1)), pa.array(block.reshape(-1))], ["cell", "block"])
        return run

    held = points.mapInArrow(cells(False), "cell BIGINT, block BIGINT").select("cell", F.col("block").alias("p")).distinct()
    visited = seekers.mapInArrow(cells(True), "cell BIGINT, block BIGINT").select("cell", F.col("block").alias("q")).distinct()
    meet = saved(held.join(visited, "cell").select("p", "q").distinct(), "meet")
    scored = saved(_scores(seekers.join(meet, "q"), points.join(meet, "p"), dim, k, how, longest), "scored")
    found = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # fewer than k found: all vectors are fewer, or the cells were thin
    thin = asked.select("vec_id").distinct().join(
        found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("c")), "vec_id", "left").filter(f"coalesce(c, 0) < {k}")
    rest = saved(asked.join(thin.select("vec_id"), "vec_id", "left_semi").select("vec_id", "v", "along", "deal"), "thin")
    if rest.head() is not None:
        again = Layout(rest, ASKED)
        few = placed(rest, again, "q").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(p.total - 1))))
        every = points.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(again.total - 1))))
        more = _scores(few, every, dim, k)
        found = found.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Cells:
    """The points of a block by the cells of every table, to be asked for candidates."""

    def __init__(self, how: Hashing, longest: float, points: np.ndarray) -> None:
        self.how, self.longest, self.n = how, longest, len(points)
        home = how.home(unit_ball(points, longest, False))
        self.order = np.argsort(home, axis=1, kind="stable")
        self.held = np.take_along_axis(home, self.order, axis=1)

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Queries x points: whether a cell that the query visits in any table holds the point."""
        out = np.zeros((len(queries), self.n), dtype=bool)
        visits = self.how.visits(unit_ball(queries, self.longest, True))
        who = np.repeat(np.arange(len(queries)), visits.shape[2])
        for table_visits, held, order in zip(visits, self.held, self.order, strict=True):
            wanted = table_visits.reshape(-1)
            low = np.searchsorted(held, wanted)
            size = np.searchsorted(held, wanted, side="right") - low
            at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            out[np.repeat(who, size), order[at]] = True
        return out


def _top(qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, k: int, cells: Cells | None = None) -> pa.Table:
    """The ``k`` best of the points (with ``cells``: of the candidates) for each query, some queries at a time.

    A product of matrices finds all points that may be among them, up to twice
    the rounding of a sum of so many terms; their own scores then decide, and the id.
    """
    out = [[], [], []]
    p = p.astype(np.float64)
    length = np.linalg.norm(p, axis=1)
    for at in range(0, len(qid), 256):
        ids, part = qid[at:at + 256], q[at:at + 256].astype(np.float64)
        s = part @ p.T
        slack = 2 * p.shape[1] * (np.finfo(np.float64).eps * np.linalg.norm(part, axis=1)[:, None] * length[None, :] + 5e-324)
        s[ids[:, None] == pid[None, :]] = -np.inf
        if cells is not None:
            s[~cells.candidates(part)] = -np.inf
        m = min(k, len(pid))
        least = -np.partition(slack - s, m - 1, axis=1)[:, m - 1:m]
        i, j = np.nonzero((s + slack >= least) & (s > -np.inf))
        score = np.zeros(len(i))
        for few in (slice(n, n + 65536) for n in range(0, len(i), 65536)):
            score[few] = np.einsum("nd,nd->n", part[i[few]], p[j[few]])
        # a repeated id with its largest score, then the best of each query
        order = np.lexsort((-score, pid[j], i))
        i, j, score = i[order], j[order], score[order]
        new = np.ones(len(i), dtype=bool)
        new[1:] = (i[1:] != i[:-1]) | (pid[j[1:]] != pid[j[:-1]])
        i, j, score = i[new], j[new], score[new]
        order = np.lexsort((pid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < m
        out[0].append(ids[i[best]])
        out[1].append(pid[j[best]])
        out[2].append(score[best])
    return pa.table([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])


_FOUND = "query_id BIGINT, vec_id BIGINT, score DOUBLE"


def _scores(seekers: DataFrame, points: DataFrame, dim: int, k: int, how: Hashing | None = None, longest: float = 1.0) -> DataFrame:
    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        if not q.num_rows or not p.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        q, p = q.combine_chunks(), p.combine_chunks()
        ids = [t.column("id").to_numpy() for t in (q, p)]
        v = [_matrix(t.column("v").combine_chunks(), dim) for t in (q, p)]
        return _top(ids[0], v[0], ids[1], v[1], k, how and Cells(how, longest, v[1].astype(np.float64)))

    # both sides come from one table: columns of their own keep them apart
    sides = [side.select(*[F.col(c).alias(c) for c in ("id", "v", "p", "q")]).groupBy("p", "q") for side in (seekers, points)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, _FOUND)


def op8_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings; every twentieth id is a query."""
    return nearest(table(spark, sf, "embeddings"))
