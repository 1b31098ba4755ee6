"""Whitening of embeddings on the leading eigenvectors of their covariance, found by spectrum slicing.

Sums over all vectors are exact: entries are integers, products are taken of vectors
centred on the integers next below their means, and what is left of the means comes off
in exact fractions. So any split of the table gives the same covariance, bit for bit.
On the driver stands only that matrix, whose size is the vectors' width. The number of
eigenvalues above a shift is the number of positive pivots of the LDL' factors of the
shifted matrix; bisection on that count isolates each leading eigenvalue, Rayleigh
quotient iteration refines it, and counts on both sides certify its number.

Cases: vectors that are null, empty, or hold null or non-finite entries take no part,
nor those of another length than the commonest (of several, the longest), nor those with
an entry that scaled does not fit a long. Fewer dimensions than components give fewer
components. Where an eigenvalue is zero (fewer vectors than dimensions, all alike), its
component has a null ``whitened`` and no part in ``identity_error``. A deviation beyond a
long is null. Equal eigenvalues: any orthonormal vectors of their space. Repeated rows
count as often as they come; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import table

COMPONENTS = 32

#: x = floor(SCALE * c) + OFFSET
SCALE, OFFSET = 64, 1_000_000

#: vectors handled at once inside a task
CHUNK = 2048

#: integers leave a task in signed limbs of so many bits, which Spark sums as longs
LIMB = 32

EPS = float(np.finfo(np.float64).eps)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """``vec_id`` and ``v`` (ARRAY<DOUBLE>) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    good = vectors.select("vec_id", v.alias("v")).filter(F.size("v") > 0).filter(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 55))))
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return good.filter(F.size("v") == (lengths.d if lengths else 0))


def integers(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row where a chunk starts, and its x less OFFSET: int64, a row per vector."""
    values = batch.column(batch.schema.get_field_index("v"))
    for start in range(0, len(values), CHUNK):
        part = values.slice(start, CHUNK)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        yield start, np.floor(SCALE * flat).astype(np.int64).reshape(len(part), -1)


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of integers without rounding: in doubles while all sums stay below 2**53."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    return y.astype(object).T @ y.astype(object)


def limbs(values: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Signed limbs, lowest first, of integers of any size: sum of limb * 2**(LIMB * k)."""
    values = values.ravel()
    if values.dtype != object:
        sign, size = np.sign(values), np.abs(values)
    else:
        size = np.array([abs(int(v)) for v in values], dtype=object)
        sign = np.array([(int(v) > 0) - (int(v) < 0) for v in values], dtype=np.int64)
    k = 0
    while k == 0 or (size != 0).any():
        yield k, (sign * (size & ((1 << LIMB) - 1))).astype(np.int64).tolist()
        size, k = size >> LIMB, k + 1


def exact_sums(vectors: DataFrame, centre: list[int] | None) -> tuple[int, list[int]]:
    """Number of vectors, and exact sums over all: of y, or of the products of y - centre.

    Each task sends its sums in limbs; Spark adds them up by position.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for _, y in integers(batch):
                got = y.astype(object).sum(axis=0) if centre is None else exact_products(y - np.array(centre, dtype=np.int64))
                got = got.astype(object)
                n, total = n + len(y), got if total is None else total + got
        if total is None:
            return
        for k, part in limbs(total):
            at = np.arange(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([k] * len(part), pa.int32()), pa.array(part, pa.int64())], names=["at", "limb", "v"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([0], pa.int32()), pa.array([n], pa.int64())], names=["at", "limb", "v"])

    n, sums = 0, {}
    for row in vectors.mapInArrow(add, "at BIGINT, limb INT, v BIGINT").groupBy("at", "limb").agg(F.sum("v").alias("v")).collect():
        if row.at < 0:
            n = row.v
        else:
            sums[row.at] = sums.get(row.at, 0) + (row.v << (LIMB * row.limb))
    return n, [sums[k] for k in range(len(sums))]


def covariance(n: int, sums: list[int], centre: list[int], products: list[int]) -> np.ndarray:
    """Covariance with divisor n from products of y - centre, each entry rounded once."""
    d = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    out = np.empty((d, d))
    for i in range(d):
        for j in range(d):
            out[i, j] = float(Fraction(n * products[i * d + j] - rest[i] * rest[j], n * n))
    return out


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of the LDL' factors.

    Bunch and Kaufman's pivoting: where a diagonal entry is small against its column, a
    larger one or a block of two takes its place; a block has a pivot of either sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    tiny = EPS * EPS * max(1e-300, float(np.abs(a).max(initial=0)))
    alpha, above, k, d = (1 + 17 ** 0.5) / 8, 0, 0, len(a)

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j], k:] = a[[j, i], k:]
            a[k:, [i, j]] = a[k:, [j, i]]

    while k < d:
        step = 1
        if k < d - 1:
            column = np.abs(a[k + 1:, k])
            r = int(column.argmax())
            most, r = float(column[r]), r + k + 1
            if abs(a[k, k]) < alpha * most:
                other = np.abs(a[k:, r])
                other[r - k] = 0
                second = float(other.max())
                if abs(a[k, k]) * second >= alpha * most * most:
                    pass
                elif abs(a[r, r]) >= alpha * second:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    step = 2
        if step == 1:
            pivot = a[k, k]
            if abs(pivot) <= tiny:
                pivot = -tiny  # the shift is an eigenvalue: not above it
            above += bool(pivot > 0)
            if k < d - 1:
                low = a[k + 1:, k] / pivot
                a[k + 1:, k + 1:] -= np.outer(low, a[k + 1:, k])
        else:
            block = a[k:k + 2, k:k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[0, 1]
            above += 1 if det < 0 else 2 * bool(block[0, 0] + block[1, 1] > 0)
            if k < d - 2:
                low = a[k + 2:, k:k + 2]
                inverse = np.array([[block[1, 1], -block[0, 1]], [-block[0, 1], block[0, 0]]]) / det
                a[k + 2:, k + 2:] -= low @ inverse @ low.T
        k += step
    return above


def rayleigh(matrix: np.ndarray, start: np.ndarray, shift: float, held: np.ndarray) -> tuple[float, np.ndarray]:
    """An eigenvalue near ``shift`` and its vector, at right angles to the columns of ``held``.

    One step of inverse iteration with the shift, then Rayleigh quotients as shifts.
    """
    size, eye = float(np.abs(matrix).sum(axis=1).max()), np.eye(len(matrix))
    v, best = start, None
    for turn in range(12):
        at = shift if turn < 2 else float(v @ matrix @ v)
        try:
            w = np.linalg.solve(matrix - at * eye, v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(matrix - (at + 4 * EPS * size) * eye, v)
        for _ in range(2):
            w = w - held @ (held.T @ w)
        length = float(np.linalg.norm(w))
        if not np.isfinite(length) or not length:
            break
        v = w / length
        value = float(v @ matrix @ v)
        error = float(np.linalg.norm(matrix @ v - value * v))
        if best is None or error < best[0]:
            best = error, value, v
        elif turn > 3:
            break
    return best[1], best[2]


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns.

    Counts cut the spectrum until an interval holds one eigenvalue, or is as narrow as
    rounding (then all it holds count as equal). A refined value must lie in its
    interval, and the counts next to it must be its number less one and its number;
    else the interval is cut further.
    """
    d = len(matrix)
    k = min(k, d)
    size = float(np.abs(matrix).sum(axis=1).max(initial=0))
    if not size:
        return np.zeros(k), np.eye(d)[:, :k]
    matrix = matrix / size
    known = {-1.01: d, 1.01: 0}
    values, vectors = np.empty(k), np.empty((d, k))
    random, narrow = np.random.default_rng(d), 16 * d * EPS

    def count(at: float) -> int:
        if at not in known:
            known[at] = count_above(matrix, at)
        return known[at]

    def interval(number: int) -> tuple[float, float]:
        return max(s for s, c in known.items() if c >= number), min(s for s, c in known.items() if c < number)

    for j in range(k):
        number = j + 1
        while True:
            low, high = interval(number)
            alone = known[low] == number and known[high] == j
            if not alone and high - low > narrow:
                count((low + high) / 2)
                continue
            # vectors of the same narrow interval, and of neighbours, stay out of the iteration
            held = vectors[:, :j][:, np.abs(values[:j] - (low + high) / 2) <= max(1e-3, high - low)]
            start = random.standard_normal(d)
            value, vector = rayleigh(matrix, start / np.linalg.norm(start), (low + high) / 2, held)
            if high - low <= narrow:
                break
            if low < value <= high and count(value + narrow) < number <= count(value - narrow):
                break
            count((low + high) / 2)
        values[j], vectors[:, j] = value, vector
    # one sweep at right angles takes off what rounding left between neighbours
    for j in range(k):
        vectors[:, j] -= vectors[:, :j] @ (vectors[:, :j].T @ vectors[:, j])
        vectors[:, j] /= np.linalg.norm(vectors[:, j])
    return values * size, vectors


class Whitener:
    """What turns integer vectors into whitened ones; its size is the vectors' width."""

    def __init__(self, n: int, sums: list[int], centre: list[int], matrix: np.ndarray, k: int):
        self.n, self.centre = n, np.array(centre, dtype=np.int64)
        self.rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
        values, self.vectors = leading(matrix, k)
        trace = float(np.trace(matrix))
        self.full = values > len(matrix) * EPS * trace
        self.explained = np.where(self.full, values / trace if trace else 0.0, 0.0)
        self.scale = np.where(self.full, 1 / np.sqrt(np.where(self.full, values, 1.0)), np.nan)

    def centred(self, y: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """x less its mean as doubles, and exact deviations (None beyond a long)."""
        y = y - self.centre
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * y.shape[1] < 1 << 63:
            whole = self.n * y - np.array(self.rest, dtype=np.int64)
            return whole / self.n, (whole * whole).sum(axis=1).tolist()
        whole = self.n * y.astype(object) - np.array(self.rest, dtype=object)
        sums = (whole * whole).sum(axis=1).tolist()
        return (whole / self.n).astype(np.float64), [s if s < 1 << 63 else None for s in sums]

    def whiten(self, z: np.ndarray) -> np.ndarray:
        return (z @ self.vectors) * self.scale


def identity_error(vectors: DataFrame, whitener: Whitener) -> float | None:
    """Largest entry of the covariance of all whitened vectors less the identity.

    Tasks send count, mean and products centred on that mean; they are joined pair by pair.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for _, y in integers(batch):
                w = whitener.whiten(whitener.centred(y)[0])[:, whitener.full]
                mean = w.mean(axis=0)
                state = joined(state, (len(w), mean, (w - mean).T @ (w - mean)))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int64()), pa.array([state[1].tolist()], pa.list_(pa.float64())), pa.array([state[2].ravel().tolist()], pa.list_(pa.float64()))], names=["n", "mean", "m"])

    state = None
    for row in vectors.mapInArrow(gather, "n BIGINT, mean ARRAY<DOUBLE>, m ARRAY<DOUBLE>").toLocalIterator():
        mean = np.array(row.mean)
        state = joined(state, (row.n, mean, np.array(row.m).reshape(len(mean), len(mean))))
    if state is None or not whitener.full.any():
        return None
    return float(np.abs(state[2] / state[0] - np.eye(len(state[1]))).max())


def joined(a: tuple | None, b: tuple) -> tuple:
    """Count, mean and centred products of two sets together."""
    if a is None:
        return b
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


SHAPE = "component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"


def whiten(vectors: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each of the first k components."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["vec_id"]
    good = usable(vectors, column)
    n, sums = exact_sums(good, None)
    if not n:
        return spark.createDataFrame([], f"vec_id {kind}, {SHAPE}")
    centre = [floor(Fraction(s, n)) for s in sums]
    _, products = exact_sums(good, centre)
    whitener = Whitener(n, sums, centre, covariance(n, sums, centre, products), k)
    error = identity_error(good, whitener)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, y in integers(batch):
                z, deviation = whitener.centred(y)
                w = whitener.whiten(z)
                m, wide = w.shape
                flat = w.ravel()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(np.arange(start, start + m), wide))),
                    pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), m)), pa.array(np.full(m * wide, n, dtype=np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), wide))),
                    pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(whitener.explained, m)),
                    pa.array([error] * (m * wide), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(rows, f"vec_id {kind}, {SHAPE}")


def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings on the 32 leading components of their covariance."""
    return whiten(table(spark, sf, "embeddings"))
