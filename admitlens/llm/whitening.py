"""Whitened embeddings from covariances that are recovered by polarisation.

Components become whole numbers. The exact sums of squares of every dimension and of the sum of every two dimensions are
aggregated over the distinct vectors, in whole numbers from centred values; the covariance of two dimensions is half of what the
variance of their sum has beyond their own variances. Only these sums, as many as there are pairs of dimensions, reach the driver,
which assembles the matrix and takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.sources.stage import release, staged


@dataclass(frozen=True)
class Whitening:
    """A component e becomes floor(scale * e) + offset. `components` bounds the components returned; `rank` is the least eigenvalue, as
    a share of the largest and per dimension, that double precision tells from nothing; `largest` bounds the size of scale * e."""

    scale: int = 64
    offset: int = 1_000_000
    components: int = 16
    rank: float = 2e-12
    largest: int = 1 << 40


_EXACT = T.DecimalType(38, 0)
_MOST = 10**38 - 1


@dataclass(frozen=True)
class Fit:
    """What the distinct vectors say: their number, sums, whole-number centres, and the components with their variances."""

    n: int
    sums: list[int]
    centres: np.ndarray
    covariance: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    @property
    def rests(self) -> list[int]:
        """Sums of what the centres leave over."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.centres)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        offset = np.array([r / self.n for r in self.rests])
        return ((x - self.centres) - offset) @ self.vectors / np.sqrt(self.values)


def whole(e: Column, p: Whitening) -> Column:
    """The whole number of a component."""
    scaled = F.floor(e.cast("double") * p.scale)
    return F.least(F.greatest(scaled, F.lit(-p.largest)), F.lit(p.largest)) + F.lit(p.offset).cast("long")


def _finite(e: Column) -> Column:
    return F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def squares(c: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of (c_i + c_j) ** 2, for i < j, and of c_i ** 2 on the diagonal (Python integers)."""
    d = c.shape[1]
    out = np.zeros((d, d), object)
    top = int(np.abs(c).max(initial=0))
    if len(c) * (2 * top) ** 2 >= 1 << 62:
        c = c.astype(object)
    for i in range(d):
        pair = c[:, i:] + c[:, i : i + 1]
        pair[:, 0] = c[:, i]
        out[i, i:] = [int(v) for v in (pair * pair).sum(axis=0)]
    return out


def _sums(d: int):
    """Per task: how many vectors, and the sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch, d)
            n += len(x)
            for at in range(0, len(x), 1 << 16):
                total = [a + int(b) for a, b in zip(total, x[at : at + (1 << 16)].sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array([-1, *range(d)], pa.int32()), "total": pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))})

    return add


def _squares(centres: np.ndarray):
    """Per task: the sums of squares of the centred dimensions and of their pairs."""
    d = len(centres)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            total += squares(_matrix(batch, d) - centres)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "total": pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))})

    return add


def polarised(n: int, rests: list[int], sums: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix (divisor n): cov(i, j) = (var(i + j) - var(i) - var(j)) / 2, rounded once from whole numbers."""
    d = len(rests)
    alone = [n * sums[i, i] - rests[i] ** 2 for i in range(d)]  # n * n times the variance
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = alone[i] / (n * n)
        for j in range(i + 1, d):
            both = n * sums[i, j] - (rests[i] + rests[j]) ** 2
            out[i, j] = out[j, i] = (both - alone[i] - alone[j]) / (2 * n * n)
    return out


def fitted(fit: DataFrame, d: int, p: Whitening = Whitening()) -> Fit:
    """Components of distinct whole-number vectors `x` of length `d`. Fewer than `components` where the vectors span less."""
    found = fit.mapInArrow(_sums(d), "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").cast(_EXACT).alias("total")).collect()
    total = {r.i: int(r.total) for r in found}
    n, sums = total[-1], [total[i] for i in range(d)]
    centres = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    pairs = fit.mapInArrow(_squares(centres), "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").cast(_EXACT).alias("total")).collect()
    rests = [s - n * int(m) for s, m in zip(sums, centres)]
    covariance = polarised(n, rests, {(r.i, r.j): int(r.total) for r in pairs})
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: p.components]
    order = order[values[order] > max(values.max() * p.rank * d, 0)]
    return Fit(n, sums, centres, covariance, vectors[:, order], values[order])


def _products(f: Fit):
    """Per task: sums of the products of whitened components."""
    d, k = len(f.sums), len(f.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = f.whitened(_matrix(batch, d))
            total += w.T @ w
        a, b = np.triu_indices(k)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "total": pa.array(total[a, b])})

    return add


def deviations(x: np.ndarray, f: Fit) -> list[int | None]:
    """Exact sums over the dimensions of (n * x - S) ** 2; None beyond 38 digits."""
    c = x - f.centres
    if (f.n * (int(np.abs(c).max(initial=0)) + 1)) ** 2 * x.shape[1] >= 1 << 62:
        c = c.astype(object)
    far = f.n * c - np.array(f.rests, c.dtype)
    return [None if v > _MOST else v for v in map(int, (far * far).sum(axis=1))]


def _rows(f: Fit, error: float):
    d, k = len(f.sums), len(f.values)
    explained = f.values / np.trace(f.covariance)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x, n = _matrix(part, d), len(part)
                which = np.repeat(np.arange(n), k)
                deviation = pa.array([None if v is None else Decimal(v) for v in deviations(x, f)], pa.decimal128(38, 0))
                columns = {
                    "vec_id": part.column("vec_id").take(pa.array(which)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    "n": pa.array(np.full(n * k, f.n)),
                    "deviation": deviation.take(pa.array(which)),
                    "whitened": pa.array(f.whitened(x).ravel()),
                    "explained": pa.array(np.tile(explained, n)),
                    "identity_error": pa.array(np.full(n * k, error)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return write


def whitened_embeddings(vectors: DataFrame, p: Whitening = Whitening(), id_: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row per usable row of `vectors` and component: vec_id, component (from 1, by falling variance), n, deviation (exact, as
    decimal(38,0), null beyond that), whitened, explained (share of the whole variance) and identity_error (one value).

    Rows whose vector is null or holds null or non-finite components are left out. Equal vectors count once for the fit and keep all
    their rows, repeated ids too. Of vectors of several lengths those of the most frequent one are taken (the longer at a tie).
    Components without variance beyond rounding can't be whitened and are left out, so equal vectors alone, like an empty
    table, give no rows. Components beyond `largest` count as that bound. Other columns are not read; a null id is an id like others.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_].dataType
    usable = vectors.select(F.col(id_).alias("vec_id"), F.col(column).alias("_v")).filter(_finite(F.col("_v")))
    rows = staged(usable.select("vec_id", F.transform("_v", lambda e: whole(e, p)).alias("x")))
    schema = T.StructType([
        T.StructField("vec_id", id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", _EXACT),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    often = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if often is None or not often.d:
        return spark.createDataFrame([], schema)
    d = often.d
    own = rows.filter(F.size("x") == d)
    fit = staged(own.select("x").distinct())
    f = fitted(fit, d, p)
    k = len(f.values)
    if not k:
        return spark.createDataFrame([], schema)
    products = fit.mapInArrow(_products(f), "a int, b int, total double").groupBy("a", "b").agg(F.sum("total").alias("total")).collect()
    error = max(abs(r.total / f.n - (r.a == r.b)) for r in products)
    release(fit)
    return own.mapInArrow(_rows(f, error), schema)
