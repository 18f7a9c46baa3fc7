"""Embedding whitening from an exact covariance: integer matrix products over digit slices, merged as big integers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: An entry c becomes floor(SCALE * c) + OFFSET (fixed values of the integer form); beyond LARGEST either way it stops there.
SCALE, OFFSET, LARGEST = 1024, 100_000, 1 << 62
#: Bits of a digit, digits of a 64-bit integer, and rows multiplied at once: a sum of products stays below 2^(32 + 13), which float64 holds.
BITS, DIGITS, BLOCK_ROWS = 16, 4, 1 << 13
#: Blocks whose digit products are added up as 64-bit integers before they become big ones.
BLOCKS = 1 << 12
#: 32-bit parts in which a sum travels; the last has the sign.
PARTS = 6
PART_COLUMNS = tuple(f"p{k}" for k in range(PARTS))


def integers(c: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET of finite float64 entries."""
    low = np.floor(np.clip(c, -1e300, 1e300) * SCALE)
    inside = np.abs(low) < LARGEST
    return np.where(inside, np.where(inside, low, 0).astype(np.int64) + OFFSET, np.where(low > 0, LARGEST, -LARGEST))


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each length among the usable vectors: not null, not empty, all entries finite."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        values = flat[begin[rows][:, None] + np.arange(size)]
        usable = np.isfinite(values).all(axis=1)
        if usable.any():
            yield rows[usable], values[usable]


class Gram:
    """The exact product of [1 | x] with itself, over all rows added.

    Each integer is cut into DIGITS digits of BITS bits, the highest with the sign. The float64 products of two digit matrices
    are exact; those of equal weight are summed as 64-bit integers and from time to time moved into big integers.
    """

    def __init__(self, size: int) -> None:
        self.total = np.zeros((size + 1, size + 1), object)
        self.weights = np.zeros((2 * DIGITS - 1, size + 1, size + 1), np.int64)
        self.blocks = 0

    def add(self, x: np.ndarray) -> None:
        for a in range(0, len(x), BLOCK_ROWS):
            block = np.concatenate([np.ones((len(x[a : a + BLOCK_ROWS]), 1), np.int64), x[a : a + BLOCK_ROWS]], axis=1)
            digits = [(block >> BITS * k) & ((1 << BITS) - 1) if k < DIGITS - 1 else block >> BITS * k for k in range(DIGITS)]
            used = {k: d.astype(np.float64) for k, d in enumerate(digits) if d.any()}
            for i, p in used.items():
                for j, q in used.items():
                    self.weights[i + j] += (p.T @ q).astype(np.int64)
            self.blocks += 1
            if self.blocks == BLOCKS:
                self.carry()

    def carry(self) -> None:
        for k, w in enumerate(self.weights):
            if w.any():
                self.total += w.astype(object) * (1 << BITS * k)
        self.weights[:] = 0
        self.blocks = 0

    def entries(self) -> Iterator[tuple[int, int, int]]:
        self.carry()
        for i in range(len(self.total)):
            for j in range(i, len(self.total)):
                yield i, j, int(self.total[i, j])


def sums(df: DataFrame, column: str = "embedding") -> DataFrame:
    """size, i, j and the 32-bit parts of the sum of products of entries i and j (0: the constant 1) over all usable vectors of
    that size. A task sends at most one row for each pair of entries; Spark adds them up part by part, before and after the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, Gram] = {}
        for batch in slices(batches):
            for _, values in vectors(batch.column(0)):
                size = values.shape[1]
                grams.setdefault(size, Gram(size)).add(integers(values))
        for size, gram in grams.items():
            rows = list(gram.entries())
            cols = [pa.array([size] * len(rows), pa.int32()), *(pa.array([r[k] for r in rows], pa.int32()) for k in range(2))]
            cols += [pa.array([(r[2] >> 32 * k) & 0xFFFFFFFF if k < PARTS - 1 else r[2] >> 32 * k for r in rows], pa.int64()) for k in range(PARTS)]
            yield pa.RecordBatch.from_arrays(cols, names=["size", "i", "j", *PART_COLUMNS])

    parts = df.select(F.col(f"`{column}`").alias("v")).mapInArrow(work, "size int, i int, j int, " + ", ".join(f"{p} long" for p in PART_COLUMNS))
    return parts.groupBy("size", "i", "j").agg(*[F.sum(p).alias(p) for p in PART_COLUMNS])


@dataclass(frozen=True)
class Whitener:
    """n vectors of the fit list, their sums S, unit eigenvectors as columns, eigenvalues and the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64-bit where no entry can overflow, else as Python integers."""
        fits = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0)) < 1 << 62
        return x * self.n - np.array(self.sums, np.int64) if fits else x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, deviation: np.ndarray) -> np.ndarray:
        """Centred rows on the components, each over the square root of its variance; NaN on components without variance."""
        scale = np.where(self.values > 0, np.sqrt(np.where(self.values > 0, self.values, 1)), np.nan)
        return (deviation / self.n).astype(np.float64) @ self.vectors / scale


def fit(df: DataFrame, components: int = 8, column: str = "embedding") -> Whitener | None:
    """Eigenvectors of the exact covariance of all usable vectors, by falling eigenvalue; None without any.

    Vectors count if they have the length that most of them have (of equally many the longest). What comes to the driver is one
    row for each pair of entries, whatever the number of vectors: the square of the vectors' length bounds it. n * sum(x y) - S S
    is formed in big integers and divided once, so nothing cancels. Of the components that are asked for those whose
    variance is not above rounding of the largest get the value 0.
    """
    stats = cut(sums(df, column))
    best = stats.filter("i = 0 AND j = 0").select("size", *PART_COLUMNS).collect()
    if not best:
        return None
    whole = lambda r: sum(r[p] << 32 * k for k, p in enumerate(PART_COLUMNS))
    size, n = max(((r["size"], whole(r)) for r in best), key=lambda x: (x[1], x[0]))
    total = {(r["i"], r["j"]): whole(r) for r in stats.filter(F.col("size") == size).collect()}
    s = [total[0, j] for j in range(1, size + 1)]
    cov = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            cov[i, j] = cov[j, i] = (n * total[i + 1, j + 1] - s[i] * s[j]) / (n * n)
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:components], vecs[:, ::-1][:, :components]
    values = np.where(values > size * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    return Whitener(n, tuple(s), np.ascontiguousarray(vecs), values, float(np.trace(cov)))


def whiten(df: DataFrame, model: Whitener | None, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, n, deviation (decimal: sum over entries of (n x - S)^2, exact) and whitened (array of double) of every vector that counts.

    Null, empty, non-finite vectors and those of another length are left out; repeated rows and null keys stay. Null stands for
    a component without variance, and for a deviation of more than 38 digits.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for rows, values in vectors(batch.column("v")):
                if model is None or values.shape[1] != model.size:
                    continue
                d = model.deviations(integers(values))
                small = d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * model.size < 1 << 62
                square = [x if x < 10**38 else None for x in map(int, (d * d).sum(axis=1) if small else (d.astype(object) ** 2).sum(axis=1))]
                w = model.whitened(d)
                white = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel(), from_pandas=True), w.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(pa.array(rows)), pa.array([model.n] * len(rows), pa.int64()), pa.array(square, pa.decimal128(38, 0)), white], names=["k", "n", "deviation", "whitened"]
                )

    narrow = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{column}`").alias("v"))
    return narrow.mapInArrow(work, f"k {narrow.schema['k'].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>").withColumnRenamed("k", key)


def identity_error(white: DataFrame, components: int) -> Column:
    """Aggregate: the largest absolute entry of the covariance of ``whitened`` less the identity, over components with variance."""
    one = [F.col("whitened")[k] for k in range(components)]
    return F.greatest(*[F.abs(F.covar_pop(one[i], one[j]) - (1.0 if i == j else 0.0)) for i in range(components) for j in range(i, components)], F.lit(0.0), F.lit(0.0))


def whitened_rows(df: DataFrame, components: int = 8, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each vector that counts and component: key, component, n, deviation, whitened, explained, identity_error.

    ``explained`` is the component's share of the trace (null if nothing varies); ``identity_error`` is measured over the whitened
    vectors themselves, and is the same on all rows. An empty table gives no rows.
    """
    model = fit(df, components, column)
    white = whiten(df, model, column, key)
    k = 0 if model is None else len(model.values)
    error = white.agg(identity_error(white, k).alias("e")).head()[0] if k else None
    share = F.array(*[F.lit(float(v) / model.trace if model.trace else None) for v in model.values]) if k else F.array()
    return white.select(key, "n", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        key, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(share.cast("array<double>"), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
