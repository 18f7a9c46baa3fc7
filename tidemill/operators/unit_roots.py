"""Augmented unit-root tests and cointegrated pairs, from cross-products that are summed chunk by chunk."""

from __future__ import annotations

import math
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import ratio
from .chunks import inside, overlap, with_chunks

#: MacKinnon (1994), tests with a constant, by the number of series (fixed values): bounds of tau outside of which p is 0 or 1, the
#: point between the two polynomials, and their coefficients by rising power, below it and above it.
MACKINNON = {
    1: (-18.83, 2.74, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-18.86, 0.92, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def p_value(tau: float, series: int = 1) -> float:
    """The probability of so low a statistic under a unit root."""
    low, high, between, small, large = MACKINNON[series]
    if tau > high or tau < low:
        return float(tau > high)
    z = sum(c * tau**k for k, c in enumerate(small if tau <= between else large))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def most_lags(n: int, constant: bool = True) -> int:
    """Lags that are tried on a series of n values: ceil(12 (n / 100) ** 0.25), as far as values last."""
    return max(0, min(ceil(12 * (n / 100) ** 0.25), n // 2 - int(constant) - 1))


def products(series: DataFrame, by: str, order: str, value: str, lags: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Sums of products of (1, level before, lagged changes, change) over the rows of each series, and the first rows themselves.

    The first table has by, i, j and total; missing lags count as 0. The second has by, known (lags that the row has) and v, for the rows
    that lack some, so that samples of fewer rows can be had by subtraction. Rows come in chunks of ``width`` with lags + 1 rows
    of context; a task holds one chunk, and what is shuffled after that is one matrix a chunk.
    """
    w = inside(by, order)
    d = overlap(with_chunks(series.select(by, order, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)"), order, width), lags + 1, by, order)
    d = d.withColumn("before", F.lag("x").over(w)).withColumn("change", F.col("x") - F.col("before"))
    past = [F.lag("change", k).over(w) for k in range(1, lags + 1)]
    d = d.withColumns({f"c{k}": c for k, c in enumerate(past, 1)}).filter("NOT context AND before IS NOT NULL")
    known = F.aggregate(F.array(F.lit(0), *[F.col(f"c{k}").isNotNull().cast("int") for k in range(1, lags + 1)]), F.lit(0), lambda s, x: s + x)
    v = F.array(F.lit(1.0), F.col("before"), *[F.coalesce(f"c{k}", F.lit(0.0)) for k in range(1, lags + 1)], F.col("change"))
    d = d.select(by, "chunk", known.alias("known"), v.alias("v"))
    kind = d.schema[by].dataType.simpleString()

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.v.tolist())
        total = x.T @ x
        i, j = np.triu_indices(len(total))
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(i), "i": i, "j": j, "total": total[i, j]})

    sums = d.groupBy(by, "chunk").applyInPandas(gram, f"`{by}` {kind}, i int, j int, total double").groupBy(by, "i", "j").agg(F.sum("total").alias("total"))
    return sums, d.filter(F.col("known") < lags).select(by, "known", "v")


def fitted(total: np.ndarray, heads: list[tuple[int, np.ndarray]], constant: bool, series: int) -> tuple[int, int, float | None, float]:
    """n, chosen lags, statistic and p from the sums of products: lags by Akaike's criterion on the sample of the most lags, the
    statistic on the larger sample of the chosen ones."""
    rows = round(total[0, 0])
    most = min(most_lags(rows + 1, constant), len(total) - 3)

    def sample(lags: int) -> np.ndarray:
        return total - sum((np.outer(v, v) for known, v in heads if known < lags), np.zeros_like(total))

    def regression(g: np.ndarray, lags: int) -> tuple[float, float, float, int]:
        use, y = [*([0] if constant else []), *range(1, 2 + lags)], len(g) - 1
        scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
        a = (g / np.outer(scale, scale))[np.ix_(use, use)]
        inverse = np.linalg.inv(a)
        beta = inverse @ (g[use, y] / scale[use])
        rest = g[y, y] - beta @ (g[use, y] / scale[use])
        at = use.index(1)
        return max(rest, 0.0), beta[at] / scale[1], inverse[at, at] / scale[1] ** 2, len(use)

    try:
        g, n = sample(most), rows - most
        best = min((n * log(r[0] / n) + 2 * r[3], lags) for lags in range(most + 1) if (r := regression(g, lags))[0] > 0)[1]
        rest, beta, spread, used = regression(sample(best), best)
        tau = beta / math.sqrt(rest / (rows - best - used) * spread)
        return rows + 1, best, tau, p_value(tau, series)
    except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):  # nothing varies, or too few rows
        return rows + 1, 0, None, 1.0


def augmented_test(series: DataFrame, by: str, order: str, value: str, width: int, constant: bool = True, tests: int = 1, least: int = 100) -> DataFrame:
    """by, n, lags, statistic, p, and half_life (of the return to the mean; null if it does not return) of each series.

    The change is regressed on the level before it and on lagged changes, with a constant or (for residuals) without; ``tests`` is the
    number of series that the value was made of. Series with fewer than ``least`` values are left out; rows without a value too.
    """
    counts = series.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    longest = counts.agg(F.max("n")).head()[0]
    lags = most_lags(longest or 0, constant)
    enough = series.join(counts.select(F.col(by).alias("_by")), F.col(by).eqNullSafe(F.col("_by")), "left_semi")
    sums, heads = products(enough, by, order, value, lags, width)
    kind = sums.schema[by].dataType.simpleString()

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((lags + 3, lags + 3))
        total[left.i, left.j] = total[left.j, left.i] = left.total
        n, used, tau, p = fitted(total, [(k, np.array(v)) for k, v in zip(right.known, right.v, strict=True)], constant, tests)
        m, y = total[0, 0], lags + 2
        var, cov = total[1, 1] - total[0, 1] ** 2 / m, total[1, y] - total[0, 1] * total[0, y] / m
        slope = cov / var if var > 0 else 0.0
        half = -log(2) / log(1 + slope) if -1 < slope < 0 else None
        return pd.DataFrame([[left[by].iloc[0], n, used, tau, p, half]], columns=[by, "n", "lags", "statistic", "p", "half_life"])

    return sums.groupBy(by).cogroup(heads.groupBy(by)).applyInPandas(solve, f"`{by}` {kind}, n long, lags int, statistic double, p double, half_life double")


def series_pairs(rows: DataFrame, key: str, order: str, value: str, least: int) -> DataFrame:
    """pair (a|b), a, b, order, x, y of each two series a < b at their common times, if they have ``least`` of them; as many pairs as the
    square of the number of series, which are meant to be hundreds."""
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    one = known.select(F.col(key).alias("a"), F.col(order), F.col(value).cast("double").alias("x"))
    two = known.select(F.col(key).alias("b"), F.col(order).alias("_t"), F.col(value).cast("double").alias("y"))
    return one.join(two, (F.col(order) == F.col("_t")) & (F.col("a") < F.col("b"))).drop("_t").withColumn("pair", F.to_json(F.array("a", "b")))


def cointegrated_pairs(rows: DataFrame, key: str, order: str, value: str, width: int, least: int = 100, alpha: float = 0.05) -> DataFrame:
    """For each pair of series: n, hedge_ratio, spread_std, lags, statistic, p, half_life, and whether they are cointegrated.

    The residual of a on b with a constant has to have no unit root (two-step test). Half-life and deviation are those of a - ratio * b.
    """
    both = series_pairs(rows, key, order, value, least)
    fit = both.groupBy("pair").agg(F.first("a").alias("fa"), F.first("b").alias("fb"), F.count(F.lit(1)).alias("m"), F.avg("x").alias("mx"), F.avg("y").alias("my"), ratio(F.covar_pop("x", "y"), F.var_pop("y")).alias("hedge_ratio"))
    fit = fit.filter((F.col("m") >= least) & F.col("hedge_ratio").isNotNull()).withColumnRenamed("pair", "_pair")
    rest = both.join(fit, F.col("pair") == F.col("_pair")).select("pair", order, ((F.col("x") - F.col("mx")) - F.col("hedge_ratio") * (F.col("y") - F.col("my"))).alias("rest"))
    deviation = rest.groupBy("pair").agg(F.stddev_pop("rest").alias("spread_std")).withColumnRenamed("pair", "_p2")
    tested = augmented_test(rest, "pair", order, "rest", width, constant=False, tests=2, least=least)
    d = tested.join(fit, F.col("pair") == F.col("_pair")).join(deviation, F.col("pair") == F.col("_p2"))
    return d.select(F.col("fa").alias("a"), F.col("fb").alias("b"), "n", "hedge_ratio", "spread_std", "lags", "statistic", "p", "half_life", (F.col("p") < alpha).alias("cointegrated"))


def best_pairs(tested: DataFrame, top: int = 10) -> DataFrame:
    """The cointegrated pairs that return to their mean, those of least p first, at most ``top``."""
    return tested.filter("cointegrated AND half_life IS NOT NULL").orderBy("p", "a", "b").limit(top)
