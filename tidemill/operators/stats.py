"""Statistics as aggregates and windows: rank correlation, Sharpe ratios, tests, tails, regressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import corr, ratio


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """Rank correlation of each group; 0 where there are too few pairs or no variance."""
    d = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    ic = F.when((F.count(F.lit(1)) < least) | (F.stddev_pop("_x") == 0) | (F.stddev_pop("_y") == 0), 0.0).otherwise(corr("_x", "_y"))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ic.alias("ic"))


def hit_rate(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Share of equal signs among non-zero signals."""
    live = F.col(x) != 0
    same = live & (F.signum(x) == F.signum(y))
    return rows.filter(F.col(y).isNotNull()).groupBy(*by).agg(F.count_if(live).alias("n"), (F.count_if(same) / F.greatest(F.count_if(live), F.lit(1))).alias("hit_rate"))


def autocorrelation(rows: DataFrame, value: str, by: str, order: list[str], lags: tuple[int, ...]) -> DataFrame:
    """Correlation with earlier values at several lags, and the half-life of an AR(1) process."""
    w = Window.partitionBy(by).orderBy(*order)
    d = rows.withColumns({f"_l{k}": F.lag(value, k).over(w) for k in lags})
    d = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[corr(value, f"_l{k}").alias(f"lag_{k}") for k in lags])
    rho = F.col(f"lag_{lags[0]}")
    return d.withColumn("half_life", F.when((F.col("n") >= 30) & (rho > 0) & (rho < 1), -math.log(2) / F.log(rho)))


def sharpe(rows: DataFrame, value: str, by: list[str], target: float = 0.0) -> DataFrame:
    """Mean, sample deviation, Sharpe, downside deviation, median, and the moments that PSR needs."""
    x = F.col(value)
    n = F.count(x)
    d = rows.groupBy(*by).agg(
        n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.median(x).alias("median"),
        F.coalesce(F.sqrt(F.avg(F.when(x < target, (x - target) * (x - target)))), F.lit(0.0)).alias("downside"),
        F.skewness(x).alias("_s"), F.kurtosis(x).alias("_k"),
    )
    return d.withColumn("sharpe", F.coalesce(ratio(F.col("mean"), F.col("sd")), F.lit(0.0)))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function to 1e-7, by the rational approximation of Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: float) -> float:
    """The normal quantile, by the standard library."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def deflated_sharpe(rows: DataFrame, value: str, by: list[str], trials: int, benchmark: float = 0.0) -> DataFrame:
    """Probabilistic and deflated Sharpe ratio of each group of at least 30 values.

    Moments use the sample deviation with sums divided by n. The expected best of ``trials`` Sharpe ratios is the
    Euler-Mascheroni mixture of two normal quantiles times the standard error.
    """
    d = sharpe(rows, value, by)
    n, sr = F.col("n"), F.col("sharpe")
    f = ratio(n - 1, n)
    skew, kurt = F.col("_s") * F.pow(f, 1.5), (F.col("_k") + 3) * f * f - 3
    d = d.withColumn("se", F.sqrt(F.greatest(F.lit(1e-12), ratio(1 - skew * sr + kurt / 4 * sr * sr, n - 1))))
    g = 0.5772156649
    best = 0.0 if trials < 2 else (1 - g) * normal_quantile(1 - 1 / trials) + g * normal_quantile(1 - 1 / (trials * math.e))
    out = d.withColumns({"psr": normal_cdf((sr - benchmark) / F.col("se")), "dsr": normal_cdf((sr - benchmark) / F.col("se") - best)})
    return out.filter("n >= 30").select(*by, "n", "sharpe", "se", "psr", "dsr")


def compare_two(rows: DataFrame, value: str, arm: str, a: str, b: str) -> DataFrame:
    """Welch's t and its degrees of freedom, Cohen's d and its name, for two arms; null without variance or with one value."""
    side = lambda v: F.when(F.col(arm) == v, F.col(value))
    d = rows.agg(*[f(side(v)).alias(f"{k}_{s}") for s, v in (("a", a), ("b", b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    va, vb = ratio(F.col("v_a"), F.col("n_a")), ratio(F.col("v_b"), F.col("n_b"))
    t = ratio(F.col("m_a") - F.col("m_b"), F.sqrt(va + vb))
    df = ratio((va + vb) * (va + vb), ratio(va * va, F.col("n_a") - 1) + ratio(vb * vb, F.col("n_b") - 1))
    pooled = F.sqrt(ratio((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b"), F.col("n_a") + F.col("n_b") - 2))
    e = ratio(F.col("m_a") - F.col("m_b"), pooled)
    name = F.when(F.abs(e) < 0.2, "negligible").when(F.abs(e) < 0.5, "small").when(F.abs(e) < 0.8, "medium").when(e.isNotNull(), "large")
    return d.select("n_a", "n_b", t.alias("t"), df.alias("df"), e.alias("d"), name.alias("effect"))


def mann_whitney(rows: DataFrame, value: str, arm: str, a: str, b: str) -> DataFrame:
    """U of the first arm, its normal score with tie correction, and the two-sided p; null if an arm is empty or all values tie."""
    d = rows.filter(F.col(arm).isin(a, b)).withColumns({"_one": F.lit(1), "_a": (F.col(arm) == a).cast("int")})
    # Ties are reduced to one row a value before the ranks are summed, so the ordered pass is over values, not rows.
    v = d.groupBy(value).agg(F.count(F.lit(1)).alias("c"), F.sum("_a").alias("ca"))
    v = v.withColumn("below", F.coalesce(F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = v.agg(F.sum("ca").alias("na"), (F.sum("c") - F.sum("ca")).alias("nb"), F.sum(F.col("ca") * (F.col("below") + (F.col("c") + 1) / 2)).alias("ra"), F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("ties"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    u = F.col("ra") - na * (na + 1) / 2
    z = ratio(u - na * nb / 2, F.sqrt(na * nb / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1)))))
    return s.select(na.alias("n_a"), nb.alias("n_b"), u.alias("u"), z.alias("z"), (2 * normal_cdf(-F.abs(z))).alias("p"))


def cvar(rows: DataFrame, value: str, by: list[str], level: float = 0.95) -> DataFrame:
    """Value at risk of the losses (linear quantile) and the mean loss at or beyond it; needs 20 values and 5 losses."""
    loss = F.when(F.col(value) < 0, -F.col(value))
    q = rows.groupBy(*by).agg(F.count(value).alias("n"), F.count(loss).alias("n_losses"), F.percentile(loss, level).alias("var"))
    tail = rows.join(q, by).groupBy(*by).agg(F.first("n").alias("n"), F.first("n_losses").alias("n_losses"), F.first("var").alias("var"), F.avg(F.when(loss >= F.col("var"), loss)).alias("cvar"))
    return tail.filter("n >= 20 AND n_losses >= 5")


def pair_statistics(rows: DataFrame, key: str, order: str, value: str, least: int = 30) -> DataFrame:
    """For each pair of series on their common times: correlation, hedge ratio, spread deviation and spread half-life."""
    a = rows.select(F.col(key).alias("a"), F.col(order).alias("t"), F.col(value).alias("x"))
    b = rows.select(F.col(key).alias("b"), F.col(order).alias("t2"), F.col(value).alias("y"))
    both = a.join(b, (F.col("t") == F.col("t2")) & (F.col("a") < F.col("b"))).drop("t2")
    fit = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), corr("x", "y").alias("corr"), F.regr_slope("x", "y").alias("beta")).filter(F.col("n") >= least)
    s = both.join(fit, ["a", "b"]).withColumn("s", F.col("x") - F.col("beta") * F.col("y"))
    prev = F.lag("s").over(Window.partitionBy("a", "b").orderBy("t"))
    s = s.withColumns({"prev": prev, "ds": F.col("s") - prev})
    out = s.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("corr").alias("corr"), F.first("beta").alias("beta"), F.avg("s").alias("spread_mean"), F.stddev_pop("s").alias("spread_sd"), F.regr_slope("ds", "prev").alias("lam"))
    return out.withColumn("half_life", F.when(F.col("lam") < 0, -math.log(2) / F.col("lam"))).drop("lam")


def reliability(rows: DataFrame, confidence: str, correct: Column) -> DataFrame:
    """Rows, mean confidence and accuracy of each tenth of confidence."""
    d = rows.withColumn("bin", F.floor(F.col(confidence) * 10).cast("long"))
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("int")).alias("accuracy"))
