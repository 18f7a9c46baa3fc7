"""Augmented unit-root tests and pairs against least squares on the rows themselves."""

import math

import numpy as np
import pytest

from tidemill.operators import unit_roots as U


def plain(x, constant=True, series=1):
    """The test by least squares, sample by sample."""
    d, n = np.diff(x), len(x)

    def fit(lags, first):
        rows = range(first, n - 1)
        design = np.array([[*([1.0] if constant else []), x[t], *(d[t - k] for k in range(1, lags + 1))] for t in rows])
        y = np.array([d[t] for t in rows])
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        rest = float(((y - design @ beta) ** 2).sum())
        at = int(constant)
        return rest, beta[at], np.linalg.inv(design.T @ design)[at, at], len(y), design.shape[1]

    most = U.most_lags(n, constant)
    best = min((f[3] * math.log(f[0] / f[3]) + 2 * f[4], k) for k in range(most + 1) for f in [fit(k, most)])[1]
    rest, beta, spread, m, used = fit(best, best)
    tau = beta / math.sqrt(rest / (m - used) * spread)
    return best, tau, U.p_value(tau, series)


def walks(seed=1):
    r = np.random.default_rng(seed)
    base = np.cumsum(r.normal(size=400))
    noise = np.zeros(400)
    for k in range(3, 400):
        noise[k] = 0.5 * noise[k - 1] - 0.3 * noise[k - 3] + r.normal()
    return {"a": base * 2 + noise + 1_000, "b": base, "c": np.cumsum(r.normal(size=400)), "d": noise[:150] * 5 + 1e5, "e": np.full(200, 3.0), "f": base[:50]}


def rows(series):
    return [(k, 3 * t + (7 if t > 90 else 0), float(v)) for k, x in series.items() for t, v in enumerate(x)]


SCHEMA = "symbol string, t long, close double"


@pytest.mark.parametrize("width", [11, 250, 10**6])
def test_augmented_test_equals_least_squares(spark, width):
    series = walks()
    extra = [("a", 10**6, None), ("b", 10**6, float("nan"))]
    got = {r.symbol: r for r in U.augmented_test(spark.createDataFrame(rows(series) + extra, SCHEMA).repartition(3), "symbol", "t", "close", width).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"} and (got["e"].statistic, got["e"].p) == (None, 1.0)
    for k in "abcd":
        best, tau, p = plain(series[k])
        assert (got[k].n, got[k].lags) == (len(series[k]), best)
        assert got[k].statistic == pytest.approx(tau, rel=1e-6) and got[k].p == pytest.approx(p, rel=1e-5, abs=1e-12)
    assert got["d"].p < 0.05 < got["c"].p
    x = series["d"]
    slope = np.polyfit(x[:-1], np.diff(x), 1)[0]
    assert got["d"].half_life == pytest.approx(-math.log(2) / math.log(1 + slope), rel=1e-6)


def test_p_values_of_known_points():
    assert U.p_value(-2.8615, 1) == pytest.approx(0.05, abs=0.001) and U.p_value(-3.4304, 1) == pytest.approx(0.01, abs=0.001)
    assert U.p_value(-3.3377, 2) == pytest.approx(0.05, abs=0.001) and U.p_value(-3.9001, 2) == pytest.approx(0.01, abs=0.001)
    assert U.p_value(3.0) == 1 and U.p_value(-20.0) == 0
    for series, (_, _, between, small, large) in U.MACKINNON.items():
        assert sum(c * between**k for k, c in enumerate(small)) == pytest.approx(sum(c * between**k for k, c in enumerate(large)), abs=0.01), series


def test_pairs(spark):
    series = walks()
    tested = U.cointegrated_pairs(spark.createDataFrame(rows(series), SCHEMA), "symbol", "t", "close", 200)
    got = {(r.a, r.b): r for r in tested.collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")}  # no e: it does not vary; no f: too short
    for (a, b), r in got.items():
        n = min(len(series[a]), len(series[b]))
        x, y = series[a][:n], series[b][:n]
        beta = np.cov(x, y)[0, 1] / np.var(y, ddof=1)
        rest = x - x.mean() - beta * (y - y.mean())
        best, tau, p = plain(rest, constant=False, series=2)
        assert (r.n, r.lags) == (n, best)
        assert (r.hedge_ratio, r.statistic, r.p) == (pytest.approx(beta), pytest.approx(tau, rel=1e-6), pytest.approx(p, rel=1e-5, abs=1e-12))
        assert r.spread_std == pytest.approx(rest.std())
    assert got["a", "b"].cointegrated and not got["b", "c"].cointegrated
    best = U.best_pairs(tested, 1).collect()
    assert len(best) == 1 and best[0].cointegrated and best[0].p == min(r.p for r in got.values())


def test_nothing_to_test(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert U.augmented_test(none, "symbol", "t", "close", 10).collect() == [] and U.cointegrated_pairs(none, "symbol", "t", "close", 10).collect() == []
