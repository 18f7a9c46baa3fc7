"""Chunked recurrences against the kernel that takes a series as one group, and against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import chunks as C
from tidemill.operators import recursive as R

BARS = "symbol string, t long, open double, high double, low double, close double, volume double"


def walk(seed, n, symbol, gaps=True):
    r = np.random.default_rng(seed)
    close = np.exp(np.cumsum(r.normal(0, 0.02, n))) * 100
    close[n // 3 : n // 3 + 15] = close[n // 3]
    t = np.cumsum(r.integers(1, 4 if gaps else 2, n)) + 1_000
    t[n // 2 :] += 500 if gaps else 0
    return [(symbol, int(k), float(c * 0.99), float(c * (1 + u)), float(c * (1 - v)), float(c), float(w)) for k, c, u, v, w in zip(t, close, r.random(n) * 0.02, r.random(n) * 0.02, r.integers(1, 50, n), strict=True)]


def test_maps_compose():
    r = np.random.default_rng(1)
    a, b = r.random((37, 3)), r.normal(size=(37, 3))
    a[[0, 9, 20], [0, 1, 2]] = 0
    big_a, big_b = C.compose(a, b)
    y = np.array([5.0, np.nan, np.nan])
    for k in range(37):
        y = np.where(a[k] == 0, b[k], a[k] * y + b[k])
        assert np.allclose(C.applied(big_a[k], big_b[k], np.array([5.0, np.nan, np.nan])), y, equal_nan=True)


@pytest.mark.parametrize("levels,fan", [(0, 1_024), (1, 4), (3, 2)])
def test_scan_over_levels(spark, monkeypatch, levels, fan):
    monkeypatch.setattr(C, "FAN", fan)
    r = np.random.default_rng(2)
    rows = [(k, t, float(x), bool(z)) for k in ("a", None) for t, (x, z) in enumerate(zip(r.normal(size=200), r.random(200) < 0.02, strict=True))]
    d = spark.createDataFrame(rows, "symbol string, t long, x double, z boolean")
    d = C.with_chunks(d.withColumn("x", F.when(F.col("t") % 17 != 3, F.col("x"))), "t", 7)
    got = {(g.symbol, g.t): g.y for g in C.affine_scan(d, {"y": (F.when(F.col("z"), 0.0).otherwise(0.9), F.col("x"))}, levels=levels).collect()}
    for k in ("a", None):
        y = None
        for key, t, x, z in rows:
            if key != k:
                continue
            if t % 17 != 3:
                y = x if z else None if y is None else 0.9 * y + x
            assert got[k, t] is None if y is None else got[k, t] == pytest.approx(y)


@pytest.mark.parametrize("chunks", [1, 64])
def test_features_in_chunks_equal_the_kernel(spark, chunks):
    rows = walk(3, 700, "a") + walk(4, 12, "b", gaps=False) + walk(5, 1, None)
    bars = spark.createDataFrame(rows, BARS)
    span = max(r[1] for r in rows) - min(r[1] for r in rows)
    got = C.chunked_features(bars.repartition(5), C.even_width(span, chunks)).toPandas()
    parts = []
    for _, part in pd.DataFrame(rows, columns=["symbol", "t", *R.BAR]).groupby("symbol", dropna=False):
        want = R._features(part)
        c, v = part.close.reset_index(drop=True), part.volume.reset_index(drop=True)
        want["obv"] = v.where(~(c.diff() < 0), -v).cumsum()
        want["obv_ema"] = want.obv.ewm(span=20).mean()
        want["ema_200"] = R.ewm(c, span=200, least=200)
        want["ema_cross_short"], want["ema_cross_long"] = (want.ema_9 - want.ema_21) / c, (want.ema_50 - want.ema_200) / c
        want["atr_pct"], want["kama_slope"], want["kama_cross"] = want.atr_14 / c, want.kama_slope / c, (c - want.kama) / c
        e = {n: c.ewm(span=n).mean() for n in (8, 21)}
        score = 3 * (e[8] - e[21]) / e[21] + 1.5 * c.pct_change(4) + 0.6 * c.pct_change(9) + 0.4 * c.pct_change(19)
        spike = v / (v.rolling(20, min_periods=1).mean() + 1e-10)
        want["momentum"] = (score * np.where(spike > 1.5, 1 + np.minimum((spike - 1.5) * 0.3, 0.5), 1)).where(c.index >= 29, 0.0)
        parts.append(want.drop(columns="hurst"))
    want = pd.concat(parts)
    both = want.merge(got, on=["symbol", "t"], suffixes=("", "_got"))
    assert len(got) == len(both) == len(rows)
    for name in want.columns[2:]:
        assert np.allclose(both[name].astype(float), both[f"{name}_got"].astype(float), rtol=1e-6, atol=1e-8, equal_nan=True), name
    assert set(got.momentum_direction) >= {"long", "neutral"}


def test_own_index_by_a_loop(spark):
    rows = walk(6, 300, "a")
    got = C.chunked_features(spark.createDataFrame(rows, BARS), 20).orderBy("t").toPandas().own_adx.astype(float)
    h, low, c = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
    up, down = h[1:] - h[:-1], low[:-1] - low[1:]
    smooth = lambda x: pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean()
    tr = smooth(np.maximum(h[1:] - low[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(low[1:] - c[:-1]))))
    p, m = 100 * smooth(np.where((up > down) & (up > 0), up, 0)) / (tr + 1e-10), 100 * smooth(np.where((down > up) & (down > 0), down, 0)) / (tr + 1e-10)
    assert np.isnan(got[0]) and np.allclose(got[1:], smooth(100 * (p - m).abs() / (p + m + 1e-10)))


@pytest.mark.parametrize("width", [9, 10_000])
def test_hurst_in_chunks(spark, width):
    rows = walk(7, 200, "a")
    got = C.chunked_hurst(spark.createDataFrame(rows, BARS), width).orderBy("t").toPandas().hurst.astype(float)
    assert np.allclose(got, R.hurst(np.array([r[5] for r in rows])), equal_nan=True)


def test_no_rows(spark):
    none = spark.createDataFrame([], BARS)
    assert C.chunked_features(none, 5).collect() == [] and C.chunked_hurst(none, 5).collect() == []
