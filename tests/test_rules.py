"""Hand-made cases of the decision rules, table operations and simulators."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import recursive as R
from tidemill.operators import rules as RU
from tidemill.operators import shaping as SH
from tidemill.operators import simulate as SM

VIEWS = "id long, action string, confidence double, funding_bp double, momentum string, rsi double, pattern string, similarity double, pattern_win_rate double, ev_pct double, mtf string, mtf_agreement double, blend_score double, blend_regime string"


def test_fusion_stage_by_stage(spark):
    plain = ("neutral", 50.0, "neutral", 0.5, 0.5, 0.0, "neutral", 0.0, 0.0, "weak_trend")
    rows = [
        (1, "long", 0.5, 0.0, *plain),
        (2, "short", 0.5, -2.0, *plain),
        (3, "long", 0.5, 0.0, "neutral", 50.0, "short", 0.9, 0.5, 0.0, "bullish", 0.9, 0.5, "ranging"),
        (4, "long", 0.5, 0.0, "neutral", 50.0, "long", 0.9, 0.6, 0.0, "bullish", 0.9, 0.5, "ranging"),
        (5, "short", 0.9, 0.0, "neutral", 50.0, "long", 0.82, 0.6, 0.0, "bullish", 0.6, 0.5, "x"),
        (6, "hold", 0.4, None, None, None, None, None, None, None, None, None, None, None),
        (7, "short", 0.5, 0.0, "neutral", 50.0, None, None, None, None, "bullish", 0.75, None, None),
        (8, "long", None, 9.0, *plain),
    ]
    got = {r.id: (r.action, r.confidence, r.reasons) for r in RU.fuse(spark.createDataFrame(rows, VIEWS)).collect()}
    assert got[1] == ("long", 0.5, "") and got[2] == ("hold", 0.0, "short_squeeze") and got[3] == ("hold", 0.0, "pattern_conflict")
    assert got[4][0] == "long" and got[4][1] == pytest.approx(0.5 * 1.25 * 1.15 * 0.6 * 1.15) and got[4][2] == "pattern_confirms|mtf_agrees|blend_ranging|blend_agrees"
    assert got[5][1] == pytest.approx(0.9 * 0.6 * 0.6 * 0.7) and got[5][2] == "pattern_weak|mtf_opposes|blend_opposes"
    assert got[6] == ("hold", 0.4, "") and got[7] == ("hold", 0.0, "mtf_veto") and got[8][0] == "hold"
    assert RU.fuse(spark.createDataFrame([], VIEWS)).count() == 0


def test_flow_toxicity_of_flat_and_rising_closes(spark):
    rows = [("flat", i, 5.0) for i in range(20)] + [("up", i, float(i)) for i in range(20)] + [("short", i, 1.0) for i in range(19)]
    got = {r.symbol: r for r in RU.flow_toxicity(spark.createDataFrame(rows, "symbol string, t long, close double")).collect()}
    assert set(got) == {"flat", "up"}
    assert (got["flat"].toxicity, got["flat"].level) == (0.0, "low") and (got["up"].toxicity, got["up"].dominant, got["up"].level) == (1.0, "buy", "high")


def test_gates_and_caps(spark):
    rows = [(1, 0, -10.0), (2, 1, -10.0), (3, 2, -10.0), (4, 3, 5.0), (5, 30, -2000.0)]
    t = spark.createDataFrame([(i, t, "s", p) for i, t, p in rows], "id long, t long, symbol string, pnl double")
    assert [r.halt for r in RU.risk_gates(t, 1000.0).orderBy("id").collect()] == [None, None, "cooldown", None, "drawdown"]
    d = spark.createDataFrame([(5, 0.04), (5, 0.012), (5, 0.0), (2, 0.001)], "lev int, stop double")
    assert [r[0] for r in d.select(RU.leverage_cap(F.col("lev"), F.col("stop"))).collect()] == [1, 4, 5, 2]
    e = spark.createDataFrame([(-0.006, 0.02), (-0.02, 0.001), (-0.006, 0.0), (None, 1.0)], "f double, p double")
    assert [r[0] for r in e.select(RU.funding_exit(F.col("f"), F.col("p"))).collect()] == ["take_profit", "emergency", None, None]


def test_table_operations(spark):
    d = spark.createDataFrame([("a", 1, 0.0, "2024-01-05 00:00:00"), ("a", 2, None, "nonsense"), ("a", 3, float("nan"), None), ("a", 4, 2.0, "2023-01-01 00:00:00")], "symbol string, t long, x double, stamp string")
    assert [r.x for r in SH.with_defaults(d, {"x": 1.0}).filter("NOT isnan(x)").orderBy("t").collect()] == [1.0, 1.0, 2.0]
    assert [r.t for r in SH.complete(d).orderBy("t").collect()] == [1, 4]
    assert [r.t for r in SH.since_or_unparsed(d, "stamp", "2024-01-01 00:00:00").orderBy("t").collect()] == [1, 2, 3]
    assert [r.t for r in SH.every(d, 3).orderBy("t").collect()] == [1, 4]
    config = {"name": "x y", "limit": 12}
    got = spark.range(1).select(SH.config_hash({"name": F.lit("x y"), "limit": F.lit(12)})).head()[0]
    assert got == hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]
    none = spark.createDataFrame([], "pnl double")
    assert tuple(SH.account_summary(none, 100.0).head()) == (0, 0.0, 0.0, None, None, 0.0)


def test_unit_root_matches_least_squares(spark):
    rnd = np.random.default_rng(5)
    s = np.zeros(200)
    for i in range(1, 200):
        s[i] = 0.5 * s[i - 1] + rnd.normal()
    got = SH.unit_root(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(s)], "k string, t long, s double"), ["k"], "s", "t").head()
    x, y = s[:-1], np.diff(s)
    beta, alpha = np.polyfit(x, y, 1)
    se = math.sqrt(((y - beta * x - alpha) ** 2).sum() / (len(x) - 2) / ((x - x.mean()) ** 2).sum())
    assert got.beta == pytest.approx(beta) and got.t_stat == pytest.approx(beta / se) and got.cointegrated


def test_backtest_pays_the_exit_fee():
    got = SM.run_backtest(["long", "close", "hold"], np.array([100.0, 100.0, 100.0]), np.ones(3), 1000.0, 0.01, 0.0)
    assert got["win_rate"] == 0.0 and got["final_equity"] == pytest.approx(1000 * 0.99 * 0.99)
    assert got["max_drawdown"] == pytest.approx(1 - 0.99 * 0.99)


def test_hurst_fits_the_sizes_that_vary():
    r = np.zeros(64)
    r[0:64:16] = 0.01  # every chunk of 8 that starts off these places is flat
    r[8:16] = 0.0
    close = np.exp(np.concatenate([[0.0], np.cumsum(np.concatenate([r, [0.01]]))]))
    got = R.hurst(close)[-1]
    logs, sizes = [], []
    for c in (8, 16, 32):
        v = []
        for p in np.diff(np.log(close))[:64].reshape(-1, c):
            z = np.cumsum(p - p.mean())
            if p.std() > 1e-10 and z.max() > z.min():
                v.append((z.max() - z.min()) / p.std())
        if v:
            logs.append(math.log(np.mean(v)))
            sizes.append(math.log(c))
    assert got == pytest.approx(float(np.clip(np.polyfit(sizes, logs, 1)[0], 0, 1)), abs=1e-6)
