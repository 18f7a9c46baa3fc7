import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import bars as B
from tidemill.operators import indicators as I
from tidemill.operators import labels as LB
from tidemill.operators import recursive as R
from tidemill.operators import simulate as SM
from tidemill.operators import splits as SP
from tidemill.operators import stats as ST
from tidemill.operators.asof import asof_join
from tidemill.streaming import bars as STR


def frame(spark, closes, symbol="s", start=0):
    rows = [(symbol, start + i, float(c), float(c) + 1, float(c) - 1, float(c), 1.0 + i % 3) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double")


def test_windows_are_null_until_full(spark):
    got = {r.t: r.bb_mid for r in I.bollinger(frame(spark, range(1, 22)), 20).collect()}
    assert all(got[t] is None for t in range(19)) and got[19] == pytest.approx(10.5) and got[20] == pytest.approx(11.5)


def test_ewm_by_hand():
    x = pd.Series([1.0, 2, 4, 3])
    assert R.ewm(x, alpha=0.5).tolist() == [1, 1.5, 2.75, 2.875]


def test_wilder_and_kama_by_hand():
    assert R.wilder(np.array([1.0, 2, 3, 6]), 3).tolist() == pytest.approx([0, 0, 2, 2 + 4 / 3])
    k = R.kama(np.arange(1.0, 14.0))
    fast = (2 / 3) ** 2
    assert np.isnan(k[:10]).all() and k[10] == 11 and k[11] == pytest.approx(11 + fast)


def test_drawdown_and_streaks(spark):
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, -3.0, 2.0, -1.0])], "symbol string, t long, pnl double")
    assert min(r.drawdown for r in I.drawdown(d, "pnl", "symbol", "t").collect()) == -3
    assert [r.streak for r in I.streaks(d, F.col("pnl") > 0, "symbol", "t").orderBy("t").collect()] == [1, 1, 1, 1]


@pytest.mark.parametrize(("high", "low", "hit", "label"), [(13.0, 8.5, "sl", 0), (13.0, 9.5, "pt", 2), (10.5, 9.5, "time", 1)])
def test_triple_barrier_cases(spark, high, low, hit, label):
    rows = [("s", 0, 10.0, 10.0, 10.0, 10.0, 1.0), ("s", 1, 10.0, high, low, 10.0, 1.0)]
    d = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, atr double")
    got = LB.triple_barrier(d, "atr").orderBy("t").collect()
    assert (got[0].tb_hit, got[0].tb_label) == (hit, label) and got[1].tb_hit is None


def test_asof_rules(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 7), ("b", 5), (None, 5)], "k string, t long")
    right = spark.createDataFrame([("a", 3, 30), ("a", 5, 50), ("b", 6, 60), (None, 2, 20)], "k string, t long, v int")
    got = {(r.k, r.t): r.right_v for r in asof_join(left, right, "t", ["k"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 50, ("a", 7): 50, ("b", 5): None, (None, 5): 20}
    assert {(r.k, r.t): r.right_v for r in asof_join(left, right, "t", ["k"], inclusive=False).collect()}[("a", 5)] == 30
    assert {(r.k, r.t): r.right_v for r in asof_join(left, right, "t", ["k"], tolerance=1).collect()}[("a", 7)] is None


def test_upsert_gaps_and_latest(spark):
    d = frame(spark, [1, 2, 3])
    up = B.upsert(d, frame(spark, [9, 8], start=2), ["symbol", "t"])
    assert [r.close for r in up.orderBy("t").collect()] == [1, 2, 9, 8]
    assert [tuple(r) for r in B.gaps(d.filter("t <> 1")).collect()] == [("s", 2, 1)]
    assert sorted(r.t for r in B.latest(d, 2).collect()) == [1, 2]
    assert B.to_bars(spark.createDataFrame([], "symbol string, t long, seq long, price double, amount double")).count() == 0


def test_spearman_ties(spark):
    d = spark.createDataFrame([("g", x, y) for x, y in [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (2.0, 4.0)]], "g string, x double, y double")
    want = pd.Series([1, 1, 1, 2]).corr(pd.Series([1, 2, 3, 4]), method=lambda a, b: np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1])
    assert ST.spearman(d, "x", "y", ["g"]).head().ic == pytest.approx(want)
    flat = spark.createDataFrame([("g", 1.0, float(i)) for i in range(5)], "g string, x double, y double")
    assert ST.spearman(flat, "x", "y", ["g"]).head().ic == 0


def test_normal_cdf(spark):
    xs = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(ST.normal_cdf(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=2e-7)


def test_splits_do_not_leak(spark):
    n = 103
    rows = spark.range(n).withColumnRenamed("id", "rn")
    folds = SP.purged_folds(rows, "rn", n, 5, 0.02, 3).collect()
    for f in range(5):
        test = sorted(r.rn for r in folds if r.fold == f and r.role == "test")
        train = {r.rn for r in folds if r.fold == f and r.role == "train"}
        assert not train & set(range(test[0] - 3, test[-1] + 1 + 2 + 3))
    assert sorted(r.rn for r in folds if r.role == "test") == list(range(n))
    assert SP.combinatorial_folds(rows, "rn", n).select("combo").distinct().count() == 15


def test_backtest_by_hand():
    got = SM.run_backtest(["long", "hold", "close"], np.array([100.0, 110.0, 110.0]), np.array([0.5, 0.5, 0.5]), 1000.0, 0.0, 0.0)
    assert got["n_trades"] == 1 and got["final_equity"] == pytest.approx(1050)
    flip = SM.run_backtest(["long", "short", "close"], np.array([100.0, 110.0, 99.0]), np.array([1.0, 1.0, 1.0]), 1000.0, 0.0, 0.0)
    assert flip["n_trades"] == 2 and flip["final_equity"] == pytest.approx(1100 * 1.1)


def test_change_point_is_found():
    rng = np.random.default_rng(1)
    m = SM.RunLengths()
    runs = [m.update(x)[1] for x in np.concatenate([rng.normal(0, 0.001, 100), rng.normal(0.05, 0.001, 50)])]
    assert runs[99] > 80 and runs[130] < 45


def test_risk_parity_weights():
    assert SM.risk_parity(np.diag([1.0, 4.0])) == pytest.approx([0.8, 0.2])
    w = SM.risk_parity(np.array([[1.0, 0.9, 0], [0.9, 1.0, 0], [0, 0, 1.0]]))
    assert w.sum() == pytest.approx(1) and (w > 0).all()


def test_stream_matches_batch(spark, tmp_path):
    bars = frame(spark, 100 + np.cumsum(np.random.default_rng(2).normal(0, 1, 60)))
    bars.select("symbol", "t", "close").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = STR.stream_change_points(spark.readStream.schema("symbol string, t long, close double").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.t: (r.change, r.run) for r in spark.table("cp").collect()}
    assert got == {r.t: (r.change, r.run) for r in SM.change_points(bars).collect()}


def test_stream_bars_drop_repeats(spark, tmp_path):
    rows = [("a", "2024-01-01 00:05:00", 1, 10.0), ("a", "2024-01-01 00:05:00", 1, 10.0), ("a", "2024-01-01 00:50:00", 2, 12.0), ("a", "2024-01-01 09:00:00", 3, 9.0)]
    spark.createDataFrame(rows, "symbol string, ts string, event_id long, price double").selectExpr("symbol", "to_timestamp(ts) AS ts", "event_id", "price", "1.0D AS amount").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = STR.stream_bars(spark.readStream.schema("symbol string, ts timestamp, event_id long, price double, amount double").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("sb").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("sb").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(10.0, 12.0, 2.0)]
