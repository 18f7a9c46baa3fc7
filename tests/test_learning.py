"""Adjustment maps, histories with a retention, nested snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import adjustments as A
from tidemill.operators import health as He
from tidemill.operators import histories as H

TRADES = "mode string, id long, hour int, symbol string, regime string, side string, strength string, agreed boolean, pnl double"


def test_feedback_maps(spark):
    rows = [("P", k, 3 if k < 6 else 4, "s", "calm" if k < 6 else "wild", "long" if k < 11 else "short", "weak", k % 2 == 0, -1.0 if k < 11 else 2.0) for k in range(12)]
    rows += [("P", 20 + k, 5, "s", None, "short", None, None, -1.0) for k in range(4)] + [("few", k, 1, "s", "r", "long", "weak", True, -1.0) for k in range(9)]
    got = {r["mode"]: r.adjustments for r in A.feedback_adjustments(spark.createDataFrame(rows, TRADES)).collect()}
    assert set(got) == {"P"}
    want = {"avoid_hour_3": 1.0, "avoid_hour_4": 1.0, "direction_scale_long": 0.5, "losing_streak_scale": 0.4, "min_signal_strength": 0.2, "regime_scale_calm": 0.3, "regime_scale_wild": 0.3}
    assert got["P"] == pytest.approx(want)


def test_daily_maps(spark):
    rows = [("P", k, k % 4, "ab"[k % 2], "r", "long", "weak", True, [-3.0, 2.0, -1.0, 2.5][k % 4]) for k in range(24)]
    got = A.daily_adjustments(spark.createDataFrame(rows, TRADES)).head().adjustments
    assert got == {"avoid_hour_0": 1.0, "avoid_hour_2": 1.0, "boost_hour_1": 1.2, "boost_hour_3": 1.2, "scale_a": 0.5, "scale_b": 1.3, "rr_ratio": pytest.approx(1.12)}
    assert A.daily_adjustments(spark.createDataFrame(rows[:9], TRADES)).collect() == []


def test_merged_maps_and_scales(spark):
    maps = [
        (1, {"global_scale": 1.45, "scale_a": 0.5, "losing_streak_scale": 0.95}, {"global_step": 0.1, "scale_a": 1.3}), (2, {"global_scale": 0.35}, {"global_step": -0.1}), (3, None, {"global_step": -0.1, "avoid_hour_2": 1.0}),
        (4, {"losing_streak_scale": 0.7}, {"losing_streak_scale": 0.4}), (5, None, None),
    ]
    d = spark.createDataFrame(maps, "k int, old map<string,double>, new map<string,double>").withColumn("m", A.merged(F.col("old"), F.col("new")))
    got = {r.k: {k: round(v, 9) for k, v in r.m.items()} for r in d.collect()}
    assert got == {1: {"global_scale": 1.5, "scale_a": 1.3, "losing_streak_scale": 1.0}, 2: {"global_scale": 0.3}, 3: {"global_scale": 0.9, "avoid_hour_2": 1.0}, 4: {"losing_streak_scale": 0.4}, 5: {}}
    assert {r.k: json.loads(r.j) for r in d.select("k", F.to_json("m").alias("j")).collect()}[2] == {"global_scale": 0.3}
    s = d.select("k", A.position_scale(F.col("m"), F.lit("a"), F.lit(2)).alias("s")).collect()
    assert {r.k: round(r.s, 9) for r in s} == {1: 1.95, 2: 0.3, 3: 0.0, 4: 1.0, 5: 1.0}


def test_histories_keep_the_newest_and_repeat_nothing(spark, tmp_path):
    schema, path, to = "source string, t long, v double", str(tmp_path / "h"), str(tmp_path / "c")
    batch = lambda lo, hi: spark.createDataFrame([("ab"[t % 2], t, float(t)) for t in range(lo, hi)], schema)
    sink = H.appender(path, ["source"], ["t"], 10)
    for number, (lo, hi) in enumerate([(0, 30), (30, 36), (20, 25)]):
        sink(batch(lo, hi), number)
    read = lambda p: sorted((r.source, r.t, r.v) for r in H.history(spark, p, schema, ["source"], ["t"], 10).collect())
    want = sorted(("ab"[t % 2], t, float(t)) for t in [*range(20, 36), *range(20, 25)])
    first = read(path)
    assert len(first) == 20 and set(first) <= set(want) and min(t for _, t, _ in first) >= 20
    sink(batch(30, 36), 1)
    assert read(path) == first
    H.compact(spark, path, to, schema, ["source"], ["t"], 10)
    assert read(to) == first


def test_stream_into_a_history(spark, tmp_path):
    schema, path = "source string, t long, v double", str(tmp_path / "h")
    for k in range(3):
        spark.createDataFrame([("a", t, 1.0) for t in range(10 * k, 10 * k + 10)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    s.writeStream.foreachBatch(H.appender(path, ["source"], ["t"], 12)).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.t for r in H.history(spark, path, schema, ["source"], ["t"], 12).collect()) == list(range(18, 30))


SNAPSHOT = "symbol string, t long, direction string, score double, scenarios array<struct<label:string,probability:double,value:double>>"


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1, "bullish", 0.5, [("up", 0.6, 2.0), ("down", 0.4, -1.0)]), ("a", 2, "bearish", -0.5, [])], SNAPSHOT)
    new = spark.createDataFrame([("a", 2, None, None, None), ("b", 5, "bullish", 0.1, [("x", 1.0, 3.0)])], SNAPSHOT)
    got = H.upsert_snapshots(old, new)
    assert sorted((r.symbol, r.t, r.direction, r.score, len(r.scenarios)) for r in got.collect()) == [("a", 1, "bullish", 0.5, 2), ("a", 2, "neutral", 0.0, 0), ("b", 5, "bullish", 0.1, 1)]
    hot = H.one_hot(got.withColumn("ev", H.expected(F.col("scenarios"))))
    assert "direction" not in hot.columns and sorted((r.t, r.is_bullish, r.is_bearish, round(r.ev, 9)) for r in hot.collect()) == [(1, 1.0, 0.0, 0.8), (2, 0.0, 0.0, 0.0), (5, 1.0, 0.0, 3.0)]
    bars = spark.createDataFrame([("a", t, 1.0) for t in range(4)] + [("b", 9, 1.0), ("c", 1, 1.0)], "symbol string, t long, close double")
    joined = H.gated_join(bars, hot.drop("scenarios"), least=2)
    assert {(r.symbol, r.t): (r.ext_score, r.ext_is_bullish, round(r.ext_ev, 9)) for r in joined.collect()} == {("a", 0): (0, 0, 0), ("a", 1): (0.5, 1, 0.8), ("a", 2): (0, 0, 0), ("a", 3): (0, 0, 0), ("b", 9): (0, 0, 0), ("c", 1): (0, 0, 0)}


def test_health(spark):
    rows = [("LIVE", 90, 1, 5.0)] + [("LIVE", 91 + k, 2 + k, -100.0) for k in range(5)] + [(" ", 100, 9, None), ("", 100, 10, 1.0), (None, 10, 11, 4.0), ("late", 200, 12, 1.0)]
    counted = spark.createDataFrame([("LIVE", 57), ("unknown", 3), ("PAPER", 2)], "mode string, n long")
    d = spark.createDataFrame(rows, "mode string, t long, id long, pnl double")
    got = {r["mode"]: r for r in He.health(d, counted, F.lit(100), least=3).collect()}
    assert set(got) == {"LIVE", "unknown", "PAPER"}
    live, unknown, paper = got["LIVE"], got["unknown"], got["PAPER"]
    assert (live.n, live.n_recent, live.hours_since, live.day_pnl, live.losing, live.n_mean) == (6, 6, 5.0, 0.0, 5, 6)
    assert live.mean_recent == pytest.approx(-495 / 6) and live.issues == ["losing_streak", "low_value", "count_drift"]
    assert (unknown.n, unknown.day_pnl, unknown.losing, unknown.issues) == (3, 1.0, 0, [])
    assert (paper.n, paper.hours_since, paper.issues) == (0, None, ["no_trades"])
    assert He.health(d.limit(0), counted.limit(0), F.lit(100)).collect() == []
    assert He.schema_issues(d, "mode string, t int, price double") == ["type:t", "missing:price"]
