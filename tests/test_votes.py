"""Votes and decisions, by hand."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import votes as V

FIELDS = {
    "id": "long", "regime": "string", "model_direction": "string", "model_confidence": "double", "model_value": "double", "agent_direction": "string", "agent_confidence": "double",
    "momentum_direction": "string", "momentum": "double", "rsi": "double", "outside_direction": "string", "outside_confidence": "double", "agreement": "double", "trend_aligned": "boolean",
    "outside_score": "double", "outside_strong": "boolean", "high_impact": "boolean", "funding_bp": "double", "breakout_direction": "string", "breakout_strength": "double",
}
QUIET = {
    "regime": "normal", "model_direction": "neutral", "model_confidence": 0.1, "model_value": 0.0, "agent_direction": "hold", "agent_confidence": 0.1, "momentum_direction": "neutral", "momentum": 0.0, "rsi": 50.0,
    "outside_direction": "neutral", "outside_confidence": 0.0, "agreement": 0.0, "trend_aligned": False, "outside_score": 0.0, "outside_strong": False, "high_impact": False, "funding_bp": 0.0, "breakout_direction": "none", "breakout_strength": 0.0,
}
LONG = {"model_direction": "long", "model_confidence": 0.8, "agent_direction": "long", "agent_confidence": 0.6}
BEARISH = {"outside_direction": "bearish", "outside_confidence": 0.05, "outside_score": -0.6}
CASES = [
    ({}, "hold", 0.0, "none", "", []),
    ({"agent_direction": "close", "agent_confidence": 0.45, "model_direction": "long"}, "close", 0.5, "close", "RL", []),
    ({"agent_direction": "close", "agent_confidence": 0.3, "model_direction": "long", "model_confidence": 0.9, "rsi": 20.0}, "hold", 0.0, "none", "", []),
    (LONG, "long", 0.7 * 0.6 + 0.1 + 0.15, "majority_long", "ML+RL", []),
    (LONG | {"agreement": 0.6}, "long", 0.67 + 0.06, "majority_long", "ML+RL", []),
    (LONG | {"model_confidence": None}, "hold", 0.0, "none", "", []),
    (LONG | {"regime": "calm"}, "long", (1.6 + 0.6) / 2 * 0.6 + 0.25, "majority_long", "ML+RL", []),
    (LONG | {"outside_direction": "bullish", "outside_confidence": 0.05, "outside_strong": True}, "long", 0.67 * 1.2, "majority_long", "EXT+ML+RL", ["strong_support"]),
    (LONG | BEARISH, "long", 0.67 * 0.75, "majority_long", "ML+RL", ["opposition"]),
    (LONG | BEARISH | {"high_impact": True}, "hold", 0.0, "majority_long", "ML+RL", ["opposition", "high_impact"]),
    (LONG | {"momentum_direction": "long", "momentum": 0.1, "trend_aligned": True}, "long", 0.67 * 1.1, "majority_long", "ML+RL", ["trend"]),
    (LONG | {"funding_bp": 3.5}, "hold", 0.0, "majority_long", "ML+RL", ["long_squeeze"]),
    ({"model_value": 0.25, "breakout_direction": "long", "breakout_strength": 0.4, "rsi": 15.0}, "hold", 0.0, "majority_long", "BREAKOUT+ML+RSI", ["blocked_combination"]),
    ({"model_value": -0.11, "rsi": 71.0}, "hold", 0.0, "majority_short", "ML+RSI", ["low_confidence"]),
    (LONG | {"regime": "extreme_volatility"}, "long", 0.67 * 0.7, "majority_long", "ML+RL", ["extreme_volatility"]),
    (LONG | {"regime": "extreme_volatility", "model_confidence": 0.3, "agent_confidence": 0.55}, "hold", 0.0, "majority_long", "ML+RL", ["extreme_volatility", "too_volatile"]),
    (LONG | {"rsi": 80.0, "momentum_direction": "short", "momentum": -0.3, "agreement": 0.4}, "long", 0.8 * 0.35 + 0.6 * 0.35 + 0.04 + 0.15, "agreed", "ML+RL", []),
]


def test_decisions_by_hand(spark):
    rows = [tuple((QUIET | case | {"id": k})[f] for f in FIELDS) for k, (case, *_) in enumerate(CASES)]
    d = spark.createDataFrame(rows, ", ".join(f"{f} {t}" for f, t in FIELDS.items()))
    multipliers = spark.createDataFrame([("calm", "model", 2.0), ("calm", "model", 1.5), ("calm", None, 9.0), ("other", "agent", 0.1), (None, "agent", 5.0)], "regime string, source string, multiplier double")
    got = {r.id: r for r in V.decide(V.votes(d, multipliers), F.lit(0.4), ("BREAKOUT+ML+RSI",)).collect()}
    assert len(got) == len(CASES)
    for k, (_, action, confidence, path, combination, reasons) in enumerate(CASES):
        r = got[k]
        assert (r.action, r.path, r.combination, r.reasons) == (action, path, combination, reasons), k
        assert r.confidence == pytest.approx(confidence), k
        assert r["size"] == (r.confidence if action in ("long", "short") else 0.0)
    assert [tuple(v) for v in got[12].votes] == [("long", "ML_val", 0.5), ("long", "RSI_extreme", 0.25), ("long", "BREAKOUT", 0.4)]
    plain = V.votes(d.drop("breakout_direction", "breakout_strength")).filter("id = 12").first().votes
    assert [v.source for v in plain] == ["ML_val", "RSI_extreme"]
