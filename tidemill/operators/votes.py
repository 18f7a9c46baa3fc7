"""Votes of several sources with weights from a table, and the decision they lead to, each step with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import funding_bias

VOTE = "struct<side:string,source:string,weight:double>"
#: Least confidences and strengths that vote, and the votes that make a majority.
MODEL, AGENT, MOMENTUM, OUTSIDE, VALUE = 0.2, 0.3, 0.15, 0.10, 0.10
MAJORITY = 2


def weights(multipliers: DataFrame, regime: str = "regime", source: str = "source", value: str = "multiplier") -> DataFrame:
    """regime and ``weights``, a map from source to multiplier: one row a regime, to be joined to decisions. Of repeated rows the largest counts."""
    m = multipliers.filter(F.col(source).isNotNull() & F.col(value).isNotNull()).groupBy(regime, source).agg(F.max(value).cast("double").alias("v"))
    return m.groupBy(F.col(regime).alias("regime")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(source), F.col("v")))).alias("weights"))


def votes(rows: DataFrame, multipliers: DataFrame | None = None) -> DataFrame:
    """Add ``votes``, an array of (side, source, weight) in the order of the sources.

    Columns: regime; model_direction, model_confidence, model_value; agent_direction, agent_confidence; momentum_direction, momentum, rsi;
    outside_direction (bullish, bearish), outside_confidence; and, if there, breakout_direction, breakout_strength. A model that is not sure
    enough of its direction votes by its value. ``multipliers`` (regime, source, multiplier) scale the weights of model, agent, momentum,
    rsi, outside and breakout; a pair that it lacks has 1. Nulls do not vote.
    """
    d = rows
    if multipliers is None:
        d = d.withColumn("weights", F.lit(None).cast("map<string,double>"))
    else:
        d = d.join(weights(multipliers).withColumnRenamed("regime", "_regime"), F.col("regime") == F.col("_regime"), "left").drop("_regime")
    c = F.col

    def vote(when: Column, side: Column, source: str, weight: Column, kind: str) -> Column:
        scaled = weight * F.coalesce(F.col("weights")[kind], F.lit(1.0))
        return F.when(when, F.struct(side.alias("side"), F.lit(source).alias("source"), scaled.cast("double").alias("weight")))

    sides = ("long", "short")
    sure = F.coalesce(c("model_direction").isin(*sides) & (c("model_confidence") > MODEL), F.lit(False))
    value = c("model_value")
    outside = F.when(c("outside_direction") == "bullish", "long").when(c("outside_direction") == "bearish", "short")
    cast = [
        vote(sure, c("model_direction"), "ML", c("model_confidence"), "model"),
        vote(~sure & (F.abs(value) > VALUE), F.when(value > 0, "long").otherwise("short"), "ML_val", F.least(F.abs(value) * 2, F.lit(0.6)), "model"),
        vote(c("agent_direction").isin(*sides) & (c("agent_confidence") > AGENT), c("agent_direction"), "RL", c("agent_confidence"), "agent"),
        vote(c("momentum_direction").isin(*sides) & (F.abs("momentum") > MOMENTUM), c("momentum_direction"), "MOM", F.abs("momentum"), "momentum"),
        vote(c("rsi") < 30, F.lit("long"), "RSI_extreme", (30 - c("rsi")) / 30 * 0.5, "rsi"),
        vote(c("rsi") > 70, F.lit("short"), "RSI_extreme", (c("rsi") - 70) / 30 * 0.5, "rsi"),
        vote(outside.isNotNull() & (c("outside_confidence") > OUTSIDE), outside, "EXT", c("outside_confidence"), "outside"),
    ]
    if "breakout_direction" in rows.columns:
        cast.append(vote(c("breakout_direction").isin(*sides), c("breakout_direction"), "BREAKOUT", c("breakout_strength"), "breakout"))
    return d.withColumn("votes", F.array_compact(F.array(*cast))).drop("weights")


def combination(sources: Column) -> Column:
    """The different parts of the sources' names before an underscore, in order, joined by a plus."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.split_part(s, F.lit("_"), F.lit(1))))), "+")


def decide(rows: DataFrame, minimum: Column, blocked: tuple[str, ...] = (), majority: int = MAJORITY) -> DataFrame:
    """Add action, confidence, path, sources (that confirm it), combination and reasons to rows with ``votes``.

    Further columns: those of ``votes``; agreement, trend_aligned, outside_score, outside_strong, high_impact, and funding_bp. An agent that
    closes, closes if it is sure or the model neutral. Else a side wins that has ``majority`` votes and more than the other; else model and agent,
    if both are surer than 0.5 of one side. Outside views and the trend scale the confidence; events of high impact, the funding rate,
    ``blocked`` combinations, ``minimum`` and extreme volatility turn an entry into a hold. ``reasons`` has what happened, in order.
    """
    c = F.col
    mine = lambda side: F.filter("votes", lambda v: v["side"] == side)
    d = rows.withColumns({"_long": mine("long"), "_short": mine("short")})
    more = lambda a, b: (F.size(a) >= majority) & (F.size(a) > F.size(b))
    both_sure = c("model_direction").isin("long", "short") & (c("agent_direction") == c("model_direction")) & (c("model_confidence") > 0.5) & (c("agent_confidence") > 0.5)
    closes = F.coalesce(c("agent_direction") == "close", F.lit(False))
    path = (
        F.when(closes & F.coalesce((c("agent_confidence") > 0.4) | (c("model_direction") == "neutral"), F.lit(False)), "close").when(closes, "none")
        .when(more("_long", "_short"), "majority_long").when(more("_short", "_long"), "majority_short").when(F.coalesce(both_sure, F.lit(False)), "agreed").otherwise("none")
    )
    d = d.withColumn("path", path).withColumn("_won", F.when(c("path") == "majority_long", c("_long")).when(c("path") == "majority_short", c("_short")))
    n = F.size("_won")
    mean = F.try_divide(F.aggregate("_won", F.lit(0.0), lambda s, v: s + v["weight"]), n.cast("double"))
    bonus = F.when(c("agreement") > 0.5, c("agreement") * 0.10).otherwise(0.0)
    confidence = (
        F.when(c("path") == "close", F.greatest(c("agent_confidence"), c("model_confidence"), F.lit(0.5)))
        .when(c("path").startswith("majority"), mean * 0.60 + F.least((n - 1) * 0.10, F.lit(0.20)) + 0.15 + bonus)
        .when(c("path") == "agreed", c("model_confidence") * 0.35 + c("agent_confidence") * 0.35 + F.coalesce("agreement", F.lit(0.0)) * 0.10 + 0.15).otherwise(0.0)
    )
    action = F.when(c("path") == "close", "close").when(c("path") == "majority_long", "long").when(c("path") == "majority_short", "short").when(c("path") == "agreed", c("model_direction")).otherwise("hold")
    sources = F.when(c("path") == "close", F.array(F.lit("RL_close"))).when(c("path") == "agreed", F.array(F.lit("ML_strong"), F.lit("RL_strong"))).when(c("_won").isNotNull(), F.transform("_won", lambda v: v["source"])).otherwise(F.array().cast("array<string>"))
    d = d.withColumns({"confidence": confidence, "action": action, "sources": sources, "reasons": F.array().cast("array<string>")}).drop("_long", "_short", "_won")

    def scaled(d: DataFrame, why: Column, factors: dict[str, float]) -> DataFrame:
        d = d.withColumn("_why", F.when(c("action").isin("long", "short"), why))
        factor = F.coalesce(*[F.when(c("_why") == k, f) for k, f in factors.items()], F.lit(1.0))
        return d.withColumns({"confidence": c("confidence") * factor, "reasons": F.when(c("_why").isNotNull(), F.array_append("reasons", c("_why"))).otherwise(c("reasons"))}).drop("_why")

    def held(d: DataFrame, why: Column) -> DataFrame:
        d = d.withColumn("_why", F.when(c("action").isin("long", "short"), why))
        stop = c("_why").isNotNull()
        return d.withColumns({"action": F.when(stop, "hold").otherwise(c("action")), "confidence": F.when(stop, 0.0).otherwise(c("confidence")), "reasons": F.when(stop, F.array_append("reasons", c("_why"))).otherwise(c("reasons"))}).drop("_why")

    with_it = ((c("action") == "long") & (c("outside_direction") == "bullish")) | ((c("action") == "short") & (c("outside_direction") == "bearish"))
    view = F.when(c("outside_direction").isin("bullish", "bearish"), F.concat(F.when(c("outside_strong"), "strong_").otherwise(""), F.when(with_it, "support").otherwise("opposition")))
    d = d.withColumn("sources", F.when(c("action").isin("long", "short") & (view == "strong_support") & ~F.array_contains("sources", "EXT"), F.array_append("sources", F.lit("EXT_boost"))).otherwise(c("sources")))
    d = scaled(d, view, {"strong_support": 1.20, "strong_opposition": 0.55, "support": 1.10, "opposition": 0.75})
    d = scaled(d, F.when(c("trend_aligned") & (c("momentum_direction") == c("action")), "trend"), {"trend": 1.10})
    against = ((c("action") == "long") & (c("outside_direction") == "bearish")) | ((c("action") == "short") & (c("outside_direction") == "bullish"))
    d = held(d, F.when(c("high_impact") & (F.abs("outside_score") > 0.4) & against, "high_impact"))
    d = held(d, funding_bias(c("action"), c("funding_bp"), c("momentum_direction"), c("rsi")))
    d = d.withColumn("combination", combination(c("sources")))
    if blocked:
        d = held(d, F.when(c("combination").isin(*blocked), "blocked_combination"))
    d = held(d, F.when(c("confidence") < minimum, "low_confidence"))
    d = scaled(d, F.when(c("regime") == "extreme_volatility", "extreme_volatility"), {"extreme_volatility": 0.7})
    d = held(d, F.when((c("regime") == "extreme_volatility") & (c("confidence") < minimum), "too_volatile"))
    return d.withColumns({"confidence": F.least("confidence", F.lit(1.0)), "size": F.when(c("action").isin("long", "short"), F.least("confidence", F.lit(1.0))).otherwise(0.0)})
