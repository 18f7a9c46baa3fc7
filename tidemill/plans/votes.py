"""The query of votes and decisions, its inputs taken from the library's own features. It joins the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import ratio
from ..functions.storage import stored
from ..operators import votes as VO
from ..sources import tables as S
from .market import FLOW, SIGNALS, W, query
from .series import RECURRENCES, features

#: Combinations of sources that may not enter, and the least confidence.
BLOCKED, LEAST = ("EXT+MOM",), 0.45


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """A row for each bar: the signals' mean as model, their majority as agent, the momentum score, the flow's balance as outside view,
    a regime by momentum, and the sign of the next return."""
    c = F.col
    bars = S.hourly_bars(spark, d).withColumn("next", F.signum(F.lead("close").over(Window.partitionBy("symbol").orderBy("t")) - c("close"))).select("symbol", "t", "next", (3 * (ratio(c("close"), c("open")) - 1)).alias("funding_bp"))
    f = features(spark, d).select("symbol", "t", c("rsi_14").alias("rsi"), "momentum", "momentum_direction", "trend_aligned")
    s = S.signals(spark, d).groupBy("symbol", "t").agg(F.avg("signal").alias("model_value"), F.avg("confidence").alias("model_confidence"), F.abs(F.avg(F.signum("signal"))).alias("agreement"), (F.count_if(c("action") == "long") / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("n"))
    x = S.flow(spark, d).select("symbol", "t", F.coalesce(ratio(c("buy") - c("sell"), c("buy") + c("sell")), F.lit(0.0)).alias("outside_score"))
    rows = bars.join(f, ["symbol", "t"]).join(s, ["symbol", "t"]).join(x, ["symbol", "t"])
    return rows.select(
        "*", F.when(c("model_value") > 0.15, "long").when(c("model_value") < -0.15, "short").otherwise("neutral").alias("model_direction"),
        F.when(c("share") == 0.5, "close").when(c("share") > 0.5, "long").otherwise("short").alias("agent_direction"), F.greatest(c("share"), 1 - c("share")).alias("agent_confidence"),
        F.when(c("outside_score") > 0.2, "bullish").when(c("outside_score") < -0.2, "bearish").otherwise("neutral").alias("outside_direction"), F.abs("outside_score").alias("outside_confidence"),
        (F.abs("outside_score") > 0.8).alias("outside_strong"), (c("n") >= 3).alias("high_impact"),
        F.when(F.abs("momentum") > 2, "extreme_volatility").when(c("momentum") > 0.5, "trending_up").when(c("momentum") < -0.5, "trending_down").otherwise("normal").alias("regime"),
    )


def hit_multipliers(rows: DataFrame) -> DataFrame:
    """regime, source and multiplier: a half and the share of the source's directions that the next return bore out."""
    outside = F.when(F.col("outside_direction") == "bullish", "long").when(F.col("outside_direction") == "bearish", "short")
    sides = {"model": F.col("model_direction"), "agent": F.col("agent_direction"), "momentum": F.col("momentum_direction"), "outside": outside}
    each = rows.select("regime", "next", F.explode(F.array(*[F.struct(F.lit(k).alias("source"), v.alias("side")) for k, v in sides.items()])).alias("s")).select("regime", "next", "s.*").filter("side IN ('long', 'short') AND next IS NOT NULL")
    hit = F.when(F.col("side") == "long", F.col("next") > 0).otherwise(F.col("next") < 0)
    return each.groupBy("regime", "source").agg((0.5 + F.count_if(hit) / F.count(F.lit(1))).alias("multiplier"))


def _vote(when: str, side: str, source: str, weight: str, kind: str) -> str:
    return f"CASE WHEN {when} THEN {{'side': {side}, 'source': '{source}', 'weight': CAST({weight} AS DOUBLE) * coalesce(w_{kind}, 1)}} END"


_CAST = ", ".join([
    _vote("sure", "model_direction", "ML", "model_confidence", "model"), _vote("NOT sure AND abs(model_value) > 0.1", "CASE WHEN model_value > 0 THEN 'long' ELSE 'short' END", "ML_val", "least(abs(model_value) * 2, 0.6)", "model"),
    _vote("agent_direction <> 'close' AND agent_confidence > 0.3", "agent_direction", "RL", "agent_confidence", "agent"), _vote("momentum_direction <> 'neutral' AND abs(momentum) > 0.15", "momentum_direction", "MOM", "abs(momentum)", "momentum"),
    _vote("rsi < 30", "'long'", "RSI_extreme", "(30 - rsi) / 30 * 0.5", "rsi"), _vote("rsi > 70", "'short'", "RSI_extreme", "(rsi - 70) / 30 * 0.5", "rsi"),
    _vote("od IS NOT NULL AND abs(x) > 0.1", "od", "EXT", "abs(x)", "outside"),
])
_KINDS = ("model", "agent", "momentum", "outside")

DECISIONS = f"""{RECURRENCES}, {SIGNALS.removeprefix("WITH ")}, {FLOW.removeprefix("WITH ")},
b AS (SELECT symbol, t, sign(lead(close) OVER ({W}) - close) AS next, 3 * (close / nullif(open, 0) - 1) AS funding FROM bars),
fe AS (SELECT symbol, t, rsi_14 AS rsi, momentum, CASE WHEN momentum > 0.1 THEN 'long' WHEN momentum < -0.1 THEN 'short' ELSE 'neutral' END AS momentum_direction, close > num50 / den50 AS above, close < num50 / den50 AS below FROM z),
sg AS (SELECT symbol, t, avg(signal) AS model_value, avg(confidence) AS model_confidence, abs(avg(sign(signal))) AS agreement, count(*) FILTER (action = 'long') / count(*)::DOUBLE AS share, count(*) AS n FROM signals GROUP BY 1, 2),
ro AS (SELECT b.*, fe.* EXCLUDE (symbol, t), sg.* EXCLUDE (symbol, t), coalesce((buy - sell) / nullif(buy + sell, 0), 0) AS x FROM b JOIN fe ON b.symbol = fe.symbol AND b.t = fe.t JOIN sg ON b.symbol = sg.symbol AND b.t = sg.t JOIN flow ON b.symbol = flow.symbol AND b.t = flow.t),
inp AS (SELECT *, CASE WHEN model_value > 0.15 THEN 'long' WHEN model_value < -0.15 THEN 'short' ELSE 'neutral' END AS model_direction, CASE WHEN share = 0.5 THEN 'close' WHEN share > 0.5 THEN 'long' ELSE 'short' END AS agent_direction, greatest(share, 1 - share) AS agent_confidence,
 CASE WHEN x > 0.2 THEN 'long' WHEN x < -0.2 THEN 'short' END AS od, CASE WHEN abs(momentum) > 2 THEN 'extreme_volatility' WHEN momentum > 0.5 THEN 'trending_up' WHEN momentum < -0.5 THEN 'trending_down' ELSE 'normal' END AS regime FROM ro),
h AS (SELECT regime, unnest([{{'k': 'model', 's': model_direction}}, {{'k': 'agent', 's': agent_direction}}, {{'k': 'momentum', 's': momentum_direction}}, {{'k': 'outside', 's': od}}], recursive := true), next FROM inp),
mu AS (SELECT regime, k, 0.5 + count(*) FILTER (CASE WHEN s = 'long' THEN next > 0 ELSE next < 0 END) / count(*)::DOUBLE AS m FROM h WHERE s IN ('long', 'short') AND next IS NOT NULL GROUP BY 1, 2),
wt AS (SELECT regime AS wr, {", ".join(f"max(m) FILTER (k = '{k}') AS w_{k}" for k in _KINDS)}, NULL::DOUBLE AS w_rsi FROM mu GROUP BY 1),
vo AS (SELECT *, list_filter([{_CAST}], lambda v: v IS NOT NULL) AS votes FROM (SELECT *, model_direction <> 'neutral' AND model_confidence > 0.2 AS sure FROM inp LEFT JOIN wt ON wr = regime)),
co AS (SELECT *, list_filter(votes, lambda v: v.side = 'long') AS vl, list_filter(votes, lambda v: v.side = 'short') AS vs FROM vo),
pa AS (SELECT *, CASE WHEN agent_direction = 'close' THEN 'close' WHEN len(vl) >= 2 AND len(vl) > len(vs) THEN 'majority_long' WHEN len(vs) >= 2 AND len(vs) > len(vl) THEN 'majority_short' WHEN model_direction = agent_direction AND model_confidence > 0.5 AND agent_confidence > 0.5 THEN 'agreed' ELSE 'none' END AS path FROM co),
de AS (SELECT *, CASE path WHEN 'close' THEN 'close' WHEN 'majority_long' THEN 'long' WHEN 'majority_short' THEN 'short' WHEN 'agreed' THEN model_direction ELSE 'hold' END AS a0, CASE path WHEN 'majority_long' THEN vl WHEN 'majority_short' THEN vs END AS won FROM pa),
c0 AS (SELECT *, CASE WHEN path = 'close' THEN greatest(agent_confidence, model_confidence, 0.5) WHEN won IS NOT NULL THEN list_sum(list_transform(won, lambda v: v.weight)) / len(won) * 0.6 + least((len(won) - 1) * 0.1, 0.2) + 0.15 + CASE WHEN agreement > 0.5 THEN agreement * 0.1 ELSE 0 END
 WHEN path = 'agreed' THEN model_confidence * 0.35 + agent_confidence * 0.35 + agreement * 0.1 + 0.15 ELSE 0 END AS k0, CASE WHEN path = 'close' THEN ['RL_close'] WHEN path = 'agreed' THEN ['ML_strong', 'RL_strong'] WHEN won IS NOT NULL THEN list_transform(won, lambda v: v.source) ELSE [] END AS s0, a0 IN ('long', 'short') AS entry FROM de),
c1 AS (SELECT *, CASE WHEN entry AND od IS NOT NULL THEN CASE WHEN abs(x) > 0.8 THEN 'strong_' ELSE '' END || CASE WHEN a0 = od THEN 'support' ELSE 'opposition' END END AS r1, CASE WHEN entry AND ((a0 = 'long' AND momentum_direction = 'long' AND above) OR (a0 = 'short' AND momentum_direction = 'short' AND below)) THEN 'trend' END AS r2 FROM c0),
c2 AS (SELECT *, k0 * CASE r1 WHEN 'strong_support' THEN 1.2 WHEN 'strong_opposition' THEN 0.55 WHEN 'support' THEN 1.1 WHEN 'opposition' THEN 0.75 ELSE 1 END::DOUBLE * CASE WHEN r2 IS NOT NULL THEN 1.1 ELSE 1 END::DOUBLE AS k2, CASE WHEN r1 = 'strong_support' AND NOT list_contains(s0, 'EXT') THEN s0 || ['EXT_boost'] ELSE s0 END AS s2,
 CASE WHEN entry AND n >= 3 AND abs(x) > 0.4 AND a0 <> od THEN 'high_impact' END AS r3 FROM c1),
c3 AS (SELECT *, CASE WHEN entry AND r3 IS NULL THEN CASE WHEN a0 = 'short' AND funding < -1 THEN 'short_squeeze' WHEN a0 = 'long' AND funding > 3 THEN 'long_squeeze' WHEN a0 = 'short' AND funding < -0.5 AND (momentum_direction = 'long' OR coalesce(rsi < 30, false)) THEN 'short_against_rebound' WHEN a0 = 'long' AND funding > 1.5 AND (momentum_direction = 'short' OR coalesce(rsi > 70, false)) THEN 'long_against_fall' END END AS r4,
 array_to_string(list_sort(list_distinct(list_transform(s2, lambda q: split_part(q, '_', 1)))), '+') AS combination FROM c2),
c4 AS (SELECT *, CASE WHEN entry AND r3 IS NULL AND r4 IS NULL AND combination = 'EXT+MOM' THEN 'blocked_combination' END AS r5 FROM c3), c5 AS (SELECT *, CASE WHEN entry AND coalesce(r3, r4, r5) IS NULL AND k2 < 0.45 THEN 'low_confidence' END AS r6 FROM c4),
c6 AS (SELECT *, entry AND coalesce(r3, r4, r5, r6) IS NULL AS open6, entry AND coalesce(r3, r4, r5, r6) IS NULL AND regime = 'extreme_volatility' AS wild FROM c5), c7 AS (SELECT *, CASE WHEN wild THEN 'extreme_volatility' END AS r7, CASE WHEN wild AND k2 * 0.7::DOUBLE < 0.45 THEN 'too_volatile' END AS r8 FROM c6),
c8 AS (SELECT *, CASE WHEN entry AND (NOT open6 OR r8 IS NOT NULL) THEN 'hold' ELSE a0 END AS action, CASE WHEN entry AND (NOT open6 OR r8 IS NOT NULL) THEN 0 ELSE least(CASE WHEN wild THEN k2 * 0.7::DOUBLE ELSE k2 END, 1) END AS confidence FROM c7)"""


@query(f"""{DECISIONS} SELECT symbol, t, regime, path, action, len(votes) AS n_votes, combination, concat_ws('|', r1, r2, r3, r4, r5, r6, r7, r8) AS reasons, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM c8""")
def vote_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The decision of each bar, from votes weighed by how often a source was right in the regime."""
    rows = stored(inputs(spark, d))
    done = VO.decide(VO.votes(rows, hit_multipliers(rows)), F.lit(LEAST), BLOCKED)
    return done.select("symbol", "t", "regime", "path", "action", F.size("votes").alias("n_votes"), "combination", F.array_join("reasons", "|").alias("reasons"), F.round("confidence", 6).alias("confidence"))
