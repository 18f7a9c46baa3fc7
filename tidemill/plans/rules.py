"""Queries of decision rules and table operations, each with its SQL. They join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback as FB
from ..operators import indicators as I
from ..operators import rules as RU
from ..operators import shaping as SH
from ..operators import signals as SG
from ..operators import sizing as SZ
from ..operators import stats as ST
from ..operators import trades as T
from ..sources import tables as S
from .market import BARS, FLOW, SIGNALS, TRADES, W, _r, _rows, out, query

VIEWS = f"""{SIGNALS}, views AS (SELECT *, signal * 4 AS funding_bp, confidence * 100 AS rsi, ['long', 'short', 'neutral'][id % 3 + 1] AS momentum, ['long', 'short', 'neutral'][id // 3 % 3 + 1] AS pattern,
  (78 + id % 15) / 100.0::DOUBLE AS similarity, (50 + id % 11) / 100.0::DOUBLE AS pattern_win_rate, (id % 21 - 10) / 100.0::DOUBLE AS ev_pct, ['bullish', 'bearish', 'neutral'][id // 7 % 3 + 1] AS mtf,
  (id % 10) / 10.0::DOUBLE AS mtf_agreement, signal AS blend_score, CASE WHEN id % 5 = 0 THEN 'ranging' ELSE 'weak_trend' END AS blend_regime FROM signals)"""


def _views(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    pick = lambda n, *x: F.get(F.array(*[F.lit(v) for v in x]), (n % len(x)).cast("int"))
    return S.signals(spark, d).withColumns({
        "funding_bp": F.col("signal") * 4, "rsi": F.col("confidence") * 100, "momentum": pick(i, "long", "short", "neutral"), "pattern": pick(F.floor(i / 3), "long", "short", "neutral"),
        "similarity": (78 + i % 15) / 100.0, "pattern_win_rate": (50 + i % 11) / 100.0, "ev_pct": (i % 21 - 10) / 100.0, "mtf": pick(F.floor(i / 7), "bullish", "bearish", "neutral"),
        "mtf_agreement": (i % 10) / 10.0, "blend_score": F.col("signal"), "blend_regime": F.when(i % 5 == 0, "ranging").otherwise("weak_trend"),
    })


@query(f"""{VIEWS}, a AS (SELECT *, CASE WHEN action = 'short' AND funding_bp < -1 THEN 'short_squeeze' WHEN action = 'long' AND funding_bp > 3 THEN 'long_squeeze'
  WHEN action = 'short' AND funding_bp < -0.5 AND (momentum = 'long' OR rsi < 30) THEN 'short_against_rebound' WHEN action = 'long' AND funding_bp > 1.5 AND (momentum = 'short' OR rsi > 70) THEN 'long_against_fall' END AS r1,
  (action = 'long' AND pattern = 'short') OR (action = 'short' AND pattern = 'long') AS conflict, (action = 'long' AND ev_pct < -0.05) OR (action = 'short' AND ev_pct > 0.05) AS adverse FROM views),
b AS (SELECT *, CASE WHEN r1 IS NULL THEN CASE WHEN conflict AND similarity >= 0.87 THEN 'pattern_conflict' WHEN adverse AND similarity >= 0.9 THEN 'pattern_adverse' WHEN (conflict OR adverse) AND similarity >= 0.8 THEN 'pattern_weak'
  WHEN pattern = action AND pattern_win_rate >= 0.56 AND similarity >= 0.88 THEN 'pattern_confirms' END END AS r2 FROM a),
c AS (SELECT *, r1 IS NOT NULL OR coalesce(r2 IN ('pattern_conflict', 'pattern_adverse'), false) AS v2, CASE r2 WHEN 'pattern_weak' THEN confidence * 0.6 WHEN 'pattern_confirms' THEN least(confidence * 1.25, 1) ELSE confidence END AS c2,
  (action = 'long' AND mtf = 'bullish') OR (action = 'short' AND mtf = 'bearish') AS agrees, (action = 'long' AND mtf = 'bearish') OR (action = 'short' AND mtf = 'bullish') AS opposes FROM b),
e AS (SELECT *, CASE WHEN NOT v2 THEN CASE WHEN opposes AND mtf_agreement >= 0.75 THEN 'mtf_veto' WHEN opposes AND mtf_agreement >= 0.5 THEN 'mtf_opposes' WHEN agrees AND mtf_agreement > 0.7 THEN 'mtf_agrees' END END AS r3 FROM c),
f AS (SELECT *, v2 OR coalesce(r3 = 'mtf_veto', false) AS v3, CASE r3 WHEN 'mtf_opposes' THEN c2 * 0.6 WHEN 'mtf_agrees' THEN least(c2 * 1.15, 1) ELSE c2 END AS c3 FROM e),
g AS (SELECT *, CASE WHEN NOT v3 AND blend_regime = 'ranging' THEN 'blend_ranging' END AS r4, CASE WHEN NOT v3 AND abs(blend_score) > 0.3 THEN CASE WHEN (action = 'long') = (blend_score > 0) THEN 'blend_agrees' ELSE 'blend_opposes' END END AS r5 FROM f),
h AS (SELECT *, c3 * CASE WHEN r4 IS NOT NULL THEN 0.6 ELSE 1 END AS c4 FROM g)
SELECT id, CASE WHEN v3 THEN 'hold' ELSE action END AS action, round(CASE WHEN v3 THEN 0 WHEN r5 = 'blend_agrees' THEN least(c4 * 1.15, 1) WHEN r5 = 'blend_opposes' THEN c4 * 0.7 ELSE c4 END, 6) AS confidence, concat_ws('|', r1, r2, r3, r4, r5) AS reasons FROM h""")
def decision_fusion(spark: SparkSession, d: str) -> DataFrame:
    return out(RU.fuse(_views(spark, d)), "id action reasons", "confidence")


@query(f"""{SIGNALS}, x AS (SELECT id, t, symbol, confidence * (1 - id % 4 / 10.0::DOUBLE) AS score FROM signals) SELECT t, arg_max(id, row(score, -id)) AS id, arg_max(symbol, row(score, -id)) AS symbol, round(max(score), 6) AS score FROM x GROUP BY t""")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return out(RU.best_candidate(S.signals(spark, d).withColumn("priority", F.col("id") % 4), "t"), "t id symbol", "score")


@query(f"""{BARS}, b AS (SELECT symbol, t, (close - open) / nullif(open, 0) AS x FROM bars WHERE open <> 0),
y AS (SELECT *, count(*) OVER {_rows(20)} AS n, CASE WHEN count(*) OVER {_rows(20)} >= 20 THEN avg(x) OVER {_rows(20)} ELSE x END AS ma, coalesce(avg(x) OVER ({W} ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING), 0) AS pv, stddev_pop(x) OVER {_rows(10)} AS sd FROM b)
SELECT symbol, t, round(x, 6) AS basis_pct, round(ma, 6) AS basis_ma, CASE WHEN abs(x) > 0.3 THEN 'reversal' ELSE 'momentum' END AS kind,
  round(greatest(-1, least(1, CASE WHEN abs(x) > 0.3 THEN -sign(x) * least(abs(x) / 0.6, 1) ELSE x / 0.3 + 2 * CASE WHEN n >= 10 THEN ma - pv ELSE 0 END END)), 6) AS score,
  round(CASE WHEN n >= 10 THEN least(1, greatest(0.2, 1 - 5 * sd)) ELSE 0.3 END, 6) AS confidence FROM y""")
def basis_spread(spark: SparkSession, d: str) -> DataFrame:
    """Close against open at a hundredth of their distance stands for futures against spot."""
    b = S.hourly_bars(spark, d).withColumns({"spot": F.col("open"), "futures": F.col("open") + (F.col("close") - F.col("open")) / 100})
    return out(RU.basis_spread(b), "symbol t kind", "basis_pct basis_ma score confidence")


@query(f"""{SIGNALS}, x AS (SELECT id, confidence * 50 AS a, abs(signal) * 0.1 AS b, (id % 20) / 10.0::DOUBLE AS v FROM signals),
y AS (SELECT *, CASE WHEN a > 25 AND b < 0.06 THEN 'strong_trend' WHEN a > 25 AND v > 1.5 THEN 'volatile_breakout' WHEN a < 20 AND b < 0.03 THEN 'quiet' WHEN a < 20 THEN 'ranging' ELSE 'weak_trend' END AS blend_regime FROM x)
SELECT id, blend_regime, round(CAST(CASE blend_regime WHEN 'strong_trend' THEN least(1, a / 50) WHEN 'volatile_breakout' THEN least(1, v / 3) WHEN 'quiet' THEN 0.6 WHEN 'ranging' THEN greatest(0.4, 1 - a / 20) ELSE 0.5 END AS DOUBLE), 6) AS regime_confidence,
  round(CAST(CASE blend_regime WHEN 'strong_trend' THEN 1.2 WHEN 'volatile_breakout' THEN 0.8 WHEN 'quiet' THEN 1.0 WHEN 'ranging' THEN 0.5 ELSE 0.7 END AS DOUBLE), 6) AS position_scale FROM y""")
def blend_regime(spark: SparkSession, d: str) -> DataFrame:
    s = S.signals(spark, d).withColumns({"adx": F.col("confidence") * 50, "bb_width": F.abs("signal") * 0.1, "vol_ratio": (F.col("id") % 20) / 10.0})
    return out(RU.blend_regime(s), "id blend_regime", "regime_confidence position_scale")


@query(f"""{BARS}, {S.SQL['flow']}, v AS (SELECT symbol, t, avg(coalesce(abs(buy - sell) / nullif(buy + sell, 0), 0)) OVER {_rows(50)} AS vpin, coalesce((buy - sell) / nullif(buy + sell, 0), 0) AS book FROM flow)
SELECT b.symbol, b.t, round(greatest(-1, least(1, (0.25 * book + 0.2 * sign(close - open) * 0.5 + 0.2 * (close - low) / nullif(high - low, 0)) * least(CASE WHEN vpin > 0.7 THEN 0.3 WHEN vpin > 0.4 THEN 0.7 ELSE 1 END, 0.9))), 6) AS score
FROM bars b JOIN v ON b.symbol = v.symbol AND b.t = v.t WHERE high > low""")
def combined_score(spark: SparkSession, d: str) -> DataFrame:
    v = SG.vpin(S.flow(spark, d)).withColumn("book", F.coalesce(F.try_divide(F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell")), F.lit(0.0)))
    b = S.hourly_bars(spark, d).filter("high > low").join(v, ["symbol", "t"])
    s = RU.combined_score(F.col("book"), F.signum(F.col("close") - F.col("open")), F.lit(0.5), F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0), F.col("scale"), F.lit(0.9))
    return out(b.withColumn("score", s), "symbol t", "score")


@query(f"""{BARS}, m AS (SELECT symbol, t, row_number() OVER ({W}) AS rn, sign(close - lag(close) OVER ({W})) AS s FROM bars), p AS (SELECT a.symbol, a.t, b.rn, b.s FROM m a JOIN m b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 18 AND a.rn WHERE a.rn >= 20 AND b.s <> 0),
q AS (SELECT *, lag(s) OVER (PARTITION BY symbol, t ORDER BY rn) AS ps FROM p), g AS (SELECT symbol, t, count(*) AS n, count(*) FILTER (s = ps) AS same, avg(s) AS lean FROM q GROUP BY 1, 2),
h AS (SELECT m.symbol, m.t, CASE WHEN n >= 5 THEN same / greatest(n - 1, 1)::DOUBLE ELSE 0 END AS sd, CASE WHEN n >= 5 THEN lean ELSE 0 END AS l FROM m LEFT JOIN g ON m.symbol = g.symbol AND m.t = g.t WHERE rn >= 20)
SELECT symbol, t, round(0.6 * sd + 0.4 * abs(l), 6) AS toxicity, round(sd, 6) AS same_direction, round(abs(l), 6) AS direction_bias, CASE WHEN l > 0.1 THEN 'buy' WHEN l < -0.1 THEN 'sell' ELSE 'neutral' END AS dominant FROM h""")
def flow_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return out(RU.flow_toxicity(S.hourly_bars(spark, d)), "symbol t dominant", "toxicity same_direction direction_bias")


CLUSTERS = f"""{BARS}, ev AS (SELECT symbol, CASE WHEN close < open THEN 'long' ELSE 'short' END AS side, CASE WHEN close < open THEN low ELSE high END AS price FROM bars WHERE CASE WHEN close < open THEN low ELSE high END > 0),
cl AS (SELECT symbol, side, CAST(floor(ln(price) / ln(1.05)) AS BIGINT) AS bucket, count(*) AS n, avg(price) AS price FROM ev GROUP BY 1, 2, 3)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    fell = F.col("close") < F.col("open")
    e = S.hourly_bars(spark, d).select("symbol", F.when(fell, "long").otherwise("short").alias("side"), F.when(fell, F.col("low")).otherwise(F.col("high")).alias("price")).filter("price > 0")
    return SG.price_clusters(e, 0.05)


@query(f"{CLUSTERS} SELECT symbol, side, bucket, n, round(price, 6) AS price FROM cl")
def price_clusters(spark: SparkSession, d: str) -> DataFrame:
    return out(_clusters(spark, d), "symbol side bucket n", "price")


@query(f"""{CLUSTERS}, l AS (SELECT symbol, arg_max(close, t) AS p FROM bars GROUP BY 1), x AS (SELECT cl.symbol, CASE WHEN side = 'short' THEN 'long' ELSE 'short' END AS side, n, price, p FROM cl JOIN l ON cl.symbol = l.symbol),
y AS (SELECT symbol, side, sum(n) AS total, any_value(p) AS p, arg_min(price, abs(price - p)) FILTER (CASE WHEN side = 'long' THEN price > p ELSE price < p END) AS cp, arg_min(n, abs(price - p)) FILTER (CASE WHEN side = 'long' THEN price > p ELSE price < p END) AS cn FROM x GROUP BY 1, 2),
z AS (SELECT symbol, side, cp, abs(cp - p) / nullif(p, 0) AS distance, cn / total AS share FROM y WHERE cp IS NOT NULL)
SELECT symbol, side, round(cp, 6) AS cluster_price, round(distance, 6) AS distance, round(share, 6) AS share, round(CASE WHEN distance < 0.05 AND share > 0.15 THEN least(1 + (0.05 - distance) * 6, 1.3) ELSE 1 END, 6) AS amplify FROM z""")
def cluster_targets(spark: SparkSession, d: str) -> DataFrame:
    last = S.hourly_bars(spark, d).groupBy("symbol").agg(F.max_by("close", "t").alias("last_price"))
    return out(RU.cluster_targets(_clusters(spark, d), last), "symbol side", "cluster_price distance share amplify")


@query(f"""{TRADES}, x AS (SELECT id, symbol, ['ranging', 'normal', 'extreme_volatility', 'strong_uptrend', 'other'][regime + 1] AS regime FROM trades)
SELECT id, symbol, regime, CAST(CASE regime WHEN 'ranging' THEN 0.3 WHEN 'extreme_volatility' THEN 0.3 WHEN 'strong_uptrend' THEN 0.1 ELSE 0.15 END AS DOUBLE) AS signal_threshold, CAST(CASE regime WHEN 'ranging' THEN 0.3 WHEN 'extreme_volatility' THEN 0.3 WHEN 'strong_uptrend' THEN 0.5 ELSE 1 END AS DOUBLE) AS position_scale,
  CAST(CASE regime WHEN 'ranging' THEN 0.8 WHEN 'extreme_volatility' THEN 2 WHEN 'strong_uptrend' THEN 1.5 ELSE 1 END AS DOUBLE) AS stop_multiple, coalesce(lag(regime) OVER (PARTITION BY symbol ORDER BY id) <> regime, false) AS changed FROM x""")
def regime_parameters(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(x) for x in ("ranging", "normal", "extreme_volatility", "strong_uptrend", "other")]), F.col("regime").cast("int"))
    t = S.trades(spark, d).select("id", "symbol", F.col("id").alias("t"), name.alias("regime"))
    return RU.regime_parameters(t).select("id", "symbol", "regime", "signal_threshold", "position_scale", "stop_multiple", "changed")


R20, R200 = _rows(20), _rows(200)


@query(f"""{BARS}, x AS (SELECT symbol, t, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r, (t % 10) / 10.0::DOUBLE AS p, CASE WHEN t % 3 = 0 THEN 'trending_up' ELSE 'mean_reverting' END AS regime FROM bars),
y AS (SELECT *, CASE WHEN count(r) OVER {R20} >= 20 THEN stddev_pop(r) OVER {R20} / (CASE WHEN count(r) OVER {R200} >= 50 THEN stddev_pop(r) OVER {R200} ELSE stddev_pop(r) OVER {R20} END + 1e-10) ELSE 1 END AS v FROM x),
z AS (SELECT *, CASE WHEN v < 0.5 THEN 'low' WHEN v < 1.5 THEN 'normal' WHEN v < 2.5 THEN 'high' ELSE 'extreme' END AS vol_class FROM y)
SELECT symbol, t, vol_class, p >= 0.6 AS blocked, round(v, 6) AS vol_ratio, round(CAST(CASE WHEN p > 0.6 THEN 0 WHEN p > 0.3 THEN 0.3 ELSE least(1.5, CASE vol_class WHEN 'low' THEN 1.3 WHEN 'normal' THEN 1 WHEN 'high' THEN 0.6 ELSE 0.3 END * CASE WHEN regime = 'trending_up' THEN 1.2 ELSE 0.8 END) END AS DOUBLE), 6) AS multiplier FROM z""")
def change_point_size(spark: SparkSession, d: str) -> DataFrame:
    b = I.returns(S.hourly_bars(spark, d), (1,)).withColumns({"change_prob": (F.col("t") % 10) / 10.0, "regime": F.when(F.col("t") % 3 == 0, "trending_up").otherwise("mean_reverting")})
    return out(RU.change_point_size(b), "symbol t vol_class blocked", "vol_ratio multiplier")


@query(f"""{TRADES}, x AS (SELECT *, t // 24 AS day, 5000 + sum(pnl - 60) OVER s AS e, count(*) FILTER (pnl - 60 >= 0) OVER s AS k FROM trades WINDOW s AS (PARTITION BY symbol ORDER BY id)),
y AS (SELECT *, greatest(max(e) OVER (PARTITION BY symbol ORDER BY id), 5000) AS peak, sum(pnl - 60) OVER (PARTITION BY symbol, day ORDER BY id) AS dp, count(*) FILTER (pnl - 60 < 0) OVER (PARTITION BY symbol, k ORDER BY id) AS losses FROM x)
SELECT id, symbol, losses, round(e, 4) AS equity, round(dp, 4) AS day_pnl, CASE WHEN losses >= 3 THEN 'cooldown' WHEN coalesce((peak - e) / nullif(peak, 0), 0) > 0.15 THEN 'drawdown' WHEN -dp / 5000 > 0.05 THEN 'daily_loss' END AS halt FROM y""")
def risk_gates(spark: SparkSession, d: str) -> DataFrame:
    t = S.trades(spark, d).withColumn("pnl", F.col("pnl") - 60)
    return out(RU.risk_gates(t, 5000.0), "id symbol losses halt", "equity day_pnl", 4)


@query(f"""{SIGNALS}, x AS (SELECT *, id % 4 AS streak, CASE WHEN id % 6 = 0 THEN 'extreme_volatility' WHEN id % 6 = 1 THEN 'trending_up' ELSE 'normal' END AS regime, 0.004 + (id % 30) / 1000.0::DOUBLE AS vol, (id % 8) / 100.0::DOUBLE AS stop FROM signals),
y AS (SELECT *, CAST(greatest(1, least(20, round_even(8.0::DOUBLE * (greatest(0.6, least(1.4, 0.6 + 1.6 * (confidence - 0.5))) * greatest(0.4, least(1.3, 0.01 / greatest(vol, 1e-9)))) * CASE regime WHEN 'extreme_volatility' THEN 0.5 WHEN 'trending_up' THEN 1.1 ELSE 1 END * CASE WHEN streak >= 2 THEN greatest(0.5, 1 - 0.1 * streak) ELSE 1 END, 0))) AS INTEGER) AS leverage FROM x)
SELECT id, leverage, CASE WHEN stop > 0 THEN least(leverage, greatest(1, CAST(floor(0.05 / stop) AS INTEGER))) ELSE leverage END AS capped FROM y""")
def leverage_steps(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    s = S.signals(spark, d).withColumns({"regime": F.when(i % 6 == 0, "extreme_volatility").when(i % 6 == 1, "trending_up").otherwise("normal"), "vol": 0.004 + (i % 30) / 1000.0, "stop": (i % 8) / 100.0})
    s = s.withColumn("leverage", SZ.leverage(8.0, F.col("confidence"), F.col("vol"), F.col("regime"), i % 4))
    return s.select("id", "leverage", RU.leverage_cap(F.col("leverage"), F.col("stop")).alias("capped"))


@query(f"""{SIGNALS}, x AS (SELECT id, 1000.0::DOUBLE + id % 500 AS equity, greatest(0.3, least(1, confidence)) AS cf, 0.002 + (id % 20) / 1000.0::DOUBLE AS atr, 0.01 + (id % 7) / 200.0::DOUBLE AS vol FROM signals),
y AS (SELECT id, greatest(0.01 * equity, least(least(0.01 * equity / (1.5 * greatest(atr, 0.003)) / 3 * cf, 1.5 * (0.2 * equity * cf * least(1, 0.02 / greatest(vol, 1e-9)))), 0.2 * equity)) AS size FROM x)
SELECT id, round(size, 4) AS size, CAST(3 AS BIGINT) AS slices, round(size / 3, 4) AS slice FROM y""")
def position_sizes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    s = S.signals(spark, d).withColumn("amount", SZ.position_size(1000.0 + i % 500, F.col("confidence"), 0.002 + (i % 20) / 1000.0, 0.01 + (i % 7) / 200.0, F.lit(3)))
    sliced = SZ.twap_slices(s, 3).groupBy("id").agg(F.count(F.lit(1)).alias("slices"), F.sum("amount").alias("size"), F.max("amount").alias("slice"))
    return out(sliced, "id slices", "size slice", 4)


@query(f"""{SIGNALS}, x AS (SELECT id, -(id % 13) / 1000.0::DOUBLE AS f, signal / 10 AS p FROM signals), y AS (SELECT id, CASE WHEN f <= -0.005 AND p >= 0.01 THEN 'take_profit' WHEN f <= -0.01 AND p > 0 THEN 'emergency' END AS reason FROM x) SELECT id, reason FROM y WHERE reason IS NOT NULL""")
def funding_exits(spark: SparkSession, d: str) -> DataFrame:
    return S.signals(spark, d).select("id", RU.funding_exit(-(F.col("id") % 13) / 1000.0, F.col("signal") / 10).alias("reason")).filter("reason IS NOT NULL")


@query(f"""{SIGNALS}, x AS (SELECT symbol, t, avg(signal) / 50 AS m FROM signals GROUP BY 1, 2) SELECT symbol, t, CASE WHEN m > 0.001 THEN 'long' WHEN m < -0.001 THEN 'short' ELSE 'neutral' END AS direction, round(greatest(-1, least(1, m / 0.01)), 6) AS signal FROM x""")
def pattern_signals(spark: SparkSession, d: str) -> DataFrame:
    direction, signal = RU.pattern_signal(F.col("m"))
    return S.signals(spark, d).groupBy("symbol", "t").agg((F.avg("signal") / 50).alias("m")).select("symbol", "t", direction.alias("direction"), F.round(signal, 6).alias("signal"))


@query(f"""{TRADES}, r AS (SELECT mode, pnl - 75 AS pnl, row_number() OVER (PARTITION BY mode ORDER BY t DESC, id DESC) AS r FROM trades QUALIFY r <= 10), x AS (SELECT mode, count(*) AS n, count(*) FILTER (pnl > 0 AND r <= 5) AS wins_5, count(*) FILTER (pnl > 0) AS wins FROM r GROUP BY 1)
SELECT mode, n, wins_5, wins, CASE WHEN n < 5 THEN NULL WHEN wins_5 = 0 THEN 'five_losses' WHEN n >= 8 AND wins <= 0.1 * n THEN 'few_wins' END AS pause, CASE WHEN n < 5 THEN 'stale' WHEN wins_5 >= 2 THEN 'wins' WHEN 3 <= wins THEN 'paper_wins' END AS resume FROM x""")
def pause_rules(spark: SparkSession, d: str) -> DataFrame:
    p = RU.pause_rules(S.trades(spark, d).withColumn("pnl", F.col("pnl") - 75))
    return p.withColumn("resume", RU.resume_reason(F.col("n"), F.col("wins_5"), F.col("wins"), F.lit(45)))


@query(f"{TRADES}, x AS (SELECT mode, CAST(t // 24 AS BIGINT) AS day, sum(pnl - 60) AS pnl FROM trades GROUP BY 1, 2) SELECT mode, day, round(pnl, 4) AS pnl, -pnl / 10000 > 0.03 AS paused FROM x")
def daily_pause(spark: SparkSession, d: str) -> DataFrame:
    return out(RU.daily_pause(S.trades(spark, d).withColumn("pnl", F.col("pnl") - 60), 10_000.0), "mode day paused", "pnl", 4)


@query(f"""{TRADES}, r AS (SELECT mode, t, pnl, row_number() OVER (PARTITION BY mode ORDER BY t DESC, id DESC) AS r, max(t) OVER (PARTITION BY mode) AS m FROM trades), x AS (SELECT mode, count(*) AS n, avg(pnl) AS mean, count(*) FILTER (pnl > 0) AS wins FROM r WHERE r <= 20 AND t > m - 168 GROUP BY 1)
SELECT mode, n, wins, round(mean, 4) AS mean, CASE WHEN n < 10 THEN 'unknown' WHEN mean < 0 THEN 'pause' ELSE 'run' END AS state FROM x""")
def recent_value(spark: SparkSession, d: str) -> DataFrame:
    return out(RU.recent_value(S.trades(spark, d)), "mode n wins state", "mean", 4)


AB = f"""{TRADES}, s AS (SELECT count(pnl) FILTER (variant = 'PAPER_MACRO_ON') AS na, avg(pnl) FILTER (variant = 'PAPER_MACRO_ON') AS ma, var_samp(pnl) FILTER (variant = 'PAPER_MACRO_ON') AS va, count(pnl) FILTER (variant = 'PAPER_MACRO_OFF') AS nb,
  avg(pnl) FILTER (variant = 'PAPER_MACRO_OFF') AS mb, var_samp(pnl) FILTER (variant = 'PAPER_MACRO_OFF') AS vb FROM trades),
u AS (SELECT na, nb, (ma - mb) / sqrt(va / na + vb / nb) AS t, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM s), k AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS k FROM u),
q AS (SELECT *, 2 * exp(-t * t / 2) / sqrt(2 * pi()) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) AS p FROM k)"""


@query(f"""{AB} SELECT na AS n_a, nb AS n_b, round(p, 6) AS p, CASE WHEN na < 100 OR nb < 100 THEN 'insufficient_data' WHEN p < 0.05 AND abs(d) >= 0.3 THEN 'significant' WHEN p < 0.05 THEN 'small_effect' ELSE 'not_significant' END AS significance,
  CASE WHEN na >= 100 AND nb >= 100 AND p < 0.05 AND abs(d) >= 0.3 THEN CASE WHEN d > 0 THEN 'a' ELSE 'b' END END AS winner, na >= 100 AND nb >= 100 AND p < 0.05 AND abs(d) >= 0.3 AS stop FROM q""")
def ab_verdict(spark: SparkSession, d: str) -> DataFrame:
    x = RU.ab_verdict(ST.compare_two(S.trades(spark, d), "pnl", "variant", "PAPER_MACRO_ON", "PAPER_MACRO_OFF"))
    return out(x, "n_a n_b significance winner stop", "p")


@query(f"""{TRADES}, r AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY pnl, id) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM trades) SELECT symbol, any_value(n) AS n, round(avg(-pnl), 4) AS cvar FROM r WHERE n >= 20 AND r <= n - floor(n * (1 - 0.05)) GROUP BY 1""")
def tail_penalty(spark: SparkSession, d: str) -> DataFrame:
    return out(RU.tail_penalty(S.trades(spark, d), ["symbol"], "pnl", "id"), "symbol n", "cvar", 4)


@query(f"{TRADES} SELECT id, round(CASE WHEN pnl < 0 THEN pnl - 0.5 * abs(pnl) ELSE pnl END, 4) AS reward FROM trades")
def shaped_rewards(spark: SparkSession, d: str) -> DataFrame:
    return S.trades(spark, d).select("id", F.round(RU.shaped_reward(F.col("pnl"), F.lit(0.5)), 4).alias("reward"))


@query(f"""{TRADES}, x AS (SELECT symbol, regime, side, count(*) AS n, CAST(sum(CAST(pnl - 130 AS DECIMAL(18, 6))) AS DOUBLE) AS total, count(*) FILTER (pnl > 130) / count(*)::DOUBLE AS win_rate FROM trades GROUP BY 1, 2, 3)
SELECT symbol, regime, side, n, {_r('total win_rate', 4)} FROM x WHERE n >= 5 AND win_rate < 0.25 AND total < 0""")
def strict_blacklist(spark: SparkSession, d: str) -> DataFrame:
    """The blacklist with its own thresholds, over results lowered so that some combinations fall under it."""
    return out(T.blacklist(S.trades(spark, d).withColumn("pnl", F.round(F.col("pnl") - 130, 2))), "symbol regime side n", "total win_rate", 4)


@query("""SELECT coalesce(a.u, b.u) AS user_id, CASE WHEN b.u IS NULL THEN 'orphan' ELSE 'ghost' END AS state FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 7 <> 0) a
FULL JOIN (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 5 <> 0) b ON a.u = b.u WHERE a.u IS NULL OR b.u IS NULL""")
def two_sided_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Positions one side lacks, with inputs that leave orphans as well as ghosts."""
    e = S.load(spark, d, "events")
    return T.mode_reconciliation(e.filter("user_id % 7 <> 0"), e.filter("user_id % 5 <> 0"), "user_id")


@query(f"""{VIEWS}, x AS (SELECT id, CASE WHEN action = 'short' AND funding_bp < -1 THEN 'short_squeeze' WHEN action = 'long' AND funding_bp > 3 THEN 'long_squeeze' WHEN action = 'short' AND funding_bp < -0.5 AND (momentum = 'long' OR rsi < 30) THEN 'short_against_rebound'
  WHEN action = 'long' AND funding_bp > 1.5 AND (momentum = 'short' OR rsi > 70) THEN 'long_against_fall' END AS reason FROM views), y AS (SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1) SELECT reason, n, round(n / sum(n) OVER (), 6) AS share FROM y""")
def block_reasons(spark: SparkSession, d: str) -> DataFrame:
    v = _views(spark, d).withColumn("reason", RU.funding_bias(F.col("action"), F.col("funding_bp"), F.col("momentum"), F.col("rsi")))
    return out(SG.block_reasons(v), "reason n", "share")


@query(f"""{TRADES}, x AS (SELECT symbol, min(t) % 300 AS age_hours, count(*) AS n, 100.0 * count(*) FILTER (pnl > 60) / count(*) AS win_rate, sum(pnl - 60) AS net, count(*) * 10.0 AS volume FROM trades GROUP BY symbol)
SELECT symbol, CASE WHEN age_hours < 120 THEN NULL WHEN n >= 8 AND win_rate < 35 AND net < 0 THEN 'results' WHEN volume < 100 THEN 'volume' END AS eject FROM x""")
def universe_rotation(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    s = S.trades(spark, d).groupBy("symbol").agg((F.min("t") % 300).alias("age_hours"), n.alias("n"), (100.0 * F.count_if(F.col("pnl") > 60) / n).alias("win_rate"), F.sum(F.col("pnl") - 60).alias("net"), (n * 10.0).alias("volume"))
    return FB.rotation(s, 100).select("symbol", "eject")


# Table operations


@query("""SELECT event_type AS symbol, event_id AS id, coalesce(nullif(value, 0), 1.0) AS ratio, coalesce(CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 1000 END, 0) AS funding FROM events QUALIFY ts > max(ts) OVER () - INTERVAL 7 DAY""")
def recent_snapshots(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), "ts", F.col("value").alias("ratio"), F.when(F.col("event_id") % 9 != 0, F.col("value") / 1000).alias("funding"))
    return SH.recent(SH.with_defaults(e, {"ratio": 1.0, "funding": 0.0}), "ts", 7).select("symbol", "id", "ratio", "funding")


@query(f"{BARS} SELECT symbol, t, close FROM bars QUALIFY (row_number() OVER ({W}) - 1) % 12 = 0")
def thinned_bars(spark: SparkSession, d: str) -> DataFrame:
    return SH.every(S.hourly_bars(spark, d), 12).select("symbol", "t", "close")


@query(f"""{BARS}, x AS (SELECT symbol, t, close / nullif(lag(close, 5) OVER ({W}), 0) - 1 AS r5, {'close / nullif(lag(close, 20) OVER (' + W + '), 0) - 1'} AS r20 FROM bars) SELECT symbol, t, {_r('r5 r20')} FROM x WHERE r5 IS NOT NULL AND r20 IS NOT NULL""")
def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    b = I.returns(S.hourly_bars(spark, d), (5, 20)).select("symbol", "t", F.col("returns_5").alias("r5"), F.col("returns_20").alias("r20"))
    return out(SH.complete(b), "symbol t", "r5 r20")


@query("""SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp FROM events WHERE event_id % 10 = 0 OR date_trunc('second', ts) >= TIMESTAMP '2024-01-20'""")
def parse_or_keep(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("stamp"))
    return SH.since_or_unparsed(e, "stamp", "2024-01-20 00:00:00")


@query("""WITH x AS (SELECT event_type || CASE WHEN user_id % 2 = 0 THEN '/USDT' ELSE '/BTC' END AS symbol, value FROM events) SELECT split_part(symbol, '/', 1) AS base, count(*) AS n, round(sum(value), 4) AS volume FROM x WHERE symbol LIKE '%/USDT' AND split_part(symbol, '/', 1) <> 'view' GROUP BY 1""")
def quoted_symbols(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "events").select(F.concat("event_type", F.when(F.col("user_id") % 2 == 0, "/USDT").otherwise("/BTC")).alias("symbol"), "value")
    x = SH.quoted(e, "/USDT", ("view",)).groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("volume"))
    return out(x, "base n", "volume", 4)


@query("""WITH x AS (SELECT event_type AS config, '{"limit": ' || CAST(count(*) AS VARCHAR) || ', "name": "' || event_type || '"}' AS j FROM events GROUP BY event_type) SELECT config, substring(md5(j), 1, 12) AS hash FROM x""")
def config_hash(spark: SparkSession, d: str) -> DataFrame:
    c = S.load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("limit"))
    return c.select(F.col("event_type").alias("config"), SH.config_hash({"name": F.col("event_type"), "limit": F.col("limit")}).alias("hash"))


@query(f"{TRADES} SELECT count(*) FILTER (mode = 'PAPER') AS n_left, count(*) FILTER (mode = 'LIVE') AS n_right, count(*) FILTER (mode = 'PAPER') - count(*) FILTER (mode = 'LIVE') AS gap, abs(count(*) FILTER (mode = 'PAPER') - count(*) FILTER (mode = 'LIVE')) > 50 AS drifted FROM trades")
def count_drift(spark: SparkSession, d: str) -> DataFrame:
    t = S.trades(spark, d)
    return SH.count_drift(t.filter("mode = 'PAPER'"), t.filter("mode = 'LIVE'"))


@query(f"""{BARS}, m AS (SELECT symbol, avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv FROM bars GROUP BY 1) SELECT b.symbol, t, round((close - mc) / (sc + 1e-8), 6) AS close, round((volume - mv) / (sv + 1e-8), 6) AS volume FROM bars b JOIN m ON b.symbol = m.symbol""")
def normalised_columns(spark: SparkSession, d: str) -> DataFrame:
    return out(SH.normalise(S.hourly_bars(spark, d), ["close", "volume"], "symbol"), "symbol t", "close volume")


@query(f"""{BARS}, x AS (SELECT symbol, t, close, list(close) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS l, count(close) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS n FROM bars) SELECT symbol, t, round(close, 6) AS label, CAST(n AS INTEGER) AS size, round(l[1], 6) AS oldest, round(l[60], 6) AS newest FROM x WHERE n = 60""")
def sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    s = SH.sequences(S.hourly_bars(spark, d), ["close"], "close", 60)
    return s.select("symbol", "t", F.round("label", 6).alias("label"), F.size("window").alias("size"), F.round(F.get(F.get("window", F.lit(0)), F.lit(0)), 6).alias("oldest"), F.round(F.get(F.get("window", F.lit(59)), F.lit(0)), 6).alias("newest"))


@query(f"{TRADES}, x AS (SELECT mode, hour FROM trades GROUP BY 1, 2 HAVING avg(pnl - 50) < 0) SELECT mode, array_to_string(list(hour ORDER BY hour), ',') AS hours FROM x GROUP BY 1")
def bad_hours(spark: SparkSession, d: str) -> DataFrame:
    return SH.bad_hours(S.trades(spark, d).withColumn("pnl", F.col("pnl") - 50)).select("mode", F.array_join(F.transform("hours", lambda h: h.cast("string")), ",").alias("hours"))


@query(f"""{TRADES}, {S.SQL['signals']} SELECT CASE WHEN abs(signal) < 0.2 THEN 'weak' WHEN abs(signal) < 0.4 THEN 'medium' ELSE 'strong' END AS strength, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses, round(sum(pnl), 4) AS total FROM trades JOIN signals ON trades.id = signals.id GROUP BY 1""")
def strength_buckets(spark: SparkSession, d: str) -> DataFrame:
    t = S.trades(spark, d).select("id", "pnl").join(S.signals(spark, d).select("id", "signal"), "id")
    return out(SH.strength_buckets(t), "strength wins losses", "total", 4)


@query(f"""{TRADES} SELECT coalesce(symbol, 'all') AS source, count(*) AS n, round(sum(abs(pnl)), 4) AS amount, round(sum(abs(pnl) * (100 + hour)) / nullif(sum(abs(pnl)), 0), 4) AS cost, round(sum(abs(pnl)) * 110 - sum(abs(pnl) * (100 + hour)), 2) AS unrealised FROM trades GROUP BY ROLLUP (symbol)""")
def reserve_status(spark: SparkSession, d: str) -> DataFrame:
    t = S.trades(spark, d).select(F.col("symbol").alias("source"), F.abs("pnl").alias("amount"), (100.0 + F.col("hour")).alias("price"))
    x = SH.reserve_status(t, 110.0)
    return x.select("source", "n", F.round("amount", 4).alias("amount"), F.round("cost", 4).alias("cost"), F.round("unrealised", 2).alias("unrealised"))


@query(f"{TRADES} SELECT count(*) AS n, round(100.0 * count(*) FILTER (pnl > 0) / count(*), 4) AS win_rate, round(sum(pnl), 2) AS total, round(max(pnl), 4) AS best, round(min(pnl), 4) AS worst, round(100 * sum(pnl) / 10000, 4) AS return_pct FROM trades WHERE mode = 'PAPER'")
def paper_summary(spark: SparkSession, d: str) -> DataFrame:
    x = SH.account_summary(S.trades(spark, d).filter("mode = 'PAPER'"), 10_000.0)
    return x.select("n", F.round("win_rate", 4).alias("win_rate"), F.round("total", 2).alias("total"), F.round("best", 4).alias("best"), F.round("worst", 4).alias("worst"), F.round("return_pct", 4).alias("return_pct"))


@query(f"""{BARS}, p AS (SELECT x.symbol AS a, y.symbol AS b, x.t, x.close - y.close AS s FROM bars x JOIN bars y ON x.t = y.t AND x.symbol < y.symbol), l AS (SELECT a, b, s - lag(s) OVER w AS d, lag(s) OVER w AS q FROM p WINDOW w AS (PARTITION BY a, b ORDER BY t)),
g AS (SELECT a, b, count(*) AS n, regr_slope(d, q) AS beta, sqrt(greatest(0, regr_syy(d, q) - regr_slope(d, q) * regr_sxy(d, q)) / (count(*) - 2) / regr_sxx(d, q)) AS se FROM l WHERE q IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT a, b, n, round(beta, 6) AS beta, round(beta / se, 4) AS t_stat, beta / se < -2.86 AS cointegrated FROM g""")
def unit_root_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = S.hourly_bars(spark, d)
    two = b.select(F.col("symbol").alias("a"), "t", F.col("close").alias("x")).join(b.select(F.col("symbol").alias("b"), F.col("t").alias("t2"), F.col("close").alias("y")), (F.col("t") == F.col("t2")) & (F.col("a") < F.col("b")))
    u = SH.unit_root(two.select("a", "b", "t", (F.col("x") - F.col("y")).alias("s")), ["a", "b"], "s", "t")
    return u.select("a", "b", "n", F.round("beta", 6).alias("beta"), F.round("t_stat", 4).alias("t_stat"), "cointegrated")
