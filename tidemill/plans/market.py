"""Market queries over the derived fixtures, each with the SQL that must return the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import bars as B
from ..operators import indicators as I
from ..operators import labels as LB
from ..operators import recursive as R
from ..operators import signals as SG
from ..operators import simulate as SM
from ..operators import sizing as SZ
from ..operators import splits as SP
from ..operators import stats as ST
from ..operators import trades as T
from ..operators import vectors as V
from ..operators.asof import asof_join
from ..sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def out(df: DataFrame, plain: str, rounded: str = "", digits: int = 6) -> DataFrame:
    """The named columns, some of them rounded."""
    return df.select(*plain.split(), *[F.round(F.col(c).cast("double"), digits).alias(c) for c in rounded.split()])


def _r(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in cols.split())


BARS, TRADES, SIGNALS, RECORDS, FLOW = (S.with_sql(n) for n in ("bars", "trades", "signals", "records", "flow"))
W = "PARTITION BY symbol ORDER BY t"
FIG = "count(*) AS n, CAST(sum(CAST(pnl AS DECIMAL(18, 6))) AS DOUBLE) AS total, CAST(sum(CAST(pnl AS DECIMAL(18, 6))) AS DOUBLE) / count(pnl) AS avg_pnl, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, count(*) FILTER (pnl > 0) / count(*)::DOUBLE AS win_rate"
FIGS = "total avg_pnl win_rate"


def _rows(n: int, w: str = W) -> str:
    return f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, x: str, agg: str) -> str:
    return f"CASE WHEN count({x}) OVER {_rows(n)} = {n} THEN {agg} OVER {_rows(n)} END"


# Bars and the bar store


@query(f"{BARS} SELECT symbol, t, open, high, low, close, volume FROM bars")
def ohlcv_bars(spark: SparkSession, d: str) -> DataFrame:
    return S.hourly_bars(spark, d)


@query(f"{BARS} SELECT symbol, t // 4 * 4 AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2")
def resampled_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.resample(S.hourly_bars(spark, d), 4)


@query(f"{BARS} SELECT symbol, t, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 50")
def latest_n_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.latest(S.hourly_bars(spark, d).select("symbol", "t", "close"), 50)


@query("SELECT event_type, user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "events").select("event_type", "user_id", "value", "event_id", F.col("event_id").alias("seq"))
    return B.dedupe(e, ["event_type", "user_id"], "seq").select("event_type", "user_id", "value", "event_id")


@query("""WITH a AS (SELECT user_id, min(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1),
b AS (SELECT user_id, max(value) AS value FROM events GROUP BY 1)
SELECT user_id, value FROM a UNION ALL SELECT user_id, value FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "events")
    first = e.agg(F.min("event_type").alias("m"))
    old = e.join(first, F.col("event_type") == F.col("m"), "left_semi").groupBy("user_id").agg(F.min("value").alias("value"))
    return B.insert_if_absent(old, e.groupBy("user_id").agg(F.max("value").alias("value")), ["user_id"])


@query(f"""{BARS}, late AS (SELECT symbol, t, close + 1 AS close FROM bars WHERE close < open)
SELECT b.symbol, b.t, coalesce(l.close, b.close) AS close FROM bars b LEFT JOIN late l ON b.symbol = l.symbol AND b.t = l.t""")
def upsert_bars(spark: SparkSession, d: str) -> DataFrame:
    b = S.hourly_bars(spark, d)
    revised = b.filter("close < open").select("symbol", "t", (F.col("close") + 1).alias("close"))
    return B.upsert(b.select("symbol", "t", "close"), revised, ["symbol", "t"])


@query(f"{BARS} SELECT symbol, t, t - lag(t) OVER ({W}) - 1 AS missing FROM bars QUALIFY t - lag(t) OVER ({W}) > 1")
def data_gaps(spark: SparkSession, d: str) -> DataFrame:
    return B.gaps(S.hourly_bars(spark, d))


# Window indicators


@query(f"""{BARS}, x AS (SELECT symbol, t, close, {_full(20, 'close', 'avg(close)')} AS bb_mid, {_full(20, 'close', 'stddev_pop(close)')} AS sd FROM bars)
SELECT symbol, t, {_r('bb_mid')}, round(bb_mid + 2 * sd, 6) AS bb_upper, round(bb_mid - 2 * sd, 6) AS bb_lower, round(4 * sd / bb_mid, 6) AS bb_width,
  round((close - (bb_mid - 2 * sd)) / (4 * sd), 6) AS bb_pct FROM x""")
def bollinger(spark: SparkSession, d: str) -> DataFrame:
    return out(I.bollinger(S.hourly_bars(spark, d)), "symbol t", "bb_mid bb_upper bb_lower bb_width bb_pct")


@query(f"""{BARS}, x AS (SELECT *, {_full(14, 'low', 'min(low)')} AS lo, {_full(14, 'high', 'max(high)')} AS hi FROM bars),
y AS (SELECT symbol, t, 100 * (close - lo) / nullif(hi - lo, 0) AS stoch_k FROM x)
SELECT symbol, t, {_r('stoch_k')}, round({_full(3, 'stoch_k', 'avg(stoch_k)')}, 6) AS stoch_d FROM y""")
def stochastic(spark: SparkSession, d: str) -> DataFrame:
    return out(I.stochastic(S.hourly_bars(spark, d)), "symbol t", "stoch_k stoch_d")


@query(f"""{BARS}, x AS (SELECT symbol, t, volume, {_full(20, 'volume', 'avg(volume)')} AS vol_sma, {_full(20, 'volume', 'stddev_samp(volume)')} AS vol_std FROM bars)
SELECT symbol, t, {_r('vol_sma vol_std')}, round(volume / vol_sma, 6) AS vol_ratio FROM x""")
def volume_profile(spark: SparkSession, d: str) -> DataFrame:
    return out(I.volume_profile(S.hourly_bars(spark, d)), "symbol t", "vol_sma vol_std vol_ratio")


@query(f"""{BARS}, x AS (SELECT symbol, t, CASE WHEN close < lag(close) OVER ({W}) THEN -volume ELSE volume END AS v FROM bars)
SELECT symbol, t, sum(v) OVER ({W}) AS obv FROM x""")
def on_balance_volume(spark: SparkSession, d: str) -> DataFrame:
    return out(I.on_balance_volume(S.hourly_bars(spark, d)), "symbol t obv")


@query(f"""{BARS}, x AS (SELECT symbol, t, abs(close / nullif(lag(close) OVER ({W}), 0) - 1) / (close * volume + 1e-10) AS a FROM bars),
y AS (SELECT symbol, t, {_full(20, 'a', 'avg(a)')} AS amihud FROM x)
SELECT symbol, t, {_r('amihud')}, round(ln(1 + amihud * 1e9), 6) AS amihud_log FROM y""")
def amihud(spark: SparkSession, d: str) -> DataFrame:
    return out(I.amihud(S.hourly_bars(spark, d)), "symbol t", "amihud amihud_log")


@query(f"""{BARS}, x AS (SELECT symbol, t, greatest(0, 0.5 * ln(nullif(high / nullif(low, 0), 0)) ** 2 - {2 * math.log(2) - 1!r} * ln(nullif(close / nullif(open, 0), 0)) ** 2) AS g, ln(nullif(high / nullif(low, 0), 0)) ** 2 / {4 * math.log(2)!r} AS p FROM bars)
SELECT symbol, t, round(sqrt({_full(20, 'g', 'avg(g)')}), 6) AS gk_vol, round(sqrt({_full(20, 'p', 'avg(p)')}), 6) AS parkinson_vol FROM x""")
def range_volatility(spark: SparkSession, d: str) -> DataFrame:
    return out(I.range_volatility(S.hourly_bars(spark, d)), "symbol t", "gk_vol parkinson_vol")


@query(f"""{BARS}, x AS (SELECT symbol, t, close / nullif(lag(close) OVER ({W}), 0) - 1 AS returns_1, close / lag(close, 5) OVER ({W}) - 1 AS returns_5, close / lag(close, 20) OVER ({W}) - 1 AS returns_20 FROM bars)
SELECT symbol, t, {_r('returns_1 returns_5 returns_20')}, round({_full(20, 'returns_1', 'stddev_samp(returns_1)')}, 6) AS volatility FROM x""")
def returns_volatility(spark: SparkSession, d: str) -> DataFrame:
    return out(I.returns(S.hourly_bars(spark, d)), "symbol t", "returns_1 returns_5 returns_20 volatility")


@query(f"""{BARS} SELECT symbol, t, round((high - low) / close, 6) AS high_low_range, round((close - open) / open, 6) AS close_open_range, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS upper_shadow,
  round((least(open, close) - low) / nullif(high - low, 0), 6) AS lower_shadow, round(abs(close - open) / nullif(high - low, 0), 6) AS body FROM bars""")
def candle_shape(spark: SparkSession, d: str) -> DataFrame:
    return out(I.candle_shape(S.hourly_bars(spark, d)), "symbol t", "high_low_range close_open_range upper_shadow lower_shadow body")


@query("""WITH x AS (SELECT event_id, hour(ts) / 24.0 AS h, (isodow(ts) - 1) / 7.0 AS w, month(ts) / 12.0 AS m, ((date_diff('day', DATE '2024-04-19', CAST(ts AS DATE)) % 1460) + 1460) % 1460 / 1460.0::DOUBLE AS c FROM events)
SELECT event_id, round(c, 6) AS cycle, round(sin(2 * pi() * h), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * w), 6) + 0.0 AS dow_cos, round(sin(2 * pi() * m), 6) + 0.0 AS month_sin, round(sin(2 * pi() * c), 6) + 0.0 AS cycle_sin FROM x""")
def time_cycles(spark: SparkSession, d: str) -> DataFrame:
    x = out(I.time_cycles(S.load(spark, d, "events")), "event_id", "cycle hour_sin dow_cos month_sin cycle_sin")
    return x.select("event_id", "cycle", *[(F.col(c) + 0.0).alias(c) for c in ("hour_sin", "dow_cos", "month_sin", "cycle_sin")])


B20 = f"({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(f"""{BARS}, x AS (SELECT *, count(close) OVER {B20} = 20 AS ready, max(high) OVER {B20} AS hi, min(low) OVER {B20} AS lo, (volume - avg(volume) OVER {B20}) / nullif(stddev_samp(volume) OVER {B20}, 0) AS z FROM bars),
y AS (SELECT symbol, t, close, CASE WHEN ready THEN hi END AS channel_high, CASE WHEN ready THEN lo END AS channel_low, CASE WHEN ready THEN z END AS volume_z FROM x)
SELECT symbol, t, channel_high, channel_low, {_r('volume_z')}, CASE WHEN close > channel_high THEN 'long' WHEN close < channel_low THEN 'short' ELSE 'none' END AS breakout FROM y""")
def donchian(spark: SparkSession, d: str) -> DataFrame:
    return out(I.donchian(S.hourly_bars(spark, d)), "symbol t channel_high channel_low breakout", "volume_z")


@query(f"""{BARS} SELECT symbol, t, round(coalesce((close - {_full(30, 'close', 'avg(close)')}) / nullif({_full(30, 'close', 'stddev_samp(close)')}, 0), 0), 6) AS zscore FROM bars""")
def rolling_zscore(spark: SparkSession, d: str) -> DataFrame:
    return out(I.rolling_zscore(S.hourly_bars(spark, d), "close"), "symbol t", "zscore")


@query(f"""{TRADES}, x AS (SELECT id, symbol, sum(pnl) OVER (PARTITION BY symbol ORDER BY id) AS cumulative FROM trades),
y AS (SELECT *, greatest(max(cumulative) OVER (PARTITION BY symbol ORDER BY id), 0) AS peak FROM x)
SELECT id, symbol, {_r('cumulative peak', 4)}, round(cumulative - peak, 4) AS drawdown FROM y""")
def drawdown_curve(spark: SparkSession, d: str) -> DataFrame:
    return out(I.drawdown(S.trades(spark, d), "pnl", "symbol", "id"), "id symbol", "cumulative peak drawdown", 4)


@query(f"""{TRADES}, x AS (SELECT id, symbol, pnl > 0 AS won, row_number() OVER (PARTITION BY symbol ORDER BY id) - row_number() OVER (PARTITION BY symbol, pnl > 0 ORDER BY id) AS g FROM trades)
SELECT id, symbol, won, row_number() OVER (PARTITION BY symbol, won, g ORDER BY id) AS streak FROM x""")
def win_loss_streaks(spark: SparkSession, d: str) -> DataFrame:
    s = I.streaks(S.trades(spark, d), F.col("pnl") > 0, "symbol", "id")
    return s.select("id", "symbol", "won", F.col("streak").cast("long").alias("streak"))


N100 = _rows(100)


@query(f"""{BARS}, x AS (SELECT symbol, t, volume, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars),
y AS (SELECT symbol, t, count(r) OVER {N100} >= 20 AS ready, [CASE WHEN abs(r) > avg(r) OVER {N100} + 3 * stddev_pop(r) OVER {N100} THEN 'price_spike' END,
  CASE WHEN volume > avg(volume) OVER {N100} + 3 * stddev_pop(volume) OVER {N100} THEN 'volume_spike' END, CASE WHEN volume / avg(volume) OVER {N100} > 2.5 THEN 'volume_high' END,
  CASE WHEN volume / avg(volume) OVER {N100} < 0.3 THEN 'volume_low' END] AS a FROM x),
z AS (SELECT symbol, t, unnest(a) AS alert FROM y WHERE ready) SELECT * FROM z WHERE alert IS NOT NULL""")
def anomaly_alerts(spark: SparkSession, d: str) -> DataFrame:
    return I.anomalies(S.hourly_bars(spark, d))


@query(f"""{BARS}, x AS (SELECT symbol, t, close, volume, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r, CAST(row_number() OVER ({W}) AS DOUBLE) AS n FROM bars),
y AS (SELECT *, stddev_pop(r) OVER {_rows(20)} AS s, CASE WHEN count(r) OVER {N100} < 100 THEN stddev_pop(r) OVER {_rows(20)} ELSE stddev_pop(r) OVER {N100} END AS l,
  corr(n, close) OVER {_rows(50)} AS c, avg(volume) OVER {_rows(5)} / avg(volume) OVER {_rows(50)} AS v FROM x)
SELECT symbol, t, CASE WHEN n < 50 THEN 'normal' WHEN s > 2 * l THEN 'extreme_volatility' WHEN c > 0.7 THEN 'trending_up' WHEN c < -0.7 THEN 'trending_down'
  WHEN abs(c) < 0.3 THEN 'ranging' WHEN v > 2 THEN 'high_volume_breakout' ELSE 'normal' END AS regime FROM y""")
def rule_regime(spark: SparkSession, d: str) -> DataFrame:
    return out(I.rule_regime(S.hourly_bars(spark, d)), "symbol t regime")


@query(f"""{BARS}, x AS (SELECT symbol, t, list(close) OVER ({W} ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS l FROM bars)
SELECT symbol, t, round(list_reduce(l, lambda e, v: e + (2.0 / 10) * (v - e)), 6) AS ema_9 FROM x""")
def ema_fold(spark: SparkSession, d: str) -> DataFrame:
    return out(R.ema(S.hourly_bars(spark, d), 9, 400), "symbol t", "ema_9")


@query()
def recursive_features(spark: SparkSession, d: str) -> DataFrame:
    return R.recursive_features(S.hourly_bars(spark, d))


# Labels and splits


@query(f"""{BARS}, x AS (SELECT symbol, t, lead(close, 12) OVER ({W}) / close - 1 AS fwd_12, lead(close, 48) OVER ({W}) / close - 1 AS fwd_48 FROM bars)
SELECT symbol, t, {_r('fwd_12 fwd_48')}, CASE WHEN fwd_12 > 0.005 THEN 2 WHEN fwd_12 < -0.005 THEN 0 ELSE 1 END AS label FROM x""")
def forward_labels(spark: SparkSession, d: str) -> DataFrame:
    return out(LB.forward_returns(S.hourly_bars(spark, d)), "symbol t label", "fwd_12 fwd_48")


TB = f"""{BARS}, a AS (SELECT symbol, t, high, low, close, row_number() OVER ({W}) AS rn, coalesce(greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))), high - low) AS tr FROM bars),
b AS (SELECT *, CASE WHEN avg(tr) OVER {_rows(14)} > 0 THEN avg(tr) OVER {_rows(14)} ELSE close * 0.01 END AS w FROM a),
c AS (SELECT b.symbol, b.t, b.close, b.close + 2 * b.w AS pt, b.close - b.w AS sl, f.rn AS frn, f.t AS ft, f.high, f.low, f.close AS fc FROM b JOIN a f ON f.symbol = b.symbol AND f.rn BETWEEN b.rn + 1 AND b.rn + 24),
e AS (SELECT symbol, t, any_value(close) AS close, any_value(pt) AS pt, any_value(sl) AS sl, min(frn) FILTER (low <= sl OR high >= pt) AS hit, arg_max(fc, frn) AS lc, max(ft) AS lt FROM c GROUP BY 1, 2),
g AS (SELECT e.*, CASE WHEN hit IS NULL THEN 'time' WHEN f.low <= sl THEN 'sl' ELSE 'pt' END AS tb_hit, f.t AS ht FROM e LEFT JOIN a f ON f.symbol = e.symbol AND f.rn = e.hit),
h AS (SELECT symbol, t, tb_hit, (CASE tb_hit WHEN 'pt' THEN pt WHEN 'sl' THEN sl ELSE lc END - close) / close AS tb_ret, coalesce(ht, lt) AS tb_t1 FROM g)"""


@query(f"{TB} SELECT symbol, t, tb_hit, tb_t1, round(tb_ret, 6) AS tb_ret, CASE WHEN tb_hit = 'pt' THEN 2 WHEN tb_hit = 'sl' THEN 0 WHEN tb_ret > 0.0025 THEN 2 WHEN tb_ret < -0.0025 THEN 0 ELSE 1 END AS tb_label FROM h")
def triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.frames import last

    b = S.hourly_bars(spark, d)
    b = b.withColumn("_tr", LB.true_range(b)).withColumn("atr", F.avg("_tr").over(last(14)))
    return out(LB.triple_barrier(b, "atr").filter("tb_hit IS NOT NULL"), "symbol t tb_hit tb_t1 tb_label", "tb_ret")


@query(f"""{BARS}, x AS (SELECT symbol, t, CASE WHEN close > open THEN 2 WHEN close < open THEN 0 ELSE 1 END AS label FROM bars),
n AS (SELECT label, count(*) AS n FROM x GROUP BY 1)
SELECT symbol, t, x.label, round((SELECT count(*) FROM x) / ((SELECT count(*) FROM n) * n.n)::DOUBLE, 6) AS weight FROM x JOIN n ON x.label = n.label""")
def sample_weights(spark: SparkSession, d: str) -> DataFrame:
    b = S.hourly_bars(spark, d).withColumn("label", F.when(F.col("close") > F.col("open"), 2).when(F.col("close") < F.col("open"), 0).otherwise(1))
    return out(LB.sample_weights(b, "label"), "symbol t label", "weight")


def _numbered(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Events numbered by id: the ids are 0 to n - 1, so no global sort is needed."""
    e = S.load(spark, d, "events").select(F.col("event_id").alias("rn"))
    return e, e.count()


@query("""WITH n AS (SELECT count(*) AS n FROM events), f AS (SELECT unnest(range(5)) AS fold), b AS (
  SELECT fold, fold * (n // 5) + least(fold, n % 5) AS a, (fold + 1) * (n // 5) + least(fold + 1, n % 5) AS b, CAST(floor(n * 0.01) AS BIGINT) AS gap FROM f, n)
SELECT event_id AS rn, CAST(fold AS INTEGER) AS fold, CASE WHEN event_id >= a AND event_id < b THEN 'test' ELSE 'train' END AS role FROM events, b
WHERE (event_id >= a AND event_id < b) OR event_id < a - 12 OR event_id >= b + gap + 12""")
def purged_folds(spark: SparkSession, d: str) -> DataFrame:
    e, n = _numbered(spark, d)
    return SP.purged_folds(e, "rn", n)


@query("""WITH n AS (SELECT count(*) AS n FROM events), f AS (SELECT unnest(range(6)) AS i), b AS (
  SELECT i, i * (n // 6) + least(i, n % 6) AS a, (i + 1) * (n // 6) + least(i + 1, n % 6) AS b, CAST(floor(n * 0.01) AS BIGINT) AS gap FROM f, n),
c AS (SELECT x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2, x.gap, row_number() OVER (ORDER BY x.i, y.i) - 1 AS combo FROM b x JOIN b y ON x.i < y.i)
SELECT combo, count(*) FILTER (test) AS n_test, count(*) FILTER (NOT test AND train) AS n_train FROM (
  SELECT combo, (event_id >= a1 AND event_id < b1) OR (event_id >= a2 AND event_id < b2) AS test, NOT ((event_id >= a1 AND event_id < b1 + gap) OR (event_id >= a2 AND event_id < b2 + gap)) AS train FROM events, c) GROUP BY combo""")
def combinatorial_folds(spark: SparkSession, d: str) -> DataFrame:
    e, n = _numbered(spark, d)
    f = SP.combinatorial_folds(e, "rn", n)
    return f.groupBy(F.col("combo").cast("long").alias("combo")).agg(F.count_if(F.col("role") == "test").alias("n_test"), F.count_if(F.col("role") == "train").alias("n_train"))


@query("""WITH n AS (SELECT count(*) AS n FROM events), f AS (SELECT unnest(range(5)) AS fold), b AS (SELECT fold, n - (5 - fold) * (n // 6) AS a, n // 6 AS size FROM f, n)
SELECT event_id AS rn, CAST(fold AS INTEGER) AS fold, CASE WHEN event_id >= a THEN 'test' ELSE 'train' END AS role FROM events, b WHERE (event_id >= a AND event_id < a + size) OR event_id < a - 12""")
def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    e, n = _numbered(spark, d)
    return SP.walk_forward(e, "rn", n)


# As-of joins


@query(f"""{BARS}, {S.SQL['signals']} SELECT s.id, s.symbol, s.action, b.t AS bar_t, b.close AS bar_close FROM signals s ASOF JOIN bars b ON s.symbol = b.symbol AND s.t >= b.t""")
def asof_signals(spark: SparkSession, d: str) -> DataFrame:
    j = asof_join(S.signals(spark, d), S.hourly_bars(spark, d).select("symbol", "t", "close"), "t", ["symbol"], prefix="bar_")
    return j.filter("bar_t IS NOT NULL").select("id", "symbol", "action", "bar_t", "bar_close")


@query(f"""{BARS}, ref AS (SELECT t, close FROM bars WHERE symbol = (SELECT min(symbol) FROM bars)), other AS (SELECT * FROM bars WHERE symbol <> (SELECT min(symbol) FROM bars))
SELECT o.symbol, o.t, r.close AS ref_close FROM other o ASOF LEFT JOIN ref r ON o.t >= r.t""")
def asof_reference(spark: SparkSession, d: str) -> DataFrame:
    b = S.hourly_bars(spark, d)
    first = b.agg(F.min("symbol")).head()[0]
    j = asof_join(b.filter(F.col("symbol") != first), b.filter(F.col("symbol") == first).select("t", "close"), "t", prefix="ref_")
    return j.select("symbol", "t", "ref_close")


@query(f"""{BARS}, {S.SQL['signals']}, f AS (SELECT symbol, t, close, lead(close, 12) OVER ({W}) AS fwd FROM bars),
j AS (SELECT s.confidence, CASE WHEN s.action = 'long' THEN fwd > close ELSE fwd < close END AS ok FROM signals s ASOF JOIN f ON s.symbol = f.symbol AND s.t >= f.t)
SELECT CAST(floor(confidence * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(CAST(ok AS INTEGER)), 6) AS accuracy FROM j WHERE ok IS NOT NULL GROUP BY 1""")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    b = S.hourly_bars(spark, d).withColumn("fwd", F.lead("close", 12).over(Window.partitionBy("symbol").orderBy("t"))).select("symbol", "t", "close", "fwd")
    j = asof_join(S.signals(spark, d), b, "t", ["symbol"], prefix="b_")
    ok = F.when(F.col("action") == "long", F.col("b_fwd") > F.col("b_close")).otherwise(F.col("b_fwd") < F.col("b_close"))
    return out(ST.reliability(j.filter(ok.isNotNull()), "confidence", ok), "bin n", "confidence accuracy")


# Trades

MODE = "coalesce(nullif(mode, ''), 'unknown')"


@query(f"{TRADES} SELECT {MODE} AS mode, count(*) AS n FROM trades GROUP BY 1")
def trade_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.trade_counts(S.trades(spark, d))


@query(f"""{TRADES}, x AS (SELECT {MODE} AS mode, {FIG}, avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl < 0) AS avg_loss, min(t) AS first_t, max(t) AS last_t FROM trades GROUP BY 1)
SELECT mode, n, wins, losses, first_t, last_t, {_r(FIGS + ' avg_win avg_loss', 4)} FROM x""")
def trade_summary(spark: SparkSession, d: str) -> DataFrame:
    return out(T.trade_summary(S.trades(spark, d)), "mode n wins losses first_t last_t", FIGS + " avg_win avg_loss", 4)


@query(f"{TRADES}, x AS (SELECT mode, hour, {FIG} FROM trades GROUP BY 1, 2) SELECT mode, hour, n, wins, losses, {_r(FIGS, 4)} FROM x")
def hourly_ev(spark: SparkSession, d: str) -> DataFrame:
    return out(T.breakdown(S.trades(spark, d), "mode", "hour"), "mode hour n wins losses", FIGS, 4)


@query(f"{TRADES}, x AS (SELECT mode, symbol, {FIG} FROM trades GROUP BY 1, 2) SELECT mode, symbol, n, wins, losses, {_r(FIGS, 4)} FROM x")
def symbol_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return out(T.breakdown(S.trades(spark, d), "mode", "symbol"), "mode symbol n wins losses", FIGS, 4)


DIMS = "SELECT pnl, unnest([{'dim': 'hour', 'key': CAST(hour AS VARCHAR)}, {'dim': 'regime', 'key': CAST(regime AS VARCHAR)}, {'dim': 'symbol', 'key': symbol}, {'dim': 'side', 'key': side}], recursive := true) FROM trades"


@query(f"""{TRADES}, u AS ({DIMS}), x AS (SELECT dim, key, {FIG}, stddev_samp(pnl) AS sd, avg(pnl) / (stddev_samp(pnl) + 1e-9) AS sharpe FROM u GROUP BY 1, 2)
SELECT dim, key, n, wins, losses, {_r(FIGS + ' sd sharpe', 4)} FROM x""")
def feedback_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return out(T.bucket_stats(S.trades(spark, d), ["hour", "regime", "symbol", "side"]), "dim key n wins losses", FIGS + " sd sharpe", 4)


@query(f"{TRADES}, x AS (SELECT symbol, {FIG} FROM trades GROUP BY ROLLUP (symbol)) SELECT symbol, n, wins, losses, {_r(FIGS, 4)} FROM x")
def overall_rollup(spark: SparkSession, d: str) -> DataFrame:
    return out(T.overall(S.trades(spark, d)), "symbol n wins losses", FIGS, 4)


@query(f"""{TRADES}, u AS ({DIMS}), x AS (SELECT dim, key, avg(pnl) AS avg_pnl FROM u GROUP BY 1, 2),
y AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY avg_pnl DESC, key) AS best, row_number() OVER (PARTITION BY dim ORDER BY avg_pnl, key) AS worst FROM x)
SELECT dim, key, CAST(best AS INTEGER) AS best, CAST(worst AS INTEGER) AS worst, {_r('avg_pnl', 4)} FROM y WHERE best <= 3 OR worst <= 3""")
def best_worst_buckets(spark: SparkSession, d: str) -> DataFrame:
    return out(T.extremes(T.bucket_stats(S.trades(spark, d), ["hour", "regime", "symbol", "side"])), "dim key best worst", "avg_pnl", 4)


@query(f"""{TRADES}, x AS (SELECT regime, side, symbol, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, avg(pnl) FILTER (pnl > 0) AS aw, avg(-pnl) FILTER (pnl < 0) AS al FROM trades WHERE pnl <> 0 GROUP BY CUBE (regime, side, symbol)),
y AS (SELECT *, wins / n::DOUBLE AS p, aw / nullif(al, 0) AS b FROM x)
SELECT CAST(regime AS VARCHAR) AS regime, side, symbol, n, wins, round(CASE WHEN n >= 10 THEN coalesce(greatest(0, (p * b - (1 - p)) / b * 0.5), 0) END, 4) AS kelly FROM y""")
def kelly_cube(spark: SparkSession, d: str) -> DataFrame:
    return out(T.kelly(S.trades(spark, d).withColumn("regime", F.col("regime").cast("string")), ["regime", "side", "symbol"]), "regime side symbol n wins", "kelly", 4)


@query(f"""{TRADES}, r AS (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC, id DESC) <= 20),
x AS (SELECT symbol, count(*) AS n, 100.0 * count(*) FILTER (pnl > 0) / count(*) AS win_rate, sum(pnl) AS net FROM r GROUP BY 1)
SELECT symbol, n, {_r('win_rate net', 4)}, CAST(CASE WHEN n < 8 THEN 1 WHEN win_rate >= 45 AND net > 0 THEN 1.3 WHEN net > 0 THEN 1.15 WHEN win_rate < 30 AND net < 0 THEN 0.5 WHEN net < 0 THEN 0.75 ELSE 1 END AS DOUBLE) AS scale FROM x""")
def recent_performance(spark: SparkSession, d: str) -> DataFrame:
    return out(T.recent_performance(S.trades(spark, d)), "symbol n scale", "win_rate net", 4)


@query(f"""{TRADES} SELECT regime || '_' || side || '_' || CASE WHEN hour < 8 THEN 'asia' WHEN hour < 16 THEN 'europe' ELSE 'us' END AS pattern, count(*) AS n, round(sum(pnl), 4) AS total FROM trades WHERE pnl < 0 GROUP BY 1""")
def loss_patterns(spark: SparkSession, d: str) -> DataFrame:
    return out(T.loss_patterns(S.trades(spark, d)), "pattern n", "total", 4)


@query(f"{TRADES}, x AS (SELECT symbol, regime, side, {FIG} FROM trades GROUP BY 1, 2, 3) SELECT symbol, regime, side, n, {_r('total win_rate', 4)} FROM x WHERE n >= 5 AND win_rate < 0.5 AND total < 100000")
def entry_blacklist(spark: SparkSession, d: str) -> DataFrame:
    b = T.breakdown(S.trades(spark, d), "symbol", "regime", "side").filter("n >= 5 AND win_rate < 0.5 AND total < 100000")
    return out(b, "symbol regime side n", "total win_rate", 4)


@query(f"""{TRADES}, x AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY t DESC, id DESC) AS r FROM trades)
SELECT symbol, coalesce(min(r) FILTER (pnl >= 0) - 1, count(*)) AS losses FROM x GROUP BY 1""")
def leading_losses(spark: SparkSession, d: str) -> DataFrame:
    return T.leading_losses(S.trades(spark, d))


@query("""SELECT coalesce(a.u, b.u) AS user_id, CASE WHEN b.u IS NULL THEN 'orphan' ELSE 'ghost' END AS state FROM (SELECT DISTINCT user_id AS u FROM events WHERE value > 100) a
FULL JOIN (SELECT DISTINCT user_id AS u FROM events WHERE value < 10) b ON a.u = b.u WHERE a.u IS NULL OR b.u IS NULL""")
def position_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "events")
    return T.mode_reconciliation(e.filter("value > 100"), e.filter("value < 10"), "user_id")


# Statistics


def _rank(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


@query(f"""{RECORDS}, x AS (SELECT source, regime, {_rank('signal', 'source, regime')} AS a, {_rank('ret', 'source, regime')} AS b FROM records WHERE ret IS NOT NULL)
SELECT source, regime, count(*) AS n, round(corr(a, b), 6) AS ic FROM x GROUP BY 1, 2""")
def spearman_ic(spark: SparkSession, d: str) -> DataFrame:
    return out(ST.spearman(S.records(spark, d), "signal", "ret", ["source", "regime"]), "source regime n", "ic")


@query(f"{RECORDS} SELECT source, count(*) FILTER (signal <> 0) AS n, round(count(*) FILTER (signal <> 0 AND sign(signal) = sign(ret)) / greatest(count(*) FILTER (signal <> 0), 1)::DOUBLE, 6) AS hit_rate FROM records WHERE ret IS NOT NULL GROUP BY 1")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return out(ST.hit_rate(S.records(spark, d), "signal", "ret", ["source"]), "source n", "hit_rate")


LAGS = (1, 3, 6, 12, 24)


@query(f"""{BARS}, x AS (SELECT symbol, close, {', '.join(f'lag(close, {k}) OVER ({W}) AS l{k}' for k in LAGS)} FROM bars),
y AS (SELECT symbol, count(*) AS n, {', '.join(f'corr(close, l{k}) AS lag_{k}' for k in LAGS)} FROM x GROUP BY 1)
SELECT symbol, n, {_r(' '.join(f'lag_{k}' for k in LAGS))}, round(CASE WHEN n >= 30 AND lag_1 > 0 AND lag_1 < 1 THEN -ln(2) / ln(lag_1) END, 4) AS half_life FROM y""")
def decay_curve(spark: SparkSession, d: str) -> DataFrame:
    x = ST.autocorrelation(S.hourly_bars(spark, d), "close", "symbol", ["t"], LAGS)
    return out(x, "symbol n", " ".join(f"lag_{k}" for k in LAGS)).join(x.select("symbol", F.round("half_life", 4).alias("half_life")), "symbol")


@query(f"""{TRADES}, x AS (SELECT variant, count(*) AS n, avg(pnl) AS mean, stddev_samp(pnl) AS sd, median(pnl) AS median, coalesce(sqrt(avg(pnl * pnl) FILTER (pnl < 0)), 0) AS downside FROM trades GROUP BY 1)
SELECT variant, n, {_r('mean sd median downside')}, round(mean / sd, 6) AS sharpe FROM x""")
def variant_stats(spark: SparkSession, d: str) -> DataFrame:
    return out(ST.sharpe(S.trades(spark, d), "pnl", ["variant"]), "variant n", "mean sd median downside sharpe")


def _cdf(x: str) -> str:
    """SQL of the approximation of the normal distribution function that ``stats.normal_cdf`` uses."""
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    tail = f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


BEST = (1 - 0.5772156649) * ST.normal_quantile(1 - 1 / 25) + 0.5772156649 * ST.normal_quantile(1 - 1 / (25 * math.e))


@query(f"""{TRADES}, m AS (SELECT symbol, regime, avg(pnl) AS mean, stddev_samp(pnl) AS sd FROM trades GROUP BY 1, 2),
g AS (SELECT symbol, regime, count(pnl) AS n, any_value(mean / nullif(sd, 0)) AS sharpe, sum((pnl - mean) ** 3) / count(pnl) / nullif(any_value(sd), 0) ** 3 AS skew, sum((pnl - mean) ** 4) / count(pnl) / nullif(any_value(sd), 0) ** 4 - 3 AS kurt
  FROM trades JOIN m USING (symbol, regime) GROUP BY 1, 2 HAVING count(pnl) >= 30),
s AS (SELECT *, sqrt(greatest(1e-12, (1 - skew * sharpe + kurt / 4 * sharpe * sharpe) / (n - 1))) AS se FROM g)
SELECT symbol, regime, n, {_r('sharpe se')}, round({_cdf('(sharpe / se)')}, 6) AS psr, round({_cdf(f'(sharpe / se - {BEST!r}::DOUBLE)')}, 6) AS dsr FROM s""")
def deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return out(ST.deflated_sharpe(S.trades(spark, d), "pnl", ["symbol", "regime"], 25), "symbol regime n", "sharpe se psr dsr")


@query(f"""{TRADES}, x AS (SELECT count(pnl) FILTER (variant = 'PAPER_MACRO_ON') AS na, avg(pnl) FILTER (variant = 'PAPER_MACRO_ON') AS ma, var_samp(pnl) FILTER (variant = 'PAPER_MACRO_ON') AS va,
  count(pnl) FILTER (variant = 'PAPER_MACRO_OFF') AS nb, avg(pnl) FILTER (variant = 'PAPER_MACRO_OFF') AS mb, var_samp(pnl) FILTER (variant = 'PAPER_MACRO_OFF') AS vb FROM trades),
y AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM x)
SELECT na AS n_a, nb AS n_b, {_r('t d')}, round(df, 3) AS df, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM y""")
def welch_cohen(spark: SparkSession, d: str) -> DataFrame:
    x = ST.compare_two(S.trades(spark, d), "pnl", "variant", "PAPER_MACRO_ON", "PAPER_MACRO_OFF")
    return x.select("n_a", "n_b", F.round("t", 6).alias("t"), F.round("d", 6).alias("d"), F.round("df", 3).alias("df"), "effect")


@query(f"""{TRADES}, x AS (SELECT variant, rank() OVER (ORDER BY pnl) + (count(*) OVER (PARTITION BY pnl) - 1) / 2.0 AS r FROM trades),
y AS (SELECT CAST(count(*) FILTER (variant = 'PAPER_MACRO_ON') AS DOUBLE) AS n_a, CAST(count(*) FILTER (variant = 'PAPER_MACRO_OFF') AS DOUBLE) AS n_b, sum(r) FILTER (variant = 'PAPER_MACRO_ON') AS ra FROM x),
tt AS (SELECT sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM trades GROUP BY pnl)),
z AS (SELECT n_a, n_b, ra - n_a * (n_a + 1) / 2 AS u, n_a + n_b AS n, ties FROM y, tt)
SELECT n_a, n_b, u, round((u - n_a * n_b / 2) / sqrt(n_a * n_b / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM z""")
def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return out(ST.mann_whitney(S.trades(spark, d), "pnl", "variant", "PAPER_MACRO_ON", "PAPER_MACRO_OFF"), "n_a n_b u", "z")


@query(f"""{TRADES}, q AS (SELECT symbol, count(pnl) AS n, count(*) FILTER (pnl < 0) AS n_losses, quantile_cont(-pnl, 0.95) FILTER (pnl < 0) AS v FROM trades GROUP BY 1)
SELECT q.symbol, any_value(n) AS n, any_value(n_losses) AS n_losses, round(any_value(v), 4) AS var, round(avg(-pnl) FILTER (-pnl >= v), 4) AS cvar FROM trades JOIN q ON trades.symbol = q.symbol GROUP BY 1""")
def cvar_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return out(ST.cvar(S.trades(spark, d), "pnl", ["symbol"]), "symbol n n_losses", "var cvar", 4)


@query(f"""{BARS}, p AS (SELECT x.symbol AS a, y.symbol AS b, x.t, x.close AS x, y.close AS y FROM bars x JOIN bars y ON x.t = y.t AND x.symbol < y.symbol),
f AS (SELECT a, b, count(*) AS n, corr(x, y) AS corr, regr_slope(x, y) AS beta FROM p GROUP BY 1, 2), s AS (SELECT p.a, p.b, t, x - beta * y AS s FROM p JOIN f ON p.a = f.a AND p.b = f.b),
l AS (SELECT *, lag(s) OVER (PARTITION BY a, b ORDER BY t) AS pv FROM s),
g AS (SELECT a, b, avg(s) AS spread_mean, stddev_pop(s) AS spread_sd, regr_slope(s - pv, pv) AS lam FROM l GROUP BY 1, 2)
SELECT f.a, f.b, n, {_r('corr beta spread_mean spread_sd')}, round(CASE WHEN lam < 0 THEN -ln(2) / lam END, 6) AS half_life FROM f JOIN g ON f.a = g.a AND f.b = g.b WHERE n >= 30""")
def hedge_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    return out(ST.pair_statistics(S.hourly_bars(spark, d), "symbol", "t", "close"), "a b n", "corr beta spread_mean spread_sd half_life")


# Scores, rules and scans


@query(f"""{FLOW}, x AS (SELECT symbol, t, avg(coalesce(abs(buy - sell) / nullif(buy + sell, 0), 0)) OVER {_rows(50)} AS vpin FROM flow)
SELECT symbol, t, {_r('vpin')}, CASE WHEN vpin > 0.7 THEN 'high' WHEN vpin > 0.4 THEN 'elevated' ELSE 'normal' END AS level FROM x""")
def vpin(spark: SparkSession, d: str) -> DataFrame:
    return out(SG.vpin(S.flow(spark, d)), "symbol t level", "vpin")


@query(f"""{FLOW}, x AS (SELECT symbol, t, coalesce((buy - sell) / nullif(buy + sell, 0), 0) AS i FROM flow),
y AS (SELECT *, avg(i) OVER {_rows(10)} AS ma, coalesce(avg(i) OVER ({W} ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING), 0) AS pv, count(*) OVER {_rows(10)} AS n,
  count(*) FILTER (i > 0) OVER {_rows(10)} AS up, count(*) FILTER (i < 0) OVER {_rows(10)} AS dn FROM x),
z AS (SELECT *, greatest(-1, least(1, 0.6 * i + 0.3 * ma + 0.5 * (ma - pv))) AS s FROM y)
SELECT symbol, t, round(i, 6) AS imbalance, round(CASE WHEN abs(i) > 0.5 THEN greatest(-1, least(1, 1.5 * s)) ELSE s END, 6) AS score,
  round(CASE WHEN n < 10 THEN 0.3 WHEN i > 0 THEN up / 10.0 WHEN i < 0 THEN dn / 10.0 ELSE (n - up - dn) / 10.0 END, 6) AS confidence FROM z""")
def orderbook_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return out(SG.imbalance_score(S.flow(spark, d)), "symbol t", "imbalance score confidence")


@query(f"""{BARS}, x AS (SELECT symbol, t, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars),
y AS (SELECT symbol, t, {_full(3, 'r', 'avg(abs(r))')} / nullif({_full(20, 'r', 'avg(abs(r))')}, 0) AS vol_ratio, {_full(3, 'r', 'avg(r)')} AS a, {_full(20, 'r', 'avg(r)')} AS b FROM x)
SELECT symbol, t, {_r('vol_ratio')}, round(greatest(0.3, least(1, 1 / greatest(1, vol_ratio))), 6) AS scale,
  round(least(1, CASE WHEN vol_ratio > 2 THEN 0.4 WHEN vol_ratio > 1.5 THEN 0.2 ELSE 0 END + CASE WHEN a * b < 0 AND abs(a) > abs(b) THEN 0.3 ELSE 0 END + 0.15 * greatest(0, vol_ratio - 1)), 6) AS risk FROM y WHERE vol_ratio IS NOT NULL""")
def crash_risk(spark: SparkSession, d: str) -> DataFrame:
    return out(SG.crash_risk(S.hourly_bars(spark, d)).filter("vol_ratio IS NOT NULL"), "symbol t", "vol_ratio scale risk")


@query(f"""{BARS}, x AS (SELECT *, (high + low + close) / 3 AS p, coalesce((close - open) / nullif(high - low, 0), 0) AS i, CASE WHEN close > lag(close) OVER ({W}) THEN volume WHEN close < lag(close) OVER ({W}) THEN -volume ELSE 0 END AS f,
  sign(close / lag(close, 5) OVER ({W}) - 1) - sign(volume / lag(volume, 5) OVER ({W}) - 1) AS divergence FROM bars),
y AS (SELECT symbol, t, close, divergence, {_full(20, 'p', 'sum(p * volume)')} / {_full(20, 'p', 'sum(volume)')} AS w, {_full(5, 'f', 'sum(f)')} / {_full(5, 'f', 'sum(volume)')} AS flow_5, {_full(10, 'i', 'avg(i)')} AS intrabar FROM x)
SELECT symbol, t, round((close - w) / w, 6) AS vwap_dev, round(flow_5, 6) AS flow_5, round(CAST(divergence AS DOUBLE), 6) AS divergence, round(intrabar, 6) AS intrabar FROM y""")
def formula_alphas(spark: SparkSession, d: str) -> DataFrame:
    return out(SG.formula_alphas(S.hourly_bars(spark, d)), "symbol t", "vwap_dev flow_5 divergence intrabar")


@query(f"""{BARS}, n AS (SELECT *, row_number() OVER ({W}) AS rn, (high + low + close) / 3 AS p FROM bars),
e AS (SELECT a.symbol, a.t, a.rn AS e, b.rn, sign(b.close - sum(b.p * b.volume) OVER w / greatest(sum(b.volume) OVER w, 1e-10)) * b.volume AS s
  FROM n a JOIN n b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 20 AND a.rn WHERE a.rn > 20 WINDOW w AS (PARTITION BY a.symbol, a.rn ORDER BY b.rn)),
z AS (SELECT symbol, t, max(s) FILTER (rn = e) AS x, avg(s) FILTER (rn < e) AS m, stddev_samp(s) FILTER (rn < e) AS sd FROM e GROUP BY 1, 2)
SELECT symbol, t, round((x - m) / nullif(sd, 0), 6) AS ofi_z FROM bars LEFT JOIN z USING (symbol, t)""")
def order_flow_z(spark: SparkSession, d: str) -> DataFrame:
    return out(SG.order_flow_z(S.hourly_bars(spark, d)), "symbol t", "ofi_z")


@query(f"""{BARS}, x AS (SELECT *, (volume - {_full(20, 'volume', 'avg(volume)')}) / nullif({_full(20, 'volume', 'stddev_samp(volume)')}, 0) AS volume_z, (close - open) / nullif(open, 0) AS body FROM bars)
SELECT symbol, t, {_r('volume_z body')}, CASE WHEN body < 0 THEN 'long' ELSE 'short' END AS side, CASE WHEN body < 0 THEN low ELSE high END AS price FROM x WHERE volume_z >= 2.0 AND abs(body) >= 0.01""")
def liquidation_events(spark: SparkSession, d: str) -> DataFrame:
    return out(SG.liquidations(S.hourly_bars(spark, d), z=2.0), "symbol t side price", "volume_z body")


TICK = "tick AS (SELECT o_custkey AS symbol, sum(o_totalprice) AS volume, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) / arg_min(o_totalprice, row(o_orderdate, o_orderkey)) - 1 AS pct FROM orders GROUP BY 1), prev AS (SELECT DISTINCT o_custkey AS symbol FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')"


def _tickers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = S.load(spark, d, "orders")
    k = F.struct("o_orderdate", "o_orderkey")
    t = o.groupBy(F.col("o_custkey").alias("symbol")).agg(F.sum("o_totalprice").alias("volume"), (F.max_by("o_totalprice", k) / F.min_by("o_totalprice", k) - 1).alias("pct"))
    return t, o.filter("o_orderdate < TIMESTAMP '1996-01-01'").select(F.col("o_custkey").alias("symbol")).distinct()


@query(f"""WITH {TICK}, live AS (SELECT * FROM tick WHERE volume >= 100000), s AS (SELECT avg(log10(volume)) AS mv, stddev_pop(log10(volume)) AS sv, avg(abs(pct)) AS mp, stddev_pop(abs(pct)) AS sp FROM live),
x AS (SELECT symbol, volume, pct, (log10(volume) - mv) / sv + (abs(pct) - mp) / sp AS score FROM live, s)
SELECT symbol, round(volume, 2) AS volume, {_r('pct score')}, symbol NOT IN (SELECT symbol FROM prev) AS is_new FROM x ORDER BY x.score DESC, symbol LIMIT 20""")
def trend_scan(spark: SparkSession, d: str) -> DataFrame:
    t, p = _tickers(spark, d)
    s = SG.trend_scan(t, p, 100000)
    return s.select("symbol", F.round("volume", 2).alias("volume"), F.round("pct", 6).alias("pct"), F.round("score", 6).alias("score"), "is_new")


@query(f"WITH {TICK} SELECT symbol FROM tick WHERE symbol NOT IN (SELECT symbol FROM prev) AND EXISTS (SELECT 1 FROM prev)")
def new_listings(spark: SparkSession, d: str) -> DataFrame:
    return SG.new_listings(*_tickers(spark, d))


@query("""WITH x AS (SELECT doc_id AS id, substring(text, 1, 80) AS title, list_filter([CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])ban($|[^\\p{L}\\p{N}_])') THEN 'ban' END, CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])licensed($|[^\\p{L}\\p{N}_])') THEN 'licensed' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])nicht($|[^\\p{L}\\p{N}_])') THEN 'nicht' END, CASE WHEN contains(lower(text), 'ción') THEN 'ción' END], lambda w: w IS NOT NULL)[1:3] AS h FROM documents),
y AS (SELECT title, min(id) AS id, arg_min(h, id) AS h FROM x WHERE len(h) > 0 GROUP BY title) SELECT id, title, array_to_string(h, ',') AS hits FROM y""")
def keyword_alerts(spark: SparkSession, d: str) -> DataFrame:
    return SG.keyword_alerts(S.load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["ban", "licensed", "nicht", "ción"])


@query("""SELECT c_custkey, CASE WHEN e < 500 THEN 'micro' WHEN e < 2000 THEN 'small' WHEN e < 10000 THEN 'medium' WHEN e < 50000 THEN 'large' ELSE 'whale' END AS tier,
  CASE WHEN e < 500 THEN 'small' WHEN e < 2000 THEN 'medium' WHEN e < 10000 THEN 'large' WHEN e < 50000 THEN 'whale' END AS next_tier,
  round(CASE WHEN e < 500 THEN 100 * e / 500 WHEN e < 2000 THEN 100 * (e - 500) / 1500 WHEN e < 10000 THEN 100 * (e - 2000) / 8000 WHEN e < 50000 THEN 100 * (e - 10000) / 40000 ELSE 100 END, 6) AS progress
FROM (SELECT c_custkey, greatest(c_acctbal, 0) AS e FROM customer)""")
def tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = S.load(spark, d, "customer").select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("e"))
    return out(SG.tier_of(c, "e"), "c_custkey tier next_tier", "progress")


@query("""WITH f AS (SELECT event_type AS symbol, epoch_us(ts) // 3600000000 AS t, event_id, (value - 50) / 1e5 AS funding FROM events)
SELECT symbol, t, round(funding, 8) AS funding, CASE WHEN funding > 0 THEN 'short' ELSE 'long' END AS side, round(abs(funding) * 3 - 0.0006, 8) AS net, round(abs(funding) * 1095, 9) AS annual FROM f WHERE abs(funding) >= 0.0003 AND abs(funding) * 3 - 0.0006 > 0""")
def carry_opportunities(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "events")
    f = e.select(F.col("event_type").alias("symbol"), S.hour_number(F.col("ts")).alias("t"), ((F.col("value") - 50) / 1e5).alias("funding"))
    x = SG.carry_opportunities(f)
    return x.select("symbol", "t", F.round("funding", 8).alias("funding"), "side", F.round("net", 8).alias("net"), F.round("annual", 9).alias("annual"))


@query(f"""{TRADES}, x AS (SELECT id, symbol, t, pnl * 0.2 AS amount FROM trades WHERE pnl >= 5 AND pnl * 0.2 >= 11)
SELECT id, symbol, t, round(amount, 4) AS amount, round(sum(amount) OVER (PARTITION BY symbol ORDER BY t, id), 4) AS total FROM x""")
def reserve_ledger(spark: SparkSession, d: str) -> DataFrame:
    return out(SZ.reserve_ledger(S.trades(spark, d)), "id symbol t", "amount total", 4)


@query("""WITH q AS (SELECT l_orderkey AS id, CAST(l_suppkey AS VARCHAR) AS venue, l_extendedprice / l_quantity AS price, l_tax AS fee FROM lineitem),
r AS (SELECT *, price * (1 + fee) AS cost FROM q) SELECT id, arg_min(venue, row(cost, venue)) AS venue, round(min(cost), 9) AS cost FROM r GROUP BY 1""")
def best_venue(spark: SparkSession, d: str) -> DataFrame:
    q = S.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("string").alias("venue"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_tax").alias("fee"))
    return out(SZ.best_venue(q, "buy"), "id venue", "cost", 9)


# Vectors, simulation and change points


KNN = """q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), x AS (
  SELECT q.vec_id AS query, b.vec_id AS neighbour, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / ((sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) + 1e-8) * (sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) + 1e-8)) AS similarity
  FROM q JOIN embeddings b ON b.vec_id <> q.vec_id)"""


@query(f"""WITH {KNN}
SELECT query, neighbour, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, neighbour) AS INTEGER) AS rank FROM x QUALIFY rank <= 10""")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "embeddings")
    return out(V.nearest(e, e.filter("vec_id % 20 = 0"), 10), "query neighbour rank", "similarity")


@query(f"""WITH {KNN}, n AS (SELECT query, neighbour, similarity FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, neighbour) <= 100),
y AS (SELECT query, similarity, label / 10.0::DOUBLE - 0.45::DOUBLE AS fwd FROM n JOIN embeddings ON vec_id = neighbour),
s AS (SELECT query, count(fwd) AS n, avg(fwd) AS mean, median(fwd) AS median, stddev_pop(fwd) AS sd, count(*) FILTER (fwd > 0) / count(fwd)::DOUBLE AS win_rate, avg(similarity) AS similarity FROM y GROUP BY 1)
SELECT query, n, CASE WHEN abs(mean) < 5e-7 THEN 0 ELSE round(mean, 6) END AS mean, {_r('median sd win_rate similarity')}, round(greatest(0, least(1, abs(mean) / (sd + 1e-4) * similarity)), 6) AS confidence FROM s""")
def knn_stats(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "embeddings").withColumn("fwd", F.col("label") / 10.0 - 0.45)
    n = V.neighbour_stats(V.nearest(e, e.filter("vec_id % 20 = 0"), 100), e, "fwd")
    n = n.withColumn("mean", F.when(F.abs("mean") < 5e-7, 0.0).otherwise(F.col("mean")))  # a sum of outcomes that cancel may end on either side of zero
    return out(n, "query n", "mean median sd win_rate similarity confidence")


def _actions(spark: SparkSession, d: str) -> DataFrame:
    z = I.rolling_zscore(S.hourly_bars(spark, d), "close", 20)
    act = F.when(F.col("zscore") < -1.5, "long").when(F.col("zscore") > 1.5, "short").when(F.abs("zscore") < 0.2, "close").otherwise("hold")
    return z.select("symbol", "t", "close", act.alias("action"), F.lit(0.1).alias("size"))


@query()
def backtest(spark: SparkSession, d: str) -> DataFrame:
    return SM.backtest(_actions(spark, d))


@query()
def change_points(spark: SparkSession, d: str) -> DataFrame:
    return SM.change_points(S.hourly_bars(spark, d))


@query()
def portfolio_weights(spark: SparkSession, d: str) -> DataFrame:
    r = I.returns(S.hourly_bars(spark, d), (1,)).select("symbol", "t", F.col("returns_1").alias("ret")).filter("ret IS NOT NULL")
    names = [x[0] for x in r.select("symbol").distinct().orderBy("symbol").collect()]
    return SM.portfolio_weights(r, names)


@query(f"""{SIGNALS}, x AS (SELECT s.id, s.signal, s.confidence, s.t % 24 AS hour FROM signals s),
y AS (SELECT *, CASE WHEN signal > 0.15 THEN 'long' WHEN signal < -0.15 THEN 'short' ELSE 'hold' END AS side, confidence * CASE WHEN abs(signal) > 0.5 THEN 1.2 ELSE 1 END AS c FROM x),
z AS (SELECT *, CASE WHEN side = 'hold' THEN 'no_direction' WHEN hour IN (1, 2, 8, 13, 16) THEN 'blocked_hour' WHEN c < 0.45 THEN 'low_confidence' END AS reason FROM y)
SELECT id, reason, CASE WHEN reason IS NULL THEN side ELSE 'hold' END AS action, round(CAST(CASE WHEN reason IS NULL THEN least(c, 1) ELSE 0 END AS DOUBLE), 6) AS size FROM z""")
def decision_cascade(spark: SparkSession, d: str) -> DataFrame:
    s = S.signals(spark, d).withColumns({"regime": F.lit("normal"), "hour": F.col("t") % 24, "rsi": F.lit(50.0)})
    return out(SG.decide(s), "id reason action", "size")
