"""Bar features that are windows of built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import before, change, corr, full, lagged, last, ordered, ratio, so_far


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Mean, bands at k population deviations, width and place of the close between the bands."""
    d = bars.withColumns({"bb_mid": full(n, F.col("close"), F.avg(F.col("close"))), "_sd": full(n, F.col("close"), F.stddev_pop(F.col("close")))})
    d = d.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_sd"), "bb_lower": F.col("bb_mid") - k * F.col("_sd")})
    span = F.col("bb_upper") - F.col("bb_lower")
    return d.withColumns({"bb_width": ratio(span, F.col("bb_mid")), "bb_pct": ratio(F.col("close") - F.col("bb_lower"), span)}).drop("_sd")


def stochastic(bars: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """%K over n bars and its mean over ``smooth``."""
    low, high = full(n, F.col("low"), F.min(F.col("low"))), full(n, F.col("high"), F.max(F.col("high")))
    d = bars.withColumn("stoch_k", 100 * ratio(F.col("close") - low, high - low))
    return d.withColumn("stoch_d", full(smooth, F.col("stoch_k"), F.avg("stoch_k")))


def volume_profile(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean and sample deviation of volume, and the ratio of volume to the mean."""
    d = bars.withColumns({"vol_sma": full(n, F.col("volume"), F.avg(F.col("volume"))), "vol_std": full(n, F.col("volume"), F.stddev_samp(F.col("volume")))})
    return d.withColumn("vol_ratio", ratio(F.col("volume"), F.col("vol_sma")))


def on_balance_volume(bars: DataFrame) -> DataFrame:
    """Running volume, added when the close does not fall, else subtracted; the first bar adds."""
    sign = F.when(F.col("close") < lagged("close", 1), -F.col("volume")).otherwise(F.col("volume"))
    d = bars.withColumn("_signed", sign)
    return d.withColumn("obv", F.sum("_signed").over(so_far())).drop("_signed")


def amihud(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean absolute return for each unit of traded value, and its scaled logarithm."""
    d = bars.withColumn("_x", ratio(F.abs(change("close", 1)), F.col("close") * F.col("volume") + 1e-10))
    d = d.withColumn("amihud", full(n, F.col("_x"), F.avg("_x"))).drop("_x")
    return d.withColumn("amihud_log", F.log1p(F.col("amihud") * 1e9))


def range_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """Garman-Klass and Parkinson volatility; null while the window holds a bar with a price of 0."""
    hl, co = F.log(ratio(F.col("high"), F.col("low"))), F.log(ratio(F.col("close"), F.col("open")))
    gk = F.greatest(F.lit(0.0), 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co)
    d = bars.withColumns({"_g": gk, "_p": hl * hl / (4 * math.log(2))})
    return d.withColumns({"gk_vol": F.sqrt(full(n, F.col("_g"), F.avg("_g"))), "parkinson_vol": F.sqrt(full(n, F.col("_p"), F.avg("_p")))}).drop("_g", "_p")


def returns(bars: DataFrame, lags: tuple[int, ...] = (1, 5, 20), n: int = 20) -> DataFrame:
    """Returns over several lags and the sample deviation of one-bar returns."""
    d = bars.withColumns({f"returns_{k}": change("close", k) for k in lags})
    if 1 not in lags:
        d = d.withColumn("returns_1", change("close", 1))
    return d.withColumn("volatility", full(n, F.col("returns_1"), F.stddev_samp("returns_1")))


def candle_shape(bars: DataFrame) -> DataFrame:
    """Range, body and shadows as shares."""
    span = F.col("high") - F.col("low")
    return bars.withColumns({
        "high_low_range": ratio(span, F.col("close")), "close_open_range": ratio(F.col("close") - F.col("open"), F.col("open")), "upper_shadow": ratio(F.col("high") - F.greatest(F.col("open"), F.col("close")), span),
        "lower_shadow": ratio(F.least(F.col("open"), F.col("close")) - F.col("low"), span), "body": ratio(F.abs(F.col("close") - F.col("open")), span),
    })


def time_cycles(rows: DataFrame, ts: str = "ts", epoch: str = "2024-04-19", days: int = 1460) -> DataFrame:
    """Hour, weekday (Monday 0) and month on circles, and the place in a cycle of ``days`` since ``epoch``."""
    t = F.col(ts)
    place = F.pmod(F.datediff(t.cast("date"), F.lit(epoch).cast("date")), F.lit(days)) / F.lit(float(days))
    out = {"cycle": place}
    for name, value, size in (("hour", F.hour(t), 24), ("dow", F.weekday(t), 7), ("month", F.month(t), 12), ("cycle", place, 1)):
        angle = 2 * math.pi * value / size
        out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return rows.withColumns(out)


def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    """Breakouts of the range of the n bars before, with the volume's z-score over them."""
    w = before(n)
    ready = F.count(F.col("close")).over(w) == n
    z = ratio(F.col("volume") - F.avg(F.col("volume")).over(w), F.stddev_samp(F.col("volume")).over(w))
    high, low = F.max(F.col("high")).over(w), F.min(F.col("low")).over(w)
    d = bars.withColumns({"channel_high": F.when(ready, high), "channel_low": F.when(ready, low), "volume_z": F.when(ready, z)})
    side = F.when(F.col("close") > F.col("channel_high"), F.lit("long")).when(F.col("close") < F.col("channel_low"), F.lit("short")).otherwise(F.lit("none"))
    return d.withColumn("breakout", side)


def rolling_zscore(rows: DataFrame, value: str, n: int = 30) -> DataFrame:
    """Sample z-score over the last n rows, 0 where there is none."""
    x = F.col(value)
    return rows.withColumn("zscore", F.coalesce(ratio(x - full(n, x, F.avg(x)), full(n, x, F.stddev_samp(x))), F.lit(0.0)))


def drawdown(rows: DataFrame, value: str, key: str, order: str) -> DataFrame:
    """Running sum, its peak (from 0) and the distance below it."""
    d = rows.withColumn("cumulative", F.sum(value).over(so_far(key, order)))
    d = d.withColumn("peak", F.greatest(F.max("cumulative").over(so_far(key, order)), F.lit(0.0)))
    return d.withColumn("drawdown", F.col("cumulative") - F.col("peak"))


def streaks(rows: DataFrame, won: Column, key: str, order: str) -> DataFrame:
    """Length of the run of equal outcomes that each row continues."""
    d = rows.withColumn("_won", won)
    d = d.withColumn("_new", F.when(F.col("_won") == F.lag("_won").over(ordered(key, order)), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(so_far(key, order)))
    from pyspark.sql.window import Window

    run = Window.partitionBy(key, "_run").orderBy(order)
    return d.withColumn("streak", F.row_number().over(run)).drop("_new", "_run").withColumnRenamed("_won", "won")


def anomalies(bars: DataFrame, n: int = 100) -> DataFrame:
    """Alerts of each bar: returns and volume beyond three deviations, and volume far from its mean; the window includes the bar."""
    d = bars.withColumn("_r", change("close", 1))
    w = last(n)
    r, v = F.col("_r"), F.col("volume")
    alerts = F.array_compact(F.array(
        F.when(F.abs(r) > F.avg(r).over(w) + 3 * F.stddev_pop(r).over(w), F.lit("price_spike")),
        F.when(v > F.avg(v).over(w) + 3 * F.stddev_pop(v).over(w), F.lit("volume_spike")),
        F.when(ratio(v, F.avg(v).over(w)) > 2.5, F.lit("volume_high")),
        F.when(ratio(v, F.avg(v).over(w)) < 0.3, F.lit("volume_low")),
    ))
    ready = F.count(r).over(w) >= 20
    return d.withColumn("_a", F.when(ready, alerts)).select("symbol", "t", F.explode("_a").alias("alert"))


def rule_regime(bars: DataFrame) -> DataFrame:
    """Six regimes from short against long volatility, the trend's correlation with time, and volume."""
    d = bars.withColumns({"_r": change("close", 1), "_n": F.row_number().over(ordered()).cast("double")})
    short, long_ = F.stddev_pop("_r").over(last(20)), F.stddev_pop("_r").over(last(100))
    long_ = F.when(F.count("_r").over(last(100)) < 100, short).otherwise(long_)
    trend = corr("_n", "close", last(50))
    volume = ratio(F.avg(F.col("volume")).over(last(5)), F.avg(F.col("volume")).over(last(50)))
    d = d.withColumns({"_s": short, "_l": long_, "_t": trend, "_v": volume})
    r = (
        F.when(F.col("_n") < 50, F.lit("normal")).when(F.col("_s") > 2 * F.col("_l"), F.lit("extreme_volatility"))
        .when(F.col("_t") > 0.7, F.lit("trending_up")).when(F.col("_t") < -0.7, F.lit("trending_down"))
        .when(F.abs(F.col("_t")) < 0.3, F.lit("ranging")).when(F.col("_v") > 2, F.lit("high_volume_breakout")).otherwise(F.lit("normal"))
    )
    return d.withColumn("regime", r).drop("_r", "_n", "_s", "_l", "_t", "_v")


