"""Leverage, position size, order size, venue choice and profit ledgers as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import clip


def leverage(base: float, confidence: Column, volatility: Column, regime: Column, streak: Column, most: int = 20) -> Column:
    """Base leverage scaled by confidence, volatility, regime and losing streak, rounded half to even."""
    f = clip(0.6 + 1.6 * (confidence - 0.5), 0.6, 1.4) * clip(0.01 / F.greatest(volatility, F.lit(1e-9)), 0.4, 1.3)
    r = F.when(regime == "extreme_volatility", 0.5).when(regime.isin("trending_up", "trending_down"), 1.1).otherwise(1.0)
    s = F.when(streak >= 2, F.greatest(F.lit(0.5), 1 - 0.1 * streak)).otherwise(1.0)
    return clip(F.bround(base * f * r * s), 1, most).cast("int")


def position_size(equity: Column, confidence: Column, atr_pct: Column, volatility: Column, lev: Column, target: float = 0.01, stop: float = 1.5, most: float = 0.2) -> Column:
    """Margin by ATR target, held by 1.5 times the volatility-scaled size and by [1 %, most] of equity."""
    cf = clip(confidence, 0.3, 1.0)
    by_atr = target * equity / (stop * F.greatest(atr_pct, F.lit(0.003))) / lev * cf
    legacy = most * equity * cf * F.least(F.lit(1.0), 0.02 / F.greatest(volatility, F.lit(1e-9)))
    return F.greatest(0.01 * equity, F.least(F.least(by_atr, 1.5 * legacy), most * equity))


def order_amount(amount: Column, price: Column, step: float, least: float) -> Column:
    """Amount in whole steps, raised to the least notional."""
    floor_ = F.floor(amount / step) * step
    return F.when(floor_ * price >= least, floor_).otherwise(F.ceil(least / price / step) * step)


def best_venue(quotes: DataFrame, side: str) -> DataFrame:
    """For each id the venue with the best price after fees; ties by name."""
    cost = F.col("price") * (1 + F.col("fee")) if side == "buy" else -F.col("price") * (1 - F.col("fee"))
    return quotes.withColumn("_c", cost).groupBy("id").agg(F.min_by("venue", F.struct("_c", "venue")).alias("venue"), F.min("_c").alias("cost"))


def reserve_ledger(trades: DataFrame, rate: float = 0.2, least_pnl: float = 5.0, least_amount: float = 11.0) -> DataFrame:
    """Share of each large enough profit that goes to the reserve, and the running total of each symbol."""
    d = trades.withColumn("amount", F.col("pnl") * rate).filter((F.col("pnl") >= least_pnl) & (F.col("amount") >= least_amount))
    w = Window.partitionBy("symbol").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("id", "symbol", "t", "amount", F.sum("amount").over(w).alias("total"))


def twap_slices(orders: DataFrame, n: int) -> DataFrame:
    """Each order in n equal slices."""
    return orders.select("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"), (F.col("amount") / n).alias("amount"))
