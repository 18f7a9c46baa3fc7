"""Trade analytics: summaries, breakdowns, Kelly, feedback dimensions, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import ratio


def won() -> Column:
    return F.col("pnl") > 0


def lost() -> Column:
    return F.col("pnl") < 0


def money(c: str) -> Column:
    """Sum at six digits as decimals, so the order of the rows never shows in the last digit."""
    return F.sum(F.col(c).cast("decimal(18,6)")).cast("double")


def mode_name() -> Column:
    return F.coalesce(F.nullif("mode", F.lit("")), F.lit("unknown"))


def _figures() -> list[Column]:
    n, total = F.count(F.lit(1)), money("pnl")
    return [n.alias("n"), total.alias("total"), ratio(total, F.count("pnl")).alias("avg_pnl"), F.count_if(won()).alias("wins"), F.count_if(lost()).alias("losses"), (F.count_if(won()) / n).alias("win_rate")]


def trade_counts(trades: DataFrame) -> DataFrame:
    """Trades of each mode."""
    return trades.groupBy(mode_name().alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def trade_summary(trades: DataFrame) -> DataFrame:
    """Counts, sums, mean win and loss, first and last time of each mode."""
    return trades.groupBy(mode_name().alias("mode")).agg(*_figures(), F.avg(F.when(won(), F.col("pnl"))).alias("avg_win"), F.avg(F.when(lost(), F.col("pnl"))).alias("avg_loss"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def breakdown(trades: DataFrame, *by: str) -> DataFrame:
    """The figures for each combination of columns."""
    return trades.groupBy(*by).agg(*_figures())


def bucket_stats(trades: DataFrame, dims: list[str]) -> DataFrame:
    """Figures for each value of each dimension, in one pass: grouping sets by exploding (dimension, key)."""
    keys = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims]))
    long_ = trades.select("pnl", keys.alias("k")).select("pnl", "k.*")
    return long_.groupBy("dim", "key").agg(*_figures(), F.stddev_samp("pnl").alias("sd"), (F.avg("pnl") / (F.stddev_samp("pnl") + 1e-9)).alias("sharpe"))


def overall(trades: DataFrame) -> DataFrame:
    """Figures for each symbol and, with a null symbol, for all."""
    return trades.rollup("symbol").agg(*_figures())


def extremes(stats: DataFrame, k: int = 3) -> DataFrame:
    """The k best and k worst buckets of each dimension by mean."""
    best = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("avg_pnl"), "key"))
    worst = F.row_number().over(Window.partitionBy("dim").orderBy("avg_pnl", "key"))
    return stats.withColumns({"best": best, "worst": worst}).filter((F.col("best") <= k) | (F.col("worst") <= k)).select("dim", "key", "avg_pnl", "best", "worst")


def kelly(trades: DataFrame, dims: list[str], fraction: float = 0.5, least: int = 10) -> DataFrame:
    """Kelly fraction of every slice of the dimensions (a cube), zero results left out."""
    d = trades.filter("pnl <> 0").cube(*dims).agg(F.count(F.lit(1)).alias("n"), F.count_if(won()).alias("wins"), F.avg(F.when(won(), F.col("pnl"))).alias("avg_win"), F.avg(F.when(lost(), -F.col("pnl"))).alias("avg_loss"))
    p, b = F.col("wins") / F.col("n"), ratio(F.col("avg_win"), F.col("avg_loss"))
    f = F.greatest(F.lit(0.0), (p * b - (1 - p)) / b * fraction)
    return d.withColumn("kelly", F.when(F.col("n") >= least, F.coalesce(f, F.lit(0.0)))).select(*dims, "n", "wins", "kelly")


def recent_performance(trades: DataFrame, n: int = 20, since: int | None = None) -> DataFrame:
    """Latest n trades of each symbol: count, win rate in percent, sum, and the size scale they earn."""
    rows = trades if since is None else trades.filter(F.col("t") >= since)
    w = Window.partitionBy("symbol").orderBy(F.desc("t"), F.desc("id"))
    d = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(won()) / F.count(F.lit(1))).alias("win_rate"), F.sum("pnl").alias("net"))
    wr, net = F.col("win_rate"), F.col("net")
    return d.withColumn("scale", F.when(F.col("n") < 8, 1.0).when((wr >= 45) & (net > 0), 1.3).when(net > 0, 1.15).when((wr < 30) & (net < 0), 0.5).when(net < 0, 0.75).otherwise(1.0))


def session_name(hour: Column) -> Column:
    return F.when(hour < 8, F.lit("asia")).when(hour < 16, F.lit("europe")).otherwise(F.lit("us"))


def loss_patterns(trades: DataFrame) -> DataFrame:
    """Losing trades by regime, side and session."""
    name = F.concat_ws("_", F.col("regime").cast("string"), "side", session_name(F.col("hour")))
    return trades.filter(lost()).groupBy(name.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total"))


def blacklist(trades: DataFrame, least: int = 5, rate: float = 0.25) -> DataFrame:
    """Combinations of symbol, regime and side that rarely win and lose in sum."""
    d = breakdown(trades, "symbol", "regime", "side")
    return d.filter((F.col("n") >= least) & (F.col("win_rate") < rate) & (F.col("total") < 0)).select("symbol", "regime", "side", "n", "total", "win_rate")


def leading_losses(trades: DataFrame) -> DataFrame:
    """Losing trades in a row, newest first, of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("t"), F.desc("id"))
    d = trades.withColumn("_r", F.row_number().over(w))
    return d.groupBy("symbol").agg(F.coalesce(F.min(F.when(F.col("pnl") >= 0, F.col("_r"))) - 1, F.count(F.lit(1))).cast("long").alias("losses"))


def mode_reconciliation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: orphan (left only) or ghost (right only)."""
    both = a.select(F.col(key).alias("a")).distinct().join(b.select(F.col(key).alias("b")).distinct(), F.col("a") == F.col("b"), "full_outer")
    return both.filter("a IS NULL OR b IS NULL").select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), F.lit("orphan")).otherwise(F.lit("ghost")).alias("state"))
