"""Feedback on closed trades, models and executions: counters, ladders, weights, triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import clip, lagged, last


def top_of_book(books: DataFrame, depth: int = 20) -> DataFrame:
    """Volumes of the best ``depth`` levels, spread and imbalance of books with arrays bids and asks of (price, size)."""
    total = lambda c: F.aggregate(F.transform(F.slice(c, 1, depth), lambda x: x["size"]), F.lit(0.0), lambda a, x: a + x)
    d = books.withColumns({"bid_volume": total("bids"), "ask_volume": total("asks"), "spread": F.get("asks", F.lit(0))["price"] - F.get("bids", F.lit(0))["price"]})
    return d.withColumn("imbalance", F.coalesce(F.try_divide(F.col("bid_volume") - F.col("ask_volume"), F.col("bid_volume") + F.col("ask_volume")), F.lit(0.0)))


def path_combinations(rows: DataFrame, sources: str, pnl: str) -> DataFrame:
    """Results by the sorted distinct source prefixes of each trade, joined with ``+``."""
    name = F.array_join(F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.split_part(s, F.lit("_"), F.lit(1))))), "+")
    return rows.groupBy(name.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(pnl) > 0).alias("wins"), F.sum(pnl).alias("total"))


def agreement(rows: DataFrame) -> DataFrame:
    """One trade counts for three keys: external direction, whether it agreed with the side, and its strength."""
    s = F.abs("external_score")
    keys = F.array(
        F.concat(F.lit("dir_"), "external_direction"),
        F.when(F.col("external_direction") == F.col("side"), F.lit("agreed")).otherwise(F.lit("disagreed")),
        F.concat(F.lit("ext_"), F.when(s < 0.2, "weak").when(s < 0.4, "medium").otherwise("strong")),
    )
    return rows.select("pnl", F.explode(keys).alias("key")).groupBy("key").agg(F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") <= 0).alias("losses"), F.sum("pnl").alias("total"))


def exit_reasons(rows: DataFrame) -> DataFrame:
    """Count, sum and mean of each exit reason, and the stop-loss advice its share of all exits gives."""
    d = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total"), F.avg("pnl").alias("mean"))
    d = d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return d.withColumn("advice", F.when(F.col("reason") == "sl", F.when(F.col("share") > 0.65, "widen").when(F.col("share") < 0.30, "tighten").otherwise("keep")))


def best_configs(rows: DataFrame, config: str, keep: int = 100, least: int = 3) -> DataFrame:
    """Totals over the latest ``keep`` results of each configuration, and its rank by sum among those with enough."""
    w = Window.partitionBy(config).orderBy(F.desc("t"), F.desc("id"))
    d = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).groupBy(config).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total"))
    return d.filter(F.col("n") >= least).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("total", 4)), config)))


def ic_multiplier(ic: Column, previous: Column) -> Column:
    """Weight multiplier: a ladder on the information coefficient, smoothed by three quarters of the previous one."""
    target = F.when(ic <= -0.03, 0.3).when(ic <= 0, 0.5).when(ic <= 0.03, 0.8).when(ic <= 0.05, 1.0).when(ic <= 0.10, 1.3).otherwise(1.5)
    return 0.75 * previous + 0.25 * target


def execution_stats(rows: DataFrame, key: str, keep: int = 50) -> DataFrame:
    """Medians of slippage (outliers beyond 200 bp out) and latency over the latest ``keep`` fills, and the maker rate from five on."""
    w = Window.partitionBy(key).orderBy(F.desc("id"))
    d = rows.filter(F.col("slippage").between(-200, 200)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    n = F.count(F.lit(1))
    return d.groupBy(key).agg(n.alias("n"), F.median("slippage").alias("slippage"), F.median("latency").alias("latency"), F.when(n >= 5, F.count_if("maker") / n).alias("maker_rate"))


def pooled(stats: DataFrame, value: str, weight: str) -> DataFrame:
    """One mean over venues, weighted by their samples."""
    return stats.agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias(value), F.sum(weight).alias(weight))


def model_trend(rows: DataFrame, keep: int = 10) -> DataFrame:
    """Mean accuracy of the latest evaluations of each model and whether the last beats the first of them."""
    w = Window.partitionBy("model").orderBy(F.desc("t"), F.desc("id"))
    d = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    k = F.struct("t", "id")
    d = d.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("accuracy").alias("mean"), F.min_by("accuracy", k).alias("_f"), F.max_by("accuracy", k).alias("_l"))
    return d.withColumn("trend", F.when(F.col("_l") > F.col("_f"), "improving").otherwise("declining")).drop("_f", "_l")


def replacement_score(accuracy: Column, sharpe: Column, win_rate: Column, drawdown: Column) -> Column:
    return 0.3 * accuracy + 0.3 * sharpe + 0.2 * win_rate - 0.2 * drawdown


def decay_weights(rows: DataFrame, label: str, half: float = 0.998) -> DataFrame:
    """Weights that fall by age in rows of a symbol and balance the classes, with mean 1 in each symbol."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    age = n - F.row_number().over(Window.partitionBy("symbol").orderBy("t"))
    of_class = F.count(F.lit(1)).over(Window.partitionBy("symbol", label))
    d = rows.withColumn("_w", F.pow(F.lit(half), age) * n / of_class)
    return d.withColumn("weight", F.col("_w") / F.avg("_w").over(Window.partitionBy("symbol"))).drop("_w")


def retrain_triggers(models: DataFrame, interval: float = 12.0, drop: float = 0.03) -> DataFrame:
    """Models (model, hours, accuracy, previous, regime_changed) that are due, with reasons and priority."""
    why = F.concat_ws("+", F.when(F.col("hours") >= interval, "interval"), F.when(F.col("previous") - F.col("accuracy") > drop, "decline"), F.when(F.col("regime_changed") & (F.col("hours") >= 1), "regime"))
    d = models.withColumn("reasons", why).filter("reasons <> ''")
    return d.withColumn("priority", F.col("hours") / interval + F.greatest(F.lit(0.0), F.col("previous") - F.col("accuracy")) * 10)


def tier_changes(rows: DataFrame) -> DataFrame:
    """Rows where the tier of a symbol differs from the one before."""
    d = rows.withColumn("previous", lagged("tier", 1))
    return d.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("tier")))


def rewards(rows: DataFrame, value: str, n: int = 100, warm: int = 20) -> DataFrame:
    """Sharpe and Sortino rewards over the last n returns; the return itself until ``warm`` rows are there."""
    w = last(n)
    x = F.col(value)
    seen, mean = F.count(x).over(w), F.avg(x).over(w)
    down = F.stddev_pop(F.when(x < 0, x)).over(w)
    return rows.withColumns({
        "sharpe_reward": F.when(seen < warm, x).otherwise(mean / (F.stddev_pop(x).over(w) + 1e-8)),
        "sortino_reward": F.when(seen < warm, x).otherwise(mean / (F.coalesce(down, F.lit(0.0)) + 1e-8)),
    })


def correlation_multiplier(pairs: DataFrame, limit: float = 0.7) -> DataFrame:
    """Half size for pairs whose correlation exceeds the limit."""
    return pairs.withColumn("multiplier", F.when(F.col("corr") > limit, 0.5).otherwise(1.0))


def log_counters(lines: DataFrame, needles: list[str], number: str) -> DataFrame:
    """Lines (line_no, text) that contain each needle, and the last number that a pattern finds."""
    found = F.regexp_extract("text", number, 1)
    some = F.when(found != "", found)
    return lines.agg(*[F.count_if(F.col("text").contains(x)).alias(f"n_{i}") for i, x in enumerate(needles)], *[F.bool_or(F.col("text").contains(x)).alias(f"any_{i}") for i, x in enumerate(needles)], F.max_by(some, F.when(some.isNotNull(), F.col("line_no"))).alias("last"))


def bootstrap_mean(rows: DataFrame, value: str, by: list[str], key: str, draws: int = 500, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by a Poisson bootstrap: each row counts Poisson(1) times in each draw.

    The counts come from a hash of row key and draw, so reruns agree and the sums combine map-side; nothing is resampled.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col("b"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    times, total, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        times = F.when(u >= total, F.lit(k)).otherwise(times)
        p /= k
    d = rows.select(*by, key, F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).withColumn("c", times)
    m = d.groupBy(*by, "b").agg((F.sum(F.col("c") * F.col("x")) / F.nullif(F.sum("c"), F.lit(0))).alias("m"))
    a = (1 - level) / 2
    return m.groupBy(*by).agg(F.percentile("m", a).alias("low"), F.percentile("m", 1 - a).alias("high"))


def ensemble_weights(scores: DataFrame, floor: float = 0.05) -> DataFrame:
    """Weights of models from their coefficients, floored and normalised in each group."""
    s = F.greatest(F.col("ic"), F.lit(0.0)) + floor
    return scores.withColumn("weight", s / F.sum(s).over(Window.partitionBy("regime")))


def rotation(state: DataFrame, floor: float, grace_hours: int = 120, least: int = 8) -> DataFrame:
    """What to do with each symbol (age_hours, n, win_rate, net, volume): keep, or eject for results or volume."""
    why = F.when(F.col("age_hours") < grace_hours, F.lit(None)).when((F.col("n") >= least) & (F.col("win_rate") < 35) & (F.col("net") < 0), "results").when(F.col("volume") < floor, "volume")
    return state.withColumn("eject", why)


def soft_clip(x: Column, low: float = 0.1, high: float = 2.0) -> Column:
    """Product of scales inside its bounds."""
    return clip(x, low, high)
