"""Adjustments learned from closed trades, as maps from a name to a number, merged with those of before and applied to positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import clip, ratio
from .trades import money


def _maps(entries: DataFrame, by: str) -> DataFrame:
    """by and ``adjustments``, from rows (by, key, value); of repeated keys the smallest value."""
    one = entries.filter("value IS NOT NULL").groupBy(by, "key").agg(F.min("value").alias("value"))
    return one.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.col("value").cast("double"))))).alias("adjustments"))


def _figures(trades: DataFrame, by: str, dims: dict[str, Column]) -> DataFrame:
    """by, dim, name, n, wins, total of trades in each value of each dimension; one pass, rows spread by dimension. A null value is left out."""
    each = trades.select(by, "pnl", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), v.cast("string").alias("name")) for d, v in dims.items()])).alias("d"))
    return each.select(by, "pnl", "d.*").filter("name IS NOT NULL").groupBy(by, "dim", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), money("pnl").alias("total"))


def feedback_adjustments(trades: DataFrame, by: str = "mode", least: int = 10) -> DataFrame:
    """What closed trades (by, id, hour, regime, side, strength, agreed, pnl) say should change: avoided hours, scales of regimes and
    sides, a least signal, the weight of outside views, and a smaller size while the newest trades lose. Groups of fewer than ``least`` trades
    say nothing; a trade that does not win counts as lost."""
    enough = trades.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(F.col(by).alias("_by"))
    t = trades.join(enough, F.col(by).eqNullSafe(F.col("_by")), "left_semi")
    agreed = F.when(F.col("agreed"), "agreed").when(~F.col("agreed"), "disagreed")
    f = _figures(t, by, {"hour": F.col("hour"), "regime": F.col("regime"), "side": F.col("side"), "strength": F.col("strength"), "outside": agreed})
    rate, d, n = F.col("wins") / F.col("n"), F.col("dim"), F.col("n")
    rule = lambda dim, least_n, when, value: F.when((d == dim) & (n >= least_n) & when, value)
    value = F.coalesce(
        rule("hour", 5, (rate < 0.3) & (F.col("total") < 0), 1.0), rule("regime", 5, rate < 0.3, 0.3), rule("regime", 5, rate > 0.65, 1.3), rule("side", 10, rate < 0.35, 0.5),
        rule("strength", 10, (F.col("name") == "weak") & (rate < 0.4), 0.2), rule("outside", 10, (F.col("name") == "agreed") & (rate > 0.6), 1.3),
        rule("outside", 10, (F.col("name") == "agreed") & (rate < 0.35), 0.5), rule("outside", 10, (F.col("name") == "disagreed") & (rate < 0.3), 1.0),
    )
    key = (
        F.when(d == "hour", F.concat(F.lit("avoid_hour_"), "name")).when(d == "regime", F.concat(F.lit("regime_scale_"), "name")).when(d == "side", F.concat(F.lit("direction_scale_"), "name"))
        .when(d == "strength", "min_signal_strength").when(F.col("name") == "agreed", "external_weight_boost").otherwise("external_disagree_block")
    )
    # The newest losses are those after the last win.
    won = t.groupBy(by).agg(F.max(F.when(F.col("pnl") > 0, F.col("id"))).alias("_last")).withColumnRenamed(by, "_by")
    streak = t.join(won, F.col(by).eqNullSafe(F.col("_by"))).groupBy(by).agg(F.count_if(F.col("_last").isNull() | (F.col("id") > F.col("_last"))).alias("k"))
    small = streak.select(by, F.lit("losing_streak_scale").alias("key"), F.when(F.col("k") >= 3, F.greatest(F.lit(0.3), 1 - 0.15 * F.col("k"))).alias("value"))
    return _maps(f.select(by, key.alias("key"), value.alias("value")).unionByName(small), by)


def daily_adjustments(trades: DataFrame, by: str = "mode", least: int = 10) -> DataFrame:
    """What the results by hour and symbol say: hours to avoid (of the three worst) and to boost (of the three best), scales of symbols,
    a step of the whole scale, and the ratio of the mean win to the mean loss. ``global_step`` is a step, not a scale."""
    w = Window.partitionBy(by)
    f = _figures(trades, by, {"hour": F.col("hour"), "symbol": F.col("symbol")})
    rate, hour = F.col("wins") / F.col("n"), F.col("dim") == "hour"
    number = F.col("name").try_cast("int")
    place = lambda order: F.row_number().over(Window.partitionBy(by, "dim").orderBy(order, number, "name"))
    f = f.withColumns({"worst": place(F.col("total")), "best": place(F.desc("total"))})
    avoid = hour & (F.col("worst") <= 3) & (F.col("n") >= 3) & (rate < 0.25) & (F.col("total") < 0)
    boost = hour & (F.col("best") <= 3) & (F.col("n") >= 3) & (rate > 0.65)
    scale = F.when(~hour & (F.col("n") >= 5) & (rate < 0.25) & (F.col("total") < 0), 0.5).when(~hour & (F.col("n") >= 5) & (rate > 0.6) & (F.col("total") > 0), 1.3)
    one = lambda prefix, v: F.struct(F.concat(F.lit(prefix), "name").alias("key"), v.cast("double").alias("value"))
    parts = f.select(by, F.explode(F.array(one("avoid_hour_", F.when(avoid, 1.0)), one("boost_hour_", F.when(boost, 1.2)), one("scale_", scale))).alias("e")).select(by, "e.*")
    win, lost = F.col("pnl") > 0, ~(F.col("pnl") > 0)
    g = trades.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(win).alias("wins"), money("pnl").alias("total"), F.avg(F.when(win, F.col("pnl"))).alias("gain"), F.abs(F.avg(F.when(lost, F.col("pnl")))).alias("loss"))
    step = F.when(F.col("wins") / F.col("n") < 0.3, -0.1).when((F.col("wins") / F.col("n") > 0.55) & (F.col("total") > 0), 0.1)
    odds = F.when(F.col("gain").isNotNull() & F.col("loss").isNotNull(), F.coalesce(F.bround(ratio(F.col("gain"), F.col("loss")), 2), F.lit(1.0)))
    whole = g.select(by, "n", F.explode(F.array(F.struct(F.lit("global_step").alias("key"), step.cast("double").alias("value")), F.struct(F.lit("rr_ratio").alias("key"), odds.cast("double").alias("value")))).alias("e"))
    enough = g.filter(F.col("n") >= least).select(F.col(by).alias("_by"))
    return _maps(parts.unionByName(whole.select(by, "e.*")).join(enough, F.col(by).eqNullSafe(F.col("_by")), "left_semi"), by)


def merged(old: Column, new: Column) -> Column:
    """One map of both: what is new wins; a step moves the old whole scale within 0.3 to 1.5; a scale for losing streaks that is not new
    recovers by a tenth, up to 1. Either may be null."""
    empty = F.create_map().cast("map<string,double>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    recovered = lambda k, o, n: F.when(n.isNull() & (k == "losing_streak_scale"), F.least(F.lit(1.0), o + 0.1)).otherwise(F.coalesce(n, o))
    both = F.map_zip_with(F.map_filter(old, lambda k, _: k != "global_scale"), F.map_filter(new, lambda k, _: k != "global_step"), recovered)
    scale = F.when(new["global_step"].isNotNull(), clip(F.coalesce(old["global_scale"], F.lit(1.0)) + new["global_step"], 0.3, 1.5)).otherwise(old["global_scale"])
    return F.map_concat(both, F.when(scale.isNotNull(), F.create_map(F.lit("global_scale"), scale)).otherwise(empty))


def position_scale(adjustments: Column, symbol: Column, hour: Column) -> Column:
    """What the map makes of a position: the whole scale times that of the symbol times that of the hour (0: avoided), within 0 and 2."""
    of = lambda key, other: F.coalesce(adjustments[key], F.lit(other))
    named = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    avoided = adjustments[named("avoid_hour_", hour)].isNotNull()
    return clip(of(F.lit("global_scale"), 1.0) * of(named("scale_", symbol), 1.0) * F.when(avoided, 0.0).otherwise(of(named("boost_hour_", hour), 1.0)), 0.0, 2.0)
