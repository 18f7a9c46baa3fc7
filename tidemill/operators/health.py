"""Health checks of a running account: one pass over the trades, one row a mode, and the list of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.frames import ratio
from .trades import money


def schema_issues(df: DataFrame, expected: StructType | str) -> list[str]:
    """Names of the expected columns that are missing or have another type; columns beyond them are no issue."""
    want = expected if isinstance(expected, StructType) else StructType.fromDDL(expected)
    have = {f.name: f.dataType for f in df.schema}
    return [f"missing:{f.name}" if f.name not in have else f"type:{f.name}" for f in want if have.get(f.name) != f.dataType]


def health(trades: DataFrame, counted: DataFrame, now: Column, recent_hours: int = 48, keep: int = 50, window_hours: int = 168, quiet_hours: float = 24.0, losses: int = 5, daily: float = -300.0, limit: float = -0.5, least: int = 20, drift: int = 50) -> DataFrame:
    """n, n_recent, hours_since, day_pnl, mean_recent, n_mean, losing, counted and issues for each mode of trades (mode, t, id, pnl).

    ``now`` is the hour of the check (a literal). A blank mode is ``unknown``. ``counted`` (mode, n) is what another log has counted; modes that
    only it has come too. Issues: nothing for ``quiet_hours``; ``losses`` trades without a win in a row; a day's loss beyond ``daily``; a mean of the
    latest ``keep`` within ``window_hours`` at or below ``limit``, if they are ``least``; counts that differ by more than ``drift``. A null result is
    no win and no part of a sum or mean. Windows hold one mode's newest trades: only those of the week and the last win are looked at.
    """
    mode = F.when(F.coalesce(F.trim("mode"), F.lit("")) == "", "unknown").otherwise(F.col("mode"))
    today = F.when(F.floor(F.col("t") / 24) == F.floor(now / 24), F.col("pnl"))
    t = trades.select(mode.alias("mode"), "t", "id", "pnl", today.alias("today")).filter(F.col("t") <= now)
    at = F.struct("t", "id")
    whole = t.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") > now - recent_hours).alias("n_recent"), (now - F.max("t")).cast("double").alias("hours_since"),
        F.coalesce(money("today"), F.lit(0.0)).alias("day_pnl"), F.max(F.when(F.col("pnl") > 0, at)).alias("won"),
    )
    after = t.join(whole.select(F.col("mode").alias("_m"), "won"), F.col("mode") == F.col("_m")).filter(F.col("won").isNull() | (at > F.col("won")))
    streak = after.groupBy(F.col("mode").alias("_s")).agg(F.count(F.lit(1)).alias("losing"))
    week = t.filter((F.col("t") > now - window_hours) & F.col("pnl").isNotNull())
    last = week.withColumn("_r", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("t"), F.desc("id")))).filter(F.col("_r") <= keep)
    mean = last.groupBy(F.col("mode").alias("_w")).agg(F.count(F.lit(1)).alias("n_mean"), ratio(money("pnl"), F.count(F.lit(1))).alias("mean_recent"))
    other = counted.select(F.col("mode").alias("_c"), F.col("n").cast("long").alias("counted"))
    d = whole.drop("won").join(streak, F.col("mode") == F.col("_s"), "left").join(mean, F.col("mode") == F.col("_w"), "left").join(other, F.col("mode") == F.col("_c"), "full")
    d = d.withColumns({"mode": F.coalesce("mode", "_c"), **{c: F.coalesce(c, F.lit(0)) for c in ("n", "n_recent", "losing", "n_mean", "counted")}, "day_pnl": F.coalesce("day_pnl", F.lit(0.0))})
    issues = F.array_compact(F.array(
        F.when(F.col("hours_since").isNull(), "no_trades").when(F.col("hours_since") > quiet_hours, "quiet"), F.when(F.col("losing") >= losses, "losing_streak"), F.when(F.col("day_pnl") < daily, "daily_loss"),
        F.when((F.col("n_mean") >= least) & (F.col("mean_recent") <= limit), "low_value"), F.when(F.abs(F.col("counted") - F.col("n")) > drift, "count_drift"),
    ))
    return d.select("mode", "n", "n_recent", "hours_since", "day_pnl", "n_mean", "mean_recent", "losing", "counted", issues.alias("issues"))
