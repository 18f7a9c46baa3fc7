"""Table operations and summaries: defaults, recent rows, thinning, sequences, normalisation, status of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType
from pyspark.sql.window import Window

from ..functions.frames import ordered, ratio
from .trades import money


def with_defaults(rows: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Null and zero replaced by each column's default."""
    return rows.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(v)) for c, v in defaults.items()})


def recent(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last ``days`` before the newest row; the newest time is one aggregate of one row."""
    newest = rows.agg(F.max(ts).alias("_newest"))
    return rows.join(F.broadcast(newest), F.col(ts) > F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")


def complete(rows: DataFrame) -> DataFrame:
    """Rows without null or NaN in any column."""
    for f in rows.schema:
        bad = F.col(f.name).isNull()
        rows = rows.filter(~(bad | F.isnan(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else bad))
    return rows


def every(rows: DataFrame, k: int) -> DataFrame:
    """Every k-th row of each symbol, the first included."""
    return rows.withColumn("_n", F.row_number().over(ordered())).filter((F.col("_n") - 1) % k == 0).drop("_n")


def since_or_unparsed(rows: DataFrame, stamp: str, start: str) -> DataFrame:
    """Rows whose time is not before ``start``, and those whose time cannot be read."""
    t = F.try_to_timestamp(F.col(stamp))
    return rows.filter(t.isNull() | (t >= F.lit(start).cast("timestamp")))


def quoted(rows: DataFrame, suffix: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Symbols with a suffix, with the part before its slash as ``base``, certain bases left out."""
    base = F.split_part("symbol", F.lit("/"), F.lit(1))
    return rows.filter(F.col("symbol").endswith(suffix)).withColumn("base", base).filter(~F.col("base").isin(*without) if without else F.lit(True))


def config_hash(fields: dict[str, Column]) -> Column:
    """The first 12 hex digits of the MD5 of a flat configuration as JSON with sorted keys; separators are a comma and a colon, each
    followed by a space. Numbers are whole; text is quoted without escapes, so it must not hold quotes or backslashes."""
    parts = []
    for k in sorted(fields):
        text = fields[k].cast("string")
        parts.append(F.concat(F.lit(f'"{k}": '), F.when(text.rlike(r"^-?[0-9]+$"), text).otherwise(F.concat(F.lit('"'), text, F.lit('"')))))
    return F.substring(F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).cast("binary")), 1, 12)


def count_drift(left: DataFrame, right: DataFrame, most: int = 50) -> DataFrame:
    """Rows of both sides, their difference, and whether it is larger than allowed."""
    n = lambda d, side: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    both = n(left, "l").unionByName(n(right, "r")).agg(F.sum(F.when(F.col("side") == "l", F.col("n"))).alias("n_left"), F.sum(F.when(F.col("side") == "r", F.col("n"))).alias("n_right"))
    gap = F.col("n_left") - F.col("n_right")
    return both.withColumns({"gap": gap, "drifted": F.abs(gap) > most})


def normalise(rows: DataFrame, columns: list[str], by: str, floor: float = 1e-8) -> DataFrame:
    """Columns less their mean, over their population deviation, for each group; the statistics are one row a group."""
    stats = rows.groupBy(by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    d = rows.join(stats, by)
    return d.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + floor) for c in columns}).select(*rows.columns)


def sequences(rows: DataFrame, features: list[str], label: str, n: int) -> DataFrame:
    """For each row with n rows before it their features, oldest first, as one bounded array, and the row's label."""
    w = ordered().rowsBetween(-n, -1)
    d = rows.withColumn("window", F.collect_list(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])).over(w))
    return d.filter(F.size("window") == n).select("symbol", "t", "window", F.col(label).alias("label"))


def bad_hours(trades: DataFrame) -> DataFrame:
    """Hours of negative mean result of each mode, ascending: at most 24 entries."""
    d = trades.groupBy("mode", "hour").agg(F.avg("pnl").alias("ev")).filter("ev < 0")
    return d.groupBy("mode").agg(F.sort_array(F.collect_list("hour")).alias("hours"))


def strength_buckets(trades: DataFrame) -> DataFrame:
    """Wins, losses and sum by the strength of the signal."""
    s = F.abs("signal")
    return trades.groupBy(F.when(s < 0.2, "weak").when(s < 0.4, "medium").otherwise("strong").alias("strength")).agg(F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") <= 0).alias("losses"), money("pnl").alias("total"))


def reserve_status(entries: DataFrame, price: float) -> DataFrame:
    """Holdings, mean cost and unrealised result at a price, of each source and of all together."""
    d = entries.rollup("source").agg(F.grouping("source").alias("_all"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.sum(F.col("amount") * F.col("price")).alias("_paid"))
    return d.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("source")).alias("source"), "n", "amount", ratio(F.col("_paid"), F.col("amount")).alias("cost"), (F.col("amount") * price - F.col("_paid")).alias("unrealised"))


def account_summary(trades: DataFrame, capital: float) -> DataFrame:
    """Count, win rate in percent, sum, best, worst and return of closed trades; one row, also for none."""
    n = F.count(F.lit(1))
    return trades.agg(n.alias("n"), F.coalesce(ratio(100.0 * F.count_if(F.col("pnl") > 0), n), F.lit(0.0)).alias("win_rate"), F.coalesce(money("pnl"), F.lit(0.0)).alias("total"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"), (F.coalesce(money("pnl"), F.lit(0.0)) * 100 / capital).alias("return_pct"))


def unit_root(rows: DataFrame, by: list[str], value: str, order: str, least: int = 30, critical: float = -2.86) -> DataFrame:
    """Regression of the change on the level before it: slope, its t statistic, and whether that lies below the critical value."""
    prev = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    d = rows.withColumns({"_q": prev, "_d": F.col(value) - prev}).filter("_q IS NOT NULL")
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_d", "_q").alias("beta"), F.regr_syy("_d", "_q").alias("_yy"), F.regr_sxy("_d", "_q").alias("_xy"), F.regr_sxx("_d", "_q").alias("_xx")).filter(F.col("n") >= least)
    rest = F.greatest(F.lit(0.0), F.col("_yy") - F.col("beta") * F.col("_xy"))
    t = ratio(F.col("beta"), F.sqrt(ratio(ratio(rest, F.col("n") - 2), F.col("_xx"))))
    return g.withColumn("t_stat", t).withColumn("cointegrated", F.coalesce(F.col("t_stat") < critical, F.lit(False))).select(*by, "n", "beta", "t_stat", "cointegrated")
