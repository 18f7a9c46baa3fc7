"""Loaders, and market fixtures derived from the star-schema tables: bars, trades, signals, snapshots, flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import ratio
from ..operators.bars import to_bars


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_number(ts: Column) -> Column:
    """Hours since 1970, from the fields of the timestamp, so no time zone enters."""
    return (F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)).cast("long")


def second_number(ts: Column) -> Column:
    """Seconds since 1970, from the fields of the timestamp; fractions are cut off."""
    return hour_number(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of five symbols: symbol, t (hour), seq (order inside), price."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), hour_number(F.col("ts")).alias("t"), F.struct("ts", "event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("amount"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the ticks: symbol, t, open, high, low, close, volume."""
    return to_bars(ticks(spark, sf_dir))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: id, t, ts, symbol, side, mode, variant, pnl, regime."""
    e = load(spark, sf_dir, "events")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % n + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), "ts", hour_number(F.col("ts")).alias("t"), F.hour("ts").alias("hour"), F.col("event_type").alias("symbol"),
        F.when(F.col("user_id") % 2 == 0, F.lit("long")).otherwise(F.lit("short")).alias("side"),
        pick(3, "PAPER", "LIVE", "").alias("mode"), pick(2, "PAPER_MACRO_ON", "PAPER_MACRO_OFF").alias("variant"),
        F.round(F.col("value") - 50, 2).alias("pnl"), (F.col("user_id") % 5).alias("regime"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a model signal: id, t, symbol, signal, confidence, action."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), hour_number(F.col("ts")).alias("t"), F.col("event_type").alias("symbol"), (F.col("value") / 250 - 1).alias("signal"),
        ((F.col("user_id") % 100) / 100.0).alias("confidence"), F.when(F.col("user_id") % 2 == 0, F.lit("long")).otherwise(F.lit("short")).alias("action"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with the return that followed: id, source, regime, signal, ret (null on the last of a type and where the value is 0)."""
    from pyspark.sql.window import Window

    e = load(spark, sf_dir, "events")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("source"), F.col("event_type").alias("regime"), (F.col("value") / 250 - 1).alias("signal"), (ratio(F.lead("value").over(w), F.col("value")) - 1).alias("ret"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly buy and sell volume of each symbol."""
    e = load(spark, sf_dir, "events")
    buy = F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(0.0))
    return e.groupBy(F.col("event_type").alias("symbol"), hour_number(F.col("ts")).alias("t")).agg(buy.alias("buy"), F.sum(F.when(F.col("user_id") % 2 == 0, 0.0).otherwise(F.col("value"))).alias("sell"))


#: The same fixtures as SQL, for the queries' SQL twins.
SQL = {
    "bars": """bars AS (SELECT event_type AS symbol, epoch_us(ts) // 3600000000 AS t, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
      min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)""",
    "trades": """trades AS (SELECT event_id AS id, ts, epoch_us(ts) // 3600000000 AS t, CAST(hour(ts) AS INTEGER) AS hour, event_type AS symbol,
      CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, ['PAPER','LIVE',''][event_id % 3 + 1] AS mode,
      ['PAPER_MACRO_ON','PAPER_MACRO_OFF'][event_id % 2 + 1] AS variant, round(value - 50, 2) AS pnl, user_id % 5 AS regime FROM events)""",
    "signals": """signals AS (SELECT event_id AS id, epoch_us(ts) // 3600000000 AS t, event_type AS symbol, value / 250 - 1 AS signal,
      (user_id % 100) / 100.0::DOUBLE AS confidence, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS action FROM events)""",
    "records": """records AS (SELECT event_id AS id, user_id % 4 AS source, event_type AS regime, value / 250 - 1 AS signal,
      lead(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) / nullif(value, 0) - 1 AS ret FROM events)""",
    "flow": """flow AS (SELECT event_type AS symbol, epoch_us(ts) // 3600000000 AS t, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS buy,
      sum(CASE WHEN user_id % 2 = 0 THEN 0 ELSE value END) AS sell FROM events GROUP BY 1, 2)""",
}


def with_sql(*names: str) -> str:
    """The opening of a statement that defines the named fixtures."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
