"""Bars from ticks, and the table operations of a bar store: latest, dedupe, upsert, insert-if-absent, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_bars(ticks: DataFrame) -> DataFrame:
    """OHLCV of ticks (symbol, t, seq, price, amount) for each symbol and bucket t; one partial aggregation, no sort."""
    return ticks.groupBy("symbol", "t").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("amount").alias("volume")
    )


def resample(bars: DataFrame, width: int) -> DataFrame:
    """Coarser bars: buckets of ``width`` units of t."""
    b = F.floor(F.col("t") / width).cast("long") * width
    return bars.groupBy("symbol", b.alias("t")).agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume")
    )


def latest(rows: DataFrame, n: int, key: str = "symbol", order: str = "t") -> DataFrame:
    """The latest n rows of each key; ranked per key with a group limit, so no key is sorted whole across the network."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def dedupe(rows: DataFrame, keys: list[str], order: str, keep: str = "last") -> DataFrame:
    """One row for each key: the last or first in ``order``; an aggregate that combines map-side."""
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace on the key columns."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    return dedupe(both, keys, "_turn").drop("_turn").select(*old.columns)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and of the new ones those whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def gaps(bars: DataFrame, step: int = 1) -> DataFrame:
    """Rows after a gap: symbol, t, missing (steps that have no bar)."""
    w = Window.partitionBy("symbol").orderBy("t")
    return bars.select("symbol", "t", ((F.col("t") - F.lag("t").over(w)) / step - 1).cast("long").alias("missing")).filter("missing > 0")
