"""Labels of bars: forward returns, triple barriers, sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import lagged, ordered, ratio


def forward_returns(bars: DataFrame, steps: tuple[int, ...] = (12, 48), threshold: float = 0.005) -> DataFrame:
    """Returns over the bars ahead; the label of the first is 2 up, 0 down, 1 between or unknown."""
    d = bars.withColumns({f"fwd_{n}": ratio(F.lead("close", n).over(ordered()), F.col("close")) - 1 for n in steps})
    x = F.col(f"fwd_{steps[0]}")
    return d.withColumn("label", F.when(x > threshold, 2).when(x < -threshold, 0).otherwise(1))


def true_range(bars: DataFrame) -> Column:
    prev = lagged("close", 1)
    return F.coalesce(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)), F.col("high") - F.col("low"))


def triple_barrier(bars: DataFrame, atr: str, take: float = 2.0, stop: float = 1.0, hold: int = 24, least: float = 0.0025) -> DataFrame:
    """First barrier a long entry at each close touches within ``hold`` bars: take-profit, stop or time.

    In one bar the stop counts first. At time-out the label follows the sign of the return beyond ``least``. The last bar of a
    symbol has no future and no label. The next bars are one bounded array a row, searched by built-in functions.
    """
    w = ordered().rowsBetween(1, hold)
    entry, width = F.col("close"), F.coalesce(F.when(F.col(atr) > 0, F.col(atr)), F.col("close") * 0.01)
    d = bars.withColumns({"_pt": entry + take * width, "_sl": entry - stop * width, "_next": F.collect_list(F.struct("high", "low", "close", "t")).over(w)})
    hit = F.filter("_next", lambda b: (b["low"] <= F.col("_sl")) | (b["high"] >= F.col("_pt")))
    d = d.withColumn("_hit", F.get(hit, F.lit(0))).withColumn("_last", F.get("_next", F.size("_next") - 1))
    kind = F.when(F.col("_hit").isNull(), F.lit("time")).when(F.col("_hit.low") <= F.col("_sl"), F.lit("sl")).otherwise(F.lit("pt"))
    d = d.withColumn("tb_hit", F.when(F.size("_next") > 0, kind))
    exit_ = F.when(F.col("tb_hit") == "pt", F.col("_pt")).when(F.col("tb_hit") == "sl", F.col("_sl")).otherwise(F.col("_last.close"))
    d = d.withColumns({"tb_ret": ratio(exit_ - entry, entry), "tb_t1": F.coalesce(F.col("_hit.t"), F.col("_last.t"))})
    r = F.col("tb_ret")
    label = F.when(F.col("tb_hit") == "pt", 2).when(F.col("tb_hit") == "sl", 0).when(r > least, 2).when(r < -least, 0).when(r.isNotNull(), 1)
    return d.withColumn("tb_label", label).drop("_pt", "_sl", "_next", "_hit", "_last")


def sample_weights(labelled: DataFrame, label: str) -> DataFrame:
    """Inverse class frequency with mean 1; the counts are one small aggregate joined back."""
    n = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumns({"_all": F.sum("_n").over(Window.partitionBy()), "_k": F.count(F.lit(1)).over(Window.partitionBy())})
    return labelled.join(n.select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight")), label)
