"""Queries of the pattern bank. They join the registry of ``market``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import new_folder, stored
from ..operators import bank as B
from ..operators import indicators as I
from ..sources import tables as S
from .market import W, _full, _r, out, query
from .series import RECURRENCES, features

FIGURES = "mean_short median_short sd_short wins_short mean_long wins_long nearest similarity confidence signal"

_VECTOR = [
    "close / nullif(lag(close) OVER w, 0) - 1", "close / nullif(lag(close, 5) OVER w, 0) - 1", "close / nullif(lag(close, 20) OVER w, 0) - 1", "atr_14 / nullif(close, 0)",
    f"(close - ({_full(20, 'close', 'avg(close)')} - 2 * sd)) / nullif(4 * sd, 0)", f"4 * sd / nullif({_full(20, 'close', 'avg(close)')}, 0)", "rsi_14", "rsi_7", "rsi_21", "macd - macd_signal",
    "k14", "k3", f"volume / nullif({_full(20, 'volume', 'avg(volume)')}, 0)", _full(20, "volume", "stddev_samp(volume)"), f"sin({2 * math.pi!r} * (t % 24) / 24)", f"cos({2 * math.pi!r} * (t % 24) / 24)",
]

BANK = f"""{RECURRENCES}, b0 AS (SELECT bars.*, rsi_14, rsi_7, rsi_21, macd, macd_signal, atr_14, {_full(20, 'bars.close', 'stddev_pop(bars.close)').replace('symbol', 'bars.symbol').replace('BY t', 'BY bars.t')} AS sd FROM bars JOIN z ON z.symbol = bars.symbol AND z.t = bars.t),
b1 AS (SELECT *, 100 * (close - {_full(14, 'low', 'min(low)')}) / nullif({_full(14, 'high', 'max(high)')} - {_full(14, 'low', 'min(low)')}, 0) AS k14 FROM b0), b2 AS (SELECT *, {_full(3, 'k14', 'avg(k14)')} AS k3 FROM b1),
vec AS (SELECT symbol, t, lead(close, 12) OVER w / nullif(close, 0) - 1 AS fs, lead(close, 48) OVER w / nullif(close, 0) - 1 AS fl, lead(close, 48) OVER w IS NOT NULL AS known, [{", ".join(f"coalesce({x}, 0)" for x in _VECTOR)}] AS v FROM b2 WINDOW w AS ({W})),
big AS (SELECT symbol FROM vec GROUP BY 1 HAVING count(*) >= 148), en AS (SELECT symbol, i, avg(v[i]) AS m, stddev_pop(v[i]) + 1e-8 AS s FROM vec, unnest(range(1, 17)) u(i) WHERE known AND symbol IN (FROM big) GROUP BY 1, 2),
st AS (SELECT symbol, list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM en GROUP BY 1), zz AS (SELECT vec.*, list_transform(v, lambda x, i: (x - m[i]) / s[i]) AS a FROM vec JOIN st ON st.symbol = vec.symbol),
un AS (SELECT *, list_transform(a, lambda x: x / (sqrt(list_inner_product(a, a)) + 1e-8)) AS u FROM zz)"""


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars with the features of a signature."""
    bars = I.volume_profile(I.stochastic(I.bollinger(I.returns(S.hourly_bars(spark, d)))))
    angle = 2 * math.pi * (F.col("t") % 24) / 24
    more = features(spark, d).select(F.col("symbol").alias("_s"), F.col("t").alias("_t"), "atr_pct", "rsi_7", "rsi_14", "rsi_21", "macd_hist")
    return bars.join(more, (F.col("symbol") == F.col("_s")) & (F.col("t") == F.col("_t"))).withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})


@query(f"""{BANK} SELECT symbol, t, {", ".join(f"round(u[{i}], 6) AS u{i}" for i in (1, 4, 7, 10, 11, 14))}, round(fs, 6) AS fwd_short, round(fl, 6) AS fwd_long FROM un WHERE known""")
def pattern_bank(spark: SparkSession, d: str) -> DataFrame:
    """The stored patterns: some entries of the normalised vectors, and what followed."""
    path = new_folder(spark, "bank")
    B.build(stored(B.patterns(_bars(spark, d))), path)
    v = spark.read.parquet(f"{path}/vectors")
    return out(v.withColumns({f"u{i}": F.col("v")[i - 1] for i in (1, 4, 7, 10, 11, 14)}), "symbol t", "u1 u4 u7 u10 u11 u14 fwd_short fwd_long")


@query(f"""{BANK}, x AS (SELECT q.symbol, q.t, b.fs, b.fl, list_inner_product(q.u, b.u) / ((sqrt(list_inner_product(q.u, q.u)) + 1e-8) * (sqrt(list_inner_product(b.u, b.u)) + 1e-8)) AS sim FROM un q JOIN un b ON q.symbol = b.symbol AND NOT q.known AND b.known),
kk AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY sim DESC) <= 100),
g AS (SELECT symbol, t, count(*) AS n, avg(fs) AS mean_short, median(fs) AS median_short, stddev_pop(fs) AS sd_short, avg(CASE WHEN fs > 0 THEN 1 ELSE 0 END) AS wins_short, avg(fl) AS mean_long, avg(CASE WHEN fl > 0 THEN 1 ELSE 0 END) AS wins_long, max(sim) AS nearest, avg(sim) AS similarity FROM kk GROUP BY 1, 2 HAVING count(*) >= 30),
o AS (SELECT *, greatest(0, least(1, abs(mean_short) / (sd_short + 1e-4) * similarity)) AS confidence, CASE WHEN mean_short > 0.001 THEN 'long' WHEN mean_short < -0.001 THEN 'short' ELSE 'neutral' END AS direction, greatest(-1, least(1, mean_short / 0.01)) AS signal FROM g)
SELECT symbol, t, n, direction, {_r(FIGURES)} FROM o""")
def pattern_outlook(spark: SparkSession, d: str) -> DataFrame:
    """What followed the hundred stored patterns nearest to each bar whose own future is not known yet."""
    path, found = new_folder(spark, "bank"), stored(B.patterns(_bars(spark, d)).withColumn("query", F.xxhash64("symbol", "t")))
    B.build(found.drop("query"), path)
    now = found.filter("NOT known")
    seen = B.outlook(spark, path, B.search(spark, path, now, 100))
    return out(seen.join(now.select("query", "symbol", "t"), "query"), "symbol t n direction", FIGURES)


@query()
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten rows most similar to every twentieth embedding, from the twelve nearest of sixteen lists; tests hold its recall above 0.9."""
    e = S.load(spark, d, "embeddings")
    rows = e.select(F.lit("all").alias("symbol"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(0.0).alias("fwd_short"), F.lit(0.0).alias("fwd_long"), F.lit(True).alias("known"))
    path = new_folder(spark, "bank")
    B.build(rows, path, normalise=False)
    found = B.search(spark, path, rows.filter("t % 20 = 0").select(F.col("t").alias("query"), "symbol", "vector"), 11, probes=12)
    ids = spark.read.parquet(f"{path}/vectors").select(F.col("id").alias("neighbour"), F.col("t").alias("vec_id"))
    found = found.join(ids, "neighbour").filter("vec_id <> query").withColumn("neighbour", F.col("vec_id")).select("query", "neighbour", "similarity")
    return B.ranked(found, 10)
