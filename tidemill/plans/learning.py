"""Queries of adjustment maps, histories and nested snapshots. They join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import new_folder, stored
from ..operators import adjustments as A
from ..operators import health as HE
from ..operators import histories as H
from ..sources import tables as S
from .market import BARS, RECORDS, SIGNALS, TRADES, out, query


def _trades(spark: SparkSession, d: str) -> DataFrame:
    """Closed trades with the strength of their signal, whether it agreed with the side, and results around zero."""
    s = S.signals(spark, d).select("id", F.when(F.abs("signal") < 0.2, "weak").when(F.abs("signal") < 0.4, "medium").otherwise("strong").alias("strength"), (F.col("signal") > 0).alias("up"))
    t = S.trades(spark, d).filter("mode <> ''").join(s, "id")
    return t.withColumns({"pnl": F.round(F.col("pnl") - 30, 2), "agreed": F.col("up") == (F.col("side") == "long"), "hour": F.col("hour").cast("long")})


ADJUSTMENTS = f"""{TRADES}, {SIGNALS.removeprefix("WITH ")}, tr AS (SELECT t.id, mode, hour, t.symbol, regime, side, CASE WHEN abs(signal) < 0.2 THEN 'weak' ELSE 'other' END AS strength, (signal > 0) = (side = 'long') AS agreed, round(pnl - 30, 2) AS pnl FROM trades t JOIN signals s ON s.id = t.id WHERE mode <> ''),
big AS (SELECT mode FROM tr GROUP BY 1 HAVING count(*) >= 10), di AS (SELECT mode, pnl, unnest([{{'d': 'hour', 'v': CAST(hour AS VARCHAR)}}, {{'d': 'regime', 'v': CAST(regime AS VARCHAR)}}, {{'d': 'side', 'v': side}}, {{'d': 'strength', 'v': strength}}, {{'d': 'outside', 'v': CASE WHEN agreed THEN 'agreed' ELSE 'disagreed' END}}, {{'d': 'symbol', 'v': symbol}}], recursive := true) FROM tr WHERE mode IN (FROM big)),
fi AS (SELECT mode, d, v, count(*) AS n, count(*) FILTER (pnl > 0) / count(*)::DOUBLE AS r, sum(CAST(pnl AS DECIMAL(18, 6))) AS s FROM di GROUP BY 1, 2, 3),
st AS (SELECT tr.mode, count(*) FILTER (tr.id > coalesce(l, -1)) AS k FROM tr JOIN (SELECT mode, max(id) FILTER (pnl > 0) AS l FROM tr GROUP BY 1) x ON x.mode = tr.mode WHERE tr.mode IN (FROM big) GROUP BY 1),
fb AS (SELECT mode, 'avoid_hour_' || v AS key, 1.0::DOUBLE AS value FROM fi WHERE d = 'hour' AND n >= 5 AND r < 0.3 AND s < 0 UNION ALL SELECT mode, 'regime_scale_' || v, CASE WHEN r < 0.3 THEN 0.3 ELSE 1.3 END FROM fi WHERE d = 'regime' AND n >= 5 AND (r < 0.3 OR r > 0.65)
 UNION ALL SELECT mode, 'direction_scale_' || v, 0.5 FROM fi WHERE d = 'side' AND n >= 10 AND r < 0.35 UNION ALL SELECT mode, 'min_signal_strength', 0.2 FROM fi WHERE d = 'strength' AND v = 'weak' AND n >= 10 AND r < 0.4
 UNION ALL SELECT mode, 'external_weight_boost', CASE WHEN r > 0.6 THEN 1.3 ELSE 0.5 END FROM fi WHERE d = 'outside' AND v = 'agreed' AND n >= 10 AND (r > 0.6 OR r < 0.35) UNION ALL SELECT mode, 'external_disagree_block', 1 FROM fi WHERE d = 'outside' AND v = 'disagreed' AND n >= 10 AND r < 0.3
 UNION ALL SELECT mode, 'losing_streak_scale', greatest(0.3, 1 - 0.15 * k) FROM st WHERE k >= 3),
pl AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY s, CAST(v AS INTEGER)) AS worst, row_number() OVER (PARTITION BY mode ORDER BY s DESC, CAST(v AS INTEGER)) AS best FROM fi WHERE d = 'hour'),
wh AS (SELECT mode, count(*) FILTER (pnl > 0) / count(*)::DOUBLE AS r, sum(CAST(pnl AS DECIMAL(18, 6))) AS s, avg(pnl) FILTER (pnl > 0) / nullif(abs(avg(pnl) FILTER (pnl <= 0)), 0) AS odds FROM tr WHERE mode IN (FROM big) GROUP BY 1),
da AS (SELECT mode, 'avoid_hour_' || v AS key, 1.0::DOUBLE AS value FROM pl WHERE worst <= 3 AND n >= 3 AND r < 0.25 AND s < 0 UNION ALL SELECT mode, 'boost_hour_' || v, 1.2 FROM pl WHERE best <= 3 AND n >= 3 AND r > 0.65
 UNION ALL SELECT mode, 'scale_' || v, CASE WHEN r < 0.25 THEN 0.5 ELSE 1.3 END FROM fi WHERE d = 'symbol' AND n >= 5 AND ((r < 0.25 AND s < 0) OR (r > 0.6 AND s > 0)) UNION ALL SELECT mode, 'rr_ratio', round_even(odds, 2) FROM wh WHERE odds IS NOT NULL
 UNION ALL SELECT mode, 'global_scale', 1 + CASE WHEN r < 0.3 THEN -0.1 ELSE 0.1 END FROM wh WHERE r < 0.3 OR (r > 0.55 AND s > 0)),
al AS (SELECT * FROM da UNION ALL SELECT * FROM fb WHERE (mode, key) NOT IN (SELECT (mode, key) FROM da))"""


def _maps(spark: SparkSession, d: str) -> DataFrame:
    """mode and the merged map."""
    t = _trades(spark, d)
    old, new = A.feedback_adjustments(t).withColumnRenamed("adjustments", "old"), A.daily_adjustments(t).withColumnRenamed("adjustments", "new")
    # The feedback is the older view here; a losing streak in it must not recover before it is used.
    both = old.join(new, "mode", "full")
    streak = F.map_filter(F.coalesce("old", F.create_map().cast("map<string,double>")), lambda k, _: k == "losing_streak_scale")
    return both.select("mode", A.merged(F.col("old"), F.map_concat(F.coalesce("new", F.create_map().cast("map<string,double>")), streak)).alias("adjustments"))


@query(f"{ADJUSTMENTS} SELECT mode, key, round(value, 6) AS value FROM al")
def adjustment_maps(spark: SparkSession, d: str) -> DataFrame:
    """Each mode's adjustments, from the results by hour, regime, side, strength, outside view and symbol."""
    read = F.from_json(F.to_json("adjustments"), "map<string,double>")  # as a sink would write and read it
    return _maps(spark, d).select("mode", F.explode(read).alias("key", "value")).select("mode", "key", F.round("value", 6).alias("value"))


@query(f"""{ADJUSTMENTS}, m AS (SELECT mode, map_from_entries(list((key, value))) AS m FROM al GROUP BY 1)
SELECT id, round(greatest(0, least(2, coalesce(m['global_scale'], 1) * coalesce(m['scale_' || symbol], 1) * CASE WHEN m['avoid_hour_' || hour] IS NOT NULL THEN 0 ELSE coalesce(m['boost_hour_' || hour], 1) END)), 6) AS scale FROM tr JOIN m ON m.mode = tr.mode""")
def adjusted_scales(spark: SparkSession, d: str) -> DataFrame:
    """What the adjustments make of each trade's size."""
    t = _trades(spark, d).join(_maps(spark, d), "mode")
    return t.select("id", F.round(A.position_scale(F.col("adjustments"), F.col("symbol"), F.col("hour")), 6).alias("scale"))


@query(f"{RECORDS} SELECT id, source, signal, ret FROM records WHERE ret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY id DESC) <= 500")
def kept_records(spark: SparkSession, d: str) -> DataFrame:
    """The newest five hundred records of each source, appended in three batches of which one comes twice (the retention is the feature)."""
    path, r = new_folder(spark, "history"), S.records(spark, d).filter("ret IS NOT NULL").select("id", "source", "signal", "ret")
    r = stored(r.withColumn("part", F.ntile(3).over(Window.partitionBy("source").orderBy("id"))))
    for number in (0, 1, 1, 2):
        H.append(r.filter(F.col("part") == number + 1).drop("part"), number, path, ["source"], ["id"])
    return H.history(spark, path, "id long, source long, signal double, ret double", ["source"], ["id"])


@query(f"""{BARS}, sn AS (SELECT symbol, t, CASE WHEN avg(signal) > 0.1 THEN 'bullish' WHEN avg(signal) < -0.1 THEN 'bearish' ELSE 'neutral' END AS direction, avg(signal) AS score, 0.0::DOUBLE + max(confidence) * avg(signal) AS ev FROM ({SIGNALS} SELECT * FROM signals) WHERE t % 3 = 0 GROUP BY 1, 2),
o AS (SELECT b.symbol, b.t, coalesce(score, 0) AS score, coalesce(ev, 0) AS ev, coalesce(CAST(direction = 'bullish' AS DOUBLE), 0) AS up, coalesce(CAST(direction = 'bearish' AS DOUBLE), 0) AS down FROM bars b ASOF LEFT JOIN (FROM sn WHERE symbol IN (SELECT symbol FROM sn GROUP BY 1 HAVING count(*) >= 50)) sn ON b.symbol = sn.symbol AND b.t >= sn.t)
SELECT symbol, t, round(score, 9) AS ext_score, round(ev, 9) AS ext_ev, up AS ext_is_bullish, down AS ext_is_bearish FROM o""")
def snapshot_features(spark: SparkSession, d: str) -> DataFrame:
    """Bars with the latest three-hourly snapshot: score, probable value of its scenarios, direction as two columns."""
    g = S.signals(spark, d).filter("t % 3 = 0").groupBy("symbol", "t").agg(F.avg("signal").alias("score"), F.max("confidence").alias("p"))
    scenarios = F.array(F.struct(F.lit("as it is").alias("label"), F.col("p").alias("probability"), F.col("score").alias("value")), F.struct(F.lit("nothing").alias("label"), (1 - F.col("p")).alias("probability"), F.lit(0.0).alias("value")))
    direction = F.when(F.col("score") > 0.1, "bullish").when(F.col("score") < -0.1, "bearish").otherwise("neutral")
    new = g.select("symbol", "t", direction.alias("direction"), "score", scenarios.alias("scenarios"))
    all_ = H.upsert_snapshots(new.withColumn("score", F.lit(9.0)), new)  # every stored one is replaced
    hot = H.one_hot(all_.withColumn("ev", H.expected(F.col("scenarios")))).drop("scenarios")
    return out(H.gated_join(S.hourly_bars(spark, d).select("symbol", "t"), hot), "symbol t ext_is_bullish ext_is_bearish", "ext_score ext_ev", 9)


NOW = 474000  # the hour of the check: late in the events' month


@query(f"""{TRADES}, x AS (SELECT CASE WHEN mode = '' THEN 'unknown' ELSE mode END || '/' || symbol AS mode, t, id, round(pnl - 150, 2) AS pnl FROM trades WHERE t <= {NOW}), c AS (SELECT mode, count(*) + 30 * (count(*) % 3) AS n FROM x GROUP BY 1),
w AS (SELECT mode, max(row(t, id)) FILTER (pnl > 0) AS won FROM x GROUP BY 1), s AS (SELECT x.mode, count(*) FILTER (won IS NULL OR row(t, id) > won) AS losing FROM x JOIN w ON w.mode = x.mode GROUP BY 1),
l AS (SELECT mode, pnl FROM x WHERE t > {NOW - 168} QUALIFY row_number() OVER (PARTITION BY mode ORDER BY t DESC, id DESC) <= 50), m AS (SELECT mode, count(*) AS n_mean, sum(CAST(pnl AS DECIMAL(18, 6)))::DOUBLE / count(*) AS mean_recent FROM l GROUP BY 1),
a AS (SELECT mode, count(*) AS n, count(*) FILTER (t > {NOW - 48}) AS n_recent, CAST({NOW} - max(t) AS DOUBLE) AS hours_since, coalesce(sum(CAST(pnl AS DECIMAL(18, 6))) FILTER (t // 24 = {NOW // 24}), 0)::DOUBLE AS day_pnl FROM x GROUP BY 1),
d AS (SELECT a.*, losing, coalesce(n_mean, 0) AS n_mean, mean_recent, c.n AS counted FROM a JOIN s ON s.mode = a.mode LEFT JOIN m ON m.mode = a.mode JOIN c ON c.mode = a.mode)
SELECT mode, n, n_recent, hours_since, n_mean, losing, counted, round(day_pnl, 4) AS day_pnl, round(mean_recent, 4) AS mean_recent, concat_ws('|', CASE WHEN hours_since > 6 THEN 'quiet' END, CASE WHEN losing >= 5 THEN 'losing_streak' END, CASE WHEN day_pnl < -300 THEN 'daily_loss' END,
  CASE WHEN n_mean >= 20 AND mean_recent <= 60 THEN 'low_value' END, CASE WHEN abs(counted - n) > 50 THEN 'count_drift' END) AS issues FROM d""")
def health_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of each mode and symbol, late in the month, against counts that another log might have."""
    name = F.concat_ws("/", F.when(F.col("mode") == "", "unknown").otherwise(F.col("mode")), "symbol")
    t = S.trades(spark, d).withColumns({"mode": name, "pnl": F.round(F.col("pnl") - 150, 2)})
    counted = t.filter(F.col("t") <= NOW).groupBy("mode").agg(F.count(F.lit(1)).alias("c")).select("mode", (F.col("c") + 30 * (F.col("c") % 3)).alias("n"))
    h = HE.health(t, counted, F.lit(NOW), quiet_hours=6.0, limit=60.0)
    return out(h.withColumn("issues", F.array_join("issues", "|")), "mode n n_recent hours_since n_mean losing counted issues", "day_pnl mean_recent", 4)
