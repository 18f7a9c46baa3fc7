"""More market queries: feedback, state machines, models, text and log scans. They join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import last
from ..operators import feedback as FB
from ..operators import indicators as I
from ..operators import labels as LB
from ..operators import machines as MC
from ..operators import models as MD
from ..operators import signals as SG
from ..operators import splits as SP
from ..operators import stats as ST
from ..sources import tables as S
from .market import BARS, FLOW, RECORDS, SIGNALS, TRADES, W, _actions, _full, _r, _rank, _rows, out, query

BOOK = """book AS (SELECT event_type AS symbol, epoch_us(ts) // 3600000000 AS t, list(value ORDER BY value DESC) FILTER (user_id % 2 = 0) AS b, list(value ORDER BY value) FILTER (user_id % 2 = 1) AS a FROM events GROUP BY 1, 2),
s AS (SELECT symbol, t, coalesce(list_sum(b[1:2]), 0) AS bid_volume, coalesce(list_sum(a[1:2]), 0) AS ask_volume, a[1] - b[1] AS spread FROM book)"""


@query(f"WITH {BOOK} SELECT symbol, t, {_r('bid_volume ask_volume spread')}, round(coalesce((bid_volume - ask_volume) / nullif(bid_volume + ask_volume, 0), 0), 6) AS imbalance FROM s")
def top_of_book(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "events")
    level = F.struct(F.col("value").alias("price"), F.col("value").alias("size"))
    books = e.groupBy(F.col("event_type").alias("symbol"), S.hour_number(F.col("ts")).alias("t")).agg(
        F.sort_array(F.collect_list(F.when(F.col("user_id") % 2 == 0, level)), asc=False).alias("bids"), F.sort_array(F.collect_list(F.when(F.col("user_id") % 2 == 1, level))).alias("asks")
    )
    return out(FB.top_of_book(books, 2), "symbol t", "bid_volume ask_volume spread imbalance")


@query(f"""{TRADES}, x AS (SELECT regime, hour, list_sort(list_distinct(list(CASE WHEN id % 2 = 0 THEN symbol || '_a' ELSE symbol || '_b' END))) AS l, sum(pnl) AS pnl FROM trades GROUP BY 1, 2),
y AS (SELECT array_to_string(list_sort(list_distinct(list_transform(l, lambda s: split_part(s, '_', 1)))), '+') AS path, pnl FROM x)
SELECT path, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, round(sum(pnl), 4) AS total FROM y GROUP BY 1""")
def path_combinations(spark: SparkSession, d: str) -> DataFrame:
    t = S.trades(spark, d)
    tag = F.concat("symbol", F.when(F.col("id") % 2 == 0, F.lit("_a")).otherwise(F.lit("_b")))
    rows = t.groupBy("regime", "hour").agg(F.collect_set(tag).alias("sources"), F.sum("pnl").alias("pnl"))
    return out(FB.path_combinations(rows, "sources", "pnl"), "path n wins", "total", 4)


@query(f"""{TRADES}, x AS (SELECT pnl, side, CASE WHEN id % 3 = 0 THEN 'long' ELSE 'short' END AS e, (id % 10) / 10.0 AS s FROM trades),
y AS (SELECT pnl, unnest(['dir_' || e, CASE WHEN e = side THEN 'agreed' ELSE 'disagreed' END, 'ext_' || CASE WHEN s < 0.2 THEN 'weak' WHEN s < 0.4 THEN 'medium' ELSE 'strong' END]) AS key FROM x)
SELECT key, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses, round(sum(pnl), 4) AS total FROM y GROUP BY 1""")
def external_agreement(spark: SparkSession, d: str) -> DataFrame:
    t = S.trades(spark, d).withColumns({"external_direction": F.when(F.col("id") % 3 == 0, "long").otherwise("short"), "external_score": (F.col("id") % 10) / 10.0})
    return out(FB.agreement(t), "key wins losses", "total", 4)


@query(f"""{TRADES}, x AS (SELECT ['sl', 'tp', 'time'][regime % 3 + 1] AS reason, count(*) AS n, sum(pnl) AS total, avg(pnl) AS mean FROM trades GROUP BY 1), y AS (SELECT *, n / sum(n) OVER () AS share FROM x)
SELECT reason, n, {_r('total mean share', 4)}, CASE WHEN reason = 'sl' THEN CASE WHEN share > 0.65 THEN 'widen' WHEN share < 0.3 THEN 'tighten' ELSE 'keep' END END AS advice FROM y""")
def exit_reasons(spark: SparkSession, d: str) -> DataFrame:
    t = S.trades(spark, d).withColumn("reason", F.element_at(F.array(F.lit("sl"), F.lit("tp"), F.lit("time")), (F.col("regime") % 3 + 1).cast("int")))
    return out(FB.exit_reasons(t), "reason n advice", "total mean share", 4)


@query(f"""{TRADES}, r AS (SELECT hour AS config, pnl FROM trades QUALIFY row_number() OVER (PARTITION BY hour ORDER BY t DESC, id DESC) <= 100), x AS (SELECT config, count(*) AS n, round(sum(pnl), 4) AS total FROM r GROUP BY 1 HAVING count(*) >= 3)
SELECT config, n, total, CAST(row_number() OVER (ORDER BY total DESC, config) AS INTEGER) AS rank FROM x""")
def best_configs(spark: SparkSession, d: str) -> DataFrame:
    return out(FB.best_configs(S.trades(spark, d).withColumnRenamed("hour", "config"), "config"), "config n rank", "total", 4)


@query(f"""{RECORDS}, x AS (SELECT source, {_rank('signal', 'source')} AS a, {_rank('ret', 'source')} AS b FROM records WHERE ret IS NOT NULL), y AS (SELECT source, corr(a, b) AS ic FROM x GROUP BY 1)
SELECT source, round(ic, 6) AS ic, 0.75 + 0.25 * CASE WHEN ic <= -0.03 THEN 0.3 WHEN ic <= 0 THEN 0.5 WHEN ic <= 0.03 THEN 0.8 WHEN ic <= 0.05 THEN 1.0 WHEN ic <= 0.1 THEN 1.3 ELSE 1.5 END::DOUBLE AS multiplier FROM y""")
def ic_multipliers(spark: SparkSession, d: str) -> DataFrame:
    ic = ST.spearman(S.records(spark, d), "signal", "ret", ["source"])
    return ic.select("source", F.round("ic", 6).alias("ic"), FB.ic_multiplier(F.col("ic"), F.lit(1.0)).alias("multiplier"))


@query("""WITH x AS (SELECT event_type AS venue, event_id AS id, value - 100 AS slippage, CAST(user_id % 100 AS DOUBLE) AS latency, user_id % 3 = 0 AS maker FROM events WHERE value - 100 BETWEEN -200 AND 200),
r AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY venue ORDER BY id DESC) <= 50)
SELECT venue, count(*) AS n, round(median(slippage), 6) AS slippage, round(median(latency), 6) AS latency, round(count(*) FILTER (maker) / count(*)::DOUBLE, 6) AS maker_rate FROM r GROUP BY 1""")
def execution_stats(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "events").select(F.col("event_type").alias("venue"), F.col("event_id").alias("id"), (F.col("value") - 100).alias("slippage"), (F.col("user_id") % 100).cast("double").alias("latency"), (F.col("user_id") % 3 == 0).alias("maker"))
    return out(FB.execution_stats(e, "venue"), "venue n", "slippage latency maker_rate")


@query("""WITH x AS (SELECT event_type AS model, epoch_us(ts) // 3600000000 AS t, event_id AS id, value / 500 AS accuracy FROM events), r AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY model ORDER BY t DESC, id DESC) <= 10)
SELECT model, count(*) AS n, round(avg(accuracy), 6) AS mean, CASE WHEN arg_max(accuracy, row(t, id)) > arg_min(accuracy, row(t, id)) THEN 'improving' ELSE 'declining' END AS trend FROM r GROUP BY 1""")
def model_trend(spark: SparkSession, d: str) -> DataFrame:
    e = S.load(spark, d, "events").select(F.col("event_type").alias("model"), S.hour_number(F.col("ts")).alias("t"), F.col("event_id").alias("id"), (F.col("value") / 500).alias("accuracy"))
    return out(FB.model_trend(e), "model n trend", "mean")


@query(f"""{BARS}, x AS (SELECT symbol, t, CASE WHEN close > open THEN 2 WHEN close < open THEN 0 ELSE 1 END AS label FROM bars),
y AS (SELECT *, 0.998 ** (count(*) OVER (PARTITION BY symbol) - row_number() OVER ({W})) * count(*) OVER (PARTITION BY symbol) / count(*) OVER (PARTITION BY symbol, label) AS w FROM x)
SELECT symbol, t, label, round(w / avg(w) OVER (PARTITION BY symbol), 6) AS weight FROM y""")
def decay_weights(spark: SparkSession, d: str) -> DataFrame:
    b = S.hourly_bars(spark, d).withColumn("label", F.when(F.col("close") > F.col("open"), 2).when(F.col("close") < F.col("open"), 0).otherwise(1))
    return out(FB.decay_weights(b, "label"), "symbol t label", "weight")


@query("""WITH m AS (SELECT event_type AS model, count(*) % 30 AS hours, avg(value) / 500 AS accuracy, max(value) / 500 AS previous, count(*) % 2 = 0 AS regime_changed FROM events GROUP BY 1),
x AS (SELECT *, concat_ws('+', CASE WHEN hours >= 12 THEN 'interval' END, CASE WHEN previous - accuracy > 0.03 THEN 'decline' END, CASE WHEN regime_changed AND hours >= 1 THEN 'regime' END) AS reasons FROM m)
SELECT model, reasons, round(hours / 12.0 + greatest(0, previous - accuracy) * 10, 6) AS priority FROM x WHERE reasons <> ''""")
def retrain_triggers(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    m = S.load(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg((n % 30).alias("hours"), (F.avg("value") / 500).alias("accuracy"), (F.max("value") / 500).alias("previous"), (n % 2 == 0).alias("regime_changed"))
    return out(FB.retrain_triggers(m), "model reasons", "priority")


@query(f"""{TRADES}, x AS (SELECT symbol, id AS t, greatest(1000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY id), 0) AS e FROM trades),
y AS (SELECT symbol, t, CASE WHEN e < 500 THEN 'micro' WHEN e < 2000 THEN 'small' WHEN e < 10000 THEN 'medium' WHEN e < 50000 THEN 'large' ELSE 'whale' END AS tier FROM x),
z AS (SELECT *, lag(tier) OVER ({W}) AS previous FROM y) SELECT symbol, t, tier, previous FROM z WHERE previous <> tier""")
def tier_changes(spark: SparkSession, d: str) -> DataFrame:
    t = S.trades(spark, d).drop("t").withColumnRenamed("id", "t")
    e = I.drawdown(t, "pnl", "symbol", "t").withColumn("equity", F.greatest(F.col("cumulative") + 1000, F.lit(0.0)))
    return out(FB.tier_changes(SG.tier_of(e, "equity")), "symbol t tier previous")


R100 = _rows(100)


@query(f"""{BARS}, x AS (SELECT symbol, t, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars)
SELECT symbol, t, round(CASE WHEN count(r) OVER {R100} < 20 THEN r ELSE avg(r) OVER {R100} / (stddev_pop(r) OVER {R100} + 1e-8) END, 6) AS sharpe_reward,
  round(CASE WHEN count(r) OVER {R100} < 20 THEN r ELSE avg(r) OVER {R100} / (coalesce(stddev_pop(r) FILTER (r < 0) OVER {R100}, 0) + 1e-8) END, 6) AS sortino_reward FROM x""")
def rewards(spark: SparkSession, d: str) -> DataFrame:
    r = I.returns(S.hourly_bars(spark, d), (1,))
    return out(FB.rewards(r, "returns_1"), "symbol t", "sharpe_reward sortino_reward")


@query("""WITH l AS (SELECT doc_id AS line_no, text FROM documents) SELECT count(*) FILTER (contains(text, 'Licensed')) AS n_0, count(*) FILTER (contains(text, 'http')) AS n_1, bool_or(contains(text, 'Licensed')) AS any_0, bool_or(contains(text, 'no such line')) AS any_2,
  arg_max(regexp_extract(text, '([0-9]{3,})', 1), line_no) FILTER (regexp_extract(text, '([0-9]{3,})', 1) <> '') AS last FROM l""")
def log_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = S.load(spark, d, "documents").select(F.col("doc_id").alias("line_no"), "text")
    return FB.log_counters(lines, ["Licensed", "http", "no such line"], "([0-9]{3,})").select("n_0", "n_1", "any_0", "any_2", "last")


@query("""WITH x AS (SELECT event_type AS symbol, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events) SELECT symbol, k % 5 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1, 2""")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    x = S.load(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), (k % 5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out(x, "symbol bucket n", "total", 4)


@query(f"""{SIGNALS}, v AS (SELECT id, unnest([{{'m': 'xgb', 's': signal}}, {{'m': 'lgb', 's': -signal / 2}}, {{'m': 'rf', 's': confidence - 0.5}}], recursive := true), confidence FROM signals),
x AS (SELECT id, sum(w * s) / sum(w) AS signal, sum(w * confidence) / sum(w) AS confidence, abs(avg(sign(s))) AS agreement FROM v JOIN (VALUES ('xgb', 0.5), ('lgb', 0.3), ('rf', 0.2)) t(n, w) ON n = m GROUP BY 1)
SELECT id, {_r('signal confidence agreement')}, CASE WHEN signal > 0.15 THEN 'long' WHEN signal < -0.15 THEN 'short' ELSE 'neutral' END AS direction FROM x""")
def ensemble_votes(spark: SparkSession, d: str) -> DataFrame:
    s = S.signals(spark, d)
    models = F.array(*[F.struct(F.lit(m).alias("model"), x.alias("signal")) for m, x in (("xgb", F.col("signal")), ("lgb", -F.col("signal") / 2), ("rf", F.col("confidence") - 0.5))])
    v = s.select("id", "confidence", F.explode(models).alias("v")).select("id", "confidence", "v.*")
    return out(SG.ensemble(v, {"xgb": 0.5, "lgb": 0.3, "rf": 0.2}), "id direction", "signal confidence agreement")


@query(f"""{BARS}, f AS (SELECT symbol, t, abs(close - open) AS x FROM bars), y AS (SELECT symbol, t, x, lag(x) OVER ({W}) AS p FROM f)
SELECT symbol, t, CASE WHEN p < 100 AND x >= 100 THEN 'up' ELSE 'down' END AS crossing FROM y WHERE (p < 100 AND x >= 100) OR (p >= 100 AND x < 100)""")
def threshold_crossings(spark: SparkSession, d: str) -> DataFrame:
    b = S.hourly_bars(spark, d).withColumn("x", F.abs(F.col("close") - F.col("open")))
    return out(SG.latest_crossings(b, "x", 100.0), "symbol t crossing")


@query(f"""{FLOW}, x AS (SELECT symbol, t, sum(buy) OVER {_rows(24)} AS buys, sum(sell) OVER {_rows(24)} AS sells FROM flow) SELECT symbol, t, {_r('buys sells', 4)}, round(buys / nullif(buys + sells, 0), 6) AS buy_share FROM x""")
def flow_share(spark: SparkSession, d: str) -> DataFrame:
    x = S.flow(spark, d).withColumns({"buys": F.sum("buy").over(last(24)), "sells": F.sum("sell").over(last(24))})
    return x.select("symbol", "t", F.round("buys", 4).alias("buys"), F.round("sells", 4).alias("sells"), F.round(F.col("buys") / F.nullif(F.col("buys") + F.col("sells"), F.lit(0.0)), 6).alias("buy_share"))


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    return FB.bootstrap_mean(S.trades(spark, d), "pnl", ["variant"], "id", 200)


@query(f"""{RECORDS}, r AS (SELECT source, signal, ret, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM records WHERE signal IS NOT NULL AND ret IS NOT NULL),
w AS (SELECT a.source, a.rn AS e, b.signal, b.ret FROM r a JOIN r b ON a.source = b.source AND b.rn BETWEEN a.rn - 49 AND a.rn WHERE a.rn >= 50),
k AS (SELECT source, e, {_rank('signal', 'source, e')} AS a, {_rank('ret', 'source, e')} AS b FROM w),
c AS (SELECT source, e, CASE WHEN var_pop(a) * var_pop(b) > 0 THEN corr(a, b) ELSE 0 END AS ic FROM k GROUP BY 1, 2),
i AS (SELECT source, avg(ic) AS m, stddev_pop(ic) AS s FROM c GROUP BY 1), n AS (SELECT source, count(*) FILTER (signal IS NOT NULL AND ret IS NOT NULL) AS n FROM records GROUP BY 1)
SELECT source, n, CASE WHEN n >= 100 THEN round(CASE WHEN s > 0 THEN m / s ELSE 0 END, 6) END AS ic_ratio FROM n LEFT JOIN i USING (source)""")
def rolling_ic_ratio(spark: SparkSession, d: str) -> DataFrame:
    return out(MC.rolling_ic_ratio(S.records(spark, d), "source"), "source n", "ic_ratio")


@query()
def hmm_regimes(spark: SparkSession, d: str) -> DataFrame:
    return MC.hmm_regimes(S.hourly_bars(spark, d))


@query()
def paper_trades(spark: SparkSession, d: str) -> DataFrame:
    a = _actions(spark, d).withColumns({"atr_pct": F.lit(0.01), "funding": F.lit(0.0001)})
    return MC.paper_trades(a)


@query(f"""{BARS.replace('WITH', 'WITH RECURSIVE', 1)}, z AS (SELECT symbol, t, row_number() OVER ({W}) AS rn, coalesce((close - {_full(30, 'close', 'avg(close)')}) / nullif({_full(30, 'close', 'stddev_samp(close)')}, 0), 0) AS zscore FROM bars),
p AS (SELECT symbol, t, rn, zscore, 0 AS position FROM z WHERE rn = 1
  UNION ALL SELECT z.symbol, z.t, z.rn, z.zscore, CASE WHEN position = 0 AND abs(z.zscore) >= 2 AND abs(z.zscore) < 4 THEN CAST(-sign(z.zscore) AS INTEGER) WHEN abs(z.zscore) <= 0.5 OR abs(z.zscore) >= 4 THEN 0 ELSE position END
  FROM p JOIN z ON z.symbol = p.symbol AND z.rn = p.rn + 1)
SELECT symbol, t, round(zscore, 6) AS zscore, position FROM p""")
def pair_positions(spark: SparkSession, d: str) -> DataFrame:
    return out(MC.pair_signals(I.rolling_zscore(S.hourly_bars(spark, d), "close", 30)), "symbol t position", "zscore")


@query()
def calibrated_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = S.signals(spark, d).withColumn("correct", ((F.col("signal") > 0) == (F.col("action") == "long")).cast("double"))
    grid = MD.fit_calibration(s, "confidence", "correct")
    return s.select("id", "confidence", MD.calibrate(F.col("confidence"), grid).alias("calibrated"))


@query()
def forest_signals(spark: SparkSession, d: str) -> DataFrame:
    """A three-class forest on bar features, trained on the first four fifths of each symbol's bars and applied to the rest."""
    b = LB.forward_returns(I.returns(I.bollinger(S.hourly_bars(spark, d))), (12, 48)).withColumns({"rn": F.row_number().over(Window.partitionBy("symbol").orderBy("t")), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    columns = MD.feature_columns(b, {"t", "rn", "n", "label", "fwd_12", "fwd_48"})
    split = F.col("rn") <= 0.8 * F.col("n")
    model = MD.train_classifier(LB.sample_weights(b.filter(split), "label"), columns, "label", "weight", trees=20)
    return MD.predict_signal(model, b.filter(~split), columns).select("symbol", "t", "signal", "confidence", "direction")


@query()
def purged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of a small forest on each purged fold."""
    from pyspark.ml.classification import RandomForestClassifier

    b = I.returns(S.hourly_bars(spark, d)).withColumn("label", (F.col("close") > F.col("open")).cast("int"))
    b = SP.number_rows(b, "t", "symbol")
    n = b.count()
    f = MD.assemble(b, ["returns_1", "returns_5", "returns_20"])
    got = MD.purged_score(f, SP.purged_folds(b, "rn", n, 3), "rn", lambda: RandomForestClassifier(labelCol="label", numTrees=5, maxDepth=3, seed=1), lambda p: p.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).head()[0], 3)
    return spark.createDataFrame(list(enumerate(got)), "fold int, accuracy double")
