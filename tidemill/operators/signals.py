"""Order-flow and market-state scores, and rule-based classification of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import change, clip, full, lagged, last, let, ordered, ratio


def vpin(flow: DataFrame, n: int = 50) -> DataFrame:
    """Mean imbalance of the last n buckets of (buy, sell), its risk level and size scale."""
    x = F.coalesce(ratio(F.abs(F.col("buy") - F.col("sell")), F.col("buy") + F.col("sell")), F.lit(0.0))
    d = flow.withColumn("_x", x).withColumn("vpin", F.avg("_x").over(last(n))).drop("_x")
    v = F.col("vpin")
    return d.withColumns({"level": F.when(v > 0.7, "high").when(v > 0.4, "elevated").otherwise("normal"), "scale": F.when(v > 0.7, 0.3).when(v > 0.4, 0.7).otherwise(1.0)})


def imbalance_score(flow: DataFrame) -> DataFrame:
    """Score of the imbalance of two sides: level, mean of ten and its change, stronger when one-sided; share of equal signs."""
    imb = F.coalesce(ratio(F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell")), F.lit(0.0))
    d = flow.withColumn("imbalance", imb)
    i = F.col("imbalance")
    ma, prev = F.avg(i).over(last(10)), F.avg(i).over(ordered().rowsBetween(-19, -10))
    d = d.withColumns({"_ma": ma, "_prev": F.coalesce(prev, F.lit(0.0)), "_same": F.count_if(F.signum(i) == 1).over(last(10)), "_neg": F.count_if(F.signum(i) == -1).over(last(10)), "_n": F.count(i).over(last(10))})
    s = clip(0.6 * i + 0.3 * F.col("_ma") + 0.5 * (F.col("_ma") - F.col("_prev")), -1, 1)
    same = F.when(i > 0, F.col("_same")).when(i < 0, F.col("_neg")).otherwise(F.col("_n") - F.col("_same") - F.col("_neg"))
    return d.withColumns({"score": F.when(F.abs(i) > 0.5, clip(1.5 * s, -1, 1)).otherwise(s), "confidence": F.when(F.col("_n") < 10, 0.3).otherwise(same / 10)}).drop("_ma", "_prev", "_same", "_neg", "_n")


def crash_risk(bars: DataFrame) -> DataFrame:
    """Momentum-crash risk from the ratio of short to long mean absolute returns and a reversal of the short trend."""
    d = bars.withColumn("_r", change("close", 1))
    a = F.abs(F.col("_r"))
    short, long_ = full(3, a, F.avg(a)), full(20, a, F.avg(a))
    m3, m20 = full(3, F.col("_r"), F.avg("_r")), full(20, F.col("_r"), F.avg("_r"))
    d = d.withColumns({"vol_ratio": ratio(short, long_), "reversal": (m3 * m20 < 0) & (F.abs(m3) > F.abs(m20))})
    v = F.col("vol_ratio")
    risk = F.when(v > 2, 0.4).when(v > 1.5, 0.2).otherwise(0.0) + F.when(F.col("reversal"), 0.3).otherwise(0.0) + 0.15 * F.greatest(F.lit(0.0), v - 1)
    scale = F.greatest(F.lit(0.3), F.least(F.lit(1.0), 1 / F.greatest(F.lit(1.0), v)))
    return d.withColumns({"risk": F.least(F.lit(1.0), risk), "scale": scale}).drop("_r")


def formula_alphas(bars: DataFrame) -> DataFrame:
    """VWAP deviation, volume flow, price-volume divergence and intrabar momentum over short windows."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.col("volume")
    vwap = ratio(full(20, tp * v, F.sum(tp * v)), full(20, v, F.sum(v)))
    span = F.col("high") - F.col("low")
    inside = F.coalesce(ratio(F.col("close") - F.col("open"), span), F.lit(0.0))
    d = bars.withColumns({"vwap_dev": ratio(F.col("close") - vwap, vwap), "_in": inside, "_flow": F.when(F.col("close") > lagged("close", 1), v).when(F.col("close") < lagged("close", 1), -v).otherwise(0.0)})
    flow = ratio(full(5, F.col("_flow"), F.sum("_flow")), full(5, v, F.sum(v)))
    divergence = F.signum(change("close", 5)) - F.signum(change("volume", 5))
    return d.withColumns({"flow_5": flow, "divergence": divergence, "intrabar": full(10, F.col("_in"), F.avg("_in"))}).drop("_in", "_flow")


def order_flow_z(bars: DataFrame, n: int = 20) -> DataFrame:
    """Signed volume against the running VWAP of the last n + 1 bars, as a z-score of the bar against the n before it.

    The bars of one window are a bounded array; the VWAP is anchored at its first bar, so it is summed inside it.
    """
    item = F.struct(((F.col("high") + F.col("low") + F.col("close")) / 3).alias("p"), F.col("volume").alias("v"), F.col("close").alias("c"))
    d = bars.withColumn("_w", F.collect_list(item).over(last(n + 1)))
    start = F.struct(F.lit(0.0).alias("pv"), F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        return let(
            F.struct((acc["pv"] + b["p"] * b["v"]).alias("pv"), (acc["v"] + b["v"]).alias("v")),
            lambda s: F.struct(s["pv"].alias("pv"), s["v"].alias("v"), F.concat(acc["out"], F.array(F.signum(b["c"] - s["pv"] / F.greatest(s["v"], F.lit(1e-10))) * b["v"])).alias("out")),
        )

    d = d.withColumn("_s", F.when(F.size("_w") == n + 1, F.aggregate("_w", start, step, lambda a: a["out"]))).drop("_w")
    past = F.slice("_s", 1, n)
    mean = F.aggregate(past, F.lit(0.0), lambda a, x: a + x) / n
    d = d.withColumns({"_m": mean, "_x": F.get("_s", F.lit(n))})
    sd = F.sqrt(F.aggregate(past, F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / (n - 1))
    return d.withColumn("ofi_z", ratio(F.col("_x") - F.col("_m"), sd)).drop("_s", "_m", "_x")


def liquidations(bars: DataFrame, n: int = 20, z: float = 2.5, body: float = 0.01) -> DataFrame:
    """Bars whose volume and body are both extreme, with the side that was hit and the price of the event."""
    v = F.col("volume")
    score = ratio(v - full(n, v, F.avg(v)), full(n, v, F.stddev_samp(v)))
    move = ratio(F.col("close") - F.col("open"), F.col("open"))
    d = bars.withColumns({"volume_z": score, "body": move}).filter((F.col("volume_z") >= z) & (F.abs("body") >= body))
    return d.select("symbol", "t", "volume_z", "body", F.when(F.col("body") < 0, "long").otherwise("short").alias("side"), F.when(F.col("body") < 0, F.col("low")).otherwise(F.col("high")).alias("price"))


def price_clusters(events: DataFrame, width: float = 0.003) -> DataFrame:
    """Events for each side and log-price bucket."""
    return events.groupBy("symbol", "side", F.floor(F.log("price") / F.log1p(F.lit(width))).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price"))


def trend_scan(tickers: DataFrame, previous: DataFrame, floor: float, top: int = 20) -> DataFrame:
    """Symbols above a volume floor by z(log10 volume) + z(|move|), with those absent from the previous snapshot marked."""
    live = tickers.filter(F.col("volume") >= floor)
    s = live.agg(*[f(x).alias(n) for n, f, x in (("mv", F.avg, F.log10("volume")), ("sv", F.stddev_pop, F.log10("volume")), ("mp", F.avg, F.abs("pct")), ("sp", F.stddev_pop, F.abs("pct")))])
    d = live.crossJoin(F.broadcast(s))  # one row
    z = lambda x, m, sd: F.coalesce(ratio(x - F.col(m), F.col(sd)), F.lit(0.0))
    d = d.withColumn("score", z(F.log10("volume"), "mv", "sv") + z(F.abs("pct"), "mp", "sp"))
    seen = previous.select(F.col("symbol").alias("p")).distinct()
    d = d.join(seen, F.col("symbol") == F.col("p"), "left")
    return d.orderBy(F.desc("score"), "symbol").limit(top).select("symbol", "volume", "pct", "score", F.col("p").isNull().alias("is_new"))


def new_listings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Symbols that the previous snapshot lacks; none if that snapshot is empty."""
    some = previous.limit(1).select(F.lit(1).alias("_some"))
    return current.select("symbol").distinct().join(previous.select("symbol"), "symbol", "left_anti").join(some, how="cross").select("symbol")


def keyword_alerts(texts: DataFrame, words: list[str], first: int = 3) -> DataFrame:
    """Rows that contain a keyword: ASCII ones as whole words, others anywhere; at most ``first`` hits, one row a title."""
    import re

    hit = lambda w: F.col("text").rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_]){re.escape(w)}($|[^\p{{L}}\p{{N}}_])") if w.isascii() else F.lower("text").contains(w.lower())
    d = texts.withColumn("hits", F.slice(F.array_compact(F.array(*[F.when(hit(w), F.lit(w)) for w in words])), 1, first)).filter(F.size("hits") > 0)
    d = d.withColumn("title", F.substring("text", 1, 80))
    return d.groupBy("title").agg(F.min(F.struct("id", "hits")).alias("m")).select(F.col("m.id").alias("id"), "title", F.array_join("m.hits", ",").alias("hits"))


TIERS = (("micro", 0.0, 500.0), ("small", 500.0, 2000.0), ("medium", 2000.0, 10000.0), ("large", 10000.0, 50000.0), ("whale", 50000.0, float("inf")))


def tier_of(rows: DataFrame, equity: str) -> DataFrame:
    """Tier, next tier and progress towards it; a fixed table of half-open ranges, as one expression."""
    x = F.col(equity)
    name, nxt, progress = F.lit(TIERS[-1][0]), F.lit(None).cast("string"), F.lit(100.0)
    for (tier, low, high), after in reversed(list(zip(TIERS[:-1], TIERS[1:], strict=True))):
        fits = (x >= low) & (x < high)
        name, nxt = F.when(fits, tier).otherwise(name), F.when(fits, after[0]).otherwise(nxt)
        progress = F.when(fits, 100 * (x - low) / (high - low)).otherwise(progress)
    return rows.withColumns({"tier": name, "next_tier": nxt, "progress": progress})


def carry_opportunities(funding: DataFrame, least: float = 0.0003, cost: float = 0.0006) -> DataFrame:
    """Funding rates worth collecting: side, net of costs, a year's rate at three payments a day."""
    f = F.abs("funding")
    d = funding.filter(f >= least).withColumn("net", f * 3 - cost).filter("net > 0")
    return d.select("symbol", "t", "funding", F.when(F.col("funding") > 0, "short").otherwise("long").alias("side"), "net", (f * 1095).alias("annual"))


def ensemble(votes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted signal and confidence of models for each row id, weights renormalised over the models that answered."""
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    d = votes.filter(F.col("signal").isNotNull() & ~F.isnan("signal")).withColumn("w", F.coalesce(m[F.col("model")], F.lit(0.0)))
    d = d.groupBy("id").agg((F.sum(F.col("w") * F.col("signal")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("signal"), (F.sum(F.col("w") * F.col("confidence")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("confidence"), F.avg(F.signum("signal")).alias("lean"))
    s = F.col("signal")
    return d.select("id", "signal", "confidence", F.when(s > 0.15, "long").when(s < -0.15, "short").otherwise("neutral").alias("direction"), F.abs("lean").alias("agreement"))


def decide(rows: DataFrame, minimum: float = 0.45) -> DataFrame:
    """A cascade of gates over signal rows (signal, confidence, regime, hour, rsi): the action, size and first reason to hold."""
    s, c = F.col("signal"), F.col("confidence")
    side = F.when(s > 0.15, "long").when(s < -0.15, "short").otherwise("hold")
    d = rows.withColumns({"side": side, "c1": c * F.when(F.abs(s) > 0.5, 1.2).otherwise(1.0)})
    d = d.withColumn("c2", F.when(F.col("regime") == "extreme_volatility", F.col("c1") * 0.7).otherwise(F.col("c1")))
    reason = (
        F.when(F.col("side") == "hold", "no_direction").when(F.col("hour").isin(1, 2, 8, 13, 16), "blocked_hour")
        .when((F.col("side") == "long") & (F.col("rsi") > 70), "overbought").when((F.col("side") == "short") & (F.col("rsi") < 30), "oversold").when(F.col("c2") < minimum, "low_confidence")
    )
    d = d.withColumn("reason", reason)
    return d.withColumns({"action": F.when(F.col("reason").isNull(), F.col("side")).otherwise("hold"), "size": F.when(F.col("reason").isNull(), F.least(F.col("c2"), F.lit(1.0))).otherwise(0.0)}).drop("c1", "c2", "side")


def block_reasons(decisions: DataFrame) -> DataFrame:
    """Histogram of the reasons to hold, with shares."""
    n = decisions.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def latest_crossings(rows: DataFrame, value: str, level: float) -> DataFrame:
    """Rows where a series crosses a level, upwards or downwards."""
    prev = lagged(value, 1)
    d = rows.withColumn("_p", prev)
    kind = F.when((F.col("_p") < level) & (F.col(value) >= level), "up").when((F.col("_p") >= level) & (F.col(value) < level), "down")
    return d.withColumn("crossing", kind).filter("crossing IS NOT NULL").drop("_p")
