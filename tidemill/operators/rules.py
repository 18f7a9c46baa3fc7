"""Decision rules as expressions over rows: fusion of a decision with other views, gates, pauses, sizes and exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import clip, lagged, last, ordered, ratio, so_far
from .stats import normal_cdf

#: Multipliers of position size by volatility class and by regime (fixed values).
VOLATILITY_SCALE = {"low": 1.3, "normal": 1.0, "high": 0.6, "extreme": 0.3}
REGIME_SCALE = {"trending_up": 1.2, "trending_down": 1.2, "mean_reverting": 0.8, "high_volatility": 0.5, "transition": 0.3, "unknown": 0.8}
#: Signal threshold, least confidence, position scale and stop multiple of each regime (fixed values).
REGIME_PARAMETERS = {
    "strong_uptrend": (0.1, 0.5, 0.5, 1.5), "strong_downtrend": (0.1, 0.5, 1.2, 1.5), "ranging": (0.3, 0.72, 0.3, 0.8),
    "extreme_volatility": (0.3, 0.75, 0.3, 2.0), "high_volume_breakout": (0.25, 0.7, 0.35, 1.2), "normal": (0.15, 0.55, 1.0, 1.0),
}


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def funding_bias(action: Column, funding_bp: Column, momentum: Column, rsi: Column) -> Column:
    """Why a side is blocked by the funding rate in basis points, alone or with a momentum against it; null if it is not."""
    return (
        F.when((action == "short") & (funding_bp < -1.0), "short_squeeze").when((action == "long") & (funding_bp > 3.0), "long_squeeze")
        .when((action == "short") & (funding_bp < -0.5) & ((momentum == "long") | (rsi < 30)), "short_against_rebound")
        .when((action == "long") & (funding_bp > 1.5) & ((momentum == "short") | (rsi > 70)), "long_against_fall")
    )


def fuse(decisions: DataFrame) -> DataFrame:
    """Pass decisions (action, confidence) through funding, pattern, time-frame and blended views, one stage after the other.

    Further columns: funding_bp, momentum, rsi; pattern (direction), similarity, pattern_win_rate, ev_pct; mtf (bullish, bearish),
    mtf_agreement; blend_score, blend_regime. Out: the new action and confidence, and ``reasons``, what each stage did. A
    vetoed row is ``hold`` with confidence 0 and passes the later stages unchanged. Null views change nothing.
    """
    d = decisions.withColumn("_r", F.array(funding_bias(F.col("action"), F.col("funding_bp"), F.col("momentum"), F.col("rsi"))))
    live = F.col("action").isin("long", "short")
    long_ = F.col("action") == "long"

    def stage(d: DataFrame, reason: Column, factor: dict[str, float], vetoes: tuple[str, ...]) -> DataFrame:
        d = d.withColumn("_why", F.when(live, reason))
        scale = F.lit(1.0)
        for name, f in factor.items():
            scale = F.when(F.col("_why") == name, f).otherwise(scale)
        veto = F.coalesce(F.col("_why").isin(*vetoes), F.lit(False)) if vetoes else F.lit(False)
        raised = F.least(F.col("confidence") * scale, F.greatest(F.lit(1.0), F.col("confidence")))
        return d.select(*[c for c in d.columns if c not in ("action", "confidence", "_r", "_why")], F.when(veto, "hold").otherwise(F.col("action")).alias("action"), F.when(veto, 0.0).otherwise(raised).alias("confidence"), F.concat("_r", F.array("_why")).alias("_r"))

    blocked = F.col("_r")[0].isNotNull()
    d = d.select(*[c for c in d.columns if c not in ("action", "confidence")], F.when(blocked, 0.0).otherwise(F.col("confidence")).alias("confidence"), F.when(blocked, "hold").otherwise(F.col("action")).alias("action"))
    conflict = (long_ & (F.col("pattern") == "short")) | (~long_ & (F.col("pattern") == "long"))
    adverse = (long_ & (F.col("ev_pct") < -0.05)) | (~long_ & (F.col("ev_pct") > 0.05))
    s = F.col("similarity")
    pattern = (
        F.when(conflict & (s >= 0.87), "pattern_conflict").when(adverse & (s >= 0.90), "pattern_adverse").when((conflict | adverse) & (s >= 0.80), "pattern_weak")
        .when((F.col("pattern") == F.col("action")) & (F.col("pattern_win_rate") >= 0.56) & (s >= 0.88), "pattern_confirms")
    )
    d = stage(d, pattern, {"pattern_weak": 0.6, "pattern_confirms": 1.25}, ("pattern_conflict", "pattern_adverse"))
    agrees = (long_ & (F.col("mtf") == "bullish")) | (~long_ & (F.col("mtf") == "bearish"))
    opposes = (long_ & (F.col("mtf") == "bearish")) | (~long_ & (F.col("mtf") == "bullish"))
    a = F.col("mtf_agreement")
    d = stage(d, F.when(opposes & (a >= 0.75), "mtf_veto").when(opposes & (a >= 0.5), "mtf_opposes").when(agrees & (a > 0.7), "mtf_agrees"), {"mtf_opposes": 0.6, "mtf_agrees": 1.15}, ("mtf_veto",))
    d = stage(d, F.when(F.col("blend_regime") == "ranging", "blend_ranging"), {"blend_ranging": 0.6}, ())
    q = F.col("blend_score")
    side = (long_ & (q > 0)) | (~long_ & (q < 0))
    d = stage(d, F.when((q != 0) & (F.abs(q) > 0.3), F.when(side, "blend_agrees").otherwise("blend_opposes")), {"blend_opposes": 0.7, "blend_agrees": 1.15}, ())
    return d.withColumn("reasons", F.array_join(F.array_compact("_r"), "|")).drop("_r")


def best_candidate(rows: DataFrame, by: str) -> DataFrame:
    """Of the candidates of each ``by`` the one with the largest confidence * (1 - priority / 10); ties by the smallest id."""
    score = F.col("confidence") * (1 - F.col("priority") / 10)
    return rows.withColumn("score", score).groupBy(by).agg(F.max_by(F.struct("id", "symbol", "score"), F.struct("score", (-F.col("id")).alias("i"))).alias("m")).select(by, "m.*")


def basis_spread(rows: DataFrame) -> DataFrame:
    """Basis of futures over spot in percent, its mean of 20, score and confidence; null without a spot price.

    Beyond 0.3 percent the basis is expected to revert, below it counts as momentum with twice the change of the mean.
    """
    b = ratio(F.col("futures") - F.col("spot"), F.col("spot")) * 100
    d = rows.withColumn("basis_pct", b).filter("basis_pct IS NOT NULL")
    w, n = last(20), F.count(F.lit(1)).over(last(20))
    x = F.col("basis_pct")
    d = d.withColumns({"basis_ma": F.when(n >= 20, F.avg(x).over(w)).otherwise(x), "_n": n, "_prev": F.coalesce(F.avg(x).over(ordered().rowsBetween(-19, -10)), F.lit(0.0)), "_sd": F.stddev_pop(x).over(last(10))})
    roc = F.when(F.col("_n") >= 10, F.col("basis_ma") - F.col("_prev")).otherwise(0.0)
    far = F.abs(x) > 0.3
    score = clip(F.when(far, -F.signum(x) * F.least(F.abs(x) / 0.6, F.lit(1.0))).otherwise(x / 0.3 + 2 * roc), -1, 1)
    return d.withColumns({"score": score, "confidence": F.when(F.col("_n") >= 10, clip(F.greatest(F.lit(0.2), 1 - 5 * F.col("_sd")), 0, 1)).otherwise(0.3), "kind": F.when(far, "reversal").otherwise("momentum")}).drop("_n", "_prev", "_sd")


def blend_regime(rows: DataFrame) -> DataFrame:
    """Five regimes of rows (adx, bb_width, vol_ratio) with confidence and position scale."""
    a, b, v = F.col("adx"), F.col("bb_width"), F.col("vol_ratio")
    r = F.when((a > 25) & (b < 0.06), "strong_trend").when((a > 25) & (v > 1.5), "volatile_breakout").when((a < 20) & (b < 0.03), "quiet").when(a < 20, "ranging").otherwise("weak_trend")
    d = rows.withColumn("blend_regime", r)
    k = F.col("blend_regime")
    conf = F.when(k == "strong_trend", F.least(F.lit(1.0), a / 50)).when(k == "volatile_breakout", F.least(F.lit(1.0), v / 3)).when(k == "quiet", 0.6).when(k == "ranging", F.greatest(F.lit(0.4), 1 - a / 20)).otherwise(0.5)
    return d.withColumns({"regime_confidence": conf, "position_scale": _lookup({"strong_trend": 1.2, "volatile_breakout": 0.8, "quiet": 1.0, "ranging": 0.5}, k, 0.7)})


def combined_score(book: Column, bias: Column, regime_confidence: Column, alpha: Column, basis: Column, *risk: Column) -> Column:
    """Weighted score of four views, scaled by the smallest of the risk scales and clipped to [-1, 1]."""
    return clip((0.25 * book + 0.20 * bias * regime_confidence + 0.20 * alpha + 0.15 * basis) * F.least(*risk), -1, 1)


def flow_toxicity(bars: DataFrame, n: int = 20, high: float = 0.7) -> DataFrame:
    """Toxicity of the last n closes: share of equal neighbouring directions and lean of the directions, zero moves left out.

    Null until n bars are there; 0 with fewer than five moves.
    """
    d = bars.withColumn("_c", F.collect_list("close").over(last(n)))
    moves = F.filter(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.signum(F.get("_c", i) - F.get("_c", i - 1))), lambda s: s != 0)
    d = d.filter(F.size("_c") == n).withColumn("_s", moves).withColumn("_n", F.size("_s"))
    same = F.size(F.filter(F.zip_with(F.slice("_s", 2, n), F.col("_s"), lambda a, b: a == b), lambda e: e))
    lean = ratio(F.aggregate("_s", F.lit(0.0), lambda a, x: a + x), F.col("_n"))
    d = d.withColumns({"same_direction": F.when(F.col("_n") < 5, 0.0).otherwise(same / F.greatest(F.col("_n") - 1, F.lit(1))), "_lean": F.when(F.col("_n") >= 5, lean).otherwise(0.0)})
    d = d.withColumns({"direction_bias": F.abs("_lean"), "dominant": F.when(F.col("_lean") > 0.1, "buy").when(F.col("_lean") < -0.1, "sell").otherwise("neutral")})
    d = d.withColumn("toxicity", 0.6 * F.col("same_direction") + 0.4 * F.col("direction_bias"))
    return d.withColumn("level", F.when(F.col("toxicity") >= high, "high").when(F.col("toxicity") >= 0.4, "normal").otherwise("low")).drop("_c", "_s", "_n", "_lean")


def cluster_targets(clusters: DataFrame, prices: DataFrame) -> DataFrame:
    """For each symbol and side the nearest opposite cluster ahead of the last price, its share and the amplification it earns.

    ``clusters``: symbol, side (that was hit), price, n. ``prices``: symbol, last_price. A long looks at shorts above, a short at longs
    below. The share is of all opposite clusters. Symbols without such a cluster have no row.
    """
    d = clusters.join(prices, "symbol").withColumn("for_side", F.when(F.col("side") == "short", "long").otherwise("short"))
    ahead = F.when(F.col("for_side") == "long", F.col("price") > F.col("last_price")).otherwise(F.col("price") < F.col("last_price"))
    dist = F.abs(F.col("price") - F.col("last_price"))
    d = d.groupBy("symbol", "for_side").agg(F.sum("n").alias("_all"), F.min(F.when(ahead, F.struct(dist.alias("dist"), "price", "n", "last_price"))).alias("m")).filter("m IS NOT NULL")
    d = d.select("symbol", F.col("for_side").alias("side"), F.col("m.price").alias("cluster_price"), ratio(F.col("m.dist"), F.col("m.last_price")).alias("distance"), (F.col("m.n") / F.col("_all")).alias("share"))
    near = (F.col("distance") < 0.05) & (F.col("share") > 0.15)
    return d.withColumn("amplify", F.when(near, F.least(1 + (0.05 - F.col("distance")) * 6, F.lit(1.3))).otherwise(1.0))


def regime_parameters(rows: DataFrame) -> DataFrame:
    """Parameters of each row's regime (unknown ones: those of normal) and whether the regime differs from the row before."""
    pick = lambda i: _lookup({k: v[i] for k, v in REGIME_PARAMETERS.items()}, F.col("regime"), REGIME_PARAMETERS["normal"][i])
    return rows.withColumns({"signal_threshold": pick(0), "min_confidence": pick(1), "position_scale": pick(2), "stop_multiple": pick(3), "changed": F.coalesce(lagged("regime", 1) != F.col("regime"), F.lit(False))})


def change_point_size(rows: DataFrame, change: float = 0.3, block: float = 0.6, n: int = 20, long_n: int = 200) -> DataFrame:
    """Volatility class of rows (returns_1, change_prob, regime) and the size multiplier; 0 where a change point blocks entries."""
    x = F.col("returns_1")
    short, long_ = F.stddev_pop(x).over(last(n)), F.stddev_pop(x).over(last(long_n))
    long_ = F.when(F.count(x).over(last(long_n)) >= 50, long_).otherwise(short)
    d = rows.withColumn("vol_ratio", F.when(F.count(x).over(last(n)) >= n, short / (long_ + 1e-10)).otherwise(1.0))
    v, p = F.col("vol_ratio"), F.col("change_prob")
    d = d.withColumn("vol_class", F.when(v < 0.5, "low").when(v < 1.5, "normal").when(v < 2.5, "high").otherwise("extreme"))
    m = F.least(_lookup(VOLATILITY_SCALE, F.col("vol_class"), 1.0) * _lookup(REGIME_SCALE, F.col("regime"), 1.0), F.lit(1.5))
    return d.withColumns({"blocked": p >= block, "multiplier": F.when(p > block, 0.0).when(p > change, 0.3).otherwise(m)})


def risk_gates(trades: DataFrame, capital: float, drawdown: float = 0.15, daily: float = 0.05, streak: int = 3) -> DataFrame:
    """For each trade of a symbol (t in hours, id, pnl) whether the next may be opened, by the state it leaves, and the first reason not to.

    State: equity and its peak, the sum of the UTC day, and the trades since the last one that did not lose. All are running sums of
    one ordered window; a losing streak cools down, a fall from the peak or a day's loss beyond its limit halts.
    """
    w = so_far("symbol", "id")
    d = trades.withColumns({"day": F.floor(F.col("t") / 24), "equity": capital + F.sum("pnl").over(w), "_k": F.count_if(F.col("pnl") >= 0).over(w)})
    d = d.withColumns({"peak": F.greatest(F.max("equity").over(w), F.lit(float(capital))), "day_pnl": F.sum("pnl").over(Window.partitionBy("symbol", "day").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)), "losses": F.count_if(F.col("pnl") < 0).over(Window.partitionBy("symbol", "_k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))})
    d = d.withColumn("fall", F.coalesce(ratio(F.col("peak") - F.col("equity"), F.col("peak")), F.lit(0.0)))
    why = F.when(F.col("losses") >= streak, "cooldown").when(F.col("fall") > drawdown, "drawdown").when(-F.col("day_pnl") / capital > daily, "daily_loss")
    return d.withColumn("halt", why).drop("_k")


def leverage_cap(leverage: Column, stop: Column, risk: float = 0.05) -> Column:
    """Leverage at which a stop costs at most ``risk``, at least 1; unchanged without a stop."""
    return F.when(stop > 0, F.least(leverage, F.greatest(F.lit(1), F.floor(F.try_divide(F.lit(risk), stop)).cast("int")))).otherwise(leverage)


def funding_exit(funding: Column, profit: Column) -> Column:
    """Exit at an extreme funding rate: with a profit of one percent at -0.5 percent, with any profit at -1 percent."""
    return F.when((funding <= -0.005) & (profit >= 0.01), "take_profit").when((funding <= -0.01) & (profit > 0), "emergency")


def pattern_signal(mean: Column) -> tuple[Column, Column]:
    """Direction and signal of the mean forward return of like patterns."""
    return F.when(mean > 0.001, "long").when(mean < -0.001, "short").otherwise("neutral"), clip(mean / 0.01, -1, 1)


def pause_rules(trades: DataFrame, keep: int = 10) -> DataFrame:
    """For each mode what its ten latest trades say: pause after five losses in a row, or when at most a tenth of eight or more won.

    With fewer than five trades nothing pauses. A trade that does not win counts as lost.
    """
    w = Window.partitionBy("mode").orderBy(F.desc("t"), F.desc("id"))
    won = F.col("pnl") > 0
    d = trades.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    d = d.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(won & (F.col("_r") <= 5)).alias("wins_5"), F.count_if(won).alias("wins"))
    return d.withColumn("pause", F.when(F.col("n") < 5, F.lit(None)).when(F.col("wins_5") == 0, "five_losses").when((F.col("n") >= 8) & (F.col("wins") <= 0.1 * F.col("n")), "few_wins"))


def resume_reason(trades: Column, wins_5: Column, paper_wins_5: Column, minutes: Column) -> Column:
    """Why a paused mode starts again: too few recent trades to judge, enough wins after half an hour, or six hours gone."""
    ready = minutes >= 30
    return F.when(trades < 5, "stale").when(ready & (wins_5 >= 2), "wins").when(ready & (paper_wins_5 >= 3), "paper_wins").when(minutes >= 360, "time")


def daily_pause(trades: DataFrame, capital: float, limit: float = 0.03) -> DataFrame:
    """Result of each mode and UTC day, and whether its loss exceeds the limit; the next day starts free."""
    d = trades.groupBy("mode", F.floor(F.col("t") / 24).alias("day")).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"))
    return d.withColumn("paused", -F.col("pnl") / capital > limit)


def recent_value(trades: DataFrame, keep: int = 20, hours: int = 168, least: int = 10) -> DataFrame:
    """Mean result and wins of the latest trades within ``hours`` of the newest, for each mode; a negative mean of enough trades pauses."""
    w = Window.partitionBy("mode").orderBy(F.desc("t"), F.desc("id"))
    d = trades.withColumns({"_r": F.row_number().over(w), "_new": F.max("t").over(Window.partitionBy("mode"))}).filter((F.col("_r") <= keep) & (F.col("t") > F.col("_new") - hours))
    d = d.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("mean"), F.count_if(F.col("pnl") > 0).alias("wins"))
    return d.withColumn("state", F.when(F.col("n") < least, "unknown").when(F.col("mean") < 0, "pause").otherwise("run"))


def ab_verdict(two: DataFrame, n_min: int = 100, d_min: float = 0.3, alpha: float = 0.05) -> DataFrame:
    """The decision over a row of ``stats.compare_two``: winner, significance and whether the test may stop."""
    p = 2 * normal_cdf(-F.abs(F.col("t")))
    d = two.withColumn("p", p)
    enough, big = (F.col("n_a") >= n_min) & (F.col("n_b") >= n_min), F.abs("d") >= d_min
    sure = F.col("p") < alpha
    return d.withColumns({
        "significance": F.when(~enough, "insufficient_data").when(sure & big, "significant").when(sure, "small_effect").otherwise("not_significant"),
        "winner": F.when(enough & sure & big, F.when(F.col("d") > 0, "a").otherwise("b")), "stop": enough & sure & big,
    })


def tail_penalty(rows: DataFrame, by: list[str], value: str, order: str, alpha: float = 0.05) -> DataFrame:
    """Mean of the worst share ``alpha`` of values of each group, by rank, and the penalty weight it adds; needs 20 values."""
    w, n = Window.partitionBy(*by).orderBy(value, order), F.count(F.lit(1)).over(Window.partitionBy(*by))
    d = rows.withColumns({"_r": F.row_number().over(w), "_n": n}).filter((F.col("_n") >= 20) & (F.col("_r") <= F.col("_n") - F.floor(F.col("_n") * (1 - alpha))))
    return d.groupBy(*by).agg(F.first("_n").alias("n"), F.avg(-F.col(value)).alias("cvar"))


def shaped_reward(reward: Column, penalty: Column) -> Column:
    """A loss weighs more by the penalty; a gain is unchanged."""
    return F.when(reward < 0, reward - penalty * F.abs(reward)).otherwise(reward)
