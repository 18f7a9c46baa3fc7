"""Queries of features over long series in time chunks, with recursive statements as their SQL. They join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import new_folder
from ..operators import chunks as C
from ..operators import unit_roots as U
from ..sources import pages as P
from ..sources import tables as S
from .market import BARS, W, _r, out, query

#: Hours of a chunk.
WIDTH = 48


def _mean(name: str, x: str, alpha: float, start: int = 1) -> str:
    """One step of an exponential mean that starts at row ``start``."""
    return f"CASE WHEN i = {start} THEN {x} WHEN i > {start} THEN {1 - alpha!r}::DOUBLE * p_{name} + {alpha!r}::DOUBLE * {x} END AS {name}"


_SPANS = {f"e{n}": 2 / (n + 1) for n in (9, 12, 21, 26, 50, 200)}
_FIRST = [_mean(k, "close", a) for k, a in _SPANS.items()]
_FIRST += [_mean(f"{k}{n}", k, 1 / n, 2) for n in (7, 14, 21) for k in ("gain", "loss")]
_FIRST += [_mean(k, x, 1 / 14) for k, x in (("plus", "up"), ("minus", "down"), ("span", "tr"))] + [_mean(f"own_{k}", x, 1 / 14, 2) for k, x in (("plus", "up"), ("minus", "down"), ("span", "tr"))]
_FIRST += [f"{x} + {1 - 2 / (n + 1)!r}::DOUBLE * CASE WHEN i = 1 THEN 0 ELSE p_{k}{n} END AS {k}{n}" for n in (8, 21, 50) for k, x in (("num", "close"), ("den", "1"))]
_FIRST += ["CASE WHEN i = 14 THEN tr_sum / 14 WHEN i > 14 THEN p_atr * 13 / 14 + tr / 14 END AS atr", "CASE WHEN i = 11 THEN close WHEN i > 11 THEN p_kama + pace * (close - p_kama) END AS kama"]
_FIRST += [f"{x} + {1 - 2 / 21!r}::DOUBLE * CASE WHEN i = 1 THEN 0 ELSE p_{k} END AS {k}" for k, x in (("obv_num", "obv"), ("obv_den", "1"))]
_NAMES = [x.rsplit(" AS ", 1)[1] for x in _FIRST]
_SECOND = [_mean("sig", "(e12 - e26)", 0.2, 26), _mean("adx", "dx", 1 / 14), _mean("own_adx", "own_dx", 1 / 14, 2)]
_ALL = [*_NAMES, "sig", "adx", "own_adx"]

RECURRENCES = f"""WITH RECURSIVE {BARS.removeprefix("WITH ")}, l AS (SELECT *, row_number() OVER ({W}) AS i, lag(close) OVER ({W}) AS p, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl FROM bars),
k AS (SELECT *, abs(close - p) AS move, coalesce(high - ph, 0) AS u, coalesce(pl - low, 0) AS d, coalesce(greatest(high - low, abs(high - p), abs(low - p)), high - low) AS tr, greatest(close - p, 0) AS gain, greatest(p - close, 0) AS loss FROM l),
f AS (SELECT *, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS up, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS down, sum(tr) OVER ({W}) AS tr_sum, sum(CASE WHEN close < p THEN -volume ELSE volume END) OVER ({W}) AS obv,
 power(abs(close - lag(close, 10) OVER ({W})) / (sum(move) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + 1e-10) * {2 / 3 - 2 / 31!r}::DOUBLE + {2 / 31!r}::DOUBLE, 2) AS pace,
 close / nullif(lag(close, 4) OVER ({W}), 0) - 1 AS r4, close / nullif(lag(close, 9) OVER ({W}), 0) - 1 AS r9, close / nullif(lag(close, 19) OVER ({W}), 0) - 1 AS r19, avg(volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mv FROM k),
m AS (SELECT symbol, 0::BIGINT AS i, 0::BIGINT AS t, 0::DOUBLE AS close, 0::DOUBLE AS obv, 0::DOUBLE AS momentum_base, 0::DOUBLE AS spike, {", ".join(f"0::DOUBLE AS {n}" for n in _ALL)} FROM bars GROUP BY symbol
 UNION ALL SELECT symbol, i, t, close, obv, momentum_base, spike, {", ".join(_NAMES)}, {", ".join(_SECOND)} FROM (
  SELECT *, coalesce(100 * abs(plus - minus) / nullif(plus + minus, 0), 0) AS dx, 100 * abs(op - om) / (op + om + 1e-10) AS own_dx FROM (
   SELECT *, 100 * own_plus / (own_span + 1e-10) AS op, 100 * own_minus / (own_span + 1e-10) AS om FROM (
    SELECT symbol, i, t, close, obv, 1.5 * r4 + 0.6 * r9 + 0.4 * r19 AS momentum_base, volume / (mv + 1e-10) AS spike, {", ".join(_FIRST)}, p_sig, p_adx, p_own_adx
    FROM (SELECT f.*, {", ".join(f"m.{n} AS p_{n}" for n in _ALL)} FROM m JOIN f ON f.symbol = m.symbol AND f.i = m.i + 1))))),
z AS (SELECT *, {", ".join(f"CASE WHEN i >= {n} THEN e{n} END AS ema_{n}" for n in (9, 21, 50, 200))}, {", ".join(f"CASE WHEN i > {n} THEN CASE WHEN loss{n} = 0 THEN 100 ELSE 100 - 100 / (1 + gain{n} / loss{n}) END END AS rsi_{n}" for n in (7, 14, 21))},
 CASE WHEN i >= 26 THEN e12 - e26 END AS macd, CASE WHEN i >= 34 THEN sig END AS macd_signal, coalesce(atr, 0) AS atr_14, 100 * plus / nullif(span, 0) AS di_plus, 100 * minus / nullif(span, 0) AS di_minus, obv_num / obv_den AS obv_ema, lag(kama, 5) OVER ({W}) AS kama_5,
 CASE WHEN i >= 30 THEN (3 * (num8 / den8 - num21 / den21) / nullif(num21 / den21, 0) + momentum_base) * CASE WHEN spike > 1.5 THEN 1 + least((spike - 1.5) * 0.3, 0.5) ELSE 1 END ELSE 0 END AS momentum FROM m WHERE i > 0)"""

EMAS, OSCILLATORS = "ema_9 ema_21 ema_50 ema_200 ema_cross_short ema_cross_long", "rsi_7 rsi_14 rsi_21 macd macd_signal macd_hist"
RANGES, FLOWS = "atr_14 atr_pct di_plus di_minus adx own_adx", "obv obv_ema kama kama_slope kama_cross momentum"


def features(spark: SparkSession, d: str) -> DataFrame:
    """The chunked features of the hourly bars."""
    return C.chunked_features(S.hourly_bars(spark, d), WIDTH)


@query(f"""{RECURRENCES}, x AS (SELECT *, (ema_9 - ema_21) / nullif(close, 0) AS ema_cross_short, (ema_50 - ema_200) / nullif(close, 0) AS ema_cross_long FROM z) SELECT symbol, t, {_r(EMAS)} FROM x""")
def chunked_means(spark: SparkSession, d: str) -> DataFrame:
    """Exponential means of the close and their crosses."""
    return out(features(spark, d), "symbol t", EMAS)


@query(f"""{RECURRENCES}, x AS (SELECT *, macd - macd_signal AS macd_hist FROM z) SELECT symbol, t, {_r(OSCILLATORS)} FROM x""")
def chunked_oscillators(spark: SparkSession, d: str) -> DataFrame:
    """RSI and MACD."""
    return out(features(spark, d), "symbol t", OSCILLATORS)


@query(f"""{RECURRENCES}, x AS (SELECT *, atr_14 / nullif(close, 0) AS atr_pct FROM z) SELECT symbol, t, {_r(RANGES)} FROM x""")
def chunked_ranges(spark: SparkSession, d: str) -> DataFrame:
    """True range and directional indices."""
    return out(features(spark, d), "symbol t", RANGES)


@query(f"""{RECURRENCES}, x AS (SELECT *, (kama - kama_5) / (close + 1e-10) AS kama_slope, (close - kama) / (close + 1e-10) AS kama_cross, CASE WHEN momentum > 0.1 THEN 'long' WHEN momentum < -0.1 THEN 'short' ELSE 'neutral' END AS momentum_direction FROM z)
SELECT symbol, t, momentum_direction, coalesce((momentum_direction = 'long' AND close > num50 / den50) OR (momentum_direction = 'short' AND close < num50 / den50), false) AS trend_aligned, {_r(FLOWS)} FROM x""")
def chunked_flows(spark: SparkSession, d: str) -> DataFrame:
    """Balance of volume, the adaptive mean and the momentum score."""
    return out(features(spark, d), "symbol t momentum_direction trend_aligned", FLOWS)


@query(f"""{BARS}, c AS (SELECT min(t) + 300 AS cut FROM bars) SELECT symbol, t, open, high, low, close, volume, CASE WHEN t < cut THEN 1 ELSE 2 END AS refresh FROM bars, c""")
def paged_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Bars cached from pages in two refreshes: pages hold the first 300 hours, then all; the second refresh takes what is later."""
    bars = S.hourly_bars(spark, d)
    pages, cache = new_folder(spark, "pages"), new_folder(spark, "cache")
    first = bars.join(F.broadcast(bars.agg((F.min("t") + 300).alias("cut"))), F.col("t") < F.col("cut")).drop("cut")  # one row
    P.write_pages(first, pages)
    P.refresh(spark, pages, cache)
    P.write_pages(bars, pages)
    P.refresh(spark, pages, cache)
    return P.cached(spark, cache)


_SWEEP = "list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - m[i][s + 1] * m[s + 1][j] / m[s + 1][s + 1]))"

PAIRS = f"""WITH RECURSIVE {BARS.removeprefix("WITH ")}, p AS (SELECT x.symbol AS a, y.symbol AS b, x.t, x.close AS x, y.close AS y FROM bars x JOIN bars y ON x.t = y.t AND x.symbol < y.symbol),
f AS (SELECT a, b, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(y) AS beta FROM p GROUP BY 1, 2 HAVING count(*) >= 40),
e AS (SELECT p.a, p.b, t, n, CAST(least(ceil(12 * power(n / 100, 0.25)), n // 2 - 1) AS INTEGER) AS most, (x - mx) - beta * (y - my) AS e FROM p JOIN f ON p.a = f.a AND p.b = f.b),
l AS (SELECT *, lag(e) OVER w AS q, e - lag(e) OVER w AS y, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY a, b ORDER BY t)),
v AS (SELECT *, list_reverse(list(y) FILTER (y IS NOT NULL) OVER (PARTITION BY a, b ORDER BY t ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)) AS past FROM l),
v1 AS (SELECT a, b, most, [q] || past[1:most] || [y] AS v FROM v WHERE i >= most + 2), g1 AS (SELECT a, b, most, i, j, sum(v[i] * v[j]) AS x, count(*) AS n FROM v1, unnest(range(1, most + 3)) t(i), unnest(range(1, most + 3)) u(j) GROUP BY 1, 2, 3, 4, 5),
r1 AS (SELECT a, b, most, n, i, list(x ORDER BY j) AS r FROM g1 GROUP BY 1, 2, 3, 4, 5), m1(a, b, most, n, s, m) AS (SELECT a, b, most, n, 0, list(r ORDER BY i) FROM r1 GROUP BY 1, 2, 3, 4 UNION ALL SELECT a, b, most, n, s + 1, {_SWEEP} FROM m1 WHERE s <= most),
best AS (SELECT a, b, arg_min(s - 1, row(n * ln(m[most + 2][most + 2] / n) + 2 * s, s)) AS k FROM m1 WHERE s > 0 GROUP BY 1, 2),
v2 AS (SELECT v.a, v.b, k, coalesce(past[1:k], []) || [q, y] AS v FROM v JOIN best ON v.a = best.a AND v.b = best.b WHERE i >= k + 2), g2 AS (SELECT a, b, k, i, j, sum(v[i] * v[j]) AS x, count(*) AS n FROM v2, unnest(range(1, k + 3)) t(i), unnest(range(1, k + 3)) u(j) GROUP BY 1, 2, 3, 4, 5),
r2 AS (SELECT a, b, k, n, i, list(x ORDER BY j) AS r FROM g2 GROUP BY 1, 2, 3, 4, 5), m2(a, b, k, n, s, m) AS (SELECT a, b, k, n, 0, list(r ORDER BY i) FROM r2 GROUP BY 1, 2, 3, 4 UNION ALL SELECT a, b, k, n, s + 1, {_SWEEP} FROM m2 WHERE s < k),
z AS (SELECT a, b, k, n, m[k + 1][k + 2] / m[k + 1][k + 1] / sqrt(greatest(m[k + 2][k + 2] - m[k + 1][k + 2] ** 2 / m[k + 1][k + 1], 0) / (n - k - 1) / m[k + 1][k + 1]) AS tau FROM m2 WHERE s = k),
h AS (SELECT a, b, regr_slope(y, q) AS lam, stddev_pop(e) AS spread_std FROM l GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN tau <= -2.62 THEN 2.92 + 1.5012 * tau + 0.039796 * tau ** 2 ELSE 2.1945 + 0.64695 * tau - 0.29198 * tau ** 2 - 0.042377 * tau ** 3 END AS x FROM z),
w AS (SELECT f.a, f.b, f.n, beta AS hedge_ratio, spread_std, k AS lags, tau AS statistic, tau, x, CASE WHEN lam < 0 AND lam > -1 THEN -ln(2) / ln(1 + lam) END AS half_life FROM f JOIN c ON f.a = c.a AND f.b = c.b JOIN h ON f.a = h.a AND f.b = h.b)"""


@query(f"{PAIRS} SELECT a, b, n, lags, {_r('hedge_ratio spread_std statistic half_life')}, tau < -3.3377 AS below FROM w")
def augmented_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two-step tests of all pairs of symbols, lags by Akaike's criterion; ``below``: the statistic lies below the critical value of 5 %."""
    tested = U.cointegrated_pairs(S.hourly_bars(spark, d), "symbol", "t", "close", WIDTH, least=40)
    return out(tested.withColumn("below", F.col("statistic") < -3.3377), "a b n lags below", "hedge_ratio spread_std statistic half_life")


@query(f"{PAIRS} SELECT a, b, round(hedge_ratio, 4) AS hedge_ratio, round(half_life, 2) AS half_life, round(spread_std, 6) AS spread_std FROM w WHERE tau < -3.4 AND half_life IS NOT NULL ORDER BY tau, a, b LIMIT 4")
def pair_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The four pairs of the lowest statistic, of those below the critical value (a report of few rows)."""
    tested = U.cointegrated_pairs(S.hourly_bars(spark, d), "symbol", "t", "close", WIDTH, least=40)
    return U.best_pairs(tested.withColumns({"cointegrated": F.col("statistic") < -3.4, "p": F.col("statistic")}), 4).select("a", "b", F.round("hedge_ratio", 4).alias("hedge_ratio"), F.round("half_life", 2).alias("half_life"), F.round("spread_std", 6).alias("spread_std"))
