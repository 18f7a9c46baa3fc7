"""Queries of state machines over polls and events, each with a recursive statement as its SQL. They join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pauses as PA
from ..sources import tables as S
from .market import BARS, SIGNALS, TRADES, W, out, query

SECONDS = "epoch_us(ts) // 1000000"
POLL_RULES = PA.PauseRules(every=1_800, soft_wins=3)


def _trades(spark: SparkSession, d: str, less: float) -> DataFrame:
    return S.trades(spark, d).withColumns({"at": S.second_number(F.col("ts")), "pnl": F.round(F.col("pnl") - less, 2)})


def _polled(less: int, after: int) -> str:
    """Trades with their seconds, and polls of each symbol half an hour apart."""
    return f"""{TRADES}, x AS (SELECT symbol, {SECONDS} AS sec, id, mode, round(pnl - {less}, 2) AS pnl FROM trades),
live AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sec, id) AS rn FROM x WHERE mode = 'LIVE'), paper AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sec, id) AS rn FROM x WHERE mode = 'PAPER'),
ends AS (SELECT symbol, CAST(ceil(min(sec) / 1800) AS BIGINT) AS a, (max(sec) + {after}) // 1800 AS b FROM x WHERE mode IN ({"'LIVE', 'PAPER'" if after < 100000 else "'LIVE'"}) GROUP BY 1),
polls AS (SELECT symbol, unnest(generate_series(a, b)) * 1800 AS poll FROM ends),
lp AS (SELECT p.symbol, poll, l.rn FROM polls p ASOF LEFT JOIN (SELECT symbol, sec, max(rn) AS rn FROM live GROUP BY 1, 2) l ON p.symbol = l.symbol AND p.poll >= l.sec)"""


@query(f"""WITH RECURSIVE {_polled(60, 43200).removeprefix('WITH ')}, pp AS (SELECT p.symbol, poll, l.rn FROM polls p ASOF LEFT JOIN (SELECT symbol, sec, max(rn) AS rn FROM paper GROUP BY 1, 2) l ON p.symbol = l.symbol AND p.poll >= l.sec),
lf AS (SELECT lp.symbol, poll, count(l.rn) AS n, count(*) FILTER (pnl > 0 AND l.rn > lp.rn - 5) AS wins FROM lp LEFT JOIN live l ON l.symbol = lp.symbol AND l.rn BETWEEN lp.rn - 9 AND lp.rn AND l.sec >= poll - 604800 GROUP BY 1, 2),
pf AS (SELECT pp.symbol, poll, count(l.rn) AS pn, count(*) FILTER (pnl > 0) AS pw FROM pp LEFT JOIN paper l ON l.symbol = pp.symbol AND l.rn BETWEEN pp.rn - 4 AND pp.rn GROUP BY 1, 2),
f AS (SELECT lf.*, pn, pw, row_number() OVER (PARTITION BY lf.symbol ORDER BY lf.poll) AS i FROM lf JOIN pf ON lf.symbol = pf.symbol AND lf.poll = pf.poll),
m(symbol, i, poll, since, was, event, reason) AS (SELECT DISTINCT symbol, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM f
 UNION ALL SELECT symbol, i, poll, CASE WHEN since IS NULL THEN CASE WHEN stop THEN poll END WHEN why IS NULL THEN since END, since, CASE WHEN since IS NULL THEN CASE WHEN stop THEN 'pause' END WHEN why IS NOT NULL THEN 'resume' END, CASE WHEN since IS NULL THEN CASE WHEN stop THEN 'losses' END ELSE why END
 FROM (SELECT f.symbol, f.i, f.poll, m.since, n >= 5 AND wins = 0 AS stop, CASE WHEN n < 5 THEN 'stale' WHEN f.poll - since >= 1800 AND wins >= 2 THEN 'live_wins' WHEN f.poll - since >= 1800 AND pn >= 5 AND pw >= 3 THEN 'paper_wins' WHEN f.poll - since >= 21600 AND pw >= 3 THEN 'time' WHEN f.poll - since >= 43200 THEN 'hard' END AS why
  FROM m JOIN f ON f.symbol = m.symbol AND f.i = m.i + 1))
SELECT symbol, poll AS "at", event, reason, poll - was AS seconds FROM m WHERE event IS NOT NULL""")
def loss_pauses(spark: SparkSession, d: str) -> DataFrame:
    """Stops and starts of each symbol by runs of losses, polled every half hour; the soft resume asks for three paper wins."""
    return PA.loss_pauses(_trades(spark, d, 60), rules=POLL_RULES)


@query(f"""{_polled(0, 604800)}, lf AS (SELECT lp.symbol, poll AS sec, count(l.rn) AS n, avg(CAST(pnl AS DECIMAL(18, 6))) AS mean FROM lp LEFT JOIN live l ON l.symbol = lp.symbol AND l.rn BETWEEN lp.rn - 49 AND lp.rn AND l.sec > poll - 604800 GROUP BY 1, 2),
y AS (SELECT *, n >= 20 AND mean <= 190 AS stopped FROM lf), z AS (SELECT *, coalesce(lag(stopped) OVER (PARTITION BY symbol ORDER BY sec), false) AS was FROM y)
SELECT symbol, sec AS "at", CASE WHEN stopped THEN 'pause' ELSE 'resume' END AS event, n, round(CAST(mean AS DOUBLE), 6) AS mean FROM z WHERE stopped <> was""")
def value_pauses(spark: SparkSession, d: str) -> DataFrame:
    """Stops and starts by the mean of the latest fifty results of a week."""
    return out(PA.value_pauses(_trades(spark, d, 0), every=1_800, limit=190.0), "symbol at event n", "mean")


@query(f"""WITH RECURSIVE {BARS.removeprefix('WITH ')}, c AS (SELECT symbol, t, abs(close / nullif(lag(close) OVER ({W}), 0) - 1) AS x FROM bars), k AS (SELECT symbol, t FROM c WHERE x >= 0.4),
m(symbol, t) AS (SELECT symbol, min(t) FROM k GROUP BY 1 UNION ALL SELECT m.symbol, (SELECT min(k.t) FROM k WHERE k.symbol = m.symbol AND k.t >= m.t + 6) AS n FROM m WHERE n IS NOT NULL)
SELECT symbol, t, 1 AS n FROM m""")
def cooled_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly moves of two fifths alert, at most one in six hours."""
    from ..operators import indicators as I

    moves = I.returns(S.hourly_bars(spark, d), (1,)).filter(F.abs("returns_1") >= 0.4)
    return PA.cooled_alerts(moves, ["symbol"], "t", 6)


@query(f"""WITH RECURSIVE {TRADES.removeprefix('WITH ')}, {SIGNALS.removeprefix('WITH ')}, o AS (SELECT symbol, {SECONDS} AS sec, id, CASE WHEN pnl > 60 THEN 1 ELSE 0 END AS win FROM trades WHERE mode = 'LIVE' AND id % 40 = 1 AND pnl <> 60),
s AS (SELECT s.symbol, {SECONDS} AS sec, s.id, confidence * 0.42 AS confidence FROM signals s JOIN trades t ON s.id = t.id),
b AS (SELECT symbol, sec, 0 AS k, id, win, NULL::DOUBLE AS confidence FROM o UNION ALL SELECT symbol, sec, 1, id, NULL::INTEGER, confidence FROM s),
c AS (SELECT *, coalesce(sum(win) OVER (PARTITION BY symbol ORDER BY sec, k, id), 0) AS wins FROM b), e AS (SELECT *, count(*) FILTER (win = 0) OVER (PARTITION BY symbol, wins ORDER BY sec, k, id) AS losses FROM c),
g AS (SELECT *, sum(k) OVER (PARTITION BY symbol, wins, losses ORDER BY sec, k, id) AS since FROM e),
f AS (SELECT symbol, sec, id, confidence, 0.4::DOUBLE + CASE WHEN losses > 0 AND since <= 24 THEN least(losses * 0.05::DOUBLE, 0.15::DOUBLE) ELSE 0 END AS floor, row_number() OVER (PARTITION BY symbol ORDER BY sec, id) AS i FROM g WHERE k = 1),
m(symbol, i, id, floor, holds, minimum, taken) AS (SELECT DISTINCT symbol, 0::BIGINT, 0::BIGINT, 0::DOUBLE, -1::BIGINT, 0::DOUBLE, false FROM f
 UNION ALL SELECT symbol, i, id, floor, h, mn, confidence >= mn FROM (SELECT *, CASE WHEN h > 60 THEN greatest(floor - (h - 60) * 0.005::DOUBLE, 0.25::DOUBLE) ELSE floor END AS mn FROM (SELECT f.*, CASE WHEN m.taken THEN 0 ELSE m.holds + 1 END AS h FROM m JOIN f ON f.symbol = m.symbol AND f.i = m.i + 1)))
SELECT symbol, id, round(floor, 6) AS floor, holds, round(minimum, 6) AS minimum, taken FROM m WHERE i > 0""")
def adaptive_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The least confidence of each signal: stricter after losses, laxer after many signals that were not taken."""
    s = S.signals(spark, d).withColumns({"confidence": F.col("confidence") * 0.42})
    s = s.join(S.trades(spark, d).select("id", S.second_number(F.col("ts")).alias("at")), "id")
    o = _trades(spark, d, 60).filter("mode = 'LIVE' AND id % 40 = 1")
    return out(PA.adaptive_confidence(s, o), "symbol id holds taken", "floor minimum")
