"""Pauses, cool-downs and adaptive thresholds: state machines over polls and events, cut where their state is known.

Each machine is a sequence of steps that depend on what happened before. None of them remembers for ever: a pause ends after
a known time, a cool-down too, and a decision that passes the highest threshold passes whatever came before. Windows find
such places, and between two of them a stretch is folded on its own, so the stretches of a long series go to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import asof_join

DAY = 86_400
#: Stretches of decisions that are folded one after another.
STRETCHES = 4_096


@dataclass(frozen=True)
class PauseRules:
    """When live orders stop and start again; times in seconds.

    It stops at a poll whose latest ``streak`` live trades, of the latest ``keep`` within ``window``, all failed to win. It
    starts again when fewer than ``streak`` such trades are left; ``settle`` after the stop, when ``live_wins`` of the latest
    ``streak`` live or ``paper_wins`` of the latest paper trades won; ``soft`` after it, if paper has at least ``soft_wins``;
    and ``hard`` after it in any case.
    """

    every: int = 600
    keep: int = 10
    streak: int = 5
    window: int = 7 * DAY
    settle: int = 1_800
    live_wins: int = 2
    paper_wins: int = 3
    soft: int = 6 * 3_600
    soft_wins: int = 0
    hard: int = 12 * 3_600

    def __post_init__(self) -> None:
        if self.every <= 0 or self.hard % self.every or self.keep < self.streak:
            raise ValueError("hard must be a multiple of every, and keep at least streak")

    def step(self, since: int | None, poll: int, live: int, wins: int, paper: int, paper_wins: int) -> tuple[int | None, str | None, str | None]:
        """The time of the stop (None: running), event and reason after a poll. ``live`` and ``paper`` count trades that are judged."""
        if since is None:
            return (poll, "pause", "losses") if live >= self.streak and wins == 0 else (None, None, None)
        if live < self.streak:
            return None, "resume", "stale"
        ready, good = poll - since >= self.settle, paper >= self.streak
        if ready and wins >= self.live_wins:
            return None, "resume", "live_wins"
        if ready and good and paper_wins >= self.paper_wins:
            return None, "resume", "paper_wins"
        if poll - since >= self.soft and paper_wins >= self.soft_wins:
            return None, "resume", "time"
        if poll - since >= self.hard:
            return None, "resume", "hard"
        return since, None, None


def _recent(trades: DataFrame, by: str, keep: int, value: Column, kind: str) -> DataFrame:
    """For each second with trades of a kind the latest ``keep`` of them, newest last, as (at, x)."""
    w = Window.partitionBy(by).orderBy("at", "id").rowsBetween(1 - keep, 0)
    last = F.collect_list(F.struct("at", value.alias("x"))).over(w)
    return trades.select(by, "at", "id", last.alias(kind)).groupBy(by, "at").agg(F.max_by(kind, "id").alias(kind))


def polls(trades: DataFrame, by: str, every: int, after: int) -> DataFrame:
    """The polls of each key, at multiples of ``every`` from its first trade to ``after`` seconds past its last."""
    ends = trades.groupBy(by).agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a IS NOT NULL")
    first, last = F.ceil(F.col("a") / every) * every, F.floor((F.col("b") + after) / every) * every
    return ends.select(by, F.explode(F.sequence(first, last, F.lit(every).cast("long"))).alias("poll"))


def pause_polls(trades: DataFrame, by: str, rules: PauseRules) -> DataFrame:
    """by, poll, live, wins, paper, paper_wins at each poll, from trades (by, at, id, mode, pnl). A null pnl is no win."""
    won = F.coalesce(F.col("pnl") > 0, F.lit(False))
    live = _recent(trades.filter("mode = 'LIVE'"), by, rules.keep, won, "live")
    paper = _recent(trades.filter("mode = 'PAPER'"), by, rules.streak, won, "paper")
    p = polls(trades.filter("mode IN ('LIVE', 'PAPER')"), by, rules.every, rules.hard).withColumn("at", F.col("poll"))
    p = asof_join(asof_join(p, live, "at", [by], prefix="l_"), paper, "at", [by], prefix="p_")
    recent = F.filter(F.coalesce("l_live", F.array().cast("array<struct<at:bigint,x:boolean>>")), lambda t: t["at"] >= F.col("poll") - rules.window)
    latest = F.filter(F.slice("recent", F.greatest(F.size("recent") - rules.streak + 1, F.lit(1)), rules.streak), lambda t: t["x"])
    return p.withColumn("recent", recent).select(
        by, "poll", F.size("recent").alias("live"), F.size(latest).alias("wins"),
        F.coalesce(F.size("p_paper"), F.lit(0)).alias("paper"), F.coalesce(F.size(F.filter("p_paper", lambda t: t["x"])), F.lit(0)).alias("paper_wins"),
    )


def loss_pauses(trades: DataFrame, by: str = "symbol", rules: PauseRules = PauseRules()) -> DataFrame:  # noqa: B008  frozen
    """Stops and starts of live orders of each key: by, at (poll), event, reason, seconds (a start's distance from its stop).

    ``trades``: by, at (whole seconds), id, mode, pnl; those of modes other than LIVE and PAPER do not count, nor rows without
    a time. Polls that could stop orders and lie more than ``hard`` after the last such poll begin a stretch, since by
    then orders run whatever happened before; each stretch is folded on its own. The streaming twin is
    ``streaming.pauses.stream_loss_pauses``.
    """
    stops = (F.col("live") >= rules.streak) & (F.col("wins") == 0)
    w = Window.partitionBy(by).orderBy("poll")
    before = F.last(F.when(stops, F.col("poll")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = pause_polls(trades.filter("at IS NOT NULL"), by, rules).withColumn("before", before)
    begins = stops & (F.col("before").isNull() | (F.col("poll") - F.col("before") > rules.hard))
    d = d.withColumn("stretch", F.sum(begins.cast("int")).over(w)).filter("stretch > 0").drop("before")
    kind = d.schema[by].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        since, out = None, []
        pdf = pdf.sort_values("poll")
        for poll, *state in pdf[["poll", "live", "wins", "paper", "paper_wins"]].itertuples(index=False, name=None):
            was = since
            since, event, reason = rules.step(since, poll, *state)
            if event:
                out.append((pdf[by].iloc[0], poll, event, reason, None if was is None else poll - was))
        return pd.DataFrame(out, columns=[by, "at", "event", "reason", "seconds"]).astype({"seconds": "Int64"})

    return d.groupBy(by, "stretch").applyInPandas(fold, f"`{by}` {kind}, at long, event string, reason string, seconds long")


def value_pauses(trades: DataFrame, by: str = "symbol", every: int = 600, keep: int = 50, least: int = 20, limit: float = -0.5, window: int = 7 * DAY) -> DataFrame:
    """Stops and starts by the mean result of the latest live trades: by, at, event, n, mean.

    At a poll live orders stop if at least ``least`` of the latest ``keep`` trades are no older than ``window`` and their mean
    is at most ``limit``, and runs if not; only changes are returned. What counts is the poll alone, so there is no fold.
    """
    live = trades.filter("mode = 'LIVE' AND at IS NOT NULL AND pnl IS NOT NULL")
    last = _recent(live, by, keep, F.col("pnl"), "live")
    p = asof_join(polls(live, by, every, window).withColumn("at", F.col("poll")), last, "at", [by], prefix="l_")
    p = p.withColumn("recent", F.filter(F.coalesce("l_live", F.array().cast("array<struct<at:bigint,x:double>>")), lambda t: t["at"] > F.col("poll") - window))
    total = F.aggregate("recent", F.lit(0).cast("decimal(38,6)"), lambda s, t: (s + t["x"].cast("decimal(18,6)")).cast("decimal(38,6)"))
    p = p.select(by, F.col("poll").alias("at"), F.size("recent").alias("n"), F.try_divide(total.cast("double"), F.size("recent").cast("double")).alias("mean"))
    p = p.withColumn("stopped", (F.col("n") >= least) & (F.col("mean") <= limit))
    was = F.coalesce(F.lag("stopped").over(Window.partitionBy(by).orderBy("at")), F.lit(False))
    p = p.withColumn("was", was).filter("stopped <> was")
    return p.select(by, "at", F.when(F.col("stopped"), "pause").otherwise("resume").alias("event"), "n", "mean")


def cooled_alerts(candidates: DataFrame, by: list[str], at: str, cooldown: int) -> DataFrame:
    """The candidates that alert: each at least ``cooldown`` after the last alert of its group. Of candidates at one time one alerts.

    A candidate with no other in the ``cooldown`` before it alerts whatever happened before, so it begins a stretch of its own.
    """
    w = Window.partitionBy(*by).orderBy(at)
    d = candidates.groupBy(*by, at).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag(at).over(w)
    d = d.withColumn("fresh", (before.isNull() | (F.col(at) - before >= cooldown)).cast("int"))
    d = d.withColumn("stretch", F.sum("fresh").over(w))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name not in ("fresh", "stretch"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        times, kept, k = pdf[at].to_numpy(), [], 0
        while k < len(times):
            kept.append(k)
            k = int(np.searchsorted(times, times[k] + cooldown))
        return pdf.iloc[kept].drop(columns=["fresh", "stretch"])

    return d.groupBy(*by, "stretch").applyInPandas(fold, schema)


def strictness(decisions: DataFrame, outcomes: DataFrame, by: str, base: float = 0.40, boost: float = 0.05, most: float = 0.15, strict: int = 24) -> DataFrame:
    """``floor`` of each decision (by, at, id): base, and for ``strict`` decisions after a loss more by ``boost`` for each loss since the
    last win, ``most`` at the most. An outcome at the time of a decision counts before it; a pnl of 0 or null is neither."""
    d = decisions.withColumns({"_k": F.lit(1), "_win": F.lit(None).cast("boolean")})
    o = outcomes.select(by, "at", "id", F.lit(0).alias("_k"), F.when(F.col("pnl") > 0, True).when(F.col("pnl") < 0, False).alias("_win")).filter("_win IS NOT NULL")
    w = Window.partitionBy(by).orderBy("at", "_k", "id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    both = d.unionByName(o, allowMissingColumns=True).withColumn("_wins", F.coalesce(F.sum(F.col("_win").cast("int")).over(so_far), F.lit(0)))
    era = Window.partitionBy(by, "_wins").orderBy("at", "_k", "id")
    both = both.withColumn("_losses", F.sum(F.when(F.col("_win") == F.lit(False), 1).otherwise(0)).over(era.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.sum("_k").over(Window.partitionBy(by, "_wins", "_losses").orderBy("at", "_k", "id").rowsBetween(Window.unboundedPreceding, 0))
    extra = F.when((F.col("_losses") > 0) & (since <= strict), F.least(F.col("_losses") * boost, F.lit(most))).otherwise(0.0)
    return both.withColumn("floor", F.lit(base) + extra).filter("_k = 1").drop("_k", "_win", "_wins", "_losses")


def adaptive_confidence(decisions: DataFrame, outcomes: DataFrame, by: str = "symbol", base: float = 0.40, patience: int = 60, decay: float = 0.005, lowest: float = 0.25, **strict: float) -> DataFrame:
    """by, at, id, floor, holds, minimum and taken of each decision (by, at, id, confidence).

    ``holds`` counts the decisions since the last one taken. Beyond ``patience`` of them the minimum falls from the floor by
    ``decay`` for each, not below ``lowest``; a decision is taken if its confidence reaches the minimum. The floor must not be
    below ``lowest``: then a confidence that reaches the floor is taken whatever came before, and the next stretch starts there.
    """
    if base < lowest:
        raise ValueError("base must not be below lowest")
    known = F.coalesce(F.nanvl(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.0))
    d = strictness(decisions.select(by, "at", "id", known.alias("confidence")), outcomes, by, base, **strict)
    before = Window.partitionBy(by).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("stretch", F.coalesce(F.sum((F.col("confidence") >= F.col("floor")).cast("int")).over(before), F.lit(0)))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    # Each stretch ends with a decision that is taken, so the stretches of a block follow each other without a break.
    d = d.withColumn("block", F.floor(F.col("stretch") / STRETCHES)).repartition(by, "block").sortWithinPartitions(by, "block", "at", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, holds = None, 0
        for batch in batches:
            out = []
            for key in zip(*(batch.column(c).to_pylist() for c in (by, "block", "confidence", "floor")), strict=True):
                if key[:2] != last:
                    last, holds = key[:2], 0
                confidence, floor = key[2:]
                minimum = max(floor - (holds - patience) * decay, lowest) if holds > patience else floor
                taken = confidence >= minimum
                out.append((holds, minimum, taken))
                holds = 0 if taken else holds + 1
            if out:
                made = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (by, "at", "id", "floor")), *made], names=[by, "at", "id", "floor", "holds", "minimum", "taken"])

    return d.select(by, "block", "at", "id", "confidence", "floor").mapInArrow(fold, f"`{by}` {kinds[by]}, at {kinds['at']}, id {kinds['id']}, floor double, holds long, minimum double, taken boolean")


def pause_spans(events: DataFrame, by: str = "symbol") -> DataFrame:
    """Each pause of ``loss_pauses`` with its end: by, paused_at, resumed_at (null: still paused), reason of the end."""
    w = Window.partitionBy(by).orderBy("at")
    d = events.withColumns({"resumed_at": F.lead("at").over(w), "ended": F.lead("reason").over(w)})
    return d.filter("event = 'pause'").select(by, F.col("at").alias("paused_at"), "resumed_at", F.col("ended").alias("reason"))

