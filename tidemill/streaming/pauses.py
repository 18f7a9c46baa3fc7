"""Pauses and cool-downs of live streams: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pauses import PauseRules

EVENTS = "key string, at long, event string, reason string, seconds long"
STATE = "next long, since long, live_at array<bigint>, live_won array<boolean>, paper_won array<boolean>"


class LossPauses(StatefulProcessor):
    """One key's pauses. New trades wait until the watermark has passed the poll that sees them; a timer stands for the next poll
    that can change anything: the one after a waiting trade, or the next one while orders are stopped or have just started."""

    def __init__(self, rules: PauseRules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getListState("waiting", "at long, id long, live boolean, won boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for pdf in rows for r in pdf[["at", "id", "live", "won"]].itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList([(int(a), int(i), bool(live), bool(w)) for a, i, live, w in new])
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        rules = self.rules
        following, since, live, paper = None, None, [], []
        if self.state.exists():
            following, since, at, won, paper = self.state.get()
            live, paper = list(zip(at, won, strict=True)), list(paper)
        waiting = sorted((tuple(r) for r in self.waiting.get()), reverse=True)
        due = lambda at: -(-at // rules.every) * rules.every
        poll = following if since is not None or following is not None else due(waiting[-1][0]) if waiting else None
        if poll is not None and since is None and waiting:
            poll = min(poll, due(waiting[-1][0])) if following is None else poll
        out = []
        while poll is not None and (poll + 1) * 1000 <= watermark:
            while waiting and waiting[-1][0] <= poll:
                at, _, is_live, won = waiting.pop()
                if is_live:
                    live = [*live, (at, won)][-rules.keep :]
                else:
                    paper = [*paper, won][-rules.streak :]
            recent = [won for at, won in live if at >= poll - rules.window]
            was = since
            since, event, reason = rules.step(since, poll, len(recent), sum(recent[-rules.streak :]), len(paper), sum(paper))
            if event:
                out.append((key[0], poll, event, reason, None if was is None else poll - was))
            if since is not None or event == "resume":
                poll += rules.every
            else:
                poll = max(poll + rules.every, due(waiting[-1][0])) if waiting else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if poll is not None:
            self.handle.registerTimer((poll + 1) * 1000)
        self.state.update((poll, since, [a for a, _ in live], [w for _, w in live], paper))
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        yield pd.DataFrame(out, columns=["key", "at", "event", "reason", "seconds"]).astype({"seconds": "Int64"})

    def close(self) -> None:
        pass


def stream_loss_pauses(trades: DataFrame, by: str = "symbol", rules: PauseRules = PauseRules(), late: str = "10 minutes") -> DataFrame:  # noqa: B008  frozen
    """Stops and starts of a stream of trades (by, ts, id, mode, pnl), as ``operators.pauses.loss_pauses`` gives them for a table.

    An event comes out once the watermark, ``late`` behind the latest trade, has passed its poll. Needs the RocksDB state store.
    """
    d = trades.withWatermark("ts", late).filter("mode IN ('LIVE', 'PAPER')")
    d = d.select(F.col(by).cast("string").alias("key"), "ts", F.unix_seconds(F.col("ts")).alias("at"), "id", (F.col("mode") == "LIVE").alias("live"), F.coalesce(F.col("pnl") > 0, F.lit(False)).alias("won"))
    got = d.groupBy("key").transformWithStateInPandas(LossPauses(rules), EVENTS, "append", "EventTime")
    return got.withColumnRenamed("key", by)


class CooledAlerts(StatefulProcessor):
    """One key's alerts: a candidate alerts unless the state still holds an alert; a timer clears it when the cool-down is over."""

    def __init__(self, cooldown: int) -> None:
        self.cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.waiting.appendList([(int(a),) for pdf in rows for a in pdf["at"]])
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        times, out = sorted(r[0] for r in self.waiting.get()), []
        for k, at in enumerate(times):
            if (at + 1) * 1000 > watermark:
                times = times[k:]
                break
            if last is None or at - last >= self.cooldown:
                last = at
                out.append((key[0], at))
        else:
            times = []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.handle.registerTimer((times[0] + 1) * 1000)
            self.waiting.put([(t,) for t in times])
        else:
            self.waiting.clear()
        if last is not None and (last + self.cooldown) * 1000 <= watermark and not times:
            self.last.clear()
        elif last is not None:
            self.last.update((last,))
            if not times:
                self.handle.registerTimer((last + self.cooldown) * 1000)
        yield pd.DataFrame(out, columns=["key", "at"])

    def close(self) -> None:
        pass


def stream_cooled_alerts(candidates: DataFrame, by: str, cooldown: int, late: str = "10 minutes") -> DataFrame:
    """The candidates of a stream (by, ts) that alert, as ``operators.pauses.cooled_alerts`` gives them for a table."""
    d = candidates.withWatermark("ts", late).select(F.col(by).cast("string").alias("key"), "ts", F.unix_seconds(F.col("ts")).alias("at"))
    return d.groupBy("key").transformWithStateInPandas(CooledAlerts(cooldown), "key string, at long", "append", "EventTime").withColumnRenamed("key", by)
