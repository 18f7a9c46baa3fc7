"""Streaming twins: windowed bars with late data, and change points with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.simulate import RunLengths


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a tick stream (symbol, ts, event_id, price, amount): repeated events inside the watermark count once, later ones are dropped."""
    d = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    seq = F.struct("ts", "event_id")
    b = d.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.sum("amount").alias("volume"))
    return b.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_vpin(flow: DataFrame, n: int = 50) -> DataFrame:
    """VPIN of a stream of buckets (symbol, t, buy, sell): the last n imbalances of each symbol are its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        total = rows.buy + rows.sell
        x = np.where(total > 0, (rows.buy - rows.sell).abs() / total.where(total > 0, 1.0), 0.0)
        out = []
        for t, v in zip(rows.t.tolist(), x.tolist(), strict=True):
            kept = [*kept, v][-n:]
            out.append((key[0], t, sum(kept) / len(kept)))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["symbol", "t", "vpin"])

    return flow.groupBy("symbol").applyInPandasWithState(step, "symbol string, t long, vpin double", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_change_points(bars: DataFrame) -> DataFrame:
    """Change points of a stream of closes (symbol, t, close), one detector a symbol; batch twin: ``change_points``."""
    state_schema = "last double, p array<double>, mu array<double>, kappa array<double>, alpha array<double>, beta array<double>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model, last = RunLengths(), None
        if state.exists:
            last, *arrays = state.get
            model.p, model.mu, model.kappa, model.alpha, model.beta = (np.array(a, float) for a in arrays)
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = []
        for t, c in zip(rows.t.tolist(), rows.close.tolist(), strict=True):
            if c <= 0:
                continue
            if last is not None:
                out.append((key[0], t, *model.update(float(np.log(c) - np.log(last)))))
            last = float(c)
        if last is not None:
            state.update((last, *(a.tolist() for a in (model.p, model.mu, model.kappa, model.alpha, model.beta))))
        yield pd.DataFrame(out, columns=["symbol", "t", "change", "run"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, t long, change double, run long", state_schema, "append", GroupStateTimeout.NoTimeout)
