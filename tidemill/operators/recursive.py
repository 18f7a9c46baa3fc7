"""Recursive indicators: one Arrow grouped map over the bars of a symbol, sorted by t."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BAR = ["open", "high", "low", "close", "volume"]


def ewm(x: pd.Series, span: float | None = None, alpha: float | None = None, adjust: bool = False, least: int = 0) -> pd.Series:
    """Exponential mean; recursive from the first value unless adjusted."""
    return x.ewm(span=span, alpha=alpha, adjust=adjust, min_periods=least).mean()


def rsi(close: pd.Series, n: int) -> pd.Series:
    """Wilder RSI from exponential means of gains and losses."""
    d = close.diff()
    up, down = ewm(d.clip(lower=0), alpha=1 / n, least=n), ewm(-d.clip(upper=0), alpha=1 / n, least=n)
    return pd.Series(np.where(down == 0, 100.0, 100 - 100 / (1 + up / down.where(down != 0))), close.index).where(up.notna())


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the first n values, then (previous * (n - 1) + x) / n; 0 before."""
    out = np.zeros(len(x))
    if len(x) >= n:
        tail = np.concatenate([[x[:n].mean()], x[n:]])
        out[n - 1 :] = pd.Series(tail).ewm(alpha=1 / n, adjust=False).mean()
    return out


def kama(close: np.ndarray, n: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Adaptive mean: the pace follows the efficiency of the last n moves; it starts at the n-th bar with its close."""
    out = np.full(len(close), np.nan)
    if len(close) <= n:
        return out
    move = np.abs(np.diff(close, prepend=close[0]))
    total = pd.Series(move).rolling(n).sum().to_numpy()
    shift = np.abs(close - np.concatenate([np.full(n, np.nan), close[:-n]]))
    er = np.divide(shift, total, out=np.zeros(len(close)), where=total > 0)
    pace = (er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
    k = close[n]
    out[n] = k
    for i in range(n + 1, len(close)):
        k += pace[i] * (close[i] - k)
        out[i] = k
    return out


def hurst(close: np.ndarray, n: int = 64, chunks: tuple[int, ...] = (8, 16, 32)) -> np.ndarray:
    """Slope of log R/S on log size over the n log returns before a bar, clipped to [0, 1]; 0.5 where fewer than two sizes are not flat."""
    out = np.full(len(close), np.nan)
    r = np.diff(np.log(close))
    if len(r) < n:
        return out
    w = np.lib.stride_tricks.sliding_window_view(r, n)[: len(close) - n - 1]
    logs = []
    for c in chunks:
        parts = w.reshape(len(w), n // c, c)
        dev = np.cumsum(parts - parts.mean(2, keepdims=True), axis=2)
        sd = parts.std(2)
        rs = np.divide(dev.max(2) - dev.min(2), sd, out=np.full(sd.shape, np.nan), where=(sd > 1e-10) & (dev.max(2) > dev.min(2)))
        with np.errstate(invalid="ignore", divide="ignore"):
            logs.append(np.log(np.nanmean(rs, axis=1)) if rs.size else np.zeros(0))
    y, x = np.array(logs).T, np.log(chunks)
    fit = np.isfinite(y)
    count = fit.sum(1)
    off = np.where(fit, x - ((fit * x).sum(1) / np.maximum(count, 1))[:, None], 0.0)
    slope = (off * np.where(fit, y, 0.0)).sum(1) / np.where(count > 1, (off**2).sum(1), 1.0)
    out[n + 1 :] = np.where(count > 1, np.clip(slope, 0, 1), 0.5)
    return out


def _features(pdf: pd.DataFrame) -> pd.DataFrame:
    p = pdf.sort_values("t", kind="stable").reset_index(drop=True)
    c, h, low = p.close, p.high, p.low
    out = p[["symbol", "t"]].copy()
    for n in (9, 21, 50):
        out[f"ema_{n}"] = ewm(c, span=n, least=n)
    for n in (7, 14, 21):
        out[f"rsi_{n}"] = rsi(c, n)
    out["macd"] = ewm(c, span=12, least=12) - ewm(c, span=26, least=26)
    out["macd_signal"] = ewm(out.macd, span=9, least=9)
    out["macd_hist"] = out.macd - out.macd_signal
    tr = np.maximum(h - low, np.maximum((h - c.shift()).abs(), (low - c.shift()).abs())).fillna(h - low)
    out["atr_14"] = wilder(tr.to_numpy(), 14)
    up, down = h.diff().fillna(0), (-low.diff()).fillna(0)
    plus = ewm(up.where((up > down) & (up > 0), 0.0), alpha=1 / 14)
    minus = ewm(down.where((down > up) & (down > 0), 0.0), alpha=1 / 14)
    atr = ewm(tr, alpha=1 / 14)
    dp, dm = 100 * plus / atr.where(atr > 0), 100 * minus / atr.where(atr > 0)
    out["di_plus"], out["di_minus"] = dp, dm
    out["adx"] = ewm((100 * (dp - dm).abs() / (dp + dm).where(dp + dm > 0)).fillna(0), alpha=1 / 14)
    out["kama"] = kama(c.to_numpy())
    out["kama_slope"] = out.kama.diff(5)
    out["hurst"] = hurst(c.to_numpy())
    return out


SCHEMA = "symbol string, t long, ema_9 double, ema_21 double, ema_50 double, rsi_7 double, rsi_14 double, rsi_21 double, macd double, macd_signal double, macd_hist double, atr_14 double, di_plus double, di_minus double, adx double, kama double, kama_slope double, hurst double"


def recursive_features(bars: DataFrame) -> DataFrame:
    """EMA, RSI, MACD, ATR, ADX, KAMA and Hurst of each symbol's bars, in one pass over the bars.

    Recursions are sequential, so a symbol is one group; its bars (a few bytes each) are all that a task holds.
    """
    return bars.select("symbol", "t", *BAR).groupBy("symbol").applyInPandas(_features, SCHEMA)


def ema(bars: DataFrame, n: int, depth: int | None = None) -> DataFrame:
    """EMA of the close, without min_periods, as a chain of built-in functions.

    The last ``depth`` closes are folded from the oldest; weights of older ones are below 1e-16 by then.
    """
    from pyspark.sql import functions as F

    from ..functions.frames import last

    a = 2 / (n + 1)
    depth = depth or int(np.ceil(np.log(1e-16) / np.log(1 - a)))
    seen = F.collect_list("close").over(last(depth))
    return bars.withColumn(f"ema_{n}", F.aggregate(F.slice(seen, 2, depth), seen[0], lambda e, x: e + a * (x - e)))
