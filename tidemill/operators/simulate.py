"""Sequential machines over the rows of a symbol: back-test, change points, hierarchical risk parity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RESULT = "symbol string, n_bars long, n_trades long, final_equity double, total_return double, sharpe double, max_drawdown double, win_rate double, profit_factor double"


def run_backtest(actions: list[str], close: np.ndarray, size: np.ndarray, capital: float = 10_000.0, fee: float = 0.0004, slip: float = 0.0005, leverage: float = 1.0) -> dict:
    """One position at a time: long and short close the other side first; fees on both legs; equity marked every bar.

    A trade's result is net of its exit fee. The largest fall is a share of the overall peak. An entry at price 0 earns nothing.
    """
    equity, pos, entry = capital, 0.0, 0.0
    curve, pnls = [capital], []

    def close_out(price: float) -> None:
        nonlocal equity, pos, entry
        pnl = (pos * (price - entry) / entry * leverage if entry else 0.0) * equity - abs(pos) * fee * equity
        pnls.append(pnl)
        equity += pnl
        pos, entry = 0.0, 0.0

    for act, c, s in zip(actions, close.tolist(), size.tolist(), strict=True):
        price = c * (1 + slip) if act == "long" else c * (1 - slip)
        if act == "long" and pos <= 0 or act == "short" and pos >= 0:
            if pos:
                close_out(price)
            pos, entry = (s if act == "long" else -s), price
            equity -= abs(pos) * fee * equity
        elif act == "close" and pos:
            close_out(price)
        curve.append(equity * (1 + (pos * (c - entry) / entry * leverage if pos and entry else 0.0)))
    e = np.array(curve)
    r = np.diff(e) / e[:-1]
    p = np.array(pnls)
    gain, loss = p[p > 0].sum(), -p[p < 0].sum()
    peak = np.maximum.accumulate(e)
    return {
        "n_bars": len(close), "n_trades": len(p), "final_equity": e[-1], "total_return": e[-1] / capital - 1,
        "sharpe": r.mean() / (r.std() + 1e-8) * math.sqrt(252 * 24) if len(r) else 0.0, "max_drawdown": float((peak - e).max() / (e.max() + 1e-8)),
        "win_rate": float((p > 0).mean()) if len(p) else 0.0, "profit_factor": gain / loss if loss > 0 else math.inf,
    }


def backtest(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics of each symbol's actions (symbol, t, close, action, size); symbols run in parallel, each one in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("t", kind="stable")
        return pd.DataFrame([{"symbol": p.symbol.iloc[0]} | run_backtest(p.action.tolist(), p.close.to_numpy(float), p["size"].to_numpy(float))])

    return rows.select("symbol", "t", "close", "action", "size").groupBy("symbol").applyInPandas(run, RESULT)


class RunLengths:
    """Bayesian online change points: a Student-t posterior for each run length, constant hazard, pruned to a bound."""

    def __init__(self, hazard: float = 1 / 250, most: int = 500, mu: float = 0.0, kappa: float = 1.0, alpha: float = 1.0, beta: float = 1e-4) -> None:
        self.hazard, self.most, self.prior = hazard, most, (mu, kappa, alpha, beta)
        self.p = np.array([1.0])
        self.mu, self.kappa, self.alpha, self.beta = (np.array([x]) for x in self.prior)

    def update(self, x: float) -> tuple[float, int]:
        """Probability that the run starts anew, and the most likely run length."""
        scale = self.beta * (self.kappa + 1) / (self.alpha * self.kappa)
        df = 2 * self.alpha
        log = np.array([math.lgamma((d + 1) / 2) - math.lgamma(d / 2) for d in df.tolist()]) - 0.5 * np.log(df * math.pi * scale)
        pdf = np.exp(log - (df + 1) / 2 * np.log1p((x - self.mu) ** 2 / (df * scale)))
        joint = self.p * pdf
        p = np.concatenate([[joint.sum() * self.hazard], joint * (1 - self.hazard)])
        total = p.sum()
        p = p / total if total > 0 else np.eye(1, len(p)).ravel()
        mu0, k0, a0, b0 = self.prior
        beta = self.beta + self.kappa * (x - self.mu) ** 2 / (2 * (self.kappa + 1))
        self.mu = np.concatenate([[mu0], (self.kappa * self.mu + x) / (self.kappa + 1)])[: self.most]
        self.kappa = np.concatenate([[k0], self.kappa + 1])[: self.most]
        self.alpha = np.concatenate([[a0], self.alpha + 0.5])[: self.most]
        self.beta = np.concatenate([[b0], beta])[: self.most]
        self.p = p[: self.most] / p[: self.most].sum()
        return float(self.p[0]), int(self.p.argmax())


def change_points(bars: DataFrame) -> DataFrame:
    """symbol, t, change (probability of a new run) and run (its likeliest length) after each return; prices <= 0 are skipped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[pdf.close > 0].sort_values("t", kind="stable")
        state, rows = RunLengths(), []
        for t, r in zip(p.t.tolist()[1:], np.diff(np.log(p.close.to_numpy(float))).tolist(), strict=True):
            rows.append((p.symbol.iloc[0], t, *state.update(r)))
        return pd.DataFrame(rows, columns=["symbol", "t", "change", "run"])

    return bars.select("symbol", "t", "close").groupBy("symbol").applyInPandas(run, "symbol string, t long, change double, run long")


def risk_parity(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity weights of a covariance matrix: single linkage, quasi-diagonal order, bisection."""
    n = len(cov)
    sd = np.sqrt(np.diag(cov))
    dist = np.sqrt(np.clip(0.5 * (1 - cov / np.outer(sd, sd)), 0, None))
    gap = np.sqrt(((dist[:, None, :] - dist[None, :, :]) ** 2).sum(2))
    groups = {i: [i] for i in range(n)}
    while len(groups) > 1:
        keys = sorted(groups)
        a, b = min(((x, y) for k, x in enumerate(keys) for y in keys[k + 1 :]), key=lambda q: min(gap[i, j] for i in groups[q[0]] for j in groups[q[1]]))
        groups[a] = groups[a] + groups.pop(b)
    order = next(iter(groups.values()))
    w = np.ones(n)

    def variance(idx: list[int]) -> float:
        sub = cov[np.ix_(idx, idx)]
        inv = 1 / np.diag(sub)
        inv /= inv.sum()
        return float(inv @ sub @ inv)

    stack = [order]
    while stack:
        part = stack.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a = 1 - variance(left) / (variance(left) + variance(right))
        w[left] *= a
        w[right] *= 1 - a
        stack += [left, right]
    return w / w.sum()


def portfolio_weights(returns: DataFrame, symbols: list[str], most: int = 2000) -> DataFrame:
    """Weights of the symbols from returns (symbol, t, ret): covariances are aggregates, and only the matrix is collected.

    The matrix has one row a symbol; more than ``most`` symbols are refused.
    """
    from pyspark.sql import functions as F

    if len(symbols) > most:
        raise ValueError("too many symbols for one covariance matrix")
    wide = returns.groupBy("t").pivot("symbol", symbols).agg(F.avg("ret")).na.drop()
    pairs = [(i, j) for i in range(len(symbols)) for j in range(i, len(symbols))]
    row = wide.agg(*[F.covar_samp(F.col(f"`{symbols[i]}`"), F.col(f"`{symbols[j]}`")).alias(f"c{i}_{j}") for i, j in pairs]).head()
    cov = np.zeros((len(symbols), len(symbols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    w = risk_parity(cov)
    return returns.sparkSession.createDataFrame([(s, float(x)) for s, x in zip(symbols, w, strict=True)], "symbol string, weight double")
