"""URL filters: host and path rules, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
GRAMS = (3, 4, 5)
#: At most this many labelled URLs are read by the driver to fit the model.
MAX_LABELLED = 20_000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is a host followed by a path prefix, such as ``example.org/en/``."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty when the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rule(rules: tuple[UrlRule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits. Of equally long ones the first listed wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.pattern)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def hashed_grams(host: pd.Series, path: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all URLs in one array, and for each the row it belongs to. Host and path have own features."""
    feats, owners = [], []
    for part, seed in ((host, 17), (path, 91)):
        data = [b"^" + s.encode() + b"$" for s in part]
        size = np.fromiter(map(len, data), np.int64, len(data))
        buf = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(data)), size)
        for n in GRAMS:
            if len(buf) < n:
                continue
            code = np.full(len(buf) - n + 1, seed * 1_000_003 + n, np.uint64)
            for k in range(n):
                code = code * np.uint64(0x100000001B3) ^ buf[k : len(buf) - n + 1 + k]
            code ^= code >> np.uint64(29)
            code *= np.uint64(0x9E3779B97F4A7C15)
            inside = row[: len(code)] == row[n - 1 :]
            feats.append((code >> np.uint64(64 - BITS))[inside].astype(np.int64))
            owners.append(row[: len(code)][inside])
    if not feats:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(feats), np.concatenate(owners)


@dataclass
class UrlModel:
    """Weights of the hashed n-grams and the intercept."""

    weights: np.ndarray
    bias: float

    def scores(self, host: pd.Series, path: pd.Series) -> np.ndarray:
        """Probability that a URL is to be blocked: the mean weight of its n-grams through the logistic function."""
        f, r = hashed_grams(host, path)
        total = np.bincount(r, self.weights[f], len(host))
        norm = np.sqrt(np.maximum(np.bincount(r, minlength=len(host)), 1))
        return 1 / (1 + np.exp(-(total / norm + self.bias)))


def fit(labelled: DataFrame, epochs: int = 400, rate: float = 2.0, ridge: float = 1e-3) -> UrlModel:
    """Fit by full-batch gradient descent on columns url and blocked (0 or 1); at most MAX_LABELLED rows are used."""
    host, path = split_url(F.col("url"))
    rows = labelled.filter("blocked is not null").select(host.alias("h"), path.alias("p"), F.col("blocked").cast("double").alias("y")).orderBy("h", "p", "y").limit(MAX_LABELLED).toPandas()
    w, b = np.zeros(1 << BITS), 0.0
    if rows.empty:
        return UrlModel(w, b)
    f, r = hashed_grams(rows.h, rows.p)
    norm = np.sqrt(np.maximum(np.bincount(r, minlength=len(rows)), 1))
    y = rows.y.to_numpy()
    balance = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(np.bincount(r, w[f], len(rows)) / norm + b)))
        g = (p - y) * balance / len(rows)
        w -= rate * (np.bincount(f, (g / norm)[r], 1 << BITS) + ridge * w)
        b -= rate * g.sum()
    return UrlModel(w, b)


def filter_urls(df: DataFrame, rules: tuple[UrlRule, ...], model: UrlModel, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, verdict (allow or block) and score, the model's probability of block.

    A rule that fits decides; else the model does. Null URLs and URLs without ``://`` have an empty host and path, no
    rule, and the model's verdict on an empty URL. Input rows and columns stay; a column named like an output is replaced.
    """
    host, path = split_url(F.col(f"`{url}`"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, p in batches:
            yield pd.Series(shared.value.scores(h, p))

    out = df.withColumns({"host": host, "path": path})
    rule, verdict = match_rule(rules, F.col("host"), F.col("path"))
    out = out.withColumns({"rule": rule, "verdict": verdict, "score": score(F.col("host"), F.col("path"))})
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))))
