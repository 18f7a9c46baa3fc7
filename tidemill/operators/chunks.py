"""Recurrences and windows over long series, cut into time chunks, so that no series has to be one group.

A step y' = a y + b is an affine map, and maps compose: a chunk is one map too. Each chunk composes its own steps, the few
chunk maps of a series are composed in turn, by levels, and then each chunk starts from the value it is handed. Windows of
k rows get the k rows before a chunk as context rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import let, ratio
from ..functions.storage import stored
from .recursive import hurst

#: Chunks of a level that make one chunk of the next, and levels.
FAN, LEVELS = 1_024, 1

Maps = dict[str, tuple[Column, Column]]


def with_chunks(df: DataFrame, order: str, width: int) -> DataFrame:
    """The rows with their ``chunk``: spans of ``width`` units of the ordering column."""
    return df.withColumn("chunk", F.floor(F.col(order) / width).cast("long"))


def overlap(df: DataFrame, k: int, by: str = "symbol", order: str = "t") -> DataFrame:
    """The rows of each (by, chunk), and as rows with ``context`` true the last ``k`` rows before the chunk.

    Only the last k rows of a chunk travel; a chunk of fewer rows passes on those of chunks before it. ``order`` must tell the rows of a series apart.
    """
    row = F.struct(order, *[c for c in df.columns if c not in (order, by, "chunk")])
    last = Window.partitionBy(by, "chunk").orderBy(F.desc(order))
    tails = df.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= k).groupBy(by, "chunk").agg(F.sort_array(F.collect_list(row)).alias("tail"))
    before = F.flatten(F.collect_list("tail").over(Window.partitionBy(by).orderBy("chunk").rowsBetween(-k, -1)))
    carried = tails.select(by, "chunk", before.alias("rows")).select(by, "chunk", F.explode(F.slice("rows", F.greatest(F.size("rows") - k + 1, F.lit(1)), k)).alias("r"))
    return df.withColumn("context", F.lit(False)).unionByName(carried.select(by, "chunk", "r.*", F.lit(True).alias("context")))


def inside(by: str = "symbol", order: str = "t") -> WindowSpec:
    """Ordered rows of a chunk, context rows first."""
    return Window.partitionBy(by, "chunk").orderBy(order)


def compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map from before the first row to after each row, for each column, by doubling steps."""
    a, b, step = a.astype(float), b.astype(float), 1
    while step < len(a):
        b = np.concatenate([b[:step], a[step:] * b[:-step] + b[step:]])
        a = np.concatenate([a[:step], a[step:] * a[:-step]])
        step *= 2
    return a, b


def applied(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Values of maps from a start; NaN is no value yet, and a map with a = 0 begins anew."""
    with np.errstate(invalid="ignore"):
        return np.where(a == 0, b, a * start + b)


def _starts(maps: DataFrame, names: list[str], by: str, level: int) -> DataFrame:
    """by, chunk and s_name: the value each chunk starts from, from the chunks' maps a_name, b_name."""
    kind = maps.schema[by].dataType.simpleString()
    fields = ", ".join(f"s_{n} double" for n in names)
    a_cols, b_cols, s_cols = [f"a_{n}" for n in names], [f"b_{n}" for n in names], [f"s_{n}" for n in names]

    def handed(pdf: pd.DataFrame, start: np.ndarray) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        a, b = compose(pdf[a_cols].to_numpy(), pdf[b_cols].to_numpy())
        after = applied(a, b, start)
        return pd.concat([pdf[[by, "chunk"]].reset_index(drop=True), pd.DataFrame(np.vstack([start, after[:-1]]), columns=s_cols)], axis=1)

    if level == 0:
        return maps.groupBy(by).applyInPandas(lambda pdf: handed(pdf, np.full(len(names), np.nan)), f"`{by}` {kind}, chunk long, {fields}")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        a, b = compose(pdf[a_cols].to_numpy(), pdf[b_cols].to_numpy())
        return pd.DataFrame([[pdf[by].iloc[0], pdf["group"].iloc[0], *a[-1], *b[-1]]], columns=[by, "chunk", *a_cols, *b_cols])

    grouped = maps.withColumn("group", F.floor(F.col("chunk") / FAN).cast("long"))
    wider = stored(grouped.groupBy(by, "group").applyInPandas(whole, f"`{by}` {kind}, chunk long, " + ", ".join(f"{c} double" for c in [*a_cols, *b_cols])))
    given = _starts(wider, names, by, level - 1).withColumnRenamed("chunk", "group")
    both = grouped.join(given.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")) & (grouped["group"] == given["group"])).drop("_by").drop(given["group"])
    return both.groupBy(by, "group").applyInPandas(lambda pdf: handed(pdf, pdf[s_cols].iloc[0].to_numpy(float)), f"`{by}` {kind}, chunk long, {fields}")


def affine_scan(df: DataFrame, maps: Maps, by: str = "symbol", order: str = "t", levels: int = LEVELS) -> DataFrame:
    """Add y = a y' + b for each named pair of columns, along the rows of each series in their chunks.

    a = 0 starts anew; before the first such row there is no value (null), and a row with a null a or b keeps the value before it.
    The chunks' maps and starts, one row a chunk, are stored, so the rows are read twice and no plan grows with the scans before it.
    A task holds one chunk, or the maps of FAN chunks; beyond the last level those of all wider chunks of one series: one of
    FAN ** levels chunks' rows.
    """
    names = list(maps)
    d = df
    for n, (a, b) in maps.items():
        known = a.isNotNull() & b.isNotNull()
        d = d.withColumns({f"a_{n}": F.when(known, a.cast("double")).otherwise(1.0), f"b_{n}": F.when(known, b.cast("double")).otherwise(0.0)})
    a_cols, b_cols, s_cols = [f"a_{n}" for n in names], [f"b_{n}" for n in names], [f"s_{n}" for n in names]
    kind = df.schema[by].dataType.simpleString()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, b = compose(pdf[a_cols].to_numpy(), pdf[b_cols].to_numpy())
        return pd.DataFrame([[pdf[by].iloc[0], pdf["chunk"].iloc[0], *a[-1], *b[-1]]], columns=[by, "chunk", *a_cols, *b_cols])

    chunks = stored(d.select(by, "chunk", order, *a_cols, *b_cols).groupBy(by, "chunk").applyInPandas(whole, f"`{by}` {kind}, chunk long, " + ", ".join(f"{c} double" for c in [*a_cols, *b_cols])))
    starts = stored(_starts(chunks, names, by, levels)).withColumnRenamed(by, "_by").withColumnRenamed("chunk", "_chunk")
    both = d.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("chunk") == F.col("_chunk"))).drop("_by", "_chunk")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` double" for n in names])
    own = df.columns

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, b = compose(pdf[a_cols].to_numpy(), pdf[b_cols].to_numpy())
        y = applied(a, b, pdf[s_cols].iloc[0].to_numpy(float))
        made = pd.DataFrame(y, columns=names, index=pdf.index)
        return pd.concat([pdf[own], made], axis=1)

    done = both.groupBy(by, "chunk").applyInPandas(along, schema)
    return done.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def smooth(x: Column, alpha: float, starts: Column) -> tuple[Column, Column]:
    """The map of an exponential mean that starts with its first value."""
    return F.when(starts, 0.0).otherwise(1 - alpha), F.when(starts, x).otherwise(alpha * x)


def weighted(x: Column, alpha: float, starts: Column) -> tuple[Column, Column]:
    """The map of the numerator (x) or denominator (1) of an adjusted exponential mean."""
    return F.when(starts, 0.0).otherwise(1 - alpha), x


def added(x: Column, starts: Column) -> tuple[Column, Column]:
    """The map of a running sum."""
    return F.when(starts, 0.0).otherwise(1.0), x


def _span(n: int) -> float:
    return 2 / (n + 1)


def chunked_features(bars: DataFrame, width: int, by: str = "symbol", order: str = "t", levels: int = LEVELS) -> DataFrame:
    """The recursive features of bars (by, order, open, high, low, close, volume) in three scans over chunks of ``width`` units of time.

    EMA with crosses, RSI, MACD, ATR, ADX, OBV with its mean, KAMA with slope and cross, the momentum score and the directional index
    of smoothed moves. Means with a least number of rows are null before it; ``atr_14`` is 0 there.
    """
    w, c = inside(by, order), F.col
    lag = lambda x, k: F.lag(x, k).over(w)
    d = overlap(with_chunks(bars.select(by, order, "open", "high", "low", "close", "volume"), order, width), 20, by, order)
    d = d.withColumns({"p": lag("close", 1), "pp": lag("close", 2), "ph": lag("high", 1), "pl": lag("low", 1)})
    d = d.withColumn("move", F.abs(c("close") - c("p")))
    d = d.withColumns({
        "total": F.when(F.count("move").over(w.rowsBetween(-9, 0)) == 10, F.sum("move").over(w.rowsBetween(-9, 0))), "shift": F.abs(c("close") - lag("close", 10)),
        "r4": ratio(c("close"), lag("close", 4)) - 1, "r9": ratio(c("close"), lag("close", 9)) - 1, "r19": ratio(c("close"), lag("close", 19)) - 1,
        "mean_volume": F.avg("volume").over(w.rowsBetween(-19, 0)),
    }).filter("NOT context").drop("context", "open")
    first, second = c("p").isNull(), c("p").isNotNull() & c("pp").isNull()
    up, down = F.coalesce(c("high") - c("ph"), F.lit(0.0)), F.coalesce(c("pl") - c("low"), F.lit(0.0))
    gain, loss = F.greatest(c("close") - c("p"), F.lit(0.0)), F.greatest(c("p") - c("close"), F.lit(0.0))
    tr = F.coalesce(F.greatest(c("high") - c("low"), F.abs(c("high") - c("p")), F.abs(c("low") - c("p"))), c("high") - c("low"))
    signed = F.when(c("close") < c("p"), -c("volume")).otherwise(c("volume"))
    d = d.withColumns({"tr": tr, "up": F.when((up > down) & (up > 0), up).otherwise(0.0), "down": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    maps: Maps = {"n": added(F.lit(1.0), first), "tr_sum": added(c("tr"), first), "obv": added(signed, first)}
    maps |= {f"e{n}": smooth(c("close"), _span(n), first) for n in (9, 12, 21, 26, 50, 200)}
    maps |= {f"{k}{n}": smooth(x, 1 / n, second) for n in (7, 14, 21) for k, x in (("gain", F.when(~first, gain)), ("loss", F.when(~first, loss)))}
    maps |= {"plus": smooth(c("up"), 1 / 14, first), "minus": smooth(c("down"), 1 / 14, first), "range_mean": smooth(c("tr"), 1 / 14, first)}
    maps |= {f"own_{k}": smooth(F.when(~first, x), 1 / 14, second) for k, x in (("plus", c("up")), ("minus", c("down")), ("range", c("tr")))}
    maps |= {f"{k}{n}": weighted(x, _span(n), first) for n in (8, 21, 50) for k, x in (("num", c("close")), ("den", F.lit(1.0)))}
    d = affine_scan(d, maps, by, order, levels)
    after = lambda n, x: F.when(c("n") >= n, x)
    d = d.withColumns({f"ema_{n}": after(n, c(f"e{n}")) for n in (9, 21, 50, 200)})
    d = d.withColumns({f"rsi_{n}": after(n + 1, F.when(c(f"loss{n}") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(c(f"gain{n}"), c(f"loss{n}"))))) for n in (7, 14, 21)})
    d = d.withColumns({
        "macd": after(26, c("e12") - c("e26")), "di_plus": 100 * ratio(c("plus"), F.when(c("range_mean") > 0, c("range_mean"))), "di_minus": 100 * ratio(c("minus"), F.when(c("range_mean") > 0, c("range_mean"))),
        "own_di_plus": 100 * c("own_plus") / (c("own_range") + 1e-10), "own_di_minus": 100 * c("own_minus") / (c("own_range") + 1e-10),
        "pace": let(c("shift") / (c("total") + 1e-10), lambda er: F.pow(er * (2 / 3 - 2 / 31) + 2 / 31, 2)),
    })
    both = c("di_plus") + c("di_minus")
    dx = F.coalesce(100 * ratio(F.abs(c("di_plus") - c("di_minus")), F.when(both > 0, both)), F.lit(0.0))
    own_dx = 100 * F.abs(c("own_di_plus") - c("own_di_minus")) / (c("own_di_plus") + c("own_di_minus") + 1e-10)
    d = affine_scan(d, {
        "signal": smooth(c("macd"), _span(9), c("n") == 26), "adx": smooth(dx, 1 / 14, c("n") == 1), "own_adx": smooth(own_dx, 1 / 14, c("n") == 2),
        "atr": (F.when(c("n") == 14, 0.0).when(c("n") > 14, 13 / 14), F.when(c("n") == 14, c("tr_sum") / 14).otherwise(c("tr") / 14)),
        "obv_num": weighted(c("obv"), _span(20), c("n") == 1), "obv_den": weighted(F.lit(1.0), _span(20), c("n") == 1),
        "kama": (F.when(c("n") == 11, 0.0).when(c("n") > 11, 1 - c("pace")), F.when(c("n") == 11, c("close")).otherwise(c("pace") * c("close"))),
    }, by, order, levels)
    near = c("close") + 1e-10
    d = overlap(d, 5, by, order).withColumn("kama_5", F.lag("kama", 5).over(w)).filter("NOT context").drop("context")
    score = 10 * 0.3 * ratio(c("num8") / c("den8") - c("num21") / c("den21"), c("num21") / c("den21")) + 5 * 0.3 * c("r4") + 3 * 0.2 * c("r9") + 2 * 0.2 * c("r19")
    spike = c("volume") / (c("mean_volume") + 1e-10)
    score = F.when(c("n") >= 30, score * F.when(spike > 1.5, 1 + F.least((spike - 1.5) * 0.3, F.lit(0.5))).otherwise(1.0)).otherwise(0.0)
    d = d.withColumns({"macd_signal": after(34, c("signal")), "atr_14": F.coalesce(c("atr"), F.lit(0.0)), "momentum": score})
    lean = F.when(c("momentum") > 0.1, "long").when(c("momentum") < -0.1, "short").otherwise("neutral")
    trend = c("num50") / c("den50")
    return d.select(
        by, order, *[f"ema_{n}" for n in (9, 21, 50, 200)], ((c("ema_9") - c("ema_21")) / F.nullif(c("close"), F.lit(0.0))).alias("ema_cross_short"), ((c("ema_50") - c("ema_200")) / F.nullif(c("close"), F.lit(0.0))).alias("ema_cross_long"),
        *[f"rsi_{n}" for n in (7, 14, 21)], "macd", "macd_signal", (c("macd") - c("macd_signal")).alias("macd_hist"), "atr_14", ratio(c("atr_14"), c("close")).alias("atr_pct"),
        "di_plus", "di_minus", "adx", "obv", (c("obv_num") / c("obv_den")).alias("obv_ema"), "kama", ((c("kama") - c("kama_5")) / near).alias("kama_slope"), ((c("close") - c("kama")) / near).alias("kama_cross"),
        "momentum", lean.alias("momentum_direction"), F.coalesce(((lean == "long") & (c("close") > trend)) | ((lean == "short") & (c("close") < trend)), F.lit(False)).alias("trend_aligned"), "own_adx",
    )


def chunked_hurst(bars: DataFrame, width: int, n: int = 64, by: str = "symbol", order: str = "t") -> DataFrame:
    """by, order and hurst over the n log returns before a bar, chunk by chunk with n + 1 rows of context."""
    d = overlap(with_chunks(bars.select(by, order, "close"), order, width), n + 1, by, order)
    kind = f"`{by}` {d.schema[by].dataType.simpleString()}, `{order}` {d.schema[order].dataType.simpleString()}, hurst double"

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pdf["hurst"] = hurst(pdf.close.to_numpy(float), n)
        return pdf.loc[~pdf.context, [by, order, "hurst"]]

    return d.groupBy(by, "chunk").applyInPandas(along, kind)


def even_width(span: int, chunks: int) -> int:
    """A chunk width that cuts a span of time into about so many chunks."""
    return max(1, ceil(span / chunks))
