"""Ordered windows over (symbol, t), with the rule that a window is null until it is full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(key: str = "symbol", order: str = "t") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last(n: int, key: str = "symbol", order: str = "t") -> WindowSpec:
    """The last n rows, the current one included."""
    return ordered(key, order).rowsBetween(-(n - 1), 0)


def before(n: int, key: str = "symbol", order: str = "t") -> WindowSpec:
    """The n rows before the current one."""
    return ordered(key, order).rowsBetween(-n, -1)


def so_far(key: str = "symbol", order: str = "t") -> WindowSpec:
    return ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)


def full(n: int, counted: Column, value: Column, w: WindowSpec | None = None) -> Column:
    """``value`` over the last n rows, null unless all n have a non-null ``counted``."""
    w = w or last(n)
    return F.when(F.count(counted).over(w) == n, value.over(w))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def lagged(c: str, k: int, key: str = "symbol", order: str = "t") -> Column:
    return F.lag(c, k).over(ordered(key, order))


def change(c: str, k: int) -> Column:
    """Relative change over k rows."""
    return ratio(F.col(c), lagged(c, k)) - 1


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def scrub(x: Column) -> Column:
    """Null, NaN and infinities as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def corr(x: Column | str, y: Column | str, w: WindowSpec | None = None) -> Column:
    """Correlation over a group or a window; null where a side does not vary (the built-in raises there in ANSI mode)."""
    parts = [F.covar_pop(x, y), F.stddev_pop(F.when(_col(y).isNotNull(), _col(x))), F.stddev_pop(F.when(_col(x).isNotNull(), _col(y)))]
    cov, sx, sy = parts if w is None else [p.over(w) for p in parts]
    return F.try_divide(cov, sx * sy)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
