"""Leakage-safe cross-validation splits: fold tables and membership as predicates on a row number."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """Half-open bounds of k contiguous folds; the first n % k have one row more."""
    size, extra = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        end = at + size + (i < extra)
        out.append((at, end))
        at = end
    return out


def number_rows(rows: DataFrame, order: str, tie: str, name: str = "rn") -> DataFrame:
    """Consecutive numbers from 0 in the order of ``order``, then ``tie``, without sorting all rows in one task.

    Rows are counted for each value of ``order``; the running sum runs over those counts only.
    """
    n = rows.groupBy(order).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(order).orderBy(tie)) - 1
    return rows.join(n, order).withColumn(name, F.col("_before") + inside).drop("_before")


def purged_folds(rows: DataFrame, rn: str, n: int, k: int = 5, embargo: float = 0.01, purge: int = 12) -> DataFrame:
    """fold, row number and role (train, test) of contiguous test folds: training rows within ``purge`` rows before a test
    fold, or in the embargo after it, are left out."""
    gap = int(n * embargo)
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(fold_bounds(n, k))])
    d = rows.select(rn, F.explode(folds).alias("f"))
    r, a, b = F.col(rn), F.col("f.a"), F.col("f.b")
    role = F.when((r >= a) & (r < b), "test").when((r < a - purge) | (r >= b + gap + purge), "train")
    return d.select(rn, F.col("f.fold").alias("fold"), role.alias("role")).filter("role IS NOT NULL")


def combinatorial_folds(rows: DataFrame, rn: str, n: int, k: int = 6, tests: int = 2, embargo: float = 0.01) -> DataFrame:
    """The same for all combinations of ``tests`` of k folds; the embargo follows each test fold."""
    gap, bounds = int(n * embargo), fold_bounds(n, k)
    parts = []
    for i, combo in enumerate(combinations(range(k), tests)):
        parts.append(F.struct(F.lit(i).alias("combo"), F.array(*[F.struct(F.lit(bounds[j][0]).alias("a"), F.lit(bounds[j][1]).alias("b")) for j in combo]).alias("t")))
    d = rows.select(rn, F.explode(F.array(*parts)).alias("f"))
    r = F.col(rn)

    def inside(t: Column, extra: int) -> Column:
        return F.exists(t, lambda x: (r >= x["a"]) & (r < x["b"] + extra))

    role = F.when(inside(F.col("f.t"), 0), "test").when(~inside(F.col("f.t"), gap), "train")
    return d.select(rn, F.col("f.combo").alias("combo"), role.alias("role")).filter("role IS NOT NULL")


def walk_forward(rows: DataFrame, rn: str, n: int, k: int = 5, gap: int = 12) -> DataFrame:
    """Expanding training windows, each followed by a test block; the last ``gap`` training rows are dropped."""
    size = n // (k + 1)
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(n - (k - i) * size).alias("a")) for i in range(k)])
    d = rows.select(rn, F.explode(folds).alias("f"))
    r, a = F.col(rn), F.col("f.a")
    role = F.when((r >= a) & (r < a + size), "test").when(r < a - gap, "train")
    return d.select(rn, F.col("f.fold").alias("fold"), role.alias("role")).filter("role IS NOT NULL")


def path_table(k: int = 6, tests: int = 2) -> list[tuple[int, int, int]]:
    """(path, fold, combo): the combinations that test a fold, in order, go to paths 0, 1, ...; so each path has each fold once."""
    seen = [0] * k
    out = []
    for i, combo in enumerate(combinations(range(k), tests)):
        for j in combo:
            out.append((seen[j], j, i))
            seen[j] += 1
    return out


def backtest_paths(rows: DataFrame, rn: str, n: int, k: int = 6, tests: int = 2) -> DataFrame:
    """Every row once for each back-test path, with its fold and the combination whose model tests it there: path, fold, combo.

    There are as many paths as combinations that test one fold. ``combo`` counts as in ``combinatorial_folds``.
    """
    bounds = fold_bounds(n, k)
    parts = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(j).alias("fold"), F.lit(i).alias("combo"), F.lit(bounds[j][0]).alias("a"), F.lit(bounds[j][1]).alias("b")) for p, j, i in path_table(k, tests)])
    mine = F.filter(parts, lambda x: (F.col(rn) >= x["a"]) & (F.col(rn) < x["b"]))
    d = rows.withColumn("_f", F.explode(mine))
    return d.select(*rows.columns, *[F.col(f"_f.{c}").alias(c) for c in ("path", "fold", "combo")])


def path_returns(paths: DataFrame, value: str, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """n, mean, sd (sample) and sharpe of a value along each path; sharpe is null where nothing varies."""
    d = paths.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return d.withColumn("sharpe", F.try_divide(F.col("mean"), F.col("sd")))


#: Leading bits of a draw by which rows are counted before any is chosen.
DRAW_BITS = 16


def draw(key: Column, seed: int = 42) -> Column:
    """A number below 2^60 that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def exact_sample(rows: DataFrame, size: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows (all, if there are fewer), those of the smallest draws of ``key``; the same ones however rows are dealt.

    Rows are counted by the leading bits of their draws: that table of at most 2^16 counts gives the bucket in which the last row lies.
    Buckets before it are taken whole, and only the rows of that one are put in order. Order among the rows is that of their own columns.
    Rows with equal keys have equal draws; which of them is left out at the edge is not fixed.
    """
    d = rows.withColumn("_draw", draw(F.col(key), seed))
    bucket = F.shiftright("_draw", 60 - DRAW_BITS)
    counts = d.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("_before", before).filter((F.col("_before") < size) & (F.col("_before") + F.col("_n") >= size)).head()
    if edge is None:
        return rows if size > 0 else rows.limit(0)
    whole = d.filter(bucket < edge["_b"])
    last = d.filter(bucket == edge["_b"]).orderBy("_draw", key).limit(size - edge["_before"])
    return whole.unionByName(last).drop("_draw")
