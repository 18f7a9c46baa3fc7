"""As-of joins: for each left row the latest right row that is not after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, inclusive: bool = True, tolerance: int | None = None, prefix: str = "right_") -> DataFrame:
    """Left rows with the columns of the latest right row at or before ``on`` (before it, if not inclusive).

    Both sides are tagged and united, and one ordered window carries the last right row forward: one shuffle on the
    key and no pair of rows is ever compared. Right columns get the prefix; without a match, or beyond the tolerance,
    they are null. Ties among right rows: any one of the largest.
    """
    by = by or []
    keys = [F.col(c) for c in by] or [F.lit(0)]
    own = [c for c in right.columns if c not in by]
    l = left.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.col(on).alias("_on"), F.lit(1 if inclusive else -1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*own)).schema[0].dataType).alias("_r"))  # noqa: E741
    r = right.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.col(on).alias("_on"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*own).alias("_r"))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_on", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter("_l IS NOT NULL")
    if tolerance is not None:
        both = both.withColumn("_m", F.when(F.col("_on") - F.col(f"_m.{on}") <= tolerance, F.col("_m")))
    return both.select("_l.*", *[F.col(f"_m.{c}").alias(f"{prefix}{c}") for c in own])
