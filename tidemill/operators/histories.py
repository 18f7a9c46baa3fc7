"""Stored histories that keep the newest records of each key, and nested snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import asof_join


def newest(rows: DataFrame, by: list[str], order: list[str], keep: int = 500) -> DataFrame:
    """The ``keep`` newest rows of each key, by the ordering columns."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= keep).drop("_place")


def append(batch: DataFrame, number: int, path: str, by: list[str], order: list[str], keep: int = 500) -> None:
    """Store a numbered batch; one that comes again replaces itself. A batch that is stored holds at most ``keep`` rows a key."""
    newest(batch, by, order, keep).write.mode("overwrite").parquet(f"{path}/batch={number}")


def appender(path: str, by: list[str], order: list[str], keep: int = 500) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: batches that a stream repeats after a failure change nothing."""
    return lambda batch, number: append(batch, number, path, by, order, keep)


def history(spark: SparkSession, path: str, schema: str, by: list[str], order: list[str], keep: int = 500) -> DataFrame:
    """The newest ``keep`` records of each key in all batches. Times that differ in batch only are told apart by the batch, later wins."""
    rows = spark.read.schema(schema).parquet(f"{path}/batch=*").withColumn("_batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long"))
    return newest(rows, by, [*order, "_batch"], keep).drop("_batch")


def compact(spark: SparkSession, path: str, to: str, schema: str, by: list[str], order: list[str], keep: int = 500) -> None:
    """Write the history as the first batch of another folder, so that dropped records no longer take space."""
    history(spark, path, schema, by, order, keep).write.mode("overwrite").parquet(f"{to}/batch=0")


def upsert_snapshots(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "t")) -> DataFrame:
    """The snapshots of both sides; of equal keys the new one, its arrays and all. Missing figures are 0, a missing direction is neutral,
    missing arrays are empty; of repeated keys on one side any one stays."""
    values = [c for c in new.columns if c not in keys]
    kinds = dict(new.dtypes)
    filled = {c: F.coalesce(c, F.array().cast(k)) if k.startswith("array") else F.coalesce(c, F.lit("neutral" if c == "direction" else "")) if k == "string" else F.coalesce(c, F.lit(0).cast(k)) for c, k in kinds.items() if c not in keys}
    both = stored.select(*keys, F.struct(F.lit(0).alias("_new"), *values).alias("s")).unionByName(new.withColumns(filled).select(*keys, F.struct(F.lit(1).alias("_new"), *values).alias("s")))
    return both.groupBy(*keys).agg(F.max_by("s", "s._new").alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in values])


def one_hot(snapshots: DataFrame, values: tuple[str, ...] = ("bullish", "bearish"), column: str = "direction") -> DataFrame:
    """A column ``is_x`` of 0 and 1 for each value, in place of the column."""
    return snapshots.withColumns({f"is_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values}).drop(column)


def expected(scenarios: Column) -> Column:
    """The probable value of an array of (label, probability, value)."""
    return F.aggregate(F.coalesce(scenarios, F.array().cast("array<struct<label:string,probability:double,value:double>>")), F.lit(0.0), lambda s, x: s + x["probability"] * x["value"])


def gated_join(bars: DataFrame, snapshots: DataFrame, by: str = "symbol", order: str = "t", least: int = 50, prefix: str = "ext_") -> DataFrame:
    """Bars with the figures of the latest snapshot that is not after them, for keys with at least ``least`` snapshots; else, and before
    the first one, 0."""
    enough = snapshots.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(F.col(by).alias("_by"))
    known = snapshots.join(enough, F.col(by).eqNullSafe(F.col("_by")), "left_semi")
    figures = [c for c, k in snapshots.dtypes if k in ("double", "float", "int", "bigint") and c not in (by, order)]
    joined = asof_join(bars, known.select(by, order, *figures), order, [by], prefix=prefix)
    return joined.drop(f"{prefix}{order}").withColumns({f"{prefix}{c}": F.coalesce(f"{prefix}{c}", F.lit(0.0)) for c in figures})
