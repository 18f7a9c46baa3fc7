"""A stored bank of patterns: signatures of bars, normalised and unit-long, with inverted lists for retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import ROWS, best_in_groups, usable

#: The features of a signature, in order (fixed values).
SIGNATURE = (
    "returns_1", "returns_5", "returns_20", "atr_pct", "bb_pct", "bb_width", "rsi_14", "rsi_7", "rsi_21", "macd_hist",
    "stoch_k", "stoch_d", "vol_ratio", "vol_std", "hour_sin", "hour_cos",
)
#: Bars ahead whose returns a pattern carries; rows without the later one are no patterns yet.
SHORT, LONG = 12, 48
#: Rows that the lists are fitted on at most; every row is in a list.
SAMPLE_ROWS = 20_000


def signature(df: DataFrame, features: tuple[str, ...] = SIGNATURE) -> Column:
    """The features as one array; missing columns, nulls, NaN and infinities are 0."""
    have = {c.lower() for c in df.columns}
    x = lambda c: F.col(c).cast("double")
    return F.array(*[F.when(x(c).isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")), x(c)).otherwise(0.0) if c.lower() in have else F.lit(0.0) for c in features])


def patterns(bars: DataFrame, by: str = "symbol", order: str = "t", features: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """by, order, vector, and the returns fwd_short and fwd_long after it (null where the bars end before)."""
    w = Window.partitionBy(by).orderBy(order)
    ahead = lambda n: F.lead("close", n).over(w) / F.nullif(F.col("close").cast("double"), F.lit(0.0)) - 1
    return bars.select(by, order, signature(bars, features).alias("vector"), ahead(SHORT).alias("fwd_short"), ahead(LONG).alias("fwd_long"), (F.lead("close", LONG).over(w).isNotNull()).alias("known"))


def normalising(known: DataFrame, by: str = "symbol") -> DataFrame:
    """by, mean and sd (population, plus 1e-8) of each entry of the vectors, as arrays: one row a group."""
    each = known.select(by, F.posexplode("vector").alias("at", "x")).groupBy(by, "at").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-8).alias("sd"), F.count(F.lit(1)).alias("n"))
    rows = F.sort_array(F.collect_list(F.struct("at", "mean", "sd")))
    return each.groupBy(by).agg(rows.alias("r"), F.max("n").alias("n")).select(by, "n", F.col("r.mean").alias("mean"), F.col("r.sd").alias("sd"))


def unit(vector: Column, mean: Column, sd: Column) -> Column:
    """The normalised vector at length 1."""
    z = F.transform(F.arrays_zip(vector.alias("x"), mean.alias("m"), sd.alias("s")), lambda e: (e["x"] - e["m"]) / e["s"])
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + 1e-8
    return F.transform(F.array(z), lambda v: F.transform(v, lambda x: x / norm(v)))[0]


def normalised(rows: DataFrame, stats: DataFrame, by: str = "symbol") -> DataFrame:
    """Rows (by, vector) with ``v``, the vector by the figures of its group; rows of unknown groups go."""
    s = stats.select(F.col(by).alias("_by"), "mean", "sd")
    return rows.join(s, F.col(by).eqNullSafe(F.col("_by"))).withColumn("v", unit(F.col("vector"), F.col("mean"), F.col("sd"))).drop("_by", "mean", "sd")


def fit_lists(rows: DataFrame, lists: int, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> np.ndarray:
    """Centres of the lists, from the rows (id, v) of the smallest hashes, at most ``sample_rows`` of them."""
    few = usable(rows, "v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).select(array_to_vector(F.col("v")).alias("features"))
    if few.isEmpty():
        return np.zeros((1, 1))
    return np.array(KMeans(k=lists, seed=seed, maxIter=20).fit(few).clusterCenters())


def in_lists(batches: Iterator[pa.RecordBatch], centres: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches (``v`` and others), each for the ``probes`` lists next to it, with ``list``; written a few rows at a time."""
    half, take = (centres**2).sum(axis=1) / 2, min(probes, len(centres))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            closeness = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1) @ centres.T - half
            top = np.argsort(-closeness, axis=1, kind="stable")[:, :take]
            out = part.take(pa.array(np.repeat(np.arange(part.num_rows), take)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(top.ravel().astype(np.int32))], names=[*part.schema.names, "list"])


def probed(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """A row for each of the ``probes`` lists whose centres are next to the row's ``v``, with ``list``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return usable(rows, "v").filter(F.size("v") == centres.shape[1]).mapInArrow(partial(in_lists, centres=centres, probes=probes), f"{schema}, list int")


def build(found: DataFrame, path: str, lists: int = 16, by: str = "symbol", order: str = "t", least: int = 148, sample_rows: int = SAMPLE_ROWS, normalise: bool = True) -> None:
    """Store the patterns of ``patterns`` whose later return is known: normalising figures, centres, and the vectors by list.

    Groups of fewer than ``least`` bars are left out. Ids are hashes of group and time. Without ``normalise`` vectors are only made unit-long,
    so similarities are those of the vectors as they are.
    """
    spark = found.sparkSession
    enough = found.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(F.col(by).alias("_by"))
    known = found.filter("known").join(enough, F.col(by).eqNullSafe(F.col("_by")), "left_semi").drop("known").withColumn("id", F.xxhash64(by, order))
    as_is = known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("_d")).select(by, "n", F.array_repeat(F.lit(0.0), F.col("_d")).alias("mean"), F.array_repeat(F.lit(1.0), F.col("_d")).alias("sd"))
    (normalising(known, by) if normalise else as_is).write.mode("overwrite").parquet(f"{path}/stats")
    rows = normalised(known, spark.read.parquet(f"{path}/stats"), by)
    centres = fit_lists(rows, lists, sample_rows)
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    probed(rows.drop("vector"), centres, 1).repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 100, probes: int | None = None, by: str = "symbol") -> DataFrame:
    """query, neighbour, similarity, rank of the stored patterns of a query's group, in its ``probes`` nearest lists (None: all, exact).

    ``queries``: query, by, vector. The centres, one row a list, are all that comes to the driver.
    """
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()])
    q = normalised(queries.select("query", by, "vector"), spark.read.parquet(f"{path}/stats"), by).drop("vector")
    on = F.coalesce(F.col(by).cast("string"), F.lit("")).alias("_g")
    q = probed(q, centres, probes or len(centres)).select("query", "v", "list", on)
    b = spark.read.parquet(f"{path}/vectors").select("id", "v", "list", on)
    return best_in_groups(b, q, k, ["list", "_g"])


def outlook(spark: SparkSession, path: str, found: DataFrame, least: int = 30) -> DataFrame:
    """What followed the neighbours of each query: n, means, medians, deviations and win rates of both returns, similarity, confidence,
    direction and signal. Queries with fewer than ``least`` neighbours are left out."""
    v = spark.read.parquet(f"{path}/vectors").select(F.col("id").alias("neighbour"), "fwd_short", "fwd_long")
    d = found.join(v, "neighbour").groupBy("query").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fwd_short").alias("mean_short"), F.median("fwd_short").alias("median_short"), F.stddev_pop("fwd_short").alias("sd_short"), F.avg((F.col("fwd_short") > 0).cast("int")).alias("wins_short"),
        F.avg("fwd_long").alias("mean_long"), F.avg((F.col("fwd_long") > 0).cast("int")).alias("wins_long"), F.max("similarity").alias("nearest"), F.avg("similarity").alias("similarity"),
    ).filter(F.col("n") >= least)
    m = F.col("mean_short")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(m) / (F.col("sd_short") + 1e-4) * F.col("similarity")))
    return d.withColumns({"confidence": sure, "direction": F.when(m > 0.001, "long").when(m < -0.001, "short").otherwise("neutral"), "signal": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m / 0.01))})


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k most similar neighbours (query, neighbour, similarity) of each query, with their rank; of equal ones the lower id first."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact neighbours that were found."""
    hit = exact.join(found.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
