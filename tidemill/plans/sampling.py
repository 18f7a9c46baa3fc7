"""Queries of back-test paths and exact samples. They join the registry of ``market``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits as SP
from ..sources import tables as S
from .market import RECORDS, _r, out, query

FOLDS = """fo AS (SELECT unnest(range(6)) AS i), nn AS (SELECT count(*) AS n FROM events), bo AS (SELECT i, i * (n // 6) + least(i, n % 6) AS a, (i + 1) * (n // 6) + least(i + 1, n % 6) AS b FROM fo, nn),
co AS (SELECT x.i AS i1, y.i AS i2, row_number() OVER (ORDER BY x.i, y.i) - 1 AS combo FROM fo x JOIN fo y ON x.i < y.i),
pa AS (SELECT i AS fold, combo, row_number() OVER (PARTITION BY i ORDER BY combo) - 1 AS path FROM fo JOIN co ON i = i1 OR i = i2)"""


@query(f"""WITH {FOLDS} SELECT event_id AS rn, path, fold, combo FROM events JOIN bo ON event_id >= a AND event_id < b JOIN pa ON fold = i""")
def backtest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every event on each of the five paths of six folds, two of them tested at a time."""
    e = S.load(spark, d, "events").select(F.col("event_id").alias("rn"))
    return SP.backtest_paths(e, "rn", e.count()).select("rn", *[F.col(c).cast("long").alias(c) for c in ("path", "fold", "combo")])


@query(f"""{RECORDS}, {FOLDS}, x AS (SELECT path, fold, combo, signal * ret AS v FROM records JOIN bo ON id >= a AND id < b JOIN pa ON fold = i WHERE ret IS NOT NULL AND combo % 2 = 0),
y AS (SELECT path, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM x GROUP BY 1) SELECT path, n, {_r('mean sd')}, round(mean / nullif(sd, 0), 6) AS sharpe FROM y""")
def path_returns(spark: SparkSession, d: str) -> DataFrame:
    """Result of following the signal along each path, while the model of an even combination is in charge."""
    n = S.load(spark, d, "events").count()
    p = SP.backtest_paths(S.records(spark, d).withColumnRenamed("id", "rn"), "rn", n).filter("ret IS NOT NULL AND combo % 2 = 0")
    x = SP.path_returns(p.withColumn("v", F.col("signal") * F.col("ret")), "v")
    return out(x.withColumn("path", F.col("path").cast("long")), "path n", "mean sd sharpe")


@query("""WITH x AS (SELECT event_id, event_type, value, CAST('0x' || substr(md5('42:' || event_id), 1, 15) AS BIGINT) AS draw FROM events) SELECT event_id, event_type, value FROM x ORDER BY draw, event_id LIMIT 700""")
def exact_sample(spark: SparkSession, d: str) -> DataFrame:
    """Seven hundred events by the draws of their ids (a sampling operator: its size is the feature)."""
    return SP.exact_sample(S.load(spark, d, "events").select("event_id", "event_type", "value"), 700, "event_id")
