"""The paged source: pushed filters, incremental refreshes, streams."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.sources import pages as P

BARS = "symbol string, t long, open double, high double, low double, close double, volume double"


def bars(spark, symbols, times):
    return spark.createDataFrame([(s, t, 1.0, 2.0, 0.5, float(t), 3.0) for s in symbols for t in times], BARS)


@pytest.fixture()
def folder(spark, tmp_path):
    path = str(tmp_path / "pages")
    P.write_pages(bars(spark, ["a/b", "c d", "é"], range(0, 2_000, 7)), path)
    return path


def test_filters_choose_pages(folder):
    every = P.PageReader({"path": folder})
    assert sum(len(p.pages) for p in every.partitions()) == 27
    r = P.PageReader({"path": folder, "after": json.dumps({"c d": 1_000})})
    left = list(r.pushFilters([P.In(("symbol",), ("c d", "é")), P.GreaterThan(("t",), 500), P.LessThanOrEqual(("t",), 1_100), P.EqualTo(("close",), 1.0), P.IsNotNull(("t",))]))
    assert [type(f).__name__ for f in left] == ["EqualTo"]
    got = {p.symbol: (len(p.pages), p.low, p.high) for p in r.partitions()}
    assert got == {"c d": (1, 1_001, 1_100), "é": (3, 501, 1_100)}
    assert list(P.PageReader({"path": folder + "-none"}).partitions()) == []


def test_rows_and_pushed_filters(spark, folder):
    d = P.read_pages(spark, folder)
    assert d.count() == 3 * 286 and sorted(r.symbol for r in d.select("symbol").distinct().collect()) == ["a/b", "c d", "é"]
    some = d.filter("symbol = 'é' AND t BETWEEN 300 AND 600 AND close > 400")
    assert sorted(r.t for r in some.collect()) == [t for t in range(0, 2_000, 7) if 400 < t <= 600]
    assert some.rdd.getNumPartitions() == 1
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "symbol#" in plan and "(t#" not in plan.split("BatchScan")[0]


def test_refresh_reads_only_what_is_new(spark, tmp_path):
    path, cache = str(tmp_path / "pages"), str(tmp_path / "cache")
    P.write_pages(bars(spark, ["a", "b"], range(0, 500)), path)
    assert P.refresh(spark, path, cache) == 1
    P.write_pages(bars(spark, ["a"], range(480, 700)), path)  # the page of 480 to 719 gets more bars, some again
    P.write_pages(bars(spark, ["c"], range(10)), path)
    reader = P.PageReader({"path": path, "after": json.dumps({"a": 499, "b": 499})})
    assert {p.symbol: len(p.pages) for p in reader.partitions()} == {"a": 1, "b": 1, "c": 1}
    assert P.refresh(spark, path, cache) == 2 and P.refresh(spark, path, cache) == 3
    got = P.cached(spark, cache)
    assert got.count() == got.select("symbol", "t").distinct().count() == 700 + 500 + 10
    by = {(r.symbol, r.refresh): (r.n, r.a) for r in got.groupBy("symbol", "refresh").agg(F.count("t").alias("n"), F.min("t").alias("a")).collect()}
    assert by == {("a", 1): (500, 0), ("b", 1): (500, 0), ("a", 2): (200, 500), ("c", 2): (10, 0)}


def test_a_broken_refresh_is_done_again(spark, tmp_path):
    path, cache = str(tmp_path / "pages"), str(tmp_path / "cache")
    P.write_pages(bars(spark, ["a"], range(300)), path)
    P.refresh(spark, path, cache)
    (tmp_path / "cache" / "part=2").mkdir()
    P.write_pages(bars(spark, ["a"], range(300, 310)), path)
    assert P.refresh(spark, path, cache) == 2 and P.cached(spark, cache).count() == 310


def test_stream_of_pages(spark, tmp_path):
    path, out = str(tmp_path / "pages"), str(tmp_path / "out")
    P.register(spark)

    def run(sealed):
        stream = spark.readStream.format("paged_bars").option("sealed", sealed).load(path)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(once=True).start()
        q.awaitTermination()
        return sorted((r.symbol, r.t) for r in spark.read.schema(BARS).parquet(out).collect())

    P.write_pages(bars(spark, ["a"], range(0, 500)), path)
    assert run("false") == [("a", t) for t in range(480)]  # the page of 480 to 719 is open
    P.write_pages(bars(spark, ["a"], range(500, 730)), path)
    P.write_pages(bars(spark, ["b"], range(5)), path)
    assert run("false") == [("a", t) for t in range(720)]
    assert run("true") == [("a", t) for t in range(730)] + [("b", t) for t in range(5)]
