"""Back-test paths and exact samples."""

import hashlib
from collections import Counter
from math import comb

import pytest

from tidemill.operators import splits as SP


@pytest.mark.parametrize("k,tests", [(6, 2), (5, 3), (4, 1)])
def test_each_path_covers_each_row_once(spark, k, tests):
    n = 103
    got = [tuple(r) for r in SP.backtest_paths(spark.range(n).withColumnRenamed("id", "rn"), "rn", n, k, tests).collect()]
    assert Counter((rn, path) for rn, path, _, _ in got) == {(rn, path): 1 for rn in range(n) for path in range(comb(k - 1, tests - 1))}
    tested = {(r.rn, r.combo) for r in SP.combinatorial_folds(spark.range(n).withColumnRenamed("id", "rn"), "rn", n, k, tests, embargo=0.0).filter("role = 'test'").collect()}
    assert {(rn, combo) for rn, _, _, combo in got} == tested and len(got) == len(tested)


@pytest.mark.parametrize("size", [0, 1, 137, 4_999, 5_000, 9_000])
def test_samples_are_exact_and_stable(spark, monkeypatch, size):
    d = spark.range(5_000).selectExpr("id", "id % 7 AS x")
    got = sorted(r.id for r in SP.exact_sample(d.repartition(7), size, "id").collect())
    order = sorted(range(5_000), key=lambda i: (int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:15], 16), i))
    assert got == sorted(order[:size])
    monkeypatch.setattr(SP, "DRAW_BITS", 3)
    assert sorted(r.id for r in SP.exact_sample(d.coalesce(1), size, "id").collect()) == got
    assert sorted(r.id for r in SP.exact_sample(d, size, "id", seed=1).collect()) != got or size in (0, 5_000, 9_000)


def test_equal_and_null_keys(spark):
    d = spark.createDataFrame([(None,), (None,), (3,), (3,), (4,)], "id long")
    assert [SP.exact_sample(d, k, "id").count() for k in range(7)] == [0, 1, 2, 3, 4, 5, 5]
    assert SP.exact_sample(d.limit(0), 3, "id").collect() == []
