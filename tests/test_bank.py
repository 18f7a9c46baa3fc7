"""The pattern bank against plain numpy, and retrieval in blocks and lists against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.operators import bank as B
from tidemill.operators import vectors as V


def cloud(n=600, size=8, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(size=(12, size))[r.integers(0, 12, n)] * 3 + r.normal(size=(n, size))


def unit(x):
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)


@pytest.mark.parametrize("rows,queries", [(1 << 16, 1 << 12), (50, 7)])
def test_nearest_in_blocks(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(V, "BANK_ROWS", rows)
    monkeypatch.setattr(V, "QUERY_ROWS", queries)
    x = cloud(300)
    x[7] = x[8]
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [float("nan")] * 8), (903, [1.0] * 3), (904, [2.0] * 3)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in V.nearest(d, d.filter("vec_id % 20 = 0 OR vec_id IN (7, 903)"), 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.neighbour, r.similarity))
    s = unit(x) @ unit(x).T
    for q in [*range(0, 300, 20), 7]:
        order = sorted((-round(s[q, j], 9), j) for j in range(300) if j != q)[:5]
        assert [n for _, n, _ in sorted(got[q])] == [j for _, j in order]
    assert got[903] == [(1, 904, pytest.approx(1.0))] and set(got) == {*range(0, 300, 20), 7, 903}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path, r = str(tmp_path_factory.mktemp("bank")), np.random.default_rng(2)
    x = cloud(900, len(B.SIGNATURE))
    x[5, 3], x[6, 4] = np.nan, np.inf
    close = np.exp(np.cumsum(r.normal(0, 0.01, 900))) * 50
    rows = [("a" if k < 600 else "b" if k < 850 else "c", k, float(close[k]), *x[k].tolist()) for k in range(900)]
    bars = spark.createDataFrame(rows, "symbol string, t long, close double, " + ", ".join(f"{c} double" for c in B.SIGNATURE)).drop("hour_cos")
    found = B.patterns(bars)
    B.build(found, path, lists=8, sample_rows=300)
    x = np.nan_to_num(x, nan=0.0, posinf=0.0)
    x[:, -1] = 0
    return path, found, x, close


def test_bank_holds_every_known_pattern(spark, stored):
    path, found, x, close = stored
    got = spark.read.parquet(f"{path}/vectors").orderBy("t").collect()
    assert [r.t for r in got] == [*range(552), *range(600, 802)]  # 48 bars at the end are no patterns; c is too short
    for lo, hi, name in ((0, 552, "a"), (600, 802, "b")):
        part = x[lo:hi]
        want = unit((part - part.mean(0)) / (part.std(0) + 1e-8))
        mine = [r for r in got if r.symbol == name]
        assert np.allclose([r.v for r in mine], want)
        assert np.allclose([r.fwd_short for r in mine], close[lo + 12 : hi + 12] / close[lo:hi] - 1) and np.allclose([r.fwd_long for r in mine], close[lo + 48 : hi + 48] / close[lo:hi] - 1)


def test_search_outlook_and_recall(spark, stored):
    path, found, x, close = stored
    q = found.filter("NOT known").select(F.col("t").alias("query"), "symbol", "vector")
    exact = B.search(spark, path, q, 40)
    ids = {r.id: r.t for r in spark.read.parquet(f"{path}/vectors").select("id", "t").collect()}
    got = {}
    for r in exact.collect():
        got.setdefault(r["query"], []).append((r["rank"], ids[r.neighbour], r.similarity))
    assert set(got) == {*range(552, 600), *range(802, 850)}
    for t in (555, 820):
        lo, hi = (0, 552) if t < 600 else (600, 802)
        part = x[lo:hi]
        z = lambda v: unit((v - part.mean(0)) / (part.std(0) + 1e-8))  # noqa: B023, E731
        s = (z(part) @ z(x[t : t + 1]).T).ravel()
        order = np.argsort(-s, kind="stable")[:40] + lo
        assert [n for _, n, _ in sorted(got[t])] == order.tolist()
        look = B.outlook(spark, path, exact).filter(f"query = {t}").first()
        short, longer = close[order + 12] / close[order] - 1, close[order + 48] / close[order] - 1
        assert (look.n, look.mean_short, look.median_short, look.sd_short) == (40, pytest.approx(short.mean()), pytest.approx(np.median(short)), pytest.approx(short.std()))
        assert (look.wins_short, look.wins_long, look.mean_long) == (pytest.approx((short > 0).mean()), pytest.approx((longer > 0).mean()), pytest.approx(longer.mean()))
        assert look.confidence == pytest.approx(min(1, abs(short.mean()) / (short.std() + 1e-4) * np.sort(s)[-40:].mean()))
    some = B.search(spark, path, q, 10, probes=4)
    assert 0.9 <= B.recall(some, B.search(spark, path, q, 10)).head().recall <= 1
    assert B.outlook(spark, path, B.search(spark, path, q, 10)).collect() == []


def test_recall_of_the_index_query(spark):
    from tidemill.plans import patterns

    d = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    exact = V.nearest(e, e.filter("vec_id % 20 = 0"), 10)
    got = patterns.index_search(spark, d).cache()
    assert got.count() == exact.count() and got.filter("query = neighbour").count() == 0
    assert B.recall(got, exact).head().recall >= 0.9
    near = got.join(exact.select("query", "neighbour", F.col("similarity").alias("s")), ["query", "neighbour"])
    assert near.filter("abs(similarity - s) > 1e-6").count() == 0


def test_tops_hold_few_products_and_take_ties_by_id():
    r = np.random.default_rng(4)
    bank = r.permutation(400)
    b = V._unit(np.where((bank % 4 == 0)[:, None], 1.0, r.normal(size=(400, 6))))  # a hundred equal vectors
    q, queries = b[:50], bank[:50]
    s = np.round(q @ b.T, 9)
    want = [(int(i), int(n)) for row, i in zip(s, queries, strict=True) for n in [x for _, x in sorted(zip(-row, bank, strict=True)) if x != i][:7]]
    for products in (1 << 20, 900, 90):
        query, neighbour, similarity, nine = V.tops(queries, q, bank, b, 7, products)
        rank = np.lexsort((neighbour, -nine))
        assert sorted(want) == sorted(zip(query.tolist(), neighbour.tolist(), strict=True))
        assert len(rank) == 350 and np.allclose(similarity * 1e9, nine, atol=1)
    assert [len(x) for x in V.tops(queries, q, bank[:1], b[:1], 7)] == [49] * 4


def test_a_bank_in_order_is_not_copied():
    r = np.random.default_rng(5)
    b, q = r.normal(size=(1 << 14, 64)), r.normal(size=(10, 64))
    tracemalloc.start()
    V.tops(np.arange(10), q, np.arange(100, 100 + len(b)), b, 5, products=1 << 14)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < b.nbytes / 2


def test_rows_of_lists_are_written_in_slices():
    r = np.random.default_rng(6)
    v, centres = r.normal(size=(10_000, 32)), r.normal(size=(16, 32))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v.tolist())], names=["id", "v"])
    before, most, seen = pa.total_allocated_bytes(), 0, []
    for part in B.in_lists(iter([batch]), centres, 12):
        most = max(most, pa.total_allocated_bytes() - before)
        seen.append((part.column("id").to_numpy(), part.column("list").to_numpy()))
        assert part.column("v")[12].as_py() == v[seen[-1][0][12]].tolist()
    assert most < 12 * v.nbytes / 5
    near = np.argsort(((v[:, None] - centres) ** 2).sum(2), axis=1, kind="stable")[:, :12]
    assert (np.concatenate([x[0] for x in seen]) == np.arange(len(v)).repeat(12)).all() and (np.concatenate([x[1] for x in seen]) == near.ravel()).all()


def test_many_equal_vectors_are_neighbours_in_order_of_id(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, -2.0]) for i in range(300)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.neighbour) for r in V.nearest(e, e.filter("vec_id = 100"), 10).collect())
    assert [n for _, n in got] == [i for i in range(300) if i % 3 and i != 100][:10]


def test_long_vectors_meet_in_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ENTRIES", 200)  # blocks of 25 rows of 8 entries
    r = np.random.default_rng(6)
    x = r.normal(size=(240, 8))
    rows = [(i, x[i].tolist(), i % 2) for i in range(240)]
    bank = spark.createDataFrame(rows, "id long, v array<double>, list int")
    queries = spark.createDataFrame(rows[::3], "query long, v array<double>, list int")
    got = V.best_in_groups(bank, queries, 5, ["list"]).collect()
    s = unit(x) @ unit(x).T
    for q in range(0, 240, 3):
        want = [n for n in np.argsort(-s[q], kind="stable").tolist() if n != q and n % 2 == q % 2][:5]
        assert [n for _, n in sorted((g["rank"], g.neighbour) for g in got if g["query"] == q)] == want
