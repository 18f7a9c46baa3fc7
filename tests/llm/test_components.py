import pytest

from tidemill.llm import components

from .helpers import rng

N = 1000


def graphs():
    r = rng(40)
    order = r.sample(range(N), N)
    return {
        "descending": [(i + 1, i) for i in range(N - 1)],
        "random path": list(zip(order, order[1:], strict=False)),
        "star of the largest": [(N - 1, i) for i in range(N - 1)],
        "zigzag": [(i, N - 1 - i) for i in range(N // 2)] + [(N - 1 - i, i + 1) for i in range(N // 2 - 1)],
        "random": [(r.randrange(N), r.randrange(N)) for _ in range(N // 2)],
    }


def expected(edges, label):
    up = list(range(N))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    least = {}
    for x in range(N):
        least[root(x)] = min(least.get(root(x), label[x]), label[x])
    return {x: least[root(x)] for x in range(N)}


@pytest.mark.parametrize("name", graphs())
def test_every_order_settles(spark, name, monkeypatch):
    edges = graphs()[name]
    cuts = []
    real = components.stored
    monkeypatch.setattr(components, "stored", lambda df: cuts.append(1) or real(df))
    label = {x: (x * 7919) % 10_007 for x in range(N)}
    nodes = spark.createDataFrame(list(label.items()), "node long, label long")
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long"), nodes).collect()}
    assert got == expected(edges, label)
    assert components.components(spark.createDataFrame([], "a long, b long"), nodes).count() == N
    assert len(cuts) <= 30  # a few for each doubling, not one for each step of a path
