"""Connected components of a distributed edge list, in logarithmically many contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _parents(edges: DataFrame) -> DataFrame:
    """node, up: for every node of the symmetric edges (a, b) a node of its component, itself or a smaller one.

    A node with a smaller neighbour takes the smallest. A local minimum takes the smallest node two steps away; if that
    is itself, its neighbours have taken it. So no node stays alone, and pointers fall, so they make trees.
    """
    near = stored(edges.groupBy("a").agg(F.min("b").alias("near")))
    low = near.filter("near > a").select(F.col("a").alias("low"))
    two = edges.join(low, F.col("a") == F.col("low"), "left_semi").join(near.select(F.col("a").alias("via"), F.col("near").alias("far")), F.col("b") == F.col("via"))
    two = two.groupBy("a").agg(F.min("far").alias("up")).select(F.col("a").alias("node"), "up")
    return near.filter("near < a").select(F.col("a").alias("node"), F.col("near").alias("up")).unionByName(two)


def _roots(up: DataFrame) -> DataFrame:
    """Every pointer moved to the root of its tree: each join doubles the steps that a pointer spans; two joins a table."""

    def jump(up: DataFrame) -> DataFrame:
        ahead = up.filter("node <> up").select(F.col("node").alias("via"), F.col("up").alias("next"))
        return up.join(ahead, F.col("up") == F.col("via"), "left").select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))

    up = stored(up)
    while True:
        step = stored(jump(jump(up).select("node", "up")))
        up = step.select("node", "up")
        if step.filter("moved").isEmpty():
            return up


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """For each node the smallest label of its component.

    ``edges``: a, b (long node ids, either direction, repeats and loops allowed). ``labels``: node, label (one row a node;
    nodes without an edge keep their label). Each round joins every node to another one, moves all pointers to the
    roots of their trees and replaces the graph by that of the roots, so at least half of the nodes with edges go and
    rounds and steps are logarithmic in the nodes, whatever their order. Every step is stored as a table; only whether
    anything moved reaches the driver. Edges to nodes without a label count as well. Empty tables give empty results.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    root = None
    while not both.isEmpty():
        up = _roots(_parents(both))
        if root is None:
            root = up.select("node", F.col("up").alias("root"))
        else:
            root = stored(root.join(up, F.col("root") == up["node"], "left").select(root["node"], F.coalesce("up", "root").alias("root")))
        left, right = up.select(F.col("node").alias("l"), F.col("up").alias("x")), up.select(F.col("node").alias("r"), F.col("up").alias("y"))
        moved = both.join(left, F.col("a") == F.col("l")).join(right, F.col("b") == F.col("r")).filter("x <> y")
        both = stored(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if root is None:
        return labels.select("node", "label")
    known = labels.join(root.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("node", "label", "root")
    least = known.filter("root IS NOT NULL").groupBy("root").agg(F.min("label").alias("least")).withColumnRenamed("root", "of")
    return known.join(least, F.col("root") == F.col("of"), "left").select("node", F.coalesce("least", "label").alias("label"))
