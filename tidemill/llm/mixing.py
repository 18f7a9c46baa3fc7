"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, cut, let

#: Documents, or residuals, that one node of the tree combines on average.
FAN_IN = 64
#: A document may be taken so many times.
MOST = 3
#: Repeated rows that one array counts.
BLOCK_ROWS = 4096
#: Groups over which documents of one source and size are dealt while some of them are picked.
SALTS = 64


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source and the number of words of each whole text (null: 0)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """One row for each source: source_size, n_sized, target.

    Sources by code point, null last, take the weights in turn. The targets share the sum of all sizes; a target stops
    at MOST times its source's size and the excess goes to the others by weight, until none is above. That is
    least(cap, level * weight) with one level for all, found by running sums in the order of cap / weight.
    The table has one row for each source, so its windows are small whatever the number of documents.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_sized"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    left = total - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    common = F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(Window.partitionBy())
    return s.withColumn("common", common).select(
        "source", "source_size", "n_sized", F.coalesce(F.least(F.col("cap"), F.col("common") * F.col("weight")), F.col("cap")).alias("target")
    )


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _fold(items: Column, seed: int) -> Column:
    """Run the pivotal method along an array of (size, rank, doc_id, x), largest documents first.

    Two documents with copy probabilities strictly inside (0, 1) meet; words move from one to the other until one
    probability is 0 or 1, in the direction that keeps both expectations. The one that is left goes on to the next.
    The sum of size * x never changes. A large document meets smaller ones until it is settled, so what is left in the
    end is small. Result: ``decided`` (doc_id, size, extra) and the residual ``rest``.
    """
    item = "struct<size:bigint,rank:bigint,doc_id:bigint,x:double>"
    done = "array<struct<doc_id:bigint,size:bigint,extra:int>>"
    start = F.struct(F.lit(None).cast(item).alias("rest"), F.array().cast(done).alias("decided"))

    def step(acc: Column, j: Column) -> Column:
        i = acc["rest"]

        def meet(v: Column) -> Column:
            # Words that i lacks to 1, i has above 0, and the same of j.
            up_i, down_i = (1 - i["x"]) * i["size"], i["x"] * i["size"]
            up_j, down_j = (1 - j["x"]) * j["size"], j["x"] * j["size"]
            a, b = F.least(up_i, down_j), F.least(down_i, up_j)
            rise = v < F.coalesce(F.try_divide(b, a + b), F.lit(0.0))
            i_ends = F.when(rise, up_i <= down_j).otherwise(down_i <= up_j)
            extra = F.when(rise == i_ends, F.lit(1)).otherwise(F.lit(0))
            new_j = F.when(rise, j["x"] - up_i / j["size"]).otherwise(j["x"] + down_i / j["size"])
            new_i = F.when(rise, i["x"] + down_j / i["size"]).otherwise(i["x"] - up_j / i["size"])
            pick = lambda p, q: F.when(i_ends, p).otherwise(q)
            clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), pick(new_j, new_i)))
            rest = F.struct(pick(j["size"], i["size"]).alias("size"), pick(j["rank"], i["rank"]).alias("rank"), pick(j["doc_id"], i["doc_id"]).alias("doc_id"), clip.alias("x"))
            decided = F.struct(pick(i["doc_id"], j["doc_id"]).alias("doc_id"), pick(i["size"], j["size"]).alias("size"), extra.alias("extra"))
            return F.struct(rest.alias("rest"), F.concat(acc["decided"], F.array(decided)).alias("decided"))

        chance = _uniform(i["rank"], j["rank"], i["doc_id"], j["doc_id"], F.lit(seed))
        first = F.struct(j.alias("rest"), acc["decided"].alias("decided"))
        return F.when(i.isNull(), first).otherwise(let(chance, meet))

    return F.aggregate(items, start, step)


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken (copies * size), copies and source of every document.

    Every document of a source gets target / source_size copies in expectation: the whole part for sure, the rest by
    pivotal rounding over documents of the source. What the last document of the tree leaves is settled by documents of
    the right sizes (``settled``), so the words taken from a source miss its target by less than its smallest documents
    that can still change (null or empty texts: no words, no copies). Randomness is a hash of doc_id, size and a number among rows
    that agree in source and both: reruns agree, and rows that are repeated, or lack an id, are documents of their own that
    may fall differently and are spread over nodes like all others. A null source is a source; a null
    doc_id is a document. Nodes of the tree are hash blocks of about FAN_IN documents, so a hot source is many nodes.
    """
    sized = cut(sizes(docs).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / BLOCK_ROWS)))).withColumn("k", F.explode(F.sequence(F.col("block") * BLOCK_ROWS + 1, F.least("rows", (F.col("block") + 1) * BLOCK_ROWS)))).drop("rows", "block"))
    targets = cut(source_targets(sized, weights))
    most = targets.agg(F.max("n_sized")).head()[0] or 0
    x = F.try_divide(F.col("target"), F.col("source_size").cast("double"))  # null for a source without words
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "n_sized", F.floor(x).alias("whole"), (x - F.floor(x)).alias("part"))
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    split = (F.col("size") > 0) & (F.col("part") > 0)
    key = ["source", "source_size", "target", "whole"]
    sure = rows.filter(~split | split.isNull()).select(*key, "doc_id", "size", F.lit(0).alias("extra"))
    rank = F.xxhash64("doc_id", "size", "k", F.lit(seed))
    open_ = rows.filter(split).select(
        *key,
        F.pmod(F.xxhash64("doc_id", "size", "k", F.lit(seed + 1)), F.ceil(F.col("n_sized") / FAN_IN)).alias("node"),
        F.struct("size", rank.alias("rank"), "doc_id", F.col("part").alias("x")).alias("item"),
    )
    parts, nodes, level = [sure], max(1, -(-most // FAN_IN)), 0
    while True:
        folded = open_.groupBy(*key, "node").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = cut(folded.select(*key, "node", _fold(F.col("items"), seed + 2 + level).alias("f")))
        parts.append(folded.select(*key, F.inline("f.decided")))
        rest = F.col("f.rest")
        if nodes == 1:
            up = _uniform(rest["rank"], rest["doc_id"], F.lit(seed + 2 + level)) < rest["x"]
            last = folded.filter(rest.isNotNull()).select(*key, rest["doc_id"].alias("doc_id"), rest["size"].alias("size"), F.lit(0).alias("extra"), up.alias("up"))
            break
        open_ = folded.filter(rest.isNotNull()).select(*key, F.floor(F.col("node") / FAN_IN).alias("node"), rest.alias("item"))
        nodes, level = -(-nodes // FAN_IN), level + 1
    decided = parts[1]
    for p in parts[2:]:
        decided = decided.unionByName(p)
    out = sure.unionByName(settled(decided, last, key, seed))
    copies = F.when(F.col("size") > 0, F.least(F.lit(MOST), F.coalesce("whole", F.lit(0)) + F.col("extra"))).otherwise(F.lit(0)).cast("int")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), "source")


def _picks(sizes: Column, words: Column) -> Column:
    """How many documents of each size come to ``words``: sizes (size, n) from the largest, as many as fit; in the end one more of
    the smallest size, if that brings the words nearer. Result: ``left`` and ``picks``."""
    start = F.struct(words.alias("left"), F.array().cast("array<struct<size:bigint,n:bigint>>").alias("picks"))

    def take(acc: Column, s: Column) -> Column:
        n = F.least(s["n"], F.floor(acc["left"] / s["size"]))
        n = n + ((n < s["n"]) & (2 * (acc["left"] - n * s["size"]) > s["size"]) & s["last"]).cast("int")
        return F.when(n <= 0, acc).otherwise(F.struct((acc["left"] - n * s["size"]).alias("left"), F.concat(acc["picks"], F.array(F.struct(s["size"].alias("size"), n.alias("n")))).alias("picks")))

    return F.aggregate(F.transform(sizes, lambda s, i: F.struct(s["size"].alias("size"), s["n"].alias("n"), (i == F.size(sizes) - 1).alias("last"))), start, take)


def settled(decided: DataFrame, last: DataFrame, key: list[str], seed: int = 1) -> DataFrame:
    """key, doc_id, size, extra of all rounded documents, the last one of each source among them.

    ``last`` has at most one document a source, with ``up``, how chance would round it. Without its extra copy some words are
    missing, with it there are too many. Either is made up for by other documents: by extra copies of some that have none, or by
    taking back those of some that have one. Documents that are not far larger than what is to be made up for are counted by size,
    the counts of a source (as many as it has such sizes, not documents) are folded from the largest, and chance decides
    unless the other way comes nearer by a thousandth of the target. Of each size as many documents as the fold says are picked by
    hash: first in each of SALTS groups, then among those. All of it is sums, counts and limits, with one row a source and size.
    """
    given = decided.groupBy(*key).agg(F.sum(F.col("extra") * F.col("size")).alias("words"), F.sum("size").alias("sizes"))
    both = last.withColumnsRenamed({k: f"l_{k}" for k in last.columns}).join(given, F.col("source").eqNullSafe(F.col("l_source")), "left")
    want = F.col("l_target") / F.col("l_source_size") - F.col("l_whole")
    missing = want * (F.coalesce("sizes", F.lit(0)) + F.col("l_size")) - F.coalesce("words", F.lit(0))
    ways = F.array(F.struct(F.lit(0).alias("way"), missing.alias("need")), F.struct(F.lit(1).alias("way"), (F.col("l_size") - missing).alias("need")))
    ways = cut(both.select(F.col("l_source").alias("w_source"), F.col("l_target").alias("w_target"), F.col("l_up").alias("up"), F.inline(ways)))
    counts = decided.join(ways, F.col("source").eqNullSafe(F.col("w_source")) & (F.col("extra") == F.col("way")) & (F.col("size") < 2 * F.col("need"))).groupBy("source", "way", "size")
    lists = counts.agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).groupBy("source", "way").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"), F.first("need").alias("f_need"))
    folded = lists.select(F.col("source").alias("f_source"), F.col("way").alias("f_way"), _picks(F.col("sizes"), F.col("f_need")).alias("f"))
    tried = ways.join(folded, F.col("w_source").eqNullSafe(F.col("f_source")) & (F.col("way") == F.col("f_way")), "left").withColumn("off", F.abs(F.coalesce("f.left", "need")))
    off = [F.max(F.when(F.col("way") == k, F.col("off"))).over(Window.partitionBy("w_source")) for k in (0, 1)]
    chance, slack = F.col("up").cast("int"), F.col("w_target") / 1000
    better = F.when((chance == 1) & (off[1] > off[0] + slack), 0).when((chance == 0) & (off[0] > off[1] + slack), 1).otherwise(chance)
    chosen = cut(tried.withColumn("better", better).filter("way = better").select("w_source", "way", "f.picks"))
    picks = cut(chosen.select(F.col("w_source").alias("p_source"), F.col("way").alias("p_way"), F.inline("picks")).withColumnsRenamed({"size": "p_size", "n": "p_n"}))
    out = [*key, "doc_id", "size", "extra"]
    ends = last.drop("extra").join(chosen, F.col("source").eqNullSafe(F.col("w_source"))).withColumn("extra", F.col("way")).select(*out)
    most = picks.agg(F.max("p_n")).head()[0]
    if not most:
        return decided.select(*out).unionByName(ends)
    some = decided.join(picks, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("extra") == F.col("p_way")), "left")
    draw = F.xxhash64("doc_id", "size", F.lit(seed))
    salted = Window.partitionBy("source", "size", F.pmod(F.xxhash64(draw), F.lit(SALTS))).orderBy(draw, "doc_id")
    asked = some.filter("p_n IS NOT NULL").withColumn("place", F.row_number().over(salted))
    first = asked.filter("place <= p_n").withColumn("place", F.row_number().over(Window.partitionBy("source", "size").orderBy(draw, "doc_id")))
    changed = first.withColumn("extra", F.when(F.col("place") <= F.col("p_n"), 1 - F.col("extra")).otherwise(F.col("extra")))
    return some.filter("p_n IS NULL").select(*out).unionByName(asked.filter("place > p_n").select(*out)).unionByName(changed.select(*out)).unionByName(ends)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 1) -> DataFrame:
    """The mixed corpus: the input's rows, each as often as the plan takes it, with the column ``copy`` (0, 1, 2).

    A row belongs to its plan by doc_id, source and size; rows that agree in all of these share the plans of their
    number, which are interchangeable. Rows that the mix does not take are absent. A group of such rows is four counts,
    of rows taken three times, twice, once and never, whatever its size; its rows take them in the order of their texts' hashes.
    """
    plan = plan_mix(docs, weights, seed)
    per = plan.groupBy(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size")).agg(
        F.count(F.lit(1)).alias("p_rows"), F.max("copies").alias("p_most"), F.min("copies").alias("p_least"), *[F.count_if(F.col("copies") >= k).alias(f"p_{k}") for k in range(1, MOST + 1)]
    )
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    both = docs.select(row, "doc_id", "source", size.alias("size")).join(
        per, F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    )
    # Only rows that are repeated and differ in copies have to be told apart by a number.
    alike = F.col("p_most") == F.col("p_least")
    turn = F.row_number().over(Window.partitionBy("p_id", "p_source", "p_size").orderBy(F.xxhash64("row.text")))  # stable if a task runs again
    one = both.filter(alike).select("row", F.col("p_most").alias("n"))
    copies = sum((turn <= F.col(f"p_{k}")).cast("int") for k in range(1, MOST + 1))
    many = both.filter(~alike).select("row", copies.alias("n"))
    return one.unionByName(many).filter("n > 0").select("row.*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
