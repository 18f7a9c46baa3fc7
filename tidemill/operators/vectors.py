"""Cosine retrieval over an array column: exact top-k of query vectors against all rows, and neighbour statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of the bank and queries that meet in one task, at most; their entries, at most; products that it holds at once.
BANK_ROWS, QUERY_ROWS, BLOCK_ENTRIES, PRODUCTS = 1 << 15, 1 << 13, 1 << 21, 1 << 18
#: Rows that are read from Arrow, or written, at once.
ROWS = 500
#: Below every similarity in units of the ninth digit.
LEAST = np.iinfo(np.int64).min


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there, not empty and all finite."""
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _vectors(table: pa.Table, place: np.ndarray, column: str = "v") -> np.ndarray:
    """The vectors of a not empty table, of one length and without nulls, as unit-long rows: row i at ``place[i]``. They are copied once."""
    x, at = np.empty((table.num_rows, len(table.column(column)[0]))), 0
    for chunk in table.column(column).chunks:
        for lo in range(0, len(chunk), ROWS):
            rows = chunk.slice(lo, ROWS).flatten().to_numpy().reshape(-1, x.shape[1])
            x[place[at : at + len(rows)]] = _unit(rows)
            at += len(rows)
    return x


def tops(queries: np.ndarray, q: np.ndarray, bank: np.ndarray, b: np.ndarray, k: int, products: int = PRODUCTS) -> tuple[np.ndarray, ...]:
    """query, neighbour, similarity, nine: of the bank's unit vectors ``b`` the k most similar to each of ``q``, itself left out.

    ``nine`` is the similarity in whole units of the ninth digit, by which rows are ranked; of equal ones those of lower ids are taken,
    however many there are. Only ``products`` similarities are held at once: queries go in slices, and so does a bank that is larger.
    A bank in order of its ids is not copied.
    """
    if (bank[1:] < bank[:-1]).any():
        order = np.argsort(bank, kind="stable")
        bank, b = bank[order], b[order]
    found: list[tuple[np.ndarray, ...]] = []
    width = min(len(bank), products)
    step = max(1, products // width)
    for at in range(0, len(queries), step):
        ids = queries[at : at + step]
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # place of the query, neighbour, similarity, nine
        for lo in range(0, len(bank), width):
            s = q[at : at + step] @ b[lo : lo + width].T
            own = ids[:, None] == bank[None, lo : lo + width]
            nine = (np.copysign(np.floor(np.abs(s) * 1e9 + 0.5), s)).astype(np.int64)
            nine[own] = LEAST
            least = np.partition(nine, nine.shape[1] - min(k, nine.shape[1]), axis=1)[:, -min(k, nine.shape[1])]
            more, tied = nine > least[:, None], nine == least[:, None]
            tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= (k - more.sum(axis=1))[:, None]
            row, col = np.nonzero((more | tied) & ~own)
            best = [np.concatenate(x) for x in zip(best, (row, bank[lo + col], s[row, col], nine[row, col]), strict=True)]
        if lo:  # more than one slice of the bank
            rank = np.lexsort((best[1], -best[3], best[0]))
            best = [x[rank] for x in best]
            kept = np.arange(len(rank)) - np.searchsorted(best[0], best[0]) < k
            best = [x[kept] for x in best]
        found.append((ids[best[0]], *best[1:]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best_in_groups(bank: DataFrame, queries: DataFrame, k: int, on: list[str]) -> DataFrame:
    """query, neighbour, similarity, rank: of the bank rows (id, v, on) in a query's groups the k most similar ones.

    Both sides of a group (query, v, on) are cut into blocks by a hash, as many as their counts ask for, and every block of queries
    meets every block of the bank in a task of its own by matrix products of bounded slices. A task hands on its own k best of each
    query, so what is shuffled after that is k rows a task and query. A row is no neighbour of its own; vectors meet those of their length.
    """
    bank, queries = (usable(x, "v").withColumn("_len", F.size("v")) for x in (bank, queries))
    on = [*on, "_len"]
    blocks = lambda d, rows, name: d.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(BLOCK_ENTRIES) / F.col("_len"))))).alias(name))
    counts = blocks(bank, BANK_ROWS, "_bs").join(blocks(queries, QUERY_ROWS, "_qs"), on)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    b = bank.join(counts, on).select(*on, "id", "v", block("id", "_bs").alias("_b"), spread("_qs").alias("_q"))
    q = queries.join(counts, on).select(*on, "query", "v", block("query", "_qs").alias("_q"), spread("_bs").alias("_b"))
    names = ["query", "neighbour", "similarity", "nine"]
    schema = pa.schema([("query", pa.int64()), ("neighbour", pa.int64()), ("similarity", pa.float64()), ("nine", pa.int64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids = right.column("id").to_numpy()
        order, place = np.argsort(ids, kind="stable"), np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        found = tops(left.column("query").to_numpy(), _vectors(left, np.arange(left.num_rows)), ids[order], _vectors(right, place), k)
        return pa.table(dict(zip(names, found, strict=True)), schema=schema)

    keys = [*on, "_q", "_b"]
    found = q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(meet, "query long, neighbour long, similarity double, nine long")
    w = Window.partitionBy("query").orderBy(F.desc("nine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("nine")


def nearest(bank: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, neighbour, similarity, rank: the k most similar rows of the whole bank for each query, itself left out."""
    one = lambda d, name: d.select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"))
    return best_in_groups(one(bank, "id"), one(queries, "query"), k, [])


def neighbour_stats(found: DataFrame, bank: DataFrame, outcome: str, key: str = "vec_id") -> DataFrame:
    """Mean, median, deviation and win rate of an outcome over each query's neighbours, and a confidence."""
    d = found.join(bank.select(F.col(key).alias("neighbour"), F.col(outcome).alias("y")), "neighbour")
    s = d.groupBy("query").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.median("y").alias("median"), F.stddev_pop("y").alias("sd"), (F.count_if(F.col("y") > 0) / F.count("y")).alias("win_rate"), F.avg("similarity").alias("similarity"))
    return s.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs("mean") / (F.col("sd") + 1e-4) * F.col("similarity"))))
