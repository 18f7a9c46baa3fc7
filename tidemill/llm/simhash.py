"""SimHash near-duplicates: fingerprints, exact tiled comparison, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, cut, slices, spare_name, stored, tidy
from .components import components

SEED = 42
BITS = 64
#: Fingerprints in one tile of a comparison.
TILE = 256
#: Fingerprints of a page: two of them are what one comparison holds.
PAGE = 1 << 14
#: Bytes of shingle sets of a page.
PAGE_BYTES = 8 << 20
#: From this radius on, nearer pairs are taken up first.
WIDE = 16
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14
#: Min-hash bands that deal set fingerprints into groups. A pair of similarity 0.8 shares none with the probability
#: (1 - 0.8 ** 3) ** 12, 0.0002.
BANDS, BAND_ROWS = 12, 3

_rng = np.random.default_rng(20240611)
SALTS, MIXERS = _rng.integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
MIXERS = MIXERS * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 values of the different word shingles of a text, ascending."""
    tokens = text.lower().split()
    joined = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens], dtype=np.int64) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - shingle + 1) if tokens else 0
    stops = ends[len(ends) - n :]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), np.uint64, n))


def set_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """As ``fingerprint``, of a set: every different shingle counts once."""
    ones = np.zeros((words, BITS), np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK]
        for k in range(words):
            if k:
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: bytes, shingle: int = 3, words: int = 1) -> tuple[np.ndarray, int]:
    """The fingerprint as ``words`` 64-bit words, and the number of word shingles.

    A bit is 1 if it is set in more than half of the hashes of the shingles, repeats counted; no words: all bits 0. The
    first word counts XXH64 values; further words count other mixings of the same values.
    """
    tokens = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not tokens:
        return np.zeros(words, np.uint64), 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - shingle + 1)
    stops = ends[-n:]
    ones, digest = np.zeros((words, BITS), np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(at + CHUNK, n)].tolist(), stops[at : at + CHUNK].tolist(), strict=True)], np.uint64)
        for k in range(words):
            if k:
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel(), n


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id, n (shingles) and the signed 64-bit words w0, w1, ... of every row's whole text (null: empty)."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    names = ["doc_id", "n", *[f"w{k}" for k in range(words)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [fingerprint(t, shingle, words) for t in byte_texts(batch, "text")]
            fp = np.array([g[0] for g in got], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[1] for g in got], pa.int64()), *[pa.array(fp[:, k]) for k in range(words)]], names=names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), ", ".join([f"doc_id {kind}"] + [f"{c} long" for c in names[1:]]))


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, tile by tile, of fingerprints (rows of words) sorted by bits set in the first word.

    A pair of tiles whose ranges of population counts lie further apart than the radius is skipped: two words differ in at
    least as many bits as their counts do.
    """
    ca, cb = np.bitwise_count(a[:, 0]), np.bitwise_count(b[:, 0])
    for i in range(0, len(a), TILE):
        x, low, high = a[i : i + TILE, 0], int(ca[i]), int(ca[min(i + TILE, len(a)) - 1])
        for j in range(i if same else 0, len(b), TILE):
            if int(cb[j]) - high > radius:
                break
            if low - int(cb[min(j + TILE, len(b)) - 1]) > radius:
                continue
            apart = np.bitwise_count(x[:, None] ^ b[None, j : j + TILE, 0])
            for k in range(1, a.shape[1]):
                apart += np.bitwise_count(a[i : i + TILE, k][:, None] ^ b[None, j : j + TILE, k])
            p, q = np.nonzero(apart <= radius)  # bytes: 256 different bits wrap to 0, so what is left is counted again
            if same and i == j:
                p, q = p[p < q], q[p < q]
            if len(p) and a.shape[1] > 1:
                near = np.bitwise_count(a[p + i] ^ b[q + j]).sum(1, dtype=np.int64) <= radius
                p, q = p[near], q[near]
            if len(p):
                yield p + i, q + j


class Forest:
    """Union-find over positions; ``add`` says which pairs joined two sets, so a group gives at most n - 1 links."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                return r
            r = s

    def add(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join the sets of all pairs; returned are the pairs that did it."""
        left, right = [p[:0]], [q[:0]]
        while len(p):
            a, b = self.roots(p), self.roots(q)
            apart = a != b
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            # One parent a root and round: the last write wins, and the pairs that lost try again.
            at = np.full(len(self.up), -1) if len(hi) > len(self.up) // 8 else None
            if at is None:
                _, won = np.unique(hi[::-1], return_index=True)
                won = len(hi) - 1 - won
            else:
                at[hi] = np.arange(len(hi))
                won = at[at >= 0]
            self.up[hi[won]] = lo[won]
            left.append(p[won])
            right.append(q[won])
        return np.concatenate(left), np.concatenate(right)


def banded(fps: DataFrame, radius: int) -> DataFrame:
    """Groups in which all pairs of one-word fingerprints within the radius meet: g, home, and the input's columns.

    Fingerprints within r bits agree on at least one of r + 1 blocks of bits, so equal block values make the groups.
    """
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    parts = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        value = F.shiftrightunsigned("w0", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < BITS else -1))
        parts.append(F.struct(F.lit(k).alias("k"), value.alias("v")))
    return fps.select("*", F.explode(F.array(*parts)).alias("b")).select("*", F.xxhash64("b.k", "b.v").alias("g"), F.lit(True).alias("home")).drop("b")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each of BANDS bands of BAND_ROWS min-hashes of a set of shingle hashes; two sets share a band's key with the
    probability similarity ** BAND_ROWS. An empty set has keys of its own."""
    least = np.full(len(MIXERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK >> 4):
        least = np.minimum(least, ((hashes[None, at : at + (CHUNK >> 4)] ^ SALTS[:, None]) * MIXERS[:, None]).min(1))
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)


def by_bands(nodes: DataFrame) -> DataFrame:
    """Groups in which sets of high similarity meet: g, home, id and the words (and label) of nodes that share a band.

    Bands that one node has alone are done with before any word is shuffled, so what is compared grows with the links, not
    with the number of texts of a size.
    """
    keys = nodes.select("id", F.explode("bands").alias("g"))
    busy = keys.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("g").alias("bg"))
    met = keys.join(busy, F.col("g") == F.col("bg")).select(F.col("id").alias("mid"), "g")
    return nodes.drop("bands", "n").join(met, F.col("id") == F.col("mid")).drop("mid").withColumn("home", F.lit(True))


def links(grouped: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """Links (a, b) between ids that connect exactly what pairs within the radius connect, group by group.

    ``grouped``: id (long), g, home and words w0, ...; two visitors of a group are not compared. Inside a group the
    comparison is exact, tile by tile. Groups are split into pages of rows; page pairs of one group are compared in
    different tasks, so a large group is spread over the cluster and no task holds it. Each task returns a
    spanning forest of the pairs it found, never all of them; of a wide radius it takes up the nearer pairs first.

    ``similarity``: the links connect what pairs of that Jaccard similarity within the radius connect, beyond what equal
    ``label`` (long) says is connected; ``shingles`` has the sets, whose bytes then make the pages. A pair that is connected
    already is not judged, and one that is judged and refused leaves no row.
    """
    judged = similarity is not None
    words = [c for c in grouped.columns if c.startswith("w")] + ["label", "shingles"] * judged
    load = F.size("shingles") * 8 / PAGE_BYTES if judged else F.lit(1 / PAGE)
    side = lambda home: F.when(F.col("home") == F.lit(home), load)
    counts = grouped.groupBy("g").agg(F.count(side(True)).alias("homes"), F.sum(side(True)).alias("hl"), F.count(side(False)).alias("guests"), F.sum(side(False)).alias("gl")).filter("homes + guests > 1 AND homes > 0")
    pages = lambda c, n: F.when(F.col(n) > 0, F.greatest(F.ceil(F.round(F.col(c), 9)), F.lit(1))).otherwise(0).cast("int")
    counts = cut(counts).select(F.col("g").alias("cg"), pages("hl", "homes").alias("hp"), pages("gl", "guests").alias("gp"))
    rows = grouped.join(counts, F.col("g") == F.col("cg"))
    draw = F.xxhash64("id", F.lit(7))
    page = F.when(F.col("home"), F.pmod(draw, F.col("hp"))).otherwise(F.col("hp") + F.pmod(draw, F.col("gp"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("home"), F.col("hp") + F.col("gp")).otherwise(F.col("hp")) - 1)
    meet = rows.withColumn("page", page).select("g", "id", *words, "page", F.explode(others).alias("o"))
    meet = meet.select("g", F.least("page", "o").alias("p"), F.greatest("page", "o").alias("q"), "page", "id", *words)
    dealt = meet.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")
    find = _judged(similarity) if judged else _forests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(c).to_numpy() for c in ("g", "p", "q")])
            bounds = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
            if held and (tuple(key[0]) != last or len(bounds) > 1):
                # The group that was open ends before, or inside, this batch.
                upto = int(bounds[1]) if tuple(key[0]) == last else 0
                yield from find([*held, batch.slice(0, upto)], radius)
                batch, bounds, held = batch.slice(upto), bounds[bounds >= upto] - upto, []
            if len(bounds) > 1:
                yield from find([batch.slice(0, int(bounds[-1]))], radius)
                batch = batch.slice(int(bounds[-1]))
            held.append(batch)
            last = tuple(key[-1])
        if held:
            yield from find(held, radius)

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _groups(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, Callable[[int], Iterator[tuple[np.ndarray, np.ndarray]]]]]:
    """Of each group (run of equal g, p, q): the rows in order of bits set, and a function from a radius to the pairs of their places
    within it, tile by tile."""
    table = pa.Table.from_batches(held)
    g, p, q, page = (table.column(c).to_numpy() for c in ("g", "p", "q", "page"))
    words = np.column_stack([table.column(c).to_numpy() for c in table.column_names if c.startswith("w")]).view(np.uint64)
    edge = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1, [len(g)]])
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        order = np.argsort(np.bitwise_count(words[lo:hi, 0]), kind="stable") + lo
        w, own = words[order], page[order]
        if p[lo] == q[lo]:
            yield table, order, partial(near_pairs, w, w, same=True)
        else:
            yield table, order, partial(_between, w, np.flatnonzero(own == p[lo]), np.flatnonzero(own == q[lo]))


def _between(w: np.ndarray, one: np.ndarray, two: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, y in near_pairs(w[one], w[two], radius, False):
        yield one[x], two[y]


def _links(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _forests(held: list[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of whole groups, of pairs within half of a wide radius first."""
    for table, order, pairs in _groups(held):
        ids, left, right = table.column("id").to_numpy()[order], [], []
        forest = Forest(len(order))
        for reach in (radius // 2, 3 * radius // 4, radius) if radius >= WIDE else (radius,):
            for x, y in pairs(radius=reach):
                p, q = forest.add(x, y)
                left.append(p)
                right.append(q)
        if left:
            yield _links(ids[np.concatenate(left)], ids[np.concatenate(right)])


def _judged(similarity: float) -> Callable[[list[pa.RecordBatch], int], Iterator[pa.RecordBatch]]:
    """Forests of the pairs of whole groups that are similar enough and connect what is not connected yet."""

    def find(held: list[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
        for table, order, pairs in _groups(held):
            ids, label = (table.column(c).to_numpy()[order] for c in ("id", "label"))
            sets = table.column("shingles").combine_chunks()
            sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
            values, offsets = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
            begin, end = offsets[:-1][order], offsets[1:][order]
            size = end - begin
            _, first, which = np.unique(label, return_index=True, return_inverse=True)
            forest = Forest(len(order))
            forest.add(np.arange(len(order)), first[which])
            left, right = [], []
            for x, y in pairs(radius=radius):
                likely = (forest.roots(x) != forest.roots(y)) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1) & (size[x] > 0) & (size[y] > 0)
                x, y = x[likely], y[likely]
                for lo, hi in _runs(x):
                    one, many = x[lo], y[lo:hi]
                    many = many[forest.roots(many) != forest.roots(x[lo : lo + 1])]
                    if len(many):
                        same = _in_common(values[begin[one] : end[one]], [values[begin[k] : end[k]] for k in many.tolist()])
                        near = many[same / (size[one] + size[many] - same) >= similarity]
                        p, q = forest.add(np.full(len(near), one), near)
                        left.append(p)
                        right.append(q)
            if left:
                yield _links(ids[np.concatenate(left)], ids[np.concatenate(right)])

    return find


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """The runs of equal values."""
    if len(x):
        edge = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]).tolist()
        yield from zip(edge[:-1], edge[1:], strict=True)


def _in_common(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """How many values of each of the ascending, not empty sets are in the first."""
    out = []
    for at in range(0, len(many), TILE):
        part = many[at : at + TILE]
        values = np.concatenate(part)
        place = np.searchsorted(one, values)
        place[place == len(one)] = 0
        out.append(np.add.reduceat((one[place] == values).astype(np.int64), np.cumsum([0, *map(len, part[:-1])])))
    return np.concatenate(out)


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text; others are ignored).

    Fingerprints that differ in at most ``radius`` bits are linked; component_id is the smallest doc_id that can be
    reached. Equal fingerprints are one node, so copies are never paired. Null and empty texts have fingerprint 0. A
    null doc_id keeps its row and is no component_id unless all doc_ids of the component are null. Repeated rows stay.
    """
    none = (1 << 63) - 1
    fps = cut(fingerprints(docs, shingle))
    nodes = cut(fps.groupBy("w0").agg(F.min("doc_id").alias("least")).select(F.col("w0").alias("node"), F.coalesce("least", F.lit(none)).alias("label")))
    groups = banded(nodes.select(F.col("node").alias("id"), F.col("node").alias("w0")), radius)
    found = components(links(groups, radius), nodes)
    out = fps.join(found, fps["w0"] == found["node"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), F.nullif("label", F.lit(none)).alias("component_id"))


def _shingle_nodes(known: DataFrame, shingle: int, words: int) -> DataFrame:
    """Of every row doc_id, t0, t1 (128 bits of its text), s0, s1 (128 bits of its shingle set), n, w0, w1, ... and its bands."""
    kind = known.select("doc_id").schema[0].dataType.simpleString()
    names = ["doc_id", "t0", "t1", "s0", "s1", "n", *[f"w{k}" for k in range(words)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, bands = [], []
            for text in byte_texts(batch, "text"):
                h = shingle_hashes(text, shingle)
                bands.append(band_keys(h))
                rows.append(np.concatenate([np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64), [len(h)], set_fingerprint(h, words).view(np.int64)]))
            fp = np.array(rows, np.int64).reshape(-1, 3 + words)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(bands).view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], *[pa.array(c) for c in fp.T.copy()], keys], names=[*names, "bands"])

    return known.select("doc_id", "t0", "t1", "text").mapInArrow(tidy(run), ", ".join([f"doc_id {kind}"] + [f"{c} long" for c in names[1:]] + ["bands array<long>"]))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets (id, shingles: array of different hashes) have at least this Jaccard similarity."""
    side = lambda c: sets.select(F.col("id").alias(f"{c}_id"), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.filter(common / (F.size("a_set") + F.size("b_set") - common) >= similarity).select("a", "b")


def _unsettled(nodes: DataFrame, forest: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """The groups in which candidates may still connect what ``found`` has apart: g, home, id, words, label, shingles.

    A group is what the forest of all candidates connects, if that is more than two nodes with more than one label; of two
    nodes the only pair has been judged. The nodes of a group's commonest label are its visitors: among them
    nothing is to be found out, and they meet each page of the others only.
    """
    family = components(forest, nodes.select(F.col("id").alias("node"), F.col("id").alias("label"))).select(F.col("node").alias("f_node"), F.col("label").alias("g"))
    where = stored(found.join(family, F.col("node") == F.col("f_node")).select("node", "label", "g"))
    sizes = where.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("c"), F.max(F.struct("c", "label")).alias("m")).filter("kinds > 1 AND c > 2")
    where = stored(where.join(open_.select(F.col("g").alias("o_g"), F.col("m.label").alias("common")), F.col("g") == F.col("o_g")).select("node", "label", "g", (F.col("label") != F.col("common")).alias("home")))
    asked = where.join(nodes.drop("bands"), F.col("node") == F.col("id")).drop("node")
    return asked.join(sets.withColumnRenamed("id", "s_id"), F.col("id") == F.col("s_id")).drop("s_id")


def keep_first(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 4, radius: int = 60) -> DataFrame:
    """One row of each near-duplicate group of docs: that with the smallest doc_id (of repeated rows, one).

    Texts are near duplicates if the Jaccard similarity of their sets of five-word shingles is at least 0.8, and groups
    are what such pairs connect. Candidates are pairs that share one of 12 min-hash bands and whose 256-bit fingerprints
    over the sets differ in at most 60 bits, compared tile by tile; each candidate is judged by the sets themselves. At
    a similarity of 0.8, 39 bits differ on average with a deviation of 6, and one pair in some 5,000 shares no band, so
    few pairs are missed; unrelated texts differ in 128 bits. Equal sets are one node. A spanning forest of
    the candidates, near ones first, is judged first; then, in what it connects, every pair within 60 bits that is still
    in different groups, so that a refused link never hides another. These are judged where they are found: tasks
    get the sets of two pages and return forests, so families of texts that are alike but not alike enough cost
    comparisons (and one copy of a page for each page of the smaller side), not rows. Rows are told apart by doc_id and text: unlike texts that share a doc_id are judged each by
    its own, and only rows equal in both are repeats. A row without doc_id stays, and represents no group. Null and
    empty texts are equal sets. Extra columns come along; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = {"t0": F.xxhash64(text), "t1": F.xxhash64(F.lit(1), text)}
    known = docs.filter("doc_id IS NOT NULL")
    rows = _shingle_nodes(known.select("doc_id", "text").withColumns(digests), shingle, words)
    fps = [f"w{k}" for k in range(words)]
    # A node is a set of shingles; ``best`` is the row that stands for it. Ids are fixed by the checkpoint.
    nodes = rows.groupBy("s0", "s1").agg(F.min(F.struct("doc_id", "t0", "t1")).alias("best"), *[F.first(c).alias(c) for c in (*fps, "bands")])
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("id"), "best", *fps, "bands"))
    apart = nodes.select("id", *fps, "bands")
    own = nodes.select(F.col("id").alias("node"), F.col("id").alias("label"))
    reps = nodes.select("id", F.col("best.doc_id").alias("b_id"), F.col("best.t0").alias("b0"), F.col("best.t1").alias("b1"))

    def shingle_sets(pairs: DataFrame) -> DataFrame:
        # What is asked grows with the texts, so they are shuffled whatever its size: plans are alike at every size.
        asked = reps.join(pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct(), F.col("id") == F.col("i"), "left_semi")
        asked = stored(asked)
        texts = known.select("doc_id", "text").withColumns(digests).join(asked.hint("merge"), (F.col("doc_id") == F.col("b_id")) & (F.col("t0") == F.col("b0")) & (F.col("t1") == F.col("b1")))
        # By the keys of the join: where that shuffled the texts, they lie right for this.
        texts = texts.dropDuplicates(["b_id", "b0", "b1"]).select("id", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                for r, t in enumerate(byte_texts(batch, "text")):
                    h = pa.array(shingle_hashes(t, shingle).view(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), h)], names=["id", "shingles"])

        return cut(texts.mapInArrow(tidy(run), "id long, shingles array<long>"))

    forest = cut(links(by_bands(apart), radius))
    # Every set with a candidate is in the forest, so these are all the sets that either round of judging needs.
    sets = shingle_sets(forest)
    sure = cut(confirmed(forest, sets, similarity))
    found = cut(components(sure, own))
    more = cut(links(_unsettled(apart, forest, found, sets), radius, similarity))
    if not more.isEmpty():
        found = components(sure.union(more), own)
    stay = found.join(nodes.select("id", "best"), F.col("node") == F.col("id")).groupBy("label").agg(F.min("best").alias("best"))
    stay = stay.select(F.col("best.doc_id").alias("b_id"), F.col("best.t0").alias("b0"), F.col("best.t1").alias("b1"))
    # What goes, and what stays but is repeated, as tables. What goes grows with the texts, so they are shuffled once for it at every
    # size; repeated rows alone are grouped.
    keys = known.select("doc_id", *[c.alias(k) for k, c in digests.items()]).groupBy("doc_id", "t0", "t1").agg(F.count(F.lit(1)).alias("c"))
    k0, k1, i_, i0, i1 = (spare_name(docs, f"_key_{k}") for k in range(5))
    keys = keys.join(stay, (F.col("doc_id") == F.col("b_id")) & (F.col("t0") == F.col("b0")) & (F.col("t1") == F.col("b1")), "left")
    keys = keys.select(F.col("doc_id").alias(i_), F.col("t0").alias(i0), F.col("t1").alias(i1), "c", F.col("b_id").isNotNull().alias("stays"))
    marked = cut(keys.filter("c > 1 OR NOT stays"))
    here = (F.col("doc_id") == F.col(i_)) & (F.col(k0) == F.col(i0)) & (F.col(k1) == F.col(i1))
    keyed = known.withColumns({k0: digests["t0"], k1: digests["t1"]})
    single = keyed.join(stored(marked.select(i_, i0, i1)).hint("merge"), here, "left_anti").drop(k0, k1)
    again = stored(marked.filter("stays").select(i_, i0, i1))
    repeated = keyed.join(again, here, "left_semi").dropDuplicates(["doc_id", k0, k1]).drop(k0, k1)
    return single.unionByName(repeated).unionByName(docs.filter("doc_id IS NULL"))
