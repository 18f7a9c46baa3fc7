"""Suffix-array dedup: remove every byte inside a string of fixed length that also starts anywhere else.

Suffixes are compared through prefix polynomial hashes: a binary search over the hashes finds the length two suffixes
have in common, so a comparison costs a logarithm of that length, and a vectorised bottom-up mergesort orders them.
Whatever the hashes call equal is verified byte by byte before it counts.

A suffix array of a whole corpus would need one order over every byte, so the suffixes are first narrowed down. In each
string of ``length`` bytes the k-gram with the smallest hash, leftmost first, is its anchor; equal strings have equal
anchors at equal places. Only anchors whose hash occurs twice can lie in a repeated string. The context of an anchor is
the stretch of the strings it anchors; contexts equal as a whole are found by their digests, and the different ones
around an equal anchor go on to be sorted, group by group of equal anchor hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest as digest

from .common import byte_texts, cut, fresh_path, slices, spare_name, tidy

K = 64
#: Window starts hashed at once; a longer text is hashed in overlapping pieces. A task holds about 100 bytes for each.
PIECE = 1 << 18
#: Low bits of a hash that give way to the place in the buffer: among equal rest the leftmost wins.
PLACE_BITS = 21
#: Contexts sorted at once, in bytes; a group of equal anchors is never split. A task holds about 50 bytes for each.
SORT_BYTES = 1 << 20
#: Strings that one round of ``covered`` looks at, or one place's, if these are more.
STRINGS = 1 << 18
#: Powers that a worker keeps for later tasks; more are made anew. Bytes hashed in one go.
KEPT_POWERS, STEP = 1 << 20, 1 << 16
#: Anchors with more different contexts than this are resolved by the distributed plan in ``_hot``.
HOT = 20_000

_rng = np.random.default_rng(20240607)
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64."""
    held = _POW
    if len(held.get("up", ())) < n:
        size = max(n, 1 << 16)
        held = _POW if size <= KEPT_POWERS else {}
        for name, b in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            held[name] = np.multiply.accumulate(p, out=p)
    return held["up"][:n], held["down"][:n]


class PrefixHash:
    """Prefix sums of table[byte] * BASE**i: the hash of any substring is one subtraction and one product."""

    def __init__(self, buf: np.ndarray) -> None:
        self.buf = buf
        up, self.down = _powers(len(buf) + 1)
        self.sum = np.zeros(len(buf) + 1, np.uint64)
        for at in range(0, len(buf), STEP):
            part = TABLE[buf[at : at + STEP]] * up[at : min(at + STEP, len(buf))]
            part[0] += self.sum[at]
            np.cumsum(part, out=self.sum[at + 1 : at + 1 + len(part)])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sum[start + size] - self.sum[start]) * self.down[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of positions a and b, at most ``most``, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        whole = self.of(a, high) == self.of(b, high)
        low[whole] = high[whole]
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            # The middle is tested from the length already known to agree.
            done = low[todo]
            same = self.of(a[todo] + done, mid - done + 1) == self.of(b[todo] + done, mid - done + 1)
            low[todo[same]] = mid[same] + 1
            high[todo[~same]] = mid[~same]
            todo = todo[low[todo] < high[todo]]
        return low


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(buf: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of the strings of ``length`` bytes that start in [first, last] of each text (last < first: none).

    Returns text number, hash, place of the anchor in buf, and the smallest and largest distance from the start of a
    string to its anchor. Every start belongs to exactly one anchor, and the starts of an anchor are contiguous.
    """
    n, gap = len(buf), length - k + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    ph = PrefixHash(buf)
    grams = _mix((ph.sum[k:] - ph.sum[:-k]) * ph.down[: n - k + 1])
    bits = np.uint64(PLACE_BITS)  # the same in every buffer, so copies of a string have the same anchor whatever surrounds them
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    wide, span = key, 1
    while span * 2 <= gap:
        wide = np.minimum(wide[:-span], wide[span:])
        span *= 2
    if span < gap:
        wide = np.minimum(wide[: len(wide) - (gap - span)], wide[gap - span :])
    least = (wide & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.maximum(last - first + 1, 0)
    owner = np.repeat(np.arange(len(first)), size)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]
    at = least[starts]
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    end = np.concatenate([new[1:], [len(at)]]) - 1
    place = at[new]
    return owner[new], grams[place], place, place - starts[end], place - starts[new]


def text_anchors(texts: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, hash, place in the text, lo, hi) of all anchors of whole texts; short texts are packed together."""
    pack: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple[np.ndarray, ...]:
        buf = np.frombuffer(b"".join(p[2] for p in pack), np.uint8)
        sizes = np.array([len(p[2]) for p in pack])
        begin = np.cumsum(sizes) - sizes
        owner, h, place, lo, hi = anchors(buf, begin, begin + sizes - length, length, k)
        base = np.array([p[1] for p in pack])
        return np.array([p[0] for p in pack])[owner], h, place - begin[owner] + base[owner], lo, hi

    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            piece = t[at : at + PIECE + length - 1]
            if pack and size + len(piece) > PIECE // 2:
                yield flush()
                pack, size = [], 0
            pack.append((i, at, piece))
            size += len(piece)
    if pack:
        yield flush()


def merge_sort(ph: PrefixHash, pos: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes (pos, size) inside each group; ``group`` is sorted. Ties keep their order.

    Bottom-up: in each round every item finds its rank in the neighbouring run by binary search, comparing two suffixes
    by their common extension and the byte after it. All items of a round are compared together.
    """
    n = len(pos)
    order = np.arange(n)
    if n < 2:
        return order
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    counts = np.diff(np.concatenate([starts, [n]]))
    begin, count = np.repeat(starts, counts), np.repeat(counts, counts)
    local = np.arange(n) - begin
    width, most = 1, int(counts.max())
    while width < most:
        run = local // width
        other = np.where(run % 2 == 0, run + 1, run - 1) * width
        busy = np.flatnonzero(other < count)
        if len(busy):
            me = order[busy]
            left = run[busy] % 2 == 0
            low = begin[busy] + other[busy]
            high = np.minimum(low + width, begin[busy] + count[busy])
            base = low.copy()
            todo = np.arange(len(busy))
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                a, b = me[todo], order[mid]
                most_len = np.minimum(size[a], size[b])
                ext = ph.common(pos[a], pos[b], most_len)
                ended = ext == most_len
                pa_, pb = np.minimum(pos[a] + ext, len(ph.buf) - 1), np.minimum(pos[b] + ext, len(ph.buf) - 1)
                less = np.where(ended, size[b] < size[a], ph.buf[pb] < ph.buf[pa_])
                equal = ended & (size[a] == size[b])
                # Items of a left run go before equal items of the right run.
                go = less | (equal & ~left[todo])
                low[todo[go]] = mid[go] + 1
                high[todo[~go]] = mid[~go]
                todo = todo[low[todo] < high[todo]]
            rank = low - base
            pair = begin[busy] + (run[busy] - run[busy] % 2) * width
            target = pair + (local[busy] - run[busy] * width) + rank
            new = order.copy()
            new[target] = me
            order = new
        width *= 2
    return order


def _equal_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a : a + size] and buf[b : b + size] are the same bytes, pair by pair."""
    out = np.ones(len(a), bool)
    most = int(size.max()) if len(size) else 0
    if not most:
        return out
    padded = np.concatenate([buf, np.zeros(most, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, most)
    for at in range(0, len(a), 1 << 14):
        s = slice(at, at + (1 << 14))
        out[s] = ((view[a[s]] == view[b[s]]) | (np.arange(most) >= size[s, None])).all(1)
    return out


def covered(bufs: list[bytes], group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated strings of contexts that share anchors: (context number, from, to), places relative to the anchor.

    ``group`` numbers equal anchor hashes and is sorted. Context i holds the strings of ``length`` bytes whose start is
    lo..hi bytes before its anchor. A start is reported if the same string is in another context of the group.
    """
    sizes = np.array([len(b) for b in bufs])
    buf = np.frombuffer(b"".join(bufs), np.uint8)
    start = np.cumsum(sizes) - sizes
    ph = PrefixHash(buf)
    # Equal contexts collapse to one; all of their strings are repeated.
    marks = _mix(ph.of(start, sizes)) + lo.astype(np.uint64) * BASE + hi.astype(np.uint64)
    order = np.lexsort((marks, group))
    same = (group[order][1:] == group[order][:-1]) & (marks[order][1:] == marks[order][:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    times = np.diff(np.concatenate([head, [len(order)]]))
    rep = np.empty(len(order), np.int64)
    rep[order] = np.repeat(order[head], times)
    real = (sizes == sizes[rep]) & (lo == lo[rep]) & (hi == hi[rep])
    real[real] = _equal_bytes(buf, start[real], start[rep[real]], sizes[real])
    bad = set(group[~real].tolist())
    many = np.zeros(len(order), bool)
    many[order] = np.repeat(times > 1, times)
    found = [(np.flatnonzero(many), -hi[many], length - lo[many])]

    one = np.sort(order[head])  # one context of each kind, by group
    g, anchor = group[one], start[one] + hi[one]
    single = ~many[one]
    pairs = [np.zeros((0, 2), np.int64)]
    forward = merge_sort(ph, anchor, length - lo[one], g)
    pairs.append(np.column_stack([forward[:-1], forward[1:]]))
    # Text before the anchor is sorted through the reversed buffer.
    back = PrefixHash(np.ascontiguousarray(buf[::-1]))
    backward = merge_sort(back, len(buf) - anchor, hi[one], g)
    pairs.append(np.column_stack([backward[:-1], backward[1:]]))
    pair = np.concatenate(pairs)
    pair = pair[g[pair[:, 0]] == g[pair[:, 1]]]
    x, y = pair[:, 0], pair[:, 1]
    right = ph.common(anchor[x], anchor[y], length - np.maximum(lo[one][x], lo[one][y]))
    left = back.common(len(buf) - anchor[x], len(buf) - anchor[y], np.minimum(hi[one][x], hi[one][y]))
    ok = _equal_bytes(buf, anchor[x] - left, anchor[y] - left, left + right)
    bad |= set(g[x[~ok]].tolist())
    # The best each context has on either side; starts that need more than that cannot be repeated.
    far, near = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    for a in (x, y):
        np.maximum.at(far, a, right)
        np.maximum.at(near, a, left)
    hit = left + right >= length
    for a in (x, y):
        mine = hit & single[a]
        found.append((one[a[mine]], -left[mine], right[mine]))
    # Starts between both limits that no neighbour has settled: sort the strings themselves, place by place.
    low, high = np.maximum(lo[one], length - far), np.minimum(hi[one], near)
    open_ = np.flatnonzero(single & (low <= high))
    asked = [np.zeros((0, 2), np.int64)]
    for own in np.split(open_, np.flatnonzero(np.diff(np.cumsum(high[open_] - low[open_] + 1) // STRINGS)) + 1) if len(open_) else []:
        n = high[own] - low[own] + 1
        row = np.full(len(one), -1)
        row[own] = np.cumsum(n) - n
        # Mark spans of settled starts with running sums.
        mark = np.zeros(n.sum() + 1, np.int64)
        for a in (x, y):
            mine = np.flatnonzero(hit & (row[a] >= 0))
            a_, top = a[mine], np.minimum(left[mine], high[a[mine]])
            bottom = np.maximum(length - right[mine], low[a_])
            live = bottom <= top
            np.add.at(mark, row[a_[live]] + bottom[live] - low[a_[live]], 1)
            np.add.at(mark, row[a_[live]] + top[live] - low[a_[live]] + 1, -1)
        todo = np.flatnonzero(np.cumsum(mark)[:-1] == 0)
        who = own[np.searchsorted(row[own], todo, "right") - 1]
        asked.append(np.unique(np.column_stack([g[who], todo - row[who] + low[who]]), axis=0))
    asked = np.unique(np.concatenate(asked), axis=0)
    if len(asked):
        from_, to = np.searchsorted(g, asked[:, 0], "left"), np.searchsorted(g, asked[:, 0], "right")
        for rows in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(np.cumsum(to - from_) // STRINGS)) + 1):
            cnt = to[rows] - from_[rows]
            num = np.repeat(np.arange(len(cnt)), cnt)
            item = np.arange(len(num)) - np.repeat(np.cumsum(cnt) - cnt, cnt) + from_[rows][num]
            o = asked[rows, 1][num]
            fits = (lo[one][item] <= o) & (o <= hi[one][item])
            num, item, o = num[fits], item[fits], o[fits]
            pos = anchor[item] - o
            by = merge_sort(ph, pos, np.full(len(pos), length), num)
            p, q = by[:-1], by[1:]
            eq = (num[p] == num[q]) & (ph.of(pos[p], length) == ph.of(pos[q], length))
            p, q = p[eq], q[eq]
            true = _equal_bytes(buf, pos[p], pos[q], np.full(len(p), length))
            bad |= set(g[item[p[~true]]].tolist())
            for a in (p[true], q[true]):
                found.append((one[item[a]], -o[a], length - o[a]))
    who, a, b = (np.concatenate([f[i] for f in found]) for i in range(3))
    if bad:
        # Two different strings had one hash: these groups are done by comparing the strings.
        keep = ~np.isin(group[who], list(bad))
        more = [_plain(bufs, np.flatnonzero(group == v), lo, hi, length) for v in bad]
        who, a, b = (np.concatenate([c[keep], *[m[i] for m in more]]) for i, c in enumerate((who, a, b)))
    # Members of a collapsed kind were reported one by one; others stand for themselves.
    return who, a, b


def _plain(bufs: list[bytes], members: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    seen: dict[tuple[int, bytes], list[int]] = {}
    for i in members.tolist():
        for o in range(lo[i], hi[i] + 1):
            seen.setdefault((o, bufs[i][hi[i] - o : hi[i] - o + length]), []).append(i)
    rows = [(i, -o, length - o) for (o, _), who in seen.items() if len(who) > 1 for i in who]
    out = np.array(rows, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


#: What names a text: doc_id (null as 0), 64 bits of a hash of the text, and twice its octet length, odd where doc_id is null.
KEY = ["doc", "th", "tn"]


def _key() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") * 2 + F.col("doc_id").isNull().cast("long")
    return [F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc"), F.xxhash64(text).alias("th"), size.alias("tn")]


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns KEY and the text, without nulls.

    Rows that agree in id and text share a key and so all results, which is right: each repeats the other.
    """
    return docs.select(*_key(), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _other(df: DataFrame) -> DataFrame:
    """The frame with KEY renamed to d2, th2, tn2, for ``_same``."""
    return df.withColumnsRenamed({"doc": "d2", "th": "th2", "tn": "tn2"})


def _same() -> Column:
    return (F.col("doc") == F.col("d2")) & (F.col("th") == F.col("th2")) & (F.col("tn") == F.col("tn2"))


def context_digests(texts: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The anchors of ``text_anchors`` with a 64-bit digest of the whole context of each, its distances included.

    An anchor hash and a digest, both equal, stand for equal contexts: 128 bits of two unlike functions.
    """
    for owner, h, place, lo, hi in text_anchors(texts, length, k):
        c = np.array([digest(texts[o][p - j : p + length - i], i << 16 | j) for o, p, i, j in zip(owner.tolist(), place.tolist(), lo.tolist(), hi.tolist(), strict=True)], np.uint64)
        yield owner, h.view(np.int64), c.view(np.int64), place, lo, hi


def _kinds(keyed: DataFrame, length: int, k: int) -> DataFrame:
    """h, c, n: contexts counted by anchor hash and digest, each Arrow batch adding a kind once with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [np.column_stack(x[1:3]) for x in context_digests(list(byte_texts(batch, "text")), length, k)]
            if got:
                kinds = np.ascontiguousarray(np.concatenate(got)).view([("h", np.int64), ("c", np.int64)]).ravel()
                kinds, n = np.unique(kinds, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds["h"]), pa.array(kinds["c"]), pa.array(n.astype(np.int32))], names=["h", "c", "n"])

    rows = keyed.select("text").mapInArrow(tidy(run), "h long, c long, n int").repartition("h")
    rows = rows.groupBy("h", "c").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("h")
    rows = rows.withColumns({"total": F.sum("n").over(w), "kinds": F.count(F.lit(1)).over(w)})
    return rows.filter("total > 1").select(F.col("h").alias("kh"), F.col("c").alias("kc"), (F.col("n") > 1).alias("many"), (F.col("kinds") > 1).alias("mixed"), F.col("kinds"))


def sorted_spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """What ``covered`` finds in contexts (h, KEY, at, lo, hi, ctx) sorted by h, a few whole groups at once: KEY, a, b."""

    def flush(t: pa.Table) -> pa.RecordBatch:
        h, doc, th, tn, at, lo, hi = (t.column(c).to_numpy() for c in ("h", *KEY, "at", "lo", "hi"))
        group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))
        who, a, b = covered(t.column("ctx").to_pylist(), group, lo.astype(np.int64), hi.astype(np.int64), length)
        return pa.RecordBatch.from_arrays([pa.array(doc[who]), pa.array(th[who]), pa.array(tn[who]), pa.array((at[who] + a).astype(np.int32)), pa.array((at[who] + b).astype(np.int32))], names=[*KEY, "a", "b"])

    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += batch.column("ctx").nbytes
        if size > SORT_BYTES:
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1], "left"))  # sorted by h: the last group may go on
            if whole:
                yield flush(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
                size = sum(x.column("ctx").nbytes for x in held)
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield flush(t)


def repeated_spans(docs: DataFrame, length: int = 200, k: int = K, hot: int = HOT) -> DataFrame:
    """doc, th, tn (KEY), spans (array of start and end, in bytes, unmerged): what repeats in each text that has repeats.

    1. Contexts are counted by anchor hash and digest; anchors that occur once are done with.
    2. The places of the others are stored. A context that occurs twice is repeated whole, wherever it is.
    3. Of the rest, only contexts that share an anchor with a different one are sorted, with one representative of each
       kind that occurs twice; their bytes are all the text that is shuffled by anchor.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    kinds = cut(_kinds(keyed, length, k))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, th, tn = (batch.column(c).to_numpy() for c in KEY)
            for owner, h, c, place, lo, hi in context_digests(list(byte_texts(batch, "text")), length, k):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(doc[owner]), pa.array(th[owner]), pa.array(tn[owner]), pa.array(place.astype(np.int32)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16))], names=["h", "c", *KEY, "at", "lo", "hi"])

    found = keyed.mapInArrow(tidy(find), "h long, c long, doc long, th long, tn long, at int, lo short, hi short")
    stored = fresh_path(spark, "anchors")
    found.join(kinds, (F.col("h") == F.col("kh")) & (F.col("c") == F.col("kc"))).drop("kh", "kc").write.parquet(stored)
    places = spark.read.parquet(stored)
    whole = places.filter("many").select(*KEY, (F.col("at") - F.col("hi")).alias("a"), (F.col("at") - F.col("lo") + length).alias("b"))
    asked = ["h", "at", "lo", "hi", "kinds"]
    rest = places.filter("mixed AND NOT many").select(*KEY, *asked)
    one = places.filter("mixed AND many").groupBy("h", "c").agg(F.min(F.struct(*KEY, *asked)).alias("m")).select("m.*")
    per_doc = rest.unionByName(one).groupBy(*KEY).agg(F.collect_set(F.struct("h", "at", "lo", "hi", (F.col("kinds") > hot).alias("hot"))).alias("anchors"))
    with_text = keyed.join(_other(per_doc), _same()).select(*KEY, "text", "anchors")

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("tn", pa.int64()), ("at", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16()), ("hot", pa.bool_()), ("ctx", pa.binary())])
        for batch in slices(batches):
            for r, text in enumerate(byte_texts(batch, "text")):
                own = batch.column("anchors").slice(r, 1).flatten()
                h, at, lo, hi, heat = own.flatten()
                a, x, y = (c.to_numpy() for c in (at, lo, hi))
                own_key = [batch.column(c)[r].as_py() for c in KEY]
                for s in range(0, len(a), 20_000):
                    e = slice(s, s + 20_000)
                    ctx = [text[p - j : p + length - i] for p, i, j in zip(a[e].tolist(), x[e].tolist(), y[e].tolist(), strict=True)]
                    n = len(ctx)
                    yield pa.RecordBatch.from_arrays([h.slice(s, n), *[pa.array(np.full(n, v, np.int64)) for v in own_key], at.slice(s, n), lo.slice(s, n), hi.slice(s, n), heat.slice(s, n), pa.array(ctx, pa.binary())], schema=schema)

    contexts = with_text.mapInArrow(tidy(context), "h long, doc long, th long, tn long, at int, lo short, hi short, hot boolean, ctx binary")

    spans = whole.unionByName(contexts.filter("NOT hot").drop("hot").repartition("h").sortWithinPartitions("h").mapInArrow(tidy(partial(sorted_spans, length=length)), "doc long, th long, tn long, a int, b int"))
    if not kinds.filter(F.col("kinds") > hot).isEmpty():
        spans = spans.unionByName(_hot(contexts.filter("hot").drop("hot"), length))
    return spans.groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _hot(contexts: DataFrame, length: int) -> DataFrame:
    """The same spans for anchors with very many different contexts, without a group that one task holds.

    Equal contexts are counted map-side; the strings of the different ones are counted by their own bytes, which spreads
    an anchor over as many keys as it has strings.
    """
    key = ["h", "lo", "hi", "ctx"]
    kinds = contexts.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
    strings = kinds.select(*key, "c", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("o"))
    strings = strings.withColumn("s", F.substring("ctx", F.col("hi") - F.col("o") + 1, F.lit(length)))
    often = strings.groupBy("h", "o", "s").agg(F.sum("c").alias("n")).filter("n > 1").select(F.col("h").alias("h2"), F.col("o").alias("o2"), F.col("s").alias("s2"))
    hits = strings.join(often, (F.col("h") == F.col("h2")) & (F.col("o") == F.col("o2")) & (F.col("s") == F.col("s2"))).groupBy(*key).agg(F.collect_set("o").alias("starts"))
    hits = hits.select(*[F.col(c).alias(f"k_{c}") for c in key], "starts")
    joined = contexts.join(hits, [F.col(c) == F.col(f"k_{c}") for c in key])
    at = F.col("at") - F.col("o")
    return joined.select(*KEY, "at", F.explode("starts").alias("o")).select(*KEY, at.cast("int").alias("a"), (at + length).cast("int").alias("b"))


def remove_repeats(docs: DataFrame, length: int = 200, k: int = K, hot: int = HOT) -> DataFrame:
    """doc_id, kept (the bytes that are left), n_bytes, n_removed, n_spans and kept_sha256 of every row of docs.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another;
    strings are judged on the input. Null and empty texts have 0 bytes; a null doc_id keeps its row; repeated rows are
    texts of their own and so repeat each other. Other columns are ignored. No string crosses a document's end.
    """
    joined = _keyed(docs).join(_other(repeated_spans(docs, length, k, hot)), _same(), "left")
    own = F.when(F.col("tn") % 2 == 0, F.col("doc")).alias("doc_id")  # the same columns of the texts as above: one shuffle of them serves both
    joined = joined.select(own, "text", "spans")
    kind = "long"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, rows = [], []
            for r, text in enumerate(byte_texts(batch, "text")):
                own = batch.column("spans").slice(r, 1).flatten()
                kept, runs = _strip(text, own)
                left.append(kept)
                rows.append((len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            n, gone, runs, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(tidy(strip), f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_documents(docs: DataFrame, length: int = 200, k: int = K, hot: int = HOT) -> DataFrame:
    """docs with repeated bytes removed from ``text``; other columns as they were, except ``n_chars``, counted anew.

    A character of which a run took a part goes whole. Rows of whose text nothing but white space is left are dropped,
    rows without repeats are untouched, null texts among them.
    """
    joined = docs.withColumns(dict(zip(KEY, _key(), strict=True))).join(_other(repeated_spans(docs, length, k, hot)), _same(), "left").select(*docs.columns, "spans")
    names, flag = docs.columns, spare_name(docs, "_cut")
    place = [c.lower() for c in names].index("text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            *columns, spans = batch.columns
            texts = columns[place].to_pylist()
            for r in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                texts[r] = _strip(texts[r].encode(), spans.slice(r, 1).flatten())[0].decode("utf-8", "ignore")
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, spans.is_valid()], names=[*names, flag])

    # One Python step that no filter on its result can be moved below, which would run it twice and with twice the workers.
    cut_out = joined.mapInArrow(tidy(strip), StructType([*docs.schema, StructField(flag, BooleanType())])).filter(~F.col(flag) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        cut_out = cut_out.withColumn("n_chars", F.when(~F.col(flag), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return cut_out.select(*docs.columns)


def _strip(text: bytes, spans: pa.StructArray) -> tuple[bytes, int]:
    """The text without the union of its spans, and the number of maximal runs that went."""
    if not len(spans):
        return text, 0
    a, b = (c.to_numpy() for c in spans.flatten())
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    starts, ends = a[new], b[np.concatenate([new[1:], [True]])]
    cuts = np.concatenate([[0], np.column_stack([starts, ends]).ravel(), [len(text)]]).tolist()
    return b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)), len(starts)
