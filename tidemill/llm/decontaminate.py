"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices, tidy
from .suffix_dedup import PrefixHash, _mix, _powers

#: Tokens of the shortest tile, which is also the seed, and the share of a test's tokens that tiles must cover.
SEED_TOKENS = 5
COVERAGE = 0.5
#: Bytes of benchmark text that one pass over the documents carries; a larger benchmark takes more passes.
BLOCK_BYTES = 4 << 20
#: Bytes of documents tokenised at once.
PACK = 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one folded buffer, the starts and ends of their tokens in it, and where each text's tokens end."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.diff(np.concatenate([[0], _WORD[buf].view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return _FOLD[buf], start, end, np.searchsorted(start, np.cumsum(sizes))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token of all texts, and where each text's tokens end.

    Tokens are maximal runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased, so neither case nor
    punctuation nor white space hides a passage.
    """
    buf, start, end, ends = _spans(texts)
    return _hashes(buf, start, end), ends


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix(PrefixHash(buf).of(start, end - start)) if len(start) else np.zeros(0, np.uint64)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Rolling (Karp-Rabin) hashes of all runs of ``size`` tokens."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return _mix((total[size:] - total[:-size]) * down[: len(h) - size + 1])


def tile(doc: np.ndarray, test: np.ndarray, least: int = SEED_TOKENS) -> list[tuple[int, int, int]]:
    """Greedy string tiles (place in doc, place in test, length), each token of either side in at most one tile.

    Running Karp-Rabin: rolling hashes of unmarked runs tell whether the two sides share a run of the search length; that
    length is bisected to the longest shared one. Its matches are marked in the order of their places, token by
    token verified, and the search goes on below that length, down to the least tile. A round takes time in proportion to
    both lengths, however often their runs repeat, and no pair of places is listed.
    """
    used_d, used_t = np.zeros(len(doc), bool), np.zeros(len(test), bool)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc), len(test))
    while most >= least:
        low, high, best = least, most, None
        while low <= high:
            size = (low + high + 1) // 2 if best is not None or high < 2 * least else min(high, 2 * low)
            found = _shared(doc, test, used_d, used_t, size)
            if found is None:
                high = size - 1
            else:
                best, low = (size, *found), size + 1
        if best is None:
            break
        most = best[0] - 1
        tiles += _mark(doc, test, used_d, used_t, *best)
    return tiles


def _free(used: np.ndarray, size: int) -> np.ndarray:
    """Whether the run of ``size`` tokens at each place is unmarked."""
    marks = np.concatenate([[0], np.cumsum(used)])
    return marks[size:] == marks[:-size]


def _shared(doc: np.ndarray, test: np.ndarray, used_d: np.ndarray, used_t: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Places in doc and test of unmarked runs whose hashes occur on both sides, and the hashes; None if there are none."""
    hd, ht = windows(doc, size), windows(test, size)
    p, q = np.flatnonzero(_free(used_d, size)), np.flatnonzero(_free(used_t, size))
    p = p[np.isin(hd[p], ht[q])]
    if not len(p):
        return None
    q = q[np.isin(ht[q], hd[p])]
    return p, q, hd[p], ht[q]


def _mark(doc: np.ndarray, test: np.ndarray, used_d: np.ndarray, used_t: np.ndarray, size: int, p: np.ndarray, q: np.ndarray, hp: np.ndarray, hq: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles of the longest length: for each place in doc the first place in test with the same run, both unmarked.

    A place of test that a mark covers stays covered, so each hash's list of places is walked once.
    """
    order = np.argsort(hq, kind="stable")
    values, first = np.unique(hq[order], return_index=True)
    last = np.append(first[1:], len(order))
    group, q = np.searchsorted(values, hp), q[order]
    at, live, end, tiles = first.copy(), len(values), -1, []
    for place, g in zip(p.tolist(), group.tolist(), strict=True):
        if place < end or at[g] == last[g]:
            continue
        k = at[g]
        while k < last[g] and used_t[q[k] : q[k] + size].any():
            k += 1
        at[g] = k
        while k < last[g]:  # beyond the first open place only after a hash collision
            t = int(q[k])
            if not used_t[t : t + size].any() and np.array_equal(doc[place : place + size], test[t : t + size]):
                used_d[place : place + size] = used_t[t : t + size] = True
                tiles.append((place, t, size))
                end = place + size
                break
            k += 1
        live -= at[g] == last[g]
        if not live:
            break
    return tiles


@dataclass
class Block:
    """Tests of one pass: ids, texts, numbers of tokens, and their seeds.

    ``seeds`` are the different hashes, sorted; those of number i are in the tests ``owner[first[i] : first[i + 1]]``, and the places of
    entry j in its test are ``place[begin[j] : begin[j + 1]]``.
    """

    ids: list
    texts: list[bytes]
    sizes: np.ndarray
    seeds: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    begin: np.ndarray
    place: np.ndarray
    sieve: np.ndarray


def make_block(ids: list, texts: list[bytes], least: int = SEED_TOKENS) -> Block:
    """Prepare tests for matching. Tests with fewer tokens than a seed match nothing."""
    h, ends = tokens(texts)
    tests = np.split(h, ends[:-1]) if len(texts) else []
    seeds = [windows(t, least) for t in tests]
    owner = np.repeat(np.arange(len(tests)), [len(s) for s in seeds])
    place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
    flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    order = np.lexsort((owner, flat))
    flat, owner, place = flat[order], owner[order], place[order]
    change = np.ones(len(flat), bool)
    change[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(change)
    different, first = np.unique(flat[begin], return_index=True)
    sieve = np.zeros(1 << 22, bool)
    sieve[(different >> np.uint64(42)).astype(np.int64)] = True
    return Block(ids, texts, np.diff(np.concatenate([[0], ends])), different, np.append(first, len(begin)), owner[begin], np.append(begin, len(flat)), place, sieve)


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in [first, last) of all ranges, and the range that each belongs to."""
    n = last - first
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), np.repeat(np.arange(len(n)), n)


def match_texts(texts: list[bytes], block: Block, least: int, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(text number, test number, tokens covered, tiles) of the pairs whose tiles cover enough of the test.

    A seed counts once for a text and a test, however often it is repeated in them, until a pair is worth tiling. Tiles are made
    over the tokens themselves, numbered by the test's own, so equal hashes of unlike tokens add nothing.
    """
    buf, start, end, ends = _spans(texts)
    w = windows(_hashes(buf, start, end), least)
    hit = np.flatnonzero(block.sieve[(w >> np.uint64(42)).astype(np.int64)])
    number = np.searchsorted(block.seeds, w[hit])
    real = number < len(block.seeds)
    real[real] = block.seeds[number[real]] == w[hit][real]
    hit, number = hit[real], number[real]
    owner = np.searchsorted(ends, hit, "right")
    inside = hit + least <= ends[owner]
    hit, number, owner = hit[inside], number[inside], owner[inside]
    if not len(hit):
        return
    text, seed = np.unique(np.column_stack([owner, number]), axis=0).T
    entry, of = _expand(block.first[seed], block.first[seed + 1])
    text, test = text[of], block.owner[entry]
    order = np.lexsort((test, text))
    text, test, entry = text[order], test[order], entry[order]
    cuts = np.append(np.concatenate([[0], np.flatnonzero((text[1:] != text[:-1]) | (test[1:] != test[:-1])) + 1]), len(text))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i, j = int(text[a]), int(test[a])
        size = int(block.sizes[j])
        if (block.begin[entry[a:b] + 1] - block.begin[entry[a:b]]).sum() * least < coverage * size:
            continue
        p = block.place[_expand(block.begin[entry[a:b]], block.begin[entry[a:b] + 1])[0]]
        seen = np.zeros(size + 1, np.int64)
        np.add.at(seen, p, 1)
        np.add.at(seen, p + least, -1)
        if (np.cumsum(seen)[:-1] > 0).sum() < coverage * size:
            continue  # every tile is made of seeds, so tiles cannot cover more than the seeds do
        known: dict[bytes, int] = {}
        tb, ts, te, _ = _spans([block.texts[j]])
        data = tb.tobytes()
        want = np.array([known.setdefault(data[x:y], len(known) + 1) for x, y in zip(ts.tolist(), te.tolist(), strict=True)], np.uint64)
        # Tiles lie where seeds do: each stretch of seeds is kept, and a token of no test keeps stretches apart.
        mine = owner == i
        mine[mine] = np.isin(number[mine], np.searchsorted(block.first, entry[a:b], "right") - 1)
        spots = hit[mine]
        parts, gap = [], np.zeros(1, np.uint64)
        for run in np.split(spots, np.flatnonzero(np.diff(spots) > least) + 1):
            x, y = int(run[0]), int(run[-1]) + least
            stretch = buf[start[x] : end[y - 1]].tobytes()
            base = int(start[x])
            parts += [np.fromiter((known.get(stretch[u - base : v - base], 0) for u, v in zip(start[x:y].tolist(), end[x:y].tolist(), strict=True)), np.uint64, y - x), gap]
        tiles = tile(np.concatenate(parts), want, least)
        total = sum(x[2] for x in tiles)
        if total >= coverage * size:
            yield i, j, total, len(tiles)


def _packs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    held, first, size = [], 0, 0
    for i, t in enumerate(byte_texts(batch, column)):
        if held and size + len(t) > PACK:
            yield first, held
            held, first, size = [], i, 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def blocks(benchmark: DataFrame, least: int = SEED_TOKENS, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark's distinct (item_id, text) rows in blocks of bounded size; null and empty texts are left out."""
    ids, texts, size = [], [], 0
    rows = benchmark.filter("text IS NOT NULL AND text <> ''").select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        data = r.text.encode()
        if texts and size + len(data) > most:
            yield make_block(ids, texts, least)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(data)
        size += len(data)
    if texts:
        yield make_block(ids, texts, least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = SEED_TOKENS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_tokens, covered, coverage and n_tiles of every document and test that tiles tie together.

    A test leaks into a document if greedy tiles of at least ``least`` tokens cover at least ``coverage`` of its tokens,
    in any order, so a reordered passage is found as well. Documents are read whole, once for each block of the benchmark;
    a block is bounded, and a larger benchmark takes more passes. Null and empty texts and tests match nothing; nor
    do tests shorter than ``least`` tokens. Null ids are kept, repeated documents give repeated rows, other columns are
    ignored. An empty benchmark gives no rows.
    """
    kinds = [d.select(c).schema[0].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_tokens long, covered long, coverage double, n_tiles long"
    rows = docs.select("doc_id", "text")
    out = None
    for block in blocks(benchmark, least, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            names = ["doc_id", "item_id", "item_tokens", "covered", "coverage", "n_tiles"]
            kind = pa.array(b.ids).type if any(i is not None for i in b.ids) else pa.int64()
            for batch in slices(batches):
                who, got = [], []
                for first, texts in _packs(batch, "text"):
                    for i, j, total, n in match_texts(texts, b, least, coverage):
                        who.append(first + i)
                        got.append((b.ids[j], int(b.sizes[j]), total, total / int(b.sizes[j]), n))
                cols = list(zip(*got, strict=True)) or [[]] * 5
                types = [kind, pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(who, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)

        part = rows.mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = SEED_TOKENS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose text no test leaks into, with their own columns; no row is moved or compared by id."""
    for block in blocks(benchmark, least, block_bytes):
        docs = docs.filter(~_leak_test(docs.sparkSession.sparkContext.broadcast(block), least, coverage)(F.col("text")))
    return docs


def _leak_test(shared: Broadcast, least: int, coverage: float) -> Callable[[Column], Column]:
    """A function of a text column: whether some test of the block leaks into the text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            bad = np.zeros(len(column), bool)
            for first, texts in _packs(pa.RecordBatch.from_arrays([column], names=["t"]), "t"):
                for i, *_ in match_texts(texts, shared.value, least, coverage):
                    bad[first + i] = True
            yield pa.array(bad)

    @F.arrow_udf("boolean")
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(run)(batches)

    return leaks
