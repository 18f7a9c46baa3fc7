"""Byte-level BPE encoding by a pair occurrence index, and decoding."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pretokens import PreTokenizer

#: Entries of a worker's cache of encoded pre-tokens before it starts anew, and the longest pre-token it keeps.
CACHE_ENTRIES, CACHED_CHARS = 400_000, 64
#: Bytes of pre-tokens whose pairs one index covers; a longer pre-token has an index of its own.
INDEX_BYTES = 1 << 19
#: Bytes of texts that a task handles at once, but for longer single texts.
TEXT_BYTES = 1 << 20


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 signs stand for themselves, the other
    bytes in order for the signs from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Merges and vocabulary of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        self.split = PreTokenizer(path)
        model = self.split.file["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError(f"{path} is not a plain byte-level BPE model")
        vocab, signs = model["vocab"], byte_signs()
        self.of_byte = np.array([vocab[s] for s, _ in sorted(signs.items(), key=lambda x: x[1])], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: By rank: the two parts and what they become. By pair of parts: the rank.
        self.steps = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {a << 32 | b: k for k, (a, b, _) in enumerate(self.steps)}
        made = {new: k for k, (_, _, new) in enumerate(self.steps)}
        if len(made) < len(merges) or any(made.get(x, -1) >= k for k, (a, b, _) in enumerate(self.steps) for x in (a, b)):
            raise ValueError(f"{path} makes a token in two ways or uses one before it is made, so ranks are not an order of merging")
        self.first_ranks = np.array([[self.rank.get(a << 32 | b, -1) for b in self.of_byte.tolist()] for a in self.of_byte.tolist()], np.int32)
        size = max([*vocab.values(), *self.split.special.values()]) + 1
        strings = [b""] * size
        for t, k in vocab.items():
            strings[k] = bytes(signs[s] for s in t) if all(s in signs for s in t) else t.encode()
        for t, k in self.split.special.items():
            strings[k] = bytes(signs[s] for s in t) if all(s in signs for s in t) else t.encode()
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.begins = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        #: Ids of pre-tokens that this worker has met; ``encode_texts`` bounds it.
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The token ids of each word.

        The index maps the rank of each pair to all positions where the pair stands, over all words at once. Ranks are
        taken in ascending order; a merge unlinks the right part and enters the two new neighbour pairs in the lists of
        their ranks, which are always higher. Entries that an earlier merge outdated are passed over when their list's turn
        comes; positions go from left to right, so of overlapping pairs the left one is merged.
        """
        joined = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = len(joined)
        closed = np.zeros(n + 1, bool)
        closed[ends] = True
        first = np.where(closed[1:n], -1, self.first_ranks[joined[:-1], joined[1:]]) if n else np.zeros(0, np.int32)
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        active, begin = np.unique(first[order], return_index=True)
        where = dict(zip(active.tolist(), (x.tolist() for x in np.split(order, begin[1:])), strict=True)) if len(active) else {}
        active = active.tolist()
        symbol = self.of_byte[joined].tolist()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[closed[1:]] = -1
        before[closed[:n] | (before < 0)] = -1
        after, before = after.tolist(), before.tolist()
        rank, steps, push, pop = self.rank.get, self.steps, heapq.heappush, heapq.heappop
        while active:
            k = pop(active)
            left, right, new = steps[k]
            ahead = new << 32
            for p in sorted(where.pop(k)):
                if symbol[p] != left or (q := after[p]) < 0 or symbol[q] != right:
                    continue
                symbol[p], symbol[q] = new, -1
                after[p] = r = after[q]
                if r >= 0:
                    before[r] = p
                    if (j := rank(ahead | symbol[r])) is not None:
                        if j in where:
                            where[j].append(p)
                        else:
                            where[j] = [p]
                            push(active, j)
                if (o := before[p]) >= 0 and (j := rank(symbol[o] << 32 | new)) is not None:
                    if j in where:
                        where[j].append(o)
                    else:
                        where[j] = [o]
                        push(active, j)
        ids = np.array(symbol, np.int32)
        kept = np.r_[0, np.cumsum(ids >= 0)]
        ids = ids[ids >= 0]
        return [ids[a:b] for a, b in zip(kept[ends - sizes].tolist(), kept[ends].tolist(), strict=True)]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each of these different pre-tokens, as the bytes of 32-bit integers."""
        out, group, held = {}, [], 0
        for k, piece in enumerate(pieces):
            group.append(piece)
            held += len(piece)
            if held >= INDEX_BYTES or k == len(pieces) - 1:
                out.update(zip(group, (x.tobytes() for x in self.merge([x.encode() for x in group])), strict=True))
                group, held = [], 0
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of the runs of ids; unknown ids stand for nothing, bytes that are no UTF-8 for U+FFFD."""
        known = (ids >= 0) & (ids < len(self.lengths))
        run = np.repeat(np.arange(len(counts)), counts)[known]
        ids = ids[known]
        size = self.lengths[ids]
        ends = np.cumsum(size)
        data = self.flat[np.repeat(self.begins[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.r_[0, np.cumsum(np.bincount(run, weights=size, minlength=len(counts)).astype(np.int64))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]  # noqa: B905  one cut more than texts


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The model of this worker."""
    return ByteBpe(path)


def encode_texts(model: ByteBpe, texts: list[str], cache: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and how many each has. ``cache`` is filled up and bounded here."""
    pieces, counts = model.split.pieces(texts)
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    if not cache:
        cache.update({t: np.int32(k).tobytes() for t, k in model.split.special.items()})
    new = [x for x in dict.fromkeys(pieces) if x not in cache]
    encoded = model.encode_pieces(new)
    cache.update((k, v) for k, v in encoded.items() if len(k) <= CACHED_CHARS)
    long = {k: v for k, v in encoded.items() if len(k) > CACHED_CHARS}
    got = list(map(cache.get, pieces)) if not long else [cache.get(x) or long[x] for x in pieces]
    tokens = np.fromiter(map(len, got), np.int64, len(got)) // 4
    ends = np.r_[0, np.cumsum(counts)]
    sums = np.r_[0, np.cumsum(tokens)]
    return np.frombuffer(b"".join(got), np.int32), np.diff(sums[ends])


def _mapped(df: DataFrame, source: str, outs: dict[str, str], fill: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """All columns of the frame and ``outs`` (names and types), which ``fill`` gives for each slice of ``source`` inside the tasks."""
    taken = {o.lower() for o in outs}
    keep = [c for c in df.columns if c.lower() not in taken]
    kept = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{source}`").alias("the_source"))
    names = [f"c{i}" for i in range(len(keep))] + [f"made{i}" for i in range(len(outs))]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, [*(f.dataType.simpleString() for f in kept.schema.fields[:-1]), *outs.values()], strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fill()
        for batch in slices(batches, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *make(batch.column("the_source"))], names=names)

    return kept.mapInArrow(work, schema).select(*[F.col(n).alias(c) for n, c in zip(names, [*keep, *outs], strict=True)])


def _id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of each whole text as an array, as the library gives them without added special tokens.

    ``path`` names a byte-level BPE file on every worker. Null and empty texts have no ids; added tokens' strings inside a
    text are those tokens. Rows and other columns stay, repeated ones too; an input column named ``out`` is replaced. A task
    holds a slice of bounded bytes, or one text, and one index over the slice's new pre-tokens.
    """

    def fill() -> Callable[[pa.Array], list[pa.Array]]:
        model = load(path)
        return lambda column: [_id_lists(*encode_texts(model, [v.as_py() or "" for v in column], model.cache))]

    return _mapped(df, text, {out: "array<int>"}, fill)


def _decoded(model: ByteBpe, column: pa.Array) -> pa.Array:
    column = column.cast(pa.list_(pa.int64()))
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(model.decode(column.flatten().fill_null(-1).to_numpy(zero_copy_only=False), counts), pa.string())


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that each array of token ids stands for, special tokens included.

    A null array is an empty text; null or unknown ids stand for nothing; bytes that are no UTF-8 become U+FFFD.
    """

    def fill() -> Callable[[pa.Array], list[pa.Array]]:
        model = load(path)
        return lambda column: [_decoded(model, column)]

    return _mapped(df, ids, {out: "string"}, fill)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass, so the ids go through one Python worker only."""

    def fill() -> Callable[[pa.Array], list[pa.Array]]:
        model = load(path)

        def both(column: pa.Array) -> list[pa.Array]:
            lists = _id_lists(*encode_texts(model, [v.as_py() or "" for v in column], model.cache))
            return [lists, _decoded(model, lists)]

        return both

    return _mapped(df, text, {ids: "array<int>", out: "string"}, fill)
