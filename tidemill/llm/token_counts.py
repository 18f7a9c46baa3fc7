"""Token counts by a two-tier lookup: a broadcast table of frequent pre-tokens, then a cache in each worker."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import slices
from .pretokens import PreTokenizer

#: Bounds of the broadcast table: entries, and rows and characters of each of the sample that fills it. They steer speed only, never a count.
TABLE_ENTRIES = 50_000
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000
#: Entries of a worker's cache before it starts anew, and the longest pre-token it keeps.
CACHE_ENTRIES = 400_000
CACHED_CHARS = 64
#: Bytes of texts that a task handles at once, but for longer single texts.
TEXT_BYTES = 2 << 20


def load(path: str) -> Tokenizer:
    """The library's tokenizer, without truncation or padding."""
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Lengths:
    """Token counts of pre-tokens, and what a worker has met of them."""

    def __init__(self, path: str) -> None:
        self.split, self.library = PreTokenizer(path), load(path)
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # pre-tokens are whole
        self.special = dict.fromkeys(self.split.special, 1)
        self.met: dict[str, int] = {}

    def encode(self, pieces: list[str]) -> dict[str, int]:
        """Token counts of different pre-tokens; an added token's string is one token."""
        plain = [x for x in pieces if x not in self.special]
        return self.special | dict(zip(plain, (len(e.ids) for e in self.library.encode_batch(plain, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str], frequent: dict[str, int]) -> np.ndarray:
        """Token counts of texts: the table first, then the cache, then the library for what neither has."""
        pieces, counts = self.split.pieces(texts)
        n = np.fromiter(map(frequent.get, pieces, repeat(0)), np.int64, len(pieces))
        late = np.flatnonzero(n == 0)
        rare = [pieces[k] for k in late.tolist()]
        if len(self.met) > CACHE_ENTRIES:
            self.met.clear()
        new = self.encode([x for x in dict.fromkeys(rare) if x not in self.met])
        n[late] = np.fromiter((new.get(x) or self.met[x] for x in rare), np.int64, len(rare))
        self.met.update((k, v) for k, v in new.items() if len(k) <= CACHED_CHARS)
        return np.diff(np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(counts)]])


@lru_cache(maxsize=4)
def lengths(path: str) -> Lengths:
    """The counter of this worker."""
    return Lengths(path)


def frequent_lengths(df: DataFrame, path: str, text: str = "text", sample_rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a bounded sample; at most ``entries`` of them."""
    counter, seen = lengths(path), Counter()
    for row in df.select(F.substring(F.col(f"`{text}`"), 1, SAMPLE_CHARS).alias("t")).filter("t is not null").limit(sample_rows).toLocalIterator():
        seen.update(x for x in counter.split.pieces([row.t])[0] if len(x) <= CACHED_CHARS)
    return counter.encode([x for x, _ in seen.most_common(entries)])


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024, out: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit"), table: dict[str, int] | None = None) -> DataFrame:
    """Add the bytes of the text, the tokens the library gives for it, and whether they exceed ``limit``.

    ``path`` names a byte-level BPE file on every worker; files with another pre-tokenizer are refused. Null and empty texts have
    0 bytes and 0 tokens. An added or special token's string inside a text is one token, as the library's default has it.
    All input rows and columns stay; an input column with the name of an output is replaced.
    """
    frequent = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, path, text) if table is None else table)
    keep = [c for c in df.columns if c.lower() not in {o.lower() for o in out}]
    names = [f.name for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema]
    kept = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("the_text"))
    schema = ", ".join([f"c{i} {kept.schema[i].dataType.simpleString()}" for i in range(len(keep))] + ["n_bytes long", "n_tokens long", "over_limit boolean"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, first = lengths(path), frequent.value
        for batch in slices(batches, TEXT_BYTES):
            column = batch.column("the_text")
            n = counter.count([v.as_py() or "" for v in column], first)
            size = pa.compute.binary_length(column.cast(pa.large_binary())).fill_null(0).cast(pa.int64())
            cols = [batch.column(i) for i in range(len(keep))] + [size, pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(keep))] + ["n_bytes", "n_tokens", "over_limit"])

    done = kept.mapInArrow(counts, schema)
    return done.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *[F.col(a).alias(b) for a, b in zip(("n_bytes", "n_tokens", "over_limit"), out, strict=True)])
