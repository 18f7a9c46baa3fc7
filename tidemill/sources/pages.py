"""Bars kept as pages: a data source that reads only the pages it must, from batch and stream, and refreshes that read only what is new.

A folder holds ``symbol=S/page=K`` folders of Parquet files; page K has the bars whose t // PAGE is K. It may lie in any store that Arrow's
file systems reach; readers on the executors open pages by themselves, and the driver only lists names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Units of time of a page, and pages that one task reads.
PAGE, TASK_PAGES = 240, 16
SCHEMA = "symbol string, t long, open double, high double, low double, close double, volume double"
_ARROW = pa.schema([("symbol", pa.string()), ("t", pa.int64()), *((c, pa.float64()) for c in ("open", "high", "low", "close", "volume"))])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1) if path.startswith("file:") else path)


def write_pages(bars: DataFrame, path: str) -> None:
    """Add the bars (symbol, t, open, high, low, close, volume) to the pages of a folder. A page may get bars in several turns."""
    page = F.floor(F.col("t") / PAGE).cast("long")
    bars.select(*_ARROW.names).withColumn("page", page).repartition("symbol", "page").write.partitionBy("symbol", "page").mode("append").parquet(path)


@dataclass
class Pages(InputPartition):
    """Some pages of one symbol, and the times of them that are wanted (both ends included)."""

    symbol: str
    pages: list[str]
    low: int
    high: int


def listed(path: str) -> Iterator[tuple[str, int, str]]:
    """symbol, page number and folder of each page."""
    store, root = _store(path)
    for folder in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if folder.base_name.startswith("symbol="):
            for page in store.get_file_info(fs.FileSelector(folder.path)):
                if page.base_name.startswith("page="):
                    yield unquote(folder.base_name[7:]), int(page.base_name[5:]), page.path


def rows(path: str, part: Pages) -> Iterator[pa.RecordBatch]:
    """The bars of a partition, as Arrow batches."""
    store, _ = _store(path)
    inside = (ds.field("t") >= part.low) & (ds.field("t") <= part.high)
    for page in part.pages:
        for batch in ds.dataset(page, filesystem=store, format="parquet", schema=pa.schema(list(_ARROW)[1:])).to_batches(filter=inside):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([part.symbol] * batch.num_rows, pa.string()), *batch.columns], schema=_ARROW)


LOWEST, HIGHEST = -(1 << 62), 1 << 62


class PageReader(DataSourceReader):
    """Filters on symbol and t choose pages before any is opened; ``after`` (symbol to time) leaves out what was read before."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.after: dict[str, int] = json.loads(options.get("after", "{}"))
        self.symbols: set[str] | None = None
        self.low, self.high = LOWEST, HIGHEST

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case EqualTo(attribute=("symbol",), value=v):
                    self.symbols = {v} if self.symbols is None else self.symbols & {v}
                case In(attribute=("symbol",), value=v):
                    self.symbols = set(v) if self.symbols is None else self.symbols & set(v)
                case EqualTo(attribute=("t",), value=v):
                    self.low, self.high = max(self.low, v), min(self.high, v)
                case GreaterThan(attribute=("t",), value=v):
                    self.low = max(self.low, v + 1)
                case GreaterThanOrEqual(attribute=("t",), value=v):
                    self.low = max(self.low, v)
                case LessThan(attribute=("t",), value=v):
                    self.high = min(self.high, v - 1)
                case LessThanOrEqual(attribute=("t",), value=v):
                    self.high = min(self.high, v)
                case IsNotNull(attribute=("symbol",) | ("t",)):
                    pass  # no page has such rows
                case _:
                    yield f

    def partitions(self) -> list[Pages]:
        wanted: dict[str, list[tuple[int, str]]] = {}
        for symbol, page, folder in listed(self.path):
            low = max(self.low, self.after.get(symbol, LOWEST) + 1)
            if (self.symbols is None or symbol in self.symbols) and page * PAGE <= self.high and (page + 1) * PAGE > low:
                wanted.setdefault(symbol, []).append((page, folder))
        out = []
        for symbol, pages in sorted(wanted.items()):
            pages.sort()
            low = max(self.low, self.after.get(symbol, LOWEST) + 1)
            out += [Pages(symbol, [f for _, f in pages[k : k + TASK_PAGES]], low, self.high) for k in range(0, len(pages), TASK_PAGES)]
        return out

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return rows(self.path, partition) if partition is not None else iter(())


class PageStream(DataSourceStreamReader):
    """Pages as a stream: an offset names the next page of each symbol. The newest page of a symbol is still being filled and waits
    until there is one after it, or until option ``sealed`` is true."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.sealed = options["path"], options.get("sealed", "false") == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        newest: dict[str, int] = {}
        for symbol, page, _ in listed(self.path):
            newest[symbol] = max(newest.get(symbol, page), page)
        return {s: p + int(self.sealed) for s, p in sorted(newest.items())}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        found: dict[str, list[tuple[int, str]]] = {}
        for symbol, page, folder in listed(self.path):
            if symbol in end and start.get(symbol, page) <= page < end[symbol]:
                found.setdefault(symbol, []).append((page, folder))
        return [Pages(s, [f for _, f in sorted(pages)[k : k + TASK_PAGES]], LOWEST, HIGHEST) for s, pages in sorted(found.items()) for k in range(0, len(pages), TASK_PAGES)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return rows(self.path, partition)


class PagedBars(DataSource):
    """Format ``paged_bars``; options: path, after (JSON: symbol to the last time that was read), sealed (streams)."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedBars)


def read_pages(spark: SparkSession, path: str, after: dict[str, int] | None = None) -> DataFrame:
    """The bars of a folder of pages, later than ``after`` for the symbols it names."""
    register(spark)
    return spark.read.format("paged_bars").option("after", json.dumps(after or {})).load(path)


def refresh(spark: SparkSession, path: str, cache: str) -> int:
    """Bring a cached table up to date and return the number of its new part.

    The table is a folder of parts; a part has the bars later than the last time of each symbol in the parts before it, with the
    number of the refresh that read it. A refresh reads the last times (one row a symbol), then only pages that can hold later bars; run
    again without new pages, or after it was broken off, it changes nothing that was there.
    """
    store, root = _store(cache)
    done = [int(f.base_name[5:]) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("part=") and store.get_file_info(f"{f.path}/_SUCCESS").type == fs.FileType.File]
    number, after = max(done, default=0) + 1, {}
    if done:
        after = {r.symbol: r.t for r in cached(spark, cache).groupBy("symbol").agg(F.max("t").alias("t")).collect()}
    new = read_pages(spark, path, after)
    bar = F.max(F.struct("volume", "close", "high", "low", "open")).alias("bar")  # of bars of one time the fullest, as a rule the last
    new = new.groupBy("symbol", "t").agg(bar).select("symbol", "t", *[f"bar.{c}" for c in _ARROW.names[2:]], F.lit(number).alias("refresh"))
    new.write.mode("overwrite").parquet(f"{cache}/part={number}")
    return number


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """All bars of a cached table, with the refresh that read each."""
    return spark.read.schema(f"{SCHEMA}, refresh int").parquet(f"{cache}/part=*")

