"""Daily prices of many symbols, one local file each, as a Spark data source."""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NUMBERS = ("open", "high", "low", "close", "adjusted_close", "volume")
SCHEMA = "symbol string, date date, " + ", ".join(f"{c} double" for c in NUMBERS) + ", error string"
_RANGES = {GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


class Batch(InputPartition):
    """Symbols that one task reads."""

    def __init__(self, symbols: list[str]):
        self.symbols = symbols


class SymbolPrices(DataSource):
    """Files ``<path>/<symbol>.csv`` with a header of date and any of NUMBERS, ascending or not.

    Options: ``path``; ``symbols``, separated by commas (by default all that have a file); ``batch``, the symbols
    of a partition; ``columns``, the numbers wanted, separated by commas: others aren't parsed, and are null.
    A symbol that can't be read gives one row with its error and nothing else, and costs no other symbol.
    """

    @classmethod
    def name(cls) -> str:
        return "symbol_prices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PriceReader:
        return PriceReader(dict(self.options))


class PriceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        listed = options.get("symbols")
        self.symbols = [s.strip() for s in listed.split(",") if s.strip()] if listed is not None else None
        self.batch = int(options.get("batch", 50))
        wanted = options.get("columns")
        self.columns = [c.strip() for c in wanted.split(",")] if wanted is not None else list(NUMBERS)
        if unknown := set(self.columns) - set(NUMBERS):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.ranges: list[tuple[type, datetime.date]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Symbols narrow the files that are planned, ranges of dates what is kept of each file; errors stay, so Spark filters once more."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = [s for s in self._listed() if s in values]
            elif type(f) in _RANGES and f.attribute == ("date",):
                self.ranges.append((type(f), f.value))
            yield f

    def _listed(self) -> list[str]:
        if self.symbols is None:
            self.symbols = sorted(f.removesuffix(".csv") for f in os.listdir(self.path) if f.endswith(".csv"))
        return self.symbols

    def partitions(self) -> list[Batch]:
        symbols = self._listed()
        return [Batch(symbols[k : k + self.batch]) for k in range(0, len(symbols), self.batch)]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        kinds = [("symbol", pa.string()), ("date", pa.date32()), *((c, pa.float64()) for c in NUMBERS), ("error", pa.string())]
        for symbol in partition.symbols if partition else []:
            try:
                columns, error, n = self._file(symbol), None, None
                n = len(columns["date"])
            except (OSError, pa.ArrowException, ValueError) as e:
                columns, error, n = {}, f"{type(e).__name__}: {e}"[:500], 1
            made = {"symbol": pa.array([symbol] * n), "error": pa.array([error] * n, pa.string())} | columns
            yield pa.RecordBatch.from_arrays([made[c].cast(k) if c in made else pa.nulls(n, k) for c, k in kinds], schema=pa.schema(kinds))

    def _file(self, symbol: str) -> dict[str, pa.Array]:
        if os.sep in symbol or symbol.startswith("."):
            raise ValueError(f"not a symbol: {symbol}")
        at = os.path.join(self.path, f"{symbol}.csv")
        with open(at, encoding="utf-8") as f:
            header = [c.strip() for c in f.readline().split(",")]
        if "date" not in header:
            raise ValueError("no column date")
        wanted = ["date", *[c for c in self.columns if c in header]]
        types = {c: pa.date32() if c == "date" else pa.float64() for c in wanted}
        rows = pyarrow.csv.read_csv(at, read_options=pyarrow.csv.ReadOptions(use_threads=False), convert_options=pyarrow.csv.ConvertOptions(include_columns=wanted, column_types=types))
        for kind, value in self.ranges:
            rows = rows.filter(_RANGES[kind](rows["date"], pa.scalar(value, pa.date32())))
        rows = rows.sort_by("date").combine_chunks()
        return {c: rows[c].combine_chunks() if rows.num_rows else pa.nulls(0, types[c]) for c in wanted}


def read_prices(spark: SparkSession, path: str, symbols: list[str] | None = None, columns: tuple[str, ...] = NUMBERS, batch: int = 50) -> tuple[DataFrame, DataFrame]:
    """(prices, failures) of the symbols' files: prices by symbol and date, and (symbol, error) of those that can't be read.

    Filters of symbols and dates on the prices reach the files.
    """
    spark.dataSource.register(SymbolPrices)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    given = {} if symbols is None else {"symbols": ",".join(symbols)}
    load = lambda names: spark.read.format("symbol_prices").options(path=path, columns=",".join(names), batch=str(batch), **given).load()
    prices = load(columns).filter("error IS NULL").select("symbol", "date", *columns)
    return prices, load(columns).filter("error IS NOT NULL").select("symbol", "error")
