"""Dense long panels and their prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_sessions(dates: DataFrame) -> DataFrame:
    """(date, t): sessions from 0. The window has no partition; it runs over the calendar alone."""
    return dates.select("date").distinct().withColumn("t", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))


def dense(cells: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """A row for each session and ticker, so that windows over rows count sessions.

    Each ticker is expanded by the calendar, which has one row per session and is small beside the panel.
    """
    calendar = number_sessions(cells) if calendar is None else calendar
    days = calendar.agg(F.array_sort(F.collect_list(F.struct("date", "t"))).alias("days"))
    grid = cells.select("ticker").distinct().join(F.broadcast(days)).select("ticker", F.explode("days").alias("d")).select("d.t", "d.date", "ticker")
    return grid.join(cells, ["date", "ticker"], "left")


def adjust(raw: DataFrame) -> DataFrame:
    """Prices (date, ticker, open, close, adjusted_close) with the opens adjusted by adjusted_close / close; opens that aren't positive are null."""
    opened = F.when(F.col("open") > 0, F.col("open"))
    factor = F.when(F.col("close") > 0, F.col("adjusted_close") / F.col("close"))
    return raw.select("date", "ticker", F.col("adjusted_close").alias("close_adj"), (opened * factor).alias("open_adj"), opened.alias("open_raw"), F.col("close").alias("close_raw"))


def assemble(raw: DataFrame, calendar: DataFrame) -> DataFrame:
    """The dense panel (date, ticker, t, close_adj, open_adj, open_raw, close_raw) of raw prices over a ``calendar`` (date, t) of its own; days outside it are left out."""
    return dense(adjust(raw), calendar)


def forward_fill(panel: DataFrame, column: str, out: str) -> DataFrame:
    w = W.partitionBy("ticker").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return panel.withColumn(out, F.last(column, ignorenulls=True).over(w))
