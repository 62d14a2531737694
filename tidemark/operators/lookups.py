"""Lookups by date, list and place: as-of sessions, semi and anti joins, month ends, histograms, lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def as_of(dates: DataFrame, calendar: DataFrame, column: str = "date") -> DataFrame:
    """(date, at_or_before, at_or_after) for each distinct date of ``dates``: session numbers of ``calendar`` (date, t), null where there is none.

    The windows have no partition: they run over distinct days, those looked up and those of the calendar.
    """
    asked = dates.select(F.col(column).alias("date")).filter("date IS NOT NULL").distinct().withColumns({"t": F.lit(None).cast("int"), "asked": F.lit(True)})
    days = asked.unionByName(calendar.select("date", "t", F.lit(False).alias("asked")))
    past = W.orderBy("date").rangeBetween(W.unboundedPreceding, W.currentRow)
    later = W.orderBy("date").rangeBetween(W.currentRow, W.unboundedFollowing)
    found = days.withColumns({"at_or_before": F.max("t").over(past), "at_or_after": F.min("t").over(later)})
    return found.filter("asked").select("date", "at_or_before", "at_or_after")


def among(rows: DataFrame, listed: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """The rows whose key is listed or, without ``keep``, those whose key isn't; null keys are never listed."""
    return rows.join(listed.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def common_periods(a: DataFrame, b: DataFrame, on: str = "date") -> DataFrame:
    """(date, a, b): two series (date, r) on the dates that both have."""
    return a.select(on, F.col("r").alias("a")).join(b.select(on, F.col("r").alias("b")), on).filter("a IS NOT NULL AND b IS NOT NULL")


def joint_panel(prices: DataFrame, members: DataFrame) -> DataFrame:
    """(t, ticker, price, member) of the tickers and sessions of either panel; who isn't listed as a member is none."""
    a = prices.select("t", "ticker", F.col("close_adj").alias("price"))
    b = members.select("t", "ticker").distinct().withColumn("member", F.lit(True))
    return a.join(b, ["t", "ticker"], "full").withColumn("member", F.coalesce("member", F.lit(False)))


def month_end(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The last value of each month that isn't null, for each of ``keys``; months without any are left out."""
    known = rows.filter(F.col(value).isNotNull())
    return known.groupBy(*keys, F.trunc("date", "MM").alias("month")).agg(F.max_by(value, "date").alias(value))


def over_cap(panel: DataFrame, cap: float) -> DataFrame:
    """(ticker, sessions) of the members whose price was ever above ``cap``, and on how many sessions."""
    above = F.coalesce((F.col("open_raw") > cap) & F.col("in_universe"), F.lit(False))
    return panel.groupBy("ticker").agg(F.count_if(above).alias("sessions")).filter("sessions > 0")


def histogram(values: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the largest value, empty ones included; the largest belongs to the last bin."""
    range_ = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).filter("lo IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = values.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(range_)).groupBy(at.alias("bin")).agg(F.count("*").alias("c"))  # one row
    every = range_.select("lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    low = F.col("lo") + F.col("bin") * F.col("width")
    return every.join(counted, "bin", "left").select("bin", low.alias("low"), (low + F.col("width")).alias("high"), F.coalesce("c", F.lit(0)).alias("n"))


def running_sum(series: DataFrame, value: str = "r", scale: float = 1.0, out: str = "running") -> DataFrame:
    """Adds the sum of a run's values so far, times ``scale``: the profit at constant capital."""
    w = W.partitionBy("run_id").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    return series.withColumn(out, scale * F.sum(value).over(w))


def lanes(rows: DataFrame, sectors: tuple[str, ...], half_width: float = 0.38) -> DataFrame:
    """Adds x: the lane of the ticker's sector, and in it a place by the alphabet, evenly from -half_width to half_width; null without a lane."""
    by = W.partitionBy("sector")
    lane = F.array_position(F.array(*map(F.lit, sectors)), F.col("sector")) - 1
    k, i = F.count("*").over(by), F.row_number().over(by.orderBy("ticker")) - 1
    offset = F.when(k > 1, -half_width + i * (2 * half_width) / (k - 1)).otherwise(0.0)
    return rows.withColumn("x", F.when(F.coalesce(lane, F.lit(-1)) >= 0, lane + offset))


def month_label(date: str) -> Column:
    """Month and year in words, whatever the session's language is."""
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS)), F.month(date)), F.year(date))
