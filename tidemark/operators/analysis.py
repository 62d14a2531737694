"""Dynamics of bands: transitions, dwell times, snapshots, trails, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABELS = ("Q1 Laggard", "Q2", "Q3", "Q4", "Q5 Leader")


def transitions(signals: DataFrame, h: int, n_bands: int = 5) -> DataFrame:
    """(band, next_band, n, probability) over all pairs of bands; null probabilities where a band never moves on."""
    step = signals.select("band", F.lead("band", h).over(W.partitionBy("ticker").orderBy("t")).alias("next_band")).filter("band IS NOT NULL AND next_band IS NOT NULL")
    counted = step.groupBy("band", "next_band").agg(F.count("*").alias("c"))
    grid = signals.sparkSession.range(n_bands * n_bands).select((F.floor(F.col("id") / n_bands) + 1).cast("int").alias("band"), (F.col("id") % n_bands + 1).cast("int").alias("next_band"))
    full = grid.join(F.broadcast(counted), ["band", "next_band"], "left").withColumn("n", F.coalesce("c", F.lit(0)))
    return full.select("band", "next_band", "n", F.try_divide("n", F.sum("n").over(W.partitionBy("band"))).alias("probability"))


def dwell(signals: DataFrame) -> DataFrame:
    """(band, n, mean, median, longest) of runs of equal bands; sessions without a band neither count nor break."""
    by = W.partitionBy("ticker")
    rows = signals.filter("band IS NOT NULL").withColumn("g", F.row_number().over(by.orderBy("t")) - F.row_number().over(W.partitionBy("ticker", "band").orderBy("t")))
    runs = rows.groupBy("ticker", "band", "g").agg(F.count("*").alias("len"))
    return runs.groupBy("band").agg(F.count("*").alias("n"), F.avg("len").alias("mean"), F.median("len").alias("median"), F.max("len").alias("longest"))


def sessions_in_band(signals: DataFrame, as_of: int) -> DataFrame:
    """(ticker, band, sessions_in_band) at session ``as_of``: sessions since the last other band."""
    past = signals.filter(F.col("t") <= as_of)
    cur = F.max(F.when(F.col("t") == as_of, F.col("band"))).over(W.partitionBy("ticker"))
    marked = past.withColumn("cur", cur).filter("cur IS NOT NULL AND band IS NOT NULL")
    other = F.coalesce(F.max(F.when(F.col("band") != F.col("cur"), F.col("t"))).over(W.partitionBy("ticker")), F.lit(-1))
    return marked.withColumn("b", other).filter("t > b").groupBy("ticker", F.col("cur").alias("band")).agg(F.count("*").alias("sessions_in_band"))


def snapshot(signals: DataFrame, meta: DataFrame, as_of: int, back: int) -> DataFrame:
    """One row per eligible ticker at ``as_of``, with its band ``back`` sessions earlier and its movement; ``strongest_first`` orders them."""
    now = signals.filter((F.col("t") == as_of) & F.col("eligible")).select("ticker", "date", "rs_score", "rs_slope", "band", "above_sma")
    prev = signals.filter(F.col("t") == max(0, as_of - back)).select("ticker", F.col("band").alias("prev_band"))
    out = now.join(prev, "ticker", "left").join(meta, "ticker", "left").join(sessions_in_band(signals, as_of).drop("band"), "ticker", "left")
    moved = F.when(F.col("band") > F.col("prev_band"), "up").when(F.col("band") < F.col("prev_band"), "down").when(F.col("band") == F.col("prev_band"), "flat")
    return out.withColumns({"movement": moved, "label": F.try_element_at(F.array(*map(F.lit, LABELS)), "band")})


def strongest_first(rows: DataFrame) -> DataFrame:
    """By falling score; ties go by ticker, null scores come last."""
    return rows.orderBy(F.desc_nulls_last("rs_score"), "ticker")


def trails(signals: DataFrame, as_of: int, length: int, step: int) -> DataFrame:
    """(t, ticker, rs_score, rs_slope) each ``step`` sessions back from the first of the last ``length``, for tickers with both."""
    first = max(0, as_of - length + 1)
    rows = signals.filter(F.col("t").between(first, as_of) & ((F.col("t") - first) % step == 0))
    return rows.filter("rs_score IS NOT NULL AND rs_slope IS NOT NULL").select("t", "ticker", "rs_score", "rs_slope")


def anomalous(returns: DataFrame, limit: float, plausible: float = 0.3) -> DataFrame:
    """Returns beyond ``limit`` either way, the largest first; ties go by run and period."""
    size = F.abs("r")
    return returns.filter(size > limit).orderBy(size.desc(), "run_id", "t").select("run_id", "t", "r", (size <= plausible).alias("plausible"))


def price_context(panel: DataFrame, ticker: int, at: int, width: int) -> DataFrame:
    """Prices around a session, with the gap between adjusted and raw returns."""
    w = W.partitionBy("ticker").orderBy("t")
    change = lambda c: F.try_divide(F.col(c), F.lag(c).over(w)) - 1
    near = panel.filter((F.col("ticker") == ticker) & F.col("t").between(at - width, at + width))
    out = near.withColumns({"r_adj": change("close_adj"), "r_raw": change("close_raw")})
    return out.select("t", "ticker", "close_adj", "close_raw", "r_adj", "r_raw", F.abs(F.col("r_adj") - F.col("r_raw")).alias("return_gap"))
