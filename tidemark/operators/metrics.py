"""Metrics and tests of return series (run_id, t, date, r)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.scan import BLOCK, running_growth

# Market regimes (label, first day, last day), bounds included.
SUBPERIODS = (
    ("dot-com crash", "2000-01-01", "2002-12-31"),
    ("recovery 2003-2007", "2003-01-01", "2007-10-31"),
    ("financial crisis", "2007-11-01", "2009-06-30"),
    ("bull 2009-2019", "2009-07-01", "2019-12-31"),
    ("covid 2020", "2020-01-01", "2020-12-31"),
    ("rates 2021-2022", "2021-01-01", "2022-12-31"),
    ("recent", "2023-01-01", "2100-01-01"),
)


def _growth() -> Column:
    return F.product(1 + F.col("r"))


def _cagr(n: Column, grown: Column) -> Column:
    return F.when(grown > 0, F.pow(grown, 12.0 / n) - 1)


def equity_curve(returns: DataFrame) -> DataFrame:
    """Adds equity, from 1, peak, the highest so far, and drawdown from it; series are scanned in blocks of periods, however long one is."""
    returns = returns.persist()  # read twice, and what leads to it is long
    out = running_growth(returns, 1 + F.col("r"), ["run_id"], "t", F.floor(F.col("t") / BLOCK), "equity", "peak")
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def max_drawdown(curve: DataFrame) -> DataFrame:
    """(run_id, depth, trough, peak, recovery, months) of ``curve`` (run_id, date, equity, peak, drawdown); first extremes count.

    Two passes of plain aggregates: the lowest point with its peak, then the peak's date and the return to it.
    """
    curve = curve.persist()
    low = curve.groupBy("run_id").agg(F.min(F.struct("drawdown", "date", "peak")).alias("low"), F.max("date").alias("last"))
    at = curve.select("run_id", "date", "equity").join(low, "run_id")
    reached = F.col("equity") >= F.col("low.peak")
    found = at.groupBy("run_id", "low", "last").agg(F.min(F.when((F.col("date") <= F.col("low.date")) & reached, F.col("date"))).alias("peak"), F.min(F.when((F.col("date") > F.col("low.date")) & reached, F.col("date"))).alias("back"))
    out = found.withColumn("recovery", F.coalesce("back", "last"))
    return out.select("run_id", F.col("low.drawdown").alias("depth"), F.col("low.date").alias("trough"), "peak", "recovery", F.round(F.datediff("recovery", "peak") / 30.44).cast("int").alias("months"))


def newey_west(series: DataFrame, lags: int = 3) -> DataFrame:
    """(run_id, n, mean, t_stat): t of the mean with Bartlett weights; null below 8 values or without spread."""
    e = series.withColumn("e", F.col("r") - F.avg("r").over(W.partitionBy("run_id")))
    w = W.partitionBy("run_id").orderBy("t")
    e = e.withColumns({f"p{k}": F.col("e") * F.lag("e", k).over(w) for k in range(1, lags + 1)})
    n = F.count("e")
    s = F.sum(F.col("e") * F.col("e")) / n + reduce(lambda a, b: a + b, [2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) / n for k in range(1, lags + 1)])
    out = e.groupBy("run_id").agg(n.alias("n"), F.avg("r").alias("mean"), s.alias("s"))
    return out.select("run_id", "n", "mean", F.when((F.col("n") >= 8) & (F.col("s") > 0), F.col("mean") / F.sqrt(F.col("s") / F.col("n"))).alias("t_stat"))


def performance(returns: DataFrame, rf: float | DataFrame) -> DataFrame:
    """(run_id, n, cagr, vol, sharpe, sortino, hit_rate, total) with a constant rate per period, or rates ``rf`` (t, rf_period), 0 where there is none."""
    if isinstance(rf, DataFrame):
        dated = returns.join(rf.select("t", "rf_period"), "t", "left").withColumn("_rf", F.coalesce("rf_period", F.lit(0.0)))
    else:
        dated = returns.withColumn("_rf", F.lit(rf))
    dated = dated.filter("r IS NOT NULL")
    x = F.col("r") - F.col("_rf")
    n = F.count("r")
    out = dated.groupBy("run_id").agg(n.alias("n"), _growth().alias("total"), F.stddev_samp("r").alias("sd"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("xs"), F.stddev_samp(F.when(x < 0, x)).alias("xd"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"))
    ratio = lambda c: F.when(F.col(c) > 0, F.col("mean") / F.col(c) * math.sqrt(12))
    return out.select("run_id", "n", _cagr(F.col("n"), F.col("total")).alias("cagr"), (F.col("sd") * math.sqrt(12)).alias("vol"), ratio("xs").alias("sharpe"), ratio("xd").alias("sortino"), "hit_rate", "total")


def basket_metrics(baskets: DataFrame, rf: DataFrame, round_trip_bps: float) -> DataFrame:
    """``performance`` of baskets (run_id, t, date, r, n, turnover), and max_dd, recovery_months, turnover, positions, cost_drag and final_value (of 1) besides.

    cost_drag is what the turnover costs a year at ``round_trip_bps`` for each name that is replaced.
    """
    baskets = baskets.persist()  # a row for each run and period, read by three branches
    series = baskets.filter("r IS NOT NULL")
    held = baskets.groupBy("run_id").agg(F.avg("turnover").alias("turnover"), F.avg("n").alias("positions"))
    low = max_drawdown(equity_curve(series)).select("run_id", F.col("depth").alias("max_dd"), F.col("months").alias("recovery_months"))
    out = performance(series, rf).withColumnRenamed("total", "final_value").join(low, "run_id").join(held, "run_id")
    return out.withColumn("cost_drag", F.col("turnover") * round_trip_bps / 1e4 * 12)


def subperiods(returns: DataFrame, bounds: tuple[tuple[str, str, str], ...] = SUBPERIODS, least: int = 6) -> DataFrame:
    """(run_id, label, n, total, cagr, vol) of each regime with enough months."""
    inside = lambda b: F.col("date").between(F.lit(b[1]).cast("date"), F.lit(b[2]).cast("date"))
    which = reduce(lambda a, b: F.when(inside(b), F.lit(b[0])).otherwise(a), reversed(bounds), F.lit(None).cast("string"))
    out = returns.withColumn("label", which).filter("label IS NOT NULL").groupBy("run_id", "label").agg(F.count("r").alias("n"), _growth().alias("g"), F.stddev_samp("r").alias("sd"))
    return out.filter(F.col("n") >= least).select("run_id", "label", "n", (F.col("g") - 1).alias("total"), _cagr(F.col("n"), F.col("g")).alias("cagr"), (F.col("sd") * math.sqrt(12)).alias("vol"))


def drop_best(returns: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(run_id, k, cagr, total, without, share): each run's growth with and without its k best months, and the difference; runs of k months or fewer are left out."""
    rank = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("r"), "t"))
    each = returns.filter("r IS NOT NULL").withColumn("i", rank).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    left = F.col("i") > F.col("k")
    out = each.groupBy("run_id", "k").agg(F.count_if(left).alias("n"), _growth().alias("all"), F.product(F.when(left, 1 + F.col("r")).otherwise(1.0)).alias("g")).filter("n > 0")
    return out.select("run_id", "k", _cagr(F.col("n"), F.col("g")).alias("cagr"), (F.col("all") - 1).alias("total"), (F.col("g") - 1).alias("without"), (F.col("all") - F.col("g")).alias("share"))


def rolling_sums(series: DataFrame, *windows: int) -> DataFrame:
    """(run_id, window, n, win_share, median, worst) of full sums over each number of periods of ``windows``."""
    by = W.partitionBy("run_id").orderBy("t")
    full = lambda n: F.when(F.count("r").over(by.rowsBetween(1 - n, 0)) == n, F.sum("r").over(by.rowsBetween(1 - n, 0)))
    each = F.array(*[F.struct(F.lit(n).alias("window"), full(n).alias("s")) for n in windows])
    sums = series.withColumn("each", each).select("run_id", F.explode("each").alias("x")).select("run_id", "x.window", "x.s").filter("s IS NOT NULL")
    return sums.groupBy("run_id", "window").agg(F.count("*").alias("n"), F.avg((F.col("s") > 0).cast("double")).alias("win_share"), F.median("s").alias("median"), F.min("s").alias("worst"))


def empirical_p(null: DataFrame, observed: DataFrame, value: str) -> DataFrame:
    """(n, p): share of null values at least as large as the one of ``observed`` (one row with column ``value``), one added to both counts."""
    seen = null.join(F.broadcast(observed.select(F.col(value).alias("_seen"))))
    out = seen.agg(F.count(value).alias("n"), F.count_if(F.col(value) >= F.col("_seen")).alias("above"))
    return out.select("n", ((F.col("above") + 1) / (F.col("n") + 1)).alias("p"))
