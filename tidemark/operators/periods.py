"""Rebalance calendar, period panel and basket selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators.lookups import as_of
from tidemark.operators.panel import forward_fill
from tidemark.operators.sampling import draw_ranks
from tidemark.operators.scan import running_growth


def rebalance_calendar(days: DataFrame, start: str | None = None) -> DataFrame:
    """(t, decision_date, exec_date): each month's last session and the session after it; the window without a partition runs over the calendar."""
    dated = days.select("date").distinct().withColumn("next", F.lead("date").over(W.orderBy("date")))
    ends = dated.groupBy(F.trunc("date", "MM").alias("m")).agg(F.max(F.struct("date", "next")).alias("x")).select(F.col("x.date").alias("decision_date"), F.col("x.next").alias("exec_date"))
    ends = ends.filter("exec_date IS NOT NULL" + (f" AND exec_date >= date'{start}'" if start else ""))
    return ends.withColumn("t", (F.row_number().over(W.orderBy("decision_date")) - 1).cast("int")).select("t", "decision_date", "exec_date")


def rf_periods(periods: DataFrame, daily: DataFrame) -> DataFrame:
    """Adds rf_period: what the daily rates (date, rf) compound to between a period's execution and the one before."""
    grown = running_growth(daily.select("date", "rf"), 1 + F.col("rf"), [], "date", F.year("date"), "growth").select("date", "growth")
    at = periods.join(grown, grown["date"] == periods["exec_date"], "left").drop("date")
    last = F.lag("growth").over(W.orderBy("t"))
    return at.withColumn("rf_period", F.coalesce(F.col("growth") / last - 1, F.lit(0.0))).drop("growth")


def period_panel(signals: DataFrame, periods: DataFrame) -> DataFrame:
    """(t, ticker, rs_score, rs_slope, eligible, band, open_adj, open_raw, px_ff, dead_after): signals at the decision, prices at the execution.

    The execution is the session after the decision, so that one pass over each ticker's sessions finds both. px_ff is the last known adjusted open, dead_after the last period with one, or -1.
    """
    w = W.partitionBy("ticker").orderBy("t")
    nxt = signals.withColumns({c: F.lead(c).over(w) for c in ("open_adj", "open_raw")})
    at = nxt.withColumnRenamed("t", "session").join(periods.select("t", "decision_date"), F.col("date") == F.col("decision_date"))
    out = forward_fill(at.select("t", "ticker", "rs_score", "rs_slope", "eligible", "band", "open_adj", "open_raw"), "open_adj", "px_ff")
    dead = F.max(F.when(F.col("open_adj").isNotNull(), F.col("t"))).over(W.partitionBy("ticker"))
    return out.withColumn("dead_after", F.coalesce(dead, F.lit(-1)))


def _top(df: DataFrame, run: str, n: int, *order) -> DataFrame:
    """The first n of each period; ties go by ticker."""
    picked = df.withColumn("ord", F.row_number().over(W.partitionBy("t").orderBy(*order, "ticker"))).filter(F.col("ord") <= n)
    return picked.select(F.lit(run).alias("run_id"), "t", "ticker", F.col("ord").cast("int").alias("ord"))


def select_band(panel: DataFrame, run: str, band: int, n: int, strongest: bool = True) -> DataFrame:
    rows = panel.filter((F.col("band") == band) & F.col("rs_score").isNotNull())
    return _top(rows, run, n, F.desc("rs_score") if strongest else F.asc("rs_score"))


def select_pullback(panel: DataFrame, run: str, band: int, n: int) -> DataFrame:
    """The most negative slopes of a band."""
    return _top(panel.filter((F.col("band") == band) & (F.col("rs_slope") < 0)), run, n, F.asc("rs_slope"))


def select_all(panel: DataFrame, run: str) -> DataFrame:
    rows = panel.filter("eligible AND rs_score IS NOT NULL")
    return rows.select(F.lit(run).alias("run_id"), "t", "ticker", F.row_number().over(W.partitionBy("t").orderBy("ticker")).cast("int").alias("ord"))


def select_random(panel: DataFrame, draws: int, n: int, seed: int) -> DataFrame:
    """n eligible tickers for each draw and period, by ranks that ``draw_ranks`` takes: rows are numbered once per period, whatever the number of draws."""
    w = W.partitionBy("t")
    rows = panel.filter("eligible AND rs_score IS NOT NULL").select("t", "ticker", (F.row_number().over(w.orderBy("ticker")) - 1).cast("long").alias("rank"))
    picks = draw_ranks(rows.groupBy("t").agg(F.count("*").alias("m")), draws, n, seed)
    return picks.join(rows, ["t", "rank"]).select(F.concat(F.lit("draw"), "draw").alias("run_id"), "t", "ticker", F.col("ord").cast("int").alias("ord"))


def baskets(panel: DataFrame, cfg: Config) -> DataFrame:
    """The five baskets as runs: top, bottom, pullback, mid and universe, in one pass: each row's ranks among a period's rows of each basket, then a row for each basket it is in."""
    top, mid = cfg.n_bands, (cfg.n_bands + 1) // 2
    scored = F.col("rs_score").isNotNull()
    runs = {
        "top": ((F.col("band") == top) & scored, F.desc("rs_score"), cfg.n_names),
        "bottom": ((F.col("band") == 1) & scored, F.asc("rs_score"), cfg.n_names),
        "pullback": ((F.col("band") == top) & (F.col("rs_slope") < 0), F.asc("rs_slope"), cfg.n_names),
        "mid": ((F.col("band") == mid) & scored, F.desc("rs_score"), cfg.n_names),
        "universe": (F.col("eligible") & scored, F.asc("ticker"), None),
    }
    ranked = panel.select("t", "ticker", "rs_score", "rs_slope", *[F.coalesce(inside, F.lit(False)).alias(f"_in_{run}") for run, (inside, *_) in runs.items()])
    each = []
    for run, (_, order, n) in runs.items():
        place = F.row_number().over(W.partitionBy("t").orderBy(F.desc(f"_in_{run}"), order, "ticker"))
        kept = F.col(f"_in_{run}") & (place <= n) if n else F.col(f"_in_{run}")
        each.append(F.when(kept, F.struct(F.lit(run).alias("run_id"), place.cast("int").alias("ord"))))
    return ranked.select("t", "ticker", F.array_compact(F.array(*each)).alias("e")).select("t", "ticker", F.inline("e")).select("run_id", "t", "ticker", "ord")


def members_at(signals: DataFrame, dates: DataFrame, calendar: DataFrame, cfg: Config) -> DataFrame:
    """(date, run_id, t, ticker, ord): what each basket but the universe would hold if it were made up on each of ``dates`` (date).

    Signals are those of the last session of ``calendar`` (date, t) at or before the date; a date before the
    first session has no rows. Dates that share a session are picked for once.
    """
    found = as_of(dates, calendar).filter("at_or_before IS NOT NULL").select("date", F.col("at_or_before").alias("t"))
    picked = baskets(signals.join(found.select("t").distinct(), "t", "left_semi"), cfg).filter("run_id <> 'universe'")
    return found.join(picked, "t").select("date", "run_id", "t", "ticker", "ord")


def basket_returns(selections: DataFrame, panel: DataFrame) -> DataFrame:
    """(run_id, t, r, n, turnover) of equally weighted baskets from one execution to the next.

    r is null in a period none of whose names has a next price; turnover is the share of names that the period
    before didn't hold.
    """
    nxt = F.lead("px_ff").over(W.partitionBy("ticker").orderBy("t")) / F.col("px_ff") - 1
    held = selections.join(panel.select("t", "ticker", nxt.alias("r")), ["t", "ticker"])
    before = F.lag("t").over(W.partitionBy("run_id", "ticker").orderBy("t"))
    held = held.withColumn("new", F.coalesce(before < F.col("t") - 1, F.lit(True)))
    return held.groupBy("run_id", "t").agg(F.avg("r").alias("r"), F.count("*").alias("n"), F.avg(F.col("new").cast("double")).alias("turnover"))
