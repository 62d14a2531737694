"""Registered queries of the analytics engine over the given tables; tidemark/oracles.py has their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import analysis, features, lookups, metrics, panel, periods, sampling, study, universe
from tidemark.oracles import ORACLES  # noqa: F401
from tidemark.sources import tables

QUERIES: dict = {}
# unit prices of the tables are near 10,000, so the cap and the capital are larger than the defaults
SCALE = {"max_share_price": 20_000.0, "capital": 10_000_000.0}
CFG = Config(**SCALE)
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
DRAWS = CFG.n_bootstrap


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since engines add in different orders; 0 added, for the sign of zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _shortened(column: str, digits: int) -> Column:
    """A column rounded by its product, as the SQL's engine does; figures rounded before are often at half a digit, where ``F.round``, which goes by decimal digits, may go the other way."""
    return (F.round(F.col(column) * 10**digits) / 10**digits).alias(column)


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel; a ticker is in the universe between its first and last price."""
    grid = tables.monthly_panel(spark, sf_dir)
    have = F.when(F.col("close_adj").isNotNull(), F.col("t"))
    w = W.partitionBy("ticker")
    return grid.withColumn("in_universe", F.col("t").between(F.min(have).over(w), F.max(have).over(w)))


def _signals(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return features.signals(_panel(spark, sf_dir), Config(**SCALE, **more))


def _as_of(spark: SparkSession, sf_dir: str) -> int:
    """The last session but one: the last that has a session to trade on."""
    months = tables.table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "MM").alias("date")).distinct()
    return months.filter("date IS NOT NULL").count() - 2


def _monthly_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tables.monthly_cells(spark, sf_dir).select("date")
    return periods.rebalance_calendar(days).withColumn("rf_period", F.lit(CFG.rf_monthly))


def _period_panel(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    at = _monthly_periods(spark, sf_dir)
    return periods.period_panel(_signals(spark, sf_dir, **more), at).join(F.broadcast(at.select("t", "rf_period")), "t")


def _band_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, t, date, r): mean return over the next session of each band."""
    nxt = F.lead("close_adj").over(W.partitionBy("ticker").orderBy("t")) / F.col("close_adj") - 1
    rows = _signals(spark, sf_dir).withColumn("r", nxt).filter("band IS NOT NULL AND r IS NOT NULL")
    return rows.groupBy(F.concat(F.lit("band"), "band").alias("run_id"), "t", "date").agg(F.avg("r").alias("r"))


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _band_returns(spark, sf_dir)
    sign = F.when(F.col("run_id") == "band5", F.col("r")).when(F.col("run_id") == "band1", -F.col("r"))
    both = r.filter(F.col("run_id").isin("band1", "band5")).groupBy("t", "date").agg(F.sum(sign).alias("r"), F.count("*").alias("n"))
    return both.filter("n = 2").select(F.lit("spread").alias("run_id"), "t", "date", "r")


@query
def panel_dense(spark, sf_dir):
    return _rounded(_panel(spark, sf_dir).select("t", "ticker", "close_adj", "close_raw", "open_adj", "in_universe"), 3)


@query
def log_return(spark, sf_dir):
    return _rounded(_panel(spark, sf_dir).select("t", "ticker", features.log_return("close_adj", 3).alias("r3")))


@query
def robust_z(spark, sf_dir):
    r = _panel(spark, sf_dir).withColumn("r3", features.log_return("close_adj", 3))
    return _rounded(features.robust_z(r, "r3", "z", CFG.winsor, CFG.min_count).select("t", "ticker", "z"))


@query
def rs_score(spark, sf_dir):
    return _rounded(features.rs_score(_panel(spark, sf_dir), CFG).select("t", "ticker", "rs_score"))


LARGE = Config(**SCALE, large_sessions=True)


@query
def robust_z_large(spark, sf_dir):
    """``robust_z`` without a session in one task."""
    r = _panel(spark, sf_dir).withColumn("r3", features.log_return("close_adj", 3))
    return _rounded(features.robust_z(r, "r3", "z", LARGE.winsor, LARGE.min_count, large=True).select("t", "ticker", "z"))


@query
def rs_score_large(spark, sf_dir):
    return _rounded(features.rs_score(_panel(spark, sf_dir), LARGE).select("t", "ticker", "rs_score"))


@query
def rs_slope_large(spark, sf_dir):
    return _rounded(features.rs_slope(features.rs_score(_panel(spark, sf_dir), LARGE), LARGE).select("t", "ticker", "rs_slope"), 5)


@query
def rs_slope(spark, sf_dir):
    return _rounded(features.rs_slope(features.rs_score(_panel(spark, sf_dir), CFG), CFG).select("t", "ticker", "rs_slope"), 5)


@query
def sma_flag(spark, sf_dir):
    return features.criteria(_panel(spark, sf_dir), CFG).select("t", "ticker", "above_sma")


@query
def history_flag(spark, sf_dir):
    return features.criteria(_panel(spark, sf_dir), CFG).select("t", "ticker", "enough_history")


@query
def eligibility(spark, sf_dir):
    return features.criteria(_panel(spark, sf_dir), CFG).select("t", "ticker", "eligible")


@query
def eligibility_criteria(spark, sf_dir):
    names = ("in_universe", "has_price", "enough_history", "under_price_cap", "above_sma", "eligible")
    day = features.criteria(_panel(spark, sf_dir), CFG).groupBy("t").agg(*[F.count_if(n).alias(n) for n in names])
    return _rounded(day.agg(*[F.avg(n).alias(n) for n in names]))


@query
def bands(spark, sf_dir):
    return _signals(spark, sf_dir).select("t", "ticker", "band")


@query
def bands_sector_neutral(spark, sf_dir):
    base = _panel(spark, sf_dir).join(tables.sectors(spark, sf_dir).select("ticker", "sector"), "ticker", "left")
    return features.signals(base, Config(**SCALE, sector_neutral=True)).select("t", "ticker", "sector", "band")


def _constituents(spark, sf_dir):
    return universe.normalize_constituents(tables.spells(spark, sf_dir), F.lit("1999-12-31").cast("date"), REGIONS)


@query
def constituents_norm(spark, sf_dir):
    return _constituents(spark, sf_dir).select("code", "name", "sector", "start_date", "end_date", "occurrence", "is_latest", "suspect")


@query
def membership(spark, sf_dir):
    sessions = panel.number_sessions(tables.monthly_cells(spark, sf_dir))
    return universe.membership(_constituents(spark, sf_dir), sessions, drop_reused_prior=True).select("t", "code")


@query
def coverage_monthly(spark, sf_dir):
    return _rounded(universe.coverage(_panel(spark, sf_dir)))


@query
def coverage_by_band(spark, sf_dir):
    s = _signals(spark, sf_dir).filter("eligible").groupBy("date").agg(F.count("*").alias("eligible"), F.count("band").alias("banded"))
    return _rounded(s.withColumn("share", F.try_divide("banded", "eligible")))


@query
def universe_size(spark, sf_dir):
    return _signals(spark, sf_dir).groupBy("date").agg(F.count_if("eligible").alias("n_eligible"))


@query
def price_anomalies(spark, sf_dir):
    r = F.try_divide(F.col("close_adj"), F.lag("close_adj").over(W.partitionBy("ticker").orderBy("t"))) - 1
    hit = _panel(spark, sf_dir).withColumn("r", r).filter(F.abs("r") > 0.6)
    return hit.groupBy("ticker").agg(F.count("*").alias("n"))


def _exclusions(spark, sf_dir):
    """A window of a year for each fifth ticker, the whole series for each eleventh."""
    each = tables.sectors(spark, sf_dir).select("ticker")
    window = each.filter("ticker % 5 = 0").select("ticker", F.lit("1995-01-01").cast("date").alias("start_date"), F.lit("1995-12-31").cast("date").alias("end_date"))
    none = F.lit(None).cast("date")
    return window.union(each.filter("ticker % 11 = 0").select("ticker", none, none))


@query
def exclusions_applied(spark, sf_dir):
    return _rounded(universe.exclude(_panel(spark, sf_dir), _exclusions(spark, sf_dir), ("close_adj", "close_raw")).select("t", "ticker", "close_adj", "close_raw"), 3)


@query
def broken_series(spark, sf_dir):
    return _rounded(universe.broken_series(_panel(spark, sf_dir), extreme=0.5, divergent=0.04))


@query
def suggest_exclusions(spark, sf_dir):
    return universe.suggest_exclusions(universe.broken_series(_panel(spark, sf_dir), extreme=0.5, divergent=0.04))


@query
def price_context(spark, sf_dir):
    return _rounded(analysis.price_context(_panel(spark, sf_dir), 3, 40, 10), 3)


@query
def rebalance_calendar(spark, sf_dir):
    return periods.rebalance_calendar(tables.ship_days(spark, sf_dir), "1993-01-01")


@query
def period_panel(spark, sf_dir):
    return _rounded(_period_panel(spark, sf_dir).select("t", "ticker", "rs_score", "eligible", "band", "open_adj", "px_ff"), 3)


@query
def dead_after(spark, sf_dir):
    return _period_panel(spark, sf_dir).select("ticker", "dead_after").distinct()


@query
def rf_period(spark, sf_dir):
    daily = tables.ship_days(spark, sf_dir).withColumn("rf", F.lit(0.0001) * (F.day("date") % 3))
    return _rounded(periods.rf_periods(periods.rebalance_calendar(tables.ship_days(spark, sf_dir)), daily), 9)


def _selection(name):
    def run(spark, sf_dir):
        return periods.baskets(_period_panel(spark, sf_dir), CFG).filter(F.col("run_id") == name).select("t", "ticker", "ord")

    QUERIES[f"select_{name}"] = run


for _name in ("top", "bottom", "pullback", "mid", "universe"):
    _selection(_name)


@query
def basket_members(spark, sf_dir):
    """What each basket would hold on the last day of each year on which orders were made."""
    day = F.to_date("o_orderdate")
    days = tables.table(spark, sf_dir, "orders").groupBy(F.year(day)).agg(F.max(day).alias("date"))
    return periods.members_at(_signals(spark, sf_dir), days, panel.number_sessions(tables.monthly_cells(spark, sf_dir)), CFG)


@query
def select_random(spark, sf_dir):
    return periods.select_random(_period_panel(spark, sf_dir), DRAWS, CFG.n_names, CFG.seed)


@query
def sample_orders(spark, sf_dir):
    """An exact sample of 500 orders."""
    return sampling.sample_rows(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 500, CFG.seed, "o_orderkey")


@query
def transition_matrix(spark, sf_dir):
    return _rounded(analysis.transitions(_signals(spark, sf_dir), 3))


@query
def dwell_time(spark, sf_dir):
    return _rounded(analysis.dwell(_signals(spark, sf_dir)))


@query
def sessions_in_band(spark, sf_dir):
    return analysis.sessions_in_band(_signals(spark, sf_dir), _as_of(spark, sf_dir))


@query
def snapshot(spark, sf_dir):
    now = analysis.snapshot(_signals(spark, sf_dir), tables.sectors(spark, sf_dir), _as_of(spark, sf_dir), 3)
    return _rounded(analysis.strongest_first(now).drop("date"), 5)


@query
def trails(spark, sf_dir):
    return _rounded(analysis.trails(_signals(spark, sf_dir), _as_of(spark, sf_dir), 12, 3), 5)


@query
def band_sector_matrix(spark, sf_dir):
    now = _signals(spark, sf_dir).filter((F.col("t") == _as_of(spark, sf_dir)) & F.col("band").isNotNull()).join(tables.sectors(spark, sf_dir), "ticker")
    return now.groupBy("sector").pivot("band", [1, 2, 3, 4, 5]).agg(F.count(F.lit(1))).select("sector", *[F.coalesce(F.col(str(b)), F.lit(0)).alias(f"b{b}") for b in range(1, 6)])


@query
def monthly_heatmap(spark, sf_dir):
    r = _spread(spark, sf_dir).withColumns({"year": F.year("date"), "m": F.month("date")}).groupBy("year").pivot("m", list(range(1, 13))).agg(F.avg("r"))
    return _rounded(r.select("year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)]))


@query
def drawdown(spark, sf_dir):
    return _rounded(metrics.max_drawdown(metrics.equity_curve(_band_returns(spark, sf_dir))))


@query
def newey_west(spark, sf_dir):
    return _rounded(metrics.newey_west(_band_returns(spark, sf_dir)))


@query
def perf_metrics(spark, sf_dir):
    return _rounded(metrics.performance(_band_returns(spark, sf_dir), CFG.rf_monthly))


BOUNDS = (("early", "1992-01-01", "1993-12-31"), ("middle", "1994-01-01", "1995-12-31"), ("late", "1996-01-01", "2100-01-01"))


@query
def subperiods(spark, sf_dir):
    return _rounded(metrics.subperiods(_band_returns(spark, sf_dir), BOUNDS))


@query
def subperiods_by_band(spark, sf_dir):
    names = [f"band{b}" for b in range(1, 6)]
    table = metrics.subperiods(_band_returns(spark, sf_dir), BOUNDS).groupBy("label").pivot("run_id", names).agg(F.first("cagr"))
    return _rounded(table.select("label", *names))


@query
def drop_best_months(spark, sf_dir):
    return _rounded(metrics.drop_best(_band_returns(spark, sf_dir), (0, 3, 6, 12)))


@query
def drop_best_by_band(spark, sf_dir):
    names = [f"band{b}" for b in range(1, 6)]
    table = metrics.drop_best(_band_returns(spark, sf_dir), (0, 3, 6, 12)).groupBy("k").pivot("run_id", names).agg(F.first("without"))
    return _rounded(table.select("k", *names))


@query
def rolling_win_rate(spark, sf_dir):
    return _rounded(metrics.rolling_sums(_band_returns(spark, sf_dir), 12, 36))


@query
def positive_years(spark, sf_dir):
    y = _band_returns(spark, sf_dir).groupBy("run_id", F.year("date").alias("y")).agg(F.sum("r").alias("s"))
    return y.groupBy("run_id").agg(F.count_if(F.col("s") > 0).alias("positive"), F.count("*").alias("total"))


@query
def skewness(spark, sf_dir):
    return _rounded(_band_returns(spark, sf_dir).groupBy("run_id").agg(F.skewness("r").alias("skew")), 5)


def _run_means(selections, rows):
    """(run_id, r): mean next return of each run's selections."""
    nxt = F.lead("px_ff").over(W.partitionBy("ticker").orderBy("t")) / F.col("px_ff") - 1
    picked = selections.join(rows.select("t", "ticker", nxt.alias("r")), ["t", "ticker"])
    return picked.filter("r IS NOT NULL").groupBy("run_id").agg(F.avg("r").alias("r"))


def _null(spark, sf_dir):
    """(run_id, r): mean next return of random selections."""
    rows = _period_panel(spark, sf_dir)
    return _run_means(periods.select_random(rows, DRAWS, CFG.n_names, CFG.seed), rows)


@query
def null_quantiles(spark, sf_dir):
    q = (0.05, 0.25, 0.5, 0.75, 0.95)
    return _rounded(_null(spark, sf_dir).agg(*[F.percentile("r", F.lit(x)).alias(f"q{int(x * 100):02d}") for x in q]))


@query
def empirical_pvalue(spark, sf_dir):
    """How many random selections do as well as the basket ``top``."""
    rows = _period_panel(spark, sf_dir)
    top = periods.baskets(rows, CFG).filter("run_id = 'top'")
    return _rounded(metrics.empirical_p(_null(spark, sf_dir), _run_means(top, rows), "r"))


@query
def anomalous_periods(spark, sf_dir):
    return _rounded(analysis.anomalous(_band_returns(spark, sf_dir), 0.1))


@query
def null_histogram(spark, sf_dir):
    return _rounded(lookups.histogram(_null(spark, sf_dir), "r", 20))


def _rf(spark, sf_dir):
    """(t, rf_period) of the monthly periods, from rates that change with the day."""
    daily = tables.ship_days(spark, sf_dir).withColumn("rf", F.lit(0.0001) * (F.day("date") % 3))
    return periods.rf_periods(periods.rebalance_calendar(tables.ship_days(spark, sf_dir)), daily).select("t", "rf_period")


@query
def perf_metrics_dated_rf(spark, sf_dir):
    return _rounded(metrics.performance(_band_returns(spark, sf_dir), _rf(spark, sf_dir)))


def _baskets(spark, sf_dir):
    panel_ = _period_panel(spark, sf_dir)
    dates = _monthly_periods(spark, sf_dir).select("t", F.col("exec_date").alias("date"))
    return periods.basket_returns(periods.baskets(panel_, CFG), panel_).join(dates, "t")


@query
def basket_returns(spark, sf_dir):
    return _rounded(_baskets(spark, sf_dir))


@query
def basket_metrics(spark, sf_dir):
    return _rounded(metrics.basket_metrics(_baskets(spark, sf_dir), _rf(spark, sf_dir), CFG.round_trip_bps), 5)


@query
def fixed_capital_profit(spark, sf_dir):
    return _rounded(lookups.running_sum(_band_returns(spark, sf_dir), scale=CFG.capital, out="profit").select("run_id", "t", "profit"), 3)


@query
def return_overlap(spark, sf_dir):
    r = _band_returns(spark, sf_dir)
    return _rounded(lookups.common_periods(r.filter("run_id = 'band5'"), r.filter("run_id = 'band1'")))


@query
def as_of_sessions(spark, sf_dir):
    """The session at or before, and at or after, each day on which orders were made."""
    days = tables.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return lookups.as_of(days, panel.number_sessions(tables.monthly_cells(spark, sf_dir)))


@query
def month_end_price(spark, sf_dir):
    """Each ticker's last daily price of a month that isn't null."""
    line = tables.table(spark, sf_dir, "lineitem")
    daily = line.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.max(F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") / F.col("l_quantity"))).alias("price"))
    return lookups.month_end(daily, "price", "ticker")


@query
def coverage_by_year(spark, sf_dir):
    return _rounded(universe.coverage_by_year(_panel(spark, sf_dir), least=95))


@query
def sector_map(spark, sf_dir):
    return universe.sector_map(_constituents(spark, sf_dir))


def _member_panel(spark, sf_dir):
    """(t, date, ticker, close_adj, in_universe): members by their spells, prices by the panel."""
    sessions = panel.number_sessions(tables.monthly_cells(spark, sf_dir))
    members = universe.membership(_constituents(spark, sf_dir), sessions, drop_reused_prior=True).select("t", F.substring("code", 2, 12).cast("long").alias("ticker"))
    joined = lookups.joint_panel(tables.monthly_panel(spark, sf_dir), members)
    return joined.join(sessions, "t").select("t", "date", "ticker", F.col("price").alias("close_adj"), F.col("member").alias("in_universe"))


@query
def member_coverage(spark, sf_dir):
    return _rounded(universe.coverage(_member_panel(spark, sf_dir)))


def _listed_exclusions(spark, sf_dir):
    """The exclusions in order, and one of a ticker that isn't there."""
    each = _exclusions(spark, sf_dir).withColumn("ord", F.col("ticker") * 2 + F.col("start_date").isNull().cast("int"))
    absent = spark.range(1).select(F.lit(-1).cast("long").alias("ticker"), F.lit("1995-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(-1).cast("long").alias("ord"))
    return each.unionByName(absent)


@query
def exclusion_report(spark, sf_dir):
    return universe.exclusion_report(_panel(spark, sf_dir), _listed_exclusions(spark, sf_dir), ("close_adj", "close_raw"))


@query
def new_proposals(spark, sf_dir):
    """Proposed exclusions of tickers that aren't excluded yet."""
    proposed = universe.suggest_exclusions(universe.broken_series(_panel(spark, sf_dir), extreme=0.5, divergent=0.04))
    return lookups.among(proposed, _exclusions(spark, sf_dir), "ticker", keep=False)


@query
def excluded_prices(spark, sf_dir):
    """The last sessions' prices of the tickers that have an exclusion."""
    rows = lookups.among(_panel(spark, sf_dir), _exclusions(spark, sf_dir), "ticker")
    return _rounded(rows.groupBy("ticker").agg(F.max_by("close_adj", F.when(F.col("close_adj").isNotNull(), F.col("t"))).alias("close_adj"), F.count("close_adj").alias("n")), 3)


@query
def over_cap(spark, sf_dir):
    return lookups.over_cap(_panel(spark, sf_dir), 24_000.0)


@query
def map_lanes(spark, sf_dir):
    return _rounded(lookups.lanes(tables.sectors(spark, sf_dir).select("ticker", "sector"), REGIONS[:4]))


@query
def feasibility(spark, sf_dir):
    """Whether prices reach the end of each ticker's last spell that has ended."""
    ended = tables.spells(spark, sf_dir).filter("end_date IS NOT NULL")
    con = universe.normalize_constituents(ended, F.lit("1999-12-31").cast("date"), REGIONS).withColumn("is_active_now", F.lit(False))
    return universe.feasibility(con, tables.monthly_cells(spark, sf_dir).select(F.concat(F.lit("S"), "ticker").alias("code"), "date", "close_adj"))


@query
def feasibility_rate(spark, sf_dir):
    return _rounded(universe.feasibility_summary(feasibility(spark, sf_dir)))


@query
def adjusted_opens(spark, sf_dir):
    """Opens of the days of a ticker, adjusted as its close is; a day opens at its first line."""
    line = tables.table(spark, sf_dir, "lineitem")
    unit, net = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    place = F.struct("l_orderkey", "l_linenumber")
    raw = line.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.min_by(unit - 15_000, place).alias("open"), F.max_by(unit, place).alias("close"), F.max_by(net, place).alias("adjusted_close"))
    return panel.adjust(raw).select("ticker", "date", "close_adj", "open_adj", "open_raw")


def _verdict(spark, sf_dir):
    """Band 5 against band 1, with the bands' persistence and the mean of all bands as the reference."""
    r = _band_returns(spark, sf_dir)
    pick = lambda b: F.max(F.when(F.col("run_id") == f"band{b}", F.col("r")))
    monthly = r.groupBy("date").agg(pick(5).alias("win"), pick(1).alias("lose"))
    stay = analysis.transitions(_signals(spark, sf_dir), 3).filter("band = next_band")
    both = stay.agg(F.max(F.when(F.col("band") == 5, F.col("probability"))).alias("win"), F.max(F.when(F.col("band") == 1, F.col("probability"))).alias("lose"))
    return study.verdict_table(monthly, persistence=both, reference=r.groupBy("date").agg(F.avg("r").alias("r")))


@query
def verdict_table(spark, sf_dir):
    return _rounded(_verdict(spark, sf_dir), 5)


def _export(spark, sf_dir, full):
    # the export shortens the figures of the query ``snapshot``, which have five digits
    now = _rounded(analysis.snapshot(_signals(spark, sf_dir), tables.sectors(spark, sf_dir), _as_of(spark, sf_dir), 3), 5)
    parts = {
        "snapshot": now.select("ticker", "name", "sector", "band", "label", "movement", "sessions_in_band", "above_sma", _shortened("rs_score", 3), _shortened("rs_slope", 3), "date"),
        "bands": now.filter("band IS NOT NULL").groupBy("band", "sector").agg(F.count("*").alias("n")),
    }
    returns = _band_returns(spark, sf_dir).select("run_id", "date", _shortened("r", 4))
    return study.export_document(parts, returns if full else None)


@query
def export_compact(spark, sf_dir):
    """A line of JSON for each row of the snapshot and of the bands' counts."""
    return _export(spark, sf_dir, full=False)


@query
def export_full(spark, sf_dir):
    """As the compact form, with each band's returns."""
    return _export(spark, sf_dir, full=True)
