"""Constituents, membership, coverage; exclusions and broken series."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lookups import as_of

# Names of sectors, by the names that sources use.
ALIASES = {
    "technology": "Information Technology",
    "information technology": "Information Technology",
    "consumer cyclical": "Consumer Discretionary",
    "consumer discretionary": "Consumer Discretionary",
    "consumer defensive": "Consumer Staples",
    "consumer staples": "Consumer Staples",
    "healthcare": "Health Care",
    "health care": "Health Care",
    "financial services": "Financials",
    "financial": "Financials",
    "financials": "Financials",
    "basic materials": "Materials",
    "materials": "Materials",
    "industrials": "Industrials",
    "industrial goods": "Industrials",
    "energy": "Energy",
    "utilities": "Utilities",
    "real estate": "Real Estate",
    "communication services": "Communication Services",
    "communication": "Communication Services",
}


def sector_name(column, known: tuple[str, ...] = ()):
    """The sector by its alias, or by its own name among ``known``; "unclassified" otherwise."""
    names = F.create_map(*[F.lit(x) for k, v in (ALIASES | {k.lower(): k for k in known}).items() for x in (k, v)])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(column))), F.lit("unclassified"))


def _day(column: str):
    return F.to_date(F.expr(f"try_cast({column} AS timestamp)"))


def normalize_constituents(spells: DataFrame, today, known: tuple[str, ...] = ()) -> DataFrame:
    """Clean spells (dates that don't parse are null) with their occurrence number, whether they are their code's latest, and whether the code looks reused."""
    clean = spells.withColumns({"code": F.upper(F.trim("code")), "sector": sector_name("sector", known), "start_date": _day("start_date"), "end_date": F.coalesce(_day("end_date"), today)})
    clean = clean.filter("code IS NOT NULL AND start_date IS NOT NULL AND end_date >= start_date")
    by = W.partitionBy("code")
    ordered = by.orderBy("start_date", "end_date", "name")
    out = clean.withColumns({"occurrence": F.row_number().over(ordered).cast("int"), "n_spells": F.count("*").over(by).cast("int"), "n_names": F.size(F.collect_set("name").over(by))})
    return out.withColumns({"is_latest": F.col("occurrence") == F.col("n_spells"), "suspect": (F.col("n_spells") > 1) | (F.col("n_names") > 1)})


def membership(constituents: DataFrame, calendar: DataFrame, drop_reused_prior: bool = False) -> DataFrame:
    """(t, date, code) of the sessions inside any spell: a spell's bounds are looked up in the calendar, then it expands to the sessions between."""
    if drop_reused_prior:
        constituents = constituents.filter("is_latest OR NOT suspect")
    days = as_of(constituents.select("start_date").union(constituents.select("end_date")), calendar, "start_date")
    first, last = days.select(F.col("date").alias("start_date"), F.col("at_or_after").alias("t0")), days.select(F.col("date").alias("end_date"), F.col("at_or_before").alias("t1"))
    spans = constituents.select("code", "start_date", "end_date").join(first, "start_date").join(last, "end_date").filter("t0 <= t1")
    inside = spans.select("code", F.explode(F.sequence("t0", "t1")).alias("t")).distinct()
    return inside.join(calendar.select("t", "date"), "t").select("t", "date", "code")


def sector_map(constituents: DataFrame) -> DataFrame:
    """(code, sector) of each code's latest spell."""
    return constituents.filter("is_latest").groupBy("code").agg(F.max_by("sector", "occurrence").alias("sector"))


def coverage(panel: DataFrame) -> DataFrame:
    """(month, members, priced, missing, coverage): of the last session of each month; coverage is null without members."""
    member = F.col("in_universe")
    day = panel.groupBy("date").agg(F.count_if(member).alias("members"), F.count_if(member & F.col("close_adj").isNotNull()).alias("priced"))
    last = day.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max_by(F.struct("members", "priced"), "date").alias("x"))
    return last.select("month", "x.members", "x.priced", (F.col("x.members") - F.col("x.priced")).alias("missing"), F.try_divide("x.priced", "x.members").alias("coverage"))


def coverage_by_year(panel: DataFrame, least: int = 480) -> DataFrame:
    """(year, coverage, members, thin): mean of the months' coverage, median of the sessions' members, and whether these are fewer than ``least``."""
    months = coverage(panel).groupBy(F.year("month").alias("year")).agg(F.avg("coverage").alias("coverage"))
    days = panel.groupBy("date").agg(F.count_if("in_universe").alias("n")).groupBy(F.year("date").alias("year")).agg(F.median("n").alias("members"))
    return months.join(days, "year").withColumn("thin", F.col("members") < least)


def _bounds() -> list[Column]:
    return [F.coalesce("start_date", F.lit("0001-01-01").cast("date")).alias("date"), F.coalesce("end_date", F.lit("9999-12-31").cast("date")).alias("_hi")]


def _swept(prices: DataFrame, windows: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """Prices and windows (ticker, date, ...) in one table, and the frame of all that begins at or before a price.

    A window stands before the prices of its first day. So one pass in order of days meets both, however many
    windows a ticker has.
    """
    both = prices.withColumn("_price", F.lit(True)).unionByName(windows.withColumn("_price", F.lit(False)), allowMissingColumns=True)
    return both, W.partitionBy("ticker").orderBy("date", "_price").rowsBetween(W.unboundedPreceding, 0)


def exclude(prices: DataFrame, exclusions: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Prices with nulls inside exclusion windows; a window without bounds covers the whole series.

    A day is excluded if the latest end of the windows begun so far isn't before it: overlapping and nested
    windows need no merging.
    """
    both, past = _swept(prices, exclusions.select("ticker", *_bounds()))
    hit = F.coalesce(F.max("_hi").over(past) >= F.col("date"), F.lit(False))
    return both.withColumn("_hit", hit).filter("_price").withColumns({c: F.when(~F.col("_hit"), F.col(c)) for c in columns}).select(*prices.columns)


def _first_windows(key, rows):
    """Disjoint stretches of a ticker's windows, each with the smallest ``ord`` of the windows that cover it."""
    ends = []
    starts = sorted((lo, o, hi) for lo, hi, o in zip(rows["lo"], rows["hi"], rows["ord"], strict=True))
    edges = sorted({lo for lo, *_ in starts} | {hi + 1 for *_, hi in starts})
    out, k = [], 0
    for a, b in zip(edges, edges[1:], strict=False):
        while k < len(starts) and starts[k][0] <= a:
            heapq.heappush(ends, (starts[k][1], starts[k][2]))
            k += 1
        while ends and ends[0][1] < a:
            heapq.heappop(ends)
        if ends:
            out.append((key[0], a, b - 1, ends[0][0]))
    return pd.DataFrame(out, columns=["ticker", "lo", "hi", "ord"])


def exclusion_report(prices: DataFrame, exclusions: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(ticker, start_date, end_date, applied, removed) for each row of ``exclusions``, whose ``ord`` gives their order.

    removed is the number of values that the window takes away, in the column where it takes most; a value that
    several windows cover counts for the first. A ticker without prices is reported as not applied. A ticker's
    windows become disjoint stretches by one sweep, which a second sweep with the prices then meets.
    """
    # days as numbers, since open windows lie outside the range of pandas' dates
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    lo, hi = _bounds()
    windows = exclusions.select("ticker", number(lo).alias("lo"), number(hi).alias("hi"), F.col("ord").cast("long").alias("ord"))
    kind = prices.schema["ticker"].dataType.simpleString()
    stretches = windows.groupBy("ticker").applyInPandas(_first_windows, f"ticker {kind}, lo long, hi long, ord long")
    both, past = _swept(prices.select("ticker", number("date").alias("date"), *columns), stretches.select("ticker", F.col("lo").alias("date"), F.struct("hi", "ord").alias("_w")))
    met = both.withColumn("_w", F.last("_w", ignorenulls=True).over(past)).filter(F.col("_price") & (F.col("_w.hi") >= F.col("date")))
    taken = met.groupBy(F.col("_w.ord").alias("ord")).agg(F.greatest(*[F.count(c) for c in columns], F.lit(0)).alias("removed"))
    present = prices.select("ticker").distinct().withColumn("applied", F.lit(True))
    out = exclusions.join(present, "ticker", "left").join(taken, "ord", "left")
    return out.select("ticker", "start_date", "end_date", F.coalesce("applied", F.lit(False)).alias("applied"), F.coalesce("removed", F.lit(0)).alias("removed"))


def broken_series(panel: DataFrame, extreme: float = 0.6, divergent: float = 0.25, reversal: float = 0.5) -> DataFrame:
    """Per ticker with a suspect day: counts of extreme, divergent and reversed returns, dates, and whether it is nearly certain."""
    w = W.partitionBy("ticker").orderBy("t")
    change = lambda c: F.try_divide(F.col(c), F.lag(c).over(w)) - 1
    logged = F.when(F.col("close_adj") > 0, F.ln("close_adj"))
    x = panel.withColumns({"r": change("close_adj"), "raw": change("close_raw"), "lr": logged - F.lag(logged).over(w)})
    x = x.withColumn("next", F.lead("lr").over(w))
    big = F.coalesce(F.abs("r") > extreme, F.lit(False))
    apart = F.coalesce(F.abs(F.col("r") - F.col("raw")) > divergent, F.lit(False))
    back = big & F.coalesce(F.abs(F.col("lr") + F.col("next")) < reversal * F.abs("lr"), F.lit(False))
    x = x.withColumns({"big": big, "apart": apart, "back": back}).filter("big OR apart")
    n = lambda c: F.count_if(c).alias(f"n_{c}")
    out = x.groupBy("ticker").agg(n("big"), n("apart"), n("back"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max(F.abs("r")).alias("max_abs_return"))
    return out.withColumn("near_certain", (F.col("n_apart") > 0) | (F.col("n_back") > 0))


def suggest_exclusions(broken: DataFrame, pad: int = 45) -> DataFrame:
    reason = F.concat_ws("; ", F.concat(F.lit("extreme "), "n_big"), F.concat(F.lit("divergent "), "n_apart"), F.concat(F.lit("reversed "), "n_back"))
    return broken.select("ticker", F.date_sub("first_date", pad).alias("start_date"), F.date_add("last_date", pad).alias("end_date"), reason.alias("reason"))


def feasibility(constituents: DataFrame, prices: DataFrame, slack: int = 30) -> DataFrame:
    """(code, sector, end_date, first_price, last_price, outcome) of each latest spell that has ended: whether prices reach its end, ``slack`` days short of it at most."""
    seen = prices.filter("close_adj IS NOT NULL").groupBy("code").agg(F.min("date").alias("first_price"), F.max("date").alias("last_price"))
    left = constituents.filter("is_latest AND NOT is_active_now").select("code", "sector", "end_date").join(seen, "code", "left")
    outcome = F.when(F.col("last_price").isNull(), "no data").when(F.col("last_price") >= F.date_sub("end_date", slack), "ok").otherwise("truncated")
    return left.withColumn("outcome", outcome)


def feasibility_summary(report: DataFrame, good: float = 0.98, fair: float = 0.90) -> DataFrame:
    """(n, usable, rate, sector_known, earliest, verdict): the share of ended spells whose prices are usable, the share whose sector is classified, the first price, and what it is good for."""
    known = F.avg((F.coalesce("sector", F.lit("unclassified")) != "unclassified").cast("double"))
    out = report.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "ok").alias("usable"), known.alias("sector_known"), F.min("first_price").alias("earliest"))
    out = out.withColumn("rate", F.try_divide("usable", "n"))
    verdict = F.when(F.col("rate") >= good, "excellent").when(F.col("rate") >= fair, "acceptable").otherwise("insufficient")
    return out.select("n", "usable", "rate", "sector_known", "earliest", verdict.alias("verdict"))
