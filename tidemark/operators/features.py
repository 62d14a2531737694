"""Scores, slopes, eligibility and bands. Null means unavailable, never zero; no row sees later sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators.selection import medians


def _series(last: int | None = None):
    w = W.partitionBy("ticker").orderBy("t")
    return w if last is None else w.rowsBetween(1 - last, 0)


def log_return(price: str, h: int) -> Column:
    logged = F.when(F.col(price) > 0, F.ln(price))
    return logged - F.lag(logged, h).over(_series())


def _local(stats: DataFrame) -> DataFrame:
    """``stats``, which has a row for each session, computed and held by the driver, so that plans don't nest."""
    return stats.sparkSession.createDataFrame(stats.collect(), stats.schema)


def robust_zs(df: DataFrame, outs: dict[str, str], winsor: float = 3.0, min_count: int = 20, large: bool = False) -> DataFrame:
    """Adds for each column of ``outs`` its distance from the session's median in robust deviations, clipped; null on sessions with few values or no spread.

    By default both medians and the count share one exchange by session, which holds one value per ticker:
    right for an index, whose sessions fit in tasks. With ``large``, sessions may have any number of tickers:
    medians come from sketches and counts (``medians``), so no session is gathered in a task, and rows stay
    partitioned as they were; they are read five times, and kept for that.
    """
    names = list(outs)
    if large:
        df = df.persist()
        med = _local(medians(df, ["t"], names))
        apart = df.join(F.broadcast(med), "t").select("t", *[F.abs(F.col(c) - F.col("medians")[k]).alias(c) for k, c in enumerate(names)])
        dev = _local(medians(apart, ["t"], names))
        each = lambda x, out: [F.col(x)[k].alias(f"{out}{k}") for k in range(len(names))]
        stats = med.select("t", *each("medians", "_med"), *each("counts", "_n")).join(dev.select("t", *each("medians", "_dev")), "t")
        df = df.join(F.broadcast(stats), "t", "left")
    else:
        w = W.partitionBy("t")
        df = df.withColumns({f"_med{k}": F.median(c).over(w) for k, c in enumerate(names)} | {f"_n{k}": F.count(c).over(w) for k, c in enumerate(names)})
        df = df.withColumns({f"_dev{k}": F.median(F.abs(F.col(c) - F.col(f"_med{k}"))).over(w) for k, c in enumerate(names)})
    new = {}
    for k, (c, out) in enumerate(outs.items()):
        mad = 1.4826 * F.col(f"_dev{k}")
        ok = F.col(c).isNotNull() & (F.col(f"_n{k}") >= min_count) & (mad > 0)
        new[out] = F.when(ok, F.greatest(F.lit(-winsor), F.least(F.lit(winsor), (F.col(c) - F.col(f"_med{k}")) / mad)))
    return df.withColumns(new).drop(*[f"{x}{k}" for x in ("_med", "_n", "_dev") for k in range(len(names))])


def robust_z(df: DataFrame, column: str, out: str, winsor: float = 3.0, min_count: int = 20, large: bool = False) -> DataFrame:
    """``robust_zs`` of one column."""
    return robust_zs(df, {column: out}, winsor, min_count, large)


def rs_score(panel: DataFrame, cfg: Config, price: str = "close_adj") -> DataFrame:
    """Adds rs_score: the robust z of the mean robust z of all horizons' returns, all of which must be there."""
    names = [f"_r{h}" for h in cfg.horizons]
    out = panel.withColumns({n: log_return(price, h) for n, h in zip(names, cfg.horizons, strict=True)})
    out = robust_zs(out, {n: f"{n}z" for n in names}, cfg.winsor, cfg.min_count, cfg.large_sessions)
    mean = reduce(lambda a, b: a + b, [F.col(f"{n}z") for n in names]) / len(names)
    out = robust_z(out.withColumn("_mean", mean), "_mean", "rs_score", cfg.winsor, cfg.min_count, cfg.large_sessions)
    return out.drop("_mean", *names, *[f"{n}z" for n in names])


def rs_slope(scored: DataFrame, cfg: Config) -> DataFrame:
    """Adds rs_slope: the robust z of the score's regression slope over the window, which must be unbroken."""
    w = _series(cfg.slope_window)
    slope = F.when(F.count("rs_score").over(w) == cfg.slope_window, F.regr_slope(F.col("rs_score"), F.col("t").cast("double")).over(w))
    return robust_z(scored.withColumn("_slope", slope), "_slope", "rs_slope", cfg.winsor, cfg.min_count, cfg.large_sessions).drop("_slope")


def criteria(panel: DataFrame, cfg: Config) -> DataFrame:
    """Adds has_price, enough_history (no hole in the last sessions), under_price_cap, above_sma and eligible; needs in_universe."""
    sma, past = _series(cfg.sma_window), _series(cfg.min_history)
    mean = F.when(F.count("close_adj").over(sma) == cfg.sma_window, F.avg("close_adj").over(sma))
    out = panel.withColumns(
        {
            "has_price": F.col("close_adj").isNotNull(),
            "enough_history": F.count("close_adj").over(past) >= cfg.min_history,
            "under_price_cap": F.coalesce(F.col("open_raw") <= cfg.max_share_price, F.lit(False)),
            "above_sma": F.coalesce(F.col("close_adj") > mean, F.lit(False)),
        }
    )
    every = ["in_universe", "has_price", "enough_history", "under_price_cap"] + ["above_sma"] * cfg.sma_filter
    return out.withColumn("eligible", reduce(lambda a, b: a & b, map(F.col, every)))


def bands(signals: DataFrame, cfg: Config) -> DataFrame:
    """Adds band, 1 (weakest) to n_bands, by average rank among the session's eligible scored rows, within sectors if neutral."""
    part = ["t", "sector"] if cfg.sector_neutral else ["t"]
    ranked = F.col("eligible") & F.col("rs_score").isNotNull()
    if cfg.sector_neutral:
        ranked &= F.col("sector").isNotNull()
    w = W.partitionBy(*part, "_in")
    rank = F.rank().over(w.orderBy("rs_score")) + (F.count("*").over(W.partitionBy(*part, "_in", "rs_score")) - 1) / 2
    band = F.greatest(F.lit(1), F.least(F.lit(cfg.n_bands), F.ceil(rank / F.count("*").over(w) * cfg.n_bands))).cast("int")
    return signals.withColumn("_in", ranked).withColumn("band", F.when(F.col("_in"), band)).drop("_in")


def signals(panel: DataFrame, cfg: Config) -> DataFrame:
    """All of it; ``panel`` has in_universe, and sector for neutral bands.

    Criteria come first, so that they share the panel's order by ticker with the returns: rows then go to their
    session for the score, back to their ticker for the slope, and to their session for the rest.
    """
    return bands(rs_slope(rs_score(criteria(panel, cfg), cfg), cfg), cfg)
