"""Properties of the operators."""

import datetime
import json
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import analysis, features, lookups, metrics, panel, periods, sampling, scan, selection, study, universe
from tidemark.sources import files, prices

DAY = datetime.date(2015, 1, 1)


def walk(spark, days=60, names=20, seed=7, hole=None):
    rng, rows = random.Random(seed), []
    for k in range(names):
        p = 100.0
        for t in range(days):
            p *= math.exp(rng.gauss(0.0004, 0.018))
            rows.append((DAY + datetime.timedelta(t), k, None if (t, k) == hole else p))
    df = panel.dense(spark.createDataFrame(rows, "date date, ticker long, close_adj double"))
    return df.withColumns({"open_adj": F.col("close_adj"), "open_raw": F.col("close_adj"), "close_raw": F.col("close_adj"), "in_universe": F.lit(True)})


def scores(df, upto=None):
    rows = features.rs_slope(features.rs_score(df, Config()), Config()).select("t", "ticker", "rs_score", "rs_slope").collect()
    return {(r.t, r.ticker): (r.rs_score, r.rs_slope) for r in rows if upto is None or r.t <= upto}


def test_no_look_ahead(spark):
    df = walk(spark, days=40)
    whole, part = scores(df, 29), scores(df.filter("t < 30"))
    assert whole.keys() == part.keys()
    for k, (a, b) in part.items():
        assert (a is None) == (whole[k][0] is None) and (b is None) == (whole[k][1] is None)
        assert a is None or abs(a - whole[k][0]) < 1e-9


def test_scale_invariance_and_null_counts(spark):
    df = walk(spark, days=40, hole=(20, 3))
    a = scores(df)
    b = scores(df.withColumn("close_adj", F.col("close_adj") * (F.col("ticker") + 1)))
    assert all((x[0] is None) == (b[k][0] is None) for k, x in a.items())
    assert all(abs(x[0] - b[k][0]) < 1e-9 for k, x in a.items() if x[0] is not None)
    assert a[(20, 3)][0] is None and a[(32, 3)][0] is None and a[(33, 3)][0] is not None  # the hole and the 12 sessions after it that look back on it
    assert sum(x[0] is None for x in a.values()) == 12 * 20 + 4  # the first sessions, and where a horizon meets the hole


def test_outlier_is_clipped_and_null_stays_null(spark):
    df = spark.createDataFrame([(0, float(i) if i else None) for i in range(30)] + [(0, 1e6)], "t int, x double")
    z = [r.z for r in features.robust_z(df, "x", "z").collect()]
    assert z.count(None) == 1 and max(v for v in z if v is not None) == 3.0
    flat = spark.createDataFrame([(0, 1.0)] * 30, "t int, x double")
    assert all(r.z is None for r in features.robust_z(flat, "x", "z").collect())


def test_bands_are_balanced_with_ties(spark):
    df = spark.createDataFrame([(0, k, float(k // 2), True) for k in range(50)], "t int, ticker long, rs_score double, eligible boolean")
    n = {r.band: r["count"] for r in features.bands(df, Config()).groupBy("band").count().collect()}
    assert n == {b: 10 for b in range(1, 6)}


def test_history_needs_unbroken_sessions(spark):
    got = features.criteria(walk(spark, days=40, names=2, hole=(20, 0)), Config(min_history=5)).filter("ticker = 0").collect()
    assert [r.t for r in got if r.enough_history] == [t for t in range(4, 40) if not 20 <= t <= 24]


def test_constituents(spark):
    d = lambda y: datetime.date(y, 1, 1)
    rows = [(" aa ", "A", " TECHNOLOGY", d(2000), d(2001)), ("AA", "B", None, d(2005), None), ("BB", None, "Energy", d(2003), d(2002)), (None, "x", "x", d(2000), None)]
    con = universe.normalize_constituents(spark.createDataFrame(rows, "code string, name string, sector string, start_date date, end_date date"), F.lit("2010-01-01").cast("date"), ("Energy",))
    got = {(r.code, r.occurrence): r for r in con.collect()}
    assert set(got) == {("AA", 1), ("AA", 2)} and got["AA", 2].is_latest and got["AA", 1].suspect
    assert got["AA", 1].sector == "Information Technology" and got["AA", 2].sector == "unclassified"
    cal = panel.number_sessions(spark.createDataFrame([(d(2000),), (d(2003),), (d(2006),)], "date date"))
    assert [r.date.year for r in universe.membership(con, cal).orderBy("t").collect()] == [2000, 2006]
    assert [r.date.year for r in universe.membership(con, cal, drop_reused_prior=True).collect()] == [2006]


def test_detectors_and_exclusions(spark):
    rows = [(DAY + datetime.timedelta(t), 1, 300.0 if t == 10 else 100.0, 300.0 if t == 10 else 100.0) for t in range(20)]
    rows += [(DAY + datetime.timedelta(t), 2, 100.0, 50.0 if t >= 10 else 100.0) for t in range(20)]
    df = panel.dense(spark.createDataFrame(rows, "date date, ticker long, close_adj double, close_raw double"))
    got = {r.ticker: r for r in universe.broken_series(df).collect()}
    assert got[1].n_back == 1 and got[1].near_certain and got[2].n_apart == 1 and got[2].n_big == 0
    x = spark.createDataFrame([(1, DAY, None), (2, None, None)], "ticker long, start_date date, end_date date")
    assert universe.exclude(df, x, ("close_adj",)).filter("close_adj IS NOT NULL").count() == 0


def test_baskets_and_turnover(spark):
    rows = [(t, k, 100.0 * (1.01 + 0.01 * k) ** t if not (k == 1 and t == 3) else None) for t in range(4) for k in range(3)]
    px = spark.createDataFrame(rows, "t int, ticker long, px_ff double")
    picks = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 3, 2)], "run_id string, t int, ticker long")
    got = {r.t: r for r in periods.basket_returns(picks, px).collect()}
    assert abs(got[0].r - 0.015) < 1e-9 and got[0].turnover == 1.0 and abs(got[1].r - 0.025) < 1e-9 and got[1].turnover == 0.5
    assert got[2].r is None and got[2].turnover == 0.0 and got[3].turnover == 1.0 and got[3].r is None


def test_members_at_dates(spark):
    """Dates between, on and before sessions: the baskets of the last session, by plain sorting; and the orders of reports."""
    cfg, rng = Config(**{"max_share_price": 20_000.0, "capital": 10_000_000.0}), random.Random(9)
    rows = [(t, k, rng.gauss(0, 1), rng.choice([-1.0, -0.5, 0.5]), True, 1 + k % 5 if k % 11 else None) for t in range(4) for k in range(40)]
    signals = spark.createDataFrame(rows, "t int, ticker long, rs_score double, rs_slope double, eligible boolean, band int")
    cal = spark.createDataFrame([(DAY + datetime.timedelta(10 * t), t) for t in range(4)], "date date, t int")
    asked = {DAY - datetime.timedelta(1): None, DAY: 0, DAY + datetime.timedelta(15): 1, DAY + datetime.timedelta(19): 1, DAY + datetime.timedelta(500): 3}
    dates = spark.createDataFrame([(d,) for d in [*asked, DAY, None]], "date date")
    got = {tuple(r) for r in periods.members_at(signals, dates, cal, cfg).select("date", "run_id", "t", "ticker", "ord").collect()}
    want = set()
    for d, t in asked.items():
        now = [r for r in rows if r[0] == t]
        for run, band, key, most in (("top", 5, lambda r: -r[2], 9), ("bottom", 1, lambda r: r[2], 9), ("mid", 3, lambda r: -r[2], 9), ("pullback", 5, lambda r: r[3], 0)):
            inside = sorted((r for r in now if r[5] == band and r[3] < most), key=lambda r: (key(r), r[1]))
            want |= {(d, run, t, r[1], i + 1) for i, r in enumerate(inside[:3])}
    assert got == want and len({r[0] for r in got}) == 4
    assert periods.members_at(signals, dates.filter("false"), cal, cfg).count() == 0
    first = [(r.rs_score, r.ticker) for r in analysis.strongest_first(signals.filter("t = 0")).collect()]
    assert first == sorted(first, key=lambda r: (-r[0], r[1]))
    returns = spark.createDataFrame([("a", 0, 0.2), ("a", 1, -0.5), ("b", 0, -0.2), ("b", 1, 0.01), ("b", 2, None)], "run_id string, t int, r double")
    assert [tuple(r) for r in analysis.anomalous(returns, 0.1).collect()] == [("a", 1, -0.5, False), ("a", 0, 0.2, True), ("b", 0, -0.2, True)]


def test_lookups(spark):
    d = lambda m, k=1: datetime.date(2020, m, k)
    cal = panel.number_sessions(spark.createDataFrame([(d(2),), (d(4),), (d(6),)], "date date"))
    asked = spark.createDataFrame([(d(1),), (d(2),), (d(3),), (d(7),), (d(3),), (None,)], "date date")
    got = {r.date.month: (r.at_or_before, r.at_or_after) for r in lookups.as_of(asked, cal).collect()}
    assert got == {1: (None, 0), 2: (0, 0), 3: (0, 1), 7: (2, None)}
    rows = spark.createDataFrame([(1, d(1, 5), 2.0), (1, d(1, 9), None), (1, d(2, 1), None), (2, d(1, 1), 3.0)], "ticker long, date date, x double")
    assert sorted((r.ticker, r.month.month, r.x) for r in lookups.month_end(rows, "x", "ticker").collect()) == [(1, 1, 2.0), (2, 1, 3.0)]
    listed = spark.createDataFrame([(1,), (1,), (None,)], "ticker long")
    assert lookups.among(rows, listed, "ticker").count() == 3 and lookups.among(rows, listed, "ticker", keep=False).count() == 1
    bins = [(r.bin, r.n) for r in lookups.histogram(spark.createDataFrame([(0.0,), (0.1,), (0.5,), (1.0,), (None,)], "x double"), "x", 4).orderBy("bin").collect()]
    assert bins == [(0, 2), (1, 0), (2, 1), (3, 1)] and lookups.histogram(rows.filter("false"), "x").count() == 0
    lanes = {r.ticker: r.x for r in lookups.lanes(spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, "C")], "ticker long, sector string"), ("A", "B"), 0.4).collect()}
    assert all(abs(lanes[k] - v) < 1e-12 for k, v in {1: -0.4, 2: 0.0, 3: 0.4, 4: 1.0}.items()) and lanes[5] is None
    assert spark.createDataFrame([(d(3),)], "d date").select(lookups.month_label("d")).first()[0] == "March 2020"
    run = spark.createDataFrame([("r", t, 0.01) for t in range(3)], "run_id string, t int, r double")
    assert [round(r.p, 6) for r in lookups.running_sum(run, scale=100.0, out="p").orderBy("t").collect()] == [1.0, 2.0, 3.0]


def test_exclusion_report_records_absent_tickers_and_overlaps(spark):
    prices = spark.createDataFrame([(1, DAY + datetime.timedelta(t), 100.0 if t != 3 else None, 50.0) for t in range(10)], "ticker long, date date, close_adj double, close_raw double")
    day = lambda t: DAY + datetime.timedelta(t)
    rows = [(0, 1, day(0), day(4)), (1, 1, day(2), day(6)), (2, 9, None, None), (3, 1, None, None)]
    report = universe.exclusion_report(prices, spark.createDataFrame(rows, "ord long, ticker long, start_date date, end_date date"), ("close_adj", "close_raw"))
    assert sorted((r.ticker, r.applied, r.removed) for r in report.collect()) == [(1, True, 2), (1, True, 3), (1, True, 5), (9, False, 0)]


def test_feasibility_and_coverage_by_year(spark):
    rows = [("A", "Energy", DAY, True, False), ("B", "unclassified", DAY, True, False), ("C", None, DAY, True, False), ("D", "Energy", DAY, True, True), ("E", "Energy", DAY, False, False)]
    con = spark.createDataFrame(rows, "code string, sector string, end_date date, is_latest boolean, is_active_now boolean")
    prices = spark.createDataFrame([("A", DAY - datetime.timedelta(29), 1.0), ("B", DAY - datetime.timedelta(31), 1.0), ("B", DAY, None)], "code string, date date, close_adj double")
    report = universe.feasibility(con, prices)
    assert {r.code: r.outcome for r in report.collect()} == {"A": "ok", "B": "truncated", "C": "no data"}
    summary = universe.feasibility_summary(report).first()
    assert summary.verdict == "insufficient" and abs(summary.sector_known - 1 / 3) < 1e-12 and summary.earliest == DAY - datetime.timedelta(31)
    panel_ = spark.createDataFrame([(datetime.date(2020, 1, 31), 1, 1.0, True), (datetime.date(2020, 1, 31), 2, None, True), (datetime.date(2020, 2, 28), 1, 1.0, False)], "date date, ticker long, close_adj double, in_universe boolean")
    assert [(r.members, r.priced, r.missing, r.coverage) for r in universe.coverage(panel_).orderBy("month").collect()] == [(2, 1, 1, 0.5), (0, 0, 0, None)]
    row = universe.coverage_by_year(panel_, least=2).first()
    assert row.coverage == 0.5 and row.members == 1.0 and row.thin


def test_performance_with_dated_rates(spark):
    x = [0.03, -0.02, 0.01, -0.04, 0.05]
    run = spark.createDataFrame([("r", t, v) for t, v in enumerate(x)] + [("r", 9, None)], "run_id string, t int, r double")
    rf = spark.createDataFrame([(0, 0.01), (3, 0.02)], "t int, rf_period double")
    e = [0.02, -0.02, 0.01, -0.06, 0.05]
    sd = lambda v: (sum((a - sum(v) / len(v)) ** 2 for a in v) / (len(v) - 1)) ** 0.5
    got = metrics.performance(run, rf).first()
    assert got.n == 5 and abs(got.sharpe - sum(e) / 5 / sd(e) * 12**0.5) < 1e-12 and abs(got.sortino - sum(e) / 5 / sd([-0.02, -0.06]) * 12**0.5) < 1e-12
    best = metrics.drop_best(run, (1, 5)).collect()
    grown = math.prod(1 + v for v in x)
    assert len(best) == 1 and abs(best[0].total - grown + 1) < 1e-12 and abs(best[0].share - (grown - grown / 1.05)) < 1e-12


def test_metrics(spark):
    curve = [100, 120, 60, 80, 130]
    rows = [("r", t, DAY + datetime.timedelta(30 * t), float(e), e / max(curve[: t + 1]) - 1) for t, e in enumerate(curve)]
    got = metrics.max_drawdown(spark.createDataFrame(rows, "run_id string, t int, date date, equity double, drawdown double").withColumn("peak", F.max("equity").over(Window.partitionBy("run_id").orderBy("t")))).first()
    assert got.depth == -0.5 and got.peak == rows[1][2] and got.recovery == rows[4][2] and got.months == 3
    x = [random.Random(i).gauss(0.01, 0.05) for i in range(40)]
    e = [v - sum(x) / 40 for v in x]
    g = lambda k: sum(a * b for a, b in zip(e[k:], e[: 40 - k])) / 40
    s = g(0) + 2 * sum((1 - k / 4) * g(k) for k in (1, 2, 3))
    series = spark.createDataFrame([("r", t, v) for t, v in enumerate(x)], "run_id string, t int, r double")
    assert abs(metrics.newey_west(series).first().t_stat - sum(x) / 40 / math.sqrt(s / 40)) < 1e-9
    assert metrics.newey_west(series.limit(7)).first().t_stat is None
    null = spark.createDataFrame([(i / 99,) for i in range(100)], "r double")
    assert metrics.empirical_p(null, spark.createDataFrame([(2.0,)], "r double"), "r").first().p == 1 / 101


def test_dwell_and_sessions_bridge_gaps(spark):
    bands = [1, 1, None, 1, 2, 2, None, 2]
    df = spark.createDataFrame([(t, 1, b) for t, b in enumerate(bands)], "t int, ticker long, band int")
    assert {r.band: (r.n, r.longest) for r in analysis.dwell(df).collect()} == {1: (1, 3), 2: (1, 3)}
    assert analysis.sessions_in_band(df, 7).first().sessions_in_band == 3
    assert analysis.sessions_in_band(df, 6).count() == 0


def test_rebalance_calendar(spark):
    days = spark.createDataFrame([(datetime.date(2020, m, d),) for m in (1, 2, 3) for d in (2, 15, 28)], "date date")
    got = [(r.decision_date, r.exec_date) for r in periods.rebalance_calendar(days).collect()]
    assert got == [(datetime.date(2020, 1, 28), datetime.date(2020, 2, 2)), (datetime.date(2020, 2, 28), datetime.date(2020, 3, 2))]


def test_verdict_and_export(spark):
    months = [(datetime.date(2000 + i // 12, i % 12 + 1, 1), 0.02 + 0.001 * (i % 3), 0.01) for i in range(60)]
    df = spark.createDataFrame(months, "date date, win double, lose double")
    passive = df.select("date", F.lit(0.005).alias("r"))
    out = study.verdict(df, "top", "bottom", cost=(0.01, 0.02), persistence=(0.7, 0.6), p_random=0.01, stress_gap=0.1, reference=passive)
    assert out.level == "convergent" and {n for n, _, _ in out.evidence} == {"sign", "halves", "years", "rolling_36", "stress", "cost", "persistence", "random", "reference"}  # a constant series has no skewness
    n = out.numbers
    assert n["n"] == 60 and n["years"] == 5 and n["low"] < 12 * n["mean"] < n["high"] and abs(n["mean"] - 0.011) < 1e-12 and n["p_sign"] == 0.5**60 and out.claims() and out.limits()
    flipped = study.verdict(df.select("date", F.col("lose").alias("win"), F.col("win").alias("lose")), "top", "bottom")
    assert flipped.level == "weak" and len(flipped.evidence) == 4 and any("against" in x for x in flipped.limits())
    nothing = study.verdict(df.filter("false"), "top", "bottom")
    assert nothing.level == "unknown" and nothing.limits()
    whole = json.loads(study.export(Config(), [{"cagr": float("nan")}], out, monthly={"top": months}))
    assert whole["metrics"] == [{"cagr": None}] and len(whole["caveats"]) == 14 and whole["caveats"][0]["direction_of_bias"] and whole["monthly"]["top"][0][0] == "2000-01-01"
    assert Config().fingerprint() != Config(seed=1).fingerprint() and Config.daily(1).horizons == (21, 63, 126) and Config.daily(6).trail_weeks == 26
    with pytest.raises(ValueError):
        Config.daily(2)


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("# note\nticker,start_date,end_date,reason\n aa ,2004-06-01,bad,split\n")
    row = files.load_exclusions(spark, str(tmp_path / "x.csv")).first()
    assert row.ticker == "AA" and row.start_date == datetime.date(2004, 6, 1) and row.end_date is None
    (tmp_path / "y.csv").write_text("ticker,start_date,end_date,reason\nNONE,,,\n")
    assert files.load_exclusions(spark, str(tmp_path / "y.csv")).count() == 0
    (tmp_path / "z.csv").write_text("ticker\nA\n")
    with pytest.raises(ValueError):
        files.load_exclusions(spark, str(tmp_path / "z.csv"))
    assert files.load_manifest(spark, str(tmp_path)) == {}
    files.save_manifest(spark, str(tmp_path), {"a": 1})
    assert files.load_manifest(spark, str(tmp_path)) == {"a": 1}
    files.save_table(spark.range(3).toDF("a"), str(tmp_path), "meta")
    assert files.load_table(spark, str(tmp_path), "meta").count() == 3 and "meta" not in files.missing(spark, str(tmp_path)) and "close_adj" in files.missing(spark, str(tmp_path))
    assert files.load_exclusions(spark, str(tmp_path / "absent.csv")).count() == files.load_exclusions(spark, "none").count() == 0
    seen = files.exclusions_manifest(spark, str(tmp_path / "x.csv"))
    import hashlib

    assert seen["exists"] and seen["rows"] == 1 and seen["tickers"] == ["AA"] and seen["fingerprint"] == hashlib.sha256((tmp_path / "x.csv").read_bytes()).hexdigest()[:12]
    assert not files.exclusions_manifest(spark, str(tmp_path / "absent.csv"))["exists"] and files.exclusions_manifest(spark, "NONE")["disabled"]
    (tmp_path / "spells.csv").write_text("ticker,start_date,end_date\naa,2000-01-01,2001-01-01\nAA,2005-01-01,\n,2000-01-01,\nbb,never,\n")
    (tmp_path / "now.csv").write_text("Symbol,Security,GICS Sector,GICS Sub-Industry\n AA ,First,Energy,x\nAA,Second,Utilities,y\n")
    con = files.load_constituents(files.read_spells(spark, str(tmp_path / "spells.csv")), files.read_current(spark, str(tmp_path / "now.csv")))
    assert [(r.code, r.name, r.sector, r.is_active_now) for r in con.orderBy("start_date").collect()] == [("AA", "Second", "Utilities", False), ("AA", "Second", "Utilities", True)]
    with pytest.raises(ValueError):
        files.read_current(spark, str(tmp_path / "spells.csv"))
    day = spark.createDataFrame([(DAY, "A", 1.5), (DAY, "B", None)], "date date, ticker string, value double")
    folder = str(tmp_path / "set")
    files.save_dataset(spark, folder, {n: day for n in files.PANELS}, spark.createDataFrame([("A", "a", "x")], "ticker string, name string, sector string"), files.constant_risk_free(spark, "2024-01-01", "2024-01-07"), {"demo_data": "no"})
    tables_, manifest = files.load_dataset(spark, folder)
    assert set(tables_) == {*files.PANELS, *files.TABLES} and [tuple(r) for r in tables_["open_adj"].collect()] == [(DAY, "A", 1.5), (DAY, "B", None)] and not files.is_demo(manifest) and files.is_demo({"demo_data": "1"})
    with pytest.raises(FileNotFoundError):
        files.load_dataset(spark, str(tmp_path))
    name, rate = files.first_risk_free(spark, [("a", None), ("b", spark.createDataFrame([(DAY, 5.0)], "date date, y double"))], "2024-01-01", "2024-01-07")
    assert name == "b" and abs((1 + rate.first().rf) ** 252 - 1.05) < 1e-9 and files.first_risk_free(spark, [], "2024-01-01", "2024-01-07")[0] == "constant 2%"
    files.save_proposals(spark.createDataFrame([("AA", DAY, DAY, "why")], "ticker string, start_date date, end_date date, reason string"), str(tmp_path / "new"))
    assert files.load_exclusions(spark, str(tmp_path / "new")).first().reason == "why"
    spark.createDataFrame([(DAY, 1.0, float("nan"))], "date date, A double, B double").write.parquet(str(tmp_path / "wide"))
    assert {r.ticker: r.close for r in files.load_wide_panel(spark, str(tmp_path / "wide"), "close").collect()} == {"A": 1.0, "B": None}
    assert files.constant_risk_free(spark, "2024-01-01", "2024-01-07").count() == 5


def test_medians_without_a_group_in_a_task(spark, monkeypatch):
    rng = random.Random(11)
    groups = {
        0: [rng.gauss(0, 1) for _ in range(5000)],
        1: [float(rng.randint(0, 3)) for _ in range(4001)],  # ties fill the bracket
        2: [7.0] * 1000,
        3: [1.0, 2.0],
        4: [None, None],
        5: [math.exp(rng.gauss(0, 20)) for _ in range(3000)],
    }
    rows = [(t, x, None if x is None or x > 1 else -x) for t, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "t int, x double, y double").repartition(7)
    for accuracy in (1000, 40):
        monkeypatch.setattr(selection, "ACCURACY", accuracy)
        got = {r.t: (r.medians, r.counts) for r in selection.medians(df, ["t"], ["x", "y"]).collect()}
        for t, xs in groups.items():
            ys = [-x for x in xs if x is not None and x <= 1]
            xs = [x for x in xs if x is not None]
            want = ([statistics.median(v) if v else None for v in (xs, ys)], [len(xs), len(ys)])
            assert got.get(t, ([None, None], [0, 0])) == want, t
    # the same scores by either plan
    cells = spark.createDataFrame([(t, i, rng.gauss(0, 1) if rng.random() > 0.1 else None) for t in range(4) for i in range(60)] + [(9, i, 1.0) for i in range(60)] + [(10, 1, 2.0)], "t int, ticker int, x double")
    z = [{(r.t, r.ticker): r.z and round(r.z, 9) for r in features.robust_z(cells, "x", "z", large=large).collect()} for large in (False, True)]
    assert z[0] == z[1] and len(z[0]) == 301 and sum(v is not None for v in z[0].values()) > 200


def test_draws_are_distinct_and_every_set_is_equally_likely(spark):
    groups = spark.createDataFrame([(0, 5), (1, 2), (2, 0), (3, 10**9)], "t int, m long")
    picked = {}
    for r in sampling.draw_ranks(groups, 3000, 3, 7).collect():
        picked.setdefault((r.t, r.draw), []).append((r.ord, r.rank))
    assert {k[0] for k in picked} == {0, 1, 3} and len(picked) == 9000
    for (t, _), x in picked.items():
        ranks = [rank for _, rank in sorted(x)]
        assert [o for o, _ in sorted(x)] == list(range(1, min(3, {0: 5, 1: 2, 3: 10**9}[t]) + 1))
        assert len(set(ranks)) == len(ranks) and all(0 <= rank < {0: 5, 1: 2, 3: 10**9}[t] for rank in ranks)
    sets = Counter(frozenset(rank for _, rank in x) for (t, _), x in picked.items() if t == 0)
    assert len(sets) == 10 and all(abs(n - 300) < 75 for n in sets.values())
    rows = spark.range(1000).select(F.col("id").alias("k"))
    one, two = ({r.k for r in sampling.sample_rows(df, 50, 3, "k").collect()} for df in (rows, rows.repartition(9)))
    assert one == two and len(one) == 50 and sampling.sample_rows(rows.limit(4), 50, 3, "k").count() == 4


def test_exclusion_sweeps_against_a_scan_of_windows(spark):
    rng, day = random.Random(3), datetime.date(2000, 1, 1)
    at = lambda n: None if n is None else day + datetime.timedelta(n)
    windows = []
    for ticker in range(6):
        for _ in range([0, 1, 3, 40, 300, 2][ticker]):
            lo = rng.randint(0, 400)
            windows.append((ticker, rng.choice([lo, lo, lo, None]) if ticker < 4 else lo, rng.choice([lo + rng.randint(0, 9), lo, lo + 60 if ticker == 3 else lo])))
    windows += [(5, 100, None), (5, 10, 300), (5, 50, 60), (5, 55, 55), (77, None, None)]
    prices = [(t, d, float(d)) for t in range(6) for d in range(0, 420, 3)]
    df = spark.createDataFrame([(t, at(d), x, "k") for t, d, x in prices], "ticker int, date date, x double, other string")
    listed = spark.createDataFrame([(i, t, at(a), at(b)) for i, (t, a, b) in enumerate(windows)], "ord int, ticker int, start_date date, end_date date")
    inside = lambda w, d: (w[1] is None or w[1] <= d) and (w[2] is None or d <= w[2])
    first = {(t, d): next((i for i, w in enumerate(windows) if w[0] == t and inside(w, d)), None) for t, d, _ in prices}
    got = {(r.ticker, r.date): r.x for r in universe.exclude(df, listed, ("x",)).collect()}
    assert got == {(t, at(d)): None if first[t, d] is not None else x for t, d, x in prices}
    report = sorted((r.ticker, str(r.start_date), str(r.end_date), r.applied, r.removed) for r in universe.exclusion_report(df, listed, ("x",)).collect())
    removed = Counter(i for i in first.values() if i is not None)
    assert report == sorted((t, str(at(a)), str(at(b)), t < 6, removed[i]) for i, (t, a, b) in enumerate(windows))


def test_round_trip_cost():
    assert Config(capital=100_000.0, n_names=30, commission=1.5, spread_bps=3.0).round_trip_bps == 2 * 1.5 / (100_000 / 30) * 1e4 + 6


def test_scans_in_blocks_equal_plain_ones(spark):
    rng, day = random.Random(9), datetime.date(1990, 1, 1)
    series = {"long": [rng.gauss(0, 0.03) for _ in range(2000)], "short": [-0.1, 0.2, None, 0.05], "flat": [0.0] * 50}
    df = spark.createDataFrame([(k, t, day + datetime.timedelta(t), r) for k, x in series.items() for t, r in enumerate(x)], "run_id string, t int, date date, r double").repartition(5)
    want = {}
    for k, x in series.items():
        e = top = 1.0
        top = -math.inf
        for t, r in enumerate(x):
            e *= 1 + (r or 0.0)
            top = max(top, e)
            want[k, t] = (e, top)
    for block in (7, 500, 10**6):
        rows = scan.running_growth(df, 1 + F.col("r"), ["run_id"], "t", F.floor(F.col("t") / block), "equity", "peak").collect()
        assert len(rows) == len(want) and all(abs(r.equity / want[r.run_id, r.t][0] - 1) < 1e-9 and abs(r.peak / want[r.run_id, r.t][1] - 1) < 1e-9 for r in rows)
    got = {r.run_id: r for r in metrics.max_drawdown(metrics.equity_curve(df)).collect()}
    low = min(range(2000), key=lambda t: want["long", t][0] / want["long", t][1])
    assert got["long"].trough == day + datetime.timedelta(low) and abs(got["long"].depth - (want["long", low][0] / want["long", low][1] - 1)) < 1e-9
    assert got["long"].peak == day + datetime.timedelta(next(t for t in range(2000) if want["long", t][0] == want["long", low][1]))
    assert got["flat"].depth == 0.0 and got["flat"].peak == day and got["short"].depth == 0.0


def test_prices_of_symbols_with_a_broken_file(spark, tmp_path):
    rows = [(s, datetime.date(2020, 1, 1) + datetime.timedelta(d), 10.0 + i + d, 9.0 + i) for i, s in enumerate("ABCDE") for d in range(10)]
    for s in "ABCDE":
        lines = [f"{d},{c},{a}" for k, d, c, a in rows if k == s]
        (tmp_path / f"{s}.csv").write_text("date,close,adjusted_close\n" + "\n".join(reversed(lines)) + "\n")
    (tmp_path / "BROKEN.csv").write_text("date,close\n2020-01-01,what\n")
    (tmp_path / "EMPTY.csv").write_text("date,close\n")
    (tmp_path / "HEADLESS.csv").write_text("1,2\n")
    got, failed = prices.read_prices(spark, f"file://{tmp_path}", columns=("close", "adjusted_close"), batch=2)
    assert sorted(map(tuple, got.collect())) == sorted(rows) and got.rdd.getNumPartitions() == 4
    assert {r.symbol for r in failed.collect()} == {"BROKEN", "HEADLESS"}
    some, gone = prices.read_prices(spark, str(tmp_path), symbols=["A", "NONE"])
    assert some.count() == 10 and some.filter("open IS NULL AND adjusted_close IS NOT NULL").count() == 10 and [r.symbol for r in gone.collect()] == ["NONE"]
    part = got.filter("symbol IN ('B', 'C', 'EMPTY') AND date >= date'2020-01-09'")
    assert part.rdd.getNumPartitions() == 2 and sorted((r.symbol, r.date.day) for r in part.collect()) == [("B", 9), ("B", 10), ("C", 9), ("C", 10)]
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("symbol_prices").options(path=str(tmp_path), columns="close,wrong").load().collect()


def test_a_stored_panel_needs_no_exchange(spark, tmp_path):
    rng = random.Random(4)
    raw = spark.createDataFrame([(i, datetime.date(2020, 1, 1) + datetime.timedelta(d), 10.0 + i, rng.uniform(5, 50), rng.uniform(5, 50)) for i in range(30) for d in range(40) if rng.random() > 0.1], "ticker long, date date, open double, close double, adjusted_close double")
    calendar = spark.createDataFrame([(datetime.date(2020, 1, 1) + datetime.timedelta(d), d) for d in range(40)], "date date, t int")
    made = panel.assemble(raw, calendar)
    assert made.count() == 1200 and made.filter("close_adj IS NULL").count() == 1200 - raw.count()
    files.store_panel(made, "stored_panel_test", 4, str(tmp_path / "panel"))
    stored = files.stored_panel(spark, "stored_panel_test")
    slope = lambda df: df.withColumn("s", F.regr_slope("close_adj", F.col("t").cast("double")).over(Window.partitionBy("ticker").orderBy("t").rowsBetween(-5, 0)))
    held = slope(stored)
    plan = held.groupBy("ticker").agg(F.max("s")).join(stored.groupBy("ticker").agg(F.max("t")), "ticker")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    key = lambda r: (r.ticker, r.t, r.s and round(r.s, 9))
    assert sorted(map(str, map(key, held.collect()))) == sorted(map(str, map(key, slope(made).collect())))
    spark.sql("DROP TABLE stored_panel_test")


def test_verdict_table_agrees_with_the_driver(spark):
    rng = random.Random(2)
    months = [(datetime.date(2000 + i // 12, i % 12 + 1, 1), rng.gauss(0.012, 0.04), rng.gauss(0.008, 0.05)) for i in range(150)]
    df = spark.createDataFrame(months, "date date, win double, lose double")
    passive = df.select("date", F.lit(0.005).alias("r"))
    stay = spark.createDataFrame([(0.7, 0.6)], "win double, lose double")
    null = spark.createDataFrame([(0.3,)], "p double")
    old = study.verdict(df, "a", "b", persistence=(0.7, 0.6), p_random=0.3, reference=passive)
    rows = {r.name: r for r in study.verdict_table(df, stay, null, passive).collect()}
    assert {n: f for n, f, _ in old.evidence} == {n: r.favourable for n, r in rows.items() if n not in ("t_stat", "p_sign", "share")}
    assert abs(rows["share"].value - old.share) < 1e-12 and abs(rows["t_stat"].value - old.numbers["t"]) < 1e-9 and abs(rows["p_sign"].value / old.numbers["p_sign"] - 1) < 1e-9
    tails = spark.createDataFrame([(0, 5), (5, 5), (3, 5), (600, 1000), (0, 0)], "up int, n int").select("up", "n", study.binomial_tail(F.col("up"), F.col("n")).alias("p")).collect()
    assert all(r.p is None if r.n == 0 else abs(r.p / study.sign_test(r.up, r.n) - 1) < 1e-9 for r in tails)
    nothing = {r.name: (r.favourable, r.value) for r in study.verdict_table(df.filter("false")).collect()}
    assert nothing["sign"] == (None, None) and nothing["p_sign"] == (None, None) and nothing["share"][0] is None


def test_documents_are_cleaned_and_valid_json(spark):
    rows = [("A", float("nan"), 1 / 3, DAY, [(float("inf"), DAY)]), ("B", float("-inf"), -0.0, None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double, d date, more array<struct<v: double, at: date>>")
    lines = study.export_document({"rows": df}, df.select("k", "y"), head={"name": "s", "bad": float("nan")}).collect()
    assert [r.part for r in lines] == ["head", "rows", "rows", "monthly", "monthly"] and json.loads(lines[0].json) == {"name": "s", "bad": None}
    assert json.loads(lines[1].json) == {"k": "A", "y": 0.333333, "d": DAY.isoformat(), "more": [{"at": DAY.isoformat()}]}
    whole = json.loads(study.export_whole({"rows": df}, df.select("k", "y")).first().json)
    assert whole == {"rows": [{"k": "A", "y": 0.333333, "d": DAY.isoformat(), "more": [{"at": DAY.isoformat()}]}, {"k": "B", "y": 0.0}], "monthly": [{"k": "A", "y": 0.333333}, {"k": "B", "y": 0.0}]}


def test_export_shortens_the_snapshots_five_digits_as_its_sql_does(spark, monkeypatch):
    import duckdb

    from tidemark import queries

    scores = [2.3754996, -0.2645004, 0.1574998, 0.5005, -0.5025, 1.0005, 2.3755, 3.0, -0.0004, None]
    rows = [(k, f"n{k}", "ASIA", 5, "Q5 Leader", "up", 1, True, x, x and -x, DAY) for k, x in enumerate(scores)]
    now = spark.createDataFrame(rows, "ticker long, name string, sector string, band int, label string, movement string, sessions_in_band long, above_sma boolean, rs_score double, rs_slope double, date date")
    monkeypatch.setattr(queries.analysis, "snapshot", lambda *_: now)
    monkeypatch.setattr(queries.tables, "sectors", lambda *_: None)
    monkeypatch.setattr(queries, "_as_of", lambda *_: 0)
    monkeypatch.setattr(queries, "_signals", lambda *_: None)
    monkeypatch.setattr(queries, "_band_returns", lambda *_: spark.createDataFrame([], "run_id string, date date, r double"))
    got = [json.loads(r.json) for r in queries.export_compact(spark, "").filter("part = 'snapshot'").collect()]
    want = duckdb.execute("SELECT x, round(round(x, 5), 3) + 0.0, round(round(-x, 5), 3) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS x)", [scores]).fetchall()
    assert {r["ticker"]: (scores[r["ticker"]], r.get("rs_score"), r.get("rs_slope")) for r in got} == dict(enumerate(want))
    assert want[0][1] == 2.376 and want[3][1] == 0.5


def test_documents_have_numbers_without_exponents_and_are_otherwise_as_to_json(spark):
    import duckdb

    xs = [3e-4, -9e-4, 1e-4, 0.001, 0.0, -0.0, 2.0, -13.25, 0.123456, 1e7, 12345678.5, -1e15, 123456789012.5, None]
    df = spark.createDataFrame([("r", x) for x in xs], "run_id string, r double")
    got = [r.json for r in study.export_document({}, df).collect()]
    said = [t for (t,) in duckdb.execute("SELECT (x + 0.0)::VARCHAR FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs]).fetchall()]
    assert got == ['{"run_id":"r"' + (f',"r":{t}' if t is not None else "") + "}" for t in said] and got[0] == '{"run_id":"r","r":0.0003}'
    assert [json.loads(t) for t in got] == [{"run_id": "r"} | ({"r": x} if x is not None else {}) for x in xs]
    kind = "a string, `b\"q` string, n long, f boolean, at timestamp, none string, x array<double>, s struct<y: float, t: string, z: array<struct<v: double>>>, l array<string>, m map<string,int>, d decimal(9,2)"
    at = datetime.datetime(2020, 1, 2, 3, 4, 5)
    rows = [('say ":1.0E-4," \\ é \n', "", -3, True, at, None, [0.5, None, 2.0], (0.25, None, [(1.5,), None, (None,)]), ["x", None], {"k": 1}, None), ("", None, None, None, None, None, [], (None, None, []), None, None, None)]
    odd = spark.createDataFrame(rows, kind)
    assert [r.json for r in study.export_document({"odd": odd}).collect()] == [r.json for r in study.json_ready(odd).select(F.to_json(F.struct("*")).alias("json")).collect()]
    small = json.loads(study.export_document({"s": spark.createDataFrame([([2e-5, 1e-6, 4e-7],)], "x array<double>")}).first().json, parse_float=str)
    assert small == {"x": ["0.00002", "0.000001", "0.0"]}
