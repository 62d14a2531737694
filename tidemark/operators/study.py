"""The verdict on a pair of return series, the caveats that go with it, and the JSON export."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Config
from tidemark.operators import metrics

#: What every export states: id, what is wrong, whom it favours, what is done about it.
CAVEATS = (
    ("delisted_prices", "Prices of names that left the universe may be missing, and such names crowd the weakest band.", "favours the weakest band", "report coverage of names that left"),
    ("constituents_are_a_reconstruction", "Past members come from a reconstruction, whose errors grow towards the past.", "uncertain", "report members by year"),
    ("price_coverage_start", "Prices may begin later than the list of members, and horizons need a warm-up.", "none; shortens the sample", "report first prices"),
    ("sectors_only_for_current_members", "Sectors come from the current list, so that former members may have none.", "spoils sector-neutral bands of the past", "fill sectors where a source has them"),
    ("todays_costs_applied_historically", "Today's costs are applied to all of the past.", "favours high turnover in early years", "report costs by turnover"),
    ("sma200_filter_not_neutral", "A filter on the moving average is itself a bet on the trend.", "mixes the filter's effect with the selection's", "compare with and without the filter"),
    ("price_cap_excludes_compounders", "Names above the price cap are left out, which are often ones that never split.", "against the strongest band", "report names above the cap"),
    ("excluded_series", "Series with known errors are left out before anything is computed.", "errors would favour the weakest band", "keep exclusions in a file and report them"),
    ("post_hoc_data_cleaning", "Exclusions were found by looking at results.", "favours whatever is sought", "give each one a reason outside the results; report both ways"),
    ("ticker_reuse", "Symbols pass to other companies; earlier spells of such symbols are dropped.", "thins the past universe a little", "report suspect codes"),
    ("recent_ipos_excluded", "A name needs a minimum history before it is ranked.", "leaves out volatile names on both sides", "none"),
    ("index_addition_effect", "Names enter an index after they have risen, and so land in the strongest band.", "favours the strongest band", "check which date an entry carries"),
    ("multiple_testing", "Many settings can be tried, and some pass by chance.", "overstates significance", "fix a configuration beforehand; show all results"),
    ("long_short_not_implementable", "The spread of two bands ignores what short selling costs.", "overstates a long-short result", "use it to separate selection from the market"),
)


def evidence(monthly: DataFrame) -> DataFrame:
    """One row of numbers about ``monthly`` (date, win, lose): the difference, its halves, years, rolling windows, skewness, growth.

    The windows without a partition run over one row per month.
    """
    d = monthly.filter("win IS NOT NULL AND lose IS NOT NULL").withColumn("d", F.col("win") - F.col("lose"))
    order = W.orderBy("date")
    full = lambda n: F.when(F.count("d").over(order.rowsBetween(1 - n, 0)) == n, F.sum("d").over(order.rowsBetween(1 - n, 0)))
    d = d.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "s36": full(36), "s120": full(120)})
    year = d.groupBy(F.year("date").alias("y")).agg(F.sum("d").alias("s")).agg(F.count_if(F.col("s") > 0).alias("years_up"), F.count("*").alias("years"))
    first = F.col("i") <= F.floor(F.col("n") / 2)
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    out = d.agg(
        F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("end"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > 0).alias("up"),
        F.avg(F.when(first, F.col("d"))).alias("half1"), F.avg(F.when(~first, F.col("d"))).alias("half2"),
        share("s36").alias("share36"), F.median("s36").alias("median36"), F.min("s36").alias("worst36"), share("s120").alias("share120"), F.median("s120").alias("median120"),
        F.skewness("win").alias("skew_win"), F.skewness("lose").alias("skew_lose"), F.product(1 + F.col("win")).alias("growth_win"), F.product(1 + F.col("lose")).alias("growth_lose"),
    )
    return out.crossJoin(year)  # one row each


def binomial_tail(positive: Column, n: Column) -> Column:
    """The one-sided tail at 1/2 from ``positive`` of ``n`` up: binomial terms by their logarithms, each from the one before, so that no factorial overflows."""
    total = n * math.log(2)
    start = F.struct(F.lit(0.0).alias("log"), F.when(positive <= 0, F.exp(-total)).otherwise(0.0).alias("tail"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log((n - k) / (k + 1))
        return F.struct(log.alias("log"), (acc["tail"] + F.when(k + 1 >= positive, F.exp(log - total)).otherwise(0.0)).alias("tail"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), (n - 1).cast("int")), start, step)["tail"])


def verdict_table(monthly: DataFrame, persistence: DataFrame | None = None, null: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """(ord, name, favourable, value) of each indicator over ``monthly`` (date, win, lose), and of the share that is favourable (``share``).

    ``persistence`` is one row (win, lose) of probabilities to stay, ``null`` one row (p), ``reference`` a passive
    series (date, r). What can't be told is null and counts for neither side. Everything stays one row until the end.
    """
    series = monthly.select(F.lit("d").alias("run_id"), "date", (F.col("win") - F.col("lose")).alias("r")).filter("r IS NOT NULL").withColumn("t", F.row_number().over(W.partitionBy("run_id").orderBy("date")))
    row = evidence(monthly).crossJoin(metrics.newey_west(series).agg(F.max("t_stat").alias("t_stat")))
    row = row.withColumn("p_sign", binomial_tail(F.col("up"), F.col("n")))
    gap = lambda a, b: F.col(a) - F.col(b)
    rows = [
        ("sign", F.col("mean") > 0, F.col("mean") * 12),
        ("halves", (F.col("half1") > 0) & (F.col("half2") > 0), F.least("half1", "half2") * 12),
        ("years", F.when(F.col("n") > 0, F.col("years_up") > F.col("years") / 2), F.try_divide("years_up", "years")),
        ("rolling_36", F.when(F.col("n") > 0, F.coalesce("share36", F.lit(0.0)) > 0.5), F.col("share36")),
        ("rolling_120", F.col("share120") > 0.5, F.col("share120")),
        ("skewness", gap("skew_win", "skew_lose") > 0, gap("skew_win", "skew_lose")),
    ]
    if persistence is not None:
        row = row.crossJoin(persistence.agg(F.max("win").alias("stay_win"), F.max("lose").alias("stay_lose")))
        rows.append(("persistence", gap("stay_win", "stay_lose") > 0, gap("stay_win", "stay_lose")))
    if null is not None:
        row = row.crossJoin(null.agg(F.max("p").alias("p_random")))
        rows.append(("random", F.col("p_random") < 0.2, F.col("p_random")))
    if reference is not None:
        row = row.crossJoin(monthly.join(reference.select("date", "r"), "date").agg(F.avg(F.col("win") - F.col("r")).alias("over")))
        rows.append(("reference", F.col("over") > 0, F.col("over") * 12))
    known = F.array_compact(F.array(*[f.cast("int") for _, f, _ in rows]))
    share = F.try_divide(F.aggregate(known, F.lit(0), lambda a, x: a + x), F.size(known))
    rows += [("t_stat", None, F.col("t_stat")), ("p_sign", None, F.col("p_sign")), ("share", share >= 0.55, share)]
    each = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), (F.lit(None) if f is None else f).cast("boolean").alias("favourable"), v.cast("double").alias("value")) for i, (n, f, v) in enumerate(rows)]
    return row.select(F.inline(F.array(*each)))


def json_ready(df: DataFrame) -> DataFrame:
    """``df`` with what JSON can't say made null (NaN, infinities), doubles of six digits and dates as ISO text, in structs and arrays too."""

    def ready(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            x = c.cast("double")
            return F.when(~F.isnan(x) & (F.abs(x) < math.inf), F.round(x, 6) + 0.0)
        if isinstance(kind, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[ready(c[f.name], f.dataType).alias(f.name) for f in kind]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: ready(x, kind.elementType))
        return c

    return df.select(*[ready(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def json_text(c: Column, kind: T.DataType) -> Column:
    """The JSON of a value of a table that is ``json_ready``, null for null. As ``to_json``, but doubles below 10^16 are written without an exponent (0.0003, not 3.0E-4)."""
    if isinstance(kind, T.DoubleType):
        plain = F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
        return F.when(F.abs(c) < 1e16, plain).otherwise(c.cast("string"))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), json_object({f.name: json_text(c[f.name], f.dataType) for f in kind}))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_text(x, kind.elementType)), ",", "null"), F.lit("]"))
    held = F.to_json(F.struct(c.alias("v")))  # {"v":...}
    return F.when(c.isNotNull(), F.substr(held, F.lit(6), F.length(held) - 6))


def json_object(texts: dict[str, Column]) -> Column:
    """An object of fields' JSON, without those that are null."""
    fields = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), t) for n, t in texts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def export_document(parts: dict[str, DataFrame], monthly: DataFrame | None = None, head: dict | None = None) -> DataFrame:
    """(part, json): a study as lines of JSON, one for each row of each part, in the order of the parts' first columns.

    ``parts`` are tables by name (snapshot, distribution, metrics, verdict ...), ``head`` what is known without
    data (configuration, provenance, caveats). The full form has ``monthly`` (run_id, date, r) too. Rows are
    cleaned and written by expressions where they are, so a document may be larger than a driver.
    """
    every = parts | ({"monthly": monthly} if monthly is not None else {})
    out = None
    for name, df in every.items():
        ready = json_ready(df)
        line = ready.select(F.lit(name).alias("part"), json_object({f.name: json_text(F.col(f.name), f.dataType) for f in ready.schema}).alias("json"))
        out = line if out is None else out.unionByName(line)
    if head:
        top = out.sparkSession.createDataFrame([("head", json.dumps(clean(head), allow_nan=False, sort_keys=True))], "part string, json string")
        out = top.unionByName(out)
    return out


def export_whole(parts: dict[str, DataFrame], monthly: DataFrame | None = None) -> DataFrame:
    """(json): the whole document of a study of ordinary size as one text: an array of rows for each part, ordered by their text; ``monthly`` in the full form."""
    lines = export_document(parts, monthly)
    rows = lines.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("rows"))
    each = rows.select(F.concat(F.lit('"'), "part", F.lit('":['), "rows", F.lit("]")).alias("p"))
    return each.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("p")), ","), F.lit("}")).alias("json"))


@dataclass
class Verdict:
    """Indicators for the winner; each is (name, favourable or None, detail)."""

    winner: str
    loser: str
    evidence: list[tuple[str, bool | None, str]] = field(default_factory=list)
    numbers: dict = field(default_factory=dict)

    @property
    def share(self) -> float | None:
        known = [f for _, f, _ in self.evidence if f is not None]
        return sum(known) / len(known) if known else None

    @property
    def level(self) -> str:
        s = self.share
        return "unknown" if s is None else "convergent" if s >= 0.75 else "moderate" if s >= 0.55 else "weak"

    def claims(self) -> list[str]:
        n = self.numbers
        out = [f"{self.winner} returned {12 * n['mean']:.2%} a year more than {self.loser} over {n['n'] / 12:.0f} years."] if n.get("mean") is not None else []
        if n.get("share36") is not None:
            out.append(f"It led in {n['share36']:.0%} of the windows of three years and in {n['years_up']} of {n['years']} years.")
        return [*out, f"{sum(bool(f) for _, f, _ in self.evidence)} of {sum(f is not None for _, f, _ in self.evidence)} indicators point the same way; that is convergence, not proof."]

    def limits(self) -> list[str]:
        """What can't be said; never empty."""
        n, out = self.numbers, []
        if n.get("t") is None or abs(n["t"]) < 2:
            out.append("That the difference is significant: its t statistic is below 2.")
        if n.get("low") is not None and n["low"] < 0 < n["high"]:
            out.append(f"That the difference is positive: its 95% interval goes from {n['low']:.2%} to {n['high']:.2%}.")
        against = [name for name, f, _ in self.evidence if f is False]
        if against:
            out.append(f"That all indicators agree; against: {', '.join(against)}.")
        return [*out, "That the past will repeat itself: the sample holds few regimes."]

    def to_dict(self) -> dict:
        return {
            "winner": self.winner, "loser": self.loser, "share": self.share, "level": self.level, "numbers": self.numbers, "claims": self.claims(), "limits": self.limits(),
            "evidence": [{"name": n, "favourable": f, "detail": d} for n, f, d in self.evidence],
            "notice": "This is the direction in which indicators converge, not a statistical proof.",
        }


def sign_test(positive: int, n: int) -> float:
    """One-sided binomial tail at 1/2."""
    return sum(math.comb(n, k) for k in range(positive, n + 1)) / 2**n


def verdict(monthly: DataFrame, winner: str, loser: str, *, cost: tuple[float, float] | None = None, persistence: tuple[float, float] | None = None, p_random: float | None = None, stress_gap: float | None = None, reference: DataFrame | None = None) -> Verdict:
    """The verdict over ``monthly`` (date, win, lose): Spark gathers one row of numbers, of which the indicators are made.

    ``cost`` and ``persistence`` are the winner's and the loser's, ``p_random`` the share of random draws that
    did better, ``stress_gap`` the difference in the worst scenario, ``reference`` a passive series (date, r).
    What isn't given, or can't be told, is no indicator.
    """
    n = evidence(monthly).first().asDict()
    out = Verdict(winner, loser, numbers=n)
    if not n["n"]:
        return out
    series = monthly.select(F.lit("d").alias("run_id"), F.row_number().over(W.orderBy("date")).alias("t"), (F.col("win") - F.col("lose")).alias("r")).filter("r IS NOT NULL")
    half = 1.96 * (n["sd"] or 0.0) / math.sqrt(n["n"]) * 12
    n |= {"t": metrics.newey_west(series).first()["t_stat"], "low": 12 * n["mean"] - half, "high": 12 * n["mean"] + half, "p_sign": sign_test(n["up"], n["n"])}
    add = lambda name, ok, detail: out.evidence.append((name, ok, detail))
    add("sign", n["mean"] > 0, f"{12 * n['mean']:.4f} a year")
    add("halves", n["half1"] is not None and n["half1"] > 0 and n["half2"] > 0, f"{12 * (n['half1'] or 0):.4f}, {12 * n['half2']:.4f} a year")
    add("years", n["years_up"] > n["years"] / 2, f"{n['years_up']} of {n['years']}")
    add("rolling_36", (n["share36"] or 0) > 0.5, "no window" if n["share36"] is None else f"{n['share36']:.0%}, median {n['median36']:.4f}, worst {n['worst36']:.4f}")
    if n["share120"] is not None:
        add("rolling_120", n["share120"] > 0.5, f"{n['share120']:.0%}, median {n['median120']:.4f}")
    if stress_gap is not None:
        add("stress", stress_gap > 0, f"{stress_gap:.4f}")
    if cost is not None:
        add("cost", cost[0] < cost[1], f"{cost[0]:.4f} against {cost[1]:.4f} a year")
    if n["skew_win"] is not None and n["skew_lose"] is not None:
        add("skewness", n["skew_win"] > n["skew_lose"], f"{n['skew_win']:.2f} against {n['skew_lose']:.2f}")
    if persistence is not None:
        add("persistence", persistence[0] > persistence[1], f"{persistence[0]:.0%} against {persistence[1]:.0%} stay in their band")
    if p_random is not None:
        add("random", p_random < 0.2, f"p = {p_random:.3f}")
    if reference is not None:
        gap = monthly.join(reference.select("date", "r"), "date").agg(F.avg(F.col("win") - F.col("r")).alias("m")).first()["m"]
        add("reference", gap is not None and gap > 0, f"{12 * (gap or 0):.4f} a year")
    return out


def clean(value):
    """JSON form: non-finite numbers are null, numbers have six digits, dates are ISO."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else None
    return value.isoformat() if hasattr(value, "isoformat") else value


def export(cfg: Config, metrics: list[dict], result: Verdict, provenance: dict | None = None, diagnostics: dict | None = None, monthly: dict[str, list] | None = None) -> str:
    """JSON of a study: configuration, provenance, metrics, verdict, caveats, diagnostics; the full form has each basket's ``monthly`` returns, too."""
    keys = ("id", "description", "direction_of_bias", "mitigation")
    body = {"config": json.loads(cfg.to_json()), "fingerprint": cfg.fingerprint(), "provenance": provenance or {}, "metrics": metrics, "verdict": result.to_dict(), "caveats": [dict(zip(keys, c, strict=True)) for c in CAVEATS], "diagnostics": diagnostics or {}}
    if monthly is not None:
        body["monthly"] = monthly
    return json.dumps(clean(body), allow_nan=False, sort_keys=True)
