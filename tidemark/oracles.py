"""SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

PANEL = """
cells AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, l_suppkey AS ticker, avg(l_extendedprice * (1 - l_discount) / l_quantity) AS close_adj,
                 avg(l_extendedprice / l_quantity) AS close_raw FROM lineitem GROUP BY 1, 2),
calendar AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INTEGER AS t FROM (SELECT DISTINCT date FROM cells)),
grid AS (SELECT c.t, c.date, k.ticker, x.close_adj, x.close_raw FROM calendar c CROSS JOIN (SELECT DISTINCT ticker FROM cells) k LEFT JOIN cells x ON x.date = c.date AND x.ticker = k.ticker),
panel AS (SELECT *, lag(close_adj) OVER w AS open_adj, lag(close_raw) OVER w AS open_raw,
                 t BETWEEN min(t) FILTER (WHERE close_adj IS NOT NULL) OVER (PARTITION BY ticker) AND max(t) FILTER (WHERE close_adj IS NOT NULL) OVER (PARTITION BY ticker) AS in_universe
          FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY t))"""


def _z(source: str, column: str, out: str) -> str:
    return f"""
{out}_a AS (SELECT *, median({column}) OVER (PARTITION BY t) AS med, count({column}) OVER (PARTITION BY t) AS cnt FROM {source}),
{out}_b AS (SELECT *, median(abs({column} - med)) OVER (PARTITION BY t) AS mad FROM {out}_a),
{out}_c AS (SELECT * EXCLUDE (med, cnt, mad), CASE WHEN {column} IS NOT NULL AND cnt >= 5 AND mad > 0 THEN greatest(-3.0, least(3.0, ({column} - med) / (1.4826 * mad))) END AS {out} FROM {out}_b)"""


RETURNS = PANEL + """,
lr AS (SELECT *, CASE WHEN close_adj > 0 THEN ln(close_adj) END AS lp FROM panel),
ret AS (SELECT * EXCLUDE (lp), lp - lag(lp, 3) OVER w AS r3, lp - lag(lp, 6) OVER w AS r6, lp - lag(lp, 12) OVER w AS r12 FROM lr WINDOW w AS (PARTITION BY ticker ORDER BY t))"""
SCORE = RETURNS + "," + _z("ret", "r3", "z3") + "," + _z("z3_c", "r6", "z6") + "," + _z("z6_c", "r12", "z12") + """,
mean AS (SELECT *, (z3 + z6 + z12) / 3 AS m FROM z12_c)""" + "," + _z("mean", "m", "rs_score")
SLOPE = SCORE + """,
sl AS (SELECT *, CASE WHEN count(rs_score) OVER w = 6 THEN regr_slope(rs_score, t) OVER w END AS s FROM rs_score_c WINDOW w AS (PARTITION BY ticker ORDER BY t ROWS 5 PRECEDING))""" + "," + _z("sl", "s", "rs_slope")
_CRITERIA = """,
crit AS (SELECT *, close_adj IS NOT NULL AS has_price, count(close_adj) OVER (PARTITION BY ticker ORDER BY t ROWS 12 PRECEDING) >= 13 AS enough_history,
                coalesce(open_raw <= 20000, false) AS under_price_cap,
                coalesce(CASE WHEN count(close_adj) OVER w = 10 THEN close_adj > avg(close_adj) OVER w END, false) AS above_sma
         FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY t ROWS 9 PRECEDING)),
elig AS (SELECT *, in_universe AND has_price AND enough_history AND under_price_cap AND above_sma AS eligible FROM crit)"""
CRITERIA = PANEL + _CRITERIA.format(source="panel")


def _bands(part: str, source: str) -> str:
    return f""",
ranked AS (SELECT ticker, t, greatest(1, least(5, ceil((rank() OVER (PARTITION BY {part} ORDER BY rs_score) + (count(*) OVER (PARTITION BY {part}, rs_score) - 1) / 2.0) / count(*) OVER (PARTITION BY {part}) * 5)))::INTEGER AS band
           FROM {source} WHERE eligible AND rs_score IS NOT NULL),
signals AS (SELECT s.*, r.band FROM {source} s LEFT JOIN ranked r ON r.t = s.t AND r.ticker = s.ticker)"""


SIGNALS = SLOPE + _CRITERIA.format(source="rs_slope_c") + _bands("t", "elig")
SECTORS = """,
sec AS (SELECT s_suppkey AS ticker, s_name AS name, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PERIODS = SIGNALS + """,
per AS (SELECT (row_number() OVER (ORDER BY date) - 1)::INTEGER AS p, date AS decision_date, nxt AS exec_date FROM (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM calendar) WHERE nxt IS NOT NULL),
placed AS (SELECT p.p AS t, s.ticker, s.rs_score, s.rs_slope, s.eligible, s.band, x.open_adj FROM per p JOIN signals s ON s.date = p.decision_date LEFT JOIN signals x ON x.date = p.exec_date AND x.ticker = s.ticker),
pp AS (SELECT *, last_value(open_adj IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px_ff,
              coalesce(max(t) FILTER (WHERE open_adj IS NOT NULL) OVER (PARTITION BY ticker), -1) AS dead_after FROM placed)"""
BAND_RETURNS = SIGNALS + """,
nx AS (SELECT band, t, date, lead(close_adj) OVER (PARTITION BY ticker ORDER BY t) / close_adj - 1 AS r FROM signals),
br AS (SELECT 'band' || band AS run_id, t, date, avg(r) AS r FROM nx WHERE band IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2, 3)"""
SPREAD = BAND_RETURNS + """,
sp AS (SELECT 'spread' AS run_id, t, date, sum(CASE WHEN run_id = 'band5' THEN r ELSE -r END) AS r FROM br WHERE run_id IN ('band1', 'band5') GROUP BY t, date HAVING count(*) = 2)"""
SPELLS = """
line AS (SELECT l_suppkey AS ticker, l_returnflag, min(l_shipdate)::DATE AS start_date, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1, 2),
sec AS (SELECT s_suppkey AS ticker, s_name AS name, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sp AS (SELECT upper(trim(' s' || l.ticker)) AS code, CASE WHEN l_returnflag = 'A' THEN name || ' old' ELSE name END AS name, sector, start_date,
              coalesce(CASE WHEN l_returnflag <> 'N' THEN last END, DATE '1999-12-31') AS end_date FROM line l JOIN sec USING (ticker)),
con AS (SELECT *, (row_number() OVER (PARTITION BY code ORDER BY start_date, end_date, name))::INTEGER AS occurrence, count(*) OVER (PARTITION BY code) AS n_spells FROM sp WHERE end_date >= start_date),
nn AS (SELECT code, count(DISTINCT name) AS n_names FROM con GROUP BY code),
norm AS (SELECT con.*, occurrence = n_spells AS is_latest, n_spells > 1 OR n_names > 1 AS suspect FROM con JOIN nn USING (code))"""


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def _put(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes.strip().lstrip(',')}\n{select}"


_put("panel_dense", PANEL, f"SELECT t, ticker, {_r('close_adj', 'close_raw', 'open_adj', digits=3)}, in_universe FROM panel")
_put("log_return", RETURNS, f"SELECT t, ticker, {_r('r3')} FROM ret")
_put("robust_z", RETURNS + "," + _z("ret", "r3", "z"), f"SELECT t, ticker, {_r('z')} FROM z_c")
_put("rs_score", SCORE, f"SELECT t, ticker, {_r('rs_score')} FROM rs_score_c")
_put("rs_slope", SLOPE, f"SELECT t, ticker, {_r('rs_slope', digits=5)} FROM rs_slope_c")
for _name in ("robust_z", "rs_score", "rs_slope"):
    ORACLES[f"{_name}_large"] = ORACLES[_name]
_put("sma_flag", CRITERIA, "SELECT t, ticker, above_sma FROM elig")
_put("history_flag", CRITERIA, "SELECT t, ticker, enough_history FROM elig")
_put("eligibility", CRITERIA, "SELECT t, ticker, eligible FROM elig")
_NAMES = ("in_universe", "has_price", "enough_history", "under_price_cap", "above_sma", "eligible")
_put("eligibility_criteria", CRITERIA, "SELECT " + ", ".join(f"round(avg({n}), 6) + 0.0 AS {n}" for n in _NAMES) + " FROM (SELECT t, " + ", ".join(f"count(*) FILTER (WHERE {n}) AS {n}" for n in _NAMES) + " FROM elig GROUP BY t)")
_put("bands", SIGNALS, "SELECT t, ticker, band FROM signals")
_put(
    "bands_sector_neutral",
    SLOPE + _CRITERIA.format(source="rs_slope_c") + SECTORS + ",\nes AS (SELECT e.*, sec.sector FROM elig e LEFT JOIN sec USING (ticker))" + _bands("t, sector", "(SELECT * FROM es WHERE sector IS NOT NULL)"),
    "SELECT t, ticker, sector, band FROM signals",
)
_put("constituents_norm", SPELLS, "SELECT code, name, coalesce(sector, 'unclassified') AS sector, start_date, end_date, occurrence, is_latest, suspect FROM norm")
_put("membership", PANEL + "," + SPELLS, "SELECT DISTINCT t, code FROM norm JOIN calendar ON calendar.date BETWEEN start_date AND end_date WHERE is_latest OR NOT suspect")
_COVERAGE = "SELECT date AS month, members, priced, members - priced AS missing, round(priced / nullif(members, 0), 6) + 0.0 AS coverage FROM (SELECT date, count(*) FILTER (WHERE in_universe) AS members, count(*) FILTER (WHERE in_universe AND close_adj IS NOT NULL) AS priced FROM {source} GROUP BY date)"
_put("coverage_monthly", PANEL, _COVERAGE.format(source="panel"))
_put(
    "coverage_by_year",
    PANEL + ",\ncv AS (SELECT date, count(*) FILTER (WHERE in_universe) AS n, count(*) FILTER (WHERE in_universe AND close_adj IS NOT NULL) AS k FROM panel GROUP BY date)",
    "SELECT year(date)::INTEGER AS year, round(avg(k / nullif(n, 0)), 6) + 0.0 AS coverage, median(n)::DOUBLE AS members, median(n) < 95 AS thin FROM cv GROUP BY 1",
)
_put("coverage_by_band", SIGNALS, "SELECT date, count(*) AS eligible, count(band) AS banded, round(count(band) / count(*), 6) + 0.0 AS share FROM signals WHERE eligible GROUP BY date")
_put("universe_size", SIGNALS, "SELECT date, count(*) FILTER (WHERE eligible) AS n_eligible FROM signals GROUP BY date")
_CHANGES = PANEL + """,
ch AS (SELECT *, close_adj / lag(close_adj) OVER w - 1 AS r, close_raw / lag(close_raw) OVER w - 1 AS raw, ln(close_adj) - lag(ln(close_adj)) OVER w AS lr FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY t))"""
_put("price_anomalies", _CHANGES, "SELECT ticker, count(*) AS n FROM ch WHERE abs(r) > 0.6 GROUP BY ticker")
_put(
    "exclusions_applied",
    PANEL,
    f"""SELECT t, ticker, {_r('close_adj', 'close_raw', digits=3)} FROM (SELECT t, ticker, CASE WHEN NOT hit THEN close_adj END AS close_adj, CASE WHEN NOT hit THEN close_raw END AS close_raw
FROM (SELECT *, ticker IN (SELECT s_suppkey FROM supplier) AND ((ticker % 5 = 0 AND date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31') OR ticker % 11 = 0) AS hit FROM panel))""",
)
_BROKEN = _CHANGES + """,
nx AS (SELECT *, lead(lr) OVER (PARTITION BY ticker ORDER BY t) AS nxt FROM ch),
fl AS (SELECT *, coalesce(abs(r) > 0.5, false) AS big, coalesce(abs(r - raw) > 0.04, false) AS apart, coalesce(abs(r) > 0.5 AND abs(lr + nxt) < 0.5 * abs(lr), false) AS back FROM nx),
bs AS (SELECT ticker, count(*) FILTER (WHERE big) AS n_big, count(*) FILTER (WHERE apart) AS n_apart, count(*) FILTER (WHERE back) AS n_back, min(date) AS first_date, max(date) AS last_date, max(abs(r)) AS max_abs_return
       FROM fl WHERE big OR apart GROUP BY ticker)"""
_put("broken_series", _BROKEN, f"SELECT ticker, n_big, n_apart, n_back, first_date, last_date, {_r('max_abs_return')}, n_apart > 0 OR n_back > 0 AS near_certain FROM bs")
_put("suggest_exclusions", _BROKEN, "SELECT ticker, (first_date - 45)::DATE AS start_date, (last_date + 45)::DATE AS end_date, 'extreme ' || n_big || '; divergent ' || n_apart || '; reversed ' || n_back AS reason FROM bs")
_put(
    "price_context",
    PANEL,
    f"""SELECT t, ticker, {_r('close_adj', 'close_raw', 'r_adj', 'r_raw', digits=3)}, round(abs(r_adj - r_raw), 3) + 0.0 AS return_gap
FROM (SELECT *, close_adj / lag(close_adj) OVER w - 1 AS r_adj, close_raw / lag(close_raw) OVER w - 1 AS r_raw FROM (SELECT * FROM panel WHERE ticker = 3 AND t BETWEEN 30 AND 50) WINDOW w AS (ORDER BY t))""",
)
_DAYS = """
days AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem),
nd AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM days),
me AS (SELECT max(date) AS decision_date, max_by(nxt, date) AS exec_date FROM nd GROUP BY date_trunc('month', date)),
cal AS (SELECT (row_number() OVER (ORDER BY decision_date) - 1)::INTEGER AS t, decision_date, exec_date FROM (SELECT m.decision_date, nd.nxt AS exec_date FROM me m JOIN nd ON nd.date = m.decision_date) WHERE exec_date IS NOT NULL {more})"""
_put("rebalance_calendar", _DAYS.format(more="AND exec_date >= DATE '1993-01-01'"), "SELECT t, decision_date, exec_date FROM cal")
_put("period_panel", PERIODS, f"SELECT t, ticker, {_r('rs_score', 'open_adj', 'px_ff', digits=3)}, eligible, band FROM pp")
_put("dead_after", PERIODS, "SELECT DISTINCT ticker, dead_after FROM pp")
_put(
    "rf_period",
    _DAYS.format(more="") + ",\ngr AS (SELECT date, product(1 + 0.0001 * (day(date) % 3)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS growth FROM days)",
    "SELECT t, decision_date, exec_date, round(coalesce(growth / lag(growth) OVER (ORDER BY t) - 1, 0.0), 9) + 0.0 AS rf_period FROM cal JOIN gr ON gr.date = cal.exec_date",
)


def _select(name: str, where: str, order: str, n: int | None = 3) -> None:
    limit = f"WHERE ord <= {n}" if n else ""
    _put(f"select_{name}", PERIODS, f"SELECT t, ticker, ord FROM (SELECT t, ticker, (row_number() OVER (PARTITION BY t ORDER BY {order}ticker))::INTEGER AS ord FROM pp WHERE {where}) {limit}")


_select("top", "band = 5", "rs_score DESC, ")
_select("bottom", "band = 1", "rs_score, ")
_select("mid", "band = 3", "rs_score DESC, ")
_select("pullback", "band = 5 AND rs_slope < 0", "rs_slope, ")
_select("universe", "eligible AND rs_score IS NOT NULL", "", None)


_put(
    "basket_members",
    SIGNALS + """,
asked AS (SELECT max(o_orderdate::DATE) AS date FROM orders GROUP BY year(o_orderdate::DATE)),
ao AS (SELECT a.date, max(c.t) AS t FROM asked a JOIN calendar c ON c.date <= a.date GROUP BY a.date),
bk AS (SELECT * FROM (VALUES ('top', 5, -1), ('bottom', 1, 1), ('pullback', 5, 0), ('mid', 3, -1)) v(run_id, of_band, sign)),
mb AS (SELECT ao.date, run_id, t, ticker, row_number() OVER (PARTITION BY ao.date, run_id ORDER BY CASE WHEN sign = 0 THEN rs_slope ELSE sign * rs_score END, ticker) AS ord
       FROM ao JOIN signals s USING (t) JOIN bk ON s.band = bk.of_band WHERE sign <> 0 OR rs_slope < 0)""",
    "SELECT date, run_id, t, ticker, ord::INTEGER AS ord FROM mb WHERE ord <= 3",
)


def _random(n: int) -> str:
    digest = lambda i: f"(('0x' || substr(md5('12345|' || draw || '|' || t || '|{i}'), 1, 13))::BIGINT % (m - k + {i} + 1))"
    return PERIODS + f""",
num AS (SELECT t, ticker, row_number() OVER (PARTITION BY t ORDER BY ticker) - 1 AS pos FROM pp WHERE eligible AND rs_score IS NOT NULL),
grp AS (SELECT t, count(*) AS m, least(count(*), 3) AS k FROM num GROUP BY t),
p0 AS (SELECT *, {digest(0)} AS a FROM grp CROSS JOIN range({n}) g(draw)),
p1 AS (SELECT *, CASE WHEN k < 2 THEN NULL WHEN {digest(1)} = a THEN m - k + 1 ELSE {digest(1)} END AS b FROM p0),
p2 AS (SELECT *, CASE WHEN k < 3 THEN NULL WHEN {digest(2)} IN (a, b) THEN m - k + 2 ELSE {digest(2)} END AS c FROM p1),
pk AS (SELECT t, draw, 1 AS ord, a AS pos FROM p2 UNION ALL SELECT t, draw, 2, b FROM p2 WHERE k > 1 UNION ALL SELECT t, draw, 3, c FROM p2 WHERE k > 2),
rnd AS (SELECT 'draw' || draw AS run_id, t, ticker, ord::INTEGER AS ord FROM pk JOIN num USING (t, pos))"""


_put("select_random", _random(1000), "SELECT run_id, t, ticker, ord FROM rnd")
ORACLES["sample_orders"] = "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('12345|' || o_orderkey), o_orderkey LIMIT 500"
_NULL = _random(1000) + """,
fwd AS (SELECT t, ticker, lead(px_ff) OVER (PARTITION BY ticker ORDER BY t) / px_ff - 1 AS r FROM pp),
nul AS (SELECT run_id, avg(r) AS r FROM rnd JOIN fwd USING (t, ticker) WHERE r IS NOT NULL GROUP BY run_id)"""
_put("null_quantiles", _NULL, "SELECT " + ", ".join(f"round(quantile_cont(r, {x}), 6) + 0.0 AS q{int(x * 100):02d}" for x in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM nul")
_put(
    "empirical_pvalue",
    _NULL + """,
tp AS (SELECT t, ticker FROM pp WHERE band = 5 QUALIFY row_number() OVER (PARTITION BY t ORDER BY rs_score DESC, ticker) <= 3),
ob AS (SELECT avg(r) AS seen FROM tp JOIN fwd USING (t, ticker))""",
    "SELECT count(r) AS n, round((count(*) FILTER (WHERE r >= seen) + 1) / (count(r) + 1), 6) + 0.0 AS p FROM nul CROSS JOIN ob",
)
_put(
    "transition_matrix",
    SIGNALS + """,
st AS (SELECT band, lead(band, 3) OVER (PARTITION BY ticker ORDER BY t) AS next_band FROM signals),
ct AS (SELECT band, next_band, count(*) AS c FROM st WHERE band IS NOT NULL AND next_band IS NOT NULL GROUP BY 1, 2),
fu AS (SELECT a.i::INTEGER AS band, b.i::INTEGER AS next_band, coalesce(c, 0) AS n FROM range(1, 6) a(i) CROSS JOIN range(1, 6) b(i) LEFT JOIN ct ON ct.band = a.i AND ct.next_band = b.i)""",
    "SELECT band, next_band, n, round(n / nullif(sum(n) OVER (PARTITION BY band), 0), 6) + 0.0 AS probability FROM fu",
)
_put(
    "dwell_time",
    SIGNALS + """,
gi AS (SELECT ticker, band, row_number() OVER (PARTITION BY ticker ORDER BY t) - row_number() OVER (PARTITION BY ticker, band ORDER BY t) AS g FROM signals WHERE band IS NOT NULL),
ru AS (SELECT ticker, band, g, count(*) AS len FROM gi GROUP BY 1, 2, 3)""",
    "SELECT band, count(*) AS n, round(avg(len), 6) + 0.0 AS mean, round(median(len), 6) + 0.0 AS median, max(len) AS longest FROM ru GROUP BY band",
)
_IN_BAND = SIGNALS + """,
cu AS (SELECT ticker, band AS cur FROM signals WHERE t = (SELECT max(t) - 1 FROM calendar) AND band IS NOT NULL),
ot AS (SELECT s.ticker, max(t) AS b FROM signals s JOIN cu USING (ticker) WHERE t <= (SELECT max(t) - 1 FROM calendar) AND band <> cur GROUP BY s.ticker),
sib AS (SELECT s.ticker, cur AS band, count(*) AS sessions_in_band FROM signals s JOIN cu USING (ticker) LEFT JOIN ot USING (ticker) WHERE t <= (SELECT max(t) - 1 FROM calendar) AND band IS NOT NULL AND t > coalesce(b, -1) GROUP BY 1, 2)"""
_put("sessions_in_band", _IN_BAND, "SELECT ticker, band, sessions_in_band FROM sib")
_put(
    "snapshot",
    _IN_BAND + SECTORS,
    f"""SELECT n.ticker, {_r('rs_score', 'rs_slope', digits=5)}, n.band, n.above_sma, p.band AS prev_band, name, sector, sessions_in_band,
CASE WHEN n.band > p.band THEN 'up' WHEN n.band < p.band THEN 'down' WHEN n.band = p.band THEN 'flat' END AS movement, ['Q1 Laggard', 'Q2', 'Q3', 'Q4', 'Q5 Leader'][n.band] AS label
FROM (SELECT * FROM signals WHERE t = (SELECT max(t) - 1 FROM calendar) AND eligible) n LEFT JOIN (SELECT ticker, band FROM signals WHERE t = (SELECT max(t) - 4 FROM calendar)) p USING (ticker) LEFT JOIN sec USING (ticker) LEFT JOIN (SELECT ticker, sessions_in_band FROM sib) USING (ticker)""",
)
_put("trails", SIGNALS, f"SELECT t, ticker, {_r('rs_score', 'rs_slope', digits=5)} FROM signals WHERE t BETWEEN (SELECT max(t) - 12 FROM calendar) AND (SELECT max(t) - 1 FROM calendar) AND (t - (SELECT max(t) - 12 FROM calendar)) % 3 = 0 AND rs_score IS NOT NULL AND rs_slope IS NOT NULL")
_put("band_sector_matrix", SIGNALS + SECTORS, "SELECT sector, " + ", ".join(f"count(*) FILTER (WHERE band = {b}) AS b{b}" for b in range(1, 6)) + " FROM signals JOIN sec USING (ticker) WHERE t = (SELECT max(t) - 1 FROM calendar) AND band IS NOT NULL GROUP BY sector")
_put("monthly_heatmap", SPREAD, "SELECT year(date)::INTEGER AS year, " + ", ".join(f"round(avg(r) FILTER (WHERE month(date) = {m}), 6) + 0.0 AS m{m}" for m in range(1, 13)) + " FROM sp GROUP BY 1")
_put(
    "drawdown",
    BAND_RETURNS + """,
eq AS (SELECT *, product(1 + r) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS equity FROM br),
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq),
lo AS (SELECT run_id, min(drawdown) AS depth, arg_min(date, drawdown) AS trough, max(date) AS last FROM dd GROUP BY run_id),
pk AS (SELECT dd.run_id, arg_max(date, equity) AS peak, max(equity) AS height FROM dd JOIN lo USING (run_id) WHERE date <= trough GROUP BY dd.run_id),
bk AS (SELECT dd.run_id, min(date) AS back FROM dd JOIN lo USING (run_id) JOIN pk USING (run_id) WHERE date > trough AND equity >= height GROUP BY dd.run_id)""",
    f"SELECT run_id, {_r('depth')}, trough, peak, coalesce(back, last) AS recovery, round((coalesce(back, last) - peak) / 30.44)::INTEGER AS months FROM lo JOIN pk USING (run_id) LEFT JOIN bk USING (run_id)",
)
_put(
    "newey_west",
    BAND_RETURNS + """,
e AS (SELECT *, r - avg(r) OVER (PARTITION BY run_id) AS e FROM br),
l AS (SELECT *, e * lag(e, 1) OVER w AS p1, e * lag(e, 2) OVER w AS p2, e * lag(e, 3) OVER w AS p3 FROM e WINDOW w AS (PARTITION BY run_id ORDER BY t)),
s AS (SELECT run_id, count(*) AS n, avg(r) AS mean, (sum(e * e) + 2 * (0.75 * coalesce(sum(p1), 0) + 0.5 * coalesce(sum(p2), 0) + 0.25 * coalesce(sum(p3), 0))) / count(*) AS s FROM l GROUP BY run_id)""",
    "SELECT run_id, n, round(mean, 6) + 0.0 AS mean, round(CASE WHEN n >= 8 AND s > 0 THEN mean / sqrt(s / n) END, 6) + 0.0 AS t_stat FROM s",
)
_put(
    "perf_metrics",
    BAND_RETURNS + """,
x AS (SELECT run_id, count(r) AS n, product(1 + r) AS total, stddev_samp(r) AS sd, avg(r - 0.002) AS m, stddev_samp(r - 0.002) AS xs, stddev_samp(r - 0.002) FILTER (WHERE r < 0.002) AS xd, avg((r > 0)::INTEGER) AS hit_rate FROM br GROUP BY run_id),
y AS (SELECT run_id, n, CASE WHEN total > 0 THEN total ** (12.0 / n) - 1 END AS cagr, sd * sqrt(12) AS vol, CASE WHEN xs > 0 THEN m / xs * sqrt(12) END AS sharpe, CASE WHEN xd > 0 THEN m / xd * sqrt(12) END AS sortino, hit_rate, total FROM x)""",
    f"SELECT run_id, n, {_r('cagr', 'vol', 'sharpe', 'sortino', 'hit_rate', 'total')} FROM y",
)
_SUBPERIODS = BAND_RETURNS + """,
w AS (SELECT *, CASE WHEN date BETWEEN DATE '1992-01-01' AND DATE '1993-12-31' THEN 'early' WHEN date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31' THEN 'middle' WHEN date BETWEEN DATE '1996-01-01' AND DATE '2100-01-01' THEN 'late' END AS label FROM br),
su AS (SELECT run_id, label, count(*) AS n, product(1 + r) - 1 AS total, product(1 + r) ** (12.0 / count(*)) - 1 AS cagr, stddev_samp(r) * sqrt(12) AS vol FROM w WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 6)"""
_put("subperiods", _SUBPERIODS, f"SELECT run_id, label, n, {_r('total', 'cagr', 'vol')} FROM su")
_BANDS = [f"band{b}" for b in range(1, 6)]


def _by_band(key: str, value: str, source: str) -> str:
    return f"SELECT {key}, " + ", ".join(f"round(max({value}) FILTER (WHERE run_id = '{b}'), 6) + 0.0 AS {b}" for b in _BANDS) + f" FROM {source} GROUP BY 1"


_put("subperiods_by_band", _SUBPERIODS, _by_band("label", "cagr", "su"))
_DROP = BAND_RETURNS + """,
ki AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY r DESC, t) AS i FROM br),
dr AS (SELECT run_id, k.k::INTEGER AS k, product(1 + r) AS whole, product(CASE WHEN i > k.k THEN 1 + r ELSE 1 END) AS g, count(*) FILTER (WHERE i > k.k) AS n FROM ki CROSS JOIN (VALUES (0), (3), (6), (12)) k(k) GROUP BY 1, 2),
de AS (SELECT run_id, k, g ** (12.0 / n) - 1 AS cagr, whole - 1 AS total, g - 1 AS without, whole - g AS share FROM dr WHERE n > 0)"""
_put("drop_best_months", _DROP, f"SELECT run_id, k, {_r('cagr', 'total', 'without', 'share')} FROM de")
_put("drop_best_by_band", _DROP, _by_band("k", "without", "de"))
_put(
    "rolling_win_rate",
    BAND_RETURNS + ",\nf AS (" + " UNION ALL ".join(f"SELECT run_id, {n} AS \"window\", CASE WHEN count(r) OVER w{n} = {n} THEN sum(r) OVER w{n} END AS s FROM br WINDOW w{n} AS (PARTITION BY run_id ORDER BY t ROWS {n - 1} PRECEDING)" for n in (12, 36)) + ")",
    "SELECT run_id, \"window\"::INTEGER AS \"window\", count(*) AS n, round(avg((s > 0)::INTEGER), 6) + 0.0 AS win_share, round(median(s), 6) + 0.0 AS median, round(min(s), 6) + 0.0 AS worst FROM f WHERE s IS NOT NULL GROUP BY ALL",
)
_put("positive_years", BAND_RETURNS, "SELECT run_id, count(*) FILTER (WHERE s > 0) AS positive, count(*) AS total FROM (SELECT run_id, year(date), sum(r) AS s FROM br GROUP BY 1, 2) GROUP BY run_id")
_put(
    "skewness",
    BAND_RETURNS + ",\nc AS (SELECT run_id, r - avg(r) OVER (PARTITION BY run_id) AS d FROM br)",
    "SELECT run_id, round(avg(d ** 3) / avg(d ** 2) ** 1.5, 5) + 0.0 AS skew FROM c GROUP BY run_id",
)
_put("anomalous_periods", BAND_RETURNS, "SELECT run_id, t, round(r, 6) + 0.0 AS r, abs(r) <= 0.3 AS plausible FROM br WHERE abs(r) > 0.1")
_put(
    "null_histogram",
    _NULL + """,
ra AS (SELECT min(r) AS lo, max(r) AS hi, (max(r) - min(r)) / 20 AS width FROM nul),
ct AS (SELECT CASE WHEN hi > lo THEN least(floor((r - lo) / width), 19)::INTEGER ELSE 0 END AS bin, count(*) AS c FROM nul CROSS JOIN ra GROUP BY 1)""",
    "SELECT g.bin::INTEGER AS bin, round(lo + g.bin * width, 6) + 0.0 AS low, round(lo + g.bin * width + width, 6) + 0.0 AS high, coalesce(c, 0) AS n FROM ra CROSS JOIN range(20) g(bin) LEFT JOIN ct ON ct.bin = g.bin",
)
_RF = "," + _DAYS.format(more="") + """,
gr AS (SELECT date, product(1 + 0.0001 * (day(date) % 3)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS growth FROM days),
rf AS (SELECT t, coalesce(growth / lag(growth) OVER (ORDER BY t) - 1, 0.0) AS rf_period FROM cal JOIN gr ON gr.date = cal.exec_date)"""


def _performance(source: str) -> str:
    return f""",
ex AS (SELECT s.*, r - coalesce(rf_period, 0.0) AS x FROM {source} s LEFT JOIN rf USING (t) WHERE r IS NOT NULL),
pa AS (SELECT run_id, count(r) AS n, product(1 + r) AS total, stddev_samp(r) AS sd, avg(x) AS m, stddev_samp(x) AS xs, stddev_samp(x) FILTER (WHERE x < 0) AS xd, avg((r > 0)::INTEGER) AS hit_rate FROM ex GROUP BY run_id),
pf AS (SELECT run_id, n, CASE WHEN total > 0 THEN total ** (12.0 / n) - 1 END AS cagr, sd * sqrt(12) AS vol, CASE WHEN xs > 0 THEN m / xs * sqrt(12) END AS sharpe, CASE WHEN xd > 0 THEN m / xd * sqrt(12) END AS sortino, hit_rate, total FROM pa)"""


_put("perf_metrics_dated_rf", BAND_RETURNS + _RF + _performance("br"), f"SELECT run_id, n, {_r('cagr', 'vol', 'sharpe', 'sortino', 'hit_rate', 'total')} FROM pf")
_BASKETS = PERIODS + """,
ba AS (SELECT 'top' AS run_id, t, ticker FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rs_score DESC, ticker) AS o FROM pp WHERE band = 5) WHERE o <= 3
       UNION ALL SELECT 'bottom', t, ticker FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rs_score, ticker) AS o FROM pp WHERE band = 1) WHERE o <= 3
       UNION ALL SELECT 'mid', t, ticker FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rs_score DESC, ticker) AS o FROM pp WHERE band = 3) WHERE o <= 3
       UNION ALL SELECT 'pullback', t, ticker FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rs_slope, ticker) AS o FROM pp WHERE band = 5 AND rs_slope < 0) WHERE o <= 3
       UNION ALL SELECT 'universe', t, ticker FROM pp WHERE eligible AND rs_score IS NOT NULL),
pr AS (SELECT t, ticker, lead(px_ff) OVER (PARTITION BY ticker ORDER BY t) / px_ff - 1 AS r FROM pp),
hd AS (SELECT run_id, t, ticker, r, coalesce(lag(t) OVER (PARTITION BY run_id, ticker ORDER BY t) < t - 1, true) AS new FROM ba JOIN pr USING (t, ticker)),
bk AS (SELECT run_id, h.t, exec_date AS date, avg(r) AS r, count(*) AS n, avg(new::INTEGER) AS turnover FROM hd h JOIN per ON per.p = h.t GROUP BY 1, 2, 3)"""
_put("basket_returns", _BASKETS, f"SELECT run_id, t, date, n, {_r('r', 'turnover')} FROM bk")
_put(
    "basket_metrics",
    _BASKETS + _RF + _performance("bk") + """,
eq AS (SELECT *, product(1 + r) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS equity FROM bk WHERE r IS NOT NULL),
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq),
lo AS (SELECT run_id, min(drawdown) AS depth, arg_min(date, drawdown) AS trough, max(date) AS last FROM dd GROUP BY run_id),
pk AS (SELECT dd.run_id, arg_max(date, equity) AS peak, max(equity) AS height FROM dd JOIN lo USING (run_id) WHERE date <= trough GROUP BY dd.run_id),
rc AS (SELECT dd.run_id, min(date) AS back FROM dd JOIN lo USING (run_id) JOIN pk USING (run_id) WHERE date > trough AND equity >= height GROUP BY dd.run_id),
tu AS (SELECT run_id, avg(turnover) AS turnover, avg(n) AS positions FROM bk GROUP BY run_id)""",
    f"""SELECT pf.run_id, pf.n, {_r('cagr', 'vol', 'sharpe', 'sortino', 'hit_rate', digits=5)}, round(total, 5) + 0.0 AS final_value, round(depth, 5) + 0.0 AS max_dd, round((coalesce(back, last) - peak) / 30.44)::INTEGER AS recovery_months,
{_r('turnover', 'positions', digits=5)}, round(turnover * (2 * 1.5 / (10000000.0 / 3) * 1e4 + 2 * 3.0) / 1e4 * 12, 5) + 0.0 AS cost_drag FROM pf JOIN lo USING (run_id) JOIN pk USING (run_id) LEFT JOIN rc USING (run_id) JOIN tu USING (run_id)""",
)
_put("fixed_capital_profit", BAND_RETURNS, "SELECT run_id, t, round(10000000.0 * sum(r) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING), 3) + 0.0 AS profit FROM br")
_put("return_overlap", BAND_RETURNS, f"SELECT a.date, round(a.r, 6) + 0.0 AS a, round(b.r, 6) + 0.0 AS b FROM br a JOIN br b ON a.date = b.date WHERE a.run_id = 'band5' AND b.run_id = 'band1'")
_put(
    "as_of_sessions",
    PANEL,
    "SELECT date, (SELECT max(t) FROM calendar c WHERE c.date <= o.date) AS at_or_before, (SELECT min(t) FROM calendar c WHERE c.date >= o.date) AS at_or_after FROM (SELECT DISTINCT o_orderdate::DATE AS date FROM orders) o",
)
_put(
    "month_end_price",
    "dy AS (SELECT l_suppkey AS ticker, l_shipdate::DATE AS date, max(l_extendedprice / l_quantity) FILTER (WHERE l_returnflag <> 'R') AS price FROM lineitem GROUP BY 1, 2)",
    "SELECT ticker, date_trunc('month', date)::DATE AS month, arg_max(price, date) AS price FROM dy WHERE price IS NOT NULL GROUP BY 1, 2",
)
_put("sector_map", SPELLS, "SELECT code, coalesce(arg_max(sector, occurrence), 'unclassified') AS sector FROM norm WHERE is_latest GROUP BY code")
_put(
    "member_coverage",
    PANEL + "," + SPELLS + """,
mb AS (SELECT DISTINCT t, substr(code, 2)::BIGINT AS ticker FROM norm JOIN calendar ON calendar.date BETWEEN start_date AND end_date WHERE is_latest OR NOT suspect),
mp AS (SELECT calendar.date, p.close_adj, m.t IS NOT NULL AS in_universe FROM panel p FULL JOIN mb m USING (t, ticker) JOIN calendar ON calendar.t = coalesce(p.t, m.t))""",
    _COVERAGE.format(source="mp"),
)
_EXCLUDED = """,
xs AS (SELECT s_suppkey AS ticker, DATE '1995-01-01' AS start_date, DATE '1995-12-31' AS end_date FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 11 = 0)"""
_put(
    "exclusion_report",
    PANEL + _EXCLUDED + """,
xl AS (SELECT *, ticker * 2 + (start_date IS NULL)::INTEGER AS ord FROM xs UNION ALL SELECT -1, DATE '1995-01-01', NULL, -1),
hi AS (SELECT p.ticker, p.date, min(ord) AS ord, any_value(close_adj) AS ca, any_value(close_raw) AS cr FROM panel p JOIN xl ON xl.ticker = p.ticker AND p.date BETWEEN coalesce(xl.start_date, DATE '0001-01-01') AND coalesce(xl.end_date, DATE '9999-12-31') GROUP BY 1, 2),
rm AS (SELECT ord, greatest(count(ca), count(cr)) AS removed FROM hi GROUP BY ord)""",
    "SELECT xl.ticker, start_date, end_date, xl.ticker IN (SELECT ticker FROM panel) AS applied, coalesce(removed, 0) AS removed FROM xl LEFT JOIN rm USING (ord)",
)
_put("new_proposals", _BROKEN + _EXCLUDED, "SELECT ticker, (first_date - 45)::DATE AS start_date, (last_date + 45)::DATE AS end_date, 'extreme ' || n_big || '; divergent ' || n_apart || '; reversed ' || n_back AS reason FROM bs WHERE ticker NOT IN (SELECT ticker FROM xs)")
_put("excluded_prices", PANEL + _EXCLUDED, "SELECT ticker, round(arg_max(close_adj, t), 3) + 0.0 AS close_adj, count(close_adj) AS n FROM panel WHERE ticker IN (SELECT ticker FROM xs) GROUP BY ticker")
_put("over_cap", PANEL, "SELECT ticker, count(*) AS sessions FROM panel WHERE open_raw > 24000 AND in_universe GROUP BY ticker")
_put(
    "map_lanes",
    SECTORS.strip().lstrip(",") + ",\nln AS (SELECT ticker, sector, count(*) OVER (PARTITION BY sector) AS k, row_number() OVER (PARTITION BY sector ORDER BY ticker) - 1 AS i, list_position(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE'], sector) - 1 AS lane FROM sec)",
    "SELECT ticker, sector, round(CASE WHEN lane >= 0 THEN lane + CASE WHEN k > 1 THEN -0.38 + i * 0.76 / (k - 1) ELSE 0 END END, 6) + 0.0 AS x FROM ln",
)
_FEASIBLE = SPELLS + """,
ls AS (SELECT 'S' || l.ticker AS code, sector, last AS end_date FROM line l JOIN sec USING (ticker) WHERE l_returnflag <> 'N'
       QUALIFY row_number() OVER (PARTITION BY l.ticker ORDER BY start_date DESC, last DESC, CASE WHEN l_returnflag = 'A' THEN name || ' old' ELSE name END DESC) = 1),
pc AS (SELECT 'S' || l_suppkey AS code, min(date_trunc('month', l_shipdate)::DATE) AS first_price, max(date_trunc('month', l_shipdate)::DATE) AS last_price FROM lineitem GROUP BY 1),
fe AS (SELECT code, sector, end_date, first_price, last_price, CASE WHEN last_price IS NULL THEN 'no data' WHEN last_price >= end_date - 30 THEN 'ok' ELSE 'truncated' END AS outcome FROM ls LEFT JOIN pc USING (code))"""
_put("feasibility", _FEASIBLE, "SELECT code, sector, end_date, first_price, last_price, outcome FROM fe")
_put(
    "feasibility_rate",
    _FEASIBLE + ",\nfr AS (SELECT count(*) AS n, count(*) FILTER (WHERE outcome = 'ok') AS usable, avg((sector IS NOT NULL)::INTEGER) AS known, min(first_price) AS earliest FROM fe)",
    "SELECT n, usable, round(usable / n, 6) + 0.0 AS rate, round(known, 6) + 0.0 AS sector_known, earliest, CASE WHEN usable / n >= 0.98 THEN 'excellent' WHEN usable / n >= 0.9 THEN 'acceptable' ELSE 'insufficient' END AS verdict FROM fr",
)
_put(
    "adjusted_opens",
    """ra AS (SELECT l_suppkey AS ticker, l_shipdate::DATE AS date, arg_min(l_extendedprice / l_quantity - 15000, (l_orderkey, l_linenumber)) AS open, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS close,
       arg_max(l_extendedprice * (1 - l_discount) / l_quantity, (l_orderkey, l_linenumber)) AS adjusted_close FROM lineitem GROUP BY 1, 2),
ad AS (SELECT *, CASE WHEN open > 0 THEN open END AS open_raw, CASE WHEN close > 0 THEN adjusted_close / close END AS factor FROM ra)""",
    "SELECT ticker, date, adjusted_close AS close_adj, open_raw * factor AS open_adj, open_raw FROM ad",
)

_VERDICT = BAND_RETURNS + """,
mo AS (SELECT date, max(r) FILTER (WHERE run_id = 'band5') AS win, max(r) FILTER (WHERE run_id = 'band1') AS lose FROM br GROUP BY date),
df AS (SELECT *, win - lose AS d, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS cnt,
              CASE WHEN count(*) OVER a = 36 THEN sum(win - lose) OVER a END AS s36, CASE WHEN count(*) OVER b = 120 THEN sum(win - lose) OVER b END AS s120
       FROM mo WHERE win IS NOT NULL AND lose IS NOT NULL WINDOW a AS (ORDER BY date ROWS 35 PRECEDING), b AS (ORDER BY date ROWS 119 PRECEDING)),
yr AS (SELECT count(*) FILTER (WHERE s > 0) AS up_years, count(*) AS years FROM (SELECT year(date) AS y, sum(d) AS s FROM df GROUP BY 1)),
mm AS (SELECT avg(win) AS mw, avg(lose) AS ml, avg(d) AS md FROM df),
ev AS (SELECT count(*) AS n, count(*) FILTER (WHERE d > 0) AS up, avg(d) AS mean, avg(d) FILTER (WHERE i <= cnt // 2) AS half1, avg(d) FILTER (WHERE i > cnt // 2) AS half2,
              avg((s36 > 0)::INTEGER) AS share36, avg((s120 > 0)::INTEGER) AS share120,
              avg((win - mw) ** 3) / avg((win - mw) ** 2) ** 1.5 - avg((lose - ml) ** 3) / avg((lose - ml) ** 2) ** 1.5 AS skew FROM df CROSS JOIN mm),
er AS (SELECT d - md AS e, i FROM df CROSS JOIN mm),
lg AS (SELECT e, lag(e, 1) OVER w * e AS p1, lag(e, 2) OVER w * e AS p2, lag(e, 3) OVER w * e AS p3 FROM er WINDOW w AS (ORDER BY i)),
nw AS (SELECT (sum(e * e) + 1.5 * sum(p1) + 1.0 * sum(p2) + 0.5 * sum(p3)) / count(*) AS s, count(*) AS k FROM lg),
st AS (SELECT band, lead(band, 3) OVER (PARTITION BY ticker ORDER BY t) AS nb FROM signals),
sy AS (SELECT avg((nb = 5)::INTEGER) FILTER (WHERE band = 5) - avg((nb = 1)::INTEGER) FILTER (WHERE band = 1) AS stay FROM st WHERE band IS NOT NULL AND nb IS NOT NULL),
rf AS (SELECT avg(win - r) AS over_ref FROM mo JOIN (SELECT date, avg(r) AS r FROM br GROUP BY date) USING (date)),
al AS (SELECT * FROM ev CROSS JOIN yr CROSS JOIN nw CROSS JOIN sy CROSS JOIN rf),
bt AS (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) AS p FROM ev CROSS JOIN range(0, 1000) g(k) WHERE k BETWEEN up AND n),
rw AS (SELECT 0 AS ord, 'sign' AS name, mean > 0 AS favourable, mean * 12 AS value FROM al
       UNION ALL SELECT 1, 'halves', half1 > 0 AND half2 > 0, least(half1, half2) * 12 FROM al
       UNION ALL SELECT 2, 'years', up_years > years / 2, up_years / years FROM al
       UNION ALL SELECT 3, 'rolling_36', share36 > 0.5, share36 FROM al
       UNION ALL SELECT 4, 'rolling_120', share120 > 0.5, share120 FROM al
       UNION ALL SELECT 5, 'skewness', skew > 0, skew FROM al
       UNION ALL SELECT 6, 'persistence', stay > 0, stay FROM al
       UNION ALL SELECT 7, 'reference', over_ref > 0, over_ref * 12 FROM al),
vr AS (SELECT * FROM rw UNION ALL SELECT 8, 't_stat', NULL, mean / sqrt(s / k) FROM al UNION ALL SELECT 9, 'p_sign', NULL, p FROM bt
       UNION ALL SELECT 10, 'share', avg(favourable::INTEGER) >= 0.55, avg(favourable::INTEGER) FROM rw)"""
_put("verdict_table", _VERDICT, "SELECT ord::INTEGER AS ord, name, favourable, round(value, 5) + 0.0 AS value FROM vr")


def _json(part: str, source: str, columns: dict[str, str]) -> str:
    """Lines of JSON without the fields that are null."""
    fields = ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN '"{n}":' || {v} END""" for n, (c, v) in {n: (v if isinstance(v, tuple) else (n, v)) for n, v in columns.items()}.items())
    return f"SELECT '{part}' AS part, '{{' || concat_ws(',', {fields}) || '}}' AS json FROM {source}"


_TEXT, _PLAIN = "'\"' || {0} || '\"'", "{0}::VARCHAR"
_f = lambda kind, *names: {n: kind.format(n) for n in names}
_SNAP = ORACLES["snapshot"].replace("WITH ", "", 1).rsplit("\nSELECT n.ticker", 1)
_NOW = _SNAP[0] + ",\nsn AS (SELECT n.ticker" + _SNAP[1].replace("n.band,", "n.band, n.date,", 1) + "),\nbn AS (SELECT band, sector, count(*) AS n FROM sn WHERE band IS NOT NULL GROUP BY 1, 2)"
_SNAPSHOT = _json(
    "snapshot",
    "(SELECT * REPLACE (round(rs_score, 3) + 0.0 AS rs_score, round(rs_slope, 3) + 0.0 AS rs_slope) FROM sn)",
    _f(_PLAIN, "ticker") | _f(_TEXT, "name", "sector") | _f(_PLAIN, "band") | _f(_TEXT, "label", "movement") | _f(_PLAIN, "sessions_in_band", "above_sma", "rs_score", "rs_slope") | _f(_TEXT, "date"),
)
_COUNTS = _json("bands", "bn", _f(_PLAIN, "band") | _f(_TEXT, "sector") | _f(_PLAIN, "n"))
_put("export_compact", _NOW, f"{_SNAPSHOT} UNION ALL {_COUNTS}")
_MONTHLY = _json("monthly", "(SELECT run_id, date, round(r, 4) + 0.0 AS r FROM br)", _f(_TEXT, "run_id", "date") | _f(_PLAIN, "r"))
_put("export_full", _NOW + BAND_RETURNS[len(SIGNALS) :], f"{_SNAPSHOT} UNION ALL {_COUNTS} UNION ALL {_MONTHLY}")
