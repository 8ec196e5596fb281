"""Queries of order-flow statistics and of strategy monitoring."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import monitoring as M
from ..operators import performance as P
from ..operators import quant as Q
from ..sources import views as V
from .registry import SQL, query
from .research import NORMAL, RESOLVED, ROUNDED, SHOWN, WITH, contrarian, metrics_sql, r6
from .sqlviews import views


@query(
    "a10_vpin",
    WITH.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", o AS (SELECT category, notional AS v, outcome = 'Yes' AND price > 0.5 AS b, row_number() OVER (PARTITION BY category ORDER BY ts, trade_id) AS k FROM contrarian),
f AS (
 SELECT category, k, CASE WHEN b THEN v ELSE 0 END AS buy, CASE WHEN b THEN 0 ELSE v END AS sell, 0 AS bucket FROM o WHERE k = 1
 UNION ALL
 SELECT o.category, o.k, CASE WHEN f.buy + f.sell >= 50000 THEN 0 ELSE f.buy END + CASE WHEN b THEN v ELSE 0 END, CASE WHEN f.buy + f.sell >= 50000 THEN 0 ELSE f.sell END + CASE WHEN b THEN 0 ELSE v END,
  f.bucket + CASE WHEN f.buy + f.sell >= 50000 THEN 1 ELSE 0 END
 FROM f JOIN o ON o.category = f.category AND o.k = f.k + 1),
l AS (SELECT category, bucket, max_by(buy, k) AS buy, max_by(sell, k) AS sell FROM f GROUP BY ALL)
SELECT category, count(*) AS buckets, {r6({"vpin": "avg(abs(buy - sell) / nullif(buy + sell, 0))", "avg_volume": "avg(buy + sell)"})},
 CASE WHEN avg(abs(buy - sell) / nullif(buy + sell, 0)) > 0.5 THEN 'high' WHEN avg(abs(buy - sell) / nullif(buy + sell, 0)) > 0.3 THEN 'medium' ELSE 'low' END AS level
FROM l GROUP BY category""",
)
def a10(spark, d):
    return Q.vpin(contrarian(spark, d), "category")


@query(
    "a11_hawkes_moments",
    WITH
    + f""", g AS (SELECT category, epoch_us(ts) / 1000.0 AS t, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY category ORDER BY ts, trade_id)) / 1000.0 AS gap FROM contrarian),
s AS (SELECT category, count(*) AS n, max(t) - min(t) AS span, avg(gap) AS mean, stddev_pop(gap) AS dev FROM g GROUP BY 1),
c AS (SELECT *, greatest(0, least(1, (dev / mean - 1) / 2)) AS score FROM s)
SELECT category, n, {r6({"rate_per_hour": "CASE WHEN n >= 10 THEN n / span * 3600000 ELSE 0 END", "clustering": "CASE WHEN n >= 10 THEN score ELSE 0 END", "alpha_e6": "CASE WHEN n >= 10 THEN score * ln(2) / 300000 * 1000000 ELSE 0 END", "branching": "CASE WHEN n >= 10 THEN score ELSE 0 END"})} FROM c""",
)
def a11(spark, d):
    # registered doubles have six places
    return Q.hawkes_moments(contrarian(spark, d), "category").withColumn("alpha_e6", F.col("alpha") * 1e6).drop("alpha")


@query(
    "a12_burst_periods",
    views("trades")
    + """, per AS (SELECT condition_id, epoch_us(ts) // 60000000 AS m, count(*) AS k FROM trades GROUP BY 1, 2),
rate AS (SELECT condition_id, sum(k) / (max(m) - min(m) + 1) AS rate FROM per GROUP BY 1),
w AS (SELECT condition_id, m - o.i AS w, sum(k) AS n FROM per, range(5) o(i) GROUP BY 1, 2),
hot AS (SELECT w.condition_id, w.w, w.w - row_number() OVER (PARTITION BY w.condition_id ORDER BY w.w) AS island FROM w JOIN rate USING (condition_id) WHERE n / 5.0 > 3 * rate),
runs AS (SELECT condition_id, island, min(w) AS first, max(w) + 5 AS past FROM hot GROUP BY 1, 2)
SELECT r.condition_id, CAST(r.first AS BIGINT) AS first, CAST(r.past AS BIGINT) AS past, CAST(sum(p.k) AS BIGINT) AS trades FROM runs r JOIN per p ON p.condition_id = r.condition_id AND p.m >= r.first AND p.m < r.past GROUP BY 1, 2, 3""",
)
def a12(spark, d):
    return Q.burst_periods(V.trades(spark, d), "condition_id")


DIGITS = """, d AS (SELECT CAST(substr(CAST(CAST(floor(notional + 0.5) AS BIGINT) AS VARCHAR), 1, 1) AS INT) AS digit, count(*) AS m FROM contrarian WHERE floor(notional + 0.5) > 0 GROUP BY 1),
e AS (SELECT k AS digit, log10(1 + 1.0 / k) AS expected, coalesce(m, 0) AS m, sum(coalesce(m, 0)) OVER () AS total FROM range(1, 10) r(k) LEFT JOIN d ON d.digit = k),
x AS (SELECT *, sum((m - expected * total) * (m - expected * total) / (expected * total)) OVER () AS chi2 FROM e)"""


@query(
    "a21_benford",
    WITH
    + DIGITS
    + f"""SELECT CAST(digit AS BIGINT) AS digit, {r6({"observed": "m / total", "expected": "expected", "deviation": "(m / total - expected) / expected * 100", "chi2": "chi2", "p_value": "CASE WHEN chi2 <= 0 THEN 1 ELSE 1 - " + NORMAL + " END"})}
FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS t FROM (SELECT *, ((chi2 / 8.0) ** (1 / 3.0) - (1 - 2 / 72.0)) / sqrt(2 / 72.0) / sqrt(2.0) AS z FROM x)) WHERE total >= 30""",
)
def a21(spark, d):
    return Q.benford(contrarian(spark, d))


DECAY = "CASE WHEN m < 0 OR m >= 120 THEN NULL WHEN m < 10 THEN 0 WHEN m < 20 THEN 10 WHEN m < 30 THEN 20 WHEN m < 45 THEN 30 WHEN m < 60 THEN 45 WHEN m < 90 THEN 60 ELSE 90 END".replace("m ", "minutes_before_close ")


@query(
    "a20_time_decay",
    WITH
    + f""", b AS (SELECT *, CASE from_minute WHEN 0 THEN 10 WHEN 10 THEN 20 WHEN 20 THEN 30 WHEN 30 THEN 45 WHEN 45 THEN 60 WHEN 60 THEN 90 ELSE 120 END AS to_minute FROM {metrics_sql(f"(SELECT * FROM (SELECT *, {DECAY} AS from_minute FROM contrarian WHERE {RESOLVED}) WHERE from_minute IS NOT NULL)", "from_minute")}),
s AS (SELECT CASE WHEN count(*) >= 3 THEN greatest(0, -regr_slope(ln(edge_points), (from_minute + to_minute) / 2)) ELSE 0 END AS decay FROM b WHERE n >= 5 AND edge_points > 0),
t AS (SELECT from_minute AS best FROM b WHERE n >= 10 ORDER BY round(edge_points, 9) DESC, from_minute LIMIT 1)
SELECT CAST(from_minute AS BIGINT) AS from_minute, CAST(to_minute AS BIGINT) AS to_minute, n, {r6({c: c for c in ("win_rate", "avg_price", "pnl", "roi", "edge_points", "decay")})}, from_minute = (SELECT best FROM t) AS is_best FROM b, s""",
)
def a20(spark, d):
    return Q.time_decay(contrarian(spark, d))


SIGNED = "(SELECT category, trade_id, notional, sqrt(notional) AS x, CASE WHEN outcome = 'Yes' THEN drift_30m ELSE -drift_30m END AS y FROM contrarian WHERE drift_30m IS NOT NULL)"


@query(
    "a22_kyle_lambda",
    WITH
    + f""", s AS (SELECT category, count(*) AS n, regr_slope(y, x) AS b, regr_r2(y, x) AS rr FROM {SIGNED} GROUP BY 1),
q AS (SELECT s.category, s.n, s.b, s.rr, sum((v.y - s.b * v.x) * (v.y - s.b * v.x)) AS rest, var_pop(v.y) * s.n AS total FROM s JOIN {SIGNED} v ON v.category = s.category GROUP BY s.category, s.n, s.b, s.rr)
SELECT category, n, {r6({"lambda": "abs(b)", "r2": "greatest(0, 1 - rest / nullif(total, 0))", "regr_r2": "rr"})} FROM q WHERE n >= 20""",
)
def a22(spark, d):
    return Q.kyle_lambda(contrarian(spark, d), "category")


@query(
    "a22_impact_by_size",
    WITH
    + f"""SELECT category, quantile, {r6({"avg_impact": "avg(y)"})}, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY notional, trade_id) - 1 AS k, count(*) OVER (PARTITION BY category) AS m FROM {SIGNED}), (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.99]::DOUBLE[]) AS quantile)
WHERE m >= 20 AND k >= floor(quantile * m) - 10 AND k < floor(quantile * m) + 10 GROUP BY 1, 2""",
)
def a22b(spark, d):
    return Q.impact_by_size(contrarian(spark, d), "category")


@query(
    "a28_signal_groups",
    WITH
    + f"""SELECT "group", n, {r6({c: c for c in ("win_rate", "avg_price", "pnl", "roi")})} FROM {metrics_sql(f'''(SELECT c.*, g."group" FROM contrarian c, (SELECT unnest(['vs_ofi', '10-60m', 'digit 2-4']) AS "group") g WHERE {RESOLVED} AND
 CASE g."group" WHEN 'vs_ofi' THEN is_against_ofi WHEN '10-60m' THEN minutes_before_close BETWEEN 10 AND 60 ELSE substr(CAST(CAST(floor(notional + 0.5) AS BIGINT) AS VARCHAR), 1, 1) IN ('2', '3', '4') END)''', '"group"')}
WHERE n >= 10 ORDER BY win_rate DESC, "group" LIMIT 5""",
)
def a28(spark, d):
    return Q.signal_groups(contrarian(spark, d))


def reported(*parts: tuple[str, str, str, str]) -> str:
    """The report's rows from the SQL of the measures' own queries: (query, name, key, value)."""
    return " UNION ALL ".join(f"SELECT '{name}' AS name, CAST({key} AS VARCHAR) AS key, {value} AS value FROM ({SQL[measure]})" for measure, name, key, value in parts)


QUICK = (("a10_vpin", "vpin", "category", "vpin"), ("a11_hawkes_moments", "branching", "category", "branching"))
REST = (("a22_kyle_lambda", "kyle_lambda", "category", '"lambda"'), ("a21_benford", "benford", "digit", "observed"), ("a20_time_decay", "edge", "from_minute", "edge_points"), ("a28_signal_groups", "win_rate", '"group"', "win_rate"))


@query("a30_report", reported(*QUICK, *REST))
def a30(spark, d):
    return Q.report(contrarian(spark, d), "category")


@query("a30_incremental_report", reported(*QUICK))
def a30_incremental(spark, d):
    return Q.report(contrarian(spark, d), "category", incremental=True)


def strategies(spark):
    """Five registered strategies: one for each category, from a notional on."""
    return spark.createDataFrame([(f"s-{c}-{n:g}", c, n) for c, n in zip(V.TYPES, (100.0, 500.0, 1000.0, 2000.0, 4000.0), strict=True)], "strategy_id string, category string, min_notional double")


STRATEGIES = "(SELECT unnest(['s-click-100', 's-error-500', 's-purchase-1000', 's-signup-2000', 's-view-4000']) AS strategy_id, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS sc, unnest([100, 500, 1000, 2000, 4000]) AS least)"
TAKEN = f"(SELECT c.*, s.strategy_id FROM contrarian c, {STRATEGIES} s WHERE c.category = s.sc AND c.notional >= s.least)"


def halves(spark, d):
    """Baseline (to the 20th) and current events of each strategy."""
    events = contrarian(spark, d)
    early = F.col("ts") < F.lit("2024-01-20").cast("timestamp")
    return M.register_baselines(events.where(early), strategies(spark)), M.register_baselines(events.where(~early), strategies(spark))


BASE = metrics_sql(f"(SELECT * FROM {TAKEN} WHERE ts < TIMESTAMP '2024-01-20')", "strategy_id")
NOW = metrics_sql(f"(SELECT * FROM {TAKEN} WHERE ts >= TIMESTAMP '2024-01-20')", "strategy_id")


@query("a46_strategy_baselines", WITH + f"SELECT strategy_id, n, wins, {ROUNDED} FROM {metrics_sql(TAKEN, 'strategy_id')}")
def a46(spark, d):
    return M.register_baselines(contrarian(spark, d), strategies(spark)).select("strategy_id", "n", "wins", *SHOWN)


ALERTS = f"""(SELECT strategy_id, metric, expected, observed, sigma, CASE WHEN abs(sigma) >= 2.5 THEN 'critical' WHEN abs(sigma) >= 1.5 THEN 'warning' END AS severity
 FROM (SELECT strategy_id, metric, expected, observed, (observed - expected) / nullif(err, 0) AS sigma FROM (
  SELECT n.strategy_id, unnest(['win_rate', 'roi', 'edge_points']) AS metric, unnest([b.win_rate, b.roi, b.edge_points]) AS expected, unnest([n.win_rate, n.roi, n.edge_points]) AS observed,
   unnest([sqrt(b.win_rate * (1 - b.win_rate)) / sqrt(n.n), n.std_return / sqrt(n.n), n.std_return * 100 / sqrt(n.n)]) AS err
  FROM {NOW} n JOIN {BASE} b USING (strategy_id) WHERE n.n >= 20)))"""


@query("a44_j14_drift_alerts", WITH + f"SELECT strategy_id, metric, severity, {r6({c: c for c in ('expected', 'observed', 'sigma')})} FROM {ALERTS} WHERE severity IS NOT NULL")
def a44(spark, d):
    return M.drift_alerts(*halves(spark, d))


@query(
    "a44_health",
    WITH
    + f""", a AS (SELECT strategy_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings FROM {ALERTS} GROUP BY 1)
SELECT strategy_id, n, coalesce(critical, 0) AS critical, coalesce(warnings, 0) AS warnings,
 CASE WHEN n < 20 THEN 'insufficient' WHEN coalesce(critical, 0) > 0 THEN 'critical' WHEN coalesce(warnings, 0) > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM {NOW} LEFT JOIN a USING (strategy_id)""",
)
def a44b(spark, d):
    return M.health(*halves(spark, d))


@query(
    "a45_recalibrated_kelly",
    WITH
    + f"SELECT strategy_id, {r6({'stake': 'CASE WHEN n.n < 20 THEN b.kelly ELSE greatest(b.kelly * 0.5, least(b.kelly * 1.5, greatest(0, 2 * n.win_rate - 1) * 0.5)) END'})} FROM {NOW} n JOIN {BASE} b USING (strategy_id)",
)
def a45(spark, d):
    base, now = halves(spark, d)
    both = now.select("strategy_id", "win_rate", "n").join(base.select("strategy_id", "kelly"), "strategy_id")
    return both.select("strategy_id", M.recalibrated_kelly(F.col("kelly"), F.col("win_rate"), F.col("n")).alias("stake"))


ROLLED = f"""(SELECT strategy_id, trade_id, k - 10 AS k, win_rate FROM (SELECT strategy_id, trade_id, row_number() OVER o AS k, count(*) OVER (PARTITION BY strategy_id) AS m,
 avg(CAST(outcome_won AS DOUBLE)) OVER (PARTITION BY strategy_id ORDER BY ts, trade_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS win_rate
 FROM {TAKEN} WHERE {RESOLVED} WINDOW o AS (PARTITION BY strategy_id ORDER BY ts, trade_id)) WHERE m >= 20 AND k >= 10)"""


def rolled(spark, d):
    taken = contrarian(spark, d).join(strategies(spark), "category").where("notional >= min_notional")
    return M.rolling_win_rate(taken, "strategy_id")


@query("w10_rolling_win_rate", WITH + f"SELECT strategy_id, trade_id, k, {r6({'win_rate': 'win_rate'})} FROM {ROLLED}")
def w10(spark, d):
    return rolled(spark, d).select("strategy_id", "trade_id", "k", "win_rate")


@query(
    "w9_page_hinkley",
    WITH.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", v AS (SELECT strategy_id, k, win_rate AS x, count(*) OVER (PARTITION BY strategy_id) AS m FROM {ROLLED}),
t AS (SELECT strategy_id, avg(x) AS target FROM v WHERE k < floor(m / 3) AND m >= 5 GROUP BY 1),
s AS (
 SELECT v.strategy_id, k, greatest(0, x - target - 0.01) AS plus, greatest(0, target - x - 0.01) AS minus FROM v JOIN t USING (strategy_id) WHERE k = 0
 UNION ALL
 SELECT s.strategy_id, v.k, greatest(0, s.plus + x - target - 0.01), greatest(0, s.minus + target - x - 0.01) FROM s JOIN v ON v.strategy_id = s.strategy_id AND v.k = s.k + 1 JOIN t ON t.strategy_id = s.strategy_id)
SELECT strategy_id, count(*) AS n, min(CASE WHEN plus > 0.5 OR minus > 0.5 THEN k END) AS change_at, {r6({"max_plus": "max(plus)", "max_minus": "max(minus)"})}, count(*) FILTER (plus > 0.5 OR minus > 0.5) > 0 AS changed FROM s GROUP BY 1""",
)
def w9(spark, d):
    return M.page_hinkley(rolled(spark, d), "strategy_id", "win_rate", "k")


@query(
    "a41_performance_history",
    WITH
    + f""", y AS (SELECT strategy_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, count(*) AS trades, CAST(count_if(outcome_won) AS BIGINT) AS wins,
 sum(CASE WHEN outcome_won THEN notional * (1 - price) ELSE -notional * price END) AS pnl FROM {TAKEN} WHERE {RESOLVED} GROUP BY 1, 2)
SELECT strategy_id, day, trades, wins, {r6({"pnl": "pnl", "pnl_7d": "sum(pnl) OVER w", "win_rate_7d": "sum(wins) OVER w / sum(trades) OVER w"})}, CAST(sum(trades) OVER w AS BIGINT) AS trades_7d
FROM y WINDOW w AS (PARTITION BY strategy_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def a41(spark, d):
    return M.performance_history(contrarian(spark, d).join(strategies(spark), "category").where("notional >= min_notional"), "strategy_id", date(2024, 1, 1))


@query(
    "t11_p11_critical_alerts",
    WITH + f"SELECT strategy_id, metric, {r6({'sigma': 'sigma'})} FROM {ALERTS} WHERE severity = 'critical' ORDER BY round(abs(sigma), 9) DESC, strategy_id, metric LIMIT 10",
)
def t11(spark, d):
    return M.drift_alerts(*halves(spark, d)).where("severity = 'critical'").orderBy(F.desc(F.round(F.abs("sigma"), 9)), "strategy_id", "metric").limit(10).select("strategy_id", "metric", "sigma")


@query(
    "t10_ranked_strategies",
    WITH + f"SELECT strategy_id, {r6({'roi': 'roi'})}, row_number() OVER (ORDER BY round(roi, 9) DESC, strategy_id) AS place FROM {metrics_sql(TAKEN, 'strategy_id')}",
)
def t10(spark, d):
    return P.ranks(M.register_baselines(contrarian(spark, d), strategies(spark)).withColumnRenamed("strategy_id", "config_id"), ("roi",)).select(F.col("config_id").alias("strategy_id"), "roi", F.col("rank_roi").alias("place"))
