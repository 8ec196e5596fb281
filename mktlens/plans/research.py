"""Queries over contrarian events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import time_bucket
from ..operators import events as E
from ..operators import features as X
from ..operators import performance as P
from ..operators import statistics as S
from ..params import EventFilter, Grid
from ..sources import views as V
from .registry import query
from .sqlviews import BOOK, views

WITH = views("events")
WITH_BOOKS = views("events", "levels") + BOOK
MODES = ("price_only", "vs_trend", "vs_ofi", "vs_both")


def contrarian(spark, d: str) -> DataFrame:
    return E.contrarian_events(V.trades(spark, d), V.markets(spark, d), V.wallets(spark, d))


def r6(expressions: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {n}" for n, e in expressions.items())


@query(
    "w24_contrarian_events",
    WITH
    + "SELECT trade_id, condition_id, token_id, outcome, category, wallet, is_tail, is_price_contrarian, is_against_trend, is_against_ofi, is_contrarian, outcome_won, "
    + r6({c: c for c in ("size_percentile", "size_zscore", "price_trend_30m", "ofi_30m", "drift_30m", "drift_60m")})
    + ", CAST(round(minutes_before_close * 60000000) AS BIGINT) AS close_us FROM contrarian",
)
def w24(spark, d):
    return contrarian(spark, d).select(
        "trade_id", "condition_id", "token_id", "outcome", "category", "wallet", "is_tail", "is_price_contrarian", "is_against_trend", "is_against_ofi", "is_contrarian", "outcome_won",
        "size_percentile", "size_zscore", "price_trend_30m", "ofi_30m", "drift_30m", "drift_60m", F.round(F.col("minutes_before_close") * 60_000_000).cast("long").alias("close_us"),
    )


@query(
    "w6_size_ranks",
    views("trades")
    + """, m AS (SELECT condition_id, median(notional) AS med FROM trades GROUP BY 1),
s AS (SELECT condition_id, median(abs(notional - med)) AS mad FROM trades JOIN m USING (condition_id) GROUP BY 1)
SELECT trade_id, """
    + r6({"size_percentile": "(rank() OVER (PARTITION BY condition_id ORDER BY notional) - 1) * 100.0 / count(*) OVER (PARTITION BY condition_id)", "size_zscore": "CASE WHEN mad = 0 THEN 0 ELSE (notional - med) / (1.4826 * mad) END"})
    + " FROM trades JOIN m USING (condition_id) JOIN s USING (condition_id)",
)
def w6(spark, d):
    return E.size_ranks(V.trades(spark, d)).select("trade_id", "size_percentile", "size_zscore")


@query(
    "w7_j6_j7_price_and_flow",
    views("trades")
    + ", t AS (SELECT *, epoch_us(ts) AS us FROM trades) SELECT trade_id, "
    + r6({
        "price_trend_30m": "price - coalesce(avg(price) OVER (PARTITION BY condition_id, token_id ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND 1 PRECEDING), price)",
        "ofi_30m": "coalesce(sum(CASE WHEN side = 'BUY' THEN notional ELSE -notional END) OVER (PARTITION BY condition_id ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND 1 PRECEDING), 0)",
        "drift_30m": "(last(price) OVER (PARTITION BY condition_id, token_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND 1800000000 FOLLOWING) - price) / price",
        "drift_60m": "(last(price) OVER (PARTITION BY condition_id, token_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND 3600000000 FOLLOWING) - price) / price",
    })
    + " FROM t",
)
def w7(spark, d):
    return E.price_and_flow(V.trades(spark, d)).select("trade_id", "price_trend_30m", "ofi_30m", "drift_30m", "drift_60m")


SUMS = """count(outcome_won) AS n, CAST(count_if(outcome_won) AS BIGINT) AS wins, coalesce(sum(notional) FILTER (outcome_won IS NOT NULL), 0) AS total_notional,
 coalesce(sum(notional * (1 - price)) FILTER (outcome_won), 0) AS win_pnl, coalesce(sum(-notional * price) FILTER (NOT outcome_won), 0) AS loss_pnl,
 coalesce(CAST(sum(CAST(price AS DECIMAL(18,8))) FILTER (outcome_won IS NOT NULL) AS DOUBLE), 0) AS price_sum, coalesce(sum(price * notional) FILTER (outcome_won IS NOT NULL), 0) AS price_notional,
 CAST(sum(CAST(CASE WHEN outcome_won THEN 1 - price WHEN NOT outcome_won THEN -price END AS DECIMAL(18,8))) AS DOUBLE) / nullif(count(outcome_won), 0) AS mean_return,
 stddev_samp(CASE WHEN outcome_won THEN 1 - price WHEN NOT outcome_won THEN -price END) AS std_return"""


def metrics_sql(source: str, by: str = "", weighted: bool = False, having: str = "") -> str:
    """The metrics of event_metrics / pnl_metrics over a relation, unrounded."""
    keys = f"{by}, " if by else ""
    price = "coalesce(price_notional / nullif(total_notional, 0), 0)" if weighted else "coalesce(price_sum / nullif(n, 0), 0)"
    return f"""(SELECT *, CASE WHEN avg_price > 0 AND avg_price < 1 THEN greatest(0, least(1, (win_rate * odds - (1 - win_rate)) / odds)) ELSE 0 END AS kelly
 FROM (SELECT *, coalesce(pnl / nullif(total_notional, 0), 0) AS roi, (win_rate - avg_price) * 100 AS edge_points,
   CASE WHEN loss_pnl <> 0 THEN win_pnl / abs(loss_pnl) WHEN win_pnl > 0 THEN 999 ELSE 0 END AS profit_factor,
   coalesce(mean_return / nullif(std_return, 0) * sqrt(252), 0) AS sharpe, CASE WHEN avg_price > 0 THEN (1 - avg_price) / avg_price ELSE 0 END AS odds
  FROM (SELECT *, coalesce(wins / nullif(n, 0), 0) AS win_rate, win_pnl + loss_pnl AS pnl, {price} AS avg_price
   FROM (SELECT {keys}{SUMS} FROM {source} {"GROUP BY " + by if by else ""} {having}))))"""


SHOWN = ("win_rate", "pnl", "roi", "avg_price", "edge_points", "profit_factor", "kelly", "sharpe")
ROUNDED = r6({c: c for c in SHOWN})


@query("a3_pnl_metrics", WITH + f"SELECT is_against_ofi, n, wins, {ROUNDED} FROM {metrics_sql('contrarian', 'is_against_ofi', True)}")
def a3(spark, d):
    return P.pnl_metrics(contrarian(spark, d), "is_against_ofi").select("is_against_ofi", "n", "wins", *SHOWN)


@query("a4_event_metrics", WITH + f"SELECT category, outcome, n, wins, {ROUNDED} FROM {metrics_sql('contrarian', 'category, outcome')}")
def a4(spark, d):
    return P.event_metrics(contrarian(spark, d), "category", "outcome").select("category", "outcome", "n", "wins", *SHOWN)


ERF = """(sign({x}) * (1 - ((((1.061405429 * t + -1.453152027) * t + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t * exp(-({x}) * ({x}))))"""


def correlated_sql(base: str, keys: str = "") -> str:
    """r, p_value, ci_low, ci_high from n and r (null where unusable) in a relation."""
    k = f"{keys}, " if keys else ""
    return f"""(SELECT {k}n, coalesce(r0, 0) AS r,
  CASE WHEN r0 IS NULL THEN 1 WHEN abs(r0) >= 1 THEN 0 ELSE greatest(0, least(1, 2 * (1 - 0.5 * (1 + (1 - ((((1.061405429 * t + -1.453152027) * t + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t * exp(-z * z)))))) END AS p_value,
  CASE WHEN r0 IS NULL THEN 0 WHEN abs(r0) >= 0.9999 THEN -1 ELSE greatest(-1, (exp(2 * (fz - h)) - 1) / (exp(2 * (fz - h)) + 1)) END AS ci_low,
  CASE WHEN r0 IS NULL THEN 0 WHEN abs(r0) >= 0.9999 THEN 1 ELSE least(1, (exp(2 * (fz + h)) - 1) / (exp(2 * (fz + h)) + 1)) END AS ci_high
 FROM (SELECT *, 1 / (1 + 0.3275911 * z) AS t, 1.96 / sqrt(nullif(n - 3, 0)) AS h, 0.5 * ln((1 + r0) / nullif(1 - r0, 0)) AS fz
  FROM (SELECT *, ts0 / sqrt(1 + ts0 * ts0 / (n - 2)) / sqrt(2.0) AS z
   FROM (SELECT *, abs(r0) * sqrt((n - 2) / nullif(1 - r0 * r0, 0)) AS ts0 FROM {base}))))"""


def biserial_sql(source: str, x: str, y: str, keys: str = "", where: str = "true") -> str:
    k = f"{keys}, " if keys else ""
    a, b = f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
    return correlated_sql(
        f"""(SELECT {k}n, CASE WHEN n >= 4 AND n1 > 0 AND n1 < n AND s > 0 THEN greatest(-1, least(1, c * sqrt((n - 1) / n))) END AS r0
   FROM (SELECT {k}count(*) AS n, sum({a}) AS n1, stddev_samp({b}) AS s, (avg({a} * {b}) - avg({a}) * avg({b})) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS c
    FROM {source} WHERE {where} {"GROUP BY " + keys if keys else ""}))""",
        keys,
    )


TAIL = r6({c: c for c in ("r", "p_value", "ci_low", "ci_high")})
RESOLVED = "outcome_won IS NOT NULL"


@query("a6_point_biserial", WITH + f"SELECT category, n, {TAIL} FROM {biserial_sql('contrarian', 'is_against_trend', 'outcome_won', 'category', RESOLVED)}")
def a6(spark, d):
    return S.point_biserial(contrarian(spark, d).where("outcome_won IS NOT NULL"), F.col("is_against_trend"), F.col("outcome_won"), ("category",))


RANKS = """(SELECT category, rank() OVER (PARTITION BY category ORDER BY notional) + (count(*) OVER (PARTITION BY category, notional) - 1) / 2 AS rx,
 rank() OVER (PARTITION BY category ORDER BY price) + (count(*) OVER (PARTITION BY category, price) - 1) / 2 AS ry FROM contrarian)"""


@query(
    "a7_spearman",
    WITH
    + f"SELECT category, n, {TAIL} FROM "
    + correlated_sql(f"(SELECT category, n, CASE WHEN n >= 4 THEN c END AS r0 FROM (SELECT category, count(*) AS n, corr(rx, ry) AS c FROM {RANKS} GROUP BY 1))", "category"),
)
def a7(spark, d):
    return S.spearman(contrarian(spark, d), "notional", "price", ("category",))


FLAGS = "CAST(is_price_contrarian AS INT) + CAST(is_against_trend AS INT) + CAST(is_against_ofi AS INT) + CAST(is_tail AS INT)"
AUC = """(SELECT coalesce((sum(rk) FILTER (outcome_won) - count_if(outcome_won) * (count_if(outcome_won) + 1) / 2) / nullif(count_if(outcome_won) * count_if(NOT outcome_won), 0), 0.5) AS auc
 FROM (SELECT outcome_won, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM (SELECT {score} AS s, outcome_won FROM {source} WHERE outcome_won IS NOT NULL)))"""


@query("a13_auc", WITH + "SELECT round(auc, 6) AS auc FROM " + AUC.format(score=FLAGS, source="contrarian"))
def a13(spark, d):
    scored = contrarian(spark, d).where("outcome_won IS NOT NULL").withColumn("s", F.expr(FLAGS))
    return S.auc(scored, "s", "outcome_won")


@query(
    "a5_correlation_summary",
    WITH
    + f"""SELECT 'vs_ofi' AS mode, total_events, resolved_events, markets, signals, {r6({"signal_win_rate": "swr", "r": "c.r", "p_value": "c.p_value", "ci_low": "c.ci_low", "ci_high": "c.ci_high", "pnl": "p.pnl", "roi": "p.roi", "profit_factor": "p.profit_factor", "edge_points": "p.edge_points", "kelly": "p.kelly", "lift": "(swr - 0.5) / 0.5", "signal_auc": "CASE WHEN signals >= 10 THEN a.auc END"})},
 c.p_value < 0.05 AS significant
FROM (SELECT count(*) AS total_events, count(outcome_won) AS resolved_events, count(DISTINCT condition_id) FILTER ({RESOLVED}) AS markets, CAST(count_if({RESOLVED} AND is_against_ofi) AS BIGINT) AS signals,
  coalesce(count_if(outcome_won AND is_against_ofi) / nullif(count_if({RESOLVED} AND is_against_ofi), 0), 0) AS swr FROM contrarian),
 {biserial_sql("contrarian", "is_against_ofi", "outcome_won", "", RESOLVED)} c, {AUC.format(score=FLAGS, source="contrarian")} a,
 {metrics_sql("(SELECT * FROM contrarian WHERE is_against_ofi)", "", True)} p""",
)
def a5(spark, d):
    return P.correlation_summary(contrarian(spark, d), EventFilter())


@query(
    "a27_compare_modes",
    WITH
    + f"""SELECT mode, n, {TAIL}, {r6({"adjusted_p": "adjusted_p"})}, adjusted_p <= 0.05 AS significant, row_number() OVER (ORDER BY round(r, 3) DESC, adjusted_p, mode) AS rank
FROM (SELECT *, least(1, min(p_value * 4 / rk) OVER (ORDER BY p_value DESC, mode DESC)) AS adjusted_p
 FROM (SELECT *, row_number() OVER (ORDER BY p_value, mode) AS rk FROM {biserial_sql("(SELECT *, unnest(['price_only', 'vs_trend', 'vs_ofi', 'vs_both']) AS mode, unnest([is_price_contrarian, is_against_trend, is_against_ofi, is_contrarian]) AS signal FROM contrarian)", "signal", "outcome_won", "mode", RESOLVED)}))""",
)
def a27(spark, d):
    return P.compare_modes(contrarian(spark, d), EventFilter(), MODES)


@query(
    "a15_time_split",
    WITH
    + f"SELECT part, n, wins, {ROUNDED} FROM "
    + metrics_sql(
        f"""(SELECT *, CASE WHEN k < floor(0.6 * m) THEN 'train' WHEN k < floor(0.8 * m) THEN 'validation' ELSE 'test' END AS part
  FROM (SELECT *, row_number() OVER (ORDER BY ts, trade_id) - 1 AS k, count(*) OVER () AS m FROM contrarian WHERE {RESOLVED}) WHERE m >= 30)""",
        "part",
    ),
)
def a15(spark, d):
    return P.time_split(contrarian(spark, d)).select("part", "n", "wins", *SHOWN)


BUCKET = "CASE WHEN m <= 5 THEN '0-5m' WHEN m <= 15 THEN '5-15m' WHEN m <= 30 THEN '15-30m' WHEN m <= 60 THEN '30-60m' WHEN m <= 120 THEN '60-120m' ELSE '120m+' END".replace("m <", "minutes_before_close <")
AGE = "CASE WHEN wallet_age_us IS NULL THEN 'unknown' WHEN wallet_age_us < 604800000000 THEN 'new' WHEN wallet_age_us < 2592000000000 THEN 'recent' WHEN wallet_age_us < 15552000000000 THEN 'established' ELSE 'old' END"


def broken_down(factor: str) -> str:
    return WITH + f"SELECT {factor} AS factor, count(*) AS n, {r6({'win_rate': 'avg(CAST(outcome_won AS DOUBLE))', 'lift': '(avg(CAST(outcome_won AS DOUBLE)) - 0.5) / 0.5'})} FROM contrarian WHERE {RESOLVED} GROUP BY 1 HAVING count(*) >= 3"


@query("a9_breakdown_time", broken_down(BUCKET))
def a9_time(spark, d):
    return P.breakdown(contrarian(spark, d), time_bucket("minutes_before_close"))


@query("a9_breakdown_category", broken_down("category"))
def a9_category(spark, d):
    return P.breakdown(contrarian(spark, d), F.col("category"))


@query("a9_breakdown_wallet_age", broken_down(AGE))
def a9_age(spark, d):
    return P.breakdown(contrarian(spark, d), P.age_band(F.col("wallet_age_us")))


LIQUIDITY = WITH_BOOKS + """, spreads AS (SELECT c.*, b.spread_bps FROM contrarian c ASOF LEFT JOIN (SELECT token_id, ts, spread_bps FROM books WHERE mid IS NOT NULL) b ON b.token_id = c.token_id AND b.ts <= c.ts),
tenths AS (SELECT *, least(9, floor((rank() OVER (ORDER BY spread_bps) - 1) / ceil(count(*) OVER () / 10))) + 1 AS decile FROM spreads WHERE outcome_won IS NOT NULL AND spread_bps IS NOT NULL)
"""


@query(
    "a9_w13_breakdown_liquidity",
    LIQUIDITY + f"SELECT CAST(decile AS BIGINT) AS factor, count(*) AS n, {r6({'win_rate': 'avg(CAST(outcome_won AS DOUBLE))', 'lift': '(avg(CAST(outcome_won AS DOUBLE)) - 0.5) / 0.5'})} FROM tenths GROUP BY 1 HAVING count(*) >= 3",
)
def a9_liquidity(spark, d):
    events = P.with_book(contrarian(spark, d), X.book_metrics(V.book_levels(spark, d)))
    return P.breakdown(P.with_decile(events, "spread_bps"), F.col("decile"))


def interval_sql(relation: str, key: str, confidence: float = 0.95) -> str:
    """ci_low and ci_high of the win rate in a relation (key, n, wins): quantiles of the binomial distribution."""
    side = (1 - confidence) / 2
    return f"""(SELECT {key}, n, wins, min(k) FILTER (cdf >= {side}) / n AS ci_low, min(k) FILTER (cdf >= {1 - side}) / n AS ci_high
 FROM (SELECT *, sum(CASE WHEN wins IN (0, n) THEN CASE WHEN k = wins THEN 1 ELSE 0 END
   ELSE exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(wins / n) + (n - k) * ln(1 - wins / n)) END) OVER (PARTITION BY {key} ORDER BY k) AS cdf
  FROM (SELECT {key}, n, wins, unnest(generate_series(0, n)) AS k FROM {relation})) GROUP BY 1, 2, 3)"""


@query(
    "a14_bootstrap_intervals",
    WITH + f"SELECT factor, n, wins, {r6({'ci_low': 'ci_low', 'ci_high': 'ci_high', 'win_rate': 'wins / n'})} FROM " + interval_sql(f"(SELECT category AS factor, count(*) AS n, CAST(count_if(outcome_won) AS BIGINT) AS wins FROM contrarian WHERE {RESOLVED} GROUP BY 1 HAVING count(*) >= 3)", "factor"),
)
def a14(spark, d):
    return P.breakdown_intervals(contrarian(spark, d), F.col("category")).select("factor", "n", "wins", "ci_low", "ci_high", "win_rate")


GAIN = "CASE WHEN outcome_won THEN 1 - price ELSE -price END"
WEIGHT = " + ".join(f"CASE WHEN u >= {share!r} THEN 1 ELSE 0 END" for share in S.POISSON)


@query(
    "a14_resampled_means",
    WITH
    + f""", e AS (SELECT category, trade_id, {GAIN} AS gain FROM contrarian WHERE {RESOLVED}),
h AS (SELECT category, gain, b, ((trade_id % {S.PRIME}) * {S.FACTORS[0]} % {S.PRIME} + b * {S.FACTORS[1]}) % {S.PRIME} * {S.FACTORS[2]} % {S.PRIME} AS h FROM e, (SELECT unnest(generate_series(1, 1000)) AS b)),
u AS (SELECT category, gain, b, xor(h, h >> 15) % {S.PRIME} * {S.FACTORS[3]} % {S.PRIME} / {S.PRIME} AS u FROM h),
m AS (SELECT category, b, sum(gain * w) / nullif(sum(w), 0) AS m FROM (SELECT category, gain, b, {WEIGHT} AS w FROM u) GROUP BY 1, 2),
i AS (SELECT category, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY 1)
SELECT category, n, {r6({"mean": "mean", "ci_low": "ci_low", "ci_high": "ci_high"})} FROM (SELECT category, count(*) AS n, avg(gain) AS mean FROM e GROUP BY 1) JOIN i USING (category)""",
)
def a14_means(spark, d):
    """Returns by category, resampled: unlike win rates, their distribution has no closed form."""
    gain = F.when(F.col("outcome_won"), 1 - F.col("price")).otherwise(-F.col("price"))
    return S.bootstrap_mean(contrarian(spark, d).where("outcome_won IS NOT NULL").withColumn("gain", gain), "gain", "trade_id", ("category",))


@query(
    "a16_benjamini_hochberg",
    WITH
    + f"""SELECT condition_id, n, {r6({"p_value": "p_value", "adjusted_p": "adjusted_p"})}, adjusted_p <= 0.05 AS significant
FROM (SELECT *, least(1, min(p_value * m / rk) OVER (ORDER BY p_value DESC, condition_id DESC)) AS adjusted_p
 FROM (SELECT *, row_number() OVER (ORDER BY p_value, condition_id) AS rk, count(*) OVER () AS m FROM {biserial_sql("contrarian", "is_price_contrarian", "outcome_won", "condition_id", RESOLVED)}))""",
)
def a16(spark, d):
    tests = S.point_biserial(contrarian(spark, d).where("outcome_won IS NOT NULL"), F.col("is_price_contrarian"), F.col("outcome_won"), ("condition_id",))
    return S.benjamini_hochberg(tests, "p_value", "condition_id").select("condition_id", "n", "p_value", "adjusted_p", "significant")


@query(
    "a17_roc_curve",
    WITH
    + f"""SELECT {r6({"threshold": "k / 100.0", "tpr": "count_if(outcome_won AND st >= k) / nullif(count_if(outcome_won), 0)", "fpr": "count_if(NOT outcome_won AND st >= k) / nullif(count_if(NOT outcome_won), 0)"})}
FROM range(101) r(k), (SELECT outcome_won, least(100, greatest(0, floor(price * 100 + 1e-9))) AS st FROM contrarian WHERE {RESOLVED}) GROUP BY k""",
)
def a17(spark, d):
    return S.roc_curve(contrarian(spark, d).where("outcome_won IS NOT NULL"), "price", "outcome_won")


@query(
    "a18_calibration_curve",
    WITH
    + f"SELECT CAST(least(9, floor(price * 10)) AS BIGINT) AS bin, count(*) AS n, {r6({'mean_predicted': 'avg(price)', 'mean_actual': 'avg(CAST(outcome_won AS DOUBLE))'})} FROM contrarian WHERE {RESOLVED} GROUP BY 1",
)
def a18(spark, d):
    return S.calibration_curve(contrarian(spark, d).where("outcome_won IS NOT NULL"), "price", "outcome_won")


@query(
    "a23_sharpe",
    WITH + f"SELECT category, {r6({'sharpe': 'sharpe', 'mean_return': 'mean_return', 'std_return': 'std_return'})} FROM {metrics_sql('contrarian', 'category')}",
)
def a23(spark, d):
    return P.event_metrics(contrarian(spark, d), "category").select("category", "sharpe", "mean_return", "std_return")


@query(
    "w14_j13_rolling_correlation",
    WITH
    + f"SELECT CAST(day AS VARCHAR) AS day, n, {TAIL} FROM {biserial_sql('(SELECT c.*, CAST(s.day AS DATE) AS day FROM contrarian c JOIN (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM contrarian), (SELECT max(CAST(ts AS DATE)) FROM contrarian), INTERVAL 1 DAY)) AS day) s ON CAST(c.ts AS DATE) <= s.day AND CAST(c.ts AS DATE) > s.day - INTERVAL 7 DAY)', 'is_price_contrarian', 'outcome_won', 'day', RESOLVED)} WHERE n >= 5",
)
def w14(spark, d):
    return P.rolling_correlation(contrarian(spark, d), "price_only")


GRID = """(SELECT c.*, mode || '|' || gn || '|' || gw || '|' || gp || '|' || gt || '|' || go AS config_id FROM contrarian c,
 (SELECT unnest(['vs_ofi', 'vs_trend', 'price_only', 'vs_both']) AS mode), (SELECT unnest(['500', '1000', '5000']) AS gn), (SELECT unnest(['30', '60', '120']) AS gw),
 (SELECT unnest(['0.1-0.25', '0.25-0.4', '0.4-0.6', '0.6-0.8', '0.8-1']) AS gp), (SELECT unnest(['0-15', '15-30', '30-60', '45-60']) AS gt), (SELECT unnest(['Yes', 'No', 'all']) AS go)
 WHERE CASE mode WHEN 'price_only' THEN is_price_contrarian WHEN 'vs_trend' THEN is_against_trend WHEN 'vs_ofi' THEN is_against_ofi ELSE is_contrarian END
  AND notional >= CAST(gn AS DOUBLE) AND minutes_before_close <= CAST(gw AS DOUBLE) AND price BETWEEN CAST(split_part(gp, '-', 1) AS DOUBLE) AND CAST(split_part(gp, '-', 2) AS DOUBLE)
  AND minutes_before_close BETWEEN CAST(split_part(gt, '-', 1) AS DOUBLE) AND CAST(split_part(gt, '-', 2) AS DOUBLE) AND (go = 'all' OR outcome = go))"""
NORMAL = "0.5 * (1 + sign(z) * (1 - ((((1.061405429 * t + -1.453152027) * t + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t * exp(-z * z)))"


def tested_sql(least: int) -> str:
    return f"(SELECT *, 1 - {NORMAL} AS p_value FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS t FROM (SELECT *, (win_rate - 0.05) / sqrt(0.05 * 0.95 / n) / sqrt(2.0) AS z FROM {metrics_sql(GRID, 'config_id', False, f'HAVING count(outcome_won) >= {least}')})))"


RANKED = ", ".join(f"row_number() OVER (ORDER BY round({o}, 9) DESC, config_id) AS rank_{o}" for o in P.OBJECTIVES)


def search_sql(least: int) -> str:
    no_worse, better = (" AND ".join(f"round(b.{o}, 9) >= round(a.{o}, 9)" for o in P.OBJECTIVES), " OR ".join(f"round(b.{o}, 9) > round(a.{o}, 9)" for o in P.OBJECTIVES))
    return (
        WITH
        + f""", g AS (SELECT *, {RANKED} FROM (SELECT *, least(1, min(p_value * m / rk) OVER (ORDER BY p_value DESC, config_id DESC)) AS adjusted_p
 FROM (SELECT *, row_number() OVER (ORDER BY p_value, config_id) AS rk, count(*) OVER () AS m FROM {tested_sql(least)})))
SELECT config_id, n, wins, {ROUNDED}, {r6({"p_value": "p_value", "adjusted_p": "adjusted_p"})}, adjusted_p < 0.1 AS significant, {", ".join(f"rank_{o}" for o in P.OBJECTIVES)},
 NOT EXISTS (SELECT 1 FROM g b WHERE b.config_id <> a.config_id AND {no_worse} AND ({better})) AS pareto FROM g a"""
    )


SEARCHED = ("config_id", "n", "wins", *SHOWN, "p_value", "adjusted_p", "significant", *(f"rank_{o}" for o in P.OBJECTIVES), "pareto")


@query("a24_j11_w12_grid_search", search_sql(30))
def a24(spark, d):
    return P.grid_search(contrarian(spark, d), Grid()).select(*SEARCHED)


@query("a24_grid_search_all", search_sql(1))
def a24_all(spark, d):
    """Every configuration with an event at all."""
    return P.grid_search(contrarian(spark, d), Grid(min_events=1)).select(*SEARCHED)


@query(
    "a24_grid_intervals",
    WITH + f"SELECT config_id, n, wins, {r6({'ci_low': 'ci_low', 'ci_high': 'ci_high'})} FROM " + interval_sql(f"(SELECT config_id, count(outcome_won) AS n, CAST(count_if(outcome_won) AS BIGINT) AS wins FROM {GRID} GROUP BY 1 HAVING count(outcome_won) >= 1)", "config_id"),
)
def a24_intervals(spark, d):
    return P.grid_intervals(contrarian(spark, d), Grid(min_events=1))


@query("j12_pareto", search_sql(5).replace("SELECT config_id, n, wins", "SELECT config_id, roi, sharpe FROM (SELECT config_id, n, wins", 1) + ") WHERE pareto")
def j12(spark, d):
    return P.grid_search(contrarian(spark, d), Grid(min_events=5)).where("pareto").select("config_id", "roi", "sharpe")


@query(
    "a25_information_ratio",
    WITH.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", daily AS (SELECT config_id, CAST(ts AS DATE) AS day, count(*) AS n, count_if(outcome_won) AS w, sum(price) AS p FROM {GRID} WHERE {RESOLVED} GROUP BY 1, 2),
starts AS (SELECT config_id, min(day) AS start FROM daily GROUP BY 1
 UNION ALL SELECT s.config_id, min(d.day) FROM starts s JOIN daily d ON d.config_id = s.config_id AND d.day >= s.start + 7 GROUP BY s.config_id),
weeks AS (SELECT *, lead(start) OVER (PARTITION BY config_id ORDER BY start) AS past FROM starts),
edges AS (SELECT config_id, start, (sum(w) - sum(p)) / sum(n) AS edge FROM weeks JOIN daily USING (config_id) WHERE day >= start AND day < past GROUP BY 1, 2 HAVING sum(n) >= 3)
SELECT config_id, round(CASE WHEN any_value(t.n) < 10 OR count(edge) < 2 THEN 0 ELSE coalesce(avg(edge) / nullif(stddev_samp(edge), 0), 0) END, 6) + 0.0 AS information_ratio
FROM (SELECT config_id, sum(n) AS n FROM daily GROUP BY 1) t LEFT JOIN edges USING (config_id) GROUP BY 1""",
)
def a25(spark, d):
    return P.grid_information_ratio(contrarian(spark, d), Grid())


@query(
    "a26_sensitivity",
    WITH
    + f""", v AS (SELECT variant, n, win_rate, pnl, roi FROM {metrics_sql("(SELECT c.*, v.variant FROM contrarian c, (SELECT unnest(['base', '500.0', '1000.0', '5000.0']) AS variant) v WHERE is_price_contrarian AND (v.variant = 'base' OR notional >= TRY_CAST(v.variant AS DOUBLE)))", "variant")})
SELECT a.variant, a.n, {r6({"win_rate": "a.win_rate", "roi": "a.roi", "pnl": "a.pnl", "delta_win_rate": "a.win_rate - b.win_rate", "delta_roi": "a.roi - b.roi", "delta_pnl": "a.pnl - b.pnl"})}, abs(a.roi - b.roi) > 0.05 AS significant
FROM v a, (SELECT * FROM v WHERE variant = 'base') b WHERE a.variant <> 'base'""",
)
def a26(spark, d):
    out = P.sensitivity(contrarian(spark, d), EventFilter(), "min_notional", (500.0, 1000.0, 5000.0), "price_only")
    return out.select("variant", "n", "win_rate", "roi", "pnl", "delta_win_rate", "delta_roi", "delta_pnl", "significant")


@query(
    "a40_correlation_rollups",
    WITH
    + f"SELECT CAST(date AS VARCHAR) AS date, CAST(window_days AS BIGINT) AS window_days, round(min_notional, 6) AS min_notional, CAST(max_minutes AS BIGINT) AS max_minutes, mode, n, {TAIL} FROM "
    + biserial_sql(
        """(SELECT c.*, CAST(s.date AS DATE) AS date, window_days, min_notional, max_minutes, mode,
 CASE mode WHEN 'vs_ofi' THEN is_against_ofi ELSE is_price_contrarian END AS signal FROM contrarian c,
 (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS date) s, (SELECT unnest([7, 30]) AS window_days), (SELECT unnest([100.0, 1000.0]) AS min_notional),
 (SELECT unnest([120, 1440]) AS max_minutes), (SELECT unnest(['vs_ofi', 'price_only']) AS mode)
 WHERE CAST(c.ts AS DATE) <= s.date AND date_diff('day', CAST(c.ts AS DATE), CAST(s.date AS DATE)) < window_days AND notional >= min_notional AND minutes_before_close <= max_minutes)""",
        "signal",
        "outcome_won",
        "date, window_days, min_notional, max_minutes, mode",
        RESOLVED,
    ),
)
def a40(spark, d):
    return P.daily_rollups(contrarian(spark, d), date(2024, 1, 31), (7, 30), (100.0, 1000.0), (120, 1440), ("vs_ofi", "price_only"))


@query(
    "p7_p8_p9_filter_events",
    WITH
    + f"""SELECT trade_id, condition_id, is_against_trend AS contrarian, {r6({"price": "price", "notional": "notional"})} FROM contrarian
WHERE end_date > TIMESTAMP '2024-01-01' AND minutes_before_close <= 720 AND notional >= 500 AND category IN ('click', 'view') AND price BETWEEN 0.1 AND 0.9 AND outcome = 'Yes'
 AND size_zscore >= 0 AND coalesce(size_zscore <= 6, true) AND minutes_before_close >= 30 AND sign(ofi_30m) <> sign(price_trend_30m)""",
)
def p7(spark, d):
    f = EventFilter(lookback_days=30, window_minutes=720, min_notional=500.0, mode="vs_trend", categories=("click", "view"), min_price=0.1, max_price=0.9, outcome="Yes", min_zscore=0.0, max_zscore=6.0, min_minutes=30, ofi_trend_disagree=True)
    return E.filter_events(contrarian(spark, d), f).select("trade_id", "condition_id", E.contrarian_flag(f.mode).alias("contrarian"), "price", "notional")


@query(
    "j1_t8_recent_signals",
    WITH
    + f"""SELECT trade_id, condition_id, question, {r6({"notional": "notional"})}, CASE WHEN outcome_won IS NULL THEN 'pending' WHEN outcome_won THEN 'won' ELSE 'lost' END AS status
FROM contrarian WHERE is_against_ofi ORDER BY ts DESC, trade_id LIMIT 50""",
)
def t8(spark, d):
    status = F.when(F.col("outcome_won").isNull(), "pending").when(F.col("outcome_won"), "won").otherwise("lost")
    rows = E.filter_events(contrarian(spark, d), EventFilter()).where(E.contrarian_flag("vs_ofi"))
    return rows.orderBy(F.desc("ts"), "trade_id").limit(50).select("trade_id", "condition_id", "question", "notional", status.alias("status"))


@query(
    "t9_events_page",
    WITH + f"SELECT trade_id, condition_id, {r6({'notional': 'notional'})}, total, total > 150 AS has_more FROM (SELECT *, count(*) OVER () AS total FROM contrarian) ORDER BY notional DESC, trade_id LIMIT 50 OFFSET 100",
)
def t9(spark, d):
    rows = contrarian(spark, d)
    page = rows.orderBy(F.desc("notional"), "trade_id").offset(100).limit(50).select("trade_id", "condition_id", "notional")
    return page.crossJoin(rows.agg(F.count(F.lit(1)).alias("total"))).withColumn("has_more", F.col("total") > 150)  # the total is one row
