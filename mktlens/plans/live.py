"""Queries of features, scores and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import numeric as N
from ..functions import scores as S
from ..operators import features as X
from ..operators import statistics as ST
from ..sources import views as V
from .registry import query
from .research import r6
from .sqlviews import BOOK, views

HOUR = "(PARTITION BY token_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)"
FIVE = "(PARTITION BY token_id ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)"
ONE = "(PARTITION BY token_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)"
T = views("trades")

ROLLED = f""", roll AS (SELECT *, CASE WHEN n_60m < 10 THEN 0 ELSE (notional - median_60m) / (1.4826 * nullif(mad_60m, 0)) END AS robust_z,
 CASE WHEN n_60m < 5 THEN 50 ELSE len(list_filter(l, lambda x: x < notional)) * 100.0 / n_60m END AS percentile
 FROM (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - median_60m)), 'median') AS mad_60m
  FROM (SELECT *, count(*) OVER {HOUR} AS n_60m, median(notional) OVER {HOUR} AS median_60m, list(notional) OVER {HOUR} AS l,
   quantile_cont(notional, 0.95) OVER {HOUR} AS q95_60m, quantile_cont(notional, 0.99) OVER {HOUR} AS q99_60m FROM trades)))"""


@query("w1_w4_rolling_size", T + ROLLED + f"SELECT trade_id, n_60m, {r6({c: c for c in ('median_60m', 'mad_60m', 'q95_60m', 'q99_60m', 'robust_z', 'percentile')})} FROM roll")
def w4(spark, d):
    return X.rolling_size(V.trades(spark, d)).select("trade_id", "n_60m", "median_60m", "mad_60m", "q95_60m", "q99_60m", "robust_z", "percentile")


@query(
    "w5_outliers",
    T
    + f""", m AS (SELECT token_id, median(notional) AS med FROM trades GROUP BY 1), s AS (SELECT token_id, median(abs(notional - med)) AS mad FROM trades JOIN m USING (token_id) GROUP BY 1)
SELECT trade_id, {r6({"z": "(notional - med) / (1.4826 * mad)"})} FROM trades JOIN m USING (token_id) JOIN s USING (token_id) WHERE mad > 0 AND abs((notional - med) / (1.4826 * mad)) > 3""",
)
def w5(spark, d):
    from ..operators.events import size_ranks

    return size_ranks(V.trades(spark, d), ("token_id",)).where(F.abs("size_zscore") > 3).select("trade_id", F.col("size_zscore").alias("z"))


@query(
    "w2_w3_trade_pace",
    T
    + f"""SELECT trade_id, count(*) OVER {ONE} AS trades_1m, count(*) OVER {FIVE} AS trades_5m, {r6({"avg_gap": f"avg(CASE WHEN gap <= 300 THEN gap END) OVER {FIVE}", "min_gap": f"min(CASE WHEN gap <= 300 THEN gap END) OVER {FIVE}"})}
FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY token_id ORDER BY ts, trade_id)) / 1000000.0 AS gap FROM trades)""",
)
def w3(spark, d):
    return X.trade_pace(V.trades(spark, d)).select("trade_id", "trades_1m", "trades_5m", "avg_gap", "min_gap")


HAWKES = """(SELECT a.trade_id, 0.1 + 0.5 * sum(exp(-0.1 * (epoch_us(a.ts) - epoch_us(b.ts)) / 1000000.0)) AS intensity FROM trades a JOIN trades b ON b.token_id = a.token_id
 AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 400000000 AND epoch_us(a.ts) GROUP BY 1)"""


@query(
    "w11_hawkes_intensity",
    T + f"SELECT trade_id, {r6({'intensity': 'intensity', 'intensity_ratio': 'intensity / 0.1', 'burst_score': 'greatest(0, least(1, (intensity / 0.1 - 1) / 4))'})}, intensity / 0.1 > 2 AS burst FROM {HAWKES}",
)
def w11(spark, d):
    return X.hawkes_intensity(V.trades(spark, d)).select("trade_id", "intensity", "intensity_ratio", "burst_score", "burst")


@query(
    "w8_cusum",
    T.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", c AS (SELECT condition_id AS key, epoch_us(ts) // 3600000000 AS h, CAST(count(*) AS DOUBLE) AS x FROM trades GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER w AS n, avg(x) OVER w AS mean, stddev_samp(x) OVER w AS dev FROM c WINDOW w AS (PARTITION BY key ORDER BY h ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, CASE WHEN n >= 2 AND dev > 1e-12 THEN (x - mean) / dev ELSE 0 END AS z FROM z),
s AS (SELECT key, n, greatest(0, z) AS s FROM y WHERE n = 1 UNION ALL SELECT s.key, y.n, greatest(0, s.s + y.z) FROM s JOIN y ON y.key = s.key AND y.n = s.n + 1)
SELECT s.key, CAST(max(s.n) AS BIGINT) AS n, {r6({"statistic": "max_by(s.s, s.n)", "score": "greatest(0, least(1, max_by(s.s, s.n) / 5))"})}, CAST(coalesce(min(CASE WHEN s.s > 5 THEN s.n END), 0) AS BIGINT) AS change_at,
 CASE WHEN max_by(s.s, s.n) < 2 THEN 'none' WHEN max_by(y.x, y.n) > avg(y.x) THEN 'increase' ELSE 'decrease' END AS direction FROM s JOIN y ON y.key = s.key AND y.n = s.n GROUP BY 1""",
)
def w8(spark, d):
    per_hour = V.trades(spark, d).groupBy(F.col("condition_id").alias("key"), F.floor(F.unix_micros("ts") / F.lit(3_600_000_000)).alias("h")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    return X.cusum(per_hour, "key", "h", "x").na.fill(0, ["change_at"]).select("key", "n", "statistic", "score", "change_at", "direction")


BOOK_COLUMNS = ("best_bid", "best_ask", "mid", "spread_bps", "bid_depth", "ask_depth", "imbalance", "imbalance_top5", "thin_ratio", "book_imbalance_score", "thin_opposite_score", "spread_score", "depth_score")


@query("f8_f9_f10_book_metrics", views("levels") + BOOK + f"SELECT snapshot_id, thin_side, is_asymmetric, depth_adequate, {r6({c: c for c in BOOK_COLUMNS})} FROM books")
def f9(spark, d):
    return X.book_metrics(V.book_levels(spark, d)).select("snapshot_id", "thin_side", "is_asymmetric", "depth_adequate", *BOOK_COLUMNS)


@query(
    "j3_as_of_book",
    views("trades", "levels") + BOOK + f"SELECT trade_id, coalesce(snapshot_id, -1) AS snapshot_id, {r6({'mid': 'mid', 'imbalance': 'imbalance'})} FROM trades t ASOF LEFT JOIN (SELECT token_id, ts, snapshot_id, mid, imbalance FROM books WHERE mid IS NOT NULL) b ON b.token_id = t.token_id AND b.ts <= t.ts",
)
def j3(spark, d):
    books = X.book_metrics(V.book_levels(spark, d)).where("mid is not null")
    return X.as_of_book(V.trades(spark, d), books, ("mid", "imbalance")).select("trade_id", F.coalesce("snapshot_id", F.lit(-1)).alias("snapshot_id"), "mid", "imbalance")


MIDS = "(SELECT token_id, ts, mid FROM books WHERE mid IS NOT NULL)"


@query(
    "w19_post_trade_impact",
    views("trades", "levels")
    + BOOK
    + f""", x AS (SELECT t.trade_id, CASE WHEN t.side = 'BUY' THEN 1 ELSE -1 END AS sign, b.mid AS mid_before, CASE WHEN a.ts > t.ts THEN a.mid END AS mid_30s, CASE WHEN c.ts > t.ts THEN c.mid END AS mid_60s FROM trades t
 ASOF LEFT JOIN {MIDS} b ON b.token_id = t.token_id AND b.ts <= t.ts
 ASOF LEFT JOIN {MIDS} a ON a.token_id = t.token_id AND a.ts <= t.ts + INTERVAL 30 SECONDS
 ASOF LEFT JOIN {MIDS} c ON c.token_id = t.token_id AND c.ts <= t.ts + INTERVAL 60 SECONDS),
y AS (SELECT *, sign * (mid_30s - mid_before) / nullif(mid_before, 0) AS drift_30s, sign * (mid_60s - mid_before) / nullif(mid_before, 0) AS drift_60s FROM x)
SELECT trade_id, {r6({c: c for c in ("mid_before", "mid_30s", "mid_60s", "drift_30s", "drift_60s")})}, {r6({"impact_score": "CASE WHEN coalesce(drift_60s, drift_30s) IS NULL THEN NULL ELSE greatest(0, least(1, abs(coalesce(drift_60s, drift_30s)) / 0.05)) END"})},
 coalesce(coalesce(drift_60s, drift_30s) > 0.01, false) AS confirmed FROM y""",
)
def w19(spark, d):
    return X.post_trade_impact(V.trades(spark, d), X.book_metrics(V.book_levels(spark, d)))


WALLET = """, wf AS (SELECT t.*, transaction_count, (epoch_us(t.ts) - epoch_us(first_seen_at)) / 86400000000.0 AS wallet_age_days FROM trades t LEFT JOIN wallets w USING (wallet)),
wg AS (SELECT *, CASE WHEN wallet_age_days IS NULL THEN 0.5 WHEN wallet_age_days < 7 THEN 1.0 WHEN wallet_age_days < 30 THEN 0.7 WHEN wallet_age_days < 180 THEN 0.3 ELSE 0.0 END AS wallet_new_score,
 CASE WHEN coalesce(transaction_count, 0) < 10 THEN 0.9 WHEN transaction_count < 50 THEN 0.6 WHEN transaction_count < 100 THEN 0.3 ELSE 0.1 END AS wallet_activity_score FROM wf)
"""


@query(
    "j4_f11_f14_wallet_features",
    views("trades", "wallets")
    + WALLET
    + f"""SELECT trade_id, {r6({"wallet_age_days": "wallet_age_days", "wallet_new_score": "wallet_new_score", "wallet_activity_score": "wallet_activity_score", "wallet_risk": "wallet_new_score * 0.40 + wallet_activity_score * 0.35"})},
 CASE WHEN wallet_age_days IS NULL THEN 'Unknown' WHEN wallet_age_days < 7 THEN 'New (' || CAST(floor(wallet_age_days) AS BIGINT) || 'd)' WHEN wallet_age_days < 30 THEN 'Recent (' || CAST(floor(wallet_age_days) AS BIGINT) || 'd)'
  WHEN wallet_age_days < 180 THEN CAST(floor(wallet_age_days) AS BIGINT) || 'd' ELSE 'Established' END AS wallet_age_text FROM wg""",
)
def j4(spark, d):
    return X.with_wallet(V.trades(spark, d), V.wallets(spark, d)).select("trade_id", "wallet_age_days", "wallet_new_score", "wallet_activity_score", "wallet_risk", "wallet_age_text")


RAMP = "coalesce(least(5, 1 + 2 * exp(-0.1 * s / 3600)), 1)"


@query(
    "j5_f3_f4_p15_time_features",
    views("trades", "markets")
    + f"""SELECT trade_id, {r6({"seconds_to_close": "s", "ramp": RAMP})}, coalesce(s <= 120, false) AS in_no_trade_zone,
 CASE WHEN s / 60 <= 5 THEN '0-5m' WHEN s / 60 <= 15 THEN '5-15m' WHEN s / 60 <= 30 THEN '15-30m' WHEN s / 60 <= 60 THEN '30-60m' WHEN s / 60 <= 120 THEN '60-120m' ELSE '120m+' END AS bucket
FROM (SELECT trade_id, greatest(0, (epoch_us(end_date) - epoch_us(ts)) / 1000000.0) AS s FROM trades LEFT JOIN markets USING (condition_id))""",
)
def j5(spark, d):
    rows = X.with_close(V.trades(spark, d), V.markets(spark, d))
    return rows.select("trade_id", "seconds_to_close", "ramp", "in_no_trade_zone", N.time_bucket(F.col("seconds_to_close") / 60).alias("bucket"))


FULL = (
    views("trades", "levels", "wallets", "markets")
    + ROLLED
    + BOOK
    + WALLET
    + f""", hk AS {HAWKES},
v AS (SELECT r.trade_id, r.token_id, r.condition_id, r.ts, r.notional, r.side, CASE WHEN n_60m < 5 THEN 0 ELSE
  CASE WHEN percentile < 95 THEN percentile / 95 * 0.5 WHEN percentile < 99 THEN 0.5 + (percentile - 95) / 4 * 0.4 WHEN percentile < 99.9 THEN 0.9 + (percentile - 99) / 0.9 * 0.08 ELSE least(1, 0.98 + (percentile - 99.9) / 0.1 * 0.02) END
  * CASE WHEN r.notional < 5000 THEN 0 WHEN r.notional < 10000 THEN 0.5 WHEN r.notional < 25000 THEN 0.75 ELSE 1 END END AS size_tail_score,
 coalesce(robust_z > 3 OR percentile > 99, false) AND n_60m >= 5 AS is_large, greatest(0, least(1, (intensity / 0.1 - 1) / 4)) AS burst_score, intensity / 0.1 > 2 AS burst,
 w.wallet_age_days, w.wallet_new_score, w.wallet_activity_score, greatest(0, (epoch_us(m.end_date) - epoch_us(r.ts)) / 1000000.0) AS s,
 coalesce(least(5, 1 + 2 * exp(-0.1 * greatest(0, (epoch_us(m.end_date) - epoch_us(r.ts)) / 1000000.0) / 3600)), 1) AS ramp,
 b.ts AS book_ts, b.mid, b.best_bid, b.best_ask, b.spread_bps, b.bid_depth, b.ask_depth, b.imbalance, b.book_imbalance_score, b.thin_opposite_score
 FROM roll r JOIN hk USING (trade_id) JOIN wg w USING (trade_id) LEFT JOIN markets m ON m.condition_id = r.condition_id
 ASOF LEFT JOIN (SELECT * FROM books WHERE mid IS NOT NULL) b ON b.token_id = r.token_id AND b.ts <= r.ts),
an AS (SELECT *, greatest(0, least(1, ramp * (0.7 * (0.35 * size_tail_score + 0.3 * (0.6 * coalesce(book_imbalance_score, 0) + 0.4 * coalesce(thin_opposite_score, 0)) + 0.2 * wallet_new_score) + 0.3 * greatest(0, burst_score)))) AS anomaly,
 coalesce(size_tail_score >= 0.9 AND book_imbalance_score >= 0.7 AND thin_opposite_score >= 0.7 AND (wallet_new_score >= 0.8 OR wallet_activity_score >= 0.7), false) AS triple,
 least(coalesce(bid_depth, 0), coalesce(ask_depth, 0)) AS depth, coalesce(spread_bps, 10000) AS sp, abs(coalesce(imbalance, 0)) AS ia FROM v),
ex AS (SELECT *, least(1, depth / 200) AS liquidity, greatest(0, least(1, (sp - 50) / 450)) AS spread_penalty,
 greatest(0, least(1, 0.4 * least(1, depth / 200) + 0.25 * (1 - greatest(0, least(1, (sp - 50) / 450))) + 0.25 * (1 - (0.6 * least(1, sp / 500) + 0.4 * ia)) + 0.1 * least(1, 1 / ramp))) AS execution,
 CASE WHEN depth <= 0 THEN 1000 ELSE least(0.1, 0.001 + 0.02 * 100 / depth) * 10000 END AS slippage_bps,
 (CASE WHEN is_large THEN CASE WHEN coalesce(imbalance, 0) > 0 THEN 1 ELSE -1 END * least(0.15, anomaly * 0.1) ELSE 0 END + CASE WHEN ia > 0.3 THEN CASE WHEN coalesce(imbalance, 0) > 0 THEN 1 ELSE -1 END * ia * 0.05 ELSE 0 END)
  * CASE WHEN coalesce(wallet_age_days < 7, false) AND is_large THEN 1.2 ELSE 1 END AS shift,
 CAST(is_large AS INT) + CAST(ia > 0.3 AS INT) + CAST(burst AS INT) + CAST(coalesce(wallet_age_days < 7, false) AS INT) AS aligned FROM an),
ed AS (SELECT *, greatest(0.01, least(0.99, coalesce(mid, 0.5) + shift)) - coalesce(mid, 0.5) AS edge, least(0.9, 0.2 + aligned * 0.14) AS edge_confidence FROM ex),
es AS (SELECT *, greatest(0, least(1, abs(edge) * 5 * edge_confidence * execution)) AS edge_score FROM ed),
scored AS (SELECT *, least(1, (0.35 * anomaly + 0.25 * execution + 0.4 * edge_score) * ramp) AS composite, liquidity * (1 - 0.3 * spread_penalty) AS fill_probability FROM es)
"""
)
STRENGTH = "CASE WHEN composite >= 0.85 THEN 'extreme' WHEN composite >= 0.75 THEN 'strong' WHEN composite >= 0.55 THEN 'moderate' WHEN composite >= 0.35 THEN 'weak' ELSE 'none' END"
SCORES = ("size_tail_score", "anomaly", "execution", "slippage_bps", "fill_probability", "edge", "edge_confidence", "edge_score", "composite")


def scored(spark, d):
    books = X.book_metrics(V.book_levels(spark, d))
    return S.with_scores(X.feature_vectors(V.trades(spark, d), books, V.wallets(spark, d), V.markets(spark, d)))


@query("f15_f19_scores", FULL + f"SELECT trade_id, triple, CAST(aligned AS BIGINT) AS aligned, {STRENGTH} AS strength, {r6({c: c for c in SCORES})} FROM scored")
def f15(spark, d):
    return scored(spark, d).select("trade_id", "triple", "aligned", "strength", *SCORES)


def portfolio_of(rows):
    """Proposals with a portfolio state derived from their ids, and sides from the book."""
    k = F.col("trade_id")
    return rows.withColumns(
        {
            "side": D.direction("imbalance", "thin_opposite_score"), "bankroll": F.lit(10_000.0), "position_usd": (k % 7) * 100.0, "exposure_usd": (k % 11) * 120.0, "daily_pnl": (k % 13) * -60.0,
            "drawdown": (k % 17) / 80.0, "losses_in_row": k % 7, "book_age_ms": (k % 19) * 1000.0, "top_depth": F.coalesce(F.least("bid_depth", "ask_depth"), F.lit(0.0)),
        }
    )


PROPOSED = (
    FULL
    + """, pr AS (SELECT *, CASE WHEN abs(imbalance) < 0.2 THEN NULL WHEN imbalance > 0 THEN 'YES' WHEN imbalance < 0 THEN 'NO' END AS dir, 10000.0 AS bank, (trade_id % 7) * 100.0 AS pos, (trade_id % 11) * 120.0 AS expo, (trade_id % 13) * -60.0 AS pnl,
 (trade_id % 17) / 80.0 AS dd, trade_id % 7 AS losses, (trade_id % 19) * 1000.0 AS age, coalesce(least(bid_depth, ask_depth), 0) AS top FROM scored),
k1 AS (SELECT *, edge_score * 0.1 / greatest(mid * (1 - mid), 0.25) AS raw, 0.05 - pos / bank AS room FROM pr),
k2 AS (SELECT *, least(raw * 0.25, 0.02) AS bet FROM k1),
k3 AS (SELECT *, CASE WHEN bet > room THEN greatest(0, room) ELSE bet END AS kelly FROM k2),
k4 AS (SELECT *, CASE WHEN kelly * bank > 0 AND kelly * bank < 5 THEN 0 ELSE kelly * bank END AS stake_usd,
 CASE WHEN kelly * bank > 0 AND kelly * bank < 5 THEN 'below_min_bet_size' WHEN bet > room THEN 'max_position_fraction' WHEN raw * 0.25 > 0.02 THEN 'max_bet_fraction' END AS capped_by FROM k3),
k5 AS (SELECT *, least(stake_usd, 200) AS single FROM k4),
k6 AS (SELECT *, CASE WHEN pos + single > 500 THEN greatest(0, 500 - pos) ELSE single END AS posn FROM k5),
k7 AS (SELECT *, CASE WHEN expo + posn > 1000 THEN least(posn, greatest(0, 1000 - expo)) ELSE posn END AS risk_usd,
 concat_ws(',', CASE WHEN -pnl / bank > 0.05 THEN 'daily_loss' END, CASE WHEN dd > 0.15 THEN 'drawdown' END, CASE WHEN losses >= 5 THEN 'consecutive_losses' END, CASE WHEN s <= 120 THEN 'no_trade_zone' END, CASE WHEN age > 10000 THEN 'stale_book' END,
  CASE WHEN spread_bps > 500 THEN 'spread_too_wide' END, CASE WHEN top < 100 THEN 'insufficient_depth' END, CASE WHEN pos + single > 500 AND 500 - pos <= 0 THEN 'position_limit' END, CASE WHEN expo + posn > 1000 AND 1000 - expo <= 0 THEN 'exposure_limit' END) AS risk_reasons,
 concat_ws(',', CASE WHEN -pnl / bank > 0.04 AND -pnl / bank <= 0.05 THEN 'near_daily_loss' END, CASE WHEN dd > 0.15 * 0.8 AND dd <= 0.15 THEN 'near_drawdown' END, CASE WHEN losses = 4 THEN 'near_losses' END, CASE WHEN stake_usd > 200 THEN 'capped_single_bet' END,
  CASE WHEN pos + single > 500 AND 500 - pos > 0 THEN 'capped_position' END) AS risk_warnings FROM k6)
"""
)


@query(
    "f22_kelly_size",
    PROPOSED + f"SELECT trade_id, capped_by, {r6({'kelly': 'kelly', 'stake_usd': 'stake_usd', 'stake_shares': 'CASE WHEN stake_usd > 0 THEN stake_usd / CASE WHEN dir = ' + chr(39) + 'NO' + chr(39) + ' THEN 1 - mid ELSE mid END ELSE 0 END'})} FROM k4 WHERE mid IS NOT NULL",
)
def f22(spark, d):
    return D.with_stake(portfolio_of(scored(spark, d).where("mid is not null"))).select("trade_id", "capped_by", "kelly", "stake_usd", "stake_shares")


def guarded(spark, d):
    return D.with_risk(D.with_stake(portfolio_of(scored(spark, d).where("mid is not null"))))


@query("f23_risk_guards", PROPOSED + f"SELECT trade_id, risk_reasons, risk_warnings, risk_reasons = '' AND risk_usd > 0 AS risk_ok, {r6({'risk_usd': 'risk_usd'})} FROM k7 WHERE mid IS NOT NULL")
def f23(spark, d):
    return guarded(spark, d).select("trade_id", "risk_reasons", "risk_warnings", "risk_ok", "risk_usd")


@query(
    "f24_circuit_breakers",
    PROPOSED + "SELECT trade_id, pnl < -bank * 0.05 AS breaks_daily_loss, dd > 0.15 AS breaks_drawdown, losses >= 5 AS breaks_losses FROM pr WHERE mid IS NOT NULL",
)
def f24(spark, d):
    return D.circuit_breakers(portfolio_of(scored(spark, d).where("mid is not null"))).select("trade_id", "breaks_daily_loss", "breaks_drawdown", "breaks_losses")


@query(
    "f20_f21_decisions",
    PROPOSED
    + f"""SELECT trade_id, dir AS direction, CASE WHEN age > 15000 THEN 'STALE_DATA' WHEN anomaly < 0.65 THEN 'BELOW_ANOMALY_THRESHOLD' WHEN execution < 0.55 THEN 'BELOW_EXECUTION_THRESHOLD' WHEN edge_score < 0.05 THEN 'BELOW_EDGE_THRESHOLD'
 WHEN dir IS NULL THEN 'RISK_CHECK_FAILED' WHEN stake_usd <= 0 THEN 'INSUFFICIENT_LIQUIDITY' WHEN NOT (risk_reasons = '' AND risk_usd > 0) THEN 'RISK_CHECK_FAILED' ELSE 'APPROVED' END AS decision,
 {r6({"limit_price": "CASE WHEN dir = 'YES' THEN least(best_ask + spread_bps / 10000 * 0.5, 0.99) WHEN dir = 'NO' THEN greatest(best_bid - spread_bps / 10000 * 0.5, 0.01) END"})} FROM k7 WHERE mid IS NOT NULL""",
)
def f20(spark, d):
    rows = guarded(spark, d)
    gate = D.decision(F.col("book_age_ms") <= 15_000, "anomaly", "execution", "edge_score", "side", "stake_usd", "risk_ok")
    return rows.select("trade_id", F.col("side").alias("direction"), gate.alias("decision"), D.limit_price("side", "best_bid", "best_ask", "spread_bps").alias("limit_price"))


@query("a38_approval_rate", PROPOSED + f"SELECT dir AS direction, count(*) AS decisions, count(*) FILTER (risk_reasons = '' AND risk_usd > 0) AS passed, {r6({'rate': '(count(*) FILTER (risk_reasons = ' + chr(39) * 2 + ' AND risk_usd > 0)) / count(*)'})} FROM k7 WHERE mid IS NOT NULL GROUP BY 1")
def a38(spark, d):
    rows = guarded(spark, d).groupBy(F.col("side").alias("direction")).agg(F.count(F.lit(1)).alias("decisions"), F.count_if("risk_ok").alias("passed"))
    return rows.withColumn("rate", F.col("passed") / F.col("decisions"))


@query(
    "w20_highest_trade",
    T + f"SELECT trade_id, CASE WHEN m IS NOT NULL THEN m.i ELSE -1 END AS top_trade_id, {r6({'top_notional': 'm.v'})} FROM (SELECT trade_id, max(CASE WHEN notional >= 500 THEN struct_pack(v := notional, i := trade_id) END) OVER {HOUR} AS m FROM trades)",
)
def w20(spark, d):
    return X.highest_trade(V.trades(spark, d)).na.fill(-1, ["top_trade_id"]).select("trade_id", "top_trade_id", "top_notional")


@query(
    "w21_triggering_trades",
    T
    + f"""SELECT trade_id, array_to_string(list_transform(list_reverse_sort(list_filter(l, lambda x: x.v >= 5000 AND x.v >= q))[1:3], lambda x: x.i), ',') AS trigger_ids
FROM (SELECT trade_id, list(struct_pack(v := notional, i := trade_id)) OVER {HOUR} AS l, quantile_cont(notional, 0.95) OVER {HOUR} AS q FROM trades)""",
)
def w21(spark, d):
    return X.triggering_trades(V.trades(spark, d)).select("trade_id", F.array_join(F.col("trigger_ids").cast("array<string>"), ",").alias("trigger_ids"))


@query(
    "w22_ema",
    T.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", o AS (SELECT condition_id, price, row_number() OVER (PARTITION BY condition_id ORDER BY trade_id) AS k FROM trades),
e AS (SELECT condition_id, k, price AS v FROM o WHERE k = 1 UNION ALL SELECT e.condition_id, o.k, e.v + 0.2 * (o.price - e.v) FROM e JOIN o ON o.condition_id = e.condition_id AND o.k = e.k + 1)
SELECT condition_id, count(*) AS n, {r6({"ema": "max_by(v, k)"})} FROM e GROUP BY 1""",
)
def w22(spark, d):
    return X.ema(V.trades(spark, d), "condition_id", "trade_id", "price")


BARS = """SELECT token_id, CAST(epoch_us(ts) // {us} AS BIGINT) AS bucket, count(*) AS trades, CAST(count_if(side = 'BUY') AS BIGINT) AS buys, {rounded}, count(DISTINCT wallet) AS wallets FROM trades GROUP BY 1, 2"""
BAR = {
    "buy_volume": "coalesce(sum(notional) FILTER (side = 'BUY'), 0)", "sell_volume": "coalesce(sum(notional) FILTER (side <> 'BUY'), 0)", "vwap": "sum(price * size) / sum(size)", "open": "arg_min(price, (ts, trade_id))", "high": "max(price)",
    "low": "min(price)", "close": "arg_max(price, (ts, trade_id))", "median_size": "median(notional)", "q95_size": "quantile_cont(notional, 0.95)",
    "q99_size": "quantile_cont(notional, 0.99)", "mad_size": "mad(notional)", "trades_per_minute": "count(*) / 60.0", "mean_gap_us": "(epoch_us(max(ts)) - epoch_us(min(ts))) / nullif(count(*) - 1, 0)",
    "imbalance": "(coalesce(sum(notional) FILTER (side = 'BUY'), 0) - coalesce(sum(notional) FILTER (side <> 'BUY'), 0)) / nullif(sum(notional), 0)",
}


@query("a1_a33_a34_trade_bars", T + BARS.format(us=3_600_000_000, rounded=r6(BAR)))
def a1(spark, d):
    return X.bars(V.trades(spark, d), 60)


@query(
    "a31_rolling_stats",
    T
    + f""", m AS (SELECT category, median(notional) AS med FROM trades GROUP BY 1)
SELECT category, count(notional) AS n, {r6({"sum": "sum(notional)", "mean": "avg(notional)", "median": "median(notional)", "min": "min(notional)", "max": "max(notional)", "variance": "var_samp(notional)", "std": "stddev_samp(notional)", "q25": "quantile_cont(notional, 0.25)", "q75": "quantile_cont(notional, 0.75)", "mad": "median(abs(notional - med))"})} FROM trades JOIN m USING (category) GROUP BY 1""",
)
def a31(spark, d):
    return ST.rolling_stats(V.trades(spark, d), "notional", ("category",))


# sketches of groups as small as the tokens' are exact: the smallest value that so many are at or below
SKETCHED = "SELECT token_id, notional, trade_id, list_sort(list(notional) OVER (PARTITION BY token_id)) AS l FROM trades"


@query("a32_quantile_sketch", T + f"SELECT token_id, len(any_value(l)) AS n, {r6({f'q{str(q)[2:]}': f'any_value(l)[CAST(ceil({q} * len(any_value(l))) AS INT)]' for q in (0.5, 0.95, 0.99, 0.999)})} FROM ({SKETCHED}) GROUP BY 1")
def a32(spark, d):
    return ST.sketch_quantiles(ST.quantile_sketch(V.trades(spark, d), "notional", ("token_id",))).drop("sketch")


@query("a32_percentile_rank", T + f"SELECT trade_id, {r6({'percentile_rank': 'floor(256 * len(list_filter(l, lambda x: x <= notional)) / len(l)) / 256 * 100'})} FROM ({SKETCHED})")
def a32_rank(spark, d):
    trades = V.trades(spark, d)
    return ST.percentile_rank(trades, ST.quantile_sketch(trades, "notional", ("token_id",)), "notional", ("token_id",)).select("trade_id", "percentile_rank")


@query("a19_logistic_report")
def a19(spark, d):
    from ..operators.models import logistic_report
    from .research import contrarian

    return logistic_report(contrarian(spark, d))


@query(
    "f1_f2_f30_functions",
    T
    + f"""SELECT trade_id, {r6({"clamped": "greatest(0.2, least(0.8, price))", "sigmoid": "1 / (1 + exp(-price))", "mapped": "0 + 10 * (price - 0) / 1", "rounded": "floor((price - 0.5) * 10 + 0.5) / 10", "change_pct": "(price - 0.5) / 0.5 * 100", "activity": "greatest(0, 1 - notional / 10000 / 100) * 0.4 + greatest(0, 1 - price) * 0.3 + greatest(0, 1 - notional / 10000) * 0.3", "impact_bps": "floor(10 + 5 * ln(1 + notional / 1000) + 0.5)"})},
 CASE WHEN notional < 5000 THEN 'small' ELSE 'large' END || '-' || side AS label FROM trades""",
)
def f1(spark, d):
    c = F.col
    return V.trades(spark, d).select(
        "trade_id", N.clamp("price", 0.2, 0.8).alias("clamped"), N.sigmoid("price").alias("sigmoid"), N.map_range("price", 0.0, 1.0, 0.0, 10.0).alias("mapped"), N.round_half_up(c("price") - 0.5, 1).alias("rounded"),
        N.change("price", 0.5).alias("change_pct"), S.activity_score(c("notional") / 10_000, c("price") * 20, "notional").alias("activity"), D.market_impact_bps("notional").alias("impact_bps"),
        D.strategy_id(F.when(c("notional") < 5000, "small").otherwise("large"), "side").alias("label"),
    )


@query(
    "a8_distribution_functions",
    T
    + f"""SELECT trade_id, {r6({"normal": "0.5 * (1 + sign(z) * (1 - ((((1.061405429 * t + -1.453152027) * t + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t * exp(-z * z)))"})}
FROM (SELECT trade_id, (price - 0.5) * 6 / sqrt(2.0) AS z, 1 / (1 + 0.3275911 * abs((price - 0.5) * 6 / sqrt(2.0))) AS t FROM trades)""",
)
def a8(spark, d):
    return V.trades(spark, d).select("trade_id", N.normal_cdf((F.col("price") - 0.5) * 6).alias("normal"))


@query("f28_strategy_hash", T + "SELECT DISTINCT category, side, substr(md5('{\"category\":\"' || category || '\",\"side\":\"' || side || '\"}'), 1, 12) AS hash FROM trades")
def f28(spark, d):
    return V.trades(spark, d).select("category", "side", D.config_hash("category", "side").alias("hash")).distinct()
