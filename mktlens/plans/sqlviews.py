"""The same derived tables as common table expressions for the checking SQL."""

TRADES = """
trades AS (
  SELECT event_id AS trade_id, ts, condition_id, outcome, side, price, notional, wallet, category,
         condition_id || CASE WHEN outcome = 'Yes' THEN '-Y' ELSE '-N' END AS token_id, notional / price AS size
  FROM (
    SELECT event_id, ts, event_type || '-' || strftime(ts, '%Y%m%d') AS condition_id,
           CASE WHEN user_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS outcome,
           CASE WHEN event_id % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side,
           (CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5) / 100 AS price,
           value * 100 AS notional, 'w' || user_id AS wallet, event_type AS category
    FROM events)
)"""

MARKETS = """
markets AS (
  SELECT event_type || '-' || strftime(day, '%Y%m%d') AS condition_id,
         CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AS end_date,
         CASE WHEN dayofmonth(day) % 7 = 0 THEN NULL WHEN (dayofmonth(day) + length(event_type)) % 2 = 0 THEN 'Yes' ELSE 'No' END AS winning_outcome,
         event_type AS category, 'Will ' || event_type || ' lead on ' || strftime(day, '%Y%m%d') AS question
  FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events)
)"""

WALLETS = """
wallets AS (
  SELECT 'w' || e.user_id AS wallet, first_seen_at, coalesce(n, 0) AS transaction_count
  FROM (SELECT user_id, min(ts) AS first_seen_at FROM events GROUP BY user_id) e
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = e.user_id
)"""

LEVELS = """
levels AS (
  SELECT snapshot_id, ts, category, is_bid, price, size, category || '-' || strftime(ts, '%Y%m%d') AS condition_id,
         category || '-' || strftime(ts, '%Y%m%d') || CASE WHEN snapshot_id % 2 = 0 THEN '-Y' ELSE '-N' END AS token_id
  FROM (
    SELECT o_orderkey AS snapshot_id, TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 7919) % 2592000) AS ts,
           ['click', 'error', 'purchase', 'signup', 'view'][CAST(o_orderkey % 5 + 1 AS INT)] AS category,
           is_bid, CASE WHEN is_bid THEN 0.5 - 0.01 * n ELSE 0.5 + 0.01 * n END AS price, size
    FROM orders JOIN (SELECT l_orderkey, l_linestatus = 'O' AS is_bid, CAST(l_linenumber AS DOUBLE) AS n, sum(l_quantity) * 100 AS size
                      FROM lineitem GROUP BY 1, 2, 3) ON l_orderkey = o_orderkey)
)"""

BOOKS = """
books AS (
  SELECT *, best_ask - best_bid AS spread, (best_bid + best_ask) / 2 AS mid
  FROM (SELECT snapshot_id, ts, token_id, condition_id, category,
               max(CASE WHEN is_bid THEN price END) AS best_bid, min(CASE WHEN NOT is_bid THEN price END) AS best_ask
        FROM levels GROUP BY ALL)
)"""

EVENTS = """
ranked AS (
  SELECT t.*, epoch_us(ts) AS us,
         (rank() OVER (PARTITION BY condition_id ORDER BY notional) - 1) * 100.0 / count(*) OVER (PARTITION BY condition_id) AS size_percentile,
         median(notional) OVER (PARTITION BY condition_id) AS med
  FROM trades t
),
framed AS (
  SELECT r.*, median(abs(notional - med)) OVER (PARTITION BY condition_id) AS mad,
         avg(price) OVER back AS prior_price,
         sum(CASE WHEN side = 'BUY' THEN notional ELSE -notional END) OVER flow AS flow_30m,
         last(price) OVER ahead30 AS price_30m, last(price) OVER ahead60 AS price_60m
  FROM ranked r
  WINDOW back AS (PARTITION BY condition_id, token_id ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND 1 PRECEDING),
         flow AS (PARTITION BY condition_id ORDER BY us RANGE BETWEEN 1799999999 PRECEDING AND 1 PRECEDING),
         ahead30 AS (PARTITION BY condition_id, token_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND 1800000000 FOLLOWING),
         ahead60 AS (PARTITION BY condition_id, token_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND 3600000000 FOLLOWING)
),
contrarian AS (
  SELECT f.trade_id, f.condition_id, f.token_id, f.outcome, f.wallet, f.ts, m.category, m.question, m.end_date, f.price, f.size, f.notional, size_percentile,
         CASE WHEN mad = 0 THEN 0.0 ELSE (notional - med) / (1.4826 * mad) END AS size_zscore,
         size_percentile >= 95 AS is_tail,
         (epoch_us(m.end_date) - us) / 60000000.0 AS minutes_before_close,
         f.price < 0.5 AS is_price_contrarian, f.price - coalesce(prior_price, f.price) AS price_trend_30m, coalesce(flow_30m, 0) AS ofi_30m,
         f.price - coalesce(prior_price, f.price) < -0.01 AS is_against_trend, coalesce(flow_30m, 0) < 0 AS is_against_ofi,
         f.price - coalesce(prior_price, f.price) < -0.01 AND coalesce(flow_30m, 0) < 0 AS is_contrarian,
         (price_30m - f.price) / f.price AS drift_30m, (price_60m - f.price) / f.price AS drift_60m,
         f.outcome = m.winning_outcome AS outcome_won, m.winning_outcome,
         epoch_us(f.ts) - epoch_us(w.first_seen_at) AS wallet_age_us, w.transaction_count
  FROM framed f JOIN markets m USING (condition_id) LEFT JOIN wallets w USING (wallet)
  WHERE side = 'BUY' AND notional >= 100 AND (epoch_us(m.end_date) - us) / 60000000.0 BETWEEN 0 AND 1440
  QUALIFY row_number() OVER (PARTITION BY f.condition_id, f.token_id, f.ts ORDER BY f.trade_id DESC) = 1
)"""


# follows a WITH clause that has levels
BOOK = """, b AS (SELECT l.*, max(CASE WHEN is_bid THEN price END) OVER s AS best_bid, min(CASE WHEN NOT is_bid THEN price END) OVER s AS best_ask,
  row_number() OVER (PARTITION BY snapshot_id, is_bid ORDER BY CASE WHEN is_bid THEN -price ELSE price END) AS place FROM levels l WINDOW s AS (PARTITION BY snapshot_id)),
g AS (SELECT snapshot_id, ts, token_id, condition_id, category, best_bid, best_ask, (best_bid + best_ask) / 2 AS mid,
 coalesce(sum(size) FILTER (is_bid AND abs(price - (best_bid + best_ask) / 2) <= (best_bid + best_ask) / 2 * 0.05 + 1e-9), 0) AS bid_5, coalesce(sum(size) FILTER (NOT is_bid AND abs(price - (best_bid + best_ask) / 2) <= (best_bid + best_ask) / 2 * 0.05 + 1e-9), 0) AS ask_5,
 coalesce(sum(size) FILTER (is_bid AND abs(price - (best_bid + best_ask) / 2) <= (best_bid + best_ask) / 2 * 0.1 + 1e-9), 0) AS bid_10, coalesce(sum(size) FILTER (NOT is_bid AND abs(price - (best_bid + best_ask) / 2) <= (best_bid + best_ask) / 2 * 0.1 + 1e-9), 0) AS ask_10,
 coalesce(sum(size) FILTER (is_bid AND place <= 5), 0) AS bid_top5, coalesce(sum(size) FILTER (NOT is_bid AND place <= 5), 0) AS ask_top5 FROM b GROUP BY ALL),
m AS (SELECT *, (best_ask - best_bid) / mid * 10000 AS spread_bps, bid_5 + bid_10 AS bid_depth, ask_5 + ask_10 AS ask_depth, coalesce((bid_10 - ask_10) / nullif(bid_10 + ask_10, 0), 0) AS imbalance,
 coalesce((bid_top5 - ask_top5) / nullif(bid_top5 + ask_top5, 0), 0) AS imbalance_top5, coalesce(least(bid_5 + bid_10, ask_5 + ask_10) / nullif(greatest(bid_5 + bid_10, ask_5 + ask_10), 0), 1) AS thin_ratio FROM g),
books AS (SELECT *, least(1, abs(imbalance) / 0.7) AS book_imbalance_score, greatest(0, 1 - thin_ratio) AS thin_opposite_score, greatest(0, 1 - spread_bps / 500) AS spread_score, least(1, (bid_depth + ask_depth) / 100) AS depth_score,
 abs(imbalance) > 0.5 AND thin_ratio < 0.3 AS is_asymmetric, bid_10 >= 100 AND ask_10 >= 100 AS depth_adequate, CASE WHEN abs(imbalance) <= 0.3 THEN 'balanced' WHEN imbalance > 0 THEN 'ask' ELSE 'bid' END AS thin_side FROM m)
"""


def views(*names: str) -> str:
    """WITH clause of these views, those that they need first."""
    needs = {"events": ("trades", "markets", "wallets"), "books": ("levels",)}
    texts = {"trades": TRADES, "markets": MARKETS, "wallets": WALLETS, "levels": LEVELS, "books": BOOKS, "events": EVENTS}
    order: list[str] = []
    for name in names:
        for view in (*needs.get(name, ()), name):
            if view not in order:
                order.append(view)
    return "WITH " + ",".join(texts[v] for v in order) + "\n"
