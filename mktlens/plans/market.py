"""Queries of sources, filters, rankings, portfolios and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as L
from ..operators import portfolio as P
from ..operators import ranking as R
from ..params import MarketFilter
from ..sources import folders
from ..sources import normalize as N
from ..sources import views as V
from .live import FULL, STRENGTH, scored
from .registry import query
from .research import r6
from .sqlviews import views

T, M, TM = views("trades"), views("markets"), views("trades", "markets")


def wire_markets(spark, d):
    """Markets as the wire has them: JSON in strings, tags, event names."""
    m = V.markets(spark, d)
    names, yes = F.lit('["Yes","No"]'), F.col("winning_outcome") == "Yes"
    ids = F.concat(F.lit('["'), "condition_id", F.lit('-Y","'), "condition_id", F.lit('-N"]'))
    prices = F.when(F.col("winning_outcome").isNull(), '["0.6","0.4"]').when(yes, '["1","0"]').otherwise('["0","1"]')
    return m.select(
        "condition_id", "question", names.alias("outcomes"), ids.alias("clob_token_ids"), prices.alias("outcome_prices"), "end_date", F.col("end_date").alias("end_date_iso"), F.col("winning_outcome").isNull().alias("active"),
        F.col("winning_outcome").isNotNull().alias("closed"), F.array(F.initcap("category"), F.lit("Election")).alias("tags"), F.when(F.col("category") != "view", F.col("category")).alias("event_title"), F.concat(F.col("category"), F.lit("-day")).alias("event_slug"),
        (F.dayofmonth("end_date") * 100.0).alias("volume"), (F.dayofmonth("end_date") * 40.0).alias("liquidity"),
    )


@query(
    "s1_normalize_markets",
    M
    + """SELECT condition_id, 2 AS n_outcomes, condition_id || '-Y' AS first_token, CASE WHEN category <> 'view' THEN category ELSE 'View' END AS category,
 concat_ws('|', upper(substr(category, 1, 1)) || substr(category, 2), 'Election', CASE WHEN category <> 'view' THEN category END, category || ' day') AS tags, winning_outcome IS NOT NULL AS resolved FROM markets""",
)
def s1(spark, d):
    out = N.normalize_markets(wire_markets(spark, d))
    return out.select("condition_id", F.size("outcomes").alias("n_outcomes"), F.col("outcomes")[0]["token_id"].alias("first_token"), "category", F.array_join("tags", "|").alias("tags"), "resolved")


@query(
    "s2_normalize_orderbook",
    views("levels")
    + f"""SELECT token_id, CAST(count_if(is_bid) AS BIGINT) AS n_bids, CAST(count_if(NOT is_bid) AS BIGINT) AS n_asks, {r6({"best_bid": "max(price) FILTER (is_bid)", "best_ask": "min(price) FILTER (NOT is_bid)", "spread_bps": "(min(price) FILTER (NOT is_bid) - max(price) FILTER (is_bid)) / ((min(price) FILTER (NOT is_bid) + max(price) FILTER (is_bid)) / 2) * 10000"})}
FROM levels GROUP BY snapshot_id, token_id""",
)
def s2(spark, d):
    wire = lambda c: F.transform(c, lambda v: F.struct(v["price"].cast("string").alias("price"), v["size"].cast("string").alias("size")))
    raw = V.books(spark, d).select("token_id", "ts", wire("bids").alias("bids"), wire("asks").alias("asks"))
    return N.normalize_orderbook(raw).select("token_id", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), "best_bid", "best_ask", "spread_bps")


@query("s3_normalize_trades_clob", T + f"SELECT trade_id, lower('W-' || wallet) AS taker, side, {r6({'price': 'price', 'size': 'size'})} FROM trades")
def s3(spark, d):
    raw = V.trades(spark, d).select("trade_id", "token_id", "ts", F.lit("0xA").alias("maker"), F.concat(F.lit("W-"), "wallet").alias("taker"), F.lower("side").alias("side"), "price", "size")
    return N.normalize_trades_clob(raw).select("trade_id", "taker", "side", "price", "size")


HASH = "CASE WHEN trade_id % 2 = 0 THEN '0x' || sha256(CAST(trade_id AS VARCHAR)) ELSE 'bad' END"


@query(
    "s4_normalize_trades_public",
    T
    + f"SELECT CASE WHEN trade_id % 2 = 0 THEN {HASH} ELSE condition_id || '-' || (epoch_us(ts) // 1000000) || '-' || upper(wallet) END AS trade_id, CASE WHEN trade_id % 2 = 0 THEN {HASH} END AS tx_hash, to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC' AS ts, wallet AS taker, side FROM trades",
)
def s4(spark, d):
    tx = F.when(F.col("trade_id") % 2 == 0, F.concat(F.lit("0x"), F.sha2(F.col("trade_id").cast("string"), 256))).otherwise("bad")
    raw = V.trades(spark, d).select("condition_id", F.floor(F.unix_micros("ts") / 1_000_000).alias("timestamp"), F.upper("wallet").alias("proxy_wallet"), tx.alias("transaction_hash"), F.lower("side").alias("side"), "price", "size")
    return N.normalize_trades_public(raw).select("trade_id", "tx_hash", "ts", "taker", "side")


@query("s6_incremental_trades", T + "SELECT trade_id, token_id FROM trades WHERE ts > TIMESTAMP '2024-01-15' AND trade_id % 10 <> 0")
def s6(spark, d):
    t = V.trades(spark, d)
    return N.incremental(t.unionByName(t.where("trade_id % 5 = 1")), t.where("trade_id % 10 = 0"), "2024-01-15").select("trade_id", "token_id")


@query("s7_u2_enrich_wallets", views("trades", "wallets") + "SELECT DISTINCT t.wallet, w.first_seen_at, coalesce(CASE WHEN w.transaction_count > 5 THEN w.transaction_count END, 0) AS transaction_count FROM trades t LEFT JOIN wallets w USING (wallet)")
def s7(spark, d):
    known = V.wallets(spark, d).withColumn("transaction_count", F.when(F.col("transaction_count") > 5, F.col("transaction_count")))
    return N.enrich_wallets(V.trades(spark, d).select(F.upper("wallet").alias("wallet")), known)


@query("s8_extract_join_date", "SELECT page_id, CAST(CAST(nullif(regexp_extract(html, '\\b(20\\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\\d|2[0-8]))\\b', 1), '') AS DATE) AS VARCHAR) AS joined, nullif(regexp_extract(html, '0x[0-9a-fA-F]{40}', 0), '') AS address FROM pages")
def s8(spark, d):
    return N.extract_join_date(V.table(spark, d, "pages").select("page_id", "html"))


@query("s9_resolved_markets", M + "SELECT condition_id, winning_outcome AS winner, condition_id || CASE WHEN winning_outcome = 'Yes' THEN '-Y' ELSE '-N' END AS winning_token FROM markets WHERE winning_outcome IS NOT NULL")
def s9(spark, d):
    return N.resolved_markets(wire_markets(spark, d)).select("condition_id", "winner", "winning_token")


@query("s10_historical_trades", TM + f"SELECT trade_id, t.condition_id, outcome, token_id, {r6({'notional': 'notional'})} FROM trades t JOIN markets m USING (condition_id) WHERE winning_outcome IS NOT NULL AND ts <= end_date AND ts >= end_date - INTERVAL 12 HOURS")
def s10(spark, d):
    raw = V.trades(spark, d).select("condition_id", "trade_id", "ts", F.when(F.col("outcome") == "Yes", 0).otherwise(1).alias("outcome_index"), "price", "size")
    return N.historical_trades(raw.unionByName(raw), N.resolved_markets(wire_markets(spark, d)), 12).select("trade_id", "condition_id", "outcome", "token_id", "notional")


@query("s11_upsert", M + "SELECT condition_id, CASE WHEN dayofmonth(end_date) > 15 THEN 'new' ELSE category END AS category, question FROM markets UNION ALL SELECT condition_id || '-x', 'new', NULL FROM markets WHERE dayofmonth(end_date) > 25")
def s11(spark, d):
    old = V.markets(spark, d).select("condition_id", "category", "question")
    late = V.markets(spark, d).where(F.dayofmonth("end_date") > 15).select("condition_id", "end_date")
    new = late.select("condition_id", F.lit("new").alias("category"), F.lit(None).cast("string").alias("question"))
    more = late.where(F.dayofmonth("end_date") > 25).select(F.concat("condition_id", F.lit("-x")).alias("condition_id"), F.lit("new").alias("category"), F.lit(None).cast("string").alias("question"))
    return N.upsert(old, new.unionByName(more), ["condition_id"], ["category"])


@query("s12_split_valid", T + "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM (SELECT CASE WHEN NOT (price <= 0.9) THEN 'price' WHEN NOT (notional > 10) THEN 'notional' END AS reason FROM trades) GROUP BY 1")
def s12(spark, d):
    good, bad = N.split_valid(V.trades(spark, d), {"price": F.col("price") <= 0.9, "notional": F.col("notional") > 10})
    return good.select(F.lit("valid").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("s14_load_results", T + f"SELECT category AS config_id, 'vs_ofi' AS mode, {r6({'min_notional': '500', 'roi': '0'})}, count(*) AS n FROM trades GROUP BY category")
def s14(spark, d):
    raw = V.trades(spark, d).groupBy(F.col("category").alias("config_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("config", F.lit('{"mode":"vs_ofi","min_notional":500}')).withColumn("roi", F.lit(None).cast("double"))
    return N.load_results(raw)


@query("s15_closing_within", M + "SELECT condition_id, end_date FROM markets WHERE end_date BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-22'")
def s15(spark, d):
    return N.closing_within(V.markets(spark, d), "2024-01-20", 48).select("condition_id", "end_date")


def term_sql(terms: tuple[str, ...]) -> str:
    return L.any_term(terms).replace("'", "''")


F_ = MarketFilter()
FILTERED = f""", f AS (SELECT condition_id, dayofmonth(end_date) AS dd, CASE WHEN dayofmonth(end_date) * 100 < 1000 THEN 'volume' WHEN dayofmonth(end_date) * 40 < 500 THEN 'liquidity' WHEN regexp_matches(q, '{term_sql(F_.blacklist)}') THEN 'blacklist'
 WHEN NOT regexp_matches(q, '{term_sql(F_.whitelist)}') AND NOT tagged THEN 'whitelist' END AS reason
 FROM (SELECT *, question || CASE WHEN dayofmonth(end_date) % 3 = 0 THEN ' in the NFL final' ELSE ' after the vote' END AS q, dayofmonth(end_date) % 5 = 0 AS tagged FROM markets))"""


def filtered(spark, d):
    rows = wire_markets(spark, d).withColumn("category", F.col("event_title")).withColumn("tags", F.when(F.dayofmonth("end_date") % 5 == 0, F.array(F.lit("US Elections"))).otherwise(F.array(F.lit("zzz"))))
    rows = rows.withColumn("question", F.concat("question", F.when(F.dayofmonth("end_date") % 3 == 0, " in the NFL final").otherwise(" after the vote")))
    return L.market_filter(rows)


@query("p1_market_filter", M + FILTERED + "SELECT condition_id, reason FROM f")
def p1(spark, d):
    return filtered(spark, d).select("condition_id", "reason")


@query("a39_filter_reasons", M + FILTERED + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM f GROUP BY 1")
def a39(spark, d):
    return filtered(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def tokens(spark, d):
    rows = N.normalize_markets(wire_markets(spark, d)).withColumn("reason", F.when(F.dayofmonth("end_date") % 4 == 0, "volume"))
    return L.tracked_tokens(rows)


@query("p2_tracked_tokens", M + "SELECT condition_id || s.t AS token_id FROM markets, (SELECT unnest(['-Y', '-N']) AS t) s WHERE winning_outcome IS NULL AND dayofmonth(end_date) % 4 <> 0")
def p2(spark, d):
    return tokens(spark, d).select("token_id")


@query("p3_expire_tokens", M + "SELECT condition_id || s.t AS token_id FROM markets, (SELECT unnest(['-Y', '-N']) AS t) s WHERE winning_outcome IS NULL AND dayofmonth(end_date) % 4 <> 0 AND end_date >= TIMESTAMP '2024-01-14 23:55:00'")
def p3(spark, d):
    return L.expire_tokens(tokens(spark, d), "2024-01-15").select("token_id")


@query("u1_new_tokens", TM + "SELECT DISTINCT token_id FROM trades EXCEPT SELECT condition_id || '-Y' FROM markets")
def u1(spark, d):
    tracked = V.markets(spark, d).select(F.concat("condition_id", F.lit("-Y")).alias("token_id"))
    return V.trades(spark, d).select("token_id").distinct().join(tracked, "token_id", "left_anti")


@query("u3_insert_if_absent", T + "SELECT count(*) AS n, count(DISTINCT trade_id) AS ids FROM trades")
def u3(spark, d):
    t = V.trades(spark, d)
    have = t.where("trade_id % 3 = 0")
    both = have.unionByName(t.join(have.select("trade_id"), "trade_id", "left_anti").select(have.columns))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trade_id").alias("ids"))


@query("p4_exclude_topics", M + "SELECT condition_id FROM markets WHERE NOT regexp_matches(question, '(?i)(error|signup)')")
def p4(spark, d):
    return L.exclude_topics(V.markets(spark, d), F_.excluded_topics).select("condition_id")


TOP = "side = 'BUY' AND notional >= 1000 AND price <= 0.95 AND (notional >= 50000 OR category NOT IN ('error', 'signup')) AND ts > TIMESTAMP '2024-01-29' AND ts <= TIMESTAMP '2024-01-30'"


def day(rows):
    return rows.where((F.col("ts") > F.lit("2024-01-29").cast("timestamp")) & (F.col("ts") <= F.lit("2024-01-30").cast("timestamp")))


@query("p5_j2_t1_top_trades", TM + f"SELECT trade_id, question, {r6({'notional': 'notional'})} FROM trades JOIN (SELECT condition_id, question FROM markets) USING (condition_id) WHERE {TOP} ORDER BY notional DESC, trade_id LIMIT 10")
def t1(spark, d):
    rows = day(V.trades(spark, d)).where(L.top_trade(F.col("category").isin("error", "signup"))).join(V.markets(spark, d).select("condition_id", "question"), "condition_id")
    return R.top(rows, 10, F.desc("notional"), F.asc("trade_id")).select("trade_id", "question", "notional")


@query("p6_near_certain", T + "SELECT trade_id FROM trades WHERE price IS NULL OR price BETWEEN 0.05 AND 0.95")
def p6(spark, d):
    return V.trades(spark, d).where(L.not_near_certain()).select("trade_id")


AGES = """, a AS (SELECT token_id, max(epoch_us(ts)) AS last FROM trades GROUP BY 1), g AS (SELECT token_id, (1706659200000000 - last) / 1000.0 / 86400 AS age FROM a)"""
STATUS = "CASE WHEN age < 5000 THEN 'fresh' WHEN age < 10000 THEN 'warning' WHEN age < 30000 THEN 'stale' ELSE 'critical' END"


def aged(spark, d):
    return V.trades(spark, d).groupBy("token_id", "condition_id", "category").agg(((F.lit(1706659200000000) - F.max(F.unix_micros("ts"))) / 1000.0 / 86400).alias("age"))


@query("p12_staleness", T + AGES + f"SELECT token_id, {STATUS} AS status, age < 5000 AS safe FROM g")
def p12(spark, d):
    return aged(spark, d).select("token_id", L.staleness(F.col("age"), "orderbook").alias("status"), (F.col("age") < L.STALENESS["orderbook"][0]).alias("safe"))


@query(
    "p13_combined_staleness",
    T + AGES + f""", s AS (SELECT substr(token_id, 1, position('-' IN token_id) - 1) AS category, token_id, {STATUS} AS status FROM g)
SELECT category, ['fresh', 'warning', 'stale', 'critical'][max(list_position(['fresh', 'warning', 'stale', 'critical'], status))] AS status, coalesce(string_agg(token_id, ',' ORDER BY token_id) FILTER (status <> 'fresh'), '') AS unsafe FROM s GROUP BY 1""",
)
def p13(spark, d):
    return L.combined_staleness(aged(spark, d).withColumn("status", L.staleness(F.col("age"), "orderbook")), "category", "token_id", "status")


@query("p14_j10_freshness_gate", TM + AGES + "SELECT token_id, concat_ws(',', CASE WHEN age > 10000 THEN 'orderbook' END, CASE WHEN age * 2 > 15000 THEN 'trades' END) AS stale FROM g WHERE age > 10000 OR age * 2 > 15000")
def p14(spark, d):
    rows = aged(spark, d).withColumn("book_age_ms", F.col("age")).withColumn("trade_age_ms", F.col("age") * 2).join(V.markets(spark, d).select("condition_id", "end_date"), "condition_id", "left")
    return L.freshness_gate(rows).where("stale != ''").select("token_id", "stale")


@query("p16_query_trades", T + f"SELECT trade_id, {r6({'size': 'size'})} FROM trades WHERE side = 'SELL' AND category = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY size DESC, trade_id LIMIT 20 OFFSET 10")
def p16(spark, d):
    return L.query_trades(V.trades(spark, d).where("category = 'click'"), side="SELL", start="2024-01-10", end="2024-01-20", order="size", offset=10, limit=20).select("trade_id", "size")


@query("p17_query_markets", M + "SELECT condition_id FROM markets WHERE lower(question) LIKE '%lead on 202401%' AND category = 'view' AND end_date >= TIMESTAMP '2024-01-05' AND winning_outcome IS NOT NULL ORDER BY end_date, condition_id LIMIT 10 OFFSET 3")
def p17(spark, d):
    return L.query_markets(V.markets(spark, d), text="LEAD on 202401", category="view", end_from="2024-01-05", resolved=True, offset=3, limit=10).select("condition_id")


@query("t2_recent_activity", views("trades", "wallets") + "SELECT trade_id, w.transaction_count, CASE WHEN side = 'BUY' THEN 'Bought ' ELSE 'Sold ' END || outcome AS shown FROM trades t JOIN wallets w USING (wallet) WHERE notional >= 1000 AND ts > TIMESTAMP '2024-01-29' AND ts <= TIMESTAMP '2024-01-30' ORDER BY ts DESC, trade_id LIMIT 50")
def t2(spark, d):
    rows = R.top(day(V.trades(spark, d)).where("notional >= 1000"), 50, F.desc("ts"), F.asc("trade_id")).join(V.wallets(spark, d), "wallet")
    return rows.select("trade_id", "transaction_count", F.concat(F.when(F.col("side") == "BUY", "Bought ").otherwise("Sold "), "outcome").alias("shown"))


LATEST = """, l AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, trade_id DESC) = 1)
"""


def latest_scores(spark, d):
    cols = ("trade_id", "token_id", "condition_id", "ts", "notional", "anomaly", "composite", "strength", "mid")
    return R.latest(scored(spark, d).select(*cols), "token_id", F.struct("ts", "trade_id"))


@query("w18_t3_t7_latest_scores", FULL + LATEST + f"SELECT token_id, trade_id, {STRENGTH} AS strength, anomaly >= 0.65 AS high, {r6({'composite': 'composite'})} FROM l ORDER BY round(composite, 9) DESC, token_id LIMIT 50")
def t3(spark, d):
    return R.top(latest_scores(spark, d), 50, F.desc(F.round("composite", 9)), F.asc("token_id")).select("token_id", "trade_id", "strength", (F.col("anomaly") >= 0.65).alias("high"), "composite")


@query(
    "j9_t4_w15_opportunities",
    FULL + LATEST + f"""SELECT condition_id, token_id, {r6({'composite': 'composite'})} FROM (SELECT l.condition_id, l.token_id, l.composite, m.end_date, l.notional FROM l JOIN markets m USING (condition_id) WHERE (l.mid IS NULL OR l.mid BETWEEN 0.05 AND 0.95)
QUALIFY row_number() OVER (PARTITION BY l.condition_id ORDER BY round(l.composite, 9) DESC, l.token_id) = 1) ORDER BY end_date, notional DESC, token_id LIMIT 40""",
)
def t4(spark, d):
    rows = latest_scores(spark, d).join(V.markets(spark, d).select("condition_id", "end_date"), "condition_id").where(L.not_near_certain("mid"))
    best = R.top_per_group(rows, "condition_id", 1, F.desc(F.round("composite", 9)), F.asc("token_id"))
    return R.top(best, 40, F.asc("end_date"), F.desc("notional"), F.asc("token_id")).select("condition_id", "token_id", "composite")


@query("t5_closing_soon", M + f"SELECT condition_id, {r6({'minutes_to_close': '(epoch_us(end_date) - 1706054400000000) / 60000000'})} FROM markets WHERE end_date BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31' ORDER BY end_date, condition_id LIMIT 30")
def t5(spark, d):
    return R.top(R.closing_soon(V.markets(spark, d), "2024-01-24"), 30, F.asc("minutes_to_close"), F.asc("condition_id")).select("condition_id", "minutes_to_close")


@query(
    "j8_t6_closing_with_activity",
    TM
    + """, s AS (SELECT condition_id, (epoch_us(end_date) - 1705838400000000) / 60000000 AS m FROM markets WHERE end_date BETWEEN TIMESTAMP '2024-01-21 12:00:00' AND TIMESTAMP '2024-01-28 12:00:00'),
tier AS (SELECT CASE WHEN count(*) FILTER (m <= 60) >= 7 THEN 60 WHEN count(*) FILTER (m <= 1440) >= 7 THEN 1440 ELSE 10080 END AS tier FROM s),
r AS (SELECT condition_id, trade_id, row_number() OVER (PARTITION BY condition_id ORDER BY ts DESC, trade_id) AS place FROM trades WHERE side = 'BUY' AND notional >= 100 AND ts <= TIMESTAMP '2024-01-21 12:00:00')
SELECT s.condition_id, CAST(tier AS BIGINT) AS tier, string_agg(CAST(trade_id AS VARCHAR), ',' ORDER BY place) AS trade_ids FROM s JOIN tier ON m <= tier LEFT JOIN r ON r.condition_id = s.condition_id AND place <= 5 GROUP BY 1, 2""",
)
def t6(spark, d):
    return R.closing_with_activity(V.markets(spark, d), V.trades(spark, d), "2024-01-21 12:00:00", k=7)


@query("t12_t13_open_positions", TM + f"SELECT trade_id, token_id, {r6({'notional': 'notional'})} FROM trades JOIN markets USING (condition_id) WHERE side = 'BUY' AND winning_outcome IS NULL ORDER BY ts DESC, trade_id LIMIT 25")
def t13(spark, d):
    return R.top(positions(spark, d).where("pnl is null"), 25, F.desc("ts"), F.asc("trade_id")).select("trade_id", "token_id", "notional")


def positions(spark, d):
    return P.positions_of(V.trades(spark, d), V.markets(spark, d))


POS = (
    TM
    + """, pos AS (SELECT trade_id, token_id, t.category, upper(outcome) AS side, price AS entry, size, notional, ts, end_date AS exit_ts,
 CASE WHEN winning_outcome IS NULL THEN NULL WHEN outcome = winning_outcome THEN (1 - price) * size ELSE -price * size END AS pnl FROM trades t JOIN markets m USING (condition_id) WHERE side = 'BUY')
"""
)


@query("j15_f27_position_pnl", POS + f"SELECT trade_id, side, {r6({'entry': 'entry', 'pnl': 'pnl'})} FROM pos")
def f27(spark, d):
    return positions(spark, d).select("trade_id", "side", "entry", "pnl")


@query("a35_position_totals", POS + f"SELECT coalesce(side, 'ALL') AS side, count(*) AS n, {r6({'notional': 'sum(notional)', 'pnl': 'round(sum(pnl), 2)'})} FROM pos GROUP BY ROLLUP (side)")
def a35(spark, d):
    return P.totals(positions(spark, d)).withColumn("pnl", F.round("pnl", 2))


@query(
    "a36_a2_pnl_summary",
    POS + f"SELECT count(*) AS n, CAST(count_if(pnl > 0) AS BIGINT) AS wins, CAST(count_if(pnl < 0) AS BIGINT) AS losses, {r6({'realized': 'sum(pnl)', 'avg_win': 'avg(pnl) FILTER (pnl > 0)', 'avg_loss': 'avg(pnl) FILTER (pnl < 0)', 'profit_factor': 'sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0)', 'win_rate': 'count_if(pnl > 0) / count(*)', 'sharpe': 'avg(pnl) / stddev_pop(pnl)'})} FROM pos WHERE pnl IS NOT NULL",
)
def a36(spark, d):
    return P.summary(positions(spark, d))


@query("a43_daily_pnl", POS + f"SELECT CAST(CAST(exit_ts AS DATE) AS VARCHAR) AS day, count(*) AS n, {r6({'pnl': 'sum(pnl)'})} FROM pos WHERE pnl IS NOT NULL GROUP BY 1")
def a43(spark, d):
    return P.daily_pnl(positions(spark, d))


LEDGER = ", led AS (SELECT token_id, coalesce(sum(size) FILTER (pnl IS NULL), 0) AS open_size, coalesce(sum(notional) FILTER (pnl IS NULL), 0) AS exposure, coalesce(sum(pnl), 0) AS closed_pnl, count(*) FILTER (pnl IS NULL) AS open_positions FROM pos GROUP BY 1)\n"


@query("a47_position_ledger", POS + LEDGER + f"SELECT token_id, open_positions, {r6({c: c for c in ('open_size', 'exposure', 'closed_pnl')})} FROM led")
def a47(spark, d):
    return P.ledger(positions(spark, d))


@query("a37_risk_breakdown", POS + LEDGER + f"SELECT token_id, {r6({'exposure': 'exposure', 'share_pct': 'exposure / 1000000 * 100', 'room': 'greatest(0, 100000 - (SELECT sum(exposure) FROM led))'})} FROM led WHERE exposure > 0")
def a37(spark, d):
    return P.risk_breakdown(P.ledger(positions(spark, d)))


@query("j16_decision_inputs", POS + LEDGER + f"SELECT trade_id, {r6({'position_usd': 'coalesce(exposure, 0)', 'bankroll': '10000 + coalesce(closed_pnl, 0)'})} FROM trades LEFT JOIN led USING (token_id)")
def j16(spark, d):
    return P.decision_inputs(V.trades(spark, d), P.ledger(positions(spark, d))).select("trade_id", "position_usd", "bankroll")


@query(
    "w16_w17_running_bankroll",
    POS
    + f""", b AS (SELECT *, 10000 + sum(pnl) OVER w AS bankroll FROM pos WHERE pnl IS NOT NULL WINDOW w AS (PARTITION BY category ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, greatest(10000, max(bankroll) OVER w) AS peak, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER w AS g FROM b WINDOW w AS (PARTITION BY category ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING))
SELECT trade_id, {r6({"bankroll": "round(bankroll, 2)", "drawdown": "(peak - bankroll) / peak", "max_drawdown": "max((peak - bankroll) / peak) OVER (PARTITION BY category ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING)"})},
 CAST(sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY category, g ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS losses_in_row FROM k""",
)
def w17(spark, d):
    return P.running(positions(spark, d), "category").select("trade_id", F.round("bankroll", 2).alias("bankroll"), "drawdown", "max_drawdown", "losses_in_row")


@query(
    "a42_exposure_series",
    POS
    + f""", u AS (SELECT category, CAST(ts AS DATE) AS day, notional AS e, 0 AS p FROM pos UNION ALL SELECT category, CAST(exit_ts AS DATE), -notional, pnl FROM pos WHERE pnl IS NOT NULL),
s AS (SELECT category, day, sum(e) AS e, sum(p) AS p FROM u GROUP BY 1, 2)
SELECT category, CAST(day AS VARCHAR) AS day, {r6({"exposure": "sum(e) OVER w", "bankroll": "round(10000 + sum(p) OVER w, 2)"})} FROM s WINDOW w AS (PARTITION BY category ORDER BY day ROWS UNBOUNDED PRECEDING)""",
)
def a42(spark, d):
    return P.exposure_series(positions(spark, d), "category").withColumn("bankroll", F.round("bankroll", 2))


@query(
    "w23_f25_f26_fill_cost",
    views("levels")
    + f""", a AS (SELECT *, min(price) OVER (PARTITION BY snapshot_id) AS best, price * size AS usd FROM levels WHERE NOT is_bid),
c AS (SELECT *, sum(usd) OVER (PARTITION BY snapshot_id ORDER BY price ROWS UNBOUNDED PRECEDING) - usd AS before FROM a WHERE price <= best * 1.05),
t AS (SELECT *, greatest(0, least(usd, 5000 - before)) AS taken FROM c)
SELECT snapshot_id, {r6({"filled": "sum(taken)", "shares": "sum(taken / price)", "avg_cents": "sum(taken) / sum(taken / price) * 100", "slippage_bps": "(sum(taken) / sum(taken / price) - best) / best * 10000"})}, sum(taken) >= 2500 AS enough FROM t GROUP BY snapshot_id, best""",
)
def w23(spark, d):
    return P.walk_depth(V.book_levels(spark, d)).withColumn("avg_cents", F.col("avg_price") * 100).drop("avg_price")


@query("f29_labels", M + "SELECT condition_id, trim(split_part(question || ': rest', ':', 1)) AS title, 'https://example.org/event/' || coalesce(nullif(category, 'view'), condition_id) AS url FROM markets")
def f29(spark, d):
    c = F.col
    return V.markets(spark, d).select(
        "condition_id", F.trim(F.split_part(F.concat("question", F.lit(": rest")), F.lit(":"), F.lit(1))).alias("title"), F.concat(F.lit("https://example.org/event/"), F.coalesce(F.nullif(c("category"), F.lit("view")), c("condition_id"))).alias("url")
    )


#: What each kind of event is checked by: a sum over what its routed rows hold.
ROUTED = {
    "book": ("CAST(get(bids, 0).price AS DOUBLE) + CAST(get(asks, 0).size AS DOUBLE)", "price + size"), "price_change": ("price", "price"), "last_trade_price": ("price * size", "price * size"), "best_bid_ask": ("ask - bid", "0.02"),
    "tick_size_change": ("tick", "0.001 * (1 + trade_id % 3)"), "market_resolved": ("CASE WHEN winner = 'Yes' THEN 1 ELSE 0 END", "CASE WHEN outcome = 'Yes' THEN 1 ELSE 0 END"),
}
KINDS = "[" + ", ".join(f"'{k}'" for k in ROUTED) + "]"


def wire_events(trades):
    """Trades as a stream of JSON texts of the six kinds, one of each seven of a kind that is unknown, and some that are broken."""
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, (*ROUTED, "other"))), (c("trade_id") % 7 + 1).cast("int"))
    level = lambda price, size: F.array(F.struct(price.cast("string").alias("price"), size.cast("string").alias("size")))
    fields = [kind.alias("event_type"), c("token_id"), c("price"), c("size"), (c("price") - 0.01).alias("bid"), (c("price") + 0.01).alias("ask"), (0.001 * (1 + c("trade_id") % 3)).alias("tick"), c("condition_id"), c("outcome").alias("winner"), level(c("price"), c("size")).alias("bids"), level(c("price"), c("size")).alias("asks")]
    return trades.select(F.when(c("trade_id") % 101 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(*fields))).alias("value"))


@query(
    "s5_route_market_events",
    T + f"SELECT kind, count(*) AS n, {r6({'total': 'sum(CASE kind ' + ' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {sql}' for k, (_, sql) in ROUTED.items()) + ' END)'})} FROM (SELECT *, {KINDS}[CAST(trade_id % 7 + 1 AS INT)] AS kind FROM trades WHERE trade_id % 101 <> 0) WHERE kind IS NOT NULL GROUP BY 1",
)
def s5(spark, d):
    routed = N.route_market_events(wire_events(V.trades(spark, d)))
    parts = [routed[k].select(F.lit(k).alias("kind"), F.expr(told).cast("double").alias("x")) for k, (told, _) in ROUTED.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("s13_append", T + f"SELECT category, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, {r6({'volume': 'sum(notional)'})}, CASE WHEN dayofmonth(ts) <= 15 THEN 'first' ELSE 'second' END AS batch FROM trades GROUP BY 1, 2, 5")
def s13(spark, d):
    """Daily reports in two batches, each of them appended twice, as after a failure."""
    reports = V.trades(spark, d).groupBy("category", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("notional").alias("volume"))
    table = f"{folders.new(spark, 'reports')}/table"
    for batch, early in (("first", True), ("second", False), ("first", True), ("second", False)):
        N.append(reports.where((F.dayofmonth("day") <= 15) == F.lit(early)), table, batch)
    return N.appended(spark, table)
