"""Streaming queries over the events table, drained once; their batch twins are checked by SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import features as X
from ..sources import folders
from ..sources import views as V
from ..streaming import ordered as OR
from ..streaming import streams as ST
from .live import FULL, HAWKES, STRENGTH
from .registry import query
from .research import r6
from .sqlviews import BOOK, views

T = views("trades")


@query("st1_ingest", T + f"SELECT trade_id, token_id, {r6({'notional': 'notional'})} FROM trades")
def st1(spark, d):
    return ST.drained(spark, ST.deduplicated(ST.trade_stream(spark, d)).select("trade_id", "token_id", "notional"))


MEASURED = f"count(*) AS trades, {r6({'volume': 'sum(notional)', 'high': 'max(price)', 'low': 'min(price)'})}"


@query(
    "st2_tumbling_bars",
    T + f"SELECT minutes, token_id, time_bucket(to_minutes(minutes), ts) AS start, {MEASURED} FROM trades, (SELECT unnest([1::BIGINT, 5, 60]) AS minutes) GROUP BY 1, 2, 3",
)
def st2(spark, d):
    bars = [ST.drained_groups(spark, ST.tumbling_bars(ST.trade_stream(spark, d), minutes), "token_id", "start").withColumn("minutes", F.lit(minutes)) for minutes in (1, 5, 60)]
    return bars[0].unionByName(bars[1]).unionByName(bars[2])


@query(
    "st3_sliding_windows",
    T + f"SELECT token_id, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS start, {MEASURED} FROM trades, (SELECT unnest(generate_series(0, 59)) AS k) GROUP BY 1, 2",
)
def st3(spark, d):
    return ST.drained_groups(spark, ST.sliding_windows(ST.trade_stream(spark, d), 60, 1), "token_id", "start")


def replayed_tokens(spark, d, processor, until):
    """Trades and books through a processor. The tables' files may come in any order, so the watermark waits for the whole span of time."""
    first, last = V.trades(spark, d).agg(F.min("ts"), F.max("ts")).first()
    seconds = int(max((UNTIL - BEGIN).total_seconds(), (last - first).total_seconds() if first else 0)) + 1
    # nothing comes out before all has been read, and each micro-batch goes to every bucket again, so they are large
    rows = OR.token_rows(ST.trade_stream(spark, d, REPLAY_FILES), ST.as_stream(V.book_mids(spark, d), REPLAY_FILES))
    return OR.replayed(spark, rows, processor, until, f"{seconds} seconds", seconds)


#: The most files in a micro-batch of a replay.
REPLAY_FILES = 64
#: The books of the tables lie between these.
BEGIN, UNTIL = datetime(2024, 1, 1), datetime(2024, 2, 1)
AS_OF = datetime(2024, 1, 31)


@query(
    "st4_token_state",
    T
    + f""", o AS (SELECT *, count(*) OVER w AS n, avg(notional) OVER w AS mean, var_samp(notional) OVER w AS spread FROM trades WINDOW w AS (PARTITION BY token_id ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, sum(CASE WHEN spread > 1e-9 THEN (notional - mean) / sqrt(spread) ELSE 0 END) OVER (PARTITION BY token_id ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS p FROM o),
q AS (SELECT a.trade_id, count(*) AS n, list_sort(list(least(255, greatest(0, floor(ln(greatest(b.notional, 0.001) / 0.001) / ln(1.1)))))) AS steps
 FROM trades a JOIN trades b ON b.token_id = a.token_id AND (b.ts, b.trade_id) <= (a.ts, a.trade_id) GROUP BY 1)
SELECT trade_id, token_id, {r6({"intensity": "intensity", "cusum": "p - least(0, min(p) OVER (PARTITION BY token_id ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING))", "q95": "0.001 * pow(1.1, steps[CAST(ceil(0.95 * q.n) AS INT)] + 0.5)"})}
FROM p JOIN q USING (trade_id) JOIN {HAWKES} USING (trade_id)""",
)
def st4(spark, d):
    return replayed_tokens(spark, d, OR.TokenState(), UNTIL).drop("mid")


@query(
    "st6_latest_book",
    views("trades", "levels")
    + BOOK
    + f""", hk AS {HAWKES} SELECT t.trade_id, {r6({"mid": "mid", "intensity": "intensity"})} FROM trades t JOIN hk USING (trade_id)
 ASOF LEFT JOIN (SELECT token_id, ts, mid FROM books WHERE mid IS NOT NULL) b ON b.token_id = t.token_id AND b.ts <= t.ts""",
)
def st6(spark, d):
    return replayed_tokens(spark, d, OR.TokenState(), UNTIL).select("trade_id", "mid", "intensity")


LIMITS_MS = {OR.BOOK: 10_000, OR.TRADE: 15_000}


@query(
    "st8_staleness",
    views("trades", "levels")
    + BOOK
    + """, r AS (SELECT token_id, 'orderbook' AS kind, epoch_us(ts) AS us, 10000000 AS lim FROM books WHERE mid IS NOT NULL UNION SELECT token_id, 'trades', epoch_us(ts), 15000000 FROM trades),
n AS (SELECT *, lead(us) OVER (PARTITION BY token_id, kind ORDER BY us) AS next FROM r),
f AS (SELECT token_id, min(us) FILTER (kind = 'trades') AS trade, min(us) FILTER (kind = 'orderbook') AS book FROM r GROUP BY 1)
SELECT token_id, kind, us AS last_us, us + lim AS stale_us FROM n WHERE CASE WHEN next IS NULL THEN us + lim < epoch_us(TIMESTAMP '2024-01-31') ELSE next - us > lim END
UNION ALL SELECT token_id, 'orderbook', -1, trade FROM f WHERE book IS NULL OR trade < book""",
)
def st8(spark, d):
    # silence is told at the end of a bucket, so wide ones do for a replay
    return replayed_tokens(spark, d, OR.Silence(LIMITS_MS, 600_000), AS_OF).na.fill(-1, ["last_us"])


@query(
    "st5_enriched",
    views("trades", "wallets", "markets")
    + f"SELECT trade_id, transaction_count, {r6({'ramp': 'coalesce(least(5, 1 + 2 * exp(-0.1 * greatest(0, (epoch_us(end_date) - epoch_us(ts)) / 1000000.0) / 3600)), 1)'})} FROM trades LEFT JOIN wallets USING (wallet) LEFT JOIN markets USING (condition_id)",
)
def st5(spark, d):
    return ST.drained(spark, ST.enriched(ST.trade_stream(spark, d), V.wallets(spark, d), V.markets(spark, d)).select("trade_id", "transaction_count", "ramp"))


@query(
    "st7_scored_signals",
    FULL + f"SELECT trade_id, token_id, strength, false AS in_no_trade_zone, {r6({'composite': 'composite'})} FROM (SELECT *, {STRENGTH} AS strength FROM scored) WHERE strength <> 'none' AND NOT s <= 120",
)
def st7(spark, d):
    books, wallets, markets = (folders.cut(df) for df in (X.book_metrics(V.book_levels(spark, d)), V.wallets(spark, d), V.markets(spark, d)))

    def score(trades):
        return S.with_scores(X.feature_vectors(trades, books, wallets, markets)).select("trade_id", "ts", "token_id", "composite", "strength", "in_no_trade_zone")

    return ST.gated(ST.rescored(spark, ST.trade_stream(spark, d), score)).drop("ts")
