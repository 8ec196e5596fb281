"""Metrics of books in one aggregate, by hand."""

from mktlens.operators import features as X


def test_book_metrics_without_a_window(spark):
    levels = [(1, True, 0.50 - 0.01 * k, 100.0 * k) for k in range(8)] + [(1, False, 0.52 + 0.01 * k, 10.0) for k in range(8)]
    levels += [(2, True, 0.4, 7.0), (3, False, 0.6, None), (3, True, 0.58, 5.0), (3, True, 0.1, 9.0)]
    made = spark.createDataFrame(levels[::-1], "snapshot_id long, is_bid boolean, price double, size double").selectExpr("*", "timestamp_seconds(snapshot_id) AS ts", "'t' AS token_id", "'m' AS condition_id", "'c' AS category")
    books = X.book_metrics(made)
    assert "Window" not in books._jdf.queryExecution().executedPlan().toString()
    got = {r["snapshot_id"]: r for r in books.collect()}
    names = ("best_bid", "best_ask", "bid_5", "ask_5", "bid_10", "ask_10", "bid_top5", "ask_top5", "total_size")
    shown = {i: tuple(None if r[c] is None else round(r[c], 6) for c in names) for i, r in got.items()}
    assert shown == {
        1: (0.5, 0.52, 100.0, 20.0, 1000.0, 50.0, 1000.0, 50.0, 2880.0),
        2: (0.4, None, 0.0, 0.0, 0.0, 0.0, 7.0, 0.0, 7.0),
        3: (0.58, 0.6, 5.0, 0.0, 5.0, 0.0, 14.0, 0.0, 14.0),
    }
    assert got[2]["mid"] is None and round(got[1]["mid"], 6) == 0.51


def test_books_of_one_instant_after_a_trade(spark):
    """The largest snapshot_id counts, not the largest mid, on both sides of a trade."""
    books = spark.createDataFrame([(1, 5, 0.7), (2, 5, 0.5), (3, 20, 0.6), (4, 20, 0.4), (6, 50, 0.3), (5, 50, 0.9)], "snapshot_id long, s long, mid double").selectExpr("*", "'t' AS token_id", "timestamp_seconds(s) AS ts")
    trades = spark.sql("SELECT 9L AS trade_id, 't' AS token_id, timestamp_seconds(10) AS ts, 'BUY' AS side")
    (got,) = X.post_trade_impact(trades, books).collect()
    assert (got["mid_before"], got["mid_30s"], got["mid_60s"]) == (0.5, 0.4, 0.3)
