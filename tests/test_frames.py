"""Frames of time as differences of growing frames, against plain Python with exact fractions."""

import random
import time
from fractions import Fraction

from pyspark.sql import functions as F

from mktlens.operators import events as E
from mktlens.operators import features as X

DAY = 1_704_067_200


def trades_of(spark, rows):
    """rows: trade_id, token, second, price, notional, side."""
    made = spark.createDataFrame(rows, "trade_id long, token_id string, s double, price double, notional double, side string")
    return made.select("*", F.lit("m").alias("condition_id"), F.timestamp_micros((F.lit(DAY * 1_000_000) + F.col("s") * 1_000_000).cast("long")).alias("ts")).drop("s")


def test_price_and_flow_is_exact(spark):
    """Sums don't drift with the number of rows or their order: 0.345 has the mean 0.345, and equal flows cancel."""
    rng = random.Random(3)
    rows = [(k, "a", float(k), 0.345, 29.27 * 100, "BUY") for k in range(300)] + [(300, "a", 300.0, 0.335, 10.0, "BUY")]
    rows += [(400 + k, "ab"[k % 2], 50_000.0 + rng.choice((rng.randrange(9000), 900 * rng.randrange(10))), rng.randrange(100) / 100 + 0.005, rng.randrange(1, 9999) / 100, rng.choice(("BUY", "SELL"))) for k in range(500)]
    rows += [(2000 + k, "b", 100_000.0 + k, 0.5, 0.1 * (k // 2 + 1), "BUY" if k % 2 else "SELL") for k in range(400)] + [(3000, "b", 100_400.0, None, 1.0, "BUY")]
    got = {r["trade_id"]: r for r in E.price_and_flow(trades_of(spark, random.Random(1).sample(rows, len(rows)))).collect()}
    assert len(got) == len(rows)
    exact = lambda x: Fraction(round(x * 10**8), 10**8)
    for i, token, s, price, _, _ in rows:
        r = got[i]
        prior = [exact(p) for _, t, at, p, _, _ in rows if t == token and s - 1800 < at < s and p is not None]
        assert r["price_trend_30m"] == (None if price is None else price - (float(sum(prior)) / len(prior) if prior else price))
        assert r["ofi_30m"] == float(sum(exact(v) * (1 if side == "BUY" else -1) for _, _, at, _, v, side in rows if s - 1800 < at < s))
        for name, reach in (("drift_30m", 1800), ("drift_60m", 3600)):
            last = max(((at, k, p) for k, t, at, p, _, _ in rows if t == token and s < at <= s + reach), default=None)
            assert r[name] == (None if last is None or price is None or last[2] is None else (last[2] - price) / price)


def test_sizes_that_are_no_numbers_stay_in_their_frames(spark):
    rows = [(0, "a", 0.0, 0.5, float("nan"), "BUY"), (1, "a", 60.0, 0.5, 1.0, "BUY"), (2, "a", 3600.0, 0.5, 2.0, "SELL"), (3, "a", 3700.0, 0.5, 2.0, "SELL")]
    got = {r["trade_id"]: r["ofi_30m"] for r in E.price_and_flow(trades_of(spark, rows)).collect()}
    assert got[1] != got[1] and (got[0], got[2], got[3]) == (0.0, 0.0, -2.0)


def test_highest_trade_over_segments(spark):
    rng = random.Random(6)
    rows = [(k, "ab"[k % 5 == 0], rng.choice((rng.randrange(20_000), 1800 * rng.randrange(12))) + 0.0, 0.5, rng.choice((rng.randrange(20) * 50.0, float("nan"), None, 900.0)) if k % 7 == 0 else rng.randrange(20) * 50.0, "BUY") for k in range(600)]
    nan = lambda v: (v != v, v)
    for minutes in (60, 1):
        got = {r["trade_id"]: (r["top_trade_id"], r["top_notional"]) for r in X.highest_trade(trades_of(spark, rows), minutes).collect()}
        assert len(got) == len(rows)
        for i, token, s, *_ in rows:
            frame = [(nan(v), k, v) for k, t, at, _, v, _ in rows if t == token and s - 60 * minutes <= at <= s and v is not None and not v < 500]
            top = max(frame, key=lambda r: (r[0][0], 0 if r[0][0] else r[2], r[1]), default=None)
            assert got[i][0] == (top and top[1]) and (top is None or got[i][1] == top[2] or top[2] != top[2])


def test_highest_trade_of_a_crowded_hour(spark):
    """150,000 trades of a token within an hour: about 10**10 steps, if each row goes through its frame."""
    crowd = spark.range(150_000).select(F.col("id").alias("trade_id"), F.lit("a").alias("token_id"), F.timestamp_micros(F.lit(DAY * 1_000_000) + F.col("id") * 20_000).alias("ts"), (F.col("id") * 7919 % 1000 + 0.0).alias("notional"))
    start = time.time()
    assert X.highest_trade(crowd).agg(F.max("top_notional")).first()[0] == 999.0
    assert time.time() - start < 30
