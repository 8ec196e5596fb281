"""Trends at their limit but for rounding: the flag follows a sum of doubles in the order of time, as SQL's sliding average does."""

import random

from pyspark.sql import functions as F

from mktlens.operators import events as E

DAY = 1_704_067_200


def test_trend_at_its_limit(spark):
    """Each token's last trade is 0.01 below the mean of those before; exact means and added ones flag different trades."""
    rng, rows, expected = random.Random(1), [], {}
    for k in range(120):
        prices = [rng.randrange(20, 99) / 100 + 0.005 for _ in range(rng.randrange(2, 9))]
        m = 10 * (len(prices) + 1)  # the last but one makes the mean a multiple of 0.005, as prices are
        last = next((c / 100 + 0.005 for c in range(20, 99) if round((sum(prices) + c / 100 + 0.005) * 1000) % m == m // 2), None)
        if last is None:
            continue
        prices.append(last)
        price = (round(sum(prices) * 1000 / len(prices)) - 10) / 1000
        total = 0.0
        for p in prices:
            total += p
        expected[1000 * k + 999] = price - total / len(prices) < -0.01
        rows += [(1000 * k + i, f"t{k}", 40_000.0 + 60 * i, p) for i, p in enumerate(prices)] + [(1000 * k + 999, f"t{k}", 40_000.0 + 60 * len(prices), price), (1000 * k + 998, f"t{k}", 30_000.0, 0.9)]
    made = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "trade_id long, token_id string, s double, price double")
    ts = F.timestamp_micros((F.lit(DAY * 1_000_000) + F.col("s") * 1_000_000).cast("long"))
    trades = made.select("*", F.lit("m").alias("condition_id"), ts.alias("ts"), F.lit(500.0).alias("notional"), F.lit("BUY").alias("side"), F.lit("Yes").alias("outcome"), F.lit("w").alias("wallet")).drop("s")
    markets = spark.createDataFrame([("m", "Yes", "?")], "condition_id string, winning_outcome string, question string").withColumn("end_date", F.timestamp_seconds(F.lit(DAY + 86_400)))
    wallets = spark.createDataFrame([("w", 1)], "wallet string, transaction_count int").withColumn("first_seen_at", F.timestamp_seconds(F.lit(DAY)))
    got = {r["trade_id"]: r for r in E.contrarian_events(trades, markets, wallets).collect()}
    assert len(got) == len(rows)
    assert {i: got[i]["is_against_trend"] for i in expected} == expected
    assert all(abs(got[i]["price_trend_30m"] + 0.01) < 1e-12 for i in expected)
    exact = {i: got[i]["price_trend_30m"] < -0.01 for i in expected}
    assert len(expected) > 40 and exact != expected and len(set(expected.values())) == 2
