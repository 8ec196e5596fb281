"""Sums of money that don't depend on the order of adding, and what has too many digits for them."""

import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from mktlens.operators import performance as P
from mktlens.params import Grid

SCHEMA = "trade_id long, notional double, price double, outcome_won boolean"


def test_pnl_of_equal_events_is_equal(spark):
    """All events are in three modes; the fourth splits them into other cells, and partitions differ."""
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(500, 9_000_000)), (rng.randrange(10, 25) + 0.5) / 100, rng.random() < 0.5) for i in range(3000)]
    events = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "'Yes' AS outcome", "CAST(20 AS DOUBLE) AS minutes_before_close", "true AS is_price_contrarian", "true AS is_against_trend", "trade_id % 2 = 0 AS is_against_ofi", "true AS is_contrarian"
    )
    exact = sum(Decimal(round(n)) * ((1 if won else 0) - Decimal(str(round(p, 3)))) for _, n, p, won in rows)
    for parts in (1, 3):
        got = P.grid_search(events.repartition(parts), Grid(min_events=1)).where("config_id LIKE '%|500|30|0.1-0.25|15-30|all' AND config_id NOT LIKE 'vs_ofi%'").collect()
        assert {r["pnl"] for r in got} == {float(exact)} and len(got) == 3
        assert [r["config_id"].split("|")[0] for r in sorted(got, key=lambda r: r["rank_pnl"])] == ["price_only", "vs_both", "vs_trend"]


def test_money_with_many_digits(spark):
    """Tiny, huge and endless amounts are added up as doubles."""
    rows = [(1, 1e-12, 0.25, True), (2, 1 / 3, 0.25, True), (3, 1e25, 0.25, False)]
    made = spark.createDataFrame(rows, SCHEMA)
    small = P.event_metrics(made.where("trade_id = 1")).first()
    assert (small["pnl"], small["roi"]) == (7.5e-13, 0.75)
    both = P.event_metrics(made).first()
    assert math.isclose(both["pnl"], -2.5e24) and math.isclose(both["win_pnl"], 0.25 + 7.5e-13)
    odd = P.event_metrics(made.unionByName(made.limit(1).withColumn("notional", F.lit(math.nan)))).first()
    assert math.isnan(odd["pnl"]) and odd["n"] == 4
