"""Sampled bounds that split hot keys: rows meet the same ones however often and in however many partitions they are read."""

import pytest
from pyspark.sql import functions as F

from mktlens.operators import order as O
from mktlens.operators import quant as Q
from mktlens.operators import scan

#: Shuffles are read in partitions that hang on their size in bytes, which isn't the same for each reading of the rows.
SMALL = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k"}


@pytest.fixture
def dealt(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_places_of_many_values(dealt):
    n = 40_000
    rows = dealt.range(2 * n).select(F.lit("a").alias("by"), (F.col("id") * 7919 % n + 0.25).alias("x"))
    wrong = O.placed(O.value_counts(rows, ("by",), "x"), ("by",), "x").where(f"below <> 2 * (x - 0.25) or total <> {2 * n} or m <> 2")
    assert wrong.count() == 0


def test_impact_by_size_of_many_sizes(dealt):
    n = 40_000
    size = F.col("id") * 7919 % n
    rows = dealt.range(n).select(F.lit("a").alias("category"), F.col("id").alias("trade_id"), (size / 100).alias("notional"), F.lit("Yes").alias("outcome"), (size + 0.0).alias("drift_30m"))
    got = {r["quantile"]: (r["avg_impact"], r["n"]) for r in Q.impact_by_size(rows, "category").collect()}
    assert got == {q: (q * n - 0.5, 20) for q in (0.25, 0.5, 0.75, 0.9, 0.99)}


def test_running_sum_of_a_long_series(dealt):
    n = 60_000
    rows = dealt.range(2 * n).groupBy(F.lit("a").alias("k"), (F.col("id") * 7919 % n).alias("at")).agg(F.sum(F.lit(1)).alias("one"), F.max(F.sqrt("id")).alias("more"))
    ranked = scan.by_rank(rows, ["k"], "at", F.count("more").alias("m")).where("m > 0")
    assert scan.running_sum(ranked, ["k"], ["at"], "one", "before").where("before <> 2 * at").count() == 0
