"""Ranking queries: latest per key, top lists, markets that close soon. Every order has a unique last key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key; an aggregate with map-side combine, without a sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def top_per_group(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def top(df: DataFrame, k: int, *order: Column, offset: int = 0) -> DataFrame:
    return (df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)).limit(k)


def closing_soon(markets: DataFrame, as_of, days: int = 7) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    minutes = (F.unix_micros("end_date") - F.unix_micros(now)) / 60_000_000.0
    return markets.withColumn("minutes_to_close", minutes).where(F.col("minutes_to_close").between(0, days * 1440))


def closing_with_activity(markets: DataFrame, trades: DataFrame, as_of, k: int = 5, tiers: tuple[int, ...] = (60, 1440, 10080), each: int = 5, least: float = 100.0) -> DataFrame:
    """The markets of the smallest tier of minutes that holds k of them (else the largest), each with its latest large buys before as_of."""
    soon = closing_soon(markets, as_of)
    counts = soon.agg(*(F.count_if(F.col("minutes_to_close") <= t).alias(f"t{t}") for t in tiers))
    tier = F.coalesce(*(F.when(F.col(f"t{t}") >= k, F.lit(t)) for t in tiers), F.lit(tiers[-1]))
    chosen = soon.crossJoin(F.broadcast(counts.select(tier.alias("tier")))).where("minutes_to_close <= tier")  # the tier is one row
    buys = trades.where((F.col("side") == "BUY") & (F.col("notional") >= least) & (F.col("ts") <= F.lit(as_of).cast("timestamp")))
    recent = top_per_group(buys, "condition_id", each, F.desc("ts"), F.asc("trade_id")).groupBy("condition_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "trade_id"))), lambda x: x["trade_id"]).alias("trade_ids")
    )
    return chosen.join(recent, "condition_id", "left").select("condition_id", "tier", F.array_join(F.col("trade_ids").cast("array<string>"), ",").alias("trade_ids"))
