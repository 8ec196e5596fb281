"""Which markets, trades and data count: filters, freshness, paging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import MarketFilter

#: Milliseconds from which data of a kind is a warning, stale, critical.
STALENESS = {"orderbook": (5_000, 10_000, 30_000), "trade": (10_000, 15_000, 60_000), "wallet": (1_800_000, 3_600_000, 86_400_000)}


def any_term(terms: tuple[str, ...], whole_words: bool = True) -> str:
    """One expression for all terms."""
    quoted = "|".join(re.escape(t).replace("\\ ", " ") for t in terms)
    return rf"(?i)\b(?:{quoted})\b" if whole_words else f"(?i)(?:{quoted})"


def market_filter(markets: DataFrame, p: MarketFilter = MarketFilter()) -> DataFrame:
    """markets (volume, liquidity, category, tags, question) with `reason` of the first rule that leaves one out (null: kept)."""
    black, white = (F.array(*map(F.lit, terms)) for terms in (p.blacklist, p.whitelist))
    tags, category, question = F.transform("tags", F.lower), F.coalesce(F.lower("category"), F.lit("")), F.lower("question")
    out = F.arrays_overlap(tags, black) | F.array_contains(black, category) | question.rlike(any_term(p.blacklist))
    near = F.exists(tags, lambda t: F.exists(white, lambda w: t.contains(w) | w.contains(t)))
    kept = F.array_contains(white, category) | near | question.rlike(any_term(p.whitelist))
    reason = F.when(F.col("volume") < p.min_volume, "volume").when(F.col("liquidity") < p.min_liquidity, "liquidity").when(out, "blacklist").when(~kept, "whitelist")
    return markets.withColumn("reason", reason)


def tracked_tokens(markets: DataFrame) -> DataFrame:
    """One row for each outcome token (outcomes: array<struct<name,token_id>>) of markets that are neither resolved nor left out."""
    return markets.where("not resolved and reason is null").select("condition_id", "end_date", F.explode("outcomes").alias("o")).select("condition_id", "end_date", "o.token_id", F.col("o.name").alias("outcome"))


def expire_tokens(tokens: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    return tokens.where(F.col("end_date") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES"))


def exclude_topics(df: DataFrame, terms: tuple[str, ...], columns: tuple[str, ...] = ("question", "category")) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.col(c).rlike(any_term(terms, whole_words=False)), F.lit(False))
    return df.where(~hit)


def top_trade(excluded: Column, least: float = 1000.0, highest: float = 0.95, large: float = 50_000.0) -> Column:
    """Large buys below near-certain prices; very large ones pass whatever their topic."""
    return (F.col("side") == "BUY") & (F.col("notional") >= least) & (F.col("price") <= highest) & ((F.col("notional") >= large) | ~excluded)


def not_near_certain(price: str = "price", low: float = 0.05, high: float = 0.95) -> Column:
    return F.col(price).isNull() | F.col(price).between(low, high)


def staleness(age_ms: Column, kind: str) -> Column:
    warning, stale, critical = STALENESS[kind]
    return F.when(age_ms < warning, "fresh").when(age_ms < stale, "warning").when(age_ms < critical, "stale").otherwise("critical")


def combined_staleness(df: DataFrame, key: str, item: str, status: str) -> DataFrame:
    """The worst status of each key, and its items that are not fresh, sorted."""
    order = F.array(*map(F.lit, ("fresh", "warning", "stale", "critical")))
    rank = F.array_position(order, F.col(status)).cast("int")
    out = df.groupBy(key).agg(F.max(rank).alias("r"), F.array_join(F.sort_array(F.collect_list(F.when(rank > 1, F.col(item)))), ",").alias("unsafe"))
    return out.select(key, F.element_at(order, F.col("r")).alias("status"), "unsafe")


def freshness_gate(df: DataFrame) -> DataFrame:
    """stale: what keeps a token from being traded (book_age_ms, trade_age_ms, end_date; a missing trade is fine)."""
    rules = [(F.coalesce(F.col("book_age_ms") > 10_000, F.lit(True)), "orderbook"), (F.coalesce(F.col("trade_age_ms") > 15_000, F.lit(False)), "trades"), (F.col("end_date").isNull(), "market")]
    return df.withColumn("stale", F.array_join(F.array_compact(F.array(*(F.when(bad, F.lit(n)) for bad, n in rules))), ","))


def query_trades(trades: DataFrame, condition_id=None, token_id=None, wallet=None, start=None, end=None, side=None, order="ts", descending=True, offset=0, limit=100) -> DataFrame:
    """Optional filters, ordering by time, size or price (ties by trade_id), and a page."""
    out = trades
    for name, value in (("condition_id", condition_id), ("token_id", token_id), ("wallet", wallet), ("side", side)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("ts") < F.lit(end).cast("timestamp"))
    return out.orderBy(F.desc(order) if descending else F.asc(order), "trade_id").offset(offset).limit(limit)


def query_markets(markets: DataFrame, text=None, category=None, end_from=None, end_to=None, resolved=None, offset=0, limit=100) -> DataFrame:
    out = markets
    if text is not None:
        out = out.where(F.lower("question").contains(text.lower()))
    if category is not None:
        out = out.where(F.col("category") == category)
    if end_from is not None:
        out = out.where(F.col("end_date") >= F.lit(end_from).cast("timestamp"))
    if end_to is not None:
        out = out.where(F.col("end_date") <= F.lit(end_to).cast("timestamp"))
    if resolved is not None:
        out = out.where(F.col("winning_outcome").isNotNull() == resolved)
    return out.orderBy("end_date", "condition_id").offset(offset).limit(limit)
