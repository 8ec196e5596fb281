"""Contrarian events, the fact table of the research operators, and the filters over it.

The table is one plan: a median for each market (aggregated, then joined), one window by market and
one by token. Each window is computed over all trades, as its frames have to see sells and small
trades, and filtered after that.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import EventFilter, EventParams
from ..sources.folders import cut
from .order import placed, quantile, value_counts
from .scan import in_segments, own, time_segment

MAD_SCALE = 1.4826
_MINUTE = 60_000_000
#: A mean price of doubles is off by less.
_ROUNDING = 1e-9


def size_ranks(trades: DataFrame, keys: tuple[str, ...] = ("condition_id",), x: str = "notional") -> DataFrame:
    """size_percentile (share of strictly smaller ones, in percent) and size_zscore (robust; 0 where MAD is 0).

    All of it is worked out over distinct sizes; each trade then meets its size's row.
    """
    sizes = cut(placed(value_counts(trades, keys, x), keys, x))
    middle = quantile(sizes, keys, x, 0.5, "_median")
    sizes = sizes.join(middle, list(keys))
    away = sizes.groupBy(*keys, F.abs(F.col(x) - F.col("_median")).alias("_away")).agg(F.sum("m").alias("m"))
    spread = quantile(placed(away, keys, "_away"), keys, "_away", 0.5, "_mad")
    score = F.when(F.col("_mad") == 0, F.lit(0.0)).otherwise((F.col(x) - F.col("_median")) / (MAD_SCALE * F.nullif(F.col("_mad"), F.lit(0.0))))
    told = sizes.join(spread, list(keys)).select(*keys, x, (F.col("below") * 100.0 / F.col("total")).alias("size_percentile"), score.alias("size_zscore"))
    return trades.join(told, [*keys, x], "left")


def price_and_flow(trades: DataFrame, minutes: int = 30) -> DataFrame:
    """Price against the token's mean before, the market's signed flow before, and drift after each trade.

    Frames are open on both sides before a trade, and closed at their end after it. Trades of one
    instant don't see each other. Markets are dealt by segments of time, so a large one is many tasks' work.
    Spark goes through a sliding frame again for each row, but adds to a growing one, so a frame is
    the difference of two growing ones. Their sums are decimals: differences are exact, and don't
    depend on the order in which rows come.
    """
    us = F.unix_micros("ts")
    rows = in_segments(trades, us, minutes * 60, 2 * minutes * 60)
    token = Window.partitionBy("condition_id", "_segment", "token_id").orderBy(us)
    market = Window.partitionBy("condition_id", "_segment").orderBy(us)
    signed = F.when(F.col("side") == "BUY", F.col("notional")).otherwise(-F.col("notional"))

    def before(c: Column, w: Window) -> Column:
        """A sum or count over the last `minutes`, which the growing frame up to their start doesn't hold yet."""
        until = lambda end: F.coalesce(c.over(w.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
        return until(-1) - until(-minutes * _MINUTE)

    def total(x: Column, kind: str, w: Window) -> Column:
        """NaN where a value of the frame is no decimal."""
        number = x.try_cast(kind)
        return F.when(before(F.count(x), w) == before(F.count(number), w), before(F.sum(number), w).cast("double")).otherwise(float("nan"))

    def later(m: int) -> Column:
        best = F.max(F.struct(us.alias("us"), "trade_id", "price")).over(token.rangeBetween(Window.unboundedPreceding, m * _MINUTE))
        return F.when(best["us"] > us, (best["price"] - F.col("price")) / F.col("price"))

    mean = F.try_divide(total(F.col("price"), "decimal(18,8)", token), before(F.count("price"), token))
    return own(
        rows.select(
            "*",
            (F.col("price") - F.coalesce(mean, F.col("price"))).alias("price_trend_30m"),
            total(signed, "decimal(27,8)", market).alias("ofi_30m"),
            later(minutes).alias("drift_30m"),
            later(2 * minutes).alias("drift_60m"),
        )
    )


def mean_in_order(rows: DataFrame, trades: DataFrame, minutes: int) -> DataFrame:
    """condition_id, token_id, ts of the rows and the mean price in the `minutes` before, as a sum of doubles in the order of time.

    For few rows: each goes through its frame. Rows without a price before them are left out.
    """
    us, width, at = F.unix_micros("ts"), minutes * 60, F.col("_at")
    start, key = us - F.lit(minutes * _MINUTE), ["condition_id", "token_id", "ts"]
    frames = rows.select(*key).distinct().withColumn("_segment", F.explode(F.sequence(time_segment(start, width), time_segment(us, width))))
    seen = trades.where("price is not null").select("condition_id", "token_id", time_segment(us, width).alias("_segment"), us.alias("_at"), "trade_id", "price")
    inside = frames.join(seen, ["condition_id", "token_id", "_segment"]).where((at > start) & (at < us))
    growing = Window.partitionBy(*key).orderBy("_at", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = inside.select(*key, "_at", "trade_id", F.sum("price").over(growing).alias("_sum"))
    return sums.groupBy(*key).agg((F.max_by("_sum", F.struct("_at", "trade_id")) / F.count(F.lit(1))).alias("mean"))


def contrarian_events(trades: DataFrame, markets: DataFrame, wallets: DataFrame, params: EventParams = EventParams()) -> DataFrame:
    """Large buys before the close, with their size, trend, flow, drift, wallet and outcome.

    outcome_won is null where the market has no winner. Of trades of one token and instant the last
    one counts. Where the trend is at its limit but for rounding, the mean is added up in the order of
    time, as a sliding average does.
    """
    featured = price_and_flow(size_ranks(trades), params.trend_minutes)
    info = markets.select("condition_id", "end_date", "winning_outcome", "question")
    minutes = (F.unix_micros("end_date") - F.unix_micros("ts")) / F.lit(float(_MINUTE))
    last = Window.partitionBy("condition_id", "token_id", "ts").orderBy(F.desc("trade_id"))
    large = cut(
        featured.join(info, "condition_id")
        .withColumn("minutes_before_close", minutes)
        .where((F.col("side") == "BUY") & (F.col("notional") >= params.min_notional) & F.col("minutes_before_close").between(0, params.window_minutes))
        .withColumn("_place", F.row_number().over(last))
        .where("_place = 1")
        .drop("_place")
    )
    at_limit = large.where(F.abs(F.col("price_trend_30m") - params.against_trend_below) < _ROUNDING)
    trend = F.coalesce(F.col("price") - F.col("_mean"), "price_trend_30m")
    against_trend, against_flow = F.col("_trend") < params.against_trend_below, F.col("ofi_30m") < 0
    return (
        large.join(mean_in_order(at_limit, trades, params.trend_minutes).withColumnRenamed("mean", "_mean"), ["condition_id", "token_id", "ts"], "left")
        .withColumn("_trend", trend)
        .join(wallets, "wallet", "left")
        .withColumns(
            {
                "is_tail": F.col("size_percentile") >= params.tail_percentile,
                "is_price_contrarian": F.col("price") < 0.5,
                "is_against_trend": against_trend,
                "is_against_ofi": against_flow,
                "is_contrarian": against_trend & against_flow,
                "outcome_won": F.col("outcome") == F.col("winning_outcome"),
                "wallet_age_us": F.unix_micros("ts") - F.unix_micros("first_seen_at"),
            }
        )
        .drop("_mean", "_trend")
    )


def contrarian_flag(mode: str) -> Column:
    """The column that says whether an event is contrarian in this mode."""
    return F.col({"price_only": "is_price_contrarian", "vs_trend": "is_against_trend", "vs_ofi": "is_against_ofi", "vs_both": "is_contrarian"}[mode])


def in_scope(f: EventFilter) -> Column:
    """Lookback, window and least notional: what every analysis starts from."""
    since = F.lit(f.as_of - timedelta(days=f.lookback_days)).cast("timestamp")
    return (F.col("end_date") > since) & (F.col("minutes_before_close") <= f.window_minutes) & (F.col("notional") >= f.min_notional)


def event_condition(f: EventFilter) -> Column:
    """The optional conditions. A null spread or upper z-score passes, a null lower z-score fails."""
    out = F.lit(True)
    if f.categories:
        out &= F.col("category").isin(*f.categories)
    if f.asymmetric_book:
        out &= F.coalesce("book_asymmetric", F.lit(False))
    if f.new_wallet:
        out &= F.coalesce(F.col("wallet_age_us") < 7 * 86_400_000_000, F.lit(False))
    if f.max_spread_bps is not None:
        out &= F.coalesce(F.col("spread_bps") <= f.max_spread_bps, F.lit(True))
    if f.ofi_trend_disagree:
        out &= F.coalesce(F.signum("ofi_30m") != F.signum("price_trend_30m"), F.lit(False))
    if f.outcome is not None:
        out &= F.col("outcome") == f.outcome
    if f.min_price is not None:
        out &= F.col("price") >= f.min_price
    if f.max_price is not None:
        out &= F.col("price") <= f.max_price
    if f.min_zscore is not None:
        out &= F.coalesce(F.col("size_zscore") >= f.min_zscore, F.lit(False))
    if f.max_zscore is not None:
        out &= F.coalesce(F.col("size_zscore") <= f.max_zscore, F.lit(True))
    if f.min_minutes is not None:
        out &= F.col("minutes_before_close") >= f.min_minutes
    return out


def filter_events(events: DataFrame, f: EventFilter) -> DataFrame:
    return events.where(in_scope(f) & event_condition(f))
