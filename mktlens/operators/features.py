"""Features of trades, books and wallets, as windows over keyed time and as-of joins."""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.numeric import clamp, seconds_to_close, time_ramp
from ..sources import folders
from .events import MAD_SCALE
from .scan import by_rank, earlier, in_segments, local_window, own, reflected_sums, time_segment, with_carried

_MINUTE = 60_000_000


def _frame(minutes: float, *keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.unix_micros("ts")).rangeBetween(-int(minutes * _MINUTE), 0)


def _between(values: list[float], q: float) -> float:
    """The quantile q of ascending values, interpolated."""
    at = q * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (at - low) * (values[high] - values[low])


def _distance(values: list[float], middle: float, k: int) -> float:
    """The k-th smallest (from 0) distance of ascending values from `middle`: how many of the k + 1 nearest lie below is found by bisection."""
    cut = bisect.bisect_left(values, middle)
    low, high = max(0, k + 1 - (len(values) - cut)), min(cut, k + 1)
    while low < high:  # take i below and k + 1 - i at or above
        i = (low + high) // 2
        above = values[cut + k - i] - middle
        if middle - values[cut - i - 1] < above:
            low = i + 1
        else:
            high = i
    below = middle - values[cut - low] if low else -math.inf
    return max(below, values[cut + k - low] - middle if k + 1 > low else -math.inf)


def _order_statistics(least: float, most: int, frame_us: int):
    """For mapInArrow: statistics of each trade's frame, from rows in order of token, segment and time.

    A task holds the values of one frame, in order; each row costs a bisection or two.
    """
    names = ["token_id", "trade_id", "n_60m", "median_60m", "mad_60m", "q95_60m", "q99_60m", "below_60m", "trigger_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queue, values, pairs, waiting, out = None, deque(), [], [], [], []

        def settle() -> None:
            """Rows of one instant see each other, so they are told once all of them are in the frame."""
            if any(own for *_, own in waiting):
                n, middle = len(values), _between(values, 0.5)
                q95, q99, k = _between(values, 0.95), _between(values, 0.99), (len(values) - 1) // 2
                mad = (_distance(values, middle, k) + _distance(values, middle, n // 2)) / 2
                top = [i for v, i in reversed(pairs[-most:]) if v >= least and v >= q95]
                for token, trade, x, own in waiting:
                    if own:
                        out.append((token, trade, n, middle, mad, q95, q99, bisect.bisect_left(values, x), top))
            waiting.clear()

        now = None
        for batch in batches:
            for token, segment, us, trade, x, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (token, segment) != group or us != now:
                    settle()
                    if (token, segment) != group:
                        group, values, pairs = (token, segment), [], []
                        queue.clear()
                    now = us
                    while queue and queue[0][0] < us - frame_us:
                        _, i, v = queue.popleft()
                        del values[bisect.bisect_left(values, v)]
                        del pairs[bisect.bisect_left(pairs, (v, i))]
                queue.append((us, trade, x))
                bisect.insort(values, x)
                bisect.insort(pairs, (x, trade))
                waiting.append((token, trade, x, own))
            yield _batch(out)
            out.clear()
        settle()
        yield _batch(out)

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.list_(pa.int64())]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def frame_statistics(trades: DataFrame, minutes: int = 60, least: float = 5000.0, most: int = 3) -> DataFrame:
    """token_id, trade_id and order statistics of the token's trades in the last hour, the trade itself included.

    Number, median, median deviation, upper quantiles, trades with a smaller notional, and the ids of
    the `most` highest ones that are `least` or more and in the upper twentieth. A token's trades are
    dealt by segments of time; null notionals take no part.
    """
    us = F.unix_micros("ts")
    rows = in_segments(trades.where("notional is not null").select("token_id", "trade_id", "ts", "notional"), us, minutes * 60)
    rows = rows.select("token_id", "_segment", us.alias("_us"), "trade_id", "notional", "_own").repartition("token_id", "_segment").sortWithinPartitions("token_id", "_segment", "_us", "trade_id")
    schema = "token_id string, trade_id long, n_60m long, median_60m double, mad_60m double, q95_60m double, q99_60m double, below_60m long, trigger_ids array<long>"
    return rows.mapInArrow(_order_statistics(least, most, int(minutes * _MINUTE)), schema)


def rolling_size(trades: DataFrame, minutes: int = 60) -> DataFrame:
    """Each trade against its token's last hour, itself included: n, median, MAD, quantiles, robust z, percentile.

    Below 5 trades the neutral record; z is 0 below 10, and null where MAD is 0.
    """
    rows = trades.join(frame_statistics(trades, minutes).drop("trigger_ids"), ["token_id", "trade_id"], "left").withColumn("n_60m", F.coalesce("n_60m", F.lit(0)))
    z = (F.col("notional") - F.col("median_60m")) / (MAD_SCALE * F.nullif(F.col("mad_60m"), F.lit(0.0)))
    return rows.withColumns(
        {
            "robust_z": F.when(F.col("n_60m") < 10, F.lit(0.0)).otherwise(z),
            "percentile": F.when(F.col("n_60m") < 5, F.lit(50.0)).otherwise(F.col("below_60m") / F.col("n_60m") * 100),
        }
    ).drop("below_60m")


def trade_pace(trades: DataFrame) -> DataFrame:
    """Trades of the token in the last 1 and 5 minutes, and mean and least gap in seconds within the last 5.

    A gap longer than 5 minutes counts nowhere, so all that matters to a trade is in its segment.
    """
    us = F.unix_micros("ts")
    key = ["token_id", "_segment"]
    rows = in_segments(trades, us, 600)
    rows = rows.withColumn("_gap", (us - F.lag(us).over(Window.partitionBy(*key).orderBy("ts", "trade_id"))) / 1e6)
    inside, five = F.when(F.col("_gap") <= 300, F.col("_gap")), _frame(5, *key)
    rows = rows.withColumns({"trades_1m": F.count(F.lit(1)).over(_frame(1, *key)), "trades_5m": F.count(F.lit(1)).over(five), "avg_gap": F.avg(inside).over(five), "min_gap": F.min(inside).over(five)})
    return own(rows).drop("_gap")


def hawkes_intensity(trades: DataFrame, base: float = 0.1, jump: float = 0.5, decay: float = 0.1, reach_s: int = 400) -> DataFrame:
    """Intensity of the token at each trade, from the trades of the last `reach_s` seconds at least; older terms are below e**-40.

    A sum of exp(-decay * (t - s)) over trades s before t is exp(-decay * t) times a running sum of
    exp(decay * s), with times from the start of a short block, where neither gets large. Each
    block's sum at its end goes on to the blocks that it still reaches, by their distance.
    """
    us, keys = F.unix_micros("ts"), ["token_id"]
    width = max(1, reach_s // 4)
    rows = trades.withColumn("_segment", time_segment(us, width))
    grown = F.exp(decay * (us / 1e6 - F.col("_segment") * width))
    running = F.sum(grown).over(Window.partitionBy(*keys, "_segment").orderBy(us).rangeBetween(Window.unboundedPreceding, 0))
    ahead = -(-reach_s // width)
    ends = rows.groupBy(*keys, "_segment").agg((F.sum(grown) * F.exp(F.lit(-decay * width))).alias("_end"))
    later = ends.select(*keys, "_segment", "_end", F.explode(F.sequence(F.lit(0), F.lit(ahead - 1))).alias("_gap"))
    carried = later.groupBy(*keys, (F.col("_segment") + 1 + F.col("_gap")).alias("_segment")).agg(F.sum(F.col("_end") * F.exp(-decay * width * F.col("_gap"))).alias("_before"))
    value = (F.col("_here") + F.coalesce("_before", F.lit(0.0))) / grown
    out = rows.withColumn("_here", running).join(carried, [*keys, "_segment"], "left").withColumn("intensity", base + jump * value)
    ratio = F.col("intensity") / base
    return out.withColumns({"intensity_ratio": ratio, "burst": ratio > 2, "burst_score": clamp((ratio - 1) / 4)}).select(*trades.columns, "intensity", "intensity_ratio", "burst", "burst_score")


def cusum(series: DataFrame, key: str, order: str, x: str, threshold: float = 5.0) -> DataFrame:
    """key, n, statistic at the end, first place over the threshold (from 1), score, direction.

    Each value is standardised by the mean and deviation so far; the statistic is S = max(0, S + z).
    A key's rows are scanned in segments. Sums are of differences from its first value, so that the
    deviation of values that have all been equal is 0.
    """
    anchor = F.min_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias("_anchor")
    series = folders.cut(series.select(key, order, x))
    rows = by_rank(series, [key], order, anchor).withColumn("_y", F.col(x) - F.col("_anchor")).withColumn("_yy", F.col("_y") * F.col("_y"))
    w, before = local_window([key], [order]), earlier([key])
    sums = {"n": F.count(x), "y": F.sum("_y"), "yy": F.sum("_yy")}
    local = rows.withColumns({f"_here_{k}": c.over(w) for k, c in sums.items()})
    rows = with_carried(local, [key], [c.alias(f"_in_{k}") for k, c in sums.items()], {f"_before_{k}": F.sum(f"_in_{k}").over(before) for k in sums})
    n, total, squares = (F.coalesce(f"_here_{k}", F.lit(0)) + F.coalesce(f"_before_{k}", F.lit(0)) for k in sums)
    rows = rows.withColumns({"_n": n, "_mean": F.try_divide(total, n), "_dev": F.sqrt(F.greatest(F.lit(0.0), F.try_divide(squares - total * F.try_divide(total, n), n - 1)))})
    z = F.when((F.col("_n") >= 2) & (F.col("_dev") > 1e-12), (F.col("_y") - F.col("_mean")) / F.col("_dev")).otherwise(0.0)
    rows = reflected_sums(rows.withColumn("_z", z), [key], [order], {"_s": "_z"})
    out = rows.groupBy(key).agg(
        F.max("_n").alias("n"), F.max_by("_s", "_n").alias("statistic"), F.min(F.when(F.col("_s") > threshold, F.col("_n"))).alias("change_at"), F.max_by(x, "_n").alias("_last"), F.avg(x).alias("_all")
    )
    direction = F.when(F.col("statistic") < 2, "none").when(F.col("_last") > F.col("_all"), "increase").otherwise("decrease")
    return out.withColumn("score", clamp(F.col("statistic") / threshold)).withColumn("direction", direction).drop("_last", "_all")


def book_metrics(levels: DataFrame) -> DataFrame:
    """One row for each snapshot: best prices, mid, spread, depths, imbalances, thin side, scores.

    Depth is the sum of the 5 % and the 10 % band; depth_10 is the plain one. Books with an empty
    side have null mid and no band depth. A book's levels meet in one aggregate as two short arrays,
    so that no window sorts all levels of a task again.
    """
    keys = ["snapshot_id", "ts", "token_id", "condition_id", "category"]
    bid, price = F.col("is_bid"), F.col("price")
    side = lambda c, order: F.sort_array(F.collect_list(F.when(c, F.struct(order.alias("order"), "price", "size"))))
    rows = levels.groupBy(*keys).agg(
        F.max(F.when(bid, price)).alias("best_bid"), F.min(F.when(~bid, price)).alias("best_ask"), side(bid, -price).alias("_bids"), side(~bid, price).alias("_asks"), F.sum("size").alias("total_size")
    )
    rows = rows.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
    total = lambda side: F.aggregate(side, F.lit(0.0), lambda sum_, level: sum_ + F.coalesce(level["size"].cast("double"), F.lit(0.0)))
    near = lambda side, part: total(F.filter(side, lambda level: F.abs(level["price"] - F.col("mid")) <= F.col("mid") * part + 1e-9))
    out = rows.withColumns({f"{name}_{part}": near(f"_{name}s", part / 100) for part in (5, 10) for name in ("bid", "ask")})
    out = out.withColumns({f"{name}_top5": total(F.slice(f"_{name}s", 1, 5)) for name in ("bid", "ask")}).drop("_bids", "_asks")
    return S.with_book_features(out)


def as_of_book(trades: DataFrame, books: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each trade with the last book of its token at or before it (null: none), without a range join.

    Both sides are stacked and the last book is carried forward, within segments of time first and
    then from segment to segment, so that a token's rows are many tasks' work. Books and trades of
    one instant: the book counts.
    """
    book = F.struct("snapshot_id", *columns)
    left = trades.select("token_id", "ts", F.lit(1).alias("_kind"), F.struct(*trades.columns).alias("_trade"), F.lit(None).cast(books.select(book.alias("b")).schema["b"].dataType).alias("_book"))
    right = books.select("token_id", "ts", F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_trade"].dataType).alias("_trade"), book.alias("_book"))
    keys = ["token_id"]
    stacked = left.unionByName(right).withColumn("_segment", time_segment(F.unix_micros("ts")))
    here = F.last("_book", ignorenulls=True).over(local_window(keys, ["ts", "_kind", F.col("_book.snapshot_id")]))
    latest = F.max_by("_book", F.when(F.col("_kind") == 0, F.struct("ts", F.col("_book.snapshot_id")))).alias("_latest")
    out = with_carried(stacked.withColumn("_here", here), keys, [latest], {"_before": F.last("_latest", ignorenulls=True).over(earlier(keys))})
    out = out.where("_kind = 1").withColumn("_last", F.coalesce("_here", "_before"))
    return out.select("_trade.*", *(F.col(f"_last.{c}").alias(f"book_{c}" if c == "ts" else c) for c in ("snapshot_id", *columns)))


def post_trade_impact(trades: DataFrame, books: DataFrame, horizons: tuple[int, ...] = (30, 60)) -> DataFrame:
    """How the mid moves after a trade: signed drift, score and whether it is confirmed, for each horizon in seconds.

    mid_before is that of the last book at or before the trade, mid_<s>s that of the last one within
    s seconds after it (null: none came). impact is the drift at the longest horizon that has one.
    Of books of one instant the largest snapshot_id counts, before and after alike.
    """
    before = as_of_book(trades.select("trade_id", "token_id", "ts", "side"), books.where("mid is not null"), ("mid",)).withColumnRenamed("mid", "mid_before")
    tagged = before.select("trade_id", "token_id", "ts", "side", "mid_before", F.lit(None).cast("long").alias("snapshot_id"), F.lit(None).cast("double").alias("mid"))
    quotes = books.where("mid is not null").select(F.lit(None).cast("long").alias("trade_id"), "token_id", "ts", F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("mid_before"), "snapshot_id", "mid")
    us = F.unix_micros("ts")
    both = in_segments(tagged.unionByName(quotes), us, 0, max(horizons))
    known = F.max(F.when(F.col("mid").isNotNull(), F.struct(us.alias("u"), "snapshot_id", "mid")))
    w = Window.partitionBy("token_id", "_segment").orderBy(us)
    rows = own(both.withColumns({f"mid_{s}s": known.over(w.rangeBetween(1, s * 1_000_000))["mid"] for s in horizons})).where("trade_id is not null")
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    drift = {s: sign * (F.col(f"mid_{s}s") - F.col("mid_before")) / F.nullif(F.col("mid_before"), F.lit(0.0)) for s in horizons}
    rows = rows.withColumns({f"drift_{s}s": x for s, x in drift.items()}).withColumn("impact", F.coalesce(*(F.col(f"drift_{s}s") for s in sorted(horizons, reverse=True))))
    mids = ("mid_before", *(f"mid_{s}s" for s in horizons))
    return rows.select("trade_id", *mids, *(f"drift_{s}s" for s in horizons), clamp(F.abs("impact") / 0.05).alias("impact_score"), F.coalesce(F.col("impact") > 0.01, F.lit(False)).alias("confirmed"))


def with_wallet(trades: DataFrame, wallets: DataFrame) -> DataFrame:
    """Trades with wallet age and scores; unknown wallets are neutral in age and count as inactive."""
    joined = trades.join(wallets, "wallet", "left")
    days = (F.unix_micros("ts") - F.unix_micros("first_seen_at")) / 86_400_000_000.0
    out = joined.withColumn("wallet_age_days", days).withColumn("wallet_new_score", S.wallet_age_score(F.col("wallet_age_days")))
    out = out.withColumn("wallet_activity_score", S.activity_from_transactions(F.coalesce("transaction_count", F.lit(0))))
    return out.withColumn("wallet_risk", S.wallet_risk(F.col("wallet_new_score"), F.col("wallet_activity_score"))).withColumn("wallet_age_text", S.wallet_age_text(F.col("wallet_age_days")))


def with_close(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Trades with seconds to the close, its ramp and the no-trade zone; unknown markets have ramp 1 and no zone."""
    joined = trades.join(markets.select("condition_id", "end_date"), "condition_id", "left").withColumn("seconds_to_close", seconds_to_close("ts", "end_date"))
    return joined.withColumn("ramp", time_ramp(F.col("seconds_to_close") / 3600)).withColumn("in_no_trade_zone", F.coalesce(F.col("seconds_to_close") <= 120, F.lit(False)))


def feature_vectors(trades: DataFrame, books: DataFrame, wallets: DataFrame, markets: DataFrame) -> DataFrame:
    """All features of each trade; books as book_metrics() gives them."""
    cols = ("mid", "best_bid", "best_ask", "spread_bps", "bid_depth", "ask_depth", "imbalance", "book_imbalance_score", "thin_ratio", "thin_opposite_score")
    rows = as_of_book(hawkes_intensity(rolling_size(trades)), books.where("mid is not null"), cols)
    rows = with_close(with_wallet(rows, wallets), markets)
    tail = S.size_tail_score(F.col("percentile"), F.col("notional"))
    return rows.withColumns(
        {"size_tail_score": F.when(F.col("n_60m") < 5, F.lit(0.0)).otherwise(tail), "is_large": F.coalesce((F.col("robust_z") > 3) | (F.col("percentile") > 99), F.lit(False)) & (F.col("n_60m") >= 5)}
    )


def highest_trade(trades: DataFrame, minutes: int = 60, least: float = 500.0) -> DataFrame:
    """Each trade with the id and notional of the token's highest one in the last hour, from `least` on.

    An hour is the end of the segments before a trade's own, and what of its own is past. Both are
    growing frames, one of them back in time, to which Spark adds row by row.
    """
    us, keys = F.unix_micros("ts"), ("token_id", "_segment")
    rows = in_segments(trades, us, minutes * 60, seconds=minutes * 60)  # a segment is no longer than a frame
    large, first = F.when(F.col("notional") >= least, F.struct("notional", F.col("trade_id"))), Window.unboundedPreceding
    here = F.max(F.when(F.col("_own"), large)).over(Window.partitionBy(*keys).orderBy(us).rangeBetween(first, 0))
    rows = rows.withColumn("_before", F.max(F.when(~F.col("_own"), large)).over(Window.partitionBy(*keys).orderBy(-us).rangeBetween(first, int(minutes * _MINUTE))))
    top = F.greatest(F.col("_here"), F.col("_before"))
    return own(rows.withColumn("_here", here).withColumns({"top_trade_id": top["trade_id"], "top_notional": top["notional"]}).drop("_here", "_before"))


def triggering_trades(trades: DataFrame, minutes: int = 60, least: float = 5000.0, most: int = 3) -> DataFrame:
    """The ids of the token's highest trades in the last hour that are large and in the frame's upper twentieth."""
    return trades.join(frame_statistics(trades, minutes, least, most).select("token_id", "trade_id", "trigger_ids"), ["token_id", "trade_id"], "left")


def ema(df: DataFrame, key: str, order: str, x: str, alpha: float = 0.2) -> DataFrame:
    """Exponential moving average at the end of each group, from its first value on: a sum with weights that fall from the last row back.

    Rows of a segment are weighted from its end, and the segment's sum by the rows behind it. Rows of
    one place count in the order of x.
    """
    w = Window.partitionBy(key, "_segment").orderBy(F.desc(order), F.desc(x))
    rows = by_rank(df.select(key, order, x), [key], order).withColumn("_back", F.row_number().over(w) - 1)
    falling = lambda n: F.pow(F.lit(1 - alpha), n)
    each = rows.groupBy(key, "_segment").agg(F.count(F.lit(1)).alias("_m"), F.sum(alpha * falling(F.col("_back")) * F.col(x)).alias("_sum"), F.min(F.struct(F.col(order).alias("at"), F.col(x).alias("x"))).alias("_first"))
    behind = F.coalesce(F.sum("_m").over(Window.partitionBy(key).orderBy(F.desc("_segment")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = each.withColumn("_behind", behind).groupBy(key).agg(F.sum("_m").alias("n"), F.sum(falling(F.col("_behind")) * F.col("_sum")).alias("ema"), F.min("_first").alias("_first"))
    # the first value counts in full
    return out.select(key, F.col("n").cast("int").alias("n"), (F.col("ema") + F.coalesce(falling(F.col("n")) * F.col("_first.x"), F.lit(0.0))).alias("ema"))


def bars(trades: DataFrame, minutes: int) -> DataFrame:
    """OHLC, volumes, VWAP, size statistics (with the median deviation in a second pass), pace and wallets of each token and window.

    mean_gap_us is null for a single trade. Trades name one wallet, the taker.
    """
    bucket = F.floor(F.unix_micros("ts") / F.lit(minutes * _MINUTE)).cast("long")
    buy = F.col("side") == "BUY"
    order = F.struct("ts", "trade_id")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("notional"))), F.lit(0.0))
    trades = trades.withColumn("bucket", bucket)
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    out = trades.groupBy("token_id", "bucket").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(buy).alias("buys"), total(buy).alias("buy_volume"), total(~buy).alias("sell_volume"),
        (F.sum(F.col("price") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0.0))).alias("vwap"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.percentile("notional", F.lit(0.5)).alias("median_size"), F.percentile("notional", F.lit(0.95)).alias("q95_size"),
        F.percentile("notional", F.lit(0.99)).alias("q99_size"), (F.count(F.lit(1)) / F.lit(float(minutes))).alias("trades_per_minute"), (span / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("mean_gap_us"),
        F.count_distinct("wallet").alias("wallets"),
    )
    key = ["token_id", "bucket"]
    away = trades.select(*key, "notional").join(out.select(*key, "median_size"), key).groupBy(*key).agg(F.percentile(F.abs(F.col("notional") - F.col("median_size")), F.lit(0.5)).alias("mad_size"))
    return out.join(away, key).withColumn("imbalance", (F.col("buy_volume") - F.col("sell_volume")) / F.nullif(F.col("buy_volume") + F.col("sell_volume"), F.lit(0.0)))
