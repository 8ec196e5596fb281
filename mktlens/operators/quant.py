"""Order-flow statistics: volume buckets, clustering, bursts, first digits, decay, price impact."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import chi2_p_value, clamp
from ..sources.folders import cut
from .buckets import volume_buckets
from .order import placed, value_counts
from .performance import event_metrics, won

#: Bounds in minutes of the decay buckets.
DECAY_BUCKETS = ((0, 10), (10, 20), (20, 30), (30, 45), (45, 60), (60, 90), (90, 120))


def vpin(events: DataFrame, by: str, size: float = 50_000.0) -> DataFrame:
    """Mean imbalance of the volume buckets, their number and volume, and a level."""
    total = F.col("buy") + F.col("sell")
    out = volume_buckets(events, by, size).groupBy(by).agg(
        F.avg(F.abs(F.col("buy") - F.col("sell")) / F.nullif(total, F.lit(0.0))).alias("vpin"), F.count(F.lit(1)).alias("buckets"), F.avg(total).alias("avg_volume")
    )
    return out.withColumn("level", F.when(F.col("vpin") > 0.5, "high").when(F.col("vpin") > 0.3, "medium").otherwise("low"))


def hawkes_moments(events: DataFrame, by: str, half_life_ms: float = 300_000.0, least: int = 10) -> DataFrame:
    """Rate per hour, decay, excitation and branching from the variation of gaps; zeros below `least` events."""
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy(by).orderBy("ts", "trade_id"))) / 1000.0
    summed = events.select(by, "ts", gap.alias("gap")).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000.0).alias("span"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("dev")
    )
    beta = math.log(2) / half_life_ms
    score = clamp((F.col("dev") / F.nullif(F.col("mean"), F.lit(0.0)) - 1) / 2)
    zero = F.lit(0.0)
    enough = F.col("n") >= least
    return summed.select(
        by,
        "n",
        F.when(enough, F.coalesce(F.col("n") / F.nullif(F.col("span"), zero) * 3_600_000, zero)).otherwise(zero).alias("rate_per_hour"),
        F.when(enough, F.coalesce(score, zero)).otherwise(zero).alias("clustering"),
        F.when(enough, F.coalesce(score * beta, zero)).otherwise(zero).alias("alpha"),
        F.when(enough, F.coalesce(score, zero)).otherwise(zero).alias("branching"),
    )


def burst_periods(trades: DataFrame, by: str, factor: float = 3.0) -> DataFrame:
    """Maximal runs of 5-minute windows, stepped by a minute, with over `factor` times the group's rate.

    by, start and end of the run (minutes), and the distinct trades in it. A run at the end counts.
    """
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    per = trades.groupBy(by, minute.alias("m")).agg(F.count(F.lit(1)).alias("k"))
    rate = per.groupBy(by).agg((F.sum("k") / (F.max("m") - F.min("m") + 1)).alias("rate"))
    windows = per.select(by, "k", F.explode(F.sequence(F.col("m") - 4, F.col("m"))).alias("w")).groupBy(by, "w").agg(F.sum("k").alias("n"))
    hot = windows.join(rate, by).where(F.col("n") / 5 > factor * F.col("rate"))
    order = Window.partitionBy(by).orderBy("w")
    island = F.col("w") - F.row_number().over(order)
    runs = hot.withColumn("island", island).groupBy(by, "island").agg(F.min("w").alias("first"), (F.max("w") + 5).alias("past"))
    inside = per.alias("p").join(runs.alias("r"), (F.col(f"p.{by}") == F.col(f"r.{by}")) & (F.col("m") >= F.col("first")) & (F.col("m") < F.col("past")))
    return inside.groupBy(F.col(f"r.{by}").alias(by), "first", "past").agg(F.sum("k").alias("trades"))


def benford(events: DataFrame) -> DataFrame:
    """digit, observed and expected share, deviation in percent; with chi2 and p of the whole on each row; none below 30."""
    whole = F.floor(F.col("notional") + 0.5).cast("long")
    digits = events.select(whole.alias("v")).where("v > 0").select(F.substring(F.col("v").cast("string"), 1, 1).cast("int").alias("digit"))
    counts = digits.groupBy("digit").agg(F.count(F.lit(1)).alias("m"))
    all_digits = events.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"), F.log10(1 + 1 / F.col("id")).alias("expected"))
    whole_ = Window.partitionBy()  # over nine rows
    out = all_digits.join(counts, "digit", "left").na.fill(0, ["m"]).withColumn("total", F.sum("m").over(whole_))
    off = F.col("m") - F.col("expected") * F.col("total")
    out = out.withColumn("chi2", F.sum(off * off / F.nullif(F.col("expected") * F.col("total"), F.lit(0.0))).over(whole_))
    observed = F.col("m") / F.col("total")
    return out.where("total >= 30").select(
        "digit", observed.alias("observed"), "expected", ((observed - F.col("expected")) / F.col("expected") * 100).alias("deviation"), "chi2", chi2_p_value("chi2", F.lit(8.0)).alias("p_value")
    )


def time_decay(events: DataFrame) -> DataFrame:
    """Metrics by minutes before the close, the best bucket (10 events or more), and the decay of ln(edge) with time."""
    m = F.col("minutes_before_close")
    bucket = F.coalesce(*(F.when((m >= lo) & (m < hi), F.lit(lo)) for lo, hi in DECAY_BUCKETS))
    rows = event_metrics(events.where(won().isNotNull()).withColumn("from_minute", bucket).where("from_minute is not null"), "from_minute")
    until = F.coalesce(*(F.when(F.col("from_minute") == lo, F.lit(hi)) for lo, hi in DECAY_BUCKETS))
    rows = rows.withColumn("to_minute", until).select("from_minute", "to_minute", "n", "win_rate", "avg_price", "pnl", "roi", "edge_points")
    few = Window.partitionBy()  # over seven rows
    usable = (F.col("n") >= 5) & (F.col("edge_points") > 0)
    x, y = F.when(usable, (F.col("from_minute") + F.col("to_minute")) / 2), F.when(usable, F.log("edge_points"))
    slope = F.when(F.count(y).over(few) >= 3, F.greatest(F.lit(0.0), -F.regr_slope(y, x).over(few))).otherwise(0.0)
    best = F.max(F.when(F.col("n") >= 10, F.struct(F.round("edge_points", 9).alias("e"), (-F.col("from_minute")).alias("f")))).over(few)
    return rows.withColumn("decay", slope).withColumn("is_best", F.coalesce(best["f"] == -F.col("from_minute"), F.lit(False)))


def kyle_lambda(events: DataFrame, by: str) -> DataFrame:
    """Slope of signed 30-minute drift on the root of notional; r2 of the slope alone, and of the fitted line; from 20 events on."""
    rows = events.where(F.col("drift_30m").isNotNull()).select(by, F.sqrt("notional").alias("x"), F.when(F.col("outcome") == "Yes", F.col("drift_30m")).otherwise(-F.col("drift_30m")).alias("y"))
    c = F.col
    s = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), (F.covar_pop("x", "y") / F.nullif(F.var_pop("x"), F.lit(0.0))).alias("slope"), F.regr_r2("y", "x").alias("regr_r2"), F.sum(c("x") * c("x")).alias("xx"), F.sum(c("x") * c("y")).alias("xy"),
        F.sum(c("y") * c("y")).alias("yy"), F.sum("y").alias("ys"),
    )
    rest = c("yy") - 2 * c("slope") * c("xy") + c("slope") * c("slope") * c("xx")
    total = c("yy") - c("ys") * c("ys") / c("n")
    return s.where("n >= 20").select(by, "n", F.abs("slope").alias("lambda"), F.greatest(F.lit(0.0), 1 - rest / F.nullif(total, F.lit(0.0))).alias("r2"), "regr_r2")


def impact_by_size(events: DataFrame, by: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Mean signed drift of the ten events before and after each size quantile, of groups with 20 events or more.

    Places are counted over distinct sizes; only the events at a size near a quantile are ordered.
    """
    rows = events.where(F.col("drift_30m").isNotNull()).select(by, "trade_id", "notional", F.when(F.col("outcome") == "Yes", F.col("drift_30m")).otherwise(-F.col("drift_30m")).alias("y"))
    rows = cut(rows)
    sizes = placed(value_counts(rows, (by,), "notional"), (by,), "notional").where("total >= 20")
    middle = lambda q: F.floor(q * F.col("total"))
    touched = lambda q: F.when((F.col("below") < middle(q) + 10) & (F.col("below") + F.col("m") > middle(q) - 10), F.lit(q))
    near = sizes.withColumn("quantile", F.explode(F.array_compact(F.array(*map(touched, quantiles))))).select(by, "notional", "quantile", "below", "total")
    at = F.col("below") + F.row_number().over(Window.partitionBy(by, "quantile", "notional").orderBy("trade_id")) - 1
    found = rows.join(near, [by, "notional"]).withColumn("_k", at).where((F.col("_k") >= F.floor(F.col("quantile") * F.col("total")) - 10) & (F.col("_k") < F.floor(F.col("quantile") * F.col("total")) + 10))
    return found.groupBy(by, "quantile").agg(F.avg("y").alias("avg_impact"), F.count(F.lit(1)).alias("n"))


def signal_groups(events: DataFrame, least: int = 10, most: int = 5) -> DataFrame:
    """The best groups of signals by win rate: against the flow, 10 to 60 minutes before the close, first digit 2 to 4."""
    m = F.col("minutes_before_close")
    first = F.substring(F.floor(F.col("notional") + 0.5).cast("string"), 1, 1)
    groups = F.array_compact(F.array(F.when(F.col("is_against_ofi"), "vs_ofi"), F.when((m >= 10) & (m <= 60), "10-60m"), F.when(first.isin("2", "3", "4"), "digit 2-4")))
    out = event_metrics(events.where(won().isNotNull()).withColumn("group", F.explode(groups)), "group").where(F.col("n") >= least)
    return out.orderBy(F.desc("win_rate"), "group").limit(most).select("group", "n", "win_rate", "avg_price", "pnl", "roi")


def report(events: DataFrame, by: str, incremental: bool = False) -> DataFrame:
    """name, key, value of all measures (only flow and clustering if incremental); the events are worked out once."""
    events = cut(events)
    parts = [
        vpin(events, by).select(F.lit("vpin").alias("name"), F.col(by).alias("key"), F.col("vpin").alias("value")),
        hawkes_moments(events, by).select(F.lit("branching").alias("name"), F.col(by).alias("key"), F.col("branching").alias("value")),
    ]
    if not incremental:
        parts += [
            kyle_lambda(events, by).select(F.lit("kyle_lambda").alias("name"), F.col(by).alias("key"), F.col("lambda").alias("value")),
            benford(events).select(F.lit("benford").alias("name"), F.col("digit").cast("string").alias("key"), F.col("observed").alias("value")),
            time_decay(events).select(F.lit("edge").alias("name"), F.col("from_minute").cast("string").alias("key"), F.col("edge_points").alias("value")),
            signal_groups(events).select(F.lit("win_rate").alias("name"), F.col("group").alias("key"), F.col("win_rate").alias("value")),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
