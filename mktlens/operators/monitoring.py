"""Drift of strategies against their baselines: z-tests, change points, health, recalibrated stakes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import folders
from . import scan
from .performance import event_metrics

WARNING, CRITICAL, LEAST = 1.5, 2.5, 20


def register_baselines(events: DataFrame, strategies: DataFrame) -> DataFrame:
    """Baseline metrics of each strategy (strategy_id, category, min_notional) over the events it takes."""
    taken = events.join(strategies, "category").where(F.col("notional") >= F.col("min_notional"))
    return event_metrics(taken, "strategy_id")


def drift_alerts(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """strategy_id, metric, expected, observed, sigma (signed), severity of what drifted; from 20 events on.

    The win rate's error is binomial; that of ROI and edge comes from the deviation of returns.
    """
    b = baseline.select("strategy_id", *(F.col(c).alias(f"e_{c}") for c in ("win_rate", "roi", "edge_points")))
    both = current.join(b, "strategy_id").where(F.col("n") >= LEAST)
    n = F.sqrt(F.col("n").cast("double"))
    errors = {"win_rate": F.sqrt(F.col("e_win_rate") * (1 - F.col("e_win_rate"))) / n, "roi": F.col("std_return") / n, "edge_points": F.col("std_return") * 100 / n}
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"e_{m}").alias("expected"), F.col(m).alias("observed"), e.alias("error")) for m, e in errors.items()))
    out = both.select("strategy_id", F.explode(rows).alias("x")).select("strategy_id", "x.*").withColumn("sigma", (F.col("observed") - F.col("expected")) / F.nullif(F.col("error"), F.lit(0.0)))
    severity = F.when(F.abs("sigma") >= CRITICAL, "critical").when(F.abs("sigma") >= WARNING, "warning")
    return out.withColumn("severity", severity).where("severity is not null").drop("error")


def health(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """strategy_id, alerts by severity, and healthy / degraded / critical / too few events."""
    alerts = drift_alerts(baseline, current).groupBy("strategy_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = current.select("strategy_id", "n").join(alerts, "strategy_id", "left").na.fill(0, ["critical", "warnings"])
    status = F.when(F.col("n") < LEAST, "insufficient").when(F.col("critical") > 0, "critical").when(F.col("warnings") > 0, "degraded").otherwise("healthy")
    return out.withColumn("status", status)


def rolling_win_rate(events: DataFrame, by: str, window: int = 10) -> DataFrame:
    """Win rate of the last `window` resolved events at each, of groups with twice as many.

    A group's events are counted up in segments, and averaged in blocks of places that overlap by a window.
    """
    resolved = events.where("outcome_won is not null").select(by, "ts", "trade_id", F.unix_micros("ts").alias("_us"), F.col("outcome_won").cast("double").alias("won"), F.lit(1).alias("_one"))
    rows = scan.by_rank(folders.cut(resolved), [by], "_us", F.count(F.lit(1)).alias("m")).where(F.col("m") >= 2 * window)
    rows = scan.in_blocks(scan.running_sum(rows, [by], ["_us", "trade_id"], "_one", "k"), "k", window - 1)
    last = Window.partitionBy(by, "_segment").orderBy("k").rowsBetween(1 - window, 0)
    rows = scan.own(rows.withColumn("win_rate", F.avg("won").over(last)))
    return rows.where(F.col("k") >= window - 1).select(by, "trade_id", "ts", (F.col("k") - (window - 1)).alias("k"), "win_rate")


def page_hinkley(series: DataFrame, by: str, x: str, place: str, drift: float = 0.01, threshold: float = 0.5) -> DataFrame:
    """Two-sided cumulative sums against the mean of the first third, and the first place over the threshold.

    place counts from 0. None below 5 values. A group's rows are scanned in segments; its size and
    the mean of its first third come from grouped sums.
    """
    series = folders.cut(series.select(by, place, x))
    rows = scan.by_rank(series, [by], place, F.count(F.lit(1)).alias("m")).where("m >= 5")
    target = rows.where(F.col(place) < F.floor(F.col("m") / 3)).groupBy(by).agg(F.avg(x).alias("target"))
    rows = rows.join(target, by, "left").withColumns({"_up": F.col(x) - F.col("target") - drift, "_down": F.col("target") - F.col(x) - drift})
    rows = scan.reflected_sums(rows, [by], [place], {"plus": "_up", "minus": "_down"})
    over = F.when((F.col("plus") > threshold) | (F.col("minus") > threshold), F.col(place))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(over).alias("change_at"), F.max("plus").alias("max_plus"), F.max("minus").alias("max_minus")).withColumn("changed", F.col("change_at").isNotNull())


def recalibrated_kelly(baseline: Column, win_rate: Column, n: Column, most: float = 0.5) -> Column:
    """Half of Kelly's fraction at even odds, within `most` of the baseline; the baseline itself below 20 events."""
    half = F.greatest(F.lit(0.0), win_rate - (1 - win_rate)) * 0.5
    return F.when(n < LEAST, baseline).otherwise(F.greatest(baseline * (1 - most), F.least(baseline * (1 + most), half)))


def performance_history(events: DataFrame, by: str, since: date) -> DataFrame:
    """For each strategy and day (days after `since`): that day's and the trailing seven days' trades, win rate and P&L."""
    day = F.datediff(F.to_date("ts"), F.lit(since))
    pnl = F.when(F.col("outcome_won"), F.col("notional") * (1 - F.col("price"))).otherwise(-F.col("notional") * F.col("price"))
    daily = events.where("outcome_won is not null").groupBy(by, day.alias("day")).agg(F.count(F.lit(1)).alias("trades"), F.count_if("outcome_won").alias("wins"), F.sum(pnl).alias("pnl"))
    week = Window.partitionBy(by).orderBy("day").rangeBetween(-6, 0)
    return daily.select(
        by, "day", "trades", "wins", "pnl", F.sum("trades").over(week).alias("trades_7d"), F.sum("pnl").over(week).alias("pnl_7d"), (F.sum("wins").over(week) / F.sum("trades").over(week)).alias("win_rate_7d")
    )
