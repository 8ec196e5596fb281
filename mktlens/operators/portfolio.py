"""Positions and results: ledgers, totals, running bankroll and drawdown, fills against book levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import position_pnl
from .scan import earlier, local_window, with_carried

#: Ids in a segment of a scan over closed positions.
SEGMENT_IDS = 65_536


def positions_of(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Buys as positions of `size` shares; closed at 1 or 0 where the market has a winner."""
    rows = trades.where("side = 'BUY'").join(markets.select("condition_id", "end_date", "winning_outcome"), "condition_id")
    exit_price = F.when(F.col("winning_outcome").isNotNull(), F.when(F.col("outcome") == F.col("winning_outcome"), 1.0).otherwise(0.0))
    out = rows.select("trade_id", "token_id", "category", F.upper("outcome").alias("side"), F.col("price").alias("entry"), "size", "notional", "ts", F.col("end_date").alias("exit_ts"), exit_price.alias("exit_price"))
    return out.withColumn("pnl", F.when(F.col("exit_price").isNotNull(), position_pnl(F.lit("YES"), "entry", "exit_price", "size")))


def totals(positions: DataFrame) -> DataFrame:
    """Count, notional and P&L by side, and of all (side 'ALL')."""
    out = positions.rollup("side").agg(F.count(F.lit(1)).alias("n"), F.sum("notional").alias("notional"), F.sum("pnl").alias("pnl"))
    return out.withColumn("side", F.coalesce("side", F.lit("ALL")))


def summary(closed: DataFrame) -> DataFrame:
    """One row for closed positions: wins, losses, averages, profit factor, Sharpe (population deviation, from 5 on)."""
    p, zero = F.col("pnl"), F.lit(0.0)
    s = closed.where(p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.sum(p).alias("realized"), F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"),
        F.coalesce(F.sum(F.when(p > 0, p)), zero).alias("gain"), F.coalesce(-F.sum(F.when(p < 0, p)), zero).alias("loss"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("dev"),
    )
    sharpe = F.when(F.col("n") >= 5, F.coalesce(F.col("mean") / F.nullif(F.col("dev"), zero), zero)).otherwise(0.0)
    return s.select("n", "wins", "losses", "realized", "avg_win", "avg_loss", (F.col("gain") / F.nullif(F.col("loss"), zero)).alias("profit_factor"), (F.col("wins") / F.col("n")).alias("win_rate"), sharpe.alias("sharpe"))


def daily_pnl(closed: DataFrame) -> DataFrame:
    return closed.where("pnl is not null").groupBy(F.to_date("exit_ts").alias("day")).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n"))


def running(closed: DataFrame, key: str, start: float = 10_000.0) -> DataFrame:
    """Bankroll, peak, drawdown (also the worst so far) and losses in a row after each close of a key's positions.

    Positions are in order of exit, then of id, and are scanned in segments of both; three rounds, as
    a peak needs the bankroll and the worst drawdown the peaks of what came before.
    """
    keys = [key]
    here, up = local_window(keys, ["exit_ts", "trade_id"]), earlier(keys)
    lost, nothing = (F.col("pnl") < 0).cast("long"), F.lit(0)
    rows = closed.where("pnl is not null").withColumn("_segment", F.struct("exit_ts", F.floor(F.col("trade_id") / F.lit(SEGMENT_IDS)).alias("part")))
    rows = rows.withColumns({"_sum": F.sum("pnl").over(here), "_losses": F.sum(lost).over(here)})
    rows = with_carried(rows, keys, [F.sum("pnl").alias("_total"), F.sum(lost).alias("_lost")], {"_pnl": F.sum("_total").over(up), "_gone": F.sum("_lost").over(up)})
    rows = rows.withColumns({"bankroll": start + F.coalesce("_pnl", nothing) + F.col("_sum"), "_losses": F.col("_losses") + F.coalesce("_gone", nothing)})
    # losses are never fewer later on, so the most at any win so far are those at the last win
    rows = rows.withColumn("_at_win", F.when(F.col("pnl") >= 0, F.col("_losses")))
    rows = rows.withColumns({"_high": F.max("bankroll").over(here), "_won": F.max("_at_win").over(here)})
    rows = with_carried(rows, keys, [F.max("bankroll").alias("_most"), F.max("_at_win").alias("_last")], {"_before": F.max("_most").over(up), "_earlier": F.max("_last").over(up)})
    rows = rows.withColumns({"peak": F.greatest(F.lit(start), "_high", "_before"), "losses_in_row": F.col("_losses") - F.coalesce(F.greatest("_won", "_earlier"), nothing)})
    rows = rows.withColumn("drawdown", (F.col("peak") - F.col("bankroll")) / F.col("peak")).withColumn("_worst", F.max("drawdown").over(here))
    rows = with_carried(rows, keys, [F.max("drawdown").alias("_most")], {"_deepest": F.max("_most").over(up)})
    return rows.withColumn("max_drawdown", F.greatest("_worst", "_deepest")).select(*closed.columns, "bankroll", "peak", "drawdown", "max_drawdown", "losses_in_row")


def exposure_series(positions: DataFrame, key: str, start: float = 10_000.0) -> DataFrame:
    """Open notional and bankroll of each key after each day."""
    opened = positions.select(key, F.to_date("ts").alias("day"), F.col("notional").alias("exposure"), F.lit(0.0).alias("pnl"))
    closed = positions.where("pnl is not null").select(key, F.to_date("exit_ts").alias("day"), (-F.col("notional")).alias("exposure"), "pnl")
    days = opened.unionByName(closed).groupBy(key, "day").agg(F.sum("exposure").alias("e"), F.sum("pnl").alias("p"))
    w = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(key, "day", F.sum("e").over(w).alias("exposure"), (start + F.sum("p").over(w)).alias("bankroll"))


def ledger(positions: DataFrame) -> DataFrame:
    """Size and exposure of open positions, and closed P&L, of each token."""
    open_ = F.col("pnl").isNull()
    total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0.0))
    return positions.groupBy("token_id").agg(total(open_, "size").alias("open_size"), total(open_, "notional").alias("exposure"), total(~open_, "pnl").alias("closed_pnl"), F.count_if(open_).alias("open_positions"))


def risk_breakdown(ledger_: DataFrame, bankroll: float = 1_000_000.0, most: float = 0.10) -> DataFrame:
    """Each exposed token's share of the bankroll, and the room left to the whole's limit."""
    whole = ledger_.agg(F.sum("exposure").alias("total"))
    rows = ledger_.where("exposure > 0").crossJoin(F.broadcast(whole))  # the total is one row
    return rows.select("token_id", "exposure", (F.col("exposure") / bankroll * 100).alias("share_pct"), F.greatest(F.lit(0.0), bankroll * most - F.col("total")).alias("room"))


def decision_inputs(proposals: DataFrame, ledger_: DataFrame, bankroll: float = 10_000.0) -> DataFrame:
    """Proposals with their token's state; 0 and the starting bankroll where there is none."""
    state = ledger_.select("token_id", F.col("exposure").alias("position_usd"), "closed_pnl")
    out = proposals.join(state, "token_id", "left").na.fill(0.0, ["position_usd", "closed_pnl"])
    return out.withColumn("bankroll", bankroll + F.col("closed_pnl"))


def walk_depth(levels: DataFrame, target: float = 5000.0, limit: float = 0.05, least_share: float = 0.5) -> DataFrame:
    """Buying `target` USD from each snapshot's asks: filled USD, shares, average price, slippage in bps, whether it is enough.

    Levels beyond the limit over the best price take no part.
    """
    w = Window.partitionBy("snapshot_id").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    usd = F.col("price") * F.col("size")
    rows = levels.where("not is_bid").withColumn("best", F.min("price").over(Window.partitionBy("snapshot_id"))).where(F.col("price") <= F.col("best") * (1 + limit))
    rows = rows.withColumn("usd", usd).withColumn("before", F.sum("usd").over(w) - F.col("usd"))
    rows = rows.withColumn("taken", F.greatest(F.lit(0.0), F.least(F.col("usd"), target - F.col("before"))))
    out = rows.groupBy("snapshot_id", "best").agg(F.sum("taken").alias("filled"), F.sum(F.col("taken") / F.col("price")).alias("shares"))
    price = F.col("filled") / F.nullif(F.col("shares"), F.lit(0.0))
    return out.select("snapshot_id", "filled", "shares", price.alias("avg_price"), ((price - F.col("best")) / F.col("best") * 10_000).alias("slippage_bps"), (F.col("filled") >= target * least_share).alias("enough"))
