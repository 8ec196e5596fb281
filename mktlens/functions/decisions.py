"""Decisions from scores: direction, stake, risk guards, gates, fills and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import RiskParams, SizingParams
from .numeric import col


def direction(imbalance, thin_opposite) -> Column:
    """YES or NO by the sign of the book's imbalance; null below 0.2."""
    i = col(imbalance)
    return F.when(F.abs(i) < 0.2, F.lit(None).cast("string")).when(i > 0, "YES").when(i < 0, "NO")


def limit_price(side, bid, ask, spread_bps) -> Column:
    """Half a spread beyond the best price, within 0.01 and 0.99."""
    buffer = col(spread_bps) / 10_000 * 0.5
    return F.when(col(side) == "YES", F.least(col(ask) + buffer, F.lit(0.99))).when(col(side) == "NO", F.greatest(col(bid) - buffer, F.lit(0.01)))


def with_stake(df: DataFrame, p: SizingParams = SizingParams()) -> DataFrame:
    """stake_usd, stake_shares and capped_by from edge_score, mid, bankroll, position_usd and side."""
    c = F.col
    raw = c("edge_score") * p.edge_scale / F.greatest(c("mid") * (1 - c("mid")), F.lit(p.variance))
    room = p.max_position - c("position_usd") / c("bankroll")
    out = df.withColumn("kelly_raw", raw).withColumn("_bet", F.least(raw * p.fraction, F.lit(p.max_bet))).withColumn("kelly", F.when(c("_bet") > room, F.greatest(F.lit(0.0), room)).otherwise(c("_bet")))
    usd = c("kelly") * c("bankroll")
    small = (usd > 0) & (usd < p.min_usd)
    reason = F.when(small, "below_min_bet_size").when(c("_bet") > room, "max_position_fraction").when(raw * p.fraction > p.max_bet, "max_bet_fraction")
    out = out.withColumn("stake_usd", F.when(small, 0.0).otherwise(usd)).withColumn("capped_by", reason)
    price = F.when(c("side") == "NO", 1 - c("mid")).otherwise(c("mid"))
    return out.withColumn("stake_shares", F.when(c("stake_usd") > 0, c("stake_usd") / F.nullif(price, F.lit(0.0))).otherwise(0.0)).drop("_bet")


def with_risk(df: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """risk_reasons, risk_warnings, risk_usd and risk_ok of a proposed stake and the portfolio's state."""
    c = F.col
    bank = c("bankroll")
    single = F.least(c("stake_usd"), bank * p.single_bet)
    room, left = bank * p.position - c("position_usd"), bank * p.exposure - c("exposure_usd")
    position = F.when(c("position_usd") + single > bank * p.position, F.greatest(F.lit(0.0), room)).otherwise(single)
    usd = F.when(c("exposure_usd") + position > bank * p.exposure, F.least(position, F.greatest(F.lit(0.0), left))).otherwise(position)
    loss, fall = -c("daily_pnl") / bank, c("drawdown")
    reasons = [
        (loss > p.daily_loss, "daily_loss"), (fall > p.drawdown, "drawdown"), (c("losses_in_row") >= p.losses, "consecutive_losses"),
        (c("seconds_to_close") <= p.no_trade_seconds, "no_trade_zone"), (c("book_age_ms") > p.stale_ms, "stale_book"), (c("spread_bps") > p.max_spread_bps, "spread_too_wide"),
        (c("top_depth") < p.min_depth_usd, "insufficient_depth"), ((c("position_usd") + single > bank * p.position) & (room <= 0), "position_limit"),
        ((c("exposure_usd") + position > bank * p.exposure) & (left <= 0), "exposure_limit"),
    ]
    warnings = [
        ((loss > p.daily_loss * 0.8) & (loss <= p.daily_loss), "near_daily_loss"), ((fall > p.drawdown * 0.8) & (fall <= p.drawdown), "near_drawdown"), (c("losses_in_row") == p.losses - 1, "near_losses"),
        (c("stake_usd") > bank * p.single_bet, "capped_single_bet"), ((c("position_usd") + single > bank * p.position) & (room > 0), "capped_position"),
    ]
    listed = lambda rules: F.array_join(F.array_compact(F.array(*(F.when(ok, F.lit(name)) for ok, name in rules))), ",")
    out = df.withColumns({"risk_reasons": listed(reasons), "risk_warnings": listed(warnings), "risk_usd": usd})
    return out.withColumn("risk_ok", (F.col("risk_reasons") == "") & (F.col("risk_usd") > 0))


def circuit_breakers(df: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    return df.withColumns({"breaks_daily_loss": F.col("daily_pnl") < -F.col("bankroll") * p.daily_loss, "breaks_drawdown": F.col("drawdown") > p.drawdown, "breaks_losses": F.col("losses_in_row") >= p.losses})


def decision(fresh, anomaly, execution, edge, side, stake, risk_ok) -> Column:
    """The first gate that fails, or APPROVED."""
    gates = [
        (~col(fresh), "STALE_DATA"), (col(anomaly) < 0.65, "BELOW_ANOMALY_THRESHOLD"), (col(execution) < 0.55, "BELOW_EXECUTION_THRESHOLD"), (col(edge) < 0.05, "BELOW_EDGE_THRESHOLD"),
        (col(side).isNull(), "RISK_CHECK_FAILED"), (col(stake) <= 0, "INSUFFICIENT_LIQUIDITY"), (~col(risk_ok), "RISK_CHECK_FAILED"),
    ]
    return F.coalesce(*(F.when(fails, F.lit(name)) for fails, name in gates), F.lit("APPROVED"))


def market_impact_bps(usd) -> Column:
    return F.floor(10 + 5 * F.log(1 + col(usd) / 1000) + 0.5).cast("double")


def position_pnl(side, entry, price, size) -> Column:
    """Long positions (YES) gain with the price, short ones (NO) with its fall."""
    return F.when(col(side) == "YES", 1.0).otherwise(-1.0) * (col(price) - col(entry)) * col(size)


def strategy_id(*parts) -> Column:
    return F.concat_ws("-", *(col(p).cast("string") for p in parts))


def config_hash(*parts: str) -> Column:
    """First 12 characters of the MD5 of the parts' JSON."""
    return F.substring(F.md5(F.to_json(F.struct(*parts))), 1, 12)
