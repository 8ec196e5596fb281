"""Scores of features: size, book, wallet, anomaly, execution, edge, composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ScoreParams
from .numeric import clamp, col


def dollar_floor(usd) -> Column:
    u = col(usd)
    return F.when(u < 5_000, 0.0).when(u < 10_000, 0.5).when(u < 25_000, 0.75).otherwise(1.0)


def raw_size_tail(percentile) -> Column:
    p = col(percentile)
    return (
        F.when(p < 95, p / 95 * 0.5).when(p < 99, 0.5 + (p - 95) / 4 * 0.4).when(p < 99.9, 0.9 + (p - 99) / 0.9 * 0.08).otherwise(F.least(F.lit(1.0), 0.98 + (p - 99.9) / 0.1 * 0.02))
    )


def size_tail_score(percentile, usd) -> Column:
    return raw_size_tail(percentile) * dollar_floor(usd)


def wallet_age_score(days) -> Column:
    d = col(days)
    return F.when(d.isNull(), 0.5).when(d < 7, 1.0).when(d < 30, 0.7).when(d < 180, 0.3).otherwise(0.0)


def activity_from_transactions(n) -> Column:
    n = col(n)
    return F.when(n < 10, 0.9).when(n < 50, 0.6).when(n < 100, 0.3).otherwise(0.1)


def activity_score(trades, markets, volume) -> Column:
    part = lambda x, most: F.greatest(F.lit(0.0), 1 - col(x) / most)
    return part(trades, 100) * 0.4 + part(markets, 20) * 0.3 + part(volume, 10_000) * 0.3


def wallet_risk(age, activity, concentration=0.0) -> Column:
    return col(age) * 0.40 + col(activity) * 0.35 + col(concentration) * 0.25


def wallet_age_text(days) -> Column:
    d = col(days)
    whole = F.concat(F.lit("("), F.floor(d).cast("string"), F.lit("d)"))
    return F.when(d.isNull(), "Unknown").when(d < 7, F.concat(F.lit("New "), whole)).when(d < 30, F.concat(F.lit("Recent "), whole)).when(d < 180, F.concat(F.floor(d).cast("string"), F.lit("d"))).otherwise("Established")


def with_book_features(df: DataFrame) -> DataFrame:
    """From bid_5, ask_5, bid_10, ask_10, bid_top5, ask_top5 and the best prices: spread, depth, imbalance, thin side."""
    c, zero = F.col, F.lit(0.0)
    out = df.withColumns({"spread": c("best_ask") - c("best_bid"), "bid_depth": c("bid_5") + c("bid_10"), "ask_depth": c("ask_5") + c("ask_10")})
    out = out.withColumns(
        {
            "spread_bps": c("spread") / F.nullif(c("mid"), zero) * 10_000,
            "imbalance": F.coalesce((c("bid_10") - c("ask_10")) / F.nullif(c("bid_10") + c("ask_10"), zero), zero),
            "imbalance_top5": F.coalesce((c("bid_top5") - c("ask_top5")) / F.nullif(c("bid_top5") + c("ask_top5"), zero), zero),
            "thin_ratio": F.coalesce(F.least("bid_depth", "ask_depth") / F.nullif(F.greatest("bid_depth", "ask_depth"), zero), F.lit(1.0)),
            "depth_adequate": (c("bid_10") >= 100) & (c("ask_10") >= 100),
        }
    )
    return out.withColumns(
        {
            "thin_side": F.when(F.abs("imbalance") <= 0.3, "balanced").when(c("imbalance") > 0, "ask").otherwise("bid"),
            "book_imbalance_score": F.least(F.lit(1.0), F.abs("imbalance") / 0.7),
            "thin_opposite_score": F.greatest(zero, 1 - c("thin_ratio")),
            "spread_score": F.greatest(zero, 1 - c("spread_bps") / 500),
            "depth_score": F.least(F.lit(1.0), (c("bid_depth") + c("ask_depth")) / 100),
            "is_asymmetric": (F.abs("imbalance") > 0.5) & (c("thin_ratio") < 0.3),
        }
    )


def triple_signal(size, book, thin, wallet_new, activity) -> Column:
    return (col(size) >= 0.90) & (col(book) >= 0.70) & (col(thin) >= 0.70) & ((col(wallet_new) >= 0.80) | (col(activity) >= 0.70))


def signal_strength(score) -> Column:
    s = col(score)
    return F.when(s >= 0.85, "extreme").when(s >= 0.75, "strong").when(s >= 0.55, "moderate").when(s >= 0.35, "weak").otherwise("none")


def with_scores(features: DataFrame, p: ScoreParams = ScoreParams()) -> DataFrame:
    """Anomaly, execution, edge and composite scores of feature vectors; a missing book counts as balanced and empty."""
    c, zero, one = F.col, F.lit(0.0), F.lit(1.0)
    for name, kind in (("impact_score", "double"), ("change_score", "double"), ("changed", "boolean")):  # optional features
        if name not in features.columns:
            features = features.withColumn(name, F.lit(None).cast(kind))
    or_ = lambda name, default: F.coalesce(name, F.lit(default))
    book = 0.6 * or_("book_imbalance_score", 0.0) + 0.4 * or_("thin_opposite_score", 0.0)
    w = p.anomaly
    core = w[0] * c("size_tail_score") + w[1] * book + w[2] * c("wallet_new_score") + w[3] * or_("impact_score", 0.0)
    out = features.withColumns({"core_score": core, "context_score": F.greatest(or_("change_score", 0.0), c("burst_score"))})
    out = out.withColumns(
        {
            "anomaly": clamp(c("ramp") * (0.7 * c("core_score") + 0.3 * c("context_score"))),
            "triple": F.coalesce(triple_signal("size_tail_score", "book_imbalance_score", "thin_opposite_score", "wallet_new_score", "wallet_activity_score"), F.lit(False)),
        }
    )
    low, high = p.spread_bps
    spread, depth = or_("spread_bps", 10_000.0), F.least(or_("bid_depth", 0.0), or_("ask_depth", 0.0))
    size = F.abs(or_("imbalance", 0.0))
    x = p.execution
    out = out.withColumns(
        {
            "spread_penalty": clamp((spread - low) / (high - low)),
            "liquidity": F.least(one, depth / max(p.target_usd * 2, p.min_depth_usd)),
            "volatility_penalty": 0.6 * F.least(one, spread / 500) + 0.4 * size,
            "slippage_bps": F.when(depth <= 0, 1000.0).otherwise(F.least(F.lit(0.1), 0.001 + 0.02 * p.target_usd / F.nullif(depth, zero)) * 10_000),
        }
    )
    out = out.withColumn("execution", clamp(x[0] * c("liquidity") + x[1] * (1 - c("spread_penalty")) + x[2] * (1 - c("volatility_penalty")) + x[3] * F.least(one, 1 / c("ramp"))))
    out = out.withColumn("fill_probability", c("liquidity") * (1 - 0.3 * c("spread_penalty")))
    sign = F.when(or_("imbalance", 0.0) > 0, 1.0).otherwise(-1.0)
    shift = F.when(c("is_large"), sign * F.least(F.lit(0.15), c("anomaly") * 0.1)).otherwise(0.0) + F.when(size > 0.3, sign * size * 0.05).otherwise(0.0)
    new = F.coalesce(c("wallet_age_days") < 7, F.lit(False))
    shift = F.when(new & c("is_large"), shift * 1.2).otherwise(shift)
    mid = or_("mid", 0.5)
    aligned = sum((flag.cast("int") for flag in (size > 0.3, c("burst"), or_("changed", False), new)), c("is_large").cast("int"))
    out = out.withColumns({"edge": F.greatest(F.lit(0.01), F.least(F.lit(0.99), mid + shift)) - mid, "aligned": aligned})
    out = out.withColumn("edge_confidence", F.least(F.lit(0.9), 0.2 + c("aligned") * 0.14))
    out = out.withColumn("edge_score", clamp(F.abs("edge") * 5 * c("edge_confidence") * c("execution")))
    k = p.composite
    out = out.withColumn("composite", F.least(one, (k[0] * c("anomaly") + k[1] * c("execution") + k[2] * c("edge_score")) * c("ramp")))
    return out.withColumn("strength", signal_strength("composite"))
