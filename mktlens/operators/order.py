"""Ranks and exact quantiles within groups that may hold a third of all rows.

Equal values are counted first. Each group's distinct values are then split into ranges at sampled
bounds, counted up within a range, and offset by the ranges before it: no group is one task's work,
and how good the bounds are only matters for balance. They are written, as what is sampled depends
on how rows are dealt and must not be sampled twice for one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import cut

#: Ranges into which a group's distinct values are split.
PARTS = 32


def value_counts(df: DataFrame, by: tuple[str, ...], x: str) -> DataFrame:
    """by, x, m: how many rows have each value; nulls are left out."""
    return df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("m"))


def placed(counts: DataFrame, by: tuple[str, ...], x: str, parts: int = PARTS) -> DataFrame:
    """counts (by, x, m) with below (rows with a smaller value) and total (rows of the group)."""
    keys = list(by)
    bounds = cut(counts.groupBy(*keys).agg(F.percentile_approx(x, F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(1000)).alias("_bounds"), F.sum("m").alias("total")))
    rows = (counts.join(bounds, keys) if keys else counts.crossJoin(F.broadcast(bounds))).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(x)))).drop("_bounds")
    ranges = rows.groupBy(*keys, "_range").agg(F.sum("m").alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over `parts` rows
    ranges = ranges.select(*keys, "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*keys, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(ranges, [*keys, "_range"]).withColumn("below", F.col("_before") + F.sum("m").over(here) - F.col("m")).drop("_range", "_before")


def quantile(placed_: DataFrame, by: tuple[str, ...], x: str, q: float, name: str) -> DataFrame:
    """by and the exact, interpolated quantile of each group, from its placed values."""
    at = F.lit(q) * (F.col("total") - 1)
    value = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("m")), F.col(x)))
    out = placed_.groupBy(*by).agg(value(F.floor(at)).alias("_low"), value(F.ceil(at)).alias("_high"), F.first(at - F.floor(at)).alias("_part"))
    return out.select(*by, (F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).alias(name))
