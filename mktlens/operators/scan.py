"""Windows over keys that may hold a third of all rows: ordered scans in two phases, frames in overlapping segments.

A key's rows are cut into segments, a function of the order that Spark can deal out by. A scan runs
in each segment, one row for each segment tells what it adds, these rows are scanned by key, and
what comes before a segment is joined back to its rows. Frames that reach a bounded time back or
ahead need no second phase: rows near a segment's edge go to its neighbours as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import cut

MICROS = 1_000_000
#: Parts into which by_rank cuts a key's rows.
PARTS = 32
#: Rows in a block of in_blocks.
BLOCK_ROWS = 4096
#: Seconds in a segment of time, unless frames need longer ones.
SEGMENT_S = 3600


def time_segment(us: Column, seconds: int = SEGMENT_S) -> Column:
    return F.floor(us / F.lit(seconds * MICROS)).cast("long")


def by_rank(df: DataFrame, keys: list[str], order: str, *more: Column) -> DataFrame:
    """df in segments (_segment) of about as many rows of a key each, at sampled bounds of order; rows of one place stay together.

    more: further aggregates of a key that its rows are to carry. Keys are not null. Bounds are
    written: a scan asks for its rows twice, and sampled again the bounds may be others.
    """
    bounds = F.percentile_approx(order, F.array(*(F.lit(k / PARTS) for k in range(1, PARTS))), F.lit(1000)).alias("_bounds")
    rows = df.join(cut(df.groupBy(*keys).agg(bounds, *more)), keys)
    return rows.withColumn("_segment", F.size(F.filter("_bounds", lambda b: b < F.col(order)))).drop("_bounds")


def local_window(keys: list[str], order: list) -> Window:
    """Rows of a segment up to the current one."""
    return Window.partitionBy(*keys, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def with_carried(rows: DataFrame, keys: list[str], summary: list[Column], carried: dict[str, Column]) -> DataFrame:
    """rows (with _segment) and, for each segment, what `carried` makes of the summaries of the key's earlier segments.

    summary: aggregates of a segment's rows. carried: expressions over earlier(), a window of one row
    for each segment; null for a key's first segment.
    """
    each = rows.groupBy(*keys, "_segment").agg(*summary)
    before = each.select(*keys, "_segment", *(c.alias(n) for n, c in carried.items()))
    return rows.join(before, [*keys, "_segment"])


def earlier(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(rows: DataFrame, keys: list[str], order: list, x: str, name: str) -> DataFrame:
    """rows (with _segment, which grows with order) and the sum of x over the key's rows before this one."""
    local = rows.withColumn("_here", F.sum(x).over(local_window(keys, order)) - F.col(x))
    out = with_carried(local, keys, [F.sum(x).alias("_total")], {"_before": F.sum("_total").over(earlier(keys))})
    return out.withColumn(name, F.col("_here") + F.coalesce("_before", F.lit(0))).drop("_here", "_before")


def reflected_sums(rows: DataFrame, keys: list[str], order: list, steps: dict[str, str]) -> DataFrame:
    """rows (with _segment, which grows with order) and, by name, S = max(0, S + step) after each row, from 0 on.

    S is P - min(0, running min of P) with P the running sum of the steps, whose nulls count as 0. A
    segment tells its sum and how low its own running sum gets.
    """
    here, before, local, summary = local_window(keys, order), earlier(keys), rows, []
    for name, step in steps.items():
        local = local.withColumn(f"_{name}_p", F.coalesce(F.sum(step).over(here), F.lit(0.0)))
        local = local.withColumn(f"_{name}_low", F.min(f"_{name}_p").over(here))
        summary += [F.coalesce(F.sum(step), F.lit(0.0)).alias(f"_{name}_total"), F.min(f"_{name}_p").alias(f"_{name}_least")]
    each = local.groupBy(*keys, "_segment").agg(*summary)
    for name in steps:
        each = each.withColumn(f"_{name}_before", F.coalesce(F.sum(f"_{name}_total").over(before), F.lit(0.0)))
        each = each.withColumn(f"_{name}_floor", F.least(F.lit(0.0), F.min(F.col(f"_{name}_before") + F.col(f"_{name}_least")).over(before)))
    each = each.select(*keys, "_segment", *(f"_{name}_{c}" for name in steps for c in ("before", "floor")))
    out = local.join(each, [*keys, "_segment"])
    reflected = {n: F.col(f"_{n}_before") + F.col(f"_{n}_p") - F.least(F.col(f"_{n}_floor"), F.col(f"_{n}_before") + F.col(f"_{n}_low")) for n in steps}
    return out.withColumns(reflected).drop(*(f"_{name}_{c}" for name in steps for c in ("p", "low", "before", "floor")))


def in_segments(df: DataFrame, us: Column, back_s: float, ahead_s: float = 0.0, seconds: int | None = None) -> DataFrame:
    """df's rows in their segments of time (_segment, _own) and once more in each one whose frames reach them.

    Frames that reach back_s back and ahead_s ahead are whole for the rows with _own, by windows that
    are partitioned by _segment as well. Segments are as long as a frame unless told, so that a row
    has a copy or two.
    """
    width = seconds or max(SEGMENT_S // 4, int(back_s + ahead_s))
    at = time_segment(us, width)
    first, last = time_segment(us - F.lit(int(ahead_s * MICROS)), width), time_segment(us + F.lit(int(back_s * MICROS)), width)
    return df.withColumn("_segment", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_segment") == at)


def in_blocks(df: DataFrame, place: str, back: int) -> DataFrame:
    """As in_segments, for frames that reach `back` rows back: blocks of a key's rows by their place, a number from 0 on without gaps."""
    block = lambda k: F.floor(k / F.lit(BLOCK_ROWS)).cast("long")
    rows = df.withColumn("_segment", F.explode(F.sequence(block(F.col(place)), block(F.col(place) + F.lit(back)))))
    return rows.withColumn("_own", F.col("_segment") == block(F.col(place)))


def own(df: DataFrame) -> DataFrame:
    """The rows of in_segments or in_blocks that stand in their own segment."""
    return df.where("_own").drop("_own", "_segment")
