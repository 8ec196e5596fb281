"""Volume buckets that start from 0 at the event after the one that fills them, without one task reading a whole group.

Where a bucket ends depends on where it starts, so buckets are a path. An event's node is the volume
before it; a node's successor is the first node that is a bucket's size or more further on. Nodes
are dealt by stretches of volume. Within a stretch, each node at which the path may come in is
followed to where it leaves; these few links between stretches are followed by pointer doubling;
and each stretch that the path has come through is walked once more to cut it into buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import cut
from .scan import running_sum, time_segment

#: Bucket sizes in a stretch of volume, and steps of volume in a dollar: sums of whole steps are exact.
SPAN, STEPS = 64, 1_000_000


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray | str]]:
    """The rows of each (_by, _g) as arrays, from batches that are sorted by both."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        by, g = batch.column("_by").to_pylist(), batch.column("_g").to_numpy()
        cuts = [k for k in range(1, len(g)) if g[k] != g[k - 1] or by[k] != by[k - 1]]
        if held and len(g) and (held[-1].column("_by")[-1].as_py(), held[-1].column("_g")[-1].as_py()) != (by[0], int(g[0])):
            cuts.insert(0, 0)
        first = 0
        for cut in cuts:
            if held or cut > first:
                yield _arrays([*held, batch.slice(first, cut - first)], names)
            held, first = [], cut
        if first < len(g):
            held.append(batch.slice(first))
    if held:
        yield _arrays(held, names)


def _arrays(parts: list[pa.RecordBatch], names: list[str]) -> dict:
    table = pa.Table.from_batches(parts)
    return {"_by": table.column("_by")[0].as_py(), "_g": table.column("_g")[0].as_py(), **{c: table.column(c).to_numpy() for c in names}}


def _successors(r: np.ndarray, size: int) -> np.ndarray:
    """Of ascending distinct nodes, the first one that is `size` or more further on (len(r): in a later stretch)."""
    return np.searchsorted(r, r + size)


def _sorted(df: DataFrame) -> DataFrame:
    return df.repartition("_by", "_g").sortWithinPartitions("_by", "_g", "_r")


def links(nodes: DataFrame, size: int, stretch: int) -> DataFrame:
    """_by, _g, _r of the nodes at which the path may enter a stretch, and _tg, _tr: what it is past when it leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["_r"]):
            r = np.unique(group["_r"])
            last = np.minimum(_successors(r, size), len(r))
            # the last node in the stretch that a node leads to
            last = np.where(last == len(r), np.arange(len(r)), last)
            while (further := last[last]).tolist() != last.tolist():
                last = further
            few = slice(0, int(np.searchsorted(r, size)) + 1)  # a bucket comes in less than its size past the stretch's start, or at the first node behind
            past = r[last[few]] + size
            rows = len(past)
            columns = [pa.array([group["_by"]] * rows, pa.string()), *(pa.array(c, pa.int64()) for c in (np.full(rows, group["_g"]), r[few], group["_g"] + past // stretch, past % stretch))]
            yield pa.RecordBatch.from_arrays(columns, names=["_by", "_g", "_r", "_tg", "_tr"])

    return _sorted(nodes).mapInArrow(run, "_by string, _g long, _r long, _tg long, _tr long")


def entries(found: DataFrame) -> DataFrame:
    """_by, _g, _r, _eg, _er: each link's node and the node at which the path enters a later stretch (none: left out)."""
    here = found.select("_by", "_g", "_r", F.lit(None).cast("struct<g:bigint,r:bigint>").alias("_from"))
    past = found.select("_by", F.col("_tg").alias("_g"), F.col("_tr").alias("_r"), F.struct(F.col("_g").alias("g"), F.col("_r").alias("r")).alias("_from"))
    node = F.when(F.col("_from").isNull(), F.col("_r"))
    ahead = Window.partitionBy("_by", "_g").orderBy("_r").rangeBetween(0, Window.unboundedFollowing)
    met = here.unionByName(past).withColumn("_er", F.min(node).over(ahead)).withColumn("_least", F.min(node).over(Window.partitionBy("_by", "_g")))
    # a stretch may be without such a node; then the next one's first is entered
    firsts = met.groupBy("_by", "_g").agg(F.min("_least").alias("_least"))
    after = Window.partitionBy("_by").orderBy("_g").rowsBetween(1, Window.unboundedFollowing)
    named = F.when(F.col("_least").isNotNull(), F.struct(F.col("_g").alias("g"), F.col("_least").alias("r")))
    firsts = firsts.select("_by", "_g", F.first(named, ignorenulls=True).over(after).alias("_next"))
    out = met.where("_from IS NOT NULL").join(firsts, ["_by", "_g"])
    to = F.when(F.col("_er").isNotNull(), F.struct(F.col("_g").alias("g"), F.col("_er").alias("r"))).otherwise(F.col("_next"))
    return out.select("_by", F.col("_from.g").alias("_g"), F.col("_from.r").alias("_r"), to.alias("_to")).where("_to IS NOT NULL").select("_by", "_g", "_r", F.col("_to.g").alias("_eg"), F.col("_to.r").alias("_er"))


def path(jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """All nodes (_by, _g, _r) on the paths from starts along jumps, by pointer doubling."""
    reached, size, jumps = cut(starts), -1, cut(jumps)
    while size != (now := reached.count()):
        size = now
        further = reached.join(jumps, ["_by", "_g", "_r"]).select("_by", F.col("_eg").alias("_g"), F.col("_er").alias("_r"))
        reached = cut(reached.unionByName(further).distinct())
        two = jumps.select("_by", F.col("_g").alias("_eg"), F.col("_r").alias("_er"), F.col("_eg").alias("_fg"), F.col("_er").alias("_fr"))
        jumps = cut(jumps.join(two, ["_by", "_eg", "_er"]).select("_by", "_g", "_r", F.col("_fg").alias("_eg"), F.col("_fr").alias("_er")))
    return reached


def cut_up(rows: DataFrame, entered: DataFrame, size: int) -> DataFrame:
    """_by, _g, start (steps into the stretch; null: in a bucket of an earlier stretch), last (the stretch's last start), buy, sell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["_r", "_v", "_b", "_e"]):
            entry, r = group["_e"][0], np.unique(group["_r"])
            starts = []
            if not np.isnan(entry):
                following, at = _successors(r, size), int(np.searchsorted(r, int(entry)))
                while at < len(r):
                    starts.append(int(r[at]))
                    at = int(following[at])
            bucket = np.searchsorted(np.array(starts, dtype=np.int64), group["_r"], side="right")  # 0: an earlier one
            buy, sell = (np.bincount(bucket, weights=np.where(side, group["_v"], 0.0), minlength=len(starts) + 1) for side in (group["_b"], ~group["_b"]))
            there = np.bincount(bucket, minlength=len(starts) + 1) > 0
            named = [None, *starts]
            keep = np.flatnonzero(there).tolist()
            columns = [pa.array([group["_by"]] * len(keep), pa.string()), pa.array([group["_g"]] * len(keep), pa.int64()), pa.array([named[k] for k in keep], pa.int64()), pa.array([starts[-1] if starts else None] * len(keep), pa.int64()), pa.array(buy[keep]), pa.array(sell[keep])]
            yield pa.RecordBatch.from_arrays(columns, names=["_by", "_g", "start", "last", "buy", "sell"])

    held = rows.join(entered.select("_by", "_g", F.col("_r").cast("double").alias("_e")), ["_by", "_g"], "left")
    return _sorted(held).select("_by", "_g", "_r", "_v", "_b", "_e").mapInArrow(run, "_by string, _g long, start long, last long, buy double, sell double")


def volume_buckets(events: DataFrame, by: str, size: float = 50_000.0, span: int = SPAN) -> DataFrame:
    """by, bucket (the volume of the group before it), buy, sell of all buckets, the last, open one too.

    Events are in order of ts, then trade_id. Volumes are compared in millionths. Buys are bets on
    Yes above 0.5.
    """
    buy = (F.col("outcome") == "Yes") & (F.col("price") > 0.5)
    steps = F.round(F.col("notional") * STEPS).cast("long")
    us = F.unix_micros("ts")
    rows = events.where("notional IS NOT NULL").select(
        F.col(by).cast("string").alias("_by"), us.alias("_t"), "trade_id", F.col("notional").alias("_v"), F.coalesce(buy, F.lit(False)).alias("_b"), steps.cast("decimal(20,0)").alias("_x"), time_segment(us).alias("_segment")
    )
    whole, stretch = int(round(size * STEPS)), int(round(size * STEPS)) * span
    # a running sum reads its rows twice, and events may be a long plan
    rows = running_sum(cut(rows), ["_by"], ["_t", "trade_id"], "_x", "_s")
    # written once: each pass below reads it
    rows = rows.withColumn("_g", F.expr(f"_s div {stretch}")).withColumn("_r", (F.col("_s") - F.col("_g") * F.lit(stretch).cast("decimal(20,0)")).cast("long"))
    rows = cut(rows.select("_by", "_g", "_r", "_v", "_b"))
    found = cut(links(rows.select("_by", "_g", "_r"), whole, stretch))
    starts = rows.groupBy("_by").agg(F.min(F.struct("_g", "_r")).alias("_least")).select("_by", "_least.*")
    parts = cut(cut_up(rows, path(entries(found), starts), whole))
    before = Window.partitionBy("_by").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    lasts = parts.groupBy("_by", "_g").agg(F.max("last").alias("_last"))
    open_ = F.last(F.when(F.col("_last").isNotNull(), F.struct(F.col("_g").alias("g"), F.col("_last").alias("r"))), ignorenulls=True).over(before)
    parts = parts.join(lasts.select("_by", "_g", open_.alias("_open")), ["_by", "_g"])
    own = F.when(F.col("start").isNotNull(), F.struct(F.col("_g").alias("g"), F.col("start").alias("r"))).otherwise(F.col("_open"))
    out = parts.groupBy("_by", own.alias("_own")).agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell")).where("buy + sell > 0")
    return out.select(F.col("_by").alias(by), (F.col("_own.g") * F.lit(float(size * span)) + F.col("_own.r") / STEPS).alias("bucket"), "buy", "sell")
