"""Streams whose state needs rows in the order of event time, however files and micro-batches deal them.

A key's rows are held in buckets of event time, and each bucket has a timer at its end. When the
watermark has passed it, all of the bucket's rows are there: they are sorted and handed on. So a
task holds one bucket of one key, the state holds what the watermark's delay spans, and how rows
are dealt makes no difference as long as none is later than the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import folders
from .streams import ROCKSDB, WATERMARK, run_once

#: Kinds of rows; books come before trades of the same instant. A tick only moves the watermark.
BOOK, TRADE, TICK = 0, 1, 2
ROWS = "token_id string, kind int, id long, ts timestamp, value double"
RECORD = np.dtype([("us", "<i8"), ("kind", "<i4"), ("id", "<i8"), ("value", "<f8")])


def token_rows(trades: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Trades (value: notional) and books (value: mid) as rows of one kind of stream."""
    rows = trades.select("token_id", F.lit(TRADE).alias("kind"), F.col("trade_id").alias("id"), "ts", F.col("notional").alias("value"))
    if books is None:
        return rows
    return rows.unionByName(books.select("token_id", F.lit(BOOK).alias("kind"), F.col("snapshot_id").alias("id"), "ts", F.col("mid").alias("value")))


class Ordered(StatefulProcessor):
    """Hands a key's rows to released() bucket by bucket, in the order of time, kind and id."""

    #: Rows of a key that are gathered before they go to their buckets.
    GATHERED = 1 << 18

    def __init__(self, width_ms: int = 600_000) -> None:
        self.width_ms = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket long", "rows binary")

    def end_after(self, us: int) -> int:
        """The end, in ms, of the bucket that holds an instant."""
        return (us // (self.width_ms * 1000) + 1) * self.width_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call to the state costs more than many rows, so frames are gathered first
        gathered: list[np.ndarray] = []
        for frame in rows:
            frame = frame[frame["kind"] != TICK]
            record = np.empty(len(frame), dtype=RECORD)
            record["us"] = frame["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            for c in ("kind", "id", "value"):
                record[c] = frame[c].to_numpy()
            gathered.append(record)
            if sum(map(len, gathered)) >= self.GATHERED:
                gathered = [self.thinned(np.concatenate(gathered))]
                if len(gathered[0]) >= self.GATHERED // 2:
                    self.hold(gathered.pop())
        if sum(map(len, gathered)):  # a tick alone leaves nothing to hold
            self.hold(self.thinned(np.concatenate(gathered)))
        return iter(())

    def hold(self, record: np.ndarray) -> None:
        """Put rows to those of their buckets; a bucket's timer is set with its first row."""
        at = record["us"] // (self.width_ms * 1000)
        buckets, place = np.unique(at, return_inverse=True)
        parts = np.split(record[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place, minlength=len(buckets)))[:-1])
        for bucket, part in zip(buckets.tolist(), parts, strict=True):
            held = self.held.getValue((bucket,))
            before = b"" if held is None else bytes(held[0])
            if held is None:
                self.handle.registerTimer((bucket + 1) * self.width_ms)
            after = self.thinned(np.concatenate([np.frombuffer(before, dtype=RECORD), part])).tobytes()
            if held is None or after != before:
                self.held.updateValue((bucket,), (after,))
        # a timer that is set while timers expire waits for the next micro-batch, so these are set now
        for end in sorted(set(self.further_ends(record)) - {(bucket + 1) * self.width_ms for bucket in buckets.tolist()}):
            self.handle.registerTimer(end)

    def thinned(self, rows: np.ndarray) -> np.ndarray:
        """The rows that released() has to see, in any order; all of them unless a processor knows better."""
        return rows

    def further_ends(self, rows: np.ndarray) -> list[int]:
        """Ends of buckets, in ms, at which released() is called even if no row falls into them."""
        return []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers expire in the order of their times
        end, rows = expiredTimerInfo.getExpiryTimeInMs(), np.empty(0, dtype=RECORD)
        bucket = (end // self.width_ms - 1,)
        held = self.held.getValue(bucket)
        if held is not None:
            rows = np.sort(np.frombuffer(bytes(held[0]), dtype=RECORD), order=["us", "kind", "id"])
            self.held.removeKey(bucket)
        yield from self.released(key[0], rows, end)

    def released(self, token: str, rows: np.ndarray, end_ms: int) -> Iterator[pd.DataFrame]:
        """What comes of a bucket's rows, all of them before end_ms; there may be none."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class TokenState(Ordered):
    """Intensity, CUSUM, a quantile sketch and the last book of each token; emits each trade with the state after it.

    Trades of one instant share the intensity that all of them lead to. The sketch counts notionals
    in BUCKETS steps of GROWTH, so that its quantiles are off by half a step at most; sketches add up.
    State of a token without rows for idle_ms of event time is cleared.
    """

    SCHEMA = "token_id string, trade_id long, intensity double, cusum double, q95 double, mid double"
    BASE, JUMP, DECAY = 0.1, 0.5, 0.1
    BUCKETS, GROWTH, LEAST = 256, 1.1, 1e-3

    def __init__(self, width_ms: int = 600_000, idle_ms: int | None = 86_400_000) -> None:
        super().__init__(width_ms)
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "us long, excess double, n long, total double, squares double, cusum double, mid double, sketch binary")

    def released(self, token: str, rows: np.ndarray, end_ms: int) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        us, excess, n, total, squares, cusum, mid, sketch = held or (0, 0.0, 0, 0.0, 0.0, 0.0, None, b"")
        if not len(rows):
            if held and self.idle_ms and us + 1000 * self.idle_ms < 1000 * end_ms:
                self.state.clear()
            return
        counts = np.frombuffer(bytes(sketch), dtype=np.int64).copy() if sketch else np.zeros(self.BUCKETS, dtype=np.int64)
        book = np.maximum.accumulate(np.where(rows["kind"] == BOOK, np.arange(len(rows)), -1))
        mids = np.where(book >= 0, rows["value"][np.maximum(book, 0)], np.nan if mid is None else mid)
        trades = rows["kind"] == TRADE
        at, x, last_us = rows["us"][trades], rows["value"][trades], us
        if len(x):
            # times within a bucket are short enough for one scale: exp(DECAY * width) is far from overflow
            grown = np.exp(self.DECAY * (at - at[0]) / 1e6)
            start = excess * np.exp(-self.DECAY * (at[0] - us) / 1e6) if n else 0.0
            sums = start + self.JUMP * np.cumsum(grown)
            intensity = (sums / grown)[np.searchsorted(at, at, side="right") - 1]
            m = n + np.arange(1, len(x) + 1)
            totals, squared = total + np.cumsum(x), squares + np.cumsum(x * x)
            spread = np.where(m > 1, (squared - totals * totals / m) / np.maximum(m - 1, 1), 0.0)
            walk = cusum + np.cumsum(np.where(spread > 1e-9, (x - totals / m) / np.sqrt(np.maximum(spread, 1e-9)), 0.0))
            statistic = walk - np.minimum(0.0, np.minimum.accumulate(walk))
            step = np.clip((np.log(np.maximum(x, self.LEAST) / self.LEAST) / np.log(self.GROWTH)).astype(np.int64), 0, self.BUCKETS - 1)
            for first in range(0, len(x), 1024):
                part = slice(first, first + 1024)
                ones = np.zeros((len(step[part]), self.BUCKETS), dtype=np.int64)
                ones[np.arange(len(ones)), step[part]] = 1
                so_far = counts + np.cumsum(ones, axis=0)
                counts = so_far[-1]
                k = (np.cumsum(so_far, axis=1) < 0.95 * m[part, None]).sum(1)
                yield pd.DataFrame({"token_id": token, "trade_id": rows["id"][trades][part], "intensity": self.BASE + intensity[part], "cusum": statistic[part], "q95": self.LEAST * self.GROWTH ** (k + 0.5), "mid": mids[trades][part]})
            last_us, excess, n, total, squares, cusum = int(at[-1]), float(intensity[-1]), int(m[-1]), float(totals[-1]), float(squared[-1]), float(statistic[-1])
        self.state.update((last_us, excess, n, total, squares, cusum, None if np.isnan(mids[-1]) else float(mids[-1]), counts.tobytes()))
        if self.idle_ms:
            self.handle.registerTimer(self.end_after(int(rows["us"][-1]) + 1000 * self.idle_ms))


class Silence(Ordered):
    """Emits a row whenever a token's books or trades have been silent for longer than their limit, without a new row coming.

    kind, the last row before the silence, and since when data is stale. A token that trades before
    it has a book has stale books from its first trade on. What is silent is told once.
    """

    SCHEMA = "token_id string, kind string, last_us long, stale_us long"
    NAMES = {BOOK: "orderbook", TRADE: "trades"}

    def __init__(self, limits_ms: dict[int, int], width_ms: int = 1000) -> None:
        super().__init__(width_ms)
        self.limits_ms = limits_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # each kind's last row, below 0 once its silence is told; null before the first one
        self.last = handle.getValueState("last", "book long, trade long")

    def limits_us(self, kinds: np.ndarray) -> np.ndarray:
        limits = np.zeros(TICK, dtype=np.int64)
        limits[list(self.limits_ms)] = [1000 * ms for ms in self.limits_ms.values()]
        return limits[kinds]

    def thinned(self, rows: np.ndarray) -> np.ndarray:
        """The first and the last row of each stretch of a kind's limit: rows between them neither begin nor end a silence."""
        rows = rows[np.lexsort((rows["us"], rows["kind"]))]
        stretch = rows["us"] // np.maximum(self.limits_us(rows["kind"]), 1)
        new = np.ones(len(rows) + 1, dtype=bool)
        new[1:-1] = (rows["kind"][1:] != rows["kind"][:-1]) | (stretch[1:] != stretch[:-1])
        first, last = new[:-1], new[1:]
        return rows[first | (last & (rows["us"] != rows["us"][np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]))]

    def further_ends(self, rows: np.ndarray) -> list[int]:
        width = self.width_ms * 1000
        return (np.unique((rows["us"] + self.limits_us(rows["kind"])) // width + 1) * self.width_ms).tolist()

    def released(self, token: str, rows: np.ndarray, end_ms: int) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        last = dict(zip((BOOK, TRADE), known or (None, None), strict=True))
        out: list[tuple] = []
        if known is None and len(rows) and rows["kind"][0] == TRADE:
            out.append((token, self.NAMES[BOOK], None, int(rows["us"][0])))
        for kind, limit_ms in self.limits_ms.items():
            limit, us = 1000 * limit_ms, np.unique(rows["us"][rows["kind"] == kind])
            if last[kind] is not None and last[kind] >= 0:
                us = np.append(last[kind], us)
            if not len(us):
                continue
            last[kind] = int(us[-1])
            silent = us[:-1][np.diff(us) > limit].tolist()
            if us[-1] + limit < 1000 * end_ms:
                silent.append(last[kind])
                last[kind] = -1
            out += [(token, self.NAMES[kind], int(t), int(t) + limit) for t in silent]
        self.last.update((last[BOOK], last[TRADE]))
        if out:
            yield pd.DataFrame(out, columns=["token_id", "kind", "last_us", "stale_us"]).astype({"last_us": "Int64"})


def in_order(rows: DataFrame, processor: Ordered, delay: str = WATERMARK) -> DataFrame:
    """A stream of rows (see ROWS) through a processor; needs the RocksDB state store."""
    return rows.withWatermark("ts", delay).groupBy("token_id").transformWithStateInPandas(processor, processor.SCHEMA, "Append", "EventTime")


def replayed(spark: SparkSession, rows: DataFrame, processor: Ordered, until: datetime, delay: str, delay_s: float) -> DataFrame:
    """Drain a stream of rows whose files may come in any order within the delay, up to an instant; read what came out.

    Once everything has been read, a tick moves the watermark to `until`, so that the last buckets
    are released, too.
    """
    at = folders.new(spark, "stream")
    ticks = f"{at}/ticks"
    spark.createDataFrame([], ROWS).write.parquet(ticks)
    stream = in_order(rows.unionByName(spark.readStream.schema(ROWS).parquet(ticks)), processor, delay)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        run_once(stream, None, "append", at)
        tick = until.replace(tzinfo=timezone.utc) + timedelta(seconds=delay_s, milliseconds=1)
        spark.createDataFrame([("", TICK, 0, tick, 0.0)], ROWS).coalesce(1).write.mode("append").parquet(ticks)
        run_once(stream, None, "append", at)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{at}/out")
