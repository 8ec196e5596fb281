"""Streams of trades and books. Each transform takes and returns DataFrames and also runs on batches.

Event time replaces wall clock: late trades within the watermark count, later ones are dropped and
counted (late_rows).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import seconds_to_close, time_ramp
from ..sources import folders
from ..sources import views as V

WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trade_stream(spark: SparkSession, sf_dir: str, files: int = 8) -> DataFrame:
    """Trades as they come with new files of the events table, a file or a folder; at most `files` a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    # a glob, as only this takes a file as well as a folder
    return V.trades_of(reader.parquet(f"{sf_dir}/events.parque[t]"))


def deduplicated(trades: DataFrame) -> DataFrame:
    """Each trade_id once within the watermark."""
    return trades.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["trade_id"])


def _measured(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("trades"), F.sum("notional").alias("volume"), F.max("price").alias("high"), F.min("price").alias("low"))


def tumbling_bars(trades: DataFrame, minutes: int = 5) -> DataFrame:
    return _measured(trades.withWatermark("ts", WATERMARK).groupBy("token_id", F.window("ts", f"{minutes} minutes"))).select("token_id", F.col("window.start").alias("start"), "trades", "volume", "high", "low")


def sliding_windows(trades: DataFrame, minutes: int = 60, step: int = 1) -> DataFrame:
    return _measured(trades.withWatermark("ts", WATERMARK).groupBy("token_id", F.window("ts", f"{minutes} minutes", f"{step} minutes"))).select("token_id", F.col("window.start").alias("start"), "trades", "volume", "high", "low")


def enriched(trades: DataFrame, wallets: DataFrame, markets: DataFrame) -> DataFrame:
    """Stream-static joins with wallets and markets; unknown ones stay, with nulls and ramp 1."""
    out = trades.join(wallets, "wallet", "left").join(markets.select("condition_id", "end_date"), "condition_id", "left")
    return out.withColumn("ramp", time_ramp(seconds_to_close("ts", "end_date") / 3600))


def gated(scores: DataFrame) -> DataFrame:
    """Scores that are a signal and outside the no-trade zone."""
    return scores.where((F.col("strength") != "none") & ~F.col("in_no_trade_zone"))


def as_stream(df: DataFrame, files: int = 8) -> DataFrame:
    """A batch as a stream: written to the shared folder, and read as its files come, at most `files` a micro-batch."""
    at = folders.new(df.sparkSession, "stream")
    df.write.mode("append").parquet(at)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(at)


def late_rows(query) -> int:
    """Rows that a stream dropped as later than the watermark, in its progress reports kept by Spark."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])


def run_once(stream: DataFrame, by_batch: Callable[[DataFrame, int], None] | None, mode: str, at: str) -> None:
    """Run a stream over all that is there and end; its checkpoint, and its rows unless by_batch takes them, are in folder `at`."""
    writer = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).outputMode(mode)
    writer = writer.foreachBatch(by_batch) if by_batch else writer.format("parquet").option("path", f"{at}/out")
    writer.start().awaitTermination()


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there, into Parquet, and read it."""
    at = folders.new(spark, "stream")
    run_once(stream, None, "append", at)
    return spark.read.parquet(f"{at}/out")


def drained_groups(spark: SparkSession, stream: DataFrame, *keys: str) -> DataFrame:
    """The last state of each group of an aggregating stream: groups that are still open at the end are there, too."""
    at = folders.new(spark, "stream")
    run_once(stream, lambda df, epoch: df.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}"), "update", at)
    return _latest(spark.read.parquet(f"{at}/out"), *keys)


def _latest(rows: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != "epoch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def rescored(spark: SparkSession, trades: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "trade_id", minutes: int = 60, late: timedelta | None = None) -> DataFrame:
    """Drain a stream of trades through `score`, whose windows reach `minutes` back; the last score of each trade.

    Trades are stored by hour as they come. A micro-batch is scored together with the stored trades
    of the hours that its windows reach back to, and so are the trades up to `minutes` behind it,
    whose windows it changes: how trades are dealt to micro-batches makes no difference. Hours that
    no trade can reach any more, as none is later than `late`, are deleted (None: trades may be as
    late as they like). A micro-batch that is run again replaces what it has stored. score keeps
    `key` and ts.
    """
    at, reach, newest = folders.new(spark, "stream"), timedelta(minutes=minutes), [0]
    hour = F.floor(F.unix_micros("ts") / F.lit(3_600_000_000)).cast("long")
    of = lambda t: F.floor(F.unix_micros(F.lit(t).cast("timestamp")) / F.lit(3_600_000_000)).cast("long")

    def batch(df: DataFrame, epoch: int) -> None:
        stored = df.withColumns({"hour": hour, "epoch": F.lit(epoch)}).write.partitionBy("hour", "epoch")
        stored.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{at}/trades")
        if not folders.names(spark, f"{at}/trades"):
            return
        kept = spark.read.parquet(f"{at}/trades")
        first, last = kept.where(F.col("epoch") == epoch).agg(F.min("ts"), F.max("ts")).first()
        if first is None:
            return
        near = kept.where(F.col("hour").between(of(first - reach), of(last + reach)) & F.col("ts").between(F.lit(first - reach), F.lit(last + reach))).drop("hour", "epoch")
        score(near).where(F.col("ts") >= F.lit(first)).write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")
        newest[0] = max(newest[0], int(last.timestamp()))
        if late is not None:
            oldest = (newest[0] - int((late + reach).total_seconds())) // 3600
            for name in folders.names(spark, f"{at}/trades"):
                if name.startswith("hour=") and int(name[5:]) < oldest:
                    folders.delete(spark, f"{at}/trades/{name}")

    run_once(trades, batch, "append", at)
    return _latest(spark.read.parquet(f"{at}/out"), key)
