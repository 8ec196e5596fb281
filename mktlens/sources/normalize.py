"""From wire records to the engine's tables: parse, derive, check, merge."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders

MONTHS = "(January|February|March|April|May|June|July|August|September|October|November|December)"


def normalize_markets(raw: DataFrame) -> DataFrame:
    """JSON-in-string arrays parsed; outcomes zipped with their token ids (without an id: dropped); category and tags derived.

    raw: condition_id, question, outcomes, clob_token_ids (JSON arrays), end_date, end_date_iso, active,
    closed, tags (array<string>), event_title, event_slug.
    """
    names, ids = F.from_json("outcomes", "array<string>"), F.from_json("clob_token_ids", "array<string>")
    zipped = F.filter(F.arrays_zip(names.alias("name"), ids.alias("token_id")), lambda o: o["token_id"].isNotNull() & (o["token_id"] != ""))
    slug = F.array(F.regexp_replace("event_slug", "-", " "))
    return raw.select(
        "condition_id",
        "question",
        zipped.alias("outcomes"),
        F.coalesce("end_date", "end_date_iso").alias("end_date"),
        F.coalesce("event_title", F.get("tags", F.lit(0))).alias("category"),
        F.filter(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array("event_title"), slug), lambda t: t.isNotNull()).alias("tags"),
        (F.col("closed") & ~F.col("active")).alias("resolved"),
    )


def normalize_orderbook(raw: DataFrame) -> DataFrame:
    """String levels cast, empty ones dropped, sides sorted best first; best prices, mid, spread in bps of the mid.

    raw: token_id, ts, bids, asks (array<struct<price:string,size:string>>).
    """

    def side(c: str, descending: bool) -> Column:
        levels = F.transform(c, lambda v: F.struct(v["price"].cast("double").alias("price"), v["size"].cast("double").alias("size")))
        return F.sort_array(F.filter(levels, lambda v: v["size"] > 0), asc=not descending)

    out = raw.select("token_id", "ts", side("bids", True).alias("bids"), side("asks", False).alias("asks"))
    out = out.withColumn("best_bid", F.get("bids", F.lit(0))["price"]).withColumn("best_ask", F.get("asks", F.lit(0))["price"])
    out = out.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
    return out.withColumn("spread_bps", (F.col("best_ask") - F.col("best_bid")) / F.nullif(F.col("mid"), F.lit(0.0)) * 10_000)


def normalize_trades_clob(raw: DataFrame) -> DataFrame:
    return raw.select("trade_id", "token_id", "ts", F.lower("maker").alias("maker"), F.lower("taker").alias("taker"), F.upper("side").alias("side"), F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))


def normalize_trades_public(raw: DataFrame) -> DataFrame:
    """Seconds to timestamps; a hash that is not 64 hexadecimal digits is null; the id is the hash, else made of market, time and wallet."""
    ok = F.col("transaction_hash").rlike("^0x[0-9a-fA-F]{64}$")
    tx = F.when(ok, F.col("transaction_hash"))
    synthetic = F.concat_ws("-", "condition_id", F.col("timestamp").cast("string"), "proxy_wallet")
    return raw.select(
        F.coalesce(tx, synthetic).alias("trade_id"), tx.alias("tx_hash"), F.timestamp_seconds("timestamp").alias("ts"), F.lower("proxy_wallet").alias("taker"), F.lit("0x" + "0" * 40).alias("maker"),
        F.upper("side").alias("side"), F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"),
    )


def resolved_markets(raw: DataFrame) -> DataFrame:
    """Two-outcome markets whose prices are exactly 1 and 0, with the winner and its token."""
    names, prices, ids = (F.from_json(c, "array<string>") for c in ("outcomes", "outcome_prices", "clob_token_ids"))
    rows = raw.select("condition_id", "question", "end_date", names.alias("names"), F.transform(prices, lambda p: p.cast("double")).alias("prices"), ids.alias("ids"))
    rows = rows.where((F.size("names") == 2) & (F.array_sort("prices") == F.array(F.lit(0.0), F.lit(1.0))))
    won = F.array_position("prices", F.lit(1.0)).cast("int") - 1
    return rows.select(
        "condition_id", "question", "end_date", F.get("names", won).alias("winner"), F.get("ids", won).alias("winning_token"), F.get("ids", F.lit(0)).alias("yes_token"), F.get("ids", F.lit(1)).alias("no_token")
    )


def historical_trades(raw: DataFrame, markets: DataFrame, hours: int = 24) -> DataFrame:
    """Trades within `hours` before their market's end, with the token of their outcome; one row for each id and market.

    raw: condition_id, trade_id, ts, outcome_index, price, size; markets as resolved_markets() gives them.
    """
    rows = raw.join(markets.select("condition_id", "end_date", "yes_token", "no_token"), "condition_id").where((F.col("ts") <= F.col("end_date")) & (F.col("ts") >= F.col("end_date") - F.expr(f"INTERVAL {hours} HOURS")))
    first = F.col("outcome_index") == 0
    rows = rows.select("condition_id", "trade_id", "ts", F.when(first, "Yes").otherwise("No").alias("outcome"), F.when(first, F.col("yes_token")).otherwise(F.col("no_token")).alias("token_id"), "price", "size", (F.col("size") * F.col("price")).alias("notional"))
    return rows.groupBy("condition_id", "trade_id").agg(F.min(F.struct("ts", "outcome", "token_id", "price", "size", "notional")).alias("t")).select("condition_id", "trade_id", "t.*")


def incremental(batch: DataFrame, known: DataFrame, since, keys: tuple[str, ...] = ("trade_id", "ts")) -> DataFrame:
    """Rows after `since` whose keys are not known yet, once each."""
    return batch.where(F.col("ts") > F.lit(since).cast("timestamp")).dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti")


def enrich_wallets(addresses: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Distinct addresses in lower case with first sight and transaction count; unknown ones have null and 0."""
    return addresses.select(F.lower("wallet").alias("wallet")).distinct().join(enrichment, "wallet", "left").select("wallet", "first_seen_at", F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"))


def extract_join_date(pages: DataFrame) -> DataFrame:
    """The first month and year or ISO date that a page's text tells, and its first address (page_id, html)."""
    month = F.regexp_extract("html", rf"(?i)joined\s+{MONTHS}\s+\d{{4}}", 0)
    spelled = F.to_date(F.initcap(F.regexp_extract(month, rf"(?i){MONTHS}\s+\d{{4}}", 0)), "MMMM yyyy")
    iso = F.to_date(F.nullif(F.regexp_extract("html", r"\b(20\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8]))\b", 1), F.lit("")))
    return pages.select("page_id", F.coalesce(F.when(month != "", spelled), iso).alias("joined"), F.nullif(F.regexp_extract("html", "0x[0-9a-fA-F]{40}", 0), F.lit("")).alias("address"))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all rules, the others with the first rule that fails as `reason`); null fails."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()), F.lit(None).cast("string"))
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with the listed columns of new where keys meet, and the new keys' rows added."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in columns else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
    return o.join(n, on, "full_outer").select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *(pick(c).alias(c) for c in old.columns if c not in keys))


def append(df: DataFrame, path: str, batch: str) -> bool:
    """Append df to the table at `path` as the batch of that name, once: a batch that is there already adds nothing, and False is returned.

    A batch's files are written to a folder that nobody reads yet, and count from when that is
    renamed, in one step; a batch that failed half-way leaves none and can be appended again. Of two
    writers of one batch the second one's rename fails.
    """
    if folders.exists(df.sparkSession, f"{path}/batch={batch}"):
        return False
    pending = f"{path}/_pending-{uuid.uuid4().hex}"
    df.write.parquet(pending)
    return folders.rename(df.sparkSession, pending, f"{path}/batch={batch}")


def appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches, with the name of each one's batch; folders that begin with an underscore are no batches."""
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("string"))


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what a stream holds to a table, a batch for each micro-batch: one that is replayed after a failure adds no row."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, epoch: append(df, path, f"{epoch:012d}") and None).start().awaitTermination()


def load_results(raw: DataFrame) -> DataFrame:
    """Stored strategy results: nulls become defaults, the configuration's JSON is parsed."""
    config = F.from_json("config", "mode string, min_notional double")
    return raw.select("config_id", config["mode"].alias("mode"), F.coalesce(config["min_notional"], F.lit(0.0)).alias("min_notional"), F.coalesce("roi", F.lit(0.0)).alias("roi"), F.coalesce("n", F.lit(0)).alias("n"))


def closing_within(markets: DataFrame, as_of, hours: int) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return markets.where((F.col("end_date") >= now) & (F.col("end_date") <= now + F.expr(f"INTERVAL {hours} HOURS"))).orderBy("end_date", "condition_id")


def route_market_events(stream: DataFrame) -> dict[str, DataFrame]:
    """One stream (value: JSON with event_type) as one stream for each known type; unknown types are left out."""
    schemas = {
        "book": "token_id string, bids array<struct<price:string,size:string>>, asks array<struct<price:string,size:string>>",
        "price_change": "token_id string, price double", "last_trade_price": "token_id string, price double, size double", "best_bid_ask": "token_id string, bid double, ask double",
        "tick_size_change": "token_id string, tick double", "market_resolved": "condition_id string, winner string",
    }
    kind = F.get_json_object("value", "$.event_type")
    return {k: stream.where(kind == k).select(F.from_json("value", schema).alias("x")).select("x.*") for k, schema in schemas.items()}
