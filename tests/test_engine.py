"""Operators on small inputs, against plain Python and known values."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mktlens import plans
from mktlens.functions import decisions as D
from mktlens.functions import numeric as N
from mktlens.functions import scores as S
from mktlens.operators import features as X
from mktlens.operators import monitoring as M
from mktlens.operators import performance as P
from mktlens.operators import statistics as ST
from mktlens.sources import normalize as Z

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("usd,expected", [(25, 0.0), (3000, 0.0), (7000, 0.5), (13000, 0.75), (70000, 1.0)])
def test_dollar_floor(spark, usd, expected):
    assert one(spark, S.dollar_floor(F.lit(float(usd)))) == expected


@pytest.mark.parametrize("days,expected", [(3.0, 1.0), (None, 0.5), (20.0, 0.7), (100.0, 0.3), (400.0, 0.0)])
def test_wallet_age(spark, days, expected):
    assert one(spark, S.wallet_age_score(F.lit(days).cast("double"))) == expected


def test_functions(spark):
    assert one(spark, N.round_half_up(F.lit(-2.5))) == -2.0
    assert abs(one(spark, N.normal_cdf(F.lit(1.96))) - 0.975) < 1e-4
    assert one(spark, N.change(F.lit(1.0), F.lit(0.0))) == math.inf
    assert one(spark, N.time_ramp(F.lit(None).cast("double"))) == 1.0
    assert one(spark, S.triple_signal(F.lit(0.95), F.lit(0.95), F.lit(0.93), F.lit(1.0), F.lit(0.0)))
    assert one(spark, D.direction(F.lit(-0.5), F.lit(0.9))) == "NO"
    assert one(spark, D.limit_price(F.lit("YES"), F.lit(0.5), F.lit(0.985), F.lit(200.0))) == 0.99


def test_cusum_is_the_recursion(spark):
    rng = random.Random(1)
    xs = [rng.gauss(0, 1) + (2 if i > 60 else 0) for i in range(120)]
    got = X.cusum(spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, i int, x double"), "k", "i", "x").first()
    total = squares = s = 0.0
    change = None
    for n, x in enumerate(xs, 1):
        total, squares = total + x, squares + x * x
        dev = math.sqrt(max(0.0, (squares - total * total / n) / (n - 1))) if n > 1 else 0.0
        s = max(0.0, s + ((x - total / n) / dev if dev > 1e-12 else 0.0))
        change = change or (n if s > 5 else None)
    assert abs(got["statistic"] - s) < 1e-9 and got["change_at"] == change


def test_page_hinkley_is_the_recursion(spark):
    xs = [0.5] * 30 + [0.9] * 30
    got = M.page_hinkley(spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, i int, x double"), "k", "x", "i").first()
    plus, first = 0.0, None
    for i, x in enumerate(xs):
        plus = max(0.0, plus + x - 0.5 - 0.01)
        first = i if first is None and plus > 0.5 else first
    assert got["change_at"] == first and abs(got["max_plus"] - plus) < 1e-9


def test_auc_shares_ranks(spark):
    rows = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False)], "s double, y boolean")
    assert ST.auc(rows, "s", "y").first()["auc"] == pytest.approx(0.875)


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double")
    got = {r["k"]: r["adjusted_p"] for r in ST.benjamini_hochberg(rows, "p", "k").collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.16 / 3, "c": 0.16 / 3, "d": 0.5})


def test_metrics_of_nothing(spark):
    rows = spark.createDataFrame([], "outcome_won boolean, notional double, price double")
    got = P.pnl_metrics(rows).first()
    assert (got["n"], got["roi"], got["kelly"], got["profit_factor"]) == (0, 0.0, 0.0, 0.0)


def test_pareto(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("b", 2.0, 1.0, 1.0), ("c", 0.0, 3.0, 0.0)], "config_id string, roi double, sharpe double, win_rate double")
    assert {r["config_id"] for r in P.pareto(rows, ("roi", "sharpe", "win_rate")).collect()} == {"b", "c"}
    five = rows.selectExpr("config_id", "roi AS pnl", "roi", "sharpe AS profit_factor", "win_rate AS edge_points", "sharpe")
    assert {r["config_id"] for r in P.pareto(five).collect()} == {"b", "c"}


def test_recalibrated_kelly(spark):
    stake = lambda b, w, n: one(spark, M.recalibrated_kelly(F.lit(b), F.lit(w), F.lit(n)))
    assert stake(0.2, 0.9, 10) == 0.2 and stake(0.2, 0.9, 50) == pytest.approx(0.3) and stake(0.2, 0.4, 50) == pytest.approx(0.1)


def test_join_date(spark):
    rows = spark.createDataFrame([(1, "x Joined March 2023 0x" + "ab" * 20), (2, "since 2022-05-06"), (3, "none"), (4, None)], "page_id long, html string")
    got = {r["page_id"]: (str(r["joined"]), r["address"]) for r in Z.extract_join_date(rows).collect()}
    assert got == {1: ("2023-03-01", "0x" + "ab" * 20), 2: ("2022-05-06", None), 3: ("None", None), 4: ("None", None)}


def rows_of(frame):
    c = sorted(frame.columns)
    values = frame[c].astype(object).where(frame[c].notna(), None).values.tolist()
    return sorted((tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in row) for row in values), key=str)


CHECKED = ["a5_correlation_summary", "w24_contrarian_events", "a24_grid_search_all", "a25_information_ratio", "a9_w13_breakdown_liquidity", "st2_tumbling_bars", "a10_vpin", "f15_f19_scores", "f20_f21_decisions", "w16_w17_running_bankroll", "j3_as_of_book", "st1_ingest", "p1_market_filter", "s10_historical_trades", "s5_route_market_events", "s13_append", "a32_percentile_rank", "a32_quantile_sketch", "a30_incremental_report", "w19_post_trade_impact", "w7_j6_j7_price_and_flow", "w11_hawkes_intensity", "w1_w4_rolling_size", "w21_triggering_trades", "w6_size_ranks", "a22_impact_by_size", "a14_resampled_means", "st4_token_state"]


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = plans.queries()[name](spark, SF).toPandas(), con.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and len(got) == len(expected)
    assert rows_of(got) == rows_of(expected)


def _with_events(spark, tmp_path, events):
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    for path in Path(sf).glob("*.parquet"):
        if path.name != "events.parquet":
            (tmp_path / path.name).symlink_to(path)
    events(spark.read.parquet(f"{sf}/events.parquet")).write.option("maxRecordsPerFile", 60).parquet(f"{tmp_path}/events.parquet")
    return sf


def test_streams_read_folders_of_many_files(spark, tmp_path):
    from mktlens.plans.streams import st1, st2

    # in the order of time, as late trades are dropped
    sf = _with_events(spark, tmp_path, lambda events: events.coalesce(1).sortWithinPartitions("ts"))
    for stream in (st1, st2):
        one, many = (sorted(map(str, stream(spark, d).collect())) for d in (sf, str(tmp_path)))
        assert one == many and one


@pytest.mark.parametrize("late", [None, 3])
def test_scores_do_not_depend_on_how_trades_are_dealt(spark, tmp_path, late, monkeypatch):
    from datetime import timedelta

    from mktlens.plans.streams import st7
    from mktlens.streaming import streams as ST

    deal = (lambda events: events.repartition(4, F.col("event_id") % 4)) if late is None else (lambda events: events.coalesce(1).sortWithinPartitions("ts"))
    sf = _with_events(spark, tmp_path, deal)
    whole, rescored, deleted = ST.trade_stream, ST.rescored, []
    one = sorted(map(str, st7(spark, sf).collect()))
    monkeypatch.setattr(ST, "trade_stream", lambda spark, d: whole(spark, d, files=6))
    if late is not None:
        delete = ST.folders.delete
        monkeypatch.setattr(ST, "rescored", lambda *a: rescored(*a, late=timedelta(hours=late)))
        monkeypatch.setattr(ST.folders, "delete", lambda spark, folder: (deleted.append(folder), delete(spark, folder)))
    assert one == sorted(map(str, st7(spark, str(tmp_path)).collect())) and one
    assert bool(deleted) == (late is not None)


def test_ordered_streams_read_shuffled_files_alike(spark, tmp_path):
    from mktlens.plans.streams import st6, st8

    sf = _with_events(spark, tmp_path, lambda events: events.repartition(40, F.hash("event_id")))
    for stream in (st6, st8):
        one, many = (sorted(map(str, stream(spark, d).collect())) for d in (sf, str(tmp_path)))
        assert one == many and one


def test_silence_is_the_freshness_gate(spark):
    """What a stream has told by an instant is what the batch rule says of that instant, though no row comes for silent tokens."""
    from datetime import datetime

    from mktlens.operators.features import book_metrics
    from mktlens.operators.filters import freshness_gate
    from mktlens.plans.streams import LIMITS_MS, replayed_tokens
    from mktlens.sources import views as V
    from mktlens.streaming import ordered as OR

    until = datetime(2024, 1, 15, 12)
    told = replayed_tokens(spark, SF, OR.Silence(LIMITS_MS), until).collect()
    now = F.lit(until).cast("timestamp")
    books = book_metrics(V.book_levels(spark, SF)).where("mid is not null").where(F.col("ts") < now).groupBy("token_id").agg(F.max(F.unix_micros("ts")).alias("book"))
    trades = V.trades(spark, SF).where(F.col("ts") < now).groupBy("token_id").agg(F.max(F.unix_micros("ts")).alias("trade"))
    age = lambda c: (F.unix_micros(now) - F.col(c)) / 1000
    last = books.join(trades, "token_id", "full").withColumns({"book_age_ms": age("book"), "trade_age_ms": age("trade"), "end_date": now})
    expected = {(r["token_id"], kind) for r in freshness_gate(last).collect() for kind in r["stale"].split(",") if kind}
    latest = {r["token_id"]: {"orderbook": r["book"], "trades": r["trade"]} for r in last.collect()}
    got = {(r["token_id"], r["kind"]) for r in told if latest[r["token_id"]][r["kind"]] == r["last_us"]}
    assert got == expected and len(got) > 50


def test_late_rows_are_counted(spark, tmp_path):
    from mktlens.streaming import streams as ST

    rows = lambda *times: spark.createDataFrame([(k, t, "a", 1.0, 1.0) for k, t in enumerate(times)], "trade_id long, ts string, token_id string, notional double, price double").withColumn("ts", F.col("ts").cast("timestamp"))
    # a batch is held against the watermark that the batch before it began with
    for name, part in (("a", rows("2024-01-01 12:00:00")), ("b", rows("2024-01-01 12:01:00")), ("c", rows("2024-01-01 12:02:00", "2024-01-01 08:00:00"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    schema = spark.read.parquet(f"{tmp_path}/a").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/[abc]")
    query = ST.tumbling_bars(stream).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("noop").start()
    query.awaitTermination()
    assert ST.late_rows(query) == 1


def test_win_rate_interval_is_that_of_resamples(spark):
    import numpy as np

    from mktlens.operators.statistics import win_rate_interval

    cases = [(1, 1), (10, 0), (10, 3), (500, 137), (40000, 39990)]
    rng = np.random.default_rng(0)
    for r in win_rate_interval(spark.createDataFrame(cases, "n long, wins long"), "n", "wins").collect():
        low, high = np.percentile(rng.binomial(r["n"], r["wins"] / r["n"], 200_000) / r["n"], [2.5, 97.5])
        assert abs(r["ci_low"] - low) <= 1 / r["n"] and abs(r["ci_high"] - high) <= 1 / r["n"]
