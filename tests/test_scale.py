"""Operators that split hot keys, on small inputs with one hot key, against plain Python."""

import math
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mktlens.operators import buckets as B
from mktlens.operators import features as X
from mktlens.operators import models, monitoring
from mktlens.operators import order as O
from mktlens.operators import portfolio as P
from mktlens.operators import scan
from mktlens.operators import statistics as ST
from mktlens.sources import folders
from mktlens.sources import normalize as N

DAY = 1_704_067_200


def trades_of(spark, rows):
    """rows: trade_id, token, second, notional."""
    made = [(i, t, float(s), float(v)) for i, t, s, v in rows]
    return spark.createDataFrame(made, "trade_id long, token_id string, s double, notional double").select("trade_id", "token_id", F.timestamp_micros((F.lit(DAY * 1_000_000) + F.col("s") * 1_000_000).cast("long")).alias("ts"), "notional")


@pytest.fixture(scope="module")
def hot():
    """A token with most of the trades of two days, ties in time and size among them; and a few others."""
    rng = random.Random(4)
    rows = [(i, "hot", rng.choice((rng.randrange(172_800), 3600 * rng.randrange(48))), rng.choice((rng.randrange(1, 60) * 100.0, 9000.0))) for i in range(900)]
    return rows + [(1000 + i, f"cold{i % 7}", rng.randrange(172_800), 10.0 * i) for i in range(40)]


def test_frame_statistics(spark, hot):
    got = {r["trade_id"]: r for r in X.frame_statistics(trades_of(spark, hot)).collect()}
    assert len(got) == len(hot)
    for i, token, s, v in hot:
        frame = [(x, k) for k, t, at, x in hot if t == token and s - 3600 <= at <= s]
        values, r = sorted(x for x, _ in frame), got[i]
        middle = statistics.median(values)
        expected = (len(values), middle, statistics.median(abs(x - middle) for x in values), np.quantile(values, 0.95), np.quantile(values, 0.99), sum(x < v for x in values))
        assert tuple(r[2:8]) == pytest.approx(expected)
        assert r["trigger_ids"] == [k for x, k in sorted(frame, reverse=True)[:3] if x >= 5000 and x >= np.quantile(values, 0.95)]


@pytest.mark.parametrize("times", [[5.0], [0.0, 0.0, 0.0], [100.0 * k for k in range(40)], [0.25 * k for k in range(2000)]])
def test_intensity_by_blocks(spark, times):
    got = {r["trade_id"]: r["intensity"] for r in X.hawkes_intensity(trades_of(spark, [(i, "a", s, 1) for i, s in enumerate(times)])).collect()}
    for i, t in enumerate(times):
        assert got[i] == pytest.approx(0.1 + 0.5 * sum(math.exp(-0.1 * (t - s)) for s in times if s <= t), rel=1e-9)


def test_as_of_book_over_segments(spark, hot):
    rng = random.Random(5)
    books = [(k, rng.choice(("hot", "cold1")), float(rng.choice((rng.randrange(172_800), 40_000))), float(k)) for k in range(60)]
    made = spark.createDataFrame(books, "snapshot_id long, token_id string, s double, mid double").withColumn("ts", F.timestamp_micros((F.lit(DAY * 1_000_000) + F.col("s") * 1_000_000).cast("long")))
    got = {r["trade_id"]: r["mid"] for r in X.as_of_book(trades_of(spark, hot), made, ("mid",)).collect()}
    for i, token, s, _ in hot:
        assert got[i] == max(((at, k) for k, t, at, _ in books if t == token and at <= s), default=(None, None))[1]


def test_running_totals_over_segments(spark, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT_IDS", 5)
    rng = random.Random(6)
    rows = [(i, "hot" if i % 9 else "cold", DAY + 86_400 * rng.randrange(3), rng.choice((-900.0, -50.0, -50.0, -50.0, 0.0, 400.0))) for i in range(200)]
    closed = spark.createDataFrame(rows, "trade_id long, key string, s long, pnl double").withColumn("exit_ts", F.timestamp_seconds("s"))
    got = {r["trade_id"]: r for r in P.running(closed, "key").collect()}
    for key in ("hot", "cold"):
        bank = peak = 10_000.0
        worst = run = 0
        for i, _, _, pnl in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            bank += pnl
            peak = max(peak, bank)
            worst, run = max(worst, (peak - bank) / peak), run + 1 if pnl < 0 else 0
            r = got[i]
            assert (r["bankroll"], r["peak"], r["drawdown"], r["max_drawdown"], r["losses_in_row"]) == pytest.approx((bank, peak, (peak - bank) / peak, worst, run))


@pytest.fixture(scope="module")
def series():
    """A hot key whose level shifts, one of equal values at first, one with nulls, and short ones: key, place, value."""
    rng = random.Random(8)
    rows = [("hot", k, rng.gauss(0.5, 0.2) + (0.3 if k > 400 else 0.0)) for k in range(700)]
    rows += [("flat", k, 0.1 if k < 50 else 0.1 + rng.random()) for k in range(90)]
    rows += [("gaps", k, None if k % 5 == 0 else rng.random()) for k in range(80)]
    return rows + [(f"short{n}", k, rng.random()) for n in range(1, 8) for k in range(n)]


def of_key(series):
    return {key: [x for k, _, x in series if k == key] for key, _, _ in series}


def test_cusum_over_segments(spark, series):
    mixed = random.Random(1).sample(series, len(series))
    got = {r["key"]: r for r in X.cusum(spark.createDataFrame(mixed, "key string, place int, x double"), "key", "place", "x").collect()}
    assert set(got) == set(of_key(series))
    for key, xs in of_key(series).items():
        seen, s, change = [], 0.0, None
        for x in (x for x in xs if x is not None):
            seen.append(x)
            dev = statistics.stdev(seen) if len(seen) > 1 else 0.0
            s = max(0.0, s + ((x - statistics.fmean(seen)) / dev if dev > 1e-12 else 0.0))
            change = change or (len(seen) if s > 5 else None)
        assert (got[key]["n"], got[key]["change_at"]) == (len(seen), change), key
        assert got[key]["statistic"] == pytest.approx(s, abs=1e-6), key
        last_above = seen[-1] > statistics.fmean(seen)
        assert got[key]["direction"] == ("none" if s < 2 else "increase" if last_above else "decrease")


def test_page_hinkley_over_segments(spark, series):
    known = [(key, k, x) for key, xs in of_key([r for r in series if r[2] is not None]).items() for k, x in enumerate(xs)]
    rows = spark.createDataFrame(random.Random(2).sample(known, len(known)), "key string, place int, x double")
    got = {r["key"]: r for r in monitoring.page_hinkley(rows, "key", "x", "place").collect()}
    assert set(got) == {key for key, xs in of_key(known).items() if len(xs) >= 5}
    for key, r in got.items():
        xs = of_key(known)[key]
        target = statistics.fmean(xs[: len(xs) // 3])
        plus = minus = most = least = 0.0
        change = None
        for k, x in enumerate(xs):
            plus, minus = max(0.0, plus + x - target - 0.01), max(0.0, minus + target - x - 0.01)
            most, least = max(most, plus), max(least, minus)
            change = k if change is None and max(plus, minus) > 0.5 else change
        assert (r["n"], r["change_at"], r["changed"]) == (len(xs), change, change is not None), key
        assert (r["max_plus"], r["max_minus"]) == pytest.approx((most, least)), key


@pytest.mark.parametrize("rows_in_block", [16, 4096])
def test_rolling_win_rate_over_blocks(spark, monkeypatch, rows_in_block):
    """Ties in time, events that aren't resolved, groups that are too small."""
    monkeypatch.setattr(scan, "BLOCK_ROWS", rows_in_block)
    rng = random.Random(9)
    rows = [(i, "hot" if i % 5 else f"cold{i // 5 % 2}", DAY + rng.randrange(300), rng.choice((True, True, False, None))) for i in range(600)]
    rows += [(1000 + i, "exact", DAY + i, i % 3 == 0) for i in range(20)] + [(2000 + i, "few", DAY + i, True) for i in range(19)]
    events = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), "trade_id long, strategy_id string, s long, outcome_won boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["trade_id"]: (r["strategy_id"], r["k"], r["win_rate"]) for r in monitoring.rolling_win_rate(events, "strategy_id").collect()}
    expected = {}
    for key in {r[1] for r in rows}:
        known = sorted((s, i, won) for i, k, s, won in rows if k == key and won is not None)
        for n in range(10, len(known) + 1) if len(known) >= 20 else ():
            expected[known[n - 1][1]] = (key, n - 10, pytest.approx(sum(won for *_, won in known[n - 10 : n]) / 10))
    assert got == expected and len({x[0] for x in expected.values()}) >= 3


def test_ema_over_segments(spark, series):
    known = [r for r in series if r[2] is not None] + [("hot", 699, 0.01), ("hot", 0, 0.9)]  # rows of one place count in the order of x
    got = {r["key"]: r for r in X.ema(spark.createDataFrame(random.Random(3).sample(known, len(known)), "key string, place long, x double"), "key", "place", "x", 0.2).collect()}
    for key in of_key(known):
        xs = [x for _, x in sorted((k, x) for one, k, x in known if one == key)]
        value = xs[0]
        for x in xs[1:]:
            value += 0.2 * (x - value)
        assert (got[key]["n"], got[key]["ema"]) == (len(xs), pytest.approx(value)), key
    assert X.ema(spark.createDataFrame([], "key string, place long, x double"), "key", "place", "x").count() == 0


def test_segments_of_ranks_are_even_and_grow(spark, series):
    rows = scan.by_rank(spark.createDataFrame(series, "key string, place int, x double"), ["key"], "place").where("key = 'hot'").toPandas().sort_values("place")
    assert rows["_segment"].is_monotonic_increasing and rows["_segment"].nunique() == scan.PARTS
    assert rows.groupby("_segment").size().max() <= 2 * len(rows) / scan.PARTS


def test_logistic_report_is_the_optimum(spark):
    """Newton's method over the first 60 percent of the days gives the same weights; every part has its area."""
    rng = np.random.default_rng(7)
    n = 400
    x = np.column_stack([rng.random(n), rng.random(n), rng.normal(size=n), rng.normal(size=n) / 10, rng.normal(size=n), rng.random(n), rng.integers(0, 2, n), rng.integers(0, 2, n)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 2] + x[:, 7] - 1)))).astype(float)
    day = np.arange(n) // 40
    rows = [(int(DAY + 86_400 * d), float(r[0]), float(r[1]), float(r[2]), float(r[3]), float(r[4] * 100_000), float(r[5] * 1440), bool(r[6]), bool(r[7]), bool(label)) for d, r, label in zip(day, x, y, strict=True)]
    rows += [(DAY, 0.5, 0.5, 0.0, 0.0, 0.0, 1.0, False, False, None)] * 5  # not resolved
    columns = "s long, price double, size_percentile double, size_zscore double, price_trend_30m double, ofi_30m double, minutes_before_close double, is_tail boolean, is_against_ofi boolean, outcome_won boolean"
    events = spark.createDataFrame(rows, columns).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {r["name"]: r["value"] for r in models.logistic_report(events).collect()}
    train = day < 6
    a, t, w = np.column_stack([x[train], np.ones(train.sum())]), y[train], np.zeros(9)
    ridge = np.r_[np.full(8, 0.01), 0.0]
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(t) + np.diag(ridge), a.T @ (p - t) / len(t) + ridge * w)
    assert [got[f"weight_{c}"] for c in models.FEATURES] == pytest.approx(w[:8].tolist(), abs=2e-3)
    for name, chosen in {"train": train, "validation": (day >= 6) & (day < 8), "test": day >= 8}.items():
        score = x[chosen] @ w[:8]
        won, lost = score[y[chosen] == 1], score[y[chosen] == 0]
        assert got[f"auc_{name}"] == pytest.approx((won[:, None] > lost[None]).mean(), abs=5e-3)
    assert models.logistic_report(events.limit(40)).count() == 0


def test_frames_reach_over_segments(spark, hot):
    rows = scan.in_segments(trades_of(spark, hot), F.unix_micros("ts"), 1800, 600)
    assert scan.own(rows).count() == len(hot) and rows.where("_own").count() == len(hot)
    assert rows.groupBy("trade_id").count().agg(F.max("count")).first()[0] <= 3


def folded(rows, size):
    out, key, total = [], None, 0.0
    for k, before, v, b in rows:
        if k != key:
            key, total, sums = k, 0.0, None
        if sums is None:
            sums = [k, before, 0.0, 0.0]
            out.append(sums)
        sums[2 if b else 3] += v
        if sums[2] + sums[3] >= size:
            sums = None
    return sorted(tuple(r) for r in out if r[2] + r[3] > 0)


@pytest.mark.parametrize("seed", range(4))
def test_volume_buckets_are_the_fold(spark, seed):
    rng = random.Random(seed)
    sizes = [lambda: rng.randrange(1, 40), lambda: rng.choice((0, 1, 10, 50)), lambda: rng.choice((1, 7, 30, 5000)), lambda: 10][seed]
    rows = [(i, "hot" if rng.random() < 0.8 else f"k{rng.randrange(3)}", rng.randrange(20_000), sizes(), rng.random() < 0.5) for i in range(700)]
    made = spark.createDataFrame([(i, k, s, float(v), "Yes" if b else "No", 0.9) for i, k, s, v, b in rows], "trade_id long, k string, s long, notional double, outcome string, price double").withColumn("ts", F.timestamp_seconds(F.col("s") + DAY))
    ordered, before = [], {}
    for i, k, s, v, b in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        ordered.append((k, before.get(k, 0), v, b))
        before[k] = before.get(k, 0) + v
    for span in (2, 64):
        got = sorted((r["k"], r["bucket"], r["buy"], r["sell"]) for r in B.volume_buckets(made, "k", 50.0, span).collect())
        assert got == folded(ordered, 50)


def test_places_and_quantiles(spark):
    rng = random.Random(8)
    rows = [("a", rng.choice((1.0, 1.0, 1.0, 2.0, float(rng.randrange(500))))) for _ in range(600)] + [("b", 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    placed = O.placed(O.value_counts(df, ("k",), "x"), ("k",), "x", parts=7)
    values = {k: sorted(x for j, x in rows if j == k and x is not None) for k in "ab"}
    for r in placed.collect():
        assert (r["below"], r["total"]) == (sum(x < r["x"] for x in values[r["k"]]), len(values[r["k"]]))
    for q in (0.0, 0.3, 0.5, 1.0):
        got = {r["k"]: r["v"] for r in O.quantile(placed, ("k",), "x", q, "v").collect()}
        assert got == {k: pytest.approx(np.quantile(v, q)) for k, v in values.items()}


def test_spearman_with_ties(spark):
    rng = random.Random(9)
    rows = [("a", float(rng.randrange(9)), float(rng.randrange(5))) for _ in range(300)] + [("b", 1.0, 1.0)] * 5
    got = {r["k"]: r for r in ST.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ("k",)).collect()}
    rank = lambda v: np.array([(np.sum(v < x) + np.sum(v <= x) + 1) / 2 for x in v])
    x, y = (np.array([r[c] for r in rows if r[0] == "a"]) for c in (1, 2))
    assert got["a"]["r"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and got["a"]["n"] == 300
    assert (got["b"]["r"], got["b"]["p_value"]) == (0.0, 1.0)


def test_interval_of_any_number_in_constant_work(spark):
    cases = spark.createDataFrame([(10**10, 3 * 10**9), (10**10, 7), (10**8, 10**8 - 3), (5, 2)], "n long, wins long")
    ST.win_rate_interval(cases, "n", "wins").collect()
    start = time.time()
    got = {(r["n"], r["wins"]): r for r in ST.win_rate_interval(cases, "n", "wins").collect()}
    assert time.time() - start < 2
    r, dev = got[10**10, 3 * 10**9], math.sqrt(0.3 * 0.7 / 10**10)
    assert (r["ci_low"], r["ci_high"]) == (pytest.approx(0.3 - 1.959964 * dev, abs=1e-9), pytest.approx(0.3 + 1.959964 * dev, abs=1e-9))
    assert got[10**10, 7]["ci_low"] == pytest.approx(2e-10) and got[10**10, 7]["ci_high"] == pytest.approx(13e-10)  # Poisson quantiles


def test_expansion_meets_the_sum(spark, monkeypatch):
    cases = spark.createDataFrame([(40_000, 11_000), (100_000, 300), (9_999, 5_000), (60_000, 59_000)], "n long, wins long")
    both = []
    for limit in (1e9, 0.0):
        monkeypatch.setattr(ST, "SUMMED", limit)
        both.append({(r["n"], r["wins"]): (r["ci_low"], r["ci_high"]) for r in ST.win_rate_interval(cases, "n", "wins").collect()})
    for (n, _), (low, high) in ((k, v) for k, v in both[0].items()):
        other = both[1][n, _]
        assert abs(other[0] - low) <= 1.01 / n and abs(other[1] - high) <= 1.01 / n


def test_resampled_means_don_t_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 2, 400)
    df = spark.createDataFrame([(i, f"k{i % 2}", float(v)) for i, v in enumerate(x)] + [(1000, "k0", None)], "i long, k string, v double")
    one, two = (sorted(map(tuple, ST.bootstrap_mean(df.repartition(n), "v", "i", ("k",)).collect())) for n in (1, 7))
    assert [r[:2] for r in one] == [r[:2] for r in two] and [r[2:] for r in one] == [pytest.approx(r[2:]) for r in two]
    for k, n, mean, low, high in one:
        mine = x[int(k[1]) :: 2]
        half = 1.96 * mine.std() / math.sqrt(len(mine))
        assert n == 200 and mean == pytest.approx(mine.mean()) and low == pytest.approx(mean - half, abs=0.08) and high == pytest.approx(mean + half, abs=0.08)
    assert ST.bootstrap_mean(df, "v", "i").count() == 1


def test_replayed_batches_add_nothing(spark, tmp_path):
    table, rows = f"{tmp_path}/t", lambda a, b: spark.range(a, b)
    assert N.append(rows(0, 3), table, "one") and not N.append(rows(0, 3), table, "one")
    (tmp_path / "t" / "_pending-x").mkdir()  # of a batch that failed half-way
    assert N.append(rows(3, 5), table, "two")
    assert sorted((r["id"], r["batch"]) for r in N.appended(spark, table).collect()) == [(0, "one"), (1, "one"), (2, "one"), (3, "two"), (4, "two")]
    rows(0, 4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    N.append_stream(stream, f"{tmp_path}/s", f"{tmp_path}/one")
    N.append_stream(stream, f"{tmp_path}/s", f"{tmp_path}/two")  # as if the first run had failed before its commit: the batch comes again
    assert N.appended(spark, f"{tmp_path}/s").count() == 4


def test_scratch_folders_go(spark):
    before = set(folders.names(spark, folders.shared(spark)))
    assert folders.cut(spark.range(3)).count() == 3 and set(folders.names(spark, folders.shared(spark))) > before
    folders.clear(spark)
    assert not [n for n in folders.names(spark, folders.shared(spark)) if n.startswith(("table-", "stream-", "reports-"))]
