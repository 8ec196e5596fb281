"""Statistics as aggregates and windows: correlation, ranking, ROC, calibration, resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, t_cdf
from ..sources.folders import cut
from .order import placed

Z95 = 1.96


def _corr(x: Column, y: Column) -> Column:
    """Pearson's r; null where x or y doesn't vary (the built-in divides by 0 there)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def _tail(r: Column, n: Column) -> dict[str, Column]:
    """p-value and Fisher interval of a correlation r over n rows."""
    t = F.abs(r) * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(clamp(2 * (1 - t_cdf(t, n - 2))))
    z = 0.5 * F.log((1 + r) / F.nullif(1 - r, F.lit(0.0)))
    half = Z95 / F.sqrt(F.nullif(n - 3, F.lit(0)))
    back = lambda v: (F.exp(2 * v) - 1) / (F.exp(2 * v) + 1)
    edge = F.abs(r) >= 0.9999
    return {
        "p_value": p,
        "ci_low": F.when(edge, F.lit(-1.0)).otherwise(F.greatest(F.lit(-1.0), back(z - half))),
        "ci_high": F.when(edge, F.lit(1.0)).otherwise(F.least(F.lit(1.0), back(z + half))),
    }


def _correlated(summed: DataFrame, r: Column, usable: Column) -> DataFrame:
    out = summed.withColumn("r", F.when(usable, r).otherwise(F.lit(0.0)))
    tail = _tail(F.col("r"), F.col("n"))
    none = {"p_value": 1.0, "ci_low": 0.0, "ci_high": 0.0}
    return out.withColumns({k: F.when(usable, v).otherwise(F.lit(none[k])) for k, v in tail.items()})


def point_biserial(df: DataFrame, x: Column, y: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Correlation of two flags with the sample deviation of y: n, r, p_value, ci_low, ci_high.

    Below 4 rows, or if x or y doesn't vary: r 0 and p 1.
    """
    a, b = x.cast("double"), y.cast("double")
    summed = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("n1"), F.stddev_samp(b).alias("s"), _corr(a, b).alias("c"))
    usable = (F.col("n") >= 4) & (F.col("n1") > 0) & (F.col("n1") < F.col("n")) & (F.coalesce("s", F.lit(0.0)) > 0)
    return _correlated(summed, clamp(F.col("c") * F.sqrt((F.col("n") - 1) / F.col("n")), -1.0, 1.0), usable).drop("n1", "s", "c")


def flag_counts(x: Column, y: Column) -> list[Column]:
    """Counts of two flags that their correlation is made of; they add up."""
    return [F.count(F.lit(1)).alias("n"), F.count_if(x).alias("nx"), F.count_if(y).alias("ny"), F.count_if(x & y).alias("nxy")]


def flag_correlation(counts: DataFrame) -> DataFrame:
    """point_biserial from flag_counts, in place of nx, ny and nxy."""
    n, x, y, both = (F.col(c).cast("double") for c in ("n", "nx", "ny", "nxy"))
    c = (both * n - x * y) / F.nullif(F.sqrt(x * (n - x)) * F.sqrt(y * (n - y)), F.lit(0.0))
    usable = (n >= 4) & (x > 0) & (x < n) & (y > 0) & (y < n)
    return _correlated(counts, clamp(c * F.sqrt((n - 1) / F.nullif(n, F.lit(0.0))), -1.0, 1.0), usable).drop("nx", "ny", "nxy")


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """Rank correlation in each group: n, r, p_value, ci_low, ci_high. Ties share their mean rank; rows with a null are left out.

    Ranks are of distinct values; pairs of values are counted before they meet their ranks. The mean
    rank is known, so sums are of deviations from it.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    pairs, mean = cut(pairs), (F.col("total") + 1) / 2
    for c in ("_x", "_y"):
        ranks = placed(pairs.groupBy(*by, c).agg(F.sum("_n").alias("m")), by, c)
        pairs = pairs.join(ranks.select(*by, c, (F.col("below") + (F.col("m") + 1) / 2 - mean).alias(f"_d{c}")), [*by, c])
    n, dx, dy = F.col("_n"), F.col("_d_x"), F.col("_d_y")
    summed = pairs.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"))
    summed = summed.withColumn("c", F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).drop("xy", "xx", "yy")
    return _correlated(summed, clamp("c", -1.0, 1.0), (F.col("n") >= 4) & F.col("c").isNotNull()).drop("c")


def auc(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve; equal scores share their rank. 0.5 where a class is missing.

    Scores are counted first, so that the window runs over distinct scores only.
    """
    return auc_of_counts(df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(label).cast("long")).alias("pos")), score, by)


def auc_of_counts(counts: DataFrame, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """auc from the number of rows (m) and of positive ones (pos) with each score."""
    below = F.sum("m").over(Window.partitionBy(*by).orderBy(score)) - F.col("m")
    ranked = counts.withColumn("rank", below + (F.col("m") + 1) / 2)
    summed = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("m").cast("double").alias("n"))
    value = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0.0))
    return summed.select(*by, F.coalesce(value, F.lit(0.5)).alias("auc"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """adjusted_p (step-up) and significant; the rows are few (one for each test), ties by key."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    order = Window.partitionBy().orderBy(p, key)
    raw = df.withColumn("_q", F.col(p) * n / F.row_number().over(order))
    back = Window.partitionBy().orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("adjusted_p", F.least(F.lit(1.0), F.min("_q").over(back))).drop("_q").withColumn("significant", F.col("adjusted_p") <= alpha)


def roc_curve(df: DataFrame, score: str, label: str, thresholds: int = 100) -> DataFrame:
    """threshold, tpr, fpr at thresholds 0, 1/n ... 1, from a histogram of the scores' steps."""
    step = F.greatest(F.lit(0), F.least(F.lit(thresholds), F.floor(F.col(score) * thresholds + 1e-9))).cast("int")
    counts = df.groupBy(step.alias("step")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((~F.col(label)).cast("long")).alias("q"))
    steps = df.sparkSession.range(thresholds + 1).select(F.col("id").cast("int").alias("step"))
    up = Window.partitionBy().orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    out = steps.join(counts, "step", "left").na.fill(0, ["p", "q"])
    return out.select(
        (F.col("step") / thresholds).alias("threshold"),
        (F.sum("p").over(up) / F.nullif(F.sum("p").over(whole), F.lit(0))).alias("tpr"),
        (F.sum("q").over(up) / F.nullif(F.sum("q").over(whole), F.lit(0))).alias("fpr"),
    )


def calibration_curve(df: DataFrame, predicted: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_predicted, mean_actual of the bins that hold rows."""
    bin_ = F.least(F.floor(F.col(predicted) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("mean_actual"))


# Constants of the multiplicative congruential hash of bootstrap weights, modulo a prime.
PRIME, FACTORS = 2_147_483_647, (1_103_515_245, 12_345, 48_271, 69_621)
#: Shares of the Poisson distribution with mean 1, summed: a weight is the number of them that a draw reaches.
POISSON = tuple(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(7))


def poisson_weights(keys: np.ndarray, resamples: int) -> np.ndarray:
    """Weight of each key (integers) in resamples 1, 2, ...: a hash of both as a Poisson draw."""
    a, b, c, d = FACTORS
    h = ((keys.astype(np.int64) % PRIME) * a % PRIME)[:, None] + np.arange(1, resamples + 1, dtype=np.int64)[None] * b
    h = h % PRIME * c % PRIME
    h = (h ^ (h >> 15)) % PRIME * d % PRIME
    return np.searchsorted(np.array(POISSON), h / PRIME, side="right")


def bootstrap_mean(df: DataFrame, value: str, key: str, by: tuple[str, ...] = (), resamples: int = 1000, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the mean: n, mean, ci_low, ci_high; nulls are left out.

    A Poisson bootstrap: each row's weight in each resample comes from a hash of its key, an integer,
    so that the result doesn't depend on partitions. A task sums all resamples of its rows as arrays;
    one pair of arrays for each task and group is shuffled.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.to_json(F.struct(*by)).alias("_by") if by else F.lit("").alias("_by"), F.col(key).cast("long").alias("_key"), F.col(value).cast("double").alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            flat = lambda k: pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * resamples), pa.array(np.concatenate([s[k] for s in sums.values()]) if sums else np.empty(0)))
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), flat(0), flat(1)], names=["_by", "_w", "_wx"])

        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                names = part.column("_by").dictionary_encode()
                code, x = names.indices.to_numpy(), part.column("_x").to_numpy()
                weights = poisson_weights(part.column("_key").to_numpy(), resamples).astype(np.float64)
                for k, name in enumerate(names.dictionary.to_pylist()):
                    mine = weights[code == k]
                    sums.setdefault(name, np.zeros((2, resamples)))
                    sums[name][0] += mine.sum(0)
                    sums[name][1] += x[code == k] @ mine
            if len(sums) > 256:
                yield told()
                sums = {}
        yield told()

    parts = rows.mapInArrow(run, "_by string, _w array<double>, _wx array<double>")
    many = parts.select("_by", F.posexplode(F.arrays_zip("_w", "_wx")).alias("_b", "_s")).groupBy("_by", "_b").agg((F.sum("_s._wx") / F.nullif(F.sum("_s._w"), F.lit(0.0))).alias("m"))
    side = (1 - confidence) / 2
    interval = many.groupBy("_by").agg(F.percentile("m", F.lit(side)).alias("ci_low"), F.percentile("m", F.lit(1 - side)).alias("ci_high"))
    plain = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return plain.withColumn("_by", F.to_json(F.struct(*by)) if by else F.lit("")).join(interval, "_by").drop("_by")


def rolling_stats(df: DataFrame, x: str, by: tuple[str, ...]) -> DataFrame:
    """n, sum, mean, median, mad, min, max, sample variance and deviation, quartiles of each group."""
    stats = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("std"), F.percentile(x, F.lit(0.25)).alias("q25"), F.percentile(x, F.lit(0.75)).alias("q75"),
    )
    spread = df.join(stats.select(*by, "median"), list(by)).groupBy(*by).agg(F.percentile(F.abs(F.col(x) - F.col("median")), F.lit(0.5)).alias("mad"))
    return stats.join(spread, list(by))


QUANTILES = (0.5, 0.95, 0.99, 0.999)


def quantile_sketch(df: DataFrame, x: str, by: tuple[str, ...]) -> DataFrame:
    """by, n, sketch: a mergeable sketch of each group, for quantiles and ranks over data that doesn't fit an exact one."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.expr(f"kll_sketch_agg_double({x})").alias("sketch"))


def sketch_quantiles(sketches: DataFrame) -> DataFrame:
    """The sketches with their estimated quantiles q5, q95, q99, q999."""
    return sketches.select("*", *(F.expr(f"kll_sketch_get_quantile_double(sketch, {q})").alias(f"q{str(q)[2:]}") for q in QUANTILES))


#: Steps in which ranks are read off a sketch, a power of two so that they are exact doubles.
RANKS = 256


def percentile_rank(df: DataFrame, sketches: DataFrame, x: str, by: tuple[str, ...]) -> DataFrame:
    """df's rows with percentile_rank: in percent, down to a RANKS-th, the share of their group that the sketch puts at or below x (null: no sketch)."""
    steps = ", ".join(repr(k / RANKS) for k in range(1, RANKS + 1))
    read = sketches.select(*by, F.expr(f"kll_sketch_get_quantile_double(sketch, array({steps}))").alias("_steps"))
    rank = F.size(F.filter("_steps", lambda v: v <= F.col(x))) / RANKS * 100
    return df.join(read, list(by), "left").withColumn("percentile_rank", F.when(F.col("_steps").isNotNull() & F.col(x).isNotNull(), rank)).drop("_steps")


#: Standard deviations of a number of wins up to which its distribution is summed, which takes REACH of them to either side.
SUMMED, REACH = 60.0, 12.0


def win_rate_interval(df: DataFrame, n: str, wins: str, confidence: float = 0.95) -> DataFrame:
    """df with ci_low and ci_high: the percentile interval of the bootstrapped win rate.

    A resample of n events with replacement has a binomial number of wins, so the interval's ends
    are quantiles of that distribution, which no resampling has to estimate. Work doesn't grow with
    n: a distribution of up to SUMMED deviations is summed term by term, a wider one is so smooth that
    the Cornish-Fisher expansion of its quantile, up to the fourth cumulant, is off by a win at most.
    """
    count = F.col(n).cast("double")
    certain = F.col(wins).isin(0) | (F.col(wins) == F.col(n))
    p = F.when(certain, F.lit(0.5)).otherwise(F.col(wins) / F.col(n))  # without both wins and losses there is nothing to sum
    mean, dev = count * p, F.sqrt(count * p * (1 - p))
    narrow = (dev <= SUMMED) & ~certain
    low = F.when(narrow, F.greatest(F.lit(0.0), F.floor(mean - REACH * (dev + 1)))).otherwise(0.0).cast("long")
    high = F.when(narrow, F.least(count, F.ceil(mean + REACH * (dev + 1)))).otherwise(0.0).cast("long")
    out = df.withColumns({"_p": p, "_low": low, "_terms": F.sequence(low, high)})

    def weights(sums: Column, step) -> Column:
        """Folds the terms' weights, relative to the first one's, which the last of them is no more than 1e70 above."""
        start = F.struct(F.lit(1.0).alias("w"), sums.alias("x"))
        after = lambda a, k: a["w"] * (F.col(n) - k) / (k + 1) * (F.col("_p") / (1 - F.col("_p")))
        return F.aggregate("_terms", start, lambda a, k: F.struct(after(a, k).alias("w"), step(a["x"], a["w"]).alias("x")), lambda a: a["x"])

    out = out.withColumn("_all", weights(F.lit(0.0), lambda x, w: x + w))

    def quantile(q: float) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k"))
        met = weights(start, lambda x, w: F.struct((x["sum"] + w).alias("sum"), (x["k"] + (x["sum"] + w < F.lit(q) * F.col("_all")).cast("long")).alias("k")))
        z = NormalDist().inv_cdf(q)
        skew, excess = (1 - 2 * F.col("_p")) / dev, (1 - 6 * F.col("_p") * (1 - F.col("_p"))) / (dev * dev)
        wide = mean + dev * (z + (z * z - 1) / 6 * skew + (z**3 - 3 * z) / 24 * excess - (2 * z**3 - 5 * z) / 36 * skew * skew)
        return F.when(certain, F.col(wins) / F.col(n)).when(narrow, (F.col("_low") + met["k"]) / count).otherwise(F.ceil(wide - 0.5) / count)

    side = (1 - confidence) / 2
    return out.withColumns({"ci_low": quantile(side), "ci_high": quantile(1 - side)}).drop("_p", "_low", "_terms", "_all")


def information_ratio(daily: DataFrame, by: str, day: str, n: str, wins: str, price_sum: str) -> DataFrame:
    """Mean over deviation of weekly edges; a week starts with the first day with events that is 7 days after the last start.

    daily: one row for each `by` and day. Weeks restart at days with events, so this is a fold over
    each group's days in order, of which there are as many as the calendar has. Weeks below 3
    events and the last, open one don't count; below 10 events or 2 weeks the ratio is 0.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.unix_date(day).alias("t"), F.col(n).cast("double").alias("n"), F.col(wins).cast("double").alias("w"), F.col(price_sum).alias("p"))))
    grouped = daily.groupBy(by).agg(rows.alias("rows"), F.sum(n).alias("n"))
    none = F.array().cast("array<double>")
    start = F.struct(F.col("rows")[0]["t"].alias("start"), F.lit(0.0).alias("n"), F.lit(0.0).alias("w"), F.lit(0.0).alias("p"), none.alias("edges"))

    def step(acc: Column, x: Column) -> Column:
        new = x["t"] - acc["start"] >= 7
        edge = F.when(acc["n"] >= 3, F.array(acc["w"] / acc["n"] - acc["p"] / acc["n"])).otherwise(none)
        return F.struct(
            F.when(new, x["t"]).otherwise(acc["start"]).alias("start"),
            *((F.when(new, x[c]).otherwise(acc[c] + x[c])).alias(c) for c in ("n", "w", "p")),
            F.when(new, F.concat(acc["edges"], edge)).otherwise(acc["edges"]).alias("edges"),
        )

    edges = grouped.select(by, "n", F.aggregate("rows", start, step)["edges"].alias("edges"))
    mean = F.aggregate("edges", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("edges"), F.lit(0))
    edges = edges.withColumn("mean", mean)
    var = F.aggregate("edges", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.nullif(F.size("edges") - 1, F.lit(0))
    ratio = F.col("mean") / F.nullif(F.sqrt(var), F.lit(0.0))
    return edges.select(by, F.when((F.col("n") < 10) | (F.size("edges") < 2), F.lit(0.0)).otherwise(F.coalesce(ratio, F.lit(0.0))).alias("information_ratio"))
