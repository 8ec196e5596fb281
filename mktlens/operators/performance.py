"""Win and loss metrics of events, correlation summaries, breakdowns, grids and strategy comparisons."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf
from ..params import EventFilter, Grid
from .events import contrarian_flag, filter_events
from .features import as_of_book
from .statistics import auc_of_counts, benjamini_hochberg, flag_correlation, information_ratio, point_biserial, win_rate_interval


def won() -> Column:
    """Whether the event's outcome won; null while unresolved."""
    return F.col("outcome_won")


def _sum_if(c: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))


def metric_sums(outcome: Column | None = None) -> list[Column]:
    """Sums over resolved events that all metrics are made of; they combine map-side, and from cell to cell.

    Prices have few digits, so their sums are exact decimals, whatever order they are taken in. So
    are sums of money; configurations that the same events satisfy have equal P&L.
    """
    y = won() if outcome is None else outcome
    gain = F.when(y, 1 - F.col("price")).when(~y, -F.col("price"))
    return [
        F.count(y).alias("n"),
        F.count_if(y).alias("wins"),
        *_money("total_notional", y.isNotNull(), F.col("notional")),
        *_money("win_pnl", y, F.col("notional") * (1 - F.col("price"))),
        *_money("loss_pnl", ~y, -F.col("notional") * F.col("price")),
        _exact(F.when(y.isNotNull(), F.col("price"))).alias("price_sum"),
        _sum_if(y.isNotNull(), F.col("price") * F.col("notional")).alias("price_notional"),
        _exact(gain).alias("return_sum"),
        _sum_if(y.isNotNull(), gain * gain).alias("return_squares"),
        F.min(gain).alias("return_min"),
        F.max(gain).alias("return_max"),
    ]


def _exact(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("decimal(18,8)")), F.lit(0).cast("decimal(28,8)"))


MONEY = ("total_notional", "win_pnl", "loss_pnl")


def _money(name: str, c: Column, x: Column) -> list[Column]:
    """The exact sum of x where c, and in <name>_rest that of doubles with more than 8 decimal places, NaN and infinite ones."""
    number = x.try_cast("decimal(27,8)")
    few = F.coalesce(F.abs(x - number.cast("double")) <= F.abs(x) * 1e-12, F.lit(False))
    return [F.coalesce(F.sum(F.when(c & few, number)), F.lit(0).cast("decimal(37,8)")).alias(name), _sum_if(c & ~few, x).alias(f"{name}_rest")]


def combined_sums() -> list[Column]:
    """metric_sums of groups of groups."""
    plain = ("n", "wins", *MONEY, *(f"{m}_rest" for m in MONEY), "price_sum", "price_notional", "return_sum", "return_squares")
    return [*(F.sum(c).alias(c) for c in plain), F.min("return_min").alias("return_min"), F.max("return_max").alias("return_max")]


def _per(x: Column, n: Column) -> Column:
    return F.coalesce(x / F.nullif(n, F.lit(0)), F.lit(0.0))


def metrics(sums: DataFrame, weighted: bool = False) -> DataFrame:
    """win_rate, pnl, roi, avg_price, edge_points, profit_factor (999 without losses), kelly, sharpe.

    weighted: the average price is weighted by notional, and Kelly's fraction may be clamped at 1.
    """
    c = F.col
    sums = sums.withColumns({m: c(m).cast("double") + c(f"{m}_rest") for m in MONEY}).drop(*(f"{m}_rest" for m in MONEY))
    sums = sums.withColumns({"price_sum": c("price_sum").cast("double"), "return_sum": c("return_sum").cast("double")})
    spread = (c("return_squares") - c("return_sum") * c("return_sum") / F.nullif(c("n"), F.lit(0))) / F.nullif(c("n") - 1, F.lit(0))
    sums = sums.withColumns({"mean_return": c("return_sum") / F.nullif(c("n"), F.lit(0)), "std_return": F.when(c("return_min") == c("return_max"), spread * 0.0).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0))))})
    price = _per(c("price_notional"), c("total_notional")) if weighted else _per(c("price_sum"), c("n"))
    out = sums.withColumn("win_rate", _per(c("wins"), c("n"))).withColumn("pnl", c("win_pnl") + c("loss_pnl")).withColumn("avg_price", price)
    odds = F.when(c("avg_price") > 0, (1 - c("avg_price")) / F.nullif(c("avg_price"), F.lit(0.0))).otherwise(0.0)
    kelly = F.when(odds > 0, (c("win_rate") * odds - (1 - c("win_rate"))) / F.nullif(odds, F.lit(0.0))).otherwise(0.0)
    return out.withColumns(
        {
            "roi": _per(c("pnl"), c("total_notional")),
            "edge_points": (c("win_rate") - c("avg_price")) * 100,
            "profit_factor": F.when(c("loss_pnl") != 0, c("win_pnl") / F.abs(F.nullif(c("loss_pnl"), F.lit(0.0)))).when(c("win_pnl") > 0, 999.0).otherwise(0.0),
            "kelly": F.greatest(F.lit(0.0), F.least(F.lit(1.0), kelly)),
            "sharpe": F.coalesce(c("mean_return") / F.nullif(c("std_return"), F.lit(0.0)) * (252.0**0.5), F.lit(0.0)),
        }
    )


def event_metrics(events: DataFrame, *by: str) -> DataFrame:
    return metrics(events.groupBy(*by).agg(*metric_sums()))


def pnl_metrics(events: DataFrame, *by: str) -> DataFrame:
    return metrics(events.groupBy(*by).agg(*metric_sums()), weighted=True)


def correlation_summary(events: DataFrame, f: EventFilter) -> DataFrame:
    """One row: signal win rate, lift, correlation with its interval, AUC, and P&L of the signals."""
    y, signal = won(), contrarian_flag(f.mode)
    flags = [F.col(c).cast("int") for c in ("is_price_contrarian", "is_against_trend", "is_against_ofi", "is_tail")]
    # events are read once: all that follows comes from the sums of each market and score
    counts = [F.count(F.lit(1)).alias("total_events"), F.count(y).alias("resolved_events"), F.count_if(y.isNotNull() & signal).alias("signals"), F.count_if(y).alias("won_events")]
    cells = filter_events(events, f).groupBy("condition_id", sum(flags[1:], flags[0]).alias("score")).agg(*counts, *metric_sums(F.when(signal, y)))
    whole = cells.agg(*(F.sum(c).alias(c) for c in ("total_events", "resolved_events", "signals", "won_events")), F.count_distinct(F.when(F.col("resolved_events") > 0, F.col("condition_id"))).alias("markets"), *combined_sums())
    whole = metrics(whole, weighted=True).drop("mean_return", "std_return")
    whole = whole.withColumns({"signal_win_rate": F.col("win_rate"), "n": F.col("resolved_events"), "nx": F.col("signals"), "ny": F.col("won_events"), "nxy": F.col("wins")})
    area = auc_of_counts(cells.groupBy("score").agg(F.sum("resolved_events").alias("m"), F.sum("won_events").alias("pos")), "score")
    out = flag_correlation(whole).crossJoin(area)  # of one row each
    shown = ("total_events", "resolved_events", "markets", "signals", "signal_win_rate", "r", "p_value", "ci_low", "ci_high", "pnl", "roi", "profit_factor", "edge_points", "kelly")
    return out.select(
        F.lit(f.mode).alias("mode"),
        *shown,
        ((F.col("signal_win_rate") - 0.5) / 0.5).alias("lift"),
        F.when(F.col("signals") >= 10, F.col("auc")).alias("signal_auc"),
        (F.col("p_value") < 0.05).alias("significant"),
    )


def compare_modes(events: DataFrame, f: EventFilter, modes: tuple[str, ...]) -> DataFrame:
    """A summary for each mode, with adjusted p-values and ranks by correlation."""
    many = events.select("*", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    flag = F.coalesce(*(F.when(F.col("mode") == m, contrarian_flag(m)) for m in modes))
    resolved = filter_events(many, f).where(won().isNotNull()).withColumn("signal", flag)
    r = point_biserial(resolved, F.col("signal"), won(), ("mode",))
    tested = benjamini_hochberg(r, "p_value", "mode")
    return tested.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("r", 3)), "adjusted_p", "mode")))


def time_split(events: DataFrame) -> DataFrame:
    """Metrics of the first 60, the next 20 and the last 20 percent of the resolved events in time; from 30 on.

    Places come from counts of days first, so that no window orders all events in one task.
    """
    rows = events.where(won().isNotNull()).withColumn("day", F.to_date("ts"))
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("m"))
    before = days.select("day", (F.sum("m").over(Window.partitionBy().orderBy("day")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("ts", "trade_id")) + F.col("before") - 1
    part = F.when(place < F.floor(F.col("total") * 0.6), "train").when(place < F.floor(F.col("total") * 0.8), "validation").otherwise("test")
    return event_metrics(rows.join(before, "day").where("total >= 30").withColumn("part", part), "part")


def breakdown(events: DataFrame, factor: Column, baseline: float = 0.5, least: int = 3) -> DataFrame:
    """Win rate and lift by a factor, of groups of `least` resolved events or more."""
    sums = events.where(won().isNotNull()).groupBy(factor.alias("factor")).agg(F.count(F.lit(1)).alias("n"), F.avg(won().cast("double")).alias("win_rate"))
    return sums.where(F.col("n") >= least).withColumn("lift", (F.col("win_rate") - baseline) / baseline)


def breakdown_intervals(events: DataFrame, factor: Column, confidence: float = 0.95, least: int = 3) -> DataFrame:
    """factor, n, wins, win_rate and the bootstrap interval of the win rate, of groups of `least` resolved events or more."""
    sums = events.where(won().isNotNull()).groupBy(factor.alias("factor")).agg(F.count(F.lit(1)).alias("n"), F.count_if(won()).alias("wins")).where(F.col("n") >= least)
    return win_rate_interval(sums, "n", "wins", confidence).withColumn("win_rate", F.col("wins") / F.col("n"))


def with_book(events: DataFrame, books: DataFrame) -> DataFrame:
    """events with spread_bps and book_asymmetric of the last book before each (null: none)."""
    known = books.where("mid is not null").withColumnRenamed("is_asymmetric", "book_asymmetric")
    return as_of_book(events, known, ("spread_bps", "book_asymmetric")).drop("snapshot_id")


def with_decile(events: DataFrame, x: str) -> DataFrame:
    """Resolved events whose x is known, with `decile`, from 1: the place of the first event of equal x in tenths, rounded up, of all.

    Events are counted by x first, so that the window runs over its distinct values only.
    """
    rows = events.where(won().isNotNull() & F.col(x).isNotNull())
    counts = rows.groupBy(F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("m"))
    all_ = Window.partitionBy()
    before, total = F.sum("m").over(all_.orderBy("_x")) - F.col("m"), F.sum("m").over(all_)
    places = counts.select("_x", (F.least(F.lit(9), F.floor(before / F.ceil(total / 10))) + 1).alias("decile"))
    return rows.join(places, rows[x] == places["_x"]).drop("_x")


def age_band(us: Column) -> Column:
    days = us / 86_400_000_000.0
    return F.when(us.isNull(), "unknown").when(days < 7, "new").when(days < 30, "recent").when(days < 180, "established").otherwise("old")


def rolling_correlation(events: DataFrame, mode: str, days: int = 7, least: int = 5) -> DataFrame:
    """For each day the correlation over the `days` before its end; an event belongs to at most days + 1 of them."""
    spine = events.agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    day = F.to_date("ts")
    near = events.where(won().isNotNull()).withColumn("signal", contrarian_flag(mode)).crossJoin(F.broadcast(spine))
    near = near.withColumn("day", F.explode(F.sequence(day, F.least(F.date_add(day, days - 1), F.col("last")))))
    return point_biserial(near, F.col("signal"), won(), ("day",)).where(F.col("n") >= least)


def grid_axes(grid: Grid) -> dict[str, list[tuple[str, Column]]]:
    """The values of each axis, and when an event satisfies them."""
    c = F.col
    return {
        "g_mode": [(m, contrarian_flag(m)) for m in grid.modes],
        "g_notional": [(f"{n:g}", c("notional") >= n) for n in grid.min_notionals],
        "g_window": [(f"{w}", c("minutes_before_close") <= w) for w in grid.windows],
        "g_price": [(f"{lo:g}-{hi:g}", c("price").between(lo, hi)) for lo, hi in grid.price_ranges],
        "g_time": [(f"{lo:g}-{hi:g}", c("minutes_before_close").between(lo, hi)) for lo, hi in grid.time_ranges],
        "g_outcome": [(o, F.lit(True) if o == "all" else c("outcome") == o) for o in grid.outcomes],
    }


def grid_sums(events: DataFrame, grid: Grid, *by: Column) -> DataFrame:
    """config_id and metric_sums of each configuration that resolved events satisfy (and of each `by` within it).

    Events of one cell satisfy the same values of every axis. They are summed by cell first, in one
    pass with map-side combine; only the cells, whose number the grid bounds, go to all their
    configurations.
    """
    axes = grid_axes(grid)
    bits = lambda values: sum((F.when(ok, F.lit(1 << k)).otherwise(0) for k, (_, ok) in enumerate(values)), F.lit(0))
    rows = events.where(won().isNotNull() & (F.col("minutes_before_close") <= max(grid.windows)) & (F.col("notional") >= min(grid.min_notionals)))
    rows = rows.withColumns({axis: bits(values) for axis, values in axes.items()}).where(" AND ".join(f"{axis} > 0" for axis in axes))
    names = [f"by{k}" for k in range(len(by))]
    cells = rows.groupBy(*axes, *(x.alias(n) for x, n in zip(by, names, strict=True))).agg(*metric_sums())
    for axis, values in axes.items():
        met = (F.when(F.col(axis).bitwiseAND(F.lit(1 << k)) != 0, F.lit(value)) for k, (value, _) in enumerate(values))
        cells = cells.withColumn(axis, F.explode(F.array_compact(F.array(*met))))
    return cells.groupBy(F.concat_ws("|", *axes).alias("config_id"), *names).agg(*combined_sums())


OBJECTIVES = ("pnl", "roi", "profit_factor", "edge_points", "sharpe")


def grid_search(events: DataFrame, grid: Grid) -> DataFrame:
    """Metrics, one-sided p against the baseline win rate, FDR, ranks and Pareto front of all configurations with enough events."""
    base = grid.baseline_win_rate
    tested = metrics(grid_sums(events, grid).where(F.col("n") >= grid.min_events))
    tested = tested.withColumn("p_value", 1 - normal_cdf((F.col("win_rate") - base) / F.sqrt(base * (1 - base) / F.col("n"))))
    adjusted = benjamini_hochberg(tested, "p_value", "config_id").withColumn("significant", F.col("adjusted_p") < grid.alpha)
    ranked = ranks(adjusted, OBJECTIVES)
    front = pareto(ranked.select("config_id", *(F.round(o, 9).alias(o) for o in OBJECTIVES)), OBJECTIVES).select("config_id", F.lit(True).alias("pareto"))
    return ranked.join(front, "config_id", "left").na.fill(False, ["pareto"])


def grid_intervals(events: DataFrame, grid: Grid, confidence: float = 0.95) -> DataFrame:
    """config_id, n, wins, ci_low, ci_high: bootstrap interval of the win rate of configurations with enough events."""
    return win_rate_interval(grid_sums(events, grid).where(F.col("n") >= grid.min_events).select("config_id", "n", "wins"), "n", "wins", confidence)


def ranks(results: DataFrame, objectives: tuple[str, ...]) -> DataFrame:
    """rank_<objective>: 1 is the largest; ties by configuration."""
    return results.withColumns({f"rank_{o}": F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round(o, 9)), "config_id")) for o in objectives})


def pareto(results: DataFrame, objectives: tuple[str, ...] = OBJECTIVES) -> DataFrame:
    """The configurations that no other one dominates (at least equal in all objectives, better in one).

    Results are one row for each configuration, so one side is broadcast by Spark.
    """
    a, b = results.alias("a"), results.select("config_id", *objectives).alias("b")
    no_worse, better = F.lit(True), F.lit(False)
    for o in objectives:
        no_worse &= F.col(f"b.{o}") >= F.col(f"a.{o}")
        better |= F.col(f"b.{o}") > F.col(f"a.{o}")
    return a.join(b, no_worse & better & (F.col("a.config_id") != F.col("b.config_id")), "left_anti")


def grid_information_ratio(events: DataFrame, grid: Grid) -> DataFrame:
    daily = grid_sums(events, grid, F.to_date("ts")).withColumnRenamed("by0", "day").withColumn("price_sum", F.col("price_sum").cast("double"))
    return information_ratio(daily, "config_id", "day", "n", "wins", "price_sum")


def sensitivity(events: DataFrame, base: EventFilter, parameter: str, values: tuple, mode: str) -> DataFrame:
    """Metrics with one parameter varied, and their differences from the base's; significant over 5 points of ROI."""
    from dataclasses import replace

    from .events import event_condition, in_scope

    variants = {"base": base} | {str(v): replace(base, **{parameter: v}) for v in values}
    fits = F.array_compact(F.array(*(F.when(in_scope(f) & event_condition(f), F.lit(k)) for k, f in variants.items())))
    out = event_metrics(events.where(contrarian_flag(mode)).withColumn("variant", F.explode(fits)), "variant")
    b = out.where("variant = 'base'").select(*(F.col(c).alias(f"base_{c}") for c in ("win_rate", "roi", "pnl")))
    both = out.where("variant != 'base'").crossJoin(b)  # the base is one row
    return both.withColumns({f"delta_{c}": F.col(c) - F.col(f"base_{c}") for c in ("win_rate", "roi", "pnl")}).withColumn("significant", F.abs("delta_roi") > 0.05)


def daily_rollups(events: DataFrame, last: date, windows: tuple[int, ...], notionals: tuple[float, ...], minutes: tuple[int, ...], modes: tuple[str, ...]) -> DataFrame:
    """Correlation by day of close up to `last`, lookback, least notional, window and mode.

    Events are counted by day and cell first; only these counts go to the days that look back on them.
    """
    keep = lambda values, ok: F.array_compact(F.array(*(F.when(ok(v), F.lit(v)) for v in values)))
    cells = events.where(won().isNotNull()).select(
        F.to_date("ts").alias("day"),
        keep(notionals, lambda v: F.col("notional") >= v).alias("min_notional"),
        keep(minutes, lambda v: F.col("minutes_before_close") <= v).alias("max_minutes"),
        F.struct(*(contrarian_flag(m).alias(m) for m in modes)).alias("flags"),
        won().alias("won"),
    )
    cells = cells.groupBy("day", "min_notional", "max_minutes", "flags", "won").agg(F.count(F.lit(1)).alias("k"))
    for axis in ("min_notional", "max_minutes"):
        cells = cells.withColumn(axis, F.explode(axis))
    cells = cells.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).withColumn("window_days", F.explode(F.array(*map(F.lit, windows))))
    signal = F.coalesce(*(F.when(F.col("mode") == m, F.col(f"flags.{m}")) for m in modes))
    count = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    keys = ("window_days", "min_notional", "max_minutes", "mode")
    days = cells.groupBy("day", *keys).agg(F.sum("k").alias("n"), count(signal).alias("nx"), count(F.col("won")).alias("ny"), count(signal & F.col("won")).alias("nxy"))
    days = days.withColumn("date", F.explode(F.expr("sequence(day, date_add(day, window_days - 1))"))).where(F.col("date") <= F.lit(last))
    return flag_correlation(days.groupBy("date", *keys).agg(*(F.sum(c).alias(c) for c in ("n", "nx", "ny", "nxy"))))
