"""Ledgers, orders, scores and metrics: joins and aggregates over operational tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["NEW", "PARTIAL", "FILLED"]


def signed(qty: str = "qty", side: str = "side") -> Column:
    return F.when(F.col(side) == "BUY", F.col(qty)).otherwise(-F.col(qty))


def net_positions(fills: DataFrame, *keys: str) -> DataFrame:
    buy = F.col("side") == "BUY"
    bought = F.sum(F.when(buy, F.col("qty")).otherwise(0))
    return fills.groupBy(*keys).agg(F.sum(signed()).alias("net_qty"), (F.sum(F.when(buy, F.col("qty") * F.col("price"))) / F.nullif(bought, F.lit(0))).alias("avg_buy"))


def blotter_agg(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """orders(order_id) with filled quantity, VWAP and the number and time of fills."""
    per = fills.groupBy(F.col("order_id").alias("_o")).agg(F.sum("qty").alias("filled"), (F.sum(F.col("qty") * F.col("price")) / F.sum("qty")).alias("vwap"), F.max("t").alias("last_fill"), F.count("*").alias("n_fills"))
    return orders.join(per, F.col("order_id") == F.col("_o"), "left").drop("_o").fillna(0, ["n_fills"])


def asof_price(events: DataFrame, bars: DataFrame, default: float = 0.0, width: int = 7 * 86400) -> DataFrame:
    """events(symbol, t, id) with the close of the last bar at or before t; no range join.

    A symbol's time is cut into stretches of ``width`` seconds, each sorted in a task of its own; what the stretches before
    end with is carried over from one row a stretch.
    """
    at = F.floor(F.col("t") / width).alias("_at")
    a = events.select("symbol", "t", "id", F.lit(None).cast("double").alias("c"), F.lit(1).alias("o"), at)
    b = bars.select("symbol", "t", F.lit(None).cast("long").alias("id"), "c", F.lit(0).alias("o"), at)
    rows = a.union(b).repartition("symbol", "_at")  # shuffled once for the ends and the sweep
    ends = rows.groupBy(F.col("symbol").alias("_s"), F.col("_at").alias("_b")).agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.col("t"))).alias("_end"))
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_s", "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    w = Window.partitionBy("symbol", "_at").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.join(ends, (F.col("symbol") == F.col("_s")) & (F.col("_at") == F.col("_b")), "left")
    both = both.withColumn("price", F.coalesce(F.last("c", ignorenulls=True).over(w), F.col("_carry"), F.lit(default)))
    return both.where("o = 1").select("symbol", "t", "id", "price")


def _fifo_axis(fills: DataFrame, order: list[str]) -> DataFrame:
    """fills with quantity above 0 and the points where they end on the axes of bought (b) and matched (m, before it m0)
    quantity. Sells beyond the lots held match nothing: with B and S bought and sold so far, max(S - B, 0) of them are lost."""
    ordered = Window.partitionBy("symbol").orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    buy = F.col("side") == "BUY"
    cum = fills.where("qty > 0").withColumn("b", F.sum(F.when(buy, F.col("qty")).otherwise(0)).over(upto))
    cum = cum.withColumn("s", F.sum(F.when(buy, 0).otherwise(F.col("qty"))).over(upto))
    cum = cum.withColumn("m", F.col("s") - F.greatest(F.lit(0), F.max(F.col("s") - F.col("b")).over(upto)))
    return cum.withColumn("m0", F.coalesce(F.lag("m").over(ordered), F.lit(0)))


def fifo_match(fills: DataFrame, order: list[str]) -> DataFrame:
    """Realized P&L by symbol under first-in first-out.

    Buys end at points of the axis of bought quantity, sells at points of that of matched quantity, and the two axes are
    one. So the points of both are put in falling order; the stretch down to the next point was bought and sold at the
    prices last seen. One sort a symbol, no join of buys with sells.
    """
    cum = _fifo_axis(fills, order)
    buy = F.col("side") == "BUY"
    point = F.when(buy, F.col("b")).otherwise(F.col("m"))
    points = cum.where(buy | (F.col("m") > F.col("m0"))).select(
        "symbol", point.alias("p"), F.when(buy, F.col("price")).alias("px_buy"), F.when(~buy, F.col("price")).alias("px_sell")
    )
    falling = Window.partitionBy("symbol").orderBy(F.col("p").desc())
    seen = falling.rowsBetween(Window.unboundedPreceding, 0)
    stretch = points.select(
        "symbol",
        (F.col("p") - F.coalesce(F.lead("p").over(falling), F.lit(0))).alias("n"),
        (F.last("px_sell", ignorenulls=True).over(seen) - F.last("px_buy", ignorenulls=True).over(seen)).alias("gain"),
    )
    matched = F.sum(F.when(F.col("gain").isNotNull(), F.col("n")))
    return stretch.groupBy("symbol").agg(F.sum(F.col("n") * F.col("gain")).alias("realized"), matched.alias("matched")).where("matched > 0")


def open_lots(fills: DataFrame, order: list[str]) -> DataFrame:
    """Buys of which something is left after first-in first-out: their columns, with ``open`` for the quantity left."""
    upto = Window.partitionBy("symbol")
    cum = _fifo_axis(fills, order).withColumn("_m", F.max("m").over(upto))
    left = cum.where(F.col("side") == "BUY").withColumn("open", F.least("qty", F.col("b") - F.col("_m"))).where("open > 0")
    return left.drop("b", "s", "m", "m0", "_m")


def cash_ledger(fills: DataFrame) -> DataFrame:
    gross = F.col("qty") * F.col("price")
    return fills.withColumn("delta", F.when(F.col("side") == "BUY", -gross - F.col("fees")).otherwise(gross - F.col("fees")))


def running(df: DataFrame, value: str, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def order_health(orders: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Count and value by status, with zero rows for statuses that do not occur."""
    spark = orders.sparkSession
    domain = spark.createDataFrame([(s,) for s in statuses or STATUSES], "status string")
    per = orders.groupBy(F.col("status").alias("_s")).agg(F.count("*").alias("n"), F.sum("notional").alias("notional"))
    return domain.join(per, F.col("status") == F.col("_s"), "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("notional", F.lit(0.0)).alias("notional"))


def active_at(events: DataFrame, reservations: DataFrame, width: int = 7 * 86400) -> DataFrame:
    """events(bucket, t, id) with what is reserved then (created <= t < expires), by a sweep of additions and releases.

    A bucket's time is cut into stretches of ``width`` seconds, each swept in a task of its own; what is reserved when a
    stretch begins comes from one sum a stretch.
    """
    nothing = F.lit(None).cast("long").alias("id")
    add = reservations.select("bucket", F.col("created").alias("t"), nothing, F.col("notional").alias("d"), F.lit(0).alias("o"))
    end = reservations.select("bucket", F.col("expires").alias("t"), nothing, (-F.col("notional")).alias("d"), F.lit(0).alias("o"))
    ask = events.select("bucket", "t", "id", F.lit(0.0).alias("d"), F.lit(1).alias("o"))
    rows = add.union(end).union(ask).withColumn("_at", F.floor(F.col("t") / width)).repartition("bucket", "_at")
    sums = rows.groupBy(F.col("bucket").alias("_k"), F.col("_at").alias("_b")).agg(F.sum("d").alias("_d"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_k", "_b", F.coalesce(F.sum("_d").over(earlier), F.lit(0.0)).alias("_before"))
    w = Window.partitionBy("bucket", "_at").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.join(sums, (F.col("bucket") == F.col("_k")) & (F.col("_at") == F.col("_b")), "left")
    swept = swept.withColumn("active", F.sum("d").over(w) + F.coalesce("_before", F.lit(0.0)))
    return swept.where("o = 1").select("bucket", "t", "id", "active")


def headroom(events: DataFrame, reservations: DataFrame, caps: DataFrame, width: int = 7 * 86400) -> DataFrame:
    """active_at with what is left of caps(bucket, cap) then, at least 0; without a cap nothing is left."""
    limits = caps.select(F.col("bucket").alias("_k"), "cap")
    left = F.greatest(F.coalesce("cap", F.lit(0.0)) - F.col("active"), F.lit(0.0))
    return active_at(events, reservations, width).join(limits, F.col("bucket") == F.col("_k"), "left").withColumn("headroom", left).drop("_k", "cap")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def topk(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def capped_topk(df: DataFrame, key: str, cap: int, order: list, k: int) -> DataFrame:
    return topk(df, [key], order, cap).drop("rank").orderBy(*order).limit(k)


def position_diff(broker: DataFrame, local: DataFrame) -> DataFrame:
    a, b = broker.alias("a"), local.alias("b")
    j = a.join(b, F.col("a.symbol") == F.col("b.symbol"), "full")
    x, y = F.coalesce("a.qty", F.lit(0)), F.coalesce("b.qty", F.lit(0))
    return j.select(F.coalesce("a.symbol", "b.symbol").alias("symbol"), x.alias("broker"), y.alias("local"), (x - y).alias("diff")).where("diff <> 0")


def _share(win: str = "win_rate") -> Column:
    """A win rate as a share: above 1 it is in per cent."""
    return F.when(F.col(win) > 1, F.col(win) / 100).otherwise(F.col(win))


def _not_positive(df: DataFrame) -> Column:
    """The return, R where there is one and else pnl_total, is null or not above 0."""
    made = F.coalesce(*[F.col(c) for c in ("R", "pnl_total") if c in df.columns])
    return F.coalesce(made <= 0, F.lit(True))


def _given(df: DataFrame, checks: list[tuple[float | None, str, str, object]]) -> list[tuple[Column, str]]:
    """Checks (limit, column they need, reason, condition on the limit) whose limit is set and whose column df has."""
    return [(condition(limit), reason) for limit, column, reason, condition in checks if limit is not None and column in df.columns]


def apply_gates(
    df: DataFrame, min_trades: int | None = None, min_win_rate: float | None = None, max_drawdown: float | None = None,
    max_slippage_bps: float | None = None, min_R: float | None = None, min_pnl_total: float | None = None, positive: bool = True,  # noqa: N803
) -> DataFrame:
    """rejected_reason: the first gate that fails (null: none). Gates not given are open, as are those of columns df lacks.

    A null number of trades, win rate, drawdown or slippage counts as 0; a null R or pnl_total passes its own gate.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    checks = [
        (min_trades, "n_trades", "min_trades", lambda x: zero("n_trades") < x),
        (min_win_rate, "win_rate", "min_win_rate", lambda x: F.coalesce(_share(), F.lit(0.0)) < x),
        (max_drawdown, "max_dd", "max_drawdown", lambda x: F.abs(zero("max_dd")) > x),
        (max_slippage_bps, "slippage_bps", "slippage", lambda x: zero("slippage_bps") > x),
        (min_R, "R", "min_R", lambda x: F.col("R") < x),
        (min_pnl_total, "pnl_total", "min_pnl_total", lambda x: F.col("pnl_total") < x),
    ]
    every = [(_not_positive(df), "non_positive_return")] * positive + _given(df, checks)
    reason = F.coalesce(*[F.when(c, F.lit(name)) for c, name in every]) if every else F.lit(None).cast("string")
    return df.withColumn("rejected_reason", reason)


def eligibility(
    df: DataFrame, as_of: int | None = None, recency_days: float | None = None, min_trades: int = 20, min_R: float | None = 0.0,  # noqa: N803
    min_pnl_total: float | None = None, min_sharpe: float | None = 0.25, min_win_rate: float = 0.5, max_drawdown: float | None = None,
    max_turnover: float | None = None, max_avg_hold_min: float | None = None, max_latency_ms: float | None = None, positive: bool = True,
) -> DataFrame:
    """reasons: all that speak against a row, comma-joined in fixed order; a return that is not positive stands alone.

    recency_days asks for an end_t (seconds) at most so long before as_of. A null Sharpe ratio or win rate fails; other
    nulls pass, but for the number of trades and the drawdown, which count as 0. Checks of columns df lacks are left out.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    above = lambda c: lambda x: F.col(c) > x
    checks = [
        (recency_days, "end_t", "stale_metrics", lambda x: F.coalesce(F.lit(as_of) - F.col("end_t") > x * 86400, F.lit(True))),
        (min_trades, "n_trades", "min_trades", lambda x: zero("n_trades") < x),
        (min_R, "R", "min_R", lambda x: F.col("R") < x),
        (min_pnl_total, "pnl_total", "min_pnl_total", lambda x: F.col("pnl_total") < x),
        (min_sharpe, "sharpe", "min_sharpe", lambda x: F.coalesce(F.col("sharpe") < x, F.lit(True))),
        (min_win_rate, "win_rate", "missing_win_rate", lambda x: F.col("win_rate").isNull()),
        (min_win_rate, "win_rate", "min_win_rate", lambda x: _share() < x),
        (max_drawdown, "max_dd", "max_drawdown", lambda x: F.abs(zero("max_dd")) > x),
        (max_turnover, "turnover", "max_turnover", above("turnover")),
        (max_avg_hold_min, "avg_hold_min", "max_avg_hold_min", above("avg_hold_min")),
        (max_latency_ms, "latency_ms", "max_latency_ms", above("latency_ms")),
    ]
    every = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in _given(df, checks)])), ",")
    return df.withColumn("reasons", F.when(_not_positive(df), "non_positive_return").otherwise(every) if positive else every)


def by_thresholds(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    out = F.lit(last)
    for most, name in reversed(steps):
        out = F.when(F.abs(value) <= most, name).otherwise(out)
    return out


def weighted_config(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means weighted by n_trades (all 1 where they sum to zero), largest drawdown, trades and sorted symbols."""
    w = F.when(F.sum(F.coalesce("n_trades", F.lit(0))).over(Window.partitionBy(*keys)) == 0, 1).otherwise(F.coalesce("n_trades", F.lit(0)))
    x = df.withColumn("_w", w)
    means = [(F.sum(F.col(v) * F.col("_w")) / F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))).alias(v) for v in values]
    return x.groupBy(*keys).agg(*means, F.max(F.abs("max_dd")).alias("max_dd"), F.sum("n_trades").alias("n_trades"), F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"))


def cohort_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Robust score of ``value`` in its cohort: (v - median) / population deviation of the winsorized values.

    Bounds are the order statistics at floor(.02 n) and max(that, floor(.98 n) - 1). Zero deviation counts as 1; a null
    value scores -0.1, or 0 where the whole cohort is null.
    """
    c = df.withColumn("_n", F.count(value).over(Window.partitionBy(*keys))).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())) - 1)
    lo = F.floor(F.col("_n") * 2 / 100)
    hi = F.greatest(lo, F.floor(F.col("_n") * 98 / 100) - 1)
    w = Window.partitionBy(*keys)
    c = c.withColumn("_lo", F.min(F.when(F.col("_r") == lo, F.col(value))).over(w)).withColumn("_hi", F.min(F.when(F.col("_r") == hi, F.col(value))).over(w))
    c = c.withColumn("_v", F.when(F.col(value).isNotNull(), F.least(F.greatest(value, "_lo"), F.col("_hi"))))
    stats = c.groupBy(*[F.col(k).alias(f"_k{k}") for k in keys]).agg(F.median("_v").alias("_m"), F.stddev_pop("_v").alias("_sd"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys]
    sd = F.when(F.coalesce("_sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_sd"))
    z = F.when(F.col("_n") == 0, 0.0).when(F.col(value).isNull(), -0.1).otherwise((F.col(value) - F.col("_m")) / sd)
    return c.join(stats, on).withColumn("z", z).drop("_n", "_r", "_lo", "_hi", "_v", "_m", "_sd", *[f"_k{k}" for k in keys])


def decayed(score: Column, age_days: Column, half_life: float) -> Column:
    return score * F.exp(-math.log(2) * age_days / half_life)


def to_histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts by upper bound ``le``; the last is infinite."""
    les = F.array(*[F.lit(float(b)) for b in [*bounds, math.inf]])
    x = df.select(*keys, F.col(value).alias("_v"), F.explode(les).alias("le"))
    return x.groupBy(*keys, "le").agg(F.sum((F.col("_v") <= F.col("le")).cast("long")).alias("n"))


def histogram_quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Linear interpolation in the bucket that holds the rank; in the infinite bucket its lower bound."""
    w = Window.partitionBy(*keys).orderBy("le")
    x = hist.select("*", F.coalesce(F.lag("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("le0"), (q * F.max("n").over(Window.partitionBy(*keys))).alias("rank"))
    hit = F.when(F.col("le") == math.inf, F.col("le0")).otherwise(F.col("le0") + (F.col("le") - F.col("le0")) * (F.col("rank") - F.col("n0")) / (F.col("n") - F.col("n0")))
    return x.where((F.col("n") >= F.col("rank")) & (F.col("n0") < F.col("rank"))).groupBy(*keys).agg(F.min_by(hit, "le").alias("quantile"))


def counter_rate(samples: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Increase of a counter within each bucket of ``width`` seconds, resets clamped at 0, per second."""
    b = F.col("t") - F.pmod("t", F.lit(width))
    rise = F.greatest(F.lit(0.0), F.max_by("value", F.struct("t", "id")) - F.min_by("value", F.struct("t", "id")))
    return samples.groupBy(*keys, b.alias("b")).agg((rise / width).alias("rate"))


#: Fixed patterns by code, in order of precedence.
ERRORS = {
    "RATE_LIMIT": "(rate.?limit|429)",
    "MARGIN": "(margin|insufficient funds)",
    "RISK": "(risk|blocked)",
    "INSTRUMENT": "(instrument|trading symbol|symbol invalid)",
    "NETWORK": "(timeout|network|dns)",
}


def error_code(text: Column) -> Column:
    """First matching class of an error message."""
    out = F.lit("REJECT_OTHER")
    for code, pattern in reversed(ERRORS.items()):
        out = F.when(F.lower(text).rlike(pattern), code).otherwise(out)
    return out


def pair_stats(bars: DataFrame, least: int, block: int = 256, slice_bars: int = 4096) -> DataFrame:
    """Correlation and hedge ratio of every two symbols a < b over the bars they share, where those are ``least`` or more.

    Symbols are dealt into a few sides and, where that takes no more files, bar times into slices of ``slice_bars`` or more;
    a symbol's bars in a slice are packed in one row. A task holds two sides in one slice, sorted by first time and cut into
    tiles of ``block`` symbols. It gives the moments of two tiles' pairs as matrix products over the times that both have,
    ``slice_bars`` at a time, one tile pair after another. Each packed row goes to as many tasks as there are sides. Slices
    need fewer sides, but then each pair's moments go through files once a slice, to be added up; with one slice a task
    gives the pairs' results itself. Closes are taken from the symbol's mean, so that differences of large sums do not lose
    their digits. Both null where a variance is zero; repeated bars of a symbol and time count once, with the smaller close.
    """
    bars = bars.where("symbol is not null and t is not null and c is not null").groupBy("symbol", "t").agg(F.min("c").alias("c"))
    sizes = bars.agg(F.count("*").alias("n"), F.approx_count_distinct("symbol").alias("s"), F.approx_count_distinct("t").alias("t")).first()
    slices, k = _dealing(sizes["n"], sizes["s"], sizes["t"], block, slice_bars)
    part = F.pmod(F.xxhash64("t"), F.lit(slices)).cast("int")
    packed = bars.withColumn("part", part).repartition("symbol").groupBy("symbol", "part").agg(F.collect_list(F.struct("t", F.col("c").cast("double").alias("c"))).alias("x"), F.sum("c").alias("_c"), F.count("*").alias("_n"))
    whole = Window.partitionBy("symbol")
    rows = packed.select(
        F.col("symbol").cast("string").alias("symbol"), "part", F.col("x.t").alias("ts"), F.col("x.c").alias("cs"), (F.sum("_c").over(whole) / F.sum("_n").over(whole)).alias("mean"),
        F.pmod(F.xxhash64("symbol"), F.lit(k)).cast("int").alias("side"),
    )
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rows = rows.withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other")).drop("_other")
    rows = rows.repartition(min(k * (k + 1) // 2 * slices, 2000), "lo", "hi", "part")  # few bytes in, many pairs out: not to be joined into one task

    def moments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _moments(pa.Table.from_batches(batches), 1, block, slice_bars)  # a pair's bars are known only when all slices are in

    def stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(_coefficients, _moments(pa.Table.from_batches(batches), max(least, 1), block, slice_bars))

    groups = rows.groupBy("lo", "hi", "part")
    if slices == 1:
        return groups.applyInArrow(stats_of, _STATS)
    moments = groups.applyInArrow(moments_of, _MOMENTS).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return moments.where(F.col("n") >= least).mapInArrow(lambda batches: map(_coefficients, batches), _STATS)


_MOMENTS = "a string, b string, n long, sx double, sy double, sxx double, syy double, sxy double"
_STATS = "a string, b string, n long, rho double, beta double"
_SIDES = 8  # 36 tasks a slice, where there are symbols enough
_SIDE_BARS = 1 << 21  # bars of a side in a slice
_ROW_BARS = 1 << 18  # bars of a packed row
_BAR_BYTES, _MOMENT_BYTES = 16, 60  # in shuffle files


def _dealing(n: int, s: int, t: int, block: int, slice_bars: int) -> tuple[int, int]:
    """Slices and sides for n bars of s symbols at t times: of those whose files are nearly the least, the most slices."""

    def files(slices: int) -> tuple[float, int]:
        k = max(1, min(s, max(min(-(-s // block), _SIDES), -(-n // (slices * _SIDE_BARS)))))
        return n * k * _BAR_BYTES + (slices > 1) * slices * s * (s - 1) / 2 * _MOMENT_BYTES, k

    widths = [slice_bars]
    while widths[-1] < t and widths[-1] * 2 <= _ROW_BARS:
        widths.append(widths[-1] * 2)
    ways = [(slices, *files(slices)) for slices in (max(1, -(-t // w)) for w in widths)]
    most = 1.25 * min(size for _, size, _ in ways)
    return next((slices, k) for slices, size, k in ways if size <= most)


def _coefficients(moments: pa.RecordBatch) -> pa.RecordBatch:
    """Correlation and hedge ratio of rows of _MOMENTS, null where a variance is zero."""
    n, sx, sy, sxx, syy, sxy = (moments.column(c).to_numpy() for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    xx, yy, xy = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    some = xx > sxx * 1e-12
    both = some & (yy > syy * 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        rho, beta = np.clip(xy / np.sqrt(xx * yy), -1.0, 1.0), xy / xx
    columns = [moments.column("a"), moments.column("b"), moments.column("n"), pa.array(rho, mask=~both), pa.array(beta, mask=~some)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "rho", "beta"])


def _moments(group: pa.Table, least: int, block: int, width: int) -> Iterator[pa.RecordBatch]:
    """Number of shared bars, sums, squares and products of each two symbols a < b of a group of pair_stats, by pairs of tiles."""
    names = group.column("symbol").combine_chunks()
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    side, sizes = group.column("side").to_numpy(), pc.list_value_length(group.column("ts")).to_numpy()
    times, at = np.unique(pc.list_flatten(group.column("ts")).to_numpy(), return_inverse=True)
    value = pc.list_flatten(group.column("cs")).to_numpy() - np.repeat(group.column("mean").to_numpy(), sizes)
    start = np.cumsum(sizes) - sizes
    earliest = np.minimum.reduceat(at, start)
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))

    def tiles(of: int) -> list[tuple]:
        """Symbols by first time, in tiles: symbols; bars' rows in the tile, times and values by stretches of times, and where these begin; all times."""
        own = np.nonzero(side == of)[0]
        own = own[np.lexsort((rank[own], earliest[own]))]
        out = []
        for tile in np.split(own, range(block, len(own), block)):
            row = np.repeat(np.arange(len(tile)), sizes[tile])
            bars = np.arange(len(row)) - np.repeat(np.cumsum(sizes[tile]) - sizes[tile] - start[tile], sizes[tile])
            stretch = at[bars] // width
            order = np.argsort(stretch, kind="stable")
            row, bars = row[order], bars[order]
            out.append((tile, row, at[bars], value[bars], np.searchsorted(stretch[order], range(-(-len(times) // width) + 1)), np.unique(at[bars])))
        return out

    column = np.full(len(times), -1)

    def dense(tile: tuple, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols, row, when, values, begin, _ = tile
        within = slice(begin[shared[0] // width], begin[shared[-1] // width + 1])
        to = column[when[within]]
        row, to, values = row[within][to >= 0], to[to >= 0], values[within][to >= 0]
        v, there = np.zeros((2, len(symbols), len(shared)))
        v[row, to], there[row, to] = values, 1
        return v, there

    left = tiles(lo)
    right = left if lo == hi else tiles(hi)
    for p, one in enumerate(left):
        for other in right[p:] if lo == hi else right:
            both = np.intersect1d(one[-1], other[-1], assume_unique=True)
            if len(both) < least:
                continue
            sums: list[np.ndarray] = []
            for shared in np.split(both, np.searchsorted(both, range(width, len(times), width))) if len(both) > width else [both]:
                if not len(shared):
                    continue
                column[shared] = np.arange(len(shared))
                (v, w), (x, y) = dense(one, shared), dense(other, shared)
                column[shared] = -1
                these = [f @ g.T for f, g in ((w, y), (v, y), (w, x), (v * v, y), (w, x * x), (v, x))]
                sums = [m + more for m, more in zip(sums, these, strict=True)] if sums else these
            n = sums[0]
            swap = rank[one[0]][:, None] > rank[other[0]]
            keep = n >= least
            if one is other:
                keep &= rank[one[0]][:, None] < rank[other[0]]
            i, j = np.nonzero(keep)
            if not len(i):
                continue
            swap = swap[i, j]
            n, *each, xy = (m[i, j] for m in sums)
            a, b = np.where(swap, other[0][j], one[0][i]), np.where(swap, one[0][i], other[0][j])
            pick = lambda p, q: np.where(swap, each[q], each[p])  # noqa: B023, E731
            columns = [n.astype(np.int64), pick(0, 1), pick(1, 0), pick(2, 3), pick(3, 2), xy]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), *map(pa.array, columns)], names=["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"])


def align(bars: DataFrame, a: str, b: str) -> DataFrame:
    """(t, x, y, symbol): closes of two symbols where both have a bar."""
    left = bars.where(F.col("symbol") == a).select("t", F.col("c").alias("x"))
    return left.join(bars.where(F.col("symbol") == b).select("t", F.col("c").alias("y")), "t").withColumn("symbol", F.lit(f"{a}|{b}"))


def align_pairs(bars: DataFrame, least: int) -> DataFrame:
    """(symbol, t, x, y): closes of every two symbols a < b where both have a bar, named a|b, for pairs that share
    ``least`` bars or more. The overlaps are counted on the same shuffle that the rows are kept from.

    It joins on time, so for thousands of symbols at a time take align_selected() of the pairs that pair_stats() finds.
    """
    a, b = bars.select("t", F.col("symbol").alias("a"), F.col("c").alias("x")), bars.select("t", F.col("symbol").alias("b"), F.col("c").alias("y"))
    both = a.join(b, "t").where("a < b").select(F.concat("a", F.lit("|"), "b").alias("symbol"), "t", "x", "y").repartition("symbol")
    enough = both.groupBy(F.col("symbol").alias("_s")).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return both.join(enough, F.col("symbol") == F.col("_s"), "left_semi")


def align_selected(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(symbol, t, x, y) of align_pairs() for pairs(a, b), such as those of pair_stats() that overlap and correlate enough.

    Only their series are laid out, by symbol and by (symbol, time), so a time that many symbols share is no task of its own.
    """
    x = bars.select(F.col("symbol").alias("_a"), "t", F.col("c").alias("x"))
    y = bars.select(F.col("symbol").alias("_b"), F.col("t").alias("_t"), F.col("c").alias("y"))
    left = pairs.select("a", "b").join(x, F.col("a") == F.col("_a")).select("a", "b", "t", "x")
    both = left.join(y, (F.col("b") == F.col("_b")) & (F.col("t") == F.col("_t")))
    return both.select(F.concat("a", F.lit("|"), "b").alias("symbol"), "t", "x", "y")


def trades_from_signals(rows: DataFrame, capital: float) -> DataFrame:
    """Trades of rows(symbol, t, c, action): BUY or SELL opens when flat, the opposite closes; at the end all is closed.

    With exits by signals only, the position is a counter clamped to -1..1. Its closed form: r is the action at the
    latest row whose action equals the one before it (or the first action); the position is r where the action is r,
    else 0. So no fold over rows is needed.
    """
    w = Window.partitionBy("symbol").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    act = rows.where("action in ('BUY', 'SELL')").withColumn("a", F.when(F.col("action") == "BUY", 1).otherwise(-1))
    before = F.lag("a").over(w)
    act = act.withColumn("anchor", F.when(before.isNull() | (before == F.col("a")), F.col("a")))
    act = act.withColumn("pos", F.when(F.last("anchor", ignorenulls=True).over(upto) == F.col("a"), F.col("a")).otherwise(0))
    act = act.withColumn("was", F.coalesce(F.lag("pos").over(w), F.lit(0))).where("pos <> was")
    nxt = act.select("symbol", "t", "c", "pos", F.lead("t").over(w).alias("t_exit"), F.lead("c").over(w).alias("c_exit"))
    ends = rows.groupBy(F.col("symbol").alias("_s")).agg(F.max("t").alias("t_end"), F.max_by("c", "t").alias("c_end"))
    qty = F.floor(F.lit(capital) / F.col("c"))
    done = nxt.where("pos <> 0").join(ends, F.col("symbol") == F.col("_s")).withColumn("px_exit", F.coalesce("c_exit", "c_end"))
    return done.select("symbol", F.col("t").alias("t_entry"), F.col("c").alias("px_entry"), F.when(F.col("pos") > 0, "LONG").otherwise("SHORT").alias("side"), qty.alias("qty"), F.coalesce("t_exit", "t_end").alias("t_exit"), "px_exit", (F.col("pos") * qty * (F.col("px_exit") - F.col("c"))).alias("pnl"))


def trade_stats(trades: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("t_exit", "t_entry").rowsBetween(Window.unboundedPreceding, 0)
    eq = trades.withColumn("eq", F.sum("pnl").over(w))
    eq = eq.withColumn("dd", F.col("eq") - F.max(F.greatest("eq", F.lit(0.0))).over(w))
    win = F.sum((F.col("pnl") > 0).cast("int"))
    return eq.groupBy("symbol").agg(F.count("*").alias("n_trades"), win.alias("wins"), (100 * win / F.count("*")).alias("win_rate"), F.sum("pnl").alias("pnl_total"), F.avg(F.col("t_exit") - F.col("t_entry")).alias("avg_hold"), F.min("dd").alias("max_dd"))
