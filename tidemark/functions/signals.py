"""Signals from indicator columns: a zone (1, 0, -1, null before it is defined) becomes an action on its edges and a state."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W

SIDES = ["BUY", "SELL", "EXIT"]


def act(zone: Column) -> Column:
    return F.when(zone > 0, "BUY").when(zone < 0, "SELL").otherwise("FLAT")


def outside(x: Column, low: Column, high: Column, follow: bool = True) -> Column:
    """1 above the band and -1 below it, or, where one bets on a return, the other way round."""
    way = 1 if follow else -1
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), F.when(x > high, way).when(x < low, -way).otherwise(0))


def with_signal(df: DataFrame, zone: Column, *keys: str) -> DataFrame:
    """(symbol, t, action, state): action only where the zone differs from the one before it within the keys."""
    edge = df.withColumn("zone", zone).withColumn("edge", W.crossing(F.col("zone"), *keys))
    return edge.select("symbol", "t", act(F.col("edge")).alias("action"), act(F.col("zone")).alias("state"))


def band_crossing(x: Column, band: float) -> Column:
    """1 where x leaves -band or less for more than band, -1 the other way, between neighbouring rows."""
    before = F.lag(x).over(W.ordered())
    return F.when((before <= -band) & (x > band), 1).when((before >= band) & (x < -band), -1).otherwise(0)


def opening_breakout(bars: DataFrame, minutes: int, start: int = 555, shift: int = 19800) -> DataFrame:
    """The first close of each local day outside its opening range."""
    x = W.with_opening_range(bars, minutes, start, shift)
    w = Window.partitionBy("symbol", "day")
    x = x.withColumn("zone", outside(F.col("c"), F.col("or_low"), F.col("or_high")))
    x = x.withColumn("_hit", F.min(F.when(F.col("zone") != 0, F.col("t"))).over(w))
    return x.select("symbol", "t", F.when(F.col("t") == F.col("_hit"), act(F.col("zone"))).otherwise("FLAT").alias("action"))


def keltner(bars: DataFrame, n: int = 20, n_atr: int = 14, k: float = 2.0) -> DataFrame:
    x = W.with_atr(W.with_emas(bars, {"mid": n}, "sma"), n_atr)
    return x.withColumn("lower", F.col("mid") - k * F.col("atr")).withColumn("upper", F.col("mid") + k * F.col("atr"))


def combine(signals: DataFrame, weights: dict[str, float], mode: str = "majority", k: int = 1, least: float = 0.0) -> DataFrame:
    """(symbol, t, side, score) of signals(symbol, t, name, side, score), where one results.

    Votes are sums of weight * score by side (null score: 1; sides other than BUY, SELL and EXIT do not vote); ties go to
    the first of BUY, SELL, EXIT. majority asks for a positive vote of ``least`` or more, k_of_n for k signals scored so,
    score_avg for votes of that sum, and divides by it (by 1 at least).
    """
    weight = reduce(lambda w, x: F.when(F.col("name") == x[0], x[1]).otherwise(w), weights.items(), F.lit(1.0))
    s = signals.where(F.col("side").isin(SIDES)).withColumn("_v", weight * F.coalesce("score", F.lit(1.0)))
    votes = [F.sum(F.when(F.col("side") == x, F.col("_v")).otherwise(0.0)).alias(x) for x in SIDES]
    g = s.groupBy("symbol", "t").agg(*votes, F.sum((F.coalesce("score", F.lit(0.0)) >= least).cast("int")).alias("_n"))
    g = g.withColumn("_top", F.greatest(*SIDES)).withColumn("_all", sum((F.col(x) for x in SIDES), F.lit(0.0)))
    side = F.when(F.col("BUY") == F.col("_top"), "BUY").when(F.col("SELL") == F.col("_top"), "SELL").otherwise("EXIT")
    ok = {"majority": (F.col("_top") > 0) & (F.col("_top") >= least), "k_of_n": F.col("_n") >= k, "score_avg": F.col("_all") >= least}[mode]
    score = F.col("_top") / F.greatest(F.lit(1.0), F.col("_all")) if mode == "score_avg" else F.col("_top")
    return g.where(ok).select("symbol", "t", side.alias("side"), score.alias("score"))


def agree(signals: DataFrame, children: int, mode: str = "votes", weights: dict[str, float] | None = None, k: int = 2, threshold: float = 1.0) -> DataFrame:
    """(symbol, t, side, strength) of signals(symbol, t, name, side, score) whose sides all agree: at least k of them
    (strength: their share of the children), or weights times scores (null: 1) that sum to the threshold."""
    weight = reduce(lambda w, x: F.when(F.col("name") == x[0], x[1]).otherwise(w), (weights or {}).items(), F.lit(1.0))
    s = signals.where(F.col("side").isin(SIDES)).withColumn("_v", weight * F.coalesce("score", F.lit(1.0)))
    g = s.groupBy("symbol", "t").agg(F.min("side").alias("side"), F.max("side").alias("_other"), F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    same = g.where(F.col("side") == F.col("_other"))
    enough, strength = (F.col("_n") >= k, F.col("_n") / children) if mode == "votes" else (F.col("_s") >= threshold, F.col("_s"))
    return same.where(enough).select("symbol", "t", "side", F.least(F.lit(1.0), strength).alias("strength"))


def k_of_n(votes: DataFrame, k: int = 3, warmup: int = 35, of: int = 4) -> DataFrame:
    """votes(symbol, t, up, down) with state (the side that at least k speak for, and more than for the other), action (that
    side where it had fewer than k votes at the bar before) and confidence (its share of the votes). All flat before bar
    ``warmup``, whose votes count as those before it are not there."""
    w = W.ordered()
    x = votes.withColumn("_n", F.row_number().over(w))
    zone = F.when((F.col("up") >= k) & (F.col("up") > F.col("down")), 1).when((F.col("down") >= k) & (F.col("down") > F.col("up")), -1).otherwise(0)
    x = x.withColumn("_z", F.when(F.col("_n") >= warmup, zone).otherwise(0))
    before = F.when(F.col("_n") > warmup, F.when(F.col("_z") > 0, F.lag("up").over(w)).otherwise(F.lag("down").over(w))).otherwise(0)
    x = x.withColumn("state", act(F.col("_z"))).withColumn("action", act(F.when(before < k, F.col("_z")).otherwise(0)))
    share = F.when(F.col("_z") > 0, F.col("up")).when(F.col("_z") < 0, F.col("down")).otherwise(0) / of
    return x.withColumn("confidence", F.least(share, F.lit(1.0))).drop("_n", "_z")


def spread_z(aligned: DataFrame, n: int, least: int = 10, mode: str = "raw") -> DataFrame:
    """aligned(symbol, t, x, y) with beta over the last n bars, the spread by each bar's own beta, and that spread's score
    over its last n values (population deviation), from ``least`` values on."""
    x, y = (F.log("x"), F.log("y")) if mode == "log" else (F.col("x"), F.col("y"))
    w = W.ordered().rowsBetween(1 - n, 0)
    d = aligned.withColumn("_x", x).withColumn("_y", y)
    d = d.withColumn("beta", F.when((F.count("_x").over(w) >= least) & (F.var_pop("_x").over(w) > 1e-12), F.regr_slope("_y", "_x").over(w)))
    d = d.withColumn("spread", F.col("_y") - F.col("beta") * F.col("_x"))
    sd = F.stddev_pop("spread").over(w)
    z = F.when((F.count("spread").over(w) >= least) & (sd > 0), (F.col("spread") - F.avg("spread").over(w)) / sd)
    return d.withColumn("z", z).drop("_x", "_y")


def half_life(spreads: DataFrame, value: str = "spread", least: int = 30) -> DataFrame:
    """-ln 2 / ln(1 + b) by symbol, b being the slope of the change on the value before; null if too short or not mean-reverting."""
    d = spreads.where(F.col(value).isNotNull()).withColumn("_p", F.lag(value).over(W.ordered())).withColumn("_d", F.col(value) - F.col("_p"))
    g = d.groupBy("symbol").agg(F.count("*").alias("n"), F.regr_slope("_d", "_p").alias("b"))
    ok = (F.col("n") >= least) & (F.col("b") > -1) & (F.col("b") != 0)
    return g.select("symbol", "n", F.when(ok, -math.log(2) / F.log1p("b")).alias("half_life"))
