"""Rows of features by timeframe, and the reading of RSI that brings its own strength and stop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as W

#: The indicators of each timeframe in minutes, (kind, bars).
BY_TF = {1: [("sma", 5), ("sma", 20), ("rsi", 14), ("atr", 14)], 5: [("sma", 10), ("rsi", 14)]}


def _indicator(kind: str, n: int) -> Column:
    if kind == "sma":
        return W.sma(F.col("c"), n)
    if kind == "rsi":
        return W.rsi(F.col("c"), n)
    if kind == "atr":
        full = W.ordered().rowsBetween(1 - n, 0)
        return F.when(F.count("_tr").over(full) >= n, F.avg("_tr").over(full))
    raise ValueError(f"no indicator {kind}")


def feature_rows(bars: DataFrame, sets: dict[int, list[tuple[str, int]]] = BY_TF) -> DataFrame:
    """(tf, symbol, t, sma_5, ..., ready) of bars(tf, symbol, t, h, l, c): a row a bar of each timeframe in ``sets`` with that
    timeframe's indicators, those of others null; ready once all of its own are there. Each timeframe is a filter on the bars,
    so stored ones skip the folders of others, and is sorted once."""

    def one(tf: int, wanted: list[tuple[str, int]]) -> DataFrame:
        own = bars.where(F.col("tf") == tf)
        own = own.withColumn("_tr", W.true_range(F.col("h"), F.col("l"), F.col("c")))
        named = {f"{kind}_{n}": _indicator(kind, n) for kind, n in wanted}
        out = own.select("tf", "symbol", "t", *[v.alias(k) for k, v in named.items()])
        return out.withColumn("ready", reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in named], F.lit(True)))

    frames = [one(tf, wanted) for tf, wanted in sets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rsi_reading(bars: DataFrame, n: int = 14, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """(symbol, t, side, strength, stop): BUY at an RSI of ``low`` or less and SELL at ``high`` or more, as strong as it is far
    beyond (30 points: 1), with a stop 1 % beyond the least or largest of the closes that the RSI has seen."""
    r = W.Ranges(bars.withColumn("rsi", W.rsi(F.col("c"), n)))
    least, most, rsi = r.least("c", n + 1), r.most("c", n + 1), F.col("rsi")
    side = F.when(rsi <= low, "BUY").when(rsi >= high, "SELL")
    far = F.least(F.lit(1.0), F.when(side == "BUY", low - rsi).otherwise(rsi - high) / 30)
    stop = F.when(side == "BUY", least * 0.99).when(side == "SELL", most * 1.01)
    return r.df.select("symbol", "t", side.alias("side"), F.when(side.isNotNull(), far).alias("strength"), stop.alias("stop"))
