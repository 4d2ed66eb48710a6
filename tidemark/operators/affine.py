"""Recursions x -> a x + b over long series, in stretches of time that are computed side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import extended


def affine_states(rows: DataFrame, b: Column, a: float, start: Column, width: int) -> DataFrame:
    """rows(symbol, t, ...) with before and after: x before and after each row of a symbol in order of t, where a row makes
    x into a x + b and the first finds ``start`` (of that row).

    A stretch of ``width`` seconds is computed from 0; as steps compose to one of the same kind, what it makes of any x before
    it is a**n x plus that. So only one row a stretch is folded in order, and a hot symbol is as many tasks as it has
    stretches. A null b makes all after it null.
    """
    dealt = rows.withColumn("_b", b.cast("double")).withColumn("_x", start.cast("double")).withColumn("_s", F.floor(F.col("t") / width))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        x, out = 0.0, []
        for v in pdf["_b"].to_numpy(float, na_value=np.nan).tolist():
            x = a * x + v
            out.append(x)
        after = np.array(out)
        return pdf.assign(_k=np.arange(len(pdf)), _before=np.concatenate([[0.0], after[:-1]]), _after=after)

    ddl = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes) + ", _k long, _before double, _after double"
    done = dealt.groupBy("symbol", "_s").applyInPandas(local, ddl).repartition("symbol", "_s")  # shuffled once for both uses
    last = F.max(F.struct("_k", "_after"))
    ends = done.groupBy(F.col("symbol").alias("symbol"), "_s").agg(last.alias("e"), F.min_by("_x", "_k").alias("first"))
    ends = ends.select("symbol", F.col("_s").alias("s"), F.col("e._k").alias("k"), F.col("e._after").alias("x"), "first")

    def make():
        carry: list[float] = []

        def step(row):
            had = carry[0] if carry else row.first
            carry[:] = [a ** (row.k + 1) * had + row.x]
            return (had,)

        return step

    carried = extended(ends, ["symbol"], ["s"], make, "carry double").select(F.col("symbol").alias("_c"), F.col("s").alias("_t"), "carry")
    both = done.join(carried, (F.col("symbol") == F.col("_c")) & (F.col("_s") == F.col("_t")))
    grown = lambda k: F.pow(F.lit(a), k) * F.col("carry")
    both = both.withColumn("before", F.col("_before") + grown(F.col("_k"))).withColumn("after", F.col("_after") + grown(F.col("_k") + 1))
    return both.select(*rows.columns, "before", "after")


def ema_in_stretches(bars: DataFrame, n: int, width: int) -> DataFrame:
    """(symbol, t, ema): the exponential mean of the close from the first one on, as windows.ema(), in stretches."""
    alpha = 2 / (n + 1)
    x = affine_states(bars.select("symbol", "t", "c"), alpha * F.col("c"), 1 - alpha, F.col("c"), width)
    return x.select("symbol", "t", F.col("after").alias("ema"))


def heikin_in_stretches(bars: DataFrame, width: int) -> DataFrame:
    """(symbol, t, ho, hc) as windows.heikin_ashi(), in stretches: each bar's open is the middle of the bar before, so the next
    one's is half of it and half of hc."""
    hc = (F.col("o") + F.col("h") + F.col("l") + F.col("c")) / 4
    x = affine_states(bars.select("symbol", "t", "o", hc.alias("hc")), F.col("hc") / 2, 0.5, F.col("o"), width)
    return x.select("symbol", "t", F.col("before").alias("ho"), "hc")
