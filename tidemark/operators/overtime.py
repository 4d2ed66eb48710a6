"""Quantiles over a sliding range of time."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sorted:
    """A bag of values that gives any of them by rank: values lie in buckets between fixed edges, whose counts lead to the
    bucket and its own order to the value. With edges at even shares a value costs about the root of the bag's size."""

    def __init__(self, values: np.ndarray):
        share = np.linspace(0, 1, max(2, int(np.sqrt(len(values)))))[1:-1]
        self.edges = np.unique(np.quantile(values, share)).tolist() if len(values) and len(share) else []
        self.buckets: list[list[float]] = [[] for _ in range(len(self.edges) + 1)]
        self.n = 0

    def add(self, v: float) -> None:
        insort(self.buckets[bisect_right(self.edges, v)], v)
        self.n += 1

    def remove(self, v: float) -> None:
        own = self.buckets[bisect_right(self.edges, v)]
        own.pop(bisect_left(own, v))
        self.n -= 1

    def at(self, k: int) -> float:
        for own in self.buckets:
            if k < len(own):
                return own[k]
            k -= len(own)
        raise IndexError(k)

    def quantile(self, q: float) -> float | None:
        """Between the two values that the share q lies between, by how far it does."""
        if not self.n:
            return None
        place = (self.n - 1) * q
        low = int(place)
        a = self.at(low)
        return a if low == place else a + (self.at(low + 1) - a) * (place - low)


def quantiles_over_time(samples: DataFrame, keys: list[str], time: str, value: str, width: int, shares: dict[str, float], stretches: int = 4) -> DataFrame:
    """samples with a column for each of ``shares``: that quantile of the values of the row's keys from ``width`` before its
    time up to it, both included, rows of the same time too. Missing values count as no rows.

    Samples go into stretches of ``stretches`` widths of time, each with the width before it, so a hot key is as many tasks
    as it has stretches; within one, the window slides over the rows in order, each coming and going once.
    """
    long = stretches * width
    own = F.floor(F.col(time) / long)
    reach = F.when(F.pmod(F.col(time), F.lit(long)) >= long - width, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = samples.withColumn("_s", F.explode(reach))
    names = list(shares)

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        t, v = pdf[time].to_numpy(), pdf[value].to_numpy(float, na_value=np.nan)
        known = ~np.isnan(v)
        bag, start, out, done = Sorted(v[known]), 0, [], 0
        first = int(pdf["_s"].iloc[0]) * long
        while done < len(t):
            end = int(np.searchsorted(t, t[done], "right"))
            for i in range(done, end):
                if known[i]:
                    bag.add(v[i])
            while t[start] < t[done] - width:
                if known[start]:
                    bag.remove(v[start])
                start += 1
            if t[done] >= first:
                out += [[bag.quantile(q) for q in shares.values()]] * (end - done)
            done = end
        kept = pdf[t >= first].drop(columns="_s")
        return kept.assign(**{n: pd.Series([r[k] for r in out], index=kept.index, dtype="float64") for k, n in enumerate(names)})

    ddl = ", ".join(f"`{n}` {t}" for n, t in samples.dtypes) + "".join(f", `{n}` double" for n in names)
    return dealt.groupBy(*keys, "_s").applyInPandas(slide, ddl)
