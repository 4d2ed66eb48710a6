"""The cointegration test with lags: moments of lagged differences from stretches of a pair's series, solved a pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import mackinnon_p


def most_lags(n: Column) -> Column:
    """The most lags that n residuals are tried with: 12 (n / 100) ** 1/4, rounded up, and half of n less 1 at most."""
    return F.least(F.ceil(12 * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 1).cast("int")


def lagged_rows(e: np.ndarray, first: int, lags: int) -> np.ndarray:
    """For each place from ``first`` on: the change there, the value before it, and the ``lags`` changes before it."""
    d = np.diff(e)
    at = np.arange(first, len(e))
    return np.stack([d[at - 1], e[at - 1], *(d[at - 1 - k] for k in range(1, lags + 1))], axis=1) if len(at) else np.zeros((0, lags + 2))


def fit(m: np.ndarray, lags: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients of the change on the value before and ``lags`` changes, the squares left, and the inverse of the
    regressors' products, all from the products m of lagged_rows()."""
    own = slice(1, lags + 2)
    inverse = np.linalg.pinv(m[own, own], hermitian=True)
    b = inverse @ m[own, 0]
    return b, max(m[0, 0] - b @ m[own, 0], 0.0), inverse


def statistic(m: np.ndarray, n: int, head: np.ndarray, lags: int) -> tuple[int, float | None]:
    """The number of lags with the least information criterion over the rows that all share, and the t value of the value
    before with that many lags over all rows that have them. ``head``: the series' first lags + 1 values."""
    best, least = 0, np.inf
    for k in range(lags + 1):
        _, left, _ = fit(m, k)
        score = n * np.log(left / n) + 2 * (k + 1) if left > 0 else -np.inf
        if score < least:
            best, least = k, score
    early = lagged_rows(head, best + 1, best)
    m, n = m[: best + 2, : best + 2] + early.T @ early, n + len(early)
    b, left, inverse = fit(m, best)
    free = n - best - 1
    error = np.sqrt(left / free * inverse[0, 0]) if free > 0 else 0.0
    return best, float(b[0] / error) if error > 0 else None


def coint_lags(aligned: DataFrame, stretch: int = 4096) -> DataFrame:
    """(symbol, n, lag, alpha, beta, tau, p) of aligned(symbol, t, x, y): as coint_test(), with as many lagged changes as the
    information criterion of Akaike asks for.

    Residuals go into stretches of ``stretch`` rows, each with the rows before it that its lags reach; a stretch gives the
    products of its lagged changes, and what is solved a pair are their sums. So no series is gathered, and the longest is
    as many tasks as it has stretches. Pairs of too few rows for one lag have none; null where nothing can be told.
    """
    line = aligned.groupBy(F.col("symbol").alias("_s")).agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.count("*").alias("n"))
    line = line.withColumn("k", F.greatest(most_lags(F.col("n")), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("t")) - 1
    e = aligned.select("symbol", "x", "y", place.alias("r")).join(line.select("_s", "alpha", "beta", "k"), F.col("symbol") == F.col("_s"))
    e = e.select("symbol", "r", "k", (F.col("y") - F.col("alpha") - F.col("beta") * F.col("x")).alias("e"))
    own = F.floor(F.col("r") / stretch)
    reach = F.when(F.col("r") % stretch >= stretch - 1 - F.col("k"), F.array(own, own + 1)).otherwise(F.array(own))
    dealt = e.withColumn("s", F.explode(reach))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        symbol, k, s = pdf["symbol"].iloc[0], int(pdf["k"].iloc[0]), int(pdf["s"].iloc[0])
        values, begin = pdf["e"].to_numpy(float), int(pdf["r"].iloc[0])
        rows = lagged_rows(values, max(s * stretch, k + 1) - begin, k)
        m = rows.T @ rows
        i, j = np.triu_indices(k + 2)
        out = [(symbol, int(a), int(b), float(m[a, b])) for a, b in zip(i, j)] + [(symbol, -1, 0, float(len(rows)))]
        if s == 0:
            out += [(symbol, -2, r, float(v)) for r, v in enumerate(values[: k + 1])]
        return pd.DataFrame(out, columns=["symbol", "i", "j", "v"])

    kind = dict(aligned.dtypes)["symbol"]
    summed = dealt.groupBy("symbol", "s").applyInPandas(products, f"symbol {kind}, i int, j int, v double").groupBy("symbol", "i", "j").agg(F.sum("v").alias("v"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {(i, j): v for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"])}
        k = max(j for i, j in at if i == 0) - 1
        m = np.array([[at[min(a, b), max(a, b)] for b in range(k + 2)] for a in range(k + 2)])
        head = np.array([at[-2, r] for r in range(sum(i == -2 for i, _ in at))])
        n = int(at[-1, 0])
        lag, tau = statistic(m, n, head, k) if n > 0 and np.isfinite(m).all() else (0, None)
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "lag": [lag], "tau": [tau]})

    solved = summed.groupBy("symbol").applyInPandas(solve, f"symbol {kind}, lag int, tau double")
    return solved.join(line, F.col("symbol") == F.col("_s")).select("symbol", "n", "lag", "alpha", "beta", "tau", mackinnon_p(F.col("tau")).alias("p"))
