"""Model scores, cointegration with lags and sliding quantiles against brute-force versions and cases worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.functions import models as M
from tidemark.functions import windows as W
from tidemark.operators import cointegration as CI
from tidemark.operators import overtime as Q
from tidemark.operators import pairs as P


def brute_adf(e):
    """The least criterion over rows that all lags share, then the t value with that lag, by least squares on the rows."""
    most = min(math.ceil(12 * (len(e) / 100) ** 0.25), len(e) // 2 - 1)
    d = np.diff(e)

    def ols(first, lags):
        rows = range(first, len(e))
        x = np.array([[e[r - 1], *(d[r - 1 - k] for k in range(1, lags + 1))] for r in rows])
        y = np.array([d[r - 1] for r in rows])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        left = ((y - x @ b) ** 2).sum()
        return b, left, x, y

    scores = []
    for k in range(most + 1):
        _, left, x, _ = ols(most + 1, k)
        scores.append(len(x) * math.log(left / len(x)) + 2 * (k + 1))
    lag = int(np.argmin(scores))
    b, left, x, _ = ols(lag + 1, lag)
    return lag, b[0] / math.sqrt(left / (len(x) - lag - 1) * np.linalg.inv(x.T @ x)[0, 0])


@pytest.mark.parametrize("stretch", [4096, 61])
def test_cointegration_with_lags(spark, stretch):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for name, n, lags in (("A|B", 300, 3), ("A|C", 151, 0), ("B|C", 90, 1), ("C|D", 24, 0)):
        x = np.cumsum(rng.standard_normal(n)) + 50
        e = np.zeros(n)
        for t in range(1, n):  # residuals with a memory of some lags
            e[t] = 0.6 * e[t - 1] + (0.3 * (e[t - lags] - e[t - lags - 1]) if lags and t > lags else 0) + rng.standard_normal()
        y = 2 + 1.5 * x + e
        rows += [(name, t * 60, float(a), float(b)) for t, (a, b) in enumerate(zip(x, y))]
        beta, alpha = np.polyfit(x, y, 1)
        want[name] = (n, *brute_adf(y - alpha - beta * x), beta, alpha)
    df = spark.createDataFrame(rows, "symbol string, t long, x double, y double").repartition(3)
    got = {r.symbol: r for r in CI.coint_lags(df, stretch).collect()}
    assert set(got) == set(want)
    for name, (n, lag, tau, beta, alpha) in want.items():
        r = got[name]
        assert (r.n, r.lag) == (n, lag) and r.tau == pytest.approx(tau, rel=1e-6) and r.beta == pytest.approx(beta) and r.alpha == pytest.approx(alpha, rel=1e-6)
    assert got["A|B"].p < 0.05 and {r.lag for r in got.values()} != {0}
    found = {r.symbol for r in P.discover_pairs(df, 0.0, 0.04, 100, test=CI.coint_lags).collect()}
    assert found == {k for k, r in got.items() if r.p <= 0.04}


def test_cointegration_of_short_and_flat_pairs(spark):
    rows = [("one", 0, 1.0, 2.0)] + [("flat", t, float(t), 2.0 * t + 1) for t in range(40)] + [("two", t, float(t), float(t * t)) for t in range(2)]
    got = {r.symbol: (r.n, r.lag) for r in CI.coint_lags(spark.createDataFrame(rows, "symbol string, t long, x double, y double")).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"one": 1, "flat": 40, "two": 2}


BARS = "symbol string, t long, o double, h double, l double, c double, vol long"


def test_models_by_hand(spark):
    closes = {"A": [10.0, 11.0, 9.0, 9.0], "B": [5.0, 6.0, 4.0, 5.0], "C": [1.0, 1.0, 2.0, 1.0]}
    bars = spark.createDataFrame([(s, k * 60, c, c, c, c, 1) for s, cs in closes.items() for k, c in enumerate(cs)], BARS)
    linear = lambda w, b: json.dumps({"weights": w, "bias": b}).encode()
    models = spark.createDataFrame([("A", 1, "linear", linear([1, 0], 0)), ("A", 3, "linear", linear([-1.0, 0.0], 0.0)), ("A", 2, "linear", b"junk"), ("B", 1, "linear", linear([1.0], 0.0)), ("D", 1, "linear", None)], "model string, version int, kind string, payload binary")
    got = {s: [(r.action, r.reason) for r in M.model_signals(bars, models, F.col("symbol")).where(F.col("symbol") == s).orderBy("t").collect()] for s in closes}
    assert got["A"] == [("FLAT", None), ("SELL", "ml_down"), ("BUY", "ml_up"), ("FLAT", None)]  # the newest version
    assert got["B"] == [("FLAT", None)] * 4  # a model that takes one feature fails on two
    assert [a for a, _ in got["C"]] == ["FLAT", "FLAT", "BUY", "SELL"] and got["C"][2][1] == "ml_fallback_up"
    rows = M.momentum_features(bars).withColumn("name", F.when(F.col("t") > 0, F.col("symbol"))).where("symbol <> 'B'")
    small = {(r.symbol, r.t): r.score for r in M.with_scores(rows, models.where("model = 'A'"), F.col("name"), ["ret", "mom"]).collect()}
    large = {(r.symbol, r.t): r.score for r in M.with_scores(rows, models.where("model = 'A'"), F.col("name"), ["ret", "mom"], most_bytes=0, salts=3).collect()}
    assert small == large and sum(v is not None for v in small.values()) == 3


def test_sorted_bag():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 30, 400).astype(float)
    bag, held = Q.Sorted(values), []
    for k, v in enumerate(values):
        bag.add(v)
        held.append(v)
        if k % 3 == 0:
            bag.remove(held.pop(int(rng.integers(len(held)))))
        if held:
            assert [bag.quantile(q) for q in (0, 0.25, 0.5, 0.9, 1)] == pytest.approx(np.quantile(held, [0, 0.25, 0.5, 0.9, 1]).tolist())


def test_quantiles_over_time(spark):
    rng = np.random.default_rng(1)
    rows = [(("x", "y")[k % 2], int(rng.integers(-500, 500)), None if k % 11 == 0 else float(rng.integers(0, 50)), k) for k in range(600)]
    df = spark.createDataFrame(rows, "key string, t long, v double, id long")
    got = {r.id: (r.lo, r.hi) for r in Q.quantiles_over_time(df, ["key"], "t", "v", 40, {"lo": 0.1, "hi": 0.75}).collect()}
    assert len(got) == len(rows)
    for key, t, _, i in rows:
        own = [v for k, u, v, _ in rows if k == key and t - 40 <= u <= t and v is not None]
        assert got[i] == (pytest.approx(tuple(np.quantile(own, [0.1, 0.75]))) if own else (None, None))


def test_windows_of_any_length(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, float(rng.integers(0, 100)) if t % 17 else None) for s in "ab" for t in range(70)]
    r = W.Ranges(spark.createDataFrame(rows, "symbol string, t long, v double"))
    named = {(how, n): getattr(r, how)("v", n) for n in (1, 2, 3, 7, 8, 13, 16, 31) for how in ("least", "most", "total")}
    got = r.df.select("symbol", "t", *[c.alias(f"{how}{n}") for (how, n), c in named.items()]).collect()
    for x in got:
        for how, n in named:
            own = [v for s, t, v in rows if s == x.symbol and x.t - n < t <= x.t]
            full = len(own) == n and None not in own
            assert x[f"{how}{n}"] == ({"least": min, "most": max, "total": sum}[how](own) if full else None)
