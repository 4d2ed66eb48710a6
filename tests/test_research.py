"""Folds against cases worked out by hand, and what queries alone do not show."""

import math
from collections import Counter

import pytest
from tidemark.operators import grids as G
from tidemark.operators import pairs as P
from tidemark.operators import risk as R
from tidemark.operators import tables as T

ROWS = "symbol string, variant string, t long, x double, y double, beta double, spread double, z double, entry double, leave double, stop double, hold double"


def rows_of(spark, zs, xs=None, ys=None, hold=1e9):
    xs, ys = xs or [10.0] * len(zs), ys or [20.0] * len(zs)
    return spark.createDataFrame([("a|b", "v", 60 * i, float(x), float(y), 1.0, float(y - x), None if z is None else float(z), 2.0, 0.5, 3.0, hold) for i, (z, x, y) in enumerate(zip(zs, xs, ys))], ROWS)


def brief(df):
    return [(r["side"], r["t_entry"] // 60, r["t_exit"] // 60, r["reason"], round(r["pnl"], 6)) for r in df.orderBy("t_entry").collect()]


def test_band_ledger(spark):
    # beyond 2 at bar 1, back within at bar 2: short the spread; reverted at bar 4; again short at 6, stopped at 7; open at the end from 10
    zs = [1.0, 2.5, 1.9, 1.0, 0.4, 2.2, 1.8, 3.1, None, -2.1, -1.9, -1.0]
    ys = [20.0, 20, 20, 20, 18, 20, 20, 23, 23, 20, 20, 21]
    free = P.pair_ledger(rows_of(spark, zs, ys=ys), notional=3000.0, slippage=0.0, fee=0.0)  # 100 of each leg at 10 and 20
    assert brief(free) == [("SHORTSPREAD", 2, 4, "CLOSE", 200.0), ("SHORTSPREAD", 6, 7, "STOP", -300.0), ("LONGSPREAD", 10, 11, "FORCE_CLOSE", 100.0)]
    paid = P.pair_ledger(rows_of(spark, zs, ys=ys), notional=3000.0, slippage=0.0, fee=5.0)
    assert [x[-1] for x in brief(paid)] == [180.0, -320.0, 80.0]  # two fees a leg
    kept = P.pair_ledger(rows_of(spark, zs, ys=ys), notional=3000.0, slippage=0.0, fee=5.0, parity=True)
    assert [x[-1] for x in brief(kept)] == [200.0, -300.0, 100.0]  # the short leg's fees are credited
    slow = P.pair_ledger(rows_of(spark, [1, 2.5, 1.9, 1.5, 1.5, 1.5], hold=120.0), slippage=0.0, fee=0.0)
    assert [x[:4] for x in brief(slow)] == [("SHORTSPREAD", 2, 4, "TIMEOUT")]
    late = P.pair_ledger(rows_of(spark, [1, 2.5, 1.9, 1.5]), slippage=0.0, fee=0.0, cutoff=333)  # local minutes are 330 + bar
    assert [x[:4] for x in brief(late)] == [("SHORTSPREAD", 2, 3, "FLATTEN")]


def test_swing_and_spread_ledgers(spark):
    zs = [1.0, 2.5, 2.4, 0.3, -1.0, -2.2, -3.5, -1.0]
    ys = [20.0, 20, 19, 18, 20, 20, 21, 22]
    swing = brief(P.pair_ledger(rows_of(spark, zs, ys=ys), "swing", notional=3000.0))
    # short in at bar 1 where the score goes beyond, out reverted at 3: leg y, held short of x's side, moved by -2 on 100
    assert [x[:4] for x in swing] == [("SHORTSPREAD", 1, 3, "revert"), ("LONGSPREAD", 5, 6, "stop")]
    assert [abs(x[4]) for x in swing] == [200.0, 100.0]
    spread = brief(P.pair_ledger(rows_of(spark, zs, ys=ys), "spread"))
    assert spread == [("SHORTSPREAD", 1, 3, "CLOSE", 2.0), ("LONGSPREAD", 5, 6, "STOP", 1.0)]


def test_pair_signals(spark):
    df = rows_of(spark, [None, 2.5, 1.9, 2.0, 0.4, -2.5, -1.0, -3.2, 0.0])
    got = [(r["t"] // 60, r["action"], r["reason"], r["position"]) for r in P.pair_signals(df, P.Thresholds(2.0, 0.5, 3.0)).orderBy("t").collect() if r["action"]]
    assert got == [(2, "ENTER_SHORT_A_LONG_B", "reenter", -1), (4, "EXIT", "revert", 0), (6, "ENTER_LONG_A_SHORT_B", "reenter", 1), (7, "EXIT", "stop", 0), (8, "ENTER_LONG_A_SHORT_B", "reenter", 1)]
    s = P.pair_signals(df, P.Thresholds(2.0, 0.5, 3.0))
    assert [(r["side_a"], r["side_b"]) for r in P.sides(s).orderBy("t").collect()] == [("SELL", "BUY"), ("BUY", "SELL"), ("BUY", "SELL"), ("SELL", "BUY"), ("BUY", "SELL")]
    stats = P.pair_signal_stats(s).first()
    assert (stats["entries"], stats["exits"], stats["last_z"], stats["position"]) == (3, 2, 0.0, 1)
    assert P.pair_signals(df.limit(0), P.Thresholds()).count() == 0


def test_fixed_exits(spark):
    bars = [("s", 60 * i, float(h), float(l), float(c), a) for i, (h, l, c, a) in enumerate([(10.0, 10, 10, "BUY"), (10.2, 9.9, 10, "SELL"), (11.2, 9.6, 10, "FLAT"), (10.0, 10, 10, "SELL"), (10.0, 8.0, 9.9, "FLAT"), (5.0, 5, 5, "BUY"), (5.1, 5, 5.1, "FLAT")])]
    df = spark.createDataFrame(bars, "symbol string, t long, h double, l double, c double, action string")
    got = [(r["side"], r["t_entry"] // 60, r["t_exit"] // 60, r["reason"], round(r["px_exit"], 6), round(r["pnl"], 6)) for r in G.trades_fixed(df, ["symbol"], 100.0, 0.1, 0.03).orderBy("t_entry").collect()]
    # both reached at bar 2: the stop goes first; the short's target at bar 4; open at the end
    assert got == [("LONG", 0, 2, "stop", 9.7, -3.0), ("SHORT", 3, 4, "target", 9.0, 10.0), ("LONG", 5, 6, "end", 5.1, 2.0)]


def test_mackinnon_p(spark):
    from pyspark.sql import functions as F

    p = {r["t"]: r["p"] for r in spark.createDataFrame([(-3.9,), (-3.34,), (-3.04,), (-2.0,), (1.0,), (-30.0,)], "t double").select("t", P.mackinnon_p(F.col("t")).alias("p")).collect()}
    assert p[-3.9] == pytest.approx(0.01, abs=2e-3) and p[-3.34] == pytest.approx(0.05, abs=2e-3) and p[-3.04] == pytest.approx(0.10, abs=3e-3)
    assert p[1.0] == 1 and p[-30.0] == 0 and p[-3.04] < p[-2.0] < 1
    assert spark.range(1).select(P.normal_cdf(F.lit(1.0)).alias("v")).first()["v"] == pytest.approx(0.5 * math.erfc(-1 / math.sqrt(2)), abs=1e-6)


def test_bounds_and_chunks(spark):
    assert R.lookback_bounds(1705190400 + 50000, 1) == (19736 * 86400 - 19800, 19737 * 86400 - 19800)
    assert R.lookback_bounds(1705190400 + 20000, 1) == (19735 * 86400 - 19800, 19736 * 86400 - 19800)
    a, b = (spark.createDataFrame(x, "symbol string, t long, c double") for x in ([("s", 1, 1.0), ("s", 2, 2.0)], [("s", 2, 9.0), ("s", 3, 3.0)]))
    assert Counter(map(tuple, R.union_chunks([a, b], ["symbol", "t"]).collect())) == Counter([("s", 1, 1.0), ("s", 2, 2.0), ("s", 3, 3.0)])


def test_error_codes(spark):
    from pyspark.sql import functions as F

    texts = {"rate-limit": "RATE_LIMIT", "corporate": "REJECT_OTHER", "limit price": "REJECT_OTHER", "Insufficient funds": "MARGIN", "no funds": "REJECT_OTHER", "DNS": "NETWORK"}
    got = {r["t"]: r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.error_code(F.col("t")).alias("c")).collect()}
    assert got == texts
