"""Signals of a strategy for many sets of parameters at once: action, confidence, stop and target of each set at each bar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import extended
from . import windows as W
from .signals import act, outside

#: Fixed confidences: of an edge, by strategy, and of a state; strategies that know states only have one for these.
EDGE = {
    "ema_cross": 0.8, "macd_signal": 0.8, "bollinger_breakout": 0.8, "bollinger_reversion": 0.8, "donchian_breakout": 0.8, "keltner_breakout": 0.8,
    "supertrend": 0.8, "orb_breakout": 0.8, "cci_reversion": 0.75, "heikin_trend": 0.75, "momentum_roc": 0.75, "zscore_reversion": 0.75, "vwap_reversion": 0.75,
}
STATE, STATE_ONLY = 0.6, {"sma_cross": 0.8, "rsi_reversion": 0.7}

Params = dict[str, float]
C = F.col
BAR = ["symbol", "t", "o", "h", "l", "c", "vol"]


def _six(c: Column) -> Column:
    return F.round(c, 6)


def _folded(df: DataFrame, makers: list[Callable[[], Callable]]) -> DataFrame:
    """df with x and y of each maker's fold, _x0, _y0, _x1, ..., in one pass over each symbol's rows."""

    def make():
        steps = [m() for m in makers]
        return lambda row: tuple(v for s in steps for v in s(row))

    return extended(df, ["symbol"], ["t"], make, ", ".join(f"_x{k} double, _y{k} double" for k in range(len(makers))))


def _ema_pair(p: Params) -> Callable[[], Callable]:
    def maker():
        both = W.TwoEmas(p["fast"], p["slow"])
        return lambda row: both.add(row.c) or (None, None)

    return maker


def _macd(p: Params) -> Callable[[], Callable]:
    def maker():
        both, mean = W.TwoEmas(p["fast"], p["slow"]), W.Ema(p["signal"], "sma")

        def step(row):
            found = both.add(row.c)
            line = found and found[0] - found[1]
            return line, None if line is None else mean.add(line)

        return step

    return maker


def _means(name: str, n: int) -> Callable[[], Callable]:
    """Exponential means of a column, seeded with the mean of its first values."""

    def maker():
        mean = W.Ema(n, "sma")
        return lambda row: (None, None if (v := getattr(row, name)) is None or v != v else mean.add(v))

    return maker


def _trend(k: float, atr: str) -> Callable[[], Callable]:
    def maker():
        fold = W.Supertrend(k)
        return lambda row: (fold.add(row.h, row.l, row.c, row.pc, getattr(row, atr)), None)

    return maker


def _heikin() -> Callable:
    fold = W.HeikinAshi()
    return lambda row: fold.add(row.o, row.h, row.l, row.c)


def _ranges(bars: DataFrame) -> W.Ranges:
    w = W.ordered()
    base = bars.withColumn("pc", F.lag("c").over(w)).withColumn("tp", (C("h") + C("l") + C("c")) / 3)
    base = base.withColumn("tr", W.true_range(C("h"), C("l"), C("c"))).withColumn("gain", F.greatest(C("c") - C("pc"), F.lit(0.0))).withColumn("loss", F.greatest(C("pc") - C("c"), F.lit(0.0)))
    base = base.withColumn("gain", F.when(C("pc").isNotNull(), C("gain"))).withColumn("loss", F.when(C("pc").isNotNull(), C("loss")))
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    for c in ("c", "tp"):  # deviations from the first value, whose squares are small
        base = base.withColumn(f"d{c}", C(c) - first(c)).withColumn(f"q{c}", C(f"d{c}") * C(f"d{c}"))
    return W.Ranges(base)


def _moments(r: W.Ranges, c: str, n: int) -> tuple[Column, Column]:
    """Mean and population deviation of the last n values."""
    shift = C(c) - C(f"d{c}")
    mean = r.total(f"d{c}", n) / n
    return shift + mean, F.sqrt(F.greatest(r.total(f"q{c}", n) / n - mean * mean, F.lit(0.0)))


def _zones(bars: DataFrame, strategy: str, sets: list[Params]) -> tuple[DataFrame, list[Column]]:
    """bars with what the strategy's sets need, and the zone of each."""
    r, k = _ranges(bars), range(len(sets))
    if strategy == "sma_cross":
        return _closed(r, [F.signum(_six(r.total("c", p["fast"]) / p["fast"]) - _six(r.total("c", p["slow"]) / p["slow"])) for p in sets])
    if strategy == "rsi_reversion":
        rsi = [_six(F.when(r.total("loss", p["period"]) == 0, 100.0).otherwise(100 - 100 / (1 + r.total("gain", p["period"]) / r.total("loss", p["period"])))) for p in sets]
        return _closed(r, [F.when(x <= p["lo"], 1).when(x >= p["hi"], -1).when(x.isNotNull(), 0) for x, p in zip(rsi, sets)])
    if strategy in ("bollinger_breakout", "bollinger_reversion"):
        out = []
        for p in sets:
            c = "tp" if p.get("price") == "typical" else "c"
            mean, sd = _moments(r, c, p["period"])
            out.append(outside(C(c), _six(mean - p["k"] * sd), _six(mean + p["k"] * sd), strategy.endswith("breakout")))
        return _closed(r, out)
    if strategy == "donchian_breakout":
        return _closed(r, [F.when(C("c") >= r.most("h", p["period"]), 1).when(C("c") <= r.least("l", p["period"]), -1).when(r.most("h", p["period"]).isNotNull(), 0) for p in sets])
    if strategy == "zscore_reversion":
        out = []
        for p in sets:
            mean, sd = _moments(r, "c", p["period"])
            out.append(outside(_six(F.when(sd > 1e-12, (C("c") - mean) / sd)), F.lit(-p["entry"]), F.lit(p["entry"]), False))
        return _closed(r, out)
    if strategy == "cci_reversion":
        return _closed(r, [outside(_six(W.cci(C("h"), C("l"), C("c"), p["period"])), F.lit(float(p["lo"])), F.lit(float(p["hi"])), False) for p in sets])
    if strategy == "momentum_roc":  # the zone is the reading itself: its edges are from band to band
        rocs = [(C("c") / F.lag("c", p["period"]).over(W.ordered()) - 1) * (100 if p.get("pct") else 1) for p in sets]
        names = [r.add(f"roc{i}", x) for i, x in enumerate(rocs)]
        df = _folded(r.df.select(*BAR, *names), [_means(n, p["signal"]) for n, p in zip(names, sets)])
        return df, [_six(C(n) - C(f"_y{i}") if p.get("compare_to_signal") else C(n)) for i, (n, p) in enumerate(zip(names, sets))]
    if strategy == "ema_cross":
        return _folded(bars, [_ema_pair(p) for p in sets]), [F.signum(_six(C(f"_x{i}")) - _six(C(f"_y{i}"))) for i in k]
    if strategy == "macd_signal":
        return _folded(bars, [_macd(p) for p in sets]), [F.signum(_six(C(f"_x{i}") - C(f"_y{i}"))) for i in k]
    if strategy in ("keltner_breakout", "supertrend"):
        atr = [r.add(f"atr{i}", r.total("tr", p["atr"]) / p["atr"]) for i, p in enumerate(sets)]
        if strategy == "supertrend":
            return _folded(r.df.select(*BAR, "pc", *atr), [_trend(p["mult"], a) for p, a in zip(sets, atr)]), [C(f"_x{i}") for i in k]
        df = _folded(r.df.select(*BAR, *atr), [_means("c", p["ema"]) for p in sets])
        return df, [outside(C("c"), _six(C(f"_y{i}") - p["mult"] * C(a)), _six(C(f"_y{i}") + p["mult"] * C(a))) for i, (p, a) in enumerate(zip(sets, atr))]
    if strategy == "heikin_trend":
        return _folded(bars, [_heikin]), [F.signum(_six(C("_y0")) - _six(C("_x0"))) for _ in sets]
    if strategy == "vwap_reversion":
        df = W.with_session_vwap(bars, least=2)
        n = F.count("dev").over(W.ordered("symbol", "day").rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("_seen", n)
        return df, [outside(F.when(C("_seen") >= p["min"], _six(C("dev_z"))), F.lit(-float(p["z"])), F.lit(float(p["z"])), False) for p in sets]
    raise ValueError(f"no strategy {strategy}")


def _closed(r: W.Ranges, zones: list[Column]) -> tuple[DataFrame, list[Column]]:
    """What the tables are laid out in by now, and the zones."""
    return r.df, zones


def signal_sets(bars: DataFrame, strategy: str, sets: dict[str, Params]) -> DataFrame:
    """(symbol, t, params_id, action, confidence, stop, target) of bars(symbol, t, o, h, l, c, vol) for each set of parameters.

    A set may have edge_only (1 by default): then there is an action only where the zone changes to it, else wherever it is
    in it, with less confidence; stop_pct and tgt_pct (0: none) give stop and target off the close, or the price the strategy
    reads. A FLAT has confidence 1. Bars are shuffled and sorted once for all sets; what differs between sets are columns,
    until each bar is laid out as a row a set.
    """
    ids, each = list(sets), list(sets.values())
    if strategy == "orb_breakout":
        return _orb(bars, sets)
    df, zones = _zones(bars, strategy, each)
    keys = ("symbol", "day") if strategy == "vwap_reversion" else ("symbol",)
    for i, z in enumerate(zones):
        df = df.withColumn(f"_z{i}", z)
    rows = []
    for i, (name, p) in enumerate(sets.items()):
        z = C(f"_z{i}")
        if strategy in STATE_ONLY:
            way, sure = z, F.lit(STATE_ONLY[strategy])
        elif p.get("edge_only", 1):
            way, sure = W.crossing(z, *keys), F.lit(EDGE[strategy])
        else:
            way, sure = z, F.lit(STATE)
        if strategy == "momentum_roc":
            b, before = p["band"], F.lag(z).over(W.ordered())
            far = F.when(z > b, 1).when(z < -b, -1).otherwise(0)
            first = before.isNull()
            way = F.when(first, 0).when((before <= -b) & (z > b), 1).when((before >= b) & (z < -b), -1).otherwise(0) if p.get("edge_only", 1) else F.when(first, 0).otherwise(far)
        elif strategy not in STATE_ONLY and not p.get("edge_only", 1):
            known = F.last(z, ignorenulls=True).over(W.ordered(*keys).rowsBetween(Window.unboundedPreceding, -1))
            way = F.when(known.isNotNull(), z).otherwise(0)  # the first zone is the baseline
        rows.append((name, way, sure, C("tp") if p.get("price") == "typical" else C("c"), p))
    return _rows(df, rows)


def _rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    out = []
    for i, (_, way, _, _, _) in enumerate(rows):
        df = df.withColumn(f"_w{i}", F.coalesce(way.cast("double"), F.lit(0.0)))
    for i, (name, _, sure, price, p) in enumerate(rows):
        w = C(f"_w{i}")
        off = lambda pct, side: F.when((w != 0) & F.lit(pct > 0), price * (1 + side * w * pct))  # noqa: B023, E731
        out.append(F.struct(F.lit(name).alias("params_id"), act(w).alias("action"), F.when(w != 0, sure).otherwise(1.0).alias("confidence"), off(p.get("stop_pct", 0.0), -1).alias("stop"), off(p.get("tgt_pct", 0.0), 1).alias("target")))
    return df.select("symbol", "t", F.explode(F.array(*out)).alias("x")).select("symbol", "t", "x.*")


def _orb(bars: DataFrame, sets: dict[str, Params]) -> DataFrame:
    """A day's first close outside its opening range, with stop and target; without edge_only also the closes after it that
    are outside, with neither."""
    day = Window.partitionBy("symbol", "day")
    df, rows = bars, []
    for i, p in enumerate(sets.values()):
        df = W.with_opening_range(df, int(p["minutes"])).withColumn(f"_z{i}", outside(C("c"), C("or_low"), C("or_high"))).drop("or_low", "or_high")
        df = df.withColumn(f"_h{i}", F.min(F.when(C(f"_z{i}") != 0, C("t"))).over(day))
    for i, (name, p) in enumerate(sets.items()):
        hit, z = C("t") == C(f"_h{i}"), C(f"_z{i}")
        way = F.when(hit if p.get("edge_only", 1) else C("t") >= C(f"_h{i}"), z)
        rows.append((name, way, F.when(hit, EDGE["orb_breakout"]).otherwise(STATE), F.when(hit, C("c")), p))
    return _rows(df, rows)
