"""Indicators as window expressions, over (symbol) in time order; null until enough rows are there."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.folds import extended

BY = ("symbol",)


def ordered(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or BY)).orderBy("t")


def _frame(n: int, *keys: str) -> WindowSpec:
    return ordered(*keys).rowsBetween(1 - n, 0)


def _ready(value: Column, n: int, *keys: str) -> Column:
    return F.when(F.count(F.lit(1)).over(_frame(n, *keys)) >= n, value)


def sma(c: Column, n: int) -> Column:
    return _ready(F.avg(c).over(_frame(n)), n)


def rsi(c: Column, n: int) -> Column:
    """Simple averages of gains and losses over n changes; 100 where there is no loss."""
    d = c - F.lag(c).over(ordered())
    gain, loss = F.sum(F.greatest(d, F.lit(0.0))).over(_frame(n)), F.sum(F.greatest(-d, F.lit(0.0))).over(_frame(n))
    return F.when(F.count(d).over(_frame(n)) >= n, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)))


def true_range(h: Column, l: Column, c: Column) -> Column:  # noqa: E741
    """Null at a series' first bar, which has no close before it."""
    before = F.lag(c).over(ordered())
    return F.when(before.isNotNull(), F.greatest(h - l, F.abs(h - before), F.abs(l - before)))


def with_atr(bars: DataFrame, n: int) -> DataFrame:
    """Mean of the last n true ranges, from bar n + 1 on."""
    ranged = bars.withColumn("tr", true_range(F.col("h"), F.col("l"), F.col("c")))
    return ranged.withColumn("atr", F.when(F.count("tr").over(_frame(n)) >= n, F.avg("tr").over(_frame(n))))


def bollinger(c: Column, n: int, k: float) -> tuple[Column, Column, Column]:
    mid, dev = F.avg(c).over(_frame(n)), F.stddev_pop(c).over(_frame(n))
    return _ready(mid - k * dev, n), _ready(mid, n), _ready(mid + k * dev, n)


def donchian(h: Column, l: Column, n: int) -> tuple[Column, Column]:  # noqa: E741
    return _ready(F.min(l).over(_frame(n)), n), _ready(F.max(h).over(_frame(n)), n)


def roc(c: Column, n: int) -> Column:
    return c / F.lag(c, n).over(ordered()) - 1


def zscore(c: Column, n: int, ddof: int = 0, eps: float = 0.0) -> Column:
    dev = (F.stddev_samp(c) if ddof else F.stddev_pop(c)).over(_frame(n))
    return _ready(F.when(dev + eps > 0, (c - F.avg(c).over(_frame(n))) / (dev + eps)), n)


def cci(h: Column, l: Column, c: Column, n: int) -> Column:  # noqa: E741
    tp = (h + l + c) / 3
    mean, seen = F.avg(tp).over(_frame(n)), F.collect_list(tp).over(_frame(n))
    mad = F.aggregate(seen, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return _ready(F.when(mad > 0, (tp - mean) / (0.015 * mad)), n)


def with_session_vwap(bars: DataFrame, shift: int = 19800, least: int = 3) -> DataFrame:
    """Mean close of the local day so far by volume (1 at least), and the close's deviation from it over that
    deviation's expanding sample deviation."""
    w = Window.partitionBy("symbol", "day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    v = F.greatest(F.col("vol"), F.lit(1))
    out = bars.withColumn("day", F.floor((F.col("t") + shift) / 86400)).withColumn("vwap", F.sum(F.col("c") * v).over(w) / F.sum(v).over(w))
    out = out.withColumn("dev", F.col("c") - F.col("vwap"))
    sd = F.stddev_samp("dev").over(w)
    return out.withColumn("dev_z", F.when((F.count("dev").over(w) >= least) & (sd > 0), F.col("dev") / sd))


def with_opening_range(bars: DataFrame, minutes: int, start: int = 555, shift: int = 19800) -> DataFrame:
    """High and low of the ``minutes`` from local minute ``start`` on, for the day's bars after them; null before, and on
    days without a bar in the range."""
    w = Window.partitionBy("symbol", "day")
    at = F.floor((F.col("t") + shift) % 86400 / 60)
    out = bars.withColumn("day", F.floor((F.col("t") + shift) / 86400)).withColumn("_at", at)
    within, after = F.col("_at").between(start, start + minutes - 1), F.col("_at") >= start + minutes
    high, low = F.max(F.when(within, F.col("h"))).over(w), F.min(F.when(within, F.col("l"))).over(w)
    return out.withColumn("or_high", F.when(after, high)).withColumn("or_low", F.when(after, low)).drop("_at")


def crossing(zone: Column, *keys: str) -> Column:
    """The zone where it differs from the last defined one, else 0; the first defined zone is the baseline."""
    before = F.last(zone, ignorenulls=True).over(ordered(*keys).rowsBetween(Window.unboundedPreceding, -1))
    return F.when(zone.isNotNull() & before.isNotNull() & (zone != before), zone).otherwise(0)


def rolling_beta(y: Column, x: Column, n: int, *keys: str, fallback: float | None = None) -> Column:
    """Slope of the line over the last n rows; ``fallback`` (null if not given) where there are fewer or x does not vary."""
    w = _frame(n, *keys)
    den = F.var_pop(x).over(w)
    slope = _ready(F.when(F.abs(den) >= 1e-12, F.regr_slope(y, x).over(w)), n, *keys)
    return slope if fallback is None else F.coalesce(slope, F.lit(fallback))


def rolling_beta_origin(y: Column, x: Column, n: int, *keys: str) -> Column:
    """Slope of the line through the origin."""
    w = _frame(n, *keys)
    den = F.sum(x * x).over(w)
    return _ready(F.when(den >= 1e-12, F.sum(x * y).over(w) / den), n, *keys)


def drawdown(equity: Column, *keys: str) -> Column:
    peak = F.max(F.greatest(equity, F.lit(0.0))).over(ordered(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return equity - peak


# Recursions: folds in time order, a row after the other, with a key's state only in memory.


class Ema:
    """seed: first value; sma (of the first n); sma_double (that, with the n-th value applied again)."""

    def __init__(self, n: int, seed: str = "first"):
        self.n, self.seed, self.a, self.seen, self.value = n, seed, 2 / (n + 1), 0, 0.0

    def add(self, v: float) -> float | None:
        self.seen += 1
        if self.seed == "first":
            self.value = v if self.seen == 1 else self.value + self.a * (v - self.value)
            return self.value
        if self.seen <= self.n:
            self.value += v / self.n
        if self.seen > self.n or self.seen == self.n and self.seed == "sma_double":
            self.value += self.a * (v - self.value)
        return self.value if self.seen >= self.n else None


class TwoEmas:
    """Seeded with the means of their first values, both stay as they are until the slower one is there; from that value
    on, which so counts twice, both follow."""

    def __init__(self, fast: int, slow: int):
        self.n, self.seen, self.values = (fast, slow), 0, [0.0, 0.0]

    def add(self, v: float) -> tuple[float, float] | None:
        self.seen += 1
        for k, n in enumerate(self.n):
            if self.seen <= n:
                self.values[k] += v / n
            if self.seen >= max(self.n):
                self.values[k] += 2 / (n + 1) * (v - self.values[k])
        return tuple(self.values) if self.seen >= max(self.n) else None


def _by_symbol(bars: DataFrame, make: Callable[[], Callable], extra: str) -> DataFrame:
    return extended(bars, ["symbol"], ["t"], make, extra)


def with_emas(bars: DataFrame, spans: dict[str, int], seed: str = "first") -> DataFrame:
    """bars with a column a span: exponential means of the close, all in one pass."""

    def make():
        each = [Ema(n, seed) for n in spans.values()]
        return lambda row: tuple(e.add(row.c) for e in each)

    return _by_symbol(bars, make, ", ".join(f"{k} double" for k in spans))


def ema(bars: DataFrame, n: int, seed: str = "first") -> DataFrame:
    return with_emas(bars.select("symbol", "t", "c"), {"ema": n}, seed).drop("c")


def with_two_emas(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """bars with fast and slow, as TwoEmas."""

    def make():
        both = TwoEmas(fast, slow)
        return lambda row: both.add(row.c) or (None, None)

    return _by_symbol(bars, make, "fast double, slow double")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """The line of TwoEmas, its exponential mean seeded with the mean of its first values, and what lies between."""

    def make():
        both, mean = TwoEmas(fast, slow), Ema(signal, "sma")

        def step(row):
            found = both.add(row.c)
            line = found and found[0] - found[1]
            sig = None if line is None else mean.add(line)
            return line, sig, None if sig is None else line - sig

        return step

    return _by_symbol(bars.select("symbol", "t", "c"), make, "macd double, signal double, hist double").drop("c")


class WilderRsi:
    def __init__(self, n: int):
        self.n, self.seen, self.before, self.up, self.down = n, 0, None, 0.0, 0.0

    def add(self, c: float) -> float | None:
        before, self.before = self.before, c
        if before is None:
            return None
        self.seen += 1
        up, down = max(c - before, 0.0), max(before - c, 0.0)
        if self.seen <= self.n:
            self.up, self.down = self.up + up / self.n, self.down + down / self.n
        else:
            self.up, self.down = (self.up * (self.n - 1) + up) / self.n, (self.down * (self.n - 1) + down) / self.n
        if self.seen < self.n:
            return None
        return 100.0 if self.down == 0 else 100 - 100 / (1 + self.up / self.down)


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    def make():
        fold = WilderRsi(n)
        return lambda row: (fold.add(row.c),)

    return _by_symbol(bars.select("symbol", "t", "c"), make, "rsi double").drop("c")


def with_votes(bars: DataFrame, rsi: int = 14, low: float = 30.0, high: float = 70.0, slope: int = 20, fast: int = 12, slow: int = 26, signal: int = 9, back: int = 12) -> DataFrame:
    """bars with up and down: how many of four readings speak for a rise and for a fall.

    They are: Wilder's RSI below low or above high; the exponential mean's direction since the bar before; the sign of
    MACD (means from the first close on) less its signal mean, which is seeded with the mean of its first values; the
    sign of the change over ``back`` bars, if the close then was not 0. A reading that is not there yet has no vote.
    """

    def make():
        strength, trend, quick, lazy, mean = WilderRsi(rsi), Ema(slope), Ema(fast), Ema(slow), Ema(signal, "sma")
        closes: deque[float] = deque(maxlen=back + 1)
        before: list[float] = []

        def step(row):
            r, e, line = strength.add(row.c), trend.add(row.c), quick.add(row.c) - lazy.add(row.c)
            m = mean.add(line)
            closes.append(row.c)
            votes = [0.0 if r is None else (r < low) - (r > high), e - before[0] if before else 0.0, 0.0 if m is None else line - m]
            votes.append(row.c / closes[0] - 1 if len(closes) > back and closes[0] else 0.0)
            before[:] = [e]
            return sum(v > 0 for v in votes), sum(v < 0 for v in votes)

        return step

    return _by_symbol(bars, make, "up int, down int")


class HeikinAshi:
    """ho and hc of bar after bar: hc is the bar's mean price; ho the open at first, then the middle of the bar before."""

    def __init__(self):
        self.last: tuple[float, float] | None = None

    def add(self, o: float, h: float, l: float, c: float) -> tuple[float, float]:  # noqa: E741
        self.last = (sum(self.last) / 2 if self.last else o), (o + h + l + c) / 4
        return self.last


def heikin_ashi(bars: DataFrame) -> DataFrame:
    def make():
        fold = HeikinAshi()
        return lambda row: fold.add(row.o, row.h, row.l, row.c)

    return _by_symbol(bars.select("symbol", "t", "o", "h", "l", "c"), make, "ho double, hc double").select("symbol", "t", "ho", "hc")


class Supertrend:
    """Trend (1, -1, or 0 while neither) of bands around the middle price that only tighten until a close passes them."""

    def __init__(self, k: float):
        self.k = k
        self.last: tuple[float, float, float, int] | None = None

    def add(self, h: float, l: float, c: float, before: float | None, atr: float | None) -> float | None:  # noqa: E741
        if atr is None or atr != atr:
            return None
        mid = (h + l) / 2
        up, low = mid + self.k * atr, mid - self.k * atr
        if self.last:
            close, was_up, was_low, trend = self.last
            up = up if close > was_up else min(up, was_up)
            low = low if close < was_low else max(low, was_low)
        else:
            trend = 1 if before > up else -1 if before < low else 0
        trend = 1 if c > up else -1 if c < low else trend
        self.last = (c, up, low, trend)
        return float(trend)


def supertrend(bars: DataFrame, n: int = 10, k: float = 3.0) -> DataFrame:
    """(symbol, t, trend) as Supertrend, from the first bar with a mean range on."""
    ready = with_atr(bars.select("symbol", "t", "h", "l", "c"), n).withColumn("pc", F.lag("c").over(ordered()))

    def make():
        fold = Supertrend(k)
        return lambda row: (fold.add(row.h, row.l, row.c, row.pc, row.atr),)

    return _by_symbol(ready, make, "trend double").select("symbol", "t", "trend")


# Windows of many lengths over the same rows.


class Ranges:
    """Least, most and sum of the last n values of a column for any n, from tables of windows of 1, 2, 4, ... values.

    A table's window is two of the one before it, so each costs one lag over the same sorted rows, whatever n, and sums lose
    no digits to differences of long running sums. A window that is not full yet, or holds a null, has none.
    """

    def __init__(self, df: DataFrame, *keys: str):
        self.df, self.w, self.made = df, ordered(*keys), {}

    def _back(self, name: str, n: int) -> Column:
        return F.lag(name, n).over(self.w) if n else F.col(name)

    def _table(self, column: str, how: str, level: int) -> str:
        if level == 0:
            return column
        if (column, how, level) not in self.made:
            half = self._table(column, how, level - 1)
            a, b = F.col(half), self._back(half, 1 << (level - 1))
            full = F.when(a.isNotNull() & b.isNotNull(), {"least": F.least(a, b), "most": F.greatest(a, b), "sum": a + b}[how])
            name = self.made[column, how, level] = f"_{how}{level}_{column}"
            self.df = self.df.withColumn(name, full)
        return self.made[column, how, level]

    def _extreme(self, column: str, how: str, n: int) -> Column:
        level = n.bit_length() - 1
        name = self._table(column, how, level)
        a, b = F.col(name), self._back(name, n - (1 << level))
        return F.when(a.isNotNull() & b.isNotNull(), (F.least if how == "least" else F.greatest)(a, b))

    def least(self, column: str, n: int) -> Column:
        return self._extreme(column, "least", n)

    def most(self, column: str, n: int) -> Column:
        return self._extreme(column, "most", n)

    def total(self, column: str, n: int) -> Column:
        out, done = None, 0
        for level in reversed(range(n.bit_length())):
            if n >> level & 1:
                part = self._back(self._table(column, "sum", level), done)
                out, done = part if out is None else out + part, done + (1 << level)
        return out

    def add(self, name: str, value: Column) -> str:
        self.df = self.df.withColumn(name, value)
        return name
