"""Streams with keyed state: pairs in step, pair signals with timers and warm-up, average-cost positions, order admission.

Every processor hands a key's rows of a micro-batch, in order, to the rule that the batch operator uses, and keeps between
batches what that rule needs. They run on the RocksDB state store, which the session names before a stream is started.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.signals import spread_z
from ..operators.ledgers import Budgets, Wac, refusal
from ..operators.pairs import Position, Thresholds, pair_signals

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    held = [x for x in rows if len(x)]
    return pd.concat(held, ignore_index=True).sort_values(order, kind="stable") if held else pd.DataFrame()


def fan_out(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(symbol, leg, t, px, ...) of bars(symbol, t, px, ...), batch or stream, for each of pairs(pair, a, b) with the bar's
    symbol as a leg; ``symbol`` is then the pair's name."""
    legs = pairs.select("pair", F.explode(F.array(*[F.struct(F.col(c).alias("_s"), F.lit(c).alias("leg")) for c in "ab"])).alias("_x")).select("pair", "_x.*")
    rest = [c for c in bars.columns if c != "symbol"]
    return bars.join(legs, F.col("symbol") == F.col("_s")).select(F.col("pair").alias("symbol"), "leg", *rest)


class Legs:
    """The latest bar of each leg of a pair; a pair of bars of one time goes on if it is later than all that went on."""

    def __init__(self, a: tuple[int, float] | None = None, b: tuple[int, float] | None = None, last: int | None = None):
        self.latest, self.last = {"a": a, "b": b}, last

    def take(self, leg: str, t: int, px: float) -> tuple[int, float, float] | None:
        self.latest[leg] = (t, px)
        a, b = self.latest["a"], self.latest["b"]
        if a is None or b is None or a[0] != b[0] or self.last is not None and t <= self.last:
            return None
        self.last = t
        return t, a[1], b[1]


def sync_legs(arrivals: DataFrame, order: list[str]) -> DataFrame:
    """(symbol, t, x, y) that Legs lets through of arrivals(symbol, leg, t, px, order), as a batch, in the order of arrival.
    A repeated or belated bar replaces its leg's latest, and counts again only if its time is new to the pair."""
    w = Window.partitionBy("symbol").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    of = lambda leg: F.last(F.when(F.col("leg") == leg, F.struct("t", "px")), ignorenulls=True).over(upto)
    met = arrivals.withColumn("_a", of("a")).withColumn("_b", of("b")).withColumn("_m", F.when(F.col("_a.t") == F.col("_b.t"), F.col("t")))
    met = met.withColumn("_l", F.max("_m").over(before))
    return met.where(F.col("_m").isNotNull() & (F.col("_l").isNull() | (F.col("_m") > F.col("_l")))).select("symbol", "t", F.col("_a.px").alias("x"), F.col("_b.px").alias("y"))


class _LegProcessor(StatefulProcessor):
    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle) -> None:
        self.kept = handle.getValueState("legs", "a_t long, a double, b_t long, b double, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        legs, out = _legs_of(self.kept.get()), []
        for r in _in_order(rows, self.order).itertuples(index=False):
            if met := legs.take(r.leg, int(r.t), float(r.px)):
                out.append((key[0], *met))
        self.kept.update(_row_of(legs))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "t", "x", "y"])


def _legs_of(row) -> Legs:
    if row is None:
        return Legs()
    a_t, a, b_t, b, last = row[:5]
    return Legs(None if a_t is None else (a_t, a), None if b_t is None else (b_t, b), last)


def _row_of(legs: Legs) -> tuple:
    a, b = legs.latest["a"] or (None, None), legs.latest["b"] or (None, None)
    return (*a, *b, legs.last)


def stream_legs(arrivals: DataFrame, order: list[str]) -> DataFrame:
    """sync_legs() on a stream; rows of a micro-batch in that order. State: two bars and a time for each pair."""
    return arrivals.groupBy("symbol").transformWithStateInPandas(_LegProcessor(order), "symbol string, t long, x double, y double", "append", "none")


class Spread:
    """The last n bars of a pair: beta, spread and score as spread_z() defines them."""

    def __init__(self, n: int, least: int, log: bool, xs=(), ys=(), spreads=()):
        self.least, self.log = least, log
        self.xs, self.ys = deque(xs, n), deque(ys, n)
        self.spreads = deque((s if s is not None and s == s else None for s in spreads), n)

    def take(self, x: float, y: float) -> tuple[float | None, float | None, float | None]:
        if self.log:
            x, y = (float(np.log(v)) if v > 0 else None for v in (x, y))
        self.xs.append(x)
        self.ys.append(y)
        both = np.array([(a, b) for a, b in zip(self.xs, self.ys) if a is not None and b is not None]).reshape(-1, 2)
        beta = None
        if sum(a is not None for a in self.xs) >= self.least and len(both) and both[:, 0].var() > 1e-12:
            d = both - both.mean(axis=0)
            beta = float((d[:, 0] * d[:, 1]).sum() / (d[:, 0] ** 2).sum())
        spread = None if beta is None or x is None or y is None else y - beta * x
        self.spreads.append(spread)
        known = np.array([s for s in self.spreads if s is not None])
        z = None
        if len(known) >= self.least and spread is not None and (sd := float(known.std())) > 0:
            z = (spread - float(known.mean())) / sd
        return beta, spread, z


_STATE = "last long, xs array<double>, ys array<double>, spreads array<double>, z double, position int, since long"
_OUT = "symbol string, t long, beta double, spread double, z double, action string, reason string, position int, timed boolean"


class _PairProcessor(StatefulProcessor):
    """Spread, score and position of a pair, with a timer for the time at which an open position has to go."""

    def __init__(self, rule: Thresholds, n: int, least: int, mode: str):
        self.rule, self.n, self.least, self.log = rule, n, least, mode == "log"

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("pair", _STATE)

    def load(self) -> tuple[int | None, Spread, Position]:
        row = self.kept.get()
        last, xs, ys, spreads, z, position, since = row if row is not None else (None, (), (), (), None, 0, 0)
        return last, Spread(self.n, self.least, self.log, xs or (), ys or (), spreads or ()), Position(self.rule, position or 0, since or 0, z)

    def save(self, last: int | None, spread: Spread, held: Position) -> None:
        self.kept.update((last, list(spread.xs), list(spread.ys), list(spread.spreads), held.before, held.position, held.since))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.iloc[0]
        whole = lambda v: tuple(v) if v is not None else ()
        held = Position(self.rule, int(r["position"]), int(r["since"]), None if pd.isna(r["z"]) else float(r["z"]))
        self.save(int(r["last"]), Spread(self.n, self.least, False, whole(r["xs"]), whole(r["ys"]), whole(r["spreads"])), held)
        if due := held.due():
            self.handle.registerTimer(due[0] * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, spread, held = self.load()
        out, was = [], held.due()
        for r in _in_order(rows, ["t"]).itertuples(index=False):
            if last is not None and r.t <= last:  # repeated or late: a pair's time only goes up
                continue
            last = int(r.t)
            beta, s, z = spread.take(float(r.x), float(r.y))
            out.append((key[0], last, beta, s, z, *held.take(last, z), False))
        self.save(last, spread, held)
        now = held.due()
        if was != now:
            if was:
                self.handle.deleteTimer(was[0] * 1000)
            if now:
                self.handle.registerTimer(now[0] * 1000)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, spread, held = self.load()
        due = held.due()
        if due and due[0] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            held.position = 0
            self.save(last, spread, held)
            yield _frame([(key[0], due[0], None, None, None, "EXIT", due[1], 0, True)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    x = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
    return x.astype({"beta": "float64", "spread": "float64", "z": "float64"})


def stream_pairs(aligned: DataFrame, rule: Thresholds, n: int, least: int = 10, mode: str = "raw", grace: str = "0 seconds", history: DataFrame | None = None) -> DataFrame:
    """Rows of pair_signals(spread_z(...)) for a stream aligned(symbol, t, x, y): (symbol, t, beta, spread, z, action, reason,
    position, timed), and a row with ``timed`` where a position is held too long, or past the cutoff, though no row of its
    pair came before the watermark, ``grace`` behind the newest row of all pairs.

    A pair's times only go up: repeated and late rows are left out. ``history`` (of warm_up()) is what was before the stream's
    first row; it is read once, when a query starts on a new checkpoint. State: n bars for each pair.
    """
    timed = aligned.withColumn("_ts", F.timestamp_seconds("t")).withWatermark("_ts", grace)
    start = history.groupBy("symbol") if history is not None else None
    return timed.groupBy("symbol").transformWithStateInPandas(_PairProcessor(rule, n, least, mode), _OUT, "append", "eventTime", initialState=start)


def warm_up(aligned: DataFrame, rule: Thresholds, n: int, least: int = 10, mode: str = "raw") -> DataFrame:
    """(symbol, last, xs, ys, spreads, z, position, since) after the rows of a table aligned(symbol, t, x, y): what
    stream_pairs() starts from to go on as if it had seen them."""
    signals = pair_signals(spread_z(aligned, n, least, mode).select("symbol", "t", "x", "y", "spread", "z"), rule)
    entered = F.when(F.col("action").startswith("ENTER"), F.col("t"))
    at = signals.groupBy(F.col("symbol").alias("_s")).agg(F.max("t").alias("last"), F.max_by("z", F.when(F.col("z").isNotNull(), F.col("t"))).alias("z"), F.max_by("position", "t").alias("position"), F.coalesce(F.max(entered), F.lit(0)).alias("since"))
    w = Window.partitionBy("symbol").orderBy(F.desc("t"))
    value = lambda c: F.when(F.col(c) > 0, F.log(c)) if mode == "log" else F.col(c)
    tail = signals.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    rows = F.array_sort(F.collect_list(F.struct("t", value("x").alias("x"), value("y").alias("y"), "spread")))  # n at most
    tail = tail.groupBy("symbol").agg(rows.alias("r")).select("symbol", F.col("r.x").alias("xs"), F.col("r.y").alias("ys"), F.col("r.spread").alias("spreads"))
    return tail.join(at, F.col("symbol") == F.col("_s")).select("symbol", "last", "xs", "ys", "spreads", "z", "position", "since")


class _WacProcessor(StatefulProcessor):
    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle) -> None:
        self.kept = handle.getValueState("position", "n long, qty long, avg double, realized double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = Wac(*(self.kept.get() or ()))
        out = [(key[0], *held.take(r.side, int(r.qty), float(r.price))) for r in _in_order(rows, self.order).itertuples(index=False)]
        self.kept.update((held.n, held.qty, float(held.avg), float(held.realized)))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "n", "qty", "avg_price", "realized"])


def stream_positions(fills: DataFrame, order: list[str]) -> DataFrame:
    """wac_positions() on a stream of fills(symbol, side, qty, price, order): a symbol's fills must come in order from batch to
    batch, within one they are sorted. State: a position for each symbol."""
    kind = dict(fills.dtypes)["symbol"]
    return fills.groupBy("symbol").transformWithStateInPandas(_WacProcessor(order), f"symbol {kind}, n long, qty long, avg_price double, realized double", "append", "none")


class _AdmitProcessor(StatefulProcessor):
    """What each day of a bucket has used up; a timer drops a day once the watermark is ``keep`` days past it."""

    def __init__(self, budgets: Budgets, order: list[str], day_s: int, keep: int):
        self.budgets, self.order, self.day_s, self.keep = budgets, order, day_s, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "day long", "used double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, reasons = _in_order(rows, self.order), []
        used: dict[int, float] = {}
        for day, notional in zip(pdf["day"].tolist(), pdf["notional"].tolist()):
            if day not in used:
                known = self.used.containsKey((day,))
                used[day] = self.used.getValue((day,))[0] if known else 0.0
                if not known:
                    self.handle.registerTimer((day + 1 + self.keep) * self.day_s * 1000)
            notional = None if pd.isna(notional) else notional
            reason = refusal(self.budgets, key[0], used[day], notional)
            used[day] += 0.0 if reason else notional
            reasons.append(reason)
        for day, v in used.items():
            self.used.updateValue((day,), (v,))
        if len(pdf):
            yield pdf[["day", "id", "notional"]].assign(bucket=key[0], reason=pd.Series(reasons, dtype=object, index=pdf.index))[["bucket", "day", "id", "notional", "reason"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // 1000 // self.day_s - 1 - self.keep
        if self.used.containsKey((day,)):
            self.used.removeKey((day,))
        return iter([])


def stream_admissions(orders: DataFrame, budgets: Budgets, order: list[str], day_s: int = 86400, keep: int = 1, grace: str = "1 day") -> DataFrame:
    """admit_orders() on a stream of orders(bucket, day, id, notional, t seconds, order), day being t // day_s. Orders of a bucket
    and day must come in order from batch to batch, within one they are sorted; those later than ``grace`` are dropped. State:
    a sum for each bucket and day, until the watermark is ``keep`` days past it."""
    timed = orders.withColumn("_ts", F.timestamp_seconds("t")).withWatermark("_ts", grace)
    kinds = dict(orders.dtypes)
    schema = f"bucket {kinds['bucket']}, day long, id {kinds['id']}, notional double, reason string"
    return timed.groupBy("bucket").transformWithStateInPandas(_AdmitProcessor(budgets, order, day_s, keep), schema, "append", "eventTime")
