"""Positions, P&L, sizing, costs and checks over fills and orders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import extended
from .tables import signed


def pnl_snapshot(fills: DataFrame, keys: list[str], order: list[str], brokerage: float = 20.0) -> DataFrame:
    """Realized (sales less average cost of what was sold, less brokerage a fill) and open profit at the last price."""
    buy = F.col("side") == "BUY"
    value, none = F.col("qty") * F.col("price"), F.lit(0)
    g = fills.groupBy(*keys).agg(
        F.sum(F.when(buy, F.col("qty")).otherwise(none)).alias("bought"), F.sum(F.when(buy, none).otherwise(F.col("qty"))).alias("sold"),
        F.sum(F.when(buy, value).otherwise(0.0)).alias("_in"), F.sum(F.when(buy, 0.0).otherwise(value)).alias("_out"), F.count("*").alias("n_fills"), F.max_by("price", F.struct(*order)).alias("last"),
    )
    avg = F.coalesce(F.col("_in") / F.nullif("bought", F.lit(0)), F.lit(0.0))
    realized = F.col("_out") - avg * F.col("sold") - F.col("n_fills") * brokerage
    return g.select(*keys, (F.col("bought") - F.col("sold")).alias("net_qty"), avg.alias("avg_cost"), realized.alias("realized"), ((F.col("last") - avg) * (F.col("bought") - F.col("sold"))).alias("unrealized"))


def over_domain(df: DataFrame, key: str, values: list, measures: dict[str, float]) -> DataFrame:
    """df's sums by key for each of the values, zero where there is none."""
    domain = df.sparkSession.createDataFrame([(v,) for v in values], f"_d {df.schema[key].dataType.simpleString()}")
    g = df.groupBy(key).agg(*[F.sum(m).alias(m) for m in measures])
    return F.broadcast(domain).join(g, F.col("_d") == F.col(key), "left").select(F.col("_d").alias(key), *[F.coalesce(m, F.lit(z)).alias(m) for m, z in measures.items()])


def pair_positions(fills: DataFrame, pair: str, leg: str) -> DataFrame:
    """One row a pair: net quantity, symbol and cash of legs A and B, and the time of its last fill."""
    one = fills.groupBy(pair, leg).agg(F.sum(signed()).alias("q"), F.min("symbol").alias("s"), F.max("t").alias("t"), F.sum(-signed() * F.col("price")).alias("cash"))
    pick = lambda c, x: F.max(F.when(F.col(leg) == x, F.col(c)))
    return one.groupBy(pair).agg(*[pick(c, x).alias(f"{n}_{x.lower()}") for x in "AB" for c, n in (("q", "qty"), ("s", "symbol"))], F.max("t").alias("last_fill"), F.sum("cash").alias("cash"))


class Wac:
    """A symbol's position by weighted average cost: a buy moves the average, a sale realizes on what is held."""

    def __init__(self, n: int = 0, qty: int = 0, avg: float = 0.0, realized: float = 0.0):
        self.n, self.qty, self.avg, self.realized = n, qty, avg, realized

    def take(self, side: str, qty: int, price: float) -> tuple[int, int, float, float]:
        """Fills, quantity, average and realized profit after a fill."""
        if side == "BUY":
            self.avg = (self.qty * self.avg + qty * price) / (self.qty + qty)
            self.qty += qty
        else:
            sold = min(self.qty, qty)
            self.realized += sold * (price - self.avg)
            self.qty -= sold
            self.avg = self.avg if self.qty else 0.0
        self.n += 1
        return self.n, self.qty, self.avg, self.realized


def wac_positions(fills: DataFrame, order: list[str]) -> DataFrame:
    """(symbol, n, qty, avg_price, realized) after each fill, by the rule of Wac.

    A fold in time order, one series a symbol. Rows come sorted to Python in batches and only the state is kept, so a
    symbol of any length fits in memory.
    """
    rows = fills.select("symbol", "side", "qty", "price", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [c for c in rows.columns if c.startswith("_o")]
    dealt = rows.repartition("symbol").sortWithinPartitions("symbol", *keys).select("symbol", "side", "qty", "price")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, Wac()
        for pdf in batches:
            out = []
            for symbol, side, q, px in pdf.itertuples(index=False):
                if symbol != at:
                    at, held = symbol, Wac()
                out.append((symbol, *held.take(side, q, px)))
            yield pd.DataFrame(out, columns=["symbol", "n", "qty", "avg_price", "realized"])

    return dealt.mapInPandas(fold, f"symbol {rows.schema['symbol'].dataType.simpleString()}, n long, qty long, avg_price double, realized double")


def cash_notional(orders: DataFrame, leverage: float = 5.0) -> DataFrame:
    """orders(risk_bucket, px_ref, qty, leverage, ...) with bucket and notional: the bucket's name in capitals (none: MED), and
    what an order takes up, px_ref x qty by its leverage (none: ``leverage``; not above 0: 1). A missing price is 0."""
    bucket = F.upper(F.when(F.length("risk_bucket") > 0, F.col("risk_bucket")).otherwise("MED"))
    lever = F.coalesce(F.expr("try_cast(leverage AS double)"), F.lit(leverage))
    value = F.coalesce(F.col("px_ref").cast("double"), F.lit(0.0)) * F.col("qty")
    return orders.withColumn("bucket", bucket).withColumn("notional", value / F.when(lever > 0, lever).otherwise(1.0))


Budgets = dict[str, tuple[float, float]]


def refusal(budgets: Budgets, bucket: str, used: float, notional: float | None) -> str | None:
    """Why an order of that notional is refused where its bucket has ``used`` already; None if it is admitted."""
    budget, most = budgets.get(bucket, (0.0, 0.0))
    if notional is None or not notional > 0:
        return "bad_notional"
    if notional > most + 1e-6:
        return "exceeds_max_per_trade"
    return "exceeds_bucket_budget" if used + notional > budget + 1e-6 else None


def admit_orders(orders: DataFrame, budgets: Budgets, order: list[str]) -> DataFrame:
    """orders(bucket, day, id, notional, ...) with a reason (null: admitted): in order, each against what its bucket has
    left that day; what is rejected uses nothing up. budgets: budget and most a trade, by bucket; others have none.

    bad_notional and exceeds_max_per_trade do not depend on others, so only the rest goes through the fold.
    """
    per = F.lit(0.0)
    for b, (_, most) in budgets.items():
        per = F.when(F.col("bucket") == b, most).otherwise(per)
    good = F.coalesce("notional", F.lit(float("nan")))
    x = orders.select("bucket", "day", "id", "notional", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.when(F.isnan(good) | (good <= 0), "bad_notional").when(F.col("notional") > per + 1e-6, "exceeds_max_per_trade").alias("reason"))
    keys = [c for c in x.columns if c.startswith("_o")]
    dealt = x.where("reason is null").repartition("bucket", "day").sortWithinPartitions("bucket", "day", *keys).select("bucket", "day", "id", "notional")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = None, 0.0
        for pdf in batches:
            reasons = []
            for bucket, day, _, notional in pdf.itertuples(index=False):
                at, used = ((bucket, day), 0.0) if (bucket, day) != at else (at, used)
                reason = refusal(budgets, bucket, used, notional)
                used += 0.0 if reason else notional
                reasons.append(reason)
            yield pdf.assign(reason=pd.Series(reasons, dtype=object))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", reason string"
    return dealt.mapInPandas(fold, schema).unionByName(x.where("reason is not null").select("bucket", "day", "id", "notional", "reason"))


def size_position(entry: Column, stop: Column, risk: float, cap: float, lot: Column) -> Column:
    """floor(risk / |entry - stop|) and floor(cap / entry), the smaller, in whole lots; without a stop by the cap alone."""
    gap = F.abs(entry - stop)
    by_cap = F.when(entry > 0, F.floor(cap / entry)).otherwise(0)
    by_risk = F.when(stop.isNull() | (stop <= 0) | (gap <= 1e-8), by_cap).otherwise(F.floor(risk / gap))
    units = F.least(by_cap, by_risk)
    return (F.floor(units / lot) * lot).cast("long")


def cost_bps(value: Column, bps: float, pct: float, flat: float) -> Column:
    return value * bps / 1e4 + value * pct + flat


def size_legs(px_a: Column, px_b: Column, beta: Column, notional: float) -> tuple[Column, Column]:
    """Whole quantities of two legs hedged by beta, 1 each at least."""
    scale = notional / (px_a + F.abs(beta) * px_b)
    return F.greatest(F.lit(1), F.floor(scale)).cast("long"), F.greatest(F.lit(1), F.floor(scale * F.abs(beta))).cast("long")


#: Fixed map: states that may follow a state.
FOLLOWS = {"NEW": ["ACK", "REJECTED"], "ACK": ["PARTIAL", "FILLED", "CANCELED", "REJECTED"], "PARTIAL": ["PARTIAL", "FILLED", "CANCELED", "REJECTED"]}
TERMINAL = ["FILLED", "CANCELED", "REJECTED"]


def validate_transitions(audit: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """audit with outcome, in order: applied, repeat (the state it is in), ignored (in a terminal state) or invalid. Only
    what is applied moves the state; the first must be NEW."""

    def make():
        at: list[str] = []

        def step(row):
            now, to = at[0] if at else None, row.state
            if now == to and now is not None:
                return ("repeat",)
            if now in TERMINAL:
                return ("ignored",)
            if to in FOLLOWS.get(now, ["NEW"] if now is None else []):
                at[:] = [to]
                return ("applied",)
            return ("invalid",)

        return step

    return extended(audit, keys, order, make, "outcome string")


def staleness(latest: DataFrame, now: Column, step: int) -> DataFrame:
    age = now - F.col("t")
    return latest.withColumn("status", F.when(F.col("t").isNull(), "INIT").when(age <= 1.5 * step, "OK").when(age <= 3 * step, "WARN").otherwise("STALE"))


def threshold_alerts(state: DataFrame, entry: float, leave: float, stop: float, buffer: float) -> DataFrame:
    """A row for each level that z is within ``buffer`` of: ENTRY when flat, EXIT and STOP in a position."""
    z = F.abs("z")
    gaps = [("ENTRY", F.col("position") == 0, F.abs(z - entry)), ("EXIT", F.col("position") != 0, F.abs(z - leave)), ("STOP", F.col("position") != 0, F.abs(z - stop))]
    near = F.array_compact(F.array(*[F.when(on & (gap <= buffer), F.struct(F.lit(n).alias("kind"), F.round(gap, 6).alias("gap"))) for n, on, gap in gaps]))
    return state.select("symbol", "t", F.explode(near).alias("x")).select("symbol", "t", "x.*")


def first_latency(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Seconds from an order to its first fill after it."""
    first = fills.groupBy(F.col("order_id").alias("_o")).agg(F.min("t").alias("t_fill"))
    return orders.join(first, F.col("order_id") == F.col("_o")).where("t_fill > t").select("order_id", "t", (F.col("t_fill") - F.col("t")).alias("latency"))


def pair_join(live: DataFrame, universe: DataFrame, values: list[str]) -> DataFrame:
    """live(a, b, ...) with universe's values for the same two names in either order; live's own come first."""
    u = universe.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"), *[F.col(v).alias(f"_{v}") for v in values])
    j = live.join(u, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left")
    return j.select("a", "b", *[F.coalesce(v, f"_{v}").alias(v) for v in values])
