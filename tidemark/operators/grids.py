"""Parameter grids: expansion, refinement, evaluation over bars, scores and selection."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Ledger, emitted
from .tables import cohort_z, topk


def expand_grid(spec: DataFrame) -> DataFrame:
    """(strategy, tf, params map<string,double>) for spec(strategy, tf, name, values array<double>): every combination.

    The names of a (strategy, tf) are folded one after another in sorted order into the combinations so far.
    """
    per = spec.groupBy("strategy", "tf").agg(F.sort_array(F.collect_list(F.struct("name", "values"))).alias("axes"))
    none = F.array(F.create_map().cast("map<string,double>"))
    grown = lambda acc, axis: F.flatten(F.transform(acc, lambda m: F.transform(axis["values"], lambda v: F.map_concat(m, F.create_map(axis["name"], v)))))
    return per.select("strategy", "tf", F.explode(F.aggregate("axes", none, grown)).alias("params"))


def filter_grid(grid: DataFrame, expr: str, names: list[str]) -> DataFrame:
    """The combinations for which the SQL condition over the named parameters is true; those that lack one are dropped."""
    named = grid.select("*", *[F.element_at("params", n).alias(n) for n in names])
    return named.where(F.expr(expr)).drop(*names)


def variant_key(strategy: Column, params: Column) -> Column:
    """strategy__a=1.0_b=2.0, by name."""
    entries = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.concat(strategy, F.lit("__"), F.array_join(entries, "_"))


def refine_neighbors(grid: DataFrame, winners: DataFrame) -> DataFrame:
    """(strategy, tf, name, value): for winners(strategy, tf, name, value) the values of grid(strategy, tf, name, values)
    one step around the nearest (the smaller of two as near)."""
    j = winners.join(grid, ["strategy", "tf", "name"]).withColumn("xs", F.array_sort(F.array_distinct("values")))
    away = F.transform("xs", lambda x, i: F.struct(F.abs(x - F.col("value")).alias("d"), i.alias("i")))
    at = F.array_min(away)["i"]
    near = F.slice("xs", F.greatest(at, F.lit(1)), F.when(at == 0, 2).otherwise(3))
    return j.select("strategy", "tf", "name", F.explode(near).alias("value")).distinct()


def refine_radius(grid: DataFrame, winners: DataFrame, radius: float = 0.25) -> DataFrame:
    """(strategy, tf, name, value): the grid's values and, for each winner, those a radius away: whole numbers for axes of
    whole numbers, rounded outwards and positive, else to 6 places."""
    whole = F.forall("values", lambda x: x == F.floor(x))
    j = winners.join(grid, ["strategy", "tf", "name"]).withColumn("whole", whole & (F.col("value") == F.floor("value")))
    low, high = F.col("value") * (1 - radius), F.col("value") * (1 + radius)
    ints = F.filter(F.array(F.greatest(F.floor(low).cast("double"), F.lit(1.0)), F.col("value"), F.ceil(high).cast("double")), lambda x: x > 0)
    reals = F.array(F.round(F.greatest(low, F.lit(0.0)), 6), F.round("value", 6), F.round(high, 6))
    more = j.select("strategy", "tf", "name", F.explode(F.when(F.col("whole"), ints).otherwise(reals)).alias("value"))
    return more.union(grid.select("strategy", "tf", "name", F.explode("values"))).distinct()


class FixedExits(Ledger):
    """One position at a time from actions at the close; out at the stop or, failing that, the target when a later bar
    reaches it, clamped to the bar; at the first bar from the cutoff on, and at the end."""

    def __init__(self, capital: float, target: float, stop: float, cutoff: int | None, shift: int):
        self.capital, self.target, self.stop, self.cutoff, self.shift = capital, target, stop, cutoff, shift
        self.open = self.last = None

    def late(self, t: int) -> bool:
        return self.cutoff is not None and (t + self.shift) % 86400 // 60 >= self.cutoff

    def out(self, t: int, px: float, reason: str) -> tuple:
        way, t0, px0, qty = self.open
        self.open = None
        return ("LONG" if way > 0 else "SHORT"), t0, px0, qty, t, px, reason, way * qty * (px - px0)

    def take(self, row):
        self.last = row
        if self.open and self.late(row.t):
            yield self.out(row.t, row.c, "squareoff")
        if not self.open:
            way = {"BUY": 1, "SELL": -1}.get(row.action, 0)
            qty = math.floor(self.capital / row.c) if way else 0
            if qty > 0:
                self.open = (way, row.t, row.c, qty)
        else:
            way, _, px, _ = self.open
            stop, target = px * (1 - way * self.stop), px * (1 + way * self.target)
            hit_stop = self.stop > 0 and (row.l <= stop if way > 0 else row.h >= stop)
            hit_target = self.target > 0 and (row.h >= target if way > 0 else row.l <= target)
            if hit_stop or hit_target:
                yield self.out(row.t, min(max(stop if hit_stop else target, row.l), row.h), "stop" if hit_stop else "target")
        if self.open and self.late(row.t):
            yield self.out(row.t, row.c, "squareoff")

    def end(self):
        if self.open:
            yield self.out(self.last.t, self.last.c, "end")


def trades_fixed(rows: DataFrame, keys: list[str], capital: float, target: float, stop: float, cutoff: int | None = None, shift: int = 19800) -> DataFrame:
    """Trades of rows(keys, t, h, l, c, action) under FixedExits."""
    schema = "side string, t_entry long, px_entry double, qty long, t_exit long, px_exit double, reason string, pnl double"
    return emitted(rows, keys, ["t"], lambda _: FixedExits(capital, target, stop, cutoff, shift), schema)


def crossings(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """(symbol, variant, t, c, action) of bars(symbol, t, c) for each of grid(variant, fast, slow): moving means that cross.

    The means of all lengths in the grid are built once from running sums by row number; a variant then takes two of them,
    so the bars are laid out once and not once a combination.
    """
    w = Window.partitionBy("symbol").orderBy("t")
    summed = bars.select("symbol", "t", "c", F.row_number().over(w).alias("n"), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    lengths = sorted({int(v) for r in grid.select("fast", "slow").distinct().collect() for v in r})  # the grid's axes
    means = F.create_map(*[x for n in lengths for x in (F.lit(n), F.when(F.col("n") >= n, (F.col("s") - F.coalesce(F.lag("s", n).over(w), F.lit(0.0))) / n))])
    of = lambda name: F.round(F.element_at("means", F.col(name).cast("int")), 6)
    each = summed.withColumn("means", means).crossJoin(F.broadcast(grid)).select("symbol", "variant", "t", "c", of("fast").alias("f"), of("slow").alias("g"))
    each = each.withColumn("zone", F.when(F.col("f") > F.col("g"), 1).when(F.col("f") < F.col("g"), -1))
    upto = Window.partitionBy("symbol", "variant").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("zone", ignorenulls=True).over(upto)
    return each.select("symbol", "variant", "t", "c", F.when(F.col("zone") != before, F.when(F.col("zone") > 0, "BUY").otherwise("SELL")).otherwise("FLAT").alias("action"))


#: Fixed weights of the composite score by metric: (weight, sign, absolute value).
WEIGHTS = {
    "ret": (2.5, 1), "sharpe": (1.2, 1), "sortino": (0.8, 1), "win_rate": (0.6, 1), "stability": (0.6, 1), "max_dd": (0.7, -1),
    "ulcer": (0.4, -1), "turnover": (0.10, -1), "avg_hold_min": (0.10, -1), "latency_ms": (0.0, -1), "penalties": (0.4, -1),
}
NEGATIVE_RETURN = 2.0


def score(rows: DataFrame, ids: list[str], keys: list[str], half_life: float | None = None, age: str = "age_days") -> DataFrame:
    """rows with score: the weighted robust scores of their metrics within the keys' cohort, less a penalty for negative
    returns, fading with the age in days. The return is R, else pnl_total; drawdowns count by size.

    ``ids`` name a row. The metrics are laid out in long form, so all are scored in one pass, whatever their number.
    """
    value = {"ret": F.coalesce("R", "pnl_total"), "max_dd": F.abs("max_dd")}
    every = [F.struct(F.lit(n).alias("name"), value.get(n, F.col(n)).cast("double").alias("v"), F.lit(float(w * sign)).alias("w")) for n, (w, sign) in WEIGHTS.items()]
    long = rows.select(*dict.fromkeys([*ids, *keys]), F.explode(F.array(*every)).alias("_m")).select("*", "_m.*").drop("_m")
    total = cohort_z(long, [*keys, "name"], "v").groupBy(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)]).agg(F.sum(F.col("w") * F.col("z")).alias("_z"))
    base = F.col("_z") - F.when(value["ret"] < 0, NEGATIVE_RETURN).otherwise(0.0)
    if half_life:
        base = base * F.coalesce(F.exp(-math.log(2) * F.greatest(F.col(age), F.lit(0.0)) / half_life), F.lit(1.0))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_id{i}")) for i, c in enumerate(ids)])
    return rows.join(total, same).withColumn("score", base).drop("_z", *[f"_id{i}" for i in range(len(ids))])


def select_configs(scored: DataFrame, k: int) -> DataFrame:
    """Coarse selection: the k best (strategy, timeframe, params) of each (strategy, timeframe) by mean score."""
    g = scored.groupBy("strategy", "timeframe", "params").agg(F.round(F.avg("score") + 1e-9, 4).alias("score"), F.count("*").alias("n"))
    return topk(g, ["strategy", "timeframe"], [F.desc("score"), F.col("params")], k)


def select_final(scored: DataFrame, least_win: float, cap: int) -> DataFrame:
    """Fine selection: rows that win often enough, the best ``cap`` of each symbol by score."""
    order = [F.desc("score"), F.col("strategy"), F.col("timeframe")]
    return topk(scored.where(F.col("win_rate") * F.when(F.col("win_rate") <= 1, 100).otherwise(1) >= least_win), ["symbol"], order, cap)


def select_pairs(scored: DataFrame, least_win: float, least_profit: float, cap: int, k: int) -> DataFrame:
    """Next day's pairs of scored(symbol, leg_x, leg_y, score, win_pct, profit, ...): good enough, one a pair of legs in
    either order, at most ``cap`` a symbol, the k best of all."""
    good = scored.where((F.col("win_pct") >= least_win) & (F.col("profit") >= least_profit))
    legs = [F.least("leg_x", "leg_y"), F.greatest("leg_x", "leg_y")]
    order = [F.desc("score"), F.col("symbol"), F.col("leg_x"), F.col("leg_y")]
    one = good.withColumn("_n", F.row_number().over(Window.partitionBy(*legs).orderBy(*order))).where("_n = 1").drop("_n")
    return topk(one, ["symbol"], order, cap).drop("rank").orderBy(*order).limit(k)


def _bump(x: Column, low: float, high: float, good: float, ok: float) -> Column:
    away = F.least(F.abs(x - low), F.abs(x - high))
    return F.when(x.isNull(), 0.0).when(x.between(low, high), good).otherwise(F.greatest(F.lit(0.0), ok - 0.1 * away))


def heuristic(tp: Column, sl: Column, trailing: Column) -> Column:
    """Score of exit settings in percent: near usual bands is good, far from them bad."""
    #: Fixed bands in per cent, and what being within or far from them is worth.
    odd = lambda x: F.when((x < 0.1) | (x > 3.0), 1.0).otherwise(0.0)
    rr = F.when(sl != 0, tp / sl)
    total = _bump(tp, 0.5, 1.5, 1.5, 0.6) - odd(tp) + _bump(sl, 0.3, 1.0, 1.2, 0.5) - odd(sl) + _bump(rr, 1.2, 2.0, 1.2, 0.5)
    return total + F.when(trailing.isNotNull(), 0.2).otherwise(0.0)


def rank_configs(configs: DataFrame) -> DataFrame:
    """configs(name, tp, sl, trail) with score and rank, by name where scores tie.

    Scores lie in a range of a few units, so they are ranked within hundredths of a unit; what is ranked before each of these
    comes from one count a hundredth.
    """
    x = configs.withColumn("score", F.round(heuristic(F.col("tp"), F.col("sl"), F.col("trail")), 6))
    x = x.withColumn("_b", F.coalesce(F.floor(F.col("score") * 100), F.lit(-(1 << 40))))
    per = x.groupBy(F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("_c", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("score"), "name"))
    ranked = x.withColumn("_r", within).join(per, F.col("_b") == F.col("_c"))
    return ranked.withColumn("rank", (F.col("_before") + F.col("_r")).cast("int")).drop("_b", "_c", "_before", "_r")


def export_selections(picks: DataFrame, budgets: dict[str, float], values: list[str]) -> DataFrame:
    """picks as documents: (symbol, strategy, doc) with values rounded, nulls left out and the bucket's budget added."""
    budget = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(v)) for b, v in budgets.items()], F.lit(None))
    stats = F.struct(*[F.round(v, 4).alias(v) for v in values])
    return picks.select("symbol", "strategy", F.to_json(F.struct("symbol", "strategy", "timeframe", "bucket", budget.alias("budget"), stats.alias("stats"))).alias("doc"))
