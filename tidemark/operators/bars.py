"""Ticks to bars, bars to larger bars, and the quality of bars. Times are epoch seconds; bars are keyed by their start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(seconds: Column, width: int) -> Column:
    return seconds - F.pmod(seconds, F.lit(width))


def tick_bars(ticks: DataFrame, width: int) -> DataFrame:
    """Bars of ``width`` seconds of ticks(symbol, ts, id, ltp, vol): first and last price by (ts, id), never by arrival."""
    key = F.struct("ts", "id")
    return ticks.groupBy("symbol", bucket(F.unix_seconds("ts"), width).alias("t")).agg(
        F.min_by("ltp", key).alias("o"), F.max("ltp").alias("h"), F.min("ltp").alias("l"), F.max_by("ltp", key).alias("c"),
        F.sum(F.coalesce("vol", F.lit(0))).alias("vol"), F.count("*").alias("n_trades"),
    )


def _merged() -> list[Column]:
    return [F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("vol").alias("vol"), F.sum("n_trades").alias("n_trades")]


def rollup_bars(bars: DataFrame, width: int) -> DataFrame:
    return bars.groupBy("symbol", bucket(F.col("t"), width).alias("b")).agg(*_merged()).withColumnRenamed("b", "t")


def rollup_multi(bars: DataFrame, widths: list[int]) -> DataFrame:
    """Several widths in one shuffle: a bar goes to one bucket of each; column tf holds the width."""
    each = bars.withColumn("tf", F.explode(F.array(*[F.lit(w).cast("long") for w in widths])))
    return each.groupBy("symbol", "tf", (F.col("t") - F.pmod("t", "tf")).alias("b")).agg(*_merged()).withColumnRenamed("b", "t")


def golden_bars(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars of minutes that divide the hour, floored within it."""
    if 60 % minutes:
        raise ValueError("minutes must divide 60")
    return rollup_bars(bars, minutes * 60)


def resample_close(bars: DataFrame, width: int, include_last: bool = True) -> DataFrame:
    """Last close of each bucket; without include_last a symbol's newest bucket, which may be open, is left out."""
    out = bars.groupBy("symbol", bucket(F.col("t"), width).alias("b")).agg(F.max_by("c", "t").alias("c")).withColumnRenamed("b", "t")
    if include_last:
        return out
    return out.withColumn("_last", F.max("t").over(Window.partitionBy("symbol"))).where("t < _last").drop("_last")


def running_bars(bars: DataFrame, width: int) -> DataFrame:
    """For each input bar the bar of its bucket as it stands then."""
    w = Window.partitionBy("symbol", "b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    keyed = bars.withColumn("b", bucket(F.col("t"), width))
    return keyed.select("symbol", "b", "t", F.first("o").over(w).alias("o"), F.max("h").over(w).alias("h"), F.min("l").over(w).alias("l"), "c", F.sum("vol").over(w).alias("vol"))


def gap_fill(bars: DataFrame, step: int, shift: int = 19800) -> DataFrame:
    """Bars and, between a local day's neighbouring bars, linearly interpolated ones for the missing steps (filled = 1).

    ``shift`` is the exchange's offset from UTC in seconds; nothing is filled across local days.
    """
    day = F.floor((F.col("t") + shift) / 86400)
    w = Window.partitionBy("symbol", "day").orderBy("t")
    named = bars.withColumn("day", day)
    nxt = named.select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("t", "o", "h", "l", "c", "vol")])
    last = F.when(F.col("n_t").isNotNull(), F.col("n_t") - step).otherwise(F.col("t"))
    at = nxt.withColumn("s", F.explode(F.sequence(F.col("t"), F.greatest("t", last), F.lit(step).cast("long"))))
    share = (F.col("s") - F.col("t")) / (F.col("n_t") - F.col("t"))
    mid = lambda c: F.when(F.col("s") == F.col("t"), F.col(c)).otherwise(F.col(c) + (F.col(f"n_{c}") - F.col(c)) * share).alias(c)
    vol = F.when(F.col("s") == F.col("t"), F.col("vol")).otherwise(F.round(F.col("vol") + (F.col("n_vol") - F.col("vol")) * share)).cast("long")
    return at.select("symbol", F.col("s").alias("t"), *map(mid, ("o", "h", "l", "c")), vol.alias("vol"), (F.col("s") != F.col("t")).cast("int").alias("filled"))


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("x")).select(*keys, "x.*")


def bar_checksum(bars: DataFrame, shift: int = 19800) -> DataFrame:
    day = F.floor((F.col("t") + shift) / 86400)
    return bars.groupBy("symbol", day.alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("c"), 4).alias("sum_c"), F.sum("vol").alias("sum_vol"))


def bars_to_ticks(bars: DataFrame) -> DataFrame:
    """Four ticks a bar (o, h, l, c), a quarter of the volume each, 1 at least."""
    legs = F.array(*[F.struct(F.lit(i).alias("leg"), F.col(c).alias("ltp")) for i, c in enumerate("ohlc")])
    return bars.select("symbol", "t", F.explode(legs).alias("x"), F.greatest(F.lit(1), F.floor(F.col("vol") / 4)).alias("vol")).select("symbol", "t", "x.*", "vol")


def candidate_symbols(bars: DataFrame, least: int, limit: int) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "symbol").limit(limit)


def in_session(df: DataFrame, opens: int = 555, closes: int = 930, shift: int = 19800) -> DataFrame:
    """Rows whose local minute of the day lies in the session, with that minute."""
    minute = F.floor(F.pmod(F.col("t") + shift, F.lit(86400)) / 60)
    return df.withColumn("minute", minute).where(F.col("minute").between(opens, closes))


def merge_bars(target: DataFrame, updates: DataFrame, policy: str = "replace") -> DataFrame:
    """Keyed upsert: replace takes the update; additive takes max h, min l, the new c and adds vol and n_trades, its o
    from the update; additive_keep_open keeps o; verify replaces but keeps the larger n_trades."""
    t, u = target.alias("t"), updates.alias("u")
    old, new = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"u.{c}"))
    both = old("t").isNotNull() & new("t").isNotNull()
    pick = lambda c: F.coalesce(new(c), old(c))
    keep = lambda c: F.coalesce(old(c), new(c))
    add = lambda c: F.when(both, old(c) + new(c)).otherwise(pick(c))
    how = {
        "replace": {},
        "additive": {"h": F.greatest(old("h"), new("h")), "l": F.least(old("l"), new("l")), "vol": add("vol"), "n_trades": add("n_trades")},
        "verify": {"n_trades": F.greatest(old("n_trades"), new("n_trades"))},
    }
    how["additive_keep_open"] = how["additive"] | {"o": keep("o")}
    cols = [how[policy].get(c, pick(c)).alias(c) for c in ("o", "h", "l", "c", "vol", "n_trades")]
    return t.join(u, (old("symbol") == new("symbol")) & (old("t") == new("t")), "full").select(keep("symbol").alias("symbol"), keep("t").alias("t"), *cols)


def reconcile(local: DataFrame, vendor: DataFrame, absolute: float = 0.02, relative: float = 0.001) -> DataFrame:
    """Reasons by (symbol, t) where local and vendor bars differ: missing_local, missing_vendor, ohlc, vol."""
    a, b = local.alias("a"), vendor.alias("b")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    close = lambda c: F.when(y(c) == 0, x(c) == 0).otherwise(F.abs(x(c) - y(c)) <= F.greatest(F.lit(absolute), relative * F.abs(y(c))))
    same = close("o") & close("h") & close("l") & close("c")
    reason = F.when(x("t").isNull(), "missing_local").when(y("t").isNull(), "missing_vendor").otherwise(F.concat_ws(",", F.when(~same, "ohlc"), F.when(x("vol") != y("vol"), "vol")))
    joined = a.join(b, (x("symbol") == y("symbol")) & (x("t") == y("t")), "full")
    return joined.select(F.coalesce(x("symbol"), y("symbol")).alias("symbol"), F.coalesce(x("t"), y("t")).alias("t"), reason.alias("reason")).where("reason <> ''")


def diff_upsert(target: DataFrame, incoming: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """What an upsert of incoming would do to each of its rows: insert, update or skip."""
    a, b = incoming.alias("a"), target.alias("b")
    near = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance for c in "ohlc"]
    same = near[0] & near[1] & near[2] & near[3] & (F.col("a.vol") == F.col("b.vol"))
    joined = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.t") == F.col("b.t")), "left")
    return joined.select("a.symbol", "a.t", F.when(F.col("b.t").isNull(), "insert").when(same, "skip").otherwise("update").alias("action"))


def heal(local: DataFrame, vendor: DataFrame, shift: int = 19800) -> DataFrame:
    """Local bars with every symbol-day of another checksum replaced wholesale by the vendor's."""
    a, b = bar_checksum(local, shift).alias("a"), bar_checksum(vendor, shift).alias("b")
    on = (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.day") == F.col("b.day"))
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.sum_c").eqNullSafe(F.col("b.sum_c")) & F.col("a.sum_vol").eqNullSafe(F.col("b.sum_vol"))
    bad = b.join(a, on, "left").where(~same).select(F.col("b.symbol").alias("_s"), F.col("b.day").alias("_d"))
    day = F.floor((F.col("t") + shift) / 86400)
    on = (F.col("symbol") == F.col("_s")) & (day == F.col("_d"))
    return local.join(bad, on, "left_anti").unionByName(vendor.join(bad, on, "left_semi"))
