"""Marks, exposure and order rates, checks of bars and positions against an outside source, picks, costs, intents, grids of any signal."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledgers import size_position
from .tables import trade_stats, trades_from_signals

# --- what is held


def marks(bars: DataFrame) -> DataFrame:
    """(symbol, px): the close of each symbol's last bar."""
    return bars.groupBy("symbol").agg(F.max_by("c", "t").alias("px"))


def marked(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """positions(symbol, net_qty, avg_cost, ...) with unrealized: what is held at its mark less what it cost; 0 where nothing is
    held or there is no mark (or one of 0), as then the average cost stands for it."""
    p = prices.select(F.col("symbol").alias("_s"), F.col("px").alias("_px"))
    mark = F.when(F.coalesce("_px", F.lit(0.0)) == 0, F.col("avg_cost")).otherwise(F.col("_px"))
    return positions.drop("unrealized").join(p, F.col("symbol") == F.col("_s"), "left").withColumn("unrealized", (mark - F.col("avg_cost")) * F.col("net_qty")).drop("_s", "_px")


def bucket_exposure(fills: DataFrame, prices: DataFrame) -> DataFrame:
    """(bucket, notional): quantities filled on either side at their symbols' marks; 0 without a mark."""
    p = prices.select(F.col("symbol").alias("_s"), F.col("px").alias("_px"))
    held = fills.groupBy("symbol", "bucket").agg(F.sum("qty").alias("q"))
    return held.join(p, F.col("symbol") == F.col("_s"), "left").groupBy("bucket").agg(F.sum(F.col("q") * F.coalesce("_px", F.lit(0.0))).alias("notional"))


# --- orders


def order_rates(orders: DataFrame, fills: DataFrame, now: Column, width: int = 86400, open_states: Sequence[str] = ("NEW", "ACK", "PENDING", "OPEN")) -> DataFrame:
    """One row: open orders now; orders and fills of the last ``width`` seconds; the shares of those orders that were cancelled
    and rejected, 0 without orders."""
    recent = F.col("t") >= now - width
    status = F.coalesce("status", F.lit(""))
    share = lambda s: F.coalesce(F.count_if(recent & (status == s)) / F.nullif(F.count_if(recent), F.lit(0)), F.lit(0.0))
    o = orders.agg(F.count_if(status.isin(*open_states)).alias("open_now"), F.count_if(recent).alias("orders"), share("CANCELLED").alias("cancel_rate"), share("REJECTED").alias("reject_rate"))
    return o.join(fills.agg(F.count_if(recent).alias("fills")), F.lit(True))  # a row each


def eod_summary(orders: DataFrame, fills: DataFrame, positions: DataFrame, day_s: int = 86400) -> DataFrame:
    """(day, orders, fills, symbols, realized) of each day with orders or fills; realized is what all positions have realized."""
    day = F.floor(F.col("t") / day_s)
    o = orders.groupBy(day.alias("day")).agg(F.count("*").alias("orders"))
    f = fills.groupBy(day.alias("_d")).agg(F.count("*").alias("fills"), F.count_distinct("symbol").alias("symbols"))
    both = o.join(f, F.col("day") == F.col("_d"), "full").select(F.coalesce("day", "_d").alias("day"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "fills", "symbols")])
    return both.join(positions.agg(F.coalesce(F.sum("realized"), F.lit(0.0)).alias("realized")), F.lit(True))  # the sum is one row


def counter_increases(samples: DataFrame, width: int, slide: int, series: list[str], by: list[str]) -> DataFrame:
    """(by, start, increase) in sliding windows of ``width`` seconds, from every ``slide`` on: how far the sum of the counters
    samples(t, id, value, series) of the same ``by`` went up, 0 where it went down. A sample counts in each window it lies in,
    with the first and last value of its series there."""
    starts = F.sequence(F.col("t") - F.pmod("t", F.lit(slide)) - (width // slide - 1) * slide, F.col("t") - F.pmod("t", F.lit(slide)), F.lit(slide))
    keys = list(dict.fromkeys([*by, *series]))
    each = samples.select(*keys, "t", "id", "value", F.explode(starts).alias("start")).where(F.col("t") < F.col("start") + width)
    rise = F.max_by("value", F.struct("t", "id")) - F.min_by("value", F.struct("t", "id"))
    return each.groupBy(*keys, "start").agg(rise.alias("rise")).groupBy(*by, "start").agg(F.greatest(F.lit(0.0), F.sum("rise")).alias("increase"))


# --- bars and positions against an outside source


def _near(x: Column, y: Column, absolute: float, relative: float) -> Column:
    return F.abs(x - y) <= F.greatest(F.lit(absolute), F.abs(y) * relative)


def verify_recent(local: DataFrame, vendor: DataFrame, k: int, absolute: float = 0.01, relative: float = 0.0005, volume: int = 0) -> DataFrame:
    """(symbol, t, reason, o, h, l, c, vol): the vendor's bars that are to replace local ones, of the last k times that either
    side has for a symbol: missing_local, or the comma-joined names of what differs. What the vendor lacks stays as it is.

    The last k of both are among the last k of each, so only those are joined.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("t"))
    last = lambda df: df.select("symbol", "t", "o", "h", "l", "c", "vol").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    a, b = last(local).alias("a"), last(vendor).alias("b")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    both = a.join(b, (x("symbol") == y("symbol")) & (x("t") == y("t")), "full")
    differ = F.concat_ws(",", *[F.when(~_near(x(c), y(c), absolute, relative), c) for c in "ohlc"], F.when(F.abs(x("vol") - y("vol")) > volume, "vol"))
    reason = F.when(y("t").isNull(), "").when(x("t").isNull(), "missing_local").otherwise(differ)
    rows = both.select(F.coalesce(x("symbol"), y("symbol")).alias("symbol"), F.coalesce(x("t"), y("t")).alias("t"), reason.alias("reason"), *[y(c).alias(c) for c in ("o", "h", "l", "c", "vol")])
    return rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= k) & (F.col("reason") != "")).drop("_n")


def reconcile_summary(detail: DataFrame) -> DataFrame:
    """(symbol, missing_local, missing_vendor, ohlc, vol) counts of the reasons of reconcile()."""
    has = lambda r: F.count_if(F.array_contains(F.split("reason", ","), r)).alias(r)
    return detail.groupBy("symbol").agg(*[has(r) for r in ("missing_local", "missing_vendor", "ohlc", "vol")])


def heal_report(local: DataFrame, vendor: DataFrame, apply: bool = False) -> DataFrame:
    """(symbol, day, n_local, n_vendor, action) of checksums(symbol, day, n, sum_c, sum_vol) of both sides: OK, or what healing does
    or would do: APPLY, DRY, or NONE where the vendor has nothing to put there."""
    a, b = local.alias("a"), vendor.alias("b")
    same = F.lit(True)
    for c in ("n", "sum_c", "sum_vol"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    action = F.when(same, "OK").when(F.col("b.n").isNull(), "NONE").otherwise("APPLY" if apply else "DRY")
    both = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.day") == F.col("b.day")), "full")
    return both.select(F.coalesce("a.symbol", "b.symbol").alias("symbol"), F.coalesce("a.day", "b.day").alias("day"), F.col("a.n").alias("n_local"), F.col("b.n").alias("n_vendor"), action.alias("action"))


def bar_fingerprint(bars: DataFrame) -> DataFrame:
    """(symbol, t, md5) of a bar's prices to four places and its volume."""
    text = F.concat_ws(",", *[F.format_string("%.4f", F.col(c)) for c in "ohlc"], F.col("vol").cast("string"))
    return bars.select("symbol", "t", F.md5(text).alias("md5"))


def position_check(diffs: DataFrame, tolerance: int = 0, kill: int = 0, most: int = 0) -> DataFrame:
    """One row of position_diff(): symbols that differ by more than ``tolerance``; breach where one differs by more than ``kill``
    (0: never); halt where there is a breach or more than ``most`` differ."""
    far = F.abs("diff")
    one = diffs.agg(F.count_if(far > tolerance).alias("mismatched"), F.coalesce(F.bool_or((far > kill) & F.lit(kill > 0)), F.lit(False)).alias("breach"))
    return one.withColumn("halt", F.col("breach") | (F.col("mismatched") > most))


def unknown_orders(broker: DataFrame, local: DataFrame) -> DataFrame:
    """The broker's open orders(tag, status, ...) whose tag is no client_id of ours; without a tag nothing can be said."""
    open_ = ~F.lower(F.coalesce("status", F.lit(""))).isin("complete", "cancelled", "rejected")
    known = local.select(F.col("client_id").alias("_k"))
    return broker.where(open_ & (F.coalesce(F.length("tag"), F.lit(0)) > 0)).join(known, F.col("tag") == F.col("_k"), "left_anti")


def presence_audit(rows: DataFrame, names: list[str]) -> DataFrame:
    """(name, present, missing) of each column."""
    counts = rows.agg(F.count("*").alias("_all"), *[F.count(n).alias(n) for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("present"), (F.col("_all") - F.col(n)).alias("missing")) for n in names]))
    return counts.select(each.alias("x")).select("x.*")


# --- picks

_PICKS = (
    "struct<selections:array<struct<symbol:string,tf_min:int,entries:array<struct<strategy:string,params:map<string,string>>>>>,"
    "use:array<struct<symbol:string,strategy:string,tf:int,params:map<string,string>>>>"
)


def params_key(params: Column) -> Column:
    """A text that equal parameters share whatever their order: sorted names with values; no parameters are the empty map."""
    some = F.coalesce(params, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(some))))


def flatten_picks(docs: DataFrame, text: str = "doc") -> DataFrame:
    """(strategy, symbol, tf, params_key) of JSON documents of two shapes: selections by symbol and tf with entries, and a list
    to use. Entries without a symbol or strategy are left out; repeated picks stand once."""
    j = docs.select(F.from_json(text, _PICKS).alias("j"))
    a = j.select(F.explode("j.selections").alias("s")).select("s.symbol", F.col("s.tf_min").alias("tf"), F.explode("s.entries").alias("e")).select("e.strategy", "symbol", "tf", "e.params")
    b = j.select(F.explode("j.use").alias("u")).select("u.strategy", "u.symbol", "u.tf", "u.params")
    trimmed = a.union(b).select(F.trim("strategy").alias("strategy"), F.trim("symbol").alias("symbol"), "tf", params_key(F.col("params")).alias("params_key"))
    return trimmed.where("strategy <> '' and symbol <> ''").distinct()


def restrict_to_selected(signals: DataFrame, picks: DataFrame) -> DataFrame:
    """The rows of signals(strategy, symbol, tf, params, ...) whose strategy, symbol, timeframe and parameters were picked."""
    p = picks.select(*[F.col(c).alias(f"_{c}") for c in ("strategy", "symbol", "tf", "params_key")])
    on = [F.col(c) == F.col(f"_{c}") for c in ("strategy", "symbol", "tf")] + [params_key(F.col("params")) == F.col("_params_key")]
    return signals.join(p, on, "left_semi")


# --- costs and intents


def fill_price(side: Column, price: Column, bps: float | Column) -> Column:
    """The price with slippage against the side."""
    return price * (1 + F.when(side == "BUY", 1).otherwise(-1) * bps / 1e4)


def cost_roundtrip(qty: Column, px_in: Column, px_out: Column, slippage: float = 2.0, fee: float = 5.0) -> Column:
    """Profit of a long trade with slippage on both sides and a fee for each."""
    return (px_out * (1 - slippage / 1e4) - px_in * (1 + slippage / 1e4)) * qty - 2 * fee


def _places(x: Column, n: int) -> Column:
    """A double to n places as SQL rounds it: the multiple nearest to the scaled double, which can lie just below a half where
    the decimal that F.round() goes by is one."""
    return F.round(x * 10.0**n) / 10.0**n


def cost_equity(side: Column, price: Column, qty: Column, bucket: Column, rates: dict[str, float], overrides: dict[str, float] | None = None) -> Column:
    """A struct of an order's estimated costs: fill_price, total and its parts. rates: brokerage a leg; exchange, sebi, stt (sales),
    stamp (purchases) as shares of the value; gst on brokerage and exchange; slippage in basis points, by bucket in ``overrides``."""
    r = {k: float(rates.get(k, 0.0)) for k in ("brokerage", "exchange", "sebi", "stt", "stamp", "gst", "slippage")}
    bps = F.lit(r["slippage"])
    for b, v in (overrides or {}).items():
        bps = F.when(bucket == b, float(v)).otherwise(bps)
    value, brokerage = price * qty, F.lit(r["brokerage"])
    exchange, sebi = value * r["exchange"], value * r["sebi"]
    stt, stamp = F.when(side == "SELL", value * r["stt"]).otherwise(0.0), F.when(side == "BUY", value * r["stamp"]).otherwise(0.0)
    gst = (brokerage + exchange) * r["gst"]
    parts = {"brokerage": brokerage, "exchange": exchange, "sebi": sebi, "stt": stt, "stamp": stamp, "gst": gst}
    total = brokerage + exchange + sebi + stt + stamp + gst
    return F.struct(_places(fill_price(side, price, bps), 4).alias("fill_price"), _places(total, 2).alias("total"), *[_places(v, 2).alias(k) for k, v in parts.items()], bps.alias("slippage_bps"))


def cost_fill(side: Column, qty: Column, price: Column, rates: dict[str, float]) -> Column:
    """A fill's costs in one sum. rates in basis points of the value: slippage, sebi, exchange, stamp (purchases); gst in basis
    points of the brokerage, which is an amount an order."""
    r = {k: float(rates.get(k, 0.0)) for k in ("slippage", "brokerage", "sebi", "exchange", "gst", "stamp")}
    value = price * qty
    return value * ((r["slippage"] + r["sebi"] + r["exchange"]) / 1e4) + r["brokerage"] * (1 + r["gst"] / 1e4) + F.when(side == "BUY", value * r["stamp"] / 1e4).otherwise(0.0)


def order_intents(signals: DataFrame, risk: float, cap: float, lot: Column | int = 1) -> DataFrame:
    """(client_id, symbol, t, side, qty, extra) of signals(symbol, t, strategy, action, px, stop, reason): what is not FLAT, sized by
    risk and cash; sizes of 0 are dropped. The id follows from the signal, so it is the same each time; extra is JSON."""
    lots = F.lit(lot) if isinstance(lot, int) else lot
    sized = signals.where("action <> 'FLAT'").withColumn("qty", size_position(F.col("px"), F.col("stop"), risk, cap, lots))
    name = F.concat_ws(":", F.col("t").cast("string"), "symbol", "strategy", "action")
    extra = F.to_json(F.struct(F.col("px").alias("px_ref"), F.col("stop"), F.col("reason")))
    return sized.where("qty > 0").select(name.alias("client_id"), "symbol", "t", F.col("action").alias("side"), "qty", extra.alias("extra"))


# --- rows of results


def aggregate_by_config(rows: DataFrame, values: Sequence[str], per_symbol: bool = False) -> DataFrame:
    """One row for each strategy, timeframe and parameters (and symbol) of rows(symbol, strategy, timeframe, params map, n_trades,
    max_dd, variant, ...): means of ``values`` weighted by trades, missing ones as 0, all weights 1 where no row has trades; the
    largest drawdown, all trades, the symbols in order and the variant of the first symbol that has one."""
    keys = [*(["symbol"] if per_symbol else []), "strategy", "timeframe"]
    w = F.coalesce(F.col("n_trades").cast("double"), F.lit(0.0))
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mean = lambda c: F.when(F.sum(w) == 0, F.avg(value(c))).otherwise(F.sum(value(c) * w) / F.nullif(F.sum(w), F.lit(0.0)))
    return rows.withColumn("params_key", params_key(F.col("params"))).groupBy(*keys, "params_key").agg(
        *[mean(c).alias(c) for c in values], F.max(F.abs(value("max_dd"))).alias("max_dd"), F.sum(w).cast("long").alias("n_trades"),
        F.array_join(F.array_sort(F.collect_set(F.col("symbol").cast("string"))), ",").alias("symbols"), F.min_by("variant", F.when(F.col("variant").isNotNull(), F.col("symbol"))).alias("variant"),
    )


def win_rate_percent(rate: Column, percent: Column) -> Column:
    """A win rate in per cent from either of two columns, the first that is there: up to 1 it is a share; neither: 0."""
    v = F.coalesce(rate, percent)
    return F.coalesce(F.when(v <= 1, v * 100).otherwise(v), F.lit(0.0))


def profit_per_trade(given: Column, average: Column, total: Column, trades: Column) -> Column:
    """The first that is there of the given value, the average, and the total over its trades; 0 without trades."""
    return F.coalesce(given, average, F.when(trades > 0, F.coalesce(total, F.lit(0.0)) / trades), F.lit(0.0))


def tf_minutes(text: Column) -> Column:
    """Minutes of a timeframe written as 5, 5m or 5M; null for what is none, and below 1."""
    n = F.regexp_extract(F.lower(F.trim(text.cast("string"))), "^([0-9]{1,9})m?$", 1)
    n = F.when(n != "", n).cast("int")
    return F.when(n > 0, n)


def blotter(orders: DataFrame, fills: DataFrame, fee: str = "$.fees.total") -> DataFrame:
    """orders(order_id, status) with their fills(order_id, symbol, side, qty, price, t, extra) and the fee in the fills' JSON, newest
    fill first, orders without fills last."""
    f = fills.select(F.col("order_id").alias("_o"), "symbol", "side", "qty", "price", F.get_json_object("extra", fee).cast("double").alias("fee"), "t")
    return orders.select("order_id", "status").join(f, F.col("order_id") == F.col("_o"), "left").drop("_o").orderBy(F.desc_nulls_last("t"), "order_id")


# --- grids


Signal = Callable[[pd.DataFrame, dict], Sequence[str]]


def evaluate_grid(bars: DataFrame, grid: dict[str, dict], signal: Signal, capital: float, chunks: int = 8) -> DataFrame:
    """(symbol, params_id, n_trades, wins, pnl_total, ..., error): trades and their statistics of bars(symbol, t, c, ...) for each
    set of parameters in ``grid``.

    signal(bars of a symbol in time order, parameters) gives BUY, SELL or FLAT a bar. Where it raises, that symbol and set have
    its message as error and no statistics, and all others theirs. Sets are dealt over ``chunks`` groups a symbol; a group has
    one symbol's bars. Sets without a trade are left out, as they have no statistics.
    """
    names = list(grid)
    chunks = max(1, min(chunks, len(names)))
    dealt = bars.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kind = dict(bars.dtypes)["symbol"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, pdf = int(pdf["_c"].iloc[0]), pdf.sort_values("t").drop(columns="_c").reset_index(drop=True)
        out = []
        for name in names[chunk::chunks]:
            try:
                actions, error = list(signal(pdf.copy(), dict(grid[name]))), None
                if len(actions) != len(pdf):
                    raise ValueError(f"{len(actions)} actions for {len(pdf)} bars")
                rows = pdf[["symbol", "t", "c"]].assign(action=actions)
                rows = rows[rows["action"].isin(["BUY", "SELL"]) | (rows.index == len(rows) - 1)]  # the last bar closes what is open
            except Exception as e:  # noqa: BLE001  kept with its key
                rows, error = pdf[["symbol", "t", "c"]].tail(1).assign(action=None), f"{type(e).__name__}: {e}"
            out.append(rows.assign(params_id=name, error=error))
        return pd.concat(out, ignore_index=True)[["symbol", "params_id", "t", "c", "action", "error"]]

    rows = dealt.groupBy("symbol", "_c").applyInPandas(run, f"symbol {kind}, params_id string, t long, c double, action string, error string")
    key = F.struct("symbol", "params_id")
    stats = trade_stats(trades_from_signals(rows.where("error is null").select(key.alias("symbol"), "t", "c", "action"), capital))
    stats = stats.select("symbol.symbol", "symbol.params_id", *[c for c in stats.columns if c != "symbol"], F.lit(None).cast("string").alias("error"))
    return stats.unionByName(rows.where("error is not null").select("symbol", "params_id", "error"), allowMissingColumns=True)
