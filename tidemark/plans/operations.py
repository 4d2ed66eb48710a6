"""Marks, rates, verification, picks, costs, intents and grid queries with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import windows as W
from ..functions.sets import signal_sets
from ..operators import bars as B
from ..operators import ledgers as L
from ..operators import operations as O
from ..operators import tables as T
from . import sets
from .catalog import DAY, HOUR, ORDER, SQL_ALIGN, SQL_BARS, SQL_CROSS, SQL_FILLS, SQL_ORDERS, SQL_RESULTS, SQL_TICKS, SQL_VENDOR, _aligned, add, fills, hour_bars, orders, results, rounded, ticks, user_ticks, vendor
from .ledgers import PNL, SQL_WAC
from .research import SQL_GRID_CROSS
from .signals import SQL_SPREAD, SQL_TRADES

C = F.col

# Marks: the last bars of users' ticks, whose numbers are those of fills' symbols.
SQL_MARKS = "mk AS (SELECT user_id AS symbol, last(value ORDER BY ts, event_id) AS px FROM events GROUP BY 1)"


def prices(s: SparkSession, d: str) -> DataFrame:
    m = O.marks(B.tick_bars(user_ticks(s, d), HOUR))
    return m.select(F.substring("symbol", 2, 20).cast("long").alias("symbol"), "px")


add(
    "e2_marked_at_bars",
    f"WITH {SQL_FILLS}, {PNL}, {SQL_MARKS} SELECT pn.symbol, bucket, net_qty, round((coalesce(nullif(px, 0), a) - a) * net_qty, 4) AS unrealized FROM pn LEFT JOIN mk ON mk.symbol = pn.symbol",
)(lambda s, d: O.marked(L.pnl_snapshot(fills(s, d), ["symbol", "bucket"], ORDER), prices(s, d)).select("symbol", "bucket", "net_qty", F.round("unrealized", 4).alias("unrealized")))
add(
    "e17_exposure_at_bars",
    f"WITH {SQL_FILLS}, {SQL_MARKS} SELECT bucket, round(sum(qty * coalesce(px, 0)), 2) AS notional FROM fills LEFT JOIN mk ON mk.symbol = fills.symbol GROUP BY 1",
)(lambda s, d: O.bucket_exposure(fills(s, d), prices(s, d)).select("bucket", F.round("notional", 2).alias("notional")))

# Orders.
_STATUS = "CASE WHEN order_id % 9 = 0 THEN 'CANCELLED' WHEN order_id % 11 = 0 THEN 'REJECTED' ELSE status END"
NOW = 852076800  # a day within the orders' years


def ended(s: SparkSession, d: str) -> DataFrame:
    return orders(s, d).withColumn("status", F.expr(_STATUS))


_share = lambda x: f"coalesce(count(*) FILTER (t >= {NOW - 365 * DAY} AND st = '{x}') / nullif(count(*) FILTER (t >= {NOW - 365 * DAY}), 0), 0)"
add(
    "e4_order_rates",
    f"WITH {SQL_ORDERS}, {SQL_FILLS}, x AS (SELECT t, {_STATUS} AS st FROM ord) SELECT count(*) FILTER (st IN ('NEW', 'ACK', 'PENDING', 'OPEN')) AS open_now, count(*) FILTER (t >= {NOW - 365 * DAY}) AS orders, "
    f"round({_share('CANCELLED')}, 6) AS cancel_rate, round({_share('REJECTED')}, 6) AS reject_rate, (SELECT count(*) FROM fills WHERE t >= {NOW - 365 * DAY}) AS fills FROM x",
)(lambda s, d: rounded(O.order_rates(ended(s, d), fills(s, d), F.lit(NOW), 365 * DAY), "cancel_rate", "reject_rate"))
add(
    "e10_eod_summary",
    f"WITH {SQL_FILLS}, {SQL_ORDERS}, {SQL_WAC}, ps AS (SELECT symbol, last(z.r ORDER BY n) AS r FROM w GROUP BY 1), a AS (SELECT t // {DAY} AS day, count(*) AS o FROM ord GROUP BY 1), "
    f"b AS (SELECT t // {DAY} AS day, count(*) AS f, count(DISTINCT symbol) AS y FROM fills GROUP BY 1) SELECT coalesce(a.day, b.day) AS day, coalesce(o, 0) AS orders, coalesce(f, 0) AS fills, coalesce(y, 0) AS symbols, "
    "(SELECT round(sum(r), 1) FROM ps) AS realized FROM a FULL JOIN b ON a.day = b.day",
)(lambda s, d: O.eod_summary(orders(s, d), fills(s, d), L.wac_positions(fills(s, d), ORDER).groupBy("symbol").agg(F.max_by("realized", "n").alias("realized"))).withColumn("realized", F.round("realized", 1)))
add(
    "e15_counter_increases",
    f"WITH {SQL_TICKS}, x AS (SELECT symbol, us // 1000000 AS t, id, id % 4 AS series, ltp FROM ticks), w AS (SELECT *, unnest(generate_series(t - t % {HOUR} - {5 * HOUR}, t - t % {HOUR}, {HOUR})) AS start FROM x), "
    f"r AS (SELECT symbol, series, start, last(ltp ORDER BY t, id) - first(ltp ORDER BY t, id) AS rise FROM w WHERE t < start + {6 * HOUR} GROUP BY ALL) SELECT symbol, start, round(greatest(0, sum(rise)), 4) AS increase FROM r GROUP BY 1, 2",
)(
    lambda s, d: O.counter_increases(ticks(s, d).select("symbol", F.unix_seconds("ts").alias("t"), "id", (C("id") % 4).alias("series"), C("ltp").alias("value")), 6 * HOUR, HOUR, ["series"], ["symbol"])
    .withColumn("increase", F.round("increase", 4))
)

# Against the vendor: some of our own bars are missing too.
SQL_OWN = f"{SQL_VENDOR}, own AS (SELECT * FROM bars WHERE t // {HOUR} % 19 <> 0)"


def own(s: SparkSession, d: str) -> DataFrame:
    return hour_bars(s, d).where(F.floor(C("t") / HOUR) % 19 != 0)


_last = lambda name: f"(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS r FROM {name})"
_off = lambda c: f"CASE WHEN abs(a.{c} - b.{c}) > greatest(0.01, abs(b.{c}) * 0.0005) THEN '{c}' END"
add(
    "d5_verify_last",
    f"WITH {SQL_OWN}, j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.t, b.t) AS t, b.o, b.h, b.l, b.c, b.vol, CASE WHEN b.t IS NULL THEN '' WHEN a.t IS NULL THEN 'missing_local' "
    f"ELSE concat_ws(',', {', '.join(map(_off, 'ohlc'))}, CASE WHEN a.vol <> b.vol THEN 'vol' END) END AS reason FROM own a FULL JOIN vendor b ON a.symbol = b.symbol AND a.t = b.t) "
    "SELECT symbol, t, reason, o, h, l, c, vol FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS r FROM j) WHERE r <= 48 AND reason <> ''",
)(lambda s, d: O.verify_recent(own(s, d), vendor(hour_bars(s, d)), 48))
_diff = f"abs(a.{{0}} - b.{{0}}) <= greatest(0.02, 0.001 * abs(b.{{0}}))"
add(
    "d3_summary",
    f"WITH {SQL_OWN}, j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, a.t AS ta, b.t AS tb, NOT ({' AND '.join(f'CASE WHEN b.{c} = 0 THEN a.{c} = 0 ELSE {_diff.format(c)} END' for c in 'ohlc')}) AS p, a.vol <> b.vol AS v "
    "FROM own a FULL JOIN vendor b ON a.symbol = b.symbol AND a.t = b.t) SELECT symbol, count(*) FILTER (ta IS NULL) AS missing_local, count(*) FILTER (tb IS NULL) AS missing_vendor, count(*) FILTER (p) AS ohlc, count(*) FILTER (v) AS vol "
    "FROM j WHERE ta IS NULL OR tb IS NULL OR p OR v GROUP BY 1",
)(lambda s, d: O.reconcile_summary(B.reconcile(own(s, d), vendor(hour_bars(s, d)))))
_sums = lambda name: f"(SELECT symbol, (t + 19800) // {DAY} AS day, count(*) AS n, round(sum(c), 4) AS c, sum(vol) AS v FROM {name} GROUP BY 1, 2)"
add(
    "d6_dry_run",
    f"WITH {SQL_OWN} SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.day, b.day) AS day, a.n AS n_local, b.n AS n_vendor, CASE WHEN a.n IS NOT DISTINCT FROM b.n AND a.c IS NOT DISTINCT FROM b.c AND a.v IS NOT DISTINCT FROM b.v THEN 'OK' "
    f"WHEN b.n IS NULL THEN 'NONE' ELSE 'DRY' END AS action FROM {_sums('own')} a FULL JOIN {_sums('vendor')} b ON a.symbol = b.symbol AND a.day = b.day",
)(lambda s, d: O.heal_report(B.bar_checksum(own(s, d)), B.bar_checksum(vendor(hour_bars(s, d)))))
add(
    "c9_fingerprint",
    f"WITH {SQL_BARS} SELECT symbol, t, md5(concat_ws(',', {', '.join(f'''printf('%.4f', {c})''' for c in 'ohlc')}, vol)) AS md5 FROM bars",
)(lambda s, d: O.bar_fingerprint(hour_bars(s, d)))


def net(s: SparkSession, d: str) -> DataFrame:
    return fills(s, d).groupBy("symbol").agg(F.sum(T.signed()).alias("qty"))


add(
    "d14_position_check",
    f"WITH {SQL_FILLS}, n AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS q FROM fills GROUP BY 1), d AS (SELECT abs(CASE WHEN symbol % 7 = 0 THEN q ELSE symbol % 5 END) AS f FROM n) "
    "SELECT count(*) FILTER (f > 2) AS mismatched, bool_or(f > 100) AS breach, bool_or(f > 100) OR count(*) FILTER (f > 2) > 5 AS halt FROM d",
)(lambda s, d: (lambda n: O.position_check(T.position_diff(n.where("symbol % 7 <> 0").withColumn("qty", C("qty") + C("symbol") % 5), n), 2, 100, 5))(net(s, d)))
add(
    "d14_unknown_orders",
    f"WITH {SQL_ORDERS} SELECT order_id FROM ord WHERE status <> 'FILLED' AND order_id % 3 <> 0 AND order_id % 10 = 1",
)(
    lambda s, d: O.unknown_orders(
        orders(s, d).select("order_id", F.when(C("status") == "FILLED", "COMPLETE").otherwise(C("status")).alias("status"), F.when(C("order_id") % 3 != 0, F.concat(F.lit("k"), "order_id")).alias("tag")),
        orders(s, d).where("order_id % 10 <> 1").select(F.concat(F.lit("k"), "order_id").alias("client_id")),
    ).select("order_id")
)
_AUDIT = ["pnl_total", "win_rate", "max_dd"]
add(
    "b6_presence_audit",
    f"WITH {SQL_RESULTS} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS present, count(*) - count({c}) AS missing FROM res" for c in _AUDIT),
)(lambda s, d: O.presence_audit(results(s, d), _AUDIT))

# Picks in documents of both shapes, some of other parameters.
_FAST, _SLOW = "n_trades % 4 + 3", "symbol % 3 * 4 + 4"


def pick_docs(s: SparkSession, d: str) -> DataFrame:
    r = results(s, d).where("n_trades % 3 = 0").withColumn("symbol_", C("symbol").cast("string"))
    params = F.create_map(F.lit("slow"), F.expr(f"string({_SLOW})"), F.lit("fast"), F.expr(f"string({_FAST} + CASE WHEN symbol % 5 = 0 THEN 1 ELSE 0 END)"))
    entry = F.struct(F.concat(F.lit(" "), "strategy").alias("strategy"), params.alias("params"))
    a = F.struct(F.array(F.struct(C("symbol_").alias("symbol"), C("timeframe").alias("tf_min"), F.array(entry).alias("entries"))).alias("selections"))
    b = F.struct(F.array(F.struct(C("symbol_").alias("symbol"), "strategy", C("timeframe").alias("tf"), params.alias("params"))).alias("use"))
    return r.select(F.when(C("symbol") % 2 == 0, F.to_json(a)).otherwise(F.to_json(b)).alias("doc"))


add("d18_picked", f"WITH {SQL_RESULTS} SELECT symbol::VARCHAR AS symbol, strategy, timeframe AS tf, n_trades FROM res WHERE n_trades % 3 = 0 AND symbol % 5 <> 0")(
    lambda s, d: O.restrict_to_selected(
        results(s, d).select(C("symbol").cast("string").alias("symbol"), "strategy", C("timeframe").alias("tf"), "n_trades", F.create_map(F.lit("fast"), F.expr(f"string({_FAST})"), F.lit("slow"), F.expr(f"string({_SLOW})")).alias("params")),
        O.flatten_picks(pick_docs(s, d)),
    ).select("symbol", "strategy", "tf", "n_trades")
)

# Costs.
RATES = {"brokerage": 20.0, "exchange": 0.0000345, "sebi": 0.000001, "stt": 0.00025, "stamp": 0.00003, "gst": 0.18, "slippage": 2.0}
FILL = {"slippage": 2.0, "brokerage": 20.0, "sebi": 0.01, "exchange": 0.345, "gst": 1800.0, "stamp": 0.3}
FILL_KEY = ["symbol", "order_id", "l_linenumber", "l_partkey", "t"]
_key = ", ".join(FILL_KEY)
add(
    "h9_cost_equity",
    f"WITH {SQL_FILLS}, x AS (SELECT *, price * qty AS v, CASE WHEN bucket = 'A' THEN 5e0 ELSE 2e0 END AS bps FROM fills) SELECT {_key}, floor(round(price * (1 + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * bps / 1e4), 4) * 10)::BIGINT AS fill_tenths, "
    f"floor(round(20 + v * {RATES['exchange']} + v * {RATES['sebi']} + CASE WHEN side = 'SELL' THEN v * {RATES['stt']} ELSE v * {RATES['stamp']} END + (20 + v * {RATES['exchange']}) * 0.18, 2))::BIGINT AS total, bps AS slippage_bps FROM x",
)(
    lambda s, d: fills(s, d).withColumn("x", O.cost_equity(C("side"), C("price"), C("qty"), C("bucket"), RATES, {"A": 5.0}))
    .select(*FILL_KEY, F.floor(C("x.fill_price") * 10).alias("fill_tenths"), F.floor("x.total").alias("total"), "x.slippage_bps")
)
_share_of = (FILL["slippage"] + FILL["sebi"] + FILL["exchange"]) / 1e4
_flat = FILL["brokerage"] * (1 + FILL["gst"] / 1e4)
add(
    "h9_cost_fill",
    f"WITH {SQL_FILLS} SELECT {_key}, floor((price * qty * {_share_of!r}::DOUBLE + {_flat!r}::DOUBLE + CASE WHEN side = 'BUY' THEN price * qty * 0.3::DOUBLE / 1e4 ELSE 0 END) * 1000 + 0.5) / 1000 AS cost FROM fills",
)(lambda s, d: fills(s, d).select(*FILL_KEY, (F.floor(O.cost_fill(C("side"), C("qty"), C("price"), FILL) * 1000 + 0.5) / 1000).alias("cost")))
add(
    "h9_cost_roundtrip",
    f"WITH {SQL_TRADES} SELECT symbol, t_entry, round((px_exit * (1 - 2 / 1e4) - px_entry * (1 + 2 / 1e4)) * qty - 10, 4) AS net FROM tr WHERE side = 'LONG'",
)(lambda s, d: T.trades_from_signals(_crossed(s, d), 1000.0).where("side = 'LONG'").select("symbol", "t_entry", F.round(O.cost_roundtrip(C("qty"), C("px_entry"), C("px_exit")), 4).alias("net")))


def _crossed(s: SparkSession, d: str) -> DataFrame:
    from .catalog import _sma_cross

    return _sma_cross(s, d)


# Intents of one set of a strategy, sized by its stop.
_ONE = {"a": sets.GIVEN["bollinger_breakout"][1]["a"]}
_SIGNED = sets.sql("bollinger_breakout", sets.GIVEN["bollinger_breakout"][0], _ONE)
add(
    "g22_sized_intents",
    f"WITH {SQL_BARS}, sg AS ({_SIGNED}), j AS (SELECT sg.*, bars.c FROM sg JOIN bars ON bars.symbol = sg.symbol AND bars.t = sg.t WHERE action <> 'FLAT'), "
    "q AS (SELECT *, CAST(least(floor(50000 / c), floor(100 / abs(c - stop))) AS BIGINT) AS qty FROM j) "
    "SELECT concat_ws(':', t, symbol, 'bollinger_breakout', action) AS client_id, symbol, t, action AS side, qty, c AS px_ref, 'a' AS reason FROM q WHERE qty > 0",
)(
    lambda s, d: O.order_intents(
        signal_sets(hour_bars(s, d), "bollinger_breakout", _ONE).join(hour_bars(s, d).select("symbol", "t", C("c").alias("px")), ["symbol", "t"])
        .select("symbol", "t", F.lit("bollinger_breakout").alias("strategy"), "action", "px", F.round("stop", 6).alias("stop"), C("params_id").alias("reason")), 100.0, 50_000.0,
    ).select("client_id", "symbol", "t", "side", "qty", F.get_json_object("extra", "$.px_ref").cast("double").alias("px_ref"), F.get_json_object("extra", "$.reason").alias("reason"))
)

# A grid of crossings by a function of pandas, with a set that has no slow length.
GRID = {"3/10": {"fast": 3, "slow": 10}, "5/20": {"fast": 5, "slow": 20}, "8/30": {"fast": 8, "slow": 30}, "odd": {"fast": 3}}


def crossing(bars: pd.DataFrame, p: dict) -> list[str]:
    """BUY and SELL where a moving mean crosses a longer one, from the first bar with both on."""
    fast, slow = (bars["c"].rolling(p[k]).mean().round(6) for k in ("fast", "slow"))
    zone, before, out = (fast > slow).astype(int) - (fast < slow).astype(int), 0, []
    for z in zone:
        out.append(("BUY" if z > 0 else "SELL") if z and before and z != before else "FLAT")
        before = z or before
    return out


add(
    "h10_grid_of_any_signal",
    f"WITH {SQL_GRID_CROSS}{SQL_TRADES[len(SQL_CROSS):]} SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS params_id, count(*) AS n_trades, count(*) FILTER (pnl > 0) AS wins, round(sum(pnl), 4) AS pnl_total, NULL AS error FROM tr GROUP BY ALL "
    "UNION ALL SELECT DISTINCT event_type, 'odd', NULL, NULL, NULL, 'KeyError: ''slow''' FROM events",
)(lambda s, d: O.evaluate_grid(hour_bars(s, d).select("symbol", "t", "c"), GRID, crossing, 1000.0).select("symbol", "params_id", "n_trades", "wins", F.round("pnl_total", 4).alias("pnl_total"), "error"))

# Rows of results.
_BASE = "SELECT *, CASE WHEN symbol % 4 <> 1 THEN symbol % 3 END AS g, CASE WHEN symbol % 5 = 0 THEN 0 ELSE n_trades END AS w FROM res"


def configured(s: SparkSession, d: str) -> DataFrame:
    """results with parameters (none for some), a variant, and some without trades."""
    g = F.expr("CASE WHEN symbol % 4 <> 1 THEN symbol % 3 END")
    params = F.when(g.isNotNull(), F.create_map(F.lit("slow"), (g * 4 + 4).cast("string"), F.lit("fast"), (g + 3).cast("string")))
    return results(s, d).select("symbol", "strategy", "timeframe", params.alias("params"), F.expr("CASE WHEN symbol % 5 = 0 THEN 0 ELSE n_trades END").alias("n_trades"), "pnl_total", "win_rate", "max_dd", F.expr("CASE WHEN symbol % 2 = 0 THEN concat('v', symbol) END").alias("variant"))


_PARAMS = "CASE WHEN g IS NULL THEN '{}' ELSE '{\"fast\":\"' || (g + 3) || '\",\"slow\":\"' || (g * 4 + 4) || '\"}' END AS params_key"
_mean = lambda c: f"round(CASE WHEN sum(w) = 0 THEN avg(coalesce({c}, 0)) ELSE sum(coalesce({c}, 0) * w) / sum(w) END, 6) AS {c}"
for _name, _sym in (("e11_by_config", ""), ("e11_by_symbol", "symbol, ")):
    add(
        _name,
        f"WITH {SQL_RESULTS}, b AS ({_BASE}) SELECT {_sym}strategy, timeframe, {_PARAMS}, {_mean('pnl_total')}, {_mean('win_rate')}, max(abs(coalesce(max_dd, 0))) AS max_dd, sum(w)::BIGINT AS n_trades, "
        f"array_to_string(list_sort(list(DISTINCT symbol::VARCHAR)), ',') AS symbols, first('v' || symbol ORDER BY symbol) FILTER (symbol % 2 = 0) AS variant FROM b GROUP BY {_sym}strategy, timeframe, g",
    )(lambda s, d, per=bool(_sym): rounded(O.aggregate_by_config(configured(s, d), ["pnl_total", "win_rate"], per), "pnl_total", "win_rate"))
_TEXT = "CASE timeframe % 5 WHEN 0 THEN '5m' WHEN 1 THEN concat(' ', timeframe, 'M') WHEN 2 THEN '0' WHEN 3 THEN 'day' ELSE concat('', timeframe * 10) END"
add(
    "b8_normalised",
    f"WITH {SQL_RESULTS} SELECT symbol, strategy, timeframe, coalesce(CASE WHEN coalesce(CASE WHEN symbol % 2 = 0 THEN win_rate END, win_rate * 100) <= 1 THEN coalesce(CASE WHEN symbol % 2 = 0 THEN win_rate END, win_rate * 100) * 100 "
    "ELSE coalesce(CASE WHEN symbol % 2 = 0 THEN win_rate END, win_rate * 100) END, 0) AS win_pct, round(coalesce(CASE WHEN symbol % 3 = 0 THEN 1.5e0 END, CASE WHEN symbol % 3 = 1 THEN 2.5e0 END, CASE WHEN n_trades - 20 > 0 THEN coalesce(pnl_total, 0) / (n_trades - 20) END, 0), 6) AS per_trade, "
    "CASE timeframe % 5 WHEN 0 THEN 5 WHEN 1 THEN timeframe WHEN 4 THEN timeframe * 10 END AS minutes FROM res",
)(
    lambda s, d: results(s, d).select(
        "symbol", "strategy", "timeframe", O.win_rate_percent(F.when(C("symbol") % 2 == 0, C("win_rate")), C("win_rate") * 100).alias("win_pct"),
        F.round(O.profit_per_trade(F.when(C("symbol") % 3 == 0, 1.5), F.when(C("symbol") % 3 == 1, 2.5), C("pnl_total"), C("n_trades") - 20), 6).alias("per_trade"), O.tf_minutes(F.expr(_TEXT)).alias("minutes"),
    )
)
add("d8_blotter_sorted", f"WITH {SQL_FILLS}, {SQL_ORDERS} SELECT o.order_id, o.status, f.symbol, f.side, f.qty, f.price, f.fees AS fee, f.t FROM ord o LEFT JOIN fills f ON f.order_id = o.order_id ORDER BY t DESC NULLS LAST, order_id")(
    lambda s, d: O.blotter(orders(s, d), fills(s, d).withColumn("extra", F.to_json(F.struct(F.struct(C("fees").alias("total")).alias("fees")))))
)
SQL_LOG = SQL_SPREAD.replace("var_pop(x)", "var_pop(ln(x))").replace("regr_slope(y, x)", "regr_slope(ln(y), ln(x))").replace("y - beta * x AS spread", "ln(y) - beta * ln(x) AS spread").replace(">= 10", ">= 30")
add("f19_log_spread_z", f"WITH {SQL_LOG} SELECT * FROM sz")(lambda s, d: rounded(S.spread_z(_aligned(s, d), 60, 30, "log"), "beta", "spread", "z").select("symbol", "t", "beta", "spread", "z"))
add("f18_beta_or_fixed", f"WITH {SQL_ALIGN}, b AS (SELECT symbol, t, CASE WHEN count(*) {sets.w(60)} >= 60 AND abs(var_pop(x) {sets.w(60)}) >= 1e-12 THEN regr_slope(y, x) {sets.w(60)} END AS beta FROM al) SELECT symbol, t, round(coalesce(beta, 1), 6) AS beta FROM b")(
    lambda s, d: _aligned(s, d).select("symbol", "t", F.round(W.rolling_beta(C("y"), C("x"), 60, fallback=1.0), 6).alias("beta"))
)
