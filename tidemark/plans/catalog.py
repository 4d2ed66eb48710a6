"""Queries over the given tables, each with the SQL that gives the same rows. Doubles are rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import bars as B
from ..operators import tables as T

HOUR, DAY = 3600, 86400


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("ltp"), F.get_json_object("props", "$.k").cast("long").alias("vol"))


def user_ticks(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    return e.select(F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("ltp"), F.get_json_object("props", "$.k").cast("long").alias("vol"))


def hour_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.tick_bars(ticks(spark, d), HOUR)


def vendor(bars: DataFrame) -> DataFrame:
    h = F.floor(F.col("t") / HOUR)
    return bars.where(h % 17 != 0).withColumn("c", F.when(h % 13 == 0, F.col("c") + 0.05).otherwise(F.col("c"))).withColumn("vol", F.when(h % 11 == 0, F.col("vol") + 10).otherwise(F.col("vol")))


ORDER = ["t", "order_id", "l_linenumber", "l_partkey", "symbol", "qty", "price"]


def fills(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "lineitem")
    side = F.when(F.col("l_linenumber") % 2 == 1, "BUY").otherwise("SELL")
    return x.select(F.col("l_suppkey").alias("symbol"), F.col("l_orderkey").alias("order_id"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("t"), "l_linenumber", "l_partkey", side.alias("side"), F.col("l_quantity").cast("long").alias("qty"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).alias("price"), F.col("l_tax").alias("fees"), F.col("l_returnflag").alias("bucket"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "NEW").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("FILLED")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"), status.alias("status"), F.col("o_totalprice").alias("notional"), F.substring("o_orderpriority", 1, 1).alias("bucket"))


def results(spark: SparkSession, d: str) -> DataFrame:
    g = fills(spark, d).groupBy("symbol", F.col("bucket").alias("strategy"), F.col("l_linenumber").alias("timeframe"))
    r = g.agg(F.count("*").alias("n_trades"), F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).alias("q"), (F.floor(F.avg("price") * 100 + 0.5) / 100).alias("px"))
    k = F.col("symbol") + F.col("timeframe")
    return r.select("symbol", "strategy", "timeframe", "n_trades", F.when(k % 7 != 0, F.col("px") - 1400).alias("pnl_total"), F.when(k % 5 != 0, (F.col("symbol") % 10) / 10.0).alias("win_rate"), (-F.abs("q") * 10.0).alias("max_dd"))


#: DuckDB forms of the tables above.
SQL_TICKS = "ticks AS (SELECT event_type AS symbol, epoch_us(ts) AS us, event_id AS id, value AS ltp, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS vol FROM events)"
SQL_BARS = SQL_TICKS + f", bars AS (SELECT symbol, us // {HOUR * 10**6} * {HOUR} AS t, first(ltp ORDER BY us, id) AS o, max(ltp) AS h, min(ltp) AS l, last(ltp ORDER BY us, id) AS c, CAST(sum(vol) AS BIGINT) AS vol, count(*) AS n_trades FROM ticks GROUP BY 1, 2)"
SQL_VENDOR = SQL_BARS + f", vendor AS (SELECT symbol, t, o, h, l, CASE WHEN t // {HOUR} % 13 = 0 THEN c + 0.05 ELSE c END AS c, CASE WHEN t // {HOUR} % 11 = 0 THEN vol + 10 ELSE vol END AS vol, n_trades FROM bars WHERE t // {HOUR} % 17 <> 0)"
SQL_FILLS = "fills AS (SELECT l_suppkey AS symbol, l_orderkey AS order_id, epoch_us(l_shipdate) // 1000000 AS t, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS side, CAST(l_quantity AS BIGINT) AS qty, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_tax AS fees, l_returnflag AS bucket FROM lineitem)"
SQL_ORDERS = "ord AS (SELECT o_orderkey AS order_id, o_custkey AS cust, epoch_us(o_orderdate) // 1000000 AS t, CASE o_orderstatus WHEN 'O' THEN 'NEW' WHEN 'P' THEN 'PARTIAL' ELSE 'FILLED' END AS status, o_totalprice AS notional, substr(o_orderpriority, 1, 1) AS bucket FROM orders)"
SQL_RESULTS = SQL_FILLS + ", res AS (SELECT symbol, strategy, timeframe, n_trades, CASE WHEN (symbol + timeframe) % 7 <> 0 THEN px - 1400 END AS pnl_total, CASE WHEN (symbol + timeframe) % 5 <> 0 THEN (symbol % 10) / 10.0::DOUBLE END AS win_rate, -abs(q) * 10.0::DOUBLE AS max_dd FROM (SELECT symbol, bucket AS strategy, l_linenumber AS timeframe, count(*) AS n_trades, CAST(sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS BIGINT) AS q, floor(avg(price) * 100 + 0.5) / 100 AS px FROM fills GROUP BY 1, 2, 3))"
BAR = "symbol, t, o, h, l, c, vol"
W_ = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _roll(width: int, extra: str = "") -> str:
    return f"SELECT symbol, {extra}t // {width} * {width} AS t, first(o ORDER BY t) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY t) AS c, CAST(sum(vol) AS BIGINT) AS vol, CAST(sum(n_trades) AS BIGINT) AS n_trades FROM bars GROUP BY symbol, t // {width} * {width}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


add("c1_tick_bars", f"WITH {SQL_BARS} SELECT {BAR}, n_trades FROM bars")(hour_bars)
add("c2_rollup", f"WITH {SQL_BARS} {_roll(DAY)}")(lambda s, d: B.rollup_bars(hour_bars(s, d), DAY))
add("c3_rollup_multi", f"WITH {SQL_BARS} " + " UNION ALL ".join(_roll(h * HOUR, f"{h * HOUR}::BIGINT AS tf, ") for h in (2, 6, 12)))(lambda s, d: B.rollup_multi(hour_bars(s, d), [2 * HOUR, 6 * HOUR, 12 * HOUR]))
add("c4_golden", f"WITH {SQL_TICKS}, bars AS (SELECT symbol, us // 60000000 * 60 AS t, first(ltp ORDER BY us, id) AS o, max(ltp) AS h, min(ltp) AS l, last(ltp ORDER BY us, id) AS c, CAST(sum(vol) AS BIGINT) AS vol, count(*) AS n_trades FROM ticks GROUP BY 1, 2) {_roll(900)}")(lambda s, d: B.golden_bars(B.tick_bars(ticks(s, d), 60), 15))
add("c5_resample_close", f"WITH {SQL_BARS}, r AS (SELECT symbol, t // {DAY} * {DAY} AS t, last(c ORDER BY t) AS c FROM bars GROUP BY 1, t // {DAY} * {DAY}) SELECT symbol, t, c FROM (SELECT *, max(t) OVER (PARTITION BY symbol) AS m FROM r) WHERE t < m")(lambda s, d: B.resample_close(hour_bars(s, d), DAY, include_last=False))
add("c6_running_bars", f"WITH {SQL_BARS} SELECT symbol, t // {DAY} * {DAY} AS b, t, first(o) OVER w AS o, max(h) OVER w AS h, min(l) OVER w AS l, c, CAST(sum(vol) OVER w AS BIGINT) AS vol FROM bars WINDOW w AS (PARTITION BY symbol, t // {DAY} ORDER BY t ROWS UNBOUNDED PRECEDING)")(lambda s, d: B.running_bars(hour_bars(s, d), DAY))
_mix = lambda c: f"round(CASE WHEN s = t THEN {c} ELSE {c} + (n_{c} - {c}) * ((s - t) / (n_t - t)::DOUBLE) END, 6) AS {c}"
add("c7_gap_fill", f"WITH {SQL_BARS}, n AS (SELECT *, lead(t) OVER w AS n_t, lead(o) OVER w AS n_o, lead(h) OVER w AS n_h, lead(l) OVER w AS n_l, lead(c) OVER w AS n_c, lead(vol) OVER w AS n_vol FROM bars WINDOW w AS (PARTITION BY symbol, (t + 19800) // {DAY} ORDER BY t)), e AS (SELECT *, unnest(range(t, coalesce(n_t, t + 1), {HOUR})) AS s FROM n) SELECT symbol, s AS t, {', '.join(map(_mix, 'ohlc'))}, CAST(CASE WHEN s = t THEN vol ELSE round(vol + (n_vol - vol) * ((s - t) / (n_t - t)::DOUBLE)) END AS BIGINT) AS vol, CAST(s <> t AS INT) AS filled FROM e")(lambda s, d: rounded(B.gap_fill(hour_bars(s, d), HOUR), "o", "h", "l", "c"))
add("c8_latest", f"WITH {SQL_BARS} SELECT symbol, t, c FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n FROM bars) WHERE n = 1")(lambda s, d: B.latest(hour_bars(s, d).select("symbol", "t", "c"), ["symbol"], ["t"]))
add("c9_checksum", f"WITH {SQL_BARS} SELECT symbol, (t + 19800) // {DAY} AS day, count(*) AS n, round(sum(c), 4) AS sum_c, CAST(sum(vol) AS BIGINT) AS sum_vol FROM bars GROUP BY 1, 2")(lambda s, d: B.bar_checksum(hour_bars(s, d)))
add("c11_bars_to_ticks", f"WITH {SQL_BARS} SELECT symbol, t, unnest([0, 1, 2, 3]) AS leg, unnest([o, h, l, c]) AS ltp, greatest(1, vol // 4) AS vol FROM bars")(lambda s, d: B.bars_to_ticks(hour_bars(s, d)))
add("a2_bar_scan", f"WITH {SQL_BARS} SELECT {BAR} FROM bars WHERE symbol IN ('click', 'error') AND t BETWEEN 1704585600 AND 1705190400")(lambda s, d: hour_bars(s, d).where(F.col("symbol").isin("click", "error") & F.col("t").between(1704585600, 1705190400)).select("symbol", "t", "o", "h", "l", "c", "vol"))
add("a3_candidates", f"WITH {SQL_TICKS} SELECT symbol, n FROM (SELECT 'U' || user_id AS symbol, count(*) AS n FROM events GROUP BY 1) WHERE n >= 5 ORDER BY n DESC, symbol LIMIT 20")(lambda s, d: B.candidate_symbols(user_ticks(s, d), 5, 20))
for policy, cols in {"replace": "coalesce(u.o, t.o), coalesce(u.h, t.h), coalesce(u.l, t.l), coalesce(u.c, t.c), coalesce(u.vol, t.vol), coalesce(u.n_trades, t.n_trades)", "additive": "coalesce(u.o, t.o), greatest(u.h, t.h), least(u.l, t.l), coalesce(u.c, t.c), coalesce(u.vol + t.vol, u.vol, t.vol), coalesce(u.n_trades + t.n_trades, u.n_trades, t.n_trades)", "additive_keep_open": "coalesce(t.o, u.o), greatest(u.h, t.h), least(u.l, t.l), coalesce(u.c, t.c), coalesce(u.vol + t.vol, u.vol, t.vol), coalesce(u.n_trades + t.n_trades, u.n_trades, t.n_trades)", "verify": "coalesce(u.o, t.o), coalesce(u.h, t.h), coalesce(u.l, t.l), coalesce(u.c, t.c), coalesce(u.vol, t.vol), greatest(u.n_trades, t.n_trades)"}.items():
    named = ", ".join(f"{x} AS {n}" for x, n in zip(cols.split("), "), ("o", "h", "l", "c", "vol", "n_trades"))).replace(" AS o", ") AS o").replace(" AS h", ") AS h").replace(" AS l,", ") AS l,").replace(" AS c,", ") AS c,").replace(" AS vol", ") AS vol")
    add(f"a6_merge_{policy}", f"WITH {SQL_VENDOR} SELECT coalesce(t.symbol, u.symbol) AS symbol, coalesce(t.t, u.t) AS t, {named} FROM bars t FULL JOIN vendor u ON t.symbol = u.symbol AND t.t = u.t")(lambda s, d, p=policy: B.merge_bars(hour_bars(s, d), vendor(hour_bars(s, d)), p))
add("b1_session", f"WITH {SQL_BARS} SELECT symbol, t, c, (t + 19800) % {DAY} // 60 AS minute FROM bars WHERE (t + 19800) % {DAY} // 60 BETWEEN 555 AND 930")(lambda s, d: B.in_session(hour_bars(s, d)).select("symbol", "t", "c", "minute"))
add("d3_reconcile", f"WITH {SQL_VENDOR}, j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.t, b.t) AS t, CASE WHEN a.t IS NULL THEN 'missing_local' WHEN b.t IS NULL THEN 'missing_vendor' ELSE concat_ws(',', CASE WHEN NOT (CASE WHEN b.c = 0 THEN a.c = 0 ELSE abs(a.c - b.c) <= greatest(0.02, 0.001 * abs(b.c)) END) THEN 'ohlc' END, CASE WHEN a.vol <> b.vol THEN 'vol' END) END AS reason FROM bars a FULL JOIN vendor b ON a.symbol = b.symbol AND a.t = b.t) SELECT * FROM j WHERE reason <> ''")(lambda s, d: B.reconcile(hour_bars(s, d), vendor(hour_bars(s, d))))
add("d4_diff_upsert", f"WITH {SQL_VENDOR} SELECT a.symbol, a.t, CASE WHEN b.t IS NULL THEN 'insert' WHEN abs(a.c - b.c) <= 1e-6 AND a.vol = b.vol THEN 'skip' ELSE 'update' END AS action FROM bars a LEFT JOIN vendor b ON a.symbol = b.symbol AND a.t = b.t")(lambda s, d: B.diff_upsert(vendor(hour_bars(s, d)), hour_bars(s, d)))
_day = f"(t + 19800) // {DAY}"
add("d6_heal", f"WITH {SQL_VENDOR}, sa AS (SELECT symbol, {_day} AS day, count(*) AS n, round(sum(c), 4) AS sc, sum(vol) AS sv FROM bars GROUP BY 1, 2), sb AS (SELECT symbol, {_day} AS day, count(*) AS n, round(sum(c), 4) AS sc, sum(vol) AS sv FROM vendor GROUP BY 1, 2), bad AS (SELECT b.symbol, b.day FROM sb b LEFT JOIN sa a ON a.symbol = b.symbol AND a.day = b.day WHERE a.n IS DISTINCT FROM b.n OR a.sc IS DISTINCT FROM b.sc OR a.sv IS DISTINCT FROM b.sv) SELECT {BAR} FROM bars x WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.symbol = x.symbol AND bad.day = {_day}) UNION ALL SELECT {BAR} FROM vendor x WHERE EXISTS (SELECT 1 FROM bad WHERE bad.symbol = x.symbol AND bad.day = {_day})")(lambda s, d: B.heal(hour_bars(s, d), vendor(hour_bars(s, d))).select("symbol", "t", "o", "h", "l", "c", "vol"))


def _bars_with(named: Callable):
    """named takes the columns c, h and l, and gives names and values."""
    return lambda s, d: hour_bars(s, d).select("symbol", "t", *[F.round(v, 6).alias(n) for n, v in named(F.col("c"), F.col("h"), F.col("l"))])


def _if(n: int, expr: str) -> str:
    return f"CASE WHEN count(*) {W_.format(n - 1)} >= {n} THEN {expr} END"


add("f1_sma", f"WITH {SQL_BARS} SELECT symbol, t, round({_if(20, 'avg(c) ' + W_.format(19))}, 6) AS sma FROM bars")(_bars_with(lambda c, h, l: [("sma", W.sma(c, 20))]))
add("f2_rsi", f"WITH {SQL_BARS}, x AS (SELECT *, c - lag(c) OVER (PARTITION BY symbol ORDER BY t) AS dd FROM bars), y AS (SELECT *, sum(greatest(dd, 0)) {W_.format(13)} AS g, sum(greatest(-dd, 0)) {W_.format(13)} AS k, count(dd) {W_.format(13)} AS n FROM x) SELECT symbol, t, round(CASE WHEN n >= 14 THEN CASE WHEN k = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / k) END END, 6) AS rsi FROM y")(_bars_with(lambda c, h, l: [("rsi", W.rsi(c, 14))]))
add("f4_atr", f"WITH {SQL_BARS}, x AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY t) AS p FROM bars), y AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(h - l, abs(h - p), abs(l - p)) END AS tr FROM x) SELECT symbol, t, round(CASE WHEN count(tr) {W_.format(13)} >= 14 THEN avg(tr) {W_.format(13)} END, 6) AS atr FROM y")(lambda s, d: rounded(W.with_atr(hour_bars(s, d), 14).select("symbol", "t", "atr"), "atr"))
add("f7_bollinger", f"WITH {SQL_BARS}, x AS (SELECT *, avg(c) {W_.format(19)} AS m, stddev_pop(c) {W_.format(19)} AS s, count(*) {W_.format(19)} AS n FROM bars) SELECT symbol, t, round(CASE WHEN n >= 20 THEN m - 2 * s END, 6) AS lower, round(CASE WHEN n >= 20 THEN m END, 6) AS middle, round(CASE WHEN n >= 20 THEN m + 2 * s END, 6) AS upper FROM x")(_bars_with(lambda c, h, l: zip(("lower", "middle", "upper"), W.bollinger(c, 20, 2.0))))
add("f8_donchian", f"WITH {SQL_BARS} SELECT symbol, t, round({_if(20, 'min(l) ' + W_.format(19))}, 6) AS low, round({_if(20, 'max(h) ' + W_.format(19))}, 6) AS high FROM bars")(_bars_with(lambda c, h, l: zip(("low", "high"), W.donchian(h, l, 20))))
add("f12_cci", f"WITH {SQL_BARS}, x AS (SELECT symbol, t, (h + l + c) / 3 AS tp, avg((h + l + c) / 3) {W_.format(19)} AS m, list((h + l + c) / 3) {W_.format(19)} AS v FROM bars), y AS (SELECT *, list_sum(list_transform(v, lambda q: abs(q - m))) / 20 AS mad FROM x) SELECT symbol, t, round(CASE WHEN len(v) >= 20 AND mad > 0 THEN (tp - m) / (0.015 * mad) END, 6) AS cci FROM y")(_bars_with(lambda c, h, l: [("cci", W.cci(h, l, c, 20))]))
add("f13_roc", f"WITH {SQL_BARS} SELECT symbol, t, round(c / lag(c, 12) OVER (PARTITION BY symbol ORDER BY t) - 1, 6) AS roc FROM bars")(_bars_with(lambda c, h, l: [("roc", W.roc(c, 12))]))
add("f14_zscore", f"WITH {SQL_BARS}, x AS (SELECT *, avg(c) {W_.format(19)} AS m, stddev_pop(c) {W_.format(19)} AS s, count(*) {W_.format(19)} AS n FROM bars) SELECT symbol, t, round(CASE WHEN n >= 20 AND s > 0 THEN (c - m) / s END, 6) AS z FROM x")(_bars_with(lambda c, h, l: [("z", W.zscore(c, 20))]))
add("f15_session_vwap", f"WITH {SQL_BARS}, x AS (SELECT *, {_day} AS day FROM bars), y AS (SELECT *, sum(c * greatest(vol, 1)) OVER w / sum(greatest(vol, 1)) OVER w AS vwap FROM x WINDOW w AS (PARTITION BY symbol, day ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT symbol, t, round(vwap, 6) AS vwap FROM y")(lambda s, d: rounded(W.with_session_vwap(hour_bars(s, d)).select("symbol", "t", "vwap"), "vwap"))


def _sma_cross(s: SparkSession, d: str) -> DataFrame:
    zone = F.when(F.col("f") > F.col("g"), 1).when(F.col("f") < F.col("g"), -1)
    x = hour_bars(s, d).withColumn("f", F.round(W.sma(F.col("c"), 5), 6)).withColumn("g", F.round(W.sma(F.col("c"), 20), 6)).withColumn("zone", zone)
    x = x.withColumn("edge", W.crossing(F.col("zone")))
    return x.select("symbol", "t", "c", F.when(F.col("edge") > 0, "BUY").when(F.col("edge") < 0, "SELL").otherwise("FLAT").alias("action"))


SQL_CROSS = f"{SQL_BARS}, s AS (SELECT symbol, t, c, round({_if(5, 'avg(c) ' + W_.format(4))}, 6) AS f, round({_if(20, 'avg(c) ' + W_.format(19))}, 6) AS g FROM bars), z AS (SELECT *, CASE WHEN f > g THEN 1 WHEN f < g THEN -1 END AS zone FROM s), p AS (SELECT *, last_value(zone IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM z), sig AS (SELECT symbol, t, c, CASE WHEN zone <> b AND zone > 0 THEN 'BUY' WHEN zone <> b AND zone < 0 THEN 'SELL' ELSE 'FLAT' END AS action FROM p)"
add("g1_sma_cross", f"WITH {SQL_CROSS} SELECT * FROM sig")(_sma_cross)


def _sixth(name: str) -> Column:
    """A column to 6 places, as SQL rounds the scaled double; round() goes by decimal text, which took half of all pairs' time."""
    x = F.col(name)
    return F.when(F.abs(x) < 1e9, F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6).otherwise(F.round(x, 6)).alias(name)


SQL_USER = f"ub AS (SELECT 'U' || user_id AS symbol, epoch_us(ts) // {DAY * 10**6} * {DAY} AS t, last(value ORDER BY ts, event_id) AS c FROM events GROUP BY 1, 2)"
add("d2_pair_stats", f"WITH {SQL_USER} SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.c, b.c), 6) AS rho, round(regr_slope(b.c, a.c), 6) AS beta FROM ub a JOIN ub b ON a.t = b.t AND a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 10")(lambda s, d: T.pair_stats(B.tick_bars(user_ticks(s, d), DAY), 10).select("a", "b", "n", _sixth("rho"), _sixth("beta")))


LEAST_OVERLAP = 10  # the given events are sparse; 180 for bars of minutes


def _aligned(s: SparkSession, d: str) -> DataFrame:
    return T.align_pairs(hour_bars(s, d), LEAST_OVERLAP)


SQL_ALIGN = (
    f"{SQL_BARS}, al AS (SELECT a.symbol || '|' || b.symbol AS symbol, a.t, a.c AS x, b.c AS y FROM bars a JOIN bars b "
    f"ON a.t = b.t AND a.symbol < b.symbol QUALIFY count(*) OVER (PARTITION BY a.symbol, b.symbol) >= {LEAST_OVERLAP})"
)
add("d1_align", f"WITH {SQL_ALIGN} SELECT symbol, t, x, y FROM al")(lambda s, d: _aligned(s, d).select("symbol", "t", "x", "y"))
_W60 = W_.format(59)
add(
    "f18_rolling_beta",
    f"WITH {SQL_ALIGN} SELECT symbol, t, round({_if(60, 'regr_slope(y, x) ' + _W60)}, 6) AS beta, "
    f"round({_if(60, f'sum(x * y) {_W60} / sum(x * x) {_W60}')}, 6) AS beta_origin FROM al",
)(
    lambda s, d: _aligned(s, d).select(
        "symbol", "t", F.round(W.rolling_beta(F.col("y"), F.col("x"), 60), 6).alias("beta"),
        F.round(W.rolling_beta_origin(F.col("y"), F.col("x"), 60), 6).alias("beta_origin"),
    )
)
add("d7_blotter_agg", f"WITH {SQL_FILLS}, {SQL_ORDERS} SELECT o.order_id, o.status, CAST(sum(qty) AS BIGINT) AS filled, floor(sum(qty * price) / sum(qty) * 1000 + 0.5) / 1000 AS vwap, max(f.t) AS last_fill, count(f.qty) AS n_fills FROM ord o LEFT JOIN fills f ON f.order_id = o.order_id GROUP BY 1, 2")(lambda s, d: T.blotter_agg(orders(s, d).select("order_id", "status"), fills(s, d)).withColumn("vwap", F.floor(F.col("vwap") * 1000 + 0.5) / 1000))
add("d11_asof_price", f"WITH {SQL_BARS}, ev AS (SELECT event_type AS symbol, epoch_us(ts) // 1000000 - 5400 AS t, event_id AS id FROM events) SELECT e.symbol, e.t, e.id, coalesce(b.c, 100.0) AS price FROM ev e ASOF LEFT JOIN bars b ON e.symbol = b.symbol AND e.t >= b.t")(lambda s, d: T.asof_price(ticks(s, d).select("symbol", (F.unix_seconds("ts") - 5400).alias("t"), "id"), hour_bars(s, d), 100.0))
SQL_FIFO = (
    f"{SQL_FILLS}, cum AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN qty ELSE 0 END) OVER w AS b, sum(CASE WHEN side = 'SELL' THEN qty ELSE 0 END) OVER w AS s "
    "FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY t, order_id, l_linenumber, l_partkey, symbol, qty, price ROWS UNBOUNDED PRECEDING)), "
    "mt AS (SELECT *, s - greatest(0, max(s - b) OVER w) AS m FROM cum WINDOW w AS "
    "(PARTITION BY symbol ORDER BY t, order_id, l_linenumber, l_partkey, symbol, qty, price ROWS UNBOUNDED PRECEDING)), "
    "m0 AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY symbol ORDER BY t, order_id, l_linenumber, l_partkey, symbol, qty, price), 0) AS m0 FROM mt)"
)
add(
    "d15_fifo",
    f"WITH {SQL_FIFO} SELECT x.symbol, round(sum((least(x.b, y.m) - greatest(x.b - x.qty, y.m0)) * (y.price - x.price)), 6) AS realized, "
    "CAST(sum(least(x.b, y.m) - greatest(x.b - x.qty, y.m0)) AS BIGINT) AS matched FROM m0 x JOIN m0 y ON x.symbol = y.symbol "
    "AND x.side = 'BUY' AND y.side = 'SELL' AND y.m > y.m0 AND x.b - x.qty < y.m AND y.m0 < x.b GROUP BY 1",
)(lambda s, d: rounded(T.fifo_match(fills(s, d), ORDER), "realized"))
add(
    "d15_open_lots",
    f"WITH {SQL_FIFO}, e AS (SELECT symbol, max(m) AS mm FROM mt GROUP BY 1) SELECT m0.symbol, order_id, l_linenumber, price, "
    "CAST(least(qty, b - mm) AS BIGINT) AS open FROM m0 JOIN e ON m0.symbol = e.symbol WHERE side = 'BUY' AND b > mm",
)(lambda s, d: T.open_lots(fills(s, d), ORDER).select("symbol", "order_id", "l_linenumber", "price", "open"))
add("e1_net_positions", f"WITH {SQL_FILLS} SELECT symbol, bucket, CAST(sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS BIGINT) AS net_qty, round(sum(CASE WHEN side = 'BUY' THEN qty * price END) / nullif(sum(CASE WHEN side = 'BUY' THEN qty ELSE 0 END), 0), 6) AS avg_buy FROM fills GROUP BY 1, 2")(lambda s, d: rounded(T.net_positions(fills(s, d), "symbol", "bucket"), "avg_buy"))
add("e4_order_health", f"WITH {SQL_ORDERS} SELECT x.status, count(o.order_id) AS n, round(coalesce(sum(notional), 0), 2) AS notional FROM (SELECT unnest(['NEW', 'PARTIAL', 'FILLED']) AS status) x LEFT JOIN ord o ON o.status = x.status GROUP BY 1")(lambda s, d: T.order_health(orders(s, d)).withColumn("notional", F.round("notional", 2)))
add("f30_cash_balance", f"WITH {SQL_FILLS} SELECT symbol, t, order_id, l_linenumber, l_partkey, qty, price, round(sum(CASE WHEN side = 'BUY' THEN -qty * price - fees ELSE qty * price - fees END) OVER (PARTITION BY symbol ORDER BY t, order_id, l_linenumber, l_partkey, qty, price ROWS UNBOUNDED PRECEDING), 4) AS balance FROM fills")(lambda s, d: T.running(T.cash_ledger(fills(s, d)), "delta", ["symbol"], [x for x in ORDER if x != "symbol"], "balance").select("symbol", "t", "order_id", "l_linenumber", "l_partkey", "qty", "price", F.round("balance", 4).alias("balance")))
add("i8_headroom", f"WITH {SQL_ORDERS} SELECT a.bucket, a.t, a.order_id AS id, round(coalesce(sum(b.notional), 0), 2) AS active FROM ord a LEFT JOIN ord b ON a.bucket = b.bucket AND b.t <= a.t AND a.t < b.t + (b.cust % 7 + 1) * {DAY} GROUP BY 1, 2, 3")(lambda s, d: T.active_at(orders(s, d).select("bucket", "t", F.col("order_id").alias("id")), orders(s, d).select("bucket", F.col("t").alias("created"), (F.col("t") + (F.col("cust") % 7 + 1) * DAY).alias("expires"), "notional")).withColumn("active", F.round("active", 2)))
add("i16_dedupe_fills", f"WITH {SQL_FILLS} SELECT order_id, price, qty, min(t) AS t FROM fills GROUP BY 1, 2, 3")(lambda s, d: T.first_of(fills(s, d), ["order_id", "price", "qty"], ["t"]).select("order_id", "price", "qty", "t"))
add("d14_position_diff", f"WITH {SQL_FILLS}, n AS (SELECT symbol, CAST(sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS BIGINT) AS qty FROM fills GROUP BY 1), a AS (SELECT symbol, CASE WHEN symbol % 5 = 0 THEN qty + 1 ELSE qty END AS qty FROM n WHERE symbol % 7 <> 0), j AS (SELECT coalesce(a.symbol, n.symbol) AS symbol, coalesce(a.qty, 0) AS broker, coalesce(n.qty, 0) AS local FROM a FULL JOIN n ON a.symbol = n.symbol) SELECT *, broker - local AS diff FROM j WHERE broker <> local")(lambda s, d: (lambda n: T.position_diff(n.where("symbol % 7 <> 0").withColumn("qty", F.when(F.col("symbol") % 5 == 0, F.col("qty") + 1).otherwise(F.col("qty"))), n))(fills(s, d).groupBy("symbol").agg(F.sum(T.signed()).alias("qty"))))
add("b4_gates", f"WITH {SQL_RESULTS} SELECT symbol, strategy, timeframe, CASE WHEN pnl_total IS NULL OR pnl_total <= 0 THEN 'non_positive_return' WHEN n_trades < 20 THEN 'min_trades' WHEN win_rate IS NULL OR win_rate * 100 < 30 THEN 'min_win_rate' WHEN abs(max_dd) > 3000 THEN 'max_drawdown' END AS rejected_reason FROM res")(lambda s, d: T.apply_gates(results(s, d), 20, 0.3, 3000).select("symbol", "strategy", "timeframe", "rejected_reason"))
add("b5_eligibility", f"WITH {SQL_RESULTS} SELECT symbol, strategy, timeframe, CASE WHEN coalesce(pnl_total <= 0, true) THEN 'non_positive_return' ELSE concat_ws(',', CASE WHEN n_trades < 20 THEN 'min_trades' END, CASE WHEN win_rate IS NULL THEN 'missing_win_rate' END, CASE WHEN win_rate < 0.3 THEN 'min_win_rate' END, CASE WHEN abs(max_dd) > 3000 THEN 'max_drawdown' END) END AS reasons FROM res")(lambda s, d: T.eligibility(results(s, d), min_win_rate=0.3, max_drawdown=3000).select("symbol", "strategy", "timeframe", "reasons"))
add("b6_reason_counts", f"WITH {SQL_RESULTS} SELECT CASE WHEN pnl_total IS NULL OR pnl_total <= 0 THEN 'non_positive_return' WHEN n_trades < 20 THEN 'min_trades' WHEN win_rate IS NULL OR win_rate * 100 < 30 THEN 'min_win_rate' WHEN abs(max_dd) > 3000 THEN 'max_drawdown' END AS rejected_reason, count(*) AS n FROM res GROUP BY 1")(lambda s, d: T.apply_gates(results(s, d), 20, 0.3, 3000).groupBy("rejected_reason").agg(F.count("*").alias("n")))
add("b7_drawdown_bucket", f"WITH {SQL_RESULTS} SELECT symbol, strategy, timeframe, CASE WHEN abs(max_dd) <= 1000 THEN 'LOW' WHEN abs(max_dd) <= 3000 THEN 'MED' ELSE 'HIGH' END AS bucket FROM res")(lambda s, d: results(s, d).select("symbol", "strategy", "timeframe", T.by_thresholds(F.col("max_dd"), [(1000, "LOW"), (3000, "MED")], "HIGH").alias("bucket")))
add("e11_config", f"WITH {SQL_RESULTS} SELECT strategy, timeframe, round(sum(pnl_total * n_trades) / sum(CASE WHEN pnl_total IS NOT NULL THEN n_trades END), 6) AS pnl_total, round(sum(win_rate * n_trades) / sum(CASE WHEN win_rate IS NOT NULL THEN n_trades END), 6) AS win_rate, max(abs(max_dd)) AS max_dd, CAST(sum(n_trades) AS BIGINT) AS n_trades, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols FROM res GROUP BY 1, 2")(lambda s, d: rounded(T.weighted_config(results(s, d), ["strategy", "timeframe"], ["pnl_total", "win_rate"]), "pnl_total", "win_rate"))
add("f25_topk", f"WITH {SQL_RESULTS} SELECT symbol, strategy, timeframe, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY strategy, timeframe ORDER BY n_trades DESC, symbol) AS rank FROM res) WHERE rank <= 3")(lambda s, d: T.topk(results(s, d), ["strategy", "timeframe"], [F.desc("n_trades"), F.col("symbol")], 3).select("symbol", "strategy", "timeframe", "rank"))
add("f26_cohort_z", f"WITH {SQL_RESULTS}, c AS (SELECT *, count(pnl_total) OVER (PARTITION BY strategy, timeframe) AS n, row_number() OVER (PARTITION BY strategy, timeframe ORDER BY pnl_total ASC NULLS LAST) - 1 AS r FROM res), b AS (SELECT *, n * 2 // 100 AS lo, greatest(n * 2 // 100, n * 98 // 100 - 1) AS hi FROM c), w AS (SELECT *, min(CASE WHEN r = lo THEN pnl_total END) OVER p AS vl, min(CASE WHEN r = hi THEN pnl_total END) OVER p AS vh FROM b WINDOW p AS (PARTITION BY strategy, timeframe)), s AS (SELECT strategy, timeframe, median(CASE WHEN pnl_total IS NOT NULL THEN least(greatest(pnl_total, vl), vh) END) AS m, stddev_pop(CASE WHEN pnl_total IS NOT NULL THEN least(greatest(pnl_total, vl), vh) END) AS sd FROM w GROUP BY 1, 2) SELECT w.symbol, w.strategy, w.timeframe, round(CASE WHEN n = 0 THEN 0.0 WHEN pnl_total IS NULL THEN -0.1 ELSE (pnl_total - m) / (CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END) END, 6) AS z FROM w JOIN s USING (strategy, timeframe)")(lambda s, d: rounded(T.cohort_z(results(s, d), ["strategy", "timeframe"], "pnl_total").select("symbol", "strategy", "timeframe", "z"), "z"))
add("e14_histogram_quantile", "WITH h AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([5.0::DOUBLE, 10.0, 20.0, 50.0, 100.0, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2), x AS (SELECT *, coalesce(lag(n) OVER w, 0) AS n0, coalesce(lag(le) OVER w, 0) AS le0, 0.95 * max(n) OVER (PARTITION BY event_type) AS rk FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)) SELECT event_type, round(CASE WHEN isinf(le) THEN le0 ELSE le0 + (le - le0) * (rk - n0) / (n - n0) END, 6) AS quantile FROM x WHERE n >= rk AND n0 < rk")(lambda s, d: rounded(T.histogram_quantile(T.to_histogram(_read(s, d, "events"), ["event_type"], "value", [5, 10, 20, 50, 100]), ["event_type"], 0.95), "quantile"))
add("e15_counter_rate", f"WITH {SQL_TICKS} SELECT symbol, us // 300000000 * 300 AS b, round(greatest(0, last(ltp ORDER BY us // 1000000, id) - first(ltp ORDER BY us // 1000000, id)) / 300, 6) AS rate FROM ticks GROUP BY 1, 2")(lambda s, d: rounded(T.counter_rate(ticks(s, d).select("symbol", F.unix_seconds("ts").alias("t"), "id", F.col("ltp").alias("value")), 300, ["symbol"]), "rate"))
add("e10_eod", f"WITH {SQL_FILLS} SELECT t // {DAY} AS day, count(*) AS n_fills, count(DISTINCT symbol) AS symbols, CAST(sum(qty) AS BIGINT) AS qty FROM fills GROUP BY 1")(lambda s, d: fills(s, d).groupBy(F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n_fills"), F.count_distinct("symbol").alias("symbols"), F.sum("qty").alias("qty")))


def graded(spark: SparkSession, d: str) -> DataFrame:
    """results with the other measures that gates and policies ask for, derived from their keys."""
    j = F.col("symbol") * 7 + F.col("timeframe") * 3
    some = lambda n, v: F.when(j % n != 0, v).cast("double")
    return results(spark, d).select(
        "*", some(4, (j % 11 - 2) / 4).alias("R"), some(3, j % 13).alias("slippage_bps"), some(5, j % 9 / 8).alias("sharpe"), some(1000, j % 17).alias("turnover"),
        some(6, j % 50).alias("avg_hold_min"), some(1000, j % 23).alias("latency_ms"), F.when(j % 8 != 0, j % 40 * DAY).alias("end_t"),
    )


SQL_GRADED = SQL_RESULTS + (
    f", jj AS (SELECT *, symbol * 7 + timeframe * 3 AS j FROM res), gr AS (SELECT *, CASE WHEN j % 4 <> 0 THEN (j % 11 - 2) / 4.0::DOUBLE END AS R, "
    "CASE WHEN j % 3 <> 0 THEN j % 13 END AS slip, CASE WHEN j % 5 <> 0 THEN j % 9 / 8.0::DOUBLE END AS sharpe, CASE WHEN j % 1000 <> 0 THEN j % 17 END AS turnover, "
    f"CASE WHEN j % 6 <> 0 THEN j % 50 END AS hold, CASE WHEN j % 1000 <> 0 THEN j % 23 END AS lat, CASE WHEN j % 8 <> 0 THEN j % 40 * {DAY} END AS end_t FROM jj)"
)
add(
    "b4_all_gates",
    f"WITH {SQL_GRADED} SELECT symbol, strategy, timeframe, CASE WHEN coalesce(R, pnl_total, 0) <= 0 THEN 'non_positive_return' WHEN n_trades < 10 THEN 'min_trades' "
    "WHEN coalesce(win_rate, 0) < 0.2 THEN 'min_win_rate' WHEN abs(max_dd) > 5000 THEN 'max_drawdown' WHEN coalesce(slip, 0) > 10 THEN 'slippage' "
    "WHEN R < 0.5 THEN 'min_R' WHEN pnl_total < 50 THEN 'min_pnl_total' END AS rejected_reason FROM gr",
)(
    lambda s, d: T.apply_gates(graded(s, d), 10, 0.2, 5000, 10, 0.5, 50).select("symbol", "strategy", "timeframe", "rejected_reason")
)
add(
    "b5_all_checks",
    f"WITH {SQL_GRADED} SELECT symbol, strategy, timeframe, CASE WHEN coalesce(R, pnl_total, 0) <= 0 THEN 'non_positive_return' ELSE concat_ws(',', "
    f"CASE WHEN end_t IS NULL OR {40 * DAY} - end_t > {30 * DAY} THEN 'stale_metrics' END, CASE WHEN n_trades < 20 THEN 'min_trades' END, CASE WHEN R < 0.5 THEN 'min_R' END, "
    "CASE WHEN pnl_total < 50 THEN 'min_pnl_total' END, CASE WHEN sharpe IS NULL OR sharpe < 0.25 THEN 'min_sharpe' END, CASE WHEN win_rate IS NULL THEN 'missing_win_rate' END, "
    "CASE WHEN win_rate < 0.5 THEN 'min_win_rate' END, CASE WHEN abs(max_dd) > 3000 THEN 'max_drawdown' END, CASE WHEN turnover > 12 THEN 'max_turnover' END, "
    "CASE WHEN hold > 40 THEN 'max_avg_hold_min' END, CASE WHEN lat > 20 THEN 'max_latency_ms' END) END AS reasons FROM gr",
)(
    lambda s, d: T.eligibility(
        graded(s, d), 40 * DAY, 30, min_R=0.5, min_pnl_total=50, max_drawdown=3000, max_turnover=12, max_avg_hold_min=40, max_latency_ms=20
    ).select("symbol", "strategy", "timeframe", "reasons")
)
