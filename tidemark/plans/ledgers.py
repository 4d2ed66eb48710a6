"""Ledger, risk and pair-table queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import alerts as A
from ..operators import bars as B
from ..operators import ledgers as L
from ..operators import overtime as Q
from ..operators import tables as T
from .catalog import DAY, HOUR, ORDER, SQL_BARS, SQL_FILLS, SQL_ORDERS, SQL_RESULTS, SQL_TICKS, SQL_VENDOR, _aligned, _read, add, fills, hour_bars, orders, results, rounded, ticks, vendor
from .signals import SQL_SPREAD, _spread

C = F.col
KEY = ", ".join(ORDER)
PNL = "g AS (SELECT symbol, bucket, CAST(sum(CASE WHEN side = 'BUY' THEN qty ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN side = 'BUY' THEN 0 ELSE qty END) AS BIGINT) AS s, sum(CASE WHEN side = 'BUY' THEN qty * price ELSE 0 END) AS i, sum(CASE WHEN side = 'BUY' THEN 0 ELSE qty * price END) AS o, count(*) AS n, last(price ORDER BY " + KEY + ") AS last FROM fills GROUP BY 1, 2), pn AS (SELECT symbol, bucket, b - s AS net_qty, coalesce(i / nullif(b, 0), 0) AS a, o - coalesce(i / nullif(b, 0), 0) * s - n * 20.0 AS realized, (last - coalesce(i / nullif(b, 0), 0)) * (b - s) AS unrealized FROM g)"


def _pnl(s: SparkSession, d: str) -> DataFrame:
    return L.pnl_snapshot(fills(s, d), ["symbol", "bucket"], ORDER)


add("e2_pnl_snapshot", f"WITH {SQL_FILLS}, {PNL} SELECT symbol, bucket, net_qty, round(a, 4) AS avg_cost, round(realized, 4) AS realized, round(unrealized, 4) AS unrealized FROM pn")(lambda s, d: _pnl(s, d).select("symbol", "bucket", "net_qty", *[F.round(c, 4).alias(c) for c in ("avg_cost", "realized", "unrealized")]))
add("e3_bucket_equity", f"WITH {SQL_FILLS}, {PNL} SELECT x.bucket, round(coalesce(sum(realized), 0), 2) AS realized, round(coalesce(sum(unrealized), 0), 2) AS unrealized FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS bucket) x LEFT JOIN pn ON pn.bucket = x.bucket GROUP BY 1")(
    lambda s, d: L.over_domain(_pnl(s, d), "bucket", ["A", "N", "R", "X"], {"realized": 0.0, "unrealized": 0.0}).select("bucket", F.round("realized", 2).alias("realized"), F.round("unrealized", 2).alias("unrealized"))
)
add("e5_open_ages", f"WITH {SQL_ORDERS} SELECT order_id, status, (SELECT max(t) FROM ord) - t AS age FROM ord WHERE status <> 'FILLED'")(lambda s, d: orders(s, d).where("status <> 'FILLED'").crossJoin(F.broadcast(orders(s, d).agg(F.max("t").alias("now")))).select("order_id", "status", (C("now") - C("t")).alias("age")))
add("e6_pair_positions", f"WITH {SQL_FILLS}, f AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS leg FROM fills), g AS (SELECT order_id, leg, CAST(sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS BIGINT) AS q, min(symbol) AS s, max(t) AS t, sum(CASE WHEN side = 'BUY' THEN -qty * price ELSE qty * price END) AS cash FROM f GROUP BY 1, 2) SELECT order_id, max(CASE WHEN leg = 'A' THEN q END) AS qty_a, max(CASE WHEN leg = 'A' THEN s END) AS symbol_a, max(CASE WHEN leg = 'B' THEN q END) AS qty_b, max(CASE WHEN leg = 'B' THEN s END) AS symbol_b, max(t) AS last_fill, round(sum(cash), 2) AS cash FROM g GROUP BY 1")(
    lambda s, d: L.pair_positions(fills(s, d).withColumn("leg", F.when(C("l_partkey") % 2 == 0, "A").otherwise("B")), "order_id", "leg").withColumn("cash", F.round("cash", 2))
)
add("e7_pair_cash", f"WITH {SQL_FILLS} SELECT order_id, round(sum(CASE WHEN side = 'BUY' THEN -qty * price ELSE qty * price END), 2) AS cash FROM fills GROUP BY 1")(lambda s, d: fills(s, d).groupBy("order_id").agg(F.round(F.sum(-T.signed() * C("price")), 2).alias("cash")))
add("e8_order_summary", f"WITH {SQL_ORDERS} SELECT cust, " + ", ".join(f"count(*) FILTER (status = '{x}') AS n_{x.lower()}" for x in T.STATUSES) + ", max(t) AS last_order FROM ord GROUP BY 1")(lambda s, d: orders(s, d).groupBy("cust").agg(*[F.count_if(C("status") == x).alias(f"n_{x.lower()}") for x in T.STATUSES], F.max("t").alias("last_order")))
add("e9_top_runs", f"WITH {SQL_RESULTS} SELECT strategy, timeframe, round(avg(pnl_total), 6) AS pnl, CAST(sum(n_trades) AS BIGINT) AS n FROM res GROUP BY 1, 2 HAVING sum(n_trades) >= 100 ORDER BY avg(pnl_total) DESC, strategy, timeframe LIMIT 5")(
    lambda s, d: results(s, d).groupBy("strategy", "timeframe").agg(F.round(F.avg("pnl_total"), 6).alias("pnl"), F.sum("n_trades").alias("n")).where("n >= 100").orderBy(F.desc("pnl"), "strategy", "timeframe").limit(5)
)
add("e16_over_time", f"WITH {SQL_BARS} SELECT symbol, t, round(avg(c) OVER w, 6) AS mean, round(max(c) OVER w, 6) AS most FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)")(
    lambda s, d: (lambda w: hour_bars(s, d).select("symbol", "t", F.round(F.avg("c").over(w), 6).alias("mean"), F.round(F.max("c").over(w), 6).alias("most")))(W.ordered().rangeBetween(-6 * HOUR, 0))
)
_OVER = f"OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {6 * HOUR * 10**6} PRECEDING AND CURRENT ROW)"
add("e16_quantiles", f"WITH {SQL_TICKS} SELECT symbol, id, round(quantile_cont(ltp, 0.5) {_OVER}, 6) AS p50, round(quantile_cont(ltp, 0.95) {_OVER}, 6) AS p95 FROM ticks")(
    lambda s, d: rounded(Q.quantiles_over_time(ticks(s, d).select("symbol", "id", "ltp", F.unix_micros("ts").alias("us")), ["symbol"], "us", "ltp", 6 * HOUR * 10**6, {"p50": 0.5, "p95": 0.95}), "p50", "p95").select("symbol", "id", "p50", "p95")
)
add("e17_exposure", f"WITH {SQL_FILLS}, l AS (SELECT symbol, last(price ORDER BY {KEY}) AS px FROM fills GROUP BY 1), n AS (SELECT symbol, bucket, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS q FROM fills GROUP BY 1, 2) SELECT bucket, round(sum(q * px), 2) AS exposure FROM n JOIN l ON n.symbol = l.symbol GROUP BY 1")(
    lambda s, d: (lambda f: f.groupBy("symbol", "bucket").agg(F.sum(T.signed()).alias("q")).join(f.groupBy("symbol").agg(F.max_by("price", F.struct(*ORDER)).alias("px")), "symbol").groupBy("bucket").agg(F.round(F.sum(C("q") * C("px")), 2).alias("exposure")))(fills(s, d))
)
add("e18_best_variant", f"WITH {SQL_RESULTS}, g AS (SELECT timeframe, strategy, round(avg(pnl_total), 6) AS score, count(*) AS n FROM res WHERE pnl_total > 0 GROUP BY 1, 2) SELECT timeframe, strategy, score, n FROM (SELECT *, row_number() OVER (PARTITION BY timeframe ORDER BY score DESC, n DESC, strategy DESC) AS r FROM g) WHERE r = 1")(
    lambda s, d: B.latest(results(s, d).where("pnl_total > 0").groupBy("timeframe", "strategy").agg(F.round(F.avg("pnl_total"), 6).alias("score"), F.count("*").alias("n")), ["timeframe"], ["score", "n", "strategy"])
)
add("e20_alerts", f"WITH {SQL_ORDERS}, h AS (SELECT bucket, t, count(*) AS n, count(*) FILTER (status = 'PARTIAL') AS p FROM ord GROUP BY 1, 2), r AS (SELECT *, CAST(sum(p) OVER w AS BIGINT) AS part, CAST(sum(n) OVER w AS BIGINT) AS total FROM h WINDOW w AS (PARTITION BY bucket ORDER BY t RANGE BETWEEN {6 * DAY} PRECEDING AND CURRENT ROW)), b AS (SELECT *, CASE WHEN part * 20 > total THEN 1 ELSE 0 END AS high FROM r) SELECT bucket, t, part, total, CAST(min(high) OVER (PARTITION BY bucket ORDER BY t RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW) AS INT) AS firing FROM b")(
    lambda s, d: orders(s, d).groupBy("bucket", "t").agg(F.count("*").alias("n"), F.count_if(C("status") == "PARTIAL").alias("p")).withColumn("part", F.sum("p").over(W.ordered("bucket").rangeBetween(-6 * DAY, 0))).withColumn("total", F.sum("n").over(W.ordered("bucket").rangeBetween(-6 * DAY, 0)))
    .withColumn("high", (C("part") * 20 > C("total")).cast("int")).select("bucket", "t", "part", "total", F.min("high").over(W.ordered("bucket").rangeBetween(-2 * DAY, 0)).alias("firing"))
)
add("d5_verify_recent", f"WITH {SQL_VENDOR}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS r FROM bars) SELECT k.symbol, k.t, CASE WHEN r <= 24 AND v.c IS NOT NULL THEN v.c ELSE k.c END AS c, CASE WHEN r <= 24 AND v.vol IS NOT NULL THEN v.vol ELSE k.vol END AS vol FROM k LEFT JOIN vendor v ON k.symbol = v.symbol AND k.t = v.t")(
    lambda s, d: (lambda x, v: x.join(v, ["symbol", "t"], "left").select("symbol", "t", *[F.when(C("rank") <= 24, F.coalesce(f"v_{c}", c)).otherwise(C(c)).alias(c) for c in ("c", "vol")]))(T.topk(hour_bars(s, d), ["symbol"], [F.desc("t")], 2**31 - 1), vendor(hour_bars(s, d)).select("symbol", "t", C("c").alias("v_c"), C("vol").alias("v_vol")))
)
add("d8_blotter", f"WITH {SQL_FILLS}, {SQL_ORDERS} SELECT o.order_id, o.status, f.symbol, f.side, f.qty, f.price, f.fees AS fee, f.t FROM ord o LEFT JOIN fills f ON f.order_id = o.order_id")(
    lambda s, d: orders(s, d).select("order_id", "status").join(fills(s, d).select(C("order_id").alias("_o"), "symbol", "side", "qty", "price", "t", F.to_json(F.struct(F.struct(C("fees").alias("total")).alias("fees"))).alias("extra")), C("order_id") == C("_o"), "left")
    .select("order_id", "status", "symbol", "side", "qty", "price", F.get_json_object("extra", "$.fees.total").cast("double").alias("fee"), "t")
)
add("d9_completion_latency", f"WITH {SQL_FILLS}, {SQL_ORDERS} SELECT o.order_id, f.l_linenumber, f.l_partkey, f.t - o.t AS latency FROM ord o JOIN fills f ON f.order_id = o.order_id WHERE f.t > o.t")(lambda s, d: orders(s, d).select("order_id", C("t").alias("t0")).join(fills(s, d), "order_id").where("t > t0").select("order_id", "l_linenumber", "l_partkey", (C("t") - C("t0")).alias("latency")))
add("d10_first_fill", f"WITH {SQL_FILLS}, {SQL_ORDERS} SELECT o.order_id, o.t, min(f.t) - o.t AS latency FROM ord o JOIN fills f ON f.order_id = o.order_id GROUP BY 1, 2 HAVING min(f.t) > o.t ORDER BY o.t DESC, o.order_id DESC LIMIT 500")(lambda s, d: L.first_latency(orders(s, d), fills(s, d)).orderBy(F.desc("t"), F.desc("order_id")).limit(500))
add("d12_pair_join", f"WITH {SQL_ORDERS}, live AS (SELECT DISTINCT cust % 40 AS a, order_id % 40 AS b, CASE WHEN order_id % 3 = 0 THEN (cust % 7)::DOUBLE END AS beta FROM ord), u AS (SELECT least(c_custkey % 40, c_nationkey) AS a, greatest(c_custkey % 40, c_nationkey) AS b, max(c_acctbal) AS beta FROM customer GROUP BY 1, 2) SELECT live.a, live.b, coalesce(live.beta, u.beta) AS beta FROM live LEFT JOIN u ON least(live.a, live.b) = u.a AND greatest(live.a, live.b) = u.b")(
    lambda s, d: L.pair_join(orders(s, d).select((C("cust") % 40).alias("a"), (C("order_id") % 40).alias("b"), F.when(C("order_id") % 3 == 0, (C("cust") % 7).cast("double")).alias("beta")).distinct(), _read(s, d, "customer").groupBy(F.least(C("c_custkey") % 40, "c_nationkey").alias("a"), F.greatest(C("c_custkey") % 40, "c_nationkey").alias("b")).agg(F.max("c_acctbal").alias("beta")), ["beta"])
)
add("d13_resolve", "WITH i AS (SELECT s_nationkey AS nation, s_suppkey AS token, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END, s_suppkey) AS r FROM supplier) SELECT c.c_custkey AS id, i.token, i.token IS NULL AS missing FROM customer c LEFT JOIN i ON i.nation = c.c_nationkey AND i.r = 1")(
    lambda s, d: _read(s, d, "customer").join(T.first_of(_read(s, d, "supplier").withColumn("p", F.when(C("s_acctbal") > 5000, 0).otherwise(1)), ["s_nationkey"], ["p", "s_suppkey"]), C("c_nationkey") == C("s_nationkey"), "left").select(C("c_custkey").alias("id"), C("s_suppkey").alias("token"), C("s_suppkey").isNull().alias("missing"))
)
add("d18_selected", f"WITH {SQL_RESULTS}, p AS (SELECT strategy, timeframe FROM res GROUP BY 1, 2 HAVING sum(n_trades) % 2 = 0) SELECT symbol, strategy, timeframe, n_trades FROM res WHERE EXISTS (SELECT 1 FROM p WHERE p.strategy = res.strategy AND p.timeframe = res.timeframe)")(
    lambda s, d: results(s, d).join(results(s, d).groupBy("strategy", "timeframe").agg(F.sum("n_trades").alias("n")).where("n % 2 = 0"), ["strategy", "timeframe"], "left_semi").select("symbol", "strategy", "timeframe", "n_trades")
)
add("b3_local_minute", "SELECT event_id AS id, CAST((epoch_us(ts) // 1000000 + 19800) % 86400 // 60 AS BIGINT) AS minute, CAST((epoch_us(ts) // 1000000 + 19800) // 86400 AS BIGINT) AS day, (epoch_us(ts) // 1000000 + 19800) % 86400 // 60 >= 915 AS beyond FROM events")(
    lambda s, d: ticks(s, d).withColumn("x", F.unix_seconds("ts") + 19800).select("id", F.floor(C("x") % DAY / 60).alias("minute"), F.floor(C("x") / DAY).alias("day")).withColumn("beyond", C("minute") >= 915)
)
add("b8_units", f"WITH {SQL_RESULTS} SELECT symbol, strategy, timeframe, CASE WHEN win_rate <= 1 THEN win_rate * 100 ELSE win_rate END AS win_pct, round(pnl_total / n_trades, 6) AS per_trade, CAST(regexp_extract(timeframe || 'm', '[0-9]+') AS INT) AS minutes FROM res")(
    lambda s, d: results(s, d).select("symbol", "strategy", "timeframe", F.when(C("win_rate") <= 1, C("win_rate") * 100).otherwise(C("win_rate")).alias("win_pct"), F.round(F.try_divide("pnl_total", "n_trades"), 6).alias("per_trade"), F.regexp_extract(F.concat(C("timeframe").cast("string"), F.lit("m")), "[0-9]+", 0).cast("int").alias("minutes"))
)
SQL_STATE = f"{SQL_SPREAD}, st AS (SELECT symbol, t, z, t // {HOUR} % 3 - 1 AS position FROM sz)"
_state = lambda s, d: _spread(s, d).select("symbol", "t", "z", (F.floor(C("t") / HOUR) % 3 - 1).alias("position"))
add("b9_threshold_alerts", f"WITH {SQL_STATE}, k AS (SELECT symbol, t, unnest(['ENTRY', 'EXIT', 'STOP']) AS kind, unnest([CASE WHEN position = 0 THEN abs(abs(z) - 2) END, CASE WHEN position <> 0 THEN abs(abs(z) - 0.5) END, CASE WHEN position <> 0 THEN abs(abs(z) - 3) END]) AS gap FROM st) SELECT symbol, t, kind, round(gap, 6) AS gap FROM k WHERE gap <= 0.25")(lambda s, d: L.threshold_alerts(_state(s, d), 2.0, 0.5, 3.0, 0.25))
add("b10_pair_status", f"WITH {SQL_STATE} SELECT symbol, t, CASE WHEN z IS NULL THEN 'PENDING' WHEN position <> 0 THEN 'HOLD' WHEN abs(z) >= 2 THEN 'OUTSIDE ENTRY' ELSE 'NEUTRAL' END AS status, round(abs(abs(z) - 2), 6) AS distance FROM st")(
    lambda s, d: _state(s, d).select("symbol", "t", F.when(C("z").isNull(), "PENDING").when(C("position") != 0, "HOLD").when(F.abs("z") >= 2, "OUTSIDE ENTRY").otherwise("NEUTRAL").alias("status"), F.round(F.abs(F.abs("z") - 2), 6).alias("distance"))
)
add("b11_staleness", "WITH l AS (SELECT user_id AS symbol, max(epoch_us(ts) // 1000000) AS t FROM events GROUP BY 1), n AS (SELECT *, (SELECT max(t) FROM l) - t AS age FROM l) SELECT symbol, t, CASE WHEN age <= 1.5 * 14400 THEN 'OK' WHEN age <= 3 * 14400 THEN 'WARN' ELSE 'STALE' END AS status FROM n")(
    lambda s, d: (lambda l: L.staleness(l.crossJoin(F.broadcast(l.agg(F.max("t").alias("now")))), C("now"), 14400).drop("now"))(_read(s, d, "events").groupBy(C("user_id").alias("symbol")).agg(F.max(F.unix_seconds(C("ts").cast("timestamp"))).alias("t")))
)
add("b13_shadow", "WITH x AS (SELECT event_id, regexp_extract(props, '[0-9]+') AS k FROM events) SELECT 'SHADOW:' || event_id AS id, '{\"k\":\"' || k || '\",\"shadow\":\"true\"}' AS extra FROM x WHERE CAST(k AS BIGINT) % 7 <> 0")(
    lambda s, d: _read(s, d, "events").where(F.get_json_object("props", "$.k").cast("long") % 7 != 0).select(F.concat(F.lit("SHADOW:"), "event_id").alias("id"), F.to_json(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("shadow"), F.lit("true")))).alias("extra"))
)
add("b14_pair_signal_rows", f"WITH {SQL_TICKS} SELECT id, upper(symbol) AS symbol, CASE WHEN vol % 3 = 0 THEN 'BUY' WHEN vol % 3 = 1 THEN 'SELL' END AS side, CASE WHEN vol % 5 = 0 THEN 0.0 ELSE ltp END::DOUBLE AS z FROM ticks")(
    lambda s, d: ticks(s, d).withColumn("raw", F.when(C("vol") % 5 == 0, "bad").otherwise(C("ltp").cast("string"))).select("id", F.upper("symbol").alias("symbol"), F.element_at(F.create_map(F.lit(0), F.lit("BUY"), F.lit(1), F.lit("SELL")), (C("vol") % 3).cast("int")).alias("side"), F.coalesce(F.expr("try_cast(raw as double)"), F.lit(0.0)).alias("z"))
)
add("c10_latency", f"WITH {SQL_TICKS} SELECT id, greatest(0, (us // {HOUR * 10**6} + 1) * {HOUR} - us // 1000000) AS to_close FROM ticks")(lambda s, d: ticks(s, d).withColumn("t", F.unix_seconds("ts")).select("id", F.greatest(F.lit(0).cast("long"), B.bucket(C("t"), HOUR) + HOUR - C("t")).alias("to_close")))
SQL_WAC = f"o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {KEY}) AS n FROM fills), k AS (SELECT symbol, n, list(struct_pack(q := CASE WHEN side = 'BUY' THEN qty ELSE -qty END::DOUBLE, a := price, r := 0.0::DOUBLE)) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING) AS v FROM o), w AS (SELECT symbol, n, list_reduce(list_prepend(struct_pack(q := 0.0::DOUBLE, a := 0.0::DOUBLE, r := 0.0::DOUBLE), v), lambda s, x: CASE WHEN x.q > 0 THEN struct_pack(q := s.q + x.q, a := (s.q * s.a + x.q * x.a) / (s.q + x.q), r := s.r) ELSE struct_pack(q := s.q - least(s.q, -x.q), a := CASE WHEN s.q + x.q > 0 THEN s.a ELSE 0.0 END, r := s.r + least(s.q, -x.q) * (x.a - s.a)) END) AS z FROM k)"
add("i1_wac_positions", f"WITH {SQL_FILLS}, {SQL_WAC} SELECT symbol, n, CAST(z.q AS BIGINT) AS qty, floor(z.a * 10000 + 0.5) / 10000 AS avg_price, floor(z.r * 10000 + 0.5) / 10000 AS realized FROM w")(lambda s, d: L.wac_positions(fills(s, d), ORDER).select("symbol", "n", "qty", *[(F.floor(C(c) * 10000 + 0.5) / 10000).alias(c) for c in ("avg_price", "realized")]))
add("i2_cash_ledger", f"WITH {SQL_FILLS} SELECT symbol, order_id, l_linenumber, l_partkey, t, round(CASE WHEN side = 'BUY' THEN -qty * price - fees ELSE qty * price - fees END, 4) AS delta, side || '_FILL' AS reason FROM fills")(lambda s, d: T.cash_ledger(fills(s, d)).select("symbol", "order_id", "l_linenumber", "l_partkey", "t", F.round("delta", 4).alias("delta"), F.concat("side", F.lit("_FILL")).alias("reason")))
add("i7_size_position", f"WITH {SQL_FILLS} SELECT symbol, order_id, l_linenumber, l_partkey, t, CAST(floor(least(floor(100000 / price), CASE WHEN l_linenumber % 4 = 0 THEN floor(100000 / price) ELSE floor(1000 / abs(price - floor(price * 98 + 0.5) / 100)) END) / (l_linenumber * 5)) * (l_linenumber * 5) AS BIGINT) AS units FROM fills")(
    lambda s, d: fills(s, d).withColumn("stop", F.when(C("l_linenumber") % 4 != 0, F.floor(C("price") * 98 + 0.5) / 100)).select("symbol", "order_id", "l_linenumber", "l_partkey", "t", L.size_position(C("price"), C("stop"), 1000.0, 100000.0, C("l_linenumber") * 5).alias("units"))
)
BUDGETS = {"LOW": (150_000.0, 60_000.0), "MED": (250_000.0, 90_000.0), "HIGH": (200_000.0, 120_000.0)}
_RISK = "CASE WHEN order_id % 50 = 0 THEN 'vip' WHEN bucket = '1' THEN 'low' WHEN bucket = '2' THEN 'Med' WHEN bucket = '3' THEN 'HIGH' WHEN bucket = '4' THEN '' END"
_LEVER = "CASE order_id % 4 WHEN 1 THEN '0' WHEN 2 THEN '2.5' WHEN 3 THEN 'x' END"


def requests(s: SparkSession, d: str) -> DataFrame:
    """Orders as they ask for admission: a bucket's name as written, a price, a quantity and a leverage that may be no number."""
    x = orders(s, d).withColumn("qty", 1 + C("order_id") % 7)
    return x.select(C("order_id").alias("id"), "t", F.floor(C("t") / (30 * DAY)).alias("day"), F.expr(_RISK).alias("risk_bucket"), (C("notional") / C("qty")).alias("px_ref"), "qty", F.expr(_LEVER).alias("leverage"))


_of = lambda k: "CASE bucket " + " ".join(f"WHEN '{b}' THEN {v[k]}::DOUBLE" for b, v in BUDGETS.items()) + " ELSE 0 END"
SQL_REQUESTS = (
    f"{SQL_ORDERS}, rq AS (SELECT order_id AS id, t, t // {30 * DAY} AS day, {_RISK} AS rb, notional / (1 + order_id % 7) AS px, 1 + order_id % 7 AS qty, coalesce(try_cast({_LEVER} AS DOUBLE), 5) AS lev FROM ord), "
    "cn AS (SELECT id, t, day, upper(coalesce(nullif(rb, ''), 'MED')) AS bucket, px * qty / CASE WHEN lev > 0 THEN lev ELSE 1 END AS notional FROM rq), "
    f"ct AS (SELECT *, {_of(0)} AS cap, CASE WHEN notional <= 0 THEN 'bad_notional' WHEN notional > {_of(1)} + 1e-6 THEN 'exceeds_max_per_trade' END AS r FROM cn)"
)
add(
    "i9_admit_orders",
    f"WITH {SQL_REQUESTS}, us AS (SELECT *, list_reduce(list_prepend(0e0, coalesce(list(notional) OVER (PARTITION BY bucket, day ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])), "
    "lambda u, x: CASE WHEN u + x > cap + 1e-6 THEN u ELSE u + x END) AS used FROM ct WHERE r IS NULL) "
    "SELECT bucket, day, id, CASE WHEN used + notional > cap + 1e-6 THEN 'exceeds_bucket_budget' END AS reason FROM us UNION ALL SELECT bucket, day, id, r FROM ct WHERE r IS NOT NULL",
)(lambda s, d: L.admit_orders(L.cash_notional(requests(s, d)), BUDGETS, ["t", "id"]).select("bucket", "day", "id", "reason"))
add("i14_unrealized", f"WITH {SQL_FILLS}, {PNL}, u AS (SELECT symbol::VARCHAR AS symbol, unrealized FROM pn UNION ALL SELECT 'TOTAL', unrealized FROM pn) SELECT symbol, round(sum(unrealized), 2) AS unrealized FROM u GROUP BY 1")(
    lambda s, d: _pnl(s, d).rollup("symbol").agg(F.round(F.sum("unrealized"), 2).alias("unrealized")).select(F.coalesce(C("symbol").cast("string"), F.lit("TOTAL")).alias("symbol"), "unrealized")
)
add("f24_dd_velocity", f"WITH {SQL_BARS}, p AS (SELECT symbol, t, c, max(c) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak FROM bars), k AS (SELECT *, 100 * (c - peak) / peak AS dd FROM p) SELECT symbol, t, round(dd, 6) AS dd_pct, round((dd - lag(dd, 5) OVER (PARTITION BY symbol ORDER BY t)) / 5, 6) AS velocity FROM k")(
    lambda s, d: hour_bars(s, d).withColumn("peak", F.max("c").over(W.ordered().rowsBetween(Window.unboundedPreceding, 0))).withColumn("dd", 100 * (C("c") - C("peak")) / C("peak")).select("symbol", "t", F.round("dd", 6).alias("dd_pct"), F.round((C("dd") - F.lag("dd", 5).over(W.ordered())) / 5, 6).alias("velocity"))
)
add("f28_dedup_pairs", f"WITH {SQL_ORDERS}, p AS (SELECT cust % 60 AS a, order_id % 60 AS b, notional AS score, order_id FROM ord) SELECT least(a, b) AS a, greatest(a, b) AS b, score FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY score DESC, order_id) AS r FROM p) WHERE r = 1")(
    lambda s, d: T.first_of(orders(s, d).select(F.least(C("cust") % 60, C("order_id") % 60).alias("a"), F.greatest(C("cust") % 60, C("order_id") % 60).alias("b"), C("notional").alias("score"), (-C("notional")).alias("k"), "order_id"), ["a", "b"], ["k", "order_id"]).select("a", "b", "score")
)
_EV = {"view": "NEW", "click": "ACK", "purchase": "FILLED", "error": "REJECTED"}
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EV.items())
_NEXT = (
    "(s = '' AND x = 'NEW' OR s = 'NEW' AND x IN ('ACK', 'REJECTED') OR s = 'ACK' AND x IN ('PARTIAL', 'FILLED', 'CANCELED', 'REJECTED') "
    "OR s = 'PARTIAL' AND x IN ('PARTIAL', 'FILLED', 'CANCELED', 'REJECTED'))"
)
add(
    "f29_transitions",
    f"WITH a AS (SELECT event_id AS id, user_id, epoch_us(ts) AS us, CASE event_type {_CASES} ELSE 'PARTIAL' END AS x FROM events), "
    "b AS (SELECT *, coalesce(list(x) OVER (PARTITION BY user_id ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS v FROM a), "
    f"c AS (SELECT id, x, list_reduce(list_prepend('', v), lambda s, x: CASE WHEN {_NEXT} THEN x ELSE s END) AS s FROM b) "
    "SELECT id, x AS state, CASE WHEN s = x THEN 'repeat' WHEN s IN ('FILLED', 'CANCELED', 'REJECTED') THEN 'ignored' "
    f"WHEN {_NEXT} THEN 'applied' ELSE 'invalid' END AS outcome FROM c",
)(
    lambda s, d: L.validate_transitions(
        _read(s, d, "events").select(
            C("event_id").alias("id"), "user_id", "ts",
            F.coalesce(*[F.when(C("event_type") == k, v) for k, v in _EV.items()], F.lit("PARTIAL")).alias("state"),
        ),
        ["user_id"], ["ts", "id"],
    ).select("id", "state", "outcome")
)
#: Messages by remainder, to be classed.
_MESSAGES = ["Rate limit hit", "HTTP 429", "Insufficient funds", "blocked by RISK", "trading symbol gone", "dns failure", "corporate action", "limit price 5"]
_CLASS = " ".join(f"WHEN regexp_matches(lower(m), '{p}') THEN '{c}'" for c, p in T.ERRORS.items())
add(
    "b12_error_codes",
    f"WITH x AS (SELECT event_id AS id, {_MESSAGES!r}[CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 8 + 1] AS m FROM events) "
    f"SELECT id, m AS message, CASE {_CLASS} ELSE 'REJECT_OTHER' END AS code FROM x",
)(
    lambda s, d: ticks(s, d).select("id", F.get(F.array(*map(F.lit, _MESSAGES)), (C("vol") % 8).cast("int")).alias("message"))
    .withColumn("code", T.error_code(C("message")))
)
add("h9_costs", f"WITH {SQL_FILLS} SELECT symbol, order_id, l_linenumber, l_partkey, t, round(qty * price * 2 / 1e4 + qty * price * 0.0003 + 20, 6) AS cost FROM fills")(lambda s, d: fills(s, d).select("symbol", "order_id", "l_linenumber", "l_partkey", "t", F.round(L.cost_bps(C("qty") * C("price"), 2, 0.0003, 20), 6).alias("cost")))
add("h14_size_legs", f"WITH {SQL_SPREAD}, q AS (SELECT sz.symbol, sz.t, sz.beta, al.x, al.y FROM sz JOIN al ON al.t = sz.t AND al.symbol = sz.symbol WHERE beta IS NOT NULL) SELECT symbol, t, CAST(greatest(1, floor(1000 / (y + abs(beta) * x))) AS BIGINT) AS qty_a, CAST(greatest(1, floor(1000 / (y + abs(beta) * x) * abs(beta))) AS BIGINT) AS qty_b FROM q")(
    lambda s, d: (lambda q: q.select("symbol", "t", *[v.alias(n) for n, v in zip(("qty_a", "qty_b"), L.size_legs(C("y"), C("x"), C("beta"), 1000.0))]))(_spread(s, d).where("beta is not null").select("symbol", "t", "beta").join(_aligned(s, d), ["symbol", "t"]))
)


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Samples of every metric that a rule looks at, by symbol and hour: counters of bars' trades, gauges of their closes."""
    bars = hour_bars(spark, d)
    so_far = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.sum(c).over(so_far).cast("double")
    values = {
        "risk_orders_rejected_total": count(C("n_trades") * 90000), "exec_orders_filled_total": count(F.when(C("n_trades") > 2, 1).otherwise(0)),
        "orders_emitted_total": count(F.when(C("n_trades") > 1, 1).otherwise(0)), "oms_reject_rate_24h": C("n_trades") / 40.0,
        "oms_time_to_complete_p95_seconds": C("c") / 10, "risk_dd_velocity_pct_per_min": F.when(C("n_trades") > 1, C("l") - C("h")),
    }
    wide = bars.select(C("symbol").alias("label"), "t", *[v.alias(m) for m, v in values.items()])
    return wide.unpivot(["label", "t"], list(values), "metric", "value")


SQL_METRICS = (
    f"{SQL_BARS}, w6 AS (SELECT symbol AS label, t, sum(n_trades) OVER w * 90000 AS rejected, sum(CASE WHEN n_trades > 2 THEN 1 ELSE 0 END) OVER w AS filled, "
    "sum(CASE WHEN n_trades > 1 THEN 1 ELSE 0 END) OVER w AS emitted, n_trades / 40.0 AS rate, c / 10 AS p95, CASE WHEN n_trades > 1 THEN l - h END AS velocity "
    "FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING))"
)


def _sql_rise(counter: str, seconds: int) -> str:
    return f"{counter} - min({counter}) OVER (PARTITION BY label ORDER BY t RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"


def _sql_alerts(times: int) -> str:
    """Every rule ``times`` slower, in SQL of its own: a stretch of bad samples is numbered by the good ones before it."""
    looks = [
        ("RiskRejectedSpike", f"({_sql_rise('rejected', 300 * times)}) / {300.0 * times}", "v > 5", 120), ("ExecNoFills", _sql_rise("filled", 900 * times), "v = 0", 900),
        ("OrdersZero", _sql_rise("emitted", 600 * times), "v = 0", 600), ("HighRejectRate", "rate", "v > 0.05", 180),
        ("OrderLatencyP95High", "p95", "v > 5", 120), ("DrawdownVelocitySpike", "velocity", "v < -0.5", 120),
    ]
    each = []
    for name, value, bad, hold in looks:
        each.append(
            f"SELECT '{name}' AS alert, label, t, v AS value, CASE WHEN bad THEN min(CASE WHEN bad THEN t END) OVER (PARTITION BY label, stretch) END AS since, "
            f"{hold * times} AS hold FROM (SELECT *, count(*) FILTER (NOT bad) OVER (PARTITION BY label ORDER BY t ROWS UNBOUNDED PRECEDING) AS stretch "
            f"FROM (SELECT *, {bad} AS bad FROM (SELECT label, t, CAST({value} AS DOUBLE) AS v FROM w6) WHERE v IS NOT NULL))"
        )
    return f"WITH {SQL_METRICS} SELECT alert, label, t, round(value, 6) AS value, since, coalesce(t - since >= hold, false) AS firing FROM ({' UNION ALL '.join(each)})"


add("e20_rules", _sql_alerts(60))(lambda s, d: A.alerts(metrics(s, d), [r.slower(60) for r in A.RULES]).withColumn("value", F.round("value", 6)))
