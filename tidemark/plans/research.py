"""Grid, pair research, selection, sizing and history queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as S
from ..operators import bars as B
from ..operators import cointegration as CI
from ..operators import grids as G
from ..operators import pairs as P
from ..operators import risk as R
from ..operators import tables as T
from ..streaming import states as ST
from .catalog import DAY, LEAST_OVERLAP, SQL_ALIGN, SQL_BARS, SQL_CROSS, SQL_FILLS, SQL_ORDERS, SQL_RESULTS, SQL_TICKS, SQL_VENDOR, _aligned, _read, add, fills, hour_bars, orders, results, rounded, ticks, vendor
from .signals import SQL_THREE, SQL_TRADES, _spread, _three

C = F.col

# Metrics of results, in expressions that both dialects read alike.
METRICS = {
    "R": "CASE WHEN (symbol + timeframe) % 3 <> 0 THEN pnl_total / 100e0 END",
    "sharpe": "CASE WHEN symbol % 4 <> 0 THEN (symbol % 13 - 5) / 4e0 END",
    "sortino": "CASE WHEN symbol % 6 <> 0 THEN (symbol % 11 - 3) / 3e0 END",
    "stability": "(symbol % 7) / 7e0",
    "ulcer": "(symbol % 9) / 2e0",
    "turnover": "(symbol % 5) * 1e0",
    "avg_hold_min": "(n_trades % 50) * 2e0",
    "latency_ms": "(symbol % 21) * 10e0",
    "penalties": "(symbol % 2) * 1e0",
    "age_days": "(symbol % 40) * 1e0",
    "params": "CASE WHEN symbol % 3 = 0 THEN 'a' WHEN symbol % 3 = 1 THEN 'b' ELSE 'c' END",
}
SQL_METRICS = f"{SQL_RESULTS}, met AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in METRICS.items())} FROM res)"
RUN = ["symbol", "strategy", "timeframe"]


def metrics(s: SparkSession, d: str) -> DataFrame:
    return results(s, d).select("*", *[F.expr(e).alias(n) for n, e in METRICS.items()])


def _long() -> str:
    of = {"ret": "coalesce(R, pnl_total)", "max_dd": "abs(max_dd)"}
    return " UNION ALL ".join(f"SELECT symbol, strategy, timeframe, '{n}' AS name, {of.get(n, n)} AS v, {w * sign}::DOUBLE AS w FROM met" for n, (w, sign) in G.WEIGHTS.items())


_P = "PARTITION BY strategy, timeframe, name"
SQL_SCORED = (
    f"{SQL_METRICS}, lg AS ({_long()}), c AS (SELECT *, count(v) OVER ({_P}) AS n, row_number() OVER ({_P} ORDER BY v ASC NULLS LAST) - 1 AS r FROM lg), "
    "b AS (SELECT *, n * 2 // 100 AS lo, greatest(n * 2 // 100, n * 98 // 100 - 1) AS hi FROM c), "
    f"w AS (SELECT * REPLACE (w AS w), min(CASE WHEN r = lo THEN v END) OVER ({_P}) AS vl, min(CASE WHEN r = hi THEN v END) OVER ({_P}) AS vh FROM b), "
    "s AS (SELECT strategy, timeframe, name, median(CASE WHEN v IS NOT NULL THEN least(greatest(v, vl), vh) END) AS m, "
    "stddev_pop(CASE WHEN v IS NOT NULL THEN least(greatest(v, vl), vh) END) AS sd FROM w GROUP BY 1, 2, 3), "
    "z AS (SELECT symbol, strategy, timeframe, sum(w.w * CASE WHEN n = 0 THEN 0.0 WHEN v IS NULL THEN -0.1 "
    "ELSE (v - m) / (CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END) END) AS z FROM w JOIN s USING (strategy, timeframe, name) GROUP BY 1, 2, 3), "
    "sc AS (SELECT met.*, round((z - CASE WHEN coalesce(R, pnl_total) < 0 THEN 2 ELSE 0 END) * exp(-ln(2) * age_days / 120), 6) AS score "
    "FROM met JOIN z USING (symbol, strategy, timeframe))"
)


def scored(s: SparkSession, d: str) -> DataFrame:
    return rounded(G.score(metrics(s, d), RUN, ["strategy", "timeframe"], 120.0), "score")


add("f27_score", f"WITH {SQL_SCORED} SELECT symbol, strategy, timeframe, score FROM sc")(lambda s, d: scored(s, d).select(*RUN, "score"))
add(
    "h20_select_configs",
    f"WITH {SQL_SCORED}, g AS (SELECT strategy, timeframe, params, round(avg(score) + 1e-9, 4) AS score, count(*) AS n FROM sc GROUP BY 1, 2, 3) "
    "SELECT strategy, timeframe, params, score, n, rank::INT AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY strategy, timeframe ORDER BY score DESC, params) AS rank FROM g) WHERE rank <= 2",
)(lambda s, d: G.select_configs(scored(s, d), 2))
add(
    "h20_select_final",
    f"WITH {SQL_SCORED} SELECT symbol, strategy, timeframe, score, rank::INT AS rank FROM (SELECT *, row_number() OVER "
    "(PARTITION BY symbol ORDER BY score DESC, strategy, timeframe) AS rank FROM sc WHERE win_rate * 100 >= 60) WHERE rank <= 2",
)(lambda s, d: G.select_final(scored(s, d), 60, 2).select(*RUN, "score", "rank"))
SQL_PICKS = (
    f"{SQL_SCORED}, pk AS (SELECT symbol, symbol % 30 AS leg_x, timeframe * 7 % 30 AS leg_y, score, win_rate * 100 AS win_pct, "
    "pnl_total / n_trades AS profit, strategy FROM sc)"
)
add(
    "h19_select_pairs",
    f"WITH {SQL_PICKS}, g AS (SELECT *, row_number() OVER (PARTITION BY least(leg_x, leg_y), greatest(leg_x, leg_y) ORDER BY score DESC, symbol, leg_x, leg_y) AS r "
    "FROM pk WHERE win_pct >= 55 AND profit >= 0.5), h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, symbol, leg_x, leg_y) AS k FROM g WHERE r = 1) "
    "SELECT symbol, leg_x, leg_y, score FROM h WHERE k <= 2 ORDER BY score DESC, symbol, leg_x, leg_y LIMIT 40",
)(
    lambda s, d: G.select_pairs(
        scored(s, d).select(
            "symbol", (C("symbol") % 30).alias("leg_x"), (C("timeframe") * 7 % 30).cast("long").alias("leg_y"), "score",
            (C("win_rate") * 100).alias("win_pct"), (C("pnl_total") / C("n_trades")).alias("profit"),
        ),
        55, 0.5, 2, 40,
    ).select("symbol", "leg_x", "leg_y", "score")
)


# Grids: axes are values that occur in the results of a strategy and timeframe.
SQL_AXES = (
    f"{SQL_RESULTS}, ax AS (SELECT strategy, timeframe AS tf, list_sort(list(DISTINCT (n_trades % 4 + 3) * 1e0)) AS fast, "
    "list_sort(list(DISTINCT (symbol % 3 * 4 + 4) * 1e0)) AS slow, (max(symbol) % 9) * 1e0 AS won FROM res GROUP BY 1, 2), "
    "gr AS (SELECT strategy, tf, unnest(fast) AS fast, slow FROM ax), gd AS (SELECT strategy, tf, fast, unnest(slow) AS slow FROM gr)"
)


def axes(s: SparkSession, d: str) -> DataFrame:
    values = lambda e: F.array_sort(F.collect_set(F.expr(e)))
    return results(s, d).groupBy("strategy", C("timeframe").alias("tf")).agg(
        values("(n_trades % 4 + 3) * 1e0").alias("fast"), values("(symbol % 3 * 4 + 4) * 1e0").alias("slow"), (F.max("symbol") % 9 * F.lit(1.0)).alias("won")
    )


def grid_spec(s: SparkSession, d: str) -> DataFrame:
    return axes(s, d).select("strategy", "tf", F.explode(F.create_map(F.lit("fast"), "fast", F.lit("slow"), "slow")).alias("name", "values"))


def _named(grid: DataFrame) -> DataFrame:
    return grid.select("strategy", "tf", C("params")["fast"].alias("fast"), C("params")["slow"].alias("slow"))


add("h1_expand_grid", f"WITH {SQL_AXES} SELECT strategy, tf, fast, slow FROM gd")(lambda s, d: _named(G.expand_grid(grid_spec(s, d))))
add("h2_filter_grid", f"WITH {SQL_AXES} SELECT strategy, tf, fast, slow FROM gd WHERE fast < slow")(
    lambda s, d: _named(G.filter_grid(G.expand_grid(grid_spec(s, d)), "fast < slow", ["fast", "slow"]))
)
add("h3_variant_key", f"WITH {SQL_AXES} SELECT tf, strategy || '__fast=' || fast || '_slow=' || slow AS variant FROM gd")(
    lambda s, d: G.expand_grid(grid_spec(s, d)).select("tf", G.variant_key(C("strategy"), C("params")).alias("variant"))
)
add(
    "h5_refine_neighbors",
    f"WITH {SQL_AXES}, u AS (SELECT strategy, tf, won, unnest(fast) AS x, generate_subscripts(fast, 1) AS i FROM ax), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY strategy, tf ORDER BY abs(x - won), i) AS r FROM u) "
    "SELECT DISTINCT u.strategy, u.tf, 'fast' AS name, u.x AS value FROM u JOIN n ON n.r = 1 AND n.strategy = u.strategy AND n.tf = u.tf AND abs(n.i - u.i) <= 1",
)(lambda s, d: G.refine_neighbors(grid_spec(s, d), axes(s, d).select("strategy", "tf", F.lit("fast").alias("name"), C("won").alias("value"))))
add(
    "h6_refine_radius",
    f"WITH {SQL_AXES}, k AS (SELECT strategy, tf, 'fast' AS name, unnest(list_filter([greatest(floor(won * 0.75), 1), won, ceil(won * 1.25)], lambda x: x > 0)) AS value FROM ax "
    "UNION ALL SELECT strategy, tf, 'fast', unnest(fast) FROM ax UNION ALL SELECT strategy, tf, 'slow', unnest(slow) FROM ax) SELECT DISTINCT * FROM k",
)(lambda s, d: G.refine_radius(grid_spec(s, d), axes(s, d).select("strategy", "tf", F.lit("fast").alias("name"), C("won").alias("value"))))
add(
    "h21_rank_configs",
    f"WITH {SQL_RESULTS}, c AS (SELECT strategy || timeframe AS name, count(*) % 40 / 10e0 AS tp, max(symbol) % 15 / 10e0 AS sl, "
    "CASE WHEN timeframe % 2 = 0 THEN 1e0 END AS trail FROM res GROUP BY strategy, timeframe), x AS (SELECT *, CASE WHEN sl <> 0 THEN tp / sl END AS rr FROM c), "
    "y AS (SELECT name, tp, sl, trail, round(CASE WHEN tp BETWEEN 0.5 AND 1.5 THEN 1.5 ELSE greatest(0, 0.6 - 0.1 * least(abs(tp - 0.5), abs(tp - 1.5))) END "
    "- CASE WHEN tp < 0.1 OR tp > 3 THEN 1 ELSE 0 END + CASE WHEN sl BETWEEN 0.3 AND 1 THEN 1.2 ELSE greatest(0, 0.5 - 0.1 * least(abs(sl - 0.3), abs(sl - 1))) END "
    "- CASE WHEN sl < 0.1 OR sl > 3 THEN 1 ELSE 0 END + CASE WHEN rr IS NULL THEN 0 WHEN rr BETWEEN 1.2 AND 2 THEN 1.2 ELSE greatest(0, 0.5 - 0.1 * least(abs(rr - 1.2), abs(rr - 2))) END "
    "+ CASE WHEN trail IS NOT NULL THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM x) SELECT *, row_number() OVER (ORDER BY score DESC, name)::INT AS rank FROM y",
)(
    lambda s, d: G.rank_configs(
        results(s, d).groupBy("strategy", "timeframe").agg((F.count("*") % 40 / 10.0).alias("tp"), (F.max("symbol") % 15 / 10.0).alias("sl"))
        .select(F.concat("strategy", "timeframe").alias("name"), "tp", "sl", F.when(C("timeframe") % 2 == 0, 1.0).alias("trail"))
    )
)
#: Pairs of lengths that the grid of moving means holds.
CROSSES = [(3, 10), (5, 20), (8, 30)]
SQL_GRID_CROSS = (
    f"{SQL_BARS}, sm AS (SELECT symbol, t, c, row_number() OVER w AS n, sum(c) OVER w AS s FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)), "
    f"pg AS (SELECT unnest({[f for f, _ in CROSSES]}) AS f, unnest({[g for _, g in CROSSES]}) AS g), "
    "mv AS (SELECT sm.symbol || '|' || pg.f || '/' || pg.g AS symbol, sm.t, sm.c, CASE WHEN sm.n >= pg.f THEN round((sm.s - coalesce(a.s, 0)) / pg.f, 6) END AS fm, "
    "CASE WHEN sm.n >= pg.g THEN round((sm.s - coalesce(b.s, 0)) / pg.g, 6) END AS gm FROM sm CROSS JOIN pg LEFT JOIN sm a ON a.symbol = sm.symbol AND a.n = sm.n - pg.f "
    "LEFT JOIN sm b ON b.symbol = sm.symbol AND b.n = sm.n - pg.g), zn AS (SELECT *, CASE WHEN fm > gm THEN 1 WHEN fm < gm THEN -1 END AS zone FROM mv), "
    "pz AS (SELECT *, last_value(zone IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM zn), "
    "sig AS (SELECT symbol, t, c, CASE WHEN zone <> b AND zone > 0 THEN 'BUY' WHEN zone <> b THEN 'SELL' ELSE 'FLAT' END AS action FROM pz)"
)


def grid_signals(s: SparkSession, d: str) -> DataFrame:
    """Crossings of every combination, under names of symbol and variant."""
    grid = s.createDataFrame([(f"{f}/{g}", f, g) for f, g in CROSSES], "variant string, fast int, slow int")
    return G.crossings(hour_bars(s, d), grid).withColumn("symbol", F.concat("symbol", F.lit("|"), "variant")).drop("variant")


add(
    "h10_evaluate_grid",
    f"WITH {SQL_GRID_CROSS}{SQL_TRADES[len(SQL_CROSS):]} SELECT symbol, count(*) AS n_trades, count(*) FILTER (pnl > 0) AS wins, round(sum(pnl), 4) AS pnl_total FROM tr GROUP BY 1",
)(
    lambda s, d: T.trade_stats(rounded(T.trades_from_signals(grid_signals(s, d), 1000.0), "pnl"))
    .select("symbol", "n_trades", "wins", F.round("pnl_total", 4).alias("pnl_total"))
)

# Pairs.
OFFSETS = {"entry": [-0.25, 0.0, 0.25], "leave": [-0.25, 0.0, 0.25], "stop": [-0.5, 0.0, 0.5]}
FLOORS = {"entry": 0.1, "leave": 0.1, "stop": 0.5}


def pair_thresholds(s: SparkSession, d: str) -> DataFrame:
    return _aligned(s, d).groupBy("symbol").agg(F.count("*").alias("n")).select("symbol", F.lit(1.5).alias("entry"), ((C("n") % 3) * 0.25).alias("leave"), F.lit(3.0).alias("stop"))


_fmt = lambda c: f"translate(CASE WHEN regexp_replace(printf('%.2f', {c}), '\\.?0+$', '') = '' THEN '0' ELSE regexp_replace(printf('%.2f', {c}), '\\.?0+$', '') END, '-.', 'mp')"
add(
    "h4_pair_grid",
    f"WITH {SQL_ALIGN}, b AS (SELECT symbol, 1.5e0 AS entry, count(*) % 3 * 0.25e0 AS leave, 3e0 AS stop FROM al GROUP BY 1), "
    "e AS (SELECT symbol, unnest([60, 120]) AS lookback, entry, leave, stop FROM b), "
    "x AS (SELECT symbol, lookback, unnest([entry - 0.25, entry, entry + 0.25]) AS entry, leave, stop FROM e), "
    "y AS (SELECT symbol, lookback, entry, unnest(list_distinct([round(greatest(0.1, leave - 0.25), 4), round(greatest(0.1, leave), 4), round(greatest(0.1, leave + 0.25), 4)])) AS leave, stop FROM x), "
    "z AS (SELECT symbol, lookback, entry, leave, unnest([stop - 0.5, stop, stop + 0.5]) AS stop FROM y) "
    f"SELECT *, 'lb' || lookback || '_ez' || {_fmt('entry')} || '_xz' || {_fmt('leave')} || '_sz' || {_fmt('stop')} AS variant FROM z",
)(lambda s, d: P.expand_pair_grid(pair_thresholds(s, d), OFFSETS, FLOORS, [60, 120]))


def pair_rows(s: SparkSession, d: str) -> DataFrame:
    """Spreads and scores with the prices they come from, once for each variant of thresholds."""
    rows = _spread(s, d).join(_aligned(s, d), ["symbol", "t"])
    grid = P.expand_pair_grid(pair_thresholds(s, d), OFFSETS, FLOORS, [60]).drop("lookback").withColumn("hold", F.lit(48 * 3600.0))
    return P.with_variants(rows, grid)


def _signals(s: SparkSession, d: str) -> DataFrame:
    return P.pair_signals(_spread(s, d), P.Thresholds(1.0, 0.25, 2.5, 48 * 3600.0, 1380))


# Arrivals of bars, some late: the order is not that of time.
_LATE = "us + (id % 5) * 1800000000"


def arrivals(s: SparkSession, d: str) -> DataFrame:
    """Prices of an hour's bars as they come in, for every two symbols."""
    names = ticks(s, d).agg(F.array_sort(F.collect_set("symbol")).alias("n"))
    pairs = names.select(F.explode("n").alias("a"), "n").select("a", F.explode("n").alias("b")).where("a < b").withColumn("pair", F.concat("a", F.lit("|"), "b"))
    bars = ticks(s, d).withColumn("us", F.unix_micros("ts")).withColumn("seq", F.expr(_LATE))
    return ST.fan_out(bars.select("symbol", (F.floor(C("us") / 3_600_000_000) * 3600).alias("t"), C("ltp").alias("px"), "seq", "id"), pairs)


_far = lambda c, leg: f"last_value(CASE WHEN leg = '{leg}' THEN {c} END IGNORE NULLS) OVER w"
add(
    "d16_sync_legs",
    f"WITH {SQL_TICKS}, nm AS (SELECT DISTINCT symbol AS s FROM ticks), pr AS (SELECT a.s AS a, b.s AS b FROM nm a JOIN nm b ON a.s < b.s), "
    f"ar AS (SELECT a || '|' || b AS symbol, CASE WHEN symbol = a THEN 'a' ELSE 'b' END AS leg, us // 3600000000 * 3600 AS t, ltp AS px, {_LATE} AS seq, id FROM ticks JOIN pr ON symbol IN (a, b)), "
    f"lt AS (SELECT *, {_far('t', 'a')} AS ta, {_far('px', 'a')} AS x, {_far('t', 'b')} AS tb, {_far('px', 'b')} AS y FROM ar WINDOW w AS (PARTITION BY symbol ORDER BY seq, id ROWS UNBOUNDED PRECEDING)), "
    "mt AS (SELECT *, CASE WHEN ta = tb THEN t END AS m FROM lt), "
    "ls AS (SELECT *, max(m) OVER (PARTITION BY symbol ORDER BY seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM mt) "
    "SELECT symbol, t, x, y FROM ls WHERE m IS NOT NULL AND (l IS NULL OR m > l)",
)(lambda s, d: ST.sync_legs(arrivals(s, d), ["seq", "id"]))
add("h15_coint_lags")(lambda s, d: CI.coint_lags(_aligned(s, d)))
add("d1_align_selected", f"WITH {SQL_ALIGN} SELECT symbol, t, x, y FROM al WHERE symbol IN (SELECT symbol FROM al GROUP BY 1 HAVING abs(round(corr(x, y), 6)) >= 0.02)")(
    lambda s, d: (lambda b: T.align_selected(b, T.pair_stats(b, LEAST_OVERLAP).where(F.abs(F.round("rho", 6)) >= 0.02)))(hour_bars(s, d))
)
add("h16_discover_lags")(lambda s, d: P.discover_pairs(_aligned(s, d), 0.0, 1.0, 100, test=CI.coint_lags))
_poly = lambda cs: " + ".join(f"({c}) * tau ** {k}" for k, c in enumerate(cs))
_u = f"(1 / (1 + {P.ERF_P} * abs(q) / sqrt(2)))"
_tail = "(" + " + ".join(f"({a}) * {_u} ** {k + 1}" for k, a in enumerate(P.ERF_A)) + ") * exp(-q * q / 2) / 2"
SQL_COINT = (
    f"{SQL_ALIGN}, ln AS (SELECT symbol, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM al GROUP BY 1), "
    "er AS (SELECT symbol, t, alpha, beta, y - alpha - beta * x AS e FROM al JOIN ln USING (symbol)), "
    "df AS (SELECT *, lag(e) OVER (PARTITION BY symbol ORDER BY t) AS p FROM er), "
    "gg AS (SELECT symbol, any_value(alpha) AS alpha, any_value(beta) AS beta, count(*) AS n, count(p) AS m, sum(p * (e - p)) AS pd, sum(p * p) AS pp, sum((e - p) * (e - p)) AS dd FROM df GROUP BY 1), "
    "ta AS (SELECT symbol, n, alpha, beta, pd / pp / sqrt(greatest(dd - pd / pp * pd, 0) / (m - 1) / pp) AS tau FROM gg), "
    f"qq AS (SELECT *, CASE WHEN tau <= {P.BORDER} THEN {_poly(P.SMALL)} ELSE {_poly(P.LARGE)} END AS q FROM ta), "
    f"co AS (SELECT symbol, n, alpha, beta, tau, CASE WHEN tau > {P.MOST} THEN 1.0 WHEN tau < {P.LEAST} THEN 0.0 WHEN q >= 0 THEN 1 - {_tail} ELSE {_tail} END::DOUBLE AS p FROM qq)"
)
add(
    "h15_coint",
    f"WITH {SQL_COINT} SELECT symbol, n, round(alpha, 5) AS alpha, round(beta, 6) AS beta, round(tau, 5) AS tau, round(p, 6) AS p FROM co",
)(lambda s, d: P.coint_test(_aligned(s, d)).select("symbol", "n", F.round("alpha", 5).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("tau", 5).alias("tau"), F.round("p", 6).alias("p")))
add(
    "h16_discover",
    f"WITH {SQL_COINT}, rh AS (SELECT symbol, corr(x, y) AS rho FROM al GROUP BY 1), lb AS (SELECT symbol, regr_slope(y, x) AS b FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS k FROM al) "
    "WHERE k <= 100 GROUP BY 1) SELECT symbol, n, round(rho, 6) AS rho, round(p, 6) AS p, round(b, 6) AS beta, round(abs(rho) * (1 - least(0.99, p)), 6) AS score "
    "FROM co JOIN rh USING (symbol) JOIN lb USING (symbol) WHERE abs(rho) >= 0.01 AND p <= 0.04",
)(lambda s, d: rounded(P.discover_pairs(_aligned(s, d), 0.01, 0.04, 100), "rho", "p", "beta", "score"))
add(
    "h17_scan",
    f"WITH {SQL_COINT}, bo AS (SELECT symbol, sum(x * y) / sum(x * x) AS b FROM al GROUP BY 1), sp AS (SELECT symbol, t, b, y - b * x AS s FROM al JOIN bo USING (symbol)), "
    "lg AS (SELECT *, lag(s) OVER (PARTITION BY symbol ORDER BY t) AS k FROM sp), hl AS (SELECT symbol, any_value(b) AS b, count(*) AS n, regr_slope(s - k, k) AS r, stddev_pop(s) AS sd FROM lg GROUP BY 1) "
    "SELECT hl.symbol, hl.n, round(p, 6) AS p, round(b, 6) AS beta, round(CASE WHEN r > -1 AND r <> 0 AND hl.n >= 30 THEN -ln(2) / ln(1 + r) END, 6) AS half_life, 0.0::DOUBLE AS z_mean, "
    "round(sd / (sd + 1e-9), 6) AS z_sd FROM hl JOIN co ON co.symbol = hl.symbol WHERE hl.n >= 100",
)(lambda s, d: rounded(P.scan_pairs(_aligned(s, d)), "p", "beta", "half_life", "z_sd"))
add(
    "h18_candidates",
    f"WITH {SQL_ALIGN}, s AS (SELECT symbol, x, y, x - y AS s, lag(x - y) OVER (PARTITION BY symbol ORDER BY t) AS p FROM al), g AS (SELECT symbol, corr(x, y) AS rho, "
    "sum(p * s) / sum(CASE WHEN p IS NOT NULL THEN p * p END) AS phi FROM s GROUP BY 1) SELECT symbol, round(rho, 6) AS rho, "
    "round(CASE WHEN phi > 0 AND phi < 1 THEN ln(0.5) / ln(phi) END, 6) AS half_life FROM g WHERE symbol NOT LIKE 'click|%'",
)(lambda s, d: rounded(P.pair_candidates(_aligned(s, d), _aligned(s, d).where("symbol like 'click|%'").select("symbol").distinct(), 10), "rho", "half_life"))
add(
    "d17_overrides",
    f"WITH {SQL_RESULTS}, st AS (SELECT strategy || symbol AS id, symbol, timeframe AS tf, pnl_total AS entry, win_rate AS leave FROM res), "
    "o1 AS (SELECT id, max(entry) + 1 AS entry, max(leave) AS leave FROM st WHERE symbol % 3 = 0 GROUP BY 1), "
    "o2 AS (SELECT symbol, tf, max(entry) - 1 AS entry, max(leave) AS leave FROM st WHERE symbol % 2 = 0 GROUP BY 1, 2) "
    "SELECT st.id, st.symbol, st.tf, coalesce(o1.entry, o2.entry, st.entry) AS entry, coalesce(o1.leave, o2.leave, st.leave) AS leave "
    "FROM st LEFT JOIN o1 ON o1.id = st.id LEFT JOIN o2 ON o2.symbol = st.symbol AND o2.tf = st.tf",
)(lambda s, d: _overridden(results(s, d).select(F.concat("strategy", "symbol").alias("id"), "symbol", C("timeframe").alias("tf"), C("pnl_total").alias("entry"), C("win_rate").alias("leave"))))


def _overridden(st: DataFrame) -> DataFrame:
    one = st.where("symbol % 3 = 0").groupBy("id").agg((F.max("entry") + 1).alias("entry"), F.max("leave").alias("leave"))
    two = st.where("symbol % 2 = 0").groupBy("symbol", "tf").agg((F.max("entry") - 1).alias("entry"), F.max("leave").alias("leave"))
    return P.apply_overrides(st, one.unionByName(two, allowMissingColumns=True), ["entry", "leave"])


SIDES = "SELECT symbol, t, any_value(side) AS side, {} AS strength FROM (SELECT *, CASE name WHEN 'sma' THEN 2 ELSE 1 END * coalesce(score, 1) AS w FROM w3) GROUP BY 1, 2 HAVING count(DISTINCT side) = 1 AND {}"
add("g19_votes", f"WITH {SQL_THREE} " + SIDES.format("least(1.0, count(*) / 3.0)::DOUBLE", "count(*) >= 2"))(lambda s, d: S.agree(_three(s, d), 3, "votes", k=2))
add("g19_weighted", f"WITH {SQL_THREE} " + SIDES.format("least(1.0, sum(w))::DOUBLE", "sum(w) >= 1.0"))(lambda s, d: S.agree(_three(s, d), 3, "weighted", weights={"sma": 2.0}, threshold=1.0))

# Money and orders.
_CASH = "c AS (SELECT c_custkey AS account, c_acctbal AS total FROM customer)"
add(
    "i3_budgets",
    f"WITH {_CASH}, x AS (SELECT account, greatest(CASE WHEN total > 0 THEN total ELSE 1000 END * 0.8, 0) AS tr FROM c), "
    "y AS (SELECT account, unnest(['LOW', 'MED', 'HIGH']) AS bucket, tr * unnest([0.5, 0.3, 0.2]) AS budget FROM x) "
    "SELECT account, bucket, round(budget, 4) AS budget, round(CASE WHEN bucket = 'HIGH' THEN 50 ELSE budget END, 4) AS max_per_trade FROM y",
)(
    lambda s, d: R.budgets(_read(s, d, "customer").select(C("c_custkey").alias("account"), C("c_acctbal").alias("total")), {"LOW": 0.5, "MED": 0.3, "HIGH": 0.2}, 0.2, {"HIGH": 50.0}, 1000.0)
    .select("account", "bucket", F.round("budget", 4).alias("budget"), F.round("max_per_trade", 4).alias("max_per_trade"))
)
add(
    "i4_deployable",
    f"WITH {SQL_ORDERS}, l AS (SELECT cust AS account, max(t) AS t, arg_max(notional, t) AS avail FROM (SELECT cust, t, max(notional) AS notional FROM ord GROUP BY 1, 2) GROUP BY 1), n AS (SELECT *, (SELECT max(t) FROM ord) AS now FROM l) "
    f"SELECT account, round(greatest(0, CASE WHEN now - t <= {60 * DAY} THEN avail * 5 * 0.8 ELSE 10000 * 5 * 0.8 END), 4)::DOUBLE AS deployable, now - t <= {60 * DAY} AS live FROM n",
)(
    lambda s, d: R.deployable(
        orders(s, d).groupBy(C("cust").alias("account"), "t").agg(F.max("notional").alias("avail")).crossJoin(F.broadcast(orders(s, d).agg(F.max("t").alias("now")))),
        C("now"), F.lit(10000.0), F.lit(5.0), 0.2, 0.8, 60 * DAY,
    ).withColumn("deployable", F.round("deployable", 4))
)
_F_KEY = ["symbol", "order_id", "l_linenumber", "l_partkey", "t"]
_FK = ", ".join(_F_KEY)
add(
    "i5_size_v1",
    f"WITH {SQL_FILLS}, x AS (SELECT *, least(qty * 10, 300, floor(200000 / greatest(price, 0.01))) AS sz, l_linenumber + 5 AS n_open FROM fills) SELECT {_FK}, "
    "CAST(CASE WHEN n_open < 11 AND sz >= 50 THEN sz ELSE 0 END AS BIGINT) AS sized, CASE WHEN n_open >= 11 THEN 'max_open_positions' WHEN sz < 50 THEN 'min_qty/notional' ELSE 'ok' END AS reason FROM x",
)(
    lambda s, d: R.size_orders_v1(fills(s, d).withColumn("qty", C("qty") * 10).withColumn("n_open", C("l_linenumber") + 5), 50, 300, 200000.0, 11).select(*_F_KEY, "sized", "reason")
)
_V2 = {"strategy": "CASE WHEN symbol % 2 = 0 THEN 'a' ELSE 'b' END", "leverage": "(l_linenumber % 4) * 1e0", "is_exit": "l_partkey % 11 = 0", "stop": "CASE WHEN l_linenumber % 3 = 0 THEN price * 0.98e0 END", "entry": "CASE WHEN l_linenumber % 2 = 0 THEN price END", "ref": "price + 1e0"}
add(
    "i6_size_v2",
    f"WITH {SQL_FILLS}, v AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _V2.items())} FROM fills), x AS (SELECT *, CASE WHEN leverage > 0 THEN leverage ELSE 1 END AS lev, coalesce(entry, ref) AS en FROM v), "
    "y AS (SELECT *, CASE WHEN stop IS NOT NULL THEN greatest(0, floor(100000 * CASE bucket WHEN 'A' THEN 2 ELSE 1 END / 100::DOUBLE * lev / greatest(en - stop, 0.05))) ELSE floor(CASE strategy WHEN 'a' THEN 50000 ELSE 0 END * lev / greatest(ref, 0.01)) END AS want, "
    "50000 * CASE bucket WHEN 'A' THEN 0.5 WHEN 'R' THEN 0.3 ELSE 0.0 END AS bud FROM x), z AS (SELECT *, CASE WHEN want * en / lev > bud THEN floor(bud * lev / greatest(en, 0.01)) ELSE want END AS cl FROM y), "
    f"q AS (SELECT {_FK}, CAST(CASE WHEN is_exit THEN qty ELSE greatest(0, least(cl, 10000)) END AS BIGINT) AS sized FROM z) SELECT *, CASE WHEN sized > 0 THEN 'APPROVED' ELSE 'REJECTED' END AS status FROM q",
)(
    lambda s, d: R.size_orders_v2(fills(s, d).select("*", *[F.expr(e).alias(n) for n, e in _V2.items()]), 100000.0, 50000.0, {"A": 0.5, "R": 0.3}, {"A": 2.0, "DEFAULT": 1.0}, {"a": 50000.0}, 10000)
    .select(*_F_KEY, "sized", "status")
)
add(
    "i10_reweight",
    "WITH c AS (SELECT c_custkey AS account, unnest(['LOW', 'MED', 'HIGH']) AS bucket, unnest([0.52e0, 0.31e0, 0.17e0]) AS split, unnest([c_custkey % 7, c_nationkey % 5, c_custkey % 3]) * -1e0 AS dd FROM customer), "
    "w AS (SELECT *, split * CASE WHEN dd <= -4 THEN 0.5 WHEN dd <= -2 THEN 0.75 ELSE 1 END AS w FROM c) SELECT account, bucket, round((w / sum(w) OVER (PARTITION BY account))::DOUBLE, 4) AS split FROM w",
)(
    lambda s, d: R.reweight(
        _read(s, d, "customer").select(
            C("c_custkey").alias("account"),
            F.explode(F.arrays_zip(F.array(*map(F.lit, R.BUCKETS)).alias("b"), F.array(*map(F.lit, [0.52, 0.31, 0.17])).alias("s"), F.array(*[(-x).cast("double") for x in (C("c_custkey") % 7, (C("c_nationkey") % 5).cast("long"), C("c_custkey") % 3)]).alias("d"))).alias("x"),
        ).select("account", C("x.b").alias("bucket"), C("x.s").alias("split"), C("x.d").alias("dd"))
    )
)
SQL_LAST = "nt AS (SELECT symbol, CAST(sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS BIGINT) AS net, max(t) AS t FROM fills GROUP BY 1), ls AS (SELECT symbol, arg_max(price, struct_pack(t := t, o := order_id, l := l_linenumber, p := l_partkey, q := qty, x := price)) AS c FROM fills GROUP BY 1)"
add(
    "i11_breaches",
    f"WITH {SQL_FILLS}, {SQL_LAST}, o AS (SELECT order_id, l_linenumber, l_partkey, symbol, side, t, CASE WHEN l_linenumber % 3 <> 0 THEN price * CASE side WHEN 'BUY' THEN 0.9e0 ELSE 1.1e0 END ELSE 0 END AS stop, price * CASE side WHEN 'BUY' THEN 1.2e0 ELSE 0.8e0 END AS target FROM fills), "
    "k AS (SELECT o.*, n.net, CASE WHEN stop > 0 AND (CASE WHEN side = 'BUY' THEN c <= stop ELSE c >= stop END) THEN 'STOP' WHEN CASE WHEN side = 'BUY' THEN c >= target ELSE c <= target END THEN 'TARGET' END AS kind FROM o JOIN nt n ON n.symbol = o.symbol AND n.net <> 0 JOIN ls ON ls.symbol = o.symbol) "
    "SELECT order_id || ':' || l_linenumber || ':' || l_partkey || ':' || t AS id, symbol, CASE WHEN side = 'BUY' THEN 'SELL' ELSE 'BUY' END AS side, abs(net) AS qty, kind FROM k WHERE kind IS NOT NULL",
)(lambda s, d: _breaches(fills(s, d)))


def _breaches(f: DataFrame) -> DataFrame:
    buy = C("side") == "BUY"
    level = lambda a, b: C("price") * F.when(buy, a).otherwise(b)
    asked = f.select(F.concat_ws(":", "order_id", "l_linenumber", "l_partkey", "t").alias("id"), "symbol", "side", F.when(C("l_linenumber") % 3 != 0, level(0.9, 1.1)).otherwise(0.0).alias("stop"), level(1.2, 0.8).alias("target"))
    last = f.groupBy("symbol").agg(F.max_by("price", F.struct("t", "order_id", "l_linenumber", "l_partkey", "qty", "price")).alias("c"))
    return R.breaches(asked, last, f)


add(
    "i12_flatten",
    f"WITH {SQL_FILLS}, {SQL_LAST} SELECT symbol, CASE WHEN net > 0 THEN 'SELL' ELSE 'BUY' END AS side, abs(net) AS qty FROM nt WHERE net <> 0 AND (t + symbol * 60 + 19800) % 86400 // 60 BETWEEN 330 AND 800",
)(lambda s, d: R.flatten_list(fills(s, d), C("t") + C("symbol") * 60, 330, 800))
_CANON = "'{\"client_order_id\":\"' || cid || '\",\"order_type\":\"MKT\",\"qty\":' || qty || ',\"risk_bucket\":\"' || bucket || '\",\"side\":\"' || side || '\",\"strategy\":\"UNKNOWN\",\"symbol\":\"' || symbol || '\",\"ts\":' || ts || '}'"
add(
    "i13_canonical_orders",
    f"WITH {SQL_FILLS}, x AS (SELECT (order_id % 997)::VARCHAR AS cid, t AS ts, symbol::VARCHAR AS symbol, side, qty, bucket FROM fills), h AS (SELECT *, sha256({_CANON}) AS audit_hash FROM x) "
    "SELECT cid AS client_order_id, ts, symbol, side, qty, 'MKT' AS order_type, 'UNKNOWN' AS strategy, bucket AS risk_bucket, audit_hash FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY ts, audit_hash) AS n FROM h) WHERE n = 1",
)(
    lambda s, d: R.canonical_orders(
        fills(s, d).select(F.concat(F.lit(" "), (C("order_id") % 997).cast("string")).alias("client_order_id"), C("t").alias("ts"), C("symbol").cast("string").alias("symbol"), F.lower("side").alias("side"), "qty", F.lit("mkt").alias("order_type"), F.lit("").alias("strategy"), F.lower("bucket").alias("risk_bucket"))
    )
)

# History.
NOW = 1705190400 + 50000
BAR = "symbol, t, o, h, l, c, vol"
_lo, _hi = R.lookback_bounds(NOW, 5)
add("b2_lookback", f"WITH {SQL_BARS} SELECT {BAR} FROM bars WHERE t >= {_lo} AND t < {_hi}")(lambda s, d: hour_bars(s, d).where(C("t").between(_lo, _hi - 1)).select(*BAR.split(", ")))
_DAY = (NOW + 19800) // DAY
_IN = f"(t + 19800) // {DAY} = {_DAY} AND (t + 19800) % {DAY} // 60 BETWEEN 555 AND 930"
add(
    "a14_merge_daily",
    f"WITH {SQL_VENDOR}, m AS (SELECT {BAR} FROM vendor WHERE {_IN}) SELECT {BAR} FROM m UNION ALL SELECT {BAR} FROM bars b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.symbol = b.symbol AND m.t = b.t)",
)(lambda s, d: R.merge_daily(hour_bars(s, d).select(*BAR.split(", ")), vendor(hour_bars(s, d)), _DAY))
add(
    "a15_union_chunks",
    f"WITH {SQL_VENDOR} SELECT {BAR} FROM bars WHERE t < 1705190400 UNION ALL SELECT {BAR} FROM vendor WHERE t >= 1705190400",
)(
    lambda s, d: (lambda b: R.union_chunks([b.where("t < 1705190400"), vendor(b).where("t >= 1705190400 - 86400 and t >= 1705190400"), vendor(b).where("t >= 1705276800")], ["symbol", "t"]).select(*BAR.split(", ")))(B.tick_bars(ticks(s, d), 3600))
)
add(
    "a12_export_selections",
    f"WITH {SQL_SCORED}, k AS (SELECT *, CASE WHEN abs(max_dd) <= 1000 THEN 'LOW' WHEN abs(max_dd) <= 3000 THEN 'MED' ELSE 'HIGH' END AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, strategy, timeframe) AS rank FROM sc WHERE win_rate * 100 >= 60) WHERE rank <= 2) "
    "SELECT symbol, strategy, timeframe, bucket, CASE bucket WHEN 'LOW' THEN 0.4 WHEN 'MED' THEN 0.35 ELSE 0.25 END::DOUBLE AS budget, round(score, 4) AS score, n_trades FROM k",
)(lambda s, d: _exported(scored(s, d)))


def _exported(rows: DataFrame) -> DataFrame:
    """The exported documents, read back."""
    picks = G.select_final(rows, 60, 2).withColumn("bucket", T.by_thresholds(C("max_dd"), [(1000, "LOW"), (3000, "MED")], "HIGH"))
    docs = G.export_selections(picks, {"LOW": 0.4, "MED": 0.35, "HIGH": 0.25}, ["score", "n_trades", "sharpe"])
    doc = F.from_json("doc", "timeframe int, bucket string, budget double, stats struct<score:double, n_trades:long>")
    return docs.select("symbol", "strategy", doc.alias("x")).select("symbol", "strategy", "x.timeframe", "x.bucket", "x.budget", "x.stats.score", "x.stats.n_trades")
