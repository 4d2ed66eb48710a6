"""Signal, pair and recursion queries with their SQL; recursions are folds over the list of values so far there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions import signals as S
from ..functions import windows as W
from ..operators import affine as A
from ..operators import tables as T
from .catalog import SQL_ALIGN, SQL_BARS, SQL_CROSS, W_, _aligned, _day, _if, _sma_cross, add, hour_bars, rounded

ACT = "CASE WHEN {0} > 0 THEN 'BUY' WHEN {0} < 0 THEN 'SELL' ELSE 'FLAT' END"
SO_FAR = "OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)"
SQL_V = f"{SQL_BARS}, v AS (SELECT *, list(c) {SO_FAR} AS v FROM bars)"
SQL_ATR = "CASE WHEN count(tr) {w} >= 14 THEN avg(tr) {w} END".format(w=W_.format(13))


def edges(z: str, keys: str = "symbol") -> str:
    """SQL of with_signal over CTEs that end in z(symbol, t, zone)."""
    before = f"last_value(zone IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"WITH {z}, p AS (SELECT *, {before} AS b FROM z) SELECT symbol, t, CASE WHEN zone <> b THEN {ACT.format('zone')} ELSE 'FLAT' END AS action, {ACT.format('zone')} AS state FROM p"


def band(x: str, low: str, high: str, way: int = 1) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {low} IS NOT NULL AND {high} IS NOT NULL THEN CASE WHEN {x} > {high} THEN {way} WHEN {x} < {low} THEN {-way} ELSE 0 END END"


def ema(n: int, v: str = "v", skip: int | None = None) -> str:
    """Seeded with the mean of n values, going on after ``skip`` of them (n if not given)."""
    return f"CASE WHEN len({v}) >= {n} THEN list_reduce(list_prepend(list_avg({v}[1:{n}]), {v}[{(n if skip is None else skip) + 1}:]), lambda a, x: a + (x - a) * (2::DOUBLE / {n + 1})) END"


def ema_first(n: int) -> str:
    return f"list_reduce(v, lambda a, x: a + (x - a) * (2::DOUBLE / {n + 1}))"


SQL_RSI = f"{SQL_BARS}, x AS (SELECT *, c - lag(c) OVER (PARTITION BY symbol ORDER BY t) AS dd FROM bars), y AS (SELECT *, sum(greatest(dd, 0)) {W_.format(13)} AS g, sum(greatest(-dd, 0)) {W_.format(13)} AS k, count(dd) {W_.format(13)} AS n FROM x), r AS (SELECT *, round(CASE WHEN n >= 14 THEN CASE WHEN k = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / k) END END, 6) AS rsi FROM y)"
SQL_BB = f"{SQL_BARS}, x AS (SELECT *, avg(c) {W_.format(19)} AS m, stddev_pop(c) {W_.format(19)} AS s, count(*) {W_.format(19)} AS n FROM bars), y AS (SELECT *, round(CASE WHEN n >= 20 THEN m - 2 * s END, 6) AS lo, round(CASE WHEN n >= 20 THEN m + 2 * s END, 6) AS hi FROM x)"
SQL_CCI = f"{SQL_BARS}, x AS (SELECT symbol, t, (h + l + c) / 3 AS tp, avg((h + l + c) / 3) {W_.format(19)} AS m, list((h + l + c) / 3) {W_.format(19)} AS v FROM bars), y AS (SELECT *, list_sum(list_transform(v, lambda q: abs(q - m))) / 20 AS mad FROM x), q AS (SELECT symbol, t, round(CASE WHEN len(v) >= 20 AND mad > 0 THEN (tp - m) / (0.015 * mad) END, 6) AS cci FROM y)"


def with_(s: SparkSession, d: str, **named) -> DataFrame:
    return hour_bars(s, d).select("*", *[F.round(v, 6).alias(n) for n, v in named.items()])


def _rsi_zone() -> Column:
    return F.when(F.col("rsi") <= 30, 1).when(F.col("rsi") >= 70, -1).when(F.col("rsi").isNotNull(), 0)


def _bands(s: SparkSession, d: str) -> DataFrame:
    lo, _, hi = W.bollinger(F.col("c"), 20, 2.0)
    return with_(s, d, lo=lo, hi=hi)


C, LO, HI = F.col, "lo", "hi"
RSI_ZONE = "z AS (SELECT symbol, t, CASE WHEN rsi <= 30 THEN 1 WHEN rsi >= 70 THEN -1 WHEN rsi IS NOT NULL THEN 0 END AS zone FROM r)"
add("g4_rsi_reversion", edges(f"{SQL_RSI}, {RSI_ZONE}"))(lambda s, d: S.with_signal(with_(s, d, rsi=W.rsi(C("c"), 14)), _rsi_zone()))
add("g5_bollinger_breakout", edges(f"{SQL_BB}, z AS (SELECT symbol, t, {band('c', LO, HI)} AS zone FROM y)"))(lambda s, d: S.with_signal(_bands(s, d), S.outside(C("c"), C(LO), C(HI))))
add("g6_bollinger_reversion", edges(f"{SQL_BB}, z AS (SELECT symbol, t, {band('c', LO, HI, -1)} AS zone FROM y)"))(lambda s, d: S.with_signal(_bands(s, d), S.outside(C("c"), C(LO), C(HI), False)))
add("g7_donchian_breakout", edges(f"{SQL_BARS}, y AS (SELECT *, {_if(20, 'min(l) ' + W_.format(19))} AS lo, {_if(20, 'max(h) ' + W_.format(19))} AS hi FROM bars), z AS (SELECT symbol, t, CASE WHEN c >= hi THEN 1 WHEN c <= lo THEN -1 WHEN hi IS NOT NULL THEN 0 END AS zone FROM y)"))(
    lambda s, d: S.with_signal(hour_bars(s, d).select("*", *[v.alias(n) for n, v in zip((LO, HI), W.donchian(C("h"), C("l"), 20))]), F.when(C("c") >= C(HI), 1).when(C("c") <= C(LO), -1).when(C(HI).isNotNull(), 0))
)
add("g11_cci_reversion", edges(f"{SQL_CCI}, z AS (SELECT symbol, t, {band('cci', '-100', '100', -1)} AS zone FROM q)"))(lambda s, d: S.with_signal(with_(s, d, cci=W.cci(C("h"), C("l"), C("c"), 20)), S.outside(C("cci"), F.lit(-100), F.lit(100), False)))
add("g12_momentum_roc", f"WITH {SQL_BARS}, x AS (SELECT symbol, t, round(c / lag(c, 12) OVER (PARTITION BY symbol ORDER BY t) - 1, 6) AS roc FROM bars), y AS (SELECT *, lag(roc) OVER (PARTITION BY symbol ORDER BY t) AS p FROM x) SELECT symbol, t, CASE WHEN p <= 0 AND roc > 0 THEN 'BUY' WHEN p >= 0 AND roc < 0 THEN 'SELL' ELSE 'FLAT' END AS action FROM y")(
    lambda s, d: with_(s, d, roc=W.roc(C("c"), 12)).withColumn("e", S.band_crossing(C("roc"), 0.0)).select("symbol", "t", S.act(C("e")).alias("action"))
)
SQL_Z = (
    f"{SQL_BARS}, x AS (SELECT *, avg(c) {W_.format(19)} AS m, stddev_pop(c) {W_.format(19)} AS s, count(*) {W_.format(19)} AS n FROM bars), "
    "y AS (SELECT symbol, t, round(CASE WHEN n >= 20 AND s > 0 THEN (c - m) / s END, 6) AS z FROM x)"
)
add(
    "g13_zscore_reversion",
    edges(f"{SQL_Z}, z AS (SELECT symbol, t, {band('z', '-1.5', '1.5', -1)} AS zone FROM y)"),
)(lambda s, d: S.with_signal(with_(s, d, z=W.zscore(C("c"), 20)), S.outside(C("z"), F.lit(-1.5), F.lit(1.5), False)))
add("g14_vwap_reversion", edges(f"{SQL_BARS}, x AS (SELECT *, {_day} AS day FROM bars), y AS (SELECT *, c - sum(c * greatest(vol, 1)) OVER w / sum(greatest(vol, 1)) OVER w AS dev FROM x WINDOW w AS (PARTITION BY symbol, day ORDER BY t ROWS UNBOUNDED PRECEDING)), q AS (SELECT *, round(CASE WHEN count(dev) OVER w >= 5 AND stddev_samp(dev) OVER w > 0 THEN dev / stddev_samp(dev) OVER w END, 6) AS dz FROM y WINDOW w AS (PARTITION BY symbol, day ORDER BY t ROWS UNBOUNDED PRECEDING)), z AS (SELECT symbol, t, day, {band('dz', '-1', '1', -1)} AS zone FROM q)", "symbol, day"))(
    lambda s, d: S.with_signal(W.with_session_vwap(hour_bars(s, d), least=5).withColumn("dz", F.round("dev_z", 6)), S.outside(C("dz"), F.lit(-1), F.lit(1), False), "symbol", "day")
)
SQL_ORB = (
    f"{SQL_BARS}, x AS (SELECT *, {_day} AS day, (t + 19800) % 86400 // 60 AS m FROM bars), "
    "y AS (SELECT symbol, t, c, day, CASE WHEN m >= 675 THEN max(CASE WHEN m >= 555 AND m < 675 THEN h END) OVER w END AS hi, "
    "CASE WHEN m >= 675 THEN min(CASE WHEN m >= 555 AND m < 675 THEN l END) OVER w END AS lo FROM x WINDOW w AS (PARTITION BY symbol, day))"
)
add(
    "f16_opening_range",
    f"WITH {SQL_ORB} SELECT symbol, t, hi AS or_high, lo AS or_low FROM y",
)(lambda s, d: W.with_opening_range(hour_bars(s, d), 120).select("symbol", "t", "or_high", "or_low"))
add(
    "g15_orb_breakout",
    f"WITH {SQL_ORB}, q AS (SELECT *, {band('c', LO, HI)} AS zone FROM y), "
    "k AS (SELECT *, min(CASE WHEN zone <> 0 THEN t END) OVER (PARTITION BY symbol, day) AS hit FROM q) "
    f"SELECT symbol, t, CASE WHEN t = hit THEN {ACT.format('zone')} ELSE 'FLAT' END AS action FROM k",
)(lambda s, d: S.opening_breakout(hour_bars(s, d), 120))

# Recursions.
add("f5_ema", f"WITH {SQL_V} SELECT symbol, t, round({ema_first(12)}, 6) AS ema FROM v")(lambda s, d: rounded(W.ema(hour_bars(s, d), 12), "ema"))
add(
    "f5_ema_seeded",
    f"WITH {SQL_V} SELECT symbol, t, round({ema(12)}, 6) AS ema, round({ema(12, skip=11)}, 6) AS ema_double FROM v",
)(
    lambda s, d: rounded(
        W.with_emas(W.with_emas(hour_bars(s, d).select("symbol", "t", "c"), {"ema": 12}, "sma"), {"ema_double": 12}, "sma_double").drop("c"),
        "ema", "ema_double",
    )
)


def two_emas(fast: int, slow: int) -> tuple[str, str]:
    """SQL of TwoEmas: both seeds meet the slower one's last value first."""
    return tuple(f"CASE WHEN len(v) >= {slow} THEN {ema(n, skip=slow - 1)} END" for n in (fast, slow))


_f, _s = two_emas(12, 26)
SQL_MACD = (
    f"{SQL_V}, x AS (SELECT symbol, t, {_f} - {_s} AS macd FROM v), y AS (SELECT *, list(macd) FILTER (macd IS NOT NULL) {SO_FAR} AS ls FROM x), "
    f"q AS (SELECT symbol, t, macd, CASE WHEN macd IS NOT NULL THEN {ema(9, 'ls')} END AS signal FROM y)"
)
add(
    "f6_macd",
    f"WITH {SQL_MACD} SELECT symbol, t, round(macd, 6) AS macd, round(signal, 6) AS signal, round(macd - signal, 6) AS hist FROM q",
)(lambda s, d: rounded(W.macd(hour_bars(s, d)), "macd", "signal", "hist"))
SQL_FOLD = "list_reduce(list_prepend(list_avg({0}[1:14]), {0}[15:]), lambda a, x: (a * 13 + x) / 14)"
add("f3_rsi_wilder", f"WITH {SQL_BARS}, x AS (SELECT *, c - lag(c) OVER (PARTITION BY symbol ORDER BY t) AS dd FROM bars), y AS (SELECT *, list(greatest(dd, 0)) FILTER (dd IS NOT NULL) {SO_FAR} AS g, list(greatest(-dd, 0)) FILTER (dd IS NOT NULL) {SO_FAR} AS k FROM x), f AS (SELECT *, CASE WHEN len(g) >= 14 THEN {SQL_FOLD.format('g')} END AS up, CASE WHEN len(k) >= 14 THEN {SQL_FOLD.format('k')} END AS down FROM y) SELECT symbol, t, round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 6) AS rsi FROM f")(lambda s, d: rounded(W.rsi_wilder(hour_bars(s, d)), "rsi"))
SQL_HA = f"{SQL_BARS}, x AS (SELECT *, (o + h + l + c) / 4 AS hc, first(o) {SO_FAR} AS o0 FROM bars), y AS (SELECT *, list_prepend(o0, coalesce(list(hc) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS v FROM x), q AS (SELECT symbol, t, round(list_reduce(v, lambda a, x: (a + x) / 2), 6) AS ho, round(hc, 6) AS hc FROM y)"
add("f11_heikin_ashi", f"WITH {SQL_HA} SELECT * FROM q")(lambda s, d: rounded(W.heikin_ashi(hour_bars(s, d)), "ho", "hc"))
# The same in stretches of a day, which are computed side by side.
add("f5_ema_stretches", f"WITH {SQL_V} SELECT symbol, t, round({ema_first(12)}, 6) AS ema FROM v")(lambda s, d: rounded(A.ema_in_stretches(hour_bars(s, d), 12, 86400), "ema"))
_four = lambda x: f"floor({x} * 10000 + 0.5000001) / 10000"  # noqa: E731  sums in another order must not fall to either side of a tie
SQL_HA4 = SQL_HA.replace("round(list_reduce(v, lambda a, x: (a + x) / 2), 6)", _four("list_reduce(v, lambda a, x: (a + x) / 2)")).replace("round(hc, 6)", _four("hc"))
add("f11_heikin_stretches", f"WITH {SQL_HA4} SELECT * FROM q")(
    lambda s, d: A.heikin_in_stretches(hour_bars(s, d), 86400).select("symbol", "t", *[(F.floor(C(c) * 10000 + 0.5000001) / 10000).alias(c) for c in ("ho", "hc")])
)
add("g10_heikin_trend", edges(f"{SQL_HA}, z AS (SELECT symbol, t, sign(hc - ho) AS zone FROM q)"))(lambda s, d: S.with_signal(rounded(W.heikin_ashi(hour_bars(s, d)), "ho", "hc"), F.signum(C("hc") - C("ho"))))
_f, _s = two_emas(12, 50)
add(
    "g2_ema_cross",
    edges(f"{SQL_V}, x AS (SELECT symbol, t, round({_f}, 6) - round({_s}, 6) AS df FROM v), z AS (SELECT symbol, t, sign(df) AS zone FROM x)"),
)(lambda s, d: S.with_signal(rounded(W.with_two_emas(hour_bars(s, d), 12, 50), "fast", "slow"), F.signum(C("fast") - C("slow"))))
add("g3_macd_signal", edges(f"{SQL_MACD}, z AS (SELECT symbol, t, sign(round(macd - signal, 6)) AS zone FROM q)"))(lambda s, d: S.with_signal(rounded(W.macd(hour_bars(s, d)), "hist"), F.signum("hist")))
SQL_KELT = f"{SQL_V}, x AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY t) AS p FROM v), y AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(h - l, abs(h - p), abs(l - p)) END AS tr FROM x), q AS (SELECT symbol, t, c, {ema(20)} AS mid, {SQL_ATR} AS atr FROM y), k AS (SELECT symbol, t, c, round(mid - 2 * atr, 6) AS lo, round(mid + 2 * atr, 6) AS hi FROM q)"
add("f9_keltner", f"WITH {SQL_KELT} SELECT symbol, t, lo AS lower, hi AS upper FROM k")(lambda s, d: rounded(S.keltner(hour_bars(s, d)).select("symbol", "t", "lower", "upper"), "lower", "upper"))
add("g8_keltner_breakout", edges(f"{SQL_KELT}, z AS (SELECT symbol, t, {band('c', LO, HI)} AS zone FROM k)"))(lambda s, d: S.with_signal(rounded(S.keltner(hour_bars(s, d)), "lower", "upper"), S.outside(C("c"), C("lower"), C("upper"))))
_up = "CASE WHEN s.c > s.up THEN x.up ELSE least(x.up, s.up) END"
_lo = "CASE WHEN s.c < s.lo THEN x.lo ELSE greatest(x.lo, s.lo) END"
_W10 = W_.format(9)
SQL_SUPER = (
    f"{SQL_BARS}, x AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY t) AS p FROM bars), "
    "y AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(h - l, abs(h - p), abs(l - p)) END AS tr FROM x), "
    f"a AS (SELECT *, CASE WHEN count(tr) {_W10} >= 10 THEN avg(tr) {_W10} END AS atr FROM y), "
    "b AS (SELECT *, (h + l) / 2 + 3 * atr AS up, (h + l) / 2 - 3 * atr AS lo FROM a), "
    "e AS (SELECT symbol, t, atr, list(struct_pack(c := c, up := up, lo := lo, "
    "tr := CASE WHEN c > up THEN 1 WHEN c < lo THEN -1 WHEN p > up THEN 1 WHEN p < lo THEN -1 ELSE 0 END)) "
    f"FILTER (atr IS NOT NULL) {SO_FAR} AS v FROM b), "
    f"st AS (SELECT symbol, t, CASE WHEN atr IS NOT NULL THEN list_reduce(v, lambda s, x: struct_pack(c := x.c, up := {_up}, lo := {_lo}, "
    f"tr := CASE WHEN x.c > {_up} THEN 1 WHEN x.c < {_lo} THEN -1 ELSE s.tr END)).tr::DOUBLE END AS trend FROM e)"
)
add("f10_supertrend", f"WITH {SQL_SUPER} SELECT symbol, t, trend FROM st")(lambda s, d: W.supertrend(hour_bars(s, d)))
add(
    "g9_supertrend",
    edges(f"{SQL_SUPER}, z AS (SELECT symbol, t, trend AS zone FROM st)"),
)(lambda s, d: S.with_signal(W.supertrend(hour_bars(s, d)), C("trend")))
SQL_ML = f"{SQL_V}, x AS (SELECT symbol, t, round(c / lag(c) OVER (PARTITION BY symbol ORDER BY t) - 1, 6) AS ret, round(c - {ema_first(20)}, 6) AS mom FROM v)"
add("f22_ml_features", f"WITH {SQL_ML} SELECT * FROM x")(lambda s, d: W.with_emas(hour_bars(s, d), {"e": 20}, "first").select("symbol", "t", F.round(W.roc(C("c"), 1), 6).alias("ret"), F.round(C("c") - C("e"), 6).alias("mom")))
add("g16_momentum", f"WITH {SQL_ML} SELECT symbol, t, {ACT.format('mom')} AS action FROM x")(lambda s, d: W.with_emas(hour_bars(s, d), {"e": 20}, "first").select("symbol", "t", S.act(F.round(C("c") - C("e"), 6)).alias("action")))
# A model a symbol, by least squares on the bar after, in two versions; one symbol has none.
SQL_MODEL = (
    f"{SQL_V}, x AS (SELECT symbol, t, c, coalesce(c / lag(c) OVER w - 1, 0) AS ret, c - {ema_first(20)} AS mom, lead(c) OVER w / c - 1 AS nxt FROM v WINDOW w AS (PARTITION BY symbol ORDER BY t)), "
    "md AS (SELECT symbol, round(regr_slope(nxt, ret), 6) AS a, round(regr_slope(nxt, mom), 6) AS b, round(avg(nxt), 6) AS k FROM x WHERE symbol <> 'click' GROUP BY 1), "
    "sc AS (SELECT x.symbol, t, mom, a, round(a * ret + b * mom + k, 6) AS score FROM x LEFT JOIN md ON md.symbol = x.symbol)"
)


def bar_models(s: SparkSession, d: str) -> DataFrame:
    """models(model, version, kind, payload) fitted on the bars."""
    x = M.momentum_features(hour_bars(s, d)).withColumn("nxt", F.lead("c").over(W.ordered()) / C("c") - 1).where("symbol <> 'click'")
    g = x.groupBy("symbol").agg(F.round(F.regr_slope("nxt", "ret"), 6).alias("a"), F.round(F.regr_slope("nxt", "mom"), 6).alias("b"), F.round(F.avg("nxt"), 6).alias("k"))
    payload = lambda a, b, k: F.to_json(F.struct(F.array(a, b).alias("weights"), k.alias("bias"))).cast("binary")
    each = F.explode(F.array(F.struct(F.lit(2).alias("version"), payload(C("a"), C("b"), C("k")).alias("payload")), F.struct(F.lit(1).alias("version"), payload(F.lit(-1.0), F.lit(0.0), F.lit(0.0)).alias("payload"))))
    return g.select(C("symbol").alias("model"), each.alias("x")).select("model", "x.version", F.lit("linear").alias("kind"), "x.payload")


add(
    "g16_model_score",
    f"WITH {SQL_MODEL}, y AS (SELECT *, CASE WHEN a IS NULL THEN mom ELSE score END AS sg, CASE WHEN a IS NULL THEN 'ml_fallback_' ELSE 'ml_' END AS word FROM sc) "
    f"SELECT symbol, t, score, {ACT.format('sg')} AS action, CASE WHEN sg > 0 THEN word || 'up' WHEN sg < 0 THEN word || 'down' END AS reason FROM y",
)(lambda s, d: rounded(M.model_signals(hour_bars(s, d), bar_models(s, d), C("symbol")), "score"))
add("g21_features", f"WITH {SQL_RSI}, p AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY t) AS pc FROM r), k AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr FROM p), f AS (SELECT symbol, t, round({_if(20, 'avg(c) ' + W_.format(19))}, 6) AS sma, rsi, round({SQL_ATR}, 6) AS atr FROM k) SELECT *, sma IS NOT NULL AND rsi IS NOT NULL AND atr IS NOT NULL AS ready FROM f")(
    lambda s, d: W.with_atr(hour_bars(s, d), 14).select("symbol", "t", F.round(W.sma(C("c"), 20), 6).alias("sma"), F.round(W.rsi(C("c"), 14), 6).alias("rsi"), F.round("atr", 6).alias("atr")).withColumn("ready", C("sma").isNotNull() & C("rsi").isNotNull() & C("atr").isNotNull())
)


def _three(s: SparkSession, d: str) -> DataFrame:
    """Signals of three names, scored by the name's share of the close."""
    a = _sma_cross(s, d).select("symbol", "t", F.lit("sma").alias("name"), C("action").alias("side"))
    b = S.with_signal(with_(s, d, rsi=W.rsi(C("c"), 14)), _rsi_zone()).select("symbol", "t", F.lit("rsi").alias("name"), C("state").alias("side"))
    c = S.with_signal(_bands(s, d), S.outside(C("c"), C(LO), C(HI), False)).select("symbol", "t", F.lit("bb").alias("name"), C("state").alias("side"))
    return a.unionByName(b).unionByName(c).withColumn("score", F.when(C("t") % 7200 == 0, 0.5))


SQL_THREE = (
    f"s3 AS (SELECT symbol, t, 'sma' AS name, action AS side FROM (WITH {SQL_CROSS} SELECT * FROM sig) UNION ALL SELECT symbol, t, 'rsi', state FROM ({edges(f'{SQL_RSI}, {RSI_ZONE}')}) "
    f"UNION ALL SELECT symbol, t, 'bb', state FROM ({edges(SQL_BB + ', z AS (SELECT symbol, t, ' + band('c', LO, HI, -1) + ' AS zone FROM y)')})), w3 AS (SELECT *, CASE WHEN t % 7200 = 0 THEN 0.5 END AS score FROM s3 WHERE side <> 'FLAT'), "
    "v3 AS (SELECT symbol, t, sum(CASE WHEN side = 'BUY' THEN w ELSE 0 END) AS b, sum(CASE WHEN side = 'SELL' THEN w ELSE 0 END) AS s, count(*) FILTER (coalesce(score, 0) >= 0.5) AS n FROM (SELECT *, (CASE name WHEN 'sma' THEN 2 ELSE 1 END * coalesce(score, 1))::DOUBLE AS w FROM w3) GROUP BY 1, 2)"
)
for _mode, _where, _score in (("majority", "greatest(b, s) >= 0.5", "greatest(b, s)"), ("k_of_n", "n >= 2", "greatest(b, s)"), ("score_avg", "b + s >= 0.5", "greatest(b, s) / greatest(1, b + s)")):
    add(f"g18_combine_{_mode}", f"WITH {SQL_THREE} SELECT symbol, t, CASE WHEN b >= s THEN 'BUY' ELSE 'SELL' END AS side, round({_score}, 6) AS score FROM v3 WHERE {_where}")(lambda s, d, m=_mode: rounded(S.combine(_three(s, d), {"sma": 2.0}, m, 2, 0.5), "score"))
add("g22_order_intents", f"WITH {SQL_CROSS} SELECT concat_ws(':', t, symbol, 'sma', action) AS client_id, symbol, t, action, CAST(floor(1000 / c) AS BIGINT) AS qty FROM sig WHERE action <> 'FLAT' AND floor(1000 / c) > 0")(
    lambda s, d: _sma_cross(s, d).where("action <> 'FLAT'").select(F.concat_ws(":", "t", "symbol", F.lit("sma"), "action").alias("client_id"), "symbol", "t", "action", F.floor(1000 / C("c")).alias("qty")).where("qty > 0")
)

# Four readings of a bar; the signal mean in SQL is a fold over the lines so far.
SQL_VOTES = (
    f"{SQL_V}, x AS (SELECT *, c - lag(c) OVER (PARTITION BY symbol ORDER BY t) AS dd, {ema_first(12)} - {ema_first(26)} AS line, {ema_first(20)} AS e, "
    "lag(c, 12) OVER (PARTITION BY symbol ORDER BY t) AS c12 FROM v), "
    f"y AS (SELECT *, list(greatest(dd, 0)) FILTER (dd IS NOT NULL) {SO_FAR} AS g, list(greatest(-dd, 0)) FILTER (dd IS NOT NULL) {SO_FAR} AS k, "
    f"list(line) {SO_FAR} AS ls, lag(e) OVER (PARTITION BY symbol ORDER BY t) AS e0, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n FROM x), "
    f"f AS (SELECT *, CASE WHEN len(g) >= 14 THEN {SQL_FOLD.format('g')} END AS gain, CASE WHEN len(k) >= 14 THEN {SQL_FOLD.format('k')} END AS loss, "
    f"{ema(9, 'ls')} AS sig FROM y), "
    "r AS (SELECT *, CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi FROM f), "
    "vo AS (SELECT symbol, t, n, CAST(coalesce(rsi < 30, false) AS INT) + CAST(coalesce(e > e0, false) AS INT) + CAST(coalesce(line > sig, false) AS INT) + CAST(coalesce(c > c12, false) AS INT) AS up, "
    "CAST(coalesce(rsi > 70, false) AS INT) + CAST(coalesce(e < e0, false) AS INT) + CAST(coalesce(line < sig, false) AS INT) + CAST(coalesce(c < c12, false) AS INT) AS down FROM r)"
)
add(
    "g17_k_of_n",
    f"WITH {SQL_VOTES}, z AS (SELECT *, CASE WHEN n < 35 THEN 0 WHEN up >= 3 AND up > down THEN 1 WHEN down >= 3 AND down > up THEN -1 ELSE 0 END AS z, "
    "CASE WHEN n > 35 THEN lag(up) OVER (PARTITION BY symbol ORDER BY t) ELSE 0 END AS u0, CASE WHEN n > 35 THEN lag(down) OVER (PARTITION BY symbol ORDER BY t) ELSE 0 END AS d0 FROM vo) "
    f"SELECT symbol, t, up, down, {ACT.format('z')} AS state, CASE WHEN z > 0 AND u0 < 3 THEN 'BUY' WHEN z < 0 AND d0 < 3 THEN 'SELL' ELSE 'FLAT' END AS action, "
    "CASE WHEN z > 0 THEN up WHEN z < 0 THEN down ELSE 0 END / 4.0::DOUBLE AS confidence FROM z",
)(lambda s, d: S.k_of_n(W.with_votes(hour_bars(s, d)).select("symbol", "t", "up", "down")))

# Pairs.
P60 = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
SQL_SPREAD = f"{SQL_ALIGN}, be AS (SELECT *, CASE WHEN count(x) {P60} >= 10 AND var_pop(x) {P60} > 1e-12 THEN regr_slope(y, x) {P60} END AS beta FROM al), sp AS (SELECT *, y - beta * x AS spread FROM be), sz AS (SELECT symbol, t, round(beta, 6) AS beta, round(spread, 6) AS spread, round(CASE WHEN count(spread) {P60} >= 10 AND stddev_pop(spread) {P60} > 0 THEN (spread - avg(spread) {P60}) / stddev_pop(spread) {P60} END, 6) AS z FROM sp)"


def _spread(s: SparkSession, d: str) -> DataFrame:
    return rounded(S.spread_z(_aligned(s, d), 60), "beta", "spread", "z").select("symbol", "t", "beta", "spread", "z")


add("f19_pair_spread_z", f"WITH {SQL_SPREAD} SELECT * FROM sz")(_spread)
add("f20_half_life", f"WITH {SQL_SPREAD}, h AS (SELECT symbol, spread AS s, lag(spread) OVER (PARTITION BY symbol ORDER BY t) AS p FROM sz WHERE spread IS NOT NULL), g AS (SELECT symbol, count(*) AS n, regr_slope(s - p, p) AS b FROM h GROUP BY 1) SELECT symbol, n, round(CASE WHEN n >= 30 AND b > -1 AND b <> 0 THEN -ln(2) / ln(1 + b) END, 6) AS half_life FROM g")(lambda s, d: rounded(S.half_life(_spread(s, d)), "half_life"))
add("f21_scan_stats", f"WITH {SQL_SPREAD} SELECT symbol, count(z) AS n, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd FROM sz GROUP BY 1")(lambda s, d: _spread(s, d).groupBy("symbol").agg(F.count("z").alias("n"), F.round(F.avg("z"), 6).alias("mean"), F.round(F.stddev_pop("z"), 6).alias("sd")))

# Trades: the position in SQL is a counter that a fold keeps within -1..1.
SQL_TRADES = f"{SQL_CROSS}, a AS (SELECT *, CASE action WHEN 'BUY' THEN 1 ELSE -1 END AS a FROM sig WHERE action <> 'FLAT'), q AS (SELECT *, list_reduce(list_prepend(0, list(a) {SO_FAR}), lambda p, x: greatest(-1, least(1, p + x))) AS pos FROM a), w AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY t), 0) AS was FROM q), n AS (SELECT *, lead(t) OVER (PARTITION BY symbol ORDER BY t) AS t2, lead(c) OVER (PARTITION BY symbol ORDER BY t) AS c2 FROM w WHERE pos <> was), e AS (SELECT symbol, max(t) AS te, max_by(c, t) AS ce FROM sig GROUP BY 1), tr AS (SELECT n.symbol, t AS t_entry, c AS px_entry, CASE WHEN pos > 0 THEN 'LONG' ELSE 'SHORT' END AS side, CAST(floor(1000 / c) AS BIGINT) AS qty, coalesce(t2, te) AS t_exit, coalesce(c2, ce) AS px_exit, round(pos * floor(1000 / c) * (coalesce(c2, ce) - c), 6) AS pnl FROM n JOIN e ON n.symbol = e.symbol WHERE pos <> 0)"
add("h7_trades", f"WITH {SQL_TRADES} SELECT * FROM tr")(lambda s, d: rounded(T.trades_from_signals(_sma_cross(s, d), 1000.0), "pnl"))
add("f23_drawdown", f"WITH {SQL_TRADES}, k AS (SELECT symbol, t_exit, t_entry, sum(pnl) OVER (PARTITION BY symbol ORDER BY t_exit, t_entry ROWS UNBOUNDED PRECEDING) AS eq FROM tr) SELECT symbol, t_exit, t_entry, round(eq, 4) AS equity, round(eq - max(greatest(eq, 0)) OVER (PARTITION BY symbol ORDER BY t_exit, t_entry ROWS UNBOUNDED PRECEDING), 4) AS dd FROM k")(
    lambda s, d: T.running(rounded(T.trades_from_signals(_sma_cross(s, d), 1000.0), "pnl"), "pnl", ["symbol"], ["t_exit", "t_entry"], "eq").withColumn("t", C("t_exit")).select("symbol", "t_exit", "t_entry", F.round("eq", 4).alias("equity"), F.round(W.drawdown(C("eq")), 4).alias("dd"))
)
add("e12_trade_stats", f"WITH {SQL_TRADES}, k AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY t_exit, t_entry ROWS UNBOUNDED PRECEDING) AS eq FROM tr), dd AS (SELECT *, eq - max(greatest(eq, 0)) OVER (PARTITION BY symbol ORDER BY t_exit, t_entry ROWS UNBOUNDED PRECEDING) AS dd FROM k) SELECT symbol, count(*) AS n_trades, count(*) FILTER (pnl > 0) AS wins, round(100.0 * count(*) FILTER (pnl > 0) / count(*), 4) AS win_rate, round(sum(pnl), 4) AS pnl_total, round(avg(t_exit - t_entry), 4) AS avg_hold, round(min(dd), 4) AS max_dd FROM dd GROUP BY 1")(
    lambda s, d: (lambda x: x.select(*[F.round(c, 4).alias(c) if c in ("win_rate", "pnl_total", "avg_hold", "max_dd") else C(c) for c in x.columns]))(T.trade_stats(rounded(T.trades_from_signals(_sma_cross(s, d), 1000.0), "pnl")))
)
