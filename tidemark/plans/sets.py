"""Signals over sets of parameters: a query a strategy, each with the SQL of its sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions.features import feature_rows, rsi_reading
from ..functions.sets import EDGE, STATE, STATE_ONLY, signal_sets
from ..operators.bars import rollup_bars
from .catalog import SQL_BARS, _day, _roll, add, hour_bars, rounded
from .signals import SO_FAR, SQL_HA, band, ema, two_emas

RISK = {"stop_pct": 0.005, "tgt_pct": 0.012}


def w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n: int, x: str, c: str = "*") -> str:
    return f"CASE WHEN count({c}) {w(n)} >= {n} THEN {x} END"


PREV = "x AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY t) AS p FROM bars)"
TR = "y AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(h - l, abs(h - p), abs(l - p)) END AS tr FROM x)"
VALUES = f"{SQL_BARS}, v AS (SELECT *, list(c) {SO_FAR} AS v FROM bars)"
_UP = "CASE WHEN s.c > s.up THEN x.up ELSE least(x.up, s.up) END"
_LO = "CASE WHEN s.c < s.lo THEN x.lo ELSE greatest(x.lo, s.lo) END"


def _sma(p: dict) -> str:
    mean = lambda n: full(n, f"round(avg(c) {w(n)}, 6)")
    return f"{SQL_BARS}, z AS (SELECT *, sign({mean(p['fast'])} - {mean(p['slow'])}) AS zone FROM bars)"


def _rsi(p: dict) -> str:
    n = p["period"]
    return (
        f"{SQL_BARS}, x AS (SELECT *, c - lag(c) OVER (PARTITION BY symbol ORDER BY t) AS dd FROM bars), "
        f"y AS (SELECT *, sum(greatest(dd, 0)) {w(n)} AS g, sum(greatest(-dd, 0)) {w(n)} AS k, count(dd) {w(n)} AS n FROM x), "
        f"r AS (SELECT *, round(CASE WHEN n >= {n} THEN CASE WHEN k = 0 THEN 100 ELSE 100 - 100 / (1 + g / k) END END, 6) AS rsi FROM y), "
        f"z AS (SELECT *, CASE WHEN rsi <= {p['lo']} THEN 1 WHEN rsi >= {p['hi']} THEN -1 WHEN rsi IS NOT NULL THEN 0 END AS zone FROM r)"
    )


def _bollinger(way: int) -> Callable[[dict], str]:
    def of(p: dict) -> str:
        n, c = p["period"], "(h + l + c) / 3" if p.get("price") == "typical" else "c"
        return (
            f"{SQL_BARS}, x AS (SELECT *, {c} AS px FROM bars), y AS (SELECT *, {full(n, f'round(avg(px) {w(n)} - {p["k"]} * stddev_pop(px) {w(n)}, 6)')} AS lo, "
            f"{full(n, f'round(avg(px) {w(n)} + {p["k"]} * stddev_pop(px) {w(n)}, 6)')} AS hi FROM x), z AS (SELECT *, {band('px', 'lo', 'hi', way)} AS zone FROM y)"
        )

    return of


def _donchian(p: dict) -> str:
    n = p["period"]
    return f"{SQL_BARS}, y AS (SELECT *, {full(n, f'min(l) {w(n)}')} AS lo, {full(n, f'max(h) {w(n)}')} AS hi FROM bars), z AS (SELECT *, CASE WHEN c >= hi THEN 1 WHEN c <= lo THEN -1 WHEN hi IS NOT NULL THEN 0 END AS zone FROM y)"


def _zscore(p: dict) -> str:
    n = p["period"]
    return f"{SQL_BARS}, y AS (SELECT *, round(CASE WHEN count(*) {w(n)} >= {n} AND stddev_pop(c) {w(n)} > 1e-12 THEN (c - avg(c) {w(n)}) / stddev_pop(c) {w(n)} END, 6) AS r FROM bars), z AS (SELECT *, {band('r', str(-p['entry']), str(p['entry']), -1)} AS zone FROM y)"


def _cci(p: dict) -> str:
    n = p["period"]
    return (
        f"{SQL_BARS}, x AS (SELECT *, (h + l + c) / 3 AS tp, avg((h + l + c) / 3) {w(n)} AS m, list((h + l + c) / 3) {w(n)} AS v FROM bars), "
        f"y AS (SELECT *, list_sum(list_transform(v, lambda q: abs(q - m))) / {n} AS mad FROM x), "
        f"q AS (SELECT *, round(CASE WHEN len(v) >= {n} AND mad > 0 THEN (tp - m) / (0.015 * mad) END, 6) AS r FROM y), z AS (SELECT *, {band('r', str(p['lo']), str(p['hi']), -1)} AS zone FROM q)"
    )


def _momentum(p: dict) -> str:
    roc = f"(c / lag(c, {p['period']}) OVER (PARTITION BY symbol ORDER BY t) - 1) * {100 if p.get('pct') else 1}"
    signal = ema(p["signal"], "rs") if p.get("compare_to_signal") else "0"
    b = p["band"]
    zone = f"CASE WHEN b IS NULL THEN 0 WHEN b <= {-b} AND d > {b} THEN 1 WHEN b >= {b} AND d < {-b} THEN -1 ELSE 0 END" if p.get("edge_only", 1) else f"CASE WHEN b IS NULL THEN 0 WHEN d > {b} THEN 1 WHEN d < {-b} THEN -1 ELSE 0 END"
    return (
        f"{SQL_BARS}, x AS (SELECT *, {roc} AS roc FROM bars), y AS (SELECT *, list(roc) FILTER (roc IS NOT NULL) {SO_FAR} AS rs FROM x), "
        f"q AS (SELECT *, round(CASE WHEN roc IS NOT NULL THEN roc - {signal} END, 6) AS d FROM y), k AS (SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY t) AS b FROM q), z AS (SELECT *, {zone} AS zone FROM k)"
    )


def _ema_cross(p: dict) -> str:
    f, s = two_emas(p["fast"], p["slow"])
    return f"{VALUES}, z AS (SELECT *, sign(round({f}, 6) - round({s}, 6)) AS zone FROM v)"


def _macd(p: dict) -> str:
    f, s = two_emas(p["fast"], p["slow"])
    return (
        f"{VALUES}, x AS (SELECT *, {f} - {s} AS macd FROM v), y AS (SELECT *, list(macd) FILTER (macd IS NOT NULL) {SO_FAR} AS ls FROM x), "
        f"z AS (SELECT *, CASE WHEN macd IS NOT NULL THEN sign(round(macd - {ema(p['signal'], 'ls')}, 6)) END AS zone FROM y)"
    )


def _keltner(p: dict) -> str:
    atr = full(p["atr"], f"avg(tr) {w(p['atr'])}", "tr")
    return (
        f"{VALUES}, {PREV.replace('FROM bars', 'FROM v')}, {TR}, q AS (SELECT *, {ema(p['ema'])} AS mid, {atr} AS atr FROM y), "
        f"k AS (SELECT *, round(mid - {p['mult']} * atr, 6) AS lo, round(mid + {p['mult']} * atr, 6) AS hi FROM q), z AS (SELECT *, {band('c', 'lo', 'hi')} AS zone FROM k)"
    )


def _supertrend(p: dict) -> str:
    atr = full(p["atr"], f"avg(tr) {w(p['atr'])}", "tr")
    return (
        f"{SQL_BARS}, {PREV}, {TR}, a AS (SELECT *, {atr} AS atr FROM y), b AS (SELECT *, (h + l) / 2 + {p['mult']} * atr AS up, (h + l) / 2 - {p['mult']} * atr AS lo FROM a), "
        "e AS (SELECT *, list(struct_pack(c := c, up := up, lo := lo, tr := CASE WHEN c > up THEN 1 WHEN c < lo THEN -1 WHEN p > up THEN 1 WHEN p < lo THEN -1 ELSE 0 END)) "
        f"FILTER (atr IS NOT NULL) {SO_FAR} AS v FROM b), z AS (SELECT *, CASE WHEN atr IS NOT NULL THEN list_reduce(v, lambda s, x: struct_pack(c := x.c, up := {_UP}, lo := {_LO}, "
        f"tr := CASE WHEN x.c > {_UP} THEN 1 WHEN x.c < {_LO} THEN -1 ELSE s.tr END)).tr END AS zone FROM e)"
    )


def _heikin(p: dict) -> str:
    return f"{SQL_HA}, z AS (SELECT q.*, bars.c, sign(q.hc - q.ho) AS zone FROM q JOIN bars USING (symbol, t))"


def _vwap(p: dict) -> str:
    return (
        f"{SQL_BARS}, x AS (SELECT *, {_day} AS day FROM bars), "
        "y AS (SELECT *, c - sum(c * greatest(vol, 1)) OVER w / sum(greatest(vol, 1)) OVER w AS dev FROM x WINDOW w AS (PARTITION BY symbol, day ORDER BY t ROWS UNBOUNDED PRECEDING)), "
        f"q AS (SELECT *, round(CASE WHEN count(dev) OVER w >= {p['min']} AND stddev_samp(dev) OVER w > 0 THEN dev / stddev_samp(dev) OVER w END, 6) AS r FROM y WINDOW w AS (PARTITION BY symbol, day ORDER BY t ROWS UNBOUNDED PRECEDING)), "
        f"z AS (SELECT *, {band('r', str(-p['z']), str(p['z']), -1)} AS zone FROM q)"
    )


def _orb(p: dict) -> str:
    end = 555 + p["minutes"]
    return (
        f"{SQL_BARS}, x AS (SELECT *, {_day} AS day, (t + 19800) % 86400 // 60 AS m FROM bars), "
        f"y AS (SELECT *, CASE WHEN m >= {end} THEN max(CASE WHEN m >= 555 AND m < {end} THEN h END) OVER w END AS hi, CASE WHEN m >= {end} THEN min(CASE WHEN m >= 555 AND m < {end} THEN l END) OVER w END AS lo FROM x WINDOW w AS (PARTITION BY symbol, day)), "
        f"q AS (SELECT *, {band('c', 'lo', 'hi')} AS zn FROM y), k AS (SELECT *, min(CASE WHEN zn <> 0 THEN t END) OVER (PARTITION BY symbol, day) AS hit FROM q), "
        f"z AS (SELECT *, CASE WHEN t {'=' if p.get('edge_only', 1) else '>='} hit THEN zn END AS zone, t = hit AS sure FROM k)"
    )


def sql(strategy: str, zones: Callable[[dict], str], sets: dict[str, dict]) -> str:
    out = []
    for name, p in sets.items():
        keys = "symbol, day" if strategy == "vwap_reversion" else "symbol"
        before = f"last_value(zone IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        price, sure = "c", STATE
        if strategy == "orb_breakout":
            way, sure, price = "zone", f"CASE WHEN sure THEN {EDGE[strategy]} ELSE {STATE} END", "CASE WHEN sure THEN c END"
        elif strategy in STATE_ONLY:
            way, sure = "zone", STATE_ONLY[strategy]
        elif strategy == "momentum_roc":
            way, sure = "zone", EDGE[strategy] if p.get("edge_only", 1) else STATE
        elif p.get("edge_only", 1):
            way, sure = f"CASE WHEN zone <> {before} THEN zone ELSE 0 END", EDGE[strategy]
        else:
            way = f"CASE WHEN {before} IS NOT NULL THEN zone ELSE 0 END"
        if p.get("price") == "typical":
            price = "px"
        off = lambda pct, side: f"CASE WHEN wy <> 0 THEN round({price} * (1 + {side} * wy * {pct}), 6) END" if pct else "NULL::DOUBLE"  # noqa: B023, E731
        out.append(
            f"SELECT * FROM (WITH {zones(p)}, wz AS (SELECT *, coalesce({way}, 0) AS wy FROM z) SELECT symbol, t, '{name}' AS params_id, CASE WHEN wy > 0 THEN 'BUY' WHEN wy < 0 THEN 'SELL' ELSE 'FLAT' END AS action, "
            f"(CASE WHEN wy <> 0 THEN {sure} ELSE 1 END)::DOUBLE AS confidence, {off(p.get('stop_pct', 0), -1)} AS stop, {off(p.get('tgt_pct', 0), 1)} AS target FROM wz)"
        )
    return " UNION ALL ".join(out)


GIVEN: dict[str, tuple[Callable[[dict], str], dict[str, dict]]] = {
    "sma_cross": (_sma, {"a": {"fast": 5, "slow": 13, **RISK}, "b": {"fast": 20, "slow": 50}, "c": {"fast": 8, "slow": 21, "stop_pct": 0.01}}),
    "ema_cross": (_ema_cross, {"a": {"fast": 12, "slow": 50, **RISK}, "b": {"fast": 5, "slow": 20, "edge_only": 0, **RISK}, "c": {"fast": 8, "slow": 21}}),
    "macd_signal": (_macd, {"a": {"fast": 12, "slow": 26, "signal": 9, **RISK}, "b": {"fast": 6, "slow": 19, "signal": 5, "edge_only": 0}, "c": {"fast": 8, "slow": 17, "signal": 9}}),
    "rsi_reversion": (_rsi, {"a": {"period": 14, "lo": 30, "hi": 70, **RISK}, "b": {"period": 7, "lo": 25, "hi": 75}, "c": {"period": 21, "lo": 35, "hi": 65}}),
    "bollinger_breakout": (_bollinger(1), {"a": {"period": 20, "k": 2.0, **RISK}, "b": {"period": 13, "k": 1.5, "edge_only": 0, **RISK}, "c": {"period": 30, "k": 1.0, "price": "typical", **RISK}}),
    "bollinger_reversion": (_bollinger(-1), {"a": {"period": 20, "k": 2.0, **RISK}, "b": {"period": 11, "k": 1.25, "edge_only": 0}, "c": {"period": 25, "k": 1.5, **RISK}}),
    "donchian_breakout": (_donchian, {"a": {"period": 20, **RISK}, "b": {"period": 7, "edge_only": 0, **RISK}, "c": {"period": 33}}),
    "keltner_breakout": (_keltner, {"a": {"ema": 20, "atr": 14, "mult": 2.0, **RISK}, "b": {"ema": 10, "atr": 7, "mult": 1.0, "edge_only": 0}, "c": {"ema": 30, "atr": 10, "mult": 1.5}}),
    "supertrend": (_supertrend, {"a": {"atr": 10, "mult": 3.0, **RISK}, "b": {"atr": 7, "mult": 1.0, "edge_only": 0, **RISK}, "c": {"atr": 14, "mult": 2.0}}),
    "heikin_trend": (_heikin, {"a": {**RISK}, "b": {"edge_only": 0, **RISK}, "c": {"stop_pct": 0.02}}),
    "cci_reversion": (_cci, {"a": {"period": 20, "lo": -100, "hi": 100, **RISK}, "b": {"period": 9, "lo": -80, "hi": 120, "edge_only": 0}, "c": {"period": 15, "lo": -50, "hi": 50}}),
    "momentum_roc": (_momentum, {"a": {"period": 12, "band": 0.0, "signal": 6, **RISK}, "b": {"period": 5, "band": 0.1, "signal": 6, "edge_only": 0}, "c": {"period": 9, "band": 0.0, "signal": 6, "compare_to_signal": 1, "pct": 1, **RISK}}),
    "zscore_reversion": (_zscore, {"a": {"period": 20, "entry": 1.5, **RISK}, "b": {"period": 9, "entry": 1.0, "edge_only": 0, **RISK}, "c": {"period": 40, "entry": 2.0}}),
    "vwap_reversion": (_vwap, {"a": {"z": 1.0, "min": 5, **RISK}, "b": {"z": 0.5, "min": 3, "edge_only": 0}, "c": {"z": 1.5, "min": 8}}),
    "orb_breakout": (_orb, {"a": {"minutes": 120, **RISK}, "b": {"minutes": 180, "edge_only": 0, **RISK}, "c": {"minutes": 60}}),
}


def _query(strategy: str, sets: dict[str, dict]):
    return lambda s, d: signal_sets(hour_bars(s, d), strategy, sets).select("symbol", "t", "params_id", "action", "confidence", F.round("stop", 6).alias("stop"), F.round("target", 6).alias("target"))


for _name, (_zones, _sets) in GIVEN.items():
    add(f"sets_{_name}", sql(_name, _zones, _sets))(_query(_name, _sets))


def _rsi_of(n: int) -> str:
    return f"CASE WHEN count(dd) {w(n)} >= {n} THEN CASE WHEN sum(greatest(-dd, 0)) {w(n)} = 0 THEN 100 ELSE 100 - 100 / (1 + sum(greatest(dd, 0)) {w(n)} / sum(greatest(-dd, 0)) {w(n)}) END END"


_DIFFS = "SELECT *, c - lag(c) OVER (PARTITION BY symbol ORDER BY t) AS dd, lag(c) OVER (PARTITION BY symbol ORDER BY t) AS p FROM"
_TF1 = f"SELECT 1 AS tf, symbol, t, {full(5, f'avg(c) {w(5)}')} AS sma_5, {full(20, f'avg(c) {w(20)}')} AS sma_20, {_rsi_of(14)} AS rsi_14, {full(14, f'avg(tr) {w(14)}', 'tr')} AS atr_14, NULL::DOUBLE AS sma_10"
_TF5 = f"SELECT 5, symbol, t, NULL, NULL, {_rsi_of(14)}, NULL, {full(10, f'avg(c) {w(10)}')}"
_SIX = ["sma_5", "sma_20", "rsi_14", "atr_14", "sma_10"]
add(
    "g21_features_by_tf",
    f"WITH {SQL_BARS}, r5 AS ({_roll(5 * 3600)}), a AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(h - l, abs(h - p), abs(l - p)) END AS tr FROM ({_DIFFS} bars)), b AS ({_DIFFS} r5), "
    f"u AS ({_TF1} FROM a UNION ALL {_TF5} FROM b) SELECT tf, symbol, t, {', '.join(f'round({c}, 6) AS {c}' for c in _SIX)}, CASE WHEN tf = 1 THEN sma_5 IS NOT NULL AND sma_20 IS NOT NULL AND rsi_14 IS NOT NULL AND atr_14 IS NOT NULL ELSE sma_10 IS NOT NULL AND rsi_14 IS NOT NULL END AS ready FROM u",
)(
    lambda s, d: rounded(feature_rows(hour_bars(s, d).withColumn("tf", F.lit(1)).unionByName(rollup_bars(hour_bars(s, d), 5 * 3600).withColumn("tf", F.lit(5)))), *_SIX)
)
add(
    "g4_rsi_reading",
    f"WITH {SQL_BARS}, a AS ({_DIFFS} bars), r AS (SELECT *, {_rsi_of(14)} AS rsi, min(c) {w(15)} AS lo, max(c) {w(15)} AS hi FROM a), z AS (SELECT *, CASE WHEN rsi <= 30 THEN 'BUY' WHEN rsi >= 70 THEN 'SELL' END AS side FROM r) "
    "SELECT symbol, t, side, round(CASE side WHEN 'BUY' THEN least(1, (30 - rsi) / 30) WHEN 'SELL' THEN least(1, (rsi - 70) / 30) END, 6) AS strength, round(CASE side WHEN 'BUY' THEN lo * 0.99 WHEN 'SELL' THEN hi * 1.01 END, 6) AS stop FROM z",
)(lambda s, d: rounded(rsi_reading(hour_bars(s, d)), "strength", "stop"))
