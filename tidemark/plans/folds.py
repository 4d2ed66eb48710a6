"""SQL of the queries that fold a key's rows: one list a key, reduced to a state that carries what it has handed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids as G
from ..operators import pairs as P
from .catalog import HOUR, add, hour_bars
from .research import SQL_GRID_CROSS, _fmt, _signals, grid_signals, pair_rows
from .signals import SQL_SPREAD, _spread

C = F.col


def fold(name: str, source: str, keys: str, fields: dict[str, tuple[str, str]], state: dict[str, tuple[str, str, str]], events: dict[str, str], emit: list[tuple[str, dict[str, str]]], after: dict[str, str] | None = None) -> str:
    """Common tables: name(keys, z), z being the last state of a fold over source in order of t, and name_e(keys, events).

    fields: what a row brings, (type, SQL); state: (type, at first, next), where s is the state before and x the row; emit:
    what a row hands on, (when, the events' columns). ``after`` gives names to parts of the next state that others use.
    """
    kind = "STRUCT(" + ", ".join(f"{k} {t}" for k, t in events.items()) + ")[]"
    begin = ", ".join(f"{k} := ({v})::{t}" for k, (t, v, _) in state.items()) + f", e := []::{kind}"
    first = "struct_pack(" + ", ".join(f"{k} := NULL::{t}" for k, (t, _) in fields.items()) + f", {begin})"
    row = "struct_pack(" + ", ".join(f"{k} := ({v})::{t}" for k, (t, v) in fields.items()) + f", {begin})"
    put = lambda sql: sql.format(**(after or {}))
    out = " || ".join([f"s.e", *(f"(CASE WHEN {put(when)} THEN [struct_pack(" + ", ".join(f"{k} := ({put(cols[k])})::{t}" for k, t in events.items()) + f")] ELSE []::{kind} END)" for when, cols in emit)])
    step = "struct_pack(" + ", ".join([*(f"{k} := x.{k}" for k in fields), *(f"{k} := ({put(n)})::{t}" for k, (t, _, n) in state.items())]) + f", e := {out})"
    return (
        f"{name} AS (SELECT {keys}, list_reduce(list_prepend({first}, list({row} ORDER BY t)), lambda s, x: {step}) AS z FROM {source} GROUP BY ALL), "
        f"{name}_e AS (SELECT {keys}, unnest(z.e, recursive := true) FROM {name})"
    )


# --- signals of pairs


def signals_sql(entry: float, leave: float, stop: float, hold: float, cutoff: int | None) -> str:
    """SQL_SPREAD with sg(symbol, z) and sg_e(symbol, t, action, reason, pos): what P.pair_signals hands on."""
    late = f"((x.t + 19800) % 86400 // 60 >= {cutoff})" if cutoff is not None else "false"
    parts = {
        "side": f"(CASE WHEN s.pos = 0 AND NOT {late} AND s.z > {entry} AND x.z <= {entry} THEN -1 WHEN s.pos = 0 AND NOT {late} AND s.z < {-entry} AND x.z >= {-entry} THEN 1 END)",
        "why": f"(CASE WHEN s.pos <> 0 THEN CASE WHEN abs(x.z) <= {leave} THEN 'revert' WHEN abs(x.z) >= {stop} THEN 'stop' {f'WHEN x.t - s.since >= {hold}' if hold else 'WHEN false'} THEN 'timeout' WHEN {late} THEN 'flatten' END END)",
    }
    step = fold(
        "sg", "(SELECT * FROM sz WHERE z IS NOT NULL)", "symbol", {"t": ("BIGINT", "t"), "z": ("DOUBLE", "z")},
        {"pos": ("INTEGER", "0", "CASE WHEN s.pos = 0 THEN coalesce({side}, 0) WHEN {why} IS NOT NULL THEN 0 ELSE s.pos END"), "since": ("BIGINT", "0", "CASE WHEN {side} IS NOT NULL THEN x.t ELSE s.since END")},
        {"t": "BIGINT", "action": "VARCHAR", "reason": "VARCHAR", "pos": "INTEGER", "way": "INTEGER"},
        [
            ("{side} IS NOT NULL", {"t": "x.t", "action": "CASE WHEN {side} < 0 THEN 'ENTER_SHORT_A_LONG_B' ELSE 'ENTER_LONG_A_SHORT_B' END", "reason": "'reenter'", "pos": "{side}", "way": "{side}"}),
            ("{why} IS NOT NULL", {"t": "x.t", "action": "'EXIT'", "reason": "{why}", "pos": "0", "way": "-s.pos"}),
        ],
        parts,
    )
    return f"{SQL_SPREAD}, {step}"


SQL_SIGNALS = signals_sql(1.0, 0.25, 2.5, 48 * 3600, 1380)
add(
    "g20_pair_signals",
    f"WITH {SQL_SIGNALS} SELECT symbol, t, action, reason, CASE WHEN way > 0 THEN 'BUY' ELSE 'SELL' END AS side_a, CASE WHEN way < 0 THEN 'BUY' ELSE 'SELL' END AS side_b FROM sg_e",
)(lambda s, d: P.sides(_signals(s, d)))
add(
    "e19_pair_signal_stats",
    f"WITH {SQL_SIGNALS}, l AS (SELECT symbol, last(z ORDER BY t) AS last_z FROM sz GROUP BY 1), g AS (SELECT symbol, count(*) FILTER (action <> 'EXIT') AS entries, count(*) FILTER (action = 'EXIT') AS exits, "
    "last(pos ORDER BY t) AS position FROM sg_e GROUP BY 1) SELECT l.symbol, coalesce(entries, 0) AS entries, coalesce(exits, 0) AS exits, last_z, coalesce(position, 0) AS position FROM l LEFT JOIN g ON g.symbol = l.symbol",
)(lambda s, d: P.pair_signal_stats(_signals(s, d)))
NOW = 1706745600
add(
    "i15_open_pairs",
    f"WITH {signals_sql(1.0, 0.0, 99.0, 0.0, None)}, g AS (SELECT symbol, max(t) AS t, last(pos ORDER BY t) AS position FROM sg_e GROUP BY 1) SELECT symbol, t, position, ({NOW} - t) / 60 AS hold_min FROM g WHERE position <> 0",
)(lambda s, d: P.open_pairs(P.pair_signals(_spread(s, d), P.Thresholds(1.0, 0.0, 99.0, 0.0)), F.lit(NOW)))

# --- trades of pairs, a fold for each pair and variant

SQL_ROWS = (
    f"{SQL_SPREAD}, vb AS (SELECT symbol, 1.5e0 AS entry, count(*) % 3 * 0.25e0 AS leave, 3e0 AS stop FROM al GROUP BY 1), ve AS (SELECT symbol, unnest([entry - 0.25, entry, entry + 0.25]) AS entry, leave, stop FROM vb), "
    "vl AS (SELECT symbol, entry, unnest(list_distinct([round(greatest(0.1, leave - 0.25), 4), round(greatest(0.1, leave), 4), round(greatest(0.1, leave + 0.25), 4)])) AS leave, stop FROM ve), "
    "vs AS (SELECT symbol, entry, leave, unnest([stop - 0.5, stop, stop + 0.5]) AS stop FROM vl), "
    f"pr AS (SELECT sz.*, al.x AS px, al.y AS py, entry, leave, stop, 'lb60_ez' || {_fmt('entry')} || '_xz' || {_fmt('leave')} || '_sz' || {_fmt('stop')} AS variant FROM sz JOIN al ON al.symbol = sz.symbol AND al.t = sz.t JOIN vs ON vs.symbol = sz.symbol)"
)
FIELDS = {"t": ("BIGINT", "t"), "z": ("DOUBLE", "z"), "px": ("DOUBLE", "px"), "py": ("DOUBLE", "py"), "beta": ("DOUBLE", "beta"), "sp": ("DOUBLE", "spread"), "en": ("DOUBLE", "entry"), "le": ("DOUBLE", "leave"), "st": ("DOUBLE", "stop")}
TRADE = {"side": "VARCHAR", "t_entry": "BIGINT", "t_exit": "BIGINT", "reason": "VARCHAR", "beta": "DOUBLE", "qx": "BIGINT", "qy": "BIGINT", "pnl": "DOUBLE", "hold_min": "DOUBLE"}
HOLD = 48 * HOUR
_scale = "(100000 / (x.px + greatest(abs(x.beta), 1e-3) * x.py))"
LEGS = {"qx": f"greatest(1, trunc({_scale}))", "qy": f"greatest(1, trunc({_scale} * greatest(abs(x.beta), 1e-3)))"}


def _held(opens: str, closes: str) -> dict[str, tuple[str, str, str]]:
    """State of an open trade: its way and what it was opened with."""
    kept = {"t0": ("BIGINT", "x.t"), "x0": ("DOUBLE", "x.px"), "y0": ("DOUBLE", "x.py"), "s0": ("DOUBLE", "x.sp"), "b0": ("DOUBLE", "x.beta"), "q0": ("BIGINT", LEGS["qx"]), "r0": ("BIGINT", LEGS["qy"])}
    way = ("INTEGER", "0", f"CASE WHEN s.way = 0 THEN coalesce({opens}, 0) WHEN {closes} THEN 0 ELSE s.way END")
    return {"way": way} | {k: (t, "0", f"CASE WHEN s.way = 0 AND {opens} IS NOT NULL THEN {v} ELSE s.{k} END") for k, (t, v) in kept.items()}


def _trade(reason: str, pnl: str, beta: str = "s.b0", legs: tuple[str, str] = ("s.q0", "s.r0")) -> dict[str, str]:
    return {"side": "CASE WHEN s.way > 0 THEN 'LONGSPREAD' ELSE 'SHORTSPREAD' END", "t_entry": "s.t0", "t_exit": "x.t", "reason": reason, "beta": beta, "qx": legs[0], "qy": legs[1], "pnl": pnl, "hold_min": "(x.t - s.t0) / 60"}


def _band_leg(qty: str, opened: str, closed: str, way: str) -> str:
    """A leg's profit with 2 basis points of slippage and fees of 5 on each side."""
    return f"(CASE WHEN {way} > 0 THEN ({closed} * (1 - 2e-4) - {opened} * (1 + 2e-4)) * {qty} - 10 ELSE ({opened} * (1 - 2e-4) - {closed} * (1 + 2e-4)) * {qty} - 10 END)"


def _band_pnl(x: str, y: str, s: str) -> str:
    return f"{_band_leg(f'{s}.r0', f'{s}.y0', y, f'{s}.way')} + {_band_leg(f'{s}.q0', f'{s}.x0', x, f'-{s}.way')}"


_known = "x.z IS NOT NULL"
_back = f"(CASE WHEN {_known} AND s.way = 0 AND (s.pend = -1 AND s.b >= x.en AND x.en >= x.z OR s.pend = 1 AND s.b <= -x.en AND -x.en <= x.z) THEN s.pend END)"
_out = f"({_known} AND s.way <> 0 AND (abs(x.z) >= x.st OR x.t - s.t0 >= {HOLD} OR abs(x.z) <= x.le))"
_band = fold(
    "bl", "pr", "symbol, variant", FIELDS,
    _held(_back, _out) | {
        "pend": ("INTEGER", "0", f"CASE WHEN {_back} IS NOT NULL THEN 0 WHEN {_known} AND s.way = 0 AND s.b < x.en AND x.en <= x.z THEN -1 WHEN {_known} AND s.way = 0 AND s.b > -x.en AND -x.en >= x.z THEN 1 ELSE s.pend END"),
        "b": ("DOUBLE", "NULL", "coalesce(x.z, s.b)"),
    },
    TRADE, [(_out, _trade(f"CASE WHEN abs(x.z) >= x.st THEN 'STOP' WHEN x.t - s.t0 >= {HOLD} THEN 'TIMEOUT' ELSE 'CLOSE' END", _band_pnl("x.px", "x.py", "s")))],
)
add(
    "h11_pair_ledger",
    f"WITH {SQL_ROWS}, {_band}, tr AS (SELECT * FROM bl_e UNION ALL SELECT symbol, variant, CASE WHEN z.way > 0 THEN 'LONGSPREAD' ELSE 'SHORTSPREAD' END, z.t0, z.t, 'FORCE_CLOSE', z.b0, z.q0, z.r0, {_band_pnl('z.px', 'z.py', 'z')}, (z.t - z.t0) / 60 FROM bl WHERE z.way <> 0) "
    "SELECT * REPLACE (round(pnl, 4) AS pnl, round(hold_min, 4) AS hold_min) FROM tr",
)(lambda s, d: _four(P.pair_ledger(pair_rows(s, d))))


def _four(df: DataFrame) -> DataFrame:
    return df.withColumn("pnl", F.round("pnl", 4)).withColumn("hold_min", F.round("hold_min", 4))


_new = f"(CASE WHEN {_known} AND s.way = 0 AND s.b IS NOT NULL AND s.b < x.en AND x.en <= x.z THEN -1 WHEN {_known} AND s.way = 0 AND s.b IS NOT NULL AND s.b > -x.en AND -x.en >= x.z THEN 1 END)"
_age = f"(CASE WHEN {_new} IS NOT NULL THEN 0 ELSE s.age END)"
_pend = f"(CASE WHEN s.way <> 0 OR NOT ({_known}) THEN s.pend WHEN {_age} > 1 THEN 0 ELSE coalesce({_new}, s.pend) END)"
_in = f"(CASE WHEN {_known} AND s.way = 0 AND {_pend} <> 0 AND -{_pend} * x.z >= x.en THEN {_pend} END)"
_gone = f"({_known} AND s.way <> 0 AND (abs(x.z) <= x.le OR abs(x.z) >= x.st OR x.t - s.t0 >= {HOLD}))"
_swing = fold(
    "sw", "pr", "symbol, variant", FIELDS,
    _held(_in, _gone) | {
        "pend": ("INTEGER", "0", f"CASE WHEN {_in} IS NOT NULL OR {_gone} THEN 0 ELSE {_pend} END"),
        "age": ("INTEGER", "0", f"CASE WHEN {_known} AND s.way = 0 AND {_pend} <> 0 AND {_in} IS NULL THEN {_age} + 1 ELSE {_age} END"),
        "b": ("DOUBLE", "NULL", "x.z"),
    },
    TRADE, [(_gone, _trade("CASE WHEN abs(x.z) <= x.le THEN 'revert' WHEN abs(x.z) >= x.st THEN 'stop' ELSE 'timeout' END", "s.way * ((x.px - s.x0) * s.q0 - (x.py - s.y0) * s.r0)"))],
)
add("h12_swing_ledger", f"WITH {SQL_ROWS}, {_swing} SELECT * REPLACE (round(pnl, 4) AS pnl, round(hold_min, 4) AS hold_min) FROM sw_e")(lambda s, d: _four(P.pair_ledger(pair_rows(s, d), "swing")))
_enter = f"(CASE WHEN {_known} AND s.way = 0 AND abs(x.z) >= x.en THEN CASE WHEN x.z > 0 THEN -1 ELSE 1 END END)"
_spreads = fold(
    "sl", "pr", "symbol, variant", FIELDS, _held(_enter, _gone), TRADE,
    [(_gone, _trade("CASE WHEN abs(x.z) >= x.st THEN 'STOP' WHEN abs(x.z) <= x.le THEN 'CLOSE' ELSE 'TIMEOUT' END", "s.way * (x.sp - s.s0)", legs=("1", "1")))],
)
add("h13_spread_ledger", f"WITH {SQL_ROWS}, {_spreads} SELECT * REPLACE (round(pnl, 4) AS pnl, round(hold_min, 4) AS hold_min) FROM sl_e")(lambda s, d: _four(P.pair_ledger(pair_rows(s, d), "spread")))

# --- trades with fixed exits, for every variant of the grid's signals

_late = "((x.t + 19800) % 86400 // 60 >= 930)"
_stop, _aim = "(s.p0 * (1 - s.way * 0.03))", "(s.p0 * (1 + s.way * 0.05))"
_hs = f"(s.way > 0 AND x.l <= {_stop} OR s.way < 0 AND x.h >= {_stop})"
_ht = f"(s.way > 0 AND x.h >= {_aim} OR s.way < 0 AND x.l <= {_aim})"
_opens = f"((s.way = 0 OR {_late}) AND x.a <> 0 AND floor(1000 / x.c) > 0)"
_closes = f"(s.way <> 0 AND ({_late} OR {_hs} OR {_ht}))"
_stay = f"{_opens} AND NOT {_late}"
_side = "CASE WHEN {} > 0 THEN 'LONG' ELSE 'SHORT' END"
_px = f"(CASE WHEN {_late} THEN x.c ELSE least(greatest(CASE WHEN {_hs} THEN {_stop} ELSE {_aim} END, x.l), x.h) END)"
_exits = fold(
    "fx", "fr", "symbol", {"t": ("BIGINT", "t"), "h": ("DOUBLE", "h"), "l": ("DOUBLE", "l"), "c": ("DOUBLE", "c"), "a": ("INTEGER", "CASE action WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END")},
    {
        "way": ("INTEGER", "0", f"CASE WHEN {_stay} THEN x.a WHEN {_closes} THEN 0 ELSE s.way END"),
        "t0": ("BIGINT", "0", f"CASE WHEN {_stay} THEN x.t ELSE s.t0 END"), "p0": ("DOUBLE", "0", f"CASE WHEN {_stay} THEN x.c ELSE s.p0 END"), "q0": ("BIGINT", "0", f"CASE WHEN {_stay} THEN floor(1000 / x.c) ELSE s.q0 END"),
    },
    {"side": "VARCHAR", "t_entry": "BIGINT", "px_entry": "DOUBLE", "qty": "BIGINT", "t_exit": "BIGINT", "px_exit": "DOUBLE", "reason": "VARCHAR", "pnl": "DOUBLE"},
    [
        (_closes, {"side": _side.format("s.way"), "t_entry": "s.t0", "px_entry": "s.p0", "qty": "s.q0", "t_exit": "x.t", "px_exit": _px, "reason": f"CASE WHEN {_late} THEN 'squareoff' WHEN {_hs} THEN 'stop' ELSE 'target' END", "pnl": f"s.way * s.q0 * ({_px} - s.p0)"}),
        (f"{_opens} AND {_late}", {"side": _side.format("x.a"), "t_entry": "x.t", "px_entry": "x.c", "qty": "floor(1000 / x.c)", "t_exit": "x.t", "px_exit": "x.c", "reason": "'squareoff'", "pnl": "0"}),
    ],
)


def exit_rows(s: SparkSession, d: str) -> DataFrame:
    """Signals of every variant with the bars' highs and lows."""
    bars = hour_bars(s, d).select(C("symbol").alias("_s"), C("t").alias("_t"), "h", "l")
    x = grid_signals(s, d)
    return x.join(bars, (F.split("symbol", "\\|")[0] == C("_s")) & (C("t") == C("_t"))).drop("_s", "_t")


add(
    "h8_fixed_exits",
    f"WITH {SQL_GRID_CROSS}, fr AS (SELECT sig.*, bars.h, bars.l FROM sig JOIN bars ON bars.symbol = split_part(sig.symbol, '|', 1) AND bars.t = sig.t), {_exits}, tr AS (SELECT * FROM fx_e UNION ALL "
    f"SELECT symbol, {_side.format('z.way')}, z.t0, z.p0, z.q0, z.t, z.c, 'end', z.way * z.q0 * (z.c - z.p0) FROM fx WHERE z.way <> 0) SELECT * REPLACE (round(px_exit, 6) AS px_exit, round(pnl, 4) AS pnl) FROM tr",
)(lambda s, d: G.trades_fixed(exit_rows(s, d), ["symbol"], 1000.0, 0.05, 0.03, 930).withColumn("px_exit", F.round("px_exit", 6)).withColumn("pnl", F.round("pnl", 4)))
