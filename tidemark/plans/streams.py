"""Sources and stream operators over whole tables, each with its SQL: what a stream of the same rows gives in the end."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import tables as S
from ..streaming import bars as SB
from .catalog import DAY, HOUR, SQL_BARS, SQL_FILLS, SQL_RESULTS, SQL_TICKS, _read, add, fills, hour_bars, results, ticks

C = F.col
START = 1704067200  # of ticks that bear no time

# Messages: some without volume, time or symbol, some that are no JSON.
_FIELDS = {"symbol": "id % 13 <> 0", "event_ts": "id % 17 <> 0", "ltp": "true", "vol": "id % 7 <> 0"}


def messages(s: SparkSession, d: str) -> DataFrame:
    x = ticks(s, d).withColumn("event_ts", F.unix_micros("ts") * 1000 + 789)
    text = F.to_json(F.struct(*[F.when(F.expr(ok), C(c)).alias(c) for c, ok in _FIELDS.items()]))
    return x.select("id", F.when(C("id") % 11 == 0, F.concat(F.lit("junk "), C("id").cast("string"))).otherwise(text).alias("value"))


def parsed(s: SparkSession, d: str) -> DataFrame:
    return S.parse_ticks(messages(s, d), now=F.timestamp_seconds(F.lit(START)))


SQL_PARSED = f"{SQL_TICKS}, pt AS (SELECT symbol, CASE WHEN id % 17 = 0 THEN {START * 10**6} ELSE us END AS us, ltp, CASE WHEN id % 7 = 0 THEN 0 ELSE coalesce(vol, 0) END AS vol, id % 13 <> 0 AND id % 11 <> 0 AS good FROM ticks)"
add("a1_parse_ticks", f"WITH {SQL_PARSED} SELECT symbol, us, ltp, vol FROM pt WHERE good")(lambda s, d: S.split_dlq(parsed(s, d))[0].select("symbol", F.unix_micros("ts").alias("us"), "ltp", "vol"))
add("a9_dead_letters", f"WITH {SQL_PARSED} SELECT count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM pt")(
    lambda s, d: parsed(s, d).agg(F.count_if(C("_corrupt").isNull()).alias("good"), F.count_if(C("_corrupt").isNotNull()).alias("bad"))
)
add("a7_publish", f"WITH {SQL_FILLS} SELECT symbol::VARCHAR AS key, '{{\"symbol\":' || symbol || ',\"side\":\"' || side || '\",\"qty\":' || qty || '}}' AS value FROM fills")(
    lambda s, d: S.publish(fills(s, d).select("symbol", "side", "qty"), "symbol")
)
_BREAKS = "concat_ws(',', CASE WHEN pnl_total IS NULL THEN 'missing:pnl_total' END, CASE WHEN win_rate IS NULL THEN 'missing:win_rate' END, CASE WHEN n_trades < 20 THEN 'minimum:n_trades' END, CASE WHEN strategy NOT IN ('A', 'N') THEN 'enum:strategy' END)"
add("a10_violations", f"WITH {SQL_RESULTS} SELECT symbol, strategy, timeframe, {_BREAKS} AS reasons FROM res")(
    lambda s, d: results(s, d).select("symbol", "strategy", "timeframe", S.violations(["pnl_total", "win_rate"], {"n_trades": 20}, {"strategy": ["A", "N"]}).alias("reasons"))
)
add("a8_expired_days", f"WITH {SQL_BARS} SELECT DISTINCT strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day FROM bars WHERE t < {START + 10 * DAY}")(
    lambda s, d: S.expired(hour_bars(s, d).select(F.to_date(F.timestamp_seconds("t")).alias("day")), datetime.date(2024, 1, 18), 7).select(C("day").cast("string").alias("day"))
)
_KIND = "CASE p_size % 4 WHEN 0 THEN 'FUT' WHEN 1 THEN 'CE' WHEN 2 THEN 'PE' ELSE 'EQ' END"
_EXPIRY = "concat('2024-0', 1 + p_size % 9, '-', 10 + p_partkey % 18, 'T00:00:00')"
add(
    "a13_instruments",
    f"WITH r AS (SELECT p_partkey % 150 AS instrument_token, {_EXPIRY} AS e, p_partkey AS k, CASE WHEN p_size % 3 <> 0 THEN 0.1::DOUBLE ELSE 0.05 END AS tick_size, CASE WHEN p_size % 5 <> 0 THEN p_size ELSE 1 END AS lot_size, {_KIND} AS i FROM part), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY instrument_token ORDER BY e DESC, k DESC) AS n FROM r WHERE i <> 'EQ') SELECT instrument_token, e[1:10] AS expiry, k, tick_size, lot_size FROM n WHERE n = 1",
)(
    lambda s, d: S.instruments(
        _read(s, d, "part").select((C("p_partkey") % 150).alias("instrument_token"), C("p_partkey").alias("k"), F.expr(_KIND).alias("instrument_type"), F.expr(_EXPIRY).alias("expiry"), F.when(C("p_size") % 3 != 0, 0.1).alias("tick_size"), F.when(C("p_size") % 5 != 0, C("p_size")).cast("int").alias("lot_size"))
    ).select("instrument_token", C("expiry").cast("string").alias("expiry"), "k", "tick_size", "lot_size")
)

# Stream operators: the same plans on a table.
add("m1_windows", f"WITH {SQL_BARS} SELECT symbol, t, o, h, l, c, vol, n_trades FROM bars")(lambda s, d: SB.stream_bars(ticks(s, d), "1 hour", "5 seconds").drop("start"))
add(
    "m2_sliding_rates",
    f"WITH {SQL_TICKS}, w AS (SELECT symbol, unnest(generate_series(us // {HOUR * 10**6} * {HOUR} - {2 * HOUR}, us // {HOUR * 10**6} * {HOUR}, {HOUR})) AS start, us FROM ticks) SELECT symbol, start, count(*) AS n FROM w GROUP BY 1, 2",
)(lambda s, d: SB.rates(ticks(s, d), "3 hours", "1 hour", "5 seconds").select("symbol", F.unix_seconds("start").alias("start"), "n"))
add(
    "m13_health",
    f"WITH {SQL_TICKS}, x AS (SELECT symbol, us // {HOUR * 10**6} * {HOUR} AS start, us, greatest(0, id % 7 - 1) AS late FROM ticks) SELECT symbol, start, count(*) AS n, round(avg(late), 6) AS mean_late, max(late)::DOUBLE AS most_late, max(us) AS newest FROM x GROUP BY 1, 2",
)(
    lambda s, d: SB.health(ticks(s, d).withColumn("seen", F.timestamp_micros(F.unix_micros("ts") + (C("id") % 7 - 1) * 1_000_000)), "1 hour", "5 seconds")
    .select("symbol", F.unix_seconds("start").alias("start"), "n", F.round("mean_late", 6).alias("mean_late"), F.round("most_late", 6).alias("most_late"), F.unix_micros("newest").alias("newest"))
)
add("c1_bar_width_3m", f"WITH {SQL_TICKS} SELECT symbol, us // 180000000 * 180 AS t, first(ltp ORDER BY us, id) AS o, last(ltp ORDER BY us, id) AS c, count(*) AS n_trades FROM ticks GROUP BY 1, 2")(
    lambda s, d: B.tick_bars(ticks(s, d), 180).select("symbol", "t", "o", "c", "n_trades")
)
