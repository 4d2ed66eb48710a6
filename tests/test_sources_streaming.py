"""Sources on small inputs, and streams against the batch operators over the same rows."""

import datetime
from collections import defaultdict, deque

from pyspark.sql import functions as F
from tidemark.operators import bars as B
from tidemark.operators import ledgers as L
from tidemark.operators import tables as T
from tidemark.plans import catalog
from tidemark.sources import tables as S
from tidemark.streaming import bars as stream

SF = "/root/testdata/sf0.001"


def test_ticks_and_dead_letters(spark):
    rows = ['{"symbol": "A", "event_ts": 1700000000123456789, "ltp": 5.5, "vol": 3}', '{"symbol": "B", "ltp": 1}', "junk", None, '{"ltp": 2}']
    good, bad = S.split_dlq(S.parse_ticks(spark.createDataFrame([(r,) for r in rows], "value string"), now=F.lit("2024-01-01").cast("timestamp")).withColumn("_corrupt", F.coalesce("_corrupt", F.when(F.col("symbol").isNull(), ""))))
    got = {r["symbol"]: r for r in good.withColumn("us", F.unix_micros("ts")).collect()}
    assert set(got) == {"A", "B"} and got["A"]["us"] == 1700000000123456 and got["B"]["vol"] == 0
    assert {r[0] for r in bad.collect()} == {"junk", "", '{"ltp": 2}'}


def test_files(spark, tmp_path):
    (tmp_path / "u.csv").write_text("tradingsymbol,exchange,subscribe\n aa ,N,Yes\nbb,N,0\ncc,N,\nAA,N,1\n")
    assert {r[0] for r in S.read_universe(spark, str(tmp_path / "u.csv")).collect()} == {"AA", "CC"}
    (tmp_path / "b.csv").write_text("ts,o,h,l,c,vol\n2024-01-01T00:00:00Z,1,2,0.5,1.5,7\n")
    assert S.read_bars_csv(spark, str(tmp_path / "b.csv")).first()["vol"] == 7
    bars = catalog.hour_bars(spark, SF)
    for _ in range(2):  # a second run replaces the days
        S.archive(bars, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.drop("day").exceptAll(bars.select(*back.drop("day").columns)).count() == 0 and back.count() == bars.count()
    assert {r[0] for r in S.expired(back, datetime.date(2024, 1, 10), 7).collect()} == {datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)}
    assert S.drop_expired(spark, str(tmp_path / "a"), datetime.date(2024, 1, 10), 7) == 2
    assert spark.read.parquet(str(tmp_path / "a")).agg(F.min("day")).first()[0] == datetime.date(2024, 1, 3)
    r = spark.createDataFrame([("A", 1.0, 3, None), ("B", 2.0, 4, 5)], "symbol string, pnl double, fast int, slow int")
    S.save_results(r, str(tmp_path / "r"), "r1", ["slow", "fast"])
    S.save_results(r.where("symbol = 'B'"), str(tmp_path / "r"), "r2", ["slow", "fast"])
    assert [(x["symbol"], x["params"]) for x in S.load_results(spark, str(tmp_path / "r")).collect()] == [("B", {"fast": "4", "slow": "5"})]
    assert {x["symbol"]: x["params"] for x in S.load_results(spark, str(tmp_path / "r"), "r1").collect()}["A"] == {"fast": "3"}


def test_contract_and_instruments(spark):
    df = spark.createDataFrame([("A", "BUY", 1), (None, "HOLD", -1), ("B", None, 0)], "symbol string, side string, qty int")
    got = [r[0] for r in df.select(S.violations(["symbol", "side"], {"qty": 0}, {"side": ["BUY", "SELL"]})).collect()]
    assert got == ["", "missing:symbol,minimum:qty,enum:side", "missing:side"]
    raw = spark.createDataFrame([(1, "FUT", "2024-01-25T00:00", None, 50), (1, "FUT", "2024-02-29", 0.1, None), (2, "EQ", None, 0.05, 1)], "instrument_token long, instrument_type string, expiry string, tick_size double, lot_size int")
    assert [tuple(r) for r in S.instruments(raw).select("instrument_token", "expiry", "tick_size", "lot_size").collect()] == [(1, datetime.date(2024, 2, 29), 0.1, 1)]
    assert S.publish(df.limit(1), "symbol").first()["value"] == '{"symbol":"A","side":"BUY","qty":1}'


def test_stream_equals_batch(spark, tmp_path):
    ticks = catalog.ticks(spark, SF)
    ticks.repartition(3).write.parquet(str(tmp_path / "t"))
    live = lambda: spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    want = {tuple(r) for r in B.tick_bars(ticks, 3600).select("symbol", "t", "o", "h", "l", "c", "vol", "n_trades").collect()}
    got = run(stream.stream_bars(live(), "1 hour", "60 days"), "complete", "whole")
    assert {tuple(r) for r in got.drop("start").collect()} == want
    twice = live().union(live())
    assert run(stream.first_seen(twice, ["id"], "60 days"), "append", "once").count() == ticks.count()
    assert run(stream.rates(live(), "2 hours", "1 hour", "60 days"), "complete", "rates").agg(F.sum("n")).first()[0] == 2 * ticks.count()
    bars = B.tick_bars(ticks, 3600).withColumn("start", F.timestamp_seconds("t"))
    bars.write.parquet(str(tmp_path / "b"))
    leg = lambda s: spark.readStream.schema(bars.schema).parquet(str(tmp_path / "b")).where(F.col("symbol") == s)
    both = run(stream.sync_legs(leg("click"), leg("error"), "60 days"), "append", "legs")
    assert both.count() == T.align(bars, "click", "error").count()


def test_fifo_and_admission_by_hand(spark):
    fills = catalog.fills(spark, SF)
    lots, realized = defaultdict(deque), defaultdict(float)
    for r in sorted(fills.collect(), key=lambda r: tuple(r[c] for c in catalog.ORDER)):
        q, held = r["qty"], lots[r["symbol"]]
        if r["side"] == "BUY":
            held.append([q, r["price"]])
            continue
        while q and held:
            n = min(q, held[0][0])
            realized[r["symbol"]] += n * (r["price"] - held[0][1])
            held[0][0] -= n
            q -= n
            if not held[0][0]:
                held.popleft()
    got = {r["symbol"]: r["realized"] for r in T.fifo_match(fills, catalog.ORDER).collect()}
    assert all(abs(got.get(s, 0.0) - v) < 1e-4 for s, v in realized.items())
    rows = [("L", 1, i, n) for i, n in enumerate([60.0, 50.0, 40.0, -1.0, None, 101.0, 0.5])] + [("L", 2, 9, 100.0), ("X", 1, 10, 1.0)]
    out = L.admit_orders(spark.createDataFrame(rows, "bucket string, day long, id long, notional double"), {"L": (100.0, 100.0)}, ["id"])
    full, big, bad = "exceeds_bucket_budget", "exceeds_max_per_trade", "bad_notional"
    assert {r["id"]: r["reason"] for r in out.collect()} == {0: None, 1: full, 2: None, 3: bad, 4: bad, 5: big, 6: full, 9: None, 10: big}
