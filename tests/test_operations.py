"""Alerts, votes, scans of stored bars, first-in first-out, pair moments and stream settings, by hand or against plain code."""

import contextlib
import datetime
import io
import itertools
import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.functions import signals as S
from tidemark.operators import alerts as A
from tidemark.operators import tables as T
from tidemark.plans import catalog
from tidemark.sources import tables as Src
from tidemark.streaming import bars as stream

SF = "/root/testdata/sf0.001"


def test_alert_holds(spark):
    rule = A.Rule("Idle", "sent", "increase", "=", 0, 60, 60)
    rows = [("sent", "a", t, v) for t, v in [(0, 1), (30, 2), (60, 2), (90, 2), (120, 2), (150, 2), (180, 2), (210, 3), (240, 0), (300, 0)]]
    rows += [("sent", "a", 30, None), ("sent", "a", 30, 1), ("other", "a", 0, 9), ("sent", "b", 5, 4)]
    rows = [(m, k, t, None if v is None else float(v)) for m, k, t, v in rows]
    got = A.alerts(spark.createDataFrame(rows, "metric string, label string, t long, value double"), [rule])
    mine = [(r["t"], r["value"], r["since"], r["firing"]) for r in got.where("label = 'a'").orderBy("t").collect()]
    rise = [(0, 0), (30, 1), (60, 1), (90, 0), (120, 0), (150, 0), (180, 0), (210, 1), (240, 0), (300, 0)]
    since = [0, None, None, 90, 90, 90, 90, None, 240, 240]
    assert mine == [(t, float(v), s, s is not None and t - s >= 60) for (t, v), s in zip(rise, since)]
    assert got.count() == 11 and A.alerts(spark.createDataFrame([], "metric string, label string, t long, value double")).count() == 0


def test_k_of_n(spark):
    rows = [("a", 1, 4, 0), ("a", 2, 3, 1), ("a", 3, 3, 0), ("a", 4, 2, 2), ("a", 5, 0, 3), ("a", 6, 1, 3), ("a", 7, 3, 1)]
    got = S.k_of_n(spark.createDataFrame(rows, "symbol string, t long, up int, down int"), warmup=2).orderBy("t").collect()
    assert [r["state"] for r in got] == ["FLAT", "BUY", "BUY", "FLAT", "SELL", "SELL", "BUY"]
    assert [r["action"] for r in got] == ["FLAT", "BUY", "FLAT", "FLAT", "SELL", "FLAT", "BUY"]
    assert [r["confidence"] for r in got] == [0, 0.75, 0.75, 0, 0.75, 0.75, 0.75]


def test_bars_are_read_by_folder_and_filter(spark, tmp_path):
    bars = catalog.hour_bars(spark, SF).withColumn("tf", F.lit(3600))
    Src.write_bars(bars.unionByName(bars.withColumn("tf", F.lit(60))), str(tmp_path / "b"))
    some, start = ["click", "error"], bars.agg(F.min("t")).first()[0] + 5 * 3600
    got = Src.read_bars(spark, str(tmp_path / "b"), 3600, some, start, start + 86400)
    want = bars.where(F.col("symbol").isin(some) & F.col("t").between(start, start + 86400))
    assert got.count() == want.count() > 0 and got.select(*want.columns).exceptAll(want).count() == 0
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        got.explain("formatted")
    plan = text.getvalue()
    assert "PartitionFilters" in plan and "tf#" in plan.split("PartitionFilters")[1].split("\n")[0] and "date#" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert "In(symbol" in plan and "GreaterThanOrEqual(t" in plan


def test_fifo_against_lots(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), n, rng.choice(["BUY", "SELL"]), rng.choice([0, 1, 2, 5, 7]), float(rng.randint(1, 9))) for n in range(300)]
    df = spark.createDataFrame(rows, "symbol string, t long, side string, qty long, price double")
    lots, realized, matched = {"a": [], "b": []}, {"a": 0.0, "b": 0.0}, {"a": 0, "b": 0}
    for symbol, n, side, qty, price in rows:
        if side == "BUY" and qty:
            lots[symbol].append([n, qty, price])
        while side == "SELL" and qty and lots[symbol]:
            lot = lots[symbol][0]
            k = min(qty, lot[1])
            realized[symbol], matched[symbol], qty, lot[1] = realized[symbol] + k * (price - lot[2]), matched[symbol] + k, qty - k, lot[1] - k
            if not lot[1]:
                lots[symbol].pop(0)
    got = {r["symbol"]: (r["realized"], r["matched"]) for r in T.fifo_match(df, ["t"]).collect()}
    assert got == {s: (realized[s], matched[s]) for s in "ab"}
    assert sorted((r["symbol"], r["t"], r["open"]) for r in T.open_lots(df, ["t"]).collect()) == sorted((s, n, q) for s in "ab" for n, q, _ in lots[s])


@pytest.mark.parametrize("block,slice_bars", [(256, 4096), (3, 7)])
def test_pair_moments(spark, block, slice_bars):
    rng = np.random.default_rng(1)
    x = {s: {int(t): 1e6 + rng.random() for t in np.nonzero(rng.random(40) < 0.6)[0]} for s in "abcdefgh"}
    x["flat"] = dict.fromkeys(range(40), 5.0)
    rows = [(s, t, v) for s, d in x.items() for t, v in d.items()] + [(None, 1, 2.0), ("a", None, 1.0), ("b", 1, None)]
    df = spark.createDataFrame(rows, "symbol string, t long, c double")
    got = {(r["a"], r["b"]): r for r in T.pair_stats(df, 8, block, slice_bars).collect()}
    for a, b in itertools.combinations(sorted(x), 2):
        both = sorted(x[a].keys() & x[b].keys())
        assert ((a, b) in got) == (len(both) >= 8)
        if len(both) >= 8:
            r, u, v = got[a, b], np.array([x[a][t] for t in both]), np.array([x[b][t] for t in both])
            assert r["n"] == len(both)
            if "flat" in (a, b):
                assert r["rho"] is None
            else:
                assert abs(r["rho"] - np.corrcoef(u, v)[0, 1]) < 1e-6 and abs(r["beta"] - np.polyfit(u - u.mean(), v, 1)[0]) < 1e-6
    assert T.pair_stats(df.limit(0), 8).count() == 0


def test_pair_stats_shuffles_few_copies_of_the_bars(spark):
    # 60 tiles: dealing each bar to the tasks of every tile took 12.7 MB of shuffle files; half the symbols end 10 bars after the rest begin
    there = np.zeros((480, 50))
    there[:240, :30], there[240:, 20:] = 1, 1
    there *= np.random.default_rng(2).random(there.shape) < 0.9
    df = spark.createDataFrame([(f"s{i}", int(t), float((i * 7 + t * t) % 23)) for i, t in zip(*np.nonzero(there))], "symbol string, t long, c double").localCheckpoint()
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {x: x.stat().st_size for f in folders for x in Path(f).rglob("shuffle_*.data")}
    before = files()
    got = {(r["a"], r["b"]): r["n"] for r in T.pair_stats(df, 9, block=8).collect()}
    size = sum(n for x, n in files().items() if x not in before)
    n = (there @ there.T).astype(int)
    assert got == {(f"s{i}", f"s{j}"): n[i, j] for i in range(480) for j in range(480) if f"s{i}" < f"s{j}" and n[i, j] >= 9}
    assert size < 5e6, size


def test_pair_stats_writes_no_moments_of_many_pairs(spark):
    # 44,850 pairs over 8 slices of time: their moments of each slice took 17 MB of shuffle files
    there = np.random.default_rng(3).random((300, 60)) < 0.8
    df = spark.createDataFrame([(f"s{i}", int(t), float((i * 7 + t * t) % 23)) for i, t in zip(*np.nonzero(there))], "symbol string, t long, c double").localCheckpoint()
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {x: x.stat().st_size for f in folders for x in Path(f).rglob("shuffle_*.data")}
    before = files()
    got = {(r["a"], r["b"]): r["n"] for r in T.pair_stats(df, 30, block=40, slice_bars=8).collect()}
    size = sum(n for x, n in files().items() if x not in before)
    n = there.astype(int) @ there.T
    assert got == {(f"s{i}", f"s{j}"): n[i, j] for i in range(300) for j in range(300) if f"s{i}" < f"s{j}" and n[i, j] >= 30}
    assert size < 3e6, size


def test_pair_stats_of_few_long_series_adds_up_slices(spark):
    rng = np.random.default_rng(4)
    x = {s: dict(zip(map(int, np.nonzero(rng.random(3000) < 0.7)[0]), rng.random(3000))) for s in "abc"}
    assert T._dealing(sum(map(len, x.values())), 3, 3000, 2, 100)[0] > 1
    df = spark.createDataFrame([(s, t, float(v)) for s, d in x.items() for t, v in d.items()], "symbol string, t long, c double")
    got = {(r["a"], r["b"]): r for r in T.pair_stats(df, 1000, block=2, slice_bars=100).collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), r in got.items():
        both = sorted(x[a].keys() & x[b].keys())
        u, v = np.array([x[a][t] for t in both]), np.array([x[b][t] for t in both])
        assert r["n"] == len(both) and abs(r["rho"] - np.corrcoef(u, v)[0, 1]) < 1e-9 and abs(r["beta"] - np.polyfit(u - u.mean(), v, 1)[0]) < 1e-9
    # hour bars of a year for 90,000 symbols: the moments of three slices would go through files, three for each pair
    assert T._dealing(3_000_000, 90_000, 8760, 256, 4096) == (1, 8)
    assert T._dealing(10_000_000, 100, 100_000, 256, 4096) == (25, 1)
    assert T._dealing(0, 0, 0, 256, 4096) == (1, 1)


def test_sums_and_closes_carry_over_stretches(spark):
    events = catalog.orders(spark, SF).select("bucket", "t", F.col("order_id").alias("id"))
    held = catalog.orders(spark, SF).select("bucket", F.col("t").alias("created"), (F.col("t") + (F.col("cust") % 7 + 1) * 86400).alias("expires"), "notional")
    one, many = (sorted((r["bucket"], r["t"], r["id"], round(r["active"], 2)) for r in T.active_at(events, held, w).collect()) for w in (10**12, 86400))
    assert one == many
    caps = spark.createDataFrame([("1", 1e6)], "bucket string, cap double")
    for r in T.headroom(events, held, caps).collect():
        assert r["headroom"] == (max(0.0, 1e6 - r["active"]) if r["bucket"] == "1" else 0.0)
    bars = catalog.hour_bars(spark, SF)
    asks = bars.select("symbol", (F.col("t") + 7 * 3600 + 5).alias("t"), F.xxhash64("t").alias("id"))
    one, many = (sorted(map(tuple, T.asof_price(asks, bars, width=w).collect())) for w in (10**12, 3 * 3600))
    assert one == many


def test_equity_costs_round_as_their_sql(spark, tmp_path):
    # 1250.25 less 2 basis points is 1249.99995, just below a half at 4 places once scaled; so are other prices of .25 and .75
    kinds = itertools.product(range(25, 400000, 50), (1, 2), "AN")
    rows = [(n, 1, 1, line, 1.0, c / 100, 0.0, flag, datetime.datetime(1995, 1, 2)) for n, (c, line, flag) in enumerate(kinds)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["h9_cost_equity"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL['h9_cost_equity']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_stream_settings_and_health(spark, tmp_path):
    ticks = catalog.ticks(spark, SF).withColumn("seen", F.col("ts") + F.expr("interval 2 seconds"))
    ticks.repartition(3).write.parquet(str(tmp_path / "t"))
    live = lambda: spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    q = stream.health(live(), "1 hour", "1 hour").writeStream.format("memory").queryName("health").outputMode("complete").option("checkpointLocation", str(tmp_path / "h")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("health").agg(F.sum("n"), F.min("mean_late"), F.max("most_late")).first()
    assert got[0] == ticks.count() and abs(got[1] - 2) < 1e-5 and abs(got[2] - 2) < 1e-5
    asked, seen = [], []

    def read(session):
        asked.append(1)  # settings change from batch to batch
        return session.createDataFrame([("click", len(asked))], "symbol string, version int")

    def write(batch, number):
        seen.append({(r["symbol"] == "click", r["version"]) for r in batch.select("symbol", "version").distinct().collect()})

    q = live().writeStream.foreachBatch(stream.with_settings(read, ["symbol"], write)).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(seen) == 3 and all(s == {(True, n + 1), (False, None)} for n, s in enumerate(seen))
