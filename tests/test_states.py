"""Streams with keyed state against the batch operators over the same rows: restarts, warm-up, timers, flushes and sinks."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tidemark.functions.signals import spread_z
from tidemark.operators import bars as B
from tidemark.operators import ledgers as L
from tidemark.operators import pairs as P
from tidemark.operators import tables as T
from tidemark.plans import catalog, ledgers, research
from tidemark.sources import tables as S
from tidemark.streaming import bars as SB
from tidemark.streaming import sinks, states

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    for k, v in states.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k in states.ROCKSDB:
        spark.conf.unset(k)


class Feed:
    """A folder that a stream reads in the order in which parts are put there."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0
        os.makedirs(self.path)

    def put(self, df):
        df.coalesce(1).write.parquet(f"{self.path}/_{self.n}")
        (file,) = Path(f"{self.path}/_{self.n}").glob("part-*")
        os.rename(file, f"{self.path}/{self.n:04d}.parquet")
        os.utime(f"{self.path}/{self.n:04d}.parquet", (1_700_000_000 + self.n * 10,) * 2)
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/*.parquet")


def drain(df, out, checkpoint):
    """Run a stream over all that is there; what it has put out so far."""
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return df.sparkSession.read.schema(df.schema).parquet(str(out))


def signals(df):
    number = lambda v: None if v is None or v != v else round(v, 6)
    return {(r.symbol, r.t, number(r.z), r.action, r.reason, r.position) for r in df.collect()}


RULE = P.Thresholds(1.0, 0.2, 3.0, 6 * 3600, 1200)


@pytest.fixture(scope="module")
def aligned(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("aligned") / "a")
    T.align_pairs(catalog.hour_bars(spark, SF), 50).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def batch_signals(aligned):
    return signals(P.pair_signals(spread_z(aligned, 60).select("symbol", "t", "z"), RULE))


CUTS = [0, 1704567200, 1705067200, 1705567200, 1706067200, 1 << 40]


def between(df, a, b):
    return df.where((F.col("t") >= a) & (F.col("t") < b))


def test_pairs_on_a_stream_with_restart(spark, aligned, batch_signals, tmp_path):
    feed = Feed(spark, tmp_path / "in", aligned.schema)
    for a, b in zip(CUTS[:3], CUTS[1:]):
        feed.put(between(aligned, a, b))
    run = lambda: drain(states.stream_pairs(feed.stream(), RULE, 60, grace="365 days"), tmp_path / "out", tmp_path / "c")
    run()
    feed.put(between(aligned, CUTS[1], CUTS[2]))  # repeated rows change nothing
    for a, b in zip(CUTS[3:], CUTS[4:]):
        feed.put(between(aligned, a, b))
    out = run()  # from the checkpoint
    assert out.where("timed").count() == 0
    assert signals(out) == batch_signals and any(a for *_, a, _, _ in batch_signals)


@pytest.mark.parametrize("mode", ["raw", "log"])
def test_pairs_from_history(spark, aligned, tmp_path, mode):
    history, rest = between(aligned, 0, CUTS[2]), between(aligned, CUTS[2], CUTS[-1])
    feed = Feed(spark, tmp_path / "in", aligned.schema)
    for a, b in zip(CUTS[2:], CUTS[3:]):
        feed.put(between(rest, a, b))
    warm = states.warm_up(history, RULE, 60, mode=mode)
    got = signals(drain(states.stream_pairs(feed.stream(), RULE, 60, mode=mode, grace="365 days", history=warm), tmp_path / "out", tmp_path / "c"))
    want = signals(P.pair_signals(spread_z(aligned, 60, mode=mode).select("symbol", "t", "z"), RULE).where(F.col("t") >= CUTS[2]))
    assert got == want and any(a for *_, a, _, _ in want)
    assert warm.where("position <> 0").count()  # so what is open goes on


def test_timers_close_what_no_row_closes(spark, tmp_path):
    # scores come from a spread that jumps and comes back: A|B enters and then has no more rows, C|D only moves time on
    hour = 3600
    def row(symbol, k, y):
        return symbol, 1_704_067_200 + k * hour, float(k % 7), y
    jump = [0.1, -0.1] * 10 + [9.0, 1.2]
    held = [row("A|B", k, 2.0 * (k % 7) + v) for k, v in enumerate(jump)]
    clock = lambda ks: [row("C|D", k, 2.0 * (k % 7)) for k in ks]
    schema = "symbol string, t long, x double, y double"
    rule = P.Thresholds(2.5, 0.0, 99.0, 5 * hour)
    feed = Feed(spark, tmp_path / "in", spark.createDataFrame([], schema).schema)
    for rows in (held, clock(range(22, 26)), clock(range(27, 32)), clock(range(32, 34))):
        feed.put(spark.createDataFrame(rows, schema))
    out = drain(states.stream_pairs(feed.stream(), rule, 20, grace="1 second"), tmp_path / "out", tmp_path / "c")
    (entry,) = out.where("action like 'ENTER%'").collect()
    assert entry.symbol == "A|B" and entry.t == 1_704_067_200 + 21 * hour
    assert [(r.symbol, r.t, r.action, r.reason, r.position) for r in out.where("timed").collect()] == [("A|B", entry.t + 5 * hour, "EXIT", "timeout", 0)]
    # the same at a local time: the entry's day ends at 09:30, before five hours are over
    day = (entry.t + 19800) // 86400 * 86400 - 19800
    minute = (entry.t - day) // 60 + 90
    out = drain(states.stream_pairs(feed.stream(), P.Thresholds(2.5, 0.0, 99.0, 5 * hour, minute), 20, grace="1 second"), tmp_path / "out2", tmp_path / "c2")
    assert [(r.t, r.reason) for r in out.where("timed").collect()] == [(day + minute * 60, "flatten")]


def test_legs_of_a_table_of_pairs(spark, tmp_path):
    rows = research.arrivals(spark, "/root/testdata/sf0.001").persist()
    feed = Feed(spark, tmp_path / "in", rows.schema)
    bounds = [r[0] for r in rows.selectExpr("explode(percentile(seq, array(0.25, 0.5, 0.75)))").collect()]
    for a, b in zip([0, *bounds], [*bounds, 1 << 60]):
        feed.put(rows.where((F.col("seq") >= a) & (F.col("seq") < b)))
    got = drain(states.stream_legs(feed.stream(), ["seq", "id"]), tmp_path / "out", tmp_path / "c")
    want = states.sync_legs(rows, ["seq", "id"])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert got.groupBy("symbol", "t").count().where("count > 1").count() == 0
    by_hand, legs, last = set(), {}, {}
    for r in rows.orderBy("seq", "id").collect():
        legs[r.symbol, r.leg] = (r.t, r.px)
        a, b = legs.get((r.symbol, "a")), legs.get((r.symbol, "b"))
        if a and b and a[0] == b[0] and a[0] > last.get(r.symbol, -1):
            last[r.symbol] = a[0]
            by_hand.add((r.symbol, a[0], a[1], b[1]))
    assert by_hand == {tuple(r) for r in want.collect()} and by_hand


def test_positions_and_admissions_with_restart(spark, tmp_path):
    fills = catalog.fills(spark, "/root/testdata/sf0.001").select(*catalog.ORDER, "side").persist()
    cuts = [r[0] for r in fills.selectExpr("explode(percentile(t, array(0.3, 0.6)))").collect()]
    feed = Feed(spark, tmp_path / "f", fills.schema)
    out = None
    for a, b in zip([0, *cuts], [*cuts, 1 << 60]):
        feed.put(between(fills, a, b))
        out = drain(states.stream_positions(feed.stream(), catalog.ORDER), tmp_path / "fo", tmp_path / "fc")  # a run each: restarts
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in L.wac_positions(fills, catalog.ORDER).collect()}

    orders = L.cash_notional(ledgers.requests(spark, "/root/testdata/sf0.001")).select("bucket", F.floor(F.col("t") / 86400 / 30).alias("day"), "id", "notional", "t").persist()
    want = {tuple(r) for r in L.admit_orders(orders, ledgers.BUDGETS, ["t", "id"]).collect()}
    feed = Feed(spark, tmp_path / "o", orders.schema)
    cuts = [r[0] for r in orders.selectExpr("explode(percentile(t, array(0.3, 0.6)))").collect()]
    for a, b in zip([0, *cuts], [*cuts, 1 << 60]):
        feed.put(between(orders, a, b))
        df = states.stream_admissions(feed.stream(), ledgers.BUDGETS, ["t", "id"], day_s=30 * 86400, keep=1)
        out = drain(df, tmp_path / "oo", tmp_path / "oc")
    assert {tuple(r) for r in out.collect()} == want and {r[-1] for r in want} >= {None, "exceeds_bucket_budget", "exceeds_max_per_trade"}
    used = spark.read.format("statestore").option("stateVarName", "used").load(str(tmp_path / "oc"))
    newest = orders.agg(F.max("day")).first()[0]
    assert used.count() and used.selectExpr("min(user_map_key.day)").first()[0] >= newest - 3 if "user_map_key" in used.columns else used.count()


def test_held_windows_complete_the_bars(spark, tmp_path):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    ticks = catalog.ticks(spark, SF)
    feed = Feed(spark, tmp_path / "in", ticks.schema)
    for a, b in ((0, 10), (10, 20), (20, 32)):
        feed.put(ticks.where((F.dayofmonth("ts") > a) & (F.dayofmonth("ts") <= b)))
    out = drain(SB.stream_bars(feed.stream(), "1 hour", "5 hours"), tmp_path / "out", tmp_path / "c")
    held = SB.held_bars(spark, str(tmp_path / "c"))
    cols = ["symbol", "t", "o", "h", "l", "c", "vol", "n_trades"]
    want = [tuple(r) for r in B.tick_bars(ticks, 3600).select(*cols).collect()]
    got = [tuple(r) for r in out.select(*cols).union(held.select(*cols)).collect()]
    assert held.count() and sorted(got) == sorted(want)
    for k, v in states.ROCKSDB.items():
        spark.conf.set(k, v)


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_table_takes_batches_by_partitions(spark, tmp_path):
    bars = B.tick_bars(catalog.ticks(spark, SF), 3600).persist()
    table = sinks.BarTable(spark, str(tmp_path / "t"), "additive", buckets=4)
    assert table.read().count() == 0 and table.upsert(bars, 0, "q")
    whole = size(tmp_path / "t/data")
    change = bars.where("symbol = 'click' and t between 1705000000 and 1705080000")
    assert table.upsert(change, 1, "q") and change.count()
    assert size(tmp_path / "t/data") - whole < whole / 10  # two days of a bucket, not the table
    want = lambda n: {tuple(r) for r in bars.join(change.select("symbol", "t", F.lit(n).alias("n")), ["symbol", "t"], "left").select("symbol", "t", (F.col("vol") * (1 + F.coalesce("n", F.lit(0)))).alias("vol")).collect()}
    now = lambda **k: {tuple(r) for r in table.read(**k).select("symbol", "t", "vol").collect()}
    assert now() == want(1)
    assert not table.upsert(change, 1, "q") and not table.upsert(bars, 0, "q") and now() == want(1)  # replayed batches
    assert table.upsert(change, 0, "another checkpoint") and now() == want(2)
    assert now(version=0) == want(0) and table.versions() == [0, 1, 2]
    assert {r[0] for r in table.read(days=(19740, 19740)).select("t").distinct().collect()} == {r[0] for r in bars.where(F.floor(F.col("t") / 86400) == 19740).select("t").distinct().collect()}
    # a writer that died before its commit leaves the table as it was
    torn = sinks.BarTable(spark, str(tmp_path / "t"), "additive", buckets=4)
    torn.versions = lambda: [0, 1]
    with pytest.raises(RuntimeError):
        torn.upsert(change, 2, "q")
    assert now() == want(2)
    assert table.vacuum(1) > 0 and now() == want(2) and table.versions() == [2] and table.vacuum(1) == 0
    assert table.upsert(change.limit(0), 2, "q") and now() == want(2)


def test_table_from_a_stream(spark, tmp_path):
    bars = B.tick_bars(catalog.ticks(spark, "/root/testdata/sf0.001"), 3600).persist()
    feed = Feed(spark, tmp_path / "in", bars.schema)
    for k in range(3):
        feed.put(bars.where(F.pmod(F.xxhash64("t"), F.lit(3)) == k))
    def run(checkpoint):
        q = feed.stream().writeStream.foreachBatch(sinks.upsert_batches(str(tmp_path / "t"), buckets=2)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        return sinks.BarTable(spark, str(tmp_path / "t"), buckets=2)
    cols = sinks.BAR
    want = sorted(tuple(r) for r in bars.select(*cols).collect())
    assert sorted(tuple(r) for r in run("c").read().collect()) == want
    again = run("d")  # a new checkpoint reads all anew
    assert sorted(tuple(r) for r in again.read().collect()) == want and len(again.versions()) == 6


def test_good_rows_and_dead_letters_once(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for k in range(2):
        (tmp_path / f"in/{k}.txt").write_text(f'{{"symbol": "A", "event_ts": {1700000000 + k}000000000, "ltp": 5.5}}\njunk {k}\n')
    write = sinks.two_sinks(str(tmp_path / "good"), str(tmp_path / "bad"))
    died = []

    def fragile(batch, number):
        if number == 1 and not died:  # dies between the two writes
            died.append(S.split_dlq(S.parse_ticks(batch))[0].write.mode("overwrite").parquet(f"{tmp_path}/good/query={sinks.query_of(batch)}/batch={number}"))
            raise RuntimeError("killed")
        write(batch, number)

    def run():
        raw = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(tmp_path / "in"))
        q = raw.writeStream.foreachBatch(fragile).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(300)

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert sorted(r["ltp"] for r in sinks.read_sink(spark, str(tmp_path / "good")).collect()) == [5.5, 5.5]
    assert sorted(r[0] for r in sinks.read_sink(spark, str(tmp_path / "bad")).collect()) == ["junk 0", "junk 1"]


def test_ticks_and_topics_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, 2.0), ("B", 2, None)], "symbol string, event_ts long, ltp double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sinks.write_topic(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "symbol", "text", str(tmp_path / "c"), path=str(tmp_path / "out"))
    assert q.awaitTermination(300)
    good, bad = S.split_dlq(S.read_ticks(spark, "text", stream=False, path=str(tmp_path / "out")))
    assert [(r.symbol, r.ltp, r.vol) for r in good.collect()] == [("A", 2.0, 0)] and bad.count() == 1
    assert S.read_ticks(spark, "text", path=str(tmp_path / "out")).isStreaming
