"""Sources and sinks: ticks, universe, CSV bars, validation with a dead-letter side, the daily archive, result runs."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICK = "symbol string, event_ts long, ltp double, vol long"
BAR = "ts timestamp, o double, h double, l double, c double, vol long"


def parse_ticks(raw: DataFrame, value: str = "value", now: Column | None = None) -> DataFrame:
    """Ticks of a column of JSON text, batch or stream: nanoseconds to time (missing: ``now``), missing volume to 0; the
    text itself in _corrupt where it is no tick."""
    x = raw.withColumn("_j", F.from_json(F.col(value).cast("string"), TICK))
    ok = F.col("_j.symbol").isNotNull() & F.col("_j.ltp").isNotNull()
    ts = F.coalesce(F.timestamp_micros(F.expr("(_j.event_ts - pmod(_j.event_ts, 1000)) div 1000")), F.current_timestamp() if now is None else now)
    return x.select(F.col("_j.symbol").alias("symbol"), ts.alias("ts"), F.col("_j.ltp").alias("ltp"), F.coalesce("_j.vol", F.lit(0)).cast("long").alias("vol"), F.when(~ok, F.col(value).cast("string")).alias("_corrupt"))


def read_ticks(spark: SparkSession, fmt: str, stream: bool = True, now: Column | None = None, **options: str) -> DataFrame:
    """parse_ticks() of a source of messages, a stream or a table: a topic (fmt kafka with its options), or files with a JSON
    text a line (fmt text, with path) or a column ``value`` (other formats, with path)."""
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    if fmt not in ("kafka", "text"):
        reader = reader.schema("value string")
    return parse_ticks(reader.load(), now=now)


def split_dlq(ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good ticks, and the texts that are none."""
    return ticks.where("_corrupt is null").drop("_corrupt"), ticks.where("_corrupt is not null").select("_corrupt")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Names to subscribe to: 1, true, y or yes, and where the column is empty."""
    x = spark.read.csv(path, header=True)
    flag = F.lower(F.trim(F.coalesce("subscribe", F.lit("1")))) if "subscribe" in x.columns else F.lit("1")
    return x.where(flag.isin("", "1", "true", "y", "yes")).select(F.upper(F.trim("tradingsymbol")).alias("symbol")).distinct()


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR).csv(path, header=True)


def publish(df: DataFrame, key: str) -> DataFrame:
    """(key, value) for a topic or file sink: the rows as JSON text."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def violations(required: list[str], least: dict[str, float], among: dict[str, list[str]]) -> Column:
    """Comma-joined reasons why a row breaks the contract; empty if it keeps it."""
    checks = [(F.col(c).isNull(), f"missing:{c}") for c in required] + [(F.col(c) < v, f"minimum:{c}") for c, v in least.items()] + [(~F.col(c).isin(v), f"enum:{c}") for c, v in among.items()]
    return F.concat_ws(",", *[F.when(c, F.lit(n)) for c, n in checks])


def archive(bars: DataFrame, path: str) -> None:
    """Bars(t seconds) into zstd Parquet by UTC day, replacing the days that occur; a day's symbols lie together."""
    day = F.to_date(F.timestamp_seconds("t"))
    out = bars.withColumn("day", day).repartition("day", "symbol").sortWithinPartitions("day", "symbol", "t")
    out.write.partitionBy("day").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def expired(archived: DataFrame, today: datetime.date, keep_days: int) -> DataFrame:
    """Days of the archive that are older than keep_days."""
    return archived.select("day").distinct().where(F.col("day") < F.lit(today - datetime.timedelta(days=keep_days)))


def drop_expired(spark: SparkSession, path: str, today: datetime.date, keep_days: int) -> int:
    """Remove the archive's days that are older than keep_days; returns how many went. Only names of days come to the driver."""
    gone = 0
    for r in expired(spark.read.parquet(path), today, keep_days).toLocalIterator():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={r['day']}")
        gone += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone


def save_results(results: DataFrame, path: str, run_id: str, params: list[str]) -> None:
    """One run into its own partition; named columns become one canonical JSON text (keys sorted, nulls left out)."""
    packed = results.withColumn("params", F.to_json(F.struct(*sorted(params)))).drop(*params).withColumn("run_id", F.lit(run_id))
    packed.write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load_results(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A run's rows, the latest run's if none is named, with params as a map."""
    x = spark.read.option("basePath", path).parquet(path)
    at = F.lit(run_id) if run_id else x.agg(F.max("run_id")).first()[0]
    return x.where(F.col("run_id") == at).withColumn("params", F.from_json("params", "map<string,string>"))


def instruments(raw: DataFrame) -> DataFrame:
    """Futures and options of an instrument list, the newest row of each token; tick 0.05 and lot 1 where missing."""
    x = raw.where(F.col("instrument_type").isin("FUT", "CE", "PE"))
    x = x.withColumn("expiry", F.to_date(F.substring("expiry", 1, 10))).fillna(0.05, ["tick_size"]).fillna(1, ["lot_size"])
    rest = [c for c in x.columns if c != "instrument_token"]
    return x.groupBy("instrument_token").agg(F.max(F.struct("expiry", *[c for c in rest if c != "expiry"])).alias("x")).select("instrument_token", *[f"x.{c}" for c in rest])


def write_bars(bars: DataFrame, path: str) -> None:
    """bars(tf, symbol, t, ...) as Parquet in folders by timeframe and UTC day, in order of symbol and time within files, so
    that scans of read_bars skip folders and row groups. The days of a timeframe that occur are replaced, so a run that is
    repeated changes nothing; give whole days."""
    dated = bars.withColumn("date", F.to_date(F.timestamp_seconds("t")))
    dated.repartition("tf", "date").sortWithinPartitions("tf", "date", "symbol", "t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tf", "date").parquet(path)


def read_bars(spark: SparkSession, path: str, tf: int, symbols: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Bars of one timeframe that write_bars wrote: of the symbols named (None: all), start <= t <= end (None: open).

    The timeframe and the days choose folders, symbols and times are pushed down to the scan. Not sorted: sort where
    order matters.
    """
    rows = spark.read.parquet(path).where(F.col("tf") == tf)
    day = lambda s: F.to_date(F.timestamp_seconds(F.lit(s)))
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(symbols))
    if start is not None:
        rows = rows.where((F.col("date") >= day(start)) & (F.col("t") >= start))
    if end is not None:
        rows = rows.where((F.col("date") <= day(end)) & (F.col("t") <= end))
    return rows.drop("date")
