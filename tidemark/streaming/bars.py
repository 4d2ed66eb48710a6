"""Bars, deduplication and leg joins on streams; the same columns as the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str, grace: str) -> DataFrame:
    """Bars of a stream of ticks(symbol, ts, id, ltp, vol). A bar is final once the watermark, ``grace`` behind the newest
    tick, has passed its end; ticks later than that are dropped (and counted in the query's progress)."""
    key = F.struct("ts", "id")
    g = ticks.withWatermark("ts", grace).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("ltp", key).alias("o"), F.max("ltp").alias("h"), F.min("ltp").alias("l"), F.max_by("ltp", key).alias("c"),
        F.sum(F.coalesce("vol", F.lit(0))).alias("vol"), F.count("*").alias("n_trades"),
    )
    return g.select("symbol", F.col("w.start").alias("start"), F.unix_seconds("w.start").alias("t"), "o", "h", "l", "c", "vol", "n_trades")


def first_seen(df: DataFrame, keys: list[str], grace: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark("ts", grace).dropDuplicatesWithinWatermark(keys)


def sync_legs(a: DataFrame, b: DataFrame, grace: str) -> DataFrame:
    """(start, x, y) where both streams of bars, each of one symbol, have one of the same start; late ones meet within
    ``grace``. For a table of pairs see states.stream_legs."""
    left = a.withWatermark("start", grace).select("start", F.col("c").alias("x"))
    right = b.withWatermark("start", grace).select(F.col("start").alias("_start"), F.col("c").alias("y"))
    return left.join(right, F.col("start") == F.col("_start")).select("start", "x", "y")


def rates(events: DataFrame, width: str, slide: str, grace: str) -> DataFrame:
    """Rows by symbol in sliding windows."""
    g = events.withWatermark("ts", grace).groupBy("symbol", F.window("ts", width, slide).alias("w"))
    return g.agg(F.count("*").alias("n")).select("symbol", F.col("w.start").alias("start"), "n")


def held_bars(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows of stream_bars() for the windows that a stopped query in append mode still holds, read from the state in its
    checkpoint: with what it has put out they are all bars of the ticks it has seen.

    They are not final: a query that goes on from the checkpoint puts these windows out once they are, with later ticks in
    them, so write them where a bar replaces an earlier one of its symbol and time.
    """
    state = spark.read.format("statestore").load(checkpoint)
    # the aggregates in their order, by place: names of a first and a last value are the same
    named = "struct<o:double,first:struct<ts:timestamp,id:bigint>,h:double,l:double,c:double,last:struct<ts:timestamp,id:bigint>,vol:bigint,n_trades:bigint>"
    held = state.select(F.col("key.symbol").alias("symbol"), F.col("key.window.start").alias("start"), F.col("value").cast(named).alias("v")).select("symbol", "start", "v.*")
    return held.select("symbol", "start", F.unix_seconds("start").alias("t"), "o", "h", "l", "c", "vol", "n_trades")


def health(ticks: DataFrame, width: str, grace: str) -> DataFrame:
    """How a stream of ticks(symbol, ts, seen, ...) is doing in windows of event time: rows, seconds from event to ``seen``
    (mean and largest; at least 0) and the newest tick. Rows under way and dropped are in the query's progress (state)."""
    late = F.greatest(F.lit(0.0), F.col("seen").cast("double") - F.col("ts").cast("double"))
    g = ticks.withWatermark("ts", grace).groupBy("symbol", F.window("ts", width).alias("w"))
    return g.agg(F.count("*").alias("n"), F.avg(late).alias("mean_late"), F.max(late).alias("most_late"), F.max("ts").alias("newest")).select("symbol", F.col("w.start").alias("start"), "n", "mean_late", "most_late", "newest")


def with_settings(read: Callable[[SparkSession], DataFrame], keys: list[str], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is joined with the settings as they are then, which read(spark) gives anew, and handed to
    ``write``. Rows without settings have nulls in their columns."""

    def each(batch: DataFrame, number: int) -> None:
        write(batch.join(read(batch.sparkSession), keys, "left"), number)

    return each
