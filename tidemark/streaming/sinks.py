"""What streams are written to: a table of bars that takes batches by partitions under a commit log, a topic, good rows and dead letters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bars import merge_bars
from ..sources.tables import parse_ticks, publish, split_dlq

DAY = 86400
BAR = ["symbol", "t", "o", "h", "l", "c", "vol", "n_trades"]
_LOG = "query string, number long, day long, part int, at string"


def query_of(batch: DataFrame) -> str:
    """The id of the query whose batch this is: it stays with a checkpoint. Outside of a query: empty."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


class BarTable:
    """Bars in partitions by UTC day and ``buckets`` groups of symbols, changed batch by batch.

    A batch rewrites the partitions that it touches, each into a new folder under ``data``, and then commits: version v of
    ``log`` names the folder that holds each partition, and for each query the last batch that was taken in. A version
    appears by one rename, so readers see a batch whole or not at all; a batch that its query has committed changes nothing
    when it comes again, while the first batch of another query, or of a new checkpoint, is taken in. One writer at a time:
    of two that commit the same version the later one fails. A batch has a row for each symbol and time.
    """

    def __init__(self, spark: SparkSession, path: str, policy: str = "replace", buckets: int = 16):
        self.spark, self.path, self.policy, self.buckets = spark, path, policy, buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/log")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def log(self, version: int | None) -> DataFrame:
        """(query, number) rows for what is committed and (day, part, at) rows for where partitions are."""
        if version is None:
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log/v={version}")

    def _at(self, places: list) -> DataFrame:
        """The rows of partitions; as many names come to the driver as the table has partitions, no rows."""
        if not places:
            return self.spark.createDataFrame([], "symbol string, t long, o double, h double, l double, c double, vol long, n_trades long")
        return self.spark.read.parquet(*[f"{self.path}/data/{r['at']}/day={r['day']}/part={r['part']}" for r in places]).select(*BAR)

    def read(self, version: int | None = None, days: tuple[int, int] | None = None) -> DataFrame:
        """The table as of a version (the newest if none is named); ``days`` (first and last, since 1970) choose partitions."""
        held = self.versions()
        log = self.log(version if version is not None else held[-1] if held else None).where("at is not null")
        if days:
            log = log.where(F.col("day").between(*days))
        return self._at(log.collect())

    def upsert(self, batch: DataFrame, number: int, query: str | None = None) -> bool:
        """Merge a batch and commit; False if it had been committed already."""
        query = query_of(batch) if query is None else query
        held = self.versions()
        log = self.log(held[-1] if held else None)
        if not log.where((F.col("query") == query) & (F.col("number") >= number)).isEmpty():
            return False
        part = F.pmod(F.xxhash64("symbol"), F.lit(self.buckets)).cast("int")
        keyed = lambda df: df.withColumn("day", F.floor(F.col("t") / DAY)).withColumn("part", part)
        new = batch.select(*BAR).persist()
        try:
            touched = keyed(new).select("day", "part").distinct().collect()
            version, at = (held[-1] + 1 if held else 0), uuid.uuid4().hex
            if touched:
                names = self.spark.createDataFrame([(r["day"], r["part"]) for r in touched], "_day long, _part int")
                same = (F.col("day") == F.col("_day")) & (F.col("part") == F.col("_part"))
                old = self._at(log.join(names, same, "left_semi").collect())
                merged = merge_bars(old, new, self.policy) if not old.isEmpty() else new
                keyed(merged).repartition("day", "part").sortWithinPartitions("day", "part", "symbol", "t").write.partitionBy("day", "part").parquet(f"{self.path}/data/{at}")
                log = log.join(names, same, "left_anti").union(names.select(F.lit(None).cast("string"), F.lit(None).cast("long"), "_day", "_part", F.lit(at)))
        finally:
            new.unpersist()
        mine = self.spark.createDataFrame([(query, number, None, None, None)], _LOG)
        aside = f"{self.path}/log/_{at}"
        log.where(F.col("query").isNull() | (F.col("query") != query)).union(mine).coalesce(1).write.parquet(aside)
        fs, source = self._fs(aside)
        target = self._fs(f"{self.path}/log/v={version}")[1]
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")
        return True

    def vacuum(self, keep: int = 10) -> int:
        """Drop all versions but the last ``keep`` and the folders that none of these names; returns how many partitions went.
        Not while a batch is under way: its folder is not named yet."""
        held = self.versions()
        kept, gone = held[-keep:], held[:-keep]
        if not gone:
            return 0
        named = lambda vs: self.spark.read.schema(_LOG).parquet(*[f"{self.path}/log/v={v}" for v in vs]).where("at is not null").select("day", "part", "at").distinct()
        dropped = 0
        for r in named(gone).exceptAll(named(kept)).toLocalIterator():
            fs, at = self._fs(f"{self.path}/data/{r['at']}/day={r['day']}/part={r['part']}")
            dropped += fs.delete(at, True)
        for v in gone:
            fs, at = self._fs(f"{self.path}/log/v={v}")
            fs.delete(at, True)
        return dropped


def upsert_batches(path: str, policy: str = "replace", buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch of bars goes into the BarTable under path."""

    def write(batch: DataFrame, number: int) -> None:
        BarTable(batch.sparkSession, path, policy, buckets).upsert(batch, number)

    return write


def two_sinks(good: str, bad: str, value: str = "value") -> Callable[[DataFrame, int], None]:
    """For foreachBatch on raw messages: ticks go to ``good`` and the texts that are none to ``bad``, as Parquet in a folder
    for each query and batch. Both are written over when a batch comes again, so a batch that failed between its two writes
    leaves no row twice and none out."""

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_ticks(batch, value).persist()
        try:
            for rows, path in zip(split_dlq(parsed), (good, bad)):
                rows.write.mode("overwrite").parquet(f"{path}/query={query_of(batch)}/batch={number}")
        finally:
            parsed.unpersist()

    return write


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """What two_sinks has written to a path, without the names of queries and batches."""
    return spark.read.parquet(path).drop("query", "batch")


def write_topic(df: DataFrame, key: str, fmt: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Start a query that writes a stream's rows as JSON texts by key to a topic (fmt kafka, with its options) or to files."""
    out = publish(df, key) if fmt != "text" else publish(df, key).select("value")
    return out.writeStream.format(fmt).option("checkpointLocation", checkpoint).options(**options).outputMode("append").trigger(availableNow=True).start()
