"""What the operators of this subpackage share: tables, scratch tables in the cluster's shared folder, grouped batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z, nothing else; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a new one where that is unset
    (tests). Elsewhere it must be set, as a folder of the driver's machine alone would lose rows."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/tidemark-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back, so a lost executor costs no recomputation."""
    at = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold only complete groups, from batches sorted by keys; memory is one batch and its last group."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        same = np.ones(len(pdf), bool)
        for k in keys:
            same &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        cut = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pd.concat([*rest, pdf.iloc[:cut]], ignore_index=True)
            rest = [pdf.iloc[cut:]]
        elif rest and any(rest[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield pd.concat(rest, ignore_index=True)
            rest = [pdf]
        else:
            rest.append(pdf)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def bucket_blocks(rows: DataFrame, key: str, spread: Column, block: int) -> DataFrame:
    """Deal the members of each bucket into groups (key, lo, hi) of about 2 * block rows at most.

    Rows of a bucket of n rows fall into k = ceil(n / block) sides by ``spread``; group (lo, hi) holds sides lo and hi,
    so every pair of the bucket meets in exactly one group: (side, side) for rows of one side, else the two sides.
    Buckets of one row are left out, as they hold no pair. Hot buckets so become many groups rather than one task.
    """
    counts = rows.groupBy(key).count().where("count > 1").withColumnRenamed(key, "_key")
    k = F.ceil(F.col("count") / F.lit(block)).cast("int")
    dealt = (
        rows.join(counts, F.col(key) == F.col("_key")).drop("_key")
        .withColumn("side", F.pmod(spread, k.cast("long")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), k - 1)))
        .withColumn("lo", F.least("side", "_other"))
        .withColumn("hi", F.greatest("side", "_other"))
        .drop("count", "_other")
    )
    return dealt.repartition(parts(rows.sparkSession), key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")
