"""Connected components of a link table, on Spark and within one batch."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (i, j): the smallest node of each one's component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a long, b long): component is the smallest node reachable.

    Alternating large-star and small-star steps: each round hangs neighbours on the smallest neighbour known, so that
    the rounds grow with the logarithm of the longest chain; they go on until a round changes nothing, as one must, since
    links only come to hang on smaller nodes. A round's links are written to the shared folder, and those of the round
    before deleted. Null ends and loops are ignored; an empty table gives an empty result.
    """
    spark, folder = links.sparkSession, scratch(links.sparkSession)

    def keep(rows: DataFrame, number: int) -> DataFrame:
        rows.write.parquet(f"{folder}/links-{number}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/links-{number}")

    links = links.where("a is not null and b is not null and a <> b")
    e = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), 0)
    before = None
    for number in count(1):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = keep(small, number)
        drop(spark, f"{folder}/links-{number - 1}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
