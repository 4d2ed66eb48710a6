"""Mixing sources to target weights by Pfair scheduling of fixed-size blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, scratch

RUN = 4096  # blocks of a source that a row of the plan holds
HELD = 1_000_000  # blocks of the plan that the driver holds at a time
BUCKETS = 4096  # hash ranges that a source's rows are numbered in


def shares(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Weights as whole numbers in exactly their ratios."""
    ratio = {s: w.as_integer_ratio() for s, w in weights.items()}
    common = lcm(*(d for _, d in ratio.values()))
    whole = {s: n * (common // d) for s, (n, d) in ratio.items()}
    least = gcd(*whole.values())
    return {s: n // least for s, n in whole.items()}


def windows(k: int, share: int, period: int) -> tuple[int, int]:
    """Release and deadline slots of a source's k-th block (from 0): it runs in a slot from release to deadline - 1."""
    return k * period // share, -(-(k + 1) * period // share)


def turns(share: dict[str | None, int]) -> Iterator[tuple[str | None, int, int, int]]:
    """(source, block, release, deadline) slot after slot, without end, earliest deadline first.

    Every block runs in its window, which keeps each source within less than one block of its due share at any time. The
    shares may be of any size: only a block a source is held.
    """
    period = sum(share.values())
    names = sorted(share, key=lambda s: (s is None, s or ""))
    waiting = [(0, i, 0) for i in range(len(names))]
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (windows(k, share[names[i]], period)[1], i, k, release))
        deadline, i, k, release = heapq.heappop(ready)
        yield names[i], k, release, deadline
        heapq.heappush(waiting, (windows(k + 1, share[names[i]], period)[0], i, k + 1))
        slot += 1


def schedule(share: dict[str | None, int]) -> dict[str | None, list[int]]:
    """One period of the schedule, of as many slots as there are shares: the slots of each source's blocks.

    It ends with every lag at zero and repeats.
    """
    out: dict[str | None, list[int]] = {s: [] for s in sorted(share, key=lambda s: (s is None, s or ""))}
    for slot, (s, *_) in enumerate(islice(turns(share), sum(share.values()))):
        out[s].append(slot)
    return out


def phases(share: dict[str | None, int], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, slot, release, deadline) of every block as sources run out one after another.

    A phase ends when a source gives its last block; the others go on by their shares, with fresh windows.
    """
    left, begin = {s: n for s, n in blocks.items() if n}, 0
    while left:
        done = {s: blocks[s] - n for s, n in left.items()}
        for slot, (s, k, release, deadline) in enumerate(turns({s: share[s] for s in left}), begin):
            yield s, done[s] + k, slot, begin + release, begin + deadline
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
        begin = slot + 1


def plan(rows: Iterator[tuple[str | None, int, int, int, int]]) -> Iterator[pd.DataFrame]:
    """phases() as frames of a row for each source and RUN of its blocks, in which windows are lists; HELD blocks at most."""
    while held := list(islice(rows, HELD)):
        runs: dict[tuple[str | None, int], list[tuple[int, int, int, int]]] = {}
        for s, k, *rest in held:
            runs.setdefault((s, k // RUN), []).append((k, *rest))
        cols = [np.array(v, np.int64).T for v in runs.values()]
        names = ["__mix_slots", "__mix_releases", "__mix_deadlines"]
        yield pd.DataFrame({"__mix_source": [s for s, _ in runs], "__mix_run": [n for _, n in runs], "__mix_first": [int(c[0][0]) for c in cols], "__mix_end": [int(c[0][-1]) + 1 for c in cols]} | {name: [c[j + 1].tolist() for c in cols] for j, name in enumerate(names)})


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = 32, most_sources: int = 2000) -> DataFrame:
    """docs with (_block, _slot, _release, _deadline, _at) behind its columns: the mix order is (_slot, _at).

    docs(doc_id, source, ...). Each source's rows are put in hash order and cut into blocks of ``block`` rows (its last
    may be shorter); blocks are scheduled so that while every source lasts, each has had its share of the slots to less
    than one block. Once a source has run out the others go on by their weights, so every row comes out exactly once.
    ``weights`` are by source (null: a source of its own; sources not named get the least weight named); without them a
    source weighs the square root of its rows. Weights are taken exactly, whatever their ratios and the slots. _release and _deadline are slots
    of the block's window. Repeated rows count each; an empty table gives an empty result. Raises ValueError over
    ``most_sources`` sources, whose counts the driver holds, and for weights that are not positive.
    Columns of these five names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("_block", "_slot", "_release", "_deadline", "_at")
    order = F.xxhash64(F.lit(1), F.col("doc_id"))
    keyed = docs.withColumn("__mix_h", order).withColumn("__mix_b", F.pmod(F.shiftright("__mix_h", 20), F.lit(BUCKETS)))
    per = keyed.groupBy(F.col("source").alias("__mix_s"), F.col("__mix_b").alias("__mix_c")).agg(F.count("*").alias("__mix_n"))
    counts = {r["__mix_s"]: r["n"] for r in per.groupBy("__mix_s").agg(F.sum("__mix_n").alias("n")).limit(most_sources + 1).collect()}
    if len(counts) > most_sources:
        raise ValueError(f"over {most_sources} sources")
    given = weights or {s: n**0.5 for s, n in counts.items()}
    if any(w <= 0 for w in given.values()):
        raise ValueError("weights must be positive")
    full = {s: given.get(s, min(given.values())) for s in counts}
    frames = plan(phases(shares(full), {s: -(-n // block) for s, n in counts.items()})) if counts else iter(())
    kinds = "__mix_source string, __mix_run long, __mix_first long, __mix_end long, __mix_slots array<long>, __mix_releases array<long>, __mix_deadlines array<long>"
    first, second = next(frames, None), next(frames, None)
    if second is None:
        table = F.broadcast(spark.createDataFrame([] if first is None else list(first.astype(object).itertuples(index=False, name=None)), kinds))
    else:  # too large to be held or broadcast
        at = scratch(spark)
        for pdf in (f for some in ([first, second], frames) for f in some):
            spark.createDataFrame(list(pdf.astype(object).itertuples(index=False, name=None)), kinds).write.mode("append").parquet(at)
        table = spark.read.schema(kinds).parquet(at)

    before = per.withColumn("__mix_before", F.coalesce(F.sum("__mix_n").over(Window.partitionBy("__mix_s").orderBy("__mix_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__mix_n")
    number = F.row_number().over(Window.partitionBy("source", "__mix_b").orderBy("__mix_h", "doc_id"))
    ranked = keyed.withColumn("__mix_r", number).join(before, F.col("source").eqNullSafe(F.col("__mix_s")) & (F.col("__mix_b") == F.col("__mix_c")))
    ranked = ranked.withColumn("__mix_r", F.col("__mix_before") + F.col("__mix_r") - 1).withColumn("_block", F.floor(F.col("__mix_r") / block))
    ranked = ranked.withColumn("__mix_of", F.floor(F.col("_block") / RUN))
    of = F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_of") == F.col("__mix_run")) & (F.col("_block") >= F.col("__mix_first")) & (F.col("_block") < F.col("__mix_end"))
    nth = lambda name: F.get(F.col(name), (F.col("_block") - F.col("__mix_first")).cast("int"))
    placed = ranked.join(table, of)  # just one row of the plan for each block
    return placed.select(*[docs[c] for c in docs.columns], F.col("_block"), nth("__mix_slots").alias("_slot"), nth("__mix_releases").alias("_release"), nth("__mix_deadlines").alias("_deadline"), F.pmod("__mix_r", F.lit(block)).cast("int").alias("_at"))


def in_mix_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = 32) -> DataFrame:
    """All rows and columns of docs, laid out in mix order: files, and rows within a file, follow the schedule."""
    n = parts(docs.sparkSession)
    return mix(docs, weights, block).repartitionByRange(n, "_slot", "_at").sortWithinPartitions("_slot", "_at").select(*docs.columns)
