"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bucket_blocks, save, whole_groups
from .components import components, local_roots

_FOLD = str.maketrans(UPPER, LOWER)


def fingerprint(text: str, shingle: int = 3) -> int:
    """A bit is set where over half the shingles' XXH64 (seed 42) have it; a text without words gives zero."""
    from xxhash import xxh64_intdigest

    words = text.translate(_FOLD).encode("utf-8", "surrogatepass").split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    every = np.array(hashes, "<u8")
    for at in range(0, len(every), 200):  # sums of up to 200 bits fit a byte
        ones += np.unpackbits(every[at : at + 200].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(every), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(doc_id, keys (longs), fp): fp is the fingerprint as a signed long; null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), **{k: pdf[k] for k in keys}, "fp": fp})

    rows = docs.select(F.col("doc_id").cast("long"), *keys, F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "".join(["doc_id long, ", *(f"{k} long, " for k in keys), "fp long"]))


def pivot_keys(fp: Column, blocks: int, most: int) -> Column:
    """Join keys made of distances to unit pivots, arranged in ``blocks`` groups of bits.

    The distances of a fingerprint to the pivots 0 and 2**i tell whether bit i is set, so the distances to a group's
    pivots are its bits. At most ``most`` differing bits touch at most that many groups; the other groups' distances
    agree exactly. So two fingerprints to be linked share the distances of some blocks - most groups: one key each.
    """
    edges = [64 * b // blocks for b in range(blocks + 1)]
    masks = [((1 << edges[b + 1]) - (1 << edges[b])) for b in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - most)):
        mask = sum(masks[b] for b in chosen)
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))))
    return F.array(*keys)


def near_links(nodes: DataFrame, most: int = 3, blocks: int = 5, pivots: int = 16, block: int = 512) -> DataFrame:
    """Links (a, b) that join the nodes (node long, fp long; fp distinct) within ``most`` bits as all such pairs would.

    Candidates share a key of pivot_keys; a pair goes on only if its distances to ``pivots`` seeded random fingerprints
    differ by ``most`` at most in every coordinate (the triangle inequality), and is then verified. Each group gives a
    spanning set of its links rather than all its pairs; hot keys are dealt over many groups by bucket_blocks.
    """
    table = np.random.default_rng(8).integers(0, 1 << 64, pivots, dtype=np.uint64)
    keyed = nodes.select("node", "fp", F.explode(pivot_keys(F.col("fp"), blocks, most)).alias("key"))
    dealt = bucket_blocks(keyed, "key", F.xxhash64("fp"), block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["key", "lo", "hi"]):
            fp, node = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
            far = np.bitwise_count(fp[:, None] ^ table).astype(np.int8)
            new = np.ones(len(pdf), bool)
            new[1:] = (pdf[["key", "lo", "hi"]].to_numpy()[1:] != pdf[["key", "lo", "hi"]].to_numpy()[:-1]).any(axis=1)
            group, found = np.cumsum(new), []
            at = np.arange(len(pdf))
            for step in range(1, len(pdf)):
                at = at[at + step < len(pdf)]
                at = at[group[at] == group[at + step]]
                if not len(at):
                    break
                near = at[(np.abs(far[at] - far[at + step]) <= most).all(axis=1)]
                near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= most]
                found.append(np.stack([near, near + step]))
            if found:
                i, j = np.concatenate(found, axis=1)
                root = local_roots(len(pdf), i, j)
                out = np.nonzero(root != np.arange(len(pdf)))[0]
                yield pd.DataFrame({"a": node[out], "b": node[root[out]]})

    return dealt.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text, ...).

    Fingerprints link at ``most`` or fewer differing bits; component_id is the smallest doc_id reachable. Rows without
    words share fingerprint zero and link like any other. A null doc_id is fingerprinted but links with nothing and gets
    a null component_id. Repeated rows stay repeated. An empty table gives an empty result. Other columns are ignored.
    """
    prints = save(fingerprints(docs), "fingerprints")
    nodes = save(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    linked = components(near_links(nodes, most)).withColumnRenamed("node", "_node")
    of = nodes.join(linked, F.col("node") == F.col("_node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id"))
    joined = prints.join(of, F.col("fp") == F.col("_fp"), "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, most: int = 3) -> DataFrame:
    """One document of each group that links of ``most`` or fewer bits make, with all its columns.

    Rows are told apart by what they hold, not by doc_id: the one that stays has the smallest doc_id of its group (null last),
    of rows of one doc_id that with the smallest hash, and of wholly equal rows one. So unrelated texts that share a doc_id
    stay, and copies that repeat one, or have none, go. An empty table gives an empty result.
    """
    row = [F.col(f"`{c}`") for c in docs.columns]
    row = [x for c in row for x in (c.isNull(), c)]  # else a null would hash as if it were not there
    marked = docs.withColumn("__dup_a", F.xxhash64(*row)).withColumn("__dup_b", F.xxhash64(F.lit("b"), *row))
    prints = save(fingerprints(marked, ["__dup_a", "__dup_b"]), "fingerprints")
    nodes = save(prints.select("fp", F.col("fp").alias("node")).distinct(), "nodes")
    linked = components(near_links(nodes, most)).withColumnRenamed("node", "_node")
    grouped = prints.join(linked, F.col("fp") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "fp"))
    grouped = grouped.select("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__dup_a").alias("a"), F.col("__dup_b").alias("b")).alias("key"))
    grouped = save(grouped.groupBy("component", "key").agg(F.count("*").alias("n")), "keys")  # a row for each group of equal rows
    best = grouped.groupBy(F.col("component").alias("_c")).agg(F.min("key").alias("best"), F.count("*").alias("kinds"), F.sum("n").alias("rows")).where("rows > 1")
    marks = grouped.join(best, F.col("component") == F.col("_c")).where("key <> best or n > 1").select(F.col("key.a").alias("_a"), F.col("key.b").alias("_b"), (F.col("key") == F.col("best")).alias("one"))
    marks = save(marks, "marks")
    same = (F.col("__dup_a") == F.col("_a")) & (F.col("__dup_b") == F.col("_b"))
    kept = marked.join(marks, same, "left_anti").drop("__dup_a", "__dup_b")
    if marks.where("one").isEmpty():
        return kept
    first = marked.join(marks.where("one"), same, "left_semi").dropDuplicates(["__dup_a", "__dup_b"])
    return kept.union(first.drop("__dup_a", "__dup_b"))
