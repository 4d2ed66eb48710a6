"""Embedding near-duplicates by spherical-cap filters from a structured random product code."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_blocks, save, whole_groups
from .components import components, local_roots


def is_usable(column: str = "embedding") -> Column:
    """Whether a row has a vec_id and a vector that is not null, empty or zero and has only finite components; never null."""
    v = F.col(column).cast("array<double>")
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return F.when(F.col("vec_id").isNull() | bad, False).otherwise(F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows of is_usable(), vectors as doubles."""
    return vectors.where(is_usable(column)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, scaled first so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Caps:
    """codes * codewords**2 filter directions over dim dimensions: ``codes`` random rotations, each followed by pairs of
    random codewords for the two halves.

    A vector belongs to the filters whose direction it exceeds by ``height`` standard deviations. Two vectors of cosine
    0.9 share one with a probability of over 0.999, nearer ones still more often. Below some 35 dimensions, where a cosine
    of 0.5 is the most that is asked for, a filter takes in a larger share of all vectors; there are fewer
    codewords then, so that a vector exceeds about as many filters in any dimension.
    """

    def __init__(self, dim: int, codes: int = 16, codewords: int = 48, height: float = 2.95, seed: int = 6):
        rng = np.random.default_rng(seed)
        cosine = min(height / math.sqrt(dim), 0.5)
        codewords = max(2, round(codewords * math.sqrt(math.erfc(height / math.sqrt(2)) / math.erfc(cosine * math.sqrt(dim / 2)))))
        self.half, self.words, self.height = max(1, dim // 2), codewords, cosine * np.sqrt(2)
        unit = lambda n: (x := rng.standard_normal((codewords, max(n, 1)))) / np.linalg.norm(x, axis=1, keepdims=True)
        self.codes = [(np.linalg.qr(rng.standard_normal((dim, dim)))[0], unit(self.half), unit(dim - self.half)) for _ in range(codes)]

    def decode(self, unit_vectors: np.ndarray) -> list[np.ndarray]:
        """For each vector all filters it exceeds, in rising order: a left codeword is looked at only if the best right
        one can make it."""
        rows, filters = [], []
        for n, (rotation, a, b) in enumerate(self.codes):
            x = unit_vectors @ rotation
            left = x[:, : self.half] @ a.T
            right = x[:, self.half :] @ b.T if x.shape[1] > self.half else np.zeros((len(x), self.words))
            row, i = np.nonzero(left >= self.height - right.max(axis=1, keepdims=True))
            for at in range(0, len(row), 50_000):
                r, c = row[at : at + 50_000], i[at : at + 50_000]
                k, j = np.nonzero(right[r] >= (self.height - left[r, c])[:, None])
                rows.append(r[k])
                filters.append((n * self.words + c[k]) * self.words + j)
        row, filter_ = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (rows, filters))
        order = np.lexsort((filter_, row))
        return np.split(filter_[order].astype("<u4"), np.searchsorted(row[order], np.arange(1, len(unit_vectors)))) if len(unit_vectors) else []


def near_vectors(vectors: DataFrame, cosine: float = 0.9, codes: int = 16, codewords: int = 48, height: float = 2.95, block: int = 512, rows: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, ...).

    Pairs whose cosine in double precision is ``cosine`` or more link. Vectors that are null, empty or zero or hold null
    or non-finite components link with nothing, as do vectors of another dimension with each other. Rows with a null
    vec_id get no links, a null component_id and kept false. Every row is a vector of its own: rows that repeat a vec_id are
    compared each, and link with each other if they are near. An empty table gives an empty result; other columns are ignored.

    Equal vectors are one class, with their number, and stand for each other's links. A class carries its components in the
    table's own width, float or double, and those of its filters that come before the one at hand: a pair counts only in
    the first filter it shares. Groups emit a row per class with its number of new links and a root to hang on, never the
    pairs. Python hands on ``rows`` rows at a time.
    """
    kind = "<f4" if "array<float>" in dict(vectors.dtypes)["embedding"] else "<f8"  # floats lose nothing as floats
    good = save(usable(vectors), "vectors")
    classes = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caps: dict[int, Caps] = {}
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                x = np.stack(part["v"].to_numpy())
                caps.setdefault(dim, Caps(dim, codes, codewords, height))
                lists = caps[dim].decode(units(x))
                lengths = np.array([len(f) for f in lists])
                rep = np.repeat(np.arange(len(part)), lengths)
                if not len(rep):
                    continue
                nth = np.arange(len(rep)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                raw, own = [r.tobytes() for r in x.astype(kind)], [f.tobytes() for f in lists]
                ids, copies = part["node"].to_numpy(), part["copies"].to_numpy()
                every = np.concatenate(lists).astype(np.int64) + (int(dim) << 32)
                for at in range(0, len(rep), rows):
                    r, n = rep[at : at + rows], nth[at : at + rows]
                    before = [own[k][: 4 * m] for k, m in zip(r.tolist(), n.tolist())]
                    yield pd.DataFrame({"cap": every[at : at + rows], "node": ids[r], "copies": copies[r], "raw": [raw[k] for k in r], "own": before})

    dealt = bucket_blocks(classes.mapInPandas(deal, "cap long, node long, copies long, raw binary, own binary"), "cap", F.xxhash64("node"), block)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["cap", "lo", "hi"]):
            out = []
            for (_, lo, hi), g in pdf.groupby(["cap", "lo", "hi"], sort=False):
                x = units(np.frombuffer(b"".join(g["raw"]), kind).astype(float).reshape(len(g), -1))
                i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
                if lo != hi and len(i):
                    side = g["side"].to_numpy()
                    i, j = i[side[i] != side[j]], j[side[i] != side[j]]
                if not len(i):
                    continue
                members, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                i, j = at[: len(i)], at[len(i) :]
                own = [np.frombuffer(b, "<u4") for b in g["own"].iloc[members]]
                row = np.repeat(np.arange(len(own)), [len(o) for o in own])
                every = np.concatenate(own)
                if len(every):  # filters before this one: pairs that share one have been counted there
                    names, col = np.unique(every, return_inverse=True)
                    has = np.zeros((len(own), len(names)), np.float32)
                    has[row, col] = 1
                    fresh = (has @ has.T)[i, j] == 0
                    i, j = i[fresh], j[fresh]
                if len(i):
                    ids, copies = g["node"].to_numpy()[members], g["copies"].to_numpy()[members]
                    n = np.zeros(len(ids), np.int64)
                    np.add.at(n, i, copies[j])
                    np.add.at(n, j, copies[i])
                    root = local_roots(len(ids), i, j)
                    out.append(pd.DataFrame({"node": ids[n > 0], "n": n[n > 0], "root": ids[root[n > 0]]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    found = save(dealt.mapInPandas(verify, "node long, n long, root long"), "links")
    counts = found.groupBy(F.col("node").alias("_node")).agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "_root")
    n_links = F.col("copies") - 1 + F.coalesce("n", F.lit(0))
    of = classes.join(counts, F.col("node") == F.col("_node"), "left").join(roots, F.col("node") == F.col("_root"), "left")
    of = save(of.select(F.col("v").alias("_v"), "least", n_links.alias("n_links"), F.coalesce("component", "node").alias("component")), "linked")
    names = of.groupBy(F.col("component").alias("_c")).agg(F.min("least").alias("component_id"))
    of = of.join(names, F.col("component") == F.col("_c")).select("_v", "n_links", "component_id")
    tied = good.join(of, F.col("v") == F.col("_v")).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = vectors.where(~is_usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return tied.union(alone)
