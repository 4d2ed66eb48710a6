"""Toxicity by non-negative positive-unlabelled learning over hashed word features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = 1 << 32


def _parts(word: str) -> list[str]:
    """A word, and its beginnings and endings, so that kindred words share features."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n), *(f"-{word[-n:]}" for n in (4, 5) if len(word) > n)]


def features(text: str, known: dict[str, list[int]]) -> set[int]:
    """Hashes of the parts of the text's words; ``known`` remembers words."""
    from xxhash import xxh32_intdigest

    out: set[int] = set()
    for w in set(_WORD.findall(text.lower())):
        if w not in known:
            if len(known) > 100_000:
                known.clear()
            known[w] = [xxh32_intdigest(p) for p in _parts(w)]
        out.update(known[w])
    return out


class Model:
    """Weights of the chosen features (sorted hashes), and a bias; score is the logistic of bias and mean-free sum."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        self.bias, self.names, self.weights = bias, names, weights
        self.table = dict(zip(names.tolist(), weights.tolist()))
        self.words: dict[str, tuple[tuple[int, float], ...]] = {}

    def score(self, text: str) -> float:
        from xxhash import xxh32_intdigest

        total: dict[int, float] = {}
        for w in set(_WORD.findall(text.lower())):
            hit = self.words.get(w)
            if hit is None:
                if len(self.words) > 150_000:
                    self.words.clear()
                hit = self.words[w] = tuple((h, self.table[h]) for h in map(xxh32_intdigest, _parts(w)) if h in self.table)
            if hit:
                total.update(hit)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(total.values()), -40, 40))))


def choose(rows: DataFrame, n_p: int, n_u: int, most_features: int, prior: float) -> np.ndarray:
    """Features of rows(tag, f array<long>) surely over-represented among the positives (tag 1) against clean texts.

    Counted over all sampled rows. As the rest (tag 0) holds positives at the class prior, a feature's share among clean
    texts is (share in the rest - prior * share in positives) / (1 - prior), floored at half a row; the log ratio to it
    must be log 4 at least. The log ratio to the rest, above zero just where that one is, must be 4 standard errors above.
    """
    one = rows.select("tag", F.explode("f").alias("f")).groupBy("f").agg(F.sum("tag").alias("p"), F.sum(1 - F.col("tag")).alias("u")).where("p >= 4")
    in_p, in_u = (F.col("p") + 0.05) / (n_p + 0.1), (F.col("u") + 0.5) / (n_u + 1)
    ratio = F.log(in_p / F.greatest((in_u - prior * in_p) / (1 - prior), F.lit(0.5 / (n_u + 1))))
    sure = F.log(in_p / in_u) / F.sqrt(1 / (F.col("p") + 0.05) + 1 / (F.col("u") + 0.5))
    best = one.select("f", ratio.alias("ratio"), sure.alias("sure")).where((F.col("ratio") >= float(np.log(4))) & (F.col("sure") >= 4))
    return np.sort(np.array([r["f"] for r in best.orderBy(F.desc("sure"), "f").limit(most_features).collect()], np.int64))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, chosen: np.ndarray, epochs: int = 150, rate: float = 0.05, decay: float = 1e-6, seed: int = 5) -> Model:
    """Minimise the non-negative risk prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]) with logistic loss l.

    Documents are given by their features; ``chosen`` are those used, sorted. As each is evidence of toxicity, weights
    stay at zero or more, so that long texts do not add up noise. Where the corrected negative risk of a batch falls below
    zero, the step climbs it instead, as the method's authors do.
    """
    rng = np.random.default_rng(seed)
    if not len(chosen):
        return Model(chosen, np.zeros(0), -4.0)

    def matrix(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        col = np.concatenate(docs)
        at = np.minimum(np.searchsorted(chosen, col), len(chosen) - 1)
        keep = chosen[at] == col
        return row[keep], at[keep]

    n_p, n_u = len(positive), len(unlabelled)
    row, col = matrix(positive + unlabelled)
    is_p = np.arange(n_p + n_u) < n_p
    w, b, m, v, mb, vb = np.zeros(len(chosen)), -1.0, np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0, 0.0
    step = 0
    for _ in range(epochs):
        deal = rng.integers(0, 8, n_p + n_u)
        for batch in range(8):
            mine = deal == batch
            k = mine[row]
            z = b + np.bincount(row[k], w[col[k]], n_p + n_u)
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            of_p, of_u = mine & is_p, mine & ~is_p
            if not of_p.any() or not of_u.any():
                continue
            negative = np.log1p(np.exp(np.clip(z, -40, 40)))
            risk = negative[of_u].mean() - prior * negative[of_p].mean()
            g = np.zeros(n_p + n_u)
            if risk >= 0:
                g[of_u] = s[of_u] / of_u.sum()
                g[of_p] = prior * (s[of_p] - 1) / of_p.sum() - prior * s[of_p] / of_p.sum()
            else:
                g[of_u] = -s[of_u] / of_u.sum()
                g[of_p] = prior * s[of_p] / of_p.sum()
            gw, gb, step = np.bincount(col[k], g[row[k]], len(chosen)) + decay * w, g.sum(), step + 1
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            w = np.maximum(w - rate * fix * m / (np.sqrt(v) + 1e-8), 0)
            b = float(b - rate * fix * mb / (np.sqrt(vb) + 1e-8))
    return Model(chosen, w, b)


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 12_000, most_features: int = 4000) -> Model:
    """Fit on up to most_positive confirmed toxic texts and most_unlabelled texts, both outside the held-out fold.

    The samples are the first by a hash of doc_id, so the same at any partitioning. The class prior is the share of toxic
    ones among all labelled rows outside the fold. Without toxic or without any texts the model scores all below 0.5.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    n, ones = usable.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    first = lambda df, k, tag: df.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(k).withColumn("_tag", F.lit(tag))
    picked = first(usable.where("toxic = 1"), most_positive, 1).union(first(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")), most_unlabelled, 0))
    picked = save(picked.withColumnRenamed("doc_id", "_id"), "sample")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for pdf in batches:
            yield pd.DataFrame({"tag": pdf["_tag"], "doc_id": pdf["doc_id"], "f": [sorted(features(t, known)) for t in pdf["text"]]})

    rows = save(texts.select("_tag", "doc_id", "text").mapInPandas(run, "tag int, doc_id long, f array<long>"), "features")
    sizes = {r["tag"]: r["count"] for r in rows.groupBy("tag").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model(np.zeros(0, np.int64), np.zeros(0), -4.0)
    prior = min(max(ones / n, 0.001), 0.9)
    chosen = choose(rows, sizes[1], sizes[0], most_features, prior)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"tag": pdf["tag"], "doc_id": pdf["doc_id"], "f": [np.intersect1d(f, chosen).astype("<u4").tobytes() for f in pdf["f"]]})

    used = rows.mapInPandas(keep, "tag int, doc_id long, f binary").toPandas().sort_values(["tag", "doc_id", "f"])
    docs_of = lambda tag: [np.frombuffer(f, "<u4").astype(np.int64) for f in used["f"][used["tag"] == tag]]
    return fit(docs_of(1), docs_of(0), prior, chosen)


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias))  # most_features at most

    def scores(texts: list[str | None], cache: list[Model]) -> list[float]:
        if not cache:
            cache.append(Model(*shared.value))
        return [cache[0].score(t or "") for t in texts]

    return scores


def score(docs: DataFrame, labels: DataFrame, **sizes: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text, ...); see train().

    The score comes from the text alone, of any length; null text counts as empty. Repeated rows stay; a null doc_id is
    scored and not held out; an empty table gives an empty result. Other columns are never read.
    """
    scores = _scorer(docs, train(docs, labels, **sizes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: list[Model] = []
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": scores(pdf["text"], cache)})

    out = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **sizes: int) -> DataFrame:
    """docs without the rows scored 0.5 or more; all columns stay."""
    scores = _scorer(docs, train(docs, labels, **sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: list[Model] = []
        for batch in batches:
            yield batch.filter(pc.less(pa.array(scores(batch.column("text").to_pylist(), cache), pa.float64()), 0.5))

    return docs.mapInArrow(run, docs.schema)
