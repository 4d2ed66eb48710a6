"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 inverted index of one shard's documents, terms being token ids.

    Terms that over a quarter of the documents have are kept as rows over all documents, so that the scores they give to many
    seeds are one matrix product; the others as postings. There are at most four such rows for each distinct term that a
    document has on average.
    """

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = [len(d) for d in docs]
        self.n, self.terms = len(docs), int(max(d.max() for d in docs)) + 1
        key = np.concatenate(docs).astype(np.uint64) * np.uint64(self.n) + np.repeat(np.arange(self.n), n).astype(np.uint64)
        key, tf = np.unique(key, return_counts=True)
        term, self.doc = (key // np.uint64(self.n)).astype(np.int64), (key % np.uint64(self.n)).astype(np.int64)
        self.at = np.searchsorted(term, np.arange(self.terms + 1))
        df = np.diff(self.at)
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        size = np.array(n) / max(np.mean(n), 1)
        self.weight = self.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[self.doc]))
        common = np.nonzero(4 * df > self.n)[0]
        self.row = np.full(self.terms, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        held = self.row[term] >= 0
        self.dense[self.row[term[held]], self.doc[held]] = self.weight[held]
        self.own = term[np.argsort(self.doc, kind="stable")]  # terms by document
        self.own_at = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=self.n))])

    def terms_of(self, d: int) -> np.ndarray:
        return self.own[self.own_at[d] : self.own_at[d + 1]]

    def common_scores(self, seeds: list[int]) -> np.ndarray:
        """What the common terms of each seed give to every document."""
        has = np.zeros((len(seeds), len(self.dense)))
        for i, d in enumerate(seeds):
            row = self.row[self.terms_of(d)]
            has[i, row[row >= 0]] = 1
        return has @ self.dense

    def neighbours(self, seed: int, unused: np.ndarray, common: np.ndarray | None = None, first: int = 32) -> Iterator[int]:
        """Unused documents by falling BM25 score for all of the seed's terms; ``common``: its common_scores(). Most windows are
        full after a few, so all but about the ``first`` best are only sorted when it comes to them."""
        term = self.terms_of(seed)
        term = term[self.row[term] < 0]
        begin, n = self.at[term], self.at[term + 1] - self.at[term]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n) + (self.common_scores([seed])[0] if common is None else common)
        score[~unused] = 0
        found = np.nonzero(score)[0]
        least = np.partition(score[found], -first)[-first] if len(found) > first else -1.0
        for part in (found[score[found] > least], found[score[found] <= least]):
            yield from part[np.argsort(-score[part], kind="stable")].tolist()


def pack_shard(docs: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): every id of every document once, all sequences but the last full.

    A document's whole windows stand alone. The longest rest left is the next seed; its neighbours fill the window in
    order of score, the last of them cut where the window ends, and where none is left the next rest in line does.
    """
    start = np.array([len(d) // window * window for d in docs])
    left = np.array([len(d) for d in docs]) - start
    seq = 0
    for d in range(len(docs)):
        for s in range(0, int(start[d]), window):
            yield d, s, window, seq, 0
            seq += 1
    index, unused = Index(docs), left > 0
    seeds, turn, line = np.argsort(-left, kind="stable"), 0, 0
    ahead: dict[int, np.ndarray] = {}  # common scores of the seeds whose turn is next
    while unused.any():
        while turn < len(seeds) and not unused[seeds[turn]]:
            turn += 1
        if turn == len(seeds):  # rests of cut neighbours whose turn had passed
            seeds, turn = np.nonzero(unused)[0], 0
        seed = d = int(seeds[turn])
        room, queue = window, None
        while True:
            n = int(min(left[d], room))
            yield d, int(start[d]), n, seq, window - room
            start[d] += n
            left[d] -= n
            room -= n
            unused[d] = left[d] > 0
            if not room:
                break
            if queue is None:
                if seed not in ahead:
                    near = [seed, *(int(x) for x in seeds[turn + 1 : turn + 64] if unused[x])]
                    ahead = dict(zip(near, index.common_scores(near)))
                queue = index.neighbours(seed, unused, ahead[seed])
            best = next((x for x in queue if unused[x]), None)
            if best is not None:
                d = best
                continue
            while line < len(docs) and not unused[line]:
                line += 1
            if line == len(docs):
                break
            d = line
        seq += 1


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, shard_ids: int = 2_000_000, order: list[str] | None = None, ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents, each id in one piece.

    docs(doc_id, text, ...): null text counts as empty, so its document is the end id alone. Documents are dealt into
    shards of about shard_ids ids, each with its own inverted index: by a min-hash of their token pairs, so that like
    documents share a shard (copies beyond a shard's size fill several), or, with ``order`` columns, as runs of that
    order. Sequences hold window ids; the last one of a shard may be shorter. Repeated rows are packed once each; a null
    doc_id stays null. An empty table gives an empty result. With ``ids`` the pieces' ids are returned too.
    """
    spark = docs.sparkSession
    by = order or []
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(by)])
    keys = source.columns[2:]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (all_.iloc[at : at + 1000] for all_ in batches for at in range(0, len(all_), 1000)):
            raw, n, route = [], [], []
            for x in encoder(tokenizer).encode(pdf["text"]):
                x = np.append(x, np.uint32(end_id))
                pair = (x[:-1].astype(np.uint64) << np.uint64(32) | x[1:]) * np.uint64(0x9E3779B97F4A7C15) if len(x) > 1 else np.zeros(1, np.uint64)
                route.append(int((pair ^ pair >> np.uint64(29)).min() >> np.uint64(1)))
                raw.append(x.tobytes())
                n.append(len(x))
            out = pdf.drop(columns="text")
            yield out.assign(doc_id=out["doc_id"].astype("Int64"), ids=raw, n=n, route=route)

    encoded = save(source.mapInPandas(run, f"{kept}, ids binary, n long, route long"), "encoded")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    by = keys or ["route", "doc_id"]
    shards = encoded.repartitionByRange(max(1, -(-total // shard_ids)), *by).sortWithinPartitions(*by, "ids")

    def emit(part: int, first: int, names: list[int | None], held: list[np.ndarray]) -> tuple[pd.DataFrame, int]:
        cols = list(zip(*pack_shard(held, window)))
        raw = [held[d][s : s + n].tobytes() for d, s, n in zip(*cols[:3])]
        out = pd.DataFrame({"doc_id": pd.array([names[d] for d in cols[0]], "Int64"), "start": cols[1], "length": cols[2], "ids_crc32": [zlib.crc32(r) for r in raw], "doc_tokens": [len(held[d]) for d in cols[0]], "sequence_id": (part << 40) + first + np.array(cols[3]), "offset": cols[4]})
        return (out.assign(ids=raw) if ids else out), first + max(cols[3]) + 1

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, first, n = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        for pdf in batches:
            for name, raw in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["ids"]):
                names.append(name)
                held.append(np.frombuffer(raw, "<u4"))
                n += len(held[-1])
                if n >= 1.5 * shard_ids:
                    out, first = emit(part, first, names, held)
                    yield out
                    names, held, n = [], [], 0
        if held:
            yield emit(part, first, names, held)[0]

    return shards.mapInPandas(fill, PIECE + (", ids binary" if ids else ""))
