"""Token-id files of directly addressable codes: any token is read by a few bitmap ranks, without decoding a block."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, scratch
from .tokens import encoder

_STEP = 512  # ids between entries of a rank directory
_HEAD = struct.Struct("<4sIQQ")


class Shard:
    """A run of documents' ids: per level the next 8 bits of each id that has them, a bitmap of those that go on, and a
    directory of the bitmap's ones before each ``_STEP`` ids. Document starts and doc_ids (null: flagged) lie beside."""

    def __init__(self, raw: bytes):
        magic, levels, self.n_docs, self.n_ids = _HEAD.unpack_from(raw)
        if magic != b"DAC1":
            raise ValueError("not a token-id shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.has_id, self.starts = take("<i8", self.n_docs), take("u1", self.n_docs), take("<u8", self.n_docs + 1)
        self.levels, n = [], self.n_ids
        for _ in range(levels):
            chunk, more, ranks = take("u1", n), take("u1", -(-n // 8)), take("<u4", n // _STEP + 1)
            self.levels.append((chunk, more, ranks))
            n = int(ranks[-1]) + int(np.bitwise_count(more[n // _STEP * _STEP // 8 :]).sum())

    @staticmethod
    def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
        every = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
        starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<u8")
        out, levels, rest = [], 0, every
        while levels == 0 or len(rest):
            on = rest > 0xFF
            ones = np.concatenate(([0], np.cumsum(on)))[:: _STEP].astype("<u4")
            out += [(rest & 0xFF).astype("u1").tobytes(), np.packbits(on, bitorder="little").tobytes(), ones[: len(rest) // _STEP + 1].tobytes()]
            rest, levels = rest[on] >> 8, levels + 1
        known = np.array([d is not None and d == d for d in doc_ids], "u1")
        numbers = np.array([int(d) if k else 0 for d, k in zip(doc_ids, known)], "<i8")
        return b"".join([_HEAD.pack(b"DAC1", levels, len(ids), len(every)), numbers.tobytes(), known.tobytes(), starts.tobytes(), *out])

    def token(self, i: int) -> int:
        """The i-th id of the shard, by one rank a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for level, (chunk, more, ranks) in enumerate(self.levels):
            out |= int(chunk[i]) << 8 * level
            if not more[i >> 3] >> (i & 7) & 1:
                break
            base = i // _STEP * _STEP
            i = int(ranks[i // _STEP]) + int(np.bitwise_count(more[base >> 3 : i >> 3]).sum()) + int(more[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """ids start to end: a range is a range on every level."""
        out, where = np.zeros(end - start, "<u4"), np.arange(end - start)
        for level, (chunk, more, ranks) in enumerate(self.levels):
            if start >= end:
                break
            out[where] |= chunk[start:end].astype("<u4") << (8 * level)
            base = start // _STEP * _STEP
            bits = np.unpackbits(more[base >> 3 : -(-end // 8)], bitorder="little")
            on = bits[start - base : end - base].astype(bool)
            start = int(ranks[start // _STEP]) + int(bits[: start - base].sum())
            where, end = where[on], start + int(on.sum())
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = 2_000_000, task_bytes: int = 64 << 20) -> None:
    """Write the ids of docs(doc_id, text, ...) in ascending doc_id order, each document followed by end_id.

    ``path`` gets Parquet files with a row (part, shard, before, n_docs, n_ids, payload) for each shard of about
    shard_ids ids, where ``before`` counts the ids of the part's earlier shards; a document is never split, however long
    its text. Parts are the ranges of doc_id that a task writes, of about task_bytes of text at most. Null text counts
    as empty (only the end id). Rows of one doc_id follow each other by text; a null doc_id comes first. An empty table
    writes an empty dataset. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = source.repartitionByRange(parts(spark, -(-size // task_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, shard, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            nonlocal shard, before, names, held
            size = sum(map(len, held))
            out = pd.DataFrame({"part": [part], "shard": [shard], "before": [before], "n_docs": [len(held)], "n_ids": [size], "payload": [Shard.pack(names, held)]})
            shard, before, names, held = shard + 1, before + size, [], []
            return out

        n = 0
        for pdf in batches:
            for name, ids in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), encoder(tokenizer).encode(pdf["text"])):
                names.append(name)
                held.append(np.append(ids, np.uint32(end_id)))
                n += len(held[-1])
                if n >= shard_ids:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    ordered.mapInPandas(run, "part long, shard long, before long, n_docs long, n_ids long, payload binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids binary]) of files of write_ids: start counts the ids of all documents
    before, the checksum is of the ids as read. Payloads stay in the tasks that read them: only the ids of the parts
    before theirs are broadcast, a row for each task that wrote."""
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(F.col("part").alias("_part"), F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    placed = shards.join(F.broadcast(starts), F.col("part") == F.col("_part")).select((F.col("before") + F.col("_earlier")).alias("before"), "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for before, raw in zip(pdf["before"], pdf["payload"]):
                s = Shard(raw)
                for at in range(0, s.n_docs, 1000):
                    k = range(at, min(at + 1000, s.n_docs))
                    own = [s.document(i).tobytes() for i in k]
                    out = pd.DataFrame({"doc_id": pd.array([int(s.doc_ids[i]) if s.has_id[i] else None for i in k], "Int64"), "start": [int(before + s.starts[i]) for i in k], "n_tokens": [len(x) // 4 for x in own], "ids_crc32": [zlib.crc32(x) for x in own]})
                    yield out.assign(ids=own) if ids else out

    return placed.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else ""))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files written by write_ids and read by read_ids."""
    path = f"{scratch(docs.sparkSession)}/ids"
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path, ids=False)
