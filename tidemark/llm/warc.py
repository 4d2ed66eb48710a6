"""WARC files of pages: whole-file gzip streams normalised to a member a record with an offset index, duplicates as revisits."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, save, scratch

DATE = "2000-01-01T00:00:00Z"  # pages bear no date; a fixed one makes a task that runs again write the same bytes
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder's URI (file, hdfs, s3, gs, ...) and the path there."""
    folder = re.sub(r"^(\w+):/(?!/)", r"\1:///", folder)
    return pyarrow.fs.FileSystem.from_uri(folder)


class Writer:
    """A file that appears under its name only when whole: it is written beside it and then moved, so a task that dies or
    runs twice leaves one right file."""

    def __init__(self, folder: str, name: str):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.fs, at = opened(folder)
        self.fs.create_dir(at, recursive=True)
        self.path, self.aside = f"{at}/{name}", f"{at}/.{name}.{context.taskAttemptId() if context else 0}"
        self.out, self.at = self.fs.open_output_stream(self.aside, compression=None), 0

    def write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.path).type != pyarrow.fs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.aside, self.path)


# --- records


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC record: version, named fields, block."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def uri(text: str) -> str:
    """What a header line can't hold, percent-encoded."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), text)


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def response(page_id: int | None, url: str | None, payload: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Headers and block of a page's response. The record's name holds the page_id, and where the record was first written,
    so that rows of one page_id have names of their own."""
    name = "null" if page_id is None else str(page_id)
    headers = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{name}:{where}>", "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        headers["WARC-Target-URI"] = uri(url)
    return headers, http_head(len(payload)) + payload


def page_of(name: str) -> int | None:
    """The page_id in a record's name."""
    part = name.split(":")[2]
    return None if part == "null" else int(part)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of plain WARC text; holds one record and a chunk."""
    rest = bytearray()
    done = False

    def more() -> bool:
        nonlocal done
        piece = next(chunks, None)
        if piece is None:
            done = True
            return False
        rest.extend(piece)
        return True

    while True:
        at, seen = -1, 0
        while at < 0:
            at = rest.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(rest)
            if at < 0 and not more():
                if rest.strip():
                    raise ValueError("a WARC stream ends within a record's headers")
                return
        lines = rest[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        begin, end = at + 4, at + 4 + int(headers["Content-Length"])
        while len(rest) < end + 4:
            if not more():
                raise ValueError("a WARC stream ends within a record")
        yield headers, bytes(rest[begin:end])
        del rest[: end + 4]


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What a gzip file holds, be it one stream or many members, in pieces of at most a chunk."""
    stream = zlib.decompressobj(31)
    for raw in chunks:
        while raw:
            piece = stream.decompress(raw, _CHUNK)
            if piece:
                yield piece
            raw = stream.unconsumed_tail
            if stream.eof:
                raw, stream = stream.unused_data, zlib.decompressobj(31)


def _read_chunks(fs: pyarrow.fs.FileSystem, path: str) -> Iterator[bytes]:
    with fs.open_input_stream(path, compression=None) as f:
        while raw := f.read(_CHUNK):
            yield raw


# --- jobs


def write_raw(pages: DataFrame, folder: str, roll: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write pages(page_id, url, html, ...) as WARC files of one gzip stream each, as crawlers leave them: every page is a
    response. Returns (page_id, file, k, digest, size) of the k-th record of each file, saved. A task writes what it reads
    and begins a new file every ``roll`` bytes; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, writer, gz, size, out = TaskContext.get().partitionId(), 0, None, None, 0, []
        names = ["page_id", "file", "k", "digest", "size"]

        def finish() -> pa.RecordBatch:
            nonlocal writer, number, size, out
            writer.write(gz.flush())
            writer.close()
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)
            writer, number, size, out = None, number + 1, 0, []
            return done

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i) for i in range(3))):
                if writer is None:
                    file = f"p{part:06d}-{number:04d}"
                    writer, gz = Writer(folder, f"{file}.raw.warc.gz"), zlib.compressobj(level, zlib.DEFLATED, 31)
                    writer.write(gz.compress(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:file:{file}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                payload = html.as_py()
                headers, block = response(page_id.as_py(), url.as_py(), payload, f"{file}.{len(out)}")
                raw = record(headers, block)
                writer.write(gz.compress(raw))
                out.append((page_id.as_py(), file, len(out), headers["WARC-Payload-Digest"][5:], len(payload)))
                size += len(raw)
                if size >= roll:
                    yield finish()
        if writer is not None:
            yield finish()

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    return save(columns.mapInArrow(run, "page_id long, file string, k long, digest string, size long"), "raw")


def decide(written: DataFrame, least: int = 0) -> DataFrame:
    """written(page_id, file, k, digest, size) with ``keeper``, the record's name (page, file and place) that each is to
    revisit; null for responses. Of equal payloads of ``least`` bytes or more that with the largest page_id is the response
    (null below all; of rows of one page_id the last written). Payloads themselves are not moved, only their digests."""
    same = written.where(F.col("size") >= least).groupBy(F.col("digest").alias("_d"), F.col("size").alias("_s"))
    best = F.max(F.struct("page_id", "file", "k"))
    best = same.agg(best.alias("best"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = written.join(best, (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s")), "left")
    other = F.col("best").isNotNull() & ((F.col("best.file") != F.col("file")) | (F.col("best.k") != F.col("k")))
    name = F.concat_ws(":", F.lit("<urn:page"), F.coalesce(F.col("best.page_id").cast("string"), F.lit("null")), F.concat("best.file", F.lit("."), "best.k", F.lit(">")))
    return joined.select("page_id", "file", "k", F.when(other, name).alias("keeper"))


def normalise(decided: DataFrame, raw: str, folder: str, level: int = 1) -> DataFrame:
    """Rewrite each file under ``raw`` that decided(file, k, keeper) names: its stream is inflated once, every record becomes a
    gzip member of its own, those with a keeper a revisit without payload, and a sidecar (file, offset, length, record's name
    a line) is written beside it. A task takes a file; it holds one record and a file's decisions. Returns (file, records)."""

    def rewrite(file: str, keepers: list[str | None]) -> int:
        fs, at = opened(raw)
        out, index, k = Writer(folder, f"{file}.warc.gz"), Writer(folder, f"{file}.warc.idx"), 0
        for headers, block in records(inflated(_read_chunks(fs, f"{at}/{file}.raw.warc.gz"))):
            if headers["WARC-Type"] == "response":
                if keepers[k] is not None:
                    headers |= {"WARC-Type": "revisit", "WARC-Refers-To": keepers[k], "WARC-Profile": _REVISIT}
                    block = block[: block.index(b"\r\n\r\n") + 4]  # the answer's head, whose Content-Length is the payload's
                k += 1
            headers.pop("Content-Length")
            gz = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = gz.compress(record(headers, block)) + gz.flush()
            index.write(f"{file}\t{out.at}\t{len(member)}\t{headers['WARC-Record-ID']}\n".encode())
            out.write(member)
        if k != len(keepers):
            raise ValueError(f"{file}: {k} records, {len(keepers)} expected")
        out.close()
        index.close()
        return k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, keepers = None, []
        for pdf in batches:
            for file, keeper in zip(pdf["file"].tolist(), pdf["keeper"].astype(object).where(pdf["keeper"].notna(), None).tolist()):
                if file != at:
                    if at is not None:
                        yield pd.DataFrame({"file": [at], "records": [rewrite(at, keepers)]})
                    at, keepers = file, []
                keepers.append(keeper)
        if at is not None:
            yield pd.DataFrame({"file": [at], "records": [rewrite(at, keepers)]})

    dealt = decided.select("file", "k", "keeper").repartition("file").sortWithinPartitions("file", "k")
    return save(dealt.mapInPandas(run, "file string, records long"), "files")


def read_archives(spark: SparkSession, folder: str, stretch: int = 16 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page's record in the archives under ``folder``,
    by their sidecars: tasks take stretches of a file and read each member from its offset. A response's digest and size are
    computed anew and compared with its headers; a revisit's come from its headers, which are the full payload's."""
    lines = F.split("value", "\t")
    index = spark.read.schema("value string").text(folder, pathGlobFilter="*.warc.idx").select(lines[0].alias("file"), lines[1].cast("long").alias("offset"), lines[2].cast("long").alias("length"), lines[3].alias("name"))
    index = index.where(F.col("name").startswith("<urn:page:")).drop("name").withColumn("_s", F.floor(F.col("offset") / stretch))
    dealt = index.repartition(parts(spark), "file", "_s").sortWithinPartitions("file", "offset").drop("_s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = opened(folder)
        name, f = None, None
        for pdf in batches:
            out = []
            for file, offset, length in zip(pdf["file"], pdf["offset"].tolist(), pdf["length"].tolist()):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{at}/{file}.warc.gz")
                f.seek(offset)
                (headers, block), *others = records(iter([zlib.decompress(f.read(length), 31)]))
                if others:
                    raise ValueError(f"{file} at {offset}: more than one record in a member")
                head, _, payload = block.partition(b"\r\n\r\n")
                size, digest = int(re.search(rb"Content-Length: (\d+)", head)[1]), headers["WARC-Payload-Digest"][5:]
                if headers["WARC-Type"] == "response" and (len(payload), digest_of(payload)) != (size, digest):
                    raise ValueError(f"{file} at {offset}: payload does not match its digest")
                refers = headers.get("WARC-Refers-To")
                out.append((page_of(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], page_of(refers) if refers else None))
            pages, sizes, digests, kinds, refers = zip(*out) if out else [()] * 5
            yield pd.DataFrame({"page_id": pd.array(pages, "Int64"), "payload_bytes": pd.array(sizes, "Int64"), "payload_digest": digests, "record_type": kinds, "refers_to": pd.array(refers, "Int64")})
        if f is not None:
            f.close()

    return dealt.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, roll: int = 64 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each row of pages(page_id, url, html, ...), read back
    from the archives that are written under ``folder`` (null: a new one in the shared folder; it must be empty).

    A payload is the html in UTF-8 (null: empty). Of equal payloads of ``least`` bytes or more the one with the largest page_id
    is a response and the others revisit it; a null page_id is below all, and what revisits one has a null refers_to. Rows that
    repeat a page_id are records of their own, so one may revisit another of its page_id. A null url gives no target URI. An
    empty table gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{scratch(spark)}/warc"
    written = write_raw(pages, f"{folder}/raw", roll)
    files = normalise(decide(written, least), f"{folder}/raw", f"{folder}/warc")
    if files.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/raw")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # every record is in the new files by now
    return read_archives(spark, f"{folder}/warc")


def oracle() -> str:
    """DuckDB SQL of archive() for whole tables. DuckDB has SHA-1 as hex; five hex digits are four of base 32."""
    hexes = "sha1(coalesce(html, ''))"
    digits = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    number = lambda k: f"('0x' || substr(h, {5 * k + 1}, 5))::BIGINT"
    code = " || ".join(f"substr({digits}, (({number(k)} >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
    return (
        f"WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, {hexes} AS h FROM pages), "
        "q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p) "
        f"SELECT page_id, payload_bytes, {code} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM q"
    )
