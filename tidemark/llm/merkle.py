"""Merkle manifest of documents: a postorder append log written by aligned builders, proofs by closed-form positions."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, parts, save

FAN = 8
SPAN = 4  # levels that one builder writes: it is aligned to FAN**SPAN leaves
_TOP = "^"  # the tree over the subroots; the others are "" (no lang) and "=" with the lang

Node = tuple[int, int]


def field(c: Column) -> Column:
    """A value as text that no other sequence of values gives: its UTF-8 bytes' count and itself, or - for null."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def depth(n: int) -> int:
    """Levels over the leaves of a tree of n leaves."""
    up = 0
    while n > FAN**up:
        up += 1
    return up


def place(node: Node, n: int) -> int:
    """Where the log of a tree of n leaves has the node (level, number): the nodes completed before it. Those are, up to its
    own level, all that end no later than it does, and above it all that end before it begins."""
    level, i = node
    begin, end = i * FAN**level, min((i + 1) * FAN**level, n)
    return sum(-(-end // FAN**j) for j in range(level + 1)) + sum(begin // FAN**j for j in range(level + 1, depth(n) + 1)) - 1


def run_of(node: Node, n: int) -> list[Node]:
    """The nodes that are hashed together with this one, itself included, from left to right."""
    level, i = node
    first = i // FAN * FAN
    return [(level, j) for j in range(first, min(first + FAN, -(-n // FAN**level)))]


def build(digests: list[str], level: int, first: int, n: int) -> list[tuple[int, str]]:
    """(place, digest) of the nodes over an aligned run of nodes of one level, the run itself included, in the order of their
    completion: a node is done with its last child. ``first`` is the run's first number in the tree of n leaves."""
    top, width = min(level + SPAN, depth(n)), -(-n // FAN**level)
    open_: list[list[str]] = [[] for _ in range(SPAN + 1)]
    out: list[tuple[int, str]] = []
    for k, digest in enumerate(digests):
        i, at = first + k, level
        out.append((place((at, i), n), digest))
        ends = i + 1 == width
        while at < top and ((i + 1) % FAN == 0 or ends):
            digest = sha256("".join([*open_[at - level], digest]).encode()).hexdigest()
            open_[at - level] = []
            i, at = i // FAN, at + 1
            out.append((place((at, i), n), digest))
        open_[at - level].append(digest)
    return out


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(tree, ...) with i, a row's number among its tree's in ``order`` (nulls first, ties in the order of the saved
    files), and n, the tree's size. Ranges are numbered where they lie; what is added up is a row for each range and tree."""
    kept = save(rows, "leaves")
    placed = kept.select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    keys = ["tree", *order, "_f", "_r"]
    ranged = placed.repartitionByRange(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("_f", "_r")
    at = save(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "ordered")
    per = at.groupBy(F.col("_part").alias("_p"), F.col("tree").alias("_t")).agg(F.min("_at").alias("_least"), F.count("*").alias("_n"))
    w = Window.partitionBy("_t")
    earlier = F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_p", "_t", "_least", earlier.alias("_earlier"), F.sum("_n").over(w).alias("n"))
    joined = at.join(per, (F.col("_part") == F.col("_p")) & (F.col("tree") == F.col("_t")))
    return joined.withColumn("i", F.col("_at") - F.col("_least") + F.col("_earlier")).drop("_at", "_part", "_p", "_t", "_least", "_earlier")


def write_log(leaves: DataFrame) -> DataFrame:
    """(tree, n, level, first, digests binary): the log of leaves(tree, n, i, digest), 32 bytes a node from place ``first`` on.

    A builder takes FAN**SPAN leaves in a row of one tree and writes all nodes over them as one row; their roots are the
    leaves of the next builders, which write a row a node, as their nodes lie between the lower builders'. So there is a
    pass for every SPAN levels. A row's last node is the only one that nodes outside of it are built from.
    """
    schema = "tree string, n long, level int, i long, first long, digests binary"

    def builder(level: int, whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []

            def flush() -> list[tuple]:
                tree, n, at = held[0]["tree"], held[0]["n"], held[0]["i"]
                nodes = build([r["digest"] for r in held], level, at, n)
                if whole:
                    return [(tree, n, level, at // FAN**SPAN, nodes[0][0], bytes.fromhex("".join(d for _, d in nodes)))]
                below = {place((level, r["i"]), n) for r in held}
                top = place((min(level + SPAN, depth(n)), at // FAN**SPAN), n)
                return [(tree, n, level, at // FAN**SPAN if p == top else -1, p, bytes.fromhex(d)) for p, d in nodes if p not in below]

            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    if held and (r["tree"], r["i"] // FAN**SPAN) != (held[0]["tree"], held[0]["i"] // FAN**SPAN):
                        out += flush()
                        held = []
                    held.append(r)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _LOG)], names=_LOG_NAMES)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flush()), _LOG)], names=_LOG_NAMES)

        return run

    level, rows, log = 0, leaves.select("tree", "n", "i", "digest"), None
    while True:
        block = F.floor(F.col("i") / FAN**SPAN)
        dealt = rows.withColumn("_b", block).repartition("tree", "_b").sortWithinPartitions("tree", "i").drop("_b")
        part = save(dealt.mapInArrow(builder(level, level == 0), schema), "log")
        log = part if log is None else log.union(part)
        level += SPAN
        rows = part.where((F.col("i") >= 0) & (F.col("n") > FAN**level)).select("tree", "n", "i", F.lower(F.hex(F.substring("digests", -32, 32))).alias("digest"))
        if rows.isEmpty():
            return log


_LOG = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
_LOG_NAMES = ["tree", "n", "level", "i", "first", "digests"]


def block_paths(log: DataFrame) -> DataFrame:
    """(tree, block, first, digests, path): each lowest builder's row with the digests, a level each, that stand
    left and right of the path from its root to the tree's: asked for by their places in the log."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tree, n, block in zip(pdf["tree"], pdf["n"].tolist(), pdf["i"].tolist()):
                for level in range(SPAN, depth(n)):
                    at = (level, block // FAN ** (level - SPAN))
                    out += [(tree, block, level, x[1] - at[1], place(x, n)) for x in run_of(at, n) if x != at]
            yield pd.DataFrame(out, columns=["tree", "block", "level", "side", "at"])

    lowest = log.where("level = 0")
    asked = lowest.select("tree", "n", "i").mapInPandas(ask, "tree string, block long, level int, side long, at long")
    nodes = log.select(F.col("tree").alias("_t"), (F.col("first") + F.octet_length("digests") / 32 - 1).cast("long").alias("_at"), F.lower(F.hex(F.substring("digests", -32, 32))).alias("digest"))
    got = asked.join(nodes, (F.col("tree") == F.col("_t")) & (F.col("at") == F.col("_at")))
    path = F.array_sort(F.collect_list(F.struct("level", "side", "digest")))  # at most FAN - 1 a level
    got = got.groupBy(F.col("tree").alias("_t"), F.col("block").alias("_b")).agg(path.alias("path"))
    of = lowest.join(got, (F.col("tree") == F.col("_t")) & (F.col("i") == F.col("_b")), "left")
    none = F.array().cast("array<struct<level:int,side:bigint,digest:string>>")
    return of.select("tree", F.col("i").alias("block"), "first", "digests", F.coalesce("path", none).alias("path"))


def _beside(node: Node, n: int, first: int, digests: bytes, upper: list[dict]) -> list[tuple[str, str]]:
    """For each level from the leaf to its tree's root what stands left and right of the path."""
    out = []
    for level in range(min(SPAN, depth(n))):
        at = (level, node[1] // FAN**level)
        sides = {-1: "", 1: ""}
        for x in run_of(at, n):
            if x != at:
                p = 32 * (place(x, n) - first)
                sides[1 if x > at else -1] += digests[p : p + 32].hex()
        out.append((sides[-1], sides[1]))
    for level in range(SPAN, depth(n)):
        own = [x for x in upper if x["level"] == level]
        out.append(("".join(x["digest"] for x in own if x["side"] < 0), "".join(x["digest"] for x in own if x["side"] > 0)))
    return out


def _folded(digest: str, beside: list[tuple[str, str]]) -> str:
    for left, right in beside:
        digest = sha256((left + digest + right).encode()).hexdigest()
    return digest


def _by_block(leaves: DataFrame, paths: DataFrame, each, schema: str) -> DataFrame:
    """each(row of paths, leaf, what stands beside its path) for every leaf, grouped by builder."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for path in right.to_pylist():
            for r in left.to_pylist():
                out.append(each(path, r, _beside((0, r["i"]), r["n"], path["first"], path["digests"], path["path"])))
        columns = list(zip(*out)) or [()] * len(names)
        return pa.table(dict(zip(names, map(list, columns))), schema=kinds)

    kinds = pa.schema([(x.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[x.split()[1]]) for x in schema.split(", ")])
    block = F.floor(F.col("i") / FAN**SPAN)
    return leaves.withColumn("block", block).groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(run, schema)


def roots(log: DataFrame) -> DataFrame:
    """(tree, digest) of each tree's last node."""
    last = F.max_by(F.lower(F.hex(F.substring("digests", -32, 32))), F.col("first") + F.octet_length("digests") / 32)
    return log.groupBy("tree").agg(last.alias("digest"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs(doc_id, source, lang, n_chars,
    text, ...).

    A leaf is the SHA-256 of the five fields, each with its byte count, nulls marked. Each lang has a tree in order of doc_id
    (null first; rows of one doc_id by leaf), 8 children a node, of fewer the last; their roots, by lang (null first), have
    one more. Proofs are taken from the logs of both. Where 3 divides the crc32 of the decimal doc_id the row's text is
    tampered with (A-Z lower-cased; never where doc_id or text is null), and folded_root is what its leaf then gives with the
    original siblings. Repeated rows are leaves of their own. An empty table gives an empty result. Other columns are ignored.
    """
    doc_id = F.col("doc_id").cast("long")
    hashed = lambda t: F.sha2(F.concat(*map(field, [doc_id, F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), t])), 256)
    tampered = F.crc32(doc_id.cast("string")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    digest = hashed(F.col("text"))
    leaves = docs.select(tree.alias("tree"), doc_id.alias("doc_id"), digest.alias("digest"), F.when(tampered, hashed(F.translate("text", UPPER, LOWER))).otherwise(digest).alias("other"))
    leaves = numbered(leaves, ["doc_id", "digest"])
    log = write_log(leaves)
    under = numbered(roots(log).select(F.lit(_TOP).alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    top = write_log(under)
    root = roots(top).first()
    root = root["digest"] if root else None
    flat = _by_block(under, block_paths(top), lambda path, r, beside: (r["name"], r["digest"], [d for x in beside for d in x]), "name string, subroot string, top array<string>")
    paths = block_paths(log).join(flat, F.col("tree") == F.col("name")).drop("name")

    def proved(path: dict, r: dict, beside: list[tuple[str, str]]) -> tuple:
        beside = beside + list(zip(path["top"][::2], path["top"][1::2]))
        proof = sha256("".join(a + b for a, b in beside).encode()).hexdigest()
        folded = _folded(r["other"], beside)
        return r["doc_id"], r["digest"], path["subroot"], root, proof, folded, folded == root

    return _by_block(leaves, paths, proved, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def oracle(levels: int = 8) -> str:
    """DuckDB SQL of manifest() for trees of up to FAN**levels leaves, a common table a level."""
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda t: "sha256(" + " || ".join(map(part, ["doc_id", "source", "lang", "n_chars", t])) + ")"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"

    def tree(name: str, source: str) -> tuple[str, str, str]:
        """Common tables over source(tree, i, digest), its roots, and (tree, i, befores and afters by level) of its leaves."""
        ctes, joins = [], []
        for k in range(levels):
            src = source if k == 0 else f"{name}{k}"
            side = lambda frame: f"coalesce(string_agg(digest, '') OVER (PARTITION BY tree, i // {FAN} ORDER BY i ROWS BETWEEN {frame}), '')"
            ctes.append(f"{name}s{k} AS (SELECT tree, i, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a, count(*) OVER (PARTITION BY tree) AS n FROM {src})")
            ctes.append(f"{name}{k + 1} AS (SELECT tree, i // {FAN} AS i, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {src}) GROUP BY tree, i // {FAN})")
            joins.append(f"JOIN {name}s{k} ON {name}s{k}.tree = l.tree AND {name}s{k}.i = l.i // {FAN**k}")
        return ", ".join(ctes), f"{name}{levels}", " ".join(joins)

    def steps(name: str) -> str:
        return "[" + ", ".join(f"CASE WHEN {name}s{k}.n > 1 THEN [{name}s{k}.b, {name}s{k}.a] END" for k in range(levels)) + "]"

    low, low_root, low_join = tree("u", "l")
    high, high_root, high_join = tree("v", "m")
    folded = "list_reduce(list_prepend(other, list_filter({0}, lambda x: x IS NOT NULL).list_transform(lambda x: x[1] || '|' || x[2])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)))"
    return (
        f"WITH d AS (SELECT coalesce('=' || lang, '') AS tree, doc_id, {leaf('text')} AS digest, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS other FROM documents), "
        f"l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i FROM d), {low}, "
        f"m AS (SELECT '^' AS tree, tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, digest FROM {low_root}), {high}, "
        f"t AS (SELECT l.name, l.digest AS subroot, {steps('v')} AS top FROM m l {high_join}), "
        f"p AS (SELECT l.doc_id, l.digest, l.other, l.tree, {steps('u')} AS own FROM l {low_join}), "
        f"q AS (SELECT doc_id, digest, other, subroot, own || top AS path FROM p JOIN t ON name = p.tree), "
        f"r AS (SELECT doc_id, digest AS leaf, subroot, (SELECT digest FROM {high_root}) AS root, sha256(coalesce(list_aggregate(flatten(list_filter(path, lambda x: x IS NOT NULL)), 'string_agg', ''), '')) AS proof_sha256, {folded.format('path')} AS folded_root FROM q) "
        "SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM r"
    )
