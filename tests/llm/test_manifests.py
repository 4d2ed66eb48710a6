"""Merkle manifests, whitening and WARC archives against brute-force versions, and their edge cases."""

import base64
import hashlib
import math
import os
import zlib
from pathlib import Path

import numpy as np
import pytest
from tidemark.llm import merkle, warc, whitening

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, n int, i string"
SF = "/root/testdata/sf0.001"

# --- Merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """Levels of a tree from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, i):
    for level in levels[:-1]:
        run = range(i // 8 * 8, min(i // 8 * 8 + 8, len(level)))
        yield "".join(level[k] for k in run if k < i), "".join(level[k] for k in run if k > i)
        i //= 8


def brute_manifest(rows):
    leaf = lambda r, t: H(*(value(v) for v in (r[0], r[1], r[2], r[3], t)))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        trees[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    own = {g: climb([leaf(r, r[4]) for r in trees[g]]) for g in order}
    top = climb([own[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(trees[g]):
            path = [*beside(own[g], i), *beside(top, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, lower(r[4]) if bad else r[4])
            for a, b in path:
                folded = H(a, folded, b)
            out.append((r[0], leaf(r, r[4]), own[g][-1][0], top[-1][0], H(*(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def manifest(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=repr)


def test_places_are_the_order_of_completion():
    for n in [1, 2, 7, 8, 9, 63, 64, 65, 513, 4096, 4097, 4105, 9000]:
        leaves = [str(k) for k in range(n)]
        log = {}
        for level in range(0, merkle.depth(n) + 1, merkle.SPAN):
            width = merkle.FAN**merkle.SPAN
            digests = leaves if level == 0 else [log[merkle.place((level, k), n)] for k in range(-(-n // merkle.FAN**level))]
            for first in range(0, len(digests), width):
                nodes = merkle.build(digests[first : first + width], level, first, n)
                if level == 0:  # a builder's nodes lie side by side
                    assert [p for p, _ in nodes] == list(range(nodes[0][0], nodes[0][0] + len(nodes)))
                log |= dict(nodes)
        levels = climb(leaves)
        assert sorted(log) == list(range(sum(map(len, levels))))
        for level, nodes in enumerate(levels):
            for i, d in enumerate(nodes):
                assert log[merkle.place((level, i), n)] == d


def test_manifest_of_odd_rows(spark):
    rows = [(k, "a", ["en", "de", None, "", "="][k % 5], k, f"Text {k} ÄÖ") for k in range(90)]
    rows += [(None, None, None, None, None), (None, "a", "en", 1, "No Id"), (5, "a", "en", 1, ""), (5, "a", "en", 1, None), rows[0], rows[0], (7, "b", "x", 3, "LONG " * 200_000)]
    got = manifest(spark, rows)
    assert got == brute_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    lone = [(3, "a", "en", 1, "One")]
    assert manifest(spark, lone) == brute_manifest(lone) and manifest(spark, lone)[0][4] == H("")
    assert manifest(spark, []) == []


def test_manifest_of_several_builders(spark):
    rows = [(k * 7 % 9001, "s", "en" if k % 50 else "de", k, f"T{k}") for k in range(9001)]
    assert manifest(spark, rows) == brute_manifest(rows)


# --- whitening


def brute_whitening(rows, most=16):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in usable]
    fit = np.array(sorted(set(map(tuple, x))), float)
    n, total = len(fit), [sum(r[k] for r in set(map(tuple, x))) for k in range(len(x[0]))]
    y = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    white = (np.array(x, float) - fit.mean(axis=0)) @ vectors / np.sqrt(values)
    return [(usable[r][0], k + 1, n, sum((n * c - s) ** 2 for c, s in zip(x[r], total)), white[r, k], values[k] / np.trace(y.T @ y / n)) for r in range(len(x)) for k in range(len(values))]


VECTORS = "vec_id long, embedding array<float>, dim int, x string"


def whitened(spark, rows, **kw):
    return whitening.whiten(spark.createDataFrame([(i, v, 1, "y") for i, v in rows], VECTORS), **kw).collect()


@pytest.mark.parametrize("dim, most", [(5, 16), (24, 16), (3, 2)])
def test_whitening_against_lapack(spark, dim, most):
    rng = np.random.default_rng(dim)
    x = (rng.standard_normal((400, dim)) * np.linspace(1, 4, dim)) @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(900, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (901, [0.0] * dim), (902, None), (903, [float("nan")] + [1.0] * (dim - 1)), (904, [None] + [1.0] * (dim - 1)), (905, [float("inf")] * dim), (906, [])]
    got = whitened(spark, rows, most=most)
    want = brute_whitening([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows if v != []], most)
    assert len(got) == len(want) and {r.component for r in got} == set(range(1, min(dim, most) + 1))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    signs = {k: 0.0 for k in range(1, most + 1)}
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and abs(g[5] / w[5] - 1) < 1e-10 and g[6] < 1e-9
        assert abs(abs(g[4]) - abs(w[4])) < 1e-9
        signs[g[1]] += g[4] * w[4]
    same = {k: math.copysign(1, s) for k, s in signs.items()}
    assert all(abs(g[4] * same[g[1]] - w[4]) < 1e-9 for g, w in zip(got, want))  # one sign for all rows


def test_whitening_of_odd_tables(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = whitened(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(10)])  # one direction only
    assert {r.component for r in line} == {1} and abs(sum(r.whitened for r in line)) < 1e-9 and abs(line[0].explained - 1) < 1e-12
    two = whitened(spark, [(k, [float(k % 3), float(k % 5)]) for k in range(15)] + [(100 + k, [float(k % 4)]) for k in range(8)])
    assert {r.n for r in two if r.vec_id < 100} == {15} and {r.n for r in two if r.vec_id >= 100} == {4}
    vast = whitened(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [2.0**60, 1.0])])
    assert {r.vec_id for r in vast} == {1, 2} and all(r.deviation is None for r in vast)


def test_divide_and_conquer_of_hard_matrices():
    rng = np.random.default_rng(1)
    turn = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0]
    for n in (2, 3, 17, 64):
        q, v = turn(n), rng.standard_normal((n, 2))
        for a in (np.eye(n), np.zeros((n, n)), v @ v.T, q @ np.diag(np.repeat([5.0, 1.0], [n // 2, n - n // 2])) @ q.T, q @ np.diag(10.0 ** -np.arange(n).clip(0, 14)) @ q.T, q @ np.diag(1 + 1e-9 * np.arange(n)) @ q.T):
            a = (a + a.T) / 2
            values, x = whitening.principal(a)
            scale = max(np.linalg.norm(a), 1e-300)
            assert np.abs(x.T @ x - np.eye(n)).max() < 1e-13 and np.abs(a @ x - x * values).max() < 1e-13 * scale
            assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * scale and (np.diff(values) <= 0).all()


# --- WARC

PAGES = "page_id long, url string, html string, file string, k int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def brute_archive(rows, least=0):
    best, out = {}, []
    for page_id, _, html in rows:
        p = (html or "").encode()
        best[p] = max(best.get(p, -1), page_id)
    for page_id, _, html in rows:
        p = (html or "").encode()
        other = len(p) >= least and page_id != best[p]
        out.append((page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if other else "response", best[p] if other else None))
    return sorted(out)


@pytest.mark.parametrize("least, roll", [(0, 1 << 26), (20, 1500)])
def test_archives_round_trip(spark, tmp_path, least, roll):
    html = [None, "", "a", "a" * 30, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "ß中\U0001f600\x00" * 40, "long " * 100_000]
    rows = [(k, [None, "http://a/ ü\r\nX: y", "http://b"][k % 3], html[k * k % 7]) for k in range(60)]
    df = pages_of(spark, rows).repartition(3)
    assert sorted(map(tuple, warc.archive(df, f"file://{tmp_path}/w", least, roll).collect())) == brute_archive(rows, least)
    files = sorted(Path(tmp_path / "w/warc").glob("*.warc.gz"))
    assert len(files) >= (3 if roll > 1 << 20 else 10) and not (tmp_path / "w/raw").exists()
    for f in files:
        raw = f.read_bytes()
        plain = b"".join(warc.inflated(iter([raw])))
        found = list(warc.records(iter([plain[k : k + 7] for k in range(0, len(plain), 7)] if len(plain) < 10_000 else [plain])))
        lines = [x.split("\t") for x in f.with_name(f.name.replace(".gz", ".idx")).read_text().splitlines()]
        assert [x[3] for x in lines] == [h["WARC-Record-ID"] for h, _ in found] and found[0][0]["WARC-Type"] == "warcinfo"
        for (_, at, n, name), (headers, block) in zip(lines, found):  # a member is a record
            ((h, b),) = warc.records(iter([zlib.decompress(raw[int(at) : int(at) + int(n)], 31)]))
            assert (h, b) == (headers, block) and h["WARC-Record-ID"] == name
        assert sum(int(x[2]) for x in lines) == len(raw)
        responses = {h["WARC-Record-ID"] for g in files for h, _ in warc.records(iter([b"".join(warc.inflated(iter([g.read_bytes()])))])) if h["WARC-Type"] == "response"}
        assert all(h["WARC-Refers-To"] in responses for h, _ in found if h["WARC-Type"] == "revisit")


def test_archives_of_odd_rows(spark):
    rows = [(None, None, "same"), (None, "u", "same"), (4, "u", "twice"), (4, "u", "twice"), (2, "u", "twice"), (None, "u", None), (9, None, None)]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages_of(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 4, "response", None), (None, 4, "revisit", None), (4, 5, "response", None), (4, 5, "revisit", 4), (2, 5, "revisit", 4), (None, 0, "revisit", 9), (9, 0, "response", None)], key=repr)
    assert warc.archive(pages_of(spark, [])).collect() == [] and warc.archive(pages_of(spark, [])).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_a_writer_that_runs_twice_leaves_one_file(tmp_path):
    for text in (b"first", b"second"):
        torn = warc.Writer(f"file://{tmp_path}/d", "x")
        torn.write(b"torn")
        w = warc.Writer(f"file://{tmp_path}/d", "x")
        w.aside += ".other"
        w.out = w.fs.open_output_stream(w.aside, compression=None)
        w.write(text)
        w.close()
        assert Path(tmp_path / "d/x").read_bytes() == text
    assert [n for n in os.listdir(tmp_path / "d") if not n.startswith(".")] == ["x"]


def test_normaliser_reads_members_and_refuses_torn_streams():
    one = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1:f.0>"}, b"x" * 3_000_000)
    both = zlib.compress(one, wbits=31) + zlib.compress(one, wbits=31)
    chunks = [both[k : k + 1000] for k in range(0, len(both), 1000)]
    assert [len(b) for _, b in warc.records(warc.inflated(iter(chunks)))] == [3_000_000] * 2
    assert all(len(p) <= 1 << 20 for p in warc.inflated(iter([both])))
    for torn in (one[:-5], one[:30], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records(iter([torn])))
