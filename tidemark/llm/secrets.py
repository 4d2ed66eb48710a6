"""Secret scans in SQL functions only: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns by kind, in listed order, with the least length of the group named.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same as AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # the same as [0-9a-f]+ of 16 characters or more
LEAST_ASSIGN = 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
#: Takes the place of each character of a base span, so that what is left of candidates is found by one more search.
_CUT = "\x01"
#: Bits a character of a window must reach, by character class of the candidate.
THRESHOLDS = {"hex": (r"^[0-9a-fA-F]+$", 3.0), "base32": (r"^[A-Z0-9]+$", 3.4), "base64": ("", 3.7)}
#: Parts of candidates that are no secrets: UUIDs, numbers, runs of the alphabet, marked examples.
ALLOWED = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^[0-9+/=_-]+$|0123456789|abcdefgh|example|sample|dummy|placeholder|xxxx"
KINDS = ["assign", "access", "hex", "entropy"]
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,m:string>>"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f looks at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(x: Column, join: Callable[[Column, Column], Column], chunk: int = 300, levels: int = 1) -> Column:
    """Running sums or maxima of an array of ints, by chunks: as a fold copies what it has at every step, it runs over
    ``chunk`` elements only, and the chunks' last values are run over in the same way to start the chunks after."""

    def plain(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(join(v, F.element_at(acc, -1))))))

    if not levels:
        return plain(x)

    def moved(parts: Column, last: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, c: F.when(c == 0, p).otherwise(F.transform(p, lambda v: join(v, F.get(last, c - 1))))))

    def chunked(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / chunk).cast("int")), lambda c: plain(F.slice(x, c * chunk + 1, F.lit(chunk))))
        return _with(parts, lambda p: _with(_running(F.transform(p, lambda v: F.element_at(v, -1)), join, chunk, levels - 1), lambda last: moved(p, last)))

    return _with(x, lambda x: F.when(F.size(x) <= chunk, plain(x)).otherwise(chunked(x)))


def _ends(gaps: Column, matches: Column) -> Column:
    """Where each match ends, from it and the text since the match before."""
    return _running(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)


def _places(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's matches: what lies between them gives their places, as split and extract match alike."""
    rank = F.lit(KINDS.index(kind))
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(m: Column) -> Column:
        span = lambda e: lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), rank.alias("rank"), F.get(e, i).alias("end"), F.lit(kind).alias("kind"), x.alias("m"))
        every = _with(_ends(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m), lambda e: F.transform(m, span(e)))
        if not group:
            return every
        return _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda part: F.filter(every, lambda _, i: F.length(F.get(part, i)) >= least))

    return F.when(text.rlike(pattern), _with(m, spans)).otherwise(F.array().cast(_SPAN))


def _replaced(text: Column, spans: Column, fill: Callable[[Column, Column, Column], Column]) -> Column:
    """text with each of the spans, sorted by start, replaced by fill(start, end, where all spans before it have ended)."""

    def joined(x: Column) -> Column:
        cut = lambda start, n: F.array_join(F.slice(x["chars"], start + 1, F.greatest(n, F.lit(0))), "")

        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(x["most"], i - 1), F.lit(0))
            return F.concat(cut(before, s["start"] - before), fill(s["start"], s["end"], before))

        last = F.element_at(x["most"], -1)
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(last, F.size(x["chars"]) - last))

    most = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, _with(F.struct(F.split(text, "").alias("chars"), most.alias("most")), joined)).otherwise(text)


def _windows(value: Column, window: int) -> Column:
    """(first, last) starts of the windows of a candidate whose entropy reaches its class's threshold, else null.

    The state holds the window's count of each character, several counts to a long, and the sum of c * log2(c) in whole
    2**-40ths; a step adds one character's count, takes one away and corrects the sum. The first window is found from the
    left, the last from the right, and steps after that do nothing, so the time is linear.
    """
    bits = window.bit_length()
    per, unit = 63 // bits, 1 << 40
    longs = -(-len(ALPHABET) // per)
    codes = [0] * 128
    for p, c in enumerate(ALPHABET):
        codes[ord(c)] = (p // per) * 64 + bits * (p % per)
    weight = F.array(*[F.lit(round(c * math.log2(c) * unit) if c else 0) for c in range(window + 2)])
    w = lambda c: F.get(weight, c)
    most = lambda need: F.lit(math.floor((math.log2(window) - need) * window * unit))
    limit = most(THRESHOLDS["base64"][1])
    for name in ("base32", "hex"):
        limit = F.when(value.rlike(THRESHOLDS[name][0]), most(THRESHOLDS[name][1])).otherwise(limit)
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), code.bitwiseAND(63))
    count = lambda n, code: F.call_function("shiftright", F.get(n, F.shiftright(code, 6)), code.bitwiseAND(63)).bitwiseAND((1 << bits) - 1).cast("int")

    def first(x: Column) -> Column:
        """The first window of the codes that is within the limit."""
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at"))

        def step(acc: Column, a: Column) -> Column:
            return F.when(acc["at"].isNotNull(), acc).otherwise(_with(F.when(acc["i"] >= window, F.get(x["codes"], acc["i"] - window)), lambda b: moved(acc, a, b)))

        def moved(acc: Column, a: Column, b: Column) -> Column:
            n, i = acc["n"], (acc["i"] + 1).alias("i")
            changed = F.transform(n, lambda v, j: v + F.when(j == F.shiftright(a, 6), one(a)).otherwise(0) - F.when(j == F.shiftright(b, 6), one(b)).otherwise(0))
            into, out = count(n, a), count(n, b)
            s = acc["s"] + w(into + 1) - w(into) + F.when(b.isNotNull(), w(out - 1) - w(out)).otherwise(0)
            fresh = _with(s, lambda s: F.struct(changed.alias("n"), s.alias("s"), i, F.when((acc["i"] >= window - 1) & (s <= x["limit"]), acc["i"] - (window - 1)).alias("at")))
            return F.when(a == b, F.struct(n.alias("n"), acc["s"].alias("s"), i, acc["at"].alias("at"))).otherwise(fresh)

        return F.aggregate(x["codes"], start, step, lambda acc: acc["at"])

    every = F.transform(F.split(value, ""), lambda c: F.get(F.array(*map(F.lit, codes)), F.ascii(c)))
    backward = lambda x: F.struct(F.reverse(x["codes"]).alias("codes"), x["limit"].alias("limit"))
    ends = lambda x, at: F.struct(at.alias("first"), F.when(at.isNotNull(), F.size(x["codes"]) - window - _with(backward(x), first)).alias("last"))
    return _with(F.struct(every.alias("codes"), limit.alias("limit")), lambda x: _with(first(x), lambda at: ends(x, at)))


def _stretches(rest: Column, allowed: str, window: int) -> Column:
    """Candidates in a text whose base spans are blanked, of a window at least, without what the allow-list matches.

    Separators beside a cut go with it, so that they do not decide a stretch's character class.
    """
    pattern = f"(?:(?<=({_CUT})))?(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{window},}}(?:(?=({_CUT})))?"
    beside = lambda g: F.regexp_extract_all(rest, F.lit(pattern), F.lit(g))
    span = lambda x, start, m: F.struct(start.alias("start"), x["rank"].alias("rank"), (start + F.length(m)).alias("end"), x["kind"].alias("kind"), m.alias("m"))

    def trimmed(x: Column, start: Column, raw: Column, left: Column, right: Column) -> Column:
        m = F.when(left, F.regexp_replace(raw, "^[+/=_-]+", "")).otherwise(raw)
        return _with(m, lambda m: span(x, start + F.length(raw) - F.length(m), F.when(right, F.regexp_replace(m, "(?<![+/=_-])[+/=_-]++$", "")).otherwise(m)))

    def parted(x: Column) -> Column:
        """What is left between matches of the allow-list, all of which are cut out."""
        gaps = F.split(x["m"], allowed, -1)
        ends = lambda g: _ends(g, F.concat(F.regexp_extract_all(x["m"], F.lit(allowed), F.lit(0)), F.array(F.lit(""))))
        m = F.concat(F.regexp_extract_all(x["m"], F.lit(allowed), F.lit(0)), F.array(F.lit("")))
        placed = lambda g, e, k: F.transform(g, lambda raw, i: trimmed(x, x["start"] + F.get(e, i) - F.length(F.get(k, i)) - F.length(raw), raw, F.lit(True), F.lit(True)))
        left = _with(gaps, lambda g: _with(m, lambda k: _with(ends(g), lambda e: placed(g, e, k))))
        return F.when(x["m"].rlike(allowed), left).otherwise(F.array(x))

    def found(x: Column) -> Column:
        whole = F.transform(x["spans"], lambda s, i: trimmed(s, s["start"], s["m"], F.get(x["left"], i) != "", F.get(x["right"], i) != ""))
        return F.filter(F.flatten(F.transform(whole, parted)), lambda s: (F.length(s["m"]) >= window) & ~s["m"].rlike(allowed))

    parts = F.struct(_places(rest, pattern, "entropy").alias("spans"), beside(1).alias("left"), beside(2).alias("right"))
    return F.when(rest.rlike(pattern), _with(parts, found)).otherwise(F.array().cast(_SPAN))


def spans(docs: DataFrame, window: int = 20, allowed: str = ALLOWED) -> DataFrame:
    """docs with __scan_base and __scan_all behind its columns: sorted spans (start, rank, end, kind, m), in code points.

    The base spans are the matches of the fixed patterns over the whole text, leftmost and non-overlapping per kind and
    long enough. Candidates are runs of ``window`` or more of ALPHABET; base spans and what the allow-list matches are cut
    out of them. From the first to the last window of high entropy each stretch left forms a span of kind entropy.
    Null text counts as empty; repeated rows stay; an empty table gives an empty result. Columns of these names are
    replaced. Time grows in proportion to a text's length, and with the logarithm of its number of matches; a text with
    spans is held as an array of its characters for a while, some 60 bytes each.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.drop("__scan_base", "__scan_all", "__scan_rest", "__scan_high")
    some = "|".join(["(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]", ACCESS, HEX])
    base = F.concat(_places(text, ASSIGN, "assign", 2, LEAST_ASSIGN), _places(text, ACCESS, "access"), _places(text, HEX, "hex"))
    out = docs.withColumn("__scan_base", F.when(text.rlike(some), F.array_sort(base)).otherwise(F.array().cast(_SPAN)))
    blank = lambda start, end, before: F.repeat(F.lit(_CUT), F.greatest(end - F.greatest(start, before), F.lit(0)))
    out = out.withColumn("__scan_rest", _replaced(text, F.col("__scan_base"), blank))
    out = out.withColumn("__scan_high", _stretches(F.col("__scan_rest"), allowed, window))
    scored = F.transform(F.col("__scan_high"), lambda x: F.struct(x.alias("x"), _windows(x["m"], window).alias("w")))
    part = F.transform(F.filter(scored, lambda y: y["w"]["first"].isNotNull()), lambda y: F.struct((y["x"]["start"] + y["w"]["first"]).alias("start"), y["x"]["rank"].alias("rank"), (y["x"]["start"] + y["w"]["last"] + window).alias("end"), y["x"]["kind"].alias("kind"), F.substring(y["x"]["m"], y["w"]["first"] + 1, y["w"]["last"] - y["w"]["first"] + window).alias("m")))
    every = F.when(F.size("__scan_high") > 0, F.array_sort(F.concat("__scan_base", part))).otherwise(F.col("__scan_base"))
    return out.withColumn("__scan_all", every).drop("__scan_rest", "__scan_high")


def scan(docs: DataFrame, window: int = 20, allowed: str = ALLOWED) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs(doc_id, text, ...); see spans()."""
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("__scan_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = spans(docs.select("doc_id", "text"), window, allowed)
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(line("__scan_base"), 256).alias("base_sha256"), line("__scan_all").alias("spans"))


def redact(docs: DataFrame, mark: str = "[REDACTED]", window: int = 20) -> DataFrame:
    """docs with every span of its texts replaced by ``mark``; overlapping spans become one. n_chars, if there, follows."""
    columns = docs.columns
    clean = _replaced(F.coalesce("text", F.lit("")), F.col("__scan_all"), lambda start, end, before: F.when(start >= before, F.lit(mark)).otherwise(F.lit("")))
    out = spans(docs, window).withColumn("text", F.when(F.size("__scan_all") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size("__scan_all") > 0, n).otherwise(F.col("n_chars")))
    return out.select(*columns)
