"""Main-text extraction by wrappers: union-free regular expressions inferred from a host's token streams."""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Fixed HTML vocabulary.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea select option svg math iframe object canvas audio video title".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Of these, what has no elements in it: all up to the end tag is text, and up to the page's end where there is none.
UNPARSED = {"script", "style", "title", "textarea"}
CLUTTER = set("nav header footer aside form button dialog menu head".split()) | set(RAW)
MAIN = {"article", "main"}
#: Words of class, id and role values that mark what is not main text.
_MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|popup|modal|overlay|side-?bar|menu|nav\w*|breadcrumbs?|header|masthead|footer|comments?|disqus|respond|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager|skip|copyright)(?=$|[\s_-])", re.I)
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
#: What follows a tag's name: quotes hide > in values only. Nothing is looked at twice.
_REST = re.compile(r"(?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
#: Ends of comments, of CDATA and of other declarations.
_UNTIL = {"<!--": "-->", "<![CDATA[": "]]>"}
#: Elements this deep and below share the names above them; what they are is in the last name.
DEEP = 200
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold lines of text: without a class or name they are parts of what is around them, not boxes of their own.
LINES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption figcaption pre blockquote address".split())
_BREAKS_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path, text) of each block in page order: the path names the open elements, text is unescaped and trimmed.

    A name is the tag and a hash of class, id and role, digits apart. It carries ``!`` if it is clutter by its tag, by
    being hidden or, unless it stands within a line, by the words of class, id or role, and ``*`` if it is the main part.
    Elements of RAW are left out up to the end tag that is theirs; one without is clutter up to its parent's end, one that
    ends in /> is empty if svg or math. End tags close their element and what it holds; p, li, td and the like close by
    themselves. A tag whose quotes never close ends at the next >; one without any > is text. The time grows in
    proportion to the page's length, whatever is left open in it.
    """
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    at, size = 0, len(page)
    last, unquoted = page.rfind(">"), size
    pairs: dict[str, dict[int, int]] = {}

    def tag_end(start: int) -> int:
        """Behind the > of the tag whose name ends at ``start``; 0 if there is none."""
        nonlocal unquoted
        if start > last:
            return 0
        if start < unquoted:
            m = _REST.match(page, start)
            if m:
                return m.end()
            unquoted = start  # from here on a quote may stay open up to the page's end
        return page.find(">", start) + 1

    def end_of(tag: str, start: int) -> int | None:
        """Where the RAW element whose start tag ends at ``start`` is over: each end tag is the innermost open one's."""
        if tag in UNPARSED:
            end = re.compile(f"</{tag}\\s*+>", re.I).search(page, start)
            return end.end() if end else size
        if tag not in pairs:
            pairs[tag], begun, look = {}, [], re.compile(f"<(/?){tag}(?=[\\s/>])", re.I)
            m = look.search(page)
            while m and (end := tag_end(m.end())):
                if not m[1]:
                    if not (tag in ("svg", "math") and page[end - 2] == "/"):
                        begun.append(end)
                elif begun:
                    pairs[tag][begun.pop()] = end
                m = look.search(page, end)
        return pairs[tag].get(start)

    def flush() -> Iterator[tuple[tuple[str, ...], str]]:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            yield tuple(n for _, n in (stack if len(stack) <= DEEP else [*stack[:DEEP], stack[-1]])), text

    def push(tag: str, name: str) -> None:
        if len(stack) >= DEEP:
            above = stack[-1][1] if len(stack) > DEEP else ""
            flags = "".join(c for c in "!*" if c in above or c in name)
            name = f"{zlib.crc32((above + '/' + name).encode('utf-8', 'surrogatepass')):08x}{flags}"
        stack.append((tag, name))
        opened[tag] += 1

    def pop() -> tuple[str, str]:
        tag, name = stack.pop()
        opened[tag] -= 1
        return tag, name

    while at < size:
        m = _OPEN.search(page, at)
        if not m:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        if not m[2]:
            until = _UNTIL.get(m[0], ">")
            end = page.find(until, m.end())
            at = end + len(until) if end >= 0 else size
            continue
        at = tag_end(m.end())
        if not at:
            held.append("<")
            at = m.start() + 1
            continue
        tag, rest = m[2].lower(), page[m.end() : at - 1]
        if tag in INLINE and not opened[tag] and not ("hidden" in rest or "none" in rest):
            continue
        if m[1]:
            if opened[tag]:
                if tag not in INLINE or "!" in next(n for t, n in reversed(stack) if t == tag):
                    yield from flush()
                while pop()[0] != tag:
                    pass
            elif tag not in INLINE:
                yield from flush()
            continue
        attrs: dict[str, str] = {}
        for k, v in _ATTR.findall(rest):
            attrs.setdefault(k.lower(), v.strip("\"'"))
        marks = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
        main = tag in MAIN or attrs.get("role", "").lower() == "main"
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        if tag in INLINE:
            if hidden:
                yield from flush()
            if hidden or opened[tag]:
                push(tag, tag + "!" * hidden)
            continue
        clutter = tag in CLUTTER or hidden or bool(_MARKED.search(marks)) and tag not in ("body", "html") and not main
        empty = rest.endswith("/")
        if tag in RAW:
            yield from flush()
            if tag in ("svg", "math") and empty:
                continue
            end = end_of(tag, at) if tag != "option" else None  # whose end tag may be missing before any sibling
            if end is not None:
                at = end
                continue
        yield from flush()
        if tag in VOID or empty and tag not in RAW:
            continue
        ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _BREAKS_P else set())
        while stack and stack[-1][0] in ends:
            pop()
        head = " ".join(sorted(marks.split()))
        name = re.sub(r"[!*+.]", "-", tag) + (f".{zlib.crc32(re.sub(r'[0-9]+', '#', head).encode('utf-8', 'surrogatepass')):08x}" if head else "")
        push(tag, name + ("!" if clutter else "") + ("*" if main else ""))
    yield from flush()


Wrapper = list[list]  # of [path, optional, repeated, text, pages]


def key_of(path: str, text: str) -> int:
    """A hash (signed long) of a text in its slot."""
    from xxhash import xxh64_intdigest

    n = xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def wrapper_of(found: list[tuple[tuple[str, ...], str]]) -> Wrapper:
    """The token stream of one page as a wrapper: a slot for each path, repeated where the path comes again.

    A slot's text is the hash of its strings on the page, or None where those of other pages differ: then it is a text slot.
    Its pages are hashes of two different pages that have it, or of the only one.
    """
    out: dict[str, list] = {}
    whole = 0
    for names, text in found:
        path = "/".join(names)
        key = key_of(path, text)
        whole = (whole * 31 + key) & ((1 << 63) - 1)
        if path in out:
            out[path][2], out[path][3] = 1, key_of(str(out[path][3]), text)
        else:
            out[path] = [path, 0, 0, key, None]
    return [[*x[:4], [whole]] for x in out.values()]


def _met(x: list, y: list, repeated: int) -> list:
    """Two slots of one path as one: strings that differ make a text slot."""
    return [x[0], x[1] | y[1], repeated, x[3] if x[3] == y[3] else None, sorted({*x[4], *y[4]})[:2]]


def merge(a: Wrapper, b: Wrapper) -> Wrapper:
    """Align two wrappers along a longest run of slots that both have in the same order.

    Slots of one side only become optional; slots of both that stand in another order become repeated groups, at their
    first place. Strings that differ where slots meet make text slots. A slot comes once in a wrapper, so the alignment takes
    n log n steps.
    """
    at = {x[0]: k for k, x in enumerate(b)}
    shared = [(i, at[x[0]]) for i, x in enumerate(a) if x[0] in at]
    tails, tops, before = [], [], []
    for n, (_, k) in enumerate(shared):
        where = bisect_left(tails, k)
        before.append(tops[where - 1] if where else -1)
        if where == len(tails):
            tails.append(k)
            tops.append(n)
        else:
            tails[where], tops[where] = k, n
    chain, n = [(len(a), len(b))], tops[-1] if tops else -1
    while n >= 0:
        chain.append(shared[n])
        n = before[n]
    in_a, in_b = {x[0] for x in a}, at
    out: dict[str, list] = {}
    i = j = 0
    for p, q in reversed(chain):
        for x in [*a[i:p], *b[j:q]]:
            if x[0] in out:
                out[x[0]] = _met(out[x[0]], x, 1)
            else:
                out[x[0]] = [x[0], x[1] if x[0] in in_a and x[0] in in_b else 1, *x[2:]]
        if p < len(a):
            out[a[p][0]] = _met(a[p], b[q], a[p][2] | b[q][2])
        i, j = p + 1, q + 1
    return list(out.values())


def inside(path: str) -> tuple[bool, bool]:
    """Whether a path lies in the main part, and whether in clutter; clutter around the main part does not count."""
    names = path.split("/")
    star = next((i for i, n in enumerate(names) if n.endswith("*")), None)
    return star is not None, any("!" in n for n in names[(star or 0) if star is not None else 0 :])


def box_of(path: str) -> str | None:
    """The nearest element around a text that is a box of its own: it has a class or name, or is none that holds lines. None
    where that is the page's body."""
    names = path.split("/")
    for n in range(len(names), 0, -1):
        tag, _, head = names[n - 1].partition(".")
        if tag in ("body", "html"):
            return None
        if head or tag.strip("!*") not in LINES:
            return "/".join(names[:n])
    return None


def main_paths(wrapper: Wrapper) -> set[str]:
    """Paths of the slots that hold main text.

    Where the host has an article or main: all in it but clutter; clutter around it does not count. Elsewhere all but clutter
    and template boxes: a box is template if at least two different pages have each of its texts and in all of it no string
    differs from page to page, so that it holds no data. A host on which nothing differs, as it has one page or its copies,
    tells nothing, and all stays.
    """
    kinds = {x[0]: inside(x[0]) for x in wrapper}
    main = {p for p, (m, bad) in kinds.items() if m and not bad}
    if main:
        return main
    plain = [x for x in wrapper if not kinds[x[0]][1]]
    if not any(x[3] is None for x in plain):
        return {x[0] for x in plain}
    data: set[str] = set()
    for x in plain:
        if x[3] is None or len(x[4]) < 2:
            names = x[0].split("/")
            data.update("/".join(names[:n]) for n in range(1, len(names) + 1))  # every box around it holds data
    return {x[0] for x in plain if (box := box_of(x[0])) is None or box in data}


def infer(pages: DataFrame, salts: int = 32) -> DataFrame:
    """(host, paths): a wrapper's main slots for each host, from all its pages.

    Tasks first merge the pages they hold into a wrapper a host, so a hot host is never gathered; these are merged in two
    rounds, by (host, salt) and by host.
    """
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        done: dict[str, Wrapper] = {}

        def wrappers() -> pd.DataFrame:
            return pd.DataFrame({"host": list(done), "salt": TaskContext.get().partitionId() % salts, "wrapper": list(map(json.dumps, done.values()))})

        for pdf in batches:
            for host, page in zip(pdf["host"], pdf["html"]):
                w = wrapper_of(list(blocks(page)))
                done[host] = merge(done[host], w) if host in done else w
                if len(done) > 20_000:
                    yield wrappers()
                    done = {}
        if done:
            yield wrappers()

    def joined(pdf: pd.DataFrame) -> Wrapper:
        out: Wrapper | None = None
        for w in map(json.loads, sorted(pdf["wrapper"])):
            out = w if out is None else merge(out, w)
        return out or []

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [str(pdf["host"].iloc[0])], "wrapper": [json.dumps(joined(pdf))]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [str(pdf["host"].iloc[0])], "paths": [sorted(main_paths(joined(pdf)))]})

    first = save(pages.mapInPandas(local, "host string, salt int, wrapper string"), "streams")
    salted = first.groupBy("host", "salt").applyInPandas(some, "host string, wrapper string")
    return salted.groupBy("host").applyInPandas(last, "host string, paths array<string>")


def extract(pages: DataFrame, most_broadcast: int = 16_000_000) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html, ...).

    The text joins the blocks of the host's main slots in page order by one space; references are decoded, white space
    within a block is one space. A page whose own stream holds none of the host's main slots, or lacks the article the
    host's wrapper has, is read by a wrapper of its own. Null html counts as empty, giving an empty text; pages without a
    host (null or odd url) share one. Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    The wrappers are broadcast only up to most_broadcast bytes, beyond that joined by host, where skew joins split hot ones.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    wrappers = save(infer(rows.select("host", "html")), "wrappers").withColumnRenamed("host", "_host")
    size = wrappers.agg(F.sum(F.length(F.to_json("paths")) + F.length("_host") + 50)).first()[0] or 0
    joined = rows.join(F.broadcast(wrappers) if size <= most_broadcast else wrappers, F.col("host") == F.col("_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, set] = {}
        for batch in batches:
            texts = []
            for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist()):
                if len(known) > 20_000:
                    known.clear()
                found = [("/".join(p), t) for p, t in blocks(page)]
                slots = known.setdefault(k := tuple(paths or ()), set(k))
                own = {p for p, _ in found}
                if not own & slots or any("*" in p for p in own) and not any("*" in p for p in own & slots):
                    slots = main_paths(wrapper_of([(tuple(p.split("/")), t) for p, t in found]))
                texts.append(" ".join(t for p, t in found if p in slots))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
