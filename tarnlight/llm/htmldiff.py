"""Main text of web pages by differencing each page with its nearest url.

1. A page is read into lines: the text of each block, with character references decoded and white space turned
   into single spaces; scripts and styles give none. Markup hints at what a line is: one of an article, of a main
   element, neither, or one of a menu, header, footer, sidebar, notice, advert, form or reader comment, by element,
   role, class or id ("hinted"). A class or id counts as a whole, or with words of place like "left" beside it. It
   never hints at an article or main element, nor at one that holds the page's only ones; in reader comments and
   related pages, only a main element counts.
2. Pages are dealt by ranges and sorted by host, path and url, so a host of any size spreads over many tasks. Each
   page is paired with the neighbour of its host whose path has the longer common prefix. Neighbours that are
   copies of each other (19 of 20 characters are in equal lines) are one run, and a page's neighbours are the last
   page before its run and the first one after it, as copies can't tell a site's lines from a page's. For the same
   reason a page isn't paired with one that holds nearly all of its lines, or that has nearly nothing else.
3. The two pages' lines, hinted ones too, are aligned by longest common subsequence, and shared lines are deleted, but
   for lines in an article or main element: articles of one host share paragraphs, and those are main text.
4. Of the lines left, hinted ones go. Where a page has an article (or else a main) element, its lines are the text;
   a main element with more text outside its articles than in them is taken whole. Otherwise all lines left are.
Differencing alone, without hints, is there as hints=False; README says how far it gets.

Defined cases: a null or empty html gives an empty text; a url without host is paired with none; a null id is
carried; repeated rows each give a row (and are copies); a page with no other partner than copies keeps its lines; other columns are ignored; an empty
table gives no rows. Pairing doesn't depend on the partitions: a first pass over outlines (hashes and lengths of lines)
finds up to four pages at the edges of each part, which are carried to the others.
"""

from __future__ import annotations

import json
import pickle
import re
import struct
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from html import unescape
from itertools import groupby, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scratch import ship
from .urlrules import host_of, path_of

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S | re.X,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROP_TAGS = frozenset("nav footer aside form script style noscript template svg math button select textarea dialog menu iframe object audio video canvas search title head xmp noembed noframes plaintext datalist".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist respond disqus share sharing social related recommended pagination pager login signup toolbar widget".split()
)
BEFORE_NAMES = frozenset("main primary secondary site page post global top footer header mobile".split())  # "site-nav"
AFTER_NAMES = frozenset("left right top bottom primary secondary main area list block box bar section container inner links item text".split())  # "sidebar-left"
OF_OTHERS = frozenset("comment comments commentlist respond disqus related recommended".split())  # their articles are other people's or pages'
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COPY = 20  # pages are copies if all but a 20th of their characters is in equal lines
KEEP, DROP, HEAD, NAMED, OTHERS = range(5)  # what an open element does to its text: DROP hints at it, HEAD at all but headings; NAMED and OTHERS hint by name
HINTED = -1  # the place of a line that markup hints at; 0, 1 and 2 are elsewhere, a main element, an article
Line = tuple[str, int]


def attributes(text: str) -> dict[str, str]:
    return {n.lower(): unescape(a or b or c) for n, a, b, c in ATTR.findall(text)} if text else {}


def by_name(names: str) -> int:
    """What class names and ids say."""
    found = KEEP
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        while len(parts) > 1 and (parts[-1] in AFTER_NAMES or parts[-1].isdigit()):
            parts.pop()
        while len(parts) > 1 and parts[0] in BEFORE_NAMES:
            parts.pop(0)
        if parts and DROP_NAMES.issuperset(parts):
            if not OF_OTHERS.isdisjoint(parts):
                return OTHERS
            found = NAMED
    return found


def effect(tag: str, attrs: str, inside: bool) -> int:
    """inside: whether an article or main element is open."""
    if tag in DROP_TAGS:
        return DROP
    if tag == "header":
        return HEAD if inside else DROP
    if not attrs or tag in ("html", "body", "main"):
        return KEEP
    have = attributes(attrs)
    if have.get("role", "").lower() in DROP_ROLES or "hidden" in have or have.get("aria-hidden", "").lower() == "true":
        return DROP
    if tag == "article" or have.get("role", "").lower() == "main":
        return KEEP
    return by_name(f"{have.get('class', '')} {have.get('id', '')}".lower())


class Named:
    """An open element that is dropped by its name unless it turns out to hold an article or main element."""

    def __init__(self, others: bool):
        self.others, self.dropped = others, True


def page_lines(html: str | None, hints: bool = True) -> list[Line]:
    """(text, place) of each block with text, in page order; without hints, every place is 0."""
    out: list[tuple[tuple[tuple[str, bool, tuple[Named, ...]], ...], int]] = []  # pieces of text, whether dropped, and the named ones around
    if not html:
        return []
    top = ("", KEEP, 0, ())
    stack: list[tuple[str, int, int, tuple[Named, ...]]] = []  # (tag, effect on what is inside, place, named ones around)
    mode, place, around, held = KEEP, 0, (), []

    def flush() -> None:
        if held:
            out.append((tuple(held), place))
            held.clear()

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            held.append((unescape(text) if "&" in text else text, mode != KEEP, around))
        if not m:
            break
        at = m.end()
        if m["raw"] is not None:
            held.append((m["raw"], mode != KEEP, around))
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if m["end"] or m["end2"]:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != tag:
                k -= 1
            if k >= 0:
                del stack[k:]
                _, mode, place, around = stack[-1] if stack else top
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["attrs2"] or ""
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = n if close is None else (html.find(">", close.start()) + 1 or n)
            continue
        if tag == "p" or tag in BLOCK:  # an open paragraph ends where a block begins
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in BLOCK:
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                del stack[k:]
                _, mode, place, around = stack[-1] if stack else top
        own = effect(tag, attrs, place > 0) if mode != DROP else DROP
        if own in (NAMED, OTHERS):  # read on, as the element may hold an article
            around = (*around, Named(own == OTHERS))
            own = KEEP
        if mode == HEAD:
            own = KEEP if tag in HEADINGS and own == KEEP else DROP if own == DROP else HEAD
        mode = own
        is_main = tag == "main" or "main" in attrs and attributes(attrs).get("role") == "main"
        if mode != DROP and (is_main or tag == "article"):
            if is_main or not any(x.others and x.dropped for x in around):
                for x in around:
                    x.dropped = False
        if tag == "article":
            place = 2
        elif is_main:
            place = max(place, 1)
        stack.append((tag, mode, place, around))
    flush()

    def lines(kept: Callable[[bool, tuple[Named, ...]], bool]) -> list[Line]:
        made = []
        for pieces, p in out:
            for want, where in ((True, p), (False, HINTED)):
                if text := " ".join("".join(t for t, dropped, named in pieces if kept(dropped, named) == want).split()):
                    made.append((text, where))
        return made

    if not hints:
        return [(t, 0) for t, _ in lines(lambda dropped, named: True)]
    # beside an article of its own, those in a sidebar are teasers
    own_lines = lines(lambda dropped, named: not dropped and not named)
    return own_lines if any(p > 0 for _, p in own_lines) else lines(lambda dropped, named: not dropped and not any(x.dropped for x in named))


def unhinted(lines: list[Line]) -> list[Line]:
    return [x for x in lines if x[1] != HINTED]


def common(a: list[str], b: list[str], most_bits: int = 1 << 28) -> list[bool]:
    """Which elements of a are in a longest common subsequence of a and b."""
    marks = [False] * len(a)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            marks[a0] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            marks[a1 - 1] = True
            a1, b1 = a1 - 1, b1 - 1
        n, m = a1 - a0, b1 - b0
        if n == 0 or m == 0:
            continue
        if n * m <= most_bits or n == 1:
            rows = _rows(a[a0:a1], b[b0:b1])
            i, j = n, m
            while i and j:
                if rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                else:
                    i -= 1
                    if not i or rows[i - 1] >> (j - 1) & 1:
                        marks[a0 + i] = True
                        j -= 1
            continue
        mid = (a0 + a1) // 2  # halves of a against the split of b that keeps the length
        front = _prefix(_last(a[a0:mid], b[b0:b1]), m)
        back = _prefix(_last(a[mid:a1][::-1], b[b0:b1][::-1]), m)
        k = max(range(m + 1), key=lambda x: front[x] + back[m - x])
        todo += [(a0, mid, b0, b0 + k), (mid, a1, b0 + k, b1)]
    return marks


def _step(a: list[str], b: list[str]) -> Iterator[int]:
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _rows(a: list[str], b: list[str]) -> list[int]:
    return list(_step(a, b))


def _last(a: list[str], b: list[str]) -> int:
    v = (1 << len(b)) - 1
    for v in _step(a, b):
        pass
    return v


def _prefix(v: int, m: int) -> list[int]:
    out = [0]
    for c in reversed(bin(v | 1 << m)[3:]):
        out.append(out[-1] + (c == "0"))
    return out


class Mark(NamedTuple):
    """What stands for a line's text where only equality and length count."""

    hash: int
    size: int


def overlap(a: list[Line], b: list[Line]) -> tuple[int, int, int]:
    """Characters of a, of b, and of lines they have both, in whatever order."""
    x, y = Counter(t for t, _ in a), Counter(t for t, _ in b)
    size = lambda t: t.size if isinstance(t, Mark) else len(t)
    return sum(size(t) for t, _ in a), sum(size(t) for t, _ in b), sum(size(t) * min(n, y[t]) for t, n in x.items() if t in y)


def copies(a: list[Line], b: list[Line]) -> bool:
    """Whether nearly all of both pages is the same, hinted lines aside."""
    if a == b:
        return True
    n, m, both = overlap(unhinted(a), unhinted(b))
    return COPY * both >= (COPY - 1) * max(n, m)


def telling(a: list[Line], b: list[Line]) -> bool:
    """Whether b may be a's partner: neither of them is nearly all in the other, hinted lines aside."""
    n, m, both = overlap(unhinted(a), unhinted(b))
    return COPY * both < (COPY - 1) * min(n, m)


def without_shared(lines: list[Line], partner: list[Line]) -> list[Line]:
    """The lines that the partner doesn't share, and those in an article or main element."""
    shared = common([t for t, _ in lines], [t for t, _ in partner])
    return [x for x, s in zip(lines, shared) if not s or x[1] > 0]


def main_text(lines: list[Line], partner: list[Line] | None) -> str:
    left = unhinted(without_shared(lines, partner) if partner else lines)
    size = [sum(len(t) for t, p in left if p == place) for place in range(3)]
    least = 1 if size[1] > size[2] else 2 if size[2] else 0
    return " ".join(t for t, p in left if p >= least)


def prefix_length(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Page(NamedTuple):
    id: object
    url: str | None
    host: str
    path: str
    packed: bytes  # lines

    def lines(self) -> list[Line]:
        data = pa.Codec("zstd").decompress(self.packed[8:], int.from_bytes(self.packed[:8], "little"), asbytes=True)
        return [tuple(x) for x in json.loads(data.decode("utf-8", "surrogatepass"))]


def written(lines: list[Line]) -> bytes:
    return json.dumps(lines, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 9).compress(data, asbytes=True)


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=8).digest()


class Outline(NamedTuple):
    """A page without its text: enough to tell copies, and to find the page again."""

    url: str | None
    host: str
    path: str
    key: str
    print: bytes  # of its lines
    marks: bytes  # of its lines without hints

    def lines(self) -> list[tuple[Mark, int]]:
        return [(Mark(*x), 0) for x in struct.iter_unpack("<QI", self.marks)]

    @property
    def packed(self) -> bytes:
        return self.print


def marks_of(lines: list[Line]) -> bytes:
    return b"".join(digest(t.encode("utf-8", "surrogatepass")) + len(t).to_bytes(4, "little") for t, p in lines if p != HINTED)


def together(a: Page, b: Page) -> bool:
    """Whether neighbours belong to one run."""
    return bool(a.host) and a.host == b.host and (a.packed == b.packed or copies(a.lines(), b.lines()))


class Edges(NamedTuple):
    """Of a partition: first page, first page of its second run, last page, last page of the run before the last."""

    first: Page
    second: Page | None
    last: Page
    earlier: Page | None


#: Of the pages before a place: the last one, and the last one of another run than that; after it likewise.
Side = tuple[Page | None, Page | None]


def edges_of(pages: Iterable[Page]) -> Edges | None:
    first = second = last = earlier = None
    for page in pages:
        if first is None:
            first = page
        elif not together(last, page):
            second, earlier = second or page, last
        last = page
    return Edges(first, second, last, earlier) if first else None


def sides(parts: dict[int, Edges]) -> dict[int, tuple[Side, Side]]:
    """What is before and after each partition that has pages."""

    def passed(side: Side, near: Page, turn: Page | None, far: Page) -> Side:
        if turn:  # a run ends inside
            return far, turn
        return far, side[1] if side[0] and together(side[0], near) else side[0]

    before, after, side = {}, {}, (None, None)
    for k in sorted(parts):
        e, before[k] = parts[k], side
        side = passed(side, e.first, e.earlier, e.last)
    side = (None, None)
    for k in sorted(parts, reverse=True):
        e, after[k] = parts[k], side
        side = passed(side, e.last, e.second, e.first)
    return {k: (before[k], after[k]) for k in parts}


def paired(pages: Iterable[Page], ahead: Side = (None, None), behind: Side = (None, None)) -> Iterator[tuple[Page, Page | None, Page | None]]:
    """Each page, the last one before its run, and the first one after it. ahead: what is before the first page,
    behind: after the last. A run's pages are held packed."""
    run, (last, before) = [], ahead
    for page in pages:
        if last and not together(last, page):
            yield from ((x, before, page) for x in run)
            before, run = last, []
        run.append(page)
        last = page
    if run:
        after = behind[1] if behind[0] and together(last, behind[0]) else behind[0]
        yield from ((x, before, after) for x in run)


def text_of(page: Page, before: Page | None, after: Page | None) -> tuple[str, int, int, int]:
    """Its main text, and how many lines it has, lost as shared ones, and lost as hinted ones."""
    lines = page.lines()
    near = [(prefix_length(page.path, x.path), x) for x in (before, after) if x and page.host and x.host == page.host]
    partner = next((other for _, x in sorted(near, key=lambda x: -x[0]) if telling(lines, other := x.lines())), None)
    left = without_shared(lines, partner) if partner else lines
    return main_text(left, None), len(lines), len(lines) - len(left), sum(p == HINTED for _, p in left)


def bounds(keys: DataFrame, n: int, each: int = 30) -> list[tuple]:
    """First keys of parts 1..n-1, from a sample of about `each` keys a part; fewer where keys are."""
    rows = keys.count()
    if rows == 0:
        return []
    some = sorted(tuple(x or "" for x in r) for r in keys.sample(min(1.0, each * n / rows), 7).collect())
    return [some[len(some) * k // n] for k in range(1, n)] if len(some) >= n else some


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hints: bool = True) -> DataFrame:
    """id, url, text, n_chars (code points), n_lines, n_shared_lines (deleted by differencing) and n_hinted_lines (deleted
    by markup after it) of each page. hints: whether markup but for scripts and styles is heeded."""
    spark = pages.sparkSession
    ship(spark)
    url = F.col(f"`{url_col}`").cast("string")
    source = pages.select(F.col(f"`{id_col}`").alias("__id"), url.alias("__url"), F.coalesce(host_of(url), F.lit("")).alias("__host"), F.coalesce(path_of(url), F.lit("")).alias("__path"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("__key"), F.col(f"`{html_col}`").cast("string").alias("__html"))
    order = ["__host", "__path", "__url", "__key"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = bounds(source.select(*order), n)
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_chars", "n_lines", "n_shared_lines", "n_hinted_lines"))])
    arrow = to_arrow_schema(schema)
    found_by = [T.StructField("__print", T.BinaryType()), T.StructField("__part", T.IntegerType())]
    parsed = T.StructType([*source.schema.fields[:4], *found_by, T.StructField("__packed", T.BinaryType())])
    outlined = T.StructType([*source.schema.fields[1:5], *found_by, T.StructField("__marks", T.BinaryType())])

    def part_of(host: str, path: str, url: str | None, key: str) -> int:
        return bisect_right(cuts, (host, path, url or "", key))

    def read(whole: bool) -> Callable:
        """Pages as rows of `parsed`, or of `outlined`."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, *rest = batch.columns
                urls, hosts, paths, keys, html = (c.to_pylist() for c in rest)
                lines = [page_lines(x, hints) for x in html]
                data = [written(x) for x in lines]
                part = pa.array([part_of(*x) for x in zip(hosts, paths, urls, keys)], pa.int32())
                head, last = ([ids, *rest[:3]], map(packed, data)) if whole else (rest[:4], map(marks_of, lines))
                yield pa.RecordBatch.from_arrays([*head, pa.array([digest(x) for x in data], pa.binary()), part, pa.array(last, pa.binary())], names=(parsed if whole else outlined).names)

        return run

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        return (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns)))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, own in groupby(rows_of(batches), lambda x: x[5]):
            found = edges_of(Outline(u, h, p, key, mark, marks) for u, h, p, key, mark, _, marks in own)
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "edges": pa.array([pickle.dumps(found)], pa.binary())})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # one of a task's equal pages is enough
        for batch in batches:
            for _, u, _, _, key, html in zip(*(c.to_pylist() for c in batch.columns)):
                if (u, key) in wanted.value:
                    data = written(page_lines(html, hints))
                    name = (u, key, digest(data))
                    if name[2] in wanted.value[u, key] and name not in done:
                        done.add(name)
                        yield pa.RecordBatch.from_pydict({"u": pa.array([u], pa.string()), "k": [key], "p": pa.array([name[2]], pa.binary()), "packed": pa.array([packed(data)], pa.binary())})

    # parts have fixed bounds and one order, so that they hold the same pages in both passes; the first sends outlines
    # alone, and the few pages at the parts' edges are fetched by what was found there
    outlines = source.mapInArrow(read(False), outlined).repartitionById(n, F.col("__part")).sortWithinPartitions("__part", *order, "__print")
    around = sides({r["part"]: pickle.loads(r["edges"]) for r in outlines.mapInArrow(edges, "part int, edges binary").collect()})
    named: dict[tuple[str | None, str], set[bytes]] = {}
    for x in (x for both in around.values() for side in both for x in side if x):
        named.setdefault((x.url, x.key), set()).add(x.print)
    wanted = spark.sparkContext.broadcast(named)
    whole = {}
    if named:
        got = source.mapInArrow(fetch, "u string, k string, p binary, packed binary").groupBy("u", "k", "p").agg(F.min("packed").alias("packed"))
        whole = {(r["u"], r["k"], bytes(r["p"])): bytes(r["packed"]) for r in got.collect()}  # up to four for each part
    real = lambda x: x and Page(None, x.url, x.host, x.path, whole[x.url, x.key, x.print])
    carried = spark.sparkContext.broadcast({k: tuple(tuple(map(real, side)) for side in both) for k, both in around.items()})
    dealt = source.mapInArrow(read(True), parsed).repartitionById(n, F.col("__part")).sortWithinPartitions("__part", "__host", "__path", "__url", F.coalesce(F.col("__id").cast("string"), F.lit("")), "__print")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[Page]]]:
        for k, own in groupby(rows_of(batches), lambda x: x[5]):
            yield k, (Page(i, u, h, p, lines) for i, u, h, p, _, _, lines in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((x.id, x.url, t, len(t), *n) for k, own in parts(batches) for x, before, after in paired(own, *carried.value.get(k, ())) for t, *n in [text_of(x, before, after)])
        while held := list(islice(made, 512)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)
