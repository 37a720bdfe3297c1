"""Main text of web pages by differencing each page with its nearest neighbour on the host.

Pages are sorted by host and URL path; a page is paired with the page before it (the first one of a host with the page
after it) whose lines are not all the same. The text lines of both are aligned by a longest common subsequence, and
lines that both share are taken for the site's template and deleted. Only hashes of lines are sorted; where a range of
the sort ends, the pages next to it travel with the tasks, so the pairs are the same for any partitioning.

Differencing alone deletes what two articles share, such as a quoted passage, and keeps boilerplate that is a page's
own, such as an advert. So two rules of structure check it: lines in an element that can't be article text (navigation,
header, footer, form, script, advert, notice, comments) always go; and of the article (or else main) elements, those that
hold a line of the page's own stay whole, with the lines in them that are shared, and what lies outside goes with the
template. An article element without a line of the page's own is the template's, such as a teaser on all pages, unless it
lies in a main element that is the text.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Container, Iterable, Iterator
from html import unescape
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import map_arrow, materialize

# Element names of HTML.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg math xmp".split())
_NEVER = frozenset("nav footer aside form button select option datalist fieldset dialog menu object canvas audio video head".split())
_MAIN = ("article", "main")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
#: Words in class, id or role that mark boilerplate: fixed values.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices "
    "sidebar comment comments respond disqus menu nav navbar navigation breadcrumb breadcrumbs share sharing social related "
    "newsletter subscribe popup modal overlay pagination pager widget footer complementary contentinfo search skip toolbar".split()
)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Attributes up to the end of the tag, by the quotes that still have a partner further on; never tried again shorter.
_ATTRIBUTES = {
    "\"'": re.compile(r"""(?>(?:[^>"']|"[^"]*"|'[^']*')*)"""),
    "'": re.compile(r"""(?>(?:[^>']|'[^']*')*)"""),
    "\"": re.compile(r"""(?>(?:[^>"]|"[^"]*")*)"""),
    "": re.compile(r"[^>]*"),
}
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[\s_\-]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)


class Line:
    __slots__ = ("inside", "main", "text", "unit")

    def __init__(self, text: str, inside: str, unit: int, main: int):
        # inside: "", "main" or "article"; unit: the number of that element, an article in an article being one with it;
        # main: the number of the main element around the line, be it in an article or not, or 0
        self.text, self.inside, self.unit, self.main = text, inside, unit, main


def _boilerplate(name: str, attributes: str, in_main: bool) -> bool:
    if name in _NEVER or (name == "header" and not in_main):
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    for values in _MARKED.findall(attributes):
        for word in _SPLIT.split("".join(values).lower()):
            if word in _MARKS or (word in ("header", "masthead") and not in_main):
                return True
    return False


def _tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of each tag, name "" for comments and declarations. A caller may send
    the place to go on from. One pass: a quote without a partner, and a `<` without a `>` after it, are plain text."""
    at, quotes, last = 0, "\"'", html.rfind(">")
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            found = (start, end + 3 if end >= 0 else len(html), "", "", "")
        elif html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start)
            found = (start, end + 1 if end >= 0 else len(html), "", "", "")
        elif (m := _NAME.match(html, start)) and start < last:
            end = _ATTRIBUTES[quotes].match(html, m.end()).end()
            while end < len(html) and html[end] != ">":
                quotes = quotes.replace(html[end], "")
                end = _ATTRIBUTES[quotes].match(html, m.end()).end()
            if end == len(html):  # every `>` is inside quotes
                end = html.find(">", m.end())
            found = (start, end + 1, m[1], m[2].lower(), html[m.end() : end])
        else:
            continue
        at = (yield found) or found[1]


def lines(html: str) -> list[Line]:
    """The page's lines of text in order, one for each block, without those in boilerplate elements.

    Character references are decoded, white space is one space, empty lines are left out. Unclosed elements end with
    the element around them; an article or main element is read even inside boilerplate that was never closed. The time
    is linear in the page, whatever is left open.
    """
    out: list[Line] = []
    held: list[str] = []
    # open elements: name, and what `inside`, `unit`, `main` and `skip` were before; `bases`: where the open article and main ones are,
    # with how many of each name are open from there on
    stack: list[tuple[str, str, int, int, int]] = []
    bases: list[tuple[int, Counter]] = [(0, Counter())]
    skip, at, inside, unit, main, units = 0, 0, "", 0, 0, 0

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(Line(text, inside, unit, main))
            held.clear()

    tags, go_on = _tags(html), None
    while True:
        try:
            start, end, closing, name, attributes = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at and not skip:
            held.append(html[at:start])
        at = end
        if not name:
            continue
        if name not in _INLINE:
            flush()
        if not closing:
            if name in _RAW:
                if not attributes.endswith("/"):
                    close = _CLOSE[name].search(html, at)
                    go_on = at = close.end() if close else len(html)
                continue
            if name in _VOID or attributes.endswith("/") and name not in _MAIN:
                continue
            own = (name, inside, unit, main, skip)
            if name in _MAIN and not _boilerplate("", attributes, False) and (name == "article" or inside != "article"):
                bases.append((len(stack), Counter()))
                if inside != name:
                    units += 1
                    unit = units
                    if name == "main":
                        main = unit
                inside, skip = name, 0
            else:
                skip += _boilerplate(name, attributes, bool(inside))
            stack.append(own)
            bases[-1][1][name] += 1
        elif bases[-1][1][name]:  # else a stray end tag, which doesn't close the article around it
            if name not in _INLINE:
                flush()
            while True:
                shut, inside, unit, main, skip = stack.pop()
                bases[-1][1][shut] -= 1
                if len(bases) > 1 and bases[-1][0] == len(stack):
                    bases.pop()
                if shut == name:
                    break
    if at < len(html) and not skip:
        held.append(html[at:])
    flush()
    return out


def _row(a: list[int], b: list[int]) -> tuple[list[int], int]:
    """Bit-parallel LCS of a against b: the vector after each element of a (zero bits count the length)."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows, full


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """LCS length of a with each prefix of b."""
    rows, full = _row(a, b)
    last = rows[-1] if rows else full
    bits = np.unpackbits(np.frombuffer(last.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int], cells: int = 1 << 26) -> list[int]:
    """Positions in a of a longest common subsequence of a and b; memory is bounded for any lengths."""
    shared = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in shared]
    other = [x for x in b if x in shared]
    own = [a[i] for i in at]

    def solve(lo: int, hi: int, b_lo: int, b_hi: int) -> Iterator[int]:
        while lo < hi and b_lo < b_hi and own[lo] == other[b_lo]:
            yield lo
            lo, b_lo = lo + 1, b_lo + 1
        tail = 0
        while lo < hi and b_lo < b_hi and own[hi - 1] == other[b_hi - 1]:
            hi, b_hi, tail = hi - 1, b_hi - 1, tail + 1
        x, y = own[lo:hi], other[b_lo:b_hi]
        if x and y:
            if len(x) > 1 and len(x) * len(y) > cells:
                half = len(x) // 2
                score = _lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]
                cut = int(score.argmax())
                yield from solve(lo, lo + half, b_lo, b_lo + cut)
                yield from solve(lo + half, hi, b_lo + cut, b_hi)
            else:
                rows, full = _row(x, y)
                found, j = [], len(y) - 1
                for i in range(len(x) - 1, -1, -1):
                    above = rows[i - 1] if i else full
                    # step left while this row gains nothing there
                    while j >= 0 and rows[i] >> j & 1:
                        j -= 1
                    if j < 0:
                        break
                    if above >> j & 1 and (~rows[i] & ((1 << j + 1) - 1)).bit_count() > (~above & ((1 << j + 1) - 1)).bit_count():
                        found.append(lo + i)
                        j -= 1
                yield from reversed(found)
        yield from range(hi, hi + tail)

    return [at[i] for i in solve(0, len(own), 0, len(other))]


def main_text(page: list[Line], shared: Container[int]) -> str:
    """The page's text without the lines at `shared`, but with those in an article that has lines of its own too.

    Without such an article it is the main elements with lines of their own, whole, so with the articles in them. Without
    these too the page may be a copy of its partner beside an advert, or a story beside a teaser: of all article (or else
    main) lines and the own lines outside, the longer is the text.
    """
    own = [x for i, x in enumerate(page) if i not in shared]
    if articles := {x.unit for x in own if x.inside == "article"}:
        return " ".join(x.text for x in page if x.unit in articles)
    if mains := {x.unit for x in own if x.inside == "main"}:
        return " ".join(x.text for x in page if x.main in mains)
    best = next((kind for kind in _MAIN if any(x.inside == kind for x in page)), None)
    return max(" ".join(x.text for x in page if x.inside == best), " ".join(x.text for x in own), key=len)


def _units(page: list[Line]) -> list[int] | None:
    """For each line its unit, below zero in a main element; None if they all lie in one, so none can go."""
    units = [-x.unit if x.inside == "main" else x.unit for x in page]
    return None if len(set(units)) == 1 and units[0] else units


def _changes(units: list[int], shared: list[int]) -> bool:
    """Whether the shared lines can change the page's text: some element that markup takes has no line of its own."""
    wanted = {u for u in units if u > 0} or {u for u in units if u < 0}
    if not wanted:
        return bool(shared)
    gone = set(shared)
    return not wanted <= {u for i, u in enumerate(units) if i not in gone}


def _key(line: Line) -> int:
    return xxhash.xxh64_intdigest(line.text.encode("utf-8", "surrogatepass")) - (1 << 63)


#: A page in the sort: host, hashes of its lines, and the page with its units, or None if no line of it can go.
_Page = tuple[str, list[int], tuple[int, int, tuple[int, ...]] | None]


def _runs(pages: Iterable[_Page]) -> Iterator[tuple[str, list[int], list[tuple[int, int, tuple[int, ...]]]]]:
    """Pages of one host in a row whose lines are all the same: host, hashes, the pages that differencing decides."""
    for (host, keys), group in groupby(pages, key=lambda x: (x[0], x[1])):
        alike: dict[tuple[int, ...], tuple[int, ...]] = {}  # equal units are held once
        yield host, keys, [(*x[2][:2], alike.setdefault(x[2][2], x[2][2])) for x in group if x[2] is not None]


class _Edge(NamedTuple):
    """What the neighbours of a range need of it: its first two runs, its last two from the end, whether it is one run."""

    head: list[tuple[str, list[int]]]
    tail: list[tuple[str, list[int]]]
    single: bool


def _beyond(edges: list[_Edge], side: str, host: str, keys: list[int]) -> list[int] | None:
    """Hashes of the nearest page of the host with other lines, in the ranges in the order given."""
    for edge in edges:
        for own_host, own in getattr(edge, side):
            if own_host != host:
                return None
            if own != keys:
                return own
        if not edge.single:
            return None
    return None


def _pairs(pages: DataFrame) -> DataFrame:
    """(k1, k2, shared): the places of the lines that a page shares with its partner, for pages whose text they change."""
    spark = pages.sparkSession

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines(x or "") for x in batch.column(5).to_pylist()]
            keys = pa.array([[_key(x) for x in page] for page in found], pa.list_(pa.int64()))
            units = pa.array([_units(page) for page in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], units, keys], names=["k1", "k2", "page_id", "host", "path", "units", "keys"])

    order = ["host", "path", "page_id", "k1", "k2"]
    kind = "k1 long, k2 long, page_id long, host string, path string, units array<int>, keys array<long>"
    dealt = map_arrow(pages.select("k1", "k2", "page_id", "host", "path", "html"), light, kind).repartitionByRange(*order[:4])
    written = materialize(dealt.withColumn("part", F.spark_partition_id()))
    parts = written.repartition("part").sortWithinPartitions("part", *order).select("part", "k1", "k2", "host", "units", "keys")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[_Page]]]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for part, group in groupby(rows, key=itemgetter(0)):
            yield part, ((host, keys, None if units is None else (k1, k2, tuple(units))) for _, k1, k2, host, units, keys in group)

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in in_order(batches):
            head: list[tuple[str, list[int]]] = []
            tail: deque[tuple[str, list[int]]] = deque(maxlen=2)
            n = 0
            for host, keys, _ in _runs(group):
                n += 1
                tail.append((host, keys))
                if n <= 2:
                    head.append((host, keys))
            kept = head if n <= 2 else [*head, *tail]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([[h for h, _ in kept]], pa.list_(pa.string())), pa.array([[k for _, k in kept]], pa.list_(pa.list_(pa.int64())))], names=["part", "n", "hosts", "keys"])

    # hashes of four pages of each part at most
    found = sorted(map_arrow(parts, edge, "part int, n long, hosts array<string>, keys array<array<long>>").collect())
    runs = [list(zip(r.hosts, map(list, r["keys"]))) for r in found]
    edges = [_Edge(x[:2], x[:-3:-1], r.n == 1) for x, r in zip(runs, found)]
    around = {}
    for i, e in enumerate(edges):
        around[found[i].part] = (_beyond(edges[:i][::-1], "tail", *e.head[0]), _beyond(edges[i + 1 :], "head", *e.tail[0]))
    shared = spark.sparkContext.broadcast(around)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in in_order(batches):
            before, after = shared.value[part]
            runs = _runs(group)
            now = next(runs, None)
            first, out = True, []
            while now is not None:
                following = next(runs, None)
                host, keys, wanted = now
                previous = before if first else last[1] if last[0] == host else None
                partner = previous
                if partner is None:
                    partner = after if following is None else following[1] if following[0] == host else None
                if wanted and partner:
                    places = common(keys, partner)
                    out.extend((k1, k2, places) for k1, k2, units in dict.fromkeys(wanted) if _changes(units, places))
                if len(out) >= 1000 or out and following is None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["k1", "k2", "shared"])
                    out = []
                last, now, first = now, following, False

    return map_arrow(parts, pair, "k1 long, k2 long, shared array<int>").dropDuplicates(["k1", "k2"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    Hashes of lines are sorted by (host, path, id) in ranges, however many pages a host has; of each range's ends a few
    come to the driver. The pages themselves are shuffled only where differencing changes the text of many. Null html is
    empty and gives an empty text. Null URLs are one host. Repeated rows each keep a row, and are paired with the nearest
    page that differs from them. Extra columns are ignored. An empty table gives an empty table.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page_id, url, html, shared = batch.columns
            texts = [main_text(lines(x or ""), set(places or ())) for x, places in zip(html.to_pylist(), shared.to_pylist())]
            yield pa.RecordBatch.from_arrays([page_id, url, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    parts = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)"
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        url.alias("url"),
        F.coalesce(F.lower(F.regexp_extract(url, parts, 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, parts, 2), F.lit("")).alias("path"),
        html.alias("html"),
    )
    row = ["page_id", "url", "html"]
    keyed = source.withColumns({"k1": F.xxhash64(*row, *(F.col(c).isNull() for c in row)), "k2": F.xxhash64(F.lit("k2"), *row[::-1])})
    joined = keyed.join(materialize(_pairs(keyed)), ["k1", "k2"], "left")
    return map_arrow(joined.select("page_id", "url", "html", "shared"), work, "page_id long, url string, text string, n_chars long")
