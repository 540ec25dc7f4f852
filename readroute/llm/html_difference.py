"""Main text of web pages: structure first, then the difference to the page of the nearest URL.

A page is cut into lines, one for each block of text. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments that say so (by element, role, class or
id) are left out, and so is what stands outside the article element, if there is one, or
else outside the main element or a container named as content.

Then pages are paired: in the order of their URL paths within a host, each page has one
neighbour on either side, and the one that shares more of the path is its partner. The
lines of both are aligned by a longest common subsequence, and lines that they share are
deleted as the site's own:

* without an article or main element, every shared line; but if these are more than half of
  the page's text, the two are copies, and the neighbour on the other side is asked instead;
* within an article or main element, shared lines of blocks with a class or id of their own,
  and of blocks that are all link. Plain paragraphs stay, since texts are often published on
  several pages of a host.

Pages are dealt to tasks by ranges of (host, path, url, id), so a host of any size is many tasks;
the first and the last page of a range also go to the ranges beside it, as neighbours only.
"""

from __future__ import annotations

import bisect
import html as markup
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readroute.llm.common import pick

# Names of elements and roles in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol option p pre search section summary table tbody tfoot thead title tr ul".split()
)
LEFT_OUT = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object canvas svg math audio video dialog menu search xmp noembed noframes title".split())
ROLES_LEFT_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: What the open elements of each kind are closed by, and how far out they are looked for.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in classes and ids of what is no main text, and of containers of it.
SITE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending comment comments disqus discussion replies respond pagination pager skip search form copyright".split()
)
HEADER_WORDS, TITLE_WORDS = frozenset(["header", "head"]), frozenset("article post entry story title headline".split())
CONTENT_WORDS = frozenset("article content post entry story main text body".split())
#: Open elements that are followed; what is deeper counts as part of them.
DEEPEST = 512
#: Rows times columns up to which an alignment keeps all its bit rows.
BITS = 1 << 26

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^<>]*+)(?:>|(?=<)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNLESS = re.compile(r"\b(?:has|with|no|without|is)[-_]\w+", re.I)


@dataclass(frozen=True)
class Line:
    """A block of text; zone: 3 in an article, 2 in a main element, 1 in a container named as content, else 0."""

    text: str
    zone: int
    loose: bool  # of a block with a class or id of its own below that, or all link


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)}


def _judged(name: str, attributes: str) -> tuple[bool, int, bool]:
    """(left out, zone, has a class or id) of an element by itself."""
    zone = {"article": 3, "main": 2}.get(name, 0)
    if not attributes or name in ("html", "body"):
        return name in LEFT_OUT or name == "header", zone, False
    a = _attributes(attributes)
    role, named = a.get("role", "").lower(), f"{a.get('class', '')} {a.get('id', '')}"
    words = set(map(str.lower, _WORD.findall(_UNLESS.sub(" ", named))))
    out = name in LEFT_OUT or role in ROLES_LEFT_OUT or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
    out |= name == "header" and not words & TITLE_WORDS
    out |= bool(words & SITE_WORDS) or bool(words & HEADER_WORDS) and not words & TITLE_WORDS
    if not zone:
        zone = 2 if role == "main" or a.get("itemprop") == "articleBody" else 3 if role == "article" else int(bool(words & CONTENT_WORDS))
    return out, zone, bool(named.strip())


class Reader:
    """Cuts one page into lines."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # name, left out, zone, loose
        self.count: dict[str, int] = {}
        self.out, self.zone, self.loose = False, 0, False
        self.links = 0
        self.begin()

    def begin(self) -> None:
        self.held: list[str] = []
        self.linked = True

    def end_block(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.lines.append(Line(text, self.zone, self.loose or self.linked))
            self.begin()

    def text(self, text: str) -> None:
        if text and not self.out:
            self.held.append(markup.unescape(text) if "&" in text else text)
            self.linked &= self.links > 0 or text.isspace()

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name in BLOCK:
            self.end_block()
            self.close({"p"}, {"button", "table", "td", "th", "caption", "object"})
        elif name in ("td", "th"):
            self.text(" ")
        if name in VOID:
            return
        if name in CLOSED_BY:
            self.close(*CLOSED_BY[name])
        if len(self.open) >= DEEPEST:
            return
        out, zone, named = _judged(name, attributes)
        zone = zone if name in BLOCK else 0
        if name == "header" and self.zone >= 2 and not attributes:
            out = False  # an article's own head has its title
        inner = zone <= self.zone
        self.open.append((name, self.out or out, max(zone, self.zone), inner and (self.loose or named and name in BLOCK)))
        self.count[name] = self.count.get(name, 0) + 1
        self.look()

    def look(self) -> None:
        """The state within the innermost open element."""
        _, self.out, self.zone, self.loose = self.open[-1] if self.open else ("", False, 0, False)
        self.links = self.count.get("a", 0)

    def close(self, names: set[str], until: set[str]) -> None:
        if not any(self.count.get(n) for n in names):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                self.cut(k)
                return
            if self.open[k][0] in until:
                return

    def cut(self, k: int) -> None:
        """Close the open elements from the k-th on; where none of them is a block, the text around goes on."""
        if any(name in BLOCK for name, *_ in self.open[k:]):
            self.end_block()
        for name, *_ in self.open[k:]:
            self.count[name] -= 1
        del self.open[k:]
        self.look()

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.end_block()
        if not self.count.get(name):
            return
        for k in range(len(self.open) - 1, -1, -1):
            here = self.open[k][0]
            if here == name:
                self.cut(k)
                return
            if name not in BLOCK and here in BLOCK:
                return  # the end of an inline element does not end blocks in it


def page_lines(page: str) -> list[Line]:
    """The lines of a page that its structure doesn't leave out, of the best zone that has any."""
    reader, at = Reader(), 0
    while True:
        m = _TAG.search(page, at)
        reader.text(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            reader.end(name)
            continue
        reader.start(name, m[3].strip())
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else len(page)
    reader.end_block()
    best = max((x.zone for x in reader.lines), default=0)
    return [x for x in reader.lines if x.zone >= min(best, 2) and (best < 3 or x.zone == 3)]


def _bit_rows(a: list[str], b: list[str], keep: bool) -> list[int]:
    """Rows of the bit-parallel alignment of `a` with `b`: a bit of row i is 0 where a[: i + 1] has one more line in common with b up to there."""
    places: dict[str, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lines that `a` has in common with each beginning of `b`."""
    if not a:
        return np.zeros(len(b) + 1, np.int64)
    bits = np.frombuffer(_bit_rows(a, b, False)[0].to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.append(0, np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64)))


def shared(a: list[str], b: list[str]) -> list[int]:
    """Places in `a` of a longest common subsequence with `b`, in memory about linear in both."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ends = [*range(lo)], [*range(len(a) - hi, len(a))]
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return ends[0] + ends[1]
    if len(a) > 1 and len(a) * len(b) > BITS:
        half = len(a) // 2
        at = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        middle = shared(a[:half], b[:at]) + [half + k for k in shared(a[half:], b[at:])]
    else:
        rows, middle = _bit_rows(a, b, True), []
        i, j = len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                middle.append(i)
        middle.reverse()
    return [*ends[0], *(lo + k for k in middle), *ends[1]]


@dataclass
class Page:
    host: str
    path: str
    lines: list[Line]
    texts: list[str]
    row: tuple  # what goes out with it; None for a neighbour only


def nearness(a: Page, b: Page) -> tuple[int, int]:
    """Leading path segments, then characters, that two URLs have in common."""
    common = lambda x, y: sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(x, y)))
    return common(a.path.split("/"), b.path.split("/")), common(a.path, b.path)


def difference(page: Page, before: Page | None, after: Page | None) -> list[str]:
    """The page's lines without those that it shares with its partner."""
    near = [p for p in (before, after) if p is not None and p.host == page.host and page.host]
    near.sort(key=lambda p: nearness(page, p), reverse=True)
    free = [k for k, x in enumerate(page.lines) if x.zone < 2 or x.loose]
    if not free:
        return page.texts
    for partner in near:
        gone = set(shared(page.texts, partner.texts)) & set(free)
        if page.lines[0].zone < 2 and 2 * sum(len(page.texts[k]) for k in gone) > sum(map(len, page.texts)):
            continue  # copies of each other
        return [x for k, x in enumerate(page.texts) if k not in gone]
    return page.texts


def _url_part(url: Column, group: int) -> Column:
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)([^?#]*)", group)
    return F.lower(part) if group == 1 else part


def _ranges(keys: DataFrame, n: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """(first key of each range but the first, key of a page at an end of its range: the ranges that need it as a neighbour).

    Keys of about 40 pages a range are drawn by hash; what comes to the driver grows with
    the number of ranges, not of pages.
    """
    total = keys.count()
    if n < 2 or total < 2:
        return [], {}
    share = min(1.0, 40 * n / total)
    drawn = keys.filter(F.pmod(F.xxhash64(F.lit(5), *keys.columns), F.lit(1 << 30)) < share * (1 << 30))
    found = sorted(map(tuple, drawn.collect()))
    bounds = sorted({found[len(found) * k // n] for k in range(1, n)} if found else set())
    ends = keys.withColumn("range", _range_of(bounds)(*keys.columns)).groupBy("range").agg(F.min(F.struct(*keys.columns)).alias("first"), F.max(F.struct(*keys.columns)).alias("last")).orderBy("range").collect()
    needed: dict[tuple, list[int]] = {}
    for left, right in itertools.pairwise(ends):
        needed.setdefault(tuple(left["last"]), []).append(right["range"])
        needed.setdefault(tuple(right["first"]), []).append(left["range"])
    return bounds, needed


def _range_of(bounds: list[tuple]):
    @F.pandas_udf("int")
    def number(host, path, url, key):
        return pa.array([bisect.bisect_right(bounds, k) for k in zip(host, path, url, key, strict=True)], pa.int32()).to_pandas()

    return number


def html_difference(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: (id, url, text, n_chars, n_shared).

    Blocks are joined by two newlines in the order of the page, white space within one is
    one space. n_shared: lines deleted as shared with the partner. A null or empty page has
    an empty text; a page without a host in its URL (null, no `://`), or alone on its host,
    has no partner. Of two neighbours as near as each other the one before counts; pages of
    one path are in the order of url and id. Pages of any length are read whole. One row for
    each input row, rows alike included (those alike in id and url sit in one range); other
    columns are not read, whatever their names.
    """
    picked = pick(pages, id=id_col, url=url_col, page=html_col)
    spark = pages.sparkSession
    kind = picked.schema["id"].dataType.simpleString()
    keyed = picked.withColumns({"host": _url_part(F.col("url"), 1), "path": _url_part(F.col("url"), 2), "at": F.coalesce("url", F.lit("")), "key": F.coalesce(F.col("id").cast("string"), F.lit(""))})
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), picked.rdd.getNumPartitions())
    bounds, needed = _ranges(keyed.select("host", "path", "at", "key"), n)

    @F.pandas_udf("array<int>")
    def ranges(host, path, url, key):
        """The page's range, and as -1 - r each range r that needs it as a neighbour."""
        out = []
        for k in zip(host, path, url, key, strict=True):
            out.append([bisect.bisect_right(bounds, k), *[-1 - r for r in needed.get(k, ())]])
        return pa.array(out, pa.list_(pa.int32())).to_pandas()

    order = ["range", "host", "path", "at", "key"]
    dealt = keyed.withColumn("to", F.explode(ranges("host", "path", "at", "key"))).withColumns({"range": F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")), "own": F.col("to") >= 0}).drop("to")
    sorted_ = dealt.repartition(n, "range").sortWithinPartitions(*order).select("range", "own", "host", "path", "id", "url", "page")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Page]]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, own, host, path, _, url, page = (batch.column(c)[k].as_py() if c != 4 else None for c in range(7))
                lines = page_lines(page or "")
                yield number, Page(host, path, lines, [x.text for x in lines], (batch.column(4).slice(k, 1), url) if own else None)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[pa.Array, str, str, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([r[0] for r in rows])
            batch = pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["id", "url", "text", "n_chars", "n_shared"])
            rows.clear()
            return batch

        before = here = None
        for after in itertools.chain(read(batches), [None]):
            if here is not None and here[1].row is not None:
                beside = [x[1] if x is not None and x[0] == here[0] else None for x in (before, after)]
                left = difference(here[1], *beside)
                text = "\n\n".join(left)
                rows.append((*here[1].row, text, len(here[1].lines) - len(left)))
                size += len(text)
                if size > 1 << 22:
                    yield flush()
                    size = 0
            before, here = here, after
        if rows:
            yield flush()

    return sorted_.mapInArrow(texts, f"id {kind}, url string, text string, n_chars long, n_shared long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
