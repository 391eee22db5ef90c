"""Main text of web pages by differencing each page against its nearest neighbours on the host.

A page becomes text lines (blocks). Pages are ordered by host and URL path, so that neighbours share a template. Lines are
aligned with those of the nearest pages by longest common subsequence, and shared lines are template:

- a page much of whose own text is shared is a copy, and says nothing of the template; the next nearest is taken;
- a line outside an <article> or <main> goes if the nearest page that is no copy shares it;
- a line inside one goes if at least half of the nearest pages that are no copies share it, three of them at least, as two
  articles may well quote the same line;
- where no page shares a line (menus that differ from page to page, a page alone on its host), element and class names
  that name page furniture decide.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_RAW = re.compile(r"(script|style|textarea|title|iframe)\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "iframe")}
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_NONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

#: Neighbours on either side that a page may be compared with; those of them that vote on lines inside an article;
#: share of a page's text that makes a page which has it a copy.
NEAR, VOTERS, COPY = 8, 5, 0.5
#: Cells of an alignment table that are held at once.
CELLS = 1 << 27

# Inline elements, void elements, furniture by element, furniture by a word of class, id or role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form button select option fieldset head menu dialog object applet audio video canvas svg math template noscript".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies respond disqus widget pagination pager toolbar skip contentinfo complementary search".split())
# What may follow a furniture word in a name ("nav-list", "ad_slot_2").
PARTS = frozenset("area bar block box container content group holder inner item items left link links list main outer panel right row section slot top bottom text title wrap wrapper".split())


def _furniture(name: str, attrs: str, inside: bool) -> bool:
    if name in FURNITURE or (name == "header" and not inside):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _NONE.search(value)):
            return True
        if key in ("class", "id", "role", "aria-label"):
            for label in value.lower().split():
                words = [w for w in re.split(r"[-_:\d]+", label) if w]
                # the word that the name ends in, or that it begins with if only parts of a layout follow
                if words and (words[-1] in HINTS or (words[0] in HINTS and PARTS.issuperset(words[1:]))):
                    if not (inside and words[-1] == "header"):
                        return True
    return False


class Tags:
    """What in a page is markup, from its start on: (start, end, kind, name, attributes), kind being "" for an opening tag, "/" for
    a closing one, "raw" for an element whose content is no text, and None for comments, declarations and the like.

    A ">" in quotes ends no tag. Where a quote is not closed, its tag is text, and so are all that lead to the same quote:
    these are remembered, and the next ">" or quote is found by binary search, so the time grows with the page alone."""

    def __init__(self, page: str):
        self.page = page
        self.ends = [m.start() for m in re.finditer(r"[>\"']", page)]
        self.marks = {c: [i for i in self.ends if page[i] == c] for c in ">\"'"}
        self.futile: set[int] = set()

    def _next(self, c: str, at: int) -> int:
        """Where the character comes next; -1 if it doesn't."""
        places = self.marks[c]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def _close(self, at: int) -> int:
        """The ">" that ends a tag whose attributes begin here; -1 if there is none."""
        seen = []
        k = bisect_left(self.ends, at)
        while k < len(self.ends):
            i = self.ends[k]
            if self.page[i] == ">":
                return i
            if i in self.futile:
                break
            seen.append(i)
            closed = self._next(self.page[i], i + 1)
            if closed < 0:
                break
            k = bisect_left(self.ends, closed + 1)
        self.futile.update(seen)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str | None, str, str]]:
        page, at, n = self.page, 0, len(self.page)
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("!--", at):
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
                yield start, at, None, "", ""
                continue
            gt = self._next(">", at)
            raw = _RAW.match(page, at) if gt >= 0 else None
            if raw:
                end = _RAW_END[raw[1].lower()].search(page, gt + 1)
                at = end.end() if end else n
                yield start, at, "raw", raw[1].lower(), ""
                continue
            named = _NAME.match(page, at)
            if named and (end := self._close(named.end())) >= 0:
                at = end + 1
                yield start, at, named[1], named[2].lower(), page[named.end() : end]
                continue
            mark = page[at : at + 1]
            if gt < 0 and (named or mark in ("!", "?", "/")):
                yield start, n, None, "", ""
                return
            odd = mark == "/" and gt > at + 1 and not ("a" <= page[at + 1].lower() <= "z")
            if gt >= 0 and (odd or mark in ("!", "?")):
                at = gt + 1
                yield start, at, None, "", ""


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """Blocks in page order: text, inside a content element, inside furniture. White space within a
    block is one space; empty blocks are left out. Character references are decoded within a piece of text, never
    across a tag. What is not closed ends with the element around it; time grows with the page alone."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, content from here, furniture from here
    opened: Counter = Counter()
    inside = skip = 0
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, inside > 0, skip > 0))

    def close() -> str:
        nonlocal inside, skip
        top, content, furniture = stack.pop()
        opened[top] -= 1
        if content or furniture:
            flush()
        inside -= content
        skip -= furniture
        return top

    at = 0
    for start, end, kind, name, attributes in Tags(page):
        if start > at:
            held.append(html.unescape(page[at:start]))
        at = end
        if kind is None:
            continue
        if kind == "raw" or name == "br":
            held.append(" ")
            continue
        if name not in INLINE:
            flush()
        if kind:
            if opened[name]:
                while close() != name:
                    pass
        elif name not in VOID and not attributes.endswith("/"):
            if name == "p" or name == "li":  # these close one another without an end tag
                while stack and (stack[-1][0] == name or stack[-1][0] in INLINE):
                    close()
            content = name in ("article", "main")
            furniture = _furniture(name, attributes, inside > 0)
            if furniture and name in INLINE:
                flush()
            stack.append((name, content, furniture))
            opened[name] += 1
            inside += content
            skip += furniture
    held.append(html.unescape(page[at:]))
    flush()
    return out


def _row(x: list, y: list) -> int:
    """The last row of the alignment table: bit i is clear where the length grows with x[i]."""
    where: dict = {}
    for i, value in enumerate(x):
        where[value] = where.get(value, 0) | 1 << i
    full = row = (1 << len(x)) - 1
    for value in y:
        hit = row & where.get(value, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def _lengths(row: int, n: int) -> np.ndarray:
    """Length of the longest common subsequence with each prefix of x, from the row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by bit-parallel rows. Of alignments with more than CELLS cells the
    second sequence is halved at the best cut, so memory is bounded by the lengths."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(y) > 1 and len(x) * len(y) > CELLS:
        cut = len(y) // 2
        total = _lengths(_row(x, y[:cut]), len(x)) + _lengths(_row(x[::-1], y[cut:][::-1]), len(x))[::-1]
        at = int(total.argmax())
        pairs += [(head + i, head + j) for i, j in lcs(x[:at], y[:cut])] + [(head + at + i, head + cut + j) for i, j in lcs(x[at:], y[cut:])]
        return sorted(pairs)
    where: dict = {}
    for i, value in enumerate(x):
        where[value] = where.get(value, 0) | 1 << i
    full, row, rows = (1 << len(x)) - 1, (1 << len(x)) - 1, []
    for value in y:
        hit = row & where.get(value, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j = len(x), len(y)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not (j and not rows[j - 1] >> (i - 1) & 1):
                i -= 1
                pairs.append((head + i, head + j))
    return sorted(pairs)


def address(url: str | None) -> tuple[str, str]:
    """Host without www., and path without query and fragment; no host if there is none or the URL is broken."""
    try:
        parts = urlsplit(url or "")
        return re.sub(r"^www\.", "", (parts.hostname or "").lower()), unquote(parts.path).rstrip("/") or "/"
    except ValueError:
        return "", url or ""


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Page:
    """A page of the sorted stream, or several that are equal."""

    __slots__ = ("key", "ids", "url", "host", "path", "lines", "hashes", "content", "furniture", "marked", "size")

    def __init__(self, key, url, host, path, texts, marks):
        self.key, self.ids, self.url, self.host, self.path = key, [], url, host, path
        self.lines = list(texts)
        self.hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in self.lines]
        self.content, self.furniture = [m & 1 for m in marks], [m >> 1 for m in marks]
        self.marked = any(c and not f for c, f in zip(self.content, self.furniture, strict=True))
        #: Length of every different line of the text as the markup has it.
        self.size = {h: len(t) for h, t, k in zip(self.hashes, self.lines, self.named(), strict=True) if k}

    def named(self) -> list[bool]:
        """What the markup alone would keep."""
        return [(c or not self.marked) and not f for c, f in zip(self.content, self.furniture, strict=True)]

    def copied(self, other: Page) -> bool:
        """Whether the other page has much of this one's own text."""
        return sum(n for h, n in self.size.items() if h in other.size) > COPY * sum(self.size.values())

    def text(self, near: list[Page], differencing: bool = True) -> tuple[str, int]:
        """Main text and number of lines that differencing alone removed. ``near``: pages of the host, nearest first."""
        keep, gone = self.named(), 0
        if differencing:
            voters, votes = 0, Counter()
            for other in near:
                if voters == VOTERS:
                    break
                if not self.copied(other):
                    shared = {i for i, _ in lcs(self.hashes, other.hashes)}
                    if not voters:
                        first = shared
                    votes.update(shared)
                    voters += 1
            if voters:
                for i, k in enumerate(keep):
                    if k and (i in first if not self.content[i] else votes[i] >= max(3, voters / 2)):
                        keep[i] = False
                        gone += 1
        return "\n\n".join(line for line, k in zip(self.lines, keep, strict=True) if k), gone


def _keys(frames):
    for frame in frames:
        found = [address(u) for u in frame["url"]]
        yield pd.DataFrame({"host": [h for h, _ in found], "path": [p for _, p in found], "digest": frame["digest"].to_numpy()})


def _edges(frames):
    """First and last keys of a sorted partition."""
    first, last = [], []
    for frame in frames:
        for key in zip(frame["host"].tolist(), frame["path"].tolist(), frame["digest"].tolist(), strict=True):
            if len(first) < NEAR:
                first.append(key)
            last.append(key)
            if len(last) > 2 * NEAR:
                del last[:NEAR]
    if first:
        tail = [k for k in last[-NEAR:] if k not in first]
        yield pd.DataFrame([(*k, i < len(first)) for i, k in enumerate(first + tail)], columns=["host", "path", "digest", "head"])


def _difference(frames, differencing: bool):
    """Rows come sorted by range, host, path and digest; each is held until its followers are known."""
    window: list[Page] = []
    at, key = 0, None  # the next page to be written, in the window

    def done(i: int) -> list[tuple]:
        page = window[i]
        if not page.ids:
            return []
        near = [(abs(k - i), x) for k, x in enumerate(window[max(0, i - NEAR) : i + NEAR + 1], max(0, i - NEAR)) if k != i and page.host and x.host == page.host]
        near.sort(key=lambda x: (-_common(x[1].path, page.path), x[0]))
        text, gone = page.text([x for _, x in near], differencing)
        return [(i, page.url, text, len(text), gone) for i in page.ids]

    for frame in frames:
        rows = []
        for v in frame.astype({"page_id": "Int64"}).itertuples(index=False):
            if v.range != key:
                for i in range(at, len(window)):
                    rows += done(i)
                window, at, key = [], 0, v.range
            if not window or window[-1].key != (v.host, v.path, v.digest):
                window.append(Page((v.host, v.path, v.digest), v.url, v.host, v.path, v.lines, v.marks))
                if len(window) - at > NEAR + 1:
                    rows += done(at)
                    at += 1
                if at > 2 * NEAR:
                    del window[: at - NEAR]
                    at = NEAR
            if v.own:
                window[-1].ids.append(v.page_id)
        yield _frame(rows)
    yield _frame([row for i in range(at, len(window)) for row in done(i)])


def _frame(rows):
    return pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars", "n_lines_shared"]).astype({"page_id": "Int64"})


def extract(pages: DataFrame, ranges: int | None = None, differencing: bool = True) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points), n_lines_shared (lines that would be
    kept by their markup and are removed as shared).

    Pages are dealt by range of (host, path), never by host alone, so a host with a third of all pages
    spreads over many tasks; the NEAR pages beyond each end of a range go along, so the result does not depend on the
    number of ranges (that of shuffle partitions, unless given). Pages of equal path are ordered by a hash of their html.
    Null or empty html gives an empty text; a page with a null or broken url has no neighbours. Equal rows stay separate
    rows and count as one page for their neighbours; an empty table gives an empty table; other columns are ignored.
    ``differencing=False`` leaves all to the markup, for comparison.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    digest = F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), digest.alias("digest"))
    keys = pages.select("url", "digest").mapInPandas(_keys, "host string, path string, digest long").distinct()
    ends = keys.repartitionByRange(ranges, "host", "path", "digest").sortWithinPartitions("host", "path", "digest").mapInPandas(_edges, "host string, path string, digest long, head boolean")
    # at most 2 * NEAR keys a range come to the driver
    parts: dict[int, list] = {}
    for r in ends.withColumn("part", F.spark_partition_id()).collect():
        parts.setdefault(r["part"], []).append(((r["host"], r["path"], r["digest"]), r["head"]))
    order = sorted((part for part in parts.values()), key=lambda part: part[0][0])
    starts = [part[0][0] for part in order][1:]
    #: Keys that also go to other ranges: those within NEAR of a range's end.
    guests: dict[tuple, set[int]] = {}
    for k in range(1, len(order)):
        before, after = [], []
        for j in range(k - 1, -1, -1):
            before = [key for key, _ in order[j]][-(NEAR - len(before)) :] + before
            if len(before) >= NEAR:
                break
        for j in range(k, len(order)):
            after += [key for key, head in order[j]][: NEAR - len(after)]
            if len(after) >= NEAR:
                break
        for key in before[-NEAR:]:
            guests.setdefault(key, set()).add(k)
        for key in after[:NEAR]:
            guests.setdefault(key, set()).add(k - 1)

    def deal(frames):
        for frame in frames:
            rows = []
            for page_id, url, text, code in zip(frame["page_id"].astype("Int64"), frame["url"], frame["html"], frame["digest"], strict=True):
                host, path = address(url)
                own = bisect_right(starts, (host, path, code))
                parts = lines(text)
                row = (page_id, url, host, path, code, [t for t, _, _ in parts], bytes(c | f << 1 for _, c, f in parts))
                rows.append((own, True, *row))
                rows += [(other, False, *row) for other in guests.get((host, path, code), ()) if other != own]
            yield pd.DataFrame(rows, columns=["range", "own", "page_id", "url", "host", "path", "digest", "lines", "marks"]).astype({"page_id": "Int64"})

    dealt = pages.mapInPandas(deal, "range int, own boolean, page_id long, url string, host string, path string, digest long, lines array<string>, marks binary")
    ordered = dealt.repartitionById(max(ranges, len(order)), "range").sortWithinPartitions("range", "host", "path", "digest", "page_id")
    return ordered.mapInPandas(lambda f: _difference(f, differencing), "page_id long, url string, text string, n_chars long, n_lines_shared long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
