"""Main text of web pages, by wrappers: union-free regular expressions inferred from the token streams of a host's pages.

A page is a stream of tags and texts. Its elements, repeated runs of which become one repeated group, are aligned with the
host's wrapper so far, level by level: what only one of them has becomes optional, what both have in a different
number becomes repeated, and texts that differ become slots. Wrappers align with wrappers in the same way, so that
partitions infer their own, which are merged by host in two rounds. The wrapper tells what a host's template is: a text
that stands at one place of the template and is the same on all its pages is no page's own; what fills the slots is. Where
a page has no article or main element, and no names that tell, the slots alone decide. Else what a slot is for, menu or
article, its tags and classes say too.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import HEAVY, join_groups, written
from tierloom.llm.url_filter import host_of

#: Levels of nesting that a wrapper tells apart; what is nested deeper belongs to the last of them. No text is left out.
DEEP = 150
#: Cells of an alignment's table at most; for longer rows of children its rows are bits, some of them kept. The alignment is the same.
CELLS = 1 << 24
#: Bytes of templates that are broadcast at most.
SENT = 64 << 20
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|template|noscript|iframe|textarea|title|xmp|noembed)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are never part of an article, and elements that close an open paragraph.
OUTSIDE = frozenset("head nav header footer aside form button select option menu dialog svg canvas object audio video map datalist fieldset label".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of a class, id or role that say the same of any element.
WORDS = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside ad ads adv advert adverts advertisement advertising adsense banner banners sponsor "
    "sponsored promo promos promotion notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments disqus respond reply replies widget widgets toolbar pagination pager skip copyright legal contentinfo complementary search alert form".split()
)
#: Those of them that say so, also as a part of a name, however much text there is.
REPLIES = frozenset("comment comments disqus respond reply replies".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose text, in an article, is the article's even if all pages have it.
PROSE = _HEADINGS | {"p", "blockquote", "pre"}


@lru_cache(65536)
def _opened(tag: str, rest: str) -> tuple[str, bool, bool, bool]:
    """An element's label (tag and classes), whether it is outside articles, whether it is only by its words, and only by parts of its names."""
    a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest else {}
    label = tag + "".join("." + re.sub(r"\d+", "0", c) for c in sorted(set(a.get("class", "").split())))
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    names = {n for k in ("class", "id", "role") for n in a.get(k, "").lower().split()}
    parts = {w for n in names for w in re.split(r"[^a-z]+", n)} & (REPLIES if tag == "article" else WORDS)
    worded = bool(parts) and tag not in ("html", "body", "main")
    only = worded and not hidden and tag not in OUTSIDE
    return label, hidden or tag in OUTSIDE or worded, only, only and not names & WORDS and not parts & REPLIES


def walk(page: str) -> Iterator[tuple[str, object]]:
    """The page's stream: ("open", (label, outside, only by words, only by parts of names, tag)), ("close", number of elements), ("text", characters), ("break", None)."""
    stack: list[str] = []
    open_: Counter[str] = Counter()

    def depth(tag: str) -> int:
        """Elements from the innermost open one of this tag to the top."""
        n = 1
        while stack[-n] != tag:
            n += 1
        return n

    def closed(n: int) -> tuple[str, int]:
        open_.subtract(stack[-n:])
        del stack[-n:]
        return "close", n

    for m in _TOKEN.finditer(page):
        raw = m[0]
        if m[3] is None:
            if raw[0] != "<" or raw == "<":
                yield "text", html.unescape(raw)
            elif m[1] is None and raw.startswith("<![CDATA["):
                yield "text", raw[9:].removesuffix("]]>")
            continue
        tag, rest = m[3].lower(), m[4].strip().rstrip("/")
        if m[2]:
            if open_[tag]:
                yield closed(depth(tag))
            if tag not in INLINE:
                yield "break", None
            continue
        if tag in CLOSES_P and open_["p"]:
            n = depth("p")
            if not any(t in ("div", "td", "li", "article", "section", "blockquote") for t in stack[-n:]):
                yield closed(n)
        elif tag == "li" and open_["li"]:
            n = depth("li")
            if not any(t in ("ul", "ol", "menu") for t in stack[-n:]):
                yield closed(n)
        if tag not in INLINE:
            yield "break", None
        if tag not in VOID:
            stack.append(tag)
            open_[tag] += 1
            yield "open", (*_opened(tag, rest), tag)


# A wrapper's node is [label, optional, repeated, pages, children]; that of a text has the label "#" and, for children, the digests of its texts (several in a
# repeated group), or None for a slot.


def _digest(text: str) -> str:
    return hashlib.sha1(_SPACE.sub(" ", text).strip().encode("utf-8", "surrogatepass")).hexdigest()[:20]


def shape(page: str) -> list:
    """The page as a wrapper of its own."""
    root = ["", False, False, 1, []]
    stack, deeper = [root], 0
    for kind, x in walk(page):
        if kind == "open":
            if len(stack) > DEEP:
                deeper += 1
                continue
            node = [x[0], False, False, 1, []]
            stack[-1][4].append(node)
            stack.append(node)
        elif kind == "close":
            below = min(x, deeper)
            deeper -= below
            if x > below:
                del stack[below - x :]
        elif kind == "text" and not x.isspace():
            stack[-1][4].append(["#", False, False, 1, {_digest(x)}])
    root = _folded(root)
    stack = [root]
    while stack:
        node = stack.pop()
        if node[0] == "#":
            node[4] = sorted(node[4])
        else:
            stack += node[4]
    return root


def _folded(node: list) -> list:
    """Repeated runs of children, of one to four labels, as one repeated group each: the squares are merged, innermost first."""
    if node[0] == "#":
        return node
    kids: list[list] = []
    for k in map(_folded, node[4]):
        kids.append(k)
        for n in range(1, 5):
            if len(kids) < 2 * n or any(a[0] != b[0] for a, b in zip(kids[-2 * n : -n], kids[-n:], strict=True)):
                continue
            if n == 1 and k[0] == "#":
                continue
            again = kids[-n:]
            del kids[-n:]
            for i, b in enumerate(again):
                one = _merged(kids[i - n], b, 0)
                kids[i - n] = [one[0], one[1], True, *one[3:]]
            break
    return [*node[:4], kids]


def _merged(a: list, b: list, more: int = 1) -> list:
    """Two nodes of one label as one; ``more``: 1 if they come from different pages, whose numbers add up."""
    pages = a[3] + b[3] if more else max(a[3], b[3])
    if a[0] == "#":
        if more:
            texts = a[4] if a[4] == b[4] else None
        else:  # of one page: the texts of the group, which another page may have as well; the larger set takes the other in
            few, texts = sorted((a[4], b[4]), key=len)
            texts |= few
        return ["#", a[1] or b[1], a[2] or b[2], pages, texts]
    return [a[0], a[1] or b[1], a[2] or b[2], pages, _aligned(a[4], b[4], more)]


def _aligned(a: list, b: list, more: int) -> list:
    """Two rows of children as one: what both have, in the longest common order, is merged; the rest is optional."""
    head = 0
    while head < min(len(a), len(b)) and a[head][0] == b[head][0]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail][0] == b[-1 - tail][0]:
        tail += 1
    out = [_merged(x, y, more) for x, y in zip(a[:head], b[:head], strict=True)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    pairs = _pairs([k[0] for k in x], [k[0] for k in y])
    i = j = 0
    for at, to in [*pairs, (len(x), len(y))]:
        out += [[k[0], True, *k[2:]] for k in (*x[i:at], *y[j:to])]
        if at < len(x):
            out.append(_merged(x[at], y[to], more))
        i, j = at + 1, to + 1
    return out + [_merged(x, y, more) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]


def _pairs(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of two rows of labels."""
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(k, len(number)) for k in row], np.int64) for row in (x, y))
    out, j = [], 0
    if not len(a) or not len(b):
        return out
    if len(a) * len(b) > CELLS:
        return _pairs_by_bits(a, b)
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)  # of what is left of both
    for i in range(len(a) - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], np.where(b == a[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    i = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _pairs_by_bits(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The same pairs in less room: a row of the table is one number, whose bits say where the length grows; every so many rows are kept, the others made again."""
    n, step = len(b), isqrt(len(a)) + 1
    full = (1 << n) - 1

    @lru_cache(1024)
    def places(label: int) -> int:
        return int.from_bytes(np.packbits(b[::-1] == label, bitorder="little").tobytes(), "little")

    def before(row: int, i: int) -> int:
        both = row & places(int(a[i]))
        return (row + both | row - both) & full

    kept, row = {len(a): full}, full
    for i in range(len(a) - 1, -1, -1):
        row = before(row, i)
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def length(i: int, j: int) -> int:
        """Of the longest common subsequence of what is left of both."""
        left = n - j
        return left - (rows[i] & (1 << left) - 1).bit_count()

    out, i, j = [], 0, 0
    while i < len(a) and j < n:
        if i not in rows or i + 1 not in rows:
            end = min(len(a), i - i % step + step)
            rows = {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                rows[k] = before(rows[k + 1], k)
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length(i + 1, j) == length(i, j):
            i += 1
        else:
            j += 1
    return out


def expression(node: list) -> str:
    """The wrapper as a regular expression without unions: ( ... )+ is repeated, ( ... )? optional, #TEXT a slot."""
    if node[0] == "#":
        s = "#TEXT" if node[4] is None else "=" + node[4][0][:6]
    else:
        inner = " ".join(map(expression, node[4]))
        s = f"<{node[0]}> {inner} </{node[0]}>" if node[0] else inner
    return f"( {s} ){'*' if node[1] and node[2] else '+' if node[2] else '?'}" if node[1] or node[2] else s


def template(root: list) -> list[str]:
    """Places and digests of the template's own texts: those that all pages have, if there is anything that not all have.

    How much text there is, or how many pages, decides nothing. Inside article or main elements and outside of them is judged
    by itself, so that pages that have the same article with other menus around it keep it. What an article has in headings
    and paragraphs is its own, even on all pages: pages may be copies of each other but for a date.
    """
    found: list[tuple[str, bool]] = []
    vary = set()  # whether what differs is inside

    def look(node: list, path: str, always: bool, inside: bool, prose: bool) -> None:
        for k in node[4]:
            on_all = always and not k[1] and k[3] == root[3]
            if k[0] != "#":
                tag = k[0].split(".")[0]
                within = inside or tag in ("article", "main")
                look(k, path + "/" + k[0], on_all, within, within and (prose or tag in PROSE))
            elif not on_all or k[4] is None:
                vary.add(inside)
            elif not prose:
                found.extend((path + " " + d, inside) for d in k[4])

    look(root, "", root[3] > 1, False, False)
    return [place for place, inside in found if inside in vary]


def _large(steps: list[tuple[str, object]]) -> set[int]:
    """The numbers of the steps that open an element outside only by parts of its names, but with half of the page's text or more."""
    if not any(kind == "open" and x[3] for kind, x in steps):
        return set()
    total, sizes = 0, {}
    stack: list[tuple[int, bool, int]] = [(-1, False, 0)]  # of each open element: its step, whether its text counts not, text before it

    def close(n: int) -> None:
        for _ in range(n):
            at, _, before = stack.pop()
            sizes[at] = total - before

    for i, (kind, x) in enumerate(steps):
        if kind == "open":
            stack.append((i, stack[-1][1] or (x[1] and not x[3]), total))
        elif kind == "close":
            close(x)
        elif kind == "text" and not stack[-1][1]:
            total += len(x.strip())
    close(len(stack))
    return {i for i, size in sizes.items() if i >= 0 and steps[i][0] == "open" and steps[i][1][3] and size and 2 * size >= total}


def main_text(page: str, own: frozenset[str] = frozenset()) -> str:
    """The page's article: of its outermost article or main elements if it has any, else of the whole body. ``own``: its host's template."""
    inside: list[list[str]] = []  # the blocks of articles
    anywhere: list[list[str]] = []
    path, deeper, marks = [""], 0, [(False, False, False)]  # of each open element: outside, outside only by words, in an article
    fresh_in = fresh_any = True
    has_article = False
    steps = list(walk(page))
    large = _large(steps)
    for i, (kind, x) in enumerate(steps):
        if kind == "open":
            label, out, worded, _, tag = x
            was_out, was_worded, article = marks[-1]
            if i in large or (tag == "article" and worded and not was_out and not article):  # articles are replies only in something else
                out = worded = False
            if tag in ("article", "main") and not out and (not was_out or was_worded):
                was_out = was_worded = False  # what holds the article isn't outside it, whatever its class
                article = has_article = True
            elif tag in _HEADINGS and article and path[-1].rpartition("/")[2].startswith("header") and not worded:
                was_out = out = False
            if len(path) > DEEP:
                deeper += 1
            else:
                path.append(path[-1] + "/" + label)
            marks.append((was_out or out, worded if not was_out else was_worded, article))
        elif kind == "close":
            del marks[-x:]
            below = min(x, deeper)
            deeper -= below
            if x > below:
                del path[below - x :]
        elif kind == "break":
            fresh_in = fresh_any = True
        elif not marks[-1][0] and (x.isspace() or not own or path[-1] + " " + _digest(x) not in own):
            for blocks, fresh in ((anywhere, fresh_any), *(((inside, fresh_in),) if marks[-1][2] else ())):
                if fresh or not blocks:
                    blocks.append([])
                blocks[-1].append(x)
            fresh_any = False
            if marks[-1][2]:
                fresh_in = False
    blocks = (" ".join(_SPACE.split("".join(b))).strip() for b in (inside if has_article else anywhere))
    return " ".join(b for b in blocks if b)


def _in(data: bytes) -> list:
    """A wrapper, of its bytes; its depth is bounded by DEEP."""
    return json.loads(zlib.decompress(data))


def _out(wrapper: list) -> bytes:
    return zlib.compress(json.dumps(wrapper, separators=(",", ":")).encode(), 1)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (compressed JSON) and n, its pages: one wrapper a host, of all its pages. A page without a host has the empty one."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, tuple[list, int]] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = shape(page or "")
                was = own.get(host)
                own[host] = (_merged(was[0], new), was[1] + 1) if was else (new, 1)
            if len(own) > 2000:
                yield packed(own)
                own = {}
        yield packed(own)

    def packed(own: dict) -> pa.RecordBatch:
        cols = [list(own), [_out(w) for w, _ in own.values()], [n for _, n in own.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int64()), strict=True)], ["host", "wrapper", "n"])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        own, n = None, 0
        for w, k in zip(t["wrapper"].to_pylist(), t["n"].to_pylist(), strict=True):
            own, n = (_merged(own, _in(w)) if own else _in(w)), n + k
        return pa.table({"host": t["host"][:1], "wrapper": pa.array([_out(own)], pa.binary()), "n": pa.array([n], pa.int64()), "at": t["at"][:1]})

    kind = "host string, wrapper binary, n bigint"
    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(infer, kind).withColumn("at", F.monotonically_increasing_id())
    # a host in all partitions: 64 tasks merge its wrappers first
    parts = parts.withColumn("salt", F.shiftright("at", 33) % 64).groupBy("host", "salt").applyInArrow(lambda t: merge(t), kind + ", at bigint")
    return parts.groupBy("host").applyInArrow(lambda t: merge(t), kind + ", at bigint").drop("at")


def templates(pages: DataFrame) -> DataFrame:
    """host, template (places and digests of its texts) and n, its pages."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([template(_in(w)) for w in b.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), found, b.column(2)], ["host", "template", "n"])

    return wrappers(pages).mapInArrow(look, "host string, template array<string>, n bigint")


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (the main text, empty if there is none), n_chars (its code points).

    A null or empty page has no text. White space inside a block is one space, and blocks are joined by one. A null url
    stays null; its page shares the wrapper of all pages without a host. Repeated rows are read each; an empty table gives
    no rows; other columns are not looked at, whatever their names. Pages may be as long, and nested as deep, as they like. Pages of
    hosts with a large share of all meet their templates by broadcast (of at most SENT bytes), the others by a shuffle on
    the host; hosts without texts of a template aren't joined.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h or "", frozenset(w or ())) for h, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            cols = [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    own = written(templates(pages), "templates")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    total = own.agg(F.sum("n")).first()[0] or 0
    some = own.filter(F.size("template") > 0)
    heavy = some.select("n", F.octet_length(F.array_join("template", "")).alias("bytes")).filter(F.col("n") * HEAVY >= total).orderBy(F.desc("n")).collect()
    most, sent = HEAVY, 0
    for h in heavy:
        sent += h["bytes"]
        if sent > SENT:
            most = max(1, total // (h["n"] + 1))  # hosts up to this one are joined by a shuffle
            break
    joined = join_groups(rows, some, ["host"], "n", total, most).select("page_id", "url", "html", "template")
    rest = rows.join(some.select("host"), "host", "left_anti").select("page_id", "url", "html", F.lit(None).cast("array<string>").alias("template"))
    rows = joined.unionByName(rest) if some.take(1) else rest
    return rows.select("page_id", "url", "html", "template").mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
