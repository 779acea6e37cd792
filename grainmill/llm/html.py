"""HTML extraction by consensus host paths (op 1).

Each page is tokenised and its open elements tracked; every container (a block element) has a generalised path: the tags from the root
on, each with its classes, runs of digits in them as ``#``. Its score is the length of the text of the paragraphs directly below it, less that of links, less a
fee a piece of text, so that running text counts and menus don't. Each page votes with the share of its total score that each path has;
the votes are summed per host in Spark, and the winning path of each host is then used to extract all its pages again: the
text of all containers with that path. A page without such a container falls back to its own best one.

A path is named by a 64-bit hash chained from its parent's, and written out only for the result; a container's text is a range of the page's pieces of text. So the work
for a page is in proportion to its length, however deep it is nested and whatever is left open in it.

Two scans of the pages and a shuffle of (host, path, votes), summed in each task before; the winners, a row a host, are broadcast if they are few.

Defined cases: a null or empty page, or one without any text, gives a null path and an empty text; a null url belongs to a null host; hosts are
lower case, without user, port and a leading ``www.``; unclosed and misnested elements are closed by their parents; a tag whose quotes are never closed ends with the
first ``>``; script, style, nav and the like are no text; ties of votes go to the path with the lowest hash, ties within a page to the first container;
repeated rows are extracted each and vote each; further columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.session import attach, cut, small

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_PLAIN = re.compile(r"[^>\"']*")
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template svg textarea".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside blockquote body center dd details div dl fieldset figure form li main ol section table tbody td tr ul".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre dt dd li td th tr br hr figcaption summary caption".split()) | CONTAINERS
SKIP = frozenset("head nav footer header title button select option iframe".split())
#: Opening the first closes an open second of the same parent.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, **dict.fromkeys(CONTAINERS - {"li", "tr", "td", "dd"}, {"p"})}
PIECE = 25
#: (host, path) pairs that a task sums before it sends them on.
HELD = 200_000


class Box:
    """A container: its path's hash and name, the container around it, its score, and the range of the page's pieces that it holds."""

    __slots__ = ("key", "name", "up", "score", "start", "end")

    def __init__(self, key: int, name: tuple | None, start: int) -> None:
        self.key, self.name, self.score, self.start, self.end = key, name, 0.0, start, -1

    def path(self) -> str:
        out, n = [], self.name
        while n is not None:
            out.append(n[1])
            n = n[0]
        return ">".join(out[::-1])


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text, then the tag after it: (text, tag or '', whether it closes, attributes). Every part of the page is looked at a bounded number of times."""
    at, pos, n = 0, 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    bad: set[int] = set()  # quotes from which no end of a tag is reached
    while (pos := page.find("<", pos)) >= 0:
        m = _NAME.match(page, pos)
        if m is None:
            if page.startswith("<!--", pos):
                end = page.find("-->", pos + 4)
                end = n if end < 0 else end + 3
            elif pos + 1 < n and page[pos + 1] in "!?" and (end := page.find(">", pos)) >= 0:
                end += 1
            else:
                pos += 1
                continue
            yield page[at:pos], "", False, ""
            at = pos = end
            continue
        begin = e = m.end()
        seen: list[int] = []
        while True:
            e = _PLAIN.match(page, e).end()
            if e < n and page[e] == ">":
                break
            if e >= n or e in bad or e >= last[page[e]]:
                bad.update(seen)
                e = page.find(">", begin)
                break
            seen.append(e)
            e = page.index(page[e], e + 1) + 1
        if e < 0:
            break  # no tag ends any more
        tag = m.group(2).lower()
        yield page[at:pos], tag, bool(m.group(1)), page[begin:e]
        at = pos = e + 1
        if tag in _RAW and not m.group(1):
            end = _RAW[tag].search(page, at)
            at = pos = end.end() if end else n
    yield page[at:], "", False, ""


def parse(page: str) -> tuple[list[Box], list[tuple[str, bool]]]:
    """The containers of a page, outer before inner, and its pieces of text: (text, whether it begins a block)."""
    pieces: list[tuple[str, bool]] = []
    boxes = [Box(0, None, 0)]
    # open elements: tag, path's hash, path (parent's, name), container, whether it is no text, whether it is a link
    stack: list[tuple] = [("", 0, None, boxes[0], False, False)]
    places: dict[str, list[int]] = {}  # where each tag is open
    around = [0]  # where containers are open
    fresh = True

    def close(to: int) -> None:
        while len(stack) > to:
            tag, _, _, box, _, _ = stack.pop()
            places[tag].pop()
            if around[-1] == len(stack):
                around.pop()
                box.end = len(pieces)

    for s, tag, shuts, attrs in tokens(page):
        _, key, name, box, skip, link = stack[-1]
        if s and not skip:
            if "&" in s:
                s = _html.unescape(s)
            s = _SPACE.sub(" ", s)
            if s != " " or not fresh:
                k = len(s.strip())
                if k:
                    box.score += -k if link else k - PIECE
                pieces.append((s, fresh))
                fresh = False
        if not tag:
            continue
        if tag in BLOCKS:
            fresh = True
        if tag in _RAW:
            continue
        if shuts:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            top = max((places[t][-1] for t in CLOSES[tag] if places.get(t)), default=0)
            if top and top >= around[-1]:
                close(top)
                _, key, name, box, skip, link = stack[-1]
        own = tag in CONTAINERS
        label = tag
        if own and attrs:
            c = _CLASS.search(attrs)
            if c:
                label = ".".join([tag, *sorted(_DIGITS.sub("#", x) for x in (c[1] or c[2] or c[3] or "").split())])
        if attrs.endswith("/") and not own:
            continue
        key, name = xxhash.xxh64_intdigest(label.encode(errors="replace"), key), (name, label)
        if own:
            box = Box(key, name, len(pieces))
            boxes.append(box)
            around.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, key, name, box, skip or tag in SKIP, link or tag == "a"))
    close(1)
    boxes[0].end = len(pieces)
    return boxes, pieces


def path_key(path: str) -> int:
    """The hash by which a path is named."""
    key = 0
    for label in path.split(">") if path else ():
        key = xxhash.xxh64_intdigest(label.encode(errors="replace"), key)
    return key - (1 << 64) if key >= 1 << 63 else key


def votes(page: str) -> list[tuple[int, float]]:
    """The share of the page's positive scores that each path, by its hash, has."""
    by: dict[int, float] = {}
    for b in parse(page)[0]:
        if b.score > 0:
            by[b.key] = by.get(b.key, 0.0) + b.score
    total = sum(by.values())
    return [(k - (1 << 64) if k >= 1 << 63 else k, round(s / total, 9)) for k, s in by.items()]


def _joined(pieces: list[tuple[str, bool]]) -> str:
    runs: list[list[str]] = []
    for s, fresh in pieces:
        if fresh or not runs:
            runs.append([s])
        else:
            runs[-1].append(s)
    return "\n".join(x for x in ("".join(r).strip() for r in runs) if x)


def extract(page: str, wanted: int | None) -> tuple[str | None, str]:
    """The path used and the text under it; the page's own best path if it has no container of the wanted path's hash or no text in it."""
    boxes, pieces = parse(page)
    if not pieces:
        return None, ""
    for key in (None if wanted is None else wanted % (1 << 64), max(boxes, key=lambda b: b.score).key):
        if key is None:
            continue
        got, path, upto = [], None, 0
        for b in boxes:
            if b.key == key and b.start >= upto:  # else within one that is taken already
                if b.end > b.start:
                    got.append(_joined(pieces[b.start : b.end]))
                    path, upto = path or b, b.end
        text = "\n".join(x for x in got if x)
        if text:
            return path.path(), text
    return None, ""


def host(url: Column) -> Column:
    """The host of a url: lower case, without user, port and ``www.``; null for null, empty where there is none."""
    at = F.when(F.contains(url, F.lit("//")), F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).otherwise(F.regexp_extract(url, "^([^/?#]*)", 1))
    at = F.regexp_replace(F.lower(at), "^.*@", "")
    bare = F.when(F.startswith(at, F.lit("[")), F.regexp_extract(at, "^\\[([^\\]]*)\\]", 1)).otherwise(F.substring_index(at, ":", 1))
    return F.when(url.isNotNull(), F.regexp_replace(bare, "^www\\.", ""))


def winners(pages: DataFrame) -> DataFrame:
    """``host, key, votes, pages``: the winning path of each host, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple, list] = {}

        def told() -> pa.RecordBatch:
            k = list(by)
            cols = [pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.int64()), pa.array([by[x][0] for x in k], pa.float64()), pa.array([by[x][1] for x in k], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["host", "key", "votes", "pages"])

        for b in batches:
            for h, page in zip(b.column(0).to_pylist(), b.column(1)):
                for key, share in votes(page.as_py() or ""):
                    v = by.setdefault((h, key), [0.0, 0])
                    v[0] += share
                    v[1] += 1
            if len(by) > HELD:
                yield told()
                by.clear()
        yield told()

    v = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, key long, votes double, pages long")
    v = v.groupBy("host", "key").agg(F.round(F.sum("votes"), 6).alias("votes"), F.sum("pages").alias("pages"))
    # the best of each host, by an aggregate that is combined in each task: a host may have a third of all paths
    best = v.groupBy("host").agg(F.max_by(F.struct("key", "votes", "pages"), F.struct("votes", (-F.col("key").cast("decimal(20,0)")).alias("key"))).alias("best"))
    return best.select("host", "best.*")


def extract_all(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, text`` for every page."""
    attach(pages.sparkSession)
    best = cut(winners(pages).select(F.col("host").alias("_host"), F.col("key").alias("_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(p.as_py() or "", w.as_py()) for p, w in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["page_id", "host", "path", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    slim = pages.select("page_id", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    joined = slim.join(small(best, 200_000), F.col("host").eqNullSafe(F.col("_host")), "left").select("page_id", "host", "html", "_key")
    return joined.mapInArrow(run, f"page_id {kind}, host string, path string, text string")
