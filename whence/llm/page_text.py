"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path, those of a host with the same lines as one; of the
two neighbours of a page on its host the one with the longer common path is its nearest. The
text lines (blocks) of both, wherever on the page they stand, are aligned by a longest common
subsequence, and lines that both share are the site's frame and go. A neighbour that has nearly
all of a page's text is another copy of it and tells nothing of the frame: the other neighbour
decides then, and if that is a copy too, no frame is known.

Elements settle what the difference leaves open. Lines that differ from page to page and yet
are no text (advertisements, comments, related links) stand in navigation, footers, asides,
forms or in elements whose class, id or role names such a thing; where there is an article or
main element, the text is what stands in it. A name drops no article or main element and
nothing that holds one, and a name that says that something is absent, open or closed
(``no-sidebar``, ``comments-open``) is none. A shared line that stands in an article is kept:
articles quote and copy each other, and a difference cannot tell a quotation from a frame.
``n_frame`` counts the lines that the difference took, ``n_settled`` those that it left and an
element took.

Character references are decoded, white space in a block becomes one space, and blocks are
joined by empty lines in page order. NULL and empty pages have an empty text. A NULL URL has
an empty host and path. Equal rows have equal results; of pages with one URL the smaller
page_id comes first. A page is held whole in one task.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from whence.session import durable

#: Elements whose content is never main text.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form iframe svg object "
    "button select textarea menu dialog audio video".split()
)
#: Classes, ids and roles (whole ones) that mark such content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent notice notices alert popup modal newsletter subscribe signup comment comments disqus reply replies "
    "respond sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social "
    "related recommended widget pagination pager toolbar login search contentinfo complementary".split()
)
#: Parts of a class, id or role (``ad-slot``, ``userComments``) that mark such content as well, unless
#: another part says that it is not there or what state it is in.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent newsletter "
    "subscribe comment comments disqus replies sidebar nav navbar breadcrumb breadcrumbs masthead sharing".split()
)
STATES = frozenset("no not non without has with open closed off on enabled disabled allowed hidden count".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset(
    "a abbr acronym annotation b bdi bdo big canvas cite code data del dfn em font i ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr br img label input "
    "math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph or the like of their own kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
OUTSIDE, MAIN, ARTICLE = 0, 1, 2
#: Share of a page's characters in shared lines from which its neighbour is a copy.
NEARLY = 0.9


def marked(attributes: str) -> bool:
    """Do the class, id or role name something other than main text?"""
    for found in _NAMES.findall(attributes):
        for name in "".join(found).split():
            if name.lower() in MARKS:
                return True
            parts = {p.lower() for p in _PART.findall(name)}
            if not PARTS.isdisjoint(parts) and STATES.isdisjoint(parts):
                return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """Text blocks that no element drops, in page order, each with what it stands in."""
    return [(line, place) for line, place, dropped in blocks_of(page) if not dropped]


def blocks_of(page: str) -> list[tuple[str, int, bool]]:
    """All text blocks in page order, each with what it stands in and whether an element drops it."""
    found: list[tuple[str, int, bool, list | None]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int, list | None]] = []  # name, dropped, place, mark
    open_: Counter = Counter()
    # The innermost marked element: whether it holds an article or main, and the next one outwards.
    mark: list | None = None
    dropped, place, at = False, OUTSIDE, 0

    def flush() -> None:
        line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        if line:
            found.append((line, place, dropped, mark))
        text.clear()

    def leave() -> str:
        nonlocal dropped, place, mark
        name = stack.pop()[0]
        open_[name] -= 1
        dropped, place, mark = stack[-1][1:] if stack else (False, OUTSIDE, None)
        return name

    while at < len(page):
        tag = _TAG.search(page, at)
        text.append(page[at : tag.start() if tag else len(page)])
        if not tag:
            break
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        if tag.group(1):
            known = open_[name] > 0
            if name in INLINE and not known:
                continue
            flush()
            if known:
                while leave() != name:
                    pass
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            if name in VOID or not marked(tag.group(3)):
                continue
        flush()
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
            close = page.find(">", at)
            at = close + 1 if end and close >= 0 else len(page)
            continue
        if name in VOID or tag.group(3).endswith("/") and name not in ("p", "div", "article"):
            continue
        if name in SELF_CLOSING and stack and stack[-1][0] == name:
            leave()
        if name == "body" and open_["head"]:
            while stack:
                leave()
        main = name == "main" or 'role="main"' in tag.group(3)
        dropped = dropped or name in DROPPED or (name == "header" and place == OUTSIDE)
        if name == "article" or main:
            place = ARTICLE if name == "article" else max(place, MAIN)
            # What holds an element that holds this one holds this one too.
            outer = mark if not dropped else None
            while outer and not outer[0]:
                outer[0], outer = True, outer[1]
        elif name != "body" and marked(tag.group(3)):
            mark = [False, mark]
        stack.append((name, dropped, place, mark))
        open_[name] += 1
    flush()
    return [(line, place, dropped or bool(mark and not mark[0])) for line, place, dropped, mark in found]


def inside(lines: list[tuple[str, int]]) -> int:
    """The narrowest kind of place that has lines: article, main, or the whole page."""
    return max((place for _, place in lines), default=OUTSIDE)


def shared(own: list[int], other: list[int]) -> set[int]:
    """Places in ``own`` of a longest common subsequence with ``other``; what both start or end with is matched at once."""
    start, end = 0, 0
    while start < min(len(own), len(other)) and own[start] == other[start]:
        start += 1
    while end < min(len(own), len(other)) - start and own[-1 - end] == other[-1 - end]:
        end += 1
    middle = between(own[start : len(own) - end], other[start : len(other) - end])
    return {*range(start), *(start + i for i in middle), *range(len(own) - end, len(own))}


def between(own: list[int], other: list[int]) -> set[int]:
    places: dict[int, list[int]] = {}
    for j, h in enumerate(other):
        places.setdefault(h, []).append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i, h in enumerate(own):
        for j in reversed(places.get(h, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    found, link = set(), links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def hashes_of(lines: list[tuple]) -> list[int]:
    return [xxh64_intdigest(line[0]) - 2**63 for line in lines]


def frame_of(own: list[int], sizes: list[int], others: list[list[int]]) -> set[int]:
    """Places of the frame's lines, by the first of the neighbours that is no copy of the page."""
    for other in others:
        found = shared(own, other)
        if sum(sizes[i] for i in found) < NEARLY * sum(sizes):
            return found
    return set()


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path without query, fragment, final slash and page suffix."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r"(?:\.html?|/)$", "")


def key_of() -> Column:
    return F.xxhash64("page_id", F.coalesce("url", F.lit("")), "html")


def frames(pages: DataFrame) -> DataFrame:
    """key, frame: for every page the places of the lines that it shares with its nearest neighbour
    on the same host that is no copy of it.

    Rows hold line hashes, not text; of pages of one host with the same lines one stands for
    all. They are range-partitioned by host and path and written; neighbours across two
    partitions are found from the first and last row of each.
    """

    def hashed(batches):
        for batch in batches:
            found = [blocks_of(h) for h in batch.column("html").to_pylist()]
            lines = pa.array([hashes_of(x) for x in found], pa.list_(pa.int64()))
            sizes = pa.array([[len(line[0]) for line in x] for x in found], pa.list_(pa.int32()))
            columns = [batch.column(c) for c in ("key", "page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, lines, sizes], ["key", "page_id", "host", "path", "lines", "sizes"])

    slim = pages.select("key", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    slim = slim.mapInArrow(hashed, "key bigint, page_id bigint, host string, path string, lines array<bigint>, sizes array<int>")
    order = ["host", "path", "page_id", "key"]
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = durable(slim.withColumn("same", F.xxhash64("host", "lines")))
    alone = slim.groupBy("same").agg(F.min_by(F.struct(*order, "lines", "sizes"), F.struct(*order)).alias("page")).select("same", "page.*")
    dealt = durable(alone.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    row = F.struct("host", "path", "lines")
    # Two rows per partition, numbered without the empty ones.
    sort = F.struct(*order)
    edges = dealt.groupBy("part").agg(F.min_by(row, sort).alias("opens"), F.max_by(row, sort).alias("closes"))
    edges = durable(edges)
    number = Window.orderBy("part")
    edges = edges.select("part", F.lag("closes").over(number).alias("left"), F.lead("opens").over(number).alias("right"))
    by = Window.partitionBy("part").orderBy(*order)
    found = dealt.withColumns({"before": F.lag(row).over(by), "after": F.lead(row).over(by)}).join(edges, "part")
    found = found.withColumns({"before": F.coalesce("before", "left"), "after": F.coalesce("after", "right")})

    def common(other: str) -> Column:
        """Length of the common start of both paths on one host, -1 on another."""
        length = F.expr(f"least(length(path), length({other}.path))")
        same = F.aggregate(
            F.sequence(F.lit(1), F.greatest(length, F.lit(1))),
            F.lit(0),
            lambda n, i: F.when((n == i - 1) & (F.substr(F.col("path"), i, F.lit(1)) == F.substr(F.col(f"{other}.path"), i, F.lit(1))), i).otherwise(n),
        )
        return F.when(F.col(f"{other}.host") == F.col("host"), same).otherwise(-1)

    found = found.withColumns({"b": F.coalesce(common("before"), F.lit(-1)), "a": F.coalesce(common("after"), F.lit(-1))})
    before, after = F.when(F.col("b") >= 0, F.col("before.lines")), F.when(F.col("a") >= 0, F.col("after.lines"))
    near = F.when(F.col("b") >= F.col("a"), F.array(before, after)).otherwise(F.array(after, before))
    found = found.select("same", "lines", "sizes", F.filter(near, lambda lines: lines.isNotNull()).alias("near"))

    def aligned(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("lines", "sizes", "near")))
            places = pa.array([sorted(frame_of(*row)) for row in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("same"), places], ["same", "frame"])

    # Written, so its size is known, and a page that has very many copies is split in the join.
    found = durable(found.mapInArrow(aligned, "same bigint, frame array<int>"))
    return slim.select("key", "same").distinct().join(found, "same").select("key", "frame")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_frame and n_settled of every page."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("key", key_of())
    found = frames(keyed)
    schema = "page_id bigint, url string, text string, n_chars bigint, n_frame bigint, n_settled bigint"

    def work(batches):
        for batch in batches:
            rows = [extracted(h, set(f or ())) for h, f in zip(batch.column("html").to_pylist(), batch.column("frame").to_pylist())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))] if rows else []
            if rows:
                texts, taken, settled = columns
                sizes = pa.array([len(t) for t, _, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), texts, sizes, taken, settled],
                    ["page_id", "url", "text", "n_chars", "n_frame", "n_settled"],
                )

    joined = keyed.join(found, "key", "left").select("page_id", "url", "html", "frame")
    return joined.mapInArrow(work, schema)


def extracted(page: str, frame: set[int]) -> tuple[str, int, int]:
    """The text of a page with that frame, and how many lines the difference and elements took."""
    blocks = blocks_of(page)
    place = inside([(line, p) for line, p, dropped in blocks if not dropped])
    kept, taken, settled = [], 0, 0
    for i, (line, own, dropped) in enumerate(blocks):
        text = not dropped and own == place
        if i in frame and (place == OUTSIDE or not text):
            taken += 1
        elif text:
            kept.append(line)
        else:
            settled += 1
    return "\n\n".join(kept), taken, settled
