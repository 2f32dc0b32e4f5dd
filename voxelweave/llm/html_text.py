"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text in them, less text in links, with boilerplate left out; the page votes for the
path of its best one. A path is the tags from the root, each with its classes, numbers generalised; it is known by a number of 64 bits.
Spark adds up the votes of each host; in a second pass a page is extracted from the containers on its host's winning path if those hold
all of the main text of its own best path, else from those on its own.

The best container is an article or main element that holds over half of the page's unlinked text, else the deepest that holds all blocks but
teasers, so nothing is lost to it. Boilerplate is what its tag, role, class or id says: menus, headers (but their headings inside an article), footers,
sidebars, notices, adverts, forms, scripts, styles, comments. A class or id counts as a whole: it is such a word, or joins such words with words of
layout alone, as `share-bar` does and `share-price-report` doesn't. Nothing else is left out, but for teasers (by class or id)
beside the best container or off the host's path. Text in one block has its white space, line breaks included, turned to single spaces.

Blocks are numbered in page order and an element holds a range of them, so time and memory grow with the page, however deep its elements nest.
An unclosed hidden inline element ends with its block; an unclosed svg, object, iframe, noscript or template drops its tag alone.

Cases: a null or empty html, and a page without text, give an empty text; a null url is a host of its own name ''; a null page_id is
kept; repeated rows vote and are extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_weight, materialise, text_slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][^\s=/>]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPLIT = re.compile(r"[^a-z]+")
NUMBER = re.compile(r"\d+")

# The tags and words of HTML that the extraction knows.
RAW = frozenset("script style textarea title".split())
#: Dropped with all in them, if they are closed.
CLOSED = frozenset("noscript template svg iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article main section div td body html blockquote center".split())
DROPPED_TAGS = frozenset("nav aside footer form button select option dialog menu head input".split()) | RAW | CLOSED
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
DROPPED_WORDS = frozenset("ad ads adsbygoogle adv advert alert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus sidebar aside footer comment comments respond reply replies disqus cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share sharing social related recommended breadcrumb breadcrumbs pagination pager widget masthead topbar toolbar skip login disclaimer".split())
HEADER_WORDS = frozenset("header".split())
#: Words that say where or how a part is laid out and not what it is.
LAYOUT_WORDS = frozenset("area articles bar bars block blocks bottom box boxes btn button buttons center col column container content footer fixed form global group header holder icon icons inner item items js left link links list main mega mobile module news outer page panel post posts primary reader readers region right row secondary section site slot small sticky stories tool tools top trail unit user wrap wrapper".split())
#: Words of parts that a best container need not hold.
ASIDE_WORDS = frozenset("teaser teasers".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What ends the open element of a kind, and where it is no longer sought.
SAME_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
KINDS = tuple((frozenset(e.split()), frozenset(w.split())) for e, w in dict.fromkeys(SAME_CLOSES.values()))
KIND_OF = {tag: list(dict.fromkeys(SAME_CLOSES.values())).index(x) for tag, x in SAME_CLOSES.items()}
P_ENDS_AT = CONTAINERS | {"table", "td"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(slots=True)
class Element:
    """An open or closed element. What its ancestors say of its blocks is handed down to it."""

    tag: str
    path: int
    depth: int
    parent: Element | None
    dropped: bool = False
    header: bool = False
    heading: bool = False
    in_article: bool = False
    inside: bool = False
    aside: bool = False
    #: The open p that the next block closes, and for each of KINDS the outermost open element that the next one closes.
    open_p: Element | None = None
    ends: tuple = (None,) * len(KINDS)
    #: The blocks under it: from this number up to that one.
    first: int = 0
    last: int = 0


@dataclass(slots=True)
class Page:
    """Containers in page order, the root first, and the blocks that aren't boilerplate."""

    found: list[Element]
    texts: list[str]
    linked: list[int]
    asides: list[bool]

    def unlinked(self) -> list[int]:
        """Running sums of the blocks' text, less twice what is in links."""
        return [0, *itertools.accumulate(len(t) - 2 * min(n, len(t)) for t, n in zip(self.texts, self.linked, strict=True))]

    def main(self) -> tuple[int, int]:
        """The range of the blocks that aren't asides; of all if there are only asides."""
        numbers = [i for i, x in enumerate(self.asides) if not x] or range(len(self.texts))
        return (numbers[0], numbers[-1] + 1) if len(numbers) else (0, 0)


def marks_boilerplate(name: str) -> bool:
    """Whether a class or id says so as a whole."""
    words = [w for w in SPLIT.split(name) if w]
    return any(w in DROPPED_WORDS for w in words) and all(w in DROPPED_WORDS or w in LAYOUT_WORDS for w in words)


@functools.lru_cache(maxsize=1 << 12)
def described(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Path step, whether the element is boilerplate, whether it is a header, whether it is an aside."""
    classes, words, names, dropped = [], set(), set(), tag in DROPPED_TAGS
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "class":
            classes = sorted(value.split())
            names |= set(classes)
            words |= set(SPLIT.split(value))
        elif name == "id":
            names.add(value)
            words |= set(SPLIT.split(value))
        elif name == "role" and value in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            dropped = True
    # an article's classes may speak of parts that it has, so there only a word alone counts
    if tag in ("article", "main"):
        dropped |= bool(names & (DROPPED_WORDS | {"comment-body"}))
    elif tag not in ("body", "html"):
        dropped |= any(map(marks_boilerplate, names)) or "comment-body" in names
    step = tag + "".join("." + NUMBER.sub("#", c) for c in classes)
    return step, dropped, tag == "header" or bool(words & HEADER_WORDS) and tag in CONTAINERS, bool(words & ASIDE_WORDS)


@functools.lru_cache(maxsize=1 << 14)
def below(path: int, step: str) -> int:
    """The number of the path that a step leads to."""
    return xxhash.xxh64_intdigest(step.encode("utf-8", "replace"), path) >> 1


def closes(page: str, tag: str) -> dict[int, int]:
    """Where each closed element of a tag starts and ends, nested ones paired."""
    found, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}\b[^>]*>", page, re.I):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            found[opened.pop()] = m.end()
    return found


def parse(page: str) -> Page:
    root = Element("#root", 0, 0, None)
    at, current = 0, root
    out = Page([root], [], [], [])
    pieces: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()
    ends_of: dict[str, dict[int, int]] = {}
    links, hidden, depth = 0, "", 0  # open links, and the inline tag that is dropped with what is in it

    def flush() -> None:
        if not pieces:
            return
        text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
        linked = sum(len(p) for p, link in pieces if link)
        pieces.clear()
        if not text or current.dropped or current.header and not (current.heading and current.inside):
            return
        out.texts.append(text)
        out.linked.append(linked)
        out.asides.append(current.aside)

    def leave(e: Element) -> Element:
        """Closes the open elements up to e; its parent is open then."""
        nonlocal current
        while True:
            current.last = len(out.texts)
            opened[current.tag] -= 1
            done, current = current, current.parent
            if done is e:
                return current

    for m in TOKEN.finditer(page):
        start = m.start()
        if start < at:
            continue
        if start > at and not current.dropped and not hidden:
            pieces.append((page[at:start], links > 0))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if hidden:
                if tag == hidden and tag not in VOID:
                    depth += -1 if m[1] else 1
                    if not depth:
                        hidden = ""
                continue
            if tag == "br":
                pieces.append((" ", False))
            elif tag == "a":
                links = max(0, links - 1) if m[1] else 1
            if tag not in VOID and not m[1] and m[3].strip(" /") and described(tag, m[3])[1]:
                hidden, depth = tag, 1
            continue
        if tag in RAW:
            if not m[1]:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if tag in CLOSED:
            if not m[1]:
                if tag not in ends_of:
                    ends_of[tag] = closes(page, tag)
                at = ends_of[tag].get(start, at)
            continue
        flush()
        links, hidden = 0, ""
        if m[1]:
            if opened[tag] > 0:
                e = current
                while e.tag != tag:
                    e = e.parent
                leave(e)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and current.open_p is not None:
            leave(current.open_p)
        if tag in KIND_OF and current.ends[KIND_OF[tag]] is not None:
            leave(current.ends[KIND_OF[tag]])
        step, dropped, header, aside = described(tag, m[3])
        up = current
        current = Element(tag, below(up.path, step), up.depth + 1, up, dropped or up.dropped, header or up.header, tag in HEADINGS or up.heading, tag in ("article", "main") or up.in_article)
        current.inside, current.aside = up.inside or header and current.in_article, aside or up.aside
        current.open_p = current if tag == "p" else None if tag in P_ENDS_AT else up.open_p
        if tag in SAME_CLOSES or tag in ("ul", "ol", "menu", "dl", "table", "select"):
            current.ends = tuple(None if tag in within else x or (current if tag in ends else None) for x, (ends, within) in zip(up.ends, KINDS, strict=True))
        else:
            current.ends = up.ends
        current.first = current.last = len(out.texts)
        opened[tag] += 1
        if tag in CONTAINERS:
            out.found.append(current)
    rest = page[at:]
    if rest and not current.dropped and not hidden:
        cut = rest.rfind("<")  # a tag that the page's end cuts off
        if cut >= 0 and re.match(r"<[/!?a-zA-Z]?[^>]*\Z", rest[cut:]) and (len(rest) == cut + 1 or rest[cut + 1] in "/!?" or rest[cut + 1].isalpha()):
            rest = rest[:cut]
        pieces.append((rest, links > 0))
    flush()
    while current is not root:
        current.last = len(out.texts)
        current = current.parent
    root.last = len(out.texts)
    return out


def best(page: Page) -> Element:
    """An article or main element with over half of the unlinked text, else the deepest container that holds all blocks but asides."""
    sums = page.unlinked()
    for tag in ("article", "main"):
        own = [(sums[e.last] - sums[e.first], -i) for i, e in enumerate(page.found) if e.tag == tag]
        if own and 2 * max(own)[0] > sums[-1]:
            return page.found[-max(own)[1]]
    first, last = page.main()
    return max((e for e in page.found if e.first <= first and e.last >= last), key=lambda e: e.depth)


def blocks_on(page: Page, path: int) -> list[int]:
    """Numbers of the blocks under the containers on a path, in order."""
    out, to = [], 0
    for e in page.found:
        if e.path == path:
            out += range(max(to, e.first), e.last)
            to = max(to, e.last)
    return out


def vote(html_text: str) -> tuple[int, int]:
    """A page's best container's path and size."""
    page = parse(html_text)
    e = best(page)
    return e.path, sum(map(len, page.texts[e.first : e.last]))


def extract(html_text: str, path: int | None) -> str:
    """The text of the containers on this path if it is all of the page's main text, else of those on the page's best path."""
    page = parse(html_text)
    own = best(page).path
    blocks = blocks_on(page, own)
    if path is not None and path != own:
        needed = [i for i in blocks if not page.asides[i]] or blocks
        voted = blocks_on(page, path)
        if set(needed) <= set(voted):
            blocks = voted
    return "\n".join(page.texts[i] for i in blocks)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host (a hash of its name), path and pages of each host: its winning path, by votes, then text, then number. Votes are summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                votes = [vote(x) if x else (0, 0) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p for p, _ in votes], pa.int64()), pa.array([s for _, s in votes], pa.int64())], ["host", "path", "size"])

    votes = pages.select(F.xxhash64(host(F.col("url"))).alias("host"), "html").mapInArrow(run, "host long, path long, size long").where("size > 0")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("size").alias("size"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("votes", "size", "path")).alias("path"), F.sum("votes").alias("pages"))


def main_text(pages: DataFrame, broadcast_hosts: int = 50_000) -> DataFrame:
    """page_id, url and main text of every page.

    The winning paths, some bytes each, are broadcast while they are at most `broadcast_hosts`; beyond that those of the largest hosts are, and the others joined.
    """
    paths = materialise(host_paths(pages), "host-paths")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(host(F.col("url"))).alias("host"))
    if paths.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(paths.drop("pages")), "host", "left")
    else:
        joined = join_by_weight(rows, paths, "host", "pages", "page_id", broadcast_hosts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                texts = [extract(x, p) if x else "" for x, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = joined.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
