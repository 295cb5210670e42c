"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of text runs and tags.  A run scores its number of words
times a weight that depends on where it stands, a tag scores a negative weight;
weights are log odds of lying in the content, from labelled pages.  One linear
scan finds the contiguous region of the greatest sum.  Its blocks are the text,
without runs inside elements that are never content (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments).

Labelled pages are those of a bounded sample (``FIT_PAGES``) that mark their
content with an ``article`` or ``main`` element; counts start from the priors
below, so pages without marks are scored sensibly too.

Blocks: elements that start a line; other tags and line breaks are white space
inside a block.  Character references are decoded, white space runs become one
space, blocks are trimmed, empty ones dropped, the rest joined by newlines.

Defined cases: null and empty pages have an empty text; markup that is cut off
or wrongly nested closes where its parent does; repeated rows get equal texts;
extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import ship, table
from blockloom.llm.words import slices

#: Bound of the sample that weights are counted on.
FIT_PAGES = 400
#: Weights of words lie between these; tags weigh at most LEAST_TAG.
WORST, BEST, LEAST_TAG = -4.0, 2.0, -0.1
#: What a stretch without content costs at most: between blocks, and in an element that marks the content, where an advert doesn't part it.
STRETCH, INNER_STRETCH = -3.0, -0.1

#: Elements whose content is no markup, that are never content, and that start a line.
RAW = frozenset("script style".split())
NEVER = frozenset("head nav header footer aside form script style noscript template button select textarea svg iframe object dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class and id names, and roles, of elements that are never content.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
NAMES = frozenset("header site-header page-header search searchbox alert".split())
#: Parts of names that say what stands in or beside an element, not what it is.
STATES = frozenset("has no non not with without".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in RAW}
_SPACE = re.compile(r"\s+")


def never(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element surely holds no content, and how far its class and id say so: 2 by a whole name, 1 by a part of one."""
    if tag in NEVER:
        return True, 0
    if not attributes.strip():
        return False, 0
    sure, hint = False, 0
    seen: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in seen:
            continue  # the first of a name counts
        seen.add(name)
        if name in ("class", "id"):
            for token in value.split():
                fragments = _PART.findall(token)
                if token in HINTS or token in NAMES:
                    hint = 2
                elif any(p in HINTS for p in fragments) and not any(p in STATES for p in fragments):
                    hint = max(hint, 1)
        elif name == "role":
            sure |= value in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            sure = True
    return sure and tag not in ("html", "body", "article", "main"), hint


@dataclass
class Element:
    """``up``: its parent's number; words: of its texts and, in the end, of all inside that could be content."""

    tag: str
    up: int
    sure: bool
    hint: int
    words: int = 0
    dead: bool = False


def settle(elements: list[Element]) -> None:
    """Say which elements are dead: surely, by a hint that nothing overrules, or inside such a one.

    A hint is overruled by an article or main inside, of articles the one with the
    most words (one with a hint of its own only if all have one); on a page without
    them by most of the page's words; and a hint from a part of a name, inside an
    article or main, by most of the words there.
    """
    for i in range(len(elements) - 1, 0, -1):
        elements[elements[i].up].words += elements[i].words
    named = [False] * len(elements)  # by a whole name, or inside such a one
    for i, e in enumerate(elements):
        named[i] = named[e.up] or e.hint == 2
    marks = [i for i, e in enumerate(elements) if e.tag in ("article", "main") and not e.sure]
    articles = [i for i in marks if elements[i].tag == "article" and not elements[i].hint] or [i for i in marks if elements[i].tag == "article" and not named[i]]
    anchors = {i for i in marks if elements[i].tag == "main"} | {max(articles, key=lambda i: (elements[i].words, -i)) for _ in articles[:1]}
    holds: set[int] = set()
    for i in anchors:
        while i and (i := elements[i].up) not in holds:
            holds.add(i)
    around = [-1] * len(elements)  # the next anchor outside
    for i, e in enumerate(elements[1:], 1):
        up = elements[e.up]
        around[i] = e.up if e.up in anchors else around[e.up]
        whole = elements[around[i]] if around[i] >= 0 and e.hint == 1 else None if anchors else elements[0]
        gone = e.hint and e.tag not in ("html", "body", "article", "main") and i not in holds and not (whole and 2 * e.words > whole.words)
        e.dead = up.dead or e.sure or bool(gone)


@dataclass
class Part:
    """A text run (``text`` set; name: the block element it stands in) or a tag; dead: of an element that is never content, and then the name too; block: number of its block; marked: inside an article or main element."""

    name: str
    block: int
    dead: bool
    marked: bool
    text: str = ""


def parts(page: str) -> list[Part]:
    out: list[Part] = []
    elements = [Element("", 0, False, 0)]
    where_of: list[int] = []  # the element of each part
    open_: list[tuple[str, int, bool, str]] = []  # elements: name, number, marked, block name
    spots: dict[str, list[int]] = defaultdict(list)  # of each name among the open elements
    walls: list[int] = []  # open blocks but p, beyond which no element is closed unsaid
    sure: list[bool] = [False]  # of each element, or one around it
    block, at, n = 0, 0, len(page)

    def add(name: str, of: int, marked: bool, text: str = "") -> None:
        out.append(Part(name, block, False, marked, text))
        where_of.append(of)

    def run(text: str) -> None:
        if text and not text.isspace():
            _, of, marked, where = open_[-1] if open_ else ("", 0, False, "text")
            add(where, of, marked, text)
            if not sure[of]:
                elements[of].words += len(text.split())

    def close(down_to: int) -> None:
        while len(open_) > down_to:
            spots[open_.pop()[0]].pop()
        while walls and walls[-1] >= down_to:
            walls.pop()

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            run(page[at:])
            break
        run(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        _, of, marked, where = open_[-1] if open_ else ("", 0, False, "text")
        if m[1] or m[4]:
            if spots[tag]:
                of = open_[spots[tag][-1]][1]
                close(spots[tag][-1])
            add(tag, of, marked)
        else:
            attributes = m[3] or m[6] or ""
            opens = tag not in RAW and tag not in VOID and not attributes.endswith("/")
            own = len(elements)
            elements.append(Element(tag, of, *never(tag, attributes)))
            sure.append(sure[of] or elements[own].sure)
            add(tag, own, marked)
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else n
            elif opens:
                if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
                    # A new one ends an open one of its kind, and what that left open, unless another block lies between.
                    if spots[tag] and spots[tag][-1] >= (walls[-1] if walls else 0):
                        close(spots[tag][-1])
                    _, of, marked, where = open_[-1] if open_ else ("", 0, False, "text")
                    elements[own].up = of
                    sure[own] = sure[of] or elements[own].sure
                spots[tag].append(len(open_))
                if tag in BLOCKS and tag != "p":
                    walls.append(len(open_))
                open_.append((tag, own, marked or tag in ("article", "main"), tag if tag in BLOCKS else where))
        if tag in BLOCKS:
            block += 1
    settle(elements)
    for p, of in zip(out, where_of, strict=True):
        if elements[of].dead:
            p.name, p.dead = "dead", True
    if any(p.marked for p in out):
        for p in out:
            if p.text and not p.marked and not p.dead:
                p.name = "outside"  # of the content, on a page that marks it
    return out


@dataclass
class Weights:
    """Log odds of lying in the content: of words by place, of tags by name."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, name: str) -> float:
        return self.words.get(name, WORST if name == "dead" else -2.0 if name == "outside" else 0.5)

    def tag(self, name: str) -> float:
        return self.tags.get(name, LEAST_TAG)


def learned(pages: list[str | None]) -> Weights:
    """Weights from the pages that mark their content; others are passed over."""
    words: dict[str, list[float]] = defaultdict(lambda: [2.0, 1.0])
    words["dead"], words["outside"] = [1.0, 50.0], [1.0, 10.0]
    tags: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    tags["dead"] = [1.0, 10.0]
    for page in pages:
        seq = parts(page or "")
        if not any(p.marked for p in seq):
            continue
        for p in seq:
            if p.text:
                words[p.name][0 if p.marked and not p.dead else 1] += len(p.text.split())
            else:
                tags[p.name][0 if p.marked and not p.dead else 1] += 1
    return Weights({k: max(WORST, min(BEST, math.log(a / b))) for k, (a, b) in words.items()}, {k: min(LEAST_TAG, max(WORST, math.log(a / b))) for k, (a, b) in tags.items()})


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first of the contiguous regions (start, end) of the greatest sum; (0, 0) if none is above 0."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def scores_of(seq: list[Part], weights: Weights) -> list[float]:
    out, left = [], 0.0
    for p in seq:
        s = weights.word(p.name) * len(p.text.split()) if p.text else weights.tag(p.name)
        if p.dead:
            s = max(s, left if left else INNER_STRETCH if p.marked else STRETCH)
            left = min(-1e-9, (left or (INNER_STRETCH if p.marked else STRETCH)) - s)
        else:
            left = 0.0
        out.append(s)
    return out


def main_text(page: str | None, weights: Weights) -> str:
    seq = parts(page or "")
    start, end = best_region(scores_of(seq, weights))
    chosen = {p.block for p in seq[start:end] if p.text and not p.dead}
    lines: dict[int, list[str]] = {}
    for i, p in enumerate(seq):
        if p.block in chosen and not p.dead:
            # A line break is white space; other tags inside a block leave the words as they touch.
            # References are decoded run by run: a tag inside one makes it plain text.
            lines.setdefault(p.block, []).append(entities.unescape(p.text) if p.text else " " if p.name in ("br", "wbr") else "")
    text = (_SPACE.sub(" ", "".join(x)).strip() for x in lines.values())
    return "\n".join(t for t in text if t)


def extracted(df: DataFrame, id_col: str, url_col: str, html_col: str, weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text`` of every row; weights are counted on a bounded sample unless given."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    if weights is None:
        some = rows.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(FIT_PAGES)
        # At most FIT_PAGES ids, and then their pages.
        weights = learned([r["html"] for r in rows.select("page_id", "html").join(F.broadcast(some), "page_id").orderBy("page_id", "html").limit(FIT_PAGES).collect()])
    # A dict of element names: its size does not depend on the corpus.
    words, tags = dict(weights.words), dict(weights.tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(words, tags)
        for batch in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([main_text(h, own) for h in batch.column("html").to_pylist()], pa.string())], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extracted(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
