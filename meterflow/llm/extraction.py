"""Main text of web pages: streaming parser events make lines, smoothed text-to-tag ratios tell which of them are content.

Each block of a page is a line with its characters and tags. Ratios of characters outside links to tags are smoothed by a
Gaussian along the page, and lines above the threshold of their spread are content. The region is the smallest element
with most of the content; what stands in it is the text, but for elements that a page names as menus, notices and the like.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

#: Reach of the smoothing in lines, the least share of content that a region holds, and the share of the spread above which a ratio is content.
SIGMA, SHARE, LEVEL = 1.0, 0.75, 0.5

# Element names of HTML by what they do, and words by which pages name what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
NEVER = set("audio button canvas datalist embed head iframe input map math meter noembed noframes noscript object option progress script select style svg template textarea title video".split())
CHROME = set("aside dialog footer header menu nav search".split())
CONTROLS = set("label legend".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | set("blockquote dd dt figcaption li p pre td th".split())
CHROME_WORDS = set("banner breadcrumb breadcrumbs complementary contentinfo footer header masthead menu menubar nav navbar navigation pager pagination search sidebar sitefooter siteheader sitenavigationelement skip skiplink toolbar topbar wpfooter wpheader wpsidebar".split())
NOTICE_WORDS = set("ad adbox adbanner ads adsbygoogle adsense adslot advert advertisement advertising adverts alert alertdialog author-box byline consent cookie cookiebar cookies dialog gdpr login modal newsletter notice notices notification overlay paywall popup privacy promo promoted promotion recommendations recommended related share sharing shares signup social sponsor sponsored sponsors subscribe subscription taboola outbrain teaser teasers toast widget widgets wpadblock".split())
AD_WORDS = set("ad ads adsbygoogle adsense advert advertisement sponsored".split())
COMMENT_WORDS = set("comment comments commentlist comment-list discussion disqus replies reply respond responses usercomments".split())
#: A class that says this before a word of the above only tells of the page's layout.
LAYOUT = set("has is no with without open closed".split())
UNDIVIDED = HEADINGS | set("blockquote dt figcaption p pre".split())
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
RIGHTS = re.compile(r"(©|\(c\)|copyright\b|all rights reserved)", re.I)
UNENDED = re.compile(r"<[a-zA-Z/!?]")
TOKEN = re.compile(r"[a-z0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z0-9]*")

#: Why an element is left out: it is named so by its tag or classes, or for good.
CLEAN, NAMED, CLOSED = 0, 1, 2


def said(attrs: list[tuple[str, str | None]]) -> tuple[set[str], set[str], bool]:
    """What an element's class, id and role say: words of its names, whole names, and whether it is hidden."""
    words, names, hidden = set(), set(), False
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and (value or "").strip().lower() == "true":
            hidden = hidden or (value or "").strip().lower() != "until-found"
        elif key == "style" and value:
            hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif key in ("data-ad", "data-ad-slot", "data-ad-client", "data-ad-unit"):
            words.add("ad")
        elif key in ("class", "id", "role", "itemtype") and value:
            for name in (value.rsplit("/", 1)[-1] if key == "itemtype" else value).split():
                parts = [x.lower() for x in TOKEN.findall(name)]
                if not LAYOUT & set(parts[:-1]):
                    words.update(parts)
                    names.update([name.lower(), "".join(parts)])
    return words, names, hidden


class Lines(HTMLParser):
    """The lines of a page in order, each with the element it stands in.

    Elements close as browsers close them where end tags are missing; an end tag without its start is passed over.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.chars: list[int] = []
        self.linked: list[int] = []
        self.tags: list[int] = []
        self.node: list[int] = []
        self.tag, self.parent, self.state = ["page"], [-1], [CLEAN]
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, element of its content, whether a block, whether its text is lost
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.walls: list[int] = []
        self.lost = self.count = self.in_links = 0
        self.words: list[str] = []

    # what is open

    def element(self) -> int:
        return self.open[-1][1] if self.open else 0

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, node: int, block: bool, lost: bool) -> None:
        at = len(self.open)
        self.open.append((tag, node, block, lost))
        self.places.setdefault(tag, []).append(at)
        if block:
            self.blocks.append(at)
        if tag in ("table", "td", "th", "caption"):
            self.walls.append(at)
        self.lost += lost

    def cut(self, at: int) -> None:
        """Closes the element at this place and all in it."""
        if self.blocks and self.blocks[-1] >= at:
            self.flush()
        while len(self.open) > at:
            tag, _, block, lost = self.open.pop()
            self.places[tag].pop()
            if block:
                self.blocks.pop()
            if self.walls and self.walls[-1] == len(self.open):
                self.walls.pop()
            self.lost -= lost

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.text.append(text)
            self.chars.append(len(text))
            self.linked.append(min(self.in_links, len(text)))
            self.tags.append(self.count)
            self.node.append(self.element())
            self.count = 0
        self.words, self.in_links = [], 0

    # events

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.count += 1
        if tag == "br":
            self.words.append(" ")
            return
        block = tag in BLOCK
        if block:
            self.flush()
            self.implied(tag)
        if tag in VOID:
            return
        if tag == "a" and self.last("a") > (self.blocks[-1] if self.blocks else -1):
            self.cut(self.last("a"))
        words, names, hidden = said(attrs) if attrs else (set(), set(), False)
        lost = tag in NEVER or hidden
        if not block:
            lost = lost or tag in CONTROLS or bool(words & AD_WORDS)
            self.push(tag, self.element(), False, lost)
            return
        above = self.element()
        state = self.state[above]
        article = tag in ("article", "main")
        if article and state == NAMED:
            state = CLEAN  # a form or an element that was not closed around it
        if tag in ("html", "body"):
            named = False
        elif article:
            named = bool(names & (COMMENT_WORDS | NOTICE_WORDS)) or any(n.startswith(("comment", "reply", "related", "teaser")) for n in names)
            state = CLOSED if named else state
        else:
            inside = self.last("article", "main") >= 0
            chrome = tag in CHROME and not (tag == "header" and inside) or tag in CONTROLS or tag == "form"
            chrome = chrome or bool(words & CHROME_WORDS) and tag not in HEADINGS and not (inside and words & CHROME_WORDS <= {"header"})
            closed = tag in ("aside", "dialog") or bool((words | names) & (NOTICE_WORDS | COMMENT_WORDS)) and tag not in HEADINGS
            state = max(state, CLOSED if closed else NAMED if chrome else CLEAN)
        self.tag.append(tag)
        self.parent.append(above)
        self.state.append(state)
        self.push(tag, len(self.tag) - 1, True, lost)

    def implied(self, tag: str) -> None:
        """Ends what this start ends: the page's head, the item, row or cell before it, or an open paragraph."""
        if self.last("head") >= 0:
            self.cut(self.last("head"))
        if tag in ENDS:
            before, around = ENDS[tag]
            at = self.last(*before)
            if at > self.last(*around):
                self.cut(at)
                return
        at = self.last("p")
        if at > (self.walls[-1] if self.walls else -1):
            self.cut(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """As browsers do, `/>` ends no element but those without content and those of drawings."""
        self.handle_starttag(tag, attrs)
        if tag in NEVER and tag not in VOID and tag not in ("script", "style", "textarea", "title"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.count += 1
        at = self.last(tag)
        if tag in BLOCK:
            self.flush()
            if at >= 0 and (tag in ("table", "td", "th", "caption", "article", "main", "body", "html") or at > (self.walls[-1] if self.walls else -1)):
                self.cut(at)
        elif at > (self.blocks[-1] if self.blocks else -1):
            self.cut(at)
        elif tag in NEVER and at >= 0:
            self.cut(at)

    def handle_data(self, data: str) -> None:
        if self.lost:
            return
        self.words.append(data)
        if self.places.get("a"):
            self.in_links += len(" ".join(data.split()))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections of other mark-up languages are comments to a browser."""
        return self.parse_bogus_comment(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that is not closed lasts to the end of the page."""
        if self.rawdata.startswith(("<!-->", "<!--->"), i):
            return self.rawdata.index(">", i) + 1
        end = self.rawdata.find("-->", i + 4)
        return len(self.rawdata) if end < 0 else end + 3

    def read(self, html: str) -> Lines:
        """All lines of a page. Behind the last `>` no tag can end: text stands there up to the next tag's start."""
        end = html.rfind(">") + 1
        tail = UNENDED.search(html, end)
        self.feed(html[: tail.start()] if tail else html)
        self.close()
        self.flush()
        return self


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian, whose weights beyond the ends go to the lines that are there."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, weights)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weights)[reach : reach + len(ratios)]


def content_lines(chars: np.ndarray, linked: np.ndarray, tags: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Whether each line's smoothed ratio lies above LEVEL spreads of all; lines that are not usable have ratio 0."""
    ratios = np.where(usable, (chars - linked) / np.maximum(1, tags), 0.0)
    even = smoothed(ratios)
    return usable & (even >= min(LEVEL * even.std(), even.max(initial=0))) & (ratios > 0)


class Page:
    """The lines of a page as arrays, with the tree of its elements."""

    def __init__(self, html: str):
        p = Lines().read(html)
        self.text, self.tag, self.parent = p.text, p.tag, p.parent
        self.chars, self.linked, self.tags = (np.array(x, float) for x in (p.chars, p.linked, p.tags))
        self.node, self.state = np.array(p.node, int), np.array(p.state)

    def region(self, mass: np.ndarray) -> int:
        """The smallest element with at least SHARE of the content, or the article that holds it."""
        inside = np.bincount(self.node, mass, len(self.tag))
        for k in range(len(self.tag) - 1, 0, -1):  # children come after their parents
            inside[self.parent[k]] += inside[k]
        best = 0
        for k in range(1, len(self.tag)):
            if self.parent[k] == best and inside[k] >= SHARE * inside[0] and self.tag[k] not in UNDIVIDED:
                best = k
        up, outer = best, {}
        while up > 0:
            if self.tag[up] in ("article", "main"):
                outer[self.tag[up]] = up
            up = self.parent[up]
        return outer.get("article", outer.get("main", best))

    def within(self, region: int) -> np.ndarray:
        """Whether each line stands in the region."""
        inside = np.zeros(len(self.tag), bool)
        inside[region] = True
        for k in range(region + 1, len(self.tag)):
            inside[k] = inside[self.parent[k]]
        return inside[self.node]

    def main_text(self) -> list[str]:
        if not self.text:
            return []
        states = self.state[self.node]
        usable = states == CLEAN
        if not usable.any():
            usable = states == NAMED  # a page that is all form or menu by its names
        if not usable.any():
            return []
        content = content_lines(self.chars, self.linked, self.tags, usable)
        if not content.any():
            content = usable
        region = self.region(np.where(content, self.chars, 0.0))
        kept = usable & self.within(region)
        tags = [self.tag[n] for n in self.node]
        article = self.tag[region] in ("article", "main")
        undivided = UNDIVIDED if article else HEADINGS
        kept &= content | (self.linked <= 0.6 * self.chars) | np.array([t in undivided for t in tags])  # the rest are menus
        if not article:
            strong = np.flatnonzero(kept & content)
            edge = np.ones(len(tags), bool)
            edge[strong[0] : strong[-1] + 1] = False
            kept &= ~edge | np.array([t in PROSE and not RIGHTS.match(x) for t, x in zip(tags, self.text)])
            first = int(np.flatnonzero(kept)[0])
            for k in range(first - 1, -1, -1):  # the headings over the region
                if usable[k]:
                    if tags[k] not in HEADINGS:
                        break
                    kept[k] = True
        return [self.text[k] for k in np.flatnonzero(kept)]


def main_text_of(html: str | None) -> str:
    """Blocks of the article joined by line feeds; empty for null, empty or text-free pages."""
    return "\n".join(Page(html).main_text()) if html else ""


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text`, the main text of each row's html, and `n_chars`, its code points.

    Columns that were named so before are replaced, all others stay; repeated rows are read each by itself. No page is cut.
    """
    bounded(pages.sparkSession)
    rest = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    rows = pages.select(*rest, F.col(html).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([main_text_of(x) for x in batch.column(len(rest)).to_pylist()], batch.schema.types[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema).withColumn("n_chars", F.length("text").cast("long"))
