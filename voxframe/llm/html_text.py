"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A line is the text between two block boundaries, as the standard library's streaming parser reports them. Lines
inside elements that are by their nature no content (menus, footers, forms, scripts) or say so (adverts, notices,
comments, sidebars) are set aside. Of the others, the ratio of unlinked characters to tags is smoothed over
neighbouring lines and split in two by an iterated threshold; the lines above it are dense. Density then decides:

- the content region is the innermost container that still holds most of the dense text;
- a box inside the region that has hardly any dense text, and is mostly links, is a menu without a name;
- where no element marks the article, sparse boxes before the first and after the last dense line are left out;
- names that only may say that a box is no content are believed if the box is not dense.

All else inside the region stays, as headings and short paragraphs have few characters for their tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import lean, tuned

#: Standard deviation of the smoothing, in lines, and the share of dense text that the content region must hold.
SIGMA, REGION_SHARE = 1.5, 0.8
#: Times that dense lines must exceed sparse ones on average for the split to mean anything.
SPREAD = 2.0
#: Ratio, in characters a tag, that counts as prose: longer paragraphs are no denser, or one of them would make others sparse.
FULL_LINE = 80
#: A box is sparse if less than this share of its text is dense, and a menu if more than this share of it is linked.
HALF = 0.5
#: A box named as no content whose removal leaves less than this share of the dense text is a wrapper around the page.
WRAPPER_REST = 0.1

# Elements by role, and words of class, id or role names.
RAW = frozenset("script style noscript template iframe svg object select option optgroup textarea button canvas audio video math head title datalist".split())
#: Those of them that hold no blocks: a block's start means that their end tag is missing.
INLINE_RAW = frozenset("svg select option optgroup button math title datalist".split())
#: What may stand in a head: anything else ends it, as its end tag is optional.
METADATA = frozenset("base basefont bgsound link meta title script style noscript template head html".split())
NOISE = frozenset("nav aside footer form dialog menu".split())
MARKED = frozenset("article main".split())
TOPS = frozenset("root html body".split())
CONTAINERS = frozenset("html body div section article main header nav aside footer form dialog menu ul ol dl table tbody thead tr td th blockquote figure details fieldset".split())
BOXES = frozenset("div section ul ol dl table fieldset details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption summary legend center".split())
SINGLES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre address figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of what the article is to be freed from.
NAMED = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer foot sidebar sidebars aside ad ads advert adverts advertisement advertisements advertising "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup comment comments respond replies disqus share sharing social related "
    "newsletter subscribe subscription signup pagination pager skip contentinfo complementary banner".split()
)
#: Names that the article's own parts may have too.
MAYBE = frozenset("discussion legal copyright recommended recommendation recommendations widget widgets toolbar topbar side alert modal overlay login search author".split())
#: Names of a page's or an article's head.
HEADER = frozenset("header masthead".split())
#: Words that a name may hold besides: "cookie-bar" is a name of cookies, "related-work" is none of what is related.
PLAIN = frozenset(
    "list lists box boxes area areas block blocks container containers wrap wrapper section sections bar item items link links form button buttons icon icons "
    "site page pages global main top bottom left right primary secondary article articles post posts content entry slot unit text title inner outer panel col column "
    "group row js id mobile desktop sticky fixed policy message media tag tags story stories news more to 1 2 3 4".split()
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[-_]+")
#: What a container says of itself: nothing, perhaps no content, a head, no content, certainly none.
NONE, DOUBTED, HEAD, HINTED, CERTAIN = range(5)


def hint(words: str) -> int:
    """What class, id and role names say of an element. All parts of a name must be known, one of them as no content."""
    most = NONE
    for word in words.lower().split():
        parts = [p for p in PARTS.split(word) if p]
        if not parts or any(p not in NAMED and p not in MAYBE and p not in HEADER and p not in PLAIN for p in parts):
            continue
        if any(p in NAMED for p in parts):
            return HINTED
        if any(p in HEADER for p in parts):
            most = HEAD
        elif any(p in MAYBE for p in parts):
            most = max(most, DOUBTED)
    return most


class Lines(HTMLParser):
    """Collects (text, tags, linked characters, container, whether it is a heading) of each line, and the containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parents, self.names, self.says = [-1], ["root"], [NONE]
        self.stack = [(0, "root")]  # container, element
        self.raw: list[str] = []
        self.text: list[str] = []
        self.heading = False
        self.tags = self.links = self.linked = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, max(1, self.tags), min(self.linked, len(text)), self.stack[-1][0], self.heading))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.raw and (self.raw[0] == "head" and (tag == "body" or self.raw == ["head"] and tag not in METADATA) or tag in BLOCKS and self.raw[0] in INLINE_RAW):
            self.raw.clear()
        if self.raw:
            if tag == self.raw[-1] or self.raw == ["head"] and tag in RAW:
                self.raw.append(tag)
            return
        if tag in RAW:
            self.raw.append(tag)
            return
        if tag == "a":
            self.links += 1
        elif tag == "br":
            self.text.append(" ")
        if tag not in BLOCKS:
            return
        self.flush()
        self.heading = tag in HEADINGS
        last = self.stack[-1][1]
        if last == "p" or last == tag and tag in SINGLES:  # such elements end where the next one begins
            self.stack.pop()
        if tag in ("td", "th", "tbody", "thead", "html"):
            return
        says = self.said(tag, attrs)
        if tag not in CONTAINERS:
            if says:
                self.push(tag, says)
            return
        self.links = 0
        if tag in MARKED:  # an article inside a menu means that the menu was not closed
            for i, (_, element) in enumerate(self.stack):
                if element in NOISE:
                    del self.stack[i:]
                    break
        self.push(tag, says)

    @staticmethod
    def said(tag: str, attrs: list) -> int:
        """What an element and its attributes say of whether it is content."""
        if attrs:
            said = dict(attrs)
            if "hidden" in said or said.get("aria-hidden") == "true" or HIDDEN.search(said.get("style") or ""):
                return CERTAIN
            own = hint(" ".join(said.get(k) or "" for k in ("class", "id", "role")))
        else:
            own = NONE
        if tag in NOISE:
            return CERTAIN
        if tag in ("body", "main"):
            return NONE
        return max(own, HEAD) if tag == "header" else own

    def push(self, tag: str, says: int) -> None:
        self.parents.append(self.stack[-1][0])
        self.names.append(tag)
        self.says.append(says)
        self.stack.append((len(self.parents) - 1, tag))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.raw:
            if tag in self.raw:
                del self.raw[len(self.raw) - 1 - self.raw[::-1].index(tag) :]
                return
            if self.raw[0] in ("script", "style", "head") or tag not in CONTAINERS or all(e != tag for _, e in self.stack):
                return
            self.raw.clear()  # the element around it ends: its own end tag is missing
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS:
            self.flush()
            self.heading = False
            if tag in CONTAINERS or tag in SINGLES:
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i][1] == tag:
                        del self.stack[i:]
                        break
                    if self.stack[i][1] in MARKED and tag not in ("body", "html"):  # a stray end tag does not end an article
                        break

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag not in RAW:
                self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.raw == ["head"] and data.strip():
            self.raw.clear()
        if not self.raw:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Values averaged over their neighbours with Gaussian weights; edges weigh what is there."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach:-reach]
    return total / np.convolve(np.ones(len(values)), kernel)[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """Splits values in two: the point midway between the means of both sides, found by iteration."""
    t = float(values.mean())
    for _ in range(50):
        high, low = values[values > t], values[values <= t]
        if not len(high) or not len(low):
            return t
        new = float((high.mean() + low.mean()) / 2)
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def dense_lines(ratio: np.ndarray) -> np.ndarray:
    """The lines above the threshold; all of them if the two sides differ by less than SPREAD."""
    t = threshold(ratio)
    high, low = ratio[ratio > t], ratio[ratio <= t]
    if not len(high) or not len(low) or high.mean() < SPREAD * low.mean():
        return np.ones(len(ratio), bool)
    return ratio > t


def _masses(parents: list[int], lines: list[tuple], weights: np.ndarray) -> np.ndarray:
    """The weight of the lines in each container, those of containers inside it too."""
    out = np.zeros(len(parents))
    np.add.at(out, [x[3] for x in lines], weights)
    for node in range(len(parents) - 1, 0, -1):  # a child comes after its parent
        out[parents[node]] += out[node]
    return out


def _below(parents: list[int], flags: np.ndarray) -> np.ndarray:
    """Which containers are flagged or lie in one that is."""
    out = flags.copy()
    for node in range(1, len(parents)):
        out[node] |= out[parents[node]]
    return out


def _dense(lines: list[tuple]) -> np.ndarray:
    return dense_lines(smoothed(np.minimum(FULL_LINE, np.array([(len(text) - linked) / tags for text, tags, linked, _, _ in lines]))))


def extract(html: str | None) -> str:
    """The main text of one page; empty if it has none."""
    page = Lines()
    page.feed(html or "")
    page.close()
    page.raw.clear()
    page.flush()
    parents, names, says = page.parents, page.names, np.array(page.says)
    certain = _below(parents, says == CERTAIN)
    lines = [x for x in page.lines if not certain[x[3]]]
    if not lines:
        return ""

    # boxes that say that they are no content, unless they are wrappers around all of it
    dense = _dense(lines)
    size = np.array([len(x[0]) for x in lines], float)
    mass = _masses(parents, lines, size * dense)
    hinted = says == HINTED
    named = _below(parents, hinted)
    if size[dense].sum() and mass[0] - sum(mass[n] for n in np.flatnonzero(hinted) if not named[parents[n]]) < WRAPPER_REST * mass[0]:
        heavy = [n for n in np.flatnonzero(hinted) if mass[n] >= (1 - WRAPPER_REST) * mass[0]]
        hinted[heavy] = False
        named = _below(parents, hinted)
    lines = [x for x in lines if not named[x[3]]]
    if not lines:
        return ""

    # the region: down to the innermost container with most of the dense text
    dense = _dense(lines)
    size = np.array([len(x[0]) for x in lines], float)
    linked = np.array([x[2] for x in lines], float)
    of = np.array([x[3] for x in lines])
    mass, whole = _masses(parents, lines, size * dense), _masses(parents, lines, size)
    links = _masses(parents, lines, linked)
    region = 0
    for node in range(1, len(parents)):
        if parents[node] == region and names[node] not in SINGLES and mass[node] >= REGION_SHARE * mass[0] and mass[node] > 0:
            region = node
    while region and (names[region] not in CONTAINERS or names[region] in ("ul", "ol", "dl", "table", "tr", "blockquote", "figure", "header")):
        region = parents[region]  # a list or a quotation is part of an article
    marked = region
    while marked > 0 and names[marked] not in MARKED:
        marked = parents[marked]
    region = marked or region
    inside = np.zeros(len(parents), bool)
    inside[region] = True
    inside = _below(parents, inside)

    sparse = mass < HALF * whole
    drop = (says == HEAD) & (~inside | (names[region] in TOPS))
    drop |= (says == DOUBTED) & sparse
    drop |= np.array([n in BOXES for n in names]) & sparse & (links > HALF * whole)
    drop[region] = False
    drop = _below(parents, drop)
    keep = inside[of] & ~drop[of]
    if not marked and (at := np.flatnonzero(dense & keep)).size:  # nothing marks the article: no sparse boxes at its ends
        ends = np.zeros(len(lines), bool)
        ends[: at[0]] = ends[at[-1] + 1 :] = True
        boxed = np.array([n in ("div", "section", "table") for n in names]) & sparse
        boxed[: region + 1] = False
        boxed = _below(parents, boxed)
        top = names[region] in TOPS
        heading = np.array([x[4] for x in lines])
        keep &= ~(ends & (boxed[of] | (linked > HALF * size) | top & ~heading & (of == region) & (np.arange(len(lines)) < at[0])))
    return "\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each page.

    Null, empty and blank html and pages without content give an empty text. Broken markup is read as the
    parser reads it; rows that share a page_id each give a row; equal pages give equal texts. White space
    inside a line is one space, lines are joined by a line feed. Other columns are not read.
    """
    tuned(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
