"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one a block element, in page order, and every line has a weighted length. Over the lengths
runs a window of WINDOW lines: a surge point is where the window's sum rises above zero, a dive point where it falls back
to zero; what lies between the two is a run of text, and its highest window its height. Runs decide:

* the highest run is text, and with it every run of height SURGE or more; one in another <article> or <main> only if it
  has SHARE of the highest run's height, as teasers of other articles have not;
* short lines at the ends of a run that stand in other elements than its text don't belong to it;
* a shorter run is text if it stands in the same <article> or <main> as one of those, is a sibling (same parent, same
  element name) of a line in one, stands between two of them, or is the page's only <article>.

Tags only weigh: a line in an <article> or <main> counts MARKED times; a line that is all links counts nothing outside
one; nor does a line in a menu, footer, sidebar, form, dialog or site header (a <header> in an article is its title), or in
an element whose class, id or role is wholly made of such words; and an element that has such a word beside others
("share-price-report") counts half. The latter holds text all the same if the highest window is in it, or a window of
SURGE characters in the highest run's <article> or <main>; where nothing on the page counts, class words are not heeded.

Cases: null and empty html, and html without text, give the empty text; a tag that is not closed ends with the page, a
boilerplate element that is not closed at the next article; comments, scripts and styles that are not closed end with
the page. Character references are decoded, white space inside a block becomes one space, blocks are joined by newlines.
"""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from quarrylog.llm._ops import arrow_map, pick

WINDOW = 3
SURGE = 86
#: Height that a run in another article needs, as a share of the highest, and what lines in an article count for.
SHARE, MARKED = 0.5, 2.0

# Elements of HTML by how they are treated.
#: Of RAW, those that run to the page's end where their end tag is missing; others end at the next block.
TO_THE_END = frozenset("script style textarea".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea title head select button noframes noembed".split())
DROPPED = frozenset("nav header footer aside form menu dialog search fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus"
    " footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related reply replies"
    " respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

#: Words that say nothing of what an element holds, and those that a name begins with which tells of a page's layout.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button card col column container content div el element foot group head holder icon icons image images inner item items js l left link links list lower main m modern new outer"
    " page panel pane post posts primary right row s secondary section site slot small strip text thread title top unit upper wide wrap wrapper x xl"
    .split()
)
LAYOUT = frozenset("has hide is no non not with without".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[_-]+")

_BLOCK_START = re.compile(rf"<(?:{'|'.join(sorted(BLOCKS | {'body'}))})(?=[\s/>])", re.I)

PLAIN, HALF, NONE = 0, 1, 2


def _kind(name: str, attributes: str, in_region: bool) -> tuple[int, int]:
    """How an element's lines count by its tag and role (PLAIN or NONE), and by its class and id (any)."""
    by_tag = NONE if name in DROPPED and not (name == "header" and in_region) else PLAIN
    by_name = PLAIN
    if not attributes or "=" not in attributes or name in ("html", "body"):
        return by_tag, by_name
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if kind.lower() == "role":
            by_tag = NONE if value.strip() in ROLES else by_tag
            continue
        for word in value.split():
            parts = [p for p in _PART.split(word) if p]
            if not parts or parts[0] in LAYOUT or HINTS.isdisjoint(parts):
                continue
            by_name = max(by_name, NONE if all(p in HINTS or p in NEUTRAL or p.isdigit() for p in parts) else HALF)
    return by_tag, by_name


class Line(NamedTuple):
    text: str
    all_links: bool
    hidden: bool  # in an element that its tag or role makes boilerplate
    named: bool  # in one that is wholly named as such
    half: bool  # in one that is partly named so
    region: int  # number of the innermost article or main, 0 for none
    in_article: bool
    place: tuple[int, str]  # number of the parent block, name of its own
    around: int  # number of the parent's parent


class Open(NamedTuple):
    name: str
    hidden: bool
    named: bool
    half: int
    region: int


class Ends:
    """Where elements end; a name whose end tag isn't found is not looked for again."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def tag(self, name: str, at: int) -> re.Match | None:
        found = None if name in self.gone else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.page, at)
        if found is None:
            self.gone.add(name)
        return found

    def of_raw(self, name: str, at: int) -> int:
        """The end of a raw element's content; inner ones of its name are part of it."""
        first = self.tag(name, at)
        if first is None:
            if name == "head":
                return at
            block = None if name in TO_THE_END else _BLOCK_START.search(self.page, at)
            return block.start() if block else len(self.page)
        if name not in TO_THE_END and name not in ("title", "head"):
            depth = 1
            for tag in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(self.page, at):
                depth += -1 if tag[1] else 0 if tag[0].endswith("/>") else 1
                if not depth:
                    return tag.end()
        return first.end()


def lines_of(page: str, half_spans: list[tuple[int, int]] | None = None) -> list[Line]:
    """The lines of a page; half_spans takes the first and end line of every element that is partly named as boilerplate.

    A form that holds over half of the text is the page's wrapper; any other is boilerplate.
    """
    ends = Ends(page)
    half_spans = [] if half_spans is None else half_spans
    forms: list[tuple[int, int]] = []
    begun: list[int] = []  # lines before each open element
    names: list[Open] = []  # open elements
    blocks: list[tuple[int, str]] = [(0, "")]  # open block elements: number, name
    count = 0
    parts: list[str] = []
    linked = 0
    lines: list[Line] = []
    at, size = 0, len(page)
    hidden = named = links = 0
    half = 0
    regions: list[tuple[int, str]] = []

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(_html.unescape("".join(parts)).split()) if parts else ""
        if text:
            place = (blocks[-2][0] if len(blocks) > 1 else -1, blocks[-1][1])
            all_links = linked >= sum(len(p) for p in parts if p.strip())
            lines.append(Line(text, all_links, hidden > 0, named > 0, half > 0, regions[-1][0] if regions else 0, any(n == "article" for _, n in regions), place, blocks[-3][0] if len(blocks) > 2 else -1))
        parts, linked = [], 0

    def close(index: int) -> None:
        nonlocal hidden, named, links, half
        for element, start in zip(reversed(names[index:]), reversed(begun[index:]), strict=True):
            hidden -= element.hidden
            named -= element.named
            links -= element.name == "a"
            if element.half:
                half -= 1
                half_spans.append((start, len(lines)))
            if element.name == "form":
                forms.append((start, len(lines)))
            if element.region:
                regions.remove((element.region, element.name))
            if element.name in BLOCKS:
                blocks.pop()
        del names[index:], begun[index:]

    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            break
        if token.start() > at:
            parts.append(page[at : token.start()])
            linked += len(page[at : token.start()]) if links else 0
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        closing, attributes = token[1] or token[4], token[3] or token[6] or ""
        if name in RAW:
            if not closing:
                at = ends.of_raw(name, at)
            continue
        if name in SPACED:
            parts.append(" ")
            continue
        block = name in BLOCKS
        if closing:
            if block:
                flush()
            for i in range(len(names) - 1, -1, -1):
                if names[i].name == name:
                    if names[i].hidden or names[i].named or names[i].half:
                        flush()
                    close(i)
                    break
            continue
        by_tag, by_name = _kind(name, attributes, bool(regions))
        if by_tag and (name == "form" or ends.tag(name, at) is None):  # forms are judged at the end; what is left open isn't boilerplate
            by_tag = PLAIN
        if block or by_tag or by_name:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        if name in ("article", "main") and not by_tag and hidden:
            first = next(i for i, e in enumerate(names) if e.hidden)
            if re.compile(rf"</{re.escape(names[first].name)}\s*>", re.I).search(page, at) is None:  # what was left open ends here
                close(first)
        if name == "p" or name == "li":  # these end the one before
            for i in range(len(names) - 1, -1, -1):
                if names[i].name == name:
                    if not names[i].hidden and not names[i].named:
                        close(i)
                    break
                if names[i].name in BLOCKS and names[i].name != "p":
                    break
        count += 1
        element = Open(name, by_tag == NONE, by_name == NONE, count if by_name == HALF else 0, count if name in ("article", "main") and not by_tag else 0)
        names.append(element)
        begun.append(len(lines))
        if block:
            blocks.append((count, name))
        hidden += element.hidden
        named += element.named
        links += name == "a"
        half += element.half > 0
        if element.region:
            regions.append((element.region, name))
    if at < size:
        parts.append(page[at:])
        linked += size - at if links else 0
    flush()
    close(0)
    plain = np.cumsum([0, *(0 if line.all_links else len(line.text) for line in lines)])
    inside = np.zeros(len(lines) + 1, int)
    for a, b in forms:
        if 2 * (plain[b] - plain[a]) <= plain[-1]:
            inside[a] += 1
            inside[b] -= 1
    return [line._replace(hidden=True) if n else line for line, n in zip(lines, np.cumsum(inside), strict=False)]


def runs(lengths: list[float], regions: list[int] | None = None, window: int = WINDOW) -> list[tuple[int, int, float]]:
    """(first line, end line, highest window sum) between each surge and the dive that follows it.

    A line of no length parts runs as a whole window of such lines: an element that holds none of the text lies there. So
    does the border of a region.
    """
    spread: list[float] = []
    place: list[int] = []
    for i, n in enumerate(lengths):
        if i and regions is not None and regions[i] != regions[i - 1]:
            spread += [0] * window
            place += [i] * window
        for _ in range(1 if n else window):
            spread.append(n)
            place.append(i)
    total = np.cumsum([0, *spread])
    sums = [float(total[min(i + window, len(spread))] - total[i]) for i in range(len(spread))]
    out, i = [], 0
    while i < len(spread):
        if sums[i] == 0:
            i += 1
            continue
        start = i
        while i < len(spread) and sums[i] > 0:
            i += 1
        inside = [place[j] for j in range(start, min(i, len(spread))) if spread[j]]
        out.append((inside[0], inside[-1] + 1, max(sums[start:i])))
    return out


def _highest(found: list[tuple[int, int, float]]) -> tuple[int, int, float]:
    return max(found, key=lambda r: (r[2], -r[0]))


class Surges:
    """Whether a range of lines lies in the main region, and whether a window of it reaches SURGE; both from tables made once."""

    def __init__(self, lengths: list[float], foreign: list[bool]):
        self.lengths, self.foreign = lengths, np.cumsum([0, *foreign])
        self.next = [len(lengths)] * (len(lengths) + 1)
        for i in range(len(lengths) - 1, -1, -1):
            self.next[i] = i if self._sum(i, len(lengths)) >= SURGE else self.next[i + 1]

    def _sum(self, i: int, end: int) -> float:
        """The window from a line on, up to a line of no length."""
        total = 0.0
        for n in self.lengths[i : min(i + WINDOW, end)]:
            if not n:
                break
            total += n
        return total

    def one_region(self, a: int, b: int) -> bool:
        return self.foreign[a] == self.foreign[b]

    def within(self, a: int, b: int) -> bool:
        return self.next[a] <= b - WINDOW or any(self._sum(i, b) >= SURGE for i in range(max(a, b - WINDOW + 1), b))


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p")


def weights(lines: list[Line], heed_names: bool = True, heed_tags: bool = True) -> list[float]:
    """The length that each line counts with."""
    out = []
    for line in lines:
        own = line.region > 0
        if (heed_tags and line.hidden) or (heed_names and line.named) or (line.all_links and not own):
            out.append(0.0)
        else:
            out.append(len(line.text) * (MARKED if own else 1.0) * (0.5 if line.half and heed_names else 1.0))
    return out


def main_text(page: str | None) -> str:
    spans: list[tuple[int, int]] = []
    lines = lines_of(page, spans) if page else []
    if not lines:
        return ""
    # A main around articles is their page; lines of it outside them are in no region of their own.
    articles = {line.region for line in lines if line.in_article and not line.hidden}
    regions = [line.region if line.in_article or not articles else 0 for line in lines]
    lines = [line._replace(region=region) for line, region in zip(lines, regions, strict=True)]
    lengths = next((w for heed in ({}, {"heed_names": False}, {"heed_names": False, "heed_tags": False}) if any(w := weights(lines, **heed))), [])
    found = runs(lengths, regions) if lengths else []
    if not found:
        return "\n".join(line.text for line in lines if not line.hidden and not line.named and line.place[1] in HEADINGS)
    # Elements partly named as boilerplate: those around the highest run, and those in its region with enough text, are text.
    a, b, _ = _highest(found)
    main = regions[a]
    window = _window_of(lengths, a, b)
    surges = Surges(lengths, [region != main for region in regions])
    whole = sum(lengths[i] for i in window)
    less = list(lengths)
    for x, y in sorted(spans, key=lambda s: (s[0], -s[1])):
        if x == y or not less[x] and not any(less[x:y]):
            continue
        if 2 * sum(lengths[i] for i in window if x <= i < y) >= whole:
            continue
        if not (main and surges.one_region(x, y) and surges.within(x, y)):
            less[x:y] = [0.0] * (y - x)
    lengths = less if any(less) else lengths  # where all is partly named, names tell nothing
    found = [_trimmed(lines, lengths, r) if not regions[r[0]] else r for r in runs(lengths, regions)]
    a, b, top = _highest(found)
    main = regions[a]
    tall = [r for r in found if r[0] == a or (r[2] >= SURGE and (regions[r[0]] in (0, main) or r[2] >= SHARE * top))]
    in_regions = {regions[r[0]] for r in tall} - {0}
    siblings = {lines[i].place for x, y, _ in tall for i in range(x, y) if lengths[i]}
    only = articles if len(articles) == 1 else set()
    first, last = tall[0][0], tall[-1][1]

    def stays(r: tuple[int, int, float]) -> bool:
        region = regions[r[0]]
        if r in tall or region in in_regions or region in only:
            return True
        return region == 0 and (first < r[0] < last or any(lines[i].place in siblings for i in range(r[0], r[1]) if lengths[i]))

    return "\n".join(lines[i].text for r in found if stays(r) for i in range(r[0], r[1]) if lengths[i])


def _trimmed(lines: list[Line], lengths: list[float], run: tuple[int, int, float]) -> tuple[int, int, float]:
    """A run without the short lines at its ends that stand in other elements than its text.

    A short line beside a paragraph is in a high window, whatever it belongs to; at a run's end only its place tells.
    """
    a, b, top = run
    text = [i for i in range(a, b) if lengths[i] >= SURGE]
    if not text:
        return run
    parents, around = {lines[i].place[0] for i in text}, {lines[i].around for i in text}
    beside = lambda i: lines[i].place[0] in parents or lines[i].around in around
    while lengths[b - 1] < SURGE and not beside(b - 1):
        b -= 1
    while lengths[a] < SURGE and not beside(a):
        a += 1
    return a, b, top


def _window_of(lengths: list[float], a: int, b: int) -> range:
    """The lines of the highest window of a run."""
    best = max(range(a, b), key=lambda i: (sum(lengths[i : min(i + WINDOW, b)]), -i))
    return range(best, min(best + WINDOW, b))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars: code points of the text) for every row."""
    work = pick(df, key=key, url=url, html=html)

    def run(batch):
        pages = batch.column("html")
        for a in range(0, len(pages), 256):
            texts = [main_text(p) for p in pages.slice(a, 256).to_pylist()]
            yield {"key": batch.column("key").slice(a, 256), "url": batch.column("url").slice(a, 256), "text": texts, "n_chars": [len(t) for t in texts]}

    kinds = {c: work.schema[c].dataType.simpleString() for c in ("key", "url")}
    return arrow_map(work, run, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})
