"""Main text of web pages by line-block distribution.

Markup is stripped into lines (the text between block-level tags). Each line has a
weight: its length without link text, nothing in an element that cannot hold the
article (menus, page footers, asides, scripts, and what a class, id or role names an
advert, a notice, reader comments and the like), half in one that is in doubt (page
headers, forms, sidebars by class, sections whose id may be a heading's slug). The
weights are summed over sliding windows of lines; where the sum rises from the ground
is a surge, where it falls back a dive, and the stretch of the largest total between
the two is the article.

The stretch's ends fall inside the article where it begins or ends in short lines, so
they are set by the innermost element that holds nearly all of the stretch's weight,
whatever its name: its lines are the article, but for those of no weight by their
marks. What was in doubt is then decided: an element around the article was none of
what its mark says, a header inside it is the article's own, and a marked section
inside it stays if its lines weigh as much as the article's. Where no element but the
page holds the stretch, lines beside it with the same parent are added.

Edge cases: a null or empty page, and one without text, gives an empty text;
unclosed and stray tags, comments and quotes are tolerated; a text in no element
counts as a line; of stretches of equal weight the first is taken; repeated rows are
extracted alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, tidy

WINDOW, SURGE = 5, 60

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: Raw text elements, whose content is not markup.
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
#: Tags that do not end a line.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are kept on the stack of containers.
_CONTAINER = frozenset("html body div section article main nav aside header footer form fieldset ul ol dl table figure details dialog menu search select button blockquote svg math object canvas audio video head address center".split())
_NEVER = frozenset("nav aside footer fieldset menu search select button dialog svg math object canvas audio video head".split())
#: Containers in which parts of an article stand; others beside its heavy lines may be the page's.
_PARTS = frozenset("section article header ul ol dl table figure details blockquote".split())
#: Words of a class, id or role for what is not the article, and for frames that may be around it.
_BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions aside navigation menubar breadcrumb breadcrumbs pagination pager toolbar footer copyright colophon "
    "comment comments commentlist disqus notice notices cookie cookies consent gdpr popup modal overlay dialog subscribe subscription newsletter signup login signin share sharing "
    "related recommended recommendations skip complementary contentinfo".split()
)
_FRAME_WORDS = frozenset("sidebar side rail header masthead banner foot search social hidden nav navbar menu topbar widget widgets".split())
#: Words that are as often a part of an article.
_DOUBTFUL_WORDS = frozenset("discussion alert respond reply replies head".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
#: Words that say nothing of what an element holds; "related-work" is no "related", "related-posts" is.
_PLAIN_WORDS = frozenset(
    "content main page site body box list area section container wrapper wrap inner outer block item items link links post posts top bottom left right fixed col column row text title form panel group module "
    "region unit global primary secondary bar button buttons icon icons slot zone label placeholder large small desktop mobile sticky js reader user".split()
)
_ARTICLE_WORDS = frozenset("article articlebody entry post story".split())
#: Classes that tell what an element has beside it, not what it is.
_ABOUT = re.compile(r"(?:has|with|without|no|is|js|layout)[-_]")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FREE, _DOUBT, _HEADER, _FRAME, _BAD = range(5)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Shares of the stretch's weight that make an element the article's, and an article element, which says so itself.
_NEARLY_ALL, _MOST = 0.9, 0.5


class _Line:
    __slots__ = ("parts", "links", "path", "marks", "own")

    def __init__(self, stack: list, own: int):
        """path: (element, number) of the containers around the line, but for the page's; marks: (standing, number) of those with one; own: its element's."""
        self.parts, self.links, self.own = [], 0, own
        self.path = [(name, number) for name, number, _ in stack if name not in ("", "html", "body")]
        self.marks = [(standing, number) for _, number, standing in stack if standing != _FREE]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def _standing(name: str, attributes: str) -> int:
    """What an element's name and attributes say of its content."""
    if name in ("html", "body"):
        return _FREE
    out = _BAD if name in _NEVER else _HEADER if name == "header" else _FRAME if name == "form" else _FREE
    if not attributes.strip():
        return out
    told = _attributes(attributes)
    if "hidden" in told or told.get("aria-hidden", "").lower() == "true" or _HIDING.search(told.get("style", "")):
        return _BAD
    for attribute in ("class", "id", "role", "itemprop"):
        if attribute == "id" and name in _HEADINGS:
            continue  # its text's slug
        for token in told.get(attribute, "").split():
            words = {x for x in (token.lower(), *_SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower())) if x} if not _ABOUT.match(token) else set()
            mark = _mark(words - {token.lower()} or words)
            if attribute == "id" and name == "section" and mark == _BAD and not words & _COMMENT_WORDS:
                mark = _DOUBT
            out = max(out, mark)
    return out


def _mark(words: set[str]) -> int:
    """The standing that a class, id or role of these words gives."""
    told = {x for x in words if x not in _PLAIN_WORDS and not x.isdigit()}
    if told <= {"header", "head"} | _ARTICLE_WORDS and words & _ARTICLE_WORDS:
        return _FREE  # an entry's own header
    if not told or not told <= _BAD_WORDS | _FRAME_WORDS | _DOUBTFUL_WORDS:
        return _FREE
    return _BAD if told & _BAD_WORDS else _FRAME if told & _FRAME_WORDS else _DOUBT


def lines_of(page: str) -> list[_Line]:
    """The lines of a page that hold text, each with its containers."""
    stack = [("", 0, _FREE)]  # element, its number, its standing
    lines, line, links, made, at, n, own = [], None, 0, 0, 0, len(page), _FREE
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            line, at = _text(page[at : m.start()], line, stack, links, lines, own), m.start()
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in _RAW and not closing:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at, line = end.end() if end else n, None
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in _INLINE:
            continue
        line, own = None, _FREE
        if closing:
            if name in _CONTAINER:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                links = 0
            continue
        mine = _standing(name, m[3])
        if name not in _CONTAINER:
            own = mine  # holds for this line, as such elements are often left open
        elif not m[3].endswith("/"):
            made += 1
            stack.append((name, made, mine))
    if at < n:
        _text(page[at:], line, stack, links, lines, own)
    return [x for x in lines if any(p.strip() for p in x.parts)]


def _text(text: str, line: _Line | None, stack: list, links: int, lines: list[_Line], own: int) -> _Line:
    if line is None:
        line = _Line(stack, own)
        lines.append(line)
    line.parts.append(text)
    if links:
        line.links += len(text.strip())
    return line


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page: its lines' text, white space collapsed, joined by spaces."""
    lines = lines_of(page or "")
    texts = [" ".join(unescape("".join(x.parts)).split()) for x in lines]
    plain = [max(0, len(t) - 2 * x.links) for x, t in zip(lines, texts, strict=True)]
    doubt = [max([x.own, *(s for s, _ in x.marks)]) for x in lines]
    weights = [0 if d == _BAD else w if d == _FREE else w // 2 for d, w in zip(doubt, plain, strict=True)]
    first, last = _densest(weights, window, surge)
    if first > last:
        return ""
    level = min(surge, max(weights[first : last + 1]))
    home = _home(lines, weights, first, last, level)
    around = {number for _, number in lines[first].path} & {number for _, number in lines[last].path}
    if home is not None:
        at = next(x.path for x in lines[first : last + 1] if home in x.path)
        around = {number for _, number in at[: at.index(home) + 1]}
    chosen = _inside(lines, [0 if d == _BAD else w for d, w in zip(doubt, plain, strict=True)], home, level) if home is not None else _beside(lines, weights, first, last, level)
    kept = [i for i in chosen if max([lines[i].own, *(s for s, number in lines[i].marks if number not in around)]) in (_FREE, _DOUBT, *[_HEADER] * (home is not None))]
    usual = [plain[i] for i in kept if doubt[i] == _FREE] or [0]
    parts: dict[int, list[int]] = {}  # of sections in doubt
    for i in kept:
        for s, number in lines[i].marks:
            if s == _DOUBT and number not in around:
                parts.setdefault(number, []).append(plain[i])
    out = {number for number, ws in parts.items() if sum(ws) / len(ws) < 0.5 * sum(usual) / len(usual)}
    return " ".join(texts[i] for i in kept if texts[i] and not any(number in out for _, number in lines[i].marks))


def _home(lines: list[_Line], weights: list[int], first: int, last: int, level: int) -> tuple[str, int] | None:
    """The innermost element that holds nearly all of the stretch's weight (an article element: most of it)."""
    total, held, depth = 0, {}, {}
    for x, w in zip(lines[first : last + 1], weights[first : last + 1], strict=True):
        if w >= level:
            total += w
            for k, element in enumerate(x.path):
                held[element] = held.get(element, 0) + w
                depth[element] = k
    fit = [e for e, w in held.items() if w >= (_MOST if e[0] == "article" else _NEARLY_ALL) * total]
    return max(fit, key=lambda e: (depth[e], held[e], -e[1]), default=None)


def _inside(lines: list[_Line], weights: list[int], home: tuple[str, int], level: int) -> list[int]:
    """The lines of an element. At its ends, other boxes without a heavy line are not the article's, unless the element is one by name."""
    mine = [i for i, x in enumerate(lines) if home in x.path]
    if home[0] in ("article", "main"):
        return mine
    heavy = {e for i in mine if weights[i] >= level for e in lines[i].path}

    def at_home(i: int) -> bool:
        below = lines[i].path[lines[i].path.index(home) + 1 :]
        return not below or below[0] in heavy or below[0][0] in _PARTS

    while mine and not at_home(mine[0]):
        del mine[0]
    while mine and not at_home(mine[-1]):
        del mine[-1]
    return mine


def _beside(lines: list[_Line], weights: list[int], first: int, last: int, level: int) -> list[int]:
    """A stretch that lies in no element of its own, and the lines beside it that have its lines' parents."""
    homes = {tuple(x.path[-1:]) for x, w in zip(lines[first : last + 1], weights[first : last + 1], strict=True) if w >= level}

    def at_home(i: int) -> bool:
        return tuple(lines[i].path[-1:]) in homes or any((e,) in homes for e in lines[i].path)

    while first < last and not at_home(first):
        first += 1
    while last > first and not at_home(last):
        last -= 1
    while first > 0 and weights[first - 1] and at_home(first - 1):
        first -= 1
    while last + 1 < len(lines) and weights[last + 1] and at_home(last + 1):
        last += 1
    # Beyond lists and boxes of no weight, the page's own lines go on.
    own = [i for i, x in enumerate(lines) if weights[i] and tuple(x.path[-1:]) in homes]
    begin, end = min([first, *own]), max([last, *own])
    return [i for i in range(begin, end + 1) if first <= i <= last or at_home(i)]


def _densest(weights: list[int], window: int, surge: int) -> tuple[int, int]:
    """First and last line of the stretch between a surge and a dive that holds most text."""
    n = len(weights)
    sums, total = [], sum(weights[:window])
    for i in range(n):
        sums.append(total)
        total += (weights[i + window] if i + window < n else 0) - weights[i]
    level = min(surge, max(sums, default=0))
    best, i = (0, -1, 0), 0  # no stretch: its end is before its start
    while i < n:
        if not level or sums[i] < level:
            i += 1
            continue
        j = i
        while j + 1 < n and sums[j + 1] >= level:
            j += 1
        a, b = i, min(j + window - 1, n - 1)
        while a < b and not weights[a]:
            a += 1
        while b > a and not weights[b]:
            b -= 1
        best = max(best, (sum(weights[a : b + 1]), -a, b))
        i = j + 1
    return -best[1], best[2]


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cut.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
