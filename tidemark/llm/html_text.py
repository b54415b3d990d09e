"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts

#: Lines in a sliding window; the weight in a window that makes a surge, on a page whose heaviest window holds at least SHARE times
#: that, and the one below which it dives.
WINDOW, SURGE, SHARE, DIVE = 3, 86, 4, 1
#: The characters beside the links that a line of mostly links needs to weigh anything.
BESIDE = 20

# HTML element names by what they are.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HOLDERS = frozenset("html body main article div".split())
RAW = frozenset("script style textarea noscript template iframe svg canvas object title head".split())
BOILER = frozenset("nav footer aside form button select menu dialog fieldset label legend search".split())
#: Elements that hold other blocks: within the article only their classes, ids and roles count.
OUTER = frozenset("address center details dialog dir div dl fieldset footer form header hgroup menu nav ol search section ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: What a head may hold.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A class, id or role with such a word marks what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|side-?bars?|footer\w*|"
    r"(?:site|page|top|main)-?header|masthead|cookies?\w*|consent|gdpr|notices?|popup|modal|alert|newsletter|subscri\w+|comments?|"
    r"disqus|replies|responses|discussion|related|share|sharing|social|toolbar|widgets?|pagination|pager|copyright|legal|"
    r"skip-?link|login|signup|search|contentinfo|navigation|complementary|dialog|alertdialog|form)(?=$|[\s_-])",
    re.I,
)

#: Words that a class within the article may have beside such a word; with any other ("related-work", "share-prices") it is the article's own.
BESIDES = frozenset("area article articles bar block body box button buttons container content icon icons inner item items link links list post posts section slot stories thread unit wrapper".split())
#: What a discussion, a response or a legal note is within the article: a part of it.
OWN = frozenset("discussion responses legal main page site top header".split())

OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>", re.S)
TAG = r"<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>%s)>"
QUOTED = re.compile(TAG % r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
#: For pages with a quotation mark that nothing ends.
UNQUOTED = re.compile(TAG % "[^>]*+")
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
SPACES = re.compile(r"\s+")
#: Elements whose end tag may be left out: an opening one closes an open one of its group.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}


def _added(token: str) -> bool:
    """Whether a class within the article names something that was added to it: each of its words does, or names a box."""
    words = [w for w in re.split(r"[-_]+", token.lower()) if w and not w.isdigit()]
    marked = [w for w in words if w not in BESIDES]
    return bool(marked) and all(w not in OWN and MARKS.fullmatch(w) for w in marked)


def _marked(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is boilerplate by its name or attributes. inside: within the article,
    where a header is the article's own, ids say nothing and a class must name an addition as a whole. Of an inline element only what hides it counts."""
    if name in BOILER or (name == "header" and not inside):
        return True
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif key == "aria-hidden" or name in ("html", "body", "article", "main") or name not in BLOCKS:
            continue
        elif inside:
            if key != "id" and (name in OUTER or name in HEADINGS) and any(map(_added, value.split())):
                return True
        elif not (key == "id" and name in HEADINGS) and MARKS.search(value):
            return True
    return False


class Markup:
    """A page's tags, comments and declarations in order. Each place is read once or twice, however
    broken the page is: what nothing ends is text."""

    def __init__(self, page: str):
        self.page, self.last, self.tag = page, page.rfind(">"), QUOTED
        self.unended: set[str] = set()

    def next(self, at: int) -> re.Match | None:
        """The first one from `at` on."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), at):
                m = OTHER.match(page, at) if at < self.last or page.startswith(("<!--", "<![CDATA["), at) else None
            elif at > self.last:
                m = None
            else:
                m = self.tag.match(page, at)
                if not m and self.tag is QUOTED and UNQUOTED.match(page, at):
                    self.tag = UNQUOTED
                    m = self.tag.match(page, at)
            if m:
                return m
            at += 1
        return None

    def end_of(self, name: str, at: int) -> int | None:
        """Where the first end tag of a name from `at` on ends."""
        close = None if name in self.unended else re.compile(rf"</{name}\s*>", re.I).search(self.page, at)
        if not close:
            self.unended.add(name)
        return close.end() if close else None

    def head_end(self, at: int) -> int:
        """Where a head without an end tag ends: at text, or at an element that cannot be in a head."""
        while m := self.next(at):
            name = _name(m)
            if self.page[at : m.start()].strip():
                return at
            if name and name not in IN_HEAD:
                return m.start()
            at = m.end()
            if name in RAW and name != "head" and not m["close"] and not m["attrs"].endswith("/"):
                end = self.end_of(name, at)
                at = len(self.page) if end is None else end
        return at


def _name(m: re.Match) -> str:
    """The name of a tag; empty for a comment or declaration."""
    return m["name"].lower() if "name" in m.re.groupindex else ""


def lines(page: str) -> tuple[list[tuple[str, int, bool, bool, int]], list[int]]:
    """The text blocks of a page in order: (text, characters in links, boilerplate, in the article,
    holder); and the holder of each holder. Holders are numbered as they open; 0 is the page."""
    out: list[tuple[str, int, bool, bool, int]] = []
    up = [0]
    buf: list[tuple[str, bool, bool]] = []  # text, boilerplate, in a link
    stack: list[tuple[str, bool, bool, int]] = []  # name, boilerplate, article, holder
    anchors = 0

    def flush() -> None:
        """End a line. Text that an element within it marks is no part of it; a line of nothing else is boilerplate itself."""
        runs = [r for r in buf if not r[1]] if any(t.strip() and not b for t, b, _ in buf) else buf
        text = SPACES.sub(" ", html.unescape("".join([t for t, _, _ in runs]))).strip()
        if text:
            linked = sum(len(t) for t, _, a in runs if a)
            out.append((text, min(linked, len(text)), any(b for _, b, _ in runs), *(stack[-1][2:] if stack else (False, 0))))
        buf.clear()

    at, end, markup, open_ = 0, len(page), Markup(page), Counter()
    while at < end:
        m = markup.next(at)
        text = page[at : m.start() if m else end]
        if text:
            buf.append((text, bool(stack and stack[-1][1]), anchors > 0))
        if not m:
            break
        at, name = m.end(), _name(m)
        if not name:
            continue
        closed = m["attrs"].endswith("/")
        if not m["close"] and name in RAW and not closed:
            if name in BLOCKS:
                flush()
            after = markup.end_of(name, at)
            at = after if after is not None else markup.head_end(at) if name == "head" else end
            continue
        if name in BLOCKS:
            flush()
        if name == "a":
            anchors = max(0, anchors + (-1 if m["close"] else 1))
        if m["close"]:
            while open_[name]:
                open_[top := stack.pop()[0]] -= 1
                if top == name:
                    break
        elif name not in VOID and not closed:
            if name in CLOSES and stack and stack[-1][0] in CLOSES[name]:
                open_[stack.pop()[0]] -= 1
            boiler, inside, holder = stack[-1][1:] if stack else (False, False, 0)
            inside = inside or name in ("article", "main")
            if name in BLOCKS or name in BOILER or not boiler:
                boiler = boiler or _marked(name, m["attrs"], inside)
            if name in HOLDERS:
                up.append(holder)
                holder = len(up) - 1
            stack.append((name, boiler, inside, holder))
            open_[name] += 1
        if name in BLOCKS:
            anchors = 0 if m["close"] and name in ("li", "td", "p", "div", "nav") else anchors
    flush()
    return out, up


def stretches(weights: list[int], window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> list[tuple[int, int, bool]]:
    """The [first, last) stretches of lines that hold text, and whether each surges.

    The distribution is the weight summed over `window` lines from each line on. A stretch
    reaches from where it rises to `dive` to where it falls below; it surges if a window in it
    holds `surge`.
    """
    sums = [sum(weights[i : i + window]) for i in range(len(weights))] + [0]
    found, first = [], None
    for i, s in enumerate(sums):
        if s >= dive and first is None:
            first = i
        elif s < dive and first is not None:
            found.append((first, i, max(sums[first:i]) >= surge))
            first = None
    return found


def weight(text: str, linked: int, boiler: bool) -> int:
    """What a line adds to the distribution: its characters; those beside the
    links if it is mostly links, unless they are few; nothing for boilerplate."""
    if boiler:
        return 0
    beside = len(text) - linked
    return len(text) if beside >= linked else beside if beside >= BESIDE else 0


def surge_of(weights: list[int], window: int = WINDOW) -> int:
    """The weight of a window that surges, from the page's own: SURGE, or a SHARE-th of the heaviest window where that is less."""
    heaviest = max((sum(weights[i : i + window]) for i in range(len(weights))), default=0)
    return max(1, min(SURGE, -(-heaviest // SHARE)))


def main_text(page: str | None) -> str:
    """The main text of a page, a block a line; empty if there is none."""
    found, up = lines(page or "")
    weights = [weight(*line[:3]) for line in found]
    # The edge of an article is a dive: what stands beside it has to surge by itself.
    surge, parts, at = surge_of(weights), [], 0
    for _, run in groupby(line[3] for line in found):
        n = len(list(run))
        parts += [(at + a, at + b, surges) for a, b, surges in stretches(weights[at : at + n], surge=surge)]
        at += n
    # Weaker stretches stay where the page says that they are its text: in the element around a surge, or in an article.
    spans = _spans([[found[i][4] for i in range(a, b) if weights[i]] for a, b, surges in parts if surges], up)
    out = []
    for a, b, surges in parts:
        some = [i for i in range(a, b) if weights[i]]
        if surges or any(found[i][3] or _within(found[i][4], spans) for i in some):
            # Lines of links between others of the text are part of it.
            out += [found[i][0] for i in range(some[0], some[-1] + 1) if not found[i][2]]
    return "\n".join(out)


def _spans(stretches: list[list[int]], up: list[int]) -> list[tuple[int, int]]:
    """The first and last holder in the innermost one around each stretch, given as its lines'
    holders, in order and apart. A holder's inner ones are numbered right after it."""
    last = list(range(len(up)))
    for i in range(len(up) - 1, 0, -1):
        last[up[i]] = max(last[up[i]], last[i])
    spans: list[tuple[int, int]] = []
    for holders in stretches:
        h, most = min(holders), max(holders)
        while last[h] < most:
            h = up[h]
        spans.append((h, last[h]))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if not out or lo > out[-1][1]:
            out.append((lo, hi))
    return out


def _within(holder: int, spans: list[tuple[int, int]]) -> bool:
    i = bisect_right(spans, (holder, float("inf"))) - 1
    return i >= 0 and spans[i][0] <= holder <= spans[i][1]


def _extract(pages: list) -> dict[str, list]:
    text = [main_text(p) for p in pages]
    return {"text": text, "n_chars": [len(t) for t in text]}


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row of pages: id, the columns of `keep`, text, n_chars (code points).

    Markup is stripped into lines (block elements end a line, character references are decoded,
    white space within a line becomes one space; hidden text and controls within a line are no part of it). A line weighs its characters; lines of menus, headers, footers, sidebars,
    notices, adverts, forms and comments weigh nothing, lines of mostly links what stands beside the
    links. Weights are summed over sliding windows of lines on every page, and the text around each surge, which is measured by the page's own windows, is kept from
    where they rise to where they dive, lines of links within it too. Between dives, weaker text is kept in the element that holds a surging
    stretch and in an article, whatever the length of the rest.
    A null or empty page, or one without text, gives an empty text. Whole pages are read; repeated
    rows give equal results.
    """
    d = pages.select(id_col, *keep, F.col(html_col).alias("_html"))
    return map_texts(d, "_html", lambda: _extract, {"text": "string", "n_chars": "bigint"})
