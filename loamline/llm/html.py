"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each with the path of tags from the root. For each path the lengths and the punctuation of
its texts are summed over its nodes: running text has long nodes with much punctuation, menus have short ones without.
The two ratios are smoothed along the page, so that a short paragraph among long ones isn't lost, fused by product, and
the paths above a threshold are content. The lowest element that holds all content is the article, with the headings
right before it; inside of it nothing is dropped but what is something else by its element (navigation, forms, asides and
the like) or by its class names and ids, and outside of it nothing is kept.

Names and elements only suggest: one that they mark stays if most of the page's content is in it, and one inside a marked
article stays if its own ratios are those of content; article elements count where a good part of the content is in them. Elements that are named as reader comments always go, unless there
is nothing else. Elements are rows of lists, a path is a number (of its parent's path and a tag), and each step goes over
all elements once, so time and memory grow with the page's length however deep it is.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import text_of

#: Elements of HTML by what becomes of their text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg select annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split()) | frozenset("math menclose mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
OTHER = frozenset("nav header footer aside form button dialog menu fieldset".split())
#: Those of them that may hold a whole page.
SOFT = frozenset("form dialog fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr td th tbody".split())
ARTICLE = frozenset("article main".split())
#: What an element closes of its own kind, unless one of these stands between.
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Parts of class names and ids that mark something else than the article.
MARKS = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|footer|masthead|site-?header|header|share|sharing|social|related|recommended|comments?|commentlist|respond|disqus|discussion|replies|login|signup|search|pagination|pager|toolbar)(?:$|[-_\s\d])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
#: A header of the text itself, and attributes without what they are set to.
OWN_HEADER = re.compile(r"(?:page|entry|post|article|content|story|section|title|main)[-_]?header", re.I)
VALUES = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
#: A heading of reader comments, and how many of a list's texts are links for it to be a menu.
COMMENT_HEADING = re.compile(r"\W*(?:\d+\s+)?(?:reader\s+)?(?:comments?|responses?|replies|discussion)\W*(?:\d+\W*)?(?:(?:to|on)\s.*)?", re.I)
LINKS = 3
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？¿¡]")
#: The part of the content from which article elements are the article, and of the largest one's that any has.
TEASERS, SMALL = 0.3, 0.15
SMOOTHING = np.exp(-0.5 * np.arange(-2, 3) ** 2)
SMOOTHING /= SMOOTHING.sum()


#: Those of reader comments.
COMMENTS = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|respond|disqus|discussion|replies|reply)(?:$|[-_\s\d])", re.I)
#: What a marked element's names say: nothing, another part of the page, reader comments.
PLAIN, MARKED, COMMENT = 0, 1, 2


class Page:
    """The elements of a page in the order in which they open, the root first, as columns; and its texts in order: element,
    number of the block that the text is in, and the text as it stands."""

    def __init__(self) -> None:
        self.names, self.parents, self.paths, self.others, self.marks, self.blocks = [""], [0], [0], [0], [PLAIN], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.known: dict[tuple[int, str], int] = {}

    def open(self, name: str, parent: int, other: int, mark: int) -> int:
        self.names.append(name), self.parents.append(parent)
        self.paths.append(self.known.setdefault((self.paths[parent], name), len(self.known) + 1))
        self.others.append(other), self.marks.append(mark)
        own = len(self.names) - 1
        self.blocks.append(self.blocks[parent] if name in INLINE else own)
        return own


def is_other(name: str, attrs: str, inside_article: bool, quoted: bool) -> int:
    """Whether an element is something else than the article: 0 no, 1 yes, 2 unless it holds most of the page. Inside an
    article a header is a part of it, and in a quotation a footer tells whose it is."""
    if name in OTHER and not (name == "header" and inside_article) and not (name in ("header", "footer") and quoted):
        return 2 if name in SOFT else 1
    if "=" in attrs:
        found = attributes(attrs)
        if found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            return 1
    return int("hidden" in attrs and re.search(r"(?:^|\s)hidden(?:[\s=/]|$)", VALUES.sub("=", attrs)) is not None)


def attributes(attrs: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}


def mark_of(name: str, attrs: str, inside_article: bool) -> int:
    """What an element's class names and ids say of it. An article's header is a part of it."""
    if "=" not in attrs or name in ("html", "body"):
        return PLAIN
    found = attributes(attrs)
    own = [found.get(k, "") for k in ("class", "id")]
    if any(map(COMMENTS.search, own)):
        return COMMENT
    if name in ARTICLE or name == "header":
        return PLAIN
    parts = [m.group().strip("-_ \t\n").lower() for x in own for m in MARKS.finditer(OWN_HEADER.sub("", x))]
    return MARKED if any(not inside_article or x != "header" for x in parts) else PLAIN


def parsed(page: str) -> Page:
    out, top, block, articles, at = Page(), 0, 0, 0, 0
    names, parents = out.names, out.parents
    open_now: dict[str, int] = defaultdict(int)  # how many elements of a name are open

    def close(upto: int) -> None:
        """Close the open elements up to this one."""
        nonlocal top, articles
        while True:
            closed = top
            open_now[names[closed]] -= 1
            articles -= names[closed] in ARTICLE
            top = parents[closed]
            if closed == upto:
                return

    while at < len(page):
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            out.texts.append((top, block, page[at:end]))
        if not m:
            break
        at = m.end()
        if m["cdata"]:
            out.texts.append((top, block, m["cdata"]))
        if not m["name"]:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        if name == "br":
            out.texts.append((top, block, " "))
            continue
        block += name not in INLINE
        if m["close"]:
            # an end tag closes what it names; without a fellow it closes nothing, and inline ones stop at a block
            if open_now[name]:
                x = top
                while x and names[x] != name and not (name in INLINE and names[x] not in INLINE):
                    x = parents[x]
                if x and names[x] == name:
                    close(x)
            continue
        if name in VOID:
            continue
        if name in RAW:
            ends = re.compile(rf"</{re.escape(name)}\s*(?:/?>|\Z)", re.I).search(page, at)
            at = ends.end() if ends else len(page)
            continue
        if (name in ENDS_P or name == "body") and open_now["p"]:
            x = top
            while x and names[x] in INLINE:
                x = parents[x]
            if names[x] == "p":
                close(x)
        if name in CLOSES and open_now[name]:
            x = top
            while x and names[x] not in CLOSES[name] and names[x] != name:
                x = parents[x]
            if names[x] == name:
                close(x)
        if attrs.endswith("/") and name not in INLINE and name not in ENDS_P:
            continue
        top = out.open(name, top, is_other(name, attrs, articles > 0, open_now["blockquote"] > 0), mark_of(name, attrs, articles > 0))
        open_now[name] += 1
        articles += name in ARTICLE
    return out


def content_paths(nodes: list[tuple[int, str]]) -> tuple[set[int], float]:
    """The paths whose smoothed and fused ratios are above the threshold, a part of their spread over the page; and it.
    nodes: path and text."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text in nodes:
        length[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    ratio = np.array([[length[p] / count[p], (1 + marks[p]) / count[p]] for p, _ in nodes])
    padded = np.pad(ratio, ((2, 2), (0, 0)), mode="edge")
    smooth = np.stack([np.convolve(padded[:, k], SMOOTHING, mode="valid") for k in (0, 1)])
    fused = smooth[0] * smooth[1]
    best: dict[int, float] = defaultdict(float)
    for (path, _), x in zip(nodes, fused.tolist(), strict=True):
        best[path] = max(best[path], x)
    threshold = min(0.8 * float(fused.std()), max(best.values()))
    return {path for path, x in best.items() if x >= threshold}, threshold


def inherited(page: Page, own: Callable[[int], object]) -> list:
    """For each element the value of the first of it and what holds it, from the inside, that has one."""
    out: list = [None] * len(page.names)
    for x in range(len(page.names)):
        mine = own(x)
        out[x] = mine if mine is not None else (out[page.parents[x]] if x else None)
    return out


def held(page: Page, values: dict[int, int]) -> list[int]:
    """For each element the sum of the values of it and of all that it holds."""
    out = [0] * len(page.names)
    for x, v in values.items():
        out[x] += v
    for x in range(len(out) - 1, 0, -1):
        out[page.parents[x]] += out[x]
    return out


def sums(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for x, v in pairs:
        out[x] += v
    return out


def others_of(page: Page) -> list[bool]:
    """For each element whether it is, or lies in, something else than the article. Forms and the like are so unless they
    hold half of the text that isn't in menus and footers, as a form around the whole page does."""
    hard = [False] * len(page.names)
    for x in range(1, len(hard)):
        hard[x] = hard[page.parents[x]] or page.others[x] == 1
    if 2 not in page.others:
        return hard
    length = held(page, sums((x, len(t.strip())) for x, _, t in page.texts if not hard[x]))
    out = list(hard)
    for x in range(1, len(out)):
        out[x] = out[page.parents[x]] or hard[x] or (page.others[x] == 2 and 2 * length[x] < length[0])
    return out


def outermost_articles(page: Page, articles: list) -> list[int]:
    """For each element the outermost article element around it, 0 if there is none."""
    out = [0] * len(page.names)
    for x in range(1, len(out)):
        out[x] = out[page.parents[x]] or (x if articles[x] == x else 0)
    return out


def drop_by_place(page: Page, nodes: list[tuple[int, str]], gone: list[bool]) -> None:
    """Mark what only its place and its form tell: lists of links before the first or after the last running text, and what
    follows a heading of reader comments, if most of the content stands before it."""
    names, parents = page.names, page.parents
    running = [k for k, (x, t) in enumerate(nodes) if len(t) >= 60 and PUNCTUATION.search(t)]
    first, last = (running[0], running[-1]) if running else (len(nodes), -1)
    links = inherited(page, lambda x: x if names[x] == "a" else None)
    lists = inherited(page, lambda x: x if names[x] in ("ul", "ol") else None)
    found: dict[int, list[tuple[int, bool, str]]] = defaultdict(list)
    for k, (x, t) in enumerate(nodes):
        if lists[x] is not None:
            found[lists[x]].append((k, links[x] is not None, t))
    for x, own in found.items():
        outside = own[-1][0] < first or own[0][0] > last
        if outside and len(own) >= LINKS and all(link and len(t) < 60 for _, link, t in own):
            gone[x] = True
    heading = inherited(page, lambda x: x if names[x] in HEADINGS else None)
    total, so_far = sum(len(t) for _, t in nodes), 0
    for k, (x, t) in enumerate(nodes):
        h = heading[x]
        if h is not None and COMMENT_HEADING.fullmatch(t) and 2 * so_far >= total:
            within = inherited(page, lambda y, top=parents[h]: True if y == top else None)
            for y, _ in nodes[k:]:
                if within[y] or parents[h] == 0:
                    gone[y] = True
            gone[h] = True
            break
        so_far += len(t)
    for x in range(1, len(names)):
        gone[x] = gone[x] or gone[parents[x]]


def main_text(html: str) -> str:
    """The text of a page's article, one line for each block."""
    page = parsed(html)
    names, parents, paths = page.names, page.parents, page.paths
    other = others_of(page)
    texts = [(x, block, text) for x, block, text in page.texts if not other[x]]
    nodes = [(x, t.strip()) for x, _, t in texts if t.strip()]
    if not nodes:
        return ""

    # elements that are named as something else go, comments first; an element with most of the content stays
    gone = [False] * len(names)
    articles = inherited(page, lambda x: x if names[x] in ARTICLE and page.marks[x] != COMMENT else None)
    for kind, most in ((COMMENT, 1.0), (MARKED, 0.5)):
        if kind not in page.marks:
            continue
        left = [(x, t) for x, t in nodes if not gone[x]]
        inside = [(x, t) for x, t in left if articles[x] is not None] or left
        good, threshold = content_paths([(paths[x], t) for x, t in inside])
        weight = held(page, sums((x, len(t)) for x, t in inside if paths[x] in good))
        length, marks, count = (held(page, sums((x, f(t)) for x, t in left)) for f in (len, lambda t: len(PUNCTUATION.findall(t)), lambda t: 1))
        for x in range(1, len(names)):
            drop = page.marks[x] == kind and count[x] > 0 and weight[x] < most * weight[0]
            if drop and kind == MARKED and articles[x] is not None:
                drop = length[x] / count[x] * (1 + marks[x]) / count[x] < threshold
            gone[x] = gone[x] or drop or gone[parents[x]]
    nodes = [(x, t) for x, t in nodes if not gone[x]]
    # elements of articles with a good part of the content stand above what lies outside of them; others are teasers
    good, _ = content_paths([(paths[x], t) for x, t in nodes])
    whole = sum(len(t) for x, t in nodes if paths[x] in good)
    outermost = outermost_articles(page, articles)
    own = sums((outermost[x], len(t)) for x, t in nodes if paths[x] in good and outermost[x])
    least = SMALL * max(own.values(), default=0) if sum(own.values()) >= TEASERS * whole else whole + 1
    for x in range(1, len(names)):
        gone[x] = gone[x] or bool(outermost[x] and own.get(outermost[x], 0) < least)
    if least <= whole:
        nodes = [(x, t) for x, t in nodes if outermost[x]]
    nodes = [(x, t) for x, t in nodes if not gone[x]]
    drop_by_place(page, nodes, gone)
    nodes = [(x, t) for x, t in nodes if not gone[x]] or nodes
    good, _ = content_paths([(paths[x], t) for x, t in nodes])
    # the lowest element with all of the content holds the article
    content = {page.blocks[x]: 1 for x, _ in nodes if paths[x] in good}
    inner = held(page, content)
    holder = max(x for x in range(len(names)) if inner[x] == len(content))
    while holder and names[holder] in ("p", "li", "td", "blockquote"):
        holder = parents[holder]
    outer = inherited(page, lambda x: x if names[x] in ARTICLE and not gone[x] else None)[holder]
    holder = holder if outer is None else outer
    within = inherited(page, lambda x: True if x == holder else None)
    heading = inherited(page, lambda x: True if names[x] in HEADINGS else None)
    kept: list[tuple[int, str]] = []
    headings: list[tuple[int, str]] = []
    for x, block, text in texts:
        if gone[x]:
            continue
        if within[x]:
            kept += [*(headings if not kept else []), (block, text)]
            headings = []
        elif heading[x]:
            headings.append((block, text))
        elif text.strip():
            headings = []
    out: dict[int, list[str]] = {}
    for block, text in kept:
        out.setdefault(block, []).append(text)
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in out.values())
    return "\n".join(line for line in lines if line)


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            texts = [main_text(h) for h in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Text is the article's: without menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts,
    styles, markup and comments. Character references are decoded, white space inside a block becomes one space, blocks
    are joined by a line end. Null, empty and unreadable pages have the empty text. Pages are read whole, broken or cut
    off ones too. Repeated rows, null ids and further columns of any name change nothing; an empty table gives an empty
    result.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), text_of(html_column).alias("html"))
    return rows.mapInArrow(extracted, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars bigint")
