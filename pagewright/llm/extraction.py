"""Main text of web pages from flat text blocks and a decision tree.

The markup is read once, from left to right, into a flat list of text blocks.  A block has the
number of its words and the share of them inside links, the same of its two neighbours, and what
its open elements say: whether it is inside an article, inside page furniture, under a name that
furniture often has, or a heading.  A decision tree, trained here on the blocks of the small labelled
pages below, tells text from furniture.
"""

from __future__ import annotations

import html
import re
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

_token = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|iframe|title|select|annotation-xml|annotation)\b"
    r"(?:(?<=svg)(?:\"[^\"]*\"|'[^']*'|[^>\"'/]|/(?!>))*/>|(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:>.*?(?:</\1\s*>|\Z)|\Z))"  # of these only svg can close itself
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
).finditer
_attributes = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I).findall
_pieces = re.compile(r"[^a-z0-9]+").split

BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold furniture; those of the second set don't when an article is begun inside (they were left open).
FURNITURE = {"nav", "aside", "footer", "form", "button", "menu", "dialog", "head", "label", "legend", "fieldset", "option"}
LEFT_OPEN = {"nav", "footer", "form", "header", "head", "menu", "button"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of class names and ids that say furniture, and those that only hint at it.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr "
    "newsletter subscribe subscription signup popup modal overlay nav navbar navigation navi menu menus breadcrumb breadcrumbs crumbs sidebar sidebars aside footer footnav colophon masthead "
    "topbar share sharing social comment comments commentlist reply replies respond disqus pagination pager login search toolbar copyright skip sitemap paywall donate".split()
)
HINTS = set("alert alerts notice notices notification related recommended recommendations discussion rail widget widgets legal disclaimer tags trending popular hidden print tools more further see".split())
#: Words that may stand beside a mark in one name; a name with another word ("related-work") is no mark.
BESIDE = set(
    "box boxes wrap wrapper container block blocks section area inner outer item items list lists link links bar panel top bottom left right module region zone col row content text title btn button icon "
    "small large mobile desktop js site page global primary secondary main post posts article articles entry blog inline body header group holder unit slot form field icons media buttons stories news view".split()
)
#: Furniture only outside articles.
OUTER_MARKS = {"header", "head", "top", "bottom", "meta", "logo", "brand"}
MAIN_MARKS = {"article", "articlebody", "content", "entry", "post", "story", "main", "maincontent", "bodytext"}


def names_in(value: str) -> tuple[bool, bool, set[str]]:
    """Of a class or id: whether a name says furniture, whether one hints at it, and all their words."""
    marked = hinted = False
    every: set[str] = set()
    for name in value.split():
        words = {w for w in _pieces(name) if w and not w.isdigit()}
        every |= words
        if words <= MARKS | HINTS | BESIDE:
            marked |= not words.isdisjoint(MARKS)
            hinted |= not words.isdisjoint(HINTS)
    return marked, hinted, every


def read_blocks(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """The text blocks of a page: (text, words, words in links, in an article, in furniture, heading, hint of furniture)."""
    blocks: list[tuple[str, int, int, int, int, int, int]] = []
    stack: list[tuple[str, int, int, int]] = []  # element, opens an article, opens furniture, hints at furniture
    main = furniture = links = hints = 0

    def shut(i: int) -> None:
        """Close the open elements from number i on."""
        nonlocal main, furniture, links, hints
        for e, opens_main, opens_furniture, hint in stack[i:]:
            main -= opens_main
            furniture -= opens_furniture
            links -= e == "a"
            hints -= hint
        del stack[i:]

    text: list[str] = []
    linked: list[str] = []

    def end_block() -> None:
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            if own:
                in_links = len(html.unescape("".join(linked)).split())
                heading = any(e[0] in HEADING for e in stack[-3:])
                blocks.append((own, own.count(" ") + 1, in_links, int(main > 0), int(furniture > 0), int(heading), int(hints > 0)))
            text.clear()
            linked.clear()

    for m in _token(page):
        raw, close, name, attrs, data = m[1], m[2], m[3], m[4], m[5]
        if data is not None:
            text.append(data)
            if links:
                linked.append(data)
            continue
        if name is None:
            if raw:
                end_block() if raw.lower() == "title" else text.append(" ")
            continue
        name = name.lower()
        if name in BLOCK:
            end_block()
        elif name == "br":
            text.append(" ")
            linked.append(" ")
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    shut(i)
                    break
            continue
        if name in VOID or attrs.endswith("/"):
            continue
        if name == "p":
            for i in range(len(stack) - 1, -1, -1):  # a paragraph ends the one before
                if stack[i][0] in BLOCK:
                    if stack[i][0] == "p":
                        shut(i)
                    break
        marks: set[str] = set()
        unseen = marked = hinted = False
        for key, value in _attributes(attrs) if attrs else ():
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                says, hint, words = names_in(value)
                marked, hinted = marked or says, hinted or hint
                marks |= words
            elif key == "role":
                unseen |= value in ROLES - {"alert"}
                hinted |= value == "alert"
                marks.add("main" if value == "main" else "")
            elif key == "itemprop":
                marks.add(value)
            else:
                unseen |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value) is not None)
        strong = unseen or marked
        if name in ("article", "main") and not strong:
            while stack and furniture and any(e[2] and e[0] in LEFT_OPEN for e in stack):
                shut(len(stack) - 1)
        opens_main = int(name in ("article", "main") or (not strong and not marks.isdisjoint(MAIN_MARKS) and name not in ("body", "html", "a")))
        outer = name == "header" or not marks.isdisjoint(OUTER_MARKS)
        opens_furniture = int(strong or name in FURNITURE or (outer and not main and not opens_main)) if name not in ("body", "html") else 0
        hint = int(hinted and name not in ("body", "html"))
        stack.append((name, opens_main, opens_furniture, hint))
        main += opens_main
        furniture += opens_furniture
        hints += hint
        links += name == "a"
    end_block()
    return blocks


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in article", "page has article", "in furniture", "heading", "hint")

#: How large the blocks of text are made: the pages of articles are taken with short blocks too.
SIZES = (0.1, 0.3, 1, 2)
#: Labelled pages made up for this purpose.  +n stands for a block of n words of text, -n for one of furniture;
#: a star after it puts half of its words, two stars all, into links.
PAGES = """
<nav><ul><li>-1**<li>-2**<li>-1**<li>-3**</ul></nav><div class=ad>-8</div><article><h1>+7</h1><p>+12<p>+80<p>+64<p>+3<p>+1<div class=ad-box>-14</div><p>+33<h2>+2</h2><p>+45</article><footer>-9</footer>
<header><p>-5<ul><li>-1**<li>-1**</ul></header><article><header><h1>+9</h1><p>+4</header><p>+25<p>+18*<p>+30<ul><li>+8<li>+6<li>+11</ul><p>+50<section class=comments><h3>-2</h3><p>-22<p>-41<p>-9</section></article><aside><h3>-3</h3><p>-35<p>-28</aside><footer><p>-12*</footer>
<header><p>-6</header><main><h1>+6</h1><p>+55<p>+70<blockquote>+20</blockquote><p>+4<p>+90<table><tr><td>+3<td>+2</tr></table><p>+28</main><form><label>-2</label><p>-9</form><footer>-30</footer>
<div id=menu><a>-1**</a><a>-2**</a></div><div class=content><h2>+5</h2><p>+60<p>+16<div class=related-posts><h3>-2</h3><ul><li>-6**<li>-7**<li>-5**</ul></div><p>+24<div class=share-buttons>-3**</div></div><div class=sidebar><p>-40<p>-22</div>
<h1>+5</h1><p>+130<p>+90<p>+28<p>+16<p>-3**<p>-2**<p>-4**<p>-9
<p>-2**<p>-1**<p>-3**<h1>+6</h1><p>+55<p>+70<p>+4<p>+35<p>+48<ul><li>-5**<li>-6**<li>-4**</ul><p>-5
<div class=cookie-notice><p>-38<p>-11</div><div><p>+120</div><div class=footer><p>-14*</div>
<ul><li>-2**<li>-2**</ul><article><p>+15<p>+12<p>+17<p>+9<div class=alert><p>-9</div><p>+44<p>+3</article><div class=related>-30</div>
<article><h1>+4</h1><p>+20<section class=further><h2>+2</h2><p>+60<p>+48<p>+35</section><div class=notice>-12</div><p>+11**<div class=popular><p>-3**<p>-7**<p>-4**</div></article>
<article><h1>+5</h1><div class=see><p>+40<p>+52</div><p>+30<div class=tags>-3**</div><div class=widget><p>-8*<p>-5**</div><p>+22<p>+2</article><p>-14<p>-6**
<nav>-4**</nav><article><p>+2</article><aside>-50</aside>
<div><p>-8*<p>-7**<p>-2<p>-18*<p>-20**<p>-9*</div><p>+60<p>+75*<p>+51<p>+66
<article><h1>+1</h1><p>+1<p>+2<p>+65<p>+60<p>+3*<p>+50<p>+6*<p>+9</article><p>-11**<p>-3**<div class=promo>-24</div>
<p>+15<p>+12<p>+17<footer><p>-7</footer>
<nav>-2**</nav><article><h1>+4</h1><p>+20<p>+30</article>
<article><p>+12<p>+6<p>+9</article>
<nav>-1**</nav><article><p>+3</article>
<header>-3**</header><article><h2>+3</h2><p>+14<p>+8<p>+21<p>+5</article>
<p>+40
<div><p>+25<p>+9<p>+31</div>
<p>+12<p>+33<p>-2**<p>-3**
<div><h1>+3</h1><p>+70<p>+20</div><div><p>-6<p>-5**</div>
"""


def labelled_blocks() -> tuple[list[tuple[float, ...]], list[int]]:
    """The features and labels (1 for text) of the blocks of ``PAGES``, each page with blocks of several sizes."""
    rows, labels = [], []
    for page, size in product(PAGES.strip().splitlines(), SIZES):

        def spell(m: re.Match, size: float = size) -> str:
            n = max(1, round(int(m[2]) * (size if m[1] == "+" and "<article" in page else max(size, 1) if m[1] == "+" else 1)))
            linked = n * len(m[3]) // 2
            words = ["yes" if m[1] == "+" else "no"] * n
            return " ".join(words[linked:]) + (" <a>" + " ".join(words[:linked]) + "</a>" if linked else "")

        blocks = read_blocks(re.sub(r"([+-])(\d+)(\*{0,2})", spell, page))
        rows += features(blocks)
        labels += [int(b[0].startswith("yes")) for b in blocks]
    return rows, labels


def grow(rows: list[list[float]], labels: list[int], depth: int = 8):
    """A decision tree by Gini impurity: a label, or (feature, threshold, tree up to it, tree above it).  Ties go to the first feature and threshold."""
    ones = sum(labels)
    if not depth or ones in (0, len(labels)):
        return int(2 * ones >= len(labels))
    best = None
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for lo, hi in zip(values, values[1:]):
            cut = (lo + hi) / 2
            left = [y for r, y in zip(rows, labels, strict=True) if r[f] <= cut]
            right = [y for r, y in zip(rows, labels, strict=True) if r[f] > cut]
            impurity = sum(len(p) - (sum(p) ** 2 + (len(p) - sum(p)) ** 2) / len(p) for p in (left, right))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None:
        return int(2 * ones >= len(labels))
    _, f, cut = best
    sides = [[i for i, r in enumerate(rows) if (r[f] > cut) == above] for above in (False, True)]
    return (f, cut, *(grow([rows[i] for i in side], [labels[i] for i in side], depth - 1) for side in sides))


@cache
def trained_tree():
    return grow(*labelled_blocks())


def features(blocks: list[tuple[str, int, int, int, int, int, int]]) -> list[tuple[float, ...]]:
    """The features of every block; at the ends a neighbour has no words.  Furniture counts for neighbours like other blocks."""
    sizes = [(b[1], 100 * min(b[2], b[1]) / b[1]) for b in blocks]
    around = [(0, 0.0), *sizes, (0, 0.0)]
    has_main = int(any(b[3] and not b[4] for b in blocks))
    return [(*around[i + 1], *around[i], *around[i + 2], b[3], has_main, b[4], b[5], b[6]) for i, b in enumerate(blocks)]


def main_text(page: str | None, tree=None) -> str:
    """The text blocks of a page that the tree takes for text, joined by single spaces; "" for a null or empty page."""
    tree = trained_tree() if tree is None else tree
    blocks = read_blocks(page or "")
    out = []
    for block, x in zip(blocks, features(blocks), strict=True):
        node = tree
        while not isinstance(node, int):
            node = node[3] if x[node[0]] > node[1] else node[2]
        if node:
            out.append(block[0])
    return " ".join(out)


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` to ``pages``; columns with these names, and the page itself, are left out.

    A null or empty page has an empty text.  Whole pages are read, however long, there is no shuffle, and equal pages
    give equal texts, repeated rows included.  Elements left open or closed out of order end where an element around
    them ends.  An empty table gives an empty result.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars", column)]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string", "n_chars bigint"])

    source = "page" + "_" * max(map(len, pages.columns))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column(source).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"]
        )

    return map_arrow(pages.select(*(f"`{c}`" for c in keep), F.col(f"`{column}`").cast("string").alias(source)), run, schema)
