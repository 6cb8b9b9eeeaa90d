"""Main text of web pages by tag-path ratios.

Each text block of a page has a path, the tags from the root to its block. Per
path, text length and punctuation are summed up and divided by the number of
nodes; both ratios are smoothed over near paths and fused. The blocks of paths
above a threshold show where the content is (the article elements, or else the
common ancestor); every block in there counts, short or not. Elements that never
hold the article (navigation, scripts, ...) are left out before; a suspect name,
or a form, speaks against what is in it, unless it is a wrapper of the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parameters of the method.
SPREAD = 1.0  # of the smoothing over paths, in tree steps
FARTHEST = 12  # steps over which paths are smoothed; exp(-72) is below the last bit of a double
SHARE = 0.12  # of the best path's fused ratio that content needs
SUSPECT = 64.0  # evidence of a suspect name or a form against what is in it
WRAPPER = 4  # a suspect with so many times the other text is a wrapper, if nothing marks the article
INSIDE_ARTICLE = 8.0  # evidence of <article>, <main> or such a class above a path

# Fixed values of HTML: elements without an end tag, inline elements, raw text.
_IN_HEAD = set("base link meta title script style noscript template".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
              "strike strong sub sup time tt u var wbr br img".split())
_NEVER = set("script style noscript template svg math canvas iframe object audio video head title nav footer aside "
             "button select option textarea input dialog".split())
_RAW = re.compile(r"(script|style|noscript|template|textarea|title|iframe|svg)\b", re.I)
_LETTER = re.compile(r"[a-zA-Z]")
_TAG_NAME = re.compile(r"[^\s/>]++")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]*+)(\s*+=\s*+)?")
_UNQUOTED = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile(r"--!?>")
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|sidebar\w*|side-?nav|menu\w*|nav\w*|breadcrumbs?|"
    r"footer|page-?header|site-?header|header|masthead|topbar|comments?|respond|disqus\w*|replies|cookie\w*|consent\w*|"
    r"notices?|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscribe\w*|signup|share\w*|sharing|social\w*|"
    r"related\w*|recommend\w*|widgets?|pagination|pager|login|search\w*|copyright|teasers?|discussion|adsbygoogle|gdpr\w*|legal|disclaimer\w*|complementary|"
    r"navigation|contentinfo)(?=$|[\s_-])", re.I)
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|post-?(?:body|content|text)|entry-?(?:content|body)|story\w*|"
                        r"main-?(?:content|text)|content-?(?:body|main)|content|main)(?=$|[\s_-])", re.I)
# An element whose start ends another that is open: fixed values of HTML.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
              "h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "tbody": {"table"}, "option": {"select"}, "p": set("td th li dd button table".split())}
# Parts that say nothing of what a box holds.
_FURNITURE = set("area bar block body box btn button buttons container content footer form group header icons inner "
                 "item items js lazy left link links list main outer panel post posts right row section slot strip "
                 "text title top bottom wrap wrapper".split())
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_ROOTS = {"html", "body", "main"}
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟।]")


class Node:
    """An element: whether it is hidden or suspect, and what its article is.

    ``place``: its path, a number in the page's tree of paths. ``holds``: it is or
    contains html, body, main or an article; ``marks``: it contains a main, an
    article, a first heading or a name of such. ``chars``: of the blocks in it.
    """

    __slots__ = ("tag", "up", "place", "never", "unseen", "suspect", "article", "holds", "marks", "chars", "blocks", "held")

    def __init__(self, tag: str, up: Node | None, place: int, never: bool, unseen: bool, suspect: bool, article: bool):
        self.tag, self.up, self.place = tag, up, place
        self.never, self.unseen, self.suspect = never, unseen, suspect
        self.article: Node | None = up.article if up and up.article else self if article else None
        self.holds = self.marks = False
        self.chars = self.blocks = self.held = 0


class Block:
    __slots__ = ("place", "parts", "node", "linked", "suspect", "said")

    def __init__(self, place: int, node: Node | None):
        self.place, self.node = place, node
        self.parts: list[str] = []
        self.linked = 0
        self.suspect = False
        self.said = ""

    @property
    def article(self) -> Node | None:
        return self.node.article if self.node else None


class Tags:
    """The start and end tags of a page, by the attribute states of HTML, in one pass.

    A quote inside an unquoted value or a name is a character like any other. A
    quoted value that nothing closes ends with its tag, at the next ">".
    """

    def __init__(self, source: str):
        self.source = source
        self.unclosed: set[str] = set()  # quotes that do not come again

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """The attributes of a tag from behind its name (first of a name counts), its end, and whether "/" ends it."""
        source, n = self.source, len(self.source)
        found: dict[str, str] = {}
        while True:
            gap = _GAP.match(source, at)
            at = gap.end()
            if at >= n:
                return found, n, False
            if source[at] == ">":
                return found, at + 1, gap[0].endswith("/")
            m = _ATTRIBUTE.match(source, at)
            at, value = m.end(), ""
            if m[2]:
                quote = source[at: at + 1]
                if quote in ('"', "'") and quote:
                    end = -1 if quote in self.unclosed else source.find(quote, at + 1)
                    if end < 0:
                        self.unclosed.add(quote)
                        end = source.find(">", at)
                        end = n if end < 0 else end
                        value, at = source[at + 1: end], end
                    else:
                        value, at = source[at + 1: end], end + 1
                else:
                    m2 = _UNQUOTED.match(source, at)
                    value, at = m2[0], m2.end()
            else:
                at = m.end(1)
            found.setdefault(m[1].lower(), value)


def _is_bad(names: str, strict: bool) -> bool:
    """Whether a name says that an element is not the article.

    ``strict``, for articles and what is in them: only if all parts of the name are
    such words, or furniture (share-buttons, but not social-history).
    """
    if not _BAD_NAME.search(names):
        return False
    if not strict:
        return True
    for name in names.split():
        parts = [x for x in re.split(r"[_-]+", name.lower()) if x]
        if _BAD_NAME.search(name) and all(x in _FURNITURE or x.isdigit() or _BAD_NAME.fullmatch(x) for x in parts):
            return True
    return False


def blocks(source: str) -> tuple[list[Block], list[Node], list[int]]:
    """The text blocks of a page in order, without those in elements that never hold the article;
    the elements, each after the one it is in; and the tree of paths, as the parent of each."""
    out: list[Block] = []
    nodes: list[Node] = []
    parents, places = [-1], {}
    stack: list[Node] = []
    is_open: Counter[str] = Counter()  # tags on the stack
    now: Block | None = None
    links = 0
    at, n = 0, len(source)
    tags = Tags(source)

    def text(raw: str) -> None:
        nonlocal now
        if not raw or stack and stack[-1].never:
            return
        if now is None:
            if raw.isspace():
                return
            now = Block(stack[-1].place if stack else 0, stack[-1] if stack else None)
            out.append(now)
        raw = html.unescape(raw)
        now.parts.append(raw)
        if links:
            now.linked += len(raw)

    def close(to: int) -> None:
        nonlocal now, links
        for node in stack[to:]:
            tag = node.tag
            is_open[tag] -= 1
            if tag not in _INLINE:
                now = None
            elif tag == "a":
                links = max(0, links - 1)
        del stack[to:]

    while at < n:
        low = source.find("<", at)
        if low < 0:
            text(source[at:])
            break
        ends_one = source.startswith("</", low)
        start = low + 2 if ends_one else low + 1
        if not _LETTER.match(source, start):
            if source.startswith("<![CDATA[", low):
                text(source[at:low])
                end = source.find("]]>", low)
                text(html.escape(source[low + 9: end if end >= 0 else n]))
                at = end + 3 if end >= 0 else n
            elif source.startswith("<!--", low):
                text(source[at:low])
                if source.startswith("<!-->", low) or source.startswith("<!--->", low):
                    at = source.index(">", low) + 1
                else:
                    end = _COMMENT_END.search(source, low + 4)
                    at = end.end() if end else n
            elif source[start - 1: start + 1] in ("<!", "<?") or ends_one and start < n:
                text(source[at:low])
                end = source.find(">", low)
                at = end + 1 if end >= 0 else n
            else:
                text(source[at: low + 1])
                at = low + 1
            continue
        text(source[at:low])
        name = _TAG_NAME.match(source, start)
        tag = name[0].lower()
        attributes, at, alone = tags.attributes(name.end())
        if ends_one:
            for i in range(len(stack) - 1, -1, -1) if is_open[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break  # a stray end tag of an inline element
            continue
        if tag == "br":
            if now is not None:
                text(" ")
            continue
        if is_open["head"] and tag not in _IN_HEAD:  # anything else ends a head that is still open
            for i, node in enumerate(stack):
                if node.tag == "head":
                    close(i)
                    break
        ends = set(_CLOSES.get(tag, ()))
        if tag in _ENDS_P:
            ends.add("p")
        if any(is_open[x] for x in ends):
            stop = _SCOPE.get(tag, set()) | (set() if "p" not in ends else _SCOPE["p"])
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in stop or stack[i].tag not in _INLINE and stack[i].tag not in ends | {"p"}:
                    break
        if tag not in _INLINE:
            now = None
        if tag in _VOID or alone and not _RAW.match(tag):
            continue
        up = stack[-1] if stack else None
        names = " ".join(attributes.get(x, "") for x in ("class", "id", "role")) if attributes else ""
        own = bool(up and up.article) or tag in ("article", "main")
        bad, good = bool(names and _is_bad(names, own)), bool(names and _GOOD_NAME.search(names))
        unseen = bool(attributes) and ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
                                       or bool(_NOT_SHOWN.search(attributes.get("style", ""))))
        never = bool(up and up.never) or tag in _NEVER or tag in ("header", "menu") and not (up and up.article)
        place = up.place if up else 0
        if tag not in _INLINE:
            place = places.setdefault((place, tag), len(parents))
            if place == len(parents):
                parents.append(up.place if up else 0)
        node = Node(tag, up, place, never, unseen, bad or tag == "form", tag in ("article", "main") and not bad or good)
        # comments and teasers may be articles: such a name holds nothing
        root = tag in _ROOTS or tag == "article" and not bad
        if root or tag == "h1" or good and not bad:
            mark = tag not in ("html", "body")
            x = node
            while x and not ((x.holds or not root) and (x.marks or not mark)):  # else all above it have both
                x.holds |= root
                x.marks |= mark
                x = x.up
        nodes.append(node)
        if _RAW.fullmatch(tag):
            end = re.compile(rf"</{tag}(?:[\s/][^>]*+)?>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag == "a":
            links += 1
        stack.append(node)
        is_open[tag] += 1
    return _seen(out, nodes), nodes, parents


def _seen(found: list[Block], nodes: list[Node]) -> list[Block]:
    """The blocks with text that no element hides; those in suspect elements are marked."""
    for x in nodes:
        x.unseen = bool(x.unseen and not x.holds or x.up and x.up.unseen)
    kept, total = [], 0
    for b in found:
        b.said = " ".join("".join(b.parts).split())
        if not b.node or not b.node.unseen:
            chars = len("".join(b.parts).strip())
            total += chars
            if b.node:
                b.node.chars += chars
                b.node.blocks += 1
            kept.append(b)
    marked = False
    for x in reversed(nodes):
        marked |= x.marks and x.blocks > 0
        if x.up:
            x.up.chars += x.chars
            x.up.blocks += x.blocks
    for x in nodes:
        doubt = x.suspect and not x.holds and not x.marks and (
            marked or x.chars < WRAPPER * (total - x.chars) or x.chars == 0)
        x.suspect = bool(doubt or x.up and x.up.suspect)
    for b in kept:
        b.suspect = bool(b.node and b.node.suspect)
    return [b for b in kept if b.said]


def smoothed(sums: dict[int, list[float]], parents: list[int]) -> dict[int, tuple[float, float]]:
    """Length and punctuation per node of each path, smoothed over the tree of paths.

    A path at so many steps weighs exp(-steps^2 / (2 SPREAD^2)); what is farther than
    FARTHEST steps would not change a double. One pass up the tree sums what lies
    below a path by its steps, one down what lies anywhere.
    """
    needed: dict[int, int] = {}  # paths and those above them, numbered with the upper first
    for p in sums:
        while p >= 0 and p not in needed:
            needed[p] = 0
            p = parents[p]
    order = sorted(needed)
    needed = {p: i for i, p in enumerate(order)}
    up = [needed.get(parents[p], -1) for p in order]
    below = np.zeros((len(order), FARTHEST + 1, 3))
    for p, (nodes, chars, marks, _) in sums.items():
        below[needed[p], 0] = chars / nodes, marks / nodes, 1
    for i in range(len(order) - 1, 0, -1):
        below[up[i], 1:] += below[i, :-1]
    around = below.copy()
    for i in range(1, len(order)):
        around[i, 1:] += around[up[i], :-1]
        around[i, 2:] -= below[i, :-2]
    weigh = np.exp(-np.arange(FARTHEST + 1) ** 2 / (2 * SPREAD ** 2))
    total = np.maximum(np.einsum("nds,d->ns", around, weigh), 0.0)
    return {p: (total[needed[p], 0] / total[needed[p], 2], total[needed[p], 1] / total[needed[p], 2]) for p in sums}


def _holders(best: list[Block], nodes: list[Node]) -> set[Node]:
    """The articles of the content blocks; without one, the least element round all of them."""
    sure = [b for b in best if not b.suspect]
    articles = {b.article for b in best if b.article and not b.suspect}
    if articles:
        return articles
    for x in nodes:
        x.blocks = 0
    for b in sure:
        if b.node is None:
            return set()
        b.node.blocks += 1
    least: set[Node] = set()
    for x in reversed(nodes):
        if x.up:
            x.up.blocks += x.blocks
    for x in nodes:  # the last one that holds all is the least
        if sure and x.blocks == len(sure) and x.tag not in _INLINE:
            least = {x}
    return least


def main_text(source: str) -> str:
    """The page's main text: content blocks in page order, joined by one space."""
    found, nodes, parents = blocks(source)
    # per path: nodes, characters outside links, punctuation, evidence of an article
    sums: dict[bool, dict[int, list[float]]] = {False: {}, True: {}}
    for b in found:
        s = sums[b.suspect].setdefault(b.place, [0, 0, 0, False])
        s[0] += 1
        s[1] += max(0, len(b.said) - b.linked)
        s[2] += len(_PUNCTUATION.findall(b.said))
        s[3] |= b.article is not None
    if not found:
        return ""
    some_article = any(s[3] for s in sums[False].values())
    fused = {}
    for suspect, of_paths in sums.items():
        for p, (length, points) in (smoothed(of_paths, parents) if of_paths else {}).items():
            value = math.sqrt(length * (points + 0.5))
            if some_article:
                value *= INSIDE_ARTICLE if of_paths[p][3] else 1 / INSIDE_ARTICLE
            fused[p, suspect] = value / SUSPECT if suspect else value
    least = SHARE * max(fused.values())
    content = {p for p, v in fused.items() if v >= least}
    holders = _holders([b for b in found if (b.place, b.suspect) in content], nodes)
    for x in nodes:  # 2: in a holder that is the page itself, 1: in another one
        x.held = max(x.up.held if x.up else 0, 0 if x not in holders else 2 if x.tag in ("html", "body") else 1)
    return " ".join(b.said for b in found if (b.place, b.suspect) in content
                    or not b.suspect and b.node and b.node.held
                    and (2 * b.linked <= len(b.said) or b.node.held < 2))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    Null and empty pages, and pages without text, give an empty text. Rows that
    repeat are rows of their own; further columns play no part; an empty table
    gives none. Each page is read alone, whatever its length, and nothing moves.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
