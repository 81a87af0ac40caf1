"""Main-text extraction by minimum cut.

A page is split at block-level tags into text blocks with their open containers.  A
linear classifier gives each block a cost of calling it content or boilerplate, from its
text (length, sentence ends, links, copyright signs), from where it stands (elements with
a meaning in HTML; outside the page's article; in an article within an article, or in one
without a heading beside a longer one, as readers' comments are) and, as one piece of
evidence more, from what its containers are named.  The costs are the capacities from the
source and to the sink.  Neighbouring blocks, and blocks that follow each other in one
container, are joined by smoothness edges, weaker across containers of different
standing: a block of weak evidence goes with those around it.  The minimum cut, found by
maximum flow (Dinic), separates content from boilerplate.  Scripts, styles, comments and
form controls never become blocks.

Defined results: null or empty html, and html without content, give the empty text with
n_chars 0; repeated rows each get a row; null page_id and url are kept; very long pages
are read whole in one linear scan; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAMED = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDES = re.compile(r"hidden|display", re.I)
_NONE = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)

#: Elements whose inside is no text of the page.
_SKIP = frozenset("script style noscript template svg iframe object select textarea button math canvas audio video head".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements that start and end blocks; all other tags are inline.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul caption title".split())
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: Elements that count as containers for DOM proximity.
_BOX = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
#: What may stand in the head; any other element, and text, ends it.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: Elements that end an open paragraph.
_ENDS_P = _BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend option optgroup frameset title".split())
#: Elements that end with the start of others: (those ended, where the search for them stops).
_ROWS, _TABLE = frozenset("thead tbody tfoot tr td th caption".split()), frozenset(("table",))
_STOPS = _BLOCK - frozenset("address div p li dt dd option optgroup".split())
_PEERS = {
    "li": (frozenset(("li",)), _STOPS),
    "dt": (frozenset(("dt", "dd")), _STOPS),
    "dd": (frozenset(("dt", "dd")), _STOPS),
    "option": (frozenset(("option",)), _STOPS | {"optgroup"}),
    "optgroup": (frozenset(("option", "optgroup")), _STOPS),
    "td": (frozenset(("td", "th", "caption")), _TABLE | {"tr"}),
    "th": (frozenset(("td", "th", "caption")), _TABLE | {"tr"}),
    "tr": (frozenset(("tr", "td", "th", "caption")), _TABLE),
    "thead": (_ROWS, _TABLE),
    "tbody": (_ROWS, _TABLE),
    "tfoot": (_ROWS, _TABLE),
}

#: What containers say: log-odds of content, in hundredths.
_TAG_COST = {"article": 250, "main": 200, "nav": -600, "footer": -500, "aside": -500, "form": -500, "menu": -500, "dialog": -500, "header": -150, "fieldset": -300, "title": -900}
#: Names of what is no content, wherever it stands, and names that content may have too.
_BAD_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|side-?bar|widget|footer|masthead|cookies?|consent|gdpr|newsletter|subscri\w*|sign-?up|login|share|sharing|social|related|recommend\w*|popular|trending|comments?|commentlist|comment-\w+|replies|reply|disqus|respond|pagination|pager|popup|modal|toolbar)(?:$|[\s_-])", re.I)
_WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:banner|foot|header|notice|alert|overlay|tags|teaser|legal|copyright|disclaimer)(?:$|[\s_-])", re.I)
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?:$|[\s_-])", re.I)
_BAD_ROLE = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"))
BAD_NAME, WEAK_NAME, GOOD_NAME = -450, -150, 100
#: What text and place say.
OUTSIDE, NESTED, HEADLESS, SIGN = -350, -600, -500, -300
_SIGN = re.compile(r"[©®™]|\(c\) ?[12][0-9]{3}", re.I)
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ADJACENT, SAME_BOX = 60, 160


class Block:
    __slots__ = ("article", "box", "depth", "links", "parts", "path_cost", "tag")

    def __init__(self, tag: str, box: int, path_cost: int, article: int = 0, depth: int = 0):
        self.tag, self.box, self.path_cost, self.article, self.depth = tag, box, path_cost, article, depth
        self.parts: list[str] = []
        self.links = 0


def _name_cost(tag: str, attrs: str) -> int:
    cost = _TAG_COST.get(tag, 0)
    if attrs:
        for m in _ATTR.finditer(attrs):
            name = m[1] or m[2] or m[3] or ""
            if tag in ("body", "html"):
                continue
            if name.lower() in _BAD_ROLE or _BAD_NAME.search(name):
                cost += BAD_NAME * (1 + (tag in ("article", "main")))
            elif tag in ("article", "main"):
                continue
            elif _WEAK_NAME.search(name):
                cost += WEAK_NAME
            elif _GOOD_NAME.search(name):
                cost += GOOD_NAME
    return cost


def _hidden(attrs: str) -> bool:
    """Whether an element has the attribute `hidden`, or a style that does not display it."""
    if not _HIDES.search(attrs):
        return False
    for m in _NAMED.finditer(attrs):
        name = m[1].lower()
        if name == "hidden" or (name == "style" and _NONE.search(m[2] or m[3] or m[4] or "")):
            return True
    return False


def _ended(tag: str, names: list[str]) -> int:
    """Place in names, open elements from the outermost, of the outermost one that the start
    of `tag` ends; len(names) if none."""
    at = n = len(names)
    if tag in _ENDS_P and names and names[-1] == "p":
        at = n - 1
    if tag in _PEERS:
        ends, stops = _PEERS[tag]
        for i in range(n - 1, -1, -1):
            if names[i] in ends:
                at = i
            elif names[i] in stops:
                break
    return at


def blocks(page: str) -> list[tuple[Block, str, float]]:
    """(block, text, share of link text) of each block with text."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int, int]] = []  # element, its box, cost of the path, article and how deep
    boxes = 0
    current = Block("", 0, 0)
    in_link = skip = at = 0
    skip_tag = ""
    inner: list[str] = []  # the hidden element and the blocks open in it
    n = len(page)

    def close(tag: str) -> None:
        nonlocal current
        if current.parts:
            out.append(current)
        current = Block(tag, *(stack[-1][1:] if stack else (0, 0, 0, 0)))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if skip and skip_tag == "head" and page[at:lt].strip():
            skip = 0
        if lt > at and not skip:
            text = page[at:lt]
            current.parts.append(text)
            if in_link and not text.isspace():
                current.links += len(text)
        if lt >= n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            nxt = page[lt + 1 : lt + 2]
            if nxt == "/" or nxt.isalpha():  # a broken tag: it ends at the next sign
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                if not skip:
                    current.parts.append("<")
                at = lt + 1
            continue
        at = m.end()
        tag, ending = m[1].lower(), page[lt + 1] == "/"
        if skip and inner:
            if ending:
                for i in range(len(inner) - 1, -1, -1):
                    if inner[i] == tag:
                        del inner[i:]
                        break
                else:
                    if tag not in _BLOCK or all(x[0] != tag for x in stack):
                        continue
                    inner = []  # the end of an element around it
                    skip = 0
                if inner:
                    continue
                if skip:
                    skip = 0
                    continue
            else:
                i = _ended(tag, inner)
                if i == len(inner) == 1 and (tag in _PEERS or (inner[0] not in _BLOCK and tag in _ENDS_P)):
                    # It may also end an element around the hidden one.
                    around = [x[0] for x in stack] + ([inner[0]] if inner[0] in _BLOCK else [])
                    i = 0 if _ended(tag, around) < len(stack) else i
                del inner[i:]
                if inner:
                    if tag in _RAW:
                        end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                        at = n if end is None else end.end()
                    elif (tag in _BLOCK or tag == skip_tag) and tag not in _VOID and not m[2].endswith("/"):
                        inner.append(tag)
                    continue
                skip = 0
        elif skip and skip_tag == "head":
            if ending:
                skip = 0 if tag in ("head", "body", "html") else 1
                continue
            if tag in _HEAD:
                if tag in _RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    at = n if end is None else end.end()
                continue
            skip = 0
        elif skip:
            if tag == skip_tag:
                skip += -1 if ending else (0 if m[2].endswith("/") else 1)
            continue
        if ending:
            if tag == "a":
                in_link = 0
            elif tag in _BLOCK:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                close("")
            continue
        if tag in _SKIP or (m[2] and tag not in ("html", "body") and _hidden(m[2])):
            if tag in _RAW:  # raw text: only its own end tag ends it
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = n if end is None else end.end()
            elif tag not in _VOID and not m[2].endswith("/"):
                skip, skip_tag = 1, tag
                inner = [] if tag in _SKIP else [tag]
            if tag in _BLOCK:
                close("")
            continue
        if tag == "br":
            current.parts.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in _BLOCK:
            if tag not in _VOID and not m[2].endswith("/"):
                if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                    stack.pop()  # these end with the next of their kind
                box, cost, article, depth = stack[-1][1:] if stack else (0, 0, 0, 0)
                if tag in _BOX:
                    boxes += 1
                    box = boxes
                    in_link = 0
                if tag in _BOX or tag == "title":
                    cost += _name_cost(tag, m[2])
                elif m[2]:
                    cost += _name_cost(tag, m[2])
                if tag in ("article", "main"):
                    article, depth = boxes, depth + (tag == "article")
                stack.append((tag, box, cost, article, depth))
            close(tag)
    close("")
    done = []
    for b in out:
        raw = "".join(b.parts)
        text = " ".join(_html.unescape(raw).split())
        if text:
            done.append((b, text, b.links / max(1, len(raw))))
    return done


def unary(tag: str, text: str, path_cost: int, link_share: float) -> int:
    """Log-odds that a block is content by its own text and containers, in hundredths."""
    size = text.count(" ") + 1
    cost = path_cost + min(size, 60) * 4 - 40
    if text[-1] in ".!?:;\"'”…)":
        cost += 40
    if link_share > 0.3:
        cost -= int(300 * link_share)
    if tag in _HEADING or tag in ("blockquote", "pre", "figcaption"):
        cost += 60
    if tag == "li" and size < 4:
        cost -= 60
    if size < 40 and _SIGN.search(text):
        cost += SIGN
    return cost


def scored(parts: list[tuple[Block, str, float]]) -> list[int]:
    """unary() of every block, and what its place among the others says."""
    scores = [unary(b.tag, text, b.path_cost, links) for b, text, links in parts]
    words, headed = {}, set()
    for (b, text, _), score in zip(parts, scores, strict=True):
        if score > 0 or not b.article:
            words[b.article] = words.get(b.article, 0) + text.count(" ") + 1
        if b.tag in _HEADING:
            headed.add(b.article)
    inside = {a: n for a, n in words.items() if a}
    if not inside:
        return scores
    largest = max(inside.values())
    # Articles with much less text than lies outside are teasers, above all without a heading.
    framed = sum(inside.values()) * (8 if headed & inside.keys() else 2) >= words.get(0, 0)
    for i, (b, _, _) in enumerate(parts):
        if not b.article:
            scores[i] += OUTSIDE * framed
        elif b.depth > 1:
            scores[i] += NESTED
        elif b.article not in headed and 2 * inside.get(b.article, 0) < largest:
            scores[i] += HEADLESS
    return scores


def min_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.  A positive score is the
    capacity from the source, a negative one that to the sink; edges (u, v, capacity)
    hold in both directions.  Dinic's algorithm, without recursion."""
    n = len(scores)
    s, t = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, c: int, back: int) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(c)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, x in enumerate(scores):
        if x > 0:
            add(s, i, x, 0)
        elif x < 0:
            add(i, t, -x, 0)
    for u, v, c in edges:
        add(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for u in queue:
            for e in out[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if not room[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(out[u]):
                path.append(e)
                u = to[e]
            elif path:
                e = path.pop()
                u = to[e ^ 1]
                at[u] += 1
            else:
                break


def neighbours(parts: list[tuple[Block, str, float]]) -> list[tuple[int, int, int]]:
    """Smoothness edges (block, block, capacity)."""
    edges, last = [], {}
    for i, (b, _, _) in enumerate(parts):
        if i:
            alike = abs(parts[i - 1][0].path_cost - b.path_cost) < 200 and parts[i - 1][0].article == b.article
            edges.append((i - 1, i, ADJACENT if alike else ADJACENT // 8))
        if b.box in last:
            edges.append((last[b.box], i, SAME_BOX))
        last[b.box] = i
    return edges


def extract(page: str | None) -> str:
    """The main text of a page."""
    parts = blocks(page) if page else []
    if not parts:
        return ""
    kept = min_cut(scored(parts), neighbours(parts))
    return "\n\n".join(text for (_, text, _), keep in zip(parts, kept, strict=True) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """The operator: (page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in C.chunks(batches, "html"):
            texts = [extract(x) for x in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    C.tune(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(C.read(spark, sf_dir, "pages"))
