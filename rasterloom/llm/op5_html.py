"""Main-text extraction from HTML by tag-path ratios.

A page becomes a sequence of text blocks, each with its path of block tags from the root (classes and ids take part). For
each path the text length per block, its spread, the punctuation per block and its spread are aggregated and fused into
one score, the scores of the block sequence are smoothed by a Gaussian, and a two-class split of the paths' mean smoothed
scores (largest variance between classes, a path counts once for each block) parts content from the rest. A page whose
classes lie close to each other, or whose lower class holds most of the text, isn't split. A heading directly before
content is content. Links count against a block. Nothing of a marked article goes by its score, and nothing that shares a
container with selected text. Elements and classes that never are the article (menus, headers and
footers of the page, sidebars, notices, adverts, forms, comments, hidden parts), and what lies outside a marked article, are
a prior against blocks that the score has selected.

Edge cases: null, empty and text-free pages give an empty text; markup that is never closed runs to the end; unknown
character references stay as they are; blocks come in page order whatever their depth; very long pages are taken whole;
repeated rows give equal rows; an empty table gives an empty result; other columns of the input take no part.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Share of the upper class's mean below which a lower class's lies if it goes; width of the smoothing.
APART, SIGMA = 0.55, 1.0
LINK_SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements that never hold the article.
OUTSIDE = frozenset("nav footer aside menu dialog button select fieldset head".split()) | RAW
#: Elements that hold blocks of one kind or other together.
CONTAINERS = frozenset("div section article main".split())
#: Class or id words that mark what surrounds an article, words that may stand beside them, words of readers' own texts.
AROUND = re.compile(r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|respond|cookies?|consent|disqus|footer|header|masthead|menu|nav\w*|newsletter|notice\w*|pager|pagination|popup|promo\w*|related|rail|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widgets?|alert|login|signup|search|skip)", re.I)
BESIDE = frozenset("area bar block box container inner list section site slot unit wrap wrapper".split())
READERS = frozenset("comment comments commentlist respond disqus replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
ARTICLE = frozenset(["article", "main"])
_HEADING = re.compile(r"/h[1-6](?:\.[^/]*)?$")
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?P<raw>script|style|noscript|template|iframe|object|svg|math|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.I | re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


class Block:
    __slots__ = ("path", "text", "linked", "outside", "article", "wraps")

    def __init__(self, path: str, text: str, linked: int, outside: bool, article: bool, wraps: tuple[Node, ...] = ()):
        self.path, self.text, self.linked, self.outside, self.article, self.wraps = path, text, linked, outside, article, wraps


class Node:
    __slots__ = ("tag", "path", "outside", "article", "wraps", "readers")

    def __init__(self, tag: str, path: str, outside: bool, article: bool):
        self.tag, self.path, self.outside, self.article = tag, path, outside, article
        self.wraps: tuple[Node, ...] = ()  # elements around the node whose class or id marks surroundings
        self.readers = False


def around(value: str) -> set[str]:
    """The words of whole classes or ids that mark surroundings: has-sidebar or entry-header is none, cookie-notice is."""
    out: set[str] = set()
    for name in value.lower().split():
        parts = [w for w in re.split(r"[_-]+", name) if w and w not in BESIDE]
        if all(map(AROUND.fullmatch, parts)):
            out.update(parts)
    return out


def entered(parent: Node, tag: str, attrs: str) -> Node:
    """The node of an opening block tag."""
    words: set[str] = set()
    outside, name, article = parent.outside or tag in OUTSIDE, tag, parent.article or tag in ARTICLE
    if tag == "header" and not parent.article:
        outside = True
    if attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                name += "." + value
                if tag not in ("body", "html", "article", "main"):
                    words |= around(value)
            elif key == "role":
                outside = outside or value.lower() in ROLES
                article = article or value.lower() in ARTICLE
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                outside = True
    node = Node(tag, f"{parent.path}/{name}", outside, article)
    if parent.article:
        words.discard("header")
    node.readers = not words.isdisjoint(READERS)
    # a form around most of the page is a frame of it, and no form
    node.wraps = (*parent.wraps, node) if words or tag == "form" else parent.wraps
    return node


def unwrapped(found: list[Block]) -> None:
    """Puts blocks outside that marked elements hold, unless such an element wraps most of the text or of the article."""
    inside = [b for b in found if not b.outside]
    marked = [b for b in inside if b.article]
    total = sum(len(b.text) for b in marked or inside)
    held: dict[Node, int] = {}
    for b in marked or inside:
        for w in b.wraps:
            if b.path != w.path:
                held[w] = held.get(w, 0) + len(b.text)
    for b in inside:
        b.outside = any(w.readers or 2 * held.get(w, 0) <= total for w in b.wraps)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    root = Node("", "", False, False)
    stack, out, held, linked = [root], [], [], 0
    link = 0  # depth of the open link, which may hold blocks; it ends with the element around it

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                node = stack[-1]
                out.append(Block(node.path, text, linked, node.outside, node.article, node.wraps))
            held.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                link = 0 if m["end"] else len(stack)
            continue
        flush()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            link = link if link <= len(stack) else 0
            continue
        if tag in VOID:
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
            stack.pop()
        link = link if link <= len(stack) else 0
        node = entered(stack[-1], tag, m["attrs"] or "")
        if not (m["attrs"] or "").endswith("/"):
            stack.append(node)
    if at < len(page):
        held.append(page[at:])
    flush()
    unwrapped(out)
    return out


def path_scores(found: list[Block]) -> dict[str, float]:
    """Fused ratio of each path: text length per block and punctuation per block, each times its spread."""
    by: dict[str, list[tuple[int, int]]] = {}
    for b in found:
        n = max(len(b.text) - b.linked, 0)
        by.setdefault(b.path, []).append((n, len(_PUNCTUATION.findall(b.text))))
    out = {}
    for path, values in by.items():
        k = len(values)
        length, marks = sum(n for n, _ in values) / k, sum(p for _, p in values) / k
        spread = math.sqrt(sum((n - length) ** 2 for n, _ in values) / k)
        spread_marks = math.sqrt(sum((p - marks) ** 2 for _, p in values) / k)
        out[path] = math.log1p(length * (1 + marks)) + 0.5 * math.log1p(spread * (1 + spread_marks))
    return out


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    taps = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, t in zip(range(-reach, reach + 1), taps):
            if 0 <= i + d < len(values):
                total += t * values[i + d]
                weight += t
        out.append(total / weight)
    return out


def threshold(scores: list[float], weights: list[int]) -> float:
    """The smallest score of the upper class, or 0 if the scores are of one class. ``weights``: unlinked text."""
    order = sorted(zip(scores, weights))
    total, text, low, low_text, best, out = sum(scores), sum(weights), 0.0, 0, 0.0, 0.0
    for i in range(1, len(order)):
        low, low_text = low + order[i - 1][0], low_text + order[i - 1][1]
        if order[i][0] - order[i - 1][0] > 1e-9:
            under, over = low / i, (total - low) / (len(order) - i)
            if (between := i * (len(order) - i) * (over - under) ** 2) > best:
                best, out = between, order[i][0] if under < APART * over and 2 * low_text < text else 0.0
    return out


def fused(found: list[Block]) -> list[float]:
    """Each block's score: the mean, over its path's blocks, of the smoothed scores of paths."""
    own = path_scores(found)
    flow: dict[str, list[float]] = {}
    for b, v in zip(found, smoothed([own[b.path] for b in found])):
        flow.setdefault(b.path, []).append(v)
    return [sum(flow[b.path]) / len(flow[b.path]) for b in found]


def selected(found: list[Block]) -> list[bool]:
    """Which blocks the score selects."""
    score = fused(found)
    limit = threshold(score, [max(len(b.text) - b.linked, 0) for b in found])
    return [v >= limit for v in score]


def container(path: str) -> str:
    """The path down to the nearest element that holds blocks together; empty where the page alone does."""
    parts = path.split("/")
    for k in range(len(parts) - 1, 0, -1):
        if parts[k].partition(".")[0] in CONTAINERS:
            return "/".join(parts[: k + 1])
    return ""


def judged(page: str | None) -> list[tuple[Block, str]]:
    """Every block of the page with the reason why it goes: "score", "marks" or "links"; "" for content.

    The score selects among all blocks of the page first. Marks (elements, classes and roles that surround articles, and
    what lies outside a marked article) are a prior against blocks that it has selected, and give the others, which no
    mark tells apart, a selection among themselves. Inside a marked article the score has nothing to part: its lists,
    headings and links belong to it. Elsewhere it decides between containers: what shares one with selected text stays,
    but for blocks that are links.
    """
    found = blocks(page or "")
    article = any(b.article and not b.outside for b in found)
    marked = [b.outside or (article and not b.article) for b in found]
    plain = [b for b, m in zip(found, marked) if not m]
    reason = ["marks" if m else "" for m in marked]
    for i, chosen in enumerate(selected(found)):
        if marked[i] and not chosen:
            reason[i] = "score"
    free = [b.linked < LINK_SHARE * max(len(b.text), 1) for b in plain]
    kept = [chosen and f for chosen, f in zip(selected(plain), free)]
    holds = {container(b.path) for b, k in zip(plain, kept) if k} - {""}
    kept = [article or k or (f and container(b.path) in holds) for b, k, f in zip(plain, kept, free)]
    for i in range(len(plain) - 2, -1, -1):
        kept[i] = kept[i] or (free[i] and kept[i + 1] and _HEADING.search(plain[i].path) is not None)
    places = [i for i, m in enumerate(marked) if not m]
    for i, k, f in zip(places, kept, free):
        reason[i] = "" if k else "score" if f else "links"
    return list(zip(found, reason))


def content_blocks(page: str | None) -> list[Block]:
    return [b for b, reason in judged(page) if not reason]


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in content_blocks(page))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, main text, its length in code points. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(run, SCHEMA)
