"""Main text of web pages by tag-path ratios.

Every text block of a page has a tag path, from the root to the block element. Per path the text length and the
number of punctuation marks are added up and divided by the number of nodes with that path. Text ratio and
punctuation ratio are fused by their geometric mean, smoothed along the page, weighted down by the share of link text,
and compared with a threshold made of the page's own mean and deviation. Blocks over it are content nodes; the element
that holds all of them is the article, and all blocks in it are kept, apart from parts that are marked as
something else (menus, forms, adverts, comments, ...). Where only the body holds them all, the stretch of the page
from the first to the last of them is kept, with the text elements next to it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import table
from wardline.llm.shingles import slices

#: Share of the deviation added to the mean, and smoothing weights of a block's neighbours.
LAMBDA = 0.0
SMOOTH = (0.15, 0.7, 0.15)
#: Share of the page's text from which on articles outside all marks are taken to be the page's article.
FREE = 0.2

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q ruby rt rp "
    "s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split())
SELF_NESTING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
                "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
SKIPPED = frozenset("nav footer aside form button dialog menu search fieldset".split())
NEVER_WHOLE = SKIPPED - {"form", "fieldset"}
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notification pager pagination "
    "popup promo promoted promotion recommended related respond responses reply replies rss share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar topbar widget".split())

# Elements that are parts of a text, never its whole.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = HEADINGS | INLINE | frozenset(
    "p pre blockquote ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption hgroup details summary".split())
BODY = ("", "html", "body")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|<(?=[a-zA-Z/!?])", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。、，！？；：]")


class Node:
    __slots__ = ("tag", "path", "marked", "worded", "skipped", "parent", "link", "size")

    def __init__(self, tag: str, parent: "Node | None", marked: bool, worded: bool = False, paths: "dict[tuple[int, str], int] | None" = None):
        self.tag, self.parent = tag, parent
        #: The page's number of the tag path; ``paths`` numbers pairs of the parent's path and a tag.
        self.path = 0 if parent is None else parent.path if tag in INLINE else paths.setdefault((parent.path, tag), len(paths) + 1)
        #: The element's own marks; whether they leave it out is known at the page's end.
        self.marked, self.worded, self.skipped = marked, worded, False
        self.link = tag == "a" or (parent is not None and parent.link)
        self.size = 0  # characters of text right in the element


class Block:
    __slots__ = ("node", "parts")

    def __init__(self, node: Node):
        self.node, self.parts = node, []

    def kept(self) -> tuple[str, int]:
        """The text outside skipped elements, and how much of it is links."""
        parts = [(node, text) for node, text in self.parts if not node.skipped]
        return "".join(text for _, text in parts), sum(len(text) for node, text in parts if node.link)


def marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether the element is marked as something other than the article; ``inside``: it stands in an article or main."""
    if tag in SKIPPED or (tag == "header" and not inside):
        return True
    return tag not in ("html", "body", "article", "main") and worded(attributes)


def worded(attributes: str) -> bool:
    """Whether the attributes mark their element as something other than the article."""
    if not attributes:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()
            if SKIPPED_WORDS.intersection(_WORD.findall(spaced)):
                return True
        elif name == "role" and value in SKIPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, by the tag rules that matter for text: implied ends, raw text, unclosed elements."""
    root = Node("", None, False)
    nodes, stack, out, block, at, size = [root], [root], [], None, 0, len(page)
    inside, paths = 0, {}

    def close(k: int) -> None:
        nonlocal inside
        inside -= sum(n.tag in ("article", "main") for n in stack[k:])
        del stack[k:]

    def take(text: str) -> None:
        nonlocal block
        node = stack[-1]
        if not text:
            return
        holder = node
        while holder.tag in INLINE and holder.parent is not None:
            holder = holder.parent
        if block is None or block.node is not holder:
            if not text.strip():
                return
            block = Block(holder)
            out.append(block)
        block.parts.append((node, text))
        node.size += len(text.strip())

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<":  # a tag that never ends: the rest is no text
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k]
                        nodes += _relink(stack, k)
                        break
                    if stack[k].tag not in INLINE:
                        break
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                block = None
            continue
        if tag == "br":
            take(" ")
            continue
        if tag in RAW and not m[4]:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = size if end is None else end.start()
            if end is not None:
                stop = page.find(">", at)
                at = size if stop < 0 else stop + 1
            continue
        if tag in VOID or (m[4] and tag not in INLINE):
            if tag not in INLINE:
                block = None
            continue
        if tag not in INLINE:
            block = None
            if tag in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
            ends, stops = SELF_NESTING.get(tag, ()), STOPS.get(tag, ("table",))
            if ends:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        close(k)
                    elif stack[k].tag in stops:
                        break
        elif tag == "a":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "a":
                    del stack[k]
                    nodes += _relink(stack, k)
                    break
                if stack[k].tag not in INLINE:
                    break
        whole = tag in ("article", "main")
        node = Node(tag, stack[-1], marked(tag, m[3], inside > 0), whole and worded(m[3]), paths)
        nodes.append(node)
        stack.append(node)
        inside += whole
    _skip(nodes)
    return out


def _relink(stack: list[Node], k: int) -> list[Node]:
    """Rebuild the inline elements above a closed one."""
    for i in range(k, len(stack)):
        stack[i] = Node(stack[i].tag, stack[i - 1], stack[i].marked)
    return stack[k:]


def _skip(nodes: list[Node]) -> None:
    """Settle which elements are left out; ``nodes`` has each after the one around it.

    A mark does not hold for an element around an article or main, unless the articles outside all marks hold more
    text (then it is one of comments or teasers; an article with marks of its own is one too). Nor does it hold
    for an element with most of the page's text, unless it is of a kind that never holds an article or
    the articles outside all marks have a share. If nothing were left, words in class and id hold for no element.
    """
    if not any(node.marked for node in nodes):
        return
    text = {node: node.size for node in nodes}
    for node in reversed(nodes):
        if node.parent is not None:
            text[node.parent] += text[node]
    within, under, free = {None: False}, {None: False}, 0
    articles = dict.fromkeys(nodes, 0)
    for node in nodes:
        whole = node.tag in ("article", "main") and not node.worded
        within[node] = within[node.parent] or whole
        under[node] = under[node.parent] or node.marked
        if within[node] and not under[node]:
            free += node.size
    for node in reversed(nodes):
        if node.tag in ("article", "main") and not node.worded:
            articles[node] = text[node]
        if node.parent is not None:
            articles[node.parent] += articles[node]

    def holds(node: Node) -> bool:
        if not node.marked or 0 < articles[node] >= free:
            return False
        return node.tag in NEVER_WHOLE or 2 * text[node] <= text[nodes[0]] or free >= FREE * text[nodes[0]]

    def settle(kinds_only: bool) -> bool:
        left = False
        for node in nodes:
            own = holds(node) and not (kinds_only and node.tag not in SKIPPED)
            node.skipped = own or (node.parent is not None and node.parent.skipped)
            left |= node.size > 0 and not node.skipped
        return left

    if not settle(False):
        settle(True)


def extract(page: str | None) -> str:
    """The article's blocks, one per line; empty if there is none."""
    found, linked = [], []
    for block in blocks_of(page or ""):
        text, links = block.kept()
        text = " ".join(html.unescape(text).split())
        if text:
            found.append((block, text))
            linked.append(min(links, len(text)))
    if not found:
        return ""
    ratio: dict[int, list[float]] = {}
    for (block, text), links in zip(found, linked):
        sums = ratio.setdefault(block.node.path, [0.0, 0.0, 0.0, 0.0])
        for k, v in enumerate((1, len(text), len(_PUNCTUATION.findall(text)), links)):
            sums[k] += v
    fused = np.empty(len(found))
    for i, (block, _) in enumerate(found):
        n, chars, marks, links = ratio[block.node.path]
        fused[i] = math.sqrt(chars / n * (1 + marks / n)) * (1 - links / chars)
    padded = np.pad(fused, 1, mode="edge")
    smooth = SMOOTH[0] * padded[:-2] + SMOOTH[1] * padded[1:-1] + SMOOTH[2] * padded[2:]
    content = smooth >= min(smooth.mean() + LAMBDA * smooth.std(), smooth.max())
    nodes = [block.node for block, _ in found]
    places = np.flatnonzero(content)
    article = _article([nodes[k] for k in places])
    if article.tag not in BODY:
        return "\n".join(text for (block, text) in found if _within(block.node, article))
    mostly_links = [2 * links > len(text) for (_, text), links in zip(found, linked)]
    first, last = _stretch(nodes, places, mostly_links)
    return "\n".join(text for _, text in found[first : last + 1])


def _above(node: Node | None) -> Iterator[Node]:
    """The element and those around it, from the inside out."""
    while node is not None:
        yield node
        node = node.parent


def _within(node: Node, article: Node) -> bool:
    return any(n is article for n in _above(node))


def _article(content: list[Node]) -> Node:
    """The outermost article or main that holds all content nodes, else the innermost element that does and is no part of a text."""
    common = list(_above(content[0]))
    for other in dict.fromkeys(content):
        around = set(_above(other))
        common = [n for n in common if n in around]
    whole = [n for n in common if n.tag in ("article", "main")]
    if whole:
        return whole[-1]
    kinds = [n for n in common if n.tag not in TEXT]
    # A section is one of several where something other than the body is around it.
    while kinds[0].tag == "section" and kinds[1].tag not in BODY:
        del kinds[0]
    return kinds[0]


def _stretch(nodes: list[Node], places: np.ndarray, mostly_links: list[bool]) -> tuple[int, int]:
    """First and last block of the text where only the body holds all content nodes.

    From the first to the last content node, with the whole of each article or main that has one. From there on outwards
    to the furthest block that is on a content node's path or in text elements alone, or, before the
    text, a heading, as far as no block of mostly links comes between.
    """
    whole = {n for k in places for n in _above(nodes[k]) if n.tag in ("article", "main")}
    inside = [k for k, node in enumerate(nodes) if whole and any(n in whole for n in _above(node))]
    first, last = min([places[0], *inside[:1]]), max([places[-1], *inside[-1:]])
    paths = {nodes[k].path for k in places}

    def belongs(node: Node) -> bool:
        return node.path in paths or all(n.tag in TEXT or n.tag in BODY for n in _above(node))

    for k in range(first - 1, -1, -1):
        if mostly_links[k]:
            break
        if nodes[k].tag in HEADINGS or belongs(nodes[k]):
            first = k
    for k in range(last + 1, len(nodes)):
        if mostly_links[k]:
            break
        if belongs(nodes[k]):
            last = k
    return first, last


def texts(pages: DataFrame, column: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All columns of pages, with the main text of the whole html and its number of code points added.

    Null and empty html, and a page without article text, give the empty text and 0. Repeated rows get
    equal answers; columns of pages named like the added ones are replaced. A page is one unit of work: memory holds one page's blocks at a time.
    """
    pages = pages.drop(*({text, n_chars} - {column}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for i, j in slices(batch.column(at), 1 << 23):
                found = [extract(page) for page in batch.column(at).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in batch.columns), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    [*batch.schema.names, text, n_chars])

    return pages.mapInArrow(run, pages.select("*", F.lit("").alias(text), F.lit(0).cast("bigint").alias(n_chars)).schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return texts(pages).select("page_id", "url", "text", "n_chars")
