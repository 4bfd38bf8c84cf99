"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is no text.
_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _RAW}
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
# The end of a tag, or its next attribute. A quote that never closes is a character like others.
_ATTR = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)|(?=>)))?)")
_READ = frozenset("class id role itemprop hidden style aria-hidden".split())

# Fixed values of HTML: elements without content, blocks, and blocks that end an open one.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Elements and names that hold no main text.
_DROP = frozenset("nav aside footer form button input label fieldset dialog menu head audio video applet".split())
_DROP_ROLE = frozenset("navigation banner complementary contentinfo search menu menubar toolbar dialog alert alertdialog form".split())
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?<!has[-_])(?<!no[-_])(?<!with[-_])(?:ads?|adverts?|advertisements?|advertising|adsense|banners?|sponsor(?:ed|s)?|promos?|promoted|"
    r"comments?|commentlist|disqus|respond|replies|reply|sidebars?|aside|nav|navbar|navigation|menus?|breadcrumbs?|footers?|cookies?|consent|gdpr|"
    r"notices?|notifications?|alerts?|popups?|modals?|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|"
    r"recommended|recommendations|widgets?|toolbar|pagination|pager|paging|outbrain|taboola)(?=$|[\s_-])(?![_-](?:open|closed|enabled|disabled|on|off)\b)",
    re.I,
)
# Names that are telling only where none speaks for the main text.
_DOUBTFUL_NAME = re.compile(r"(?:^|[\s_-])(?:side|foot|headers?|masthead|topbar|search|forms?|skip|disclaimer|copyright|tags)(?=$|[\s_-])", re.I)
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|blog|hentry)(?=$|[\s_-])", re.I)
_MAIN_ROLE = frozenset(["main", "article"])
# A row or a list is kept with all of its table or list.
_PARTS = frozenset("tr tbody thead tfoot td th li dt dd".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())

MIN_SCORED = 25
SIBLING_SHARE = 0.2
SIBLING_LEAST = 10.0
CHARS_PER_POINT = 100
MAX_LENGTH_POINTS = 3
PASSED_ON = 0.5
_NAME_POINTS = {"div": 5, "article": 10, "main": 10, "section": 5, "td": 3, "blockquote": 3}
_PASSES = frozenset(["p", "pre", "blockquote", "li", "td", "dd"])


@dataclass(eq=False, slots=True)
class Node:
    name: str
    parent: Node | None
    dropped: bool = False
    skipped: bool = False
    doubtful: bool = False
    main: bool = False
    inside_main: bool = False
    bias: float = 0.0
    score: float = 0.0
    scored: bool = False
    kept: bool = False
    chars: int = 0
    link_chars: int = 0


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    link_chars: int
    dropped: bool


def _open(name: str, attrs: dict[str, str], parent: Node) -> Node:
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    role = attrs.get("role", "").lower()
    named = bool(names.strip())
    good = named and bool(_GOOD_NAME.search(names))
    bad = named and (bool(_BAD_NAME.search(names)) or not good and bool(_DOUBTFUL_NAME.search(names)))
    block = name in _BLOCK
    node = Node(name, parent)
    node.main = name in ("article", "main") or role in _MAIN_ROLE or attrs.get("itemprop", "").lower() == "articlebody"
    node.inside_main = parent.main or parent.inside_main
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    dropped = (
        name in _DROP
        or role in _DROP_ROLE
        or hidden
        # A page's header goes, an article's own heading stays.
        or (name == "header" and not node.inside_main)
        # A telling name does not drop the page itself or a heading.
        or (bad and block and name not in ("html", "body") and name not in _HEADING)
    )
    node.dropped = parent.dropped or dropped
    # What goes inside a line leaves the text around it in one block.
    node.skipped = parent.skipped or (dropped and not block and not parent.dropped)
    # An inline element with a telling name goes only with a block that has nothing else.
    node.doubtful = parent.doubtful or (bad and not block)
    node.bias = 25.0 * good - 25.0 * bad
    return node


def _decode(text: str) -> str:
    """Character references, and white space as one space."""
    if "&" in text:
        # The commonest reference alone needs no look-up.
        plain = text.count("&") == text.count("&amp;")
        text = text.replace("&amp;", "&") if plain else html.unescape(text)
    return " ".join(text.split())


def tokens(page: str) -> Iterator[tuple[str, str, str, dict[str, str]]]:
    """``text, close, name, attributes``: each tag with the text before it; the last one has no name.

    One forward pass. Comments, declarations and elements whose content is no text are left out.
    The first of equal attributes counts. What the page's end cuts off is left out; if a quote
    hides the end of a tag up to there, this and all later tags end at the next ``>``.
    """
    last = at = 0
    last_end = page.rfind(">")
    loose = False
    # A pass joins text over comments, so that they do not break a word.
    before: list[str] = []
    while (at := page.find("<", at)) >= 0:
        following = page[at + 1 : at + 2]
        if following in ("!", "?") or (following == "/" and not page[at + 2 : at + 3].isalpha()):
            before.append(page[last:at])
            mark = "-->" if page.startswith("<!--", at) else ">"
            stop = page.find(mark, at + 2)
            last = at = len(page) if stop < 0 else stop + len(mark)
            continue
        tag = _NAME.match(page, at)
        if tag is None:
            at += 1
            continue
        before.append(page[last:at])
        if at > last_end:
            last = len(page)
            break
        name, attrs = tag[2].lower(), {}
        end, empty = tag.end(), False
        while not loose:
            part = _ATTR.match(page, end)
            if part is None:
                loose = True
                break
            end = part.end()
            if part[1]:
                empty = page[end - 2] == "/"
                break
            if (key := part[2].lower()) in _READ and key not in attrs:
                value = part[3] or part[4] or part[5] or ""
                attrs[key] = html.unescape(value) if "&" in value else value
        else:
            part = None
        if part is None:
            end, attrs = page.find(">", tag.end()) + 1, {}
        if name in _RAW and not tag[1] and not (empty and name in ("svg", "math")):
            found = _RAW_END[name].search(page, end)
            stop = page.find(">", found.end()) if found else -1
            last = at = len(page) if stop < 0 else stop + 1
            continue
        last = at = end
        if name in _RAW:
            continue
        yield "".join(before), tag[1], name, attrs
        before = []
    before.append(page[last:])
    yield "".join(before), "", "", {}


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The elements, parents first, and in page order the texts of the blocks.

    A block is the text between two block tags. Unclosed elements end where HTML says so; a
    closing tag without its opening one is ignored. Open elements are found by name, so the cost
    follows the length of the page, not its depth.
    """
    root = Node("#root", None)
    nodes = [root]
    stack = [root]
    # Places of open elements by name, and of open blocks.
    places: dict[str, list[int]] = {}
    open_blocks = [0]
    blocks: list[Block] = []
    depth_links = 0
    parts: list[str] = []
    link_parts: list[str] = []
    sure = False

    def flush() -> None:
        nonlocal parts, link_parts, sure
        if parts:
            text = _decode("".join(parts))
            if text:
                links = len(_decode("".join(link_parts))) if link_parts else 0
                at, holder = stack[-1], stack[open_blocks[-1]]
                blocks.append(Block(at if at.dropped else holder, text, links, not sure or holder.dropped))
            parts, link_parts, sure = [], [], False

    def leave(place: int) -> None:
        """Close the innermost elements down to ``place``."""
        nonlocal depth_links
        while len(stack) > place:
            node = stack.pop()
            places[node.name].pop()
            if node.name in _BLOCK:
                open_blocks.pop()
            depth_links -= node.name == "a"

    def place_of(names: set[str] | frozenset[str]) -> int:
        """The innermost open element with one of the names; 0 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    for text, close, name, attrs in tokens(page):
        at = stack[-1]
        if text and not at.skipped:
            parts.append(text)
            sure = sure or not (at.doubtful or text.isspace())
            if depth_links:
                link_parts.append(text)
        if not name:
            break
        if name == "br":
            if not at.skipped:
                parts.append(" ")
            continue
        block = name in _BLOCK
        if close:
            place = place_of({name})
            # An inline end tag does not close a block.
            if block or place > open_blocks[-1]:
                if block:
                    flush()
                if place:
                    leave(place)
            continue
        if name in _ENDS_P and (place := place_of({"p"})) > place_of({"td", "th", "button", "table"}):
            flush()
            leave(place)
        if name in _SAME:
            same, stop = _SAME[name]
            if (place := place_of(same)) > place_of(stop):
                # A row ends the open row with the open cells in it.
                if name == "tr":
                    while stack[place].name != "tr" and stack[place - 1].name in ("tr", "td", "th"):
                        place -= 1
                flush()
                leave(place)
        if block:
            flush()
        if name in _VOID:
            continue
        if name == "a" and (place := place_of({"a"})) > open_blocks[-1]:
            # A link in a link ends the outer one, whose other elements stay open.
            stack[place].name = "span"
            places["a"].pop()
            insort(places.setdefault("span", []), place)
            depth_links -= 1
        node = _open(name, attrs, stack[-1])
        nodes.append(node)
        places.setdefault(name, []).append(len(stack))
        if block:
            open_blocks.append(len(stack))
        stack.append(node)
        depth_links += name == "a"
    flush()
    return nodes, blocks


def points(block: Block) -> float:
    """1, a point for each comma and for each 100 characters up to 3, less the share of link text."""
    chars = len(block.text)
    commas = block.text.count(",") + block.text.count("、")
    return (1 + commas + min(chars // CHARS_PER_POINT, MAX_LENGTH_POINTS)) * (1 - min(1.0, block.link_chars / chars))


def _score(nodes: list[Node], blocks: list[Block], least: int) -> list[Node]:
    """Pass the points of blocks of ``least`` characters up the tree, children first; the scored nodes."""
    for block in blocks:
        if len(block.text) >= least:
            # A paragraph's own element passes everything on; a bare block keeps its text itself.
            holder = block.node.parent if block.node.name in _PASSES and block.node.parent else block.node
            holder.score += points(block)
            holder.scored = True
    for node in reversed(nodes):
        if node.scored and node.parent is not None:
            node.parent.score += node.score * PASSED_ON
            node.parent.scored = True
    scored = [n for n in nodes if n.scored]
    for node in scored:
        node.score += node.bias + _NAME_POINTS.get(node.name, 0)
        node.score *= 1 - min(1.0, node.link_chars / max(1, node.chars))
    return scored


def main_text(page: str) -> str:
    """The main text, its blocks in page order joined by one space; '' if there is none.

    Each block of text passes points for its length and commas, discounted by its share of link
    text, to its ancestors: whole to the nearest, half as many to each further one. The
    ancestor with the most points, itself discounted by link density, is the container; an
    article or main element around it takes its place. Its siblings are kept from a fifth of its
    score, and beside a container that is no article as paragraphs of running text.
    """
    nodes, blocks = parse(page)
    blocks = [b for b in blocks if not b.dropped]
    if not blocks:
        return ""
    for block in blocks:
        block.node.chars += len(block.text)
        block.node.link_chars += block.link_chars
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    scored = _score(nodes, blocks, MIN_SCORED) or _score(nodes, blocks, 1)
    best = max(scored, key=lambda n: n.score)
    least = max(SIBLING_LEAST, SIBLING_SHARE * best.score)
    while best.name in _PARTS and best.parent is not None:
        best = best.parent
    # The outermost article, so that sections marked as articles stay together, unless several
    # stand side by side in a main element.
    outer, article = best, None
    while outer is not None:
        if outer.main and (article is None or article.chars >= 0.5 * outer.chars):
            article = outer
        outer = outer.parent
    best = article or best
    best.kept = True
    for sibling in nodes:
        if best.parent is None or sibling.parent is not best.parent or not sibling.chars:
            continue
        density = sibling.link_chars / sibling.chars
        running = sibling.name == "p" and (sibling.chars > 80 and density < 0.25)
        heading = sibling.name in ("h1", "h2", "h3") and density < 0.25
        if (sibling.scored and sibling.score >= least) or (article is None and (running or heading)):
            sibling.kept = True
    for node in nodes:
        node.kept = node.kept or (node.parent is not None and node.parent.kept)
    return " ".join(b.text for b in blocks if b.node.kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every row.

    Null, empty and blank pages, and pages of boilerplate only, have the text ''. Repeated rows
    and null ids and URLs are kept; an empty table gives no rows. Very long and badly formed pages
    take time and memory in proportion to their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "") for p in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op2_html(spark, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
