"""Main text of web pages by composite text density.

Every element has a number of characters, of tags, and of characters and tags
inside links. Its composite density is characters per tag, weighted down by the
share of links against the page's average. The element whose children's densities
sum up highest holds the article. The least density on the path from the body to it
is the threshold: what hangs on this path and is as dense belongs to the article too.
So does what stands next to that element, or with it inside an article element, and
headings along the path, however sparse, unless most of it is links.
Elements that are no part of an article by their kind (menus, scripts, forms and
the like) count for nothing. Names in class, id and role only raise a suspicion: a
suspected element counts for nothing where the page has text elsewhere, but is let off
where it (or all elements suspected for the same words) holds most of the page's plain
text, as a wrapper named after its layout does. Reader comments, adverts and sign-up
boxes are never let off. The work grows with the length of a page, however deep it nests.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .texts import slices, strings

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))""",
    re.S,
)
HINT = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s=/>])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORD = re.compile(r"[a-z]+")

# Element names of HTML by what they mean here.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set(
    "script style noscript template head title nav footer aside form button select option textarea input label "
    "iframe object svg canvas audio video dialog menu fieldset map".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# What an opening tag ends: the outermost of `closes` below the nearest of `limits`.
SCOPES = [({"p"}, {"button", "table", "td", "th", "li"}), *({id(v): v for v in SIBLINGS.values()}.values())]
SCOPE_OF = {t: SCOPES.index(v) for t, v in SIBLINGS.items()} | dict.fromkeys(CLOSES_P, 0)
SCOPED = set().union(*(closes | limits for closes, limits in SCOPES))
# Words in class, id and role that name what is mostly no article.
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs toolbar tabs pager "
    "pagination footer masthead topbar share sharing social related recommended recommendations trending "
    "comment comments disqus replies respond reply discussion complementary contentinfo search".split()
)
# Those of them that name it even where nothing else on the page has text.
CERTAIN = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe "
    "subscription signup login paywall comment comments disqus replies respond".split()
)
# Words that turn a name into a layout's state, as in has-sidebar or comments-open.
STATES = set("has no with without enabled disabled open closed".split())
OUTWEIGHS = 2  # times the plain text elsewhere that suspected elements must hold to be let off
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}


class Node:
    __slots__ = (
        "tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "dead", "begin", "end", "density",
        "names", "article", "link", "scope", "plain",
    )

    def __init__(self, tag: str, parent: Node | None, attributes: str, begin: int):
        self.tag, self.parent, self.begin, self.end = tag, parent, begin, begin
        self.children: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.plain = 0
        self.density = 0.0
        if parent is None:
            self.dead = self.article = self.link = False
            self.names, self.scope = NO_NAMES, (None,) * len(SCOPES)
            return
        parent.children.append(self)
        self.article = parent.article or tag in ARTICLE
        self.link = parent.link or tag == "a"
        self.dead = parent.dead or is_apart(tag, attributes, parent.article)
        self.names = NO_NAMES if self.dead else suspicions(tag, attributes)
        self.scope = parent.scope
        if tag in SCOPED:
            self.scope = tuple(
                None if tag in limits else above or (self if tag in closes else None)
                for above, (closes, limits) in zip(parent.scope, SCOPES, strict=True)
            )


NO_NAMES: frozenset[str] = frozenset()


def is_apart(tag: str, attributes: str, inside_article: bool) -> bool:
    """No part of an article by its kind, or not shown."""
    if tag in NEVER or (tag == "header" and not inside_article):
        return True
    return tag not in {"html", "body", *ARTICLE} and len(attributes) > 5 and bool(HIDDEN.search(attributes))


def suspicions(tag: str, attributes: str) -> frozenset[str]:
    """The words for boilerplate in an element's names."""
    if len(attributes) < 6 or tag in {"html", "body", *ARTICLE}:
        return NO_NAMES
    found: set[str] = set()
    for hint in HINT.finditer(attributes):
        for name in (hint[1] or hint[2] or hint[3] or "").lower().split():
            words = set(WORD.findall(name))
            if not words & STATES:
                found |= words & BOILERPLATE
    return frozenset(found)


def parse(page: str) -> tuple[Node, list[list[tuple[int, str]]]]:
    """The page's elements, and its blocks of text as numbered pieces. A node has the
    pieces from `begin` up to `end`."""
    root = Node("html", None, "", 0)
    body = root
    node, pieces = root, 0
    blocks: list[list[tuple[int, str]]] = []
    block: list[tuple[int, str]] = []
    opened: Counter[str] = Counter()

    def close_block() -> None:
        nonlocal block
        if block:
            blocks.append(block)
            block = []

    def add(raw: str) -> None:
        nonlocal pieces
        if node.dead or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        block.append((pieces, text))
        pieces += 1
        n = len("".join(text.split()))
        node.chars += n
        node.link_chars += n if node.link else 0

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            if node.tag not in INLINE:
                close_block()
            node.end = pieces
            opened[node.tag] -= 1
            node = node.parent

    def enter(made: Node) -> Node:
        opened[made.tag] += 1
        return made

    position = 0
    while True:
        hit = TAG.search(page, position)
        add(page[position : hit.start() if hit else len(page)])
        if not hit:
            break
        position = hit.end()
        closing, tag, rest = hit[1], (hit[2] or "").lower(), hit[3] or ""
        if not tag:
            continue
        if closing:
            if opened[tag] > 0 and tag not in ("html", "body"):
                open_node = node
                while open_node.tag != tag:
                    open_node = open_node.parent
                leave(open_node.parent)
            elif tag not in INLINE:
                close_block()
            continue
        if tag in ("html", "body"):
            if tag == "body" and body is root:
                leave(root)
                body = node = enter(Node(tag, node, rest, pieces))
            continue
        last = node.scope[SCOPE_OF[tag]] if tag in SCOPE_OF else None
        if last is not None:
            leave(last.parent)
        if tag == "br":
            if block and not node.dead:
                block.append((pieces, " "))
                pieces += 1
            node.tags += 1
            continue
        if tag not in INLINE:
            close_block()
        made = Node(tag, node, rest, pieces)
        if tag in VOID or rest.endswith("/>"):
            made.end = pieces
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, position)
            position = stop.end() if stop else len(page)
            made.end = pieces
        else:
            node = enter(made)
    leave(root)
    close_block()
    root.end = pieces
    return body, blocks


def unnamed(top: Node) -> tuple[int, list[Node]]:
    """Plain text of an element outside the suspected ones in it, and the outermost of these."""
    own, found, order = 0, [], [top]
    for node in order:
        own += node.chars - node.link_chars
        for child in node.children:
            if child.names and not child.dead:
                found.append(child)
            elif not child.dead:
                order.append(child)
    return own, found


def settle(body: Node) -> list[Node]:
    """Decide which suspected elements count for nothing, and return them.

    Suspected elements are weighed with all that bear the same words, or alone where
    one holds most of their text. Where an article element has text of its own,
    only what is suspected inside such elements can be let off.
    """
    order, wraps, has_article = [body], set(), False
    for node in order:
        order += [c for c in node.children if not c.dead]
    for node in reversed(order):
        living = [c for c in node.children if not c.dead and not c.names & CERTAIN]
        node.plain = node.chars - node.link_chars + sum(c.plain for c in living)
        if node.tag in ARTICLE or any(id(c) in wraps for c in living):
            wraps.add(id(node))
    elsewhere, waiting = unnamed(body)
    todo = [(body, False)]
    while todo and not has_article:
        node, inside = todo.pop()
        inside = inside or node.tag in ARTICLE
        has_article = inside and node.chars > node.link_chars
        todo += [(c, inside) for c in node.children if not c.dead and not c.names]
    dropped: list[Node] = []
    groups: dict[frozenset[str], list[tuple[int, int, Node]]] = {}
    totals: Counter[frozenset[str]] = Counter()
    turn = 0
    while True:
        for node in waiting:
            if node.names & CERTAIN or (has_article and not node.article and id(node) not in wraps):
                dropped.append(node)
            else:
                turn += 1
                heapq.heappush(groups.setdefault(node.names, []), (-node.plain, turn, node))
                totals[node.names] += node.plain
        waiting = []
        names = max(totals, key=totals.__getitem__, default=None)
        if names is None or totals[names] <= OUTWEIGHS * elsewhere:
            break
        group = groups[names]
        alone = -2 * group[0][0] > totals[names]
        let_off = [heapq.heappop(group)[2]] if alone else [n for *_, n in group if n.plain]
        if not alone:
            dropped += [n for *_, n in group if not n.plain]
            group.clear()
        for node in let_off:
            totals[names] -= node.plain
            own, inner = unnamed(node)
            elsewhere += own
            waiting += inner
    dropped += [n for group in groups.values() for *_, n in group]
    for node in dropped:
        node.dead = True
    return dropped


def measure(body: Node) -> list[Node]:
    """Sums and densities of all living elements below the body, which comes first."""
    order = [body]
    for node in order:
        order += [c for c in node.children if not c.dead]
    for node in reversed(order):
        node.link_tags += node.tag == "a"
        for child in node.children:
            if not child.dead:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
    average = body.link_chars / max(1, body.chars)
    for node in order:
        if node.chars:
            tags, linked, links = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + average * node.chars + math.e)
            adjusted = max(1.0, node.chars / linked * tags / links)
            node.density = node.chars / tags * math.log(adjusted) / max(math.log(base) if base > 1 else 0.0, 1.0)
    return order


def main_text(page: str) -> str:
    """Text of the article, its blocks in page order joined by line feeds."""
    body, blocks = parse(page)
    dropped = settle(body)
    order = measure(body)
    sums = [(sum(c.density for c in n.children if not c.dead and c.tag not in INLINE), n) for n in order]
    best, chosen = 0.0, body
    for total, node in sums:
        if node.tag not in INLINE and total > best:
            best, chosen = total, node
    kept, left = [chosen], dropped
    path = [chosen]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    inside = chosen.parent is not None and chosen.parent.article
    for node, parent in zip(path, path[1:], strict=False):
        others = [c for c in parent.children if not c.dead and c is not node and c.tag not in INLINE]
        if node is chosen or inside:
            kept.append(parent)
            left += [c for c in others if is_linked(c)]
            inside = inside and parent.tag not in ARTICLE
        else:
            own = [c for c in others if not is_linked(c) and (c.tag in HEADINGS or c.density >= threshold)]
            kept += own
            if parent is body:  # also what stands between parts of the article
                ends = {id(c) for c in (node, *own)}
                places = [i for i, c in enumerate(parent.children) if id(c) in ends]
                between = {id(c) for c in parent.children[places[0] : places[-1]]}
                kept += [c for c in others if id(c) in between and not is_linked(c)]
    size = max((n for block in blocks for n, _ in block), default=-1) + 1
    belongs, apart = covered(kept, size), covered(left, size)
    texts = []
    for block in blocks:
        text = " ".join("".join([t for n, t in block if belongs[n] and not apart[n]]).split())
        if text:
            texts.append(text)
    return "\n".join(texts)


def covered(nodes: list[Node], size: int) -> list[int]:
    """For each piece how many of these nodes have it."""
    steps = [0] * (size + 1)
    for node in nodes:
        steps[node.begin] += 1
        steps[node.end] -= 1
    return [*accumulate(steps)]


def is_linked(node: Node) -> bool:
    """More than half of its text is links."""
    return 2 * node.link_chars > node.chars


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page, from its whole html; null and empty pages, and those
    without text, give an empty text. Repeated rows each give a row, other columns
    are ignored, an empty table gives no rows."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(p) for p in strings(batch.column("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=schema.names)

    return df.select(df[id_col].alias("id"), df[html_col].alias("html")).mapInArrow(run, schema)
