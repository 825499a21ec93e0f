"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, less the further up and less the more of an
ancestor's text lies in links; the best container and its siblings that read like it are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.text import pieces

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROPPED = set("aside audio button canvas dialog footer head iframe input label menu nav noembed noframes noscript object select svg template video".split()) | _RAW
# Words in classes and ids that make an element doubtful. Most of its points are lost for the first ones,
# half of them for the others, which articles use for parts of their own as well; readers' comments are no part of one.
_UNLIKELY = "ad adsbygoogle adsense ads advert adverts advertisement advertisements advertising adbox alert alerts banner banners breadcrumb breadcrumbs captcha consent cookie cookies crumbs footer gdpr forms form hidden login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion promotions recommended recommendations related search share sharing sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subnav subscribe subscription toolbar topbar topnav widget widgets"
_DOUBTFUL = "discussion feedback header recommend tags"
_COMMENTS = "comment comments commentlist disqus replies respond responses"
_WORDS = {**{w: 0.5 for w in _DOUBTFUL.split()}, **{w: 0.1 for w in _UNLIKELY.split()}, **{w: 0.0 for w in _COMMENTS.split()}}
# Words that say nothing of what an element holds. A name with any others, such as related-work, is one of its own.
_PLAIN = "area articles bar block body bottom box btn button buttons col column container content cta desktop entry fixed footer full group head header holder icons inner item items large left letter link links list main message mobile module page panel panels policy post posts right row section sections site slot small sticky text title top unit user wrap wrapper"
_NEUTRAL = set(_PLAIN.split())
_WORD_ENDS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
#: A doubtful element stays from so many points on; so many links make a menu, of up to so many characters each.
_STAYS, _LINKS, _MENU = 3.0, 3, 25
# What stands before links that lead away from an article.
_LABELS = re.compile(r"\b(?:read more|related|share|tags|see also|more on)\b", re.I)
# What links of a page's own menu say.
_PAGES = set("about archive back blog contact faq help home imprint login news next previous print privacy register rss search sitemap terms top".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog"}
_CLOSES_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Node:
    """``trust``: what share of its points an element keeps; ``points``: those of all paragraphs in it, ``score``: those
    that were passed to it; ``size``, ``linked`` and ``links``: characters, characters in links, number of links; ``titled``:
    a heading of the first level is in it; ``inside``: it stands in an article."""

    __slots__ = ("tag", "parent", "parts", "dropped", "trust", "points", "score", "size", "linked", "links", "titled", "inside")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool = False, trust: float = 1.0):
        self.tag, self.parent, self.dropped, self.trust = tag, parent, dropped, trust
        self.parts: list[_Node | str] = []
        self.points, self.score, self.size, self.linked, self.links, self.titled = 0.0, 0.0, 0, 0, 0, tag == "h1"
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


def _trust(name: str) -> float:
    """What a class or an id leaves of an element's points. A name counts if all of its words are known ones."""
    words = [w.lower() for w in _WORD_ENDS.split(name) if w and not w.isdigit()]
    known = [_WORDS[w] for w in words if w in _WORDS]
    return min(known) if known and all(w in _WORDS or w in _NEUTRAL for w in words) else 1.0


def _element(tag: str, parent: _Node, rest: str) -> _Node:
    """A node; what is hidden, or no text of an article by its tag or role, is dropped, and doubtful names lower its trust.

    A heading is trusted whatever its name is, as is what an article is made of.
    """
    node = _Node(tag, parent, tag in _DROPPED, 0.1 if tag == "form" else 1.0)
    if tag == "header" and not node.inside:
        node.dropped = True
    if node.dropped or tag in ("body", "html", "article", "main") or not rest.strip():
        return node
    for name, *values in _ATTRIBUTE.findall(rest):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "class" and tag not in _HEADINGS:
            node.trust = min([node.trust, *map(_trust, value.split())])
        if name == "id" and tag not in _HEADINGS and (found := _trust(value)) < 1:
            # a part of an article has its id for links to it
            node.trust = min(node.trust, 0.5 if tag == "section" and node.inside and found > 0 else found)
        if name == "hidden" or name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            node.dropped = True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.dropped = True
    return node


def _upwards(node: _Node | None) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.parent


class _Open:
    """The elements that are open, with the depths of each tag, so that none has to be looked for upwards."""

    def __init__(self, root: _Node):
        self.stack, self.depths = [root], {root.tag: [0]}

    @property
    def top(self) -> _Node:
        return self.stack[-1]

    def push(self, node: _Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The depth of the innermost open element with one of the tags; 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def close(self, depth: int) -> None:
        """Close the element at a depth, and all in it; the root stays open."""
        while len(self.stack) > max(depth, 1):
            self.depths[self.stack.pop().tag].pop()


_AROUND_P = ("p", "article", "div", "section", "body", "td", "main", "li")
_AROUND_ITEM = ("ul", "ol", "dl", "table", "tbody", "select", "div", "article", "body")
_HOLDS_INLINE = ("article", "div", "td", "body", "section", "main")


def parse(page: str) -> _Node:
    """A tree of the page's elements and texts; what was left open is closed where its container ends."""
    root = _Node("#root", None)
    still, unclosed = _Open(root), set()
    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            still.top.parts.append(page[at:])
            break
        if found.start() > at:
            still.top.parts.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        if "<" in found[3] and (loose := _LOOSE.match(page, found.start())) and loose.end() < at:
            found, at = loose, loose.end()  # a quote that never closed took other tags in
        tag = found[2].lower()
        if found[1]:
            if tag == "p" or tag in _BLOCKS or tag == "a":
                depth = still.last((tag,))
                if depth and not (tag in ("p", "li", "a") and still.last(_HOLDS_INLINE) > depth):
                    still.close(depth)
            elif still.top.tag == tag:
                still.close(len(still.stack) - 1)
            continue
        if tag in _RAW:
            close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close is None:  # never closed: it ends where what it stands in does
                unclosed.add(tag)
                around = [t for t, d in still.depths.items() if d and t != "#root"]
                close = around and re.compile(rf"(?=</(?:{'|'.join(map(re.escape, around))})\s*>)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in _BLOCKS and (depth := still.last(_AROUND_P)) and still.stack[depth].tag == "p":
            still.close(depth)
        if tag in _CLOSES_SELF and (depth := still.last((*_AROUND_ITEM, *_CLOSES_SELF[tag]))) and still.stack[depth].tag in _CLOSES_SELF[tag]:
            still.close(depth)
        child = _element(tag, still.top, found[3])
        still.top.parts.append(child)
        if tag not in _VOID and not found[3].endswith("/"):
            still.push(child)
    return root


def _measure(root: _Node) -> list[_Node]:
    """Set the sizes of all nodes bottom-up, give points to containers, and return the nodes in page order."""
    order, todo = [], [(root, 1.0)]
    trusts = []
    while todo:
        node, trust = todo.pop()
        if node.dropped:
            continue
        trust = min(trust, node.trust)
        order.append(node)
        trusts.append(trust)
        todo.extend((x, trust) for x in reversed(node.parts) if not isinstance(x, str))
    for node in reversed(order):
        own = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        node.size += own
        if node.tag == "a":
            node.linked, node.links = node.size, 1
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.links += node.links
            node.parent.titled |= node.titled
    for node, trust in zip(order, trusts, strict=True):
        inline = own_text(node) if node.tag in ("p", "pre", "td", "blockquote", "li", "div", "section", "article") else ""
        if len(inline) < 2 or node.tag == "li" and node.linked > 0.5 * node.size:
            continue
        node.points = 1 + inline.count(",") + min(len(inline) / 100, 3.0)
        share = trust
        up = node if node.tag in ("div", "section", "article") else node.parent
        for level in range(1, 5):
            if up is None or up.tag in ("#root", "html"):
                break
            up.score += node.points * share
            share = trust / (2 * level)
            up = up.parent
    for node in reversed(order):
        if node.parent is not None:
            node.parent.points += node.points
    return order


def doubted(node: _Node) -> bool:
    """Whether an element goes for its name: too few points are left of those of its paragraphs. The title of an article
    stays in whatever it is wrapped in, unless that is no part of an article at all."""
    if node.trust == 0.5 and node.titled and node.inside:
        return False
    return node.trust < 1 and node.points * (1 - density(node)) * node.trust < _STAYS


def menu(node: _Node) -> bool:
    """Whether a container is mostly links of a few words each, more than a text names in passing."""
    listed = node.tag in ("ul", "ol", "dl", "table", "div", "section", "header") and density(node) > 0.5 and node.linked <= _MENU * node.links
    if not listed or not node.inside or node.links >= _LINKS:
        return listed
    out: list[str] = []
    todo: list[_Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x.strip().lower())
        else:
            todo.extend(x.parts)
    return _LABELS.search(" ".join(out)) is not None or all(x in _PAGES for x in out if x)


def own_text(node: _Node) -> str:
    """The text of a node and its inline children, without blocks inside it."""
    out, todo = [], list(reversed(node.parts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped and x.tag not in _BLOCKS:
            todo.extend(reversed(x.parts))
    return "".join(out).strip()


def density(node: _Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _blocks(node: _Node, out: list[str]) -> None:
    """Append the texts of the blocks below a node, in page order."""
    text: list[str] = []

    def close() -> None:
        if text and (joined := " ".join(html.unescape("".join(text)).split())):
            out.append(joined)
        text.clear()

    todo: list[_Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            text.append(x)
        elif x.dropped or x is not node and (doubted(x) or menu(x)):
            close()
        elif x.tag in _BLOCKS:
            close()
            todo.append(None)
            todo.extend(reversed(x.parts))
        elif x.tag == "br":
            text.append(" ")
        else:
            todo.extend(reversed(x.parts))
    close()


def main_text(page: str | None) -> str:
    """The blocks of the best container and of its siblings that read like it, joined by an empty line; '' if none."""
    if not page:
        return ""
    order = _measure(parse(page))
    scored = [(n.score * (1 - density(n)), -i, n) for i, n in enumerate(order) if n.score > 0 and n.tag not in ("p", "#root", "html")]
    if not scored:
        body = next((n for n in order if n.tag in ("article", "main", "body")), order[0] if order else None)
        out: list[str] = []
        if body is not None and density(body) <= 0.5:
            _blocks(body, out)
        return "\n\n".join(out)
    best, _, top = max(scored, key=lambda x: x[:2])
    around = [up for up in _upwards(top.parent) if up.tag == "article" and not up.dropped]
    if top.tag not in ("article", "main", "body") and around:
        top = around[0]
    out = []
    parent = top.parent
    if top.tag == "body" or parent is None:
        _blocks(top, out)
        return "\n\n".join(out)
    siblings = [x for x in parent.parts if not isinstance(x, str) and (x is top or not (x.dropped or doubted(x)))]
    reads = [x is top or _reads_like(x, best, top.tag not in ("article", "main")) for x in siblings]
    first, last = reads.index(True), len(reads) - 1 - reads[::-1].index(True)
    for x, good in zip(siblings[first : last + 1], reads[first : last + 1], strict=True):
        if good or x.tag in _BLOCKS and density(x) < 0.25 and not menu(x):  # short blocks between good ones belong to them
            _blocks(x, out)
    return "\n\n".join(out)


def _reads_like(node: _Node, best: float, short: bool) -> bool:
    """Whether a sibling of the best container is text of the same kind; ``short`` sentences count beside a container that
    the page doesn't call its article."""
    if density(node) >= 0.25:
        return False
    if node.score * (1 - density(node)) >= max(10.0, 0.2 * best):
        return True
    text = own_text(node) if node.tag in ("p", "pre", "blockquote") else ""
    return len(text) > 80 or short and bool(re.search(r"[.!?…。]['\")\]]*$", text))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """One row per page: the kept columns, ``text`` and ``n_chars`` (its code points).

    A null or empty page, and one without text outside of menus, notices and the like, has an empty text. Repeated
    pages are extracted one by one; nothing is cut off.
    """
    slim = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_column).alias("__html"))
    out = slim.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "__html"):
            texts = [main_text(x) for x in piece.column(len(keep)).to_pylist()]
            yield pa.record_batch([*piece.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], out.names)

    return slim.mapInArrow(run, out)
