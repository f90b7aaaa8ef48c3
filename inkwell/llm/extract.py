"""Main text of web pages by composite text density.

A page becomes a light DOM tree. Elements that HTML itself keeps apart from the
text (navigation, footers, asides, forms, scripts, styles, hidden parts) are cut
from it. Each remaining node gets the characters and tags below it and those
inside links; its density is characters per tag, lowered by the share of links.
The subtree whose children have the largest sum of densities is the core;
subtrees whose whole name says boilerplate (``site-footer``, ``comments``,
``ad-box``) and that hold no article, main element or main heading, nor, unless
they are comments, most of the page, are left out of the sums. The
least density on the path from the body to the core is the threshold: every
block that reaches it marks the subtree of the largest sum within it. The core
widens to an ancestor if at least half of what that adds lies in marked subtrees
that hold paragraphs. Every node on the path reaches the threshold; if an
article or main element is among them, it breaks the tie, and if the core is
wider than the only such element, that one does. A main heading that stands
before the core, outside it, is put first.

Within the core, these subtrees go, too; elements whose class or id only contains
such a word, or a word that articles use as well (``search``, ``legal``,
``discussion``), go only if they are sparser than the threshold or half of their
characters are links. So do headings, paragraphs and quotes, unless the name is that
of an advert. Paragraphs, headings and sections keep what their ids say, as those are
slugs of titles. Nothing else is dropped: lists of links and short blocks of an
article stay. On a page without a main heading, a second-level one right before the
core takes its place.

Defined cases: a null or empty page gives an empty text; text without any tag
is one block; unclosed and stray tags are repaired as browsers do for
paragraphs, list items and table cells; a tag or comment that the end of the
page cuts off is markup and ends the text; a quote without its partner is an
ordinary character; elements nested deeper than ``MAX_DEPTH`` become siblings,
as in browsers; pages of any length are read whole, in time that grows with
their length; a page whose core is empty gives an empty text, as does an empty
table no rows; repeated rows are extracted one by one; null ids and urls are
passed on; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {t: ("p",) for t in "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()} | {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)
}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
CUT_TAGS = frozenset("nav footer aside script style noscript template iframe svg canvas button select input textarea object embed audio video map dialog menu head title".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words of a class or id that name what an article does not hold.
BOILER = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe subscription "
    "share sharing social sidebar sidebars menu menus nav navbar navbars navigation breadcrumb breadcrumbs related recommended teaser teasers comment comments commentlist commenter replies reply respond disqus footer footers masthead topbar toolbar login signup pagination pager paywall".split()
)
#: Those of reader comments, which may be longer than the article.
READERS = frozenset("comment comments commentlist commenter replies reply respond disqus".split())
#: Those of adverts, which may be single paragraphs.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsors sponsored cookie cookies consent gdpr".split())
#: Words that articles use for their own parts, too.
PERHAPS = frozenset("widget widgets side foot discussion review reviews search skip alert alerts disclaimer legal copyright tags head header headers".split())
#: Words that may stand beside them without changing what is named.
BESIDE = frozenset("site page main top bottom left right inner outer wrapper wrap container box area section block list item items bar links link button buttons form post posts article articles story stories reader user global primary secondary slot unit area thread text author meta date body and the content".split())
HEADER = frozenset("header headers head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are single parts of a text.
TEXTS = HEADINGS | frozenset("p blockquote pre".split())
PARTS = HEADINGS | frozenset("p li dt dd td th tr tbody thead tfoot blockquote pre figcaption caption".split())
MAX_DEPTH = 512
#: A tag's attributes: runs, quoted values after an equals sign, or a lone sign. No part gives back what it took, so a tag is read once.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>")
OPENING = re.compile(r"<(?=[a-zA-Z/!?])")
COMMENT_END = re.compile(r"--!?>")
ATTR = re.compile(r"([^\s\"'>/=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]*+))")
ATTR_NAME = re.compile(r"([^\s\"'>/=]++)(\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]*+))?+")
BLANKS = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "named", "inside", "depth", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, named: int = 0):
        self.tag, self.parent, self.kids, self.cut, self.named = tag, parent, [], cut, named
        self.depth = parent.depth + 1 if parent is not None else 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def name_level(value: str, header: bool) -> int:
    """3 if one of the names in a class or id says reader comments as a whole, 2 if one says other boilerplate, 1 if one contains such a word, else 0. ``header``: whether headers count as whole names."""
    level = 0
    for name in dict.fromkeys(value.lower().split()):  # each name once
        words = WORD.findall(name)
        if header and any(w in HEADER for w in words) and all(w in HEADER or w in ("site", "page", "main", "top", "global") for w in words):
            level = max(level, 2)
        sure = any(w in BOILER for w in words)
        if sure and all(w in BOILER or w in PERHAPS or w in BESIDE for w in words):
            level = max(level, 3 if any(w in READERS for w in words) else 2)
        elif sure or any(w in PERHAPS for w in words):
            level = max(level, 1)
    return level


def judge_element(tag: str, attrs: str, inside: bool) -> tuple[bool, int]:
    """(cut whatever the densities say, level of its names)."""
    if tag in CUT_TAGS or tag == "header" and not inside:
        return True, 0
    if not attrs or attrs.isspace():
        return False, 0
    level = 0
    for m in ATTR_NAME.finditer(attrs):
        name = m[1].lower()
        if name == "hidden":
            return True, 0
        if m[2] is None or name not in ("class", "id", "role", "aria-hidden", "style"):
            continue
        m = ATTR.match(m[0])
        value = unescape(m[2] or m[3] or m[4] or "").strip()
        if name == "role" and value.lower() in CUT_ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return True, 0
        if name == "class" or name == "id" and tag not in PARTS:
            if tag in ("html", "body"):
                continue
            found = name_level(value, not inside)
            if name == "id" and tag == "section" or tag in PARTS or tag in ("article", "main"):
                found = found if found >= 2 else 0  # slugs of titles, and names of topics
            if tag in TEXTS and found >= 2 and ADVERTS.isdisjoint(WORD.findall(value.lower())):
                found = 1
            level = max(level, found)
    return False, level


def parse(html: str) -> Node:
    """The tree of a page; kids are nodes and strings in page order."""
    root = at = Node("body", None)
    open_: dict[str, int] = {}
    pos, size = 0, len(html)

    def text(raw: str) -> None:
        if raw:
            at.kids.append(unescape(raw) if "&" in raw else raw)

    def pop_to(node: Node) -> None:
        nonlocal at
        while at is not node:
            open_[at.tag] -= 1
            at = at.parent

    while pos < size:
        begin = pos
        m = OPENING.search(html, pos)
        if m is None:
            text(html[begin:])
            break
        text(html[begin : m.start()])
        pos = m.start()
        tag_match = TAG.match(html, pos)
        if tag_match is None:
            if html.startswith("<!--", pos):
                end = COMMENT_END.search(html, pos + 2)
                pos = end.end() if end else size
            elif html[pos + 1] in "!?" or html[pos + 1] == "/" and not html[pos + 2 : pos + 3].isalpha():
                end = html.find(">", pos)
                pos = end + 1 if end >= 0 else size
            else:
                break  # a tag that the end of the page cuts off
            continue
        pos = tag_match.end()
        closing, tag, attrs = tag_match[1], tag_match[2].lower(), tag_match[3]
        if tag in ("html", "body", "tbody") or tag == "head" and closing:
            if tag == "tbody" and closing and open_.get("table"):
                node = at
                while node.tag != "table":
                    node = node.parent
                pop_to(node)
            elif tag == "body" and not closing:
                pop_to(root)
            continue
        if closing:
            if not open_.get(tag):
                continue
            node = at
            while node.tag != tag:
                if tag in INLINE and node.tag in ("td", "th", "table"):
                    break
                node = node.parent
            if node.tag == tag:
                pop_to(node.parent)
            continue
        for other in CLOSES.get(tag, ()):
            if open_.get(other):
                node, fence = at, FENCE.get(tag, ("table", "td", "th", "button", "object"))
                while node.parent is not None and node.tag != other and node.tag not in fence:
                    node = node.parent
                if node.tag == other:
                    pop_to(node.parent)
        if at.depth >= MAX_DEPTH:
            pop_to(at.parent)
        new = Node(tag, at)
        new.cut, new.named = judge_element(tag, attrs, new.inside)
        at.kids.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(html, pos)
            raw = html[pos : end.start() if end else size]
            if not new.cut:
                new.kids.append(unescape(raw))
            pos = end.end() if end else size
        elif tag not in VOID and (not attrs.rstrip().endswith("/") or tag in CLOSES or tag == "a"):
            at = new
            open_[tag] = open_.get(tag, 0) + 1
    return root


def walk(root: Node) -> list[Node]:
    """The nodes that are not cut, parents first, in page order."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.cut]
    return out


def count(nodes: list[Node]) -> None:
    """Characters and tags below each node, all of them and those in links."""
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
    for n in reversed(nodes):
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(BLANKS.sub("", k))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags


def density(n: Node, share: float) -> float:
    """Characters per tag, times a logarithm that falls with the share of links; ``share`` is that of the whole page."""
    if not n.chars:
        return 0.0
    tags, links, link_tags = max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
    base = math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + share * n.chars + math.e)
    # one is added to the base's logarithm, which is 0 for pages without links
    return n.chars / tags * max(0.0, math.log(max(n.chars / links * tags / link_tags, 1.0)) / (math.log(base) + 1.0))


def measure(root: Node) -> list[Node]:
    """Counts, densities and sums of child densities of all nodes. A form is cut unless it holds most of the page, as some pages are one form."""
    nodes = walk(root)
    count(nodes)
    forms = [n for n in nodes if n.tag == "form" and 2 * n.chars <= root.chars]
    if forms:
        for n in forms:
            n.cut = True
        nodes = walk(root)
        count(nodes)
    holds = {id(n): False for n in nodes}  # an article, main element or main heading
    for n in reversed(nodes):
        if n.named >= 2 and (holds[id(n)] or n.named == 2 and 2 * n.chars > root.chars):
            n.named = 0  # a name of the layout around the article
        if n.parent is not None and n.named < 2 and (holds[id(n)] or n.tag in ("article", "main", "h1") and n.chars):
            holds[id(n.parent)] = True
    share = root.link_chars / root.chars if root.chars else 0.0
    for n in nodes:
        n.density = density(n, share)
    for n in nodes:
        n.total = sum(k.density for k in n.kids if isinstance(k, Node) and not k.cut and k.named < 2)
    return nodes


def marked_subtrees(root: Node, nodes: list[Node]) -> tuple[Node, float, set[int]]:
    """(the subtree of the largest sum, the threshold on the path to it, ids of the marked subtrees)."""
    best: dict[int, Node] = {}
    for n in reversed(nodes):
        top = n
        for k in n.kids:
            if isinstance(k, Node) and not k.cut and k.named < 2 and best[id(k)].total > top.total:
                top = best[id(k)]
        best[id(n)] = top
    top = best[id(root)]
    least, n = math.inf, top
    while n is not None:
        if n.density > 0:
            least = min(least, n.density)
        n = n.parent
    marked = {id(best[id(n)]) for n in nodes if n.density >= least and n.chars and n.tag not in INLINE}
    return top, least, marked


def core(root: Node) -> tuple[list[Node], float]:
    """(the subtrees of the article in page order, the threshold)."""
    nodes = measure(root)
    if not root.chars:
        return [], 0.0
    top, least, marked = marked_subtrees(root, nodes)
    gain = dict.fromkeys(map(id, nodes), 0)  # characters below that lie in marked subtrees with paragraphs
    whole = dict.fromkeys(map(id, nodes), False)
    for n in reversed(nodes):
        kids = [k for k in n.kids if isinstance(k, Node) and not k.cut]
        whole[id(n)] = n.tag in PARTS or any(whole[id(k)] for k in kids)
        gain[id(n)] = 0 if n.named >= 2 else n.chars if id(n) in marked and whole[id(n)] else sum(gain[id(k)] for k in kids)
    around = top
    while around.parent is not None and (around.tag in INLINE or around.tag in PARTS and not any(isinstance(k, Node) and k.tag not in INLINE for k in around.kids)):
        around = around.parent
    n, held = around.parent, gain[id(around)]
    while n is not None:
        kids = [k for k in n.kids if isinstance(k, Node) and not k.cut]
        below = sum(gain[id(k)] for k in kids)
        if below > held and 2 * (below - held) >= n.chars - around.chars:
            around = n
        held, n = max(held, below) if around is n else below, n.parent
    n, element = around, None
    while n is not None:
        if n.tag == "article" or n.tag == "main" and element is None:
            element = n
        n = n.parent
    around = element or article_within(around)
    if any(k.tag == "h1" and k.chars for k in walk(around)):
        return [around], least
    heading, path = None, set()
    n = around
    while n is not None:
        path.add(id(n))
        n = n.parent
    main = any(n.tag == "h1" and n.chars for n in nodes)
    for n in nodes:  # in page order; the last main heading before the core, or one of the second level with no text behind it
        if n is around:
            break
        if n.tag == ("h1" if main else "h2") and n.chars and not _below_named(n):
            heading = n
        elif heading is not None and not main and any(isinstance(k, str) and not k.isspace() for k in n.kids) and not _within(n, heading):
            heading = None
    return ([heading] if heading is not None and id(heading) not in path else []) + [around], least


def article_within(n: Node) -> Node:
    """The article or main element in the core, outside named parts, if it is the only one or has half of the characters that no name gives away; else the core."""
    found, stack, named = [], [n], 0
    while stack:
        k = stack.pop()
        if k.named >= 2 and k is not n:
            named += k.chars
        elif k.tag in ("article", "main") and k.chars:
            found.append(k)
        else:
            stack += [x for x in k.kids if isinstance(x, Node) and not x.cut]
    if not found:
        return n
    most = max(found, key=lambda k: k.total)
    return most if len(found) == 1 or 2 * most.chars >= n.chars - named else n


def _within(n: Node | None, top: Node) -> bool:
    while n is not None and n is not top:
        n = n.parent
    return n is top


def _below_named(n: Node | None) -> bool:
    while n is not None:
        if n.named >= 2:
            return True
        n = n.parent
    return False


def drops(n: Node, least: float) -> bool:
    """Whether an element within the core goes by its names."""
    if n.cut or not n.named:
        return n.cut
    return n.named >= 2 or 2 * n.link_chars > n.chars or n.density < least


def blocks(root: Node, least: float = 0.0) -> list[str]:
    """Texts of the blocks of a subtree in page order."""
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = BLANKS.sub(" ", "".join(parts)).strip()
        if text:
            out.append(text)
        parts.clear()

    stack: list[tuple[object, bool]] = [(root, False)]  # item, leaving it
    while stack:
        item, leaving = stack.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        inline = item.tag in INLINE
        if not inline:
            close()
        if leaving:
            continue
        if item.tag == "br":
            parts.append(" ")
        if not inline:
            stack.append((item, True))
        stack += [(k, False) for k in reversed(item.kids) if isinstance(k, str) or not drops(k, least)]
    close()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not html:
        return ""
    roots, least = core(parse(html))
    return "\n".join(x for r in roots for x in blocks(r, least))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):  # a bounded number of texts at once
            part = batch.slice(i, 256)
            texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in range(part.num_columns - 1)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*part.schema.names[:-1], "text", "n_chars"]
            )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, ``text`` and ``n_chars``, its code points."""
    narrow = pages.select(id_col, url_col, html_col)
    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(_extract, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
