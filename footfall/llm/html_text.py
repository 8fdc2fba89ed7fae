"""HTML extraction by composite text density.

Each node of a page's tree gets its characters per tag, adjusted for links; a node's density sum adds up those of its children. The main text
is the subtree with the greatest sum, together with what lies beside its way to the body and is as dense as the thinnest node on that way.
Parts that say by tag or role that they are no main text are taken out first; so are forms and parts with such a name, unless they hold the main text.
A name that only has such a word in it weighs: the part goes, also from inside an article, if its unlinked characters a paragraph, so weighed, are below
those of the text around it. A page is read in time linear in its length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# HTML elements by role.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "script style noscript template iframe object embed applet canvas svg audio video map button select textarea input option datalist "
    "nav menu footer aside dialog head title noembed noframes".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements whose end an open paragraph does not outlive, and which end it when they begin.
ENDS_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body"}

# Words in a class or id, and roles, of parts that are no main text.
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside rail nav navbar navigation menu submenu breadcrumb "
    "breadcrumbs footer masthead comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager toolbar "
    "skip skiplink copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
STOP = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Words that say nothing beside one of NAMES.
NEUTRAL = frozenset(
    "left right top bottom main site page primary secondary container wrapper wrap box block area list item items section bar button buttons link links icon icons "
    "inner outer title form post posts article articles stories slot unit google global header".split()
)
#: Names that parts of an article have as well.
WEAK = frozenset("discussion related share sharing social notice notices alert promotion respond reply replies aside copyright consent notification subscription".split())
COMMENTS = frozenset("comment comments commentlist disqus".split())
#: A token that begins with one of the longer names.
BEGINS = re.compile("|".join(sorted(n for n in NAMES if len(n) > 2)))
#: What a character counts in a part whose name speaks against it in part, without and with a paragraph of its own.
WEIGHTS = (0.25, 0.5)
PARAGRAPHS = frozenset("p pre blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "noise", "hint", "parent", "children", "chars", "tags", "link_chars", "links", "paragraphs", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", noise: bool, hint: str = ""):
        self.tag, self.parent, self.noise, self.hint = tag, parent, noise, hint
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.links = self.paragraphs = 0
        self.density = self.total = 0.0


def _noise(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no main text; ``inside`` an article or main element, where a header belongs to the text."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _hint(tag: str, attributes: str, inside: bool) -> str:
    """What speaks against an element: "form", a "name" (all words of a class or the id), one of "comments", a "weak" one, which articles use too, or "some" word of a name."""
    if tag in ("form", "fieldset"):
        return "form"
    if tag in HEADINGS or tag in ("html", "body") or not attributes.strip() or tag in ("article", "main") and "comment" not in attributes.lower():
        return ""
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() not in ("class", "id"):
            continue
        for token in (m[2] or "").strip("\"'").split():
            if not token.isascii():
                continue
            names = NAMES if inside else NAMES | {"header"}
            for words in ({w.lower() for w in PART.findall(token)}, set(re.findall(r"[a-z]+", token.lower()))):
                said = words & names
                if said & COMMENTS:
                    return "comments"
                if said and words <= names | NEUTRAL:
                    found = "name" if said - WEAK else found if found == "name" else "weak"
                elif said or BEGINS.match(token.lower()):
                    found = found or "some"
    return found


class Tokens:
    """A page's comments, tags and texts, one behind the other. What has no end is text, and is not searched for again."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last = {end: page.rfind(end) for end in (">", "-->", "]]>")}
        self.quoted = True  # until a tag's quotes have no end

    def _attributes(self, start: int) -> int:
        """Where the tag whose attributes begin at ``start`` ends (behind it); -1 if it does not."""
        page, at = self.page, start
        while m := STOP.search(page, at):
            if m[0] == ">":
                return m.end()
            at = page.find(m[0], m.end()) + 1
            if not at:
                break
        return -1

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """Kind (text, open, close), tag or text, and attributes."""
        page, n = self.page, len(self.page)
        while self.at < n:
            at = self.at
            if page[at] != "<":
                end = page.find("<", at)
                self.at = n if end < 0 else end
                yield "text", page[at : self.at], ""
            elif page.startswith("<!--", at):
                self.at = page.find("-->", at + 4) + 3 if at + 4 <= self.last["-->"] else n
            elif page.startswith("<![CDATA[", at) and at < self.last["]]>"]:
                self.at = page.find("]]>", at) + 3
                yield "data", page[at + 9 : self.at - 3], ""
            elif at > self.last[">"]:
                # No tag ends any more.
                self.at = n
                yield "text", page[at:], ""
            elif page[at + 1] in "!?":
                self.at = page.find(">", at) + 1
            elif m := NAME.match(page, at):
                end = self._attributes(m.end()) if self.quoted else -1
                if end < 0:
                    # Quotes without an end: from here on a tag ends at the next bracket, whatever its quotes.
                    self.quoted = False
                    end = page.find(">", m.end()) + 1
                    following = page.find("<", m.end(), end)
                    if following >= 0:
                        self.at = following
                        yield "text", page[at:following], ""
                        continue
                self.at = end
                yield "close" if m[1] else "open", m[2], page[m.end() : end - 1]
            else:
                self.at = at + 1
                yield "text", "<", ""


RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^<>]*>|\Z", re.I) for tag in RAW}

#: Elements that an end tag of an inline element does not reach beyond.
WALLS = frozenset("article main table td th".split())


def parse(page: str) -> Node:
    """The page's tree. Open elements that an end tag or a new block implies closed are closed; stray end tags are ignored.

    Open elements are counted by tag, in all and since the last wall, so that nobody walks up for one that is not there.
    """
    root = node = Node("html", None, False)
    inside = 0  # open article and main elements
    open_ = Counter()
    since = [Counter()]

    def close(target: Node) -> Node:
        nonlocal inside
        here = node
        while here is not target.parent:
            inside -= here.tag in ("article", "main")
            open_[here.tag] -= 1
            if here.tag in WALLS:
                since.pop()
            since[-1][here.tag] -= 1
            here = here.parent
        return here

    def opened(tags, stop) -> Node | None:
        """The outermost of the open elements ``tags`` within the nearest of ``stop``."""
        left = sum(open_[t] for t in tags)
        here, found = node, None
        while left > 0 and here is not root and here.tag not in stop:
            if here.tag in tags:
                found, left = here, left - 1
            here = here.parent
        return found

    def enter(child: Node) -> None:
        open_[child.tag] += 1
        since[-1][child.tag] += 1
        if child.tag in WALLS:
            since.append(Counter())

    tokens = Tokens(page)
    for kind, tag, attributes in tokens:
        if kind in ("text", "data"):
            node.children.append(html.unescape(tag) if kind == "text" else tag)
            continue
        tag = tag.lower()
        if kind == "close":
            if tag in ("html", "body"):
                continue
            # An inline element is only looked for since the last wall; a wall that is one itself counts as outside.
            found = open_[tag] > 0 if tag in BLOCK or tag in WALLS else since[-1][tag] > 0
            if found:
                here = node
                while here.tag != tag:
                    here = here.parent
                node = close(here)
            elif tag == "br":
                node.children.append(" ")
            continue
        if tag in ("html", "body"):
            if tag == "body" and not any(isinstance(c, Node) and c.tag == "body" for c in root.children):
                if node is not root:
                    node = close(opened({"head"}, ()) or node) if opened({"head"}, ()) else node
                body = Node("body", node, False)
                node.children.append(body)
                node = body
                enter(body)
            continue
        if tag in ENDS_P and (p := opened({"p"}, {"article", "main", "section", "div", "td", "th", "blockquote", "li", "button", "table"})):
            node = close(p)
        elif tag in CLOSES and (old := opened(*CLOSES[tag])):
            node = close(old)
        if tag == "br":
            node.children.append(" ")
            continue
        child = Node(tag, node, _noise(tag, attributes, inside > 0), _hint(tag, attributes, inside > 0))
        node.children.append(child)
        if tag in RAW:
            end = RAW_ENDS[tag].search(page, tokens.at)
            if tag not in NEVER:
                child.children.append(page[tokens.at : end.start()])
            tokens.at = end.end()
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            node = child
            inside += tag in ("article", "main")
            enter(child)
    return root


def _preorder(root: Node) -> list[Node]:
    """All nodes but those in parts that are no main text, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.noise:
            out.append(node)
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def settle(root: Node) -> None:
    """Take out the elements that a name or form tag speaks against, unless their text says otherwise.

    Outside articles, none stays that leaves an article or main element with text outside it; else one that holds the greater part of the page's paragraphs (of its
    text, for a form; nine tenths, for comments and on a page without paragraphs). Inside an article, one with a name stays if it holds nine tenths of the article, one with a weak name if half of its text is
    unlinked paragraphs.
    """
    nodes = _preorder(root)
    if not any(n.hint and n.hint != "some" for n in nodes):
        return
    text, para, homes = {}, {}, {}
    above: dict[int, tuple[bool, bool, Node | None]] = {}  # inside a paragraph, inside a link, nearest article or main element
    for n in nodes:
        in_p, in_a, home = above.get(id(n.parent), (False, False, None))
        above[id(n)] = in_p or n.tag in ("p", "pre", "blockquote") or n.tag in HEADINGS, in_a or n.tag == "a", n if n.tag in ("article", "main") else home
    for n in reversed(nodes):
        in_p, in_a, _ = above[id(n)]
        below = [c for c in n.children if isinstance(c, Node) and not c.noise]
        own = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        text[id(n)] = own + sum(text[id(c)] for c in below)
        para[id(n)] = own * (in_p and not in_a) + sum(para[id(c)] for c in below)
        inner = sum(homes[id(c)] for c in below)
        homes[id(n)] = 1 if n.tag in ("article", "main") and text[id(n)] else inner
    all_text, all_para, all_homes = text[id(root)], para[id(root)], homes[id(root)]
    for n in nodes:
        if not n.hint or n.hint == "some":
            continue
        t, p, home = text[id(n)], para[id(n)], above.get(id(n.parent), (False, False, None))[2]
        if n.tag in ("article", "main"):
            stays = homes[id(n)] == all_homes and home is None
        elif n.hint == "weak" and (home is not None or not all_homes):
            stays = p and 2 * p >= t
        elif home is not None:
            stays = 10 * t >= 9 * text[id(home)]
        elif homes[id(n)] < all_homes:
            stays = False
        elif n.hint == "form" and 2 * t > all_text:
            stays = True
        else:
            stays = (10 * p >= 9 * all_para if n.hint == "comments" else 2 * p > all_para) if all_para else 10 * t >= 9 * all_text
        n.noise = not stays


def weigh(nodes: list[Node], body: Node) -> None:
    """Counts, composite densities and density sums; ``nodes`` with parents first."""
    for node in reversed(nodes):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if isinstance(c, Node) and not c.noise]
        node.chars = own + sum(c.chars for c in below)
        node.tags = len(below) + sum(c.tags for c in below)
        if node.tag == "a":
            node.link_chars, node.links = node.chars, 1 + sum(c.links for c in below)
        else:
            node.link_chars, node.links = sum(c.link_chars for c in below), sum(c.links for c in below)
        node.paragraphs = sum(c.paragraphs for c in below) or int(node.tag in PARAGRAPHS and 2 * node.link_chars < node.chars)
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if not node.chars:
            continue
        tags, links, link_chars = max(1, node.tags), max(1, node.links), max(1, node.link_chars)
        plain = max(1, node.chars - node.link_chars)
        base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
        ratio = max(1.0, node.chars / link_chars * tags / links)
        node.density = node.chars / tags * (math.log(ratio) / math.log(max(base, 1.0 + 1e-9)) if base > 1 + 1e-9 else math.log(ratio))
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.noise)


def _is_menu(node: Node) -> bool:
    return node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.links >= 3 and node.link_chars >= 0.9 * node.chars


def _is_thin(node: Node, around: Node) -> bool:
    """Whether a part with a doubtful name holds less text than is usual around it: unlinked characters a paragraph, weighed by the name."""
    if node.hint != "some" or node.paragraphs > 1 or node.tag in PARAGRAPHS or 2 * node.chars > around.chars:
        return False
    usual = (around.chars - around.link_chars) / max(1, around.paragraphs)
    return (node.chars - node.link_chars) * WEIGHTS[node.paragraphs] < usual


def _within(node: Node, top: Node | None) -> bool:
    while node is not None and node is not top:
        node = node.parent
    return node is not None


def _text_blocks(node: Node, keep) -> list[str]:
    """White space made one space, block by block; ``keep`` says of an element whether it is part of the text."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [node]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif not item.noise and keep(item):
            if item.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(item.children)
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a page: its blocks, joined by two line feeds; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    settle(root)
    nodes = _preorder(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    weigh(nodes, body)
    inner = [n for n in nodes if n.chars and not _is_menu(n)]
    if not inner:
        return ""
    # Text that lies in the body itself counts as its own child.
    best = max(inner, key=lambda n: n.total)
    if not best.total:
        best = max(inner, key=lambda n: n.density)
    way = [best]
    while way[-1].parent is not None and way[-1] is not body:
        way.append(way[-1].parent)
    threshold = min(n.density for n in way)
    home = next((n for n in way if n.tag in ("article", "main")), None)
    scope = home or way[-1]
    on_way = {id(n) for n in way}

    # All of the best subtree and of its article, lists of links too; around them, no menus, and beside the way, what is dense enough, and headings.
    chosen = home or (best if best is not body else None)

    def keep(node: Node) -> bool:
        if id(node) not in on_way and _is_thin(node, scope):
            return False
        if home is not None or id(node) in on_way:
            return True
        if _is_menu(node) and not _within(node, chosen):
            return False
        if id(node.parent) not in on_way or node.parent is best:
            return True
        return node.tag not in BLOCK or node.density >= threshold or node.tag in ("h1", "h2", "h3")

    return "\n\n".join(_text_blocks(scope, keep))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Columns page_id, url, text and n_chars (code points) for each row of ``pages``.

    A null or empty page has an empty text, so has one without main text; other nulls pass through. Repeated rows give equal rows. Other columns are not read.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
