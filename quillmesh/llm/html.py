"""Main text of web pages by scoring the element tree.

Paragraphs pass points for their length and commas to their parent and, halved, to each further ancestor; a container's
score is discounted by its link density. The best container and the siblings that score near it, read like text or are
headings, code or quotes are kept, without menus, notices, adverts, forms and comments. An element that looks like one of
these and holds the page's article or most of its text is a wrapper, and stays; hidden elements and comments never do.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import by_value, chunks, small_batches

#: A mark's beginning, and what follows a tag's name with its quoted values, as far as the first bare end.
MARK = re.compile(r"<(?:(?P<comment>!--)|[!?]|(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*))")
INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, and no text of the page.
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
DROP = frozenset("nav footer aside form button select option datalist svg canvas audio video menu dialog template fieldset head picture annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr"}, "tfoot": {"tr", "td", "th", "tbody"}}
LISTS = ("table", "ul", "ol", "dl", "select")
STOPS = frozenset("table ul ol dl html body article section div main".split())
NOT_TEXT = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertise(?:ment)?s?|adsense|sponsor(?:ed|s)?|promos?|promoted|promotion|banner|cookies?|consent|gdpr|notices?|notifications?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|paywall|sidebars?|side-?bar|rail|menus?|nav|navbar|navigation|breadcrumbs?|masthead|site-?header|page-?header|header|footer|comments?|commentlist|disqus|respond|replies|share|sharing|social|related|recommended|recommendations|widgets|widget-area|toolbar|pagination|pager|login|signup|search|skip-?link|hidden|sr-only|tags)(?:$|[\s_-])")
#: Names that tell how a page or its article is laid out, not what an element is.
LAYOUT = re.compile(r"(?i)(?<![^\s_-])(?:(?:has|no|with|without|overflow)[_-]\S+|(?:entry|post|article|content|story)[_-]header(?!\S))")
#: Texts beside the main one, however long.
ASIDE_TEXT = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|related|recommended|recommendations|hidden|sr-only)(?:$|[\s_-])")
#: Elements that may turn out to be wrappers.
WRAPPERS = frozenset("nav footer aside form menu dialog fieldset header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
KEEP_ALWAYS = frozenset("html body article main".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body".split())
MIN_PARAGRAPH = 25
SIBLING_SHARE = 0.2
QUOTED = frozenset("h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: What is known of an element by its name and attributes: LOOKS is no main text unless it turns out to be a wrapper.
TEXT, LOOKS, NEVER = 0, 1, 2


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, drop: int = TEXT):
        self.tag, self.parent, self.children, self.drop, self.score, self.chars, self.linked = tag, parent, [], drop, 0.0, 0, 0


def is_furniture(tag: str, attributes: str) -> int:
    """Whether an element's name or attributes mark it as no part of the main text: TEXT, LOOKS or NEVER."""
    found = TEXT
    if tag in DROP:
        found = LOOKS if tag in WRAPPERS else NEVER
    if found == NEVER or not attributes or attributes.isspace() or tag in KEEP_ALWAYS:
        return found
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and NOT_TEXT.search(value):
            value = LAYOUT.sub("", value)
            if NOT_TEXT.search(value):
                found = NEVER if ASIDE_TEXT.search(value) else max(found, LOOKS)
        if name == "role" and value.lower() in ROLES:
            found = max(found, LOOKS)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return NEVER
        if name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return NEVER
        if found == NEVER:
            return NEVER
    return found


def tokens(html: str):
    """Texts, and tags as (name, closing, attributes, end), in page order; time is in proportion to the page's length.

    A tag ends at the first bare `>`. Where quotes leave none, it ends at the first `>` of any kind, and so do all later
    tags, so that a broken quote is looked for once. A mark that has no `>` after it is text, like the rest of the page.
    """
    at, from_, end, quotes = 0, 0, len(html), True
    while (m := MARK.search(html, at)) is not None:
        if m["comment"]:
            close = html.find("-->", m.end())
            stop = close + 3 if close >= 0 else end
        else:
            close = html.find(">", m.end())
            if close < 0:
                break
            if quotes and m["name"]:
                close = INSIDE.match(html, m.end()).end()
                if html[close : close + 1] != ">":
                    quotes, close = False, html.find(">", m.end())
            stop = close + 1
        if m.start() > from_:
            yield html[from_ : m.start()]
        at = from_ = stop
        if m["name"]:
            skip = yield m["name"].lower(), bool(m["close"]), html[m.end() : close], stop
            if skip is not None:
                at = from_ = skip
                yield None
    if from_ < end:
        yield html[from_:]


def raw_end(html: str, tag: str, at: int) -> int:
    """Where an element whose content is no markup ends, or the end of the page."""
    m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
    close = html.find(">", m.end()) if m else -1
    return close + 1 if close >= 0 else len(html)


class Open:
    """The open elements: a stack, where it has each tag, and where it has elements that tags don't reach beyond."""

    def __init__(self, root: Node):
        self.stack, self.at, self.stops = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in STOPS:
            self.stops.append(len(self.stack))
        self.stack.append(node)

    def cut(self, n: int) -> None:
        """Close all elements from the n-th on."""
        while len(self.stack) > n:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in STOPS:
                self.stops.pop()

    def last(self, tag: str) -> int:
        """Where the innermost open element of this tag is, or 0."""
        found = self.at.get(tag)
        return found[-1] if found else 0

    def within(self, tag: str) -> int:
        """The same, if no element that tags don't reach beyond is above it in the stack."""
        n = self.last(tag)
        return n if not self.stops or self.stops[-1] <= n else 0


def parse(html: str) -> Node:
    """The element tree, forgiving: unclosed and stray tags, raw elements, comments; nesting of any depth."""
    root = Node("html", None)
    opened, stream = Open(root), tokens(html)
    for x in stream:
        here = opened.stack[-1]
        if isinstance(x, str):
            here.children.append(x)
            continue
        tag, closing, attributes, stop = x
        if closing:
            if n := opened.last(tag) if tag in STOPS or tag in BLOCK else opened.within(tag):
                opened.cut(n)
            elif tag == "br":
                here.children.append(Node("br", here))
            continue
        if tag in ("html", "body") and here is root:
            continue
        if tag in RAW:
            stream.send(raw_end(html, tag, stop))
            continue
        if tag in BLOCK and (n := opened.within("p")):  # an open paragraph ends at the next block
            opened.cut(n)
        if ends := CLOSES.get(tag):
            bound = max(opened.last(t) for t in LISTS)
            first = [a[i] for t in ends if (a := opened.at.get(t)) and (i := bisect_right(a, bound)) < len(a)]
            if first:
                opened.cut(min(first))
        here = opened.stack[-1]
        in_text = tag == "header" and not opened.last("article") and not opened.last("main")
        new = Node(tag, here, max(LOOKS if in_text else TEXT, is_furniture(tag, attributes)))
        here.children.append(new)
        if tag not in VOID and not attributes.endswith("/"):
            opened.push(new)
    return root


def spare_wrappers(root: Node) -> None:
    """Keep what only looks like furniture but holds the page's largest article or main, or most of its running text."""
    order, stack, dropped = [], [(root, False, False)], False
    while stack:
        node, link, out = stack.pop()
        order.append((node, link, out))
        dropped = dropped or node.drop == LOOKS
        stack += [(c, link or c.tag == "a", out or c.drop == LOOKS) for c in node.children if isinstance(c, Node) and c.drop != NEVER]
    if not dropped:
        return
    mass, inside, kept = {}, {}, -1
    for node, link, out in reversed(order):
        # mass: characters of running text without links; inside: the most that an article or main in the node has
        mass[node] = mass.get(node, 0) + (0 if link else sum(len(c.strip()) for c in node.children if isinstance(c, str) and len(c.strip()) >= MIN_PARAGRAPH))
        if node.tag in ("article", "main"):
            inside[node] = max(mass[node], inside.get(node, -1))
            if not out:
                kept = max(kept, mass[node])
        if node.parent is not None:
            mass[node.parent] = mass.get(node.parent, 0) + mass[node]
            if node in inside:
                inside[node.parent] = max(inside.get(node.parent, -1), inside[node])
    largest = max(inside.values(), default=-1)
    for node, _, _ in order:
        if node.drop == LOOKS and (inside.get(node, -1) == largest > kept or 2 * mass[node] > mass[root]):
            node.drop = TEXT


def score(root: Node) -> list[Node]:
    """Containers with points, in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append((node, link))
        for c in node.children:
            if isinstance(c, Node) and not c.drop:
                stack.append((c, link or c.tag == "a"))
    own: dict[int, str] = {}
    for node, link in reversed(order):
        text = " ".join(unescape("".join(c if isinstance(c, str) else " " for c in node.children)).split())
        node.chars += len(text)
        node.linked += len(text) if link else 0
        own[id(node)] = text
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    found: dict[int, Node] = {}
    for node, _ in order:
        if node.tag in PARAGRAPH and node.chars - node.linked >= MIN_PARAGRAPH:
            direct = node.tag not in ("div", "section", "article", "main", "body")
            length = node.chars if direct else len(own[id(node)])
            if length < MIN_PARAGRAPH:
                continue
            commas = sum(own[id(node)].count(c) for c in ",،、，")
            points = (1 + commas + min(length / 100, 3)) * (1 - node.linked / max(1, node.chars))
            to, share = (node if not direct else node.parent), 1.0
            while to is not None and share > 0.01:
                to.score += points * share
                found[id(to)] = to
                to, share = to.parent, share / 2
    for node in found.values():
        node.score *= 1 - node.linked / max(1, node.chars)
    return [n for n, _ in order if id(n) in found]


def best_nodes(root: Node) -> list[Node]:
    """The best container with the siblings that belong to it, in page order."""
    spare_wrappers(root)
    scored = score(root)
    best = max(scored, key=lambda n: n.score, default=None)
    if best is None or best is root:
        marked = [n for n in walk(root) if n.tag in ("article", "main")]
        best = max(marked, key=lambda n: n.chars, default=best or root)
    above = best
    for tag in ("article", "main"):  # the container's own article holds its headings
        node = above
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and not node.drop:
            best = node
            break
    if best.parent is None:
        return [best]
    keep = []
    for c in best.parent.children:
        if c is best:
            keep.append(c)
        elif isinstance(c, Node) and not c.drop and best.tag in ("article", "main"):
            if c.tag == best.tag and c.score >= SIBLING_SHARE * best.score:  # another article of the page, no teaser
                keep.append(c)
        elif isinstance(c, Node) and not c.drop:
            density = c.linked / max(1, c.chars)
            if c.score >= max(5, SIBLING_SHARE * best.score) or c.tag == "p" and (c.chars > 80 and density < 0.25 or 0 < c.chars <= 80 and density == 0) or c.tag in QUOTED and c.chars > 0 and density < 0.25:
                keep.append(c)
    return keep


def walk(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]


def blocks(nodes: list[Node]) -> list[str]:
    """Texts between block boundaries, with references decoded and white space as single spaces."""
    out, run = [], []

    def end():
        if text := " ".join(unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.drop:
            continue
        elif x.tag in ("br", "wbr", "img"):
            run.append("" if x.tag == "wbr" else " ")
        else:
            block = x.tag in BLOCK
            if block:
                end()
                stack.append(None)
            stack += reversed(x.children)
    end()
    return out


def main_text(html: str | None) -> str:
    """The main text of a whole page; null and empty pages have none."""
    return "\n\n".join(blocks(best_nodes(parse(html)))) if html else ""


def extract_batches(batches):
    for batch in batches:
        for part in chunks(batch, "html"):
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each page, repeated rows included.

    A null or empty page has an empty text; ids and URLs may be null; further columns are ignored; no rows give no rows.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")


by_value(__name__)
