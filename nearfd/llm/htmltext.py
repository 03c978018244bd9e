"""Main text of web pages by composite text density.

Every page is parsed to a small element tree.  An element's density is its characters per tag, adjusted for links:
``C / T * log_b((C / LC) * (T / LT))`` with ``b = ln(C * LC / (C - LC) + C * LC_body / C_body + e)``, where C and T
count characters and tags, LC and LT those in links (0 counts as 1); inline markup other than links is no tag.  The element with the largest sum of its
children's densities leads to the article: if it is a list, a table or another part, the article, main, div or cell
around it is taken, and all of that container's text is kept in page order.  The smallest density on the path to the
body is the threshold for further blocks beside the container; where no article or main is marked up, running text
beside it is kept whatever its density.  Elements that by tag, role or class are menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments hold no text and are left out before.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "object", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
         "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
         "th", "thead", "tr", "ul"}
# closed by the start of the named elements
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
        "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select", "datalist"}}
# tags that hold running text; beside the article they are kept unless most of their text is links
FLOW = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "figure"}
LEFT_OUT = {"nav", "aside", "footer", "form", "menu", "select", "button", "dialog", "head", "audio", "video", "canvas",
            "datalist", "fieldset"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar",
         "alertdialog", "toolbar", "status"}
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adv|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|"
    r"side|aside|footer|foot|masthead|header|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|"
    r"login|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|reply|respond|widget|toolbar|"
    r"pagination|pager|skip|search|copyright|legal|disclaimer)(?:$|[-_\s\d])", re.I)
# names of parts as whole tokens: all that counts inside an article or main, and for tags of running text
PARTS = re.compile(
    r"^(?:(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*)(?:[-_](?:slot|unit|box|block|container|wrapper|banner|label))?|"
    r"banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|footer|masthead|notice|cookies?|consent|gdpr|popup|modal|"
    r"(?:cookie|newsletter|subscribe|signup|login)(?:[-_](?:form|box|bar|banner|notice|consent))?|"
    r"(?:share|sharing|social)(?:[-_](?:buttons?|bar|links?|icons?|tools?|media|share))?|"
    r"(?:related|recommended)(?:[-_](?:posts?|articles?|links?|stories|content|news|pages?))?|"
    r"(?:comments?|commentlist|disqus|replies|respond)(?:[-_](?:area|list|section|thread|wrap|wrapper|container|form))?|"
    r"widget|toolbar|pagination|pager)$", re.I)
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "td", "th", "dd", "dt"}
STATES = re.compile(r"(?:^|[-_])(?:has|no|not|with|without)[-_]", re.I)  # such a token tells of a state
HEADERS = re.compile(r"(?:^|[-_])header(?:$|[-_\d])", re.I)
TITLES = re.compile(r"^(?:post|entry|article|story)[-_]+header(?:$|[-_\d])", re.I)
COMMENTS = re.compile(r"^(?:comments?|commentlist|disqus|replies|respond)(?:[-_](?:area|list|section|thread|wrap|wrapper|container))?$", re.I)


class Node:
    """``named``: 1 if class or id name a part that is left out, 2 for reader comments."""

    __slots__ = ("tag", "parent", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total", "named")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.kids = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.named = 0


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(tag: str, attributes: str, in_article: bool) -> int:
    """Whether a token of class or id names a part that is left out: 0, 1, or 2 for reader comments.

    Tokens that tell of a state (has-sidebar, no-comments) name nothing; headers of an article are kept like
    ``<header>`` in it.  Inside an article or main element, and for tags of running text, only a whole token names a
    part (share-buttons, but not share-prices); the id of a heading or paragraph is an anchor.
    """
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    out = 0
    for m in ATTRIBUTE.finditer(attributes):
        if m.group(1).lower() not in (("class",) if tag in TEXTUAL else ("class", "id")):
            continue
        for token in (m.group(2) or m.group(3) or m.group(4) or "").split():
            if in_article or tag in TEXTUAL:
                out = max(out, 0 if not PARTS.search(token) else 2 if COMMENTS.search(token) else 1)
                continue
            if not NAMES.search(token) or STATES.search(token):
                continue
            if HEADERS.search(token) and (in_article or TITLES.search(token)) and not NAMES.search(HEADERS.sub("-", token)):
                continue
            out = max(out, 2 if COMMENTS.search(token) else 1)
    return out


def _prune(root: Node) -> None:
    """Take out the elements that class or id name, but not wrappers of the page's text.

    A wrapper holds the main element or the page's longest article; without either, more than half of the page's
    text and is no list of comments.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node)]
    if not any(x.named for x in order):
        return
    size: dict[int, int] = {}
    for x in reversed(order):
        size[id(x)] = sum(len("".join(k.split())) if isinstance(k, str) else size[id(k)] for k in x.kids)

    commented: set[int] = set()  # parents come before their children
    for x in order:
        if x.named == 2 or x.parent is not None and id(x.parent) in commented:
            commented.add(id(x))
    marked = [x for x in order if x.tag in ("main", "article") and size[id(x)] and id(x) not in commented]
    text = max(marked, key=lambda x: (x.tag == "main", size[id(x)]), default=None)
    wrappers = set()
    while text is not None:
        wrappers.add(id(text))
        text = text.parent
    gone, parents = set(), {}
    for x in order:
        whole = id(x) in wrappers if marked else x.named == 1 and size[id(x)] * 2 > size[id(root)]
        if x.named and not whole:
            gone.add(id(x))
            parents[id(x.parent)] = x.parent
    for x in parents.values():
        x.kids = [k for k in x.kids if id(k) not in gone]


def tokens(page: str):
    """``(text from, text to, end tag, name, attributes)``: the text before each tag, then the tag.

    Comments and declarations are tags without a name; a tag that the page ends in is dropped with what follows.  Quotes
    hide ``>`` if they are closed and a ``>`` follows outside of them; else the tag ends at its first ``>``.  Places
    from which no end was found are remembered, so every place is passed a bounded number of times.  A place that is sent
    to the generator is where it goes on.
    """
    n, last, dead = len(page), page.rfind(">"), set()
    pos = at = 0

    def end_of(i: int) -> int:
        path = []
        while i not in dead:
            path.append(i)
            m = STOP.search(page, i) if i <= last else None
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            close = page.find(m[0], m.end())
            if close < 0:
                break
            i = close + 1
        dead.update(path)
        return -1

    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            yield pos, n, False, "", ""
            return
        jump = None
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield pos, lt, False, "", ""
            pos = at = n if end < 0 else end + 3
            continue
        ends = page[lt + 1] == "/"
        name = NAME.match(page, lt + 1 + ends)
        if name is None and page[lt + 1] not in "!?/":
            at = lt + 1  # a plain sign
            continue
        if lt > last:  # nothing closes it
            yield pos, lt, False, "", ""
            return
        if name is None:
            end = page.find(">", lt)
            yield pos, lt, False, "", ""
        else:
            end = end_of(name.end())
            end = page.find(">", name.end()) if end < 0 else end
            jump = yield pos, lt, ends, name[0].lower(), page[name.end():end]
        pos = at = end + 1 if jump is None else jump(end + 1)


def _raw_end(page: str, after: int, tag: str) -> int:
    """Where the element ends whose content is no markup."""
    m = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(page, after)
    end = page.find(">", m.end()) if m else -1
    return end + 1 if end >= 0 else len(page)


def parse(page: str) -> Node:
    """Element tree; text is kept as strings among an element's ``kids``."""
    root = Node("#page", None)
    stack, skip = [root], None  # skip: the element that is being left out
    depths: dict[str, list[int]] = {}  # places in the stack by tag

    def depth(*tags: str) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=-1)

    def close(to: int) -> None:
        nonlocal skip
        while len(stack) > to:
            node = stack.pop()
            depths[node.tag].pop()
            if node is skip:
                skip = None

    found, jump = tokens(page), None
    while True:
        try:
            lo, hi, ends, tag, attributes = found.send(jump)
        except StopIteration:
            break
        jump = None
        if hi > lo and skip is None:
            stack[-1].kids.append(page[lo:hi])
        if not tag:
            continue
        if ends:
            i = depth(tag)
            barrier = -1 if tag in ("body", "html", "article", "main", "div", "section", "table") else depth("article", "table", "body")
            if i > barrier:
                close(i)
            continue
        for open_tag, by in ENDS.items():
            if tag in by and (i := depth(open_tag)) > depth(*SCOPE.get(open_tag, ("table", "td", "th", "button", "caption"))):
                close(i)
        if tag in RAW:
            jump = lambda after, tag=tag: _raw_end(page, after, tag)
            continue
        inside = depth("article", "main") >= 0
        node = Node(tag, stack[-1])
        if skip is None:
            stack[-1].kids.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag == "body" and skip is not None and skip.tag == "head":
            skip = None
            node.parent = root
            root.kids.append(node)
        elif skip is None and _left_out(tag, attributes, inside):
            node.parent.kids.pop()
            skip = node
        elif skip is None:
            node.named = _named(tag, attributes, inside)
        depths.setdefault(tag, []).append(len(stack))
        stack.append(node)
    _prune(root)
    return root


def _subtree(top: Node) -> list[Node]:
    """All elements of a subtree, children before parents."""
    order, stack = [], [top]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node)]
    return order[::-1]


def _measure(root: Node) -> list[Node]:
    """Counts, densities and sums of all elements, children before parents."""
    order = _subtree(root)
    for node in order:
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len("".join(k.split()))
            else:
                node.chars += k.chars
                node.tags += k.tags + (k.tag in BLOCK or k.tag == "a")
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    whole = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c * node.link_chars / max(c - node.link_chars, 1) + whole * c + math.e)
            inner = (c / lc) * (t / lt)
            node.density = c / t * (math.log(inner) / math.log(base) if base > 1 + 1e-9 else math.log(max(inner, 1)))
            node.density = max(node.density, 0.0)
        node.total = sum(k.density if k.tag in BLOCK or k.tag == "a" else k.total for k in node.kids if isinstance(k, Node))
    return order


def _blocks(nodes: list, out: list[str]) -> None:
    """Texts of the blocks of subtrees in page order."""
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = nodes[::-1]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        else:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            elif x.tag == "br":
                line.append(" ")
            stack += reversed(x.kids)
    flush()


def main_text(page: str | None) -> str:
    """Main text of one page; blocks joined by a line feed, empty for an empty page."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    bodies = [x for x in order if x.tag == "body"]
    body = bodies[-1] if bodies and bodies[-1].chars * 2 >= root.chars else root
    inside = order if body is root else _subtree(body)
    if not body.chars:
        return ""
    best = max((x for x in reversed(inside) if x.tag in BLOCK or x is body), key=lambda x: (x.total, x.chars))
    if not best.total:
        best = body
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    at = _container(path)
    marked = path[at].tag in ("article", "main")
    chosen, on_path = {id(path[at])}, {id(x) for x in path[at:]}
    for node in path[at + 1:]:
        for k in node.kids:
            if id(k) in on_path:
                continue
            if isinstance(k, Node) and (k.tag in ("h1", "h2") or k.tag in BLOCK and k.density >= threshold and k.link_chars * 3 <= k.chars):
                chosen.add(id(k))
            elif not marked and _flows(k):
                chosen.add(id(k))
    out: list[str] = []
    line: list = []  # strings and inline elements beside the container, up to the next block

    def flush() -> None:
        if line:
            _blocks(line, out)
            line.clear()

    stack = [body]
    while stack:
        x = stack.pop()
        if id(x) in chosen and not (isinstance(x, Node) and x.tag in BLOCK or x is path[at]):
            line.append(x)
            continue
        flush()
        if id(x) in chosen:
            _blocks([x], out)
        elif id(x) in on_path:
            stack += reversed(x.kids)
    flush()
    return "\n".join(out)


def _flows(x: Node | str) -> bool:
    """Running text: a string, an inline element or a text block, if no more than half of it is links."""
    if isinstance(x, str):
        return bool(x.strip())
    return (x.tag in FLOW or x.tag not in BLOCK) and x.chars > 0 and x.link_chars * 2 <= x.chars


def _container(path: list[Node]) -> int:
    """Index in ``path`` (best element first, body last) of the element whose text is all kept.

    The outermost article, else the main element; else the nearest div, cell with blocks or body, and from there on
    every div around it that holds running text of its own and is not rich in links.
    """
    for tag in ("article", "main"):
        found = [i for i, x in enumerate(path) if x.tag == tag]
        if found:
            return found[-1]

    def holds(x: Node) -> bool:
        return x.tag in ("div", "center", "body", "#page") or x.tag in ("td", "th") and any(
            isinstance(k, Node) and k.tag in BLOCK for k in x.kids)

    at = next((i for i, x in enumerate(path) if holds(x)), len(path) - 1)
    for i in range(at + 1, len(path) - 1):
        x = path[i]
        others = [k for k in x.kids if k is not path[i - 1] and (k.strip() if isinstance(k, str) else k.chars)]
        if x.tag == "div" and x.link_chars * 3 <= x.chars and any(_flows(k) for k in others):
            at = i
        elif others:
            break
    return at


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url, text, n_chars``, one row per input row.

    A null or empty page, and one without text outside the left-out elements, has the empty text.  Broken
    markup is read as far as it goes; repeated rows are extracted each; other columns are ignored.  Nothing is
    shuffled: one page is one step of a task.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long").withColumnRenamed("page_id", id_col)
