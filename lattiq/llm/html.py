"""Main text of web pages by composite text density.

A lenient parser builds the DOM (implied end tags, raw-text elements, cut-off pages).  What never is running text
by its tag, role or style (menus, scripts, controls, hidden parts, ...) is cut; a form or fieldset is looked through
if it holds the main body, two blocks of running text, or all of the page's.  For each node that stays, the composite
text density is its characters per tag, adjusted for links:

    w * C/T * log(C/LC * T/LT) / log(b),  b = ln(C/nLC * LC + LCbody/Cbody * C + e) + e - 1

with C characters, T tags, LC characters and LT tags of links, nLC characters outside links.  The weight w is 0 in
what is a menu, advert, notice or reader comment by its names, and in threads of replies by their structure (like
items with a byline or a reply link each), unless it holds the page's main body by structure; else it is 1.

A node's density sum adds up its children's densities; the node of the greatest sum is chosen.  The threshold is the
least density on the path from it up to the body.  Content is: under each node that reaches the threshold, the
subtree of the greatest sum; the ancestors of the chosen node below the body as long as at least half of their
weighed text is content (so that short paragraphs and headlines beside it stay); a headline before it.  Inside
content a container goes only if its density is less than LEAST of what the same text would have without links
and names.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Attributes by the HTML rules: a quote opens a value only after "="; one that is never closed is a character.
_ATTRS = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})(>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_CUT = set("script style noscript template nav footer aside iframe button select option optgroup datalist textarea input label output svg math canvas object embed head title dialog menu video audio".split())
_ROLES = set("navigation banner complementary contentinfo search form menu menubar dialog alert alertdialog toolbar".split())
#: Names of what isn't article text.  A class or id counts if all its words are such names or say nothing of the content.
_NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar comment comments commentlist reply replies respond disqus social share sharing related recommended newsletter subscribe signup login pagination pager widget skip copyright".split()
)
_GENERIC = set(
    "area bar block bottom box buttons col column container content desktop div extra fixed form global group holder inner item items left links list main mobile module ol outer page panel post posts primary right section site slot sticky sub th thread top ul unit wrap wrapper".split()
)
#: Words of links and buttons under a reply.
_REPLY = set("reply antworten répondre responder report melden signaler denunciar permalink".split())
_BYLINE = set("author byline user username nickname commenter avatar posted".split())
_HEADLINES = {"h1", "h2", "h3"}
#: Share of its unadjusted density below which a container inside content goes.
LEAST = 0.1
#: Running text, and what is never cut for its links.
_PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre a td th tr tbody caption figcaption dt dd li body html article main".split())
#: Tags that are nodes of the density tree: blocks and links.
_NODES = (_BLOCK - {"br", "hr"}) | {"a"}
_FORMS = {"form", "fieldset"}
#: Characters from which a block's own text is running text.
_RUNNING = 60
_KEEP = {"html", "body", "article", "main"}
#: start tag -> open elements that it ends
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_P_ENDERS = _BLOCK - {"br", "button", "col", "colgroup", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "option", "select", "textarea", "title", "legend", "iframe", "noscript", "body", "head", "html"}
_SCOPE = {"table", "ul", "ol", "dl", "td", "th", "div", "section", "article", "body", "html", "aside", "main", "form", "blockquote", "button"}


class Node:
    __slots__ = ("tag", "attrs", "items", "chars", "tags", "link_chars", "link_tags", "weight", "density", "total", "up", "noise", "own", "running", "headed", "holds")

    def __init__(self, tag: str, attrs: str = "", up: Node | None = None):
        self.tag, self.attrs, self.up, self.items = tag, attrs, up, []


def parse(source: str) -> Node:
    """The tree of a page; text items are str, with references not yet decoded.  A tag that the page's end cuts off is dropped, or ends at its first ">" if it has one."""
    root = Node("html")
    at, n = 0, len(source)
    open_ = [root]
    while at < n:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            s = m.group()
            if not s.startswith(("<!", "<?")):
                open_[-1].items.append(s)
            elif s.startswith("<![CDATA["):
                open_[-1].items.append(s[9:-3] if s.endswith("]]>") else s[9:])
            continue
        tag = tag.lower()
        attrs = m.group(3)
        if not m.group(4):  # a quoted ">" may be its only end
            if (first := source.find(">", m.end(2))) < 0:
                break
            attrs, at = source[m.end(2) : first], first + 1
        if m.group(1):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
                if tag == "p" and open_[k].tag in _SCOPE:
                    break
            continue
        if tag in ("html", "body") and (tag == "html" or any(x.tag == "body" for x in open_)):
            continue
        if tag in _P_ENDERS:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    del open_[k:]
                    break
                if open_[k].tag in _SCOPE:
                    break
        if ends := _ENDS.get(tag):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in ends:
                    del open_[k:]
                    if tag != "tr":
                        break
                elif open_[k].tag in _SCOPE - ends:
                    break
        node = Node(tag, attrs, open_[-1])
        open_[-1].items.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            node.items.append(source[at : end.start() if end else n])
            at = end.end() if end else n
        elif not attrs.endswith("/") or tag in _BLOCK or tag == "a":
            open_.append(node)
    return root


def _is_noise(node: Node) -> int:
    """2: never text; 1: by its names, unless it holds the page's main body; 3: a form, unless it holds running text; 0: not."""
    if node.tag in _CUT:
        return 2
    kind = 3 * (node.tag in _FORMS)
    if node.tag == "header":  # of the page, not of an article
        up = node.up
        while up is not None:
            if up.tag in ("article", "main", "section"):
                return 0
            up = up.up
        return 2
    if not node.attrs or node.tag in _KEEP:
        return kind
    named = False
    for k, v in _attributes(node):
        if k in ("class", "id"):
            named = named or any(_named(x) for x in v.split())
        elif k == "role" and v.lower() in _ROLES:
            return 2
        elif k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I)):
            return 2
    return 1 if named else kind


@lru_cache(1 << 14)
def _named(name: str) -> bool:
    """Whether one class or id says that a node isn't article text: "ad-slot", "siteFooter"; not "notice-of-award"."""
    words = _words(name)
    return not words.isdisjoint(_NOISE) and words <= _NOISE | _GENERIC


def _words(names: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))


def _attributes(node: Node) -> list[tuple[str, str]]:
    return [(k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(node.attrs)]


def _is_main(node: Node) -> bool:
    """Whether a node is the page's main body by its tag, role or property.

    An article counts with a headline of its own, or where it stands in no list and no other article and has no
    name of noise: comments are articles too.
    """
    if node.tag == "main":
        return True
    if node.tag == "article":
        if node.headed:
            return True
        if node.attrs and any(_named(x) for k, v in _attributes(node) if k in ("class", "id") for x in v.split()):
            return False
        up = node.up
        while up is not None and up.tag not in ("li", "ol", "ul", "article"):
            up = up.up
        return up is None
    return bool(node.attrs) and any((k == "role" and v.lower() == "main") or (k == "itemprop" and v.lower() == "articlebody") for k, v in _attributes(node))


def _structure(order: list[Node]) -> None:
    """For each node: characters of its own text, blocks of running text, whether it has a headline, and whether it holds a main body.

    A main body is an element that says so, or a headline with two blocks of running text or more.  What stands in
    a node that is noise by its names isn't seen from outside of it.
    """
    for x in reversed(order):
        x.own = x.running = 0
        x.headed = x.holds = False
        if x.noise == 2:
            continue
        for c in x.items:
            if isinstance(c, str):
                x.own += len(c) - c.count(" ") - c.count("\n")
            elif c.noise in (0, 3):
                if c.tag not in _NODES:
                    x.own += c.own
                x.running += c.running
                x.headed |= c.headed
                x.holds |= c.holds
        x.running += x.tag in _BLOCK and x.own >= _RUNNING
        x.headed |= x.tag == "h1" and x.own > 0
        x.holds = x.holds or _is_main(x) or (x.headed and x.running >= 2 and x.tag not in ("article", "section"))


def _in_article(x: Node) -> bool:
    up = x.up
    while up is not None and up.tag != "article":
        up = up.up
    return up is not None


def _measure(root: Node) -> list[Node]:
    """Counts characters and tags bottom-up; returns the nodes in page order."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        x.noise = _is_noise(x)
        order.append(x)
        if x.noise != 2:
            todo.extend(c for c in reversed(x.items) if isinstance(c, Node))
    _count(order)
    return order


def _count(order: list[Node]) -> None:
    for x in reversed(order):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        if x.noise == 2:
            continue
        for c in x.items:
            if isinstance(c, str):
                x.chars += len(c) - c.count(" ") - c.count("\n")
            elif c.noise != 2:
                x.chars += c.chars
                x.tags += c.tags + (c.tag in _NODES)
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, 1


def _children(x: Node) -> list[Node]:
    """Child nodes that are counted; inline formatting is looked through."""
    out: list[Node] = []
    todo = list(reversed(x.items))
    while todo:
        c = todo.pop()
        if not isinstance(c, str) and c.noise != 2:
            if c.tag in _NODES:
                out.append(c)
            else:
                todo.extend(reversed(c.items))
    return out


def _density(x: Node, linked: float, adjusted: bool = True) -> float:
    """Composite text density; not adjusted: as if without links and names."""
    if not x.chars or (adjusted and not x.weight):
        return 0.0
    links, link_tags = (x.link_chars, x.link_tags) if adjusted else (0, 0)
    tags = max(1, x.tags)
    base = log(log(x.chars / max(1, x.chars - links) * links + linked * x.chars + e) + e - 1)
    return x.chars / tags * log(max(1.0, x.chars / max(1, links) * tags / max(1, link_tags))) / base


def _is_reply(x: Node) -> bool:
    """Whether a node has the byline or the controls of a reply, and no headline."""
    todo, found = [x], False
    while todo:
        c = todo.pop()
        if c.tag in _HEADLINES:
            return False
        found = found or c.tag in ("time", "cite") or (bool(c.attrs) and any(not _BYLINE.isdisjoint(_words(v)) for k, v in _attributes(c) if k in ("class", "rel", "itemprop")))
        if not found and c.tag in ("a", "button"):
            found = any(isinstance(t, str) and _words(t) and _words(t) <= _REPLY for t in c.items)
        todo.extend(t for t in c.items if isinstance(t, Node))
    return found


def _is_thread(x: Node) -> bool:
    """Whether a node's blocks are two replies or more of one kind."""
    kinds: dict[tuple[str, str], list[Node]] = {}
    for c in x.items:
        if isinstance(c, Node) and c.tag in ("li", "div", "article", "section", "dd", "blockquote", "tr") and c.noise in (0, 1) and c.chars:
            name = " ".join(sorted(v for k, v in _attributes(c) if k == "class")) if c.attrs else ""
            kinds.setdefault((c.tag, name), []).append(c)
    return any(len(k) > 1 and all(map(_is_reply, k)) for k in kinds.values())


def _weigh(body: Node, order: list[Node]) -> None:
    """Weights: 0 in named nodes and threads, else 1; where nothing else has text, threads count as text."""
    for by_thread in (True, False):
        left = 0
        for x in order:
            x.weight = int(x is body or x.up is None or x.up.weight) if x.noise not in (1, 2) else 0
            if x.weight and by_thread and x is not body and not x.holds and _is_thread(x):
                x.weight = 0
            if x.weight:
                left += sum(len(c) - c.count(" ") - c.count("\n") for c in x.items if isinstance(c, str))
        if left:
            return


def _content(body: Node) -> set[int]:
    """Marks of the nodes whose subtrees are content."""
    linked = body.link_chars / body.chars
    live, kids, todo = [], {}, [body]
    while todo:
        x = todo.pop()
        live.append(x)
        kids[id(x)] = _children(x)
        todo.extend(reversed(kids[id(x)]))
    best: dict[int, Node] = {}
    for x in reversed(live):
        x.density = _density(x, linked)
        own = kids[id(x)]
        x.total = sum(c.density for c in own) or x.density
        best[id(x)] = max([x, *(best[id(c)] for c in own)], key=lambda c: c.total)
    top = best[id(body)]
    path, x = [], top
    while x is not None and x is not body.up:
        if x.tag in _NODES:
            path.append(x)
        x = x.up
    threshold = min(x.density for x in path)
    marked = {id(best[id(x)]) for x in live if x.density >= threshold and x.chars}
    marked.add(id(top))
    # ancestors that are content for the most part
    held: dict[int, int] = {}
    text: dict[int, int] = {}
    for x in reversed(live):
        own = x.chars - sum(c.chars for c in kids[id(x)])
        text[id(x)] = (own + sum(text[id(c)] for c in kids[id(x)])) if _density(x, linked) else 0
        held[id(x)] = text[id(x)] if id(x) in marked else own + sum(held[id(c)] for c in kids[id(x)])
    for x in path:
        if x is body or 2 * held[id(x)] < text[id(x)]:
            break
        marked.add(id(x))
    for x in path:  # a headline before the chosen subtree
        if x.up is not None and x is not body:
            for c in kids.get(id(x.up), ()):
                if c is x:
                    break
                if c.tag == "h1":
                    marked.add(id(c))
    for x in live:  # menus and adverts inside
        if x.tag not in _PROSE and x.density < LEAST * _density(x, linked, False):
            x.noise = 2
    return marked


def main_text(source: str) -> str:
    root = parse(source)
    order = _measure(root)
    # a node that holds the main body keeps its weight whatever its names; so does a form around the text
    for x in order:
        x.holds = False
    doubtful = [x for x in order if x.noise in (1, 3)]
    if doubtful:
        _structure(order)
        elsewhere = root.holds
        for x in doubtful:
            if x.noise == 1:
                x.noise = 0 if x.holds and not elsewhere and not _in_article(x) else 1
            else:
                x.noise = 0 if x.holds or x.running >= 2 or (x.running and x.running == root.running) else 2
        _count(order)
    body = next((x for x in order if x.tag == "body" and x.noise != 2), root)
    if not body.chars:
        return ""
    _weigh(body, order)
    marked = _content(body)
    out: list[str] = []

    def walk(x: Node, inside: bool) -> None:
        stack = [(x, inside, iter(x.items))]
        if x.tag in _BLOCK:
            out.append(" ")
        while stack:
            node, own, items = stack[-1]
            for c in items:
                if isinstance(c, Node):
                    if c.noise == 2:
                        if c.tag in _BLOCK:
                            out.append(" ")
                        continue
                    if c.tag in _BLOCK:
                        out.append(" ")
                    stack.append((c, own or id(c) in marked, iter(c.items)))
                    break
                elif own:
                    out.append(html.unescape(c))
            else:
                stack.pop()
                if node.tag in _BLOCK:
                    out.append(" ")

    walk(body, id(body) in marked)
    return " ".join("".join(out).split())


def _extract(batches):
    for b in batches:
        texts = [main_text(h or "") for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages; null, empty or textless html gives an empty text.

    Repeated rows are extracted each, nulls in page_id or url stay, other columns are ignored; no rows give no rows.
    """
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select("page_id", "url", "html").mapInArrow(_extract, schema)
