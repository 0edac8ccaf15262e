"""HTML extraction by a tree-structured graphical model.

Every DOM node has a label: 1 for content and for what holds content, 0 for the rest. Node potentials come from features of the node (tag, words of class and id,
share of text in links, amount of text; siblings that are alike share one vote, so that many short paragraphs do not
outvote the article that they stand in), edge potentials connect parent and child by the kind of the child. Sum-product
messages passed up and down the tree give each node's exact content marginal; text whose nearest element is content
belongs to the main text. The weights are learned from labelled pages by gradient ascent on the log-likelihood (expected
minus observed features come from the same marginals). The labelled pages are drawn from a grammar of page layouts,
``PAGES`` of them, from a fixed seed.

Cases: null or empty html gives an empty text. Broken markup is read as browsers do for the cases that pages have:
unclosed paragraphs and list items end where the next one begins, stray end tags are passed over, the rest closes at the
end; end tags may have attributes, unquoted values may hold quotes, and a quote that nothing closes ends with its tag.
Scripts, styles, titles and text fields are skipped; svg, template and noscript are elements without content. One
forward pass reads a page, so pages may be of any length. Repeated rows are read each. Extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import map_batches

PAGES = 600
EPOCHS = 16
# Most tags: quotes only right behind an equals sign, and no bracket inside them. It never steps back.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|(?<==)\"[^\"<>]*+\"|(?<==)'[^'<>]*+')*+)>")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
HIDDEN = {"noscript", "template", "svg"}
_RAW_END = {x: re.compile(f"</{x}(?=[\\s/>])", re.I) for x in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "img", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Tree:
    """Nodes in page order: parent, tag, attribute words; and the text pieces, each with its element and its block."""

    __slots__ = ("parent", "tag", "names", "pieces", "own", "linked", "hidden")

    def __init__(self):
        self.parent, self.tag, self.names, self.pieces, self.own, self.linked, self.hidden = [-1], ["#root"], [()], [], [0], [0], [False]


def _slow_tag(page: str, at: int, missing: set[str]):
    """A tag with unusual quotes: (slash, name, attributes, end), or None where it never ends; each quote is looked for once."""
    m = _OPEN.match(page, at)
    pos = m.end()
    while stop := _STOP.search(page, pos):
        pos, quote = stop.end(), stop[0]
        if quote == ">":
            return m[1], m[2], page[m.end() : stop.start()], pos
        if page[m.end() : stop.start()][-40:].rstrip().endswith("=") and quote not in missing:
            close = page.find(quote, pos)
            if close < 0:
                missing.add(quote)
            else:
                pos = close + 1
    return None


def parse(page: str) -> Tree:
    t = Tree()
    stack, block, at = [0], 0, 0
    is_open: dict[str, int] = {}
    missing: set[str] = set()

    def text(s: str) -> None:
        node = stack[-1]
        if t.hidden[node]:
            return
        if s and not s.isspace():
            t.pieces.append((node, block, s))
            t.own[node] += len(s)
            if any(t.tag[k] == "a" for k in stack[-4:]):
                t.linked[node] += len(s)
        elif s and t.pieces and t.pieces[-1][1] == block:
            t.pieces.append((node, block, " "))

    def cut(k: int) -> None:
        for x in stack[k:]:
            is_open[t.tag[x]] -= 1
        del stack[k:]

    def close(tags: set[str], scope: set[str]) -> None:
        if not any(is_open.get(x) for x in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if t.tag[stack[k]] in tags:
                cut(k)
                return
            if t.tag[stack[k]] in scope:
                return

    size = len(page)
    while at < size:
        lt = page.find("<", at)
        while lt >= 0 and not (page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] in ("/", "!", "?")):
            lt = page.find("<", lt + 1)  # text
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        m = _TAG.match(page, lt)
        if m:
            slash, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
        elif _OPEN.match(page, lt):
            got = _slow_tag(page, lt, missing)
            if got is None:
                break
            slash, tag, attributes, at = got[0], got[1].lower(), got[2], got[3]
        else:  # <!doctype>, <?xml?>, </ >
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else size
            continue
        if slash:
            if tag not in INLINE:
                block += 1
            if is_open.get(tag):
                k = len(stack) - 1
                while t.tag[stack[k]] != tag:
                    k -= 1
                cut(k)
            continue
        if tag in CLOSES_P:
            close({"p"}, {"article", "section", "div", "td", "th", "li", "body", "blockquote", "button", "table"})
        if tag in SAME:
            close(SAME[tag], SCOPE[tag])
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            block += 1
        if tag in VOID:
            continue
        t.parent.append(stack[-1])
        t.tag.append(tag)
        t.names.append(_names(attributes) if attributes else ())
        t.own.append(0)
        t.linked.append(0)
        t.hidden.append(t.hidden[stack[-1]] or tag in HIDDEN)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            close_at = page.find(">", end.end()) if end else -1
            at = close_at + 1 if close_at >= 0 else size
        elif not attributes.endswith("/"):
            stack.append(len(t.parent) - 1)
            is_open[tag] = is_open.get(tag, 0) + 1
    return t


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, ...]:
    return tuple(sorted({w for m in _ATTR.finditer(attributes) for w in _NAME.findall(_html.unescape(m[2] or m[3] or m[4] or "").lower())}))


def kind(tag: str) -> str:
    if tag in INLINE:
        return "inline"
    return tag if tag in ("p", "li", "td", "div", "article", "h1", "section", "body", "main") else "heading" if re.fullmatch("h[2-6]", tag) else "other"


@lru_cache(maxsize=65536)
def features(tag: str, names: tuple[str, ...], own: int, links: int) -> tuple[str, ...]:
    return ("bias", "tag:" + tag, *("name:" + n for n in names), f"text:{own}", f"links:{links}")


def node_features(t: Tree) -> list[tuple[str, ...]]:
    """Features of each node; amounts of text and links are those of its subtree, in steps."""
    n = len(t.parent)
    own, linked = list(t.own), list(t.linked)
    for k in range(n - 1, 0, -1):
        own[t.parent[k]] += own[k]
        linked[t.parent[k]] += linked[k]
    return [features(t.tag[k], t.names[k], min(6, own[k].bit_length() // 2), 0 if not own[k] else 1 + int(3.999 * linked[k] / own[k])) for k in range(n)]


def marginals(parent: list[int], unary: list[float], edges: list[tuple[float, float, float, float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Sum-product on a tree whose parents come first.

    ``unary`` is the log-odds of content, ``edges[k]`` the potentials (parent, child) = 00, 01, 10, 11 of node k and its
    parent. Returns the content marginal of each node and the pair marginals of each edge.
    """
    n = len(parent)
    up0, up1 = [1.0] * n, [math.exp(max(-30.0, min(30.0, u))) for u in unary]  # node potential times messages from below
    m0, m1 = [0.0] * n, [0.0] * n
    for k in range(n - 1, 0, -1):
        s = up0[k] + up1[k]
        a0, a1 = up0[k] / s, up1[k] / s
        up0[k], up1[k] = a0, a1
        e = edges[k]
        m0[k], m1[k] = e[0] * a0 + e[1] * a1, e[2] * a0 + e[3] * a1
        p = parent[k]
        up0[p] *= m0[k]
        up1[p] *= m1[k]
        s = up0[p] + up1[p]
        up0[p], up1[p] = up0[p] / s, up1[p] / s
    b1 = [0.0] * n
    pairs = [(0.0, 0.0, 0.0, 0.0)] * n
    s = up0[0] + up1[0]
    b1[0] = up1[0] / s
    for k in range(1, n):
        q = b1[parent[k]]
        d0, d1 = (1 - q) / max(m0[k], 1e-300), q / max(m1[k], 1e-300)  # belief of the parent without this child's message
        e = edges[k]
        p00, p01, p10, p11 = d0 * e[0] * up0[k], d0 * e[1] * up1[k], d1 * e[2] * up0[k], d1 * e[3] * up1[k]
        s = p00 + p01 + p10 + p11
        pairs[k] = (p00 / s, p01 / s, p10 / s, p11 / s)
        b1[k] = (p01 + p11) / s
    return b1, pairs


def shares(t: Tree) -> list[float]:
    """One over the number of a node's siblings with its tag and words, itself included: a row of likes has one vote."""
    count: dict[tuple, int] = {}
    keys = list(zip(t.parent, t.tag, t.names))
    for k in keys:
        count[k] = count.get(k, 0) + 1
    return [1 / count[k] for k in keys]


def infer(t: Tree, model: dict):
    """Features, shares, and the marginals of nodes and edges. A node's log-odds are its weights' sum times its share."""
    w, ew = model["node"], model["edge_exp"]
    cache = model.setdefault("_odds", {})
    odds = []
    feats, share = node_features(t), shares(t)
    for f, part in zip(feats, share):
        u = cache.get(f)
        if u is None:
            if len(cache) > 100_000:
                cache.clear()
            u = cache[f] = sum(w.get(x, 0.0) for x in f)
        odds.append(u * part)
    kinds = model.setdefault("_kinds", {})
    edges = []
    for tag in t.tag:
        e = kinds.get(tag)
        if e is None:
            e = kinds[tag] = ew.get(kind(tag)) or ew["other"]
        edges.append(e)
    return feats, share, *marginals(t.parent, odds, edges)


# Labelled pages. A page is written with every content element marked; the mark is taken out before it is parsed.
_FILL = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat voluptua at vero eos accusam justo duo dolores ea rebum stet clita kasd gubergren".split()
_CHROME = ["menu", "navbar", "navigation", "breadcrumb", "sidebar", "widget", "related", "share", "social", "ad", "ads", "advert", "banner", "sponsored", "promo", "cookie", "notice", "consent", "popup", "newsletter", "subscribe", "footer", "copyright", "header", "masthead", "topbar", "comments", "comment", "respond", "reply", "search", "login", "pagination", "tags", "author", "meta", "modal", "alert"]
_MAIN = ["content", "main", "post", "article", "entry", "body", "story", "text"]
_PLAIN = ["col", "row", "inner", "left", "center", "box", "wide", "panel", "grid", "cell", "layout", "area"]


def labelled_page(rng: random.Random) -> str:
    """A page in which the tags of content elements begin with ``<*``."""

    def prose(lo, hi):
        s = " ".join(rng.choice(_FILL) for _ in range(rng.randint(lo, hi)))
        return s.capitalize() + "."

    def chrome():
        tag, names = rng.choice([("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("div", "x"), ("div", "x"), ("section", "x"), ("ul", "x")])
        name = f' class="{rng.choice(_CHROME)}{rng.choice(["", "-box", " wide", "-1"])}"' if names or rng.random() < 0.3 else ""
        if rng.random() < 0.2 and name:
            name = name.replace("class", "id")
        r = rng.random()
        if tag == "ul" or r < 0.4:
            inner = "".join(f"<li><a href='/{k}'>{prose(1, 2)}</a></li>" for k in range(rng.randint(2, 8)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif r < 0.7:
            inner = prose(3, 20)
        else:
            inner = "".join(f"<p>{prose(2, 25)}</p>" for _ in range(rng.randint(1, 3)))
        if tag == "form":
            inner = f"<label>{prose(1, 3)}</label><input><button>{prose(1, 1)}</button>"
        return f"<{tag}{name}>{inner}</{tag}>"

    short = rng.random() < 0.3  # all of the page's paragraphs are: length alone tells nothing

    def block():
        r = rng.random()
        if short and r < 0.85:
            s = prose(1, 4)
            return f"<*p><*b>{s}<br>" if r < 0.1 else f"<*p>{s}" + ("</p>" if r < 0.8 else "")
        if r < 0.7:
            s = prose(2, 60)
            if rng.random() < 0.3:
                s = f"<*b>{prose(1, 30)}</b> {s}" if rng.random() < 0.6 else f"<*b>{s}<br>"
            if rng.random() < 0.2:
                s += f" <*a href='/x'>{prose(1, 3)}</a> {prose(1, 9)}"
            if rng.random() < 0.1:
                s = " | ".join(rng.choice(_FILL) for _ in range(rng.randint(2, 30)))
            return f"<*p>{s}" + ("</p>" if rng.random() < 0.9 else "")
        if r < 0.8:
            return f"<*h{rng.randint(2, 4)}>{prose(1, 6)}</h2>"
        if r < 0.9:
            return "<*ul>" + "".join(f"<*li>{prose(2, 12)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if r < 0.94:
            return f"<*blockquote><*p>{prose(4, 30)}</p></blockquote>"
        if r < 0.97:
            return f"<*pre>{prose(3, 20)}</pre>"
        return "<*table><*tr><*td>" + prose(1, 4) + "</td><*td>" + prose(1, 4) + "</td></tr></table>"

    parts = [block() for _ in range(rng.choice([1, 2, 3, 3, 5, 8, 14, 30 if short else 6]))]
    if rng.random() < 0.85:
        parts.insert(0, f"<*h1>{prose(1, 8)}</h1>")
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
        parts.insert(rng.randint(1, len(parts)), chrome())
    inner = "".join(parts)
    if rng.random() < 0.3:
        inner += f"<div class='comments'><p>{prose(4, 30)}</p><p>{prose(3, 20)}</p></div>"
    named = lambda tag, names: f"{tag} {rng.choice(['class', 'id'])}='{rng.choice(names)}'"
    outer = rng.choice([["article"], ["article"], ["main"], ["main", "article"], [named("div", _MAIN)], [named("section", _MAIN)], ["div"], [named("div", _PLAIN)], ["table", "tr", "td"], [named("div", _PLAIN), named("div", _MAIN)], [], []])
    body = "".join(f"<*{x}>" for x in outer) + inner + "".join(f"</{x.split()[0]}>" for x in reversed(outer))
    head = f"<html><head><title>{prose(2, 6)}</title><style>p{{}}</style><script>x='</p>'</script></head>"
    before, after = ("".join(chrome() for _ in range(rng.choice([0, 0, 1, 2, 3]))) for _ in (0, 1))
    mid = before + body + after
    if rng.random() < 0.3:
        mid = f"<{named('div', ['page', 'wrapper', 'container', 'site'])}>{mid}</div>"
    r = rng.random()
    if r < 0.2:
        return mid if r < 0.1 else body
    return head + "<body>" + mid + ("</body></html>" if rng.random() < 0.8 else "")


def labelled(page: str) -> tuple[Tree, list[int]]:
    """The tree of a marked page, and the label of each node: marked ones and all that they stand in are content."""
    names, marks = [], []
    for m in re.finditer(r"<(\*?)([a-zA-Z][^\s/>]*)", re.sub(r"<(script|style|title)>.*?</\1>", r"<\1>", page, flags=re.S)):
        marks.append(int(bool(m[1])))
        names.append(m[2].lower())
    t = parse(page.replace("<*", "<"))
    y = [0, *(x for x, n in zip(marks, names) if n not in VOID)]
    for k in range(len(y) - 1, 0, -1) if len(y) == len(t.parent) else ():
        y[t.parent[k]] |= y[k]
    return t, y


def conditional(x: list[float]) -> tuple[float, float, float, float]:
    """Potentials (parent, child) = 00, 01, 10, 11 from weights; those of a parent's label add up to one.

    So a child without evidence of its own says nothing about its parent, however many there are.
    """
    a, b, c, d = (math.exp(v) for v in x)
    return a / (a + b), b / (a + b), c / (c + d), d / (c + d)


@lru_cache(maxsize=2)
def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 5) -> dict:
    rng = random.Random(seed)
    data = [labelled(labelled_page(rng)) for _ in range(pages)]
    data = [(t, y) for t, y in data if len(y) == len(t.parent)]
    w: dict[str, float] = {}
    e: dict[str, list[float]] = {k: [0.0] * 4 for k in [kind(x) for x in ("b", "p", "li", "td", "div", "article", "h1", "section", "body", "main", "h2", "x")]}
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch / 3)
        model = {"node": w, "edge_exp": None}
        for t, y in data:
            model = {"node": w, "edge_exp": {k: conditional(x) for k, x in e.items()}}
            feats, share, b1, pairs = infer(t, model)
            scale = rate / math.sqrt(len(y))
            for k, f in enumerate(feats):
                g = scale * (y[k] - b1[k]) * share[k]
                if abs(g) > 1e-7:
                    for x in f:
                        w[x] = w.get(x, 0.0) * (1 - 1e-5) + g
            for k in range(1, len(y)):
                x, p, q = e[kind(t.tag[k])], pairs[k], model["edge_exp"][kind(t.tag[k])]
                true = 2 * y[t.parent[k]] + y[k]
                for c in range(4):
                    row = c & 2
                    here = (true & 2 == row) - p[row] - p[row + 1]
                    x[c] = max(-6.0, min(6.0, x[c] + scale * ((c == true) - p[c] - q[c] * here)))
    return {"node": w, "edge_exp": {k: conditional(x) for k, x in e.items()}}


def main_text(page: str, model: dict) -> str:
    if not page:
        return ""
    t = parse(page)
    b1 = infer(t, model)[2]
    blocks: list[str] = []
    last, part = None, []
    for node, block, s in t.pieces:
        if b1[node] <= 0.5:
            continue
        if block != last:
            blocks.append("".join(part))
            last, part = block, []
        part.append(s)
    blocks.append("".join(part))
    return "\n\n".join(x for x in (" ".join(_html.unescape(b).split()) for b in blocks) if x)


def _work(model: dict):
    def work(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                text = [main_text(x.as_py(), model) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return work


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages(page_id, url, html)``."""
    return map_batches(pages.select("page_id", "url", "html"), _work(model or train()), "page_id long, url string, text string, n_chars long")
