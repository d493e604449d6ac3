"""Main-text extraction with a tree-structured graphical model over DOM blocks.

A page becomes a tree of its block elements and runs of text.  Each node has a binary state
(content or not); a node potential scores its features, a parent-child potential scores the
pair of states on each edge.  Sum-product messages, upward then downward, give exact
marginals; runs of text that are rather content than not make up the text.

Training pages are labelled by landmark elements (article, main; nav, header, footer,
aside, form) and by construction: boilerplate of other kinds (comments, sidebars, notices,
adverts, forms), built from other pages' text, is set into them, so that it is known inside
articles too.  Potentials are trained by conditional likelihood of each node given its
parent on a bounded sample of pages.

Defined cases: null or empty html: an empty text; text outside any landmark counts as its
neighbourhood does; a block just as likely content as not is content; unclosed tags,
quotes and comments are read in one pass (see markup), very long pages whole; equal pages
give equal texts; null ids, null urls and other columns do no harm; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import math
import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound of pages that the model is trained on.
TRAIN_PAGES = 600

# What follows `<`: the name of a tag, and its attributes up to `>`; quotes count only after `=`.
# Nothing in it can be matched in two ways, so no place is read twice.
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+>")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-label)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")

# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template head title iframe select textarea button".split())
RAW = frozenset("script style textarea title iframe".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Formulas and labels of drawings read on within their line.
INLINE |= frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml text tspan textpath".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())

# Words of class and id attributes by what they hint at.
HINTS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager skip",
    "side": "sidebar aside widget related recommended trending rail",
    "foot": "footer foot copyright colophon legal bottom",
    "head": "masthead topbar header logo branding",
    "notice": "cookie cookies consent notice popup modal gdpr alert overlay newsletter subscribe signup paywall",
    "comment": "comment comments reply replies respond discussion disqus",
    "form": "form login search share social sharing toolbar tags",
    "main": "article content main post entry story body text",
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
TAGS = "article main section div p h1 h2 h3 li ul ol nav header footer aside form table td blockquote pre figure body html text".split()
_TAG_SET = frozenset(TAGS)


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "text", "links", "size", "label")

    def __init__(self, tag, attrs="", parent=None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.text, self.links, self.size, self.label = "", 0, 0, None
        if parent is not None:
            parent.kids.append(self)


def markup(page: str):
    """(text before, tag in lower case or None, closing, attributes) of each tag, and the text after the last one.

    One pass: comments and declarations are left out, contents of raw elements too.  A page
    with a quote that never ends is read from there on as if quotes had no meaning; `<`
    without a `>` after it is text.
    """
    at = start = 0
    quotes, last = True, page.rfind(">")
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield page[start:at], None, False, ""
            at = start = end
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            yield page[start:at], None, False, ""
            at = start = end
            continue
        name = _NAME.match(page, at + 1)
        if name is None:
            at += 1
            continue
        rest = _ATTRIBUTES.match(page, name.end()) if quotes else None
        if rest is None:
            quotes = False
            end = page.find(">", name.end()) + 1
            if not end:
                break
        else:
            end = rest.end()
        tag, closing = name[1].lower(), page[at + 1] == "/"
        raw = tag in RAW
        yield page[start:at], None if raw else tag, closing, page[name.end() : end - 1]
        at = start = end
        if raw and not closing:
            found = _RAW_END[tag].search(page, at)
            end = page.find(">", found.end()) + 1 if found else 0
            at = start = end or len(page)
    yield page[start:], None, False, ""


def parse(page: str | None) -> Node:
    """The tree of block elements; text runs are leaves with tag `text`, white space collapsed."""
    root = node = Node("html")
    buffer: list[str] = []
    links = in_link = 0
    open_: dict[str, int] = {"html": 1}  # elements on the way from the root to here

    def flush():
        nonlocal links
        text = _SPACE.sub(" ", "".join(buffer)).strip()
        if text:
            leaf = Node("text", "", node)
            leaf.text, leaf.size, leaf.links = text, len(text), links
        buffer.clear()
        links = 0

    def leave():
        nonlocal node
        open_[node.tag] -= 1
        node = node.parent

    for before, tag, closing, attrs in markup(page or ""):
        if before:
            # Each run between tags on its own: a reference does not go over a tag.
            before = entities.unescape(before) if "&" in before else before
            buffer.append(before)
            if in_link:
                links += len(before)
        if tag is None:
            continue
        if tag in INLINE:
            if tag in ("br", "text"):
                buffer.append(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        if closing:
            if open_.get(tag) and tag != "html":
                while node.tag != tag:
                    leave()
                leave()
                in_link = 0
            continue
        if tag in VOID or tag == "html":
            continue
        if tag in CLOSES_P and node.tag == "p":
            leave()
        elif tag in PLAIN and node.tag in PLAIN:
            leave()
        if tag in ITEMS and any(open_.get(t) for t in ITEMS[tag].split()):
            same, up = ITEMS[tag].split(), node
            while up.tag not in same and up.tag not in ("ul", "ol", "dl", "table") and up.parent is not None:
                up = up.parent
            if up.tag in same:
                while node is not up:
                    leave()
                leave()
        node = Node(tag, attrs, node)
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return root


def order(root: Node) -> list[Node]:
    """Nodes in page order, parents first; subtrees that are never shown are left out."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.tag in HIDDEN:
            continue
        out.append(n)
        stack.extend(reversed(n.kids))
    return out


def hints(node: Node) -> set[str]:
    out = set()
    if node.attrs:
        for name, value in _ATTR.findall(node.attrs):
            if name.lower() == "hidden":
                out.add("notice")
            out.update(_HINT_OF[w] for w in _WORDS.findall(value.lower()) if w in _HINT_OF)
    return out


def features(node: Node) -> list[str]:
    tag = node.tag if node.tag in _TAG_SET else "div"
    out = ["bias", f"tag:{tag}", *(f"hint:{h}" for h in hints(node))]
    if node.tag == "text":
        size = node.size
        out.append(f"size:{min(6, size.bit_length() // 2)}")
        out.append(f"links:{round(4 * min(1.0, node.links / max(1, size)))}")
        out.append(f"holder:{node.parent.tag if node.parent is not None and node.parent.tag in _TAG_SET else 'div'}")
        if node.text.startswith(("©", "(c)", "Copyright")):
            out.append("copyright")
    return out


class TreeModel:
    """Weights of node features and of edges (parent state, child state, child's kind)."""

    def __init__(self, node: dict[str, float], edge: dict[tuple, float]):
        self.node, self.edge = node, edge

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node of order(root), by sum-product in log space."""
        n = len(nodes)
        at = {id(x): i for i, x in enumerate(nodes)}
        parent = [-1] * n
        for i, x in enumerate(nodes):
            if x.parent is not None:
                parent[i] = at[id(x.parent)]
        own = [sum(self.node.get(f, 0.0) for f in features(x)) for x in nodes]
        psi = [[[self.edge.get((a, b, kind(x)), 0.0) for b in (0, 1)] for a in (0, 1)] for x in nodes]
        up0, up1 = [0.0] * n, list(own)  # node potential and messages from the children
        message: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            t = psi[i]
            m = _log_add(up0[i] + t[0][0], up1[i] + t[0][1]), _log_add(up0[i] + t[1][0], up1[i] + t[1][1])
            message[i] = m
            up0[parent[i]] += m[0]
            up1[parent[i]] += m[1]
        full = [(0.0, 0.0)] * n
        out = [0.0] * n
        for i in range(n):
            if i:
                p, t = full[parent[i]], psi[i]
                c0, c1 = p[0] - message[i][0], p[1] - message[i][1]  # the parent without this child
                full[i] = up0[i] + _log_add(c0 + t[0][0], c1 + t[1][0]), up1[i] + _log_add(c0 + t[0][1], c1 + t[1][1])
            else:
                full[i] = up0[i], up1[i]
            top = max(full[i])
            full[i] = full[i][0] - top, full[i][1] - top
            out[i] = 1 / (1 + math.exp(max(-500.0, min(500.0, full[i][0] - full[i][1]))))
        return out

    def extract(self, page: str | None) -> str:
        nodes = order(parse(page))
        p = self.marginals(nodes)
        return "\n\n".join(x.text for x, q in zip(nodes, p, strict=True) if x.tag == "text" and q >= 0.5)


def kind(node: Node) -> str:
    return "text" if node.tag == "text" else "landmark" if hints(node) or node.tag in ("article", "main", "nav", "header", "footer", "aside", "form") else "block"


def _log_add(a: float, b: float) -> float:
    hi, lo = (a, b) if a >= b else (b, a)
    return hi + math.log1p(math.exp(max(lo - hi, -700.0)))


def label(nodes: list[Node]) -> None:
    """Labels of training pages: the nearest landmark above a node decides, or a block that was set in (BUILT).

    Words of class and id attributes decide nothing: a block that carries such a word
    inside a landmark has no label, as nobody knows.  Containers without a landmark are
    content if they hold any.
    """
    for x in nodes:
        above = x.parent.label if x.parent is not None else None
        if x.tag in ("nav", "header", "footer", "aside", "form") or BUILT in x.attrs:
            x.label = 0
        elif above == 0:
            x.label = 0
        elif x.tag in ("article", "main"):
            x.label = 1
        elif above == 1 and hints(x) - {"main"}:
            x.label = None
        else:
            x.label = above
    for x in reversed(nodes):
        if x.label is None and x.tag != "text" and not hints(x) and any(k.label == 1 for k in x.kids):
            x.label = 1


#: Attribute of blocks set into training pages; no feature sees it.
BUILT = "data-set-in"


def with_boilerplate(page: str, text: str, rng: random.Random) -> str:
    """The page with blocks of unwanted kinds, filled with text, before and inside its article."""
    words = text.split() or ["text"]

    def some(n):
        start = rng.randrange(len(words))
        return entities.escape(" ".join(words[start : start + n]), quote=False)

    def mark(hint):
        return f'{rng.choice(("class", "id"))}="{rng.choice(HINTS[hint].split())}" {BUILT}'

    kinds = [
        lambda: f"<div {mark('comment')}><p>{some(20)}</p><p>{some(30)}</p></div>",
        lambda: f"<section {mark('comment')}><h3>{some(3)}</h3><div><p>{some(40)}</p></div></section>",
        lambda: f'<aside {mark("side")}><h3>{some(3)}</h3><ul><li><a href="/x">{some(4)}</a></li><li>{some(6)}</li></ul></aside>',
        lambda: f"<div {mark('side')}><p>{some(30)}</p></div>",
        lambda: f"<div {mark('notice')}>{some(15)}</div>",
        lambda: f"<div {mark('ad')}><p>{some(12)}</p></div>",
        lambda: f"<form {mark('form')}><p>{some(5)}</p></form>",
        lambda: f'<div {mark("menu")}><ul><li><a href="/y">{some(2)}</a></li></ul></div>',
        lambda: f"<header><p>{some(6)}</p></header>",
        lambda: f"<div {mark('foot')}><p>{some(9)}</p></div>",
    ]
    # The article itself, told as such by a class or by nothing but its place.
    names = {"<article>": rng.choice(("<article>", "<main>", "<article class=content>", "<article class=post>"))}
    names["</article>"] = "</main>" if names["<article>"] == "<main>" else "</article>"
    for old, new in names.items():
        page = page.replace(old, new)
    places = [m.start() for m in re.finditer(r"<p>|</(?:article|main)>|<(?:article|main)[ >]|<footer", page)]
    for place in sorted((rng.choice(places) for _ in range(rng.randrange(4))), reverse=True) if places else ():
        page = page[:place] + rng.choice(kinds)() + page[place:]
    return page


def fit(pages: list[str], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> TreeModel:
    """Node and edge weights from landmark labels, each node given its parent's label."""
    rng = random.Random(0)
    rows = []
    for k, page in enumerate(pages):
        other = "".join(x.text + " " for x in order(parse(pages[k - 1])) if x.tag == "text")
        nodes = order(parse(with_boilerplate(page, other, rng)))
        label(nodes)
        rows.extend((x.label, features(x), x.parent.label, kind(x)) for x in nodes if x.label is not None and x.parent is not None and x.parent.label is not None)
    node: dict[str, float] = {}
    edge = {(a, b, k): 0.0 for a in (0, 1) for b in (0, 1) for k in ("text", "landmark", "block")}
    g2: dict = {}
    for _ in range(epochs):
        rng.shuffle(rows)
        for y, fs, above, k in rows:
            z = sum(node.get(f, 0.0) for f in fs) + edge[above, 1, k] - edge[above, 0, k]
            d = y - 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
            if abs(d) < 1e-4:
                continue
            for f in fs:
                g2[f] = g2.get(f, 1e-2) + d * d
                node[f] = node.get(f, 0.0) * (1 - decay) + rate * d / math.sqrt(g2[f])
            g2[above, k] = g2.get((above, k), 1e-2) + d * d
            for b, sign in ((1, 1), (0, -1)):
                edge[above, b, k] += sign * rate / 2 * d / math.sqrt(g2[above, k])
    return TreeModel(node, edge)


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> TreeModel:
    """Fit on at most `most` pages chosen by a hash of id and html, in one task; pages (page_id, html)."""
    import pickle

    n = pages.count()
    hashed = pages.select("page_id", "html", F.xxhash64("page_id", "html", F.lit("sample")).alias("_h"))
    near = hashed.where(F.pmod("_h", F.lit(1_000_003)) < int(1_000_003 * min(1.0, (2 * most + 100) / max(1, n))))
    chosen = near.orderBy("_h", "page_id", "html").limit(most)  # rows that repeat an id are bounded too

    def learn(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["page_id", "html"])
        model = fit([h for h in pdf["html"].tolist() if h])
        return pd.DataFrame({"model": [pickle.dumps((model.node, model.edge))]})

    got = chosen.select("page_id", "html", F.lit(1).alias("one")).groupBy("one").applyInPandas(learn, "model binary").collect()
    return TreeModel(*pickle.loads(got[0]["model"])) if got else TreeModel({}, {})


def extract_text(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text of pages (page_id, url, html)."""

    def run(batches):
        for pdf in batches:
            yield pdf[["page_id", "no_id", "url"]].assign(text=[model.extract(h) for h in pdf["html"].tolist()])

    whole = common.whole_ids(pages.select("page_id", "url", "html"), "page_id")
    return common.null_ids(whole.mapInPandas(run, "page_id long, no_id boolean, url string, text string"), "page_id")


def op9_html_extraction(spark, sf_dir):
    """The main text of all pages."""
    pages = common.table(spark, sf_dir, "pages", "page_id", "url", "html")
    got = extract_text(pages, train(pages))
    return got.withColumn("n_chars", F.char_length("text").cast("long"))


