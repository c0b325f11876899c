"""Main text of HTML pages by a tree-structured graphical model.

A page is parsed into its block elements and text blocks. Every node has a hidden label, content or not. A
node's tag, class words, link share and text shape speak for its label; parent-child potentials connect labels
along the tree. Sum-product messages, upward and then downward, give each text block's content marginal. All
potentials are counts over labelled pages (``labelled_pages``).

Defined results: a null or empty page gives an empty text; so does a page with no content. Unclosed tags and
comments, stray end tags and any depth of nesting are read as they stand; repeated rows give equal results; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp title textarea".split())
SILENT = frozenset("svg object select button canvas audio video datalist".split())
BLOCK = frozenset("label legend address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption".split()) | {"hr", "table"}
BARRIER = frozenset("table td th caption html".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}

SHAPE = 0.6

_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/>]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["']?[^"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.IGNORECASE)
_OWNER = re.compile(r"©|\(c\)|\bcopyright\b|all rights reserved|\balle rechte\b|tous droits|todos los derechos", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAMED = re.compile(r"(?:class|id|role)\s*=", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    attributes: str = ""
    text: str | None = None  # of text blocks
    chars: int = 0
    linked: int = 0
    label: int | None = None


def parse(page: str) -> list[Node]:
    """Block elements and text blocks in page order; a parent comes before its children."""
    nodes = [Node("body", -1)]
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements; inline ones carry -1, silent ones -2
    open_tags: Counter = Counter()
    texts: list[str] = []
    links = 0  # open links
    linked = 0
    owner = 0  # innermost open block
    marks: list[int] = [0]  # open blocks
    silent = 0  # open inline elements whose text is not shown
    endless: set[str] = set()  # tags without an end tag in the rest of the page

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            texts.clear()
            if text:
                nodes.append(Node("#text", owner, "", text, len(text), min(linked, len(text))))
            linked = 0

    def pop(k: int = -1) -> None:
        nonlocal owner, links, silent
        tag, at = stack.pop(k)
        open_tags[tag] -= 1
        if at >= 0:
            flush()
            marks.pop()
            owner = marks[-1]
        else:
            links -= tag == "a"
            silent -= at == -2

    def close(tags: set | frozenset, barrier: set | frozenset) -> None:
        if not any(open_tags[t] > 0 for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in barrier:
                return

    at, size = 0, len(page)
    last = page.rfind(">")  # no tag is complete beyond
    search = _MARKUP.search
    while at < size:
        m = search(page, at) if at <= last else None
        if at > last:  # what opens here never closes
            cut = _OPENS.search(page, at)
            size = cut.start() if cut else size
        end = m.start() if m else size
        if end > at:
            piece = page[at:end]
            if not silent:
                texts.append(entities.unescape(piece) if "&" in piece else piece)
                if links > 0:
                    linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        tag = name.lower()
        if m.group(1) or m.group(4):  # an end tag
            if tag == "p" and not open_tags["p"]:
                flush()
            elif tag in BLOCK:
                if tag not in ("body", "html"):
                    close({tag}, frozenset() if tag in ("table", "article", "main", "body") else BARRIER - {tag})
            elif open_tags[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if stack[k][1] >= 0:
                        break
            continue
        attributes = m.group(3) or m.group(6) or ""
        if tag in RAW or tag in SILENT:
            texts.append(" ")
            if tag in SILENT and attributes.rstrip().endswith("/"):
                continue
            stop = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            if stop:
                at = stop.end()
                continue
            endless.add(tag)
            if tag in RAW:
                at = size
            else:
                stack.append((tag, -2))
                open_tags[tag] += 1
                silent += 1
            continue
        if tag in VOID:
            if tag == "hr":
                close({"p"}, BARRIER)
                flush()
            elif tag in ("br", "img", "input", "wbr"):
                texts.append("" if tag == "wbr" else " ")
            continue
        if tag in CLOSES_P:
            close({"p"}, BARRIER)
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if tag in BLOCK:
            if tag in ("body", "html"):
                if tag == "body":
                    nodes[0].attributes = nodes[0].attributes or attributes
                continue
            flush()
            nodes.append(Node(tag, owner, attributes))
            owner = len(nodes) - 1
            stack.append((tag, owner))
            marks.append(owner)
        else:
            if tag == "a" and open_tags["a"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "a":
                        pop(k)
                        break
            unseen = bool(attributes) and _HIDDEN.search(attributes) is not None
            links += tag == "a"
            silent += unseen
            stack.append((tag, -2 if unseen else -1))
        open_tags[tag] += 1
    flush()
    for n in reversed(nodes):
        if n.parent >= 0:
            nodes[n.parent].chars += n.chars
            nodes[n.parent].linked += n.linked
    return nodes


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(text)} if text else {}


def _links(n: Node) -> str:
    """The class of a node's link share."""
    share = n.linked / n.chars if n.chars else 0.0
    return "0" if share == 0 else "1" if share < 0.34 else "2" if share < 0.8 else "3"


def signs(n: Node, parent: Node) -> list[str]:
    """The observed features of a node. Below the top level its tag speaks through the parent-child potential, and that
    all is linked is a sign of the outermost such block only, so that nothing counts twice."""
    link = _links(n)
    below = parent.parent >= 0
    if link == "3" and n is not parent and _links(parent) == "3":
        link = ""
    if n.text is not None:
        t = n.text
        size = "0" if n.chars < 12 else "1" if n.chars < 40 else "2" if n.chars < 120 else "3"
        out = [*([] if below else [f"T in {parent.tag}"]), *([f"T links {link}"] if link else []), f"T size {size}", f"T stop {t[-1] in '.!?…'}"]
        if n.chars < 200 and _OWNER.search(t):
            out.append("T owner")
        return out
    out = [*([] if below else [f"E tag {n.tag}"]), *([f"E links {link}"] if link else []), f"E size {min(4, len(str(n.chars)))}"]
    if n.attributes and _HIDDEN.search(n.attributes):
        out.append("E hidden")
    found = _attributes(n.attributes)
    words = {w.lower() for a in ("class", "id", "role") if a in found for w in _WORDS.findall(found[a])}
    return out + [f"E word {w}" for w in sorted(words)]


def link(n: Node, parent: Node) -> str:
    """The kind of a parent-child potential: where the child hangs, its tag, and whether it is named."""
    named = "" if n.text is not None or not _NAMED.search(n.attributes) else " named"
    return f"{'top' if parent.parent < 0 else 'in'} {n.tag}{named}"


@dataclass
class Model:
    """Log-odds of features, and P(child label | parent label) for each kind of child."""

    signs: dict[str, float] = field(default_factory=dict)
    pairs: dict[str, tuple[tuple[float, float], tuple[float, float]]] = field(default_factory=dict)
    root: float = 0.5

    def pair(self, kind: str) -> tuple[tuple[float, float], tuple[float, float]]:
        return self.pairs.get(kind) or self.pairs["*"]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node, by messages to the root and back."""
        n = len(nodes)
        get = self.signs.get
        own: list[tuple[float, float]] = []
        for node in nodes:
            z = 0.0
            for s in signs(node, nodes[max(0, node.parent)]):
                z += get(s, 0.0)
            z = max(-25.0, min(25.0, z))
            p = 1.0 / (1.0 + math.exp(-z))
            own.append((1.0 - p, p))
        between = [self.pair(link(x, nodes[max(0, x.parent)])) for x in nodes]
        below = list(own)  # evidence of the subtree, for each label
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = between[i]
            x, y = below[i]
            m0, m1 = a * x + b * y, c * x + d * y
            up[i] = (m0, m1)
            k = nodes[i].parent
            p0, p1 = below[k][0] * m0, below[k][1] * m1
            s = p0 + p1
            below[k] = (p0 / s, p1 / s)
        full: list[tuple[float, float]] = [(0.0, 0.0)] * n
        x, y = below[0][0] * (1 - self.root), below[0][1] * self.root
        full[0] = (x / (x + y), y / (x + y))
        for i in range(1, n):
            k = nodes[i].parent
            q0, q1 = full[k][0] / up[i][0], full[k][1] / up[i][1]  # what the parent knows from elsewhere
            (a, b), (c, d) = between[i]
            x, y = below[i][0] * (q0 * a + q1 * c), below[i][1] * (q0 * b + q1 * d)
            s = x + y
            full[i] = (max(x / s, 1e-12), max(y / s, 1e-12))
        return [y for _, y in full]


def train(pages: list[str], smoothing: float = 0.5) -> Model:
    """Counts over pages whose elements carry ``data-y`` (1 content, 0 not; inherited). The shape of texts, seen
    again in every block around them, is tempered by SHAPE."""
    seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    total: dict[str, list[float]] = {"T": [0.0, 0.0], "E": [0.0, 0.0]}
    pairs: dict[str, list[list[float]]] = defaultdict(lambda: [[0.0, 0.0], [0.0, 0.0]])
    root = [1.0, 1.0]
    for page in pages:
        nodes = parse(page)
        weight = [[0, 0] for _ in nodes]
        given: list[int] = []
        for i, n in enumerate(nodes):
            y = _attributes(n.attributes).get("data-y")
            given.append(int(y) if y else given[n.parent] if n.parent >= 0 else 0)
            if n.text is not None:
                weight[i][given[i]] = n.chars
        for i in range(len(nodes) - 1, 0, -1):
            for y in (0, 1):
                weight[nodes[i].parent][y] += weight[i][y]
        labels = [int(w[1] > w[0]) if sum(w) else g for w, g in zip(weight, given)]
        root[labels[0]] += 1
        for i, n in enumerate(nodes):
            kind = "E" if n.text is None else "T"
            total[kind][labels[i]] += 1
            for s in signs(n, nodes[max(0, n.parent)]):
                seen[s][labels[i]] += 1
            if i:
                for key in (link(n, nodes[n.parent]), "*"):
                    pairs[key][labels[n.parent]][labels[i]] += 1
    model = Model(root=root[1] / sum(root))
    for s, (c0, c1) in seen.items():
        t0, t1 = total[s[0]]
        model.signs[s] = (1.0 if s.startswith(("E tag", "E word")) else 2.0 if s == "E hidden" else SHAPE) * max(-4.0, min(4.0, math.log((c1 + smoothing) / (t1 + 2 * smoothing)) - math.log((c0 + smoothing) / (t0 + 2 * smoothing))))
    for key, rows in pairs.items():
        model.pairs[key] = tuple(tuple((rows[p][c] + smoothing) / (sum(rows[p]) + 2 * smoothing) for c in (0, 1)) for p in (0, 1))
    return model


# ---- labelled pages ---------------------------------------------------------------------------

# How pages name what is not their article, and what is.
OTHERS = {
    "nav": "nav;nav class=menu;div class=navbar;div id=main-menu;ul class=nav-links;div class=breadcrumbs;div class=pagination;div class=topnav;div role=navigation;ol class=breadcrumb;div class=site-menu;div class=toc;div class=skip-links",
    "header": "header;header class=site-header;div id=header;div class=masthead;div class=top-bar;div class=branding logo;div role=banner",
    "footer": "footer;footer class=site-footer;div id=footer;div class=copyright;div class=legal;div class=page-footer;div role=contentinfo;footer class=bottom",
    "side": "aside;aside class=sidebar;div id=sidebar;div class=widget;div class=related-posts;div class=right-rail;section class=recommended;div class=popular trending;div class=tags;div role=complementary;div class=side column",
    "notice": "div class=cookie-notice;div class=consent banner;div class=alert;div class=notice;div id=gdpr;div class=popup modal;div class=subscribe;div class=newsletter-signup;div class=announcement;div class=overlay;dialog;div class=paywall",
    "ad": "div class=ad;div class=ads;div class=advert;div class=advertisement;div class=ad-slot;div class=sponsored;div class=promo;aside class=ad-banner;div id=google-ads;section class=sponsor;div class=promotion;div class=banner-ad",
    "form": "form;form class=search;div class=login;form id=signup;fieldset;div class=search-box;form class=contact-form;div class=poll",
    "comment": "section class=comments;div id=comments;div class=comment-list;ol class=commentlist;div class=comment;div class=discussion;div class=responses;div id=disqus_thread;section class=reader-comments;div class=replies",
    "share": "div class=share;div class=social;ul class=share-buttons;div class=toolbar;div class=meta-links",
}
WRAPPERS = "div;div;div;div class=wrapper;div class=container;div class=row;div id=page;section;div class=inner;div class=layout"
ARTICLES = "article;article class=post;div class=article-body;main;div class=entry-content;div id=content;div class=post-content;section class=story;div class=main;div role=main;div class=text;article class=h-entry;div class=content;div class=page-content"


def labelled_pages(count: int = 400, seed: int = 7) -> list[str]:
    """Pages made of invented words, whose elements carry their labels: an article of paragraphs, headings, lists,
    quotes, linked lines and tables in wrappers, amid menus, notices, adverts, forms, sidebars, comments, hidden blocks
    and lines on rights that nothing names."""
    rng = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi zo an er in or ut as el il".split()

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    def prose() -> str:
        n = rng.choice([1, 2, 4, 8, 15, 30, 60, 90])
        out = words(n).capitalize()
        if rng.random() < 0.25:
            out += f' <a href="/x">{words(rng.randint(1, 3))}</a> {words(rng.randint(1, 6))}'
        return out + rng.choice([".", ".", ".", "", "!", "?", " ###", "%", ",", " &amp;"])

    def tagged(spec: str, inner: str, y: int | None) -> str:
        tag, _, attributes = spec.partition(" ")
        if attributes:
            k, _, v = attributes.partition("=")
            attributes = f' {k}="{v}"'
        mark = "" if y is None else f' data-y="{y}"'
        return f"<{tag}{attributes}{mark}>{inner}</{tag}>"

    def article() -> str:
        out = []
        if rng.random() < 0.8:
            title = f"<h1>{words(rng.randint(1, 10)).capitalize()}{rng.choice(['', '.', '?', '&amp;'])}</h1>"
            out.append(f"<header>{title}</header>" if rng.random() < 0.2 else title)
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.04:
                out.append(f'<p><a href="/x">{prose()}</a></p>')
            elif kind < 0.06:
                out.append("<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randint(2, 8))}</a></li>' for i in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.72:
                out.append(f"<p>{prose()}</p>")
            elif kind < 0.8:
                out.append(f"<h{rng.randint(2, 4)}>{words(rng.randint(1, 6))}</h3>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{prose()}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{rng.randint(1, 99)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.96:
                out.append(f"<div>{prose()}</div>")
            else:
                out.append(f"<figure><figcaption>{prose()}</figcaption></figure>")
            if rng.random() < 0.05:
                out.append(other(rng.choice(["ad", "share", "notice", "side", "hidden", "label"])))
        return "".join(out)

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randint(1, 4))}</a></li>' for i in range(n)) + "</ul>"

    def rights() -> str:
        return rng.choice([f"&copy; {rng.randint(1990, 2030)} {words(2)}", f"Copyright {rng.randint(1990, 2030)} {words(2)}. All rights reserved.", f"{words(2)} &copy; {words(1)}", f"Copyright &copy; {words(3)}."])

    def other(kind: str) -> str:
        if kind == "rights":
            return tagged(rng.choice(["div", "div", f"div class={words(1)}"]), rights(), 0)
        if kind == "label":
            return tagged("label", words(rng.randint(1, 4)), 0)
        if kind == "hidden":
            tag, mark = rng.choice(["div", "div", "section", "ul", "p"]), rng.choice(["hidden", 'style="display:none"', 'aria-hidden="true"', 'style="visibility: hidden"'])
            return f'<{tag} {mark} data-y="0">{prose()}</{tag}>'
        spec = rng.choice(OTHERS[kind].split(";"))
        if kind in ("nav", "share"):
            inner = links(rng.randint(1, 8)) if rng.random() < 0.7 else " ".join(f'<a href="/{i}">{words(1)}</a>' for i in range(rng.randint(1, 8)))
        elif kind == "header":
            inner = f'<a href="/">{words(2)}</a><p>{words(5)}</p>' + (other("nav") if rng.random() < 0.5 else "")
        elif kind == "footer":
            inner = f"&copy; {words(2)} &middot; {prose()}" if rng.random() < 0.6 else f"<p>{prose()}</p>{links(3)}"
        elif kind == "side":
            inner = f"<h3>{words(2)}</h3>" + (links(rng.randint(2, 6)) if rng.random() < 0.5 else f"<p>{prose()}</p><p>{prose()}</p>")
        elif kind == "comment":
            inner = "".join(rng.choice([f"<div class='comment-body'><p>{prose()}</p></div>", f"<p>{prose()}</p>", f"<li>{words(2)}: {prose()}</li>", f"<div>{prose()}</div>"]) for _ in range(rng.randint(1, 5)))
            inner = f"<h3>{words(1)}</h3>{inner}" if rng.random() < 0.5 else inner
        elif kind == "form":
            inner = f"<label>{words(2)}</label><input name=q><p>{words(rng.randint(2, 12))}</p>"
        else:
            inner = prose() if rng.random() < 0.6 else f"<p>{prose()}</p><p>{words(3)}</p>"
        return tagged(spec, inner, 0)

    out = []
    for _ in range(count):
        before = "".join(other(k) for k in ("header", "nav", "notice", "ad", "form", "side") if rng.random() < 0.45)
        after = "".join(other(k) for k in ("comment", "side", "ad", "share", "notice", "form", "footer") if rng.random() < 0.45)
        before += other("hidden") if rng.random() < 0.1 else other("label") if rng.random() < 0.05 else ""
        after += other("rights") if rng.random() < 0.2 else ""
        body, root = article(), ""
        if rng.random() < 0.88:
            body = tagged(rng.choice(ARTICLES.split(";")), body, 1)
        elif rng.random() < 0.5:
            body = f'<div data-y="1">{body}</div>'
        else:
            root = ' data-y="1"'  # an article that nothing encloses
        if rng.random() < 0.3:
            body = f"<div class=wrapper>{body}{other('side') if rng.random() < 0.5 else ''}</div>"
        for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
            body = tagged(rng.choice(WRAPPERS.split(";")), body, None)
        whole = f"{before}{body}{after}"
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            whole = tagged(rng.choice(WRAPPERS.split(";")), whole, None)
        out.append(f"<html><body{root}>{whole}</body></html>")
    return out


# ---- operator ---------------------------------------------------------------------------------

_MODEL: list[Model] = []


def model() -> Model:
    """The model fitted on ``labelled_pages``, once in a process; the fit is the same everywhere."""
    if not _MODEL:
        _MODEL.append(train(labelled_pages()))
    return _MODEL[0]


def main_text(page: str | None, fitted: Model) -> str:
    """Content blocks joined by newlines."""
    if not page:
        return ""
    nodes = parse(page)
    found = fitted.marginals(nodes)
    return "\n".join(n.text for n, p in zip(nodes, found) if n.text is not None and p >= 0.5)


def extract(df: DataFrame, fitted: Model, keep: list[str], page: str = "html") -> DataFrame:
    """The columns ``keep`` of every row, with ``text`` and its number of code points, ``n_chars``."""
    columns = df.select(*(df[k].alias(f"k{i}") for i, k in enumerate(keep)), df[page].alias("page"))

    def rows(parts):
        for part in parts:
            texts = [main_text(p, fitted) for p in part["page"]]
            yield [*(part[f"k{i}"] for i in range(len(keep))), texts, [len(t) for t in texts]]

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return map_rows(columns, f"{kinds}, text string, n_chars long", rows)
