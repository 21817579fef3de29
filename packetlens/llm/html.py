"""Main text of web pages by a tree-structured graphical model of the DOM.

Block elements and the runs of text in them are nodes. A node is content or not; its own evidence (tag, words of class
and id, share of links, length, signs) and a potential between parent and child are learned by counting over labelled
pages. Sum-product messages, upward from the leaves and downward from the root, give every node's exact marginal; the
runs whose marginal exceeds one half are the text. Elements that say nothing (a div without a word that the model knows)
part blocks but are no nodes, so that nesting, however deep, changes nothing.

The labelled pages are generated here, from a fixed seed: layouts of sites with menus, headers, footers, sidebars,
notices, adverts, forms and reader comments round an article, every element carrying its label.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter, defaultdict
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page; script and style reach to the end of the page if nothing closes them.
RAW = frozenset("script style template iframe textarea title svg select".split())
#: Elements that stand for what is in them.
TRANSPARENT = frozenset("noscript object math canvas video audio picture".split())
INLINE = frozenset("a abbr b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote body details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html main menu nav ol p pre section table ul".split())
#: Block elements; others that are not inline group what is in them.
ELEMENTS = CLOSES_P | frozenset("body caption dd dt legend li option optgroup summary tbody td tfoot th thead tr dialog".split())
#: An open element that the start of one of these ends, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|data-is)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: The rest of a tag: quotes count behind an equals sign, if they are closed.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+>""")
_WORD = re.compile(r"[a-z]+")


#: Tags of text, which hardly ever part from what they are in; and those that tell something of all that is in them.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption details summary address".split())
TELLING = frozenset("article aside blockquote dialog footer form header main nav section table".split())
#: Elements that are no nodes where none of their words is known.
GROUPING = frozenset("div section center".split())


class Node:
    """A block element, or a run of text (tag "#"), with its place in the list of nodes as its parent's index.

    marks: words of its classes and its tag, if that tells something, as far as no node above has them.
    """

    __slots__ = ("parent", "tag", "words", "marks", "label", "inside", "place", "parts", "size", "linked")

    def __init__(self, parent: int, tag: str, words: tuple[str, ...], marks: tuple[str, ...], label: int | None, inside: bool):
        self.parent, self.tag, self.words, self.marks, self.label, self.inside = parent, tag, words, marks, label, inside
        self.place = "inside" if inside else ""
        self.parts: list[str] = []
        self.size = self.linked = 0

    @property
    def kind(self) -> str:
        return "run" if self.tag == "#" else "flow" if self.tag in FLOW else "box"


def _tag_end(html: str, at: int) -> int:
    """Index after the rest of a tag from ``at`` on."""
    m = _REST.match(html, at)
    return m.end() if m else len(html)


def parsed(html: str, known: frozenset[str] | None = None) -> list[Node]:
    """Nodes in page order, parents first. ``known``: words that tell something, None for all."""
    nodes = [Node(-1, "html", (), (), None, False)]
    stack: list[tuple[str, int]] = [("html", 0)]  # inline and grouping elements stand for the block they are in
    opened: Counter[str] = Counter()  # tags of the stack
    marked: Counter[str] = Counter()  # marks of the nodes that are open
    labels: list[int | None] = [None]  # of the elements of the stack
    raw_ends: dict[str, int] = {}  # from here on nothing closes the tag
    run: Node | None = None
    links = 0
    at, n = 0, len(html)

    def text(s: str) -> None:
        nonlocal run
        if not s:
            return
        s = unescape(s) if "&" in s else s
        if run is None:
            if s.isspace():
                return
            block = nodes[stack[-1][1]]
            run = Node(stack[-1][1], "#", (), (), labels[-1], block.inside)
            nodes.append(run)
        run.parts.append(s)
        size = len(s.strip())
        run.size += size
        run.linked += size if links else 0

    def enter(tag: str, node: int, label: int | None) -> None:
        stack.append((tag, node))
        labels.append(label)
        opened[tag] += 1

    def leave(k: int) -> None:
        nonlocal links, run
        while len(stack) > k:
            tag, node = stack.pop()
            labels.pop()
            opened[tag] -= 1
            links -= tag == "a"
            if tag not in INLINE and tag not in TRANSPARENT:
                run = None
            if tag not in INLINE and stack[-1][1] != node:
                marked.subtract(nodes[node].marks)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        if lt > at:
            text(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        closing = html.startswith("</", lt)
        m = _NAME.match(html, lt + 1 + closing)
        if not m:
            if html[lt + 1 : lt + 2] in ("!", "?") or closing:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                text("<")
                at = lt + 1
            continue
        tag, at = m[0].lower(), _tag_end(html, m.end())
        if closing:
            k = len(stack) - 1 if opened[tag] else 0
            while k and stack[k][0] != tag:
                # an inline element ends with its block
                k = 0 if tag in INLINE and stack[k][0] not in INLINE else k - 1
            if k:
                leave(k)
            elif tag == "p":
                run = None
            continue
        if tag in RAW or (tag == "button" and run is None):
            if lt >= raw_ends.get(tag, n):
                end = None
            elif (end := re.compile(f"</{tag}(?![a-z0-9])", re.I).search(html, at)) is None:
                raw_ends[tag] = lt
            if end is not None:
                at = _tag_end(html, end.end())
            elif tag in ("script", "style"):
                at = n
            continue
        if tag in VOID:
            if tag == "hr":
                run = None
            else:
                text(" ") if run is not None else None
            continue
        if tag in INLINE or tag in TRANSPARENT:
            enter(tag, stack[-1][1], labels[-1])
            links += tag == "a"
            continue
        if tag in CLOSES_P or tag == "option":
            k = len(stack) - 1
            while stack[k][0] in INLINE:
                k -= 1
            if stack[k][0] in ("p", "option"):
                leave(k)
        if tag in ENDS:
            ended, stop = ENDS[tag]
            for k in range(len(stack) - 1 if any(opened[x] for x in ended) else 0, 0, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in ended:
                    leave(k)
                    break
        run = None
        label, words = None, []
        for a in _ATTR.finditer(html, m.end(), at):
            value = a[2] or a[3] or a[4] or ""
            if a[1].lower() == "data-is":
                label = int(value)
            else:
                words += _WORD.findall(value.lower())
        if known is not None:
            words = [w for w in words if w in known]
        label = label if label is not None else labels[-1]
        if tag in ("html", "body") and len(stack) == 1:
            nodes[0].label = labels[0] = label
            continue
        if (tag in GROUPING or tag not in ELEMENTS) and not words:
            enter(tag, stack[-1][1], label)
            continue
        above = nodes[stack[-1][1]]
        words = tuple(dict.fromkeys(words))
        marks = tuple(w for w in ((f"<{tag}>", *words) if tag in TELLING else words) if not marked[w])
        marked.update(marks)
        nodes.append(Node(stack[-1][1], tag, words, marks, label, above.inside or tag in ("article", "main")))
        enter(tag, len(nodes) - 1, label)
    if any(x.inside for x in nodes):
        for x in nodes:
            x.place = x.place or "beside"
    return nodes


def evidence(node: Node) -> list[tuple[str, str]]:
    """What is seen of a node by itself: pairs of a kind and a value. Kinds tell apart nodes inside an article, beside
    one, and of pages that mark none."""
    within = f" {node.place}"
    if node.tag != "#":
        return [(f"tag{within}", node.tag), *(("word", w) for w in node.words)]
    tail = next((x.rstrip()[-1:] for x in reversed(node.parts) if x.strip()), "")
    return [
        ("links", str(min(3, int(node.linked / max(1, node.size) * 4)))),
        (f"length{within}", str(min(4, int(math.log2(1 + node.size)) // 2))),
        (f"ends{within}", str(tail in ".!?")),
        ("copyright", str(any("©" in x for x in node.parts))),
    ]


def above(nodes: list[Node], node: Node) -> list[tuple[str, str]]:
    """Marks of all the node's ancestors, each once."""
    out, k = [], node.parent
    while k >= 0:
        out += [(f"above {node.place}", w) for w in nodes[k].marks]
        k = nodes[k].parent
    return out


PLACES = ("", "inside", "beside")


class Model:
    """Log potentials: of evidence for (not content, content), and between the labels of parent and child."""

    def __init__(self, pages: list[str]):
        seen: dict[tuple[str, str], list[float]] = defaultdict(lambda: [1.0, 1.0])
        total: dict[str, list[float]] = defaultdict(lambda: [8.0, 8.0])
        # by kind and place of the child: an element may part from its parent, a run of text hardly ever does
        pair = {(kind, place): [[1.0, 1e-3], [0.1, 1.0]] for kind in ("run", "flow", "box") for place in PLACES}
        for page in pages:
            nodes = parsed(page)
            for x in nodes[1:]:
                y = x.label or 0
                pair[x.kind, x.place][nodes[x.parent].label or 0][y] += 1
                for e in evidence(x) + above(nodes, x):
                    seen[e][y] += 1
                    total[e[0]][y] += 1
        self.own = {e: (math.log(a / total[e[0]][0]), math.log(b / total[e[0]][1])) for e, (a, b) in seen.items()}
        self.pair = {kind: [[math.log(c / sum(row)) for c in row] for row in rows] for kind, rows in pair.items()}
        self.words = frozenset(w for kind, w in self.own if kind == "word" or kind.startswith("above"))

    def parsed(self, html: str) -> list[Node]:
        return parsed(html, self.words)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of every node: one pass up, one pass down."""
        n = len(nodes)
        own = [[0.0, 0.0] for _ in nodes]
        # what the marks of a node and of all above it say of a node below, by that node's place
        say: list[dict[str, tuple[float, float]]] = []
        nothing = (0.0, 0.0)
        for x, o in zip(nodes, own):
            if x.parent >= 0:
                o[0], o[1] = say[x.parent][x.place]
                for e in evidence(x):
                    a, b = self.own.get(e, nothing)
                    o[0] += a
                    o[1] += b
            before = say[x.parent] if x.parent >= 0 else dict.fromkeys(PLACES, nothing)
            if x.marks:
                given = {p: [self.own.get((f"above {p}", w), nothing) for w in x.marks] for p in PLACES}
                before = {p: (before[p][0] + sum(a for a, _ in g), before[p][1] + sum(b for _, b in g)) for p, g in given.items()}
            say.append(before)
        own[0][0] = -20.0  # the page as a whole leads to content
        up = [(0.0, 0.0)] * n  # message from the node to its parent
        for i in range(n - 1, 0, -1):
            a, b = own[i]
            (p00, p01), (p10, p11) = self.pair[nodes[i].kind, nodes[i].place]
            m = (_add(p00 + a, p01 + b), _add(p10 + a, p11 + b))
            up[i] = m
            o = own[nodes[i].parent]
            o[0] += m[0]
            o[1] += m[1]
        # own now is the belief of the subtree; going down it gets what the rest of the page says
        for i in range(1, n):
            q = own[nodes[i].parent]
            a, b = q[0] - up[i][0], q[1] - up[i][1]
            (p00, p01), (p10, p11) = self.pair[nodes[i].kind, nodes[i].place]
            own[i][0], own[i][1] = own[i][0] + _add(a + p00, b + p10), own[i][1] + _add(a + p01, b + p11)
        return [1 / (1 + math.exp(min(700.0, max(-700.0, o[0] - o[1])))) for o in own]


def _add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def labelled_pages(count: int = 1200, seed: int = 5) -> list[str]:
    """Training pages; data-is="1" marks what is content or leads to it, "0" what is not."""
    rng = random.Random(seed)

    def prose(lo: int, hi: int) -> str:
        ws = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        for k in range(0, len(ws), rng.randint(6, 14)):
            ws[k] = ws[k].capitalize()
            if k:
                ws[k - 1] += rng.choice(".,.")
        return " ".join(ws) + rng.choice([".", ".", "!", "?", "", ""])

    def element(tag: str, inner: str, is_: int, names: list[str] | None = None) -> str:
        # what neither its tag nor a word tells apart nobody could
        named = names and (rng.random() < 0.8 or (not is_ and tag in GROUPING))
        name = f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"' if named else ""
        return f'<{tag}{name} data-is="{is_}">{inner}</{tag}>'

    def link(words: int = 2) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{prose(1, words)}</a>'

    def menu() -> str:
        return element("ul", "".join(element("li", link(), 0) for _ in range(rng.randint(3, 9))), 0, ["menu", "nav-list", "links"])

    def box(tag: str, inner: str, *names: str) -> str:
        return element(tag, inner, 0, list(names))

    def remarks() -> str:
        """Readers' comments, with a heading or without, in lists, boxes or bare paragraphs."""
        head = element(rng.choice(["h2", "h3", "h4"]), prose(1, 3), 0) if rng.random() < 0.6 else ""
        each = [element("p", prose(4, 60), 0) for _ in range(rng.randint(1, 5))]
        kind = rng.choice(["div", "li", "article", ""])
        each = [box(kind, x, "comment", "reply", "comment-body") if kind else x for x in each]
        body = element("ol", "".join(each), 0) if kind == "li" else "".join(each)
        return box(rng.choice(["section", "div"]), head + body, "comments", "comment-list", "responses", "discussion", "disqus")

    def teasers() -> str:
        """Other stories."""
        head = element(rng.choice(["h2", "h3"]), prose(1, 4), 0) if rng.random() < 0.7 else ""
        each = [element(rng.choice(["h3", "p", "h4"]), link(5), 0) + rng.choice(["", element("p", prose(4, 25), 0)]) for _ in range(rng.randint(1, 4))]
        body = "".join(box(rng.choice(["div", "article"]), x, "teaser", "card", "story-card") for x in each) if rng.random() < 0.5 else "".join(each)
        return box(rng.choice(["section", "div", "aside"]), head + body, "related", "more", "recommended", "popular", "latest")

    def junk() -> str:
        p = lambda lo=3, hi=25: element("p", prose(lo, hi), 0)
        some = lambda: rng.choice([prose(2, 20), p(), p() + p()])
        return rng.choice([
            lambda: box("nav", menu(), "nav", "navigation", "menu", "breadcrumb"),
            lambda: box("div", menu(), "menu", "navbar", "nav", "breadcrumbs", "pagination", "tags"),
            lambda: box("header", element("h1", prose(1, 4), 0) + rng.choice(["", menu(), p(2, 8)]), "header", "site-header", "masthead", "banner"),
            lambda: box("footer", rng.choice(["&copy; ", ""]) + prose(3, 20) + rng.choice(["", menu()]), "footer", "site-footer"),
            lambda: box("aside", some() + rng.choice(["", menu()]), "sidebar", "aside", "widget", "related"),
            lambda: box("div", some(), "sidebar", "side", "widget", "related", "recommended", "promo"),
            lambda: box("div", some(), "ad", "ads", "advert", "advertisement", "sponsored", "banner-ad", "promo"),
            lambda: box("div", some(), "cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "banner"),
            lambda: box("form", element("label", prose(1, 3), 0) + prose(1, 6) + element("p", prose(1, 8), 0), "search", "login", "newsletter", "subscribe", "form"),
            remarks,
            teasers,
            lambda: box("div", link(1) * 3 + prose(1, 4), "share", "social", "follow"),
        ])()

    def block() -> str:
        x = rng.random()
        if x < 0.64:
            inner = prose(*rng.choice([(1, 4), (2, 12), (2, 90), (20, 90)]))
            return element("p", rng.choice([inner, f"<b>{inner}</b>", f"{inner} {link()} {prose(2, 20)}", f"{prose(1, 2)} {link(9)} {prose(1, 2)} {link(5)}.", f"{inner}<br>{prose(2, 9)}"]), 1)
        if x < 0.72:
            return element(rng.choice(["h2", "h3"]), prose(1, 9), 1)
        if x < 0.88:
            return element(rng.choice(["ul", "ol"]), "".join(element("li", prose(*rng.choice([(1, 3), (3, 20)])), 1) for _ in range(rng.randint(2, 8))), 1)
        if x < 0.9:
            return element("div", prose(4, 40), 1)
        if x < 0.94:
            return element("blockquote", element("p", prose(5, 40), 1), 1)
        return prose(4, 40) + rng.choice(["", " " + link() + " " + prose(1, 9)])

    def article() -> str:
        title = element("h1", prose(2, 9), 1)
        title = element("header", title, 1) if rng.random() < 0.15 else title
        inner = title + "".join(nested(block(), 1) for _ in range(rng.choice([rng.randint(0, 9), rng.randint(0, 30)])))
        if rng.random() < 0.35:
            at = len(title)
            inner = rng.choice([inner + junk(), inner[:at] + junk() + inner[at:]])
        kind = rng.random()
        if kind < 0.7:
            return element("article", inner, 1, ["post", "article", "entry", "story"] if rng.random() < 0.3 else None)
        if kind < 0.85:
            return element("main", inner, 1, ["content", "main"])
        return element("div", inner, 1, ["content", "main-content", "post-body", "article", "entry-content", "story", "text"])

    def nested(inner: str, is_: int) -> str:
        """In up to four elements that say nothing, most often none."""
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 4])):
            inner = element(rng.choice(["div", "div", "section"]), inner, is_)
        return inner

    out = []
    for _ in range(count):
        before, after = ("".join(junk() for _ in range(rng.randint(0, 3))) for _ in "ab")
        body = before + article() + after
        for _ in range(rng.choice([0, 0, 1, 2])):
            body = element(rng.choice(["div", "section", "main"]), body, 1, ["wrapper", "page", "container", "wrap"])
        out.append(f'<html data-is="1"><body>{body}</body></html>')
    return out


@functools.lru_cache(maxsize=1)
def model() -> Model:
    return Model(labelled_pages())


def main_blocks(html: str | None, trained: Model | None = None) -> list[str]:
    """Blocks of main text in page order, white space turned into one space each."""
    if not html:
        return []
    trained = trained or model()
    nodes = trained.parsed(html)
    likely = trained.marginals(nodes)
    blocks = (" ".join("".join(x.parts).split()) for x, p in zip(nodes, likely) if x.tag == "#" and p > 0.5)
    return [b for b in blocks if b]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages``.

    text: the blocks of main text joined by two line feeds; empty if html is null or empty or has none. Whole pages
    are read, whatever their length; rows are independent, repeated rows repeat, an empty table gives no rows.
    """

    trained = model()

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series(["\n\n".join(main_blocks(x, trained)) for x in pages], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def oracle() -> str:
    """DuckDB SQL for ``extracted`` on pages like the driver's: one article of h1 and p blocks, three references."""
    tags, blanks = "'<[^>]*>'", "'[\\s\\x{00A0}]+'"
    clean = f"regexp_replace(x, {tags}, ' ', 'g')"
    for name, sign in (("quot", '"'), ("lt", "<"), ("amp", "&")):  # the semicolon may be missing
        clean = f"regexp_replace({clean}, '&{name};?', '{sign}', 'g')"
    clean = f"trim(regexp_replace({clean}, {blanks}, ' ', 'g'))"
    blocks = f"list_filter(list_transform(string_split_regex(replace(replace(body, '<b>', ''), '</b>', ''), '</?(p|h1)>'), lambda x: {clean}), lambda x: x <> '')"
    return f"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) body from pages),
b as (select page_id, url, array_to_string({blocks}, chr(10) || chr(10)) as text from a)
select page_id, url, text, length(text)::bigint n_chars from b"""
