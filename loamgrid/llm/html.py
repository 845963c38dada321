"""Main-text extraction: boosted trees over DOM-node features, decoded along the tree.

A forgiving parser builds the tree of block elements of a page. Each node is described by its tag,
the tokens of its class, id and role, its depth and place among siblings, and densities of its
subtree (text, links, tags, punctuation). Gradient-boosted trees give the log odds that the node
holds main text. Decoding picks the likeliest labelling in which whatever lies below a rejected
node is rejected too, by one pass up and one down the tree. Accepted nodes' own text is joined in
page order.

The trees are trained here, on pages made by a seeded generator of many layouts, whose nodes'
labels are known; nothing is learned from, or kept about, the pages that are read.

Edge cases: null and empty pages, and pages in which no node is accepted, have an empty text;
tags are read as browsers read them, so unclosed, stray and cut-off ones, odd quotes and random
bytes are tolerated (a tag that isn't ended, an open quote after =, and an unclosed script or style run
to the page's end); reading takes time in proportion to the page, whatever it holds, and whole pages
are read whatever their length; of labellings that tie the one that rejects is taken; null and
repeated page ids and repeated rows are rows like any other, equal pages get equal results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm._core import released, share, table, worker_state
from loamgrid.llm._trees import Boosted

# Possessive parts never go back, and every markup that begins also ends, at the page's end if nowhere else.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|\Z)"
    r"|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)",
    re.S,
)
#: Elements that hold no markup; what follows them is looked for by their end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "iframe", "textarea", "title", "xmp", "noembed", "noframes")}
#: Controls of forms: what they show is no text of the page. They end at the next block at the latest.
_CONTROLS = frozenset(("button", "label", "legend", "optgroup"))
#: The rest of a drawing's or formula's hint, which isn't shown.
_HINT = re.compile(r"[^<]*+</(?:desc|annotation)\s*+>", re.I)
_MARKS = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_TRUTH = re.compile(r"(?<![^\s\"'])data-y=([01])(?![^\s/])")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var img input picture audio video canvas area map object embed source track param wbr".split())
#: Elements of drawings and formulas; they are no blocks, and whether they are closed makes no difference.
_FOREIGN = frozenset("svg g defs symbol use path rect circle ellipse line polyline polygon text tspan textpath image switch view set animate animatemotion animatetransform mpath stop lineargradient radialgradient pattern clippath mask marker filter foreignobject feblend fecolormatrix fecomponenttransfer fecomposite feconvolvematrix fediffuselighting fedisplacementmap fedistantlight fedropshadow feflood fefunca fefuncb fefuncg fefuncr fegaussianblur feimage femerge femergenode femorphology feoffset fepointlight fespecularlighting fespotlight fetile feturbulence desc title math mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tbody", "tr", "td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "option": ("select",)}
_GROUPS = {t: i for i, g in enumerate(("html body", "article main", "nav menu", "aside", "footer", "header hgroup", "form fieldset legend dialog select", "p", "h1", "h2 h3 h4 h5 h6", "li dd dt", "ul ol dl", "table tbody thead tr td th", "blockquote pre figure figcaption", "section", "div center", "head")) for t in g.split()}
_GOOD = frozenset("article content main post entry story body text prose page copy essay markdown rich primary maincontent".split())
_BAD = frozenset("nav navbar navigation menu menubar footer foot header head masthead topbar sidebar side rail aside ad ads adv advert adverts advertisement banner sponsor sponsored promo promoted promotion comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert warning message toast popup modal overlay share sharing social related recommended more trending popular login signin signup register form search subscribe newsletter breadcrumb breadcrumbs pagination pager toolbar widget widgets legal copyright privacy terms skip meta byline tags tag contact feedback poll survey offer deal teaser links outbrain taboola complementary contentinfo dialog hidden".split())


class Page:
    """Block nodes in page order and the runs of text between their borders."""

    __slots__ = ("parent", "tag", "depth", "good", "bad", "mark", "links", "tags", "texts")

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.depth: list[int] = []
        self.good: list[int] = []
        self.bad: list[int] = []
        self.mark: list[int] = []
        self.links: list[int] = []  # characters inside links
        self.tags: list[int] = []  # elements of any kind, the node included
        self.texts: list[tuple[int, str]] = []


def _attributes(raw: str) -> tuple[int, int]:
    good = bad = 0
    for name, value in _MARKS.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            bad += 1
        else:
            words = {w.lower() for w in _WORD.findall(value)}
            good += len(words & _GOOD)
            bad += len(words & _BAD)
    return good, bad


def parse(source: str, marked: bool = True) -> Page:
    """The page's block tree. Markup that nests wrongly is repaired as browsers do in common cases.

    Only ``marked`` pages, those made here, have their ``data-y`` read.
    """
    page, stack = Page(), [0]
    parent, tags, depth = page.parent, page.tag, page.depth

    def node(tag: str, raw: str) -> int:
        i = len(parent)
        parent.append(stack[-1] if i else -1)
        tags.append(tag)
        depth.append(len(stack) if i else 0)
        g, b = _attributes(raw) if raw else (0, 0)
        truth = _TRUTH.search(raw) if marked else None
        page.good.append(g)
        page.bad.append(b + (tag == "template"))  # never shown, as what is hidden
        page.mark.append(int(truth[1]) if truth else -1)
        page.links.append(0)
        page.tags.append(1)
        return i

    open_at: dict[str, list[int]] = {}  # where in the stack each tag is open

    def close(at: int) -> None:
        while len(stack) > at:
            open_at[tags[stack.pop()]].pop()

    def innermost(names: tuple[str, ...]) -> int:
        return max((open_at[t][-1] for t in names if open_at.get(t)), default=0)

    node("html", "")
    buffer: list[str] = []
    link, last, control = 0, 0, ""

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                page.texts.append((stack[-1], text))

    while m := _TOKEN.search(source, last):
        start = m.start()
        if start > last and not control:
            text = source[last:start]
            buffer.append(text)
            if link:
                page.links[stack[-1]] += len(text)
        last = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in _RAW and not m[1] and not (name == "title" and m[3].endswith("/")):
            end = _RAW[name].search(source, last)
            last = end.end() if end else len(source)
            continue
        if name in ("desc", "annotation") and not m[1] and not m[3].endswith("/"):
            if end := _HINT.match(source, last):
                last = end.end()
            continue
        if name in _FOREIGN:
            continue
        if name in _CONTROLS:
            control = "" if m[1] else name
            if not m[1]:
                buffer.append(" ")
            continue
        if name in _INLINE:
            if name == "a":
                link = 0 if m[1] else 1
            if not m[1]:
                page.tags[stack[-1]] += 1
            continue
        if name == "br":
            buffer.append(" ")
            page.tags[stack[-1]] += 1
            continue
        flush()
        link, control = 0, ""
        if m[1]:
            if at := innermost((name,)):
                close(at)
            continue
        if name == "html" or (name == "body" and open_at.get("body")):
            continue
        while name in _CLOSES_P and tags[stack[-1]] in ("option", "select"):
            close(len(stack) - 1)
        if name in _CLOSES_P and tags[stack[-1]] == "p":
            close(len(stack) - 1)
        same = _SAME.get(name)
        if same and (at := innermost(same)) > innermost(_SCOPE[name]):
            close(at)
        if name in _VOID:
            page.tags[stack[-1]] += 1
            continue
        if name == "body":
            close(1)
        open_at.setdefault(name, []).append(len(stack))
        stack.append(node(name, m[3]))
    if last < len(source) and not control:
        buffer.append(source[last:])
        if link:
            page.links[stack[-1]] += len(source) - last
    flush()
    return page


N_GROUPS = 18
FEATURES = N_GROUPS + 21


def features(page: Page) -> np.ndarray:
    """A row per node: its tag group, attribute tokens, depth, siblings and subtree densities."""
    n = len(page.parent)
    parent = page.parent
    own, stops, blocks = [0] * n, [0] * n, [0] * n
    for i, t in page.texts:
        own[i] += len(t)
        stops[i] += t.count(".") + t.count(",") + t.count("!") + t.count("?")
        blocks[i] += 1
    text, links, tags, marks = own[:], page.links[:], page.tags[:], stops[:]
    paragraphs = [int(t == "p") for t in page.tag]
    size, children, bad_below = [1] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        text[p] += text[i]
        links[p] += links[i]
        tags[p] += tags[i]
        marks[p] += marks[i]
        paragraphs[p] += paragraphs[i]
        size[p] += size[i]
        bad_below[p] += bad_below[i] + (page.bad[i] > 0)
        children[p] += 1
    order, good_up, bad_up, bad_tag_up, good_tag_up, before, seen = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    total = max(1, text[0])
    at = 0
    start = [0] * n
    group = [_GROUPS.get(t, 17) for t in page.tag]
    for i in range(n):  # nodes are numbered in page order
        start[i] = at
        at += own[i]
    for i in range(1, n):
        p = parent[i]
        order[i] = seen[p]
        seen[p] += 1
        good_up[i] = good_up[p] + page.good[p]
        bad_up[i] = bad_up[p] + page.bad[p]
        bad_tag_up[i] = bad_tag_up[p] + (group[p] in (2, 3, 4, 5, 6))
        good_tag_up[i] = good_tag_up[p] + (group[p] == 1)
        before[i] = group[p]
    x = np.zeros((n, FEATURES))
    x[np.arange(n), group] = 1
    a = np.array
    t, o, k, kids = a(text, float), a(own, float), a(tags, float), a(children, float)
    up = a([max(0, p) for p in parent])
    cols = (a(page.good), a(page.bad), a(good_up), a(bad_up), a(bad_tag_up), a(good_tag_up), a(page.depth), a(order), kids[up], kids, np.log1p(t), a(links) / np.maximum(t, 1), t / k, a(marks) / np.maximum(t, 1), a(paragraphs), t / total, a(start) / total, np.log1p(o), a(links)[up] / np.maximum(t[up], 1), t / np.maximum(t[up], 1), a(bad_below) / a(size))
    for j, c in enumerate(cols):
        x[:, N_GROUPS + j] = c
    return x


def accepted(parent: list[int], odds: np.ndarray) -> list[bool]:
    """Likeliest labels such that only children of accepted nodes are accepted; the root always is."""
    n = len(parent)
    # gain of accepting a node with its best subtree, against rejecting the whole subtree
    gain = odds.tolist()
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    out = [False] * n
    if n:
        out[0] = True
    for i in range(1, n):
        out[i] = gain[i] > 0 and out[parent[i]]
    return out


def main_text(page: Page, odds: np.ndarray) -> str:
    ok = accepted(page.parent, odds)
    return " ".join(t for i, t in page.texts if ok[i] and (i or odds[0] > 0))


class _Maker:
    """Seeded pages of many layouts; ``data-y`` marks what is main text (1) and what is not (0)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = []
        for i in range(r.randint(low, high)):
            w = "".join(r.choice("aeiou") + r.choice("bcdfglmnrst") for _ in range(r.randint(1, 4)))
            out.append((w.capitalize() if i == 0 or out[-1].endswith(".") else w) + (r.choice([".", ",", "", "", "", "", "", ""]) if i else ""))
        return " ".join(out) + r.choice([".", ".", "", "!"])

    def box(self, names: str, tags: str = "div div div section") -> tuple[str, str]:
        """Open and close tag of a container, named in one of several ways or not at all."""
        r, tag = self.r, self.r.choice(tags.split())
        name = r.choice(names.split())
        name = r.choice([name, name, f"{name}-{r.choice(['box', 'wrap', 'inner', 'block', 'area', 'x1'])}", f"{r.choice(['site', 'page', 'js', 'm', 'top', 'col'])}-{name}"])
        attr = r.choice([f' class="{name}"', f' id="{name}"', f' class="{r.choice(["c", "x", "box", "row"])} {name}"'])
        return f"<{tag}{attr}", f"</{tag}>"

    def links(self) -> str:
        r = self.r
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(r.randint(3, 9))) + "</ul>"

    def junk(self) -> str:
        """One block that is not main text."""
        r = self.r
        k = r.randrange(11)
        body = r.choice([lambda: f"<p>{self.words(3, 40)}</p>", lambda: self.words(2, 30), lambda: f"<p>{self.words(3, 30)}</p><p>{self.words(3, 20)}</p>"])
        if k == 0:
            return f"<nav data-y=0>{self.links()}</nav>"
        if k == 1:
            # menus are told by their links where nothing names them
            o, c = ("<div", "</div>") if r.random() < 0.35 else self.box("menu nav breadcrumb breadcrumbs navigation", "div ul div")
            return f"{o} data-y=0>{self.links()}{c}"
        if k == 2:
            o, c = self.box("ad ads advert sponsor promo banner sponsored advertisement")
            return f"{o} data-y=0>{body()}{c}"
        if k == 3:
            return f"<aside data-y=0>{r.choice(['', '<h3>' + self.words(1, 3) + '</h3>'])}{r.choice([self.links, body])()}</aside>"
        if k == 4:
            o, c = self.box("sidebar related widget side rail trending popular recommended")
            return f"{o} data-y=0>{r.choice(['', '<h3>' + self.words(1, 3) + '</h3>'])}{r.choice([self.links, body])()}{c}"
        if k == 5:
            o, c = self.box("cookie notice alert consent warning popup modal newsletter subscribe")
            return f"{o} data-y=0>{body()}{r.choice(['', '<button>OK</button>'])}{c}"
        if k == 6:
            o, c = r.choice([("<form", "</form>"), self.box("login search signup form")])
            return f'{o} data-y=0>{r.choice(["<label>" + self.words(1, 3) + "</label><input name=q>", "<p>" + self.words(3, 12) + "</p><input>"])}<button>{self.words(1, 2)}</button>{c}'
        if k == 7:
            o, c = self.box("share social toolbar tags pagination")
            if r.random() < 0.25:
                return f"<div data-y=0>{self.links()}</div>"
            return f"{o} data-y=0>{r.choice([self.links, lambda: self.words(1, 8)])()}{c}"
        if k == 8:
            return f"<header data-y=0>{r.choice(['<h1>' + self.words(1, 3) + '</h1>', self.links(), '<p>' + self.words(2, 8) + '</p>'])}</header>"
        if k == 9:
            o, c = self.box("header masthead topbar head")
            return f"{o} data-y=0>{r.choice([self.links, body])()}{c}"
        return f"<footer data-y=0>{r.choice([self.links, lambda: '&copy; ' + self.words(2, 20), body])()}</footer>"

    def comments(self) -> str:
        r = self.r
        o, c = self.box("comments comment replies discussion respond", "div section ol")
        if r.random() < 0.2:
            o = '<section aria-label="comments"'
            c = "</section>"
        each = r.choice(["<p>{}</p>", "<div class=comment><b>x</b><p>{}</p></div>", "<li><p>{}</p></li>", "<article class=comment><p>{}</p></article>", "<div>{}</div>"])
        return f"{o} data-y=0>{r.choice(['', '<h2>Comments</h2>', '<h3>' + self.words(1, 3) + '</h3>'])}" + "".join(each.format(self.words(4, 60)) for _ in range(r.randint(1, 6))) + c

    def block(self) -> str:
        """One block of main text."""
        r, k = self.r, self.r.random()
        inline = r.choice(["{}", "{}", "{}", "<b>{}</b>", "{} <a href=/x>abeda</a> og {}", "<em>{}</em> {}", "{}<br>{}"])
        text = inline.replace("{}", "\0", 2)
        while "\0" in text:
            text = text.replace("\0", self.words(1, r.choice([4, 12, 60, 160])), 1)
        if k < 0.72:
            return f"<p data-y=1>{text}{r.choice(['</p>', '</p>', '</p>', ''])}"
        if k < 0.78:
            return f"<h{(h := r.randint(2, 4))} data-y=1>{self.words(1, 8)}</h{h}>"
        if k < 0.83:
            return "<ul>" + "".join(f"<li data-y=1>{self.words(3, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if k < 0.87:
            return f"<blockquote><p data-y=1>{text}</p></blockquote>"
        if k < 0.9:
            return "<table>" + "".join(f"<tr><td data-y=1>{self.words(1, 6)}</td><td data-y=1>{self.words(1, 6)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if k < 0.92:
            return f"<pre data-y=1>{text}</pre>"
        if k < 0.94:
            return f"<figure><img src=x><figcaption data-y=1>{self.words(2, 15)}</figcaption></figure>"
        return f"<div data-y=1>{text}</div>"

    def page(self) -> str:
        r = self.r
        out = ["<html><head><title>x</title></head><body>"]
        shells = r.randint(0, 2)
        closes = []
        for _ in range(r.randint(0, 4)):
            out.append(self.junk())
        for _ in range(shells):
            o, c = self.box("container wrapper layout site grid outer", "div div main")
            out.append(o + ">")
            closes.append(c)
            if r.random() < 0.4:
                out.append(self.junk())
        kind = r.random()
        if kind < 0.45:
            o, c = r.choice([("<article", "</article>"), ("<main", "</main>"), ('<div role="main"', "</div>"), ("<main><article", "</article></main>")])
        elif kind < 0.75:
            o, c = self.box("article content post entry story main text body prose")
        elif kind < 0.92:
            o, c = self.box("x1 c2 box42 col wide z-9 q")
        else:
            o, c = "<div", "</div>"
        out.append(o + ">")
        if r.random() < 0.8:
            out.append(f"<h1 data-y=1>{self.words(2, 10)}</h1>")
        for i in range(r.choice([1, 1, 2, 3, 5, 8, 15])):
            if i and r.random() < 0.1:
                out.append(self.junk())
            out.append(self.block())
        inner = r.random()
        if inner < 0.2:
            out.append(self.comments())
        out.append(c)
        if inner > 0.75:
            out.append(self.comments())
        while closes:
            if r.random() < 0.4:
                out.append(self.junk())
            out.append(closes.pop())
        for _ in range(r.randint(0, 3)):
            out.append(self.junk())
        if r.random() < 0.7:
            out.append(r.choice([f"<footer data-y=0>&copy; {self.words(2, 25)}", f'<div class="footer" data-y=0><p>{self.words(2, 25)}</p></div></body></html>', f"<footer data-y=0>&copy; {self.words(2, 25)}</footer></body></html>"]))
        return "".join(out)


def labels(page: Page) -> np.ndarray:
    """1 for nodes that hold main text, themselves or below."""
    n = len(page.parent)
    y, state = np.zeros(n), list(page.mark)
    for i in range(1, n):
        if state[i] < 0 and state[page.parent[i]] == 0:
            state[i] = 0
    holds = {i for i, _ in page.texts}
    for i in range(n - 1, -1, -1):
        if state[i] == 1 and i in holds:
            y[i] = 1
        if y[i] and i:
            y[page.parent[i]] = 1
    y[0] = 1
    return y


def train(pages: int = 700, seed: int = 11) -> Boosted:
    maker = _Maker(seed)
    parsed = [parse(maker.page()) for _ in range(pages)]
    x, y = np.concatenate([features(p) for p in parsed]), np.concatenate([labels(p) for p in parsed])
    return Boosted(x, y, trees=60, depth=4, rate=0.3)


def model() -> Boosted:
    """The trained trees, made once per process."""
    state = worker_state("html")
    if not hasattr(state, "model"):
        state.model = train()
    return state.model


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): main text of every page's whole html."""
    shared = share(pages.sparkSession, model())  # 60 trees of depth 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared()
        for batch in batches:
            out: list[str] = []
            source = batch.column(2)
            for a in range(0, batch.num_rows, 256):
                parsed = [parse(v.as_py() or "", marked=False) for v in source.slice(a, 256)]
                x = [features(p) for p in parsed]
                odds = trees.raw(np.concatenate(x))
                at = 0
                for p, f in zip(parsed, x, strict=True):
                    out.append(main_text(p, odds[at : at + len(f)]))
                    at += len(f)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(released(run), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
