"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the element tree.

A block is the text between two block-level tags. Its features are what its ancestors are (tags, roles, words in
class and id), its own tag, and its text (length, links, punctuation, capitals). The field is fitted on labelled
pages, built here from many layouts, with and without telling tags, and decoded by Viterbi on every page.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm import crf
from dataprobe.llm.text import column

# fixed values: tags of the HTML standard by what they do to the flow of text
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template svg math iframe object audio video canvas textarea select datalist".split())
RAW = frozenset("script style title textarea".split())
#: tags that an opening tag closes, looked for up to one of the bounds
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "a": ({"a"}, {"div", "table"}), "body": ({"head"}, set()),
}
#: what an ancestor can be: tags and roles, and words in class or id
KINDS = (
    ("main", {"article", "main"}, {"article", "content", "post", "entry", "story", "main", "text", "body"}),
    ("menu", {"nav", "menu", "navigation", "menubar"}, {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager"}),
    ("header", {"header", "banner"}, {"header", "masthead", "topbar", "banner"}),
    ("footer", {"footer", "contentinfo"}, {"footer", "copyright", "legal", "colophon", "imprint"}),
    ("aside", {"aside", "complementary"}, {"aside", "sidebar", "related", "widget", "share", "social", "recommended", "teaser", "tags", "author", "byline"}),
    ("advert", set(), {"ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion"}),
    ("notice", {"dialog", "alert", "alertdialog"}, {"cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "gdpr", "warning", "overlay"}),
    ("form", {"form", "button", "label", "fieldset", "legend", "select", "search"}, {"form", "search", "login", "signup"}),
    ("comments", {"comment"}, {"comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "reviews"}),
    ("list", {"ul", "ol", "dl"}, set()),
    ("table", {"table"}, set()),
    ("figure", {"figure"}, {"caption", "gallery"}),
    ("hidden", set(), {"hidden", "hide", "invisible"}),
)
PAGES = 400
#: elements nested deeper count as part of the one they are in, as in browsers
DEEPEST = 512
_SIGN = ("\ue000", "\ue001")
OWN = ("p", "h1", "h2", "h3", "li", "div", "td", "blockquote", "pre", "body")

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|$)|([!?][^>]*+)(?:>|$)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"?+|'[^']*+'?+)*+)(>|$))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BIT = {name: 1 << i for i, (name, _, _) in enumerate(KINDS)}
_SKIP = 1 << len(KINDS)


@lru_cache(maxsize=50_000)
def _mask(tag: str, attributes: str) -> int:
    """What an element is, as bits."""
    out = _SKIP if tag in UNSEEN else 0
    names = {tag}
    said: set[str] = set()
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "role":
                names.add(value)
            elif name in ("class", "id"):
                said.update(re.split(r"[^a-z0-9]+", value))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                said.add("hidden")
    for kind, tags, words in KINDS:
        if names & tags or said & words:
            out |= _BIT[kind]
    return out


def blocks(page: str) -> list[tuple[str, int, str, int]]:
    """(own tag, ancestor bits, text, characters inside links) of the leaf blocks in page order."""
    out: list[tuple[str, int, str, int]] = []
    stack: list[tuple[str, int, str]] = [("body", 0, "body")]  # tag, bits of it and its ancestors, nearest block tag
    parts: list[str] = []
    linked = 0
    links = 0
    deeper: Counter[str] = Counter()  # open elements that are not on the stack, by tag
    unseen = 0  # and how many of them hide what they hold

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((stack[-1][2], stack[-1][1], text, linked))
        linked = 0

    def close(at: int) -> None:
        """Close the elements from place ``at`` of the stack on."""
        nonlocal links
        if any(t in BLOCKS for t, _, _ in stack[at:]):
            flush()
        links -= sum(t == "a" for t, _, _ in stack[at:])
        del stack[at:]

    def say(text: str) -> None:
        nonlocal linked
        if text and not unseen and not stack[-1][1] & _SKIP:
            parts.append(text)
            if links:
                linked += len(text)

    place, n = 0, len(page)
    while place < n:
        m = _TAG.search(page, place)
        if m is None:
            say(page[place:])
            break
        say(page[place : m.start()])
        place = m.end()
        tag = (m[4] or "").lower()
        if not tag or not m[6]:
            continue
        if m[3] and deeper[tag]:
            deeper[tag] -= 1
            unseen -= tag in UNSEEN
            if tag in BLOCKS:
                flush()
            continue
        if m[3]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if at:
                close(at)
            elif tag == "p":
                flush()
            continue
        if tag in BLOCKS:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("p", "button", "table")), 0)
            if at and stack[at][0] == "p":
                close(at)
            flush()
        elif tag == "br":
            say(" ")
        if tag in CLOSES:
            gone, bounds = CLOSES[tag]
            at = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in bounds:
                    break
                if stack[i][0] in gone:
                    at = i
            if at:
                close(at)
        if tag in VOID or m[5].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in ("html", "body"):
            stack[0] = ("body", stack[0][1], "body")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, place)
            place = end.end() if end else n
            continue
        if len(stack) > DEEPEST:
            deeper[tag] += 1
            unseen += tag in UNSEEN
            continue
        links += tag == "a"
        stack.append((tag, stack[-1][1] | _mask(tag, m[5]), tag if tag in BLOCKS else stack[-1][2]))
    flush()
    return out


def features(found: list[tuple[str, int, str, int]]) -> list[list[float]]:
    out = []
    for tag, bits, text, linked in found:
        n = text.count(" ") + 1
        size = len(text)
        out.append([
            *[float(bits >> i & 1) for i in range(len(KINDS))], *[float(tag == t) for t in OWN],
            math.log1p(n), min(1.0, linked / size), float(text[-1] in ".!?:\"'”"), sum(map(text.count, ".,;")) / n, float(n <= 3), float("©" in text or "(c)" in text), sum(map(str.isdigit, text)) / size,
        ])
    return out


def _words(rng: random.Random, n: int, end: str = ".") -> str:
    ws = ["".join(rng.choice("aeioulnrstdm") for _ in range(rng.randrange(1, 9))) for _ in range(max(n, 1))]
    for i in range(len(ws)):
        if i == 0 or ws[i - 1].endswith("."):
            ws[i] = ws[i].capitalize()
        if rng.random() < 0.08:
            ws[i] += "," if rng.random() < 0.5 else "."
    return " ".join(ws) + end


def labelled_page(rng: random.Random) -> list[tuple[str, int]]:
    """A page as (markup, label) in order; label 1 is main text, 0 other text, -1 no text."""
    page: list[tuple[str, int]] = []
    put = lambda markup, label=-1: page.append((markup, label))
    pick = rng.choice
    telling = rng.random() < 0.75

    def link(n: int) -> str:
        return f'<a href="/x">{_words(rng, n, "")}</a>'

    def menu() -> None:
        top = pick(["<nav>", '<nav class="nav">', '<div class="menu">', '<div id="navigation">', '<div role="navigation">'])
        put(top + "<ul>")
        for _ in range(rng.randrange(2, 8)):
            put(f"<li>{link(rng.randrange(1, 3))}</li>", 0)
        put("</ul></nav>" if top.startswith("<nav") else "</ul></div>")

    def other(kind: str) -> None:
        long = _words(rng, rng.randrange(3, 25))
        if kind == "ad":
            put(f'<div class="{pick(["ad", "ads", "advert", "sponsored box", "promo"])}">{long}</div>', 0)
        elif kind == "notice":
            put(f'<div {pick(["class=cookie-notice", "id=consent", "role=alert", "class=newsletter"])}>{long} <button>{_words(rng, 1, "")}</button>', 0)
            put("</div>")
        elif kind == "aside":
            top = pick(["<aside>", '<aside class="widget">', '<div class="sidebar">', '<div class="related">'])
            put(f"{top}<h3>{_words(rng, 2, '')}</h3>", 0)
            for _ in range(rng.randrange(1, 5)):
                put(f"<li>{link(rng.randrange(2, 8))}</li>" if rng.random() < 0.6 else f"<p>{_words(rng, rng.randrange(4, 20))}</p>", 0)
            put("</aside>" if top.startswith("<aside") else "</div>")
        elif kind == "form":
            put(f"<form><label>{_words(rng, 2, ':')}</label>", 0)
            put(f"<input><button>{_words(rng, 1, '')}</button></form>", 0)
        elif kind == "comments":
            top = pick(['<section id="comments">', '<div class="comments">', '<div id="disqus">'])
            put(f"{top}<h3>{_words(rng, 2, '')}</h3>", 0)
            for _ in range(rng.randrange(1, 5)):
                put(f"<{pick(['p', 'li', 'div class=comment'])}>{_words(rng, rng.randrange(3, 40))}", 0)
            put("</section>" if top.startswith("<section") else "</div>")
        elif kind == "footer":
            top = pick(["<footer>", '<div class="footer">', '<div id="copyright">'])
            put(f"{top}&copy; {_words(rng, rng.randrange(2, 15))}", 0)
            if rng.random() < 0.3:
                put(f"<p>{link(2)} | {link(1)}</p>", 0)
            put("</footer>" if top == "<footer>" else "</div>")
        elif kind == "header":
            top = pick(["<header>", '<div class="header">', '<div id="masthead">'])
            put(f"{top}<h1>{_words(rng, 2, '')}</h1>" if rng.random() < 0.5 else f"{top}<p>{link(2)}</p>", 0)
            put("</header>" if top == "<header>" else "</div>")

    def body() -> None:
        put(f"<h1>{_words(rng, rng.randrange(3, 11), '')}</h1>", 1)
        for _ in range(rng.randrange(1, 9)):
            r = rng.random()
            n = pick([rng.randrange(1, 6), rng.randrange(5, 40), rng.randrange(40, 150)])
            if r < 0.72:
                open_p = rng.random() < 0.3
                put(f"<p>{'<b>' if open_p else ''}{_words(rng, n)}{'<br>' if open_p else '</p>'}", 1)
            elif r < 0.78:
                put(f"<h2>{_words(rng, rng.randrange(2, 8), '')}</h2>", 1)
            elif r < 0.84:
                put("<ul>")
                for _ in range(rng.randrange(1, 5)):
                    put(f"<li>{_words(rng, rng.randrange(2, 20))}</li>", 1)
                put("</ul>")
            elif r < 0.88:
                put(f"<blockquote>{_words(rng, n)}</blockquote>", 1)
            elif r < 0.91:
                put(f"<table><tr><td>{_words(rng, 3, '')}</td>", 1)
                put(f"<td>{_words(rng, 3, '')}</td></tr></table>", 1)
            elif r < 0.94:
                put(f"<p>{_words(rng, n, '')} {link(2)} {_words(rng, 4)}</p>", 1)
            elif r < 0.97:
                put(f"<div>{_words(rng, n)}</div>", 1)
            else:
                other(pick(["ad", "notice", "aside", "form"]))

    for kind in ("header", "menu", "notice", "ad", "form"):
        if rng.random() < (0.6 if kind in ("menu", "ad") else 0.3):
            menu() if kind == "menu" else other(kind)
    top = pick(["<article>", "<main>", '<article class="post">', "<main><article>", '<div class="content">', '<div id="article">', '<section class="entry">']) if telling else pick(["<div>", "<section>", '<div class="x1">'])
    put(top)
    body()
    put("</article></main></div></section>")
    for kind in ("aside", "comments", "ad", "notice", "menu", "footer"):
        if rng.random() < (0.75 if kind == "footer" else 0.3):
            menu() if kind == "menu" else other(kind)
    return page


def training_set(pages: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and labels of the blocks of ``pages`` labelled pages."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        marks, built = labelled_page(rng), []
        # a letter that no text holds carries the label through the parser
        for markup, label in marks:
            built.append(markup if label < 0 else re.sub(r">(?=[^<])", f">{_SIGN[label]}", markup))
        found = blocks("<html><body>" + "".join(built) + "</body></html>")
        y = [int(_SIGN[1] in t) for _, _, t, _ in found]
        clean = [(a, b, t.replace(_SIGN[0], "").replace(_SIGN[1], "") or "x", c) for a, b, t, c in found]
        if clean:
            xs.append(np.array(features(clean)))
            ys.append(np.array(y))
    return xs, ys




def fit(pages: int = PAGES, seed: int = 7) -> crf.Chain:
    xs, ys = training_set(pages, seed)
    return crf.fit(xs, ys)


def main_text(page: str | None, chain: crf.Chain) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    states = crf.viterbi(chain, chain.emissions(np.array(features(found))))
    return " ".join(b[2] for b, s in zip(found, states) if s == 1)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", markup: str = "html", chain: crf.Chain | None = None) -> DataFrame:
    """One row per row: page_id, url, text (main text, empty if none), n_chars, n_blocks.

    Null pages are empty. Character references are decoded, white space within a block is one blank, blocks are joined
    by one blank in page order; elements that are never shown (head, script, style and the like) hold no blocks.
    Markup that ends inside a tag or comment ends there.
    """
    chain = chain or fit()
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{markup}`").cast("string").alias("html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(p or "") for p in column(b, "html")]
            flat = [f for x in found for f in features(x)]
            e = chain.emissions(np.array(flat)) if flat else np.zeros((0, 2))
            texts, at = [], 0
            for x in found:
                states = crf.viterbi(chain, e[at : at + len(x)])
                at += len(x)
                texts.append(" ".join(block[2] for block, s in zip(x, states) if s == 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    return base.mapInArrow(scan, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long")
