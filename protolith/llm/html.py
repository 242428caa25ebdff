"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in order: runs of text that no block-level tag
interrupts, each with its chain of ancestors. Features are the ancestors' tags and
the words of their class, id and role attributes, and shape, length, link and
punctuation features of the text. The field labels every block as content or not; Viterbi
decodes the best sequence.

Training pages come from a seeded page grammar (``training_pages``) that knows which blocks
are content, so no page of the input is used for fitting.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Container, Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
HIDDEN = "script|style|noscript|template|svg|iframe|textarea|select|object|canvas|audio|video|math|title"
CLOSABLE = "svg|math|iframe|object|canvas|audio|video"
IN_HEAD = frozenset("base link meta".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_SAME = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SAME.items()}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    rf"|<(?P<empty>{CLOSABLE})(?=[\s/>])[^>]*/>"
    rf"|<(?P<raw>{HIDDEN})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|$)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<[a-zA-Z/!?][^>]*(?:>|$)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HINT = re.compile(r"[a-z]+")

Block = tuple[tuple[str, ...], str, int, str]  # distinct features of the ancestors, text, characters in links, parent's tag


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks of a page in order; scripts, styles, comments and other hidden elements have none.

    ``known`` limits the features of ancestors to those that a field knows, so that chains stay short
    however deep a page nests distinct elements. Open elements are found by name, never by a walk of the stack.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each name is open
    held: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((stack[-1][1] if stack else (), text, linked, stack[-1][0] if stack else ""))
            held.clear()
        linked = 0

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            held.append(page[a:b])
            if in_link:
                linked += b - a

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop()[0]].pop()

    def deepest(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    for m in _TOKEN.finditer(page):
        text(at, m.start())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] or m["empty"]:
                held.append(" ")
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                in_link = 0
            if tag in INLINE:
                continue
            flush()
            if places.get(tag):
                close(places[tag][-1])
                in_link = 0
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in INLINE:
            in_link = 1 if tag == "a" else in_link
            continue
        flush()
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:  # its end tag is optional
            close(len(stack) - 1)
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        elif tag in _SAME:
            mine, fence = _SAME[tag]
            if (at_mine := deepest(mine)) > deepest(fence):
                close(at_mine)
        if tag in VOID or m["attrs"].endswith("/") and tag in VOID:
            continue
        hints = [f"t:{tag}"]
        if m["attrs"]:
            for found in _ATTR.findall(m["attrs"]):
                hints += [f"c:{h}" for h in _HINT.findall("".join(found).lower())]
        chain = stack[-1][1] if stack else ()
        new = [h for h in dict.fromkeys(hints) if (known is None or h in known) and h not in chain]
        places[tag].append(len(stack))
        stack.append((tag, (*chain, *new) if new else chain))  # deep nesting of the same elements shares one chain
    text(at, len(page))
    flush()
    return out


def _bucket(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


# Words that mark notices, forms, adverts and the like.
CUES = frozenset("cookie cookies copyright subscribe newsletter login share tweet advert advertisement sponsored reply comments comment menu search privacy terms rights reserved accept password".split())


def text_features(block: Block) -> list[str]:
    """Features of the whole text of a block, whatever its length."""
    _, text, linked, tag = block
    words = text.split()
    n, c = len(words), len(text)
    marks = sum(text.count(x) for x in ",.;:!?")
    cues = sum(w.strip(".,:!?()").lower() in CUES for w in words)
    parent = f"t:{tag}"
    out = [
        "bias", f"parent:{parent}", f"words:{_bucket(n, (2, 4, 8, 15, 30, 60))}", f"links:{_bucket(linked / c, (0.01, 0.3, 0.6, 0.9))}",
        f"marks:{_bucket(marks / n, (0.01, 0.05, 0.12))}", f"ends:{text[-1] if text[-1] in '.!?:…' else '-'}", f"digits:{_bucket(sum(map(str.isdigit, text)) / c, (0.05, 0.3))}",
        f"parent-words:{parent}:{_bucket(n, (4, 15))}", f"cues:{_bucket(cues / n, (0.001, 0.04, 0.09, 0.16, 0.3))}", f"sign:{'©' in text}",
    ]
    return out


@dataclass
class Field:
    """Weights of features for the content label, and transition scores between labels 0 and 1."""

    weights: dict[str, float]
    start: np.ndarray
    move: np.ndarray

    def __post_init__(self):
        self.chains: dict[tuple, float] = {}

    def _score(self, block: Block) -> float:
        chain, w = block[0], self.weights
        if (c := self.chains.get(chain)) is None:
            if len(self.chains) > 50_000:
                self.chains.clear()
            c = self.chains[chain] = sum(w.get(f, 0.0) for f in chain)
        return c + sum(w.get(f, 0.0) for f in text_features(block))

    def decode(self, found: list[Block]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not found:
            return []
        (a, b), ((aa, ab), (ba, bb)) = self.start.tolist(), self.move.tolist()
        back = []
        for k, block in enumerate(found):
            s = self._score(block)
            if k == 0:
                x, y = a, b + s
                continue
            fx, fy = (0 if x + aa >= y + ba else 1), (0 if x + ab >= y + bb else 1)
            x, y = (x + aa if fx == 0 else y + ba), (x + ab if fy == 0 else y + bb) + s
            back.append((fx, fy))
        label = [int(y > x)]
        for pair in reversed(back):
            label.append(pair[label[-1]])
        return label[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page or "", self.weights)
        return " ".join(b[1] for b, keep in zip(found, self.decode(found), strict=True) if keep)


def training_pages(count: int = 700, seed: int = 11) -> list[list[tuple[Block, int]]]:
    """Labelled pages from a page grammar. Content is marked by a private-use character that is taken out again."""
    rng = random.Random(seed)
    mark, syllables = "", "ba de ki lo mu ne pra sti tor val en ou ch ier sch und tion ado mente".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 18) -> str:
        s = words(a, b)
        if rng.random() < 0.25:
            s = s.upper() if rng.random() < 0.3 else " ".join(w + rng.choice(("***", "!!", "$$$", "&amp;&amp;")) for w in s.split())
        return s.capitalize() + rng.choice(("...", ".", ".", ".", "!", "?", "", ""))

    prose = lambda: " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 8))))
    pick = rng.choice
    link = lambda a=1, b=3: f'<a href="/{word()}">{words(a, b)}</a>'
    wrap = lambda tag, body, cls="": f"<{tag}{f' class={chr(34)}{cls}{chr(34)}' if cls else ''}>{body}</{tag}>"

    def links() -> str:
        items = [link() for _ in range(rng.randint(2, 8))]
        return pick((wrap("ul", "".join(wrap("li", x) for x in items)), " | ".join(items), "".join(wrap("span", x) for x in items), "".join(wrap("div", x) for x in items)))

    def inside(body: str) -> str:
        if rng.random() < 0.4:
            return body
        return pick((wrap("b", body), f"<p>{body}", body + "<br>", f"<b>{body}", wrap("span", body), body + " " + link(1, 2) + " " + words(1, 5), "See " + link(3, 8) + ", " + body))

    def paragraph(tag: str = "p") -> str:
        return wrap(tag, inside(mark + prose())) if rng.random() < 0.85 or tag != "p" else f"<p>{mark}{prose()}"

    def cells(tag: str) -> str:
        return wrap("tr", "".join(wrap(tag, mark + pick((words(1, 4), str(rng.randint(1, 3000))))) for _ in range(3)))

    def content(tag: str = "p") -> str:
        kind, m = rng.random(), mark
        if kind < 0.64:
            return paragraph(tag)
        if kind < 0.74:
            return wrap(pick(("h2", "h3", "h4")), m + pick((words(1, 3), sentence(1, 6))))
        if kind < 0.81:
            return wrap(pick(("ul", "ol")), "".join(wrap("li", m + pick((words(1, 5), sentence(), prose()))) for _ in range(rng.randint(2, 5))))
        if kind < 0.84:
            return wrap("dl", "".join(wrap("dt", m + words(1, 3)) + wrap("dd", m + prose()) for _ in range(rng.randint(1, 3))))
        if kind < 0.89:
            return wrap("blockquote", wrap("p", m + prose()) if rng.random() < 0.6 else m + prose())
        if kind < 0.92:
            return wrap("pre", m + pick((prose(), f"{word()} = 1; {word()} = 2")))
        if kind < 0.96:
            return wrap("table", (cells("th") if rng.random() < 0.4 else "") + "".join(cells("td") for _ in range(2)))
        return wrap("figure", "<img src=x>" + wrap("figcaption", m + sentence()))

    def noise() -> str:
        kind = pick((0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9))
        if kind == 0:
            return wrap("div", pick((prose(), wrap("p", prose()), link(2, 6))), pick(("ad", "ad", "ads", "advert", "ad-banner", "ad-slot", "sponsored", "promo", "advertisement", "banner")))
        if kind == 1:
            return pick((wrap("aside", pick((links(), wrap("p", prose()), wrap("h3", words(1, 3)) + links()))), wrap("div", wrap("h3", words(1, 3)) + pick((links(), wrap("p", prose()))), pick(("sidebar", "side", "widget", "related", "recommended", "trending")))))
        if kind == 2:
            return wrap("form", wrap("label", words(1, 3)) + '<input name="q">' + wrap("button", words(1, 2)) + wrap("p", sentence()), pick(("", "search", "newsletter", "subscribe", "login")))
        if kind == 3:
            n = rng.randint(1, 5)
            body = "".join(wrap(pick(("div", "li", "article")), wrap("p", prose()) + wrap("span", words(1, 3)), pick(("comment", "comment-body", "reply"))) for _ in range(n))
            said = wrap(pick(("h2", "h3")), pick(("Comments", f"{n} comments", words(1, 2))))
            return pick((f'<section id="comments">{said}{body}</section>', wrap("section", wrap("h3", pick(("Comments", words(1, 2), sentence(2, 5)))) + body, pick(("comments", "discussion", "responses"))), wrap("div", body, pick(("comments", "comment-list", "disqus-comments"))), f'<div id="comments">{body}</div>'))
        if kind == 4:
            return wrap("div", pick((wrap("p", sentence() + " cookies " + words(2, 6)), prose()) + (wrap("button", "Accept"),)), pick(("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal")))
        if kind == 5:
            return wrap("div", "".join(link(1, 1) for _ in range(4)), pick(("share", "social", "social-links", "tags", "breadcrumb", "breadcrumbs", "pagination", "toolbar")))
        if kind == 6:
            return wrap(pick(("div", "section")), wrap("h3", words(1, 3)) + links(), pick(("related", "related-posts", "more", "recommended", "menu", "links")))
        if kind == 7:
            return wrap("nav", links())
        if kind == 8:
            return wrap("div", prose(), pick(("disclaimer", "legal", "subscribe", "newsletter-signup", "paywall", "meta", "byline")))
        return f"<!-- {words(1, 3)} -->"

    def story() -> str:
        """The article's own blocks; some are bare text or lie in plain ``div`` elements."""
        kind, short = rng.random(), rng.random() < 0.3
        size = 1 if short else rng.choice((1, 2, 3, 5, 8, 14))
        title = [wrap(pick(("h1", "h1", "h2")), inside(mark + pick((words(2, 6), sentence(2, 8)))))] if rng.random() < (0.3 if short else 0.75) else []
        if kind < 0.1:
            return "".join(title) + pick(("<br>", "<br><br>")).join(mark + prose() for _ in range(size))
        body = title + [mark + prose()] * (rng.random() < 0.1)
        tag = "div" if kind < 0.22 else "p"
        for _ in range(size):
            body.append(content(tag))
            if rng.random() < 0.15:
                body.append(noise())
        return "".join(body)

    def framed(main: str) -> str:
        kind = rng.random()
        if kind < 0.35:
            return wrap("article", main, pick(("", "", "post", "entry")))
        if kind < 0.5:
            return wrap("main", pick((main, wrap("article", main), wrap("article", main) + noise(), main + noise())))
        if kind < 0.75:
            main = wrap(pick(("div", "section")), main, pick(("content", "post", "entry-content", "article", "article-body", "story", "main-content", "post-body text", "page", "text", "main", "body")))
            return f'<div {pick(("id", "role"))}="{pick(("content", "main", "page", "wrapper"))}">{main}</div>' if rng.random() < 0.3 else main
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            main = wrap(pick(("div", "div", "section")), main, pick(("", word())))
        return main

    pages = []
    for _ in range(count):
        main = framed(story())
        bare = rng.random() < 0.3  # nothing but the article, or little else
        top = [wrap("header", pick((link(), wrap("h1", words(1, 3)), wrap("p", sentence()) + links())))] if not bare and rng.random() < 0.4 else []
        if not bare and rng.random() < 0.4:
            top.append(wrap(pick(("nav", "div", "td")), links(), pick(("", "menu", "navbar", "nav", "navigation", "topbar", "header")) or "menu"))
        elif not bare and rng.random() < 0.8:
            top.append(pick((wrap("nav", links()), f'<div {pick(("id", "role"))}="{pick(("nav", "menu", "navigation", "header"))}">{links()}</div>')))
        top += [noise() for _ in range(rng.choice((0, 0, 1) if bare else (0, 1, 1, 2)))]
        end = [noise() for _ in range(rng.choice((0, 0, 1) if bare else (0, 0, 1, 1, 2)))]
        foot = pick((f"&copy; {words(1, 3)} &middot; {words(1, 4)}", prose(), links(), wrap("p", sentence()), f"{sentence()} &copy; {words(1, 2)}"))
        if rng.random() < (0.3 if bare else 0.9):
            end += [pick((wrap("footer", foot), wrap("div", f"&copy; 2020 {words(1, 3)}", pick(("footer", "copyright", "bottom"))), f'<div {pick(("id", "class"))}="footer">{foot}</div>', f'<div role="contentinfo">{foot}</div>'))]
        if rng.random() < 0.08:  # a layout table
            main = f"<table>{wrap('tr', wrap('td', link()))}{wrap('tr', wrap('td', links()) + wrap('td', main))}</table>"
        body = "".join(top) + main + "".join(end)
        page = body if bare and rng.random() < 0.3 else f"<html><head><title>{words(1, 5)}</title></head><body>{body}</body></html>"
        pages.append([((b[0], b[1].replace(mark, ""), *b[2:]), int(mark in b[1])) for b in blocks(page) if b[1].replace(mark, "")])
    return pages


def fit(pages: list[list[tuple[Block, int]]], steps: int = 250, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Maximum conditional likelihood by Adam, all pages in step through padded forward and backward passes."""
    pages = [p for p in pages if p]
    names: dict[str, int] = {}
    rows, cols, page, place = [], [], [], []
    n, t = len(pages), max(map(len, pages))
    gold = np.full((n, t), -1)
    for i, p in enumerate(pages):
        for k, (block, label) in enumerate(p):
            gold[i, k] = label
            for f in dict.fromkeys([*block[0], *text_features(block)]):
                rows.append(i * t + k)
                cols.append(names.setdefault(f, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    on, y = gold >= 0, np.maximum(gold, 0)
    d = len(names)
    theta, m, v = np.zeros(d + 6), np.zeros(d + 6), np.zeros(d + 6)
    add = lambda a, axis: (top := a.max(axis)) + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis))
    for step in range(1, steps + 1):
        emit = np.zeros((n, t, 2))
        emit[:, :, 1] = np.bincount(rows, theta[cols], n * t).reshape(n, t)
        start, move = theta[d : d + 2], theta[d + 2 :].reshape(2, 2)
        ahead, behind = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        ahead[:, 0] = start + emit[:, 0]
        for k in range(1, t):
            new = add(ahead[:, k - 1, :, None] + move, 1) + emit[:, k]
            ahead[:, k] = np.where(on[:, k, None], new, ahead[:, k - 1])
        for k in range(t - 2, -1, -1):
            new = add(move + (emit[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
            behind[:, k] = np.where(on[:, k + 1, None], new, 0)
        total = add(ahead[:, -1], 1)[:, None]
        p1 = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total)
        grad = np.zeros(d + 6)
        miss = np.where(on, y - p1, 0).ravel()
        grad[:d] = np.bincount(cols, miss[rows], d)
        grad[d : d + 2] = np.stack([1 - y[:, 0] - (1 - p1[:, 0]), y[:, 0] - p1[:, 0]], 1).sum(0)
        both = np.exp(ahead[:, :-1, :, None] + move + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, :, None, None]) * on[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][on[:, 1:]], y[:, 1:][on[:, 1:]]), 1)
        grad[d + 2 :] = (seen - both.sum((0, 1))).ravel()
        grad = grad / n - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Field({f: float(theta[k]) for f, k in names.items()}, theta[d : d + 2], theta[d + 2 :].reshape(2, 2))


@lru_cache(1)
def default_field() -> Field:
    return fit(training_pages())


def extract_text(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    A null or empty page, or one without content, has the empty text. White space inside a block,
    line breaks included, is one blank; blocks are joined by one. Truncated pages are read as far as
    they go, without a last unfinished tag. Repeated rows are read each, null ids passed on, other columns
    not read; an empty table gives an empty result.
    """
    field = field or default_field()

    def run(batches):
        for b in batches:
            texts = [field.extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
