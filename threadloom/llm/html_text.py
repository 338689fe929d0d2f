"""Operator 6, main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut at block-level tags into leaf blocks of text. Each block has features of its ancestors'
tags, of the words in their class and id attributes, and of its text. A chain model with two labels
(content or not) is trained by gradient steps on the exact likelihood over labelled pages, and decoded
by Viterbi. The labelled pages come from a seeded generator of page layouts in this module, since the
tables hold no labels; it writes other layouts, tags and texts than it could learn by heart.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Container, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import batches

# Fixed values of HTML: tags without an end, tags whose content is raw text up to their end tag, tags whose
# text is never the page's, tags inside a line, tags that end a paragraph, ends that a new tag implies.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
UNSEEN = frozenset("head script style textarea select".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i iframe ins kbd label mark math noscript object picture q rp rt ruby s samp small span strike strong sub sup svg time tt u var video wbr img input button".split())
FORMULA = frozenset("math svg".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_IMPLIED = {t: frozenset(["p"]) for t in CLOSES_P} | {t: frozenset([t, "p"]) for t in ("li", "option")} | {t: frozenset(["dd", "dt", "p"]) for t in ("dd", "dt")} | {t: frozenset(["td", "th", "p"]) for t in ("td", "th")} | {"tr": frozenset(["tr", "td", "th", "p"])}

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_END_OR_QUOTE = re.compile(r"[>\"']")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_LONG_REFERENCE = re.compile(r"&#(?:0*[1-9][0-9]{9,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{9,});?")
_ZEROS = re.compile(r"(?<=&#)0{20,}|(?<=&#[xX])0{20,}")


class Block(NamedTuple):
    text: str
    features: tuple[str, ...]


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of tags, comments and declarations in page order, read forward once.

    ``name`` is lower case, with a slash in front for an end tag, and empty for comments and the like. A
    quote that is never closed is an ordinary character; where no tag end is left outside of quotes, quotes
    count no more from there on; where none is left at all, the rest is text. Open comments and raw text
    reach to the end of the page. So no character is looked at more than a fixed number of times.
    """
    last = {q: page.rfind(q) for q in "\"'"}
    ends, quotes, at = page.rfind(">"), True, 0
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            yield start, end, "", ""
            at = end
            continue
        if start > ends:
            return
        if page[start + 1 : start + 2] in ("!", "?"):
            at = page.index(">", start) + 1
            yield start, at, "", ""
            continue
        name = _NAME.match(page, start + 1)
        if not name:
            at = start + 1
            continue
        end = _tag_end(page, name.end(), last) if quotes else -1
        if end < 0:
            quotes, end = False, page.index(">", name.end())
        tag = name[0].lower()
        yield start, end + 1, tag, page[name.end() : end]
        at = end + 1
        if tag in RAW and page[end - 1] != "/":
            close = _RAW_END[tag].search(page, at)
            at = close.start() if close else len(page)


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the > that ends a tag, outside of quotes; -1 if there is none."""
    while m := _END_OR_QUOTE.search(page, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        if last[m[0]] >= at:
            at = page.index(m[0], at) + 1
    return -1


class _Stack:
    """Open elements. What blocks need of their ancestors is kept as counts, and where the last element of
    each tag and the last block-level one stand, so that neither depth nor broken nesting costs a walk."""

    def __init__(self, known: Container[str] | None) -> None:
        self.known = known
        self.open: list[tuple[str, tuple[str, ...], bool]] = []
        self.places: dict[str, list[int]] = {}
        self.block: list[int] = []  # places of block-level elements
        self.active: dict[str, int] = {}
        self.anchors = self.unseen = self.formula = 0

    def push(self, tag: str, attributes: str, line: bool) -> None:
        found = ["in:" + tag] if tag not in ("html", "body") else []
        if attributes:
            found += ["name:" + w for n in _NAMES.findall(attributes) for w in _WORD.findall(" ".join(n).lower())]
        found = tuple(f for f in dict.fromkeys(found) if self.known is None or f in self.known)
        for f in found:
            self.active[f] = self.active.get(f, 0) + 1
        self.places.setdefault(tag, []).append(len(self.open))
        if not line:
            self.block.append(len(self.open))
        hidden = tag in UNSEEN or (tag == "title" and not self.formula)  # a drawing's title is text
        self.open.append((tag, found, hidden))
        self.anchors += tag == "a"
        self.unseen += hidden
        self.formula += tag in FORMULA

    def close(self, upto: int) -> None:
        while len(self.open) > upto:
            tag, found, hidden = self.open.pop()
            self.places[tag].pop()
            if self.block and self.block[-1] == len(self.open):
                self.block.pop()
            for f in found:
                if self.active[f] == 1:
                    del self.active[f]
                else:
                    self.active[f] -= 1
            self.anchors -= tag == "a"
            self.unseen -= hidden
            self.formula -= tag in FORMULA

    def last(self, tag: str) -> int:
        own = self.places.get(tag)
        return own[-1] if own else -1

    def leaf(self) -> str:
        return self.open[self.block[-1]][0] if self.block else "none"


def blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks in page order with their features; of ancestors' features the ``known`` ones only, if
    given. Broken markup is read as far as it goes, in time proportional to the page."""
    page = page or ""
    stack = _Stack(known)
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", unescaped("".join(parts))).strip() if parts else ""
        if text:
            out.append(Block(text, ("any", *stack.active, "leaf:" + stack.leaf(), *_of_text(text, linked))))
        parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text and not stack.unseen:
            parts.append(text)
            linked += len(text) * bool(stack.anchors)

    at = 0
    for start, end, tag, attributes in tags(page):
        put(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append("\n")
            continue
        ending = tag[0] == "/"
        tag = tag.removeprefix("/")
        line = tag in INLINE or bool(stack.formula)
        if not line:
            flush()
        if ending:
            place = stack.last(tag)
            if place >= 0 and not (line and stack.block and stack.block[-1] > place):
                stack.close(place)
            continue
        if tag in VOID:
            continue
        if tag == "body" and stack.last("head") >= 0:  # ends a head that was left open
            stack.close(stack.last("head"))
        for_end = _IMPLIED.get(tag, ())
        while not line and stack.block and stack.open[stack.block[-1]][0] in for_end:
            stack.close(stack.block[-1])
        if not attributes.endswith("/"):
            stack.push(tag, attributes, line)
    put(page[at:])
    flush()
    return out


def unescaped(text: str) -> str:
    """Text with its character references decoded; numbers of any length are read."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_REFERENCE.sub("\ufffd", _ZEROS.sub("0", text))
    return entities.unescape(text)


_SAYS = re.compile(r"cookie|©|copyright|all rights reserved|subscribe|newsletter|sign up|log in|advert|sponsor|privacy|terms|related|read more|share|reply|comment|menu|skip to", re.I)


def _of_text(text: str, linked: int) -> Iterator[str]:
    n = len(text)
    yield f"length:{min(9, n.bit_length())}"
    share = linked / n
    yield "links:" + ("none" if share == 0 else "few" if share < 0.4 else "many" if share < 0.9 else "all")
    yield "stops:" + str(min(3, text.count(". ") + text.endswith((".", "!", "?", "…"))))
    yield "end:" + ("stop" if text[-1] in ".!?…:\"”" else "word" if text[-1].isalnum() else "mark")
    if n < 200:
        for w in set(x.lower() for x in _SAYS.findall(text)):
            yield "says:" + w


class Chain(NamedTuple):
    index: dict[str, int]
    weights: np.ndarray  # feature by label
    moves: np.ndarray  # label before by label
    first: np.ndarray


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, strength: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by Adam, with forward and backward passes over all pages at once."""
    names = sorted({f for own, _ in pages for b in own for f in b.features})
    index = {f: k for k, f in enumerate(names)}
    most = max(len(own) for own, _ in pages)
    x = np.zeros((len(pages), most, len(names)), np.float32)
    y, real = np.zeros((len(pages), most), int), np.zeros((len(pages), most), bool)
    for k, (own, labels) in enumerate(pages):
        for t, b in enumerate(own):
            x[k, t, [index[f] for f in b.features]] = 1
        y[k, : len(own)], real[k, : len(own)] = labels, True
    flat = x.reshape(-1, len(names))
    theta = np.zeros(2 * len(names) + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(len(pages))
    for step in range(1, rounds + 1):
        w, moves, first = theta[: 2 * len(names)].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        e = (flat @ w.astype(np.float32)).reshape(len(pages), most, 2).astype(float)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, most):
            now = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], now, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            now = np.logaddexp.reduce(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], now, 0.0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        gap = p.copy()
        gap[rows[:, None], np.arange(most), y] -= real
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        dm = pair.sum((0, 1))
        np.add.at(dm, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), -1)
        grad = np.concatenate([(flat.T @ gap.reshape(-1, 2).astype(np.float32)).ravel(), dm.ravel(), gap[:, 0].sum(0)]) / len(pages) + strength * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        theta = theta - 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Chain(index, theta[: 2 * len(names)].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:])


def decode(own: list[Block], chain: Chain) -> list[int]:
    """The likeliest labels by Viterbi."""
    if not own:
        return []
    (a, b), (c, d) = chain.moves.tolist()
    score, back = None, []
    gain = {f: chain.weights[k].tolist() for f, k in chain.index.items()} if not isinstance(chain, Decoder) else chain.gain
    for block in own:
        e0 = e1 = 0.0
        for f in block.features:
            if f in gain:
                g = gain[f]
                e0 += g[0]
                e1 += g[1]
        if score is None:
            score = (chain.first[0] + e0, chain.first[1] + e1)
            continue
        s0, s1 = score
        back.append((0 if s0 + a >= s1 + c else 1, 0 if s0 + b >= s1 + d else 1))
        score = (max(s0 + a, s1 + c) + e0, max(s0 + b, s1 + d) + e1)
    now = 0 if score[0] >= score[1] else 1
    out = [now]
    for step in reversed(back):
        now = step[now]
        out.append(now)
    return out[::-1]


class Decoder:
    """A chain with its weights at hand for many pages."""

    def __init__(self, chain: Chain) -> None:
        self.moves, self.first, self.index, self.weights = chain.moves, chain.first.tolist(), chain.index, chain.weights
        self.gain = {f: chain.weights[k].tolist() for f, k in chain.index.items()}


def main_text(page: str | None, chain: Chain | Decoder) -> str:
    own = blocks(page, chain.index)
    return "\n".join(b.text for b, y in zip(own, decode(own, chain), strict=True) if y)


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages with the texts of their content blocks, in several layouts."""
    rng = random.Random(seed)
    letters = "aeiouaeiounrstlmdkbpg"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))

    def phrase(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize()

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(phrase(2, 16) + rng.choice([".", ".", ".", "?", "!", ","]) for _ in range(rng.randint(low, high)))

    def links(n: int) -> str:
        if rng.random() < 0.5:
            return "<ul>" + "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(n)) + "</ul>"
        return " ".join(f'<a href="/{word()}">{phrase(1, 2)}</a>' for _ in range(n))

    def wrap(tag: str, names: list[str], inner: str) -> str:
        name = rng.choice(names)
        attribute = rng.choice(["class", "class", "id"])
        return f'<{tag} {attribute}="{name}">{inner}</{tag}>'

    def noise(kind: str) -> str:
        div = rng.choice(["div", "div", "section", "aside"])
        if kind == "nav":
            return f"<nav>{links(rng.randint(3, 8))}</nav>" if rng.random() < 0.6 else wrap("div", ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "topnav", "breadcrumb navigation"], links(rng.randint(3, 8)))
        if kind == "header":
            return f"<header><div>{phrase(1, 4)}</div><p>{phrase(3, 8)}</p></header>" if rng.random() < 0.5 else wrap("div", ["header", "site-header", "masthead", "banner top", "logo"], f"<p>{phrase(1, 6)}</p>")
        if kind == "ad":
            inner = rng.choice([prose(1, 2), f"<p>{prose(1, 2)}</p>", f'<a href="/x">{phrase(2, 6)}</a>', f"<span>Advertisement</span><p>{prose(1, 2)}</p>"])
            return wrap(div, ["ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "sponsor", "promo", "ad slot", "promotion", "adbox", "google ads"], inner)
        if kind == "side":
            inner = f"<h3>{phrase(1, 3)}</h3>" + rng.choice([links(rng.randint(2, 6)), f"<p>{prose(1, 3)}</p>", f"<ul><li>{phrase(2, 5)}</li><li>{phrase(2, 5)}</li></ul>"])
            return f"<aside>{inner}</aside>" if rng.random() < 0.5 else wrap("div", ["sidebar", "side", "widget", "related", "related-posts", "recommended", "right-rail", "trending", "more stories", "popular"], inner)
        if kind == "notice":
            inner = rng.choice([f"<p>We use cookies. {prose(1, 2)}</p><button>Accept</button>", f"<p>{prose(1, 2)}</p>", prose(1, 2)])
            return wrap("div", ["cookie", "cookie-banner", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "privacy-notice", "warning notice", "notification", "disclaimer"], inner)
        if kind == "form":
            return f'<form action="/{word()}"><label>{phrase(1, 3)}</label><input name="q"><p>{prose(1, 1)}</p><button>{phrase(1, 2)}</button></form>' if rng.random() < 0.7 else wrap("div", ["newsletter", "subscribe", "signup", "login", "search form"], f"<p>{prose(1, 2)}</p><form><label>{phrase(1, 2)}</label></form>")
        if kind == "comments":
            inner = f"<h2>{rng.choice(['Comments', '3 comments', phrase(1, 2)])}</h2>" + "".join(rng.choice(['<div class="comment"><b>{0}</b><p>{1}</p></div>', "<li><p>{0}</p><p>{1}</p></li>", "<article><p>{0}</p><p>{1}</p></article>", "<p>{1}</p>"]).format(phrase(1, 2), prose(1, 4)) for _ in range(rng.randint(1, 4)))
            return wrap(rng.choice(["div", "section", "ol", "ul"]), ["comments", "comment-list", "reader-comments", "discussion", "replies", "responses", "disqus thread", "comments area"], inner)
        if kind == "share":
            return wrap("div", ["share", "social", "share-buttons", "tags", "meta", "byline", "author-box", "post-meta"], rng.choice([links(3), f"<span>{phrase(2, 4)}</span>"]))
        inner = rng.choice(["&copy; {0} &middot; {1}", "<p>&copy; {0}</p><p>{1}</p>", "{1}", "<p>{1}</p>", "<div>{0}</div><p>{1}</p>"]).format(word() + ".example", prose(1, 3))
        return f"<footer>{inner}</footer>" if rng.random() < 0.75 else wrap("div", ["footer", "site-footer", "copyright", "bottom footer", "page-foot"], inner)

    def content() -> tuple[str, list[str]]:
        out, texts = [], []

        def put(tag: str, text: str, mark: bool = True) -> None:
            shown = text
            if mark and rng.random() < 0.15:
                words = text.split(" ")
                k = rng.randrange(len(words))
                words[k] = rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/r">{}</a>', "<span>{}</span>"]).format(words[k])
                shown = " ".join(words)
            close = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
            out.append(f"<{tag}>{shown}{close}")
            texts.append(text)

        if rng.random() < 0.85:
            put(rng.choice(["h1", "h1", "h2"]), phrase(2, 10) if rng.random() < 0.6 else prose(1, 3))
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.72:
                put("p", prose(1, 1) if rng.random() < 0.35 else prose(1, 9))
            elif kind < 0.8:
                put(rng.choice(["h2", "h3"]), phrase(1, 6))
            elif kind < 0.87:
                out.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    put("li", phrase(2, 10))
                out.append("</ul>")
            elif kind < 0.9:
                out.append("<blockquote>")
                put("p", prose(1, 3))
                out.append("</blockquote>")
            elif kind < 0.93:
                out.append("<table>")
                for _ in range(2):
                    out.append("<tr>")
                    put("td", phrase(1, 3))
                    put("td", phrase(1, 3))
                    out.append("</tr>")
                out.append("</table>")
            elif kind < 0.95:
                put("pre", phrase(3, 9))
            elif kind < 0.97:
                out.append("<figure>")
                put("figcaption", phrase(3, 8))
                out.append("</figure>")
            else:
                out.append(noise(rng.choice(["ad", "ad", "share", "form", "notice", "side"])))
        return "".join(out), texts

    pages = []
    for _ in range(count):
        inner, texts = content()
        kind = rng.random()
        if kind < 0.4:
            body = f"<article>{inner}</article>"
        elif kind < 0.55:
            body = f"<main>{inner}</main>"
        elif kind < 0.65:
            body = f"<main><article>{inner}</article></main>"
        else:
            body = wrap(rng.choice(["div", "section"]), ["content", "article", "post", "entry-content", "main", "article-body", "story", "post-content", "text body", "page-content"], inner)
        if rng.random() < 0.1 and texts:
            body = body.replace("<article>", "<article><header>", 1).replace("</h1>", "</h1></header>", 1) if "<article><h1>" in body else body
        top = [k for k in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < (0.7 if k in ("nav",) else 0.35)]
        below = [k for k in ("share", "ad", "side", "comments", "form", "nav", "notice") if rng.random() < 0.3]
        if rng.random() < 0.85:
            below.append("footer")
        head = f"<head><title>{phrase(2, 6)}</title><style>p{{margin:0}}</style></head>"
        pages.append((f"<!DOCTYPE html><html>{head}<body>{''.join(map(noise, top))}{body}{''.join(map(noise, below))}" + rng.choice(["</body></html>", ""]), texts))
    return pages


def labels_of(own: list[Block], texts: list[str]) -> list[int]:
    """Marks the blocks that are the content texts in their order."""
    out, k = [], 0
    for b in own:
        hit = k < len(texts) and b.text == _SPACE.sub(" ", texts[k]).strip()
        out.append(int(hit))
        k += hit
    return out


def trained(count: int = 400, seed: int = 11) -> Chain:
    pages = []
    for page, texts in labelled_pages(count, seed):
        own = blocks(page)
        if own:
            pages.append((own, labels_of(own, texts)))
    return train(pages)


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """(page_id, url, text, n_chars) per row, from the whole page.

    Null and empty pages, and pages without content, have an empty text; ``n_chars`` counts code points.
    Very long, very deep and broken pages are read whole, in time proportional to their length (``tags``
    says how); repeated rows give equal rows; an empty table gives none; other columns are ignored.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(chain)
        for b in batches(it, 500):
            texts = [main_text(x.as_py(), decoder) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
