"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks, the runs of text between block-level tags, each with
its open ancestors. Every block gets features of its ancestors (tags, class and id words)
and of its text (length, share of link text, punctuation, place), a block is labelled main
or other jointly with its neighbours by Viterbi, and the main blocks are the text.

The model is trained here on labelled pages made by ``labelled_pages``: a generator of
page layouts, with the article in many kinds of containers and with menus, headers,
sidebars, notices, adverts, forms, comments and footers around and inside it. Number of
pages and seed are parameters, so the model that is sent out has a fixed bound.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TRAINING_PAGES = 600
SEED = 7
EPOCHS = 6

#: Elements that never close, that start or end a block, and whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style title noscript template svg math iframe object canvas textarea select button head".split())
RAW = frozenset("script style title textarea noscript iframe".split())
#: Inline elements that count as ancestors, elements of other vocabularies, and containers of what is not the article.
KNOWN = BLOCK | frozenset("a abbr b big cite code del em font i ins kbd label mark q s samp small span strong sub sup time u var".split())
FOREIGN = ("svg", "math")
OUTSIDE = frozenset(("nav", "footer", "aside", "form"))
#: A start tag (value) that ends an open element (key).
ENDED_BY = {
    "p": BLOCK - {"body", "html", "head", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody"},
    "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"},
}
#: Elements that may stand in a head; the start tag of any other, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A block's container words are those of so many elements above it; its tags and hints are those of all of them.
WORD_ANCESTORS = 6
#: What class, id and role words of containers hint at.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination skip tabs toolbar topbar",
    "ad": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted outbrain taboola adsense dfp commercial",
    "talk": "comment comments commentlist discussion disqus reply replies respond thread reviews review feedback reader readers",
    "side": "sidebar side aside rail widget widgets related recommended more popular trending teaser teasers archive",
    "foot": "footer foot bottom copyright legal colophon imprint impressum",
    "top": "header masthead top logo brand branding hero",
    "notice": "notice notices alert cookie cookies consent gdpr privacy popup modal overlay message warning paywall disclaimer",
    "form": "form search subscribe subscription newsletter login signup register signin contact input",
    "share": "share sharing social follow like tags tag meta byline author date breadcrumb print tools",
    "text": "article content post entry story body text main page single blog news prose copy paragraph richtext",
}
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}
#: Container words that are features of their own.
_WORDS = frozenset(_HINT) | frozenset("site box main js wide wrapper page wrap inner outer row col column container left right center".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_UNCLOSED = re.compile(r"<!--.*\Z|<!\[CDATA\[.*\Z|<[!?][^>]*+\Z", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


@lru_cache(maxsize=20_000)
def _container_words(attributes: str) -> tuple[str, ...]:
    words: list[str] = []
    for found in _NAMED.findall(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(found)).lower()
        words += _WORD.findall(value)
    return tuple(dict.fromkeys(w for w in words if w in _WORDS))


class Element:
    """An open element with what its descendants need to know of their ancestors.

    ``key`` is the same for elements with the same names and container words all the way up.
    """

    __slots__ = ("name", "words", "parent", "key", "tags", "kinds", "own", "outer", "header")

    def __init__(self, name: str, words: tuple[str, ...], parent: Element | None, keys: dict):
        self.name, self.words, self.parent = name, words, parent
        self.key = keys.setdefault((parent.key if parent else -1, name, words), len(keys))
        above, kinds = (parent.tags, parent.kinds) if parent else (frozenset(), frozenset())
        plain = name in ("html", "body")
        self.tags = above if plain or name in above or name not in KNOWN else above | {name}
        new = frozenset() if plain else frozenset(_HINT[w] for w in words if w in _HINT)
        self.kinds = kinds if new <= kinds else kinds | new
        self.own, self.outer = (parent.own, parent.outer) if parent else ("none", "none")
        if name in BLOCK:
            self.own, self.outer = name, self.own
        self.header = parent.header if parent else None
        if name == "header" and self.header is None:
            self.header = "article" in above


@dataclass
class Block:
    text: str
    path: Element | None
    link_share: float
    features: list[str] = field(default_factory=list)


def parse_blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in page order, character references decoded, white space single.

    The work is linear in the page: elements are looked up by counts of the open names, the
    innermost open block is kept, and ancestors are summed up once in each element. Only void elements, and svg or math and what
    is in them, close by a slash. End tags of paragraphs, list items, table parts, options
    and the head, and the tags of head and body altogether, may be left out. A reference is
    decoded within its run of text and never goes on across a tag or comment.
    """
    blocks: list[Block] = []
    stack: list[Element] = []
    inner: list[int] = []  # where the open blocks are in the stack
    keys: dict = {}
    opened: Counter[str] = Counter()
    parts: list[str] = []
    path: Element | None = None
    linked, silent, said, at = 0, 0, False, 0
    last = html.rfind(">") + 1  # no tag ends beyond it

    def flush() -> None:
        nonlocal linked, said
        if said:
            text = _SPACES.sub(" ", "".join(parts)).strip()
            if text:
                blocks.append(Block(text, path, min(1.0, linked / len(text))))
        parts.clear()
        linked, said = 0, False

    def say(text: str) -> None:
        nonlocal path, linked, said
        if silent and stack[-1].name == "head" and not text.isspace():
            pop(len(stack) - 1)
        if silent or not text:
            return
        parts.append(entities.unescape(text))
        if not said:
            path = stack[-1] if stack else None
            said = not parts[-1].isspace()
        if opened["a"]:
            linked += len(text)

    def pop(index: int) -> None:
        nonlocal silent
        for e in stack[index:]:
            silent -= e.name in SILENT
            opened[e.name] -= 1
        del stack[index:]
        while inner and inner[-1] >= index:
            inner.pop()

    while True:
        m = _TOKEN.search(html, at, last) if at < last else None
        m = m or _UNCLOSED.search(html, at)
        say(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        if m.re is _UNCLOSED:
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name == "br":
            say(" ")
            continue
        closing, attributes = (m[1] or m[4]), (m[3] or m[6] or "")
        if name in BLOCK:
            flush()
        if closing:
            if opened[name]:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                pop(i)
            continue
        if stack and stack[-1].name == "head" and name not in IN_HEAD:
            pop(len(stack) - 1)
        while inner and name in ENDED_BY.get(stack[inner[-1]].name, ()):
            pop(inner[-1])  # and the inline elements open in it
        if name in VOID or (attributes.endswith("/") and (name in FOREIGN or any(opened[f] for f in FOREIGN))):
            continue
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in BLOCK:
            inner.append(len(stack))
        stack.append(Element(name, _container_words(attributes) if attributes else (), stack[-1] if stack else None, keys))
        opened[name] += 1
        silent += name in SILENT
    flush()
    return blocks


def add_features(blocks: list[Block]) -> list[Block]:
    for i, b in enumerate(blocks):
        e = b.path
        tags, kinds, own, outer = (e.tags, e.kinds, e.own, e.outer) if e else (frozenset(), frozenset(), "none", "none")
        f = [f"own={own}", "bias", f"pair={outer}>{own}", *(f"in={n}" for n in tags)]
        words, up = set(), e
        for _ in range(WORD_ANCESTORS):
            if up is None:
                break
            if up.name not in ("html", "body"):
                words.update(up.words)
            up = up.parent
        f += [f"word={w}" for w in words]
        f += [f"hint={k}" for k in kinds] or ["hint=none"]
        f.append(f"inside={'article' in tags or 'main' in tags}")
        f.append(f"outside={bool(OUTSIDE & tags)}")
        if e and e.header is not None:
            f.append(f"header-in-article={e.header}")
        n = len(b.text)
        size = min(n.bit_length(), 11)
        link = round(b.link_share * 4)
        f += [f"size={size}", f"link={link}", f"size-link={size // 2}-{link}"]
        f.append(f"stop={b.text[-1] in '.!?…。！？»”' + chr(34)}")
        f.append(f"commas={min(b.text.count(',') * 40 // (n + 40), 3)}")
        f.append(f"legal={any(c in b.text for c in '©®') or 'opyright' in b.text}")
        f.append(f"digits={sum(map(str.isdigit, b.text)) * 5 // n}")
        f.append(f"place={min(4, 5 * i // len(blocks))}")
        if i and (blocks[i - 1].path.key if blocks[i - 1].path else -1) == (e.key if e else -1):
            f.append("same-path")
        b.features = f
    return blocks


@dataclass
class Crf:
    """Two labels (0 other, 1 main): weights of features for main, of label pairs and of the first label."""

    weights: dict[str, float]
    pairs: np.ndarray
    first: np.ndarray

    def label(self, blocks: list[Block]) -> list[int]:
        """The most likely labels together (Viterbi)."""
        if not blocks:
            return []
        get, back = self.weights.get, []
        scores = [sum(get(x, 0.0) for x in b.features) for b in blocks]
        (oo, om), (mo, mm) = self.pairs.tolist()
        other, main = float(self.first[0]), float(self.first[1]) + scores[0]
        for s in scores[1:]:
            to_other, to_main = mo + main > oo + other, mm + main > om + other
            back.append((to_other, to_main))
            other, main = (mo + main if to_other else oo + other), (mm + main if to_main else om + other) + s
        labels = [int(main > other)]
        for to_other, to_main in reversed(back):
            labels.append(int(to_main if labels[-1] else to_other))
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = 0.25, decay: float = 1e-4, seed: int = SEED) -> Crf:
    """Maximum likelihood by adaptive stochastic gradients; forward-backward in log space."""
    names: dict[str, int] = {}
    data = [([np.array([names.setdefault(f, len(names)) for f in b.features]) for b in blocks], np.array(labels)) for blocks, labels in pages if blocks]
    w, gw = np.zeros(len(names)), np.full(len(names), 1e-2)
    t, gt = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    s, gs = np.zeros(2), np.full(2, 1e-2)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for rows, y in data:
            n = len(rows)
            emit = np.zeros((n, 2))
            emit[:, 1] = [w[r].sum() for r in rows]
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = s + emit[0]
            for i in range(1, n):
                alpha[i] = emit[i] + np.logaddexp(alpha[i - 1, 0] + t[0], alpha[i - 1, 1] + t[1])
            for i in range(n - 2, -1, -1):
                ahead = emit[i + 1] + beta[i + 1]
                beta[i] = np.logaddexp(t[:, 0] + ahead[0], t[:, 1] + ahead[1])
            total = np.logaddexp(*alpha[-1])
            marginal = np.exp(alpha + beta - total)
            grad_w = np.zeros(len(names))
            for r, g in zip(rows, y - marginal[:, 1]):
                grad_w[r] += g
            grad_t = np.zeros((2, 2))
            if n > 1:
                both = np.exp(alpha[:-1, :, None] + t + (emit[1:] + beta[1:])[:, None, :] - total)
                grad_t -= both.sum(axis=0)
                np.add.at(grad_t, (y[:-1], y[1:]), 1)
            grad_s = -marginal[0]
            grad_s[y[0]] += 1
            for v, g, acc in ((w, grad_w - decay * w, gw), (t, grad_t, gt), (s, grad_s, gs)):
                acc += g * g
                v += rate * g / np.sqrt(acc)
    return Crf({f: float(w[i]) for f, i in names.items() if w[i]}, t, s)


class PageMaker:
    """Random page layouts. Main leaf texts start with ``MARK``; everything else is boilerplate."""

    MARK = "\x01"

    def __init__(self, rng: random.Random):
        self.r = rng

    def word(self) -> str:
        return "".join(self.r.choice(("an", "er", "th", "st", "ou", "le", "ri", "mé", "ka", "so", "ün", "de", "va", "pi")) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(1, 14)
        if self.r.random() < 0.4:
            text += ", " + self.words(1, 8)
        return text.capitalize() + self.r.choice("...!?")

    def prose(self, low: int = 1, high: int = 6) -> str:
        parts = [self.sentence() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.15:
            parts[self.r.randrange(len(parts))] += f' <a href="/{self.word()}">{self.words(1, 3)}</a>'
        if self.r.random() < 0.15:
            parts[-1] = self.r.choice(("<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "<i>{}")).format(parts[-1])
        return self.r.choice((" ", " ", " ", "<br>")).join(parts)

    def name(self, *kinds: str) -> str:
        word = self.r.choice([w for k in kinds for w in HINTS[k].split()])
        shape = self.r.choice(("{}", "{}", "{}", "site-{}", "{}-box", "main {}", "{}_1", "js-{} wide"))
        return self.r.choice((' class="{}"', ' class="{}"', ' id="{}"', " class={}")).replace("{}", shape.format(word)).replace("class=main ", "class=").replace("class=js-", "class=")

    def links(self, low: int = 2, high: int = 8) -> str:
        each = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        return self.r.choice(("<ul><li>" + "</li><li>".join(each) + "</li></ul>", "<ul><li>" + "<li>".join(each) + "</ul>", " | ".join(each), "<p>" + "</p><p>".join(each) + "</p>", "<div>" + "</div><div>".join(each) + "</div>"))

    def menu(self) -> str:
        return self.r.choice((f"<nav>{self.links()}</nav>", f"<nav{self.name('menu')}>{self.links()}</nav>", f"<div{self.name('menu')}>{self.links()}</div>"))

    def header(self) -> str:
        inner = self.r.choice((f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 7)}</p>", f'<a href="/">{self.words(1, 2)}</a>', "")) + self.r.choice(("", self.menu()))
        return self.r.choice((f"<header>{inner}</header>", f"<header{self.name('top')}>{inner}</header>", f"<div{self.name('top')}>{inner}</div>"))

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "div", "aside", "section", "p"))
        return f"<{tag}{self.name('ad')}>{self.r.choice((self.prose(1, 2), self.words(2, 9), self.links(1, 2)))}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(("div", "div", "section", "p", "aside"))
        inner = self.prose(1, 3).replace("<p>", "")
        return f"<{tag}{self.name('notice')}>{inner}</{tag}>"

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name=q><p>{self.words(2, 9)}</p>" + self.r.choice(("<button>Go</button>", "<select><option>a<option>b</select>", ""))
        return self.r.choice((f"<form>{inner}</form>", f"<div{self.name('form')}><form action='/x'>{inner}</form></div>"))

    def aside(self) -> str:
        inner = self.r.choice(("", f"<h3>{self.words(1, 3)}</h3>")) + self.r.choice((self.links(), f"<p>{self.prose(1, 2)}</p>"))
        return self.r.choice((f"<aside>{inner}</aside>", f"<aside{self.name('side')}>{inner}</aside>", f"<div{self.name('side')}>{inner}</div>", f"<section{self.name('side')}>{inner}</section>"))

    def comments(self) -> str:
        each = [self.r.choice(("<p>{}</p>", "<div>{}</div>", "<p><b>" + self.word() + "</b></p><p>{}</p>")).format(self.prose(1, 4)) for _ in range(self.r.randint(1, 5))]
        inner = self.r.choice(("", f"<h3>{self.words(1, 3)}</h3>")) + self.r.choice(("".join(each), "<ul><li>" + "</li><li>".join(each) + "</li></ul>", "<article>" + "</article><article>".join(each) + "</article>" if self.r.random() < 0.3 else "".join(each)))
        tag = self.r.choice(("div", "section", "ol", "aside"))
        return f"<{tag}{self.name('talk')}>{inner}</{tag}>"

    def share(self) -> str:
        return f"<div{self.name('share')}>{self.r.choice((self.words(1, 5), self.links(2, 4)))}</div>"

    def footer(self) -> str:
        inner = self.r.choice((f"&copy; {self.word()}.example &middot; {self.prose(1, 2)}", f"<p>{self.words(2, 9)}</p>", self.links(), f"<p>© {self.words(2, 6)}</p>{self.links(1, 4)}", self.prose(1, 2)))
        return self.r.choice((f"<footer>{inner}</footer>", f"<footer{self.name('foot')}>{inner}</footer>", f"<div{self.name('foot')}>{inner}</div>"))

    def main_parts(self) -> list[str]:
        m, parts = self.MARK, []
        for _ in range(self.r.randint(1, 12)):
            kind = self.r.random()
            if kind < 0.72:
                text = m + self.prose(1, self.r.choice((1, 2, 6, 14)))
                parts.append(self.r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>")).format(text))
            elif kind < 0.8:
                parts.append(self.r.choice(("<h2>{}</h2>", "<h3>{}</h3>")).format(m + self.words(1, 8)))
            elif kind < 0.88:
                tag = self.r.choice(("ul", "ol"))
                parts.append(f"<{tag}>" + "".join(f"<li>{m}{self.r.choice((self.words(1, 5), self.prose(1, 2)))}</li>" for _ in range(self.r.randint(1, 5))) + f"</{tag}>")
            elif kind < 0.93:
                parts.append(f"<blockquote>{m}{self.prose(1, 3)}</blockquote>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td>{m}{self.words(1, 3)}</td><td>{m}{self.words(1, 3)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            else:
                parts.append(f"<pre>{m}{self.words(3, 20)}</pre>")
        return parts

    def page(self) -> str:
        r, m = self.r, self.MARK
        parts = self.main_parts()
        for maker in (self.advert, self.notice, self.share, self.form, self.aside):
            if r.random() < 0.12:
                parts.insert(r.randint(0, len(parts)), maker())
        if r.random() < 0.2:
            parts.append(self.comments())
        title = f"<h1>{m}{self.words(2, 12)}</h1>"
        if r.random() < 0.2:
            title = f"<header>{title}</header>"
        if r.random() < 0.85:
            parts.insert(0, title)
        inner = "".join(parts)
        text = self.name("text")
        main = r.choice((
            f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article{text}>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
            f"<div{text}>{inner}</div>", f"<div{text}>{inner}</div>", f"<div{text}><div>{inner}</div></div>", f"<section{text}>{inner}</section>", f"<table><tr><td{text}>{inner}</td></tr></table>",
            f"<div>{inner}</div>",
        ))
        before = [maker() for maker, p in ((self.header, 0.5), (self.menu, 0.75), (self.notice, 0.25), (self.advert, 0.45), (self.form, 0.15), (self.aside, 0.15)) if r.random() < p]
        after = [maker() for maker, p in ((self.share, 0.25), (self.comments, 0.35), (self.aside, 0.35), (self.advert, 0.3), (self.form, 0.2), (self.notice, 0.15), (self.menu, 0.15)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        if r.random() < 0.3:
            r.shuffle(after)
        if r.random() < 0.85:
            after.append(self.footer())
        body = "".join((*before, main, *after))
        if r.random() < 0.25:
            body = f'<div{r.choice(("", self.name("text"), " class=wrapper", " id=page"))}>{body}</div>'
        head = f"<head><meta charset=utf-8><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + r.choice(("</body></html>", "</body></html>", ""))


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    maker, out = PageMaker(random.Random(seed)), []
    for _ in range(n):
        blocks = parse_blocks(maker.page())
        labels = [int(maker.MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(maker.MARK, "").strip() or "-"
        out.append((add_features(blocks), labels))
    return out


@lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Crf:
    return train(labelled_pages(pages, seed))


def main_text(html: str | None, crf: Crf) -> str:
    blocks = add_features(parse_blocks(html or ""))
    return "\n".join(b.text for b, label in zip(blocks, crf.label(blocks)) if label)


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row; a null or empty html gives an empty text.

    Repeated rows, and rows with one page_id, are pages of their own; a null page_id or url
    stays null. A page of any length is read whole, in time linear in it and within one
    task. Where both labellings score the same, a block is no main text. Other columns are not
    read, whatever their names.
    """
    model = pages.sparkSession.sparkContext.broadcast(crf or trained())  # weights of the training pages' features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), model.value) for h in b.column("html")]
            columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
