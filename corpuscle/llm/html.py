"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page's text falls into blocks, runs of text between block-level tags. Each
block has features of its ancestors (tag names, classes and ids) and of its
text. The field labels the blocks main or other; it is trained on labelled
pages and decoded by Viterbi. The pages table has no labels, so that the pages
to learn from are made here, in many layouts (:func:`labelled_pages`).
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuscle.llm.shared import column

FEATURES = 1 << 13
#: Labelled pages that are made to learn from.
PAGES = 800

#: A tag from its name on; quoted values may hold anything. It never goes back over what it has read.
_TAG = re.compile(r"""(?>[^>"']+|"[^"]*"|'[^']*')*+>""")
#: Tags of a page whose quotes are left open, each read to the page's end; after that many, quotes don't count any more.
OPEN_QUOTES = 16
#: Elements nested deeper count as siblings of the last level (browsers do so as well).
DEPTH = 256
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_RAW = {k: re.compile(rf"</{k}\b", re.I) for k in ("script", "style")}
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_LONG = re.compile(r"&#0*([0-9]{9})[0-9]*")
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript object ol option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that a block tag of the same kind ends, where none of the walls lies between.
_ENDS = {"p": BLOCK_TAGS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
_WALLS = frozenset("article aside body div footer form header main nav section table ul ol".split())


class Place:
    """A chain of block-level ancestors (each a tag, or a tag and its marks), with the features that its steps have together."""

    __slots__ = ("below", "grams", "own", "parent", "step")

    def __init__(self, parent: Place | None, step: str) -> None:
        self.parent, self.step, self.below = parent, step, {}
        tag, _, marks = step.partition(" ")
        found = set(parent.grams) if parent else set()
        if step and tag not in _PLAIN:
            found |= {_hash(f"in:{tag}")} if marks else {_hash(f"in:{tag}"), _hash(f"bare:{tag}")}
        found |= {_hash(f"mark:{w}") for w in _WORDS.findall(marks)}
        self.grams = parent.grams if parent and len(found) == len(parent.grams) else frozenset(found)
        self.own = _hash(f"own:{tag or 'none'}")

    def features(self) -> tuple[int, ...]:
        return (self.own, *(x for x in self.grams if x != self.own))


class Places:
    """The chains met so far, as a tree; it starts anew when it has grown large."""

    def __init__(self, most: int = 20_000) -> None:
        self.most, self.n, self.root = most, 0, Place(None, "")

    def under(self, parent: Place, step: str) -> Place:
        found = parent.below.get(step)
        if found is None:
            found = Place(parent, step)
            if self.n < self.most:
                parent.below[step] = found
                self.n += 1
        return found

    def fit(self) -> None:
        if self.n >= self.most:
            self.n, self.root = 0, Place(None, "")


@dataclass
class Block:
    text: str
    place: Place
    linked: int = 0  # characters inside links
    label: int | None = None


def unescape(raw: str) -> str:
    """Character references decoded; numbers of any length are none of a character beyond nine digits."""
    return entities.unescape(_LONG.sub(r"&#\1", raw)) if "&" in raw else raw


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(text, '') and ('', tag without its angle brackets) in order, in one pass.

    Comments, declarations, and what scripts and styles hold are left out, up to the page's end where they aren't closed. A
    tag that isn't closed reaches to the page's end as well. Each search that finds nothing is made once.
    """
    at, n, quotes = 0, len(page), 0
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], ""
            return
        c = page[lt + 1 : lt + 2]
        if not (c in "!/?" and c or c.isalpha() and c.isascii()) or c == "/" and not (page[lt + 2 : lt + 3].isalpha() and page[lt + 2 : lt + 3].isascii()):
            yield page[at : lt + 1], ""
            at = lt + 1
            continue
        if lt > at:
            yield page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if end < 0:
                return
            at = end + 3
            continue
        end = -1
        if c not in "!?/" and quotes < OPEN_QUOTES:
            if m := _TAG.match(page, lt + 1):
                end = m.end()
            else:
                quotes += 1
        if end < 0:
            end = page.find(">", lt + 1) + 1
            if not end:
                return
        at = end
        if c not in "!?":
            tag = page[lt + 1 : end - 1]
            yield "", tag
            name = _NAME.match(tag)
            raw = _RAW.get(name[0].lower()) if name and not tag.endswith("/") else None
            if raw:
                m = raw.search(page, at)
                if not m:
                    return
                at = m.start()


def blocks(page: str, places: Places | None = None) -> list[Block]:
    """The leaf blocks of a page, in its order; scripts, styles and comments have none."""
    places = places or Places()
    places.fit()
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []  # open elements, and the place inside them
    where: dict[str, list[int]] = {}  # places on the stack, by kind
    walls: list[int] = []
    edges: list[int] = []  # walls, and what a block tag may end
    over: dict[str, int] = {}  # elements below DEPTH, by kind
    text: list[str] = []
    linked = depth = 0
    place = places.root

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole:
                out.append(Block(whole, place, linked))
            text.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal depth, place
        for kind, _ in stack[i:]:
            where[kind].pop()
            depth -= kind == "a"
        del stack[i:]
        for marks in (walls, edges):
            while marks and marks[-1] >= i:
                marks.pop()
        place = stack[-1][1] if stack else places.root

    for raw, tag in tokens(page):
        if not tag:
            raw = unescape(raw)
            text.append(raw)
            if depth:
                linked += len(raw)
            continue
        if tag[0] == "/":
            kind = _NAME.match(tag, 1)[0].lower()
            if kind in BLOCK_TAGS:
                flush()
            if over.get(kind):
                over[kind] -= 1
                continue
            if (found := where.get(kind)) and (kind in _WALLS or not walls or walls[-1] < found[-1]):
                close(found[-1])
            continue
        kind = _NAME.match(tag)[0].lower()
        if kind == "br":
            text.append(" ")
            continue
        block = kind in BLOCK_TAGS
        if block:
            flush()
            for i in reversed(edges):  # few, as each kind ends its like
                if kind in _ENDS.get(stack[i][0], ()):
                    close(i)
                    break
                if stack[i][0] in _WALLS:
                    break
        if kind in VOID or tag.endswith("/"):
            continue
        if len(stack) >= DEPTH:
            over[kind] = over.get(kind, 0) + 1
            continue
        if block:
            marks = " ".join(filter(None, (x for y in _MARKS.findall(tag) for x in y))) if "=" in tag else ""
            place = places.under(place, f"{kind} {marks.lower()}" if marks else kind)
        if kind in _WALLS:
            walls.append(len(stack))
        if kind in _WALLS or kind in _ENDS:
            edges.append(len(stack))
        where.setdefault(kind, []).append(len(stack))
        stack.append((kind, place))
        depth += kind == "a"
    flush()
    return out


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


_PLAIN = frozenset(("html", "body"))


@lru_cache(maxsize=5_000)
def text_features(size: int, link: int, stops: bool, sign: bool, first: bool) -> tuple[int, ...]:
    return tuple(_hash(x) for x in (f"size:{size}", f"link:{link}", f"stops:{stops}", f"size:{size}:link:{link}", f"sign:{sign}", f"first:{first}"))


def features(b: Block, first: bool) -> tuple[int, ...]:
    t = b.text
    size = min(8, len(t).bit_length())
    stops = t.find(". ") >= 0 or t.endswith((".", "!", "?"))
    sign = "©" in t or "®" in t
    return b.place.features() + text_features(size, min(4, 4 * b.linked // max(1, len(t))), stops, sign, first)


def sequence(found: Sequence[Block]) -> list[tuple[int, ...]]:
    return [features(b, i == 0) for i, b in enumerate(found)]


@dataclass
class Field:
    """Weights: those of the features for label 1 (label 0 has none), of the first label, and of couples of labels."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def viterbi(self, rows: Sequence[tuple[int, ...]]) -> list[int]:
        if not rows:
            return []
        emit = self._emit
        (s00, s01), (s10, s11) = self._step
        a, b = self._start
        b += sum([emit[f] for f in rows[0]])
        back: list[tuple[bool, bool]] = []
        for r in rows[1:]:
            e = sum([emit[f] for f in r])
            a0, b0, a1, b1 = a + s00, b + s10, a + s01, b + s11
            back.append((b0 > a0, b1 > a1))
            a, b = max(a0, b0), max(a1, b1) + e
        y = int(b > a)
        out = [y]
        for k in reversed(back):
            y = int(k[y])
            out.append(y)
        return out[::-1]

    def ready(self) -> Field:
        """Plain lists for the decoding of many pages."""
        self._emit, self._step, self._start = self.emit.tolist(), self.step.tolist(), self.start.tolist()
        return self


def train(pages: Sequence[Sequence[Block]], rounds: int = 250, ridge: float = 0.002) -> Field:
    """A field of greatest penalised likelihood, by adaptive gradient steps over all labelled pages at once."""
    pages = [p for p in pages if p]
    n, longest = len(pages), max(map(len, pages))
    rows = [sequence(p) for p in pages]
    flat = np.array([f for p in rows for r in p for f in r])
    block = np.repeat(np.arange(sum(map(len, pages))), [len(r) for p in rows for r in p])
    page = np.repeat(np.arange(n), [len(p) for p in pages])
    pos = np.concatenate([np.arange(len(p)) for p in pages])
    gold = np.zeros((n, longest), int)
    gold[page, pos] = [b.label for p in pages for b in p]
    real = np.zeros((n, longest), bool)
    real[page, pos] = True
    out = Field()
    memory = [np.zeros(FEATURES), np.zeros(2), np.zeros((2, 2))]
    for _ in range(rounds):
        e = np.zeros((n, longest, 2))
        e[page, pos, 1] = np.bincount(block, out.emit[flat], len(page))
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = out.start + e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(alpha[:, t - 1, :1] + out.step[0], alpha[:, t - 1, 1:] + out.step[1]) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = beta[:, t + 1] + e[:, t + 1]
            new = np.logaddexp(out.step[:, 0] + nxt[:, :1], out.step[:, 1] + nxt[:, 1:])
            beta[:, t] = np.where(real[:, t + 1, None], new, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - total[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + out.step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        g_emit = np.bincount(flat, (gold - p[:, :, 1])[page, pos][block], FEATURES)
        g_start = np.bincount(gold[:, 0], minlength=2) - p[:, 0].sum(axis=0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
        for k, (w, g) in enumerate(((out.emit, g_emit), (out.start, g_start), (out.step, seen - pair.sum(axis=(0, 1))))):
            g = g - ridge * n * 0.05 * w
            memory[k] += g * g
            w += 0.5 * g / np.sqrt(memory[k] + 1e-9)
    return out


def labelled_pages(n: int = PAGES, seed: int = 7) -> list[list[Block]]:
    """Made-up pages with labelled blocks: articles in many layouts, among menus, headers, sidebars, notices, adverts, forms, comments and footers.

    The words are of no language, so that nothing is learned from them; main
    and other text alike come long and short. Some pages are cut off, have tags left open, or
    lack sectioning tags, so that classes, lengths and links must decide.
    """
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "os")]
    choice = lambda *x: x[int(rng.random() * len(x))]

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(lo, hi)))

    def sentence(lo: int = 3, hi: int = 16) -> str:
        return words(lo, hi).capitalize() + choice(".", ".", ".", "!", "?")

    def prose(most: int = 8) -> str:
        return " ".join(sentence() for _ in range(rng.randrange(1, most)))

    M, O = "\x01", "\x02"  # noqa: E741  marks of main and other text

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{O}{words(1, 4)}</a></li>' for i in range(k))

    def attr(*names: str) -> str:
        return f' {choice("class", "class", "id")}="{choice(*names)}"' if names else ""

    def menu() -> str:
        inner = f"<ul>{links(rng.randrange(2, 9))}</ul>"
        return choice(f"<nav>{inner}</nav>", f"<nav{attr('main-nav', 'menu', 'breadcrumb')}>{inner}</nav>", f"<div{attr('menu', 'nav', 'navbar', 'navigation', 'breadcrumbs', 'top-menu')}>{inner}</div>", f"<ul{attr('menu', 'nav', 'navbar')}>{links(4)}</ul>")

    def header() -> str:
        inner = choice(f"<h1>{O}{words(1, 4)}</h1>", f"<p>{O}{words(2, 8)}</p>", f"<div{attr('logo', 'site-title', 'tagline')}>{O}{words(1, 5)}</div>", f"<a href='/'>{O}{words(1, 3)}</a>") + choice("", menu(), f"<p>{O}{sentence()}</p>")
        return choice(f"<header>{inner}</header>", f"<header{attr('site-header', 'top', 'masthead')}>{inner}</header>", f"<div{attr('header', 'site-header', 'masthead', 'banner', 'top-bar', 'topbar')}>{inner}</div>")

    def some(kind: str, names: tuple[str, ...], inner: str) -> str:
        return choice(f"<{kind}>{inner}</{kind}>", f"<{kind}{attr(*names)}>{inner}</{kind}>", f"<div{attr(*names)}>{inner}</div>")

    def sidebar() -> str:
        return some("aside", ("sidebar", "side", "widget", "related", "recommended", "related-posts", "more-stories", "trending", "popular", "teaser", "tags", "newsletter-box", "author-bio"), f"{choice('', f'<h3>{O}{words(1, 4)}</h3>', f'<h2>{O}{words(1, 4)}</h2>')}{choice(f'<ul>{links(4)}</ul>', f'<p>{O}{prose(4)}</p>', f'<div>{O}{prose(3)}</div>', f'<p>{O}{prose(3)}</p><p>{O}{prose(5)}</p>')}")

    def advert() -> str:
        inner = choice(f"{O}{prose(3)}", f"<p>{O}{prose(3)}</p>", f'<a href="/x">{O}{words(2, 7)}</a>', f"{O}{words(1, 4)}")
        names = attr("ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo", "sponsor", "banner-ad", "adsbox", "promotion", "ad ad-top", "google-ad")
        return choice(f"<div{names}>{inner}</div>", f"<div{names}>{inner}</div>", f"<aside{names}>{inner}</aside>", f"<section{names}>{inner}</section>", f"<p{names}>{O}{prose(3)}</p>")

    def notice() -> str:
        return f"<div{attr('cookie', 'cookie-notice', 'cookie-banner', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal', 'overlay', 'paywall', 'subscribe', 'newsletter', 'signup', 'disclaimer')}>{choice('', '<p>')}{O}{prose(4)}{choice('', f'<button>{O}{words(1, 3)}</button>', f'<a href=/p>{O}{words(1, 3)}</a>')}</div>"

    def form() -> str:
        inner = f"<label>{O}{words(1, 4)}</label><input name=q><button>{O}{words(1, 3)}</button>" + choice("", f"<p>{O}{prose(3)}</p>", f"<select><option>{O}{words(1, 2)}<option>{O}{words(1, 2)}</select>", f"<fieldset><legend>{O}{words(1, 3)}</legend>{O}{words(1, 4)}</fieldset>")
        return f"<form{choice('', attr('search', 'login', 'contact-form', 'subscribe', 'newsletter', 'comment-form'))}>{inner}</form>"

    def comments() -> str:
        one = lambda: f"<{(k := choice('div', 'li', 'article', 'p', 'section'))}{attr('comment', 'reply', 'comment-body', 'review', 'user-comment', 'comment comment-item')}>{choice('', f'<b>{O}{words(1, 3)}</b> ', f'<h4>{O}{words(1, 3)}</h4>', f'<span>{O}{words(1, 3)}</span>')}{choice('', '<p>')}{O}{prose(6)}</{k}>"
        head = choice("", f"<h2>{O}{words(1, 3)}</h2>", f"<h3>{O}{words(1, 3)}</h3>")
        return f"<{(k := choice('section', 'div', 'div', 'ol', 'aside'))}{attr('comments', 'comment-list', 'reader-comments', 'discussion', 'responses', 'disqus', 'comments-area', 'replies', 'respond', 'reviews')}>{head}{''.join(one() for _ in range(rng.randrange(1, 5)))}{choice('', form())}</{k}>"

    def footer() -> str:
        inner = choice(f"&copy; {O}{words(2, 6)} &middot; {prose(4)}", f"<p>{O}&copy; {words(2, 7)}</p>", f"<p>{O}{prose(3)}</p><ul>{links(3)}</ul>", f"{O}{prose(5)}")
        return choice(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<footer{attr('site-footer', 'footer')}>{inner}</footer>", f"<div{attr('footer', 'site-footer', 'copyright', 'legal', 'bottom', 'footer-links')}>{inner}</div>")

    def paragraph() -> str:
        text = choice(f"{M}{prose()}", f"{M}{prose()}", f"{M}{prose()}", f"{M}{prose(4)} <a href=/l>{words(1, 5)}</a> {prose(4)}", f"<b>{M}{sentence()}</b> {prose()}", f"<b>{M}{prose()}<br>", f"{M}{sentence(1, 5)}", f"{M}{words(1, 12)}", f"<a href=/l>{M}{sentence(2, 6)}</a>", f"{M}{prose()} &amp; {sentence()}")
        return choice(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>", f"<blockquote>{text}</blockquote>", f"<blockquote><p>{text}</p></blockquote>", f"<h2>{M}{words(1, 7)}</h2><p>{text}</p>", f"<h3>{M}{words(1, 7)}</h3><p>{text}</p>", f"<ul><li>{M}{sentence(1, 9)}</li><li>{M}{words(1, 9)}</li></ul>", f"<ol><li>{M}{sentence(1, 9)}<li>{M}{prose(3)}</ol>", f"<table><tr><td>{M}{words(1, 4)}</td><td>{M}{words(1, 4)}</td></tr></table>", f"<pre>{M}{words(2, 20)}</pre>", f"<figure><img src=x><figcaption>{M}{sentence()}</figcaption></figure>", f"<section><p>{text}</p></section>", f"{text}", f"{text}<ul><li>{M}{words(1, 4)}</li><li>{M}{words(1, 3)}</li></ul>", f"<noscript><p>{text}</p></noscript>", f"<object data=x>{text}</object>", f"<table><tr><th>{M}{words(1, 3)}</th></tr><tr><td>{M}{rng.randrange(1000)}</td><td>{M}{rng.randrange(9)}</td></tr></table>", f"<dl><dt>{M}{words(1, 3)}</dt><dd>{M}{sentence()}</dd></dl>")

    def article() -> str:
        parts = [paragraph() for _ in range(rng.randrange(1, 10))]
        if rng.random() < 0.12:
            return choice(f"<article><p>{M}{sentence(1, 4)}</p></article>", f"<article>{M}{sentence(1, 9)}</article>", f"<main><p>{M}{words(1, 5)}</p></main>", f"<div{attr('content', 'post', 'main')}>{M}{sentence(1, 6)}</div>", f"<article><h1>{M}{words(1, 4)}</h1><p>{M}{sentence(1, 4)}</p></article>", f"<article>{M}{sentence()}<ul><li>{M}{words(1, 2)}</li></ul></article>", f"<article>{M}{prose()}<table><tr><td>{M}{rng.randrange(99)}</td></tr></table></article>")
        for extra in (advert, advert, sidebar, notice, form, menu):
            if rng.random() < 0.16:
                parts.insert(rng.randrange(len(parts) + 1), extra())
        head = choice(f"<h1>{M}{words(2, 9)}</h1>", f"<h1>{M}{words(2, 9)}</h1>", f"<h1>{M}{sentence()}</h1>", f"<header><h1>{M}{words(2, 9)}</h1></header>", f"<h2>{M}{words(2, 9)}</h2>", "")
        inner = head + "".join(parts)
        if rng.random() < 0.15:
            inner += comments()
        names = ("content", "post", "article", "entry", "main", "entry-content", "post-body", "article-body", "story", "main-content", "text", "page-content", "body-text")
        end = lambda k: choice(f"</{k}>", f"</{k}>", f"</{k}>", "") if rng.random() < 0.2 else f"</{k}>"
        return choice(f"<article>{inner}</article>", f"<article>{inner}{end('article')}", f"<article{attr(*names)}>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{attr(*names)}>{inner}</div>", f"<div{attr(*names)}>{inner}</div>", f"<section{attr(*names)}>{inner}</section>", f'<div role="main">{inner}</div>', f"<div><div>{inner}</div></div>")

    def page() -> str:
        before = [menu, header, advert, notice, form, sidebar]
        after = [sidebar, advert, comments, comments, form, notice, menu]
        top = "".join(f() for f in before if rng.random() < 0.35)
        bottom = "".join(f() for f in after if rng.random() < 0.3) + (footer() if rng.random() < 0.85 else "")
        inner = top + "<!-- x -->" + article() + bottom
        if rng.random() < 0.12:  # nothing but the article
            inner = choice(article(), article(), f"<p>{M}{prose()}</p><p>{M}{prose()}</p>", f"<p>{M}{sentence()}<p>{M}{sentence(1, 5)}", f"{M}{prose()}", f"<article><p>{M}{sentence(1, 4)}</p></article>", f"<h1>{M}{words(1, 6)}</h1><p>{M}{prose()}</p>")
            if rng.random() < 0.5:
                return inner
        if rng.random() < 0.2:
            inner = f"<div{choice('', attr('wrapper', 'container', 'page', 'site', 'layout'))}>{inner}</div>"
        whole = f"<html><head><title>{O}{words(2, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{inner}{choice('', '</body></html>', '</body></html>')}"
        return whole[: int(len(whole) * rng.uniform(0.5, 1))] if rng.random() < 0.05 else whole

    made = []
    for _ in range(n):
        found = blocks(page())
        for b in found:
            b.label = int(M in b.text)
            b.text = b.text.replace(M, "").replace(O, "")
        made.append([b for b in found if b.text.strip()])
    return made


@lru_cache(maxsize=4)
def model(n: int = PAGES, seed: int = 7) -> Field:
    return train(labelled_pages(n, seed))


def main_text(page: str | None, crf: Field, places: Places | None = None) -> str:
    """The blocks labelled main, joined by blank lines. A title in the head is never one."""
    if not page:
        return ""
    found = blocks(page, places)
    labels = crf.viterbi(sequence(found))
    return "\n\n".join(b.text for b, y in zip(found, labels, strict=True) if y)


def extract(pages: DataFrame, crf: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages (page_id, url, html).

    The whole html counts, whatever its length, and is read in one pass; a null or empty one, and one without a main block,
    has the empty text. Tags left open end with the page; elements nested deeper than DEPTH count as siblings. Repeated
    rows and null ids stay; other columns, of any name, are dropped.
    """
    state = pages.sparkSession.sparkContext.broadcast(crf or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, places = state.value.ready(), Places()
        for batch in batches:
            html = column(batch, "html")
            for lo in range(0, batch.num_rows, 500):
                texts = [main_text(h.as_py(), crf, places) for h in html[lo : lo + 500]]
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
