r"""Main text of web pages: a bidirectional LSTM labels every block, having seen the whole page.

A page is read once into blocks: the text between two marks of block elements, with
character references decoded, white space made one space, and the elements it stands
in. Scripts, styles, other content that is never shown, comments and markup are no
blocks. A block's vector has the mean of its path's vectors (elements with the words
of their classes and ids), the mean of its words' vectors, both by hash, and measures
of its text, links and place. Two LSTMs in numpy read the sequence from both ends,
and from both states the block is labelled main text or not; the blocks labelled
main text are the page's text.

The labeller learns from a sample of the pages, of ``SAMPLE_PAGES`` or so by a hash and of
at most ``SAMPLE_CHARS`` characters each: as they are, where ``article`` or ``main``
elements tell the text, and put together anew, their texts in other elements, in
other orders, and among menus, notices, forms, sidebars, adverts and comments. All pages
are then read whole and labelled.

Edge cases: null, empty and textless pages give an empty text; marks that are never
closed end where they must; pages of any size are read in time proportional to their
size; equal pages give equal texts, and repeated rows are read each; an empty table
gives no rows. Columns besides ``page_id``, ``url`` and ``html`` are not read, whatever their names.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .tokens import ALNUM, chunks

SAMPLE_PAGES, SAMPLE_CHARS, MADE_PAGES = 600, 50_000, 1500
#: Of HTML that is labelled at once, in characters; a longer page is alone.
CHUNK_CHARS = 2 << 20
PATHS, WORDS, WIDTH, HIDDEN = 1024, 4096, 16, 24

# Elements of HTML.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("audio canvas iframe math noembed noframes noscript object script select style svg template textarea title video".split())
_CLOSES_P = BLOCK - {"button", "label", "option", "body", "html", "head"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_KEEPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": (), "p": ()}
_TELLING = frozenset("article aside footer form header main nav search".split())

_QUOTED = re.compile(r"""</?([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN = re.compile(r"</?([A-Za-z][^\s/>]*)([^>]*)>")
_BEGUN = re.compile(r"<[A-Za-z/!?]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Block:
    text: str
    path: list[str]  #: what its elements are called, the innermost first
    link: int  #: characters of it that are links


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order; time is proportional to its length."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    n_open: dict[str, int] = {}
    never: set[str] = set()  # elements that are closed nowhere any more
    pieces: list[str] = []
    link, in_link = 0, False
    tag, n, at = _QUOTED, len(html), 0
    last_end, last_comment = html.rfind(">"), html.rfind("-->")

    def flush() -> None:
        nonlocal link
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            path = [w for _, own in stack[:-5:-1] for w in own[:4]]
            far = [w for name, own in stack[-5:-40:-1] if name in _TELLING or len(own) > 1 for w in own[:4]][:24]
            out.append(Block(text, path + far, min(link, len(text))))
        link = 0

    def close(name: str) -> None:
        while stack:
            top = stack.pop()[0]
            n_open[top] -= 1
            if top == name:
                break

    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last_end:
            # no mark ends any more; one that has begun is none
            begun = _BEGUN.search(html, at)
            pieces.append(unescape(html[at : begun.start() if begun else n]))
            break
        if lt > at:
            text = unescape(html[at:lt])
            pieces.append(text)
            link += len(text) if in_link else 0
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4) if lt + 4 <= last_comment else -1
            at = end + 3 if end >= 0 else html.index(">", lt) + 1
            continue
        m = tag.match(html, lt)
        if m is None and tag is _QUOTED and html[lt + 1 : lt + 2].strip("/").isalpha():
            # a quote is never closed: from here on marks end at the next bracket
            tag = _PLAIN
            m = tag.match(html, lt)
        if m is None:
            if html.startswith(("<!", "<?", "</"), lt):
                at = html.index(">", lt) + 1
            else:
                pieces.append("<")
                at = lt + 1
            continue
        name, at = m[1].lower(), m.end()
        if html[lt + 1] == "/":
            if name == "a":
                in_link = False
            elif name in BLOCK:
                flush()
                if n_open.get(name):
                    close(name)
            continue
        if name in HIDDEN_TEXT:
            if not m[2].endswith("/"):
                end = None if name in never else re.compile(f"</{re.escape(name)}", re.IGNORECASE).search(html, at)
                if end is None:
                    never.add(name)
                close_at = html.find(">", end.start()) if end else -1
                at = close_at + 1 if close_at >= 0 else n if end or name in ("script", "style") else at
            pieces.append(" ")
        elif name == "a":
            in_link = True
        elif name in BLOCK:
            flush()
            if name in _CLOSES_P and n_open.get("p"):
                close("p")
            for same in _SAME.get(name, ()):
                # an element that ends the one before it, unless a list or table lies between
                if n_open.get(same):
                    above = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1) if stack[i][0] == same or stack[i][0] in _KEEPS[name]), -1)
                    if above >= 0 and stack[above][0] == same:
                        close(same)
            if name not in VOID:
                called = [name] + [w.lower() for v in _NAMES.findall(m[2]) for w in _NAME_WORD.findall(v[0] or v[1] or v[2])]
                stack.append((name, called))
                n_open[name] = n_open.get(name, 0) + 1
        else:
            pieces.append(" " if name in ("br", "img", "wbr", "input") else "")
    flush()
    return out


# ---- vectors of blocks


def _hash(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


@dataclass
class Vectors:
    """Of the blocks of some pages: the hashed words of paths and texts, with the block of each, and measures."""

    path: np.ndarray
    path_of: np.ndarray
    word: np.ndarray
    word_of: np.ndarray
    measures: np.ndarray
    sizes: np.ndarray  #: of each page, its number of blocks


N_MEASURES = 12


def vectors_of(pages: list[list[Block]]) -> Vectors:
    blocks = [b for p in pages for b in p]
    path = [_hash(f"{i // 8}/{w}" if i < 8 else w, PATHS) for b in blocks for i, w in enumerate(b.path)]
    path_of = np.repeat(np.arange(len(blocks)), [len(b.path) for b in blocks])
    words, word_of = [], []
    for w in chunks(pa.array([b.text for b in blocks], pa.string()), ALNUM):
        words.append((w.hash % np.uint64(WORDS)).astype(np.int64))
        word_of.append(w.text + w.first)
    measures = np.zeros((len(blocks), N_MEASURES), np.float32)
    i = 0
    for page in pages:
        for k, b in enumerate(page):
            t, size = b.text, len(b.text)
            n = t.count(" ") + 1
            measures[i] = (
                np.log1p(size) / 5, np.log1p(n) / 4, b.link / size, size / n / 10, (t.count(".") + t.count("!") + t.count("?") + t.count("。")) / n, t.count(",") / n,
                t[-1] in ".!?:…\"'”»。", t[0].isupper(), n < 6, k / len(page), min(k, 20) / 20, min(len(page) - 1 - k, 20) / 20,
            )
            i += 1
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Vectors(np.array(path, np.int64), path_of, join(words), join(word_of), measures, np.array([len(p) for p in pages], np.int64))


def _means(vectors: np.ndarray, ids: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the ids' vectors for each of ``n`` blocks, and how many each has; ``of`` is sorted."""
    count = np.bincount(of, minlength=n)
    out = np.zeros((n, vectors.shape[1]), np.float32)
    has = np.flatnonzero(count)
    if len(has):
        begin = (np.cumsum(count) - count)[has]
        for lo in range(0, len(has), 4096):
            hi = min(lo + 4096, len(has))
            a, z = begin[lo], begin[hi] if hi < len(has) else len(ids)
            out[has[lo:hi]] = np.add.reduceat(vectors[ids[a:z]], begin[lo:hi] - a, axis=0)
        out[has] /= count[has, None]
    return out, count


# ---- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _pass(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, reverse: bool) -> tuple[np.ndarray, list]:
    """States of one LSTM over ``x`` (time, page, input), and what :func:`_pass_back` needs."""
    steps, pages, _ = x.shape
    size = wh.shape[0]
    given = x.reshape(-1, x.shape[2]) @ wx + b
    given = given.reshape(steps, pages, 4 * size)
    h, c = np.zeros((pages, size), np.float32), np.zeros((pages, size), np.float32)
    out, seen = np.zeros((steps, pages, size), np.float32), [None] * steps
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        z = given[t] + h @ wh
        gates, g = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        c_new = (f * c + i * g) * mask[t]
        tc = np.tanh(c_new)
        h_new = o * tc * mask[t]
        seen[t] = (h, c, i, f, o, g, tc)
        h, c = h_new, c_new
        out[t] = h
    return out, seen


def _pass_back(d_out: np.ndarray, x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, seen: list, reverse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    steps, pages, size = d_out.shape
    dh, dc = np.zeros((pages, size), np.float32), np.zeros((pages, size), np.float32)
    dz = np.zeros((steps, pages, 4 * size), np.float32)
    d_wh = np.zeros_like(wh)
    for t in range(steps) if reverse else range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = seen[t]
        d = (d_out[t] + dh) * mask[t]
        dc = (dc + d * o * (1 - tc * tc)) * mask[t]
        z = dz[t]
        z[:, :size] = dc * g * i * (1 - i)
        z[:, size : 2 * size] = dc * c * f * (1 - f)
        z[:, 2 * size : 3 * size] = d * tc * o * (1 - o)
        z[:, 3 * size :] = dc * i * (1 - g * g)
        d_wh += h.T @ z
        dh, dc = z @ wh.T, dc * f
    flat = dz.reshape(-1, 4 * size)
    return (flat @ wx.T).reshape(x.shape), x.reshape(-1, x.shape[2]).T @ flat, d_wh, flat.sum(axis=0)


@dataclass
class Labeller:
    """The weights of the network."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        r = np.random.default_rng(seed)
        width = 2 * WIDTH + N_MEASURES
        make = lambda *shape, by=0.1: (r.standard_normal(shape) * by).astype(np.float32)
        w = {"paths": make(PATHS, WIDTH), "words": make(WORDS, WIDTH), "out": make(2 * HIDDEN, by=0.2), "bias": np.zeros(1, np.float32)}
        for d in ("f", "b"):
            w |= {f"x{d}": make(width, 4 * HIDDEN, by=width**-0.5), f"h{d}": make(HIDDEN, 4 * HIDDEN, by=HIDDEN**-0.5), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remembers at first
        return cls(w)

    def _inputs(self, v: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(v.measures)
        paths, n_paths = _means(self.weights["paths"], v.path, v.path_of, n)
        words, n_words = _means(self.weights["words"], v.word, v.word_of, n)
        return np.concatenate([paths, words, v.measures], axis=1), n_paths, n_words

    @staticmethod
    def _laid_out(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks' numbers as (time, page) of pages of like length, -1 where a page has ended, and the pages."""
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and sizes[order[hi]] * (hi - lo + 1) <= 20_000 and sizes[order[hi]] <= 1.5 * sizes[order[lo]] + 4:
                hi += 1
            pages = order[lo:hi]
            t = np.arange(sizes[pages].max())[:, None]
            yield np.where(t < sizes[pages], begin[pages] + t, -1), pages
            lo = hi

    def probabilities(self, v: Vectors) -> np.ndarray:
        """For each block, how likely it is main text."""
        w = self.weights
        x, _, _ = self._inputs(v)
        out = np.zeros(len(x), np.float32)
        for at, _ in self._laid_out(v.sizes):
            mask = (at >= 0).astype(np.float32)[:, :, None]
            given = x[at] * mask
            states = [_pass(given, mask, w[f"x{d}"], w[f"h{d}"], w[f"c{d}"], d == "b")[0] for d in "fb"]
            p = _sigmoid(np.concatenate(states, axis=2) @ w["out"] + w["bias"])
            out[at[at >= 0]] = p[at >= 0]
        return out

    def gradients(self, v: Vectors, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean log loss over blocks and its gradient."""
        w = self.weights
        x, n_paths, n_words = self._inputs(v)
        d_x, loss = np.zeros_like(x), 0.0
        grads = {k: np.zeros_like(a) for k, a in w.items()}
        for at, _ in self._laid_out(v.sizes):
            real = at >= 0
            mask = real.astype(np.float32)[:, :, None]
            given = x[at] * mask
            runs = {d: _pass(given, mask, w[f"x{d}"], w[f"h{d}"], w[f"c{d}"], d == "b") for d in "fb"}
            states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
            p = _sigmoid(states @ w["out"] + w["bias"])
            y = labels[at]
            loss -= float(np.log(np.where(y == 1, p, 1 - p)[real] + 1e-9).sum())
            d = np.where(real, p - y, 0).astype(np.float32) / len(x)
            grads["out"] += np.einsum("tp,tph->h", d, states)
            grads["bias"] += d.sum()
            d_states = d[:, :, None] * w["out"]
            for i, k in enumerate("fb"):
                d_given, d_wx, d_wh, d_b = _pass_back(d_states[:, :, i * HIDDEN : (i + 1) * HIDDEN], given, mask, w[f"x{k}"], w[f"h{k}"], runs[k][1], k == "b")
                grads[f"x{k}"] += d_wx
                grads[f"h{k}"] += d_wh
                grads[f"c{k}"] += d_b
                d_x[at[real]] += d_given[real]
        np.add.at(grads["paths"], v.path, d_x[v.path_of, :WIDTH] / n_paths[v.path_of, None])
        np.add.at(grads["words"], v.word, d_x[v.word_of, WIDTH : 2 * WIDTH] / n_words[v.word_of, None])
        return loss / max(len(x), 1), grads


# ---- what it learns from

# What elements of pages are called, and what stands in them.
_IN = {
    "main": "article|main|div class=content|div id=content|div class=post-body|div class=entry-content|div class=article-body|section class=story|div role=main|div id=main|div class=text|div|section|td",
    "menu": "nav|div class=menu|ul class=navbar|div id=nav|div class=navigation|div class=topbar|ul class=menu|div class=breadcrumbs|div class=tabs|div",
    "header": "header|div id=header|div class=masthead|div class=site-header|div class=page-header|div class=branding|div class=logo|div",
    "footer": "footer|div id=footer|div class=site-footer|div class=copyright|div class=bottom|div class=legal|div",
    "sidebar": "aside|div class=sidebar|div id=right|div class=widget|div class=related|div class=recommended|section class=more|div id=sidebar|div class=popular|div class=trending",
    "advert": "div class=ad|div class=ads|div class=advert|div class=advertisement|div class=sponsored|div class=banner|div class=promo|div class=ad-slot|aside class=ad|div id=ad",
    "notice": "div class=cookie|div class=notice|div id=cookie-banner|div class=gdpr|div class=consent|div class=alert|div class=newsletter|div class=popup|div class=overlay|div role=alert",
    "form": "form|form class=search|form class=subscribe|div class=login|form id=contact|div class=search-box|form class=signup",
    "comments": "section class=comments|div id=comments|div class=comment-list|ol class=commentlist|div class=comment|div class=replies|div class=responses|div class=discussion|section id=comments",
    "share": "div class=share|ul class=social|div class=social-links|div class=toolbar|div class=tags|div class=author-bio|div class=meta",
}
_SAID = {
    "menu": "Home|News|About us|Contact|Products|Blog|Sports|World|Business|Login|Sign in|Shop|Startseite|Kontakt|Accueil|Inicio|Politik|Culture|Help|Menu",
    "header": "Skip to content|The daily news|Welcome|Search|Subscribe|Today|English|Deutsch|Français|Español",
    "footer": "All rights reserved|© 2024|Privacy policy|Terms of use|Imprint|Impressum|Datenschutz|Mentions légales|Aviso legal|Contact us|Powered by|Sitemap|Cookie settings",
    "sidebar": "Related articles|Most read|You may also like|Recent posts|Popular|Trending now|More from us|Archive|Categories|Read more|Newsletter|Meist gelesen|Lire aussi|Más leídas",
    "advert": "Advertisement|Sponsored|Buy now|Special offer|Anzeige|Publicité|Publicidad|Save 50% today|Order now|Shop the sale",
    "notice": "We use cookies to improve your experience|Accept all|Reject|This site uses cookies|Wir verwenden Cookies|Nous utilisons des cookies|Usamos cookies|Subscribe to continue reading|Please enable JavaScript|Manage preferences|Sign up for our newsletter",
    "form": "Name|Email|Your message|Send|Search|Password|Sign up|Log in|Submit|Remember me|Subscribe",
    "comments": "Reply|Leave a comment|2 days ago|Report|Like|3 comments|Log in to comment|Antworten|Répondre|Responder|Sort by newest|ann says:|Guest wrote:|Posted by max",
    "share": "Share|Tweet|Share on Facebook|Print|Email this|Copy link|Tags|Follow us|Teilen|Partager|Compartir",
}
_IN, _SAID = {k: v.split("|") for k, v in _IN.items()}, {k: v.split("|") for k, v in _SAID.items()}
_NOT_MAIN = frozenset("nav aside footer form".split())


def told(block: Block) -> bool | None:
    """Whether the elements themselves tell that a block is main text; not, if none of them does."""
    names = set(block.path)
    return None if not names & {"article", "main"} else not names & _NOT_MAIN


def _element(kind: str, rnd: random.Random) -> tuple[str, str]:
    name, _, attr = rnd.choice(_IN[kind]).partition(" ")
    if attr:
        key, _, value = attr.partition("=")
        value = rnd.choice((value, value, f"{value} {rnd.choice('abcxyz')}{rnd.randrange(99)}", f"{rnd.choice(('site', 'page', 'box', 'm'))}-{value}"))
        attr = f' {key}="{value}"'
    elif rnd.random() < 0.3:
        attr = f' class="{rnd.choice("abcdefgh")}{rnd.randrange(999)}"'
    return f"<{name}{attr}>", f"</{name}>"


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def made_page(main: list[str], other: list[str], rnd: random.Random) -> tuple[str, list[int]]:
    """A page put together of main texts, and of texts that may stand elsewhere, with the label of each block."""
    out: list[str] = []
    labels: list[int] = []

    def add(text: str, label: int, mark: str, link: bool = False) -> None:
        inner = _escaped(text)
        out.append(f"<{mark}>{f'<a href=x>{inner}</a>' if link else inner}</{mark}>")
        labels.append(label)

    def part(kind: str) -> None:
        begin, end = _element(kind, rnd)
        out.append(begin)
        listed, linked = rnd.random() < 0.5, kind in ("menu", "footer", "sidebar", "share") and rnd.random() < 0.7
        for _ in range(rnd.randrange(1, 8 if kind in ("menu", "comments", "sidebar") else 4)):
            own = kind in ("comments", "advert", "notice", "sidebar", "form") and rnd.random() < 0.6 or kind in ("menu", "footer") and rnd.random() < 0.3
            text = rnd.choice(other) if own and other else rnd.choice(_SAID[kind])
            add(text, 0, "li" if listed else rnd.choice(("p", "div", "div", "h3", "label" if kind == "form" else "p")), linked and len(text) < 120)
        out.append(end)

    around = lambda kinds, most: [rnd.choice(kinds) for _ in range(rnd.randrange(most + 1))]
    if rnd.random() < 0.5:
        out.append("<body>")
    for kind in around(("menu", "header", "notice", "advert", "form", "share", "sidebar"), 5):
        part(kind)
    begin, end = _element("main", rnd)
    nested = rnd.random() < 0.4
    out.append(f'<div class="{rnd.choice(("wrap", "container", "page", "row", "col", "site"))}">' if nested else "")
    out.append(begin)
    if rnd.random() < 0.7:
        add(rnd.choice(main)[:60].strip() or "x", 1, rnd.choice(("h1", "h1", "h2")))
    for text in main:
        add(text, 1, rnd.choices(("p", "li", "h2", "blockquote", "div", "pre"), (12, 1, 1, 1, 1, 0.5))[0])
        if rnd.random() < 0.05:
            part(rnd.choice(("advert", "share", "sidebar", "notice", "form")))
    if rnd.random() < 0.3:
        part(rnd.choice(("comments", "share", "comments")))
    out += [end, "</div>" if nested else ""]
    for kind in around(("comments", "comments", "sidebar", "footer", "form", "advert", "notice", "footer", "menu"), 5):
        part(kind)
    return "".join(out), labels


def lessons(htmls: list[str], n_made: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Pages as blocks with labels: the sample's own, where their elements tell, and ``n_made`` put together."""
    rnd = random.Random(seed)
    pages, labels, mains, other = [], [], [], []
    for html in htmls:
        blocks = blocks_of(html)
        tells = [told(b) for b in blocks]
        if any(tells):
            pages.append(blocks)
            labels.append(np.array([bool(t) for t in tells], np.int64))
            mains.append([b.text for b, t in zip(blocks, tells, strict=True) if t])
            other += [b.text for b, t in zip(blocks, tells, strict=True) if not t]
        elif texts := [b.text for b in blocks if b.text.count(" ") > 15 and b.link * 3 < len(b.text)]:
            mains.append(texts)
    if not mains:
        word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9)))
        mains = [[" ".join(word() for _ in range(rnd.randrange(5, 60))).capitalize() + "." for _ in range(6)] for _ in range(50)]
    for _ in range(n_made):
        own = rnd.choice(mains)
        lo = rnd.randrange(len(own))
        main = [t[: rnd.choice((60, 400, 2000))] for t in own[lo : lo + rnd.randrange(1, 25)]]
        # remarks read like main text
        remarks = [rnd.choice(rnd.choice(mains))[: rnd.choice((40, 150, 500))] for _ in range(3)] + rnd.sample(other, min(2, len(other)))
        html, gold = made_page([t for t in main if t.strip()] or ["x"], [t for t in remarks if t.strip()], rnd)
        blocks = blocks_of(html)
        if len(blocks) == len(gold):
            pages.append(blocks)
            labels.append(np.array(gold, np.int64))
    return pages, labels


def trained(htmls: list[str], n_made: int = MADE_PAGES, seed: int = 7, epochs: int = 5, batch: int = 48) -> Labeller:
    """A labeller that has learnt from the pages of a sample, by Adam."""
    pages, labels = lessons(htmls, n_made, seed)
    model, rnd = Labeller.fresh(seed), random.Random(seed)
    first = {k: np.zeros_like(a) for k, a in model.weights.items()}
    second = {k: np.zeros_like(a) for k, a in model.weights.items()}
    step, order = 0, list(range(len(pages)))
    total = epochs * -(-len(order) // batch)
    for _ in range(epochs):
        rnd.shuffle(order)
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            _, grads = model.gradients(vectors_of([pages[i] for i in some]), np.concatenate([labels[i] for i in some]))
            step += 1
            rate = 0.01 * min(1, step / 20) * (1 - 0.9 * step / total)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return model


def sampled(pages: DataFrame, n: int = SAMPLE_PAGES, most_chars: int = SAMPLE_CHARS) -> list[str]:
    """About ``n`` pages of at most ``most_chars`` characters, twice as many at most, by a hash of id and address."""
    fits = pages.where(F.length("html") <= most_chars)
    total = fits.count()
    share = int((1 << 30) * min(1.0, n / max(total, 1)))
    some = fits.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < share)
    return sorted(r.html for r in some.select("html").limit(2 * n).collect())


# ---- over tables


def _grouped(htmls: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, h in enumerate(htmls):
        if i > lo and size + len(h or "") > CHUNK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(h or "")
    if lo < len(htmls):
        yield lo, len(htmls)


def labelled(pages: DataFrame, model: Labeller) -> DataFrame:
    """``page_id, url, blocks`` of each row: of each block its ``text``, its ``path`` and how likely (``p``) it is main text."""
    kind = pages.schema["page_id"].dataType.simpleString()
    weights = model.weights
    block = pa.struct([("text", pa.string()), ("path", pa.string()), ("p", pa.float32())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(weights)
        for batch in batches:
            htmls = batch.column("html").to_pylist()
            for lo, hi in _grouped(htmls):
                each = [blocks_of(h or "") for h in htmls[lo:hi]]
                p = own.probabilities(vectors_of(each))
                flat = [b for x in each for b in x]
                rows = pa.StructArray.from_arrays([pa.array([b.text for b in flat], pa.string()), pa.array([" ".join(b.path) for b in flat], pa.string()), pa.array(p, pa.float32())], fields=list(block))
                ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
                size = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(lo, size), batch.column("url").slice(lo, size), pa.ListArray.from_arrays(pa.array(ends), rows)], ["page_id", "url", "blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(made, f"page_id {kind}, url string, blocks array<struct<text:string,path:string,p:float>>")


def extracted(pages: DataFrame, model: Labeller | None = None, threshold: float = 0.5) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_main`` of each row; without a model one learns from the pages."""
    model = model or trained(sampled(pages))
    main = F.filter("blocks", lambda b: b["p"] >= threshold)
    text = F.array_join(F.transform("main", lambda b: b["text"]), "\n")
    out = labelled(pages, model).select("page_id", "url", main.alias("main"), F.size("blocks").alias("n_blocks"))
    return out.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"), "n_blocks", F.size("main").alias("n_main"))


def op12_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
