"""Main text of web pages by a linear-chain conditional random field.

A page is parsed into leaf blocks: runs of text between block-level tags. Each has features of its ancestor tags, their
class and id words, and its text. The field labels the blocks in page order as article or not; it is trained here by
gradient ascent on the likelihood of labelled pages, and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarrylight.llm.common import schema_with, set_aside

#: Elements that end a line of text, elements without content, and elements whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template textarea title".split())
#: Elements that an open paragraph ends before, and open elements that another of their kind ends.
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True, slots=True)
class Place:
    """Where a block stands: the innermost tag and block-level tag, and what all ancestors together have of the tags and
    of the class and id words that features ask for."""

    tag: str = ""
    inner: str = ""
    above: frozenset[str] = frozenset()
    kinds: frozenset[str] = frozenset()


@dataclass
class Block:
    text: str
    place: Place
    linked: int  # characters inside links


class _Stack:
    """The open elements. The places of every tag's open elements are kept, so that no search walks the stack."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: list[Place] = [Place()]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # of block-level elements other than paragraphs

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else -1

    def push(self, tag: str, kinds: frozenset[str]) -> None:
        up, k = self.places[-1], len(self.tags)
        self.tags.append(tag)
        self.at.setdefault(tag, []).append(k)
        if tag in BLOCK_TAGS and tag != "p":
            self.blocks.append(k)
        above = up.above | {tag} if tag in _ABOVE and tag not in up.above else up.above
        self.places.append(Place(tag, tag if tag in BLOCK_TAGS else up.inner, above, up.kinds if kinds <= up.kinds else up.kinds | kinds))

    def pop(self, k: int) -> None:
        """Closes the element at k and those inside it."""
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.places.pop()
            self.at[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.tags):
                self.blocks.pop()

    def end(self, tag: str) -> None:
        k = self.last(tag)
        # an inline end tag does not close blocks
        if k >= 0 and (tag in BLOCK_TAGS or max(self.blocks[-1] if self.blocks else -1, self.last("p")) <= k):
            self.pop(k)

    def begin(self, tag: str) -> None:
        """Closes what a block-level start tag ends."""
        if tag in _SELF_CLOSING:
            floor = max((self.last(t) for t in _SCOPES[tag]), default=-1)
            found = [self.at[t][bisect_right(self.at[t], floor)] for t in _SELF_CLOSING[tag] if self.last(t) > floor]
            if found:
                self.pop(min(found))
        p = self.last("p")
        if tag not in ("button", "iframe") and p > (self.blocks[-1] if self.blocks else -1):
            self.pop(p)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that have text, in page order."""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked, at, n = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack.places[-1], linked))
            parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if stack.at.get("a"):
            linked += len(text)

    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            put(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            stack.end(tag)
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else n
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            stack.begin(tag)
        if tag not in VOID_TAGS:
            stack.push(tag, _kinds(m[3]) if m[3] else frozenset())
    if at < n:
        put(html.unescape(page[at:]))
    flush()
    return out


def _kinds(attributes: str) -> frozenset[str]:
    """What the class and id words, and the ways to hide an element, say about it."""
    found = set()
    for name, value in _NAMES.findall(attributes):
        low = name.lower()
        if low == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                found.add("hidden")
        elif low == "hidden" or low == "aria-hidden":
            found.add("hidden") if low == "hidden" or "true" in value.lower() else None
        else:
            found.update(_KIND[w] for w in map(str.lower, _WORDS.findall(value)) if w in _KIND)
    return frozenset(found)


# ---------------------------------------------------------------- features

#: Words in class and id names, and in short texts, that the features tell apart by kind.
KINDS = {
    "advert": "ad ads adv advert advertisement banner promo promoted promotion sponsor sponsored doubleclick dfp outbrain taboola affiliate",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs topbar toolbar tabs pagination pager skip sitemap toc",
    "frame": "header masthead footer foot colophon copyright legal imprint logo branding site",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more popular trending tags tag cloud archive archives latest teaser",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay lightbox paywall newsletter subscribe subscription signup toast dialog privacy",
    "form": "form search login signin register input contact poll survey",
    "reader": "comment comments commentlist reply replies respond discussion disqus thread responses reader readers feedback",
    "social": "share sharing social facebook twitter follow like",
    "byline": "byline author meta date dateline timestamp published credit",
    "article": "article content entry post story main body text prose page blog news hentry maincontent",
    "hidden": "hidden invisible",
}
_KIND = {w: k for k, ws in KINDS.items() for w in ws.split()}
_SAYS = re.compile(
    r"(?i)\b(cookies?|subscribe|newsletter|sign (?:in|up)|log ?in|register|advertis\w+|sponsored|copyright|all rights reserved|privacy policy|terms of (?:use|service)|share (?:this|on)|"
    r"leave a (?:reply|comment)|comments?|read more|related|click here|accept|menu|search|follow us|reply)\b|©"
)


_ABOVE = frozenset("nav header footer aside form article main ul ol table section blockquote pre figure button select dialog a dl menu label".split())


@lru_cache(maxsize=1 << 14)
def _structure(place: Place) -> tuple[str, ...]:
    """Features of a block's place in the page."""
    kinds = sorted(place.kinds)
    f = ["bias", f"tag:{place.tag}", f"block:{place.inner}"]
    f += [f"in:{t}" for t in sorted(place.above)]
    f += [f"kind:{k}" for k in kinds]
    if "article" in place.above or "main" in place.above or "article" in kinds:
        f.append("within")
        f += [f"within+kind:{k}" for k in kinds]
        f += [f"within+{t}" for t in ("header", "footer", "nav", "aside", "form", "ul") if t in place.above]
    else:
        f.append("without")
        f.append(f"without+block:{place.inner}")
    return tuple(f)


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features of every block of a page."""
    out = []
    longest = max((len(b.text) for b in found), default=0)
    seen_head = False
    for i, b in enumerate(found):
        inner = b.place.inner
        n = len(b.text)
        words = b.text.count(" ") + 1
        f = list(_structure(b.place))
        size = 0 if words < 3 else 1 if words < 8 else 2 if words < 20 else 3 if words < 50 else 4
        dense = 0 if not b.linked else 1 if 3 * b.linked < n else 2 if 3 * b.linked < 2 * n else 3
        f += [f"size:{size}", f"links:{dense}", f"size:{size}+links:{dense}", f"block:{inner}+size:{size}"]
        if b.text[-1] in ".!?:;\"'”»…)":
            f.append("stop")
        if words < 40 and _SAYS.search(b.text):
            f.append("says")
            f.append("says+short" if words < 12 else "says+mid")
        if inner in ("h1", "h2", "h3", "h4", "h5", "h6"):
            f.append("head")
            f.append("head:first" if not seen_head else "head:later")
            seen_head = True
        if 4 * n > longest:
            f.append("large")
        if i == 0:
            f.append("first")
        if i == len(found) - 1:
            f.append("last")
        out.append(f)
    return out


# ---------------------------------------------------------------- the field


class Field:
    """A linear-chain field over labels 0 (other) and 1 (article)."""

    def __init__(self, names: dict[str, int], state: np.ndarray, step: np.ndarray):
        self.names, self.state, self.step = names, state, step
        self._more: dict[str, float] | None = None

    def scores(self, feats: list[list[str]]) -> list[tuple[float, float]]:
        """Of both labels for each block; label 0 counts as 0."""
        if self._more is None:
            more = (self.state[:, 1] - self.state[:, 0]).tolist()
            self._more = {k: more[v] for k, v in self.names.items()}
        get = self._more.get
        return [(0.0, sum([get(k, 0.0) for k in f])) for f in feats]

    def viterbi(self, rows: list[tuple[float, float]]) -> list[int]:
        """The most likely labels; of equally likely ones, those that say article."""
        if not rows:
            return []
        (t00, t01), (t10, t11) = self.step.tolist()
        a, b, back = rows[0][0], rows[0][1], []
        for x, y in rows[1:]:
            from0, from1 = a + t00 > b + t10, a + t01 > b + t11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + t00 if from0 else b + t10) + x, (a + t01 if from1 else b + t11) + y
        label = 0 if a > b else 1
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 100, penalty: float = 0.02) -> Field:
    """Maximum likelihood with a Gaussian prior, by forward and backward sums over all pages at once and Adam steps."""
    names: dict[str, int] = {}
    for feats, _ in pages:
        for f in feats:
            for k in f:
                names.setdefault(k, len(names))
    p, longest = len(pages), max(len(x) for x, _ in pages)
    length = np.array([len(x) for x, _ in pages])
    flat_feats = [[names[k] for k in f] for feats, _ in pages for f in feats]
    row = np.repeat(np.arange(len(flat_feats)), [len(f) for f in flat_feats])
    col = np.concatenate([np.array(f) for f in flat_feats])
    x = np.zeros((len(flat_feats), len(names)))
    np.add.at(x, (row, col), 1)
    place = np.concatenate([k * longest + np.arange(m) for k, m in enumerate(length)])
    gold = np.concatenate([np.array(y) for _, y in pages])
    inside = np.arange(longest) < length[:, None]
    truth = np.zeros((p, longest), int)
    truth.ravel()[place] = gold
    pair_in = inside[:, 1:]
    gold_step = np.zeros((2, 2))
    np.add.at(gold_step, (truth[:, :-1][pair_in], truth[:, 1:][pair_in]), 1)
    theta = [np.zeros((len(names), 2)), np.zeros((2, 2))]
    m1, m2 = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]

    xt = np.ascontiguousarray(x.T)

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        return np.logaddexp(a.take(0, axis), a.take(1, axis))

    for turn in range(1, rounds + 1):
        state, step = theta
        unary = np.zeros((p * longest, 2))
        unary[place] = x @ state
        unary = unary.reshape(p, longest, 2)
        fore, aft = np.zeros((p, longest, 2)), np.zeros((p, longest, 2))
        fore[:, 0] = unary[:, 0]
        for t in range(1, longest):
            new = lse(fore[:, t - 1][:, :, None] + step, 1) + unary[:, t]
            fore[:, t] = np.where(inside[:, t, None], new, fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = lse(step + (unary[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
            aft[:, t] = np.where(inside[:, t + 1, None], new, 0)
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        node = np.exp(fore + aft - total[:, None, None]).reshape(-1, 2)[place]
        edge = np.exp(fore[:, :-1, :, None] + step + (unary[:, 1:] + aft[:, 1:])[:, :, None, :] - total[:, None, None, None])[pair_in].sum(0)
        want = np.zeros_like(node)
        want[np.arange(len(gold)), gold] = 1
        grads = [xt @ (want - node) - penalty * state * p / 10, gold_step - edge - penalty * step * p / 10]
        for k, g in enumerate(grads):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            theta[k] = theta[k] + 0.08 * (m1[k] / (1 - 0.9**turn)) / (np.sqrt(m2[k] / (1 - 0.99**turn)) + 1e-8)
    return Field(names, *theta)


# ---------------------------------------------------------------- labelled pages

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu an er in on th st sch ción ment eau".split()


def labelled_page(r: random.Random) -> list[tuple[str, int, str]]:
    """A page of a made-up site as (markup before, label, text) pieces; label -1 where there is no text."""
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    sent = lambda a=3, b=16: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", ".", "!", "?"])
    para = lambda a=1, b=6: " ".join(sent() for _ in range(r.randint(a, b)))
    law = ["All rights reserved.", "Copyright " + word() + ".", "This work is licensed under the General Public License, version 3.", "Read more about comments and cookies.", "Licensed under the " + word() + " License."]
    odd = lambda: r.choice([r.choice(law), " ".join(word() + r.choice(["***", "###", "!!", "$$$"]) for _ in range(r.randint(2, 30))), " ".join([word()] * r.randint(2, 20)), sent().upper(), str(r.randint(1, 99999)) + " " + word()])
    pick = lambda kind: r.choice(KINDS[kind].split())
    cls = lambda kind: r.choice([f' class="{pick(kind)}"', f' id="{pick(kind)}"', f' class="{pick(kind)}-{word()}"', f' class="{word()} {pick(kind)}"'])
    out: list[tuple[str, int, str]] = []
    put = lambda markup, label=-1, text="": out.append((markup, label, text))

    def links(n: int, open_: str, close: str, label: int = 0) -> None:
        put(open_)
        for _ in range(n):
            item = r.choice([("<li><a href='/x'>", "</a></li>"), ("<a href='/x'>", "</a> "), ("<div><a href='#'>", "</a></div>")])
            put(item[0], label, r.choice([word(), word() + " " + word(), sent(2, 6)]))
            put(item[1])
        put(close)

    def nav() -> None:
        links(r.randint(3, 9), r.choice(["<nav><ul>", f"<div{cls('menu')}><ul>", f"<ul{cls('menu')}>", "<nav>"]), "</ul></nav></div>")

    def advert() -> None:
        tag = r.choice(["div", "div", "section", "aside", "p"])
        put(f"<{tag}{cls('advert')}>", 0, r.choice([sent(3, 12), "Advertisement", "Sponsored: " + sent(3, 8), para(1, 2)]))
        put(f"</{tag}>")

    def header() -> None:
        put(r.choice(["<header>", f"<div{cls('frame')}>", f"<header{cls('frame')}>"]))
        put(r.choice(["<h1>", "<div>", "<a href='/'>", "<p>"]), 0, word() + " " + word())
        put("</h1></div></a></p>")
        if r.random() < 0.5:
            put("<p>", 0, sent(2, 8))
            put("</p>")
        if r.random() < 0.5:
            nav()
        put("</header></div>")

    def footer() -> None:
        put(r.choice(["<footer>", f"<div{cls('frame')}>", f"<footer{cls('frame')}>"]))
        for _ in range(r.randint(1, 3)):
            put(r.choice(["<p>", "<div>", "", "<small>"]), 0, r.choice(["&copy; 2020 " + word() + ". All rights reserved.", "&copy; www." + word() + ".example &middot; " + sent(), sent(), "Privacy policy", "Copyright " + word()]))
            put("</p></div>")
        if r.random() < 0.4:
            links(r.randint(2, 6), "<ul>", "</ul>")
        put("</footer></div>")

    def side() -> None:
        put(r.choice(["<aside>", f"<div{cls('side')}>", f"<aside{cls('side')}>", f"<section{cls('side')}>"]))
        if r.random() < 0.7:
            put(r.choice(["<h3>", "<h2>", "<h4>", "<div>"]), 0, r.choice(["Related", "More " + word(), word(), sent(1, 3)]))
            put("</h3></h2></h4></div>")
        if r.random() < 0.7:
            links(r.randint(2, 7), r.choice(["<ul>", "<div>"]), "</ul></div>")
        for _ in range(r.randint(0, 3)):
            put("<p>", 0, para(1, 3))
            put("</p>")
        put("</aside></div></section>")

    def notice() -> None:
        tag = r.choice(["div", "section", "p", "dialog"])
        put(f"<{tag}{cls('notice')}>", 0, r.choice(["We use cookies. " + sent(), "Subscribe to our newsletter. " + sent(), sent(4, 14), para(1, 2)]))
        if r.random() < 0.5:
            put("<button>", 0, r.choice(["Accept", "OK", "Sign up", word()]))
            put("</button>")
        put(f"</{tag}>")

    def form() -> None:
        put(r.choice(["<form>", f"<form{cls('form')}>", f"<div{cls('form')}><form>"]))
        for _ in range(r.randint(1, 3)):
            put(r.choice(["<label>", "<p>", "<div>", "<legend>"]), 0, r.choice(["Search", "Your name", sent(1, 4), word()]))
            put("</label></p></div></legend><input type='text'>")
        put("<button>", 0, r.choice(["Go", "Submit", word()]))
        put("</button></form></div>")

    def comments() -> None:
        put(r.choice([f"<section{cls('reader')}>", f"<div{cls('reader')}>", f"<ol{cls('reader')}>"]))
        if r.random() < 0.7:
            put("<h3>", 0, r.choice(["Comments", "3 comments", "Leave a reply", sent(1, 3)]))
            put("</h3>")
        for _ in range(r.randint(1, 6)):
            put(r.choice(["<div>", "<li>", f"<div{cls('reader')}>", "<article>"]))
            if r.random() < 0.6:
                put("<b>", 0, word() + ":")
                put("</b>")
            put("<p>", 0, para(1, 4))
            put("</p></div></li></article>")
        put("</section></div></ol>")

    def share() -> None:
        links(r.randint(2, 4), f"<div{cls('social')}>", "</div>")

    def article() -> None:
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        named = cls("article") if tag in ("div", "section") and r.random() < 0.8 or r.random() < 0.4 else ""
        put(f"<{tag}{named}>")
        if r.random() < 0.85:
            put(r.choice(["<h1>", "<h1>", "<h2>"]), 1, r.choice([sent(1, 12), para(1, 1)]))
            put("</h1></h2>")
        if r.random() < 0.3:
            put(f"<p{cls('byline')}>" if r.random() < 0.5 else "<p>", 1, sent(2, 6))
            put("</p>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.72:
                put("<p>", 1, r.choice([para(1, 1), para(1, 7), para(1, 7), sent(1, 3), word() + ".", odd()]))
                put("</p>")
            elif kind < 0.78:
                put(r.choice(["<h2>", "<h3>"]), 1, sent(1, 6))
                put("</h2></h3>")
            elif kind < 0.83:
                put(r.choice(["<ul>", "<ol>"]))
                for _ in range(r.randint(2, 5)):
                    put("<li>", 1, sent(1, 12))
                    put("</li>")
                put("</ul></ol>")
            elif kind < 0.86:
                put("<blockquote><p>", 1, para(1, 3))
                put("</p></blockquote>")
            elif kind < 0.88:
                put("<pre>", 1, sent(2, 10))
                put("</pre>")
            elif kind < 0.90:
                put("<table><tr>")
                for _ in range(r.randint(2, 6)):
                    put("<td>", 1, sent(1, 4))
                    put("</td>")
                put("</tr></table>")
            elif kind < 0.92:
                put("<p><b>", 1, sent(3, 14))
                put("<br>")
            elif kind < 0.95:
                advert()
            elif kind < 0.97:
                r.choice([side, share, notice])()
            else:
                put("<p>", 1, para(1, 2))
                put("<a href='/y'>", 1, word() + " " + word())
                put("</a>", 1, sent(2, 6))
                put("</p>")
        if r.random() < 0.15:
            r.choice([share, comments, form, side])()
        put(f"</{tag}>")

    put("<!DOCTYPE html><html><head><title>x</title></head><body>")
    for part, chance in ((notice, 0.25), (header, 0.45), (nav, 0.8), (form, 0.2), (advert, 0.6), (side, 0.25)):
        if r.random() < chance:
            part()
    wrap = r.random() < 0.5
    put(f"<div{cls('article')}>" if wrap and r.random() < 0.3 else "<div>" if wrap else "")
    article()
    if r.random() < 0.2:  # the page was cut off
        return out
    for part, chance in ((share, 0.25), (advert, 0.3), (comments, 0.35), (side, 0.4), (form, 0.2)):
        if r.random() < chance:
            part()
    put("</div>" if wrap else "")
    for part, chance in ((notice, 0.2), (footer, 0.9)):
        if r.random() < chance:
            part()
    return out


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """Pages and the label of each of their leaf blocks."""
    r, out = random.Random(seed), []
    while len(out) < n:
        pieces = labelled_page(r)
        page = "".join(m + t for m, _, t in pieces)
        texts = [(" ".join(html.unescape(t).split()), y) for _, y, t in pieces if y >= 0]
        labels, k = [], 0
        for b in blocks(page):  # a block may hold several pieces, as links side by side
            votes, rest = [], b.text
            while k < len(texts) and rest.startswith(texts[k][0]):
                rest = rest[len(texts[k][0]) :].lstrip()
                votes.append(texts[k][1])
                k += 1
                if not rest:
                    break
            if not votes or rest:
                break
            labels.append(round(sum(votes) / len(votes)))
        else:
            if k == len(texts) and labels:
                out.append((page, labels))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = 500, seed: int = 5) -> Field:
    return fit([(features(blocks(p)), y) for p, y in labelled_pages(pages, seed)])


def main_text(page: str | None, field: Field) -> str:
    """The article's blocks in page order, one a line; empty if there are none."""
    found = blocks(page or "")
    labels = field.viterbi(field.scores(features(found)))
    return "\n".join(b.text for b, y in zip(found, labels, strict=True) if y)


def extract(pages: DataFrame, source: str = "html", field: Field | None = None, into: str = "text") -> DataFrame:
    """pages with the main text of every whole page. Null pages are empty and have an empty text.

    Other columns and repeated rows pass through, one called as the new one under a leading underscore; an empty table
    gives an empty table.
    """
    pages = set_aside(pages, into)
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(x, field) for x in part.column(part.schema.get_field_index(source)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, into])

    return pages.mapInArrow(run, schema_with(pages.schema, **{into: T.StringType()}))


def op5_dom_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
