"""Main text of web pages by a linear-chain conditional random field.

A page is read as its leaf blocks: runs of text between the starts and ends of
block elements, in page order. Each block has features of its ancestors' tags,
of words in their class and id, and of its text. The field scores every block
as main text or not, together with the step from the block before, and Viterbi
picks the page's best labels. It is trained by maximum likelihood on labelled
pages; those in this module are invented layouts whose labels are known from
how they are built, and callers can give their own.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Pages that training uses, and rounds of gradient ascent.
TRAIN_PAGES, ROUNDS = 700, 160
#: Attribute that marks a labelled page's elements: 1 main text, 0 not.
MARK = "data-main"

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>|<[!?/][^>]*+>|<[A-Za-z/!?][^>]*+\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|data-main)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose text is never part of the page's text; the first group holds raw text (fixed values).
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
_SKIPPED = frozenset(("head", "noscript", "template", "svg", "select", "button", "canvas", "audio", "video", "map", "datalist"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "input", "embed")
)
_LEAVES = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "dt", "dd", "dl", "figure", "figcaption"))
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|</{t}\Z", re.I) for t in _RAW}
#: A start tag on the left ends an open element on the right, up to the given ancestors.
_IMPLIED = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dd", ("dl",)), "td": ("td", ("tr", "table")), "tr": ("tr", ("table",)), "option": ("option", ("select",))}

#: Ancestors' tags that are features (fixed values).
TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "figure", "figcaption", "blockquote", "pre", "p", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "details", "dialog", "address", "menu", "fieldset")
#: Words in class and id that are features, by what they speak for (fixed values).
NAMES = {
    "text": "content article post entry story body text main page prose paragraph",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager toc",
    "side": "sidebar side aside widget rail complementary",
    "edge": "header footer masthead banner contentinfo copyright topbar bottom colophon site",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion promoted dfp affiliate",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert warning toast paywall dialog privacy",
    "talk": "comment comments commentlist reply replies discussion disqus respond thread responses feedback",
    "share": "share sharing social follow related recommend recommended recommendations tags more trending popular newsletter subscribe signup teaser outbrain taboola",
    "form": "form search login register",
}
_OF_NAME = {w: k for k, ws in NAMES.items() for w in ws.split()}

FEATURES = (
    "bias", *(f"tag {t}" for t in TAGS), *(f"name {n}" for n in NAMES), "hidden", "in text", "in text, no other name",
    "words 1", "words 2-3", "words 4-7", "words 8-15", "words 16-31", "words 32-79", "words 80", "links none", "links few", "links many", "links all",
    "ends a sentence", "has a comma", "copyright", "capitals", "after h1", "first", "last",
    "no root", "no root, no other name", "no root, prose", "in most text", "in most text, no other name",
)
_BIT = {f: 1 << i for i, f in enumerate(FEATURES)}
_TAG_BIT = {t: _BIT[f"tag {t}"] for t in TAGS}
_SKIP = 1 << len(FEATURES)
_KEEP, _LEAVE = _SKIP << 1, _SKIP << 2
_TEXT_ROOTS = _BIT["tag article"] | _BIT["tag main"] | _BIT["name text"]
_OTHER = sum(_BIT[f"name {n}"] for n in NAMES if n != "text") | sum(_BIT[f"tag {t}"] for t in ("nav", "header", "footer", "aside", "form", "menu", "dialog"))
_OWN = (1 << len(FEATURES)) - 1
_PROSE = _BIT["words 8-15"] | _BIT["words 16-31"] | _BIT["words 32-79"] | _BIT["words 80"]


def _attribute_bits(attributes: str) -> int:
    bits = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for part in _NAME_PART.findall(value):
                if kind := _OF_NAME.get(part.lower()):
                    bits |= _BIT[f"name {kind}"]
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            bits |= _BIT["hidden"]
        elif name == MARK:
            bits |= _KEEP if value == "1" else _LEAVE
    return bits


def _text_bits(text: str, linked: int) -> int:
    n = text.count(" ") + 1
    size = "1" if n == 1 else "2-3" if n < 4 else "4-7" if n < 8 else "8-15" if n < 16 else "16-31" if n < 32 else "32-79" if n < 80 else "80"
    share = linked / len(text)
    bits = _BIT["bias"] | _BIT[f"words {size}"] | _BIT["links none" if not linked else "links few" if share < 0.34 else "links many" if share < 0.8 else "links all"]
    if text[-1] in ".!?…:;\"'”»)":
        bits |= _BIT["ends a sentence"]
    if "," in text:
        bits |= _BIT["has a comma"]
    if "©" in text:
        bits |= _BIT["copyright"]
    if text.isupper():
        bits |= _BIT["capitals"]
    return bits


def blocks(page: str) -> tuple[list[str], list[int], list[int | None]]:
    """The page's leaf blocks in order: texts, feature bits, and labels where the page has them."""
    texts: list[str] = []
    feats: list[int] = []
    labels: list[int | None] = []
    homes: list[int] = []  # the block-level element that holds each block
    stack: list[tuple[str, int]] = [("", 0)]
    levels, home, elements = [0], 0, 0
    opened: dict[str, int] = {}
    parts: list[str] = []
    mask = linked = links = 0
    seen_h1 = False

    def flush() -> None:
        nonlocal linked, seen_h1
        text = "".join(parts)
        parts.clear()
        raw, linked_now = len(text), linked
        linked = 0
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if not text:
            return
        bits = (mask & _OWN) | _text_bits(text, min(len(text), linked_now * len(text) // max(1, raw)))
        if mask & _TEXT_ROOTS:
            bits |= _BIT["in text"] | (0 if mask & _OTHER else _BIT["in text, no other name"])
        if mask & _TAG_BIT["h1"]:
            seen_h1 = True
        if seen_h1:
            bits |= _BIT["after h1"]
        texts.append(text)
        homes.append(home)
        feats.append(bits)
        labels.append(1 if mask & _KEEP else 0 if mask & _LEAVE else None)

    def pop(name: str) -> None:
        nonlocal links
        while True:
            top, _ = stack.pop()
            levels.pop()
            opened[top] -= 1
            if top == "a":
                links -= 1
            if top == name:
                return

    def text(piece: str) -> None:
        nonlocal mask, linked, home
        here = stack[-1][1]
        if piece and not here & _SKIP:
            if not parts:
                mask, home = here, levels[-1]
            parts.append(piece)
            linked += len(piece) if links else 0

    pos = 0
    while m := _TOKEN.search(page, pos):
        text(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        inline = name in _INLINE
        if not inline:
            if name == "br":
                if parts:
                    parts.append(" ")
                continue
            if parts:
                flush()
        if m[1]:
            if opened.get(name):
                pop(name)
            continue
        if name in _RAW:
            end = _END[name].search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        if not inline and opened.get("p"):
            k = len(stack) - 1
            while k and (stack[k][0] in _INLINE or stack[k][0] == "p"):
                if stack[k][0] == "p":
                    pop("p")
                    break
                k -= 1
        if name in _IMPLIED:
            ends, walls = _IMPLIED[name]
            if opened.get(ends):
                k = len(stack) - 1
                while k and stack[k][0] not in walls and stack[k][0] != ends:
                    k -= 1
                if stack[k][0] == ends:
                    pop(ends)
        bits = stack[-1][1]
        if name in _SKIPPED:
            bits |= _SKIP
        elif not inline:
            bits |= _TAG_BIT.get(name, 0)
            if m[3]:
                own = _attribute_bits(m[3])
                if own & (_KEEP | _LEAVE):
                    bits &= ~(_KEEP | _LEAVE)
                bits |= own
        if name == "body":  # a head that was left open ends here
            bits &= ~_SKIP
        links += name == "a"
        stack.append((name, bits))
        # paragraphs, headings and list items belong to what holds them
        elements += 1
        levels.append(levels[-1] if inline or name in _LEAVES else elements)
        opened[name] = opened.get(name, 0) + 1
    text(page[pos:])
    if parts:
        flush()
    if feats:
        feats[0] |= _BIT["first"]
        feats[-1] |= _BIT["last"]
        rootless = not any(f & _TEXT_ROOTS for f in feats)
        size: dict[int, int] = {}
        for t, f, h in zip(texts, feats, homes, strict=True):  # the container whose own blocks have most prose
            if f & _PROSE and not f & (_BIT["links many"] | _BIT["links all"]):
                size[h] = size.get(h, 0) + len(t)
        most = max(size, key=size.__getitem__) if size else -1
        for k, (f, h) in enumerate(zip(feats, homes, strict=True)):
            free = not f & _OTHER
            if rootless:
                f |= _BIT["no root"] | (_BIT["no root, no other name"] if free else 0) | (_BIT["no root, prose"] if free and f & _PROSE else 0)
            if h == most:
                f |= _BIT["in most text"] | (_BIT["in most text, no other name"] if free else 0)
            feats[k] = f
    return texts, feats, labels


def _rows(feats: list[int]) -> np.ndarray:
    n = len(FEATURES)
    packed = np.frombuffer(b"".join(f.to_bytes(16, "little") for f in feats), np.uint8).reshape(len(feats), 16)
    return np.unpackbits(packed, axis=1, bitorder="little")[:, :n].astype(float)


@dataclass
class Field:
    """A block's weights for being main text, and the scores of steps between labels."""

    weight: np.ndarray
    step: np.ndarray
    start: np.ndarray


def fit(pages: list[str], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood over whole label sequences of pages with MARK, with a small penalty."""
    got = [(f, y) for _, f, y in map(blocks, pages) if f and None not in y]
    field = Field(np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2))
    if not got:
        return field
    n, t = len(got), max(len(f) for f, _ in got)
    x, y, on = np.zeros((n, t, len(FEATURES))), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (f, labels) in enumerate(got):
        x[i, : len(f)], y[i, : len(f)], on[i, : len(f)] = _rows(f), labels, True
    params = [field.weight, field.step, field.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    both = on[:, 1:]
    for round_ in range(1, rounds + 1):
        own = np.stack([np.zeros((n, t)), x @ field.weight], 2)
        fore, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fore[:, 0] = own[:, 0] + field.start
        for k in range(1, t):
            fore[:, k] = np.where(on[:, k, None], np.logaddexp.reduce(fore[:, k - 1, :, None] + field.step, axis=1) + own[:, k], fore[:, k - 1])
        for k in range(t - 2, -1, -1):
            back[:, k] = np.where(on[:, k + 1, None], np.logaddexp.reduce(field.step + (own[:, k + 1] + back[:, k + 1])[:, None, :], axis=2), 0)
        total = np.logaddexp.reduce(fore[:, -1], axis=1)
        p = np.exp(fore + back - total[:, None, None])
        pair = np.exp(fore[:, :-1, :, None] + field.step + (own + back)[:, 1:, None, :] - total[:, None, None, None])
        hot = np.eye(2)
        real = hot[y[:, :-1]][:, :, :, None] * hot[y[:, 1:]][:, :, None, :]
        miss = ((y - p[:, :, 1]) * on)[:, :, None]
        grads = [(miss * x).sum((0, 1)), ((real - pair) * both[:, :, None, None]).sum((0, 1)), (hot[y[:, 0]] - p[:, 0]).sum(0)]
        for q, g, a, c in zip(params, grads, m, v, strict=True):
            g = g / n - 2e-3 * q
            a += 0.1 * (g - a)
            c += 0.01 * (g * g - c)
            q += 0.15 * (a / (1 - 0.9**round_)) / (np.sqrt(c / (1 - 0.99**round_)) + 1e-8)
    return field


class Extractor:
    """Decodes pages with a field; scores of feature sets are kept."""

    def __init__(self, field: Field) -> None:
        self.field, self.known = field, {}

    def labels(self, feats: list[int]) -> list[int]:
        """Viterbi over the page's blocks; of equal scores, main text loses."""
        if len(self.known) > 200_000:
            self.known.clear()
        known = self.known
        missing = list({f for f in feats if f not in known})
        if missing:
            known.update(zip(missing, (_rows(missing) @ self.field.weight).tolist(), strict=True))
        (s00, s01), (s10, s11) = self.field.step.tolist()
        a, b = self.field.start.tolist()
        b += known[feats[0]]
        came: list[tuple[int, int]] = []
        for f in feats[1:]:
            to0 = 0 if a + s00 >= b + s10 else 1
            to1 = 0 if a + s01 >= b + s11 else 1
            a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + known[f]
            came.append((to0, to1))
        out = [int(b > a)]
        for step in reversed(came):
            out.append(step[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        texts, feats, _ = blocks(page) if page else ([], [], [])
        return " ".join(t for t, y in zip(texts, self.labels(feats), strict=True) if y) if texts else ""


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 5) -> list[str]:
    """Invented pages of many layouts, whose elements say whether they hold main text."""
    rng = random.Random(seed)
    signs = "bcdfglmnprstvaeiouéüñ"

    def word() -> str:
        return "".join(rng.choice(signs) for _ in range(rng.randint(2, 9)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 4, b: int = 18) -> str:
        w = words(a, b).split(" ")
        for i in range(len(w) - 1):
            if rng.random() < 0.12:
                w[i] += ","
        return " ".join(w).capitalize() + rng.choice("....?!")

    def prose(a: int = 1, b: int = 6) -> str:
        kind = rng.random()
        text = " ".join(sentence() for _ in range(rng.randint(a, b)))
        if kind < 0.1:
            text = " ".join(w + rng.choice(("***", "###", "&amp;&amp;", "!!", "%%%")) for w in text.split())
        elif kind < 0.16:
            text = text.upper()
        return text if rng.random() < 0.8 else f"<b>{word()}</b> {text} <a href='/x'>{word()}</a> {word()}."

    def links(a: int = 3, b: int = 8) -> str:
        return "<ul>" + "".join(f"<li><a href='/{word()}'>{words(1, 3)}</a></li>" for _ in range(rng.randint(a, b))) + "</ul>"

    def bad(inner: str, tag: str, names: str) -> str:
        name = rng.choice(names.split()) if names and rng.random() < 0.9 else word()  # a name that says nothing
        attribute = rng.choice((f' class="{name}"', f' id="{name}"')) if names else ""
        return f"<{tag}{attribute} {MARK}=0>{inner}</{tag}>"

    def inner_clutter() -> str:
        return rng.choice(
            (
                lambda: bad(rng.choice((sentence(), prose(1, 3))), rng.choice(("div", "p", "section")), "ad ads advert sponsored promo ad-slot"),
                lambda: bad(links(2, 5), "div", "share social related more-stories"),
                lambda: bad(f"<p>{prose(1, 2)}</p>", "aside", ""),
                lambda: bad(f"<p>{sentence()}</p><input><label>{words(1, 3)}</label>", "form", "newsletter subscribe"),
                lambda: bad(f"<p>{sentence()}</p>", "div", "newsletter related-posts notice"),
            )
        )()

    def comments() -> str:
        return bad(f"<h3>{words(1, 2)}</h3>" + "".join(f"<p>{prose(1, 4)}</p>" for _ in range(rng.randint(1, 6))), rng.choice(("div", "section", "ol")), "comments comment-list replies discussion responses user-comments")

    def body() -> str:
        out = [f"<h1>{words(2, 9).capitalize()}{rng.choice(('', '', '.'))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            k = rng.random()
            out.append(
                f"<p>{prose()}</p>" if k < 0.66
                else f"<p>{rng.choice((word().capitalize() + '.', sentence(1, 3)))}</p>" if k < 0.76
                else f"<h2>{words(1, 5).capitalize()}</h2>" if k < 0.82
                else f"<ul>{''.join(f'<li>{sentence(2, 12)}</li>' for _ in range(rng.randint(1, 4)))}</ul>" if k < 0.87
                else f"<blockquote><p>{prose(1, 2)}</p></blockquote>" if k < 0.91
                else f"<table><tr><td>{word()}</td><td>{words(1, 4)}</td></tr></table>" if k < 0.94
                else f"<pre>{words(3, 12)}</pre>" if k < 0.96
                else inner_clutter()
            )
        return "".join(out)

    def page() -> str:
        before, after = [], []
        nav = lambda: bad(links(), *rng.choice((("nav", ""), ("div", "menu navbar main-nav breadcrumb"), ("ul", "menu tabs"))))
        if rng.random() < 0.5:
            before.append(bad(f"<a href='/'>{words(1, 3)}</a><p>{rng.choice((sentence(), words(2, 4)))}</p>" + (links() if rng.random() < 0.5 else ""), *rng.choice((("header", ""), ("div", "header masthead site-header topbar")))))
        for part, p in ((nav, 0.85), (lambda: bad(rng.choice((sentence(), prose(1, 2))), "div", "ad ads advert banner sponsored"), 0.5), (lambda: bad(f"<p>{prose(1, 2)}</p><button>{word()}</button>", "div", "cookie-notice consent popup notice alert"), 0.25), (lambda: bad(f"<label>{words(1, 3)}</label><input>", "form", "search login"), 0.2)):
            if rng.random() < p:
                before.append(part())
        side = lambda: bad(f"<h3>{words(1, 3)}</h3>" + rng.choice((links(), f"<p>{prose(1, 3)}</p>")), *rng.choice((("aside", ""), ("div", "sidebar widget side rail"))))
        for part, p in ((comments, 0.4), (side, 0.4), (lambda: bad(links(), "div", "related recommended more popular"), 0.25), (lambda: bad(prose(1, 1), "div", "ad promo sponsored"), 0.2), (lambda: bad(f"<p>{sentence()}</p><input>", "form", "newsletter comment-form"), 0.15)):
            if rng.random() < p:
                (after if rng.random() < 0.8 else before).append(part())
        foot = rng.choice((f"&copy; {words(1, 3)} {sentence()}", f"<p>{sentence()}</p>" + links(2, 4), f"<p>&copy; {words(2, 5)}</p>"))
        if rng.random() < 0.9:
            after.append(bad(foot, *rng.choice((("footer", ""), ("div", "footer copyright site-footer bottom")))))
        kind = rng.random()
        if kind > 0.84 and rng.random() < 0.6:  # no element of its own: bare in the body, in a cell beside others, in a nameless part
            inner, layout = body(), rng.random()
            if layout < 0.4:
                return f"<html><body {MARK}=1>{''.join(before)}{inner}{''.join(after)}</body></html>"
            if layout < 0.7:
                cells = [f"<td {MARK}=0>{rng.choice((links(2, 9), words(1, 4), f'<a href=/>{words(1, 2)}</a>'))}</td>", f"<td {MARK}=1>{inner}</td>"]
                if rng.random() < 0.3:
                    cells.append(f"<td {MARK}=0>{links(1, 4)}</td>")
                rows = f"<tr><td colspan=2 {MARK}=0>{words(1, 4)}</td></tr>" if rng.random() < 0.5 else ""
                return f"<html><body {MARK}=0>{''.join(before)}<table>{rows}<tr>{''.join(cells)}</tr></table>{''.join(after)}</body></html>"
            return f"<html><body {MARK}=0>{''.join(before)}<{(tag := rng.choice(('div', 'section', 'center')))} {MARK}=1>{inner}</{tag}>{''.join(after)}</body></html>"
        open_, close = (
            ("<article", "</article>") if kind < 0.42
            else ("<main", "</main>") if kind < 0.56
            else (f'<div class="{rng.choice("content article-body post entry-content story text main-content".split())}"', "</div>") if kind < 0.74
            else (f'<div id="{rng.choice("content main article post".split())}"', "</div>") if kind < 0.84
            else (f'<main {MARK}=0><article', "</article></main>") if kind < 0.88
            else (f'<div class="{word()}"><div id="{word()}"', "</div></div>") if kind < 0.94
            else (rng.choice(("<section", "<div", f'<div class="{word()}"')), None)
        )
        close = close or f"</{open_[1:].split()[0]}>"
        return f"<html><head><title>{words(1, 4)}</title><style>p{{}}</style></head><body {MARK}=0>{''.join(before)}{open_} {MARK}=1>{body()}{close}{''.join(after)}</body></html>"

    return [page() for _ in range(n)]


def extract(pages: DataFrame, field: Field | None = None, html: str = "html") -> DataFrame:
    """Every row of pages with its main text and the text's code points as text and n_chars.

    White space inside a block becomes one space, and the blocks are joined in
    page order by one space. Null and empty pages, and pages without main text,
    give an empty text and 0. Repeated rows give the same text each. An empty
    table gives no rows. The html column is left out; columns named text or
    n_chars are replaced, and all others stay.
    """
    pages = pages.select(F.col(html).cast("string").alias(html), *(c for c in pages.columns if c not in (html, "text", "n_chars")))
    shared = pages.sparkSession.sparkContext.broadcast(field or fit(labelled_pages()))
    schema = StructType([*pages.schema.fields[1:], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(shared.value)
        for rows in batches:
            for lo in range(0, rows.num_rows, 1024):
                part = rows.slice(lo, 1024)
                texts = [extractor.text(cell.as_py()) for cell in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*part.schema.names[1:], "text", "n_chars"])

    return pages.mapInArrow(run, schema)
