"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers; these
spans always stay. The field labels every token with a digit, an @ or an "(at)"
and finds what patterns can't: numbers written otherwise than the patterns ask,
secrets after their names, and bare later mentions of data named before.
Neighbouring tokens form a chain, and a token is also tied to its last likes
in the document, however far away: equal addresses, equal digits, or digits at
another's end. Ties share one table of potentials, and loopy message passing
makes a document's like tokens agree. The field learns by pseudo-likelihood
from a bounded sample of documents: what patterns find there is labelled, and
entities are planted in copies of them, disguised, mistyped and mentioned again
without their shape, beside harmless numbers of the same look.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, unit_hash

KINDS = ("email", "ip", "card", "phone")
#: What the field can label a token with beside none; only it finds secrets.
LABELS = (*KINDS, "secret")
#: Documents that training may use, and signs of each.
SAMPLE_DOCS, SAMPLE_CHARS = 800, 8000
#: Signs of a training text that its copy with plants has; plants lie between the words of this part.
PLANTED_CHARS = 1500
#: Copies with plants that training makes of each text.
COPIES = 3
#: Rounds of message passing, and the probability that an added span needs.
ROUNDS, SURE = 12, 0.8
#: Hashes of a token's look, and signs of a token that its look is taken from; everything else about a token is taken from all of it.
LOOKS, LOOK_CHARS = 128, 64
#: Signs between neighbours of the chain, at most.
GAP = 3
#: Bytes of text whose graphs are worked on together, unless a single text is longer, and edges or tokens whose tables are in memory at once.
SLICE, STEP = 1 << 20, 1 << 15

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
_RIGHT = re.compile(r"\S*")
_NEXT = re.compile(r"\s*\S*")
_DIGIT = re.compile(r"[0-9]")
_DIGITS, _LETTERS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")
_ALONE = re.compile(r"@|[(\[]at[)\]]", re.I)
_DOTTED = re.compile(r"\s?[A-Za-z0-9-]++\s?(?:\.|[(\[]dot[)\]])\s?[A-Za-z]", re.I)
_HEX = re.compile(r"[0-9a-fA-F]{16}")
_WORD = re.compile(r"[^\W\d_]+\Z")
#: Words that come before a kind of token in the four languages and in code.
CUES = {
    "mail": "mail email write contact kontakt contacto correo courriel",
    "host": "ip host server address addr adresse servidor serveur",
    "card": "card visa mastercard amex karte carte tarjeta kreditkarte",
    "call": "phone tel call mobile fax telefon telefono téléphone teléfono ruf anruf",
    "secret": "token key secret password passwd pwd apikey bearer passwort clave contraseña",
    "count": "version order invoice page item year ticket isbn no nr article licensed license bestellung pedido commande seite página nc",
}
_CUE = {w: k for k, ws in CUES.items() for w in ws.split()}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """Whether the number is at most 255, however many zeros lead it."""
    rest = digits.lstrip("0")
    return len(rest) < 4 and int(rest or "0") < 256


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the e-mail pattern finds, from each @ outwards."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
            at = text.find("@", low)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and start; offsets are code points, ends exclusive."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(x) for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "") if len(m[0]) >= 16 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """The runs without white space that hold a digit or an @; a lone @ or (at) goes with the words beside it."""
    out: list[tuple[int, int]] = []
    pos = 0
    while m := _HIT.search(text, pos):
        at = left = m.start()
        while left > pos and not text[left - 1].isspace():
            left -= 1
        right = _RIGHT.match(text, at).end()
        if _ALONE.fullmatch(text, left, right):
            while left > pos and text[left - 1].isspace():
                left -= 1
            while left > pos and not text[left - 1].isspace():
                left -= 1
            right = _NEXT.match(text, right).end()
        out.append((left, right))
        pos = right
    return out


def _disguised(run: str) -> bool:
    """Whether an address is written with an (at) or with spaces in it. Looked for from each @ or (at) outwards, so that long runs take linear time."""
    for m in _ALONE.finditer(run):
        a = m.start()
        if a and run[a - 1].isspace():
            a -= 1
        if a and run[a - 1] in _LOCAL and _DOTTED.match(run, m.end()):
            return True
    return False


def look(run: str) -> int:
    """A hash of how a run looks: its digits' numbers, letters as one, other signs as they are."""
    return zlib.crc32(_DIGITS.sub(lambda m: str(min(9, len(m[0]))), _LETTERS.sub("a", run[:LOOK_CHARS])).encode("utf-8", "replace")) % LOOKS


FEATURES = (
    "any", "at", "address", "obfuscated", "letters", "plus", "bracket", "dash", "quote", "equals", "dots 1", "dots 2", "dots 3", "four parts", "four bytes", "byte", "zeros",
    "digits 1", "digits 2", "digits 3", "digits 4", "digits 5-6", "digits 7-8", "digits 9-12", "digits 13-15", "digits 16-19", "digits 20", "luhn", "hex", "mixed",
    "after near", "before near", "after plus", "after bracket", "before dash", "near dot", "is after =", *(f"cue {k}" for k in CUES), *(f"cue before {k}" for k in CUES), *(f"look {k}" for k in range(LOOKS)),
)
_AT = {f: i for i, f in enumerate(FEATURES)}
#: Shapes that training hides on a share of tied tokens, so that ties have to tell.
_SHAPES = [_AT[f] for f in ("address", "obfuscated", "plus", "four parts", "four bytes", "luhn", "hex", "mixed", "after plus", "after bracket", "is after =")] + [i for f, i in _AT.items() if f.startswith(("cue", "look"))]


def _digits_name(n: int) -> str:
    return f"digits {n}" if n < 5 else "digits 5-6" if n < 7 else "digits 7-8" if n < 9 else "digits 9-12" if n < 13 else "digits 13-15" if n < 16 else "digits 16-19" if n < 20 else "digits 20"


def _likes(w: str, digits: str) -> tuple[list[str], list[str]]:
    """Under which names a token looks for an earlier like, and under which it is found later."""
    if "@" in w and (found := [w[a:b].lower() for a, b in _emails(w)]):
        return found, found
    bare = w.strip("\"'=,;.!?#").lower()
    if len(digits) >= 7:
        own = ["t" + bare] if len(bare) >= 16 and len(digits) < len(bare) else []
        return [*own, "7" + digits[-7:]], [*own, "7" + digits[-7:], "4" + digits[-4:]]
    if len(digits) >= 4:
        return ["4" + digits[-4:]], ["4" + digits[-4:]]
    return [], []


def describe(text: str) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """A document's tokens, their features, its chain's edges and its ties."""
    spans = tokens(text)
    x = np.zeros((len(spans), len(FEATURES)), np.uint8)
    chain: list[tuple[int, int]] = []
    ties: list[tuple[int, int]] = []
    last: dict[str, tuple[int, int]] = {}
    words = [text[a:b] for a, b in spans]
    for i, w in enumerate(words):
        digits = "".join(c for c in w if "0" <= c <= "9")
        dots = min(3, w.count("."))
        has = {"any", f"look {look(w)}", "at" if "@" in w else "any", "plus" if "+" in w else "any", "bracket" if "(" in w or ")" in w else "any", "dash" if "-" in w else "any", "quote" if '"' in w or "'" in w else "any", "equals" if "=" in w else "any"}
        if dots:
            has.add(f"dots {dots}")
        if digits:
            has.add(_digits_name(len(digits)))
            if w == digits and len(digits) < 4 and int(digits) < 256:
                has.add("byte")
            if digits.startswith("00"):
                has.add("zeros")
        if "@" in w and next(_emails(w), None):
            has.add("address")
        elif _disguised(w):
            has.add("obfuscated")
        if any(c.isalpha() for c in w):
            has.add("letters")
            if len(w) >= 16 and 4 * sum(c.isalnum() for c in w) > 3 * len(w) and len(digits) >= 3:
                has.add("mixed")
        if dots == 3 and (m := _IP.search(w)):
            has.add("four parts")
            if all(len(p) < 4 and int(p) < 256 for p in m[0].split(".")):
                has.add("four bytes")
        if 16 <= len(digits) <= 19 and luhn(digits):
            has.add("luhn")
        if len(w) >= 16 and len(digits) < len(w) and _HEX.search(w):
            has.add("hex")
        start = spans[i][0]
        if i and start - spans[i - 1][1] <= GAP:
            chain.append((i - 1, i))
            has.add("after near")
            x[i - 1, _AT["before near"]] = 1
            if "+" in words[i - 1]:
                has.add("after plus")
            if "(" in words[i - 1]:
                has.add("after bracket")
            if "-" in w:
                x[i - 1, _AT["before dash"]] = 1
            if "." in text[spans[i - 1][1] : start]:
                has.add("near dot")
                x[i - 1, _AT["near dot"]] = 1
        ahead = text[max(0, start - 60) : start].rstrip()
        if ahead[-1:] in ("=", ":"):
            has.add("is after =")
            ahead = ahead[:-1].rstrip()
        for name, part in (("cue", ahead.rstrip(" .:=#(\"'")), ("cue before", None)):
            if part is None:
                part = rest.rstrip(" .:=#(\"'-")
            m = _WORD.search(part)
            if m and (k := _CUE.get(m[0].lower())):
                has.add(f"{name} {k}")
            rest = part[: m.start()] if m else ""
        inside = re.match(r"[^\W\d_]+(?=[=:])", w)
        if inside and (k := _CUE.get(inside[0].lower())):
            has |= {f"cue {k}", "is after ="}
        for f in has:
            x[i, _AT[f]] = 1
        sought, known = _likes(w, digits)
        # tied to the first and the last like: all mentions share potentials over two ties at most
        for b in {met for k in sought if k in last for met in last[k]}:
            if (b, i) not in chain[-1:]:
                ties.append((b, i))
        for k in known:
            last[k] = (last[k][0] if k in last else i, i)
    return spans, x, chain, ties


# --- training texts ---------------------------------------------------------


def _number(rng: np.random.Generator, n: int) -> str:
    return str(rng.integers(1, 10)) + "".join(map(str, rng.integers(0, 10, n - 1)))


def _grouped(digits: str, sizes: tuple[int, ...], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(x for x in out if x)


def entity(rng: np.random.Generator) -> tuple[str, str, str, str]:
    """A made-up entity that the patterns can't find: kind, words before it, its text, and a bare later mention ('' for none)."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    cue = lambda k: pick(CUES[k].split()) + pick((" ", ": ", " = ", " no. " if k in ("card", "call") else ": "))
    sure = rng.random() < 0.7
    kind = LABELS[rng.integers(len(LABELS))]
    if kind == "email":
        name, host = pick(("jo", "ann", "kim", "lee", "max")) + "." + pick(("berg", "diaz", "roux", "hill")) + _number(rng, 2), "mail" + _number(rng, 1) + "." + pick(("example.com", "example.org", "test.net"))
        text = pick((f"{name} (at) {host}", f"{name}[at]{host}", f"{name} @ {host}", f"{name}(at){host}", f"{name} [at] {host}"))
        return kind, cue("mail") if sure else "", text, ""
    if kind == "ip":
        parts = [str(x) for x in rng.integers(1, 255, 4)]
        return kind, cue("host"), pick((" . ", " .", "-")).join(parts), ""
    if kind == "card":
        d = _number(rng, 16)
        text = pick((_grouped(d, (4, 4, 4, 4), "."), _grouped(d, (4, 4, 4, 4), "/"), _grouped(d, (4, 6, 5), "-"), _grouped(d, (4, 4, 4, 4), " ")))
        return kind, cue("card"), text, d if rng.random() < 0.5 else d[-4:]
    if kind == "phone":
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        text = pick((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{_number(rng, 2)} {a} {b}{c}", f"0{a}/{b}{c}", f"{a}.{b}.{c}"))
        return kind, cue("call"), text, pick((f"{b}{c}", f"{a}-{b}-{c}"))
    size = int(rng.integers(20, 48))
    signs = pick(("0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    text = "".join(signs[k] for k in rng.integers(0, len(signs), size))
    if not _DIGIT.search(text[:-1]):
        text = text[:-1] + "7"
    quote = pick(('"', "'", ""))
    name = pick(CUES["secret"].split())
    return kind, name + pick((" = ", "=", ": ")) + quote, text, text if rng.random() < 0.4 else ""


def harmless(rng: np.random.Generator) -> str:
    """A number of a similar look that is nothing personal."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    before = pick(("", "", "", *(w + " " for w in CUES["count"].split())))
    d = _number(rng, int(rng.integers(1, 17)))
    commit = "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 40))
    shape = pick((d, d, d, f"{d}.", f"{rng.integers(1, 9)}.{rng.integers(0, 20)}", f"{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{_number(rng, 2)},{_number(rng, 3)}", f"{_number(rng, 2)}%", f"({_number(rng, 4)})", f"commit {commit}", f"{_number(rng, 3)}-{_number(rng, 2)}", f"{_number(rng, 16)}", _grouped(_number(rng, 12), (3, 3, 3, 3), " "), f"@{pick(('home', 'work'))}{_number(rng, 2)}"))
    return before + shape


def planted(text: str, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with entities and harmless numbers put between its words, and the entities' spans."""
    words = text.split(" ")
    pieces: list[tuple[str, str, str]] = []  # kind, text before, text
    for _ in range(rng.integers(1, 4)):
        kind, before, body, again = entity(rng)
        pieces.append((kind, before, body))
        if again:
            pieces += [(kind, "", again)] * int(rng.integers(1, 3))
    for _ in range(rng.integers(1, 5)):
        h = harmless(rng)
        pieces += [("", "", h)] * (1 + int(rng.random() < 0.3))
    cuts = np.sort(rng.integers(0, len(words) + 1, len(pieces)))
    firsts = [k for k in range(len(pieces)) if pieces[k][0]]
    others = [k for k in range(len(pieces)) if not pieces[k][0]]
    order = sorted(firsts + others, key=lambda k: (rng.random() if not pieces[k][0] else k / max(1, len(firsts))))
    out, spans, at, length = [], [], 0, 0
    for k, c in zip(order, cuts.tolist(), strict=True):
        part = " ".join(words[at:c])
        at = c
        kind, before, body = pieces[k]
        lead = (part + " " if part else "") + before
        out.append(lead + body)
        if kind:
            spans.append((kind, length + len(lead), length + len(lead) + len(body)))
        length += len(lead) + len(body)
        tail = '"' if before.endswith('"') else "'" if before.endswith("'") else ""
        out.append(tail + " ")
        length += len(tail) + 1
    return "".join(out) + " ".join(words[at:]), spans


def examples(texts: list[str], seed: int = 5) -> list[tuple[np.ndarray, list, list, np.ndarray, np.ndarray]]:
    """Features, chain, ties, labels and weights of each text and of its copies with plants."""
    rng = np.random.default_rng(seed)
    out = []
    for text in texts:
        for copy, spans in ((text, []), *(planted(text[:PLANTED_CHARS], rng) for _ in range(COPIES))):
            at, x, chain, ties = describe(copy)
            if not at:
                continue
            y = _labels(at, [*spans, *base_spans(copy)])
            # what looks like a secret in the text itself may be one: it teaches nothing
            own = _labels(at, spans) > 0
            weight = np.where((x[:, _AT["mixed"]] > 0) & (y == 0) & (x[:, _AT["is after ="]] > 0), 0.0, 1.0)
            tied = np.zeros(len(at), bool)
            for a, b in ties:
                tied[a] = tied[b] = True
            hide = tied & own & (rng.random(len(at)) < 0.3)
            x[np.ix_(hide, _SHAPES)] = 0
            out.append((x, chain, ties, y, weight))
    return out


@dataclass
class Field:
    """Weights of features, of neighbours and of ties; label 0 is none."""

    weight: np.ndarray
    near: np.ndarray
    tied: np.ndarray


def fit(docs: list[tuple[np.ndarray, list, list, np.ndarray, np.ndarray]]) -> Field:
    """Maximise the pseudo-likelihood of labelled documents, with a small penalty."""
    k, f = len(LABELS) + 1, len(FEATURES)
    field = Field(np.zeros((f, k)), np.zeros((k, k)), np.zeros((k, k)))
    if not docs:
        return field
    x = np.concatenate([d[0] for d in docs]).astype(np.float32)
    y = np.concatenate([d[3] for d in docs])
    weight = np.concatenate([d[4] for d in docs])[:, None]
    shift = np.cumsum([0, *(len(d[3]) for d in docs)])
    near = np.array([(a + s, b + s) for d, s in zip(docs, shift, strict=False) for a, b in d[1]], int).reshape(-1, 2)
    tied = np.array([(a + s, b + s) for d, s in zip(docs, shift, strict=False) for a, b in d[2]], int).reshape(-1, 2)
    hot = np.eye(k)[y]
    params = [field.weight, field.near, field.tied]
    moment = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    for step in range(1, 251):
        score = (x @ field.weight.astype(np.float32)).astype(float)
        for table, edges in ((field.near, near), (field.tied, tied)):
            np.add.at(score, edges[:, 0], table[:, y[edges[:, 1]]].T)
            np.add.at(score, edges[:, 1], table[y[edges[:, 0]]])
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = (hot - p) * weight / len(y)
        grads = [x.T @ miss.astype(np.float32)]
        for edges in (near, tied):
            g = np.zeros((k, k))
            np.add.at(g.T, y[edges[:, 1]], miss[edges[:, 0]])
            np.add.at(g, y[edges[:, 0]], miss[edges[:, 1]])
            grads.append(g)
        for q, g, m, v in zip(params, grads, moment, square, strict=True):
            g = g - 2e-5 * q
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return field


def marginals(field: Field, x: np.ndarray, near: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Every token's label probabilities, by damped sum-product message passing on all edges at once.

    Edges go through their tables STEP at a time, so that memory is a few numbers an edge and label.
    """
    parts = [(field.near, near[:, 0], near[:, 1]), (field.near.T, near[:, 1], near[:, 0]), (field.tied, tied[:, 0], tied[:, 1]), (field.tied.T, tied[:, 1], tied[:, 0])]
    own = np.concatenate([x[lo : lo + STEP].astype(float) @ field.weight for lo in range(0, len(x), STEP)] or [np.zeros((0, field.weight.shape[1]))])
    own -= own.max(1, keepdims=True) if len(own) else 0
    message = [np.zeros((len(src), own.shape[1])) for _, src, _ in parts]
    total = own.copy()
    for _ in range(ROUNDS if len(near) or len(tied) else 0):
        after = []
        for k, (table, src, _) in enumerate(parts):
            back = message[k ^ 1]  # the same edges the other way
            new = np.empty_like(message[k])
            for lo in range(0, len(src), STEP):
                at = slice(lo, lo + STEP)
                out = (total[src[at]] - back[at])[:, :, None] + table
                top = out.max(1, keepdims=True)
                got = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                new[at] = 0.5 * message[k][at] + 0.5 * (got - got.max(1, keepdims=True))
            after.append(new)
        message, total = after, own.copy()
        for m, (_, _, dst) in zip(message, parts, strict=True):
            np.add.at(total, dst, m)
    p = np.exp(total - total.max(1, keepdims=True)) if len(total) else total
    return p / p.sum(1, keepdims=True)


def _labels(spans: list[tuple[int, int]], base: list[Span]) -> np.ndarray:
    """Each token's label: the kind of a span that overlaps it, else none."""
    y = np.zeros(len(spans), int)
    ends = np.array([b for _, b in spans])
    for kind, a, b in base:
        i = int(np.searchsorted(ends, a, side="right"))
        while i < len(spans) and spans[i][0] < b:
            y[i] = y[i] or 1 + LABELS.index(kind)
            i += 1
    return y


def _added(text: str, spans: list[tuple[int, int]], chain: list[tuple[int, int]], p: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of sure tokens that no base span touches; neighbours of one kind are one span."""
    taken = _labels(spans, base) > 0
    best = p.argmax(1)
    linked = {b for _, b in chain}
    out: list[Span] = []
    last = -2
    for i in np.flatnonzero((best > 0) & (p.max(1) >= SURE) & ~taken).tolist():
        a, b = spans[i]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a == b:
            continue
        kind = LABELS[best[i] - 1]
        if kind == "secret" and (m := re.match(r"[^\W\d_]+[=:]\W?", text[a:b])):
            a += m.end()  # its name stands in the same run
        if out and last == i - 1 and i in linked and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
        last = i
    return out


def find(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """Every text's spans as (kind, start, end, base), by kind and start."""
    base = [base_spans(t) if t else [] for t in texts]
    seen = [(i, t, *describe(t)) for i, t in enumerate(texts) if t and _HIT.search(t)]
    if seen:
        shift = np.cumsum([0, *(len(s[2]) for s in seen)])
        near = np.array([(a + d, b + d) for s, d in zip(seen, shift, strict=False) for a, b in s[4]], int).reshape(-1, 2)
        tied = np.array([(a + d, b + d) for s, d in zip(seen, shift, strict=False) for a, b in s[5]], int).reshape(-1, 2)
        p = marginals(field, np.concatenate([s[3] for s in seen]), near, tied)
        for (i, t, spans, _, chain, _), a, b in zip(seen, shift, shift[1:], strict=False):
            base[i] = [(*s, True) for s in base[i]] + [(*s, False) for s in _added(t, spans, chain, p[a:b], base[i])]
    order = {k: i for i, k in enumerate(LABELS)}
    return [sorted(((s if len(s) == 4 else (*s, True)) for s in found), key=lambda s: (order[s[0]], s[1], s[2])) for found in base]


def learn(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Field:
    """Fit the field on about `sample` documents with tokens in question, those of the least hashes, and on plants in them."""
    hits = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]")).withColumn("h", unit_hash(F.col("text"), 3))
    share = 1.5 * sample / max(1, hits.count())
    rows = hits.filter(F.col("h") < share).dropDuplicates(["h"]).select("h", F.substring("text", 1, SAMPLE_CHARS)).limit(4 * sample).collect()
    return fit(examples([r[1] for r in sorted(rows)[:sample]]))


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id and its spans, by kind and start.

    base is true for the patterns' spans; kinds are those of LABELS. Null, empty
    and harmless texts have no spans. Repeated rows get the same spans each. An
    empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in by_bytes(rows, 1, SLICE):
                found = find(part.column(1).to_pylist(), shared.value)
                cells = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, _SPAN_TYPE)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; a column n_chars is counted anew.

    Overlapping spans go as one, under the kind of the earliest, and of two that
    start together the longer. All other columns and all rows stay; null texts stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or learn(docs.select(F.col(text).alias("text"))))
    at = docs.columns.index(text)
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[str | None] = []
            for part in by_bytes(rows, at, SLICE):
                texts = part.column(at).to_pylist()
                for t, found in zip(texts, find(texts, shared.value), strict=True):
                    parts, pos = [], 0
                    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
                        if a >= pos:
                            parts += [t[pos:a], f"<{kind}>"]
                        pos = max(pos, b)
                    out.append("".join([*parts, t[pos:]]) if parts else t)
            cols = list(rows.columns)
            cols[at] = pa.array(out, rows.schema.field(at).type)
            if count is not None:
                cols[count] = pa.array([None if t is None else len(t) for t in out], rows.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, names=rows.schema.names)

    return docs.mapInArrow(run, docs.schema)
