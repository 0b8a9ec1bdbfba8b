"""Personal data: exact base rules plus a character BiLSTM-CRF trained in numpy.

The base rules find email addresses, IPv4 addresses, card and phone numbers in their strict
written forms.  The tagger adds loosely written ones (a phone number without ``+``, ``1.2.3 .4``,
``a @ b.org``).  It reads fixed overlapping windows of a grid over the text; each window is tagged
by two LSTMs and decoded with CRF transitions, and the windows of a text are reconciled globally:
a span that touches an inner window edge is left to the neighbour that sees it whole, and of
overlapping spans the one with the larger margin stays.

Every span must hold a digit or ``@``.  Windows without either cannot yield a span, so they are not
run; the result is the same as with all windows, which ``every_window=True`` runs.  Training uses
labelled sentences made from templates with a fixed seed, so a model is the same on every run.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import keyed_text, map_batches

KINDS = ("email", "ip", "card", "phone")
LOOSE = "loose_"
T, STRIDE, HIDDEN, BATCH = 96, 48, 24, 1024
_ORDER = {k: n for n, k in enumerate([*KINDS, *(LOOSE + k for k in KINDS)])}

# ---------------------------------------------------------------- base rules

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d)
        if n % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email rule in one pass: each ``@`` is tried once, with all local characters before it."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
        floor = match.end() if match else at + 1
        at = text.find("@", max(floor, at + 1))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of the base rules, by start, then kind; matches that fail their check are dropped."""
    out = [(s, e, "email") for s, e in _emails(text)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], _ORDER[x[2]]))


# ---------------------------------------------------------------- tagger

_SPECIAL = " \n@.-_+()/:,%#='\""
CLASSES = 30 + len(_SPECIAL)
LABELS = 1 + 2 * len(KINDS)


def _class_table() -> np.ndarray:
    table = np.full(129, 28, np.int64)
    for c in range(128):
        ch = chr(c)
        if ch.isalpha():
            table[c] = 1 + ord(ch.lower()) - 97
        elif ch.isdigit():
            table[c] = 27
        elif ch in _SPECIAL:
            table[c] = 30 + _SPECIAL.index(ch)
    table[128] = 29
    return table


_CLASS = _class_table()


def codes(text: str) -> np.ndarray:
    """Character classes 1.. of a text, one for each code point; 0 pads."""
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _legal() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of label pairs and of first labels: an inside label follows its own kind only."""
    pairs = np.zeros((LABELS, LABELS), np.float32)
    for k in range(len(KINDS)):
        pairs[:, 2 + 2 * k] = -1e4
        pairs[1 + 2 * k, 2 + 2 * k] = pairs[2 + 2 * k, 2 + 2 * k] = 0
    return pairs, np.zeros(LABELS, np.float32)


_PAIRS, _FIRST = _legal()


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(table, u, x, keep=False):
    """Hidden states (time first) of windows x (windows x time); keep: what the gradient needs."""
    n, steps = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        g = table[x[:, t]] + h @ u
        s, z = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        before_h, before_c = h, c
        c = f * c + i * z
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            kept.append((before_h, before_c, i, f, o, z, tc))
    return out, kept


def _lstm_back(u, x, kept, dout):
    du, dgs = np.zeros_like(u), np.empty((x.shape[1], x.shape[0], 4 * HIDDEN), np.float32)
    dh = dc = np.zeros((x.shape[0], HIDDEN), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        before_h, before_c, i, f, o, z, tc = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate((dc * z * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - z * z)), 1)
        dgs[t] = dg
        du += before_h.T @ dg
        dh, dc = dg @ u.T, dc * f
    at = x.T.ravel()
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    dtable = np.zeros((CLASSES, 4 * HIDDEN), np.float32)
    dtable[at[order][starts]] = np.add.reduceat(dgs.reshape(-1, 4 * HIDDEN)[order], starts)
    return dtable, du


class Tagger:
    """Weights: input tables and recurrences of both directions, output layer, transitions."""

    NAMES = ("table_f", "table_b", "u_f", "u_b", "w", "b", "trans", "first")

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        r = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.table_f, self.table_b = r(CLASSES, 4 * HIDDEN), r(CLASSES, 4 * HIDDEN)
        self.u_f, self.u_b = r(HIDDEN, 4 * HIDDEN), r(HIDDEN, 4 * HIDDEN)
        self.w, self.b = r(2 * HIDDEN, LABELS), np.zeros(LABELS, np.float32)
        self.trans, self.first = np.zeros((LABELS, LABELS), np.float32), np.zeros(LABELS, np.float32)
        self.b[0] = 1.0

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Label scores, time first; padding is outside for certain."""
        hf, kf = _lstm(self.table_f, self.u_f, x, keep)
        hb, kb = _lstm(self.table_b, self.u_b, x[:, ::-1], keep)
        h = np.concatenate((hf, hb[::-1]), 2)
        e = h @ self.w + self.b
        e[(x == 0).T] = np.array([0] + [-1e4] * (LABELS - 1), np.float32)
        return (e, h, kf, kb) if keep else e

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best label path of each window (windows x time) and its emissions (time first)."""
        e = self.emissions(x)
        steps, n, _ = e.shape
        trans = self.trans + _PAIRS
        best, back = self.first + _FIRST + e[0], np.empty((steps, n, LABELS), np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + trans
            back[t] = s.argmax(1)
            best = s.max(1) + e[t]
        path = np.empty((n, steps), np.int64)
        path[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t, np.arange(n), path[:, t]]
        return path, e

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of label windows y and its gradients."""
        e, h, kf, kb = self.emissions(x, True)
        steps, n, _ = e.shape
        trans, first = (self.trans + _PAIRS).astype(np.float64), (self.first + _FIRST).astype(np.float64)
        # Forward and backward sums as probabilities, scaled to one at each step.
        top = e.max(2).astype(np.float64)
        p, move = np.exp(e - top[:, :, None]), np.exp(trans)
        alpha, beta, scale = np.empty(e.shape), np.ones(e.shape), np.empty((steps, n))
        for t in range(steps):
            a = p[t] * (np.exp(first) if t == 0 else alpha[t - 1] @ move)
            scale[t] = a.sum(1)
            alpha[t] = a / scale[t][:, None]
        for t in range(steps - 2, -1, -1):
            beta[t] = (p[t + 1] * beta[t + 1] / scale[t + 1][:, None]) @ move.T
        z = (np.log(scale) + top).sum(0)
        rows, yt = np.arange(n), y.T
        gold = first[yt[0]] + sum(e[t, rows, yt[t]] for t in range(steps)) + sum(trans[yt[t - 1], yt[t]] for t in range(1, steps))
        de = alpha * beta
        dfirst = de[0].sum(0)
        dtrans = move * np.einsum("tnk,tnl->kl", alpha[:-1], p[1:] * beta[1:] / scale[1:, :, None], optimize=True)
        for t in range(1, steps):
            np.subtract.at(dtrans, (yt[t - 1], yt[t]), 1)
        np.subtract.at(dfirst, yt[0], 1)
        de[np.arange(steps)[:, None], rows[None, :], yt] -= 1
        de[(x == 0).T] = 0
        de = (de / n).astype(np.float32)
        grads = {"w": np.einsum("tnh,tnl->hl", h, de, optimize=True), "b": de.sum((0, 1)), "trans": (dtrans / n).astype(np.float32), "first": (dfirst / n).astype(np.float32)}
        dh = de @ self.w.T
        grads["table_f"], grads["u_f"] = _lstm_back(self.u_f, x, kf, dh[:, :, :HIDDEN])
        grads["table_b"], grads["u_b"] = _lstm_back(self.u_b, x[:, ::-1], kb, dh[::-1, :, HIDDEN:])
        return float((z - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.02, batch: int = 128, seed: int = 4) -> float:
        """Adam; returns the last epoch's mean loss."""
        rng, step, mean = np.random.default_rng(seed), 0, 0.0
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        for epoch in range(epochs):
            losses, order = [], rng.permutation(len(x))
            for at in range(0, len(order), batch):
                now = order[at : at + batch]
                loss, grads = self.loss(x[now], y[now])
                losses.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                pace = rate * (1 - epoch / epochs) + 1e-4
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    setattr(self, k, (getattr(self, k) - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
            mean = float(np.mean(losses))
        return mean


# ---------------------------------------------------------------- labelled sentences


def _luhn_number(rng: random.Random, n: int) -> str:
    body = _digit_word(rng, n - 1)
    return next(body + d for d in "0123456789" if luhn(body + d))


_SYLLABLES = "an th er on re st la ve qu ich de o mi é ka ri jo sm ow bu te ni sch ß pa lu ga no do".split()
_NAMES = "john anna maria peter sales info support kowalska smith jones mueller lee ivanova garcia team billing office".split()
_PLACES = "gmail firma yahoo mail corp uni acme outlook web post example shop".split()
_ENDINGS = "com org net example pl de io fr edu gov co uk ru es info biz".split()


def _digit_word(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _word(rng: random.Random) -> str:
    """A word of syllables, at times a very long one, a first or a place name, or letters in any order."""
    kind = rng.random()
    if kind < 0.4:
        return "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4) if kind < 0.25 else rng.randint(5, 12)))
    if kind < 0.6:
        return rng.choice(_NAMES + _PLACES)
    return "".join(rng.choice("aeiouy") if k % 2 and kind < 0.8 else rng.choice("abcdefghijklmnopqrstuvwxyz") for k in range(rng.randint(2, 10)))


def _value(rng: random.Random, kind: int) -> str:
    """A value of a kind, in its strict or a loose form; kinds below 0 are what is none."""
    word = lambda: _word(rng)
    number = lambda n: _digit_word(rng, n)
    pick = lambda *options: rng.choice(options)
    if kind == 0:
        who, where = word(), word()
        who += pick("", "", "." + word(), "." + word(), number(2), "_" + word(), "-" + word())
        at, dot = pick("@", " @ ", " @ ", "@ ", " @"), pick(".", ".", " . ", " .", ". ")
        return who + at + where + pick("", "", number(1), "-" + word(), dot + word()) + dot + pick(rng.choice(_ENDINGS), rng.choice(_ENDINGS), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 3))))
    if kind == 1:
        return pick(".", ".", " . ", " .", ". ", "[.]").join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        digits, gap = _luhn_number(rng, rng.randint(14, 19)), pick("", " ", "-", ".", "  ", " - ", "/")
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == 3:
        a, b, c = number(3), number(3), number(4)
        body = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b} {c}", f"{a}/{b}-{c}", f"{a}-{b} {c}", f"({a})-{b}-{c}", f"0{a}/{b}{number(2)}-{number(2)}")
        return pick("+1 ", "+49 ", "", "", "", "001 ", "1-", "1 ", "(+1) ") + body
    a, b, c = str(rng.randint(2, 12)), number(2), number(3)
    return pick(
        f"{number(4)}-{b}-{number(2)}", number(rng.randint(1, 8)), f"{b}:{number(2)}", f"{b}.{number(2)}", f"v{a}.{b}.{c}", f"{c},{number(3)}", f'token = "{"".join(rng.choices("0123456789abcdef", k=40))}"',
        number(20), f"@{word()}", f"{word()} @ {b}:{number(2)}", f"#{number(5)}", f"{number(4)} | {c} | {number(4)} | {number(3)}", f"{a}.{number(1)}", f"{number(4)}/{b}/{number(2)}", f"{a} {b} {c}", f"{c}-{number(2)}", f"{word()}@{word()}", f"${a},{c}.{b}", f"({number(4)})",
    )


def _sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made sentence and its labelled spans (start, end, kind); some hold hardly more than one value."""
    word = lambda: _word(rng)
    pick = lambda *options: rng.choice(options)
    text, spans = "", []
    short = rng.random() < 0.25
    for _ in range(rng.randint(1, 2) if short else rng.randint(6, 13)):
        for _ in range(rng.randint(0, 1 if short else 3)):
            text += word() + pick(" ", " ", " ", ", ", ".\n", ": ", " ")
        if rng.random() > 0.6 and not short:
            continue
        kind = rng.choice((-3, -2, -1, 0, 0, 0, 1, 2, 3, 3))
        value = _value(rng, kind)
        if kind >= 0:
            spans.append((len(text), len(text) + len(value), kind))
        text += value + pick(" ", ", ", ". ", "\n", ") ", "; ", " ", "")[: 1 + (rng.random() < 0.5)]
        if text and not text[-1].isspace():
            text += " "
    return (text.rstrip(), spans) if rng.random() < 0.3 else (text, spans)


def labelled_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of classes and labels, cut at random places of made sentences."""
    rng = random.Random(seed)
    x, y = np.zeros((n, T), np.int64), np.zeros((n, T), np.int64)
    for k in range(n):
        text, spans = _sentence(rng)
        labels = np.zeros(len(text), np.int64)
        for s, e, kind in spans:
            labels[s:e] = 2 + 2 * kind
            labels[s] = 1 + 2 * kind
        at = rng.randrange(max(1, len(text) - T // 2))
        part = codes(text)[at : at + T]
        x[k, : len(part)], y[k, : len(part)] = part, labels[at : at + T]
    return x, y


@cache
def trained(windows: int = 7000, epochs: int = 8, seed: int = 11) -> Tagger:
    """The tagger of these parameters, trained once in a process."""
    tagger = Tagger()
    tagger.fit(*labelled_windows(windows, seed), epochs)
    return tagger


# ---------------------------------------------------------------- inference

_EMAIL_FORM = re.compile(r"[^\s@]+\s?@\s?[^\s@]+?\s?\.\s?[^\s@]+\Z")


def plausible(value: str, kind: str) -> bool:
    """Whether a tagged value can be of its kind at all: the numbers behind the loose form must be right."""
    digits = _digits(value)
    if kind == "email":
        return _EMAIL_FORM.match(value) is not None
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and "." in value
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"[+0-9(][0-9() ./-]*[0-9]", value)) and len(re.findall("[0-9]+", value)) >= 3


#: digits of the longest value of a kind
_MOST_DIGITS = {"ip": 12, "card": 19, "phone": 15}


def hopeless(piece: str, kind: str) -> bool:
    """Whether no value of the kind can hold this piece, however the text goes on around it."""
    if kind == "email":
        return piece.count("@") > 1 or sum(c.isspace() for c in piece) > 4
    return sum("0" <= c <= "9" for c in piece) > _MOST_DIGITS[kind]


def _window_spans(path: np.ndarray, e: np.ndarray, column: int, start: int, length: int) -> tuple[list, list]:
    """(margin, start, end, kind) of one decoded window: the whole spans, and those cut by an inner edge."""
    whole, cut, t, row, end = [], [], 0, path, len(path)
    while t < end:
        if row[t] == 0:
            t += 1
            continue
        kind, s = (int(row[t]) - 1) // 2, t
        t += 1
        while t < end and row[t] == 2 + 2 * kind:
            t += 1
        inside = (s > 0 or start == 0) and (t < end or start + end >= length)
        margin = float((e[np.arange(s, t), column, row[s:t]] - e[s:t, column, 0]).mean())
        (whole if inside else cut).append((margin, start + s, start + t, kind))
    return whole, cut


def _anchors(codes: np.ndarray) -> np.ndarray:
    """Places of digits and @; a span has one of them at least."""
    return np.flatnonzero((codes == 27) | (codes == 30 + _SPECIAL.index("@")))


def _decoded(tagger: Tagger, coded: list[np.ndarray], places: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, list, list]]:
    """Each place (text, start, end) with its whole and its cut spans."""
    at = 0
    places = sorted(places, key=lambda p: p[2] - p[1])
    while at < len(places):
        part = places[at : at + BATCH]
        part = [p for k, p in enumerate(part) if k == 0 or (k + 1) * (p[2] - p[1]) <= BATCH * T]
        at += len(part)
        x = np.zeros((len(part), max(b - a for _, a, b in part)), np.int64)
        for n, (r, a, b) in enumerate(part):
            piece = coded[r][a:b]
            x[n, : len(piece)] = piece
        path, e = tagger.decode(x)
        for n in np.flatnonzero(path.any(1)):
            r, a, b = part[n]
            yield r, a, b, *_window_spans(path[n, : b - a], e, n, a, len(coded[r]))


class _Cover:
    """Whether a span lies inside one of some spans."""

    def __init__(self, spans: list[tuple[float, int, int, int]]):
        ordered = sorted((s, e) for _, s, e, _ in spans)
        self.starts, self.ends = [s for s, _ in ordered], list(itertools.accumulate((e for _, e in ordered), max))

    def covers(self, span: tuple[float, int, int, int]) -> bool:
        k = bisect.bisect_right(self.starts, span[1])
        return k > 0 and self.ends[k - 1] >= span[2]


def _grown(regions: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The regions with as much text again on either side, those that then meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, a - (b - a)), min(length, b + (b - a))) for a, b in regions):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def tag_texts(texts: list[str], tagger: Tagger, every_window: bool = False) -> list[list[tuple[int, int, str]]]:
    """Loose spans (start, end, kind) of each text, reconciled over its windows, in order.

    Where all windows cut a span, larger and larger ones are decoded until one holds the whole of it,
    unless the piece seen is already more than a value of its kind can hold.  Time is linear in the text
    but for spans that go on and on.
    """
    coded = [codes(t) for t in texts]
    anchors = [_anchors(c) for c in coded]
    places: list[tuple[int, int, int]] = []
    for r, c in enumerate(coded):
        k = np.arange(-(-len(c) // STRIDE)) if every_window else np.unique(np.concatenate((anchors[r] // STRIDE, anchors[r] // STRIDE - 1)))
        places += [(r, int(s) * STRIDE, int(s) * STRIDE + T) for s in k if s >= 0]
    found: list[list] = [[] for _ in texts]
    cuts: dict[int, list] = {}
    for r, a, b, whole, cut in _decoded(tagger, coded, places):
        found[r] += whole
        cuts.setdefault(r, []).extend((a, b, c) for c in cut)
    while cuts:
        places = []
        for r, cut in cuts.items():
            inside = [_Cover([f for f in found[r] if f[3] == kind]) for kind in range(len(KINDS))]
            # What has no anchor is no span; the windows that see one report the cut as well.
            alone = {(a, b) for a, b, c in cut if not inside[c[3]].covers(c) and np.searchsorted(anchors[r], c[1]) < np.searchsorted(anchors[r], c[2]) and not hopeless(texts[r][c[1] : c[2]], KINDS[c[3]])}
            places += [(r, a, b) for a, b in _grown(sorted(alone), len(coded[r]))]
        cuts, long = {}, {}
        for r, a, b, whole, cut in _decoded(tagger, coded, places):
            for c in whole:
                if c[2] - c[1] >= STRIDE and plausible(texts[r][c[1] : c[2]].strip(" \n.,;:"), KINDS[c[3]]):
                    long.setdefault(r, []).append(c)
            if cut:
                cuts.setdefault(r, []).extend((a, b, c) for c in cut)
        for r, spans in long.items():
            # What a smaller window took for a whole span is a part of one of these.
            cover = _Cover(spans)
            found[r] = [f for f in found[r] if not cover.covers(f)] + spans
    return [_reconciled(text, spans) for text, spans in zip(texts, found)]


class _Taken:
    """Which characters of a text are taken; a test costs the length of the span."""

    def __init__(self, length: int, spans=()):
        self.marks = bytearray(length)
        for s, e, _ in spans:
            self.take(s, e)

    def take(self, s: int, e: int) -> None:
        self.marks[s:e] = b"\1" * (e - s)

    def free(self, s: int, e: int) -> bool:
        return self.marks.find(1, s, e) < 0


def _reconciled(text: str, spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, str]]:
    """Of overlapping candidates the one with the largest margin; only values that are plausible.  Linear in the text."""
    out, taken = [], _Taken(len(text) if spans else 0)
    for _, s, e, kind in sorted(set(spans), key=lambda x: (-round(x[0], 3), x[1], x[2], x[3])):
        while s < e and text[s].isspace():
            s += 1
        while s < e and text[e - 1] in " \n.,;:":
            e -= 1
        value = text[s:e]
        if any(c == "@" or "0" <= c <= "9" for c in value) and taken.free(s, e) and plausible(value, KINDS[kind]):
            taken.take(s, e)
            out.append((s, e, KINDS[kind]))
    return sorted(out)


def find_spans(texts: list[str], tagger: Tagger, every_window: bool = False) -> list[tuple[list, list]]:
    """For each text its base spans and the added loose ones, which overlap no base span and no other."""
    out = []
    for text, tagged in zip(texts, tag_texts(texts, tagger, every_window)):
        base = base_spans(text)
        taken = _Taken(len(text) if tagged else 0, base if tagged else ())
        out.append((base, [(s, e, LOOSE + kind) for s, e, kind in tagged if taken.free(s, e)]))
    return out


_HINT = tv.lut(lambda b: 48 <= b <= 57 or b == 64)


def _candidates(column: pa.Array) -> np.ndarray:
    """Rows with a digit or @; no other row can hold a span of either sort."""
    data, offsets = tv.string_column(column)
    at = np.flatnonzero(_HINT[data]) if len(data) else np.zeros(0, np.int64)
    return np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])


_SPAN = "array<struct<start:int,end:int,kind:string>>"


def personal_data(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text", every_window: bool = False) -> DataFrame:
    """One row per input row: doc_id, base and added spans as arrays of (start, end, kind).

    Offsets are code points, end exclusive.  Null and empty texts have no spans; repeated rows have
    equal spans; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        some = np.ones(batch.num_rows, bool) if every_window else _candidates(batch.column(1))
        base, added = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        rows = np.flatnonzero(some)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            texts = [t or "" for t in batch.column(1).take(pa.array(part)).to_pylist()]
            for r, spans in zip(part, find_spans(texts, shared.value, every_window)):
                base[r], added[r] = ([{"start": s, "end": e, "kind": k} for s, e, k in x] for x in spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    text = keyed_text(docs, id_col, text_col)
    return map_batches(text, run, f"doc_id {dict(text.dtypes)['doc_id']}, base {_SPAN}, added {_SPAN}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (base and added) and n_added."""
    names = F.array(*[F.lit(k) for k in _ORDER])
    ranked = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(ranked)).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, tagger: Tagger | None = None, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; all columns stay, null texts too."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(at)
        rows = np.flatnonzero(_candidates(column))
        if len(rows):
            new, texts = column.to_pylist(), column.take(pa.array(rows)).to_pylist()
            for first in range(0, len(rows), 256):
                part = texts[first : first + 256]
                for r, text, (base, added) in zip(rows[first:], part, find_spans(part, shared.value)):
                    new[r] = replaced(text, base + added)
            column = pa.array(new, column.type)
        yield pa.RecordBatch.from_arrays([column if k == at else batch.column(k) for k in range(batch.num_columns)], schema=batch.schema)

    return map_batches(docs, run, docs.schema)


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans replaced; overlapping ones become one, named after the first."""
    out, cursor = [], 0
    for s, e, kind in sorted(spans):
        if s >= cursor:
            out += (text[cursor:s], f"<{kind.removeprefix(LOOSE).upper()}>")
        cursor = max(cursor, e)
    return "".join(out) + text[cursor:]
