"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans to theirs.

The tagger is trained in numpy from spans written into invented contexts in many ways, spelled out or with other separators,
beside numbers, hashes, dates, versions and keys that are no personal data. It reads every character of every text, in overlapping
windows. Where windows overlap, a character's tag is that of the window in which it lies furthest from an edge, and spans are
read from the tags of the whole text. A span is added if the tagger is sure of it, its digits can be of its kind (as many as a number has, a card's with their check digit, an address's below
256) and it touches no span of the patterns; how it is written is not asked.

Defined cases: null text is empty; an empty text has no spans; rows with a null doc_id are kept; rows that share a doc_id are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, mapped_rows

KINDS = ["email", "ip", "card", "phone"]
# The base patterns. A run of digits or of the local part is entered at its start only, so that long runs stay linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return sum(values[::2] + [sum(divmod(2 * v, 10)) for v in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    if not (_DIGITS.search(text) or "@" in text):
        return []
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub(r"[ -]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the tagger ------------------------------------------------------------------------------------------------------

#: Characters of a window in training and of one in reading, and how many at its edges are there for the others' sake.
WINDOW, READ, EDGE = 96, 528, 24
#: Windows that are read together are as many as this, or twice as many, and so on.
BLOCK = 200
HIDDEN, EMBED = 24, 12
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_ALPHABET = " \n@.+-_()[]:/,;='\"#%&*!?|<>{}atdoATDO"
#: How sure the tagger must be of a span, on average over its characters.
SURE = 0.8


def _codes(text: str) -> np.ndarray:
    """0 padding, 1 digit, 2 lower, 3 upper, 4 other letter, 5 else, then one for each character of the alphabet."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _CODE[np.minimum(points, 127)]
    others = np.flatnonzero(points > 127)
    if len(others):
        found, which = np.unique(points[others], return_inverse=True)
        codes[others] = np.array([4 if chr(c).isalpha() else 5 for c in found.tolist()], dtype=np.int8)[which]
    return codes


_CODE = np.array([6 + _ALPHABET.index(chr(i)) if chr(i) in _ALPHABET else 1 if chr(i).isdigit() else 2 if chr(i).islower() else 3 if chr(i).isupper() else 5 for i in range(128)], dtype=np.int8)
N_CODES = 6 + len(_ALPHABET)


def _examples(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags: invented prose with spans of each kind and with what only looks like them."""
    syllables = "an be co den er for ge hi in ka le men no ou pro qui re sta the un ver whi zu é ña ü".split()
    pick = lambda xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    common = "to me us you the and or with from on by is was are as for of in it this that my our his her call mail write reach ask send note see number address card phone fax email server host user paid new old now then please thanks about before after".split()
    said = lambda: (w := word() if rng.random() < 0.5 else pick(common), w.capitalize() if rng.random() < 0.15 else w)[1]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))

    def card() -> str:
        d = str(rng.integers(3, 7)) + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(["", " ", " ", "-", "-", ".", "/", " - ", "_"]).join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = pick([("@", "."), (" @ ", "."), ("(@)", "."), ("[@]", "[.]"), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" AT ", " DOT "), ("{at}", "."), (" (at) ", "."), ("[at]", "."), *[(" at ", " dot ")] * 4, (" @ ", "."), (" @ ", " . "), (" [at] ", " [dot] ")])
        name = f"{word()}{pick(['', '.', '_', '-'])}{pick(['', word()])}{pick(['', '', num(2), num(1)])}"
        return f"{name}{at}{word()}{pick(['', num(1), '-' + word()])}{pick(['', dot + word()])}{dot}{pick(['com', 'org', 'net', 'de', 'io', 'example'])}"

    make = [
        email,
        lambda: pick([".", ".", "[.]", "(.)", " . ", "[dot]", " dot ", "{.}"]).join(str(x) for x in rng.integers(1, 256, 4)),
        card,
        lambda: pick(["+1 ({}) {}-{}", "+{} {} {}", "({}) {}-{}", "({}) {} {}", "00{} {} {}", "+49-{}-{}-{}", "tel: {}-{}-{}", "{}-{}-{}", "{}.{}.{}", "+1.{}.{}.{}", "0{}/{}-{}", "1-{}-{}-{}", "00{} {} {}", "{}-{}-{}", "{}.{}.{}", "({}) {} {}"]).format(num(3), num(3), num(4)),
    ]
    hexes = lambda k: "".join("0123456789abcdef"[d] for d in rng.integers(0, 16, k))
    others = [lambda: hexes(18), lambda: hexes(40), lambda: f"{rng.integers(1, 9)}.{rng.integers(0, 20)}", lambda: str(rng.integers(1800, 2100)), lambda: num(rng.integers(1, 9)), lambda: num(rng.integers(20, 30)), lambda: f"{num(2)}:{num(2)}", lambda: f"2024-{num(2)}-{num(2)}", lambda: "AKIA" + hexes(16).upper(), lambda: f"@{word()}", lambda: f"{num(3)},{num(3)}.{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(1)}", lambda: num(rng.integers(9, 14)), lambda: f"{num(2)}-{num(3)}", lambda: f"{num(4)}/{num(2)}/{num(2)}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}", lambda: f"({num(1)})", lambda: f"${num(2)}.{num(2)}", lambda: "at the " + word(), lambda: "a dot " + word(), lambda: word() + " at " + said(), lambda: f"{num(3)} {num(2)} {num(5)}", lambda: num(4) + " " + num(4), lambda: "ghp_" + hexes(20), lambda: f"{num(1)}.{num(1)}.{num(2)}-{num(1)}"]
    x, y = np.zeros((n, WINDOW), dtype=np.int64), np.zeros((n, WINDOW), dtype=np.int64)
    for i in range(n):
        text, tags = "", []
        # half of them are texts of their own, which begin and end within the window, the others are cut from longer ones
        own = rng.random() < 0.5
        enough = rng.integers(1, WINDOW) if own else 2 * WINDOW
        while len(text) < enough:
            kind = rng.integers(0, 14 if text or not own else 7)  # spans often begin a text
            if kind < 4:
                made = make[kind]()
                skip = len(made) - len(made.removeprefix("tel: "))
                tags += [0] * skip + [1 + 2 * kind] + [2 + 2 * kind] * (len(made) - skip - 1)
            else:
                made = pick(others)() if kind < 8 else said()
                tags += [0] * len(made)
            gap = pick([" ", " ", " ", " ", ", ", ". ", "\n", ": ", "; "])
            text, tags = text + made + gap, tags + [0] * len(gap)
        at = 0 if own else rng.integers(0, WINDOW)
        if own and rng.random() < 0.5:
            text, tags = text.rstrip(), tags[: len(text.rstrip())]
        codes = _codes(text[at : at + WINDOW])
        x[i, : len(codes)] = codes
        y[i, : len(codes)] = tags[at : at + WINDOW]
    return x, y


def _squashed(x):
    """In place of tanh, which takes numpy several times as long."""
    return x / np.sqrt(1 + x * x)


def _gate(x):
    return 0.5 + 0.5 * _squashed(0.5 * x)


def _slope(y):
    """Of _squashed, where it is y."""
    rest = np.maximum(1 - y * y, 0)
    return rest * np.sqrt(rest)


def _gate_slope(g):
    return 0.25 * _slope(2 * g - 1)


class Tagger:
    """Two LSTMs over embedded characters, a linear layer to tag scores, and CRF transitions between neighbouring tags."""

    def __init__(self, rng: np.random.Generator) -> None:
        init = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.p = {"E": rng.standard_normal((N_CODES, EMBED)) * 0.5, "O": init(2 * HIDDEN, TAGS), "o": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"W{d}": init(EMBED + HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        # an I goes only after the B or I of its kind
        self.allowed = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.p["T"], np.float32(-1e4))

    def _lstm(self, e: np.ndarray, d: str):
        w, c0 = self.p[f"W{d}"], self.p[f"c{d}"]
        b, steps, _ = e.shape
        h = c = np.zeros((b, HIDDEN), dtype=np.float32)
        hs, kept = np.zeros((b, steps, HIDDEN), dtype=np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = np.concatenate((e[:, t], h), axis=1)
            a = z @ w + c0
            i, f, o = (_gate(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = _squashed(a[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = _squashed(c)
            h = o * tc
            hs[:, t] = h
            kept.append((t, z, i, f, o, g, before, tc))
        return hs, kept

    def emissions(self, x: np.ndarray, keep: bool = False):
        e = self.p["E"][x]
        (hf, kf), (hb, kb) = self._lstm(e, "f"), self._lstm(e, "b")
        h = np.concatenate((hf, hb), axis=2)
        out = h @ self.p["O"] + self.p["o"]
        return (out, h, kf, kb) if keep else out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        s, h, kf, kb = self.emissions(x, keep=True)
        b, steps, _ = s.shape
        tr = self.transitions()
        lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for t in range(1, steps):
            alpha[:, t] = s[:, t] + lse(alpha[:, t - 1, :, None] + tr, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = lse(tr + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None])
        rows = np.arange(b)
        gold = sum(s[rows, t, y[:, t]] for t in range(steps)) + sum(tr[y[:, t - 1], y[:, t]] for t in range(1, steps))
        ds = marginal.copy()
        for t in range(steps):
            ds[rows, t, y[:, t]] -= 1
        ds /= b
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps):
            g["T"] += np.exp(alpha[:, t - 1, :, None] + tr + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(axis=0) / b
            np.add.at(g["T"], (y[:, t - 1], y[:, t]), -1 / b)
        g["T"] *= self.allowed
        g["O"], g["o"] = np.einsum("bth,btk->hk", h, ds), ds.sum(axis=(0, 1))
        dh = ds @ self.p["O"].T
        de = np.zeros((b, steps, EMBED), dtype=np.float32)
        for d, kept, part in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[:, :, HIDDEN:])):
            w, nh, nc = self.p[f"W{d}"], np.float32(0), np.float32(0)
            for t, zz, i, f, o, gg, before, tc in reversed(kept):
                dht = part[:, t] + nh
                dc = nc + dht * o * _slope(tc)
                da = np.concatenate((dc * gg * _gate_slope(i), dc * before * _gate_slope(f), dht * tc * _gate_slope(o), dc * i * _slope(gg)), axis=1)
                g[f"W{d}"] += zz.T @ da
                g[f"c{d}"] += da.sum(axis=0)
                dz = da @ w.T
                de[:, t] += dz[:, :EMBED]
                nh, nc = dz[:, EMBED:], dc * f
        np.add.at(g["E"], x, de)
        return float((z - gold).mean()), g

    def __getstate__(self) -> dict:
        return {"p": self.p, "allowed": self.allowed}

    def _room(self, name: str, shape: tuple[int, ...]) -> np.ndarray:
        """An array of that shape, in memory that is kept from one call to the next; fresh memory costs much of the time that using it takes."""
        rooms = self.__dict__.setdefault("rooms", {})
        if name not in rooms or rooms[name].size < np.prod(shape):
            rooms[name] = np.empty(np.prod(shape), dtype=np.float32)
        return rooms[name][: np.prod(shape)].reshape(shape)

    def read(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Emissions (steps, TAGS, rows) of rows of codes (steps, rows) of their own lengths, the longest first; beyond a row's end it is O. The next call overwrites them.

        The same as emissions(), without what training keeps: features lie along the first axis, halves and biases are in the weights.
        """
        steps, rows = x.shape
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows longer than t
        out = self._room("read", (steps, TAGS, rows))
        out[:] = 0
        embedded = np.ascontiguousarray(self.p["E"].T)
        half = np.repeat(np.float32([0.5, 0.5, 0.5, 1.0]), HIDDEN)
        for d, o in (("f", self.p["O"][:HIDDEN]), ("b", self.p["O"][HIDDEN:])):
            w = self.p[f"W{d}"]
            # what comes in: h, twice as large as it is, then the embedded character, then 1
            weights = np.zeros((4 * HIDDEN + TAGS, HIDDEN + EMBED + 1), dtype=np.float32)
            weights[: 4 * HIDDEN] = (np.concatenate((w[EMBED:] / 2, w[:EMBED], self.p[f"c{d}"][None])) * half).T
            weights[4 * HIDDEN :, :HIDDEN] = o.T / 2  # the scores of the step before, in the same product
            u, c = np.zeros((HIDDEN + EMBED + 1, 0), dtype=np.float32), np.zeros((HIDDEN, 0), dtype=np.float32)
            last = None
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                n = active[t]
                width = min(rows, -(-n // BLOCK) * BLOCK)
                if width != c.shape[1]:  # arrays of just that width, as numpy is slow with parts of wider ones
                    if last is not None:
                        out[last, :, : active[last]] += weights[4 * HIDDEN :, :HIDDEN] @ u[:HIDDEN, : active[last]]
                        last = None
                    was, u, c = (u, c), np.zeros((len(u), width), dtype=np.float32), np.zeros((HIDDEN, width), dtype=np.float32)
                    for new, old in zip((u, c), was, strict=True):
                        both = min(width, old.shape[1])
                        new[:, :both] = old[:, :both]
                    u[-1] = 1
                    product, b = np.empty((len(weights), width), dtype=np.float32), np.empty((4 * HIDDEN, width), dtype=np.float32)
                    a, said = product[: 4 * HIDDEN], product[4 * HIDDEN :]
                u[HIDDEN:-1] = embedded.take(x[t, :width], axis=1, mode="clip")
                np.matmul(weights, u, out=product)
                if last is not None:
                    out[last, :, : active[last]] += said[:, : active[last]]
                last = t
                np.multiply(a, a, out=b)
                b += 1
                np.sqrt(b, out=b)
                a /= b
                i, f, o2, g = (a[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
                a[: 3 * HIDDEN] += 1  # the gates, twice as large as they are
                c *= f
                i *= g
                c += i
                c *= 0.5
                s = b[:HIDDEN]
                np.multiply(c, c, out=s)
                s += 1
                np.sqrt(s, out=s)
                np.divide(c, s, out=s)
                np.multiply(s, o2, out=u[:HIDDEN])
                u[:HIDDEN, n:] = c[:, n:] = 0
            out[last, :, : active[last]] += weights[4 * HIDDEN :, :HIDDEN] @ u[:HIDDEN, : active[last]]
        out += self.p["o"][:, None]
        for t in np.flatnonzero(active < rows):
            out[t, :, active[t] :] = np.where(np.arange(TAGS) == 0, np.float32(0), np.float32(-1e4))[:, None]
        return out

    def confidence(self, s: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """How probable each of the tags (steps, rows) is, given the emissions s (steps, TAGS, rows)."""
        tr, steps = np.exp(self.transitions()), len(s)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        a, b = np.zeros_like(s), np.ones_like(s)
        a[0] = e[0] / e[0].sum(axis=0)
        for t in range(1, steps):
            a[t] = (tr.T @ a[t - 1]) * e[t]
            a[t] /= a[t].sum(axis=0)
        for t in range(steps - 2, -1, -1):
            b[t] = tr @ (b[t + 1] * e[t + 1])
            b[t] /= b[t].sum(axis=0)
        a *= b
        return np.take_along_axis(a, tags[:, None].astype(np.int64), axis=1)[:, 0] / a.sum(axis=1)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window."""
        return self.decoded(self.emissions(x).transpose(1, 2, 0)).T

    def decoded(self, s: np.ndarray) -> np.ndarray:
        """The best tags (steps, rows) of emissions s (steps, TAGS, rows)."""
        tr, steps, rows = self.transitions(), len(s), s.shape[2]
        free, best = [0, *range(1, TAGS, 2)], self._room("decoded", s.shape)  # all tags go before these, only two before an I
        before, begun, gone_on = np.ascontiguousarray(tr[:, free, None]), tr[range(1, TAGS, 2), range(2, TAGS, 2), None], tr[range(2, TAGS, 2), range(2, TAGS, 2), None]
        every, most = np.empty((TAGS, len(free), rows), dtype=s.dtype), np.empty((len(free), rows), dtype=s.dtype)
        stays = np.empty((steps, rows), dtype=bool)  # whether O comes from O
        best[0] = s[0]
        for t in range(1, steps):
            was, now = best[t - 1], best[t]
            np.add(was[:, None], before, out=every).max(axis=0, out=most)
            now[0], now[1::2] = most[0], most[1:]
            np.equal(most[0], every[0, 0], out=stays[t])
            np.maximum(was[1::2] + begun, was[2::2] + gone_on, out=now[2::2])
            now += s[t]
        tags = np.zeros((steps, rows), dtype=np.int8)
        tags[-1] = best[-1].argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            some = np.flatnonzero((tags[t] > 0) | ~stays[t])
            tags[t - 1, some] = (best[t - 1][:, some] + tr[:, tags[t, some]]).argmax(axis=0)
        return tags


@functools.cache
def trained(examples: int = 12288, epochs: int = 6, seed: int = 3, size: int = 192) -> Tagger:
    """The tagger, trained once in the driver; its size and that of its examples are fixed."""
    rng = np.random.default_rng(seed)
    tagger, (x, y) = Tagger(rng), _examples(examples, rng)
    m, v = ({k: np.zeros_like(p) for k, p in tagger.p.items()} for _ in range(2))
    step, total = 0, epochs * (examples // size)
    for _ in range(epochs):
        order = rng.permutation(examples)
        for at in range(0, examples - size + 1, size):
            some = order[at : at + size]
            _, g = tagger.gradients(x[some], y[some])
            norm = np.sqrt(sum((k * k).sum() for k in g.values()))
            step += 1
            rate = 0.03 * (1 - step / (total + 1))
            for k in g:
                d = g[k] * min(1.0, 5 / norm)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.98 * v[k] + 0.02 * d * d
                tagger.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-8)
    return tagger


def _windows(size: int) -> range:
    """Where windows begin: over the whole of a text of that size. Tags are taken from between a window's edges, and at the text's ends."""
    return range(0, max(1, size - EDGE), READ - 2 * EDGE) if size else range(0)


def _possible(kind: int, text: str) -> bool:
    """Whether the digits can be of the kind, however they are written; an email needs something that stands for its @ and, after that, for its dot."""
    numbers = re.findall(r"[0-9]+", text)
    digits = "".join(numbers)
    if kind == 0:
        return re.search(r"(@|\bat\b).*(\.|\bdot\b)", text, re.I | re.S) is not None
    if kind == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def model_spans(texts: list[str], taken: list[list[tuple[int, int, int]]], tagger: Tagger, batch: int = 3200) -> list[list[tuple[int, int, int]]]:
    """The spans that the tagger adds to those taken. A text is held with three bytes for each of its characters."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def read(i: int) -> None:
        """Spans of one text from the tags of its characters."""
        tags, sure = held.pop(i)
        text, inside = texts[i], np.flatnonzero(tags)
        at = 0
        while at < len(inside):
            start = int(inside[at])
            kind, end = (int(tags[start]) - 1) // 2, start + 1
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            at = int(np.searchsorted(inside, end))
            s, e = start, end
            while e > s and text[e - 1] in " \n.,;:":
                e -= 1
            if tags[start] % 2 and e > s and sure[s:e].mean() >= 100 * SURE and not any(s < b and a < e for a, _, b in taken[i]) and _possible(kind, text[s:e]):
                out[i].append((s, kind, e))

    def tag(some: list[tuple[int, int, np.ndarray]]) -> None:
        """Tags of texts' characters from windows: text, beginning, codes."""
        some.sort(key=lambda window: -len(window[2]))
        lengths = np.array([len(c) for _, _, c in some])
        x = np.zeros((lengths[0], len(some)), dtype=np.int8)
        for k, (_, _, c) in enumerate(some):
            x[: len(c), k] = c
        scores = tagger.read(x, lengths)
        tags = tagger.decoded(scores)
        inside = tags > 0
        inside[:EDGE, [begin > 0 for _, begin, _ in some]] = False
        found = np.flatnonzero(inside[: READ - EDGE].any(axis=0))
        sure = (100 * tagger.confidence(scores[:, :, found], tags[:, found])).astype(np.int8)
        for n, k in enumerate(found.tolist()):
            i, begin, _ = some[k]
            size = len(texts[i])
            if i not in held:
                held[i] = np.zeros(size, np.int8), np.zeros(size, np.int8)
            first, last = EDGE if begin else 0, min(READ - EDGE, size - begin)
            for v, new in zip(held[i], (tags[:, k], sure[:, n]), strict=True):
                v[begin + first : begin + last] = new[first:last]

    waiting: list[tuple[int, int, np.ndarray]] = []
    for i, text in enumerate(texts):
        codes = np.pad(_codes(text), (0, EDGE))
        for begin in _windows(len(text)):
            waiting.append((i, begin, codes[begin : begin + READ]))
            if len(waiting) == batch:
                tag(waiting)
                waiting = []
                for done in [j for j in held if j < i]:
                    read(done)
    if waiting:
        tag(waiting)
    for i in [*held]:
        read(i)
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, spans: all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def read(frames):
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            base = [base_spans(t) for t in texts]
            more = model_spans(texts, base, shared.value)
            counts = {f"n_{name}": [sum(s[1] == k for s in b) for b in base] for k, name in enumerate(KINDS)}
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("string").astype("Int64"), **counts, "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], "spans": [_joined(b + m) for b, m in zip(base, more, strict=True)]})

    # ids as text: a column of whole numbers and nulls would become floats
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, read, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, n_chars being the length of the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def read(found):
        for rows in found:
            given = rows.column("text").to_pylist()
            texts = [t or "" for t in given]
            base = [base_spans(t) for t in texts]
            new = []
            for text, spans in zip(texts, (b + m for b, m in zip(base, model_spans(texts, base, shared.value), strict=True)), strict=True):
                parts, at = [], 0
                for a, k, b in sorted(spans):
                    if b > at:
                        parts += [text[at : max(a, at)], f"[{KINDS[k].upper()}]"] if a >= at else []
                        at = b
                new.append("".join([*parts, text[at:]]))
            made = {"text": [None if o is None else n for o, n in zip(given, new, strict=True)], "n_chars": [len(n) for n in new]}
            columns = [pa.array(made[f.name], f.type) if f.name in made else rows.column(i) for i, f in enumerate(rows.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return mapped_rows(docs, read, docs.schema)
