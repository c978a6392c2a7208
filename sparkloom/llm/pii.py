"""Operator 2: personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field then looks at windows around digits, at-signs and spelled-out at-signs that no
base span covers; windows that meet are one. A candidate is a whole run of up to LONGEST tokens with a type; its features are of the
whole span (lengths of its digit groups, separators, check digit, octets, what precedes it), its score is linear in them, and
a dynamic programme over segment ends picks boundaries and types together, with entities of bounded length. Tokens of base
spans are fixed: no candidate holds one. So found spans overlap neither each other nor base spans. Base spans of different
kinds may overlap, as their rules have it. Weights are learned by the driver from generated, labelled lines (a fixed seed), by
gradients of the conditional likelihood.

Null and empty texts have no spans, an empty table gives no rows. Very long texts are scanned whole, very long windows in pieces that
look ahead; features are computed for STRETCH tokens at a time. Repeated rows are scanned each by itself. Equal segmentations: the one found first. Other columns pass
if kept; one named spans is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, slices, tidy
from .secrets import digest_columns

KINDS = ("email", "ip", "card", "phone", "ssn")
BASE = 4

# The four base rules.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9]*(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind, then start."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        # a match holds an at-sign right after the run of local characters, and begins where that run does
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, begin, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", at + 1)
    for m in DOTTED.finditer(text):
        if text.count(".", m.start(), m.end()) >= 3:
            # the run splits into matches of four numbers each; what is left over can't match
            parts = [(n.start(), n.end()) for n in NUMBER.finditer(text, m.start(), m.end())]
            for i in range(0, len(parts) - 3, 4):
                four = [text[a:b].lstrip("0") for a, b in parts[i : i + 4]]
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in four):
                    out.append((1, parts[i][0], parts[i + 3][1]))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ---------------------------------------------------------------- the field

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
#: Digits or at-signs that may belong to an entity.
TRIGGER = re.compile(r"[0-9]{2,}|@|[\[(]\x20?at\x20?[\])]", re.I)
#: Tokens of an entity at most, and characters of a window on either side of its trigger.
LONGEST, REACH = 12, 36
CUES = {"phone": ("tel", "phone", "call", "mobile", "fax", "cell"), "card": ("card", "visa", "credit", "mastercard"), "ssn": ("ssn", "social", "security"), "email": ("mail", "email", "contact", "write"), "ip": ("ip", "host", "server", "address")}
#: Digit groups that are usual for a type.
GROUPS = {"3-3-4": 0, "3-4": 1, "3-2-4": 2, "4-4-4-4": 3, "4-6-5": 4, "2-2-2-2-2": 5, "4-2-2": 6, "1-3-3-4": 7, "2-2-4": 8}
N_FEATURES = 37
SPELLED = re.compile(r"\(at\)|\[at\]|\( at \)|\[ at \]", re.I | re.A)
DOTS = re.compile(r"(?=( dot |\(dot\)|\[dot\]))", re.I | re.A)
#: Tokens whose candidates' features are computed at once.
STRETCH = 8192
GAP = "\n\n"


def _code(lengths: list[int]) -> int:
    out = 0
    for n in lengths:
        out = out * 32 + min(n, 31)
    return out


GROUP_CODES = {_code([int(x) for x in g.split("-")]): i for g, i in GROUPS.items()}


class Lattice:
    """Tokens of windows, laid end to end with gaps that no entity crosses, and the features of their candidates."""

    def __init__(self, windows: list[str], fixed: list[list[tuple[int, int]]] | None = None):
        """fixed: for each window, spans whose tokens are in no candidate."""
        text = self.text = GAP.join(windows) + GAP
        self.begin = np.concatenate([[0], np.cumsum([len(w) + len(GAP) for w in windows])])[:-1].astype(np.int64)
        found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.a, self.b = np.array(found, np.int64).reshape(-1, 2).T
        n = len(found)
        self.cuts = np.append(np.searchsorted(self.a, self.begin), n)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        alnum, alpha = np.zeros(len(code), bool), np.zeros(len(code), bool)
        for c in np.unique(code).tolist():
            if chr(c).isalnum():
                at = code == c
                alnum |= at
                if chr(c).isalpha():
                    alpha |= at
        self.code, self.alnum = code, alnum
        has = lambda chars: np.isin(code, [ord(c) for c in chars])
        self.count = {k: np.concatenate([[0], np.cumsum(x)]) for k, x in {"-": has("-"), " ": has(" "), ".": has("."), "@": has("@"), "bad": has("\n/:"), "alpha": alpha}.items()}
        self.glued = np.concatenate([[False], alnum | has("-./@_")])  # by the place after the character
        later = np.concatenate([alnum[1:], [False]])
        self.runs_on = alnum | has("@_") | has("-./") & later
        first = code[self.a]
        digit = (first >= 48) & (first <= 57)
        self.opens = (alnum[self.a] | np.isin(first, [40, 43])) if n else digit
        self.closes = alnum[self.a] if n else digit
        length = self.b - self.a
        self.length = np.where(digit, length, 0)
        value = np.zeros(n, np.int64)
        for i in range(3):
            real = digit & (length > i) & (length <= 3)
            value[real] = value[real] * 10 + code[self.a[real] + i] - 48
        self.octet = (digit & (length <= 3) & (value <= 255)).astype(np.int64)
        small = (length <= 2) & (np.isin(first, [64, 65, 97]))
        at_sign = np.zeros(n, bool)
        for i in np.flatnonzero(small).tolist():
            at_sign[i] = text[self.a[i] : self.b[i]] in ("@", "at", "At", "aT", "AT")
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.digits, self.numbers, self.octets, self.ats = sums(self.length), sums(digit), sums(self.octet), sums(at_sign)
        apart = np.zeros(n, np.int64)
        apart[1:] = self.a[1:] - self.b[:-1] > 1
        blocked = np.zeros(n, np.int64)
        for w, spans in enumerate(fixed or []):
            for x, y in spans:
                low, high = np.searchsorted(self.b, self.begin[w] + x, "right"), np.searchsorted(self.a, self.begin[w] + y)
                blocked[low:high] = 1
        self.apart, self.blocked = sums(apart), sums(blocked)
        self.digit = digit
        self.marks = [np.array([(m.start(), m.end()) for m in SPELLED.finditer(text)], np.int64).reshape(-1, 2), np.array([(m.start(1), m.end(1)) for m in DOTS.finditer(text)], np.int64).reshape(-1, 2)]
        lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        self.cues = [[(np.array([m.start() for m in re.finditer(f"(?={w})", lower)], np.int64), len(w)) for w in words] for words in CUES.values()]

    def segments(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates whose first token is low..high - 1, by it, then length: first token and one past the last."""
        first, last = [], []
        n = len(self.a)
        for w in range(1, LONGEST + 1):
            i = np.arange(low, min(high, n - w + 1))
            j = i + w
            good = self.opens[i] & self.closes[j - 1] & (self.apart[j] == self.apart[i + 1]) & (self.blocked[j] == self.blocked[i])
            good &= ((self.numbers[j] > self.numbers[i]) | (self.ats[j] > self.ats[i])) & (self.b[j - 1] - self.a[i] >= 7)
            first.append(i[good])
            last.append(j[good])
        i, j = np.concatenate(first), np.concatenate(last)
        order = np.lexsort((j, i))
        return i[order], j[order]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the whole spans of the candidates."""
        f = np.zeros((len(i), N_FEATURES), np.float32)
        if not len(i):
            return f
        a, b = self.a[i], self.b[j - 1]
        n = {k: c[b] - c[a] for k, c in self.count.items()}
        nd, ng = self.digits[j] - self.digits[i], self.numbers[j] - self.numbers[i]
        rest = b - a - nd
        f[:, 0] = 1
        f[:, 1] = nd == 0
        for k, (x, y) in enumerate(((7, 8), (9, 12), (13, 19), (20, 1 << 40), (1, 6)), 2):
            f[:, k] = (nd >= x) & (nd <= y)
        code, width = np.zeros(len(i), np.int64), j - i
        for w in range(LONGEST):
            at = np.minimum(i + w, len(self.a) - 1)
            code = np.where((w < width) & self.digit[at], code * 32 + np.minimum(self.length[at], 31), code)
        for c, g in GROUP_CODES.items():
            f[:, 7 + g] = code == c
        spelled, dots = (self._within(m[:, 0], m[:, 1], a, b) for m in self.marks)
        f[:, 16] = n["@"] > 0
        f[:, 17] = spelled
        f[:, 18] = (spelled | (n["@"] > 0)) & ((n["."] > 0) | dots)
        f[:, 19] = self.code[a] == 40
        f[:, 20] = self.code[a] == 43
        for k in np.flatnonzero((nd >= 13) & (nd <= 19)).tolist():
            f[k, 21] = luhn(_digits(self.text[a[k] : b[k]]))
        f[:, 22] = (ng == 4) & (rest == 3) & (n["."] == 3) & (self.octets[j] - self.octets[i] == 4)
        f[:, 23] = (rest > 0) & (n["-"] + n[" "] == rest)
        f[:, 24] = (n["."] > 0) & (n["."] + n[" "] == rest)
        f[:, 25] = rest == 0
        f[:, 26] = n["alpha"] > 0
        f[:, 27] = ~self.alnum[b - 1]
        f[:, 28] = ~self.opens[i]
        f[:, 29] = self.glued[a]
        f[:, 30] = self.runs_on[np.minimum(b, len(self.code) - 1)]
        low = np.maximum(a - 24, self.begin[np.searchsorted(self.begin, a, "right") - 1])
        for k, words in enumerate(self.cues):
            for starts, size in words:
                f[:, 31 + k] = np.maximum(f[:, 31 + k], self._within(starts, starts + size, low, a))
        f[:, 36] = n["bad"] > 0
        return f

    @staticmethod
    def _within(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a mark stands in each span; marks are sorted by start, and none holds another."""
        if not len(starts):
            return np.zeros(len(a), bool)
        at = np.searchsorted(starts, a)
        return (at < len(starts)) & (ends[np.minimum(at, len(starts) - 1)] <= b)


class Field:
    """Types 1.. are KINDS; type 0 is a single token outside. weights: of types by features; moves: of types by types."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights.T  # of entities only; a token outside scores 0

    def best(self, text: str) -> list[tuple[int, int, int]]:
        """(kind number, start, end) of the best segmentation's entities."""
        return self.decode(Lattice([text]))[0]

    def decode(self, lattice: Lattice) -> list[list[tuple[int, int, int]]]:
        """(kind number, start, end) of each window's best segmentation's entities."""
        found = self.chosen(lattice)
        out = []
        for w, begin in enumerate(lattice.begin.tolist()):
            own = self._path(lattice, found, int(lattice.cuts[w]), int(lattice.cuts[w + 1]))
            out.append([(y, a - begin, b - begin) for y, a, b in own])
        return out

    def chosen(self, lattice: Lattice) -> dict[int, list[tuple[int, int, float]]]:
        """By first token: (end, type, score) of the candidates that can be in a best segmentation.

        One that can't make up, by its own score and the moves into and out of its type, for leaving its tokens outside is left out.
        """
        moves, out = self.moves, {}
        into = (moves[:, 1:] - moves[:, :1]).max(0)
        on = (moves[1:] - moves[:1]).max(1).clip(0)
        for low in range(0, len(lattice.a), STRETCH):
            i, j = lattice.segments(low, low + STRETCH)
            score = self.scores(lattice.features(i, j))
            k, y = np.nonzero(score + into + on - ((j - i - 1) * moves[0, 0])[:, None] > -1e-3)
            for first, end, kind, s in zip(i[k].tolist(), j[k].tolist(), (y + 1).tolist(), score[k, y].tolist(), strict=True):
                out.setdefault(first, []).append((end, kind, s))
        return out

    def _path(self, lattice: Lattice, found: dict, low: int, high: int) -> list[tuple[int, int, int]]:
        """Dynamic programme over the tokens low..high - 1: values are pushed from each place to the ends of what begins there."""
        if not any(i in found for i in range(low, high)):
            return []
        t, none = len(self.moves), float("-inf")
        moves = self.moves.tolist()
        width, via = bytearray((high - low + 1) * t), bytearray((high - low + 1) * t)
        value: list = [None] * (high - low + 1)
        value[0] = [0.0] + [none] * (t - 1)
        for i in range(high - low):
            v, value[i] = value[i], None
            live = [(x, p) for p, x in enumerate(v) if x > none]
            best, p = max(((x + moves[p][0], -p) for x, p in live))
            after = value[i + 1] = value[i + 1] or [none] * t
            if best > after[0]:
                after[0], width[(i + 1) * t], via[(i + 1) * t] = best, 1, -p
            for end, y, s in found.get(low + i, ()):
                end -= low
                best, p = max(((x + moves[p][y], -p) for x, p in live))
                there = value[end] = value[end] or [none] * t
                if best + s > there[y]:
                    there[y], width[end * t + y], via[end * t + y] = best + s, end - i, -p
        j = high - low
        y = max(range(t), key=lambda k: (value[j][k], -k))
        out = []
        while j:
            step, p = width[j * t + y], via[j * t + y]
            if y:
                out.append((y - 1, int(lattice.a[low + j - step]), int(lattice.b[low + j - 1])))
            j, y = j - step, p
        return out[::-1]

    def gradient(self, n: int, segments: list[tuple[int, int]], features: np.ndarray, truth: list[tuple[int, int]], dw: np.ndarray, dm: np.ndarray) -> float:
        """Adds the gradient of the log-likelihood of one line; truth: (segment's number, type) in order."""
        t = len(self.moves)
        score = self.scores(features)
        into, out = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(segments):
            into[j].append(k)
            out[i].append(k)
        lse = lambda x, axis: (m := x.max(axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))
        low = -1e30
        alpha, beta = np.full((n + 1, t), low), np.full((n + 1, t), low)
        alpha[0, 0], beta[n] = 0, 0
        for j in range(1, n + 1):
            alpha[j, 0] = lse(alpha[j - 1] + self.moves[:, 0], 0)
            if into[j]:
                own = np.array([lse(alpha[segments[k][0]][:, None] + self.moves[:, 1:], 0) + score[k] for k in into[j]])
                alpha[j, 1:] = lse(own, 0)
        for i in range(n - 1, -1, -1):
            ways = [self.moves[:, :1] + beta[i + 1, 0]]
            ways += [self.moves[:, 1:] + (score[k] + beta[segments[k][1], 1:]) for k in out[i]]
            beta[i] = lse(np.concatenate(ways, 1), 1)
        z = lse(alpha[n], 0)
        for j in range(1, n + 1):
            dm[:, 0] -= np.exp(alpha[j - 1] + self.moves[:, 0] + beta[j, 0] - z)
        for k, (i, j) in enumerate(segments):
            p = np.exp(alpha[i][:, None] + self.moves[:, 1:] + score[k] + beta[j, 1:] - z)
            dm[:, 1:] -= p
            dw -= p.sum(0)[:, None] * features[k]
        total, last, at = 0.0, 0, 0
        for k, y in [*truth, (None, 0)]:
            until = n if k is None else segments[k][0]
            for _ in range(at, until):
                total += self.moves[last, 0]
                dm[last, 0] += 1
                last = 0
            if k is not None:
                total += self.moves[last, y + 1] + score[k, y]
                dm[last, y + 1] += 1
                dw[y] += features[k]
                last, at = y + 1, segments[k][1]
        return total - z


def generated(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines with labelled entities among words, dates, prices and versions that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))

    def card() -> str:
        d = pick("4", "5", "3") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)))

    def entity(kind: int) -> str:
        if kind == 0:
            at, dot = pick(("(at)", "."), (" (at) ", " dot "), (" [at] ", " dot "), ("[at]", "[dot]"), (" [at] ", " dot "), (" (at) ", " (dot) "), ("@", "."))
            return word() + pick("", "." + word()) + at + word() + dot + pick("com", "org", "net", "example")
        if kind == 1:
            return ".".join(str(rng.integers(1, 255)) for _ in range(4))
        if kind == 2:
            return card()
        if kind == 3:
            return pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{pick('1', '4')}{num(1)} {num(3)} {num(3)} {num(4)}", f"1-{num(3)}-{num(3)}-{num(4)}")
        return f"{num(3)}-{num(2)}-{num(4)}"

    def other() -> str:
        return pick(f"{pick('19', '20')}{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(1)}.{num(2)}.{num(1)}", f"{num(3)},{num(3)}.{num(2)}", num(rng.integers(2, 12)), f"{num(2)}:{num(2)}:{num(2)}", f"{num(4)}-{num(4)}", f"{num(16)}{pick('a', 'f')}{num(3)}", f"{word()}@{word()}", f"{num(2)}.{num(4)}/{num(5)}", f"{num(3)}-{num(3)}-{num(3)}-{num(3)}", num(21))

    lines = []
    for _ in range(count):
        line, labels = "", []
        for _ in range(rng.integers(1, 4)):
            line += "".join(word() + " " for _ in range(rng.integers(0, 4)))
            if rng.random() < 0.65:
                kind = int(rng.integers(len(KINDS)))
                if rng.random() < 0.4 or kind == 4:
                    line += pick(*CUES[KINDS[kind]]) + pick(" ", ": ")
                s = entity(kind)
                line += (opened := pick("", "", "", "", "("))
                labels.append((kind, len(line), len(line) + len(s)))
                line += s + (")" if opened else "") + pick(" ", ", ", ". ")
            else:
                line += other() + pick(" ", ", ", ". ")
        lines.append((line.strip(), labels))
    return lines


#: Generated lines, passes over them, step and weight decay of the training.
LINES, PASSES, STEP, DECAY = 260, 14, 0.5, 1e-3


def train(lines: int = LINES, passes: int = PASSES, seed: int = 5) -> Field:
    data = []
    for text, labels in generated(lines, seed):
        lattice = Lattice([text])
        i, j = lattice.segments(0, len(lattice.a))
        number = {(int(lattice.a[x]), int(lattice.b[y - 1])): k for k, (x, y) in enumerate(zip(i, j, strict=True))}
        truth = [(number[a, b], y) for y, a, b in labels if (a, b) in number]
        if len(truth) == len(labels) and len(i):
            data.append((len(lattice.a), list(zip(i.tolist(), j.tolist(), strict=True)), lattice.features(i, j).astype(float), truth))
    field = Field(np.zeros((len(KINDS), N_FEATURES)), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))
    squares_w, squares_m = np.full_like(field.weights, 1e-6), np.full_like(field.moves, 1e-6)
    for _ in range(passes):
        for at in range(0, len(data), 16):
            dw, dm = -DECAY * field.weights, -DECAY * field.moves
            for line in data[at : at + 16]:
                field.gradient(*line, dw, dm)
            squares_w += dw**2
            squares_m += dm**2
            field.weights += STEP * dw / np.sqrt(squares_w)
            field.moves += STEP * dm / np.sqrt(squares_m)
    return field


def regions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The windows that the field looks at: around what may belong to an entity and isn't in a base span."""
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else None
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        i = int(np.searchsorted(starts, m.end())) if taken else 0
        if i and int(reach[i - 1]) > m.start():
            continue
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        while a and not text[a - 1].isspace() and a > m.start() - 2 * REACH:
            a -= 1
        while b < len(text) and not text[b].isspace() and b < m.end() + 2 * REACH:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Characters of windows that are put into one lattice. A window of more than LONG is decoded in pieces of so many, each of
#: which looks LAP further: far more than an entity can have, so that what comes after makes no difference in practice.
TOGETHER, LONG, LAP = 1 << 16, 1 << 18, 1 << 11


def pieces(text: str, a: int, b: int, fixed: Callable[[int, int], list[tuple[int, int]]], field: Field) -> Iterator[tuple[int, int, int]]:
    """(kind number, start, end) of the entities in text[a:b], piece by piece; each begins behind the last one's entities, and
    sees what stands before it."""
    first = a
    while a < b:
        cut = min(b, a + LONG)
        until = min(b, cut + LAP)
        low = max(first, a - REACH)
        for kind, i, j in field.decode(Lattice([text[low:until]], [[(0, a - low)] * (a > low) + fixed(low, until)]))[0]:
            if low + i < cut or until == b:
                yield kind, low + i, low + j
                cut = max(cut, low + j)
        if until == b:
            return
        while cut < b and text[cut - 1].isalnum() and text[cut].isalnum():  # not within a token
            cut += 1
        a = cut


def find_all(texts: list[str | None], field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(kind number, start, end, base) of each text, by kind, then start."""
    out = []
    held: list[tuple[int, int, str, list[tuple[int, int]]]] = []
    size = 0

    def work() -> None:
        for (at, a, _, _), found in zip(held, field.decode(Lattice([h[2] for h in held], [h[3] for h in held])), strict=True):
            out[at].extend((kind, a + i, a + j, False) for kind, i, j in found)
        held.clear()

    for at, text in enumerate(texts):
        base = base_spans(text) if text else []
        out.append([(*s, True) for s in base])
        spans = sorted((a, b) for _, a, b in base)
        firsts = [a for a, _ in spans]
        longest = max((b - a for a, b in spans), default=0)

        def fixed(a: int, b: int, spans=spans, firsts=firsts, longest=longest) -> list[tuple[int, int]]:
            near = spans[bisect_left(firsts, a - longest) : bisect_left(firsts, b)]
            return [(x - a, y - a) for x, y in near if y > a]

        for a, b in regions(text, base) if text else ():
            if b - a > LONG:
                out[at].extend((*s, False) for s in pieces(text, a, b, fixed, field))
                continue
            held.append((at, a, text[a:b], fixed(a, b)))
            size += b - a
            if size >= TOGETHER:
                work()
                size = 0
    if held:
        work()
    return [sorted(x, key=lambda s: s[:3]) for x in out]


def find_pii(text: str | None, field: Field) -> list[tuple[int, int, int, bool]]:
    return find_all([text], field)[0]


_fields: dict[int, Field] = {}


def field() -> Field:
    if 0 not in _fields:
        _fields[0] = train()
    return _fields[0]


def scan(docs: DataFrame, keep: list[str], model: Field | None = None) -> DataFrame:
    """Rows of docs: the columns `keep` and spans, an array of (kind, start, end, base), by kind, then start."""
    model = model or field()
    keep = [c for c in keep if c != "spans"]
    kept = "".join(f"`{c}` {t}, " for c, t in docs.select(*[f"`{c}`" for c in keep]).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            for part in slices(batch, "__text"):
                found = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in x] for x in find_all(part.column("__text").to_pylist(), model)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found, kind)], [*keep, "spans"])

    return docs.select(*[f"`{c}`" for c in keep], docs["text"].alias("__text")).mapInArrow(tidy(run), f"{kept}spans array<struct<kind string, start long, end long, base boolean>>")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(scan(read(spark, sf_dir, "documents"), ["doc_id"]), KINDS[:BASE])


QUERIES: dict[str, Callable] = {"op2_pii": op2_pii}
