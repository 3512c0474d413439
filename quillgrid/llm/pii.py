"""Personal data: fixed patterns, and a semi-Markov conditional random field for spans that they miss.

Base spans follow the patterns exactly (leftmost, non-overlapping for each kind, failing matches dropped).
Where a stretch of number-like or address-like chunks holds more than the base spans explain, a semi-Markov
CRF reads the whole stretch, however long: features of whole candidate spans (shape, digit counts, check digit,
octet range, neighbours) score (span, kind), and dynamic programming over spans of at most LONGEST tokens chooses
boundaries and kinds jointly. A candidate holds one @, or no letter and either 7 to 19 digits or three dots. The
field is trained here by conditional likelihood on generated stretches. Its spans are added where they overlap no base
span.

Defined results: a null or empty text has no spans (the digest is that of an empty string); offsets are code
points, the end exclusive; rows that repeat get equal results; of equally good segmentations the first found counts;
patterns and stretches cost linear time in the text; an empty table gives an empty result; input columns that are named
like an added one get ``_input`` added to their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import deque
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.shared import clear_of, small_batches

KINDS = ["email", "ip", "card", "phone"]
#: Most tokens of an entity, and least and most digits of one without an @ or three dots.
LONGEST, LEAST_DIGITS, MOST_DIGITS = 16, 7, 19
EXAMPLES, EPOCHS, RATE, PENALTY = 160, 25, 0.5, 1e-3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TELLING = re.compile(r"[0-9@]")
#: Words with a digit or @, and those after them by one space that may go on with them; starts at words alone, for linear time.
_STRETCH = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@(+]*+[0-9@(+]\S*+)*+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
_OUTSIDE = re.compile(r"[0-9]{7}|@|[0-9](?:[ ().-]{1,2}[0-9]+){2}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the patterns, by kind as listed, then start."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
    if _TELLING.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _digits(m[0])
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_SHAPES = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\Z"),
    re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}\Z"),
    re.compile(r"[0-9]{4}([ -]?[0-9]{4}){3}\Z|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}\Z|[0-9]{13,19}\Z"),
    re.compile(r"\+[0-9]{1,3}[ .-]?(\([0-9]{1,4}\)|[0-9]{1,4})([ .-]?[0-9]{2,4}){2,4}\Z"),
    re.compile(r"(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\Z"),
    re.compile(r"00[0-9]{1,3}[ .-]?[0-9]{2,4}([ .-]?[0-9]{2,4}){2,3}\Z"),
]
_SIZES = [(0, 3), (4, 6), (7, 8), (9, 10), (11, 12), (13, 15), (16, 16), (17, 19), (20, 10**6)]


def span_features(text: str, start: int, end: int) -> list[float]:
    """Features of a whole candidate span in its text."""
    s = text[start:end]
    d = _digits(s)
    before, after = text[start - 1 : start], text[end : end + 1]
    shapes = [float(bool(p.match(s))) for p in _SHAPES]
    sizes = [float(lo <= len(d) <= hi) for lo, hi in _SIZES]
    return [
        1.0, *shapes, *sizes, float(13 <= len(d) <= 19 and luhn(d)), float(s.count("@") == 1), float("@" in s and not shapes[0]), float(s[0] == "+"), float("(" in s), float(s.count("(") != s.count(")")),
        float(any(c.isalpha() for c in s)), float(" " in s), float(s[0] in " .,;:-)/" or s[-1] in " .,;:-(/@"), float(not before or before in " \t\n,;:(/\"'"), float(not after or after in " \t\n,;:.)!?/\"'"),
        float(before.isalnum()), float(after.isalnum()), float(shapes[1] and octets(s)),
    ]


class Tokens:
    """Tokens of a stretch, and how many digits, letters, @ and dots lie before each."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.spans: list[tuple[int, int]] = []
        self.before: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)]
        digits = letters = ats = dots = 0
        for m in _TOKEN.finditer(text, start, end):
            c = text[m.start()]
            if "0" <= c <= "9":
                digits += m.end() - m.start()
            elif c in "@.":
                ats, dots = ats + (c == "@"), dots + (c == ".")
            elif "a" <= c <= "z" or "A" <= c <= "Z":
                letters += 1
            self.spans.append(m.span())
            self.before.append((digits, letters, ats, dots))

    def starts(self, j: int) -> list[int]:
        """First tokens of the candidate spans that end with token j."""
        text, spans, before = self.text, self.spans, self.before
        if not text[spans[j][0]].isalnum():
            return []
        low, (d, n, a, o) = max(0, j - LONGEST + 1), before[j + 1]
        if d - before[low][0] < 4 and a == before[low][2]:
            return []
        out = []
        for i in range(low, j + 1):
            digits, letters, ats, dots = before[i]
            if a - ats == 1 or n == letters and a == ats and (LEAST_DIGITS <= d - digits <= MOST_DIGITS or o - dots == 3 and d - digits >= 4):
                first = text[spans[i][0]]
                if first.isalnum() or first in "+(":
                    out.append(i)
        return out


class Lattice:
    """Candidate spans of a stretch: for each end token the starts with their features."""

    def __init__(self, text: str, start: int, end: int):
        tokens = Tokens(text, start, end)
        self.tokens, self.n = tokens.spans, len(tokens.spans)
        self.starts: list[np.ndarray] = []
        self.x: list[np.ndarray] = []
        for j in range(self.n):
            own = tokens.starts(j)
            x = [span_features(text, self.tokens[i][0], self.tokens[j][1]) for i in own]
            self.starts.append(np.array(own, dtype=np.int64))
            self.x.append(np.array(x, dtype=float).reshape(len(own), -1) if own else np.zeros((0, WIDTH)))


WIDTH = len(span_features("0", 0, 1))
TYPES = len(KINDS) + 1  # the first is outside


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def likelihood(lat: Lattice, w: np.ndarray, t: np.ndarray, gold: list[tuple[int, int, int]]):
    """Log-likelihood of a gold segmentation [(first, last, type)] and its gradients."""
    n = lat.n
    alpha = np.full((n + 1, TYPES), -np.inf)
    alpha[0, 0] = 0.0
    scores = [x @ w for x in lat.x]
    for j in range(n):
        alpha[j + 1, 0] = _lse(alpha[j] + t[:, 0], 0)
        if len(s := lat.starts[j]):
            into = _lse(alpha[s][:, :, None] + t[None, :, 1:], 1)
            alpha[j + 1, 1:] = _lse(into + scores[j], 0)
    total = _lse(alpha[n], 0)
    beta = np.full((n + 1, TYPES), -np.inf)
    beta[n] = 0.0
    after: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for j in range(n):
        for k, i in enumerate(lat.starts[j]):
            after[i].append((j, k))
    gw, gt = np.zeros_like(w), np.zeros_like(t)
    for i in range(n - 1, -1, -1):
        ways = [t[:, 0] + beta[i + 1, 0]]
        gt[:, 0] -= np.exp(alpha[i] + ways[0] - total)
        for j, k in after[i]:
            arc = t[:, 1:] + scores[j][k] + beta[j + 1, 1:]
            m = np.exp(alpha[i][:, None] + arc - total)
            gt[:, 1:] -= m
            gw -= np.outer(lat.x[j][k], m.sum(axis=0))
            ways.append(_lse(arc, 1))
        beta[i] = _lse(np.stack(ways), 0)
    value, before = -float(total), 0
    for i, j, y in gold:
        value += t[before, y]
        gt[before, y] += 1
        if y:
            k = int(np.flatnonzero(lat.starts[j] == i)[0])
            value += scores[j][k][y - 1]
            gw[:, y - 1] += lat.x[j][k]
        before = y
    return value, gw, gt


def decode(text: str, start: int, end: int, w: np.ndarray, t: np.ndarray) -> list[tuple[int, int, int]]:
    """Best spans (start, end, type) of a stretch by dynamic programming; only the way back is kept of tokens read."""
    tokens = Tokens(text, start, end)
    spans, moves = tokens.spans, t.tolist()
    never = float("-inf")
    kinds = range(1, TYPES)
    best = deque([[0.0] + [never] * (TYPES - 1)], maxlen=LONGEST)  # of the last token boundaries, the newest last
    back: list[tuple[int, list[tuple[int, int]] | None]] = []
    for j in range(len(spans)):
        now = best[-1]
        was = max(range(TYPES), key=lambda y: now[y] + moves[y][0])
        new, ways = [now[was] + moves[was][0]] + [never] * (TYPES - 1), None
        if own := tokens.starts(j):
            scores = (np.array([span_features(text, spans[i][0], spans[j][1]) for i in own]) @ w).tolist()
            ways = [(0, 0)] * (TYPES - 1)
            for i, score in zip(own, scores, strict=True):
                old = best[i - j - 1]
                for y in kinds:
                    z = max(range(TYPES), key=lambda x: old[x] + moves[x][y])
                    if (value := old[z] + moves[z][y] + score[y - 1]) > new[y]:
                        new[y], ways[y - 1] = value, (i, z)
        best.append(new)
        back.append((was, ways))
    found, j, y = [], len(spans), max(range(TYPES), key=lambda x: best[-1][x])
    while j:
        was, ways = back[j - 1]
        if y:
            i, z = ways[y - 1]
            found.append((spans[i][0], spans[j - 1][1], y))
            j, y = i, z
        else:
            j, y = j - 1, was
    return found[::-1]


def examples(seed: int = 5, many: int = EXAMPLES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated stretches with their gold spans: entities in common formats among look-alikes."""
    rng = np.random.default_rng(seed)
    r = lambda a, b: int(rng.integers(a, b + 1))
    pick = lambda xs: xs[r(0, len(xs) - 1)]
    digits = lambda n: "".join(str(r(0, 9)) for _ in range(n))
    word = lambda: "".join(chr(97 + r(0, 25)) for _ in range(r(3, 8)))

    def card(good: bool = True) -> str:
        d = pick("3456") + digits(14)
        last = next(str(c) for c in range(10) if luhn(d + str(c)) == good)
        d += last
        gap = pick(["", "", " ", "-"])
        return gap.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return pick([f"+{r(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{r(10, 99)} {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])

    kinds = [
        lambda: ("email", f"{word()}{pick(['', '.', '_'])}{digits(r(0, 3))}@{word()}.{pick(['com', 'org', 'example.com'])}"),
        lambda: ("ip", ".".join(str(r(0, 255)) for _ in range(4))),
        lambda: ("card", card()),
        lambda: ("phone", phone()),
    ]
    noise = [lambda: digits(r(1, 8)), lambda: f"{digits(r(1, 3))}.{digits(2)}", lambda: f"20{digits(2)}-0{r(1, 9)}-1{r(0, 9)}", lambda: f"v{r(0, 9)}.{r(0, 9)}.{r(0, 9)}", lambda: card(False), lambda: digits(r(17, 26)), lambda: f"{r(300, 999)}.{r(0, 255)}.{r(256, 999)}.{r(0, 9)}", lambda: f"{r(1, 12)}:{digits(2)}", lambda: word() + digits(4), lambda: word() + "=" + "".join(pick("0123456789abcdef") for _ in range(r(16, 40))), lambda: "".join(pick("0123456789abcdef") for _ in range(40)), lambda: f"@{word()}{digits(2)}", lambda: f"{word()}@{word()}"]
    out = []
    for _ in range(many):
        text, spans = "", []
        for _ in range(r(1, 3)):
            if text:
                text += pick([" ", " ", ", ", "; "])
            if rng.random() < 0.6:
                kind, s = pick(kinds)()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += pick(noise)()
        out.append((text, spans))
    return out


@cache
def train() -> tuple[np.ndarray, np.ndarray]:
    """Weights of spans and of transitions, fitted by Adagrad on the generated stretches."""
    w, t = np.zeros((WIDTH, TYPES - 1)), np.zeros((TYPES, TYPES))
    hw, ht = np.full_like(w, 1e-3), np.full_like(t, 1e-3)
    data = []
    for text, spans in examples():
        lat = Lattice(text, 0, len(text))
        first, last = {a: i for i, (a, _) in enumerate(lat.tokens)}, {b: i for i, (_, b) in enumerate(lat.tokens)}
        entities = {first[a]: (last[b], 1 + KINDS.index(k)) for k, a, b in spans if a in first and b in last and first[a] in lat.starts[last[b]]}
        gold, i = [], 0
        while i < lat.n:
            j, y = entities.get(i, (i, 0))
            gold.append((i, j, y))
            i = j + 1
        data.append((lat, gold))
    for _ in range(EPOCHS):
        for lat, gold in data:
            _, gw, gt = likelihood(lat, w, t, gold)
            gw, gt = gw - PENALTY * w, gt - PENALTY * t
            hw += gw * gw
            ht += gt * gt
            w += RATE * gw / np.sqrt(hw)
            t += RATE * gt / np.sqrt(ht)
    return w, t


def added_spans(text: str, base: list[tuple[str, int, int]], w: np.ndarray, t: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the field that overlap no base span."""
    if not _OUTSIDE.search(text):
        return []
    out, taken = [], sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    at = 0
    for m in _STRETCH.finditer(text):
        while at < len(taken) and ends[at] <= m.start():
            at += 1
        rest, p, k = [], m.start(), at
        while k < len(taken) and starts[k] < m.end():
            rest.append(text[p : max(p, starts[k])])
            p = max(p, ends[k])
            k += 1
        rest.append(text[p : m.end()])
        if not any(_OUTSIDE.search(x) for x in rest):
            continue
        for a, b, y in decode(text, m.start(), m.end(), w, t):
            k = bisect_left(starts, b)
            if not k or ends[k - 1] <= a:
                out.append((KINDS[y - 1], a, b))
    return out


def find(text: str | None, w: np.ndarray, t: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, w, t), key=lambda s: (KINDS.index(s[0]), s[1]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add arrays ``base`` and ``spans`` of (kind, start, end)."""
    small_batches(docs.sparkSession)
    docs, names, own = clear_of(docs, ["__f"], ["base", "spans"])
    w, t = train()

    @F.pandas_udf("base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        found = [find(x, w, t) for x in texts]
        rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return pd.DataFrame({"base": pd.Series([rows(b) for b, _ in found], dtype=object), "spans": pd.Series([rows(s) for _, s in found], dtype=object)})

    return docs.withColumn("__f", scanned(F.col(names.get(text, text)))).select(*own, F.col("__f.base").alias("base"), F.col("__f.spans").alias("spans"))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the query on personal data returns."""
    found = scan(docs.select("doc_id", "text"))
    joined = lambda c: F.expr(f"array_join(transform({c}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
