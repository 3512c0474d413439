"""Quality rules: exact document statistics, then gradient-boosted trees over them.

Every whole text gives counts (words, symbols, repeated lines, words in repeated five-word windows and
others); fixed rules reject texts of under ten words or with over a fifth of their words in repeated
windows. The rest is judged by gradient-boosted trees on ratios of those counts, trained here with the
logistic loss on a bounded sample of ``labels.quality``. Trees are flattened into numpy node arrays and a
batch of documents walks all trees level by level. Features in RISING may only raise the score as they
grow and features in FALLING only lower it: a split against that is never taken, and the bounds handed to
the two sides keep whole trees monotonic.

Defined results: a null or empty text has no words and is rejected by the rules; without usable labels
(none, or one class) the rules alone decide; rows that repeat get equal verdicts; of equally good splits the
first feature and threshold count; lines and words of very long texts are counted in linear time; an empty
table gives an empty result; extra columns of any name stay with their rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.shared import apart, different_rows, small_batches

#: Most labelled rows that a model is fitted on; the rows with the smallest hashes of doc_id are taken.
SAMPLE = 4000
TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 40, 3, 0.2, 32, 1.0, 10
KEEP_AT = 0.5
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "exclaims", "bare_words", "short_lines", "distinct", "commas", "longest", "periods"]
RISING = {"log_words"}
FALLING = {"symbols", "dup_lines", "repeats", "upper", "exclaims", "bare_words"}


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The exact counts and the features of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = sum(len(w) for w in words) if len(raw) == len(text or "") else len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = sum(raw.count(x) for x in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    seen: set[bytes] = set()
    lines = dup = short = 0
    for line in raw.split(b"\n"):
        if not line or line.isspace():
            continue
        lines += 1
        short += len(line) < 30
        if line in seen:
            dup += 1
        else:
            seen.add(line)
    repeat = 0
    if n >= WINDOW:
        grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(grams)) < len(grams):
            times = Counter(grams)
            covered = np.zeros(n + WINDOW, dtype=np.int32)
            at = np.flatnonzero(np.fromiter((times[g] > 1 for g in grams), dtype=bool, count=len(grams)))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
            repeat = int((np.cumsum(covered)[:n] > 0).sum())
    counts = (n, word_chars, symbols, dup, repeat)
    if not n:
        return counts, (0.0,) * len(FEATURES)
    data = np.frombuffer(raw, dtype=np.uint8)
    hist = np.bincount(data, minlength=256)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    bare = words.count(b"|") + words.count(b"-") + words.count(b"*")
    features = (
        float(np.log1p(n)), word_chars / n, symbols / n, dup / lines, repeat / n, upper / max(1, upper + lower), int(hist[48:58].sum()) / max(1, word_chars),
        int(hist[33]) / n, bare / n, short / lines, len(set(words)) / n, int(hist[44]) / n, float(np.log1p(max(map(len, words)))), int(hist[46]) / n,
    )
    return counts, features


@dataclass
class Trees:
    """All trees in flat node arrays; node 2i+1 and 2i+2 follow node i within a tree."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows."""
        total = np.full(len(x), self.start)
        if not len(x):
            return total
        rows, inner = np.arange(len(x)), self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees on histogram bins with Newton leaves and monotonic bounds."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    sign = np.array([1 if f in RISING else -1 if f in FALLING else 0 for f in FEATURES])[:width]
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    score = np.full(n, start)

    def value(g: float, h: float, low: float, high: float) -> float:
        return min(max(g / (h + RIDGE), low), high)

    def split(t: int, node: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float) -> None:
        own = value(g[rows].sum(), h[rows].sum(), low, high)
        if node >= inner:
            leaf[t, node - inner] = RATE * own
            return
        best = (1e-6, -1, 0, 0.0)
        if len(rows) >= 2 * LEAST:
            for j in range(width):
                k = len(edges[j])
                if not k:
                    continue
                b = binned[rows, j]
                gs, hs, cs = (np.cumsum(np.bincount(b, w, minlength=k + 1))[:-1] for w in (g[rows], h[rows], None))
                gt, ht, ct = g[rows].sum(), h[rows].sum(), len(rows)
                left = np.clip(gs / (hs + RIDGE), low, high)
                right = np.clip((gt - gs) / (ht - hs + RIDGE), low, high)
                gain = (gs * left - 0.5 * (hs + RIDGE) * left**2) + ((gt - gs) * right - 0.5 * (ht - hs + RIDGE) * right**2) - (gt * own - 0.5 * (ht + RIDGE) * own**2)
                gain[(cs < LEAST) | (ct - cs < LEAST) | (sign[j] * (right - left) < 0)] = 0
                if gain.max() > best[0]:
                    at = int(gain.argmax())
                    best = (gain[at], j, at, (left[at] + right[at]) / 2)
        _, j, at, middle = best
        if j < 0:
            split(t, 2 * node + 1, rows, g, h, own, own)
            split(t, 2 * node + 2, rows[:0], g, h, own, own)
            return
        feature[t, node], threshold[t, node] = j, edges[j][at]
        goes = binned[rows, j] > at
        bounds = [(low, high), (low, high)]
        if sign[j] > 0:
            bounds = [(low, middle), (middle, high)]
        elif sign[j] < 0:
            bounds = [(middle, high), (low, middle)]
        split(t, 2 * node + 1, rows[~goes], g, h, *bounds[0])
        split(t, 2 * node + 2, rows[goes], g, h, *bounds[1])

    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        split(t, 0, np.arange(n), y - p, p * (1 - p), -4.0, 4.0)
        score += Trees(feature[t : t + 1], threshold[t : t + 1], leaf[t : t + 1], 0.0).score(x)
    return Trees(feature, threshold, leaf, start)


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """(text, label) of a bounded, repeatable sample of labelled documents: at most ``most`` different rows."""
    chosen = labels.where(F.col(label).isNotNull()).select(F.col("doc_id"), F.col(label).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(most)
    return different_rows(docs.select("doc_id", "text"), chosen, most, "text").select("text", "_y")


def _measured(batches):
    for batch in batches:
        found = [measure(t)[1] for t in batch["text"]]
        yield pd.DataFrame({"x": [np.array(f) for f in found], "y": batch["_y"].to_numpy()})


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Trees | None:
    """Trees from at most ``most`` labelled rows, or None where labels are missing or of one class."""
    small_batches(docs.sparkSession)
    rows = sampled(docs, labels, "quality", most).mapInPandas(_measured, "x array<double>, y int").collect()
    y = np.array([r.y for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    order = sorted(range(len(rows)), key=lambda i: (rows[i].x, rows[i].y))  # the collected order may differ
    return fit(np.array([rows[i].x for i in order], dtype=float), y[order])


def judge(docs: DataFrame, model: Trees | None, text: str = "text") -> DataFrame:
    """Add a struct ``__q`` of the counts, base_failed, score and kept; an input column of that name gets ``_input`` added."""
    small_batches(docs.sparkSession)
    docs = apart(docs, ["__q"])

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        both = [measure(t) for t in texts]
        counts = np.array([c for c, _ in both], dtype=np.int64).reshape(-1, len(COUNTS))
        x = np.array([f for _, f in both], dtype=float).reshape(-1, len(FEATURES))
        n, repeat = counts[:, 0], counts[:, 4]
        failed = (n < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n)
        p = 1 / (1 + np.exp(-model.score(x))) if model else np.ones(len(x))
        out = pd.DataFrame(counts, columns=COUNTS)
        return out.assign(base_failed=failed, score=p, kept=~failed & (p >= KEEP_AT))

    return docs.withColumn("__q", judged(F.col(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns that the quality query returns."""
    out = judge(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", *(F.col(f"__q.{c}").alias(c) for c in [*COUNTS, "base_failed", "kept", "score"]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass."""
    held = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return judge(held, train(docs, labels)).where("__q.kept").select("row.*")
