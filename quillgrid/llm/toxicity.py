"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed lower-case words and word beginnings. The machine scores ``w0 + sum w_i + sum <v_i, v_j>``
over the terms present, so pairs of terms weigh in beyond their own weights, at a cost linear in the
terms. Weights are fitted with the logistic loss and Adagrad on a bounded sample of labelled documents
outside the held-out fold. Terms take part that the sample ties to the label, on their own or as one of a pair: all
pairs of the SCREENED most frequent terms are counted, so two words that say nothing alone and much together are in.
The others stay at zero, as tens of thousands of terms on a few thousand rows would fit noise.

Defined results: a null or empty text has no terms and gets the score of the bias; without usable
labels every score is 0; rows that repeat get equal scores; long texts cost time in proportion; an empty
table gives an empty result; an input column named ``score`` gets ``_input`` added to its name.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.language import HELD_OUT, fold
from quillgrid.llm.quality import sampled
from quillgrid.llm.shared import apart, small_batches, within

BITS = 18
FACTORS = 4
SAMPLE = 8000
#: Bytes of the word beginnings that are terms besides whole words.
BEGINNINGS = (4, 5, 6, 8)
#: Most bytes of terms that the driver gathers for the sample, in the order of the rows' hashes.
SAMPLE_BYTES = 64 << 20
#: Least chi-square of a term's presence and the label in the sample.
LEAST_CHI2 = 30.0
#: Terms whose pairs are counted, least chi-square of what a pair says beyond the sum of its terms, and how often that of
#: either term alone the chi-square of the pair's presence must be.
SCREENED, LEAST_PAIR_CHI2, ABOVE = 2000, 60.0, 1.5
EPOCHS, RATE, DECAY, BATCH = 12, 0.1, 2e-4, 32
_BREAK = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def terms(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct words and word beginnings of a whole text."""
    if not text:
        return np.zeros(0, dtype=np.int32)
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(_BREAK).split())
    words |= {b"^" + w[:k] for k in BEGINNINGS for w in words if len(w) > k}
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((crc32(w) & mask for w in words), dtype=np.int32, count=len(words)))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    used: np.ndarray  # whether a term has weights

    def score(self, at: np.ndarray) -> float:
        """Probability of the label."""
        return float(self.scores([at])[0])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities of a batch of rows."""
        n = len(rows)
        doc = np.repeat(np.arange(n), [len(r) for r in rows])
        at = np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64)
        used = self.used[at]
        doc, at = doc[used], at[used]
        v = self.factors[at].astype(float)
        sums = np.stack([np.bincount(doc, v[:, f], minlength=n) for f in range(v.shape[1])], axis=1)
        raw = self.bias + np.bincount(doc, self.weights[at], minlength=n) + 0.5 * ((sums * sums).sum(axis=1) - np.bincount(doc, (v * v).sum(axis=1), minlength=n))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def chi_square(both: np.ndarray, each: np.ndarray, positive: float, n: float) -> np.ndarray:
    """Chi-square of presence (``each`` rows, ``both`` of them positive) and the label."""
    cross = n * both - positive * each
    return n * cross**2 / np.maximum(1.0, positive * (n - positive) * each * (n - each))


def interaction(both: tuple[np.ndarray, np.ndarray], one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], whole: tuple[float, float]) -> np.ndarray:
    """Chi-square of the contrast between the positive rates of rows with both terms, with each alone and with neither.

    Each argument is (rows, positive rows): of pairs, of their first terms, of their second terms, and of all.
    """
    contrast, variance = 0.0, 0.0
    cells = [(b, o - b, t - b, w - o - t + b) for b, o, t, w in zip(both, (c[:, None] for c in one), (c[None, :] for c in other), whole, strict=True)]
    for rows, positive, sign in zip(*cells, (1, -1, -1, 1), strict=True):
        rate = (positive + 0.5) / (rows + 1)
        contrast, variance = contrast + sign * rate, variance + rate * (1 - rate) / (rows + 1)
    return contrast**2 / variance


def chosen(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Which terms take part."""
    n, m = len(rows), float(y.sum())
    none = np.zeros(0, dtype=np.int32)
    spread = np.bincount(np.concatenate([none, *rows]), minlength=size).astype(float)
    alone = chi_square(np.bincount(np.concatenate([none, *(r for r, b in zip(rows, y, strict=True) if b)]), minlength=size), spread, m, n)
    used = alone >= LEAST_CHI2
    frequent = np.sort(np.lexsort((np.arange(size), -spread))[:SCREENED])
    place = np.full(size, -1)
    place[frequent] = np.arange(len(frequent))
    x = np.zeros((n, len(frequent)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, (at := place[r])[at >= 0]] = 1
    positive = x[y > 0]
    each = x.sum(axis=0, dtype=float), positive.sum(axis=0, dtype=float)
    for at in range(0, len(frequent), 250):
        part = slice(at, at + 250)
        both = (x[:, part].T @ x).astype(float), (positive[:, part].T @ positive).astype(float)
        strong = interaction(both, (each[0][part], each[1][part]), each, (n, m)) >= LEAST_PAIR_CHI2
        strong &= chi_square(both[1], both[0], m, n) >= ABOVE * np.maximum(alone[frequent[part]][:, None], alone[frequent][None, :])
        strong[np.arange(len(strong)), np.arange(at, at + len(strong))] = False
        used[frequent[part][strong.any(axis=1)]] = True
        used[frequent[strong.any(axis=0)]] = True
    return used


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 7, pairs: bool = True) -> Machine:
    """A machine fitted to rows of terms; without ``pairs`` a linear model of the same terms, for comparison."""
    size = 1 << BITS
    used = chosen(rows, y, size)
    rows = [r[used[r]] for r in rows]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size), np.where(used[:, None] & pairs, rng.normal(0, 0.01, (size, FACTORS)), 0.0)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            n = np.array([len(rows[i]) for i in batch])
            idx = np.concatenate([rows[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), n)
            vi = v[idx]
            s = np.stack([np.bincount(doc, vi[:, f], minlength=len(batch)) for f in range(FACTORS)], axis=1)
            q = np.bincount(doc, (vi * vi).sum(axis=1), minlength=len(batch))
            raw = bias + np.bincount(doc, w[idx], minlength=len(batch)) + 0.5 * ((s * s).sum(axis=1) - q)
            e = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[batch]
            gb += e.sum() ** 2
            bias -= RATE * e.sum() / np.sqrt(gb)
            one, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, e[doc]) + DECAY * w[one] * len(batch)
            per = e[doc][:, None] * (s[doc] - vi)
            dv = np.stack([np.bincount(back, per[:, f]) for f in range(FACTORS)], axis=1) + DECAY * v[one] * len(batch)
            gw[one] += dw * dw
            gv[one] += dv * dv
            w[one] -= RATE * dw / np.sqrt(gw[one])
            v[one] -= 0.2 * RATE * pairs * dv / np.sqrt(gv[one])
    return Machine(bias, w.astype(np.float32), v.astype(np.float32), used)


def _listed(batches):
    for batch in batches:
        yield pd.DataFrame({"x": [terms(t).tobytes() for t in batch["text"]], "y": batch["_y"].to_numpy()})


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine | None:
    """A machine from at most ``most`` labelled rows outside the held-out fold; None without two classes."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.coalesce(fold(), F.lit(-1)) != HELD_OUT)
    rows = within(sampled(docs, usable, "toxic", most).mapInPandas(_listed, "x binary, y int"), "x", SAMPLE_BYTES).collect()
    rows = sorted((bytes(r["x"]), r["y"]) for r in rows)
    y = np.array([b for _, b in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    return fit([np.frombuffer(x, dtype=np.int32) for x, _ in rows], y)


def rate(docs: DataFrame, machine: Machine | None, text: str = "text") -> DataFrame:
    """Add ``score``."""
    small_batches(docs.sparkSession)
    docs = apart(docs, ["score"])

    @F.pandas_udf("double")
    def rated(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.scores([terms(t) for t in texts]) if machine else np.zeros(len(texts)), dtype="float64")

    return docs.withColumn("score", rated(F.col(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns that the toxicity query returns."""
    out = rate(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
