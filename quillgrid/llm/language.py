"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

A whole text becomes a normalised histogram of hashed byte n-grams of its letters. A one-versus-rest
linear SVM picks the language family; within it one linear SVM for each pair of languages votes. Models
are fitted with the squared hinge loss on a bounded sample of documents for each language, never on
held-out ones. Every language that a usable label names can be predicted.

Defined results: a null text or one without a letter (general category L) is ``und`` with score 0; null
labels teach nothing; without labels at all every text is ``und``; a language outside the family table is
a family of its own; equal votes go to the larger sum of margins, then to the first language by name;
rows that repeat get equal results; whole texts of any length are counted; an empty table gives an empty
result; an input column named ``lang_pred`` or ``score`` gets ``_input`` added to its name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.shared import clear_of, cut, small_batches, small_side

SIZE = 4096
#: Most training documents of a language, and of all together: with over 64 languages each has fewer, with thousands two.
SAMPLE_EACH, SAMPLE = 250, 16_000
#: Texts whose histograms are held at once.
CHUNK = 512
FOLDS, HELD_OUT = 5, 0
PENALTY, STEPS, SLOPE = 1e-3, 150, 4.0

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it la oc pt rm ro wa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "uralic": "et fi hu se",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "semitic": "am ar he mt ti",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "sinitic": "zh",
    "malayic": "id jv mg ms su tl",
}

_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PRIMES = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    """Whether a character has the general category L."""
    return bool(text) and any(map(str.isalpha, text))


def family_of(lang: str) -> str:
    return _FAMILY.get(re.split(r"[-_]", lang.lower())[0], f"only {lang}")


def histogram(text: str) -> np.ndarray:
    """Square roots of n-gram counts (2 to 4 bytes), of length 1."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()) + b" "
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    total = np.zeros(SIZE)
    h = b * _PRIMES[0]
    for n in range(2, 5):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(31) + b[n - 1 :] * _PRIMES[n - 1]
        total += np.bincount((h ^ (h >> np.uint32(15))) >> np.uint32(3) & np.uint32(SIZE - 1), minlength=SIZE)
    x = np.sqrt(total)
    return (x / (np.linalg.norm(x) or 1.0)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss (labels 1 and -1, classes weighed alike); the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = last = np.zeros(x.shape[1], dtype=np.float32)
    rate = 1.0 / (2 * 2.0 + PENALTY)  # rows have a norm of at most sqrt(2)
    for k in range(STEPS):
        z = w + (k / (k + 3)) * (w - last)
        gap = np.maximum(0, 1 - y * (x @ z))
        last, w = w, z - rate * (PENALTY * z - 2 * x.T @ (c * y * gap))
    return w


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    pair_weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each histogram."""
        x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
        margins = x @ self.family_weights.T
        at = margins.argmax(axis=1)
        sure = _soft(margins)[np.arange(len(x)), at] if len(self.families) > 1 else np.ones(len(x))
        out: list[tuple[str, float]] = [("", 0.0)] * len(x)
        for f in np.unique(at):
            rows, own = np.flatnonzero(at == f), self.languages[self.families[f]]
            if len(own) == 1:
                names, p = np.zeros(len(rows), dtype=int), sure[rows]
            else:
                m = x[rows] @ self.pair_weights[self.families[f]].T
                votes, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
                for k, (i, j) in enumerate(self.pairs[self.families[f]]):
                    votes[:, i] += m[:, k] >= 0
                    votes[:, j] += m[:, k] < 0
                    sums[:, i] += m[:, k]
                    sums[:, j] -= m[:, k]
                names = np.where(votes == votes.max(axis=1, keepdims=True), sums, -np.inf).argmax(axis=1)
                p = sure[rows] * _soft(sums / (len(own) - 1))[np.arange(len(rows)), names]
            for r, name, value in zip(rows, names, p, strict=True):
                out[r] = (str(own[name]), round(float(min(1.0, max(0.0, value))), 4))  # rounded, as sums depend on the batch
        return out


def _soft(m: np.ndarray) -> np.ndarray:
    e = np.exp(SLOPE * (m - m.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    if not langs:
        return None
    langs_at = np.array(langs)
    fams = np.array([family_of(s) for s in langs])
    families = sorted(set(fams))
    weights = np.stack([svm(x, np.where(fams == f, 1, -1).astype(np.float32)) if len(families) > 1 else np.zeros(SIZE + 1, dtype=np.float32) for f in families])
    languages = {f: sorted(set(langs_at[fams == f])) for f in families}
    pairs, pair_weights = {}, {}
    for f, own in languages.items():
        pairs[f] = list(combinations(range(len(own)), 2))
        rows = [svm(x[at], np.where(langs_at[at] == own[i], 1, -1).astype(np.float32)) for i, j in pairs[f] for at in [(langs_at == own[i]) | (langs_at == own[j])]]
        pair_weights[f] = np.stack(rows) if rows else np.zeros((0, SIZE + 1), dtype=np.float32)
    return Model(families, weights, languages, pairs, pair_weights)


def fold(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def training_rows(docs: DataFrame, each: int = SAMPLE_EACH, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, lang) of different documents of each language, none held out: ``each``, or fewer where that makes over
    ``most``, yet two at least where there are two.

    A hash threshold that follows from the language's count leaves a few hundred candidates of each
    language wherever they lie, so no task ranks all rows of a common language. Where it leaves too few, because ids
    repeat, all different rows of that language are ranked. The driver gets a count of each language.
    """
    key = F.xxhash64("text").alias("__key")
    usable = docs.where(F.col("lang").isNotNull() & (F.coalesce(fold(), F.lit(-1)) != HELD_OUT)).select("doc_id", "lang", key)
    counts = cut(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    each = max(2, min(each, most // max(1, counts.count())))
    h = F.xxhash64("doc_id")
    # at 40 expected candidates fewer than 2 are next to impossible, unless rows share their ids
    share = F.least(F.lit(1.0), F.lit(float(2 * each + 40)) / F.col("n"))
    some = cut(usable.join(small_side(counts), "lang").where((F.pmod(h, F.lit(1_000_003)) / 1_000_003) < share).select("doc_id", "lang", "__key").distinct())
    got = some.groupBy("lang").agg(F.count(F.lit(1)).alias("got"))
    lacking = counts.join(got, "lang", "left").where(f"coalesce(got, 0) < least(n, {each})").select("lang")
    if lacking.limit(1).count():
        some = some.union(usable.join(small_side(lacking), "lang", "left_semi").select(*some.columns)).distinct()
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", "__key"))).where(F.col("_r") <= each)
    chosen = ranked.select("doc_id", "lang", "__key")
    own = docs.select("doc_id", "text", "lang", key).join(small_side(chosen), ["doc_id", "lang", "__key"])
    return own.dropDuplicates(["doc_id", "lang", "__key"]).select("doc_id", "text", "lang")


def _histograms(batches):
    for batch in batches:
        rows = [(t, s) for t, s in zip(batch["text"], batch["lang"], strict=True) if has_letter(t)]
        if not rows:
            continue
        yield pd.DataFrame({"x": [histogram(t).tobytes() for t, _ in rows], "lang": [s for _, s in rows]})


def train(docs: DataFrame) -> Model | None:
    """Fit on the bounded sample; the driver gets a histogram of 16 KB of each of its documents, so some 260 MB at most."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs).mapInPandas(_histograms, "x binary, lang string").collect()
    rows = sorted((r["lang"], bytes(r["x"])) for r in rows)
    return fit(np.array([np.frombuffer(x, dtype=np.float32) for _, x in rows]).reshape(-1, SIZE), [s for s, _ in rows])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``."""
    small_batches(docs.sparkSession)
    docs, names, own = clear_of(docs, ["__l"], ["lang_pred", "score"])

    @F.pandas_udf("lang_pred string, score double")
    def identified(texts: pd.Series) -> pd.DataFrame:
        out = [("und", 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
        for at in range(0, len(known), CHUNK):
            rows = known[at : at + CHUNK]
            for i, found in zip(rows, model.predict(np.stack([histogram(texts.iat[i]) for i in rows])), strict=True):
                out[i] = found
        return pd.DataFrame({"lang_pred": [s for s, _ in out], "score": [p for _, p in out]})

    return docs.withColumn("__l", identified(F.col(names.get(text, text)))).select(*own, F.col("__l.lang_pred").alias("lang_pred"), F.col("__l.score").alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the language query returns."""
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
