"""Licence scans: a trained paragraph classifier over sparse word n-grams, confirmed against templates.

A paragraph is a block of lines between blank ones, its lines joined, so notices may be wrapped. In a block the places
of telling word pairs of the templates (pairs with a word that isn't a function word) are found; places at most GAP words
apart make a window. Each window, and each line with such a pair, is classified: softmax regression over the words and
word pairs of licence templates scores licence families and an unknown class; it is fitted on variations of the
templates and on ordinary paragraphs of a bounded sample of documents, then calibrated by a temperature on paragraphs
left out of the fit. A family counts only if its probability beats the threshold and the window agrees with one of the
family's templates: it has half of the template's word pairs or, a window, is itself a part of the template. What is scored
depends on the templates alone, not on the sample.

Defined results: null, empty and word-less texts have no notices; a family is reported once for each line or window that
shows it, windows only where none of their lines does; rows that repeat get equal results; long texts are scanned whole;
an empty table gives an empty result, and the unknown class is then fitted on template fragments alone; an input column
named ``notices`` gets ``_input`` added to its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.shared import apart, sample_rows, small_batches

SAMPLE_DOCS = 1000
#: Most ordinary paragraphs that the model is fitted on.
SAMPLE_PARAGRAPHS = 4000
VARIANTS = 40
STEPS, RATE, PENALTY = 250, 1.0, 1e-3
LEAST_P, LEAST_AGREEMENT = 0.5, 0.5
#: Least share of a window's word pairs, and least number of them, that make it a part of a longer template.
PART, PART_PAIRS = 0.8, 6
#: Most words between two telling pairs of a window.
GAP = 8
# Words that tell nothing of licences on their own.
FUNCTION = frozenset(b"a an and any are as at be been by can for from has have he in is it its may must no not of on or she so such that the their them they this to under was were which will with you your".split())
UNKNOWN = "unknown"

# Short notices of common licence families.
TEMPLATES = {
    "agpl": ["GNU Affero General Public License", "Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "apache": ["Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl": ["GNU General Public License", "You should have received a copy of the GNU General Public License along with this program.", "This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.", "Licensed under the GNU General Public License, version 2."],
    "isc": ["ISC License", "Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl": ["GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": ["MIT License", "Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."],
    "mpl": ["Mozilla Public License Version 2.0", "Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential. All rights reserved."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}

_BREAK = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BREAK).split()


def grams(words: list[bytes]) -> set[bytes]:
    return {*words, *(a + b" " + b for a, b in zip(words, words[1:], strict=False))}


def pairs_of(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


def agrees(words: list[bytes], template: list[bytes], part: bool = True) -> bool:
    """Whether a window has enough of a template's word pairs or, with ``part``, consists of them."""
    a, b = pairs_of(words), pairs_of(template)
    both = len(a & b)
    return bool(b) and (both >= LEAST_AGREEMENT * len(b) or part and both >= PART_PAIRS and both >= PART * len(a))


_TEMPLATES = [(f, tokens(t)) for f, ts in TEMPLATES.items() for t in ts]
_VOCABULARY = {g: i for i, g in enumerate(sorted({g for _, t in _TEMPLATES for g in grams(t)}))}
_TELLING = frozenset(p for _, t in _TEMPLATES for p in pairs_of(t) if not FUNCTION.issuperset(p) and not (p[0].isdigit() and p[1].isdigit()))
_TELLING_WORDS = frozenset(w for p in _TELLING for w in p if w not in FUNCTION)


def features(words: list[bytes]) -> list[int]:
    """Numbers of the vocabulary's words and word pairs that occur."""
    return sorted(i for g in grams(words) if (i := _VOCABULARY.get(g)) is not None)


def blocks(text: str) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Blocks of neighbouring lines that aren't blank, as (line number, words)."""
    own = []
    for i, line in enumerate(text.split("\n")):
        if words := tokens(line):
            own.append((i, words))
        elif own and not line.strip():
            yield own
            own = []
    if own:
        yield own


def windows(block: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first line, last line, words) of the runs of a block in which telling pairs follow each other."""
    lines = [i for i, words in block for _ in words]
    words = [w for _, ws in block for w in ws]
    hits = [k for k, p in enumerate(zip(words, words[1:], strict=False)) if p in _TELLING]
    at = 0
    for k in range(1, len(hits) + 1):
        if k == len(hits) or hits[k] - hits[k - 1] > GAP:
            first, last = hits[at], hits[k - 1] + 1
            yield lines[first], lines[last], words[first : last + 1]
            at = k


@dataclass
class Classifier:
    classes: list[str]
    weights: np.ndarray  # (features + bias) x classes
    temperature: float

    def classify(self, words: list[bytes], part: bool = True) -> tuple[str, float]:
        """Family and probability, or unknown."""
        at = features(words)
        if not at:
            return UNKNOWN, 1.0
        z = (self.weights[at].sum(axis=0) / np.sqrt(len(words)) + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        name = self.classes[best]
        if name == UNKNOWN or p[best] < LEAST_P:
            return UNKNOWN, float(p[self.classes.index(UNKNOWN)])
        return (name, float(p[best])) if any(agrees(words, t, part) for f, t in _TEMPLATES if f == name) else (UNKNOWN, float(1 - p[best]))

    def scan(self, text: str | None) -> list[tuple[int, str, float]]:
        """(line, family, probability) of the notices in a text, by line."""
        if not text or _TELLING_WORDS.isdisjoint(tokens(text)):
            return []
        out = []
        for block in blocks(text):
            if all(_TELLING_WORDS.isdisjoint(words) for _, words in block):
                continue
            own = dict(block)
            told: dict[int, str] = {}  # each line is classified once, however many windows it has
            for first, last, words in windows(block):
                shown = set()
                for i in range(first, last + 1):
                    if i not in told and i in own:
                        name, p = UNKNOWN, 0.0
                        if not _TELLING.isdisjoint(pairs_of(own[i])):
                            name, p = self.classify(own[i], part=False)  # parts of a notice are told by their window
                        if name != UNKNOWN:
                            out.append((i, name, p))
                        told[i] = name
                    shown.add(told.get(i))
                name, p = self.classify(words)
                if name != UNKNOWN and name not in shown:
                    out.append((first, name, p))
        return sorted(set(out))


def fit(ordinary: list[tuple[int, list[int]]], seed: int = 11) -> Classifier:
    """Fit on template variations and ordinary paragraphs (words, features); a fifth is held back for the temperature."""
    rng = np.random.default_rng(seed)
    own = sorted({w for _, t in _TEMPLATES for w in t})
    rows, names = [], []
    for f, t in _TEMPLATES:
        for k in range(VARIANTS):
            words = [w for w in t if k == 0 or rng.random() > 0.08]
            if k % 4 == 3 and len(t) > 12:  # a part, as a wrapped line holds
                at = int(rng.integers(0, len(t) - 8))
                words = t[at : at + int(rng.integers(8, 16))]
            rows.append((len(words) + (int(rng.integers(1, 5)) if k % 3 == 1 else 0), features(words)))
            names.append(f)
    for n, at in ordinary:
        rows.append((n, at))
        names.append(UNKNOWN)
    for _ in range(400):  # words of licences in other company
        words = [own[i] for i in rng.integers(0, len(own), rng.integers(1, 9))]
        rows.append((len(words) + int(rng.integers(2, 12)), features(words)))
        names.append(UNKNOWN)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    y = np.array([classes.index(n) for n in names])
    x = np.zeros((len(rows), len(_VOCABULARY) + 1), dtype=np.float32)
    for i, (n, at) in enumerate(rows):
        x[i, at] = 1 / np.sqrt(max(1, n))
        x[i, -1] = 1
    held = rng.random(len(rows)) < 0.2
    fitted, target = x[~held], np.eye(len(classes), dtype=np.float32)[y[~held]]
    share = target.sum(axis=0)
    each = (1 / np.maximum(share, 1))[y[~held]][:, None] * len(target) / len(classes)
    w = last = np.zeros((x.shape[1], len(classes)), dtype=np.float32)
    for k in range(STEPS):
        v = w + (k / (k + 3)) * (w - last)
        z = fitted @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        last, w = w, v - RATE * (fitted.T @ (each * (p - target)) / len(fitted) + PENALTY * v)
    z, ty = x[held] @ w, y[held]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(ty)), ty]).mean()) if len(ty) else 0.0

    return Classifier(classes, w, min(np.geomspace(0.05, 4, 40), key=loss))


def _paragraphs(texts: pd.Series) -> pd.Series:
    """(words, features) of the paragraphs that agree with no template, once each."""
    out = []
    for text in texts:
        found = {}
        for block in blocks(text or ""):
            for words in (*(ws for _, ws in block), [w for _, ws in block for w in ws]):
                at = features(words)
                if at and not any(agrees(words, t) for _, t in _TEMPLATES):
                    found[len(words), tuple(at)] = None
        out.append([{"n": n, "at": list(at)} for n, at in found])
    return pd.Series(out, dtype=object)


def train(docs: DataFrame) -> Classifier:
    """Fit with ordinary paragraphs, whole, from a bounded sample of documents.

    The driver gets their lengths and vocabulary numbers, of which a paragraph has at most the vocabulary's size.
    """
    small_batches(docs.sparkSession)
    listed = F.pandas_udf(_paragraphs, "array<struct<n:int,at:array<int>>>")
    rows = sample_rows(docs, SAMPLE_DOCS, "text").select(F.explode(listed("text")).alias("p")).select("p.n", "p.at").distinct()
    rows = rows.orderBy(F.xxhash64("n", "at"), "n", "at").limit(SAMPLE_PARAGRAPHS)
    return fit(sorted((r["n"], list(r["at"])) for r in rows.collect()))


def find_notices(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add an array ``notices`` of (line, family, p)."""
    small_batches(docs.sparkSession)
    docs = apart(docs, ["notices"])

    @F.pandas_udf("array<struct<line:int,family:string,p:double>>")
    def scanned(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"line": i, "family": f, "p": p} for i, f, p in model.scan(t)] for t in texts], dtype=object)

    return docs.withColumn("notices", scanned(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: its notices and their families."""
    out = find_notices(docs.select("doc_id", "text"), train(docs))
    return out.select(
        "doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct(F.expr("transform(notices, x -> x.family)"))), ",").alias("families"),
        F.expr("array_join(transform(notices, x -> concat(x.line, ':', x.family)), ',')").alias("notices"), F.expr("array_max(transform(notices, x -> x.p))").alias("score"),
    )
