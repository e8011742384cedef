"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines. Relative frequencies of words and word pairs feed a multinomial logistic
regression over licence families and one class for everything else. It is fitted on a bounded sample:
the templates, up to ``MAX_LABELLED`` paragraphs of each family that name it (weak labels by pattern)
and ``MAX_OTHERS`` that name none, chosen by hash. A fifth of the sample is held out to calibrate the
probabilities by a temperature. A paragraph is reported if a family's calibrated probability reaches
``MIN_PROBABILITY`` and its word pairs agree with a template of that family; all else is unknown.

Defined cases: NULL and empty texts have no paragraphs and no licences. Blank lines count as no
paragraph. Rows are scanned one by one, repeated or not; an empty table gives no rows. Columns not in
``keep`` are ignored; a kept column with the name of a result gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomtext.llm.arrow import add_columns, texts

# Usual notices of licence families.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction.",
    ],
    "reserved": ["All rights reserved.", "Copyright 2024 by the author. All rights reserved."],
}
#: What names a family in a lower-cased paragraph, for weak labels.
LABELS = {
    "apache-2.0": r"apache license",
    "bsd": r"\bbsd\b.*licen[cs]e|redistribution and use in source",
    "cc-by-nc": r"\bcc by-nc|attribution-noncommercial",
    "cc-by": r"\bcc by [0-9]|creative commons attribution [0-9]",
    "gpl": r"gnu general public|\bgpl\b",
    "mit": r"\bmit licen[cs]e|permission is hereby granted, free",
    "reserved": r"all rights reserved",
}
OTHER = "other"
CLASSES = [*sorted(TEMPLATES), OTHER]
MAX_LABELLED, MAX_OTHERS = 500, 4000
MAX_FEATURES = 20_000
MIN_PROBABILITY = 0.5
MIN_AGREEMENT = 0.6
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
TEMPLATE_WEIGHT = 20


def terms(paragraph: str) -> list[str]:
    """Words and word pairs."""
    words = WORD.findall(paragraph.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@dataclass
class Model:
    """Weights of words and word pairs for each class; scores are means over a paragraph's
    known terms."""

    number: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray  # number of first word * words + number of second word, sorted
    pair_rows: np.ndarray
    is_term: np.ndarray  # per row of weights; words that only occur in pairs are none
    bias: np.ndarray
    temperature: float

    def probabilities(self, paragraphs: list[str]) -> np.ndarray:
        """Calibrated class probabilities, a row per paragraph."""
        words = [WORD.findall(p.lower()) for p in paragraphs]
        counts = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(words)), counts)
        get = self.number.get
        ids = np.fromiter((get(w, -1) for ws in words for w in ws), np.int64, int(counts.sum()))
        total = np.zeros((len(words), len(self.bias)))
        sizes = np.zeros(len(words))
        known = ids >= 0
        self._add(total, sizes, owner[known], ids[known])
        together = (owner[:-1] == owner[1:]) & known[:-1] & known[1:]
        if len(self.pairs) and together.any():
            key = ids[:-1][together] * len(self.number) + ids[1:][together]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            self._add(total, sizes, owner[1:][together][hit], self.pair_rows[at[hit]])
        z = (total / np.maximum(sizes, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def _add(self, total: np.ndarray, sizes: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> None:
        terms = self.is_term[rows]
        sizes += np.bincount(owner, terms, len(total))
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(owner, self.weights[rows, k], len(total))


def labelled_sample(docs: DataFrame, text: str) -> DataFrame:
    """(paragraph, label) rows of bounded number: weakly labelled families and other paragraphs."""
    lines = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("paragraph"))
    lowered = F.lower("paragraph")
    label = F.lit(OTHER)
    for family, pattern in reversed(LABELS.items()):
        label = F.when(lowered.rlike(pattern), F.lit(family)).otherwise(label)
    hint = lowered.rlike("licen[cs]e|rights|free|gpl|bsd|creative|cc by|redistribution")
    lines = lines.where(F.length("paragraph").between(8, 2000)).withColumn(
        "label", F.when(hint, label).otherwise(OTHER)
    )
    order = F.xxhash64("paragraph")
    named = lines.where(F.col("label") != OTHER).distinct()
    by_hash = Window.partitionBy("label").orderBy(order, "paragraph")
    ranked = named.withColumn("r", F.row_number().over(by_hash))
    some = ranked.where(F.col("r") <= MAX_LABELLED).drop("r")
    others = lines.where(F.col("label") == OTHER).orderBy(order, "paragraph").limit(MAX_OTHERS)
    spark = docs.sparkSession
    known = [(t, c) for c, ts in TEMPLATES.items() for t in ts for _ in range(TEMPLATE_WEIGHT)]
    return some.unionByName(others).unionByName(
        spark.createDataFrame(known, "paragraph string, label string")
    )


def train(docs: DataFrame, *, text: str = "text") -> Model:
    """Fits and calibrates the classifier on the bounded sample."""
    spark = docs.sparkSession
    rows = [(r.paragraph, r.label) for r in labelled_sample(docs, text).collect()]
    rows.sort()
    seen: dict[str, int] = {}
    for paragraph, _ in rows:
        for term in set(terms(paragraph)):
            seen[term] = seen.get(term, 0) + 1
    features = sorted((t for t, n in seen.items() if n > 1), key=lambda t: (-seen[t], t))[:MAX_FEATURES]
    place = {t: k for k, t in enumerate(features)}

    def vector(paragraph: str) -> SparseVector:
        found: dict[int, int] = {}
        for term in terms(paragraph):
            if term in place:
                found[place[term]] = found.get(place[term], 0) + 1
        size = sum(found.values())
        return SparseVector(len(place), {k: n / size for k, n in found.items()})

    data = [(vector(p), float(CLASSES.index(c))) for p, c in rows]
    fit_on = [d for k, d in enumerate(data) if k % 5]
    schema = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])
    frame = spark.createDataFrame(fit_on, schema).coalesce(2).cache()
    fitted = LogisticRegression(
        family="multinomial", regParam=1e-3, maxIter=60, standardization=True
    ).fit(frame)
    frame.unpersist()
    weights = fitted.coefficientMatrix.toArray().T.copy()
    bias = fitted.interceptVector.toArray()
    words = [t for t in features if " " not in t]
    number = {w: k for k, w in enumerate(words)}
    for term in features:  # a pair is met through its words
        for w in term.split(" "):
            number.setdefault(w, len(number))
    table = np.zeros((len(number), len(bias)))
    for w in words:
        table[number[w]] = weights[place[w]]
    pairs = [(t.split(" "), place[t]) for t in features if " " in t]
    keys = np.array([number[a] * len(number) + number[b] for (a, b), _ in pairs], np.int64)
    by = np.argsort(keys)
    table = np.concatenate([table, weights[[k for _, k in pairs]].reshape(-1, len(bias))])
    is_term = np.array([w in place for w in number] + [True] * len(pairs), float)
    pair_rows = (len(number) + np.arange(len(pairs)))[by]
    model = Model(number, table, keys[by], pair_rows, is_term, bias, 1.0)
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    truth = np.array([CLASSES.index(c) for _, c in held])
    losses = {}
    for temperature in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        model.temperature = temperature
        p = model.probabilities([x for x, _ in held])[np.arange(len(held)), truth]
        losses[temperature] = -np.log(np.maximum(p, 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    return model


def agreement(paragraph: str, family: str) -> float:
    """Share of the smaller set of word pairs, paragraph's or template's, that both have; the best."""
    def pairs(x: str) -> set:
        words = WORD.findall(x.lower())
        return set(zip(words, words[1:], strict=False)) or set(words)

    own, best = pairs(paragraph), 0.0
    for template in TEMPLATES[family]:
        its = pairs(template)
        if own:
            best = max(best, len(own & its) / min(len(own), len(its)))
    return best


def scan_licences(
    docs: DataFrame, *, model: Model | None = None, text: str = "text", keep: list[str]
) -> DataFrame:
    """The ``keep`` columns of every row with ``n_paragraphs``, and ``licences``: line, family and
    probability of each paragraph found."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text=text))
    found_type = pa.list_(
        pa.struct([("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64())])
    )

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        model = shared.value
        for (column,) in batches:
            bodies = texts(column)
            paragraphs, place, counts = [], [], []
            for k, body in enumerate(bodies):
                lines = [(n, x) for n, x in enumerate(body.split("\n")) if x and not x.isspace()]
                counts.append(len(lines))
                for n, x in lines:
                    paragraphs.append(x)
                    place.append((k, n))
            found = [[] for _ in bodies]
            p = model.probabilities(paragraphs) if paragraphs else np.zeros((0, len(CLASSES)))
            top = p[:, :-1].argmax(axis=1) if len(p) else np.empty(0, int)
            for i in np.flatnonzero(p[np.arange(len(p)), top] >= MIN_PROBABILITY):
                family = CLASSES[top[i]]
                if agreement(paragraphs[i], family) >= MIN_AGREEMENT:
                    k, n = place[i]
                    found[k].append({"line": n, "family": family, "probability": float(p[i, top[i]])})
            yield [pa.array(counts, pa.int64()), pa.array(found, found_type)]

    made = "n_paragraphs bigint, licences array<struct<line:bigint,family:string,probability:double>>"
    return add_columns(docs, keep, [text], made, compute)
