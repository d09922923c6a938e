"""Licence scans: a trained paragraph classifier whose predictions templates confirm.

Paragraphs are lines, and lines without a wordless one between them are also read as one, without their
comment markers, so that wrapped notices are whole.  More than ``WINDOW`` words are cut into windows that overlap by half.  A
logistic regression over word 1- to 3-grams tells licence families and ``unknown``; its temperature is
set on variants that it was not trained on.  A predicted family is confirmed if a template of it has
``SIMILARITY`` of its word 5-grams in the paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import frugal
from .columns import packed, passing, unpacked

UNKNOWN_FAMILY = "unknown"
#: Customary notices and opening clauses of licence families.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "MPL": ("Released under the Mozilla Public License 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "Proprietary": ("Copyright. All rights reserved. No part of this work may be reproduced without permission.", "This software is confidential and proprietary. Unauthorized copying of this file is strictly prohibited."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Lines that speak of licences but are no notices.
NO_NOTICES = (
    "The driver lost his license last year.",
    "A license to operate the machine is required by the city.",
    "They released the new version of the software under great pressure.",
    "The general public was not admitted to the work.",
    "Permission to enter the building is granted by the office.",
    "The terms of the contract are subject to law.",
    "Version 2.0 of the source code was published in March.",
)

SHINGLE, SIMILARITY, THRESHOLD = 5, 0.8, 0.5
GRAMS, WINDOW = 3, 64
#: Lines of the corpus that stand for unknown in training, at most; variants of a template; steps and weight decay of the fit.
NEGATIVES, VARIANTS, STEPS, DECAY = 2000, 40, 300, 1e-4
#: What comments have before the text of a line.
_MARKER = re.compile(r"^\s*(?:/\*+|\*+|//+|#+|;+|--+|%+|>+|<!--)+")
_WORD = re.compile(r"[\w.+-]*\w[+]*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(found: Sequence[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


class Classifier:
    """Weights by feature; features are words and n-grams of such words, as tuples."""

    def __init__(self, families: list[str], features: dict[tuple[str, ...], int], weights: np.ndarray, bias: np.ndarray, templates: dict[str, list[set]]):
        self.families, self.features, self.weights, self.bias, self.templates = families, features, weights, bias, templates
        self.single = {f[0]: i for f, i in features.items() if len(f) == 1}

    def ids(self, found: Sequence[str]) -> list[int]:
        """Ids of the features; an n-gram is one only if all its words are."""
        single, features, out, run = self.single, self.features, [], 0
        for k, w in enumerate(found):
            i = single.get(w)
            if i is None:
                run = 0
                continue
            run += 1
            out.append(i)
            for n in range(2, min(run, GRAMS) + 1):
                if (j := features.get(tuple(found[k - n + 1 : k + 1]))) is not None:
                    out.append(j)
        return out

    def probabilities(self, windows: Sequence[Sequence[str]]) -> np.ndarray:
        ids = [self.ids(w) for w in windows]
        flat = np.array([i for x in ids for i in x], np.int64)
        total = np.vstack([np.zeros(len(self.bias)), np.cumsum(self.weights[flat], axis=0)]) if len(flat) else np.zeros((1, len(self.bias)))
        ends = np.cumsum([len(x) for x in ids])
        z = total[ends] - total[ends - [len(x) for x in ids]] + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of paragraphs, and what was predicted in them."""
        windows, first, last, number, block = [], [], [], 0, []

        def cut(found: list[str], line: Sequence[int]) -> None:
            for k in range(0, max(1, len(found) - WINDOW // 2), WINDOW // 2) if len(found) > WINDOW else (0,):
                windows.append(found[k : k + WINDOW])
                first.append(line[k])
                last.append(line[min(k + WINDOW, len(found)) - 1])

        lines = []
        for line in text.split("\n"):
            found = words(line)
            if found:
                cut(found, [number] * len(found))
                block.append((number, words(_MARKER.sub("", line))))
                number += 1
            else:
                lines.append(block)
                block = []
        alone = len(windows)
        for block in [*lines, block]:
            if len(block) > 1:
                cut([w for _, found in block for w in found], [n for n, found in block for _ in found])
        out, known = [], {}
        for begin in range(0, len(windows), 4096):
            some = windows[begin : begin + 4096]
            p = self.probabilities(some)
            best = p[:, 1:].argmax(axis=1) + 1
            for k in np.flatnonzero(p[np.arange(len(some)), best] >= THRESHOLD):
                family, own, w = self.families[best[k]], shingles(some[k]), begin + k
                similar = max(len(own & t) / len(t) for t in self.templates[family])
                sure = similar >= SIMILARITY
                # lines put together add what no line or window that they overlap has shown
                if w >= alone and any((family, n) in known and known[family, n] >= sure for n in range(first[w], last[w] + 1)):
                    continue
                for n in range(first[w], last[w] + 1):
                    known[family, n] = max(sure, known.get((family, n), False))
                out.append({"paragraph": first[w], "family": family, "probability": float(p[k, best[k]]), "similarity": similar, "confirmed": sure})
        out.sort(key=lambda f: f["paragraph"])
        return number, out


def fit(df: DataFrame, key: str, text: str, templates: dict[str, tuple[str, ...]] = TEMPLATES, negatives: int = NEGATIVES, seed: int = 3) -> Classifier:
    """Trains on variants of the templates, and for ``unknown`` on at most ``negatives`` windows of lines of ``df``, chosen by hash, that resemble no template.

    An empty table, or one of null texts: the lines of ``NO_NOTICES`` stand for unknown alone."""
    rows = max(1, df.count())
    share = F.shiftrightunsigned(F.xxhash64(f"`{key}`", F.lit("fit")), 11) / F.lit(float(2**53))
    lines = df.where(share < min(1.0, negatives / rows)).select(F.explode(F.split(f"`{text}`", "\n")).alias("line")).select(F.split(F.trim("line"), r"\s+").alias("words"))
    # long lines are cut into windows, as they are in scans
    cuts = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(WINDOW))
    lines = lines.select("words", F.explode(cuts).alias("at")).select(F.array_join(F.slice("words", F.col("at"), F.lit(WINDOW)), " ").alias("line"))
    lines = lines.orderBy(F.xxhash64("line"), "line").limit(negatives).collect()
    return train([r[0] for r in lines], templates, seed)


def train(lines: Sequence[str], templates: dict[str, tuple[str, ...]] = TEMPLATES, seed: int = 3) -> Classifier:
    rng = np.random.default_rng(seed)
    families = [UNKNOWN_FAMILY, *sorted(templates)]
    known = {f: [shingles(words(t)) for t in templates[f]] for f in templates}
    every = set().union(*[s for x in known.values() for s in x])
    other = [w for line in [*NO_NOTICES * 10, *lines] if (w := words(line)) and not (shingles(w) & every)]
    noise = sorted({w for x in other for w in x}) or ["noise"]
    samples, labels = [], []
    for k, name in enumerate(families[1:], 1):
        for t in templates[name]:
            whole = words(t)
            for v in range(VARIANTS):
                w = [x for x in whole if rng.random() >= (0.0, 0.05, 0.12)[v % 3]] or whole
                extra = [noise[i] for i in rng.integers(0, len(noise), rng.integers(0, 12) if v % 2 else 0)]
                at = int(rng.integers(0, len(extra) + 1))
                samples.append([*extra[:at], *w, *extra[at:]])
                labels.append(k)
    for w in other:
        for k in range(0, len(w), WINDOW):  # words may be more than what white space separates
            samples.append(w[k : k + WINDOW])
            labels.append(0)
    # unknown also means the words of templates in any order
    common = sorted({w for x in templates.values() for t in x for w in words(t)})
    for _ in range(VARIANTS * 5):
        samples.append([common[i] for i in rng.integers(0, len(common), rng.integers(2, 12))])
        labels.append(0)
    grams = lambda w: [tuple(w[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1)]
    vocabulary = {f: i for i, f in enumerate(sorted({g for x in templates.values() for t in x for g in grams(words(t))}))}
    model = Classifier(families, vocabulary, np.zeros((len(vocabulary), len(families))), np.zeros(len(families)), known)
    x = np.zeros((len(samples), len(vocabulary)))
    for r, s in enumerate(samples):
        np.add.at(x[r], model.ids(s), 1)
    y, apart = np.array(labels), rng.random(len(samples)) < 0.2
    goal = np.eye(len(families))[y]
    weigh = (len(y) / np.bincount(y, minlength=len(families)).clip(1))[y]
    weigh /= weigh[~apart].mean()

    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    w, b = model.weights, model.bias
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    xt, gt, wt = x[~apart], goal[~apart], weigh[~apart, None]
    for step in range(1, STEPS + 1):  # Adam
        d = (softmax(xt @ w + b) - gt) * wt / len(xt)
        for v, g, m, s in ((w, xt.T @ d + DECAY * w, state[0], state[1]), (b, d.sum(axis=0), state[2], state[3])):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    z = x[apart] @ w + b
    loss = lambda t: -np.log(softmax(z * t)[np.arange(len(z)), y[apart]].clip(1e-12)).mean()
    t = min((0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5), key=loss) if len(z) else 1.0
    model.weights, model.bias = w * t, b * t
    return model


FINDING = T.StructType().add("paragraph", "long").add("family", "string").add("probability", "double").add("similarity", "double").add("confirmed", "boolean")


def scan(df: DataFrame, text: str, model: Classifier) -> DataFrame:
    """Replaces ``text`` by ``n_paragraphs`` and ``findings``, all predictions in order of paragraphs.  No shuffle.

    Null and empty texts have no paragraphs; lines without words count for none.  Whole texts are read, in windows, however long.  Of families that are
    equally probable the first by name is predicted; equal texts get equal findings.  Other columns pass; those of the added names are replaced.
    An empty table gives no rows."""
    rest = passing(df, (text, "n_paragraphs", "findings"))
    rows = df.select(packed(rest), F.col(f"`{text}`").alias("text"))
    schema = rows.select("row").schema.add("n_paragraphs", "long").add("findings", T.ArrayType(FINDING))
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [model.scan(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], kind)], schema.names)

    return unpacked(rows.mapInArrow(frugal(run), schema), rest, "n_paragraphs", "findings")
