"""Licence scan: a trained paragraph classifier, confirmed by templates.

Paragraphs are lines.  A multinomial logistic regression on sparse word n-grams (one to three words) tells the licence
families apart, with a class "unknown" for everything else, trained on paragraphs of the corpus and on wording that
is legal but no licence.  Its probabilities are calibrated by a temperature on generated paragraphs that were not used
for the fit.  A family is confirmed only if enough of the paragraph's word pairs stand in one of the family's templates.
A paragraph goes to the classifier unless it has too few template word pairs to be confirmed for any family, so this filter
drops no licence.  Paragraphs of more than LONG words are judged in a window around each place with a template word pair.

Training paragraphs are made from the templates: cut, with words dropped, exchanged or put in front.  At most
NEGATIVES corpus paragraphs (a documented bound, picked by hash from about as many documents) go with them.

Defined cases: null and empty texts have no paragraph and no licence; repeated rows get equal results; an empty
table gives an empty result (the templates alone train the model); further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled

#: Notices by licence family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution-ShareAlike license.",
        "Published under CC-BY 4.0.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU Lesser General Public License, version 2.1 or later.",
        "Licensed under the GPL v3.",
        "Released under GPLv3.",
        "This program is free software under the terms of the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "public": (
        "This file is in the public domain under CC0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain.",
        "Dedicated to the public domain under the CC0 1.0 Universal licence.",
    ),
    "proprietary": (
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This material is proprietary and confidential and may not be copied without written consent.",
    ),
}
#: Legal or technical wording that grants or reserves nothing.
OTHERS = (
    "The driver renewed the license of his car in version two of the form.",
    "We released the record under the name of the band.",
    "The public license office is free and open to the general public.",
    "The court held that the permission was granted under the terms of the contract.",
    "The software version 2.0 was released with new files and documentation.",
    "The apache helicopter and the general were in the work.",
    "All seats are reserved and all rights of way are marked.",
    "The university MIT published the work of the general public.",
    "He reserved the right to copy the article at the library.",
    "The foundation distributed copies of the free publication.",
    "The doctor kept his license to practise under the terms of the board.",
    "The photograph was released into the public by the author of the work.",
    "He used the general public library and its domain of free works.",
    "Any person may use the software for the purpose of this course without a fee.",
    "The eclipse was seen in public and the materials were made available in the program.",
)
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
#: Corpus paragraphs among the negatives at most, and the longest of them, so that they fit on the driver.
NEGATIVES, NEGATIVE_LENGTH = 2000, 2000
CONFIRM = 0.6
SCORE = 0.5
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def tokens(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(words: list[str], longest: int = 3) -> set[str]:
    """Indicators of n-grams of one to ``longest`` words, with a mark at both ends."""
    marked = ["<", *words, ">"]
    return {" ".join(marked[i : i + n]) for n in range(1, longest + 1) for i in range(len(marked) - n + 1)}


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weights: np.ndarray  # n-grams and a bias by families
    temperature: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [self.index[g] for g in grams(words) if g in self.index]
        z = (self.weights[at].sum(0) / max(len(at), 1) ** 0.5 + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _made(rng: np.random.Generator, text: str, filler: list[str]) -> list[str]:
    words = tokens(text)
    if len(words) > 6 and rng.random() < 0.4:
        a = int(rng.integers(0, len(words) // 3))
        words = words[a : max(a + 4, len(words) - int(rng.integers(0, len(words) // 3)))]
    words = [filler[rng.integers(len(filler))] if rng.random() < 0.05 else w for w in words if rng.random() > 0.05] or words
    if rng.random() < 0.25:
        words = [filler[i] for i in rng.integers(len(filler), size=rng.integers(1, 5))] + words
    return words


def train(negatives: list[str], seed: int = 11, copies: int = 30, rounds: int = 300) -> Model:
    """Fit on generated paragraphs and negatives by gradient descent; calibrate on others of the same make."""
    rng = np.random.default_rng(seed)
    filler = sorted({w for t in [*OTHERS, *negatives[:200]] for w in tokens(t)})
    rows: list[tuple[list[str], int]] = []
    for k, family in enumerate(TEMPLATES, 1):
        for text in TEMPLATES[family]:
            rows += [(tokens(text), k)] + [(_made(rng, text, filler), k) for _ in range(copies)]
    for text in OTHERS:
        rows += [(_made(rng, text, filler), 0) for _ in range(copies)]
    rows += [(tokens(t), 0) for t in negatives]
    order = rng.permutation(len(rows))
    fit_rows, own_rows = [rows[i] for i in order if i % 4], [rows[i] for i in order if i % 4 == 0]
    index: dict[str, int] = {}
    licensed = [grams(w) for w, k in fit_rows if k]
    seen: dict[str, int] = {}
    for g in licensed:
        for x in g:
            seen[x] = seen.get(x, 0) + 1
    for x in sorted(x for x, n in seen.items() if n >= 3):
        index[x] = len(index)

    def matrix(rows: list[tuple[list[str], int]]) -> np.ndarray:
        x = np.zeros((len(rows), len(index) + 1), np.float32)
        for i, (words, _) in enumerate(rows):
            at = [index[g] for g in grams(words) if g in index]
            x[i, at] = 1 / max(len(at), 1) ** 0.5
        x[:, -1] = 1
        return x

    x, y = matrix(fit_rows), np.eye(len(FAMILIES), dtype=np.float32)[[k for _, k in fit_rows]]
    w = np.zeros((x.shape[1], len(FAMILIES)), np.float32)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - 2.0 * (x.T @ (p - y) / len(x) + 1e-4 * w)
        w += speed
    z, truth = matrix(own_rows) @ w, np.array([k for _, k in own_rows])

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), truth]).mean())

    temperature = min((0.25 * 1.15**i for i in range(25)), key=loss)
    return Model(index, w, temperature)


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


_TEMPLATE_PAIRS = {f: [_pairs(tokens(t)) for t in ts] for f, ts in TEMPLATES.items()}
_ANY_PAIR = frozenset().union(*(p for ps in _TEMPLATE_PAIRS.values() for p in ps))
#: Template word pairs without which ``confirmed`` stays below CONFIRM for every family: its least denominator is 3, or a template's.
LEAST_PAIRS = math.ceil(CONFIRM * min(3, *(len(p) for ps in _TEMPLATE_PAIRS.values() for p in ps)))
#: Words of a paragraph that is judged as a whole at most; words before and after a place in a longer one.
LONG, BEFORE, AFTER = 60, 15, 30


def confirmed(words: list[str], family: str) -> float:
    """Share of a template's word pairs in the paragraph, or of the paragraph's in the template: the better one."""
    own = _pairs(words)
    best = 0.0
    for pairs in _TEMPLATE_PAIRS[family]:
        common = len(own & pairs)
        best = max(best, common / len(pairs), common / len(own) if len(own) >= 3 else 0.0)
    return best


def candidates(words: list[str]) -> list[list[str]]:
    """The paragraph, or its windows if it is long, that have template word pairs enough to be confirmed."""
    spots = [i for i, pair in enumerate(zip(words, words[1:])) if pair in _ANY_PAIR]
    if len(spots) < LEAST_PAIRS:
        return []
    if len(words) <= LONG:
        return [words]
    windows = (words[max(0, i - BEFORE) : i + AFTER] for i in spots)
    return [w for w in windows if len(_pairs(w) & _ANY_PAIR) >= LEAST_PAIRS]


def confirmable(words: list[str]) -> bool:
    return any(confirmed(w, f) >= CONFIRM for w in candidates(words) for f in TEMPLATES)


def judge(text: str | None, model: Model) -> tuple[str | None, float, int, str]:
    """(family, score, number of licence paragraphs, all families) of a text; family is None without a licence."""
    found: dict[str, float] = {}
    n = 0
    for line in (text or "").split("\n"):
        best = None
        for words in candidates(tokens(line)):
            p = model.probabilities(words)
            k = int(p.argmax())
            if k and p[k] >= SCORE and confirmed(words, FAMILIES[k]) >= CONFIRM and (best is None or p[k] > best[1]):
                best = (FAMILIES[k], float(p[k]))
        if best:
            n += 1
            found[best[0]] = max(best[1], found.get(best[0], 0.0))
    if not found:
        return None, 0.0, 0, ""
    family = min(found, key=lambda f: (-found[f], f))
    return family, found[family], n, ",".join(sorted(found))


def scan(docs: DataFrame, negatives: int = NEGATIVES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence, score, n_paragraphs, families of every document; a map over the scan."""
    # Lines of about as many documents as lines are wanted; then as many of them.
    few = F.pmod(F.xxhash64(text_col), F.lit(labelled.RANGE)) < int(min(1.0, negatives / max(docs.count(), 1)) * labelled.RANGE)
    lines = docs.where(few).select(F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    fair = lines.where(F.length("line").between(1, NEGATIVE_LENGTH)).orderBy(F.xxhash64("line"), "line").limit(negatives)
    model = train(sorted(t for (t,) in fair.collect() if not confirmable(tokens(t))))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, model) for t in batch.column("text").to_pylist()]
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "licence", "score", "n_paragraphs", "families"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, licence string, score double, n_paragraphs long, families string"
    )
