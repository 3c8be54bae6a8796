"""Licence scan: a trained paragraph classifier, confirmed by templates.

A text is cut into units, its sentences and lines, and runs of 1 to 16 units of one
paragraph (lines without a blank one between) are read as sparse vectors of hashed word
unigrams and bigrams, so that a statement is found inside a long line as well as over
several wrapped ones.  A multinomial logistic regression over the licence families and
"unknown" is fitted on the driver, on a bounded sample: variations of the templates below,
sentences that only speak of licences, and passages of the corpus as unknown ones: the
``sample_rows`` non-blank lines with the smallest hashes, each with the 15 lines after it.
Passages are parted by document: three in five documents' are learned from, as runs of all lengths of
RUNS; those of the others calibrate the unknown class.  The temperature minimises the loss on them and on a held-out
fifth of the variations; the least probability is one that no more than one in a thousand unknown runs of the documents held
out reach (one, if they are fewer).  Passages that share half of a template with a licence, or name one in full, are left out.

Every run of every text is classified; its vector is the sum of its units' vectors.  A
prediction is confirmed if SIMILARITY or more of the five-word shingles of one of the
family's templates (of the whole template, if that is shorter) stand in the run.  Of
overlapping predictions the confirmed one of the largest similarity stays, then the
shortest run, then the first; of unconfirmed ones the most probable.

Defined cases: a null or blank text has no paragraphs and no licence; texts are read
whole, however long; equal rows give equal results; ties between families go to the first
by name; an empty corpus is classified by the templates alone; ids may be null or repeat;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import small_batches

UNKNOWN = "unknown"
SHINGLE, SIMILARITY = 5, 0.8
BUCKETS = 1 << 14
RUNS = (1, 2, 3, 4, 6, 8, 12, 16)

# How the licences are named, and usual wordings of notices and texts.
NAMES = {
    "agpl-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL version 3 or later", "AGPL-3.0"],
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 license", "Apache-2.0"],
    "bsd-3-clause": ["the BSD 3-Clause License", "the 3-clause BSD license", "BSD-3-Clause"],
    "cc-by-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "cc0-1.0": ["CC0 1.0", "the CC0 1.0 Universal public domain dedication", "CC0-1.0"],
    "epl-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2", "EPL-2.0"],
    "gpl-2.0": ["the GNU General Public License, version 2", "the GNU GPL version 2", "GPL-2.0"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU GPL version 3 or later", "GPL-3.0"],
    "isc": ["the ISC License", "the terms of the ISC license", "ISC"],
    "lgpl-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL version 3", "LGPL-3.0"],
    "mit": ["the MIT License", "the terms of the MIT license", "MIT"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"],
    "proprietary": [],
    "unlicense": ["the Unlicense", "the terms of the Unlicense", "Unlicense"],
}
STATEMENTS = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This program is licensed under {}.", "Distributed under {}."]
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
BODIES = {
    "agpl-3.0": [_GNU.format("Affero General", 3)], "gpl-2.0": [_GNU.format("General", 2)], "gpl-3.0": [_GNU.format("General", 3)], "lgpl-3.0": [_GNU.format("Lesser General", 3)],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission.", "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
TEMPLATES = {
    family: [
        *(s.format(n) for n in names[:2] for s in STATEMENTS), *(f"SPDX-License-Identifier: {n}" for n in names[2:]), *BODIES.get(family, []),
    ]
    for family, names in NAMES.items()
}
#: Sentences with the words of licences that license nothing.
TALK = [
    "A driving license must be shown at the desk.", "The license fee is due on the first day of the term.", "He was licensed to practise medicine in two states.",
    "Version 2 of the report was released under pressure.", "The general public was not admitted.", "Permission to leave was granted by the court.",
    "Under the terms of the lease the tenant pays.", "The committee released version 3 of the plan.", "All rights of way are shown on the map.", "The work is under way and free of charge.",
    "The parties shall agree on a license before the work is distributed.", "She reserved all the rooms for the guests.", "A copy of the notice is kept with the files of the program.",
]
FILLER = "notice see file header project copy holder author text page more details here also note year name site data set part code home".split()
_KEEP = bytes(c if chr(c).isalnum() or c == 10 or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))
_FOLD = bytes(_KEEP[c] | 32 if 65 <= c <= 90 else _KEEP[c] for c in range(256))


_CUT = _FOLD[:1] + b"\x01" + _FOLD[2:]  # keeps the mark between sentences


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split()


def features(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all unigrams and bigrams, start of each line's); a line has words."""
    flat = [w for line in lines for w in line]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
    n = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(50)
    out = np.empty(2 * len(h) - len(lines), np.int64)
    at = np.arange(len(h)) * 2 - np.repeat(np.arange(len(lines)), n)
    out[at] = (h >> np.uint64(50)).astype(np.int64)
    inner = np.ones(len(h), bool)
    inner[starts + n - 1] = False
    out[at[inner] + 1] = two[np.flatnonzero(inner)].astype(np.int64) if len(two) else 0
    return out, starts * 2 - np.arange(len(lines))


@dataclass(frozen=True)
class Classifier:
    families: tuple[str, ...]  # the last is UNKNOWN
    weights: np.ndarray  # bucket x family
    bias: np.ndarray
    temperature: float
    least: float

    def sums(self, lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(summed weights, number of features) of each line."""
        buckets, starts = features(lines)
        return np.add.reduceat(self.weights[buckets], starts, axis=0), np.diff(np.r_[starts, len(buckets)])

    def of_sums(self, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _softmax((total / np.sqrt(size)[:, None] + self.bias) / self.temperature)

    def probabilities(self, lines: list[list[bytes]]) -> np.ndarray:
        return self.of_sums(*self.sums(lines))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def training_lines(seed: int = 7, copies: int = 16) -> tuple[list[list[bytes]], list[str]]:
    """Variations of the templates, and of sentences that license nothing."""
    rng = np.random.default_rng(seed)
    lines, labels = [], []
    fill = [w.encode() for w in FILLER]
    talk = [words_of(t) for t in TALK]
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, TALK)]:
        for text in texts:
            core = words_of(text)
            for _ in range(copies * (6 if family == UNKNOWN else 3 if len(texts) < 4 else 1)):
                words = list(core)
                if len(words) > 8 and rng.random() < 0.3:
                    del words[int(rng.integers(len(words)))]
                around = [[fill[int(i)] for i in rng.integers(len(fill), size=int(rng.integers(0, 6)))] for _ in range(2)]
                extra = talk[int(rng.integers(len(talk)))] if rng.random() < 0.2 else []
                lines.append(around[0] + words + around[1] + extra)
                labels.append(family)
    for _ in range(copies * 30):
        pool = fill + [w for t in talk for w in t]
        lines.append([pool[int(i)] for i in rng.integers(len(pool), size=int(rng.integers(1, 30)))])
        labels.append(UNKNOWN)
    return lines, labels


#: The families' full names, as whole runs of words.
_NAMED = [{b" ".join(words_of(n))} for names in NAMES.values() for n in names[:2] if len(words_of(n)) > 1]


def unknown_runs(passage: str, known: list[set[bytes]]) -> list[list[bytes]]:
    """The words of the runs from a passage's first unit on, of all lengths of RUNS in its paragraph; none if one is a licence's or names one."""
    units, _, paragraph, _ = units_of(passage)
    own = sum(x == 0 for x in paragraph)
    runs = [[w for u in units[:n] for w in u] for n in RUNS if n <= own]
    # The longest run holds the shingles of all others.
    return runs if runs and confirmed(runs[-1], known) < 0.5 and confirmed(runs[-1], _NAMED) < 1 else []


def fit(learned: list[str], held_out: list[str] = (), seed: int = 7, steps: int = 60) -> Classifier:
    """Fit on the templates' variations and the passages ``learned``, calibrate on the passages ``held_out`` of other documents."""
    lines, labels = training_lines(seed)
    known = [_shingles(words_of(t)) for texts in TEMPLATES.values() for t in texts]
    rng = np.random.default_rng(seed)
    held = [bool(x) for x in rng.random(len(lines)) < 0.2]
    for passages, apart in ((learned, False), (held_out, True)):
        runs = [r for text in passages for r in unknown_runs(text, known)]
        lines += runs
        labels += [UNKNOWN] * len(runs)
        held += [apart] * len(runs)
    families = (*TEMPLATES, UNKNOWN)
    y, held = np.array([families.index(x) for x in labels]), np.array(held)
    buckets, starts = features(lines)
    size = np.diff(np.r_[starts, len(buckets)])
    row = np.repeat(np.arange(len(lines)), size)
    met, column = np.unique(buckets, return_inverse=True)  # buckets that no line has keep the weight 0
    value = (1 / np.sqrt(size[row])).astype(np.float32)
    w, b = np.zeros((len(met), len(families)), np.float32), np.zeros(len(families))
    truth = np.eye(len(families))[y]
    balance = (1 / np.bincount(y[~held], minlength=len(families)).clip(1))[y] * (~held)
    balance /= balance.sum()
    m, v = np.zeros_like(w), np.zeros_like(w)

    def logits() -> np.ndarray:
        return np.add.reduceat(w[column] * value[:, None], starts, axis=0) + b

    for t in range(1, steps + 1):
        wrong = (_softmax(logits()) - truth) * balance[:, None]
        g = np.stack([np.bincount(column, wrong[row, f] * value, len(met)) for f in range(len(families))], 1).astype(np.float32)
        g += 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (g != 0)
        b -= 0.5 * wrong.sum(0)
    z = logits()[held]
    losses = {t: -np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean() for t in np.geomspace(0.05, 20, 40)}
    # Not so small that probabilities of float64 are all 1 and can't be told apart any more.
    temperature = max(float(min(losses, key=lambda t: losses[t])), float(np.ptp(z, axis=1).max(initial=0)) / 30)
    p = _softmax(z / temperature)[:, :-1].max(1)[y[held] == len(families) - 1]
    over = max(1, len(p) // 1000)  # runs that may be taken
    least = max(0.5, 1 - (1 - float(np.sort(p)[-over - 1])) * 0.999) if len(p) > over else 0.5  # a little over the next
    weights = np.zeros((BUCKETS, len(families)), np.float32)
    weights[met] = w
    return Classifier(families, weights, b.astype(np.float32), temperature, least)


def _shingles(words: list[bytes], most: int = SHINGLE) -> set[bytes]:
    size = min(most, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def confirmed(words: list[bytes], templates: list[set[bytes]]) -> float:
    """Largest share of a template's shingles that stand in the paragraph."""
    own: dict[int, set[bytes]] = {}
    best = 0.0
    for t in templates:
        if t:
            size = next(iter(t)).count(b" ") + 1  # all words of a template shorter than a shingle
            if size not in own:
                own[size] = _shingles(words, size)
            best = max(best, len(t & own[size]) / len(t))
    return best


def units_of(text: str | None) -> tuple[list[list[bytes]], list[int], list[int], int]:
    """(words, line number, paragraph number of each sentence or line, number of paragraphs)."""
    raw = (text or "").encode("utf-8").replace(b"\x01", b" ")
    for mark in (b". ", b"! ", b"? "):
        raw = raw.replace(mark, b"\x01")
    units, line_of, paragraph_of, paragraph, inside = [], [], [], -1, False
    for n, line in enumerate(raw.translate(_CUT).split(b"\n")):
        any_words = False
        for part in line.split(b"\x01"):
            words = part.split()
            if words:
                if not inside:
                    paragraph, inside = paragraph + 1, True
                any_words = True
                units.append(words)
                line_of.append(n)
                paragraph_of.append(paragraph)
        inside = any_words
    return units, line_of, paragraph_of, paragraph + 1


def predictions(c: Classifier, units: list[list[bytes]], group: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, stop, family, probability) of the runs of units of one group that are taken for a licence."""
    total, size = c.sums(units)
    total, size = np.r_[np.zeros((1, total.shape[1])), np.cumsum(total, 0, dtype=np.float64)], np.r_[0, np.cumsum(size)]
    out = []
    for n in RUNS:
        if n > len(units):
            break
        start = np.flatnonzero(group[: len(group) - n + 1] == group[n - 1 :])
        p = c.of_sums(total[start + n] - total[start], size[start + n] - size[start])
        best = p[:, :-1].argmax(1)
        top = p[np.arange(len(start)), best]
        hit = np.flatnonzero((top >= c.least) & (top > p[:, -1]))
        out += [(int(start[j]), int(start[j]) + n, int(best[j]), float(top[j])) for j in hit]
    return out


def chosen(c: Classifier, units: list[list[bytes]], found: list[tuple[int, int, int, float]], templates: list[list[set[bytes]]]) -> list[tuple[int, int, float, float]]:
    """(first unit, family, probability, similarity) of predictions that don't overlap."""
    scored = []
    for start, stop, family, p in found:
        share = confirmed([w for u in units[start:stop] for w in u], templates[family])
        scored.append(((share < SIMILARITY, -share if share >= SIMILARITY else 0.0, stop - start if share >= SIMILARITY else 0, -p, start, stop), start, stop, family, p, share))
    taken: set[int] = set()
    out = []
    for _, start, stop, family, p, share in sorted(scored):
        if not any(i in taken for i in range(start, stop)):
            taken.update(range(start, stop))
            out.append((start, family, p, share))
    return sorted(out)


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Classifier = model.value
        templates = [[_shingles(words_of(t)) for t in TEMPLATES.get(f, [])] for f in c.families]
        for b in batches:
            hits: list[list[dict]] = [[] for _ in range(len(b))]
            counts = [0] * len(b)
            units: list[list[bytes]] = []
            line_of: list[int] = []
            group: list[int] = []
            ends: list[int] = []  # units up to the end of each text held
            first = 0

            def settle() -> None:
                if units:
                    found: dict[int, list] = {}
                    for x in predictions(c, units, np.array(group)):
                        found.setdefault(x[0], []).append(x)
                    start = 0
                    for i, stop in enumerate(ends, first):
                        own = [x for at in range(start, stop) for x in found.get(at, ())]
                        if own:
                            hits[i] = [
                                {"paragraph": line_of[at], "family": c.families[f], "probability": round(p, 4), "similarity": round(s, 4), "confirmed": s >= SIMILARITY}
                                for at, f, p, s in chosen(c, units, own, templates)
                            ]
                        start = stop
                for x in (units, line_of, group, ends):
                    x.clear()

            for i, text in enumerate(b.column(1).to_pylist()):
                own, lines, paragraphs, counts[i] = units_of(text)
                base = group[-1] + 1 if group else 0
                units += own
                line_of += lines
                group += [base + x for x in paragraphs]
                ends.append(len(units))
                if len(units) >= 20_000:
                    settle()
                    first = i + 1
            settle()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(hits, _HITS)], ["doc_id", "n_paragraphs", "hits"])

    return run


_HITS = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))


def train(docs: DataFrame, sample_rows: int = 1500) -> Classifier:
    """Fit and calibrate on the passages that begin with the ``sample_rows`` non-blank lines of ``docs`` with the smallest hashes of (id, line number, line)."""
    cut = F.split("text", "\n")
    lines = docs.select(F.col("doc_id").cast("string").alias("id"), F.posexplode(cut).alias("pos", "line")).where(F.trim("line") != "")
    # Only hashes under a bound that some more lines than asked for have go to the driver, however many tasks there are.
    bound = -(2**63) + int(2**64 * min(1.0, 1.3 * sample_rows / max(1, lines.count())))
    passages = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.posexplode(cut).alias("pos", "line")).where(F.trim("line") != "")
    picked = passages.select("id", "line", F.xxhash64("id", "pos", "line").alias("h"), F.array_join(F.slice(cut, F.col("pos") + 1, max(RUNS)), "\n").alias("passage")).where(F.col("h") <= F.lit(min(bound, 2**63 - 1)))
    rows = picked.select("h", "line", "passage", (F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(5)) >= 3).alias("apart")).orderBy("h", "line", "passage").limit(sample_rows).collect()
    return fit([r["passage"] for r in rows if not r["apart"]], [r["passage"] for r in rows if r["apart"]])


def scan_licenses(docs: DataFrame, sample_rows: int = 1500) -> DataFrame:
    """doc_id, n_paragraphs, n_predicted, n_confirmed, family (of the first confirmed paragraph,
    else null), families (sorted), hits (paragraph: the number of its first line; family, probability, similarity, confirmed)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, sample_rows))  # BUCKETS x families weights
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").mapInArrow(
        _scan(model), f"doc_id {kind}, n_paragraphs bigint, hits array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>"
    )
    sure = F.filter("hits", lambda h: h["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size("hits").cast("bigint").alias("n_predicted"), F.size(sure).cast("bigint").alias("n_confirmed"),
        F.get(sure, F.lit(0))["family"].alias("family"), F.array_sort(F.array_distinct(F.transform(sure, lambda h: h["family"]))).alias("families"), "hits",
    )
