"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs are lines, and runs of lines that a notice is wrapped over. A sparse multinomial logistic regression over word 1- to 3-grams tells licence families from ordinary
text. It is trained on variants of the templates below (names, years and versions changed, words dropped, other
words around) and on a bounded sample of the corpus's own lines as the class none. A temperature,
fitted on a part that training doesn't see, calibrates its probabilities. A line that is probably a licence
but of no family with enough probability, or whose words don't match that family's templates well
enough, is of the family unknown.

Only lines with two cue words (words of templates that are no stop words) or an SPDX tag are classified; others are none by
definition, which whole-column operations decide. A run is the fewest lines, comment marks left out, that have CONFIRM of a
template's word pairs between them, and the lines next to it that go on with the template; its span takes the place
of spans of its family, or unknown ones, within it. Words outside the templates' vocabulary share one number.

Defined cases: null and empty texts have no licence; equal lines are classified alike; repeated rows are reported each; long
lines are read whole; an empty table gives no rows; other columns are carried; ties between families go to the one listed first.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, in_slices, table, words_of

# Public licence notices and statements, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "This document is confidential and proprietary. No part may be reproduced without prior written permission of the copyright holder.",
    ),
}
# Words too common to be a cue.
STOPS = frozenset("a all and any at be by can do for found following form free file has if in is it may no not obtain of one or part see that the this to use was were which with without work you your".split())

FAMILIES = list(TEMPLATES)
NONE = len(FAMILIES)
DIMS = 1 << 14
#: Lines of the corpus that train the class none at most, of whatever length.
SAMPLE_LINES = 1500
VARIANTS, SURE, CONFIRM = 24, 0.6, 0.5

#: Words that are a cue by themselves, and what stands at the start or end of a comment's lines.
STRONG = frozenset(["spdx-license-identifier"])
COMMENT = frozenset("/* /** * ** */ **/ // /// # ## ; ;; -- --- % %% <!-- --> rem dnl .\\\" ' !".split())

MARKS = "\"'()[]{}<>,;:!?*#|.“”«»"
NUMBER = re.compile(r"v?[0-9][0-9.]*")
SPANS = T.ArrayType(T.StructType([T.StructField("family", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())]))


def plain(word: str) -> str:
    return word.lower().strip(MARKS)


def words_in(line: str) -> list[str]:
    return [w for w in map(plain, re.split(r"[\x20\x09-\x0D]+", line)) if w]


@functools.cache
def vocabulary() -> dict[str, int]:
    """Numbers of the templates' words, from 1; 0 is every other word."""
    return {w: k for k, w in enumerate(sorted({w for lines in TEMPLATES.values() for t in lines for w in words_in(t)}), 1)}


@functools.cache
def cues() -> frozenset[str]:
    return frozenset(vocabulary()) - STOPS


def grams(line: str) -> np.ndarray:
    """Numbers of the distinct 1-, 2- and 3-grams of a line that have a word of the vocabulary."""
    known = vocabulary()
    ids = [known.get(w, 0) for w in words_in(line)]
    out = set()
    for n in (1, 2, 3):
        for k in range(len(ids) - n + 1):
            part = ids[k : k + n]
            if any(part):
                h = n
                for x in part:
                    h = (h * 1_000_003 + x) & 0xFFFFFFFF
                out.add((h ^ h >> 15) * 0x2C1B3C6D % DIMS)
    return np.array(sorted(out), np.int64)


@functools.cache
def template_pairs(family: int) -> tuple[frozenset, ...]:
    return tuple(frozenset(pairs(words_in(t))) for t in TEMPLATES[FAMILIES[family]])


def pairs(words: list[str]) -> list[tuple]:
    """Word pairs of a line; numbers are all alike, and a single word pairs with nothing."""
    words = ["0" if NUMBER.fullmatch(w) else w for w in words]
    return list(zip(words, [*words[1:], ""], strict=True)) if words else []


@functools.cache
def own_pairs(family: int) -> frozenset:
    """Word pairs that only this family's templates have; numbers, which versions share, tell nothing."""
    others = frozenset().union(*(t for f in range(NONE) if f != family for t in template_pairs(f)))
    return frozenset(p for t in template_pairs(family) for p in t if p not in others and p[1] != "0" and not (p[0] == "0" and not p[1]))


def likeness(line: str, family: int) -> float:
    """The share of a template's word pairs that the line has, at best over the family's templates of whose own pairs it has most."""
    have, own = set(pairs(words_in(line))), own_pairs(family)
    return max(len(have & t) / len(t) if 2 * len(have & own & t) > len(own & t) else 0.0 for t in template_pairs(family))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # DIMS x (families + none)
    bias: np.ndarray
    temperature: float

    def probabilities(self, line: str) -> np.ndarray:
        z = (self.weights[grams(line)].sum(0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def classify(self, line: str) -> tuple[str, float] | None:
        """(family, probability), or None for ordinary text."""
        p = self.probabilities(line)
        if p[NONE] >= 0.5:
            return None
        best = int(np.argmax(p[:NONE]))
        if p[best] >= SURE and likeness(line, best) >= CONFIRM:
            return FAMILIES[best], float(p[best])
        return "unknown", float(1 - p[NONE])


def is_candidate(line: str) -> bool:
    words = [plain(w) for w in re.split(r"[\x20\x09-\x0D]+", line)]
    return sum(w in cues() for w in words) >= 2 or any(w in STRONG for w in words)


def uncommented(line: str) -> list[str]:
    """The words of a line as pairs has them, without the marks of a comment around them."""
    words = line.split()
    while words and (words[0].lower() in COMMENT):
        del words[0]
    while words and words[-1].lower() in COMMENT:
        del words[-1]
    return [w for w in map(plain, words) if w]


def wrapped(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """(first line, last line, family, probability) of notices that run over several lines."""
    lines = [uncommented(x) for x in text.split("\n")]
    words = [(w, k) for k, line in enumerate(lines) for w in line]
    after = pairs([w for w, _ in words])
    runs: list[tuple[int, int, int]] = []
    for family in range(NONE):
        for t in template_pairs(family):
            # (line of the first word, line of the second, pair); a line's end may be the template's
            hits = []
            for k, (pair, (_, line)) in enumerate(zip(after, words, strict=True)):
                last = k + 1 == len(words) or words[k + 1][1] != line
                if pair in t:
                    hits.append((line, words[k + 1][1] if k + 1 < len(words) else line, pair))
                if last and pair[1] and (pair[0], "") in t:
                    hits.append((line, line, (pair[0], "")))
            if len({h[2] for h in hits}) < CONFIRM * len(t):
                continue
            own = {line for line, _, _ in hits} | {line for _, line, _ in hits}
            share = {k: sum(p in t for p in pairs(lines[k])) * 2 >= max(1, len(lines[k]) - 1) for k in own}
            window: list[tuple[int, int, tuple]] = []
            for hit in sorted(hits, key=lambda h: (h[1], h[0])):
                window.append(hit)
                if len({h[2] for h in window}) < CONFIRM * len(t):
                    continue
                last = hit[1]
                first = max(k for k in {h[0] for h in window} if len({h[2] for h in window if h[0] >= k}) >= CONFIRM * len(t))
                window = [h for h in window if h[0] > first]
                if first == last or sum(map(len, lines[first : last + 1])) > 2 * len(t) + 10:
                    continue
                while share.get(first - 1):
                    first -= 1
                while share.get(last + 1):
                    last += 1
                window = [h for h in window if h[0] > last]
                runs.append((-len({h[2] for h in hits if first <= h[0] and h[1] <= last}), first, last))
    found: list[tuple[int, int, str, float]] = []
    for _, first, last in sorted(runs):  # what has most of a template goes before shorter templates' parts of it
        got = model.classify(" ".join(w for line in lines[first : last + 1] for w in line))
        if got is not None and not any(f == got[0] and a <= last and first <= b for a, b, f, _ in found):
            found.append((first, last, *got))
    return found


@functools.cache
def pair_table() -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Of templates' word pairs with a cue: their numbers, and by template its own and how many of them half of the template needs."""
    number = numbers()
    out = []
    for family in range(NONE):
        for t in template_pairs(family):
            own = [number[a] * len(number) + number[b] for a, b in t if b and (a in cues() or b in cues())]
            out.append((np.array(sorted(own), np.int64), max(1, int(np.ceil(CONFIRM * len(t))) - (len(t) - len(own)))))
    return np.unique(np.concatenate([own for own, _ in out])), out


@functools.cache
def numbers() -> dict[str, int]:
    """Numbers of the words that pairs of templates have; 0 is any other word."""
    return {"": 0} | {w: k for k, w in enumerate(sorted({w for f in range(NONE) for t in template_pairs(f) for p in t for w in p if w}), 1)}


def may_be_wrapped(owner: np.ndarray, codes: np.ndarray, core: list[str], raw: list[str]) -> np.ndarray:
    """Rows (owner has each word's) that have as many pairs of some template as a run needs."""
    number = numbers()
    of = np.array([-1 if not w or r.lower() in COMMENT else number.get("0" if NUMBER.fullmatch(w) else w, 0) for w, r in zip(core, raw, strict=True)], np.int64)[codes]
    owner, of = owner[of >= 0], of[of >= 0]
    key = of[:-1] * len(number) + of[1:]
    every, templates = pair_table()
    at = np.flatnonzero((of[:-1] > 0) & (of[1:] > 0) & (owner[:-1] == owner[1:]))
    at = at[np.isin(key[at], every)]
    rows, which = owner[at], key[at]
    if not len(rows):
        return rows
    both = np.unique(np.stack([rows, which], 1), axis=0)
    found = []
    for own, need in templates:
        mine, n = np.unique(both[np.isin(both[:, 1], own), 0], return_counts=True)
        found.append(mine[n >= need])
    return np.unique(np.concatenate(found))


def train(lines: list[str], seed: int = 5, steps: int = 150) -> Model:
    """The model from template variants and lines of the corpus; lines that repeat a template are no examples of none."""
    rng = np.random.default_rng(seed)
    fillers = [w for t in lines[:200] for w in t.split()][:2000] or ["lorem", "ipsum", "dolor"]
    texts, labels = [], []
    for family, templates in enumerate(TEMPLATES.values()):
        for t in templates:
            for k in range(VARIANTS):
                words = t.split()
                if k:
                    keep = rng.random(len(words)) > (0.15 if len(words) > 8 else 0.0)
                    words = [w for w, x in zip(words, keep, strict=True) if x] or words
                    some = lambda n: [str(w) for w in rng.choice(fillers, rng.integers(0, n))]
                    words = some(5) + words + some(5)
                texts.append(" ".join(words))
                labels.append(family)
    for line in lines:
        if max(likeness(line, f) for f in range(NONE)) < CONFIRM:
            texts.append(line)
            labels.append(NONE)
    for _ in range(400):  # words of the templates in no order are no licence
        texts.append(" ".join(str(w) for w in rng.choice(list(vocabulary()) + fillers, rng.integers(3, 30))))
        labels.append(NONE)
    y = np.array(labels)
    rows = [grams(t) for t in texts]
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    test = rng.random(len(y)) < 0.2
    w, bias = np.zeros((DIMS, NONE + 1)), np.zeros(NONE + 1)
    squares, squares_b = np.full_like(w, 1e-6), np.full(NONE + 1, 1e-6)
    hot = np.eye(NONE + 1)[y] * ~test[:, None]

    def scores() -> np.ndarray:
        z = np.zeros((len(y), NONE + 1))
        np.add.at(z, owner, w[flat])
        return z + bias

    for _ in range(steps):
        z = scores()
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True)) * ~test[:, None] - hot
        gradient = np.zeros_like(w)
        np.add.at(gradient, flat, error[owner])
        squares += gradient**2
        squares_b += error.sum(0) ** 2
        w -= 0.3 * gradient / np.sqrt(squares)
        w = np.sign(w) * np.maximum(np.abs(w) - 2e-3, 0)  # the lasso's pull keeps it sparse
        bias -= 0.3 * error.sum(0) / np.sqrt(squares_b)
    z = scores()[test]

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), y[test]]).mean())

    return Model(w, bias, min(np.geomspace(0.5, 4, 15), key=loss))


def sample(docs: DataFrame) -> list[str]:
    """Lines of the corpus for the class none: of all lines, in so many classes by hash, the one of least hash. How often a line is there doesn't matter."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").withColumn("hash", F.xxhash64("line"))
    least = lines.groupBy(F.pmod("hash", F.lit(SAMPLE_LINES)).alias("class")).agg(F.min("hash").alias("hash")).select("hash")
    picked = lines.join(F.broadcast(least), "hash").groupBy("hash").agg(F.min("line").alias("line")).orderBy("hash")
    return [r["line"] for r in picked.collect()]


def scan_lines(texts: pa.Array, model: Model, known: dict) -> list[list[dict]]:
    """The licence spans of texts without nulls."""
    split = pc.split_pattern(texts, "\n")
    bounds, lines = split.offsets.to_numpy(), split.values
    offsets, codes, dictionary = words_of(lines)
    core = pc.utf8_trim(pc.utf8_lower(dictionary), MARKS)
    cue = pc.is_in(core, pa.array(sorted(cues()), core.type)).to_numpy(zero_copy_only=False).astype(np.int64)
    cue[pc.is_in(core, pa.array(sorted(STRONG), core.type)).to_numpy(zero_copy_only=False)] = 2
    total = np.concatenate([[0], np.cumsum(cue[codes])])
    hits = np.flatnonzero(total[offsets[1:]] - total[offsets[:-1]] >= 2)
    before = np.concatenate([[0], np.cumsum(pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for i in hits.tolist():
        line = lines[i].as_py()
        if line not in known:
            if len(known) > 20_000:
                known.clear()
            known[line] = model.classify(line)
        if known[line] is not None:
            row = int(np.searchsorted(bounds, i, side="right")) - 1
            start = int(before[i] - before[bounds[row]])
            family, p = known[line]
            out[row].append({"family": family, "start": start, "end": start + len(line), "probability": p})
    owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(bounds)), np.diff(offsets))
    for row in may_be_wrapped(owner, codes, core.to_pylist(), dictionary.to_pylist()).tolist():
        text = texts[row].as_py()
        begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in text.split("\n")])]).tolist()
        for first, last, family, p in wrapped(text, model):
            start, end = begins[first], begins[last + 1] - 1
            rest = [x for x in out[row] if not (start <= x["start"] and x["end"] <= end and x["family"] in (family, "unknown"))]
            out[row] = sorted([*rest, {"family": family, "start": start, "end": end, "probability": p}], key=lambda x: (x["start"], x["end"]))
    return out


def scan(docs: DataFrame, model: Model, text: str = "text", out: str = "licences") -> DataFrame:
    """docs with an array of (family, start, end, probability) added: code points of lines; a column of this name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.temperature))
    known: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan_lines(held(batch.column(batch.schema.get_field_index(text))), Model(*sent.value), known)
        kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        keep = [n for n in batch.schema.names if n != out]
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in keep] + [pa.array(found, kind)], [*keep, out])

    return in_slices(docs, text, work, T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, SPANS)]))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines or wrapped notices state a licence, the families by name, and family:start:end of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scan(docs, train(sample(docs)))
    spans = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",")
    return rows.select("doc_id", F.size("licences").cast("long").alias("n_found"), families.alias("families"), spans.alias("spans"))
